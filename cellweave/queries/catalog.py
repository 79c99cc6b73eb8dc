"""Tag selection, tag indexes and bookkeeping, over documents, labels and the region tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.operators import catalog as cat
from cellweave.plans import extraction
from cellweave.queries import Query
from cellweave.queries.inputs import CONVERSATION_PORTIONS, conversation_portions, load
from cellweave.sources.worldfiles import format_index
from cellweave.tables import in_order


def documents_index(spark, d):
    """Documents as tables tagged by language and source."""
    return load(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("table_path"), F.array("lang", "source").alias("tags"), "n_chars"
    )


def any_tag(spark, d):
    return cat.with_any_tag(documents_index(spark, d), ["fr", "src3"]).select("table_path")


def none_tag(spark, d):
    return cat.without_tags(documents_index(spark, d), ["fr", "src3"]).select("table_path")


def checked_tags(spark, d):
    wanted, unwanted = ["fr", "en"], ["src3", "src5"]
    cat.check_tag_lists(wanted, unwanted)
    return cat.without_tags(cat.with_any_tag(documents_index(spark, d), wanted), unwanted).select("table_path")


def enabled(spark, d):
    df = documents_index(spark, d).withColumn("disabled", F.col("n_chars") < 500)
    return cat.enabled(df).select("table_path")


def all_tags(spark, d):
    index = documents_index(spark, d)
    return cat.paths_with_all_tags(index, cat.inverted_index(index), ["en", "src3"])


def all_tags_by_filter(spark, d):
    return cat.with_all_tags(documents_index(spark, d), ["en", "src3"]).select("table_path")


def inverted(spark, d):
    return cat.inverted_index(documents_index(spark, d))


def exactly_one(spark, d):
    nation, region = load(spark, d, "nation"), load(spark, d, "region")
    index = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("table_path"), F.array("n_name", "r_name").alias("tags")
    )
    return cat.only_row(cat.with_all_tags(index, ["NATION_3"]), "NATION_3").select("table_path")


def region_catalog(spark, d):
    """Region, nation, supplier as a tree of groups and tables."""
    region, nation, supplier = (load(spark, d, n) for n in ("region", "nation", "supplier"))
    tags = lambda *c: F.array(*c).cast("array<string>").alias("tags")
    kind = lambda k: F.lit(k).alias("kind")
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    size = F.when(F.col("s_acctbal") < 0, "debt").when(F.col("s_acctbal") < 5000, "small").otherwise("large")
    root = region.groupBy().agg(F.count("*").alias("n")).select(F.lit("w").alias("path"), kind("group"), tags(F.lit("book/world")))
    groups = region.select(F.concat(F.lit("w/"), "r_name").alias("path"), kind("group"), tags(F.lower("r_name")))
    subgroups = nations.select(
        F.concat(F.lit("w/"), "r_name", F.lit("/"), "n_name").alias("path"), kind("group"), tags("n_name", F.lit("nation"))
    )
    tables = supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("w/"), "r_name", F.lit("/"), "n_name", F.lit("/"), F.translate(F.lower("s_name"), "#", "-")).alias("path"),
        kind("table"),
        tags(size, F.lit("nation")),
    )
    return root.unionByName(groups).unionByName(subgroups).unionByName(tables)


REGION_TABLES = """tree AS (
    SELECT 'w/' || r_name || '/' || n_name || '/' || replace(lower(s_name), '#', '-') AS path,
           [CASE WHEN s_acctbal < 0 THEN 'debt' WHEN s_acctbal < 5000 THEN 'small' ELSE 'large' END,
            'nation', n_name, lower(r_name), 'book/world'] AS tags
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def inherit_tags(spark, d):
    return cat.inherit_tags(region_catalog(spark, d)).select("path", F.array_join("tags", ";").alias("tags"))


def flat_paths(spark, d):
    return cat.output_paths(cat.inherit_tags(region_catalog(spark, d))).select("out_path")


def ordered_work(spark, d):
    tables = cat.output_paths(cat.inherit_tags(region_catalog(spark, d)))
    return in_order(tables.withColumn("book", F.lit("w")), ("book",), [F.col("out_path")], "position").select(
        "out_path", "position"
    )


def pages(spark, d):
    df = cat.pages_of(conversation_portions(spark, d), 1)
    return df.select("table_id", F.array_join(F.col("pages").cast("array<string>"), ";").alias("pages"))


BRAND_NUMBER = "cast(substring(brand, 7) as int)"


def supplier_brands(spark, d):
    """Suppliers with the brands they sold more of than twice their mean brand; some have none."""
    line = load(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.col("l_quantity").cast("bigint").alias("quantity"))
    part = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    sold = line.join(part, "l_partkey").groupBy("l_suppkey", "p_brand").agg(F.sum("quantity").alias("quantity"))
    brands = (
        sold.groupBy("l_suppkey")
        .agg(F.sum("quantity").alias("whole"), F.collect_list(F.struct("p_brand", "quantity")).alias("each"))
        .withColumn("large", F.filter("each", lambda b: b["quantity"] * F.size("each") > F.col("whole") * 2))
        .select("l_suppkey", F.col("large.p_brand").alias("brands"))
    )
    return load(spark, d, "supplier").join(brands, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(
        "s_suppkey", "s_name", "s_nationkey", F.coalesce("brands", F.array().cast("array<string>")).alias("codes")
    )


def brand_codes(spark, d):
    """Brands as codes of a few classes; the thirteenth is not on the list."""
    return (
        load(spark, d, "part").selectExpr("p_brand AS brand").distinct()
        .selectExpr("brand AS code", f"concat('Class ', {BRAND_NUMBER} % 7) AS classification")
        .filter("code <> 'Brand#13'")
    )


SUPPLIER_BRANDS = """sold AS (
    SELECT l_suppkey, p_brand, sum(CAST(l_quantity AS BIGINT)) AS quantity
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_brand),
brands AS (
    SELECT l_suppkey AS s_suppkey, p_brand AS code FROM sold
    QUALIFY quantity * count(*) OVER (PARTITION BY l_suppkey) > sum(quantity) OVER (PARTITION BY l_suppkey) * 2),
codes AS (SELECT DISTINCT p_brand AS code, 'Class ' || (CAST(substr(p_brand, 7) AS INT) % 7) AS classification
          FROM part WHERE p_brand <> 'Brand#13')"""


def resolve_codes(spark, d):
    found = cat.resolve_codes(supplier_brands(spark, d), "s_suppkey", "codes", brand_codes(spark, d), False)
    return found.select("s_suppkey", F.array_join("classes", ";").alias("classes"), F.array_join("unknown", ";").alias("unknown"))


def resolve_known_codes(spark, d):
    found = cat.resolve_codes(supplier_brands(spark, d), "s_suppkey", "codes", brand_codes(spark, d), True)
    return found.select("s_suppkey", F.array_join("classes", ";").alias("classes"), F.size("unknown").cast("bigint").alias("unknown"))


def lookup_default(spark, d):
    customer, nation = load(spark, d, "customer"), load(spark, d, "nation")
    odd = nation.filter("n_nationkey % 2 = 1").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("known_as"))
    return customer.join(odd, "c_nationkey", "left").select("c_custkey", F.coalesce("known_as", F.lit("elsewhere")).alias("place"))


def field_override(spark, d):
    part = load(spark, d, "part")
    changes = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.max("l_linenumber").cast("int").alias("new_size")
    ).filter("new_size < 7")
    return part.join(changes, "p_partkey", "left").select(
        "p_partkey", cat.override(F.col("p_size"), F.col("new_size")).cast("bigint").alias("p_size")
    )


def merge_records(spark, d):
    customer = load(spark, d, "customer")
    place = lambda seg, nat: F.struct(seg.alias("segment"), nat.alias("nation")).alias("place")
    when = lambda cond, c: F.when(F.expr(cond), F.col(c))
    a = customer.filter("c_custkey % 5 <> 0").select(
        "c_custkey", when("c_custkey % 2 = 0", "c_name").alias("name"),
        place(when("c_custkey % 3 <> 0", "c_mktsegment"), when("c_custkey % 7 = 0", "c_nationkey")),
    )
    b = customer.filter("c_custkey % 4 <> 0").select(
        "c_custkey", F.when(F.expr("c_custkey % 6 = 2"), F.upper("c_name")).otherwise(F.col("c_name")).alias("name"),
        place(F.lit(None).cast("string"), F.when(F.expr("c_custkey % 14 = 0"), F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey"))),
    )
    m = cat.merge_records(a, b, "c_custkey")
    return m.select(
        "c_custkey", "name", F.col("place.segment").alias("segment"), F.col("place.nation").cast("bigint").alias("nation"),
        F.array_join("conflicts", ";").alias("conflicts"),
    )


def audit(spark, d):
    docs, labels = load(spark, d, "documents"), load(spark, d, "labels")
    tables = docs.filter("n_chars >= 100").select(
        F.col("doc_id").cast("string").alias("path"), F.when(F.col("lang") != "fr", F.col("lang")).alias("transform")
    )
    return cat.audit(tables, labels.select(F.col("doc_id").cast("string").alias("path")))


NAMES = ["opening", "reply", "follow-up", "answer"]


def _named(spark, d):
    turns = load(spark, d, "conversations").select("conv_id", "turn", "role")
    return cat.name_by_position(turns, "conv_id", [F.col("turn")], NAMES)


def name_by_position(spark, d):
    return _named(spark, d)[0].select("conv_id", "turn", "name")


def name_by_position_errors(spark, d):
    return _named(spark, d)[1]


STEM = """CASE p_size % 4 WHEN 0 THEN replace(p_name, ' ', '-type-') WHEN 1 THEN replace(p_name, ' ', '-class-')
    WHEN 2 THEN concat(replace(p_name, ' ', '-'), '-small-craft') ELSE replace(p_name, ' ', '_') END"""


def category_from_name(spark, d):
    stems = load(spark, d, "part").selectExpr("p_partkey", f"{STEM} AS stem")
    name, category = cat.craft_name_and_category(F.col("stem"))
    return stems.select("p_partkey", name.alias("name"), category.alias("category"))


def validate_names(spark, d):
    part, pages_ = load(spark, d, "part"), load(spark, d, "pages")
    names = part.selectExpr("concat('p', p_partkey) AS id", "CASE p_size % 2 WHEN 0 THEN replace(p_name, ' ', '_') ELSE p_name END AS text")
    urls = pages_.selectExpr("concat('u', page_id) AS id", "substring(url, 8) AS text")
    paths = pages_.selectExpr("concat('r', page_id) AS id", "concat(CASE page_id % 4 WHEN 0 THEN '/' WHEN 1 THEN '../' WHEN 2 THEN './' ELSE '' END, 'page/', page_id) AS text")
    text = F.col("text")
    return names.unionByName(urls).unionByName(paths).select(
        "id", cat.valid_name(text).alias("name_ok"), cat.valid_tag(text).alias("tag_ok"),
        cat.valid_node_id(text).alias("node_ok"), cat.valid_relative_path(text).alias("path_ok"),
    )


def _hashed(spark, d):
    docs = load(spark, d, "documents")
    return docs.select("doc_id", cat.content_key(F.col("text"), [F.col("lang")]).alias("key"), "n_chars")


def content_keys(spark, d):
    return _hashed(spark, d).select("doc_id", "key")


def incremental_run(spark, d):
    """Labelled documents have stored results; the others, unless copies of these, are worked on now."""
    work = _hashed(spark, d)
    labelled = load(spark, d, "labels").select("doc_id")
    result = lambda df, run: df.groupBy("key").agg(F.max("n_chars").alias("result")).withColumn("run", F.lit(run))
    stored = result(work.join(labelled, "doc_id", "left_semi"), "stored")
    fresh = result(cat.new_work(work, stored), "fresh")
    return cat.stored_and_fresh(work, stored, fresh)


def outcomes(spark, d):
    key = lambda df: df.select(F.col("doc_id").cast("string").alias("table_id"), *[c for c in df.columns if c != "doc_id"])
    labels = load(spark, d, "labels")
    errors = key(labels.filter("toxic = 1").select("doc_id", F.lit("rejected").alias("error")))
    return cat.outcomes(key(load(spark, d, "documents").select("doc_id")), key(labels.filter("quality = 1").select("doc_id")), errors)


def outcome_counts(spark, d):
    return outcomes(spark, d).groupBy("ok", "error").agg(F.count("*").alias("n"))


def index_upsert(spark, d):
    old = documents_index(spark, d).filter("cast(table_path as bigint) % 3 <> 0").withColumn("pages", F.array(F.lit(1)))
    new = load(spark, d, "labels").select(
        F.col("doc_id").cast("string").alias("table_path"),
        F.array(F.concat(F.lit("quality/"), "quality"), F.concat(F.lit("a/toxic/"), "toxic")).alias("tags"),
        F.array(F.lit(12), F.lit(3)).alias("pages"),
    )
    return format_index(cat.upsert_index(old, new))


def skip_existing(spark, d):
    work = documents_index(spark, d).select(F.col("table_path").alias("out_path"), "n_chars")
    done = load(spark, d, "labels").select(F.col("doc_id").cast("string").alias("table_path"))
    return cat.without_outputs(work, done, overwrite=False)


def _extraction_work(spark, d):
    turns = load(spark, d, "conversations")
    tables = turns.groupBy("conv_id").agg(F.max("turn").alias("last")).selectExpr(
        "concat('c/', conv_id) AS path", "'table' AS kind", "array(concat('turns/', last)) AS tags",
        "last < 2 AS disabled", "CASE WHEN last % 2 = 0 THEN 'fold' WHEN last % 3 = 0 THEN 'wrap' END AS transform",
    )
    root = tables.groupBy().agg(F.count("*").alias("n")).selectExpr(
        "'c' AS path", "'group' AS kind", "array('talk') AS tags", "false AS disabled", "cast(null as string) AS transform"
    )
    index = turns.filter("turn = 5").selectExpr("concat('c/', conv_id, '.csv') AS table_path").distinct()
    choice = extraction.Choice(with_tags=["talk"], without_tags=["turns/3"])
    return extraction.work_list(tables.unionByName(root), index, choice)


def extraction_run(spark, d):
    """Choose conversations by tags, leave written ones out, reshape the rest by their transform."""
    from cellweave.operators import reshape
    from cellweave.operators.grouping import AllRows

    portions = conversation_portions(spark, d).withColumn("table_id", F.concat(F.lit("c/"), "table_id"))
    transforms = {"fold": [reshape.fold_rows([AllRows()])], "wrap": [reshape.wrap_row_every_n(1)]}
    out, _ = extraction.extract(_extraction_work(spark, d), portions, transforms)
    return out.groupBy("table_id").agg(F.count("*").alias("n_rows"), F.sum(F.size("cells")).alias("n_cells"))


def extraction_index(spark, d):
    portions = conversation_portions(spark, d).withColumn("table_id", F.concat(F.lit("c/"), "table_id"))
    return format_index(extraction.index_rows(_extraction_work(spark, d), portions))


EXTRACTION_WORK = """work AS (
    SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id
    HAVING max(turn) >= 2 AND max(turn) <> 3 AND count(*) FILTER (turn = 5) = 0)"""

QUERIES = {
    "r1_any_tag": Query(any_tag, "SELECT CAST(doc_id AS VARCHAR) AS table_path FROM documents WHERE lang = 'fr' OR source = 'src3'"),
    "r2_none_tag": Query(none_tag, "SELECT CAST(doc_id AS VARCHAR) AS table_path FROM documents WHERE lang <> 'fr' AND source <> 'src3'"),
    "r3_checked_tag_lists": Query(
        checked_tags,
        "SELECT CAST(doc_id AS VARCHAR) AS table_path FROM documents WHERE lang IN ('fr', 'en') AND source NOT IN ('src3', 'src5')",
    ),
    "r4_enabled": Query(enabled, "SELECT CAST(doc_id AS VARCHAR) AS table_path FROM documents WHERE n_chars >= 500"),
    "r5_all_tags_lookup": Query(
        all_tags, "SELECT CAST(doc_id AS VARCHAR) AS table_path FROM documents WHERE lang = 'en' AND source = 'src3'"
    ),
    "r5_all_tags_filter": Query(
        all_tags_by_filter, "SELECT CAST(doc_id AS VARCHAR) AS table_path FROM documents WHERE lang = 'en' AND source = 'src3'"
    ),
    "r6_inverted_index": Query(
        inverted,
        """SELECT lang AS tag, CAST(doc_id AS VARCHAR) AS table_path FROM documents
UNION SELECT source, CAST(doc_id AS VARCHAR) FROM documents""",
    ),
    "r7_exactly_one": Query(exactly_one, "SELECT n_name AS table_path FROM nation WHERE n_name = 'NATION_3'"),
    "r8_inherit_tags": Query(
        inherit_tags,
        f"WITH {REGION_TABLES} SELECT path, array_to_string(list_sort(list_distinct(tags)), ';') AS tags FROM tree",
    ),
    "r9_flat_paths": Query(flat_paths, f"WITH {REGION_TABLES} SELECT path || '.csv' AS out_path FROM tree"),
    "r10_ordered_work_list": Query(
        ordered_work,
        f"WITH {REGION_TABLES} SELECT path || '.csv' AS out_path, row_number() OVER (ORDER BY path || '.csv') - 1 AS position FROM tree",
    ),
    "r11_distinct_pages": Query(
        pages,
        """SELECT CAST(conv_id AS VARCHAR) AS table_id, string_agg(CAST(page AS VARCHAR), ';' ORDER BY page) AS pages
FROM (SELECT DISTINCT conv_id, turn + 1 AS page FROM conversations) GROUP BY conv_id""",
    ),
    "r12_resolve_codes": Query(
        resolve_codes,
        f"""WITH {SUPPLIER_BRANDS}
SELECT s_suppkey, coalesce(string_agg(DISTINCT classification, ';' ORDER BY classification), '') AS classes,
       coalesce(string_agg(DISTINCT code, ';') FILTER (classification IS NULL), '') AS unknown
FROM supplier LEFT JOIN brands USING (s_suppkey) LEFT JOIN codes USING (code) GROUP BY s_suppkey""",
    ),
    "r12_resolve_known_codes": Query(
        resolve_known_codes,
        f"""WITH {SUPPLIER_BRANDS}
SELECT s_suppkey, coalesce(string_agg(DISTINCT classification, ';' ORDER BY classification), '') AS classes,
       CAST(0 AS BIGINT) AS unknown
FROM supplier LEFT JOIN brands USING (s_suppkey) LEFT JOIN codes USING (code) GROUP BY s_suppkey""",
    ),
    "r13_lookup_with_default": Query(
        lookup_default,
        """SELECT c_custkey, coalesce(n_name, 'elsewhere') AS place
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 1""",
    ),
    "r14_field_override": Query(
        field_override,
        """SELECT p_partkey, CAST(coalesce(n, p_size) AS BIGINT) AS p_size FROM part LEFT JOIN
(SELECT l_partkey, max(l_linenumber) AS n FROM lineitem GROUP BY l_partkey HAVING max(l_linenumber) < 7) ON l_partkey = p_partkey""",
    ),
    "r15_merge_records": Query(
        merge_records,
        """WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name,
    CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 7 = 0 THEN c_nationkey END AS nation
    FROM customer WHERE c_custkey % 5 <> 0),
b AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 2 THEN upper(c_name) ELSE c_name END AS name,
    CASE WHEN c_custkey % 14 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS nation FROM customer WHERE c_custkey % 4 <> 0)
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey,
       CASE WHEN a.name <> b.name THEN NULL ELSE coalesce(a.name, b.name) END AS name, a.segment AS segment,
       CAST(CASE WHEN a.nation <> b.nation THEN NULL ELSE coalesce(a.nation, b.nation) END AS BIGINT) AS nation,
       concat_ws(';', CASE WHEN a.name <> b.name THEN 'name' END, CASE WHEN a.nation <> b.nation THEN 'place.nation' END) AS conflicts
FROM a FULL JOIN b ON a.c_custkey = b.c_custkey""",
    ),
    "r16_audit": Query(
        audit,
        """WITH t AS (SELECT doc_id, lang FROM documents WHERE n_chars >= 100)
SELECT CAST(doc_id AS VARCHAR) AS path, 'template without table' AS problem FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM t)
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'table without template' FROM t WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'no extraction configured' FROM t
WHERE lang = 'fr' AND doc_id IN (SELECT doc_id FROM labels)""",
    ),
    "r17_name_by_position": Query(
        name_by_position,
        """SELECT conv_id, turn, ['opening', 'reply', 'follow-up', 'answer'][row_number() OVER (PARTITION BY conv_id ORDER BY turn)] AS name
FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) = 4)""",
    ),
    "r17_name_by_position_errors": Query(
        name_by_position_errors,
        "SELECT conv_id, count(*) AS n, CAST(4 AS BIGINT) AS expected FROM conversations GROUP BY conv_id HAVING count(*) <> 4",
    ),
    "r18_category_from_name": Query(
        category_from_name,
        """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN split_part(p_name, ' ', 1)
           WHEN 2 THEN replace(p_name, ' ', '-') ELSE replace(p_name, ' ', '_') END AS name,
       CASE p_size % 4 WHEN 0 THEN 'spacecraft-type/' || split_part(p_name, ' ', 2)
           WHEN 1 THEN 'spacecraft-class/' || split_part(p_name, ' ', 2) WHEN 2 THEN 'category/small-craft' ELSE '' END AS category
FROM part""",
    ),
    "r19_validate_names": Query(
        validate_names,
        """WITH t AS (
    SELECT 'p' || p_partkey AS id, CASE p_size % 2 WHEN 0 THEN replace(p_name, ' ', '_') ELSE p_name END AS text FROM part
    UNION ALL SELECT 'u' || page_id, substr(url, 8) FROM pages
    UNION ALL SELECT 'r' || page_id, CASE page_id % 4 WHEN 0 THEN '/' WHEN 1 THEN '../' WHEN 2 THEN './' ELSE '' END || 'page/' || page_id FROM pages)
SELECT id, regexp_full_match(text, '[a-z0-9_-]+') AS name_ok,
       regexp_full_match(text, '[a-z0-9_/-]+') AND text NOT LIKE '/%' AND text NOT LIKE '%/' AND text NOT LIKE '%//%' AS tag_ok,
       regexp_full_match(text, '[a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?') AS node_ok,
       text NOT LIKE '/%' AND NOT list_contains(string_split(text, '/'), '..') AND string_split(text, '/')[1] <> '.' AS path_ok
FROM t""",
    ),
    "r20_content_key": Query(
        content_keys, "SELECT doc_id, sha256(sha256(text) || chr(1) || lang) AS key FROM documents"
    ),
    "r20_incremental_run": Query(
        incremental_run,
        """WITH work AS (SELECT doc_id, sha256(sha256(text) || chr(1) || lang) AS key, n_chars FROM documents),
stored AS (SELECT key, max(n_chars) AS result FROM work WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY key)
SELECT key, result, 'stored' AS run FROM stored
UNION ALL SELECT key, max(n_chars), 'fresh' FROM work WHERE key NOT IN (SELECT key FROM stored) GROUP BY key""",
    ),
    "r21_outcomes": Query(
        outcomes,
        """SELECT CAST(d.doc_id AS VARCHAR) AS table_id, coalesce(quality = 1 AND toxic = 0, false) AS ok,
       CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN NULL ELSE 'no output' END AS error
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    ),
    "r21_outcome_counts": Query(
        outcome_counts,
        """SELECT ok, error, count(*) AS n FROM (SELECT coalesce(quality = 1 AND toxic = 0, false) AS ok,
       CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN NULL ELSE 'no output' END AS error
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY ok, error""",
    ),
    "k4_index_upsert": Query(
        index_upsert,
        """SELECT CAST(doc_id AS VARCHAR) AS table_path, '1' AS pages, lang || ';' || source AS tags, n_chars FROM documents
WHERE doc_id % 3 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT CAST(doc_id AS VARCHAR), '3;12', 'a/toxic/' || toxic || ';quality/' || quality, NULL FROM labels""",
    ),
    "k7_skip_existing": Query(
        skip_existing,
        """SELECT CAST(doc_id AS VARCHAR) AS out_path, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    ),
    "extraction_run": Query(
        extraction_run,
        f"""WITH {EXTRACTION_WORK}, {CONVERSATION_PORTIONS},
sizes AS (SELECT CAST(table_id AS BIGINT) AS conv_id, count(*) AS n FROM portions GROUP BY table_id)
SELECT 'c/' || conv_id AS table_id,
       CASE WHEN last % 2 = 0 THEN 1 WHEN last % 3 = 0 THEN 2 * n ELSE n END AS n_rows,
       CASE WHEN last % 2 = 0 THEN 2 ELSE 2 * n END AS n_cells
FROM work JOIN sizes USING (conv_id)""",
    ),
    "extraction_index": Query(
        extraction_index,
        f"""WITH {EXTRACTION_WORK}
SELECT 'c/' || conv_id || '.csv' AS table_path, string_agg(CAST(turn + 1 AS VARCHAR), ';' ORDER BY turn) AS pages,
       'talk;turns/' || last AS tags FROM work JOIN conversations USING (conv_id) GROUP BY conv_id, last""",
    ),
}
