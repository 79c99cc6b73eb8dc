"""Readers and writers: data derived from the tables is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.plans.records import worlds_from_sector
from cellweave.queries import Query
from cellweave.queries.catalog import SUPPLIER_BRANDS
from cellweave.queries.inputs import CONVERSATION_PORTIONS, DOCUMENT_LINES, conversation_portions, load, rows
from cellweave.queries.trade import OVERRIDES_SQL, goods_rows, overrides, worlds_csv_rows
from cellweave.operators.reshape import concat_portions
from cellweave.session import scratch_path
from cellweave.sources import csvtables, worldfiles
from cellweave.tables import layout_of, renumber, to_cells


def document_rows(spark, d):
    """Documents as rows of a table per source: language, text with line breaks and quotes, length."""
    docs = load(spark, d, "documents")
    return rows(
        docs, F.col("source"), F.col("doc_id"), [F.when(F.col("lang") == "fr", "").otherwise(F.col("lang")), F.concat(F.lit('say "'), "text", F.lit('", then')), F.col("n_chars")]
    )


DOCUMENT_ROWS = """doc_rows AS (
    SELECT source AS table_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row_ix,
           [CASE WHEN lang = 'fr' THEN '' ELSE lang END, 'say "' || text || '", then', CAST(n_chars AS VARCHAR)] AS cells FROM documents)"""


def csv_round_trip(spark, d):
    """Write the tables as CSV text, and read them back as portions."""
    path = scratch_path(spark, "tables")
    csvtables.write_csv_tables(document_rows(spark, d), path)
    back = concat_portions(csvtables.read_written_tables(spark, path))
    # A record has a line at least, so lines, which need no shuffle to be counted, say how long tables are at most.
    return to_cells(renumber(back, layout_of(csvtables.written_lines(spark, path))))


def flexible_csv(spark, d):
    """Files of ragged lines, each with a title that is dropped again on reading."""
    orders = load(spark, d, "orders")
    line = "CASE o_orderkey % 3 WHEN 0 THEN concat(o_orderkey, ',', o_orderpriority) WHEN 1 THEN concat(o_orderkey, ',\"a, b\",') ELSE concat(o_orderkey, '') END"
    lines = orders.selectExpr("o_orderkey div 10000 AS file", "o_orderkey AS at", f"{line} AS value")
    titles = lines.select("file").distinct().selectExpr("file", "cast(-1 as bigint) AS at", "'title,,' AS value")
    path = scratch_path(spark, "flexible")
    (
        lines.unionByName(titles)
        .repartition("file")
        .sortWithinPartitions("file", "at")
        .select("file", "value")
        .write.partitionBy("file")
        .text(path)
    )
    back = csvtables.read_csv_body(spark, path)
    return back.select(F.get("cells", F.lit(0)).alias("o_orderkey"), F.size("cells").cast("bigint").alias("n_cells"), F.array_join("cells", "|").alias("line"))


def _keyed_file(df, name: str, sep: str = ",", quote: str = '"') -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.option("header", True).option("sep", sep).option("quote", quote).option("escape", quote).option("emptyValue", quote * 2).csv(path)
    return path


def _flat_worlds(df):
    n = lambda c: F.col(c).cast("bigint")
    return df.select(
        "name", n("location.subsector_hex.x").alias("x"), n("location.subsector_hex.y").alias("y"), F.col("uwp.starport").alias("starport"),
        n("uwp.law_level").alias("law_level"), n("uwp.tech_level").alias("tech_level"),
        F.array_join(F.array_sort("social.trade_codes"), ":").alias("codes"),
    )


def worlds_csv(spark, d):
    path = _keyed_file(worlds_csv_rows(spark, d).drop("s_suppkey"), "worlds")
    return _flat_worlds(worldfiles.read_worlds(spark, "csv", path))


SECTOR_COLUMNS = {
    "Sector": "'Spin'", "SS": "CASE s_suppkey % 3 WHEN 0 THEN '' ELSE 'A' END", "Hex": "Location", "Name": "concat('\"', Name, ' of')",
    "UWP": "UWP", "Bases": "substring('KMKN', 1, cast(s_suppkey % 5 as int))", "Remarks": "replace(`Trade Codes`, ':', ' ')",
    "Zone": "substring('AR', cast(s_suppkey % 3 as int) + 1, 1)", "PBG": "concat(s_suppkey % 10, 1, s_suppkey % 4)", "Allegiance": "'ZhIN'",
    "Stars": "CASE s_suppkey % 2 WHEN 0 THEN 'G8 V M1 V' ELSE '' END", "{Ix}": "concat('{ ', s_suppkey % 6 - 3, ' }')",
    "(Ex)": "concat('(C', s_suppkey % 10, '3-1)')", "[Cx]": "'[65 9]'", "Nobility": "''", "W": "s_suppkey % 14", "RU": "s_suppkey * 7 - 300",
}


def _sector_rows(spark, d):
    return worlds_csv_rows(spark, d).selectExpr(*[f"cast({e} as string) AS `{c}`" for c, e in SECTOR_COLUMNS.items()])


def sector_tsv(spark, d):
    path = _keyed_file(_sector_rows(spark, d), "sector", "\t", "")
    return _flat_sector(worldfiles.read_worlds(spark, "sector_tsv", path))


def sector_rows(spark, d):
    return _flat_sector(worlds_from_sector(_sector_rows(spark, d)))


def _flat_sector(df):
    n = lambda c: F.col(c).cast("bigint")
    words = lambda c: F.array_join(c, ";")
    return df.select(
        "name", "travel_code", F.col("uwp.starport").alias("starport"), F.col("location.sector_abbv").alias("sector"),
        F.col("location.subsector").alias("subsector"), n("location.subsector_hex.x").alias("x"), n("location.subsector_hex.y").alias("y"),
        F.col("social.allegiance").alias("allegiance"), words("social.bases").alias("bases"), F.col("social.nobility").alias("nobility"),
        n("social.pop_multiplier").alias("pop"), words(F.array_sort("social.trade_codes")).alias("codes"), F.col("ext.cultural").alias("cultural"),
        F.col("ext.economic").alias("economic"), n("ext.importance").alias("importance"), n("ext.resource_units").alias("ru"),
        n("system.num_belts").alias("belts"), n("system.num_gas_giants").alias("giants"), n("system.num_worlds").alias("worlds"),
        words("system.stellar").alias("stars"),
    )


def overrides_csv(spark, d):
    """Overrides written as text and read back; a repeated key in a later row wins."""
    shown = overrides(spark, d).selectExpr(
        "location AS Location", "d66 AS D66", "coalesce(cast(available as string), '') AS Available",
        "coalesce(cast(purchase_dm as string), '') AS `Purchase DM`", "coalesce(cast(sale_dm as string), '') AS `Sale DM`",
        "upper(coalesce(cast(illegal as string), '')) AS Illegal", "'note, with comma' AS Comment",
    )
    twice = shown.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "Sale DM", F.when(F.col("again") == 0, F.lit("99")).otherwise(F.col("Sale DM"))
    )
    ordered = twice.repartition("Location", "D66").sortWithinPartitions("Location", "D66", "again").drop("again")
    return worldfiles.read_overrides(spark, _keyed_file(ordered, "overrides"))


def illegality_csv(spark, d):
    shown = goods_rows(spark, d).filter("b % 3 = 0").selectExpr("D66", "lo % 10 AS `Illegal law level`")
    return worldfiles.read_illegality(spark, _keyed_file(shown, "illegality"))


def index_csv(spark, d):
    docs = load(spark, d, "documents")
    index = docs.select(
        F.concat(F.lit("d/"), "doc_id", F.lit(".csv")).alias("table_path"),
        F.array(F.lit(12), F.expr("cast(doc_id % 9 as int)")).alias("pages"), F.array("source", "lang").alias("tags"), "n_chars",
    )
    path = scratch_path(spark, "index")
    worldfiles.write_index(index, path)
    back = worldfiles.read_index(spark, path)
    return back.select("table_path", "n_chars", F.explode("pages").alias("page"), F.array_join("tags", "|").alias("tags")).withColumn(
        "page", F.col("page").cast("bigint")
    )


def world_source(spark, d):
    """The source is picked by name; both give the same worlds."""
    plain = worlds_csv_rows(spark, d)
    tsv = _sector_rows(spark, d)
    found = {
        "csv": worldfiles.read_worlds(spark, "csv", _keyed_file(plain.drop("s_suppkey"), "worlds")),
        "sector_tsv": worldfiles.read_worlds(spark, "sector_tsv", _keyed_file(tsv, "sector", "\t", "")),
    }
    counts = [df.groupBy("uwp.starport").agg(F.count("*").alias("n")).withColumn("source", F.lit(k)) for k, df in found.items()]
    return counts[0].unionByName(counts[1])


def recognised_json(spark, d):
    """Recogniser output per document: a row per line, a boxed text per phrase."""
    box = lambda w, i: F.struct(
        F.lit(1.5).alias("top"), i.cast("double").alias("left"), F.length(w).cast("double").alias("width"), F.lit(9.0).alias("height"), w.alias("text")
    )
    docs = load(spark, d, "documents").select(
        "doc_id", F.to_json(F.transform(F.split("text", "\n", -1), lambda line: F.transform(F.split(line, ", ", -1), box))).alias("data")
    )
    flat = csvtables.flatten_recognised(docs)
    return flat.select("doc_id", "row_ix", F.size("cells").cast("bigint").alias("n_cells"), F.array_join("cells", "|").alias("line"))


def csv_text(spark, d):
    """The CSV text of each row, line ends aside."""
    return csvtables.csv_lines(document_rows(spark, d)).select("table_id", "row_ix", "value")


def _json_tables(spark, d):
    df = conversation_portions(spark, d)
    return csvtables.table_json(concat_portions(df))


def json_text(spark, d):
    return _json_tables(spark, d).select("table_id", F.sha2("json", 256).alias("digest"))


def json_round_trip(spark, d):
    path = scratch_path(spark, "json")
    csvtables.write_json_tables(concat_portions(conversation_portions(spark, d)), path)
    return to_cells(csvtables.read_json_tables(spark, path))


def _mixed_json(spark, d):
    """JSON tables, some of which are spoiled."""
    spoil = (
        F.when(F.expr("cast(table_id as bigint) % 7 = 1"), F.replace("json", F.lit('[["'), F.lit('[[12,"')))
        .when(F.expr("cast(table_id as bigint) % 7 = 2"), F.lit('{"rows": []}'))
        .when(F.expr("cast(table_id as bigint) % 7 = 3"), F.concat(F.lit('[["x"],"row",'), F.substring("json", 2, 1 << 30)))
        .when(F.expr("cast(table_id as bigint) % 7 = 4"), F.lit("[[["))
        .when(F.expr("cast(table_id as bigint) % 7 = 5"), F.concat(F.lit('[[],["a",["b"]],'), F.substring("json", 2, 1 << 30)))
        .otherwise(F.col("json"))
    )
    return _json_tables(spark, d).withColumn("json", spoil)


def json_to_csv(spark, d):
    rows_, _ = csvtables.json_to_rows(_mixed_json(spark, d))
    return csvtables.csv_lines(rows_)


def json_errors(spark, d):
    return csvtables.json_to_rows(_mixed_json(spark, d))[1]


_CSV_CELL = """CASE WHEN contains({c}, ',') OR contains({c}, '"') OR contains({c}, chr(10)) OR contains({c}, chr(13))
    THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END"""


def _csv_cell(c: str) -> str:
    return _CSV_CELL.replace("{c}", c)


WORLDS_FLAT_SQL = f"""{SUPPLIER_BRANDS},
listed AS (SELECT s_suppkey, string_agg(code, ':' ORDER BY code) AS codes FROM brands GROUP BY s_suppkey),
flat AS (SELECT s_suppkey AS k, s_name, s_nationkey AS nk, lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') AS loc,
                coalesce(codes, '') AS codes FROM supplier LEFT JOIN listed USING (s_suppkey))"""

SECTOR_SQL = f"""WITH {WORLDS_FLAT_SQL}
SELECT '"' || s_name || ' of' AS name, CASE k % 3 WHEN 0 THEN 'Amber' WHEN 1 THEN 'Red' ELSE '' END AS travel_code,
       substr('ABCDEX', nk % 6 + 1, 1) AS starport, 'Spin' AS sector, CASE k % 3 WHEN 0 THEN NULL ELSE 'A' END AS subsector,
       CAST(substr(loc, 1, 2) AS BIGINT) AS x, CAST(substr(loc, 3) AS BIGINT) AS y, 'ZhIN' AS allegiance,
       CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'K' WHEN 2 THEN 'K;M' WHEN 3 THEN 'K;M' ELSE 'K;M;N' END AS bases, '' AS nobility,
       k % 10 AS pop, replace(codes, ':', ';') AS codes, '65 9' AS cultural, 'C' || (k % 10) || '3-1' AS economic,
       k % 6 - 3 AS importance, k * 7 - 300 AS ru, CAST(1 AS BIGINT) AS belts, k % 4 AS giants, k % 14 AS worlds,
       CASE k % 2 WHEN 0 THEN 'G8;V;M1;V' ELSE '' END AS stars FROM flat"""

QUERIES = {
    "s1_k1_csv_tables": Query(
        csv_round_trip,
        f"""WITH {DOCUMENT_ROWS}
SELECT table_id, row_ix, CAST(generate_subscripts(cells, 1) - 1 AS BIGINT) AS col_ix, unnest(cells) AS cell FROM doc_rows""",
    ),
    "s2_flexible_csv": Query(
        flexible_csv,
        """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END AS n_cells,
       o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '|' || o_orderpriority WHEN 1 THEN '|a, b|' ELSE '' END AS line FROM orders""",
    ),
    "s3_worlds_csv": Query(
        worlds_csv,
        f"""WITH {WORLDS_FLAT_SQL}
SELECT s_name AS name, CAST(substr(loc, 1, 2) AS BIGINT) AS x, CAST(substr(loc, 3) AS BIGINT) AS y,
       substr('ABCDEX', nk % 6 + 1, 1) AS starport, CAST(nk % 10 AS BIGINT) AS law_level, k % 7 AS tech_level, codes FROM flat""",
    ),
    "s4_sector_tsv": Query(sector_tsv, SECTOR_SQL),
    "n2_sector_worlds": Query(sector_rows, SECTOR_SQL),
    "s5_overrides_csv": Query(
        overrides_csv,
        f"""WITH {OVERRIDES_SQL}
SELECT location, d66, available, CAST(purchase_dm AS BIGINT) AS purchase_dm, CAST(sale_dm AS BIGINT) AS sale_dm, illegal FROM overrides""",
    ),
    "s6_illegality_csv": Query(
        illegality_csv,
        """SELECT CAST(substr(p_brand, 7) AS INT) || '-' || left(p_type, 2) AS d66, CAST(min(p_size) % 10 AS BIGINT) AS illegal_level
FROM part WHERE CAST(substr(p_brand, 7) AS INT) % 3 = 0 GROUP BY p_brand, p_type""",
    ),
    "s7_world_source": Query(
        world_source,
        """SELECT substr('ABCDEX', s_nationkey % 6 + 1, 1) AS starport, count(*) AS n, source
FROM supplier, (VALUES ('csv'), ('sector_tsv')) v(source) GROUP BY 1, source""",
    ),
    "s8_index_csv": Query(
        index_csv,
        """SELECT 'd/' || doc_id || '.csv' AS table_path, CAST(n_chars AS VARCHAR) AS n_chars, CASE p.i WHEN 0 THEN 12 ELSE doc_id % 9 END AS page,
       lang || '|' || source AS tags FROM documents, (VALUES (0), (1)) p(i)""",
    ),
    "s10_flatten_recognised": Query(
        recognised_json,
        f"""WITH {DOCUMENT_LINES}
SELECT CAST(table_id AS BIGINT) AS doc_id, row_ix, len(string_split(line, ', ')) AS n_cells, replace(line, ', ', '|') AS line FROM lines""",
    ),
    "k1_csv_text": Query(
        csv_text,
        f"""SELECT source AS table_id, doc_id AS row_ix, CASE WHEN lang = 'fr' THEN '' ELSE lang END || ',' || {_csv_cell("t")} || ',' || n_chars AS value
FROM (SELECT *, 'say "' || text || '", then' AS t FROM documents)""",
    ),
    "k2_json_to_csv": Query(
        json_to_csv,
        f"""WITH {CONVERSATION_PORTIONS}
SELECT table_id, row_number() OVER (PARTITION BY table_id ORDER BY part_ix, row_ix) - 1 AS row_ix,
       role || ',' || {_csv_cell("line")} AS value FROM portions WHERE CAST(table_id AS BIGINT) % 7 IN (0, 6)""",
    ),
    "k3_json_tables": Query(
        json_text,
        f"""WITH {CONVERSATION_PORTIONS}
SELECT table_id, sha256('[' || string_agg('["' || role || '",' || CAST(to_json(line) AS VARCHAR) || ']', ',' ORDER BY part_ix, row_ix) || ']') AS digest
FROM portions GROUP BY table_id""",
    ),
    "k3_json_round_trip": Query(
        json_round_trip,
        f"""WITH {CONVERSATION_PORTIONS},
placed AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY part_ix, row_ix) - 1 AS r FROM portions)
SELECT table_id, r AS row_ix, CAST(c.i AS BIGINT) AS col_ix, CASE c.i WHEN 0 THEN role ELSE line END AS cell
FROM placed, (VALUES (0), (1)) c(i)""",
    ),
    "u3_table_type_errors": Query(
        json_errors,
        """SELECT DISTINCT CAST(conv_id AS VARCHAR) AS table_id, CASE conv_id % 7
    WHEN 1 THEN 'want Array[Array[string]], got .[0][0] with type number' WHEN 2 THEN 'want Array[Array[string]], got . with type Object'
    WHEN 3 THEN 'want Array[Array[string]], got .[1] with type string' WHEN 4 THEN 'not JSON'
    ELSE 'want Array[Array[string]], got .[1][1] with type Array' END AS error
FROM conversations WHERE conv_id % 7 BETWEEN 1 AND 5""",
    ),
}
