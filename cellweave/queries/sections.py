"""Sectioning of marked lines and patches of ordered tables.

The marked lines are made from the words of whole conversations: each word is a
line, and its length picks what kind of line it becomes. The SQL walks the lines
of each table one by one with a recursive query, keeping the state as the
definition says.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.operators import sections as sec
from cellweave.queries import Query
from cellweave.queries.inputs import DOCUMENT_LINES, document_lines, load, rows
from cellweave.tables import layout_of, renumber, routed

SUFFIX, LIST_MARKER = " SKILLS PACKAGE", "Skills:"
TITLE_MARKER = "Specialities"

PACKAGE_LINE = """CASE length(word) % 6
    WHEN 0 THEN concat(word, ' ', turn, ' SKILLS PACKAGE')
    WHEN 1 THEN 'Skills:'
    WHEN 2 THEN concat(word, ' ', length(word), ', Other ', turn, ',')
    WHEN 3 THEN ' SKILLS PACKAGE'
    ELSE concat('about ', word) END"""

TITLE_LINE = """CASE length(word) % 9
    WHEN 0 THEN concat('Topic T', word)
    WHEN 1 THEN 'Specialities'
    WHEN 2 THEN concat('• ', word, ': about ', role)
    WHEN 3 THEN concat(word, ': ', turn)
    WHEN 4 THEN '• plain bullet'
    WHEN 5 THEN concat('some ', word)
    WHEN 6 THEN concat('Title: ', word)
    WHEN 7 THEN word
    ELSE concat('more than two ', word) END"""

# Words of a turn follow those of the turn before it.
ORDER = "turn * 1000000 + at"


def _marked_lines(spark, d, line: str):
    words = load(spark, d, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", "[ \n]", -1)).alias("at", "word"))
    return words.selectExpr("cast(conv_id as string) AS table_id", f"cast({ORDER} as bigint) AS row_ix", f"{line} AS line")


def _marked_sql(line: str) -> str:
    return f"""words AS (
    SELECT conv_id, turn, role, generate_subscripts(ws, 1) - 1 AS "at", unnest(ws) AS word
    FROM (SELECT *, regexp_split_to_array(text, '[ \n]') AS ws FROM conversations)),
marked AS MATERIALIZED (
    SELECT CAST(conv_id AS VARCHAR) AS table_id, {ORDER.replace("at", '"at"')} AS row_ix, {line} AS line FROM words),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_ix) AS n FROM marked)"""


PACKAGES_SQL = f"""RECURSIVE {_marked_sql(PACKAGE_LINE)},
walk AS (
    SELECT table_id, CAST(0 AS BIGINT) AS n, 'seek' AS state, CAST(NULL AS BIGINT) AS section_ix, CAST(NULL AS VARCHAR) AS kind,
           CAST('' AS VARCHAR) AS line FROM (SELECT DISTINCT table_id FROM placed)
    UNION ALL
    SELECT p.table_id, p.n,
           CASE WHEN h AND w.state IN ('seek', 'list') THEN 'description'
                WHEN p.line = 'Skills:' AND w.state = 'description' THEN 'list' ELSE w.state END,
           CASE WHEN h AND w.state IN ('seek', 'list') THEN p.row_ix ELSE w.section_ix END,
           CASE WHEN h AND w.state IN ('seek', 'list') THEN 'name'
                WHEN p.line = 'Skills:' AND w.state = 'description' THEN NULL
                WHEN w.state <> 'seek' THEN w.state END,
           p.line
    FROM walk w JOIN (SELECT *, line LIKE '_% SKILLS PACKAGE' AS h FROM placed) p
      ON p.table_id = w.table_id AND p.n = w.n + 1),
packages AS (
    SELECT table_id, section_ix, max(replace(line, ' SKILLS PACKAGE', '')) FILTER (kind = 'name') AS name,
           coalesce(string_agg(line, ' ' ORDER BY n) FILTER (kind = 'description'), '') AS description,
           coalesce(string_agg(line, ' ' ORDER BY n) FILTER (kind = 'list'), '') AS list_text
    FROM walk WHERE section_ix IS NOT NULL GROUP BY table_id, section_ix)"""

PAIRS_SQL = f"""{PACKAGES_SQL},
pairs AS (
    SELECT table_id, section_ix, CAST(generate_subscripts(names, 1) - 1 AS BIGINT) AS child_ix,
           trim(unnest(names)) AS name, CAST(unnest(levels) AS BIGINT) AS level
    FROM (SELECT *, regexp_extract_all(list_text, '([^,0-9]+)([0-9]+)', 1) AS names,
                 regexp_extract_all(list_text, '([^,0-9]+)([0-9]+)', 2) AS levels FROM packages))"""

TITLES_SQL = f"""RECURSIVE {_marked_sql(TITLE_LINE)},
walk AS (
    SELECT table_id, CAST(0 AS BIGINT) AS n, 'find' AS state, CAST(NULL AS BIGINT) AS section_ix,
           CAST(NULL AS BIGINT) AS item_ix, CAST(NULL AS VARCHAR) AS part, CAST('' AS VARCHAR) AS line
    FROM (SELECT DISTINCT table_id FROM placed)
    UNION ALL
    SELECT p.table_id, p.n,
           CASE WHEN h THEN 'desc'
                WHEN w.state = 'desc' AND p.line = 'Specialities' THEN 'find spec'
                WHEN w.state = 'desc' AND colon THEN 'find'
                WHEN w.state IN ('find spec', 'example', 'spec') AND bullet THEN 'spec'
                WHEN w.state = 'spec' AND colon THEN 'example'
                ELSE w.state END,
           CASE WHEN h THEN p.row_ix ELSE w.section_ix END,
           CASE WHEN h THEN NULL
                WHEN w.state IN ('find spec', 'example', 'spec') AND bullet THEN p.row_ix
                ELSE w.item_ix END,
           CASE WHEN h THEN 'name'
                WHEN w.state = 'desc' AND p.line <> 'Specialities' AND NOT colon THEN 'description'
                WHEN w.state IN ('find spec', 'example', 'spec') AND bullet THEN 'item'
                WHEN w.state = 'spec' AND NOT colon THEN 'item' END,
           p.line
    FROM walk w JOIN (
        SELECT *, len(string_split(line, ' ')) <= 2 AND line <> 'Specialities'
                  AND regexp_matches(string_split(line, ' ')[1], '[A-Z][a-z]+')
                  AND regexp_matches(string_split(line, ' ')[-1], '[A-Z][a-z]+') AS h,
               line LIKE '• %' AS bullet, line LIKE '%:%' AS colon FROM placed) p
      ON p.table_id = w.table_id AND p.n = w.n + 1)"""


def _split_lines(spark, d):
    lines = document_lines(spark, d)
    return lines.select("table_id", "row_ix", F.split("line", r"[ ,]", -1).alias("cells"))


def lines(spark, d):
    return sec.lines_of(_split_lines(spark, d))


def filled_lines(spark, d):
    return sec.lines_of(_split_lines(spark, d), keep_empty_cells=False)


def _packages(spark, d):
    df = _marked_lines(spark, d, PACKAGE_LINE)
    return routed(df, lambda part, layout: sec.suffix_sections(part, SUFFIX, LIST_MARKER, layout))


def suffix_sections(spark, d):
    return _packages(spark, d)


def _pairs(packages):
    return packages.select(
        "table_id", "section_ix", F.posexplode(sec.name_level_pairs(F.col("list_text"))).alias("child_ix", "pair")
    ).select("table_id", "section_ix", F.col("child_ix").cast("bigint").alias("child_ix"), "pair.name", "pair.level")


def name_level_pairs(spark, d):
    return _pairs(_packages(spark, d))


def _titles(spark, d, what):
    df = _marked_lines(spark, d, TITLE_LINE)
    return routed(df, lambda part, layout: what(sec.title_sections(part, TITLE_MARKER, layout), layout))


def title_sections(spark, d):
    return _titles(spark, d, sec.section_records)


def section_items(spark, d):
    return _titles(spark, d, sec.section_items)


def sparse_rows(spark, d):
    packages = _packages(spark, d)
    parents = [F.col("name"), F.lit(""), F.lit(""), F.col("description")]
    children = [F.lit(""), F.col("name"), F.col("level").cast("string"), F.lit("")]
    out = sec.sparse_rows(packages, parents, _pairs(packages), children)
    return out.select("table_id", "row_ix", *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(4)])


def ditto_fill(spark, d):
    events = load(spark, d, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "").otherwise(F.col("event_type"))
    df = rows(events, F.col("user_id"), F.col("event_id"), [kind, F.col("event_id")])
    out = sec.ditto_fill(df, 0, layout_of(df))
    return out.select("table_id", F.col("row_ix").alias("event_id"), F.get("cells", F.lit(0)).alias("kind"))


def append_next_row(spark, d):
    customer = load(spark, d, "customer")
    df = rows(customer, F.col("c_nationkey"), F.col("c_custkey"), [F.col("c_name"), F.col("c_mktsegment")])
    out = sec.append_next_row(df, 15, 0, layout_of(df))
    return out.select("table_id", "row_ix", F.get("cells", F.lit(0)).alias("c0"), F.get("cells", F.lit(1)).alias("c1"))


def dense_rows(spark, d):
    orders = load(spark, d, "orders")
    df = rows(orders, F.col("o_orderstatus"), F.col("o_orderkey"), [F.col("o_orderkey")])
    return renumber(df, layout_of(df)).select("table_id", "row_ix", F.get("cells", F.lit(0)).alias("o_orderkey"))


QUERIES = {
    "x1_rows_to_lines": Query(
        lines,
        f"""WITH {DOCUMENT_LINES}
SELECT table_id, row_ix, replace(line, ',', ' ') AS line FROM lines""",
    ),
    "x2_rows_to_lines_filled": Query(
        filled_lines,
        f"""WITH {DOCUMENT_LINES}
SELECT table_id, row_ix, trim(regexp_replace(replace(line, ',', ' '), ' +', ' ', 'g'), ' ') AS line FROM lines""",
    ),
    "x3_suffix_sections": Query(suffix_sections, f"WITH {PACKAGES_SQL} SELECT * FROM packages"),
    "x4_name_level_pairs": Query(name_level_pairs, f"WITH {PAIRS_SQL} SELECT * FROM pairs"),
    "x5_title_sections": Query(
        title_sections,
        f"""WITH {TITLES_SQL}
SELECT table_id, section_ix, max(line) FILTER (part = 'name') AS name,
       coalesce(string_agg(line, ' ' ORDER BY n) FILTER (part = 'description'), '') AS description
FROM walk WHERE section_ix IS NOT NULL GROUP BY table_id, section_ix""",
    ),
    "x6_section_items": Query(
        section_items,
        f"""WITH {TITLES_SQL}, items AS (
    SELECT table_id, section_ix, item_ix, string_agg(line, ' ' ORDER BY n) AS text
    FROM walk WHERE part = 'item' GROUP BY table_id, section_ix, item_ix)
SELECT *, nullif(regexp_extract(text, '• ([^:]+): (.+)', 1), '') AS name,
       nullif(regexp_extract(text, '• ([^:]+): (.+)', 2), '') AS description FROM items""",
    ),
    "x7_sparse_rows": Query(
        sparse_rows,
        f"""WITH {PAIRS_SQL}, both_kinds AS (
    SELECT table_id, section_ix, CAST(-1 AS BIGINT) AS child_ix, name AS c0, '' AS c1, '' AS c2, description AS c3 FROM packages
    UNION ALL SELECT table_id, section_ix, child_ix, '', name, CAST(level AS VARCHAR), '' FROM pairs)
SELECT table_id, row_number() OVER (PARTITION BY table_id ORDER BY section_ix, child_ix) - 1 AS row_ix, c0, c1, c2, c3
FROM both_kinds""",
    ),
    "x8_ditto_fill": Query(
        ditto_fill,
        """SELECT CAST(user_id AS VARCHAR) AS table_id, event_id,
       coalesce(last_value(CASE WHEN event_type NOT IN ('click', 'view') THEN event_type END IGNORE NULLS)
                OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), '') AS kind FROM events""",
    ),
    "x9_append_next_row": Query(
        append_next_row,
        """SELECT CAST(c_nationkey AS VARCHAR) AS table_id, c_custkey AS row_ix,
       CASE WHEN n = 16 AND below IS NOT NULL THEN c_name || ' ' || below WHEN n = 17 THEN '' ELSE c_name END AS c0,
       c_mktsegment AS c1
FROM (SELECT *, row_number() OVER w AS n, lead(c_name) OVER w AS below FROM customer
      WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey))""",
    ),
    "w1_dense_row_numbers": Query(
        dense_rows,
        """SELECT o_orderstatus AS table_id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS row_ix,
       CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM orders""",
    ),
}
