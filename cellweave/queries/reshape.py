"""Reshaping steps and row groupers over documents, conversations, orders and parts."""

from __future__ import annotations

from itertools import zip_longest

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators import reshape
from cellweave.operators.grouping import AllRows, EmptyColumn, StaticRowCounts, assign_groups
from cellweave.operators.userfn import concat_tables, named_inputs_function, table_function
from cellweave.queries import Query
from cellweave.queries.inputs import (
    CONVERSATION_PORTIONS,
    DOCUMENT_LINES,
    DOCUMENT_WORDS,
    HEADED_LINES,
    cells_sql,
    conversation_portions,
    document_lines,
    document_words,
    headed_lines,
    load,
    rows,
)
from cellweave.tables import layout_of, renumber, to_cells

# White space as a character class, for an engine whose \s knows only ASCII.
SPACE_CLASS = r"[\t\n\x0B\f\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _run(df: DataFrame, steps: list, clean: bool = False) -> DataFrame:
    layout = layout_of(df)
    return to_cells(renumber(reshape.sequence(df, steps, clean=clean, layout=layout), layout))


def _columns(df: DataFrame, n: int, key: str) -> DataFrame:
    return df.select(F.col("row_ix").alias(key), *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(n)])


# One step each ---------------------------------------------------------------


def concat_portions(spark, d):
    df = reshape.concat_portions(conversation_portions(spark, d))
    return to_cells(renumber(df, layout_of(df)))


def clean_cells(spark, d):
    lines = document_lines(spark, d)
    df = lines.select("table_id", "row_ix", F.split("line", ",", -1).alias("cells"))
    return to_cells(reshape.sequence(df, []))


PRIORITY_PATTERN = r"(?P<level>\d)-(\w+)"


def expand_column(spark, d):
    orders = load(spark, d, "orders")
    df = rows(orders, F.col("o_orderstatus"), F.col("o_orderkey"), [F.col("o_orderkey"), F.col("o_orderpriority")])
    step = reshape.expand_column_on_regex(1, PRIORITY_PATTERN, [r"level \g<level>", r"\2"], ["", r"\g<0>"])
    return _columns(reshape.sequence(df, [step]), 3, "o_orderkey")


def join_columns(spark, d):
    part = load(spark, d, "part")
    df = rows(part, F.col("p_brand"), F.col("p_partkey"), [F.col(c) for c in ("p_partkey", "p_name", "p_type", "p_size")])
    return _columns(reshape.sequence(df, [reshape.join_columns(1, 3, " / ")]), 4, "p_partkey")


def prepend_row(spark, d):
    customer, nation = load(spark, d, "customer"), load(spark, d, "nation")
    df = rows(customer, F.col("c_nationkey"), F.col("c_custkey"), [F.col("c_name"), F.col("c_mktsegment")])
    work = nation.select(F.col("n_nationkey").cast("string").alias("table_id"))
    return to_cells(reshape.sequence(df, [reshape.prepend_row(["Name", "Segment"], work)], clean=False))


def fold_rows(spark, d):
    return _run(headed_lines(spark, d), [reshape.fold_rows([StaticRowCounts((1,)), EmptyColumn(0)])])


def split_column(spark, d):
    events = load(spark, d, "events")
    df = rows(events, F.col("event_type"), F.col("event_id"), [F.col("event_id"), F.col("props"), F.col("event_type")])
    return _columns(reshape.sequence(df, [reshape.split_column(1, r":\s*")]), 4, "event_id")


def transpose(spark, d):
    lines = document_lines(spark, d)
    return _run(lines.select("table_id", "row_ix", F.split("line", ", ", -1).alias("cells")), [reshape.transpose()])


def transpose_long_tables(spark, d):
    part = load(spark, d, "part")
    df = rows(part, F.col("p_brand"), F.col("p_partkey"), [F.col("p_name"), F.col("p_type"), F.col("p_size")])
    return reshape.transpose_cells(df)


def wrap_row(spark, d):
    return _run(document_words(spark, d), [reshape.wrap_row_every_n(7)])


def no_transform(spark, d):
    df = reshape.concat_portions(conversation_portions(spark, d))
    return df.select("table_id", "row_ix", F.get("cells", F.lit(0)).alias("role"), F.get("cells", F.lit(1)).alias("line"))


SEQUENCE = [
    reshape.join_columns(from_=1, delim=" "),
    reshape.expand_column_on_regex(0, r"([A-Z][a-z]*)", [r"\1"], [""]),
    reshape.fold_rows([EmptyColumn(0)]),
    reshape.prepend_row(["Word", "Text"]),
]


def step_sequence(spark, d):
    return _run(document_words(spark, d), SEQUENCE, clean=True)


def wrap_transpose(spark, d):
    return _run(document_words(spark, d), [reshape.wrap_row_every_n(5), reshape.transpose()], clean=True)


# Long tables: all documents of a language are one table, cut into chunks -----------


def _long_tables(spark, d):
    """Headed lines by language; the order is sparse, as after concatenating portions."""
    docs = load(spark, d, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    head = F.regexp_extract("line", r"\A([A-Z]\S*)", 1)
    df = docs.select(
        F.col("lang").alias("table_id"),
        (F.shiftleft("doc_id", 20) + F.col("n")).alias("row_ix"),
        F.array(head, F.col("line")).alias("cells"),
    )
    return df, layout_of(df, bits=10)


LONG_TABLES = """long_rows AS (
    SELECT lang AS table_id, doc_id * 1048576 + generate_subscripts(ls, 1) - 1 AS row_ix, unnest(ls) AS line
    FROM (SELECT lang, doc_id, string_split(text, chr(10)) AS ls FROM documents)),
headed AS (SELECT table_id, row_ix, regexp_extract(line, '^([A-Z][^ \\t\\n\\f\\r]*)', 1) AS head,
                  line AS len FROM long_rows)"""


def _long_run(steps):
    def run(spark, d):
        df, layout = _long_tables(spark, d)
        return to_cells(renumber(reshape.sequence(df, steps, clean=False, layout=layout), layout))

    return run


fold_long_tables = _long_run([reshape.fold_rows([StaticRowCounts((3,)), EmptyColumn(0)])])
wrap_long_tables = _long_run([reshape.wrap_row_every_n(3)])


def wrap_transpose_wrap_long_tables(spark, d):
    df, layout = _long_tables(spark, d)
    steps = [reshape.wrap_row_every_n(3), reshape.transpose(), reshape.wrap_row_every_n(4)]
    return reshape.sequence_cells(df, steps, clean=False, layout=layout)


prepend_long_tables = _long_run([reshape.prepend_row(["Head", "Length"])])


# Groupers ----------------------------------------------------------------------


def _groups(groupers):
    def run(spark, d):
        df = headed_lines(spark, d)
        grouped = assign_groups(df, groupers, layout_of(df))
        return grouped.groupBy("table_id", "group_ix").agg(
            F.min("row_ix").alias("first_row"), F.max("row_ix").alias("last_row"), F.count("*").alias("n_rows")
        ).drop("group_ix")

    return run


def _groups_sql(group: str) -> str:
    return f"""WITH {HEADED_LINES}
SELECT table_id, min(row_ix) AS first_row, max(row_ix) AS last_row, count(*) AS n_rows
FROM (SELECT table_id, row_ix, {group} AS g FROM headed) GROUP BY table_id, g"""


HEADS = "sum(CASE WHEN head <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY row_ix)"


# User functions ----------------------------------------------------------------


def _number_lines(portions):
    return [[str(i), *row] for i, row in enumerate(concat_tables(portions))]


def user_function(spark, d):
    return to_cells(table_function(conversation_portions(spark, d), _number_lines)[0])


def _side_by_side(first, rest):
    return [[*a, *b] for a, b in zip_longest(first, rest, fillvalue=[])]


def named_inputs(spark, d):
    """The user's lines beside all others, as far as the longer side goes."""
    turns = conversation_portions(spark, d)
    side = lambda own: reshape.concat_portions(turns.filter(own))
    return to_cells(named_inputs_function({"rest": side("role <> 'user'"), "first": side("role = 'user'")}, _side_by_side)[0])


def _whole_table(portions):
    return [["rows", str(sum(map(len, portions)))], ["portions", str(len(portions))]]


def user_summary(spark, d):
    return to_cells(table_function(conversation_portions(spark, d), _whole_table)[0])


def _some_fail(portions):
    lines = sum(map(len, portions))
    if lines % 3 == 0:
        raise ValueError(f"{lines} lines")
    return [["lines", lines if lines % 3 == 1 else str(lines)]]


def user_errors(spark, d):
    """What happens to each table when the function raises for some and gives other results than rows of text for others."""
    rows_, errors = table_function(conversation_portions(spark, d), _some_fail)
    good = rows_.select("table_id", F.get("cells", F.lit(1)).alias("outcome"))
    return good.unionByName(errors.select("table_id", F.col("error").alias("outcome")))


QUERIES = {
    "t1_concat_portions": Query(
        concat_portions,
        cells_sql(
            f"{CONVERSATION_PORTIONS}, rs AS (SELECT table_id, part_ix, row_ix, [role, line] AS cells FROM portions)",
            "rs",
            "part_ix, row_ix",
        ),
    ),
    "t2_clean_cells": Query(
        clean_cells,
        f"""WITH {DOCUMENT_LINES}, split AS (SELECT table_id, row_ix, string_split(line, ',') AS cells FROM lines),
flat AS (SELECT table_id, row_ix, CAST(generate_subscripts(cells, 1) - 1 AS BIGINT) AS col_ix, unnest(cells) AS cell FROM split)
SELECT table_id, row_ix, col_ix, trim(regexp_replace(cell, '{SPACE_CLASS}', ' ', 'g'), ' ') AS cell FROM flat""",
    ),
    "t3_expand_column_on_regex": Query(
        expand_column,
        """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS c0,
       CASE WHEN regexp_full_match(o_orderpriority, '(\\d)-(\\w+)')
            THEN 'level ' || left(o_orderpriority, 1) ELSE '' END AS c1,
       CASE WHEN regexp_full_match(o_orderpriority, '(\\d)-(\\w+)')
            THEN substr(o_orderpriority, 3) ELSE o_orderpriority END AS c2 FROM orders""",
    ),
    "t4_join_columns": Query(
        join_columns,
        """SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS c0, p_name || ' / ' || p_type AS c1,
       CAST(p_size AS VARCHAR) AS c2, CAST(NULL AS VARCHAR) AS c3 FROM part""",
    ),
    "t5_prepend_row": Query(
        prepend_row,
        """SELECT CAST(c_nationkey AS VARCHAR) AS table_id, c_custkey + 1 AS row_ix, CAST(c.i AS BIGINT) AS col_ix,
       CASE c.i WHEN 0 THEN c_name ELSE c_mktsegment END AS cell
FROM customer, (VALUES (0), (1)) c(i)
UNION ALL
SELECT CAST(n_nationkey AS VARCHAR), CAST(0 AS BIGINT), CAST(c.i AS BIGINT), c.t
FROM nation, (VALUES (0, 'Name'), (1, 'Segment')) c(i, t)""",
    ),
    "t6_fold_rows": Query(
        fold_rows,
        cells_sql(
            f"""{HEADED_LINES},
groups AS (SELECT *, CASE WHEN row_ix = 0 THEN -1 ELSE sum(CASE WHEN row_ix > 0 AND head <> '' THEN 1 ELSE 0 END)
               OVER (PARTITION BY table_id ORDER BY row_ix) END AS g FROM headed),
folded AS (SELECT table_id, g, [coalesce(string_agg(nullif(head, ''), ' ' ORDER BY row_ix), ''),
                                coalesce(string_agg(nullif(line, ''), ' ' ORDER BY row_ix), '')] AS cells
           FROM groups GROUP BY table_id, g)""",
            "folded",
            "g",
        ),
    ),
    "t7_split_column": Query(
        split_column,
        """SELECT event_id, CAST(event_id AS VARCHAR) AS c0, trim(p[1]) AS c1, trim(p[2]) AS c2, event_type AS c3
FROM (SELECT *, string_split(props, ':') AS p FROM events)""",
    ),
    "t8_transpose": Query(
        transpose,
        f"""WITH {DOCUMENT_LINES}, words AS (SELECT table_id, row_ix, string_split(line, ', ') AS cells FROM lines),
widths AS (SELECT table_id, max(len(cells)) AS width FROM words GROUP BY table_id),
cols AS (SELECT table_id, unnest(range(width)) AS c FROM widths)
SELECT w.table_id, c AS row_ix, w.row_ix AS col_ix, coalesce(w.cells[c + 1], '') AS cell
FROM words w JOIN cols USING (table_id)""",
    ),
    "t8_transpose_long_tables": Query(
        transpose_long_tables,
        """SELECT p_brand AS table_id, CAST(c.i AS BIGINT) AS row_ix,
       row_number() OVER (PARTITION BY p_brand, c.i ORDER BY p_partkey) - 1 AS col_ix,
       CASE c.i WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE CAST(p_size AS VARCHAR) END AS cell
FROM part, (VALUES (0), (1), (2)) c(i)""",
    ),
    "t9_wrap_row_every_n": Query(
        wrap_row,
        f"""WITH {DOCUMENT_WORDS},
flat AS (SELECT table_id, row_ix, generate_subscripts(cells, 1) AS p, unnest(cells) AS cell FROM words),
placed AS (SELECT table_id, cell, row_number() OVER (PARTITION BY table_id ORDER BY row_ix, p) - 1 AS k FROM flat)
SELECT table_id, k // 7 AS row_ix, k % 7 AS col_ix, cell FROM placed""",
    ),
    "t10_no_transform": Query(
        no_transform,
        f"""WITH {CONVERSATION_PORTIONS}
SELECT table_id, part_ix * 4294967296 + row_ix AS row_ix, role, line FROM portions""",
    ),
    "t11_step_sequence": Query(
        step_sequence,
        cells_sql(
            f"""{DOCUMENT_WORDS},
joined AS (SELECT table_id, row_ix,
                  CASE WHEN regexp_full_match(cells[1], '[A-Z][a-z]*') THEN cells[1] ELSE '' END AS head,
                  CASE WHEN len(cells) > 1 THEN array_to_string(cells[2:], ' ') END AS rest FROM words),
groups AS (SELECT *, sum(CASE WHEN head <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY row_ix) AS g
           FROM joined),
folded AS (SELECT table_id, g, coalesce(string_agg(nullif(head, ''), ' ' ORDER BY row_ix), '') AS a,
                  CASE WHEN count(rest) > 0 THEN coalesce(string_agg(nullif(rest, ''), ' ' ORDER BY row_ix), '') END AS b
           FROM groups GROUP BY table_id, g),
cleaned AS (SELECT table_id, g, trim(regexp_replace(a, '{SPACE_CLASS}', ' ', 'g'), ' ') AS a,
                   trim(regexp_replace(b, '{SPACE_CLASS}', ' ', 'g'), ' ') AS b FROM folded),
headed AS (SELECT table_id, g, CASE WHEN b IS NULL THEN [a] ELSE [a, b] END AS cells FROM cleaned
           UNION ALL SELECT DISTINCT table_id, -1, ['Word', 'Text'] FROM lines)""",
            "headed",
            "g",
        ),
    ),
    "t11_wrap_then_transpose": Query(
        wrap_transpose,
        f"""WITH {DOCUMENT_WORDS},
flat AS (SELECT table_id, row_ix, generate_subscripts(cells, 1) AS p, unnest(cells) AS cell FROM words),
placed AS (SELECT table_id, cell, row_number() OVER (PARTITION BY table_id ORDER BY row_ix, p) - 1 AS k FROM flat),
sizes AS (SELECT table_id, count(*) AS n FROM flat GROUP BY table_id),
slots AS (SELECT table_id, unnest(range(CAST(least(n, 5) * ((n + 4) // 5) AS BIGINT))) AS s, n, (n + 4) // 5 AS h FROM sizes)
SELECT slots.table_id, s // h AS row_ix, s % h AS col_ix,
       trim(regexp_replace(coalesce(cell, ''), '{SPACE_CLASS}', ' ', 'g'), ' ') AS cell
FROM slots LEFT JOIN placed ON placed.table_id = slots.table_id AND placed.k = (s % h) * 5 + s // h""",
    ),
    "t5_prepend_long_tables": Query(
        prepend_long_tables,
        cells_sql(
            f"""{LONG_TABLES}, both_kinds AS (SELECT table_id, row_ix, [head, len] AS cells FROM headed
    UNION ALL SELECT DISTINCT table_id, -1, ['Head', 'Length'] FROM headed)""",
            "both_kinds",
        ),
    ),
    "t6_fold_long_tables": Query(
        fold_long_tables,
        cells_sql(
            f"""{LONG_TABLES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row_ix) - 1 AS rank FROM headed),
groups AS (SELECT *, CASE WHEN rank < 3 THEN -1 ELSE sum(CASE WHEN rank >= 3 AND head <> '' THEN 1 ELSE 0 END)
               OVER (PARTITION BY table_id ORDER BY row_ix) END AS g FROM ranked),
folded AS (SELECT table_id, g, [coalesce(string_agg(nullif(head, ''), ' ' ORDER BY row_ix), ''),
                                string_agg(len, ' ' ORDER BY row_ix)] AS cells FROM groups GROUP BY table_id, g)""",
            "folded",
            "g",
        ),
    ),
    "t11_wrap_transpose_wrap_long_tables": Query(
        wrap_transpose_wrap_long_tables,
        f"""WITH {LONG_TABLES},
flat AS (SELECT table_id, row_ix, 0 AS p, head AS cell FROM headed UNION ALL SELECT table_id, row_ix, 1, len FROM headed),
placed AS (SELECT table_id, cell, row_number() OVER (PARTITION BY table_id ORDER BY row_ix, p) - 1 AS k FROM flat),
sizes AS (SELECT table_id, count(*) AS n FROM flat GROUP BY table_id),
slots AS (SELECT table_id, unnest(range(CAST(least(n, 3) * ((n + 2) // 3) AS BIGINT))) AS s, (n + 2) // 3 AS h FROM sizes)
SELECT slots.table_id, s // 4 AS row_ix, s % 4 AS col_ix, coalesce(cell, '') AS cell
FROM slots LEFT JOIN placed ON placed.table_id = slots.table_id AND placed.k = (s % h) * 3 + s // h""",
    ),
    "t9_wrap_long_tables": Query(
        wrap_long_tables,
        f"""WITH {LONG_TABLES},
flat AS (SELECT table_id, row_ix, 0 AS p, head AS cell FROM headed UNION ALL SELECT table_id, row_ix, 1, len FROM headed),
placed AS (SELECT table_id, cell, row_number() OVER (PARTITION BY table_id ORDER BY row_ix, p) - 1 AS k FROM flat)
SELECT table_id, k // 3 AS row_ix, k % 3 AS col_ix, cell FROM placed""",
    ),
    "g1_all_rows": Query(_groups([StaticRowCounts((2,)), AllRows()]), _groups_sql("CASE WHEN row_ix < 2 THEN 0 ELSE 1 END")),
    "g2_static_row_counts": Query(
        _groups([StaticRowCounts((1, 3, 2))]),
        _groups_sql(
            "CASE WHEN row_ix < 1 THEN 0 WHEN row_ix < 4 THEN 1 WHEN row_ix < 6 THEN 4 ELSE row_ix END"
        ),
    ),
    "g3_empty_column": Query(_groups([EmptyColumn(0)]), _groups_sql(HEADS)),
    "g4_grouper_chain": Query(
        _groups([StaticRowCounts((1,)), StaticRowCounts((2,)), EmptyColumn(0)]),
        _groups_sql(f"CASE WHEN row_ix < 1 THEN -2 WHEN row_ix < 3 THEN -1 ELSE {HEADS} END"),
    ),
    "g5_rest_as_singletons": Query(
        _groups([StaticRowCounts((4,))]), _groups_sql("CASE WHEN row_ix < 4 THEN 0 ELSE row_ix END")
    ),
    "u1_user_function": Query(
        user_function,
        f"""WITH {CONVERSATION_PORTIONS},
placed AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY part_ix, row_ix) - 1 AS r FROM portions)
SELECT table_id, r AS row_ix, CAST(c.i AS BIGINT) AS col_ix,
       CASE c.i WHEN 0 THEN CAST(r AS VARCHAR) WHEN 1 THEN role ELSE line END AS cell
FROM placed, (VALUES (0), (1), (2)) c(i)""",
    ),
    "u1_user_function_errors": Query(
        user_errors,
        f"""WITH {CONVERSATION_PORTIONS}
SELECT table_id, CASE count(*) % 3 WHEN 0 THEN 'ValueError: ' || count(*) || ' lines'
       WHEN 1 THEN 'TypeError: row 0, cell 1 must be a str, not a int' ELSE CAST(count(*) AS VARCHAR) END AS outcome
FROM portions GROUP BY table_id""",
    ),
    "u2_named_inputs_function": Query(
        named_inputs,
        f"""WITH {CONVERSATION_PORTIONS},
n AS (SELECT table_id, role, line, role = 'user' AS own,
             row_number() OVER (PARTITION BY table_id, role = 'user' ORDER BY part_ix, row_ix) - 1 AS r FROM portions),
a AS (SELECT * FROM n WHERE own), b AS (SELECT * FROM n WHERE NOT own),
beside AS (SELECT coalesce(a.table_id, b.table_id) AS table_id, coalesce(a.r, b.r) AS row_ix,
                  list_concat(CASE WHEN a.role IS NULL THEN [] ELSE [a.role, a.line] END,
                              CASE WHEN b.role IS NULL THEN [] ELSE [b.role, b.line] END) AS cells
           FROM a FULL JOIN b ON a.table_id = b.table_id AND a.r = b.r)
SELECT table_id, row_ix, CAST(generate_subscripts(cells, 1) - 1 AS BIGINT) AS col_ix, unnest(cells) AS cell FROM beside""",
    ),
    "u4_user_function_with_helpers": Query(
        user_summary,
        f"""WITH {CONVERSATION_PORTIONS},
sizes AS (SELECT table_id, count(*) AS n, count(DISTINCT part_ix) AS p FROM portions GROUP BY table_id)
SELECT table_id, CAST(r.i AS BIGINT) AS row_ix, CAST(c.i AS BIGINT) AS col_ix,
       CASE WHEN c.i = 0 THEN r.t WHEN r.i = 0 THEN CAST(n AS VARCHAR) ELSE CAST(p AS VARCHAR) END AS cell
FROM sizes, (VALUES (0, 'rows'), (1, 'portions')) r(i, t), (VALUES (0), (1)) c(i)""",
    ),
}
