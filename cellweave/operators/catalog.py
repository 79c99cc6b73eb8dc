"""Selecting tables by tags, tag indexes, and bookkeeping of runs.

A catalog has one row per table or group: `(path, tags, ...)`; an index one row
per written table: `(table_path, pages, tags)`. Joins carry no hints: the
adaptive planner broadcasts a side it has measured to be small, and splits
partitions of a hot key otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.tables import Layout, in_order

#: An output file is named after its table, and ends so.
OUTPUT_SUFFIX = ".csv"

# What names, tags and node ids may look like, and how the stem of
# a craft's file tells its category.
NAME_PATTERN = r"\A[a-z0-9_-]+\z"
TAG_PATTERN = r"\A[a-z0-9_/-]+\z"
NODE_PATTERN = r"\A[a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?\z"
SMALL_CRAFT_STEM, SMALL_CRAFT_TAG = r"\A(.+)-small-craft", "category/small-craft"
TYPE_STEM, TYPE_TAG = r"\A(.+)-type-(.+)\z", "spacecraft-type/"
CLASS_STEM, CLASS_TAG = r"\A(.+)-class-(.+)\z", "spacecraft-class/"


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def check_tag_lists(with_tags: list[str], without_tags: list[str]) -> None:
    """The same tag cannot be wanted and unwanted."""
    both = sorted(set(with_tags) & set(without_tags))
    if both:
        raise ValueError(f"tags both included and excluded: {', '.join(both)}")


def with_any_tag(df: DataFrame, tags: list[str]) -> DataFrame:
    """Tables with at least one of the tags; no tags given keeps all."""
    return df.filter(F.arrays_overlap("tags", _literals(tags))) if tags else df


def without_tags(df: DataFrame, tags: list[str]) -> DataFrame:
    """Tables with none of the tags."""
    return df.filter(~F.arrays_overlap("tags", _literals(tags))) if tags else df


def enabled(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("disabled"))


def with_all_tags(df: DataFrame, tags: list[str]) -> DataFrame:
    """Tables with every tag; no tags given keeps all."""
    return df.filter(F.size(F.array_except(_literals(tags), F.col("tags"))) == 0) if tags else df


def only_row(df: DataFrame, what: str) -> DataFrame:
    """The single row of `df`; any other number of rows is an error."""
    rows = df.limit(2).count()
    if rows != 1:
        found = "none" if rows == 0 else "more"
        raise ValueError(f"want exactly 1 table for {what}, found {found}")
    return df


def inverted_index(df: DataFrame, path: str = "table_path") -> DataFrame:
    """Tag to path, one row each: a tag on very many tables stays spread out."""
    return df.select(F.explode("tags").alias("tag"), path).distinct()


def paths_with_all_tags(index: DataFrame, inverted: DataFrame, tags: list[str]) -> DataFrame:
    """Look up paths with every tag in the inverted index."""
    if not tags:
        return index.select("table_path").distinct()
    wanted = sorted(set(tags))
    return (
        inverted.filter(F.col("tag").isin(wanted))
        .groupBy("table_path")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") == len(wanted))
        .select("table_path")
    )


def inherit_tags(catalog: DataFrame) -> DataFrame:
    """Give every table the tags of the groups above it.

    `catalog` has `(path, kind, tags)`, paths `/`-separated, kind `group` or
    `table`. Tags are first worked out for groups alone, of which there are far
    fewer than tables; each table then looks up just its own group.
    """
    groups = catalog.filter("kind = 'group'").select("path", "tags")
    steps = F.split("path", "/")
    above = groups.select(
        "path",
        F.explode(
            F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
        ).alias("above"),
    )
    merged = (
        above.join(groups.select(F.col("path").alias("above"), "tags"), "above")
        .groupBy("path")
        .agg(F.array_distinct(F.flatten(F.collect_list("tags"))).alias("group_tags"))
    )
    return (
        catalog.filter("kind = 'table'")
        .withColumn("group_path", F.regexp_extract("path", r"\A(.*)/[^/]*\z", 1))
        .join(merged.withColumnRenamed("path", "group_path"), "group_path", "left")
        .withColumn(
            "tags",
            F.array_sort(F.array_union("tags", F.coalesce("group_tags", F.array().cast("array<string>")))),
        )
        .drop("group_path", "group_tags", "kind")
    )


def output_paths(tables: DataFrame) -> DataFrame:
    """Name the output file of each table. Sort by it where order is wanted: joins do not keep it."""
    return tables.withColumn("out_path", F.concat("path", F.lit(OUTPUT_SUFFIX)))


def pages_of(portions: DataFrame, page_offset: int) -> DataFrame:
    """The distinct source pages of each table, sorted."""
    return (
        portions.select("table_id", (F.col("page") + page_offset).alias("page"))
        .distinct()
        .groupBy("table_id")
        .agg(F.array_sort(F.collect_list("page")).alias("pages"))
    )


def resolve_codes(
    df: DataFrame, key: str, codes_column: str, codes: DataFrame, ignore_unknown: bool, place: str | None = None
) -> DataFrame:
    """Replace an array of codes by the distinct classifications they stand for.

    `codes` has `(code, classification)`. Of rows that repeat a code the last one
    counts, by the column `place`; without it, that with the largest classification.
    Gives `(key, classes, unknown)`; unless they are ignored, unknown codes are
    listed in `unknown` for the caller.
    """
    order = F.struct(place, "classification") if place else F.col("classification")
    codes = codes.groupBy("code").agg(F.max_by("classification", order).alias("classification"))
    each = df.select(key, F.explode_outer(F.array_distinct(codes_column)).alias("code"))
    found = each.join(codes.select("code", "classification"), "code", "left")
    missing = F.when(F.col("code").isNotNull() & F.col("classification").isNull(), F.col("code"))
    return found.groupBy(key).agg(
        F.array_sort(F.collect_set("classification")).alias("classes"),
        (F.array().cast("array<string>") if ignore_unknown else F.array_sort(F.collect_set(missing))).alias("unknown"),
    )


def override(value: Column, by: Column) -> Column:
    return F.coalesce(by, value)


def merge_records(left: DataFrame, right: DataFrame, key: str, whole: tuple[str, ...] = ()) -> DataFrame:
    """Merge partial records: the set field wins, equal fields stay, unequal ones conflict.

    Struct fields are merged field by field, but for those named in `whole` (as
    `a` or `a.b`): these are equal or not as one value, like all others. Arrays
    are sets; of maps the entries count. `conflicts` names unequal fields; they
    come out null.
    """
    a, b = left.alias("a"), right.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    conflicts: list[Column] = []

    def merge(x: Column, y: Column, data_type, name: str) -> Column:
        if hasattr(data_type, "fields") and name not in whole:
            fields = [merge(x[f.name], y[f.name], f.dataType, f"{name}.{f.name}").alias(f.name) for f in data_type.fields]
            return F.when(x.isNotNull() | y.isNotNull(), F.struct(*fields))
        if hasattr(data_type, "fields"):
            # Two values are at hand, maybe with null fields, which are equal to each other.
            unequal = F.when(x.isNotNull() & y.isNotNull(), ~x.eqNullSafe(y))
        elif data_type.typeName() == "array":
            unequal = F.array_sort(x) != F.array_sort(y)
        elif data_type.typeName() == "map":
            unequal = F.array_sort(F.map_entries(x)) != F.array_sort(F.map_entries(y))
        else:
            unequal = x != y
        conflicts.append(F.when(unequal, F.lit(name)))
        return F.when(F.coalesce(unequal, F.lit(False)), None).otherwise(F.coalesce(x, y))

    fields = [f for f in left.schema.fields if f.name != key]
    merged = [merge(F.col(f"a.{f.name}"), F.col(f"b.{f.name}"), f.dataType, f.name).alias(f.name) for f in fields]
    return joined.select(
        F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key),
        *merged,
        F.array_compact(F.array(*conflicts)).alias("conflicts"),
    )


def audit(tables: DataFrame, templates: DataFrame) -> DataFrame:
    """Problems of a catalog: `(path, problem)`.

    `tables` has `(path, transform)`, `templates` has `(path)`.
    """
    both = tables.select("path", "transform", F.lit(True).alias("_table")).join(
        templates.select("path", F.lit(True).alias("_template")), "path", "full_outer"
    )
    problem = (
        F.when(F.col("_table").isNull(), "template without table")
        .when(F.col("_template").isNull(), "table without template")
        .when(F.col("transform").isNull(), "no extraction configured")
    )
    return both.select("path", problem.alias("problem")).filter("problem is not null")


def name_by_position(
    df: DataFrame, group: str, order: list[Column], names: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Give the nth row of each group the nth name.

    Groups of another size come back as errors `(group, n, expected)`.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    right = sizes.filter(F.col("n") == len(names)).select(group)
    # The groups left have exactly len(names) rows.
    small = Layout(chunked=False)
    ranked = in_order(df.join(right, group, "left_semi"), (group,), order, "position", small)
    named = ranked.withColumn("name", F.get(_literals(names), F.col("position").cast("int")))
    errors = sizes.filter(F.col("n") != len(names)).withColumn("expected", F.lit(len(names)).cast("bigint"))
    return named, errors


def craft_name_and_category(stem: Column) -> tuple[Column, Column]:
    """Split a file stem such as `scout-type-s` into name and category tag."""
    named = lambda pattern, tag: F.concat(F.lit(tag), F.regexp_extract(stem, pattern, 2))
    rules = [
        (SMALL_CRAFT_STEM, F.lit(SMALL_CRAFT_TAG)),
        (TYPE_STEM, named(TYPE_STEM, TYPE_TAG)),
        (CLASS_STEM, named(CLASS_STEM, CLASS_TAG)),
    ]
    name, category = stem, F.lit("")
    for pattern, tag in reversed(rules):
        name = F.when(stem.rlike(pattern), F.regexp_extract(stem, pattern, 1)).otherwise(name)
        category = F.when(stem.rlike(pattern), tag).otherwise(category)
    return name, category


def valid_name(name: Column) -> Column:
    return name.rlike(NAME_PATTERN)


def valid_tag(tag: Column) -> Column:
    return tag.rlike(TAG_PATTERN) & ~tag.startswith("/") & ~tag.endswith("/") & ~tag.contains("//")


def valid_node_id(node: Column) -> Column:
    return node.rlike(NODE_PATTERN)


def valid_relative_path(path: Column) -> Column:
    """No root, no leading `.` step and no `..` step."""
    steps = F.split(path, "/", -1)
    return ~path.startswith("/") & (steps[0] != ".") & ~F.array_contains(steps, "..")


def content_key(content: Column, spec: list[Column]) -> Column:
    """Key of one piece of work: a hash of the content hash and what is done with it."""
    return F.sha2(F.concat_ws("\u0001", F.sha2(content, 256), *[s.cast("string") for s in spec]), 256)


def new_work(work: DataFrame, stored: DataFrame, key: str = "key") -> DataFrame:
    """Work whose key has no stored result yet."""
    return work.join(stored.select(key).distinct(), key, "left_anti")


def stored_and_fresh(work: DataFrame, stored: DataFrame, fresh: DataFrame, key: str = "key") -> DataFrame:
    """Results for all of `work`: kept ones where stored, else the fresh ones."""
    kept = stored.join(work.select(key).distinct(), key, "left_semi")
    return kept.unionByName(fresh)


def upsert_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """Index rows of `new` replace those of the same path; columns only in `old` stay."""
    return old.join(new.select("table_path").distinct(), "table_path", "left_anti").unionByName(
        new, allowMissingColumns=True
    )


def without_outputs(work: DataFrame, index: DataFrame, overwrite: bool) -> DataFrame:
    """Leave out tables already written, unless they are to be overwritten."""
    if overwrite:
        return work
    done = index.select(F.col("table_path").alias("out_path")).distinct()
    return work.join(done, "out_path", "left_anti")


def outcomes(work: DataFrame, done: DataFrame, errors: DataFrame, key: str = "table_id") -> DataFrame:
    """One row per piece of work: `(key, ok, error)`.

    Errors `(key, error)` never stop other work; work that is neither done nor
    in error is reported as missing.
    """
    return (
        work.select(key)
        .distinct()
        .join(done.select(key).distinct().withColumn("_done", F.lit(True)), key, "left")
        .join(errors.groupBy(key).agg(F.min("error").alias("_error")), key, "left")
        .select(
            key,
            (F.coalesce("_done", F.lit(False)) & F.col("_error").isNull()).alias("ok"),
            F.coalesce("_error", F.when(F.col("_done").isNull(), F.lit("no output"))).alias("error"),
        )
    )
