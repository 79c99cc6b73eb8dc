"""Packed codes, integer ranges and locations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base-34 digits (no I, no O), starport letters, the numbers of a
# world profile in order, and how ranges look.
DIGITS = "0123456789ABCDEFGHJKLMNPQRSTUVWXYZ"
STARPORTS = "ABCDEX"
PROFILE_NUMBERS = ["size", "atmosphere", "hydrographic", "population", "government", "law_level", "tech_level"]

RANGE_FROM, RANGE_UPTO = r"\A(\d+)[+]\z", r"\A(\d+)[-–]\z"
RANGE_BOTH, RANGE_ONE = r"\A(\d+)[-–](\d+)\z", r"\A([-+]?\d+)\z"


def parse_digit(char: Column) -> Column:
    """Value of one base-34 digit; null for anything else."""
    at = F.position(char, F.lit(DIGITS))
    return F.when((F.length(char) == 1) & (at > 0), at - 1)


def format_digit(value: Column) -> Column:
    return F.when(value.between(0, len(DIGITS) - 1), F.substring(F.lit(DIGITS), value + 1, F.lit(1)))


def parse_profile(text: Column) -> Column:
    """`A123456-7` as a struct of starport and seven numbers; null where malformed."""
    packed = F.replace(text, F.lit("-"), F.lit(""))
    fields = [F.substring(packed, 1, 1).alias("starport")]
    fields += [parse_digit(F.substring(packed, i + 2, 1)).alias(n) for i, n in enumerate(PROFILE_NUMBERS)]
    return F.when(packed.rlike(rf"\A[{STARPORTS}][{DIGITS}]{{7}}\z"), F.struct(*fields))


def format_profile(profile: Column) -> Column:
    return F.concat(profile["starport"], *[format_digit(profile[n]) for n in PROFILE_NUMBERS])


def parse_location(text: Column) -> Column:
    """`XXYY` as a struct of x and y; null where malformed."""
    part = lambda at: F.substring(text, at, 2).try_cast("int")
    return F.when(text.rlike(r"\A\d{4}\z"), F.struct(part(1).alias("x"), part(3).alias("y")))


def format_location(location: Column) -> Column:
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    return F.concat(two(location["x"]), two(location["y"]))


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group).try_cast("int"))


def parse_range(text: Column) -> Column:
    """Inclusive range as a struct of lo and hi, null for an open end.

    `` any, `a+` from a, `a-` up to a, `a-b`, `a`; an en dash works as a hyphen.
    Null where malformed.
    """
    lo = F.coalesce(_number(text, RANGE_FROM), _number(text, RANGE_BOTH), _number(text, RANGE_ONE))
    hi = F.coalesce(_number(text, RANGE_UPTO), _number(text, RANGE_BOTH, 2), _number(text, RANGE_ONE))
    known = (text == "") | lo.isNotNull() | hi.isNotNull()
    return F.when(known, F.struct(lo.alias("lo"), hi.alias("hi")))


def parse_range_set(text: Column) -> Column:
    """Comma separated ranges; null where any is malformed. Blank text is one open range."""
    ranges = F.transform(F.split(text, ",", -1), lambda r: parse_range(F.regexp_replace(r, r"(?U)\A\s+|\s+\z", "")))
    return F.when(F.forall(ranges, lambda r: r.isNotNull()), ranges)


def in_ranges(value: Column, ranges: Column) -> Column:
    return F.exists(
        ranges, lambda r: (r["lo"].isNull() | (value >= r["lo"])) & (r["hi"].isNull() | (value <= r["hi"]))
    )


def format_range(r: Column) -> Column:
    lo, hi = r["lo"].cast("string"), r["hi"].cast("string")
    return (
        F.when(lo.isNull() & hi.isNull(), "")
        .when(hi.isNull(), F.concat(lo, F.lit("+")))
        .when(lo.isNull(), F.concat(hi, F.lit("-")))
        .when(lo == hi, lo)
        .otherwise(F.concat(lo, F.lit("-"), hi))
    )


def format_range_set(ranges: Column) -> Column:
    return F.array_join(F.transform(ranges, format_range), ", ")
