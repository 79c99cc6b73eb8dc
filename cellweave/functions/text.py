"""Text expressions: cleaning, full regex match, templates, numbers in text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# (?U): \s, \w and \d follow Unicode, so a no-break space is space too.
SPACES = r"(?U)\s+"

# How a modifier and an amount of credits look.
MODIFIER_PATTERN = r"\A(?s:(.+)) ([-+]\d+)\z"
CREDITS_PATTERN = r"\AM?Cr([-+]?\d+)\z"


def clean_text(text: Column) -> Column:
    """Strip, and turn every run of white space into one space."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def clean_cells(cells: Column) -> Column:
    return F.transform(cells, clean_text)


def join_cells(cells: Column) -> Column:
    """A row as one line, cells joined by a space."""
    return F.array_join(cells, " ")


def join_filled_cells(cells: Column) -> Column:
    """A row as one line, leaving empty cells out."""
    return F.array_join(F.filter(cells, lambda c: c != ""), " ")


def java_pattern(pattern: str) -> str:
    """A Python pattern for Spark: named groups become numbered ones."""
    numbers = re.compile(pattern).groupindex

    def piece(m: re.Match) -> str:
        if m[1]:
            return rf"\{numbers[m[1]]}"
        if m[0].startswith("("):
            return "("
        return r"\z" if m[0] == r"\Z" else m[0]

    # Escaped signs are taken whole, so that an escaped backslash or bracket begins nothing.
    return re.sub(r"(?s)\\.|\(\?P=(\w+)\)|\(\?P<\w+>", piece, pattern)


def full_match(pattern: str) -> str:
    """A Spark pattern that must cover the whole string; (?d): only \\n ends a line."""
    return rf"(?Ud)\A(?:{java_pattern(pattern)})\z"


def expand_template(template: str, pattern: str, text: Column) -> Column:
    r"""Fill `\1`, `\g<1>`, `\g<name>` in a template from a full match of `text`."""
    compiled, whole = re.compile(pattern), full_match(pattern)
    pieces: list[Column] = []
    at = 0
    for m in re.finditer(r"\\(?:([1-9]\d?)|g<(\w+)>|(.))", template):
        if m.start() > at:
            pieces.append(F.lit(template[at : m.start()]))
        at = m.end()
        ref = m[1] or m[2]
        if ref is None:
            pieces.append(F.lit({"n": "\n", "t": "\t", "r": "\r"}.get(m[3], m[3])))
            continue
        group = int(ref) if ref.isdigit() else compiled.groupindex[ref]
        if group > compiled.groups:
            raise ValueError(f"template {template!r} wants group {group} of {pattern!r}")
        pieces.append(text if group == 0 else F.regexp_extract(text, whole, group))
    if at < len(template):
        pieces.append(F.lit(template[at:]))
    if not pieces:
        return F.lit("")
    return pieces[0] if len(pieces) == 1 else F.concat(*pieces)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def parse_int(text: Column) -> Column:
    """Whole signed number, or null for a blank or malformed value."""
    return F.when(text.rlike(r"\A\s*[-+]?\d+\s*\z"), F.trim(text).try_cast("bigint"))


def parse_bool(text: Column) -> Column:
    """`true` / `false` in any case; anything else is null."""
    return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)


def parse_set(text: Column) -> Column:
    """Comma separated values as an array of distinct clean texts."""
    return F.array_distinct(F.transform(F.split(text, ",", -1), clean_text))


def parse_credits(text: Column) -> Column:
    """`Cr1234` or `MCr30` as a number of credits; null where malformed."""
    number = F.regexp_extract(text, CREDITS_PATTERN, 1).try_cast("bigint")
    return F.when(text.startswith("MCr"), number * 1_000_000).otherwise(number)


def parse_modifiers(text: Column) -> Column:
    """`Name +1, Other -2` as a map; the last of equal names wins.

    Null where any item is malformed.
    """
    item = MODIFIER_PATTERN
    parts = F.split(text, ",", -1)
    entry = lambda s: F.struct(
        F.trim(F.regexp_extract(s, item, 1)).alias("name"), F.regexp_extract(s, item, 2).try_cast("int").alias("dm")
    )
    entries = F.transform(parts, entry)
    last_of_name = F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + F.lit(2), F.greatest(F.size(entries) - i - F.lit(1), F.lit(0))),
            lambda later: later["name"] == e["name"],
        ),
    )
    return F.when(F.forall(parts, lambda s: s.rlike(item)), F.map_from_entries(last_of_name))


def strip_brackets(text: Column, opening: str, closing: str) -> Column:
    inner = F.when(text.startswith(opening), F.substring(text, 2, 1 << 30)).otherwise(text)
    inner = F.when(inner.endswith(closing), F.left(inner, F.length(inner) - 1)).otherwise(inner)
    return clean_edges(inner)


def clean_edges(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def split_words(text: Column) -> Column:
    """Split on white space; blank text has no words."""
    return F.filter(F.split(text, SPACES, -1), lambda w: w != "")


def csv_field(text: Column) -> Column:
    """Quote a value for CSV where it holds a comma, a quote or a line break."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\r\n]'), quoted).otherwise(text)


def csv_line(cells: Column) -> Column:
    """Cells as one CSV record without the line end.

    A row of one empty cell is written as `""`, to tell it from an empty row.
    """
    line = F.array_join(F.transform(cells, csv_field), ",")
    return F.when((F.size(cells) == 1) & (cells[0] == ""), F.lit('""')).otherwise(line)


# A cell in quotes up to the closing one; quotes in it are doubled, and what follows the closing one is text as it stands.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'


def csv_leaves_open(line: Column, separator: str = ",") -> Column:
    """Whether a line that begins a record ends within a quoted cell.

    A quote counts only at the start of a cell; within an unquoted cell, or
    after the closing quote, it is text. Put a quote in front of a line to ask
    the same of one that begins within a quoted cell.
    """
    sep = re.escape(separator)
    closed = rf'(?:{_QUOTED}"[^{sep}]*+|[^"{sep}][^{sep}]*+|){sep}'
    return line.contains('"') & line.rlike(rf"(?s)\A(?:{closed})*+{_QUOTED}\z")


def csv_cells(record: Column, separator: str = ",") -> Column:
    """Split one whole CSV record into cells; an empty record has none. A quoted cell without its closing quote reaches to the end."""
    sep = re.escape(separator)
    # A separator in front of every field, so that no match is empty.
    fields = F.regexp_extract_all(
        F.concat(F.lit(separator), record), F.lit(rf'(?s){sep}({_QUOTED}(?:"[^{sep}]*+|\z)|[^{sep}]*+)'), F.lit(1)
    )
    unquote = lambda f: F.when(
        f.startswith('"'),
        F.concat(
            F.replace(F.regexp_extract(f, rf"(?s)\A{_QUOTED}", 0).substr(F.lit(2), F.length(f)), F.lit('""'), F.lit('"')),
            F.regexp_extract(f, rf'(?s)\A{_QUOTED}"(.*)\z', 1),
        ),
    ).otherwise(f)
    return F.when(record == "", F.array().cast("array<string>")).otherwise(F.transform(fields, unquote))


def split_list(text: Column, separator: str = ";") -> Column:
    """A joined list as an array; blank text is an empty list."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separator, -1), lambda v: v != "")
