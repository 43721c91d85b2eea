"""Line, attribute and character expressions over rendered pages and plain text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ranges that count as Chinese for the two predicates.
ALL_CHINESE, ANY_CHINESE = "^[\\u4e00-\\u9fa5]*$", "[\\u4e00-\\u9fff]"
#: The characters that upper() makes several of, and the one that stands for each where every character stays one.
_LONGER = {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it; generated code stays small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(c: Column, unicode: bool = False) -> Column:
    """Without white space at either end; unicode also counts no-break and other wide spaces."""
    return F.regexp_replace(c, ("(?U)" if unicode else "") + r"^\s+|\s+$", "")


def lines(html: Column) -> Column:
    """Lines of the stripped page."""
    return F.split(stripped(html), "\n")


def kept_lines(text: Column) -> Column:
    """Lines with their newline, as a file is read; the last may have none."""
    return F.regexp_extract_all(text, F.lit("([^\\n]*\\n|[^\\n]+)"), 1)


def simple_upper(text: Column) -> Column:
    """Upper case, one character for each, as in DuckDB: upper() alone makes SS of ß. Only texts that it makes longer are taken apart."""
    special = "ßŉǰΐΰև\u1e96-\u1e9a\u1f50-\u1ffc\ufb00-\ufb17"  # all of _LONGER, and some others
    names = F.create_map(*[F.lit(x) for kv in _LONGER.items() for x in kv])
    runs = F.regexp_extract_all(text, F.lit(f"([{special}]|[^{special}]+)"), 1)
    mixed = F.array_join(F.transform(runs, lambda x: F.coalesce(F.element_at(names, x), F.upper(x))), "")
    return let(F.upper(text), lambda upper: F.when(F.length(upper) > F.length(text), mixed).otherwise(upper))


def words(text: Column) -> Column:
    """Non-empty runs without white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def found(line: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, null where nothing matches."""
    return F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))


def inner_text(line: Column) -> Column:
    """The stripped text between a tag's end and the next tag; null without any, '' if blank."""
    return F.when(line.rlike(r">\s*[^<>]+\s*<"), stripped(F.regexp_extract(line, r">\s*([^<>]+)\s*<", 1)))


def attribute(line: Column, name: str) -> Column:
    """An attribute's value; null where it is missing or empty."""
    return found(line, f'(?:^|\\s){name}="([^"]+)"')


def all_chinese(c: Column) -> Column:
    """True for the empty string too."""
    return c.rlike(ALL_CHINESE)


def any_chinese(c: Column) -> Column:
    return c.rlike(ANY_CHINESE)


def translated(value: Column, names: dict[str, str]) -> Column:
    """The name that stands for a value; the value itself where there is none."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.element_at(pairs, value), value)


def first_column_without_mark(names: list[str]) -> list[str]:
    """Column names without the byte-order mark that some CSV files begin with."""
    return [n.removeprefix("﻿") if i == 0 else n for i, n in enumerate(names)]
