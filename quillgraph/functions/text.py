"""Column expressions for whitespace, case folding and literal string counting.

Everything here stays in the JVM. Offsets are code points, half open, zero based.
"""
from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.isspace`` accepts, and the ones that end a line.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
LINE_PATTERN = rf"(?s)[^{LINE_BREAKS}]*+(?:\r\n|[{LINE_BREAKS}])|[^{LINE_BREAKS}]++"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it inside a lambda: a column that only a lambda reads
    is otherwise computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(col: Column) -> Column:
    """Runs of whitespace become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(col, SPACE + "+", " "))


def strip(col: Column) -> Column:
    return F.regexp_replace(col, rf"^{SPACE}+|{SPACE}+$", "")


def is_blank(col: Column) -> Column:
    return ~col.rlike(rf"[^{SPACE[1:]}")


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    single_from, single_to, longer = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        low, folded = ch.lower(), ch.casefold()
        if low == folded or len(low) != 1:
            continue
        if len(folded) == 1:
            single_from.append(low)
            single_to.append(folded)
        else:
            longer[low] = folded
    return "".join(single_from), "".join(single_to), longer


_ONE_FROM, _ONE_TO, _LONGER = _fold_tables()


def _ranges(chars: str, slack: int) -> str:
    """A regex class covering the characters with few ranges; it may cover some others as well."""
    out: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if out and code - out[-1][1] <= slack:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


_SPECIAL = _ranges("".join(c for c in _ONE_FROM + "".join(_LONGER) if c != "ß"), 64)


def fold(col: Column) -> Column:
    """Full Unicode case folding: lower case plus the letters whose folding differs from it.

    Almost every text needs no more than lower case and the sharp s; the rest takes a second path.
    """
    plain = F.replace(F.lower(col), F.lit("ß"), F.lit("ss"))
    table = F.array(*[F.struct(F.lit(c).alias("a"), F.lit(f).alias("b")) for c, f in _LONGER.items()])
    full = F.aggregate(table, F.translate(F.lower(col), _ONE_FROM, _ONE_TO),
                       lambda text, pair: F.replace(text, pair["a"], pair["b"]))
    return F.when(F.lower(col).rlike(_SPECIAL), full).otherwise(plain)


def occurrences(haystack: Column, needle: Column) -> Column:
    """Non-overlapping literal occurrences; an empty needle counts zero."""
    gone = F.length(haystack) - F.length(F.replace(haystack, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (gone / F.length(needle)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def cut(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` with zero-based offsets."""
    return F.substring(text, start.cast("int") + 1, (end - start).cast("int"))
