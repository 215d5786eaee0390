"""Numeral values of headings as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numeral characters and what they stand for.
CN_DIGITS = "零〇一壹二两贰三叁四肆五伍六陆七柒八捌九玖"
CN_DIGIT_VALUES = "001122233445566778899"
CN_UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
CN_BIG_UNITS = {"万": 10000, "萬": 10000}
CN_NUMBER_CLASS = "零〇一二两三四五六七八九十百千万壹贰叁肆伍陆柒捌玖拾佰仟萬"
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
ENGLISH = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5,
           "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
WIDE_DIGITS = "０１２３４５６７８９"


def _lookup(ch: Column, table: dict[str, int]) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(ch == key, F.lit(value).cast("bigint")) if out is None else out.when(ch == key, F.lit(value).cast("bigint"))
    return out


def decimal_value(col: Column) -> Column:
    return F.translate(col, WIDE_DIGITS, "0123456789").try_cast("bigint")


def _chinese_part(part: Column) -> Column:
    """What stands between two signs for ten thousand: the sum of digit times unit, and the digit at the end.

    A unit without a digit, or with a zero before it, counts once; of several digits in a row the last one counts.
    """
    digits, units = "[" + CN_DIGITS + "]", "[" + "".join(CN_UNITS) + "]"
    digit = lambda c: F.coalesce(F.translate(c, CN_DIGITS, CN_DIGIT_VALUES).try_cast("bigint"), F.lit(0).cast("bigint"))
    pair = lambda group: F.regexp_extract_all(part, F.lit(f"({digits}?)({units})"), F.lit(group))
    products = F.zip_with(pair(1), pair(2), lambda d, u: F.greatest(digit(d), F.lit(1).cast("bigint")) * _lookup(u, CN_UNITS))
    return F.aggregate(products, F.lit(0).cast("bigint"), lambda a, x: a + x) + digit(F.regexp_extract(part, f"({digits})$", 1))


def chinese_value(col: Column) -> Column:
    """A string of digits alone is positional. Otherwise the text splits at the signs for ten thousand: every part before one of
    them counts ten thousandfold, the last part once."""
    parts = F.split(col, "[" + "".join(CN_BIG_UNITS) + "]", -1)
    scale = F.lit(CN_BIG_UNITS["万"]).cast("bigint")
    values = F.transform(parts, lambda part, i: _chinese_part(part) * F.when(i < F.size(parts) - 1, scale).otherwise(F.lit(1).cast("bigint")))
    plain = F.translate(col, CN_DIGITS, CN_DIGIT_VALUES)
    return (F.when(~col.rlike(f"^[{CN_NUMBER_CLASS}]+$"), F.lit(None).cast("bigint"))
            .when(plain.rlike("^[0-9]+$"), plain.try_cast("bigint")).otherwise(F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)))


def roman_value(col: Column) -> Column:
    """The sum of the signs, those that stand before a larger one anywhere behind them taken negative."""
    signs = F.transform(F.split(F.upper(col), ""), lambda s: _lookup(s, ROMAN))
    behind = lambda i: F.array_max(F.slice(signs, i + 2, F.size(signs)))
    signed = F.transform(signs, lambda v, i: F.when(v < F.coalesce(behind(i), F.lit(0).cast("bigint")), -v).otherwise(v))
    return F.when(F.upper(col).rlike("^[IVXLCDM]+$"), F.aggregate(signed, F.lit(0).cast("bigint"), lambda a, x: a + x))


def english_value(col: Column) -> Column:
    word = F.lower(col)
    return F.coalesce(_lookup(word, ENGLISH), decimal_value(word), roman_value(word))
