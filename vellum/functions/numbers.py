"""Packed numbers, exact number texts and number formats."""

from __future__ import annotations

import datetime as dt
import functools
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Formats from this number on are a workbook's own.
OWN_FORMATS = 164


def shortest_text(x: float | None) -> str | None:
    """Least digits that read back as the same double, never an exponent."""
    if x is None:
        return None
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    text = repr(float(x))
    if "e" in text:
        mantissa, exponent = text.split("e")
        sign, mantissa = ("-", mantissa[1:]) if mantissa[0] == "-" else ("", mantissa)
        head, _, tail = mantissa.partition(".")
        digits, point = head + tail, len(head) + int(exponent)
        if point <= 0:
            return f"{sign}0.{'0' * -point}{digits}"
        return sign + digits.ljust(point, "0")[:point] + (f".{digits[point:]}" if digits[point:] else "")
    return text.removesuffix(".0")


_TOKENS = re.compile("YYYY|yyyy|YY|yy|MMMM|MMM|MM|M|mm|m|DD|dd|D|d|HH|hh|H|h|ss|SS|s|S|.", re.S)


def date_text(pattern: str, stamp: dt.datetime) -> str:
    """A timestamp by a pattern like ``MM/DD/YYYY hh:mm:ss``. Capital M is the
    month and small m the minute; other letters stand for themselves."""
    values = {
        "yyyy": f"{stamp.year:04d}", "yy": f"{stamp.year % 100:02d}", "MMMM": stamp.strftime("%B"), "MMM": stamp.strftime("%b"), "MM": f"{stamp.month:02d}", "M": str(stamp.month),
        "dd": f"{stamp.day:02d}", "d": str(stamp.day), "hh": f"{stamp.hour:02d}", "h": str(stamp.hour), "mm": f"{stamp.minute:02d}", "m": str(stamp.minute), "ss": f"{stamp.second:02d}", "s": str(stamp.second),
    }
    key = lambda t: t if t[0] in "Mm" else t.lower()
    return "".join(values.get(key(t), t) for t in _TOKENS.findall(pattern))


@functools.lru_cache(4096)
def renderer(pattern: str | None, ifmt: int | None, date1904: bool = False) -> Callable[[float], str]:
    """How a format shows a number: by the first of these that the pattern
    has, General or @, a percent sign, # or .00, 0; else as a date."""
    if ifmt is None or pattern is None or ifmt < OWN_FORMATS or pattern in ("General", "@"):
        return shortest_text
    if "%" in pattern:
        return lambda v: f"{v * 100:.2f}%"
    if "#" in pattern or ".00" in pattern:
        return lambda v: f"{v:.2f}"
    if "0" in pattern:
        return lambda v: f"{v:.0f}"
    shown = pattern.replace("HH:MM:SS", "hh:mm:ss").replace("\\", "")
    epoch = dt.datetime(1904, 1, 1) if date1904 else dt.datetime(1899, 12, 30)

    def date(v: float) -> str:
        if not -600_000 < v < 2_900_000:
            return shortest_text(v)
        try:
            return date_text(shown, epoch + dt.timedelta(days=math.floor(v), microseconds=round((v - math.floor(v)) * 86_400_000_000)))
        except OverflowError:
            return shortest_text(v)

    return date


def rendered(value: float | None, pattern: str | None, ifmt: int | None, date1904: bool = False) -> str | None:
    return None if value is None else renderer(pattern, ifmt, date1904)(value)


@F.pandas_udf(StringType())
def number_text(values: pd.Series) -> pd.Series:
    """The shortest decimal text of each double."""
    return pd.Series([None if pd.isna(x) else shortest_text(float(x)) for x in values], dtype=object)


@F.pandas_udf(StringType())
def _render(values: pd.Series, patterns: pd.Series, ifmts: pd.Series) -> pd.Series:
    keys = zip(patterns, ifmts)
    return pd.Series([None if v != v or v is None else renderer(p, None if i != i or i is None else int(i))(v) for v, (p, i) in zip(values, keys)], dtype=object)


def render(value: Column, pattern: Column, ifmt: Column) -> Column:
    """Numbers as their formats show them; see ``rendered``. Those of a fixed
    number of places stay in Spark's expressions; general formats, dates, and
    numbers too large for exact places go to Python, the others as nulls."""
    own = F.coalesce((ifmt >= OWN_FORMATS) & ~pattern.isin("General", "@"), F.lit(False)) & (F.abs(value) < 1e10)
    shown = lambda v, form: F.call_function("format_number", v, F.lit(form))
    fixed = (
        F.when(own & pattern.contains("%"), F.concat(shown(value * 100, "0.00"), F.lit("%")))
        .when(own & (pattern.contains("#") | pattern.contains(".00")), shown(value, "0.00"))
        .when(own & pattern.contains("0"), shown(value, "0"))
    )
    return F.coalesce(fixed, _render(F.when(fixed.isNull(), value), pattern, ifmt))


def decode_rk(raw: Column) -> Column:
    """A packed number: bit 1 tells an integer, bit 0 one of hundredths. The
    integer is signed. The other kind, the high bits of a double, is put
    together from sign, exponent and fraction."""
    raw = raw.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    signed = F.when(raw >= 1 << 31, raw - (1 << 32)).otherwise(raw)
    whole = F.shiftright(signed, 2).cast("double")
    sign = F.when(raw >= 1 << 31, -1.0).otherwise(1.0)
    exponent = F.shiftright(raw, 20).bitwiseAND(F.lit(0x7FF))
    fraction = raw.bitwiseAND(F.lit(0xFFFFC)).cast("double") / float(1 << 20)
    floating = F.when(exponent == 0, sign * fraction * F.pow(F.lit(2.0), F.lit(-1022))).otherwise(sign * (1 + fraction) * F.pow(F.lit(2.0), exponent - 1023))
    value = F.when(raw.bitwiseAND(F.lit(2)) != 0, whole).otherwise(floating)
    return F.when(raw.bitwiseAND(F.lit(1)) != 0, value / 100).otherwise(value)

