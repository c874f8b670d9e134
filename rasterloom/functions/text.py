"""Bytes and texts of logs and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_line(data: Column, fallback: str = "ISO-8859-1") -> Column:
    """UTF-8 where it is valid, else the fallback encoding."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(F.decode(data, fallback))


def twelve_digits(value: Column) -> Column:
    """At most twelve significant digits, without trailing zeros: plain from 1e-4 up to 1e12, else with an exponent."""
    size = F.abs(value)
    places = F.greatest(F.lit(0), F.lit(11) - F.floor(F.log10(size)).cast("int"))
    plain = F.regexp_replace(F.round(value.cast("decimal(38,16)"), 12).cast("string"), r"\.?0+$", "")
    return F.when(value == 0, "0").when((size >= 1e-4) & (size < 1e12) & (places <= 12), plain).otherwise(F.format_string("%.11e", value))


def error_text(message: Column, cause: Column) -> Column:
    """Message and root cause, the cause only if it says more."""
    return F.concat_ws(": ", message, F.when(~F.coalesce(F.contains(message, cause), F.lit(True)), cause))


def tail_lines(text: Column, n: int) -> Column:
    parts = F.split(text, "\n")
    return F.slice(parts, F.greatest(F.lit(1), F.size(parts) - n + 1), F.lit(n))


def causes(error: BaseException) -> list[str]:
    """The chain of an exception, outermost first; a cycle ends it."""
    seen: set[int] = set()
    out: list[str] = []
    while error is not None and id(error) not in seen:
        seen.add(id(error))
        out.append(f"{type(error).__name__}: {error}")
        error = error.__cause__ or error.__context__
    return out
