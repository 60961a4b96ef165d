"""Scalar expressions: numbers written for people, labels by threshold, parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(x: Column, default: float | None = 0.0) -> Column:
    """`86.42K`, `$10.5B`, `1,234`, `0.01%` as a double; what can't be read is default."""
    text = F.upper(F.regexp_replace(F.trim(x), r"[$,%\s]", ""))
    scale = F.when(text.endswith("K"), 1e3).when(text.endswith("M"), 1e6).when(text.endswith("B"), 1e9).otherwise(1.0)
    value = F.regexp_replace(text, "[KMB]$", "").try_cast("double") * scale
    return value if default is None else F.coalesce(value, F.lit(default))


def large_number(x: Column) -> Column:
    """`$1.50B`, `$2.00M`, `$3.25K` or `$12.00`; N/A for null."""
    size = F.abs(x)
    text = (
        F.when(size >= 1e9, F.format_string("$%.2fB", x / 1e9))
        .when(size >= 1e6, F.format_string("$%.2fM", x / 1e6))
        .when(size >= 1e3, F.format_string("$%.2fK", x / 1e3))
        .otherwise(F.format_string("$%.2f", x))
    )
    return F.when(x.isNull(), "N/A").otherwise(text)


def banded(x: Column, bands: list[tuple[float, str]], otherwise: str, strict: bool = False) -> Column:
    """The label of the first band (in the given order) that x reaches, or exceeds where strict."""
    out = None
    for bound, label in bands:
        hit = x > bound if strict else x >= bound
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def below(x: Column, bands: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first band that x is below."""
    out = None
    for bound, label in bands:
        out = F.when(x < bound, label) if out is None else out.when(x < bound, label)
    return out.otherwise(otherwise)


#: Thresholds of labels, by name: fixed values.
CONFIDENCE = [(0.8, "high"), (0.6, "moderate"), (0.4, "low")]
STRENGTH = [(0.85, "critical"), (0.70, "strong"), (0.55, "moderate")]
VOLATILITY = [(30, "low"), (60, "moderate"), (100, "high")]
FLOW = [(1e8, "low"), (5e8, "moderate"), (1e9, "high")]


def sentiment_label(x: Column) -> Column:
    """Five labels with strict bounds: exactly 0.2 is neutral, exactly -0.2 is bearish."""
    return banded(x, [(0.6, "very_bullish"), (0.2, "bullish"), (-0.2, "neutral"), (-0.6, "bearish")], "very_bearish", strict=True)


def parse_day(x: Column) -> Column:
    """A date from ISO text, with or without a time, or `DD-MM-YYYY`; else null."""
    return F.coalesce(F.try_to_timestamp(x), F.try_to_timestamp(x, F.lit("dd-MM-yyyy")), F.try_to_timestamp(x, F.lit("MM/dd/yyyy"))).cast("date")


def cache_key(params: Column) -> Column:
    """md5 of a map's JSON with its keys in order."""
    entries = F.map_from_entries(F.array_sort(F.map_entries(params)))
    return F.md5(F.to_json(entries).cast("binary"))


def any_keyword(lowered: Column, words: list[str]) -> Column:
    """Whether any of the words is part of a text that is in lower case already, so that it is lowered once."""
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(w)) for w in words])


def fenced_json(text: Column, schema: str) -> Column:
    """The JSON inside a ```json fence, or the bare JSON, as a struct; null where it can't be read."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    return F.from_json(bare, schema)


def encoded(data: Column) -> Column:
    """base64 of bytes or of a text's UTF-8, on one line."""
    return F.base64(data)


def parse_instant(text: Column) -> Column:
    """ISO with a T and Z, or a plain day; null for others."""
    iso = F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return F.coalesce(iso, F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("timestamp_ntz")


def pair_base(pair: Column, quote: str = "USDT") -> Column:
    """BTC of BTCUSDT."""
    return F.replace(pair, F.lit(quote), F.lit(""))


def price_text(x: Column) -> Column:
    """`$1,234.50`; null for null."""
    return F.when(x.isNotNull(), F.concat(F.lit("$"), F.format_number(x.cast("double"), 2)))


def percent_text(x: Column) -> Column:
    """`+1.25%`, with its sign."""
    return F.when(x.isNotNull(), F.format_string("%+.2f%%", x.cast("double")))


def said(x: Column) -> Column:
    """A label in lower case with spaces for underscores."""
    return F.lower(F.replace(x, F.lit("_"), F.lit(" ")))
