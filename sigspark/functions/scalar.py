"""Scalar column expressions. All are built-in functions, so they stay inside generated code."""

from __future__ import annotations

import html
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CLOSE_SECONDS = 16 * 3600

# The text patterns of cashtags, mentions and links.
CASHTAG = r"\$([A-Za-z]{1,6}(?:\.[A-Za-z]{1,2})?)\b"
MENTION = r"(?<!\w)@(\w{1,20})"
LINK = r"https?://\S+"

# The session groups of a business day by the half-hour they begin at (HHMM), in order.
SESSIONS = (
    ("midnight_to_morning", 0),
    ("pre_market", 900),
    ("market_open", 930),
    ("late_morning", 1000),
    ("midday", 1200),
    ("early_afternoon", 1300),
    ("market_close", 1530),
    ("post_market", 1600),
)
AFTER_HOURS = ("midnight_to_morning", "pre_market", "post_market")
MARKET_HOURS = ("market_open", "late_morning", "midday", "early_afternoon", "market_close")


def finite(c: Column) -> Column:
    """NaN and infinities become null, as ranks order null and NaN at opposite ends."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """a / b; ``empty`` where b is zero or null (null by default, some features ask for 0)."""
    return F.when(b != 0, a / b).otherwise(F.lit(empty).cast("double"))


def logarithm(c: Column, of: Callable[[Column], Column] = F.log, zero: float = 0.0) -> Column:
    """``of`` (F.log, F.log10, or F.log1p with ``zero`` = -1) of c, minus infinity where its argument is zero, as in SQL; Spark has null there."""
    return F.when(c == zero, F.lit(float("-inf"))).otherwise(of(c))


def eastern(ts: Column) -> Column:
    """UTC wall time to New York wall time, without a zone; the session's time zone plays no part."""
    return F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), ts.cast("timestamp_ntz"))


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts)


def half_hour(ts: Column) -> Column:
    """HHMM with the minutes floored to 0 or 30."""
    return F.hour(ts) * 100 + F.when(F.minute(ts) < 30, 0).otherwise(30)


def after_close(ts: Column) -> Column:
    """Strictly after 16:00:00, fractions of a second included; 16:00:00 itself is not."""
    return seconds_of_day(ts) > CLOSE_SECONDS


def session_group(session: Column, business: Column, weekend: Column, holiday: Column) -> Column:
    """Weekend and holiday come first, then the business day's session; 'unknown' if none fits."""
    out = F.when(weekend, "weekend").when(holiday, "holiday")
    ends = [start for _, start in SESSIONS[1:]] + [2400]
    for (name, start), end in zip(SESSIONS, ends, strict=True):
        out = out.when(business & (session >= start) & (session < end), name)
    return out.otherwise("unknown")


def cut(c: Column, edges: Sequence[float]) -> Column:
    """Number of the right-closed bin (edges[i], edges[i+1]] that holds c; null outside."""
    out = None
    for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        inside = (c > low) & (c <= high)
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def parse_symbols(c: Column) -> Column:
    """A list literal such as ['A', 'B'] as an array; empty for anything else."""
    return F.coalesce(F.from_json(F.replace(c, F.lit("'"), F.lit('"')), "array<string>"), F.array().cast("array<string>"))


def symbols_by_pattern(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("'([^']*)'"), 1)


def cashtags(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(CASHTAG), 1)


def mentions(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(MENTION), 1)


def links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(LINK), 0)


def squeeze(c: Column) -> Column:
    """White-space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def without_boilerplate(c: Column) -> Column:
    """Links go first, then cashtags, then mentions."""
    for pattern in (LINK, CASHTAG, MENTION):
        c = F.regexp_replace(c, pattern, " ")
    return squeeze(c)


def unescape(c: Column) -> Column:
    """HTML entities to text. The full entity table is Python's; there is no built-in for it."""

    def texts(batch: pd.Series) -> pd.Series:
        return batch.map(html.unescape, na_action="ignore")

    return F.pandas_udf(texts, "string")(c)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def agreement(mean: Column, n: Column) -> tuple[Column, Column]:
    """Norm of a mean of unit vectors, and the mean pairwise cosine it implies (1 for a single one)."""
    square = F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(mean, mean)))
    cosine = F.when(n == 1, F.lit(1.0)).otherwise((n * square - 1) / (n - 1))
    return F.sqrt(square), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))


def row_stddev(columns: Sequence[Column]) -> Column:
    """Sample deviation across columns of one row."""
    values, n = F.array(*(c.cast("double") for c in columns)), len(columns)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    return F.sqrt(F.aggregate(F.transform(values, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x) / (n - 1))


def r6(c: Column) -> Column:
    """Rounded for comparison across engines: moved off exact halves first, and a negative zero becomes zero."""
    return F.round(c.cast("double") + F.lit(1e-10), 6) + F.lit(0.0)
