"""Column helpers: clipping, rounding, weekday arithmetic and guarded windows."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F


def clip(col: Column, low: float, high: float) -> Column:
    """Bound *col*, keeping nulls (greatest/least alone would skip them)."""
    return F.when(col < low, F.lit(float(low))).when(col > high, F.lit(float(high))).otherwise(col)


def clip_score(col: Column) -> Column:
    return clip(col, 0.0, 100.0)


def rounded(col: Column, digits: int) -> Column:
    """Round with ties going up after clearing float noise, so equal sums round equally."""
    return F.round(col + F.lit(1e-9), digits)


def exceeds(value: Column, mean: Column) -> Column:
    """value > mean by more than the float noise of a mean taken from running sums; distinct prices lie much further apart."""
    return value - mean > F.abs(value) * 1e-11


def positive(col: Column) -> Column:
    """max(0, col), null read as 0."""
    return F.greatest(F.coalesce(col, F.lit(0.0)), F.lit(0.0))


def pct_change(now: Column, then: Column) -> Column:
    return (now / F.nullif(then, F.lit(0.0)) - 1.0) * 100.0


def bound(value: Column, use) -> Column:
    """use(value) with *value* computed once a row. A function over array elements computes what it reads from outside anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def as_flag(condition: Column) -> Column:
    """Boolean that is never null: an unknown comparison is false."""
    return F.coalesce(condition, F.lit(False))


def as_int(condition: Column) -> Column:
    return F.coalesce(condition.cast("long"), F.lit(0))


def number(col: Column) -> Column:
    """Permissive string-to-number coercion; unusable text becomes null."""
    return F.regexp_replace(F.trim(col), ",", "").try_cast("double")


def business_ordinal(date: Column) -> Column:
    """Weekday count since Monday 1970-01-05; both weekend days share the following Monday's number,
    so ``ordinal(x) <= ordinal(d) - n`` is exactly ``x <= d - n business days``."""
    days = F.datediff(date, F.lit("1970-01-05").cast("date"))
    return (F.lit(5) * F.floor(days / 7) + F.least(F.pmod(days, F.lit(7)), F.lit(5))).cast("long")


def by_ticker():
    """Time order of one instrument. Bars are unique per (ticker, date), so a group is bounded by the calendar."""
    return Window.partitionBy("ticker").orderBy("date")


def frame(first: int, last: int):
    return by_ticker().rowsBetween(first, last)


def rolling(fn, col: str, n: int, shift: int = 0, min_periods: int | None = None) -> Column:
    """fn over the n bars ending *shift* bars ago; null until enough values exist."""
    window = frame(-(n - 1) - shift, -shift)
    return F.when(F.count(col).over(window) >= (min_periods or n), fn(col).over(window))


def lagged(col: str, n: int = 1) -> Column:
    return F.lag(col, n).over(by_ticker())
