"""Scalar column expressions (projections, predicates, time functions).

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_lit(text: str) -> Column:
    """A timestamp literal without zone (``'2024-01-16'`` or with time)."""
    return F.lit(text).cast("timestamp_ntz")


def epoch_to_ts(seconds: ColumnOrName) -> Column:
    """Epoch seconds (double, microseconds kept) to a zone-less timestamp.

    Built as epoch + interval, so the session time zone plays no part (an
    instant cast to ``timestamp_ntz`` would take the session zone's wall clock).
    """
    secs = col(seconds).cast("decimal(18,6)")
    return ts_lit("1970-01-01 00:00:00") + F.make_dt_interval(secs=secs)


def typed_lit(value, dtype) -> Column:
    """Literal of a collected value with the column's type. Zone-less timestamps
    go through text, so neither the Python nor the session zone shifts them."""
    import datetime as _dt

    from pyspark.sql.types import TimestampNTZType
    if isinstance(dtype, TimestampNTZType) and isinstance(value, _dt.datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value).cast(dtype)


def inspection_due(ts: ColumnOrName, days: int = 2) -> Column:
    """Midnight ``days`` days after ``ts``: when the inspection label lands."""
    return F.date_add(F.to_date(col(ts)), days).cast("timestamp_ntz")


def window_day(ts: ColumnOrName) -> Column:
    """Start date of the one-day tumbling window holding ``ts``."""
    return F.to_date(F.window(col(ts), "1 day").start)


def in_range(c: ColumnOrName, lo, hi) -> Column:
    return col(c).between(lo, hi)


def all_of(preds: Iterable[Column]) -> Column:
    out = None
    for p in preds:
        out = p if out is None else (out & p)
    return F.lit(True) if out is None else out


def ranges_hold(bounds: dict[str, tuple]) -> Column:
    """Conjunction of inclusive ``between`` tests, one per column."""
    return all_of(in_range(c, lo, hi) for c, (lo, hi) in bounds.items())


def first_match(branches: Sequence[tuple[Column, object]], otherwise) -> Column:
    """Chained ``when``: value of the first branch whose condition holds."""
    out = None
    for cond, value in branches:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def label_as_int(pred: ColumnOrName) -> Column:
    """Predicted label text as int; null where it is not a number (no ANSI error)."""
    return col(pred).try_cast("int")


def correct_flag(pred: ColumnOrName, actual: ColumnOrName) -> Column:
    """1 where the prediction equals the label, as numbers or as text, else 0
    (nulls count as wrong)."""
    same = (label_as_int(pred) == label_as_int(col(actual).cast("string"))) \
        | (col(pred).cast("string") == col(actual).cast("string"))
    return F.when(same, 1).otherwise(0)


def pct(part: ColumnOrName, whole: ColumnOrName) -> Column:
    return col(part) * 100 / col(whole)


def window_key(start: str, end: str) -> Column:
    """Run key of a data window: ``'<start> - <end>'``."""
    return F.concat_ws(" - ", F.lit(start), F.lit(end))


def offset_key(c: ColumnOrName, offset: int) -> Column:
    return col(c) + F.lit(offset)


def hash_bucket(key: ColumnOrName, buckets: int) -> Column:
    """Deterministic bucket of ``key``: first 32 bits of md5(key) mod ``buckets``.

    Unlike ``randomSplit``/``sample`` it does not depend on partitioning, and
    DuckDB computes the same number.
    """
    h = F.conv(F.substring(F.md5(col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    return h % buckets


@dataclass(frozen=True)
class Measure:
    """How a feature is measured: scaled, shifted, and ``noise`` times a term in -1 .. 1 added."""

    scale: float = 1.0
    shift: float = 0.0
    noise: float = 0.0

    def of(self, value: Column, term: Column) -> Column:
        out = value if self.scale == 1.0 else value * F.lit(self.scale)
        out = out if self.shift == 0.0 else out + F.lit(self.shift)
        return out if self.noise == 0.0 else out + (term if self.noise == 1.0 else term * F.lit(self.noise))
