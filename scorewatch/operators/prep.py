"""Data preparation: training table, time slices, unions, clean feature rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewatch.functions.columns import Measure, ts_lit


def between_times(df: DataFrame, col: str, start: str, end: str) -> DataFrame:
    """Inclusive time range from text bounds (F1); pushed into the scan."""
    return df.filter(F.col(col).between(ts_lit(start), ts_lit(end)))


def training_set(readings: DataFrame, labels: DataFrame, start: str, end: str) -> DataFrame:
    """Readings joined to labels, both clocks inside [start, end].

    Bounding the label clock too keeps only readings already inspected by
    ``end``: the label-availability rule of the training window.
    """
    r = between_times(readings, "process_time", start, end)
    q = between_times(labels, "qualitycheck_time", start, end)
    return r.join(q, "pid")


def time_slice(df: DataFrame, col: str, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Half-open slice ``lo <= col < hi``; a missing bound is open (F2, T5)."""
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (F.col(col) >= ts_lit(lo))
    if hi is not None:
        cond = cond & (F.col(col) < ts_lit(hi))
    return df.filter(cond)


def slice_index(col: str, cuts: Sequence[str]) -> F.Column:
    """0-based index of the half-open slice holding ``col`` for sorted cut points."""
    idx = F.lit(0)
    for c in cuts:
        idx = idx + F.when(F.col(col) >= ts_lit(c), 1).otherwise(0)
    return idx


def combine(*frames: DataFrame) -> DataFrame:
    """Union by column name, whatever the column order."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def valid_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows whose features are all present and not NaN (F6, dropna form)."""
    return df.dropna(subset=list(features))


def measured(readings: DataFrame, how: Mapping[str, Measure], noise: F.Column | None = None,
             seed: int | None = None) -> DataFrame:
    """Readings as a sensor gives them (P2): every feature named in ``how`` is scaled, shifted
    and shaken. ``noise`` is a term in -1 .. 1 (the same for a rerun); without it a standard
    normal draw with ``seed`` is used, a fresh one per feature."""
    out = {}
    for i, (c, m) in enumerate(how.items()):
        term = noise if noise is not None else F.randn(None if seed is None else seed + i)
        out[c] = m.of(F.col(c), term)
    return readings.withColumns(out)
