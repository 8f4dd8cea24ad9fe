"""Stand-in readings, labels and rule models derived from the ``events`` table.

``events`` has a unique ``event_id``, 30 days of ``ts`` and numeric columns, so
it maps onto the readings table column for column. Labels follow a rule that
changes in two regimes (concept drift); two rule "models" stand in for fitted
ones wherever an exact, SQL-checkable prediction is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.functions.columns import (Measure, first_match, inspection_due, ranges_hold,
                                          ts_lit)

# --- fixed values of the stand-in data set -----------------------------------
# Rule rule(t, p, d): temp BETWEEN t AND 120, pressure BETWEEN 0 AND p,
# duration BETWEEN d AND 97.
TEMP_HI = 120
DURATION_HI = 97
REGIME_CUTS = ("2024-01-14", "2024-01-24")
REGIME_RULES = ((5, 134, 2), (30, 134, 2), (30, 74, 2))
# Rule models: m1 is the first regime's rule, m2 the second's.
RULE_MODELS = {"m1": (5, 134, 2), "m2": (30, 134, 2)}
# Quality grades: 0 below the first bound of temp, 1 below the second, else 2.
GRADE_BOUNDS = (20, 60)
# Deterministic measurement noise: temp + ((pid * 7919) % 1001) / 500 - 1.
NOISE_MULT, NOISE_MOD, NOISE_DIV = 7919, 1001, 500.0
# Props text: a flat one-key object such as {"k": 12}.
FLAT_PROPS = r'^\{"k": (-?[0-9]+)\}$'
# Training window, switch day and arrival cuts of the demo loop.
TRAIN_WINDOW = ("2024-01-01 00:00:00", "2024-01-10 23:59:00")
SWITCH_DAY = "2024-01-16"
ARRIVAL_CUTS = ("2024-01-16", "2024-01-21", "2024-01-26")
# -----------------------------------------------------------------------------


_EVENTS: dict[tuple[int, str], DataFrame] = {}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table; the lazy frame is reused per session and folder so its
    footer is read once."""
    key = (id(spark), sf_dir)
    df = _EVENTS.get(key)
    if df is None or df.sparkSession is not spark:
        df = _EVENTS[key] = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df


def props_k(props: str = "props") -> F.Column:
    """``$.k`` of the props JSON. The flat one-key shape is read by an anchored
    regular expression (about 4x faster than a JSON parser); any other text
    goes through ``get_json_object``, so the value is the JSON one either way."""
    flat = F.regexp_extract(props, FLAT_PROPS, 1)
    return F.when(flat != "", flat).otherwise(F.get_json_object(props, "$.k"))


def readings_from_events(ev: DataFrame) -> DataFrame:
    return ev.select(
        F.col("event_id").alias("pid"),
        F.col("ts").alias("process_time"),
        F.col("value").alias("temp"),
        F.col("user_id").cast("double").alias("pressure"),
        props_k().cast("double").alias("duration"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_from_events(events(spark, sf_dir))


def rule(t: float, p: float, d: float, temp="temp", pressure="pressure",
         duration="duration"):
    return ranges_hold({temp: (t, TEMP_HI), pressure: (0, p), duration: (d, DURATION_HI)})


def rule_label(readings_df: DataFrame) -> DataFrame:
    """Inspection labels: regime-dependent rule on the true readings."""
    t = F.col("process_time")
    c1, c2 = ts_lit(REGIME_CUTS[0]), ts_lit(REGIME_CUTS[1])
    regimes = (t < c1, (t >= c1) & (t < c2), t >= c2)
    quality = first_match([(reg & rule(*r), 1) for reg, r in zip(regimes, REGIME_RULES)], 0)
    return readings_df.select(
        "pid",
        inspection_due("process_time").alias("qualitycheck_time"),
        quality.cast("int").alias("quality"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_label(readings(spark, sf_dir))


def perturb(readings_df: DataFrame) -> DataFrame:
    """Readings as measured: temp shifted by a deterministic noise term."""
    from scorewatch.operators.prep import measured
    return measured(readings_df, {"temp": Measure(noise=1.0)}, noise_of())


def noise_of(pid: str = "pid") -> F.Column:
    """The noise term of ``perturb``, in -1 .. 1."""
    return ((F.col(pid) * NOISE_MULT) % NOISE_MOD) / NOISE_DIV - 1


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perturb(readings(spark, sf_dir))


def rule_predictions(readings_df: DataFrame, version: str,
                     bounds: tuple | None = None) -> DataFrame:
    """Score readings with a rule model: the written predictions shape."""
    t, p, d = bounds or RULE_MODELS[version]
    pred = F.when(rule(t, p, d), "1").otherwise("0")
    return readings_df.select(
        "pid", "process_time", pred.alias("predicted_quality"),
        F.lit(version).alias("model_version"))


def rule_predictions_many(readings_df: DataFrame, versions) -> DataFrame:
    """Score readings with several rule models in one pass: one output row per
    (reading, model), the union of ``rule_predictions`` for each version."""
    cells = [F.struct(F.when(rule(*RULE_MODELS[v]), "1").otherwise("0").alias("predicted_quality"),
                      F.lit(v).alias("model_version")) for v in versions]
    return (readings_df.select("pid", "process_time", F.explode(F.array(*cells)).alias("_m"))
            .select("pid", "process_time", "_m.predicted_quality", "_m.model_version"))


def predictions(spark: SparkSession, sf_dir: str, version: str = "m1") -> DataFrame:
    return rule_predictions(noisy(spark, sf_dir), version)


def grade(temp: str = "temp") -> F.Column:
    """The quality grade (0, 1 or 2) of a reading."""
    lo, hi = GRADE_BOUNDS
    return F.when(F.col(temp) < lo, 0).when(F.col(temp) < hi, 1).otherwise(2)


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inspection labels with three grades, from the true readings."""
    return readings(spark, sf_dir).select(
        "pid", inspection_due("process_time").alias("qualitycheck_time"), grade().alias("quality"))


def grade_predictions(spark: SparkSession, sf_dir: str, version: str = "g1") -> DataFrame:
    """Grades predicted from the readings as measured."""
    return noisy(spark, sf_dir).select(
        "pid", "process_time", grade().cast("string").alias("predicted_quality"),
        F.lit(version).alias("model_version"))
