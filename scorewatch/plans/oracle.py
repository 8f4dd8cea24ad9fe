"""DuckDB SQL for every checked query: an independent, plain formulation
(plain joins, window functions) of what the Spark operators compute.

Views available to the SQL: the driver's tables, here only ``events``.
"""

from __future__ import annotations


def _rule(t, p, d, temp="temp"):
    return (f"({temp} BETWEEN {t} AND 120 AND pressure BETWEEN 0 AND {p} "
            f"AND duration BETWEEN {d} AND 97)")


BASE = f"""
sensor AS (
  SELECT event_id AS pid, ts AS process_time, value AS temp,
         CAST(user_id AS DOUBLE) AS pressure,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS duration
  FROM events),
quality AS (
  SELECT pid, date_trunc('day', process_time + INTERVAL 2 DAY) AS qualitycheck_time,
         CAST(CASE
           WHEN process_time < TIMESTAMP '2024-01-14' AND {_rule(5, 134, 2)} THEN 1
           WHEN process_time >= TIMESTAMP '2024-01-14' AND process_time < TIMESTAMP '2024-01-24'
                AND {_rule(30, 134, 2)} THEN 1
           WHEN process_time >= TIMESTAMP '2024-01-24' AND {_rule(30, 74, 2)} THEN 1
           ELSE 0 END AS INTEGER) AS quality
  FROM sensor),
noisy AS (
  SELECT pid, process_time,
         temp + (CAST((pid * 7919) % 1001 AS DOUBLE) / CAST(500 AS DOUBLE) - 1) AS temp,
         pressure, duration
  FROM sensor),
pred_m1 AS (
  SELECT pid, process_time, CASE WHEN {_rule(5, 134, 2)} THEN '1' ELSE '0' END AS predicted_quality,
         'm1' AS model_version FROM noisy),
pred_m2 AS (
  SELECT pid, process_time, CASE WHEN {_rule(30, 134, 2)} THEN '1' ELSE '0' END AS predicted_quality,
         'm2' AS model_version FROM noisy),
promos AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, ts, event_id AS seq
  FROM events WHERE event_type = 'signup'),
grid_frame AS (
  SELECT n.pid, n.temp, n.pressure, n.duration, q.quality FROM noisy n JOIN quality q USING (pid)
  WHERE n.process_time BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-10 23:59:00'
    AND q.qualitycheck_time BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-10 23:59:00'),
grid_hits AS (
  SELECT g.lo, g.hi,
         CAST(SUM(CASE WHEN (CASE WHEN t.temp BETWEEN g.lo AND g.hi AND t.pressure BETWEEN 0 AND 134
                                  THEN 1 ELSE 0 END) = t.quality THEN 1 ELSE 0 END) AS BIGINT) AS hits,
         COUNT(*) AS n
  FROM (SELECT * FROM (VALUES (0), (5), (20)) a(lo) CROSS JOIN (VALUES (80), (120), (200)) b(hi)) g
  CROSS JOIN grid_frame t GROUP BY g.lo, g.hi)"""


def _grade(temp):
    return f"CASE WHEN {temp} < 20 THEN 0 WHEN {temp} < 60 THEN 1 ELSE 2 END"


GRADED = f"""graded AS (SELECT pid, {_grade('temp')} AS quality FROM sensor)"""
PRED_G = f"""pred_g AS (
  SELECT pid, process_time, CAST({_grade('temp')} AS VARCHAR) AS predicted_quality, 'g1' AS model_version
  FROM noisy)"""
# State tags: the latest of a run by event number, whatever the hourly time says.
STATES = """states AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, event_type, date_trunc('hour', ts) AS logged_at, event_id AS seq,
         CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS experiment,
         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn
  FROM events WHERE event_type IN ('signup', 'error'))"""
GAPPY = """
SELECT pid, process_time, 1 AS versions, 1 AS rows FROM noisy
WHERE temp IS NOT NULL AND pressure IS NOT NULL AND duration IS NOT NULL AND duration NOT IN (50, 60)"""


# Rows that a fitted pipeline scores; its node table must agree on all of them.
WALKED = """
SELECT COUNT(*) AS rows, 0 AS disagreements FROM noisy
WHERE temp IS NOT NULL AND pressure IS NOT NULL AND duration IS NOT NULL AND duration NOT IN (50, 60)"""
BOTH = """promo2 AS (
  SELECT *, CASE WHEN seq % 2 = 0 THEN 'even' ELSE 'odd' END AS experiment FROM promos)"""
# Stretches of consecutive drift days of the table kpi.
DRIFT_RUNS = ("""bad AS (
  SELECT window_day, row_number() OVER (ORDER BY window_day) AS n FROM (
    SELECT window_day, SUM(CASE WHEN accurate_prediction = 'Accurate' THEN ratio ELSE 0.0 END) AS a
    FROM kpi GROUP BY window_day) WHERE a < 80 OR a > 100)""", """runs AS (
  SELECT MIN(window_day) AS s, MAX(window_day) AS e FROM bad GROUP BY window_day - CAST(n AS INTEGER))""")


def with_base(*ctes: str) -> str:
    extra = "".join(",\n" + c for c in ctes)
    return "WITH " + BASE.strip() + extra + "\n"


def kpi_cte(name: str, preds: str, by_version: bool = False, labels: str = "quality") -> str:
    v = ", model_version" if by_version else ""
    part = "window_day" + v
    return f"""{name}_j AS (
  SELECT CAST(p.process_time AS DATE) AS window_day{", p.model_version" if by_version else ""},
         CASE WHEN TRY_CAST(p.predicted_quality AS INTEGER) = q.quality THEN 1 ELSE 0 END AS acc
  FROM {preds} p JOIN {labels} q USING (pid)),
{name}_c AS (SELECT window_day{v}, acc, COUNT(*) AS cnt FROM {name}_j GROUP BY window_day{v}, acc),
{name} AS (
  SELECT window_day{v}, CASE WHEN acc = 1 THEN 'Accurate' ELSE 'Inaccurate' END AS accurate_prediction,
         cnt AS "count", CAST(SUM(cnt) OVER (PARTITION BY {part}) AS BIGINT) AS total,
         cnt * 100 / CAST(SUM(cnt) OVER (PARTITION BY {part}) AS BIGINT) AS ratio
  FROM {name}_c)"""


SLICE = ("CASE WHEN process_time < TIMESTAMP '2024-01-16' THEN 0 "
         "WHEN process_time < TIMESTAMP '2024-01-21' THEN 1 "
         "WHEN process_time < TIMESTAMP '2024-01-26' THEN 2 ELSE 3 END")

KPI_COLS = 'window_day, accurate_prediction, "count", total, ratio'


def _describe(c):
    return (f"SELECT '{c}' AS \"column\", COUNT({c}) AS \"count\", ROUND(AVG({c}), 6) AS mean, "
            f"ROUND(STDDEV_SAMP({c}), 6) AS stddev, ROUND(MIN({c}), 6) AS \"min\", "
            f"ROUND(MAX({c}), 6) AS \"max\" FROM sensor")


def _runlog_rows():
    rid = "'rule-' || CAST(lo AS VARCHAR) || '-' || CAST(hi AS VARCHAR)"
    parts = [
        f"SELECT {rid} AS run_id, 'param' AS kind, 'lo' AS key, CAST(lo AS VARCHAR) AS value FROM grid_hits",
        f"SELECT {rid}, 'param', 'hi', CAST(hi AS VARCHAR) FROM grid_hits",
        f"SELECT {rid}, 'param', 'model_data_date', "
        "'2024-01-01 00:00:00 - 2024-01-10 23:59:00' FROM grid_hits",
        f"SELECT {rid}, 'metric', 'hits', CAST(hits AS VARCHAR) FROM grid_hits",
        f"SELECT {rid}, 'tag', 'state', 'dev' FROM grid_hits",
    ]
    return "\nUNION ALL\n".join(parts)


SQL: dict[str, str] = {
    "kpi_daily": with_base(kpi_cte("kpi", "pred_m1")) + f"SELECT {KPI_COLS} FROM kpi",

    "kpi_from_tables": with_base(kpi_cte("kpi", "pred_m1")) + f"SELECT {KPI_COLS} FROM kpi",

    "kpi_incremental": with_base(kpi_cte("kpi", "pred_m1")) + f"SELECT {KPI_COLS} FROM kpi",

    "kpi_on_arrival": with_base(kpi_cte("kpi", "pred_m1")) + f"SELECT {KPI_COLS} FROM kpi",

    "kpi_delta": with_base(kpi_cte("kpi", "pred_m1")) + f"SELECT {KPI_COLS} FROM kpi",
    "kpi_streams": with_base(kpi_cte("kpi", "pred_m1")) + f"SELECT {KPI_COLS} FROM kpi",

    "confusion_delta": with_base() + """
SELECT p.model_version, p.predicted_quality, CAST(q.quality AS VARCHAR) AS quality, COUNT(*) AS "count"
FROM pred_m1 p JOIN quality q USING (pid) WHERE p.pid % 97 <> 0
GROUP BY p.model_version, p.predicted_quality, q.quality""",

    "class_share_delta": with_base() + """
SELECT CAST(process_time AS DATE) AS window_day, predicted_quality, COUNT(*) AS "count",
       CAST(SUM(COUNT(*)) OVER (PARTITION BY CAST(process_time AS DATE)) AS BIGINT) AS total,
       COUNT(*) * 100 / CAST(SUM(COUNT(*)) OVER (PARTITION BY CAST(process_time AS DATE)) AS BIGINT) AS ratio
FROM pred_m1 GROUP BY CAST(process_time AS DATE), predicted_quality""",

    "production_intervals_by_experiment": with_base(BOTH) + """
SELECT run_id, experiment, ts AS production_start,
       LEAD(ts) OVER (PARTITION BY experiment ORDER BY ts, seq) AS production_end, seq FROM promo2""",

    "in_production_by_experiment": with_base(BOTH, """iv AS (
  SELECT run_id, experiment, ts AS s, LEAD(ts) OVER (PARTITION BY experiment ORDER BY ts, seq) AS e FROM promo2)""",
  """f AS (
  SELECT p.process_time, CASE WHEN p.pid % 2 = 0 THEN 'even' ELSE 'odd' END AS experiment,
         CASE WHEN TRY_CAST(p.predicted_quality AS INTEGER) = q.quality THEN 1 ELSE 0 END AS acc
  FROM pred_m1 p JOIN quality q USING (pid))""") + """
SELECT iv.experiment, iv.run_id, COUNT(*) AS readings, CAST(SUM(f.acc) AS BIGINT) AS accurate,
       CAST(SUM(f.acc) AS BIGINT) * 100 / COUNT(*) AS ratio
FROM f JOIN iv ON f.experiment = iv.experiment AND f.process_time >= iv.s AND (iv.e IS NULL OR f.process_time < iv.e)
GROUP BY iv.experiment, iv.run_id""",

    "slice_files": with_base() + """
SELECT COUNT(*) AS rows, 0 AS files_above FROM sensor WHERE process_time >= TIMESTAMP '2024-01-26'""",

    "measured_readings": with_base() + """
SELECT pid, process_time,
       temp * CAST(1.5 AS DOUBLE) + CAST(-2 AS DOUBLE) + (CAST((pid * 7919) % 1001 AS DOUBLE) / CAST(500 AS DOUBLE) - 1) AS temp,
       pressure + CAST(3 AS DOUBLE)
         + (CAST((pid * 7919) % 1001 AS DOUBLE) / CAST(500 AS DOUBLE) - 1) * CAST(0.5 AS DOUBLE) AS pressure,
       duration * CAST(0.5 AS DOUBLE) AS duration
FROM sensor""",

    "retrain_window_streamed": with_base("""landed AS (
  SELECT * FROM quality WHERE qualitycheck_time <= TIMESTAMP '2024-01-18 00:30:00')""",
  kpi_cte("kpi", "pred_m1", labels="landed"), DRIFT_RUNS[0], DRIFT_RUNS[1]) + """
SELECT s AS start_day, least(e, s + 6) AS end_day FROM runs ORDER BY e DESC LIMIT 1""",

    "scored_counts": with_base() + """, c AS (
  SELECT COUNT(*) AS rows, COUNT(*) FILTER (temp IS NULL OR pressure IS NULL OR duration IS NULL OR duration IN (50, 60))
         AS skipped FROM noisy)
SELECT path, rows, skipped FROM c, (VALUES ('batch'), ('stream')) v(path)""",

    "forest_walk": with_base() + WALKED,
    "tree_walk": with_base() + WALKED,
    "boosted_walk": with_base() + WALKED,

    "training_set": with_base() + """
SELECT s.pid, s.process_time, s.temp, s.pressure, s.duration, q.qualitycheck_time, q.quality
FROM sensor s JOIN quality q USING (pid)
WHERE s.process_time BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-10 23:59:00'
  AND q.qualitycheck_time BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-10 23:59:00'""",

    "due_slice": with_base() + """
SELECT pid, process_time, date_trunc('day', process_time + INTERVAL 2 DAY) AS qualitycheck_time
FROM sensor
WHERE process_time >= TIMESTAMP '2024-01-16' AND process_time < TIMESTAMP '2024-01-21'""",

    "rule_label": with_base() + "SELECT pid, qualitycheck_time, quality FROM quality",

    "confusion_matrix": with_base("""c AS (
  SELECT p.predicted_quality, q.quality, COUNT(*) AS cnt
  FROM pred_m1 p JOIN quality q USING (pid) GROUP BY p.predicted_quality, q.quality)""") + """
SELECT predicted_quality,
       CAST(COALESCE(SUM(CASE WHEN quality = 0 THEN cnt END), 0) AS BIGINT) AS quality_0,
       CAST(COALESCE(SUM(CASE WHEN quality = 1 THEN cnt END), 0) AS BIGINT) AS quality_1
FROM c GROUP BY predicted_quality""",

    "confusion_log": with_base("""u AS (SELECT * FROM pred_m1 UNION ALL SELECT * FROM pred_m2)""") + """
SELECT p.model_version, p.predicted_quality, q.quality, COUNT(*) AS "count"
FROM u p JOIN quality q USING (pid)
GROUP BY p.model_version, p.predicted_quality, q.quality""",

    "class_share": with_base("""c AS (
  SELECT CAST(process_time AS DATE) AS window_day, predicted_quality, COUNT(*) AS cnt
  FROM pred_m1 GROUP BY 1, 2)""") + """
SELECT window_day, predicted_quality, cnt AS "count",
       CAST(SUM(cnt) OVER (PARTITION BY window_day) AS BIGINT) AS total,
       cnt * 100 / CAST(SUM(cnt) OVER (PARTITION BY window_day) AS BIGINT) AS ratio
FROM c""",

    "drift_days": with_base(kpi_cte("kpi", "pred_m1")) + """
SELECT * FROM (
  SELECT window_day,
         SUM(CASE WHEN accurate_prediction = 'Accurate' THEN ratio ELSE 0.0 END) AS accurate_ratio
  FROM kpi GROUP BY window_day) d
WHERE accurate_ratio < 80 OR accurate_ratio > 100""",

    "kpi_stitched": with_base(kpi_cte("k1", "pred_m1"), kpi_cte("k2", "pred_m2")) + f"""
SELECT {KPI_COLS}, 'm1' AS model_version FROM k1 WHERE window_day < DATE '2024-01-16'
UNION ALL
SELECT {KPI_COLS}, 'm2' AS model_version FROM k2 WHERE window_day >= DATE '2024-01-16'""",

    "kpi_grades": with_base(GRADED, PRED_G, kpi_cte("kpi", "pred_g", labels="graded")) +
    f"SELECT {KPI_COLS} FROM kpi",

    "accuracy_grades": with_base(GRADED, PRED_G) + """
SELECT 'g1' AS model_version,
       SUM(CASE WHEN p.predicted_quality = CAST(q.quality AS VARCHAR) THEN 1 ELSE 0 END) / COUNT(*) AS accuracy,
       COUNT(*) AS n
FROM pred_g p JOIN graded q USING (pid)""",

    "confusion_grades": with_base(GRADED, PRED_G) + """
SELECT p.predicted_quality, COUNT(*) FILTER (q.quality = 0) AS quality_0,
       COUNT(*) FILTER (q.quality = 1) AS quality_1, COUNT(*) FILTER (q.quality = 2) AS quality_2
FROM pred_g p JOIN graded q USING (pid) GROUP BY p.predicted_quality""",

    "run_confusion": with_base() + """
SELECT p.predicted_quality, COUNT(*) FILTER (q.quality = 0) AS quality_0,
       COUNT(*) FILTER (q.quality = 1) AS quality_1
FROM pred_m2 p JOIN quality q USING (pid) GROUP BY p.predicted_quality""",

    "retrain_window": with_base(kpi_cte("kpi", "pred_m1"), *DRIFT_RUNS) + """
SELECT s AS start_day, least(e, s + 6) AS end_day FROM runs ORDER BY e DESC LIMIT 1""",

    "production_run": "WITH " + STATES + """
SELECT run_id, logged_at, seq FROM states WHERE rn = 1 AND event_type = 'signup' AND experiment = 'even'""",

    "promote_cycle": "WITH " + STATES + """
SELECT run_id, logged_at, seq FROM states WHERE rn = 1 AND event_type = 'signup' AND experiment = 'even'
UNION ALL
SELECT 'new-2', TIMESTAMP '2024-02-01', MAX(seq) + 2 FROM states""",

    "demote": "WITH " + STATES + """
SELECT run_id, seq FROM states
WHERE rn = 1 AND event_type = 'signup' AND experiment = 'even' AND run_id <> '4'""",

    "random_split_total": with_base() + "SELECT COUNT(*) AS rows, COUNT(DISTINCT pid) AS pids FROM grid_frame",

    "random_sample_outside": "SELECT 0 AS rows FROM events LIMIT 1",

    "stream_readings": with_base() + "SELECT * FROM sensor",

    "forest_rows": with_base() + GAPPY,
    "tree_rows": with_base() + GAPPY,
    "boosted_rows": with_base() + GAPPY,

    "fit_confusion_total": with_base() + """
SELECT COUNT(*) AS rows FROM grid_frame
WHERE ('0x' || substr(md5(CAST(pid AS VARCHAR)), 1, 8))::BIGINT % 10 >= 8
  AND temp IS NOT NULL AND pressure IS NOT NULL AND duration IS NOT NULL""",

    "kpi_after": with_base(kpi_cte("kpi", "pred_m1")) +
    f"SELECT {KPI_COLS} FROM kpi WHERE window_day > DATE '2024-01-20'",

    "kpi_stitch": with_base(kpi_cte("k1", "pred_m1"), kpi_cte("k2", "pred_m2")) + f"""
SELECT {KPI_COLS}, 'm1' AS model_version FROM k1 WHERE window_day < DATE '2024-01-16'
UNION ALL
SELECT {KPI_COLS}, 'm2' AS model_version FROM k2 WHERE window_day >= DATE '2024-01-16'""",

    "what_if": with_base("""u AS (SELECT * FROM pred_m1 UNION ALL SELECT * FROM pred_m2)""",
                         kpi_cte("kpi", "u", by_version=True)) +
    'SELECT window_day, model_version, accurate_prediction, "count", total, ratio FROM kpi',

    "accuracy_by_model": with_base("""u AS (SELECT * FROM pred_m1 UNION ALL SELECT * FROM pred_m2)""") + """
SELECT p.model_version,
       SUM(CASE WHEN TRY_CAST(p.predicted_quality AS INTEGER) = q.quality THEN 1 ELSE 0 END)
         / COUNT(*) AS accuracy,
       COUNT(*) AS n
FROM u p JOIN quality q USING (pid) GROUP BY p.model_version""",

    "hash_split": with_base() + """
SELECT CASE WHEN ('0x' || substr(md5(CAST(pid AS VARCHAR)), 1, 8))::BIGINT % 10 < 8
            THEN 'train' ELSE 'test' END AS split,
       COUNT(*) AS rows
FROM sensor GROUP BY 1""",

    "hash_sample": with_base() + """
SELECT s.temp, s.pressure, s.duration, q.quality
FROM sensor s JOIN quality q USING (pid)
WHERE ('0x' || substr(md5(CAST(s.pid AS VARCHAR)), 1, 8))::BIGINT % 100 < 99""",

    "grid_best": with_base() + """
SELECT lo, hi, hits, hits / n AS accuracy FROM grid_hits ORDER BY hits DESC, lo, hi LIMIT 1""",

    "best_run_per_family": with_base() + """
SELECT lo, hi, hits, accuracy FROM (
  SELECT lo, hi, hits, hits / n AS accuracy,
         ROW_NUMBER() OVER (PARTITION BY lo ORDER BY hits DESC, hi) AS rn
  FROM grid_hits) t WHERE rn = 1""",

    "pending_grid": with_base() + """
SELECT g.lo, g.hi
FROM (SELECT * FROM (VALUES (0), (5), (20), (30)) a(lo)
      CROSS JOIN (VALUES (80), (120), (200), (250)) b(hi)) g
WHERE NOT EXISTS (SELECT 1 FROM grid_hits h WHERE h.lo = g.lo AND h.hi = g.hi)""",

    "run_log": with_base() + _runlog_rows(),

    "latest_tag": """
SELECT run_id, key, value, logged_at FROM (
  SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS key, props AS value, ts AS logged_at,
         ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) t WHERE rn = 1""",

    "run_details": """
SELECT run_id, 'tag' AS kind, key, value, logged_at FROM (
  SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS key, props AS value, ts AS logged_at,
         ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn
  FROM events WHERE user_id = 3) t WHERE rn = 1""",

    "run_search": """
SELECT CAST(event_id AS VARCHAR) AS run_id FROM events
WHERE event_type = 'click' AND json_extract_string(props, '$.k') = '9'""",

    "production_intervals": with_base() + """
SELECT run_id, ts AS production_start, LEAD(ts) OVER (ORDER BY ts, seq) AS production_end, seq
FROM promos""",

    "promotion_log": with_base("""p AS (
  SELECT run_id, ts, seq, LAG(run_id) OVER (ORDER BY ts, seq) AS prev FROM promos)""") + """
SELECT run_id, 'state' AS key, 'production' AS value, ts, seq FROM p
UNION ALL
SELECT prev, 'state', 'ex_production', ts, seq FROM p WHERE prev IS NOT NULL""",

    "in_production": with_base("""iv AS (
  SELECT run_id, ts AS s, LEAD(ts) OVER (ORDER BY ts, seq) AS e FROM promos)""", """f AS (
  SELECT p.pid, p.process_time,
         CASE WHEN TRY_CAST(p.predicted_quality AS INTEGER) = q.quality THEN 1 ELSE 0 END AS acc
  FROM pred_m1 p JOIN quality q USING (pid))""") + """
SELECT iv.run_id, COUNT(*) AS readings, CAST(SUM(f.acc) AS BIGINT) AS accurate,
       CAST(SUM(f.acc) AS BIGINT) * 100 / COUNT(*) AS ratio
FROM f JOIN iv ON f.process_time >= iv.s AND (iv.e IS NULL OR f.process_time < iv.e)
GROUP BY iv.run_id""",

    "describe_value": with_base() + "\nUNION ALL\n".join(
        _describe(c) for c in ("temp", "pressure", "duration")),

    "label_index": with_base() + """
SELECT label, cnt AS "count",
       CAST(ROW_NUMBER() OVER (ORDER BY cnt DESC, label) - 1 AS DOUBLE) AS label_index
FROM (SELECT CAST(quality AS VARCHAR) AS label, COUNT(*) AS cnt FROM quality GROUP BY 1) t""",

    "valid_features": with_base() + """
SELECT pid, temp, pressure, duration FROM (
  SELECT pid, temp, pressure, CASE WHEN duration = 50 THEN NULL ELSE duration END AS duration
  FROM sensor) t
WHERE temp IS NOT NULL AND pressure IS NOT NULL AND duration IS NOT NULL
  AND NOT isnan(temp) AND NOT isnan(pressure) AND NOT isnan(duration)""",

    "combined_readings": with_base() +
    "SELECT pid, process_time, temp, pressure, duration FROM sensor",

    "batch_write_slices": with_base() +
    f"SELECT {SLICE} AS batch, COUNT(*) AS rows FROM sensor GROUP BY 1",

    "scaled_features": with_base() + """
SELECT pid,
       ROUND(temp / STDDEV_SAMP(temp) OVER (), 6) AS temp_scaled,
       ROUND(pressure / STDDEV_SAMP(pressure) OVER (), 6) AS pressure_scaled,
       ROUND(duration / STDDEV_SAMP(duration) OVER (), 6) AS duration_scaled
FROM sensor""",

    "epoch_readings": """
SELECT 100000 + event_id AS pid,
       make_timestamp(CAST((event_id * 450.0 + 1704067200 + ROUND(value, 0)) * 1000000 AS BIGINT))
         AS process_time
FROM events""",

    "stream_score_rule": with_base() + "SELECT * FROM pred_m1",

    "stream_predictions": with_base() + "SELECT * FROM pred_m1",

    "stream_labels": with_base() + "SELECT pid, qualitycheck_time, quality FROM quality",

    "stream_swap": with_base() + """
SELECT pid, process_time,
       CASE WHEN process_time < TIMESTAMP '2024-01-16'
            THEN (CASE WHEN temp > 5 THEN '1' ELSE '0' END)
            ELSE (CASE WHEN temp > 30 THEN '1' ELSE '0' END) END AS predicted_quality,
       CASE WHEN process_time < TIMESTAMP '2024-01-16' THEN 'm1' ELSE 'm2' END AS model_version
FROM sensor""",
}
SQL["stream_promote"] = SQL["stream_swap"]
