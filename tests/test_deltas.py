"""Signed deltas equal a full recomputation after any mix of batches, corrections and replays."""

import random

import pytest

from scorewatch.operators import deltas, monitor
from scorewatch.session import fresh_dir, path_exists
from tests.helpers import ts

PRED = "pid long, process_time timestamp_ntz, predicted_quality string, model_version string"
CHANGE = "pid long, quality int, op string"


def batches(seed):
    rng = random.Random(seed)
    labels, out = {}, []
    for b in range(6):
        if b % 2 == 0:
            out.append([(rng.randrange(60), ts(f"2024-01-{rng.randrange(1, 6):02d} 03:00:00"), rng.choice("01"),
                         rng.choice(["a", "b"])) for _ in range(40)])
            continue
        changes, fixed = [], set(labels)
        for _ in range(30):
            changes.append((rng.randrange(60), rng.choice([0, 1, None]), "add"))
        for pid in rng.sample(sorted(fixed), min(8, len(fixed))):
            changes.append((pid, rng.randrange(2), rng.choice(["correct", "remove"])))
        for pid, q, op in changes:
            if op != "add":
                labels[pid] = []
        for pid, q, op in changes:
            if op != "remove":
                labels.setdefault(pid, []).append(q)
        out.append(changes)
    return out, [(p, q) for p, qs in labels.items() for q in qs]


def apply(spark, state, b, rows):
    if b % 2 == 0:
        return state.append_predictions(b, spark.createDataFrame(rows, PRED))
    return state.change_labels(b, spark.createDataFrame(rows, CHANGE))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_recomputation_with_replays_and_a_failed_batch(spark, seed, monkeypatch):
    made, labels = batches(seed)
    state = deltas.Deltas(fresh_dir(spark, "t-deltas"), span=7)
    real = deltas.Deltas._commit
    for b, rows in enumerate(made):
        if b == 3:                                               # fails before its ledger entry, then comes again
            monkeypatch.setattr(deltas.Deltas, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                apply(spark, state, b, rows)
            monkeypatch.setattr(deltas.Deltas, "_commit", real)
        assert apply(spark, state, b, rows)
        assert not apply(spark, state, max(0, b - 1), made[max(0, b - 1)])        # replay of an earlier batch
    preds = spark.createDataFrame([r for b in made[::2] for r in b], PRED)
    labs = spark.createDataFrame(labels, "pid long, quality int")
    assert sorted(state.kpi(spark).collect()) == sorted(monitor.daily_kpi(labs, preds).collect())
    assert sorted(state.kpi(spark, by_version=True).collect()) == sorted(
        monitor.daily_kpi(labs, preds, by_version=True).collect())
    text = labs.selectExpr("pid", "CAST(quality AS STRING) AS quality")
    assert sorted(map(str, state.confusion(spark).collect())) == sorted(
        map(str, monitor.joined_confusion(text, preds).collect()))
    assert sorted(state.class_share(spark).collect()) == sorted(monitor.daily_class_share(preds).collect())
    assert sorted(state.accuracy(spark).collect()) == sorted(monitor.accuracy(labs, preds).collect())


def test_empty_batches_and_nothing_applied(spark):
    state = deltas.Deltas(fresh_dir(spark, "t-deltas"))
    assert state.kpi(spark).collect() == [] and state.committed(spark) == []
    assert state.append_predictions(0, spark.createDataFrame([], PRED))
    assert state.change_labels(1, spark.createDataFrame([(1, 1, "correct"), (None, 1, "add")], CHANGE))
    assert state.committed(spark) == [0, 1] and state.totals(spark).collect() == []
    assert path_exists(spark, f"{state.root}/counts/batch=0/_SUCCESS")
