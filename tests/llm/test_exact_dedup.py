import hashlib
import re
from collections import defaultdict

import pytest

from scorewatch.llm import exact_dedup


@pytest.mark.parametrize("fan_in", [2, 16])
def test_against_brute_force(spark, fan_in):
    texts = ["a b", "a  b", "a\t\nb", "a b ", " a b", None, "", "A b", "x" * 300_000, "x" * 300_000]
    rows = [(i * 7 % 103, texts[i % len(texts)] if i % 3 else f"only {i}") for i in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for d, t in rows:
        groups[norm(t)].append(d)
    want = sorted((d, min(groups[norm(t)]), len(groups[norm(t)]), d == min(groups[norm(t)]),
                   hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in rows)
    assert sorted(map(tuple, exact_dedup.exact_dedup(frame, fan_in=fan_in).collect())) == want


def test_null_ids_repeated_rows_and_no_rows(spark):
    rows = [(None, "a", 1), (4, "a", 1), (4, "a", 1), (None, "b", 2), (None, "b", 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, run int").repartition(2)
    got = exact_dedup.exact_dedup(frame).collect()
    assert sorted((str(r.keep_id), r.group_size, r.kept) for r in got) == sorted(
        [("4", 3, True), ("4", 3, False), ("4", 3, False), ("None", 2, True), ("None", 2, False)])
    assert exact_dedup.exact_dedup(frame.limit(0)).collect() == []


@pytest.mark.parametrize(("runs", "fan_in", "rounds"), [(1, 16, 1), (16, 16, 1), (17, 16, 2), (40, 2, 6)])
def test_rounds_share_one_exchange_and_one_sort(spark, runs, fan_in, rounds):
    rows = [(r, bytes([r * k % 7]), 1, 5, (False, 100 * r + k, 0), 1) for r in range(runs) for k in range(3)]
    kind = ("run int, sha binary, n_bytes long, check long, "
            "first struct<no_id: boolean, doc_id: long, row: long>, n long")
    got = exact_dedup.merged(spark.createDataFrame(rows, kind), runs, fan_in)
    want = defaultdict(list)
    for _, sha, _, _, first, _ in rows:
        want[sha].append(first[1])
    assert sorted((bytes(r.sha), r["first"].doc_id, r.n) for r in got.collect()) == sorted(
        (k, min(v), len(v)) for k, v in want.items())
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortAggregate") == 2 * rounds                # partial and final
    plan = got._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("Exchange ") == plan.count("Exchange rangepartitioning") == 1
    assert len(re.findall(r"\bSort \[", plan)) == 1


def test_group_over_many_runs(spark):
    rows = [(i, "same  text" if i % 3 == 0 else f"t{i}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(60)
    got = exact_dedup.exact_dedup(frame, fan_in=4)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == [
        (i, 0, 1000, i == 0) if i % 3 == 0 else (i, i, 1, True) for i in range(3000)]
