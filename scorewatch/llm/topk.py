"""Exact top-k inner-product search: ball trees per shard, branch and bound.

Vectors are dealt to shards of about ``SHARD`` rows by a hash of the row. Each
shard builds a ball tree (median splits along the widest direction, flat
arrays), stored once. The query set (ids divisible by ``EVERY``) is cut into
blocks, and a shard's task loads its tree once and searches block after block:
nodes are bounded by q.center + |q| * radius, visited in the order of that
bound, and dropped for every query whose current k-th score exceeds it; bounds
carry a rounding margin, so nothing that ties is lost.

Shards are searched in rounds, the first alone, then ``GROWTH`` times as many each:
after a round the k-th score that every query has reached by then is shared
with the shards to come, so they visit and return little. Per query a final
top-k over at most k rows per shard gives the answer.

Scores are integers: computed in doubles while every product sum stays below 2^53,
in 64-bit integers below 2^63, else in Python integers, where scores beyond a long
are ordered exactly within a shard and given as the largest (smallest) long.

Defined cases: vectors that are null, empty, or hold null or non-finite components
take no part; only vectors of the query's length are its candidates; a row is
never its own neighbour, but other rows of the same vec_id are; repeated query
rows are answered each; a null vec_id is never a query and sorts last among ties;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorewatch.llm.common import python_tasks, stored, table

K = 20
EVERY = 20                  # queries: rows whose id is divisible by it
SCALE = 64                  # component x becomes floor(SCALE * x)
SHARD = 8192                # vectors per tree, about
BLOCK = 4096                # queries per block, about
LEAF = 128                  # vectors per leaf
LARGE = 2**63 - 1
LEAST = -2**63              # no k-th score yet
GROWTH = 4


def _scaled(c: Column) -> Column:
    most = F.lit(np.finfo(float).max.item())
    y = F.greatest(F.least(c * float(SCALE), most), -most)
    whole = F.abs(y) >= float(2**52)                             # an integer already, perhaps beyond a long
    return F.when(whole, y).otherwise(F.floor(F.when(~whole, y)).cast("double"))


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(row, vec_id, dim, v): usable vectors as integers in doubles; a null id is LARGE. A
    component whose multiple is beyond doubles counts as the largest double."""
    x = F.transform(vec_col, lambda c: c.cast("double"))
    usable = (F.size(vec_col) > 0) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LARGE)).alias("vec_id"),
        F.size(vec_col).alias("dim"), F.transform(x, _scaled).alias("v"))


def _pack(**arrays: np.ndarray) -> bytes:
    buf = io.BytesIO()
    np.savez(buf, **arrays)
    return buf.getvalue()


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        return {k: z[k] for k in z.files}


# ---- tree ---------------------------------------------------------------------------------

def build(v: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Flat ball tree: ``order`` sorts the vectors; node i covers order[lo:hi] and has
    children ``left[i]``, ``left[i] + 1`` (0: leaf)."""
    order = np.arange(len(v))
    lo, hi, left, center, radius = [0], [len(v)], [0], [], []
    i = 0
    while i < len(lo):
        a, b = lo[i], hi[i]
        own = v[order[a:b]]
        c = own.mean(axis=0)
        center.append(c)
        radius.append(float(np.sqrt(((own - c)**2).sum(axis=1).max())))
        if b - a > leaf and radius[-1] > 0:
            axis = int(own.var(axis=0).argmax())
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, axis], mid)]
            left[i] = len(lo)
            lo += [a, a + mid]
            hi += [a + mid, b]
            left += [0, 0]
        i += 1
    return {"order": order, "lo": np.array(lo), "hi": np.array(hi), "left": np.array(left),
            "center": np.array(center), "radius": np.array(radius)}


class _Best:
    """The best k (score, id) per query, with the current k-th score."""

    def __init__(self, kth: np.ndarray, k: int) -> None:
        self.k, self.kth = k, kth.astype(np.int64)
        self.q = np.zeros(0, np.int64)
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, score, ids = (np.concatenate(x) for x in ((self.q, q), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, q))                     # ~score falls as the score rises
        q = q[order]
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        keep = place < self.k
        full = q[place == self.k - 1]
        self.q, self.score, self.id = q[keep], score[order][keep], ids[order][keep]
        ends = score[order][place == self.k - 1]
        self.kth[full] = np.maximum(self.kth[full], ends)


def products(qv: np.ndarray, v: np.ndarray, largest: float) -> np.ndarray:
    """Inner products of integers held as doubles, as longs; ``largest``: no sum of absolute
    products exceeds it."""
    if largest < 2**53:
        return (qv @ v.T).astype(np.int64)
    if largest < 2**62:                                          # a factor of two for its own rounding
        return qv.astype(np.int64) @ v.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    s = whole(qv).dot(whole(v).T)
    return np.maximum(np.minimum(s, LARGE), -LARGE).astype(np.int64)


def search(v: np.ndarray, ids: np.ndarray, rows: np.ndarray, tree: dict[str, np.ndarray], qv: np.ndarray,
           qrows: np.ndarray, kth: np.ndarray, k: int) -> _Best:
    """Best k of the shard for each query; ``kth``: scores already reached elsewhere."""
    largest = float(np.abs(v).max(initial=0)) * float(np.abs(qv).max(initial=0)) * v.shape[1]
    best = _Best(kth, k)
    with np.errstate(over="ignore"):
        norm = np.sqrt((qv**2).sum(axis=1))
        far = np.sqrt((tree["center"]**2).sum(axis=1)) + tree["radius"]
    sorted_v, sorted_ids, sorted_rows = v[tree["order"]], ids[tree["order"]], rows[tree["order"]]

    def bound(node: int, active: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            ub = qv[active] @ tree["center"][node] + norm[active] * tree["radius"][node]
            ub = ub + 1e-11 * norm[active] * far[node] + 1e-6
        return np.where(np.isfinite(ub), ub, np.inf)             # beyond doubles: not pruned

    everyone = np.arange(len(qv))
    stack = [(0, everyone, bound(0, everyone))]
    while stack:
        node, active, ub = stack.pop()
        stay = ub >= best.kth[active].astype(float)              # equal scores may win by a smaller id
        active = active[stay]
        if not len(active):
            continue
        child = int(tree["left"][node])
        if child:
            both = [(c, active, bound(c, active)) for c in (child, child + 1)]
            stack += sorted(both, key=lambda x: x[2].sum())      # the larger bound is popped first
            continue
        a, b = int(tree["lo"][node]), int(tree["hi"][node])
        s = products(qv[active], sorted_v[a:b], largest)
        ok = (s >= best.kth[active][:, None]) & (qrows[active][:, None] != sorted_rows[a:b][None, :])
        i, j = np.nonzero(ok)
        best.add(active[i], s[i, j], sorted_ids[a:b][j])
    return best


# ---- operator -----------------------------------------------------------------------------

def _trees(rows: DataFrame, shards: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        v = np.stack(pdf["v"])
        blob = _pack(v=v, ids=pdf["vec_id"].to_numpy(np.int64), rows=pdf["row"].to_numpy(), **build(v))
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "tree": [blob]})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    return stored(dealt.groupBy("dim", "shard").applyInPandas(run, "dim int, shard int, tree binary"), "topk-trees")


def _blocks(queries: DataFrame, blocks: int) -> DataFrame:
    """Query blocks; ``kth`` is the score each query has reached, or ``LEAST``."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        blob = _pack(v=np.stack(pdf["v"]), ids=pdf["vec_id"].to_numpy(np.int64), rows=pdf["row"].to_numpy(),
                     kth=pdf["kth"].to_numpy(np.int64))
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "block": [pdf["block"].iloc[0]], "queries": [blob]})

    dealt = queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("dim", "block").applyInPandas(run, "dim int, block int, queries binary")


FOUND = "qrow long, query_id long, vec_id long, score long"


def _search(trees: DataFrame, blocks: DataFrame, first: int, last: int, k: int) -> DataFrame:
    """The trees of shards first to last against all blocks of their dimension: blocks are
    copied to the shards, each tree is loaded once and moves once."""
    def run(batches):
        tree, at = None, None
        for pdf in batches:
            for dim, shard, blob, queries in zip(pdf["dim"], pdf["shard"], pdf["tree"], pdf["queries"]):
                if blob is not None:
                    tree, at = _unpack(blob), (dim, shard)
                elif at == (dim, shard):                         # a dimension may lack this shard
                    q = _unpack(queries)
                    best = search(tree["v"], tree["ids"], tree["rows"], tree, q["v"], q["rows"], q["kth"], k)
                    yield pd.DataFrame({"qrow": q["rows"][best.q], "query_id": q["ids"][best.q], "vec_id": best.id,
                                        "score": best.score})

    own = trees.filter(F.col("shard").between(first, last)).select(
        "dim", "shard", F.lit(-1).alias("block"), "tree", F.lit(None).cast("binary").alias("queries"))
    dealt = blocks.select("dim", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("shard"), "block",
                          F.lit(None).cast("binary").alias("tree"), "queries")
    both = own.unionAll(dealt).repartition(max(1, last - first + 1), "dim", "shard")
    return both.sortWithinPartitions("dim", "shard", "block").select("dim", "shard", "tree", "queries").mapInPandas(
        run, FOUND)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding",
          shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for every query row."""
    spark = vectors.sparkSession
    python_tasks(spark)
    rows = stored(integer_vectors(vectors, id_col, vec_col), "topk-vectors")
    queries = rows.filter((F.pmod("vec_id", F.lit(every)) == 0) & (F.col("vec_id") < LARGE))
    n, m = rows.count(), queries.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-m // block))
    trees = _trees(rows, shards)
    found, first, last = None, 0, 0
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    size = spark.conf.get(key)
    while first < shards:
        kth = F.lit(LEAST).cast("long").alias("kth")
        own = queries.withColumn("kth", kth)
        if found is not None:
            place = F.row_number().over(W.partitionBy("qrow").orderBy(F.desc("score"), "vec_id"))
            reached = (found.withColumn("place", place).filter(F.col("place") == k)
                       .select(F.col("qrow").alias("row"), F.col("score").alias("kth")))
            own = queries.join(reached, "row", "left").withColumn("kth", F.coalesce("kth", kth))
        ready = stored(_blocks(own, blocks), "topk-blocks")
        spark.conf.set(key, "8")                                 # rows are whole trees and blocks
        try:
            more = stored(_search(trees, ready, first, last, k), "topk-found")
        finally:
            spark.conf.set(key, size)
        found = more if found is None else found.unionAll(more)
        first, last = last + 1, min(shards - 1, last + GROWTH * (last - first + 1))
    place = F.row_number().over(W.partitionBy("qrow").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", place).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.when(F.col("vec_id") < LARGE, F.col("vec_id")).alias("vec_id"), "score"))


def op8_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH v AS (SELECT vec_id, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
