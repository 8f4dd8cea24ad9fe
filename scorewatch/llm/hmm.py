"""Language-model scoring by a hidden Markov model over token classes.

Counts. Every training document's tokens (A-Z lower-cased words and one end) are
counted: per chunk in Python, then one aggregation. Tokens with at least one in
``SHARE`` of all training tokens (so at most ``SHARE`` of them) and the end are
classes of their own; all others fall into ``BUCKETS`` classes by their last
three bytes. Within a class a token has probability (c + 0.1) / S, S the class's
sum of c + 0.1 plus 0.1 for the one unknown outcome of a bucket. So the text's
probability is that of its class sequence under the HMM times these, a proper
distribution over known tokens and one unknown outcome per bucket; the number of
classes is bounded, the counts are not and stay in tables.

Training. States start from the documents' class profiles. The first centres lie on both
sides of the mean profile along its main axes, which come from sums over all training
documents; ``NEAREST`` k-means rounds over all of them follow, a row of sums per centre
and task, then every training document counts towards its nearest centre. Nothing here
depends on how the rows are stored. ``ROUNDS`` Baum-Welch rounds follow: each task runs the
scaled forward and backward recursions over its documents and sends on one row of
expected counts per class; these are summed by Spark, and the driver gets at most
classes x states numbers.

Scoring. The scaled forward recursion gives each whole text's exact likelihood.
Documents of a batch advance together, sorted by length, a token at a time. The
counts of rare tokens reach the documents chunk by chunk: a chunk's distinct rare
tokens are joined with the count table and co-grouped with the chunk's documents,
so a token costs one row per chunk, not one per occurrence.

Defined cases: a null text counts as empty (the end alone); a null doc_id is
neither held out nor learned from and gets a score; without training documents
all classes are alike; repeated rows count and are scored each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.llm.common import python_tasks, stored, table

FOLDS = 10
ALPHA = 0.1                 # fixed by the contract: additive smoothing
STATES = 6
ROUNDS = 2
SHARE = 8192                # own class: at least 1 / SHARE of the training tokens
BUCKETS = 1024              # classes of the other tokens, by their last three bytes
NEAREST = 3                 # k-means rounds that place the states' centres
FOLD = 128                  # a profile: the FOLD commonest tokens, the others by bucket modulo FOLD
STAY = 0.95                 # first probability of keeping the state
PRIOR = 50.0                # pseudo-tokens of the overall class distribution per state
END = b""                   # the end token; words are never empty

CHUNK_WORDS = 400_000       # distinct rare tokens of a chunk
CHUNK_TOKENS = 4_000_000
BATCH_TOKENS = 1_000_000    # tokens of documents that advance together


def tokens_of(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()   # bytes: ASCII only, both
    words.append(END)
    return words


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0


# ---- counts -------------------------------------------------------------------------------

def token_counts(rows: DataFrame) -> DataFrame:
    """(token, c) over the training documents of ``rows(doc_id, text)``."""
    def run(batches):
        counts: Counter = Counter()

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()),
                                              pa.array(list(counts.values()), pa.int64())], ["token", "n"])
            counts.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update(tokens_of(t))
            if len(counts) > CHUNK_WORDS:
                yield from flush()
        yield from flush()

    train = rows.filter(~held_out()).select("text")             # null ids are neither
    return train.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


@dataclass(frozen=True)
class Classes:
    """Frequent tokens 0 .. F-1, the end F, buckets F+1 .. F+BUCKETS."""

    frequent: tuple[bytes, ...]
    counts: np.ndarray            # of the frequent tokens and the end
    within: np.ndarray            # log10 S per class, 0 for single tokens
    share: np.ndarray             # overall class distribution
    total: int                    # N
    distinct: int                 # V

    @property
    def size(self) -> int:
        return len(self.share)

    def bucket(self, token: bytes) -> int:
        return len(self.frequent) + 1 + zlib.crc32(token[-3:]) % BUCKETS


def classes_of(counts: DataFrame) -> Classes:
    """At most SHARE + BUCKETS rows reach the driver."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    own = F.col("c") * SHARE >= total
    is_end = F.length("token") == 0
    top = counts.filter(own & ~is_end).orderBy(F.desc("c"), "token").collect()
    end = counts.filter(is_end).agg(F.sum("c")).first()[0] or 0
    bucket = F.crc32(F.expr("substring(token, -3, 3)")) % BUCKETS
    sums = counts.filter(~own & ~is_end).groupBy(bucket.alias("b")).agg(F.sum(F.col("c") + F.lit(ALPHA)).alias("s"))
    mass = np.full(len(top) + 1 + BUCKETS, ALPHA)
    mass[:len(top)] += [r["c"] for r in top]
    mass[len(top)] += end
    for r in sums.collect():
        mass[len(top) + 1 + r["b"]] += r["s"]
    within = np.log10(mass)
    within[:len(top) + 1] = 0
    return Classes(tuple(bytes(r["token"]) for r in top), np.array([r["c"] for r in top] + [end], dtype=np.int64),
                   within, mass / mass.sum(), int(total), int(distinct))


# ---- documents as class sequences ---------------------------------------------------------

CODED = ("chunk long, row int, doc_id long, held boolean, n_tokens long, known long, logs double, "
         "rare binary, seq binary, token binary, local int")


class _Numbers(dict):
    def __missing__(self, token: bytes) -> int:
        self[token] = n = len(self)
        return n


def coded(rows: DataFrame, cls: Classes) -> DataFrame:
    """Chunks of documents: a row per document (class sequence, numbers of its rare
    tokens within the chunk) and a row per distinct rare token of the chunk."""
    own = len(cls.frequent) + 1

    def run(batches):
        logs = np.log10(cls.counts + ALPHA)
        seen = cls.counts > 0
        names = [c.split()[0] for c in CODED.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary(),
                 pa.binary(), pa.binary(), pa.int32()]
        first = {t: i for i, t in enumerate((*cls.frequent, END))}
        number, docs, chunk, size = _Numbers(first), [], TaskContext.get().partitionId() << 24, 0

        def batch(cols, n):
            return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(n, t)
                                               for c, t in zip(names, types)], names)

        def flush():
            words = list(number)[own:]
            kind = np.concatenate([np.arange(own), np.fromiter(map(cls.bucket, words), np.int64, len(words))])
            for at in range(0, len(docs), 512):
                part = docs[at:at + 512]
                rows = {c: [] for c in names[:9]}
                for i, (doc_id, held, ids) in enumerate(part):
                    mine = ids[ids < own]
                    for c, v in zip(names, (chunk, at + i, doc_id, held, len(ids), int(seen[mine].sum()),
                                            float(logs[mine].sum()), (ids[ids >= own] - own).astype("<i4").tobytes(),
                                            kind[ids].astype("<u2").tobytes())):
                        rows[c].append(v)
                yield batch(rows, len(part))
            for at in range(0, len(words), 1 << 16):
                part = words[at:at + (1 << 16)]
                yield batch({"chunk": [chunk] * len(part), "token": part,
                             "local": list(range(at, at + len(part)))}, len(part))

        for b in batches:
            for doc_id, held, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                words = tokens_of(text)
                docs.append((doc_id, held, np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                             .astype(np.int32)))
                size += len(words)
                if size > CHUNK_TOKENS or len(number) > CHUNK_WORDS:
                    yield from flush()
                    number, docs, chunk, size = _Numbers(first), [], chunk + 1, 0
        yield from flush()

    return rows.select("doc_id", held_out().alias("held"), "text").mapInArrow(run, CODED)


def rare_sums(code: DataFrame, counts: DataFrame) -> DataFrame:
    """(chunk, row, rare_known, rare_logs): a document's rare tokens that are known, and
    their sum of log10(c + 0.1)."""
    words = (code.filter("token IS NOT NULL").select("chunk", "local", "token").join(counts, "token", "left")
             .select("chunk", "local", F.coalesce("c", F.lit(0)).alias("c")))
    docs = code.filter("row IS NOT NULL").select(F.col("chunk").alias("part"), "row", "rare")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        c = np.zeros(right.num_rows, dtype=np.int64)
        c[right["local"].to_numpy()] = right["c"].to_numpy()
        known, logs = c > 0, np.log10(c + ALPHA)
        ids = [np.frombuffer(x, "<i4") for x in left["rare"].to_pylist()]
        return pa.table({"chunk": left["part"], "row": left["row"],
                         "rare_known": pa.array([int(known[i].sum()) for i in ids], pa.int64()),
                         "rare_logs": pa.array([float(logs[i].sum()) for i in ids], pa.float64())})

    return docs.groupBy("part").cogroup(words.groupBy("chunk")).applyInArrow(
        run, "chunk long, row int, rare_known long, rare_logs double")


# ---- the model ----------------------------------------------------------------------------

@dataclass(frozen=True)
class HMM:
    first: np.ndarray             # (states)
    move: np.ndarray              # (states, states)
    emit: np.ndarray              # (classes, states)


class _Together:
    """Documents sorted by length, laid out step by step: step t holds the first
    ``live[t]`` documents from ``at[t]`` on."""

    def __init__(self, docs: list[np.ndarray]) -> None:
        lens = np.array([len(d) for d in docs])
        self.order = np.argsort(-lens, kind="stable")
        lens = lens[self.order]
        self.live = np.searchsorted(-lens, -np.arange(lens[0]), side="left")
        self.at = np.concatenate([[0], np.cumsum(self.live)])
        self.seq = np.empty(int(lens.sum()), dtype=np.int32)
        self.doc = np.empty(len(self.seq), dtype=np.int32)
        for j, i in enumerate(self.order.tolist()):
            place = self.at[:lens[j]] + j
            self.seq[place], self.doc[place] = docs[i], j


def likelihood(model: HMM, docs: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each class sequence: the scaled forward recursion."""
    w = _Together(docs)
    scale = np.empty(len(w.seq))
    a = None
    for t, n in enumerate(w.live.tolist()):
        lo = w.at[t]
        a = (model.first if a is None else a[:n] @ model.move) * model.emit[w.seq[lo:lo + n]]
        scale[lo:lo + n] = s = a.sum(axis=1)
        a /= s[:, None]
    out = np.empty(len(docs))
    out[w.order] = np.bincount(w.doc, np.log10(scale), len(docs))
    return out


class Expected:
    """Expected counts of Baum-Welch: first states, moves, emissions."""

    def __init__(self, classes: int, states: int) -> None:
        self.first, self.move = np.zeros(states), np.zeros((states, states))
        self.emit = np.zeros((classes, states))

    def add(self, model: HMM, docs: list[np.ndarray]) -> None:
        w = _Together(docs)
        emit, move = model.emit.astype(np.float32), model.move.astype(np.float32)
        e = emit[w.seq]
        alpha = np.empty_like(e)
        scale = np.empty(len(w.seq), dtype=np.float32)
        live, at = w.live.tolist(), w.at.tolist()
        for t, n in enumerate(live):
            lo = at[t]
            a = e[lo:lo + n] * (model.first.astype(np.float32) if t == 0 else alpha[at[t - 1]:at[t - 1] + n] @ move)
            s = a.sum(axis=1)
            alpha[lo:lo + n] = a / s[:, None]
            scale[lo:lo + n] = s
        beta = np.ones((live[-1], len(move)), dtype=np.float32)
        pairs = np.zeros_like(self.move)
        for t in range(len(live) - 1, 0, -1):
            lo, n, before, m = at[t], live[t], at[t - 1], live[t - 1]
            x = e[lo:lo + n] * beta / scale[lo:lo + n, None]
            pairs += alpha[before:before + n].T @ x
            e[lo:lo + n] = beta                                  # kept for the state weights below
            beta = np.ones((m, len(move)), dtype=np.float32)
            beta[:n] = x @ move.T
        e[:live[0]] = beta
        gamma = alpha * e
        gamma /= gamma.sum(axis=1, keepdims=True)
        self.move += pairs * model.move
        self.first += gamma[:live[0]].sum(axis=0)
        for k in range(len(move)):
            self.emit[:, k] += np.bincount(w.seq, gamma[:, k], len(self.emit))

    def assign(self, centres: np.ndarray, docs: list[np.ndarray], own: int) -> None:
        """Every document counts wholly towards the state of its nearest centre."""
        state = nearest(centres, profiles(docs, own))
        self.first += np.bincount(state, minlength=len(self.first))
        each = np.repeat(state, [len(d) for d in docs])
        flat = np.concatenate(docs).astype(np.int64) * len(self.first) + each
        self.emit += np.bincount(flat, minlength=self.emit.size).reshape(self.emit.shape)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(class, one column per state); first states and moves as classes below 0."""
        used = np.flatnonzero(self.emit.any(axis=1))
        values = np.concatenate([self.emit[used], self.first[None, :], self.move])
        kinds = np.concatenate([used, -1 - np.arange(len(self.move) + 1)])
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32())] + [pa.array(v) for v in values.T.copy()],
                                         ["kind"] + [f"s{k}" for k in range(values.shape[1])])


def profiles(docs: list[np.ndarray], own: int) -> np.ndarray:
    """A row per document: square roots of the shares of its folded classes."""
    lens = np.array([len(d) for d in docs])
    seq = np.concatenate(docs).astype(np.int64)
    folded = np.where(seq < own, np.minimum(seq, FOLD), FOLD + 1 + (seq - own) % FOLD)
    wide = 2 * FOLD + 1
    flat = np.repeat(np.arange(len(docs)), lens) * wide + folded
    return np.sqrt(np.bincount(flat, minlength=len(docs) * wide).reshape(-1, wide) / lens[:, None])


def nearest(centres: np.ndarray, x: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def first_centres(n: float, total: np.ndarray, square: np.ndarray, states: int) -> np.ndarray:
    """Centres from n profiles' sum and their summed outer products: a standard deviation
    off the mean, to both sides along the main axes."""
    mean = total / max(n, 1)
    value, axis = np.linalg.eigh(square / max(n, 1) - np.outer(mean, mean))
    out = []
    for k in range(states):
        a = axis[:, -1 - k // 2]
        a = a * np.sign(a[np.abs(a).argmax()])                   # eigenvectors have no sign of their own
        out.append(mean + (1 - 2 * (k % 2)) * np.sqrt(max(value[-1 - k // 2], 0)) * a)
    return np.array(out)


def place_centres(train: DataFrame, own: int, states: int) -> np.ndarray:
    """The states' centres, from sums over all documents of ``train(seq)``. What reaches the
    driver is as large as a profile's square, whatever the number of documents."""
    wide = 2 * FOLD + 1

    def sums(of, rows: int) -> np.ndarray:
        def run(batches):
            total = np.zeros((rows, wide))
            for group in batches_of(np.frombuffer(s, "<u2") for b in batches for s in b.column(0).to_pylist()):
                total += of(profiles(group, own))
            yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()),
                                              pa.array(list(total), pa.list_(pa.float64()))], ["row", "x"])
        cells = train.select("seq").mapInArrow(run, "row int, x array<double>").select("row", F.posexplode("x"))
        got = (cells.groupBy("row", "pos").agg(F.sum("col").alias("x")).groupBy("row")
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("x")))
        out = np.zeros((rows, wide))
        for r in got.collect():
            out[r["row"]] = r["x"]
        return out

    def moments(x: np.ndarray) -> np.ndarray:
        return np.vstack([x.T @ x, x.sum(axis=0), np.full(wide, len(x))])

    got = sums(moments, wide + 2)
    centres = first_centres(got[-1, 0], got[-2], got[:-2], states)

    def towards(x: np.ndarray) -> np.ndarray:
        near = np.eye(states)[nearest(centres, x)]               # states are few
        return np.vstack([near.T @ x, np.pad(near.sum(axis=0), (0, wide - states))])

    for _ in range(NEAREST):
        got = sums(towards, states + 1)
        n = got[-1, :states]
        centres = np.where(n[:, None] > 0, got[:-1] / np.maximum(n, 1)[:, None], centres)
    return centres


def batches_of(docs: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    held, n = [], 0
    for d in docs:
        held.append(d)
        n += len(d)
        if n >= BATCH_TOKENS:
            yield held
            held, n = [], 0
    if held:
        yield held


def maximise(got: list, cls: Classes, states: int, start: bool) -> HMM:
    exp = Expected(cls.size, states)
    for r in got:
        values = [r[f"s{k}"] for k in range(states)]
        if r["kind"] >= 0:
            exp.emit[r["kind"]] = values
        elif r["kind"] == -1:
            exp.first[:] = values
        else:
            exp.move[-2 - r["kind"]] = values
    if start:
        exp.move[:] = 1e6 * np.where(np.eye(states) > 0, STAY, (1 - STAY) / max(1, states - 1))
    emit = exp.emit + PRIOR * cls.share[:, None]
    return HMM((exp.first + 1) / (exp.first.sum() + states),
               (exp.move + 1) / (exp.move.sum(axis=1, keepdims=True) + states), emit / emit.sum(axis=0))


def baum_welch(code: DataFrame, cls: Classes, states: int = STATES, rounds: int = ROUNDS) -> HMM:
    """Train on the coded training documents."""
    train = code.filter("row IS NOT NULL AND held = false").select("seq")
    own = len(cls.frequent) + 1
    centres = place_centres(train, own, states)

    def expect(model: HMM | None):
        def run(batches):
            exp = Expected(cls.size, states)
            docs = (np.frombuffer(s, "<u2") for b in batches for s in b.column(0).to_pylist())
            for group in batches_of(docs):
                if model is None:
                    exp.assign(centres, group, own)
                else:
                    exp.add(model, group)
            yield from exp.rows()
        schema = "kind int, " + ", ".join(f"s{k} double" for k in range(states))
        summed = (train.select("seq").mapInArrow(run, schema).groupBy("kind")
                  .agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(states)]))
        return summed.orderBy("kind").collect()

    model = maximise(expect(None), cls, states, start=True)
    for _ in range(rounds):
        model = maximise(expect(model), cls, states, start=False)
    return model


# ---- operator -----------------------------------------------------------------------------

def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES,
                rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score."""
    python_tasks(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = stored(token_counts(rows), "lm-counts")
    cls = classes_of(counts)
    code = stored(coded(rows, cls), "lm-coded")
    model = baum_welch(code, cls, states, rounds)

    def run(batches):
        for b in batches:
            seqs = [np.frombuffer(s, "<u2") for s in b.column(2).to_pylist()]
            within = pa.array([float(cls.within[s].sum()) for s in seqs], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), within, pa.array(likelihood(model, seqs), pa.float64())],
                ["chunk", "row", "within", "hidden"])

    facts = code.filter("row IS NOT NULL")
    hidden = facts.select("chunk", "row", "seq").mapInArrow(run, "chunk long, row int, within double, hidden double")
    rare = stored(rare_sums(code, counts), "lm-rare")
    denominator = float(np.log10(cls.total + ALPHA * (cls.distinct + 1)))
    return (facts.select("chunk", "row", "doc_id", "held", "n_tokens", "known", "logs")
            .join(rare, ["chunk", "row"]).join(stored(hidden, "lm-hidden"), ["chunk", "row"])
            .select("doc_id", F.coalesce("held", F.lit(False)).alias("held_out"), "n_tokens",
                    (F.col("known") + F.col("rare_known")).alias("n_known"),
                    F.lit(cls.total).cast("long").alias("train_tokens"),
                    (F.col("logs") + F.col("rare_logs") - F.col("n_tokens") * F.lit(denominator)).alias("base_score"),
                    (F.col("hidden") + F.col("rare_logs") - F.col("within")).alias("score")))


def op9_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
