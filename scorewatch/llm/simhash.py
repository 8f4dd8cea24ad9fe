"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints: ``width``-word shingles of the A-Z lower-cased text, repeats
included, XXH64 with seed 42 each; a fingerprint bit is 1 if set in over half of
them. Two texts are linked if their 64-bit fingerprints differ in at most three
bits; classes are the connected components.

Finding the links: a fingerprint is cut into three segments (21, 21 and 22
bits). Three errors over three segments leave (pigeonhole)

* a segment without an error and another with at most one, or
* exactly one error in every segment.

A segment with at most one error is matched through the perfect binary Golay code
[23, 12, 7]: it is padded to 23 bits and *decoded* to the indices of all
codewords within distance four - one codeword, or six of them when the nearest
lies at distance three. If x and y differ in one bit at most, the nearest codeword
of x is within distance four of y, so x stores its nearest index and y probes
all of its own. One error changes a segment's parity, so the parity says who does
which: even segments store, odd ones probe (equal segments do the same and meet).
Keys are (error-free segment, index of another segment), six tables of 33 and 34
bits, and for one error in every segment (index of the first, index of the second,
one half of the third, the two sums of neighbouring parities), two tables of 37 bits:
the third segment's error leaves one of its halves alone, and three changed
parities leave their sums. Rows that meet on a key are verified by counting
differing bits of the whole fingerprints.

Scale: only distinct fingerprints enter, so copies cost nothing. Rows go to tasks
by key and are compared run by run in vectorised steps; a task passes on a
spanning forest of the links it found, at most one edge per row, never all
pairs. A key with more than ``RUN`` fingerprints is not compared there: its
rows are passed on and dealt out anew by (key, block, block), so every pair of
blocks meets in a task of bounded size and no link is lost. Components are
contracted as tables; nothing is collected to the driver.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero and is linked like any other; shorter texts are one shingle;
a null id sorts last and forms links like any other row, its component is the
smallest id reachable (null if there is none); repeated rows share a fingerprint; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.llm.common import fresh_name, python_tasks, stored, table
from scorewatch.llm.components import components

WIDTH = 3                   # words per shingle
MAX_BITS = 3                # differing bits of a link; the keys are made for three
SEED = 42
SEGMENTS = ((0, 21), (21, 21), (42, 22))        # first bit, bits
RUN = 2048                  # fingerprints of one key compared in one go
POLY = 0b101011100011       # fixed value: generator polynomial of the Golay code


# ---- fingerprints -------------------------------------------------------------------------

def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64-bit fingerprint of one text, as an unsigned integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()   # bytes: ASCII only, both
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(b" ".join(words), SEED)
    ones = np.zeros(64, dtype=np.int64)
    n = len(words) - width + 1
    for at in range(0, n, 1 << 16):                                          # bounded memory
        part = words[at:at + (1 << 16) + width - 1]
        h = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(width)))),
                        dtype="<u8", count=len(part) - width + 1)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): one row per document, fp as a signed long."""
    python_tasks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


# ---- Golay code ---------------------------------------------------------------------------

def _remainder(words: np.ndarray) -> np.ndarray:
    """Syndromes: remainders of 23-bit words modulo the generator polynomial."""
    w = words.astype(np.int64)
    for bit in range(22, 10, -1):
        w = np.where(w >> bit & 1, w ^ (POLY << (bit - 11)), w)
    return w


class Golay:
    """Error patterns by syndrome: column 0 leads to the nearest codeword, the rest
    to the others within distance four (-1: none)."""

    def __init__(self) -> None:
        self.patterns = np.full((2048, 6), -1, dtype=np.int64)
        filled = np.zeros(2048, dtype=np.int64)
        for weight in range(5):
            errors = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)])
            for e, s in zip(errors, _remainder(errors), strict=True):
                if weight < 4 or (first := int(self.patterns[s, 0])).bit_count() == 3:
                    self.patterns[s, filled[s]] = e
                    filled[s] += 1
        low = np.arange(1 << 12)
        self.low, self.high = _remainder(low), _remainder(np.arange(1 << 11) << 12)

    def indices(self, words: np.ndarray) -> np.ndarray:
        """(len(words), 6) codeword indices, the nearest first, -1 for none."""
        w = words.astype(np.int64)
        errors = self.patterns[self.low[w & 4095] ^ self.high[w >> 12]]
        return np.where(errors < 0, -1, (w[:, None] ^ errors) >> 11)         # systematic: top 12 bits


def keys_of(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of every fingerprint; keys are unsigned 64-bit."""
    seg = [(fps >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in SEGMENTS]
    index = [golay.indices(s) for s in seg]
    parity = [np.bitwise_count(s) & np.uint8(1) for s in seg]
    rows, keys = [], []
    everyone = np.arange(len(fps))
    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                for c in range(6):
                    ok = index[j][:, c] >= 0
                    if c:                                    # even segments store the nearest only
                        ok &= parity[j] == 1
                    rows.append(everyone[ok])
                    keys.append(np.uint64(tag << 40) | (seg[i][ok] << np.uint64(12))
                                | index[j][ok, c].astype(np.uint64))
                tag += 1
    sums = ((parity[0] ^ parity[1]) << 1 | parity[1] ^ parity[2]).astype(np.uint64)
    halves = (seg[2] & np.uint64(2047), seg[2] >> np.uint64(11))
    for half in halves:
        rest = half << np.uint64(2) | sums
        for c in range(6):
            for d in range(6):
                ok = (index[0][:, c] >= 0) & (index[1][:, d] >= 0)
                if c or d:
                    ok &= parity[0] == 1
                rows.append(everyone[ok])
                keys.append(np.uint64(tag << 40) | (index[0][ok, c].astype(np.uint64) << np.uint64(25))
                            | (index[1][ok, d].astype(np.uint64) << np.uint64(13)) | rest[ok])
        tag += 1
    return np.concatenate(rows), np.concatenate(keys)


# ---- links --------------------------------------------------------------------------------

def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a, b)."""
    if not len(a):
        return a, b
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    pairs = np.unique(np.stack([flat[:len(a)], flat[len(a):]], axis=1), axis=0)
    parent = list(range(len(names)))
    keep = []
    for i, (u, v) in enumerate(pairs.tolist()):
        while parent[u] != u:
            parent[u] = u = parent[parent[u]]
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        if u != v:
            parent[max(u, v)] = min(u, v)
            keep.append(i)
    return names[pairs[keep, 0]], names[pairs[keep, 1]]


def _links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between rows of equal key, as a forest; rows sorted by key."""
    out_a, out_b = [], []
    at = np.arange(len(key))
    step = 1
    while len(at := at[at + step < len(key)]):
        at = at[key[at] == key[at + step]]
        hit = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= bits]
        out_a.append(rep[hit])
        out_b.append(rep[hit + step])
        step += 1
        if sum(map(len, out_a)) > 1 << 20:
            fa, fb = _forest(np.concatenate(out_a), np.concatenate(out_b))
            out_a, out_b = [fa], [fb]
    empty = np.zeros(0, dtype=np.int64)
    return _forest(np.concatenate([empty, *out_a]), np.concatenate([empty, *out_b]))


EDGES = "a long, b long, key long, fp long"      # a link (key null) or a row of a hot key (b null)


def _compare(bits: int, run: int):
    """mapInArrow body over rows (key, fp, rep) sorted by key."""
    def emit(a, b, key, fp):
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64()),
             pa.nulls(n, pa.int64()) if key is None else pa.array(key, pa.int64()),
             pa.nulls(n, pa.int64()) if fp is None else pa.array(fp, pa.int64())], ["a", "b", "key", "fp"])

    def split(key, fp, rep):
        """Links of the whole runs, rows of the runs that are too long."""
        edge = np.flatnonzero(np.diff(key)) + 1
        lens = np.diff(np.concatenate([[0], edge, [len(key)]]))
        hot = np.repeat(lens > run, lens)
        if hot.any():
            yield emit(rep[hot], None, key[hot], fp[hot].view(np.int64))
        a, b = _links(key[~hot], fp[~hot], rep[~hot], bits)
        if len(a):
            yield emit(a, b, None, None)

    def body(batches):
        held: list = []
        n = 0
        spilled = None                                   # a hot key whose rows already left
        for batch in batches:
            key, fp, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            held.append((key, fp.view(np.uint64), rep))
            n += len(key)
            if n < 1 << 17:
                continue
            key, fp, rep = (np.concatenate(x) for x in zip(*held, strict=True))
            if spilled is not None and (own := key == spilled).any():
                yield emit(rep[own], None, key[own], fp[own].view(np.int64))
                key, fp, rep = key[~own], fp[~own], rep[~own]
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if cut:
                yield from split(key[:cut], fp[:cut], rep[:cut])
            if len(key) - cut > run:                     # the last key is hot already
                spilled = key[-1]
                yield emit(rep[cut:], None, key[cut:], fp[cut:].view(np.int64))
                cut = len(key)
            held, n = [(key[cut:], fp[cut:], rep[cut:])], len(key) - cut
        if n:
            key, fp, rep = (np.concatenate(x) for x in zip(*held, strict=True))
            if spilled is not None and (own := key == spilled).any():
                yield emit(rep[own], None, key[own], fp[own].view(np.int64))
                key, fp, rep = key[~own], fp[~own], rep[~own]
            if len(key):
                yield from split(key, fp, rep)
    return body


def _meet(rows: DataFrame, bits: int, run: int, *by: str) -> DataFrame:
    """Compare the rows (key, fp, rep) that share a key."""
    return (rows.repartition(*by).sortWithinPartitions("key").select("key", "fp", "rep")
            .mapInArrow(_compare(bits, run), EDGES))


def links(reps: DataFrame, bits: int = MAX_BITS, run: int = RUN) -> DataFrame:
    """(a, b) edges whose components are those of all links between the distinct
    fingerprints of ``reps(fp, rep)``; ``rep`` names a fingerprint."""
    if bits > MAX_BITS:
        raise ValueError(f"the keys find links of up to {MAX_BITS} bits")

    def expand(batches):
        golay = Golay()
        for b in batches:
            fp, rep = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for at in range(0, len(fp), 2048):
                row, key = keys_of(fp[at:at + 2048].view(np.uint64), golay)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(fp[at:at + 2048][row]),
                     pa.array(rep[at:at + 2048][row])], ["key", "fp", "rep"])

    keyed = reps.select("fp", "rep").mapInArrow(expand, "key long, fp long, rep long")
    found = stored(_meet(keyed, bits, run, "key"), "simhash-links")
    near = found.filter("b IS NOT NULL").select("a", "b")
    hot = found.filter("b IS NULL").select("key", "fp", F.col("a").alias("rep"))
    if not hot.head(1):
        return near
    # hot keys: blocks of about run / 4 rows, every pair of blocks in a task of its own
    sizes = hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) * 4 / run).alias("m"))
    block = hot.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("fp"), "m"))
    other = F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("other")
    pairs = block.select("key", "fp", "rep", "own", other).select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp", "rep")
    # two blocks stay below 2 ** 31 rows, so nothing is hot any more
    again = stored(_meet(pairs, bits, 2**31, "key"), "simhash-hot-links")
    return near.unionByName(again.select("a", "b"))


# ---- operator -----------------------------------------------------------------------------

def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = WIDTH, bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed long), component_id."""
    rows = stored(fingerprints(docs, id_col, text_col, width), "simhash-rows")
    reps = stored(rows.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(2**63 - 1)).alias("least")),
                  "simhash-distinct")
    # a fingerprint is named by its smallest doc_id; names order like ids and are made
    # unique by ranking (least, fp), so that equal ids on two texts stay two vertices
    named = stored(reps.repartitionByRange("least", "fp").sortWithinPartitions("least", "fp")
                   .withColumn("rep", F.monotonically_increasing_id()), "simhash-names")
    comp = components(links(named, bits))
    roots = named.select(F.col("rep").alias("component"), F.col("least").alias("root"))
    classes = stored(named.join(comp.withColumnRenamed("vertex", "rep"), "rep", "left")
                     .select("fp", F.coalesce("component", "rep").alias("component"))
                     .join(roots, "component").select("fp", "root"), "simhash-classes")
    return rows.join(classes, "fp").select(
        "doc_id", "fp", F.when(F.col("root") < 2**63 - 1, F.col("root")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
             bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the one with the smallest
    id (null ids last, then table order). All columns kept."""
    rid = fresh_name(docs, "rid")
    rows = stored(docs.withColumn(rid, F.monotonically_increasing_id()), "simhash-docs")
    classes = near_duplicates(rows, rid, text_col, width, bits).select(F.col("doc_id").alias("rid"), "component_id")
    ids = rows.select(F.col(rid).alias("rid"), F.col(id_col).alias("id"))
    own = stored(classes.join(ids, "rid").select(
        "component_id", F.struct(F.col("id").isNull().alias("no_id"), "id", "rid").alias("place")), "simhash-places")
    best = stored(own.groupBy("component_id").agg(F.min("place").alias("best"), F.count(F.lit(1)).alias("n"))
                  .filter("n > 1").drop("n"), "simhash-kept")
    gone = own.join(best, "component_id").filter("place.rid <> best.rid").select(F.col("place.rid").alias(rid))
    return rows.join(gone, rid, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def op5_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
