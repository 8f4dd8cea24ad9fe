"""N-gram Jaccard join by filtering under several global token orders.

A document's set holds its distinct ``width``-word shingles of the A-Z lower-cased text, as
XXH64 numbers. Two documents link when the intersection is at least ``share`` percent of
the union; classes are the connected components of the links.

Reduction. A shingle that one set alone holds can match nothing, so shingles first meet in
hash buckets: one row per (chunk of documents, bucket) moves all of them once (six bytes
each, beside what the bucket says of them), each bucket is sorted on its own, and only
shingles of two or more different sets come back, one row per (bucket, part of the sets).
Equal sets count as one, so copies neither move twice nor match each other. A set is
kept while its shared shingles can still reach the threshold.

Filtering. Under any global order of the tokens, two similar sets share a token among
their first q (a set of n tokens, r of them shared by others: q = r - need + 1, where need
is the share of n, as the unshared ones come first in every order). The orders are:

* rarest first (a rounded count, then the number itself): its prefix tokens are the keys
  under which sets meet; sizes and positions must allow the overlap;
* two orders by differently mixed numbers. Of the second, a bitmap of all tokens travels
  along: a bit of one set that the other lacks is a token it lacks, so too many of them
  leave no room for the overlap. Of the third, 16-bit marks of the first q + ``MORE``:
  similar sets share at least MORE + 1 of those (each further token of a prefix is a
  further one they must share). A pair that fails under either order is dropped.

What passes all of them is verified on the sets themselves, under the full tokens of the
other orders first, then by the size of the intersection.

Groups of near copies. First only neighbours within a key are verified, in two sortings
that bring like sets together (the key's rows are range-partitioned, so a hot key is spread). Their links are contracted; from then
on only pairs across components matter, and keys whose sets are one component drop
out. A round passes on at most ``budget`` pairs for two components that meet on a key; if
it held any back, the links found are contracted and the next round looks at these keys,
with a larger budget if there were none, until a round holds back nothing: every pair that passes the filters has
then been verified or lies within one component. Keys with many sets are dealt out by
pairs of blocks. No list, component or pair of all documents reaches the driver.

Defined cases: null and empty texts and texts without words have no shingles and link with
nothing (their component is their own id); a text with fewer words than ``width`` is one
shingle; a null id links like any other, its component is the smallest id reachable (null
if there is none); repeated rows are linked; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.llm.common import ARROW_ROWS, python_tasks, stored, table
from scorewatch.llm.components import components

WIDTH = 4
SHARE = 85                  # percent of the union
SEED = 42
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)       # odd factors: the orders beside the first
CHUNK = 1 << 21             # shingles of a chunk
BUCKET_BYTES = 24 << 20     # text bytes whose shingles make a bucket, about
RUN = 2048                  # sets of one key compared in one go
MORE = 64                   # tokens beyond a prefix whose marks travel along
SPREAD = 3                  # bits of a set's bitmap per token, at least
BUDGET = 1                  # pairs per key and two components in the first round
GROWTH = 16
NARROW = 16_384             # rows of an Arrow batch without texts


# ---- sets ---------------------------------------------------------------------------------

def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of one whole text, as sorted unsigned 64-bit numbers."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()    # bytes: ASCII only, both
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    n = len(words) - width + 1
    found = []
    for at in range(0, n, 1 << 16):                                           # bounded memory
        part = words[at:at + (1 << 16) + width - 1]
        h = {digest(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(width)))}
        found.append(np.fromiter(h, np.uint64, len(h)))
    return np.unique(np.concatenate(found))


def need_of(n: np.ndarray, share: int) -> np.ndarray:
    """Tokens of a set of n that any partner must share: ceil(share * n / 100)."""
    return -(-share * n.astype(np.int64) // 100)


def _binary(data: np.ndarray, lens: np.ndarray) -> pa.Array:
    """Rows of ``lens`` items each, as little-endian bytes."""
    offsets = np.concatenate([[0], np.cumsum(lens)]) * data.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()),
                                                          pa.py_buffer(data.tobytes())])


def _six(numbers: np.ndarray) -> np.ndarray:
    """The low six bytes of each number, as rows of a ``V6`` array."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").reshape(-1)


def _from_six(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :6] = raw.view(np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _flat(column, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(all items, items per row) of a binary column."""
    rows = column.to_pylist()
    size = np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(rows), dtype), np.array([len(r) // size for r in rows], dtype=np.int64)


PACKED = "bucket int, doc_id long, sig long, n int, sigs binary, counts binary, tokens binary"
PACKED_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _packed(cols: dict, n: int) -> pa.RecordBatch:
    names = [c.split()[0] for c in PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(n, t)
                                       for c, t in zip(names, PACKED_TYPES)], names)


def packed(docs: DataFrame, buckets: int, id_col: str, text_col: str, width: int) -> DataFrame:
    """A row per document (doc_id, sig, n; no sig without shingles) and a row per chunk and
    bucket: the sets seen (sigs), how many shingles each has there (counts), the shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held: list = []
        seen: set[int] = set()
        size = turn = 0

        def flush():
            token, sig = np.concatenate([s for _, s in held]), np.repeat(
                np.array([k for k, _ in held], dtype=np.uint64), [len(s) for _, s in held])
            bucket = (token % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")              # sets stay together within a bucket
            token, sig, bucket = (token // np.uint64(buckets))[order], sig[order], bucket[order]
            new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (bucket[1:] != bucket[:-1])])
            at = np.flatnonzero(new)
            counts = np.diff(np.concatenate([at, [len(token)]])).astype("<u4")
            which, first, sets = np.unique(bucket[at], return_index=True, return_counts=True)
            sums = np.add.reduceat(counts, first)
            yield _packed({"bucket": pa.array(which, pa.int32()), "sigs": _binary(sig[at], sets),
                           "counts": _binary(counts, sets), "tokens": _binary(_six(token), sums)}, len(which))

        for b in batches:
            ids, sigs, ns = b.column(0), [], []
            for text in b.column(1).to_pylist():
                own = shingles(text, width)
                sig = xxhash.xxh64_intdigest(own.tobytes(), SEED) if len(own) else None
                sigs.append(None if sig is None else sig - (1 << 64) * (sig >> 63))
                ns.append(len(own))
                if len(own) and sig not in seen:
                    seen.add(sig)
                    held.append((sig, own))
                    size += len(own)
                if size > CHUNK:
                    yield from flush()
                    held, size, seen = [], 0, set()
            turn += 1
            yield _packed({"bucket": pa.array((np.arange(len(ns)) + turn) % buckets, pa.int32()), "doc_id": ids,
                           "sig": pa.array(sigs, pa.int64()), "n": pa.array(ns, pa.int32())}, len(ns))
        if held:
            yield from flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PACKED)


COMMON = ("doc_id long, sig long, n int, part int, bucket int, sigs binary, counts binary, tokens binary, "
          "rounded binary")
COMMON_TYPES = [pa.int64(), pa.int64(), *[pa.int32()] * 3, *[pa.binary()] * 4]
PART_BITS = 2**31 - 1       # of a set's number, the bits that choose its part


def common(rows: DataFrame, buckets: int) -> DataFrame:
    """The document rows of ``packed``, and for every bucket and part of the sets the shingles
    that other sets hold too, with their rounded counts (eight steps per doubling)."""
    names = [c.split()[0] for c in COMMON.split(", ")]

    def made(cols: dict, n: int) -> pa.Table:
        return pa.table([cols[c] if c in cols else pa.nulls(n, t) for c, t in zip(names, COMMON_TYPES)], names=names)

    def run(t: pa.Table) -> pa.Table:
        docs = t.filter(pa.compute.is_null(t["tokens"]))
        bucket = t["bucket"][0].as_py()
        t = t.filter(pa.compute.is_valid(t["tokens"]))
        out = made({c: docs[c] for c in ("doc_id", "sig", "n")}, docs.num_rows)
        if not t.num_rows:
            return out
        token = _from_six(_flat(t["tokens"], "V6")[0])
        counts, _ = _flat(t["counts"], "<u4")
        sig = np.repeat(_flat(t["sigs"], "<u8")[0], counts)
        order = np.lexsort((sig, token))
        token, sig = token[order], sig[order]
        other = np.concatenate([[True], (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])])
        token, sig = token[other], sig[other]                    # equal sets of several chunks are one
        edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        df = np.diff(np.concatenate([edge, [len(token)]]))
        df = np.repeat(df, df)
        token, sig, df = token[df > 1], sig[df > 1], df[df > 1]
        if not len(token):
            return out
        part = ((sig & np.uint64(PART_BITS)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((sig, part))
        token, sig, df, part = token[order], sig[order], df[order], part[order]
        at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        lens = np.diff(np.concatenate([at, [len(sig)]]))
        which, first, sets = np.unique(part[at], return_index=True, return_counts=True)
        sums = np.add.reduceat(lens, first)
        rounded = np.minimum(255, np.round(8 * np.log2(df))).astype(np.uint8)
        found = made({"part": pa.array(which, pa.int32()), "bucket": pa.array([bucket] * len(which), pa.int32()),
                      "sigs": _binary(sig[at], sets), "counts": _binary(lens.astype("<u4"), sets),
                      "tokens": _binary(_six(token), sums), "rounded": _binary(rounded, sums)}, len(which))
        return pa.concat_tables([out, found])

    return rows.groupBy("bucket").applyInArrow(run, COMMON)


SETS = "sig long, n int, tokens binary"


def reduced(found: DataFrame, sets: DataFrame, buckets: int, share: int) -> DataFrame:
    """(sig, n, tokens) of the sets that can have a partner: their shared tokens, rarest first."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        name = right["sig"].to_numpy()
        place = np.argsort(name)
        sig, _ = _flat(left["sigs"], "<i8")
        counts, _ = _flat(left["counts"], "<u4")
        token, sums = _flat(left["tokens"], "V6")
        token = _from_six(token) * np.uint64(buckets) + np.repeat(left["bucket"].to_numpy().astype(np.uint64), sums)
        df = _flat(left["rounded"], "u1")[0]
        row = np.repeat(place[np.searchsorted(name, sig, sorter=place)] if len(sig) else np.zeros(0, np.int64), counts)
        order = np.lexsort((token, df, row))
        size = right["n"].to_numpy()
        r = np.bincount(row, minlength=len(name))
        keep = r >= need_of(size, share)
        return pa.table([pa.array(name[keep]), pa.array(size[keep], pa.int32()),
                         _binary(token[order][np.repeat(keep, r)], r[keep])], names=["sig", "n", "tokens"])

    rows = found.filter("part IS NOT NULL").select("part", "bucket", "sigs", "counts", "tokens", "rounded")
    part = (F.col("sig").bitwiseAND(F.lit(PART_BITS)) % buckets).cast("int")
    named = sets.select(part.alias("part"), "sig", "n")
    return rows.groupBy("part").cogroup(named.groupBy("part")).applyInArrow(run, SETS)


# ---- filters ------------------------------------------------------------------------------

def prefix_size(r: np.ndarray, n: np.ndarray, share: int) -> np.ndarray:
    return r - need_of(n, share) + 1


def mixed(token: np.ndarray, factor: int) -> np.ndarray:
    """Another order of the tokens: a one-to-one mix of their numbers."""
    x = token * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


def prefix_under(token: np.ndarray, q: int, factor: int) -> np.ndarray:
    """The first q tokens, mixed, under the order of ``factor``."""
    m = mixed(token, factor)
    return m if q >= len(m) else np.partition(m, q - 1)[:q]


def postings(sets: DataFrame, share: int) -> DataFrame:
    """(key, near0, near1, sig, n, r, pos): every prefix token of every set under the first
    order; the ``near`` columns, first tokens under the other orders, are alike for like sets."""
    def run(batches):
        for b in batches:
            sig, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            token, r = _flat(b.column(2), "<u8")
            if not len(sig):
                continue
            q = prefix_size(r, n, share)
            first = np.concatenate([[0], np.cumsum(r)[:-1]])
            near = [np.minimum.reduceat(mixed(token, f), first).view(np.int64) for f in MIX]
            pos = np.arange(len(token)) - np.repeat(first, r)
            keep = pos < np.repeat(q, r)
            row = np.repeat(np.arange(len(sig)), r)[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[keep].view(np.int64)), *(pa.array(x[row]) for x in near), pa.array(sig[row]),
                 pa.array(n[row], pa.int32()), pa.array(r[row], pa.int32()), pa.array(pos[keep], pa.int32())],
                ["key", "near0", "near1", "sig", "n", "r", "pos"])

    return sets.select("sig", "n", "tokens").mapInArrow(
        run, "key long, near0 long, near1 long, sig long, n int, r int, pos int")


def bitmap(token: np.ndarray) -> bytes:
    """The bits named by the low digits of the tokens' numbers in the second order; their
    number is a power of two, at least ``SPREAD`` a token."""
    bits = max(8, 1 << int(SPREAD * len(token) - 1).bit_length())
    flags = np.zeros(bits, dtype=np.uint8)
    flags[(mixed(token, MIX[0]) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def folded(bits: int, size: int, to: int) -> int:
    """A bitmap of ``size`` bits as one of ``to`` bits: the lower digits only."""
    while size > to:
        size //= 2
        bits = (bits | bits >> size) & ((1 << size) - 1)
    return bits


def marks(sets: DataFrame, share: int) -> DataFrame:
    """(sig, m0, m1): the bitmap of a set's tokens in the second order, and 16-bit marks of
    the first of them in the third, as many as its prefix and ``MORE``."""

    def run(batches):
        for b in batches:
            token, r = _flat(b.column(2), "<u8")
            q = prefix_size(r, b.column(1).to_numpy(), share)
            parts = np.split(token, np.cumsum(r)[:-1]) if len(r) else []
            ends = [(prefix_under(t, int(k) + MORE, MIX[1]) >> np.uint64(48)).astype("<u2").tobytes()
                    for t, k in zip(parts, q)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bitmap(t) for t in parts], pa.binary()),
                                              pa.array(ends, pa.binary())], ["sig", "m0", "m1"])

    return sets.select("sig", "n", "tokens").mapInArrow(run, "sig long, m0 binary, m1 binary")


def room(x: tuple[int, int, int], y: tuple[int, int, int]) -> int:
    """How many tokens two sets (bitmap, its size, tokens) can share at most."""
    to = min(x[1], y[1])
    a, b = folded(x[0], x[1], to), folded(y[0], y[1], to)
    return min(x[2] - (a & ~b).bit_count(), y[2] - (b & ~a).bit_count())


def similar_size(a: np.ndarray, b: np.ndarray, share: int) -> np.ndarray:
    return 100 * np.minimum(a, b).astype(np.int64) >= share * np.maximum(a, b).astype(np.int64)


def neighbours(posts: DataFrame, share: int) -> DataFrame:
    """(a, b): sets next to each other under a key, in either sorting. Blocks may cut a key
    anywhere."""
    def run(batches):
        for b in batches:
            key, sig, n = (b.column(i).to_numpy() for i in range(3))
            ok = (key[1:] == key[:-1]) & similar_size(n[1:], n[:-1], share)
            a, c = sig[1:][ok], sig[:-1][ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, c)), pa.array(np.maximum(a, c))], ["a", "b"])

    def sorting(near: str) -> DataFrame:
        order = ["key", near, "sig"]
        return (posts.select(*order, "n").repartitionByRange(*order).sortWithinPartitions(*order)
                .select("key", "sig", "n").mapInArrow(run, "a long, b long"))

    return sorting("near0").unionAll(sorting("near1")).distinct()


def _across(key, own, token, sig, comp, n, r, pos, marks0, marks1, share: int, budget: int):
    """Candidate pairs of different components within equal keys, and the tokens of which any
    was held back. Rows are sorted by key."""
    out_a, out_b, more = [], [], set()
    at, step, cache, used = np.arange(len(key)), 1, {}, {}

    def marks_of(i):
        if i not in cache:
            first = np.frombuffer(marks1[i], "<u2").tolist()
            cache[i] = (int.from_bytes(marks0[i], "little"), 8 * len(marks0[i]), int(r[i])), frozenset(first), len(first)
        return cache[i]

    def share_marks(a, b, overlap: int) -> bool:
        """Whether so many tokens can be common under both orders; marks of two tokens of a set
        may be alike."""
        (all_x, x, nx), (all_y, y, ny) = a, b
        return (room(all_x, all_y) >= overlap
                and len(x & y) + min(nx - len(x), ny - len(y)) >= min(overlap, MORE + 1))

    while len(at := at[at + step < len(key)]):
        at = at[key[at] == key[at + step]]
        x, y = at, at + step
        ok = (comp[x] != comp[y]) & own_pair(own, x, y) & similar_size(n[x], n[y], share)
        x, y = x[ok], y[ok]
        overlap = np.minimum(r[x] - pos[x], r[y] - pos[y])       # holds at the first token they share
        need = -(-share * (n[x].astype(np.int64) + n[y]) // (100 + share))
        ok = overlap >= need
        for i, j, o in zip(x[ok].tolist(), y[ok].tolist(), need[ok].tolist()):
            two = (int(key[i]), *sorted((int(comp[i]), int(comp[j]))))
            if used.get(two, 0) > budget or not share_marks(marks_of(i), marks_of(j), o):
                continue
            used[two] = used.get(two, 0) + 1
            if used[two] > budget:
                more.add(int(token[i]))
                continue
            out_a.append(min(sig[i], sig[j]))
            out_b.append(max(sig[i], sig[j]))
        step += 1
    return out_a, out_b, more


def own_pair(own: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``own`` is 0 where a key holds one block, else the sides are -1 and 1."""
    return (own[x] == 0) | (own[x] != own[y])


def across(posts: DataFrame, marked: DataFrame, comp: DataFrame, share: int, budget: int, run: int) -> DataFrame:
    """(a, b) candidates between components; rows (token, null) name the keys that held any back."""
    named = comp.select(F.col("vertex").alias("sig"), "component")
    rows = stored(posts.drop("near0", "near1").join(named, "sig", "left")
                  .withColumn("comp", F.coalesce("component", "sig")).drop("component"), "jaccard-postings")
    keys = rows.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"),
                                   F.ceil(F.count(F.lit(1)) * 2 / run).alias("m")).filter("c0 < c1").select("key", "m")
    block = rows.join(keys, "key").withColumn("block", F.pmod(F.xxhash64("sig"), "m"))
    block = block.join(marked, "sig").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), -1).otherwise(1)
    dealt = block.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"),
                         side.cast("int").alias("own"), F.col("key").alias("token"), "sig", "comp", "n", "r", "pos",
                         "m0", "m1")

    def emit(rows: list):
        t = pa.Table.from_batches(rows)
        cols = [t.column(i).to_numpy() for i in range(8)]
        a, b, more = _across(*cols, t.column(8).to_pylist(), t.column(9).to_pylist(), share, budget)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        yield pa.RecordBatch.from_arrays([pa.array(list(more), pa.int64()), pa.nulls(len(more), pa.int64())],
                                         ["a", "b"])

    def body(batches):
        held, n = [], 0
        for b in batches:
            key = b.column(0).to_numpy()
            if held and n >= 4 * run and len(key):
                last = held[-1].column(0)[-1].as_py()
                cut = int(np.searchsorted(key, last, side="right"))
                held.append(b.slice(0, cut))
                if cut < len(key):
                    yield from emit(held)
                    held, n, b = [], 0, b.slice(cut)
                else:
                    continue
            held.append(b)
            n += b.num_rows
        if n:
            yield from emit(held)

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(body, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs that link: shared prefix tokens under every order, then the intersection."""
    def run(batches):
        for b in batches:
            keep = []
            for x, n, y, m in zip(*(b.column(i).to_pylist() for i in range(2, 6))):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                ok = True
                for f in MIX:
                    p = [prefix_under(t, int(prefix_size(np.int64(len(t)), np.int64(k), share)), f)
                         for t, k in ((x, n), (y, m))]
                    ok = ok and len(np.intersect1d(*p, assume_unique=True)) > 0
                both = len(np.intersect1d(x, y, assume_unique=True)) if ok else 0
                keep.append(100 * both >= share * (n + m - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    def side(own: str, tokens: str, n: str) -> DataFrame:
        named = sets.select(F.col("sig").alias(own), F.col("tokens").alias(tokens), F.col("n").alias(n))
        return pairs.filter("b IS NOT NULL").join(named, own)

    return (side("a", "x", "nx").join(side("b", "y", "ny"), ["a", "b"]).select("a", "b", "x", "nx", "y", "ny")
            .mapInArrow(run, "a long, b long"))


# ---- operator -----------------------------------------------------------------------------

def similar_links(sets: DataFrame, share: int = SHARE, run: int = RUN, budget: int = BUDGET) -> DataFrame:
    """(vertex, component) of the sets that link with another one."""
    posts = stored(postings(sets, share), "jaccard-keys")
    first = stored(neighbours(posts, share), "jaccard-pairs")
    links = stored(verified(first, sets, share), "jaccard-links")
    marked = stored(marks(sets, share), "jaccard-marks")
    while True:
        comp = components(links)
        pairs = stored(across(posts, marked, comp, share, budget, run), "jaccard-pairs")
        found = stored(verified(pairs, sets, share), "jaccard-links")
        some = bool(found.head(1))
        if some:
            links = links.unionAll(found)
        back = pairs.filter("b IS NULL").select(F.col("a").alias("key"))
        if not back.head(1):
            return components(links) if some else comp
        posts = stored(posts.join(back, "key", "left_semi"), "jaccard-keys")
        budget *= 1 if some else GROWTH


def jaccard_classes(docs: DataFrame, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text",
                    width: int = WIDTH, run: int = RUN, budget: int = BUDGET) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    python_tasks(spark)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    found = stored(common(packed(docs, buckets, id_col, text_col, width), buckets), "jaccard-common")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(NARROW))                     # no texts from here on
    try:
        rows = found.filter("part IS NULL").select("doc_id", "sig", "n")
        sets = stored(rows.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"), F.first("n").alias("n")),
                      "jaccard-distinct")
        kept = stored(reduced(found, sets, buckets, share), "jaccard-sets")
        comp = similar_links(kept, share, run, budget)
        named = sets.join(comp.withColumnRenamed("vertex", "sig"), "sig", "left").select(
            "sig", "least", F.coalesce("component", "sig").alias("component"))
        roots = named.groupBy("component").agg(F.min("least").alias("root"))
        classes = stored(named.join(roots, "component").select("sig", "root"), "jaccard-classes")
    finally:
        spark.conf.set(key, str(ARROW_ROWS))
    return rows.join(classes, "sig", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("root")).alias("component_id"))


def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
