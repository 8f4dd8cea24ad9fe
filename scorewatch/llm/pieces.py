"""SentencePiece encoding and decoding with a max-plus parallel scan for giant documents.

Texts of up to ``GIANT`` characters are one chunk and go to the library. Longer
ones are cut into chunks of ``CHUNK`` characters, dealt to all tasks:

1. Each chunk yields a *transfer matrix* between boundary states, in max-plus
   algebra: entry 0 if a segmentation leads from one state to the other, minus
   infinity (absent) if none does. A state at a boundary is the piece that reaches
   or crosses it and how far it crosses.
2. The matrices of a document multiply associatively: they are reduced pairwise up
   a tree and the prefixes walk back down, so the only path from the start to the
   end of the text fixes the states at every boundary.
3. Each chunk is then backtraced on its own, from its two states.

The weights reproduce byte-pair merging exactly: a sequence of pieces is what the
merges produce if and only if every two neighbours are (merging the text of a pair
gives that pair), so a step from piece to piece has weight 0 if the pair holds and
minus infinity otherwise, and exactly one path through a text is finite. Pieces
never cross from a non-space to a space marker; where a chunk has such a place,
its inside is independent of its ends, and the library encodes it.

Characters without a piece become byte pieces (or the unknown id). Decoding
reverses: the ids of a document, whole, give its text.

Defined cases: null and empty texts have no ids and decode to an empty text; a null
doc_id passes through; repeated rows are encoded each; an empty table gives no
rows; other columns are ignored. Space markers in a text decode to spaces, as in
the library.
"""

from __future__ import annotations

import zlib
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewatch.llm.common import python_tasks, stored, table

GIANT = 32_768              # characters; longer texts are scanned in chunks
CHUNK = 8_192               # characters of a chunk; far longer than any piece
MARK = "▁"             # the space marker
START = (0, "")             # the state before the text

State = tuple[int, str]     # characters beyond the boundary, the piece ("" at the start)


class Model:
    """A SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.sp
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size())
                      if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.longest = max(map(len, self.score))
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("pieces that hold a space marker after a character are not supported")
        self.merged = lru_cache(1 << 18)(self._merged)
        self.own_ids = lru_cache(1 << 16)(self._ids)

    def _merged(self, text: str) -> tuple[str, ...]:
        """Byte-pair merging of a short text: best score first, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == -np.inf:
                break
            i = -best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return tuple(parts)

    def pair(self, a: str, b: str) -> bool:
        """May piece b follow piece a?"""
        return not a or (a[-1] != MARK and b[0] == MARK) or self.merged(a + b) == (a, b)

    def starting(self, text: str, at: int) -> list[str]:
        """The pieces that start at a place of the text; a lone character always does."""
        found = [text[at]]
        for n in range(2, min(self.longest, len(text) - at) + 1):
            p = text[at:at + n]
            if p in self.score and self.merged(p) == (p,):
                found.append(p)
        return found

    def _ids(self, piece: str) -> tuple[int, ...]:
        sp = self.sp
        if piece in self.score:
            return (sp.piece_to_id(piece),)
        ids = tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in piece.encode())
        return ids if all(map(sp.is_byte, ids)) else (sp.unk_id(),)

    def encode(self, text: str) -> list[int]:
        return self.sp.encode(text, num_threads=1) if text else []

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids, num_threads=1) if ids else ""

    def normal(self, text: str) -> str:
        """The normalised text whose pieces encode() finds."""
        return self.sp.normalize(text)

    def inside(self, text: str) -> list[int]:
        """Ids of normalised text that starts and ends at a safe place: its first
        marker is the one the library puts in front."""
        return self.sp.encode(text[1:].replace(MARK, " "), num_threads=1) if len(text) > 1 else [
            *self.own_ids(MARK)]


@cache
def model(path: str) -> Model:
    return Model(path)


# ---- one chunk ----------------------------------------------------------------------------

def paths(m: Model, text: str, lo: int, hi: int, first: str) -> list[dict[str, tuple[int, str]]]:
    """reach[i]: the pieces that end at place i of a finite path from place ``lo``
    after piece ``first``, each with where it comes from. Pieces start before ``hi``."""
    reach: list[dict[str, tuple[int, str]]] = [{} for _ in range(len(text) + 1)]
    reach[lo][first] = (-1, "")
    for i in range(lo, hi):
        if reach[i]:
            nexts = m.starting(text, i)
            for last in reach[i]:
                for p in nexts:
                    if m.pair(last, p):
                        reach[i + len(p)].setdefault(p, (i, last))
    return reach


def trace(m: Model, reach, at: int, last: str) -> list[int]:
    """Ids of the path that ends in piece ``last`` at place ``at``."""
    back = []
    while reach[at][last][0] >= 0:
        back.append(last)
        at, last = reach[at][last]
    return [i for p in reversed(back) for i in m.own_ids(p)]


def safe_places(text: str, size: int) -> tuple[int, int] | None:
    """The first and last place in a chunk's own text where a space marker follows
    another character: no piece crosses it."""
    own = text[:size]
    first = next((i for i in range(1, len(own)) if own[i] == MARK and own[i - 1] != MARK), None)
    if first is None:
        return None
    last = next(i for i in range(len(own) - 1, 0, -1) if own[i] == MARK and own[i - 1] != MARK)
    return first, last


def entries(m: Model, left: str, text: str, number: int) -> list[State]:
    """States at a chunk's front: pieces of the text that reach or cross it."""
    if number == 0:
        return [START]
    both, n = left + text[:m.longest], len(left)
    return [(s + len(p) - n, p) for s in range(max(0, n - m.longest), n) for p in m.starting(both, s)
            if s + len(p) >= n]


def exits(reach, size: int, last: bool) -> list[State]:
    """States at a chunk's back: pieces that start before it and reach it."""
    stops = [size] if last else range(size, len(reach))
    return [(i - size, p) for i in stops for p, (s, _) in reach[i].items() if 0 <= s < size]


def transfer(m: Model, left: str, text: str, size: int, number: int, last: bool) -> list[tuple[State, State]]:
    """The finite entries (all 0) of a chunk's max-plus transfer matrix."""
    fronts = entries(m, left, text, number)
    safe = safe_places(text, size)
    if safe is None:
        return [(f, b) for f in fronts for b in exits(paths(m, text, f[0], size, f[1]), size, last)]
    first, final = safe
    ok = [f for f in fronts if f[0] <= first and paths(m, text[:first], f[0], first, f[1])[first]]
    backs = exits(paths(m, text, final, size, ""), size, last)
    return [(f, b) for f in ok for b in backs]


def backtrace(m: Model, text: str, size: int, front: State, back: State) -> list[int]:
    """Ids of the pieces that start in the chunk, given the states at its ends."""
    safe = safe_places(text, size)
    if safe is None:
        return trace(m, paths(m, text, front[0], size, front[1]), size + back[0], back[1])
    first, final = safe
    reach = paths(m, text[:first], front[0], first, front[1])
    head = trace(m, reach, first, next(iter(reach[first])))
    tail = trace(m, paths(m, text, final, size, ""), size + back[0], back[1])
    return head + (m.inside(text[first:final]) if final > first else []) + tail


# ---- combining chunks ---------------------------------------------------------------------

Matrix = frozenset          # of (state, state): the finite entries


def product(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product: best weight over the middle state (0 or none)."""
    onward: dict[State, list[State]] = {}
    for mid, end in b:
        onward.setdefault(mid, []).append(end)
    return frozenset((start, end) for start, mid in a for end in onward.get(mid, ()))


def boundary_states(matrices: list[Matrix]) -> list[tuple[State, State]]:
    """The states at both ends of every chunk on the one finite path."""
    levels = [matrices]
    while len(levels[-1]) > 1:                              # products of neighbours, up a tree
        row = levels[-1]
        levels.append([product(row[i], row[i + 1]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)])
    (whole,) = levels[-1]
    (ends,) = whole                                         # exactly one finite entry
    found = [ends]
    for row in reversed(levels[:-1]):                       # down: split each path at its middle
        down = []
        for i, (start, end) in enumerate(found):
            if 2 * i + 1 < len(row):
                after = {mid for mid, e in row[2 * i + 1] if e == end}
                (mid,) = {s for f, s in row[2 * i] if f == start and s in after}
                down += [(start, mid), (mid, end)]
            else:
                down.append((start, end))
        found = down
    return found


# ---- operator -----------------------------------------------------------------------------

CHUNKS = "rid long, number int, size int, last boolean, before string, body string"


def _chunks(giants: DataFrame, path: str, chunk: int) -> DataFrame:
    def run(batches):
        m = model(path)
        for b in batches:
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = m.normal(text)
                count = max(1, len(s) // chunk)
                for c in range(count):
                    lo, hi = c * chunk, (c + 1) * chunk if c + 1 < count else len(s)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], t) for v, t in ((rid, pa.int64()), (c, pa.int32()), (hi - lo, pa.int32()),
                                                       (c + 1 == count, pa.bool_()),
                                                       (s[max(0, lo - m.longest):lo], pa.string()),
                                                       (s[lo:hi + m.longest], pa.string()))],
                        [x.split()[0] for x in CHUNKS.split(", ")])

    return giants.select("rid", "text").mapInArrow(run, CHUNKS)


def _flat(pairs) -> pa.Array:
    kind = pa.struct([("f", pa.int32()), ("fp", pa.string()), ("b", pa.int32()), ("bp", pa.string())])
    return pa.array([[{"f": f, "fp": fp, "b": b, "bp": bp} for (f, fp), (b, bp) in p] for p in pairs], pa.list_(kind))


def _scan(chunks: DataFrame, path: str) -> DataFrame:
    """(rid, number, ids) of every chunk."""
    state = "struct<f:int,fp:string,b:int,bp:string>"

    def matrices(batches):
        m = model(path)
        for b in batches:
            got = [transfer(m, *a) for a in zip(*(b.column(i).to_pylist() for i in (4, 5, 2, 1, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _flat(got)], ["rid", "number", "entries"])

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("number")
        found = boundary_states([frozenset(((e["f"], e["fp"]), (e["b"], e["bp"])) for e in x) for x in pdf["entries"]])
        return pd.DataFrame({"rid": pdf["rid"], "number": pdf["number"], "f": [s[0] for s, _ in found],
                             "fp": [s[1] for s, _ in found], "b": [e[0] for _, e in found],
                             "bp": [e[1] for _, e in found]})

    def ids(batches):
        m = model(path)
        for b in batches:
            rid, number, size, text, f, fp, bk, bp = (b.column(i).to_pylist() for i in range(8))
            got = [backtrace(m, t, n, (x, xp), (y, yp)) for t, n, x, xp, y, yp in zip(text, size, f, fp, bk, bp)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.list_(pa.int32()))],
                                             ["rid", "number", "ids"])

    dealt = stored(chunks.repartition("rid", "number"), "piece-chunks")
    steps = dealt.mapInArrow(matrices, f"rid long, number int, entries array<{state}>")
    ends = stored(steps.groupBy("rid").applyInPandas(combine, "rid long, number int, f int, fp string, b int, bp string"),
                  "piece-states")
    return (dealt.join(ends, ["rid", "number"]).select("rid", "number", "size", "body", "f", "fp", "b", "bp")
            .mapInArrow(ids, "rid long, number int, ids array<int>"))


def _giants(docs: DataFrame, path: str, giant: int, chunk: int) -> DataFrame:
    """(doc_id, text, ids) of the texts longer than ``giant`` characters."""
    big = stored(docs.filter(F.length("text") > giant).withColumn("rid", F.monotonically_increasing_id()),
                 "piece-giants")
    whole = (_scan(_chunks(big, path, chunk), path).groupBy("rid")
             .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("number", "ids"))),
                                        lambda x: x["ids"])).alias("ids")))
    return big.join(whole, "rid").select("doc_id", "text", "ids")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    python_tasks(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, giant: int, chunk: int) -> DataFrame:
    """(doc_id, text, ids) of every document."""
    def run(batches):
        m = model(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([m.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))],
                ["doc_id", "text", "ids"])

    rows = _rows(docs, id_col, text_col)
    small = rows.filter(F.length("text") <= giant).mapInArrow(run, "doc_id long, text string, ids array<int>")
    return small.unionByName(_giants(rows, path, giant, chunk))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT,
           chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids) of every document, equal to the library's ids of the whole text."""
    return _encoded(docs, path, id_col, text_col, giant, chunk).select("doc_id", "ids")


def _decoded(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` (its column ``ids``) with the decoded text and the CRC-32 of the ids
    (little-endian unsigned 32-bit) as ``decoded`` and ``ids_crc32``."""
    names = [*tokens.columns, "decoded", "ids_crc32"]
    at = tokens.columns.index("ids")

    def run(batches):
        m = model(path)
        for b in batches:
            flat, edge = b.column(at).values.to_numpy(), b.column(at).offsets.to_numpy()
            ids = [flat[i:j] for i, j in zip(edge, edge[1:])]            # of a null: none
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([m.decode(x.tolist()) for x in ids], pa.string()), pa.array(crc, pa.int64())],
                names)

    python_tasks(tokens.sparkSession)
    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField("decoded", T.StringType()),
                                                T.StructField("ids_crc32", T.LongType())]))


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row of ids; null ids count as none, in a row as well."""
    rows = tokens.select(F.col(id_col).cast("long").alias("doc_id"),
                         F.array_compact(F.col(ids_col).cast("array<int>")).alias("ids"))
    return _decoded(rows, path).select("doc_id", F.col("decoded").alias("text"))


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT,
                chunk: int = CHUNK) -> DataFrame:
    """Encode every document and decode its ids: doc_id, n_tokens, ids, their CRC-32, the
    decoded text's CRC-32, and whether the decoded text is the text."""
    back = _decoded(_encoded(docs, path, id_col, text_col, giant, chunk), path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "ids_crc32",
                       F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
                       (F.col("decoded") == F.col("text")).alias("round_trip"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
