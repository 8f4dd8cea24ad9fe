"""Packing documents into fixed-size training sequences by dynamic programming.

Each partition's documents form one token stream in table order. Cuts are chosen
among document ends, sentence ends and, where sentences are long, every ``GRID``
tokens. The cost of a sequence is its padding plus the truncation penalty of
the cut that ends it (none at a document end) plus a fixed cost per sequence;
lengths that are a power of two need no padding. With f(j) the least cost up to
cut j,

    f(j) = pen(j) + open + min over i of  f(i) + size - (pos(j) - pos(i))

over cuts i at most ``size`` tokens back, so the minimum of f(i) + pos(i) over a
sliding window: a monotone queue gives each transition in amortised constant
time. The few unpadded transitions (exactly a power of two back) are looked up.

A block of ``BLOCK`` tokens is solved at a time and its last sequence stays open
into the next block, so memory is bounded whatever a partition holds. There is no
shuffle: documents stay in the task that reads them, ids of sequences carry the
partition's number, and a task that runs again yields the same rows. Each
partition ends in one sequence that may be padded.

Defined cases: a null or empty text is the end id alone; a null doc_id passes
through; repeated rows are packed each; longer documents span sequences; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.llm.common import python_tasks, table

SIZE = 2048                  # tokens of a sequence
END_ID = 1                   # closes each document
SENTENCE_COST = 4            # penalty of a cut at a sentence end, in tokens of padding
HARD_COST = 24               # penalty of a cut inside a sentence
OPEN_COST = 8                # cost of one more sequence
GRID = 64                    # longest stretch without a cut to choose from
BLOCK = 1 << 19              # tokens solved at a time

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def best_cuts(pos: list[int], pen: list[int], free: dict[int, list[int]], size: int) -> tuple[list[int], int]:
    """Indices of the chosen cuts (first and last included) and their cost."""
    n = len(pos)
    f, g, back = [0] * n, [0] * n, [0] * n
    g[0] = pos[0]
    queue = deque([0])
    for j in range(1, n):
        p = pos[j]
        while pos[queue[0]] < p - size:
            queue.popleft()
        i = queue[0]
        best = g[i] + size - p
        for k in free.get(j, ()):
            if f[k] < best:
                best, i = f[k], k
        f[j] = best = best + pen[j] + OPEN_COST
        back[j] = i
        best += p
        g[j] = best
        while queue and g[queue[-1]] >= best:
            queue.pop()
        queue.append(j)
    cuts, j = [n - 1], n - 1
    while j:
        j = back[j]
        cuts.append(j)
    return cuts[::-1], f[-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions that may be cut (0 and the end included) and their penalties."""
    ends = np.flatnonzero(closes[ids]) + 1
    soft = np.unique(np.concatenate([[0], doc_ends, ends]))
    gap = np.diff(soft)
    wide = np.flatnonzero(gap > GRID)
    hard = [np.arange(soft[i] + GRID, soft[i + 1], GRID) for i in wide.tolist()]
    pos = np.unique(np.concatenate([soft, *hard])) if hard else soft
    pen = np.full(len(pos), HARD_COST, dtype=np.int64)
    pen[np.searchsorted(pos, ends)] = SENTENCE_COST
    pen[np.searchsorted(pos, doc_ends)] = 0
    return pos, pen


def unpadded(pos: np.ndarray, size: int) -> dict[int, list[int]]:
    """Cut j -> cuts exactly a power of two (an eighth of ``size`` or more) back."""
    free: dict[int, list[int]] = {}
    length = 1 << max(0, (size // 8 - 1).bit_length())
    while length <= size:
        at = np.searchsorted(pos, pos - length)
        for j in np.flatnonzero(pos[at] == pos - length).tolist():
            free.setdefault(j, []).append(int(at[j]))
        length *= 2
    return free


class Packer:
    """Solves a stream of documents block by block and yields its pieces."""

    def __init__(self, closes: np.ndarray, size: int, first_id: int, block: int = BLOCK) -> None:
        self.closes, self.size, self.sequence, self.block = closes, size, first_id, block
        self.docs: list[tuple] = []               # (doc_id, tokens before in the document, ids, all tokens)
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[list[tuple]]:
        self.docs.append((doc_id, 0, ids, len(ids)))
        self.held += len(ids)
        if self.held >= self.block:
            yield self.solve(last=False)

    def solve(self, last: bool) -> list[tuple]:
        if not self.docs:
            return []
        ids = np.concatenate([d[2] for d in self.docs])
        ends = np.cumsum([len(d[2]) for d in self.docs])
        pos, pen = candidates(ids, ends, self.closes)
        cuts, _ = best_cuts(pos.tolist(), pen.tolist(), unpadded(pos, self.size), self.size)
        if not last:
            cuts.pop()                             # the last sequence stays open
        bounds = pos[cuts]
        done = int(bounds[-1])
        marks = np.unique(np.concatenate([bounds, ends[ends < done]]))
        rows = []
        doc = np.searchsorted(ends, marks[:-1], side="right").tolist()
        window = (np.searchsorted(bounds, marks[:-1], side="right") - 1).tolist()
        begins = (ends - [len(d[2]) for d in self.docs]).tolist()
        raw = ids.astype("<u4")
        for a, b, d, w in zip(marks[:-1].tolist(), marks[1:].tolist(), doc, window):
            doc_id, before, _, total = self.docs[d]
            rows.append((doc_id, before + a - begins[d], b - a, zlib.crc32(raw[a:b]), total,
                         self.sequence + w, a - int(bounds[w]), raw[a:b]))
        self.sequence += len(bounds) - 1
        left = []
        for (doc_id, before, own, total), a, b in zip(self.docs, begins, ends.tolist()):
            if b > done:
                cut = max(0, done - a)
                left.append((doc_id, before + cut, own[cut:], total))
        self.docs, self.held = left, len(ids) - done
        return rows


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True,
         block: int = BLOCK) -> DataFrame:
    """One row per piece of a document in a sequence: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids."""
    python_tasks(docs.sparkSession)

    def run(batches):
        from scorewatch.llm.tokens import byte_bpe

        bpe = byte_bpe(tokenizer_path)
        closes = np.zeros(max(max(bpe.bytes_of), end_id) + 1, dtype=bool)
        closes[[i for i, b in bpe.bytes_of.items() if b.rstrip().endswith((b".", b"!", b"?")) or b"\n" in b]] = True
        packer = Packer(closes, size, TaskContext.get().partitionId() << 33, block)

        def out(rows):
            cols = list(zip(*rows))
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in cols[7]])])
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                                       pa.array(np.concatenate(cols[7]).astype(np.int32))))
            return pa.RecordBatch.from_arrays(arrays, NAMES + ["ids"] * with_ids)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = bpe.encode(text or "")
                ids.append(end_id)
                for rows in packer.add(doc_id, np.array(ids, dtype=np.uint32)):
                    if rows:
                        yield out(rows)
        rows = packer.solve(last=True)
        if rows:
            yield out(rows)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
