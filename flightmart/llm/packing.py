"""Hierarchical multi-length packing of documents into training sequences.

A document's ids fill whole windows of the largest context size first; the
remainder is routed to the smallest tier (context size) that holds it.  Each
tier is packed from the largest down: a remainder opens a window of its tier,
and the gap is filled best-fit from the shorter tiers' remainders, the last
bit by cutting one.  What is left at the end of a task is closed by windows of
powers of two, so no position is padded.  The windows of a block are dealt to
step groups of nearly equal numbers of tokens.

The work is one pass over the input without a shuffle: each task packs the
documents of its own partition, in blocks of bounded size, so memory does not
grow with the table and a lost executor costs its running tasks only.

Defined results.  Null or empty text: the end id alone.  Null doc_id: packed
like any other.  Repeated rows: each is packed.  Empty table: no rows.  Very
long texts: encoded whole, cut at windows.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flightmart.llm.common import python_batches, text_of
from flightmart.llm.tokens import encoder, slices

#: Context sizes, powers of two; the last is the longest window.
TIERS = (256, 512, 1024, 2048)

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
    T.StructField("tier", T.LongType()),
    T.StructField("step_group", T.LongType()),
])


class _Packer:
    """Packs blocks of documents.  A piece is (document's number in the block, start, length)."""

    def __init__(self, tiers: tuple[int, ...], group_tokens: int):
        self.tiers, self.group_tokens = sorted(tiers), group_tokens
        self.longest = self.tiers[-1]

    def pack(self, sizes: list[int], last: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
        """Full windows, and the pieces that fill none; with ``last`` those too are put into windows."""
        windows: list[list[tuple[int, int, int]]] = []
        pool: list[tuple[int, int, int]] = []  # (length, document, start) of remainders, ascending
        for doc, size in enumerate(sizes):
            whole = size - size % self.longest
            windows += [[(doc, at, self.longest)] for at in range(0, whole, self.longest)]
            if size > whole:
                pool.append((size - whole, doc, whole))
        pool.sort()
        rest: list[tuple[int, int, int]] = []
        while pool:
            length, doc, start = pool.pop()
            tier = next(t for t in self.tiers if t >= length)
            window, gap = [(doc, start, length)], tier - length
            while gap and pool:
                at = bisect_right(pool, (gap, len(sizes), 0)) - 1
                if at >= 0:
                    n, d, s = pool.pop(at)
                else:  # the shortest is longer than the gap: cut it
                    n, d, s = pool.pop(0)
                    insort(pool, (n - gap, d, s + gap))
                    n = gap
                window.append((d, s, n))
                gap -= n
            if gap:
                rest = window
            else:
                windows.append(window)
        if last and rest:
            windows += self._powers(rest)
            rest = []
        return windows, rest

    @staticmethod
    def _powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
        """Windows of powers of two, the longest first, that hold the pieces without padding."""
        windows, left = [], sum(n for _, _, n in pieces)
        pieces = pieces[::-1]
        while left:
            size = gap = 1 << (left.bit_length() - 1)
            window = []
            while gap:
                doc, start, n = pieces.pop()
                if n > gap:
                    pieces.append((doc, start + gap, n - gap))
                    n = gap
                window.append((doc, start, n))
                gap -= n
            windows.append(window)
            left -= size
        return windows

    def groups(self, windows: list[list[tuple[int, int, int]]]) -> list[int]:
        """The step group of each window: the longest first, each to the group with the fewest tokens so far."""
        sizes = [sum(n for _, _, n in w) for w in windows]
        heap = [(0, g) for g in range(max(1, round(sum(sizes) / self.group_tokens)))]
        out = [0] * len(windows)
        for i in sorted(range(len(windows)), key=lambda i: (-sizes[i], i)):
            load, group = heap[0]
            out[i] = group
            heapq.heapreplace(heap, (load + sizes[i], group))
        return out


def _pack_partition(path: str, end_id: int, tiers: tuple[int, ...], group_tokens: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, packer = encoder(path), _Packer(tiers, group_tokens)
        base = TaskContext.get().partitionId() << 36  # each task numbers its sequences and groups itself
        made = grouped = 0
        docs: list[tuple[int | None, np.ndarray, int, int]] = []  # doc_id, ids, number of ids before them, of all

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal made, grouped, docs
            windows, rest = packer.pack([len(x[1]) for x in docs], last)
            group = packer.groups(windows)
            cols: list[list] = [[] for _ in SCHEMA.fields]
            for k, window in enumerate(windows):
                offset, tier = 0, sum(n for _, _, n in window)
                for d, start, n in window:
                    doc_id, ids, before, total = docs[d]
                    row = (doc_id, before + start, n, ids[start:start + n].tobytes(), total, base + made + k, offset, tier, base + grouped + group[k])
                    for col, value in zip(cols, row, strict=True):
                        col.append(value)
                    offset += n
            made += len(windows)
            grouped += max(group, default=-1) + 1
            docs = [(docs[d][0], docs[d][1][s:s + n], docs[d][2] + s, docs[d][3]) for d, s, n in rest]
            kinds = [pa.binary() if f.name == "ids" else pa.int64() for f in SCHEMA.fields]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=SCHEMA.names)

        held = 0
        for batch in python_batches(batches):
            doc_ids, texts = (batch.column(n).to_pylist() for n in ("doc_id", "text"))
            for a, b in slices(texts):
                ids, sizes = code.encode(texts[a:b], end_id)
                ids = ids.astype("<u4", copy=False)
                for doc_id, part in zip(doc_ids[a:b], np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                    docs.append((doc_id, part, 0, len(part)))
                held += len(ids)
                if held >= block_tokens:
                    yield flush(False)
                    held = sum(len(x[1]) for x in docs)
        if docs:
            yield flush(True)

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS,
         group_tokens: int = 64 * 2048, block_tokens: int = 2_000_000) -> DataFrame:
    """One row per piece of a document, with its ids (little-endian unsigned 32 bits) and its place.

    ``tier`` is the length of the piece's sequence.  ``step_group`` tells which
    sequences make one training step of about ``group_tokens`` tokens.
    """
    if any(t & (t - 1) or t < 1 for t in tiers):
        raise ValueError("tiers are powers of two")
    return text_of(docs).mapInArrow(_pack_partition(tokenizer_path, end_id, tuple(tiers), group_tokens, block_tokens), SCHEMA)
