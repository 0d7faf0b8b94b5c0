"""Ranked lexical search with range-maximum sparse tables on posting lists.

1. One pass over the texts: a document's length and its occurrences of the
   items' terms, written; the number of documents, all their terms and the
   document frequencies are summed from that table.
2. Each task indexes its documents shard by shard.  A term's posting list holds
   the documents in ascending doc_id and the impact of each, and a sparse table
   answers the maximum of any range of the list.  An item's search is best
   first over intervals of documents: an interval's bound is the sum, over the
   item's terms, of the maximum impacts within it.  The interval of greatest
   bound is split at the document of its greatest impact; that document is
   scored in full, and the two halves get bounds of their own.  An interval
   whose bound cannot enter the ten best is dropped.
3. A task keeps an item's ten best over all its shards, and the best of the
   tasks' are ranked per item.

Items are a query set run against all documents, in blocks of at most
``BLOCK_TERMS`` terms if there are many.  Nothing that grows with the documents
passes the driver or one task: a task holds one shard.

Defined results.  Null or empty texts, and texts without a term, are no
documents; an item without terms, or none of whose terms occurs, has no rows.
Each row of the items' table is an item of its own, so that a repeated row's
results are repeated; a null item_id stays null.  Rows of documents are
documents of their own too, also where they share a doc_id; a null doc_id ranks
after all others of the same score.  Very long texts are read whole.  No items
or no documents: no rows.  Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightmart.llm.common import python_batches, written

SHARD_DOCS = 16_384
SHARD_POSTINGS = 2_000_000
BLOCK_TERMS = 200_000
SPLITS = 128  # intervals that are split at a time
_LAST = np.iinfo(np.int64).max  # a null doc_id

#: A-Z to a-z; every byte that belongs to no term becomes a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


_POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"


def _postings(vocabulary: dict[bytes, int]):
    """Length, and occurrences of the vocabulary's terms, of each document that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for batch in python_batches(batches):
            ids, lengths, held, counts = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = terms(text)
                if not words:
                    continue
                tf = Counter(words)
                found = sorted((vocabulary[t], tf[t]) for t in known & tf.keys())
                ids.append(_LAST if doc_id is None else doc_id), lengths.append(len(words))
                held.append([x for x, _ in found]), counts.append([x for _, x in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                                             names=["doc_id", "n", "terms", "counts"])

    return run


class RangeMaxima:
    """Posting lists one after another, and for each power of two the place of the greatest of so many impacts.

    ``starts`` are the lists' bounds; a range must lie within one list.  Of
    equal impacts the first place counts.  A level holds only lists that are
    long enough for it.
    """

    def __init__(self, impacts: np.ndarray, starts: np.ndarray):
        self.impacts, lengths = impacts, np.diff(starts)
        self.levels = [(starts[:-1], np.arange(len(impacts), dtype=np.int32))]
        size = 1
        while (lengths >= 2 * size).any():
            begin, places = self.levels[-1]
            keep = np.maximum(lengths - 2 * size + 1, 0)
            new = np.concatenate(([0], np.cumsum(keep)[:-1]))
            at = np.repeat(begin - new, keep) + np.arange(keep.sum())
            left, right = places[at], places[at + size]
            self.levels.append((new, np.where(impacts[left] >= impacts[right], left, right)))
            size *= 2
        self.starts = starts

    def argmax(self, lists: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Places of the maxima of [lo, hi), ranges of the given lists that are not empty."""
        out = np.zeros(len(lo), np.int64)
        level = np.frexp(hi - lo)[1] - 1  # the largest power of two within
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            begin, places = self.levels[k]
            offset = begin[lists[at]] - self.starts[lists[at]]
            left, right = places[lo[at] + offset], places[hi[at] - (1 << k) + offset]
            out[at] = np.where(self.impacts[left] >= self.impacts[right], left, right)
        return out


class Shard:
    """The posting lists of some documents, in ascending doc_id."""

    def __init__(self, doc_ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        """doc_ids ascending; postings (place in doc_ids, term, impact of weight one)."""
        order = np.lexsort((doc, term))
        self.doc_ids, self.size = doc_ids, len(doc_ids)
        self.docs, term = doc[order], term[order]
        self.terms, first = np.unique(term, return_index=True)
        self.starts = np.append(first, len(term))
        self.keys = np.searchsorted(self.terms, term) * np.int64(self.size) + self.docs
        self.maxima = RangeMaxima(impact[order], self.starts)

    def best(self, terms: np.ndarray, weights: np.ndarray, top: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """The k best (score, -doc_id) of ``top``, a heap, and this shard's documents with a score above 0."""
        lists = np.searchsorted(self.terms, terms)
        held = lists < len(self.terms)
        held[held] = self.terms[lists[held]] == terms[held]
        lists, weights = lists[held], weights[held]
        if not len(lists):
            return top
        base = lists * np.int64(self.size)
        heap: list[tuple[int, int, int, int]] = []  # (-bound, from, to, document to split at), ends inclusive

        def bounds(lo: np.ndarray, hi: np.ndarray) -> None:
            """Push the intervals, none of which is empty, with the sum of their range maxima."""
            a = np.searchsorted(self.keys, (lo[:, None] + base).ravel(), "left")
            b = np.searchsorted(self.keys, (hi[:, None] + base).ravel(), "right")
            some = np.flatnonzero(a < b)
            place = self.maxima.argmax(np.tile(lists, len(lo))[some], a[some], b[some])
            value = np.zeros(len(a), np.int64)
            value[some] = self.maxima.impacts[place] * np.tile(weights, len(lo))[some]
            where = np.zeros(len(a), np.int64)
            where[some] = self.docs[place]
            value, where = value.reshape(len(lo), -1), where.reshape(len(lo), -1)
            total = value.sum(axis=1)
            split = where[np.arange(len(lo)), value.argmax(axis=1)]
            for bound, x, y, at in zip(total.tolist(), lo.tolist(), hi.tolist(), split.tolist(), strict=True):
                if bound > 0 and enters(bound, int(self.doc_ids[x])):
                    heapq.heappush(heap, (-bound, x, y, at))

        def enters(bound: int, doc_id: int) -> bool:
            return len(top) < k or (bound, -doc_id) > top[0]

        bounds(np.array([0]), np.array([self.size - 1]))
        while heap:
            lo, hi, at = [], [], []
            while heap and len(at) < SPLITS:
                bound, x, y, d = heapq.heappop(heap)
                if not enters(-bound, int(self.doc_ids[x])):
                    continue
                at.append(d)
                if x < d:
                    lo.append(x), hi.append(d - 1)
                if d < y:
                    lo.append(d + 1), hi.append(y)
            if not at:
                continue
            wanted = (np.array(at)[:, None] + base).ravel()
            place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            scores = (np.where(self.keys[place] == wanted, self.maxima.impacts[place], 0).reshape(len(at), -1) * weights).sum(axis=1)
            for score, d in zip(scores.tolist(), at, strict=True):
                row = (score, -int(self.doc_ids[d]))
                if len(top) < k:
                    heapq.heappush(top, row)
                elif row > top[0]:
                    heapq.heapreplace(top, row)
            if lo:
                bounds(np.array(lo), np.array(hi))
        return top


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """Impact of weight one of tf occurrences in a document of n terms; whole numbers throughout."""
    m = 100 - 75 + (75 * n * documents) // all_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


_BEST = "item int, doc_id long, score long"


def _search(items: list[tuple[np.ndarray, np.ndarray]], documents: int, all_terms: int, k: int):
    """items: (term ids, weight by occurrences in the item).  The k best of a task's documents for each."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        waiting: list[pa.RecordBatch] = []
        docs = postings = 0
        for batch in python_batches(batches):
            waiting.append(batch)
            docs, postings = docs + batch.num_rows, postings + len(batch.column("terms").flatten())
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield shard(waiting)
                waiting, docs, postings = [], 0, 0
        if docs:
            yield shard(waiting)

    def shard(batches: list[pa.RecordBatch]) -> Shard:
        table = pa.Table.from_batches(batches).sort_by("doc_id").combine_chunks()
        held = table.column("terms").combine_chunks()
        sizes = np.diff(held.offsets.to_numpy())
        tf = table.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(table.num_rows), sizes)
        impact = impacts(tf, table.column("n").to_numpy()[doc], documents, all_terms)
        return Shard(table.column("doc_id").to_numpy(), doc, held.flatten().to_numpy().astype(np.int64), impact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list[list[tuple[int, int]]] = [[] for _ in items]
        for s in shards(batches):
            for i, (ids, weights) in enumerate(items):
                s.best(ids, weights, top[i], k)
        for at in range(0, len(items), 10_000):
            rows = [(i, -d, score) for i in range(at, min(len(items), at + 10_000)) for score, d in top[i] if score > 0]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)] if rows else
                                             [pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64())], names=["item", "doc_id", "score"])

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in python_batches(batches):
        found = [Counter(terms(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))],
                                         names=["item_id", "terms", "counts"])


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each row of ``items``."""
    schema = items.select(F.col("item_id")).schema["item_id"].dataType.simpleString()
    parsed = written(items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(_item_terms, f"item_id {schema}, terms array<binary>, counts array<long>"), "items")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = parsed.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    parsed = written(parsed.withColumn("item", F.monotonically_increasing_id()), "numbered")
    found = None
    for block in range(blocks):
        part = _block(texts, parsed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block), k)
        found = part if found is None else found.unionByName(part)
    return found


def _block(texts: DataFrame, parsed: DataFrame, k: int) -> DataFrame:
    """``search`` for one block of items, whose terms are broadcast to all tasks."""
    rows = parsed.orderBy("item").collect()  # about block_terms terms
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
    postings = written(texts.mapInArrow(_postings(vocabulary), _POSTINGS), "postings")
    size = postings.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("all_terms")).first()
    df = {r["term"]: r["df"] for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # one row a term of the block
    queries = []
    for r in rows:
        held = [(vocabulary[bytes(t)], c) for t, c in zip(r["terms"], r["counts"], strict=True) if vocabulary[bytes(t)] in df]
        ids = np.array([t for t, _ in held], np.int64)
        queries.append((ids, np.array([c * weight(size["documents"], df[t]) for t, c in held], np.int64)))
    best = postings.mapInArrow(_search(queries, size["documents"], size["all_terms"] or 1, k), _BEST)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    places = [(i, r["item"]) for i, r in enumerate(rows)]
    names = texts.sparkSession.createDataFrame(places, "item int, place long").join(parsed.select(F.col("item").alias("place"), "item_id"), "place").select("item", "item_id")
    return ranked.join(names, "item").select("item_id", "rank", F.when(F.col("doc_id") != _LAST, F.col("doc_id")).alias("doc_id"), "score")
