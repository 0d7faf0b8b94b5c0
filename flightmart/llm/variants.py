"""Spelling variants by a frequency-vector trie.

Letters are dealt to ``GROUPS`` groups; a word's vector counts its letters in
each group.  The vectors form a trie: one level for each group, one child for
each count.  One inserted, deleted or replaced letter changes the vector by at
most one surplus and one deficit, so a word's near words are found by a
depth-first search from the root that may spend a surplus of one and a deficit
of one; the words at the leaves it reaches are verified letter by letter.

The trie is spread over tasks.  Its top is unfolded level by level, with counts
taken in Spark, until no node holds more than ``node_words`` words; each such
node is one task's subtrie.  A word searches the top for the subtries that its
budgets reach and is sent there.  As nearness goes both ways, it is sent only
to subtries that do not precede its own, and each pair is found once.  Within a
task the search takes all words at once: each node of the subtrie keeps the
words that still have budget, so a node is visited once and not once a word.

Counts above 15 are taken as 15, which only lets more words reach a leaf.  A
node of full depth with too many words (anagrams, or words with more than 15 of
several groups) is dealt to blocks, and its searchers visit all of them.

Defined results.  Null or empty texts have no words; a null doc_id is written
as the empty string where occurrences are hashed.  Repeated rows count again.
Very long texts are read whole; a word may be as long as its text.  No words,
or an empty table: no rows.  Equal counts: the word smallest in code-point
order is the form.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightmart.llm.common import python_batches, written

GROUPS = 15
NODE_WORDS = 20_000
MAX_NODES = 50_000  # nodes of a level that are unfolded further
_TOP = 15  # counts above are taken as this
_LEAF = 16  # a node with so few words is a leaf
_WIDTH = 48  # letters compared as a matrix; pairs with a longer word are compared one by one
_PAIRS = 100_000  # pairs verified at a time

_WORDS = "word string, n long"


def _word_counts(min_length: int, drop_mod: int):
    """Occurrences of words, summed within a batch; from some runs a letter is deleted, as (doc_id, run) says."""
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % min_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def emit() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in counts], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in python_batches(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                own: dict[bytes, int] = {}
                for w in runs.findall(text):
                    w = w.encode("latin-1").lower()  # bytes: A-Z alone
                    own[w] = own.get(w, 0) + 1
                start = zlib.crc32((f"{doc_id}:" if doc_id is not None else ":").encode())
                for w, n in own.items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % drop_mod == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1:]
                        if len(w) < min_length:
                            continue
                    counts[w] = counts.get(w, 0) + n
            if len(counts) > 300_000:
                yield emit()
                counts.clear()
        if counts:
            yield emit()

    return run


def word_counts(docs: DataFrame, min_length: int = 7, min_count: int = 2, drop_mod: int = 31) -> DataFrame:
    """(word, n) of all words of at least ``min_length`` letters with at least ``min_count`` occurrences."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_word_counts(min_length, drop_mod), _WORDS).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All letters of the words one after another, and the words' lengths."""
    words = [w.encode("latin-1") for w in column.to_pylist()]
    return np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for batch in batches:
        total += np.bincount(_codes(batch.column("word"))[0], minlength=256)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["letter", "n"])


def letter_groups(words: DataFrame) -> np.ndarray:
    """The group of each letter: the commonest have one of their own, first in the trie; the rest are folded back."""
    counts = words.select("word").mapInArrow(_letters, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()  # 256 rows at most
    group = np.zeros(256, np.uint8)
    for rank, row in enumerate(sorted(counts, key=lambda r: (-r["n"], r["letter"]))):
        group[row["letter"]] = rank if rank < GROUPS else GROUPS - 1 - rank % GROUPS
    return group


def vectors(codes: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Frequency vectors, four bits a group, the first group in the highest bits."""
    word = np.repeat(np.arange(len(lengths)), lengths)
    counts = np.bincount(word * GROUPS + group[codes], minlength=len(lengths) * GROUPS).reshape(-1, GROUPS)
    counts = np.minimum(counts, _TOP).astype(np.int64)
    return (counts << (4 * np.arange(GROUPS - 1, -1, -1, dtype=np.int64))).sum(axis=1)


def _with_vectors(group: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = vectors(*_codes(batch.column("word")), group) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(vec, pa.int64())], names=["word", "n", "vec"])

    return run


def _shift(depth: int) -> int:
    return 4 * (GROUPS - depth)


def top_nodes(words: DataFrame, node_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(path, depth, words) of the nodes that become subtries, in the order of their paths.

    A node with more words is unfolded, one level for all in one aggregate.
    There are at most words / node_words such nodes in a level, and each has
    at most 16 children; this is what the driver holds.
    """
    done: list[tuple[int, int, int]] = []
    split = [0]
    for depth in range(1, GROUPS + 1):
        path = F.shiftright("vec", _shift(depth))
        parents = words.sparkSession.createDataFrame([(x,) for x in split], "parent long")
        found = (words.select(path.alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
                 .join(F.broadcast(parents), F.shiftright("path", 4) == F.col("parent")).select("path", "n").collect())  # see above for its bound
        split = [r["path"] for r in found if r["n"] > node_words and depth < GROUPS]
        keep = set(split)
        done += [(r["path"] << _shift(depth), depth, r["n"]) for r in found if r["path"] not in keep]
        if not split:
            break
    done.sort()
    return tuple(np.array([x[k] for x in done], np.int64) for k in range(3))


def search(keys: np.ndarray, ends: np.ndarray, leaf: int, queries: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Depth-first search of the trie of sorted ``keys`` for all queries at once: (from, to, queries that reach that leaf).

    ``ends``: the depth at which a key ends; a node with at most ``leaf`` keys
    is not unfolded further.  At each node a query that has spent more than a
    surplus of one and a deficit of one is dropped.
    """
    zero = np.zeros(len(queries), np.int8)
    stack = [(0, len(keys), 0, np.arange(len(queries)), zero, zero)] if len(keys) else []
    while stack:
        lo, hi, depth, alive, surplus, deficit = stack.pop()
        if depth == ends[lo] or hi - lo <= leaf:
            yield lo, hi, alive
            continue
        shift = np.int64(_shift(depth + 1))
        counts = keys[lo:hi] >> shift & 15
        mine = queries[alive] >> shift & 15
        cuts = np.concatenate(([0], np.flatnonzero(counts[1:] != counts[:-1]) + 1, [hi - lo]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            more = counts[a] - mine
            s, d = surplus + np.maximum(more, 0), deficit + np.maximum(-more, 0)
            fits = np.flatnonzero((s <= 1) & (d <= 1))
            if len(fits):
                stack.append((lo + a, lo + b, depth + 1, alive[fits], s[fits].astype(np.int8), d[fits].astype(np.int8)))


def _reached(paths: np.ndarray, depths: np.ndarray, blocks: np.ndarray):
    """Sends each word to the subtries (node, block) that it reaches and that do not precede its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("vec").to_numpy()
            words = batch.column("word")
            spread = np.fromiter((zlib.crc32(w.encode()) for w in words.to_pylist()), np.int64, batch.num_rows)
            own = np.searchsorted(paths, vec, side="right") - 1
            own_block = spread % blocks[own] if len(own) else own
            rows, nodes, parts = [], [], []
            for node, _, alive in search(paths, depths, 0, vec):
                alive = alive[own[alive] <= node]
                for block in range(int(blocks[node])):
                    here = alive if blocks[node] == 1 else alive[(own[alive] < node) | (own_block[alive] <= block)]
                    rows.append(here), nodes.append(np.full(len(here), node)), parts.append(np.full(len(here), block))
            if not rows:
                continue
            row, node, part = np.concatenate(rows), np.concatenate(nodes), np.concatenate(parts)
            for at in range(0, len(row), 50_000):
                r, t, p = row[at:at + 50_000], node[at:at + 50_000], part[at:at + 50_000]
                resident = (own[r] == t) & (own_block[r] == p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t, pa.int64()), pa.array(p, pa.int64()), pa.array(resident), words.take(pa.array(r)), batch.column("n").take(pa.array(r)), pa.array(vec[r], pa.int64())],
                    names=["node", "block", "resident", "word", "n", "vec"])

    return run


def near(x: bytes, y: bytes) -> bool:
    """Do the words differ by exactly one inserted, deleted or replaced letter?"""
    if abs(len(x) - len(y)) > 1 or x == y:
        return False
    at = next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    return x[at + (len(x) >= len(y)):] == y[at + (len(y) >= len(x)):]


def _verified(codes: np.ndarray, lengths: np.ndarray, words: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``near`` for pairs of rows of a matrix of letters, padded with zeros."""
    ok = np.zeros(len(a), bool)
    gap = lengths[a] - lengths[b]
    close = np.abs(gap) <= 1
    short = close & (np.maximum(lengths[a], lengths[b]) < _WIDTH)
    same = np.flatnonzero(short & (gap == 0))
    ok[same] = (codes[a[same]] != codes[b[same]]).sum(axis=1) == 1
    other = np.flatnonzero(short & (gap != 0))
    if len(other):
        swap = gap[other] < 0
        long, less = codes[np.where(swap, b[other], a[other])], codes[np.where(swap, a[other], b[other])]
        first = (long != less).argmax(axis=1)  # the longer word's own letter, at the latest its last
        rest = np.logical_and.accumulate((long[:, 1:] == less[:, :-1])[:, ::-1], axis=1)[:, ::-1]
        ok[other] = rest[np.arange(len(other)), first]
    for k in np.flatnonzero(close & ~short).tolist():
        ok[k] = near(words[a[k]], words[b[k]])
    return ok


def near_pairs(words: list[bytes], vec: np.ndarray, resident: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs (searcher, resident) of rows; of two residents the earlier row is the searcher."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.zeros((len(words), _WIDTH), np.uint8)
    for i, w in enumerate(words):
        if len(w) < _WIDTH:
            codes[i, :len(w)] = np.frombuffer(w, np.uint8)
    here = np.flatnonzero(resident)
    here = here[np.argsort(vec[here], kind="stable")]
    keys, ends = vec[here], np.full(len(here), GROUPS)
    found_a, found_b, waiting, size = [], [], [], 0

    def verify() -> None:
        a, b = (np.concatenate(x) for x in zip(*waiting, strict=True))
        ok = _verified(codes, lengths, words, a, b)
        found_a.append(a[ok]), found_b.append(b[ok])
        waiting.clear()

    for lo, hi, alive in search(keys, ends, _LEAF, vec):
        step = max(1, _PAIRS // max(1, len(alive)))
        for at in range(lo, hi, step):  # a leaf of anagrams may hold many words
            residents = here[at:min(hi, at + step)]
            for part in range(0, len(alive), _PAIRS):
                searchers = alive[part:part + _PAIRS]
                a, b = np.repeat(searchers, len(residents)), np.tile(residents, len(searchers))
                once = ~resident[a] | (a < b)
                waiting.append((a[once], b[once]))
                size += int(once.sum())
                if size > _PAIRS:
                    verify()
                    size = 0
    if waiting:
        verify()
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


_NEAR = "word string, other string, other_n long"


def _pairs_of_subtrie(table: pa.Table) -> pa.Table:
    """Both directions of each near pair of a subtrie."""
    words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    a, b = near_pairs(words, table.column("vec").to_numpy(), table.column("resident").to_numpy(zero_copy_only=False))
    x, y = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
    word, n = table.column("word").combine_chunks(), table.column("n").combine_chunks()
    return pa.table({"word": word.take(x), "other": word.take(y), "other_n": n.take(y)})


def _roots(words: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: pointers are doubled until each one leads to a word without a form.

    A form has at least ten times its word's count, so a chain is no longer
    than the number of digits of the largest count, and a few rounds do.
    """
    known = words.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    digits = len(str(words.agg(F.max("n")).first()[0] or 1))
    for _ in range(max(1, digits - 1).bit_length()):
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = written(known.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return known


def variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, factor: int = 10, drop_mod: int = 31,
             node_words: int = NODE_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words.

    form: the near word of largest count, if that is at least ``factor`` times
    the word's own; root: the last of the forms that follow; n_near: how many
    near words there are.
    """
    words = written(word_counts(docs, min_length, min_count, drop_mod), "words")
    return grouped(words, factor, node_words)


def grouped(words: DataFrame, factor: int = 10, node_words: int = NODE_WORDS) -> DataFrame:
    """``variants`` of given (word, n); words are of the letters A-Z, a-z and U+00C0 to U+00FF."""
    words = written(words.mapInArrow(_with_vectors(letter_groups(words)), "word string, n long, vec long"), "vectors")
    size = max(node_words, words.count() // MAX_NODES)
    paths, depths, sizes = top_nodes(words, size)
    sent = words.mapInArrow(_reached(paths, depths, -(-sizes // size)), "node long, block long, resident boolean, word string, n long, vec long")
    pairs = sent.groupBy("node", "block").applyInArrow(_pairs_of_subtrie, _NEAR)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    fits = -F.col("best.less") >= factor * F.col("n")
    formed = written(words.select("word", "n").join(best, "word", "left").select(
        "word", F.when(fits, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, -F.col("best.less")).alias("form_n")), "forms")
    return formed.join(_roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
