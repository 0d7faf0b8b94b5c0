"""Class-based n-gram scores of documents, after Brown et al.

1. Words are counted over all training texts, one row per word.
2. The most frequent words (``HEAD`` at most, a fixed bound, none of them seen
   once) get numbers that every task knows; texts are written once as numbers.
   All rarer words stay in tables and are joined by shuffle: none of them is hot.
3. Exchange clustering into ``CLASSES`` classes, by the likelihood of the bigrams:
   the ``CORE`` most frequent words one by one until no move raises it; then all
   head words in batches, each word to the class that its neighbours' classes,
   counted in Spark, make likeliest, for as long as the likelihood rises; then
   every rarer word that occurs twice or more, likewise, in one batch.  Words
   seen once share a class with the unknown ones, so that it tells where these occur.
4. A text's probability is the product, over its tokens and an end, of the
   transition from class to class and the emission of the word by its class,
   both smoothed.

Defined results.  Null or empty text: the end alone.  Null doc_id: held out, as
the checksum of the empty string is 0.  Repeated rows: each counts and is
scored.  Very long texts: read whole.  Words of equal frequency: ranked by
their bytes; those that share the frequency at which the head is full are all
left to the tables.  No training texts: nothing is known, all probabilities
come from smoothing.  Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightmart.llm.common import python_batches, written

HEAD = 1 << 18
CORE = 1 << 11
CLASSES = 64  # 127 at most: a neighbour's side and class share a byte
LEAST_RISE = 2e-3  # batches end when one raises the log-likelihood by less than this per token
ADD = 0.1  # smoothing of word counts
CLASS_MIX = 5.0  # weight of a class's overall share in a transition
END = b""  # no word is empty
_PENDING = 2_000_000  # tokens that a task counts at once

Batches = Iterator[pa.RecordBatch]


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _count(batches: Batches) -> Batches:
    seen: Counter = Counter()

    def rows() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        seen.clear()
        return batch

    for batch in python_batches(batches):
        for text in batch.column("text").to_pylist():
            seen.update(words(text))
            seen[END] += 1
        if len(seen) > 300_000:
            yield rows()
    if seen:
        yield rows()


@dataclass
class Head:
    """The numbered words: the end first, then the most frequent ones; any other word has the number ``len(words)``."""

    words: list[bytes]
    counts: np.ndarray
    n_tokens: int  # of the whole training corpus
    n_words: int
    number: dict[bytes, int] = field(default_factory=dict)

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        if not self.number:
            self.number = {w: i for i, w in enumerate(self.words)}
        return np.fromiter(map(self.number.get, tokens, repeat(len(self.words))), np.int32, len(tokens))


def head_of(counts: DataFrame, size: int) -> Head:
    """The words of the greatest frequencies, as many frequencies as ``size`` words allow."""
    totals = counts.agg(F.sum("n"), F.count(F.lit(1)), F.max(F.when(F.col("word") == END, F.col("n")))).first()
    # a row per different frequency: fewer than the square root of twice the tokens
    steps = counts.where("n > 1").groupBy("n").agg(F.count(F.lit(1)).alias("words")).toArrow().sort_by([("n", "descending")])
    fits = np.cumsum(steps.column("words").to_numpy()) <= size
    least = int(steps.column("n").to_numpy()[fits][-1]) if fits.any() else None
    rest = counts.where((F.col("n") >= least) & (F.col("word") != END)) if least else counts.where("false")
    found = rest.toArrow().sort_by([("n", "descending"), ("word", "ascending")])  # ``size`` rows at most
    return Head([END, *found.column("word").to_pylist()], np.concatenate([[totals[2] or 0], found.column("n").to_numpy()]).astype(np.int64), totals[0] or 0, totals[1])


_CODED = ("key long, doc_id long, held_out boolean, n_tokens long, n_known long, log_n double, numbers binary, rare array<struct<pos: int, word: binary>>")


def _encode(shared: Broadcast):
    def run(batches: Batches) -> Batches:
        head: Head = shared.value
        log_n, known, beyond = np.append(np.log10(head.counts + ADD), 0.0), np.append(head.counts > 0, False), len(head.words)
        first = TaskContext.get().partitionId() << 40
        for batch in python_batches(batches):
            held, at, rare, upto = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                tokens = words(text)
                tokens.append(END)
                got = head.numbers(tokens)
                places = np.flatnonzero(got == beyond)
                held.append(got), at.append(places), rare.extend(tokens[i] for i in places)
                upto.append(len(rare))
            struct = pa.StructArray.from_arrays([pa.array(np.concatenate(at).astype(np.int32)) if at else pa.array([], pa.int32()), pa.array(rare, pa.binary())], names=["pos", "word"])
            keys = pa.array(range(first, first + batch.num_rows), pa.int64())
            first += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [keys, batch.column("doc_id"), batch.column("held_out"), pa.array(map(len, held), pa.int64()), pa.array([int(known[x].sum()) for x in held], pa.int64()),
                 pa.array([float(log_n[x].sum()) for x in held], pa.float64()), pa.array([x.astype("<i4").tobytes() for x in held], pa.binary()), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), struct)],
                names=["key", "doc_id", "held_out", "n_tokens", "n_known", "log_n", "numbers", "rare"])

    return run


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column as one array, and where each row's begin."""
    wide = pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[-1]].view(kind), (at[:-1] - at[0]) // np.dtype(kind).itemsize


def _places(starts: np.ndarray, lists: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Places in the flat values of all structs of a list column by their ``pos``, and the structs."""
    sizes, found = pc.fill_null(lists.value_lengths(), 0).to_numpy(), lists.flatten()
    return np.repeat(starts, sizes) + found.field("pos").to_numpy(), found


def _streams(batches: Batches, column: str, kind: str) -> Iterator[np.ndarray]:
    """The values of whole texts one after another.  Each text ends with the end, which is also what comes before its first word."""
    held, pending = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(_flat(batch.column(column), kind)[0])
            pending += len(held[-1])
        if pending > _PENDING:
            yield np.concatenate(held)
            held, pending = [], 0
    if held:
        yield np.concatenate(held)


def _pair_rows(total: np.ndarray) -> Batches:
    at = np.flatnonzero(total)
    for k in range(0, len(at), 1 << 18):
        part = at[k:k + (1 << 18)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["pair", "n"])


def _pairs(shared: Broadcast, size: int, column: str, kind: str):
    """Counts of neighbours under a map of the values to 0..size-1, as ``left * size + right``."""

    def run(batches: Batches) -> Batches:
        of, total, end = shared.value, np.zeros(size * size, np.int64), None
        for s in _streams(batches, column, kind):
            c = of[s].astype(np.int64)
            end = c[-1]
            total += np.bincount(np.concatenate([[end], c[:-1]]) * size + c, minlength=size * size)
        if end is not None:
            yield from _pair_rows(total)

    return run


def _pair_table(rows: DataFrame, of: np.ndarray, size: int, column: str = "numbers", kind: str = "<i4") -> np.ndarray:
    """Counts of neighbours as a matrix; a row per pair, ``size`` squared at most, comes to the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(of)
    found = rows.select(column).mapInArrow(_pairs(shared, size, column, kind), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size * size)
    table[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return table.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    """Log-likelihood of the bigrams under the class model, but for the words' own counts, which no move changes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def exchange(bigrams: np.ndarray, core: int, classes: int) -> np.ndarray:
    """Class of each symbol.  The first ``core`` symbols are moved between ``classes`` classes; the others keep one each.

    A symbol moves to the class that raises the likelihood of the bigrams under
    the class model most; the class counts follow each move.  Each move raises
    it, so that sweeps end; they go on until none moves a symbol.
    """
    size = len(bigrams)
    of = np.concatenate([np.arange(core) % classes, classes + np.arange(size - core)])
    k = classes + size - core
    table = np.zeros((k, k))
    np.add.at(table, (of[:, None], of[None, :]), bigrams)
    weight = bigrams.sum(axis=1) + bigrams.sum(axis=0)
    totals = np.bincount(of, weights=weight, minlength=k)  # twice a class's count but for the ends of texts
    own = np.arange(k)
    least = 1e-9 + 1e-13 * float(_xlogx(weight.sum()))  # more than rounding, which could move symbols to and fro
    moved = 1
    while moved:
        moved = 0
        for w in range(core):
            if not weight[w]:
                continue
            itself, was = bigrams[w, w], of[w]
            after = np.bincount(of, weights=bigrams[w], minlength=k)
            before = np.bincount(of, weights=bigrams[:, w], minlength=k)
            after[was] -= itself
            before[was] -= itself
            table[was] -= after
            table[:, was] -= before
            table[was, was] -= itself
            totals[was] -= weight[w]
            here = _xlogx(table)
            rows = table + after
            rows[own, own] += before + itself
            columns = _xlogx(table + before[:, None]) - here
            columns[own, own] = 0
            gain = (_xlogx(rows) - here).sum(axis=1) + columns.sum(axis=0) - (_xlogx(totals + weight[w]) - _xlogx(totals))
            to = int(np.argmax(gain[:classes]))
            if gain[to] <= gain[was] + least:
                to = was
            moved += to != was
            of[w] = to
            table[to] += after
            table[:, to] += before
            table[to, to] += itself
            totals[to] += weight[w]
    return of


def _preference(table: np.ndarray) -> np.ndarray:
    """What one more bigram of two classes adds to the log-likelihood, to first order."""
    return np.log(table + ADD) - np.log(table.sum(1) + ADD)[:, None] - np.log(table.sum(0) + ADD)[None, :]


def best_class(neighbours: np.ndarray, preference: np.ndarray) -> np.ndarray:
    """The likeliest class of each word (row), by how often each class stands before and after it; never the last class."""
    k = len(preference)
    return np.argmax(neighbours[:, :k] @ preference[:, :k - 1] + neighbours[:, k:] @ preference[:k - 1].T, axis=1)


def _neighbours(shared: Broadcast, parts: int):
    """Rows (part, keys, counts) for the words that may move, a part of the words in each.

    Key: number // parts * 2k + code; code: the class before, or k + the class after.
    """

    def run(batches: Batches) -> Batches:
        of, moving, k = shared.value
        width = 2 * k
        room = (len(of) // parts + 1) * width  # keys of a part
        base = np.arange(len(of)) % parts * room + np.arange(len(of)) // parts * width
        kind = np.int32 if parts * room < 1 << 31 else np.int64
        base, of = base.astype(kind), of.astype(kind)
        for s in _streams(batches, "numbers", "<i4"):
            left = np.concatenate([s[:1] * 0, s[:-1]])
            a, b = moving[s], moving[left]
            keys, n = np.unique(np.concatenate([base[s[a]] + of[left[a]], base[left[b]] + (of[s[b]] + kind(k))]), return_counts=True)
            edge = np.searchsorted(keys, np.arange(parts + 1, dtype=np.int64) * room)
            keys = (keys % room).astype("<u4")
            rows = [p for p in range(parts) if edge[p] < edge[p + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32()), *(pa.array([x[edge[p]:edge[p + 1]].tobytes() for p in rows], pa.binary()) for x in (keys, n.astype("<u4")))], names=["part", "keys", "counts"])

    return run


def _choose(preference: np.ndarray, parts: int, words: int):
    """Rows (number, class) from all rows of a part; a task holds the neighbour counts of one part at a time."""

    def run(batches: Batches) -> Batches:
        width = 2 * len(preference)
        counts, part = None, None

        def rows() -> pa.RecordBatch:
            table = counts.reshape(-1, width)
            local = np.flatnonzero(table.any(axis=1))
            return pa.RecordBatch.from_arrays([pa.array((local * parts + part).astype(np.int32)), pa.array(best_class(table[local], preference).astype(np.int32))], names=["number", "class"])

        for batch in batches:
            for at, keys, n in zip(*(batch.column(c) for c in ("part", "keys", "counts")), strict=True):
                if at.as_py() != part:
                    if part is not None:
                        yield rows()
                    part, counts = at.as_py(), np.zeros((words // parts + 1) * width)
                counts[np.frombuffer(keys.as_buffer(), "<u4")] += np.frombuffer(n.as_buffer(), "<u4")  # no key twice in a row
        if part is not None:
            yield rows()

    return run


def exchange_in_batches(training: DataFrame, of: np.ndarray, classes: int, core: int, least_rise: float = LEAST_RISE) -> tuple[np.ndarray, np.ndarray]:
    """(class by number, counts of neighbouring classes): head words are moved in batches while the likelihood rises.

    The first batch places the words beyond the core; after that, each is one half
    of all words in turn, so that neighbours do not change places at once.
    """
    spark, k, turn = training.sparkSession, classes + 1, 0
    numbers = np.arange(len(of))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    table = _pair_table(training, of, k)
    idle = 0
    while table.any() and idle < 2:
        moving = numbers >= core if turn == 0 else (numbers * 2654435761 >> 16) % 2 == turn % 2
        moving[-1] = False  # all rarer words
        shared = spark.sparkContext.broadcast((of.astype(np.int64), moving, k))
        chosen = (training.select("numbers").mapInArrow(_neighbours(shared, parts), "part int, keys binary, counts binary").repartition(parts, "part").sortWithinPartitions("part")
                  .mapInArrow(_choose(_preference(table), parts, len(of)), "number int, class int").toArrow())  # a row per head word at most
        moved = of.copy()
        moved[chosen.column("number").to_numpy()] = chosen.column("class").to_numpy()
        after = _pair_table(training, moved, k)
        rise = likelihood(after) - likelihood(table)
        if rise > 0:
            of, table = moved, after
        idle = 0 if rise >= least_rise * table.sum() else idle + 1
        turn += 1
    return of, table


def _rare_neighbours(shared: Broadcast):
    """Rows (word, codes): a byte for each neighbour of the rarer words, as in ``_neighbours``."""

    def run(batches: Batches) -> Batches:
        of, k = shared.value
        seen: dict[bytes, bytes] = {}

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], names=["word", "codes"])
            seen.clear()
            return batch

        for batch in python_batches(batches):
            numbers, starts = _flat(batch.column("numbers"), "<i4")
            c = of[numbers]
            at, found = _places(starts, batch.column("rare"))
            codes = np.stack([c[at - 1], k + c[at + 1]], axis=1).astype(np.uint8).tobytes()  # the last is the end, which also stands before the first
            for i, word in enumerate(found.field("word").to_pylist()):
                seen[word] = seen.get(word, b"") + codes[2 * i:2 * i + 2]
            if len(seen) > 200_000:
                yield rows()
        if seen:
            yield rows()

    return run


def _place(preference: np.ndarray):
    def run(batches: Batches) -> Batches:
        width = 2 * len(preference)
        for batch in python_batches(batches, 2048):
            lists = batch.column("codes")
            codes = [b"".join(x) for x in lists.to_pylist()]
            sizes = np.array([len(x) for x in codes], np.int64)
            counts = np.bincount(np.repeat(np.arange(len(codes)), sizes) * width + np.frombuffer(b"".join(codes), np.uint8), minlength=len(codes) * width)
            often = np.flatnonzero(sizes > 2)  # two neighbours for each occurrence
            chosen = best_class(counts.reshape(-1, width)[often].astype(float), preference).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("word").take(pa.array(often)), pa.array(chosen)], names=["word", "class"])

    return run


@dataclass
class Clustering:
    """Class of each head word by its number (the last: of all that have no other) and, as a table (word, class), of rarer words."""

    head: Head
    counts: DataFrame
    coded: DataFrame
    of: np.ndarray
    rarer: DataFrame
    classes: int


def cluster(docs: DataFrame, held_out: Column, head_size: int = HEAD, core: int = CORE, classes: int = CLASSES) -> Clustering:
    """Cluster the words of the rows for which ``held_out`` is false; ``coded`` holds all rows, ready to be scored."""
    if not 1 <= classes <= 127:
        raise ValueError("classes must be 1 to 127")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    counts = written(rows.where("NOT held_out").select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    head = head_of(counts, head_size)
    coded = written(rows.mapInArrow(_encode(spark.sparkContext.broadcast(head)), _CODED), "coded")
    training = coded.where("NOT held_out")
    core, rest = min(core, len(head.words)), classes
    symbols = np.minimum(np.arange(len(head.words) + 1), core)
    of = np.full(len(symbols), rest)
    of[:core] = exchange(_pair_table(training, symbols, core + 1), core, classes)[:core]
    of, table = exchange_in_batches(training, of, classes, core)
    codes = training.select("numbers", "rare").where("size(rare) > 0").mapInArrow(_rare_neighbours(spark.sparkContext.broadcast((of, classes + 1))), "word binary, codes binary")
    # a rarer word's neighbours: two bytes for each of its occurrences
    rarer = written(codes.groupBy("word").agg(F.collect_list("codes").alias("codes")).mapInArrow(_place(_preference(table)), "word binary, class int"), "rarer")
    return Clustering(head, counts, coded, of, rarer, classes)


_FILLED = "doc_id long, held_out boolean, n_tokens long, n_known long, log_n double, classes binary"


def _fill(shared: Broadcast):
    """The class of every token: of the head words by number, of the rarer ones from ``filled``."""

    def run(batches: Batches) -> Batches:
        of = shared.value.astype(np.uint8)
        for batch in python_batches(batches):
            numbers, starts = _flat(batch.column("numbers"), "<i4")
            c = of[numbers]
            at, found = _places(starts, batch.column("filled"))
            c[at] = found.field("class").to_numpy()
            out = [c[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(c)], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "held_out", "n_tokens", "n_known", "log_n")), pa.array(out, pa.binary())], names=["doc_id", "held_out", "n_tokens", "n_known", "log_n", "classes"])

    return run


def model(table: np.ndarray, different: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 P(class | class before), log10 of the divisor of a word's smoothed count in its class)."""
    count = table.sum(0)
    share = (count + ADD) / (count.sum() + ADD * len(count))
    transition = np.log10((table + CLASS_MIX * share) / (table.sum(axis=1, keepdims=True) + CLASS_MIX))
    return transition, np.log10(count + ADD * (different + 1))


def _score(shared: Broadcast) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        transition, divisor = shared.value
        for batch in python_batches(batches):
            out = []
            for raw, log_n in zip(batch.column("classes"), batch.column("log_n").to_pylist(), strict=True):
                c = np.frombuffer(raw.as_buffer(), np.uint8)
                out.append(float(transition[np.concatenate([c[-1:], c[:-1]]), c].sum() - divisor[c].sum()) + log_n)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "held_out", "n_tokens", "n_known", "log_n")), pa.array(out, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "log_n", "score"])

    return run


def scores(docs: DataFrame, held_out: Column, head_size: int = HEAD, core: int = CORE, classes: int = CLASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from the rows for which ``held_out`` is false.  Scores are log10
    probabilities of the whole text and its end: base_score by smoothed single
    words, score by the class model.
    """
    spark = docs.sparkSession
    found = cluster(docs, held_out, head_size, core, classes)
    head, rest, k, zero = found.head, found.classes, found.classes + 1, F.lit(0)
    # the same joins at every size: both sides grow with the rows
    rare = (found.coded.select("key", F.inline("rare")).join(found.counts.hint("merge"), "word", "left").join(found.rarer.hint("merge"), "word", "left")
            .groupBy("key").agg(F.count_if(F.col("n") > 0).alias("rare_known"), F.sum(F.log10(F.coalesce("n", zero) + ADD)).alias("rare_log_n"),
                                F.collect_list(F.struct("pos", F.coalesce("class", F.lit(rest)).cast("int").alias("class"))).alias("filled")))
    joined = found.coded.drop("rare").join(rare.hint("merge"), "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", zero)).alias("n_known"), (F.col("log_n") + F.coalesce("rare_log_n", zero)).alias("log_n"), "numbers", "filled")
    filled = written(joined.mapInArrow(_fill(spark.sparkContext.broadcast(found.of)), _FILLED), "filled")
    table = _pair_table(filled.where("NOT held_out"), np.arange(k), k, "classes", "u1")
    different = np.bincount(found.of[:-1], minlength=k)
    for row in found.rarer.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per class
        different[row["class"]] += row["n"]
    different[rest] += max(head.n_words - int(different.sum()), 0)
    base_total = float(np.log10(head.n_tokens + ADD * (head.n_words + 1)))
    scored = filled.mapInArrow(_score(spark.sparkContext.broadcast(model(table, different))), "doc_id long, held_out boolean, n_tokens long, n_known long, log_n double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(head.n_tokens).cast("long").alias("train_tokens"),
                         (F.col("log_n") - F.col("n_tokens") * base_total).alias("base_score"), "score")
