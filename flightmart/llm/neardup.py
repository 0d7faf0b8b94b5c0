"""Near-duplicate groups by b-bit MinHash.

1. One pass over the texts gives each document its set of word shingles: the
   set's size and 128-bit key, the low ``BITS`` bits of its ``HASHES`` minima
   packed into a signature, and a key for each band of ``ROWS`` full minima.
   Documents with equal sets form one class; only classes go on.
2. Classes that share a band are candidates.  A bucket is not expanded into
   pairs: at first the class that shares most bands with others (the pivot) is
   compared with the rest.  From the signatures the similarity is estimated by
   counting equal positions and correcting for chance collisions; a pair stays
   unless the estimate lies ``SLACK`` standard deviations below the threshold.
3. Pairs that stay are confirmed on the full sets, made anew from the texts.
4. Classes linked so far get one component.  A bucket whose classes are all in
   one component is done.  The others go to tasks in blocks of at most
   ``BLOCK`` classes, with their texts: there, pairs of different components
   that the signatures leave are confirmed on the full sets, and the links that
   join components are emitted.  Pairs within a component need no look, as they
   cannot change it; so from a group of thousands of near copies come about as
   many links as it has members, never all its pairs.

Rows of a bucket are never gathered whole in a task: pivots are maxima, found
with partial aggregation, joins are equi-joins that can split a hot key, and a
larger bucket is compared block by block.

With 40 bands of 6 rows a pair at similarity 0.85 shares no band with
probability 6e-9, and at 0.8 5e-6.

Defined results.  Null or empty text, or one without words: an empty set,
linked with nothing.  Fewer words than a shingle has: the whole sequence as
one.  Null doc_id: in a class like any other; it is never the class's smallest
unless there is no other.  Repeated rows: one class.  Very long texts: read
whole.  Equal similarity and threshold: linked.  Empty table: no rows.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightmart.llm.common import keyed, packed, python_batches, written

BANDS, ROWS = 40, 6
HASHES = BANDS * ROWS
BITS = 2
SLACK = 6.0
BLOCK = 2048
_SEED = np.random.default_rng(20240229)
_MULTIPLY = (_SEED.integers(1, 2**32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)
_ADD = _SEED.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)
_COLUMNS = 2048  # shingles that are hashed at a time


class _WordHashes(dict):
    """word -> 64-bit hash, of at most a few hundred thousand words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _WordHashes()


def shingles(text: str | None, k: int) -> np.ndarray:
    """The distinct hashes of the text's k-word shingles, ascending; of all its words if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i:len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _minima(sets: np.ndarray) -> np.ndarray:
    low = (sets ^ sets >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), _COLUMNS):
        np.minimum(best, (low[None, at:at + _COLUMNS] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1), out=best)
    return best


@lru_cache(maxsize=1)
def _band_mix() -> np.ndarray:
    return (np.random.default_rng(7).integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64)) | np.uint64(1)


def sketch(sets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(packed low bits, band keys) of a set that is not empty."""
    low = _minima(sets)
    # a multiplier's low bits are its weakest, so "low" is taken from a mixed value
    mixed = (low ^ low >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    bits = (mixed >> np.uint32(32 - BITS))[:, None] >> np.arange(BITS, dtype=np.uint32) & 1
    keys = (low.reshape(BANDS, ROWS).astype(np.uint64) * _band_mix()).sum(axis=1, dtype=np.uint64)
    keys = (keys ^ keys >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) + np.arange(BANDS, dtype=np.uint64)
    return np.packbits(bits.astype(np.uint8)).tobytes(), keys.view(np.int64)


_SKETCH = "doc_id long, text_hash long, n_shingles long, set_key string, signature binary, bands array<long>"


def _sketch_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in python_batches(batches):
            sizes, keys, signatures, bands = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, k)
                sizes.append(len(s))
                if not len(s):
                    keys.append(None), signatures.append(None), bands.append(None)
                    continue
                signature, band = sketch(s)
                keys.append(xxhash.xxh3_128_hexdigest(s.tobytes())), signatures.append(signature), bands.append(band)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(keys, pa.string()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "set_key", "signature", "bands"])

    return run


def _least(threshold: float) -> float:
    """Equal positions of two signatures from which a pair may reach the threshold."""
    chance = 2.0 ** -BITS  # two different minima agree in their low bits this often
    at = threshold + (1 - threshold) * chance
    return HASHES * at - SLACK * (HASHES * at * (1 - at)) ** 0.5


def _words(signatures) -> np.ndarray:
    """Packed signatures as rows of 64-bit words."""
    raw = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), -1)
    return np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8))).view(np.uint64)


_LOW_BITS = np.uint64(sum(1 << k for k in range(0, 64, BITS)))


def _equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many positions signatures agree; the last axis holds their words."""
    differ = x ^ y
    any_bit = differ
    for k in range(1, BITS):
        any_bit = any_bit | differ >> np.uint64(k)
    return HASHES - np.bitwise_count(any_bit & _LOW_BITS).sum(axis=-1, dtype=np.int64)


def _estimates(threshold: float):
    """Keeps the pairs (a, b) of (a, b, sig_a, sig_b) whose estimated similarity may reach the threshold."""
    least = _least(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                equal = _equal(*(_words(batch.column(n).to_pylist()) for n in ("sig_a", "sig_b")))
                yield batch.select(["a", "b"]).filter(pa.array(equal >= least))

    return run


def block_links(nodes: np.ndarray, labels: np.ndarray, words: np.ndarray, side: np.ndarray, sets: list[np.ndarray],
                numerator: int, denominator: int) -> list[tuple[int, int]]:
    """Linked pairs of nodes that join all of a block's components (labels) that its links join.

    Each node in turn is compared, on the full sets, with the later ones that
    the signatures leave and that are in another component at that time.
    ``side``: if there are two sides, only pairs across are looked at.
    """
    least, n = _least(numerator / denominator), len(nodes)
    sizes = np.array([len(x) for x in sets])
    universe, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    holds = np.zeros(len(universe), bool)
    _, root = np.unique(labels, return_inverse=True)
    two_sided = side.any() and not side.all()
    found: list[tuple[int, int]] = []
    for i in range(n - 1):
        fits = (root[i + 1:] != root[i]) & (_equal(words[i], words[i + 1:]) >= least)
        if two_sided:
            fits &= side[i + 1:] != side[i]
        if not fits.any():
            continue
        mine = flat[begin[i]:begin[i] + sizes[i]]
        holds[mine] = True
        for j in (np.flatnonzero(fits) + i + 1).tolist():
            if root[j] != root[i]:
                both = int(holds[flat[begin[j]:begin[j] + sizes[j]]].sum())
                if denominator * both >= numerator * (sizes[i] + sizes[j] - both):
                    found.append((int(nodes[i]), int(nodes[j])))
                    root[root == root[j]] = root[i]
        holds[mine] = False
    return found


def _links_of_blocks(k: int, numerator: int, denominator: int):
    """For applyInPandas over the blocks of buckets: links (a, b)."""

    def run(block):
        block = block.sort_values("node")
        sets = [shingles(text, k) for text in block["text"]]
        links = block_links(block["node"].to_numpy(), block["label"].to_numpy(), _words(block["signature"].tolist()), block["side"].to_numpy(), sets, numerator, denominator)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _blocks(buckets: DataFrame) -> DataFrame:
    """(band, node, block, side): blocks of at most about BLOCK nodes; a larger bucket's parts meet in pairs.

    A bucket with p parts has a block for every two of them; a part alone is
    compared within itself in the block with its own number twice.
    """
    sizes = buckets.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / (BLOCK // 2)).cast("int").alias("parts"))
    dealt = buckets.join(sizes, "band").withColumn("part", F.when(F.col("parts") <= 2, F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))
    one = F.array(F.struct(F.lit("0").alias("block"), F.lit(0).alias("side")))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(
        F.concat_ws(":", F.least("part", j), F.greatest("part", j)).alias("block"), F.when(F.col("part") <= j, F.lit(0)).otherwise(F.lit(1)).alias("side")))
    return dealt.select("band", "node", F.inline(F.when(F.col("parts") <= 2, one).otherwise(meets)))


def _confirm(k: int, numerator: int, denominator: int):
    """Keeps the pairs (a, b, text_a, text_b) whose full sets reach numerator / denominator."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in python_batches(batches):
            keep = []
            last, last_set = None, None
            for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                if x != last:
                    last, last_set = x, shingles(x, k)
                other = shingles(y, k)
                both = len(np.intersect1d(last_set, other, assume_unique=True))
                keep.append(denominator * both >= numerator * (len(last_set) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _spread(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label), links (a, b): every node of a linked component gets its least label.

    Each round a node takes the least label around it, and then its label's
    label; the number of rounds grows with the logarithm of a chain's length.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a, "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = step.select(F.col("node").alias("at"), F.col("new").alias("further"))
        done = written(step.join(jump, step.new == jump["at"], "left").select("node", F.least("new", F.coalesce("further", "new")).alias("label"), F.col("label").alias("was")), "labels")
        labels = done.select("node", "label")
        if done.where("label <> was").isEmpty():
            return labels


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels of whole components, links (a, b) between their nodes: every node gets the least label of all that its component is joined to.

    A link joins the components of its ends, not the ends alone: labels are
    spread over labels, and then each node takes what its own has become.
    """
    ends = links.select("a", "b").join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
    tops = labels.select(F.col("label").alias("node")).distinct().withColumn("label", F.col("node"))
    tops = _spread(tops, ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")))
    return labels.select("node", F.col("label").alias("was")).join(tops.select(F.col("node").alias("was"), "label"), "was").select("node", "label")


def components(docs: DataFrame, k: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_key, component, class_id, component_id) of every row.

    Texts are linked if the similarity (intersection by union) of their sets of
    k-word shingles is ``numerator / denominator`` or more.  class_id is the
    smallest doc_id with the same set, component_id the smallest reachable.
    ``component`` tells components apart even where different texts bear one
    doc_id; it is null for empty sets.
    """
    threshold = numerator / denominator
    rows = keyed(docs).withColumnRenamed("k2", "text_hash")
    sketches = written(rows.select("doc_id", "text_hash", "text").mapInArrow(_sketch_rows(k), _SKETCH), "sketches")
    # signature and bands are the same in all rows of a class; copies are summed before the shuffle
    classes = written(sketches.where("set_key IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "text_hash")).alias("source"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    banded = classes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = written(banded.join(shared, "band").select("band", "node", "n"), "buckets")  # buckets with two classes or more
    nodes = written(buckets.groupBy("node").agg(F.sum("n").alias("degree")).join(classes.select("node", "set_key", "signature", "source"), "node"), "nodes")
    texts = _class_texts(rows, nodes)
    # the pivot of a bucket: the class with the most company; a pair of many bands is one pair before signatures join it
    members = buckets.select("band", "node").join(nodes.select("node", "degree"), "node")
    pivots = members.groupBy("band").agg(F.max(F.struct("degree", "node")).alias("top")).select("band", F.col("top.node").alias("pivot"))
    pairs = members.join(pivots, "band").where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    signed = (pairs.join(nodes.select(F.col("node").alias("a"), F.col("signature").alias("sig_a")), "a")
              .join(nodes.select(F.col("node").alias("b"), F.col("signature").alias("sig_b")), "b"))
    likely = written(signed.select("a", "b", "sig_a", "sig_b").mapInArrow(_estimates(threshold), "a long, b long"), "likely")
    labels = nodes.select("node", F.col("node").alias("label"))
    sets = (likely.hint("merge").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").hint("merge")
            .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a"))
    labels = _spread(labels, written(sets.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(k, numerator, denominator), "a long, b long"), "confirmed"))
    # buckets whose classes, without the pivot that has been compared with all, are in several components
    others = buckets.join(pivots.select("band", F.col("pivot").alias("node")), ["band", "node"], "left_anti").select("band", "node").join(labels, "node")
    split = others.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band")
    blocks = (_blocks(written(others.join(split, "band").select("band", "node"), "split")).join(labels, "node")
              .join(nodes.select("node", "signature"), "node").join(texts, "node"))
    links = written(blocks.groupBy("band", "block").applyInPandas(_links_of_blocks(k, numerator, denominator), "a long, b long"), "links")
    labels = _merge(labels, links)
    named = labels.join(classes.select("node", "class_id"), "node").groupBy("label").agg(F.min("class_id").alias("least"))
    found = labels.join(named, "label").select("node", "least", "label")
    by_class = classes.select("node", "set_key", "class_id").join(found, "node", "left").select(
        "set_key", "class_id", F.coalesce("least", "class_id").alias("component_id"), F.coalesce("label", "node").alias("component"))
    return sketches.select("doc_id", "text_hash", "n_shingles", "set_key").join(by_class, "set_key", "left").select(
        "doc_id", "text_hash", "n_shingles", "set_key", "component", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _class_texts(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text): a text for each class that has candidates, written once."""
    # nodes grow with the rows: the same join at every size, also where they would be few enough to broadcast
    wanted = nodes.select("node", F.coalesce("source.doc_id", F.lit(0)).alias("k1"), "source.text_hash").hint("merge")
    return written(rows.join(wanted, ["k1", "text_hash"]).select("node", "text").dropDuplicates(["node"]), "texts")


def first_of_components(docs: DataFrame, k: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """One row of each group of near duplicates, with all columns of ``docs``: that of the smallest doc_id.

    Rows without words are linked with nothing and all stay.  If several rows of
    a group bear its smallest doc_id, one stays, that with the smallest text hash.
    """
    found = components(docs, k, numerator, denominator)
    chosen = found.where("set_key IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    chosen = chosen.select(F.coalesce("first.doc_id", F.lit(0)).alias("k1"), F.col("first.text_hash").alias("k2"))
    rows = packed(docs)
    wordless = F.coalesce(F.col("row.text").cast("string"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    one = rows.where(~wordless).join(chosen.hint("merge"), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    return one.select("row.*").unionByName(rows.where(wordless).select("row.*"))
