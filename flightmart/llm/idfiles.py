"""Token ids in byte-aligned variable-length code, ranked by frequency.

Ids are replaced by their rank among all ids of the corpus (0: the most
frequent), so most values take one byte.  Four values share a control byte of
two bits each, which say how many bytes (1 to 4, little-endian) each takes;
control bytes and data bytes are stored apart.  A control byte is decoded by
tables of 256 entries: the four lengths, and from them all places at once.

A file set is a folder with

* ``blocks``: Parquet rows (shard, block, control, data, and per document its
  doc_id, number of ids and place in its shard).  Shards are numbered in
  ascending doc_id order, as are blocks within a shard and documents within a
  block.  Parquet is the container only; the ids are in ``control``/``data``.
* ``ranks``: one row, all ids in order of rank.

Both are written by Spark's committers, so a lost executor's half-written
files never count, and the folder may be in any store that Spark reaches.

Defined results.  Null or empty text: the end id alone.  Null doc_id: comes
first.  Rows with the same doc_id: in the order of their texts.  Empty table:
no blocks.  Very long texts: encoded whole, in one block.  Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightmart.llm.common import python_batches, scratch, text_of
from flightmart.llm.tokens import encoder, slices

#: units whose ids a worker remembers; about 200 MB where all are taken
MEMO = 1_000_000

_SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1  # control byte -> its four lengths
_BLOCK = "shard long, block long, doc_ids array<long>, sizes array<long>, start long, control binary, data binary"


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values; the last control byte is filled up with length 1, without data."""
    v = values.astype("<u4", copy=False)
    size = 1 + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[:len(v)] = size - 1
    quads = code.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    upto = np.cumsum(size)
    data, first = np.empty(int(upto[-1]) if len(v) else 0, np.uint8), upto - size
    data[first] = v & 0xFF
    for k in (1, 2, 3):
        more = size > k
        data[first[more] + k] = v[more] >> np.uint32(8 * k) & 0xFF
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    first = np.cumsum(size) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    out = raw[first]
    for k in (1, 2, 3):
        more = size > k
        out[more] |= raw[first[more] + k] << np.uint32(8 * k)
    return out


def _tokenize(path: str, end_id: int):
    """Rows (shard, seq, doc_id, start, ids): start counts the ids before in this task; last a row of the ids' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard = encoder(path, MEMO), TaskContext.get().partitionId()
        kind = "<u2" if max(code.vocab_size, end_id + 1) <= 1 << 16 else "<u4"
        counts, seq, start = np.zeros(max(code.vocab_size, end_id + 1), np.int64), 0, 0
        for batch in python_batches(batches):
            doc_ids, texts = (batch.column(n).to_pylist() for n in ("doc_id", "text"))
            for a, b in slices(texts):
                ids, sizes = code.encode(texts[a:b], end_id)
                counts += np.bincount(ids, minlength=len(counts))
                upto = np.cumsum(sizes)
                yield _rows(shard, range(seq, seq + b - a), doc_ids[a:b], start + upto - sizes, sizes, [x.tobytes() for x in np.split(ids.astype(kind), upto[:-1])])
                seq, start = seq + b - a, start + int(upto[-1])
        if seq:
            yield _rows(shard, [-1], [None], [0], [0], [counts.astype("<i8").tobytes()])

    return run


def _rows(shard, seq, doc_ids, start, sizes, ids) -> pa.RecordBatch:
    seq = pa.array(list(seq), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([shard] * len(seq), pa.int64()), seq, pa.array(doc_ids, pa.int64()), pa.array(np.asarray(start, np.int64)), pa.array(np.asarray(sizes, np.int64)), pa.array(ids, pa.binary())],
        names=["shard", "seq", "doc_id", "start", "size", "ids"])


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for raw in batch.column("ids"):
            counts = np.frombuffer(raw.as_buffer(), "<i8")
            total = counts.copy() if total is None else total + counts
    if total is not None:
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])


def _to_blocks(by_rank: np.ndarray, block_ids: int):
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def block() -> pa.RecordBatch:
            nonlocal held, count
            control, data = encode_values(rank[np.concatenate([np.frombuffer(x[5], f"<u{len(x[5]) // x[4]}") for x in held])])
            row = ([held[0][0]], [held[0][1]], [[x[2] for x in held]], [[x[4] for x in held]], [held[0][3]], [control], [data])
            held, count = [], 0
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["shard", "block", "doc_ids", "sizes", "start", "control", "data"])

        for batch in python_batches(batches):
            for row in zip(*(batch.column(n).to_pylist() for n in ("shard", "seq", "doc_id", "start", "size", "ids")), strict=True):
                # a block holds documents that follow one another in one shard
                if held and (count >= block_ids or row[0] != held[0][0] or row[1] != held[-1][1] + 1):
                    yield block()
                held.append(row)
                count += row[4]
        if held:
            yield block()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, block_ids: int = 262_144) -> None:
    """Encode every text and write the file set to ``path``.

    The table is range-partitioned by doc_id once, as text; the ids go to the
    shared folder, with their counts, and are coded from there without another
    shuffle.  Through the driver pass the counts of the vocabulary's ids only.
    """
    spark = docs.sparkSession
    staged = scratch(spark, "ids")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    (text_of(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(_tokenize(tokenizer_path, end_id), "shard long, seq long, doc_id long, start long, size long, ids binary")
     .write.option("compression", "zstd").parquet(staged))
    rows = spark.read.schema("shard long, seq long, doc_id long, start long, size long, ids binary").parquet(staged)
    counted = (rows.where("seq < 0").select("ids").mapInArrow(_sum_counts, "id long, n long")
               .groupBy("id").agg(F.sum("n").alias("n")))
    found = counted.toArrow().sort_by([("n", "descending"), ("id", "ascending")])  # a row per id of the vocabulary at most
    by_rank = found.column("id").to_numpy()
    (spark.createDataFrame([(by_rank.astype("<u4").tobytes(),)], "ids binary").coalesce(1)
     .write.mode("overwrite").parquet(f"{path}/ranks"))
    (rows.where("seq >= 0").select("shard", "seq", "doc_id", "start", "size", "ids")
     .mapInArrow(_to_blocks(by_rank, block_ids), _BLOCK)
     .write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/blocks"))


def _from_blocks(by_rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in python_batches(batches, 4):
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], np.int64)
                ids = by_rank[decode_values(row["control"], row["data"], int(sizes.sum()))]
                upto = np.cumsum(sizes)
                raw = [x.tobytes() for x in np.split(ids, upto[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(sizes), pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + upto - sizes), pa.array(sizes), pa.array(raw, pa.binary())],
                    names=["shard", "doc_id", "start", "n_tokens", "ids"])

    return run


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document's ids from the file set, and the number of ids before them."""
    by_rank = np.frombuffer(spark.read.schema("ids binary").parquet(f"{path}/ranks").first()["ids"], "<u4")
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    # a row per shard, that is per task that wrote (spark.sql.shuffle.partitions at most): broadcast, so that the ids are not shuffled
    shards = blocks.groupBy("shard").agg(F.max(F.col("start") + F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select(F.col("shard"), F.coalesce(before, F.lit(0)).alias("before"))
    return (blocks.mapInArrow(_from_blocks(by_rank), "shard long, doc_id long, start long, n_tokens long, ids binary")
            .join(F.broadcast(shards), "shard").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids"))
