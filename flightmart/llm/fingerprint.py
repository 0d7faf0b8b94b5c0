"""Order MinHash fingerprints of documents.

A text's items are its runs of ``k`` words, each with its occurrence number
(how often the same run stands before it), so repeats count.  For each of
``size`` hash functions the ``tuple_size`` items with the least hashes are
chosen, put back in the order of the text, and hashed together: the signature
agrees in a place only if both the items and their order agree, which follows
edit distance rather than mere common content.  The hash functions are
rotations of one hash: the least items of the j-th are the first that follow
its start on the circle of hashes, so an item is hashed and sorted once and
every function is a binary search.

DataFrame operations only; a text is fingerprinted by array functions within
its row, so a document never leaves its task.

Defined results.  Null or empty text: the fingerprint of the empty text.
Fewer words than ``k``: the whole text is the only item.  Very long texts: read
whole; beyond 2^26 items, positions are rounded down to 2^26 steps.  Ties are
told apart by position.  ``with_next``: null doc_id comes last in descending
order; rows with equal doc_id are ordered by a hash of their texts; repeated
rows (equal doc_id and text) count as one document in the order, and each gets
its result; a lone document follows itself.  Empty table: no rows.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightmart.llm.common import keyed, text_of, written

_POS = 26  # low bits of a packed item that hold its position
_STEPS = [1 << b for b in range(30, -1, -1)]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used inside functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _first_from(items: Column, steps: Column, n: Column, target: Column, shift: int = 0) -> Column:
    """Index of the first of the ascending items (without their ``shift`` low bits) that is not below target; n if none."""

    def step(at: Column, width: Column) -> Column:
        there = F.get(items, at + width)
        there = F.shiftright(there, shift) if shift else there
        return F.when((at + width < n) & (there < target), at + width).otherwise(at)

    return F.aggregate(steps, F.lit(-1), step) + 1


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, _POS)


def _position(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << _POS) - 1))


def _pack(value: Column, position: Column) -> Column:
    return value.bitwiseAND(F.lit(-1 << _POS)).bitwiseOR(position)


def order_minhash(text: Column, k: int = 3, size: int = 64, tuple_size: int = 2) -> Column:
    """The fingerprint as a string of ``size`` values of four hexadecimal digits."""

    def runs(words: Column) -> Column:
        n = F.greatest(F.size(words) - (k - 1), F.lit(1))
        place = F.when(n <= 1 << _POS, F.lit(1)).otherwise(n.cast("double") / (1 << _POS))
        return F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), lambda i: _pack(F.xxhash64(*[F.get(words, i + j) for j in range(k)]), F.floor(i / place))))

    def numbered(sorted_runs: Column, steps: Column) -> Column:
        n = F.size(sorted_runs)

        def item(run: Column, i: Column) -> Column:
            again = (i > 0) & (_hash(F.get(sorted_runs, i - 1)) == _hash(run))
            occurrence = i - _first_from(sorted_runs, steps, n, _hash(run), _POS)
            return F.when(again, _pack(F.xxhash64(_hash(run), occurrence), _position(run))).otherwise(run)

        return F.sort_array(F.transform(sorted_runs, item))

    def signature(items: Column, steps: Column) -> Column:
        n = F.size(items)

        def value(start: Column) -> Column:
            def chosen(first: Column) -> Column:
                least = F.array(*[F.get(items, F.pmod(first + j, n)) for j in range(tuple_size)])
                in_order = F.sort_array(F.transform(least, lambda x: F.struct(_position(x).alias("p"), _hash(x).alias("h"))))
                return F.lpad(F.lower(F.hex(F.aggregate(in_order, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x["h"])).bitwiseAND(F.lit(0xFFFF)))), 4, "0")

            return _let(_first_from(items, steps, n, start), chosen)

        starts = F.array(*[F.lit(-(1 << 63) + j * ((1 << 64) // size)) for j in range(size)])
        return F.array_join(F.transform(starts, value), "")

    def whole(sorted_runs: Column) -> Column:
        steps = F.filter(F.array(*map(F.lit, _STEPS)), lambda s: s <= F.size(sorted_runs))
        return _let(steps, lambda st: _let(numbered(sorted_runs, st), lambda items: signature(items, st)))

    return _let(F.split(text, r"\s+"), lambda words: _let(runs(words), whole))


def likeness(a: Column, b: Column, size: int = 64) -> Column:
    """Share of places in which two fingerprints agree, 0 to 1."""
    same = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.substring(a, i * 4 + 1, F.lit(4)) == F.substring(b, i * 4 + 1, F.lit(4)))
    return F.size(same) / F.lit(float(size))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    return text_of(docs).select("doc_id", order_minhash(F.col("text")).alias("fingerprint"))


def _followers(keyed: DataFrame) -> DataFrame:
    """(k1, k2, to_1, to_2, to_chars): each document, the one that it follows, and that one's length.

    Only keys and lengths are ordered: in ranges of doc_id, within each by a
    window, and from each range's last to the next range's first by a table of
    one row per range.
    """
    spark = keyed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = keyed.select("doc_id", "k1", "k2", F.char_length("text").alias("chars")).distinct()
    ranges = written(keys.repartitionByRange(parts, F.col("doc_id").desc_nulls_last()).withColumn("range", F.spark_partition_id()), "key-ranges")
    order = [F.col("doc_id").desc_nulls_last(), F.col("k2")]
    me = F.struct("k1", "k2")
    within = Window.partitionBy("range").orderBy(*order)
    placed = written(ranges.select("range", "k1", "k2", "chars", F.lead(me).over(within).alias("next"), F.row_number().over(within).alias("n")), "key-order")
    over = Window.orderBy("range")
    heads = placed.where("n = 1").select("range", me.alias("head"))
    heads = heads.select("range", F.coalesce(F.lead("head").over(over), F.first("head").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    full = placed.join(F.broadcast(heads), "range").withColumn("next", F.coalesce("next", "after"))  # a row per shuffle partition
    return full.select(F.col("next.k1").alias("k1"), F.col("next.k2").alias("k2"), F.col("k1").alias("to_1"), F.col("k2").alias("to_2"), F.col("chars").alias("to_chars"))


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row's text and of its edited text, which ends like the next document begins.

    The edited text has its last floor(n / 3) code points replaced by the first
    as many of the next document's, in descending order of doc_id; the first
    document follows the last.  Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, next_doc_id.
    """
    rows = keyed(docs)
    # written, so that a text is fingerprinted once; without the text, so that this is small
    prints = written(rows.select("k1", "k2", order_minhash(F.col("text")).alias("fingerprint")), "fingerprints").dropDuplicates(["k1", "k2"])
    texts = rows.groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    known = texts.join(prints, ["k1", "k2"])
    # Each document sends what its predecessor needs of it: a third of that one's length, and its fingerprint.
    # Both sides use the same columns of ``known``, so that Spark shuffles the texts once for both.
    sent = (known.join(_followers(rows), ["k1", "k2"])
            .select(F.col("to_1").alias("k1"), F.col("to_2").alias("k2"), F.when(F.col("copies") > 0, F.expr("left(text, cast(floor(to_chars / 3) as int))")).alias("begin"),
                    F.col("fingerprint").alias("next_fingerprint"), F.col("doc_id").alias("next_doc_id")))
    n = F.char_length("text")
    edited = known.join(sent, ["k1", "k2"]).withColumn("edited", F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 3) as int))"), "begin"))
    out = edited.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", order_minhash(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint", "next_doc_id", "copies")
    out = out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                     likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), "next_doc_id", F.explode_outer(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.drop("copy")
