"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ``window`` consecutive words (a shorter item is
one window), a window into shingles of ``shingle`` words.  A document contains
a window if, over some run of its own words of the window's length, the share
of the window's shingles that stand there at their places (the containment) is
``threshold`` or more; at 1, the default, if the run equals the window.

1. The documents' shingles are joined with the distinct shingles of all
   windows; what matches is written, with the words around it.
2. Each window's shingles are ordered by rarity in the documents.  A window of
   n shingles can reach the threshold only where one of its
   ``n - ceil(threshold * n) + 1`` rarest (the prefix) occurs: only those are
   joined with the matches.
3. A match gives a place for the window; places before the document's first
   word or beyond its last are dropped (length and positional bounds).
4. Containment is verified on the words themselves.

DataFrame operations only.  The windows' shingles are counted first; up to
``broadcast_rows`` of them (16 bytes each) are broadcast, beyond that the joins
shuffle, and the words around a match are fetched by a join of their own.

Defined results.  Null or empty text: no words, no hits.  Null doc_id: a
document like any other.  Repeated rows: each is judged.  Items without words:
no windows.  Null item_id: hits count, but no id is listed.  Equal items: each
is listed.  Very long texts: read whole.  Empty tables: no hits, or no rows.
Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightmart.llm.common import ascii_lower, keyed, packed, written

#: Runs of ASCII letters and digits and of all other characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same runs before A-Z are lower-cased.
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def _shingles(of: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words; none if there are fewer words."""

    def hashes(w: Column) -> Column:
        return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])))

    return F.get(F.transform(F.array(of), hashes), F.lit(0))  # so that the words are made once, not once per run


def windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, words, window): the windows of all items; window is the words joined by spaces, which no word holds."""
    items = benchmark.select(F.col("item_id").alias("item_id"), words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("all")).where(F.size("all") > 0)
    last = F.greatest(F.size("all") - window, F.lit(0))
    cut = items.select("item_id", "all", F.explode(F.sequence(F.lit(0), last)).alias("at")).select("item_id", F.slice("all", F.col("at") + 1, F.lit(window)).alias("words"))
    return cut.withColumn("window", F.array_join("words", " "))


def _matches(docs: DataFrame, tokens: DataFrame, size: int, around: int, broadcast: bool) -> DataFrame:
    """(doc_id, text_hash, n_words, pos, h, near, near_at): where shingles of ``size`` words occur, with the words around."""
    worded = docs.select("doc_id", "text_hash", words(F.col("text")).alias("words"))
    hashed = worded.withColumn("hashes", _shingles(F.col("words"), size))
    tokens = tokens.where(F.col("size") == size).select("h").distinct()
    # "outer", as the filter that Spark adds below an inner explode would make all hashes twice; the joins drop what is null
    if broadcast:
        found = hashed.select("doc_id", "text_hash", "words", F.posexplode_outer("hashes").alias("pos", "h")).join(F.broadcast(tokens), "h")
    else:
        places = hashed.select("doc_id", "text_hash", F.posexplode_outer("hashes").alias("pos", "h")).join(tokens, "h")
        places = places.groupBy(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_")).agg(F.collect_set(F.struct("pos", "h")).alias("places"))  # at most a document's words
        found = worded.join(places, worded.doc_id.eqNullSafe(places.id_) & (worded.text_hash == places.hash_)).select("doc_id", "text_hash", "words", F.inline("places"))
    near_at = F.greatest(F.col("pos") - (around - size), F.lit(0))
    return found.select("doc_id", "text_hash", F.size("words").alias("n_words"), "pos", "h", F.lit(size).alias("size"),
                        F.slice("words", near_at + 1, F.lit(2 * around - size)).alias("near"), near_at.alias("near_at"))


def contained(docs: DataFrame, item_windows: DataFrame, window: int, shingle: int = 5, threshold: float = 1.0,
              broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text_hash, window, start, length): every place where a document contains a window.

    docs: (doc_id, text, text_hash).
    """
    distinct = item_windows.select("window", "words", F.size("words").alias("length")).dropDuplicates(["window"])
    # a window shorter than a shingle is a shingle itself
    sizes = [r[0] for r in distinct.select(F.least(F.lit(shingle), "length").alias("size")).distinct().collect()]  # at most ``shingle`` rows
    cut = None
    for size in sizes:
        part = distinct.where(F.least(F.lit(shingle), F.col("length")) == size).select("window", "words", "length", F.lit(size).alias("size"), F.posexplode(_shingles(F.col("words"), size)).alias("at", "h"))
        cut = part if cut is None else cut.unionByName(part)
    if cut is None:
        return docs.select("doc_id", "text_hash", F.lit("").alias("window"), F.lit(0).alias("start"), F.lit(0).alias("length")).where(F.lit(False))
    cut = written(cut, "window-shingles")
    small = cut.count() <= broadcast_rows
    matches = None
    for size in sizes:
        part = _matches(docs, cut, size, window, small)
        matches = part if matches is None else matches.unionByName(part)
    matches = written(matches, "matches")
    rarity = matches.groupBy("h", "size").agg(F.count(F.lit(1)).alias("n"))
    total = F.count(F.lit(1)).over(Window.partitionBy("window"))
    need = F.ceil(total * F.lit(threshold) - 1e-9)
    ranked = (cut.join(rarity, ["h", "size"], "left")
              .withColumns({"rank": F.row_number().over(Window.partitionBy("window").orderBy(F.coalesce("n", F.lit(0)), "h", "at")), "need": need, "total": total}))
    prefix = ranked.where(F.col("rank") <= F.col("total") - F.col("need") + 1).select("h", "size", "window", "words", "length", "at", "need")
    joined = matches.join(F.broadcast(prefix) if small else prefix, ["h", "size"])
    start = F.col("pos") - F.col("at")
    placed = joined.withColumn("start", start).where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
    there = F.slice("near", F.col("start") - F.col("near_at") + 1, F.col("length"))
    if math.isclose(threshold, 1.0):
        verified = placed.where(there == F.col("words"))
    else:
        same = F.filter(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1), lambda i: F.slice(there, i, F.col("size")) == F.slice("words", i, F.col("size")))
        verified = placed.where(F.size(same) >= F.col("need"))
    return verified.select("doc_id", "text_hash", "window", "start", "length").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, threshold: float = 1.0,
                  broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, items) of every row: its words, those inside contained windows, the items' ids as sorted strings."""
    texts = keyed(docs).withColumnRenamed("k2", "text_hash")
    cut = written(windows(benchmark, window), "windows")
    hits = written(contained(texts, cut, window, shingle, threshold, broadcast_rows), "hits")
    # a word counts once however many windows cover it
    end = F.col("start") + F.col("length")
    before = F.max(end).over(Window.partitionBy("doc_id", "text_hash").orderBy("start", "length", "window").rowsBetween(Window.unboundedPreceding, -1))
    covered = hits.withColumn("fresh", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(before, F.lit(0))))).groupBy("doc_id", "text_hash").agg(F.sum("fresh").alias("n_hit"))
    listed = (hits.select("doc_id", "text_hash", "window").distinct().join(cut.select("window", F.col("item_id").cast("string").alias("item")).distinct(), "window")
              .groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item")).alias("items")))
    found = (covered.join(listed.withColumnsRenamed({"doc_id": "id_", "text_hash": "hash_"}), F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_")))
             .select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"), "n_hit", "items"))
    rows = texts.select("doc_id", "text_hash", F.regexp_count("text", F.lit(_RAW_WORD)).cast("long").alias("n_words"))
    return (rows.join(found, rows.doc_id.eqNullSafe(found.id_) & (rows.text_hash == found.hash_), "left")
            .select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def clean_rows(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, threshold: float = 1.0,
               broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows that contain no window of an item, with all columns of ``docs``."""
    texts = keyed(docs).withColumnRenamed("k2", "text_hash")
    hits = contained(texts, written(windows(benchmark, window), "windows"), window, shingle, threshold, broadcast_rows)
    dirty = written(hits.select(F.coalesce("doc_id", F.lit(0)).alias("k1"), F.col("text_hash").alias("k2")).distinct(), "contaminated")
    return packed(docs).join(dirty, ["k1", "k2"], "left_anti").select("row.*")
