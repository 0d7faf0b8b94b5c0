"""The integrity audit (O41) kept up to date: reference counts by key, checked where a batch touches them.

The state is a table of counts in hash buckets of the key: copies of each
primary key, children of each referenced value by foreign key, NULLs in NOT
NULL columns and values that are too long (of key columns the counts say it).
A batch is a signed delta of it, whatever it does (inserts, updates as old and
new rows, deletes of parents or children).  The delta is written beside what its
buckets hold; the counts of its keys are looked up there, and these keys alone
are checked anew.  No table is read again, and the counts of other keys are
neither shuffled nor written.  After ``FOLD`` versions a bucket is summed up.

All counts of a key in a table and of the references to it are one row until
they are stored, so the first count is one shuffle, and a stored row says itself
whether it breaks a rule.  Digits travel two to a byte.

A hot parent (an airline, say) is one row for each foreign key, however many
children it has; its children are counted before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightmart.operators.quality import FOREIGN_KEYS, NOT_NULL, PRIMARY_KEYS, TABLE_NAMES
from flightmart.session import ensure_checkpoint_dir
from flightmart.sources import bucketed
from flightmart.sources.schemas import MAX_VARCHAR, SCHEMAS
from flightmart.sources.tables import Tables

COUNTS = T.StructType([*(T.StructField(name, T.StringType()) for name in ("rule", "table_name", "parent", "key")),
                       T.StructField("n", T.LongType()), T.StructField("copies", T.LongType())])  # copies: of the key in its parent, as a whole version knew it
VIOLATIONS = T.StructType([f for f in COUNTS.fields if f.name not in ("parent", "copies")])
_FOUND = T.StructType([*VIOLATIONS.fields, T.StructField("change", T.BooleanType())])  # change: n is what a batch added or, below 0, took away

FOLD = 16  # versions of a bucket that are read together
FEW = 4_000_000  # keys of a batch that every task may look up

_KEY_COLUMNS = {f"{table}.{c}" for table, c in PRIMARY_KEYS} | {f"{table}.{c}" for table, c, _, _ in FOREIGN_KEYS}
# A kind is a parent table, whose first slot counts its keys and the others the references by foreign key, or a rule for one column.
_KINDS = [[("pk", name, name, f"{name}.{c}"), *(("fk", f"{table}.{column}", name, f"{table}.{column}") for table, column, parent, _ in FOREIGN_KEYS if parent == name)]
          for name, c in PRIMARY_KEYS]
_KINDS += [[("not_null", f"{table}.{c}", None, None)] for table, c in NOT_NULL]
_KINDS += [[("length", f"{name}.{f.name}", None, None)] for name, schema in SCHEMAS.items() for f in schema.fields
           if isinstance(f.dataType, T.StringType) and f"{name}.{f.name}" not in _KEY_COLUMNS]
_PLACES = {(rule, table_name): (kind, slot) for kind, slots in enumerate(_KINDS) for slot, (rule, table_name, _, _) in enumerate(slots)}
_WIDTH = max(map(len, _KINDS))
_SLOTS = [f"n{i}" for i in range(_WIDTH)]


def _packed(key: Column) -> Column:
    """Two digits to a byte; the first byte says whether their number is odd, or that the text is no number."""
    digits = F.concat(F.when(F.length(key) % 2 == 1, F.lit(b"\1")).otherwise(F.lit(b"\0")), F.unhex(key))
    return F.when(key.rlike(r"^[0-9]+\z"), digits).otherwise(F.concat(F.lit(b"\2"), key.cast("binary")))


def _unpacked(key: Column) -> Column:
    first, rest = F.substring(key, 1, 1), F.substring(key, 2, 1 << 30)
    return F.when(first == F.lit(b"\2"), rest.cast("string")).when(first == F.lit(b"\1"), F.substring(F.hex(rest), 2, 1 << 30)).otherwise(F.hex(rest))


def _references(tables: Mapping[str, DataFrame], sign: int) -> DataFrame:
    """(kind, slot, key, n) of each key, reference and fault of these rows; each table is scanned once."""
    found = []
    for name, rows in tables.items():
        def place(rule: str, table_name: str, key: Column) -> Column:
            kind, slot = _PLACES[rule, table_name]
            return F.struct(F.lit(kind).alias("kind"), F.lit(slot).alias("slot"), key.cast("string").alias("key"))

        places = [place("pk", name, F.col(c)) for table, c in PRIMARY_KEYS if table == name]
        places += [F.when(F.col(c).isNotNull(), place("fk", f"{name}.{c}", F.col(c))) for table, c, _, _ in FOREIGN_KEYS if table == name]
        places += [F.when(F.col(c).isNull(), place("not_null", f"{name}.{c}", F.lit(None))) for table, c in NOT_NULL if table == name]
        places += [F.when(F.length(f.name) > MAX_VARCHAR, place("length", f"{name}.{f.name}", F.col(f.name)))
                   for f in SCHEMAS[name].fields if ("length", f"{name}.{f.name}") in _PLACES]
        found.append(rows.select(F.inline_outer(F.array(*places))).filter(F.col("kind").isNotNull()))
    return reduce(DataFrame.unionByName, found).select("kind", "slot", _packed(F.col("key")).alias("key"), F.lit(sign).cast("long").alias("n"))


def _by_key(references: DataFrame) -> DataFrame:
    """(kind, key, n0, n1, ...): one row for a key and all that refers to it, summed in one shuffle."""
    sums = [F.coalesce(F.sum(F.when(F.col("slot") == i, F.col("n"))), F.lit(0)).alias(c) for i, c in enumerate(_SLOTS)]
    return references.groupBy("kind", "key").agg(*sums)


def _counts(by_key: DataFrame) -> DataFrame:
    """The rows of ``COUNTS``: those that are not 0."""
    def named(field: int, slot: int) -> Column:
        names = [slots[slot][field] if slot < len(slots) else None for slots in _KINDS]
        return F.element_at(F.array(*(F.lit(x).cast("string") for x in names)), F.col("kind") + 1)

    rows = [F.when(F.col(c) != 0, F.struct(named(0, i).alias("rule"), named(1, i).alias("table_name"), named(2, i).alias("parent"), F.col("text").alias("key"),
                                           F.col(c).alias("n"), F.when(F.col("n0") != 0, F.col("n0")).alias("copies"))) for i, c in enumerate(_SLOTS)]
    return by_key.withColumn("text", _unpacked(F.col("key"))).select(F.inline_outer(F.array(*rows))).filter(F.col("rule").isNotNull())


def _again(counts: DataFrame) -> DataFrame:
    """(kind, slot, key, n) of stored counts or deltas."""
    at = F.element_at(F.create_map(*(F.lit(x) for (rule, table_name), (kind, slot) in _PLACES.items() for x in (f"{rule} {table_name}", kind * _WIDTH + slot))),
                      F.concat_ws(" ", "rule", "table_name"))
    return counts.select(F.floor(at / _WIDTH).cast("int").alias("kind"), (at % _WIDTH).alias("slot"), _packed(F.col("key")).alias("key"), "n")


def violations(counts: DataFrame) -> DataFrame:
    """(rule, table_name, key, n) of whole counts, as ``quality.integrity_audit`` reports them."""
    broken = F.when(F.col("rule") == "pk", F.col("n") > 1).when(F.col("rule") == "fk", F.col("copies").isNull()).otherwise(True)
    primary = F.create_map(*(F.lit(x) for slots in _KINDS if slots[0][0] == "pk" for x in (slots[0][1], slots[0][3])))
    column = F.when(F.col("rule") == "pk", F.element_at(primary, F.col("table_name"))).otherwise(F.col("table_name"))
    long = F.col("rule").isin("pk", "fk") & (F.length("key") > MAX_VARCHAR)
    found = F.array(F.when(broken, F.struct("rule", "table_name", "key", "n")),
                    F.when(long, F.struct(F.lit("length").alias("rule"), column.alias("table_name"), "key", "n")))
    return counts.select(F.inline_outer(found)).filter(F.col("rule").isNotNull())


def start_audit(t: Tables, path: str, buckets: int) -> None:
    """Count all references once; ``update_audit`` keeps counts and violations up to date."""
    spark = t.airline.sparkSession
    # a task of the sums writes a file for each bucket, rather than shuffle all counts again
    bucketed.write(_counts(_by_key(_references({name: getattr(t, name) for name in TABLE_NAMES}, 1))), f"{path}/counts", "key", buckets, 0, gather=False)
    found = violations(bucketed.read(spark, f"{path}/counts", COUNTS)).withColumn("change", F.lit(False))
    bucketed.write(found, f"{path}/violations", "key", buckets, 0, gather=False)


def update_audit(spark: SparkSession, path: str, added: Mapping[str, DataFrame], removed: Mapping[str, DataFrame], version: int) -> set[int]:
    """Bring the audit up to date after batch ``version`` (1, 2, ...); returns the numbers of the buckets that its keys lie in.

    ``added`` and ``removed`` hold rows by table name; a changed row is in
    both.  ``removed`` must be rows that the tables held.  The batch reads the
    version before its own, so one that was killed is run again as it was.
    """
    ensure_checkpoint_dir(spark)
    signed = [_references(rows, sign) for rows, sign in ((added, 1), (removed, -1)) if rows]
    if not signed:
        return set()
    delta = _counts(_by_key(reduce(DataFrame.unionByName, signed))).checkpoint()
    counts = f"{path}/counts"
    last, holds = bucketed.manifest(spark, counts, version - 1)
    if last != version - 1:
        raise ValueError(f"batch {version} follows batch {last}")
    held, touched = bucketed.read_for(spark, counts, COUNTS, "key", delta, upto=version - 1)
    bucket = bucketed.bucket_of("key", len(holds))
    if any(len(holds[b]) >= FOLD for b in touched):
        stored = _counts(_by_key(_again(held.unionByName(delta))))
        bucketed.replace(spark, counts, stored.withColumn("bucket", bucket), touched, version)
    else:
        bucketed.append(spark, counts, delta.withColumn("bucket", bucket), touched, version)
    found = _again(_of_keys(held, delta, "left_semi")).checkpoint()
    before, now = (violations(_counts(_by_key(rows))) for rows in (found, found.unionByName(_again(delta))))
    changes = _summed(now.unionByName(before.withColumn("n", -F.col("n")))).withColumn("change", F.lit(True))
    path = f"{path}/violations"
    if any(len(v) >= FOLD for b, v in bucketed.manifest(spark, path, version - 1)[1].items() if b in touched):
        old, _ = bucketed.read_for(spark, path, _FOUND, "key", delta, upto=version - 1)
        stored = _settled(old.unionByName(changes)).withColumn("change", F.lit(False))
        bucketed.replace(spark, path, stored.withColumn("bucket", bucket), touched, version)
    else:
        bucketed.append(spark, path, changes.withColumn("bucket", bucket), touched, version)
    return touched


def _of_keys(rows: DataFrame, of: DataFrame, how: str) -> DataFrame:
    """Rows of the keys of ``of``, or of the others; by hash: keys that share one with them are taken for theirs, with all of their rows."""
    keys = of.select(F.xxhash64("key").alias("_hash")).distinct().checkpoint()
    if keys.count() <= FEW:
        keys = F.broadcast(keys)
    return rows.withColumn("_hash", F.xxhash64("key")).join(keys, "_hash", how).drop("_hash")


def _summed(found: DataFrame) -> DataFrame:
    return found.groupBy("rule", "table_name", "key").agg(F.sum("n").alias("n")).filter(F.col("n") != 0)


def _settled(found: DataFrame) -> DataFrame:
    """Violations as the changes left them; those of other keys are not shuffled."""
    columns = VIOLATIONS.fieldNames()
    first, changes = found.filter(~F.col("change")).select(*columns), found.filter("change").select(*columns)
    return _of_keys(first, changes, "left_anti").unionByName(_summed(_of_keys(first, changes, "left_semi").unionByName(changes)))


def read_violations(spark: SparkSession, path: str) -> DataFrame:
    """All violations after the last batch."""
    ensure_checkpoint_dir(spark)
    return _settled(bucketed.read(spark, f"{path}/violations", _FOUND))
