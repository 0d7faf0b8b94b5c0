"""Keyed updates rewrite the buckets of changed keys and nothing else."""

from __future__ import annotations

import glob
import tempfile

import pytest
from pyspark.sql import functions as F

from flightmart.operators import maintain as mt
from flightmart.sources import bucketed, fixtures, schemas
from tests.conftest import SF_SMALL, ts


def files(path):
    return set(glob.glob(f"{path}/versions/**/*.parquet", recursive=True))


def held(df):
    """The files whose rows a table has; version and bucket are partition filters, so no others are opened."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    return sorted({r[0] for r in df.select(F.input_file_name()).distinct().collect()})


def changes(spark, nums):
    rows = [(i, ts("2001-07-02 10:00:00"), al, num, "delayed") for i, (num, al) in enumerate(nums)]
    return spark.createDataFrame(rows, "request_id long, ts timestamp_ntz, airline_name string, flight_num string, flight_status string")


def test_a_small_change_set_rewrites_its_buckets_only(spark):
    flight = fixtures.load(spark, SF_SMALL).flight
    flight = flight.unionByName(flight.withColumn("flight_num", F.concat(F.lit("x"), "flight_num")))
    path = tempfile.mkdtemp(prefix="flightmart-bucketed-")
    bucketed.write(flight, path, "flight_num", 50)
    before = files(path)
    one = flight.orderBy("flight_num").select("flight_num", "airline_name").limit(2).collect()
    log = changes(spark, [(r["flight_num"], r["airline_name"]) for r in one] + [("nowhere", "A")])
    touched = bucketed.update(spark, path, schemas.FLIGHT, "flight_num", log,
                              lambda rows: mt.flights_after(mt.status_decisions(log, rows), rows))
    assert touched == {r["b"] for r in log.select(bucketed.bucket_of("flight_num", 50).alias("b")).collect()} and len(touched) <= 3
    new = files(path) - before
    assert before <= files(path) and {f.split("bucket=")[1].split("/")[0] for f in new} <= {str(b) for b in touched}
    after = bucketed.read(spark, path, schemas.FLIGHT)
    expected = mt.apply_flight_status(log, flight)
    assert sorted(map(repr, after.collect())) == sorted(map(repr, expected.select(*after.columns).collect()))
    # the table's files: those of untouched buckets as they were, the new ones of the others
    live = {f.removeprefix("file://") for f in held(after)}
    assert {f for f in live if "version=0" in f} == {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    # an update reads the buckets of its keys
    rows, numbers = bucketed.read_for(spark, path, schemas.FLIGHT, "flight_num", log)
    assert numbers == touched and {int(f.split("bucket=")[1].split("/")[0]) for f in held(rows)} <= touched


def test_deletes_empty_buckets_and_null_keys(spark):
    path = tempfile.mkdtemp(prefix="flightmart-bucketed-")
    table = spark.createDataFrame([("u1", ""), ("u1", "Admin"), ("u2", ""), (None, "Operator")], "username string, permission string")
    bucketed.write(table, path, "username", 8)
    keys = spark.createDataFrame([("u2",), (None,), ("u3",)], "username string")
    bucketed.update(spark, path, schemas.PERMISSION, "username", keys, lambda rows: rows.filter("username = 'u1'").unionByName(spark.createDataFrame([("u3", "Admin")], "username string, permission string")))
    assert sorted(map(tuple, bucketed.read(spark, path, schemas.PERMISSION).collect())) == [("u1", ""), ("u1", "Admin"), ("u3", "Admin")]
    assert bucketed.update(spark, path, schemas.PERMISSION, "username", keys.where("false"), lambda rows: rows) == set()
    bucketed.write(table, path, "username", 4)  # stored anew, in another number of buckets
    assert bucketed.read(spark, path, schemas.PERMISSION).count() == 4


def test_an_update_killed_before_its_manifest_is_not_seen(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="flightmart-bucketed-")
    table = spark.createDataFrame([(f"u{i}", "") for i in range(20)], "username string, permission string")
    bucketed.write(table, path, "username", 8)

    def grant():
        bucketed.update(spark, path, schemas.PERMISSION, "username", table.limit(3), lambda rows: rows.withColumn("permission", F.lit("Admin")))

    def state():
        return sorted(map(tuple, bucketed.read(spark, path, schemas.PERMISSION).collect()))

    start, real = state(), bucketed._commit
    monkeypatch.setattr(bucketed, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        grant()
    assert state() == start
    monkeypatch.setattr(bucketed, "_commit", real)
    grant()
    assert state() != start and len(state()) == 20 and ("u0", "Admin") in state()
