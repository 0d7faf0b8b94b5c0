"""The audit kept up to date by batch equals a full audit of the tables, and touches the buckets of its keys only."""

from __future__ import annotations

import datetime as dt
import glob
import random
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightmart.operators.quality import TABLE_NAMES, integrity_audit
from flightmart.plans import audit
from flightmart.sources import bucketed
from flightmart.sources.schemas import SCHEMAS
from flightmart.sources.tables import Tables
from tests.conftest import flight_row, make_tables

DAY = dt.date(2000, 5, 5)


def rows(df):
    return sorted((r["rule"], r["table_name"], r["key"] or "", r["key"] is None, r["n"]) for r in df.collect())


def files(path):
    return set(glob.glob(f"{path}/*/versions/**/*.parquet", recursive=True))



@pytest.fixture(scope="module")
def base(spark):
    flights = [flight_row(n, "A" if n % 3 else "B") for n in range(12)] + [flight_row(3), flight_row("x" * 25)]
    tickets = [(str(i), str(i % 14)) for i in range(60)] + [("7", "1"), (None, "2"), (None, None)]
    sold = [(str(i), f"c{i % 5}", "a1" if i % 3 else None, DAY) for i in range(0, 70)]
    return make_tables(spark, airline=[("A",), ("B",)], airport=[("X", "x"), ("Y", "y")], airplane=[("A", "P1", 9)],
                       flight=flights, ticket=tickets, purchases=sold, permission=frame(spark, "permission", [(None, "Admin"), ("s", "Operator")]))


def frame(spark, name, found):
    """Rows of a table, NULLs allowed everywhere, as in files that nobody checked."""
    return spark.createDataFrame(found, T.StructType([T.StructField(f.name, f.dataType) for f in SCHEMAS[name].fields]))


def as_rows(t):
    return {name: [tuple(r) for r in getattr(t, name).collect()] for name in TABLE_NAMES}


@pytest.fixture(scope="module")
def found(base):
    return rows(integrity_audit(base))


def test_batches_equal_a_full_audit(spark, base, found):
    path, held = tempfile.mkdtemp(prefix="flightmart-audit-"), as_rows(base)
    audit.start_audit(base, path, 4)
    assert rows(audit.read_violations(spark, path)) == found != []
    rnd = random.Random(4)
    new = {"ticket": lambda: (str(rnd.randrange(90)), str(rnd.randrange(16))), "purchases": lambda: (str(rnd.randrange(90)), f"c{rnd.randrange(9)}", rnd.choice([None, "a1", "a2"]), DAY),
           "flight": lambda: flight_row(rnd.randrange(20)), "permission": lambda: (rnd.choice([None, "s", "t" * 30]), "Admin"), "airport": lambda: (rnd.choice("XYZ"), "z")}
    for version in (1, 2):
        added, removed = {}, {}
        for name, make in new.items():
            added[name] = [make() for _ in range(rnd.randrange(6))]
            removed[name] = rnd.sample(held[name], min(len(held[name]), rnd.randrange(5)))  # parents and children leave
            for r in removed[name]:
                held[name].remove(r)
            held[name] += added[name]
        frames = [{name: frame(spark, name, part) for name, part in side.items()} for side in (added, removed)]
        audit.update_audit(spark, path, *frames, version)
        now = Tables(**{name: frame(spark, name, held[name]) for name in TABLE_NAMES})
        assert rows(audit.read_violations(spark, path)) == rows(integrity_audit(now)), version


def test_only_buckets_of_the_batch_are_written(spark, base):
    path = tempfile.mkdtemp(prefix="flightmart-audit-")
    audit.start_audit(base, path, 64)
    old = files(path)
    batch = {"purchases": spark.createDataFrame([("500", "c1", None, DAY)], SCHEMAS["purchases"])}
    touched = audit.update_audit(spark, path, batch, {}, 1)
    assert len(touched) <= 2
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in files(path) - old} <= touched and old <= files(path)
    assert ("fk", "purchases.ticket_id", "500", False, 1) in rows(audit.read_violations(spark, path))
    with pytest.raises(ValueError):
        audit.update_audit(spark, path, batch, {}, 3)  # batch 2 is missing
    assert audit.update_audit(spark, path, {}, {}, 2) == set()


def test_a_batch_that_was_killed_is_run_again(spark, base, found, monkeypatch):
    path = tempfile.mkdtemp(prefix="flightmart-audit-")
    audit.start_audit(base, path, 4)
    more = [("900", "1"), ("901", "nowhere")]
    batch = {"ticket": spark.createDataFrame(more, SCHEMAS["ticket"])}
    done, commit = [0], bucketed._commit

    def killed(*args):
        done[0] += 1
        if done[0] == at:
            raise RuntimeError("killed")
        commit(*args)

    monkeypatch.setattr(bucketed, "_commit", killed)
    for at in (1, 2):
        done[0] = 0
        with pytest.raises(RuntimeError):
            audit.update_audit(spark, path, batch, {}, 1)
        assert rows(audit.read_violations(spark, path)) == found
    at = 0
    audit.update_audit(spark, path, batch, {}, 1)
    assert rows(audit.read_violations(spark, path)) == sorted([*found, ("fk", "ticket.flight_num", "nowhere", False, 1)])


def test_hot_parents_and_empty_tables(spark):
    path = tempfile.mkdtemp(prefix="flightmart-audit-")
    audit.start_audit(make_tables(spark), path, 4)
    assert audit.read_violations(spark, path).collect() == []
    hot = {"ticket": spark.range(5000).selectExpr("CAST(id AS STRING) ticket_id", "'1' flight_num")}
    audit.update_audit(spark, path, hot, {}, 1)
    assert rows(audit.read_violations(spark, path)) == [("fk", "ticket.flight_num", "1", False, 5000)]
    counted = bucketed.read(spark, f"{path}/counts", audit.COUNTS).filter("rule = 'fk'").collect()
    assert [(r["key"], r["n"]) for r in counted] == [("1", 5000)]  # one row, however many children
    audit.update_audit(spark, path, {"flight": spark.createDataFrame([flight_row(1)], SCHEMAS["flight"])}, {}, 2)
    assert {r[1] for r in rows(audit.read_violations(spark, path))} == {"flight.airline_name", "flight.airplane_id", "flight.depart_name", "flight.arrive_name"}
    audit.update_audit(spark, path, {}, {"flight": spark.createDataFrame([flight_row(1)], SCHEMAS["flight"])}, 3)
    assert rows(audit.read_violations(spark, path)) == [("fk", "ticket.flight_num", "1", False, 5000)]


def test_a_batch_stores_the_counts_of_its_keys_only(spark, base):
    path = tempfile.mkdtemp(prefix="flightmart-audit-")
    audit.start_audit(base, path, 2)
    touched = audit.update_audit(spark, path, {"purchases": frame(spark, "purchases", [("500", "c1", None, DAY), ("501", "c1", None, DAY)])}, {}, 1)
    stored = spark.read.schema(audit.COUNTS).parquet(f"{path}/counts/versions/version=1").collect()
    assert sorted((r["table_name"], r["key"], r["n"]) for r in stored) == [
        ("purchases.customer_email", "c1", 2), ("purchases.ticket_id", "500", 1), ("purchases.ticket_id", "501", 1)]
    last, holds = bucketed.manifest(spark, f"{path}/counts")
    assert last == 1 and holds == {b: (0, 1) if b in touched else (0,) for b in range(2)}


@pytest.mark.parametrize("few", [0, 10**6])
def test_many_batches_are_summed_up(spark, base, few, monkeypatch):
    monkeypatch.setattr(audit, "FOLD", 2)
    monkeypatch.setattr(audit, "FEW", few)
    path, held = tempfile.mkdtemp(prefix="flightmart-audit-"), as_rows(base)
    audit.start_audit(base, path, 1)
    rnd, versions = random.Random(7), []
    for version in range(1, 4):
        added = [(rnd.choice(["7", "07", "x" * 30, "9" * 25, None]), rnd.choice(["1", "nowhere", None])) for _ in range(3)]
        removed = rnd.sample(held["ticket"], 3)
        for r in removed:
            held["ticket"].remove(r)
        held["ticket"] += added
        audit.update_audit(spark, path, {"ticket": frame(spark, "ticket", added)}, {"ticket": frame(spark, "ticket", removed)}, version)
        versions.append(bucketed.manifest(spark, f"{path}/counts")[1][0])
        assert rows(audit.read_violations(spark, path)) == rows(integrity_audit(Tables(**{name: frame(spark, name, held[name]) for name in TABLE_NAMES}))), version
    assert versions == [(0, 1), (2,), (2, 3)]


def test_packed_keys_come_back(spark):
    keys = ["", "0", "00", "007", "1234567890123456789012", "12\n", "12\r", "\u2028", "1\u2028", "١٢", "a1", "-1", "1 ", "é" * 30, None]
    df = spark.createDataFrame([(k,) for k in keys], "key string").select("key", audit._packed(F.col("key")).alias("packed"))
    found = df.select("key", "packed", audit._unpacked(F.col("packed")).alias("back")).collect()
    assert [r["back"] for r in found] == [r["key"] for r in found] == keys
    assert len({bytes(r["packed"]) for r in found if r["packed"] is not None}) == len(keys) - 1
