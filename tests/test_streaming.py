"""Micro-batch booking stream equals the sequential rule across batches."""

from __future__ import annotations

import datetime as dt
import tempfile

from flightmart.sources.tables import write_tables
from flightmart.streaming import bookings
from tests.conftest import flight_row, make_tables
from tests.test_booking import sequential

T0 = dt.datetime(2024, 1, 1)
REQ = "request_id long, ts timestamp_ntz, customer_email string, flight_num string"


def test_stream_matches_sequential(spark):
    work = tempfile.mkdtemp(prefix="flightmart-stream-")
    t = make_tables(spark, flight=[flight_row("F"), flight_row("G")],
                    airplane=[("A", "P1", 3)], ticket=[("5", "F")],
                    purchases=[("5", "c0", None, dt.date(2001, 1, 1))])
    write_tables(t, f"{work}/tables")
    reqs = [(i, T0 + dt.timedelta(minutes=i), f"c{i % 3}", "F" if i % 4 else "G") for i in range(12)]
    # three files -> three micro-batches (one file per trigger), in request order
    for k in range(3):
        spark.createDataFrame(reqs[4 * k:4 * k + 4], REQ).coalesce(1).write.parquet(f"{work}/in/part{k}")
    stream = (spark.readStream.schema(REQ).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
              .parquet(f"{work}/in"))
    q = bookings.start_booking_stream(spark, stream, f"{work}/tables", f"{work}/out", f"{work}/ckpt")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.request_id: r.status for r in bookings.read_outcomes(spark, f"{work}/out").collect()}
    expected = sequential(reqs, {"F": 3, "G": 3}, {"F": 1}, {("c0", "F")})
    assert got == expected
    new_ids = sorted(int(r.ticket_id) for r in spark.read.parquet(f"{work}/out/ticket").collect())
    assert new_ids == list(range(6, 6 + sum(1 for s in expected.values() if s == 1)))
