"""Bookings as a stream: the reference's one-purchase-at-a-time flow, in micro-batches.

Each micro-batch of requests is decided with the batch operator (O32, or
O33 with prechecks) against the tables as they stand after all earlier
micro-batches, so the outcome equals the sequential order across batches.

Exactly-once without a transactional table format: everything a batch
writes goes to folders keyed by its batch id (``.../batch_id=N``), written
in overwrite mode, its commit row last (``sources.ledger``), and a batch reads
only the rows of committed batches before it.  A batch replayed after a failure
therefore rewrites the same folders and sees the same inputs, and readers never
see its tickets without its purchases.  The commit row keeps the largest ticket
id, so later batches number on from it and do not search the ticket table.  What earlier batches sold is kept as state, not searched for in their rows:
tickets sold per flight, and the pairs of customer and flight that are held, in
hash buckets of the flight (``sources.bucketed``).  A batch reads the buckets of
the flights it asks for, as the last committed batch left them, and writes them
as the version of its own number; so its reads grow neither with the number of
batches nor with the history, and a replay starts from the same state.

The annotated requests, then the decided requests, are
written and read back (a written table cuts the lineage) before the ranking,
the ids and the new rows are derived from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flightmart.operators import booking as bk
from flightmart.sources import bucketed, ledger
from flightmart.sources.schemas import TICKET
from flightmart.sources.tables import read_tables, with_batch_id

DECIDED = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("customer_email", T.StringType()),
    T.StructField("flight_num", T.StringType()),
    T.StructField("booking_agent_email", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("flight_rank", T.LongType()),
])


SOLD = T.StructType([T.StructField("flight_num", T.StringType()), T.StructField("sold", T.LongType())])
HELD = T.StructType([T.StructField("customer_email", T.StringType()), T.StructField("flight_num", T.StringType())])
STATE_BUCKETS = 64


def _start_state(spark: SparkSession, root: str, out: str, batch_id: int) -> None:
    """State version 0, from the base tables (and committed batches of a history that has no state yet)."""
    done = [n for n in ledger.committed(spark, out) if n < batch_id]
    if done and bucketed.exists(spark, f"{out}/state/held"):
        return
    t = read_tables(spark, root, bookings=out, before_batch=batch_id)
    bucketed.write(bk.sold_tickets(t.ticket), f"{out}/state/sold", "flight_num", STATE_BUCKETS, version=0)
    held = t.purchases.join(t.ticket, "ticket_id").select(*HELD.fieldNames()).distinct()
    bucketed.write(held, f"{out}/state/held", "flight_num", STATE_BUCKETS, version=0)


def process_batch(spark: SparkSession, requests: DataFrame, batch_id: int, root: str, out: str,
                  agent: bool = False) -> None:
    _start_state(spark, root, out, batch_id)
    t = read_tables(spark, root)
    if agent:
        requests = bk.agent_prechecks(requests, t.flight, t.booking_agent, t.customer)
    earlier = {n: r for n, r in ledger.committed(spark, out).items() if n < batch_id}
    upto = max((n + 1 for n in earlier), default=0)
    sold, touched = bucketed.read_for(spark, f"{out}/state/sold", SOLD, "flight_num", requests, upto)
    held, _ = bucketed.read_for(spark, f"{out}/state/held", HELD, "flight_num", requests, upto)
    # written once and read back: the ranking reads the annotated requests twice
    annotated_path = f"{out}/annotated/batch_id={batch_id}"
    bk.annotate_requests(requests, t.flight, t.airplane, t.ticket, t.purchases, sales=held, sold=sold).write.mode(
        "overwrite").parquet(annotated_path)
    decided = bk.rank_requests(spark.read.parquet(annotated_path))
    if "booking_agent_email" not in decided.columns:
        decided = decided.withColumn("booking_agent_email", F.lit(None).cast("string"))
    decided.select(*DECIDED.fieldNames()).write.mode("overwrite").parquet(f"{out}/decided/batch_id={batch_id}")
    decided = spark.read.schema(DECIDED).parquet(f"{out}/decided/batch_id={batch_id}")
    last = max(int(r["last_id"]) for r in earlier.values()) if earlier else int(bk.last_ticket_id(t.ticket).first()["m"])
    ids = bk.assign_ticket_ids(decided, t.ticket, after=last)
    new_tickets, new_purchases = bk.booking_rows(decided, ids)
    new_tickets.write.mode("overwrite").parquet(f"{out}/ticket/batch_id={batch_id}")
    new_purchases.write.mode("overwrite").parquet(f"{out}/purchases/batch_id={batch_id}")
    new_tickets = spark.read.schema(TICKET).parquet(f"{out}/ticket/batch_id={batch_id}")
    booked = decided.filter(F.col("status") == bk.BOOKED).select(*HELD.fieldNames())
    for name, rows in (("sold", sold.unionByName(bk.sold_tickets(booked)).groupBy("flight_num").agg(F.sum("sold").alias("sold"))), ("held", held.unionByName(booked).distinct())):
        if touched:
            bucketed.replace(spark, f"{out}/state/{name}", rows.withColumn("bucket", bucketed.bucket_of("flight_num", STATE_BUCKETS)), touched, batch_id + 1)
    new = int(bk.last_ticket_id(new_tickets).first()["m"])
    ledger.commit(spark, out, batch_id, "book", ["ticket", "purchases"], last_id=str(max(last, new)))


def start_booking_stream(spark: SparkSession, requests: DataFrame, root: str, out: str, checkpoint: str,
                         agent: bool = False, trigger: dict | None = None) -> StreamingQuery:
    """Run ``process_batch`` for every micro-batch of the ``requests`` stream.

    ``root`` holds the ten tables (``read_tables`` layout); ``out`` receives
    the decided requests and the new ticket / purchases rows per batch.
    """
    writer = (requests.writeStream
              .foreachBatch(lambda df, batch_id: process_batch(spark, df, batch_id, root, out, agent))
              .option("checkpointLocation", checkpoint))
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start()


def read_outcomes(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(with_batch_id(DECIDED)).parquet(f"{out}/decided")
