"""Batch jobs: the write side (P02 append, P03/P04 snapshot) around the operators.

Operators stay lazy; these functions are the actions.  Every job writes its
per-request outcomes first and reads them back, so that what follows starts at
a written table.  Appends are staged per batch and committed last
(``sources.ledger``): a job that is killed between any two writes and run again
gives the same outcomes and the same tables.  With a ``batch_id`` a batch that
has been committed is not run twice; its outcomes are read.  Updates and
deletes write the whole new table to a fresh folder (``write_snapshot``), since
plain Parquet has no MERGE; the changes are decided once, written, and read by
both the outcomes and the snapshot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightmart.functions.components import connected
from flightmart.operators import maintain as mt
from flightmart.session import ensure_checkpoint_dir
from flightmart.sources import ledger
from flightmart.sources.tables import Tables, read_tables, write_snapshot
from flightmart.streaming.bookings import process_batch

#: Rounds before the conflicts that are left are settled by components.
FIRST_ROUNDS = 2
#: Records of a component that one task settles in order; larger components go on in rounds.
FOLD_RECORDS = 20_000


def _written(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _load(spark: SparkSession, root: str, job: str, out: str, batch_id: int | None,
          decide: Callable[[Tables], DataFrame], rows: Callable[[DataFrame], dict[str, DataFrame]]) -> DataFrame:
    """One batch: outcomes to ``out``, their rows staged, the commit row last."""
    done = ledger.committed(spark, root)
    number = ledger.number(done, batch_id)
    if number in done:
        return spark.read.parquet(done[number]["outcomes"])
    outcomes = _written(spark, decide(read_tables(spark, root)), out)
    added = rows(outcomes)
    for table, df in added.items():
        ledger.stage(df, root, table, number)
    ledger.commit(spark, root, number, job, list(added), out)
    return outcomes


def book(spark: SparkSession, root: str, requests: DataFrame, out: str, batch_id: int,
         agent: bool = False, replay: bool = False) -> None:
    """O32-O34 as a job: decide, number the tickets, write new ticket/purchases rows under ``out``.

    ``out`` is the one history of all booking batches, direct and agent:
    a batch sees what all batches before it sold, and
    ``read_tables(root, bookings=out)`` shows every report the new sales.
    Batches are numbered upwards.  A number that has been committed is refused,
    unless ``replay`` says that this is the same batch again, which must then
    be the last; it rewrites its own rows.  One that was killed before its
    commit is simply run again.
    """
    last = max(ledger.committed(spark, out), default=-1)
    if batch_id < last or batch_id == last and not replay:
        raise ValueError(f"batch {batch_id} is not after the last one, {last}")
    process_batch(spark, requests, batch_id, root, out, agent)


def load_flights(spark: SparkSession, root: str, requests: DataFrame, out: str, batch_id: int | None = None) -> DataFrame:
    """O35 job: outcomes to ``out``; accepted flights appended to the flight table."""
    return _load(spark, root, "load_flights", out, batch_id,
                 lambda t: mt.load_new_flights(requests, t.flight, t.airplane, t.airport, t.permission, t.airline_staff),
                 lambda outcomes: {"flight": mt.new_flight_rows(requests, outcomes)})


def load_airplanes(spark: SparkSession, root: str, requests: DataFrame, out: str, batch_id: int | None = None) -> DataFrame:
    """O37 job: outcomes to ``out``; accepted airplanes appended."""
    return _load(spark, root, "load_airplanes", out, batch_id,
                 lambda t: mt.load_new_airplanes(requests, t.airplane, t.permission, t.airline_staff),
                 lambda outcomes: {"airplane": mt.new_airplane_rows(requests, outcomes)})


def load_airports(spark: SparkSession, root: str, requests: DataFrame, out: str, batch_id: int | None = None) -> DataFrame:
    """O38 job: outcomes to ``out``; accepted airports appended."""
    return _load(spark, root, "load_airports", out, batch_id,
                 lambda t: mt.load_new_airports(requests, t.airport, t.permission, t.airline_staff),
                 lambda outcomes: {"airport": outcomes.filter("outcome = 'ok'").select("name", "city")})


def _snapshot(spark: SparkSession, root: str, table: DataFrame, path: str) -> None:
    ledger.mark_snapshot(spark, path, max(ledger.committed(spark, root), default=-1))
    write_snapshot(table, path)


def change_statuses(spark: SparkSession, root: str, changes: DataFrame, new_flight_path: str, out: str) -> DataFrame:
    """O36 job: decisions to ``out``; the flight table after the changes, written as a new snapshot."""
    t = read_tables(spark, root)
    decisions = _written(spark, mt.status_decisions(changes, t.flight, t.permission, t.airline_staff), out)
    _snapshot(spark, root, mt.flights_after(decisions, t.flight), new_flight_path)
    return decisions.select("request_id", "flight_num", "outcome")


def grant_permissions(spark: SparkSession, root: str, grants: DataFrame, new_permission_path: str, out: str) -> DataFrame:
    """O39 job: outcomes to ``out``; permission table with the grants added and placeholders removed."""
    t = read_tables(spark, root)
    outcomes = _written(spark, mt.permission_grant_outcomes(grants, t.permission, t.airline_staff), out)
    _snapshot(spark, root, mt.permissions_after(outcomes, t.permission), new_permission_path)
    return outcomes


def move_agents(spark: SparkSession, root: str, moves: DataFrame, new_agent_path: str, out: str) -> DataFrame:
    """O40 job: decisions to ``out``; booking_agent table after the moves, as a new snapshot."""
    t = read_tables(spark, root)
    decisions = _written(spark, mt.agent_decisions(moves, t.booking_agent, t.airline, t.permission, t.airline_staff), out)
    _snapshot(spark, root, mt.agents_after(decisions, t.booking_agent), new_agent_path)
    return decisions.select("request_id", "email", "airline_name", "outcome")


def registration_outcomes(spark: SparkSession, regs: DataFrame, customer: DataFrame, booking_agent: DataFrame,
                          airline_staff: DataFrame, airline: DataFrame) -> DataFrame:
    """O42 outcomes with the exact one-at-a-time result.

    A round settles every record whose earlier conflicting records (same key,
    or same b_id for agents) are settled; two rounds settle nearly all.  What
    is open then hangs in chains of conflicts.  Their components are found by
    spreading labels (rounds grow with the logarithm of a chain's length), and
    each component is settled by one task in order; a component above
    ``FOLD_RECORDS`` records goes on in rounds.  The state is checkpointed
    (reliable checkpoint in ``spark.checkpoint.dir``), so the plan does not
    grow and a lost executor does not replay earlier rounds.
    """
    ensure_checkpoint_dir(spark)
    state = mt.registration_state(regs, customer, booking_agent, airline_staff, airline).checkpoint()
    rounds = 0
    while not state.filter("outcome IS NULL").isEmpty():
        state = (mt.registration_round(state) if rounds != FIRST_ROUNDS else settled_by_components(state)).checkpoint()
        rounds += 1
    return state.select("request_id", "kind", "key", "outcome")


def settled_by_components(state: DataFrame, most: int | None = None) -> DataFrame:
    """The state with the open records of all components of at most ``most`` records settled."""
    open_ = mt.open_registrations(state).checkpoint()
    node = F.concat_ws(":", "kind", "key")
    links = open_.select(node.alias("a"), F.when(F.col("kind") == "agent", F.concat(F.lit("b_id:"), "b_id")).alias("b"))
    labels = connected(links.select("a", F.coalesce("b", "a").alias("b")))
    dealt = open_.withColumn("_node", node).join(labels, F.col("_node") == F.col("node")).drop("_node", "node").checkpoint()
    sizes = dealt.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= (FOLD_RECORDS if most is None else most))
    settled = (dealt.join(sizes.select("label"), "label").groupBy("label")
               .applyInPandas(mt.settle_in_order, "request_id long, _settled string"))
    return (state.join(settled, "request_id", "left")
            .withColumn("outcome", F.coalesce("outcome", "_settled")).drop("_settled"))


def register(spark: SparkSession, root: str, regs: DataFrame, out: str, batch_id: int | None = None) -> DataFrame:
    """O42 job: outcomes to ``out``; accepted records appended to their tables."""
    return _load(spark, root, "register", out, batch_id,
                 lambda t: registration_outcomes(spark, regs, t.customer, t.booking_agent, t.airline_staff, t.airline),
                 lambda outcomes: mt.registration_rows(regs, outcomes))
