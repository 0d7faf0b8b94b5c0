"""Maintenance batch jobs.

O42 (registrations) has two constraints per agent record (email and b_id),
so its exact one-at-a-time result is computed in rounds: ``registration_state``
and ``registration_round`` here, looped by ``plans.jobs.registration_outcomes``.

The reference applies one form post at a time.  Each job here takes a table
of requests (``request_id`` and, where order matters, ``ts``) and returns one
outcome per request, plus the rows to append or the new table snapshot.
Requests are taken in (ts, request_id) order, so "the first valid request
of a key wins" and "the latest change wins" reproduce the sequential result.

Outcome codes are fixed strings (quirk Q21: codes, not the form texts).
An optional ``requester`` column (a staff username) switches on the
permission check: the requester must hold the job's permission and work for
the airline the request is about.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightmart.functions.ordering import id_chunk, previous_value
from flightmart.sources.schemas import (FLIGHT_COLUMNS, PERMISSION_ADMIN, PERMISSION_OPERATOR,
                                        PERMISSION_PLACEHOLDER, SCHEMAS, STATUSES)

# Outcome codes.
OK = "ok"
UPDATED = "updated"
UNCHANGED = "unchanged"
NOT_PERMITTED = "not_permitted"
EXISTING = "existing"
EXISTING_FLIGHT_NUM = "existing_flight_num"
SAME_AIRPORT = "same_airport"
BAD_TIME = "bad_time"
AIRPLANE_NOT_OWNED = "airplane_not_owned"
UNKNOWN_AIRPORT = "unknown_airport"
UNKNOWN_FLIGHT = "unknown_flight"
BAD_STATUS = "bad_status"
NOT_AN_INTEGER = "not_an_integer"
EXISTING_ID = "existing_id"
ALREADY_GRANTED = "already_granted"
UNKNOWN_USER = "unknown_user"
BAD_PERMISSION = "bad_permission"
UNKNOWN_AGENT = "unknown_agent"
UNKNOWN_AIRLINE = "unknown_airline"
EXISTING_B_ID = "existing_b_id"

# Status spelling used on creation mapped to the update spelling.
STATUS_ALIASES = {"delay": "delayed"}


def _order_cols(df: DataFrame) -> list[str]:
    return ["ts", "request_id"] if "ts" in df.columns else ["request_id"]


def _earlier_than_first(df: DataFrame, keys: Sequence[str], valid: str, out: str) -> DataFrame:
    """Flag ``out``: an earlier valid row of the same key exists (so this one comes too late)."""
    order = _order_cols(df)
    firsts = (df.filter(F.col(valid)).groupBy(*keys)
              .agg(F.min(F.struct(*order)).alias("_m")))
    joined = df.join(firsts, list(keys), "left")
    later = F.struct(*[F.col(c) for c in order]) > F.col("_m")
    return joined.withColumn(out, F.coalesce(later, F.lit(False))).drop("_m")


def _with_permission(requests: DataFrame, permission: DataFrame | None, airline_staff: DataFrame | None,
                     needed: str, airline_col: str | None) -> DataFrame:
    """Add ``_permitted``: the requester holds ``needed`` (and works for ``airline_col``'s airline)."""
    if "requester" not in requests.columns or permission is None or airline_staff is None:
        return requests.withColumn("_permitted", F.lit(True))
    staff = (airline_staff.select(F.col("username").alias("requester"), F.col("airline_name").alias("_req_airline"))
             .dropDuplicates(["requester"]))
    holders = (permission.filter(F.col("permission") == F.lit(needed))
               .select(F.col("username").alias("requester")).distinct()
               .join(staff, "requester"))
    r = requests.join(holders.withColumn("_holds", F.lit(True)), "requester", "left")
    ok = F.col("_holds").isNotNull()
    if airline_col is not None:
        ok = ok & F.coalesce(F.col("_req_airline") == F.col(airline_col), F.lit(False))
    return r.withColumn("_permitted", ok).drop("_holds", "_req_airline")


def normalize_status(col: Column) -> Column:
    expr = col
    for alias, canonical in STATUS_ALIASES.items():
        expr = F.when(col == F.lit(alias), F.lit(canonical)).otherwise(expr)
    return expr


# ---------------------------------------------------------------- O35 new flights

def load_new_flights(requests: DataFrame, flight: DataFrame, airplane: DataFrame, airport: DataFrame,
                     permission: DataFrame | None = None, airline_staff: DataFrame | None = None) -> DataFrame:
    """Outcome per new-flight request (request_id, flight_num, outcome).

    Checks in order: requester holds Admin for the airline (when given), same
    departure and arrival airport, arrival not after departure; then what an
    insert would meet: flight number exists (PK, also against earlier accepted
    requests of the batch), airplane not owned by the airline, unknown airport.
    """
    r = _with_permission(requests, permission, airline_staff, PERMISSION_ADMIN, "airline_name")
    in_table = flight.select("flight_num").distinct().withColumn("_in_table", F.lit(True))
    owned = airplane.select(F.col("id").alias("airplane_id"), "airline_name").distinct() \
        .withColumn("_owned", F.lit(True))
    names = airport.select("name").distinct()
    r = (r.join(in_table, "flight_num", "left")
         .join(owned, ["airplane_id", "airline_name"], "left")
         .join(names.withColumn("_dep_ok", F.lit(True)).withColumnRenamed("name", "depart_name"), "depart_name", "left")
         .join(names.withColumn("_arr_ok", F.lit(True)).withColumnRenamed("name", "arrive_name"), "arrive_name", "left"))
    other = (F.when(F.col("depart_name") == F.col("arrive_name"), F.lit(SAME_AIRPORT))
             .when(F.col("arrive_time") <= F.col("depart_time"), F.lit(BAD_TIME))
             .when(F.col("_owned").isNull(), F.lit(AIRPLANE_NOT_OWNED))
             .when(F.col("_dep_ok").isNull() | F.col("_arr_ok").isNull(), F.lit(UNKNOWN_AIRPORT)))
    r = r.withColumn("_other", other).withColumn(
        "_valid", F.col("_permitted") & F.col("_in_table").isNull() & F.col("_other").isNull())
    r = _earlier_than_first(r, ["flight_num"], "_valid", "_late")
    outcome = (F.when(~F.col("_permitted"), F.lit(NOT_PERMITTED))
               .when(F.col("_other").isin(SAME_AIRPORT, BAD_TIME), F.col("_other"))
               .when(F.col("_in_table").isNotNull() | F.col("_late"), F.lit(EXISTING_FLIGHT_NUM))
               .when(F.col("_other").isNotNull(), F.col("_other"))
               .otherwise(F.lit(OK)))
    return r.select("request_id", "flight_num", outcome.alias("outcome"))


def new_flight_rows(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows to append to flight for the accepted requests (status spelling normalised)."""
    ok = outcomes.filter(F.col("outcome") == OK).select("request_id")
    rows = requests.join(ok, "request_id", "left_semi")
    return rows.withColumn("flight_status", normalize_status(F.col("flight_status"))).select(*FLIGHT_COLUMNS)


# ---------------------------------------------------------------- O36 status changes

def status_decisions(changes: DataFrame, flight: DataFrame, permission: DataFrame | None = None,
                     airline_staff: DataFrame | None = None, chunk_units: Sequence[str] = ("day", "second")) -> DataFrame:
    """O36 core: (request_id, flight_num, ts, flight_status, outcome); a job writes it once for both results."""
    r = _with_permission(changes, permission, airline_staff, PERMISSION_OPERATOR, "airline_name")
    base = flight.select("flight_num", F.col("airline_name").alias("_flight_airline"),
                         F.col("flight_status").alias("_base_status"))
    r = (r.withColumn("flight_status", normalize_status(F.col("flight_status")))
         .join(base, "flight_num", "left"))
    known = F.coalesce(F.col("_flight_airline") == F.col("airline_name"), F.lit(False))
    good_status = F.col("flight_status").isin(*STATUSES)
    r = r.withColumn("_pre", F.when(~F.col("_permitted"), F.lit(NOT_PERMITTED))
                     .when(~known, F.lit(UNKNOWN_FLIGHT))
                     .when(~good_status, F.lit(BAD_STATUS)))
    # previous status of each valid change: lag inside (flight, time chunk)
    # pieces, carried across chunks (see functions.ordering)
    valid = previous_value(r.filter(F.col("_pre").isNull()), ["flight_num"], "flight_status",
                           ["ts", "request_id"], [F.date_trunc(u, F.col("ts")) for u in chunk_units], "_lag")
    valid = valid.withColumn("_prev", F.coalesce(F.col("_lag"), F.col("_base_status")))
    decided = valid.select("request_id", "flight_num", "ts", "flight_status",
                           F.when(F.col("_prev") == F.col("flight_status"), F.lit(UNCHANGED))
                           .otherwise(F.lit(UPDATED)).alias("outcome"))
    rejected = r.filter(F.col("_pre").isNotNull()).select(
        "request_id", "flight_num", "ts", "flight_status", F.col("_pre").alias("outcome"))
    return decided.unionByName(rejected)


def flight_status_outcomes(changes: DataFrame, flight: DataFrame, permission: DataFrame | None = None,
                           airline_staff: DataFrame | None = None, chunk_units: Sequence[str] = ("day", "second")) -> DataFrame:
    """O36 outcomes: per change request, updated / unchanged / a rejection code.

    "unchanged" means the requested status equals the flight's status at that
    moment (after the earlier changes of the batch).
    """
    return status_decisions(changes, flight, permission, airline_staff, chunk_units).select(
        "request_id", "flight_num", "outcome")


def apply_flight_status(changes: DataFrame, flight: DataFrame, permission: DataFrame | None = None,
                        airline_staff: DataFrame | None = None, chunk_units: Sequence[str] = ("day", "second")) -> DataFrame:
    """The flight table after the batch of status changes (latest valid change wins).

    P03 as a snapshot: flight left join (latest status per flight), coalesce.
    """
    return flights_after(status_decisions(changes, flight, permission, airline_staff, chunk_units), flight)


def flights_after(decisions: DataFrame, flight: DataFrame) -> DataFrame:
    """The flight table after decided status changes."""
    latest = (decisions.filter(F.col("outcome").isin(UPDATED, UNCHANGED))
              .groupBy("flight_num")
              .agg(F.max_by("flight_status", F.struct("ts", "request_id")).alias("_new_status")))
    cols = [F.coalesce(F.col("_new_status"), F.col("flight_status")).alias("flight_status")
            if c == "flight_status" else F.col(c) for c in flight.columns]
    return flight.join(latest, "flight_num", "left").select(*cols)


# ---------------------------------------------------------------- O37 airplanes

def load_new_airplanes(requests: DataFrame, airplane: DataFrame, permission: DataFrame | None = None,
                       airline_staff: DataFrame | None = None) -> DataFrame:
    """request_id, airplane_id, outcome.  Ids and seats must be integers
    (``try_cast``); the id is the airplane PK, compared as the canonical
    integer text (Q13 corrected); the first valid request of an id wins.
    """
    r = _with_permission(requests, permission, airline_staff, PERMISSION_ADMIN, "airline_name")
    id_num = F.expr("try_cast(airplane_id AS BIGINT)")
    seats_num = F.expr("try_cast(seats AS INT)")
    r = (r.withColumn("_id", id_num.cast("string"))
         .withColumn("_seats", seats_num)
         .withColumn("_is_int", F.col("_id").isNotNull() & F.col("_seats").isNotNull()))
    existing = airplane.select(F.col("id").alias("_id")).distinct().withColumn("_exists", F.lit(True))
    r = r.join(existing, "_id", "left").withColumn(
        "_valid", F.col("_permitted") & F.col("_is_int") & F.col("_exists").isNull())
    r = _earlier_than_first(r, ["_id"], "_valid", "_late")
    outcome = (F.when(~F.col("_permitted"), F.lit(NOT_PERMITTED))
               .when(~F.col("_is_int"), F.lit(NOT_AN_INTEGER))
               .when(F.col("_exists").isNotNull() | F.col("_late"), F.lit(EXISTING_ID))
               .otherwise(F.lit(OK)))
    return r.select("request_id", "airplane_id", outcome.alias("outcome"))


def new_airplane_rows(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    ok = outcomes.filter(F.col("outcome") == OK).select("request_id")
    return requests.join(ok, "request_id", "left_semi").select(
        "airline_name", F.expr("try_cast(airplane_id AS BIGINT)").cast("string").alias("id"),
        F.expr("try_cast(seats AS INT)").alias("seats"))


# ---------------------------------------------------------------- O38 airports

def load_new_airports(requests: DataFrame, airport: DataFrame, permission: DataFrame | None = None,
                      airline_staff: DataFrame | None = None) -> DataFrame:
    """request_id, name (upper-cased), city (upper-cased), outcome; existing names rejected.

    With a ``requester`` column the requester must hold Admin (any airline:
    airports are shared)."""
    keep = [c for c in ("ts", "requester") if c in requests.columns]
    r = requests.select("request_id", *keep, F.upper("name").alias("name"), F.upper("city").alias("city"))
    r = _with_permission(r, permission, airline_staff, PERMISSION_ADMIN, None)
    existing = airport.select("name").distinct().withColumn("_exists", F.lit(True))
    r = r.join(existing, "name", "left").withColumn("_valid", F.col("_permitted") & F.col("_exists").isNull())
    r = _earlier_than_first(r, ["name"], "_valid", "_late")
    outcome = (F.when(~F.col("_permitted"), F.lit(NOT_PERMITTED))
               .when(F.col("_exists").isNotNull() | F.col("_late"), F.lit(EXISTING)).otherwise(F.lit(OK)))
    return r.select("request_id", "name", "city", outcome.alias("outcome"))


# ---------------------------------------------------------------- O39 permissions

def permission_grant_outcomes(grants: DataFrame, permission: DataFrame, airline_staff: DataFrame) -> DataFrame:
    """O39 outcomes: request_id, username, permission, outcome.

    Rejects unknown staff, permissions other than Admin/Operator, and grants
    the user already holds (also from an earlier request of the batch).  With
    a ``requester`` column the requester must be an Admin of the grantee's
    airline.
    """
    staff = airline_staff.select("username", F.col("airline_name").alias("_grantee_airline")).dropDuplicates(
        ["username"]).withColumn("_staff", F.lit(True))
    held = permission.select("username", "permission").distinct().withColumn("_held", F.lit(True))
    r = grants.join(staff, "username", "left")
    r = _with_permission(r, permission, airline_staff, PERMISSION_ADMIN, "_grantee_airline")
    r = (r.join(held, ["username", "permission"], "left")
         .withColumn("_pre", F.when(~F.col("_permitted"), F.lit(NOT_PERMITTED))
                     .when(F.col("_staff").isNull(), F.lit(UNKNOWN_USER))
                     .when(~F.col("permission").isin(PERMISSION_ADMIN, PERMISSION_OPERATOR), F.lit(BAD_PERMISSION)))
         .withColumn("_valid", F.col("_pre").isNull() & F.col("_held").isNull()))
    r = _earlier_than_first(r, ["username", "permission"], "_valid", "_late")
    outcome = (F.when(F.col("_pre").isNotNull(), F.col("_pre"))
               .when(F.col("_held").isNotNull() | F.col("_late"), F.lit(ALREADY_GRANTED))
               .otherwise(F.lit(OK)))
    return r.select("request_id", "username", "permission", outcome.alias("outcome"))


def apply_permission_grants(grants: DataFrame, permission: DataFrame, airline_staff: DataFrame) -> DataFrame:
    """The permission table after the grants.

    Accepted grants are appended; the ``''`` placeholder of every user who
    received a grant is dropped (P04 as an anti join).
    """
    return permissions_after(permission_grant_outcomes(grants, permission, airline_staff), permission)


def permissions_after(outcomes: DataFrame, permission: DataFrame) -> DataFrame:
    """The permission table after decided grants."""
    added = outcomes.filter(F.col("outcome") == OK).select("username", "permission")
    granted_users = added.select("username").distinct()
    placeholders = permission.filter(F.col("permission") == F.lit(PERMISSION_PLACEHOLDER))
    kept_placeholders = placeholders.join(granted_users, "username", "left_anti")
    return (permission.filter(~F.col("permission").eqNullSafe(F.lit(PERMISSION_PLACEHOLDER)))
            .unionByName(kept_placeholders).unionByName(added))


# ---------------------------------------------------------------- O40 agents

def agent_decisions(moves: DataFrame, booking_agent: DataFrame, airline: DataFrame,
                    permission: DataFrame | None = None, airline_staff: DataFrame | None = None,
                    chunk_rows: Sequence[int] = (1_000_000, 10_000)) -> DataFrame:
    """O40 core: (request_id, email, airline_name, ts if given, outcome)."""
    base = booking_agent.select("email", F.col("airline_name").alias("_base_airline"), F.lit(True).alias("_known"))
    names = airline.select(F.col("name").alias("airline_name")).distinct().withColumn("_airline_ok", F.lit(True))
    r = _with_permission(moves, permission, airline_staff, PERMISSION_ADMIN, "airline_name")
    r = (r.join(base, "email", "left").join(names, "airline_name", "left")
         .withColumn("_pre", F.when(~F.col("_permitted"), F.lit(NOT_PERMITTED))
                     .when(F.col("_known").isNull(), F.lit(UNKNOWN_AGENT))
                     .when(F.col("_airline_ok").isNull(), F.lit(UNKNOWN_AIRLINE))))
    order = _order_cols(moves)
    chunks = ([F.date_trunc(u, F.col("ts")) for u in ("day", "second")] if "ts" in order
              else [id_chunk("request_id", n) for n in chunk_rows])
    valid = previous_value(r.filter(F.col("_pre").isNull()), ["email"], "airline_name", order, chunks, "_lag")
    valid = valid.withColumn("_prev", F.coalesce(F.col("_lag"), F.col("_base_airline")))
    decided = valid.select("request_id", "email", "airline_name", *[c for c in order if c != "request_id"],
                           F.when(F.col("_prev") == F.col("airline_name"), F.lit(UNCHANGED))
                           .otherwise(F.lit(UPDATED)).alias("outcome"))
    rejected = r.filter(F.col("_pre").isNotNull()).select(
        "request_id", "email", "airline_name", *[c for c in order if c != "request_id"], F.col("_pre").alias("outcome"))
    return decided.unionByName(rejected)


def agent_move_outcomes(moves: DataFrame, booking_agent: DataFrame, airline: DataFrame,
                        permission: DataFrame | None = None, airline_staff: DataFrame | None = None) -> DataFrame:
    """O40 outcomes: request_id, email, airline_name, outcome (unknown agent / airline, unchanged, updated).

    With a ``requester`` column the requester must be an Admin of the target airline."""
    return agent_decisions(moves, booking_agent, airline, permission, airline_staff).select(
        "request_id", "email", "airline_name", "outcome")


def assign_agents_to_airline(moves: DataFrame, booking_agent: DataFrame, airline: DataFrame,
                             permission: DataFrame | None = None, airline_staff: DataFrame | None = None) -> DataFrame:
    """The booking_agent table after the moves; the latest valid move per agent wins."""
    return agents_after(agent_decisions(moves, booking_agent, airline, permission, airline_staff), booking_agent)


def agents_after(decisions: DataFrame, booking_agent: DataFrame) -> DataFrame:
    """The booking_agent table after decided moves."""
    order = _order_cols(decisions)
    latest = (decisions.filter(F.col("outcome").isin(UPDATED, UNCHANGED)).groupBy("email")
              .agg(F.max_by("airline_name", F.struct(*order)).alias("_new_airline")))
    cols = [F.coalesce(F.col("_new_airline"), F.col("airline_name")).alias("airline_name")
            if c == "airline_name" else F.col(c) for c in booking_agent.columns]
    return booking_agent.join(latest, "email", "left").select(*cols)


# ---------------------------------------------------------------- O42 registrations

def registration_state(regs: DataFrame, customer: DataFrame, booking_agent: DataFrame,
                       airline_staff: DataFrame, airline: DataFrame) -> DataFrame:
    """Start of the exact (round-based) registration: table facts known, nothing decided.

    Carries per request whether its b_id / key is already in the tables and
    whether its airline is unknown; ``registration_round`` then decides
    records round by round (see ``plans.jobs.registration_outcomes``).
    """
    base = _registration_table_checks(regs, customer, booking_agent, airline_staff, airline)
    is_agent, is_staff = F.col("kind") == "agent", F.col("kind") == "staff"
    table_bid = is_agent & F.col("_bid_exists").isNotNull()
    table_key = F.col("_exists").isNotNull()
    bad_airline = (is_agent | is_staff) & F.col("_airline_ok").isNull()
    return base.select(
        "request_id", "ts", "kind", "key", "b_id",
        table_bid.alias("_table_bid"), table_key.alias("_table_key"), bad_airline.alias("_bad_airline"),
        (~table_bid & ~table_key & ~bad_airline).alias("_can_accept"),
        F.lit(None).cast("string").alias("outcome"))


def _registration_table_checks(regs, customer, booking_agent, airline_staff, airline) -> DataFrame:
    cust = customer.select(F.col("email").alias("key")).distinct().withColumn("kind", F.lit("customer"))
    agents = booking_agent.select(F.col("email").alias("key")).distinct().withColumn("kind", F.lit("agent"))
    staff = airline_staff.select(F.col("username").alias("key")).distinct().withColumn("kind", F.lit("staff"))
    existing = cust.unionByName(agents).unionByName(staff).withColumn("_exists", F.lit(True))
    b_ids = booking_agent.select(F.col("b_id").alias("_bid")).distinct().withColumn("_bid_exists", F.lit(True))
    names = airline.select(F.col("name").alias("airline_name")).distinct().withColumn("_airline_ok", F.lit(True))
    r = (regs.join(existing, ["kind", "key"], "left")
         .join(b_ids, (F.col("b_id") == F.col("_bid")) & (F.col("kind") == "agent"), "left")
         .join(names, "airline_name", "left"))
    is_agent, is_staff = F.col("kind") == "agent", F.col("kind") == "staff"
    unknown_airline = F.col("_airline_ok").isNull()
    pre = (F.when(is_staff & unknown_airline, F.lit(UNKNOWN_AIRLINE))
           .when(F.col("_exists").isNotNull(), F.lit(EXISTING))
           .when(is_agent & unknown_airline, F.lit(UNKNOWN_AIRLINE))
           .when(is_agent & F.col("_bid_exists").isNotNull(), F.lit(EXISTING_B_ID)))
    return r.withColumn("_pre", pre)


def registration_round(state: DataFrame) -> DataFrame:
    """One round of the exact batch rule (one-at-a-time order, decided in rounds).

    Reasons follow the per-kind precedence, with "already taken" meaning in
    the tables or by an earlier accepted record of the batch.  A reason is
    settled only when no earlier still-undecided record that could be
    accepted shares the key (or, for agents, the b_id); records that can
    never be accepted do not hold others back.  Per key and per b_id only
    the earliest accepted and the earliest open candidate matter, so a round
    is two aggregates and two joins, never pairs within a key.
    """
    order = F.struct("ts", "request_id")
    undecided = F.col("outcome").isNull()
    accepted = F.col("outcome") == F.lit(OK)
    open_candidate = undecided & F.col("_can_accept")
    by_key = (state.groupBy("kind", "key")
              .agg(F.min(F.when(accepted, order)).alias("_acc_k"),
                   F.min(F.when(open_candidate, order)).alias("_und_k")))
    by_bid = (state.filter(F.col("kind") == "agent").groupBy("b_id")
              .agg(F.min(F.when(accepted, order)).alias("_acc_b"),
                   F.min(F.when(open_candidate, order)).alias("_und_b"))
              .withColumn("kind", F.lit("agent")))
    s = state.join(by_key, ["kind", "key"], "left").join(by_bid, ["kind", "b_id"], "left")
    me = F.struct("ts", "request_id")
    before = lambda c: F.coalesce(F.col(c) < me, F.lit(False))
    wait = F.lit(None).cast("string")
    key_taken = F.col("_table_key") | before("_acc_k")
    agent = (F.when(key_taken, F.lit(EXISTING))
             .when(before("_und_k"), wait)
             .when(F.col("_bad_airline"), F.lit(UNKNOWN_AIRLINE))
             .when(F.col("_table_bid") | before("_acc_b"), F.lit(EXISTING_B_ID))
             .when(before("_und_b"), wait)
             .otherwise(F.lit(OK)))
    staff = (F.when(F.col("_bad_airline"), F.lit(UNKNOWN_AIRLINE))
             .when(key_taken, F.lit(EXISTING))
             .when(before("_und_k"), wait)
             .otherwise(F.lit(OK)))
    customer = F.when(key_taken, F.lit(EXISTING)).when(before("_und_k"), wait).otherwise(F.lit(OK))
    decided = (F.when(~undecided, F.col("outcome"))
               .when(F.col("kind") == "agent", agent)
               .when(F.col("kind") == "staff", staff)
               .otherwise(customer))
    return s.select("request_id", "ts", "kind", "key", "b_id", "_table_bid", "_table_key", "_bad_airline",
                    "_can_accept", decided.alias("outcome"))


def open_registrations(state: DataFrame) -> DataFrame:
    """The open records, with what settled records of the batch have taken before them."""
    order, accepted = F.struct("ts", "request_id"), F.col("outcome") == F.lit(OK)
    by_key = state.filter(accepted).groupBy("kind", "key").agg(F.min(order).alias("_acc_k"))
    by_bid = (state.filter(accepted & (F.col("kind") == "agent")).groupBy("b_id").agg(F.min(order).alias("_acc_b")).withColumn("kind", F.lit("agent")))
    s = state.filter(F.col("outcome").isNull()).join(by_key, ["kind", "key"], "left").join(by_bid, ["kind", "b_id"], "left")
    before = lambda c: F.coalesce(F.col(c) < F.struct("ts", "request_id"), F.lit(False))
    return s.select("request_id", "ts", "kind", "key", "b_id", (F.col("_table_key") | before("_acc_k")).alias("_key_taken"),
                    (F.col("_table_bid") | before("_acc_b")).alias("_bid_taken"), "_bad_airline")


def settle_in_order(records):
    """For applyInPandas: the outcomes of one component's open records, one after the other."""
    records = records.sort_values(["ts", "request_id"])
    keys, b_ids, outcomes = set(), set(), []
    for kind, key, b_id, key_taken, bid_taken, bad_airline in zip(
            *(records[c] for c in ("kind", "key", "b_id", "_key_taken", "_bid_taken", "_bad_airline")), strict=True):
        key_taken = key_taken or (kind, key) in keys
        if kind == "staff" and bad_airline:
            outcome = UNKNOWN_AIRLINE
        elif key_taken:
            outcome = EXISTING
        elif kind == "agent" and bad_airline:
            outcome = UNKNOWN_AIRLINE
        elif kind == "agent" and (bid_taken or b_id is not None and b_id in b_ids):
            outcome = EXISTING_B_ID
        else:
            outcome = OK
            keys.add((kind, key))
            if kind == "agent":
                b_ids.add(b_id)
        outcomes.append(outcome)
    return records[["request_id"]].assign(_settled=outcomes)


def registration_rows(regs: DataFrame, outcomes: DataFrame) -> dict[str, DataFrame]:
    """Rows to append per table for accepted registrations (staff also get a '' permission).

    Every column of the table (passwords are not carried) that the record has
    is kept; one that it lacks is NULL.
    """
    ok = regs.join(outcomes.filter(F.col("outcome") == OK).select("request_id"), "request_id", "left_semi")

    def rows(kind: str, table: str, key: str) -> DataFrame:
        cols = [F.col("key").alias(key) if f.name == key else
                F.col(f.name).cast(f.dataType).alias(f.name) if f.name in regs.columns else
                F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields]
        return ok.filter(F.col("kind") == kind).select(*cols)

    staff = rows("staff", "airline_staff", "username")
    return {
        "customer": rows("customer", "customer", "email"),
        "booking_agent": rows("agent", "booking_agent", "email"),
        "airline_staff": staff,
        "permission": staff.select("username", F.lit(PERMISSION_PLACEHOLDER).alias("permission")),
    }
