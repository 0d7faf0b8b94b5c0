"""Derive the airline tables from the TPC-H-like test Parquet.

The mapping is fixed by FIXTURES.md; the same expressions are written once
more in SQL for the DuckDB oracle (``flightmart/oracle.py``).  Everything is
lazy: the ten tables are plans over the scans, so column pruning and filter
pushdown reach the source files.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightmart.sources.tables import Tables

# Fixed values of the test mapping (FIXTURES.md).
FIRST_DEPARTURE = "1995-01-01 00:00:00"
STATUS_CUTOFF = "2001-07-01 00:00:00"
AS_OF = dt.date(2001, 7, 1)
N_AIRLINES = 25


# Declared schemas of the raw test tables: reading with a schema skips the
# footer-inference job per file and fixes the types (timestamps are NTZ).
RAW_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _ticket_id(parts: int, suppliers: int) -> Column:
    """One decimal number from a line's four keys; the radices follow the tables, so ids never collide."""
    def wide(c: Column) -> Column:
        return c.cast("decimal(38,0)")

    parts, suppliers = wide(F.lit(parts)), wide(F.lit(suppliers))
    line = wide(F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return wide(wide(wide(line * parts) + wide(F.col("l_partkey"))) * suppliers + wide(F.col("l_suppkey"))).cast("string")


def _permission_of(suppkey: Column) -> Column:
    m = suppkey % 3
    return F.when(m == 0, F.lit("Admin")).when(m == 1, F.lit("Operator")).otherwise(F.lit(""))


def _agent_airline(suppkey: Column) -> Column:
    return F.concat(F.lit("Brand#"), (suppkey % N_AIRLINES + 1).cast("string"))


def load(spark: SparkSession, sf_dir: str) -> Tables:
    region = _read(spark, sf_dir, "region")
    nation = _read(spark, sf_dir, "nation")
    part = _read(spark, sf_dir, "part")
    lineitem = _read(spark, sf_dir, "lineitem")
    orders = _read(spark, sf_dir, "orders")
    customer = _read(spark, sf_dir, "customer")
    supplier = _read(spark, sf_dir, "supplier")
    # two numbers, read once as the tables are loaded, instead of subqueries in every plan
    ticket_id = _ticket_id((part.agg(F.max("p_partkey")).first()[0] or 0) + 1, (supplier.agg(F.max("s_suppkey")).first()[0] or 0) + 1)

    airline = part.select(F.col("p_brand").alias("name")).distinct()

    nation_region = nation.join(region, nation.n_regionkey == region.r_regionkey)
    airport = nation_region.select(F.col("n_name").alias("name"), F.col("r_name").alias("city"))

    airplane = part.select(
        F.col("p_brand").alias("airline_name"),
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_size").cast("int").alias("seats"),
    )

    dep = nation.select(F.col("n_nationkey").alias("dep_key"), F.col("n_name").alias("depart_name"))
    arr = nation.select(F.col("n_nationkey").alias("arr_key"), F.col("n_name").alias("arrive_name"))
    depart_time = F.timestamp_add(
        "HOUR", (F.col("p_partkey") * 37 % 2500) * 24 + F.col("p_partkey") % 24, _ts(FIRST_DEPARTURE))
    flight = (
        part.withColumn("dep_key", (F.col("p_partkey") % 25).cast("int"))
        .withColumn("arr_key", ((F.col("p_partkey") + 1 + F.col("p_size") % 24) % 25).cast("int"))
        .join(dep, "dep_key")
        .join(arr, "arr_key")
        .withColumn("depart_time", depart_time)
        .select(
            F.col("p_partkey").cast("string").alias("flight_num"),
            F.col("p_brand").alias("airline_name"),
            F.col("p_partkey").cast("string").alias("airplane_id"),
            "depart_name",
            "arrive_name",
            "depart_time",
            F.timestamp_add("HOUR", 1 + F.col("p_size") % 12, F.col("depart_time")).alias("arrive_time"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
            F.when(F.col("depart_time") > _ts(STATUS_CUTOFF), F.lit("upcoming"))
            .when(F.col("p_size") % 5 == 0, F.lit("delayed"))
            .otherwise(F.lit("in-progress"))
            .alias("flight_status"),
        )
    )

    ticket = lineitem.select(
        ticket_id.alias("ticket_id"),
        F.col("l_partkey").cast("string").alias("flight_num"),
    )

    # an order's customer is found once for the order, not for each of its lines
    buyer = orders.select("o_orderkey", "o_custkey", "o_orderdate").join(
        customer.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    purchases = (
        lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
        .join(buyer.select("o_orderkey", "c_name", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            ticket_id.alias("ticket_id"),
            F.col("c_name").alias("customer_email"),
            F.when(F.col("l_returnflag") == "R", F.lit(None).cast("string"))
            .otherwise(F.col("s_name")).alias("booking_agent_email"),
            F.col("o_orderdate").cast("date").alias("p_date"),
        )
    )

    cust_nation = nation_region.select("n_nationkey", "n_name", "r_name")
    customer_t = customer.join(cust_nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_name").alias("email"),
        F.col("c_name").alias("name"),
        F.col("c_custkey").cast("long").alias("building_number"),
        F.concat(F.lit("Street "), F.col("c_custkey").cast("string")).alias("street"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
        (F.col("c_custkey") + 10_000_000_000).cast("decimal(20,0)").alias("phone_number"),
        F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("passport_number"),
        F.date_add(F.lit(dt.date(2030, 1, 1)), F.col("c_custkey").cast("int")).alias("passport_expiration"),
        F.col("n_name").alias("passport_country"),
        F.date_add(F.lit(dt.date(1950, 1, 1)), F.col("c_custkey").cast("int")).alias("date_of_birth"),
    )

    booking_agent = supplier.select(
        F.col("s_name").alias("email"),
        F.col("s_suppkey").cast("string").alias("b_id"),
        _agent_airline(F.col("s_suppkey")).alias("airline_name"),
    )

    airline_staff = supplier.select(
        F.concat(F.lit("staff-"), F.col("s_name")).alias("username"),
        _agent_airline(F.col("s_suppkey")).alias("airline_name"),
        F.concat(F.lit("First"), F.col("s_suppkey").cast("string")).alias("first_name"),
        F.concat(F.lit("Last"), F.col("s_suppkey").cast("string")).alias("last_name"),
        F.date_add(F.lit(dt.date(1960, 1, 1)), F.col("s_suppkey").cast("int")).alias("date_of_birth"),
    )

    permission = supplier.select(
        F.concat(F.lit("staff-"), F.col("s_name")).alias("username"),
        _permission_of(F.col("s_suppkey")).alias("permission"),
    )

    return Tables(
        airline=airline,
        airport=airport,
        airplane=airplane,
        flight=flight,
        ticket=ticket,
        purchases=purchases,
        customer=customer_t,
        booking_agent=booking_agent,
        airline_staff=airline_staff,
        permission=permission,
    )


# ---------------------------------------------------------------- request tables
# Batch-job inputs derived from the ``events`` table (and others), so that the
# batch jobs' work grows with the data like the reports'.

# One flight draws a third of the requests, all within one hour (a sale opening).
HOT_FLIGHT = 7
HOT_HOUR = "2000-06-01 10:00:00"


def _requests(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    """Events of a type with a flight key: the lowest part of the order whose key is
    event_id (event_id itself without such an order), so requested flights grow
    with the data; every third run of three events asks for the hot flight."""
    events = _read(spark, sf_dir, "events").filter(F.col("event_type") == event_type)
    first_line = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_partkey").alias("_part"), F.min("l_suppkey").alias("line_supplier"))
    hot = F.floor(F.col("event_id") / 3) % 3 == 0
    opened = F.timestamp_add("SECOND", F.col("event_id") * 7919 % 3600, _ts(HOT_HOUR))
    return (events.join(first_line, events.event_id == first_line.l_orderkey, "left")
            .withColumn("flight_key", F.when(hot, F.lit(HOT_FLIGHT)).otherwise(F.coalesce("_part", "event_id")))
            .withColumn("ts", F.when(hot, opened).otherwise(F.col("ts"))))


def booking_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct booking requests: purchase events; customer of key user_id."""
    events = _requests(spark, sf_dir, "purchase")
    customer = _read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return events.join(customer, events.user_id == customer.c_custkey).select(
        F.col("event_id").alias("request_id"),
        "ts",
        F.col("c_name").alias("customer_email"),
        F.col("flight_key").cast("string").alias("flight_num"),
    )


def _per_airline(spark: SparkSession, sf_dir: str) -> int:
    """Suppliers of an airline (4 at least), so that requesters grow with the table."""
    return max(4, ((_read(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0] or 0) + 1) // N_AIRLINES)


def _staff_key(spark: SparkSession, sf_dir: str, brand: str, request: str) -> Column:
    """Key of a supplier whose airline is ``brand``: (brand number - 1) + 25 * (request % suppliers of an airline)."""
    return F.regexp_extract(F.col(brand), r"(\d+)$", 1).cast("bigint") - 1 + N_AIRLINES * (F.col(request) % _per_airline(spark, sf_dir))


def _agent_requests(spark: SparkSession, sf_dir: str, agent_key: Column) -> DataFrame:
    """Click events; every 11th customer unknown; the agent may use p_brand of the flight."""
    events = _requests(spark, sf_dir, "click")
    customer = _read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    supplier = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    keyed = (events.join(customer, events.user_id == customer.c_custkey)
             .join(part, F.col("flight_key") == F.col("p_partkey"), "left")
             .withColumn("_agent_key", agent_key))
    return (keyed.join(supplier, keyed._agent_key == supplier.s_suppkey, "left")
            .select(
                F.col("event_id").alias("request_id"),
                "ts",
                F.col("s_name").alias("booking_agent_email"),
                F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("unknown-"), F.col("user_id").cast("string")))
                .otherwise(F.col("c_name")).alias("customer_email"),
                F.col("flight_key").cast("string").alias("flight_num"),
            ))


def agent_booking_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent booking requests: every fifth by the supplier of the event's order (mostly of another
    airline; NULL without an order), the others by an agent of the flight's airline."""
    own = _staff_key(spark, sf_dir, "p_brand", "event_id")
    return _agent_requests(spark, sf_dir, F.when(F.col("event_id") % 5 == 0, F.col("line_supplier")).otherwise(own))


def agent_booking_requests_same_airline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent booking requests whose agent works for the flight's airline (NULL when that supplier does not exist)."""
    return _agent_requests(spark, sf_dir, _staff_key(spark, sf_dir, "p_brand", "event_id"))


def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status change requests: view events with the flight's airline
    (a wrong airline every 13th); status by event_id % 3, with the creation
    spelling ``delay`` for 2."""
    events = _requests(spark, sf_dir, "view")
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    m = F.col("event_id") % 3
    return (events.join(part, events.flight_key == part.p_partkey, "left")
            .select(
                F.col("event_id").alias("request_id"),
                "ts",
                F.when(F.col("event_id") % 13 == 0, F.lit("Brand#0")).otherwise(F.col("p_brand")).alias("airline_name"),
                F.col("flight_key").cast("string").alias("flight_num"),
                F.when(m == 0, F.lit("upcoming")).when(m == 1, F.lit("in-progress")).otherwise(F.lit("delay"))
                .alias("flight_status"),
            ))


def status_changes_with_requester(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``status_changes`` plus a requester: a staff member of the flight's airline
    (``_staff_key``; NULL when missing)."""
    changes = status_changes(spark, sf_dir)
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    supplier = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    keyed = (changes.join(part, changes.flight_num.cast("bigint") == part.p_partkey, "left")
             .withColumn("_staff_key", _staff_key(spark, sf_dir, "p_brand", "request_id")))
    return (keyed.join(supplier, keyed._staff_key == supplier.s_suppkey, "left")
            .select(*changes.columns, F.concat(F.lit("staff-"), F.col("s_name")).alias("requester")))


def new_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New-flight requests, one per order (flight_num = order key)."""
    orders = _read(spark, sf_dir, "orders")
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    nation = _read(spark, sf_dir, "nation")
    dep = nation.select(F.col("n_nationkey").alias("_dk"), F.col("n_name").alias("depart_name"))
    arr = nation.select(F.col("n_nationkey").alias("_ak"), F.col("n_name").alias("arrive_name"))
    depart = F.timestamp_add("HOUR", F.col("o_orderkey") % 24, F.col("o_orderdate"))
    return (orders.join(part, orders.o_custkey == part.p_partkey, "left")
            .join(dep, (orders.o_custkey % 25) == dep._dk)
            .join(arr, (orders.o_orderkey % 25) == arr._ak)
            .select(
                F.col("o_orderkey").alias("request_id"),
                F.col("o_orderdate").alias("ts"),
                F.col("o_orderkey").cast("string").alias("flight_num"),
                F.when(F.col("o_orderkey") % 30 == 0, F.lit("Brand#1")).otherwise(F.col("p_brand")).alias("airline_name"),
                F.col("o_custkey").cast("string").alias("airplane_id"),
                "depart_name",
                "arrive_name",
                depart.alias("depart_time"),
                F.timestamp_add("HOUR", F.col("o_orderkey") % 7 - 1, depart).alias("arrive_time"),
                (F.floor("o_totalprice") / 100).cast("decimal(10,2)").alias("price"),
                F.lit("upcoming").alias("flight_status"),
            ))


def new_flights_with_requester(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``new_flights`` plus a requester: a staff member of the request's airline
    (``_staff_key``; NULL when missing)."""
    reqs = new_flights(spark, sf_dir)
    supplier = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    keyed = reqs.withColumn("_staff_key", _staff_key(spark, sf_dir, "airline_name", "request_id"))
    return (keyed.join(supplier, keyed._staff_key == supplier.s_suppkey, "left")
            .select(*reqs.columns, F.concat(F.lit("staff-"), F.col("s_name")).alias("requester")))


def saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved searches from error events, by the event's flight: event_id % 8 says which criteria are named.

    ``departure_date`` is the flight's day, every fifth time the next one;
    ``from_date`` and ``until_date`` are bounds up to two weeks apart.
    """
    t = load(spark, sf_dir)
    city = t.airport
    events = _requests(spark, sf_dir, "error").withColumn("_num", F.col("flight_key").cast("string"))
    customer = _read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    f = (t.flight.join(city.select(F.col("name").alias("depart_name"), F.col("city").alias("_dep_city")), "depart_name")
         .join(city.select(F.col("name").alias("arrive_name"), F.col("city").alias("_arr_city")), "arrive_name"))
    e, k = F.col("event_id"), F.col("event_id") % 8
    day = F.col("depart_time").cast("date")

    def named(value: Column, *kinds: int) -> Column:
        return F.when(k.isin(*kinds), value)

    return (events.join(f, events["_num"] == f["flight_num"]).join(customer, F.col("user_id") == F.col("c_custkey"), "left").select(
        e.alias("search_id"), F.col("c_name").alias("customer_email"),
        named(F.col("flight_num"), 0, 7).alias("flight_num"),
        F.when(k == 4, F.lit("")).otherwise(named(F.col("depart_name"), 1, 5)).alias("departure_airport"),
        named(F.col("arrive_name"), 2, 5).alias("arrival_airport"),
        named(F.col("airline_name"), 6).alias("airline_name"),
        named(F.col("_dep_city"), 3, 7).alias("departure_city"),
        named(F.col("_arr_city"), 3, 6).alias("arrival_city"),
        named(F.date_add(day, F.when(e % 5 == 0, F.lit(1)).otherwise(F.lit(0))), 1, 3, 4, 5).alias("departure_date"),
        named(F.col("arrive_time").cast("date"), 2, 6).alias("arrival_date"),
        named(F.date_sub(day, (e % 4).cast("int")), 1, 3, 4, 5).alias("from_date"),
        named(F.date_add(day, (e % 4 + 1).cast("int")), 2, 3, 4, 6).alias("until_date")))


def bounded_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``saved_searches`` with the bounds as dates; a flight's route is added where the search would be open."""
    s = saved_searches(spark, sf_dir)
    return s.withColumns({"departure_date": F.col("from_date"), "arrival_date": F.col("until_date")})


def new_airplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New-airplane requests from suppliers; every 7th id is not an integer."""
    s = _read(spark, sf_dir, "supplier")
    plain = (F.col("s_suppkey") * 50).cast("string")
    return s.select(
        F.col("s_suppkey").alias("request_id"),
        _agent_airline(F.col("s_suppkey")).alias("airline_name"),
        F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("x"), plain)).otherwise(plain).alias("airplane_id"),
        (F.col("s_suppkey") % 50 + 1).cast("string").alias("seats"),
    )


def new_airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New-airport requests, one per customer: the lower-cased name of the
    customer's nation (already an airport) for even keys, ``Port <k % n>``
    (new, repeated across customers; n a tenth of the customers, 97 at least) for odd keys; city = lower-cased region."""
    customer = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = _read(spark, sf_dir, "nation")
    region = _read(spark, sf_dir, "region")
    k, ports = F.col("c_custkey"), max(97, customer.count() // 10)
    return (customer.join(nation, customer.c_nationkey == nation.n_nationkey)
            .join(region, nation.n_regionkey == region.r_regionkey)
            .select(
                k.cast("long").alias("request_id"),
                F.when(k % 2 == 0, F.lower("n_name"))
                .otherwise(F.concat(F.lit("Port "), (k % ports).cast("string"))).alias("name"),
                F.lower("r_name").alias("city"),
            ))


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permission grants: Admin for even suppliers, Operator for odd; some bad names and users."""
    s = _read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("request_id"),
        F.when(k % 13 == 7, F.concat(F.lit("staff-nobody-"), k.cast("string")))
        .otherwise(F.concat(F.lit("staff-"), F.col("s_name"))).alias("username"),
        F.when(k % 11 == 5, F.lit("Root")).when(k % 2 == 0, F.lit("Admin")).otherwise(F.lit("Operator"))
        .alias("permission"),
    )


def agent_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent moves, two rounds per agent: odd agents move to the next airline and
    are then asked to move there again (unchanged); some unknown agents and airlines."""
    s = _read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    email = F.when(k % 9 == 4, F.concat(F.lit("Unknown#"), k.cast("string"))).otherwise(F.col("s_name"))
    first = s.select(
        (2 * k).alias("request_id"), email.alias("email"),
        F.when(k % 17 == 3, F.lit("Brand#99"))
        .otherwise(F.concat(F.lit("Brand#"), ((k + k % 2) % N_AIRLINES + 1).cast("string"))).alias("airline_name"))
    second = s.select(
        (2 * k + 1).alias("request_id"), email.alias("email"),
        F.concat(F.lit("Brand#"), ((k + 1) % N_AIRLINES + 1).cast("string")).alias("airline_name"))
    return first.unionByName(second)


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups from signup events: kind by event_id % 3; about half the keys exist."""
    e = _read(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    kind = F.when(F.col("event_id") % 3 == 0, F.lit("customer")) \
        .when(F.col("event_id") % 3 == 1, F.lit("agent")).otherwise(F.lit("staff"))
    uid = F.col("user_id")
    key = (F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Customer#"), F.lpad((uid * 20).cast("string"), 9, "0")))
           .when(F.col("event_id") % 3 == 1, F.concat(F.lit("Supplier#"), F.lpad(uid.cast("string"), 9, "0")))
           .otherwise(F.concat(F.lit("staff-Supplier#"), F.lpad(uid.cast("string"), 9, "0"))))
    is_cust = F.col("event_id") % 3 == 0
    return e.select(
        F.col("event_id").alias("request_id"), "ts", kind.alias("kind"), key.alias("key"), key.alias("name"),
        F.when(is_cust, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Brand#"), (F.col("event_id") % 30 + 1).cast("string"))).alias("airline_name"),
        F.when(F.col("event_id") % 3 == 1, (uid + 50).cast("string")).alias("b_id"),
        uid.alias("building_number"), F.concat(F.lit("Street "), uid.cast("string")).alias("street"),
        F.lit("City").alias("city"), F.lit("State").alias("state"),
        (uid + 20_000_000_000).cast("decimal(20,0)").alias("phone_number"),
        F.concat(F.lit("N"), uid.cast("string")).alias("passport_number"),
        F.lit(dt.date(2031, 1, 1)).alias("passport_expiration"), F.lit("Country").alias("passport_country"),
        F.concat(F.lit("First"), uid.cast("string")).alias("first_name"), F.concat(F.lit("Last"), uid.cast("string")).alias("last_name"),
        F.date_add(F.lit(dt.date(1970, 1, 1)), (uid % 10_000).cast("int")).alias("date_of_birth"),
    )
