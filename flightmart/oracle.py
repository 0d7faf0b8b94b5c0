"""Independent DuckDB SQL for every registered query (the correctness oracle).

The airline tables are re-derived from the raw test tables by the SQL in
``TABLES`` (the same mapping as ``flightmart.sources.fixtures``, written a
second time in SQL).  Table names carry an ``fm_`` prefix because the raw
``customer`` view is already taken.  Date bounds are literals computed from
the fixed as-of date.
"""

from __future__ import annotations

import datetime as dt

AS_OF = dt.date(2001, 7, 1)


def d(days_back: int = 0) -> str:
    """DATE literal of as_of minus ``days_back`` days."""
    return f"DATE '{(AS_OF - dt.timedelta(days=days_back)).isoformat()}'"


def ts(day: dt.date) -> str:
    return f"TIMESTAMP '{day.isoformat()} 00:00:00'"


TABLES = """
WITH
fm_airline AS (SELECT DISTINCT p_brand AS name FROM part),
fm_airport AS (
  SELECT n.n_name AS name, r.r_name AS city
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
fm_airplane AS (
  SELECT p_brand AS airline_name, CAST(p_partkey AS VARCHAR) AS id, CAST(p_size AS INTEGER) AS seats
  FROM part),
fm_flight_base AS (
  SELECT p.*, TIMESTAMP '1995-01-01 00:00:00'
           + to_hours(CAST((p_partkey * 37 % 2500) * 24 + p_partkey % 24 AS BIGINT)) AS dep_ts
  FROM part p),
fm_flight AS (
  SELECT CAST(p_partkey AS VARCHAR) AS flight_num,
         p_brand AS airline_name,
         CAST(p_partkey AS VARCHAR) AS airplane_id,
         dn.n_name AS depart_name,
         an.n_name AS arrive_name,
         dep_ts AS depart_time,
         dep_ts + to_hours(CAST(1 + p_size % 12 AS BIGINT)) AS arrive_time,
         CAST(p_retailprice AS DECIMAL(10,2)) AS price,
         CASE WHEN dep_ts > TIMESTAMP '2001-07-01 00:00:00' THEN 'upcoming'
              WHEN p_size % 5 = 0 THEN 'delayed'
              ELSE 'in-progress' END AS flight_status
  FROM fm_flight_base
  JOIN nation dn ON dn.n_nationkey = p_partkey % 25
  JOIN nation an ON an.n_nationkey = (p_partkey + 1 + p_size % 24) % 25),
fm_ticket AS (
  SELECT CAST((CAST(l_orderkey * 8 + l_linenumber AS HUGEINT) * (SELECT MAX(p_partkey) + 1 FROM part) + l_partkey) * (SELECT MAX(s_suppkey) + 1 FROM supplier) + l_suppkey AS VARCHAR) AS ticket_id,
         CAST(l_partkey AS VARCHAR) AS flight_num
  FROM lineitem),
fm_purchases AS (
  SELECT CAST((CAST(l_orderkey * 8 + l_linenumber AS HUGEINT) * (SELECT MAX(p_partkey) + 1 FROM part) + l_partkey) * (SELECT MAX(s_suppkey) + 1 FROM supplier) + l_suppkey AS VARCHAR) AS ticket_id,
         c.c_name AS customer_email,
         CASE WHEN l.l_returnflag = 'R' THEN NULL ELSE s.s_name END AS booking_agent_email,
         CAST(o.o_orderdate AS DATE) AS p_date
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey),
fm_customer AS (
  SELECT c.c_name AS email, c.c_name AS name, CAST(c.c_custkey AS BIGINT) AS building_number,
         'Street ' || CAST(c.c_custkey AS VARCHAR) AS street, n.n_name AS city, r.r_name AS state,
         CAST(c.c_custkey + 10000000000 AS DECIMAL(20,0)) AS phone_number,
         'P' || CAST(c.c_custkey AS VARCHAR) AS passport_number,
         CAST(DATE '2030-01-01' + CAST(c.c_custkey AS INTEGER) AS DATE) AS passport_expiration,
         n.n_name AS passport_country,
         CAST(DATE '1950-01-01' + CAST(c.c_custkey AS INTEGER) AS DATE) AS date_of_birth
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
fm_agent AS (
  SELECT s_name AS email, CAST(s_suppkey AS VARCHAR) AS b_id,
         'Brand#' || CAST(s_suppkey % 25 + 1 AS VARCHAR) AS airline_name
  FROM supplier),
fm_staff AS (
  SELECT 'staff-' || s_name AS username, 'Brand#' || CAST(s_suppkey % 25 + 1 AS VARCHAR) AS airline_name,
         'First' || CAST(s_suppkey AS VARCHAR) AS first_name, 'Last' || CAST(s_suppkey AS VARCHAR) AS last_name,
         CAST(DATE '1960-01-01' + CAST(s_suppkey AS INTEGER) AS DATE) AS date_of_birth
  FROM supplier),
fm_permission AS (
  SELECT 'staff-' || s_name AS username,
         CASE s_suppkey % 3 WHEN 0 THEN 'Admin' WHEN 1 THEN 'Operator' ELSE '' END AS permission
  FROM supplier),
fm_sales AS (
  SELECT p.ticket_id, p.customer_email, p.booking_agent_email, p.p_date,
         f.flight_num, f.airline_name, f.airplane_id, f.depart_name, f.arrive_name,
         f.depart_time, f.arrive_time, f.price, f.flight_status
  FROM fm_purchases p
  JOIN fm_ticket t ON p.ticket_id = t.ticket_id
  JOIN fm_flight f ON t.flight_num = f.flight_num),
fm_event AS (
  SELECT e.event_id, e.user_id, e.event_type, l.line_supplier,
         CASE WHEN e.event_id // 3 % 3 = 0 THEN TIMESTAMP '2000-06-01 10:00:00' + to_seconds(e.event_id * 7919 % 3600)
              ELSE e.ts END AS ts,
         CASE WHEN e.event_id // 3 % 3 = 0 THEN 7 ELSE COALESCE(l.part, e.event_id) END AS flight_key
  FROM events e
  LEFT JOIN (SELECT l_orderkey, MIN(l_partkey) AS part, MIN(l_suppkey) AS line_supplier FROM lineitem GROUP BY l_orderkey) l
    ON l.l_orderkey = e.event_id)
"""

FLIGHT_COLS = ("flight_num, airline_name, airplane_id, depart_name, arrive_name, depart_time, "
               "arrive_time, price, flight_status")


def _q(body: str, recursive: bool = False) -> str:
    if recursive:
        return _q(body).replace("WITH\nfm_airline", "WITH RECURSIVE\nfm_airline", 1)
    body = body.lstrip()
    if body.startswith("WITH "):
        # continue the shared CTE list instead of nesting a second WITH
        return TABLES.rstrip() + ",\n" + body[len("WITH "):]
    return TABLES + body


def _avg_half_even(total: str, n: str) -> str:
    """Exact half-even rounding of total/n to cents, on integer cents."""
    c = f"CAST(ROUND({total} * 100) AS BIGINT)"
    return (f"CASE WHEN {n} = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST((({c}) // {n} + "
            f"CASE WHEN 2 * (({c}) % {n}) > {n} OR (2 * (({c}) % {n}) = {n} AND (({c}) // {n}) % 2 = 1) "
            f"THEN 1 ELSE 0 END) * 0.01 AS DECIMAL(18,2)) END")


def _pct(p: str, o: str) -> str:
    pc = f"CAST(ROUND(({p}) * 100) AS BIGINT)"
    tc = f"CAST(ROUND((({p}) + ({o})) * 100) AS BIGINT)"
    return f"CASE WHEN {tc} > 0 THEN CAST(({pc} * 2000 + {tc}) // (2 * {tc}) AS BIGINT) / 10.0 END"


def queries() -> dict[str, str]:
    q: dict[str, str] = {}

    q["sales_fact"] = _q("SELECT * FROM fm_sales")

    q["dim_lists"] = _q("""
SELECT 'airline' AS list_name, name AS airline_name, name AS item FROM fm_airline
UNION ALL SELECT 'airport', NULL, name FROM fm_airport
UNION ALL SELECT 'airplane', airline_name, id FROM fm_airplane
UNION ALL SELECT 'flight', airline_name, flight_num FROM fm_flight""")

    q["airline_revenue_split"] = _q(f"""
SELECT airline_name, window_days,
       CAST(SUM(CASE WHEN booking_agent_email IS NULL THEN price END) AS DECIMAL(18,2)) AS revenue_direct,
       CAST(SUM(CASE WHEN booking_agent_email IS NOT NULL THEN price END) AS DECIMAL(18,2)) AS revenue_agent
FROM fm_sales s
JOIN (SELECT 30 AS window_days UNION ALL SELECT 365) w
  ON s.p_date <= {d()} AND s.p_date >= {d()} - w.window_days
GROUP BY airline_name, window_days""")

    q["airline_revenue_share"] = _q(f"""
SELECT airline_name, window_days,
       {_pct('COALESCE(rd, 0)', 'COALESCE(ra, 0)')} AS pct_direct,
       {_pct('COALESCE(ra, 0)', 'COALESCE(rd, 0)')} AS pct_agent
FROM (
  SELECT airline_name, window_days,
         SUM(CASE WHEN booking_agent_email IS NULL THEN price END) AS rd,
         SUM(CASE WHEN booking_agent_email IS NOT NULL THEN price END) AS ra
  FROM fm_sales s
  JOIN (SELECT 30 AS window_days UNION ALL SELECT 365) w
    ON s.p_date <= {d()} AND s.p_date >= {d()} - w.window_days
  GROUP BY airline_name, window_days) x""")

    q["airline_ticket_counts"] = _q(f"""
SELECT a.name AS airline_name,
       CAST((SELECT COUNT(*) FROM fm_sales s WHERE s.airline_name = a.name
              AND s.p_date BETWEEN {d(31)} AND {d()}) AS BIGINT) AS tickets_31d,
       CAST((SELECT COUNT(*) FROM fm_sales s WHERE s.airline_name = a.name
              AND s.p_date BETWEEN {d(365)} AND {d()}) AS BIGINT) AS tickets_365d
FROM fm_airline a""")

    q["airline_top_agents_by_tickets"] = _q(f"""
SELECT airline_name, window_days, rank, booking_agent_email, tickets FROM (
  SELECT airline_name, window_days, booking_agent_email, tickets,
         CAST(ROW_NUMBER() OVER (PARTITION BY airline_name, window_days
                                 ORDER BY tickets DESC, booking_agent_email) AS INTEGER) AS rank
  FROM (
    SELECT airline_name, w.window_days, booking_agent_email, COUNT(ticket_id) AS tickets
    FROM fm_sales s
    JOIN (SELECT 31 AS window_days UNION ALL SELECT 365) w
      ON s.p_date <= {d()} AND s.p_date >= {d()} - w.window_days
    WHERE booking_agent_email IS NOT NULL
    GROUP BY airline_name, w.window_days, booking_agent_email) g) r
WHERE rank <= 5""")

    q["airline_top_agents_by_sales"] = _q(f"""
SELECT airline_name, rank, booking_agent_email, sales FROM (
  SELECT airline_name, booking_agent_email, sales,
         CAST(ROW_NUMBER() OVER (PARTITION BY airline_name ORDER BY sales DESC, booking_agent_email) AS INTEGER) AS rank
  FROM (
    SELECT airline_name, booking_agent_email, CAST(SUM(price) AS DECIMAL(18,2)) AS sales
    FROM fm_sales
    WHERE booking_agent_email IS NOT NULL AND p_date BETWEEN {d(365)} AND {d()}
    GROUP BY airline_name, booking_agent_email) g) r
WHERE rank <= 5""")

    q["airline_top_customers"] = _q(f"""
SELECT airline_name, rank, customer_email, tickets FROM (
  SELECT airline_name, customer_email, tickets,
         CAST(ROW_NUMBER() OVER (PARTITION BY airline_name ORDER BY tickets DESC, customer_email) AS INTEGER) AS rank
  FROM (
    SELECT airline_name, customer_email, COUNT(ticket_id) AS tickets
    FROM fm_sales
    WHERE p_date BETWEEN {d(365)} AND {d()}
    GROUP BY airline_name, customer_email) g) r
WHERE rank <= 10""")

    q["top_destinations"] = _q(f"""
SELECT window_days, rank, city, flights FROM (
  SELECT window_days, city, flights,
         CAST(ROW_NUMBER() OVER (PARTITION BY window_days ORDER BY flights DESC, city) AS INTEGER) AS rank
  FROM (
    SELECT w.window_days, a.city, COUNT(f.arrive_time) AS flights
    FROM fm_flight f
    JOIN fm_airport a ON f.arrive_name = a.name
    JOIN (SELECT 92 AS window_days UNION ALL SELECT 365) w
      ON f.depart_time <= {ts(AS_OF)}
     AND f.depart_time >= CAST({d()} - w.window_days AS TIMESTAMP)
    GROUP BY w.window_days, a.city) g) r
WHERE rank <= 3""")

    q["airline_monthly_tickets_12m"] = _q(f"""
WITH months AS (
  SELECT DATE '2000-08-01' AS lo, DATE '2001-07-01' AS hi),
counts AS (
  SELECT airline_name, CAST(date_trunc('month', p_date) AS DATE) AS month_start, COUNT(*) AS n
  FROM fm_sales
  WHERE p_date BETWEEN DATE '2000-08-01' AND {d()}
  GROUP BY 1, 2)
SELECT m.airline_name, m.month_start, CAST(COALESCE(c.n, 0) AS BIGINT) AS tickets
FROM (SELECT a.name AS airline_name,
             CAST(unnest(generate_series((SELECT lo FROM months), (SELECT hi FROM months), INTERVAL 1 MONTH)) AS DATE)
               AS month_start
      FROM fm_airline a) m
LEFT JOIN counts c ON c.airline_name = m.airline_name AND c.month_start = m.month_start""")

    q["airline_monthly_tickets_range"] = _q("""
WITH months AS (
  SELECT DATE '1999-11-01' AS lo, DATE '2001-02-01' AS hi),
counts AS (
  SELECT airline_name, CAST(date_trunc('month', p_date) AS DATE) AS month_start, COUNT(*) AS n
  FROM fm_sales
  WHERE p_date BETWEEN DATE '1999-11-15' AND DATE '2001-02-10'
  GROUP BY 1, 2)
SELECT m.airline_name, m.month_start, CAST(COALESCE(c.n, 0) AS BIGINT) AS tickets
FROM (SELECT a.name AS airline_name,
             CAST(unnest(generate_series((SELECT lo FROM months), (SELECT hi FROM months), INTERVAL 1 MONTH)) AS DATE)
               AS month_start
      FROM fm_airline a) m
LEFT JOIN counts c ON c.airline_name = m.airline_name AND c.month_start = m.month_start""")

    q["customer_purchase_history"] = _q("""
SELECT airline_name, customer_email, flight_num, airplane_id, depart_name, arrive_name, depart_time,
       arrive_time, price, flight_status, ticket_id, booking_agent_email, p_date
FROM fm_sales""")

    q["flight_passenger_list"] = _q("SELECT airline_name, flight_num, customer_email FROM fm_sales")

    q["staff_permissions"] = _q("""
SELECT s.airline_name, s.username, p.permission
FROM fm_staff s JOIN fm_permission p ON s.username = p.username""")

    q["airline_flights_next_30_days"] = _q(f"""
SELECT {FLIGHT_COLS} FROM fm_flight
WHERE depart_time >= {ts(AS_OF)} AND arrive_time <= {ts(AS_OF + dt.timedelta(days=30))}""")

    up_pairs = """
  SELECT DISTINCT customer_email, flight_num, airline_name, airplane_id, depart_name, arrive_name,
         depart_time, arrive_time, price, flight_status
  FROM fm_sales WHERE flight_status = 'upcoming'"""

    q["public_upcoming_flights"] = _q(f"SELECT {FLIGHT_COLS} FROM fm_flight WHERE flight_status = 'upcoming'")

    q["flight_search"] = _q(f"""
SELECT {FLIGHT_COLS} FROM fm_flight
WHERE depart_name IN (SELECT name FROM fm_airport WHERE city = 'ASIA')
  AND arrive_name IN (SELECT name FROM fm_airport WHERE city = 'EUROPE')""")

    q["flight_search_by_day"] = _q(f"""
SELECT {FLIGHT_COLS} FROM fm_flight
WHERE TIMESTAMP '2000-11-29 00:00:00' <= depart_time AND depart_time <= TIMESTAMP '2000-11-30 00:00:00'""")

    # the criteria of fixtures.saved_searches; matched by the plain rule "not named or equal"
    saved = """WITH search AS (
  SELECT e.event_id AS search_id, c.c_name AS customer_email, e.event_id % 8 AS k,
         CASE WHEN e.event_id % 8 IN (0, 7) THEN f.flight_num END AS num,
         CASE WHEN e.event_id % 8 IN (1, 5) THEN f.depart_name END AS dep,
         CASE WHEN e.event_id % 8 IN (2, 5) THEN f.arrive_name END AS arr,
         CASE WHEN e.event_id % 8 = 6 THEN f.airline_name END AS al,
         CASE WHEN e.event_id % 8 IN (3, 7) THEN da.city END AS dep_city,
         CASE WHEN e.event_id % 8 IN (3, 6) THEN aa.city END AS arr_city,
         CASE WHEN e.event_id % 8 IN (1, 3, 4, 5) THEN CAST(f.depart_time AS DATE) + CAST(CASE WHEN e.event_id % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) END AS dep_day,
         CASE WHEN e.event_id % 8 IN (2, 6) THEN CAST(f.arrive_time AS DATE) END AS arr_day,
         CASE WHEN e.event_id % 8 IN (1, 3, 4, 5) THEN CAST(f.depart_time AS DATE) - CAST(e.event_id % 4 AS INTEGER) END AS from_day,
         CASE WHEN e.event_id % 8 IN (2, 3, 4, 6) THEN CAST(f.depart_time AS DATE) + CAST(e.event_id % 4 + 1 AS INTEGER) END AS until_day
  FROM fm_event e JOIN fm_flight f ON f.flight_num = CAST(e.flight_key AS VARCHAR)
  JOIN fm_airport da ON da.name = f.depart_name JOIN fm_airport aa ON aa.name = f.arrive_name
  LEFT JOIN customer c ON c.c_custkey = e.user_id
  WHERE e.event_type = 'error')"""
    plain = """(num IS NULL OR num = f.flight_num) AND (dep IS NULL OR dep = f.depart_name) AND (arr IS NULL OR arr = f.arrive_name)
  AND (al IS NULL OR al = f.airline_name)
  AND (dep_city IS NULL OR f.depart_name IN (SELECT name FROM fm_airport WHERE city = dep_city))
  AND (arr_city IS NULL OR f.arrive_name IN (SELECT name FROM fm_airport WHERE city = arr_city))"""
    bounds = """(from_day IS NULL OR f.depart_time >= CAST(from_day AS TIMESTAMP)) AND (until_day IS NULL OR f.arrive_time <= CAST(until_day AS TIMESTAMP))"""
    flight_cols = ", ".join(f"f.{c.strip()}" for c in FLIGHT_COLS.split(","))

    q["searches_matched"] = _q(f"""{saved}
SELECT search_id, {flight_cols} FROM search JOIN fm_flight f ON {plain}
  AND (dep_day IS NULL OR f.depart_time BETWEEN CAST(dep_day AS TIMESTAMP) AND CAST(dep_day + 1 AS TIMESTAMP))
  AND (arr_day IS NULL OR f.arrive_time BETWEEN CAST(arr_day AS TIMESTAMP) AND CAST(arr_day + 1 AS TIMESTAMP))""")

    q["searches_matched_by_bounds"] = _q(f"""{saved}
SELECT search_id, {flight_cols} FROM search JOIN fm_flight f ON {plain} AND {bounds}""")

    q["customer_searches_matched"] = _q(f"""{saved},
held AS (SELECT DISTINCT customer_email, {FLIGHT_COLS} FROM fm_sales WHERE flight_status = 'upcoming')
SELECT search_id, search.customer_email, {flight_cols} FROM search JOIN held f ON f.customer_email = search.customer_email AND {plain} AND {bounds}""")

    q["customer_upcoming_flights"] = _q(up_pairs)

    q["customer_upcoming_search"] = _q(f"""
SELECT * FROM ({up_pairs}) x
WHERE depart_time >= TIMESTAMP '2001-08-01 00:00:00'
  AND arrive_name IN (SELECT name FROM fm_airport WHERE city = 'AMERICA')""")

    q["customer_year_spend"] = _q(f"""
SELECT c.email AS customer_email, CAST(COALESCE(SUM(f.price), 0) AS DECIMAL(18,2)) AS year_spend
FROM fm_customer c
LEFT JOIN (SELECT DISTINCT customer_email, flight_num FROM fm_sales
           WHERE p_date BETWEEN {d(365)} AND {d()}) b ON b.customer_email = c.email
LEFT JOIN fm_flight f ON f.flight_num = b.flight_num
GROUP BY c.email""")

    q["customer_monthly_spend_6m"] = _q(f"""
WITH months AS (
  SELECT DATE '2001-02-01' AS lo, DATE '2001-07-01' AS hi),
spend AS (
  SELECT customer_email, CAST(date_trunc('month', p_date) AS DATE) AS month_start, SUM(price) AS s
  FROM fm_sales
  WHERE p_date BETWEEN DATE '2001-02-01' AND {d()}
  GROUP BY 1, 2)
SELECT m.customer_email, m.month_start, CAST(COALESCE(s.s, 0) AS DECIMAL(18,2)) AS spend
FROM (SELECT c.email AS customer_email,
             CAST(unnest(generate_series((SELECT lo FROM months), (SELECT hi FROM months), INTERVAL 1 MONTH)) AS DATE)
               AS month_start
      FROM fm_customer c) m
LEFT JOIN spend s ON s.customer_email = m.customer_email AND s.month_start = m.month_start""")

    q["customer_monthly_spend_range"] = _q("""
WITH months AS (
  SELECT DATE '2000-10-01' AS lo, DATE '2001-03-01' AS hi),
spend AS (
  SELECT customer_email, CAST(date_trunc('month', p_date) AS DATE) AS month_start, SUM(price) AS s
  FROM fm_sales
  WHERE p_date >= DATE '2000-10-15' AND p_date < DATE '2001-03-31'
  GROUP BY 1, 2)
SELECT m.customer_email, m.month_start, CAST(COALESCE(s.s, 0) AS DECIMAL(18,2)) AS spend
FROM (SELECT c.email AS customer_email,
             CAST(unnest(generate_series((SELECT lo FROM months), (SELECT hi FROM months), INTERVAL 1 MONTH)) AS DATE)
               AS month_start
      FROM fm_customer c) m
LEFT JOIN spend s ON s.customer_email = m.customer_email AND s.month_start = m.month_start""")

    agent_rows = """
SELECT a.booking_agent_email, s.flight_num, s.airline_name, s.airplane_id, s.depart_name, s.arrive_name,
       s.depart_time, s.arrive_time, s.price, s.flight_status, s.customer_email
FROM fm_sales s
JOIN (SELECT DISTINCT booking_agent_email, flight_num FROM fm_sales
      WHERE booking_agent_email IS NOT NULL) a ON a.flight_num = s.flight_num
WHERE s.flight_status = 'upcoming'"""

    q["agent_upcoming_bookings"] = _q(agent_rows)

    q["agent_upcoming_search"] = _q(agent_rows + """
  AND s.depart_name = 'NATION_2' AND s.arrive_time <= TIMESTAMP '2002-06-30 00:00:00'""")

    def commission(lo: str, hi: str) -> str:
        return f"""
SELECT a.email AS booking_agent_email,
       CAST(COALESCE(SUM(s.price), 0) AS DECIMAL(18,2)) AS commission,
       CAST(COUNT(s.ticket_id) AS BIGINT) AS tickets
FROM fm_agent a
LEFT JOIN fm_sales s ON s.booking_agent_email = a.email AND s.p_date BETWEEN {lo} AND {hi}
GROUP BY a.email"""

    q["agent_commission"] = _q(f"""
SELECT booking_agent_email, commission, tickets, {_avg_half_even('commission', 'tickets')} AS avg_commission
FROM ({commission(d(30), d())}) x""")

    q["agent_commission_range"] = _q(commission("DATE '2001-01-01'", "DATE '2001-03-31'"))

    def agent_top(measure: str, expr: str, days: int) -> str:
        return f"""
SELECT booking_agent_email, rank, customer_email, {measure} FROM (
  SELECT booking_agent_email, customer_email, {measure},
         CAST(ROW_NUMBER() OVER (PARTITION BY booking_agent_email
                                 ORDER BY {measure} DESC, customer_email) AS INTEGER) AS rank
  FROM (
    SELECT booking_agent_email, customer_email, {expr} AS {measure}
    FROM fm_sales
    WHERE booking_agent_email IS NOT NULL AND p_date BETWEEN {d(days)} AND {d()}
    GROUP BY 1, 2) g) r
WHERE rank <= 5"""

    q["agent_top_customers_by_tickets"] = _q(agent_top("tickets", "COUNT(flight_num)", 183))
    q["agent_top_customers_by_spend"] = _q(agent_top("spend", "CAST(SUM(price) AS DECIMAL(18,2))", 365))

    q["airline_flight_search"] = _q(f"""
SELECT {FLIGHT_COLS} FROM fm_flight
WHERE depart_time >= TIMESTAMP '2000-01-01 00:00:00' AND arrive_time <= TIMESTAMP '2000-12-31 00:00:00'
  AND depart_name IN (SELECT name FROM fm_airport WHERE city = 'ASIA')""")

    q["seat_availability"] = _q("""
SELECT f.flight_num, f.airline_name, CAST(a.seats AS BIGINT) AS seats,
       CAST(COALESCE(t.sold, 0) AS BIGINT) AS sold,
       CAST(GREATEST(a.seats - COALESCE(t.sold, 0), 0) AS BIGINT) AS remaining
FROM fm_flight f
LEFT JOIN fm_airplane a ON a.id = f.airplane_id AND a.airline_name = f.airline_name
LEFT JOIN (SELECT flight_num, COUNT(*) AS sold FROM fm_ticket GROUP BY flight_num) t
  ON t.flight_num = f.flight_num""")

    q["duplicate_bookings"] = _q("""
SELECT p.customer_email, t.flight_num, COUNT(*) AS tickets
FROM fm_purchases p JOIN fm_ticket t ON p.ticket_id = t.ticket_id
GROUP BY 1, 2 HAVING COUNT(*) > 1""")

    q["book_tickets_direct"] = _q("WITH " + _booking_sql(agent=False) + """
SELECT request_id, customer_email, flight_num, status FROM decided""", recursive=True)

    q["book_tickets_agent"] = _q("WITH " + _booking_sql(agent=True) + """
SELECT request_id, booking_agent_email, customer_email, flight_num, status FROM decided""", recursive=True)

    q["assign_ticket_ids"] = _q("WITH " + _booking_sql(agent=False) + """
SELECT request_id,
       CAST((SELECT COALESCE(MAX(TRY_CAST(ticket_id AS HUGEINT)), 0) FROM fm_ticket)
            + ROW_NUMBER() OVER (ORDER BY substr(md5(flight_num), 1, 3), flight_num, k) AS VARCHAR) AS ticket_id
FROM decided WHERE status = 1""", recursive=True)

    q["load_new_flights"] = _q("WITH " + _NEW_FLIGHTS + """
SELECT request_id, flight_num,
       CASE WHEN other IN ('same_airport', 'bad_time') THEN other WHEN in_table OR late THEN 'existing_flight_num'
            WHEN other IS NOT NULL THEN other ELSE 'ok' END AS outcome
FROM nf4""")

    q["load_new_flights_by_admin"] = _q("WITH " + _NEW_FLIGHTS + """,
req_by AS (
  SELECT nf4.*, 'staff-' || s.s_name AS requester
  FROM nf4 LEFT JOIN supplier s
    ON s.s_suppkey = CAST(regexp_extract(nf4.airline_name, '(\\d+)$', 1) AS BIGINT) - 1 + 25 * (nf4.request_id % (SELECT GREATEST(4, (MAX(s_suppkey) + 1) // 25) FROM supplier))),
permitted AS (
  SELECT req_by.*, EXISTS (SELECT 1 FROM fm_permission pm JOIN fm_staff st ON st.username = pm.username
                           WHERE pm.username = req_by.requester AND pm.permission = 'Admin'
                             AND st.airline_name = req_by.airline_name) AS ok_req
  FROM req_by),
judged AS (
  SELECT permitted.*, EXISTS (SELECT 1 FROM permitted b
                              WHERE b.ok_req AND NOT b.in_table AND b.other IS NULL AND b.flight_num = permitted.flight_num
                                AND (b.ts < permitted.ts OR (b.ts = permitted.ts AND b.request_id < permitted.request_id)))
           AS late_ok
  FROM permitted)
SELECT request_id, flight_num,
       CASE WHEN NOT ok_req THEN 'not_permitted'
            WHEN other IN ('same_airport', 'bad_time') THEN other
            WHEN in_table OR late_ok THEN 'existing_flight_num'
            WHEN other IS NOT NULL THEN other ELSE 'ok' END AS outcome
FROM judged""")

    q["flight_status_outcomes"] = _q("WITH " + _STATUS_CHANGES + """
SELECT request_id, flight_num, CASE WHEN prev = flight_status THEN 'unchanged' ELSE 'updated' END AS outcome
FROM sc3
UNION ALL
SELECT request_id, flight_num, pre FROM sc2 WHERE pre IS NOT NULL""")

    q["flight_status_outcomes_by_operator"] = _q("""
WITH sc AS (
  SELECT e.event_id AS request_id, e.ts,
         CASE WHEN e.event_id % 13 = 0 THEN 'Brand#0' ELSE p.p_brand END AS airline_name,
         CAST(e.flight_key AS VARCHAR) AS flight_num,
         CASE e.event_id % 3 WHEN 0 THEN 'upcoming' WHEN 1 THEN 'in-progress' ELSE 'delayed' END AS flight_status,
         'staff-' || s.s_name AS requester
  FROM fm_event e
  LEFT JOIN part p ON p.p_partkey = e.flight_key
  LEFT JOIN supplier s
    ON s.s_suppkey = CAST(regexp_extract(p.p_brand, '(\\d+)$', 1) AS BIGINT) - 1 + 25 * (e.event_id % (SELECT GREATEST(4, (MAX(s_suppkey) + 1) // 25) FROM supplier))
  WHERE e.event_type = 'view'),
sc2 AS (
  SELECT sc.*, f.flight_status AS base_status,
         CASE WHEN NOT EXISTS (SELECT 1 FROM fm_permission pm JOIN fm_staff st ON st.username = pm.username
                               WHERE pm.username = sc.requester AND pm.permission = 'Operator'
                                 AND st.airline_name = sc.airline_name) THEN 'not_permitted'
              WHEN f.airline_name IS NULL OR f.airline_name <> sc.airline_name THEN 'unknown_flight'
              WHEN sc.flight_status NOT IN ('upcoming', 'in-progress', 'delayed') THEN 'bad_status' END AS pre
  FROM sc LEFT JOIN fm_flight f ON f.flight_num = sc.flight_num),
sc3 AS (
  SELECT *, COALESCE(LAG(flight_status) OVER (PARTITION BY flight_num ORDER BY ts, request_id), base_status) AS prev
  FROM sc2 WHERE pre IS NULL)
SELECT request_id, flight_num, CASE WHEN prev = flight_status THEN 'unchanged' ELSE 'updated' END AS outcome
FROM sc3
UNION ALL
SELECT request_id, flight_num, pre FROM sc2 WHERE pre IS NOT NULL""")

    q["apply_flight_status"] = _q("WITH " + _STATUS_CHANGES + """,
latest AS (
  SELECT flight_num, flight_status FROM (
    SELECT flight_num, flight_status,
           ROW_NUMBER() OVER (PARTITION BY flight_num ORDER BY ts DESC, request_id DESC) AS rn
    FROM sc2 WHERE pre IS NULL) x WHERE rn = 1)
SELECT f.flight_num, f.airline_name, f.airplane_id, f.depart_name, f.arrive_name, f.depart_time, f.arrive_time,
       f.price, COALESCE(l.flight_status, f.flight_status) AS flight_status
FROM fm_flight f LEFT JOIN latest l ON l.flight_num = f.flight_num""")

    q["load_new_airplanes"] = _q("""
WITH na AS (
  SELECT s_suppkey AS request_id,
         CASE WHEN s_suppkey % 7 = 0 THEN 'x' || CAST(s_suppkey * 50 AS VARCHAR)
              ELSE CAST(s_suppkey * 50 AS VARCHAR) END AS airplane_id,
         CAST(s_suppkey % 50 + 1 AS VARCHAR) AS seats
  FROM supplier),
na2 AS (
  SELECT na.*, CAST(TRY_CAST(airplane_id AS BIGINT) AS VARCHAR) AS id_norm,
         TRY_CAST(seats AS INTEGER) AS seats_n
  FROM na),
na3 AS (
  SELECT na2.*, (id_norm IS NOT NULL AND seats_n IS NOT NULL) AS is_int,
         COALESCE(id_norm IN (SELECT id FROM fm_airplane), FALSE) AS ex
  FROM na2),
na4 AS (SELECT *, (is_int AND NOT ex) AS valid FROM na3)
SELECT request_id, airplane_id,
       CASE WHEN NOT is_int THEN 'not_an_integer'
            WHEN ex OR EXISTS (SELECT 1 FROM na4 b WHERE b.valid AND b.id_norm = na4.id_norm
                                 AND b.request_id < na4.request_id) THEN 'existing_id'
            ELSE 'ok' END AS outcome
FROM na4""")

    q["load_new_airports"] = _q("""
WITH ap AS (
  SELECT CAST(c.c_custkey AS BIGINT) AS request_id,
         UPPER(CASE WHEN c.c_custkey % 2 = 0 THEN lower(n.n_name)
                    ELSE 'Port ' || CAST(c.c_custkey % (SELECT GREATEST(97, COUNT(*) // 10) FROM customer) AS VARCHAR) END) AS name,
         UPPER(lower(r.r_name)) AS city
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
ap2 AS (SELECT ap.*, COALESCE(name IN (SELECT name FROM fm_airport), FALSE) AS ex FROM ap)
SELECT request_id, name, city,
       CASE WHEN ex OR EXISTS (SELECT 1 FROM ap2 b WHERE NOT b.ex AND b.name = ap2.name
                                 AND b.request_id < ap2.request_id) THEN 'existing' ELSE 'ok' END AS outcome
FROM ap2""")

    q["permission_grant_outcomes"] = _q("WITH " + _GRANTS + """
SELECT request_id, username, permission, outcome FROM gr4""")

    q["apply_permission_grants"] = _q("WITH " + _GRANTS + """,
added AS (SELECT username, permission FROM gr4 WHERE outcome = 'ok')
SELECT username, permission FROM fm_permission WHERE permission IS DISTINCT FROM ''
UNION ALL
SELECT username, permission FROM fm_permission
WHERE permission = '' AND username NOT IN (SELECT username FROM added)
UNION ALL
SELECT username, permission FROM added""")

    q["agent_move_outcomes"] = _q("WITH " + _MOVES + """
SELECT request_id, email, airline_name, CASE WHEN prev = airline_name THEN 'unchanged' ELSE 'updated' END AS outcome
FROM mv3
UNION ALL
SELECT request_id, email, airline_name, pre FROM mv2 WHERE pre IS NOT NULL""")

    q["assign_agents_to_airline"] = _q("WITH " + _MOVES + """,
latest AS (
  SELECT email, airline_name FROM (
    SELECT email, airline_name, ROW_NUMBER() OVER (PARTITION BY email ORDER BY request_id DESC) AS rn
    FROM mv2 WHERE pre IS NULL) x WHERE rn = 1)
SELECT a.email, a.b_id, COALESCE(l.airline_name, a.airline_name) AS airline_name
FROM fm_agent a LEFT JOIN latest l ON l.email = a.email""")

    q["load_registrations"] = _q("""
WITH rg AS (
  SELECT event_id AS request_id, ts,
         CASE event_id % 3 WHEN 0 THEN 'customer' WHEN 1 THEN 'agent' ELSE 'staff' END AS kind,
         CASE event_id % 3
           WHEN 0 THEN 'Customer#' || lpad(CAST(user_id * 20 AS VARCHAR), 9, '0')
           WHEN 1 THEN 'Supplier#' || lpad(CAST(user_id AS VARCHAR), 9, '0')
           ELSE 'staff-Supplier#' || lpad(CAST(user_id AS VARCHAR), 9, '0') END AS key,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'Brand#' || CAST(event_id % 30 + 1 AS VARCHAR) END AS airline_name,
         CASE WHEN event_id % 3 = 1 THEN CAST(user_id + 50 AS VARCHAR) END AS b_id
  FROM events WHERE event_type = 'signup'),
facts AS (
  SELECT rg.*,
         COALESCE(airline_name IN (SELECT name FROM fm_airline), FALSE) AS good_airline,
         CASE kind WHEN 'customer' THEN key IN (SELECT email FROM fm_customer)
                   WHEN 'agent' THEN key IN (SELECT email FROM fm_agent)
                   ELSE key IN (SELECT username FROM fm_staff) END AS table_key,
         COALESCE(kind = 'agent' AND b_id IN (SELECT b_id FROM fm_agent), FALSE) AS table_bid
  FROM rg),
-- customers: the first record of a new email is accepted, later ones find it taken
customers AS (
  SELECT request_id, kind, key,
         CASE WHEN table_key OR ROW_NUMBER() OVER (PARTITION BY key ORDER BY ts, request_id) > 1 THEN 'existing'
              ELSE 'ok' END AS outcome
  FROM facts WHERE kind = 'customer'),
-- staff: the key is taken by the table or by an earlier accepted (good-airline) record
staff AS (
  SELECT f.request_id, f.kind, f.key,
         CASE WHEN NOT f.good_airline THEN 'unknown_airline'
              WHEN f.table_key OR EXISTS (SELECT 1 FROM facts b WHERE b.kind = 'staff' AND b.key = f.key
                                            AND b.good_airline AND NOT b.table_key
                                            AND (b.ts < f.ts OR (b.ts = f.ts AND b.request_id < f.request_id)))
              THEN 'existing' ELSE 'ok' END AS outcome
  FROM facts f WHERE f.kind = 'staff'),
-- agents: one step per record in (ts, request_id) order, carrying the keys
-- and b_ids accepted so far (two constraints, so simulated in order)
agents_ordered AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY ts, request_id) AS k FROM facts WHERE kind = 'agent'),
agent_sim AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS keys, CAST([] AS VARCHAR[]) AS bids,
         CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS outcome
  UNION ALL
  SELECT k, CASE WHEN outcome = 'ok' THEN list_append(keys, key) ELSE keys END,
         CASE WHEN outcome = 'ok' THEN list_append(bids, b_id) ELSE bids END, request_id, outcome
  FROM (
    SELECT a.k, s.keys, s.bids, a.request_id, a.key, a.b_id,
           CASE WHEN a.table_key OR list_contains(s.keys, a.key) THEN 'existing'
                WHEN NOT a.good_airline THEN 'unknown_airline'
                WHEN a.table_bid OR COALESCE(list_contains(s.bids, a.b_id), FALSE) THEN 'existing_b_id'
                ELSE 'ok' END AS outcome
    FROM agent_sim s JOIN agents_ordered a ON a.k = s.k + 1) step),
agents AS (
  SELECT a.request_id, a.kind, a.key, s.outcome
  FROM agents_ordered a JOIN agent_sim s ON s.request_id = a.request_id)
SELECT * FROM customers UNION ALL SELECT * FROM staff UNION ALL SELECT * FROM agents""", recursive=True)

    q["customer_monthly_spend_12m"] = _q(f"""
WITH months AS (
  SELECT DATE '2000-08-01' AS lo, DATE '2001-07-01' AS hi),
spend AS (
  SELECT customer_email, CAST(date_trunc('month', p_date) AS DATE) AS month_start, SUM(price) AS s
  FROM fm_sales
  WHERE p_date BETWEEN DATE '2000-08-01' AND {d()}
  GROUP BY 1, 2)
SELECT m.customer_email, m.month_start, CAST(COALESCE(s.s, 0) AS DECIMAL(18,2)) AS spend
FROM (SELECT c.email AS customer_email,
             CAST(unnest(generate_series((SELECT lo FROM months), (SELECT hi FROM months), INTERVAL 1 MONTH)) AS DATE)
               AS month_start
      FROM fm_customer c) m
LEFT JOIN spend s ON s.customer_email = m.customer_email AND s.month_start = m.month_start""")

    q["airline_monthly_tickets_24m"] = _q(f"""
WITH months AS (
  SELECT DATE '1999-08-01' AS lo, DATE '2001-07-01' AS hi),
counts AS (
  SELECT airline_name, CAST(date_trunc('month', p_date) AS DATE) AS month_start, COUNT(*) AS n
  FROM fm_sales
  WHERE p_date BETWEEN DATE '1999-08-01' AND {d()}
  GROUP BY 1, 2)
SELECT m.airline_name, m.month_start, CAST(COALESCE(c.n, 0) AS BIGINT) AS tickets
FROM (SELECT a.name AS airline_name,
             CAST(unnest(generate_series((SELECT lo FROM months), (SELECT hi FROM months), INTERVAL 1 MONTH)) AS DATE)
               AS month_start
      FROM fm_airline a) m
LEFT JOIN counts c ON c.airline_name = m.airline_name AND c.month_start = m.month_start""")

    accepted = f"(SELECT request_id FROM ({q['load_registrations']}) o WHERE outcome = 'ok')"
    signups = f"FROM events e WHERE e.event_type = 'signup' AND e.event_id IN {accepted}"
    q["registration_rows_customer"] = f"""
SELECT 'Customer#' || lpad(CAST(e.user_id * 20 AS VARCHAR), 9, '0') AS email,
       'Customer#' || lpad(CAST(e.user_id * 20 AS VARCHAR), 9, '0') AS name, e.user_id AS building_number,
       'Street ' || CAST(e.user_id AS VARCHAR) AS street, 'City' AS city, 'State' AS state,
       CAST(e.user_id + 20000000000 AS DECIMAL(20,0)) AS phone_number, 'N' || CAST(e.user_id AS VARCHAR) AS passport_number,
       DATE '2031-01-01' AS passport_expiration, 'Country' AS passport_country,
       CAST(DATE '1970-01-01' + CAST(e.user_id % 10000 AS INTEGER) AS DATE) AS date_of_birth
{signups} AND e.event_id % 3 = 0"""
    q["registration_rows_booking_agent"] = f"""
SELECT 'Supplier#' || lpad(CAST(e.user_id AS VARCHAR), 9, '0') AS email, CAST(e.user_id + 50 AS VARCHAR) AS b_id,
       'Brand#' || CAST(e.event_id % 30 + 1 AS VARCHAR) AS airline_name
{signups} AND e.event_id % 3 = 1"""
    q["registration_rows_airline_staff"] = f"""
SELECT 'staff-Supplier#' || lpad(CAST(e.user_id AS VARCHAR), 9, '0') AS username,
       'Brand#' || CAST(e.event_id % 30 + 1 AS VARCHAR) AS airline_name, 'First' || CAST(e.user_id AS VARCHAR) AS first_name,
       'Last' || CAST(e.user_id AS VARCHAR) AS last_name,
       CAST(DATE '1970-01-01' + CAST(e.user_id % 10000 AS INTEGER) AS DATE) AS date_of_birth
{signups} AND e.event_id % 3 = 2"""
    q["registration_rows_permission"] = f"""
SELECT 'staff-Supplier#' || lpad(CAST(e.user_id AS VARCHAR), 9, '0') AS username, '' AS permission
{signups} AND e.event_id % 3 = 2"""

    q["new_flight_rows"] = _q("WITH " + _NEW_FLIGHTS + """
SELECT nf4.flight_num, nf4.airline_name, nf4.airplane_id, nf4.depart_name, nf4.arrive_name, nf4.depart_time,
       nf4.arrive_time, CAST(floor(o.o_totalprice) / 100 AS DECIMAL(10,2)) AS price, 'upcoming' AS flight_status
FROM nf4 JOIN orders o ON o.o_orderkey = nf4.request_id
WHERE other IS NULL AND NOT in_table AND NOT late""")

    q["new_airplane_rows"] = f"""
SELECT 'Brand#' || CAST(s.s_suppkey % 25 + 1 AS VARCHAR) AS airline_name, CAST(s.s_suppkey * 50 AS VARCHAR) AS id,
       CAST(s.s_suppkey % 50 + 1 AS INTEGER) AS seats
FROM supplier s JOIN ({q['load_new_airplanes']}) o ON o.request_id = s.s_suppkey WHERE o.outcome = 'ok'"""

    q["booking_rows_ticket"] = f"""
SELECT t.ticket_id, d.flight_num
FROM ({q['assign_ticket_ids']}) t JOIN ({q['book_tickets_direct']}) d ON d.request_id = t.request_id"""

    q["booking_rows_purchases"] = f"""
SELECT t.ticket_id, d.customer_email, CAST(NULL AS VARCHAR) AS booking_agent_email,
       CAST(CASE WHEN e.event_id // 3 % 3 = 0 THEN TIMESTAMP '2000-06-01 10:00:00' ELSE e.ts END AS DATE) AS p_date
FROM ({q['assign_ticket_ids']}) t JOIN ({q['book_tickets_direct']}) d ON d.request_id = t.request_id
JOIN events e ON e.event_id = t.request_id"""

    q["integrity_audit"] = _q(_audit_sql())

    q["top_destinations_by_airline"] = _q(f"""
SELECT airline_name, window_days, rank, city, flights FROM (
  SELECT airline_name, window_days, city, flights,
         CAST(ROW_NUMBER() OVER (PARTITION BY airline_name, window_days ORDER BY flights DESC, city) AS INTEGER) AS rank
  FROM (
    SELECT f.airline_name, w.window_days, a.city, COUNT(f.arrive_time) AS flights
    FROM fm_flight f
    JOIN fm_airport a ON f.arrive_name = a.name
    JOIN (SELECT 92 AS window_days UNION ALL SELECT 365) w
      ON f.depart_time <= {ts(AS_OF)}
     AND f.depart_time >= CAST({d()} - w.window_days AS TIMESTAMP)
    GROUP BY f.airline_name, w.window_days, a.city) g) r
WHERE rank <= 3""")

    q["agent_own_upcoming_bookings"] = _q("""
SELECT booking_agent_email, flight_num, airline_name, airplane_id, depart_name, arrive_name,
       depart_time, arrive_time, price, flight_status, customer_email
FROM fm_sales WHERE flight_status = 'upcoming' AND booking_agent_email IS NOT NULL""")

    q["agent_upcoming_flights"] = _q("""
SELECT DISTINCT booking_agent_email, flight_num, airline_name, airplane_id, depart_name, arrive_name,
       depart_time, arrive_time, price, flight_status
FROM fm_sales WHERE flight_status = 'upcoming' AND booking_agent_email IS NOT NULL""")

    q["upcoming_passengers"] = _q("""
SELECT flight_num, ticket_id, customer_email, booking_agent_email AS sold_by
FROM fm_sales WHERE flight_status = 'upcoming'""")

    q["book_tickets_upcoming_only"] = _q("WITH " + _booking_sql(agent=False, require_upcoming=True) + """
SELECT request_id, customer_email, flight_num, status FROM decided""", recursive=True)

    q["book_tickets_agent_same_airline"] = _q("WITH " + _booking_sql(agent=True, same_airline=True) + """
SELECT request_id, booking_agent_email, customer_email, flight_num, status FROM decided""", recursive=True)

    q["customer_monthly_spend_6m_year_end"] = _q("""
WITH months AS (
  SELECT DATE '2000-08-01' AS lo, DATE '2001-01-01' AS hi),
spend AS (
  SELECT customer_email, CAST(date_trunc('month', p_date) AS DATE) AS month_start, SUM(price) AS s
  FROM fm_sales
  WHERE p_date BETWEEN DATE '2000-08-01' AND DATE '2001-01-15' AND p_date >= DATE '2000-07-16'
  GROUP BY 1, 2)
SELECT m.customer_email, m.month_start, CAST(COALESCE(s.s, 0) AS DECIMAL(18,2)) AS spend
FROM (SELECT c.email AS customer_email,
             CAST(unnest(generate_series((SELECT lo FROM months), (SELECT hi FROM months), INTERVAL 1 MONTH)) AS DATE)
               AS month_start
      FROM fm_customer c) m
LEFT JOIN spend s ON s.customer_email = m.customer_email AND s.month_start = m.month_start""")

    for name in ("apply_flight_status", "apply_permission_grants"):
        q[f"{name}_by_buckets"] = q[name]
    q["assign_agents_by_buckets"] = q["assign_agents_to_airline"]

    q["sales_mart_after_batches"] = _q(f"""WITH all_purchases AS (SELECT * FROM fm_purchases
                  UNION ALL SELECT ticket_id, customer_email, booking_agent_email, p_date FROM ({q["booking_rows_purchases"]}) n),
all_tickets AS (SELECT * FROM fm_ticket UNION ALL SELECT ticket_id, flight_num FROM ({q["booking_rows_ticket"]}) n)
SELECT p.ticket_id, p.customer_email, p.booking_agent_email, p.p_date, {", ".join(f"f.{c.strip()}" for c in FLIGHT_COLS.split(","))}
FROM all_purchases p JOIN all_tickets t ON t.ticket_id = p.ticket_id JOIN ({q["apply_flight_status"]}) f ON f.flight_num = t.flight_num""")

    after = _audit_sql()
    for base, name in (("fm_purchases", "all_purchases"), ("fm_ticket", "all_tickets"), ("fm_flight", "flights_left")):
        after = after.replace(base, name)
    q["audit_after_batches"] = _q(f"""WITH all_purchases AS (SELECT ticket_id, customer_email, booking_agent_email, p_date FROM fm_purchases
                  UNION ALL SELECT ticket_id, customer_email, booking_agent_email, p_date FROM ({q["booking_rows_purchases"]}) n),
all_tickets AS (SELECT ticket_id, flight_num FROM fm_ticket UNION ALL SELECT ticket_id, flight_num FROM ({q["booking_rows_ticket"]}) n),
flights_left AS (SELECT * FROM fm_flight WHERE flight_status IS DISTINCT FROM 'delayed')
{after}""")

    q["airline_monthly_chart"] = f"""
SELECT airline_name, month_start, year(month_start) || '-' || month(month_start) AS month_key,
       ['Jan', 'Feb', 'Mar', 'Apr', 'May', 'June', 'July', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'][month(month_start)] AS month_label, tickets
FROM ({q["airline_monthly_tickets_12m"]}) m"""

    spans = [(f"{d(n)}", d()) for n in (30, 31, 365)] + [
        ("DATE '2000-12-01'", "DATE '2000-12-31'"), ("DATE '2001-01-01'", "DATE '2001-03-31'"), ("DATE '1995-03-15'", "DATE '2000-02-29'")]
    for name, key in (("airline", "airline_name"), ("agent", "booking_agent_email"), ("customer", "customer_email")):
        # keys whose first sale is after the last window have no row
        q[f"{name}_windows_from_index"] = _q(f"""WITH span AS ({" UNION ALL ".join(f"SELECT {a} AS window_start, {b} AS window_end" for a, b in spans)}),
keys AS (SELECT {key} FROM fm_sales WHERE {key} IS NOT NULL GROUP BY {key} HAVING MIN(date_trunc('month', p_date)) <= {d()})
SELECT k.{key}, window_start, window_end, COUNT(s.ticket_id) AS tickets,
       CAST(COALESCE(SUM(s.price) FILTER (WHERE s.booking_agent_email IS NULL AND s.ticket_id IS NOT NULL), 0) AS DECIMAL(18,2)) AS revenue_direct,
       CAST(COALESCE(SUM(s.price) FILTER (WHERE s.booking_agent_email IS NOT NULL), 0) AS DECIMAL(18,2)) AS revenue_agent
FROM keys k CROSS JOIN span
LEFT JOIN fm_sales s ON s.{key} = k.{key} AND s.p_date BETWEEN window_start AND window_end
GROUP BY k.{key}, window_start, window_end""")

    return q


def _audit_sql() -> str:
    pks = [("airline", "fm_airline", "name"), ("airline_staff", "fm_staff", "username"), ("airplane", "fm_airplane", "id"),
           ("airport", "fm_airport", "name"), ("flight", "fm_flight", "flight_num"), ("ticket", "fm_ticket", "ticket_id"),
           ("customer", "fm_customer", "email"), ("booking_agent", "fm_agent", "email")]
    fks = [("airline_staff.airline_name", "fm_staff", "airline_name", "fm_airline", "name"),
           ("permission.username", "fm_permission", "username", "fm_staff", "username"),
           ("airplane.airline_name", "fm_airplane", "airline_name", "fm_airline", "name"),
           ("flight.airline_name", "fm_flight", "airline_name", "fm_airline", "name"),
           ("flight.airplane_id", "fm_flight", "airplane_id", "fm_airplane", "id"),
           ("flight.depart_name", "fm_flight", "depart_name", "fm_airport", "name"),
           ("flight.arrive_name", "fm_flight", "arrive_name", "fm_airport", "name"),
           ("ticket.flight_num", "fm_ticket", "flight_num", "fm_flight", "flight_num"),
           ("booking_agent.airline_name", "fm_agent", "airline_name", "fm_airline", "name"),
           ("purchases.ticket_id", "fm_purchases", "ticket_id", "fm_ticket", "ticket_id"),
           ("purchases.customer_email", "fm_purchases", "customer_email", "fm_customer", "email"),
           ("purchases.booking_agent_email", "fm_purchases", "booking_agent_email", "fm_agent", "email")]
    strings = {
        "airline": ("fm_airline", ["name"]),
        "airline_staff": ("fm_staff", ["username", "airline_name", "first_name", "last_name"]),
        "permission": ("fm_permission", ["username", "permission"]),
        "airplane": ("fm_airplane", ["airline_name", "id"]),
        "airport": ("fm_airport", ["name", "city"]),
        "flight": ("fm_flight", ["flight_num", "airline_name", "airplane_id", "depart_name", "arrive_name",
                                 "flight_status"]),
        "ticket": ("fm_ticket", ["ticket_id", "flight_num"]),
        "customer": ("fm_customer", ["email", "name", "street", "city", "state", "passport_number",
                                     "passport_country"]),
        "booking_agent": ("fm_agent", ["email", "b_id", "airline_name"]),
        "purchases": ("fm_purchases", ["ticket_id", "customer_email", "booking_agent_email"]),
    }
    parts = []
    for name, view, col in pks:
        parts.append(f"SELECT 'pk' AS rule, '{name}' AS table_name, CAST({col} AS VARCHAR) AS key, "
                     f"CAST(COUNT(*) AS BIGINT) AS n FROM {view} GROUP BY {col} HAVING COUNT(*) > 1")
    for label, child, col, parent, pcol in fks:
        parts.append(f"SELECT 'fk', '{label}', CAST({col} AS VARCHAR), CAST(COUNT(*) AS BIGINT) FROM {child} "
                     f"WHERE {col} IS NOT NULL AND {col} NOT IN (SELECT {pcol} FROM {parent} WHERE {pcol} IS NOT NULL) "
                     f"GROUP BY {col}")
    for label, view, col in [("airline_staff.username", "fm_staff", "username"),
                             ("permission.username", "fm_permission", "username")]:
        parts.append(f"SELECT 'not_null', '{label}', CAST(NULL AS VARCHAR), CAST(COUNT(*) AS BIGINT) FROM {view} "
                     f"WHERE {col} IS NULL HAVING COUNT(*) > 0")
    for name, (view, cols) in strings.items():
        for col in cols:
            parts.append(f"SELECT 'length', '{name}.{col}', {col}, CAST(COUNT(*) AS BIGINT) FROM {view} "
                         f"WHERE length({col}) > 20 GROUP BY {col}")
    return "\nUNION ALL\n".join(parts)


_NEW_FLIGHTS = """nf AS (
  SELECT o.o_orderkey AS request_id, o.o_orderdate AS ts, CAST(o.o_orderkey AS VARCHAR) AS flight_num,
         CASE WHEN o.o_orderkey % 30 = 0 THEN 'Brand#1' ELSE p.p_brand END AS airline_name,
         CAST(o.o_custkey AS VARCHAR) AS airplane_id, dn.n_name AS depart_name, an.n_name AS arrive_name,
         o.o_orderdate + to_hours(CAST(o.o_orderkey % 24 AS BIGINT)) AS depart_time,
         o.o_orderdate + to_hours(CAST(o.o_orderkey % 24 AS BIGINT))
           + to_hours(CAST(o.o_orderkey % 7 - 1 AS BIGINT)) AS arrive_time
  FROM orders o
  LEFT JOIN part p ON p.p_partkey = o.o_custkey
  JOIN nation dn ON dn.n_nationkey = o.o_custkey % 25
  JOIN nation an ON an.n_nationkey = o.o_orderkey % 25),
nf2 AS (
  SELECT nf.*, COALESCE(nf.flight_num IN (SELECT flight_num FROM fm_flight), FALSE) AS in_table,
         CASE WHEN depart_name = arrive_name THEN 'same_airport'
              WHEN arrive_time <= depart_time THEN 'bad_time'
              WHEN NOT EXISTS (SELECT 1 FROM fm_airplane a
                               WHERE a.id = nf.airplane_id AND a.airline_name = nf.airline_name) THEN 'airplane_not_owned'
              WHEN depart_name NOT IN (SELECT name FROM fm_airport)
                OR arrive_name NOT IN (SELECT name FROM fm_airport) THEN 'unknown_airport' END AS other
  FROM nf),
nf3 AS (SELECT nf2.*, (NOT in_table AND other IS NULL) AS valid FROM nf2),
nf4 AS (
  SELECT nf3.*, EXISTS (SELECT 1 FROM nf3 b WHERE b.valid AND b.flight_num = nf3.flight_num
                          AND (b.ts < nf3.ts OR (b.ts = nf3.ts AND b.request_id < nf3.request_id))) AS late
  FROM nf3)
"""

_STATUS_CHANGES = """sc AS (
  SELECT e.event_id AS request_id, e.ts,
         CASE WHEN e.event_id % 13 = 0 THEN 'Brand#0' ELSE p.p_brand END AS airline_name,
         CAST(e.flight_key AS VARCHAR) AS flight_num,
         CASE e.event_id % 3 WHEN 0 THEN 'upcoming' WHEN 1 THEN 'in-progress' ELSE 'delayed' END AS flight_status
  FROM fm_event e LEFT JOIN part p ON p.p_partkey = e.flight_key
  WHERE e.event_type = 'view'),
sc2 AS (
  SELECT sc.*, f.flight_status AS base_status,
         CASE WHEN f.airline_name IS NULL OR f.airline_name <> sc.airline_name THEN 'unknown_flight'
              WHEN sc.flight_status NOT IN ('upcoming', 'in-progress', 'delayed') THEN 'bad_status' END AS pre
  FROM sc LEFT JOIN fm_flight f ON f.flight_num = sc.flight_num),
sc3 AS (
  SELECT *, COALESCE(LAG(flight_status) OVER (PARTITION BY flight_num ORDER BY ts, request_id), base_status) AS prev
  FROM sc2 WHERE pre IS NULL)
"""

_GRANTS = """gr AS (
  SELECT s_suppkey AS request_id,
         CASE WHEN s_suppkey % 13 = 7 THEN 'staff-nobody-' || CAST(s_suppkey AS VARCHAR)
              ELSE 'staff-' || s_name END AS username,
         CASE WHEN s_suppkey % 11 = 5 THEN 'Root' WHEN s_suppkey % 2 = 0 THEN 'Admin' ELSE 'Operator' END AS permission
  FROM supplier),
gr2 AS (
  SELECT gr.*,
         CASE WHEN gr.username NOT IN (SELECT username FROM fm_staff) THEN 'unknown_user'
              WHEN gr.permission NOT IN ('Admin', 'Operator') THEN 'bad_permission' END AS pre,
         EXISTS (SELECT 1 FROM fm_permission p WHERE p.username = gr.username AND p.permission = gr.permission) AS held
  FROM gr),
gr3 AS (SELECT gr2.*, (pre IS NULL AND NOT held) AS valid FROM gr2),
gr4 AS (
  SELECT gr3.*,
         CASE WHEN pre IS NOT NULL THEN pre
              WHEN held OR EXISTS (SELECT 1 FROM gr3 b WHERE b.valid AND b.username = gr3.username
                                     AND b.permission = gr3.permission AND b.request_id < gr3.request_id)
              THEN 'already_granted' ELSE 'ok' END AS outcome
  FROM gr3)
"""

_MOVES = """mv AS (
  SELECT 2 * s_suppkey AS request_id,
         CASE WHEN s_suppkey % 9 = 4 THEN 'Unknown#' || CAST(s_suppkey AS VARCHAR) ELSE s_name END AS email,
         CASE WHEN s_suppkey % 17 = 3 THEN 'Brand#99'
              ELSE 'Brand#' || CAST((s_suppkey + s_suppkey % 2) % 25 + 1 AS VARCHAR) END AS airline_name
  FROM supplier
  UNION ALL
  SELECT 2 * s_suppkey + 1,
         CASE WHEN s_suppkey % 9 = 4 THEN 'Unknown#' || CAST(s_suppkey AS VARCHAR) ELSE s_name END,
         'Brand#' || CAST((s_suppkey + 1) % 25 + 1 AS VARCHAR)
  FROM supplier),
mv2 AS (
  SELECT mv.*, a.airline_name AS base_airline,
         CASE WHEN a.email IS NULL THEN 'unknown_agent'
              WHEN mv.airline_name NOT IN (SELECT name FROM fm_airline) THEN 'unknown_airline' END AS pre
  FROM mv LEFT JOIN fm_agent a ON a.email = mv.email),
mv3 AS (
  SELECT *, COALESCE(LAG(airline_name) OVER (PARTITION BY email ORDER BY request_id), base_airline) AS prev
  FROM mv2 WHERE pre IS NULL)
"""


def _booking_sql(agent: bool, require_upcoming: bool = False, same_airline: bool = False) -> str:
    """Requests -> ``decided`` (request columns, k = order on the flight, status) as CTEs."""
    if agent:
        req = """req AS (
  SELECT e.event_id AS request_id, e.ts, s.s_name AS booking_agent_email,
         CASE WHEN e.event_id % 11 = 0 THEN 'unknown-' || CAST(e.user_id AS VARCHAR) ELSE c.c_name END AS customer_email,
         CAST(e.flight_key AS VARCHAR) AS flight_num
  FROM fm_event e
  JOIN customer c ON e.user_id = c.c_custkey
  LEFT JOIN part p ON p.p_partkey = e.flight_key
  LEFT JOIN supplier s
    ON s.s_suppkey = CASE WHEN e.event_id % 5 = 0 THEN e.line_supplier
                          ELSE CAST(regexp_extract(p.p_brand, '(\\d+)$', 1) AS BIGINT) - 1 + 25 * (e.event_id % (SELECT GREATEST(4, (MAX(s_suppkey) + 1) // 25) FROM supplier)) END
  WHERE e.event_type = 'click'),"""
        if same_airline:
            req = """req AS (
  SELECT e.event_id AS request_id, e.ts, s.s_name AS booking_agent_email,
         CASE WHEN e.event_id % 11 = 0 THEN 'unknown-' || CAST(e.user_id AS VARCHAR) ELSE c.c_name END AS customer_email,
         CAST(e.flight_key AS VARCHAR) AS flight_num
  FROM fm_event e
  JOIN customer c ON e.user_id = c.c_custkey
  LEFT JOIN part p ON p.p_partkey = e.flight_key
  LEFT JOIN supplier s
    ON s.s_suppkey = CAST(regexp_extract(p.p_brand, '(\\d+)$', 1) AS BIGINT) - 1 + 25 * (e.event_id % (SELECT GREATEST(4, (MAX(s_suppkey) + 1) // 25) FROM supplier))
  WHERE e.event_type = 'click'),"""
        req += """
pre AS (
  SELECT r.*,
         CASE WHEN f.airline_name IS NULL OR a.airline_name IS NULL OR f.airline_name <> a.airline_name THEN -1
              WHEN r.customer_email NOT IN (SELECT email FROM fm_customer) THEN -2 END AS pre_status
  FROM req r
  LEFT JOIN fm_flight f ON f.flight_num = r.flight_num
  LEFT JOIN fm_agent a ON a.email = r.booking_agent_email),"""
    else:
        req = """req AS (
  SELECT e.event_id AS request_id, e.ts, c.c_name AS customer_email,
         CAST(e.flight_key AS VARCHAR) AS flight_num
  FROM fm_event e JOIN customer c ON e.user_id = c.c_custkey
  WHERE e.event_type = 'purchase'),
pre AS (SELECT r.*, CAST(NULL AS INTEGER) AS pre_status FROM req r),"""
    if require_upcoming:
        req = req.replace("pre AS (SELECT r.*, CAST(NULL AS INTEGER) AS pre_status FROM req r),", """pre AS (
  SELECT r.*, CASE WHEN COALESCE(f.flight_status, '') <> 'upcoming' THEN -3 END AS pre_status
  FROM req r LEFT JOIN fm_flight f ON f.flight_num = r.flight_num),""")
    return req + """
seats AS (
  SELECT f.flight_num, a.seats, COALESCE(t.sold, 0) AS sold0
  FROM fm_flight f
  LEFT JOIN fm_airplane a ON a.id = f.airplane_id AND a.airline_name = f.airline_name
  LEFT JOIN (SELECT flight_num, COUNT(*) AS sold FROM fm_ticket GROUP BY flight_num) t
    ON t.flight_num = f.flight_num),
held AS (
  SELECT DISTINCT p.customer_email, t.flight_num
  FROM fm_purchases p JOIN fm_ticket t ON p.ticket_id = t.ticket_id),
ordered AS (
  SELECT pre.*, (h.customer_email IS NOT NULL) AS is_held, s.seats, COALESCE(s.sold0, 0) AS sold0,
         ROW_NUMBER() OVER (PARTITION BY pre.flight_num ORDER BY pre.ts, pre.request_id) AS k
  FROM pre
  LEFT JOIN seats s ON s.flight_num = pre.flight_num
  LEFT JOIN held h ON h.customer_email = pre.customer_email AND h.flight_num = pre.flight_num),
sim AS (
  -- the reference's one-request-at-a-time rule, simulated per flight: one
  -- step per request in (ts, request_id) order, carrying the flight's sold
  -- count and the customers booked so far
  SELECT flight_num, CAST(0 AS BIGINT) AS k, MIN(sold0) AS sold, CAST([] AS VARCHAR[]) AS booked,
         CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS INTEGER) AS status
  FROM ordered GROUP BY flight_num
  UNION ALL
  SELECT flight_num, k, sold + CASE WHEN status = 1 THEN 1 ELSE 0 END,
         CASE WHEN status = 1 THEN list_append(booked, customer_email) ELSE booked END, request_id, status
  FROM (
    SELECT s.flight_num, o.k, s.sold, s.booked, o.request_id, o.customer_email,
           CAST(CASE WHEN o.pre_status IS NOT NULL THEN o.pre_status
                     WHEN o.seats IS NULL OR s.sold >= o.seats THEN 3
                     WHEN o.is_held OR list_contains(s.booked, o.customer_email) THEN 2
                     ELSE 1 END AS INTEGER) AS status
    FROM sim s JOIN ordered o ON o.flight_num = s.flight_num AND o.k = s.k + 1) step),
decided AS (
  SELECT o.*, sim.status FROM ordered o JOIN sim ON sim.request_id = o.request_id)
"""
