"""Fixed schemas of the ten tables (password columns are not carried)."""

from pyspark.sql import types as T

S = T.StringType()

AIRLINE = T.StructType([T.StructField("name", S)])

AIRLINE_STAFF = T.StructType([
    T.StructField("username", S, nullable=False),
    T.StructField("airline_name", S),
    T.StructField("first_name", S),
    T.StructField("last_name", S),
    T.StructField("date_of_birth", T.DateType()),
])

PERMISSION = T.StructType([
    T.StructField("username", S, nullable=False),
    T.StructField("permission", S),
])

AIRPLANE = T.StructType([
    T.StructField("airline_name", S),
    T.StructField("id", S),
    T.StructField("seats", T.IntegerType()),
])

AIRPORT = T.StructType([T.StructField("name", S), T.StructField("city", S)])

FLIGHT = T.StructType([
    T.StructField("flight_num", S),
    T.StructField("airline_name", S),
    T.StructField("airplane_id", S),
    T.StructField("depart_name", S),
    T.StructField("arrive_name", S),
    T.StructField("depart_time", T.TimestampNTZType()),
    T.StructField("arrive_time", T.TimestampNTZType()),
    T.StructField("price", T.DecimalType(10, 2)),
    T.StructField("flight_status", S),
])

TICKET = T.StructType([T.StructField("ticket_id", S), T.StructField("flight_num", S)])

CUSTOMER = T.StructType([
    T.StructField("email", S),
    T.StructField("name", S),
    T.StructField("building_number", T.LongType()),
    T.StructField("street", S),
    T.StructField("city", S),
    T.StructField("state", S),
    T.StructField("phone_number", T.DecimalType(20, 0)),
    T.StructField("passport_number", S),
    T.StructField("passport_expiration", T.DateType()),
    T.StructField("passport_country", S),
    T.StructField("date_of_birth", T.DateType()),
])

BOOKING_AGENT = T.StructType([
    T.StructField("email", S),
    T.StructField("b_id", S),
    T.StructField("airline_name", S),
])

PURCHASES = T.StructType([
    T.StructField("ticket_id", S),
    T.StructField("customer_email", S),
    T.StructField("booking_agent_email", S),
    T.StructField("p_date", T.DateType()),
])

SCHEMAS = {
    "airline": AIRLINE,
    "airline_staff": AIRLINE_STAFF,
    "permission": PERMISSION,
    "airplane": AIRPLANE,
    "airport": AIRPORT,
    "flight": FLIGHT,
    "ticket": TICKET,
    "customer": CUSTOMER,
    "booking_agent": BOOKING_AGENT,
    "purchases": PURCHASES,
}

FLIGHT_COLUMNS = [f.name for f in FLIGHT.fields]

# The status and permission vocabularies of the data model.
STATUS_UPCOMING = "upcoming"
STATUS_IN_PROGRESS = "in-progress"
STATUS_DELAYED = "delayed"
STATUSES = (STATUS_UPCOMING, STATUS_IN_PROGRESS, STATUS_DELAYED)
PERMISSION_ADMIN = "Admin"
PERMISSION_OPERATOR = "Operator"
PERMISSION_PLACEHOLDER = ""

# Declared column lengths (varchar(20) everywhere in the data model).
MAX_VARCHAR = 20
