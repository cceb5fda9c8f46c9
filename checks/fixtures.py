"""Flight-like views over the test tables.

``flights`` has the operational schema; the others are views on it or on the conversations. All of them
read whole tables and stay lazy.
"""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farelens.fixed_values import WEEKDAY_NAMES
from farelens.schema import FLIGHT_SCHEMA

HOLIDAY_MONTH_DAYS = ("01-01", "01-28", "02-01", "04-05", "05-01", "05-02")
HOLIDAY_YEARS = range(1995, 2002)
#: Added to ids so that a double cannot hold them; a multiple of ten, so lines stay readable from ids.
BIG_ID = 9_007_199_254_740_990

# A stable order for previews: whatever still ties is alike in every column shown.
PREVIEW_ORDER = ("date", "route_name", "flight_number", "flight_id", "total_revenue", "total_cost")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="farelens-checks-")


def work_folder(spark: SparkSession) -> str:
    """Folder for written tables: the one the session names; a temporary one only for a local session that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or _local_folder()


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems with what belongs to them; lineitem is shuffled by order and by part at most, as numbers.

    Customers go to the orders, which are fewer. Small sides carry keys only, and the names of the 25 nations come last: a join's size
    is guessed as the product of its sides, so that suppliers already joined with nations would not count as small.
    """
    nation = table(spark, sf_dir, "nation")
    origin = nation.select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("departure_city")
    )
    target = nation.select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("arrival_city")
    )
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice")
    return (
        table(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(origin, "s_nationkey")
        .join(target, "c_nationkey")
    )


def _clamped_shift(key: str) -> str:
    """Load factor moved by -0.1 .. 0.1 in steps of 0.05, within [0.3, 0.95]."""
    return f"greatest(0.3D, least(0.95D, load_factor + ({key} % 5 - 2) / 20D))"


_FLIGHT_COLUMNS = (
    {
        "day": "CAST(l_shipdate AS DATE)",
        "seat_capacity": "10 + 2 * c_nationkey",
        "distance": "CAST(250 + 90 * c_nationkey AS DOUBLE)",
    },
    {
        "flight_id": "l_orderkey * 10 + l_linenumber",
        "flight_number": "concat('FL', l_suppkey)",
        "route_name": "concat(departure_city, '-', arrival_city)",
        "flight_date": "date_format(day, 'yyyy-MM-dd')",
        "day_of_week": "weekday(day) + 1",
        "is_holiday": f"CAST(date_format(day, 'MM-dd') IN {HOLIDAY_MONTH_DAYS} AS INT)",
        "aircraft_type": "p_type",
        "load_factor": "greatest(0.4D, least(0.98D, l_quantity / seat_capacity))",
        "avg_ticket_price": "l_extendedprice / l_quantity",
        "discount_rate": "1D - l_discount",
        "subsidy_revenue": "0D",
        "total_revenue": "l_extendedprice * (1D - l_discount)",
        "total_cost": "l_quantity * p_retailprice * CASE s_nationkey % 3 WHEN 0 THEN 0.6D "
        "WHEN 1 THEN 0.7D ELSE 0.8D END",
        "seasonal_index": "CASE WHEN month(day) IN (12, 1, 2) THEN 0.9D "
        "WHEN month(day) IN (6, 7, 8) THEN 1.2D WHEN month(day) IN (3, 4, 5) THEN 1.1D "
        "ELSE 1D END",
        "price_elasticity": "0.5D + (l_partkey % 11) / 10D",
        "flight_hours": "rint(distance / 800D * 100D) / 100D",
        "ask": "seat_capacity * distance / 10000D",
        "price_upper_bound": "p_retailprice * 1.2D",
    },
    {
        "booked_seats": "CAST(floor(seat_capacity * load_factor) AS INT)",
        "variable_cost": "0.7D * total_cost",
        "fixed_cost": "0.2D * total_cost",
        "maintenance_cost": "0.1D * total_cost",
        "passenger_revenue": "total_revenue",
        "profit": "total_revenue - total_cost",
        "rask": "total_revenue / ask",
        "competitor_load_factor": _clamped_shift("l_suppkey"),
        "historical_load_factor": _clamped_shift("l_partkey"),
        "competitor_price": "rint(avg_ticket_price)",
        "optimal_price": "avg_ticket_price",
    },
    {
        "marginal_contribution": "total_revenue - variable_cost",
        "marginal_contribution_rate": "(total_revenue - variable_cost) / total_revenue",
        "profit_rate": "profit / total_revenue",
        "price_lower_bound": "variable_cost / (seat_capacity * 0.7D)",
    },
)


def _with_flight_columns(joined: DataFrame) -> DataFrame:
    """The 36 operational columns, next to the source columns."""
    for step in _FLIGHT_COLUMNS:
        joined = joined.selectExpr("*", *[f"{sql} AS {name}" for name, sql in step.items()])
    return joined


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operational flights, one per lineitem row."""
    names = [field.name for field in FLIGHT_SCHEMA.fields]
    return _with_flight_columns(_joined(spark, sf_dir)).select(*names)


def flights_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights that miss the price on line 3 of an order, the aircraft on line 5, the seats on line 2 and the route on line 6.

    On line 4 the elasticity is not a number. Ids lie above 2 ** 53.
    """
    line = F.col("flight_id") % 10
    return flights(spark, sf_dir).withColumns(
        {
            "flight_id": F.col("flight_id") + F.lit(BIG_ID),
            "avg_ticket_price": F.when(line != 3, F.col("avg_ticket_price")),
            "aircraft_type": F.when(line != 5, F.col("aircraft_type")),
            "booked_seats": F.when(line != 2, F.col("booked_seats")),
            "route_name": F.when(line != 6, F.col("route_name")),
            "price_elasticity": F.when(line == 4, F.lit(float("nan"))).otherwise(F.col("price_elasticity")),
        }
    )


def analytic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights with the analytic column names and a date, not capped."""
    return flights(spark, sf_dir).withColumns(
        {
            "date": F.to_date("flight_date"),
            "month": F.month("flight_date"),
            "ticket_price": F.col("avg_ticket_price"),
            "profit_margin": F.col("profit_rate"),
            "sold_seats": F.col("booked_seats"),
        }
    )


def flight_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights before pricing: distance, rates, base load and discount, no money yet."""
    return _with_flight_columns(_joined(spark, sf_dir)).selectExpr(
        "flight_id",
        "route_name",
        "flight_date",
        "day_of_week",
        "is_holiday",
        "aircraft_type",
        "seat_capacity",
        "distance",
        "p_retailprice AS base_price",
        "0.85D + (s_nationkey * 7 + c_nationkey) % 10 / 20D AS seasonal_index",
        "CASE s_nationkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"
        " AS profitability",
        "10D + 8D * (l_discount * 10D) AS variable_cost_per_hour",
        "5D + 60D * l_tax AS fixed_cost_per_flight",
        "0.5D + 1.5D * (l_discount * 10D) AS maintenance_per_hour",
        "0.65D + l_quantity / 200D AS base_load_factor",
        "0.7D + 3D * l_tax AS discount_rate",
        "rint(40D * l_tax * 100D) / 100D AS subsidy_revenue",
        "(l_suppkey % 5 - 2) / 20D AS competitor_load_shift",
        "(l_partkey % 5 - 2) / 20D AS historical_load_shift",
    )


def route_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of the routes that occur, derived from their two nations."""
    pairs = _joined(spark, sf_dir).select(
        "departure_city", "arrival_city", "s_nationkey", "c_nationkey"
    )
    origin, target = F.col("s_nationkey"), F.col("c_nationkey")
    return pairs.distinct().select(
        F.concat("departure_city", F.lit("-"), "arrival_city").alias("route_name"),
        (F.lit(250) + 90 * target).alias("distance"),
        (F.lit(500) + 40 * origin + 10 * target).alias("base_price"),
        (F.lit(0.5) + (origin + target) % 11 / F.lit(10.0)).alias("elasticity"),
        (F.lit(0.85) + (origin * 7 + target) % 10 / F.lit(20.0)).alias("route_season"),
        F.when(origin % 3 == 0, "high").when(origin % 3 == 1, "medium").otherwise("low").alias(
            "profitability"
        ),
    )


def aircraft_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seats per aircraft type, a function of the type's name."""
    kinds = table(spark, sf_dir, "part").select("p_type").distinct()
    return kinds.select(
        F.col("p_type").alias("aircraft_type"), (F.lit(80) + 10 * F.length("p_type")).alias("seats")
    ).filter(F.col("aircraft_type") != "SMALL")


def holiday_dimension(spark: SparkSession) -> DataFrame:
    rows = [(f"{year}-{day}",) for year in HOLIDAY_YEARS for day in HOLIDAY_MONTH_DAYS]
    return spark.createDataFrame(rows, "holiday STRING")


def tier_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subsidy tiers: A for routes of base price under 700, B for those under 900."""
    routes = route_dimension(spark, sf_dir)
    return routes.filter(F.col("base_price") < 900).select(
        "route_name", F.when(F.col("base_price") < 700, "A").otherwise("B").alias("subsidy_tier")
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pricing request per flight."""
    names = F.array(*[F.lit(name) for name in WEEKDAY_NAMES])
    return flights(spark, sf_dir).select(
        F.col("route_name").alias("route"),
        F.col("flight_date").alias("date"),
        (F.col("is_holiday") == 1).alias("is_holiday"),
        F.element_at(names, F.col("day_of_week")).alias("day_of_week"),
        "aircraft_type",
        "seat_capacity",
        "price_elasticity",
        "seasonal_index",
        "load_factor",
        "competitor_load_factor",
        "historical_load_factor",
        F.col("competitor_price").cast("int").alias("competitor_price"),
    )


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn that follows it."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question")
    )
    answered = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    return asked.join(answered, ["conv_id", "turn"])


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses made of the exchanges, in eight shapes.

    0 reasoning field, 1 think tags, 2 word and heading, 3 error, 4 no choices, 5 message without content,
    6 plain, 7 two pairs of think tags.
    """
    shape = (F.col("conv_id") + F.col("turn")) % 8
    question, reply = F.col("question"), F.col("reply")
    content = (
        F.when(shape == 1, F.concat(F.lit("<think>\n"), question, F.lit("\n</think>\n\n"), reply))
        .when(shape == 2, F.concat(F.lit("思考过程:\n"), question, F.lit("\n# 答\n"), reply))
        .when(
            shape == 7,
            F.concat(
                F.lit("前 <think>"),
                question,
                F.lit("</think> 中 <think>二</think> "),
                reply,
                F.lit(" 　\n"),
            ),
        )
        .otherwise(reply)
    )

    def body(message: Column) -> Column:
        usage = F.struct(
            F.struct(F.length("question").alias("reasoning_tokens")).alias(
                "completion_tokens_details"
            )
        )
        return F.to_json(
            F.struct(
                F.array(F.struct(message.alias("message"))).alias("choices"), usage.alias("usage")
            )
        )

    plain = F.struct(content.alias("content"))
    with_field = F.struct(content.alias("content"), question.alias("reasoning_content"))
    json = (
        F.when(shape == 0, body(with_field))
        .when(shape == 3, F.to_json(F.struct(question.alias("error"))))
        .when(shape == 4, F.lit('{"choices":[]}'))
        .when(shape == 5, body(F.struct(F.lit("assistant").alias("role"))))
        .otherwise(body(plain))
    )
    return exchanges(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.col("question").alias("query"),
        json.alias("response_json"),
    )
