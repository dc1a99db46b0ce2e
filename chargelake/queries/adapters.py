"""The given tables as charging sessions, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import renewable_share, tariff
from ..operators.schema import validate, with_calendar


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a raw table of a charging network, with its odd names and minutes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    site = F.when(F.col("event_type") == "click", "Bureau").when(F.col("event_type") == "view", " Residential ")
    site = site.when(F.col("event_type") == "purchase", "street").when(F.col("event_type") == "signup", "po_lo").otherwise("depot")
    kind = F.pmod("user_id", F.lit(4))
    return e.select(
        F.col("event_id").alias("session_id"),
        F.col("ts").cast("timestamp_ntz").alias("Start"),
        (F.hour("ts") + F.minute("ts") / 60).alias("Arrival"),
        (F.get_json_object("props", "$.k").cast("double") * 20).alias("Park.Duration"),
        F.col("value").alias("Energy"),
        site.alias("site_type"),
        F.when(kind == 0, 3.7).when(kind == 1, 7.4).when(kind == 2, 11.0).otherwise(22.0).alias("power_kw"),
        F.lpad((F.col("user_id") % 12).cast("string"), 2, "0").alias("dept"),
        F.lit("x").alias("Unnamed: 0"),
    )


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(raw_events(spark, sf_dir)).withColumnRenamed("power", "power_kw")


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as sessions of several years, with the supplier's nation as department."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    near = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    rows = t("lineitem").join(near, F.col("l_suppkey") == F.col("s_suppkey"))
    day, minutes = F.to_date("l_shipdate"), F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber") * 131, F.lit(1440)).cast("int")
    flag, charger = F.col("l_returnflag"), F.pmod("l_suppkey", F.lit(3))
    id_ = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day.cast("string"), F.col("l_quantity").cast("long"))
    return rows.select(
        F.md5(id_).alias("session_id"),
        (day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)).alias("arrival_time"),
        (F.col("l_quantity") / 4.0).cast("double").alias("duration"),
        (F.col("l_quantity") * (F.lit(0.5) + 10 * F.col("l_discount"))).cast("double").alias("energy"),
        F.when(flag == "A", "work").when(flag == "N", "home").otherwise("public").alias("location_type"),
        F.when(charger == 0, 7.4).when(charger == 1, 11.0).otherwise(22.0).alias("power_kw"),
        F.col("n_name").alias("department"),
        F.col("l_linestatus").alias("status"),
        flag.alias("flag"),
    )


def order_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_calendar(raw_orders(spark, sf_dir)).drop("status", "flag")


def national_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = raw_orders(spark, sf_dir)
    return o.select(
        "session_id",
        F.col("arrival_time").alias("debut_session_timestamp"),
        (F.col("duration") * 60).alias("duree_min"),
        (F.col("energy") * 1000).alias("energie_delivree_wh"),
        F.when(F.col("status") == "O", "t").otherwise("f").alias("succes_session"),
        F.when(F.col("flag") == "A", "en_pri").when(F.col("flag") == "N", "re_co").otherwise("en_opu").alias("id_domaine_subvention"),
        F.col("department").alias("insee_code_departement"),
    )


def slots_of(sessions: DataFrame, resolution_min: int = 30) -> DataFrame:
    """A regular grid of slots over the sessions' days: from the first midnight to the end of the last day."""
    ends = sessions.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(resolution_min))
    last = F.date_add("hi", 1).cast("timestamp_ntz") - step
    return ends.select(F.explode(F.sequence(F.col("lo").cast("timestamp_ntz"), last, step)).alias("ts"))


def price_signal(sessions: DataFrame) -> DataFrame:
    return slots_of(sessions).select("ts", tariff("ts").alias("value"))


def renewable_signal(sessions: DataFrame) -> DataFrame:
    return slots_of(sessions).select("ts", renewable_share("ts").alias("value"))


EV = """ev_raw AS (
  SELECT event_id AS session_id, ts AS arrival_time, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 20 / 60.0::DOUBLE AS duration, value AS energy,
    CASE event_type WHEN 'click' THEN 'work' WHEN 'view' THEN 'home' WHEN 'purchase' THEN 'public' WHEN 'signup' THEN 'heavy' ELSE 'unknown' END AS location_type,
    CASE user_id % 4 WHEN 0 THEN 3.7::DOUBLE WHEN 1 THEN 7.4::DOUBLE WHEN 2 THEN 11.0::DOUBLE ELSE 22.0::DOUBLE END AS power_kw,
    lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') AS department,
    hour(ts) + minute(ts) / 60.0::DOUBLE AS hour, CAST(isodow(ts) - 1 AS INT) AS day_of_week, CAST(month(ts) AS INT) AS month,
    CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) IN (3, 4, 5) THEN 'spring' WHEN month(ts) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season,
    CAST(isodow(ts) >= 6 AS INT) AS is_weekend, CAST(ts AS DATE) AS date
  FROM events
), ev AS (SELECT * FROM ev_raw WHERE duration > 0 AND duration < 168 AND energy >= 0 AND energy < 400 AND arrival_time IS NOT NULL)"""

ORD = """ord_raw AS (
  SELECT md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR), CAST(l_quantity AS BIGINT))) AS session_id,
    CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + to_minutes(CAST((l_orderkey * 7 + l_linenumber * 131) % 1440 AS BIGINT)) AS arrival_time,
    CAST(l_quantity AS DOUBLE) / 4.0::DOUBLE AS duration, CAST(l_quantity AS DOUBLE) * (0.5::DOUBLE + 10 * CAST(l_discount AS DOUBLE)) AS energy,
    CASE l_returnflag WHEN 'A' THEN 'work' WHEN 'N' THEN 'home' ELSE 'public' END AS location_type,
    CASE l_suppkey % 3 WHEN 0 THEN 7.4::DOUBLE WHEN 1 THEN 11.0::DOUBLE ELSE 22.0::DOUBLE END AS power_kw,
    n_name AS department, l_linestatus AS status, l_returnflag AS flag
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), ord AS (
  SELECT session_id, arrival_time, duration, energy, location_type, power_kw, department,
    hour(arrival_time) + minute(arrival_time) / 60.0::DOUBLE AS hour, CAST(isodow(arrival_time) - 1 AS INT) AS day_of_week, CAST(month(arrival_time) AS INT) AS month,
    CASE WHEN month(arrival_time) IN (12, 1, 2) THEN 'winter' WHEN month(arrival_time) IN (3, 4, 5) THEN 'spring' WHEN month(arrival_time) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season,
    CAST(isodow(arrival_time) >= 6 AS INT) AS is_weekend, CAST(arrival_time AS DATE) AS date
  FROM ord_raw
)"""

TARIFF = "CASE WHEN h >= 8 AND h < 10 THEN 0.30::DOUBLE WHEN h >= 17 AND h < 20 THEN 0.28::DOUBLE WHEN h >= 7 AND h < 22 THEN 0.20::DOUBLE ELSE 0.10::DOUBLE END"
RENEWABLE = "least(greatest(greatest(0.0::DOUBLE, cos(pi() * (h - 13) / 7)) + (0.2::DOUBLE + 0.15::DOUBLE * sin(2 * pi() * h / 24 + 1.0::DOUBLE)), 0.0::DOUBLE), 1.0::DOUBLE)"

SLOTS = """slots AS (
  SELECT ts, hour(ts) + minute(ts) / 60.0::DOUBLE AS h FROM (
    SELECT unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP) + INTERVAL 1430 MINUTE, INTERVAL 30 MINUTE)) AS ts FROM ev)
)"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
