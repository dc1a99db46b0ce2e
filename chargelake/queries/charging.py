"""Smart charging and its loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import renewable_share, tariff
from ..operators import loadcurve as L
from ..operators import smart as C
from ..operators.schema import shifted_week
from .adapters import EV, RENEWABLE, SLOTS, TARIFF, event_sessions, price_signal, renewable_signal, slots_of, with_
from .aggregates import rounded
from .registry import query


def _scheduled(sessions: str, signal: str = TARIFF, order: str = "ASC", minutes: int = 30) -> str:
    kwh = f"power_kw * {minutes}::DOUBLE / 60"
    return f"""sig AS (SELECT ts, {signal} AS value FROM slots),
  win AS (SELECT s.session_id, energy, power_kw, ts, value, arrival_time FROM {sessions} s JOIN sig ON ts >= arrival_time AND ts < arrival_time + to_microseconds(CAST(round(duration * 3600 * 1000000) AS BIGINT))),
  rk AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts) AS nth, row_number() OVER (PARTITION BY session_id ORDER BY value {order}, ts) AS best,
    CASE WHEN power_kw > 0 THEN least(ceil(energy / 0.9::DOUBLE / ({kwh})), count(*) OVER (PARTITION BY session_id)) END AS k, arrival_time FROM win),
  sm AS (SELECT session_id, coalesce(sum(value * {kwh}) FILTER (WHERE best <= k), 0) AS cost_smart, coalesce(sum(value * {kwh}) FILTER (WHERE nth <= k), 0) AS cost_plug,
    coalesce(min(ts) FILTER (WHERE best <= k), any_value(arrival_time)) AS scheduled_start, max(k) AS k FROM rk WHERE k IS NOT NULL GROUP BY session_id),
  res AS (SELECT s.*, cost_smart, cost_plug, CASE WHEN cost_plug > 0 THEN 100 * (cost_plug - cost_smart) / cost_plug END AS savings_pct, scheduled_start, scheduled_start + to_minutes(CAST(k * {minutes} AS BIGINT)) AS scheduled_end FROM {sessions} s LEFT JOIN sm USING (session_id))"""


COST = "round(cost_smart, 4) AS cost_smart, round(cost_plug, 4) AS cost_plug, round(savings_pct, 9) AS savings_pct, scheduled_start, scheduled_end"


@query(with_(EV, SLOTS, _scheduled("ev")) + f"SELECT session_id, {COST} FROM res")
def smart_charge_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_sessions(spark, sf_dir)
    out = C.smart_charge(s, price_signal(s)).select("session_id", *C.OUTPUT)
    return rounded(rounded(out, "cost_smart", "cost_plug"), "savings_pct", places=9)


@query(with_(EV, SLOTS, _scheduled("ev", f"round({RENEWABLE}, 9)", "DESC")) + f"SELECT session_id, {COST} FROM res")
def smart_charge_renewable(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_sessions(spark, sf_dir)
    signal = renewable_signal(s).withColumn("value", F.round("value", 9))
    return rounded(rounded(C.smart_charge(s, signal, "renewable").select("session_id", *C.OUTPUT), "cost_smart", "cost_plug"), "savings_pct", places=9)


@query(with_(EV, SLOTS, _scheduled("ev")) + """SELECT round(sum(cost_smart), 3) AS total_smart, round(sum(cost_plug), 3) AS total_plug, round(sum(cost_plug - cost_smart), 3) AS total_saved,
  round(avg(savings_pct), 4) AS mean_savings_pct, count(*) AS n_sessions FROM res WHERE cost_plug IS NOT NULL""")
def savings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_sessions(spark, sf_dir)
    out = C.savings_summary(C.smart_charge(s, price_signal(s)))
    return rounded(rounded(out, "total_smart", "total_plug", "total_saved", places=3), "mean_savings_pct")


@query(with_(EV, SLOTS, _scheduled("ev")) + """, k AS (SELECT date, power_kw, greatest(1, ceil(energy / 0.9::DOUBLE / (power_kw * 0.5::DOUBLE))) AS k, epoch_us(arrival_time) - epoch_us(date::TIMESTAMP) AS plug, epoch_us(scheduled_start) - epoch_us(date::TIMESTAMP) AS smart FROM res),
  l AS (SELECT date, power_kw, k, 'plug' AS kind, plug / 3.6e9::DOUBLE / 0.5::DOUBLE AS f FROM k UNION ALL SELECT date, power_kw, k, 'smart', smart / 3.6e9::DOUBLE / 0.5::DOUBLE FROM k WHERE smart IS NOT NULL),
  b AS (SELECT date, kind, power_kw, greatest(CAST(trunc(f) AS INT), 0) AS lo, CAST(least(greatest(CAST(trunc(f) AS INT), 0) + k, 48) AS INT) AS hi FROM l)
  SELECT date, kind, CAST(slot AS INT) AS slot, round(sum(power_kw), 4) AS kw FROM (SELECT date, kind, power_kw, unnest(generate_series(lo, hi - 1)) AS slot FROM b WHERE hi > lo) GROUP BY ALL""")
def shift_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_sessions(spark, sf_dir)
    return rounded(L.shift_curves(C.smart_charge(s, price_signal(s))), "kw")


@query(with_(EV, SLOTS, _scheduled("ev")) + """, p AS (SELECT hour(scheduled_start) + minute(scheduled_start) / 60.0::DOUBLE AS hour, day_of_week, season, date, energy, 7.4::DOUBLE AS p, least(greatest(energy / 7.4::DOUBLE, 0), 48) AS d FROM res WHERE scheduled_start IS NOT NULL),
  y AS (SELECT *, unnest(generate_series(CAST(floor(hour) AS INT), CAST(least(ceil(hour + d), 72) AS INT) - 1)) AS s FROM p WHERE d > 0)
  SELECT day_of_week, season, CAST(s % 24 AS INT) AS h, round(sum(p * (least(hour + d, s + 1) - greatest(hour, s))), 3) AS kwh FROM y GROUP BY ALL""")
def smart_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy by hour of the day when charging begins at the scheduled start."""
    s = event_sessions(spark, sf_dir)
    return rounded(L.smart_profile(C.smart_charge(s, price_signal(s)), ["day_of_week", "season"]), "kwh", places=3)


REGRET = with_(EV, SLOTS) + """, st AS (
    SELECT 'oracle/' || session_id AS session_id, arrival_time, duration, energy, power_kw, 'oracle' AS strategy FROM ev WHERE date >= DATE '2024-01-15' AND date < DATE '2024-01-22'
    UNION ALL SELECT 'persistence/' || session_id, arrival_time + INTERVAL 7 DAY, duration, energy, power_kw, 'persistence' FROM ev WHERE date >= DATE '2024-01-08' AND date < DATE '2024-01-15'),
  """ + _scheduled("st") + """, t AS (SELECT strategy, sum(cost_smart) AS c, sum(cost_plug) AS p, sum(energy) AS e FROM res GROUP BY strategy), o AS (SELECT c AS c0, e AS e0, p AS p0 FROM t WHERE strategy = 'oracle')
  SELECT strategy, round(c, 3) AS cost_smart, round(c - c0, 3) AS regret, round(greatest(c / e - c0 / e0, 0), 6) AS regret_per_kwh, round(p0, 3) AS oracle_plug FROM t, o"""


@query(REGRET)
def charging_regret(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_sessions(spark, sf_dir)
    oracle = s.filter(F.col("date").between("2024-01-15", "2024-01-21"))
    out = C.regret({"oracle": oracle, "persistence": shifted_week(s, "2024-01-08")}, price_signal(s))
    return rounded(rounded(out, "cost_smart", "regret", "oracle_plug", places=3), "regret_per_kwh", places=6)


@query(with_(EV) + "SELECT day_of_week, season, min(date) AS representative FROM ev GROUP BY ALL")
def representative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.representative_dates(event_sessions(spark, sf_dir))


FROM_HOURS = "hv AS (SELECT session_id, CAST(date AS TIMESTAMP) + to_microseconds(CAST(round(hour * 3600 * 1000000) AS BIGINT)) AS arrival_time, duration, energy, 7.4::DOUBLE AS power_kw FROM ev)"


@query(with_(EV, FROM_HOURS, SLOTS, _scheduled("hv")) + f"SELECT session_id, arrival_time, {COST} FROM res")
def smart_charge_from_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with a date and an hour only, and no power: the arrival is made, the power is the default."""
    s = event_sessions(spark, sf_dir)
    bare = s.select("session_id", "date", F.col("hour").alias("arrival_hour"), "duration", "energy")
    return rounded(rounded(C.smart_charge(bare, price_signal(s)).select("session_id", "arrival_time", *C.OUTPUT), "cost_smart", "cost_plug"), "savings_pct", places=9)


@query(with_(EV, SLOTS, _scheduled("ev").replace("sig AS (SELECT ts, ", "sig AS (SELECT ts + INTERVAL 5 MINUTE AS ts, ")) + f"SELECT session_id, {COST} FROM res")
def smart_charge_off_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal whose times lie five minutes off the grid of slots."""
    s = event_sessions(spark, sf_dir)
    late = price_signal(s).withColumn("ts", F.col("ts") + F.expr("interval 5 minutes"))
    return rounded(rounded(C.smart_charge(s, late).select("session_id", *C.OUTPUT), "cost_smart", "cost_plug"), "savings_pct", places=9)


FINE = SLOTS.replace("1430 MINUTE", "1435 MINUTE").replace("INTERVAL 30 MINUTE", "INTERVAL 5 MINUTE")


@query(with_(EV, FINE, _scheduled("ev", f"round({RENEWABLE}, 9)", "DESC", 5)) + f"SELECT session_id, {COST} FROM res")
def smart_charge_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A renewable signal of five minutes."""
    s = event_sessions(spark, sf_dir)
    signal = slots_of(s, 5).select("ts", F.round(renewable_share("ts"), 9).alias("value"))
    out = C.smart_charge(s, signal, "renewable", resolution_min=5).select("session_id", *C.OUTPUT)
    return rounded(rounded(out, "cost_smart", "cost_plug"), "savings_pct", places=9)


IDLE = "idle AS (SELECT * REPLACE (CASE WHEN session_id % 10 = 0 THEN 0 ELSE energy END AS energy, CASE WHEN session_id % 10 = 1 THEN 0 ELSE power_kw END AS power_kw) FROM ev)"


def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ten sessions one took no energy and one had no power."""
    s, last = event_sessions(spark, sf_dir), F.col("session_id") % 10
    return s.withColumns({"energy": F.when(last == 0, 0.0).otherwise(F.col("energy")), "power_kw": F.when(last == 1, 0.0).otherwise(F.col("power_kw"))})


@query(with_(EV, IDLE, SLOTS, _scheduled("idle")) + f"SELECT session_id, {COST} FROM res")
def smart_charge_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = idle_sessions(spark, sf_dir)
    return rounded(rounded(C.smart_charge(s, price_signal(s)).select("session_id", *C.OUTPUT), "cost_smart", "cost_plug"), "savings_pct", places=9)


@query(with_(EV) + """SELECT location_type, count(*) AS n_sessions, round(sum(energy), 3) AS kwh, round(sum(CASE WHEN hour + duration > 72 THEN energy / duration * (hour + duration - 72) ELSE 0 END), 3) AS lost_kwh,
  count(*) FILTER (WHERE hour + duration > 72) AS n_beyond FROM ev WHERE energy > 0 GROUP BY location_type""")
def energy_beyond(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a profile of 72 hours loses of longer sessions."""
    return rounded(L.energy_beyond(event_sessions(spark, sf_dir), ["location_type"]), "kwh", "lost_kwh", places=3)


@query(with_(EV, SLOTS) + f"""SELECT ts, round({TARIFF}, 4) AS day_night, round(least(greatest(0.15::DOUBLE + 0.08::DOUBLE * sin(2 * pi() * h / 24 - pi() / 3), 0.02::DOUBLE), 0.40::DOUBLE), 6) AS spot_like,
  0.15::DOUBLE AS flat, round({RENEWABLE}, 6) AS renewable FROM slots""")
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tariffs and renewable share of every half hour of the sessions' days."""
    t = slots_of(event_sessions(spark, sf_dir)).select(
        "ts", tariff("ts").alias("day_night"), tariff("ts", "spot_like").alias("spot_like"), F.lit(0.15).alias("flat"), renewable_share("ts").alias("renewable")
    )
    return rounded(rounded(t, "day_night"), "spot_like", "renewable", places=6)


#: Prices that hold from one purchase of a user to the next: intervals of all lengths that overlap and leave gaps.
VALID = """vf AS (SELECT user_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to, ln(1 + value) / 20 AS value FROM events WHERE event_type = 'purchase'),
  mt AS (SELECT session_id, energy, duration, value, epoch_us(least(arrival_time + to_microseconds(CAST(round(duration * 3600 * 1000000) AS BIGINT)), valid_to)) - epoch_us(greatest(arrival_time, valid_from)) AS us
    FROM ev JOIN vf ON arrival_time < valid_to AND valid_from < arrival_time + to_microseconds(CAST(round(duration * 3600 * 1000000) AS BIGINT)) WHERE valid_from < valid_to)"""


@query(with_(EV, VALID) + "SELECT session_id, round(coalesce(sum(us / 3.6e9::DOUBLE), 0), 6) AS covered_h, round(coalesce(sum(energy / duration * us / 3.6e9::DOUBLE * value), 0), 5) AS cost FROM ev LEFT JOIN mt USING (session_id) GROUP BY session_id".replace("energy / duration", "mt.energy / mt.duration"))
def cost_of_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_sessions(spark, sf_dir)
    bought = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'purchase'")
    next_ = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    tariffs = bought.select(F.col("ts").cast("timestamp_ntz").alias("valid_from"), next_.cast("timestamp_ntz").alias("valid_to"), (F.log1p("value") / 20).alias("value"))
    return rounded(C.cost_of_validity(s, tariffs).select("session_id", "covered_h", "cost").withColumn("cost", F.round("cost", 5)), "covered_h", places=6)
