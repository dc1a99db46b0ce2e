"""Aggregations, profiles and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import draw, uniform
from ..operators import aggregate as A
from ..operators import loadcurve as L
from .adapters import EV, ORD, event_sessions, order_sessions, with_
from .registry import query


def rounded(df: DataFrame, *names: str, places: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def scenario_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions dealt into four scenarios."""
    return event_sessions(spark, sf_dir).withColumn("scenario", (F.col("session_id") % 4).cast("int"))


SCEN = EV + ", sc AS (SELECT *, CAST(session_id % 4 AS INT) AS scenario FROM ev)"


@query(with_(SCEN) + "SELECT date, scenario, round(sum(energy), 4) AS energy_kwh, count(energy) AS n_sessions, round(avg(duration), 4) AS mean_duration_h, round(sum(power_kw), 4) AS peak_power_kw FROM sc GROUP BY date, scenario")
def daily_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.daily_energy(scenario_sessions(spark, sf_dir)), "energy_kwh", "mean_duration_h", "peak_power_kw")


@query(with_(EV) + "SELECT date, CAST(hour(arrival_time) AS INT) AS slot_hour, location_type, round(sum(energy), 4) AS energy_kwh, count(energy) AS n_sessions, round(sum(power_kw), 4) AS power_kw FROM ev GROUP BY ALL")
def hourly_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.hourly_profile(event_sessions(spark, sf_dir), ("location_type",)), "energy_kwh", "power_kw")


QUANTILES = ", ".join(f"round(quantile_cont(v, {q}), 4) AS {n}" for n, q in A.BANDS.items())


@query(with_(SCEN) + f", d AS (SELECT date, scenario, sum(energy) AS v FROM sc GROUP BY ALL) SELECT date, round(avg(v), 4) AS mean, {QUANTILES} FROM d GROUP BY date")
def scenario_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.scenario_bands(A.daily_energy(scenario_sessions(spark, sf_dir)), "energy_kwh", ["date"])
    return rounded(out, "mean", *A.BANDS)


def _department(freq: str, key: str):
    return with_(ORD) + f"SELECT {key} AS date, department, round(sum(energy), 4) AS energy_kwh, count(*) AS n_sessions, round(avg(energy), 6) AS mean_energy_kwh, round(avg(duration), 6) AS mean_duration_h FROM ord GROUP BY ALL"


@query(_department("W", "date + CAST(7 - isodow(date) AS INT)"))
def department_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(A.aggregate_by_department(order_sessions(spark, sf_dir), "W"), "energy_kwh"), "mean_energy_kwh", "mean_duration_h", places=6)


@query(_department("ME", "last_day(date)"))
def department_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(A.aggregate_by_department(order_sessions(spark, sf_dir), "ME"), "energy_kwh"), "mean_energy_kwh", "mean_duration_h", places=6)


@query(with_(ORD) + "SELECT date, department, round(sum(energy), 4) AS energy_kwh FROM ord WHERE department IN ('NATION_1', 'NATION_2', 'NATION_3') GROUP BY ALL")
def department_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.department_daily_energy(order_sessions(spark, sf_dir), ["NATION_1", "NATION_2", "NATION_3"]), "energy_kwh")


PANEL = with_(ORD) + """, h AS (SELECT date, department, sum(energy) AS v FROM ord GROUP BY ALL), s AS (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM h)
  SELECT s.date, d.department, round(@V@, 4) AS energy_kwh FROM s CROSS JOIN (SELECT DISTINCT department FROM h) d LEFT JOIN h ON h.date = s.date AND h.department = d.department"""


@query(PANEL.replace("@V@", "CASE WHEN v IS NULL AND s.date NOT IN (SELECT date FROM h) THEN 0.0::DOUBLE ELSE v END"))
def panel_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.panel(order_sessions(spark, sf_dir)), "energy_kwh")


@query(PANEL.replace("@V@", "coalesce(v, 0.0::DOUBLE)"))
def panel_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.panel(order_sessions(spark, sf_dir), mode="all"), "energy_kwh")


@query(with_(ORD) + """, c AS (SELECT department, date, count(*) AS n FROM ord GROUP BY ALL), s AS (SELECT department, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM c GROUP BY department)
  SELECT s.department, s.date, coalesce(n, 0) AS n_sessions FROM s LEFT JOIN c USING (department, date)""")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.daily_counts(order_sessions(spark, sf_dir), ("department",))


@query(with_(EV) + ", l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM ev" for c in ("duration", "energy", "power_kw")) + """)
  SELECT feature, count(v) AS "count", round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS "min", round(quantile_cont(v, 0.25), 4) AS p25,
  round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75, round(max(v), 4) AS "max", round(100.0::DOUBLE * count(*) FILTER (WHERE v IS NULL) / count(*), 4) AS missing_pct FROM l GROUP BY feature""")
def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.summary_stats(event_sessions(spark, sf_dir)), "mean", "std", "min", "p25", "p50", "p75", "max", "missing_pct")


@query(with_(ORD) + "SELECT department, season, count(*) AS n, count(DISTINCT date) AS n_dates, round(count(*) / count(DISTINCT date), 4) AS per_day FROM ord GROUP BY ALL HAVING count(*) >= 10")
def context_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.context_rates(order_sessions(spark, sf_dir), ["department", "season"]), "per_day")


OVERLAP = """, x AS (SELECT *, hour + {active} AS z, {power} AS p FROM {src}), y AS (SELECT *, unnest(generate_series(CAST(floor(hour) AS INT), CAST(least(ceil(z), 72) AS INT) - 1)) AS s FROM x WHERE p > 0 AND z > hour),
  e AS (SELECT {keys}, CAST(s % 24 AS INT) AS h, sum(p * (least(z, s + 1) - greatest(hour, s))) AS kwh FROM y GROUP BY ALL),
  d AS (SELECT {keys}, count(*) AS n_sessions, count(DISTINCT date) AS n_days FROM {src} GROUP BY ALL), g AS (SELECT *, unnest(range(24)) AS h FROM d)"""
MEAN = {"active": "duration", "power": "energy / duration"}


@query(with_(EV) + OVERLAP.format(keys="day_of_week, season", src="ev", **MEAN) + " SELECT day_of_week, season, CAST(h AS INT) AS h, round(coalesce(kwh, 0) / n_days / 1000, 6) AS mw, n_sessions FROM g LEFT JOIN e USING (day_of_week, season, h)")
def load_profile_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.load_profiles(event_sessions(spark, sf_dir), ["day_of_week", "season"]), "mw", places=6)


@query(with_(ORD) + OVERLAP.format(keys="location_type", src="ord", active="least(energy / 7.4::DOUBLE, duration)", power="7.4::DOUBLE") + " SELECT location_type, CAST(h AS INT) AS h, round(coalesce(kwh, 0) / n_days / 1000, 6) AS mw, n_sessions FROM g LEFT JOIN e USING (location_type, h)")
def load_profile_fixed_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.schema import session_power

    s = session_power(order_sessions(spark, sf_dir), "fixed_power", 7.4)
    return rounded(L.load_profiles(s, ["location_type"], F.col("power_used"), F.col("active")), "mw", places=6)


@query(with_(EV) + OVERLAP.format(keys="day_of_week, season", src="ev", **MEAN) + """, p AS (SELECT day_of_week, season, h, coalesce(kwh, 0) / n_days / 1000 AS mw FROM g LEFT JOIN e USING (day_of_week, season, h)),
  t AS (SELECT unnest(generate_series(TIMESTAMP '2025-01-01', TIMESTAMP '2025-12-31 23:00:00', INTERVAL 1 HOUR)) AS ts),
  u AS (SELECT ts, isodow(ts) - 1 AS day_of_week, hour(ts) AS h, CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) IN (3, 4, 5) THEN 'spring' WHEN month(ts) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season FROM t)
  SELECT ts, round(coalesce(mw, 0), 6) AS mw FROM u LEFT JOIN p USING (day_of_week, season, h)""")
def annual_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.annual_series(L.load_profiles(event_sessions(spark, sf_dir), ["day_of_week", "season"]), 2025), "mw", places=6)


@query(with_(EV) + """, r AS (SELECT date, power_kw, CAST(floor(hour / 0.5::DOUBLE) AS INT) AS lo, CAST(floor(least((hour + duration) / 0.5::DOUBLE, 48)) AS INT) AS hi FROM ev),
  s AS (SELECT date, unnest(generate_series(lo, hi - 1)) AS slot, power_kw FROM r WHERE hi > lo), a AS (SELECT date, slot, sum(power_kw) AS kw FROM s GROUP BY ALL)
  SELECT g.date, CAST(g.slot AS INT) AS slot, round(coalesce(kw, 0), 4) AS kw FROM (SELECT date, unnest(range(48)) AS slot FROM (SELECT DISTINCT date FROM ev)) g LEFT JOIN a USING (date, slot)""")
def load_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.load_curve(event_sessions(spark, sf_dir)), "kw")


HIST = ", b AS (SELECT location_type, energy, min(energy) OVER (PARTITION BY location_type) AS lo, max(energy) OVER (PARTITION BY location_type) AS hi FROM ev), c AS (SELECT location_type, CAST(least(floor((energy - lo) / ((hi - lo) / 40)), 39) AS INT) AS bin, count(*) AS n, any_value((hi - lo) / 40) AS width FROM b WHERE hi > lo GROUP BY ALL)"


@query(with_(EV) + HIST + " SELECT location_type, bin, n, round(n / (sum(n) OVER (PARTITION BY location_type) * width), 6) AS density FROM c")
def energy_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.histogram(event_sessions(spark, sf_dir), "energy", 40, ("location_type",)), "density", places=6)


@query(with_(EV) + "SELECT day_of_week, " + ", ".join(f"round(coalesce(sum(energy) FILTER (WHERE floor(hour) = {h}), 0), 4) AS h{h:02d}" for h in range(24)) + " FROM ev GROUP BY day_of_week")
def energy_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.heatmap(event_sessions(spark, sf_dir), "energy")
    return rounded(out, *out.columns[1:])


@query(with_(ORD) + "SELECT season, " + ", ".join(f"round(avg(energy) FILTER (WHERE day_of_week = {d}), 4) AS d{d}" for d in range(7)) + " FROM ord GROUP BY season")
def weekday_season_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = order_sessions(spark, sf_dir).groupBy("season").pivot("day_of_week", list(range(7))).agg(F.avg("energy"))
    return out.select("season", *(F.round(F.col(str(d)), 4).alias(f"d{d}") for d in range(7)))


NAT = ORD + """, sc AS (SELECT *, CAST(floor((('0x' || substr(md5(session_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * 5) AS INT) AS scenario FROM ord), nat AS (SELECT date, scenario, sum(energy) AS v FROM sc GROUP BY ALL)"""


def national(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = order_sessions(spark, sf_dir).withColumn("scenario", F.floor(uniform("session_id") * 5).cast("int"))
    return s.groupBy("date", "scenario").agg(F.sum("energy").alias("v"))


@query(with_(NAT) + "SELECT last_day(date) AS month_end, scenario, round(sum(v), 4) AS total, round(avg(v), 8) AS mean FROM nat GROUP BY ALL")
def monthly_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = national(spark, sf_dir).groupBy(A.period("ME").alias("month_end"), "scenario").agg(F.sum("v").alias("total"), F.avg("v").alias("mean"))
    return rounded(rounded(out, "total"), "mean", places=8)


@query(with_(NAT) + "SELECT CAST(date_trunc('quarter', date) AS DATE) AS quarter, scenario, round(sum(v), 4) AS total FROM nat GROUP BY ALL")
def quarterly_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(national(spark, sf_dir).groupBy(A.period("QS").alias("quarter"), "scenario").agg(F.sum("v").alias("total")), "total")


@query(with_(NAT) + """, b AS (SELECT date, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.9) AS p90 FROM nat GROUP BY date)
  SELECT round(avg((p90 - p10) / greatest(med, 1e-6::DOUBLE)), 6) AS relative_width, count(*) AS n_days FROM b""")
def band_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = A.scenario_bands(national(spark, sf_dir), "v", ["date"])
    width = (F.col("p90") - F.col("p10")) / F.greatest("median", F.lit(1e-6))
    return b.agg(F.round(F.avg(width), 6).alias("relative_width"), F.count("*").alias("n_days"))


@query(with_(NAT) + """, r AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY date DESC) AS n FROM nat)
  SELECT scenario, round(avg(v), 4) AS baseline, max(date) AS last_date, round(arg_max(v, date), 4) AS anchor FROM r WHERE n <= 30 GROUP BY scenario""")
def recent_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.tail_days(national(spark, sf_dir), 30, ("scenario",))
    return t.groupBy("scenario").agg(F.round(F.avg("v"), 4).alias("baseline"), F.max("date").alias("last_date"), F.round(F.max_by("v", "date"), 4).alias("anchor"))


@query(with_(NAT) + """, m AS (SELECT scenario, CAST(date_trunc('quarter', date) AS DATE) AS date, sum(v) AS v FROM nat GROUP BY ALL), w AS (SELECT *, lag(v) OVER o AS before, first_value(v) OVER o AS first_v,
  year(date) + month(date) / 12.0::DOUBLE AS t FROM m WINDOW o AS (PARTITION BY scenario ORDER BY date)), g AS (SELECT *, (coalesce(lead(v) OVER o, v) - coalesce(lag(v) OVER o, v)) / (coalesce(lead(t) OVER o, t) - coalesce(lag(t) OVER o, t)) AS slope FROM w WINDOW o AS (PARTITION BY scenario ORDER BY t))
  SELECT scenario, date, round(v, 4) AS v, round(v / before - 1, 6) AS change, round(v / first_v, 6) AS ratio, round(slope, 3) AS slope, round(stddev_samp(v / before - 1) OVER (PARTITION BY scenario), 6) AS volatility FROM g""")
def series_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    m = national(spark, sf_dir).groupBy("scenario", A.period("QS").alias("date")).agg(F.sum("v").alias("v"))
    m = m.withColumn("t", F.year("date") + F.month("date") / F.lit(12.0))
    out = A.gradient(A.growth_ratio(A.returns(m, "v", ("scenario",)), "v", ("scenario",)), "v", "t", ("scenario",))
    out = out.withColumn("volatility", F.stddev_samp("change").over(Window.partitionBy("scenario"))).drop("t")
    return rounded(rounded(rounded(out, "v"), "change", "ratio", "volatility", places=6), "slope", places=3)


@query(with_(NAT) + """, l AS (SELECT max(date) AS t0, arg_max(v, date) AS v0 FROM (SELECT date, sum(v) AS v FROM nat WHERE date < DATE '1998-01-01' GROUP BY date)), f AS (SELECT * FROM nat WHERE date >= DATE '1997-12-31')
  SELECT f.scenario, f.date, round(v, 4) AS v FROM f, l WHERE date <> t0 UNION ALL SELECT scenario, t0, round(v0, 4) FROM (SELECT DISTINCT scenario FROM f), l""")
def anchored_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = national(spark, sf_dir)
    seen = n.filter("date < '1998-01-01'").groupBy("date").agg(F.sum("v").alias("v"))
    return rounded(A.anchored(n.filter("date >= '1997-12-31'"), seen, "v"), "v")


@query(with_(NAT) + "SELECT date, " + ", ".join(f"round(any_value(v) FILTER (WHERE scenario = {i}), 4) AS s{i}" for i in range(5)) + " FROM nat GROUP BY date")
def wide_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.pivot_scenarios(national(spark, sf_dir), "v", list(range(5))), *(f"s{i}" for i in range(5)))


@query(with_(NAT) + """, m AS (SELECT date, quantile_cont(v, 0.5) AS med, sum(v) AS real FROM nat GROUP BY date)
  SELECT date, round(real, 4) AS real, round(med, 4) AS median, round(med / real, 6) AS ratio, med / real > 0.5::DOUBLE AS high FROM m""")
def real_against_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = national(spark, sf_dir)
    m = A.scenario_bands(n, "v", ["date"]).select("date", "median")
    out = n.groupBy("date").agg(F.sum("v").alias("real")).join(m, "date").withColumn("ratio", F.try_divide(F.col("median"), F.col("real")))
    return rounded(rounded(out.withColumn("high", F.col("ratio") > 0.5), "real", "median"), "ratio", places=6)


@query(with_(EV) + ", d AS (SELECT location_type, ('0x' || substr(md5('mix|' || session_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM ev) SELECT location_type, CASE WHEN u < 0.25::DOUBLE THEN 3.7::DOUBLE WHEN u < 0.75::DOUBLE THEN 7.4::DOUBLE ELSE 22.0::DOUBLE END AS kw, count(*) AS n FROM d GROUP BY ALL")
def charger_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    kw = draw({3.7: 1.0, 7.4: 2.0, 22.0: 1.0}, uniform(F.lit("mix"), "session_id"))
    return event_sessions(spark, sf_dir).groupBy("location_type", kw.alias("kw")).agg(F.count("*").alias("n"))
