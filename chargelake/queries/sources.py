"""Sources and schema: reading, normalising, validating, filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import CHARGER_MIX
from ..operators import schema as S
from ..sources.readers import cached_cells, cached_table, export, load_datasets, load_sessions, local_series, shared_folder
from .adapters import EV, ORD, event_sessions, national_raw, order_sessions, raw_events, raw_orders, with_
from .registry import query

CALENDAR = "hour, day_of_week, month, season, is_weekend, date"


@query(with_(EV) + "SELECT session_id, arrival_time, round(duration, 4) AS duration, round(energy, 4) AS energy, power_kw, location_type, department, round(hour, 4) AS hour, day_of_week, month, season, is_weekend, date FROM ev")
def validated_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_sessions(spark, sf_dir)
    return s.select(
        "session_id", "arrival_time", F.round("duration", 4).alias("duration"), F.round("energy", 4).alias("energy"), "power_kw", "location_type",
        "department", F.round("hour", 4).alias("hour"), "day_of_week", "month", "season", "is_weekend", "date",
    )


@query(with_(ORD) + """SELECT session_id, arrival_time, round(duration * 60 / 60.0::DOUBLE, 4) AS duration, round(energy * 1000 / 1000.0::DOUBLE, 4) AS energy,
  CASE flag WHEN 'A' THEN 'work' WHEN 'N' THEN 'home' ELSE 'public' END AS location_type, department FROM ord_raw
  WHERE status = 'O' AND duration > 0 AND duration < 168 AND energy >= 0 AND energy < 400""")
def national_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.validate(national_raw(spark, sf_dir))
    return s.select("session_id", "arrival_time", F.round("duration", 4).alias("duration"), F.round("energy", 4).alias("energy"), "location_type", "department")


@query(with_(EV) + """, r AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT coalesce(duration > 0 AND duration < 168, false)) AS duration,
  count(*) FILTER (WHERE NOT coalesce(energy >= 0 AND energy < 400, false)) AS energy, count(*) FILTER (WHERE arrival_time IS NULL) AS arrival_time,
  count(*) FILTER (WHERE NOT coalesce(duration > 0 AND duration < 168 AND energy >= 0 AND energy < 400 AND arrival_time IS NOT NULL, false)) AS "any" FROM ev_raw)
  SELECT n_rows, 'duration' AS rule, duration AS n_failed FROM r UNION ALL SELECT n_rows, 'energy', energy FROM r
  UNION ALL SELECT n_rows, 'arrival_time', arrival_time FROM r UNION ALL SELECT n_rows, 'any', "any" FROM r""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quality_report(S.normalised(raw_events(spark, sf_dir)))


@query(with_(EV) + """SELECT session_id, round(epoch_us(arrival_time + to_microseconds(CAST(duration * 3600 AS BIGINT) * 1000000)) / 3.6e9::DOUBLE - epoch_us(arrival_time) / 3.6e9::DOUBLE, 3) AS duration
  FROM ev_raw WHERE CAST(duration * 3600 AS BIGINT) > 0 AND energy >= 0 AND energy < 400""")
def duration_from_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_events(spark, sf_dir)
    end = F.col("Start") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("`Park.Duration`") * 60).cast("long").cast("decimal(18,6)"))
    ended = raw.withColumn("Stop Time", end).drop("Park.Duration")
    return S.validate(ended).select("session_id", F.round("duration", 3).alias("duration"))


FORMATS = ["csv", "tsv", "semicolon", "json", "jsonl", "parquet"]


@query(with_(EV) + ", a AS (SELECT count(*) AS n_sessions, round(sum(energy), 2) AS energy, round(sum(duration), 2) AS duration FROM ev) SELECT f AS format, a.* FROM a, (SELECT unnest(['" + "', '".join(FORMATS) + "']) AS f)")
def scan_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events written in each format, read back and validated."""
    raw, folder = raw_events(spark, sf_dir).drop("Unnamed: 0"), shared_folder(spark)
    text = raw.withColumn("Start", F.date_format("Start", "yyyy-MM-dd HH:mm:ss")).withColumnRenamed("Park.Duration", "Park Duration")
    out = None
    for name in FORMATS:
        path, options, source = f"{folder}/{name}.{'csv' if name == 'semicolon' else name}", {}, text
        if name == "semicolon":
            source = text.withColumns({c: F.regexp_replace(F.col(c).cast("string"), r"\.", ",") for c in ("Energy", "Park Duration")})
            export(source, path, sep=";")
            options = {"decimal_commas": ("Energy", "Park Duration")}
        elif name == "json":
            # files with one array of about a thousand records each, however many records there are
            records = F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*source.columns))), ","), F.lit("]"))
            files = F.lit(max(1, source.count() // 1000))
            source.groupBy(F.pmod(F.xxhash64("session_id"), files).alias("part")).agg(records.alias("value")).write.partitionBy("part").text(path)
        else:
            export(source, path)
        if name in ("json", "jsonl"):
            options = {"schema": source.schema}
        s = load_sessions(spark, path, **options)
        one = s.agg(F.lit(name).alias("format"), F.count("*").alias("n_sessions"), F.round(F.sum("energy"), 2).alias("energy"), F.round(F.sum("duration"), 2).alias("duration"))
        out = one if out is None else out.unionByName(one)
    return out


@query(with_(EV, ORD) + """SELECT 'events' AS dataset, count(*) AS n_sessions, round(sum(energy), 2) AS energy, count(DISTINCT department) AS n_departments FROM ev
  UNION ALL SELECT 'orders', count(*), round(sum(energy), 2), count(DISTINCT department) FROM ord""")
def multi_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = raw_orders(spark, sf_dir).drop("status", "flag")
    both = load_datasets(spark, {"events": raw_events(spark, sf_dir), "orders": orders, "both": orders}, exclude=("both",))
    return both.groupBy("dataset").agg(F.count("*").alias("n_sessions"), F.round(F.sum("energy"), 2).alias("energy"), F.count_distinct("department").alias("n_departments"))


@query(with_(EV) + "SELECT date, count(*) AS n_sessions, round(sum(energy), 4) AS energy FROM ev GROUP BY date")
def cached_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second call finds the first one's table."""
    folder = shared_folder(spark)
    build = lambda: event_sessions(spark, sf_dir).groupBy("date").agg(F.count("*").alias("n_sessions"), F.round(F.sum("energy"), 4).alias("energy"))
    cached_table(spark, build, {"freq": "D"}, ["events"], folder)
    return cached_table(spark, lambda: spark.range(0).toDF("never"), {"freq": "D"}, ["events"], folder)


@query(with_(EV) + "SELECT department, date, count(*) AS n_sessions, round(sum(energy), 4) AS energy FROM ev GROUP BY ALL")
def cached_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of areas, kept by area: the first call builds some, the second only the others."""
    s, folder = event_sessions(spark, sf_dir), shared_folder(spark)
    daily = lambda missing: s.join(missing, "department", "left_semi").groupBy("department", "date").agg(F.count("*").alias("n_sessions"), F.round(F.sum("energy"), 4).alias("energy"))
    areas = s.select("department").distinct()
    cached_cells(spark, daily, areas.filter("department < '06'"), ["department"], {"freq": "D"}, folder)
    return cached_cells(spark, daily, areas, ["department"], {"freq": "D"}, folder).select("department", "date", "n_sessions", "energy")


@query(with_(EV, ORD) + """SELECT 'year' AS part, count(*) AS n FROM ord WHERE year(arrival_time) = 1996
  UNION ALL SELECT 'departments', count(*) FROM ord WHERE department IN ('NATION_1', 'NATION_2')
  UNION ALL SELECT 'exclude_last', count(*) FROM ord WHERE date < (SELECT max(date) - 30 FROM ord)
  UNION ALL SELECT 'recent_months', count(*) FROM ord WHERE date >= (SELECT max(date) - INTERVAL 6 MONTH FROM ord)
  UNION ALL SELECT 'full_months', count(*) FROM ord WHERE date < (SELECT date_trunc('month', max(date)) FROM ord) AND date >= (SELECT date_trunc('month', max(date)) - INTERVAL 12 MONTH FROM ord)
  UNION ALL SELECT 'one_day', count(*) FROM ev WHERE date = DATE '2024-01-15'
  UNION ALL SELECT 'subset', count(*) FROM ev WHERE day_of_week = 2 AND location_type = 'work'
  UNION ALL SELECT 'zoom', count(*) FROM ev WHERE date BETWEEN DATE '2024-01-12' AND DATE '2024-01-18'
  UNION ALL SELECT 'expression', count(*) FROM ev WHERE energy > 10 AND duration < 4
  UNION ALL SELECT 'train', count(*) FROM ev WHERE date < DATE '2024-01-20' UNION ALL SELECT 'eval', count(*) FROM ev WHERE date >= DATE '2024-01-20' AND date < DATE '2024-01-27'""")
def session_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, od = event_sessions(spark, sf_dir), order_sessions(spark, sf_dir)
    train, test = S.train_eval(ev, "2024-01-20", 7)
    parts = {
        "year": od.filter(F.year("arrival_time") == 1996),
        "departments": od.filter(F.col("department").isin("NATION_1", "NATION_2")),
        "exclude_last": S.exclude_last_days(od, 30),
        "recent_months": S.recent_months(od, 6),
        "full_months": S.full_months(od, 12),
        "one_day": ev.filter(F.col("date") == F.lit("2024-01-15").cast("date")),
        "subset": ev.filter("day_of_week = 2 and location_type = 'work'"),
        "zoom": ev.filter(F.col("date").between("2024-01-12", "2024-01-18")),
        "expression": ev.filter(F.expr("energy > 10 and duration < 4")),
        "train": train,
        "eval": test,
    }
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(with_(EV) + """SELECT session_id, round(least(energy, power_kw * duration), 4) AS energy, round(ln(1 + duration), 6) AS f_duration, round(ln(1 + least(energy, power_kw * duration)), 6) AS f_energy,
  round(least(greatest(exp(ln(1 + duration)) - 1, 0.08::DOUBLE), 48.0::DOUBLE), 4) AS back_duration FROM ev""")
def capped_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = S.to_features(S.cap_energy(event_sessions(spark, sf_dir)))
    back = S.from_features(f.withColumn("capped", F.col("energy")))
    return back.select("session_id", F.round("capped", 4).alias("energy"), F.round("f_duration", 6).alias("f_duration"), F.round("f_energy", 6).alias("f_energy"), F.round("duration", 4).alias("back_duration"))


U = "(('0x' || substr(md5(session_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


MODES = f""", p AS (SELECT *, {U} AS u FROM {{sessions}}), q AS (SELECT *, CASE location_type
    WHEN 'home' THEN CASE WHEN u < 0.3::DOUBLE THEN 3.7::DOUBLE WHEN u < 0.3::DOUBLE + 0.6::DOUBLE THEN 7.4::DOUBLE ELSE 11.0::DOUBLE END
    WHEN 'work' THEN CASE WHEN u < 0.55::DOUBLE THEN 7.4::DOUBLE WHEN u < 0.55::DOUBLE + 0.25::DOUBLE THEN 11.0::DOUBLE ELSE 22.0::DOUBLE END
    WHEN 'public' THEN CASE WHEN u < 0.4::DOUBLE THEN 22.0::DOUBLE WHEN u < 0.75::DOUBLE THEN 50.0::DOUBLE WHEN u < 0.95::DOUBLE THEN 150.0::DOUBLE ELSE 350.0::DOUBLE END
    ELSE energy / duration END AS drawn FROM p)
  SELECT session_id, round(energy / duration, 9) AS mean_power, round(least(energy / 7.4::DOUBLE, duration), 4) AS fixed_active, round(drawn, 9) AS drawn_power, round(least(energy / nullif(drawn, 0), duration), 4) AS drawn_active FROM q"""


def modes(ev: DataFrame) -> DataFrame:
    mean = S.session_power(ev).select("*", F.col("power_used").alias("mean_power")).drop("power_used", "active")
    fixed = S.session_power(mean, "fixed_power", 7.4).withColumn("fixed_active", F.col("active")).drop("power_used", "active")
    drawn = S.session_power(fixed, "by_location", mix=CHARGER_MIX["2024"])
    return drawn.select("session_id", F.round("mean_power", 9).alias("mean_power"), F.round("fixed_active", 4).alias("fixed_active"), F.round("power_used", 9).alias("drawn_power"), F.round("active", 4).alias("drawn_active"))


@query(with_(EV) + MODES.format(sessions="ev"))
def charging_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes(event_sessions(spark, sf_dir))


@query(with_(EV) + ", idle AS (SELECT * REPLACE (CASE WHEN session_id % 10 = 0 THEN 0 ELSE energy END AS energy) FROM ev)" + MODES.format(sessions="idle"))
def charging_modes_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session of ten took no energy, also at places without a charger mix."""
    ev = event_sessions(spark, sf_dir)
    return modes(ev.withColumn("energy", F.when(F.col("session_id") % 10 == 0, 0.0).otherwise(F.col("energy"))))


@query(with_(EV) + "SELECT session_id, arrival_time + INTERVAL 7 DAY AS arrival_time, date + 7 AS date, round(energy, 4) AS energy FROM ev WHERE date >= DATE '2024-01-08' AND date < DATE '2024-01-15'")
def week_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shifted_week(event_sessions(spark, sf_dir), "2024-01-08").select("session_id", "arrival_time", "date", F.round("energy", 4).alias("energy"))


@query(with_(EV) + "SELECT location_type, count(*) AS n_sessions, count(DISTINCT department) AS n_departments FROM ev GROUP BY location_type")
def load_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.load_overview(event_sessions(spark, sf_dir), ["location_type", "not_there"])


SITES = "CASE user_id % 3 WHEN 0 THEN 'Caltech' WHEN 1 THEN 'jpl' ELSE 'office' END"


@query(f"""WITH t AS (SELECT event_type, {SITES} AS site FROM events), k AS (SELECT 'known' AS part, lower(site) AS site FROM t UNION ALL SELECT 'one', 'jpl' FROM t UNION ALL SELECT 'others', CASE WHEN event_type = 'error' THEN 'elsewhere' ELSE lower(site) END FROM t)
  SELECT part, coalesce(string_agg(DISTINCT site, ',' ORDER BY site) FILTER (WHERE site IN ('caltech', 'jpl', 'office')), '') AS sites, count(*) FILTER (WHERE site NOT IN ('caltech', 'jpl', 'office')) AS n_other,
    count(*) FILTER (WHERE site NOT IN ('caltech', 'jpl', 'office')) = 0 AND count(DISTINCT site) > 1 AS combined FROM k GROUP BY part""")
def combined_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a raw table is several known sites put together: three of them, one, and three among others."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    site = F.when(F.col("user_id") % 3 == 0, "Caltech").when(F.col("user_id") % 3 == 1, "jpl").otherwise("office")
    parts = {"known": site, "one": F.lit("JPL"), "others": F.when(F.col("event_type") == "error", "elsewhere").otherwise(site)}
    rows = [S.combined_site_check(e.select(c.alias("data"))).withColumn("part", F.lit(n)) for n, c in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT date_trunc('second', ts) AS ts, round(value, 4) AS value FROM events WHERE year(ts) = 2024 AND value <> round(value)")
def decimal_comma_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as text with decimal commas and a zone behind the local time, written, read, and one year kept."""
    e, path = spark.read.parquet(f"{sf_dir}/events.parquet"), f"{shared_folder(spark)}/series.csv"
    zone = F.when(F.col("event_id") % 2 == 0, "+02:00").otherwise("Z")
    at = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    export(e.filter("value <> round(value)").select(at.alias("Horodate"), F.regexp_replace(F.col("value").cast("string"), r"\.", ",").alias("Valeur")), path, sep=";")
    s = local_series(spark.read.options(header=True, sep=";").csv(path), "Horodate", "Valeur", 2024)
    return s.select("ts", F.round("value", 4).alias("value"))
