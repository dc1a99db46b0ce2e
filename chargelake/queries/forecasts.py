"""Forecasts, look-back windows, resampling and growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import forecast as R
from .adapters import EV, ORD, event_sessions, order_sessions, with_
from .aggregates import rounded
from .registry import query

COUNTS = """c0 AS (SELECT department, date, count(*) AS n FROM ord WHERE date < DATE '2001-01-01' GROUP BY ALL), sp AS (SELECT department, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM c0 GROUP BY department),
  cn AS (SELECT department, date, coalesce(n, 0) AS n FROM sp LEFT JOIN c0 USING (department, date))"""
TARGETS = "tg AS (SELECT unnest(generate_series(DATE '2001-01-01', DATE '2001-01-14', INTERVAL 1 DAY))::DATE AS date)"


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.daily_counts(order_sessions(spark, sf_dir).filter("date < '2001-01-01'"), ("department",))


@query(with_(ORD, COUNTS, TARGETS) + """, me AS (SELECT department, avg(n) AS m FROM cn GROUP BY department),
  p AS (SELECT t.date, me.department, m, arg_max(n, cn.date) AS v FROM tg t CROSS JOIN me LEFT JOIN cn ON cn.department = me.department AND isodow(cn.date) = isodow(t.date) AND cn.date BETWEEN t.date - 14 - 364 AND t.date - 14 GROUP BY ALL)
  SELECT department, date, greatest(0, round_even(coalesce(v, m), 0))::DOUBLE AS n_sessions FROM p""")
def persistence_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.persistence_forecast(counts(spark, sf_dir), 2, "2001-01-01", 14, ("department",))


@query(with_(ORD, COUNTS, TARGETS) + """, l AS (SELECT department, avg(n) AS m, stddev_samp(n) AS s FROM cn GROUP BY department)
  SELECT department, date, round(m, 4) AS mean, round(greatest(m - 1.2816::DOUBLE * s, 0), 4) AS p10, round(m + 1.2816::DOUBLE * s, 4) AS p90 FROM l CROSS JOIN tg""")
def normal_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.normal_forecast(counts(spark, sf_dir), "2001-01-01", 14, ("department",)), "mean", "p10", "p90")


DEPARTMENT = with_(ORD, TARGETS) + """, hd AS (SELECT unnest([DATE '2000-01-01', DATE '2000-12-25', DATE '2001-01-01']) AS date), dd AS (SELECT date, department, sum(energy) AS v FROM ord WHERE date < DATE '2001-01-01' GROUP BY ALL),
  rw AS (SELECT dd.*, ln(1 + v) AS y, CAST(dd.date - DATE '1970-01-01' AS DOUBLE) AS t, isodow(dd.date) AS wd, CASE WHEN hd.date IS NULL THEN 0 ELSE 1 END AS hol FROM dd LEFT JOIN hd ON hd.date = dd.date),
  tr AS (SELECT department, count(*) AS n, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, avg(v) AS m, stddev_samp(v) AS s FROM rw GROUP BY department),
  r1 AS (SELECT rw.*, y - (a + b * t) AS r FROM rw JOIN tr USING (department)), we AS (SELECT department, wd, avg(r) AS w FROM r1 GROUP BY ALL),
  ho AS (SELECT department, coalesce(avg(r - w) FILTER (WHERE hol = 1), 0) AS h FROM r1 JOIN we USING (department, wd) GROUP BY department),
  fc AS (SELECT tg.date, tr.department, s, greatest(CASE WHEN n < 60 THEN m ELSE exp(a + b * CAST(tg.date - DATE '1970-01-01' AS DOUBLE) + coalesce(w, 0) + CASE WHEN tg.date IN (SELECT date FROM hd) THEN h ELSE 0 END) - 1 END, 0) AS med
    FROM tg CROSS JOIN tr JOIN ho USING (department) LEFT JOIN we ON we.department = tr.department AND we.wd = isodow(tg.date))
  SELECT date, department, round(med, 3) AS median, round(greatest(med - 1.2816::DOUBLE * greatest(s, 1), 0), 3) AS p10, round(med + 1.2816::DOUBLE * greatest(s, 1), 3) AS p90 FROM fc"""


@query(DEPARTMENT)
def department_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = A.department_daily_energy(order_sessions(spark, sf_dir).filter("date < '2001-01-01'"))
    holidays = spark.sql("select explode(array(date'2000-01-01', date'2000-12-25', date'2001-01-01')) as date")
    return rounded(R.department_forecast(daily, "2001-01-01", 14, holidays=holidays), "median", "p10", "p90", places=3)


POOL = """tgt AS (SELECT unnest([DATE '2024-01-22', DATE '2024-01-23', DATE '2024-01-24', DATE '2024-01-03']) AS target),
  pd AS (SELECT target, date AS pool_date, dense_rank() OVER (PARTITION BY target ORDER BY date DESC) AS n FROM tgt JOIN (SELECT DISTINCT date FROM ev) d ON isodow(date) = isodow(target) AND date < target)"""


def targets(spark: SparkSession) -> DataFrame:
    return spark.sql("select explode(array(date'2024-01-22', date'2024-01-23', date'2024-01-24', date'2024-01-03')) as target")


@query(with_(EV, POOL) + """SELECT tgt.target, count(DISTINCT date) AS n_dates, count(date) AS n_sessions FROM tgt LEFT JOIN (SELECT target, date FROM pd JOIN ev ON date = pool_date WHERE n <= 2) p ON p.target = tgt.target GROUP BY tgt.target""")
def last_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.last_n_occurrences(event_sessions(spark, sf_dir), targets(spark), 2)[1]


@query(with_(EV, POOL) + """, pool AS (SELECT target, ev.*, row_number() OVER (PARTITION BY target ORDER BY substr(md5(session_id::VARCHAR), 1, 2), session_id) - 1 AS nth, count(*) OVER (PARTITION BY target) AS size FROM pd JOIN ev ON date = pool_date WHERE n <= 2),
  dr AS (SELECT target, any_value(size) AS size FROM pool GROUP BY target), ex AS (SELECT target, size, CAST(s AS INT) AS scenario, d AS draw FROM dr, (SELECT unnest(range(3)) AS s), (SELECT unnest(generate_series(1, 50)) AS d)),
  pk AS (SELECT *, CAST(floor(('0x' || substr(md5('7|' || target || '|' || scenario || '|' || draw), 1, 8))::BIGINT / 4294967296.0::DOUBLE * size) AS BIGINT) AS nth FROM ex)
  SELECT pk.target, scenario, CAST(draw AS INT) AS draw, session_id, round(energy, 4) AS energy FROM pk JOIN pool USING (target, nth)""")
def bootstrap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool, info = R.last_n_occurrences(event_sessions(spark, sf_dir), targets(spark), 2)
    out = R.bootstrap_sessions(pool, info.select("target", F.lit(50).alias("n")), ["target"], 3, seed=7)
    return out.select("target", "scenario", "draw", "session_id", F.round("energy", 4).alias("energy"))


def _u(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_NOISE = f"sqrt(-2 * ln(greatest({_u(chr(39) + 'n1|5|' + chr(39) + ' || location_type || ' + chr(39) + '|' + chr(39) + ' || date || ' + chr(39) + '|' + chr(39) + ' || scenario')}, 1e-12::DOUBLE))) * cos(2 * pi() * {_u(chr(39) + 'n2|5|' + chr(39) + ' || location_type || ' + chr(39) + '|' + chr(39) + ' || date || ' + chr(39) + '|' + chr(39) + ' || scenario')})"


@query(with_(EV) + f""", dd AS (SELECT location_type, date, count(*) AS n FROM ev GROUP BY ALL), sp AS (SELECT location_type, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM dd GROUP BY location_type), cn AS (SELECT sp.*, coalesce(n, 0) AS n FROM sp LEFT JOIN dd USING (location_type, date)),
  lv AS (SELECT location_type, avg(n) AS m, coalesce(stddev_samp(n), 0) AS s FROM cn GROUP BY location_type), dy AS (SELECT DATE '2024-01-31' + CAST(k AS INT) AS date FROM (SELECT unnest(range(7)) AS k)), sc AS (SELECT CAST(unnest(range(5)) AS INT) AS scenario),
  pf AS (SELECT lv.location_type, dy.date, greatest(0, round_even(coalesce(arg_max(n, cn.date) FILTER (WHERE isodow(cn.date) = isodow(dy.date) AND cn.date <= dy.date - 7 AND cn.date >= dy.date - 371), any_value(m)), 0)) AS n, any_value(m) AS m, any_value(s) AS s FROM lv CROSS JOIN dy JOIN cn ON cn.location_type = lv.location_type GROUP BY ALL),
  al AS (SELECT *, {_NOISE} AS z FROM pf, sc)
  SELECT location_type, date, scenario, greatest(0, round_even(m + s * z, 0)) AS normal, greatest(0, round_even(n + greatest(0.03::DOUBLE * s, 0.1::DOUBLE) * z, 0)) AS persistence FROM al""")
def forecast_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reproducible scenarios of the two forecasts of counts by place."""
    c, by = A.daily_counts(event_sessions(spark, sf_dir), ("location_type",)), ("location_type",)
    a = R.normal_scenarios(c, "2024-01-31", 7, 5, by, seed=5).withColumnRenamed("n_sessions", "normal")
    b = R.persistence_scenarios(c, 1, "2024-01-31", 7, 5, by, seed=5).withColumnRenamed("n_sessions", "persistence")
    return a.join(b, [*by, "date", "scenario"])


GROWTH = {
    "linear": "b * (1 + 0.15::DOUBLE * t)",
    "s_curve": "b + b * 2.0::DOUBLE * (1 / (1 + exp(-2.0::DOUBLE * (t - 1.5::DOUBLE))) - 1 / (1 + exp(3.0::DOUBLE))) / (1 - 1 / (1 + exp(3.0::DOUBLE)))",
    "bass": "b + b * 3.0::DOUBLE * (1 - exp(-0.41::DOUBLE * t)) / (1 + 0.38::DOUBLE / 0.03::DOUBLE * exp(-0.41::DOUBLE * t))",
}
WEIGHTS = {"winter": 1.1, "summer": 0.9}


def _growth(model: str) -> str:
    return with_(ORD) + f""", r AS (SELECT department, date, count(*) AS n, sum(energy) AS e FROM ord GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY department ORDER BY date DESC) AS i FROM r),
  bs AS (SELECT department, avg(n) AS b, sum(e) / sum(n) AS kwh FROM k WHERE i <= 30 GROUP BY department), dy AS (SELECT unnest(generate_series(DATE '2002-01-01', DATE '2002-01-01' + 1095, INTERVAL 1 DAY))::DATE AS date),
  g AS (SELECT department, date, kwh, ({GROWTH[model]}) * CASE WHEN month(date) IN (12, 1, 2) THEN 1.1::DOUBLE WHEN month(date) IN (6, 7, 8) THEN 0.9::DOUBLE ELSE 1 END AS x FROM (SELECT *, (date - DATE '2002-01-01') / 365.25::DOUBLE AS t FROM bs CROSS JOIN dy))
  SELECT department, date, round(x, 4) AS expected, round(x * kwh, 3) AS expected_kwh FROM g"""


def projection(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    daily = order_sessions(spark, sf_dir).groupBy("department", "date").agg(F.count("*").alias("n"), F.sum("energy").alias("e"))
    base = A.tail_days(daily, 30, ("department",)).groupBy("department").agg(F.avg("n").alias("base"), (F.sum("e") / F.sum("n")).alias("kwh"))
    return R.growth_projection(base, "2002-01-01", 3.0, model, weights=WEIGHTS, energy="kwh")


def _projected(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    out = projection(spark, sf_dir, model).select("department", "date", "expected", "expected_kwh")
    return rounded(rounded(out, "expected"), "expected_kwh", places=3)


@query(_growth("linear"))
def growth_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projected(spark, sf_dir, "linear")


@query(_growth("s_curve"))
def growth_s_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projected(spark, sf_dir, "s_curve")


@query(_growth("bass"))
def growth_bass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projected(spark, sf_dir, "bass")


@query(_growth("bass").replace("SELECT department, date, round(x, 4) AS expected, round(x * kwh, 3) AS expected_kwh FROM g", "SELECT department, round(arg_min(x, date), 4) AS first_value, round(arg_max(x, date), 4) AS last_value, round(arg_max(x, date) / arg_min(x, date), 6) AS factor FROM g GROUP BY department"))
def capacity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(R.capacity_table(projection(spark, sf_dir, "bass"), ("department",)), "first_value", "last_value"), "factor", places=6)


def _autoregression(horizon: int = 14) -> str:
    n = 11
    x = [f"CAST(isodow(date) = {d + 1} AS DOUBLE)" for d in range(7)] + ["t", "hol", "l1", "l7"]
    gram = ", ".join("[" + ", ".join([*(f"coalesce(sum(({x[i]}) * ({x[j]})) FILTER (WHERE l7 IS NOT NULL), 0)" + (" + 1e-3::DOUBLE" if i == j else "") for j in range(n)), f"coalesce(sum(({x[i]}) * y) FILTER (WHERE l7 IS NOT NULL), 0)"]) + "]" for i in range(n))
    k, at = "CAST(e[1][1] AS BIGINT)", lambda a: f"b[10] * {a}[-1] + b[11] * {a}[-7]"
    solved = f"""list_reduce(list_transform(range(1, {n + 1}), lambda k: [[k::DOUBLE]]), lambda m, e: list_transform(m, lambda row, i: CASE WHEN i = {k} THEN list_transform(row, lambda v: v / m[{k}][{k}])
      ELSE list_transform(row, lambda v, j: v - row[{k}] * m[{k}][j] / m[{k}][{k}]) END), lines)"""
    return with_(ORD) + f""", hd AS (SELECT unnest([DATE '2000-01-01', DATE '2000-12-25', DATE '2001-01-01']) AS date), dd AS (SELECT date, department, sum(energy) AS v FROM ord WHERE date < DATE '2001-01-01' GROUP BY ALL),
  rw AS (SELECT dd.*, ln(1 + v) AS y, (dd.date - DATE '2001-01-01') / 365.0::DOUBLE AS t, CASE WHEN hd.date IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS hol, lag(ln(1 + v), 1) OVER w AS l1, lag(ln(1 + v), 7) OVER w AS l7, row_number() OVER (PARTITION BY department ORDER BY dd.date DESC) AS ago
    FROM dd LEFT JOIN hd ON hd.date = dd.date WINDOW w AS (PARTITION BY department ORDER BY dd.date)),
  ft AS (SELECT department, count(*) AS n, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS sd, 2 * max(y) AS top, count(*) FILTER (WHERE l7 IS NOT NULL) AS k, coalesce(sum(y * y) FILTER (WHERE l7 IS NOT NULL), 0) AS yy, list(y ORDER BY date) FILTER (WHERE ago <= 7) AS last, [{gram}] AS lines FROM rw GROUP BY department),
  sv AS (SELECT *, list_transform({solved}, lambda row: row[{n + 1}]) AS b FROM ft),
  mo AS (SELECT *, greatest(yy - list_sum(list_transform(range(1, {n + 1}), lambda i: b[i] * lines[i][{n + 1}])), 0) / greatest(k - {n}, 1) AS var,
    list_transform(range(0, {horizon}), lambda h: b[isodow(DATE '2001-01-01' + CAST(h AS INT))] + b[8] * (h / 365.0::DOUBLE) + b[9] * CASE WHEN h = 0 THEN 1 ELSE 0 END) AS given FROM sv WHERE n < 60 OR len(last) = 7),
  pa AS (SELECT *, CASE WHEN n >= 60 THEN list_reduce(list_transform(given, lambda f: [f]), lambda acc, f: list_append(acc, least(greatest(f[1] + {at("acc")}, 0), top)), last)[8:{7 + horizon}] END AS path,
    CASE WHEN n >= 60 THEN list_reduce(list_transform(range(2, {horizon + 2}), lambda h: [h::DOUBLE]), lambda acc, h: list_append(acc, {at("acc")}), [0::DOUBLE, 0, 0, 0, 0, 0, 1])[7:{6 + horizon}] END AS carried FROM mo),
  ex AS (SELECT *, unnest(range(0, {horizon})) AS h FROM pa),
  fc AS (SELECT DATE '2001-01-01' + CAST(h AS INT) AS date, department, mean, 1.2816::DOUBLE * greatest(sd, 1) AS flat, path[h + 1] AS a, 1.2816::DOUBLE * sqrt(var * list_sum(list_transform(carried[1:h + 1], lambda c: c * c))) AS w FROM ex)
  SELECT date, department, round(greatest(coalesce(exp(a) - 1, mean), 0), 3) AS median, round(greatest(coalesce(exp(a - w) - 1, mean - flat), 0), 3) AS p10, round(greatest(coalesce(exp(a + w) - 1, mean + flat), 0), 3) AS p90 FROM fc"""


@query(_autoregression())
def department_autoregression(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = A.department_daily_energy(order_sessions(spark, sf_dir).filter("date < '2001-01-01'"))
    holidays = spark.sql("select explode(array(date'2000-01-01', date'2000-12-25', date'2001-01-01')) as date")
    return rounded(R.autoregressive_forecast(daily, "2001-01-01", 14, holidays=holidays), "median", "p10", "p90", places=3)
