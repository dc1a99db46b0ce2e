"""Scores, backtests and comparisons of series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import compare as X
from ..operators import loadcurve as L
from ..operators import metrics as M
from ..operators import smart as C
from ..operators.forecast import with_holidays
from ..operators.gaussian import PAIRS
from ..plans import backtest as B
from ..sources.readers import written
from .adapters import EV, ORD, SLOTS, TARIFF, event_sessions, order_sessions, price_signal, with_
from .aggregates import NAT, OVERLAP, national, rounded
from .charging import _scheduled
from .forecasts import COUNTS, TARGETS, counts
from .models import _gaussian_draws
from .registry import query

PAIRS_SQL = """, b AS (SELECT date, quantile_cont(v, 0.5) AS p, max(v) AS y FROM nat GROUP BY date)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenarios' median against their maximum, by day."""
    return national(spark, sf_dir).groupBy("date").agg(F.percentile("v", F.lit(0.5)).alias("p"), F.max("v").alias("y"))


@query(with_(NAT) + PAIRS_SQL + """ SELECT year(date) AS year, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(avg(abs(p - y)), 4) AS mae, round(avg(p - y), 4) AS bias, round(100 * avg(abs((p - y) / (y + 1e-6::DOUBLE))), 4) AS mape,
  round(100 * avg(abs(p - y) / ((abs(y) + abs(p)) / 2 + 1e-6::DOUBLE)), 4) AS smape FROM b GROUP BY 1""")
def forecast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.forecast_metrics(pairs(spark, sf_dir).withColumn("year", F.year("date").cast("long")), "y", "p", ("year",))
    return rounded(out, "rmse", "mae", "bias", "mape", "smape")


@query(with_(NAT) + """, b AS (SELECT date, quantile_cont(v, 0.5) AS med, sum(v) AS y FROM nat GROUP BY date)
  SELECT count(*) AS n_days, round(avg(abs(med - y / 5)), 4) AS mae, round(avg(CASE WHEN y > 0 THEN 100 * abs(med - y / 5) / (y / 5) END), 4) AS mape FROM b""")
def median_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = national(spark, sf_dir)
    truth = n.groupBy("date").agg((F.sum("v") / 5).alias("y"))
    return rounded(M.median_evaluation(n, "v", truth, "y", ["date"]), "mae", "mape")


DIST = """fe AS (SELECT location_type, feature, x, CAST(weekend AS INT) AS side FROM (SELECT location_type, 'hour' AS feature, hour AS x, is_weekend AS weekend FROM {src} UNION ALL SELECT location_type, 'duration', duration, is_weekend FROM {src} UNION ALL SELECT location_type, 'energy', energy, is_weekend FROM {src})),
  va AS (SELECT location_type, feature, x, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM fe GROUP BY ALL), sz AS (SELECT location_type, feature, sum(a) AS n, sum(b) AS m FROM va GROUP BY ALL),
  st AS (SELECT va.*, n, m, abs(sum(a) OVER w / n - sum(b) OVER w / m) AS gap, lead(x) OVER w AS nx FROM va JOIN sz USING (location_type, feature) WINDOW w AS (PARTITION BY location_type, feature ORDER BY x)),
  kw AS (SELECT location_type, feature, any_value(n) AS n, any_value(m) AS m, max(gap) AS ks, sum(gap * (nx - x)) AS wasserstein FROM st GROUP BY ALL),
  en AS (SELECT location_type, feature, min(x) AS lo, max(x) AS hi, count(*) FILTER (WHERE side = 0) AS n, count(*) FILTER (WHERE side = 1) AS m FROM fe GROUP BY ALL),
  ct AS (SELECT location_type, feature, CAST(least(floor((x - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM fe JOIN en USING (location_type, feature) GROUP BY ALL),
  gr AS (SELECT e.*, coalesce(a, 0) / n / ((hi - lo) / 50) + 1e-9::DOUBLE AS p, coalesce(b, 0) / m / ((hi - lo) / 50) + 1e-9::DOUBLE AS q FROM (SELECT *, unnest(range(50)) AS bin FROM en) e LEFT JOIN ct USING (location_type, feature, bin)),
  sp AS (SELECT *, p / sum(p) OVER w AS u, q / sum(q) OVER w AS v FROM gr WINDOW w AS (PARTITION BY location_type, feature)), kl AS (SELECT location_type, feature, sum(u * ln(u / v) - u + v) AS kl FROM sp GROUP BY ALL),
  pv AS (SELECT * REPLACE (CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m), CAST(round(ks * n * m) AS BIGINT) AS lim, ks * sqrt(n * m / (n + m)) AS t FROM kw)"""
#: The exact p-value of small samples: paths on the lattice that stay inside, row by row.
EXACT = """CASE WHEN lim <= 0 THEN 1.0::DOUBLE ELSE least(greatest(1 - list_extract(list_reduce(list_transform(range(1, n + 1), lambda i: [i::DOUBLE]),
   lambda before, x: list_reduce(list_transform(range(1, m + 1), lambda j: [j::DOUBLE]),
       lambda done, y: list_append(done, CASE WHEN abs(x[1] * m - y[1] * n) < lim THEN (before[CAST(y[1] AS BIGINT) + 1] * x[1] + done[-1] * y[1]) / (x[1] + y[1]) ELSE 0.0::DOUBLE END),
       [CASE WHEN x[1] * m < lim THEN before[1] ELSE 0.0::DOUBLE END]),
   list_transform(range(0, m + 1), lambda j: CASE WHEN j * n < lim THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)), -1), 0), 1) END"""
KSP = f"CASE WHEN n * m <= {M.EXACT_UP_TO} THEN {EXACT} ELSE CASE WHEN t < 0.04::DOUBLE THEN 1.0::DOUBLE ELSE least(greatest(list_aggregate(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END) * exp(-2.0::DOUBLE * k * k * t * t)), 'sum'), 0), 1) END END"


@query(with_(EV, DIST.format(src="ev")) + f" SELECT location_type, feature, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, round(ks, 6) AS ks, round({KSP}, 6) AS ks_p, round(wasserstein, 5) AS wasserstein, round(kl, 5) AS kl FROM pv JOIN kl USING (location_type, feature)")
def distribution_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekend days (as simulated) against working days, by place."""
    s = event_sessions(spark, sf_dir)
    out = M.distribution_comparison(s.filter("is_weekend = 0"), s.filter("is_weekend = 1"), by=("location_type",))
    return rounded(rounded(out, "ks", "ks_p", places=6), "wasserstein", "kl", places=5)


SMALL = ", sm AS (SELECT department || '/' || location_type AS location_type, hour, duration, energy, is_weekend FROM ev), "


@query(with_(EV) + SMALL + DIST.format(src="sm") + f" SELECT location_type AS cell, feature, n, m, round(ks, 9) AS ks, round({KSP}, 9) AS ks_p, round(wasserstein, 8) AS wasserstein, round(kl, 5) AS kl FROM pv JOIN kl USING (location_type, feature)")
def small_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekend against working days by area and place: groups so small that their p-values are exact."""
    s = event_sessions(spark, sf_dir).withColumn("cell", F.concat_ws("/", "department", "location_type"))
    out = M.distribution_comparison(s.filter("is_weekend = 0"), s.filter("is_weekend = 1"), by=("cell",), split=False)
    return rounded(rounded(rounded(out, "ks", "ks_p", places=9), "wasserstein", places=8), "kl", places=5)


@query(with_(NAT) + """, m AS (SELECT date, avg(v) AS y FROM nat GROUP BY date), r AS (SELECT date, v, y, row_number() OVER (PARTITION BY date ORDER BY v) AS i, count(*) OVER (PARTITION BY date) AS m FROM nat JOIN m USING (date))
  SELECT date, round(avg(abs(v - y)) - sum((2 * i - m - 1) * v) / (any_value(m) * any_value(m)), 7) AS crps, count(*) AS members FROM r GROUP BY date""")
def crps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = national(spark, sf_dir)
    return rounded(M.crps(n.join(n.groupBy("date").agg(F.avg("v").alias("y")), "date"), "v", "y", ["date"]), "crps", places=7)


P2 = OVERLAP.format(keys="location_type", src="wk", active="duration", power="energy / duration") + ", r24 AS (SELECT location_type, h, coalesce(kwh, 0) / n_days / 1000 AS y FROM g LEFT JOIN e USING (location_type, h))"


@query(with_(EV) + ", wk AS (SELECT * FROM ev WHERE is_weekend = 0)" + P2 + ", we AS (SELECT * FROM ev WHERE is_weekend = 1)" + P2.replace("wk", "we").replace(" x AS", " x2 AS").replace("FROM x ", "FROM x2 ").replace(" y AS (", " y2 AS (").replace("FROM y ", "FROM y2 ").replace(" e AS (", " e2 AS (").replace("JOIN e USING", "JOIN e2 USING").replace(" d AS (", " d2 AS (").replace("FROM d)", "FROM d2)").replace(" g AS (", " g2 AS (").replace("FROM g LEFT", "FROM g2 LEFT").replace("r24 AS", "s24 AS").replace("/ 1000 AS y ", "/ 1000 AS p ") + """
  SELECT location_type, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(sqrt(avg((p - y) * (p - y))) / nullif(avg(y), 0), 6) AS nrmse FROM r24 JOIN s24 USING (location_type, h) GROUP BY location_type""")
def profile_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_sessions(spark, sf_dir)
    a, b = (L.load_profiles(s.filter(f"is_weekend = {k}"), ["location_type"]) for k in (0, 1))
    return rounded(M.profile_error(a, b, ["location_type"]), "rmse", "nrmse", places=6)


@query(with_(EV) + ", t AS (SELECT location_type, sum(energy) FILTER (WHERE session_id % 2 = 0) AS y, sum(energy) FILTER (WHERE session_id % 2 = 1) AS p FROM ev GROUP BY 1) SELECT location_type, round(p - y, 4) AS bias_kwh, round(100 * (p - y) / y, 4) AS bias_pct FROM t")
def energy_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_sessions(spark, sf_dir)
    return rounded(M.energy_bias(s.filter("session_id % 2 = 0"), s.filter("session_id % 2 = 1"), ["location_type"]), "bias_kwh", "bias_pct")


#: The grid of the usual backtest; of its pool sizes those count that the data have days for.
X_GRID, HORIZONS, WINDOW, SCENARIOS = [1, 2, 3, 4, 8, 16, 52], [1, 2, 3], 30, 10
GRID = f"""gd AS (SELECT 'events' AS dataset, o::DATE AS origin, h, x, (o::DATE + h) AS target FROM (SELECT unnest(generate_series((SELECT max(date) - {WINDOW} FROM ev), (SELECT max(date) - {max(HORIZONS)} FROM ev), INTERVAL 1 DAY)) AS o), (SELECT unnest({HORIZONS}) AS h), (SELECT unnest({X_GRID}) AS x)),
  pl AS (SELECT * FROM (SELECT gd.*, pool_date, row_number() OVER (PARTITION BY origin, h, x ORDER BY pool_date DESC) AS n FROM gd JOIN (SELECT DISTINCT date AS pool_date FROM ev) d ON isodow(pool_date) = isodow(target) AND pool_date <= origin AND pool_date < target) WHERE n <= x),
  nd AS (SELECT date, count(*) AS n FROM ev GROUP BY date),
  zz AS (SELECT origin, h, x, count(*) AS n_dates, sum(nd.n) AS n_pool FROM pl JOIN nd ON date = pool_date GROUP BY ALL),
  ss AS (SELECT gd.*, coalesce(n_dates, 0) AS n_dates, CAST(coalesce(n_pool, 0) AS BIGINT) AS n_pool, coalesce(nd.n, 0) AS n_target FROM gd LEFT JOIN zz USING (origin, h, x) LEFT JOIN nd ON nd.date = target),
  sx AS (SELECT *, CASE WHEN n_dates < x THEN 'insufficient_history' WHEN n_pool < 10 THEN 'insufficient_volume' WHEN n_target = 0 THEN 'no_target_sessions' ELSE 'ok' END AS status FROM ss)"""


def grid_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = event_sessions(spark, sf_dir).withColumn("dataset", F.lit("events"))
    grid = B.backtest_grid(s, X_GRID, HORIZONS, WINDOW)
    pools = B.backtest_pools(s, grid)
    return s, pools, B.backtest_status(s, grid, pools)


@query(with_(EV, GRID) + "SELECT dataset, origin, h, x, target, n_dates, n_pool, n_target, status FROM sx")
def backtest_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_of(spark, sf_dir)[2].select("dataset", "origin", "h", "x", "target", "n_dates", "n_pool", "n_target", "status")


@query(with_(EV, GRID) + "SELECT x, count(*) AS n_cells, count(*) FILTER (WHERE status = 'ok') AS n_ok, round(100.0::DOUBLE * count(*) FILTER (WHERE status = 'ok') / count(*), 4) AS pct_ok FROM sx GROUP BY x")
def cell_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.cell_coverage(grid_of(spark, sf_dir)[2], ["dataset", "origin", "h", "x"], "x"), "pct_ok")


BOOT = f""", dw AS (SELECT origin, h, x, target, n_target, s AS scenario, d AS draw FROM (SELECT *, unnest(range({SCENARIOS})) AS s FROM (SELECT *, unnest(generate_series(1, n_target)) AS d FROM sx WHERE status = 'ok'))),
  pp AS (SELECT origin, h, x, ev.*, row_number() OVER (PARTITION BY origin, h, x ORDER BY date, substr(md5(session_id::VARCHAR), 1, 2), session_id) - 1 AS nth, count(*) OVER (PARTITION BY origin, h, x) AS size FROM pl JOIN sx USING (origin, h, x) JOIN ev ON date = pl.pool_date WHERE status = 'ok'),
  pz AS (SELECT origin, h, x, any_value(size) AS size FROM pp GROUP BY ALL),
  pk AS (SELECT origin, h, x, scenario, CAST(floor(('0x' || substr(md5('0|events|' || origin || '|' || h || '|' || x || '|' || scenario || '|' || draw), 1, 8))::BIGINT / 4294967296.0::DOUBLE * size) AS BIGINT) AS nth, draw FROM dw JOIN pz USING (origin, h, x)),
  bs AS (SELECT pk.origin, pk.h, pk.x, pk.scenario, pk.draw, pp.arrival_time, pp.hour, pp.duration, pp.energy, pp.power_kw FROM pk JOIN pp USING (origin, h, x, nth))"""
CRPS = """, tt AS (SELECT origin, h, x, scenario, sum(energy) AS total FROM bs GROUP BY ALL),
  tr AS (SELECT origin, h, x, sum(energy) AS truth FROM sx JOIN ev ON date = target WHERE status = 'ok' GROUP BY ALL),
  rr AS (SELECT *, row_number() OVER (PARTITION BY origin, h, x ORDER BY total) AS i, count(*) OVER (PARTITION BY origin, h, x) AS m FROM tt JOIN tr USING (origin, h, x))
  SELECT 'events' AS dataset, origin, h, x, round(avg(abs(total - truth)) - sum((2 * i - m - 1) * total) / (any_value(m) * any_value(m)), 6) AS crps, count(*) AS members FROM rr GROUP BY ALL"""


def scored_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, pools and the cells that can be scored, numbered (``cell_``); the latter two written, a row for each cell and date."""
    s, pools, status = grid_of(spark, sf_dir)
    return s, written(pools), written(status.filter("status = 'ok'").withColumn("cell_", F.monotonically_increasing_id()))


def drawn(s: DataFrame, pools: DataFrame, ok: DataFrame, n_scenarios: int) -> DataFrame:
    """Draws with the number of their cell only: few bytes a draw."""
    return B.pool_draws(s, pools, ok.select(*B.CELL, "cell_", F.col("n_target").alias("n")), n_scenarios).drop(*B.CELL)


@query(with_(EV, GRID) + BOOT + CRPS)
def persistence_energy_crps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, pools, ok = scored_cells(spark, sf_dir)
    daily = s.groupBy("dataset", F.col("date").alias("target")).agg(F.sum("energy").alias("truth"))
    truth = ok.join(daily, ["dataset", "target"]).select(*B.CELL, "cell_", "truth")
    scores = B.energy_crps(truth.select("cell_", "truth"), drawn(s.select("session_id", "dataset", "date", "energy"), pools, ok, SCENARIOS), ["cell_"])
    return rounded(scores.join(truth.select(*B.CELL, "cell_"), "cell_").drop("cell_"), "crps", places=6)


ARMS = """, rs AS (SELECT department, CAST(date_trunc('month', date) AS DATE) AS cell, location_type AS method, avg(energy) AS score FROM ord GROUP BY ALL)"""


def arm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of three arms (here places) for each cell (department and month)."""
    return order_sessions(spark, sf_dir).groupBy("department", F.trunc("date", "MM").alias("cell"), F.col("location_type").alias("method")).agg(F.avg("energy").alias("score"))


@query(with_(ORD) + ARMS + """, wd AS (SELECT department, cell, round(avg(score) FILTER (WHERE method = 'home'), 9) AS home, round(avg(score) FILTER (WHERE method = 'work'), 9) AS work, round(avg(score) FILTER (WHERE method = 'public'), 9) AS public FROM rs GROUP BY ALL),
  wn AS (SELECT *, CASE WHEN home = least(home, work, public) THEN 'home' WHEN work = least(home, work, public) THEN 'work' ELSE 'public' END AS winner FROM wd WHERE home IS NOT NULL AND work IS NOT NULL AND public IS NOT NULL)
  SELECT department, count(*) AS n_cells, a AS method, round(avg(CASE WHEN winner = a THEN 1.0::DOUBLE ELSE 0 END), 6) AS win_rate FROM wn, (SELECT unnest(['home', 'work', 'public']) AS a) GROUP BY department, a""")
def win_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.win_rates(arm_scores(spark, sf_dir), "score", ["department", "cell"], ["home", "work", "public"], ("department",)), "win_rate", places=6)


@query(with_(ORD) + ARMS + ", bb AS (SELECT department, cell, score AS b FROM rs WHERE method = 'home') SELECT method, count(*) AS n_cells, round(avg(CASE WHEN score < b THEN 1.0::DOUBLE ELSE 0 END), 6) AS win_rate FROM rs JOIN bb USING (department, cell) WHERE method <> 'home' GROUP BY method")
def pairwise_win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.pairwise_win_rate(arm_scores(spark, sf_dir), "score", ["department", "cell"], "home"), "win_rate", places=6)


@query(with_(ORD) + ARMS + ", mm AS (SELECT department, method, avg(score) AS mean FROM rs GROUP BY ALL) SELECT department, method, round(mean, 5) AS mean, round(mean / (SELECT b.mean FROM mm b WHERE b.department = mm.department AND b.method = 'home'), 6) AS ratio FROM mm")
def mean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(M.mean_by(arm_scores(spark, sf_dir), "score", ["department"], "home"), "mean", places=5), "ratio", places=6)


@query(with_(EV) + """, oo AS (SELECT unnest([DATE '2024-01-16', DATE '2024-01-20']) AS origin), cc AS (SELECT origin, date, count(*) AS n FROM oo JOIN ev ON date <= origin GROUP BY ALL), ff AS (SELECT origin, k AS "offset", origin + CAST(k AS INT) AS date FROM oo, (SELECT unnest(generate_series(1, 5)) AS k)),
  pf AS (SELECT ff.origin, ff."offset", ff.date, greatest(0, round_even(coalesce(arg_max(n, cc.date) FILTER (WHERE isodow(cc.date) = isodow(ff.date) AND cc.date <= ff.date - 7), avg(n)), 0))::DOUBLE AS p FROM ff JOIN cc ON cc.origin = ff.origin GROUP BY ALL),
  pt AS (SELECT pf.*, (SELECT count(*) FROM ev WHERE ev.date = pf.date)::DOUBLE AS y FROM pf)
  SELECT CAST("offset" AS INT) AS "offset", round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(avg(abs(p - y)), 4) AS mae, round(avg(p - y), 4) AS bias, round(100 * avg(abs((p - y) / (y + 1e-6::DOUBLE))), 4) AS mape, round(100 * avg(abs(p - y) / ((abs(y) + abs(p)) / 2 + 1e-6::DOUBLE)), 4) AS smape FROM pt GROUP BY 1""")
def count_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.count_scores(B.count_sanity(event_sessions(spark, sf_dir), ["2024-01-16", "2024-01-20"], 5))
    return rounded(out, "rmse", "mae", "bias", "mape", "smape")


HOURLY = """hr AS (SELECT date_trunc('hour', arrival_time) AS ts, department, sum(energy) AS value FROM ev GROUP BY ALL)"""


def hourly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_sessions(spark, sf_dir).groupBy(F.date_trunc("hour", "arrival_time").cast("timestamp_ntz").alias("ts"), "department").agg(F.sum("energy").alias("value"))


@query(with_(EV, HOURLY) + """, a AS (SELECT ts, value AS a FROM hr WHERE department = '01'), b AS (SELECT ts, value AS b FROM hr WHERE department = '02'), r AS (SELECT (SELECT quantile_cont(a, 0.5) FROM a) / (SELECT quantile_cont(b, 0.5) FROM b) AS f)
  SELECT ts, round(a, 4) AS a, round(b, 4) AS b, round(b * f, 4) AS rescaled FROM a JOIN b USING (ts), r""")
def aligned_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly_series(spark, sf_dir)
    a, b = h.filter("department = '01'"), h.filter("department = '02'")
    b = X.rescaled_to_median(b, "value", a, "value")
    out = X.aligned(a, b).join(b.select("ts", "rescaled"), "ts")
    return rounded(out, "a", "b", "rescaled")


@query(with_(EV, HOURLY) + """, sm AS (SELECT department, avg(value) AS mean, quantile_cont(value, 0.5) AS median, max(value) AS mx FROM hr GROUP BY department), pk AS (SELECT department, hour(ts) AS h FROM (SELECT *, max(value) OVER (PARTITION BY department, CAST(ts AS DATE)) AS top FROM hr) WHERE value = top),
  ph AS (SELECT department, h, row_number() OVER (PARTITION BY department ORDER BY count(*) DESC, h) AS r FROM pk GROUP BY department, h)
  SELECT department, round(mean, 4) AS mean, round(median, 4) AS median, round(mx, 4) AS "max", round(mean * 8760 / 1e9::DOUBLE, 9) AS annual_twh, CAST(h AS INT) AS peak_hour, round(100 * (mean / (SELECT mean FROM sm WHERE department = '00') - 1), 4) AS bias_pct FROM sm JOIN ph USING (department) WHERE r = 1""")
def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.series_summary(hourly_series(spark, sf_dir), "department", reference="00")
    return rounded(rounded(out, "mean", "median", "max", "bias_pct"), "annual_twh", places=9)


@query(with_(EV, HOURLY) + """, tot AS (SELECT ts, sum(value) AS value FROM hr GROUP BY ts), w AS (SELECT ts, value, count(*) OVER o AS n, avg(value) OVER o AS m FROM tot WINDOW o AS (ORDER BY ts ROWS BETWEEN 84 PRECEDING AND 83 FOLLOWING))
  SELECT 'all' AS series, ts, round(CASE WHEN n = 168 THEN m END, 8) AS rolling FROM w""")
def weekly_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = hourly_series(spark, sf_dir).groupBy(F.lit("all").alias("series"), "ts").agg(F.sum("value").alias("value"))
    return rounded(A.centred_mean(total, "value", 168, ("series",)).select("series", "ts", "rolling"), "rolling", places=8)


@query(with_(EV) + ", d AS (SELECT date, day_of_week, hour(arrival_time) AS h, sum(energy) AS s FROM ev GROUP BY ALL) SELECT day_of_week, CAST(h AS INT) AS h, round(avg(s), 4) AS mean FROM d GROUP BY day_of_week, h")
def weekday_hour_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_sessions(spark, sf_dir).withColumn("h", F.hour("arrival_time"))
    return rounded(X.mean_of_means(s, "energy", ["date", "day_of_week", "h"], ["day_of_week", "h"]), "mean")


@query(with_(EV, HOURLY) + """, q AS (SELECT department, ts, value, max(value) OVER (PARTITION BY CAST(ts AS DATE)) AS top FROM hr) SELECT department, ts, CAST(ts AS DATE) AS date, round(value, 4) AS value FROM q WHERE value = top""")
def daily_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.daily_maximum_rows(hourly_series(spark, sf_dir), "value").select("department", "ts", "date", "value"), "value")


@query(with_(EV) + """, en AS (SELECT min(energy) AS lo, max(energy) AS hi, count(*) AS n, stddev_samp(energy) AS sd FROM ev), bn AS (SELECT least(floor((energy - lo) / ((hi - lo) / 2000)), 1999) AS bin, avg(energy) AS x, count(*) AS w FROM ev, en GROUP BY 1),
  gr AS (SELECT CAST(i AS INT) AS i, lo + i * (hi - lo) / 299 AS pt, n, sd * pow(n, -0.2::DOUBLE) AS bw FROM en, (SELECT unnest(range(300)) AS i))
  SELECT i, round(any_value(pt), 5) AS "at", round(sum(w * exp(-0.5::DOUBLE * ((pt - x) / bw) * ((pt - x) / bw))) / any_value(n * bw) / sqrt(2 * pi()), 7) AS density FROM gr, bn GROUP BY i""")
def energy_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(X.density(event_sessions(spark, sf_dir), "energy"), "at", places=5), "density", places=7)


@query(with_(EV, SLOTS) + f", ss AS (SELECT location_type, count(*) AS n, sum(energy) AS e FROM ev GROUP BY 1), rr AS (SELECT location_type, count(DISTINCT department) AS d FROM ev WHERE energy > 200 GROUP BY 1) SELECT location_type, n, round(e, 4) AS e, d, (SELECT round(avg({TARIFF}), 6) FROM slots) AS mean_price FROM ss LEFT JOIN rr USING (location_type)")
def summary_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_sessions(spark, sf_dir)
    a = s.groupBy("location_type").agg(F.count("*").alias("n"), F.round(F.sum("energy"), 4).alias("e"))
    b = s.filter("energy > 200").groupBy("location_type").agg(F.count_distinct("department").alias("d"))
    price = price_signal(s).agg(F.round(F.avg("value"), 6).alias("mean_price"))
    return a.join(b, "location_type", "left").join(F.broadcast(price))


@query(with_(ORD, COUNTS, TARGETS) + """, hd AS (SELECT unnest([DATE '2000-12-25', DATE '2000-05-01']) AS date), cd AS (SELECT cn.*, CASE WHEN hd.date IS NULL THEN 0 ELSE 1 END AS holiday FROM cn LEFT JOIN hd ON hd.date = cn.date)
  SELECT holiday, count(*) AS n_days, round(avg(n), 6) AS mean_sessions FROM cd GROUP BY holiday""")
def holiday_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.sql("select explode(array(date'2000-12-25', date'2000-05-01')) as date")
    flagged = with_holidays(counts(spark, sf_dir), days)
    return flagged.groupBy("holiday").agg(F.count("*").alias("n_days"), F.round(F.avg("n_sessions"), 6).alias("mean_sessions"))


#: Moments of the pools, plain and weighted by recency, and draws from both.
_X = ["hour", "ln(1 + duration)", "ln(1 + energy)"]
_DAYS = ", ".join([f"sum({x}) AS s{i}" for i, x in enumerate(_X)] + [f"sum(({_X[i]}) * ({_X[j]})) AS s{i}{j}" for i, j in PAIRS])
_MOMENTS = ", ".join([f"sum(w * s{i}) / sum(w * n) AS m{i}" for i in range(3)] + [
    f"greatest(sum(w * s{i}{j}) / sum(w * n) - (sum(w * s{i}) / sum(w * n)) * (sum(w * s{j}) / sum(w * n)), 0) + 1e-5::DOUBLE AS c{i}{j}" if i == j
    else f"sum(w * s{i}{j}) / sum(w * n) - (sum(w * s{i}) / sum(w * n)) * (sum(w * s{j}) / sum(w * n)) AS c{i}{j}" for i, j in PAIRS])
MODELS = f""", dm AS (SELECT date, count(*) AS n, {_DAYS} FROM ev GROUP BY date),
  pd AS (SELECT origin, h, x, pool_date, dm.*, max(pool_date) OVER c AS hi, greatest(1.0::DOUBLE, (max(pool_date) OVER c - min(pool_date) OVER c) / 3.5::DOUBLE) AS half FROM pl JOIN sx USING (origin, h, x) JOIN dm ON dm.date = pool_date WHERE status = 'ok' WINDOW c AS (PARTITION BY origin, h, x)),
  pw AS (SELECT 'gmm' AS method, 1.0::DOUBLE AS w, pd.* FROM pd UNION ALL SELECT 'gmm_recency', pow(0.5::DOUBLE, (hi - pool_date) / half), pd.* FROM pd),
  pm AS (SELECT method, origin, h, x, {_MOMENTS} FROM pw GROUP BY method, origin, h, x HAVING sum(n) >= 10),
  gd2 AS (SELECT pm.*, scenario, draw FROM dw JOIN pm USING (origin, h, x)), """ + _gaussian_draws("gd2", "method, origin, h, x, scenario", "'0|events|' || origin || '|' || h || '|' || x || '|' || scenario || '|' || draw")


def _scored(arms: list[str], sims: str) -> str:
    """Scores of the arms' simulations against the target days, and the cells that can't be scored."""
    cell = "origin || '|' || h || '|' || x || '|' || scenario || '|' || method"
    return f""", bt AS (SELECT {cell} AS location_type, hour, duration, energy, 1 AS is_weekend FROM ({sims})
    UNION ALL SELECT {cell}, ev.hour, ev.duration, ev.energy, 0 FROM sx JOIN ev ON ev.date = target, (SELECT unnest(range({SCENARIOS})) AS scenario), (SELECT unnest({arms}) AS method) WHERE status = 'ok'), {DIST.format(src="bt")},
  ws AS (SELECT location_type AS cell, feature, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, round(ks, 6) AS ks, round({KSP}, 6) AS ks_p, round(wasserstein, 8) AS wasserstein, round(kl, 5) AS kl, 'ok' AS status FROM pv JOIN kl USING (location_type, feature))
  SELECT * FROM ws UNION ALL SELECT origin || '|' || h || '|' || x, NULL, NULL, NULL, NULL, NULL, NULL, NULL, status FROM sx WHERE status <> 'ok'"""


def scored(spark: SparkSession, sf_dir: str, arms: tuple[str, ...]) -> DataFrame:
    s = event_sessions(spark, sf_dir).withColumn("dataset", F.lit("events"))
    out = B.rolling_origin(s, X_GRID, HORIZONS, WINDOW, n_scenarios=SCENARIOS, arms=arms)
    out = out.withColumn("cell", F.concat_ws("|", "origin", "h", "x", "scenario", "method"))
    out = out.select("cell", "feature", "n", "m", "ks", "ks_p", "wasserstein", "kl", "status")
    out = rounded(rounded(out, "ks", "ks_p", places=6), "kl", places=5)
    return rounded(out, "wasserstein", places=8)  # halves of the fifth place are common


_PERSISTENCE = "SELECT 'persistence' AS method, origin, h, x, scenario, hour, duration, energy FROM bs"


@query(with_(EV, GRID) + BOOT + _scored(["persistence"], _PERSISTENCE))
def rolling_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The persistence arm of the rolling-origin backtest, and the cells that can't be scored."""
    return scored(spark, sf_dir, ("persistence",))


@query(with_(EV, GRID) + BOOT + MODELS + _scored(["persistence", "gmm", "gmm_recency"], _PERSISTENCE + " UNION ALL SELECT method, origin, h, x, scenario, hour, duration, energy FROM gs"))
def rolling_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All arms on the whole grid."""
    return scored(spark, sf_dir, ("persistence", "gmm", "gmm_recency"))


SCHEDULED = """, sb AS (SELECT concat_ws('/', 'events', origin, h, x, scenario, draw) AS session_id, origin, h, x, arrival_time, duration, energy, power_kw FROM bs), """


@query(with_(EV, GRID) + BOOT.replace(f"range({SCENARIOS})", "range(3)") + ", " + SLOTS + SCHEDULED + _scheduled("sb") + " SELECT 'events' AS dataset, origin, h, x, round(sum(cost_smart), 3) AS cost_smart, round(sum(cost_plug), 3) AS cost_plug FROM res GROUP BY ALL")
def scheduled_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of the persistence arm's sessions of each backtest cell, over three scenarios, under the price signal."""
    s, pools, ok = scored_cells(spark, sf_dir)
    # a draw is a copy of its session, which is scheduled once, however often it is drawn
    costs = C.smart_charge(s.select("session_id", "dataset", "date", "arrival_time", "duration", "energy", "power_kw"), price_signal(s))
    sim = drawn(costs.select("session_id", "dataset", "date", "cost_smart", "cost_plug"), pools, ok, 3)
    totals = sim.groupBy("cell_").agg(F.sum("cost_smart").alias("cost_smart"), F.sum("cost_plug").alias("cost_plug"))
    return rounded(totals.join(ok.select(*B.CELL, "cell_"), "cell_").drop("cell_"), "cost_smart", "cost_plug", places=3)
