"""Models of sessions per context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import gaussian as G
from ..operators.schema import to_features
from ..sources.readers import shared_folder, written
from .adapters import EV, ORD, event_sessions, order_sessions, with_
from .aggregates import rounded
from .registry import query

BY = ["location_type", "season", "is_weekend"]
FEAT = ", ft AS (SELECT *, hour AS x0, ln(1 + duration) AS x1, ln(1 + energy) AS x2 FROM ord)"
COV = ", ".join(f"covar_pop(x{i}, x{j}){' + 1e-5::DOUBLE' if i == j else ''} AS c{i}{j}" for i, j in G.PAIRS)
PAR = FEAT + f", par AS (SELECT location_type, season, is_weekend, count(*) AS n, count(*) / count(DISTINCT date) AS per_day, avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2, {COV} FROM ft GROUP BY ALL HAVING count(*) >= 10)"
NUMBERS = ["per_day", "m0", "m1", "m2", *(f"c{i}{j}" for i, j in G.PAIRS)]
ROUND = ", ".join(f"round({c}, 5) AS {c}" for c in NUMBERS)


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.gaussian_strata(order_sessions(spark, sf_dir), BY)


@query(with_(ORD) + PAR + f" SELECT location_type, season, is_weekend, n, {ROUND} FROM par")
def gaussian_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(params(spark, sf_dir), *NUMBERS, places=5)


WCOV = ", ".join(f"sum(w * x{i} * x{j}) / sum(w) - sum(w * x{i}) * sum(w * x{j}) / (sum(w) * sum(w)){' + 1e-5::DOUBLE' if i == j else ''} AS c{i}{j}" for i, j in G.PAIRS)


@query(with_(ORD) + FEAT + f""", en AS (SELECT department, max(date) AS hi, greatest(1.0::DOUBLE, (max(date) - min(date)) / 3.5::DOUBLE) AS hl, count(*) AS n, count(*) / count(DISTINCT date) AS per_day FROM ft GROUP BY department HAVING count(*) >= 10),
  w AS (SELECT ft.*, en.n, per_day, pow(0.5::DOUBLE, (hi - date) / hl) AS w FROM ft JOIN en USING (department)),
  par AS (SELECT department, any_value(n) AS n, any_value(per_day) AS per_day, sum(w * x0) / sum(w) AS m0, sum(w * x1) / sum(w) AS m1, sum(w * x2) / sum(w) AS m2, {WCOV} FROM w GROUP BY department) SELECT department, n, {ROUND} FROM par""")
def gaussian_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.gaussian_strata(order_sessions(spark, sf_dir), ["department"], recency=True), *NUMBERS, places=5)


DENSITY = """det AS (SELECT *, c11 * c22 - c12 * c12 AS a00, c01 * c22 - c12 * c02 AS a01, c01 * c12 - c11 * c02 AS a02, c00 * c22 - c02 * c02 AS a11, c00 * c12 - c01 * c02 AS a12, c00 * c11 - c01 * c01 AS a22 FROM par),
  dt AS (SELECT *, c00 * a00 - c01 * a01 + c02 * a02 AS d FROM det),
  li AS (SELECT -0.5::DOUBLE * (((x0 - m0) * (x0 - m0) * a00 - 2 * (x0 - m0) * (x1 - m1) * a01 + 2 * (x0 - m0) * (x2 - m2) * a02 + (x1 - m1) * (x1 - m1) * a11 - 2 * (x1 - m1) * (x2 - m2) * a12 + (x2 - m2) * (x2 - m2) * a22) / d + ln(d) + 3 * ln(2 * pi())) AS l
    FROM ft JOIN dt USING (location_type, season, is_weekend))"""


@query(with_(ORD) + PAR + ", " + DENSITY + " SELECT round(avg(l), 5) AS score, count(*) AS n FROM li")
def gaussian_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.gaussian_score(order_sessions(spark, sf_dir), params(spark, sf_dir), BY), "score", places=5)


@query(with_(EV, ORD) + PAR + """, wa AS (SELECT DISTINCT location_type, season, is_weekend FROM ev), rk AS (SELECT *, row_number() OVER (ORDER BY n DESC, location_type, season, is_weekend) AS r0,
    row_number() OVER (PARTITION BY location_type ORDER BY n DESC, location_type, season, is_weekend) AS r1, row_number() OVER (PARTITION BY location_type, season ORDER BY n DESC, location_type, season, is_weekend) AS r2 FROM par)
  SELECT w.*, CASE WHEN e.n IS NOT NULL THEN 3 WHEN s.n IS NOT NULL THEN 2 WHEN l.n IS NOT NULL THEN 1 ELSE 0 END AS level, coalesce(e.location_type, s.location_type, l.location_type, t.location_type) AS ctx_location_type,
    coalesce(e.season, s.season, l.season, t.season) AS ctx_season, coalesce(e.is_weekend, s.is_weekend, l.is_weekend, t.is_weekend) AS ctx_is_weekend
  FROM wa w LEFT JOIN rk e ON e.location_type = w.location_type AND e.season = w.season AND e.is_weekend = w.is_weekend LEFT JOIN rk s ON s.r2 = 1 AND s.location_type = w.location_type AND s.season = w.season
    LEFT JOIN rk l ON l.r1 = 1 AND l.location_type = w.location_type JOIN rk t ON t.r0 = 1""")
def context_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of events, from their dates, found among the models of orders."""
    return G.resolve_context(event_sessions(spark, sf_dir).select(*BY).distinct(), params(spark, sf_dir), BY)


@query(with_(ORD) + PAR + """, a AS (SELECT location_type, season FROM par WHERE is_weekend = 0), b AS (SELECT location_type, season FROM par WHERE is_weekend = 1 AND season <> 'winter')
  SELECT 'shared' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_left', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'only_right', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def context_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = params(spark, sf_dir)
    return G.context_overlap(p.filter("is_weekend = 0"), p.filter("is_weekend = 1 and season <> 'winter'"), ["location_type", "season"])


@query(with_(ORD) + PAR + " SELECT location_type, season, CASE season WHEN 'winter' THEN 0 WHEN 'spring' THEN 1 WHEN 'summer' THEN 2 ELSE 3 END AS season_order, round(sum(n * m0) / sum(n), 5) AS hour, round(sum(n * m1) / sum(n), 5) AS log_duration, round(sum(n * m2) / sum(n), 5) AS log_energy FROM par GROUP BY location_type, season")
def context_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.when(F.col("season") == "winter", 0).when(F.col("season") == "spring", 1).when(F.col("season") == "summer", 2).otherwise(3)
    out = G.weighted_means(params(spark, sf_dir), ["location_type", "season"]).withColumn("season_order", order)
    return rounded(out, "hour", "log_duration", "log_energy", places=5)


@query(with_(ORD) + ", p AS (SELECT department, season, count(*) AS n, count(*) / count(DISTINCT date) AS r FROM ord GROUP BY ALL HAVING count(*) >= 10) SELECT department, count(*) AS n_contexts, CAST(sum(n) AS BIGINT) AS total_samples, round(avg(r), 5) AS mean_per_day FROM p GROUP BY department")
def context_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.context_summary(G.gaussian_strata(order_sessions(spark, sf_dir), ["department", "season"])), "mean_per_day", places=5)


@query(with_(ORD) + """, y AS (SELECT department, mode(year(date) ORDER BY year(date)) AS year FROM ord GROUP BY department), p AS (SELECT department, location_type, count(*) AS n FROM ord GROUP BY ALL), k AS (SELECT department, count(*) AS k FROM p GROUP BY department)
  SELECT (SELECT year FROM (SELECT year(date) AS year, count(*) AS n FROM ord GROUP BY 1 ORDER BY n DESC, year LIMIT 1)) AS training_year, min(k) AS min_k, avg(k) AS mean_k, max(k) AS max_k FROM k""".replace("y AS (SELECT department, mode(year(date) ORDER BY year(date)) AS year FROM ord GROUP BY department), ", ""))
def training_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.training_summary(order_sessions(spark, sf_dir), "department", "location_type")


@query(with_(ORD) + ", r AS (SELECT *, row_number() OVER (PARTITION BY department, season ORDER BY md5('3|' || session_id), session_id) AS n FROM ord) SELECT session_id, department, season FROM r WHERE n <= 20")
def capped_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.capped(order_sessions(spark, sf_dir), ["department", "season"], 20, seed=3).select("session_id", "department", "season")


def _uniform(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _normals(key: str) -> list[str]:
    """The three reproducible normal numbers of one key, in SQL."""
    u = [f"(('0x' || substr(md5({key}), {1 + 8 * i}, 8))::BIGINT / 4294967296.0::DOUBLE)" for i in range(4)]
    radius = lambda x: f"sqrt(-2 * ln(greatest({x}, 1e-12::DOUBLE)))"
    return [f"({radius(u[0])} * cos(2 * pi() * {u[1]}))", f"({radius(u[0])} * sin(2 * pi() * {u[1]}))", f"({radius(u[2])} * cos(2 * pi() * {u[3]}))"]


def _normal(key: str) -> str:
    """The reproducible normal number of a key, in SQL."""
    u, v = (_uniform(f"'n{i}|' || {key}") for i in (1, 2))
    return f"(sqrt(-2 * ln(greatest({u}, 1e-12::DOUBLE))) * cos(2 * pi() * {v}))"


def _gaussian_draws(cells: str, keys: str, key: str) -> str:
    """SQL of draws from moments: ``cells`` has one row for each draw, ``key`` is the text of its normal numbers."""
    z = _normals(key)
    return f"""zz0 AS (SELECT *, {z[0]} AS z0, {z[1]} AS z1, {z[2]} AS z2, sqrt(c00) AS l00 FROM {cells}), zz1 AS (SELECT *, c01 / l00 AS l10, c02 / l00 AS l20 FROM zz0),
  zz2 AS (SELECT *, sqrt(greatest(c11 - l10 * l10, 1e-12::DOUBLE)) AS l11 FROM zz1), zz3 AS (SELECT *, (c12 - l20 * l10) / l11 AS l21 FROM zz2), zz4 AS (SELECT *, sqrt(greatest(c22 - l20 * l20 - l21 * l21, 1e-12::DOUBLE)) AS l22 FROM zz3),
  gs AS (SELECT {keys}, least(greatest(m0 + l00 * z0, 0.0::DOUBLE), 23.99::DOUBLE) AS hour, least(greatest(exp(m1 + l10 * z0 + l11 * z1) - 1, 0.08::DOUBLE), 48.0::DOUBLE) AS duration,
    least(greatest(exp(m2 + l20 * z0 + l21 * z1 + l22 * z2) - 1, 0.01::DOUBLE), 350.0::DOUBLE) AS energy FROM zz4)"""


@query(with_(ORD) + PAR + ", dr AS (SELECT *, unnest(generate_series(1, n)) AS draw FROM par), " + _gaussian_draws("dr", "location_type, season, is_weekend, n, draw", "'1|' || location_type || '|' || season || '|' || is_weekend || '|' || draw")
       + " SELECT location_type, season, is_weekend, n, CAST(draw AS INT) AS draw, round(hour, 5) AS hour, round(duration, 5) AS duration, round(energy, 5) AS energy FROM gs")
def gaussian_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many drawn sessions for each context as it has."""
    p = written(params(spark, sf_dir))
    return rounded(G.gaussian_sessions(p, p.select(*BY, "n"), BY, seed=1), "hour", "duration", "energy", places=5)


DATED = ["season", "is_weekend", "location_type"]


@query(with_(EV, ORD) + PAR + """, wa AS (SELECT DISTINCT date, season, is_weekend FROM ev), rk AS (SELECT *, row_number() OVER (ORDER BY n DESC, season, is_weekend, location_type) AS r0, row_number() OVER (PARTITION BY season ORDER BY n DESC, season, is_weekend, location_type) AS r1,
    row_number() OVER (PARTITION BY season, is_weekend ORDER BY n DESC, season, is_weekend, location_type) AS r2, row_number() OVER (ORDER BY n DESC, location_type, season, is_weekend) AS q0 FROM par)
  SELECT w.date, CASE WHEN e.n IS NOT NULL THEN 2 WHEN s.n IS NOT NULL THEN 1 ELSE 0 END AS level, coalesce(e.location_type, s.location_type, t.location_type) AS ctx_location_type, coalesce(e.season, s.season, t.season) AS ctx_season,
    coalesce(e.is_weekend, s.is_weekend, t.is_weekend) AS ctx_is_weekend, 0 AS place_level, q.location_type AS place_location_type, q.season AS place_season, q.is_weekend AS place_is_weekend
  FROM wa w LEFT JOIN rk e ON e.r2 = 1 AND e.season = w.season AND e.is_weekend = w.is_weekend LEFT JOIN rk s ON s.r1 = 1 AND s.season = w.season JOIN rk t ON t.r0 = 1 JOIN rk q ON q.q0 = 1""")
def context_of_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of dates alone, the place unknown: with the place as last key the season decides, as first key the most populous of all."""
    dates, p = event_sessions(spark, sf_dir).select("date").distinct(), params(spark, sf_dir)
    last = G.resolve_context(G.contexts_of_dates(dates, DATED), p, DATED).drop(*DATED)
    first = G.resolve_context(G.contexts_of_dates(dates, BY), p, BY).drop(*BY)
    return last.join(first.withColumnsRenamed({"level": "place_level", **{f"ctx_{b}": f"place_{b}" for b in BY}}), "date")


@query(with_(ORD) + ", p AS (SELECT department, season, count(*) AS n FROM ord GROUP BY ALL HAVING count(*) >= 10), d AS (SELECT department, CAST(sum(n) AS BIGINT) AS total_samples FROM p GROUP BY department) SELECT department, total_samples, CAST(row_number() OVER (ORDER BY total_samples DESC, department) AS INT) AS position FROM d")
def context_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departments in the order of the sorted summary: the place of each row as it comes out."""
    out = G.context_summary(G.gaussian_strata(order_sessions(spark, sf_dir), ["department", "season"]))
    placed = out.withColumn("at_", F.monotonically_increasing_id())  # a row for each department
    return placed.select("department", "total_samples", F.row_number().over(Window.orderBy("at_")).alias("position"))


@query(None)
def gaussian_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.gaussian_mixtures(order_sessions(spark, sf_dir), ["location_type", "season"], 3, shared_folder(spark))[0]


@query(None)
def component_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.component_count_by_bic(event_sessions(spark, sf_dir), shared_folder(spark))


@query(None)
def context_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of components of every place and season, by BIC."""
    return G.component_counts(order_sessions(spark, sf_dir), ["location_type", "season"], shared_folder(spark))[0]


@query(with_(ORD) + FEAT + " SELECT session_id, round(x1, 6) AS f_duration, round(x2, 6) AS f_energy FROM ft")
def log_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(to_features(order_sessions(spark, sf_dir)).select("session_id", "f_duration", "f_energy"), "f_duration", "f_energy", places=6)
