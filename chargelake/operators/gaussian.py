"""Gaussian models of sessions per context: moments, scores, draws, mixtures, and context lookup."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import normals, recency_weight, season
from .aggregate import present
from .mixture_kernels import SUMS as STEP_SUMS
from .mixture_kernels import expected, packed, started
from .schema import from_features, to_features

FEATURES = ["f_hour", "f_duration", "f_energy"]
PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
RIDGE = 1e-5
#: Draws that one row stands for until they are drawn.
PACK = 1000


def moments(w: Column | None = None) -> list[Column]:
    """Means m0-m2 and covariances c00-c22 (division by n) of the features, plain or weighted, as one aggregation."""
    x = [F.col(f) for f in FEATURES]
    if w is None:
        mean = [F.avg(c) for c in x]
        cov = {(i, j): F.covar_pop(x[i], x[j]) for i, j in PAIRS}
    else:
        total = F.sum(w)
        mean = [F.sum(w * c) / total for c in x]
        cov = {(i, j): F.sum(w * x[i] * x[j]) / total - F.sum(w * x[i]) * F.sum(w * x[j]) / (total * total) for i, j in PAIRS}
    return [m.alias(f"m{i}") for i, m in enumerate(mean)] + [(c + (RIDGE if i == j else 0)).alias(f"c{i}{j}") for (i, j), c in cov.items()]


SUMS = [f"s{i}" for i in range(3)] + [f"s{i}{j}" for i, j in PAIRS]


def day_moments(df: DataFrame, by: list[str]) -> DataFrame:
    """``by, date, n, k, s*``: of each context and day the sessions, those with all features, and the sums of these features and of their products.

    Moments of days can be added, so every pool of days, with any weights by day, is a sum over rows of this table.
    """
    x = [F.col(f) for f in FEATURES]
    whole = x[0].isNotNull() & x[1].isNotNull() & x[2].isNotNull()
    sums = [F.sum(F.when(whole, c)).alias(f"s{i}") for i, c in enumerate(x)] + [F.sum(F.when(whole, x[i] * x[j])).alias(f"s{i}{j}") for i, j in PAIRS]
    return to_features(present(df, [*by, "date"])).groupBy(*by, "date").agg(F.count("*").alias("n"), F.count_if(whole).alias("k"), *sums)


def strata_of_days(days: DataFrame, by: list[str], recency: bool = False, half_life_days: float | None = None, least: int = 10) -> DataFrame:
    """``gaussian_strata`` of the days' moments (``by, date, n, k, s*``); a day may be in several contexts."""
    extra = [F.sum("n").alias("n"), (F.sum("n") / F.count("*")).alias("per_day")]
    w = F.lit(1.0)
    if recency:
        ends = days.groupBy(*by).agg(F.max("date").alias("hi_"), F.min("date").alias("lo_"))
        half = F.lit(float(half_life_days)) if half_life_days else F.greatest(F.lit(1.0), F.datediff("hi_", "lo_") / 3.5)
        days = days.join(ends.withColumn("half_", half), by)
        w = recency_weight(F.datediff("hi_", "date"), "half_")
    out = days.groupBy(*by).agg(*extra, F.sum(w * F.col("k")).alias("w_"), *(F.sum(w * F.col(c)).alias(c) for c in SUMS)).filter(F.col("n") >= least)
    mean = [F.try_divide(F.col(f"s{i}"), F.col("w_")) for i in range(3)]
    cov = {(i, j): F.try_divide(F.col(f"s{i}{j}"), F.col("w_")) - mean[i] * mean[j] for i, j in PAIRS}
    cov = {(i, j): (F.greatest(c, F.lit(0.0)) + RIDGE if i == j else c) for (i, j), c in cov.items()}
    return out.select(*by, "n", "per_day", *(m.alias(f"m{i}") for i, m in enumerate(mean)), *(c.alias(f"c{i}{j}") for (i, j), c in cov.items()))


def gaussian_strata(df: DataFrame, by: list[str], recency: bool = False, half_life_days: float | None = None, least: int = 10) -> DataFrame:
    """One row for each context with enough sessions: count, rate per day, mean and covariance (division by n) of the log features.

    recency: rows weigh 0.5^(age / half-life), age from the context's last day; half-life: given, or the context's
    span / 3.5 and at least a day.  Sessions are added up by day before anything else, so only days are joined and weighed.
    """
    return strata_of_days(day_moments(df, by), by, recency, half_life_days, least)


def log_density(of: Callable[[str], Column] = F.col) -> Column:
    """Of the features under m0-m2, c00-c22 (given by ``of``): closed form of the inverse and determinant of a 3 x 3 matrix."""
    c = {(i, j): of(f"c{min(i, j)}{max(i, j)}") for i in range(3) for j in range(3)}
    minor = lambda i, j: (lambda r, s: c[r[0], s[0]] * c[r[1], s[1]] - c[r[0], s[1]] * c[r[1], s[0]])([k for k in range(3) if k != i], [k for k in range(3) if k != j])
    det = c[0, 0] * minor(0, 0) - c[0, 1] * minor(0, 1) + c[0, 2] * minor(0, 2)
    d = [F.col(f) - of(f"m{i}") for i, f in enumerate(FEATURES)]
    quad = sum((d[i] * d[j] * minor(i, j) * (-1) ** (i + j) for i in range(3) for j in range(3)), F.lit(0.0)) / det
    return -0.5 * (quad + F.ln(det) + 3 * math.log(2 * math.pi))


def gaussian_score(df: DataFrame, params: DataFrame, by: list[str]) -> DataFrame:
    """Mean log-likelihood over the sessions whose context has a model; none: minus infinity."""
    rows = to_features(df).join(params, by).agg(F.avg(log_density()).alias("score"), F.count("*").alias("n"))
    return rows.select(F.coalesce("score", F.lit(float("-inf"))).alias("score"), "n")


def resolve_context(wanted: DataFrame, params: DataFrame, by: list[str]) -> DataFrame:
    """``wanted`` (its keys may be null: unknown) with ``level`` and the model's context ``ctx_*``: the exact one, else that with the longest common
    beginning of ``by`` (its most populous), else the most populous of all.  One join per length."""
    ctx = params.select("n", *by)
    top = ctx.orderBy(F.desc("n"), *by).limit(1).select(*(F.col(b).alias(f"t_{b}") for b in by))
    out = wanted.join(F.broadcast(top))
    picks = []
    for length in range(len(by), 0, -1):
        keys = by[:length]
        w = Window.partitionBy(*keys).orderBy(F.desc("n"), *by)
        one = ctx.withColumn("r_", F.row_number().over(w)).filter("r_ = 1")
        name = f"p{length}"
        one = one.select(*(F.col(k).alias(f"k_{k}") for k in keys), F.struct(*by).alias(name))
        out = out.join(one, [F.col(k) == F.col(f"k_{k}") for k in keys], "left").drop(*(f"k_{k}" for k in keys))
        picks.append((length, name))
    level = F.coalesce(*(F.when(F.col(n).isNotNull(), F.lit(k)) for k, n in picks), F.lit(0))
    chosen = F.coalesce(*(F.col(n) for _, n in picks), F.struct(*(F.col(f"t_{b}").alias(b) for b in by)))
    out = out.withColumn("level", level).withColumn("c_", chosen)
    return out.select(*wanted.columns, "level", *(F.col(f"c_.{b}").alias(f"ctx_{b}") for b in by))


def gaussian_sessions(
    params: DataFrame, draws: DataFrame, by: list[str], seed: int = 0, carried: tuple[str, ...] = (), dealt: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """``n`` sessions for each row of ``draws``: Cholesky factor times reproducible normals, back from log features.

    The normals depend on all columns of ``draws`` but ``carried`` and n.  A row of many draws is dealt to all tasks in packs of PACK,
    or as ``dealt`` says; draws stay where their pack is.  None of 0 is drawn.
    """
    p, n = params.drop("n"), F.col("n").cast("int")
    packs = draws.join(p, by).filter(n > 0).withColumn("pack_", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / PACK).cast("int"))))
    packs = dealt(packs) if dealt else packs.repartition(4 * draws.sparkSession.sparkContext.defaultParallelism)
    each = packs.withColumn("draw", F.explode(F.sequence(F.col("pack_") * PACK + 1, F.least(n, (F.col("pack_") + 1) * PACK)))).drop("pack_")
    l00 = F.sqrt("c00")
    l10, l20 = F.col("c01") / l00, F.col("c02") / l00
    l11 = F.sqrt(F.greatest(F.col("c11") - l10 * l10, F.lit(1e-12)))
    l21 = (F.col("c12") - l20 * l10) / l11
    l22 = F.sqrt(F.greatest(F.col("c22") - l20 * l20 - l21 * l21, F.lit(1e-12)))
    z = normals(F.lit(seed), *by, *(c for c in draws.columns if c not in (*by, *carried, "n")), "draw")
    f = {"f_hour": F.col("m0") + l00 * z[0], "f_duration": F.col("m1") + l10 * z[0] + l11 * z[1], "f_energy": F.col("m2") + l20 * z[0] + l21 * z[1] + l22 * z[2]}
    return from_features(each.withColumns(f)).select(*draws.columns, "draw", "hour", "duration", "energy")


def fit_mixtures(
    df: DataFrame, by: list[str], ks: list[int], folder: str, rounds: int = 300, least: int = 10, tolerance: float = 1e-3
) -> tuple[DataFrame, list[float]]:
    """``by, kk, k, weight, mass, mean_ll, m*, c*``: mixtures of kk Gaussians, for every context and each kk of ``ks`` at once, by
    expectation-maximisation; and each round's mean log-likelihood.  A context needs ``least`` sessions and five for each component.

    Sessions with the same features are one row with their number, and rows of a context lie in packs of at most 2,048.  A
    round joins the packs with the contexts' parameters, works out responsibilities as products of matrices, a pack at a time, and adds
    up one row for each pack and component: sessions aren't shuffled by themselves.  Parameters are written to ``folder`` (shared)
    each round, which cuts the lineage.  Components start as ranges of energy between the context's quantiles.  A mixture is done when
    its mean log-likelihood changes by less than ``tolerance``; only the others go on, ``rounds`` at most.
    Sessions without all features are left out.
    """
    spark = df.sparkSession
    base = f"{folder}/{uuid.uuid4().hex}"

    def save(t: DataFrame, name: str) -> DataFrame:
        t.write.parquet(f"{base}/{name}")
        return spark.read.schema(t.schema).parquet(f"{base}/{name}")

    names = ["weight", "mass", *(f"m{i}" for i in range(3)), *(f"c{i}{j}" for i, j in PAIRS)]
    rows = to_features(present(df, by)).select(*by, *(F.col(f).cast("double").alias(f) for f in FEATURES)).na.drop(subset=FEATURES)
    distinct = save(rows.groupBy(*by, *FEATURES).agg(F.count("*").cast("double").alias("count_")), "rows")
    parts = 4 * spark.sparkContext.defaultParallelism
    near = distinct.repartitionByRange(parts, *by, *FEATURES).sortWithinPartitions(*by)  # a large context is many ranges
    keys = [f for f in near.schema.fields if f.name in by]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)
    packs = save(near.mapInArrow(packed(by, [*FEATURES, "count_"]), f"{ddl}, pack binary"), "packs")
    shares = sorted({i / kk for kk in ks for i in range(1, kk)})
    cuts = F.percentile_approx("f_energy", F.lit(shares), 10_000).alias("cuts")
    starts = rows.groupBy(*by).agg(F.count("*").alias("size_"), cuts)
    starts = save(starts.filter(F.col("size_") >= least), "starts")
    each = F.explode(F.array(*(F.struct(F.lit(kk).alias("kk"), F.array(*(F.element_at("cuts", shares.index(i / kk) + 1) for i in range(1, kk))).alias("cuts")) for kk in ks)))
    wide = starts.select(*by, "size_", each.alias("s_")).select(*by, "size_", "s_.kk", "s_.cuts").filter("size_ >= 5 * kk")
    step = f"{ddl}, kk int, k int, " + ", ".join(f"{c} double" for c in STEP_SUMS)

    def added(models: DataFrame, run: Callable) -> DataFrame:
        sums = packs.join(models, by).mapInArrow(run, step)
        return sums.groupBy(*by, "kk", "k").agg(*(F.sum(c).alias(c) for c in STEP_SUMS))

    def parameters() -> list[Column]:
        mean = [F.col(f"s{i}") / F.col("w_") for i in range(3)]
        return [m.alias(f"m{i}") for i, m in enumerate(mean)] + [
            (F.col(f"s{i}{j}") / F.col("w_") - mean[i] * mean[j] + (RIDGE if i == j else 0)).alias(f"c{i}{j}") for i, j in PAIRS
        ]

    def as_rows(t: DataFrame) -> DataFrame:
        """The components of a mixture as one array, at most kk of them, with their weights."""
        held = t.select(*by, "kk", "k", "mass", "sum_", *parameters()).groupBy(*by, "kk")
        held = held.agg(F.sort_array(F.collect_list(F.struct("k", *names[1:]))).alias("parts"), F.sum("mass").alias("size_"), F.sum("sum_").alias("sum_all"))
        weight = lambda c: F.greatest(c["mass"] / F.col("size_"), F.lit(1e-9)).alias("weight")
        weighed = F.transform("parts", lambda c: F.struct(c["k"].alias("k"), weight(c), *(c[x].alias(x) for x in names[1:])))
        return held.select(*by, "kk", (F.col("sum_all") / F.col("size_")).alias("mean_ll"), weighed.alias("parts"))

    ranges = F.transform(F.sequence(F.lit(0), F.size("cuts")), lambda k: F.struct(
        k.alias("k"), F.coalesce(F.get("cuts", k - 1), F.lit(float("-inf"))).alias("low"), F.coalesce(F.get("cuts", k), F.lit(float("inf"))).alias("high")
    ))
    spread = wide.select(*by, "kk", F.explode(ranges).alias("p_"))
    spread = spread.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("kk", "p_.*"))).alias("p_"))
    spread = spread.select(*by, F.col("p_.kk").alias("kks"), F.col("p_.k").alias("ks"), F.col("p_.low").alias("lows"), F.col("p_.high").alias("highs"))
    now = as_rows(added(spread, started(by)).filter("mass > 0")).withColumn("mean_ll", F.lit(float("-inf"))).withColumn("done", F.lit(False))
    now = save(now, "0")
    trace: list[float] = []
    for n in range(1, rounds + 1):
        live = now.filter("not done")
        flat = F.transform("parts", lambda c: F.struct(F.col("kk").alias("kk"), c["k"].alias("k"), F.array(*(c[x] for x in ("weight", *names[2:]))).alias("form")))
        forms = live.groupBy(*by).agg(F.sort_array(F.flatten(F.collect_list(flat))).alias("p_"))  # at most ks of them, of kk each
        forms = forms.select(*by, F.col("p_.kk").alias("kks"), F.col("p_.k").alias("ks"), F.flatten("p_.form").alias("forms"))
        stepped = as_rows(added(forms, expected(by))).join(live.select(*by, "kk", F.col("mean_ll").alias("before_")), [*by, "kk"])
        stepped = stepped.withColumn("done", F.abs(F.col("mean_ll") - F.col("before_")) < tolerance).drop("before_")
        now = save(now.filter("done").unionByName(stepped), str(n))
        mass = F.aggregate("parts", F.lit(0.0), lambda total, c: total + c["mass"])
        likely, size, left = now.agg(F.sum(F.col("mean_ll") * mass), F.sum(mass), F.count_if(~F.col("done"))).first()
        trace.append(float(likely) / float(size) if size else float("nan"))
        if not left:
            break
    out = now.select(*by, "kk", "mean_ll", F.explode("parts").alias("p_"))
    return out.select(*by, "kk", "p_.k", "mean_ll", *(F.col(f"p_.{c}").alias(c) for c in names)), trace


def gaussian_mixtures(df: DataFrame, by: list[str], k: int, folder: str, rounds: int = 300, least: int = 10, tolerance: float = 1e-3) -> tuple[DataFrame, list[float]]:
    """Mixtures of ``k`` Gaussians in every context, and each round's mean log-likelihood (``fit_mixtures``)."""
    params, trace = fit_mixtures(df, by, [k], folder, rounds, least, tolerance)
    return params.drop("kk", "mean_ll"), trace


def component_counts(df: DataFrame, by: list[str], folder: str, least: int = 2, most: int = 10, rounds: int = 300, tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """For every context ``by, kk, bic, best`` of mixtures of ``least`` to min(``most``, n / 5) components, and the best one's parameters.

    All contexts and numbers of components are fitted in one run of ``fit_mixtures``.  Contexts without five sessions for
    each of ``least`` components have no row; the single Gaussian of ``gaussian_strata`` is theirs.
    """
    params, _ = fit_mixtures(df, by, list(range(least, most + 1)), folder, rounds, 10, tolerance)
    size = F.sum("mass")
    bic = params.groupBy(*by, "kk").agg((-2 * F.first("mean_ll") * size + (F.col("kk") * 9 + F.col("kk") - 1) * F.ln(F.round(size))).alias("bic"))
    best = bic.groupBy(*by).agg(F.min_by("kk", F.struct("bic", "kk")).alias("best_"))
    table = bic.join(best, by).withColumn("best", F.col("kk") == F.col("best_")).drop("best_")
    return table, params.join(table.filter("best").select(*by, "kk"), [*by, "kk"], "left_semi")


def component_count_by_bic(df: DataFrame, folder: str, least: int = 2, most: int = 10, rounds: int = 300, tolerance: float = 1e-3) -> DataFrame:
    """``k, bic`` of unstratified mixtures of ``least`` to min(``most``, n / 5) components; the least is best (``component_counts``)."""
    table, _ = component_counts(df.withColumn("all_", F.lit(1)), ["all_"], folder, least, most, rounds, tolerance)
    return table.select(F.col("kk").alias("k"), "bic")


def contexts_of_dates(dates: DataFrame, by: list[str], date: str = "date") -> DataFrame:
    """Context keys of dates: weekday, weekend flag, month and season as they follow; any other key of ``by`` is null (unknown)."""
    day = F.weekday(date)
    known = {"day_of_week": day, "is_weekend": (day >= 5).cast("int"), "month": F.month(date), "season": season(F.month(date))}
    return dates.select(date, *(known[b].alias(b) if b in known else F.lit(None).cast("string").alias(b) for b in by))


def training_summary(df: DataFrame, by: str, components: str, date: str = "date") -> DataFrame:
    """The year with most sessions (ties: the earliest), and the least, mean and largest number of components of the groups."""
    k = df.groupBy(by, components).count().groupBy(by).agg(F.count("*").alias("k"))
    k = k.agg(F.min("k").alias("min_k"), F.avg("k").alias("mean_k"), F.max("k").alias("max_k"))
    return df.agg(F.mode(F.year(date), True).alias("training_year")).join(F.broadcast(k))  # one row each


def context_summary(params: DataFrame, by: str = "department") -> DataFrame:
    """Contexts, and the sessions behind them, by department; most sessions first."""
    return params.groupBy(by).agg(F.count("*").alias("n_contexts"), F.sum("n").alias("total_samples"), F.avg("per_day").alias("mean_per_day")).orderBy(F.desc("total_samples"), by)


def weighted_means(params: DataFrame, by: list[str], weight: str = "n") -> DataFrame:
    total = F.sum(weight)
    return params.groupBy(*by).agg(*((F.sum(F.col(weight) * F.col(m)) / total).alias(n) for m, n in (("m0", "hour"), ("m1", "log_duration"), ("m2", "log_energy"))))


def context_overlap(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """How many contexts both have, only the first, only the second."""
    x, y = a.select(*by).distinct(), b.select(*by).distinct()
    counts = {"shared": x.intersect(y), "only_left": x.exceptAll(y), "only_right": y.exceptAll(x)}
    out = None
    for name, rows in counts.items():
        one = rows.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def capped(df: DataFrame, by: list[str], cap: int, id_: str = "session_id", seed: int = 0) -> DataFrame:
    """At most ``cap`` sessions of each context: those with the smallest hashes, ties by id.

    No task sorts a context.  Sessions are counted by the first three digits of their hash, partly before any shuffle; the
    counts (4,096 a context at most) say in which of these parts the cap is reached.  All before it are in, and only that part
    is ranked.
    """
    hashed = present(df, by).withColumn("h_", F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col(id_).cast("string"))))
    hashed = hashed.withColumn("part_", F.substring("h_", 1, 3))
    before = F.coalesce(F.sum("c_").over(Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = hashed.groupBy(*by, "part_").agg(F.count("*").alias("c_")).withColumn("room_", F.lit(cap) - before).filter("room_ > 0")
    near = hashed.join(counts, [*by, "part_"])
    last = near.filter("c_ > room_").withColumn("r_", F.row_number().over(Window.partitionBy(*by, "part_").orderBy("h_", id_)))
    return near.filter("c_ <= room_").select(*df.columns).unionByName(last.filter("r_ <= room_").select(*df.columns))
