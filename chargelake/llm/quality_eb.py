"""Document quality: classifier evidence combined with host and path posteriors (empirical Bayes)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decision_list import FEATURES
from .textstats import COUNTS, text_statistics
from .util import Scratch, chosen_labels, labelled_sample, with_columns_last

#: Evidence from the text: the ratios of the quality rules, compressed, and the logarithm of the length.
INPUTS: dict[str, str] = {f: (f"ln(1 + {e})" if f == "words" else f"sqrt({e})") for f, e in FEATURES.items()}


@dataclass(frozen=True)
class Evidence:
    """A logistic model of standardised inputs: log odds of quality 1, and the share of quality 1."""

    weights: tuple[float, ...]
    bias: float
    prior: float

    def column(self) -> Column:
        terms = [F.expr(e) * F.lit(w) for e, w in zip(INPUTS.values(), self.weights, strict=True)]
        return sum(terms, F.lit(self.bias))


def fit_evidence(docs: DataFrame, labels: DataFrame, sample: int = 20_000, ridge: float = 1.0) -> Evidence:
    """Ridge logistic regression by Newton steps on at most ``sample`` labelled documents.

    Without both kinds of labels the evidence is nil for every document and the prior is that of the labels
    (one half without any).
    """
    found = text_statistics(labelled_sample(docs, labels, "quality", sample))
    rows = found.select("target_", *(F.expr(e).alias(f) for f, e in INPUTS.items())).toPandas()
    y, x = rows["target_"].to_numpy(float), rows[list(INPUTS)].to_numpy(float)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    if len(set(y)) < 2:
        return Evidence((0.0,) * len(INPUTS), float(np.log(prior / (1 - prior))), float(prior))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    penalty, w = np.diag([ridge] * len(INPUTS) + [1e-6]), np.zeros(len(INPUTS) + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[:-1] / scale
    return Evidence(tuple(map(float, weights)), float(w[-1] - weights @ mean), float(prior))


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without port: ``host`` for tables with URLs."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def path_of(url: Column) -> Column:
    """The first part of a URL's path ('' where there is none): ``path`` for tables with URLs."""
    return F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://[^/?#]+/([^/?#]*)", 1)


@dataclass(frozen=True)
class Shrinking:
    """The corpus mean and the prior sample sizes of hosts and of paths."""

    mean: float
    k_host: float
    k_path: float

    def posterior(self, s: Column, n: Column, host_s: Column, host_n: Column) -> Column:
        """Mean of a path's Beta posterior, whose prior is its host's, whose prior is the corpus."""
        host_p = (F.lit(self.mean * self.k_host) + host_s) / (F.lit(self.k_host) + host_n)
        return (host_p * self.k_path + s) / (F.lit(self.k_path) + n)


def shrinking(paths: DataFrame) -> Shrinking:
    """From ``host_, path_, s, n, host_s, host_n``: the prior sample sizes that the spread of means implies, by moments.

    A Beta prior of mean m and size k has the variance m (1 - m) / (k + 1).  Hosts spread about the corpus mean, paths about the
    mean of their own host; what sampling alone explains is taken off.
    """
    hosts = paths.groupBy("host_").agg(F.first("host_s").alias("s"), F.first("host_n").alias("n")).filter("n > 0")
    total = hosts.agg(F.sum("s"), F.sum("n"), F.sum(F.col("s") * F.col("s") / F.col("n")), F.count("*")).first()
    if not total[1]:
        return Shrinking(0.5, 1.0, 1.0)
    m = min(max(total[0] / total[1], 1e-6), 1 - 1e-6)
    between_hosts = total[2] / total[1] - m * m - m * (1 - m) * (total[3] - 1) / total[1]
    off = F.col("s") / F.col("n") - F.col("host_s") / F.col("host_n")
    inner = paths.filter("n > 0").agg(F.sum(F.col("n") * off * off), F.count("*")).first()
    between_paths = inner[0] / total[1] - m * (1 - m) * (inner[1] - total[3]) / total[1]
    size = lambda v: float(min(max(m * (1 - m) / max(v, 1e-6) - 1, 1.0), 1e4))
    return Shrinking(float(m), size(between_hosts), size(between_paths))


def site_sums(rows: DataFrame) -> DataFrame:
    """``host_, path_, s, n, host_s, host_n`` from ``host_, path_, own_s, own_n`` of every document.

    Grouped aggregation: a host with a third of all rows is summed in parts before the shuffle.
    """
    paths = rows.groupBy("host_", "path_").agg(F.sum("own_s").alias("s"), F.sum("own_n").alias("n"))
    hosts = paths.groupBy(F.col("host_").alias("of_")).agg(F.sum("s").alias("host_s"), F.sum("n").alias("host_n"))
    return paths.join(hosts, F.col("host_").eqNullSafe(F.col("of_"))).drop("of_")


def quality_scores(
    docs: DataFrame,
    evidence: Evidence,
    labels: DataFrame | None = None,
    host: str = "source",
    path: str = "lang",
    sample: int = 20_000,
    soft: float = 0.1,
    keep_text: bool = False,
) -> DataFrame:
    """``docs`` with ``doc_p`` (text alone), ``site_p``, ``quality_p`` and ``kept`` (quality_p >= 0.5).

    A site is a path of a host.  Its counts are those of the labels (at most ``sample``, the ones the evidence is fitted to), and
    every other document adds ``soft`` of a label of the value that its text suggests.  A document never votes for
    itself: its own part is taken from its path and its host before their posteriors.  quality_p adds up log odds: the
    evidence of the text, and how far the posterior of the document's path lies from the corpus.  A path with few
    documents is shrunk to its host, a host with few to the corpus.

    One pass over the texts; its table is read for the sums and again for the result.
    Null host or path: a site of its own.  Null or empty text: scored as a text without words.  Very long texts are
    counted whole.  Null ids: never labelled.  Repeated rows and ties: each row alike.  Empty table: no rows.  Clashing
    columns are renamed ``in_<name>``.
    """
    inner = ["logit_", "id_", "y_", "host_", "path_", "own_s", "own_n", "s", "n", "host_s", "host_n"]
    docs = with_columns_last(docs, [*COUNTS, "doc_p", "site_p", "quality_p", "kept", *inner])
    scratch = Scratch(docs.sparkSession)
    logit = F.greatest(F.least(evidence.column(), F.lit(30.0)), F.lit(-30.0))
    scored = scratch.save(text_statistics(docs, keep_text=keep_text).withColumn("logit_", logit).drop(*COUNTS))
    p = 1 / (1 + F.exp(-F.col("logit_")))
    rows = scored.withColumn("doc_p", p).withColumn("host_", F.col(host)).withColumn("path_", F.col(path))
    if labels is None:
        rows = rows.withColumn("y_", F.lit(None).cast("double"))
    else:
        known = scratch.save(chosen_labels(labels, "quality", sample).select(F.col("doc_id").alias("id_"), F.col("target_").alias("y_")))
        rows = rows.join(F.broadcast(known), F.col("doc_id") == F.col("id_"), "left").drop("id_")  # at most ``sample`` rows
    rows = rows.withColumn("own_s", F.coalesce("y_", F.col("doc_p") * soft)).withColumn("own_n", F.when(F.col("y_").isNull(), soft).otherwise(1.0))
    sites = scratch.save(site_sums(rows.select("host_", "path_", "own_s", "own_n")))
    fitted = shrinking(sites)
    sites = sites.withColumnsRenamed({"host_": "of_host_", "path_": "of_path_"})
    same = F.col("host_").eqNullSafe(F.col("of_host_")) & F.col("path_").eqNullSafe(F.col("of_path_"))
    others = [F.greatest(F.col(c) - F.col(own), F.lit(0.0)) for c, own in (("s", "own_s"), ("n", "own_n"), ("host_s", "own_s"), ("host_n", "own_n"))]
    odds = lambda c: F.ln(c / (1 - c))
    site_p = F.greatest(F.least(fitted.posterior(*others), F.lit(1 - 1e-9)), F.lit(1e-9))
    total = F.col("logit_") + odds(F.col("site_p")) - odds(F.lit(fitted.mean))
    return (
        rows.join(sites, same, "left")
        .withColumn("site_p", site_p)
        .withColumn("quality_p", 1 / (1 + F.exp(-total)))
        .withColumn("kept", F.col("quality_p") >= 0.5)
        .drop("logit_", "y_", "host_", "path_", "own_s", "own_n", "s", "n", "host_s", "host_n", "of_host_", "of_path_")
    )
