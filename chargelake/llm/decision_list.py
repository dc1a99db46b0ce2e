"""Quality rules learned as an ordered list of threshold conjunctions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textstats import COUNTS, text_statistics
from .util import labelled_sample, with_columns_last

#: Ratios of whole-text counts, as Spark expressions; the rules' vocabulary.
FEATURES: dict[str, str] = {
    "words": "cast(n_words as double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "exclaim_share": "n_exclaim / greatest(word_chars, 1)",
}


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def of(self, values: dict[str, np.ndarray]) -> np.ndarray:
        v = values[self.feature]
        return v > self.threshold if self.above else v <= self.threshold

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Test, ...]


def matches(rule: Rule, values: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for test in rule:
        out &= test.of(values)
    return out


def grow(values: dict[str, np.ndarray], bad: np.ndarray, thresholds: dict[str, np.ndarray], most: int) -> Rule:
    """Add the test with the largest information gain until no good document is covered."""
    rule: Rule = ()
    covered = np.ones(len(bad), bool)
    while len(rule) < most:
        p0, n0 = bad[covered].sum(), (~bad[covered]).sum()
        if not n0 or not p0:
            break
        now, best, found = np.log2(p0 / (p0 + n0)), 1e-9, None
        for feature, cuts in thresholds.items():
            v, b = values[feature][covered], bad[covered]
            order = np.argsort(v, kind="stable")
            at = np.searchsorted(v[order], cuts, side="right")
            below_p = np.concatenate([[0], np.cumsum(b[order])])[at]
            below_n = at - below_p
            for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - now), 0)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, found = gain[k], Test(feature, above, float(cuts[k]))
        if found is None:
            break
        v = values[found.feature][covered]  # the cut goes to the middle of the gap it lies in
        low, high = v[v <= found.threshold], v[v > found.threshold]
        if len(low) and len(high):
            found = Test(found.feature, found.above, float((low.max() + high.min()) / 2))
        rule += (found,)
        covered &= found.of(values)
    return rule


def prune(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop last tests while that raises (bad - good) / covered on rows the rule wasn't grown on."""

    def worth(r: Rule) -> float:
        m = matches(r, values, len(bad))
        p, n = int(bad[m].sum()), int((~bad[m]).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for length in range(len(rule) - 1, 0, -1):
        if worth(rule[:length]) >= worth(best):
            best = rule[:length]
    return best


def learn_rules(
    values: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, most_rules: int = 12, most_tests: int = 3, cuts: int = 64, most_failures: int = 4
) -> list[Rule]:
    """Sequential covering: each rule rejects documents, and the next is learned on what is left.

    Two thirds of the rows grow a rule, the others prune it and must agree to ``precision``.  Where they don't, the bad
    rows that the rule was grown on are set aside, and another rule is tried, ``most_failures`` times.
    """
    third = np.arange(len(bad)) % 3 == 2
    left, rules, failures = np.ones(len(bad), bool), [], 0
    part = lambda m: {f: v[m] for f, v in values.items()}
    thresholds = {f: np.unique(np.quantile(v, np.linspace(0.0, 1.0, cuts + 1))) for f, v in values.items()} if len(bad) else {}
    while len(rules) < most_rules and bad[left & ~third].any() and bad[left & third].any():
        rule = grow(part(left & ~third), bad[left & ~third], thresholds, most_tests)
        if not rule:
            break
        rule = prune(rule, part(left & third), bad[left & third])
        m = matches(rule, part(left & third), int((left & third).sum()))
        hits = bad[left & third][m]
        if not len(hits) or hits.mean() < precision:
            failures += 1
            if failures > most_failures:
                break
            left &= ~(matches(rule, values, len(bad)) & bad & ~third)
            continue
        rules.append(rule)
        left &= ~matches(rule, values, len(bad))
    return rules


def rules_column(rules: list[Rule]) -> Column:
    """The number of the first rule that fits (from 0), or null: one conditional expression in order."""
    out: Column | None = None
    for n, rule in enumerate(rules):
        test = F.expr(" and ".join(t.sql() for t in rule))
        out = F.when(test, F.lit(n)) if out is None else out.when(test, F.lit(n))
    return F.lit(None).cast("int") if out is None else out


def fit_rules(docs: DataFrame, labels: DataFrame, sample: int = 20_000, **options) -> list[Rule]:
    """Rules from the statistics of at most ``sample`` labelled documents (``quality`` 0: bad).

    One document for each labelled id, however many rows it has (``labelled_sample``).  No labels, or no bad ones: no rules.
    """
    found = text_statistics(labelled_sample(docs, labels, "quality", sample))
    rows = found.select("doc_id", (F.col("target_") == 0).alias("bad"), *(F.expr(e).alias(f) for f, e in FEATURES.items())).toPandas()
    rows = rows.sort_values(list(rows.columns), ignore_index=True)
    return learn_rules({f: rows[f].to_numpy(float) for f in FEATURES}, rows["bad"].to_numpy(bool), **options)


def quality_rules(docs: DataFrame, rules: list[Rule], keep_text: bool = False) -> DataFrame:
    """``docs`` with whole-text counts, ``base_failed``, ``rule`` (the first that fits) and ``kept``.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows.  kept: neither
    base_failed nor rejected by a rule.  Null or empty text: no words, base_failed.  Null ids, repeated rows and ties: each
    row by itself.  Very long texts are counted whole, one at a time.  Empty table: no rows.  Input columns named like a result are renamed ``in_<name>``.  No shuffle.
    """
    added = [*COUNTS, "base_failed", "rule", "kept"]
    found = text_statistics(with_columns_last(docs, added), keep_text=keep_text)
    return (
        found.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
        .withColumn("rule", rules_column(rules))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )
