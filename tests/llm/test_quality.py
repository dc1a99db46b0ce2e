"""Quality, rules and toxicity: against brute force, on held-out labels and on edge rows."""

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from chargelake.llm.decision_list import FEATURES, fit_rules, learn_rules, matches, quality_rules, rules_column
from chargelake.llm.quality_eb import INPUTS, fit_evidence, host_of, path_of, quality_scores
from chargelake.llm.queries import op5_toxicity, op6_quality, op10_quality_rules
from chargelake.llm.textstats import COUNTS, counts_of
from chargelake.llm.toxicity import BlockMaxIndex, fit_toxicity, score_toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(1, None), (2, ""), (3, " \n\n"), (4, "a b a b a b a b"), (5, "x"), (5, "x"), (None, "no id"), (6, "#$%&|<>* " * 100), (7, "\x1cé\x85 word\n\nword\nword"), (8, "w " * 20000)]


def brute_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + d for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered)


def test_counts_equal_brute_force(spark, table, docs_of):
    for docs in (table("documents"), docs_of(EDGE)):
        rows = quality_rules(docs, [], keep_text=True).collect()
        for r in rows:
            want = brute_counts(r["text"])
            assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert r["kept"] == (not r["base_failed"])


def test_rules_are_learned_pruned_and_evaluated_in_order(spark, table):
    rng = np.random.default_rng(0)
    values = {f: rng.random(3000) for f in FEATURES}
    bad = (values["symbol_share"] > 0.8) | (values["upper_share"] > 0.9) & (values["words"] < 0.5)
    rules = learn_rules(values, bad)
    fired = np.zeros(3000, bool)
    for rule in rules:
        fired |= matches(rule, values, 3000)
    assert (fired == bad).mean() > 0.97 and learn_rules(values, np.zeros(3000, bool)) == []
    docs, labels = table("documents", "0.01"), table("labels", "0.01")
    found = fit_rules(docs, labels)
    rows = quality_rules(docs, found).withColumn("again", rules_column(found)).join(labels, "doc_id").toPandas()
    first = np.full(len(rows), np.nan)
    stats = {"words": rows.n_words.astype(float), "word_length": rows.word_chars / rows.n_words.clip(lower=1), "symbol_share": rows.n_symbols / rows.word_chars.clip(lower=1),
             "dup_line_share": rows.n_dup_lines / rows.n_lines.clip(lower=1), "repeat_share": rows.n_repeat_words / rows.n_words.clip(lower=1),
             "upper_share": rows.n_upper / rows.word_chars.clip(lower=1), "digit_share": rows.n_digits / rows.word_chars.clip(lower=1), "exclaim_share": rows.n_exclaim / rows.word_chars.clip(lower=1)}
    for n in reversed(range(len(found))):
        first[matches(found[n], {f: v.to_numpy(float) for f, v in stats.items()}, len(rows))] = n
    assert np.array_equal(first, rows.rule.to_numpy(float), equal_nan=True)


def held_out(df, mod=5):
    return df[[zlib.crc32(str(i).encode()) % mod == 0 for i in df.doc_id]]


def test_rules_on_held_out_labels(spark, table):
    """Rules learned without a fifth of the labels, judged on that fifth."""
    docs, labels = table("documents", "0.1"), table("labels", "0.1")
    found = fit_rules(docs, labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    rows = held_out(quality_rules(docs, found).join(labels, "doc_id").toPandas())
    good, bad = rows[(rows.quality == 1) & ~rows.base_failed], rows[rows.quality == 0]
    assert len(found) and good.kept.mean() > 0.97 and bad.kept.mean() < 0.15


def test_rules_edge_rows(spark, table, docs_of):
    docs = docs_of(EDGE).selectExpr("*", "1 as n_words", "true as kept")
    none = table("labels").filter("false")
    rules = fit_rules(docs, none)
    assert rules == [] and quality_rules(docs, rules).count() == len(EDGE)
    assert {"in_n_words", "in_kept"} <= set(quality_rules(docs, rules).columns)
    assert quality_rules(docs.filter("false"), rules).count() == 0
    assert op10_quality_rules(spark, "/root/testdata/sf0.001").count() == table("documents").count()


def brute_quality(docs, labels, evidence):
    """doc_p, site_p and quality_p of (doc_id, text, host, path) rows, straight from the definition."""
    y = {i: float(q) for i, q in labels if i is not None and q in (0, 1)}
    logits, owns = [], []
    for i, text, _, _ in docs:
        n = dict(zip(COUNTS, counts_of(text or ""))) | {"greatest": max, "sqrt": np.sqrt, "ln": np.log, "cast": float}
        values = [eval(re.sub(r"cast\((\w+) as double\)", r"float(\1)", e), {}, n) for e in INPUTS.values()]
        logits.append(max(min(float(np.dot(values, evidence.weights)) + evidence.bias, 30.0), -30.0))
        owns.append((y[i], 1.0) if i in y else (0.1 / (1 + np.exp(-logits[-1])), 0.1))
    add = lambda key: {k: np.sum([o for o, d in zip(owns, docs) if key(d) == k], axis=0) for k in {key(d) for d in docs}}
    path, host = add(lambda d: d[2:]), add(lambda d: d[2])
    total = np.sum(list(host.values()), axis=0)
    m = total[0] / total[1]
    v_host = sum(n * (s / n) ** 2 for s, n in host.values()) / total[1] - m * m - m * (1 - m) * (len(host) - 1) / total[1]
    off = lambda k: path[k][0] / path[k][1] - host[k[0]][0] / host[k[0]][1]
    v_path = sum(path[k][1] * off(k) ** 2 for k in path) / total[1] - m * (1 - m) * (len(path) - len(host)) / total[1]
    size = lambda v: min(max(m * (1 - m) / max(v, 1e-6) - 1, 1.0), 1e4)
    out = []
    for d, logit, own in zip(docs, logits, owns):
        hs, hn = host[d[2]] - own
        ps, pn = path[d[2:]] - own
        p_host = (m * size(v_host) + hs) / (size(v_host) + hn)
        site = (p_host * size(v_path) + ps) / (size(v_path) + pn)
        odds = lambda p: np.log(p / (1 - p))
        out.append((1 / (1 + np.exp(-logit)), site, 1 / (1 + np.exp(-(logit + odds(site) - odds(m))))))
    return out


def test_quality_equals_brute_force(spark, table, docs_of):
    docs, labels = table("documents"), table("labels")
    evidence = fit_evidence(docs, labels)
    rows = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in docs.collect()]
    want = brute_quality(rows, [(r["doc_id"], r["quality"]) for r in labels.collect()], evidence)
    got = {r["doc_id"]: r for r in op6_quality(spark, "/root/testdata/sf0.001").collect()}
    for (i, *_), w in zip(rows, want):
        assert np.allclose((got[i]["doc_p"], got[i]["site_p"], got[i]["quality_p"]), w, atol=1e-9) and got[i]["kept"] == (w[2] >= 0.5)


def test_quality_on_held_out_labels(spark, table):
    """Fitted without a fifth of the labels, judged on that fifth: the sites don't harm, the text decides."""
    docs, labels = table("documents", "0.1"), table("labels", "0.1")
    train = labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    rows = held_out(quality_scores(docs, fit_evidence(docs, train), train).join(labels, "doc_id").toPandas())
    assert rows[rows.quality == 1].kept.mean() > 0.97 and rows[rows.quality == 0].kept.mean() < 0.25
    loss = lambda p: -np.log(np.where(rows.quality == 1, p, 1 - p).clip(1e-9)).mean()
    assert loss(rows.quality_p) < loss(rows.doc_p) + 0.01


def test_sites_decide_where_the_text_cannot(spark):
    """Equal texts: the labels of a host and of its paths tell them apart, sparse paths follow their host, no document votes for itself."""
    text, rows, labels = " ".join(f"w{i}" for i in range(100)), [], []
    for n, (host, path, good) in enumerate([("a", "x", 0.95), ("a", "y", 0.9), ("b", "x", 0.05), ("b", "y", 0.1)] * 100):
        rows.append((n, text, path, host, len(text)))
        labels.append((n, int(n // 4 % 20 < 20 * good), 0))
    rows += [(1000, text, "new", "b", 1), (1001, text, "new", "a", 1), (1002, text, "x", "c", 1), (1003, text, None, None, 1)]
    labels += [(1002, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_scores(docs, fit_evidence(docs, labels), labels).collect()}
    assert got[0]["kept"] and not got[2]["kept"] and got[0]["quality_p"] > got[1]["quality_p"] > 0.7
    assert not got[1000]["kept"] and got[1001]["kept"] and 0.3 < got[1002]["site_p"] < 0.7  # its own label 0 doesn't count
    assert abs(got[1003]["site_p"] - 0.5) < 0.1 and len({round(r["doc_p"], 9) for r in got.values()}) == 1


def test_hosts_and_paths_of_urls(spark, table):
    urls = ["HTTPS://User@Example.COM:80/Fr/1?x", "http://a.b", "http://a.b/?q=/c", "no url", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"))
    assert [(r["h"], r["p"]) for r in df.collect()] == [("example.com", "Fr"), ("a.b", ""), ("a.b", ""), ("", ""), (None, None)]
    pages = table("pages").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    assert pages.filter("host = '' or host is null").count() == 0 and pages.select("path").distinct().count() < 20


def test_quality_edge_rows(spark, table, docs_of):
    docs = docs_of(EDGE).selectExpr("*", "0.5 as quality_p", "1 as site_p", "2 as host_", "3 as path_", "4 as own_s", "5 as y_", "6 as s").withColumnRenamed("n_chars", "n_words")
    e = fit_evidence(docs, table("labels").filter("false"))
    assert e.prior == 0.5
    for labels in (None, table("labels"), table("labels").filter("false")):
        out = quality_scores(docs, e, labels, keep_text=True)
        assert out.count() == len(EDGE) and {"in_quality_p", "in_site_p", "in_n_words", "in_host_", "in_s", "text"} <= set(out.columns)
        assert all(0 < r["site_p"] < 1 for r in out.collect())
        assert quality_scores(docs.filter("false"), e, labels).count() == 0


def test_block_max_index_is_exact():
    rng = np.random.default_rng(1)

    def unit(terms):
        w = rng.integers(1, 4, len(terms)).astype(float)
        return np.sort(terms), w / np.sqrt(w @ w)

    vectors = [unit(rng.choice(40, rng.integers(1, 6), replace=False)) for _ in range(700)]
    queries = [unit(rng.choice(40, rng.integers(1, 5), replace=False)) for _ in range(100)]
    dense = np.zeros((700, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for share in (0.0, 0.12, 1.0):  # all, some and none of the terms in the matrix
        index = BlockMaxIndex(vectors, 40, block=16, dense=share)
        for k in (1, 10, 699, 700, 900):
            for (t, w), (got, cosines) in zip(queries, index.nearest(queries, k)):
                score = dense[:, t] @ w
                want = np.lexsort((np.arange(700), -np.round(score, 10)))[:k]
                want = [i for i in want if score[i] > 1e-12]
                assert got.tolist() == want and np.allclose(cosines, score[want])


def brute_toxicity(docs, labels, k=16):
    """Scores and evidence of (doc_id, text) rows by all cosines of plain dictionaries."""
    y = {i: float(t) for i, t in labels if zlib.crc32(str(i).encode()) % 5}
    bags = [Counter(re.findall(r"\w+", (t or "").lower())) for _, t in docs]
    train = sorted((i, n) for n, (i, _) in enumerate(docs) if i in y)
    df, bad, good = Counter(), Counter(), Counter()
    for b in bags:
        df.update(set(b))
    for i, n in train:
        (bad if y[i] else good).update(set(bags[n]))
    p = (sum(y[i] for i, _ in train) + 0.5) / (len(train) + 1)
    idf = {t: np.log((1 + len(docs)) / (1 + df[t])) + 1 for t in bad | good}

    def vector(bag, off=None):
        w = {}
        for t, n in bag.items():
            if t in idf:
                b, g = bad[t] - (off == 1), good[t] - (off == 0)
                w[t] = (1 + np.log(n)) * idf[t] * (0.1 + abs(np.log((b + 20 * p) / (g + 20 * (1 - p)) * (1 - p) / p)))
        norm = np.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()} if norm else {}

    examples = [(i, y[i], vector(bags[n])) for i, n in train]
    # examples with the same heaviest term come together, in the order in which the terms first occur
    first = {t: n for n, t in enumerate(dict.fromkeys(t for _, n in train for t in bags[n]))}
    heaviest = [max(v, key=lambda t: (round(v[t], 12), -first[t])) if v else "" for _, _, v in examples]
    examples = [examples[n] for n in sorted(range(len(examples)), key=lambda n: (first.get(heaviest[n], -1), n))]

    def vote(v, leave_out=None):
        cosines = [(round(sum(x * e.get(t, 0.0) for t, x in v.items()), 10), -n) for n, (i, _, e) in enumerate(examples) if i != leave_out]
        near = [c for c in sorted(cosines, reverse=True)[:k] if c[0] > 1e-12]
        return (sum(c * examples[-n][1] for c, n in near) + p) / (sum(c for c, _ in near) + 1), [examples[-n][0] for _, n in near[:5]]

    x = np.array([np.log(v / (1 - v)) for v in (vote(vector(bags[n], y[i]), i)[0] for i, n in train)])
    x, ys, w = np.column_stack([x, np.ones(len(x))]), np.array([y[i] for i, _ in train]), np.array([1.0, 0.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-(x @ w)))
        w = w + np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.eye(2), x.T @ (ys - q) - (w - [1.0, 0.0]))
    out = []
    for b in bags:
        v, near = vote(vector(b))
        out.append((1 / (1 + np.exp(-(w[0] * np.log(v / (1 - v)) + w[1]))), near))
    return out


def test_toxicity_query_equals_brute_force(spark, table):
    rows = [(r["doc_id"], r["text"]) for r in table("documents").collect()]
    labels = [(r["doc_id"], r["toxic"]) for r in table("labels").collect()]
    got = {r["doc_id"]: r for r in op5_toxicity(spark, "/root/testdata/sf0.001").collect()}
    for (i, _), (score, near) in zip(rows, brute_toxicity(rows, labels)):
        assert abs(got[i]["score"] - score) < 1e-6 and set(got[i]["evidence"]) == set(near)
        assert got[i]["predicted"] == (got[i]["score"] >= 0.5) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert len({round(r["score"], 9) for r in got.values()}) > 0.5 * len(rows)


def test_toxicity_on_held_out_labels(spark, table):
    docs, labels = table("documents", "0.1").select("doc_id", "text"), table("labels", "0.1")
    rows = held_out(score_toxicity(docs, fit_toxicity(docs, labels)).join(labels, "doc_id").toPandas())
    toxic, clean = rows[rows.toxic == 1], rows[rows.toxic == 0]
    assert toxic.predicted.mean() > 0.85 and clean.predicted.mean() < 0.01
    assert abs(rows.score.mean() - rows.toxic.mean()) < 0.03 and rows.score.between(0, 1).all()
    assert all(len(e) for e in toxic[toxic.predicted == 1].evidence)


def test_toxicity_edge_rows(spark, table, docs_of):
    docs = docs_of(EDGE).selectExpr("*", "1 as score", "'a' as evidence")
    labels = spark.createDataFrame([(4, 1, 1), (6, 1, 0), (8, 0, 1), (5, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.filter("false")):
        out = score_toxicity(docs, fit_toxicity(docs, some))
        rows = out.collect()
        assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
        assert {"in_score", "in_evidence"} <= set(out.columns)
    assert score_toxicity(docs.filter("false"), fit_toxicity(docs.filter("false"), labels)).count() == 0
