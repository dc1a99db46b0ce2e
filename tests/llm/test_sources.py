"""Source divergence and importance resampling against brute force, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from chargelake.llm import divergence
from chargelake.llm.divergence import DIVERGENCE_SQL, source_divergence
from chargelake.llm.queries import queries
from chargelake.llm.resampling import features, importance_resampling

from ..oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, value string, rank string"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def diverged(docs):
    """docs: (text, lang, source); every kept term, pair and value spelled out."""
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))) for text, lang, source in docs]
    out = set()
    for lang in {w[0] for w in words}:
        df = Counter(t for la, _, w in words if la == lang for t in set(w))
        kept = sorted(t for t, k in df.items() if k >= 3)
        of = {s: Counter() for la, s, _ in words if la == lang}
        for la, s, w in words:
            if la == lang:
                of[s].update(w)
        whole = sum(of.values(), Counter())

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: shares(c) for s, c in of.items()}
        q = shares(whole)
        for s in of:
            pair = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in of if o != s]
            term = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", sorted(pair)), ("term", sorted(term)[:200])):
                out |= {(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(rows)}
    return out


def got(df):
    return {tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()}


def test_query_equals_sql(spark):
    assert_same(spark, queries()["op11_source_divergence"], DIVERGENCE_SQL, SF)


ROWS = [
    ("The cat, the Dog; 3dogs été É", "en", "a"), ("the cat THE cat", "en", "b"), ("the cat dog dog", "en", "c"), ("dog dog", "en", "a"), ("", "en", "d"), (None, "en", "e"),
    ("dog the zz", None, "x"), ("dog the", "", "y"), ("dog the", None, None), ("only once", "fr", "a"), ("twice", "fr", "b"), ("the cat", "en", "a"), ("the cat", "en", "a"),
]


@pytest.mark.parametrize("tile_terms, tile_sources, held", [(4096, 64, 200_000), (1, 1, 2), (2, 2, 1)])
def test_divergence_by_hand(spark, monkeypatch, tile_terms, tile_sources, held):
    """Also with tiles of one term and one source, and partial counts that are sent on at once."""
    monkeypatch.setattr(divergence, "TILE_TERMS", tile_terms)
    monkeypatch.setattr(divergence, "TILE_SOURCES", tile_sources)
    monkeypatch.setattr(divergence, "HELD", held)
    docs = spark.createDataFrame([(n, *r, "x", "y") for n, r in enumerate(ROWS)], SCHEMA)
    assert got(source_divergence(docs)) == diverged(ROWS)


def test_divergence_of_nothing_and_of_a_very_long_text(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert source_divergence(docs).count() == 0
    long = [("dog the zz " * 300_000, "en", "a"), ("dog the zz", "en", "b"), ("dog", "en", "c"), ("the zz", "en", "c")]
    assert got(source_divergence(spark.createDataFrame([(n, *r, "", "") for n, r in enumerate(long)], SCHEMA))) == diverged(long)


def drawn(docs, target, percent=25, least=20):
    """docs: (doc_id, text)."""

    def of(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        return w, [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(of(text)[1])
    for text in target:
        t.update(of(text)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000))))
    rows = []
    for i, text in docs:
        w, f = of(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    rank = {r[0]: k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return {(*r[:4], rank.get(r[0]) if r[4] >= least else None) for r in rows}


def rows_of(df):
    return {tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()}


def test_resampling_query_equals_brute_force(spark):
    c = connect(SF)
    docs, target = c.sql("select doc_id, text from documents").fetchall(), [r[0] for r in c.sql("select text from benchmark").fetchall()]
    assert rows_of(queries()["op12_importance_resampling"](spark, SF)) == drawn(docs, target)


def test_features_of_texts_cut_into_pieces(monkeypatch):
    texts = pa.array(["one two three " * 9, None, "Four", "five six " * 5, ""])
    whole = Counter((d, b, w) for part in features(texts, 10_000) for d, b, w in zip(*map(list, part), strict=True))
    monkeypatch.setattr("chargelake.llm.resampling.PIECE", 7)
    assert Counter((d, b, w) for part in features(texts, 10_000) for d, b, w in zip(*map(list, part), strict=True)) == whole


def test_resampling_edges(spark):
    """Nulls, separators at the ends, non-ASCII words, clashing further columns, ties and repeats."""
    texts = [None, "", " ,;", "Été 3x été", "word " * 25, "a b " * 40, " lead and Trail ", *(f"w{n} " * 30 for n in range(20)), "long tail of words " * 5000]
    docs = list(enumerate(texts)) + [(None, "x y " * 20)]
    schema = "doc_id long, text string, rank string, score string, weight int"
    frame = spark.createDataFrame([(*r, "p", "q", 1) for r in docs], schema)
    target = spark.createDataFrame([("word a b",), (None,)], "text string")
    assert rows_of(importance_resampling(frame, target)) == drawn(docs, ["word a b", None])
    assert importance_resampling(frame.limit(0), target).count() == 0
    assert importance_resampling(frame, target.limit(0)).filter("rank is not null").count() == 6
    same = spark.createDataFrame([(1, "one two " * 20, "", "", 0)] * 40, schema)
    ranks = [r[0] for r in importance_resampling(same, target).filter("rank is not null").select("rank").collect()]
    assert sorted(ranks) == list(range(1, 11))
