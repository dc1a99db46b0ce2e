"""The Katz model against a direct reading of its definition."""

import math
import zlib
from collections import Counter
from functools import cache

import pytest

from chargelake.llm.katz import HISTORY_EXTRA, discounts, score_katz


def tokens_of(text):
    return [*(text or "").encode().lower().split(), b""]


def grams_of(ts, order):
    """Of each token its history at every order: the first word's is the end of a text, which no longer history goes beyond."""
    padded = [b"", *ts]
    return [[(tuple(padded[max(0, i + 2 - k) : i + 1]), w) for k in range(1, order + 1) if i + 2 >= k] for i, w in enumerate(ts)]


def brute(rows, order):
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts, totals = [Counter() for _ in range(order + 1)], Counter()
    for i, t in rows:
        if not out(i):
            for grams in grams_of(tokens_of(t), order):
                for h, w in grams:
                    counts[len(h) + 1][h, w] += 1
                    totals[h] += 1
    words = Counter({w: c for ((), w), c in counts[1].items()})
    n, v = sum(words.values()), len(words)
    d = [None, *(discounts([sum(x == r for x in c.values()) for r in range(1, 7)]) for c in counts[1:])]
    star = lambda c, d: c * d[c] if c < len(d) else c
    unknown = 1 - sum(star(c, d[1]) for c in words.values()) / n if n else 1.0
    follow = {}
    for c in counts[2:]:
        for h, w in c:
            follow.setdefault(h, []).append(w)

    @cache
    def left(h):
        seen = sum(star(counts[len(h) + 1][h, w], d[len(h) + 1]) for w in follow[h]) / (totals[h] + HISTORY_EXTRA)
        return (1 - seen) / (1 - sum(p(h[1:], w) for w in follow[h]))

    def p(h, w):
        c = counts[len(h) + 1][h, w]
        if not h:
            return star(c, d[1]) / n if c else unknown
        if c:
            return star(c, d[len(h) + 1]) / (totals[h] + HISTORY_EXTRA)
        return (left(h) if totals[h] else 1) * p(h[1:], w)

    result = []
    for i, t in rows:
        ts = tokens_of(t)
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in ts)
        score = sum(math.log10(p(*grams[-1])) for grams in grams_of(ts, order))
        result.append((str(i), out(i), len(ts), sum(words[w] > 0 for w in ts), n, base, score))
    return sorted(result), p, words, follow


def check(docs, order=3, **options):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, p, words, follow = brute(rows, order)
    got = sorted((str(r[0]), *r[1:]) for r in score_katz(docs, order=order, **options).collect())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)
    return p, words, follow, got


def test_scores_equal_definition(table):
    p, words, follow, got = check(table("documents"), batch_tokens=3000)
    for h in [(), (b"",), (b"never seen",), *list(follow)[:5], *[h for h in follow if len(h) == 2][:5]]:
        assert sum(p(h, w) for w in [*words, b"\x00unknown"]) == pytest.approx(1)  # exactly: all known words and one unknown
    held = [g for g in got if g[1]]
    assert held and sum(g[6] for g in held) > sum(g[5] for g in held)  # better than the add-one unigram
    lower = [g for g in check(table("documents"), order=2, batch_tokens=50000)[3] if g[1]]
    assert sum(g[6] for g in held) > sum(g[6] for g in lower)  # and than the order below


@pytest.mark.parametrize("order", [1, 4])
def test_other_orders(table, order):
    check(table("documents").limit(60), order=order, batch_tokens=2000)


def test_edge_rows(docs_of):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A a B"), (4, "A a B"), (None, "a b"), (5, "é É a\x0bb\x1cc"), (9, "new words only"), (6, "x " * 5000)]
    check(docs_of(rows), batch_tokens=7)
    check(docs_of(rows).selectExpr("*", "1 as held_out", "2 as words", "3 as lengths"))
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    check(docs_of([(i, "nothing to learn from") for i in held[:3]]))
    assert score_katz(docs_of(rows).filter("false")).count() == 0
