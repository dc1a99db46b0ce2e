"""Chat perspectives and Hamming search: SQL twins, brute force and edge rows."""

import random

from chargelake.llm import queries as llm
from chargelake.llm.chat import rotate_perspectives
from chargelake.llm.hamming_topk import flips, hamming_neighbors, search_codes, segments_for

from ..oracle import assert_same

SF = "/root/testdata/sf0.001"


def test_queries_equal_sql(spark):
    for name, sql in llm.oracle_sql().items():
        assert_same(spark, llm.queries()[name], sql, SF)


def test_perspectives_edge_rows(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "hé\n"), (1, 2, "system", "rule"), (1, 3, None, None), (1, 3, "bob", ""), (1, 3, "bob", ""), (1, 600, "ann", "later"),
            (2, None, "eve", "x" * 100_000), (None, 0, "zoe", "y"), (3, 0, "system", "alone")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as segment", "1 as rendered", "2 as m")
    out = rotate_perspectives(turns)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["conv_id"], r["segment"], r["speaker"]): r for r in out.collect()}
    assert set(got) == {(1, 0, "ann"), (1, 0, "bob"), (2, 0, "eve"), (None, 0, "zoe")}
    ann, bob = got[1, 0, "ann"], got[1, 0, "bob"]
    assert ann["n_messages"] == 7 and ann["target_mask"] == "1000001" and bob["target_mask"] == "0100110"
    for r in got.values():
        spans = [tuple(map(int, s.split("-"))) for s in r["target_spans"].split(",") if s]
        assert len(spans) == r["n_targets"] == r["target_mask"].count("1")
        assert all(r["rendered"][: b].endswith("<|assistant|>\n") and r["rendered"][b:e].endswith("<|end|>\n") for b, e in spans)
    assert '<|user name="unknown"|>\n<|end|>' in ann["rendered"] and "<|system|>\nrule<|end|>" in ann["rendered"]
    assert rotate_perspectives(turns.filter("false")).count() == 0
    marks = spark.createDataFrame([(1, 0, 'a"<|b', "<|end|>\nx"), (1, 1, "c", "d")], "conv_id long, turn long, role string, text string")
    one = rotate_perspectives(marks).filter("speaker = 'c'").first()["rendered"]
    assert one.startswith('<|user name="a\\"<\\|b"|>\n<\\|end|>\nx<|end|>\n') and one.count("<|end|>") == 2


def test_long_dialogues_keep_every_message_and_the_system_message(spark):
    """Null turns, repeated rows and one turn number for all: segments are bounded and lose nothing."""
    rows = [(7, None if i % 3 == 0 else 5, "ann" if i % 2 else "bob", f"m{i % 400:03d}") for i in range(1000)] + [(7, None, None, "?"), (7, 4, "system", "be kind")]
    rows += [(8, i, "ann", f"t{i}") for i in range(5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = rotate_perspectives(turns, segment_messages=64).filter("speaker = 'ann'").orderBy("conv_id", "segment").collect()
    long = [r["rendered"] for r in got if r["conv_id"] == 7]
    assert len(got) == len(long) + 1 and len(long) == -(-len(rows[:1002]) // 64)
    order = sorted((x[1:] for x in rows if x[0] == 7), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "", x[2]))
    head = {"ann": "<|assistant|>", "system": "<|system|>", None: '<|user name="unknown"|>', "bob": '<|user name="bob"|>'}
    system = "<|system|>\nbe kind<|end|>\n"
    at = next(i for i, x in enumerate(order) if x[1] == "system")
    for n, text in enumerate(long):
        own = "".join(f"{head[r]}\n{t}<|end|>\n" for _, r, t in order[64 * n : 64 * n + 64])
        assert text == (system + own if at < 64 * n else own)


def brute(index, queries, k):
    out = []
    least = lambda rows: {i: min(c for j, c in rows if j == i) for i in dict(rows)}.items()  # of repeated ids the smallest code
    index, queries = least(index), least(queries)
    for q, c in sorted(set(queries)):
        near = sorted(((c ^ d) & (2**64 - 1)).bit_count() * 10**9 + i for i, d in set(index) if i != q)[:k]
        out += [(q, n + 1, x % 10**9, x // 10**9) for n, x in enumerate(near)]
    return out


def test_search_equals_brute_force(spark):
    rng = random.Random(5)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    common = signed(rng.getrandbits(64))
    index = [(i, common if i % 3 == 0 else signed(rng.getrandbits(64))) for i in range(240)] + [(7, common), (7, common)]
    index += [(300 + i, common ^ (1 << i)) for i in range(60)]
    queries = [index[0], index[1], index[50], (9999, 0), (-1, -1)]
    df = lambda rows: spark.createDataFrame(rows, "id long, code long")
    got = search_codes(df([*index, (None, 3), (500, None)]), df([*queries, (None, 1), (4, None)]), 5).collect()
    assert sorted(map(tuple, got)) == brute(index, queries, 5)
    few = index[:3]
    assert sorted(map(tuple, search_codes(df(few), df(few), 5).collect())) == brute(few, few, 5)
    few = [(1, 0), (2, 1), (3, -1), (3, 7), (3, 7)]
    assert sorted(map(tuple, search_codes(df(few), df([(99, 0), (2, 1)]), 5).collect())) == brute(few, [(99, 0), (2, 1)], 5)
    assert len(brute(few, [(99, 0)], 5)) == 3
    wide = [(i, signed(rng.getrandbits(64))) for i in range(3000)]
    outside = [(10_000 + i, signed(rng.getrandbits(64))) for i in range(8)]
    assert sorted(map(tuple, search_codes(df(wide), df(outside), 10).collect())) == brute(wide, outside, 10)
    assert [sum(w for _, w in segments_for(n)) for n in (0, 1, 300, 50_000, 10**6, 10**12)] == [64] * 6 and max(w for _, w in segments_for(10**12)) <= 22
    none = df([]).filter("false")
    assert search_codes(none, df(few), 5).count() == 0 and search_codes(df(few), none, 5).count() == 0


def test_vectors_edge_rows(spark):
    rows = [(0, [0.1, -0.2]), (50, [0.1, None]), (51, None), (52, []), (None, [1.0]), (53, [0.1, -0.2])]
    out = hamming_neighbors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as code"))
    assert sorted(map(tuple, out.collect())) == [(0, 1, 50, 0), (0, 2, 53, 0), (50, 1, 0, 0), (50, 2, 53, 0)]


def test_flips_of_two_widths(spark):
    got = sorted(tuple(r) for r in flips(spark, {3, 4}, 2).collect())
    assert got == [(w, f) for w in (3, 4) for f in range(1 << w) if f.bit_count() == 2]
