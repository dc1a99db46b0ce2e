"""Near-duplicate classes against all pairs."""

import random
from itertools import combinations

import numpy as np

from chargelake.llm.buckets import compared_blocks
from chargelake.llm.prob_minhash import Shingler, components, drop_near_duplicates, joined_labels, links_between, near_duplicates, prob_minhash, signatures, similarity
from chargelake.llm.util import Scratch


def brute_similarity(a, wa, b, wb):
    x, y = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    both = x.keys() & y.keys()
    p = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in both)
    return p, len(both) / len(x.keys() | y.keys())


def brute_classes(texts, threshold=0.8):
    """text -> smallest text of its class, from all pairs that share a shingle."""
    distinct = sorted({t for t in texts if t and t.lower().encode().split()})
    shingler = Shingler()
    sets = [shingler.of(t) for t in distinct]
    parent = list(range(len(distinct)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders: dict[int, list[int]] = {}
    for i, (s, _) in enumerate(sets):
        for x in s.tolist():
            holders.setdefault(x, []).append(i)
    for i, j in sorted({p for h in holders.values() for p in combinations(h, 2)}):
        if max(similarity(*sets[i], *sets[j])) >= threshold - 1e-9:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {t: distinct[root(i)] for i, t in enumerate(distinct)}


def want_of(rows):
    of = brute_classes([t for _, t in rows])
    least: dict[str, int] = {}
    for i, t in rows:
        if t in of and i is not None:
            least[of[t]] = min(i, least.get(of[t], i))
    return sorted((str(i), str(least.get(of[t])) if t in of else str(i)) for i, t in rows)


def test_similarity_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 30, 20)).astype(np.uint64) for _ in range(2))
        wa, wb = 1 + rng.random(len(a)) * 3, 1 + rng.random(len(b)) * 3
        assert np.allclose(similarity(a, wa, b, wb), brute_similarity(a, wa, b, wb))


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    b = np.concatenate([a[:45], rng.integers(0, 1 << 62, 15).astype(np.uint64)])
    wa, wb = 1 + rng.random(60) * 3, 1 + rng.random(60) * 3
    w = prob_minhash(np.concatenate([a, b]), np.concatenate([wa, wb]), np.repeat([0, 1], 60), 2, 4096)
    assert abs((w[0] == w[1]).mean() - brute_similarity(a, wa, b, wb)[0]) < 0.04


def test_components(spark):
    rng = random.Random(2)
    edges = [(bytes([a]), bytes([b])) for a, b in ((rng.randrange(90), rng.randrange(90)) for _ in range(60))]
    edges += [(bytes([i]), bytes([i + 1])) for i in range(100, 140)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {bytes(r["node"]): bytes(r["label"]) for r in components(spark.createDataFrame(edges, "a binary, b binary"), Scratch(spark)).collect()}
    assert got == {x: m for x, m in label.items() if x in got} and all(x in got for a, b in edges if a != b for x in (a, b))


def test_links_added_to_classes(spark):
    """Labels after each share of the links are those of all links at once; nodes without a class yet are added."""
    rnd = random.Random(7)
    edges = [(f"{rnd.randrange(300):03}".encode(), f"{rnd.randrange(300):03}".encode()) for _ in range(240)]
    frame = lambda some: spark.createDataFrame(some, "a binary, b binary")
    scratch = Scratch(spark)
    rows = lambda t: {bytes(r["node"]): bytes(r["label"]) for r in t.collect()}
    labels = scratch.save(components(frame(edges[:80]), scratch), "labels")
    for lo in (80, 160):
        labels = scratch.save(joined_labels(labels, frame(edges[lo : lo + 80]), scratch), "labels")
        assert rows(labels) == rows(components(frame(edges[: lo + 80]), scratch))
    assert rows(joined_labels(labels, frame(edges).limit(0), scratch)) == rows(labels)


def test_links_of_blocks_grow_with_the_group(spark):
    """A large bucket of which all sets are alike: its links grow as it does, not as its pairs, and join all of it."""
    made = {}
    for n in (100, 200):
        sets = [(bytes([i // 256, i % 256]), [*range(60), 100 + i], [1.0] * 61) for i in range(n)]
        sets = spark.createDataFrame(sets, "node binary, shingles array<long>, weights array<float>")
        scratch = Scratch(spark)
        members = scratch.save(sets.selectExpr("1L as key", "node", "61 as n", "node as label"))
        labels = members.select("node", "label")
        joined = lambda found: joined_labels(labels, found, scratch)  # noqa: B023, E731
        found = compared_blocks(members, sets, ["shingles", "weights"], lambda x, y: links_between(x, y, 0.8), joined, 10, 1 << 17, scratch)
        made[n] = found.count()
        assert joined(found).select("label").distinct().count() == 1
    assert made[100] <= 100 * 10 and made[200] < 2.5 * made[100]


def test_classes_equal_all_pairs(spark, table):
    docs = table("documents", "0.01")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in near_duplicates(docs).collect())
    want = want_of(rows)
    assert got == want
    assert len({c for _, c in want}) < len(rows)


def test_hot_groups_and_edge_rows(spark, docs_of):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(i, " ".join(base)) for i in range(40)]
    for i in range(40, 140):  # a large group of near copies, some of which are only linked through others
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    shared = " ".join(rng.choice(words) for _ in range(60))  # a passage in many otherwise different texts
    rows += [(i, shared + " " + " ".join(rng.choice(words) for _ in range(40))) for i in range(140, 200)]
    rows += [(207, " ".join(rng.choice(words) for _ in range(40_000)))]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "ONE"), (205, "two words"), (205, "two words"), (None, "two words"), (None, None), (None, "nobody has an id"), (206, " ".join(base * 50))]
    docs = docs_of(rows)
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in near_duplicates(docs, small_bucket=4, block=20).collect())
    assert got == want_of(rows)
    extra = docs.selectExpr("*", "1 as node", "'a' class_id", "2 as label", "3 as key", "4 as id_", "5 as node_", "6 as node_of", "7 as of_id", "8 as of_node")
    assert near_duplicates(extra, small_bucket=4, cheap_rounds=0, block=16).count() == len(rows)
    kept = drop_near_duplicates(extra).collect()
    assert set(kept[0].asDict()) == set(extra.columns)
    of = brute_classes([t for _, t in rows])
    with_words = [r["text"] for r in kept if r["text"] in of]
    assert len(with_words) == len({of[t] for t in with_words}) == len(set(of.values()))
    assert sum(r["text"] not in of for r in kept) == sum(t not in of for _, t in rows)
    assert near_duplicates(docs.filter("false")).count() == 0 and drop_near_duplicates(docs.filter("false")).count() == 0


def test_links_hold_classes_together(spark, table):
    """Links are verified pairs: as many as the counts say, and without other links every class is connected."""
    rows = near_duplicates(table("documents", "0.01")).collect()
    text = {r["doc_id"]: r["text"] for r in table("documents", "0.01").collect()}
    shingler = Shingler()
    size = {}
    for r in rows:
        size.setdefault(r["class_id"], set()).add(bytes(r["node"] or b""))
    for r in rows:
        assert (r["n_links"] > 0) == (r["link_id"] is not None) == (len(size[r["class_id"]]) > 1)
        if r["link_id"] is not None:
            assert max(similarity(*shingler.of(text[r["doc_id"]]), *shingler.of(text[r["link_id"]]))) >= 0.8 - 1e-6


def test_texts_alike_as_sets_meet(spark, docs_of):
    """Half of the second text is said 50 times: set Jaccard near 1, probability Jaccard well below the threshold."""
    rng = random.Random(4)
    rows = []
    for n in range(20):
        half = [[f"t{n}w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(2)]
        rows += [(2 * n, " ".join(half[0] + half[1])), (2 * n + 1, " ".join(half[0] + half[1] * 50))]
    keys = {r["doc_id"]: set(r["bands"]) for r in signatures(docs_of(rows), 32, 5, 5).collect()}
    assert all(keys[2 * n] & keys[2 * n + 1] for n in range(20)) and len(keys[1]) > len(keys[0]) == 32
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in near_duplicates(docs_of(rows)).collect())
    assert got == want_of(rows) and len({c for _, c in got}) == 20


def test_blocks_join_members_once(spark):
    """Rows of a large bucket are read for their order and for the pairs of blocks, not again for each comparison."""
    n, read = 60, spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    sets = [(bytes([i]), [*range(60), 100 + i], [1.0] * 61) for i in range(n)]
    sets = spark.createDataFrame(sets, "node binary, shingles array<long>, weights array<float>")
    scratch = Scratch(spark)
    members = scratch.save(sets.selectExpr("1L as key", "node", "61 as n", "node as label"))
    labels = members.select("node", "label")
    seen = members.mapInArrow(counted, members.schema)
    found = compared_blocks(seen, sets, ["shingles", "weights"], lambda x, y: links_between(x, y, 0.8), lambda f: joined_labels(labels, f, scratch), 10, 1 << 17, scratch)
    assert joined_labels(labels, found, scratch).select("label").distinct().count() == 1
    # a sort by ranges reads its rows once more, for their quantiles
    assert read.value <= 3 * n


def test_stars_need_no_step(spark):
    scratch = Scratch(spark)
    edges = spark.createDataFrame([(i, i % 3) for i in range(3, 30)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges, scratch).collect()}
    assert got == {i: i % 3 for i in range(30)}
    assert len(scratch.folders["edges"]) == 1
    assert components(edges.limit(0), scratch).count() == 0
