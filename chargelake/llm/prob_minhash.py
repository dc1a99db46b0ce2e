"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import compared_blocks
from .util import Scratch, bounded_batches

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of word windows with weights 1 + ln(count).  Words: runs between space and \\x09-\\x0D, in lower case."""

    def __init__(self, words: int = 5, limit: int = 4_000_000):
        self.words, self.limit, self.known, self.held = words, limit, {}, 0

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """A text with fewer words than a window is one shingle; one without words has none."""
        shingles, counts = np.unique(self.windows((text or "").lower().encode().split()), return_counts=True)
        return shingles, 1 + np.log(counts)

    def windows(self, found: list[bytes]) -> np.ndarray:
        """Hashes of all windows of the words, repeats included."""
        if not found:
            return np.zeros(0, np.uint64)
        if self.held > self.limit:  # bytes of remembered words
            self.known.clear()
            self.held = 0
        known, hashed = self.known, xxhash.xxh3_64_intdigest
        try:
            ids = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        except KeyError:
            for w in found:
                if w not in known:
                    known[w] = hashed(w)
                    self.held += len(w)
            ids = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        size = min(self.words, len(ids))
        windows = np.zeros(len(ids) - size + 1, np.uint64)
        for k in range(size):
            windows = mixed(windows + ids[k : len(ids) - size + 1 + k] * GOLDEN + np.uint64(k + 1))
        return windows


def prob_minhash(shingles: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """The winning shingle of every register of every document (n_docs x registers).

    Each shingle of weight w sends points at the times of a Poisson process of rate w, each to a
    random register; the first point in a register wins.  Two documents agree in a register with the probability
    Jaccard of their weights.  All points come from hashes of the shingle, and a shingle stops once its next
    point is later than the latest first point of its document.
    """
    time = np.full(n_docs * registers, np.inf)
    winner = np.zeros(n_docs * registers, np.uint64)
    latest = np.full(n_docs, np.inf)
    live, clock, step = np.arange(len(shingles)), np.zeros(len(shingles)), 0
    while len(live):
        step += 1
        random = mixed(shingles[live] + np.array([step], np.uint64) * GOLDEN)
        clock = clock - np.log(((random >> np.uint64(11)).astype(np.float64) + 1) / float(1 << 53)) / weights[live]
        ok = clock <= latest[doc[live]]
        live, clock, random = live[ok], clock[ok], random[ok]
        at = doc[live] * registers + (mixed(random ^ GOLDEN) % np.uint64(registers)).astype(np.int64)
        better = clock < time[at]
        order = np.argsort(-clock[better], kind="stable")  # the earliest is written last
        target = at[better][order]
        time[target] = clock[better][order]
        winner[target] = shingles[live[better][order]]
        latest = time.reshape(n_docs, registers).max(axis=1)
    return winner.reshape(n_docs, registers)


def band_keys(winner: np.ndarray, bands: int) -> np.ndarray:
    n, registers = winner.shape
    rows = registers // bands
    keys = np.tile(np.arange(bands, dtype=np.uint64) * GOLDEN, (n, 1))
    for r in range(rows):
        keys = mixed(keys + winner[:, r::rows][:, :bands] * GOLDEN + np.uint64(r + 1))
    return keys.view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """``doc_id, node, bands``: node is the md5 of the whole text (null without words), bands its keys.

    A text that repeats shingles has its keys twice, by their weights and with equal ones: so texts that are alike by their
    probability Jaccard meet, and those that are alike as sets.  For all others both are the same.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [shingler.of(s) for s in part.column("text").to_pylist()]
                doc = np.repeat(np.arange(len(found)), [len(s) for s, _ in found])
                shingles, weights = (np.concatenate(x) for x in zip(*found, strict=True))
                keys = list(band_keys(prob_minhash(shingles, weights, doc, len(found), bands * rows), bands))
                again = [n for n, (_, w) in enumerate(found) if (w > 1).any()]
                if again:
                    sets = [found[n][0] for n in again]
                    doc = np.repeat(np.arange(len(sets)), list(map(len, sets)))
                    shingles = np.concatenate(sets)
                    equal = band_keys(prob_minhash(shingles, np.ones(len(shingles)), doc, len(sets), bands * rows), bands)
                    for n, more in zip(again, equal, strict=True):
                        keys[n] = np.union1d(keys[n], more)
                has = np.array([len(s) > 0 for s, _ in found])
                flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys)))
                node = part.column("node").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([x if h else None for x, h in zip(node, has, strict=True)], pa.binary()), flat],
                    ["doc_id", "node", "bands"],
                )

    keyed = docs.select("doc_id", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"))
    return keyed.mapInArrow(signed, keyed.select("doc_id", "node").schema.add("bands", T.ArrayType(T.LongType())))


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> tuple[float, float]:
    """Exact probability Jaccard of the weights, and Jaccard of the shingle sets.

    Probability Jaccard: the sum over common shingles i of 1 / sum over all j of max(a_j / a_i, b_j / b_i).
    """
    common, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    union = len(a) + len(b) - len(common)
    if not len(common):
        return 0.0, 0.0
    x, y = wa[ia], wb[ib]
    # for i, the maximum is a_j / a_i where a_j / b_j >= a_i / b_i: sorted by that ratio, prefix sums give the inner sum
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    r, x, y = ratio[order], x[order], y[order]
    below_y = np.concatenate([[0], np.cumsum(y)])
    above_x = np.concatenate([np.cumsum(x[::-1])[::-1], [0]])
    at = np.searchsorted(r, r, side="left")
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    inner = (above_x[at] + only_a) / x + (below_y[at] + only_b) / y
    return float((1 / inner).sum()), len(common) / union


def shingle_table(docs: DataFrame, words: int) -> DataFrame:
    """``node, shingles, weights`` (single precision) of documents with ``node``."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            found = [shingler.of(s) for s in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([s.view(np.int64) for s, _ in found], pa.list_(pa.int64())), pa.array([w.astype(np.float32) for _, w in found], pa.list_(pa.float32()))],
                ["node", "shingles", "weights"],
            )

    return docs.select("node", "text").mapInArrow(shingled, "node binary, shingles array<long>, weights array<float>")


def verified(pairs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose similarity reaches the threshold."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            columns = (batch.column(c) for c in ("sa", "wa", "sb", "wb"))
            for sa, wa, sb, wb in zip(*columns, strict=True):
                sets = [x.values.to_numpy().view(np.uint64) if n % 2 == 0 else x.values.to_numpy().astype(float) for n, x in enumerate((sa, wa, sb, wb))]
                keep.append(max(similarity(*sets)) >= threshold - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda side: shingles.select(F.col("node").alias(side), F.col("shingles").alias(f"s{side}"), F.col("weights").alias(f"w{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(checked, "a binary, b binary")


def links_between(a: list[dict], b: list[dict], threshold: float) -> list[tuple[bytes, bytes]]:
    """A link for every two classes (``label``) of two blocks of nodes that have one between them."""
    side = lambda rows: (
        np.concatenate([np.asarray(r["shingles"], dtype=np.int64) for r in rows]), np.concatenate([np.asarray(r["weights"], dtype=float) for r in rows]),
        np.repeat(np.arange(len(rows)), [len(r["shingles"]) for r in rows]),
    )
    (xs, xw, xi), (ys, yw, yi) = side(a), side(b)
    common = np.intersect1d(xs, ys)
    number = {r["label"]: n for n, r in enumerate({r["label"]: r for r in [*a, *b]}.values())}
    la, lb = np.array([number[r["label"]] for r in a]), np.array([number[r["label"]] for r in b])
    overlap, share_a, share_b = (np.zeros((len(a), len(b)), np.float32) for _ in range(3))
    for lo in range(0, len(common), 8192):  # a part of the shingles at a time
        part = common[lo : lo + 8192]
        grids = []
        for s, w, i, n in ((xs, xw, xi, len(a)), (ys, yw, yi, len(b))):
            at = np.minimum(np.searchsorted(part, s), len(part) - 1)
            hit = part[at] == s
            has, weighed = np.zeros((n, len(part)), np.float32), np.zeros((n, len(part)), np.float32)
            has[i[hit], at[hit]], weighed[i[hit], at[hit]] = 1, w[hit]
            grids.append((has, weighed))
        (ha, wa), (hb, wb) = grids
        overlap += ha @ hb.T
        share_a += wa @ hb.T
        share_b += ha @ wb.T
    size_a, size_b = (np.bincount(i, minlength=n).astype(np.float32) for i, n in ((xi, len(a)), (yi, len(b))))
    total_a, total_b = (np.bincount(i, weights=w, minlength=n).astype(np.float32) for i, w, n in ((xi, xw, len(a)), (yi, yw, len(b))))
    jaccard = overlap / (size_a[:, None] + size_b[None, :] - overlap)
    # probability Jaccard is at most the share of either side's weight in common; with equal weights it is the Jaccard
    flat_a, flat_b = total_a <= size_a + 1e-4, total_b <= size_b + 1e-4
    bound = np.minimum(share_a / total_a[:, None], share_b / total_b[None, :])
    maybe = (jaccard >= threshold - 1e-6) | (bound >= threshold - 1e-6) & ~(flat_a[:, None] & flat_b[None, :])
    maybe &= la[:, None] != lb[None, :]
    found: dict[tuple[int, int], tuple[bytes, bytes]] = {}
    for i, j in np.argwhere(maybe):
        pair = (min(la[i], lb[j]), max(la[i], lb[j]))
        if pair not in found:
            sets = [np.asarray(a[i]["shingles"]).view(np.uint64), np.asarray(a[i]["weights"], float), np.asarray(b[j]["shingles"]).view(np.uint64), np.asarray(b[j]["weights"], float)]
            if max(similarity(*sets)) >= threshold - 1e-9:
                found[pair] = (a[i]["node"], b[j]["node"])
    return list(found.values())


#: Shingles of a block, but for single texts that have more.
BLOCK_TOKENS = 1 << 17
#: Members of a bucket that share a salt: a bucket with many is spread over many tasks.
SALTED = 256


def salt() -> F.Column:
    """Which part of its bucket a member (node, n) is in."""
    return F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / SALTED)).cast("int").alias("salt")


def salts() -> F.Column:
    """All parts of a bucket of n members."""
    return F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / SALTED).cast("int") - 1)).alias("salt")


def stars(edges: DataFrame) -> bool:
    """Whether each node of the distinct edges (a, b), a > b, either has one edge to a smaller node and none to larger ones, or the reverse."""
    down, up = edges.select(F.col("a").alias("node"), F.lit(1).alias("smaller"), F.lit(0).alias("larger")), edges.select(F.col("b").alias("node"), F.lit(0).alias("smaller"), F.lit(1).alias("larger"))
    ends = down.unionByName(up).groupBy("node").agg(F.sum("smaller").alias("smaller"), F.max("larger").alias("larger"))
    return ends.filter("smaller + larger > 1").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, label`` for every node of the edges (a, b): the smallest node it is connected with.

    Large-star and small-star steps alternate until all edges are stars; each step is a grouped minimum and a join, and
    their result is written before the next two.  Edges that are stars at first need no step.  Only a count reaches the driver.
    """
    now = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    scratch.clean()
    while not stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # b > a >= m
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(low.withColumnRenamed("m", "b"))
        now = scratch.save(small.distinct(), "edges")
        scratch.clean()
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def joined_labels(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, label`` once ``links`` (a, b) are added to classes named by their smallest node, which ``labels`` has as a node as well.

    Only the new links go through ``components``, as links of classes.  Nodes that ``labels`` lacks are classes of their own.
    """
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    merged = components(between, scratch)
    now = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("now")), "label", "left")
    return now.select("node", F.coalesce("now", "label").alias("label")).unionByName(merged.join(labels, "node", "left_anti"))


def near_duplicates(
    docs: DataFrame, words: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 5, small_bucket: int = 8, cheap_rounds: int = 6, block: int = 256
) -> DataFrame:
    """``doc_id, class_id, n_links, link_id, node, class_node, n_copies``: one row for each row of ``docs`` (doc_id, text).

    Documents are linked where the probability Jaccard of their weighted ``words``-word shingles, or the Jaccard of the shingle
    sets, is at least ``threshold``; classes are the connected components, named by their smallest doc_id.  node is
    the md5 of the text: exact copies are one node; class_node is the smallest of the class.  n_copies counts the rows with the
    text (1 without words), n_links the verified links of the text to other texts, link_id is the smallest doc_id of one such text (null without): every class is held
    together by its verified links, though not every two of its texts have been compared.  Candidates share a band of a
    signature, by weights or by sets; a pair at 0.8 by either does so with a probability over 0.99999.

    No bucket is turned into all its pairs.  Buckets of up to ``small_bucket`` nodes are compared in full (a constant
    number of pairs each).  In larger ones classes are first joined cheaply: in each round a member
    is compared with one node, the smallest of the random pivots of its buckets that isn't of its class; rounds go on while
    they settle a quarter of what is left, ``cheap_rounds`` at most.
    Buckets with one class left are done.  What is left, nodes near the threshold that few links hold together, is
    compared in full, in blocks that share a bucket (``compared_blocks``), which keep a link for every two classes.  So every two members of a bucket have been compared
    or have ended up in one class: no candidate is dropped, and there is no cap.

    Null, empty and white-space texts: alone (class_id their own id, node null).  Null ids: the class of their text;
    class_id is null only if all ids of the class are.  Repeated rows: one row each, the same class.
    Texts shorter than a window: one shingle.  Very long texts: whole.  Empty table: no rows.  Other columns are dropped.
    """
    bounded_batches(docs.sparkSession)
    return classes_of(docs.select("doc_id", "text"), words, threshold, bands, rows, small_bucket, cheap_rounds, block)


def classes_of(
    docs: DataFrame, words: int, threshold: float, bands: int, rows: int, small_bucket: int, cheap_rounds: int, block: int
) -> DataFrame:
    """The steps of ``near_duplicates``; all but the last joins are run here, and tables of earlier steps are deleted."""
    scratch = Scratch(docs.sparkSession)
    save = scratch.save
    signed = save(signatures(docs, bands, rows, words), "signed")
    nodes = signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.count("*").alias("n_copies"))
    nodes = save(nodes, "nodes")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1")
    members = save(keyed.join(full, "key").withColumn("salt", salt()), "members")  # key, node, n, least, salt
    wanted = members.select("node").distinct().join(nodes.select("node", F.col("doc_id").alias("first_id")), "node")
    text_of = docs.withColumn("node", F.unhex(F.md5(F.col("text").cast("binary"))))
    picked = text_of.join(wanted, (text_of["node"] == wanted["node"]) & text_of["doc_id"].eqNullSafe(wanted["first_id"]))
    picked = picked.select(text_of["node"], "text").dropDuplicates(["node"])
    shingles = save(shingle_table(picked, words), "shingles")

    few = members.filter(F.col("n") <= small_bucket).select("key", "node")
    all_pairs = few.alias("x").join(few.alias("y"), "key").filter("x.node < y.node").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    rest = members.filter(F.col("n") > small_bucket).select("key", "node", "n", "salt")
    star = members.filter((F.col("n") > small_bucket) & (F.col("node") > F.col("least"))).groupBy("node").agg(F.min("least").alias("a"))
    links = save(verified(star.select("a", F.col("node").alias("b")).unionByName(all_pairs).distinct(), shingles, threshold), "links")
    labels = save(components(links, scratch), "labels")

    def unsettled(labels: DataFrame) -> DataFrame:
        """Members of large buckets in which more than one class is left, with their classes."""
        now = rest.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        keys = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.first("n").alias("n")).filter("lo <> hi")
        return save(now.join(keys.select("key", salts()), ["key", "salt"], "left_semi"), "unsettled")

    now = unsettled(labels)
    left = now.count()
    for turn in range(cheap_rounds):
        if not left:
            break
        one = now.groupBy("key").agg(F.min_by(F.struct("node", "label"), F.xxhash64("node", F.lit(turn))).alias("p"), F.first("n").alias("n"))
        pairs = now.join(one.select("key", "p", salts()), ["key", "salt"]).filter("label <> p.label").groupBy("node").agg(F.min("p.node").alias("a"))
        more = save(verified(pairs.select("a", F.col("node").alias("b")), shingles, threshold), "more")
        labels = save(joined_labels(labels, more, scratch), "labels")
        links = save(links.unionByName(more), "links")
        now, before = unsettled(labels), left
        left = now.count()
        if left > 0.75 * before:
            break
    if left:
        sizes = shingles.select("node", F.size("shingles").alias("n"))
        compare = lambda x, y: links_between(x, y, threshold)

        def joined(found: DataFrame) -> DataFrame:
            nonlocal labels
            labels = save(joined_labels(labels, found, scratch), "labels")
            return labels

        more = compared_blocks(now.drop("n"), shingles, ["shingles", "weights"], compare, joined, block, BLOCK_TOKENS, scratch, sizes)
        joined(more)
        links = save(links.unionByName(more), "links")

    joined = nodes.select("node", "doc_id", "n_copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    joined = save(joined, "joined")
    class_of = joined.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    both = links.distinct().unionByName(links.distinct().select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = joined.select(F.col("node").alias("b"), F.col("doc_id").alias("other"))
    counts = both.distinct().join(other, "b").groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"), F.min("other").alias("link_id"))
    of_node = joined.join(class_of, "label").join(counts, "node", "left")
    of_node = save(of_node.select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "link_id", F.col("label").alias("class_node"), "n_copies"), "classes")
    scratch.clean("nodes", "members", "shingles", "links", "labels", "unsettled", "joined", "edges", "more", "dealt", "place", "blocks", "block_pairs", "within", "found")
    columns = ["doc_id", "class_id", "n_links", "link_id", "node", "class_node", "n_copies"]
    with_text = signed.filter("node is not null").select("doc_id", "node").join(of_node, "node").select(*columns)
    none = {"n_links": F.lit(0).cast("long"), "link_id": F.lit(None), "class_node": F.lit(None).cast("binary"), "n_copies": F.lit(1).cast("long")}
    alone = signed.filter("node is null").select("doc_id", F.col("doc_id").alias("class_id"), "node").withColumns(none).select(*columns)
    return with_text.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the row with the smallest doc_id stays.

    Of repeated rows (same id and text) one stays.  Rows without words all stay, as they belong to no class.  All columns
    of ``docs`` stay, whatever their names.
    """
    rows = near_duplicates(docs, **options).filter("node is not null and doc_id <=> class_id")
    free = lambda name: name if name not in docs.columns else free(name + "_")
    own, of_id, of_node = free("node"), free("of_id"), free("of_node")
    first = rows.groupBy("class_node").agg(F.min("doc_id").alias(of_id), F.min("node").alias(of_node)).drop("class_node")
    text = docs.withColumn(own, F.unhex(F.md5(F.col("text").cast("binary"))))
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = text.filter(words).join(first, (F.col(own) == F.col(of_node)) & F.col("doc_id").eqNullSafe(F.col(of_id)), "left_semi")
    kept = kept.dropDuplicates([own, "doc_id"])
    return kept.unionByName(text.filter(~words)).drop(own)
