"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import arrow_map, doc_crc_mod, labelled_sample, with_columns_last

WORD = re.compile(r"\w+")
#: Rows of queries scored together.
TOGETHER = 128


def terms_of(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


class BlockMaxIndex:
    """Postings of unit vectors in blocks of examples, with the largest weight of each term in each block.

    Terms that more than ``dense`` of the examples hold have their postings as rows of a matrix; those of all other
    terms are lists.  ``vectors``: term numbers and weights of each example.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = 64, dense: float = 0.05):
        self.n, self.block = len(vectors), block
        self.n_blocks = -(-self.n // block)
        width = self.n_blocks * block
        sizes = [len(t) for t, _ in vectors]
        terms = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)]).astype(np.int64)
        weights = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
        examples = np.repeat(np.arange(self.n), sizes)
        frequent = np.flatnonzero(np.bincount(terms, minlength=n_terms) > max(dense * self.n, 1))
        self.place = np.full(n_terms, -1, dtype=np.int32)  # rows of the matrix
        self.place[frequent] = np.arange(len(frequent))
        at = self.place[terms]
        self.matrix = np.zeros((len(frequent), width))
        self.matrix[at[at >= 0], examples[at >= 0]] = weights[at >= 0]
        self.top = self.matrix.reshape(len(frequent), self.n_blocks, block).max(axis=2) if self.n else np.zeros((len(frequent), 0))
        terms, examples, weights = terms[at < 0], examples[at < 0], weights[at < 0]
        order = np.lexsort((examples, terms))
        self.examples, self.weights = examples[order].astype(np.int32), weights[order]
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1)).astype(np.int64)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the k examples with the largest cosine above 0 (ties: lower number first), and the cosines.

        The lists are added up for all blocks; on top of that comes, for each block, the bound of the matrix terms.  The
        blocks with the largest sums are scored first, at least k examples; of all others then those that can still
        reach the k-th cosine so far.  A block that could equal it is scored as well, because of ties.
        """
        if not self.n or not queries:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        rows, width = len(queries), self.n_blocks * self.block
        of = np.repeat(np.arange(rows), [len(t) for t, _ in queries])
        terms = np.concatenate([t for t, _ in queries]).astype(np.int64)
        weights = np.concatenate([w for _, w in queries])
        at = self.place[terms]
        head = np.zeros((rows, len(self.matrix)))
        head[of[at >= 0], at[at >= 0]] = weights[at >= 0]
        of, terms, weights = of[at < 0], terms[at < 0], weights[at < 0]
        begin, length = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        total = np.cumsum(length)
        posting = np.arange(total[-1] if len(total) else 0) + np.repeat(begin - (total - length), length)
        cell = np.repeat(of, length) * width + self.examples[posting]
        score = np.bincount(cell, weights=np.repeat(weights, length) * self.weights[posting], minlength=rows * width)
        score = score.reshape(rows, self.n_blocks, self.block)
        bound = score.max(axis=2) + head @ self.top
        first = min(max(4, -(-k // self.block) + 1), self.n_blocks)
        top = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        wanted = np.zeros((rows, self.n_blocks), bool)
        np.put_along_axis(wanted, top, True, axis=1)
        seen = np.full((rows, width), -1.0)

        def scored(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)):
                q, at = np.flatnonzero(wanted[:, b]), slice(b * self.block, (b + 1) * self.block)
                seen[q, at] = score[q, b] + head[q] @ self.matrix[:, at]

        def kth_best(among: np.ndarray) -> np.ndarray:
            n = among.shape[1]
            return np.maximum(np.partition(among, n - k, axis=1)[:, n - k], 0) if n > k else np.zeros(rows)

        scored(wanted)
        kth = kth_best(np.take_along_axis(seen.reshape(rows, self.n_blocks, self.block), top[:, :, None], axis=1).reshape(rows, -1))
        scored(~wanted & (bound >= kth[:, None] - 1e-9))
        kth = kth_best(seen) if self.n > k else np.zeros(rows)
        out = []
        for q in range(rows):
            hit = np.flatnonzero(seen[q] > max(kth[q] - 1e-9, 1e-12))
            best = hit[np.lexsort((hit, -np.round(seen[q, hit], 10)))][:k]
            out.append((best, seen[q, best]))
        return out


@dataclass
class ToxicityModel:
    vocabulary: dict[str, int]  # every term of the examples
    weight: np.ndarray  # of each: inverse document frequency times relevance
    prior: float
    k: int
    index: BlockMaxIndex = field(default_factory=lambda: BlockMaxIndex([], 0))
    example_ids: list = field(default_factory=list)
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    slope: float = 1.0
    shift: float = 0.0

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the terms that an example holds as well, and how often the text has them."""
        known, found = self.vocabulary, terms_of(text)
        numbers = np.array([known.get(t, -1) for t in found], dtype=np.int64)
        counts = np.array(list(found.values()), dtype=np.float64)
        return numbers[numbers >= 0], counts[numbers >= 0]

    def vector(self, terms: np.ndarray, counts: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        v = (1 + np.log(counts)) * (self.weight[terms] if weight is None else weight)
        norm = np.sqrt(v @ v)
        return (terms, v / norm) if norm > 0 else (terms[:0], v[:0])

    def votes(self, queries: list[tuple[np.ndarray, np.ndarray]], leave_out: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """The k nearest examples vote with their cosine, besides one vote of the prior; those examples as evidence."""
        shares, evidence = np.empty(len(queries)), []
        for q, (found, cosines) in enumerate(self.index.nearest(queries, self.k + (leave_out is not None))):
            if leave_out is not None:
                keep = found != leave_out[q]
                found, cosines = found[keep][: self.k], cosines[keep][: self.k]
            shares[q] = (cosines @ self.toxic[found] + self.prior) / (cosines.sum() + 1)
            evidence.append(found)
        return shares, evidence

    def scores(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * np.log(votes / (1 - votes)) + self.shift)))


def document_frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term of the vocabulary occurs; the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        seen = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for s in batch.column("text").to_pylist():
                seen[[known[t] for t in set(WORD.findall((s or "").lower())) if t in known]] += 1
                seen[-1] += 1
        term = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(seen[term])], ["term", "n"])

    rows = arrow_map(docs.select("text"), counted, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(len(vocabulary) + 1, np.int64)
    seen[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return seen[:-1], int(seen[-1])


def relevance(bad: np.ndarray, good: np.ndarray, prior: float, strength: float, least: float) -> np.ndarray:
    """``least`` plus how far the odds of a term's examples being toxic lie from the prior's, as a log ratio.

    bad and good count the toxic and clean examples with the term; ``strength`` further examples with the prior's
    share stand for what a few examples can't tell.
    """
    odds = (bad + strength * prior) / (good + strength * (1 - prior))
    return least + np.abs(np.log(odds * (1 - prior) / prior))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 4_000, k: int = 16, strength: float = 20.0, least: float = 0.1) -> ToxicityModel:
    """Examples from at most ``sample`` labelled rows whose crc32(doc_id as text) mod 5 isn't 0.

    A term is a run of word characters in lower case.  Every term of every example counts, none is left out; its weight is (1 + ln
    count) times the inverse of its document frequency among all ``docs`` times its relevance.  With ``strength`` = inf
    relevance is the same for all terms, and the vectors are those of plain TF-IDF.  Terms that no example has lie outside the space of
    the vectors.  Each example's votes, without itself and with relevance counted without it, give the calibration.

    Only texts and the label ``toxic`` are read.  Without both kinds of labels every score is the prior (0.5 without labels).
    """
    train = labels.filter(doc_crc_mod("doc_id", 5) != 0)
    chosen = labelled_sample(docs, train, "toxic", sample)

    def termed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms_of(s) for s in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("target_"),
                    pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32())),
                ],
                ["doc_id", "target_", "terms", "counts"],
            )

    schema = chosen.select("doc_id", "target_").schema.add("terms", T.ArrayType(T.StringType())).add("counts", T.ArrayType(T.IntegerType()))
    rows = arrow_map(chosen.select("doc_id", "target_", "text"), termed, schema).toArrow()
    order = rows.column("doc_id").combine_chunks()
    rows = rows.take(pa.compute.sort_indices(order)) if len(rows) else rows
    y = rows["target_"].to_numpy() if len(rows) else np.zeros(0)
    prior = float((y.sum() + 0.5) / (len(y) + 1))
    if not len(rows):
        return ToxicityModel({}, np.zeros(0), prior, k)
    lists = rows["terms"].combine_chunks()
    names = lists.values.dictionary_encode()
    vocabulary = {t: i for i, t in enumerate(names.dictionary.to_pylist())}
    terms, counts = names.indices.to_numpy().astype(np.int64), rows["counts"].combine_chunks().values.to_numpy().astype(np.float64)
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    df, n = document_frequencies(docs, vocabulary)
    idf = np.log((1 + n) / (1 + df)) + 1
    of = np.repeat(np.arange(len(y)), np.diff(bounds))
    bad = np.bincount(terms, weights=y[of], minlength=len(vocabulary))
    good = np.bincount(terms, minlength=len(vocabulary)) - bad
    plain = np.isinf(strength)
    model = ToxicityModel(vocabulary, idf * (1.0 if plain else relevance(bad, good, prior, strength, least)), prior, k)
    parts = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        rising = np.argsort(terms[a:b])
        parts.append((terms[a:b][rising], counts[a:b][rising]))
    vectors = [model.vector(t, c) for t, c in parts]
    # examples whose heaviest term is the same lie together, so that blocks have few large weights
    heaviest = np.array([t[np.argmax(w)] if len(t) else -1 for t, w in vectors])
    placed = np.lexsort((np.arange(len(y)), heaviest))
    model.index = BlockMaxIndex([vectors[i] for i in placed], len(vocabulary))
    ids = rows["doc_id"].to_pylist()
    model.example_ids, model.toxic = [ids[i] for i in placed], y[placed]
    if 0 < y.sum() < len(y):
        if not plain:  # each example as if it hadn't been counted
            vectors = [model.vector(t, c, idf[t] * relevance(bad[t] - y[i], good[t] - 1 + y[i], prior, strength, least)) for i, (t, c) in enumerate(parts)]
        where = np.empty(len(y), np.int64)
        where[placed] = np.arange(len(y))
        votes = np.concatenate([model.votes(vectors[lo : lo + TOGETHER], where[lo : lo + TOGETHER])[0] for lo in range(0, len(y), TOGETHER)])
        x = np.column_stack([np.log(votes / (1 - votes)), np.ones(len(votes))])
        w = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2)
            w += np.linalg.solve(hessian, x.T @ (y - p) - (w - [1.0, 0.0]))
        model.slope, model.shift = max(float(w[0]), 0.05), float(w[1])
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``score``, ``predicted`` (score >= 0.5) and ``evidence``: the nearest examples' ids.

    The index is broadcast: it holds at most the sampled examples.  Null or empty texts, and those without a term of an
    example, have no neighbours and get the calibrated prior.  Very long texts count whole.  Null ids, repeated rows and ties:
    each row by itself, equal cosines in the order of the examples.  Empty table: no rows.  Clashing columns are renamed.
    """
    docs = with_columns_last(docs, ["score", "predicted", "evidence"])
    kept = [c for c in docs.columns if c != text]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = T.StringType() if model.example_ids and isinstance(model.example_ids[0], str) else T.LongType()
    schema = docs.select(*kept).schema.add("score", "double").add("evidence", T.ArrayType(id_type))
    arrow_ids = pa.list_(pa.string() if isinstance(id_type, T.StringType) else pa.int64())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(lo, TOGETHER)
                votes, found = m.votes([m.vector(*m.counts(s)) for s in batch.column(text).to_pylist()])
                evidence = [[m.example_ids[e] for e in f[:5]] for f in found]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(m.scores(votes)), pa.array(evidence, arrow_ids)], [*kept, "score", "evidence"])

    out = arrow_map(docs.select(*kept, text), scored, schema)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
