"""How the sources of each language differ in their words: exact term frequencies, compared pair by pair and term by term."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import Scratch, arrow_map, small_batches

#: Letters in lower case; every other byte below 0x80 is a blank.  Bytes from 0x80 on belong to letters outside ASCII.
FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
SCALE = 1_000_000_000
#: A partial count table in a worker is sent on when it has this many terms.
HELD = 200_000
#: Terms, and sources, of one tile of the comparison of sources.
TILE_TERMS, TILE_SOURCES = 4096, 64


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: parts of the counts of terms and of the documents that hold them, to be added up.

    Each document is folded by one ``bytes.translate`` and split; its Counter is added to those of its group.  Every group
    also has rows with the empty term and n = 0.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = {}
        held: dict[tuple[str, str], Counter] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in n.items():
                names = list(terms)
                rows = len(names) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * rows), pa.array([source] * rows), pa.array([b"", *names], pa.binary()).cast(pa.string()),
                        pa.array([0, *terms.values()], pa.int64()), pa.array([0, *map(held[lang, source].__getitem__, names)], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )
            n.clear()
            held.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                group = lang, source
                if group not in n:
                    n[group], held[group] = Counter(), Counter()
                found = Counter(text.encode().translate(FOLD).split())
                size -= len(n[group])
                n[group].update(found)
                held[group].update(found.keys())
                size += len(n[group])
                if size > HELD:
                    yield from sent()
                    size = 0
        yield from sent()

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return arrow_map(docs.select(text("lang"), text("source"), text("text")), counted, "lang string, source string, term string, n long, docs long")


def share(n: F.Column, total: F.Column, terms: F.Column) -> F.Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), in decimals of whole numbers: exact."""
    num = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return 1 + F.when(terms > 0, F.call_function("div", num, F.greatest(total + terms, F.lit(1)).cast("decimal(20,0)"))).otherwise(0)


def gap(p: F.Column, q: F.Column) -> F.Column:
    """floor((p - q)^2 / q); both are at most 10^9 + 1, so a long holds the square."""
    return F.call_function("div", (p - q) * (p - q), q)


def tile_sums(rows: pa.Table) -> pa.Table:
    """Of one tile: the sum of gaps over its terms for each two of its sources, and the number of its terms.

    Rows are source, side, p of a term in the source, and p0, that of a term it doesn't have; rows without a term name the sources.
    """
    source, side, p, p0 = (rows.column(c).to_numpy() for c in ("source_no", "side", "p", "p0"))
    first, second = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    coded = pc.dictionary_encode(rows.column("term").combine_chunks())
    has, terms = coded.is_valid().to_numpy(zero_copy_only=False), len(coded.dictionary)
    at = coded.indices.filter(pa.array(has)).to_numpy()
    names, own = np.unique(source, return_inverse=True)
    base = np.zeros(len(names), np.int64)
    base[own] = p0
    grid = np.repeat(base[:, None], terms, axis=1)
    grid[own[has], at] = p[has]
    sides = [np.unique(own[side == s]) for s in (0, 1)]
    left, right = (sides[0], sides[0]) if first == second else sides
    out: list[tuple[int, int, int]] = []
    for a in left:
        d = grid[a] - grid[right]
        square = d * d
        out += [(names[a], names[b], v) for b, v in zip(right, (square // grid[right]).sum(axis=1), strict=True) if a != b]
        if first != second:
            out += [(names[b], names[a], v) for b, v in zip(right, (square // grid[a]).sum(axis=1), strict=True)]
    a, b, value = zip(*out, strict=True) if out else ((), (), ())
    return pa.table(
        {
            "lang_no": pa.array([rows.column("lang_no")[0].as_py()] * len(out), pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()),
            "value": pa.array(value, pa.int64()), "terms": pa.array([terms] * len(out), pa.int64()),
        }
    )


def source_divergence(docs: DataFrame, least_docs: int = 3, best: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank``: how sources differ from each other and from their language.

    Terms are runs of ASCII letters (in lower case) and of characters outside ASCII.  Each language keeps the terms in at
    least ``least_docs`` of its documents.  A kept term has p = 1 + floor(10^9 (n + 1) / (N + V)) in each source and in the
    language; n: its occurrences there, N: those of all kept terms, V: the number of kept terms.  A gap is
    floor((p - q)^2 / q).  Part ``pair``: for every other source of the language the sum of gaps from its q.  Part
    ``term``: the ``best`` terms of the source with a p above the language's.  All arithmetic is on whole numbers.

    Counts are added up sparsely: a term that a source lacks isn't a row.  Sources are compared in tiles of TILE_TERMS terms
    and two blocks of TILE_SOURCES sources, each a small matrix; terms that no source of a tile has are added as one
    product.  So the largest language or source is many tiles, and a task holds one tile at a time.

    Null lang, source and text are ''.  A source without terms, or a language without kept terms: its pairs, with value 0 where
    no terms are kept.  Repeated rows count each.  Ties rank by item, in the order of UTF-8 bytes.  Very long texts: whole.
    Empty table: no rows.  Other columns are dropped, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    counts = scratch.save(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = counts.filter("term <> ''").select("lang", "source", "term", "n").join(terms.filter(F.col("docs") >= least_docs).drop("docs"), ["lang", "term"])
    kept = scratch.save(kept)
    langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    names = counts.filter("term = ''").select("lang", "source")
    groups = names.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    number = Window.partitionBy("lang").orderBy("source")
    groups = groups.withColumns({"lang_no": F.xxhash64("lang"), "source_no": (F.row_number().over(number) - 1).cast("long")})
    groups = scratch.save(groups.withColumn("p0", share(F.lit(0), F.col("total"), F.col("v"))))
    rows = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))

    q = share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    of_terms = rows.withColumn("q", q).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_terms = of_terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= best)

    span = groups.groupBy("lang_no").agg(F.max("source_no").alias("last"), F.first("v").alias("v"))
    tiles = F.greatest(F.ceil(F.col("v") / TILE_TERMS), F.lit(1))
    groups_at = groups.select("lang_no", "source_no", "p0").join(span, "lang_no").withColumn("n_tiles", tiles)
    entries = rows.select("lang_no", "source_no", "term", "p", "p0").join(span, "lang_no")
    entries = entries.withColumn("tile", F.pmod(F.xxhash64("term"), tiles).cast("int"))
    marks = groups_at.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("n_tiles").cast("int") - 1)))
    every = entries.select("lang_no", "source_no", "term", "p", "p0", "last", "tile").unionByName(
        marks.select("lang_no", "source_no", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), "p0", "last", "tile")
    )
    block = lambda c: F.floor(F.col(c) / TILE_SOURCES).cast("int")
    meets = F.explode(F.sequence(F.lit(0), block("last"))).alias("other")
    each = every.select("lang_no", "source_no", "term", "p", "p0", "tile", block("source_no").alias("own"), meets)
    each = each.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).withColumn("side", (F.col("own") > F.col("i")).cast("int"))
    with small_batches(docs.sparkSession, 10_000):
        sums = each.drop("own", "other").groupBy("lang_no", "tile", "i", "j").applyInArrow(tile_sums, "lang_no long, a long, b long, value long, terms long")
        sums = scratch.save(sums.groupBy("lang_no", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms")))
    of = lambda side: groups.select("lang_no", F.col("source_no").alias(side), F.col("source").alias(f"source_{side}"), F.col("p0").alias(f"p0_{side}"))
    pairs = sums.join(of("a"), ["lang_no", "a"]).join(of("b"), ["lang_no", "b"]).join(groups.select("lang_no", "lang", "v").distinct(), "lang_no")
    rest = (F.col("v") - F.col("terms")) * gap(F.col("p0_a"), F.col("p0_b"))
    of_pairs = pairs.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), (F.col("value") + rest).alias("value"))
    of_pairs = of_pairs.withColumn("rank", F.row_number().over(by_value))
    return of_pairs.unionByName(of_terms).select("lang", "source", "part", "item", "value", "rank")


#: The same, for DuckDB.
DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_no, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
  w AS (SELECT row_no, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  t AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT row_no) >= 3),
  l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM t GROUP BY lang),
  g AS (SELECT DISTINCT lang, source FROM d),
  c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN t USING (lang, term) GROUP BY ALL),
  s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
  p AS (SELECT s.lang, s.source, t.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + l.v)::HUGEINT AS p,
      1 + (1000000000::HUGEINT * (t.n + 1)) // (l.total + l.v)::HUGEINT AS q
    FROM s JOIN t ON s.lang = t.lang JOIN l ON s.lang = l.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = t.term),
  f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
  terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q),
  r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
