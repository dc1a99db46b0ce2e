"""Exact top-k search for 64-bit binary codes by incremental multi-index hashing."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import Scratch

BITS = 64
#: A segment has at most this many bits, so that the flips of one radius (at most 705,432 numbers) can be broadcast.
WIDEST = 22


def sign_code(vector: str) -> Column:
    """Bit i is 1 where component i is above 0.  At most 64 components, more raise; null stays null."""
    bits = F.transform(
        vector, lambda x, i: F.when(F.coalesce(x > 0, F.lit(False)), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    )
    too_long = F.raise_error(F.lit("more than 64 components")).cast("long")
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(vector) > 64, too_long).when(F.size(vector) > 0, code)


def segments_for(n_codes: int) -> list[tuple[int, int]]:
    """First bit and width of each segment: about log2(n_codes) bits wide, so that a value has about one code."""
    bits = max(4, math.ceil(math.log2(max(n_codes, 2))))
    m = max(math.ceil(BITS / WIDEST), min(16, round(BITS / bits)))
    widths = [BITS // m + (n < BITS % m) for n in range(m)]
    return [(sum(widths[:n]), w) for n, w in enumerate(widths)]


def part_of(code: Column, segment: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(code, segment[0]).bitwiseAND(F.lit((1 << segment[1]) - 1)).cast("int")


def flips(spark: SparkSession, widths: set[int], radius: int) -> DataFrame:
    """``width, flip``: for each width all numbers of so many bits of which ``radius`` are 1.

    The width is worked out from the row, as a constant would be taken out of the join that needs it.
    """
    of = lambda w: spark.range(1 << w).filter(F.bit_count("id") == radius).select((F.col("id") * 0 + w).cast("int").alias("width"), F.col("id").cast("int").alias("flip"))
    return reduce(DataFrame.unionByName, map(of, sorted(widths)))


def search_codes(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, neighbor_id, distance``: the k nearest other rows of ``index`` for each query, exactly.

    Both tables: ``id`` long, ``code`` long.  Order: Hamming distance, then id.  The row with the query's own id is left out.

    A code within distance d of a query differs by at most floor(d / m) bits in one of its m segments.  Radii 0, 1, 2, ... are
    searched in all segments; after r every code up to distance m (r + 1) - 1 has been seen, so a query is done once
    its k-th distance is no larger, and only the others go on.  A code counts where it is met first, by the least radius and then
    the first segment, and only if it isn't farther than the k-th so far, both before anything is shuffled.
    m follows from the number of codes.  Equal codes are one entry of the index with the k + 1 smallest ids, which is
    all a top-k can use, and equal queries are searched once, so a code that a third of all rows share is one entry and one
    search.  Only counts reach the driver.

    Null code or id: never a neighbour, and a query without result.  Repeated rows of an id: one row, of several codes the smallest.
    Fewer than k other rows: all of them, for queries inside and outside the index.  Empty tables: no rows.
    """
    spark, scratch = index.sparkSession, Scratch(index.sparkSession)
    one_each = lambda t: t.filter("id is not null and code is not null").groupBy("id").agg(F.min("code").alias("code"))
    by_code = Window.partitionBy("code").orderBy("id")
    few = one_each(index).withColumn("n", F.row_number().over(by_code)).filter(F.col("n") <= k + 1)
    entries = scratch.save(few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = scratch.save(one_each(queries).select(F.col("id").alias("query_id"), F.col("code").alias("query_code")))
    segments = segments_for(entries.count())
    m, widest = len(segments), segments[0][1]
    places = F.explode(F.array(*(F.struct(F.lit(n).alias("part"), part_of(F.col("code"), s).alias("value")) for n, s in enumerate(segments))))
    parts = entries.select("code", "ids", places.alias("p")).select("code", "ids", F.col("p.part").alias("part"), F.col("p.value").alias("value"))
    open_ = asked.select("query_code").distinct().withColumn("worst", F.lit(BITS))
    apart = F.col("query_code").bitwiseXOR(F.col("code"))
    distance = F.bit_count(apart)
    order = Window.partitionBy("query_code").orderBy("distance", "neighbor_id")
    done: list[DataFrame] = []
    best: DataFrame | None = None
    for radius in range(widest + 1):
        probe = F.array(*(F.struct(F.lit(n).alias("part"), F.lit(w).alias("width"), part_of(F.col("query_code"), (at, w)).alias("own")) for n, (at, w) in enumerate(segments)))
        probes = open_.select("query_code", "worst", F.explode(probe).alias("p")).select("query_code", "worst", "p.part", "p.width", "p.own")
        probes = probes.join(F.broadcast(flips(spark, {w for _, w in segments}, radius)), "width")
        probes = probes.withColumn("value", F.col("own").bitwiseXOR(F.col("flip"))).drop("own", "flip", "width")
        first = F.lit(True)
        for n, s in enumerate(segments):
            first = first & (F.bit_count(part_of(apart, s)) >= F.when(F.lit(n) < F.col("part"), radius + 1).otherwise(radius))
        found = probes.join(parts, ["part", "value"]).filter(first & (distance <= F.col("worst")))
        near = found.select("query_code", distance.cast("int").alias("distance"), F.explode("ids").alias("neighbor_id"))
        if best is not None:
            near = near.unionByName(best)
        best = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1).drop("rank")
        best = scratch.save(best)
        state = open_.join(best.groupBy("query_code").agg(F.count("*").alias("n"), F.max("distance").alias("far")), "query_code", "left")
        state = scratch.save(state.select("query_code", F.when(F.col("n") > k, F.col("far")).otherwise(BITS).cast("int").alias("worst")))
        sure = (F.col("worst") < m * (radius + 1)) | F.lit(radius == widest)
        done.append(best.join(state.filter(sure).select("query_code"), "query_code", "left_semi"))
        open_ = state.filter(~sure)
        if open_.isEmpty():
            break
        best = best.join(open_.select("query_code"), "query_code", "left_semi")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    lists = out.groupBy("query_code").agg(F.sort_array(F.collect_list(F.struct("distance", "neighbor_id"))).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["neighbor_id"] != F.col("query_id")), 1, k)
    ranked = asked.join(lists, "query_code").select("query_id", F.posexplode(others).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.neighbor_id").alias("neighbor_id"), F.col("x.distance").alias("distance"))


def hamming_neighbors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 10) -> DataFrame:
    """Sign codes of ``vectors``, and for every row whose id is divisible by ``every`` its k nearest rows.

    Null or empty vectors have no code; a null component counts as not above 0.  See ``search_codes``.
    """
    codes = vectors.select(F.col(id).alias("id"), sign_code(vector).alias("code"))
    return search_codes(codes, codes.filter(F.col("id") % every == 0), k)


HAMMING_SQL = """
WITH bits AS (
  SELECT vec_id AS id, list_aggregate(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN CAST(1 AS HUGEINT) << CAST(i - 1 AS INTEGER) ELSE CAST(0 AS HUGEINT) END), 'sum') AS b
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
), codes AS (
  SELECT id, CAST(min(CASE WHEN b >= 9223372036854775808 THEN CAST(b AS HUGEINT) - 18446744073709551616 ELSE CAST(b AS HUGEINT) END) AS BIGINT) AS code FROM bits GROUP BY id
), pairs AS (
  SELECT q.id AS query_id, c.id AS neighbor_id, bit_count(xor(q.code, c.code)) AS distance
  FROM codes q JOIN codes c ON c.id <> q.id WHERE q.id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, CAST(distance AS INTEGER) AS distance FROM ranked WHERE rank <= 10
"""
