"""Large buckets of candidates, compared in full without listing their pairs: blocks of sets, two of which are one row of work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .util import Scratch, small_batches


def dealt_blocks(nodes: DataFrame, most_sets: int, most_tokens: int) -> DataFrame:
    """``node, label, block``: nodes (node, label, key, n) in the order of their keys, in blocks of at most ``most_sets`` sets and, but for single
    sets that are larger, ``most_tokens`` tokens.  So nodes of one bucket are neighbours."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, tokens = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            out = []
            for n in batch.column("n").to_pylist():
                if held == most_sets or held and tokens + n > most_tokens:
                    block, held, tokens = block + 1, 0, 0
                held, tokens = held + 1, tokens + n
                out.append(block)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("label"), pa.array(out, pa.int64())], ["node", "label", "block"])

    in_order = nodes.select("node", "label", "key", "n").repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    return in_order.mapInArrow(dealt, nodes.select("node", "label").schema.add("block", "long"))


def classes_of_blocks(place: DataFrame) -> DataFrame:
    """``block, lo, hi``: the first and the last class of a block; it has but one if they are the same."""
    return place.groupBy("block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))


def block_pairs(members: DataFrame, place: DataFrame) -> DataFrame:
    """``bx, by``, bx before by: the distinct pairs of blocks that share a bucket (key, node) and hold more than one class between them."""
    at = members.select("key", "node").join(place, "node").groupBy("key").agg(F.sort_array(F.collect_set("block")).alias("at"))
    at = at.select("at").distinct().select("at", F.posexplode("at").alias("i", "bx"))  # many buckets are in the same blocks
    # each block with the later ones of its buckets, united: a row for each block of a bucket, not for each two
    later = at.select("bx", F.slice("at", F.col("i") + 2, F.size("at")).alias("later")).groupBy("bx").agg(F.collect_set("later").alias("later"))
    pairs = later.select("bx", F.explode(F.array_distinct(F.flatten("later"))).alias("by"))
    classes = classes_of_blocks(place)
    of = lambda side: classes.select(F.col("block").alias(f"b{side}"), F.col("lo").alias(f"lo_{side}"), F.col("hi").alias(f"hi_{side}"))
    one_class = F.expr("lo_x = hi_x and lo_x = lo_y and lo_y = hi_y")
    return pairs.join(of("x"), "bx").join(of("y"), "by").filter(~one_class).select("bx", "by")


def compared_blocks(
    members: DataFrame,
    sets: DataFrame,
    columns: list[str],
    links_between: Callable[[list[dict], list[dict]], list[tuple]],
    joined: Callable[[DataFrame], DataFrame],
    most_sets: int,
    most_tokens: int,
    scratch: Scratch,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Links (a, b) that join classes, from large buckets (key, node, n, label): each row one bucket and member, n its tokens (or in ``sizes``: node, n).

    sets: node and ``columns``, which ``links_between`` finds with node and label in the rows of two blocks.  Each block is compared with itself
    first; ``joined`` gives the classes (node, label) with these links.  Then blocks are compared with each other: of a group of sets that are all
    alike each block is one class by then, so two blocks have one link, not one for every two sets.

    Members are joined once, with their blocks; all else is joined by node or block.
    """

    nodes = members.select(F.col("node").alias("a"), F.col("node").alias("b")).schema
    kind = to_arrow_type(nodes["a"].dataType)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = links_between(batch.column("x")[i].as_py(), batch.column("y")[i].as_py())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in zip(*found, strict=True)], ["a", "b"])

    def found_in(place: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        blocks = place.join(sets, "node").groupBy("block").agg(F.collect_list(F.struct("node", "label", *columns)).alias("rows"))
        blocks = scratch.save(blocks, "blocks")
        of = lambda side: blocks.select(F.col("block").alias(f"b{side}"), F.col("rows").alias(side))
        work = pairs.join(of("x"), "bx").join(of("y"), "by")
        with small_batches(members.sparkSession, 4):
            return scratch.save(work.select("x", "y").mapInArrow(compared, nodes), name)

    n = [] if sizes else [F.first("n").alias("n")]
    first = members.groupBy("node").agg(F.min("key").alias("key"), F.first("label").alias("label"), *n)
    first = first.join(sizes, "node") if sizes else first
    place = scratch.save(dealt_blocks(first, most_sets, most_tokens), "dealt")
    several = classes_of_blocks(place).filter("lo <> hi").select(F.col("block").alias("bx"), F.col("block").alias("by"))
    within = found_in(place, several, "within")
    now = joined(within).select("node", F.col("label").alias("now"))
    place = place.join(now, "node", "left").select("node", F.coalesce("now", "label").alias("label"), "block")
    place = scratch.save(place, "place")
    pairs = scratch.save(block_pairs(members, place), "block_pairs")
    return within if pairs.isEmpty() else within.unionByName(found_in(place, pairs, "found"))
