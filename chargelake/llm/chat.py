"""Multi-party dialogues rendered from every participant's point of view (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import Scratch

END = "<|end|>\n"
#: Longer dialogues are written in segments of this many messages.
SEGMENT = 4096


def numbered(rows: DataFrame) -> DataFrame:
    """``conv_id, m, i``: the rows of long dialogues with their place (from 0) in the order of m.

    Rows are dealt to tasks by ranges of (conv_id, m), so that a dialogue spreads over as many tasks as it needs, whatever its
    turns are.  Only dialogues that reach over tasks need to know how much of them lies before: those
    are at most two rows for each task, which is the bound of the broadcast.
    """
    dealt = rows.repartitionByRange("conv_id", "m").withColumn("task", F.spark_partition_id())
    dealt = Scratch(rows.sparkSession).save(dealt)
    here = F.row_number().over(Window.partitionBy("conv_id", "task").orderBy("m")) - 1
    parts = dealt.groupBy("conv_id", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    spans = parts.select(F.col("conv_id").alias("conv_"), F.col("task").alias("task_"), before.alias("before")).filter("before is not null")
    return dealt.join(F.broadcast(spans), F.col("conv_id").eqNullSafe(F.col("conv_")) & (F.col("task") == F.col("task_")), "left").select(
        "conv_id", "m", (here + F.coalesce("before", F.lit(0))).alias("i")
    )


def is_system(role: Column, system_roles: tuple[str, ...]) -> Column:
    return F.coalesce(role.isin(*system_roles), F.lit(False))


def segmented(rows: DataFrame, size: int, system_roles: tuple[str, ...]) -> DataFrame:
    """``conv_id, segment, messages`` of long dialogues; later segments begin with the system message in force."""
    placed = numbered(rows).withColumn("segment", F.floor(F.col("i") / size).cast("long"))
    system = F.max_by("m", F.when(is_system(F.col("m.role"), system_roles), F.col("i")))
    last = F.when(F.max(F.when(is_system(F.col("m.role"), system_roles), F.col("i"))).isNotNull(), system)
    found = placed.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list("m")).alias("messages"), last.alias("system"))
    earlier = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("system", F.last("system", ignorenulls=True).over(earlier))
    messages = F.when(F.col("system").isNull(), F.col("messages")).otherwise(F.concat(F.array("system"), "messages"))
    return found.select("conv_id", "segment", messages.alias("messages"))


def rotate_perspectives(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    system_roles: tuple[str, ...] = ("system",),
    segment_messages: int = SEGMENT,
) -> DataFrame:
    """One row for each dialogue and participant, with that participant as the assistant.

    ``conv_id, segment, speaker, n_messages, n_targets, rendered, target_mask, target_spans``.  Messages are
    ``<|assistant|>\\n`` for the speaker, ``<|user name="..."|>\\n`` for the others and ``<|system|>\\n`` for system roles, then
    the text and ``<|end|>\\n``.  ``<|`` inside texts and names becomes ``<\\|``, a quote inside names ``\\"``: no text can pass for a mark.
    target_mask has a 1 for each message of the speaker, else 0; target_spans are the character ranges to learn,
    ``begin-end`` (end excluded): text and end mark of those messages.

    Messages are in order of turn, role, text.  A dialogue is one row, segment 0.  Only one of more than ``segment_messages``
    messages is written in several, as it may be a large part of all rows and larger than a task: the next so many messages
    each, and the later ones begin with the last system message before them, so that each can be learned by itself.
    The places of its messages are counted over ranges of its rows, in many tasks; participants are those of the whole dialogue.

    Null role: the message of a user named ``unknown``, who is no participant.  Null or empty text: an empty message.  Very long texts
    whole.  Null turn: first.  Null conv_id: one dialogue of that name.  Repeated rows and ties: every row is a message.
    A dialogue of system messages only has no participants and no row.  Empty table: no rows.  Other columns are dropped.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("m"),
    )
    who = rows.select(F.col("conv_id").alias("conv_"), F.col("m.role").alias("speaker"))
    who = who.filter(F.col("speaker").isNotNull() & ~is_system(F.col("speaker"), system_roles)).distinct()
    long = rows.groupBy("conv_id").count().filter(F.col("count") > segment_messages).select(F.col("conv_id").alias("long_"))
    same = F.col("conv_id").eqNullSafe(F.col("long_"))
    some = not long.isEmpty()
    short = rows.join(long, same, "left_anti") if some else rows
    dialogues = short.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("messages"))
    dialogues = dialogues.select("conv_id", F.lit(0).cast("long").alias("segment"), "messages")
    if some:
        dialogues = dialogues.unionByName(segmented(rows.join(long, same, "left_semi"), segment_messages, system_roles))
    views = dialogues.join(who, F.col("conv_id").eqNullSafe(F.col("conv_")))

    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("<\\|"))
    name = lambda r: F.replace(plain(F.coalesce(r, F.lit("unknown"))), F.lit('"'), F.lit('\\"'))
    target = lambda m: F.coalesce(m["role"] == F.col("speaker"), F.lit(False))
    head = lambda m: (
        F.when(target(m), F.lit("<|assistant|>\n"))
        .when(is_system(m["role"], system_roles), F.lit("<|system|>\n"))
        .otherwise(F.concat(F.lit('<|user name="'), name(m["role"]), F.lit('"|>\n')))
    )
    parts = F.transform(
        "messages",
        lambda m: F.struct(head(m).alias("head"), F.concat(plain(m["text"]), F.lit(END)).alias("body"), target(m).alias("target")),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def next_span(state, p):
        begin = state["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.concat_ws("-", begin.cast("string"), end.cast("string"))
        return F.struct(
            end.cast("long").alias("at"), F.when(p["target"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans")
        )

    return views.withColumn("parts", parts).select(
        "conv_id",
        "segment",
        "speaker",
        F.size("parts").cast("long").alias("n_messages"),
        F.size(F.filter("parts", lambda p: p["target"])).cast("long").alias("n_targets"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        F.array_join(F.transform("parts", lambda p: F.when(p["target"], "1").otherwise("0")), "").alias("target_mask"),
        F.array_join(F.aggregate("parts", start, next_span)["spans"], ",").alias("target_spans"),
    )


PERSPECTIVES_SQL = rf"""
WITH n AS (
  SELECT conv_id, role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, coalesce(text, '')) - 1 AS i
  FROM conversations
), own AS (
  SELECT conv_id, CAST(i // {SEGMENT} AS BIGINT) AS segment, i, role, text FROM n
), carried AS (
  SELECT s.conv_id, s.segment, max(y.i) AS i FROM (SELECT DISTINCT conv_id, segment FROM own WHERE segment > 0) s
  JOIN n y ON y.conv_id IS NOT DISTINCT FROM s.conv_id AND y.role = 'system' AND y.i < s.segment * {SEGMENT} GROUP BY 1, 2
), t AS (
  SELECT * FROM own UNION ALL
  SELECT c.conv_id, c.segment, c.i, y.role, y.text FROM carried c JOIN n y ON y.conv_id IS NOT DISTINCT FROM c.conv_id AND y.i = c.i
), who AS (
  SELECT DISTINCT conv_id AS conv_, role AS speaker FROM n WHERE role IS NOT NULL AND role <> 'system'
), p AS (
  SELECT conv_id, segment, speaker, i, coalesce(role = speaker, false) AS target,
    CASE WHEN role = speaker THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10)
      ELSE '<|user name="' || replace(replace(coalesce(role, 'unknown'), '<|', '<\|'), '"', '\"') || '"|>' || chr(10) END AS head,
    replace(text, '<|', '<\|') || '<|end|>' || chr(10) AS body
  FROM t JOIN who ON conv_id IS NOT DISTINCT FROM conv_
), q AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, segment, speaker ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM p
)
SELECT conv_id, segment, speaker, count(*) AS n_messages, count(*) FILTER (WHERE target) AS n_targets,
  string_agg(head || body, '' ORDER BY i) AS rendered,
  string_agg(CASE WHEN target THEN '1' ELSE '0' END, '' ORDER BY i) AS target_mask,
  coalesce(string_agg(CASE WHEN target THEN CAST(pos + length(head) AS BIGINT) || '-' || CAST(pos + length(head) + length(body) AS BIGINT) END, ',' ORDER BY i), '') AS target_spans
FROM q GROUP BY conv_id, segment, speaker
"""
