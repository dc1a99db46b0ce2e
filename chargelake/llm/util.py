"""Helpers shared by the operators: scratch tables and Arrow batch functions."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is unset a temporary folder is taken and set, but only on a local master; elsewhere no folder of
    one machine would do, so this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="chargelake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def table_written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: cuts lineage and survives lost executors.

    The job's shuffle files go when the table is complete.
    """
    spark = df.sparkSession
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables written for one run of an operator.  ``clean`` deletes those that no later step reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, {}

    def save(self, df: DataFrame, name: str = "") -> DataFrame:
        """With a name, the table takes the place of an earlier one of that name at the next ``clean``."""
        folder = scratch_dir(self.spark)
        self.folders.setdefault(name or folder, []).append(folder)
        return table_written(df, folder)

    def clean(self, *names: str) -> None:
        """Delete the tables with these names, the last table of any other repeated name stays."""
        jvm = self.spark.sparkContext._jvm
        for name, folders in self.folders.items():
            while folders and (name in names or len(folders) > 1):
                path = jvm.org.apache.hadoop.fs.Path(folders.pop(0))
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 4) -> None:
    """Lower the session's limits on Arrow batches to ``rows`` rows and ``megabytes``.

    Texts are wide rows of very different lengths, and a Python worker holds a batch several times over; the
    defaults (10,000 rows, 64 MB) are for narrow ones.  Spark reads these settings when a job starts, so they are set for
    the session and stay; limits that are lower already are kept.
    """
    now = int(spark.conf.get(BATCH_ROWS))
    if now <= 0 or now > rows:
        spark.conf.set(BATCH_ROWS, str(rows))
    now = spark.conf.get(BATCH_BYTES).rstrip("bB")
    if not now.isdigit() or int(now) > megabytes << 20:
        spark.conf.set(BATCH_BYTES, str(megabytes << 20))


def arrow_map(
    df: DataFrame, batch_rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType
) -> DataFrame:
    """``mapInArrow`` in batches that fit texts."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(batch_rows, schema)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs run inside."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, min(int(before), rows) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def with_columns_last(df: DataFrame, added: list[str], prefix: str = "in_") -> DataFrame:
    """Rename columns of ``df`` that clash with those an operator adds: ``n`` becomes ``in_n``."""
    taken, out = set(df.columns), df
    for name in added:
        if name in taken:
            new = prefix + name
            while new in taken:
                new = prefix + new
            out, taken = out.withColumnRenamed(name, new), (taken - {name}) | {new}
    return out


def doc_crc_mod(doc_id: str | F.Column, mod: int) -> F.Column:
    """crc32 of the id's decimal text modulo ``mod``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def chosen_labels(labels: DataFrame, target: str, limit: int, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, target_`` of at most ``limit`` labelled ids; the bound makes a broadcast of them safe.

    Of all labels with an id and a value of 0 or 1 those with the smallest hashes of their id are taken, so the choice
    doesn't depend on the order of rows; of several labels of one id the largest counts.
    """
    return (
        labels.filter(F.col(doc_id).isNotNull() & F.col(target).isin(0, 1))
        .groupBy(doc_id)
        .agg(F.max(target).cast("double").alias("target_"))
        .orderBy(F.xxhash64(doc_id), doc_id)
        .limit(limit)
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, limit: int, doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, text, target_``: one document for each of ``chosen_labels``, of several rows of an id the smallest text."""
    chosen = F.broadcast(chosen_labels(labels, target, limit, doc_id))
    found = docs.select(doc_id, "text").join(chosen, doc_id)
    return found.groupBy(doc_id).agg(F.min("text").alias("text"), F.first("target_").alias("target_"))
