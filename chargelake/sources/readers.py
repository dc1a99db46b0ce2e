"""Reading sessions from files of several formats, writing tables, and keeping results by their configuration."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.schema import validate


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where that is unset, a temporary folder on a local master; on any other this raises, as no folder of one machine would do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="chargelake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Folders of the tables that operators have written, by application.
_folders: dict[str, list[str]] = {}


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in a new shared folder: computed once, and safe from lost executors.

    The table stays until ``drop_written``, as what an operator returns may read it.
    """
    path = shared_folder(df.sparkSession)
    _folders.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Delete the tables that operators have written for this application, and say how many: once their results are saved or no
    longer wanted."""
    folders = _folders.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    return len(folders)


def separator(spark: SparkSession, path: str) -> str:
    """Of a CSV: semicolon if the first lines have more of them than commas.  A .tsv has tabs."""
    if path.endswith(".tsv"):
        return "\t"
    head = "\n".join(r[0] for r in spark.read.text(path).limit(20).collect())
    return ";" if head.count(";") > head.count(",") else ","


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """A table by its extension: csv, tsv, json (one array of records), jsonl, parquet.

    ``schema``: of JSON, which is then read once; without it Spark reads all of it before, to infer one.
    """
    schema = options.pop("schema", None)
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv"):
        sep = options.pop("sep", None) or separator(spark, path)
        return spark.read.options(header=True, sep=sep, **options).csv(path)
    if kind == "json":
        return spark.read.options(multiLine=True, **options).json(path, schema)
    if kind in ("jsonl", "ndjson"):
        return spark.read.options(**options).json(path, schema)
    if kind in ("parquet", "pq"):
        return spark.read.options(**options).parquet(path)
    raise ValueError(f"no reader for .{kind}")


def decimal_comma(df: DataFrame, *columns: str) -> DataFrame:
    """Text with decimal commas to numbers; what is no number becomes null."""
    return df.withColumns({c: F.regexp_replace(F.col(c), ",", ".").try_cast("double") for c in columns})


def local_series(df: DataFrame, ts: str, value: str, year: int | None = None) -> DataFrame:
    """``ts, value`` from text: local time as written, whatever zone follows it, decimal commas, and one year only if given.

    Rows whose time can't be read go; a value that is no number is null.
    """
    local = F.regexp_extract(F.col(ts), r"^\s*(\d{4}-\d\d-\d\d)[ T](\d\d:\d\d(?::\d\d)?)", 0)
    at = F.try_to_timestamp(F.regexp_replace(F.trim(local), "T", " ")).cast("timestamp_ntz")
    number = F.regexp_replace(F.col(value).cast("string"), ",", ".").try_cast("double")
    out = df.select(at.alias("ts"), number.alias("value")).filter("ts is not null")
    return out if year is None else out.filter(F.year("ts") == year)


def load_sessions(
    spark: SparkSession, source: str | DataFrame, strict: bool = False, filter_failed: bool = True, decimal_commas: tuple[str, ...] = (), **options
) -> DataFrame:
    """Validated sessions from a path or a DataFrame."""
    df = source if isinstance(source, DataFrame) else read_table(spark, source, **options)
    return validate(decimal_comma(df, *decimal_commas), strict, filter_failed)


def load_datasets(spark: SparkSession, sources: dict[str, str | DataFrame], exclude: tuple[str, ...] = ()) -> DataFrame:
    """Several tables as one with a column ``dataset``: one job over all of them."""
    out: DataFrame | None = None
    for name, source in sources.items():
        if name in exclude:
            continue
        one = load_sessions(spark, source).withColumn("dataset", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no datasets are left")
    return out


def export(df: DataFrame, path: str, **options) -> None:
    """Write by extension: csv, tsv, json (lines), parquet."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    writer = df.write.mode("overwrite").options(**options)
    if kind in ("csv", "tsv"):
        writer.options(header=True, sep=options.get("sep", "\t" if kind == "tsv" else ",")).csv(path)
    elif kind in ("json", "jsonl"):
        writer.json(path)
    elif kind in ("parquet", "pq"):
        writer.parquet(path)
    else:
        raise ValueError(f"no writer for .{kind}")


def config_hash(config: dict, datasets: list[str]) -> str:
    text = json.dumps({"config": config, "datasets": sorted(datasets)}, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def cached_table(spark: SparkSession, build: Callable[[], DataFrame], config: dict, datasets: list[str], folder: str, force: bool = False) -> DataFrame:
    """The result for a configuration and its set of datasets: read if it is there, else built and written.

    The configuration lies beside the table as one line of JSON, in ``<hash>.config.json``.
    """
    path = f"{folder}/{config_hash(config, datasets)}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if force or not there:
        text = json.dumps({"config": config, "datasets": sorted(datasets)}, sort_keys=True, default=str)
        spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}.config.json")
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cached_cells(spark: SparkSession, build: Callable[[DataFrame], DataFrame], cells: DataFrame, keys: list[str], config: dict, folder: str) -> DataFrame:
    """The results of ``cells`` (``keys``) for a configuration: only cells that aren't there yet are built, and added.

    ``build`` gets the missing cells and returns their rows, with ``keys``; a cell may have none.  Rows are written before the
    manifest that lists their cells, under a name of their own, so a run that breaks off leaves nothing that would be read.
    """
    path = f"{folder}/{config_hash(config, [])}"
    manifest = f"{path}/manifest"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    wanted = cells.select(*keys).distinct()
    missing = written(wanted.join(spark.read.parquet(manifest), keys, "left_anti") if there else wanted)
    if not missing.isEmpty():
        run = uuid.uuid4().hex
        build(missing).write.parquet(f"{path}/rows/run={run}")
        missing.withColumn("run", F.lit(run)).write.mode("append").parquet(manifest)
    done = spark.read.parquet(manifest).join(wanted, keys, "left_semi")
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").withColumn("run", F.col("run").cast("string"))
    return rows.join(done, [*keys, "run"], "left_semi").drop("run")
