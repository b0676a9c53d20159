"""Incremental stages: what is pending, what is done, and publishing of results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.functions import text as T
from murmur.session import one_off


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base or os.path.join(tempfile.gettempdir(), "murmur-checkpoints")


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """df as a table in the shared folder: later jobs start from it, a lost executor costs only its tasks, and what is appended to its sources meanwhile
    does not change it.  It goes when the driver ends, as a lazy result may read it until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with one_off(spark):
        df.write.parquet(path)
    fs, p = _files(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def pending(inputs: DataFrame, outputs: DataFrame, on: str | list[str], redo: bool = False) -> DataFrame:
    """Inputs that have no output yet; all of them with redo."""
    return inputs if redo else inputs.join(outputs, on, "left_anti")


def episode_numbering(feed: DataFrame, order: list[str], title="title") -> DataFrame:
    """Adds number (from 1, over all feeds in order) and slug.

    Numbers need one order over everything: rows are first counted by feed, and numbered within each
    feed, so that no task sorts all feeds.
    """
    first, *rest = order
    sizes = feed.groupBy(first).agg(F.count("*").alias("_n"))
    before = sizes.select(F.col(first).alias("_f"), (F.sum("_n").over(Window.orderBy(first)) - F.col("_n")).alias("_before"))  # one row for each feed
    place = F.row_number().over(Window.partitionBy(first).orderBy(*rest)).cast("long")
    out = feed.withColumn("_i", place).join(before, F.col(first) == F.col("_f")).withColumn("number", F.col("_i") + F.col("_before"))
    return out.drop("_i", "_before", "_f").withColumn("slug", T.episode_slug(F.col("number"), F.col(title)))


def select_episode(episodes: DataFrame, number: int | None) -> DataFrame:
    """The episode of a number, or all of them without one; an unknown number raises."""
    if number is None:
        return episodes
    one = episodes.where(F.col("number") == number)
    if not one.limit(1).count():
        raise ValueError(f"episode {number} not found")
    return one


def episode_status(episodes: DataFrame, texts: DataFrame, diarized: DataFrame, on: str) -> DataFrame:
    """Adds status: t and d where the text and the diarized text exist, - where not."""
    t = texts.select(on).distinct().withColumn("_t", F.lit("t"))
    d = diarized.select(on).distinct().withColumn("_d", F.lit("d"))
    return episodes.join(t, on, "left").join(d, on, "left").withColumn("status", F.concat(F.coalesce("_t", F.lit("-")), F.coalesce("_d", F.lit("-")))).drop("_t", "_d")


def savings(before: Column, after: Column) -> list[Column]:
    """chars_before, chars_after and pct_removed."""
    a, b = F.length(before).cast("long"), F.length(after).cast("long")
    return [a.alias("chars_before"), b.alias("chars_after"), F.round(F.when(a > 0, 100.0 * (a - b) / a).otherwise(0.0), 6).alias("pct_removed")]


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Publishes new rows; the commit protocol makes them visible at once."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _files(spark: SparkSession, *paths: str):
    """The file system of the first path, and the paths on it."""
    ps = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return ps[0].getFileSystem(spark._jsc.hadoopConfiguration()), *ps


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file on any file system."""
    fs, p = _files(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stage's table, empty before its first run; the path may be on any file system."""
    fs, p, old = _files(spark, path, path + ".old")
    if not fs.exists(p) and fs.exists(old):
        fs.rename(old, p)  # a driver was lost while it replaced the table
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Puts df in the place of a table, which df may read; a driver lost on the way leaves a whole copy."""
    df.write.mode("overwrite").parquet(path + ".next")
    fs, p, new, old = _files(df.sparkSession, path, path + ".next", path + ".old")
    if fs.exists(p):
        fs.delete(old, True)
        fs.rename(p, old)
    fs.rename(new, p)
    fs.delete(old, True)


def run_stage(inputs: DataFrame, path: str, schema: str, on: str | list[str], work, redo: bool = False, dry_run: bool = False) -> DataFrame:
    """Runs ``work`` on the pending inputs and appends; dry_run only returns what would run."""
    spark = inputs.sparkSession
    todo = pending(inputs, read_or_empty(spark, path, schema), on, redo)
    if not dry_run:
        append(work(todo), path)
    return todo
