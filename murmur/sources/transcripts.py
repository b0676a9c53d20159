"""Transcripts, turns, checkpoints and rendered texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur import schemas as S
from murmur.functions import text as T

TURNS = f"array<{S.TURN}>"


def _slug() -> Column:
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^/]*$", 1)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Stored transcripts, one JSON document in a file, with the slug from the file name."""
    return spark.read.schema(S.STORED_TRANSCRIPT).json(path, multiLine=True).withColumn("slug", _slug())


def write_transcripts(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def explode_segments(transcripts: DataFrame, key: str = "slug") -> DataFrame:
    return transcripts.select(key, F.posexplode("segments").alias("seg_idx", "s")).select(key, F.col("seg_idx").cast("long"), "s.*")


def turns_to_json(turns: Column) -> Column:
    return F.to_json(turns)


def turns_from_json(text: Column) -> Column:
    return F.from_json(text, TURNS)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Finished chunks (i, text, segments); bad lines are dropped, the last of equal chunks wins."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n", -1)).alias("line", "json"))
    row = F.from_json("json", S.CHECKPOINT, {"mode": "PERMISSIVE"})
    good = lines.withColumn("r", row).where("r.i is not null")
    return good.groupBy("r.i").agg(F.max_by("r", "line").alias("r")).select("r.i", "r.text", "r.segments")


def read_speakers(spark: SparkSession, path: str) -> DataFrame:
    """(name, embedding) from a JSON map; empty if there is no file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], S.SPEAKERS)
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<double>>")).alias("name", "embedding"))


def read_rendered(spark: SparkSession, path: str) -> DataFrame:
    """(slug, text) of rendered text files, whole."""
    return spark.read.text(path, wholetext=True).select(_slug().alias("slug"), F.col("value").alias("text"))


def paragraph_rows(docs: DataFrame, key: str = "slug", strip: bool = True) -> DataFrame:
    """(key, para_idx, text) of documents (key, text)."""
    return docs.select(key, F.posexplode(T.paragraphs(F.col("text"), strip)).alias("para_idx", "text")).withColumn("para_idx", F.col("para_idx").cast("long"))


def preferred_audio(episodes: DataFrame, files: DataFrame, key: str = "slug") -> DataFrame:
    """Adds audio: the opus file of an episode if there is one, else the first other. files: (key, path)."""
    opus = files.where(F.col("path").endswith(".opus")).groupBy(key).agg(F.min("path").alias("_opus"))
    other = files.where(~F.col("path").endswith(".opus")).groupBy(key).agg(F.min("path").alias("_other"))
    return episodes.join(opus, key, "left").join(other, key, "left").withColumn("audio", F.coalesce("_opus", "_other")).drop("_opus", "_other")
