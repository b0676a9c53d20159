"""What the operators of this subpackage share: reading, shared scratch tables, components."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.session import one_off

#: A side is broadcast only if its counted rows times its width stay below this.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set and all runs on this machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "murmur-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Rows and bytes of an Arrow batch of texts; Spark's own default of 10,000 rows bounds no bytes of long texts.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def text_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches between the JVM and the Python workers, for plans made from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder.

    A written table cuts the lineage: a lost executor costs the tasks it ran and not the stages
    before; the shuffles that made it go at once.  ``drop`` removes a table that no later step reads; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, tuple[DataFrame, str]] = {}  # holds the frames, so that no other one gets their ids
        if _open():
            _open()[-1].append(self)

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}-{name}"
        with one_off(self.spark):
            df.write.mode("overwrite").parquet(path)
        if self._n == 1:
            fs, p = self._files(self.root)
            fs.deleteOnExit(p)  # a lazy result may read them until the driver ends
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = out, path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if id(df) in self._paths:
                self._delete(self._paths.pop(id(df))[1])

    def drop_all(self) -> None:
        self._paths.clear()
        self._delete(self.root)

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _delete(self, path: str) -> None:
        fs, p = self._files(path)
        fs.delete(p, True)


_local = threading.local()


def _open() -> list[list[Scratch]]:
    """The open blocks of this thread."""
    if not hasattr(_local, "blocks"):
        _local.blocks = []
    return _local.blocks


@contextmanager
def temporary() -> Iterator[None]:
    """The scratch tables that are made inside go at the end of the block: its result must have been written by then."""
    _open().append([])
    try:
        yield
    finally:
        for s in _open().pop():
            s.drop_all()


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint if the counted size is below the bound; else the planner's own choice (a shuffle join)."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def fresh(df: DataFrame, name: str) -> str:
    """The name with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Bits of the map that thins rows before a join: 2**23 bits are 1 MB, whatever the number of keys.
MAP_BITS = 23


def divided(rows: DataFrame, keys: list[str], marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that are surely not among marks, the rest): a reducer of fixed size before a join on keys.

    The keys of marks are hashed into a bit map of fixed size, kept as at most 2**(MAP_BITS - 6) rows of 64 bits and
    broadcast.  Rows whose bit is not set need no exchange; the join that follows decides about the others.  With very
    many keys all bits are set and every row is among the rest, so the result never depends on it.
    """
    at, word, bits = fresh(rows, "_place"), fresh(rows, "_word"), fresh(rows, "_bits")
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << MAP_BITS))
    bit = lambda c: F.expr(f"shiftleft(1L, cast(`{c}` % 64 as int))")
    number = lambda c: F.floor(F.col(c) / 64).cast("int")
    set_ = marks.select(place.alias(at)).groupBy(number(at).alias(word)).agg(F.bit_or(bit(at)).alias(bits))
    out = rows.withColumn(at, place).withColumn(word, number(at)).join(F.broadcast(set_), word, "left")
    hit = F.coalesce(F.col(bits).bitwiseAND(bit(at)) != 0, F.lit(False))
    return out.where(~hit).select(rows.columns), out.where(hit).select(rows.columns)


def thinned(rows: DataFrame, keys: str | list[str], among: DataFrame) -> DataFrame:
    """rows without most of those whose keys are not in among."""
    return divided(rows, [keys] if isinstance(keys, str) else keys, among)[1]


def keyed(docs: DataFrame, did: str = "did", th: str = "th") -> DataFrame:
    """docs with the key of a row: (did, th), its id (0 for null) and a hash of its text and of whether it has an id.

    Rows share a key only if they have the same id and text: among the rows of one id, but for a 64-bit chance of the SHA-256 of their texts.
    """
    return docs.withColumn(did, F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))).withColumn(th, F.xxhash64(F.sha2("text", 256), F.col("doc_id").isNull()))


def texts_of(docs: DataFrame, among: DataFrame) -> DataFrame:
    """(did, th, text) of the rows (did, th, text) whose key is in among, each key once however often its row repeats."""
    return thinned(docs, ["did", "th"], among).select("did", "th", "text").dropDuplicates(["did", "th"])


MANY_EDGES = 5_000_000


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): smallest node reachable over links (a, b), for nodes that have a link.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step is an
    aggregation and an equi-join, the number of rounds is logarithmic, and edges never multiply.
    Each round is written to the shared folder.
    """
    e = scratch.write(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while state[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # With many edges the least neighbours are written, so that both sides of a join are plain exchanges and the root of a large
        # component can be split; with few that would only cost jobs.
        settle = scratch.write if state[0] > MANY_EDGES else lambda df, _: df
        low = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = settle(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")
        )
        new = scratch.write(small.select("x.u", "x.v").where("u <> v").distinct(), "edges")
        scratch.drop(e, low, large, least)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
