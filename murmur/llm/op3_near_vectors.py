"""Near-duplicate embeddings: an exact metric range join over pivot cells.

* Identical vectors become one class (its smallest vec_id and its size), so copies never pair.
* Pivots come from a sample of fixed size, each the one farthest from those before; a class belongs to the cell of its
  nearest pivot.  How many are taken follows from the replication that the sample shows: more pivots make smaller
  cells but move more rows.  The number decides only speed.
* Two unit vectors with cosine >= c are at most ``chord = sqrt(2 - 2c)`` and ``arccos(c)`` apart.  By the triangle
  inequality a vector x of cell i can only have a partner in cell j if its distance to the plane that halves the way
  from pivot i to pivot j is at most that chord, and if its angle to pivot j is at most the radius of cell j (the
  largest angle of a class at home there) plus ``arccos(c)``; it is then replicated into cell j.
* A cell's own classes meet all that is in the cell, so each finds all of its partners there and
  cells are independent.  A large cell is cut into blocks of its own classes times blocks of all.
* A task returns, for each class, how many vectors it links with, and the edges of a spanning forest of the
  links it saw: never the pairs of a group.  Components follow from those edges.

Cosines are products of unit vectors in double precision.

Defined cases: vectors that are null, zero, or hold null or non-finite numbers link with nothing, have
n_links 0 and are their own component, and so do vectors without vec_id; shorter vectors are padded with zeros; rows that repeat
count as vectors of their own; different vectors of one vec_id link like any others and are one place in the components, which
are named by vec_id; very long vectors are read whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import Scratch, components, table
from murmur.llm.vectors import dimension, float_kind, pack, unpack

THRESHOLD = 0.95
BLOCK = 8192
#: Least and most pivots: what every task holds of them is bounded.  Cells of any size are cut into blocks.
FEW, MAX_PIVOTS = 8, 1024
#: Classes that the driver looks at to pick pivots.
SAMPLE = 4096
#: Moving a row costs about as much as so many comparisons.
MOVE = 2000


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def farthest_first(sample: np.ndarray, count: int) -> np.ndarray:
    """count rows of the sample, the first one and then always the one farthest from those taken; equal rows are taken once."""
    taken, near = [0], sample @ sample[0]
    while len(taken) < min(count, len(sample)) and near.min() < 1 - 1e-12:
        taken.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[taken[-1]])
    return sample[taken]


class Cells:
    """Pivots, and which cells a vector must be in; without radii the cells have no bound but their planes."""

    def __init__(self, pivots: np.ndarray, threshold: float, least: np.ndarray | None = None):
        self.pivots = pivots
        self.chord = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
        apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
        np.fill_diagonal(apart, 1)
        self.apart = np.maximum(apart, 1e-12)
        if least is None:
            self.reach = np.full(len(pivots), -2.0)
        else:
            angle = np.arccos(np.clip(least, -1, 1)) + math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
            self.reach = np.where(angle >= math.pi, -2.0, np.cos(np.minimum(angle, math.pi)))

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cosines with the pivots, home cells, table of the cells that hold x)."""
        near = x @ self.pivots.T
        home = near.argmax(1)
        gap = near[np.arange(len(x)), home][:, None] - near
        held = (gap <= self.chord * self.apart[home] + 1e-9) & (near >= self.reach)
        held[np.arange(len(x)), home] = True
        return near, home, held


def choose_pivots(sample: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """As many pivots as make comparisons and moved rows of n classes least, by the replication of the sample."""
    order = farthest_first(sample, MAX_PIVOTS)
    counts = [min(len(order), FEW << i) for i in range((MAX_PIVOTS // FEW).bit_length())]

    def cost(c: int) -> float:
        copies = np.mean([Cells(order[:c], threshold).of(sample[lo : lo + 512])[2].sum(1).mean() for lo in range(0, len(sample), 512)])
        return copies * (MOVE + n / c)

    return order[: min(sorted(set(counts)), key=cost)]


def _parts(batches: Iterator[pd.DataFrame], kind: str) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for b in batches:
        for lo in range(0, len(b), 1024):
            part = b.iloc[lo : lo + 1024].reset_index(drop=True)
            yield part, _unit(unpack(part["vec"], kind))


def radii(classes: DataFrame, pivots: np.ndarray, kind: str, threshold: float) -> np.ndarray:
    """For each cell the least cosine of a class at home there with its pivot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, least = Cells(pivots, threshold), np.full(len(pivots), 2.0)
        for _, x in _parts(batches, kind):
            near, home, _ = cells.of(x)
            np.minimum.at(least, home, near[np.arange(len(x)), home])
        at = np.flatnonzero(least < 2)
        yield pd.DataFrame({"cell": at.astype("int32"), "least": least[at]})

    out = np.ones(len(pivots))
    found = classes.select("vec").mapInPandas(run, "cell int, least double").groupBy("cell").agg(F.min("least").alias("least"))
    for r in found.collect():  # at most MAX_PIVOTS rows
        out[r["cell"]] = r["least"]
    return out


def assign(classes: DataFrame, cells: Cells, kind: str) -> DataFrame:
    """(id, size, vec, cell, own): the home cell and the cells of replication."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in _parts(batches, kind):
            _, home, held = cells.of(x)
            r, c = np.nonzero(held)
            out = part.iloc[r].reset_index(drop=True)
            out["cell"] = c.astype("int32")
            out["own"] = home[r] == c
            yield out

    return classes.mapInPandas(run, "id long, size long, vec binary, cell int, own boolean")


def _links(kind: str, threshold: float):
    def run(b: pd.DataFrame) -> pd.DataFrame:
        left, right = b[b["role"] == 0], b[b["role"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "h": [], "b": [], "n": []}).astype({"a": "int64", "h": "int64", "b": "Int64", "n": "int64"})
        x, y = _unit(unpack(left["vec"], kind)), _unit(unpack(right["vec"], kind))
        xid, yid, size = left["id"].to_numpy(), right["id"].to_numpy(), right["size"].to_numpy()
        xh, yh = left["h"].to_numpy(), right["h"].to_numpy()  # different vectors of one vec_id may link
        nodes, at = np.unique(np.concatenate([xid, yid]), return_inverse=True)
        xat, yat = at[: len(xid)], at[len(xid) :]
        parent = np.arange(len(nodes))
        total = np.zeros(len(xid), dtype=np.int64)
        for lo in range(0, len(x), 512):
            near = x[lo : lo + 512] @ y.T >= threshold
            near &= (xid[lo : lo + 512, None] != yid[None, :]) | (xh[lo : lo + 512, None] != yh[None, :])
            total[lo : lo + 512] = near @ size
            for i in np.flatnonzero(near.any(1)):
                groups = np.unique(np.append(parent[yat[near[i]]], parent[xat[lo + i]]))
                if len(groups) > 1:
                    parent[np.isin(parent, groups)] = groups[0]
        linked = np.flatnonzero(parent != np.arange(len(nodes)))
        counts = pd.DataFrame({"a": xid, "h": xh, "b": pd.array([None] * len(xid), dtype="Int64"), "n": total})
        edges = pd.DataFrame({"a": nodes[linked], "h": 0, "b": pd.array(nodes[parent[linked]], dtype="Int64"), "n": 0})
        return pd.concat([counts[counts["n"] > 0], edges])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    scratch, kind, dim = Scratch(spark, "vectors"), float_kind(vectors), max(dimension(vectors), 1)
    zero = bytes(dim * int(kind[-1]))
    packed = scratch.write(pack(vectors, dim, kind).withColumn("vec", F.when((F.col("vec") != F.lit(zero)) & F.col("vec_id").isNotNull(), F.col("vec"))), "packed")
    classes = packed.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"))
    classes = scratch.write(classes.select("id", "size", "vec"), "classes")
    n = classes.count()
    if n == 0:
        return packed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = classes.orderBy(F.xxhash64("id"), "id", "vec").limit(SAMPLE).select("vec").toPandas()
    pivots = choose_pivots(_unit(unpack(sample["vec"], kind)), n, threshold)
    cells = scratch.write(assign(classes, Cells(pivots, threshold, radii(classes, pivots, kind, threshold)), kind), "cells")
    sizes = cells.groupBy("cell").agg(F.sum(F.col("own").cast("int")).alias("own"), F.count("*").alias("all_")).collect()  # at most MAX_PIVOTS rows
    shape = spark.createDataFrame([(r["cell"], max(1, -(-r["own"] // BLOCK)), max(1, -(-r["all_"] // BLOCK))) for r in sizes], "cell int, rows int, cols int")
    c = cells.join(F.broadcast(shape), "cell")
    i = F.pmod(F.xxhash64("id"), F.col("rows")).cast("int")
    j = F.pmod(F.xxhash64("id", F.lit(1)), F.col("cols")).cast("int")
    last = lambda n: F.col(n) - 1
    left = c.where("own").withColumn("i", i).withColumn("j", F.explode(F.sequence(F.lit(0), last("cols")))).withColumn("role", F.lit(0))
    right = c.withColumn("j", j).withColumn("i", F.explode(F.sequence(F.lit(0), last("rows")))).withColumn("role", F.lit(1))
    cols = ["cell", "i", "j", "role", "id", "size", "vec", F.xxhash64("vec").alias("h")]
    found = left.select(cols).unionByName(right.select(cols)).groupBy("cell", "i", "j").applyInPandas(_links(kind, threshold), "a long, h long, b long, n long")
    found = scratch.write(found, "found")
    links = found.where("b is null").groupBy(F.col("a").alias("id"), "h").agg(F.sum("n").alias("n"))
    # A vec_id that names several vectors joins their classes, also where it is not the one that names a class.
    shared = packed.where("vec is not null").groupBy("vec_id").agg(F.min("vec").alias("least"), F.max("vec").alias("most")).where("least <> most").select("vec_id")
    shared = scratch.write(shared, "shared")
    bonds = packed.where("vec is not null").join(shared, "vec_id", "left_semi").distinct() if shared.limit(1).count() else None
    edges = found.where("b is not null").select("a", "b")
    comp = components(edges if bonds is None else edges.unionByName(bonds.join(classes, "vec").select(F.col("vec_id").alias("a"), F.col("id").alias("b"))), scratch)
    per = classes.withColumn("h", F.xxhash64("vec")).join(links, ["id", "h"], "left").join(comp, F.col("id") == F.col("node"), "left").select(
        "vec", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    per = scratch.write(per, "per-class")
    return packed.join(per, "vec", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from r join l on r.b = l.a),
c as (select a as vec_id, min(b) as component_id from r group by a),
n as (select a as vec_id, count(*) as n from l group by a)
select c.vec_id, coalesce(n.n, 0) as n_links, component_id, c.vec_id = component_id as kept from c left join n on n.vec_id = c.vec_id
"""
