"""Speaker vectors and sentence clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions import rules as R
from murmur.functions.vectors import cosine
from murmur.operators.scan import small, written


def cluster_means(turns: DataFrame, keys: list[str], least_s: float | None = R.LEAST_TURN_S) -> DataFrame:
    """(keys..., embedding): element-wise mean of a cluster's turn vectors, short turns left out.

    Elements are averaged by position, so partial sums combine before the exchange.
    """
    if least_s is not None and "start" in turns.columns:
        turns = turns.where(F.col("end") - F.col("start") >= least_s)
    flat = turns.select(*keys, F.posexplode("embedding").alias("_p", "_x")).groupBy(*keys, "_p").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return flat.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda x: x["_m"]).alias("embedding"))


#: Known vectors in one array, and bytes of a store that is broadcast.
STORE_ROWS, STORE_BYTES = 1000, 8 << 20


def match_speakers(clusters: DataFrame, known: DataFrame, threshold: float = R.SPEAKER_SIMILARITY, cluster="cluster") -> DataFrame:
    """(cluster, similarity, name): the most similar known speaker, or the cluster's own label.

    known: (name, known_idx, embedding), a store of named people.  The store is dealt into arrays of about STORE_ROWS vectors; a
    cluster meets each array, the best of each comes back, and the best of these counts.  The arrays are broadcast only if their counted
    size is small.  Not one to one; ties go to the first known; similarities that are not positive never match.
    """
    n, size = known.agg(F.count("*"), F.sum(F.size("embedding"))).first()
    blocks = max(1, -(-n // STORE_ROWS))
    deal = F.pmod(F.xxhash64("name", "known_idx"), F.lit(blocks)).cast("int").alias("_block")
    store = known.groupBy(deal).agg(F.collect_list(F.struct("known_idx", "name", F.col("embedding").cast("array<double>").alias("v"))).alias("_store"))
    store = F.broadcast(store) if (size or 0) * 8 <= STORE_BYTES else store
    rows = clusters.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(store, "_block", "left")
    scored = F.transform("_store", lambda k: F.struct(cosine(F.col("embedding").cast("array<double>"), k["v"]).alias("s"), (-k["known_idx"]).alias("i"), k["name"].alias("n")))
    rows = rows.withColumn("_best", F.array_max(F.filter(scored, lambda x: x["s"] > 0)))
    if blocks > 1:
        rows = rows.groupBy(cluster, "embedding").agg(F.max("_best").alias("_best"))
    return rows.select(cluster, F.coalesce("_best.s", F.lit(0.0)).alias("similarity"), F.when(F.col("_best.s") >= threshold, F.col("_best.n")).otherwise(F.col(cluster).cast("string")).alias("name"))


def upsert_speakers(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, embedding): new vectors replace those of the same name, others stay."""
    o, n = old.select("name", F.col("embedding").alias("_old")), new.select("name", F.col("embedding").alias("_new"))
    return o.join(n, "name", "full").select("name", F.coalesce("_new", "_old").alias("embedding"))


#: Rows of a block: a task compares two blocks of a scope.
BLOCK_ROWS = 1024


def similarity_pairs(rows: DataFrame, scope: str, index: str, threshold: float = R.SENTENCE_SIMILARITY) -> DataFrame:
    """(scope, i, j, similarity), i < j, within a scope such as a document.

    A scope is dealt into blocks by its counted rows, so a large one spreads over tasks; two blocks meet in one matrix product of unit
    vectors.  Vectors without length are similar to nothing.
    """
    size = rows.groupBy(scope).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_blocks"))
    r = rows.select(scope, F.col(index).alias("i"), F.col("embedding").cast("array<double>").alias("v")).join(size, scope)
    r = r.withColumn("_own", F.pmod(F.xxhash64("i"), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    r = r.select(scope, F.least("_own", "_other").alias("_x"), F.greatest("_own", "_other").alias("_y"), (F.col("_own") <= F.col("_other")).alias("_left"), "i", "v")
    kinds = dict(r.dtypes)

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        left = b[b["_left"]]
        right = b[~b["_left"]] if b["_x"].iloc[0] < b["_y"].iloc[0] else left
        if not len(left) or not len(right):
            return pd.DataFrame({scope: b[scope].iloc[:0], "i": b["i"].iloc[:0], "j": b["i"].iloc[:0], "similarity": np.zeros(0)})
        near = _units(left["v"]) @ _units(right["v"]).T
        at, to = np.nonzero(near >= threshold)
        i, j = left["i"].to_numpy()[at], right["i"].to_numpy()[to]
        out = pd.DataFrame({scope: b[scope].iloc[0], "i": np.minimum(i, j), "j": np.maximum(i, j), "similarity": near[at, to]})
        return out[i < j] if right is left else out[i != j]

    return r.groupBy(scope, "_x", "_y").applyInPandas(compare, f"{scope} {kinds[scope]}, i {kinds['i']}, j {kinds['i']}, similarity double")


def _units(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_list()).astype(np.float64)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


#: Links of a scope up to which one task joins them.
LOCAL_LINKS = 200_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node that each reaches) over links u, v, by union of trees with short paths."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = np.arange(len(nodes))
    a, b = at[: len(u)], at[len(u) :]
    while True:
        low = np.minimum(parent[a], parent[b])
        before = parent.copy()
        for x in (a, b):
            np.minimum.at(parent, before[x], low)
            np.minimum.at(parent, x, low)
        parent = parent[parent]
        if (parent == before).all():
            return nodes, nodes[parent]


def _stars(links: DataFrame, scope: str) -> DataFrame:
    """(scope, _n, component) over links (scope, u > v): alternating large-star and small-star steps (Kiveris et al., 2014).

    Every step is an aggregation and an equi-join, rounds are logarithmic in number, and each is written, so that lost executors can read it back.
    """
    e, last = written(links, "links"), None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64(scope, "u", "v").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
        last = state
        both = e.select(scope, "u", "v").union(e.select(scope, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(scope, "u").agg(F.min("v").alias("m")).select(scope, "u", F.least("u", "m").alias("m"))
        large = written(both.join(low, [scope, "u"]).where("v > u").select(scope, F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        least = large.groupBy(scope, "u").agg(F.min("v").alias("m"))
        small_ = large.join(least, [scope, "u"])
        small_ = small_.select(scope, "u", F.col("m").alias("v")).union(small_.select(scope, F.col("v").alias("u"), F.col("m").alias("v")))
        e = written(small_.where("u <> v").distinct(), "links")
    roots = e.select(scope, F.col("v").alias("_n"), F.col("v").alias("component")).distinct()
    return e.select(scope, F.col("u").alias("_n"), F.col("v").alias("component")).union(roots)


def link_components(nodes: DataFrame, pairs: DataFrame, scope: str, index: str, local: int | None = None) -> DataFrame:
    """(scope, index, component): smallest index reachable over pairs (scope, i, j).

    Scopes with few links are joined side by side, each by one task; links of larger scopes take star steps over the whole cluster.
    """
    links = written(pairs.where("i <> j").select(scope, F.greatest("i", "j").alias("u"), F.least("i", "j").alias("v")).distinct(), "links")
    many = links.groupBy(scope).agg(F.count("*").alias("_l")).where(F.col("_l") > (local or LOCAL_LINKS)).select(F.col(scope).alias("_scope"))
    many = written(many, "large-scopes")
    n = many.count()
    kinds = dict(links.dtypes)

    def join(b: pd.DataFrame) -> pd.DataFrame:
        at, low = forest(b["u"].to_numpy(), b["v"].to_numpy())
        return pd.DataFrame({scope: b[scope].iloc[0], "_n": at, "component": low})

    same = F.col(scope).eqNullSafe(F.col("_scope"))
    few = links.join(small(many, n), same, "left_anti") if n else links
    named = few.groupBy(scope).applyInPandas(join, f"{scope} {kinds[scope]}, _n {kinds['u']}, component {kinds['u']}")
    if n:
        named = named.unionByName(_stars(links.join(small(many, n), same, "left_semi"), scope))
    named = named.select(scope, F.col("_n").alias(index), "component")
    return nodes.select(scope, index).join(named, [scope, index], "left").select(scope, index, F.coalesce("component", index).alias("component"))


def keep_longest(rows: DataFrame, comps: DataFrame, scope: str, index: str, words: str = "words") -> DataFrame:
    """Rows of the longest text in each component, the first among equals."""
    r = rows.join(comps, [scope, index])
    best = F.row_number().over(Window.partitionBy(scope, "component").orderBy(F.desc(words), index))
    return r.withColumn("_b", best).where("_b = 1").drop("_b")
