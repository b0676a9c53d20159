"""Clusters of near vectors within a scope, by links instead of pairs.

Rows of one vector are one class, compared once, so a sentence that is said a million times costs one row.  Scopes of up to ``BLOCK_ROWS``
classes are compared whole, many of them in one call.  Larger scopes are dealt into cells, each class to the nearest of its scope's pivots; if two
classes in cells x and y lie within the angle t of the threshold, the triangle inequality gives angle(a, y) <= angle(a, x) + 2 t, so
a class calls only at cells for which this holds.  Python names the cells of a class; Spark repeats its row for them.  A cell deals its residents and its callers into blocks, which meet in
matrix products; each meeting hands on a spanning forest of its links, so what leaves a task is bounded by the rows that entered it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions import rules as R
from murmur.operators.scan import small, written
from murmur.operators.vectors import BLOCK_ROWS, forest, link_components

#: Expected pivots of a scope, at most; classes that one task deals to cells, in blocks; slack of angles against rounding.
MAX_PIVOTS, DEALT_BLOCKS, SLACK = 1024, 8, 1e-6


def near_components(rows: DataFrame, scope: str, index: str, threshold: float = R.SENTENCE_SIMILARITY, block: int | None = None) -> DataFrame:
    """(scope, index, component): smallest index reachable over pairs of a scope whose cosine is at least the threshold.

    rows: (scope, index, embedding), index unique in its scope; other columns are ignored.  Vectors that are null, zero or
    hold null or non-finite numbers, and rows without scope, link with nothing.  Shorter vectors are padded with zeros.  Equal vectors
    are linked at every threshold up to 1.  An empty table gives no rows.
    """
    block = block or BLOCK_ROWS
    v = F.col("embedding").cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col(scope).isNotNull()
    nodes = written(rows.select(F.col(scope).alias("_s"), F.col(index).alias("_i"), F.when(usable, v).alias("_v")), "nodes")
    classes = written(nodes.where("_v is not null and _i is not null").groupBy("_s", "_v").agg(F.min("_i").alias("_i")), "classes")
    sizes = classes.groupBy("_s").agg(F.count("*").alias("_n"), F.min("_i").alias("_first")).where(F.col("_n") > block)
    large = written(sizes, "large-scopes")
    n = large.count()
    few = classes.join(small(large.select("_s"), n), "_s", "left_anti") if n else classes
    kinds = dict(classes.dtypes)
    bundles = -(-classes.count() // (block * DEALT_BLOCKS)) or 1
    bundled = few.withColumn("_c", F.pmod(F.xxhash64("_s"), F.lit(bundles)).cast("int"))
    named = bundled.groupBy("_c").applyInPandas(_whole(threshold), f"_s {kinds['_s']}, _v array<double>, component {kinds['_i']}")
    if n:
        big = written(classes.join(small(large, n), "_s"), "large")
        comps = link_components(big.select("_s", "_i"), _large_links(big, threshold, block), "_s", "_i")
        named = named.unionByName(big.join(comps, ["_s", "_i"]).select("_s", "_v", "component"))
    out = nodes.join(named, ["_s", "_v"], "left")
    return out.select(F.col("_s").alias(scope), F.col("_i").alias(index), F.coalesce("component", "_i").alias("component"))


def _large_links(rows: DataFrame, threshold: float, block: int) -> DataFrame:
    """(_s, i, j): forests of the links of scopes with many classes; rows: (_s, _i, _v, _n, _first)."""
    kinds = dict(rows.dtypes)
    # About one pivot for each block, drawn by a hash; the first class is one in any case.
    draw = F.pmod(F.xxhash64("_i", F.lit("pivot")), F.lit(1 << 30)) / float(1 << 30)
    drawn = (draw < F.least(F.lit(float(MAX_PIVOTS)), F.col("_n") / block) / F.col("_n")) | (F.col("_i") == F.col("_first"))
    parts = F.ceil(F.col("_n") / (block * DEALT_BLOCKS)).cast("int")
    pivots = rows.where(drawn).select("_s", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_c"), F.col("_i").alias("_p"), F.col("_v").alias("_pv"))
    dealt = rows.select("_s", F.pmod(F.xxhash64("_i"), parts).cast("int").alias("_c"), "_i", "_v")
    to_cells = _dealer(float(np.arccos(np.clip(threshold, -1, 1))), block)
    cell = f"array<{kinds['_i']}>"
    calls = dealt.groupBy("_s", "_c").cogroup(pivots.groupBy("_s", "_c")).applyInPandas(
        to_cells, f"_s {kinds['_s']}, _own {kinds['_i']}, _cells {cell}, _i {kinds['_i']}, _v array<double>"
    )
    calls = written(calls, "visits").select("_s", F.explode("_cells").alias("_cell"), "_own", "_i", "_v").withColumn("_own", F.col("_own") == F.col("_cell"))
    calls = written(calls, "calls")
    blocks = lambda x: F.ceil(x / block).cast("int")
    cells = calls.groupBy("_s", "_cell").agg(blocks(F.sum(F.col("_own").cast("int"))).alias("_a"), blocks(F.count("*")).alias("_b"))
    cells = written(cells, "cells")
    at = calls.join(small(cells, cells.count()), ["_s", "_cell"])
    place = lambda n, salt: F.pmod(F.xxhash64("_i", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    live = at.where("_own").withColumn("_x", place("_a", "x")).withColumn("_y", every("_b")).withColumn("_home", F.lit(True))
    call = at.withColumn("_x", every("_a")).withColumn("_y", place("_b", "y")).withColumn("_home", F.lit(False))
    both = live.unionByName(call).select("_s", "_cell", "_x", "_y", "_home", "_i", "_v")
    return both.groupBy("_s", "_cell", "_x", "_y").applyInPandas(_meet(threshold), f"_s {kinds['_s']}, i {kinds['_i']}, j {kinds['_i']}")


def _units(*sides: pd.Series) -> list[np.ndarray]:
    """Unit vectors of each side, padded to one length."""
    width = max((len(v) for s in sides for v in s), default=0)
    out = []
    for s in sides:
        x = np.zeros((len(s), width))
        for row, v in zip(x, s):
            row[: len(v)] = v
        x /= np.maximum(np.abs(x).max(1, keepdims=True, initial=0), 1e-308)  # so that squares neither overflow nor vanish
        out.append(x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300))
    return out


def _dealer(angle: float, block: int):
    """Each class with its own cell and the cells that it visits: one row, whose vector is repeated for the cells only outside of Python."""

    def deal(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        pivots = pivots.sort_values("_p")
        names, cells, owns = pivots["_p"].to_numpy(), [], [pivots["_p"].to_numpy()[:0]]
        for lo in range(0, len(rows), block):
            x, p = _units(rows["_v"].iloc[lo : lo + block], pivots["_pv"])
            far = np.arccos(np.clip(x @ p.T, -1, 1))
            own = far.argmin(1)
            # Of two cells the one with the smaller pivot is called at; a pair in one cell meets there.
            visit = (far <= far[np.arange(len(x)), own][:, None] + 2 * angle + SLACK) & (np.arange(len(p)) <= own[:, None])
            cells += [names[to] for to in visit]
            owns.append(names[own])
        return pd.DataFrame({"_s": rows["_s"], "_own": np.concatenate(owns), "_cells": cells, "_i": rows["_i"], "_v": rows["_v"]})

    return deal


def _links(near: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node that each reaches) where rows i and columns j are near."""
    at, to = np.nonzero(near)
    i, j = i[at], j[to]
    return forest(i[i != j], j[i != j])


def _whole(threshold: float):
    """Components of the scopes of a bundle, one after the other."""

    def name(b: pd.DataFrame) -> pd.DataFrame:
        order = pd.factorize(b["_s"])[0].argsort(kind="stable")
        b = b.iloc[order]
        s, own = pd.factorize(b["_s"])[0], b["_i"].to_numpy()
        out = own.copy()
        cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo > 1:
                (x,) = _units(b["_v"].iloc[lo:hi])
                node, low = _links(x @ x.T >= threshold, own[lo:hi], own[lo:hi])
                if len(node):
                    at = np.minimum(np.searchsorted(node, own[lo:hi]), len(node) - 1)
                    out[lo:hi] = np.where(node[at] == own[lo:hi], low[at], own[lo:hi])
        return pd.DataFrame({"_s": b["_s"], "_v": b["_v"], "component": out})

    return name


def _meet(threshold: float):
    """A spanning forest of the links between residents and callers."""

    def meet(b: pd.DataFrame) -> pd.DataFrame:
        home, call = b[b["_home"]], b[~b["_home"]]
        x, y = _units(home["_v"], call["_v"])
        node, low = _links(x @ y.T >= threshold, home["_i"].to_numpy(), call["_i"].to_numpy())
        keep = node != low
        return pd.DataFrame({"_s": np.repeat(b["_s"].to_numpy()[:1], keep.sum()), "i": node[keep], "j": low[keep]})

    return meet
