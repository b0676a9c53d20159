"""Sequential operators over one document's timeline."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions import rules as R
from murmur.operators.scan import Last, Least, Next, Ranges, Sum, row_numbers, small, written


#: Frames of a span, in which split points are found by one task.
SPAN = 1 << 22


def _follow(pos: np.ndarray, mids: np.ndarray, stop: int, end: int, target: int, search: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Steps of many walkers at once, as (which went on, where they are now), until all are at ``stop`` or cannot go on before ``end``."""
    live = np.flatnonzero(pos < stop)
    pos = pos.copy()
    far = np.iinfo(np.int64).max // 2
    padded = np.concatenate([[-far], mids, [far]])
    while len(live):
        at = pos[live]
        want = at + target
        live, at, want = live[want < end], at[want < end], want[want < end]
        i = np.searchsorted(padded, want)
        left, right = padded[i - 1], padded[i]
        dl, dr = np.where(left > at, want - left, far), np.where(right > at, right - want, far)
        near = np.where(dl <= dr, left, right)
        pos[live] = np.where(np.minimum(dl, dr) <= search, near, want)
        yield live, pos[live]
        live = live[pos[live] < stop]


def _span_map(mids: np.ndarray, first: int, span: int, end: int, target: int, search: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place in which a walker may enter a span: where it leaves it (-1: it ended), and its steps."""
    pos = first + np.arange(target + search, dtype=np.int64)
    steps, left = np.zeros(len(pos), dtype=np.int64), pos.copy()
    for live, now in _follow(pos, mids, first + span, end, target, search):
        steps[live] += 1
        left[live] = now
    return np.where(left >= first + span, left - first - span, -1), steps


def greedy_split_points(lengths: DataFrame, mids: DataFrame, target: int, search: int = R.SEARCH_S * 1000 // R.FRAME_MS, key="doc_id", span: int | None = None) -> DataFrame:
    """(key, k, at): split points, each near the last one plus target.

    The next point is the silence nearest to last + target within the search radius and after the last
    point (the first among equals), else that place itself; it stops at the end.
    lengths: (key, n_frames); mids: (key, mid).

    A document is cut into spans.  What the points of a span are depends only on the place at which they enter it, one of target + search
    places, so each span is a map from places of entry to places of leaving and numbers of steps; all spans are mapped side by side (the walkers of a span
    soon run together), the maps are followed in order, and each span gives its points from where they enter.  A task holds the middles of one span.
    """
    reach = target + search
    span = max(span or SPAN, reach)
    spans = lengths.select(key, F.col("n_frames").cast("long").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("n_frames") - 1) / span)))).alias("b"))
    own = F.floor(F.col("mid") / span)
    # Points of a span may look beyond its end.
    near = F.when((own > 0) & (F.col("mid") - own * span < reach), F.array(own, own - 1)).otherwise(F.array(own))
    m = mids.where("mid >= 0").select(F.col(key).alias("_key"), F.explode(near).alias("_b"), "mid").groupBy("_key", "_b").agg(F.sort_array(F.collect_set(F.col("mid").cast("long"))).alias("mids"))
    held = spans.join(m, F.col(key).eqNullSafe(F.col("_key")) & (F.col("b") == F.col("_b")), "left").drop("_key", "_b")
    kind = dict(held.dtypes)[key]
    array = lambda x: np.asarray(x if x is not None else [], dtype=np.int64)

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = [_span_map(array(v), b * span, span, n, target, search) for v, b, n in zip(x["mids"], x["b"], x["n"])]
            yield pd.DataFrame({key: x[key], "b": x["b"], "to": [a.tolist() for a, _ in out], "steps": [c.tolist() for _, c in out]})

    def enters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for k, parts in zip(x[key], x["parts"]):
                at, done = 0, 0
                for p in parts:
                    rows.append((k, p["b"], at, done))
                    done += p["steps"][at]
                    at = p["to"][at]
                    if at < 0:
                        break
            yield pd.DataFrame(rows, columns=[key, "b", "at", "done"])

    def points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            ks, no, at = [], [], []
            for k, b, n, v, e, done in zip(x[key], x["b"], x["n"], x["mids"], x["at"], x["done"]):
                got = [int(now[0]) for _, now in _follow(np.asarray([b * span + e], dtype=np.int64), array(v), (b + 1) * span, n, target, search) if len(now)]
                ks += [k] * len(got)
                no += range(done, done + len(got))
                at += got
            yield pd.DataFrame({key: pd.Series(ks, dtype=x[key].dtype), "k": no, "at": at})

    if lengths.where(F.col("n_frames") > span).limit(1).count():
        long = held.where(F.col("n") > span).mapInPandas(maps, f"{key} {kind}, b long, to array<long>, steps array<long>")
        first = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("b", "to", "steps"))).alias("parts")).mapInPandas(enters, f"{key} {kind}, b long, at long, done long")
        e = first.select(F.col(key).alias("_key"), F.col("b").alias("_b"), "at", "done")
        met = held.where(F.col("n") > span).join(e, F.col(key).eqNullSafe(F.col("_key")) & (F.col("b") == F.col("_b"))).drop("_key", "_b")
        held = met.unionByName(held.where(F.col("n") <= span).withColumn("at", F.lit(0).cast("long")).withColumn("done", F.lit(0).cast("long")))
    else:
        held = held.withColumn("at", F.lit(0).cast("long")).withColumn("done", F.lit(0).cast("long"))
    return held.mapInPandas(points, f"{key} {kind}, k int, at long")


def chunk_bounds(points: DataFrame, lengths: DataFrame, key="doc_id", point="at", length="n_samples") -> DataFrame:
    """(key, chunk, s0, s1): half-open ranges between 0, the split points and the end."""
    edge = points.select(key, F.col(point).cast("long").alias("s0")).unionByName(lengths.select(key, F.lit(0).cast("long").alias("s0")))
    edge = edge.unionByName(lengths.select(key, F.col(length).cast("long").alias("s0")))
    w = Window.partitionBy(key).orderBy("s0")
    return edge.withColumn("chunk", F.row_number().over(w).cast("long") - 1).withColumn("s1", F.lead("s0").over(w)).where("s1 is not null").select(key, "chunk", "s0", "s1")


def _moves(silences: list[tuple], ends: list[tuple], plain: bool) -> dict:
    """Which boundary each silence moves: {place: (t0, t1)}, the last silence counting; ends: (end, place) in order.

    Silences that do not overlap come in order, so the nearest current end is the last one before a silence's middle, moved or not, or the
    first one after it, which no silence has moved yet.  plain: overlapping ones; all ends are looked at.
    """
    out: dict = {}
    if plain:
        at = dict((i, e) for e, i in ends)
        for t0, t1 in silences:
            if at:
                i = min(at, key=lambda i: (abs(at[i] - (t0 + t1) / 2), i))
                at[i], out[i] = t0, (t0, t1)
        return out
    before: list[tuple] = []  # (end, -place): the last one is nearest, the smaller place of equal ends
    nxt = 0
    for t0, t1 in silences:
        mid = (t0 + t1) / 2
        while nxt < len(ends) and ends[nxt][0] < mid:
            insort(before, (ends[nxt][0], -ends[nxt][1]))
            nxt += 1
        options = [(mid - before[-1][0], -before[-1][1], True)] if before else []
        options += [(ends[nxt][0] - mid, ends[nxt][1], False)] if nxt < len(ends) else []
        if options:
            _, i, left = min(options)
            if left:
                before.pop()
            else:
                nxt += 1
            insort(before, (t0, -i))
            out[i] = (t0, t1)
    return out


def apply_silence_breaks(segments: DataFrame, windows: DataFrame, key="doc_id", order="seg_idx") -> DataFrame:
    """Segments whose boundaries are moved to real silences, one silence after the other.

    For each silence in order, the boundary whose current end is nearest to the silence's middle (the first among
    equals) gets the silence: that segment ends at t0 and the next starts at t1.  Later silences see
    earlier moves; fewer than two segments stay as they are.

    Silences only depend on each other in chains.  A silence takes at most one end from beyond its middle, always the first that is left.
    So if u ends may be gone beyond the silence before, and n lie between the two, at most max(0, u - n) + 1 may be gone beyond this
    one: a running sum less its running minimum.  Where more ends than that lie before the next silence, the last of them (with its equals) is sure to be untouched, it is
    nearer to the next silence than all before it, and a new chain begins.  A task folds one chain over the ends that it can reach, and no document as a whole.
    Silences of a document that overlap each other are one chain.
    """
    kind = dict(segments.dtypes)
    s = row_numbers(segments.select(key, order, "start", "end"), key, [order], "_i")
    last = s.groupBy(F.col(key).alias("_key")).agg(F.max("_i").alias("_n"))
    ends = s.join(last, F.col(key).eqNullSafe(F.col("_key"))).where("_i < _n").select(key, F.col("end").alias("_x"), F.lit(1).alias("_kind"), "_i", F.lit(None).cast(kind["end"]).alias("t0"), F.lit(None).cast(kind["end"]).alias("t1"))
    mid = ((F.col("t0") + F.col("t1")) / 2).cast("double")
    w = windows.select(key, mid.alias("_x"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_i"), F.col("t0").cast(kind["end"]).alias("t0"), F.col("t1").cast(kind["end"]).alias("t1"))
    both = written(ends.withColumn("_x", F.col("_x").cast("double")).unionByName(w), "breaks")
    r = Ranges(both, key, "_x")
    # An end at the very middle counts as one after it.
    placed = r.scan(r.attach(both), ["_x", "_kind", "_i", "t0"], _e=Sum(F.col("_kind").cast("long")), _p=Sum((1 - F.col("_kind")).cast("long")))
    # Of equal ends the first is taken: _f is the rank of the first end that equals the last one so far.
    placed = r.scan(placed, ["_x", "_kind", "_i", "t0"], _last=Last(F.when(F.col("_kind") == 1, F.struct("_x"))))
    new = (F.col("_kind") == 1) & F.coalesce(F.col("_last._x") < F.col("_x"), F.lit(True))
    placed = r.scan(placed, ["_x", "_kind", "_i", "t0"], _f=Last(F.when(new, F.col("_e")), True)).drop("_last")
    placed = written(placed.withColumn("_f", F.coalesce("_f", F.lit(0).cast("long"))), "breaks")
    sil = placed.where("_kind = 0").withColumn("_t", F.col("_p") - F.col("_e"))
    sil = r.scan(sil, ["_x", "t0"], _low=Least(F.col("_t")), _past=Last(F.struct("t1")), _next=Next(F.struct("_f")))
    sil = sil.withColumn("_u", F.col("_t") - F.col("_low") + 1).withColumn("_ends_chain", F.coalesce(F.col("_next._f") - F.col("_e") > F.col("_u"), F.lit(True)))
    sil = r.scan(sil, ["_x", "t0"], _chain=Sum(F.col("_ends_chain").cast("long")))
    sil = written(sil.withColumn("_chain", F.col("_chain") - F.col("_ends_chain").cast("long")), "silences")
    odd = sil.where(F.col("_past.t1") > F.col("t0")).select(F.col(key).alias("_key")).distinct()
    odd = written(odd.withColumn("_odd", F.lit(True)), "overlapping")
    sil = sil.join(small(odd, odd.count()), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key").withColumn("_odd", F.coalesce("_odd", F.lit(False)))
    sil = sil.withColumn("_chain", F.when(F.col("_odd"), F.lit(0).cast("long")).otherwise(F.col("_chain")))
    chains = sil.groupBy(key, "_chain", "_odd").agg(
        F.min("_f").alias("_lo"), F.max(F.col("_e") + F.col("_u")).alias("_hi"), F.array_sort(F.collect_list(F.struct("t0", "t1"))).alias("silences")
    )
    reach = chains.where(~F.col("_odd")).select(F.col(key).alias("_key"), "_chain", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("_lo")), F.col("_hi"))).alias("_q"))
    own = placed.where("_kind = 1").select(key, "_e", F.struct(F.col("_x").alias("x"), F.col("_i").alias("i")).alias("end"))
    near = own.join(reach, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_e") == F.col("_q"))).select(key, "_chain", "end")
    every = own.join(small(odd, 1 << 30), F.col(key).eqNullSafe(F.col("_key"))).select(key, F.lit(0).cast("long").alias("_chain"), "end")
    near = near.unionByName(every).groupBy(F.col(key).alias("_key"), F.col("_chain").alias("_c")).agg(F.array_sort(F.collect_list("end")).alias("ends"))
    rows = chains.join(near, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chain") == F.col("_c"))).select(key, "_odd", "silences", "ends")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, plain, silences, ends in zip(b[key], b["_odd"], b["silences"], b["ends"]):
                got = _moves([(x["t0"], x["t1"]) for x in silences], [(x["x"], x["i"]) for x in ends], plain)
                out += [(k, i, *t) for i, t in got.items()]
            yield pd.DataFrame(out, columns=["_key", "_at", "_t0", "_t1"])

    moved = written(rows.mapInPandas(fold, f"_key {kind[key]}, _at long, _t0 {kind['end']}, _t1 {kind['end']}"), "moved")
    one, two = moved.select("_key", "_at", F.col("_t0").alias("_end")), moved.select("_key", (F.col("_at") + 1).alias("_at"), F.col("_t1").alias("_start"))
    at = lambda m: F.col(key).eqNullSafe(m["_key"]) & (F.col("_i") == m["_at"])
    out = row_numbers(segments, key, [order], "_i").join(one, at(one), "left").drop("_key", "_at").join(two, at(two), "left").drop("_key", "_at")
    rest = [F.col(f"`{c}`") for c in segments.columns if c not in (key, order, "start", "end")]
    return out.select(key, order, F.coalesce("_start", "start").cast(kind["start"]).alias("start"), F.coalesce("_end", "end").cast(kind["end"]).alias("end"), *rest)
