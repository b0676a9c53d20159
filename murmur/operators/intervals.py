"""Interval joins.

``overlap_join`` is a range join.  Within a document, intervals meet through time buckets: each
side is listed under the buckets it touches, so a document with very many turns is an equi-join on
(document, bucket) that spreads over tasks, and not one task that compares all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.operators.scan import Last, Next, Ranges
from murmur.schemas import UNKNOWN_SPEAKER


def _buckets(start: Column, end: Column, width) -> Column:
    low, high = F.floor(start / width).cast("long"), F.floor(end / width).cast("long")
    return F.sequence(low, F.greatest(low, high))


def overlap_join(segments: DataFrame, turns: DataFrame, key="doc_id", seg="seg_idx", turn="turn_idx", width: float | None = None) -> DataFrame:
    """segments with the speaker of the one turn that overlaps most.

    Only positive overlap counts; ties go to the earlier turn; no overlap gives UNKNOWN.  Keeps all
    columns of segments.  width: bucket width in the unit of the times (None: no buckets).
    """
    s = segments.select(key, F.col(seg).alias("_seg"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    t = turns.select(F.col(key).alias("_key"), F.col(turn).alias("_turn"), F.col("start").alias("_ts"), F.col("end").alias("_te"), F.col("speaker").alias("_who"))
    on = F.col(key) == F.col("_key")
    if width:
        s = s.withColumn("_b", F.explode(_buckets(F.col("_s"), F.col("_e"), width)))
        t = t.withColumn("_tb", F.explode(_buckets(F.col("_ts"), F.col("_te"), width)))
        on = on & (F.col("_b") == F.col("_tb"))
    hit = s.join(t, on & (F.col("_ts") < F.col("_e")) & (F.col("_te") > F.col("_s")))
    overlap = F.least("_e", "_te") - F.greatest("_s", "_ts")
    best = hit.where(overlap > 0).groupBy(key, "_seg").agg(F.max(F.struct(overlap.alias("o"), (-F.col("_turn")).alias("t"), F.col("_who").alias("w"))).alias("_best"))
    best = best.select(F.col(key).alias("_k"), "_seg", F.col("_best.w").alias("_speaker"))
    out = segments.join(best, (F.col(key) == F.col("_k")) & (F.col(seg) == F.col("_seg")), "left")
    keep = [c for c in segments.columns if c != "speaker"]
    return out.select(*keep, F.coalesce("_speaker", F.lit(UNKNOWN_SPEAKER)).alias("speaker"))


def nearest_join(points: DataFrame, marks: DataFrame, key: str, point: str, mark: str, order: str) -> DataFrame:
    """points with the nearest mark of the same key (``_mark``, ``_order``), the first in order among equals.

    The last mark at or before and the first after each point come from a scan in two levels over the
    union, so the cost is a sort and not a product, and one key may hold most of all rows.
    """
    low = F.lit(None).cast("long")
    u = points.withColumn("_kind", F.lit(1)).withColumn("_at", F.col(point)).withColumn("_m", F.lit(None).cast("double")).withColumn("_o", low)
    # Equal times keep only the first mark in order.
    m = marks.groupBy(key, mark).agg(F.min(order).alias("_o")).select(
        key, *[F.lit(None).cast(dict(points.dtypes)[c]).alias(c) for c in points.columns if c != key],
        F.lit(0).alias("_kind"), F.col(mark).alias("_at"), F.col(mark).cast("double").alias("_m"), F.col("_o").cast("long"),
    )
    u = u.unionByName(m).withColumn("_mk", F.when(F.col("_kind") == 0, F.struct("_m", "_o")))
    both = points.select(key, F.col(point).alias("_at")).union(marks.select(key, F.col(mark).alias("_at")))
    u = Ranges(both, key, "_at").scan(u, ["_at", "_kind"], _prev=Last(F.col("_mk"), True), _next=Next(F.col("_mk"), True)).where("_kind = 1")
    options = F.filter(F.array("_prev", "_next"), lambda x: x.isNotNull())
    best = F.array_min(F.transform(options, lambda x: F.struct(F.abs(x["_m"] - F.col(point)).alias("d"), x["_o"].alias("o"), x["_m"].alias("m"))))
    return u.select(*points.columns, best["m"].alias("_mark"), best["o"].alias("_order"))
