"""Run detection: silence and music, as gaps and islands.

Places and chains come from scans in two levels, figures of a run from aggregations with partial sums, so one recording or
document may hold most of all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions import rules as R
from murmur.functions import text as T
from murmur.operators.quantiles import exact_quantile
from murmur.operators.scan import Last, Next, Ranges, Sum, row_numbers, written


def frame_rms(samples: DataFrame, frame: int, key="doc_id", index="i", value="x") -> DataFrame:
    """(key, frame_idx, rms) of whole frames; a last, partial frame is left out."""
    return (
        samples.groupBy(key, F.floor(F.col(index) / frame).cast("long").alias("frame_idx"))
        .agg(F.sqrt(F.avg(F.col(value).cast("double") * F.col(value).cast("double"))).alias("rms"), F.count("*").alias("_n"))
        .where(F.col("_n") == frame).drop("_n")
    )


def energy_threshold(frames: DataFrame, factor: float = R.SILENCE_FACTOR, key="doc_id") -> DataFrame:
    """(key, threshold): a share of the 75th percentile of non-zero energy, interpolated; 0 without any."""
    q = exact_quantile(frames.where("rms > 0").select(key, F.col("rms").cast("double").alias("rms")), key, "rms", 0.75)
    every = frames.select(key).distinct().join(q.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left")
    return every.select(key, F.coalesce(F.col("quantile") * factor, F.lit(0.0)).alias("threshold"))


def silence_runs(frames: DataFrame, threshold: DataFrame, least: int, key="doc_id") -> DataFrame:
    """(key, first, stop): maximal runs of frames below the threshold, at least so many frames long."""
    low = frames.join(threshold, key).where("rms < threshold").select(key, "frame_idx")
    low = row_numbers(low, key, ["frame_idx"], "_n", Ranges(frames.select(key, "frame_idx"), key, "frame_idx"))
    runs = low.groupBy(key, (F.col("frame_idx") - F.col("_n")).alias("_g")).agg(F.min("frame_idx").alias("first"), (F.max("frame_idx") + 1).alias("stop"))
    return runs.where(F.col("stop") - F.col("first") >= least).drop("_g")


def silence_windows(frames: DataFrame, least_s: float = R.LEAST_SILENCE_S, factor: float = R.SILENCE_FACTOR, key="doc_id") -> DataFrame:
    """(key, t0, t1) in seconds."""
    runs = silence_runs(frames, energy_threshold(frames, factor, key), max(1, int(least_s * 1000 / R.FRAME_MS)), key)
    return runs.select(key, (F.col("first") * R.FRAME_MS / 1000).alias("t0"), (F.col("stop") * R.FRAME_MS / 1000).alias("t1"))


def silence_midpoints(frames: DataFrame, factor: float = R.SPLIT_FACTOR, least: int | None = None, key="doc_id") -> DataFrame:
    """(key, mid): frame in the middle of each silence of 300 ms or more."""
    least = max(1, R.LEAST_SPLIT_SILENCE_MS // R.FRAME_MS) if least is None else least
    runs = silence_runs(frames, energy_threshold(frames, factor, key), least, key)
    return runs.select(key, F.floor((F.col("first") + F.col("stop")) / 2).cast("long").alias("mid"))


def _chains(paras: DataFrame, key: str, order: str, ranges: Ranges | None = None) -> DataFrame:
    """paras with the chain that each paragraph may belong to: (_i, _short, _inner, _run).

    A chain is a maximal run of short paragraphs at most two places apart: one longer paragraph between short ones is tolerated.
    Longer ones after the last short one ride along in ``_run``; ``_runs`` tells them by the chain's end.
    """
    r = ranges or Ranges(paras.select(key, F.col(order).alias("_i")), key, "_i")
    p = paras.withColumn("_i", F.col(order)).withColumn("_t", T.stamp_seconds(F.col("text"))).withColumn("_short", F.length(T.content(F.col("text"))) <= R.MUSIC_CHARS)
    # The place of the last short paragraph before decides whether a new chain begins.
    p = r.scan(r.attach(p), ["_i"], _before=Last(F.when(F.col("_short"), F.col("_i"))), _after=Next(F.struct("_t")))
    p = p.withColumn("_new", F.when(F.col("_short") & F.coalesce(F.col("_i") - F.col("_before") > 2, F.lit(True)), 1).otherwise(0))
    p = r.scan(p, ["_i"], _run=Sum(F.col("_new")))
    gap = F.when((F.col("_t") >= 0) & (F.col("_after._t") >= 0), F.col("_after._t") - F.col("_t"))
    return p.withColumn("_inner", F.when(gap > 0, gap)).drop("_t", "_after", "_before", "_new", "_range")


def music_runs(paras: DataFrame, key="doc_id", order="para_idx", gap_s: float | None = R.MUSIC_GAP_S, ranges: Ranges | None = None) -> DataFrame:
    """(key, lo, hi, len, shorts): chains of short paragraphs with dense stamps.

    ``order`` must count the paragraphs of a document without holes.  Needs columns text (with stamp).  gap_s None skips the test of stamps.
    A chain's figures are sums over its paragraphs.
    """
    return _music(_chains(paras.select(key, order, "text"), key, order, ranges), key, gap_s).drop("_run")


def _music(chains: DataFrame, key: str, gap_s: float | None) -> DataFrame:
    p = chains.where("_run > 0")
    # The mean is over gaps between the chain's paragraphs: a gap counts if the paragraph it leads to is not beyond the last short one.
    ends = p.groupBy(key, "_run").agg(F.min("_i").alias("lo"), F.max(F.when(F.col("_short"), F.col("_i"))).alias("hi"), F.sum(F.col("_short").cast("long")).alias("shorts"))
    ends = ends.withColumn("len", F.col("hi") - F.col("lo") + 1)
    ends = ends.where((F.col("len") >= R.MUSIC_RUN) & (F.col("shorts") / F.col("len") >= R.MUSIC_SHORT_RATIO))
    if gap_s is not None:
        e = ends.select(F.col(key).alias("_key"), F.col("_run").alias("_r"), F.col("hi").alias("_hi"))
        gaps = p.where("_inner is not null").join(e, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_run") == F.col("_r")) & (F.col("_i") < F.col("_hi")))
        dense = gaps.groupBy("_key", "_r").agg(F.avg("_inner").alias("_mean")).where(F.col("_mean") < gap_s)
        ends = ends.join(dense, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_run") == F.col("_r")), "left_semi")
    return ends.select(key, "_run", "lo", "hi", "len", "shorts")


def drop_music(paras: DataFrame, key="doc_id", order="para_idx", gap_s: float | None = R.MUSIC_GAP_S, ranges: Ranges | None = None) -> DataFrame:
    """Paragraphs outside music runs.  Where no document is long, paras are read once, and one exchange by document serves all windows."""
    ranges = ranges or Ranges(paras.select(key, F.col(order).alias("_i")), key, "_i")
    chains = _chains(paras, key, order, ranges)
    if not ranges.hot:
        w = Window.partitionBy(key, "_run")
        p = chains.withColumn("_hi", F.max(F.when(F.col("_short"), F.col("_i"))).over(w)).withColumn("_inside", F.coalesce((F.col("_run") > 0) & (F.col("_i") <= F.col("_hi")), F.lit(False)))
        w = Window.partitionBy(key, "_run", "_inside")
        size = F.count("*").over(w)
        music = F.col("_inside") & (size >= R.MUSIC_RUN) & (F.sum(F.col("_short").cast("long")).over(w) / size >= R.MUSIC_SHORT_RATIO)
        if gap_s is not None:
            mean = F.avg(F.when(F.col("_i") < F.col("_hi"), F.col("_inner"))).over(w)
            music = music & F.coalesce(mean < gap_s, F.lit(False))
        return p.withColumn("_music", music).where(~F.col("_music")).select(*paras.columns)
    chains = written(chains, "chains")
    m = _music(chains.select(key, "_i", "_short", "_run", "_inner"), key, gap_s).select(F.col(key).alias("_key"), F.col("_run").alias("_r"), F.col("hi").alias("_hi"))
    inside = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_run") == F.col("_r")) & (F.col("_i") <= F.col("_hi"))
    return chains.join(m, inside, "left_anti").select(*paras.columns)
