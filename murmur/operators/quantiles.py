"""Exact quantiles of a key's values by histograms.

A percentile aggregate keeps all values of a key in one place.  Here counting passes narrow the interval that holds the rank: each pass deals
the values of a key's interval into at most ``BUCKETS`` buckets (by magnitude first, then evenly), counts them with partial counts in
every task, and goes on with the bucket in which the rank falls.  When at most ``FEW`` values are left, or all that are left are equal, the value is read
off.  Nothing longer than that is ever held for a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.operators.scan import small, written

BUCKETS, FEW = 1 << 16, 4096


def exact_quantile(rows: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """(key, quantile) of the values that are neither null nor NaN: interpolated between the two at rank (n - 1) q, for each key that has any."""
    x = rows.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_x")).where("_x is not null and not isnan(_x)")
    n = x.groupBy("_key").agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    rank = (F.col("n") - 1) * F.lit(q)
    state = written(n.select("_key", F.floor(rank).alias("k"), (rank - F.floor(rank)).alias("part"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), "lo", "hi"), "ranks")
    keys, first = state.count(), True
    wide = (F.col("inside") > FEW) & (F.col("lo") < F.col("hi"))
    while state.where(wide).limit(1).count():
        v = _within(x, state.where(wide), keys).where("_x between lo and hi")
        # Magnitudes have some 2,100 powers of two; 15 buckets for each on either side of zero.
        size = F.signum("_x") * (F.log2(F.greatest(F.abs("_x"), F.lit(5e-324))) + 1075) * 15
        even = F.least(F.lit(BUCKETS - 1.0), F.floor((F.col("_x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS))
        b = v.groupBy("_key", "k", "part", "below", F.floor(size if first else even).alias("_b")).agg(F.count("*").alias("c"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        b = b.withColumn("before", F.col("below") + F.sum("c").over(Window.partitionBy("_key").orderBy("_b")) - F.col("c"))  # a histogram
        b = b.where("before <= k and k < before + c").select("_key", "k", "part", F.col("before").alias("below"), F.col("c").alias("inside"), "lo", "hi")
        state, first = written(state.where(~wide).unionByName(b), "ranks"), False
    left = F.when((F.col("_x") >= F.col("lo")) & (F.col("_x") <= F.col("hi")) & (F.col("inside") <= FEW), F.col("_x"))
    last = _within(x, state, keys).groupBy("_key", "k", "part", "below", "inside", "lo").agg(F.sort_array(F.collect_list(left)).alias("v"), F.min(F.when(F.col("_x") > F.col("hi"), F.col("_x"))).alias("next"))
    at = (F.col("k") - F.col("below")).cast("int")
    low = F.when(F.col("inside") <= FEW, F.get("v", at)).otherwise(F.col("lo"))
    high = F.when(at + 1 >= F.col("inside"), F.col("next")).when(F.col("inside") <= FEW, F.get("v", at + 1)).otherwise(F.col("lo"))
    return last.select(F.col("_key").alias(key), F.when(F.col("part") == 0, low).otherwise((1 - F.col("part")) * low + F.col("part") * high).alias("quantile"))


def _within(x: DataFrame, state: DataFrame, keys: int) -> DataFrame:
    s = state.withColumnRenamed("_key", "_k")
    return x.join(small(s, keys), F.col("_key").eqNullSafe(F.col("_k"))).drop("_k")
