"""Mixing sources to target weights by Poisson replication.

Each source has a repetition rate: target weight times total rows over rows of the source.  A
document is emitted k times, where k inverts the Poisson distribution with that mean at a uniform
number that is a hash of (seed, doc_id), so a rerun or a lost executor gives the same rows.  A rate
above ``PART_RATE`` is cut into equal parts, each inverted at a hash of its own: the sum of independent
Poisson counts is a Poisson count with the sum of their means.  The
copies are then ordered over the whole corpus by a hash of (seed, doc_id, copy): a range
exchange, no single task.

By default the weights are proportional to the square root of the rows of a source, which lifts
small sources and lowers large ones while the expected size stays that of the input.

Defined cases: a null source is a source of its own; a null doc_id hashes as the text ``null``;
rows that repeat, and rows of one doc_id, hash alike and get the same count; texts are not looked at, so null, empty and very long ones are
like any other; ties of the order go to the smaller doc_id; a source without a weight gets rate 0; columns of the documents may have any
names: they travel as one struct, and an added column takes underscores before its name until it differs from all of theirs; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import Scratch, fresh, maybe_broadcast, table

SEED = 17
#: exp(-PART_RATE) must stay a normal double.
PART_RATE = 600.0


def uniform(key: Column) -> Column:
    """The first 52 bits of MD5, as a double in [0, 1)."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_quantile(u: Column, rate: Column, terms: int | Column) -> Column:
    """Smallest k with P(X <= k) > u, by summing terms of the distribution in order."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("k"), u.alias("u"))  # u is computed once
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        start,
        lambda s, i: F.when(
            s["u"] >= s["c"],
            F.struct((s["p"] * rate / i).alias("p"), (s["c"] + s["p"] * rate / i).alias("c"), i.alias("k"), s["u"].alias("u")),
        ).otherwise(s),
        lambda s: s["k"],
    )


def poisson_count(key: Column, rate: Column) -> Column:
    """A Poisson count with any mean, by the hash of key."""
    parts = F.greatest(F.ceil(rate / PART_RATE), F.lit(1)).cast("int")
    part = rate / parts
    terms = (part + 12 * F.sqrt(part) + 30).cast("int")
    first = poisson_quantile(uniform(key), part, terms)
    more = F.transform(F.sequence(F.lit(2), parts), lambda i: poisson_quantile(uniform(F.concat(key, F.lit("#"), i.cast("string"))), part, terms))
    return F.when(parts == 1, first).otherwise(first + F.aggregate(more, F.lit(0), lambda a, x: a + x))


def rates(docs: DataFrame, scratch: Scratch, weights: dict | None = None, power: float = 0.5) -> DataFrame:
    """(source, rate), written: weights may be given by source, else rows ** power."""
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        pairs = [F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w))) for s, w in weights.items()]
        n = n.withColumn("w", F.coalesce(*pairs, F.lit(0.0)))
    n = scratch.write(n, "sources")
    rows, weight = n.agg(F.sum("n"), F.sum("w")).first()
    if not weight:
        return n.select("source", F.lit(0.0).alias("rate"))
    return n.select("source", (F.col("w") / F.lit(weight) * F.lit(rows) / F.col("n")).alias("rate"))


def copies(docs: DataFrame, weights: dict | None = None, power: float = 0.5, seed: int = SEED) -> DataFrame:
    """(doc, copy, copies, key): each document as a struct, as often as its count says; copy counts from 1."""
    r = rates(docs, Scratch(docs.sparkSession, "mix"), weights, power)
    r = maybe_broadcast(r.select(F.col("source").alias("of"), "rate"), r.count(), 64)
    ident = F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("null"))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).join(r, F.col("doc.source").eqNullSafe(F.col("of")))
    out = out.select("doc", poisson_count(F.concat(F.lit(f"{seed}:"), ident), F.col("rate")).alias("copies")).where("copies > 0")
    out = out.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "copies")
    return out.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), ident, F.lit(":"), F.col("copy").cast("string"))))


def replicate(docs: DataFrame, weights: dict | None = None, power: float = 0.5, seed: int = SEED) -> DataFrame:
    """All columns of docs, with _copy (from 1), _copies and _key, globally ordered by _key."""
    out = copies(docs, weights, power, seed).orderBy("key", "doc.doc_id", "copy")
    return out.select("doc.*", *[F.col(c).alias(fresh(docs, f"_{c}")) for c in ("copy", "copies", "key")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return replicate(docs).select(
        "doc_id", "source", F.col("_copy").cast("int").alias("copy"), F.col("_copies").cast("int").alias("copies"), F.col("_key").alias("shuffle_key")
    )


ORACLE = r"""
with recursive n as (select source, count(*) as n, sqrt(count(*)::double) as w from documents group by source),
r as (select source, w / (select sum(w) from n) * (select sum(n)::bigint from n) / n as rate from n),
d as (
  select doc_id, documents.source,
         ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, 'null')), 1, 13))::ubigint::double / 4503599627370496.0 as u, rate
  from documents join r on documents.source is not distinct from r.source
), walk(doc_id, source, u, rate, k, p, c) as (
  select doc_id, source, u, rate, 0, exp(-rate), exp(-rate) from d
  union all
  select doc_id, source, u, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) from walk where u >= c and k < 400
), counts as (select doc_id, source, u, max(k) as copies from walk group by doc_id, source, u)
select doc_id, source, x.copy::int as copy, copies::int as copies,
       md5('17:' || coalesce(doc_id::varchar, 'null') || ':' || x.copy::varchar) as shuffle_key
from counts, lateral (select unnest(range(1, copies + 1)) as copy) x
"""
