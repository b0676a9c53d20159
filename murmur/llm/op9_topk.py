"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Index: every vector becomes integers floor(64 x).  Candidates are dealt into blocks by a hash; a block stores its posting segments: for
each dimension, sign and quantised impact (the size of the number in steps of ``STEPS`` levels; steps of one where numbers are small) the
places of the candidates that have it, in descending impact.  Numbers of impact 0 are in no segment.

Search: queries come in blocks too; each query block meets each candidate block in an equi-join on the block number.  Segments are
taken in descending impact and added to the accumulators of all queries of a batch.  What a candidate's accumulator can still be off by is
bounded by Cauchy-Schwarz: the length of the query times that of the candidate's rest, the numbers that no segment has brought yet and the
rounding of those that one has.  A candidate leaves only when its upper end is below the k-th largest lower end.  Once few enough are
left, and at the latest after the last segment, the search stops: that is the proof.  Members that remain possible are rescored
exactly in integers; the k best of each block are merged by query.

Defined cases: null vectors and those with null or non-finite numbers take no part; shorter vectors are
padded with zeros; ties go to the smaller vec_id; a query excludes candidates with its own vec_id
(repeated rows with that id too); repeated candidate rows each take part; fewer candidates than
k: all are returned; an empty table gives no rows; a row without vec_id takes no part; other columns are ignored.  A number or a score
that does not fit 64 bits raises an error, as no long could hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.llm.common import Scratch, table, text_batches
from murmur.llm.vectors import dimension, pack, unpack

K = 20
CANDIDATES, QUERIES, BATCH = 8192, 1024, 256  # rows in a block, and queries that share accumulators
STEPS = 64  # impacts, at most
ENOUGH = 64  # of so many candidates one may be left when a search stops (speed only)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def segments(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(step, heads, places): heads has a row (impact, dimension, sign, end in places) for each segment, in descending impact."""
    step = max(1, -(-int(np.abs(x).max(initial=0)) // STEPS))
    impact = np.abs(x) // step
    place, dim = np.nonzero(impact)
    level, sign = impact[place, dim], np.where(x[place, dim] < 0, -1, 1)
    order = np.lexsort((place, sign, dim, -level))
    key = np.stack([level, dim, sign], axis=1)[order]
    last = np.append(np.flatnonzero((key[1:] != key[:-1]).any(1)), len(key) - 1) if len(key) else np.zeros(0, dtype=np.int64)
    return step, np.column_stack([key[last], last + 1]).astype("<i8"), place[order].astype("<i4")


def search_block(x: np.ndarray, ids: np.ndarray, index: tuple[int, np.ndarray, np.ndarray], q: np.ndarray, qids: np.ndarray, k: int):
    """Yields (query id, candidate ids, scores) with the k best of this block; x, q: integers."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(q.astype(np.float64)).sum(1).max(initial=0)) >= 2.0**63:
        raise OverflowError("scores of these vectors do not fit 64 bits")
    step, heads, places = index
    qf, xf = q.astype(np.float64).T.copy(), x.astype(np.float64)
    qnorm = np.sqrt((qf * qf).sum(0))
    own = ids[:, None] == qids[None, :]
    acc, rest = np.zeros((len(x), len(q))), (xf * xf).sum(1)
    possible, tried, at, begin = ~own, rest.sum(), 0, 0
    while True:
        if at < len(heads):
            impact = heads[at, 0]
            middle = impact * step + (step - 1) / 2
            while at < len(heads) and heads[at, 0] == impact:
                _, dim, sign, end = heads[at].tolist()
                part = places[begin:end]
                acc[part] += sign * middle * qf[dim]
                value = xf[part, dim]
                rest[part] += (value - sign * middle) ** 2 - value * value
                at, begin = at + 1, end
        done = at == len(heads)
        if not done and rest.sum() > tried / 4:
            continue
        tried = rest.sum()
        slack = np.sqrt(np.maximum(rest, 0))[:, None] * qnorm * (1 + 1e-9) + 1e-9 * (1 + np.abs(acc)) + 1e-6
        if len(x) > k:
            low = np.where(own, -np.inf, acc - slack)
            possible &= acc + slack >= np.partition(low, len(x) - k, axis=0)[len(x) - k]
        if done or possible.sum() * ENOUGH <= possible.size:
            break
    for i in range(len(q)):
        left = np.flatnonzero(possible[:, i])
        if len(left):
            s = x[left] @ q[i]
            best = _top(s, ids[left], k)
            yield qids[i], ids[left][best], s[best]


def _search(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                ids, qids = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.qids, "<i8")
                x = np.frombuffer(r.vecs, "<i8").reshape(len(ids), -1)
                q = np.frombuffer(r.qvecs, "<i8").reshape(len(qids), -1)
                index = r.step, np.frombuffer(r.heads, "<i8").reshape(-1, 4), np.frombuffer(r.places, "<i4")
                for lo in range(0, len(qids), BATCH):
                    out = [
                        pd.DataFrame({"query_id": np.full(len(c), n), "vec_id": c, "score": s})
                        for n, c, s in search_block(x, ids, index, q[lo : lo + BATCH], qids[lo : lo + BATCH], k)
                    ]
                    if out:
                        yield pd.concat(out)

    return run


def _dealt(packed: DataFrame, rows: int, count: int) -> DataFrame:
    """Blocks of about ``rows`` rows, dealt by a hash of the id and of the row."""
    n = max(1, -(-count // rows))
    key = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n)).cast("int").alias("block")
    return packed.select(key, "vec_id", "vec")


def index_blocks(packed: DataFrame, count: int) -> DataFrame:
    """(block, ids, vecs, step, heads, places): candidates and their posting segments."""

    def build(b: pd.DataFrame) -> pd.DataFrame:
        step, heads, places = segments(unpack(b["vec"], "<i8"))
        return pd.DataFrame({
            "block": [b["block"].iloc[0]], "ids": [b["vec_id"].to_numpy("<i8").tobytes()], "vecs": [b"".join(b["vec"])], "step": [step],
            "heads": [heads.tobytes()], "places": [places.tobytes()],
        })

    return _dealt(packed, CANDIDATES, count).groupBy("block").applyInPandas(build, "block int, ids binary, vecs binary, step long, heads binary, places binary")


def query_blocks(packed: DataFrame, count: int) -> DataFrame:
    """(qblock, qids, qvecs)."""

    def gather(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"qblock": [b["block"].iloc[0]], "qids": [b["vec_id"].to_numpy("<i8").tobytes()], "qvecs": [b"".join(b["vec"])]})

    return _dealt(packed, QUERIES, count).groupBy("block").applyInPandas(gather, "qblock int, qids binary, qvecs binary")


def meetings(index: DataFrame, asked: DataFrame, blocks: int, qblocks: int) -> DataFrame:
    """Each query block with each candidate block: (ids, vecs, step, heads, places, qids, qvecs).

    A candidate block is repeated only for its lanes, as many as give each task of a shuffle about four in all, and a query block goes to
    one lane of each candidate block.  The join is a merge in any case: file sizes say nothing of repeated rows, and a side taken for small by them would
    go whole through the driver.  Its buffered side has one row for each key.
    """
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lanes = min(qblocks, -(-4 * tasks // blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.withColumn("lane", F.pmod("qblock", F.lit(lanes))).withColumn("block", every(blocks))
    pairs = asked.join(index.withColumn("lane", every(lanes)).hint("merge"), ["block", "lane"])
    return pairs.select("ids", "vecs", "step", "heads", "places", "qids", "qvecs")


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score); vectors and queries have vec_id and embedding."""
    scratch = Scratch(vectors.sparkSession, "topk")
    text_batches(vectors.sparkSession)  # a row of a meeting has megabytes
    dim = max(dimension(vectors), dimension(queries), 1)
    ready = lambda df, name: scratch.write(pack(df.where("vec_id is not null"), dim, "int").where("vec is not null"), name)
    x, q = ready(vectors, "vectors"), ready(queries, "queries")
    nx, nq = x.count(), q.count()
    index = scratch.write(index_blocks(x, nx), "index")
    asked = scratch.write(query_blocks(q, nq), "asked")
    scratch.drop(x, q)
    found = meetings(index, asked, max(1, -(-nx // CANDIDATES)), max(1, -(-nq // QUERIES))).mapInPandas(_search(k), "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return search(v, v.where("vec_id % 20 = 0"))


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e::double[], c.e::double[])::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""
