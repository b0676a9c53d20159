"""Source divergence audit: how far the sources of a language differ in their words.

Every source of a language is a vector of smoothed shares over the terms that the language keeps.  Sources are compared in a round-robin
tournament by *systolic rotation*: vectors are cut into chunks of about ``CHUNK`` terms; a source's chunk stays resident in its
partition, and compressed chunks of its peers come by, one meeting a round by the circle method, so that each pair meets once and both
directions are evaluated there.  ``ROUNDS`` rounds make one job, which bounds what is under way; a task holds one resident and one visitor.
A local heap ranks the resident's terms against the language's own vector, which comes by once; only ranked terms leave the task.

Words are counted in tasks before anything moves (one row for each task, source and term), so a source with a third of all rows costs no task
more than others.  All arithmetic is in whole numbers.

Defined cases: a null text, lang or source is read as ''; an empty text has no terms but its group occurs; very long texts are counted whole; rows
that repeat count as documents each; equal values are ranked by the item's UTF-8 bytes; a language without kept terms gives pairs of value 0; a language
of one source gives no pairs; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.llm.common import Scratch, maybe_broadcast, table, text_batches

LEAST_DOCS, SHARE, TOP_TERMS = 3, 1_000_000_000, 200
CHUNK, ROUNDS = 1 << 15, 8
#: A task's counts leave it when it holds so many different ones.
HELD = 1 << 18
#: Letters stay, upper-case ones of ASCII as lower; bytes of other characters stay; all else parts terms.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's documents, as often as it has to let go."""
    held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            keys = list(n)
            for i in range(0, len(keys), 10_000):
                k = keys[i : i + 10_000]
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(k), pa.string()), "source": pa.array([source] * len(k), pa.string()), "term": pa.array(k, pa.binary()),
                    "n": pa.array([n[x] for x in k], pa.int64()), "docs": pa.array([docs[x] for x in k], pa.int64()),
                })
        held.clear()

    for b in batches:
        for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"].cast(pa.binary()).to_pylist()):
            words = terms(text)
            n, docs = held[lang, source]
            n.update(words)
            docs.update(set(words))
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from out()
    yield from out()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and counts of a chunk as one compressed vector of its size."""
    for b in batches:
        vec = []
        for size, items in zip(b["size"].to_pylist(), b["items"].to_pylist()):
            x = np.zeros(size, dtype="<i8")
            if items:
                x[[i["pos"] for i in items]] = [i["n"] for i in items]
            vec.append(zlib.compress(x.tobytes(), 1))
        i = b.schema.get_field_index("items")
        yield b.set_column(i, "vec", pa.array(vec, pa.binary()))


def shares(vec: bytes, total: int, size: int) -> np.ndarray:
    """1 + floor(SHARE * (count + 1) / (total + size)) of each count."""
    c = np.frombuffer(zlib.decompress(vec), dtype="<i8")
    if len(c) and int(c.max()) >= (1 << 63) // SHARE - 1:
        return np.asarray([1 + SHARE * (x + 1) // (total + size) for x in c.tolist()], dtype=np.int64)
    return 1 + SHARE * (c + 1) // np.int64(max(total + size, 1))


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _best(value: np.ndarray, among: np.ndarray, top: int) -> np.ndarray:
    """Places of the largest values among some, the earlier one of equals first."""
    if len(among) > top:
        least = np.partition(value[among], len(among) - top)[len(among) - top]
        among = among[value[among] >= least]
    return among[np.lexsort((among, -value[among]))][:top]


MEETINGS = "lang string, source string, item string, chunk long, pos int, value long"


def _meet(top: int):
    """Of each resident: its values against every visitor and theirs against it, and its best terms against the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, home, p, counts = None, None, None, None
        for b in batches:
            out: list[dict] = []
            for r in b.to_pylist():
                if r["kind"] == 0:
                    at, home, p = (r["lang"], r["chunk"], r["host"]), r, shares(r["vec"], r["total"], r["terms"])
                    counts = np.frombuffer(zlib.decompress(r["vec"]), dtype="<i8")
                    continue
                if at != (r["lang"], r["chunk"], r["host"]):
                    raise ValueError("a visitor came to a partition without its resident")
                q = shares(r["vec"], r["total"], r["terms"])
                row = {"lang": r["lang"], "chunk": r["chunk"], "source": home["source"], "item": None, "pos": None}
                if r["kind"] == 1:
                    value = divergence(p, q)
                    out += [row | {"pos": i, "value": int(value[i])} for i in _best(value, np.flatnonzero((counts > 0) & (p > q)), top).tolist()]
                else:
                    out.append(row | {"item": r["source"], "value": int(divergence(p, q).sum())})
                    out.append(row | {"source": r["source"], "item": home["source"], "value": int(divergence(q, p).sum())})
            if out:
                yield pa.RecordBatch.from_pylist(out, _MEETINGS)

    return run


_MEETINGS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("chunk", pa.int64()), ("pos", pa.int32()), ("value", pa.int64())])


def partner(slot: Column, turn: Column, even: Column) -> Column:
    """Whom a slot meets in a round of the circle method; even: number of slots, made even by a bye."""
    m = even - 1
    return F.when(slot == m, turn).when(slot == turn, m).otherwise(F.pmod(2 * turn - slot, m))


def vectors(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(residents, languages' own vectors, terms): chunks of vectors with what their shares need, and the terms by place."""
    d = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    text_batches(docs.sparkSession)
    counts = d.mapInArrow(_count, "lang string, source string, term binary, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = scratch.write(counts, "counts")
    kept = scratch.write(counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).drop("docs"), "kept")
    slot = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1  # one row for each source
    groups = scratch.write(d.select("lang", "source").distinct().withColumn("slot", slot).withColumn("slots", F.count("*").over(Window.partitionBy("lang"))), "groups")
    langs = groups.select("lang", "slots").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("all")), "lang", "left")
    langs = langs.select("lang", "slots", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("all", F.lit(0)).alias("all"))
    langs = scratch.write(langs.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("terms") / CHUNK)).cast("long")), "langs")
    n_langs = langs.count()
    small = lambda df: maybe_broadcast(df, n_langs, 128)
    placed = kept.join(small(langs.select("lang", "chunks")), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")))
    placed = placed.withColumn("pos", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)  # a chunk is bounded
    placed = scratch.write(placed.select("lang", "chunk", "pos", "term", "total"), "terms")
    sizes = langs.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "slots", "terms", "all")
    sizes = scratch.write(sizes.join(placed.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("size")), ["lang", "chunk"], "left").fillna(0, ["size"]), "sizes")

    own = counts.join(placed.select("lang", "term", "chunk", "pos"), ["lang", "term"]).select("lang", "source", "chunk", "pos", "n")
    pieces = own.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("pos", "n")).alias("items"), F.sum("n").alias("sum"))
    pieces = scratch.write(pieces, "pieces")
    totals = pieces.groupBy("lang", "source").agg(F.sum("sum").alias("total"))
    every = groups.join(totals, ["lang", "source"], "left").select("lang", "source", "slot", F.coalesce("total", F.lit(0)).alias("total"))
    full = every.join(small(sizes), "lang").join(pieces.select("lang", "source", "chunk", "items"), ["lang", "source", "chunk"], "left")
    cols = ["lang", "source", "slot", "slots", "chunk", "size", "terms", "total", "items"]
    schema = "lang string, source string, slot long, slots long, chunk long, size int, terms long, total long, vec binary"
    residents = scratch.write(full.select(*cols).mapInArrow(_pack, schema), "residents")
    whole = placed.groupBy("lang", "chunk").agg(F.collect_list(F.struct("pos", F.col("total").alias("n"))).alias("items"))
    whole = sizes.join(whole, ["lang", "chunk"], "left").select("lang", F.lit("").alias("source"), F.lit(0).cast("long").alias("slot"), "slots", "chunk", "size", "terms", F.col("all").alias("total"), "items")
    return residents, scratch.write(whole.mapInArrow(_pack, schema), "whole"), placed


def meetings(residents: DataFrame, whole: DataFrame, scratch: Scratch, top: int = TOP_TERMS) -> list[DataFrame]:
    """The tournament: written results of each job of ``ROUNDS`` rounds."""
    cols = ["source", "total", "terms", "vec"]
    at_home = residents.select("lang", "chunk", F.col("slot").alias("host"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("turn"), *cols)
    even = F.col("slots") + F.col("slots") % 2
    last, out = residents.agg(F.max(even - 1)).first()[0] or 0, []
    for first in range(0, max(last, 1), ROUNDS):
        turns = F.sequence(F.lit(first).cast("long"), F.least(even - 2, F.lit(first + ROUNDS - 1)))
        out_and_about = residents.where(even - 2 >= first).withColumn("turn", F.explode(turns)).withColumn("peer", partner(F.col("slot"), F.col("turn"), even)).where("peer < slots")
        # Of two that meet, the one of the lower slot is the visitor if the slots differ by an odd number.
        visits = (F.col("slot") < F.col("peer")) == (F.pmod(F.col("slot") + F.col("peer"), F.lit(2)) == 1)
        moving = out_and_about.where(visits).select("lang", "chunk", F.col("peer").alias("host"), F.lit(2).alias("kind"), "turn", *cols)
        if first == 0:
            hosts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1))
            moving = moving.union(whole.select("lang", "chunk", hosts.alias("host"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("turn"), *cols))
        stream = at_home.union(moving).repartition("lang", "chunk", "host").sortWithinPartitions("lang", "chunk", "host", "kind", "turn")
        out.append(scratch.write(stream.mapInArrow(_meet(top), MEETINGS), "meetings"))
    return out


def audit(docs: DataFrame, scratch: Scratch | None = None, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source)."""
    scratch = scratch or Scratch(docs.sparkSession, "divergence")
    residents, whole, placed = vectors(docs, scratch)
    met = None
    for m in meetings(residents, whole, scratch, top):
        met = m if met is None else met.union(m)
    pairs = met.where("item is not null").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    best = met.where("pos is not null").join(placed.select("lang", "chunk", "pos", "term"), ["lang", "chunk", "pos"])
    best = best.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    w = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(w)
    return pairs.withColumn("rank", rank).unionByName(best.withColumn("rank", rank).where(F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE = r"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ws
  from documents
), w as (select lang, source, rid, unnest(ws) as term from d),
kept as (select lang, term, count(*) as total from w group by lang, term having count(distinct rid) >= 3),
l as (select lang, count(*) as v, sum(total) as n from kept group by lang),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by lang, source, term),
gn as (select g.lang, g.source, coalesce(sum(c.n), 0) as n from g left join c using (lang, source) group by g.lang, g.source),
p as (
  select gn.lang, gn.source, k.term, coalesce(c.n, 0) as cnt, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)::hugeint) // (gn.n + l.v)::hugeint as p
  from gn join l using (lang) join kept k using (lang) left join c on c.lang = gn.lang and c.source = gn.source and c.term = k.term
), q as (select kept.lang, term, 1 + (1000000000::hugeint * (total + 1)::hugeint) // (l.n + l.v)::hugeint as q from kept join l using (lang)),
f as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source
), parts as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all
  select p.lang, p.source, 'term', p.term, (((p - q) * (p - q)) // q)::bigint from p join q on p.lang = q.lang and p.term = q.term where cnt > 0 and p > q
)
select lang, source, part, item, value, rank::int as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from parts) where part = 'pair' or rank <= 200
"""
