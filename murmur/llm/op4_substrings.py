"""Substring dedup over a compacted de Bruijn graph of the corpus.

Edges are word k-mers with k = ``WINDOW``; an edge that occurs twice is a repeated window, and every word
under such a window goes.  The graph is far larger than the corpus, so it is never written edge by edge:

* *Paths.*  Each edge has a minimiser, the smallest hash among its ``ANCHOR``-word grams.  Consecutive
  edges of a document with the same minimiser occurrence form a path (a super-k-mer).  Equal edges
  have equal minimisers, so edges can only repeat between paths with the same anchor.
* *Compaction.*  A join on the anchor drops paths whose anchor occurs once.  Paths are then grouped by
  anchor and by the hash of their whole word sequence.  An anchor with a single sequence is a
  nonbranching path: all of its edges repeat together and one row settles them.  In the same way,
  a sequence that occurs twice settles its own edges.
* *Verification by source coordinates.*  Where sequences branch, one occurrence of each is looked up in its
  document at its coordinates, and its edges are compared one by one.

Sequences and edges are the same only if a 128-bit cryptographic digest of their words is (BLAKE2 over the words at their source
coordinates, with one space between).  The faster hashes, which have a key of the run, only choose anchors: where two of those collide, more
is compared and nothing is found or lost.

Each removal is a span of coordinates; the spans of a document meet its text in one join.

Defined cases: a null text has no words; a text shorter than a window loses nothing; rows that repeat
count as occurrences, so they lose all windows; rows of one doc_id with different texts are documents of their own, and so
are rows without doc_id; ties (equal windows) are all removed, none is kept as the first; very long texts are read whole; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import Scratch, keyed, table, text_batches, texts_of
from murmur.llm.words import chunks, digests, fresh_key, joined, split, window_hashes, within, word_hashes

WINDOW, ANCHOR = 35, 8
_SEGMENT = 1 << 23
_KEY = ["did", "th"]


def minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of width grams the position of its smallest hash, the leftmost among equals."""
    n = len(grams) - width + 1
    out = np.empty(max(n, 0), dtype=np.int64)
    for lo in range(0, n, _SEGMENT):
        g = grams[lo : min(lo + _SEGMENT, n) + width - 1]
        # The upper 40 bits of the hash, then the position: one minimum finds both.
        low = (g & np.uint64(~0xFFFFFF & (1 << 64) - 1)) | np.arange(len(g), dtype=np.uint64)
        reach = 1
        while reach * 2 <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < width:
            low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
        out[lo : lo + len(low)] = lo + (low & np.uint64(0xFFFFFF)).astype(np.int64)
    return out


def paths(h: np.ndarray, word_off: np.ndarray, window: int, anchor: int):
    """(document position, first edge in its document, edges, anchor hash, first word in the chunk) of all paths of a chunk."""
    n = len(h) - window + 1
    if n <= 0:
        return None
    grams = window_hashes(h, anchor, 3)
    at = minimisers(grams, window - anchor + 1)
    ok = within(word_off, len(h), window)
    new = np.ones(n, dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | ~ok[:-1]
    new[word_off[:-1][word_off[:-1] < n]] = True
    new &= ok
    first = np.flatnonzero(new)
    if not len(first):
        return None
    stop = ~ok
    ends = np.append(np.flatnonzero(new | stop), n)
    end = ends[np.searchsorted(ends, first, "right")]
    count = end - first
    doc = np.searchsorted(word_off, first, "right") - 1
    return doc, first - word_off[doc], count, grams[at[first]], first


PATHS = "anchor long, sequence binary, did long, th long, start int, edges int"


def _paths(window: int, anchor: int, key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for rows, data, offsets in chunks(pa.array(range(batch.num_rows)), batch.column(2)):
                starts, ends, word_off = split(data, offsets)
                found = paths(word_hashes(data, starts, ends, key), word_off, window, anchor)
                if found is not None:
                    doc, start, count, a, first = found
                    at = rows[doc]
                    text, begin = joined(data, starts, ends)
                    cols = [a.view(np.int64), pa.array(digests(text, begin[first], begin[first + count + window - 1]), pa.binary()), did[at], th[at], start.astype(np.int32), count.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=["anchor", "sequence", "did", "th", "start", "edges"])

    return run


EDGES = "anchor long, edge binary, did long, th long, at int, n int"


def _edges(window: int):
    """From rows (did, th, text, spans) to the edges under the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(3)
            flat = spans.flatten()
            sizes = np.diff(np.asarray(spans.offsets)) if len(spans) else np.zeros(0, int)
            field = {f: np.asarray(flat.field(i)) for i, f in enumerate(("start", "edges", "anchor", "n"))}
            first = np.concatenate([[0], np.cumsum(sizes)])
            done = 0
            did, th = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for rows, data, offsets in chunks(pa.array(range(batch.num_rows)), batch.column(2)):
                starts, ends, word_off = split(data, offsets)
                text, place = joined(data, starts, ends)
                lo, hi = first[done], first[done + len(rows)]
                owner = np.repeat(np.arange(len(rows)), sizes[done : done + len(rows)])
                count = field["edges"][lo:hi].astype(np.int64)
                begin = field["start"][lo:hi].astype(np.int64)
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at = np.repeat(begin, count) + step
                where = np.repeat(word_off[owner], count) + at
                row = np.repeat(rows[owner], count)
                cols = [np.repeat(field["anchor"][lo:hi], count), pa.array(digests(text, place[where], place[where + window]), pa.binary()), did[row], th[row], at.astype(np.int32), np.repeat(field["n"][lo:hi], count).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=["anchor", "edge", "did", "th", "at", "n"])
                done += len(rows)

    return run


def repeated_spans(docs: DataFrame, scratch: Scratch, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(did, th, start, edges): coordinates of repeated edges."""
    rows = keyed(docs.select("doc_id", "text")).select(*_KEY, "text")
    runs = scratch.write(rows.mapInArrow(_paths(window, anchor, fresh_key()), PATHS), "paths")
    again = scratch.write(runs.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "anchors")
    kept = scratch.write(runs.join(again, "anchor", "left_semi"), "kept")
    scratch.drop(runs, again)
    groups = kept.groupBy("anchor", "sequence").agg(F.count("*").alias("n"), F.min(F.struct(*_KEY, "start", "edges")).alias("one"))
    groups = scratch.write(groups, "groups")
    branching = scratch.write(groups.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "branching")
    # One occurrence of each sequence of a branching anchor, gathered by document (bounded by its length).
    look = groups.join(branching, "anchor", "left_semi")
    look = look.groupBy(F.col("one.did").alias("did"), F.col("one.th").alias("th")).agg(
        F.collect_list(F.struct(F.col("one.start").alias("start"), F.col("one.edges").alias("edges"), "anchor", F.least("n", F.lit(2)).alias("n"))).alias("spans")
    )
    look = scratch.write(look, "look")
    edges = texts_of(rows, look).join(look, _KEY).select(*_KEY, "text", "spans").mapInArrow(_edges(window), EDGES)
    edges = scratch.write(edges, "edges")
    twice = scratch.write(edges.groupBy("anchor", "edge").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "edge"), "twice")
    single = edges.where("n = 1").join(twice, ["anchor", "edge"], "left_semi").select(*_KEY, F.col("at").alias("start"), F.lit(1).alias("edges"))
    settled = scratch.write(groups.where("n > 1").select("anchor", "sequence"), "settled")
    whole = kept.join(settled, ["anchor", "sequence"], "left_semi").select(*_KEY, "start", "edges")
    out = scratch.write(whole.unionByName(single), "spans")
    scratch.drop(kept, groups, branching, look, edges, twice, settled)
    return out


def removed_words(n: int, spans: list[dict], window: int) -> np.ndarray:
    """Which words lie under a repeated window."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, [s["start"] for s in spans], 1)
    np.add.at(change, [s["start"] + s["edges"] + window - 1 for s in spans], -1)
    return np.cumsum(change[:-1]) > 0


def _apply(window: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, spans in zip(*(batch.column(i) for i in range(3))):
                words = (text.as_py() or "").encode().split()
                gone = 0
                if spans.is_valid and len(words):
                    lost = removed_words(len(words), spans.as_py(), window)
                    gone = int(lost.sum())
                    kept = b" ".join([w for w, x in zip(words, lost.tolist()) if not x])
                else:
                    kept = b" ".join(words)
                out.append((doc.as_py(), len(words), gone, hashlib.sha256(kept).hexdigest() if digest else kept.decode()))
            cols = list(zip(*out)) or [()] * 4
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept"])

    return run


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the kept words joined by one space (or their SHA-256)."""
    text_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "substrings")
    spans = repeated_spans(docs, scratch, window, anchor)
    # A set, as rows that repeat bring the same spans; written, so that both sides of the join are plain exchanges and a key can be split.
    per = scratch.write(spans.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "edges")).alias("spans")), "per-row")
    scratch.drop(spans)
    rows = keyed(docs.select("doc_id", "text")).join(per, _KEY, "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_apply(window, digest), f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'kept'} string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


ORACLE = rf"""
with w as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
         row_number() over () as rid from documents
), e as (
  select rid, unnest(range(1, len(w) - {WINDOW} + 2)) as i from w where len(w) >= {WINDOW}
), h as (select e.rid, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) as h from e join w using (rid)),
t as (select rid, i from (select rid, i, count(*) over (partition by h) as c from h) where c > 1),
x as (select rid, list(i order by i) as s from t group by rid),
pos as (select rid, unnest(range(1, len(w) + 1)) as p, unnest(w) as word from w),
near as (
  select pos.rid, p, word, max(t.i) over (partition by pos.rid order by p rows unbounded preceding) as last_start
  from pos left join t on t.rid = pos.rid and t.i = pos.p
), f as (select rid, p, word, last_start is not null and p < last_start + {WINDOW} as gone from near),
g as (
  select rid, count(*) filter (where gone) as n_removed, coalesce(string_agg(word, ' ' order by p) filter (where not gone), '') as kept from f group by rid
)
select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join g using (rid)
"""
