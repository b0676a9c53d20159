"""Best-fit packing of token sequences with Martello-Toth dominance reduction.

A document becomes its byte-level BPE ids and one end id 0.  Only a document longer than the
capacity is cut: into full pieces, with the remainder as its first piece.

Packing works on the histogram of piece lengths, which has at most ``capacity`` rows however many
documents there are, so the driver's part is bounded:

* ``reduce_dominated`` goes through the lengths from the longest down, fixes sequences that provably dominate every
  alternative for a piece (a piece alone, a pair that fills its sequence, the largest partner when no two pieces fit beside
  it), and starts again on the smaller instance until nothing more can be fixed;
* ``best_fit`` packs what is left, longest first, each piece into the fullest sequence that takes it;
  equal pieces are placed in bulk.

Both give *patterns*: a multiset of lengths and how many sequences use it.  Each piece then finds
its place by its rank among the pieces of its length: ranks are counted per task and shifted by
per-task sums, so that no task needs all pieces of a length.

Tokens: the vocabulary's own file is read by ``tokenizers`` in tests; the workers use the same
ranks through ``tiktoken``, encode each distinct pretoken once, and split pretokens with
numpy.  Texts that hold the end-of-text marker go through the marker rule of the vocabulary file.

Defined cases: a null text is empty and packs as the single id 0; rows that repeat are packed as
often as they come; a null doc_id stays null; very long texts are cut into full pieces; pieces of one length are interchangeable
and take its places in the order of their ranks; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.llm.common import Scratch, table, text_batches
from murmur.llm.words import chunks, fresh_key, released, same_bytes, word_hashes

CAPACITY = 2048
END_ID = 0
MARKER, MARKER_ID = "<|endoftext|>", 50256
#: Bound of a worker's cache of pretokens.
CACHE_ENTRIES = 300_000

# ---------------------------------------------------------------- tokens


_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
#: Unicode White_Space, as the pattern's \\s means it.
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    import sys
    import unicodedata

    kind = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(sys.maxunicode + 1)), dtype=np.uint8)
    out[_WHITE] = _SPACE
    return out


def pretoken_starts(cp: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pretokens of the vocabulary's pattern begin; first: where documents begin.

    Runs of letters, numbers, others and white space are tokens, except that the last space of a
    run of white space belongs to what follows (if it is a plain space) or stands alone, and that
    an apostrophe alone takes s, t, m, d, re, ve or ll from the letters after it.
    """
    n = len(cp)
    c = classes[cp]
    edge = np.zeros(n + 1, dtype=bool)
    edge[first] = True
    edge[n] = True
    run = edge[:n].copy()
    run[1:] |= c[1:] != c[:-1]
    start = run.copy()
    solid = np.flatnonzero(run & (c != _SPACE) & ~edge[:n])  # not at a document's start
    after = solid[c[solid - 1] == _SPACE]
    start[after - 1] = True
    start[after[cp[after - 1] == 0x20]] = False
    quote = np.flatnonzero((cp == 0x27) & run)
    quote = quote[quote + 1 < n]
    quote = quote[start[quote] & (c[quote + 1] == _LETTER) & ~edge[quote + 1]]
    if len(quote):
        one = cp[quote + 1]
        last = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~edge[quote + 2] & (c[last] == _LETTER), cp[last], 0)
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[quote[short | long] + 1] = False
        nxt = np.concatenate([quote[short] + 2, quote[long] + 3])
        nxt = nxt[nxt < n]
        start[nxt[(c[nxt] == _LETTER)]] = True
    return np.flatnonzero(start)


class PretokenEncoder:
    """Ids of many texts at once, each distinct pretoken encoded once."""

    def __init__(self, ranks_path: str | None = None):
        import public_tokenizers
        import tiktoken

        path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={MARKER: MARKER_ID})
        self.single = self.encoding._core_bpe.encode_single_piece
        self.classes = _classes()
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.key = fresh_key()
        self.flat, self.at, self.size = np.zeros(1 << 16, dtype=np.uint32), np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.used = 0

    def _learn(self, keys: list[bytes], words: list[str]) -> None:
        lists = [self.single(w.encode()) for w in words]
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        flat = np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(sizes.sum()))
        n = len(self.index)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(keys) > len(self.at):
            self.at, self.size = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.size, np.zeros_like(self.size)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.at[n : n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(keys)] = sizes
        self.index.update(zip(keys, range(n, n + len(keys))))
        self.used += len(flat)

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a chunk of UTF-8 bytes."""
        text = data.tobytes().decode()
        if MARKER in text:
            return [np.asarray(self.encoding.encode(data[a:b].tobytes().decode(), allowed_special={MARKER}), dtype="<u4") for a, b in zip(offsets[:-1], offsets[1:])]
        if not text:
            return [np.zeros(0, dtype="<u4")] * (len(offsets) - 1)
        cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        lead = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        docs = lead[offsets]
        starts = pretoken_starts(cp, docs[:-1][docs[:-1] < len(cp)], self.classes)
        ends = np.append(starts[1:], len(cp))
        place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        lo, hi = place[starts], place[ends]
        _, where, inverse = np.unique(word_hashes(data, lo, hi, self.key), return_index=True, return_inverse=True)
        # The hash only gathers equal pretokens; what is equal, and what is known, is told by their bytes.
        if not same_bytes(data, lo, hi, lo[where[inverse]], hi[where[inverse]]).all():
            where = np.arange(len(lo))
            inverse = where
        if len(self.index) + len(where) > CACHE_ENTRIES:
            self.clear()
        raw = data.tobytes()
        listed = [raw[x:y] for x, y in zip(lo[where].tolist(), hi[where].tolist())]
        known = [*map(self.index.get, listed)]
        new = [i for i, x in enumerate(known) if x is None]
        if new:
            a, b = starts[where[new]].tolist(), ends[where[new]].tolist()
            self._learn([listed[i] for i in new], [text[x:y] for x, y in zip(a, b)])
            known = [*map(self.index.get, listed)]
        which = np.asarray(known, dtype=np.int64)[inverse]
        sizes = self.size[which]
        upto = np.zeros(len(which) + 1, dtype=np.int64)
        np.cumsum(sizes, out=upto[1:])
        ids = self.flat[np.repeat(self.at[which] - upto[:-1], sizes) + np.arange(upto[-1])]
        cuts = upto[np.searchsorted(starts, docs)]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


_encoder: PretokenEncoder | None = None


def encoder() -> PretokenEncoder:
    global _encoder
    if _encoder is None:
        _encoder = PretokenEncoder()
    return _encoder


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, slot int, nth long"


def _pieces(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, slot, seen = encoder(), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            out = []
            for docs, data, offsets in chunks(batch.column(0), batch.column(1)):
                for doc, ids in zip(docs, enc.batch(data, offsets)):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4", copy=False)
                    at = 0
                    first = len(ids) % capacity or capacity
                    for piece in range(1 + (len(ids) - first) // capacity):
                        n = first if piece == 0 else capacity
                        out.append((doc, piece, at, n, zlib.crc32(ids[at : at + n].tobytes()), slot, seen[n]))
                        seen[n] += 1
                        at += n
            names = [x.split()[0] for x in PIECES.split(", ")]
            cols = list(zip(*out)) or [()] * len(names)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(released(_pieces(capacity)), PIECES)


# ---------------------------------------------------------------- packing of a histogram

Pattern = tuple[tuple[int, ...], int]  # lengths of one sequence in order, number of sequences


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fixes dominating sets until none is left; (fixed patterns, what is left).

    For a piece j and the others that are left:

    * nothing fits beside it: j alone is fixed;
    * some k fills the sequence with it: {j, k} dominates.  What any other set holds beside j is no longer than k, so
      it can trade places with k;
    * no two pieces fit beside it: {j, largest k that fits} dominates in the same way.

    A length to which none of these applies is set aside and the next shorter one tried; each pass works on what the one before left.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    fixed: list[Pattern] = []
    again = True
    while again:
        again = False
        sizes = sorted(left)

        def take(n: int, c: int) -> None:
            left[n] -= c
            if not left[n]:
                del left[n]
                sizes.pop(bisect.bisect_left(sizes, n))

        for j in sizes[::-1]:
            while left.get(j):
                room = capacity - j
                beside = bisect.bisect_right(sizes, room) - 1
                if beside >= 0 and sizes[beside] == j and left[j] == 1:  # j is no partner of itself
                    beside -= 1
                if beside < 0:
                    fixed.append(((j,), left[j] if room < j else 1))
                    take(j, fixed[-1][1])
                    again = True
                    continue
                k = sizes[beside]
                if k != room and _two_least(left, sizes, j) <= room:
                    break
                n = left[j] // 2 if k == j else min(left[j], left[k])
                fixed.append(((j, k), n))
                take(j, n)
                take(k, n)
                again = True
    return fixed, left


def _two_least(left: dict[int, int], sizes: list[int], j: int) -> int:
    """Sum of the two shortest pieces beside one piece j."""
    least = []
    for n in sizes[:3]:
        least += [n] * min(2, left[n] - (n == j))
    return sum(least[:2]) if len(least) > 1 else 1 << 62


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit decreasing on a histogram; patterns with their numbers."""
    open_: dict[int, list[Pattern]] = defaultdict(list)
    room: list[int] = []  # sorted rooms that have open sequences

    def put(r: int, p: Pattern) -> None:
        if r not in open_ or not open_[r]:
            bisect.insort(room, r)
        open_[r].append(p)

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            at = bisect.bisect_left(room, n)
            if at == len(room):  # new sequences
                per = capacity // n
                whole, rest = divmod(left, per)
                if whole:
                    put(capacity - per * n, ((n,) * per, whole))
                if rest:
                    put(capacity - rest * n, ((n,) * rest, 1))
                left = 0
                continue
            r = room[at]
            have, number = open_[r].pop()
            if not open_[r]:
                room.pop(at)
                del open_[r]
            per = r // n
            whole = min(number, left // per)
            rest = 0
            if whole < number and whole * per < left:
                rest = left - whole * per  # fewer than per: they share one sequence
            if whole:
                put(r - per * n, (have + (n,) * per, whole))
            if rest:
                put(r - rest * n, (have + (n,) * rest, 1))
            spare = number - whole - (1 if rest else 0)
            if spare:
                put(r, (have, spare))
            left -= whole * per + rest
    return [p for ps in open_.values() for p in ps]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


def places(patterns: list[Pattern]) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length: (first rank, first sequence, number of sequences, offset), ranks in order."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, number in patterns:
        at = 0
        for n in lengths:
            out[n].append((used[n], sequence, number, at))
            used[n] += number
            at += n
        sequence += number
    return out


# ---------------------------------------------------------------- operator

def pack_pieces(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut: rows of PIECES, already written. Adds sequence_id and offset."""
    per_task = cut.groupBy("slot", "length").agg(F.count("*").alias("n"))
    # At most tasks x capacity rows; the driver gets one row for each length.
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(solve(counts, capacity))
    rows = [(n, *x) for n, xs in where.items() for x in xs]

    # The ranks of a task's pieces begin where those of the tasks before end.
    before = per_task.select(
        "slot", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("slot")) - F.col("n")).alias("before")
    )
    spark = cut.sparkSession
    spans = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "length long, lo long, seq long, number long, offset long")
    # Each task's block of ranks of a length meets the spans it overlaps: an equi-join on length, then a
    # range test on whole blocks, and only then single pieces.
    block = per_task.withColumnRenamed("n", "size").join(before, ["slot", "length"])
    fit = block.join(spans.hint("broadcast") if len(rows) * 48 <= (8 << 20) else spans, "length").where(
        (F.col("lo") < F.col("before") + F.col("size")) & (F.col("before") < F.col("lo") + F.col("number"))
    )
    fit = fit.groupBy("slot", "length", "before").agg(F.sort_array(F.collect_list(F.struct("lo", "seq", "offset"))).alias("spans"))
    j = cut.join(fit, ["slot", "length"])
    rank = F.col("before") + F.col("nth")
    j = j.withColumn("s", F.element_at(F.filter("spans", lambda x: x["lo"] <= rank), -1))
    return j.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("s.seq") + rank - F.col("s.lo")).alias("sequence_id"), F.col("s.offset").alias("offset")
    )


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    text_batches(docs.sparkSession)
    cut = Scratch(docs.sparkSession, "pack").write(pieces(docs, capacity), "pieces")
    return pack_pieces(cut, capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
