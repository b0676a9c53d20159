"""N-gram Jaccard join: a prefix-tree join over word shingles, and components of its links.

A document's set holds its distinct word shingles.  Documents link when
``100 * intersection >= THRESHOLD * union``.

1. *Global order.*  Shingles are ordered by (frequent, count, hash): the frequency is counted over
   all documents, on the part of each set that can become a prefix.  The order only decides speed; any
   global order gives the same links.
2. *Classes.*  Equal sets become one class; only its representative, the row of the smallest doc_id, is compared.
3. *Prefixes.*  Linked sets share a shingle among their first ``n - ceil(t n) + 1``.  Posting lists with a
   single class are dropped.
4. *Candidates.*  Short lists give their pairs, filtered by length and by position (shingles that one prefix
   has and the other lacks bound the overlap).  A long list is never expanded into pairs: each of its classes is first
   compared with a leader of the list.  Components of the links found so far then show what is still open: pairs of different
   components.  Lists with the same largest component form a group, dealt into bands of length and blocks; blocks outside that component
   meet all others, and blocks inside it never each other.  A large group of near copies thus costs about one
   comparison for each member and one for each block and straggler.
5. *Prefix trees.*  The ordered sets of a gathering (the partners of a class, in parts of bounded size, or a block) form a prefix
   tree: shared beginnings share their partial overlap, and a probe leaves a
   subtree as soon as the lengths that remain cannot reach the required overlap, or all of it is connected with the
   probe.  Only links that connect something new are returned, so a large group of near copies gives no more links
   than it has members.  Gatherings are rows of one sorted stream; none is collected.
6. *Components* of the links (Spark joins, see ``common.components``).

Shingles are compared as 64-bit hashes under a key drawn for each run (see ``words``), so no text can be built against them; two
given shingles are taken for one with a chance of 2**-64.

Defined cases: no text or no words: an empty set, linked with nothing, n_shingles 0, own component;
fewer words than a shingle: the whole sequence is the one shingle; rows that repeat link; rows of one doc_id with different
texts are documents of their own; a row without doc_id links like any other, and its component_id is the smallest doc_id that
its component has, null if it has none; other columns are ignored; an empty table gives no rows; very long texts make
gatherings of fewer members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import Scratch, components, divided, fresh, keyed, table, text_batches, texts_of, thinned
from murmur.llm.words import LOWER, chunks, fresh_key, mix, released, split, window_hashes, word_hashes
from murmur.session import one_off

SHINGLE, THRESHOLD = 4, 85
#: A shingle in so many candidate prefixes counts as frequent.
FREQUENT = 16
#: The most frequent ones, up to this number, are placed by count; the rest by hash (speed only).
MAX_FREQUENT = 200_000
#: Lists up to this length give their pairs at once (speed only).
SHORT = 12
#: Sets and shingles in one prefix tree, so that trees of long documents have fewer sets (memory only).
PART, WEIGHT = 256, 100_000
#: Leaders are tried again while more open pairs than this remain for each row of a long list (speed only).
OPEN = 64


def prefix_length(n: np.ndarray | int, threshold: int = THRESHOLD):
    return n - -(-threshold * n // 100) + 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, key: bytes) -> Iterator[np.ndarray]:
    """For each document its shingle hashes, distinct and ascending."""
    data = LOWER[data]
    starts, ends, off = split(data, offsets)
    h = word_hashes(data, starts, ends, key)
    s = window_hashes(h, k, 1)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        if b - a >= k:
            yield np.unique(s[a : b - k + 1])
        elif b > a:
            x = np.asarray([b - a], dtype=np.uint64)
            for w in h[a:b]:
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + w)
            yield x
        else:
            yield s[:0]


class Order:
    """The global order: frequent shingles have a place by count."""

    def __init__(self, frequent: list[tuple[int, int]]):
        t = np.asarray([x for x, _ in frequent], dtype=np.int64).view(np.uint64)
        c = np.asarray([n for _, n in frequent], dtype=np.int64)
        by_count = np.lexsort((t, -c))
        place = np.empty(len(t), dtype=np.uint64)
        place[by_count] = np.arange(len(t), dtype=np.uint64)
        at = np.argsort(t)
        self.tokens, self.place = t[at], place[at]

    def split(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rare shingles by hash, frequent ones, their places)."""
        if not len(self.tokens) or not len(s):
            return s, s[:0], s[:0]
        i = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        known = self.tokens[i] == s
        return s[~known], s[known], self.place[i[known]]

    def prefix(self, s: np.ndarray, n: int) -> np.ndarray:
        """The first n of a set, rarest first."""
        rare, often, place = self.split(s)
        return rare[:n] if len(rare) >= n else np.concatenate([rare, often[np.argsort(place)[::-1]]])[:n]

    def tree_keys(self, s: np.ndarray) -> np.ndarray:
        """Numbers that sort most frequent first, so that similar sets share beginnings."""
        rare, _, place = self.split(s)
        return np.concatenate([np.sort(place), rare])


def _count_tokens(k: int, threshold: int, key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in chunks(batch.column(0), batch.column(1)):
                # Frequent ones move to the end of the order, so prefixes reach further than without them.
                out = [s[: prefix_length(len(s), threshold) * 8 // 5] for s in shingle_sets(data, offsets, k, key) if len(s)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["token"])

    return run


SETS = "doc_id long, did long, th long, n int, k1 long, k2 long, prefix array<long>"


def _prefixes(order, k: int, threshold: int, key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = order.value
        for batch in batches:
            for rows, data, offsets in chunks(pa.array(range(batch.num_rows)), batch.column(3)):
                n, k1, k2, toks, sizes = [], [], [], [], [0]
                for s in shingle_sets(data, offsets, k, key):
                    n.append(len(s))
                    k1.append(mix(s + np.uint64(0x1234567)).sum(dtype=np.uint64))
                    k2.append(mix(s ^ np.uint64(0xABCDEF987654321)).sum(dtype=np.uint64))
                    p = o.prefix(s, prefix_length(len(s), threshold)) if len(s) else s
                    toks.append(p)
                    sizes.append(len(p))
                flat = np.concatenate(toks).view(np.int64) if toks else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(flat))
                as_long = lambda x: pa.array(np.asarray(x, dtype=np.uint64).view(np.int64))
                own = [batch.column(i).slice(int(rows[0]), len(rows)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int32()), as_long(k1), as_long(k2), lists], names=["doc_id", "did", "th", "n", "k1", "k2", "prefix"])

    return run


# ---------------------------------------------------------------- verification


class PrefixTree:
    """Ordered sets as a path-compressed tree; a node covers positions lo..hi of the set ``rep``."""

    def __init__(self, sets: list[np.ndarray]):
        big = [s.astype(">u8").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=big.__getitem__)
        self.sets = [sets[i] for i in self.order]
        self.root = self._build()

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def _build(self):
        # node: [rep, lo, hi, children, members, least size, largest size]
        root = [0, 0, 0, [], [], 1 << 60, 0]
        stack = [root]
        for i, s in enumerate(self.sets):
            depth = self._common(self.sets[i - 1], s) if i else 0
            last = None
            while stack[-1][2] > depth:
                last = stack.pop()
                if stack[-1][2] < depth:  # the common part ends inside ``last``: cut it there
                    upper = [last[0], last[1], depth, [last], [], last[5], last[6]]
                    last[1] = depth
                    stack[-1][3][-1] = upper
                    stack.append(upper)
                    break
            if len(s) > stack[-1][2] or i == 0:
                node = [i, stack[-1][2], len(s), [], [i], len(s), len(s)]
                stack[-1][3].append(node)
                stack.append(node)
            else:
                stack[-1][4].append(i)
        self._sizes(root)
        return root

    def _sizes(self, root) -> None:
        walk, todo = [], [root]
        while todo:
            node = todo.pop()
            walk.append(node)
            todo += node[3]
        for node in reversed(walk):
            own = [len(self.sets[i]) for i in node[4]]
            node[5] = min(own + [c[5] for c in node[3]], default=1 << 60)
            node[6] = max(own + [c[6] for c in node[3]], default=0)

    def uniform(self, label: np.ndarray) -> dict[int, int]:
        """By node (its id): the label of all sets below, or -1. label: by index of the sets as given."""
        out, walk, todo = {}, [], [self.root]
        while todo:
            node = todo.pop()
            walk.append(node)
            todo += node[3]
        for node in reversed(walk):
            seen = {int(label[self.order[i]]) for i in node[4]} | {out[id(c)] for c in node[3]}
            out[id(node)] = seen.pop() if len(seen) == 1 else -1
        return out

    def join(self, probes: list[np.ndarray], probe_label: np.ndarray, label: np.ndarray, threshold: int) -> list[tuple[int, int]]:
        """Links (probe, set) that join different labels: enough to connect all that is linked.

        All probes walk the tree together, so a shared beginning is compared once with each.  A probe leaves a
        subtree when its sets cannot reach the threshold any more, or all have its label.
        """
        n = np.asarray([len(s) for s in probes], dtype=np.int64)
        flat = np.concatenate(self.sets)
        mine = np.concatenate(probes)
        known = np.intersect1d(flat, mine)
        has = np.zeros((len(known) + 1, len(probes)), dtype=bool)
        if len(known):
            at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            hit = known[at] == mine
            has[at[hit], np.repeat(np.arange(len(probes)), n)[hit]] = True
            rows = [np.where(known[i] == s, i, len(known)) for s in self.sets for i in [np.minimum(np.searchsorted(known, s), len(known) - 1)]]
        else:
            return []
        canon = np.arange(int(max(label.max(), probe_label.max())) + 1)
        same = self.uniform(label)
        out, todo = [], [(self.root, np.arange(len(probes)), np.zeros(len(probes), dtype=np.int64))]
        while todo:
            node, active, have = todo.pop()
            if node[2] > node[1]:
                have = have + has[rows[node[0]][node[1] : node[2]]][:, active].sum(0)
            # The best any set below can reach: all that remains of it, or of the probe, is common.
            best = np.minimum(have + node[6] - node[2], n[active])
            least = np.maximum(node[5], best)
            ok = 100 * best >= threshold * (n[active] + least - best)
            one = same[id(node)]
            if one >= 0:
                ok &= canon[probe_label[active]] != canon[one]
            active, have = active[ok], have[ok]
            if not len(active):
                continue
            for i in node[4]:
                m, j = len(self.sets[i]), self.order[i]
                for k in active[100 * have >= threshold * (n[active] + m - have)].tolist():
                    x, y = canon[probe_label[k]], canon[label[j]]
                    if x != y:
                        out.append((k, j))
                        canon[canon == max(x, y)] = min(x, y)
            todo += [(c, active, have) for c in node[3]]
        return out


PROBE, MEMBER = 0, 1


def _links(rows: list[tuple[int, int, int, np.ndarray]], threshold: int) -> list[tuple[int, int]]:
    """Links of one gathering of rows (role, cls, component, set): its probes against a tree of its members."""
    probe, member = [r for r in rows if r[0] == PROBE], [r for r in rows if r[0] == MEMBER]
    if not probe or not member:
        return []
    _, label = np.unique([r[2] for r in probe + member], return_inverse=True)
    found = PrefixTree([r[3] for r in member]).join([r[3] for r in probe], label[: len(probe)], label[len(probe) :], threshold)
    return [(probe[x][1], member[y][1]) for x, y in found]


def _join(order, k: int, threshold: int, key: bytes):
    """From rows (gathering, role, cls, comp, text), sorted by gathering, to links; a gathering may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = order.value
        open_, rows = None, []
        for batch in batches:
            sets, found = [], []
            for _, data, offsets in chunks(pa.array(range(batch.num_rows)), batch.column(4)):
                sets += [o.tree_keys(s) for s in shingle_sets(data, offsets, k, key)]
            for g, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), sets):
                if g != open_:
                    found += _links(rows, threshold)
                    open_, rows = g, []
                rows.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])
        found = _links(rows, threshold)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    return run


class _Join:
    """What the steps of one join share: its classes, texts, order and scratch tables."""

    def __init__(self, docs: DataFrame, k: int, threshold: int):
        self.spark = docs.sparkSession
        text_batches(self.spark)
        self.scratch, self.k, self.threshold = Scratch(self.spark, "jaccard"), k, threshold
        self.key = fresh_key()
        self.docs = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "did", "th", "text")

    def order(self) -> None:
        counts = self.docs.select("did", "text").mapInArrow(released(_count_tokens(self.k, self.threshold, self.key)), "token long").groupBy("token").count().where(f"count >= {FREQUENT}")
        with one_off(self.spark):
            frequent = counts.orderBy(F.desc("count"), "token").limit(MAX_FREQUENT).collect()
        self.order_ = self.spark.sparkContext.broadcast(Order([(r[0], r[1]) for r in frequent]))

    def classes(self) -> None:
        """sets: one row for each row of docs; classes: (cls, n, members, nul, did, th) of equal sets; prefixed: their prefixes, until ``meets``."""
        w = self.scratch.write
        rows = w(self.docs.mapInArrow(released(_prefixes(self.order_, self.k, self.threshold, self.key)), SETS), "prefixes")
        one = F.min(F.struct(F.col("doc_id").isNull().alias("nul"), "did", "th")).alias("one")
        c = rows.where("n > 0").groupBy("k1", "k2", "n").agg(one, F.count("*").alias("members"), F.first("prefix").alias("prefix"))
        # Numbered once, as the table is written.
        self.prefixed = w(c.select(F.monotonically_increasing_id().alias("cls"), "k1", "k2", "n", "members", "one.nul", "one.did", "one.th", "prefix"), "prefixed")
        # Prefixes are nearly all of both tables, and the steps after ``meets`` do not read them.
        self.sets, self.all_classes = w(rows.drop("prefix"), "sets"), w(self.prefixed.drop("prefix"), "classes")
        self.scratch.drop(rows)
        self.where = self.all_classes.select("cls", "n", "did", "th")

    def meets(self) -> DataFrame:
        """(token, c, cls, n, pos): the posting lists of at least two classes."""
        posts = self.prefixed.select("cls", "n", F.posexplode("prefix").alias("pos", "token"))
        lists = self.scratch.write(posts.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "lists")
        out = self.scratch.write(thinned(posts, "token", lists).join(lists, "token").select("token", "c", "cls", "n", "pos"), "meets")
        self.scratch.drop(lists, self.prefixed)
        return out

    def verify_pairs(self, pairs: DataFrame) -> DataFrame:
        """(a, b): links among pairs (a, b) that connect all that is linked; each a meets its partners, in parts."""
        w = self.scratch.write
        pairs = w(pairs.join(self.where.select(F.col("cls").alias("b"), "n", "did", "th"), "b"), "pairs")
        parts = F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum("n") / WEIGHT)).cast("int")
        size = w(pairs.groupBy("a").agg(parts.alias("parts")), "hubs")
        gathering = F.xxhash64("a", "part")
        members = pairs.join(size, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
        members = members.select(gathering.alias("gathering"), F.lit(MEMBER).alias("role"), F.col("b").alias("cls"), F.col("b").alias("comp"), "did", "th")
        hubs = size.join(self.where, size.a == self.where.cls).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        hubs = hubs.select(gathering.alias("gathering"), F.lit(PROBE).alias("role"), F.col("a").alias("cls"), F.col("a").alias("comp"), "did", "th")
        return self.verify(members.unionByName(hubs), pairs, size)

    def verify_groups(self, rows: DataFrame, lists: DataFrame) -> DataFrame:
        """(a, b): links between different components of open lists that connect all that is linked; block meets block.

        The lists that share their largest component are one group g.  Its classes are dealt, by length, into bands, and each band
        into blocks of those in the component (kind 0) and of the others (kind 1).  Linked sets are in the same band or in
        neighbouring ones.  Each block of the others meets every block of the component, and every one of the others once.
        """
        w = self.scratch.write
        band = F.floor(F.log("n") / F.lit(math.log(100 / self.threshold))).cast("int")
        of = rows.join(lists.select("token", F.col("top").alias("g")), "token").select("g", "cls", "n", "comp", band.alias("band"), (F.col("comp") != F.col("g")).cast("int").alias("kind")).distinct()
        of = w(of.join(self.where.drop("n"), "cls"), "bands")
        count = F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum("n") / WEIGHT)).cast("int")
        size = w(of.groupBy("g", "band", "kind").agg(count.alias("blocks")), "blocks")
        of = of.join(size, ["g", "band", "kind"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).drop("blocks")
        each = size.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        x = each.where("kind = 1").select("g", *[F.col(c).alias(f"x{c}") for c in ("band", "kind", "block")], F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"))
        y = x.join(each, ["g", "band"]).where("kind = 0 or band > xband or (band = xband and block >= xblock)")
        y = w(y.select("g", "xband", "xkind", "xblock", "band", "kind", "block").withColumn("gathering", F.monotonically_increasing_id()), "meetings")
        at = ["g", "band", "kind", "block"]
        probes = of.join(y.select("gathering", "g", *[F.col(f"x{c}").alias(c) for c in at[1:]]), at).withColumn("role", F.lit(PROBE))
        members = of.join(y.select("gathering", *at), at).withColumn("role", F.lit(MEMBER))
        cols = ["gathering", "role", "cls", "comp", "did", "th"]
        return self.verify(probes.select(cols).unionByName(members.select(cols)), y, size)

    def verify(self, gathered: DataFrame, *done: DataFrame) -> DataFrame:
        """(a, b), written: links of gatherings (gathering, role, cls, comp, did, th)."""
        w = self.scratch.write
        gathered = w(gathered, "gatherings")
        rows = gathered.join(texts_of(self.docs, gathered), ["did", "th"]).select("gathering", "role", "cls", "comp", "text")
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(tasks, "gathering").sortWithinPartitions("gathering")
        out = w(rows.mapInArrow(released(_join(self.order_, self.k, self.threshold, self.key)), "a long, b long"), "links")
        self.scratch.drop(gathered, *done)
        return out

    def short_pairs(self, short: DataFrame) -> DataFrame:
        """Pairs of short lists, the smaller set first.  A pair that also shares a long list is found there; for any other, c
        counts all that the prefixes share up to pa and pb."""
        x = short.select("token", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
        y = short.select("token", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
        near = x.join(y, "token").where((F.struct("na", "a") < F.struct("nb", "b")) & (100 * F.col("na") >= self.threshold * F.col("nb")))
        near = near.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
        best = F.col("c") + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1)
        return near.where(self._reaches(best)).select("a", "b")

    def _reaches(self, best) -> Column:
        return 100 * best >= self.threshold * (F.col("na") + F.col("nb") - best)

    def _similar_length(self) -> Column:
        return 100 * F.least("na", "nb") >= self.threshold * F.greatest("na", "nb")

    def labelled(self, long_: DataFrame, comp: DataFrame | None, turn: int) -> tuple[DataFrame, DataFrame]:
        """(rows of long lists with their component, written; by list: the leader of its largest component and the pairs still open)."""
        if comp is None:
            rows = long_.withColumn("comp", F.col("cls"))
        else:
            rows = long_.join(comp, long_.cls == comp.node, "left").select(*long_.columns, F.coalesce("component", "cls").alias("comp"))
        rows = self.scratch.write(rows, "labelled")
        lead = F.min(F.struct(F.xxhash64("cls", F.lit(turn)).alias("h"), "cls", "n")).alias("lead")
        by = rows.groupBy("token", "comp").agg(F.count("*").alias("m"), lead)
        lists = by.groupBy("token").agg(F.sum("m").alias("size"), F.sum(F.col("m") * F.col("m")).alias("square"), F.max(F.struct("m", F.col("lead.h").alias("h"), "comp", "lead")).alias("top"))
        lists = lists.where("size * size > square").select("token", "size", ((F.col("size") * F.col("size") - F.col("square")) / 2).alias("open"), F.col("top.comp").alias("top"), "top.lead")
        return rows, self.scratch.write(lists, "open")

    def led_pairs(self, rows: DataFrame, lists: DataFrame) -> DataFrame:
        """Each class outside the largest component of its list, with the leader of that."""
        p = rows.join(lists, "token").where("comp <> top").select(F.col("lead.cls").alias("a"), F.col("cls").alias("b"), F.col("lead.n").alias("na"), F.col("n").alias("nb"))
        return p.where(self._similar_length()).select("a", "b").distinct()

    def components(self, links: DataFrame, before: DataFrame | None = None) -> DataFrame:
        """(node, component) over links and the components before."""
        if before is not None:
            links = links.unionByName(before.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return self.scratch.write(components(links, self.scratch), "components")

    def connect(self) -> DataFrame:
        """(node, component) of the classes that have a link."""
        meets = self.meets()
        short, long_ = meets.where(f"c <= {SHORT}"), meets.where(f"c > {SHORT}").drop("c")
        pairs, some = self.short_pairs(short), bool(long_.limit(1).count())
        if some:
            rows, lists = self.labelled(long_, None, 0)
            pairs = pairs.unionByName(self.led_pairs(rows, lists)).distinct()
        comp = self.components(self.verify_pairs(pairs))
        turn, left = 0, None
        while some:
            turn += 1
            rows, lists = self.labelled(long_, comp, turn)
            size, open_ = lists.agg(F.sum("size"), F.sum("open")).first()
            if not open_:
                break
            many = open_ > OPEN * size and (left is None or open_ < 0.7 * left)
            links = self.verify_pairs(self.led_pairs(rows, lists)) if many else self.verify_groups(rows, lists)
            comp = self.components(links, comp)
            left, some = open_, many
            self.scratch.drop(rows, lists, links)
        self.scratch.drop(meets)
        return comp


# ---------------------------------------------------------------- operator


def _rows(docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """For each row: doc_id, did, th, n, and of its component (of n > 0) the first row: one.nul, one.did, one.th; members of its class."""
    j = _Join(docs, k, threshold)
    j.order()
    j.classes()
    comp = j.connect()
    c = j.all_classes.join(comp, j.all_classes.cls == comp.node, "left").withColumn("component", F.coalesce("component", "cls"))
    c = j.scratch.write(c.select("k1", "k2", "n", "members", "component", "nul", "did", "th"), "of-classes")
    first = j.scratch.write(c.groupBy("component").agg(F.min(F.struct("nul", "did", "th")).alias("one")), "first")
    named = j.scratch.write(c.join(first, "component").select("k1", "k2", "n", "members", "one"), "named")
    j.scratch.drop(c, first)
    return j.sets.join(named, ["k1", "k2", "n"], "left").select("doc_id", "did", "th", "n", "members", "one")


def jaccard_components(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    linked = F.when(~F.col("one.nul"), F.col("one.did"))
    return _rows(docs, k, threshold).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, linked).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (rows without one come last), of equal rows any.

    Rows with no words stay.  Only rows whose key is, by a bit map of fixed size, among those that go are exchanged.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    rows = scratch.write(_rows(docs, k, threshold).where("n > 0"), "rows")
    first = (F.col("did") == F.col("one.did")) & (F.col("th") == F.col("one.th"))
    did, th, gone = fresh(docs, "_did"), fresh(docs, "_th"), fresh(docs, "_gone")
    marks = rows.where(~first).select("did", "th", F.lit(True).alias(gone)).distinct()
    again = rows.where(first & (F.col("members") > 1)).groupBy("did", "th").count().where("count > 1").select("did", "th", F.lit(False).alias(gone))
    marks = scratch.write(marks.unionByName(again).toDF(did, th, gone), "marks")
    clear, maybe = divided(keyed(docs, did, th), [did, th], marks)
    maybe = maybe.join(marks, [did, th], "left")
    out = clear.select(docs.columns).unionByName(maybe.where(F.col(gone).isNull()).select(docs.columns))
    if marks.where(~F.col(gone)).limit(1).count():
        out = out.unionByName(maybe.where(~F.col(gone)).dropDuplicates([did, th]).select(docs.columns))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = rf"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < {SHINGLE} then [md5(array_to_string(w, ' '))]
    else list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: md5(array_to_string(w[i:i + {SHINGLE - 1}], ' ')))) end as s
  from w
), t as (select doc_id, len(s) as n, unnest(s) as t from s),
o as (
  select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as i from t a join t b on a.t = b.t and a.doc_id <> b.doc_id
  where 100 * least(a.n, b.n) >= {THRESHOLD} * greatest(a.n, b.n) group by all
), l as (select a, b from o where 100 * i >= {THRESHOLD} * (na + nb - i)),
r(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from r join l on r.b = l.a)
select s.doc_id, len(s.s) as n_shingles, c.c as component_id from s join (select a, min(b) as c from r group by a) c on c.a = s.doc_id
"""
