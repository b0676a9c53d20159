"""Language ID, vectors, substring dedup, packing and the Jaccard join, against brute force."""

import glob
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from murmur import session as S
from murmur.llm import op2_language as O2
from murmur.llm import op3_near_vectors as O3
from murmur.llm import op4_substrings as O4
from murmur.llm import op5_packing as O5
from murmur.llm import op6_jaccard as O6
from murmur.llm import op9_topk as O9
from murmur.llm import words as W
from murmur.llm.common import Scratch, components, shared_dir
from murmur.operators.stages import written

NASTY = [None, "", " \n\t ", "a", "a b", "a b c", "\u00e9\u00e8 x\u00a0y \u2003z", "w\x0bx\x0cy\rz", "long " * 3000, "X" * 20000, "A b C d e F g", "a b c d e f g"]


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def group(ids, links):
    parent = {i: i for i in ids}
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    return {i: find(parent, i) for i in ids}


def test_words():
    texts = [*NASTY, "\x1c\x1d not gaps"]
    for cap in (1, 40, 1 << 20):
        W.CHUNK_BYTES, old = cap, W.CHUNK_BYTES
        try:
            seen, hashes = [], defaultdict(set)
            for ids, data, off in W.chunks(pa.array(range(len(texts))), pa.array(texts)):
                s, e, wo = W.split(data, off)
                h = W.word_hashes(data, s, e, b"key")
                for k, i in enumerate(ids):
                    ws = [data[a:b].tobytes() for a, b in zip(s[wo[k] : wo[k + 1]], e[wo[k] : wo[k + 1]])]
                    assert ws == (texts[i] or "").encode().split()
                    for w, x in zip(ws, h[wo[k] : wo[k + 1]].tolist()):
                        hashes[w].add(x)
                    seen.append(i)
            assert seen == [*range(len(texts))]
            assert all(len(v) == 1 for v in hashes.values()) and len({x for v in hashes.values() for x in v}) == len(hashes)
        finally:
            W.CHUNK_BYTES = old


def test_components(spark):
    r = random.Random(4)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2001 + i) for i in range(60)] + [(5, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {x["node"]: x["component"] for x in components(df, Scratch(spark, "t")).collect()}
    ids = {x for p in links if p[0] != p[1] for x in p}
    assert got == group(ids, [p for p in links if p[0] != p[1]])


@pytest.mark.parametrize("bits", [7, 23])
def test_thinned_keeps_every_key(spark, monkeypatch, bits):
    from murmur.llm import common

    monkeypatch.setattr(common, "MAP_BITS", bits)
    rows = spark.range(3000).withColumnRenamed("id", "k").withColumn("_word_count", F.lit(1))
    keys = spark.range(0, 3000, 50).withColumnRenamed("id", "k")
    out = common.thinned(rows, "k", keys)
    assert out.columns == rows.columns and out.join(keys, "k").count() == 60
    assert out.count() == 60 or bits == 7
    assert common.thinned(rows, "k", keys.limit(0)).count() == 0


# ---------------------------------------------------------------- language


def phrases(text, sample):
    n = at = 0
    while at < len(text):
        size = 0
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at += max(1, size)
        n += 1
    return n


@pytest.mark.parametrize("stretch", [1024, 16, 5])
def test_cross_parsing_equals_a_plain_parse(monkeypatch, stretch):
    """Whole texts, however they are cut into stretches."""
    monkeypatch.setattr(O2, "STRETCH", stretch)
    r = random.Random(stretch)
    samples = [("a", "the cat sat on the mat aaaaaaa"), ("b", "le chat est la"), ("c", "xyz xyz"), ("d", "".join(chr(0x4E00 + r.randrange(900)) for _ in range(900)))]
    m = O2.Model(samples)
    texts = ["".join(r.choice("the catsomlx \u00e9z\u4e05") for _ in range(r.choice([0, 1, 30, 2500]))) for _ in range(40)]
    texts += ["".join(r.choice(["the cat ", "sat on", "chat est", "a" * r.randint(1, 60), "xyz x"]) for _ in range(300)), "a" * 3000, "q" * 2000, "the mat" * 500]
    cp = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    got = m.phrases(cp, np.cumsum([0] + [len(t) for t in texts]))
    for t, p in zip(texts, got.tolist()):
        assert p == [phrases(t, s) for _, s in samples]
    assert len(m.automata[3][0]) < 4 * 900 + 2 * m.width


def test_language_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = O2.query(spark, sf_dir).join(docs, "doc_id").where("held_out").toPandas()
    assert len(out) == docs.where(O2.held_out()).count() and (out["lang_pred"] == out["lang"]).mean() > 0.95
    assert out["score"].between(0, 1).all()


def test_language_of_odd_rows(spark):
    rows = [(i, "the and of to in is that", "en", "e") for i in range(8)] + [(10 + i, "le la les des et une que", "fr", "e") for i in range(8)]
    rows += [(30, None, "en", "e"), (31, "", "fr", "e"), (32, "123 456 !!", None, "e"), (None, "the is that of", None, "e"), (33, "les des que " * 4000, None, "e"), (33, "les des que " * 4000, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = O2.identify(docs)
    assert out.columns == [*docs.columns, "_lang_pred", "_score"]
    got = Counter((r["doc_id"], r["_lang_pred"]) for r in out.where("doc_id is null or doc_id >= 30").collect())
    assert got == Counter({(30, "und"): 1, (31, "und"): 1, (32, "und"): 1, (None, "en"): 1, (33, "fr"): 2})
    assert {r["_lang_pred"] for r in O2.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert O2.identify(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- vectors


def vectors(n=120, dim=8, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)).astype(np.float32)
    x[20:60] = x[:1] + 0.15 * r.normal(size=(40, dim))
    x[60:70] = x[5]
    rows = [(i, [float(v) for v in y], "e") for i, y in enumerate(x)]
    rows += [(900, None, "e"), (901, [0.0] * dim, "e"), (902, [float("nan")] * dim, "e"), (903, [None] + [1.0] * (dim - 1), "e"), (904, [float("inf")] * dim, "e"), (905, [1.0], "e"), (906, [], "e")]
    return rows


def good(v):
    return v is not None and all(y is not None and math.isfinite(y) for y in v)


@pytest.mark.parametrize("block, few", [(8192, 8), (16, 8), (16, 64)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block, few):
    monkeypatch.setattr(O3, "FEW", few)
    monkeypatch.setattr(O3, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, size string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in O3.near_duplicates(df).collect()}
    x = {i: np.pad(np.asarray(v, float), (0, 8 - len(v))) for i, v, _ in rows if good(v) and any(v)}
    links = [(a, b) for a in x for b in x if a < b and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.95]
    n = Counter(i for p in links for i in p)
    c = group([i for i, *_ in rows], links)
    assert got == {i: (n[i], c[i], c[i] == i) for i, *_ in rows}


def test_cells_of_clustered_vectors_prune():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(200, 48))
    x = O3._unit((centres[:, None] + 0.05 * rng.normal(size=(200, 20, 48))).reshape(-1, 48))
    pivots = O3.choose_pivots(x[rng.permutation(len(x))[:1000]], 1_000_000, 0.95)
    cells = O3.Cells(pivots, 0.95)
    near, home, _ = cells.of(x)
    least = np.ones(len(pivots))
    np.minimum.at(least, home, near[np.arange(len(x)), home])
    held = O3.Cells(pivots, 0.95, least).of(x)[2]
    assert len(pivots) >= 64 and held.sum(1).mean() < 0.2 * len(pivots)
    for lo in range(0, len(x), 500):  # the home cell of either end holds the other end of every link
        a, b = np.nonzero(x[lo : lo + 500] @ x.T >= 0.95)
        assert held[b, home[lo + a]].all()


def test_vectors_of_one_id_link(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.01]), (7, [0.0, 1.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in O3.near_duplicates(df).collect())
    assert got == [(0, 0, 0), (5, 1, 5), (5, 1, 5), (7, 0, 7)]


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert O3.near_duplicates(df).count() == 0 and O9.search(df, df).count() == 0
    null = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in O3.near_duplicates(null).collect()] == [(1, 0, 1, True)] and O9.search(null, null).count() == 0


@pytest.mark.parametrize("block, k", [(16384, 20), (13, 3), (13, 500)])
def test_topk_equals_brute_force(spark, monkeypatch, block, k):
    monkeypatch.setattr(O9, "CANDIDATES", block)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = sorted(tuple(r) for r in O9.search(df, df.where("vec_id % 10 = 0"), k).collect())
    x = {i: np.floor(64 * np.pad(np.asarray(v, float), (0, 8 - len(v)))).astype(int) for i, v, _ in rows if good(v)}
    want = []
    for q in x:
        if q % 10 == 0:
            best = sorted((-int(x[q] @ x[c]), c) for c in x if c != q)[:k]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert got == sorted(want)


@pytest.mark.parametrize("scale", [1, 12, 64, 5000, 10**8])
def test_segments_and_their_search(scale):
    """Segments hold every number once, in descending impact; what is found is exact, also where the search stops early."""
    r = np.random.default_rng(scale)
    x = np.floor(r.normal(size=(500, 9)) * scale).astype(np.int64)
    x[::50] *= 3
    step, heads, places = O9.segments(x)
    assert (np.diff(heads[:, 0]) <= 0).all() and heads[:, 0].max() <= O9.STEPS
    begin = 0
    for impact, dim, sign, end in heads.tolist():
        v = x[places[begin:end], dim]
        assert (np.abs(v) // step == impact).all() and (np.sign(v) == sign).all()
        begin = end
    assert begin == (np.abs(x) >= step).sum()
    ids, q = np.arange(500), x[::40]
    for n, c, s in O9.search_block(x, ids, (step, heads, places), q, ids[::40], 7):
        want = sorted((-int(x[n] @ x[j]), j) for j in range(500) if j != n)[:7]
        assert [(-a, b) for a, b in zip(s.tolist(), c.tolist())] == want


def test_scores_beyond_64_bits_raise(spark):
    big = spark.createDataFrame([(0, [3e9, 3e9]), (1, [3e9, 3e9])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        O9.search(big, big).collect()
    fine = spark.createDataFrame([(0, [3e7]), (1, [2e7])], "vec_id long, embedding array<double>")
    assert {r["score"] for r in O9.search(fine, fine).collect()} == {64 * 64 * 6 * 10**14}


# ---------------------------------------------------------------- substrings


def plain_dedup(texts, k):
    words = [(t or "").encode().split() for t in texts]
    n = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - k + 1):
            if n[tuple(w[i : i + k])] > 1:
                gone |= set(range(i, i + k))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_substrings_equal_brute_force(spark, seed):
    r = random.Random(seed)
    vocab = "abcdef" if seed % 2 else [f"w{i}" for i in range(400)]
    passages = [[r.choice(vocab) for _ in range(r.randint(5, 40))] for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [r.choice(passages) if r.random() < 0.4 else [r.choice(vocab) for _ in range(r.randint(0, 25))] for _ in range(r.randint(0, 6))]
        texts.append(r.choice([" ", "\n"]).join(w for p in parts for w in p))
    texts += NASTY + ["x y " * 50, "z " * 100]
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in O4.dedup(docs, 12, 4).collect()}
    assert [got[i] for i in range(len(texts))] == plain_dedup(texts, 12)


def test_substrings_of_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, t), (1, t), (None, t + " x"), (2, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in O4.dedup(docs).collect()), key=repr)
    assert got == sorted([(1, 50, 50), (1, 50, 50), (None, 51, 50), (2, 0, 0)], key=repr)
    assert O4.dedup(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- packing


def test_tokens_equal_the_tokenizer_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(1)
    parts = ["'s", "'", " ", "  ", "\n", "a", "bc", "'ll", "'re", "'r", "'v", "'ve", "'d", "\u00e9", "12", "\u0663", "!!", "...", "\t", " \n", "\u6f22\u5b57", "\U0001F600", "\x1f", "\r\n", " '", "I'm", "'t", "<|endoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(1500)] + [x or "" for x in NASTY]
    plain = [x for x in texts if O5.MARKER not in x]
    for batch in (plain, texts):
        for i in range(0, len(batch), 300):
            part = batch[i : i + 300]
            for ids, data, off in W.chunks(pa.array(range(len(part))), pa.array(part)):
                for k, x in zip(ids, O5.encoder().batch(data, off)):
                    assert t.encode(part[k], add_special_tokens=False).ids == x.tolist()


def bins_needed(sizes, capacity):
    """Least number of sequences, by search."""
    sizes, best = sorted(sizes, reverse=True), len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= sizes[i]}.values():
            go(i + 1, rooms[:j] + [rooms[j] - sizes[i]] + rooms[j + 1 :])
        go(i + 1, rooms + [capacity - sizes[i]])

    go(0, [])
    return best


def test_reduction_keeps_the_optimum():
    r = random.Random(7)
    for _ in range(300):
        sizes = [r.randint(1, 20) for _ in range(r.randint(1, 9))]
        fixed, left = O5.reduce_dominated(Counter(sizes), 20)
        assert Counter(n for p, c in fixed for n in p * c) + Counter(left) == Counter(sizes)
        assert sum(c for _, c in fixed) + bins_needed([*Counter(left).elements()], 20) == bins_needed(sizes, 20)


def test_patterns_hold_every_piece():
    r = random.Random(3)
    for _ in range(40):
        counts = Counter(min(2048, int(r.lognormvariate(5.5, 1.2)) + 1) for _ in range(r.choice([1, 30, 3000])))
        patterns = O5.solve(dict(counts))
        assert all(sum(p) <= 2048 for p, _ in patterns)
        assert Counter({n: 0 for n in counts}) + Counter(n for p, c in patterns for n in p * c) == counts
        assert sum(c for _, c in patterns) <= 1.05 * sum(n * c for n, c in counts.items()) / 2048 + 1


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_round_trip(spark, capacity):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i if i != 4 else None, x, "e") for i, x in enumerate(NASTY)] + [(3, NASTY[3], "e")]
    out = O5.pack(spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(3), capacity).toPandas()
    want = Counter()
    for d, x, _ in rows:
        ids = np.asarray(t.encode(x or "", add_special_tokens=False).ids + [0], dtype="<u4")
        cut = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cut, cut[1:])):
            want[(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    got = Counter((None if d != d else int(d), *r) for d, *r in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    assert got == want
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= capacity


def test_nothing_to_pack(spark):
    assert O5.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---------------------------------------------------------------- Jaccard


def test_tree_connects_what_is_linked():
    r = np.random.default_rng(0)
    for _ in range(80):
        base = np.unique(r.integers(0, 200, r.integers(1, 60)).astype(np.uint64))
        sets = [np.unique(np.concatenate([base[r.random(len(base)) > r.choice([0, 0.03, 0.2])], r.integers(0, 200, r.integers(0, 4)).astype(np.uint64)])) for _ in range(24)]
        sets = [s for s in sets if len(s)]
        for limit in (50, 85, 100):
            cut = len(sets) // 3
            for probes, members in (([*range(len(sets))], [*range(len(sets))]), ([*range(cut)], [*range(cut, len(sets))])):
                if not probes or not members:
                    continue
                want = []
                for i in probes:
                    for j in members:
                        o = len(np.intersect1d(sets[i], sets[j]))
                        if i != j and 100 * o >= limit * (len(sets[i]) + len(sets[j]) - o):
                            want.append((i, j))
                got = O6.PrefixTree([sets[j] for j in members]).join([sets[i] for i in probes], np.asarray(probes), np.asarray(members), limit)
                got = [(probes[x], members[y]) for x, y in got]
                assert set(got) <= set(want) and len(got) < len(sets)
                assert group(range(len(sets)), got) == group(range(len(sets)), want)


def shingles(text, k=4):
    ws = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


def check_jaccard(spark, texts, ids=None):
    ids = ids or [*range(len(texts))]
    docs = spark.createDataFrame([(i, t, "e", 1) for i, t in zip(ids, texts)], "doc_id long, text string, n string, th long")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in O6.jaccard_components(docs).collect())
    sets = [shingles(t) for t in texts]
    known = [i for i, s in enumerate(sets) if s]
    links = [(a, b) for a in known for b in known if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    c = group(range(len(sets)), links)
    least = {}
    for row, i in enumerate(ids):
        least[c[row]] = min((x for x in (least.get(c[row]), i) if x is not None), default=None)
    assert got == Counter((i, len(s), least[c[row]]) for row, (i, s) in enumerate(zip(ids, sets)))


def near_copies(r, vocab, groups, size, common):
    for _ in range(groups):
        base = [r.choice(vocab) for _ in range(r.randint(3, 70))] + common * r.randint(0, 1)
        for _ in range(r.randint(1, size)):
            copy = [*base]
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            yield r.choice([" ", "\n"]).join(copy)


@pytest.mark.parametrize(("short", "open_"), [(16, 4), (2, 0), (2, 1000)])
def test_jaccard_equals_brute_force(spark, monkeypatch, short, open_):
    """short 2 sends nearly all lists through leaders; open_ decides whether leaders are tried again or blocks compared."""
    monkeypatch.setattr(O6, "SHORT", short)
    monkeypatch.setattr(O6, "OPEN", open_)
    monkeypatch.setattr(O6, "FREQUENT", 4)
    monkeypatch.setattr(O6, "PART", 7)
    r = random.Random(short + open_)
    vocab = [f"w{i}" for i in range(300)]
    texts = [*near_copies(r, vocab, 14, 9, [r.choice(vocab) for _ in range(12)])]
    check_jaccard(spark, texts + NASTY)


def test_jaccard_of_one_large_group(spark, monkeypatch):
    """Copies that differ from each other by more than the limit are connected through others only."""
    monkeypatch.setattr(O6, "SHORT", 3)
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(90):
        copy = [*base]
        for j in range(0, i // 8):
            copy[(5 * j + i) % 60] = f"x{i}-{j}"
        texts.append(" ".join(copy))
    r.shuffle(texts)
    check_jaccard(spark, texts)


def test_jaccard_of_repeated_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(40))
    u = " ".join(f"u{i}" for i in range(40))
    check_jaccard(spark, [t, t, t + " x", "other words are here now", None], [5, 5, 2, None, 9])
    check_jaccard(spark, [t, u, u + " x", t, t, u, ""], [1, 1, None, 7, None, 3, None])
    check_jaccard(spark, [t, t, u], [None, None, None])
    assert O6.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one(spark):
    t, u = (" ".join(f"{c}{i}" for i in range(40)) for c in "tu")
    rows = [(1, t, 0), (1, u, 1), (2, t + " x", 2), (3, t, 3), (3, t, 3), (None, u, 4), (None, "alone it is here", 5), (None, "alone it is here", 5), (8, None, 6), (8, None, 6), (9, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _did long")
    got = Counter(tuple(r) for r in O6.keep_one(docs).collect())
    assert got == Counter([(1, t, 0), (1, u, 1), (None, "alone it is here", 5), (8, None, 6), (8, None, 6), (9, "", 7)])
    assert O6.keep_one(docs.limit(0)).count() == 0 and O6.keep_one(docs).columns == docs.columns
    # Copies of one row, some of them without an id.
    same = spark.createDataFrame([(4, t)] * 5 + [(None, t)] * 2, "doc_id long, text string")
    assert [tuple(r) for r in O6.keep_one(same).collect()] == [(4, t)]


def thue_morse(bits, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(1 << bits))


@pytest.mark.parametrize("bits", [10, 11, 12])
def test_no_text_cancels_a_hash(spark, bits):
    x, y = thue_morse(bits, "a", "b"), thue_morse(bits, "b", "a")
    plain = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{x} {plain}"), (2, f"{y} {plain}")], "doc_id long, text string")
    assert {r["n_removed"] for r in O4.dedup(docs).collect()} == {0}
    small = spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")
    assert {r["component_id"] for r in O6.jaccard_components(small).collect()} == {1, 2}
    e = O5.PretokenEncoder()
    data = np.frombuffer((x + y).encode(), dtype=np.uint8)
    one, two = e.batch(data, np.asarray([0, len(x), len(x) + len(y)]))
    assert one.tolist() == e.encoding.encode(x) and two.tolist() == e.encoding.encode(y)


def colliding_words(hashes):
    """Two words of 16 letters of one hash, where it can be searched: the second half follows from the first, or chance finds it on 32 bits."""
    r, seen = random.Random(4), {}
    while True:
        words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=16)) for _ in range(100_000)]
        data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
        at = np.arange(len(words)) * 16
        for w, h in zip(words, (hashes(data, at, at + 16) >> np.uint64(32)).tolist()):
            if h in seen:
                return seen[h], w
            seen[h] = w


def test_words_that_collide_are_told_apart(spark, monkeypatch):
    """A pair is searched for a hash that is too short; what words decide for good does not depend on it."""
    real = W.word_hashes
    key = b"known to all"
    x, y = colliding_words(lambda d, a, b: real(d, a, b, key))
    short = lambda d, a, b, _: real(d, a, b, key) & ~np.uint64(0xFFFFFFFF)
    one, two = (np.frombuffer(w.encode(), dtype=np.uint8) for w in (x, y))
    ends = np.asarray([16])
    assert x != y and short(one, ends - 16, ends, b"") == short(two, ends - 16, ends, b"")
    fresh = [tuple(real(w, ends - 16, ends, W.fresh_key()).tolist()) for w in (one, one)]
    assert fresh[0] != fresh[1], "the key of a run is its own"
    # Pretokens and windows under the broken hash, in this process.
    monkeypatch.setattr(O5, "word_hashes", short)
    e, text = O5.PretokenEncoder(), f"{x} {y} {x}"
    assert e.batch(np.frombuffer(text.encode(), dtype=np.uint8), np.asarray([0, len(text)]))[0].tolist() == e.encoding.encode(text)
    monkeypatch.setattr(O4, "word_hashes", short)
    plain = [f"w{i}" for i in range(34)]
    texts = [" ".join([x, *plain]), " ".join([y, *plain]), "  ".join([x, *plain])]
    batch = pa.RecordBatch.from_pydict({"did": [1, 2, 3], "th": [1, 2, 3], "text": texts})
    found = [r for b in O4._paths(35, 8, key)(iter([batch])) for r in b.to_pylist()]
    assert len(found) == 3 and found[0]["sequence"] == found[2]["sequence"] != found[1]["sequence"] and len({r["anchor"] for r in found}) <= 2
    # Under keys of their own, whole operators tell them apart too.
    docs = spark.createDataFrame(list(enumerate(texts[:2])) + [(7, f"{x} one"), (8, f"{y} one")], "doc_id long, text string")
    assert {r["n_removed"] for r in O4.dedup(docs).collect()} == {0}
    assert {r["doc_id"]: r["component_id"] for r in O6.jaccard_components(docs.where("doc_id > 2")).collect()} == {7: 7, 8: 8}


def test_equal_bytes():
    words = ["a", "b", "a", "abcdefgh", "abcdefgh", "abcdefgi", "x" * 100, "x" * 100, "x" * 99 + "y", "", "", "abcdefghi", "abcdefghj"]
    data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    i, j = (x.ravel() for x in np.meshgrid(range(len(words)), range(len(words))))
    assert W.same_bytes(data, start[i], end[i], start[j], end[j]).tolist() == [words[a] == words[b] for a, b in zip(i, j)]
    text, begin = W.joined(*[np.frombuffer(b" ab  c\td ", dtype=np.uint8)], np.asarray([1, 5, 7]), np.asarray([3, 6, 8]))
    assert text == b"ab c d " and begin.tolist() == [0, 3, 5, 7]


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120)
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "12 34", "en", "src0", 5), (10**6 + 2, "the password=abcdefgh of the", "en", "src0", 28)], docs.schema)
    cur, seen = docs.union(extra), {}
    for name, stage in P.STAGES:
        cur = Scratch(spark, "test").write(stage(spark, cur, sf_dir), name)
        seen[name] = cur
    ids = lambda n: {r["doc_id"] for r in seen[n].select("doc_id").collect()}
    assert [c for n, _ in P.STAGES[:-1] for c in seen[n].columns] == docs.columns * 4
    assert not ids("language_id") & {10**6, 10**6 + 1} and 10**6 + 2 in ids("ngram_jaccard")
    sets = {r["doc_id"]: shingles(r["text"], P.SHINGLE) for r in seen["language_id"].collect()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= P.THRESHOLD * len(sets[a] | sets[b])]
    assert ids("ngram_jaccard") == set(group(sets, links).values())
    assert ids("secret_scan") == ids("ngram_jaccard")
    assert "the [SECRET] of the" in {r["text"] for r in seen["secret_scan"].collect()}
    n = Counter(r["doc_id"] for r in seen["mix_sources"].collect())
    packed = Counter(r["doc_id"] for r in seen["best_fit_packing"].where("piece = 0").collect())
    assert n == packed


def test_pipeline_mixes_in_the_order_of_the_hash(spark, sf_dir):
    """The copies are ordered over the whole corpus, in what the stage gives and in the table that is written from it."""
    import corpus_pipeline as P

    docs = spark.range(400).repartition(5).selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang", "if(id % 10 = 0, 'few', 'many') as source", "8L as n_chars")
    mixed = P.mix_sources(spark, docs, sf_dir)
    got = [r["doc_id"] for r in mixed.collect()]
    counts = Counter(got)
    assert max(counts.values()) > 1
    want = sorted((hashlib.md5(f"17:{i}:{c}".encode()).hexdigest(), i) for i, n in counts.items() for c in range(1, n + 1))
    assert got == [i for _, i in want]
    written = Scratch(spark, "test").write(mixed, "mixed").withColumn("file", F.input_file_name()).collect()
    assert [r["doc_id"] for r in sorted(written, key=lambda r: r["file"])] == got


def test_pipeline_near_duplicates(spark, sf_dir):
    """Five words and 80 %: copies of 400 words with 72 to 96 more go, with 104 more they stay."""
    import corpus_pipeline as P

    docs, kept = [], set()
    for i, more in enumerate((72, 84, 96, 104)):
        t = " ".join(f"w{i}x{j}" for j in range(400))
        docs += [(2 * i, t, "en", "src0", len(t)), (2 * i + 1, t + "".join(f" v{i}x{j}" for j in range(more)), "en", "src0", len(t))]
        kept |= {2 * i} | ({2 * i + 1} if more > 99 else set())
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in P.near_duplicates(spark, docs, sf_dir).collect()} == kept


def test_pipeline_of_odd_tables(spark, sf_dir):
    """Repeated rows, one id with two texts, columns of clashing names, a long text, and no rows at all."""
    import corpus_pipeline as P

    long_ = " ".join(f"the{i} word" for i in range(30_000))
    rows = [(1, "the cat and the dog", None, None, 19, 0.5, "a"), (1, "the cat and the dog", None, None, 19, 0.5, "a"), (1, "another story of the house", "en", "s", 26, 0.1, "b")]
    rows += [(None, "a text of its own", "en", "s", 17, None, None), (3, long_, "en", "s", len(long_), 0.0, "c"), (4, "", "en", "s", 0, 0.0, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _score double, rate string")
    one = P.language_id(spark, docs, sf_dir)
    assert one.columns == docs.columns and one.count() == 5 and {r["lang"] for r in one.collect()} == {"en"}
    two = P.near_duplicates(spark, one, sf_dir)
    assert two.columns == docs.columns and two.count() == 4
    three = P.mix_sources(spark, P.secret_scan(spark, two, sf_dir), sf_dir)
    assert three.columns == docs.columns
    assert P.pack(spark, two, sf_dir).agg(F.max("sequence_id")).first()[0] > 1
    none = docs.limit(0)
    for name, stage in P.STAGES:
        none = stage(spark, none, sf_dir)
        assert none.count() == 0


def test_topk_sends_no_block_through_the_driver(spark):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    found = O9.search(v, v.where("vec_id % 20 = 0"))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 200
    for blocks, qblocks in ((1, 1), (3, 5), (7, 2), (40, 30)):
        index = spark.range(blocks).selectExpr("int(id) as block", "id as ids", "id as vecs", "id as step", "id as heads", "id as places")
        asked = spark.range(qblocks).selectExpr("int(id) as qblock", "id as qids", "id as qvecs")
        met = O9.meetings(index, asked, blocks, qblocks).select("ids", "qids").collect()
        assert sorted(map(tuple, met)) == [(x, y) for x in range(blocks) for y in range(qblocks)]


# ---------------------------------------------------------------- disk


def shuffled(spark):
    """Bytes of the shuffle files that there are."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",").split(",")
    return sum(os.path.getsize(f) for f in files if "shuffle_" in f and os.path.exists(f))


def test_shuffle_files_go_with_the_table_that_they_made(spark):
    before, own = shuffled(spark), spark.conf.get(S.CLEANUP, None)
    spread = spark.range(20_000).repartition(4, "id")
    for write in (Scratch(spark, "t").write, written):
        assert write(spread.groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    assert shuffled(spark) < before + 50_000
    assert spark.conf.get(S.CLEANUP, None) == own
    with S.one_off(spark), S.one_off(spark):
        assert spark.conf.get(S.CLEANUP) == "true"
    assert spark.conf.get(S.CLEANUP, None) == own


def test_the_order_of_shingles_leaves_no_shuffle(spark):
    texts = [(i, " ".join(f"w{random.Random(i).randrange(10**6)}x{j}" for j in range(60))) for i in range(4000)]
    join = O6._Join(Scratch(spark, "t").write(spark.createDataFrame(texts, "doc_id long, text string")), 4, 85)
    before = shuffled(spark)
    join.order()
    assert shuffled(spark) < before + 50_000


def test_pipeline_drops_the_table_of_a_stage_once_the_next_is_written(spark, sf_dir):
    import corpus_pipeline as P

    tables = lambda: set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/corpus-*/*"))
    before = tables()
    out = P.run(spark, sf_dir)
    assert [t.rsplit("-", 1)[1] for t in tables() - before] == ["mix_sources"]
    assert out.count()
