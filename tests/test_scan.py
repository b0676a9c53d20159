"""Two-level scans, quantiles and split points on hot keys, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from murmur.operators import intervals, quantiles, runs, scan, segments, splits

from .conftest import rows
from .test_sequences import music_loop, split_loop


@pytest.fixture(params=[7, 1_000_000])
def small_ranges(request, monkeypatch):
    monkeypatch.setattr(scan, "RANGE_ROWS", request.param)
    return request.param


def _timeline(seed):
    """(key, at, v): one hot key, few of the others, clustered places, null keys and null places."""
    r = random.Random(seed)
    data = [(1, int(r.paretovariate(0.4)) if r.random() < 0.5 else r.randint(0, 200), r.choice([None, r.randint(-5, 5)])) for _ in range(300)]
    data += [(k, i * 3, r.randint(0, 3)) for k in (2, 3) for i in range(5)] + [(None, i, i) for i in range(20)] + [(1, None, 4)] * 3 + [(4, 9, 9)]
    return [(k, min(a, 10**15) if a is not None else None, i, v) for i, (k, a, v) in enumerate(data)]


def test_scans_equal_loops(spark, small_ranges):
    data = _timeline(2)
    df = spark.createDataFrame(data, "k long, at long, id long, v long")
    got = scan.Ranges(df, "k", "at").scan(df, ["at", "id"], s=scan.Sum(F.col("v")), n=scan.Sum(F.lit(1)), last=scan.Last(F.col("v")), now=scan.Last(F.col("v"), True), next=scan.Next(F.col("v")), here=scan.Next(F.col("v"), True))
    assert got.columns == ["k", "at", "id", "v", "s", "n", "last", "now", "next", "here"]
    want = []
    for k in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == k), key=lambda d: (d[1] is not None, d[1] or 0, d[2]))
        vs = [d[3] for d in own]
        first = lambda xs: next((x for x in xs if x is not None), None)
        want += [(*d, sum(x or 0 for x in vs[: i + 1]), i + 1, first(vs[:i][::-1]), first(vs[: i + 1][::-1]), first(vs[i + 1 :]), first(vs[i:])) for i, d in enumerate(own)]
    assert rows(got) == sorted(want, key=repr)


def test_ranges_of_other_rows(spark, monkeypatch):
    """Ranges may be counted on rows that differ from those that are scanned."""
    monkeypatch.setattr(scan, "RANGE_ROWS", 5)
    counted = spark.createDataFrame([(1, i) for i in range(0, 400, 9)], "k long, at long")
    df = spark.createDataFrame([(1, i) for i in range(-50, 900, 7)] + [(2, i) for i in range(20)], "k long, at long")
    got = scan.row_numbers(df, "k", ["at"], "n", scan.Ranges(counted, "k", "at"))
    assert rows(got) == sorted([(1, i, n + 1) for n, i in enumerate(range(-50, 900, 7))] + [(2, i, i + 1) for i in range(20)], key=repr)


def test_a_hot_key_spreads_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(scan, "RANGE_ROWS", 100)
    df = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("at"))
    got = scan.Ranges(df, "k", "at").attach(df).groupBy("_range").count()
    assert got.count() >= 35 and got.agg(F.max("count")).first()[0] <= 110


def test_runs_and_joins_on_hot_keys(spark, small_ranges):
    r = random.Random(small_ranges)
    # gaps
    s, t = [], 0
    for i in range(200):
        t += r.choice([0, 1, 5])
        s.append((1, i, t, t + 1))
    para, want = 0, []
    for i, (k, x, a, b) in enumerate(s):
        para += int(i > 0 and a - s[i - 1][3] >= 3)
        want.append((k, x, a, b, para))
    assert rows(segments.gap_segments(spark.createDataFrame(s, "doc_id long, seg_idx long, start long, end long"), 3)) == sorted(want, key=repr)
    # music
    paras, t = [], 0
    for _ in range(300):
        t += r.choice([0, 5, 10, 40])
        paras.append((t if r.random() < 0.9 else -1, "x" * (10 if r.random() < 0.8 else 90)))
    data = [(1, i, (f"[{t // 60}:{t % 60:02d}] " if t >= 0 else "") + c) for i, (t, c) in enumerate(paras)]
    df = spark.createDataFrame(data, "doc_id long, para_idx long, text string")
    music = music_loop(paras)
    assert sorted(tuple(x) for x in runs.music_runs(df).select("lo", "hi").collect()) == music
    assert {x["para_idx"] for x in runs.drop_music(df).collect()} == {i for i in range(300) if not any(lo <= i <= hi for lo, hi in music)}
    # silences
    energy = [r.choice([0.0, 0.0, 0.0, 1.0]) for _ in range(400)]
    f = spark.createDataFrame([(1, i, x) for i, x in enumerate(energy)], "doc_id long, frame_idx long, rms double")
    want, i = [], 0
    while i < 400:
        j = i
        while j < 400 and energy[j] < 0.15:
            j += 1
        if j - i >= 3:
            want.append((1, i, j))
        i = max(j, i + 1)
    assert sorted(tuple(x) for x in runs.silence_runs(f, runs.energy_threshold(f), 3).select("doc_id", "first", "stop").collect()) == want
    # nearest
    p, m = [(1, r.randint(0, 500)) for _ in range(150)], [(1, r.randint(0, 500), i) for i in range(60)]
    got = intervals.nearest_join(spark.createDataFrame([(k, i, a) for i, (k, a) in enumerate(p)], "k long, id long, at long"), spark.createDataFrame(m, "k long, mark long, o long"), "k", "at", "mark", "o")
    best = lambda a: min((abs(x - a), o, x) for _, x, o in m)
    assert rows(got.select("id", F.col("_mark").cast("long"), "_order")) == sorted(((i, best(a)[2], best(a)[1]) for i, (_, a) in enumerate(p)), key=repr)


@pytest.mark.parametrize("few", [2, 4096])
@pytest.mark.parametrize("q", [0.0, 0.25, 0.75, 1.0])
def test_quantiles_are_exact(spark, monkeypatch, few, q):
    monkeypatch.setattr(quantiles, "FEW", few)
    r = random.Random(few)
    values = {1: [r.lognormvariate(0, 40) * r.choice([1, -1]) for _ in range(500)], 2: [7.5] * 50, 3: [1.0, 2.0], 4: [0.0, -0.0, 5e-324, 1e308, -1e308] * 3, 5: [1.0] * 30 + [1.0 + 2**-52] * 10 + [3.0], None: [4.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [(1, None), (6, None), (1, float("nan"))], "k long, v double")
    got = {x["k"]: x["quantile"] for x in quantiles.exact_quantile(df, "k", "v", q).collect()}

    def plain(vs):
        vs = sorted(vs)
        at = (len(vs) - 1) * q
        i = int(at)
        return vs[i] if at == i else (1 - (at - i)) * vs[i] + (at - i) * vs[i + 1]

    assert got == {k: plain(vs) for k, vs in values.items()}
    assert "percentile" not in runs.energy_threshold(spark.createDataFrame([(1, 1.0)], "doc_id long, rms double"))._jdf.queryExecution().toString()


@pytest.mark.parametrize("target, search", [(100, 30), (20, 35), (7, 0), (1, 3)])
def test_split_points_of_long_documents(spark, target, search):
    r = random.Random(target)
    docs = {d: (n, sorted(r.sample(range(n), n // r.choice([5, 30, 200])))) for d, n in enumerate([1, 2, 400, 2500, 3000, 5000])}
    n = spark.createDataFrame([(d, x, "y") for d, (x, _) in docs.items()] + [(99, 0, "y")], "doc_id long, n_frames long, b string")
    m = spark.createDataFrame([(d, x) for d, (_, ms) in docs.items() for x in ms] + [(1, 1), (1000, 5), (3, -4)], "doc_id long, mid long")
    got = rows(splits.greedy_split_points(n, m, target, search, span=300))
    assert got == sorted(((d, k, at) for d, (x, ms) in docs.items() for k, at in enumerate(split_loop(x, ms, target, search))), key=repr)


def test_split_points_of_a_million_middles(spark):
    n = 20_000_000
    m = spark.range(1_000_000).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 20 + F.pmod(F.xxhash64("id"), F.lit(17))).alias("mid"))
    mids = sorted(x["mid"] for x in m.collect())
    got = [x["at"] for x in splits.greedy_split_points(spark.createDataFrame([(1, n)], "doc_id long, n_frames long"), m, 4500, 500).orderBy("k").collect()]
    import bisect

    pos, want = 0, []
    while pos + 4500 < n:
        i = bisect.bisect_left(mids, pos + 4500)
        pos = min((x for x in mids[max(i - 2, 0) : i + 2] if abs(x - pos - 4500) <= 500), key=lambda x: (abs(x - pos - 4500), x), default=pos + 4500)
        want.append(pos)
    assert got == want


def breaks_loop(segs, wins):
    segs = sorted(segs)
    starts, ends = [s for _, s, _ in segs], [e for _, _, e in segs]
    if len(segs) > 1:
        for t0, t1 in sorted(wins):
            at = min(range(len(ends) - 1), key=lambda i: (abs(ends[i] - (t0 + t1) / 2), i))
            ends[at], starts[at + 1] = t0, t1
    return [(i, a, b) for (i, _, _), a, b in zip(segs, starts, ends)]


@pytest.mark.parametrize("seed, overlap", [(1, False), (2, False), (3, True)])
def test_silence_breaks_equal_the_loop(spark, small_ranges, seed, overlap):
    r = random.Random(seed)
    segs, wins = [], []
    for d in range(14):
        t, n = 0.0, r.choice([1, 2, 5, 40, 80])
        for i in range(n):
            e = t + r.choice([0, 1, 2, 6, 30])
            segs.append((d, i * 2, t, e, "x"))
            t = e + r.choice([0, 0, 1])
        x = -3.0
        for _ in range(r.choice([0, 1, 5, 30, 90])):
            x += r.choice([0.5, 1, 2, 9, 40])
            stop = x + r.choice([0.25, 1, 4])
            wins.append((d, x, stop))
            x = stop - 2 if overlap and r.random() < 0.3 else stop
    wins.append((99, 1.0, 2.0))
    df = spark.createDataFrame(segs, "doc_id long, seg_idx long, start double, end double, text string")
    got = rows(splits.apply_silence_breaks(df, spark.createDataFrame(wins, "doc_id long, t0 double, t1 double")))
    want = [(d, *x, "x") for d in range(14) for x in breaks_loop([s[1:4] for s in segs if s[0] == d], [w[1:] for w in wins if w[0] == d])]
    assert got == sorted(want, key=repr)
