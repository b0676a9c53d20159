import random

from murmur.operators import runs, splits, stages, vectors

from .conftest import rows


def music_loop(paras):
    """The definition as a loop: (lo, hi) of runs."""
    short = [len(c) <= 80 for _, c in paras]
    out, i, n = [], 0, len(paras)
    while i < n:
        if not short[i]:
            i += 1
            continue
        end = last = i
        while end + 1 < n and (short[end + 1] or end == last):
            end += 1
            if short[end]:
                last = end
        size = last - i + 1
        t = [x for x, _ in paras[i : last + 1]]
        gaps = [b - a for a, b in zip(t, t[1:]) if a >= 0 and b >= 0 and b - a > 0]
        if size >= 5 and sum(short[i : last + 1]) / size >= 0.75 and gaps and sum(gaps) / len(gaps) < 15:
            out.append((i, last))
        i = last + 1
    return out


def test_music_runs_equal_the_loop(spark):
    r = random.Random(3)
    docs, data = {}, []
    for d in range(40):
        t, paras = 0, []
        for _ in range(r.randint(0, 40)):
            t += r.choice([0, 5, 10, 40])
            paras.append((t if r.random() < 0.9 else -1, "x" * (10 if r.random() < 0.7 else 90)))
        docs[d] = paras
        data += [(d, i, (f"[{t // 60}:{t % 60:02d}] " if t >= 0 else "") + c) for i, (t, c) in enumerate(paras)]
    df = spark.createDataFrame(data, "doc_id long, para_idx long, text string")
    want = sorted((d, lo, hi) for d, p in docs.items() for lo, hi in music_loop(p))
    assert sorted(tuple(x) for x in runs.music_runs(df).select("doc_id", "lo", "hi").collect()) == want
    assert runs.drop_music(df).count() == len(data) - sum(hi - lo + 1 for _, lo, hi in want)


def test_silences(spark):
    energy = [1.0] * 30 + [0.0] * 30 + [1.0] * 20 + [0.0] * 10 + [1.0] * 10 + [0.0] * 26
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(energy)], "doc_id long, frame_idx long, rms double")
    assert rows(runs.silence_windows(df)) == [(1, 0.6, 1.2), (1, 2.0, 2.52)]
    assert rows(runs.silence_midpoints(df)) == [(1, 113), (1, 45)]


def test_rms_leaves_out_the_partial_frame(spark):
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([3, 4, 0, 0, 9])], "doc_id long, i long, x double")
    assert [(a, b, round(c, 6)) for a, b, c in rows(runs.frame_rms(df, 2))] == [(1, 0, round(12.5**0.5, 6)), (1, 1, 0.0)]


def split_loop(n, mids, target, search):
    out, pos = [], 0
    while pos + target < n:
        want = pos + target
        near = [m for m in mids if m > pos and abs(m - want) <= search]
        pos = min(near, key=lambda m: (abs(m - want), m)) if near else want
        out.append(pos)
    return out


def test_split_points_equal_the_loop(spark):
    r = random.Random(1)
    docs = {d: (r.randint(0, 900), sorted(r.sample(range(900), r.randint(0, 20)))) for d in range(30)}
    n = spark.createDataFrame([(d, x) for d, (x, _) in docs.items()], "doc_id long, n_frames long")
    m = spark.createDataFrame([(d, x) for d, (_, ms) in docs.items() for x in ms], "doc_id long, mid long")
    got = rows(splits.greedy_split_points(n, m, 100, 30))
    assert got == sorted(((d, k, at) for d, (x, ms) in docs.items() for k, at in enumerate(split_loop(x, ms, 100, 30))), key=repr)


def test_chunk_bounds(spark):
    p = spark.createDataFrame([(1, 5), (1, 9)], "doc_id long, at long")
    n = spark.createDataFrame([(1, 12), (2, 7)], "doc_id long, n_samples long")
    assert rows(splits.chunk_bounds(p, n)) == [(1, 0, 0, 5), (1, 1, 5, 9), (1, 2, 9, 12), (2, 0, 0, 7)]


def test_silence_breaks(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 2.0, "a"), (1, 1, 2.0, 4.0, "b"), (1, 2, 4.0, 6.0, "c"), (2, 0, 0.0, 1.0, "d")], "doc_id long, seg_idx long, start double, end double, text string")
    w = spark.createDataFrame([(1, 3.8, 4.4), (2, 0.1, 0.2), (3, 0.0, 1.0)], "doc_id long, t0 double, t1 double")
    got = rows(splits.apply_silence_breaks(s, w))
    assert got == [(1, 0, 0.0, 2.0, "a"), (1, 1, 2.0, 3.8, "b"), (1, 2, 4.4, 6.0, "c"), (2, 0, 0.0, 1.0, "d")]


def test_match_and_upsert(spark):
    known = spark.createDataFrame([("ana", 0, [1.0, 0.0]), ("bo", 1, [1.0, 0.0]), ("zero", 2, [0.0, 0.0])], "name string, known_idx long, embedding array<double>")
    c = spark.createDataFrame([("c1", [2.0, 0.0]), ("c2", [0.0, 1.0]), ("c3", [-1.0, 0.0])], "cluster string, embedding array<double>")
    assert rows(vectors.match_speakers(c, known)) == [("c1", 1.0, "ana"), ("c2", 0.0, "c2"), ("c3", 0.0, "c3")]
    assert rows(vectors.match_speakers(c, known.limit(0)).select("cluster", "name")) == [(x, x) for x in ("c1", "c2", "c3")]
    new = spark.createDataFrame([("ana", [5.0]), ("cy", [6.0])], "name string, embedding array<double>")
    assert rows(vectors.upsert_speakers(known.select("name", "embedding"), new)) == [("ana", [5.0]), ("bo", [1.0, 0.0]), ("cy", [6.0]), ("zero", [0.0, 0.0])]


def test_cluster_means_skip_short_turns(spark):
    t = spark.createDataFrame([("a", 0.0, 1.0, [1.0, 3.0]), ("a", 1.0, 2.0, [3.0, 5.0]), ("a", 2.0, 2.4, [99.0, 99.0])], "cluster string, start double, end double, embedding array<double>")
    assert rows(vectors.cluster_means(t, ["cluster"])) == [("a", [2.0, 4.0])]


def test_components_and_longest(spark):
    r = random.Random(2)
    links = [(d, i, j) for d in range(4) for i, j in (sorted(r.sample(range(30), 2)) for _ in range(14))]
    nodes = [(d, i, (i * 7) % 5) for d in range(4) for i in range(30)]
    label = {(d, i): i for d, i, _ in nodes}
    for _ in range(40):
        for d, i, j in links:
            label[d, i] = label[d, j] = min(label[d, i], label[d, j])
    n = spark.createDataFrame(nodes, "doc_id long, i long, words long")
    pairs = spark.createDataFrame(links, "doc_id long, i long, j long")
    for local in (5, None):
        comps = vectors.link_components(n, pairs, "doc_id", "i", local)
        assert {(d, i): c for d, i, c in comps.collect()} == label
    kept = {(d, i) for d, i, *_ in vectors.keep_longest(n, comps, "doc_id", "i").select("doc_id", "i").collect()}
    want = set()
    for key in set((d, c) for (d, _), c in label.items()):
        want.add(min(((-w, d, i) for d, i, w in nodes if (d, label[d, i]) == key))[1:])
    assert kept == want


def test_stages(spark, tmp_path):
    path, schema = str(tmp_path / "out"), "k long, v string"
    inputs = spark.createDataFrame([(1,), (2,)], "k long")
    from pyspark.sql import functions as F

    work = lambda df: df.withColumn("v", F.lit("done"))
    assert stages.run_stage(inputs.where("k = 1"), path, schema, "k", work, dry_run=True).count() == 1
    stages.run_stage(inputs.where("k = 1"), path, schema, "k", work)
    stages.run_stage(inputs, path, schema, "k", work)
    assert rows(stages.read_or_empty(spark, path, schema)) == [(1, "done"), (2, "done")]


def test_long_chains_of_links(spark):
    chain = [(0, i, i + 1) for i in range(60)] + [(1, i, i + 2) for i in range(0, 60, 2)]
    nodes = spark.createDataFrame([(d, i) for d in (0, 1) for i in range(62)], "doc_id long, i long")
    pairs = spark.createDataFrame(chain, "doc_id long, i long, j long")
    want = {(0, i): 0 if i < 61 else 61 for i in range(62)} | {(1, i): i if i % 2 else 0 for i in range(62)}
    want[1, 60] = 0
    want[1, 61] = 61
    for local in (1, None):
        assert {(d, i): c for d, i, c in vectors.link_components(nodes, pairs, "doc_id", "i", local).collect()} == want
    assert vectors.link_components(nodes, pairs.limit(0), "doc_id", "i").where("component = i").count() == 124
