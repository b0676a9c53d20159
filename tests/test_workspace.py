import pytest

from murmur import cli
from murmur.operators import stages
from murmur.operators.chunks import resume_chunks
from murmur.workspace import Show, Tools, Workspace, check_options

from .conftest import rows


def asr():
    return lambda xs: [{"text": "all", "language": "en", "segments": [{"start": 0.0, "end": 2.0, "text": f"example institute is {bytes(x).decode()}"}, {"start": 2.1, "end": 4.0, "text": "and cooking is fine today."}, {"start": 9.0, "end": 9.5, "text": "bye for now"}]} for x in xs]


def turns():
    return lambda xs: [[{"start": 0.0, "end": 2.0, "speaker": "S1"}, {"start": 2.0, "end": 8.0, "speaker": "S2"}] for _ in xs]


def voices():
    return lambda xs: [[{"speaker": "S1", "start": 0.0, "end": 2.0, "embedding": [1.0, 0.0]}, {"speaker": "S2", "start": 2.0, "end": 8.0, "embedding": [0.0, 1.0]}] for _ in xs]


@pytest.fixture
def made(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    tools = Tools(get=lambda u: (200, u[-1].encode(), {}), asr=asr, diarizer=turns, turn_vectors=voices, complete=lambda: lambda xs: [x.upper() for x in xs])
    w = Workspace(spark, str(tmp_path / "ws"), Show("s", "S"), tools=tools)
    feed = spark.createDataFrame([(0, 0, "First One!", "http://x/1"), (0, 1, "Second", "http://x/2")], "feed_idx int, pos long, title string, audio_url string")
    return w, w.episodes(feed)


def test_stages_run_once(made):
    w, e = made
    assert w.produce(e, dry_run=True) == {"download": 2, "recognised": 2, "render": 2}
    assert w.produce(e, 1) == {"download": 1, "recognised": 1, "render": 1}
    assert w.produce(e) == {"download": 1, "recognised": 1, "render": 1}
    assert w.produce(e) == {"download": 0, "recognised": 0, "render": 0}
    assert rows(w.texts().select("slug", "text")) == [(s, f"[0:00] example institute is {n} and cooking is fine today.\n\n[0:09] bye for now") for s, n in (("001-first-one", 1), ("002-second", 2))]
    assert [r["status"] for r in w.status(e).collect()] == ["t-", "t-"]
    assert w.produce(e, 2, redo=True)["recognised"] == 1
    assert w.texts().count() == 2
    with pytest.raises(ValueError):
        w.produce(e, 9)


def test_speakers_are_named_and_learnt(made):
    w, e = made
    w.produce(e, 1, diarize=True, speakers=["Ana", "Bo"], learn=True)
    assert rows(w.speakers()) == [("Ana", [1.0, 0.0]), ("Bo", [0.0, 1.0])]
    assert w.texts(True).first()["text"].startswith("[0:00 | Ana] example institute")
    w.produce(e, 2, diarize=True)
    t = {r["slug"]: r["speaker_mapping"] for r in w.read("transcripts", "slug string, speaker_mapping map<string,string>").collect()}
    assert t == {"001-first-one": {"S1": "Ana", "S2": "Bo"}, "002-second": {"S1": "Ana", "S2": "Bo"}}


def test_voices_are_replaced_by_name(made):
    w, e = made
    w.produce(e, 1, diarize=True, speakers=["Ana", "Bo"], learn=True)
    w._learn(e.where("number = 1"), ["Bo", "Cy"])
    assert rows(w.speakers()) == [("Ana", [1.0, 0.0]), ("Bo", [1.0, 0.0]), ("Cy", [0.0, 1.0])]


def test_redoing_an_episode_rewrites_no_table(made, tmp_path):
    w, e = made
    w.produce(e)
    files = lambda: {p: p.stat().st_mtime_ns for t in ("raw", "transcripts", "texts") for p in (tmp_path / "ws/s/default" / t).glob("part-*")}
    before = files()
    w.tools.asr = lambda: lambda xs: [{"text": "new", "language": "en", "segments": [{"start": 0.0, "end": 2.0, "text": "another text of it."}]} for _ in xs]
    assert w.produce(e, 1, redo=True) == {"download": 0, "recognised": 1, "render": 1}
    assert {p: t for p, t in files().items() if p in before} == before
    want = [("001-first-one", "[0:00] another text of it."), ("002-second", "[0:00] example institute is 2 and cooking is fine today.\n\n[0:09] bye for now")]
    assert rows(w.texts().select("slug", "text")) == want
    w.compact()
    assert rows(w.texts().select("slug", "text")) == want and w.spark.read.parquet(w.path("texts")).count() == 2
    assert w.produce(e) == {"download": 0, "recognised": 0, "render": 0}


def test_two_drivers_at_once(made):
    """Both find the same work pending; each appends; one row of each episode counts."""
    w, e = made
    other = Workspace(w.spark, w.root.rsplit("/", 1)[0], w.show, tools=w.tools)
    pending = {t: w.read(t, s) for t, s in (("audio", "slug string, audio binary"), ("raw", "slug string, text string"))}
    for d in (w, other):
        d.read, real = (lambda t, s, shared=False, d=d: pending[t].limit(0) if t in pending and d.blind else Workspace.read(d, t, s, shared)), d.read
        d.blind = True
        d.download(e)
        d.blind, d.read = False, real
    assert w.spark.read.parquet(w.path("audio", True)).count() == 4
    assert w.audio().count() == other.audio().count() == 2
    assert w.produce(e) == {"download": 0, "recognised": 2, "render": 2} and other.texts().count() == 2


def test_voices_are_those_of_the_episode_named(made):
    """Both episodes are stored; naming the first one's speakers learns from its own audio."""
    w, e = made

    def voices_of(xs):
        return [[{"speaker": "S1", "start": 0.0, "end": 2.0, "embedding": [float(bytes(x)), 0.0]}, {"speaker": "S2", "start": 2.0, "end": 8.0, "embedding": [0.0, float(bytes(x))]}] for x in xs]

    w.tools.turn_vectors = lambda: voices_of
    w.produce(e, 2, diarize=True)
    w.produce(e, 1, diarize=True, speakers=["Ana", "Bo"], learn=True)
    assert rows(w.speakers()) == [("Ana", [1.0, 0.0]), ("Bo", [0.0, 1.0])]


def test_tables_are_replaced_as_a_whole(spark, tmp_path):
    path, one = str(tmp_path / "t"), "x long"
    stages.replace(spark.createDataFrame([(1,), (2,)], one), path)
    stages.replace(stages.read_or_empty(spark, path, one).where("x > 1"), path)
    assert rows(stages.read_or_empty(spark, path, one)) == [(2,)] and sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    (tmp_path / "t").rename(tmp_path / "t.old")
    assert rows(stages.read_or_empty(spark, path, one)) == [(2,)]


def test_own_feeds(made, tmp_path):
    w, _ = made
    xml = '<rss><channel><item><title>B</title><enclosure url="b"/></item><item><title>A</title><enclosure url="a"/></item></channel></rss>'
    w.show, w.tools.fetch = Show("s", "S", ["u"]), lambda url, headers: (200, xml.encode(), {})
    assert rows(w.load_episodes().select("number", "slug", "audio_url")) == [(1, "001-a", "a"), (2, "002-b", "b")]


def test_cleaning_and_notes(made):
    w, e = made
    w.produce(e)
    w.denoise(e, 1)
    w.denoise(e)
    assert w.read("denoised", "slug string, text string").count() == 2 and w.savings("denoised").count() == 2
    w.denoise2(e)
    w.extract(e)
    w.distill(e)
    out = w.read("distilled/small/large", "slug string, model string, notes string")
    assert out.count() == 2 and all("COOKING" in r["notes"] for r in out.collect())


def test_options():
    with pytest.raises(ValueError):
        check_options("sync", learn=True)
    with pytest.raises(ValueError):
        check_options("sync", learn=True, speakers=["a"])
    check_options("diarize", learn=True, speakers=["a"])
    a = cli.parser().parse_args(["--root", "r", "--feeds", "f", "denoise2", "3", "--similarity-threshold", "0.8"])
    assert (a.number, a.similarity_threshold) == (3, 0.8)


def test_chunks_resume(spark, tmp_path):
    path, seen = str(tmp_path / "done"), str(tmp_path / "seen")

    def infer():
        def run(xs):
            with open(seen, "a") as f:
                f.writelines(f"{x}\n" for x in xs)
            return [{"text": x, "segments": [{"start": 0.0, "end": 1.0, "text": x}] if x else []} for x in xs]

        return run

    all_ = spark.createDataFrame([("k", 2, "c"), ("k", 0, "a"), ("k", 1, "")], "key string, i int, input string")
    resume_chunks(all_.where("i = 0"), path, infer).collect()
    out = resume_chunks(all_, path, infer).first()
    assert (out["text"], [s["text"] for s in out["segments"]]) == ("a c", ["a", "c"])
    assert sorted(open(seen).read().split("\n")) == ["", "", "a", "c"]
