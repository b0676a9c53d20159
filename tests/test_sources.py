import json

import pytest
from pyspark.sql import functions as F

from murmur import models as M
from murmur.sources import feed, http, transcripts
from murmur.streaming.gaps import gap_segments_stream

from .conftest import rows

RSS = """<?xml version="1.0"?><rss><channel><title>t</title>{}</channel></rss>"""
ITEM = '<item><title>{}</title><enclosure url="http://x/{}" type="audio/mpeg"/></item>'


def test_feeds_are_reversed_and_keep_order(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS.format(ITEM.format("one", 1) + "<item><title>none</title></item>" + ITEM.format("two", 2)))
    (tmp_path / "b.xml").write_text(RSS.format(ITEM.format("three", 3) * 2))
    df = feed.read_feeds(spark, [str(tmp_path / "a.xml"), str(tmp_path / "b.xml")])
    assert [r["title"] for r in df.orderBy("feed_idx", "pos").collect()] == ["two", "one", "three", "three"]


def test_items_at_any_depth(spark):
    deep = "<rss><channel><!-- " + ITEM.format("no", 0) + " --><group>" + ITEM.format("in", 1) + "</group></channel>" + ITEM.format("<![CDATA[a </item> b]]>", 2) + "<item>x</item></rss>"
    untitled = '<item>\n<enclosure/><enclosure url="u3"/></item><item><enclosure url="u4"/></item>'
    df = spark.createDataFrame([(0, deep), (1, untitled), (2, None), (3, "")], "feed_idx int, xml string")
    got = [(r["feed_idx"], r["title"], r["audio_url"]) for r in feed.parse_feeds(df).orderBy("feed_idx", "pos").collect()]
    assert got == [(0, "a </item> b", "http://x/2"), (0, "in", "http://x/1"), (1, "", "u4")]


def test_refresh(spark, tmp_path):
    log, path = tmp_path / "calls", str(tmp_path / "feeds")

    def fetch(url, headers):
        with log.open("a") as f:
            f.write(f"{url} {headers.get('If-None-Match', '')}\n")
        n = len(log.read_text().splitlines())
        return [(200, b"v1", {"ETag": "e1"}), (304, b"", {}), (200, b"v2", {})][n - 1]

    def ask(now):
        return [tuple(r) for r in feed.refresh(spark, ["u"], path, fetch, now=now).collect()], log.read_text().split("\n")[:-1]

    assert ask(0.0) == ([(0, "v1")], ["u "])
    assert ask(10.0) == ([(0, "v1")], ["u "])
    assert ask(3600.0) == ([(0, "v1")], ["u ", "u e1"])
    assert ask(7199.0)[1] == ["u ", "u e1"]
    assert ask(7200.0) == ([(0, "v2")], ["u ", "u e1", "u e1"])


def test_completion(spark):
    def post(url, body, headers):
        asked = json.loads(body)
        assert asked["stream"] and asked["top_k"] == 64 and headers["Content-Type"] == "application/json" and url == "u"
        return 200, "\n".join("data: " + json.dumps({"choices": [{"delta": {"content": m["content"] + ";"}}]}) for m in asked["messages"]).encode() + b"\ndata: [DONE]\n"

    df = spark.createDataFrame([(1, "text")], "i long, t string")
    assert M.map_model(df, "t", "o", http.chat_completion("u", post, "prompt")).first()["o"] == "prompt;text;"
    assert http.post_json(lambda *a: (200, b'{"a": 1}'), "u", {}) == {"a": 1}
    with pytest.raises(RuntimeError):
        http.post_json(lambda *a: (500, b"no"), "u", {})


def test_retries():
    seen, waits = [], []

    def get():
        seen.append(1)
        if len(seen) == 1:
            raise OSError("reset")
        return (503, b"", {}) if len(seen) == 2 else (200, b"ok", {})

    assert http.with_retries(get, 5, waits.append)[1] == b"ok" and waits == [1, 2]
    with pytest.raises(RuntimeError):
        http.with_retries(lambda: (404, b"", {}), 5, waits.append)
    waits.clear()
    with pytest.raises(RuntimeError):
        http.with_retries(lambda: (503, b"", {}), 2, waits.append)
    assert waits == [1, 2]
    lines = ["", "data: " + json.dumps({"choices": [{"delta": {"content": "a"}}]}), 'data: {"choices": [{"delta": {}}]}', "data: [DONE]", "data: x"]
    assert [*http.server_sent_text(iter(lines))] == ["a"]


def test_fetch_all(spark):
    urls = spark.createDataFrame([("k1", "u1"), ("k2", "u2")], "key string, url string")
    assert [bytes(r["body"]) for r in http.fetch_all(urls, lambda u: (200, u.encode(), {})).orderBy("key").collect()] == [b"u1", b"u2"]


def test_transcripts(spark, tmp_path):
    doc = {"text": "x", "language": "en", "backend": "b", "speaker_mapping": {"S": "Ana"}, "segments": [{"start": 0, "end": 1.5, "text": "hi", "speaker": "S"}]}
    (tmp_path / "001-ep.json").write_text(json.dumps(doc, indent=1))
    t = transcripts.read_transcripts(spark, str(tmp_path / "*.json"))
    assert rows(transcripts.explode_segments(t)) == [("001-ep", 0, 0.0, 1.5, "hi", "S")]
    assert t.first()["speaker_mapping"] == {"S": "Ana"}


def test_checkpoint_drops_bad_lines_and_keeps_the_last(spark, tmp_path):
    (tmp_path / "c").write_text('{"i":0,"text":"a","segments":[]}\nnot json\n{"i":0,"text":"b","segments":[]}\n{"i":1,"text":"c","segments":[]}\n')
    assert rows(transcripts.read_checkpoint(spark, str(tmp_path / "c")).select("i", "text")) == [(0, "b"), (1, "c")]


def test_speakers_and_turns(spark, tmp_path):
    assert transcripts.read_speakers(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "s.json").write_text('{"ana": [1, 2], "bo": [3]}')
    assert rows(transcripts.read_speakers(spark, str(tmp_path / "s.json"))) == [("ana", [1.0, 2.0]), ("bo", [3.0])]
    back = transcripts.turns_from_json(F.lit('[{"start": 1, "end": 2, "speaker": "S"}]'))
    assert spark.range(1).select(back).first()[0][0].asDict() == {"start": 1.0, "end": 2.0, "speaker": "S"}


def test_sizes():
    assert M.pick_model(16).id == "small" and M.pick_model(64).id == "large" and M.find_model("small").id == "small"


def test_formulas(spark):
    df = spark.createDataFrame([(1.0,), (12.0,), (900.0,)], "b double")
    assert [r[0] for r in df.select(M.chunk_seconds(F.col("b"))).collect()] == [30, 45, 600]
    assert [r[0] for r in df.select(M.context_length(F.col("b"), F.lit(5.0))).collect()] == [131072, 131072, 131072]
    assert df.select(M.context_length(F.col("b"), F.lit(60.0))).first()[0] == 18432


def test_guarded_correction(spark):
    texts = [("the bread is good tonight",), ("keep every important word",)]
    fix = lambda: lambda xs: [x.replace("tonight", "tonights") if "bread" in x else "keep every word" for x in xs]
    df = M.guarded_correction(spark.createDataFrame(texts, "t string"), "t", "o", fix)
    assert [r["o"] for r in df.collect()] == ["the bread is good tonights", "keep every important word"]


def test_stream_equals_batch(spark, tmp_path):
    schema = "doc_id long, seg_idx long, start double, end double"
    src = str(tmp_path / "src")
    spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 1.2, 2.0), (2, 0, 0.0, 1.0)], schema).coalesce(1).write.parquet(src)
    spark.createDataFrame([(1, 2, 9.0, 9.5), (2, 1, 1.1, 2.0)], schema).coalesce(1).write.mode("append").parquet(src)
    stream = gap_segments_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    q = stream.writeStream.format("memory").queryName("gaps").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("gaps").select("doc_id", "seg_idx", "para_idx")) == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (2, 0, 0), (2, 1, 0)]
