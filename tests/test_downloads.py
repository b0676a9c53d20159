import json
from pathlib import Path

import pytest

from murmur.operators.segments import offset_segments
from murmur.sources import http
from murmur.workspace import Tools, recognise_file

from .conftest import rows
from .test_workspace import asr, turns

BODY = bytes(i * 7 % 251 for i in range(10_000))


def server(log, fail_after=None, ranges=True):
    """A transport that gives chunks of 700 bytes and may break off after some bytes."""

    def stream(url, start):
        with open(log, "a") as f:
            f.write(f"{url} {start}\n")
        if url == "gone":
            return 404, []
        body = BODY[start:] if ranges else BODY

        def chunks():
            for i in range(0, len(body), 700):
                if fail_after is not None and i >= fail_after:
                    raise OSError("broken off")
                yield body[i : i + 700]

        return (206 if start and ranges else 200), chunks()

    return stream


def whole(spark, path):
    parts = http.bodies(spark, path).orderBy("key", "part").collect()
    assert all(len(p["data"]) <= 1024 for p in parts)
    return {k: b"".join(bytes(p["data"]) for p in parts if p["key"] == k) for k in {p["key"] for p in parts}}


@pytest.mark.parametrize("ranges", [True, False])
def test_downloads_go_on_where_they_stopped(spark, tmp_path, ranges):
    urls = spark.createDataFrame([("a", "http://x/a"), ("b", "http://x/b"), ("c", "gone")], "key string, url string")
    path, log, none = str(tmp_path / "parts"), str(tmp_path / "log"), lambda _: None
    http.download_parts(urls, path, server(log, 3000, ranges), 0, 2, 1024, sleep=none)
    assert whole(spark, path) == {}
    stored = http.stages.read_or_empty(spark, path, http.PARTS)
    assert rows(stored.groupBy("key").agg(http.F.sum(http.F.length("data")))) == [("a", 3500), ("b", 3500)]
    todo = http.download_parts(urls, path, server(log, None, ranges), 0, 2, 1024, sleep=none)
    assert rows(todo) == rows(urls) and whole(spark, path) == {"a": BODY, "b": BODY}
    assert sorted(Path(log).read_text().split("\n"))[-4:] == ["http://x/a 0", "http://x/a 3500", "http://x/b 0", "http://x/b 3500"]
    assert rows(http.download_parts(urls, path, server(log), 0, 2, 1024, sleep=none)) == [("c", "gone")]


def test_downloads_stop_when_told(spark, tmp_path):
    urls = spark.createDataFrame([("a", "http://x/a")], "key string, url string")
    path, log = str(tmp_path / "parts"), str(tmp_path / "log")
    http.download_parts(urls, path, server(log), part_bytes=1024, stop=lambda: True)
    assert whole(spark, path) == {}
    http.download_parts(urls, path, server(log), part_bytes=1024)
    assert whole(spark, path) == {"a": BODY}


def test_pieces_are_handed_on_as_they_come():
    came = []

    def chunks():
        for piece in (b'data: {"choices": [{"delta": {"con', b'tent": "one"}}]}\n', b'data: {"choices": [{"delta": {"content": "\xc3\xa9"}}]}\ndata: [DONE]\n', b"never read"):
            came.append(piece)
            yield piece

    got = http.stream_text(lambda url, body, headers: (200, chunks()), "u", {"x": 1})
    assert next(got) == "one" and len(came) == 2
    assert list(got) == ["\u00e9"] and len(came) == 3
    with pytest.raises(RuntimeError, match="status 500: no"):
        list(http.stream_text(lambda *_: (500, [b"no"]), "u", {}))


@pytest.mark.parametrize("diarize", [False, True])
def test_one_file(spark, tmp_path, diarize):
    (tmp_path / "x.opus").write_bytes(b"7")
    out = tmp_path / "x.json"
    assert recognise_file(spark, Tools(asr=asr, diarizer=turns), str(tmp_path / "x.opus"), str(out), diarize) == 3
    got = json.loads(out.read_text())
    assert got["text"] == "all" and got["language"] == "en" and got["segments"][0]["text"] == "example institute is 7"
    assert [s.get("speaker") for s in got["segments"]] == (["S1", "S2", "UNKNOWN"] if diarize else [None] * 3)


def test_aligned_sentences_begin_with_a_space(spark):
    s = spark.createDataFrame([(0.5, 1.0, " a b ", 10.0)], "start double, end double, text string, offset_s double")
    assert rows(offset_segments(s, aligned=True)) == [(10.5, 11.0, " a b", 10.0)] and rows(offset_segments(s)) == [(10.5, 11.0, " a b ", 10.0)]
