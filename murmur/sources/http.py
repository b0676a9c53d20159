"""Downloads as a Spark stage, with an injected transport.

``fetch_all`` takes bodies whole, for small ones.  ``download_parts`` stores a body as rows of bounded size as it streams in: an interrupted
download goes on from the parts that are stored, and a row without data, written last, says that a body is whole.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators import stages

RETRYABLE = (500, 502, 503, 504)
GOOD = (200, 206, 304)
#: How completions are sampled.
SAMPLING = {"temperature": 1.0, "top_p": 0.95, "top_k": 64, "thinking": False}
#: (status, body) of a POST to a URL of a body with headers; the body whole, or in chunks as it streams in.
Post = Callable[[str, bytes, dict[str, str]], tuple[int, bytes | Iterable[bytes]]]
#: (status, chunks) of a GET of a URL from a byte on (206), or of all of it (200).
Stream = Callable[[str, int], tuple[int, Iterable[bytes]]]
PART_BYTES = 16 << 20
#: Parts of bodies: at counts the bytes before; data is null in the last row, which has the size of the body in ``at``.
PARTS = "key string, part int, at long, data binary, sha256 string"


def with_retries(get: Callable[[], tuple[int, bytes, dict]], retries: int, sleep: Callable[[float], None] = time.sleep) -> tuple[int, bytes, dict]:
    """Calls get until its status is good; server errors and connection errors are tried again ``retries`` times, after 2**attempt seconds."""
    for attempt in range(retries + 1):
        try:
            status, body, headers = get()
            if status in GOOD:
                return status, body, headers
            if status not in RETRYABLE or attempt == retries:
                raise RuntimeError(f"status {status}")
        except OSError:
            if attempt == retries:
                raise
        sleep(2**attempt)
    raise RuntimeError("no attempt was made")


def server_sent_text(lines: Iterable[str]) -> Iterator[str]:
    """Text pieces of a stream of server-sent events, up to [DONE]."""
    for line in lines:
        line = line.strip()
        if not line.startswith("data:"):
            continue
        data = line[5:].strip()
        if data == "[DONE]":
            return
        piece = (json.loads(data).get("choices") or [{}])[0].get("delta", {}).get("content")
        if piece:
            yield piece


def lines_of(chunks: Iterable[bytes]) -> Iterator[str]:
    """Lines of a streamed body, each as soon as it is whole."""
    held = b""
    for chunk in chunks:
        *lines, held = (held + chunk).split(b"\n")
        for line in lines:
            yield line.decode()
    if held:
        yield held.decode()


def post_json(post: Post, url: str, body: object) -> object:
    """The parsed answer to a JSON body; any status but 200 raises."""
    return json.loads(_answer(post, url, body))


def _chunks(post: Post, url: str, body: object) -> Iterable[bytes]:
    status, data = post(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    chunks = [data] if isinstance(data, bytes) else data
    if status != 200:
        raise RuntimeError(f"status {status}: {b''.join(chunks).decode(errors='replace')}")
    return chunks


def _answer(post: Post, url: str, body: object) -> bytes:
    return b"".join(_chunks(post, url, body))


def stream_text(post: Post, url: str, body: dict) -> Iterator[str]:
    """Pieces of a completion, each handed on as it comes."""
    return server_sent_text(lines_of(_chunks(post, url, body | {"stream": True})))


def chat_completion(url: str, post: Post, prompt: str = "", sampling: dict | None = None) -> Callable[[], Callable[[list], list]]:
    """A completion model (a factory as in ``murmur.models``) behind a chat server, for ``Tools.complete`` or ``map_model``.

    The prompt is the system's message and each text the user's; the answer is the streamed pieces, joined.
    """
    system = [{"role": "system", "content": prompt}] if prompt else []

    def one(text: str) -> str:
        return "".join(stream_text(post, url, {"messages": [*system, {"role": "user", "content": text}], **(SAMPLING if sampling is None else sampling)}))

    return lambda: lambda texts: [one(t) for t in texts]


def fetch_all(urls: DataFrame, get: Callable[[str], tuple[int, bytes, dict]], retries: int = 5, parallel: int = 4) -> DataFrame:
    """(key, url, status, body) of urls (key, url), by at most ``parallel`` tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                status, body, _ = with_retries(lambda: get(r.url), retries)
                yield pd.DataFrame({"key": [r.key], "url": [r.url], "status": [status], "body": [body]})

    return urls.select("key", "url").repartition(parallel).mapInPandas(run, "key string, url string, status int, body binary")


def _parts(key: str, url: str, at: int, part: int, stream: Stream, retries: int, part_bytes: int, stop: Callable[[], bool], sleep: Callable[[float], None]) -> Iterator[tuple]:
    """Rows of one body from a byte on; ends without the last row when it is stopped or the retries are used up."""
    held, attempt = bytearray(), 0

    def row(data: bytes) -> tuple:
        return key, part, at, data, hashlib.sha256(data).hexdigest()

    while attempt <= retries:
        try:
            status, chunks = stream(url, at + len(held))
            if status in RETRYABLE:
                raise OSError(f"status {status}")
            if status not in (200, 206):
                return
            skip = at + len(held) if status == 200 else 0  # the whole body came
            for chunk in chunks:
                if stop():
                    return
                if skip:
                    chunk, skip = chunk[skip:], max(0, skip - len(chunk))
                held += chunk
                while len(held) >= part_bytes:
                    data = bytes(held[:part_bytes])
                    yield row(data)
                    del held[:part_bytes]
                    at, part = at + len(data), part + 1
            if held:
                yield row(bytes(held))
                at, part = at + len(held), part + 1
            yield key, part, at, None, None
            return
        except OSError:
            attempt += 1
            if attempt <= retries:
                sleep(2 ** (attempt - 1))
    if held:
        yield row(bytes(held))  # what came is kept for the next run


def download_parts(
    urls: DataFrame, path: str, stream: Stream, retries: int = 5, parallel: int = 4, part_bytes: int = PART_BYTES, stop: Callable[[], bool] = lambda: False, sleep: Callable[[float], None] = time.sleep
) -> DataFrame:
    """Downloads the bodies of urls (key, url) that the table of parts at path lacks; returns the urls that were not whole before.

    A task holds one part and one chunk.  Stored parts count up to the first that is missing, and the download goes on after them; ``stop`` is asked
    between chunks.
    """
    spark = urls.sparkSession
    stored = stages.read_or_empty(spark, path, PARTS)
    whole = stored.where("data is null").select("key").distinct()
    todo = urls.select("key", "url").join(whole, "key", "left_anti")
    sizes = stored.where("data is not null").groupBy("key", "part").agg(F.max(F.length("data")).cast("long").alias("n"), F.max("at").alias("at"))
    have = sizes.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "at", "n"))).alias("have"))  # a few numbers for each part
    todo = stages.written(todo.join(have, "key", "left").repartition(parallel))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                at = part = 0
                for h in r.have if r.have is not None else []:
                    if h["part"] == part and h["at"] == at:
                        at, part = at + h["n"], part + 1
                for row in _parts(r.key, r.url, at, part, stream, retries, part_bytes, stop, sleep):
                    yield pd.DataFrame([row], columns=["key", "part", "at", "data", "sha256"])

    stages.append(todo.mapInPandas(run, PARTS), path)
    return todo.select("key", "url")


def bodies(spark, path: str) -> DataFrame:
    """(key, size, part, at, data) of the bodies that are whole, each part once."""
    parts = stages.read_or_empty(spark, path, PARTS)
    whole = parts.where("data is null").groupBy("key").agg(F.max("at").alias("size"), F.max("part").alias("_parts"))
    return parts.where("data is not null").join(whole, "key").where("part < _parts").dropDuplicates(["key", "part"]).select("key", "size", "part", "at", "data")
