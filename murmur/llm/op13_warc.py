"""WARC archives as a Python data source, for writing and reading.

*Writing*: each task appends records to files of its own and begins a new one beyond ``FILE_BYTES``, so that a file is never
too large for one task to read.  A task names its files after a random number and the commit lists those of the tasks that
counted in a manifest, so a retried or lost task leaves no record twice.  With ``compress`` every record is a gzip member of its own,
whose header has the lengths before and after compression (the ``sl`` field of the archives' convention).

*Reading*: the planner packs files into partitions of about ``PARTITION_BYTES``.  A task parses the headers of a record first and judges the
pushed predicates on them (type, identifiers, target, digest; ``spark.sql.python.filterPushdown.enabled`` must be set, which ``read``
does).  The payload of a record that fails, and every payload with ``payload=False``, is skipped: plain files by a seek, compressed ones by
the ``sl`` field or, in files of others that have none, by inflating without keeping.

Blocks are HTTP responses.  A revisit (profile *identical payload digest*) keeps the HTTP headers, with the length of
the payload that it does not repeat, and names the record that has it.

The places of archives are those that ``pyarrow.fs`` opens (local and shared folders, HDFS, object stores).

Defined cases: a null payload is empty; a null ``page_id`` counts as smaller than any, and where all of a group are null all are responses;
rows of the largest ``page_id`` that repeat are all responses; rows that repeat get a record each; a null URL gives a record without a target; control characters in
header values are percent-encoded; payloads of any length are written whole (one record is held in memory, as one cell is); other
columns are ignored; an empty table gives an archive without records; a truncated or foreign file raises an error with its
name and place.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, StringStartsWith, WriterCommitMessage,
)

from murmur.llm.common import BATCH_BYTES, BATCH_ROWS, Scratch, divided, maybe_broadcast, table, text_batches

FILE_BYTES, PARTITION_BYTES = 256 << 20, 128 << 20
MANIFEST = "_files"
#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, content_type string, "
    "payload_bytes long, headers map<string,string>, payload binary"
)
#: Column and the header that it comes from.
HEADERS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest", "content_type": "content-type",
}
_READ = 1 << 16


# ---------------------------------------------------------------- records


def _value(v: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", v)


def _hex_digest(v: str | None) -> str | None:
    """sha1:BASE32 as bare hex; other forms stay."""
    if v and v[:5].lower() == "sha1:" and len(v) == 37:
        return base64.b32decode(v[5:].upper()).hex()
    return v


def record(row: dict) -> bytes:
    """One record of columns record_id, record_type, target_uri, refers_to, payload_digest (hex), payload_bytes, payload."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + payload
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", DATE), ("WARC-Target-URI", row["target_uri"])]
    head += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()), ("Content-Type", "application/http; msgtype=response")]
    head += [("WARC-Refers-To", row["refers_to"]), ("WARC-Profile", PROFILE)] if revisit else []
    lines = "".join(f"{k}: {_value(v)}\r\n" for k, v in head if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose extra field has the lengths, so that a reader can pass over it."""
    c = zlib.compressobj(3, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = 24 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Bytes:
    """What a record is read from: the decoded bytes from a place on, as many as are asked for."""

    def __init__(self, source, at: int, size: int):
        self.source, self.at, self.size, self.held = source, at, size, b""
        head = source.read_at(min(_READ, size - at), at)
        self.gz, self.after = head[:2] == b"\x1f\x8b", None
        if self.gz:
            self.inflate = zlib.decompressobj(31)
            if head[3:4] == b"\x04" and head[12:14] == b"sl":
                self.after = at + struct.unpack("<I", head[16:20])[0]
        self._take(head)

    def _take(self, raw: bytes) -> None:
        self.at += len(raw)
        if self.gz:
            self.held += self.inflate.decompress(raw)
            self.at -= len(self.inflate.unused_data)
        else:
            self.held += raw

    def more(self, least: int = 0) -> bool:
        if self.at >= self.size or self.gz and self.inflate.eof:
            return False
        self._take(self.source.read_at(min(max(least, _READ), self.size - self.at), self.at))
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (k := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self.more():
                return None
        out, self.held = self.held[: k + len(mark)], self.held[k + len(mark) :]
        return out

    def exactly(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            self.held = b""
            if not self.more(n - have):
                raise EOFError
            parts.append(self.held)
            have += len(self.held)
        all_ = b"".join(parts)
        self.held = all_[n:]
        return all_[:n]

    def over(self, n: int) -> None:
        """Passes over n bytes of a plain file."""
        if n <= len(self.held):
            self.held = self.held[n:]
        else:
            self.at, self.held = self.at + n - len(self.held), b""

    def end_of_member(self) -> int:
        """Place after this gzip member."""
        if self.after is not None:
            return self.after
        while not self.inflate.eof:
            self.held = b""
            if not self.more():
                raise EOFError
        return self.at


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, v = line.split(":", 1)
            last = last.strip().lower()
            out[last] = v.strip()
    return out


def records(source, size: int, wanted: Callable[[dict], bool] = lambda _: True, payload: bool = True) -> Iterator[dict]:
    """The records of an open file whose headers pass ``wanted``, as columns; other payloads are not decoded."""
    at, b = 0, None
    try:
        while at < size:
            b = _Bytes(source, at, size) if b is None or b.gz else b
            head = b.until(b"\r\n\r\n")
            if head is None or not head.startswith(b"WARC/"):
                raise ValueError("no WARC record")
            h = _fields(head)
            left = int(h["content-length"])
            row = {c: h.get(k) for c, k in HEADERS.items()} | {"headers": h, "payload": None, "payload_bytes": left}
            row["payload_digest"] = _hex_digest(row["payload_digest"])
            if wanted(row):
                if (row["content_type"] or "").startswith("application/http"):
                    http = b.until(b"\r\n\r\n")
                    left -= len(http)
                    row["payload_bytes"] = int(_fields(http).get("content-length", left))
                if payload and row["record_type"] != "revisit":
                    row["payload"], left = b.exactly(left), 0
                yield row
            if b.gz:
                at = b.end_of_member()
            else:
                b.over(left + 4)
                at = b.at - len(b.held)
    except (EOFError, ValueError, KeyError, TypeError, zlib.error) as e:
        raise ValueError(f"not a whole WARC record at byte {at}: {e!r}") from e


# ---------------------------------------------------------------- predicates on headers


def _test(f: Filter) -> Callable[[dict], bool] | None:
    """A pushed filter as a test of header columns; None if it is on anything else."""
    if isinstance(f, Not):
        inner = f.child
        if isinstance(inner, (IsNull, IsNotNull)) and (t := _test(inner)):
            return lambda r: not t(r)
        return None
    if len(f.attribute) != 1 or f.attribute[0] not in HEADERS:
        return None
    c = f.attribute[0]
    if isinstance(f, (EqualTo, EqualNullSafe)):
        return lambda r: r[c] == f.value and (r[c] is not None or isinstance(f, EqualNullSafe))
    if isinstance(f, In):
        among = set(f.value)
        return lambda r: r[c] is not None and r[c] in among
    if isinstance(f, IsNotNull):
        return lambda r: r[c] is not None
    if isinstance(f, IsNull):
        return lambda r: r[c] is None
    if isinstance(f, StringStartsWith):
        return lambda r: r[c] is not None and r[c].startswith(f.value)
    return None


# ---------------------------------------------------------------- the data source


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"\w[\w+.-]*:", path) else "file://" + path)


def _uri(path: str) -> str:
    """file:/x as file:///x."""
    return re.sub(r"^file:/(?=[^/])", "file:///", path)


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class WarcSource(DataSource):
    """``format("warc")``: options ``path``, ``payload`` (false: headers only) and, for writing, ``compress``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(_uri(self.options["path"]), self.options.get("payload", "true") == "true", schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(_uri(self.options["path"]), self.options.get("compress", "true") == "true", overwrite)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, schema):
        self.path, self.payload, self.schema, self.tests = path, payload, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if t := _test(f):
                self.tests.append((f, t))
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, root = _open(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.File:
            found = [(root, info.size)]
        else:
            listed = [i for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File]
            manifests = [i.path for i in listed if i.base_name.startswith(MANIFEST)]
            named = {f"{m.rsplit('/', 1)[0]}/{n}" for m in manifests for n in store.open_input_file(m).read().decode().split()}
            found = [(i.path, i.size) for i in listed if (i.path in named if manifests else re.search(r"\.warc(\.gz)?$", i.path))]
        out: list[list[tuple[str, int]]] = []
        room = 0
        for path, size in sorted(found):
            if size > room:
                out.append([])
                room = PARTITION_BYTES
            out[-1].append((path, size))
            room -= size
        self.tests = [f for f, _ in self.tests]  # the tests are made again in the tasks
        return [Files(x) for x in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        tests = [_test(f) if isinstance(f, Filter) else f[1] for f in self.tests]
        store, _ = _open(self.path)
        rows, size = [], 0
        for path, length in partition.paths:
            with store.open_input_file(path) as f:
                try:
                    for r in records(f, length, lambda r: all(t(r) for t in tests), self.payload):
                        rows.append({n: r[n] if n != "headers" else list(r[n].items()) for n in schema.names})
                        size += len(r["payload"] or b"") + 500
                        if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, compress: bool, overwrite: bool):
        self.path, self.compress, self.overwrite = path, compress, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for b in batches:
            for row in b.to_pylist():
                if out is None or size >= FILE_BYTES:
                    if out:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc{'.gz' if self.compress else ''}")
                    out, size = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                data = member(record(row)) if self.compress else record(row)
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Written(names)

    def commit(self, messages) -> None:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        if self.overwrite:
            keep = {n for m in messages if m for n in m.paths}
            for i in store.get_file_info(fs.FileSelector(root)):
                if i.base_name not in keep and re.match(rf"{MANIFEST}|part-", i.base_name):
                    store.delete_file(i.path)
        with store.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}", compression=None) as f:
            f.write("\n".join(n for m in messages if m for n in m.paths).encode())

    def abort(self, messages) -> None:
        store, root = _open(self.path)
        for n in (n for m in messages if m for n in m.paths):
            store.delete_file(f"{root}/{n}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def write(rows: DataFrame, path: str, compress: bool = True, mode: str = "append") -> None:
    """rows: record_id, record_type, target_uri, refers_to, payload_digest (hex), payload_bytes, payload."""
    register(rows.sparkSession)
    text_batches(rows.sparkSession)
    rows.write.format("warc").option("compress", str(compress).lower()).mode(mode).save(path)


# ---------------------------------------------------------------- records of pages


def _id(page: str, digest: str):
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("null")), F.lit(":"), F.col(digest), F.lit(">"))


def page_records(pages: DataFrame, scratch: Scratch, least: int = LEAST_REVISIT) -> DataFrame:
    """Records of pages (page_id, url, html): of equal payloads, the one of the largest page_id is the response.

    Payloads are equal if their SHA-256 is.  Only digests and page_ids are grouped; payloads move only where their digest may be repeated.
    """
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    p = p.withColumn("same", F.unhex(F.sha2("payload", 256))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    many = p.where(F.col("payload_bytes") >= least).groupBy("same").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1")
    many = scratch.write(many.select("same", "top"), "repeated")
    alone, rest = divided(p, ["same"], many)
    both = alone.withColumn("top", F.lit(None).cast("long")).withColumn("again", F.lit(False))
    joined = rest.join(maybe_broadcast(many.withColumn("m", F.lit(True)), many.count(), 64), "same", "left").withColumn("again", F.coalesce(F.col("m") & ~F.col("page_id").eqNullSafe(F.col("top")), F.lit(False)))
    rows = both.unionByName(joined.drop("m")).withColumn("payload_digest", F.sha1("payload"))
    return rows.select(
        _id("page_id", "payload_digest").alias("record_id"), F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        F.when(F.col("again"), _id("top", "payload_digest")).alias("refers_to"), "payload_digest", "payload_bytes", F.when(~F.col("again"), F.col("payload")).alias("payload"),
    )


def _page(c: str):
    return F.regexp_extract(c, r"^<urn:page:(-?\d+):", 1).try_cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages, read back: digests and lengths of responses are those of the payloads read, of revisits those of their headers."""
    scratch = Scratch(spark, "warc")
    path = f"{scratch.root}/archive"
    write(page_records(table(spark, sf_dir, "pages").select("page_id", "url", "html"), scratch), path)
    full = read(spark, path).where("record_type = 'response'").select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
    again = read(spark, path, payload=False).where("record_type = 'revisit'").select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return full.union(again).select(_page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page("refers_to").alias("refers_to"))


ORACLE = r"""
with p as (select page_id, coalesce(html, '') as html from pages),
g as (select html, max(page_id) as top from p where strlen(html) >= 1000 group by html)
select p.page_id, strlen(p.html)::bigint as payload_bytes, sha1(p.html) as payload_digest,
       case when g.html is null or p.page_id is not distinct from g.top then 'response' else 'revisit' end as record_type,
       case when g.html is not null and p.page_id is distinct from g.top then g.top end as refers_to
from p left join g on g.html = p.html
"""
