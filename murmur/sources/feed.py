"""Podcast feeds: conditional download and parsing."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.operators.stages import append, read_or_empty
from murmur.sources.http import with_retries

FEED_TTL = 3600
#: (status, body, headers) of a GET of a URL with headers.
Fetch = Callable[[str, dict[str, str]], tuple[int, bytes, dict[str, str]]]


#: Appended at each download or renewal; xml is null where the server said that nothing changed.
COPIES = "url string, xml string, etag string, fetched_at double"


def copies(spark: SparkSession, path: str) -> DataFrame:
    """(url, xml, etag, fetched_at): the newest copy of each feed."""
    got = F.col("xml").isNotNull()
    newest = lambda c: F.max_by(c, F.when(got, F.col("fetched_at")))
    return read_or_empty(spark, path, COPIES).groupBy("url").agg(newest("xml").alias("xml"), newest("etag").alias("etag"), F.max("fetched_at").alias("fetched_at"))


def refresh(spark: SparkSession, urls: list[str], path: str, fetch: Fetch, ttl: float = FEED_TTL, now: float | None = None, retries: int = 3) -> DataFrame:
    """(feed_idx, xml) of feeds in their declared order, from a table of copies on shared storage.

    A feed whose copy is older than ``ttl`` seconds is asked for again, with the copy's tag; an unchanged feed (304) only renews the
    copy's time.  Rows are only appended, so a lost driver loses no copy.
    """
    now = time.time() if now is None else now
    wanted = spark.createDataFrame(list(enumerate(urls)), "feed_idx int, url string")
    stale = wanted.select("url").distinct().join(copies(spark, path), "url", "left").where(F.coalesce(now - F.col("fetched_at") >= ttl, F.lit(True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                headers = {"If-None-Match": r.etag.strip()} if r.xml and r.etag else {}
                status, body, got = with_retries(lambda: fetch(r.url, headers), retries)
                tag = next((v for k, v in got.items() if k.lower() == "etag"), None)
                yield pd.DataFrame({"url": [r.url], "xml": [None if status == 304 else body.decode()], "etag": [None if status == 304 else tag], "fetched_at": [now]})

    if stale.limit(1).count():
        append(stale.select("url", "xml", "etag").mapInPandas(run, COPIES), path)
    return wanted.join(copies(spark, path), "url").select("feed_idx", "xml")


#: An item at any depth of a feed; what stands in comments and literal text is passed over.
_LITERAL = r"<!--.*?-->|<!\[CDATA\[.*?\]\]>"
_ITEMS = rf"(?s){_LITERAL}|<item(?:\s[^>]*+)?>[^<]*+(?:(?:{_LITERAL}|(?!</item\s*>)<)[^<]*+)*+</item\s*>"
_ITEM = "title string, enclosure array<struct<_url:string>>"


def parse_feeds(feeds: DataFrame) -> DataFrame:
    """(feed_idx, pos, title, audio_url) of feeds (feed_idx, xml), each feed reversed.

    Items count at any depth.  Those without a first enclosure with a url are left out; a missing title is empty.
    """
    found = F.filter(F.regexp_extract_all("xml", F.lit(_ITEMS), F.lit(0)), lambda x: F.startswith(x, F.lit("<item")))
    items = feeds.select("feed_idx", F.posexplode(found).alias("p", "x")).withColumn("item", F.from_xml("x", _ITEM))
    items = items.withColumn("url", F.get("item.enclosure", F.lit(0)).getField("_url")).where(F.coalesce("url", F.lit("")) != "")
    return items.select("feed_idx", (-F.col("p")).cast("long").alias("pos"), F.coalesce("item.title", F.lit("")).alias("title"), F.col("url").alias("audio_url"))


def read_feeds(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Feed files in their declared order, read as whole texts; each file is named by its place in the list."""
    one = [spark.read.text(p, wholetext=True).select(F.lit(i).alias("feed_idx"), F.col("value").alias("xml")) for i, p in enumerate(paths)]
    return parse_feeds(reduce(DataFrame.unionByName, one))
