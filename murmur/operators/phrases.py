"""Removal of phrases, with a phrase table of any size.

The n-grams of a text, of the lengths that phrases have, meet the phrases in one equi-join on their words.  Of phrases that overlap the longer one
goes, then the earlier one: overlapping spans form islands (a scan in two levels, so one text may have most of all spans), and only inside an island
one span is taken after the other.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators.scan import Last, Least, Ranges, Sum, small, written


def _longest_first(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of spans (first, last) those that stay when the longest is taken first, the earlier one of equals."""
    taken: list[tuple[int, int]] = []
    for first, last in sorted(set(spans), key=lambda s: (s[0] - s[1], s)):
        i = bisect_left(taken, (first, last))
        if not (i and taken[i - 1][1] >= first) and not (i < len(taken) and taken[i][0] <= last):
            insort(taken, (first, last))
    return taken


def phrase_spans(texts: DataFrame, phrases: DataFrame, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(key, first, last): places, from 1, of the phrases that go.

    texts: (key, tokens), one row for each key; phrases: (phrase, not_after, not_before): lower-case words, and the words (or null) after or before which
    the phrase stays.  A phrase that stays so does not keep another one from going.
    """
    p = written(phrases.where(F.size("phrase") > 0).select("phrase", "not_after", "not_before").distinct(), "phrases")
    count, sizes = p.agg(F.count("*"), F.collect_set(F.size("phrase"))).first()
    if not count:
        return texts.select(key, F.lit(0).alias("first"), F.lit(0).alias("last")).limit(0)
    low = F.transform(tokens, F.lower)
    t = texts.select(key, low.alias("_low")).withColumn("_n", F.explode(F.array(*map(F.lit, sorted(sizes))))).where(F.size("_low") >= F.col("_n"))
    t = t.withColumn("first", F.explode(F.sequence(F.lit(1), F.size("_low") - F.col("_n") + 1)))
    grams = t.select(
        key, "first", (F.col("first") + F.col("_n") - 1).alias("last"), F.slice("_low", F.col("first"), F.col("_n")).alias("phrase"),
        F.get("_low", F.col("first") - 2).alias("_before"), F.get("_low", F.col("first") + F.col("_n") - 1).alias("_after"),
    )
    none = lambda words, word: ~F.coalesce(F.array_contains(words, F.col(word)), F.lit(False))
    hit = grams.join(small(p, count, 256), "phrase").where(none(F.col("not_after"), "_before") & none(F.col("not_before"), "_after"))
    hit = written(hit.select(key, "first", "last").distinct(), "spans")
    r = Ranges(hit, key, "first")
    x = r.scan(r.attach(hit), ["first", "last"], _end=Least(-F.col("last")))
    x = r.scan(x, ["first", "last"], _past=Last(F.struct("_end")))
    new = F.coalesce(F.col("first") > -F.col("_past._end"), F.lit(True))
    x = r.scan(x.withColumn("_new", new.cast("int")), ["first", "last"], _island=Sum(F.col("_new")))
    islands = x.groupBy(key, "_island").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    kind = dict(texts.dtypes)[key]

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, *s) for k, spans in zip(b[key], b["spans"]) for s in _longest_first([(x["first"], x["last"]) for x in spans])]
            yield pd.DataFrame(out, columns=[key, "first", "last"])

    alone = islands.where(F.size("spans") == 1).select(key, F.col("spans")[0]["first"].alias("first"), F.col("spans")[0]["last"].alias("last"))
    return alone.unionByName(islands.where(F.size("spans") > 1).select(key, "spans").mapInPandas(take, f"{key} {kind}, first int, last int"))


def remove_phrases(texts: DataFrame, phrases: DataFrame, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """texts without the tokens of the phrases that go (see ``phrase_spans``); null tokens stay null."""
    spans = phrase_spans(texts.where(F.col(tokens).isNotNull()), phrases, key, tokens)
    per = written(spans.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct("first", "last")).alias("_spans")), "spans")
    both = texts.join(per, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")

    @F.pandas_udf("array<boolean>")
    def stays(size: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for n, s in zip(size, spans):
            change = np.zeros(n + 2, dtype=np.int64)
            for x in s:
                change[x["first"]] += 1
                change[x["last"] + 1] -= 1
            out.append((np.cumsum(change)[1 : n + 1] == 0).tolist())
        return pd.Series(out)

    hit = both.where(F.col("_spans").isNotNull()).withColumn("_stays", stays(F.size(tokens), F.col("_spans")))
    kept = F.transform(F.filter(F.arrays_zip(F.col(tokens).alias("t"), F.col("_stays").alias("s")), lambda x: x["s"]), lambda x: x["t"])
    hit = hit.withColumn(tokens, kept).select(texts.columns)
    return both.where(F.col("_spans").isNull()).select(texts.columns).unionByName(hit)
