import random

import pytest

from murmur.functions import rules as R
from murmur.operators import phrases, scan

from .conftest import rows


def loop(tokens, table):
    """Longest first, then in order; a covered place is covered once."""
    low = [t.lower() for t in tokens]
    found = []
    for p, after, before in table:
        for i in range(len(low) - len(p) + 1):
            if low[i : i + len(p)] == p and not (i and after and low[i - 1] in after) and not (before and i + len(p) < len(low) and low[i + len(p)] in before):
                found.append((-len(p), i, i + len(p)))
    covered = set()
    for _, a, b in sorted(set(found)):
        if not covered & set(range(a, b)):
            covered |= set(range(a, b))
    return [t for i, t in enumerate(tokens) if i not in covered]


@pytest.mark.parametrize("size", [5, 1_000_000])
def test_phrases_equal_the_loop(spark, monkeypatch, size):
    monkeypatch.setattr(scan, "RANGE_ROWS", size)
    r = random.Random(size)
    words = ["you", "know", "what", "i", "mean", "sort", "of", "Do", "it", "x"]
    table = [(p.split(), R.SEMANTIC_PRECEDES if p in ("you know", "you see") else None, R.SEMANTIC_FOLLOWS if p in ("i mean", "i guess") else None) for p in R.LEXICAL_FILLERS]
    table += [(["know", "what"], None, None), (["x", "x"], None, None), (["x"], ["it"], []), ([], None, None)]
    texts = {i: [r.choice(words) for _ in range(r.randint(0, 60))] for i in range(25)} | {100: [r.choice(["you", "know", "what", "x"]) for _ in range(400)]}
    df = spark.createDataFrame([(k, t, "e") for k, t in texts.items()] + [(-1, None, "e")], "doc_id long, tokens array<string>, first string")
    p = spark.createDataFrame(table, "phrase array<string>, not_after array<string>, not_before array<string>")
    got = {x["doc_id"]: x["tokens"] for x in phrases.remove_phrases(df, p).collect()}
    assert got == {k: loop(t, [x for x in table if x[0]]) for k, t in texts.items()} | {-1: None}
    assert rows(phrases.remove_phrases(df, p.limit(0)).select("doc_id")) == rows(df.select("doc_id"))


def test_many_phrases(spark):
    """A table of 100,000 phrases."""
    from pyspark.sql import functions as F

    p = spark.range(100_000).select(F.array(F.concat(F.lit("a"), F.col("id")), F.concat(F.lit("b"), F.col("id"))).alias("phrase"), F.lit(None).cast("array<string>").alias("not_after"), F.lit(None).cast("array<string>").alias("not_before"))
    t = spark.range(1000).select(F.col("id").alias("doc_id"), F.array(F.lit("x"), F.concat(F.lit("A"), F.col("id") * 100), F.concat(F.lit("b"), F.col("id") * 100), F.concat(F.lit("a"), F.col("id") + 1), F.lit("y")).alias("tokens"))
    got = phrases.remove_phrases(t, p).select(F.size("tokens").alias("n")).groupBy("n").count().collect()
    assert [(x["n"], x["count"]) for x in got] == [(3, 1000)]
