"""Secret scans, URL filters, mixing and licence scans."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from murmur.llm import op1_secrets as O1
from murmur.llm import op7_url_filters as O7
from murmur.llm import op8_mixing as O8
from murmur.llm import op10_licenses as O10
from murmur.llm.common import keyed

TEXTS = [
    None, "", "no secrets here", 'password = "abc" token: abcdef1 x', "Secret=token: abcdefgh", "API_KEY='zzzzzz' apikey=abcdef passwd:123456",
    "\u00e9\U0001F600 AKIA" + "A" * 16 + " and AKIAAKIA" + "B" * 20 + " AKIA12", "x" + "0123456789abcdef" * 2 + "g token=" + "f" * 30, "ghp_" + "a" * 36 + " xoxb-0123456789ab",
    "-----BEGIN RSA PRIVATE KEY----- eyJhbGciOiJI.eyJzdWIiOiIx.sig", "token=" * 50 + "abcdefg\n" * 30, "secret\n=\nabcdefgh", "pa\u017fsword=abcdefgh to\u212aen=abcdefgh",
]


def plain_spans(text):
    text, out = text or "", []
    for i, r in enumerate(O1.RULES):
        for m in re.finditer(r.pattern, text):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), i, r.kind, m.end()))
    return sorted(out)


def test_secrets_equal_a_plain_scan(spark):
    docs = spark.createDataFrame([(i if i != 3 else None, t, "y") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "n")], "doc_id long, text string, spans string")
    got = Counter(tuple(r) for r in O1.report(O1.scan(docs)).collect())
    want = Counter()
    show = lambda xs: ",".join(f"{k}:{s}:{e}" for s, _, k, e in xs)
    for r in docs.collect():
        x = plain_spans(r["text"])
        n = Counter(k for _, _, k, _ in x)
        want[(r["doc_id"], n["assign"], n["access"], n["hex"], hashlib.sha256(show([y for y in x if y[1] < 3]).encode()).hexdigest(), show(x))] += 1
    assert got == want


def test_redact(spark):
    docs = spark.createDataFrame([(1, "a token=abcdefgh b", 18), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: tuple(r) for r in O1.redact(docs).collect()}
    assert out == {1: (1, "a [SECRET] b", 12), 2: (2, "clean", 5), 3: (3, None, None)}


def plain_redact(text):
    out, at = "", 0
    for start, _, _, end in plain_spans(text):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


@pytest.mark.parametrize("page", [1000, 7])
def test_redact_of_many_and_overlapping_spans(spark, monkeypatch, page):
    monkeypatch.setattr(O1, "PAGE", page)
    texts = [t for t in TEXTS if t] + ["\U0001F600 token=" + "f" * 3000 + " é " * 900, "token=abcdefgh " * 400, "é" * 2000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, _rules int")
    assert {r["doc_id"]: r["text"] for r in O1.redact(docs).collect()} == {i: plain_redact(t) for i, t in enumerate(texts)}


def test_spans_cost_the_same_in_long_texts(spark):
    """40,000 spans in one text; a fold that copies its list would take minutes."""
    t = "token=abcdefgh " * 40_000
    docs = spark.createDataFrame([(1, t)], "doc_id long, text string")
    r = O1.report(O1.scan(docs)).first()
    assert r["n_assign"] == 40_000 and r["spans"].endswith("assign:599985:599999")
    assert O1.redact(docs).first()["text"] == "[SECRET] " * 40_000


def test_derived_trigram_queries():
    q = O1.trigram_query
    assert q("hello") == (("ell", "hel", "llo"),) and q("[0-9a-f]{24,}") is None and q("(ab|cd)") is None
    assert q("(?:abc|xyz)[0-9]+") == (("abc",), ("xyz",)) and q("abc.*xyz") == (("abc", "xyz"),)
    assert q("ab?cd") == (("abc", "bcd"), ("acd",)) and q("(foo.*|ba)r") is None and q("(foo.*|bar)") == (("bar",), ("foo",))
    assert q("(abc){2,}") == (("abc", "bca", "cab"),) and q("(abc)*") is None and q("[Kk]ey=") == (("ey=", "key"),)
    assert q("(foo.*x|bar)qux") == (("bar", "qux"), ("foo", "qux"))
    r = random.Random(3)
    parts = ["abc", "[Xx]y", "z?", "(?:de|fgh)", "[0-9]+", ".", "(?:ij|k.l)m", "no{2,3}"]
    for _ in range(400):
        pattern = "".join(r.choice(parts) for _ in range(r.randint(1, 5)))
        for _ in range(20):
            text = "".join(r.choice(["abc", "xy", "Xy", "z", "de", "fgh", "7", "ij", "kkl", "m", "noo", "nooo"]) for _ in range(9))
            if (m := re.search(pattern, text)) and (query := q(pattern)) is not None:
                assert any(all(t in m[0].lower() for t in c) for c in query), (pattern, m[0], query)


def test_candidates_never_miss(spark):
    """A text that matches a rule meets the rule's trigram query."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    found = {r["doc_id"]: set(r["rules"]) for r in keyed(docs).join(O1.candidates(O1.postings(docs)), ["did", "th"]).collect()}
    for i, t in enumerate(TEXTS):
        for r in O1.RULES:
            if r.query is not None and t and re.search(r.pattern, t):
                assert r.kind in found[i]


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert O1.report(O1.scan(docs)).count() == 0 and O10.scan(docs).count() == 0 and O8.replicate(docs).count() == 0
    assert O7.judge(spark.createDataFrame([], "page_id long, url string"), O7.rules_frame(spark)).count() == 0


URLS = [
    (1, "http://Example.ORG/es/1"), (2, "https://a.b.example.org/en/15?x"), (3, "http://notexample.org/es/"), (4, "http://x.com/de/#a"), (5, "http://x.com"), (6, "no url"),
    (7, None), (8, "ftp://y.org?q://z.com/de/"), (9, "http:///de/"), (5, "http://x.com"), (None, "http://q.example.org/en/2"), (10, "http://x.com:80/de/1"), (11, "a\nb://W.com/fr/\u00e9"),
]


def plain_verdict(url):
    m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in O7.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def test_urls(spark):
    got = Counter(tuple(r) for r in O7.judge(spark.createDataFrame(URLS, "page_id long, url string"), O7.rules_frame(spark)).collect())
    assert got == Counter((i, *plain_verdict(u)) for i, u in URLS)
    none = O7.judge(spark.createDataFrame(URLS, "page_id long, url string"), O7.rules_frame(spark, []) if False else O7.rules_frame(spark).limit(0))
    assert {r["verdict"] for r in none.collect()} == {"allow"}


def test_mixing(spark):
    docs = spark.createDataFrame([(i, "big" if i % 10 else None, i) for i in range(4000)], "doc_id long, source string, rate int")
    docs = docs.select("*", F.lit("x").alias("_copy"), F.lit(1).alias("key"), F.lit(2).alias("_source"))
    out = O8.replicate(docs)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    share = math.sqrt(400) / (math.sqrt(400) + math.sqrt(3600))
    assert abs(n[None] - 4000 * share) < 150 and abs(n["big"] - 4000 * (1 - share)) < 150
    assert out.columns == [*docs.columns, "__copy", "_copies", "_key"] and {r["_copy"] for r in out.select("_copy").collect()} == {"x"}
    again = O8.replicate(docs.repartition(7))
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    keys = [r["_key"] for r in out.collect()]
    assert keys == sorted(keys)
    given = O8.replicate(docs, {"big": 1.0})
    assert {r["source"] for r in given.select("source").distinct().collect()} == {"big"}


def test_poisson_counts(spark):
    u = spark.range(20000).select(O8.uniform(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("u"))
    for rate in (0.3, 2.5, 40.0):
        m, v = u.select(O8.poisson_quantile(F.col("u"), F.lit(rate), 200).alias("k")).agg(F.avg("k"), F.var_pop("k")).first()
        assert abs(m - rate) < 0.05 * rate + 0.02 and abs(v - rate) < 0.1 * rate + 0.02


def test_a_tiny_source_beside_a_large_corpus(spark):
    """One row with rate 1,000,001 / (1 + 1,000) = 999 or more, and rows of one source that many sources make rare."""
    docs = spark.range(1_000_001).select(F.col("id").alias("doc_id"), F.when(F.col("id") > 0, "big").alias("source"))
    n = {r["source"]: r["count"] for r in O8.replicate(docs).groupBy("source").count().collect()}
    rate = 1_000_001 / 1001
    assert abs(n[None] - rate) < 6 * math.sqrt(rate) and abs(n["big"] - 1_000_000 * rate / 1000) < 6000


def test_poisson_counts_of_any_rate(spark):
    keys = spark.range(2000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("k"))
    for rate in (599.0, 601.0, 1255.0, 5000.0):
        m, v = keys.select(O8.poisson_count(F.col("k"), F.lit(rate)).alias("n")).agg(F.avg("n"), F.var_pop("n")).first()
        assert abs(m - rate) < 6 * math.sqrt(rate / 2000) and abs(v - rate) < 0.2 * rate


def plain_licence(text):
    low = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
    gap = "[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    words = [w for w in re.split(gap, low) if w]
    at = [(i, label) for p, label in O10.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    base = {label for _, label in at}
    more, share = set(), 0.0
    for label, t in O10.TEMPLATES:
        size, t = 2 * len(t.split()), set(t.split())
        for i in range(max(1, len(words) - size + 1)):
            n = len(set(words[i : i + size]) & t)
            if n >= math.ceil(0.8 * len(t) - 1e-9):
                more.add(label)
                share = max(share, n / len(t))
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if at else share


def test_licences(spark):
    t = dict(reversed(O10.TEMPLATES))
    texts = [
        None, "", "Under the MIT license. under the mit licenseunder the mit license", "under the mit license under the mit license cc by nc", "Apache License, Version 2.0 apache license version 2 x",
        "a\n" + t["mit"].upper() + " extra", " ".join(t["bsd"].split()[:-6]), " ".join(t["gpl"].split()[3:]), "\u00e9t\u00e9 CC-BY-NC \u4e2d under_the_mit_license", "word " * 3000,
    ]
    docs = spark.createDataFrame([(i, x, "e") for i, x in enumerate(texts)] + [(None, texts[3], "e"), (3, texts[3], "e")], "doc_id long, text string, score string")
    got = Counter(tuple(r) for r in O10.scan(docs).collect())
    assert got == Counter((r["doc_id"], *plain_licence(r["text"])) for r in docs.collect())


def test_licences_across_line_breaks(spark):
    heads = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal",
        "apache-2": "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain",
        "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
        "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by",
    }
    # Before the notice stand 0 to 60 words, so that it begins at every place of a run; one word a line; and words too far apart.
    texts = [("line\n" * n + h, label) for label, h in heads.items() for n in (0, 1, 22, 23, 24, 45, 46, 60)] + [("\n".join(h.split()), label) for label, h in heads.items()]
    texts += [("\n".join((w + " pad" * 60) for w in heads["mit"].split()), ""), ("\n\n", ""), ("\n".join(heads["mit"].split()[:9]), "")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in O10.scan(docs).collect()}
    assert [rows[i]["labels"] for i in range(len(texts))] == [label for _, label in texts]
    assert all(rows[i]["score"] >= 0.8 for i, (_, label) in enumerate(texts) if label)


def test_scattered_words_make_no_licence(spark):
    """Words of a notice 200 apart, on one line or on many; a notice inside a long line, at every place of a stretch; twice the words between is too far."""
    gpl = dict(reversed(O10.TEMPLATES))["gpl"].split()
    pad = lambda k: [f"p{i % 9}" for i in range(k)]
    far = [w for x in dict.fromkeys(gpl) for w in (x, *pad(199))]
    texts = [(" ".join(far), ""), ("\n".join(" ".join(far[i : i + 10]) for i in range(0, len(far), 10)), "")]
    texts += [(" ".join([*pad(k), *gpl, *pad(500)]), "gpl") for k in range(0, 200, 13)]
    texts += [(" ".join(w for x in gpl for w in (x, "pad")), "gpl"), (" ".join(w for x in gpl for w in (x, "pad", "pad", "pad")), ""), (" ".join(gpl * 40), "gpl")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in O10.scan(docs).collect()}
    assert [rows[i]["labels"] for i in range(len(texts))] == [label for _, label in texts]
    assert [tuple(rows[i]) for i in rows] == [(i, *plain_licence(texts[i][0])) for i in rows]


def test_hosts_of_many_labels(spark):
    urls = [(1, f"http://{'a.' * 16_000}example.org/es/x"), (2, f"http://{'a.' * 16_000}net/"), (3, "http://" + "x" * 100_000 + ".com/de/" + "y" * 100_000), (4, "http://....org/es/"), (5, "http://example.org./es/")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in O7.judge(spark.createDataFrame(urls, "page_id long, url string"), O7.rules_frame(spark)).collect()}
    assert got == {i: plain_verdict(u)[2:] for i, u in urls}


def test_vectors_that_share_an_id_equal_their_sql(spark):
    """Two vectors of one vec_id, one of them a copy of another's; chains over shared ids."""
    import duckdb

    from murmur.llm import op3_near_vectors as O3

    e = lambda *x: [float(v) for v in x]
    data = [(1, e(1, 0, 0)), (5, e(1, 0, 0)), (5, e(0, 1, 0)), (7, e(0, 1, 0.01)), (9, e(0, 0, 1)), (9, e(1, 1, 1)), (11, e(1, 1, 1)), (12, e(0, 0, 1)), (12, None), (13, e(0, 0, 0)), (14, e(-1, 0, 0)), (14, e(-1, 0, 0))]
    got = sorted((r["vec_id"], r["component_id"]) for r in O3.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect())
    con = duckdb.connect()
    con.execute("create table embeddings(vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", data)
    want = con.execute(f"select vec_id, component_id from ({O3.ORACLE})").fetchall()
    # The SQL has one row for each vec_id; a vector that takes no part is its own component, whatever its vec_id.
    assert {x for x in got} == {x for x in want} | {(12, 12)}


@pytest.mark.parametrize("name", ["op1_secrets", "op3_near_vectors", "op4_substrings", "op6_jaccard", "op7_url_filters", "op8_mixing", "op9_topk", "op10_licenses", "op11_divergence", "op13_warc"])
def test_query_equals_sql(spark, sf_dir, name):
    import duckdb

    from murmur.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = queries()[name](spark, sf_dir)
    res = con.execute(oracle_sql()[name])
    names = [c[0] for c in res.description]
    show = lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v)
    want = sorted(tuple(show(r[names.index(c)]) for c in sorted(names)) for r in res.fetchall())
    assert sorted(tuple(show(r[c]) for c in sorted(names)) for r in df.collect()) == want
