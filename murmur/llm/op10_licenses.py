"""License scans: phrases, and an exact set-similarity join of text blocks with templates.

Native: DataFrame functions only.

*Base*: places where the words of a phrase stand consecutively, counted in a normal form in which
each word has a space on both sides, so that neighbouring places do not share one.

*Join*: a block is a run of consecutive words of the text, whatever its lines, of at most ``REACH`` times as many words as a template has.  A
template's label goes to every text that has a block with at least ``THRESHOLD`` of the template's distinct words: notices
are found however they are wrapped or whatever stands around them, and words scattered over a long text make none.

A text is searched only if it holds, as a whole, enough words of some template.  It is cut into stretches of twice the longest block,
one beginning every such length, so that any block lies whole inside one.  Tokens are ordered by their frequency over
all stretches, rarest first, and only words of templates matter:

* length filter: a stretch needs as many template words as the smallest template requires;
* prefix filter: a stretch that reaches the threshold holds one of the first
  ``size - required + 1`` words of the template, an equi-join on words;
* positional filter: the words after that one, on either side, must suffice for the rest;
* verification: the exact intersection of the template with each block of its length inside the stretch.

Defined cases: a null text is empty (no words, no labels, score 0); very long texts are searched whole, and a text shorter than a block is one; of several
blocks the one with the largest share counts, and ties of templates give all their labels; rows that repeat are judged alike and
come back as often as they came; a null doc_id stays null; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import Scratch, maybe_broadcast, table

PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Sentences of well-known licence notices.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("cc-by", "this work is licensed under a creative commons attribution international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]
#: Words of a block for each word of its template.
REACH = 2
THRESHOLD = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words and gaps of the lower-cased text; upper-case letters count as words before lower-casing.
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _GAP, -1), lambda w: w != "")


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def base(docs: DataFrame, phrases=PHRASES) -> DataFrame:
    """doc_id, key, n_words, n_base, first_word, last_word, base (array of labels)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    loose = "|".join(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in p.split()) for p, _ in phrases)
    rows = docs.select(
        "doc_id", F.md5(text).alias("key"), F.regexp_count(text, F.lit(_WORD_ANY_CASE)).cast("long").alias("n_words"),
        F.when(text.rlike(loose), F.concat(F.lit(" "), F.array_join(words(text), "  "), F.lit(" "))).alias("norm"),
    )
    count, first, last, labels = [], [], [], []
    for phrase, label in phrases:
        ws = phrase.split()
        p = " " + "  ".join(ws) + " "
        n = ((F.length("norm") - F.length(F.replace("norm", F.lit(p), F.lit("")))) / len(p)).cast("long")
        n = F.coalesce(n, F.lit(0).cast("long"))
        count.append(n)
        first.append(F.when(n > 0, (_spaces(F.substring_index("norm", p, 1)) / 2).cast("long")))
        last.append(F.when(n > 0, F.col("n_words") - (_spaces(F.substring_index("norm", p, -1)) / 2).cast("long") - len(ws)))
        labels.append(F.when(n > 0, F.lit(label)))
    total = sum(count[1:], count[0])
    return rows.select(
        "doc_id", "key", "n_words", total.alias("n_base"),
        F.array_min(F.array_compact(F.array(*first))).alias("first_word"),
        F.array_max(F.array_compact(F.array(*last))).alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"),
    )


def stretches(docs: DataFrame, sets: list[tuple[str, list[str], int]], need: list[int], longest: int) -> DataFrame:
    """(key, line, block, tokens) of texts that hold enough words of some template: block has the words, tokens those of templates."""
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for _, s, _ in sets for w in s})])
    split = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("key"), words(F.coalesce(F.col("text"), F.lit(""))).alias("words"))
    whole = F.array_intersect("words", vocabulary)
    enough = [F.size(F.array_intersect("held", F.array(*map(F.lit, s)))) >= k for (_, s, _), k in zip(sets, need)]
    some = split.select("key", "words", whole.alias("held")).where(F.size("held") >= min(need)).where(reduce(lambda a, b: a | b, enough))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words"), F.lit(1)) - 1, F.lit(longest))
    cut = some.select("key", F.posexplode(F.transform(starts, lambda i: F.slice("words", i + 1, F.lit(2 * longest)))).alias("line", "block"))
    return cut.withColumn("tokens", F.array_intersect("block", vocabulary)).where(F.size("tokens") >= min(need))


def matches(docs: DataFrame, scratch: Scratch, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, label, share) of every text with a block that meets a template."""
    spark = docs.sparkSession
    sets = [(label, sorted(set(t.split())), REACH * len(t.split())) for label, t in templates]
    need = [math.ceil(threshold * len(s) - 1e-9) for _, s, _ in sets]
    vocabulary = sorted({w for _, s, _ in sets for w in s})
    blocks = scratch.write(stretches(docs, sets, need, max(n for _, _, n in sets)), "blocks")
    freq = blocks.select(F.explode("tokens").alias("w")).groupBy("w").count()
    df = {r["w"]: r["count"] for r in freq.collect()}  # at most the words of the templates
    order = sorted(vocabulary, key=lambda w: (df.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    prefix = []
    for i, ((label, s, n), k) in enumerate(zip(sets, need)):
        s = sorted(s, key=rank.get)
        prefix += [(s[p], label, i, s, n, k, p) for p in range(len(s) - k + 1)]
    t = spark.createDataFrame(prefix, "w string, label string, tid int, template array<string>, reach int, need int, tpos int")
    t = maybe_broadcast(t, len(prefix), 1024)
    ranked = F.array_sort(F.transform("tokens", lambda w: F.struct(F.array_position(F.array(*map(F.lit, order)), w).alias("r"), w.alias("w"))))
    probe = blocks.select("key", "line", "block", F.transform(ranked, lambda x: x["w"]).alias("tokens"))
    probe = probe.select("key", "line", "block", F.size("tokens").alias("size"), F.posexplode("tokens").alias("bpos", "w"))
    hit = probe.join(t, "w").where((F.col("size") >= F.col("need")) & (F.least(F.size("template") - F.col("tpos"), F.col("size") - F.col("bpos")) >= F.col("need")))
    # The first common word decides the positional filter, later ones can only be weaker: any that passes keeps the pair.
    pairs = hit.select("key", "line", "label", "tid", "template", "reach", "need", "block").dropDuplicates(["key", "line", "tid"])
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("block") - F.col("reach") + 1))
    n = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("block", i, F.col("reach")), F.col("template")))))
    best = pairs.select("key", "label", "need", n.alias("n"), F.size("template").alias("of"))
    return best.where("n >= need").groupBy("key", "label").agg(F.max(F.col("n") / F.col("of")).alias("share"))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "licenses")
    found = matches(docs, scratch, templates, threshold).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    # Written, so that both sides of the join are plain exchanges: a text with very many copies can be split.
    found = scratch.write(found, "labels")
    rows = base(docs, phrases).join(found, "key", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _oracle() -> str:
    low = "string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    ws = f"list_filter({low.format('t')}, lambda w: w <> '')"
    places = ", ".join(
        f"list_transform(list_filter(range(len(w)), lambda i: array_to_string(w[i+1:i+{len(p.split())}], ' ') = '{p}'), lambda i: {{'at': i, 'label': '{label}'}})" for p, label in PHRASES
    )
    temps = ", ".join(f"('{label}', {sorted(set(t.split()))!r}, {math.ceil(THRESHOLD * len(set(t.split())) - 1e-9)}, {REACH * len(t.split())})" for label, t in TEMPLATES)
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, doc_id, {ws} as w from d),
p as (select rid, doc_id, len(w) as n_words, list_concat({places}) as p from w),
tm(label, words, need, reach) as (values {temps}),
c as (select rid, label, w, words, need, reach from w join tm on len(list_intersect(w, words)) >= need),
b as (select rid, label, words, need, w[i:i + reach - 1] as block from (select *, unnest(range(1, greatest(len(w) - reach + 1, 1) + 1)) as i from c)),
m as (select rid, label, max(len(list_intersect(list_distinct(block), words)) / len(words)) as share from b where len(list_intersect(list_distinct(block), words)) >= need group by rid, label),
mm as (select rid, list(label) as more, max(share) as share from m group by rid)
select doc_id, n_words, len(p) as n_base, list_min(list_transform(p, lambda x: x.at)) as first_word, list_max(list_transform(p, lambda x: x.at)) as last_word,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda x: x.label), coalesce(more, [])))), ',') as labels,
  case when len(p) > 0 then 1.0::double else coalesce(share, 0.0::double) end as score
from p left join mm using (rid)
"""


ORACLE = _oracle()
