import re

import pytest
from pyspark.sql import functions as F

from murmur import models as M
from murmur.functions import numbers as N
from murmur.functions import rules as R
from murmur.functions import text as T
from murmur.functions.rules import Names
from murmur.plans import documents as D


def apply(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    "f, text, want",
    [
        (T.slugify, "Nr. 7: Bread & Butter!", "nr-7-bread-butter"),
        (T.slugify, "!! lead", "-lead"),
        (T.stamp_seconds, "[2:05] x", 125),
        (T.stamp_seconds, "[1:02:03 | Ana] x", 3723),
        (T.stamp_seconds, "x [1:00]", -1),
        (T.content, "[1:02 | Ana Li]  hello", "hello"),
        (T.format_seconds, "59.9", "0:59"),
        (T.format_seconds, "3723", "1:02:03"),
        (T.normalize_fractions, "2 and a half or 1 and three quarters", "2½ or 1¾"),
        (T.normalize_temperatures, "at 90 degrees F or 30 degree centigrade or 5 degrees", "at 90°F or 30°C or 5°"),
        (T.normalize_percent, "20 percent", "20%"),
        (T.normalize_units, "2 Tablespoons and a liter", "2 tbsp and a L"),
        (T.spoken_urls, "go to a b c dot org now", "go to abc.org now"),
        (T.spoken_urls, "a b", "a b"),
        (T.spoken_dots, "www dot x dot com", "www.x.com"),
        (T.normalize_punctuation, "What?? No!!! Ok..", "What? No! Ok."),
        (T.strip_disfluencies, "well, um, the earth uh-huh", "well,  the earth uh-huh"),
        (T.dedup_stutter, "The the THE we'll we'll go", "The we'll go"),
        (T.phrase_stutter, "before we before we go", "before we go"),
        (T.letter_stutter, "f floral and a apple", "floral and a apple"),
        (T.its_stutter, "it's a it's good", "it's good"),
        (T.strip_phone_numbers, "Call 718-497-2128, that's 7184972128. Bye", "Call Bye"),
        (T.clean_sentence, "So, like, basically it works.", "It works."),
        (T.clean_sentence, "Do you know it", "Do you know it"),
        (T.clean_sentence, "It is, you know, fine", "It is fine"),
        (T.clean_sentence, "The problem is, heat", "Problem is heat"),
        (T.clean_sentence, "I mean it works", "I mean it works"),
        (T.clean_sentence, "I mean, uh,", ""),
        (T.clean_sentence, "so it goes", "it goes"),
        (T.clean_sentence, "That is good, right? Yes", "That is good.Yes"),
        (T.clean_sentence, "Is that right?", "Is that right?"),
        (T.strip_lexical_fillers, "I mean, it is kind of good", "It is good"),
        (T.strip_lexical_fillers, "I think so", "I think so"),
        (T.strip_lexical_fillers, "if you know the way", "if you know the way"),
    ],
)
def test_functions(spark, f, text, want):
    assert apply(spark, f, text) == want


def fixpoint(pattern, text):
    while (new := re.sub(pattern, r"\1", text, flags=re.IGNORECASE)) != text:
        text = new
    return text


def test_stutters_to_the_fixpoint(spark):
    """As the reference: one collapse after another until nothing changes."""
    phrases = ["Thank you", "one two three", "go on and on", "a b c d"]
    texts = [f"x {' '.join([p] * n)} y" for p in phrases for n in (2, 9, 40, 59, 200)] + ["", "no repeats here", "thank  you thank you\nthank you " * 12, None]
    words = ["a a'b a'b'c a'b'c'd a'b'c'd'e a'b'c'd'e'f a'b'c'd'e'f'g", "The the " * 40, "", None]
    for f, pattern, ts in ((T.phrase_stutter, r"\b(\w+(?:\s+\w+){1,3})\s+\1\b", texts), (T.dedup_stutter, r"\b((?:\w|')+)\s+\1\b", texts + words)):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "i int, t string")
        got = [r["o"] for r in df.select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]
        assert got == [t if t is None else fixpoint(pattern, t) for t in ts]


def test_denoise2_collapses_long_runs(spark):
    docs = spark.createDataFrame([(1, "[0:45] We bake bread " + "thank you " * 40 + "with salt.")], "doc_id long, text string")
    assert D.denoise2(docs).first()["text"].lower().count("thank you") == 1


@pytest.mark.parametrize(
    "text, out, kept",
    [
        ("Well, it works", "It works", False),
        ("It is, like, salt", "It is,, salt", False),
        ("We like salt", "We like salt", False),
        ("We like salt but", "We like salt but", True),
        ("It actually works", "It works", False),
        ("Don't bake", "Don't bake", True),
        ("Ask Ana Baker", "Ask Ana Baker", True),
        ("It is not", "It is not", False),
        ("Let me just tell you know what", "Know what", False),
        ("Do by the way you know it", "Do it", False),
        ("or something like, that", "like, that", False),
        ("bread or something like that", "bread", False),
        ("", "", False),
    ],
)
def test_parsed_sentences(spark, text, out, kept):
    df = M.map_model(spark.createDataFrame([(text,)], "t string"), "t", "p", M.keyword_parser, M.PARSE)
    df = df.withColumn("o", T.strip_parsed_fillers(F.col("t"), F.col("p.tokens")))
    assert tuple(df.select("o", T.keep_turn(F.col("o"), F.col("p"))).first()) == (out, kept)


def test_nulls_stay_null(spark):
    for f in (T.slugify, T.content, T.normalize_units, T.strip_disfluencies, T.sentences):
        assert spark.createDataFrame([(None,)], "t string").select(f(F.col("t")).alias("o")).first()["o"] is None


@pytest.mark.parametrize("text, want", [("Yeah.", None), ("And so", None), ("Welcome back to it.", None), ("Bread rises.", "Bread rises."), ("the example hour", None)])
def test_keep_sentence(spark, text, want):
    assert apply(spark, lambda c: T.keep_sentence(c, Names()), text) == want


def test_noise_in_a_long_sentence_is_cut_out(spark):
    long = "We call in and " + " ".join(f"w{i}" for i in range(30))
    assert apply(spark, lambda c: T.keep_sentence(c, Names()), long) == long.replace("call in ", "")


def test_sentences(spark):
    assert apply(spark, T.sentences, 'One. Two? "Three" four! five. 6') == ["One.", "Two?", '"Three" four! five.', "6"]
    assert apply(spark, T.sentences_v2, "One. and two. buts three") == ["One.", "and two. buts three"]


@pytest.mark.parametrize(
    "text, want",
    [("sixty three eggs", "63 eggs"), ("two hundred five, ok", "205, ok"), ("a hundred eggs", "a hundred eggs"), ("one million two thousand three", "1002003"),
     ("two thousand three thousand", "two thousand 3000"), ("a  b\nc", "a b c"), ("", ""), ("one two three", "5"), ("hundred five", "500"), ("one two three four five", "1"),
     ("thousand five", "thousand 5"), ("million thousand", "million thousand"), ("five million thousand six", "five million thousand 6"), ("sevenx one twox", "sevenx 1 twox"),
     ("one  hundred, thousand million two.", "one hundred, thousand million 2."), ("a hundred and Twenty three!", "a hundred and 23!"), ("thousand", "thousand"), ("twenty-one two", "twenty-one 2")],
)
def test_numbers(spark, text, want):
    assert apply(spark, N.normalize_numbers, text) == want


@pytest.mark.parametrize("text, want", [("seven one Eight now", "718 now"), ("one day", "one day"), ("sixty three", "sixty three"), ("one two threex", "12 threex"), ("\ue000 one\n two \ue000", "\ue000 12 \ue000")])
def test_digits(spark, text, want):
    assert apply(spark, N.collapse_spoken_digits, text) == want


def plain_numbers(text):
    """As the definition goes: from left to right, a run's value or one word that stays."""
    values = {w: i for i, w in enumerate(R.DIGIT_WORDS + R.TEEN_WORDS)} | {w: 20 + 10 * i for i, w in enumerate(R.TENS_WORDS)} | R.MULTIPLIERS

    def section(v):
        if len(v) in (3, 4):
            return v[0] * v[1] + sum(v[2:])
        return v[0] * v[1] if len(v) == 2 and 100 in v else sum(v) if len(v) == 2 else v[0]

    def number(ws):
        v = [values[w] for w in ws]
        if v.count(1000) > 1 or v.count(10**6) > 1 or len(v) == 1 and ws[0] in R.MULTIPLIERS:
            raise ValueError
        if 1000 in v and 10**6 in v and v.index(1000) < v.index(10**6):
            raise ValueError
        if len(v) == 1:
            return v[0]
        total = 0
        for scale in (10**6, 1000):
            if scale in v:
                i = v.index(scale)
                total += section(v[:i]) * scale
                v = v[i + 1 :]
        return total + (section(v) if v else 0)

    words, out, i = text.split(), [], 0
    bare = [w.lower().rstrip(".,!?;:") for w in words]
    while i < len(words):
        j = i
        while j < len(words) and bare[j] in values:
            j += 1
        try:
            if i == j:
                raise ValueError
            out.append(f"{number(bare[i:j])}{words[j - 1][len(words[j - 1].rstrip('.,!?;:')):]}")
            i = j
        except (ValueError, IndexError):
            out.append(words[i])
            i += 1
    return " ".join(out)


def test_numbers_equal_the_definition(spark):
    """All runs of up to three words of a small table, and longer ones by chance."""
    from itertools import product
    from random import Random

    few = ["one", "twenty", "hundred", "thousand", "million", "x"]
    r = Random(1)
    texts = [" ".join(w) for n in (1, 2, 3, 4) for w in product(few, repeat=n)]
    texts += [" ".join(r.choice(["seven", "Nineteen,", "fifty", "hundred", "thousand.", "million", "zero"]) for _ in range(r.randint(5, 9))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", N.normalize_numbers(F.col("t")).alias("o"))
    assert [x["o"] for x in df.orderBy("i").collect()] == [plain_numbers(t) for t in texts]


def test_gates(spark):
    n = Names(preroll=("food",))
    paras = ["[0:40] Yeah.", "[1:00] Thank you for listening", "[1:00] You're listening to it on example radio", "[1:00] sponsored by x", "[0:10] hello", "[0:10] food", "no stamp", "[0:40] Yeah, well"]
    df = spark.createDataFrame([(p,) for p in paras], "t string")
    assert [r["t"] for r in df.where(T.passes_gates(F.col("t"), n)).collect()] == ["[0:10] food", "no stamp", "[0:40] Yeah, well"]


def test_no_content_dropped(spark):
    df = spark.createDataFrame([("the licen is impossi", "the license is impossible"), ("bread rises slowly", "bread rises")], "o string, c string")
    assert [r[0] for r in df.select(T.no_content_dropped(F.col("o"), F.col("c"))).collect()] == [True, False]


def test_documents(spark):
    text = "[0:40] Yeah.\n\n[0:45] So, uh, we bake sixty three loaves at 200 degrees F. Got it.\n\n[0:50] Call seven one eight four nine seven two one two eight."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert D.denoise(docs).first()["text"] == "[0:45] So, uh, we bake sixty three loaves at 200 degrees F. Got it.\n\n[0:50] Call."
    assert D.strip_fillers_rendered(docs).first()["text"].startswith("We bake 63 loaves at 200°F.\n\nCall ")
    out = D.denoise2(docs).first()["text"]
    assert "bake 63 loaves at 200°F." in out and "uh" not in out


def test_sentence_dedup_keeps_the_longest(spark):
    text = "[0:40] food tastes good with salt.\n\n[0:45] food tastes good with salt.\n\n[0:50] other words are here now."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert D.denoise2(docs, threshold=0.999).first()["text"].count("\n\n") == 1


def test_documents_of_which_nothing_is_left(spark):
    from murmur.plans import documents as D

    docs = spark.createDataFrame([(1, "[0:40] Yeah."), (2, "")], "doc_id long, text string")
    for clean in (D.strip_fillers_rendered, D.denoise, D.denoise2):
        assert sorted(tuple(r) for r in clean(docs).collect()) == [(1, ""), (2, "")]


def test_guarded_correction_equals_the_rule(spark):
    from random import Random

    r = Random(3)
    words = ["bread", "Bread", "breads", "salt", "kneading", "knead", "a", "oven,", "\u00e9t\u00e9s", "x"]
    pairs = [("", ""), ("a", ""), ("", "a"), ("long " * 400, "long " * 399 + "song")]
    for _ in range(400):
        t = [r.choice(words) for _ in range(r.randint(1, 12))]
        c = [w if r.random() < 0.9 else r.choice(words) for w in t if r.random() < 0.95]
        pairs.append((" ".join(t), " ".join(c)))
    answers = dict(pairs)
    df = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(answers.items())] + [(-1, None, None)], "i int, t string, c string")
    got = {x["i"]: x["o"] for x in M.guarded_correction(df, "t", "o", lambda: lambda xs: [answers.get(x) for x in xs]).collect()}
    assert got == {i: c if M.accepts(t, c) else t for i, (t, c) in enumerate(answers.items())} | {-1: None}


def test_hints_never_decide(spark, monkeypatch):
    """Rules behind hints give what they give without, also for the characters outside ASCII that are cases of ASCII letters."""
    import random

    r = random.Random(3)
    words = ["it's", "it", "right?", "you know", "Youİ", "rİght?", "I mean,", "ı mean", "by the way", "very", "BASICALLY", "baſically", "uh", "éuh", "a-um", "er.", "over", "5", "degrees", "C", "percent"]
    words += ["teaſpoons", "2 and a half", "ounces", "dot", "a", "b", "c", "", "pain in the ass", "some of them", "!!", "..", ",", "  ", " ", "\n", "like", "wor wor", "don't 't", "example radio", "thank our sponsors", "Kilograms"]
    texts = [(i, r.choice(["", ", ", " "]) + " ".join(r.choices(words, k=r.randint(1, 12))) + r.choice(["", " ", "."])) for i in range(600)]
    df = spark.createDataFrame(texts, "i int, t string").repartition(4)
    both = lambda: df.select("i", T.clean_sentence(F.col("t")).alias("a"), T.after_numbers(F.col("t")).alias("b"), T.tidy(F.col("t")).alias("c"), F.col("t").rlike(R.java(R.noise(R.Names()))).alias("d"))
    got = {x["i"]: x for x in both().collect()}
    monkeypatch.setattr(T, "if_any", lambda c, hints, body: T.let(c, body))
    monkeypatch.setattr(R, "EDGE", "")
    monkeypatch.setattr(R, "DISFLUENCY_HINT", "")
    monkeypatch.setattr(T, "trim", lambda c: T._sub(c, r"^\s++|(?<!\s)\s++$", ""))
    monkeypatch.setattr(R, "noise", lambda names: R.CALL_IN + "|" + R.intro(names))
    want = {x["i"]: x for x in both().collect()}
    assert got == want and len({x["a"] for x in want.values()}) > 300


def test_text_queries_spread_and_clean_once(spark, sf_dir):
    """Costly functions of a file with one row group run in many tasks, and no filter computes them a second time."""
    from murmur.plans import registry

    for name in ("clean_sentence", "strip_fillers"):
        assert registry.queries()[name](spark, sf_dir).rdd.getNumPartitions() > 1
    plan = registry.queries()["strip_fillers_rendered"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("tablespoon") > 0 and not [x for x in plan.split("\n") if "Filter" in x and "tablespoon" in x]


def test_second_cleaner_looks_for_strings_before_patterns(spark):
    texts = [
        "You know what I mean, I THINK so.", "It was K\u0131nd of it , sort  of ; \u212aind of", ",; leading", "no such thing", "", "  two  spaces .", "like, well, it's it.", "It's a it's here",
        "i mean it", "or something like that", "caught by  the way !", "Actually, okay, like, this", "call 555-123-4567 , . now", "That's 555.123.4567, ok ,  .", "\u0665\u0665\u0665\u0661\u0662\u0663\u0664\u0665\u0666\u0667 x",
        "--- a1 \u00e9 -b- \u2003 9", "-" * 5000, "You are listening to the Example Radio now", "SPON\u017fORED BY us", "brought to you by x", "I'm Ana of here", "\u0130'm like, it'\u017f foo it's",
    ]
    df = M.map_model(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "p", M.keyword_parser, M.PARSE)
    c = F.col("t")
    clean = lambda x: T.let(T.dedup_stutter(T._subs(x, [R.ITS_STUTTER, R.ITS_IT])), lambda y: T.recapitalize(y, c))
    bare = lambda x: clean(T._sub(T._sub(T._sub(T.trim(T._sub(x, T._filler_pattern(), "")), r" {2,}", " "), r" ([.,!?;:])", "$1"), r"^[,;:\s]+", ""))
    phone = T._sub(T._sub(c, R.PHONE_REPEAT, "", ignore_case=False), R.PHONE, "", ignore_case=False)
    phone = T.trim(T._sub(T._sub(T._sub(phone, r",\s*\.", "."), r" {2,}", " "), r" ([.,])", "$1"))
    words = F.size(F.filter(F.split(T.trim(c), R.java(r"\s+"), -1), lambda w: w.rlike("[a-zA-Z0-9]")))
    names = Names()
    pairs = [
        (T.strip_lexical_fillers(c), bare(c)), (T.its_stutter(c), T._subs(c, [R.ITS_STUTTER, R.ITS_IT])), (T.strip_phone_numbers(c), phone), (T.alnum_words(c), words),
        (T.is_bumper(c, names), c.rlike(R.java(R.bumper(names)))), (T.is_sponsor(c), c.rlike(R.java(R.SPONSOR))),
    ]
    for r in df.select("t", *[F.struct(a.alias("a"), b.alias("b")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).collect():
        assert all(x["a"] == x["b"] for x in r[1:]), r
    # The costly patterns stand behind a look for strings.
    plan = df.select(T.strip_parsed_fillers(c, F.col("p.tokens")))._jdf.queryExecution().analyzed().toString()
    assert re.search(r"(?i)contains\(.{1,80}guess\)", plan)


def test_models_answer_in_arrow(spark):
    df = spark.createDataFrame([("Well, it is not so.", 1), (None, None), ("", 3)], "t string, n long")
    out = M.map_model(df.where("t is not null"), "t", "p", M.keyword_parser, M.PARSE)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["t"], r["n"], tuple(x["text"] + x["ws"] for x in r["p"]["tokens"])) for r in out.collect()} == {("Well, it is not so.", 1, ("Well", ", ", "it ", "is ", "not ", "so", ".")), ("", 3, ())}
    assert [tuple(r) for r in M.map_model(df, "n", "m", lambda: lambda xs: [None if x is None else x * 0.5 for x in xs], "double").select("n", "m").orderBy("n").collect()] == [(None, None), (1, 0.5), (3, 1.5)]
