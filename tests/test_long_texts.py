"""No text, however long its words and runs, may recurse or take quadratic time."""

import pytest
from pyspark.sql import functions as F

from murmur.functions import text as T
from murmur.functions.rules import Names

N = 1_000_000
TEXTS = {
    "one word": ("x" * N, None), "we": ("we " * 100_000, "we "), "so": ("so " * 100_000, None), "letters": ("a " * 500_000, None), "spaces": ("a" + " " * (N // 4) + "b" + " " * (N // 4) + ".", None),
    "dots": ("." * N, None), "thanks": ("thank you " * 50_000, None), "fillers": ("you know, " * 50_000, None), "commas": (", " * 250_000, None), "base64": ("aGVsbG8/d29ybGQ+" * 60_000, None), "sentences": ("Yes. No! " * 50_000, None),
}
FUNCTIONS = [
    T.slugify, T.stamp_seconds, T.content, T.paragraphs, T.spoken_urls, T.normalize_punctuation, T.strip_disfluencies, T.dedup_stutter, T.letter_stutter, T.phrase_stutter, T.its_stutter,
    T.strip_phone_numbers, T.sentences, T.sentences_v2, T.clean_sentence, T.strip_lexical_fillers, T.alnum_words, T.after_numbers, lambda c: T.strip_filler_sentences(c, Names()), lambda c: T.passes_gates(c, Names()),
]


@pytest.mark.parametrize("k", range(len(FUNCTIONS)))
def test_long_words_and_runs(spark, k):
    df = spark.createDataFrame([(n, t) for n, (t, _) in TEXTS.items()], "n string, t string")
    assert df.select("n", F.hash(FUNCTIONS[k](F.col("t"))).alias("o")).where("o is not null").count() == len(TEXTS)


def test_runs_collapse_whole(spark):
    t = spark.createDataFrame([("we " * 100_000 + "go", "thank you " * 50_000 + "all", "So, " * 50_000 + "it works.", "w " * 3 + "dot " + "f n y c dot org")], "a string, b string, c string, d string")
    got = t.select(T.dedup_stutter(F.col("a")), T.phrase_stutter(F.col("b")), T.clean_sentence(F.col("c")), T.spoken_urls(F.col("d"))).first()
    assert tuple(got) == ("we go", "thank you all", "It works.", "www.fnyc.org")


def test_spaces_around_disfluencies(spark):
    t = spark.createDataFrame([(x,) for x in ("a  uh  uh , um,b", "uh x", "x   uh", " uh", "that's a-uh", "a,  you know  , b", "do you know", "x , you know", "you know you know it")], "t string")
    got = [tuple(r) for r in t.select(T.strip_disfluencies(F.col("t")), T._subs(F.col("t"), T.R.PARENTHETICALS)).collect()]
    assert [a for a, _ in got][:5] == ["a   b", "  x".replace("  ", " ", 1), "x ", " ", "that's a-uh"]
    assert [b for _, b in got][5:] == ["a  b", "do you know", "x  ", "  it"]
