import random

import pytest
from pyspark.sql import functions as F

from murmur.operators import intervals, segments as S

from .conftest import rows

SEG = "doc_id long, seg_idx long, start double, end double, text string, speaker string"


def segs(spark, data):
    return spark.createDataFrame([(d, i, float(s), float(e), t, w) for d, i, s, e, t, w in data], SEG)


def test_gap_is_inclusive_and_from_the_previous_end(spark):
    df = segs(spark, [(1, 0, 0, 5, "a", "x"), (1, 1, 5.5, 6, "b", "x"), (1, 2, 6.4, 7, "c", "y"), (2, 0, 0, 1, "d", "x")])
    assert rows(S.gap_segments(df).select("doc_id", "seg_idx", "para_idx")) == [(1, 0, 0), (1, 1, 1), (1, 2, 1), (2, 0, 0)]
    assert rows(S.gap_segments(df, 2.0).select("para_idx").distinct()) == [(0,)]


def test_render(spark):
    df = segs(spark, [(1, 0, 0, 1, " a ", "S1"), (1, 1, 1, 2, "b", "S2"), (1, 2, 3700, 3701, "c", "UNKNOWN")])
    assert S.render_document(df).first()["text"] == "[0:00] a b\n\n[1:01:40] c"
    assert S.render_document(df, diarized=True, names=["Ana"]).first()["text"] == "[0:00 | Ana] a b\n\n[1:01:40 | UNKNOWN] c"
    mapping = spark.createDataFrame([(1, "S1", "Old")], "doc_id long, speaker string, name string")
    assert S.render_document(df, diarized=True, mapping=mapping).first()["text"].startswith("[0:00 | Old]")
    assert S.render_document(df, diarized=True, names=["New"], mapping=mapping).first()["text"].startswith("[0:00 | New]")


def test_first_appearance_skips_unknown_and_leaves_surplus(spark):
    df = segs(spark, [(1, 0, 0, 1, "", "UNKNOWN"), (1, 1, 0, 1, "", "B"), (1, 2, 0, 1, "", "A"), (1, 3, 0, 1, "", "B")])
    assert rows(S.first_appearance_map(df, ["n1"])) == [(1, "A", 2, None), (1, "B", 1, "n1")]


def test_empty(spark):
    df = segs(spark, [])
    assert S.render_document(df).count() == 0 and S.first_appearance_map(df, ["a"]).count() == 0


@pytest.mark.parametrize("width", [None, 1.5])
def test_overlap_join_equals_a_plain_loop(spark, width):
    r = random.Random(5)
    interval = lambda: (s := r.randint(0, 30) / 2, s + r.randint(0, 8) / 2)
    seg = [(d, i, *interval()) for d in range(3) for i in range(20)]
    turn = [(d, i, *interval(), f"s{i}") for d in range(3) for i in range(12)]
    want = []
    for d, i, s, e in seg:
        best, who = 0, "UNKNOWN"
        for td, _, ts, te, name in turn:
            o = min(e, te) - max(s, ts)
            if td == d and o > best:
                best, who = o, name
        want.append((d, i, who))
    a = spark.createDataFrame(seg, "doc_id long, seg_idx long, start double, end double")
    b = spark.createDataFrame(turn, "doc_id long, turn_idx long, start double, end double, speaker string")
    got = intervals.overlap_join(a.withColumn("words", F.lit(1)), b, width=width)
    assert "words" in got.columns
    assert rows(got.select("doc_id", "seg_idx", "speaker")) == sorted(want, key=repr)


def test_nearest(spark):
    p = spark.createDataFrame([(1, 0.0), (1, 5.0), (2, 1.0)], "k long, at double")
    m = spark.createDataFrame([(1, 4.0, 7), (1, 6.0, 3), (1, 6.0, 9)], "k long, m double, o long")
    assert rows(intervals.nearest_join(p, m, "k", "at", "m", "o")) == [(1, 0.0, 4.0, 7), (1, 5.0, 6.0, 3), (2, 1.0, None, None)]
