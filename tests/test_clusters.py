"""Clusters of near vectors against the definition."""

from __future__ import annotations

import math
import random

import pytest

from murmur.operators.clusters import near_components


def plain(rows, threshold):
    """Components by comparing all rows of a scope."""
    def ok(v):
        return v is not None and any(v) and all(x is not None and math.isfinite(x) for x in v)

    def cosine(a, b):
        dot = sum(x * y for x, y in zip(a, b))
        return dot / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    comp = {(s, i): i for s, i, _ in rows}
    changed = True
    while changed:
        changed = False
        for s, i, v in rows:
            for t, j, w in rows:
                if s == t and s is not None and ok(v) and ok(w) and (v == w or cosine(v, w) >= threshold):
                    low = min(comp[s, i], comp[t, j])
                    changed |= comp[s, i] != low or comp[t, j] != low
                    comp[s, i] = comp[t, j] = low
    return comp


def made(seed):
    r, out = random.Random(seed), []
    for s, size in (("a", 90), ("b", 25), ("c", 3), ("d", 1)):
        centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(1 + size // 6)]
        for i in range(size):
            v = [x + r.gauss(0, 0.15) for x in r.choice(centres)]
            out.append((s, i * 3 + 1, out[-1][2] if i and r.random() < 0.2 else v))
    odd = [None, [0.0] * 6, [1.0, float("nan")], [1.0, None], [float("inf")], [], [1e200, 1e200], [2.0, 2.0, 0.0], [1e-200, 1e-200]]
    out += [("e", i, v) for i, v in enumerate(odd)] + [(None, 1, [1.0, 1.0]), (None, 2, [1.0, 1.0])]
    return out


@pytest.mark.parametrize("block", [None, 4])
@pytest.mark.parametrize("threshold", [0.97, 0.9, 0.3])
def test_equal_to_the_definition(spark, block, threshold):
    rows = made(int(threshold * 100))
    df = spark.createDataFrame(rows, "s string, i long, embedding array<double>").selectExpr("*", "1 as _v", "2 as component")
    got = near_components(df, "s", "i", threshold, block)
    assert got.columns == ["s", "i", "component"]
    usual = [x for x in rows if x[0] != "e"]
    found = {(s, i): c for s, i, c in got.collect()}
    want = plain(usual, threshold)
    assert {k: found[k] for k in want} == want and len(found) == len(rows)
    assert [found["e", i] for i in range(9)] == [0, 1, 2, 3, 4, 5, 6, 6, 6]


def test_copies_and_a_hot_scope(spark):
    """A third of the rows are one vector: they are one class, so nothing is squared."""
    df = spark.range(30_000).selectExpr(
        "0 as s", "id as i", "if(id % 3 = 0, array(1d, 0d, 0d), array(cos(id div 3 % 50), sin(id div 3 % 50), 5d * (id % 50))) as embedding"
    )
    got = near_components(df, "s", "i", 0.9999, 16)
    assert got.count() == 30_000 and got.where("i % 3 = 0 and component <> 0").count() == 0
    at = {i: c for _, i, c in got.where("i < 300").collect()}
    rows = [("x", r["i"], list(r["embedding"])) for r in df.where("i < 300").collect()]
    assert at == {i: c for (_, i), c in plain(rows, 0.9999).items()}


def test_empty(spark):
    assert near_components(spark.createDataFrame([], "s int, i long, embedding array<float>"), "s", "i").count() == 0


def test_a_task_hands_on_its_classes_once():
    """Where nothing is pruned a class visits half of all cells, but what leaves Python has one row for each class."""
    import numpy as np
    import pandas as pd

    from murmur.operators.clusters import _dealer

    r = np.random.default_rng(5)
    frame = lambda n, **names: pd.DataFrame({"_s": 1, "_c": 0, names["at"]: np.arange(n), names["of"]: list(r.normal(size=(n, 8)))})
    rows, pivots = frame(500, at="_i", of="_v"), frame(40, at="_p", of="_pv")
    for block in (64, 1000):
        out = _dealer(1.3, block)(rows, pivots)
        assert out["_i"].tolist() == rows["_i"].tolist() and len(out) == 500
        assert all(own in cells and max(cells) == own for own, cells in zip(out["_own"], out["_cells"]))
        assert out["_cells"].map(len).sum() > 5000
    assert len(_dealer(1.3, 64)(rows.iloc[:0], pivots)) == 0


def test_scopes_of_one_bundle_stay_apart():
    """One call takes many scopes, and links are found within each alone."""
    import pandas as pd

    from murmur.operators.clusters import _whole

    b = pd.DataFrame({"_s": ["b", "a", "b", "a", "c"], "_i": [7, 3, 2, 9, 1], "_v": [[1.0, 0.0], [1.0, 0.1], [1.0, 0.05], [0.0, 1.0], [1.0, 0.0]]})
    out = _whole(0.9)(b)
    found = {(s, tuple(v)): c for s, v, c in zip(out["_s"], out["_v"], out["component"])}
    assert found == {("b", (1.0, 0.0)): 2, ("b", (1.0, 0.05)): 2, ("a", (1.0, 0.1)): 3, ("a", (0.0, 1.0)): 9, ("c", (1.0, 0.0)): 1}
