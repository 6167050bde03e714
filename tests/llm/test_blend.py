import random

import numpy as np
import pytest

from caddis.llm.blend import blended_ranking

SCHEMA = "id string, a double, b double, c double, position int, _key string"


def brute(data):
    """Projection of average ranks on the first component, in plain numpy."""
    cols = []
    for j in (1, 2, 3):
        v = [r[j] for r in data]
        real = sorted(x for x in v if x is not None and x == x)
        rank = {x: (real.index(x) + len(real) - real[::-1].index(x) + 1) / 2 for x in set(real)}
        z = np.array([rank[x] if x is not None and x == x else np.nan for x in v])
        cols.append((z - np.nanmean(z)) / np.nanstd(z))
    cols[2] = -cols[2]
    r = np.eye(3)
    for i in range(3):
        for j in range(i):
            ok = ~np.isnan(cols[i]) & ~np.isnan(cols[j])
            r[i, j] = r[j, i] = np.corrcoef(cols[i][ok], cols[j][ok])[0, 1]
    w = np.linalg.eigh(r)[1][:, -1]
    w = w if w.sum() >= 0 else -w
    return np.nansum(np.array(cols).T * w, axis=1), w


def test_ranking_equals_brute_force(spark):
    rng = random.Random(4)
    data = []
    for i in range(200):
        x = rng.gauss(0, 1)
        data.append((f"k{i:03d}", None if i % 9 == 0 else float(round(x * 5)), None if i % 7 == 0 else x + rng.gauss(0, 1), float("nan") if i % 11 == 0 else -np.exp(3 * x + rng.gauss(0, 1)).item(), 0, "q"))
    df = spark.createDataFrame(data, SCHEMA)
    ranked, loadings = blended_ranking(df, "id", {"a": 1, "b": 1, "c": -1})
    want, w = brute(data)
    got = {r["id"]: r for r in ranked.collect()}
    for i, r in enumerate(data):
        some = any(x is not None and x == x for x in r[1:4])
        assert (got[r[0]]["projection"] is not None) == some
        if some:
            assert got[r[0]]["projection"] == pytest.approx(want[i], abs=1e-6)
    assert sorted(x["position"] for x in got.values()) == list(range(1, 201))
    assert loadings["a"] > 0 and loadings["c"] < 0


def test_ties_constants_and_empty(spark, rows):
    df = spark.createDataFrame([("b", 1.0, 5.0, None, 0, ""), ("a", 1.0, 5.0, None, 0, ""), ("c", 2.0, 5.0, None, 0, ""), ("d", None, None, None, 0, ""), (None, 0.0, 5.0, None, 0, ""), ("a", 1.0, 5.0, None, 0, "")], SCHEMA)
    ranked, _ = blended_ranking(df, "id", {"a": 1, "b": 1, "c": 1})
    assert [r["id"] for r in ranked.orderBy("position").collect()] == ["c", "a", "a", "b", None, "d"]
    assert blended_ranking(df.limit(0), "id", {"a": 1, "b": 1})[0].count() == 0
