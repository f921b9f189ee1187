"""Moments of pairs by blocks and tiles against every pair compared day by day."""

import math
import random

import numpy as np
import pytest

from sparkfolio.operators import gram, selection


def cells(seed, items=9, days=80, missing=0.2):
    r = random.Random(seed)
    out = [(f"i{k}", d, 5 + r.gauss(k, 1 + k)) for k in range(items) for d in range(days) if r.random() > missing]
    out += [("flat", d, 0.1) for d in range(days)] + [("same", d, v) for i, d, v in out if i == "i0"] + [("lone", 10**6, 1.0), ("gone", 3, None), (None, 3, 1.0)]
    return out


def plain(rows):
    by = {}
    for i, d, v in rows:
        if i is not None and v is not None:
            by.setdefault(i, {})[d] = v
    out = {}
    for a in by:
        for b in by:
            days = sorted(by[a].keys() & by[b].keys())
            if a < b and days:
                x, y = (np.array([by[s][d] for d in days]) for s in (a, b))
                out[a, b] = x, y
    return out


@pytest.mark.parametrize("width, tile", [(10**7, 256), (7, 4), (1, 2), (30, 1)])
def test_pair_moments(spark, width, tile):
    rows = cells(width)
    got = {(r["a"], r["b"]): r for r in gram.correlations(gram.pair_moments(spark.createDataFrame(rows, "item string, day int, v double").repartition(4), "item", "day", "v", width, tile)).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for k, (x, y) in want.items():
        r = got[k]
        assert r["n"] == len(x) and r["mean_a"] == pytest.approx(x.mean()) and r["mean_b"] == pytest.approx(y.mean())
        assert r["cov"] == pytest.approx(np.mean((x - x.mean()) * (y - y.mean())), abs=1e-9) and r["var_a"] == pytest.approx(x.var(), abs=1e-9)
        spread = x.std() > 1e-9 and y.std() > 1e-9
        assert r["rho"] == (pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9) if spread else None)
    rho = [r["rho"] for r in got.values() if r["rho"] is not None]
    pooled = selection.pooled_correlation(gram.correlations(gram.pair_moments(spark.createDataFrame(rows, "item string, day int, v double"), "item", "day", "v"))).first()
    assert pooled["rho_bar"] == pytest.approx(min(1, max(0, np.mean(rho)))) and pooled["pairs"] == len(want)


def test_differences(spark):
    rows = [r for r in cells(3) if r[0] not in ("lone", "gone", None)]
    got = {(r["a"], r["b"]): r for r in gram.differences(gram.pair_moments(spark.createDataFrame(rows, "item string, day int, v double"), "item", "day", "v")).collect()}
    for k, (x, y) in plain(rows).items():
        d = x - y
        want = d.mean() / (d.std(ddof=1) / math.sqrt(len(d))) if d.std() > 1e-12 else 0.0
        assert got[k]["mean_diff"] == pytest.approx(d.mean(), abs=1e-9) and got[k]["score"] == pytest.approx(want, abs=1e-6)
    assert got["i0", "same"]["score"] == 0 and got["i0", "same"]["sd_diff"] == 0
    apart = [("a", d, float(d % 7)) for d in range(50)] + [("b", d, float(d % 7) + 3) for d in range(50)]
    with pytest.raises(Exception, match="differ by a constant"):
        gram.differences(gram.pair_moments(spark.createDataFrame(apart, "item string, day int, v double"), "item", "day", "v")).collect()
    none = spark.createDataFrame([], "item string, day int, v double")
    assert gram.pair_moments(none, "item", "day", "v").count() == 0
