"""Scans by cuts against plain loops, with one cut, a few, one a row, and one market that has most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import curves, indicators, joins, scans, stats


def rows_of(seed=1):
    """market, at, tie, v: gaps, equal times, nulls, a null market, a market with one row and one with most of all."""
    r, out, k = random.Random(seed), [], 0
    for market, n in (("hot", 400), ("b", 30), ("one", 1), (None, 12)):
        at = -50
        for _ in range(n):
            at += r.choice([0, 0, 1, 1, 2, 40 if r.random() < 0.05 else 3])
            k += 1
            out.append((market, at, k, r.choice([None, 1.0, -2.0, 0.5, 3.25, -7.0])))
    return out


SCHEMA = "market string, at int, tie int, v double"
CUTS = [None, 10**6, 97, 1]


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(5)


def groups(rows):
    out = {}
    for row in sorted(rows, key=lambda x: (x[1], x[2])):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("width", CUTS)
@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running(spark, width, backward, exclusive):
    rows = rows_of()
    df = table(spark, rows)
    kinds = {k: (k, F.col("v")) for k in ("sum", "count", "max", "min", "last")}
    got = {r["tie"]: r for r in scans.running(df, ["market"], ["at", "tie"], scans.cut_by(df, "at", width), kinds, exclusive, backward).collect()}
    assert len(got) == len(rows)
    for g in groups(rows).values():
        seen = []
        for row in g[::-1] if backward else g:
            if not exclusive and row[3] is not None:
                seen.append(row[3])
            r = got[row[2]]
            want = (sum(seen), max(seen), min(seen), seen[-1]) if seen else (None, None, None, None)
            assert (r["sum"], r["max"], r["min"], r["last"]) == want and (r["count"] or 0) == len(seen), row
            if exclusive and row[3] is not None:
                seen.append(row[3])


@pytest.mark.parametrize("width", CUTS)
def test_numbers_lags_and_levels(spark, width):
    rows = rows_of(2)
    df = table(spark, rows)
    cut = scans.cut_by(df, "at", width)
    number = {r["tie"]: r["n"] for r in scans.numbered(df, ["market"], ["at", "tie"], cut, "n").collect()}
    before = {r["tie"]: r["b"] for r in scans.lagged(df, ["market"], ["at", "tie"], cut, "v", "b").collect()}
    level = {r["tie"]: (r["equity"], r["peak"]) for r in scans.levels(df.fillna(0.0), ["market"], ["at", "tie"], cut, "v", 5.0).collect()}
    deep = {r["market"]: r["max_dd"] for r in scans.deepest(df.fillna(0.0), ["market"], ["at", "tie"], cut, "v", 5000.0).collect()}
    for market, g in groups(rows).items():
        at, peak = 5.0, 5.0
        worst, money, top = 0.0, 5000.0, 5000.0
        for k, row in enumerate(g):
            assert number[row[2]] == k + 1 and before[row[2]] == (g[k - 1][3] if k else None)
            at, money = at + (row[3] or 0), money + (row[3] or 0)
            peak, top = max(peak, at), max(top, money)
            worst = max(worst, (top - money) / top)
            assert level[row[2]] == (at, peak)
        assert deep[market] == pytest.approx(worst, abs=1e-15)


@pytest.mark.parametrize("width", CUTS)
@pytest.mark.parametrize("block", [1, 7, 50_000])
def test_rolling(spark, width, block):
    rows = rows_of(3)
    df = table(spark, rows)
    got = {r["tie"]: r for r in scans.rolling(df, ["market"], ["at", "tie"], scans.cut_by(df, "at", width), 5, {"m": F.max("v"), "c": F.count("*")}, block).collect()}
    assert len(got) == len(rows)
    for g in groups(rows).values():
        for k, row in enumerate(g):
            frame = [x[3] for x in g[max(0, k - 4) : k + 1]]
            r = got[row[2]]
            assert r["c"] == len(frame) and r["m"] == max((v for v in frame if v is not None), default=None) and r["__at"] == k + 1


@pytest.mark.parametrize("width", CUTS)
def test_recurrences(spark, width):
    """Bars every four hours with gaps; the market 'hot' has most of them. The plain versions run over whole markets."""
    r = np.random.default_rng(5)
    rows = [(m, f"2024-01-01 00:00:00", k, float(x)) for m, n in (("hot", 300), ("b", 20), ("one", 1)) for k, x in enumerate(100 + np.cumsum(r.normal(0, 1, n)).round(2))]
    df = spark.createDataFrame(rows, "market string, t string, k int, close double").select("market", (F.col("t").cast("timestamp") + F.expr("make_dt_interval(0, 4 * (k + k div 17 * 9))")).alias("ts"), "k", "close").repartition(4)
    got = {}
    for x in indicators.smoothed(df, ["market"], 12, 14, width=width).collect():
        got.setdefault(x["market"], {})[x["k"]] = (x["ema"], x["rsi"])
    for m in ("hot", "b", "one"):
        close = np.array([c for a, _, _, c in rows if a == m])
        e = close[:1].tolist()
        for c in close[1:]:
            e.append(e[-1] + 2 / 13 * (c - e[-1]))
        want = indicators.rsi(close, 14)
        for k in range(len(close)):
            assert got[m][k] == (pytest.approx(e[k], rel=1e-12), pytest.approx(want[k], rel=1e-9))


@pytest.mark.parametrize("width", CUTS)
def test_asof_and_nearest(spark, width):
    r = random.Random(7)
    left = [(m, r.randint(-30, 500), k) for k, m in enumerate(["hot"] * 300 + ["b"] * 20 + ["none"] * 3)]
    right = [(m, at, float(at)) for m, n in (("hot", 40), ("b", 3)) for at in r.sample(range(0, 480, 3), n)] + [("hot", 100, None)]
    right = list({(m, at): (m, at, v) for m, at, v in right}.values())
    a, b = spark.createDataFrame(left, "market string, at int, k int").repartition(4), spark.createDataFrame(right, "market string, at int, v double").repartition(3)
    ats = {}
    for m, at, v in right:
        ats.setdefault(m, {})[at] = v
    for strict in (False, True):
        got = {x["k"]: x["v"] for x in joins.asof(a, b, ["market"], "at", ["v"], strict, width).collect()}
        for m, at, k in left:
            before = [t for t in ats.get(m, {}) if (t < at if strict else t <= at)]
            assert got[k] == (ats[m][max(before)] if before else None)
    got = {x["k"]: x["nearest"] for x in joins.nearest(a, b, ["market"], "at", width).collect()}
    assert got == {k: min(ats.get(m, {}), key=lambda t: (abs(t - at), t), default=None) for m, at, k in left}


@pytest.mark.parametrize("width", CUTS)
def test_curves(spark, width):
    rows = [(m, at, tie, v or 0.0) for m, at, tie, v in rows_of(4) if m]
    df = table(spark, rows)
    curve = curves.equity_curve(df, ["market"], ["at", "tie"], "v", 1000.0, width)
    got = {(r["market"], r["step"]): r["equity"] for r in curve.collect()}
    score = {r["market"]: r["score"] for r in stats.calmar(df, ["market"], ["at", "tie"], "v", 1000.0, width=width).collect()}
    walked = {r["tie"]: r["r_multiple"] for r in curves.assign_r(df, ["market"], ["at", "tie"], "v", 1000.0, 0.01, False, width).collect()}
    for m, g in groups(rows).items():
        equity, peak, dd = 1000.0, 1000.0, 0.0
        assert got[m, 0] == 1000.0
        for k, row in enumerate(g):
            assert walked[row[2]] == pytest.approx(row[3] / (0.01 * equity))
            equity += row[3]
            peak = max(peak, equity)
            dd = max(dd, (peak - equity) / peak)
            assert got[m, k + 1] == equity
        want = sum(r[3] for r in g) / 1000.0 / max(dd, 1e-6) if len(g) >= 10 else float("-inf")
        assert score[m] == pytest.approx(want)
    steps = curve.groupBy("market").count().collect()
    assert {r["market"]: r["count"] for r in steps} == {m: len(g) + 1 for m, g in groups(rows).items()}
