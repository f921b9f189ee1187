"""Path replay, metrics and decisions against expected values and a plain loop over every account's paths."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import inference, pathrisk

DAYS = "account string, day int, opening double, balance_change double, equity_change double, to_minimum double"


def fold(days, start=1000.0):
    """days: (balance, equity, minimum, opening) of one path."""
    x = np.array([(o, b, e, m) for b, e, m, o in days], float)
    return {k: v[0] for k, v in pathrisk.replayed(x, np.arange(len(x))[None, :], start).items()}


def day(balance=0.0, equity=None, minimum=0.0, opening=1000.0):
    return balance, balance if equity is None else equity, minimum, opening


@pytest.mark.parametrize(
    "days, start, want",
    [
        ([day(10, 10, -30)], 1000, {"final_return": 0.01, "internal_daily": True}),  # a breach in the day stays one after a good close
        ([day(0, 0, -26)], 1000, {"internal_daily": True, "daily": False}),
        ([day(0, 0, -26)], 100_000, {"internal_daily": True, "daily": False}),  # whatever the path's own size
        ([day(50, 50, 0, 100), day(-100, -100, 0)], 1000, {"final_return": 0.35}),
        ([day(0, 0, -25)], 1000, {"internal_daily": True}),
        ([day(0, 0, -24.99)], 1000, {"internal_daily": False}),
        ([day(50, 50, 0)], 1000, {"internal_trailing": True, "trailing": False, "earlier_internal_trailing": False, "earlier_trailing": False}),
        ([day(100, 100, -10)], 1000, {"max_drawdown": 0.01}),  # a later close is no peak of an earlier minimum
        ([day(100, 100, 0), day(0, 0, -10)], 1000, {"max_drawdown": 0.01}),
        ([day(0, 0, -60), day(10, 10, 0)], 1000, {"internal_trailing": True, "trailing": True}),
        ([day(0, 0, -59.99)], 1000, {"trailing": False}),
        ([day(-10, -10, -10), day(), day(20, 20)], 1000, {"under_water": 2 / 3}),
        ([day(-1200, 0, -1200), day(100, 0, 0)], 1000, {"final_return": -1.22, "max_drawdown": 1.2, "daily": True, "internal_daily": True, "trailing": True}),
        ([day(-1000, -1000, -100), day()], 1000, {"final_return": -1.0, "daily": True}),  # it opens a day at nothing
    ],
)
def test_replay(days, start, want):
    got = fold(days, float(start))
    for k, v in want.items():
        assert got[k] == (v if isinstance(v, bool) else pytest.approx(v)), k


def test_refusals(spark):
    for start in (0.0, -1.0, math.nan, math.inf):
        with pytest.raises(ValueError):
            fold([day()], start)
    with pytest.raises(ValueError):
        fold([day(opening=0.0)])
    with pytest.raises(ValueError):
        pathrisk.replayed(np.ones((1, 4)), np.zeros((1, 1), int), 1.0, pathrisk.Limits(internal_daily=0.04))
    flat = [("short", d, 1000.0, float(d % 2), 0.0, 0.0) for d in range(9)] + [("zero", d, float(d), 1.0, 1.0, 0.0) for d in range(40)] + [("still", d, 10.0, 0.0, 0.0, 0.0) for d in range(40)]
    got = {(r["account"], r["label"]): r for r in pathrisk.path_risk(spark.createDataFrame(flat, DAYS), ["account"], 1000.0, 30).collect()}
    assert len(got) == 15
    assert got["short", "plugin"]["reason"] and got["short", "plugin"]["block"] is None and got["short", "plugin"]["breach_ok"] is None
    assert got["short", "fixed_5"]["paths"] == 30 and got["zero", "fixed_5"]["reason"] and got["zero", "fixed_5"]["paths"] is None
    assert got["still", "plugin"]["block"] == 1 and got["still", "plugin"]["internal_any_count"] == 0 and not got["still", "plugin"]["breach_ok"]  # no event in 30 paths proves little
    assert pathrisk.path_risk(spark.createDataFrame([], DAYS), ["account"], 1000.0, 30).count() == 0


def test_metrics_are_exact(spark):
    values = (-30, -20, -10, 0, 10, 20, 30, 40, 50, 60)
    rows = [("a", k, 1 + v / 1000, v / 1000, max(-v, 0) / 1000, float(v < 0)) for k, v in enumerate(values)]
    x = spark.createDataFrame(rows, "account string, rep int, growth double, final_return double, max_drawdown double, under_water double")
    m = pathrisk.metrics(x.withColumns({h: F.lit(False) for h in pathrisk.HITS}), ["account"]).first()
    assert (m["final_return_p05"], m["final_return_p50"], m["final_return_p95"]) == (-0.03, 0.01, 0.06)
    assert m["shortfall_05"] == -0.03 and m["max_drawdown_p95"] == 0.03 and m["under_water_p05"] == 0 and m["under_water_p95"] == 1
    assert m["profit_chance"] == 0.6 and m["negative_count"] == 3
    many = spark.createDataFrame([("a", k, 1.0, v / 1000, 0.0, 0.0) for k, v in enumerate((-50, -40, -30, *range(47)))], x.schema)
    assert pathrisk.metrics(many.withColumns({h: F.lit(False) for h in pathrisk.HITS}), ["account"]).first()["shortfall_05"] == pytest.approx(-0.04)


def plain(days, rows, start):
    """One path, day by day, in exact fractions; the limits as they stand."""
    balance = close = high = peak = Fraction(start)
    hit, deepest, wet = dict.fromkeys(pathrisk.HITS, False), Fraction(0), 0
    for k in rows:
        o, b, e, m = (Fraction(v) for v in days[k])
        opened, least = balance, balance * (1 + m / o)
        close += opened * e / o
        balance = opened * (1 + b / o)
        for name, limit in (("internal_daily", Fraction("0.025")), ("daily", Fraction("0.03"))):
            hit[name] |= opened <= 0 or -m >= limit * o
        for name, limit in (("internal_trailing", Fraction("0.05")), ("trailing", Fraction("0.06"))):
            hit["earlier_" + name] |= least <= min(start, high - limit * start)
            hit[name] |= least <= min(start, max(high, balance) - limit * start)
        high = max(high, balance)
        deepest = max(deepest, (peak - least) / peak)
        peak = max(peak, close)
        wet += close < peak
    return {"final_return": (balance - start) / start, "max_drawdown": deepest, "under_water": Fraction(wet, len(rows)), **hit}


def test_all_accounts_like_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    source = {}
    for account, n in (("a", 24), ("b", 12), ("c", 1)):
        opening = rng.integers(800, 1300, n).astype(float)
        change = np.round(rng.normal(0, 12, n), 1)
        source[account] = np.stack([opening, change, np.round(change + rng.normal(0, 3, n), 1), np.minimum(change, 0) - rng.integers(0, 15, n)], axis=1)
    rows = [(a, d, *map(float, x)) for a, days in source.items() for d, x in enumerate(days)]
    choices = pathrisk.chosen(pathrisk.packed(spark.createDataFrame(rows, DAYS).repartition(5), ["account"])).cache()
    got = pathrisk.replays(choices, ["account"], 1000.0, 520, 9).collect()
    seen = {(r["account"], r["label"], r["rep"]) for r in got}
    blocks = {(r["account"], r["label"]): r["block"] for r in choices.collect()}
    assert len(seen) == len(got) == 520 * sum(b is not None for b in blocks.values()) and blocks["b", "fixed_60"] == 60
    drawn = {}
    for (a, label), b in blocks.items():
        if b is not None:
            drawn[a, label] = np.concatenate([inference.indices(len(source[a]), b, size, 9, c) for c, size in enumerate((500, 20))])
    for r in got:
        want = plain(source[r["account"]], drawn[r["account"], r["label"]][r["rep"]], 1000)
        assert {k: r[k] for k in pathrisk.HITS} == {k: bool(want[k]) for k in pathrisk.HITS}
        assert all(r[k] == pytest.approx(float(want[k]), abs=1e-12) for k in pathrisk.VALUES)
        assert (not r["daily"] or r["internal_daily"]) and (not r["trailing"] or r["internal_trailing"])
    counts = {(r["account"], r["label"], r["day"]): (r["drawn"], r["paths"]) for r in pathrisk.drawn_days(choices, ["account"], 520, 9).collect()}
    for (a, label), x in drawn.items():
        for d in range(len(source[a])):
            assert counts[a, label, d] == ((x == d).sum(), (x == d).any(axis=1).sum())


def test_sampled_days_stay_whole(spark):
    rows = [(a, d, 100.0 + d, float(d), 0.5 * d, -float(d)) for a, n in (("a", 12), ("b", 5)) for d in range(n)]
    days = spark.createDataFrame(rows, DAYS)
    p = pathrisk.sampled(days, ["account"], 3, 40, 11)
    assert p.count() == 40 * 17 and pathrisk.foreign(days, p, ["account"]).count() == 0
    torn = p.where("account <> 'b' OR rep <> 7 OR step <> 0").withColumn("to_minimum", F.when((F.col("rep") == 3) & (F.col("account") == "a"), 5.0).otherwise(F.col("to_minimum")))
    found = {(r["account"], r["what"]) for r in pathrisk.foreign(days, torn, ["account"]).collect()}
    assert found == {("a", "row"), ("b", "length")}
    assert pathrisk.sampled(days.limit(0), ["account"], 3, 40).count() == 0
