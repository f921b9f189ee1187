"""Signals against hand-made bars, plain loops and the expected sequence; overfitting against a plain version."""

import itertools
import math
import random

import numpy as np
import pytest

from sparkfolio.operators import signals, walkforward
from sparkfolio.operators.indicators import ema, rsi


def sine(n=199):
    """Two sines, periods 37 and 407 bars, sampled at each bar's open and close."""
    t = np.arange(n)
    slow = 0.35 * np.sin(t * 2 * np.pi / 407)
    open_, close = (100 + slow + 4 * np.sin((t + k) * 2 * np.pi / 37) for k in (0, 1))
    return tuple(x.round(5) for x in (open_, np.maximum(open_, close) + 0.15, np.minimum(open_, close) - 0.15, close))


def plain(o, h, low, c, p):
    """Bar by bar, with every condition looked up again."""
    mean, strength = ema(c, p.mean), rsi(c, p.strength, p.strength_scale)

    def band(i):
        x = c[i + 1 - p.band : i + 1]
        return np.mean(x) - p.band_width * np.std(x)

    def wr(i):
        if i + 1 < p.range_:
            return 0.0
        hi, lo = max(h[i + 1 - p.range_ : i + 1]), min(low[i + 1 - p.range_ : i + 1])
        return 100 * (c[i] - hi) / (hi - lo) if hi > lo else 0.0

    buys, sells, was, fell, armed = [], [], False, False, None
    for i in range(p.first - 1, len(c)):
        b = band(i)
        raw = c[i] > o[i] and low[i] <= b <= h[i]
        raw = raw and (not p.need_band or any(low[i - k] < band(i - k) for k in range(1, p.under_band + 1)))
        raw = raw and (not p.need_range or any(wr(i - k) < p.oversold for k in range(p.weak)))
        raw = raw and (not p.need_strength or strength[i] < p.buy_below)
        if raw and not was:
            buys.append(i)
        was = raw
        now = c[i] < o[i] and wr(i) < -20 < wr(i - 1) and 100 * (o[i] - c[i]) / o[i] >= p.body_pct
        base, fell = now and not fell, now
        strong = sum(strength[i - k] > p.sell_above for k in range(1, p.wait + 1)) >= p.strong
        if base and (mean[i] < mean[i - 1] or mean[i] > mean[i - 1] and (strong or not p.need_strength)):
            sells.append(i)
        if base and mean[i] > mean[i - 1] and p.need_strength and not strong:
            armed = (i, False)
        elif armed and i <= armed[0] + p.wait:
            at, broke = armed[0], armed[1] or low[i] < low[armed[0]]
            armed = (at, broke)
            if broke and c[i] < o[i] and mean[i] < mean[i - 1] and c[i] < h[at]:
                armed = None
                if i not in sells:
                    sells.append(i)
    return buys, sells


def found(x, p):
    return tuple(np.flatnonzero(s).tolist() for s in signals.signals(*x, p))


LOOSE = dict(need_band=False, need_range=False, need_strength=False)


def test_sequence_alternates():
    buys, sells = found(sine(), signals.EntryRules(band_width=1.0, **LOOSE))
    assert sorted(buys + sells) == [29, 50, 66, 87, 103, 124, 140, 161, 177, 198]
    assert buys == [29, 66, 103, 140, 177]


@pytest.mark.parametrize("rules", [dict(band_width=1.0, body_pct=0.0), dict(band_width=1.0, body_pct=0.0, sell_above=55.0), dict(band_width=0.5, body_pct=0.0, strength_scale=1.0), dict(band_width=1.0, body_pct=0.05, **LOOSE)])
def test_signals_like_the_plain_version(rules):
    p, n = signals.EntryRules(**rules), 0
    for seed in range(6):
        r = random.Random(seed)
        c = np.cumsum([r.gauss(0, 1) for _ in range(700)]) + 200
        o = np.concatenate([c[:1], c[:-1]])
        h, low = np.maximum(o, c) + [r.random() for _ in c], np.minimum(o, c) - [r.random() for _ in c]
        got, want = found((o, h, low, c), p), plain(o, h, low, c, p)
        assert got == want
        n += len(got[0]) and len(got[1])
    assert n


def test_few_bars():
    assert all(not x.any() for x in signals.signals(*(np.array([1.0, 2.0]) for _ in range(4))))
    assert all(len(x) == 0 for x in signals.signals(*(np.empty(0) for _ in range(4))))


def plain_pbo(m, groups):
    n, trials = len(m), len(m[0])
    bounds, at = [], 0
    for g in range(groups):
        bounds.append(range(at, at := at + n // groups + (g < n % groups)))
    low = total = 0
    for ins in itertools.combinations(range(groups), groups // 2):
        sums = [[sum(m[t][k] for g in range(groups) if (g in ins) == side for t in bounds[g]) for k in range(trials)] for side in (True, False)]
        best = sums[0].index(max(sums[0]))
        low += sum(x < sums[1][best] for x in sums[1]) / (trials - 1) < 0.5
        total += 1
    return low / total


@pytest.mark.parametrize("slices,trials", [(20, 5), (23, 4), (9, 7), (4, 2)])
def test_pbo(spark, slices, trials):
    r = random.Random(slices)
    m = [[r.randint(-9, 9) if k == 0 or r.random() < 0.8 else None for k in range(trials)] for _ in range(slices)]
    df = spark.createDataFrame([(t, f"c{k}", x) for t, row in enumerate(m) for k, x in enumerate(row) if x is not None], "slice int, trial string, perf long")
    groups = walkforward.usable_groups(slices)
    got = walkforward.pbo(df, "trial", "slice", "perf").first()
    assert math.isclose(got["pbo"], plain_pbo([[x or 0 for x in row] for row in m], groups)) and got["splits"] == math.comb(groups, groups // 2)


def test_pbo_of_steady_trials_and_few_slices(spark):
    df = spark.createDataFrame([(t, f"c{k}", k) for t in range(20) for k in range(5)], "slice int, trial string, perf long")
    assert walkforward.pbo(df, "trial", "slice", "perf").first()["pbo"] == 0.0
    assert walkforward.pbo(df.where("slice < 3"), "trial", "slice", "perf").first()["pbo"] is None


@pytest.mark.parametrize("width, block", [(1, 1), (40, 50), (10_000, 50_000)])
def test_signals_by_blocks_of_a_market(spark, width, block):
    """Blocks as short as the rules' memory, cuts of a day: the same signals as whole markets, the golden sequence included."""
    o, h, low, c = sine()
    rows = [("sine", k, *map(float, x)) for k, x in enumerate(zip(o, h, low, c))]
    for m, n in (("hot", 700), ("short", 20)):
        r = random.Random(n)
        close = 200 + np.cumsum([r.gauss(0, 1) for _ in range(n)])
        open_ = np.concatenate([close[:1], close[:-1]])
        rows += [(m, k, float(a), float(max(a, b) + r.random()), float(min(a, b) - r.random()), float(b)) for k, (a, b) in enumerate(zip(open_, close))]
    df = spark.createDataFrame(rows, "market string, k int, open double, high double, low double, close double").repartition(5)
    df = df.selectExpr("market", "timestamp_seconds(k * 14400L) AS ts", "open", "high", "low", "close")
    for rules in (signals.EntryRules(band_width=1.0, **LOOSE), signals.EntryRules(band_width=1.0, body_pct=0.0)):
        want = sorted(map(tuple, signals.signal_table(df, ["market"], rules).collect()))
        got = sorted(map(tuple, signals.signal_table(df, ["market"], rules, width, block).collect()))
        assert got == want and any(x[2] for x in got) and any(x[3] for x in got)
