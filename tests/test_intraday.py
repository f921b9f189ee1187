"""Minima within a day against a definition evaluated at every cut."""

import datetime as dt
import random

import pytest

from sparkfolio.operators import intraday

US, H = 1_000_000, 3_600_000_000
T0 = int(dt.datetime(2024, 3, 4, tzinfo=dt.UTC).timestamp()) * US
TRADE = "account string, id long, market string, ts_opened long, ts_closed long, pnl double, swap double, entry double, exit double, is_long boolean, size double"
BAR = "market string, ts long, low double, high double, close double"


def loss_day(us):
    """The Chicago date, the next from 16:15 on; daylight saving began there on 10 March 2024."""
    at = dt.datetime.fromtimestamp(us // US, dt.UTC)
    away = 5 if at >= dt.datetime(2024, 3, 10, 8, tzinfo=dt.UTC) else 6
    return (at - dt.timedelta(hours=away) + dt.timedelta(hours=7, minutes=45)).date().toordinal() - dt.date(1970, 1, 1).toordinal()


def brute(trades, bars, daily, start):
    out = {}
    for account in {d[0] for d in daily}:
        mine = [t for t in trades if t[0] == account]
        cuts = sorted({x for t in mine for x in t[3:5]} | {b[1] + k for b in bars for k in (0, 4 * H)})
        days = {d[1]: [min(d[2], d[3]), 0.0] for d in daily if d[0] == account}

        def money(t, price):
            return t[10] * t[5] * (price - t[7]) / ((t[8] - t[7]) if abs(t[8] - t[7]) >= 1e-12 else 1.0)

        def last(t, now):
            ended = [b for b in bars if b[0] == t[2] and t[3] < b[1] + 4 * H <= now]
            return max(ended, key=lambda b: b[1])[4] if ended else t[7]

        def fell(day, value, peak):
            if day in days and peak > 0:
                days[day][1] = min(days[day][1], (value - peak) / peak)

        peak = start
        for now, until in zip(cuts, cuts[1:] + [None]):
            booked = start + sum((t[5] + t[6]) * t[10] for t in mine if t[4] <= now)
            held = [t for t in mine if t[3] <= now < t[4]]
            seen = booked + sum(money(t, last(t, now)) for t in held)
            fell(loss_day(now), seen, peak)
            peak = max(peak, seen)
            if until and held:
                mark = booked
                for t in held:
                    run = [b for b in bars if b[0] == t[2] and b[1] <= now and until <= b[1] + 4 * H]
                    mark += money(t, (run[0][2] if t[9] else run[0][3]) if run else last(t, now))
                for day in range(loss_day(now), loss_day(until - 1) + 1):
                    fell(day, mark, peak)
                    if day in days:
                        days[day][0] = min(days[day][0], mark)
        out |= {(account, day): tuple(v) for day, v in days.items()}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_minima(spark, seed):
    draw = random.Random(seed)
    bars = []
    for m in "pqr":
        price = 100.0
        for k in range(50):
            if m != "p" and draw.random() < 0.3:
                continue  # closed markets
            c = price + draw.uniform(-3, 3)
            bars.append((m, T0 + k * 4 * H, min(price, c) - draw.random(), max(price, c) + draw.random(), c))
            price = c
    trades = []
    for i in range(40):
        m = draw.choice("pqr")
        a = draw.choice([b[1] for b in bars if b[0] == m]) + draw.choice([0, 0, H, 2 * H + 7])
        b = a + draw.choice([0, 4 * H, 9 * H, 30 * H, 70 * H])
        e, long_ = 100 + draw.uniform(-5, 5), draw.random() < 0.5
        x = draw.choice([e, e + draw.uniform(-5, 5)])
        trades.append((draw.choice("ab"), i, m, a, b, (x - e) * (1 if long_ else -1) * 10, -0.5, e, x, long_, draw.choice([0.5, 2.0])))
    days = range(loss_day(T0), loss_day(T0 + 270 * H) + 1)
    daily = [(acc, d, 1000 + draw.uniform(-60, 60), 1000 + draw.uniform(-60, 60)) for acc in "abc" for d in days]
    got = intraday.minima(spark.createDataFrame(trades, TRADE), spark.createDataFrame(bars, BAR), spark.createDataFrame(daily, "account string, day int, opening double, equity double"), 1000.0)
    got = {(r["account"], r["day"]): (r["minimum"], r["drawdown"]) for r in got.collect()}
    want = brute(trades, bars, daily, 1000.0)
    assert set(got) == set(want)
    assert any(v[1] < -0.01 for v in want.values()) and any(v[0] < min(d[2], d[3]) for d in daily for k, v in want.items() if k == d[:2])
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9), k


def test_a_position_that_no_bar_overlaps(spark):
    t = spark.createDataFrame([("a", 1, "p", T0, T0 + H, 1.0, 0.0, 1.0, 2.0, True, 1.0), ("a", 2, "p", T0, T0, 1.0, 0.0, 1.0, 2.0, True, 1.0)], TRADE)
    bars, daily = spark.createDataFrame([("p", T0 + 4 * H, 1.0, 2.0, 1.5)], BAR), spark.createDataFrame([("a", 19786, 1.0, 1.0)], "account string, day int, opening double, equity double")
    assert [tuple(r) for r in intraday.unobserved(t, bars).collect()] == [("a", 1)]
    with pytest.raises(ValueError, match="a/1"):
        intraday.minima(t, bars, daily, 1.0)
    assert intraday.minima(t.limit(0), bars, daily, 1.0).collect()[0]["minimum"] == 1.0


def test_levels_are_worked_out_once(spark, sf_dir):
    """Every pass over an account's times reads their stored sums, not the pairs of positions and bars."""
    from sparkfolio.queries import accounts

    assert not any("/met-" in f for f in accounts.watched(spark, sf_dir).inputFiles())
