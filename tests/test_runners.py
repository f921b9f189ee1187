"""Walk-forward runs against plain loops over pandas slices."""

import datetime as dt
import math

import numpy as np
import pytest

from sparkfolio.operators import runners, signals, walkforward

RULES = signals.EntryRules(band_width=1.0, need_band=False, need_range=False, need_strength=False)
COMBOS = [(f"{s}/{t}", s, t) for s in (1.0, 3.0) for t in (1.0, 2.0, 6.0)]
RISK = 0.002


def make(spark, n=2200):
    """Four-hour bars of two seeded walks around waves, so that windows prefer different parameters."""
    rows, draw = [], np.random.default_rng(7)
    for m, speed in (("p", 37), ("q", 53)):
        at = 100 + 3 * np.sin(2 * np.pi * np.arange(n + 1) / speed) + np.cumsum(draw.normal(0, 0.4, n + 1))
        for i, (o, c) in enumerate(zip(at.tolist(), at[1:].tolist())):
            rows.append((m, dt.datetime(2020, 1, 1) + dt.timedelta(hours=4 * i), o, max(o, c) + 0.15, min(o, c) - 0.15, c))
    return spark.createDataFrame(rows, "market string, ts timestamp_ntz, open double, high double, low double, close double")


def closed(pdf, first, sl, tp, allowed=None):
    """(opened, closed, r) in order of closing."""
    ohlc = [pdf[c].to_numpy(float) for c in ("open", "high", "low", "close")]
    ok = (pdf["ts"] >= first).to_numpy() if allowed is None else allowed
    ts, sl = list(pdf["ts"]), np.broadcast_to(sl, len(pdf))
    out = signals.simulate_positions(*ohlc, *signals.signals(*ohlc, RULES), ok, sl, tp)
    return [(ts[a], ts[b], (1 if side else -1) * (x - e) / (e * sl[a] / 100)) for a, b, side, e, x in out]


def curve(rs):
    total, peak, dd = 1.0, 1.0, 0.0
    for r in rs:
        total += r * RISK
        peak = max(peak, total)
        dd = max(dd, (peak - total) / peak)
    return total - 1, dd


def test_walk_forward(spark):
    bars, windows = make(spark), walkforward.rolling_windows(spark, "2020-01-01", "2021-01-01", 4, 2, 3)
    ws, pre = [r.asDict() for r in windows.orderBy("ordinal").collect()], dt.timedelta(runners.PREROLL_DAYS)
    assert len(ws) == 3 and ws[0]["test_end"] < ws[1]["test_start"]  # gaps between tests
    got = {(r["market"], r["ordinal"]): r for r in runners.walk_forward(bars, windows, COMBOS, ["market"], RISK, RULES).collect()}
    want, picks = {}, set()
    every = bars.toPandas()
    for m, pdf in every.groupby("market"):
        pdf = pdf.sort_values("ts").reset_index(drop=True)
        chosen = []
        for w in ws:
            part = pdf[(pdf["ts"] >= w["train_start"] - pre) & (pdf["ts"] < w["train_end"])].reset_index(drop=True)
            best = (-math.inf, COMBOS[0], 0.0)
            for combo in COMBOS:
                rs = [r for _, _, r in closed(part, w["train_start"], *combo[1:])]
                total, dd = curve(rs)
                if len(rs) >= 10 and total / max(dd, 1e-6) > best[0]:
                    best = (total / max(dd, 1e-6), combo, total)
            chosen.append(best)
        span = pdf[(pdf["ts"] >= ws[0]["test_start"] - pre) & (pdf["ts"] <= ws[-1]["test_end"])].reset_index(drop=True)
        own = [next((i for i in reversed(range(len(ws))) if t >= ws[i]["test_start"]), None) for t in span["ts"]]
        ok = np.array([i is not None and t < ws[i]["test_end"] for i, t in zip(own, span["ts"])])
        sl, tp = (np.array([chosen[i or 0][1][k] for i in own]) for k in (1, 2))
        trades = closed(span, None, sl, tp, ok)
        for i, w in enumerate(ws):
            end = ws[i + 1]["test_start"] if i + 1 < len(ws) else w["test_end"] + dt.timedelta(microseconds=1)
            rs = [r for _, b, r in trades if w["test_start"] <= b < end]
            want[m, w["ordinal"]] = (chosen[i][1][0], chosen[i][2], *curve(rs), len(rs))
            picks.add(chosen[i][1][0])
    assert len(picks) > 1 and set(got) == set(want)
    for k, (combo, ins, oos, dd, n) in want.items():
        r = got[k]
        assert r["combo"] == combo and r["oos_trades"] == n and n > 0 and r["error"] is None
        assert r["is_return"] == pytest.approx(ins) and r["oos_return"] == pytest.approx(oos) and r["oos_max_dd"] == pytest.approx(dd)


def test_matrix_and_faults(spark):
    bars, windows = make(spark, 1500), walkforward.rolling_windows(spark, "2020-01-01", "2020-09-01", 4, 2, 2)
    one = [("1", 1.0, 2.0)]
    picked = spark.createDataFrame([(m, w, "1") for m in "pq" for w in range(2)], "market string, ordinal int, combo string")
    run = runners.continuous(bars, picked, windows, one, ["market"], RULES, matrix=True)
    rows = {(r["combo"], r["market"], r["ts_opened"], r["r"]) for r in run.collect()}
    assert {r[1:] for r in rows if r[0]} == {r[1:] for r in rows if not r[0]} and rows  # one combination: the matrix is the run
    assert runners.window_matrix(run, windows, ["market"], RISK).count() == 4
    lost = runners.continuous(bars.where("market = 'p'"), picked, windows, one, ["market"], RULES)
    assert {(r["market"], r["error"]) for r in lost.where("error IS NOT NULL").collect()} == {("q", "ValueError: no bars")}
    got = runners.walk_forward(bars, windows, [("bad", 1.0, None)], ["market"], RISK, RULES).collect()
    assert len(got) == 4 and all(r["error"].startswith("TypeError") and r["combo"] is None and r["oos_trades"] == 0 for r in got)
    with pytest.raises(ValueError, match="overlap"):
        runners.walk_forward(bars, walkforward.rolling_windows(spark, "2020-01-01", "2020-12-01", 4, 3, 2), one, ["market"], RISK, RULES)


def test_without_trades(spark):
    bars, windows = make(spark, 1500), walkforward.rolling_windows(spark, "2020-01-01", "2020-09-01", 4, 2, 2)
    got = runners.walk_forward(bars, windows, COMBOS, ["market"], RISK, RULES, least=10_000).collect()
    assert {(r["combo"], r["is_return"]) for r in got} == {("1.0/1.0", 0.0)}
    assert runners.walk_forward(bars.limit(0), windows, COMBOS, ["market"], RISK, RULES).count() == 0
