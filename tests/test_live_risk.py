"""Risk state: expected decisions, the batch answer against a plain controller, and the stream against the batch answer over a
restart."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from sparkfolio.queries import live
from sparkfolio.streaming import parity, risk

T0 = dt.datetime(2024, 3, 4, 12)


def rows(*events):
    """(hours after T0, kind, id, risk, balance, equity) of account a."""
    return [("a", T0 + dt.timedelta(hours=h), k, *rest) for k, (h, *rest) in enumerate(events)]


def last(spark, *events):
    x = risk.risk_table(spark.createDataFrame(rows(*events), risk.UPDATE)).collect()
    return max(x, key=lambda r: (r["ts"], r["seq"]))


def start(balance):
    return (0, "start", None, None, balance, balance)


def test_floors_and_halts(spark):
    r = last(spark, start(200_000.0))
    assert (r["day_start"], r["high"], r["flatten"]) == (200_000, 200_000, None)
    x = risk.judged(spark.createDataFrame([("balance", 200_000.0, 200_000.0, 220_000.0, 0.0, 196_000.0, None, None)], "kind string, start double, day_start double, high double, open_risk double, equity double, risk double, replaced double")).first()
    assert x["trailing_floor"] == 200_000 and x["daily_floor"] == 195_000 and x["flatten"] == risk.TRAILING
    assert last(spark, start(200_000.0), (1, "balance", None, None, 200_000.0, 189_000.0))["flatten"] == risk.TRAILING
    assert last(spark, start(200_000.0), (1, "balance", None, None, 200_000.0, 196_000.0))["flatten"] is None
    assert last(spark, start(50_000.0), (1, "balance", None, None, 50_000.0, 48_700.0))["flatten"] == risk.DAILY
    # the day's start is the balance that the day before closed with, and the highest one is banked
    r = last(spark, start(200_000.0), (1, "balance", None, None, 210_000.0, 210_000.0), (30, "balance", None, None, 209_000.0, 204_000.0))
    assert (r["day_start"], r["high"], r["flatten"]) == (210_000, 210_000, risk.DAILY)


@pytest.mark.parametrize(
    "balance, open_, equity, ask, refused",
    [
        (200_000.0, None, 200_000.0, (None, 400.0), None), (200_000.0, 3_800.0, 200_000.0, (None, 400.0), risk.CAP), (200_000.0, 900.0, 196_000.0, (None, 400.0), risk.TAIL),
        (200_000.0, 3_800.0, 200_000.0, (1, 400.0), None), (50_000.0, 810.0, 50_000.0, (None, 90.0), None), (50_000.0, 900.0, 50_000.0, (None, 90.0), risk.TAIL), (50_000.0, 1_000.0, 55_000.0, (None, 100.0), risk.TAIL),
        (200_000.0, math.nan, 200_000.0, (None, 1.0), risk.CAP), (200_000.0, None, 200_000.0, (None, None), risk.CAP),
    ],
)
def test_entries(spark, balance, open_, equity, ask, refused):
    """nan: a position without a price."""
    held = [] if open_ is None else [(1, "open", 1, None if math.isnan(open_) else open_, None, None)]
    r = last(spark, start(balance), *held, (2, "balance", None, None, balance, equity), (3, "entry", *ask, None, None))
    assert r["refused"] == refused and (math.isinf(r["open_risk"]) if open_ is not None and math.isnan(open_) else r["open_risk"] == (open_ or 0))


def test_unknown_start_and_closed_positions(spark):
    r = last(spark, (0, "balance", None, None, 5.0, 5.0), (1, "entry", None, 1.0, None, None))
    assert (r["refused"], r["flatten"], r["day_start"]) == (risk.UNKNOWN, risk.UNKNOWN, None)
    r = last(spark, start(1000.0), (1, "open", 7, None, None, None), (2, "close", 7, None, None, None), (3, "entry", 7, 5.0, None, None))
    assert r["open_risk"] == 0 and r["refused"] is None


def plain(updates):
    """Every account's updates in order through one loop."""
    out = {}
    state = {}
    for u in sorted(updates, key=lambda r: (r["ts"], r["seq"])):
        s = state.setdefault(u["account"], {"day": None, "start": None, "day_start": None, "high": None, "balance": None, "equity": None, "pos": {}})
        if s["day"] is not None and u["day"] > s["day"] and s["start"] is not None:
            s["high"], s["day_start"] = max(s["high"], s["balance"]), s["balance"]
        s["day"], b, replaced = u["day"], risk.Budget(), 0.0
        if u["kind"] in ("start", "balance"):
            s["balance"], s["equity"] = u["balance"], u["equity"]
        if u["kind"] == "start":
            s["start"] = s["day_start"] = u["balance"]
            s["high"] = max(s["high"] or u["balance"], u["balance"])
        if u["kind"] == "open":
            s["pos"][u["id"]] = math.inf if u["risk"] is None else u["risk"]
        if u["kind"] == "close":
            s["pos"].pop(u["id"], None)
        total = round(sum(s["pos"].values()), 9)
        flatten = refused = None
        if s["start"] is None:
            flatten, refused = risk.UNKNOWN, risk.UNKNOWN if u["kind"] == "entry" else None
        else:
            floor = min(s["start"], s["high"] - 0.05 * s["start"])
            flatten = risk.TRAILING if s["equity"] <= floor else risk.DAILY if s["equity"] <= s["day_start"] - 0.025 * s["day_start"] else None
            if u["kind"] == "entry":
                replaced = s["pos"].get(u["id"], 0.0)
                taken = max(0.0, total - (replaced if replaced != math.inf else 0.0)) + u["risk"]
                ref = min(s["equity"], s["day_start"])
                room = min(ref - 0.973 * s["day_start"], ref - 0.97 * s["day_start"], min(s["equity"], s["high"]) - floor)
                refused = risk.CAP if taken > b.open_risk * s["equity"] else risk.TAIL if 1.5 * taken > room + 1e-9 else None
        out[u["account"], u["seq"]] = (u["day"], s["day_start"], s["high"], total, flatten, refused)
    return out


def test_table_like_a_plain_loop(spark, sf_dir):
    from sparkfolio.functions import timeaxis as tx

    u = live.updates(spark, sf_dir)
    want = plain(u.withColumn("day", tx.day_number(tx.loss_day(F.col("ts")))).collect())
    for width in (None, 1):
        got = {(r["account"], r["seq"]): (r["day"], r["day_start"], r["high"], r["open_risk"], r["flatten"], r["refused"]) for r in risk.risk_table(u, width=width).collect()}
        assert got.keys() == want.keys()
        for k, w in want.items():
            assert got[k][0] == w[0] and got[k][4:] == w[4:], k
            assert all((a is None) == (b is None) and (a is None or a == b or a == pytest.approx(b, abs=1e-6)) for a, b in zip(got[k][1:4], w[1:4]))
    assert {w[5] for w in want.values()} >= {None, risk.CAP, risk.UNKNOWN}


def streamed(spark, source, out, checkpoint, make):
    q = make(spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source))
    q = q.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


@pytest.fixture()
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    risk.durable_state(spark)
    yield
    spark.conf.set(key, old)


def test_stream_survives_a_restart(spark, tmp_path, store):
    events = []
    for a, shift in (("a", 0), ("b", 5)):
        kinds = [(0, "start", None, None, 1000.0, 1000.0), (1, "open", 1, 4.0, None, None), (2, "balance", None, None, 1010.0, 1004.0), (3, "entry", None, 3.0, None, None), (9, "open", 2, None, None, None), (10, "entry", None, 1.0, None, None)]
        kinds += [(20, "close", 2, None, None, None), (30, "balance", None, None, 1008.0, 980.0), (31, "entry", 1, 12.0, None, None), (60, "close", 1, 4.0, None, None), (61, "balance", None, None, 1030.0, 1030.0), (90, "entry", None, 5.0, None, None)]
        events += [(a, T0 + dt.timedelta(hours=h + shift), k, *rest) for k, (h, *rest) in enumerate(kinds)]
    events.append(("c", T0 + dt.timedelta(hours=200), 0, "start", None, None, 1.0, 1.0))  # moves the watermark
    df = spark.createDataFrame(events, risk.UPDATE)
    src, out, ck = (f"{tmp_path}/{n}" for n in ("in", "out", "ck"))
    for k, part in enumerate((df.where(F.col("ts") < F.lit(T0 + dt.timedelta(hours=15))), df.where((F.col("ts") >= F.lit(T0 + dt.timedelta(hours=15))) & (F.col("account") != "c")), df.where("account = 'c'"))):
        part.coalesce(1).write.mode("append").parquet(src)
        streamed(spark, src, out, ck, lambda s: risk.risk_stream(s, "1 hour"))  # each part is a run of its own
    got = spark.read.parquet(out).collect()
    key = lambda r: tuple(r[c] for c in ("account", "ts", "seq", "kind", "day", "day_start", "high", "open_risk", "flatten", "refused"))
    want = sorted(map(key, risk.risk_table(df).collect()), key=str)
    assert sorted((key(r) for r in got if r["kind"] != "roll"), key=str) == want
    rolls = {(r["account"], r["day"]): r for r in got if r["kind"] == "roll"}
    assert {a for a, _ in rolls} >= {"a", "b"}  # idle accounts roll by their timers
    end = max(r["day"] for r in got if r["account"] == "a" and r["kind"] != "roll")
    late = [r for (a, day), r in rolls.items() if a == "a" and day > end]
    assert late and all(r["high"] == r["day_start"] == 1030.0 for r in late)


def test_signals_of_two_streams(spark, tmp_path, store):
    import numpy as np

    from sparkfolio.operators import signals

    rules = signals.EntryRules(need_band=False, need_range=False, need_strength=False)
    r, sides = np.random.default_rng(11), {"live": [], "ref": []}
    for m, n in (("x", 120), ("y", 40)):
        close = 100 + np.cumsum(r.normal(0, 1, n))
        open_ = np.concatenate([[100.0], close[:-1]])
        for k in range(n):
            at = T0 + dt.timedelta(hours=4 * k)
            bar = (m, at, float(open_[k]), float(max(open_[k], close[k]) + 0.3), float(min(open_[k], close[k]) - 0.3), float(close[k]))
            sides["ref"].append(bar)
            if k % 13:  # some bars are missing live, some closes differ
                sides["live"].append(bar if k % 17 else (*bar[:5], bar[5] + 4))
    kinds = "market string, ts timestamp, open double, high double, low double, close double"
    live_, ref = (spark.createDataFrame(sides[s], kinds) for s in ("live", "ref"))
    table = parity.signal_table(live_, ref, rules)
    counts = {x["market"]: (x["agree"], x["disagree"]) for x in parity.agreement(table).collect()}
    by = {(b[0], b[1]): b for b in sides["ref"]}
    for m in ("x", "y"):
        pairs = [(b, by[b[:2]]) for b in sorted(sides["live"], key=lambda b: b[1]) if b[0] == m]
        marks = [signals.signals(*(np.array([p[s][c] for p in pairs]) for c in (2, 3, 4, 5)), rules) for s in (0, 1)]
        same = [marks[0][0][k] == marks[1][0][k] and marks[0][1][k] == marks[1][1][k] for k in range(len(pairs)) if k + 1 >= rules.first]
        assert counts[m] == (sum(same), len(same) - sum(same))
    assert counts["x"][0] and counts["x"][1]
    paths = {}
    for name, df in (("live", live_), ("ref", ref)):
        paths[name] = f"{tmp_path}/{name}"
        for part in (F.col("ts") < F.lit(T0 + dt.timedelta(hours=200)), F.col("ts") >= F.lit(T0 + dt.timedelta(hours=200))):
            df.where(part).coalesce(1).write.mode("append").parquet(paths[name])
    ends = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(paths["live"])
    others = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(paths["ref"])
    q = parity.signal_stream(ends, others, rules, "4 hours").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    line = lambda x: tuple(x)
    assert sorted(map(line, spark.read.parquet(f"{tmp_path}/out").select(*table.columns).collect())) == sorted(map(line, table.collect()))


def test_balances_meet_their_floor_exactly(spark, tmp_path):
    """Cents add up without the noise of doubles: a last event brings equity to the start, which is its floor by then."""
    from decimal import Decimal

    cents = [(7919 * k * k) % 99_999_989 - 40_000_000 for k in range(4_000)]  # gains and losses of up to 600,000
    so_far = 10_000_000 + sum(cents)
    cents += [1] * (so_far % 2)
    cents.append((10_000_000 - so_far - so_far % 2) // 2)
    values = [float(Decimal(c + 5_000) / 100) for c in cents]
    rows = [(k, T0 + dt.timedelta(minutes=k), 1, v) for k, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["seq"] // 4: r for r in live.updates(spark, str(tmp_path)).where("kind = 'balance'").collect()}
    at = 10_000_000
    for k, c in enumerate(cents):
        at += c
        assert got[k]["balance"] == float(Decimal(at) / 100) and got[k]["equity"] == float(Decimal(at + c) / 100)
    end = live.t47(spark, str(tmp_path)).where(F.col("seq") == 4 * (len(cents) - 1)).first()
    assert got[len(cents) - 1]["equity"] == live.START and end["high"] > 105_000 and end["flatten"] == risk.TRAILING


def test_odd_values_are_summed_as_doubles(spark):
    from sparkfolio.operators import scans

    for cut in (None, F.col("k")):
        rows = [(k, v) for k, v in enumerate([None, 0.1, 0.2, 1e300, None, -1e300, math.inf, math.nan])]
        x = scans.running(spark.createDataFrame(rows, "k int, v double"), [], ["k"], cut, {"s": ("exact", F.col("v"))})
        got = [r["s"] for r in x.orderBy("k").collect()]
        assert got[:3] == [None, 0.1, 0.3] and got[3:5] == [1e300] * 2 and got[5] == 0.3 and got[6] == math.inf and math.isnan(got[7])
