"""Account simulation, scenario days, paths and the forward test against plain loops on small fixtures."""

import datetime as dt
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sparkfolio.functions import pricing as px
from sparkfolio.functions import text as tt
from sparkfolio.operators import accounts, inference, monitoring, paths, selection

TRADE = "account string, id long, market string, od int, cd int, ts_opened long, ts_closed long, pnl double, swap double, entry double, exit double"


def positions(seed=3, n=60):
    rng, rows = random.Random(seed), []
    for k in range(n):
        od = rng.randrange(10)
        cd = od + rng.choice([0, 0, 1, 2, 5])
        at = od * 100 + rng.randrange(4) * 20
        entry = rng.uniform(50, 100)
        end = at if cd == od and k % 3 == 0 else max(at, cd * 100 + rng.randrange(4) * 20)
        rows.append((rng.choice(["a", "b", None]), k, rng.choice(["x", "y"]), od, cd, at, end, rng.uniform(-900, 900), -rng.random(), entry, entry if k % 11 == 0 else entry + rng.uniform(-9, 9)))
    return rows


def by_hand(rows, price, start, limit, risk, compound):
    """Every position valued anew at each event."""
    sizes, days = {}, {}
    for who in {r[0] for r in rows}:
        mine = {r[1]: r for r in rows if r[0] == who}
        steps = sorted([(r[3], r[5], 0, k) for k, r in mine.items()] + [(r[4], r[6], 1, k) for k, r in mine.items()])
        booked, high, held, size = 0.0, start, [], {}

        def floating(day):
            total = 0.0
            for j in held:
                r = mine[j]
                span = r[10] - r[9] if abs(r[10] - r[9]) >= 1e-12 else 1.0
                total += r[7] * size[j] * (price[r[2], day] - r[9]) / span
            return total

        for day in range(min(r[3] for r in mine.values()), max(r[4] for r in mine.values()) + 1):
            opening = start + booked
            for d, _, kind, k in steps:
                if d == day and kind == 0:
                    high = max(high, start + booked)
                    equity = start + booked + floating(day)
                    used = min(1.0, max(0.0, 1 - (equity - min(start, high - limit * start)) / (limit * start)))
                    size[k] = risk(used) * (equity / start if compound else 1)
                    held.append(k)
                elif d == day:
                    booked += (mine[k][7] + mine[k][8]) * size[k]
                    held.remove(k)
            high = max(high, start + booked)
            days[who, day] = (opening, start + booked, start + booked + floating(day))
        sizes |= {(who, k): v for k, v in size.items()}
    return sizes, days


@pytest.mark.parametrize("compound", [False, True])
def test_simulation(spark, compound):
    rows, rng = positions(), random.Random(5)
    price = {(m, d): rng.uniform(50, 100) for m in "xy" for d in range(20)}
    risk = lambda used: max(0.15, 1 - used)
    t = spark.createDataFrame(rows, TRADE).withColumn("extra", F.lit(1))
    p = spark.createDataFrame([(m, d, v) for (m, d), v in price.items()], "market string, day int, close double")
    got = accounts.simulate(t, p, 10_000.0, 0.3, risk, compound).collect()
    sizes, days = by_hand(rows, price, 10_000.0, 0.3, risk, compound)
    assert {(r["account"], r["id"]) for r in got if r["id"] is not None} == set(sizes) and len(got) == len(sizes) + len(days)
    for r in got:
        if r["id"] is not None:
            assert math.isclose(r["size"], sizes[r["account"], r["id"]], rel_tol=1e-9)
        else:
            assert all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip((r["opening"], r["balance"], r["equity"]), days[r["account"], r["day"]]))
    assert len({round(v, 6) for v in sizes.values()}) > 10
    assert accounts.simulate(t.limit(0), p, 1e4, 0.3, risk).count() == 0


def test_flat_is_the_simulation_at_size_one(spark):
    rows = [r for r in positions(9) if r[0]]
    t = spark.createDataFrame(rows, TRADE)
    p = spark.createDataFrame([(m, d, 70.0 + d) for m in "xy" for d in range(20)], "market string, day int, close double")
    key = lambda df: {(r["account"], r["day"]): tuple(round(r[c], 6) for c in ("opening", "balance", "equity")) for r in df.collect()}
    flat = accounts.flat(t, p, 1e4)
    assert key(flat) == key(accounts.simulate(t, p, 1e4, 0.06, lambda used: 1.0).where("id IS NULL"))
    days = accounts.scenario_days(flat.withColumn("minimum", F.least("opening", "equity")), t, 1e4)
    assert accounts.discontinuous(days, 1e4, 1e-6).count() == 0
    assert accounts.discontinuous(days.withColumn("opening", F.col("opening") + (F.col("day") == 3).cast("double")), 1e4, 1e-6).count() > 0


def test_diagnostics(spark):
    rows = [("a", 1, 100.0, 110.0, 105.0, 96.0), ("a", 2, 110.0, 90.0, 90.0, 104.0), ("a", 3, 0.0, 0.0, 0.0, 0.0)]
    d = spark.createDataFrame(rows, "account string, day int, opening double, balance double, equity double, minimum double")
    got = accounts.diagnostics(d, 100.0, 0.06, 0.04).orderBy("day").collect()
    assert [r["floor"] for r in got] == [100.0, 100.0, 100.0] and [r["trailing_breach"] for r in got] == [True, False, True]
    assert [r["daily_breach"] for r in got] == [False, True, False] and math.isinf(got[2]["daily_loss"])


def test_mean_bounds_and_states(spark):
    values = [Decimal("0.30"), Decimal("-0.1"), Decimal("0.250"), Decimal("0.05"), Decimal("-0.4"), Decimal("0.2")]
    b = paths.mean_bounds(spark, values, 2, 0.95, 1000, 4)
    means = sorted(sum(values[i] for i in row) / 6 for c in range(2) for row in inference.indices(6, 2, 500, 4, c))
    assert (b["mean"], b["lower"], b["upper"]) == (sum(values) / 6, means[49], means[949])
    state = lambda v, end, trades: paths.forward_state(spark, [Decimal(x) for x in v], dt.date(2020, 1, 31), end, trades, 2, 200)
    late, mid, early = dt.date(2022, 7, 31), dt.date(2021, 7, 31), dt.date(2021, 7, 30)
    assert state(["50"] * 9, late, 2400) == "PASS" and state(["-1"] * 9, late, 2400) == "FAIL"
    assert state(["-1"] * 9, mid, 1400) == "FUTILITY_STOP" and state(["-1"] * 9, early, 1400) == "NO_DECISION" and state(["50"] * 9, mid, 2400) == "NO_DECISION"
    with pytest.raises(ValueError):
        state(["1"], dt.date(2020, 1, 1), 1)


def test_expectation_band(spark):
    r = spark.createDataFrame([(1.0,)] * 3 + [(-1.0,), (None,)], "r double")
    got = paths.expectation_band(r, "r", 50).orderBy("trade").collect()
    assert [x["trade"] for x in got] == list(range(1, 51)) and abs(got[-1]["p50"] - 25) <= 2 and got[-1]["p05"] < 18 < 32 < got[-1]["p95"]
    assert paths.expectation_band(r.limit(0), "r", 50).count() == 0


def test_streams_keep_what_all_have(spark):
    full = [(18, c, i, w, float(w)) for c in "pq" for i in "mn" for w in (1, 2, 3)]
    rows = [r for r in full if r != (18, "q", "n", 2, 2.0)] + [(18, "p", "only", 1, 9.0)] + [(24, "p", "m", 1, 1.0)]
    cells = spark.createDataFrame(rows, "train_months int, candidate string, instrument string, label int, value double")
    got = sorted((r["train_months"], r["candidate"], r["label"], r["value"]) for r in monitoring.candidate_streams(cells).collect())
    assert got == [(18, c, w, float(w)) for c in "pq" for w in (1, 3)]


def test_open_risk_and_pooling(spark):
    p = spark.createDataFrame([("a", "m", 1.0), ("a", "z", None), ("a", "k", None), ("a", "z", None), ("b", "m", 2.0)], "account string, market string, risk double")
    got = {r["account"]: (r["total"], r["unpriceable"], r["known"]) for r in monitoring.open_risk(p, ["account"]).collect()}
    assert got == {"a": (1.0, ["k", "z", "z"], False), "b": (2.0, [], True)}
    part = lambda *rows: spark.createDataFrame(rows, "cohort string, source string, day int, r double")
    assert selection.pooled([part(("c", "live", 1, 0.1)), part(("c", "live", 2, 0.2))]).count() == 2
    for bad in (("d", "live", 2, 0.2), ("c", "paper", 2, 0.2), ("c", "live", 1, 0.2)):
        with pytest.raises(ValueError):
            selection.pooled([part(("c", "live", 1, 0.1)), part(bad)])


def test_texts_and_sizes(spark):
    x = spark.createDataFrame([("100.00", "12:AB", "bot 12:AB or 12"), ("-0.50", "", "same"), ("0.00", None, "same"), (None, "12:", "12")], "d string, token string, said string")
    got = x.select(tt.decimal_text(F.col("d").cast("decimal(12,2)")).alias("d"), tt.redacted(F.col("said"), F.col("token")).alias("m")).collect()
    assert [tuple(r) for r in got] == [("100", "bot *** or ***"), ("-0.5", "same"), ("0", "same"), (None, "***")]
    one = lambda loss: spark.range(1).select(px.entry_order(F.lit(100.0), F.lit(True), F.lit(1.0), F.lit(2.0), F.lit(10.0), F.lit(0.01), F.lit(0.1), 0.01, 0.01, 5.0, 2, loss).alias("o")).first()["o"]
    plain = one(None)
    assert (round(plain["volume"], 8), round(plain["risk"], 8), plain["sl"], plain["tp"]) == (1.0, 10.0, 99.0, 102.0)
    dear = one(lambda v: v * 12.5)
    assert round(dear["volume"], 8) == 0.8 and dear["risk"] <= 10
    assert one(lambda v: v * 5000.0) is None and round(one(lambda v: F.lit(None).cast("double"))["volume"], 8) == 1.0
