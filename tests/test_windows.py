"""Walk-forward windows by hand, and window membership with and without the broadcast."""

import datetime as dt

import pytest

from sparkfolio.operators import joins, ledger, walkforward


def test_windows(spark):
    got = walkforward.rolling_windows(spark, "2020-01-01", "2023-01-01", 12, 6, 6).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in got] == [0, 1, 2, 3]
    assert (got[0]["test_start"], got[0]["test_end"]) == (dt.datetime(2021, 1, 1), dt.datetime(2021, 7, 1)) and got[1]["train_start"] == dt.datetime(2020, 7, 1)
    got = walkforward.rolling_windows(spark, "2020-01-01", "2023-01-01", 12, 6, 6, 7).orderBy("ordinal").collect()
    assert len(got) == 3 and all(r["test_start"] == r["train_end"] + dt.timedelta(7) for r in got)
    got = walkforward.rolling_windows(spark, "2020-01-31 06:00:00", "2020-08-01", 1, 1, 1).orderBy("ordinal").collect()
    assert [r["train_start"] for r in got] == [dt.datetime(2020, m, d, 6) for m, d in ((1, 31), (2, 29), (3, 29), (4, 29), (5, 29))]
    assert walkforward.rolling_windows(spark, "2020-01-01", "2020-02-01", 12, 6, 6).count() == 0


@pytest.mark.parametrize("most", [10_000, 1])
def test_member(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "MOST_WINDOWS", most)
    at = lambda d: dt.datetime(2020, 1, d)
    windows = spark.createDataFrame([("a", at(2), at(4), 0), ("a", at(6), at(8), 1), ("b", at(1), at(20), 2)], "k string, s timestamp_ntz, e timestamp_ntz, label int")
    events = spark.createDataFrame([("a", at(d), d) for d in range(1, 12)] + [("b", at(3), 99), (None, at(3), 98)], "k string, ts timestamp_ntz, n int")
    got = sorted((r["n"], r["label"]) for r in joins.member(events, windows, ["k"], "ts", "s", "e", "label").collect())
    assert got == [(2, 0), (3, 0), (4, 0), (5, 0), (6, 1), (7, 1), (8, 1), (99, 2)]


def test_balances(spark):
    rows = [("x", 10 + 50_000 * (k // 3), k, f"{(-1) ** k * k}.25") for k in range(12)] + [("y", 5, 1, "7"), (None, 5, 2, "3")]
    led = spark.createDataFrame(rows, "account string, time long, ticket long, amount string").withColumn("amount", ledger.F.col("amount").cast(ledger.MONEY))
    got = {(r["account"], r["ticket"]): float(r["balance"]) for r in ledger.equity(led, 100.0).collect()}
    total, want = {}, {}
    for a, _, t, v in sorted(rows, key=lambda r: r[1:3]):
        total[a] = total.get(a, 0) + float(v)
        want[a, t] = 100 + total[a]
    assert got == want
    back = {(r["account"], r["ticket"]): (float(r["before"]), float(r["after"])) for r in ledger.backward(led, 50.0).collect()}
    assert back == {k: (50 - total[k[0]] + v - 100 - float(next(r[3] for r in rows if (r[0], r[2]) == k)), 50 - total[k[0]] + v - 100) for k, v in want.items()}
