"""Typed deals with every refusal, positions that can't be rebuilt, and the reference of a back-test."""

from decimal import Decimal

import pytest

from sparkfolio.operators import ledger, stats
from sparkfolio.sources import deals

GOOD = {"ticket": "1", "time": "100", "type": "0", "entry": "0", "position_id": "9", "symbol": "", "volume": "0.5", "price": "1e3", "profit": "-1.25", "swap": "0", "commission": "-0.0500", "fee": None}


def raw(spark, **changes):
    return spark.createDataFrame([tuple((GOOD | changes)[c] for c in deals.FIELDS)], ", ".join(f"{c} string" for c in deals.FIELDS))


def test_typed(spark):
    r = deals.typed_deals(raw(spark)).first()
    assert (r["ticket"], r["symbol"], r["price"], r["profit"], r["commission"], r["fee"]) == (1, "", 1000.0, Decimal("-1.25"), Decimal("-0.05"), 0)
    assert deals.typed_deals(raw(spark).drop("fee")).first()["fee"] == 0
    assert deals.typed_deals(raw(spark).limit(0)).count() == 0


@pytest.mark.parametrize("change", [{"time": None}, {"ticket": "x"}, {"type": "1.5"}, {"volume": "NaN"}, {"price": "Infinity"}, {"profit": "1.00001"}, {"swap": ""}, {"symbol": None}, {"commission": "1e30"}, {"fee": "none"}])
def test_refused(spark, change):
    with pytest.raises(Exception, match=f"is refused: {next(iter(change))}"):
        deals.typed_deals(raw(spark, **change)).collect()


def test_every_fault_of_a_deal_is_named(spark):
    with pytest.raises(Exception, match="deal 1 is refused: time, swap"):
        deals.typed_deals(raw(spark, time=None, swap="?")).collect()


def test_positions_that_cannot_be_rebuilt(spark):
    legs = [  # position, time, ticket, type, entry
        (1, 1, 1, 0, 0), (1, 2, 2, 1, 1), (2, 1, 3, 0, 0), (2, 2, 4, 0, 2), (2, 3, 5, 1, 1), (3, 1, 6, 0, 0), (3, 2, 7, 7, 0), (3, 3, 8, 4, 0), (3, 4, 9, 1, 3), (4, 1, 10, 0, 0), (4, 1, 11, 5, 0), (4, 2, 12, 1, 1), (5, 1, 13, 0, 0),
    ]
    money = Decimal("1.0000")
    rows = [(p, t, k, kind, entry, "X", money, money, money, money) for p, t, k, kind, entry in legs] + [(6, 1, 20, 2, 0, "", money, money, money, money)]
    d = spark.createDataFrame(rows, "position_id long, time long, ticket long, type int, entry int, symbol string, profit decimal(18,4), swap decimal(18,4), commission decimal(18,4), fee decimal(18,4)").repartition(3)
    got = {r["position_id"]: r["reasons"] for r in ledger.unreconstructable(d).collect()}
    assert got == {2: ["reversal"], 3: ["closed by another", "later entry of type 4", "later entry of type 7"], 4: ["later entry of type 5"]}
    assert [r["position_id"] for r in ledger.round_trips(d).collect()] == [1]
    first = spark.createDataFrame([(7, 1, 30, 5, 0, "X", *[money] * 4), (7, 2, 31, 1, 1, "X", *[money] * 4)], d.schema)
    with pytest.raises(Exception, match="unknown deal type 5"):
        ledger.round_trips(first).collect()


def test_reference_is_net_of_swaps(spark):
    rows = [("a", 1.0, -0.5), ("a", -1.0, None), ("b", 2.0, -2.5), ("b", 3.0, 0.0), ("c", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "market string, r double, swap_r double")
    got = {(r["market"], r["overall"]): r for r in stats.reference(df, "market").collect()}
    assert got.keys() == {("a", False), ("b", False), ("c", False), (None, True)}
    assert got["a", False]["expectancy"] == -0.25 and got["b", False]["profit_factor"] == 6.0 and got["c", False]["profit_factor"] == float("inf")
    assert got[None, True]["n"] == 5 and got[None, True]["profit_factor"] == pytest.approx((0.5 + 3 + 2) / 1.5)
    plain = {(r["market"], r["overall"]): r["expectancy"] for r in stats.reference(df.drop("swap_r"), "market").collect()}
    assert plain["b", False] == 2.5 and plain[None, True] == pytest.approx(1.2)
