"""Strict price scans: every refusal, exact decimals, blocks of one file."""

from decimal import Decimal

import pytest

from sparkfolio.sources import prices

GOOD = [("m", 0, 0, "2024-01-01 00:00:00", "1.10", "1.30", " 1.2000 "), ("m", 0, 1, "2024-01-01 04:00:00", "1", "2.", "1.5e0"), ("m", 9, 7, "2024-01-01 08:00:00", "0.0000000001", "3", "+2"), ("b", 0, 0, "2024-01-01 00:00:00", "-5", "7", "6")]


def texts(spark, rows):
    x = spark.createDataFrame(rows, "market string, block long, line long, t string, low string, high string, close string").repartition(3)
    return x.withColumn("ts", x["t"].cast("timestamp_ntz")).drop("t")


def test_scan(spark, tmp_path):
    got = {(r["market"], r["ts"].hour): (r["low"], r["high"], r["close"]) for r in prices.write_scan(texts(spark, GOOD), f"file://{tmp_path}/a").collect()}
    assert got["m", 0] == (Decimal("1.1"), Decimal("1.3"), Decimal("1.2")) and got["m", 4] == (1, 2, Decimal("1.5")) and got["m", 8][0] == Decimal("1E-10") and got["b", 0] == (-5, 7, 6)
    assert prices.write_scan(texts(spark, []), f"file://{tmp_path}/b").count() == 0


@pytest.mark.parametrize(
    "row, reason",
    [
        (("m", 9, 8, "2024-01-01 08:00:00", "1", "1", "1"), "1 repeated"), (("m", 9, 8, "2024-01-01 06:00:00", "1", "1", "1"), "1 unordered"), (("m", 9, 8, None, "1", "1", "1"), "1 without_time"),
        (("m", 9, 8, "2024-01-02 00:00:00", "NaN", "1", "1"), "1 not_finite"), (("m", 9, 8, "2024-01-02 00:00:00", "1", "Infinity", "1"), "1 not_finite"), (("m", 9, 8, "2024-01-02 00:00:00", "1", "1", ""), "1 not_finite"),
        (("m", 9, 8, "2024-01-02 00:00:00", "1", "1", None), "1 not_finite"), (("m", 9, 8, "2024-01-02 00:00:00", "x1", "1", "1"), "1 not_finite"), (("m", 9, 8, "2024-01-02 00:00:00", "0.00000000001", "1", "1"), "1 inexact"),
        (("m", 9, 8, "2024-01-02 00:00:00", "1" * 19, "1", "1"), "1 inexact"),
    ],
)
def test_refusals(spark, tmp_path, row, reason):
    path = f"{tmp_path}/a"
    with pytest.raises(ValueError, match=reason):
        prices.write_scan(texts(spark, [*GOOD, row]), f"file://{path}")
    assert not (tmp_path / "a").exists()


def test_exports_in_their_order(spark, tmp_path):
    head = "<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\t<VOL>\t<SPREAD>\n"
    line = lambda day, hour: f"2024.01.{day:02d}\t{hour:02d}:00:00\t1.5\t2.5\t1.25\t1.75\t1\t0\t3\n"
    (tmp_path / "in").mkdir()
    for name in ("A", "B"):
        (tmp_path / f"in/{name}.csv").write_text(head + "".join(line(d, h) for d in range(1, 29) for h in range(0, 24, 4)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # many blocks a file
        x = prices.export_texts(spark, f"file://{tmp_path}/in")
        assert x.select("block").distinct().count() > 3
        assert prices.write_scan(x, f"file://{tmp_path}/out").count() == 2 * 28 * 6
        (tmp_path / "in/C.csv").write_text(head + line(2, 0) + line(1, 0))
        with pytest.raises(ValueError, match="1 unordered"):
            prices.write_scan(prices.export_texts(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/again")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
