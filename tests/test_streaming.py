"""Cycles against a replay over all bars, retries, and rolls of the loss day."""

import datetime as dt
import math

import pytest

from sparkfolio.operators import signals
from sparkfolio.streaming import cycles


def frame(spark, a, b, markets="pq"):
    """Bars a to b of a wave, four hours apart."""
    rows = []
    for m in markets:
        for i in range(a, b):
            o, c = (100 + 4 * math.sin(2 * math.pi * j / 37) + 0.35 * math.sin(2 * math.pi * i / 407) for j in (i, i + 1))
            rows.append((m, dt.datetime(2024, 1, 1) + dt.timedelta(hours=4 * i), o, max(o, c) + 0.15, min(o, c) - 0.15, c, 1))
    return spark.createDataFrame(rows, cycles.BAR)


LOOSE = signals.EntryRules(band_width=1.0, need_band=False, need_range=False, need_strength=False)


def test_cycles_equal_one_replay(spark, tmp_path):
    run = cycles.cycle(str(tmp_path), LOOSE)
    run(frame(spark, 0, 100), 0)
    run(frame(spark, 90, 150), 1)  # ten bars come again
    run(frame(spark, 90, 150), 1)  # the batch is retried
    run(frame(spark, 150, 199, "p"), 2)
    got = {(r["market"], r["ts"]): (r["buy"], r["sell"]) for r in cycles.decisions(spark, str(tmp_path)).collect()}
    every = frame(spark, 0, 150, "q").union(frame(spark, 0, 199, "p"))
    want = {(r["market"], r["ts"]): (r["buy"], r["sell"]) for r in signals.signal_table(every, ["market"], LOOSE).collect()}
    assert got == want and any(b for b, _ in got.values()) and any(s for _, s in got.values())


def test_a_failed_market_is_retried(spark, tmp_path):
    broken = tmp_path / "broken"
    broken.touch()
    flag = str(broken)

    def judge(bars):
        import os

        if bars["market"].iloc[0] == "p" and os.path.exists(flag):
            raise OSError("no route")
        return [False] * len(bars), [True] * len(bars)

    run = cycles.cycle(str(tmp_path / "out"), judge=judge)
    run(frame(spark, 0, 2), 0)
    got = {r["market"]: (r["sell"], r["error"]) for r in cycles.decisions(spark, str(tmp_path / "out")).collect()}
    assert got == {"p": (None, "OSError: no route"), "q": (True, None)}
    broken.unlink()
    run(frame(spark, 2, 3, "p"), 1)
    assert {(r["sell"], r["error"]) for r in cycles.decisions(spark, str(tmp_path / "out")).collect()} == {(True, None)}
    assert cycles.decisions(spark, str(tmp_path / "out")).count() == 5


def test_stream_of_bars(spark, tmp_path):
    frame(spark, 0, 60).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart without new bars adds nothing
        q = cycles.start(spark.readStream.schema(cycles.BAR).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), rules=LOOSE)
        q.awaitTermination()
    assert cycles.decisions(spark, str(tmp_path / "out")).count() == 120
    assert spark.read.parquet(str(tmp_path / "out" / "signals")).count() == 120


def test_day_rolls(spark, tmp_path):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [[("a", at(2, 12), 95.0), ("a", at(2, 13), 97.0), ("b", at(2, 12), 50.0), (None, at(2, 12), 1.0), ("a", at(3, 12), 104.0)], [("a", at(3, 13), 103.0), ("a", at(3, 23), 101.0), ("a", at(2, 14), 1.0)]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, "account string, ts timestamp, balance double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        x = spark.readStream.schema("account string, ts timestamp, balance double").parquet(str(tmp_path / "in"))
        q = cycles.day_rolls(x, {"a": 100.0}).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("account", "day", "day_start", "peak", "halted").collect())
    day = (dt.date(2024, 1, 2) - dt.date(1970, 1, 1)).days
    assert got == [("a", day, 100.0, 95.0, False), ("a", day + 1, 104.0, 104.0, False), ("a", day + 2, 101.0, 104.0, False), ("b", day, None, 50.0, True)]


def test_stable(spark):
    sizes = iter([1, 2, 2, 2])
    df, balance = cycles.stable(lambda: spark.range(next(sizes)), lambda: 5.0)
    assert df.count() == 2 and balance == 5.0
    sizes = iter(range(6))
    with pytest.raises(RuntimeError):
        cycles.stable(lambda: spark.range(next(sizes)), lambda: 5.0)
