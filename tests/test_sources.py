"""Exports, catalogue, artifacts and publication on small files; goldens by hand."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from sparkfolio.sources import artifacts, files, publish, vendor

HEAD = "<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\t<VOL>\t<SPREAD>\n"
ROWS = ["2020.01.02\t00:00:00\t1517.97\t1521.37\t1517.23\t1519.44\t500\t0\t2\n", "2020.01.02\t04:00:00\t1519.44\t1520.00\t1518.00\t1519.00\t500\t0\t0\n"]


def times(spark, rows, zone=vendor.tx.SERVER_ZONE, hours=0):
    x = spark.createDataFrame([tuple(r.split(" ")) for r in rows], "d string, t string")
    return [r[0] for r in x.select(vendor.stamp(F.col("d"), F.col("t"), zone, hours)).collect()]


def test_stamps(spark):
    assert times(spark, ["2024.07.01 00:00:00", "2024.01.15 00:00:00"]) == [dt.datetime(2024, 6, 30, 21), dt.datetime(2024, 1, 14, 22)]
    # skipped and repeated wall clocks of the changes to and from summer time
    assert times(spark, ["2024.03.31 03:30:00", "2024.10.27 03:30:00"]) == [dt.datetime(2024, 3, 31, 1), dt.datetime(2024, 10, 27, 0, 30)]
    assert times(spark, ["2024.07.01 03:00:00"], None) == [dt.datetime(2024, 7, 1, 3)]
    assert times(spark, ["2024.07.01 03:00:00"], None, 3) == [dt.datetime(2024, 7, 1)]


def test_catalogue(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "GOLD.csv").write_text(HEAD + "".join(ROWS))
    (tmp_path / "in" / "ZERO.csv").write_text(HEAD + ROWS[1])
    src, at = str(tmp_path / "in"), str(tmp_path / "cat")
    assert {tuple(r) for r in vendor.stale(spark, src, at).collect()} == {("GOLD", "absent"), ("ZERO", "absent")}
    assert {r["market"]: r["bars"] for r in vendor.write_catalogue(spark, src, at, "0.01").collect()} == {"GOLD": 2, "ZERO": 1}
    got = {(r["market"], r["ts"], r["side"]): (float(r["open"]), float(r["close"])) for r in vendor.read_catalogue(spark, src, at).collect()}
    t0, t1 = dt.datetime(2020, 1, 1, 22), dt.datetime(2020, 1, 2, 2)
    assert got["GOLD", t0, "bid"] == (1517.97, 1519.44) and got["GOLD", t0, "ask"] == (1517.99, 1519.46)
    assert got["GOLD", t1, "ask"] == (1519.46, 1519.02) and got["ZERO", t1, "ask"] == (1519.44, 1519.0) and len(got) == 6
    with pytest.raises(ValueError, match="GOLD .frame.*ZERO .frame"):
        vendor.read_catalogue(spark, src, at, None)
    (tmp_path / "in" / "GOLD.csv").write_text(HEAD + ROWS[0])
    with pytest.raises(ValueError, match="GOLD .source"):
        vendor.read_catalogue(spark, src, at)
    vendor.write_catalogue(spark, src, at, "0.01")
    assert vendor.read_catalogue(spark, src, at).where("market = 'GOLD'").count() == 2  # the later bar went
    (tmp_path / "in" / "BAD.csv").write_text(HEAD.replace("OPEN", "OPENED") + ROWS[0])
    with pytest.raises(Exception):
        vendor.read_export(spark, str(tmp_path / "in" / "BAD.csv")).collect()


def test_last_closed(spark):
    x = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 4 * h)) for h in range(5)] + [(None, dt.datetime(2024, 1, 1))], "market string, ts timestamp_ntz")
    got = vendor.last_closed(x, ["market"], 2, F.lit("2024-01-01 16:00:00").cast("timestamp_ntz"))
    assert {(r["market"], r["ts"].hour) for r in got.collect()} == {("a", 8), ("a", 12), (None, 0)}


def matrix(tmp_path, text):
    (tmp_path / "m.csv").write_text(text)
    return str(tmp_path / "m.csv")


def test_candidate_family(spark, tmp_path):
    meta = {"persisted_candidates": ["a", "b"], "persisted_candidate_count": 2, "trial_counts": {"formal": 2}}
    body = "".join(f"2024-01-{d:02d},0.{d},-1\n" for d in range(1, 4))
    read = lambda text, m=meta, least=3: artifacts.candidate_family(spark, matrix(tmp_path, text), {"a", "b"}, m, least)
    got = {(str(r["day"]), r["candidate"]): r["value"] for r in read("day,a,b\n" + body).collect()}
    assert len(got) == 6 and got["2024-01-02", "a"] == decimal.Decimal("0.2")
    for text, m, least in [("day,a,a\n" + body, meta, 3), ("day,a,c\n" + body, meta, 3), ("day,a,b\n" + body, {**meta, "persisted_candidate_count": 3}, 3), ("day,a,b\n" + body, meta, 4), ("day,a,b\n" + body + "2024-01-05,1,1\n", meta, 3),
                           ("day,a,b\n" + body + "2024-01-03,1,1\n", meta, 3), ("day,a,b\n" + body + "x,1,1\n", meta, 3), ("day,a,b\n" + body + "2024-01-04,NaN,1\n", meta, 3), ("", meta, 3)]:
        with pytest.raises(ValueError):
            read(text, m, least)


def test_scenarios(spark, tmp_path):
    names = [c.split()[0] for c in artifacts.SCENARIO.split(", ")][1:]
    make = lambda days: spark.createDataFrame([(dt.date(2024, 1, d), *([decimal.Decimal("1.5")] * 5), 3, decimal.Decimal(0)) for d in days], ", ".join(artifacts.SCENARIO.split(", ")[1:])).select(names)
    artifacts.write_scenarios(make([2, 1, 3]), str(tmp_path / "a"))
    assert artifacts.read_scenarios(spark, str(tmp_path / "a")).count() == 3
    for k, days in enumerate([[1, 3], [1, 1], []]):
        artifacts.write_scenarios(make(days) if days else make([1]).limit(0), str(tmp_path / f"b{k}"))
        with pytest.raises(ValueError):
            artifacts.read_scenarios(spark, str(tmp_path / f"b{k}"))


def test_studies_swaps_observations(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for n in ("2024-01", "2024-02"):
        (tmp_path / "s" / f"{n}.csv").write_text("name,error\na,\nb,boom\n")
    at = files.newest_by_name(spark, str(tmp_path / "s"))
    assert at.endswith("2024-02.csv") and [r["name"] for r in artifacts.read_study(spark, at).collect()] == ["a"]
    swaps = spark.createDataFrame([("GOLD", "points", -1.0, -1.5, 2, 0.01, 1.0)], f"symbol string, {artifacts.SWAP}")
    artifacts.write_swaps(spark, swaps, str(tmp_path), "swaps.json")
    assert artifacts.read_swaps(spark, str(tmp_path / "swaps.json")).collect() == swaps.collect()
    path = str(tmp_path / "obs")
    day = lambda d, v="0.10": spark.createDataFrame([(dt.date(2024, 1, d), decimal.Decimal(v))], "loss_day date, daily_r decimal(10,2)")
    artifacts.append_observations(spark, day(1), path, "c", "live")
    artifacts.append_observations(spark, day(2), path, "c", "live")
    for bad in (lambda: artifacts.append_observations(spark, day(1), path, "c", "live"), lambda: artifacts.append_observations(spark, day(3), path, "c", "paper"), lambda: artifacts.append_observations(spark, day(4).union(day(4)), path, "c", "live")):
        with pytest.raises(ValueError):
            bad()
    assert artifacts.observations(spark, path, "c", "live").count() == 2
    more, again = str(tmp_path / "more"), str(tmp_path / "again")
    artifacts.append_observations(spark, day(3), more, "c", "live")
    artifacts.append_observations(spark, day(2), again, "c", "live")
    assert artifacts.pooled(spark, [path, more], "c", "live").count() == 3
    for places in ([], [path, again]):
        with pytest.raises(ValueError):
            artifacts.pooled(spark, places, "c", "live")


def test_publish(spark, tmp_path):
    run = publish.Run(spark, str(tmp_path / "run"), ("one", "two"))
    df = spark.range(5)
    with pytest.raises(ValueError):
        run.publish("two", {"t": df})
    run.publish("one", {"t": df}, {"x": "1"})
    run.publish("two", {"u": df.select((F.col("id") * 2).alias("v"))})
    assert run.faults({"x": "1"}) == [] and run.table("two", "u").count() == 5
    assert run.faults({"x": "2"}) == ["one: input x changed"]
    df.limit(3).write.mode("overwrite").parquet(str(tmp_path / "run" / "two" / "u"))
    assert len(run.faults()) == 1 and run.faults()[0].startswith("two/u: ValueError")
    with pytest.raises(Exception):  # fails before the move: what was published stays
        run.publish("one", {"t": df.select(F.raise_error(F.lit("boom")).alias("x"))})
    assert run.table("one", "t").count() == 5
    run.publish("one", {"t": df.limit(2)})
    assert run.faults() == ["two: not published"]
    run.folder.create("_lock", "x")
    with pytest.raises(FileExistsError):
        run.publish("one", {"t": df})
    name = publish.register_cohort(spark, str(tmp_path / "reg"), {"a": 1}, {})
    assert len(name) == 36
    with pytest.raises(FileExistsError):
        publish.register_cohort(spark, str(tmp_path / "reg"), {"a": 1}, {})
    assert publish.risk_policy("Flat") == ("flat", 0.15) and publish.risk_policy("kelly:0.1") == ("kelly", 0.1)
    with pytest.raises(ValueError):
        publish.risk_policy("all-in")
