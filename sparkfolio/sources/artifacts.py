"""Strict readers and writers of research artifacts: candidate matrices, scenarios, studies, swaps, observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Folder

#: Version and columns of the scenario file.
SCENARIO_VERSION = 2
SCENARIO = "schema_version int, source_date date, source_opening_balance decimal(28,8), close_realized_pnl decimal(28,8), close_equity_change decimal(28,8), opening_to_minimum_equity_change decimal(28,8), closing_balance_change decimal(28,8), trade_count int, daily_swap decimal(28,8)"
#: A swap specification.
SWAP = "mode string, swap_long double, swap_short double, rollover_py int, tick_value double, tick_size double"
EXACT = "decimal(38,12)"


def _refuse(checks: dict[str, Column], df: DataFrame, what: str) -> None:
    """One pass over df; ValueError naming every check that is true."""
    row = df.agg(*(c.alias(k) for k, c in checks.items())).first()
    bad = [k for k in checks if row[k]]
    if bad:
        raise ValueError(f"{what}: {', '.join(bad)}")


def _gaps(day: str) -> Column:
    """Whether days repeat or leave gaps. Rows of a table have no order, so days are judged as a set."""
    return (F.count(day) != F.countDistinct(day)) | (F.countDistinct(day) != F.datediff(F.max(day), F.min(day)) + 1)


def candidate_family(spark: SparkSession, path: str, expected: set[str], metadata: dict, least: int = 30) -> DataFrame:
    """day, candidate, value of a wide CSV of daily returns. ValueError unless names are unique, not empty, those
    expected and those of the metadata; dates are consecutive, at least `least`; and every value is a finite decimal."""
    header = (spark.read.text(path).first() or [""])[0].split(",")
    names = header[1:]
    declared = metadata.get("persisted_candidates"), metadata.get("persisted_candidate_count"), (metadata.get("trial_counts") or {}).get("formal")
    if not names or not all(names) or len(set(names)) != len(names):
        raise ValueError("candidate names must be unique and not empty")
    if set(names) != set(expected) or declared != (names, len(names), len(names)):
        raise ValueError("the family is not that of the study and its metadata")
    cols = [f"c{i}" for i in range(len(names))]
    wide = spark.read.schema(", ".join(f"{c} string" for c in ["day", *cols])).options(header=True, mode="FAILFAST").csv(path)
    cells = F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("candidate"), F.array(*cols).alias("value")))
    day = F.when(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr("try_cast(day as date)"))
    wide = wide.withColumn("day", day)
    _refuse({"bad dates": F.count_if(F.col("day").isNull()) > 0, f"fewer than {least} days": F.count("*") < least, "days not consecutive": _gaps("day")}, wide, path)
    x = wide.select("day", cells.alias("x")).select("day", "x.candidate", F.expr(f"try_cast(x.value as {EXACT})").alias("value"))
    _refuse({"values not finite": F.count_if(F.col("value").isNull()) > 0}, x, path)
    return x


def write_scenarios(df: DataFrame, path: str) -> None:
    """One row a loss day, in the file's columns; the version is added."""
    names = [c.split()[0] for c in SCENARIO.split(", ")]
    df.withColumn("schema_version", F.lit(SCENARIO_VERSION)).select(*names).repartitionByRange("source_date").sortWithinPartitions("source_date").write.mode("errorifexists").option("header", True).csv(path)


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """The rows; ValueError when there are none, a version or cell is another, or days repeat or leave gaps."""
    x = spark.read.schema(SCENARIO).options(header=True, enforceSchema=False, mode="FAILFAST").csv(path)
    empty = F.greatest(*(F.col(c).isNull().cast("int") for c in x.columns)) == 1
    _refuse({"empty": F.count("*") == 0, "version": F.count_if(F.col("schema_version") != SCENARIO_VERSION) > 0, "empty cells": F.count_if(empty) > 0, "days not contiguous": _gaps("source_date")}, x, path)
    return x.drop("schema_version")


def read_study(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a study without an error, without that column."""
    x = spark.read.options(header=True, inferSchema=True).csv(path)
    return x.where("error IS NULL").drop("error") if "error" in x.columns else x


def read_swaps(spark: SparkSession, path: str) -> DataFrame:
    """symbol and its swap specification, from a JSON object by symbol."""
    x = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, struct<{SWAP.replace(' ', ':').replace(',:', ',')}>>", {"mode": "FAILFAST"}).alias("m"))
    return x.select(F.explode("m").alias("symbol", "s")).select("symbol", "s.*")


def write_swaps(spark: SparkSession, swaps: DataFrame, folder: str, name: str) -> None:
    """swaps: one row an instrument of a broker, a small table. The file must not exist."""
    rows = swaps.select("symbol", *(c.split()[0] for c in SWAP.split(", "))).collect()
    value = {r["symbol"]: {k: v for k, v in r.asDict().items() if k != "symbol"} for r in rows}
    if len(value) != len(rows):
        raise ValueError("symbols repeat")
    Folder(spark, folder).create(name, value)


def append_observations(spark: SparkSession, new: DataFrame, path: str, cohort: str, source: str) -> None:
    """new: loss_day, daily_r (decimal), appended as JSON lines with exact decimals as text. ValueError when a day is
    null, repeats, or is there already, when a value is null, or when the cohort's source is another."""
    x = new.select(F.lit(cohort).alias("cohort"), F.lit(source).alias("source"), F.col("loss_day").cast("date").alias("loss_day"), F.col("daily_r").cast("string").alias("daily_r"))
    held = observations(spark, path, cohort, source).select("loss_day") if Folder(spark, path).exists("") else spark.createDataFrame([], "loss_day date")
    both = x.select("loss_day", "daily_r").unionByName(held.withColumn("daily_r", F.lit("")))
    _refuse({"a day repeats": F.count("loss_day") != F.countDistinct("loss_day"), "a null": F.count_if(F.col("loss_day").isNull() | F.col("daily_r").isNull()) > 0}, both, path)
    x.write.mode("append").json(path)


def observations(spark: SparkSession, path: str, cohort: str, source: str) -> DataFrame:
    """loss_day, daily_r of a cohort. ValueError when sources mix, a value is no decimal, or a day repeats."""
    x = spark.read.schema("cohort string, source string, loss_day date, daily_r string").option("mode", "FAILFAST").json(path).where(F.col("cohort") == cohort)
    x = x.select("loss_day", "source", F.expr(f"try_cast(daily_r as {EXACT})").alias("daily_r"))
    _refuse({"other sources": F.count_if(~F.col("source").eqNullSafe(F.lit(source))) > 0, "not a decimal": F.count_if(F.col("daily_r").isNull()) > 0, "a day repeats or is null": (F.count("*") != F.countDistinct("loss_day"))}, x, path)
    return x.drop("source")


def pooled(spark: SparkSession, paths: list[str], cohort: str, source: str) -> DataFrame:
    """The observations of one cohort held in several places. ValueError without a place, when sources mix, or when a
    day is in two of them."""
    if not paths:
        raise ValueError("nothing to pool")
    x = observations(spark, paths[0], cohort, source)
    for p in paths[1:]:
        x = x.unionByName(observations(spark, p, cohort, source))
    _refuse({"a day repeats": F.count("*") != F.countDistinct("loss_day")}, x, cohort)
    return x
