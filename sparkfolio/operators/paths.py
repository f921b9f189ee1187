"""Resampled paths of scenario days, their risk, and the decision of a forward test."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import inference

#: Block lengths tried beside the estimated one.
BLOCKS = (5, 10, 20, 60)
#: Fixed values of the forward test: months, trades and confidence of its two looks.
EFFICACY, FUTILITY = (30, 2400, 0.95), (18, 1400, 0.99)
#: Days of a series that the driver takes: one row a day, so some 270 years.
MOST_DAYS = 100_000


def daily_values(df: DataFrame, day: str, value: str) -> list:
    """A series in order of its days, one value a day, checked for its size before it is collected."""
    rows = df.select(day, value).orderBy(day).limit(MOST_DAYS + 1).collect()
    if len(rows) > MOST_DAYS:
        raise ValueError(f"a series of over {MOST_DAYS} days")
    return [r[1] for r in rows]


def expectation_band(r: DataFrame, value: str, trades: int, sims: int = 2000, seed: int = 7) -> DataFrame:
    """trade, p05, p50, p95 of the running sum over simulated sequences of independent draws. The values come as their
    counts, which are checked for their number."""
    counts = r.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).count().orderBy("v").limit(1_000_001).collect()
    if len(counts) > 1_000_000:
        raise ValueError("over a million different values")
    spark = r.sparkSession
    if not counts:
        return spark.createDataFrame([], "trade long, p05 double, p50 double, p95 double")
    weight = np.array([c["count"] for c in counts], float)
    shared = spark.sparkContext.broadcast((np.array([c["v"] for c in counts]), np.cumsum(weight) / weight.sum()))
    sizes = [(c, min(250, sims - c * 250)) for c in range(math.ceil(sims / 250))]

    def run(it):
        values, upto = shared.value
        for pdf in it:
            for c, size in zip(pdf["chunk"], pdf["size"]):
                at = np.searchsorted(upto, np.random.default_rng([seed, int(c)]).random((size, trades)), "right")
                sums = np.cumsum(values[np.minimum(at, len(values) - 1)], axis=1)
                yield pd.DataFrame({"trade": np.tile(np.arange(1, trades + 1), size), "total": sums.ravel()})

    x = spark.createDataFrame(sizes, "chunk long, size long").repartition(len(sizes)).mapInPandas(run, "trade long, total double")
    return x.groupBy("trade").agg(*(F.percentile("total", p).alias(f"p{round(p * 100):02d}") for p in (0.05, 0.5, 0.95)))


def mean_bounds(spark: SparkSession, values: list[Decimal], mean_block: int, confidence: float, replications: int = inference.REPLICATIONS, seed: int = inference.SEED) -> Row:
    """mean, lower, upper of a daily series: nearest-rank quantiles of resampled means. Sums are whole numbers of the
    series' last digit, so means and ranks are exact."""
    digits = max(0, *(-v.as_tuple().exponent for v in values))
    whole, n = np.array([int(v.scaleb(digits)) for v in values], object), len(values)
    if sum(abs(v) for v in whole) >= 2**53:
        raise ValueError("a series with too many digits")
    data = spark.sparkContext.broadcast(whole.astype(np.int64))
    chunk = inference.CHUNK
    sizes = [(c, min(chunk, replications - c * chunk)) for c in range(math.ceil(replications / chunk))]

    def run(it):
        for pdf in it:
            for c, size in zip(pdf["chunk"], pdf["size"]):
                yield pd.DataFrame({"total": data.value[inference.indices(n, mean_block, size, seed, int(c))].sum(axis=1)})

    sums = spark.createDataFrame(sizes, "chunk long, size long").repartition(len(sizes)).mapInPandas(run, "total long")
    at = lambda p: f"percentile_disc({p:.12g}) WITHIN GROUP (ORDER BY total)"
    got = sums.agg(F.expr(at(1 - confidence)).cast("long").alias("lower"), F.expr(at(confidence)).cast("long").alias("upper")).first()
    mean = lambda total: Decimal(int(total)).scaleb(-digits) / n
    return Row(mean=mean(int(whole.sum())), lower=mean(got["lower"]), upper=mean(got["upper"]))


def forward_state(spark: SparkSession, values: list[Decimal], start: dt.date, as_of: dt.date, trades: int, mean_block: int, replications: int = inference.REPLICATIONS, seed: int = inference.SEED) -> str:
    """PASS, FAIL or INCONCLUSIVE once months and trades of the efficacy look are reached: by the bounds of mean daily
    R against 0.10 R a trade; FUTILITY_STOP from the earlier look on if the upper bound is below 0; else NO_DECISION,
    and nothing is computed before a look is due."""
    due = lambda look: as_of >= (pd.Timestamp(start) + pd.DateOffset(months=look[0])).date() and trades >= look[1]
    if as_of < start:
        raise ValueError("the day of the decision is before the start")
    if not values:
        raise ValueError("a forward test without a day")
    if due(EFFICACY):
        b, need = mean_bounds(spark, values, mean_block, EFFICACY[2], replications, seed), Decimal("0.10") * trades / len(values)
        return "PASS" if b["lower"] > need else "FAIL" if b["upper"] < need else "INCONCLUSIVE"
    if due(FUTILITY) and mean_bounds(spark, values, mean_block, FUTILITY[2], replications, seed)["upper"] < 0:
        return "FUTILITY_STOP"
    return "NO_DECISION"
