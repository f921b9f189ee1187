"""Diagnostics of a whole family on the windows that all its tasks share: deflated Sharpe ratios and the probability of
overfitting, or the reason why there are none."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import gram, inference, stats, walkforward

#: How sure a candidate's Sharpe must be, how likely overfitting may be, and windows at least.
SURE, OVERFIT, LEAST = 0.90, 0.20, 4


def common_bounds(df: DataFrame, task: str, start: str, end: str) -> DataFrame:
    """One row: the latest first start and the earliest last end over the tasks; empty spans (start not before end)
    give none. A task is summed up before the tasks are compared."""
    x = df.groupBy(task).agg(F.min(start).alias("__a"), F.max(end).alias("__b"))
    return x.agg(F.max("__a").alias(start), F.min("__b").alias(end)).where(F.col(start) < F.col(end))


def synchronized(cells: DataFrame, task: str, candidate: str, label: str, value: str) -> DataFrame:
    """candidate, label, value: the mean over all tasks on the labels that every task has for every candidate. By counts:
    no set of labels is gathered. A cell that comes twice fails the query."""
    c = cells.groupBy(task, candidate, label).agg(F.count("*").alias("__n"), F.max(value).alias("__v"))
    once = F.when(F.col("__n") > 1, F.raise_error(F.lit("a cell comes twice")).cast("double")).otherwise(F.col("__v"))
    c = c.select(task, candidate, label, once.alias("__v"))
    pairs = cells.select(task, candidate).distinct().agg(F.count("*").alias("pairs")).withColumn("one", F.lit(1))
    full = c.groupBy(label).agg(F.count("*").alias("n")).withColumn("one", F.lit(1)).join(F.broadcast(pairs), "one").where("n = pairs").select(label)  # one row a label; pairs is one
    return c.join(full, label).groupBy(candidate, label).agg(F.avg("__v").alias(value))


def family_diagnostics(matrix: DataFrame, candidate: str, label: str, value: str, formal: int, manual: int = 5, sure: float = SURE, overfit: float = OVERFIT, least: int = LEAST) -> DataFrame:
    """candidate, status, reason, labels, rho_bar, n_eff, sharpe, skew, kurt, dsr_effective, dsr_nominal, dsr_ok, pbo,
    pbo_ok, passed. matrix: one row a candidate and label. A family of another size than `formal`, too few labels, a
    cell that is missing or not finite, a candidate without spread or equal Sharpe ratios give one row of status
    unavailable with its reason, and no diagnostics: nothing is dropped to make a matrix fit."""
    spark, kinds = matrix.sparkSession, "status string, reason string, labels long, rho_bar double, n_eff double, sharpe double, skew double, kurt double, dsr_effective double, dsr_nominal double, dsr_ok boolean, pbo double, pbo_ok boolean, passed boolean"
    x = matrix.select(F.col(candidate).alias("candidate"), F.col(label).alias("label"), F.col(value).cast("double").alias("value"))
    good = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    n = x.agg(F.countDistinct("candidate").alias("m"), F.countDistinct("label").alias("labels"), F.count("*").alias("cells"), F.count_if(~F.coalesce(good, F.lit(False))).alias("odd")).first()

    def unavailable(reason: str) -> DataFrame:
        return spark.createDataFrame([(None, "unavailable", reason, n["labels"], *[None] * 11)], f"candidate {matrix.schema[candidate].dataType.simpleString()}, {kinds}")

    if n["m"] != formal:
        return unavailable(f"{n['m']} candidates for {formal} formal ones")
    if n["labels"] < least or not walkforward.usable_groups(n["labels"]):
        return unavailable(f"{n['labels']} windows, fewer than {least}")
    if n["cells"] != n["m"] * n["labels"] or n["odd"]:
        return unavailable(f"{n['cells']} cells of {n['m'] * n['labels']}, {n['odd']} of them not finite")
    place = x.select("label").distinct().withColumn("at", F.row_number().over(Window.orderBy("label")))  # one row a label
    pairs = gram.correlations(gram.pair_moments(x.join(place, "label"), "candidate", "at", "value"))
    r = pairs.agg(F.avg("rho").alias("rho"), F.count_if(F.col("rho").isNull()).alias("bare")).first()
    if r["bare"]:
        return unavailable(f"{r['bare']} correlations are undefined")
    rho = min(1.0, max(0.0, r["rho"])) if r["rho"] is not None else 0.0
    n_eff = min(float(manual + formal), manual + rho + (1 - rho) * formal)
    m = stats.sharpe(x, ["candidate"], "value").drop("n").join(stats.moments(x, ["candidate"], "value"), "candidate")
    variance, most = m.agg(F.var_samp("sharpe"), F.max(F.abs("sharpe"))).first()
    if variance is None or not (variance > (gram.ROUNDING * most) ** 2 and math.isfinite(variance)):
        return unavailable("Sharpe ratios do not vary")
    y = inference.deflated_sharpe(m, n_eff, variance).withColumnRenamed("dsr", "dsr_effective").drop("psr")
    y = y.join(inference.deflated_sharpe(m, manual + formal, variance).select("candidate", F.col("dsr").alias("dsr_nominal")), "candidate")
    pbo = walkforward.pbo(x, "candidate", "label", "value").first()["pbo"]
    ok, pbo_ok = F.coalesce(F.col("dsr_effective") >= sure, F.lit(False)), pbo is not None and pbo <= overfit
    return y.select(
        "candidate", F.lit("available").alias("status"), F.lit(None).cast("string").alias("reason"), F.lit(n["labels"]).cast("long").alias("labels"), F.lit(rho).alias("rho_bar"), F.lit(n_eff).alias("n_eff"),
        "sharpe", "skew", "kurt", "dsr_effective", "dsr_nominal", ok.alias("dsr_ok"), F.lit(pbo).cast("double").alias("pbo"), F.lit(pbo_ok).alias("pbo_ok"), (ok & F.lit(pbo_ok)).alias("passed"),
    )
