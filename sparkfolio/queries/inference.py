"""Resampling and multiple testing over the candidates' daily returns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import gram, inference, selection, stats
from ..sources import tables as tb
from .base import query
from .books import MATRIX, matrix

#: Cells of a family's matrix that the driver takes and every task is sent.
MOST_CELLS = 20_000_000


def _wide(spark, sf) -> tuple[list[str], np.ndarray]:
    """Days x candidates: a row a day whatever the number of trades; checked for its size before it is collected."""
    x = matrix(spark, sf).withColumn("ret", F.col("ret").cast("double"))
    n = x.agg(F.countDistinct("day"), F.countDistinct("candidate")).first()
    if n[0] * n[1] > MOST_CELLS:
        raise ValueError(f"a family of {n[1]} candidates over {n[0]} days is too large")
    rows = x.groupBy("candidate").agg(F.sort_array(F.collect_list(F.struct("day", "ret"))).alias("x")).select("candidate", "x.ret").orderBy("candidate").collect()
    return [r["candidate"] for r in rows], np.array([r["ret"] for r in rows]).T


@query("R01_block_length")
def r01(spark, sf):
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("day")["ret"].to_numpy()
        return pd.DataFrame({"candidate": pdf["candidate"].iloc[:1], "n": [len(x)], "block": [inference.block_length(x)]})

    return matrix(spark, sf).withColumn("ret", F.col("ret").cast("double")).groupBy("candidate").applyInPandas(f, "candidate string, n long, block double")


@query("R08_R11_R14_selection")
def r14(spark, sf):
    """Each candidate's mean and its adjusted step-down and confidence-set p-values, and the family's SPA p-value, all
    from one set of resampled days."""
    names, x = _wide(spark, sf)
    block = float(np.ceil(max(inference.block_length(c) for c in x.T)))
    return inference.family_tests(spark, x, names, block)


@query("R04_R10_spa_lengths")
def r10(spark, sf):
    """The family's SPA test at its own block length and at four fixed ones, all of which it has to pass."""
    names, x = _wide(spark, sf)
    return inference.spa_by_length(spark, x, names)


@query("A28_A29_deflated_sharpe")
def a29(spark, sf):
    x = matrix(spark, sf).withColumn("ret", F.col("ret").cast("double"))
    m = stats.sharpe(x, ["candidate"], "ret").join(stats.moments(x, ["candidate"], "ret").drop("n"), "candidate")
    variance = m.agg(F.coalesce(F.var_samp("sharpe"), F.lit(0.0))).first()[0]
    return inference.deflated_sharpe(m, m.count(), variance)


@query(
    "F26_effective_trials",
    """SELECT rho_bar, m AS formal, least(5 + m, 5 + rho_bar + (1 - rho_bar) * m) AS trials FROM (SELECT greatest(0.0::DOUBLE, least(1.0::DOUBLE, avg(rho))) AS rho_bar FROM
 (SELECT corr(x.ret, y.ret) AS rho FROM matrix x JOIN matrix y ON x.day = y.day AND x.candidate < y.candidate GROUP BY x.candidate, y.candidate)), (SELECT count(DISTINCT candidate) AS m FROM matrix)""",
    "rho_bar trials",
    MATRIX,
)
def f26(spark, sf):
    """The family's own number of candidates is its number of formal trials."""
    x = matrix(spark, sf)
    rho = selection.pooled_correlation(gram.correlations(gram.pair_moments(x, "candidate", "day", "ret")))
    return rho.crossJoin(x.agg(F.countDistinct("candidate").alias("formal"))).select("rho_bar", "formal", selection.effective_trials(F.col("rho_bar"), F.col("formal")).alias("trials"))  # one row each


@query("R26_kelly")
def r26(spark, sf):
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"market": pdf["market"].iloc[:1], "fraction": [inference.kelly_fraction(pdf["day_r"].to_numpy(), 0.9, 0.05)]})

    daily = stats.daily_sum(tb.trades(spark, sf), ["market"], "day", "r")
    value = next(c for c in daily.columns if c not in ("market", "day"))
    return daily.select("market", F.col(value).cast("double").alias("day_r")).groupBy("market").applyInPandas(f, "market string, fraction double")
