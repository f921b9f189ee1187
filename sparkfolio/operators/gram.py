"""Moments of every two items over the days that both have: a block of days makes its cross products once, as matrices,
and blocks are added up. Days are never paired row by row, so a day of m items costs m rows and not m squared."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scans

#: Items on a side of one tile of the matrix.
TILE = 256
#: Spread that rounding alone can make, as a share of the mean.
ROUNDING = 1e-10

_SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def _products(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Sums over the rows that both columns have; nan is none."""
    in_a, in_b = ~np.isnan(a), ~np.isnan(b)
    a, b, ma, mb = np.where(in_a, a, 0.0), np.where(in_b, b, 0.0), in_a.astype(float), in_b.astype(float)
    return dict(zip(_SUMS, (ma.T @ mb, a.T @ mb, ma.T @ b, (a * a).T @ mb, ma.T @ (b * b), a.T @ b)))


def pair_moments(long: DataFrame, item: str, on: str, value: str, width: int = 512, tile: int = TILE) -> DataFrame:
    """a, b, n, mean_a, mean_b, var_a, var_b, cov (population) for every two items, the smaller name first, that share a
    day. long: one row an item and day; null values and null names don't count. width: days (or units of `on`) of one
    block. Values are taken about their item's mean, so sums of squares keep their digits. Items are dealt to tiles
    too: a task holds a block's days of two tiles, whatever the numbers of items and days."""
    x = long.where(F.col(value).isNotNull() & F.col(item).isNotNull()).select(F.col(item).alias("item"), F.col(on).alias("on"), F.col(value).cast("double").alias("v"))
    names = x.groupBy("item").agg(F.avg("v").alias("mean"))
    names = names.withColumn("id", F.row_number().over(Window.orderBy("item")) - 1)  # one row an item
    tiles = names.agg(F.max("id").alias("last")).first()["last"]
    tiles = 1 if tiles is None else tiles // tile + 1
    x = x.join(names, "item").select("id", "on", (F.col("v") - F.col("mean")).alias("v"), scans.cut_by(x, "on", width).alias("block"))
    own, others = F.floor(F.col("id") / tile).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    x = x.select("*", own.alias("own"), others.alias("other")).select("id", "on", "v", "block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        day, n = pd.factorize(pdf["on"])[0], pdf["on"].nunique()
        ids = pdf["id"].to_numpy()
        sides = []
        for t in (i, j):
            m = np.full((n, tile), np.nan)
            here = ids // tile == t
            m[day[here], ids[here] % tile] = pdf["v"].to_numpy()[here]
            sides.append(m)
        sums = _products(*sides)
        a, b = np.nonzero(sums["n"])
        keep = a + i * tile < b + j * tile
        a, b = a[keep], b[keep]
        return pd.DataFrame({"a": a + i * tile, "b": b + j * tile, **{k: s[a, b] for k, s in sums.items()}})

    parts = x.groupBy("block", "i", "j").applyInPandas(multiply, f"a long, b long, {', '.join(f'{k} double' for k in _SUMS)}")
    total = parts.groupBy("a", "b").agg(*(F.sum(k).alias(k) for k in _SUMS))
    side = lambda c: names.select(F.col("id").alias(c), F.col("item").alias(f"name_{c}"), F.col("mean").alias(f"mu_{c}"))
    y = total.join(side("a"), "a").join(side("b"), "b")
    n = F.col("n")
    spread = lambda c: F.greatest(F.lit(0.0), F.col(f"s{c}{c}") / n - F.pow(F.col(f"s{c}") / n, F.lit(2)))
    return y.select(
        F.col("name_a").alias("a"), F.col("name_b").alias("b"), n.cast("long").alias("n"), (F.col("mu_a") + F.col("sa") / n).alias("mean_a"), (F.col("mu_b") + F.col("sb") / n).alias("mean_b"),
        spread("a").alias("var_a"), spread("b").alias("var_b"), (F.col("sab") / n - F.col("sa") * F.col("sb") / (n * n)).alias("cov"),
    )


def correlations(moments: DataFrame) -> DataFrame:
    """moments with rho, within -1 and 1; null where one of the two has no spread beyond rounding."""
    flat = lambda c: F.sqrt(f"var_{c}") <= ROUNDING * F.abs(F.col(f"mean_{c}"))
    rho = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cov") / F.sqrt(F.col("var_a") * F.col("var_b"))))
    return moments.withColumn("rho", F.when(~flat("a") & ~flat("b") & (F.col("var_a") * F.col("var_b") > 0), rho))


def differences(moments: DataFrame) -> DataFrame:
    """moments with mean_diff and sd_diff (sample) of a - b, and the score, the mean in standard errors: 0 for two items
    that never differ. Two that differ by a constant have no score and fail the query."""
    n = F.col("n")
    var = F.greatest(F.lit(0.0), F.col("var_a") + F.col("var_b") - 2 * F.col("cov"))
    scale = F.greatest(F.col("var_a"), F.col("var_b"))
    var = F.when(var <= ROUNDING * ROUNDING * scale + 4 * 2.3e-16 * scale, F.lit(0.0)).otherwise(var)
    x = moments.withColumn("mean_diff", F.col("mean_a") - F.col("mean_b")).withColumn("sd_diff", F.when(n > 1, F.sqrt(var * n / (n - 1))))
    same = F.abs("mean_diff") <= ROUNDING * F.greatest(F.abs("mean_a"), F.abs("mean_b"), F.sqrt(scale))
    score = F.when(F.col("sd_diff") > 0, F.col("mean_diff") / (F.col("sd_diff") / F.sqrt(n))).when(same, F.lit(0.0))
    apart = F.raise_error(F.concat(F.lit("two items differ by a constant: "), F.col("a"), F.lit(", "), F.col("b"))).cast("double")
    return x.withColumn("score", F.when((F.col("sd_diff") == 0) & ~same, apart).otherwise(score))
