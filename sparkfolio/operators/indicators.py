"""Indicators over bars: frames of the last n rows, and recurrences on their own output as scans of affine maps. width is
the days of a market that one task takes (see scans); without it a market is one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans


def williams_r(bars: DataFrame, by: list[str], n: int, width: int | None = None) -> DataFrame:
    """100 (close - highest) / (highest - lowest) of n bars; 0 before n bars and without a range."""
    x = scans.rolling(bars, by, ["ts"], scans.cut_by(bars, "ts", width), n, {"__hi": F.max("high"), "__lo": F.min("low")})
    hi, lo = F.col("__hi"), F.col("__lo")
    return x.withColumn("wpr", F.when((F.col("__at") >= n) & (hi > lo), 100 * (F.col("close") - hi) / (hi - lo)).otherwise(0.0)).drop("__hi", "__lo", "__at")


def bollinger(bars: DataFrame, by: list[str], n: int, mult: float, width: int | None = None) -> DataFrame:
    """Mean and mean -/+ mult population deviations of n closes; null before n bars."""
    x = scans.rolling(bars, by, ["ts"], scans.cut_by(bars, "ts", width), n, {"__n": F.count("close"), "__mid": F.avg("close"), "__dev": F.stddev_pop("close")})
    full, mid, dev = F.col("__n") == n, F.col("__mid"), F.col("__dev")
    bands = {"mid": F.when(full, mid), "lower": F.when(full, mid - mult * dev), "upper": F.when(full, mid + mult * dev)}
    return x.withColumns(bands).drop("__n", "__mid", "__dev", "__at")


def realized_vol(daily: DataFrame, by: list[str], n: int, close: str = "close", day: str = "day") -> DataFrame:
    """Sample deviation of n daily log returns; null until there are n."""
    w = Window.partitionBy(*by).orderBy(day)
    x = daily.withColumn("__r", F.ln(F.col(close)) - F.ln(F.lag(close).over(w)))
    f = w.rowsBetween(1 - n, 0)
    return x.withColumn("vol", F.when(F.count("__r").over(f) == n, F.stddev_samp("__r").over(f))).drop("__r")


def efficiency_ratio(daily: DataFrame, by: list[str], n: int, close: str = "close", day: str = "day") -> DataFrame:
    """Net change over n days by the path's length; null without a path."""
    w = Window.partitionBy(*by).orderBy(day)
    x = daily.withColumn("__step", F.abs(F.col(close) - F.lag(close).over(w)))
    f = w.rowsBetween(1 - n, 0)
    path = F.when(F.count("__step").over(f) == n, F.sum("__step").over(f))
    return x.withColumn("er", F.try_divide(F.abs(F.col(close) - F.lag(close, n).over(w)), F.nullif(path, F.lit(0.0)))).drop("__step")


def terciles(df: DataFrame, by: list[str], value: str, labels: tuple[str, str, str], to: str) -> DataFrame:
    """Label by the linear 33 and 66 % quantiles of the group: at most the first, at most the second, above."""
    q = df.groupBy(*by).agg(F.percentile(value, 0.33).alias("__lo"), F.percentile(value, 0.66).alias("__hi"))
    v = F.col(value)
    return df.join(q, by).withColumn(to, F.when(v <= F.col("__lo"), labels[0]).when(v <= F.col("__hi"), labels[1]).when(v.isNotNull(), labels[2])).drop("__lo", "__hi")


def ema(values: np.ndarray, n: int) -> np.ndarray:
    """alpha = 2 / (n + 1), from the first value."""
    return pd.Series(values).ewm(span=n, adjust=False).mean().to_numpy()


def rsi(close: np.ndarray, n: int, scale: float = 100.0) -> np.ndarray:
    """Wilder's smoothing with alpha 1 / n from the first change, in 0..scale; half of it before anything moves."""
    d = np.diff(close, prepend=close[:1])
    up, down = (pd.Series(np.clip(s * d, 0, None)).ewm(alpha=1 / n, adjust=False).mean().to_numpy() for s in (1, -1))
    total = up + down
    return np.where(total > 0, scale * up / np.where(total > 0, total, 1), scale / 2)


def smoothed(bars: DataFrame, by: list[str], ema_n: int, rsi_n: int, scale: float = 100.0, width: int | None = None) -> DataFrame:
    """bars and ema, rsi, as ema() and rsi() have them. Each is an affine recurrence, so a cut of a market is a map of what
    enters it, and maps are composed; the first change of a cut is from the last close before it."""
    cut = scans.cut_by(bars, "ts", width)
    x = scans.lagged(bars, by, ["ts"], cut, "close", "__b")
    step = F.coalesce(F.col("close") - F.col("__b"), F.lit(0.0))
    x = x.withColumns({"__up": F.greatest(step, F.lit(0.0)), "__down": F.greatest(-step, F.lit(0.0))})
    x = scans.affine(x, by, ["ts"], cut, {"ema": (2 / (ema_n + 1), "close", "first"), "__u": (1 / rsi_n, "__up", 0.0), "__d": (1 / rsi_n, "__down", 0.0)})
    total = F.col("__u") + F.col("__d")
    return x.withColumn("rsi", F.when(total > 0, scale * F.col("__u") / total).otherwise(scale / 2)).select(*bars.columns, "ema", "rsi")


def warm(by: list[str], bars_needed: int) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy("ts")) >= bars_needed


def new_last_bar(bars: DataFrame, by: list[str], now: Column, seen: DataFrame | None = None, hours: int = 4) -> DataFrame:
    """The last closed bar of each group by the server clock; none if it is the one that was acted on before."""
    closed = bars.where(F.col("ts") + F.expr(f"INTERVAL '{hours}' HOUR") <= now)
    last = closed.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ts")))).where("__n = 1").drop("__n")
    return last if seen is None else last.join(seen.select(*by, "ts"), [*by, "ts"], "left_anti")
