"""Equity curves, drawdowns, floors and daily grids. Where a curve can be long, width is the days or units of its first
order column that one task takes (see scans); without it a group is one window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scans


def running_sum(df: DataFrame, by: list[str], order: list[str], value: str, to: str, start: float = 0.0, width: int | None = None) -> DataFrame:
    x = scans.running(df, by, order, scans.cut_by(df, order[0], width), {"__sum": ("sum", F.col(value))})
    return x.withColumn(to, start + F.col("__sum")).drop("__sum")


def _peaks(curve: DataFrame, by: list[str], order: list[str], value: str, width: int | None) -> DataFrame:
    return scans.running(curve, by, order, scans.cut_by(curve, order[0], width), {"peak": ("max", F.col(value))})


def equity_curve(df: DataFrame, by: list[str], order: list[str], pnl: str, start: float, width: int | None = None) -> DataFrame:
    """by, step, equity: step 0 is the start, step k the equity after k trades."""
    own = df.select(*by, *(c for c in order if c not in by), F.col(pnl).alias("__pnl"))
    x = scans.running(own, by, order, scans.cut_by(own, order[0], width), {"step": ("count", F.lit(1)), "equity": ("sum", F.col("__pnl"))})
    x = x.select(*by, F.col("step").cast("int").alias("step"), (start + F.col("equity")).alias("equity"))
    return x.unionByName(df.select(*by).distinct().select(*by, F.lit(0).alias("step"), F.lit(float(start)).alias("equity")))


def max_drawdown(curve: DataFrame, by: list[str], order: list[str], equity: str = "equity", width: int | None = None) -> DataFrame:
    """Largest fall from the running peak, as a share of the peak."""
    x = _peaks(curve, by, order, equity, width)
    return x.groupBy(*by).agg(F.max((F.col("peak") - F.col(equity)) / F.col("peak")).alias("max_drawdown"))


def drawdown_series(curve: DataFrame, by: list[str], order: list[str], equity: str = "equity", width: int | None = None) -> DataFrame:
    return _peaks(curve, by, order, equity, width).withColumn("drawdown", F.col(equity) / F.col("peak") - 1).drop("peak")


def trailing_floor(curve: DataFrame, by: list[str], order: list[str], balance: str, start: float, limit: float, width: int | None = None) -> DataFrame:
    """The floor follows the highest balance, the same day's close included, and never exceeds the start."""
    high = F.greatest(F.lit(start), F.col("peak"))
    return _peaks(curve, by, order, balance, width).withColumn("floor", F.least(F.lit(start), high - limit * start)).drop("peak")


def trailing_check(curve: DataFrame, by: list[str], order: str, equity: str, balance: str, start: float, limit: float) -> DataFrame:
    """breached, the least margin over the floor, and the first step at or under it (null if none)."""
    x = trailing_floor(curve, by, [order], balance, start, limit).withColumn("margin", F.col(equity) - F.col("floor"))
    hit = F.col("margin") <= 0
    return x.groupBy(*by).agg(F.bool_or(hit).alias("breached"), F.min("margin").alias("min_margin"), F.min(F.when(hit, F.col(order))).alias("first_breach"))


def daily_breach(curve: DataFrame, by: list[str], order: str, equity: str, start: float, limit: float) -> DataFrame:
    """Steps that lose strictly more than limit of the equity before them; the first is held against the start."""
    before = F.lag(equity, 1, start).over(Window.partitionBy(*by).orderBy(order))
    return curve.withColumn("loss", (before - F.col(equity)) / before).withColumn("breach", F.col("loss") > limit)


def day_grid(df: DataFrame, by: list[str], day: str = "day") -> DataFrame:
    """Every day from a group's first to its last."""
    return df.groupBy(*by).agg(F.min(day).alias("a"), F.max(day).alias("b")).select(*by, F.explode(F.sequence("a", "b")).alias(day))


def align(prices: DataFrame, grid: DataFrame, by: list[str], price: str, day: str = "day") -> DataFrame:
    """Prices on a day grid, filled forward and then, at the start, backward."""
    w = Window.partitionBy(*by).orderBy(day)
    x = grid.join(prices, [*by, day], "left")
    x = x.withColumn(price, F.last(price, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumn(price, F.coalesce(price, F.first(price, True).over(w.rowsBetween(0, Window.unboundedFollowing))))


def daily_close(bars: DataFrame, by: list[str], day: str = "day") -> DataFrame:
    """The last close of each loss day."""
    return bars.groupBy(*by, day).agg(F.max_by("close", "ts").alias("close"))


def base_curves(trades: DataFrame, prices: DataFrame, grid: DataFrame) -> DataFrame:
    """realized: cumulative pnl by close day; unrealized: the open trades' share of their pnl at each day's price, on
    days [od, cd). trades: market, od, cd, pnl, entry, exit; prices: market, day, close; grid: day. Open days are
    exploded to an equi join on (market, day)."""
    held = trades.where("cd > od").withColumn("day", F.explode(F.sequence("od", F.col("cd") - 1)))
    span = F.col("exit") - F.col("entry")
    marks = held.join(prices, ["market", "day"]).groupBy("day").agg(F.sum(F.col("pnl") / F.when(F.abs(span) < 1e-12, F.lit(1.0)).otherwise(span) * (F.col("close") - F.col("entry"))).alias("unrealized"))
    done = trades.groupBy(F.col("cd").alias("day")).agg(F.sum("pnl").alias("pnl"))
    x = grid.join(done, "day", "left").join(marks, "day", "left").withColumn("account", F.lit("all"))
    x = running_sum(x.fillna({"pnl": 0.0, "unrealized": 0.0}), ["account"], ["day"], "pnl", "realized")
    return x.select("day", "realized", "unrealized")


def assign_r(df: DataFrame, by: list[str], order: list[str], pnl: str, start: float, risk: float, fixed: bool, width: int | None = None) -> DataFrame:
    """R of each trade over the start (fixed) or over the balance before it (walked), times the base risk."""
    if fixed:
        return df.withColumn("r_multiple", F.col(pnl) / F.lit(risk * start))
    x = scans.running(df, by, order, scans.cut_by(df, order[0], width), {"__before": ("sum", F.col(pnl))}, exclusive=True)
    return x.withColumn("r_multiple", F.col(pnl) / (risk * (start + F.coalesce("__before", F.lit(0.0))))).drop("__before")
