"""Edge, risk and attribution statistics of trades and studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import ratio, tail_safe_risk
from . import scans


def edge_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, hit_rate, payoff, profit_factor (infinite without losses), avg_win, avg_loss, expectancy per group. Zeros count
    in n alone; nulls count nowhere."""
    v = F.col(value)
    win, loss = F.when(v > 0, v), F.when(v < 0, v)
    x = df.groupBy(*by).agg(
        F.count(v).alias("n"), F.coalesce(ratio(F.count(win).cast("double"), F.count(v)), F.lit(0.0)).alias("hit_rate"), F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"), F.coalesce(F.avg(v), F.lit(0.0)).alias("expectancy"), F.sum(win).alias("w"), F.sum(loss).alias("l"),
    )
    pf = F.when(F.col("l") < 0, F.coalesce("w", F.lit(0.0)) / -F.col("l")).otherwise(F.lit(float("inf")))
    return x.withColumn("payoff", ratio(F.col("avg_win"), -F.col("avg_loss"))).withColumn("profit_factor", pf).drop("w", "l")


def reference(trades: DataFrame, by: str, value: str = "r", cost: str = "swap_r") -> DataFrame:
    """edge_stats of a back-test's stream net of its cost (where it has that column): a row for each of by, and one for
    all trades, whose by is null and whose `overall` is true. Sums are partial before the shuffle."""
    net = F.col(value) + F.coalesce(F.col(cost), F.lit(0.0)) if cost in trades.columns else F.col(value)
    x = trades.select(F.col(by).alias(by), net.alias("__net"))
    both = x.select(F.explode(F.array(F.struct(F.col(by).alias(by), F.lit(False).alias("overall")), F.struct(F.lit(None).cast(x.schema[by].dataType).alias(by), F.lit(True).alias("overall")))).alias("k"), "__net")
    return edge_stats(both.select("k.*", "__net"), [by, "overall"], "__net")


def daily_sum(df: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    return df.groupBy(*by, day).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def worst_day(df: DataFrame, by: list[str], day: str = "day", r: str = "r") -> DataFrame:
    """worst_day_r: the least sum of R of one loss day; the earliest day on ties."""
    d = daily_sum(df, by, day, r).withColumn("total", F.round("total", 6))
    return d.groupBy(*by).agg(F.min("total").alias("worst_day_r"), F.min_by(day, F.struct("total", day)).alias("worst_day"))


def worst_trade(df: DataFrame, by: list[str], r: str = "r") -> DataFrame:
    return df.groupBy(*by).agg(F.min(r).alias("worst_trade_r"))


def tail_cap(df: DataFrame, by: list[str], stress: float, daily: float, trailing: float) -> DataFrame:
    """Risk a trade that the stressed worst day and the stressed worst trade leave within the limits."""
    x = worst_day(df, by).join(worst_trade(df, by), by)
    least = F.least(tail_safe_risk(F.col("worst_day_r"), stress, daily, trailing), tail_safe_risk(F.col("worst_trade_r"), stress, daily, trailing))
    return x.withColumn("tail_cap", least)


def per_config(study: DataFrame) -> DataFrame:
    """Means and the worst over instruments of each configuration."""
    return study.groupBy("variation", "train_months").agg(
        F.avg("mean_oos").alias("mean_ret"), F.avg("return_per_dd").alias("mean_rpd"), F.min("return_per_dd").alias("worst_rpd"),
        F.avg((F.col("mean_oos") > 0).cast("double")).alias("frac_positive"), F.countDistinct("instrument").alias("instruments"),
    )


def ranking(study: DataFrame, least_positive: float = 0.9, tolerance: float = 0.85) -> DataFrame:
    """Configurations with their gates: enough instruments positive, close enough to the best mean, and complete. The
    best and the number of instruments come from one aggregate row, joined back."""
    c = per_config(study)
    ref = c.agg(F.max("mean_rpd").alias("best")).withColumn("one", F.lit(1))
    full = study.agg(F.countDistinct("instrument").alias("universe")).withColumn("one", F.lit(1))
    x = c.withColumn("one", F.lit(1)).join(F.broadcast(ref), "one").join(F.broadcast(full), "one").drop("one")
    return x.select(
        "variation", "train_months", "mean_ret", "mean_rpd", "worst_rpd", "frac_positive", (F.col("instruments") == F.col("universe")).alias("complete"),
        (F.col("frac_positive") >= least_positive).alias("enough_positive"), (F.col("mean_rpd") >= tolerance * F.col("best")).alias("near_best"),
    )


def best_train(study: DataFrame) -> DataFrame:
    """The train length with the best mean of return_per_dd for each variation; the shortest on ties."""
    x = study.groupBy("variation", "train_months").agg(F.avg("return_per_dd").alias("rpd"))
    return x.groupBy("variation").agg(F.max_by("train_months", F.struct(F.round("rpd", 9), -F.col("train_months"))).alias("best_train"), F.max("rpd").alias("best_rpd"))


def pivoted(study: DataFrame, rows: str, columns: str, values: list, value: str) -> DataFrame:
    return study.groupBy(rows).pivot(columns, values).agg(F.avg(value))


def attribution(df: DataFrame, by: str, r: str, risk: float) -> DataFrame:
    """Trades, R, hit rate, return and share of the total for each market."""
    x = df.groupBy(by).agg(F.count("*").alias("n"), F.sum(r).alias("total_r"), F.avg((F.col(r) > 0).cast("double")).alias("hit"), F.avg(r).alias("avg_r"))
    total = x.agg(F.sum("total_r").alias("all_r")).withColumn("one", F.lit(1))
    x = x.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").drop("one")
    return x.withColumn("return_pct", F.col("total_r") * risk * 100).withColumn("share_pct", ratio(F.col("total_r") * 100, F.col("all_r"))).drop("all_r")


def compound_by_year(daily: DataFrame, by: list[str]) -> DataFrame:
    """daily: by, day (date), equity. Year-end equity over the year before's, or over the first equity."""
    y = daily.groupBy(*by, F.year("day").alias("year")).agg(F.max_by("equity", "day").alias("last"), F.min_by("equity", "day").alias("first"))
    before = F.coalesce(F.lag("last").over(Window.partitionBy(*by).orderBy("year")), F.col("first"))
    return y.select(*by, "year", (F.col("last") / before - 1).alias("ret"))


def calmar(df: DataFrame, by: list[str], order: list[str], pnl: str, start: float, least: int = 10, parts: bool = False, width: int | None = None) -> DataFrame:
    """Total return over the largest drawdown (at least 1e-6); -infinity under `least` trades, which ranks last. With parts
    also the total and the drawdown. width: see curves."""
    x = scans.levels(df, by, order, scans.cut_by(df, order[0], width), pnl, start)
    return x.groupBy(*by).agg(F.count("*").alias("n"), F.sum(pnl).alias("total"), F.max((F.col("peak") - F.col("equity")) / F.col("peak")).alias("dd")).select(
        *by, "n", *(["total", "dd"] if parts else []), F.when(F.col("n") >= least, F.col("total") / start / F.greatest("dd", F.lit(1e-6))).otherwise(F.lit(float("-inf"))).alias("score")
    )


def sharpe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per observation, sample deviation; 0 for fewer than two or no spread."""
    s = F.stddev_samp(value)
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.coalesce(ratio(F.avg(value), F.nullif(s, F.lit(0.0))), F.lit(0.0)).alias("sharpe"))


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Skewness and plain kurtosis, standardised with the sample deviation."""
    n = F.count(value).cast("double")
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), (F.skewness(value) * F.pow((n - 1) / n, F.lit(1.5))).alias("skew"), ((F.kurtosis(value) + 3) * F.pow((n - 1) / n, F.lit(2))).alias("kurt")
    )


def risk_stats(daily: DataFrame, by: list[str], start: float) -> DataFrame:
    """daily: by, day (int), equity. Years, total and annual return on the start, largest drawdown, yearly Sharpe of
    daily changes over the start."""
    w = Window.partitionBy(*by).orderBy("day")
    x = daily.withColumn("peak", F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("step", (F.col("equity") - F.lag("equity").over(w)) / start)
    g = x.groupBy(*by).agg(
        F.greatest((F.max("day") - F.min("day")) / 365.25, F.lit(1e-9)).alias("years"), F.max_by("equity", "day").alias("last"), F.max((F.col("peak") - F.col("equity")) / F.col("peak")).alias("max_dd"),
        F.coalesce(ratio(F.avg("step"), F.nullif(F.stddev_samp("step"), F.lit(0.0))) * F.sqrt(F.lit(252.0)), F.lit(0.0)).alias("sharpe"),
    )
    return g.select(*by, "years", (F.col("last") / start - 1).alias("total_return"), ((F.col("last") / start - 1) / F.col("years")).alias("annual_return"), "max_dd", "sharpe")


def modal(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value; the smallest on ties."""
    return df.groupBy(*by).agg(F.mode(value, True).alias("modal"))


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """sorted[n // 2] of the distinct values."""
    return df.groupBy(*by).agg(F.sort_array(F.collect_set(value)).alias("v")).select(*by, F.element_at("v", (F.size("v") / 2).cast("int") + 1).alias("median"))


def swap_impact(df: DataFrame, by: list[str]) -> DataFrame:
    """Gross and swap totals, longs and shorts, profit factor before and after swap."""

    def pf(x: Column) -> Column:
        return ratio(F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)), -F.sum(F.when(x < 0, x)))

    net = F.col("r") + F.col("swap_r")
    return df.groupBy(*by).agg(
        F.sum("r").alias("gross"), F.sum("swap_r").alias("swap"), F.count_if("is_long").alias("longs"), F.count_if(~F.col("is_long")).alias("shorts"), pf(F.col("r")).alias("pf_gross"), pf(net).alias("pf_net")
    )


def expected_shortfall(df: DataFrame, by: list[str], value: str, share: float = 0.05) -> DataFrame:
    """Mean of the worst ceil(share * n) values. Counted by distinct value, so a hot value is one row."""
    v = df.groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    x = v.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    k = F.ceil(F.col("n") * share)
    take = F.greatest(F.lit(0), F.least(F.col("c"), k - (F.col("upto") - F.col("c"))))
    return x.groupBy(*by).agg((F.sum(F.col(value) * take) / F.sum(take)).alias("shortfall"), F.max("n").alias("n"))


def percentiles(df: DataFrame, by: list[str], value: str, ps: list[float], nearest: bool = False) -> DataFrame:
    """Linear quantiles, or nearest-rank ones."""
    if nearest:
        cols = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(p * 100):02d}") for p in ps]
    else:
        cols = [F.percentile(value, p).alias(f"p{round(p * 100):02d}") for p in ps]
    return df.groupBy(*by).agg(*cols)
