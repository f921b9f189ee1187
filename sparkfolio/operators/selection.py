"""Choosing configurations, and the pre-trade and verdict gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def universe(study: DataFrame, variation: str, train_months: int, least_rpd: float = 1.0, least_profitable: float = 60.0) -> DataFrame:
    """Instruments of one configuration that pay their drawdown, are positive and profitable often enough."""
    x = study.where((F.col("variation") == variation) & (F.col("train_months") == train_months))
    return x.where((F.col("return_per_dd") >= least_rpd) & (F.col("mean_oos") > 0) & (F.col("pct_profitable") >= least_profitable))


def chain(df: DataFrame, by: list[str], steps: list[tuple[str, Column]]) -> DataFrame:
    """How many rows of each group survive each of the filters, applied in turn, and the first one that left none."""
    alive, cols = F.lit(True), []
    for name, cond in steps:
        alive = alive & F.coalesce(cond, F.lit(False))
        cols.append(F.count_if(alive).alias(name))
    x = df.groupBy(*by).agg(*cols)
    return x.withColumn("emptied_by", F.coalesce(*(F.when(F.col(n) == 0, n) for n, _ in steps)))


def first_choice(df: DataFrame, by: list[str], keys: list[Column]) -> DataFrame:
    """The first row of each group under a total order."""
    w = Window.partitionBy(*by).orderBy(*keys)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_max(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The earliest row with the largest value."""
    return df.groupBy(*by).agg(F.max(value).alias("best"), F.min_by(order, F.struct(-F.col(value), F.col(order))).alias("at"))


def pre_trade(df: DataFrame, risk: str, equity: str, open_risk: str, day_start: str, high: str, start: float) -> DataFrame:
    """allowed and reason of a trade: open risk with it at most 2 % of equity, and 1.5 times it within the least of what
    the daily gate, the trailing floor and the hard daily limit leave. The least budget names the reason."""
    trailing = F.col(equity) - F.least(F.lit(start), F.col(high) - 0.05 * start)
    budgets = [(F.col(equity) - F.col(day_start) * (1 - 0.027), "daily gate"), (F.col(equity) - F.col(day_start) * (1 - 0.03), "daily limit"), (trailing, "trailing floor")]
    x = df.withColumn("__b", F.array_min(F.array(*(F.struct(b.alias("room"), F.lit(n).alias("name")) for b, n in budgets))))
    total = F.col(open_risk) + F.col(risk)
    reason = F.when(total > 0.02 * F.col(equity), "open risk").when(1.5 * total > F.col("__b.room"), F.col("__b.name"))
    return x.withColumn("reason", F.coalesce(reason, F.lit("ok"))).withColumn("allowed", F.col("reason") == "ok").withColumn("room", F.col("__b.room")).drop("__b")


def must_flatten(equity: Column, day_start: Column, high: Column, start: float) -> Column:
    return (equity <= F.least(F.lit(start), high - 0.05 * start)) | (equity <= day_start * (1 - 0.025))


def regression(reference: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """Runs that differ: by over 1 % of trades, over 2 points of annual return, or by a number that is missing."""
    a = reference.select(key, F.col("trades").alias("t0"), F.col("annual").alias("a0"))
    x = a.join(candidate.select(key, F.col("trades").alias("t1"), F.col("annual").alias("a1")), key, "full")
    missing = F.col("t0").isNull() | F.col("t1").isNull() | F.col("a0").isNull() | F.col("a1").isNull()
    moved = (F.abs(F.col("t1") - F.col("t0")) > 0.01 * F.col("t0")) | (F.abs(F.col("a1") - F.col("a0")) > 0.02)
    return x.withColumn("flag", F.when(missing, "missing").when(moved, "moved").otherwise("same"))


def pooled_correlation(correlated: DataFrame) -> DataFrame:
    """Mean Pearson correlation over pairs with rho, within 0 and 1; pairs without spread don't count in it."""
    return correlated.agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("rho"))).alias("rho_bar"), F.count("*").alias("pairs"))


def effective_trials(rho: Column, formal: Column, manual: int = 5) -> Column:
    """Manual trials, and of the formal ones as many as their mean correlation leaves; never more than both."""
    return F.least(manual + formal, manual + rho + (1 - rho) * formal)


def shortest_match(left: DataFrame, right: DataFrame, base: str, name: str) -> DataFrame:
    """For each base symbol the equal name, or else the shortest that starts with it, the first by name on ties; right
    is a terminal's symbol list, keyed by its prefixes so that the match is an equi join."""
    pre = right.select(F.col(name), F.explode(F.transform(F.sequence(F.lit(1), F.length(name)), lambda n: F.substring(F.col(name), F.lit(1), n))).alias(base))
    return left.join(pre, base, "left").groupBy(base).agg(F.min(F.struct(F.length(name).alias("n"), F.col(name).alias("match")))["match"].alias("match"))


def with_diagnostics(ranked: DataFrame, diagnosed: DataFrame, key: str, sure: str = "0.90") -> DataFrame:
    """ranked with dsr, dsr_nominal and dsr_ok of its candidates; a candidate that has no diagnostics keeps nulls and isn't
    ok. diagnosed: key, dsr_effective, dsr_nominal, unique by key."""
    d = diagnosed.select(key, F.col("dsr_effective").alias("dsr"), "dsr_nominal")
    return ranked.join(d, key, "left").withColumn("dsr_ok", F.coalesce(F.col("dsr").cast("decimal(38,18)") >= F.lit(sure).cast("decimal(38,18)"), F.lit(False)))


def closed_positions(positions: DataFrame, since=None, closed: str = "ts_closed") -> DataFrame:
    """Positions that are closed, at `since` or later."""
    x = positions.where(F.col(closed).isNotNull())
    return x if since is None else x.where(F.col(closed) >= F.lit(since))


def at_most(p: Column, limit: str = "0.05") -> Column:
    """p <= limit as exact decimals; false for null and NaN."""
    return F.coalesce(p.cast("decimal(38,18)") <= F.lit(limit).cast("decimal(38,18)"), F.lit(False))


def verdict(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """passed, when all checks hold, and the names of those that don't, in order; a null check doesn't hold."""
    bad = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), n) for n, c in checks)), lambda n: n.isNotNull())
    return df.withColumn("failed", bad).withColumn("passed", F.size("failed") == 0)


def gated(gates: list[Column], forced: Column) -> Column:
    """All gates hold and the choice wasn't forced."""
    both = F.lit(True)
    for g in gates:
        both = both & F.coalesce(g, F.lit(False))
    return both & ~F.coalesce(forced, F.lit(False))


def disagreeing(params: DataFrame, by: list[str], key: str, value: str, switchable: tuple[str, ...] = ()) -> DataFrame:
    """Parameters that one continuous run needs to be constant but whose chosen values differ; null is a value."""
    v = F.coalesce(F.col(value).cast("string"), F.lit("None"))
    x = params.where(~F.col(key).isin(*switchable)) if switchable else params
    return x.groupBy(*by, key).agg(F.countDistinct(v).alias("values"), F.min(v).alias("least"), F.max(v).alias("most")).where("values > 1")


def renamed(positions: DataFrame, names: DataFrame, symbol: str, old: str, new: str) -> DataFrame:
    """positions with `market`: the new name of their symbol, or the symbol itself where there is none."""
    n = names.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    return positions.join(n, F.col(symbol) == F.col("__old"), "left").withColumn("market", F.coalesce("__new", symbol)).drop("__old", "__new")


def uncovered(part: DataFrame, whole: DataFrame, on: list[str]) -> DataFrame:
    """Rows of part that whole lacks; empty if part is a subset. Nulls are equal."""
    return part.select(*on).distinct().exceptAll(whole.select(*on).distinct())


def pooled(series: list[DataFrame]) -> DataFrame:
    """cohort, source, day, r of several fragments as one series. Fails where cohorts or sources differ or a day repeats."""
    x = series[0]
    for s in series[1:]:
        x = x.unionByName(s)
    one = x.agg(F.countDistinct("cohort").alias("c"), F.countDistinct("source").alias("s"), F.count("*").alias("n"), F.countDistinct("day").alias("d")).first()
    if one["c"] > 1 or one["s"] > 1:
        raise ValueError("fragments of different cohorts or sources can't be pooled")
    if one["n"] != one["d"]:
        raise ValueError("pooled fragments repeat a day")
    return x


def trial_budget(study: DataFrame, manual: int = 5) -> DataFrame:
    """How many trials a study stands for: variations x train lengths x combinations, and those made by hand."""
    x = study.agg(F.countDistinct("variation").alias("variations"), F.countDistinct("train_months").alias("lengths"), F.countDistinct("combo").alias("combos"))
    return x.withColumn("trials", F.col("variations") * F.col("lengths") * F.col("combos") + manual)
