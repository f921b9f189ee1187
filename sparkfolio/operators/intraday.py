"""Equity within a day: the least that four-hour bars allow, and the fall from the highest equity seen so far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeaxis as tx
from ..sources import files
from . import joins

DAY_US = 86_400_000_000


def _unit() -> Column:
    """Money of a position for a price move of one."""
    span = F.col("exit") - F.col("entry")
    return F.col("size") * F.col("pnl") / F.when(F.abs(span) < 1e-12, F.lit(1.0)).otherwise(span)


def _met(trades: DataFrame, bars: DataFrame, hours: int) -> DataFrame:
    b = bars.select("market", F.col("ts").alias("s"), (F.col("ts") + hours * 3_600_000_000).alias("e"), "low", "high", "close")
    return joins.overlap(trades.select("account", "id", "market", "ts_opened", "ts_closed", "entry", "is_long", _unit().alias("unit")), b, ["market"], "ts_opened", "ts_closed", "s", "e", DAY_US)


def unobserved(trades: DataFrame, bars: DataFrame, hours: int = tx.BAR_HOURS) -> DataFrame:
    """account, id of positions with a duration that no bar of their market overlaps."""
    return _bare(trades, _met(trades, bars, hours))


def _bare(trades: DataFrame, met: DataFrame) -> DataFrame:
    held = trades.where("ts_closed > ts_opened").select("account", "id")
    return joins.missing(held, met, ["account", "id"])


def _levels(met: DataFrame) -> DataFrame:
    """account, at, worst, seen: changes of each position's floating money, at the worst price of the bar that runs and
    at the last close seen since it opened (its entry before the first). Without a running bar both are the same."""
    w = Window.partitionBy("account", "id").orderBy("s")
    money = lambda p: F.col("unit") * (p - F.col("entry"))
    x = met.withColumn("next", F.lead("s").over(w)).withColumn("before", F.coalesce(money(F.lag("close").over(w)), F.lit(0.0)))
    worst, after = money(F.when(F.col("is_long"), F.col("low")).otherwise(F.col("high"))), money(F.col("close"))
    level = lambda at, a, b: F.struct(F.col(at).alias("at") if isinstance(at, str) else at.alias("at"), a.alias("worst"), b.alias("seen"))
    none = F.lit(None)
    idle = (F.col("e") < F.col("ts_closed")) & (F.col("next").isNull() | (F.col("next") > F.col("e")))
    steps = F.array(level(F.greatest("s", "ts_opened"), worst, F.col("before")), F.when(idle, level("e", after, after)), F.when(F.col("next").isNull(), level("ts_closed", F.lit(0.0), F.lit(0.0))).otherwise(none))
    x = x.select("account", "id", F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("l")).select("account", "id", "l.*")
    w = Window.partitionBy("account", "id").orderBy("at")
    return x.select("account", "at", *((F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0.0))).alias(c) for c in ("worst", "seen")))


def minima(trades: DataFrame, bars: DataFrame, daily: DataFrame, start: float, hours: int = tx.BAR_HOURS) -> DataFrame:
    """daily (account, day, opening, equity) with minimum and drawdown. trades: account, id (unique in it), market,
    ts_opened, ts_closed (microseconds), pnl, swap, entry, exit, is_long, size; bars: market, ts, low, high, close, which
    don't overlap within a market.

    Between two events of an account its equity is marked at the worst price, low or high, of the bars that run in all
    markets it holds at once; a market without one stays at its last close. minimum is the least of a day's opening,
    closing equity and marks; drawdown the lowest fall, at most 0, of marks and of what can be seen (closes of bars,
    closed positions) from the highest equity seen before, the start at first. Marks count for every loss day that they
    touch. A position without duration is only booked. ValueError when no bar overlaps a position: see unobserved().

    Positions meet bars in an equi join by market and day, once: the pairs are written, checked and read again. Sums run
    within days on top of totals of the days before, so an account with very many positions isn't one task's work."""
    spark = trades.sparkSession
    path = files.scratch(spark, "met")
    _met(trades, bars, hours).write.parquet(path)
    met = spark.read.parquet(path)
    bad = _bare(trades, met).orderBy("account", "id").limit(5).collect()
    if bad:
        raise ValueError("no bar overlaps " + ", ".join(f"{r['account']}/{r['id']}" for r in bad))
    zero = {c: F.lit(0.0) for c in ("worst", "seen", "booked", "open")}
    row = lambda df, at, **k: df.select("account", F.col(at).alias("at"), *((k.get(c, z)).cast("double").alias(c) for c, z in zero.items()))
    lasting = (F.col("ts_closed") > F.col("ts_opened")).cast("double")
    cuts = bars.select(F.explode(F.array(F.col("ts"), F.col("ts") + hours * 3_600_000_000)).alias("at")).withColumn("day", tx.day_number(tx.loss_day(F.timestamp_micros("at"))))
    cuts = daily.select("account", "day").join(cuts.groupBy("day").agg(F.min("at").alias("at")), "day")  # a day is looked at once without events
    x = row(_levels(met), "at", worst=F.col("worst"), seen=F.col("seen")).unionByName(row(cuts, "at"))
    x = x.unionByName(row(trades, "ts_opened", open=lasting)).unionByName(row(trades, "ts_closed", open=-lasting, booked=(F.col("pnl") + F.col("swap")) * F.col("size")))
    path = files.scratch(spark, "steps")
    x.groupBy("account", "at").agg(*(F.sum(c).alias(c) for c in zero)).withColumn("day", tx.day_number(tx.loss_day(F.timestamp_micros("at")))).write.parquet(path)
    x = spark.read.parquet(path)  # a row an account and time; read by every pass below, the positions' levels once

    key = ["account", "day"]
    days = Window.partitionBy("account").orderBy("day")
    past, rest = days.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*key).orderBy("at")
    upto = rest.rowsBetween(Window.unboundedPreceding, 0)
    total = x.groupBy(*key).agg(*(F.sum(c).alias(f"t_{c}") for c in zero), F.min("at").alias("first"))
    total = total.select(*key, *(F.coalesce(F.sum(f"t_{c}").over(past), F.lit(0.0)).alias(f"p_{c}") for c in zero), F.lead("first").over(days).alias("tomorrow"))
    x = x.join(total, key).select(*key, "at", F.coalesce(F.lead("at").over(rest), F.col("tomorrow")).alias("until"), *((F.col(f"p_{c}") + F.sum(c).over(upto)).alias(c) for c in zero))
    x = x.withColumn("equity", start + F.col("booked") + F.col("seen")).withColumn("mark", start + F.col("booked") + F.col("worst"))

    top = x.groupBy(*key).agg(F.max("equity").alias("m")).select(*key, F.greatest(F.lit(start), F.max("m").over(past)).alias("p"))
    peak = lambda w: F.greatest(F.col("p"), F.max("equity").over(w))
    x = x.join(top, key).withColumn("before", peak(rest.rowsBetween(Window.unboundedPreceding, -1))).withColumn("peak", peak(upto))
    fall = lambda v, p: F.when(F.col(p) > 0, F.least(F.lit(0.0), (F.col(v) - F.col(p)) / F.col(p)))
    none = F.lit(None).cast("double")
    seen = x.select(*key, none.alias("mark"), fall("equity", "before").alias("fall"))
    held = x.where("open > 0.5 AND until > at").withColumn("date", F.explode(tx.overlapped_loss_days(F.timestamp_micros("at"), F.timestamp_micros("until"))))
    held = held.select("account", tx.day_number(F.col("date")).alias("day"), "mark", fall("mark", "peak").alias("fall"))
    low = seen.unionByName(held).groupBy(*key).agg(F.min("mark").alias("mark"), F.min("fall").alias("fall"))
    return daily.join(low, key, "left").select(*daily.columns, F.least("opening", "equity", "mark").alias("minimum"), F.coalesce("fall", F.lit(0.0)).alias("drawdown"))
