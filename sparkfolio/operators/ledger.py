"""Broker deals: ledgers, round trips, balances and live statistics, in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def amount() -> Column:
    return (F.col("profit") + F.col("swap") + F.col("commission") + F.col("fee")).cast(MONEY)


def direction(kind: Column) -> Column:
    """BUY or SELL; any other deal type fails the job."""
    return F.when(kind == 0, "BUY").when(kind == 1, "SELL").otherwise(F.raise_error(F.concat(F.lit("unknown deal type "), F.coalesce(kind.cast("string"), F.lit("null")))))


def ledger(deals: DataFrame, account: str = "account") -> DataFrame:
    """account, time, ticket, amount: every deal that moves money."""
    return deals.select(account, "time", "ticket", amount().alias("amount")).where("amount <> 0")


#: Seconds of the stretches that running sums go through first.
STRETCH = 86_400


def _upto(led: DataFrame, account: str) -> DataFrame:
    """led and upto, the account's sum through each row, and all, its whole sum. Two levels: stretches of a day are
    added up and summed, a row an account and day; rows are sorted within their day only."""
    x = led.withColumn("__part", F.floor(F.col("time") / STRETCH))
    parts = x.groupBy(account, "__part").agg(F.sum("amount").alias("s"))
    over = Window.partitionBy(account).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(account).alias("__a"), F.col("__part").alias("__p"), F.coalesce(F.sum("s").over(over), F.lit(0)).alias("__before"), F.sum("s").over(Window.partitionBy(account)).alias("__all"))
    x = x.join(parts, F.col(account).eqNullSafe(F.col("__a")) & (F.col("__part") == F.col("__p")))
    inside = F.sum("amount").over(Window.partitionBy(account, "__part").orderBy("time", "ticket").rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("__upto", F.col("__before") + inside).drop("__a", "__p", "__part", "__before")


def equity(led: DataFrame, start: float, account: str = "account") -> DataFrame:
    """Running balance in the order of time and ticket."""
    x = _upto(led, account)
    return x.withColumn("balance", (F.lit(str(start)).cast(MONEY) + F.col("__upto")).cast("decimal(28,4)")).drop("__upto", "__all")


def backward(led: DataFrame, current: float, account: str = "account") -> DataFrame:
    """Balance before and after each entry, walked back from the current balance."""
    x = _upto(led, account)
    after = (F.lit(str(current)).cast(MONEY) - (F.col("__all") - F.col("__upto"))).cast("decimal(28,4)")
    return x.withColumn("after", after).withColumn("before", (F.col("after") - F.col("amount")).cast("decimal(28,4)")).drop("__upto", "__all")


def round_trips(deals: DataFrame) -> DataFrame:
    """One row a position with an entry and an exit leg: symbol, side, volume of entries, net money, open and close
    times and prices' tickets. Positions that unreconstructable() names drop out."""
    d = deals.where("symbol <> ''")
    key = F.struct("time", "ticket")
    x = d.groupBy("position_id").agg(
        F.min_by("symbol", key).alias("symbol"), F.min(F.when(F.col("entry") == 0, key)).alias("first_in"), F.max(F.when(F.col("entry") == 1, key)).alias("last_out"),
        F.min_by("type", F.when(F.col("entry") == 0, key)).alias("type"), F.sum(amount()).cast("decimal(28,4)").alias("net"), F.count_if(F.col("entry") == 0).alias("ins"), F.count_if(F.col("entry") == 1).alias("outs"),
        F.bool_or(F.col("entry").isin(2, 3)).alias("odd"), F.count_if((F.col("entry") == 0) & ~F.col("type").isin(0, 1)).alias("strange"),
    )
    later = F.col("strange") > (~F.col("type").isin(0, 1)).cast("int")  # the first entry's own type is refused below
    x = x.where("ins > 0 AND outs > 0 AND NOT odd").where(~later)
    return x.select("position_id", "symbol", direction(F.col("type")).alias("side"), F.col("first_in.time").alias("opened"), F.col("last_out.time").alias("closed"), F.col("first_in.ticket").alias("open_ticket"), "net", "ins", "outs")


def excluded(deals: DataFrame) -> DataFrame:
    """Positions that round_trips leaves out, and why."""
    g = deals.where("symbol <> '' AND type IN (0, 1)").groupBy("position_id").agg(F.count_if(F.col("entry") == 0).alias("ins"), F.count_if(F.col("entry") == 1).alias("outs"), F.bool_or(F.col("entry").isin(2, 3)).alias("odd"))
    why = F.when(F.col("odd"), "reversal").when(F.col("ins") == 0, "no entry").when(F.col("outs") == 0, "open")
    return g.withColumn("reason", why).where("reason IS NOT NULL").select("position_id", "reason")


def unreconstructable(deals: DataFrame) -> DataFrame:
    """position_id and reasons, in this order, of positions that can't be rebuilt from their legs: a reversal (entry 2), a
    leg closed by another position (3), and each type other than buy and sell of an entry leg after the first, the
    smallest first. One pass by position; types are few."""
    d = deals.where("symbol <> ''")
    key = F.struct("time", "ticket")
    first = d.where("entry = 0").groupBy("position_id").agg(F.min(key).alias("first"))
    x = d.join(first, "position_id", "left")
    later = F.when((F.col("entry") == 0) & (key > F.col("first")) & ~F.col("type").isin(0, 1), F.col("type"))
    g = x.groupBy("position_id").agg(F.bool_or(F.col("entry") == 2).alias("turned"), F.bool_or(F.col("entry") == 3).alias("by"), F.sort_array(F.collect_set(later)).alias("types"))
    said = lambda flag, text: F.when(F.col(flag), F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    types = F.transform("types", lambda t: F.concat(F.lit("later entry of type "), t.cast("string")))
    return g.select("position_id", F.concat(said("turned", "reversal"), said("by", "closed by another"), types).alias("reasons")).where(F.size("reasons") > 0)


def live_stats(trips: DataFrame, by: list[str]) -> DataFrame:
    """Counts, hit rate, profit factor and expectancy of net money."""
    win, loss = F.when(F.col("net") > 0, F.col("net")), F.when(F.col("net") < 0, F.col("net"))
    return trips.groupBy(*by).agg(
        F.count("*").alias("n"), (F.count(win).cast("double") / F.count("*")).alias("hit_rate"),
        F.try_divide(F.coalesce(F.sum(win), F.lit(0)).cast("double"), -F.sum(loss).cast("double")).alias("profit_factor"), (F.sum("net").cast("double") / F.count("*")).alias("expectancy"),
    )
