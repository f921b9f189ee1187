"""What a dashboard and a study report show: open risk, history windows, parity, task metrics and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import joins, walkforward


def open_risk(priced: DataFrame, by: list[str]) -> DataFrame:
    """Total risk of the positions that have a price, and the markets of those that have none, by name and once a
    position: with any of these no headroom may be shown."""
    bare = F.col("risk").isNull()
    x = priced.groupBy(*by, "market").agg(F.sum("risk").alias("s"), F.count_if(bare).alias("n"))  # a market a row before names are gathered
    names = F.flatten(F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.array_repeat("market", F.col("n").cast("int"))))))
    return x.groupBy(*by).agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("total"), names.alias("unpriceable"), (F.sum("n") == 0).alias("known"))


def history_window(led: DataFrame, since: int, current: float, account: str = "account") -> DataFrame:
    """Each account's balance on entering a window that starts at `since`, walked back from the current balance, and
    how many entries lie in and before it."""
    inside = F.col("time") >= since
    entering = F.lit(str(current)).cast("decimal(18,4)") - F.coalesce(F.sum(F.when(inside, F.col("amount"))), F.lit(0))
    return led.groupBy(account).agg(entering.cast("decimal(28,4)").alias("entering"), F.count_if(inside).alias("shown"), F.count_if(~inside).alias("hidden"))


def parity(live: DataFrame, reference: DataFrame, by: list[str]) -> DataFrame:
    """Live bars against reference bars by (by, ts), within the reference's span: bars in the span, matched, their rate,
    the largest relative difference of closes, and the most frequent distance in hours of unmatched bars to the nearest
    reference bar (the least on ties, 0 without any). ts and close; bars are unique by (by, ts)."""
    span = reference.groupBy(*by).agg(F.min("ts").alias("__a"), F.max("ts").alias("__b"))
    x = live.select(*by, "ts", "close").join(span, by).where("ts BETWEEN __a AND __b").drop("__a", "__b")
    x = x.join(reference.select(*by, "ts", F.col("close").alias("other")), [*by, "ts"], "left")
    near = joins.nearest(x, reference, by, "ts")
    apart = F.abs(F.unix_micros(F.col("nearest").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9
    matched = F.col("nearest") == F.col("ts")
    off = near.where(~matched).withColumn("off", F.round(apart, 6)).groupBy(*by, "off").count()
    off = off.groupBy(*by).agg(F.min_by("off", F.struct(-F.col("count"), F.col("off"))).alias("modal_offset_hours"))
    x = near.groupBy(*by).agg(
        F.count("*").alias("overlap"), F.count_if(matched).alias("matched"), F.coalesce(F.max(F.when(matched & (F.col("other") != 0), F.abs(F.col("close") - F.col("other")) / F.col("other"))), F.lit(0.0)).alias("close_diff_max")
    )
    return x.withColumn("match_rate", F.col("matched") / F.col("overlap")).join(off, by, "left").fillna({"modal_offset_hours": 0.0})


def task_metrics(windows: DataFrame, by: list[str]) -> DataFrame:
    """windows: oos and drawdown of each out-of-sample window of a task. Mean, share of profitable windows in percent,
    mean drawdown, and return over it (0.005 at least)."""
    x = windows.groupBy(*by).agg(F.avg("oos").alias("mean_oos"), (F.avg((F.col("oos") > 0).cast("double")) * 100).alias("pct_profitable"), F.avg("drawdown").alias("mean_dd"), F.count("*").alias("windows"))
    return x.withColumn("return_per_dd", F.col("mean_oos") / F.greatest("mean_dd", F.lit(0.005)))


def candidate_streams(cells: DataFrame) -> DataFrame:
    """cells: train_months, candidate, instrument, label, value. Each candidate's value by window, averaged over the
    instruments that all candidates of its train length have, on the windows that all those cells have; train lengths
    with fewer than two such windows have no stream. By counts: no candidate is compared with another."""
    c = cells.groupBy("train_months", "candidate", "instrument", "label").agg(F.max("value").alias("value"))
    total = c.groupBy("train_months").agg(F.countDistinct("candidate").alias("candidates"))
    have = c.groupBy("train_months", "instrument").agg(F.countDistinct("candidate").alias("n")).join(total, "train_months").where("n = candidates").select("train_months", "instrument")
    c = c.join(have, ["train_months", "instrument"])
    size = c.select("train_months", "candidate", "instrument").distinct().groupBy("train_months").agg(F.count("*").alias("cells"))
    full = c.groupBy("train_months", "label").agg(F.count("*").alias("n")).join(size, "train_months").where("n = cells").select("train_months", "label")
    enough = full.groupBy("train_months").agg(F.count("*").alias("k")).where("k >= 2").select("train_months")
    x = c.join(full.join(enough, "train_months"), ["train_months", "label"])
    return x.groupBy("train_months", "candidate", "label").agg(F.avg("value").alias("value"))


def worst_pbo(streams: DataFrame, lengths: list[int]) -> DataFrame:
    """The largest probability of overfitting over the train lengths (a few, given); lengths too short for it don't
    count, null if none is long enough."""
    s = streams.cache()
    each = [walkforward.pbo(s.where(F.col("train_months") == m), "candidate", "label", "value").withColumn("train_months", F.lit(m)) for m in lengths]
    x = each[0]
    for e in each[1:]:
        x = x.unionByName(e)
    return x.agg(F.max("pbo").alias("pbo"), F.max_by("train_months", "pbo").alias("train_months"))


def variation_pbo(cells: DataFrame) -> DataFrame:
    """pbo and splits over variations. cells: variation, instrument, train_months, label, value. Slices are the windows, by
    instrument, train length and label, of the cells (instrument and train length) that every variation has, and of
    those the ones that every variation has; a cell that one variation lacks doesn't shift the others. By counts."""
    c = cells.groupBy("variation", "instrument", "train_months", "label").agg(F.max("value").alias("value"))
    total = c.agg(F.countDistinct("variation").alias("variations")).withColumn("one", F.lit(1))
    have = c.groupBy("instrument", "train_months", "label").agg(F.count("*").alias("n")).withColumn("one", F.lit(1)).join(F.broadcast(total), "one").where("n = variations")  # total is one row
    slice_ = F.struct("instrument", "train_months", "label").alias("slice")
    x = c.join(have.select("instrument", "train_months", "label"), ["instrument", "train_months", "label"]).select("variation", slice_, "value")
    return walkforward.pbo(x, "variation", "slice", "value")


def variant_ranking(study: DataFrame, train_months: int, metric: str) -> DataFrame:
    """Variations of one train length by the mean of a metric over their instruments, best first, by name on ties."""
    x = study.where(F.col("train_months") == train_months).groupBy("variation").agg(F.avg(metric).alias("mean"), F.count("*").alias("instruments"))
    return x.orderBy(F.desc("mean"), "variation")


def live_against_backtest(live: DataFrame, backtest: DataFrame) -> DataFrame:
    """market, and n, hit rate and mean R of live trades (market, r) beside those of the back-test; markets that the
    back-test lacks keep nulls."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("market").agg(F.count("*").alias(f"{name}_n"), F.avg((F.col("r") > 0).cast("double")).alias(f"{name}_hit"), F.avg("r").alias(f"{name}_mean"))

    return side(live, "live").join(side(backtest, "test"), "market", "left")
