"""Streams of ticks and balances: bars that have closed, cycles of signals over them, and rolls of the loss day."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import timeaxis as tx
from ..operators import signals
from ..sources.vendor import last_closed

BAR = "market string, ts timestamp_ntz, open double, high double, low double, close double, ticks long"


def closed_bars(ticks: DataFrame, late: str = "4 hours", hours: int = tx.BAR_HOURS) -> DataFrame:
    """ticks: market, ts (timestamp), id, value. A bar comes once the watermark, the latest ts less `late`, has passed
    its end; a forming bar never does. Ticks that come later still are dropped by the watermark. Equal ts go by id."""
    key = F.struct("at", "id")
    x = ticks.withColumn("at", F.col("ts")).withWatermark("ts", late).groupBy("market", F.window("ts", f"{hours} hours").alias("w"))
    x = x.agg(F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count("*").alias("ticks"))
    return x.select("market", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "ticks")


def _stored(spark: SparkSession, path: str, kinds: str) -> DataFrame:
    try:
        return spark.read.schema(kinds).parquet(path)
    except AnalysisException:  # nothing written yet
        return spark.createDataFrame([], kinds)


def cycle(path: str, rules: signals.EntryRules = signals.EntryRules(), history: int = 500, judge: Callable | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function. Each batch of closed bars goes to path/bars under its number; the markets it touches
    replay their last `history` bars, and the signals of the new bars go to path/signals under the same number.
    A bar is judged once: those that an earlier batch has judged are left out, and a batch that failed is written
    anew in place of what it left. `judge` (bars of one market as pandas, in order, to buy and sell arrays) may fail:
    that market's bars get its error and no signal, are tried again with the market's next bar, and others go on."""
    kinds = f"{BAR}, batch long"
    judged = judge or (lambda b: signals.signals(*(b[c].to_numpy(float) for c in ("open", "high", "low", "close")), rules))
    out = "market string, ts timestamp_ntz, buy boolean, sell boolean, error string"

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        new = pdf["fresh"].to_numpy(bool)
        try:
            buy, sell = judged(pdf)
            x = pdf[["market", "ts"]].assign(buy=buy, sell=sell, error=None)
        except Exception as e:  # one market's fault must not stop the others; it is stored with its bars
            x = pdf[["market", "ts"]].assign(buy=None, sell=None, error=f"{type(e).__name__}: {e}")
        return x[new]

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = _stored(spark, f"{path}/bars", kinds).where(F.col("batch") < number)
        batch.dropDuplicates(["market", "ts"]).join(old.select("market", "ts"), ["market", "ts"], "left_anti").write.mode("overwrite").parquet(f"{path}/bars/batch={number}")
        new = spark.read.parquet(f"{path}/bars/batch={number}")
        done = _stored(spark, f"{path}/signals", f"{out}, batch long").where((F.col("batch") < number) & F.col("error").isNull()).select("market", "ts", F.lit(True).alias("done"))
        every = old.drop("batch").unionByName(new).join(new.select("market").distinct(), "market", "left_semi")
        seen = last_closed(every, ["market"], history, F.lit("9999-12-31").cast("timestamp_ntz"))
        seen = seen.join(done, ["market", "ts"], "left").select("*", F.col("done").isNull().alias("fresh"))
        seen.groupBy("market").applyInPandas(replay, out).write.mode("overwrite").parquet(f"{path}/signals/batch={number}")

    return run


def start(bars: DataFrame, path: str, checkpoint: str, seconds: int | None = None, **kw) -> StreamingQuery:
    """Cycles over a stream of closed bars: every so many seconds, or once over all there is."""
    w = bars.writeStream.foreachBatch(cycle(path, **kw)).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)).start()


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """market, ts, buy, sell, error: the latest word on each bar."""
    x = _stored(spark, f"{path}/signals", "market string, ts timestamp_ntz, buy boolean, sell boolean, error string, batch long")
    return x.groupBy("market", "ts").agg(F.max_by(F.struct("buy", "sell", "error"), "batch").alias("d")).select("market", "ts", "d.*")


def day_rolls(balances: DataFrame, opening: dict[str, float] | None = None) -> DataFrame:
    """balances: account, ts (timestamp), balance, as a stream. At an account's first balance of a loss day: day, its
    opening balance and the highest balance banked at a day's start, as state by account. An account's first day opens
    at opening[account]; without it the row is halted and the account stays without state. A balance of a day that has
    passed changes nothing, and nor does one with a null."""
    opening = opening or {}
    x = balances.where("account IS NOT NULL AND balance IS NOT NULL AND ts IS NOT NULL").withColumn("day", tx.day_number(tx.loss_day(F.col("ts"))))

    def f(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first = pd.concat(list(frames)).sort_values("ts", kind="stable").drop_duplicates("day")  # a row a day
        rows = []
        for day, balance in zip(first["day"].tolist(), first["balance"].tolist()):
            last, start_, peak = state.get if state.exists else (None, None, None)
            if last is not None and day <= last:
                continue
            known = last is not None or key[0] in opening
            begin = balance if last is not None else opening.get(key[0])
            peak = balance if peak is None else max(peak, balance)
            if known:
                state.update((day, begin, peak))
            rows.append((key[0], day, begin, peak, not known))
        yield pd.DataFrame(rows, columns=["account", "day", "day_start", "peak", "halted"])

    kinds = "account string, day int, day_start double, peak double, halted boolean"
    return x.select("account", "ts", F.col("balance").cast("double").alias("balance"), "day").groupBy("account").applyInPandasWithState(f, kinds, "day int, day_start double, peak double", "append", "NoTimeout")


def stable(read: Callable[[], DataFrame], account: Callable[[], float], attempts: int = 3) -> tuple[DataFrame, float]:
    """A deal history and the account's balance that belong together: both read alike before and after. RuntimeError
    after so many attempts. Histories are compared by digest."""
    from ..sources.files import digest

    for _ in range(attempts):
        before, balance = digest(read()), account()
        after = read()
        if digest(after) == before and account() == balance:
            return after, balance
    raise RuntimeError(f"no stable history and account in {attempts} attempts")
