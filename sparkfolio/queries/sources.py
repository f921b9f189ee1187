"""Queries of exports, bar series and streams, over the derived bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import deals as dl, files, prices, tables as tb, vendor
from ..streaming import cycles
from .base import query

#: Ticks and slippage of the derived exports.
TICK, SLIPPAGE = "0.01", 3.2


def export(spark, sf):
    """The bars as an export's rows, on the server's clock."""
    b = tb.bars(spark, sf)
    price = [F.col(c).cast("decimal(18,2)").cast("decimal(18,5)").alias(c) for c in vendor.PRICES]
    return b.select("market", F.date_format("ts", "yyyy.MM.dd").alias("date"), F.date_format("ts", "HH:mm:ss").alias("time"), *price, (F.col("ticks") % 5 - 1).cast("int").alias("spread"))


EXPORT = f"{tb.BARS},\nexport AS (SELECT market, ts, ticks % 5 - 1 AS spread, open::DECIMAL(18,2)::DOUBLE AS open, high::DECIMAL(18,2)::DOUBLE AS high, low::DECIMAL(18,2)::DOUBLE AS low, close::DECIMAL(18,2)::DOUBLE AS close FROM bars)"


@query(
    "S01_export_times",
    """SELECT market, strftime(ts, '%Y.%m.%d %H:%M:%S') AS wall, (ts AT TIME ZONE 'Europe/Athens') AT TIME ZONE 'UTC' AS by_zone,
 ts AS as_utc, ts - INTERVAL 3 HOUR AS by_hours FROM export""",
    ctes=EXPORT,
)
def s01(spark, sf):
    x, d, t = export(spark, sf), F.col("date"), F.col("time")
    return x.select("market", F.concat_ws(" ", d, t).alias("wall"), vendor.stamp(d, t).alias("by_zone"), vendor.stamp(d, t, None).alias("as_utc"), vendor.stamp(d, t, None, 3).alias("by_hours"))


@query(
    "S02_bid_ask",
    """SELECT market, ts, side, round(open + move, 2) AS open, round(high + move, 2) AS high, round(low + move, 2) AS low, round(close + move, 2) AS close
 FROM (SELECT e.*, side, CASE side WHEN 'bid' THEN -0.016 ELSE CASE WHEN spread > 0 THEN spread ELSE coalesce(usual, 0) END * 0.01 + 0.016 END::DOUBLE AS move
 FROM export e LEFT JOIN (SELECT market, CAST(trunc(median(spread)) AS INTEGER) AS usual FROM export WHERE spread > 0 GROUP BY 1) USING (market), (VALUES ('bid'), ('ask')) s(side))""",
    "open high low close",
    EXPORT,
)
def s02(spark, sf):
    x = export(spark, sf).withColumn("ts", vendor.stamp(F.col("date"), F.col("time"), None))
    x = vendor.bid_ask(x, ["market"], TICK, SLIPPAGE)
    return x.select("market", "ts", "side", *(F.col(c).cast("double").alias(c) for c in vendor.PRICES))


@query(
    "S10_last_closed",
    """SELECT market, ts, close FROM bars WHERE ts + INTERVAL 4 HOUR <= TIMESTAMP '2024-01-20 10:00:00'
 QUALIFY row_number() OVER (PARTITION BY market ORDER BY ts DESC) <= 50""",
    "close",
    tb.BARS,
)
def s10(spark, sf):
    return vendor.last_closed(tb.bars(spark, sf), ["market"], 50, F.lit("2024-01-20 10:00:00").cast("timestamp_ntz")).select("market", "ts", "close")


@query(
    "L04_closed_bars",
    "SELECT market, ts, open, high, low, close, ticks FROM bars WHERE ts + INTERVAL 4 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 4 HOUR",
    "open high low close",
    tb.BARS,
)
def l04(spark, sf):
    """The events as a stream, read to their end."""
    kinds = spark.read.parquet(f"{sf}/events.parquet").schema
    e = spark.readStream.schema(kinds).option("pathGlobFilter", "events.parquet").parquet(sf)
    ticks = e.select(F.col("event_type").alias("market"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), "value")
    at = files.scratch(spark, "closed-bars")
    q = cycles.closed_bars(ticks).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(cycles.BAR).parquet(f"{at}/out")


@query("S08_price_scan", "SELECT market, ts, low, high, close FROM bars", "low high close", tb.BARS)
def s08(spark, sf):
    """The bars as texts in order of time, a block a day, scanned into decimals."""
    b = tb.bars(spark, sf)
    texts = b.select("market", F.to_date("ts").alias("day"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("line"), "ts", *(F.col(c).cast("string").alias(c) for c in prices.PRICES))
    texts = texts.withColumn("block", F.unix_date("day")).drop("day")
    x = prices.write_scan(texts, files.scratch(spark, "prices"))
    return x.select("market", "ts", *(F.col(c).cast("double").alias(c) for c in prices.PRICES))


@query(
    "S11_typed_deals",
    "SELECT ticket, time, type, entry, position_id, symbol, CAST(1 + ticket % 3 AS DOUBLE) AS volume, CAST(ticket AS DOUBLE) / 4 AS price, CAST(profit AS DOUBLE) AS profit, CAST(swap AS DOUBLE) AS swap, CAST(commission AS DOUBLE) AS commission, CAST(fee AS DOUBLE) AS fee FROM deals",
    "volume price profit swap commission fee",
    tb.DEALS,
)
def s11(spark, sf):
    """The deals as texts, typed again; a missing fee is 0."""
    d = tb.deals(spark, sf).withColumns({"volume": 1 + F.col("ticket") % 3, "price": F.col("ticket") / 4, "fee": F.when(F.col("ticket") % 2 == 0, F.col("fee"))})
    x = dl.typed_deals(d.select(*(F.col(c).cast("string").alias(c) for c in dl.FIELDS)))
    return x.select(*(F.col(c).cast("double").alias(c) if kind.startswith("decimal") else c for c, kind in dl.FIELDS.items()))
