"""Vendor bar exports, the catalogue of bid and ask bars made of them, and the checks before it is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeaxis as tx
from .files import Folder, digests

#: The columns of an export, tab-separated.
EXPORT = "`<DATE>` string, `<TIME>` string, `<OPEN>` decimal(18,5), `<HIGH>` decimal(18,5), `<LOW>` decimal(18,5), `<CLOSE>` decimal(18,5), `<TICKVOL>` long, `<VOL>` long, `<SPREAD>` int"
PRICES = ("open", "high", "low", "close")


def stamp(date: Column, time: Column, zone: str | None = tx.SERVER_ZONE, offset_hours: int = 0) -> Column:
    """UTC of a server's date and time texts: by its zone, or (zone None) less fixed hours. Malformed texts fail."""
    wall = F.to_timestamp_ntz(F.concat_ws(" ", date, time), F.lit("yyyy.MM.dd HH:mm:ss"))
    return tx.server_to_utc(wall, zone, 0 if zone else offset_hours).cast("timestamp_ntz")


def read_export(spark: SparkSession, path: str, zone: str | None = tx.SERVER_ZONE, offset_hours: int = 0) -> DataFrame:
    """market (the file's name), ts, prices, spread of every export under path. Another header or a cell that is no
    number fails the read. zone None leaves the server's clock."""
    x = spark.read.schema(EXPORT).options(sep="\t", header=True, enforceSchema=False, mode="FAILFAST").csv(path)
    market = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    ts = stamp(F.col("`<DATE>`"), F.col("`<TIME>`"), zone, offset_hours)
    return x.select(market.alias("market"), ts.alias("ts"), *(F.col(f"`<{c.upper()}>`").alias(c) for c in PRICES), F.col("`<SPREAD>`").alias("spread"))


def bid_ask(bars: DataFrame, by: list[str], tick: str, slippage_points: float = 0.0) -> DataFrame:
    """Two rows a bar, side 'bid' and 'ask'. Prices are bids; the ask lies `spread` ticks above, and half the slippage
    moves each side outwards. A spread that is null or not positive counts as the market's median of the positive ones,
    cut to a whole number, or 0 without any. Prices are rounded half up to ticks. One pass counts spreads by value,
    so a large market is as cheap as a small one."""
    counts = bars.where("spread > 0").groupBy(*by, "spread").agg(F.count("*").alias("n"))
    usual = counts.groupBy(*by).agg(F.expr("cast(percentile(spread, 0.5, n) as int)").alias("__usual"))
    same = F.lit(True)
    right = usual.select(*(F.col(c).alias(f"__{c}") for c in by), "__usual")
    for c in by:
        same = same & bars[c].eqNullSafe(right[f"__{c}"])
    x = bars.join(right, same, "left")
    unit = F.lit(tick).cast("decimal(12,6)")
    half = (F.lit(str(slippage_points)).cast("decimal(12,6)") * unit / 2).cast("decimal(18,9)")
    points = F.when(F.col("spread") > 0, F.col("spread")).otherwise(F.coalesce("__usual", F.lit(0))).cast("decimal(9,0)")
    up = (points * unit + half).cast("decimal(18,9)")

    def side(name: str, move: Column) -> Column:
        return F.struct(F.lit(name).alias("side"), *((F.round(((F.col(c).cast("decimal(18,9)") + move) / unit).cast("decimal(28,9)"), 0) * unit).cast("decimal(18,5)").alias(c) for c in PRICES))

    x = x.select(*by, "ts", F.explode(F.array(side("bid", -half), side("ask", up))).alias("s"))
    return x.select(*by, "ts", "s.*")


def write_catalogue(spark: SparkSession, exports: str, path: str, tick: str, zone: str | None = tx.SERVER_ZONE, slippage_points: float = 0.0) -> DataFrame:
    """Writes the exports' bars under path/bars by market and side, then a line a market to path/manifest: market,
    frame, sha256, bars (a side), version. A market's folders are replaced whole, so an export with another span
    leaves nothing behind; a job that dies before the manifest leaves the market stale. Returns the lines."""
    both = bid_ask(read_export(spark, exports, zone), ["market"], tick, slippage_points)
    # a market's rows spread over tasks by time; each task writes a file of its markets
    both.repartitionByRange("market", "side", "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("market", "side").parquet(f"{path}/bars")
    wrote = digests(spark, exports).select(F.col("name").alias("market"), "sha256")
    counts = spark.read.parquet(f"{path}/bars").where("side = 'bid'").groupBy("market").agg(F.count("*").alias("bars"))
    lines = wrote.join(counts.withColumn("market", F.col("market").cast("string")), "market", "left").select(
        "market", F.lit(zone or "UTC").alias("frame"), "sha256", F.coalesce("bars", F.lit(0)).alias("bars"), F.unix_micros(F.current_timestamp()).alias("version")
    )
    lines.write.mode("append").json(f"{path}/manifest")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The latest line of each market; empty without a catalogue."""
    kinds = "market string, frame string, sha256 string, bars long, version long"
    if not Folder(spark, path).exists("manifest"):
        return spark.createDataFrame([], kinds)
    x = spark.read.schema(kinds).json(f"{path}/manifest")
    return x.groupBy("market").agg(F.max_by(F.struct("frame", "sha256", "bars", "version"), "version").alias("m")).select("market", "m.*")


def stale(spark: SparkSession, exports: str, path: str, zone: str | None = tx.SERVER_ZONE) -> DataFrame:
    """market, reason of exports that the catalogue doesn't hold as they are: absent, frame, or source."""
    now = digests(spark, exports).select(F.col("name").alias("market"), F.col("sha256").alias("now"))
    x = now.join(manifest(spark, path), "market", "left")
    why = F.when(F.col("sha256").isNull(), "absent").when(F.col("frame") != (zone or "UTC"), "frame").when(F.col("sha256") != F.col("now"), "source")
    return x.select("market", why.alias("reason")).where("reason IS NOT NULL")


def read_catalogue(spark: SparkSession, exports: str, path: str, zone: str | None = tx.SERVER_ZONE) -> DataFrame:
    """The catalogue's bars; ValueError when any export changed or was read on another clock."""
    bad = stale(spark, exports, path, zone).orderBy("market").limit(20).collect()  # names for the message
    if bad:
        raise ValueError("stale catalogue: " + ", ".join(f"{r['market']} ({r['reason']})" for r in bad))
    return spark.read.parquet(f"{path}/bars").withColumn("market", F.col("market").cast("string"))


def last_closed(bars: DataFrame, by: list[str], n: int, now: Column, hours: int = tx.BAR_HOURS) -> DataFrame:
    """The latest n bars of each market that have ended at `now`; the forming bar is none of them."""
    from pyspark.sql import Window

    done = bars.where(F.col("ts") + F.expr(f"INTERVAL '{hours}' HOUR") <= now)
    w = Window.partitionBy(*by).orderBy(F.col("ts").desc())
    return done.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")
