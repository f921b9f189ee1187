"""Strict price scans: decimals from text, refused in the pass that makes them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import scans
from .files import Folder
from .vendor import EXPORT, stamp

#: Digits of a price: whole ones and decimals.
WHOLE, DIGITS = 18, 10
#: Fixed value: prices as exports spell them.
NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
PRICES = ("low", "high", "close")


def export_texts(spark: SparkSession, path: str, zone: str | None = None) -> DataFrame:
    """market (the file's name), block, line, ts and the prices as text of every export under path: block and line are a
    row's place in its file."""
    texts = EXPORT.replace("decimal(18,5)", "string")
    x = spark.read.schema(texts).options(sep="\t", header=True, enforceSchema=False, mode="FAILFAST").csv(path)
    market = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return x.select(market.alias("market"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), stamp(F.col("`<DATE>`"), F.col("`<TIME>`"), zone).alias("ts"), *(F.col(f"`<{c.upper()}>`").alias(c) for c in PRICES))


def write_scan(texts: DataFrame, path: str, keys: tuple[str, ...] = ("market",), order: tuple[str, ...] = ("block", "line"), prices: tuple[str, ...] = PRICES) -> DataFrame:
    """Writes keys, ts and the prices as decimals to path and returns them read back. texts: keys, ts, prices as text, and
    order, the place of a row in its source; block, its first column, is what one task takes. Metrics are observed in
    the pass that writes; if any is not 0 the folder is deleted again and a ValueError names them: a time that repeats
    the one before or lies before it, a time that is missing, a price that is no finite number, and one with more
    digits than a decimal(28,10) keeps. An empty source gives an empty table."""
    spark = texts.sparkSession
    x = scans.lagged(texts, list(keys), list(order), F.col(order[0]), "ts", "__before")
    trimmed = {p: F.trim(F.coalesce(F.col(p).cast("string"), F.lit(""))) for p in prices}
    x = x.withColumns({f"__t_{p}": v for p, v in trimmed.items()})
    exact = {p: F.expr(f"try_cast(__t_{p} AS decimal({WHOLE + DIGITS},{DIGITS}))") for p in prices}
    number = {p: F.col(f"__t_{p}").rlike(NUMBER) for p in prices}
    same = {p: F.expr(f"try_cast(__t_{p} AS decimal(38,{38 - WHOLE}))").eqNullSafe(v.cast(f"decimal(38,{38 - WHOLE})")) & v.isNotNull() for p, v in exact.items()}
    some = lambda cs: reduce(lambda a, b: a | b, cs)
    watch = Observation("scan")
    y = x.observe(
        watch, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("ts") == F.col("__before")).alias("repeated"), F.count_if(F.col("ts") < F.col("__before")).alias("unordered"), F.count_if(F.col("ts").isNull()).alias("without_time"),
        F.count_if(some([~n for n in number.values()])).alias("not_finite"), F.count_if(some([number[p] & ~same[p] for p in prices])).alias("inexact"),
    )
    y.select(*keys, "ts", *(v.alias(p) for p, v in exact.items())).write.parquet(path)
    found = watch.get
    bad = {k: n for k, n in found.items() if k != "rows" and n}
    if bad:
        parent, _, name = path.rstrip("/").rpartition("/")
        Folder(spark, parent).delete(name)
        raise ValueError("prices are refused: " + ", ".join(f"{n} {k}" for k, n in sorted(bad.items())))
    return spark.read.parquet(path)
