"""Windows of candidates as JSON lists: typed rows, or a refusal that says which window is wrong and how."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: What a text holds, taken out of it in one pass; what is of another kind is null.
LIST = "array<struct<window: string, test_start_ns: variant, test_end_ns: variant, net_r_events: variant>>"


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _whole(v: Column) -> Column:
    return F.when(_kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def _event(e: Column) -> Column:
    """ts_ns and net_r of [time in nanoseconds, net R], a whole number and an exact decimal, as a number or a text; null for what is none."""
    ts, r = F.get(e, F.lit(0)), F.get(e, F.lit(1))
    exact = F.when(_kind(r).substr(1, 7).isin("BIGINT", "STRING", "DECIMAL"), F.try_variant_get(r, "$", "decimal(38,18)"))
    return F.struct(F.when(F.size(e) == 2, _whole(ts)).alias("ts_ns"), exact.alias("net_r"))


def candidate_windows(texts: DataFrame, keys: list[str], column: str = "json") -> DataFrame:
    """keys, window, test_start_ns, test_end_ns and events (ts_ns, net_r) of every window of every text, a list of
    {"window", "test_start_ns", "test_end_ns", "net_r_events"}. A missing label is empty. A text that is no list, a
    window that is no object, bounds that are no whole numbers, events that are no list of [time, net R], and a label
    that a text repeats fail the query, naming the keys, the window's place and what is wrong. An empty list has no
    windows."""
    items = F.try_variant_get(F.try_parse_json(F.col(column).cast("string")), "$", LIST)
    who = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    fail = lambda what: F.raise_error(F.concat(who, F.lit(": "), what))
    x = texts.select(*keys, F.posexplode(F.coalesce(items, fail(F.lit("not a list of windows")).cast(LIST))).alias("place", "w"))
    x = x.select(
        *keys, "place", F.col("w").isNotNull().alias("object"), F.coalesce("w.window", F.lit("")).alias("window"), *(_whole(F.col(f"w.{c}")).alias(c) for c in ("test_start_ns", "test_end_ns")),
        F.transform(F.try_variant_get("w.net_r_events", "$", "array<array<variant>>"), _event).alias("events"),
    )
    whole = F.forall("events", lambda e: e["ts_ns"].isNotNull() & e["net_r"].isNotNull())
    wrong = F.concat_ws(
        ", ", F.when(~F.col("object"), "no object"), *(F.when(F.col(c).isNull(), c) for c in ("test_start_ns", "test_end_ns")), F.when(~F.coalesce(whole, F.lit(False)), "net_r_events"),
    )
    x = x.withColumn("wrong", wrong).withColumn("times", F.count("*").over(Window.partitionBy(*reversed(keys), "window")))
    said = F.when(F.col("wrong") != "", fail(F.concat(F.lit("window "), F.col("place").cast("string"), F.lit(": "), F.col("wrong")))).when(F.col("times") > 1, fail(F.concat(F.lit("repeats window "), F.col("window"))))
    x = x.withColumn("ok", F.coalesce(said.cast("boolean"), F.lit(True))).where("ok")
    return x.select(*keys, "window", "test_start_ns", "test_end_ns", "events")
