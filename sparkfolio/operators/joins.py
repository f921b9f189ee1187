"""Joins that Spark has no word for: as-of, nearest, interval overlap and membership. All are equi joins or windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scans


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], strict: bool = False, width: int | None = None) -> DataFrame:
    """left and, from the right row with the last `on` at or (strict) before left's, the values; null if there is
    none. One sort of the union by (by, on): no pairs are made. Right rows must be unique by (by, on). width: the days
    or units of `on` that one task takes; a cut without a right row gets the last one of the cuts before it."""
    cols = left.columns
    order = 1 if strict else 0  # strict: left rows go first at equal times
    a = left.select(*cols, *(F.lit(None).cast(right.schema[v].dataType).alias(f"__{v}") for v in values), F.lit(1 - order).alias("__side"), F.lit(False).alias("__right"))
    b = right.select(*(F.col(c) if c in {*by, on} else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols), *(F.col(v).alias(f"__{v}") for v in values), F.lit(order).alias("__side"), F.lit(True).alias("__right"))
    packed = F.when(F.col("__right"), F.struct(*(F.col(f"__{v}").alias(v) for v in values)))
    x = a.unionByName(b)
    x = scans.running(x, by, [on, "__side"], scans.cut_by(x, on, width), {"__got": ("last", packed)}).where(~F.col("__right"))
    return x.select(*cols, *(F.col("__got")[v].alias(v) for v in values))


def nearest(left: DataFrame, right: DataFrame, by: list[str], on: str, width: int | None = None) -> DataFrame:
    """left and nearest: the right `on` with the least distance, the earlier on ties. One sort of the union, in which the
    last right row before and the first one after are looked up, by cuts as in asof."""
    cols = left.columns
    r = right.select(*by, on).distinct()
    a = left.select(*cols, F.lit(1).alias("__side"))
    b = r.select(*(F.col(c) if c in {*by, on} else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols), F.lit(0).alias("__side"))
    x = a.unionByName(b).withColumn("__turned", 1 - F.col("__side"))  # both ways the right row of an equal time counts
    cut, found = scans.cut_by(x, on, width), F.when(F.col("__side") == 0, F.col(on))
    x = scans.running(x, by, [on, "__side"], cut, {"before": ("last", found)})
    x = scans.running(x, by, [on, "__turned"], cut, {"after": ("last", found)}, backward=True).where("__side = 1").drop("__side", "__turned")
    closer = F.col("after").isNotNull() & (F.col("before").isNull() | (F.col("after") - F.col(on) < F.col(on) - F.col("before")))
    return x.withColumn("nearest", F.when(closer, F.col("after")).otherwise(F.col("before"))).drop("before", "after")


#: Bytes of input, as its files are stored, of which one task of an interval join takes a share.
TASK_BYTES = 4 << 20


def tasks(*sides: DataFrame) -> int:
    """Tasks of a join: in proportion to the stored sizes of the files read, and no fewer than the session's; 1, the
    session's own choice, where these suffice or sizes are unknown."""
    spark = sides[0].sparkSession
    files = sorted({f for s in sides for f in s.inputFiles()})
    conf, path = spark._jsc.hadoopConfiguration(), lambda f: spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f))
    size = sum(path(f).getFileSystem(conf).getFileStatus(path(f)).getLen() for f in files)
    n = -(-size // TASK_BYTES)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else 1


def overlap(a: DataFrame, b: DataFrame, by: list[str], a_start: str, a_end: str, b_start: str, b_end: str, bucket: int) -> DataFrame:
    """Pairs of rows of one group whose half-open intervals of longs overlap. Both sides explode to the buckets they
    touch and meet in an equi join; a pair is kept only in the bucket of the later start, so it comes once."""
    slot = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor((F.col(hi) - 1) / bucket)))
    x = a.where(F.col(a_end) > F.col(a_start)).withColumn("__slot", slot(a_start, a_end))
    y = b.where(F.col(b_end) > F.col(b_start)).withColumn("__slot", slot(b_start, b_end))
    n = tasks(a, b)
    if n > 1:  # a task sorts about as many rows whatever the size of the input
        x, y = x.repartition(n, *by, "__slot"), y.repartition(n, *by, "__slot")
    j = x.join(y, [*by, "__slot"]).where((F.col(a_start) < F.col(b_end)) & (F.col(b_start) < F.col(a_end)))
    return j.where(F.floor(F.greatest(a_start, b_start) / bucket) == F.col("__slot")).drop("__slot")


#: Windows that are broadcast; more are met by an as-of join.
MOST_WINDOWS = 10_000


def member(events: DataFrame, windows: DataFrame, by: list[str], at: str, start: str, end: str, label: str) -> DataFrame:
    """Each event's window: the last one that has started, gaps belong to the window before them, and the last window
    is closed at its end; others drop out. Few windows are broadcast, so events neither move nor get sorted."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    last = windows.withColumn("__until", F.max(end).over(w)).withColumn("__next", F.lead(start).over(w.orderBy(start)))
    if windows.limit(MOST_WINDOWS + 1).count() > MOST_WINDOWS:
        last = last.select(*by, F.col(start).alias(at), label, "__until")
        return asof(events, last, by, at, [label, "__until"]).where(F.col(label).isNotNull() & (F.col(at) <= F.col("__until"))).drop("__until")
    last = last.select(*(F.col(c).alias(f"__{c}") for c in by), F.col(start).alias("__start"), "__next", "__until", F.col(label).alias("__label"))
    inside = (F.col(at) >= F.col("__start")) & (F.col(at) < F.coalesce("__next", F.col(at) + F.expr("INTERVAL '1' DAY"))) & (F.col(at) <= F.col("__until"))
    for c in by:
        inside = inside & (F.col(c) == F.col(f"__{c}"))
    return events.join(F.broadcast(last), inside).select(*events.columns, F.col("__label").alias(label))


def missing(expected: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    return expected.select(*on).distinct().join(actual.select(*on).distinct(), on, "left_anti")


def duplicates(df: DataFrame, on: list[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")


def grid(*sides: DataFrame) -> DataFrame:
    """All combinations of small parameter tables, each with its ordinal; not for data."""
    x = sides[0]
    for s in sides[1:]:
        x = x.crossJoin(s)
    return x


def pairs(long: DataFrame, item: str, on: list[str], value: str) -> DataFrame:
    """Rows of one key for every two different items, the smaller name first: a, b, va, vb."""
    a = long.select(*on, F.col(item).alias("a"), F.col(value).alias("va"))
    b = long.select(*on, F.col(item).alias("b"), F.col(value).alias("vb"))
    return a.join(b, on).where("a < b")
