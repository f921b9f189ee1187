"""Prefix scans over long groups, dealt to cuts: what comes before a row is what its own cut brings and what the cuts before
it bring together. Windows then span a cut and not a group, so one market with most of all rows is many tasks.

A cut is a number that never falls along the order of its group: the days or units of the first order column divided by
a width. It is a function of the row alone, so passes agree without a written table. Every scan makes two passes: one
sums each cut (narrow columns, summed before they are shuffled), one goes over the rows with what was carried. The carried
rows are one a cut. A burst within the width of a cut stays one task, which sorts with spill."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUT = "__cut"
#: What exact sums add up: 15 digits after the point, values under 10**13.
DECIMAL = "decimal(28,15)"


def parts(value: Column) -> tuple[Column, Column]:
    """A double as a decimal, and as it is where DECIMAL can't hold it (infinite, NaN, too large); null in the other one."""
    d = value.try_cast(DECIMAL)
    return d, F.when(d.isNull(), value)


def cut_by(df: DataFrame, on: str, width: int | None) -> Column | None:
    """The cut of each row: `width` days of a date or time, `width` units of a number; none without a width."""
    if width is None:
        return None
    kind = dict(df.dtypes)[on]
    if kind.startswith(("timestamp", "date")):
        return F.floor(F.datediff(F.to_date(on), F.lit("1970-01-01").cast("date")) / width).cast("long")
    return F.floor(F.col(on) / width).cast("long")


def _carried(x: DataFrame, carry: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """x and its cut's row of carry; null keys meet."""
    c = carry.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *names)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & x[k].eqNullSafe(c[f"__k{i}"])
    return x.join(c, same).drop(*(f"__k{i}" for i in range(len(keys))))


def running(df: DataFrame, by: list[str], order: list[str], cut: Column | None, what: dict[str, tuple[str, Column]], exclusive: bool = False, backward: bool = False) -> DataFrame:
    """df and, for each name, the sum, count, max, min or last of a value over the rows of the group up to this one (with
    exclusive: before it); null before anything counts. what: name -> (kind, value). last skips nulls. exact is a sum of
    doubles as decimals, whose error doesn't grow with the rows. backward: from the end of the order on. order is total
    where results depend on it. Without a cut a group is one window."""
    if exact := [n for n, (kind, _) in what.items() if kind == "exact"]:
        split = {n: parts(what[n][1]) for n in exact}
        each = {k: v for k, v in what.items() if k not in split} | {f"__{i}_{n}": ("sum", p) for n in exact for i, p in enumerate(split[n])}
        x = running(df, by, order, cut, each, exclusive, backward)
        whole = {n: (F.col(f"__0_{n}").cast("double"), F.col(f"__1_{n}")) for n in exact}
        return x.select(*df.columns, *((F.coalesce(whole[n][0] + whole[n][1], *whole[n]) if n in whole else F.col(n)).alias(n) for n in what))
    end = F.desc if backward else F.asc
    local = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "last": lambda v: F.last(v, True)}
    edge = Window.unboundedPreceding, -1 if exclusive else 0
    if cut is None:
        w = Window.partitionBy(*by).orderBy(*(end(c) for c in order)).rowsBetween(*edge)
        return df.withColumns({n: local[kind](v).over(w) for n, (kind, v) in what.items()})
    x, keys = df.withColumn(CUT, cut), [*by, CUT]
    far = F.min_by if backward else F.max_by
    place = F.struct(*order)
    total = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "last": lambda v: far(v, F.when(v.isNotNull(), place))}
    merge = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "last": lambda v: F.last(v, True)}
    totals = x.groupBy(*keys).agg(*(total[kind](v).alias(f"__t_{n}") for n, (kind, v) in what.items()))
    before = Window.partitionBy(*by).orderBy(end(CUT)).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, *(merge[kind](F.col(f"__t_{n}")).over(before).alias(f"__c_{n}") for n, (kind, _) in what.items()))
    w = Window.partitionBy(*keys).orderBy(*(end(c) for c in order)).rowsBetween(*edge)
    x = x.select("*", *(local[kind](v).over(w).alias(f"__l_{n}") for n, (kind, v) in what.items()))
    x = _carried(x, carry, keys, [f"__c_{n}" for n in what])

    def joined(n: str, kind: str) -> Column:
        c, own = F.col(f"__c_{n}"), F.col(f"__l_{n}")
        if kind in ("sum", "count"):
            return F.coalesce(c + own, c, own)
        return F.coalesce(own, c) if kind == "last" else (F.greatest if kind == "max" else F.least)(c, own)

    return x.select(*df.columns, *(joined(n, kind).alias(n) for n, (kind, _) in what.items()))


def numbered(df: DataFrame, by: list[str], order: list[str], cut: Column | None, to: str) -> DataFrame:
    """df and the row's number in its group, from 1."""
    return running(df, by, order, cut, {to: ("count", F.lit(1))})


def lagged(df: DataFrame, by: list[str], order: list[str], cut: Column | None, value: str, to: str) -> DataFrame:
    """df and the value of the row before, which may be null; null on the first."""
    x = running(df, by, order, cut, {"__lag": ("last", F.struct(F.col(value).alias("v")))}, exclusive=True)
    return x.withColumn(to, F.col("__lag.v")).drop("__lag")


def levels(df: DataFrame, by: list[str], order: list[str], cut: Column | None, value: str, start: float, to: str = "equity", peak: str = "peak") -> DataFrame:
    """df with the running level, start and all values so far, and its highest so far, the start included. A cut's summary
    is its sum and the highest of its own running sums; entering level and peak follow from the summaries before it."""
    start_ = F.lit(float(start))
    if cut is None:
        x = running(df, by, order, None, {"__s": ("sum", F.col(value))}).withColumn(to, start_ + F.col("__s")).drop("__s")
        x = running(x, by, order, None, {"__p": ("max", F.col(to))})
        return x.withColumn(peak, F.greatest(start_, "__p")).drop("__p")
    x, keys = df.withColumn(CUT, cut), [*by, CUT]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("__s", F.sum(value).over(w))
    totals = x.groupBy(*keys).agg(F.sum(value).alias("__sum"), F.max("__s").alias("__high"))
    before = Window.partitionBy(*by).orderBy(CUT).rowsBetween(Window.unboundedPreceding, -1)
    t = totals.withColumn("__at", start_ + F.coalesce(F.sum("__sum").over(before), F.lit(0.0)))
    t = t.withColumn("__top", F.greatest(start_, F.max(F.col("__at") + F.col("__high")).over(before)))
    x = _carried(x, t, keys, ["__at", "__top"]).withColumn(to, F.col("__at") + F.col("__s"))
    x = x.withColumn(peak, F.greatest("__top", F.max(to).over(w)))
    return x.drop("__s", "__at", "__top", CUT)


def deepest(df: DataFrame, by: list[str], order: list[str], cut: Column | None, value: str, start: float) -> DataFrame:
    """by and max_dd, the largest fall of the running level from its peak, as a share of the peak."""
    x = levels(df, by, order, cut, value, start)
    return x.groupBy(*by).agg(F.max((F.col("peak") - F.col("equity")) / F.col("peak")).alias("max_dd"))


def rolling(df: DataFrame, by: list[str], order: list[str], cut: Column | None, n: int, what: dict[str, Column], block: int = 50_000, number: str = "__at") -> DataFrame:
    """df with aggregates over the last n rows of the group, this one included, and the row's number. Rows are numbered
    by a scan and dealt to blocks of equal numbers; the last n - 1 rows of a block also go to the next one, where they
    only fill frames. what: name -> aggregate. Without a cut a group is one window."""
    x = numbered(df, by, order, cut, number)
    if cut is None:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - n, 0)
        return x.withColumns({k: v.over(w) for k, v in what.items()})
    block, at = max(block, n), F.col(number) - 1
    own = F.floor(at / block)
    where = F.when(at % block >= block - (n - 1), F.array(own, own + 1)).otherwise(F.array(own))
    x = x.withColumn("__block", F.explode(where)).withColumn("__own", F.col("__block") == own)
    w = Window.partitionBy(*by, "__block").orderBy(number).rowsBetween(1 - n, 0)
    return x.withColumns({k: v.over(w) for k, v in what.items()}).where("__own").drop("__block", "__own")


def affine(df: DataFrame, by: list[str], order: list[str], cut: Column | None, what: dict[str, tuple[float, str, str | float]]) -> DataFrame:
    """df with recurrences y = (1 - alpha) y + alpha x along the order. what: name -> (alpha, x, start); start is what y is
    before the first row, a number or "first" for the first x. A cut of m rows maps an entering y to (1 - alpha)**m y + b,
    where b is what the cut makes of 0: maps are summed up for each cut, composed from cut to cut over one row a cut, and
    every cut then runs from what enters it. Values are not null."""
    x = df.withColumn(CUT, F.lit(0).cast("long") if cut is None else cut)
    keys = [*by, CUT]
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    y = x.withColumn("__left", F.row_number().over(w) - 1)
    first = F.min_by  # the first row of a cut in the order
    made = [F.count("*").alias("__m"), F.min(F.struct(*order)).alias("__o")]
    for n, (alpha, value, _) in what.items():
        made += [F.sum(alpha * F.pow(F.lit(1 - alpha), F.col("__left")) * F.col(value)).alias(f"__b_{n}"), first(F.col(value), F.struct(*order)).alias(f"__f_{n}")]
    maps = y.groupBy(*keys).agg(*made).drop("__o")
    entry = ", ".join(f"__e_{n} double" for n in what)

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CUT, kind="stable")
        out = pdf[keys].copy()
        for n, (alpha, _, start) in what.items():
            state, states = float(pdf[f"__f_{n}"].iloc[0] if start == "first" else start), []
            for m, b in zip(pdf["__m"], pdf[f"__b_{n}"]):
                states.append(state)
                state = (1 - alpha) ** m * state + b
            out[f"__e_{n}"] = states
        return out

    kinds = dict(x.dtypes)
    entered = maps.groupBy(*by).applyInPandas(compose, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", {entry}")
    x = _carried(x, entered, keys, [f"__e_{n}" for n in what])
    columns = [*df.columns, *what]
    schema = df.select("*", *(F.lit(0.0).alias(n) for n in what)).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        for n, (alpha, value, _) in what.items():
            seeded = np.concatenate([pdf[f"__e_{n}"].to_numpy(float)[:1], pdf[value].to_numpy(float)])
            pdf[n] = pd.Series(seeded).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]
        return pdf[columns]

    return x.groupBy(*keys).applyInPandas(run, schema)
