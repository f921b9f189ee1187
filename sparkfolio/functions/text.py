"""Keys, exact numbers and messages as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def combo_key(params: Column) -> Column:
    """'a=1,b=2' of a map of strings, by key whatever the map's order; a null value reads 'null'."""
    one = lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))
    return F.array_join(F.transform(F.array_sort(F.map_entries(params)), one), ",")


def decimal_text(value: Column) -> Column:
    """A decimal without exponent, without zeros after its last digit and without a bare point: 1.50 is 1.5, 0.00 is 0."""
    plain = F.replace(F.format_number(value.cast("decimal(38,18)"), 18), F.lit(","), F.lit(""))
    return F.regexp_replace(plain, r"\.?0+$", "")


def redacted(text: Column, token: Column) -> Column:
    """Text without a token and without the part before its colon, which errors may carry alone. An empty or null token
    hides nothing."""
    head = F.split_part(token, F.lit(":"), F.lit(1))
    hide = lambda t, s: F.when(F.coalesce(s, F.lit("")) == "", t).otherwise(F.replace(t, s, F.lit("***")))
    return hide(hide(text, token), head)
