"""Broker deals from texts: typed, or refused with what is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import MONEY

#: Fixed value: a deal's fields and their types. A fee that is missing is 0; every other field must be there.
FIELDS = {
    "ticket": "long", "time": "long", "type": "int", "entry": "int", "position_id": "long", "symbol": "string", "volume": "double", "price": "double",
    "profit": MONEY.simpleString(), "swap": MONEY.simpleString(), "commission": MONEY.simpleString(), "fee": MONEY.simpleString(),
}


def typed_deals(raw: DataFrame) -> DataFrame:
    """raw's fields (texts or already typed) as FIELDS has them. A field that is null or malformed, a volume or price that
    isn't finite, and money with more digits than its type keeps fail the query, naming the ticket and the fields; no
    deal is dropped. A symbol may be empty: cash has none."""
    text = {c: F.col(c).cast("string") for c in FIELDS if c in raw.columns}
    text["fee"] = F.coalesce(text.get("fee", F.lit(None).cast("string")), F.lit("0"))
    value = {c: text[c] if kind == "string" else text[c].try_cast(kind) for c, kind in FIELDS.items()}
    wrong = []
    for c, kind in FIELDS.items():
        bad = value[c].isNull()
        if kind == "double":
            bad = bad | F.isnan(value[c]) | (F.abs(value[c]) == float("inf"))
        elif kind.startswith("decimal"):
            bad = bad | ~F.coalesce(text[c].try_cast("decimal(38,18)") == value[c].cast("decimal(38,18)"), F.lit(False))
        wrong.append(F.when(F.coalesce(bad, F.lit(True)), F.lit(c)))
    found = F.filter(F.array(*wrong), lambda n: n.isNotNull())
    said = F.raise_error(F.concat(F.lit("deal "), F.coalesce(text["ticket"], F.lit("?")), F.lit(" is refused: "), F.concat_ws(", ", found))).cast("boolean")
    x = raw.withColumn("__ok", F.when(F.size(found) > 0, said).otherwise(F.lit(True))).where("__ok")
    return x.select(*(value[c].alias(c) for c in FIELDS))
