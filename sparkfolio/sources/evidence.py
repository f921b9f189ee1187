"""Evidence as JSON texts: written from typed rows, read back as VARIANT and checked field by field, without a loop over rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What schema_of_variant says of values that a kind takes.
SHAPES = {
    "long": r"^BIGINT$", "decimal": r"^(BIGINT|DECIMAL\(.*\))$", "text": r"^STRING$", "flag": r"^BOOLEAN$", "texts": r"^ARRAY<(STRING|VOID)>$", "object": r"^OBJECT<.*>$",
}
CASTS = {"long": "bigint", "decimal": "decimal(38,18)", "text": "string", "flag": "boolean", "texts": "array<string>"}


@dataclass(frozen=True)
class Field:
    """A field by its path (parts joined by dots), what it holds, whether it must be there, and the only value it may
    have, as text. Fields of an object are declared with the object's path before theirs; an object without any is
    free inside."""

    path: str
    kind: str
    required: bool = True
    fixed: str | None = None

    @property
    def parent(self) -> str:
        return self.path.rpartition(".")[0]

    @property
    def name(self) -> str:
        return self.path.rpartition(".")[2]


def _json_path(path: str) -> str:
    return "$" + "".join(f"['{p}']" for p in path.split(".") if p)


def _prefixed(names: Column, prefix: str) -> Column:
    return F.transform(F.sort_array(names), lambda n: F.concat(F.lit(prefix), n))


def checked(texts: DataFrame, fields: Sequence[Field], column: str = "json") -> DataFrame:
    """texts with value, the VARIANT (null if malformed), and problems, in order of the fields: malformed (no JSON object,
    a key twice, null), unknown (a key that no field has), missing, wrong (another kind, null included), inexact (a number
    with more digits than decimals hold, or with an exponent), and fixed (not the only value allowed)."""
    bad = [f for f in fields if f.kind not in SHAPES or "'" in f.path]
    if bad or len({f.path for f in fields}) < len(fields):
        raise ValueError("fields have a known kind and a path of their own")
    x = texts.withColumn("value", F.try_parse_json(F.col(column).cast("string")))
    v = F.col("value")
    whole = F.schema_of_variant(v).rlike(r"^OBJECT<.*>$")
    shape = lambda path: F.schema_of_variant(F.try_variant_get(v, _json_path(path), "variant"))
    found: list[Column] = [F.when(~F.coalesce(whole, F.lit(False)), F.array(F.lit("malformed")))]
    inside: dict[str, list[str]] = {}
    for f in fields:
        inside.setdefault(f.parent, []).append(f.name)
    for parent, names in inside.items():
        own = F.col(column) if not parent else F.get_json_object(F.col(column), _json_path(parent))
        keys = F.coalesce(F.json_object_keys(own.cast("string")), F.array().cast("array<string>"))
        more = F.array_except(keys, F.array(*(F.lit(n) for n in names)))
        found.append(_prefixed(more, f"unknown {parent + '.' if parent else ''}"))
    for f in fields:
        kind, there = shape(f.path), F.try_variant_get(v, _json_path(f.parent) if f.parent else "$", "variant").isNotNull()
        absent, wrong = kind.isNull(), ~kind.rlike(SHAPES[f.kind])
        inexact = (kind == "DOUBLE") & F.lit(f.kind == "decimal")
        told = F.when(absent, F.lit(f"missing {f.path}") if f.required else F.lit(None).cast("string")).when(inexact, f"inexact {f.path}").when(wrong, f"wrong {f.path}")
        if f.fixed is not None:
            told = F.coalesce(told, F.when(F.try_variant_get(v, _json_path(f.path), "string") != f.fixed, f"fixed {f.path}"))
        found.append(F.when(F.coalesce(whole, F.lit(False)) & there & told.isNotNull(), F.array(told)))
    none = F.array().cast("array<string>")
    return x.withColumn("problems", F.concat(*(F.coalesce(c, none) for c in found)))


def typed(texts: DataFrame, fields: Sequence[Field], column: str = "json", keep: Sequence[str] = ()) -> DataFrame:
    """keep and the fields as columns (dots become underscores; objects stay JSON text). A text with a problem fails the
    query, and names its problems."""
    x = checked(texts, fields, column)
    refused = F.raise_error(F.concat(F.lit("evidence is refused: "), F.concat_ws(", ", "problems")))
    ok = F.when(F.size("problems") > 0, refused.cast("variant")).otherwise(F.col("value"))
    x = x.withColumn("__ok", ok)
    get = lambda f: F.to_json(F.variant_get("__ok", _json_path(f.path), "variant")) if f.kind == "object" else F.variant_get("__ok", _json_path(f.path), CASTS[f.kind])
    return x.select(*keep, *(get(f).alias(f.path.replace(".", "_")) for f in fields))


def written(rows: DataFrame, fields: Sequence[Field], keep: Sequence[str] = (), column: str = "json") -> DataFrame:
    """keep and the JSON text of each row: its columns under their fields' paths. Decimals keep their digits; optional
    fields that are null are left out."""

    def build(parent: str) -> Column:
        own = []
        for f in (f for f in fields if f.parent == parent):
            inner = any(g.parent == f.path for g in fields)
            own.append((build(f.path) if inner else F.col(f.path.replace(".", "_"))).alias(f.name))
        return F.struct(*own)

    return rows.select(*keep, F.to_json(build("")).alias(column))
