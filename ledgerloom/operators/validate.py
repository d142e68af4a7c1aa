"""Validation of records by their document type: known type, required party blocks, required names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..sinks import layouts as L

#: Money texts of these fields are normal in every type; other types' fields stay as they are.
FINANCIAL = [k for fam, ks in T.FAMILIES.items() if fam != "tax" for k in ks]


def required(kind: str) -> list[str]:
    """Paths that a record of the type must hold: both parties of a tax form, the entity's name of a statement."""
    for f in L.forms():
        if f[0] == kind:
            return [f[1], f[2]]
    return ["entity.name"] if kind in FINANCIAL else []


def known_types() -> list[str]:
    return [f[0] for f in L.forms()] + FINANCIAL


def problems_of(record: object, kind: str | None) -> list[str]:
    """``validated`` for one parsed record, without its type's own problem."""
    if not isinstance(record, dict):
        return ["no record"]
    out = []
    for path in required(kind or ""):
        if path == "entity.name":
            entity = record.get("entity")
            name = entity.get("name") if isinstance(entity, dict) else None
            if name is None or name == "" or isinstance(name, (dict, list)):
                out.append(f"missing {path}")
        elif not isinstance(record.get(path), dict):
            out.append(f"missing {path}")
    return out


def validated(records: DataFrame, data_col: str = "data") -> DataFrame:
    """Adds ``problems``: array of ``unknown type``, ``no record``, ``missing PATH``; empty for a valid record.

    Parties must be objects; a statement's entity must have a name that isn't empty.
    """
    v = F.try_parse_json(F.regexp_extract(data_col, r"(?s)\{.*\}", 0))
    d = records.withColumn("_v", v)
    at = lambda p, kind: F.try_variant_get("_v", f"$.{p}", kind)
    broken = F.coalesce(~F.schema_of_variant("_v").startswith("OBJECT"), F.lit(True))
    checks: list[Column] = [F.when(~F.col("document_type").isin(*known_types()) | F.col("document_type").isNull(), F.lit("unknown type")), F.when(broken, F.lit("no record"))]
    for kind in known_types():
        for path in required(kind):
            absent = F.coalesce(at(path, "string"), F.lit("")) == "" if path == "entity.name" else F.coalesce(~F.schema_of_variant(at(path, "variant")).startswith("OBJECT"), F.lit(True))
            checks.append(F.when((F.col("document_type") == kind) & ~broken & absent, F.lit(f"missing {path}")))
    return d.withColumn("problems", F.array_compact(F.array(*checks))).drop("_v")
