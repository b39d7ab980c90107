"""Projection of canonical profiles by a config: paths, normalisation, missing values, validation.

All that depends only on the config and the schema is settled when the plan is made: a field's
path becomes a column expression, a type that can't hold the value rejects every row. Only
missing values and null elements are looked at per row. Columns the config doesn't name are
pruned from the whole plan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unifold.functions.normalize import normalize_phone, normalize_skill
from unifold.schemas import PROVENANCE

_JSON_TYPES = {"string": "string", "number": "number", "boolean": "boolean"}
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def json_type(kind: str | None) -> dict:
    """JSON schema of a config type; unknown types count as string."""
    if kind in ("string[]", "number[]"):
        return {"type": "array", "items": {"type": kind[:-2]}}
    return {"type": _JSON_TYPES.get(kind or "string", "string")}


def json_schema(config: dict, compat_schema: bool = False) -> dict:
    """Draft-07 schema of the projected profiles.

    Every field has its own type; ``compat_schema`` shares one type object between fields of the
    same scalar type, so that an optional field makes all of them nullable and a second optional
    one nests the type list, which no validator accepts.
    """
    shared = {k: json_type(k) for k in ("string", "number", "boolean")}
    properties: dict[str, dict] = {}
    required: list[str] = []
    for f in config.get("fields", []):
        path, kind = f.get("path"), f.get("type", "string")
        if not path:
            continue
        t = json_type(kind)
        if compat_schema and t["type"] != "array":
            t = shared[t["type"]]
        if f.get("required", False):
            required.append(path)
        elif t["type"] == "array":
            t = {"anyOf": [t, {"type": "null"}]}
        else:
            t["type"] = [t["type"], "null"]
        properties[path] = t
    if config.get("include_confidence", False):
        properties["overall_confidence"] = {"type": "number"}
    if config.get("include_provenance", False):
        member = {n: {"type": "string"} for n in ("field", "source", "method")}
        properties["provenance"] = {"type": "array", "items": {"type": "object", "properties": member, "required": list(member)}}
    return {"$schema": "http://json-schema.org/draft-07/schema#", "type": "object", "properties": properties, "required": required, "additionalProperties": False}


def path_column(schema: T.StructType, path: str | None) -> tuple[Column, T.DataType]:
    """Column and type of ``name``, ``name[i]`` or ``name[].member``; anything else is a null."""
    nothing = (F.lit(None).cast("string"), T.NullType())
    if not path:
        return nothing
    names = set(schema.names)
    if (m := re.fullmatch(r"(\w+)\[(\d+)\]", path)) and m.group(1) in names:
        t = schema[m.group(1)].dataType
        return (F.get(F.col(f"`{m.group(1)}`"), F.lit(int(m.group(2)))), t.elementType) if isinstance(t, T.ArrayType) else nothing
    if (m := re.fullmatch(r"(\w+)\[\]\.(\w+)", path)) and m.group(1) in names:
        t = schema[m.group(1)].dataType
        if not isinstance(t, T.ArrayType):
            return nothing
        c = F.col(f"`{m.group(1)}`")
        if not isinstance(t.elementType, T.StructType) or m.group(2) not in t.elementType.names:
            return F.when(F.size(c) > 0, F.array().cast("array<string>")), T.ArrayType(T.StringType())
        return F.when(F.size(c) > 0, F.transform(c, lambda x: x[m.group(2)])), T.ArrayType(t.elementType[m.group(2)].dataType)
    return (F.col(f"`{path}`"), schema[path].dataType) if path in names else nothing


def normalized(value: Column, kind: T.DataType, how: str | None) -> tuple[Column, T.DataType]:
    """Apply ``E164`` or ``canonical`` to a scalar or to every element; unknown names change nothing."""
    if isinstance(kind, T.NullType) or how not in ("E164", "canonical"):
        return value, kind
    fn = normalize_phone if how == "E164" else normalize_skill
    if isinstance(kind, T.ArrayType):
        each = F.transform(value, lambda x: fn(x.cast("string")))
        return (F.filter(each, lambda x: x.isNotNull()) if how == "E164" else each), T.ArrayType(T.StringType())
    return F.when(value.isNotNull(), fn(value.cast("string"))), T.StringType()


def _missing(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.NullType):
        return F.lit(True)
    if isinstance(kind, T.ArrayType):
        return value.isNull() | (F.size(value) == 0)
    return value.isNull() | (value == "") if isinstance(kind, T.StringType) else value.isNull()


def _scalar_fits(kind: T.DataType, declared: str) -> bool:
    if declared == "number":
        return isinstance(kind, _NUMBERS)
    return isinstance(kind, T.BooleanType if declared == "boolean" else T.StringType)


def _fault(value: Column, kind: T.DataType, missing: Column, field: dict, on_missing: str) -> Column:
    """Why a row's value isn't valid, or null."""
    path, declared = field["path"], json_type(field.get("type", "string"))
    gone = F.lit(None).cast("string")
    if field.get("required", False):
        gone = F.lit(f"'{path}' is required and missing" if on_missing == "error" else f"'{path}' is required")
    wrong = F.lit(f"'{path}' is not of type {field.get('type', 'string')}")
    if isinstance(kind, T.NullType):
        return gone
    if declared["type"] == "array":
        if not isinstance(kind, T.ArrayType) or not _scalar_fits(kind.elementType, declared["items"]["type"]):
            present = wrong
        else:
            present = F.when(F.exists(value, lambda x: x.isNull()), wrong)
    else:
        present = F.lit(None).cast("string") if _scalar_fits(kind, declared["type"]) else wrong
    return F.when(missing, gone).otherwise(present)


def project(profiles: DataFrame, config: dict, compat_schema: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects) of profiles under a config.

    ``valid`` has the config's fields in its order, then the metadata it asks for; missing values
    are null (a sink that omits nulls gives the "omit" policy). ``rejects`` has the profile's
    candidate_id, full_name and the reason. With ``compat_schema`` the shared type objects of
    ``json_schema`` decide: required fields may be null where an optional one has their type, and
    two optional ones of a scalar type reject everything.
    """
    on_missing = config.get("on_missing", "null")
    columns: dict[str, Column] = {}
    faults: list[Column] = []
    optional = [json_type(f.get("type", "string"))["type"] for f in config.get("fields", []) if f.get("path") and not f.get("required", False)]
    for f in config.get("fields", []):
        if not f.get("path"):
            continue
        value, kind = path_column(profiles.schema, f.get("from", f["path"]))
        value, kind = normalized(value, kind, f.get("normalize"))
        gone = _missing(value, kind)
        columns[f["path"]] = F.when(~gone, value)
        scalar = json_type(f.get("type", "string"))["type"]
        if compat_schema and scalar != "array" and scalar in optional and on_missing == "null":
            f = {**f, "required": False}
        faults.append(_fault(value, kind, gone, f, on_missing))
    if compat_schema and any(optional.count(t) > 1 for t in ("string", "number", "boolean")):
        faults.append(F.lit("the schema is invalid"))
    if config.get("include_confidence", False):
        columns["overall_confidence"] = F.coalesce("overall_confidence", F.lit(0.0)) if "overall_confidence" in profiles.columns else F.lit(0.0)
    if config.get("include_provenance", False):
        paths = [f.get("path") for f in config.get("fields", []) if f.get("path")]
        known = F.col("provenance") if "provenance" in profiles.columns else F.array().cast(PROVENANCE)
        columns["provenance"] = F.filter(F.coalesce(known, F.array().cast(PROVENANCE)), lambda p: p["field"].isin(paths))
    fault = F.coalesce(*faults) if faults else F.lit(None).cast("string")
    judged = profiles.withColumn("_fault", fault)
    valid = judged.where("_fault is null").select(*(c.alias(n) for n, c in columns.items()))
    ident = [c for c in ("candidate_id", "full_name") if c in profiles.columns]
    return valid, judged.where("_fault is not null").select(*ident, F.col("_fault").alias("reason"))
