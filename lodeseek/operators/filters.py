"""Metadata predicates in document-store notation, compiled to Spark columns.

Two modes: typed columns (pass the schema of a struct or frame) and VARIANT metadata (one column with
whatever JSON each document has). A missing field fails every test but $ne, $nin and {"$exists": false}.

VARIANT predicates are never null. Typed ones are for WHERE: a comparison in positive position is left bare, so that it reaches the scan, and may be
null, which a WHERE takes as false; only below a negation ($ne, $nin, $nor) nulls are turned into false.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F, types as T

ORDER = ("$gt", "$gte", "$lt", "$lte")
OPS = ("$eq", "$ne", *ORDER, "$in", "$nin", "$exists")
COMBINE = ("$and", "$or", "$nor")
#: Numeric type names as schema_of_variant prints them.
NUMERIC = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def parse(spec: object) -> tuple:
    """Check a predicate and turn it into (op, ...) tuples. Raises ValueError before any job runs."""
    if not isinstance(spec, dict):
        raise ValueError("a filter must be an object")
    parts: list[tuple] = []
    for key, value in spec.items():
        if key in COMBINE:
            if not isinstance(value, list) or not value:
                raise ValueError(f"{key} needs a non-empty array of filters")
            parts.append((key, [parse(x) for x in value]))
        elif key.startswith("$"):
            raise ValueError(f"unsupported top-level operator {key}")
        else:
            parts.append(("field", key, _conditions(key, value)))
    return ("$and", parts)


def _conditions(key: str, value: object) -> list[tuple[str, object]]:
    if not isinstance(value, dict):
        return [("$eq", value)]
    if not value:
        raise ValueError(f"{key}: an empty object is no condition")
    for op, target in value.items():
        if not op.startswith("$"):
            raise ValueError(f"{key}: a condition may not hold plain keys ({op})")
        if op not in OPS:
            raise ValueError(f"{key}: unknown operator {op}")
        if op in ("$in", "$nin") and not isinstance(target, list):
            raise ValueError(f"{key}: {op} needs an array")
        if op == "$exists" and not isinstance(target, bool):
            raise ValueError(f"{key}: $exists needs true or false")
    return list(value.items())


def _build(node: tuple, field: Callable[[str, list, bool], Column], bare: bool) -> Column:
    """bare: whether a null may stand for false here."""
    if node[0] == "field":
        return field(node[1], node[2], bare)
    parts = [_build(x, field, bare and node[0] != "$nor") for x in node[1]]
    if not parts:
        return F.lit(True)
    if node[0] == "$and":
        return reduce(lambda a, b: a & b, parts)
    some = reduce(lambda a, b: a | b, parts)
    return some if node[0] == "$or" else ~some


def _is_number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _never_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _order(op: str, a: Column, b: Column) -> Column:
    return {"$gt": a > b, "$gte": a >= b, "$lt": a < b, "$lte": a <= b}[op]


# typed columns


def _literal(kind: T.DataType, target: object) -> Column | None:
    """The target as a literal of the column's own type, None where no value of that type equals it: a cast of the column would keep the comparison
    from the scan."""
    if isinstance(kind, T.BooleanType):
        return F.lit(target) if isinstance(target, bool) else None
    if isinstance(kind, T.StringType):
        return F.lit(target) if isinstance(target, str) else None
    if not isinstance(kind, T.NumericType) or not _is_number(target):
        return None
    if isinstance(kind, T.IntegralType):
        bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31}.get(type(kind), 63)
        whole = target == math.floor(target) if math.isfinite(target) else False
        return F.lit(int(target)).cast(kind) if whole and -(1 << bits) <= target < 1 << bits else None
    return F.lit(float(target)) if isinstance(kind, T.DoubleType) else F.lit(target)


def _typed_eq(c: Column, kind: T.DataType, targets: list) -> Column:
    """Whether the column, or an element of an array column, equals one of the targets; null if it is missing."""
    if isinstance(kind, T.ArrayType):
        return F.exists(c, lambda x: _never_null(_typed_eq(x, kind.elementType, targets)))
    held = [x for t in targets if (x := _literal(kind, t)) is not None]
    if not held:
        return F.lit(False)
    return c == held[0] if len(held) == 1 else c.isin(*held)


def _typed_op(c: Column, kind: T.DataType, op: str, target: object, bare: bool) -> Column:
    shown = (lambda x: x) if bare else _never_null
    if op in ("$eq", "$in"):
        return shown(_typed_eq(c, kind, target if op == "$in" else [target]))
    if op in ("$ne", "$nin"):
        return ~_never_null(_typed_eq(c, kind, target if op == "$nin" else [target]))
    if op == "$exists":
        return c.isNotNull() if target else c.isNull()
    if isinstance(kind, T.StringType) and isinstance(target, str):
        return shown(_order(op, c, F.lit(target)))
    if not isinstance(kind, T.NumericType) or not _is_number(target):
        return F.lit(False)
    if isinstance(kind, T.IntegralType) and not isinstance(target, int):
        if not math.isfinite(target):
            above = target > 0
            return c.isNotNull() if above == (op in ("$lt", "$lte")) and not math.isnan(target) else F.lit(False)
        # x > 2.5 and x >= 2.5 mean x >= 3 in whole numbers
        target, op = {"$gt": (math.floor(target), op), "$gte": (math.ceil(target), op), "$lt": (math.ceil(target), op), "$lte": (math.floor(target), op)}[op]
    literal = _literal(kind, target)
    return shown(_order(op, c, F.lit(target) if literal is None else literal))


def compile_typed(spec: dict, schema: T.StructType, prefix: str | None = None) -> Column:
    """A column for WHERE over data with a declared schema; SQL NULL counts as a missing field. Comparisons in positive position reach the scan."""
    kinds = {f.name: f.dataType for f in schema.fields}

    def field(key: str, conditions: list, bare: bool) -> Column:
        if key not in kinds:
            return _build_missing(conditions)
        c = F.col(f"{prefix}.`{key}`" if prefix else f"`{key}`")
        return reduce(lambda a, b: a & b, [_typed_op(c, kinds[key], op, target, bare) for op, target in conditions])

    return _build(parse(spec), field, True)


def _build_missing(conditions: list) -> Column:
    return F.lit(all(op in ("$ne", "$nin") or op == "$exists" and not target for op, target in conditions))


# VARIANT metadata


def _path(key: str) -> str:
    if '"' in key and "'" in key:
        raise ValueError("a field name may not hold both kinds of quotes")
    return f"$['{key}']" if '"' in key else f'$["{key}"]'


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _canonical(target: object) -> str:
    return json.dumps(target, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _variant_eq_one(v: Column, target: object) -> Column:
    if target is None:
        return _never_null(F.is_variant_null(v))
    if isinstance(target, bool):
        return _never_null((_kind(v) == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(target)))
    if _is_number(target):
        return _never_null(_kind(v).rlike(NUMERIC) & (F.try_variant_get(v, "$", "double") == F.lit(float(target))))
    if isinstance(target, str):
        return _never_null((_kind(v) == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(target)))
    start = "ARRAY" if isinstance(target, list) else "OBJECT"
    return _never_null(_kind(v).startswith(start) & (F.to_json(v) == F.lit(_canonical(target))))


def _variant_eq(v: Column, target: object) -> Column:
    in_array = _kind(v).startswith("ARRAY") & F.exists(F.try_variant_get(v, "$", "array<variant>"), lambda x: _variant_eq_one(x, target))
    # an array field equals a target through its elements only
    whole = F.lit(False) if isinstance(target, list) else _variant_eq_one(v, target)
    return whole | _never_null(in_array)


def _variant_op(v: Column, op: str, target: object) -> Column:
    if op == "$eq":
        return _variant_eq(v, target)
    if op == "$ne":
        return ~_variant_eq(v, target)
    if op in ("$in", "$nin"):
        some = reduce(lambda a, b: a | b, [_variant_eq(v, x) for x in target], F.lit(False))
        return some if op == "$in" else ~some
    if op == "$exists":
        return v.isNotNull() if target else v.isNull()
    if _is_number(target):
        return _never_null(_kind(v).rlike(NUMERIC) & _order(op, F.try_variant_get(v, "$", "double"), F.lit(float(target))))
    if isinstance(target, str):
        return _never_null((_kind(v) == "STRING") & _order(op, F.try_variant_get(v, "$", "string"), F.lit(target)))
    return F.lit(False)


def compile_variant(spec: dict, metadata: Column) -> Column:
    """A column for VARIANT metadata. Metadata that is null or no object has no fields."""

    def field(key: str, conditions: list, bare: bool) -> Column:
        v = F.try_variant_get(metadata, _path(key), "variant")
        return reduce(lambda a, b: a & b, [_variant_op(v, op, target) for op, target in conditions])

    return _build(parse(spec), field, False)


def compile_json(spec: dict, text: Column) -> Column:
    """The same for JSON text; broken JSON counts as null."""
    return compile_variant(spec, F.try_parse_json(text))


# plain Python, for single records and as the tests' yardstick


def matches(spec: dict, record: object) -> bool:
    def equal(a: object, b: object) -> bool:
        if _is_number(a) and _is_number(b):
            return float(a) == float(b)
        return type(a) is type(b) and a == b

    def test(value: object, found: bool, op: str, target: object) -> bool:
        if op == "$exists":
            return found == target
        if op in ("$ne", "$nin"):
            return not test(value, found, "$eq" if op == "$ne" else "$in", target)
        if not found:
            return False
        if op == "$in":
            return any(test(value, found, "$eq", x) for x in target)
        if op == "$eq":
            return any(equal(x, target) for x in value) if isinstance(value, list) else equal(value, target)
        if _is_number(value) and _is_number(target) or isinstance(value, str) and isinstance(target, str):
            a, b = (value.encode(), target.encode()) if isinstance(value, str) else (float(value), float(target))
            return {"$gt": a > b, "$gte": a >= b, "$lt": a < b, "$lte": a <= b}[op]
        return False

    def walk(node: tuple) -> bool:
        if node[0] == "field":
            found = isinstance(record, dict) and node[1] in record
            value = record[node[1]] if found else None
            return all(test(value, found, op, target) for op, target in node[2])
        inner = [walk(x) for x in node[1]]
        return all(inner) if node[0] == "$and" else any(inner) if node[0] == "$or" else not any(inner)

    return walk(parse(spec))


def check_metadata(value: object) -> None:
    """Raise ValueError for what JSON metadata cannot hold: NaN, infinities, keys that are no strings, other types."""
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("metadata may not hold NaN or infinities")
    elif isinstance(value, dict):
        for k, x in value.items():
            if not isinstance(k, str):
                raise ValueError("metadata keys must be strings")
            check_metadata(x)
    elif isinstance(value, (list, tuple)):
        for x in value:
            check_metadata(x)
    elif not (value is None or isinstance(value, (bool, str, int))):
        raise ValueError(f"metadata may not hold {type(value).__name__}")
