"""Document-style filters (``{"price": {"$gt": 10}, "$or": [...]}``) as Columns, with two-valued logic: a test of a missing
field is false, and its negation true.

A filter is compiled against typed columns or against a column of JSON text, which is read as a variant. Numbers compare by value
(10 equals 10.0)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH, LENGTH = 32, 1000


class FilterError(ValueError):
    """A filter that can't be read."""


class Typed:
    """Fields that are columns; dotted paths go into structs, and numbers into arrays."""

    def __init__(self, types: Mapping[str, str]):
        self.types = dict(types)

    def value(self, path: str) -> Column:
        head, *rest = path.split(".")
        column = F.col(f"`{head}`")
        for part in rest:
            column = F.get(column, F.lit(int(part))) if part.isdigit() else column.getField(part)
        return column

    def text(self, path: str) -> Column:
        return self.value(path).cast("string")

    def number(self, path: str) -> Column:
        return self.value(path).cast("double") if self._name(path) == "number" else F.lit(None).cast("double")

    def _name(self, path: str) -> str:
        t = self.types.get(path, "string")
        return "array" if t.startswith("array") else "object" if t.startswith(("struct", "map")) else "boolean" if t == "boolean" else "string" if t in ("string", "timestamp", "timestamp_ntz", "date", "binary") else "number"

    def kind(self, path: str) -> Column:
        return F.when(self.value(path).isNull(), F.lit("null")).otherwise(F.lit(self._name(path)))

    def exists(self, path: str) -> Column:
        return self.value(path).isNotNull()

    def items(self, path: str) -> Column:
        return F.transform(self.value(path), lambda x: x.cast("string"))

    def size(self, path: str) -> Column:
        return F.size(self.value(path))


class Json:
    """Fields of a column of JSON text. A text that is no JSON has no fields."""

    def __init__(self, column: str):
        self.column = F.try_parse_json(F.col(column))

    def _path(self, path: str) -> str:
        return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" if re.fullmatch(r"\w+", p) else f"['{p}']" for p in path.split("."))

    def value(self, path: str) -> Column:
        return F.try_variant_get(self.column, self._path(path), "variant")

    def text(self, path: str) -> Column:
        return F.try_variant_get(self.column, self._path(path), "string")

    def number(self, path: str) -> Column:
        return F.when(self.kind(path) == "number", F.try_variant_get(self.column, self._path(path), "double"))

    def kind(self, path: str) -> Column:
        t = F.schema_of_variant(self.value(path))
        return (
            F.when(self.value(path).isNull(), F.lit(None))
            .when(t == "VOID", "null")
            .when(t == "STRING", "string")
            .when(t == "BOOLEAN", "boolean")
            .when(t.startswith("ARRAY"), "array")
            .when(t.startswith("OBJECT"), "object")
            .otherwise("number")
        )

    def exists(self, path: str) -> Column:
        return self.value(path).isNotNull()

    def items(self, path: str) -> Column:
        return F.try_variant_get(self.column, self._path(path), "array<string>")

    def size(self, path: str) -> Column:
        return F.size(F.try_variant_get(self.column, self._path(path), "array<variant>"))


def compile_filter(spec: Mapping[str, Any] | str, fields: Typed | Json) -> Column:
    """The filter as a boolean Column that is never null. Siblings of ``$and``, ``$or`` and ``$not`` hold too."""
    spec = json.loads(spec) if isinstance(spec, str) else spec
    return _object(spec, fields, 0)


def _object(spec: Any, fields: Typed | Json, depth: int) -> Column:
    if not isinstance(spec, Mapping):
        raise FilterError("a filter is an object")
    if not spec:
        raise FilterError("an empty filter")
    if depth > DEPTH:
        raise FilterError(f"more than {DEPTH} levels")
    parts = []
    for key, value in spec.items():
        if key in ("$and", "$or"):
            if not isinstance(value, list) or len(value) > LENGTH:
                raise FilterError(f"{key} takes a list of at most {LENGTH}")
            each = [_object(v, fields, depth + 1) for v in value]
            parts.append(reduce(lambda a, b: a & b, each, F.lit(True)) if key == "$and" else reduce(lambda a, b: a | b, each, F.lit(False)))
        elif key == "$not":
            parts.append(~_object(value, fields, depth + 1))
        elif key.startswith("$"):
            raise FilterError(f"unknown operator {key}")
        elif isinstance(value, Mapping):
            if not value:
                raise FilterError(f"no test of {key}")
            parts += [_leaf(key, op, v, fields, depth) for op, v in value.items()]
        else:
            parts.append(_leaf(key, "$eq", value, fields, depth))
    return reduce(lambda a, b: a & b, parts)


def _equal(path: str, value: Any, fields: Typed | Json) -> Column:
    if value is None:
        return fields.kind(path) == "null"
    if isinstance(value, bool):
        return (fields.kind(path) == "boolean") & (fields.text(path) == str(value).lower())
    if isinstance(value, (int, float)):
        return (fields.kind(path) == "number") & (fields.number(path) == float(value))
    if isinstance(value, str):
        return (fields.kind(path) == "string") & (fields.text(path) == value)
    return (fields.kind(path) == ("array" if isinstance(value, list) else "object")) & (fields.text(path) == json.dumps(value, separators=(",", ":")))


def _any_of(path: str, values: list, fields: Typed | Json) -> Column:
    """Whether the field equals one of the values; numbers and texts are tested as one set each."""
    numbers = [float(v) for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
    texts = [v for v in values if isinstance(v, str)]
    tests = [_equal(path, v, fields) for v in values if v is None or not isinstance(v, (int, float, str)) or isinstance(v, bool)]
    if numbers:
        tests.append((fields.kind(path) == "number") & fields.number(path).isin(numbers))
    if texts:
        tests.append((fields.kind(path) == "string") & fields.text(path).isin(texts))
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False))


def _number(value: Any, op: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise FilterError(f"{op} takes a number")
    return float(value)


def _list(value: Any, op: str) -> list:
    if not isinstance(value, list) or len(value) > LENGTH:
        raise FilterError(f"{op} takes a list of at most {LENGTH}")
    return value


def mini_regex(pattern: str) -> str:
    """The filter's small regex dialect as a full pattern: it covers the whole text unless ``.*`` stands at an end, and only ``.`` is special."""
    pattern = pattern.removeprefix("^").removesuffix("$") if pattern.startswith("^") or pattern.endswith("$") else pattern
    head, tail = pattern.startswith(".*"), pattern.endswith(".*") and len(pattern) > 2
    inner = pattern[2 if head else 0 : -2 if tail else None]
    return "(?s)^" + (".*" if head else "") + "".join("." if c == "." else re.escape(c) for c in inner) + (".*" if tail else "") + "$"


def _leaf(path: str, op: str, value: Any, fields: Typed | Json, depth: int) -> Column:
    there = fields.exists(path)
    if op == "$eq":
        test = _equal(path, value, fields)
    elif op == "$ne":
        test = there & ~F.coalesce(_equal(path, value, fields), F.lit(False))
    elif op in ("$gt", "$gte", "$lt", "$lte"):
        number, other = fields.number(path), _number(value, op)
        test = {"$gt": number > other, "$gte": number >= other, "$lt": number < other, "$lte": number <= other}[op]
    elif op == "$between":
        low, high = _list(value, op)
        test = fields.number(path).between(_number(low, op), _number(high, op))
    elif op in ("$in", "$nin"):
        any_of = _any_of(path, _list(value, op), fields)
        test = any_of if op == "$in" else there & ~any_of
    elif op == "$contains":
        wanted = value if isinstance(value, str) else json.dumps(value)
        text = fields.text(path)
        if isinstance(fields, Typed) and not fields.types.get(path, "string").startswith("array"):
            test = F.contains(text, F.lit(wanted))
        elif isinstance(fields, Typed):
            test = F.array_contains(fields.items(path), wanted)
        else:
            test = F.when(fields.kind(path) == "array", F.array_contains(fields.items(path), wanted)).when(fields.kind(path) == "string", F.contains(text, F.lit(wanted)))
    elif op == "$startsWith":
        test = (fields.kind(path) == "string") & F.startswith(fields.text(path), F.lit(str(value)))
    elif op == "$endsWith":
        test = (fields.kind(path) == "string") & F.endswith(fields.text(path), F.lit(str(value)))
    elif op == "$exists":
        test = there if value else ~there
    elif op == "$regex":
        test = (fields.kind(path) == "string") & F.rlike(fields.text(path), F.lit(mini_regex(str(value))))
    elif op == "$all":
        have = fields.items(path)
        test = reduce(lambda a, b: a & b, [F.array_contains(have, v if isinstance(v, str) else json.dumps(v)) for v in _list(value, op)], fields.kind(path) == "array")
    elif op == "$elemMatch":
        test = F.exists(fields.items(path), lambda x: _element(x, value))
    elif op == "$size":
        n = int(_number(value, op))
        test = F.when(fields.kind(path) == "string", F.octet_length(fields.text(path)) == n)
        if isinstance(fields, Json) or fields.types.get(path, "").startswith("array"):
            test = F.when(fields.kind(path) == "array", fields.size(path) == n).otherwise(test)
    elif op == "$type":
        test = fields.kind(path) == str(value)
    elif op == "$not":
        return ~_object({path: value}, fields, depth + 1)
    else:
        raise FilterError(f"unknown operator {op}")
    return F.coalesce(test, F.lit(False))


def _element(x: Column, spec: Any) -> Column:
    tests: dict[str, Callable[[Column, Any], Column]] = {
        "$eq": lambda c, v: c == (v if isinstance(v, str) else json.dumps(v)),
        "$ne": lambda c, v: c != (v if isinstance(v, str) else json.dumps(v)),
        "$gt": lambda c, v: c.try_cast("double") > v,
        "$gte": lambda c, v: c.try_cast("double") >= v,
        "$lt": lambda c, v: c.try_cast("double") < v,
        "$lte": lambda c, v: c.try_cast("double") <= v,
        "$in": lambda c, v: c.isin([y if isinstance(y, str) else json.dumps(y) for y in v]),
        "$startsWith": lambda c, v: F.startswith(c, F.lit(v)),
        "$endsWith": lambda c, v: F.endswith(c, F.lit(v)),
        "$contains": lambda c, v: F.contains(c, F.lit(v)),
    }
    spec = spec if isinstance(spec, Mapping) else {"$eq": spec}
    unknown = set(spec) - set(tests)
    if unknown:
        raise FilterError(f"unknown operator {sorted(unknown)[0]} within $elemMatch")
    return F.coalesce(reduce(lambda a, b: a & b, [tests[op](x, v) for op, v in spec.items()]), F.lit(False))


# ---- filters in words ---------------------------------------------------------------------------------------------

# Phrases for comparisons.
_PHRASES = [
    ("$gte", r"(?:at least|no less than|minimum(?: of)?|>=)"),
    ("$lte", r"(?:at most|no more than|maximum(?: of)?|up to|<=)"),
    ("$gt", r"(?:greater than|more than|over|above|exceeding|>)"),
    ("$lt", r"(?:less than|fewer than|under|below|<)"),
    ("$ne", r"(?:is not|not equal to|other than|!=)"),
    ("$eq", r"(?:equals|equal to|is|of|=)"),
]


def filter_of_words(text: str, fields: Mapping[str, str]) -> dict[str, Any]:
    """A filter from a sentence such as "price over 10 and status is open"; ``fields`` maps the known fields to ``number`` or ``string``.

    Parts joined by "and" hold together, by "or" alternatively. What names no known field is passed over; nothing found is an error."""
    def one(part: str) -> dict | None:
        for name, kind in fields.items():
            words = re.escape(name).replace("_", "[_ ]")
            between = re.search(rf"\b{words}\b.*?\bbetween\s+(-?[\d.]+)\s+(?:and|to)\s+(-?[\d.]+)", part, re.I)
            if between and kind == "number":
                return {name: {"$between": [float(between[1]), float(between[2])]}}
            for op, phrase in _PHRASES:
                value = r"(-?\d+(?:\.\d+)?)" if kind == "number" else r"[\"']?([\w-]+)[\"']?"
                m = re.search(rf"\b{words}\b\s*(?:is\s+)?{phrase}\s*{value}", part, re.I)
                if m:
                    return {name: {op: float(m[1]) if kind == "number" else m[1]}}
        return None

    kept = re.sub(r"(between\s+-?[\d.]+)\s+and\s+", r"\1 to ", text, flags=re.I)
    ors = []
    for side in re.split(r"\s+or\s+", kept, flags=re.I):
        ands = [f for f in (one(p) for p in re.split(r"\s+and\s+|,", side, flags=re.I)) if f]
        if ands:
            ors.append(ands[0] if len(ands) == 1 else {"$and": ands})
    if not ors:
        raise FilterError("no known field is tested")
    return ors[0] if len(ors) == 1 else {"$or": ors}
