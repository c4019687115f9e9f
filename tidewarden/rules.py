"""Detection rules: loading, validation, and compilation to column expressions.

Rule text is data: it is never evaluated as code or SQL.
"""

from __future__ import annotations

import json
import re
import warnings
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("eq", "neq", "in", "not_in", "contains", "regex", "exists", "gt", "gte", "lt", "lte")
FIELDS = ("event_id", "timestamp", "actor_id", "actor_type", "source_ip", "device_id", "action", "resource", "result", "severity", "source", "schema_version")
#: Event fields that aren't text, and so equal no JSON value.
OPAQUE = ("event_id", "timestamp")
PATH = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z0-9_-]+)*$")
RULE_ID = re.compile(r"^[a-z][a-z0-9_-]*$")


@dataclass(frozen=True)
class Condition:
    field: str
    operator: str
    value: Any = None

    def __post_init__(self) -> None:
        if not PATH.match(self.field):
            raise ValueError(f"bad field path: {self.field!r}")
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator: {self.operator!r}")
        if self.operator == "regex" and isinstance(self.value, str):
            java_regex(self.value)


@dataclass(frozen=True)
class Rule:
    rule_id: str
    version: int
    name: str
    description: str
    severity: str
    conditions: tuple[Condition, ...]
    match_mode: str = "all"
    tags: frozenset[str] = field(default_factory=frozenset)
    enabled: bool = True

    def __post_init__(self) -> None:
        if not RULE_ID.match(self.rule_id):
            raise ValueError(f"bad rule id: {self.rule_id!r}")
        if self.version < 1 or not self.conditions or self.match_mode not in ("all", "any") or self.severity not in ("low", "medium", "high", "critical"):
            raise ValueError(f"bad rule {self.rule_id}")


def _only(raw: dict, allowed: set[str], what: str) -> dict:
    if not isinstance(raw, dict) or set(raw) - allowed:
        raise ValueError(f"unknown fields in {what}: {sorted(set(raw) - allowed) if isinstance(raw, dict) else raw!r}")
    return raw


def conditions_of(raw: list) -> tuple[Condition, ...]:
    return tuple(Condition(**_only(c, {"field", "operator", "value"}, "condition")) for c in raw)


def rule_of(raw: dict) -> Rule:
    raw = _only(raw, {"rule_id", "version", "name", "description", "severity", "conditions", "match_mode", "tags", "enabled"}, "rule")
    return Rule(**{**raw, "conditions": conditions_of(raw["conditions"]), "tags": frozenset(raw.get("tags", ()))})


def load_rules(path: str | Path | None = None) -> tuple[Rule, ...]:
    """Rules of a JSON array; the default pack without a path."""
    raw = json.loads(Path(path or Path(__file__).parent / "config/rules.json").read_text(encoding="utf-8"))
    if not isinstance(raw, list):
        raise ValueError("rules must be a JSON array")
    return tuple(map(rule_of, raw))


def java_regex(pattern: str) -> str:
    """The pattern in Java's dialect; fails here if it is malformed."""
    re.compile(pattern)
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))


class Value:
    """A resolved field: its presence and typed views of it."""

    def __init__(self, present: Column, text: Column, number: Column | None = None, null: Column | None = None, variant: Column | None = None):
        self.present, self.text, self.number, self.variant = present, text, number, variant
        self.null = null if null is not None else F.lit(False)

    def json(self) -> Column:
        """The value as JSON text."""
        if self.variant is not None:
            return F.coalesce(F.to_json(self.variant), F.lit("null"))
        quoted = F.to_json(F.array(self.text))
        return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def resolve(path: str, attributes: Column) -> Value:
    first, *rest = path.split(".")
    never = F.lit(False)
    if first in FIELDS:
        if rest:
            return Value(never, F.lit(None).cast("string"))
        if first in OPAQUE:
            warnings.warn(f"{first} is no text: comparisons with it are false", stacklevel=3)
            return Value(F.lit(True), F.lit(None).cast("string"))
        return Value(F.lit(True), F.col(first), null=F.col(first).isNull())
    if first == "derived":
        warnings.warn("derived.* never resolves; use attributes.derived.*", stacklevel=3)
        return Value(never, F.lit(None).cast("string"))
    parts = rest if first == "attributes" else [first, *rest]
    if not parts:
        variant = attributes
    else:
        variant = F.try_variant_get(attributes, "$" + "".join(f"['{p}']" for p in parts), "variant")
    kind = F.schema_of_variant(variant)
    present = variant.isNotNull()
    text = F.when(kind == "STRING", F.try_variant_get(variant, "$", "string"))
    number = F.when(kind.isin("BIGINT", "DOUBLE", "BOOLEAN", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(variant, "$", "double"))
    return Value(present, text, number, F.is_variant_null(variant), variant)


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _eq(v: Value, expected: Any) -> Column:
    if expected is None:
        return v.present & _false(v.null)
    if isinstance(expected, str):
        return v.present & _false(v.text == F.lit(expected))
    if isinstance(expected, (bool, int, float)):
        return v.present & _false(v.number == F.lit(float(expected))) if v.number is not None else F.lit(False)
    if v.variant is None:
        return F.lit(False)
    return v.present & _false(F.to_json(v.variant) == F.to_json(F.parse_json(F.lit(json.dumps(expected)))))


def _member(v: Value, expected: Any) -> Column:
    if isinstance(expected, (str, int, float, bool)) or expected is None:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [_eq(v, x) for x in expected], F.lit(False))


def _contains(v: Value, expected: Any) -> Column:
    text = _false(v.text.contains(F.lit(expected))) if isinstance(expected, str) else F.lit(False)
    if v.variant is None:
        return v.present & text
    kind = F.schema_of_variant(v.variant)

    def same(x: Column) -> Column:
        k = F.schema_of_variant(x)
        number = F.when(k.isin("BIGINT", "DOUBLE", "BOOLEAN", "FLOAT") | k.startswith("DECIMAL"), F.try_variant_get(x, "$", "double"))
        return _eq(Value(F.lit(True), F.when(k == "STRING", F.try_variant_get(x, "$", "string")), number, F.is_variant_null(x), x), expected)

    elements = F.when(kind.startswith("ARRAY"), F.try_variant_get(v.variant, "$", "array<variant>"))
    key = kind.startswith("OBJECT") & F.try_variant_get(v.variant, f"$['{expected}']", "variant").isNotNull() if isinstance(expected, str) and "'" not in expected else F.lit(False)
    return v.present & (text | _false(F.exists(elements, same)) | _false(key))


def _ordered(v: Value, operator: str, expected: Any) -> Column:
    if isinstance(expected, str):
        side, other = v.text, F.lit(expected)
    elif isinstance(expected, (bool, int, float)):
        if v.number is None:
            return F.lit(False)
        side, other = v.number, F.lit(float(expected))
    else:
        return F.lit(False)
    return v.present & _false({"gt": side > other, "gte": side >= other, "lt": side < other, "lte": side <= other}[operator])


def compile_condition(c: Condition, attributes: Column | None = None) -> tuple[Column, Value]:
    """A boolean that is never null, and the resolved field."""
    v = resolve(c.field, F.col("attributes") if attributes is None else attributes)
    if c.operator == "exists":
        test = v.present if bool(c.value if c.value is not None else True) else ~v.present
    elif c.operator == "eq":
        test = _eq(v, c.value)
    elif c.operator == "neq":
        test = ~_eq(v, c.value)
    elif c.operator == "in":
        test = v.present & _member(v, c.value)
    elif c.operator == "not_in":
        scalar = isinstance(c.value, (str, int, float, bool)) or c.value is None
        test = F.lit(False) if scalar else v.present & ~_member(v, c.value)
    elif c.operator == "contains":
        test = _contains(v, c.value)
    elif c.operator == "regex":
        test = v.present & _false(v.text.rlike(java_regex(c.value))) if isinstance(c.value, str) else F.lit(False)
    else:
        test = _ordered(v, c.operator, c.value)
    return test, v


def compile_conditions(conditions: tuple[Condition, ...], match_mode: str = "all") -> tuple[Column, Column]:
    """(does it match?, evidence as JSON text with the fields that passed, sorted)."""
    compiled = [(c, *compile_condition(c)) for c in conditions]
    test = reduce((lambda a, b: a & b) if match_mode == "all" else (lambda a, b: a | b), [t for _, t, _ in compiled])
    by_field: dict[str, tuple[Column, Value]] = {}
    for c, t, v in compiled:
        by_field[c.field] = (by_field[c.field][0] | t if c.field in by_field else t, v)
    entries = [F.when(t, F.concat(F.lit(f"{json.dumps(name)}:"), F.when(v.present, v.json()).otherwise("null"))) for name, (t, v) in sorted(by_field.items())]
    return test, F.concat(F.lit("{"), F.array_join(F.filter(F.array(*entries), lambda x: x.isNotNull()), ","), F.lit("}"))
