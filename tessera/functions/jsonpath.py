"""JSON paths: root, properties (one or several), array indexes, wildcards and filters, over JSON text.

A path compiles to Column expressions on a VARIANT. Definite paths give one value, others an array. ``missing``
chooses between null (which also suppresses text that is not JSON) and an error for absent properties; ``as_list``
wraps a definite result, ``paths`` gives the places instead of the values, ``merged`` several properties as one object.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(r"\.(\w+)|\.\*|\[\s*\*\s*\]|\[\s*(-?\d+)\s*\]|\[\s*('[^']*'(?:\s*,\s*'[^']*')*)\s*\]|\[\?\(([^\]]*)\)\]")
_CRITERION = re.compile(r"\s*@\.(\w+)\s*(==|!=|<=|>=|<|>)\s*(?:'([^']*)'|(-?\d+(?:\.\d+)?)|(true|false))\s*$")


@dataclass(frozen=True)
class Step:
    kind: str  # property, index, wildcard, filter
    value: object = None


def parse(path: str) -> list[Step]:
    if not path.startswith("$"):
        raise ValueError(f"a path starts with $: {path}")
    at, steps = 1, []
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"cannot read {path[at:]!r} in {path!r}")
        if m[1]:
            steps.append(Step("property", (m[1],)))
        elif m[2]:
            steps.append(Step("index", int(m[2])))
        elif m[3]:
            steps.append(Step("property", tuple(re.findall(r"'([^']*)'", m[3]))))
        elif m[4] is not None:
            steps.append(Step("filter", _criteria(m[4])))
        else:
            steps.append(Step("wildcard"))
        at = m.end()
    return steps


def _criteria(text: str) -> list[list[tuple]]:
    """An OR of ANDs of (property, operator, value)."""
    out = []
    for either in text.split("||"):
        every = []
        for part in either.split("&&"):
            m = _CRITERION.match(part)
            if not m:
                raise ValueError(f"cannot read the criterion {part!r}")
            every.append((m[1], m[2], m[3] if m[3] is not None else float(m[4]) if m[4] else m[5] == "true"))
        out.append(every)
    return out


def is_definite(steps: list[Step]) -> bool:
    return not any(s.kind in ("wildcard", "filter") or s.kind == "property" and len(s.value) > 1 for s in steps)


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _accepts(v: Column, criteria: list[list[tuple]]) -> Column:
    result = F.lit(False)
    for every in criteria:
        all_ = F.lit(True)
        for name, op, value in every:
            kind = "string" if isinstance(value, str) else "boolean" if isinstance(value, bool) else "double"
            x = _get(v, f"$['{name}']", kind)
            all_ = all_ & F.coalesce({"==": x == value, "!=": x != value, "<": x < value, "<=": x <= value, ">": x > value, ">=": x >= value}[op], F.lit(False))
        result = result | all_
    return result


def _step(s: Step, v: Column) -> Column:
    if s.kind == "property":
        found = [_get(v, f"$['{k}']", "variant") for k in s.value]
        return found[0] if len(found) == 1 else F.filter(F.array(*found), lambda x: x.isNotNull())
    if s.kind == "index":
        return _get(v, f"$[{s.value}]", "variant") if s.value >= 0 else F.try_element_at(_get(v, "$", "array<variant>"), F.lit(s.value))
    none = F.array().cast("array<variant>")
    if s.kind == "wildcard":
        return F.coalesce(_get(v, "$", "array<variant>"), F.map_values(_get(v, "$", "map<string, variant>")), none)
    return F.filter(F.coalesce(_get(v, "$", "array<variant>"), none), lambda x: _accepts(x, s.value))


def _unary(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A function of one argument, as transform() needs (it counts parameters)."""
    return lambda v: f(v)


def evaluate(json: Column, path: str, kind: str = "string", missing: str = "null", as_list: bool = False) -> Column:
    """The value (of SQL type ``kind``) or, of an indefinite path, the array of values at ``path`` in JSON text."""
    steps = parse(path)
    current, many = F.try_parse_json(json), False
    for s in steps:
        one = partial(_step, s)
        spreads = s.kind in ("wildcard", "filter") or s.kind == "property" and len(s.value) > 1
        if many:
            current = F.transform(current, _unary(one))
            current = F.flatten(current) if spreads else F.filter(current, lambda x: x.isNotNull())
        else:
            current = one(current)
        many = many or spreads
    out = F.transform(current, lambda v: _get(v, "$", kind)) if many else _get(current, "$", kind)
    if missing == "error" and not many:
        out = F.when(out.isNull() & json.isNotNull(), F.raise_error(F.concat(F.lit(f"no value at {path} in "), json)).cast(kind)).otherwise(out)
    return F.array(out) if as_list and not many else out


def merged(json: Column, path: str) -> Column:
    """A path that ends in several properties, as one object (JSON text) of those present instead of a list."""
    steps = parse(path)
    if not is_definite(steps[:-1]) or steps[-1].kind != "property":
        raise ValueError(f"{path} does not end in properties of one object")
    v = F.try_parse_json(json)
    for s in steps[:-1]:
        v = _step(s, v)
    entries = F.array(*(F.struct(F.lit(k).alias("key"), _get(v, f"$['{k}']", "variant").alias("value")) for k in steps[-1].value))
    return F.to_json(F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())))


def paths(json: Column, path: str) -> Column:
    """The normalized paths of all values at ``path`` (as-path-list), in order; none for text that is not JSON."""
    at = F.struct(F.lit("$").alias("p"), F.try_parse_json(json).alias("v"))
    found = F.array(at)
    for s in parse(path):
        found = F.flatten(F.transform(found, _unary(partial(_spread, s))))
    return F.coalesce(F.transform(F.filter(found, lambda x: x["v"].isNotNull()), lambda x: x["p"]), F.array().cast("array<string>"))


def _spread(s: Step, x: Column) -> Column:
    """The (path, value) pairs that a step makes of one."""
    p, v = x["p"], x["v"]
    of_items = lambda: F.transform(_get(v, "$", "array<variant>"), lambda e, i: F.struct(F.concat(p, F.lit("["), i.cast("string"), F.lit("]")).alias("p"), e.alias("v")))
    none = F.array().cast("array<struct<p:string,v:variant>>")
    if s.kind == "property":
        return F.array(*(F.struct(F.concat(p, F.lit(f"['{k}']")).alias("p"), _get(v, f"$['{k}']", "variant").alias("v")) for k in s.value))
    if s.kind == "index":
        at = F.lit(s.value) if s.value >= 0 else F.size(_get(v, "$", "array<variant>")) + s.value
        return F.array(F.struct(F.concat(p, F.lit("["), at.cast("string"), F.lit("]")).alias("p"), _step(s, v).alias("v")))
    if s.kind == "wildcard":
        members = F.transform(F.map_entries(_get(v, "$", "map<string, variant>")), lambda e: F.struct(F.concat(p, F.lit("['"), e["key"], F.lit("']")).alias("p"), e["value"].alias("v")))
        return F.coalesce(of_items(), members, none)
    return F.coalesce(F.filter(of_items(), lambda e: _accepts(e["v"], s.value)), none)


def keys(json: Column) -> Column:
    return F.json_object_keys(json)


def array_length(json: Column) -> Column:
    return F.json_array_length(json)


def write_json(value: Column) -> Column:
    return F.to_json(value)
