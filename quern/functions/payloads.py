"""JSON payloads of unknown shape: tolerant parsing, stamped keys, typed extraction.

Payloads are parsed to VARIANT, so numbers, nested objects and arrays pass as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OBJECT = "map<string, variant>"


def parsed(payload: Column) -> Column:
    """VARIANT of a payload; null where it is null or no JSON."""
    return F.try_parse_json(payload)


def extracted(payload: Column, path: str, kind: str) -> Column:
    """The value at a path like ``$.a.b[0]`` as a type; null where there is none, or none of that type."""
    return F.try_variant_get(parsed(payload), path, kind)


def _object(payload: Column) -> Column:
    """Members of a payload that is a JSON object, else null."""
    return F.when(F.schema_of_variant(parsed(payload)).startswith("OBJECT"), F.from_json(payload, OBJECT))


def stamped(payload: Column, wrap: str | None = None, **keys: Column) -> Column:
    """The payload with these keys set, as JSON with its keys in order; keys that are null for a row
    are left out.

    A payload that looks like an object but doesn't parse, and one that is no object, stays as
    it is; the latter, where ``wrap`` is given, becomes that key of a new object. Null stays
    null. Members of one name: the last one counts."""
    new = F.from_json(F.to_json(F.struct(*[v.alias(k) for k, v in keys.items()])), OBJECT)
    old = F.map_filter(_object(payload), lambda k, _: ~F.array_contains(F.map_keys(new), k))
    both = F.map_concat(old, new)
    text = F.to_json(F.map_from_entries(F.transform(F.array_sort(F.map_keys(both)), lambda k: F.struct(k, F.element_at(both, k)))))
    out = F.when(_object(payload).isNotNull(), text)
    if wrap:
        braces = payload.startswith("{") & payload.endswith("}")
        out = out.when(~braces, F.to_json(F.struct(payload.alias(wrap), *[v.alias(k) for k, v in keys.items()])))
    return out.otherwise(payload)
