"""Attribute maps from and to JSON.

A scalar keeps its kind: null, bool, u64 (an integer of at least 0 that fits 64 bits), f64
(every other number, negative integers included) or string.  Arrays and objects become null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import ATTRIBUTE, ATTRIBUTES

_U64_MOST = "18446744073709551615"

_SLOTS = {"b": "BOOLEAN", "u": "DECIMAL(20,0)", "f": "DOUBLE", "s": "STRING"}


def _coerce(v: str) -> str:
    """SQL of the tagged struct from SQL of a variant."""
    kind = f"schema_of_variant({v})"
    whole = f"({kind} = 'BIGINT' OR {kind} RLIKE '^DECIMAL[(][0-9]+,0[)]$')"
    number = f"try_variant_get({v}, '$', 'DECIMAL(38,0)')"

    def made(kind: str, **slots: str) -> str:
        parts = (f"'{n}', CAST({slots.get(n, 'NULL')} AS {t})" for n, t in _SLOTS.items())
        return f"named_struct('kind', '{kind}', {', '.join(parts)})"

    return f"""CASE WHEN {v} IS NULL OR {kind} = 'VOID' THEN {made("null")}
        WHEN {kind} = 'BOOLEAN' THEN {made("bool", b=f"try_variant_get({v}, '$', 'BOOLEAN')")}
        WHEN {kind} = 'STRING' THEN {made("string", s=f"try_variant_get({v}, '$', 'STRING')")}
        WHEN {whole} AND {number} BETWEEN 0 AND {_U64_MOST}BD THEN {made("u64", u=number)}
        WHEN {kind} RLIKE '^(BIGINT|DOUBLE|FLOAT|DECIMAL)' THEN {made("f64", f=f"try_variant_get({v}, '$', 'DOUBLE')")}
        ELSE {made("null")} END"""


def from_json(column: str) -> Column:
    """The attribute map of a JSON object's text; null or no object: an empty map."""
    parsed = f"try_variant_get(try_parse_json({column}), '$', 'MAP<STRING, VARIANT>')"
    return F.expr(f"CAST(coalesce(transform_values({parsed}, (k, v) -> {_coerce('v')}), map()) AS {ATTRIBUTES})")


def plain(a: str) -> str:
    """SQL of an attribute's text as JSON."""
    return f"""CASE {a}.kind WHEN 'bool' THEN CAST({a}.b AS STRING) WHEN 'u64' THEN CAST({a}.u AS STRING)
        WHEN 'f64' THEN CAST({a}.f AS STRING) WHEN 'string' THEN regexp_replace(to_json(array({a}.s)), '^\\\\[|\\\\]$', '') ELSE 'null' END"""


def to_json(column: str) -> Column:
    """A JSON object's text, keys in order."""
    entries = f"transform(array_sort(map_keys({column})), k -> concat(regexp_replace(to_json(array(k)), '^\\\\[|\\\\]$', ''), ':', {plain(f'{column}[k]')}))"
    return F.expr(f"concat('{{', array_join({entries}, ','), '}}')")


def tagged(kind: str, value: Column) -> Column:
    """One attribute of a given kind from a column."""
    slot = {"bool": "b", "u64": "u", "f64": "f", "string": "s"}.get(kind)
    slots = ((value if n == slot else F.lit(None)).cast(t).alias(n) for n, t in _SLOTS.items())
    return F.struct(F.lit(kind).alias("kind"), *slots).cast(ATTRIBUTE)


def entries(column: str) -> Column:
    """Sorted entries: maps do not compare, these do."""
    return F.array_sort(F.map_entries(column))
