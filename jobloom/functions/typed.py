"""Journal values that JSON alone can't tell apart: dates and the absence of a result.

They are stored as JSON text in which an object with one key that begins with '$' says what it
stands for; a value's own object of that shape is wrapped, so nothing is ambiguous. In Spark
the text becomes a VARIANT.
"""

from __future__ import annotations

import datetime as dt
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE, VOID_KEY, PLAIN = "$date", "$void", "$plain"
#: Integers beyond this aren't exact as JSON numbers.
SAFE_INTEGER = 2**53 - 1


class _Void:
    """The result of a step that has none, unlike null."""

    def __repr__(self) -> str:
        return "VOID"

    def __reduce__(self) -> str:
        return "VOID"


VOID = _Void()


class NotStorable(TypeError):
    """A value that the journal can't hold, with the place of it."""


def _stored(value: object, path: str, above: tuple[int, ...]) -> object:
    if value is None or isinstance(value, str | bool):
        return value
    if isinstance(value, int):
        if abs(value) > SAFE_INTEGER:
            raise NotStorable(f"{path}: {value} isn't exact as a number")
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise NotStorable(f"{path}: {value}")
        return value
    if isinstance(value, dt.datetime):
        utc = value.replace(tzinfo=dt.UTC) if value.tzinfo is None else value.astimezone(dt.UTC)
        return {DATE: utc.isoformat(timespec="microseconds").replace("+00:00", "Z")}
    if id(value) in above:
        raise NotStorable(f"{path}: holds itself")
    if isinstance(value, list):
        return [_stored(x, f"{path}[{i}]", (*above, id(value))) for i, x in enumerate(value)]
    if type(value) is dict:
        for k in value:
            if not isinstance(k, str):
                raise NotStorable(f"{path}: key {k!r}")
        made = {k: _stored(x, f"{path}.{k}", (*above, id(value))) for k, x in value.items()}
        return {PLAIN: made} if len(made) == 1 and next(iter(made)).startswith("$") else made
    raise NotStorable(f"{path}: {type(value).__name__}")


def encoded(value: object, path: str = "result") -> str:
    """A value as text: null, booleans, numbers, strings, datetimes (naive ones are UTC), lists, dicts with string keys, or VOID by itself."""
    return json.dumps({VOID_KEY: True} if value is VOID else _stored(value, path, ()))


def _value(stored: object) -> object:
    if isinstance(stored, list):
        return [_value(x) for x in stored]
    if isinstance(stored, dict):
        if len(stored) == 1:
            (k, x), = stored.items()
            if k == DATE:
                return dt.datetime.fromisoformat(x)
            if k == PLAIN:
                return {k: _value(x) for k, x in x.items()}
        return {k: _value(x) for k, x in stored.items()}
    return stored


def decoded(text: str) -> object:
    """The reverse of encoded(); datetimes come back in UTC."""
    stored = json.loads(text)
    return VOID if stored == {VOID_KEY: True} else _value(stored)


def variant(text: Column) -> Column:
    """Stored text as a VARIANT; null where it is no JSON."""
    return F.try_parse_json(text)


def is_void(value: Column) -> Column:
    """Is a VARIANT the absence of a result?"""
    return F.coalesce(F.to_json(value) == F.lit(f'{{"{VOID_KEY}":true}}'), F.lit(False))


def as_date(value: Column) -> Column:
    """The time of a VARIANT that is a date, else null."""
    return F.try_variant_get(value, f"$['{DATE}']", "timestamp_ntz")


def kind(value: Column) -> Column:
    """What a stored value is: void, date, null, boolean, number, string, array or object; null where there is none."""
    schema = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.lit(None))
        .when(is_void(value), "void")
        .when(schema.startswith("OBJECT"), F.when(as_date(value).isNotNull(), "date").otherwise("object"))
        .when(schema.startswith("ARRAY"), "array")
        .when(schema == "VOID", "null")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "STRING", "string")
        .otherwise("number")
    )
