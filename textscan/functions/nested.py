"""Text functions on nested columns: the schema decides where the strings are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TextFunction = Callable[[Column], Column]


def _last_wins(entries: Column) -> Column:
    """Of entries with equal keys keep the last value, in the place of the first."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(
        F.transform(
            keys,
            lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value")),
        )
    )


def apply_nested(value: Column, data_type: T.DataType, function: TextFunction, keys: bool = False) -> Column:
    """``function`` on every string inside ``value``; other types are unchanged.
    ``keys`` also maps the string keys of maps (of keys that become equal, the
    last one's value stays)."""
    if isinstance(data_type, T.StringType):
        return function(value)
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda x: apply_nested(x, data_type.elementType, function, keys))
    if isinstance(data_type, T.StructType):
        fields = [
            apply_nested(value[f.name], f.dataType, function, keys).alias(f.name) for f in data_type.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(data_type, T.MapType):
        if keys and isinstance(data_type.keyType, T.StringType):
            entries = F.transform(
                F.map_entries(value),
                lambda e: F.struct(
                    function(e["key"]).alias("key"),
                    apply_nested(e["value"], data_type.valueType, function, keys).alias("value"),
                ),
            )
            return _last_wins(entries)
        return F.transform_values(value, lambda _, v: apply_nested(v, data_type.valueType, function, keys))
    return value


def normalize_columns(
    df: DataFrame, function: TextFunction, columns: list[str] | None = None, keys: bool = True
) -> DataFrame:
    """Apply a text function to whole columns, however nested."""
    names = columns or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: apply_nested(F.col(c), types[c], function, keys) for c in names})


def flatten(value: Column, data_type: T.DataType) -> Column:
    """A nested array as one flat array; anything else as an array of one."""
    if not isinstance(data_type, T.ArrayType):
        return F.array(value)
    while isinstance(data_type.elementType, T.ArrayType):
        value, data_type = F.flatten(value), data_type.elementType
    return value
