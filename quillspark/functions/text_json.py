"""JSON values as columns: parsing to VARIANT, kinds, and strict objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """VARIANT, or null where the text isn't one JSON value.

    The parser stops after the first value.  Whatever follows it can go on neither in an array of one nor in an object.
    """
    one = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = F.try_variant_get(one, "$[1]", "variant").isNull() & F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}"))).isNotNull()
    return F.when(one.isNotNull() & alone, F.try_parse_json(text))


def kind(text: Column) -> Column:
    """object, array, string, boolean, long, double or null; a null column where the text isn't JSON."""
    s = F.schema_of_variant(parsed(text))
    return (
        F.when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "BIGINT", "long")
        .when(s.startswith("DECIMAL") | (s == "DOUBLE"), "double")
        .when(s == "VOID", "null")
    )


def is_object(text: Column) -> Column:
    return F.coalesce(kind(text) == "object", F.lit(False))


def written(value: Column) -> Column:
    """JSON of a struct, map or array."""
    return F.to_json(value)


def finite(x: Column) -> Column:
    """JSON has no NaN and no infinity: these become null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
