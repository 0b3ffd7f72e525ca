"""Typed access to the JSON body of a click event."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

JSON_SPACE = " \t\n\r"


def parse_body(body: Column) -> Column:
    """VARIANT of a body holding exactly one JSON value, else NULL.

    ``try_parse_json`` ignores text after the first value. When the only
    closing brace is the last character nothing can follow; any other body must
    also parse inside an array and inside an object, which no trailing text can.
    """
    trimmed = F.rtrim(body, F.lit(JSON_SPACE))
    closes_at_end = F.instr(trimmed, "}") == F.length(trimmed)
    in_array = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"w":'), body, F.lit("}")))
    whole = closes_at_end | (in_array.isNotNull() & in_object.isNotNull())
    return F.when(whole, F.try_parse_json(body))


def type_at(parsed: Column, key: str) -> Column:
    """Type name under ``key``: NULL when absent, ``VOID`` for an explicit null."""
    return F.schema_of_variant(F.try_variant_get(parsed, f"$.{key}", "variant"))


def text_at(parsed: Column, key: str) -> Column:
    return F.try_variant_get(parsed, f"$.{key}", "string")


def number_at(parsed: Column, key: str) -> Column:
    return F.try_variant_get(parsed, f"$.{key}", "double")


def is_numeric_type(type_name: Column) -> Column:
    """JSON numbers; booleans count too, as 1 and 0."""
    return type_name.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | F.startswith(type_name, F.lit("DECIMAL"))
