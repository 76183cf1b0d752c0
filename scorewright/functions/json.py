"""JSON as Python's json module reads it."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as TY

_KIND = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}


@F.pandas_udf(TY.StructType([TY.StructField("ok", TY.BooleanType()), TY.StructField("kind", TY.StringType()), TY.StructField("canon", TY.StringType())]))
def _parse(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        try:
            value = json.loads(t) if t is not None else None
            # NaN and the infinities have no JSON form that other readers take; they stay Python's words
            rows.append((t is not None, _KIND[type(value)] if t is not None else None, json.dumps(value, ensure_ascii=False) if t is not None else None))
        except (ValueError, RecursionError):
            rows.append((False, None, None))
    return pd.DataFrame(rows, columns=["ok", "kind", "canon"])


@F.pandas_udf(TY.StringType())
def _shown(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else str(json.loads(t)) for t in texts])


def shown(text: Column) -> Column:
    """A JSON value as Python's str() shows it: True, None, ['a', 1.5]."""
    return _shown(text)


def parse(text: Column) -> Column:
    """(ok, kind, canon): whether the text is JSON by Python's rules, the kind of value, and the value written anew (last of duplicate keys)."""
    return _parse(text)


def field(canon: Column, key: str) -> Column:
    """(present, is_string, text) of an object's field."""
    value = F.try_variant_get(F.try_parse_json(canon), f"$['{key}']", "variant")
    return F.struct(
        value.isNotNull().alias("present"),
        F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False)).alias("is_string"),
        F.try_variant_get(F.try_parse_json(canon), f"$['{key}']", "string").alias("text"),
    )


# The three patterns of the salvage.
_BRACES = r"(?s)\{.*\}"
_FENCE = r"(?m)(?d)^```json[\s\x1c-\x1f\x{85}\x{a0}]*|[\s\x1c-\x1f\x{85}\x{a0}]*```$"
_SHALLOW = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"


def braces(text: Column) -> Column:
    """From the first { to the last }, across lines; null without both."""
    return F.nullif(F.regexp_extract(text, _BRACES, 0), F.lit(""))


def unfenced(text: Column) -> Column:
    """Without ```json at a line's start and ``` at a line's end."""
    return F.regexp_replace(text, _FENCE, "")


def shallow_braces(text: Column) -> Column:
    """The first {...} with at most one level of braces inside."""
    return F.nullif(F.regexp_extract(text, _SHALLOW, 0), F.lit(""))
