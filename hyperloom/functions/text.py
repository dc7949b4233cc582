"""Splitting text, JSON and s-expressions into lists."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The separators of a split.
SEPARATORS = " \t\n\r\x0b"


def split(text: Column, separators: str = SEPARATORS) -> Column:
    """Non-empty pieces between any of the separators."""
    marks = "".join(f"\\u{ord(c):04x}" for c in separators)
    return F.filter(F.split(text, f"[{marks}]"), lambda x: x != "")


def json_pairs(text: Column) -> Column:
    """A flat object as (key, value) pairs in order, scalars as strings."""
    return F.map_entries(F.from_json(text, T.MapType(T.StringType(), T.StringType())))


def _strings(x: object) -> object:
    if isinstance(x, dict):
        return [[k, _strings(v)] for k, v in x.items()]
    if isinstance(x, list):
        return [_strings(v) for v in x]
    return x if isinstance(x, str) else json.dumps(x)


@F.pandas_udf(T.StringType())
def json_split(texts: pd.Series) -> pd.Series:
    """Any JSON as nested lists, written as JSON: objects as lists of pairs, every scalar a string.

    What follows the first value isn't looked at; a text that doesn't start with one gives null.
    """
    decode = json.JSONDecoder(parse_float=str, parse_int=str).raw_decode

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            return json.dumps(_strings(decode(t.lstrip())[0]), ensure_ascii=False)
        except ValueError:
            return None

    return texts.map(one)


def variant_pairs(text: Column) -> Column:
    """The JSON as a VARIANT, for nested access in the JVM."""
    return F.try_parse_json(text)
