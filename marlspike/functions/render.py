"""Leafs, contacts and answers as JSON, CSV and YAML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspike.functions.text import yaml_scalar


def as_json(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.to_json(F.struct(*(columns or df.columns))).alias("value"))


def as_csv(df: DataFrame, *columns: str) -> DataFrame:
    """One line of CSV for each row; arrays are joined by semicolons."""
    flat = [F.array_join(c, ";").alias(c) if dict(df.dtypes)[c].startswith("array") else F.col(c) for c in (columns or df.columns)]
    return df.select(F.to_csv(F.struct(*flat)).alias("value"))


def leaf_yaml(*columns: str) -> Column:
    """An item of a YAML list; texts of several lines as blocks."""
    block = lambda c: F.concat(F.lit("|-\n      "), F.replace(F.col(c), F.lit("\n"), F.lit("\n      ")))
    value = lambda c: F.when(F.contains(F.col(c), F.lit("\n")), block(c)).otherwise(yaml_scalar(F.coalesce(c, F.lit(""))))
    return F.concat(F.lit("  - "), F.concat_ws("\n    ", *[F.concat(F.lit(f"{c}: "), value(c)) for c in columns]))


def to_yaml(value: object, depth: int = 0) -> str:
    """Dicts in their order, lists and scalars of an answer, on the driver."""
    pad = "  " * depth
    if isinstance(value, dict) and value:
        return "".join(f"{pad}{k}:{_inline(v, depth)}" for k, v in value.items())
    if isinstance(value, list) and value:
        return "".join(f"{pad}-{_inline(v, depth)}" for v in value)
    return f"{pad}{_scalar(value)}\n"


def _inline(value: object, depth: int) -> str:
    if isinstance(value, dict | list) and value:
        return "\n" + to_yaml(value, depth + 1)
    return f" {_scalar(value)}\n"


def _scalar(value: object) -> str:
    import json

    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int | float):
        return str(value)
    if isinstance(value, dict | list):
        return "{}" if isinstance(value, dict) else "[]"
    text = str(value)
    plain = text and not any(c in text for c in ":#[]{}&*!|>'\"%@`\n") and text.strip() == text and text[0] not in "-?" and text.lower() not in ("null", "true", "false", "yes", "no", "~")
    return text if plain and not text.replace(".", "", 1).isdigit() else json.dumps(text, ensure_ascii=False)
