"""JSON text as variants: parsed once, then read by paths, with the type that all rows agree on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with name: the variant of a JSON text, null for a null and for what isn't JSON."""
    return rows.withColumn(name, F.try_parse_json(text))


def at(variant: str, path: str, kind: str) -> Column:
    """The value at a path, null if there is none or it isn't of that type."""
    return F.try_variant_get(variant, path, kind)


def has(variant: str, path: str) -> Column:
    """Whether there is a value at a path, a JSON null included; false for a null variant."""
    return F.coalesce(F.try_variant_get(variant, path, "variant").isNotNull(), F.lit(False))


def shape(rows: DataFrame, variant: str) -> DataFrame:
    """schema: the type that holds all rows' variants."""
    return rows.agg(F.schema_of_variant_agg(variant).alias("schema"))
