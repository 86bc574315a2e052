"""First and third parties: whose script runs on whose page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.functions import urls


def with_entity(rows: DataFrame, entities: DataFrame, host: str, name: str, tracking: str, suffixes: DataFrame | None = None) -> DataFrame:
    """rows with the owner of a host's registrable domain, or the host itself with tracking 0. suffixes: a table of public suffixes, else a short list."""
    dim = entities.select(F.col("domain").alias("_domain"), F.col("display_name").alias(name), F.col("tracking").alias(tracking))
    keyed = rows.withColumn("_domain", urls.registrable(F.col(host))) if suffixes is None else urls.with_registrable(rows, host, suffixes, "_domain")
    return keyed.join(dim, "_domain", "left").withColumns({name: F.coalesce(F.col(name), F.col(host)), tracking: F.coalesce(F.col(tracking), F.lit(0.0))}).drop("_domain")


def parties(active: DataFrame, entities: DataFrame, root: str | None = None, suffixes: DataFrame | None = None) -> DataFrame:
    """active (sha2, url, first_origin, ...) with owners of script, origin and root page, and who is a third party.

    root: the page's URL; without it the origin is the first party. Each row is a script once.
    """
    rows = active.withColumns({"script_host": urls.hostname(F.col("url")), "origin_host": urls.hostname(F.col("first_origin"))})
    rows = with_entity(rows, entities, "script_host", "script_owner", "tracking", suffixes)
    rows = with_entity(rows, entities, "origin_host", "origin_owner", "origin_tracking", suffixes).drop("origin_tracking")
    page = urls.hostname(F.lit(root)) if root else F.col("origin_host")
    rows = with_entity(rows.withColumn("root_host", page), entities, "root_host", "root_owner", "root_tracking", suffixes).drop("root_tracking")
    return rows.withColumns({"third_party": F.col("script_owner") != F.col("origin_owner"), "third_party_to_root": F.col("script_owner") != F.col("root_owner")})
