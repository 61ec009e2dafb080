"""Snapshots: hashes of rows, differences and merges of keyed tables, edges with existing ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnwatch.functions import canonical

#: Columns that don't count as a change.
VOLATILE = ("created_at", "updated_at", "entity_hash", "raw_data")


def entity_hash(df: DataFrame) -> Column:
    """md5 of the columns as canonical JSON, the volatile ones left out."""
    return canonical.key_hash(df, [c for c in df.columns if c not in VOLATILE])


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): new, modified or removed; both sides are whole snapshots."""
    a = old.select(key, entity_hash(old).alias("_a"))
    b = new.select(key, entity_hash(new).alias("_b"))
    change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change IS NOT NULL")


def merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert by key: rows of either side, the new side's values where they are given; a null there leaves the old value."""
    names = [c for c in old.columns if c != key]
    joined = old.alias("o").join(new.alias("n"), key, "full_outer")
    return joined.select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in names])


def apply_deletes(current: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return current.join(deleted.select(key), key, "left_anti")
