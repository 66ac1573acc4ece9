"""Keyed writes as table-to-table operators, and snapshots on plain files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PROFILE_FIELDS = ("name", "age", "conditions", "emergency_contact", "notes",
                  "health_info_consent")
HEALTH_FIELDS = ("conditions", "notes")


def upsert_profiles(profiles: DataFrame, updates: DataFrame, now: Column,
                    key: str = "nickname", fields: Sequence[str] = PROFILE_FIELDS,
                    health_fields: Sequence[str] = HEALTH_FIELDS,
                    clear: str = "clear_health_info",
                    order: Sequence[str] | None = None) -> DataFrame:
    """Insert or update one row per key.

    Of several updates of a key the newest by ``order`` (columns of the updates; by default all
    other columns, so that the choice is repeatable) is the one that counts.

    A null in an update keeps the old value. Withdrawn consent clears the health fields
    of an existing row. Keys without an update pass through unchanged.
    """
    p, u = profiles.alias("p"), newest(updates, key, order).alias("u")
    exists, touched = F.col(f"p.{key}").isNotNull(), F.col(f"u.{key}").isNotNull()

    def value(f: str) -> Column:
        kept = F.coalesce(F.col(f"u.{f}"), F.col(f"p.{f}"))
        if f not in health_fields:
            return kept
        wiped = exists & touched & F.coalesce(F.col(f"u.{clear}"), F.lit(False))
        return F.when(~wiped, kept)

    return p.join(u, F.col(f"p.{key}") == F.col(f"u.{key}"), "full").select(
        F.coalesce(f"p.{key}", f"u.{key}").alias(key), *[value(f).alias(f) for f in fields],
        F.coalesce(F.col("p.created_at"), now).alias("created_at"),
        F.when(touched, now).otherwise(F.col("p.updated_at")).alias("updated_at"))


def upsert_summaries(summaries: DataFrame, updates: DataFrame, now: Column,
                     key: str = "nickname", order: Sequence[str] | None = None) -> DataFrame:
    """Replace summary and count of a key, or add it. Of several updates of a key the one with the
    largest count is taken, or the newest by ``order``."""
    s, u = summaries.alias("s"), newest(updates, key, order or ["summarized_count", "summary"]).alias("u")
    hit = F.col(f"u.{key}").isNotNull()

    def pick(f: str) -> Column:
        return F.when(hit, F.col(f"u.{f}")).otherwise(F.col(f"s.{f}")).alias(f)

    return s.join(u, F.col(f"s.{key}") == F.col(f"u.{key}"), "full").select(
        F.coalesce(f"s.{key}", f"u.{key}").alias(key), pick("summary"), pick("summarized_count"),
        F.coalesce("s.created_at", now).alias("created_at"),
        F.when(hit, now).otherwise(F.col("s.updated_at")).alias("updated_at"))


def newest(updates: DataFrame, key: str, order: Sequence[str] | None = None) -> DataFrame:
    """One update per key; updates without a key have no row to go to and are left out."""
    columns = updates.columns
    rest = list(order) if order else [c for c in columns if c != key]
    return latest_by_key(updates.filter(F.col(key).isNotNull()), [key], rest).select(columns)


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key. The maximum is combined before the exchange, so a key with
    very many versions costs one row per task."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max(F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)],
                            *[F.col(c) for c in rest if c not in order],
                            *[F.col(o) for o in order]))
    return df.groupBy(*keys).agg(newest.alias("_r")).select(
        *[F.col(k) for k in keys], *[F.col(f"_r.{c}").alias(c) for c in rest])


def delete_by_key(df: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    return df.join(doomed.select(key).distinct(), key, "left_anti")


def deletion_counts(df: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """Rows that a deletion takes and leaves, counted before it is done."""
    marked = df.join(doomed.select(key).distinct().withColumn("_x", F.lit(True)), key, "left")
    return marked.agg(F.count_if(F.col("_x").isNotNull()).alias("n_deleted"),
                      F.count_if(F.col("_x").isNull()).alias("n_kept"))


def ensure_columns(df: DataFrame, schema: StructType) -> DataFrame:
    """Add the columns of a newer schema that a table does not have yet, as nulls."""
    empty = df.sparkSession.createDataFrame([], schema)
    return df.select("*").unionByName(empty, allowMissingColumns=True)


def create_if_absent(spark: SparkSession, table: str, schema: StructType) -> bool:
    """Create an empty managed table once; True if this call created it."""
    if spark.catalog.tableExists(table):
        return False
    spark.createDataFrame([], schema).write.saveAsTable(table)
    return True
