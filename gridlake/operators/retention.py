"""Keyed upsert, keep-latest and expiry for saved views of any number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: parts a partition is trimmed in before its rows meet
SALTS = 64
# Snapshots kept, and how long an automatic one lives.
KEPT_VIEWS = 50
VIEW_HOURS = 24


def upsert_by_key(
    existing: DataFrame,
    incoming: DataFrame,
    key: str = "name",
    id_col: str = "id",
    position: str = "position",
    recency: str = "saved_at",
) -> DataFrame:
    """Replace rows in place by key, append new keys after the last position.

    A replaced row keeps its id and position and takes the most recent content.  New
    keys keep their arrival order: the least incoming position follows the largest existing
    one, wherever incoming positions start; rows without one come after all others.
    Aggregation only, so a hot key combines on the map side.
    """
    last = existing.agg(F.coalesce(F.max(position), F.lit(0))).scalar()
    least = incoming.agg(F.coalesce(F.min(position), F.lit(0))).scalar()
    most = incoming.agg(F.coalesce(F.max(position), F.lit(0))).scalar()
    arrived = F.coalesce(F.col(position), most + 1)
    incoming = incoming.withColumn(position, arrived.cast(existing.schema[position].dataType))
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c not in (key, id_col, position)]
    arrival = F.struct("_new", position)
    merged = both.groupBy(key).agg(
        F.min_by(F.struct(id_col, position, "_new"), arrival).alias("_first"),
        F.max_by(F.struct(*rest), F.struct("_new", recency, position)).alias("_last"),
    )
    at = F.when(F.col("_first._new") == 1, last + F.col(f"_first.{position}") - least + 1).otherwise(
        F.col(f"_first.{position}")
    )
    return merged.select(
        F.col(f"_first.{id_col}").alias(id_col),
        key,
        at.alias(position),
        *[F.col(f"_last.{c}").alias(c) for c in rest],
    ).select(*existing.columns)


def keep_latest(
    df: DataFrame, n: int = KEPT_VIEWS, partition: list[str] | None = None, position: str = "position"
) -> DataFrame:
    """The last ``n`` rows by position, overall or per partition.

    A salted first round trims each of ``SALTS`` parts of a partition to n rows, so a hot
    partition never reaches one task whole.
    """
    if not partition:
        return df.orderBy(F.col(position).desc()).limit(n)
    last = F.col(position).desc()
    salted = Window.partitionBy(*partition, "_salt").orderBy(last)
    rows = (
        df.withColumn("_salt", F.pmod(F.xxhash64(position), F.lit(SALTS)))
        .withColumn("_rn", F.row_number().over(salted))
        .where(F.col("_rn") <= n)
        .drop("_salt", "_rn")
    )
    window = Window.partitionBy(*partition).orderBy(last)
    return rows.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")


def expire(
    df: DataFrame, now: Column, ttl_hours: float = VIEW_HOURS, saved_at: str = "saved_at"
) -> DataFrame:
    """Drop rows older than the ttl at ``now``; exactly the ttl is kept."""
    limit = now - F.make_dt_interval(secs=F.lit(ttl_hours * 3600))
    return df.where(F.col(saved_at) >= limit)
