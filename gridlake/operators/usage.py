"""Monthly usage counters and quotas over a table of usage events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from ..functions.dates import next_reset


def utc_month(events: DataFrame, ts: str) -> Column:
    """``yyyy-MM`` of an instant in UTC, whatever the session's zone; zone-free times as they stand."""
    if not isinstance(events.schema[ts].dataType, TimestampType):
        return F.date_format(ts, "yyyy-MM")
    day = F.date_from_unix_date(F.floor(F.unix_micros(ts) / 86_400_000_000).cast("int"))
    return F.date_format(day, "yyyy-MM")


def monthly_usage(
    events: DataFrame,
    user: str = "user_id",
    action: str = "action",
    ts: str = "ts",
    found: Column | None = None,
    premium: Column | None = None,
) -> DataFrame:
    """``user, action, month, used``; runs that found nothing and premium users do not count."""
    rows = events
    if found is not None:
        rows = rows.where(found > 0)
    if premium is not None:
        rows = rows.where(~F.coalesce(premium, F.lit(False)))
    return rows.groupBy(
        F.col(user).alias("user"),
        F.col(action).alias("action"),
        utc_month(rows, ts).alias("month"),
    ).agg(F.count("*").alias("used"))


def quota_status(
    usage: DataFrame, limits: dict[str, int | None], premium: Column | None = None
) -> DataFrame:
    """Adds max, capped used, remaining, allowed and near_limit; a missing limit is unlimited.

    Limits are parameters (a handful of actions), so they enter the plan as literals.
    """
    bounded = [(a, m) for a, m in limits.items() if m is not None]
    table = F.create_map(*[F.lit(x) for pair in bounded for x in pair]) if bounded else None
    cap = (
        F.try_element_at(table, F.col("action")).cast("bigint")
        if table is not None
        else F.lit(None).cast("bigint")
    )
    free = F.coalesce(premium, F.lit(False)) if premium is not None else F.lit(False)
    cap = F.when(free, F.lit(None).cast("bigint")).otherwise(cap)
    used = F.least(F.col("used"), F.col("max"))
    return (
        usage.withColumn("max", cap)
        .withColumn("used", used)
        .withColumn("remaining", F.col("max") - F.col("used"))
        .withColumn("allowed", F.coalesce(F.col("used") < F.col("max"), F.lit(True)))
        .withColumn("near_limit", F.coalesce(F.col("used") == F.col("max") - 1, F.lit(False)))
        .withColumn("resets_on", next_reset(F.to_date(F.concat("month", F.lit("-01")))))
    )
