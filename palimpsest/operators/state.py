"""Keyed state from event tables: newest row wins, guarded counters, entitlement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_wins(events: DataFrame, key: str, time: str, tie: str, columns: list[str]) -> DataFrame:
    """Per key the row of the newest time; of equal times the last to arrive (largest `tie`)."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(time, tie)).alias("r")).select(key, "r.*")


def grants(events: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """Each request's number within its key and whether the counter, which stops at limit, still allowed it."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("n", n).withColumn("granted", F.col("n") <= limit)


def quota_view(events: DataFrame, key: str, limit: int) -> DataFrame:
    """Per key: used (never above limit), remaining and paywalled."""
    used = F.least(F.count("*"), F.lit(limit))
    return events.groupBy(key).agg(used.alias("used"), F.greatest(F.lit(0), limit - used).alias("remaining"), (used >= limit).alias("paywalled"))


def entitled(revoked: Column, expires: Column, grace: Column, now: Column) -> Column:
    """Revoked by now: no; no expiry: yes; not expired: yes; else whether the grace period lasts."""
    return F.when(revoked.isNotNull() & (revoked <= now), False).when(expires.isNull(), True).when(expires > now, True).otherwise(F.coalesce(grace > now, F.lit(False)))


def peek(events: DataFrame, key: str, visitors: DataFrame, visitor: str, limit: int) -> DataFrame:
    """(visitor, used) of every visitor; one without events has used nothing."""
    used = events.groupBy(F.col(key).alias(visitor)).agg(F.count("*").alias("n"))
    return visitors.join(used, visitor, "left").select(visitor, F.least(F.coalesce("n", F.lit(0)), F.lit(limit)).cast("int").alias("used"))


def released(events: DataFrame, key: str, order: list[str], release: Column, limit: int, stretch: str = "stretch") -> DataFrame:
    """(key, used): reservations, limit at most, and releases, which take back one of them, in their order.

    A reservation beyond the limit and a release of nothing change nothing. What a stretch of events does to a counter
    is to add a number and to keep the result between two others, so stretches of a key (the column `stretch`, which
    grows with order) are folded one by one and then one after the other; no task holds all events of a key.
    """
    step = events.select(key, stretch, F.struct(*order).alias("o"), F.when(release, -1).otherwise(1).alias("d"))
    # x becomes least(greatest(x + add, low), high)
    start = F.struct(F.lit(0).alias("add"), F.lit(0).alias("low"), F.lit(limit).alias("high"))
    bounded = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(limit))
    one = lambda s, e: F.struct((s["add"] + e["d"]).alias("add"), bounded(s["low"] + e["d"]).alias("low"), bounded(s["high"] + e["d"]).alias("high"))
    parts = step.groupBy(key, stretch).agg(F.aggregate(F.array_sort(F.collect_list(F.struct("o", "d"))), start, one).alias("s"))
    through = lambda x, p: F.least(F.greatest(x + p["s"]["add"], p["s"]["low"]), p["s"]["high"])
    used = F.aggregate(F.array_sort(F.collect_list(F.struct(stretch, "s"))), F.lit(0), through)
    return parts.groupBy(key).agg(used.cast("int").alias("used"))


def subscription_state(transaction: Column, renewal: Column) -> list[Column]:
    """Fields of a subscription from its transaction and, where there is one, its renewal."""
    return [
        F.when(transaction["environment"] == "Production", "Production").otherwise("Sandbox").alias("environment"),
        F.coalesce(transaction["signed"], renewal["signed"], F.lit(0)).alias("signed_date_ms"),
        F.coalesce(renewal["auto_renew"] == 1, F.lit(False)).alias("auto_renew"),
    ]
