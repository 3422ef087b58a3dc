"""Affiliation at a date, freshness, and runs of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import age_hours


def affiliation_at(items: DataFrame, affiliations: DataFrame, item_key: str, person: str, at: str, out: str = "party_at_date") -> DataFrame:
    """Items with the party of the affiliation that covers their date.

    affiliations: id, person, party, date_start, date_end (closed, null is open). First that covers the
    date by id; else, or without a date, the first that is still open; else the latest start. One
    aggregation per item with a minimum over (class, start, id): no window, combined map-side.
    """
    a = affiliations.select(F.col(person).alias("_p"), F.struct("id", "party", "date_start", "date_end").alias("_a"))
    d = F.to_date(F.col(at))
    covers = F.coalesce(d >= F.col("_a.date_start"), d.isNotNull() & F.col("_a.date_start").isNull()) & F.coalesce(d <= F.col("_a.date_end"), d.isNotNull() & F.col("_a.date_end").isNull())
    kind = F.when(covers, 0).when(F.col("_a.date_end").isNull(), 1).otherwise(2)
    late = F.when(kind == 2, F.datediff(F.lit("9999-12-31").cast("date"), F.coalesce("_a.date_start", F.lit("0001-01-01").cast("date")))).otherwise(0)
    best = (
        items.select(item_key, person, at)
        .join(a, F.col(person) == F.col("_p"))
        .groupBy(item_key)
        .agg(F.min_by("_a.party", F.struct(kind, late, F.col("_a.id"))).alias(out))
    )
    return items.join(best, item_key, "left")


def seed_affiliations(people: DataFrame, transitions: DataFrame, since: str = "2024-07-08") -> DataFrame:
    """Known transitions, and for everyone else one open affiliation to their group (dated for RN and UDR)."""
    rest = people.join(transitions.select("personality_id").distinct(), people["id"] == F.col("personality_id"), "left_anti")
    own = rest.select(F.col("id").alias("personality_id"), F.coalesce(F.nullif("famille", F.lit("")), "group_code").alias("party"), F.when(F.col("group_code").isin("RN", "UDR"), F.lit(since).cast("date")).alias("date_start"), F.lit(None).cast("date").alias("date_end"))
    return transitions.select(own.columns).unionByName(own)


def freshness(entities: DataFrame, now: Column, at: str = "last_collected_at", stale_hours: float = 24) -> DataFrame:
    """age_hours (one decimal) and whether it is stale: never collected, or older than `stale_hours`."""
    out = entities.withColumn("age_hours", age_hours(at, now))
    return out.withColumn("stale", F.col("age_hours").isNull() | (F.col("age_hours") > stale_hours))


def failure_streaks(attempts: DataFrame, entity: str, status: str = "status", order: str = "attempt_id", got_new: str | None = None, at: str | None = None) -> DataFrame:
    """Per entity: failures since the last success, the last status and, if asked, when something new last came.

    One aggregation over the log instead of a counter that is updated: a failure counts if it came
    after the last success.
    """
    last_ok = attempts.groupBy(entity).agg(
        F.max(F.when(F.col(status) == "ok", F.col(order))).alias("_ok"),
        F.max_by(status, order).alias("last_status"),
        *([F.max(F.when(F.col(got_new), F.col(at))).alias("last_collected_at")] if got_new and at else []),
    )
    later = attempts.join(last_ok, entity).groupBy(entity).agg(F.count_if((F.col(status) != "ok") & (F.col("_ok").isNull() | (F.col(order) > F.col("_ok")))).alias("consecutive_failures"))
    return last_ok.drop("_ok").join(later, entity)


def failing(health: DataFrame, least: int = 2) -> DataFrame:
    """Active entities with at least `least` failures in a row, worst first."""
    return health.where(F.col("is_active") & (F.col("consecutive_failures") >= least)).orderBy(F.desc("consecutive_failures"), "id")


def first_per(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
