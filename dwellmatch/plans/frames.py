"""Shared frames of the registered queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellmatch.operators import match, notify, quality, skew, upsert
from dwellmatch.plans import adapter as A
from dwellmatch.sources.registry import filter_definitions

LISTING_KEY = ["source_slug", "external_id"]


def listing_key() -> Column:
    return F.concat_ws("|", *LISTING_KEY)


def gated(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_gate(A.observations(spark, d), A.REGIONS)


def latest(spark: SparkSession, d: str, by_order: bool = False) -> DataFrame:
    """Newest observation per listing with the gate's verdict."""
    return quality.quality_gate(A.newest_observations(spark, d, by_order), A.REGIONS)


def live(spark: SparkSession, d: str, by_order: bool = False) -> DataFrame:
    return latest(spark, d, by_order).filter("ok").drop("ok", "issues")


def live_columns(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """``listing_id`` and some columns of ``live``. The gate judges each row by itself, so it does so before the
    newest one is chosen, and only its verdict, these columns and the order are shuffled."""
    rows = quality.quality_gate(A.observations(spark, d).withColumn("listing_id", listing_key()), A.REGIONS)
    narrow = rows.select("listing_id", "ok", *dict.fromkeys([*columns, "seen_at", *A.SEQ]))
    return skew.latest_per_key(narrow, ["listing_id"], ["seen_at", *A.SEQ]).filter("ok").select("listing_id", *columns)


def incoming(spark: SparkSession, d: str) -> DataFrame:
    """Gated rows with their listing id, dealt out by it."""
    return quality.gated_rows(quality.quality_gate(A.listed_observations(spark, d), A.REGIONS))


def versions(spark: SparkSession, d: str) -> DataFrame:
    return upsert.listing_versions(incoming(spark, d), seq=A.SEQ)


def snapshot(spark: SparkSession, d: str) -> DataFrame:
    return upsert.snapshot(versions(spark, d), seq=A.SEQ)


def matched(spark: SparkSession, d: str, listings: DataFrame | None = None, profiles: DataFrame | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    return match.inverse_match(
        live(spark, d) if listings is None else listings, A.profiles(spark, d) if profiles is None else profiles,
        A.filters(spark, d), filter_definitions(spark), carry=carry,
    )


def past_matches(spark: SparkSession, d: str) -> DataFrame:
    return A.past_matches(spark, d).withColumn("listing_id", listing_key()).drop(*LISTING_KEY)


def past_notifications(spark: SparkSession, d: str) -> DataFrame:
    """Earlier notifications with their listing key."""
    known = A.observations(spark, d).select("external_id", listing_key().alias("listing_id")).distinct()
    return A.past_notifications(spark, d).join(known, "external_id").drop("external_id")


def last_events(spark: SparkSession, d: str) -> DataFrame:
    """Event of the newest version of each listing, where that version has one."""
    newest = skew.latest_per_key(
        versions(spark, d).select("listing_id", "event", "change_version", "seen_at", *A.SEQ), ["listing_id"], ["seen_at", *A.SEQ]
    )
    return newest.filter("event is not null").select("listing_id", "event", "change_version", F.col("seen_at").alias("at"))


def recorded(spark: SparkSession, d: str, carry_profile: Sequence[str] = ()) -> DataFrame:
    """Recorded matches of the listings whose newest version has an event."""
    listings = live(spark, d).join(last_events(spark, d), "listing_id")
    return match.match_and_record(
        listings, A.profiles(spark, d), A.filters(spark, d), filter_definitions(spark), past_matches(spark, d).drop("matched_at"),
        carry_profile=carry_profile,
    )


def known_matched(spark: SparkSession, d: str) -> DataFrame:
    """The matches that are known already."""
    return match.still_matched(past_matches(spark, d), live(spark, d), A.profiles(spark, d), A.filters(spark, d), filter_definitions(spark))


def notify_events(spark: SparkSession, d: str) -> DataFrame:
    events, _ = match.fan_out(recorded(spark, d, match.PROFILE_COLUMNS), A.profiles(spark, d))
    return events.withColumn("matched_at", F.col("at"))


def fanned(spark: SparkSession, d: str) -> DataFrame:
    return notify.fan_out_subscriptions(notify.eligible(notify_events(spark, d)), A.subscriptions(spark, d))
