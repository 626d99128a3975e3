"""Matching and notification queries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellmatch.functions import keys as K
from dwellmatch.functions.delivery import classify_error
from dwellmatch.operators import match, notify, upsert
from dwellmatch.plans import adapter as A
from dwellmatch.plans import frames as fr
from dwellmatch.plans.registry import query
from dwellmatch.plans.sqltext import haversine, num_text
from dwellmatch.session import read_table
from dwellmatch.sources.registry import DEFINITION_SCHEMA, filter_definitions

_INSIDE = haversine("l.lat", "l.lng", "w.f_lat", "w.f_lng")


def matches_per_profile(spark: SparkSession, d: str) -> DataFrame:
    return fr.matched(spark, d).groupBy("profile_id").agg(F.count("*").alias("matches"))


query(
    "f4_matches_per_profile",
    "SELECT profile_id, count(*) AS matches FROM matched GROUP BY profile_id",
)(matches_per_profile)


@query("f4_inverse_match", "SELECT profile_id, listing_id FROM matched")
def inverse_match(spark: SparkSession, d: str) -> DataFrame:
    return fr.matched(spark, d)


@query(
    "f2_explain_pairs",
    "SELECT profile_id, listing_id, failed = '' AS matched, failed AS failed_keys FROM (SELECT w.profile_id, l.listing_id, array_to_string(list_filter(["
    "CASE WHEN f_city IS NOT NULL AND NOT coalesce(l.city = f_city, false) THEN 'city' END, "
    "CASE WHEN NOT coalesce(l.price <= f_price, false) THEN 'price' END, "
    "CASE WHEN f_rooms IS NOT NULL AND NOT coalesce(l.rooms >= f_rooms, false) THEN 'rooms' END, "
    "CASE WHEN f_balcony AND NOT coalesce(l.balcony, false) THEN 'balcony' END, "
    f"CASE WHEN f_radius IS NOT NULL AND NOT coalesce({_INSIDE} <= f_radius, false) THEN 'location' END"
    "], lambda x: x IS NOT NULL), ',') AS failed FROM past_matches m JOIN live l USING (listing_id) JOIN wide w ON w.profile_id = m.profile_id)",
)
def explain_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = fr.past_matches(spark, d)
    out = match.explain_pairs(pairs, fr.live(spark, d), A.filters(spark, d), filter_definitions(spark))
    return out.withColumn("failed_keys", F.array_join("failed_keys", ","))


def _own_definitions(spark: SparkSession) -> DataFrame:
    rows = [
        ("max_warm", {"de": "Warmmiete"}, "number", ["lte"], json.dumps({"binding": {"column": "warm_rent"}}), True),
        ("lift", {"de": "Lift"}, "bool", ["eq"], json.dumps({"binding": {"attribute": "elevator"}}), True),
        ("kind", {"de": "Titel"}, "text", ["in"], json.dumps({"binding": {"column": "title"}}), True),
        ("off", {"de": "Aus"}, "bool", ["eq"], "{}", False),
    ]
    return filter_definitions(spark).unionByName(spark.createDataFrame(rows, DEFINITION_SCHEMA))


@query(
    "f3_own_definitions",
    "SELECT c_custkey AS profile_id, count(*) AS matches FROM customer JOIN live l ON c_acctbal >= 0 AND c_custkey % 7 <> 0 "
    "AND l.warm_rent <= floor(200 + c_acctbal/8) AND (c_custkey % 2 = 0 OR l.elevator) AND (c_custkey % 5 <> 0 OR l.title IN ('red widget', 'small ring', 'blue widget')) GROUP BY 1",
)
def own_definitions(spark: SparkSession, d: str) -> DataFrame:
    """New filters are new definition rows: column, attribute and list bindings, one inactive."""
    row = lambda i, key, op, value, cond: F.when(
        F.expr(cond), F.struct(F.lit(i).alias("position"), F.lit(key).alias("key"), F.lit(op).alias("operator"), F.expr(value).alias("value_json"))
    )
    rows = [
        row(0, "max_warm", "lte", "cast(cast(floor(200 + c_acctbal/8) as bigint) as string)", "true"),
        row(1, "lift", "eq", "'true'", "c_custkey % 2 <> 0"),
        row(2, "kind", "in", "'[\"red widget\",\"small ring\",\"blue widget\"]'", "c_custkey % 5 = 0"),
        row(3, "off", "eq", "'true'", "c_custkey % 7 = 0"),
    ]
    filters = read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("profile_id"), F.inline(F.array_compact(F.array(*rows)))
    )
    pairs = match.inverse_match(fr.live(spark, d), A.profiles(spark, d), filters, _own_definitions(spark))
    return pairs.groupBy("profile_id").agg(F.count("*").alias("matches"))


@query(
    "f6_radius_join",
    f"SELECT w.profile_id AS circle_id, count(*) AS points, min({_INSIDE}) AS nearest_km FROM wide w JOIN live l ON w.f_radius IS NOT NULL AND {_INSIDE} <= w.f_radius GROUP BY 1",
)
def radius_join(spark: SparkSession, d: str) -> DataFrame:
    circle = F.from_json("value_json", "lat double, lng double, radius_km double")
    circles = A.filters(spark, d).filter("key = 'location'").select("profile_id", circle.alias("c")).select(
        F.col("profile_id").alias("circle_id"), F.col("c.lat").alias("c_lat"), F.col("c.lng").alias("c_lng"), F.col("c.radius_km").alias("radius_km")
    )
    points = fr.live(spark, d).select(F.col("listing_id").alias("point_id"), "lat", "lng")
    return match.radius_counts(points, circles)


@query(
    "f7_record_matches",
    "SELECT event, state, is_new, triggers, count(*) AS n, count(change_version) AS versions FROM recorded GROUP BY ALL",
)
def record_matches(spark: SparkSession, d: str) -> DataFrame:
    return fr.recorded(spark, d).groupBy("event", "state", "is_new", "triggers").agg(
        F.count("*").alias("n"), F.count("change_version").alias("versions")
    )


@query(
    "f8_fan_out",
    "SELECT p.user_id, 'notify' AS kind, count(*) AS n FROM recorded r JOIN profiles p USING (profile_id) WHERE triggers AND notify GROUP BY ALL "
    "UNION ALL SELECT p.user_id, 'reply', count(*) FROM recorded r JOIN profiles p USING (profile_id) WHERE triggers AND auto_reply_enabled AND length(trim(auto_reply_text)) > 0 GROUP BY ALL",
)
def fan_out(spark: SparkSession, d: str) -> DataFrame:
    events, replies = match.fan_out(fr.recorded(spark, d, match.PROFILE_COLUMNS), A.profiles(spark, d))
    count = lambda df, kind: df.groupBy("user_id", F.lit(kind).alias("kind")).agg(F.count("*").alias("n"))
    return count(events, "notify").unionByName(count(replies, "reply"))


@query(
    "f9_rejected_events",
    "SELECT listing_id, event, 'changed match events require changeVersion' AS error FROM versions WHERE event = 'changed' AND s3 < 10",
)
def rejected_events(spark: SparkSession, d: str) -> DataFrame:
    v = fr.versions(spark, d).withColumn("change_version", F.when(F.col("s3") >= 10, F.col("change_version")))
    _, errors = match.reject_events(upsert.match_events(v))
    return errors.select("listing_id", "event", "error")


@query(
    "f10_failure_counts",
    "WITH a AS (SELECT * FROM wide WHERE is_active) "
    "SELECT 'city' AS key, count(*) AS failures FROM a w JOIN live l ON w.f_city IS NOT NULL AND l.city <> w.f_city "
    "UNION ALL SELECT 'price', count(*) FROM a w JOIN live l ON NOT coalesce(l.price <= w.f_price, false) "
    "UNION ALL SELECT 'rooms', count(*) FROM a w JOIN live l ON w.f_rooms IS NOT NULL AND NOT l.rooms >= w.f_rooms "
    "UNION ALL SELECT 'balcony', count(*) FROM a w JOIN live l ON w.f_balcony AND NOT l.balcony "
    f"UNION ALL SELECT 'location', count(*) FROM a w JOIN live l ON w.f_radius IS NOT NULL AND NOT {_INSIDE} <= w.f_radius",
)
def failure_counts(spark: SparkSession, d: str) -> DataFrame:
    return match.failure_counts(fr.live(spark, d), A.profiles(spark, d), A.filters(spark, d), filter_definitions(spark))


@query(
    "f11_match_rate",
    "SELECT matches, listings, matches * 1000 / listings AS per_thousand, dismissed / matches AS dismissed_share FROM "
    "(SELECT count(*) AS matches, count(*) FILTER (state = 'dismissed') AS dismissed FROM past_matches), (SELECT count(*) AS listings FROM live)",
)
def match_rate(spark: SparkSession, d: str) -> DataFrame:
    return match.match_rate(fr.past_matches(spark, d), fr.live(spark, d))


@query("g1_eligible", "SELECT event, state, count(*) AS n FROM eligible GROUP BY ALL")
def eligible(spark: SparkSession, d: str) -> DataFrame:
    return notify.eligible(fr.notify_events(spark, d)).groupBy("event", "state").agg(F.count("*").alias("n"))


@query(
    "g2_fan_out_subscriptions",
    "SELECT subscription_id, chat_id, count(*) AS n, sum(profile_id) AS profiles, "
    "min(concat('telegram:', sha256(concat(cast(subscription_id as varchar), ':', listing_id)))) AS first_key FROM fanned GROUP BY ALL",
)
def fan_out_subscriptions(spark: SparkSession, d: str) -> DataFrame:
    return fr.fanned(spark, d).groupBy("subscription_id", "chat_id").agg(
        F.count("*").alias("n"), F.sum("profile_id").alias("profiles"), F.min("dedupe_key").alias("first_key")
    )


@query(
    "g3_unreachable",
    "SELECT user_id, count(*) AS n FROM eligible WHERE user_id NOT IN (SELECT user_id FROM subs WHERE enabled AND user_id % 11 <> 0) GROUP BY user_id",
)
def unreachable(spark: SparkSession, d: str) -> DataFrame:
    paused = A.subscriptions(spark, d).withColumn("enabled", F.col("enabled") & (F.col("user_id") % 11 != 0))
    done = notify.unreachable(notify.eligible(fr.notify_events(spark, d)), paused)
    return done.groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    "g4_without_delivered",
    "SELECT subscription_id, count(*) AS n FROM fanned f WHERE NOT EXISTS (SELECT 1 FROM past_notifications p "
    "WHERE p.status = 'sent' AND p.subscription_id = f.subscription_id AND p.listing_id = f.listing_id) GROUP BY subscription_id",
)
def without_delivered(spark: SparkSession, d: str) -> DataFrame:
    return notify.without_delivered(fr.fanned(spark, d), fr.past_notifications(spark, d)).groupBy("subscription_id").agg(
        F.count("*").alias("n")
    )


@query(
    "g5_get_or_create",
    "SELECT is_new, status, CASE WHEN status IN ('sent', 'failed', 'skipped') THEN 'done' WHEN status = 'queued' THEN 'in_flight' ELSE 'send' END AS action, count(*) AS n FROM ("
    "SELECT p.status IS NULL AS is_new, coalesce(p.status, 'pending') AS status FROM fanned f LEFT JOIN "
    "(SELECT subscription_id, listing_id, arg_max(status, created_at) AS status FROM past_notifications GROUP BY ALL) p USING (subscription_id, listing_id)) GROUP BY ALL",
)
def get_or_create(spark: SparkSession, d: str) -> DataFrame:
    known = fr.past_notifications(spark, d).withColumn(
        "dedupe_key", notify.delivery_key(F.col("subscription_id").cast("string"), F.col("listing_id"))
    )
    return notify.get_or_create(fr.fanned(spark, d), known).groupBy("is_new", "status", "action").agg(F.count("*").alias("n"))


_CODE = "CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 429 WHEN 1 THEN 403 WHEN 2 THEN 400 WHEN 3 THEN 502 END END"
_TEXT = (
    "CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN concat('Too Many Requests: retry after ', cast(event_id % 9 as string)) "
    "WHEN 1 THEN 'Forbidden: bot was blocked by the user' WHEN 2 THEN concat('Bad Request: chat not found bot', cast(event_id as string), ':AbC-9') "
    "WHEN 3 THEN 'Bad Gateway' ELSE 'socket hang up' END END"
)
_CLASSIFIED = (
    f"SELECT event_id, user_id, ts, event_id % 6 + 1 AS attempt, {_CODE} AS code, "
    "CASE event_id % 5 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'blocked' WHEN 2 THEN 'permanent' ELSE 'retryable' END AS kind, "
    "CASE WHEN event_id % 5 = 0 THEN 1000 * CASE WHEN event_id % 9 = 0 THEN 1 ELSE event_id % 9 END END AS retry_after_ms, "
    "CASE event_id % 5 WHEN 0 THEN concat('telegram_retry_after:', cast(CASE WHEN event_id % 9 = 0 THEN 1 ELSE event_id % 9 END as varchar)) WHEN 1 THEN 'telegram_bot_blocked' "
    "WHEN 2 THEN 'telegram_permanent:400:Bad Request: chat not found bot<redacted>' WHEN 3 THEN 'telegram_retryable:502:Bad Gateway' ELSE 'telegram_retryable:socket hang up' END AS error, "
    "event_type = 'error' AS failed FROM events"
)
_NEXT = "CASE WHEN kind IN ('blocked', 'permanent') THEN 'failed' WHEN kind = 'rate_limited' THEN 'pending' WHEN attempt >= 5 THEN 'failed' ELSE 'pending' END"


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("dedupe_key"),
        F.col("user_id").alias("subscription_id"),
        (F.col("event_id") % 6 + 1).alias("attempt"),
        F.col("ts").alias("at"),
        F.expr(_CODE).alias("error_code"),
        F.expr(_TEXT).alias("description"),
        F.lit(None).cast("long").alias("retry_after"),
    )


@query(
    "g6_latest_states",
    f"WITH c AS ({_CLASSIFIED}), s AS (SELECT *, CASE WHEN failed THEN {_NEXT} ELSE 'sent' END AS status FROM c), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY status = 'sent' DESC, ts DESC, attempt DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS attempts FROM s) "
    "SELECT cast(user_id as varchar) AS dedupe_key, status, CASE WHEN failed THEN error END AS error, CASE WHEN status = 'sent' THEN ts END AS sent_at, attempts FROM r WHERE rn = 1",
)
def latest_states(spark: SparkSession, d: str) -> DataFrame:
    return notify.latest_states(_attempts(spark, d)).drop("retry_after_ms")


@query(
    "g8_error_routing",
    f"WITH c AS ({_CLASSIFIED}) SELECT event_id, kind, error, retry_after_ms, {_NEXT} AS status, kind = 'blocked' AS disable_subscription FROM c WHERE failed",
)
def error_routing(spark: SparkSession, d: str) -> DataFrame:
    routed = notify.route_errors(_attempts(spark, d).filter("description is not null"))
    return routed.select("event_id", "kind", "error", "retry_after_ms", "status", "disable_subscription")


@query(
    "g8_disabled_subscriptions",
    "SELECT subscription_id, enabled AND subscription_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 5 = 1) AS enabled FROM subs",
)
def disabled_subscriptions(spark: SparkSession, d: str) -> DataFrame:
    routed = notify.route_errors(_attempts(spark, d).filter("description is not null"))
    return notify.disable_blocked(A.subscriptions(spark, d), routed).select("subscription_id", "enabled")


@query(
    "c21_error_classes",
    f"WITH c AS ({_CLASSIFIED}) SELECT kind, error, count(*) AS n FROM c WHERE failed GROUP BY ALL",
)
def error_classes(spark: SparkSession, d: str) -> DataFrame:
    cls = classify_error(F.col("error_code"), F.col("description"), F.col("retry_after"))
    rows = _attempts(spark, d).filter("description is not null").select(cls.alias("c"))
    return rows.groupBy("c.kind", "c.error").agg(F.count("*").alias("n"))


@query(
    "g7_rate_limit",
    "WITH a AS (SELECT event_id, user_id AS chat_id, ts, epoch_us(ts) // 3600000000 AS bucket, epoch_us(ts) // 1000 AS ms FROM events), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY bucket, chat_id ORDER BY ts, event_id) AS crn FROM a), "
    "c AS (SELECT *, CASE WHEN crn <= 1 THEN count(*) FILTER (crn <= 1) OVER (PARTITION BY bucket ORDER BY ts, event_id) END AS grn FROM b), "
    "e AS (SELECT *, coalesce(grn <= 10, false) AS allowed FROM c), "
    "f AS (SELECT *, coalesce(sum(CASE WHEN allowed THEN 1 ELSE 0 END) OVER (PARTITION BY bucket ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e) "
    "SELECT event_id, allowed, CASE WHEN NOT allowed THEN CASE WHEN before >= 10 THEN 'global' ELSE 'chat' END END AS scope, "
    "CASE WHEN NOT allowed THEN 3600000 - ms % 3600000 + 25 END AS retry_after_ms FROM f",
)
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    attempts = read_table(spark, d, "events").select("event_id", F.col("user_id").alias("chat_id"), "ts")
    out = notify.rate_limit(attempts, ["ts", "event_id"], global_limit=10, chat_limit=1, window_ms=3_600_000)
    return out.select("event_id", "allowed", "scope", "retry_after_ms")


_CAPTION = (
    "concat('🏠 <b>Новая квартира найдена</b>', chr(10), chr(10), '📍 ', city, chr(10), '💰 ', coalesce({p}, '—'), ' €', chr(10), '📐 ', coalesce({a}, '—'), ' м²', chr(10), "
    "'🛏 ', coalesce({r}, '—'), ' комнаты', chr(10), chr(10), '🔗 <a href=\"', url, '\">Ссылка на объявление</a>', chr(10), chr(10), 'Источник: ', source_slug)"
).format(p=num_text("price"), a=num_text("area"), r=num_text("rooms"))


@query(
    "g9_payload",
    f"SELECT listing_id, CASE WHEN n_images > 0 THEN 'photo' ELSE 'text' END AS kind, {_CAPTION} AS caption, "
    "CASE WHEN n_images > 0 THEN concat('https://img.example/', image_of, '/1.jpg') END AS photo, url AS button_url FROM live",
)
def payload(spark: SparkSession, d: str) -> DataFrame:
    listings = fr.live(spark, d)
    return notify.render(listings.select("listing_id"), listings)


@query(
    "g10_mark_notified",
    "SELECT state, count(*) AS n FROM (SELECT CASE WHEN state = 'pending' AND (profile_id, listing_id) IN (SELECT (profile_id, listing_id) FROM matched) THEN 'notified' ELSE state END AS state FROM past_matches) GROUP BY state",
)
def mark_notified(spark: SparkSession, d: str) -> DataFrame:
    return notify.mark_notified(fr.past_matches(spark, d), fr.known_matched(spark, d)).groupBy("state").agg(F.count("*").alias("n"))


@query(
    "g11_auto_replies",
    "SELECT m.profile_id, l.source_slug AS channel, 'skipped_no_channel' AS status, trim(p.auto_reply_text) AS body, count(*) AS n, min(concat('seller_reply:', sha256(concat(cast(m.profile_id as varchar), ':', m.listing_id)))) AS first_key "
    "FROM matched m JOIN live l USING (listing_id) JOIN profiles p ON p.profile_id = m.profile_id AND auto_reply_enabled AND length(trim(auto_reply_text)) > 0 "
    "WHERE (m.profile_id, m.listing_id) NOT IN (SELECT (profile_id, listing_id) FROM past_matches) GROUP BY ALL",
)
def auto_replies(spark: SparkSession, d: str) -> DataFrame:
    # Only profiles that want replies are matched, and the channel comes with the listing.
    profiles = A.profiles(spark, d)
    wanting = profiles.join(profiles.filter(match.wants_reply()).select("profile_id"), "profile_id", "left_semi")
    pairs = fr.matched(spark, d, profiles=wanting, carry=("source_slug",))
    known = fr.past_matches(spark, d).select(notify.reply_key(F.col("profile_id").cast("string"), F.col("listing_id")).alias("dedupe_key"))
    out = notify.auto_replies(pairs, A.profiles(spark, d), known)
    return out.groupBy("profile_id", "channel", "status", "body").agg(F.count("*").alias("n"), F.min("dedupe_key").alias("first_key"))


@query(
    "g12_digest",
    "SELECT s.chat_id, time_bucket(INTERVAL 10 MINUTE, n.created_at) AS digest_start, count(*) AS matches, min(n.listing_id) AS first_listing, min(l.price) AS min_price, max(l.price) AS max_price "
    "FROM past_notifications n JOIN subs s USING (subscription_id) JOIN live l ON l.listing_id = n.listing_id GROUP BY ALL",
)
def digest(spark: SparkSession, d: str) -> DataFrame:
    rows = (
        fr.past_notifications(spark, d)
        .join(A.subscriptions(spark, d).select("subscription_id", "chat_id"), "subscription_id")
        .join(fr.live_columns(spark, d, "price"), "listing_id")
    )
    return notify.digest(rows, "created_at")


@query(
    "g13_due_time",
    "SELECT event_id, CASE WHEN hour(ts) >= 22 THEN date_trunc('day', ts) + INTERVAL 31 HOUR WHEN hour(ts) < 7 THEN date_trunc('day', ts) + INTERVAL 7 HOUR ELSE ts END AS due_at FROM events",
)
def due_time(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    return e.select("event_id", notify.due_time(F.col("ts"), 22, 7, F.lit(None).cast("timestamp_ntz")).cast("timestamp_ntz").alias("due_at"))


@query(
    "c19_delivery_keys",
    "SELECT o_orderkey, concat('telegram:', sha256(concat(cast(o_custkey as varchar), ':', cast(o_orderkey as varchar)))) AS delivery_key, "
    "concat('seller_reply:', sha256(concat(cast(o_custkey as varchar), ':', cast(o_orderkey as varchar)))) AS reply_key, "
    "concat('match-', cast(o_orderkey as varchar), '-', CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%dT%H-%M-%S-000Z') ELSE 'created' END) AS job_key FROM orders",
)
def delivery_keys(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    ident = F.col("o_orderkey").cast("string")
    version = F.when(F.col("o_orderstatus") == "F", K.iso_time(F.col("o_orderdate").cast("timestamp")))
    return o.select(
        "o_orderkey",
        K.delivery_key(F.col("o_custkey").cast("string"), ident).alias("delivery_key"),
        K.reply_key(F.col("o_custkey").cast("string"), ident).alias("reply_key"),
        K.job_key("match", ident, F.lit("created"), version).alias("job_key"),
    )
