"""Serving, dashboard and monitoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellmatch.functions.lifecycle import health
from dwellmatch.operators import monitor, profiles, serve, upsert
from dwellmatch.plans import adapter as A
from dwellmatch.plans import frames as fr
from dwellmatch.plans.registry import query
from dwellmatch.session import read_table, scratch
from dwellmatch.sources.registry import SOURCE_KINDS, filter_definitions, source_rows, upsert_by_key

_END = "2001-12-01"
REGISTERED = [k for k, *_ in SOURCE_KINDS]


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    return fr.snapshot(spark, d)


@query(
    "h1_search",
    "SELECT listing_id, price, rooms, area, first_seen_at FROM snapshot WHERE status IN ('active', 'updated') AND city = 'NATION_3' AND price BETWEEN 200 AND 1500 AND rooms >= 2 AND area >= 20 "
    "AND (first_seen_at < timestamp '2000-01-01' OR (first_seen_at = timestamp '2000-01-01' AND listing_id < 'src5')) ORDER BY first_seen_at DESC, listing_id DESC LIMIT 21",
)
def search(spark: SparkSession, d: str) -> DataFrame:
    cursor = (F.lit("2000-01-01").cast("timestamp_ntz"), "src5")
    rows = serve.search_listings(
        _catalogue(spark, d), "NATION_3", price_min=200, price_max=1500, rooms_min=2, area_min=20, cursor=cursor
    )
    return rows.select("listing_id", "price", "rooms", "area", "first_seen_at")


@query(
    "h2_listing_detail",
    "SELECT listing_id, city, price, CASE WHEN len(image_urls) > 0 THEN array_to_string(image_urls, ' ') ELSE '' END AS images FROM snapshot",
)
def listing_detail(spark: SparkSession, d: str) -> DataFrame:
    snap = _catalogue(spark, d)
    images = snap.select("listing_id", F.inline("images"))
    out = serve.listing_detail(snap, images)
    urls = F.array_join(F.transform("images", lambda i: i["url"]), " ")
    return out.select("listing_id", "city", "price", F.coalesce(urls, F.lit("")).alias("images"))


@query(
    "h3_listing_history",
    "SELECT field, old_value, new_value, changed_at FROM history WHERE listing_id = (SELECT max(listing_id) FROM history)",
)
def listing_history(spark: SparkSession, d: str) -> DataFrame:
    rows = upsert.history_rows(fr.versions(spark, d))
    newest = rows.agg(F.max("listing_id")).first()[0]
    return serve.listing_history(rows, newest).select("field", "old_value", "new_value", "changed_at")


@query(
    "h4_profile_matches",
    "SELECT profile_id, listing_id, matched_at, rank, price FROM (SELECT profile_id, listing_id, matched_at, row_number() OVER (PARTITION BY profile_id ORDER BY matched_at DESC, listing_id) AS rank FROM past_matches) JOIN latest USING (listing_id) WHERE rank <= 100",
)
def profile_matches(spark: SparkSession, d: str) -> DataFrame:
    listings = fr.latest(spark, d).select("listing_id", "price")
    return serve.profile_matches(fr.past_matches(spark, d).drop("state"), listings)


@query(
    "h4_profiles_with_filters",
    "SELECT p.profile_id, is_active, coalesce(f.filters, '') AS filters FROM profiles p LEFT JOIN (SELECT profile_id, string_agg(concat(key, ' ', operator, ' ', value_json), '; ' ORDER BY position) AS filters FROM filters GROUP BY profile_id) f ON f.profile_id = p.profile_id",
)
def profiles_with_filters(spark: SparkSession, d: str) -> DataFrame:
    out = serve.profiles_with_filters(A.profiles(spark, d), A.filters(spark, d))
    text = F.array_join(F.transform("filters", lambda f: F.concat_ws(" ", f["key"], f["operator"], f["value_json"])), "; ")
    return out.select("profile_id", "is_active", F.coalesce(text, F.lit("")).alias("filters"))


@query(
    "h5_profile_changes",
    "WITH c AS (SELECT o_custkey AS profile_id, arg_max({'kind': CASE o_orderstatus WHEN 'F' THEN 'update' WHEN 'O' THEN 'toggle' ELSE 'delete' END, 'act': o_orderkey % 2 = 0}, o_orderdate + to_microseconds(o_orderkey)) AS c FROM orders GROUP BY 1) "
    "SELECT p.profile_id, coalesce(c.c.act, p.is_active) AS is_active, coalesce(CASE WHEN c.c.kind = 'update' THEN 1 ELSE f.n END, 0) AS filters FROM profiles p LEFT JOIN c USING (profile_id) "
    "LEFT JOIN (SELECT profile_id, count(*) AS n FROM filters GROUP BY 1) f ON f.profile_id = p.profile_id WHERE coalesce(c.c.kind, '') <> 'delete'",
)
def profile_changes(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "update").when(F.col("o_orderstatus") == "O", "toggle").otherwise("delete")
    changes = o.select(
        F.col("o_custkey").alias("profile_id"),
        (F.col("o_custkey") % 500).alias("user_id"),
        kind.alias("kind"),
        (F.col("o_orderkey") % 2 == 0).alias("is_active"),
        F.struct("o_orderdate", "o_orderkey").alias("at"),
    )
    new_filters = A.filters(spark, d).filter("key = 'price'")
    after, rows = profiles.apply_profile_changes(A.profiles(spark, d), A.filters(spark, d), changes, new_filters)
    n = rows.groupBy("profile_id").agg(F.count("*").alias("filters"))
    return after.join(n, "profile_id", "left").select("profile_id", "is_active", F.coalesce("filters", F.lit(0)).alias("filters"))


@query(
    "h6_notification_history",
    "SELECT user_id, notification_id, status, rank, price FROM (SELECT s.user_id, n.notification_id, n.status, n.listing_id, row_number() OVER (PARTITION BY s.user_id ORDER BY n.created_at DESC, n.notification_id, n.listing_id) AS rank "
    "FROM past_notifications n JOIN subs s USING (subscription_id)) JOIN latest USING (listing_id) WHERE rank <= 50",
)
def notification_history(spark: SparkSession, d: str) -> DataFrame:
    rows = serve.notification_history(
        fr.past_notifications(spark, d), A.subscriptions(spark, d), fr.latest(spark, d).select("listing_id", "price")
    )
    return rows.select("user_id", "notification_id", "status", "rank", "price")


def _users(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lower("c_name"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example")).alias("email"),
        F.when(F.col("c_acctbal") < 0, "deleted").otherwise("active").alias("status"),
        F.col("c_acctbal").alias("created_at"),
    )


@query(
    "h7_system_totals",
    "SELECT 'users' AS name, count(*) AS n FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'active_profiles', count(*) FROM profiles WHERE is_active UNION ALL SELECT 'listings', count(*) FROM latest "
    "UNION ALL SELECT 'matches', count(*) FROM past_matches UNION ALL SELECT 'sent_notifications', count(*) FROM past_notifications WHERE status = 'sent'",
)
def system_totals(spark: SparkSession, d: str) -> DataFrame:
    return serve.system_totals(
        _users(spark, d), A.profiles(spark, d), fr.latest(spark, d), fr.past_matches(spark, d), fr.past_notifications(spark, d)
    )


_SOURCE_CONFIG = (
    "concat('{\"lifecycleStatus\":\"', CASE s % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'beta' WHEN 2 THEN 'blocked' ELSE 'odd' END, '\",\"activationApproved\":', CASE WHEN s % 2 = 0 THEN 'true' ELSE 'false' END, ',\"options\":{\"activationApproved\":true}}')"
)


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """The sources behind the listings: one per supplier group."""
    s = read_table(spark, d, "supplier").select((F.col("s_suppkey") % 8).alias("s")).distinct()
    return s.select(
        F.concat(F.lit("src"), F.col("s").cast("string")).alias("slug"),
        F.when(F.col("s") == 7, "unknown").otherwise("marketplace").alias("kind"),
        (F.col("s") != 3).alias("is_active"),
        (F.col("s") * 2).cast("int").alias("rate_limit_rpm"),
        F.when(F.col("s") == 1, "open").when(F.col("s") == 2, "half_open").otherwise("closed").alias("breaker_state"),
        F.expr(_SOURCE_CONFIG).alias("config"),
    )


_LIFE = "CASE WHEN s % 4 = 0 THEN 'ready' WHEN s % 4 = 1 THEN 'beta' WHEN s % 4 = 2 THEN 'blocked' ELSE 'permission-needed' END"
_REASONS = (
    "array_to_string(list_filter([CASE WHEN s = 7 THEN 'No connector registered for source slug \"src7\"' END, "
    f"CASE WHEN s % 4 >= 2 THEN concat('Source lifecycle status \"', {_LIFE}, '\" blocks activation') END, "
    f"CASE WHEN s % 2 <> 0 THEN concat('Source activationApproved must be true for lifecycle status \"', {_LIFE}, '\"') END], lambda x: x IS NOT NULL), '; ')"
)


@query(
    "h8_source_dashboard",
    "WITH s AS (SELECT DISTINCT s_suppkey % 8 AS s FROM supplier), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_slug ORDER BY finished_at DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1), "
    "n AS (SELECT source_slug, count(*) AS listings FROM latest GROUP BY 1) "
    f"SELECT concat('src', cast(s as varchar)) AS source_slug, coalesce(listings, 0) AS listings, r.status AS last_run_status, coalesce(r.items_new, 0) AS items_new, coalesce(r.errors, 0) AS errors, r.finished_at, {_LIFE} AS lifecycle_status, {_REASONS} = '' AS activatable, {_REASONS} AS reasons, "
    "CASE WHEN s = 3 THEN 'paused' WHEN s = 1 THEN 'failing' WHEN s = 2 THEN 'degraded' WHEN r.status IS NULL THEN 'unknown' WHEN r.status = 'failed' THEN 'failing' WHEN r.status = 'partial' OR r.errors > 0 THEN 'degraded' ELSE 'healthy' END AS health "
    "FROM s LEFT JOIN r ON r.source_slug = concat('src', cast(s as varchar)) LEFT JOIN n ON n.source_slug = concat('src', cast(s as varchar))",
)
def source_dashboard(spark: SparkSession, d: str) -> DataFrame:
    out = serve.source_dashboard(_sources(spark, d), fr.latest(spark, d), A.source_runs(spark, d), REGISTERED)
    return out.withColumn("reasons", F.array_join("reasons", "; ")).drop("is_active")


@query(
    "h16_activation_list",
    f"SELECT concat('src', cast(s as varchar)) AS slug, {_LIFE} AS lifecycle_status, {_REASONS} = '' AS activatable, {_REASONS} AS reasons FROM (SELECT DISTINCT s_suppkey % 8 AS s FROM supplier)",
)
def activation_list(spark: SparkSession, d: str) -> DataFrame:
    return serve.activation_list(_sources(spark, d), REGISTERED).withColumn("reasons", F.array_join("reasons", "; "))


@query(
    "a11_source_upsert",
    "SELECT DISTINCT concat('src', cast(s_suppkey % 8 as varchar)) AS slug, 'listing' AS origin FROM supplier UNION ALL "
    "SELECT unnest(['synthetic', 'marketplace', 'portal_html', 'portal_api', 'aggregator', 'landlord', 'shared_flats', 'exchange']), 'seed'",
)
def source_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Seeding twice over the listing sources leaves each slug once."""
    stored = _sources(spark, d).withColumn("origin", F.lit("listing")).select("slug", "origin")
    seed = source_rows(spark).select("slug", F.lit("seed").alias("origin"))
    return upsert_by_key(upsert_by_key(stored, seed, "slug"), seed, "slug")


@query(
    "h9_user_search",
    "SELECT c_custkey AS user_id, concat(lower(c_name), '@', lower(c_mktsegment), '.example') AS email FROM customer WHERE lower(c_name) || '@' || lower(c_mktsegment) LIKE '%7@b%' ORDER BY c_acctbal DESC, c_custkey LIMIT 200",
)
def user_search(spark: SparkSession, d: str) -> DataFrame:
    return serve.search_users(_users(spark, d), "7@B").select("user_id", "email")


@query(
    "h10_runs_of_source",
    "SELECT source_slug, run_id, status, items_new, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_slug ORDER BY finished_at DESC, run_id DESC) AS rank FROM runs) WHERE rank <= 50",
)
def runs_of_source(spark: SparkSession, d: str) -> DataFrame:
    return serve.runs_of_source(A.source_runs(spark, d)).select("source_slug", "run_id", "status", "items_new", "rank")


@query(
    "h11_audit_log",
    "SELECT o_orderkey AS audit_id, o_orderpriority AS action, concat(lower(c_name), '@', lower(c_mktsegment), '.example') AS email FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 500) LEFT JOIN customer ON c_custkey = o_custkey",
)
def audit_log(spark: SparkSession, d: str) -> DataFrame:
    log = read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("audit_id"), F.col("o_custkey").alias("actor_id"), F.col("o_orderpriority").alias("action"), F.col("o_orderdate").alias("at")
    )
    return serve.audit_log(log, _users(spark, d)).select("audit_id", "action", "email")


@query(
    "h12_queue_counts",
    "WITH q AS (SELECT concat('queue', cast(user_id % 5 as varchar)) AS queue, CASE event_id % 5 WHEN 0 THEN 'waiting' WHEN 1 THEN 'active' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'delayed' END AS status FROM events) "
    "SELECT queue, count(*) FILTER (status = 'waiting') AS waiting, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'delayed') AS delayed, count(*) FILTER (status = 'waiting') AS depth FROM q GROUP BY queue",
)
def queue_counts(spark: SparkSession, d: str) -> DataFrame:
    states = F.array(*[F.lit(s) for s in serve.QUEUE_STATES])
    audit = read_table(spark, d, "events").select(
        F.concat(F.lit("queue"), (F.col("user_id") % 5).cast("string")).alias("queue"),
        F.element_at(states, (F.col("event_id") % 5 + 1).cast("int")).alias("status"),
    )
    return serve.queue_counts(audit)


@query(
    "h13_personal_export",
    "WITH m AS (SELECT pm.*, p.user_id, row_number() OVER (PARTITION BY p.user_id ORDER BY matched_at DESC, pm.profile_id, listing_id) AS rn FROM past_matches pm JOIN profiles p ON p.profile_id = pm.profile_id) "
    "SELECT c_custkey AS user_id, 'account' AS section, count(*) AS items FROM customer GROUP BY 1 UNION ALL SELECT user_id, 'profile', count(*) FROM profiles GROUP BY 1 "
    "UNION ALL SELECT user_id, 'subscription', count(*) FROM subs GROUP BY 1 UNION ALL SELECT user_id, 'match', count(*) FROM m GROUP BY 1",
)
def personal_export(spark: SparkSession, d: str) -> DataFrame:
    rows = serve.personal_export(
        _users(spark, d), A.profiles(spark, d), A.filters(spark, d), A.subscriptions(spark, d), fr.past_matches(spark, d)
    )
    return rows.groupBy("user_id", "section").agg(F.count("item").alias("items"))


@query(
    "h14_erasure",
    "WITH e AS (SELECT DISTINCT o_custkey AS user_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') "
    "SELECT 'deleted users' AS name, count(*) AS n FROM customer WHERE c_acctbal < 0 OR c_custkey IN (SELECT user_id FROM e) "
    "UNION ALL SELECT 'active profiles', count(*) FROM profiles WHERE is_active AND user_id NOT IN (SELECT user_id FROM e) "
    "UNION ALL SELECT 'audit rows', count(*) FROM customer WHERE c_custkey IN (SELECT user_id FROM e) "
    "UNION ALL SELECT 'kept subscriptions', count(*) FROM subs WHERE user_id NOT IN (SELECT user_id FROM e)",
)
def erasure(spark: SparkSession, d: str) -> DataFrame:
    ask = read_table(spark, d, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"))
    users, profs, audit = serve.erase_users(_users(spark, d), A.profiles(spark, d), ask)
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return (
        one("deleted users", users.filter("status = 'deleted'"))
        .unionByName(one("active profiles", profs.filter("is_active")))
        .unionByName(one("audit rows", audit))
        .unionByName(one("kept subscriptions", serve.purge(A.subscriptions(spark, d), ask)))
    )


@query(
    "h15_radius_rewrite",
    "SELECT profile_id, f_radius AS before, cast(10 as double) AS after, f_lat AS lat FROM wide WHERE f_radius IS NOT NULL",
)
def radius_rewrite(spark: SparkSession, d: str) -> DataFrame:
    preview, after = profiles.set_radius(A.filters(spark, d), filter_definitions(spark), 10)
    get = lambda n: F.get_json_object("value_json", f"$.{n}").cast("double")
    now = after.filter("operator = 'within'").select("profile_id", get("radius_km").alias("after"), get("lat").alias("lat"))
    return preview.select("profile_id", F.col("current_radius_km").cast("double").alias("before")).join(now, "profile_id")


@query("h17_city_overview", "SELECT city, count(*) AS listings, min(title) AS sample_title FROM live GROUP BY city")
def city_overview(spark: SparkSession, d: str) -> DataFrame:
    return serve.city_overview(fr.live(spark, d))


@query(
    "h19_subscription_state",
    "WITH c AS (SELECT user_id % 500 AS user_id, user_id + 100000 AS chat_id, event_id, ts, CASE event_id % 4 WHEN 0 THEN 'link' WHEN 1 THEN 'pause' WHEN 2 THEN 'resume' ELSE 'stop' END AS cmd FROM events) "
    "SELECT user_id, chat_id, arg_max(cmd IN ('link', 'resume'), ts + to_microseconds(event_id % 1)) AS enabled, min(ts) FILTER (cmd = 'link') AS linked_at FROM c GROUP BY ALL",
)
def subscription_state(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(F.lit("link"), F.lit("pause"), F.lit("resume"), F.lit("stop"))
    log = read_table(spark, d, "events").select(
        (F.col("user_id") % 500).alias("user_id"),
        (F.col("user_id") + 100000).alias("chat_id"),
        F.col("event_id").alias("command_id"),
        F.col("ts").alias("at"),
        F.element_at(words, (F.col("event_id") % 4 + 1).cast("int")).alias("command"),
    )
    return serve.subscription_state(log)


@query(
    "h20_filter_metadata",
    "SELECT key, count(*) AS uses, CASE key WHEN 'city' THEN 'Stadt' WHEN 'price' THEN 'Preis' WHEN 'rooms' THEN 'Zimmer' WHEN 'balcony' THEN 'Balkon' ELSE 'Umkreis' END AS label FROM filters GROUP BY key",
)
def filter_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the filters in use, in a locale without own labels."""
    uses = A.filters(spark, d).groupBy("key").agg(F.count("*").alias("uses"))
    return serve.filter_metadata(filter_definitions(spark), "fr").join(uses, "key").select("key", "uses", "label")


@query(
    "h21_similar_titles",
    "WITH t AS (SELECT title, count(*) AS listings FROM live GROUP BY title), g AS (SELECT title, listings, list_distinct(list_transform(range(1, len(title) + 2), lambda i: substr('  ' || lower(title) || ' ', i, 3))) AS a, "
    "list_distinct(list_transform(range(1, len('red widget') + 2), lambda i: substr('  red widget ', i, 3))) AS b FROM t) "
    "SELECT title, listings, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS similarity FROM g WHERE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) >= 0.3",
)
def similar_titles(spark: SparkSession, d: str) -> DataFrame:
    return serve.similar_titles(fr.live(spark, d), "red widget")


_PAGE_TITLE = "nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '')"
_GRAMS = "list_distinct(list_transform(range(1, len({0}) + 2), lambda i: substr('  ' || lower({0}) || ' ', i, 3)))"


@query(
    "h21_title_index",
    f"WITH p AS (SELECT page_id, {_PAGE_TITLE} AS title FROM pages), t AS (SELECT title, count(*) AS listings FROM p WHERE title IS NOT NULL GROUP BY title), "
    f"a AS (SELECT title, listings, {_GRAMS.format('title')} AS g FROM t), q AS (SELECT page_id AS query_id, {_GRAMS.format('title')} AS w FROM p WHERE page_id % 50 = 0 AND title IS NOT NULL), "
    "b AS (SELECT query_id, title, listings, len(list_intersect(g, w)) AS n, len(g) + len(w) AS m FROM q, a) "
    "SELECT query_id, title, listings, n / (m - n) AS similarity FROM b WHERE n / (m - n) >= 0.3",
)
def title_index(spark: SparkSession, d: str) -> DataFrame:
    """Titles of all pages, searched for those of every fiftieth page."""
    titles = read_table(spark, d, "pages").select("page_id", F.expr(_PAGE_TITLE).alias("title"))
    index = serve.TitleIndex(spark, scratch(spark, "h21"))
    index.build(titles)
    return index.search(titles.filter("page_id % 50 = 0").select(F.col("page_id").alias("query_id"), F.col("title").alias("text")))


@query(
    "h22_current_consents",
    "WITH c AS (SELECT user_id, concat('type', cast(event_id % 3 as varchar)) AS consent_type, event_id % 2 = 0 AS granted, ts, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts DESC, event_id DESC) AS rn FROM events) "
    "SELECT user_id, consent_type, granted, ts AS recorded_at FROM c WHERE rn = 1",
)
def current_consents(spark: SparkSession, d: str) -> DataFrame:
    log = read_table(spark, d, "events").select(
        "user_id",
        F.concat(F.lit("type"), (F.col("event_id") % 3).cast("string")).alias("consent_type"),
        (F.col("event_id") % 2 == 0).alias("granted"),
        F.col("ts").alias("recorded_at"),
        F.col("event_id").alias("consent_id"),
    )
    return serve.current_consents(log)


@query(
    "b17_search_areas",
    "WITH a AS (SELECT profile_id, f_city AS location, floor(f_radius + 0.5) AS radius_km, CASE WHEN f_price >= 50 THEN least(f_price, 50000) END AS max_price, f_lat AS lat, f_lng AS lng FROM wide WHERE is_active AND f_city IS NOT NULL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY lower(location), radius_km, max_price ORDER BY profile_id) AS rn FROM a) "
    "SELECT profile_id, location, radius_km, max_price, lat, lng FROM r WHERE rn = 1",
)
def search_areas(spark: SparkSession, d: str) -> DataFrame:
    return profiles.derive_search_areas(A.profiles(spark, d), A.filters(spark, d))


@query(
    "i1_run_totals",
    "SELECT source_slug, status, count(*) AS runs, sum(errors) AS errors, sum(items_new) AS items_new FROM runs GROUP BY ALL",
)
def run_totals(spark: SparkSession, d: str) -> DataFrame:
    return monitor.run_totals(A.source_runs(spark, d))


@query(
    "i1_run_gauges",
    "SELECT source_slug, arg_max(items_new, finished_at) AS last_items_new, max(finished_at) FILTER (status = 'success') AS last_success_at FROM runs GROUP BY source_slug",
)
def run_gauges(spark: SparkSession, d: str) -> DataFrame:
    return monitor.run_gauges(A.source_runs(spark, d))


@query(
    "i2_error_alerts",
    "WITH w AS (SELECT source_slug, unnest([time_bucket(INTERVAL 5 MINUTE, finished_at), time_bucket(INTERVAL 5 MINUTE, finished_at) - INTERVAL 5 MINUTE, time_bucket(INTERVAL 5 MINUTE, finished_at) - INTERVAL 10 MINUTE]) AS window_start, errors FROM runs) "
    "SELECT source_slug, window_start, sum(errors) AS errors FROM w GROUP BY ALL HAVING sum(errors) > 0",
)
def error_alerts(spark: SparkSession, d: str) -> DataFrame:
    return monitor.error_alerts(A.source_runs(spark, d))


@query(
    "i3_stalled_sources",
    "SELECT source_slug, age_seconds FROM (SELECT source_slug, (SELECT cast(floor(epoch(max(finished_at))) as bigint) FROM runs) - cast(floor(epoch(max(finished_at) FILTER (status = 'success'))) as bigint) AS age_seconds FROM runs GROUP BY source_slug) WHERE age_seconds > 900",
)
def stalled_sources(spark: SparkSession, d: str) -> DataFrame:
    runs = A.source_runs(spark, d)
    as_of = F.lit(runs.agg(F.max("finished_at")).first()[0]).cast("timestamp_ntz")
    return monitor.stalled_sources(runs, as_of).select("source_slug", "age_seconds")


_ITEMS = (
    "WITH b AS (SELECT source_slug, cast(floor(epoch(finished_at) / {w}) as bigint) AS slot, items_new FROM runs), "
    "spine AS (SELECT source_slug, unnest(range((SELECT min(slot) FROM b), (SELECT max(slot) FROM b) + 1)) AS slot FROM (SELECT DISTINCT source_slug FROM b)), "
    "i AS (SELECT source_slug, make_timestamp(slot * {w} * 1000000) AS window_start, coalesce(sum(items_new), 0) AS items_new FROM spine LEFT JOIN b USING (source_slug, slot) GROUP BY source_slug, slot) "
)


@query("i4_silent_windows", _ITEMS.format(w=3600) + "SELECT source_slug, window_start FROM i WHERE items_new = 0")
def silent_windows(spark: SparkSession, d: str) -> DataFrame:
    out = monitor.silent_windows(A.source_runs(spark, d))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "i5_stall_transitions",
    _ITEMS.format(w=5400)
    + ", s AS (SELECT *, items_new = 0 AS stalled, lag(items_new = 0) OVER (PARTITION BY source_slug ORDER BY window_start) AS before FROM i) "
    "SELECT source_slug, window_start, CASE WHEN stalled THEN 'stalled' ELSE 'recovered' END AS state FROM s WHERE stalled <> coalesce(before, false)",
)
def stall_transitions(spark: SparkSession, d: str) -> DataFrame:
    out = monitor.stall_transitions(A.source_runs(spark, d))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "i6_tick_outcomes",
    "WITH t AS (SELECT concat('src', cast(user_id % 8 as varchar)) AS source_slug, user_id % 8 AS s, event_id AS seq, ts, floor(epoch(ts) / 3600) AS slot FROM events), "
    "j AS (SELECT concat('src', cast(user_id % 8 as varchar)) AS source_slug, ts AS started, ts + INTERVAL 10 MINUTE AS finished FROM events WHERE event_type = 'purchase'), "
    "b AS (SELECT t.*, EXISTS (SELECT 1 FROM j WHERE j.source_slug = t.source_slug AND t.ts > j.started AND t.ts < j.finished) AS busy FROM t), "
    "r AS (SELECT *, CASE WHEN s = 3 THEN 'skipped_inactive' WHEN busy THEN 'duplicate_active' END AS o FROM b), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY source_slug, slot, o IS NULL ORDER BY ts, seq) AS rn FROM r) "
    "SELECT source_slug, seq, coalesce(o, CASE WHEN rn <= s * 2 THEN 'queued' ELSE 'rate_limited' END) AS outcome FROM n",
)
def tick_outcomes(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    slug = F.concat(F.lit("src"), (F.col("user_id") % 8).cast("string")).alias("source_slug")
    ticks = e.select(slug, "ts", F.col("event_id").alias("seq"))
    running = e.filter("event_type = 'purchase'").select(
        slug, F.col("ts").alias("started"), (F.col("ts") + F.expr("interval 10 minutes")).alias("finished")
    )
    return monitor.classify_ticks(ticks, _sources(spark, d), running, window_seconds=3600).select("source_slug", "seq", "outcome")


@query(
    "i7_daily_stats",
    "SELECT source_slug, date_trunc('day', finished_at) AS day, count(*) AS runs, sum(items_new) AS items_new, count(*) FILTER (status = 'success') / count(*) AS success_rate, sum(errors) / count(*) AS error_rate FROM runs GROUP BY ALL",
)
def daily_stats(spark: SparkSession, d: str) -> DataFrame:
    out = monitor.daily_source_stats(A.source_runs(spark, d))
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query(
    "i8_latency",
    "WITH s AS (SELECT (event_id * 7919 % 400000) / 1000 AS s FROM events) SELECT count(*) AS deliveries, quantile_cont(s, 0.5) AS p50, quantile_cont(s, 0.95) AS p95, quantile_cont(s, 0.99) AS p99, count(*) FILTER (s > 60) AS over_60s, count(*) FILTER (s > 300) AS over_300s FROM s",
)
def latency(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("found_at"), "event_id")
    sent = F.timestamp_micros(F.unix_micros("found_at") + (F.col("event_id") * 7919 % 400000) * 1000)
    return monitor.latency_report(e.withColumn("sent_at", sent), "found_at", "sent_at")


@query(
    "c24_health_labels",
    "SELECT CASE WHEN event_id % 11 = 0 THEN 'paused' WHEN event_id % 7 = 0 THEN 'failing' WHEN event_id % 7 = 1 THEN 'degraded' WHEN status = 'failed' THEN 'failing' WHEN status = 'partial' OR errors > 0 THEN 'degraded' ELSE 'healthy' END AS health, count(*) AS n FROM (SELECT run_id AS event_id, status, errors FROM runs) GROUP BY ALL",
)
def health_labels(spark: SparkSession, d: str) -> DataFrame:
    breaker = F.when(F.col("run_id") % 7 == 0, "open").when(F.col("run_id") % 7 == 1, "half_open").otherwise("closed")
    label = health(F.col("run_id") % 11 != 0, breaker, F.col("status"), F.col("errors"))
    return A.source_runs(spark, d).groupBy(label.alias("health")).agg(F.count("*").alias("n"))


_ARGS = {
    "city": "CASE WHEN c_custkey % 7 = 0 THEN '   ' WHEN c_custkey % 7 > 1 THEN concat(' ', c_mktsegment) END",
    "price_max": "CASE WHEN c_custkey % 4 > 0 THEN cast((c_custkey * 37) % 9000 as string) END",
    "price_min": "CASE WHEN c_custkey % 3 > 0 THEN cast(cast(floor(c_acctbal) as bigint) as string) END",
    "rooms_min": "CASE WHEN c_custkey % 5 = 0 THEN 'many' WHEN c_custkey % 5 = 1 THEN ' 2.5 ' WHEN c_custkey % 5 = 2 THEN '' END",
    "area_min": "CASE WHEN c_custkey % 13 = 0 THEN '1e999' WHEN c_custkey % 13 = 1 THEN '.5e2' END",
    "limit": "CASE WHEN c_custkey % 3 = 0 THEN cast(c_custkey % 130 - 10 as string) WHEN c_custkey % 17 = 1 THEN '2.5' END",
    "cursor": "CASE WHEN c_custkey % 11 = 0 THEN 'next' WHEN c_custkey % 11 = 1 THEN '00000000-0000-4000-8000-00000000000A' END",
}
_N = "CASE WHEN trim({0}) = '' THEN 0 WHEN {0} IS NOT NULL THEN coalesce(try_cast(trim({0}) as double), 'nan'::double) END"


@query(
    "d11_search_args",
    "WITH a AS (SELECT c_custkey AS request_id, " + ", ".join(f'{sql} AS "{n}"' for n, sql in _ARGS.items()) + " FROM customer), "
    "b AS (SELECT request_id, trim(city) AS city, cursor, " + ", ".join(f"{_N.format(n)} AS {n}" for n in ("price_max", "price_min", "rooms_min", "area_min")) + f", coalesce({_N.format('a.limit')}, 20) AS l FROM a), "
    "c AS (SELECT *, concat(CASE WHEN length(city) NOT BETWEEN 1 AND 200 THEN 'city;' ELSE '' END, "
    + ", ".join(f"CASE WHEN isnan({n}) OR isinf({n}) OR {n} < 0 THEN '{n};' ELSE '' END" for n in ("price_max", "price_min", "rooms_min", "area_min"))
    + ", CASE WHEN isnan(l) OR l <> floor(l) OR l < 1 OR l > 100 THEN 'limit;' ELSE '' END, CASE WHEN cursor = 'next' THEN 'cursor;' ELSE '' END) AS e FROM b), "
    "d AS (SELECT *, CASE WHEN e = '' AND price_min > price_max THEN 'price_min > price_max;' ELSE e END AS errors FROM c) "
    "SELECT request_id, errors, CASE WHEN errors = '' THEN l::INT END AS page_size FROM d",
)
def search_args(spark: SparkSession, d: str) -> DataFrame:
    """Accepted and refused search requests."""
    logged = read_table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), *[F.expr(sql).alias(n) for n, sql in _ARGS.items()])
    checked = serve.checked_search_args(logged)
    errors = F.concat_ws("", F.transform("errors", lambda e: F.concat(e, F.lit(";"))))
    return checked.select("request_id", errors.alias("errors"), F.col("limit").alias("page_size"))
