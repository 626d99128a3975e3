"""Common table expressions of the check queries (standard SQL)."""

from __future__ import annotations

import re

from dwellmatch.plans.adapter import FILTER_SQL, OBSERVATION_SQL, REGIONS

_OBS_COLS = ", ".join(f"{sql} AS {name}" for name, sql in OBSERVATION_SQL.items())
_STATES = ", ".join(f"'{r}'" for r in REGIONS)
_F = {key: (cond, value) for key, _, cond, value in FILTER_SQL}


def _ge(name: str, path: str, lo: str) -> str:
    return f"CASE WHEN {name} < {lo} THEN '{path}: Number must be greater than or equal to {lo}' END"


def _le(name: str, path: str, hi: str) -> str:
    return f"CASE WHEN {name} > {hi} THEN '{path}: Number must be less than or equal to {hi}' END"


_ISSUES = ", ".join(
    [
        _ge("price", "price", "50"),
        _le("price", "price", "50000"),
        _ge("warm_rent", "warmRent", "50"),
        _le("warm_rent", "warmRent", "60000"),
        _ge("area", "area", "5"),
        _le("area", "area", "1000"),
        _ge("rooms", "rooms", "0.5"),
        _le("rooms", "rooms", "20"),
        "CASE WHEN NOT regexp_matches(postal_code, '^[0-9]{5}$') THEN 'postalCode: PLZ must be exactly 5 digits' END",
        _ge("lat", "geo.lat", "47.2"),
        _le("lat", "geo.lat", "55.1"),
        _ge("lng", "geo.lng", "5.8"),
        _le("lng", "geo.lng", "15.1"),
        "CASE WHEN price IS NULL AND warm_rent IS NULL THEN 'price: At least one of price or warmRent is required' END",
    ]
)
_BEFORE = "(PARTITION BY listing_id ORDER BY seen_at, s1, s2, s3, s4)"
_RUNNING = "(PARTITION BY listing_id ORDER BY seen_at, s1, s2, s3, s4 ROWS UNBOUNDED PRECEDING)"
_DIFF = ["url", "title", "price", "warm_rent", "area", "rooms", "city", "bundesland", "postal_code", "attr_text", "geo_text"]
_LAGS = ", ".join(
    f"lag({c}) OVER {_BEFORE} AS p_{c}"
    for c in [*_DIFF, "image_text", "quarantined", "balcony", "elevator", "listing_id"]
)
_CHANGED = " OR ".join(f"{c} IS DISTINCT FROM p_{c}" for c in _DIFF)
_SIGNIFICANT = (
    "(coalesce(price < p_price, false) OR coalesce(warm_rent < p_warm_rent, false) OR "
    + " OR ".join(f"{c} IS DISTINCT FROM p_{c}" for c in ["area", "rooms", "city", "bundesland", "postal_code", "geo_text", "balcony", "elevator"])
    + " OR p_quarantined)"
)

HAVERSINE = (
    "(2*6371.0088*asin(least(1.0, sqrt(sin(radians({la2}-{la1})/2)*sin(radians({la2}-{la1})/2)"
    "+sin(radians({lo2}-{lo1})/2)*sin(radians({lo2}-{lo1})/2)*cos(radians({la1}))*cos(radians({la2}))))))"
)


def haversine(la1: str, lo1: str, la2: str, lo2: str) -> str:
    return HAVERSINE.format(la1=la1, lo1=lo1, la2=la2, lo2=lo2)


def num_text(c: str) -> str:
    """Number text without a trailing '.0'."""
    return f"regexp_replace(cast({c} as varchar), '\\.0$', '')"


CTES = {
    "obs": f"SELECT {_OBS_COLS} FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey "
    "JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "gated": f"SELECT *, list_filter([{_ISSUES}], lambda x: x IS NOT NULL) AS issues FROM obs",
    "latest": "SELECT *, len(issues) = 0 AS ok, concat(source_slug, '|', external_id) AS listing_id FROM ("
    "SELECT *, row_number() OVER (PARTITION BY source_slug, external_id ORDER BY seen_at DESC, s1 DESC, s2 DESC, s3 DESC, s4 DESC) AS rn FROM gated) WHERE rn = 1",
    "live": "SELECT * FROM latest WHERE ok",
    # A quarantined version keeps its fields, loses position and images, gains two attributes.
    "v0": "SELECT source_slug, external_id, concat(source_slug, '|', external_id) AS listing_id, url, title, price, warm_rent, area, rooms, city, bundesland, postal_code, "
    "seen_at, s1, s2, s3, s4, balcony, elevator, len(issues) > 0 AS quarantined, "
    "CASE WHEN len(issues) = 0 THEN concat(cast(lat as varchar), ',', cast(lng as varchar)) END AS geo_text, "
    "CASE WHEN len(issues) = 0 THEN lat END AS lat, CASE WHEN len(issues) = 0 THEN lng END AS lng, "
    "CASE WHEN len(issues) = 0 AND n_images > 0 THEN list_transform(range(1, n_images + 1), lambda i: concat('https://img.example/', image_of, '/', i, '.jpg')) ELSE [] END AS image_urls, "
    "concat('{', CASE WHEN len(issues) > 0 THEN concat('\"_quality_issues\":', cast(to_json(issues) as varchar), ',\"_quarantine\":true,') ELSE '' END, "
    "'\"balcony\":', cast(balcony as varchar), CASE WHEN elevator IS NOT NULL THEN concat(',\"elevator\":', cast(elevator as varchar)) ELSE '' END, '}') AS attr_text FROM gated",
    "v1": "SELECT *, cast(to_json(image_urls) as varchar) AS image_text FROM v0",
    "v2": f"SELECT *, {_LAGS} FROM v1",
    "v3": f"SELECT *, p_listing_id IS NOT NULL AND NOT quarantined AND {_SIGNIFICANT} AS significant, "
    f"CASE WHEN p_listing_id IS NULL THEN 'new' WHEN {_CHANGED} OR image_text <> p_image_text THEN 'updated' ELSE 'touched' END AS outcome FROM v2",
    "v4": "SELECT *, CASE WHEN quarantined THEN 'removed' WHEN p_listing_id IS NULL THEN 'active' WHEN significant THEN 'updated' END AS set_status, "
    "CASE WHEN p_listing_id IS NULL AND NOT quarantined THEN 'created' WHEN significant THEN 'changed' END AS event, "
    "CASE WHEN significant THEN strftime(seen_at, '%Y-%m-%dT%H:%M:%S.000Z') END AS change_version FROM v3",
    "v5": f"SELECT *, last_value(set_status IGNORE NULLS) OVER {_RUNNING} AS status FROM v4",
    "versions": f"SELECT *, lag(status) OVER {_BEFORE} AS prev_status FROM v5",
    "snapshot": "SELECT * EXCLUDE (rn) FROM (SELECT *, min(seen_at) OVER (PARTITION BY listing_id) AS first_seen_at, max(seen_at) OVER (PARTITION BY listing_id) AS last_seen_at, "
    "row_number() OVER (PARTITION BY listing_id ORDER BY seen_at DESC, s1 DESC, s2 DESC, s3 DESC, s4 DESC) AS rn FROM versions) WHERE rn = 1",
    "history": "SELECT listing_id, seen_at AS changed_at, unnest(rows, recursive := true) FROM (SELECT listing_id, seen_at, list_filter(["
    + ", ".join(
        "CASE WHEN {c} IS DISTINCT FROM p_{c} THEN {{'field': '{n}', 'old_value': {o}, 'new_value': {v}}} END".format(
            c=c,
            n={"attr_text": "attributes", "geo_text": "geo"}.get(c, c),
            o=num_text(f"p_{c}") if c in ("price", "warm_rent", "area", "rooms") else f"p_{c}",
            v=num_text(c) if c in ("price", "warm_rent", "area", "rooms") else c,
        )
        for c in _DIFF
    )
    + ", CASE WHEN status IS DISTINCT FROM prev_status THEN {'field': 'status', 'old_value': prev_status, 'new_value': status} END"
    ", CASE WHEN image_text IS DISTINCT FROM p_image_text THEN {'field': 'images', 'old_value': p_image_text, 'new_value': image_text} END"
    "], lambda x: x IS NOT NULL) AS rows FROM versions WHERE outcome = 'updated')",
    "profiles": "SELECT c_custkey AS profile_id, c_custkey % 500 AS user_id, c_acctbal >= 0 AS is_active, c_mktsegment <> 'HOUSEHOLD' AS notify, "
    "c_custkey % 6 = 0 AS auto_reply_enabled, CASE WHEN c_custkey % 12 = 0 THEN '  ' ELSE concat(' Hello from ', c_name) END AS auto_reply_text FROM customer",
    "filters": " UNION ALL ".join(
        f"SELECT c_custkey AS profile_id, {i} AS position, '{key}' AS key, '{op}' AS operator, {value} AS value_json FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE {cond}"
        for i, (key, op, cond, value) in enumerate(FILTER_SQL)
    ),
    "wide": "SELECT c_custkey AS profile_id, c_acctbal >= 0 AS is_active, "
    f"CASE WHEN {_F['city'][0]} THEN n_name END AS f_city, cast(floor(400 + c_acctbal/8) as double) AS f_price, "
    f"CASE WHEN {_F['rooms'][0]} THEN cast(1 + c_custkey % 4 as double) END AS f_rooms, {_F['balcony'][0]} AS f_balcony, "
    f"CASE WHEN {_F['location'][0]} THEN cast(47.5 as double)+cast(c_custkey%75 as double)/10 END AS f_lat, "
    f"CASE WHEN {_F['location'][0]} THEN cast(6 as double)+cast(c_custkey%90 as double)/10 END AS f_lng, "
    f"CASE WHEN {_F['location'][0]} THEN cast(25 + c_custkey % 100 as double) END AS f_radius "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "matched": "SELECT p.profile_id, l.listing_id FROM live l JOIN wide p ON p.is_active AND (p.f_city IS NULL OR l.city = p.f_city) "
    "AND l.price <= p.f_price AND (p.f_rooms IS NULL OR l.rooms >= p.f_rooms) AND (NOT p.f_balcony OR l.balcony) "
    f"AND (p.f_radius IS NULL OR {haversine('l.lat', 'l.lng', 'p.f_lat', 'p.f_lng')} <= p.f_radius)",
    "subs": "SELECT c_custkey AS subscription_id, c_custkey % 500 AS user_id, c_custkey + 100000 AS chat_id, c_custkey % 7 <> 0 AS enabled FROM customer",
    "past_notifications": "SELECT o_orderkey AS notification_id, o_custkey AS subscription_id, l.listing_id, "
    "CASE o_orderstatus WHEN 'F' THEN 'sent' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status, o_orderdate AS created_at "
    "FROM orders JOIN (SELECT DISTINCT external_id, concat(source_slug, '|', external_id) AS listing_id FROM obs) l ON l.external_id = concat(cast(o_orderkey as varchar), '-1')",
    "past_matches": "SELECT DISTINCT o_custkey AS profile_id, concat('src', cast(l_suppkey % 8 as varchar), '|', cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)) AS listing_id, "
    "CASE o_orderstatus WHEN 'F' THEN 'notified' WHEN 'O' THEN 'pending' ELSE 'dismissed' END AS state, o_orderdate AS matched_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "events_now": "SELECT m.profile_id, m.listing_id, v.event, v.change_version, v.seen_at AS at FROM matched m JOIN (SELECT listing_id, event, change_version, seen_at FROM "
    "(SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY seen_at DESC, s1 DESC, s2 DESC, s3 DESC, s4 DESC) AS rn2 FROM versions) WHERE rn2 = 1 AND event IS NOT NULL) v USING (listing_id)",
    "recorded": "SELECT e.*, x.state IS NULL AS is_new, coalesce(x.state, 'pending') AS state, "
    "x.state IS NULL OR e.event = 'changed' OR x.state = 'pending' AS triggers FROM events_now e LEFT JOIN past_matches x USING (profile_id, listing_id)",
    "notify_events": "SELECT r.*, p.user_id FROM recorded r JOIN profiles p USING (profile_id) WHERE r.triggers AND p.notify",
    "eligible": "SELECT * FROM notify_events WHERE CASE WHEN event = 'changed' THEN state <> 'dismissed' ELSE state = 'pending' END",
    "per_user": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, listing_id ORDER BY e1.at, profile_id) AS un FROM eligible e1) WHERE un = 1",
    "fanned": "SELECT u.*, s.subscription_id, s.chat_id FROM per_user u JOIN subs s ON s.user_id = u.user_id AND s.enabled",
    "runs": "SELECT event_id AS run_id, concat('src', cast(user_id % 8 as varchar)) AS source_slug, "
    "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'partial' ELSE 'success' END AS status, "
    "cast(floor(value/10) as bigint) AS items_new, cast(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END as bigint) AS errors, ts AS finished_at FROM events",
}


def with_ctes(body: str) -> str:
    """Prefix the body with the shared CTEs it names, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    if not needed:
        return body
    parts = [f"{n} AS ({CTES[n]})" for n in CTES if n in needed]
    head = "WITH " + ", ".join(parts)
    return f"{head}, {body[5:]}" if body.startswith("WITH ") else f"{head} {body}"
