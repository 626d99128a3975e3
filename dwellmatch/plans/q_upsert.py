"""Quality gate, saved-search validation and upsert queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellmatch.functions.keys import fingerprint
from dwellmatch.operators import monitor, profiles, quality, upsert
from dwellmatch.operators.skew import latest_per_key
from dwellmatch.plans import adapter as A
from dwellmatch.plans import frames as fr
from dwellmatch.plans.registry import query
from dwellmatch.session import read_table, scratch
from dwellmatch.sources import postal
from dwellmatch.sources.registry import filter_definitions


@query("d1_gate_issues", "SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM gated) GROUP BY issue")
def gate_issues(spark: SparkSession, d: str) -> DataFrame:
    return quality.issue_counts(fr.gated(spark, d))


@query(
    "d2_gate_split",
    "SELECT source_slug, len(issues) = 0 AS ok, count(*) AS n, sum(price) AS price FROM gated GROUP BY ALL",
)
def gate_split(spark: SparkSession, d: str) -> DataFrame:
    valid, rejected = quality.split_gate(fr.gated(spark, d))
    count = lambda df, ok: df.groupBy("source_slug").agg(
        F.lit(ok).alias("ok"), F.count("*").alias("n"), F.sum("price").alias("price")
    )
    return count(valid, True).unionByName(count(rejected, False))


@query(
    "d3_quarantine_rows",
    "SELECT listing_id, seen_at, price, area, city, attr_text, lat, lng FROM v0 WHERE quarantined",
)
def quarantine(spark: SparkSession, d: str) -> DataFrame:
    _, rejected = quality.split_gate(fr.gated(spark, d).withColumn("raw", F.to_json(F.struct("price", "area"))))
    rows = quality.quarantine_rows(rejected)
    return rows.select(
        fr.listing_key().alias("listing_id"), "seen_at", "price", "area", "city",
        upsert.canonical_json(F.col("attributes")).alias("attr_text"), "lat", "lng",
    )


@query(
    "d4_map_failures",
    "SELECT source_slug, count(*) AS failed FROM obs WHERE s3 = 13 GROUP BY source_slug",
)
def map_failures(spark: SparkSession, d: str) -> DataFrame:
    rows = A.observations(spark, d).withColumn("map_error", F.when(F.col("s3") == 13, F.lit("unreadable")))
    failed = quality.quality_gate(rows, A.REGIONS).filter(F.array_contains("issues", "map failed: unreadable"))
    return failed.groupBy("source_slug").agg(F.count("*").alias("failed"))


# Filter rows with known faults: customer → (key, operator, JSON value).
_FAULTY = [
    ("price", "lte", "cast(cast(floor(c_acctbal) as bigint) as string)"),
    ("price", "gte", "'800'"),
    ("rooms", "eq", "'2'"),
    ("colour", "eq", "'1'"),
    ("bundesland", "eq", "concat('\"', c_mktsegment, '\"')"),
    ("balcony", "eq", "CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE '\"true\"' END"),
    ("city", "in", "CASE WHEN c_custkey % 3 = 0 THEN '[]' ELSE '[\"A\",\" \"]' END"),
    ("location", "within", "concat('{\"lat\":', cast(c_custkey % 120 as string), ',\"lng\":10,\"radius_km\":', cast(c_custkey % 5 - 1 as string), '}')"),
]
_STATES_TEXT = (
    "Baden-Württemberg, Bayern, Berlin, Brandenburg, Bremen, Hamburg, Hessen, Mecklenburg-Vorpommern, Niedersachsen, "
    "Nordrhein-Westfalen, Rheinland-Pfalz, Saarland, Sachsen, Sachsen-Anhalt, Schleswig-Holstein, Thüringen"
)


def _faulty_filters(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(k).alias("key"), F.lit(o).alias("operator"), F.expr(v).alias("value_json"))
            for i, (k, o, v) in enumerate(_FAULTY)
        ]
    )
    return read_table(spark, d, "customer").select(F.col("c_custkey").alias("profile_id"), F.inline(rows))


@query(
    "d5_filter_validation",
    "WITH c AS (SELECT c_custkey AS profile_id, cast(floor(c_acctbal) as bigint) AS p, c_mktsegment AS seg FROM customer) "
    "SELECT profile_id, 'filters[0].value' AS field, 'must be >= 0' AS issue FROM c WHERE p < 0 "
    "UNION ALL SELECT profile_id, 'price', 'gte must be <= lte' FROM c WHERE p >= 0 AND p < 800 "
    "UNION ALL SELECT profile_id, 'filters[2].operator', 'operator is not allowed for this filter' FROM c "
    "UNION ALL SELECT profile_id, 'filters[3].key', 'unknown filter key' FROM c "
    f"UNION ALL SELECT profile_id, 'filters[4].value', 'must be one of: {_STATES_TEXT}' FROM c "
    "UNION ALL SELECT profile_id, 'filters[5].value', 'must be a boolean' FROM c WHERE profile_id % 2 <> 0 "
    "UNION ALL SELECT profile_id, CASE WHEN profile_id % 3 = 0 THEN 'filters[6].value' ELSE 'filters[6].value[1]' END, "
    "CASE WHEN profile_id % 3 = 0 THEN 'must be a non-empty array' ELSE 'must be a non-empty string' END FROM c "
    "UNION ALL SELECT profile_id, 'filters[7].value.lat', 'must be <= 90' FROM c WHERE profile_id % 120 > 90 "
    "UNION ALL SELECT profile_id, 'filters[7].value.radius_km', CASE WHEN profile_id % 5 = 0 THEN 'must be >= 0' ELSE 'must be > 0' END FROM c WHERE profile_id % 5 < 2",
)
def filter_validation(spark: SparkSession, d: str) -> DataFrame:
    return profiles.validate_filters(_faulty_filters(spark, d), filter_definitions(spark))


_CRITERIA = (
    "concat('{', array_to_string(list_filter(["
    "CASE WHEN f_balcony THEN '\"attrs\":{\"balcony\":true}' END, "
    "CASE WHEN f_radius IS NOT NULL THEN concat('\"location\":', loc) END, "
    "CASE WHEN f_city IS NOT NULL THEN concat('\"city\":\"', f_city, '\"') END, "
    "concat('\"price\":{\"lte\":', cast(cast(f_price as bigint) as varchar), '}'), "
    "CASE WHEN f_rooms IS NOT NULL THEN concat('\"rooms\":{\"gte\":', cast(cast(f_rooms as bigint) as varchar), '}') END"
    "], lambda x: x IS NOT NULL), ','), '}')"
)


@query(
    "d6_criteria",
    f"SELECT w.profile_id, {_CRITERIA} AS criteria FROM wide w "
    "LEFT JOIN (SELECT profile_id, value_json AS loc FROM filters WHERE key = 'location') l ON l.profile_id = w.profile_id",
)
def criteria(spark: SparkSession, d: str) -> DataFrame:
    return profiles.build_criteria(A.filters(spark, d))


@query(
    "d7_form_values",
    "SELECT profile_id, f_city AS city, f_price AS price_max, f_rooms AS rooms_min, f_lat AS lat, f_lng AS lng, f_radius AS radius_km FROM wide",
)
def form_values(spark: SparkSession, d: str) -> DataFrame:
    return profiles.form_values(profiles.build_criteria(A.filters(spark, d))).select(
        "profile_id", "city", "price_max", "rooms_min", "lat", "lng", "radius_km"
    )


@query("d8_form_filters", "SELECT profile_id, key, operator, value_json FROM filters")
def form_filters(spark: SparkSession, d: str) -> DataFrame:
    cell = F.when(F.col("operator") == "lte", F.concat("key", F.lit("_max"))).when(
        F.col("operator") == "gte", F.concat("key", F.lit("_min"))
    ).otherwise(F.col("key"))
    plain = A.filters(spark, d).filter("operator <> 'within'").select("profile_id", cell.alias("cell"), "value_json")
    circle = A.filters(spark, d).filter("operator = 'within'").select(
        "profile_id",
        F.explode(F.array(*[F.struct(F.lit(n).alias("cell"), F.get_json_object("value_json", f"$.{n}").alias("value_json")) for n in ("lat", "lng", "radius_km")])).alias("x"),
    ).select("profile_id", "x.cell", "x.value_json")
    # A form is at most a few dozen cells.
    forms = plain.unionByName(circle).groupBy("profile_id").agg(
        F.map_from_entries(F.collect_list(F.struct("cell", "value_json"))).alias("values")
    )
    return profiles.filters_from_form(forms, filter_definitions(spark))


@query(
    "d9_postal_location",
    "WITH dim AS (SELECT lpad(cast((s_suppkey*997)%100000 as varchar),5,'0') AS postal_code, min(n_name) AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1), "
    "centre AS (SELECT n_name AS city, cast(n_nationkey + 40 as double) AS lat, cast(n_nationkey as double) AS lng FROM nation WHERE n_nationkey % 2 = 0), "
    "f AS (SELECT c_custkey AS profile_id, lpad(cast((c_custkey*997)%100000 as varchar),5,'0') AS postal_code, "
    "CASE WHEN c_custkey % 3 = 0 THEN 'own' END AS city, CASE WHEN c_custkey % 4 = 0 THEN cast(25 as double) END AS radius_km FROM customer) "
    "SELECT profile_id, coalesce(f.city, dim.city) AS city, centre.lat, centre.lng, "
    "CASE WHEN centre.lat IS NOT NULL THEN coalesce(radius_km, 10) ELSE radius_km END AS radius_km "
    "FROM f LEFT JOIN dim USING (postal_code) LEFT JOIN centre ON centre.city = dim.city",
)
def postal_location(spark: SparkSession, d: str) -> DataFrame:
    nation = read_table(spark, d, "nation")
    dim = read_table(spark, d, "supplier").join(nation, F.expr("s_nationkey = n_nationkey")).groupBy(
        F.expr(A.OBSERVATION_SQL["postal_code"]).alias("postal_code")
    ).agg(F.min("n_name").alias("city"))
    centre = nation.filter("n_nationkey % 2 = 0").select(
        F.col("n_name").alias("city"), (F.col("n_nationkey") + 40).cast("double").alias("lat"), F.col("n_nationkey").cast("double").alias("lng")
    )
    forms = read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("profile_id"),
        F.expr("lpad(cast((c_custkey*997)%100000 as string),5,'0')").alias("postal_code"),
        F.when(F.col("c_custkey") % 3 == 0, "own").alias("city"),
        F.lit(None).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lng"),
        F.when(F.col("c_custkey") % 4 == 0, F.lit(25.0)).alias("radius_km"),
    )
    return postal.fill_location(forms, dim, centre).select("profile_id", "city", "lat", "lng", "radius_km")


@query(
    "d10_plan_limit",
    "WITH u AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 9 = 0 THEN 20 ELSE 3 END AS lim FROM customer), "
    "held AS (SELECT o_custkey AS user_id, count(*) AS held FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), "
    "r AS (SELECT o_custkey AS user_id, o_orderkey AS profile_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders WHERE o_orderstatus <> 'F') "
    "SELECT user_id, profile_id, rank + coalesce(held, 0) <= lim AS admitted FROM r JOIN u USING (user_id) LEFT JOIN held USING (user_id)",
)
def plan_limit(spark: SparkSession, d: str) -> DataFrame:
    orders = read_table(spark, d, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("profile_id"), F.col("o_orderdate").alias("requested_at"), "o_orderstatus"
    )
    users = read_table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 9 == 0, "premium").otherwise("user").alias("role")
    )
    stored, asked = orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus <> 'F'")
    return profiles.admit_profiles(asked.drop("o_orderstatus"), stored, users).select("user_id", "profile_id", "admitted")


@query(
    "e1_fingerprint",
    "SELECT DISTINCT source_slug, external_id, sha256(concat(source_slug, '|', external_id)) AS fingerprint FROM obs",
)
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    ids = A.observations(spark, d).groupBy("source_slug", "external_id").agg(
        *[F.max(c).alias(c) for c in ("postal_code", "area", "rooms", "price", "warm_rent", "title")]
    )
    return ids.select("source_slug", "external_id", fingerprint().alias("fingerprint"))


_CUT = "1998-01-01"


def _written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@query(
    "e2_two_runs",
    f"SELECT CASE WHEN first_seen < timestamp '{_CUT}' THEN listing_id ELSE sha256(listing_id) END AS listing_id, seen_at, s4, outcome, status, event, change_version FROM "
    f"(SELECT *, min(seen_at) OVER (PARTITION BY listing_id) AS first_seen FROM versions) WHERE seen_at >= timestamp '{_CUT}'",
)
def two_runs(spark: SparkSession, d: str) -> DataFrame:
    """Second run on top of the first run's snapshot gives what one serial run gives.

    The ids are the resolver's: a listing of the first run keeps its id there, though a part of the
    rows comes with another external id and is only known by the fingerprint; a new listing takes
    its fingerprint.
    """
    rows = fr.incoming(spark, d).withColumn("fingerprint", F.sha2("listing_id", 256))
    cut = F.lit(_CUT).cast("timestamp_ntz")
    first = upsert.listing_versions(rows.filter(F.col("seen_at") < cut), seq=A.SEQ)
    stored = upsert.snapshot(first, seq=A.SEQ).withColumn("pending_event", F.lit(None).cast("string")).withColumn(
        "pending_version", F.lit(None).cast("string")
    )
    # Read several times below, so made once.
    stored = _written(spark, stored, "e2-stored")
    renamed = F.when(F.col("s3") % 5 == 0, F.concat(F.lit("moved-"), "external_id")).otherwise(F.col("external_id"))
    second = rows.filter(F.col("seen_at") >= cut).drop("listing_id").withColumn("external_id", renamed)
    in_order, _ = upsert.split_late(upsert.resolve_existing(second, stored))
    return upsert.listing_versions(_written(spark, in_order, "e2-in-order"), stored, A.SEQ).select(
        "listing_id", "seen_at", "s4", "outcome", "status", "event", "change_version"
    )


@query(
    "e3_versions",
    "SELECT outcome, quarantined, significant, status, prev_status, event, count(*) AS n, count(change_version) AS versions FROM versions GROUP BY ALL",
)
def version_states(spark: SparkSession, d: str) -> DataFrame:
    return (
        fr.versions(spark, d)
        .groupBy("outcome", "quarantined", "significant", "status", "prev_status", "event")
        .agg(F.count("*").alias("n"), F.count("change_version").alias("versions"))
    )


@query(
    "e4_field_changes",
    "SELECT field, count(*) AS changes, count(old_value) AS with_old, count(new_value) AS with_new FROM history GROUP BY field",
)
def field_changes(spark: SparkSession, d: str) -> DataFrame:
    return upsert.history_rows(fr.versions(spark, d)).groupBy("field").agg(
        F.count("*").alias("changes"), F.count("old_value").alias("with_old"), F.count("new_value").alias("with_new")
    )


@query(
    "e8_snapshot",
    "SELECT listing_id, url, title, price, warm_rent, area, rooms, city, lat, lng, attr_text, len(image_urls) AS images, quarantined, status, first_seen_at, last_seen_at FROM snapshot",
)
def snapshot_rows(spark: SparkSession, d: str) -> DataFrame:
    return fr.snapshot(spark, d).select(
        "listing_id", "url", "title", "price", "warm_rent", "area", "rooms", "city", "lat", "lng",
        upsert.canonical_json(F.col("attributes")).alias("attr_text"), F.size("images").cast("long").alias("images"),
        "quarantined", "status", "first_seen_at", "last_seen_at",
    )


@query("e10_events", "SELECT listing_id, event, change_version, seen_at AS at FROM versions WHERE event IS NOT NULL")
def events(spark: SparkSession, d: str) -> DataFrame:
    return upsert.match_events(fr.versions(spark, d))


@query("e11_history", "SELECT listing_id, field, old_value, new_value, changed_at FROM history")
def history(spark: SparkSession, d: str) -> DataFrame:
    return upsert.history_rows(fr.versions(spark, d))


@query(
    "e12_undelivered",
    "SELECT listing_id, event, change_version FROM versions WHERE event IS NOT NULL AND NOT (event = 'created' AND s3 >= 10)",
)
def undelivered(spark: SparkSession, d: str) -> DataFrame:
    v = fr.versions(spark, d)
    delivered = v.filter("event = 'created' and s3 >= 10").select("listing_id", "event", "change_version")
    return upsert.undelivered(upsert.match_events(v), delivered).select("listing_id", "event", "change_version")


@query(
    "e13_soft_groups",
    "SELECT soft_fingerprint, min(listing_id) AS group_id, count(*) AS listings, count(DISTINCT source_slug) AS sources, count(DISTINCT source_slug) > 1 AS cross_source FROM ("
    "SELECT listing_id, source_slug, sha256(concat(postal_code, '|', cast(cast(floor(area/2+0.5)*2 as bigint) as varchar), '|', "
    "CASE WHEN rooms = floor(rooms) THEN cast(cast(rooms as bigint) as varchar) ELSE cast(rooms as varchar) END, '|', "
    "coalesce(cast(cast(floor(price/50+0.5)*50 as bigint) as varchar), ''))) AS soft_fingerprint FROM live) GROUP BY soft_fingerprint",
)
def soft_groups(spark: SparkSession, d: str) -> DataFrame:
    return upsert.duplicate_groups(fr.live_columns(spark, d, "source_slug", "postal_code", "area", "rooms", "price"))


@query(
    "e14_expired",
    "SELECT listing_id, status AS old_value FROM snapshot WHERE status IN ('active', 'updated') AND last_seen_at < timestamp '2001-12-01' - INTERVAL 365 DAY",
)
def expired(spark: SparkSession, d: str) -> DataFrame:
    _, rows = upsert.expire(fr.snapshot(spark, d), F.lit("2001-12-01").cast("timestamp_ntz"), "365 days")
    return rows.select("listing_id", "old_value")


@query(
    "e15_run_counters",
    "SELECT source_slug, count(*) AS items_fetched, count(*) FILTER (outcome = 'new') AS items_new, count(*) FILTER (outcome = 'updated') AS items_updated, "
    "count(*) FILTER (quarantined) AS errors, CASE WHEN count(*) FILTER (quarantined) > 0 THEN 'partial' ELSE 'success' END AS status FROM versions GROUP BY source_slug",
)
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    v = fr.versions(spark, d)
    return upsert.run_counters(v, v.filter("quarantined"))


@query(
    "e16_retention",
    "SELECT status = 'removed' AND last_seen_at < timestamp '2001-12-01' - INTERVAL 90 DAY AS archived, strftime(last_seen_at, '%Y-%m') AS month, count(*) AS n FROM snapshot GROUP BY ALL",
)
def retention(spark: SparkSession, d: str) -> DataFrame:
    kept, archived = upsert.retention_split(
        fr.snapshot(spark, d), F.col("status") == "removed", "last_seen_at", F.lit("2001-12-01").cast("timestamp_ntz"), "90 days"
    )
    count = lambda df, a: df.groupBy(F.lit(a).alias("archived"), "month").agg(F.count("*").alias("n"))
    return count(kept, False).unionByName(count(archived, True))


@query(
    "i9_two_run_report",
    "SELECT 1 AS run, source_slug, count(*) AS items_fetched, count(DISTINCT listing_id) AS items_new FROM versions GROUP BY ALL "
    "UNION ALL SELECT 2, source_slug, count(*), 0 FROM versions GROUP BY ALL",
)
def two_run_report(spark: SparkSession, d: str) -> DataFrame:
    """The same input twice: the second run finds every listing again."""
    rows = fr.incoming(spark, d).withColumn("fingerprint", F.sha2("listing_id", 256))
    first = upsert.listing_versions(rows, seq=A.SEQ)
    stored = upsert.snapshot(first, seq=A.SEQ).withColumn("pending_event", F.lit(None).cast("string")).withColumn(
        "pending_version", F.lit(None).cast("string")
    )
    # Read several times below, so made once.
    stored = _written(spark, stored, "i9-stored")
    again = upsert.resolve_existing(rows.drop("listing_id"), stored).drop("stored_seen_at")
    again = _written(spark, again, "i9-again")
    second = upsert.listing_versions(again, stored, A.SEQ)
    report = monitor.two_run_report(upsert.run_counters(first), upsert.run_counters(second))
    return report.select("run", "source_slug", "items_fetched", "items_new")


@query("i7_dedup_ratio", "SELECT source_slug, count(*) AS observations, count(*) FILTER (outcome <> 'new') / count(*) AS dedup_ratio FROM versions GROUP BY source_slug")
def dedup_ratio(spark: SparkSession, d: str) -> DataFrame:
    return monitor.dedup_ratio(fr.versions(spark, d))



RUN_ENDS = ["1995-01-01", "1997-01-01"]


def _three_runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(events of three runs, last snapshot). Handing over fails for rows with s3 >= 10; before the next run
    a third of the pending events is delivered, and stale deliveries of the others change nothing."""
    root = scratch(spark, "e12")
    rows = fr.incoming(spark, d).withColumn("fingerprint", F.sha2("listing_id", 256)).withColumn("handed", F.col("s3") < 10)
    run = sum(((F.col("seen_at") >= F.lit(end).cast("timestamp_ntz")).cast("int") for end in RUN_ENDS), F.lit(0))
    rows, stored, events = rows.withColumn("run", run), None, None
    for k in range(len(RUN_ENDS) + 1):
        now = upsert.listing_versions(rows.filter(F.col("run") == k), stored, seq=A.SEQ)
        # What the snapshot and the events read, without the change lists.
        now = now.select("run", "listing_id", "seen_at", *A.SEQ, *upsert.SNAPSHOT_FIELDS, "outcome", "event", "change_version", "handed")
        now.write.parquet(f"{root}/versions-{k}")
        now = spark.read.parquet(f"{root}/versions-{k}")
        snapshot = upsert.snapshot(now, stored, seq=A.SEQ)
        sent = now.filter("event is not null").select("run", "listing_id", "event", "change_version", "handed")
        events = sent if events is None else events.unionByName(sent)
        if k < len(RUN_ENDS):
            last = latest_per_key(now, ["listing_id"], ["seen_at", *A.SEQ])
            late = F.when(F.col("s1") % 3 == 0, F.col("change_version")).otherwise(F.lit("1970-01-01T00:00:00.000Z"))
            snapshot = upsert.clear_pending(snapshot, last.select("listing_id", "event", late.alias("change_version")))
        snapshot.write.parquet(f"{root}/snapshot-{k}")
        stored = spark.read.parquet(f"{root}/snapshot-{k}")
    return events, stored


_PENDING = (
    "WITH r AS (SELECT *, CASE WHEN seen_at >= '1997-01-01' THEN 2 WHEN seen_at >= '1995-01-01' THEN 1 ELSE 0 END AS run FROM versions), "
    "t AS (SELECT *, s3 < 10 AS handed, row_number() OVER (PARTITION BY listing_id, run ORDER BY seen_at DESC, s1 DESC, s2 DESC, s3 DESC, s4 DESC) = 1 AND run < 2 AND s1 % 3 = 0 AS acked, "
    "row_number() OVER (PARTITION BY listing_id ORDER BY seen_at, s1, s2, s3, s4) AS n FROM r), "
    "u AS (SELECT *, coalesce(sum(CASE WHEN handed OR acked THEN 1 ELSE 0 END) OVER (PARTITION BY listing_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM t), "
    "x AS (SELECT *, bool_or(coalesce(event = 'created', false)) OVER w AS any_created, last_value(change_version IGNORE NULLS) OVER w AS newest FROM u WINDOW w AS (PARTITION BY listing_id, part ORDER BY n ROWS UNBOUNDED PRECEDING)), "
    "y AS (SELECT *, CASE WHEN any_created THEN 'created' WHEN newest IS NOT NULL THEN 'changed' END AS sent, CASE WHEN NOT any_created THEN newest END AS version FROM x) "
)


@query(
    "e12_pending_runs",
    _PENDING + "SELECT run, listing_id, sent AS event, version AS change_version, handed FROM y WHERE sent IS NOT NULL",
)
def pending_runs(spark: SparkSession, d: str) -> DataFrame:
    """Events of three runs in which handing over fails; what is pending comes up again."""
    return _three_runs(spark, d)[0]


@query(
    "e9_pending_snapshot",
    _PENDING + "SELECT listing_id, CASE WHEN NOT done THEN sent END AS pending_event, CASE WHEN NOT done THEN version END AS pending_version FROM "
    "(SELECT *, handed OR acked OR sent IS NULL AS done, row_number() OVER (PARTITION BY listing_id ORDER BY n DESC) AS back FROM y) WHERE back = 1",
)
def pending_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """What is still pending after the three runs."""
    return _three_runs(spark, d)[1].select("listing_id", *upsert.PENDING_FIELDS)
