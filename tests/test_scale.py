"""What large tables move: narrow rows by listing, no exchange of matched pairs."""

import pytest
from pyspark.sql import functions as F

from dwellmatch.operators import match
from dwellmatch.operators.skew import KeyedHistory
from dwellmatch.plans import frames as fr
from dwellmatch.sources.registry import filter_definitions


def exchanges(df):
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_live_rows_are_dealt_out_by_listing(spark, sf):
    both = fr.live(spark, sf).join(fr.live(spark, sf).select("listing_id", F.col("price").alias("p")), "listing_id")
    assert exchanges(both) and all("hashpartitioning(listing_id" in x for x in exchanges(both) if "l_partkey" not in x and "l_suppkey" not in x)


def test_lines_of_an_order_stay_together(spark, sf):
    grouped = fr.live(spark, sf, by_order=True).groupBy("order_no").agg(F.collect_list("url"))
    assert [x for x in exchanges(grouped) if "order_no" in x]
    assert not [x for x in exchanges(grouped) if "listing_id" in x and "order_no" not in x]
    mine = fr.live(spark, sf).select("listing_id", "title", "price", F.expr("cast(split(external_id, '-')[0] as long)").alias("order_no"))
    other = fr.live(spark, sf, by_order=True).select("listing_id", "title", "price", "order_no")
    assert mine.count() == other.count() and mine.exceptAll(other).isEmpty()


def test_hot_keys_leave_their_task_after_a_deal_by_key(spark):
    rows = spark.range(4000).select(F.lit("a").alias("k"), F.col("id").alias("seq"), F.timestamp_seconds(F.col("id")).alias("at")).repartition(4, "k")
    hist = KeyedHistory(rows, ["k"], "at", ["at", "seq"], share=4, min_rows=10, chunks=16)
    hist.add_previous("before", F.col("seq"))
    out = hist.result()
    assert out.filter("seq > 0 and before <> seq - 1").isEmpty()
    assert "REPARTITION_BY_COL" in [x for x in exchanges(out) if "_chunk" in x][0]


@pytest.mark.parametrize("most", [1, 256])
def test_matching_and_recording_together(spark, most):
    listings = spark.createDataFrame(
        [(f"l{i}", "A" if i % 2 else "B", 500.0 + i, "created" if i % 3 else "changed", None, i) for i in range(12)],
        "listing_id string, city string, price double, event string, change_version string, at long",
    ).selectExpr("*", *[f"cast(null as string) as {c}" for c in ("postal_code", "bundesland", "title", "url", "deal_type", "source_slug", "external_id")],
                 *[f"cast(null as double) as {c}" for c in ("warm_rent", "area", "rooms", "lat", "lng")], "cast(map() as map<string,string>) as attributes")
    profiles = spark.createDataFrame([(p, p % 2, p != 4, True, p == 2, "hi") for p in (1, 2, 3, 4, 5, 5)], "profile_id long, user_id long, is_active boolean, notify boolean, auto_reply_enabled boolean, auto_reply_text string")
    filters = spark.createDataFrame([(1, 0, "city", "eq", '"A"'), (2, 0, "price", "lte", "505"), (5, 0, "city", "eq", '"B"')], "profile_id long, position int, key string, operator string, value_json string")
    existing = spark.createDataFrame(
        [(1, "l1", "pending"), (2, "l1", "notified"), (3, "l1", "dismissed"), (3, "l2", "notified"), (3, "l4", "pending"), (3, "l4", "notified"), (9, "l5", "pending"), (1, "l7", None), (None, "l8", "x")],
        "profile_id long, listing_id string, state string",
    )
    pairs = match.inverse_match(listings, profiles, filters, filter_definitions(spark)).join(listings.select("listing_id", "event", "change_version", "at"), "listing_id")
    want = match.record_matches(pairs, existing)
    got = match.match_and_record(listings, profiles, filters, filter_definitions(spark), existing, most=most)
    key = lambda df: sorted(map(str, df.select(*sorted(want.columns)).collect()))
    assert key(got) == key(want)
    if most > 1:
        plain = match.match_and_record(listings, profiles, filters, filter_definitions(spark), existing.filter("listing_id in ('l1', 'l2')"))
        assert not [x for x in exchanges(plain) if "profile_id" in x and "listing_id" in x]
    columns = match.PROFILE_COLUMNS
    carried = match.match_and_record(listings, profiles, filters, filter_definitions(spark), existing, carry_profile=columns, most=most)
    for new, old in zip(match.fan_out(carried, profiles), match.fan_out(want, profiles)):
        assert sorted(map(str, new.select(*sorted(old.columns)).collect())) == sorted(map(str, old.select(*sorted(old.columns)).collect()))
