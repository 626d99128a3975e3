"""Plans that must hold at scale: pushed filters, no crossed sides, no stray shuffles."""

import re

import pytest
from pyspark.sql import functions as F

from dwellmatch.operators import match, quality, serve, upsert
from dwellmatch.plans import adapter as A
from dwellmatch.plans import frames as fr
from dwellmatch.sources.registry import filter_definitions


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def listings(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("snap") / "listings")
    fr.snapshot(spark, sf).write.parquet(path)
    return path


def test_search_prunes_and_pushes(spark, listings):
    out = serve.search_listings(spark.read.parquet(listings), "NATION_3", price_max=900, limit=20).select("listing_id", "price", "first_seen_at")
    p = plan(out)
    assert "TakeOrderedAndProject" in p
    pushed = re.search(r"PushedFilters: (.*?), ReadSchema", p).group(1)
    assert "EqualTo(city,NATION_3)" in pushed and "LessThanOrEqual(price,900" in pushed
    schema = re.search(r"ReadSchema: struct<(.*?)>", p).group(1)
    assert "attributes" not in schema and "title" not in schema


def test_gate_is_one_narrow_stage(spark, listings):
    df = spark.read.parquet(listings).drop("quarantined", "status")
    assert "Exchange" not in plan(quality.quality_gate(df, A.REGIONS))


def test_match_never_crosses_and_stays_compiled(spark, sf, listings):
    df = spark.read.parquet(listings)
    out = match.inverse_match(df, A.profiles(spark, sf), A.filters(spark, sf), filter_definitions(spark), slices=2)
    p = plan(out)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "lambdafunction" not in re.search(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[path.*", p).group(0)
    assert "raw" not in re.search(r"ReadSchema: struct<(.*?)\n", p).group(1)


def test_profiles_without_any_key_use_equal_slices(spark, listings):
    profiles = spark.createDataFrame([(1, 1, True)], "profile_id long, user_id long, is_active boolean")
    none = spark.createDataFrame([], "profile_id long, position int, key string, operator string, value_json string")
    df = spark.read.parquet(listings)
    out = match.inverse_match(df, profiles, none, filter_definitions(spark))
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    assert out.count() == df.filter("status in ('active', 'updated')").count()


def test_versions_shuffle_once_by_listing(spark, sf):
    rows = fr.incoming(spark, sf)
    p = plan(upsert.listing_versions(rows, seq=A.SEQ))
    assert len(re.findall(r"Exchange hashpartitioning\(listing_id", p)) == 1


def test_latest_limits_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(fr.latest(spark, sf))


def test_rate_limit_ranks_are_cut_before_the_shuffle(spark):
    from dwellmatch.operators.notify import rate_limit

    df = spark.range(10).select("id", (F.col("id") % 2).alias("chat_id"), F.timestamp_seconds("id").alias("ts"))
    assert plan(rate_limit(df, ["ts", "id"])).count("Partial") >= 2
