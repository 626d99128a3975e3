"""Predicate semantics, compiled against row-by-row evaluation, and brute force."""

import json
import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from dwellmatch.operators import match
from dwellmatch.plans import adapter
from dwellmatch.sources.registry import DEFINITION_SCHEMA, filter_definitions

LISTING = "listing_id string, source_slug string, external_id string, url string, title string, deal_type string, price double, warm_rent double, area double, rooms double, city string, bundesland string, postal_code string, lat double, lng double, attributes map<string,string>"
FILTER = "profile_id long, position int, key string, operator string, value_json string"
BASE = dict(
    listing_id="l1", source_slug="mock", external_id="1", url="https://example.com/1", title="t", deal_type="rent", price=1200.0,
    warm_rent=None, area=60.0, rooms=2.5, city="Berlin", bundesland="Berlin", postal_code="10115", lat=52.52, lng=13.405,
    attributes={"balcony": "true", "elevator": "false"},
)


def rows(spark, *listings):
    return spark.createDataFrame([tuple(x.values()) for x in listings], LISTING)


def frames(spark, filters_by_profile):
    flat = [
        (pid, i, k, o, v if isinstance(v, str) and v.startswith("raw:") else json.dumps(v, separators=(",", ":")))
        for pid, fs in filters_by_profile.items()
        for i, (k, o, v) in enumerate(fs)
    ]
    profiles = spark.createDataFrame([(p, p, True) for p in filters_by_profile], "profile_id long, user_id long, is_active boolean")
    return profiles, spark.createDataFrame(flat, FILTER)


def both(spark, listings, filters_by_profile, definitions=None, slices=3):
    definitions = filter_definitions(spark) if definitions is None else definitions
    profiles, filters = frames(spark, filters_by_profile)
    got = {(r.profile_id, r.listing_id) for r in match.inverse_match(listings, profiles, filters, definitions, slices=slices).collect()}
    ids = [r.listing_id for r in listings.select("listing_id").collect()]
    pairs = spark.createDataFrame([(p, i) for p in filters_by_profile for i in ids], "profile_id long, listing_id string")
    explained = match.explain_pairs(pairs, listings, filters, definitions).collect()
    assert {(r.profile_id, r.listing_id) for r in explained if r.matched} == got
    return got, {(r.profile_id, r.listing_id): r.failed_keys for r in explained}


CASES = {
    "all pass": ([("city", "eq", "Berlin"), ("price", "lte", 1300), ("rooms", "gte", 2), ("balcony", "eq", True)], True),
    "price over the limit": ([("price", "lte", 1000)], False),
    "false attribute": ([("elevator", "eq", True)], False),
    "attribute equal to false": ([("elevator", "eq", False)], True),
    "missing attribute": ([("parking", "eq", True)], False),
    "missing attribute equal to false": ([("parking", "eq", False)], False),
    "radius near": ([("location", "within", {"lat": 52.5, "lng": 13.4, "radius_km": 5})], True),
    "radius far": ([("location", "within", {"lat": 48.137, "lng": 11.575, "radius_km": 5})], False),
    "radius malformed": ([("location", "within", {"lat": 52.5, "lng": 13.4, "radius_km": -5})], False),
    "radius as text": ([("location", "within", {"lat": 52.5, "lng": 13.4, "radius_km": "5"})], False),
    "radius beside city": ([("city", "eq", "Berlin"), ("location", "within", {"lat": 48.1, "lng": 11.5, "radius_km": 5})], False),
    "two circles": ([("location", "within", {"lat": 52.5, "lng": 13.4, "radius_km": 9}), ("location", "within", {"lat": 48.1, "lng": 11.5, "radius_km": 5})], False),
    "city in list": ([("city", "in", ["Hamburg", "Berlin"])], True),
    "city not in list": ([("city", "in", ["Hamburg"])], False),
    "two city filters": ([("city", "in", ["Hamburg", "Berlin"]), ("city", "eq", "Hamburg")], False),
    "operator not allowed": ([("balcony", "gte", 1)], False),
    "unknown key": ([("colour", "eq", "red")], False),
    "no filters": ([], True),
    "text number": ([("price", "lte", "1300")], False),
    "number for text": ([("postal_code", "eq", 10115)], False),
    "range": ([("price", "gte", 1200), ("price", "lte", 1200)], True),
    "two upper bounds": ([("price", "lte", 5000), ("price", "lte", 100)], False),
    "state": ([("bundesland", "eq", "Berlin")], True),
    "postal code": ([("postal_code", "in", ["10115", "1"])], True),
    "area only": ([("area", "gte", 60)], True),
    "rooms only": ([("rooms", "gte", 3)], False),
}


def test_predicate_cases(spark):
    names = list(CASES)
    got, failed = both(spark, rows(spark, BASE), {i: CASES[n][0] for i, n in enumerate(names)})
    assert {n: (i, "l1") in got for i, n in enumerate(names)} == {n: CASES[n][1] for n in names}
    assert failed[names.index("unknown key"), "l1"] == ["colour"]


def test_missing_values_fail_closed(spark):
    bare = {**BASE, "lat": None, "lng": None, "price": None, "warm_rent": 900.0, "city": None}
    got, _ = both(
        spark,
        rows(spark, bare),
        {1: [("location", "within", {"lat": 52.5, "lng": 13.4, "radius_km": 5})], 2: [("price", "lte", 5000)], 3: [("city", "eq", "Berlin")], 4: []},
    )
    assert got == {(4, "l1")}


def test_own_definitions(spark):
    defs = spark.createDataFrame(
        [
            ("garden", {}, "bool", ["eq"], json.dumps({"binding": {"attribute": "garden"}}), True),
            ("floor", {}, "number", ["gte", "in"], json.dumps({"binding": {"attribute": "floor"}}), True),
            ("old", {}, "bool", ["eq"], "{}", False),
        ],
        DEFINITION_SCHEMA,
    )
    with_garden = {**BASE, "listing_id": "l2", "attributes": {"garden": "true", "floor": "3"}}
    text_floor = {**BASE, "listing_id": "l3", "attributes": {"floor": '"3"', "old": "true"}}
    got, _ = both(
        spark,
        rows(spark, BASE, with_garden, text_floor),
        {1: [("garden", "eq", True)], 2: [("floor", "gte", 2)], 3: [("floor", "in", [3, 4])], 4: [("old", "eq", True)], 5: [("floor", "in", ["3"])]},
        defs,
    )
    assert got == {(1, "l2"), (2, "l2"), (3, "l2"), (5, "l3")}


def test_inactive_status_and_profiles(spark):
    profiles, filters = frames(spark, {1: [], 2: []})
    profiles = profiles.withColumn("is_active", F.col("profile_id") == 1)
    listings = rows(spark, BASE, {**BASE, "listing_id": "l2"}).withColumn(
        "status", F.when(F.col("listing_id") == "l1", "updated").otherwise("removed")
    )
    out = match.inverse_match(listings, profiles, filters, filter_definitions(spark)).collect()
    assert [(r.profile_id, r.listing_id) for r in out] == [(1, "l1")]


def _km(a, b, c, d):
    r = math.radians
    h = math.sin(r(c - a) / 2) ** 2 + math.sin(r(d - b) / 2) ** 2 * math.cos(r(a)) * math.cos(r(c))
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


def test_random_profiles_equal_brute_force(spark):
    rnd = random.Random(3)
    listings = []
    for i in range(120):
        attrs = {k: rnd.choice(["true", "false"]) for k in ("balcony", "elevator") if rnd.random() < 0.8}
        listings.append(
            {**BASE, "listing_id": f"l{i}", "price": rnd.choice([None, float(rnd.randrange(50, 3000))]), "area": float(rnd.randrange(5, 200)),
             "rooms": rnd.randrange(1, 12) / 2, "city": rnd.choice(["A", "B", None]), "lat": rnd.choice([None, 47 + rnd.random() * 8]),
             "lng": 6 + rnd.random() * 9, "attributes": attrs}
        )
    makers = [
        lambda: ("city", "eq", rnd.choice(["A", "B", "C"])),
        lambda: ("city", "in", rnd.sample(["A", "B", "C"], 2)),
        lambda: ("price", "lte", rnd.randrange(50, 3000)),
        lambda: ("price", "gte", rnd.randrange(50, 3000)),
        lambda: ("area", "gte", rnd.randrange(5, 200)),
        lambda: ("rooms", "gte", rnd.randrange(1, 12) / 2),
        lambda: ("balcony", "eq", rnd.choice([True, False])),
        lambda: ("location", "within", {"lat": 47 + rnd.random() * 8, "lng": 6 + rnd.random() * 9, "radius_km": rnd.randrange(5, 300)}),
    ]
    profs = {p: [rnd.choice(makers)() for _ in range(rnd.randrange(0, 4))] for p in range(150)}

    def ok(x, key, op, v):
        if key == "location":
            return x["lat"] is not None and _km(x["lat"], x["lng"], v["lat"], v["lng"]) <= v["radius_km"]
        have = {"true": True, "false": False}.get(x["attributes"].get(key)) if key == "balcony" else x[key]
        if have is None:
            return False
        return {"eq": lambda: have == v, "in": lambda: have in v, "gte": lambda: have >= v, "lte": lambda: have <= v}[op]()

    want = {(p, x["listing_id"]) for p, fs in profs.items() for x in listings if all(ok(x, *f) for f in fs)}
    got, _ = both(spark, rows(spark, *listings), profs)
    assert got == want and len(want) > 500


@pytest.mark.parametrize("slices", [None, 1, 3, 64])
def test_extreme_bounds_and_circles(spark, slices):
    listings = rows(
        spark, BASE, {**BASE, "listing_id": "l2", "rooms": 150.0, "price": 2e9}, {**BASE, "listing_id": "l3", "price": 1e300, "rooms": 0.0, "lat": -89.95, "lng": 180.0},
        {**BASE, "listing_id": "l4", "price": 0.0, "area": None, "lat": 0.0, "lng": -180.0},
    )
    circle = lambda lat, lng, r: [("location", "within", {"lat": lat, "lng": lng, "radius_km": r})]
    profs = {
        1: [("rooms", "gte", 120)], 2: [("price", "gte", 1.5e9)], 3: [("price", "gte", 1e299)], 4: [("price", "lte", 0)], 5: [("price", "gte", -5)],
        6: circle(10, 10, 20000), 7: circle(0, 179.9, 50), 8: circle(90, 0, 20000), 9: circle(-90, 0, 100), 10: circle(50, 10, 4000), 11: [],
        12: [("price", "gte", 1200), ("price", "lte", 1e9)], 13: [("balcony", "eq", True)], 14: [("area", "gte", 0), ("rooms", "lte", 2.5)],
    }
    got, _ = both(spark, listings, profs, slices=slices)
    assert {(1, "l2"), (2, "l2"), (2, "l3"), (3, "l3"), (4, "l4"), (7, "l4"), (9, "l3"), (12, "l1")} <= got
    profiles, filters = frames(spark, profs)
    keys = match.profile_keys(match.rule_rows(profiles, filters, filter_definitions(spark))).groupBy("profile_id").count().collect()
    assert max(r["count"] for r in keys) <= 120


def test_failure_counts_equal_pairs(spark):
    rnd = random.Random(5)
    listings = rows(spark, *[{**BASE, "listing_id": f"l{i}", "price": float(rnd.randrange(50, 900)), "city": rnd.choice("AB")} for i in range(40)])
    profs = {p: [("price", rnd.choice(["lte", "gte"]), rnd.randrange(50, 900)), ("city", "in", ["A", "Z"]), ("nope", "eq", 1)] for p in range(20)}
    profiles, filters = frames(spark, profs)
    counted = {r.key: r.failures for r in match.failure_counts(listings, profiles, filters, filter_definitions(spark)).collect()}
    _, failed = both(spark, listings, profs)
    want = {}
    for keys in failed.values():
        for k in keys:
            want[k] = want.get(k, 0) + 1
    assert counted == want


def test_counting_failures_reads_the_listings_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passing(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    listings = rows(spark, *[{**BASE, "listing_id": f"l{i}", "price": float(i), "lat": None if i == 3 else 52.5} for i in range(12)])
    listings = listings.mapInArrow(passing, listings.schema)
    circle = {"lat": 52.5, "lng": 13.4, "radius_km": 5}
    profiles, filters = frames(spark, {1: [("price", "lte", 4), ("city", "eq", "Berlin")], 2: [("location", "within", circle), ("balcony", "eq", True)]})
    got = {r.key: r.failures for r in match.failure_counts(listings, profiles, filters, filter_definitions(spark)).collect()}
    assert got == {"price": 7, "city": 0, "location": 1, "balcony": 0} and seen.value == 12
    none = match.failure_counts(listings.filter("false"), profiles, filters, filter_definitions(spark)).collect()
    assert {r.key: r.failures for r in none} == dict.fromkeys(got, 0)


def test_known_matches_are_told_apart_where_the_order_is(spark, tmp_path):
    spark.createDataFrame(
        [(1, 1, 9), (1, 1, 17), (1, 1, 2), (1, 2, 9), (2, 1, 9), (1, None, 9), (2, None, 9), (3, 1, None), (4, 1, 9)], "l_orderkey long, l_linenumber long, l_suppkey long"
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, 7, "F", "a"), (2, 7, "F", "a"), (3, 7, "O", "b"), (3, 7, "O", "b"), (5, 7, "O", "b")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate string").write.parquet(str(tmp_path / "orders.parquet"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = adapter.past_matches(spark, str(tmp_path))
        got = sorted(map(str, found.select("profile_id", "source_slug", "external_id", "state").collect()))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    rest = [(7, "src1", "1-1", "notified"), (7, "src2", "1-1", "notified"), (7, "src1", "1-2", "notified"), (7, "src1", "2-1", "notified"), (7, "src1", None, "notified"), (7, None, "3-1", "pending")]
    assert got == sorted(str(Row(profile_id=p, source_slug=s, external_id=e, state=st)) for p, s, e, st in rest)
    assert "hashpartitioning(o_custkey" not in plan


def test_radius_join_at_the_date_line(spark):
    points = spark.createDataFrame([(1, 0.0, 179.99), (2, 0.0, -179.99), (3, 0.0, 178.0)], "point_id long, lat double, lng double")
    circles = spark.createDataFrame([(7, 0.0, 179.999, 10.0)], "circle_id long, c_lat double, c_lng double, radius_km double")
    assert sorted(r.point_id for r in match.radius_join(points, circles).collect()) == [1, 2]


@pytest.mark.parametrize("event,state,triggers", [("created", "pending", True), ("created", "notified", False), ("changed", "notified", True), ("changed", "dismissed", True)])
def test_known_match_triggers(spark, event, state, triggers):
    pairs = spark.createDataFrame([(1, "l1", event, "v")], "profile_id long, listing_id string, event string, change_version string")
    known = spark.createDataFrame([(1, "l1", state)], "profile_id long, listing_id string, state string")
    r = match.record_matches(pairs, known).first()
    assert (r.is_new, r.triggers, r.state) == (False, triggers, state)
    assert match.record_matches(pairs, known.limit(0)).first().is_new


def _many(spark, n=400):
    rnd = random.Random(31)
    flag = lambda: rnd.choice(["true", "false"])
    some = [
        {**BASE, "listing_id": f"l{k}", "price": rnd.choice([None, 500.0, 900.0, 1200.0]), "rooms": rnd.choice([1.0, 2.5]), "city": rnd.choice(["Berlin", "Bonn", None]),
         "title": rnd.choice(["t", "u"]), "lat": rnd.choice([None, 52.52, 48.1]), "attributes": rnd.choice([None, {}, {"balcony": flag()}, {"balcony": flag(), "elevator": flag(), "own": "\"x\""}])}
        for k in range(n)
    ]
    place = {"lat": 52.5, "lng": 13.4, "radius_km": 5}
    wanted = {
        1: [("price", "lte", 1000)], 2: [("price", "lte", 1000), ("balcony", "eq", True)], 3: [], 4: [("city", "eq", "Berlin"), ("location", "within", place)],
        5: [("balcony", "eq", False)], 6: [("kind", "in", ["u"]), ("rooms", "gte", 2)], 7: [("own", "eq", "x")], 8: [("price", "lte", 1)], 9: [("nothing", "eq", 1)],
        10: [("location", "within", place), ("elevator", "eq", True), ("price", "gte", 600)], 11: [("price", "lte", 1000)],
    }
    extra = [("kind", {"de": "T"}, "text", ["in"], json.dumps({"binding": {"column": "title"}}), True), ("own", {"de": "O"}, "text", ["eq"], json.dumps({"binding": {"attribute": "own"}}), True)]
    definitions = filter_definitions(spark).unionByName(spark.createDataFrame(extra, DEFINITION_SCHEMA))
    profiles, filters = frames(spark, wanted)
    odd = spark.createDataFrame([(None, 1, True), (2, 2, True), (12, 1, False)], profiles.schema)
    return rows(spark, *some, *some[:20], {**BASE, "listing_id": None}), profiles.unionByName(odd), filters, definitions


@pytest.mark.parametrize("with_extra", [True, False])
def test_known_pairs_are_matched_without_any_others(spark, monkeypatch, with_extra):
    listings, profiles, filters, definitions = _many(spark)
    filters = filters if with_extra else filters.where("key not in ('kind', 'own')")
    pairs = {(r.profile_id, r.listing_id) for r in match.inverse_match(listings, profiles, filters, definitions).collect() if r.listing_id and r.profile_id}
    asked = [(p, f"l{k}") for p in range(1, 13) for k in range(0, 60, 3)]
    table = spark.createDataFrame([*asked, asked[0], asked[5], (None, "l1"), (1, None)], "profile_id long, listing_id string")
    monkeypatch.setattr(match, "inverse_match", None)
    got = [tuple(r) for r in match.still_matched(table, listings, profiles, filters, definitions).collect()]
    assert sorted(got) == sorted(set(asked) & pairs) and got


def test_points_at_one_place_meet_the_circles_once(spark, monkeypatch):
    rnd = random.Random(32)
    points = [(f"p{k}", rnd.choice([None, 50.0, 50.1, 51.0]), rnd.choice([None, 7.0, 7.2])) for k in range(300)]
    circles = [(k, 50.0 + k / 20, 7.0, float(r)) for k, r in enumerate((1, 12, 30, 200))] + [(9, 10.0, 10.0, 5.0)]
    p = spark.createDataFrame(points, "point_id string, lat double, lng double")
    c = spark.createDataFrame(circles, "circle_id long, c_lat double, c_lng double, radius_km double")
    want = sorted((r.circle_id, r["count(1)"], r["min(km)"]) for r in match.radius_join(p, c).groupBy("circle_id").agg(F.expr("count(1)"), F.min("km")).collect())
    join, seen = match.radius_join, []
    monkeypatch.setattr(match, "radius_join", lambda places, *rest: seen.append(places.count()) or join(places, *rest))
    got = sorted((r.circle_id, r.points, r.nearest_km) for r in match.radius_counts(p, c).collect())
    assert got == want and len(got) >= 3 and seen == [12]
