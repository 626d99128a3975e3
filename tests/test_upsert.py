"""Gate rules and the change-detecting upsert, case by case and against a serial replay."""

import json
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellmatch.operators import quality, upsert
from dwellmatch.operators.skew import KeyedHistory, hot_keys, latest_per_key, mark_first_n, sliced_join
from dwellmatch.schema import LISTING

ROW = dict(
    source_slug="test-source", external_id="ext-1", url="https://example.com/1", title="Nice flat", deal_type=None, price=1000.0, warm_rent=1200.0,
    area=55.0, rooms=2.0, city="Berlin", bundesland="Berlin", postal_code="10115", lat=None, lng=None, attributes={"balcony": "true"}, images=None, raw="{}",
)


def gate(spark, *changes):
    df = spark.createDataFrame([tuple({**ROW, **c}.values()) for c in changes], LISTING)
    return [sorted(r.issues) for r in quality.quality_gate(df).collect()]


def test_gate_issues(spark):
    got = gate(
        spark, {}, {"price": 5.0}, {"postal_code": "ABC"}, {"lat": 0.0, "lng": 0.0}, {"price": None}, {"price": None, "warm_rent": None},
        {"price": None, "warm_rent": None, "area": 1.0}, {"price": None, "warm_rent": None, "bundesland": "Nowhere"}, {"external_id": None, "url": "nope"},
        {"title": "x" * 501}, {"images": [("bad", -1)]}, {"lat": 50.0},
    )
    both = "price: At least one of price or warmRent is required"
    assert got[0] == [] and got[4] == []
    assert got[1] == ["price: Number must be greater than or equal to 50"]
    assert got[2] == ["postalCode: PLZ must be exactly 5 digits"]
    assert len(got[3]) == 2 and got[3][0].startswith("geo.lat")
    assert got[5] == [both]
    assert both in got[6] and len(got[6]) == 2
    assert len(got[7]) == 1 and got[7][0].startswith("bundesland: Invalid enum value")
    assert got[8] == ["externalId: Required", "url: Invalid url"]
    assert got[9] == ["title: String must contain at most 500 character(s)"]
    assert got[10] == ["images.0.position: Number must be greater than or equal to 0", "images.0.url: Invalid url"]
    assert got[11] == ["geo.lng: Required"]


def frame(spark, *versions):
    """Versions of listings in time order; each a dict of changes with an optional key."""
    base = [tuple({**ROW, **{k: v for k, v in c.items()}}.values()) for c in versions]
    df = spark.createDataFrame([b + (i,) for i, b in enumerate(base)], _schema())
    rows = quality.gated_rows(quality.quality_gate(df)).withColumn("seen_at", F.timestamp_seconds(F.col("seq") * 60))
    rows = upsert.with_identity(rows, True)
    return rows.withColumn("listing_id", F.col("fingerprint"))


def _schema():
    return T.StructType([*LISTING.fields, T.StructField("seq", T.IntegerType())])


def run(spark, *versions, **kw):
    out = upsert.listing_versions(frame(spark, *versions), **kw).orderBy("seq")
    return out.collect()


def outcome(spark, change, first=None):
    r = run(spark, first or {}, {**(first or {}), **change})[1]
    return r.outcome, r.event, r.status, sorted(c.field for c in r.changes or [])


def test_single_changes(spark):
    cases = {
        "price fall": ({"price": 900.0}, ("updated", "changed", "updated", ["price"])),
        "price rise": ({"price": 1100.0}, ("updated", None, "active", ["price"])),
        "warm fall": ({"warm_rent": 1100.0}, ("updated", "changed", "updated", ["warm_rent"])),
        "price appears": ({"price": 900.0}, ("updated", None, "active", ["price"])),
        "other attribute": ({"attributes": {"balcony": "true", "wg": "true"}}, ("updated", None, "active", ["attributes"])),
        "filter attribute": ({"attributes": {"balcony": "false"}}, ("updated", "changed", "updated", ["attributes"])),
        "unchanged": ({}, ("touched", None, "active", [])),
        "below stored scale": ({"area": 55.001}, ("touched", None, "active", [])),
        "title": ({"title": "New"}, ("updated", None, "active", ["title"])),
        "rooms": ({"rooms": 3.0}, ("updated", "changed", "updated", ["rooms"])),
        "geo appears": ({"lat": 52.0, "lng": 13.0}, ("updated", "changed", "updated", ["geo"])),
        "images": ({"images": [("https://i.example/1.jpg", 0)]}, ("updated", None, "active", [])),
        "quarantined": ({"price": 5.0}, ("updated", None, "removed", ["attributes", "price"])),
    }
    for name, (change, want) in cases.items():
        first = {"price": None} if name == "price appears" else None
        assert outcome(spark, change, first) == want, name


def test_geo_sticks_and_quarantine_clears_it(spark):
    at = {"lat": 52.0, "lng": 13.0}
    rows = run(spark, at, {}, {"price": 5.0}, {})
    assert [(r.lat, r.outcome, r.event, r.status) for r in rows] == [
        (52.0, "new", "created", "active"), (52.0, "touched", None, "active"), (None, "updated", None, "removed"), (None, "updated", "changed", "updated"),
    ]


def test_more_than_ten_images_do_not_change_every_time(spark):
    many = {"images": [(f"https://i.example/{i}.jpg", i) for i in range(12)]}
    rows = run(spark, many, many)
    assert rows[1].outcome == "touched"


def test_stays_updated_after_a_minor_change(spark):
    rows = run(spark, {}, {"price": 900.0}, {"price": 950.0}, {"price": 950.0, "title": "x"})
    assert [r.status for r in rows] == ["active", "updated", "updated", "updated"]


def stored(spark, status, pending=None, version=None, **change):
    snap = upsert.snapshot(upsert.listing_versions(frame(spark, change)))
    return (
        snap.withColumn("status", F.lit(status)).withColumn("pending_event", F.lit(pending).cast("string")).withColumn("pending_version", F.lit(version).cast("string"))
    )


def second(spark, snap, change):
    rows = frame(spark, change).withColumn("seen_at", F.timestamp_seconds(F.lit(9999)))
    return upsert.listing_versions(rows, snap).first()


def test_reactivation_and_pending_events(spark):
    r = second(spark, stored(spark, "expired"), {})
    assert (r.outcome, r.event, r.status) == ("updated", "changed", "updated")
    r = second(spark, stored(spark, "active", "created"), {"price": 900.0})
    assert (r.outcome, r.event, r.status, r.change_version) == ("updated", "created", "updated", None)
    r = second(spark, stored(spark, "active", "changed", "v1"), {})
    assert (r.outcome, r.event, r.change_version) == ("touched", "changed", "v1")
    r = second(spark, stored(spark, "active", "changed", "v1"), {"title": "x"})
    assert (r.outcome, r.event, r.change_version) == ("updated", "changed", "v1")


def test_existing_found_by_id_then_fingerprint(spark):
    snap = stored(spark, "active").withColumn("listing_id", F.lit("L1"))
    same = frame(spark, {}, {"external_id": "EXT-1"}, {"external_id": "other"}).drop("listing_id")
    got = {r.external_id: r.listing_id for r in upsert.resolve_existing(same, snap).collect()}
    assert got["ext-1"] == "L1" and got["EXT-1"] == "L1" and got["other"] not in ("L1", None)


def test_late_rows_go_to_history(spark):
    snap = stored(spark, "active").withColumn("last_seen_at", F.timestamp_seconds(F.lit(500)))
    rows = frame(spark, {}, {"price": 900.0}).drop("listing_id").withColumn("seen_at", F.timestamp_seconds(F.when(F.col("seq") == 0, 100).otherwise(900)))
    ok, late = upsert.split_late(upsert.resolve_existing(rows, snap))
    assert ok.count() == 1 and [r.field for r in upsert.late_history(late).collect()] == ["late"]


def test_blank_id_uses_content(spark):
    rows = frame(spark, {"external_id": " "}, {"external_id": " ", "price": 999.0}).select("fingerprint").collect()
    assert rows[0] != rows[1]


def _serial(versions):
    """Plain one-by-one processing of one listing's versions: (outcome, status, event)."""
    state, out = None, []
    for v in versions:
        bad = v["price"] < 50
        new = {"price": v["price"], "rooms": v["rooms"], "title": v["title"], "bad": bad}
        new["geo"] = None if bad else (v["geo"] or (state or {}).get("geo"))
        if state is None:
            status, event, what = ("removed", None, "new") if bad else ("active", "created", "new")
        else:
            diff = [k for k in ("price", "rooms", "title", "geo", "bad") if new[k] != state[k]]
            signif = not bad and (new["price"] < state["price"] or "rooms" in diff or "geo" in diff or state["bad"])
            if not diff:
                status, event, what = state["status"], None, "touched"
            else:
                status = "removed" if bad else "updated" if signif else "updated" if state["status"] == "updated" else "active"
                event, what = ("changed" if signif else None), "updated"
        state = {**new, "status": status}
        out.append((what, status, event))
    return out


def _random_versions(rnd, n, keys):
    return [
        {"key": f"k{rnd.choice(keys)}", "price": float(rnd.choice([5, 800, 900, 1000])), "rooms": float(rnd.choice([2, 3])), "title": rnd.choice("ab"),
         "geo": rnd.choice([None, (52.0, 13.0), (48.0, 11.0)])}
        for _ in range(n)
    ]


def _check_serial(spark, versions, **kw):
    changes = [
        {"external_id": v["key"], "price": v["price"], "warm_rent": None, "rooms": v["rooms"], "title": v["title"], "lat": (v["geo"] or (None, None))[0], "lng": (v["geo"] or (None, None))[1]}
        for v in versions
    ]
    got = run(spark, *changes, **kw)
    want = [None] * len(versions)
    for key in {v["key"] for v in versions}:
        at = [i for i, v in enumerate(versions) if v["key"] == key]
        for i, o in zip(at, _serial([versions[i] for i in at])):
            want[i] = o
    assert [(r.outcome, r.status, r.event) for r in got] == want


def test_random_versions_equal_serial_processing(spark):
    _check_serial(spark, _random_versions(random.Random(1), 300, range(25)))


def test_hot_listing_is_cut_into_chunks_with_the_same_result(spark):
    rnd = random.Random(2)
    versions = _random_versions(rnd, 400, [0] * 10 + list(range(1, 12)))
    _check_serial(spark, versions, share=8, min_rows=20)


def test_hot_key_detection_and_chunks(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") + 10).alias("k"), F.timestamp_seconds("id").alias("t"), "id")
    assert len(hot_keys(df, ["k"], 16, 50)) == 1 and hot_keys(df, ["k"], 16, 500) == {}
    h = KeyedHistory(df, ["k"], "t", ["t"], 16, 50, 8)
    assert h.hot and h.df.filter("_hot").select("_chunk").distinct().count() == 8
    h.add_previous("p", F.col("id"))
    wrong = h.result().filter("k = 1 and id > 0").filter("p <> id - 3 or p is null").count()
    assert wrong == 0 and h.result().count() == 1000


def test_sliced_join_equals_plain_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50 + 2).alias("k"), F.col("id").alias("a"))
    right = spark.range(60).select((F.col("id") % 40).alias("k"), F.col("id").alias("b"))
    plain = left.join(right, "k")
    for n in (1, 7):
        got = sliced_join(left, right, ["k"], ["a"], n).select(plain.columns)
        assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_mark_first_n(spark):
    df = spark.createDataFrame([(g, i, 2 if g == "a" else 0) for g in "ab" for i in range(5)], "g string, i int, n int")
    got = {(r.g, r.i) for r in mark_first_n(df, ["g"], ["i"], F.col("n"), 2, "ok").filter("ok").collect()}
    assert got == {("a", 0), ("a", 1)}


def test_latest_per_key(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, t int, v string")
    assert sorted(r.v for r in latest_per_key(df, ["k"], ["t"]).collect()) == ["b", "c"]


def test_quarantine_row_without_id(spark):
    df = spark.createDataFrame([tuple({**ROW, "external_id": None, "url": None, "raw": json.dumps({"b": 1, "a": 2})}.values())], LISTING)
    _, bad = quality.split_gate(quality.quality_gate(df))
    r = quality.quarantine_rows(bad).first()
    assert r.url == f"https://quarantine.local/test-source/{r.external_id}" and r.attributes["_quarantine"] == "true"
    assert "externalId: Required" in r.attributes["_quality_issues"]
