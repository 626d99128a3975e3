"""Saved searches, notifications, monitoring, pages and text functions on small frames."""

import json

import pytest
from pyspark.sql import functions as F

from dwellmatch.functions import delivery, keys, numbers, redact, text, urls
from dwellmatch.operators import monitor, notify, profiles, serve
from dwellmatch.sources import details, jsonld, mapping, pages, sitemap
from dwellmatch.sources.registry import filter_definitions, source_rows, upsert_by_key
from dwellmatch.sources.sinks import write_monthly

FILTER = "profile_id long, position int, key string, operator string, value_json string"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "fn,value,want",
    [
        (numbers.first_number, "ab 1.250 € kalt", 1250.0), (numbers.first_number, "1.234,56", 1234.56), (numbers.first_number, "790", 790.0),
        (numbers.first_number, "1,5 Zimmer", 1.5), (numbers.first_number, "65,88 m²", 65.88), (numbers.first_number, "12.5", 12.5), (numbers.first_number, "frei", None),
        (numbers.spaced_number, "1 250,00 €", 1250.0), (numbers.spaced_number, "1.234.567", 1234567.0), (numbers.spaced_number, "65 m²", 65.0),
        (numbers.spaced_number, "1.250", 1.25), (numbers.stripped_number, "EUR 1.250", 1250.0), (numbers.stripped_number, "12.5.1", 12.5),
        (numbers.stripped_number, "keine", None), (numbers.naive_number, "0 m²", None), (numbers.naive_number, "65,5 m²", 65.5),
        (text.postal_code, "in 10115 Berlin", "10115"), (text.postal_code, "123456", None), (text.clean_text, "   a\n b ", "a b"), (text.clean_text, "  ", None),
        (text.fold_key, "Wohnfläche (ca.)", "wohnflaecheca"), (text.rental_type, "WG-gesucht.de Angebot", "unknown"), (text.rental_type, "Möbliertes WG-Zimmer", "wg_room"),
        (text.availability, "01.02.2024", "ab 01.02.2024"), (text.normalize_identity, "  ÄÖ  ﬁ X", "ao fi x"),
        (urls.canonical_url, "http://P.example/a/?utm_a=1&b=2&fbclid=3#x", "https://p.example/a?b=2"), (urls.canonical_url, "ftp://p.example/a", None),
        (redact.mask_token, "at bot12:aB_-c!", "at bot<redacted>!"),
    ],
)
def test_scalar_functions(spark, fn, value, want):
    assert one(spark, fn(F.lit(value))) == want


def test_resolved_links_and_ids(spark):
    assert one(spark, sitemap.detail_url(F.lit("//p.example/expose/7/?x=1"), "https://p.example")) == "https://p.example/expose/7"
    assert one(spark, sitemap.detail_url(F.lit("https://other.example/expose/7"), "https://p.example")) is None
    assert one(spark, sitemap.detail_url(F.lit("/impressum"), "https://p.example")) is None


def test_json_keys_keep_types(spark):
    assert one(spark, keys.json_string(F.lit('a "b"'))) == '"a \\"b\\""'
    assert one(spark, keys.json_number(F.lit(float("inf")))) is None
    assert one(spark, keys.canonical_json(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit('"1"')))) == '{"a":"1","b":1}'


@pytest.mark.parametrize(
    "code,text_,retry,want",
    [
        (403, "Forbidden: bot was blocked by the user", None, ("blocked", None, "telegram_bot_blocked")),
        (403, "Forbidden: no rights", None, ("permanent", None, "telegram_permanent:403:Forbidden: no rights")),
        (429, "Too Many Requests: retry after 7", None, ("rate_limited", 7000, "telegram_retry_after:7")),
        (429, "slow", 3, ("rate_limited", 3000, "telegram_retry_after:3")), (429, "slow", None, ("rate_limited", 1000, "telegram_retry_after:1")),
        (502, "x", None, ("retryable", None, "telegram_retryable:502:x")), (None, "reset", None, ("retryable", None, "telegram_retryable:reset")),
    ],
)
def test_error_classes(spark, code, text_, retry, want):
    got = one(spark, delivery.classify_error(F.lit(code).cast("int"), F.lit(text_), F.lit(retry).cast("int")))
    assert tuple(got) == want


def test_filter_validation(spark):
    rows = [
        (1, 0, "price", "gte", "900"), (1, 1, "price", "lte", "800"), (2, 0, "price", "lte", '"9"'), (3, 0, "nope", "eq", "1"), (4, 0, "balcony", "gte", "1"),
        (5, 0, "bundesland", "in", '["Berlin","Mars"]'), (6, 0, "location", "within", '{"lat":91,"lng":1,"radius_km":0}'), (7, 0, "location", "within", "5"),
        (8, 0, "city", "eq", '" "'), (9, 0, "city", "eq", '"Berlin"'), (10, 0, "location", "within", '{"lat":"1","lng":1,"radius_km":5}'),
    ]
    got = {}
    for r in profiles.validate_filters(spark.createDataFrame(rows, FILTER), filter_definitions(spark)).collect():
        got.setdefault(r.profile_id, set()).add((r.field, r.issue.split(":")[0]))
    assert got == {
        1: {("price", "gte must be <= lte")}, 2: {("filters[0].value", "must be a finite number")}, 3: {("filters[0].key", "unknown filter key")},
        4: {("filters[0].operator", "operator is not allowed for this filter")}, 5: {("filters[0].value[1]", "must be one of")},
        6: {("filters[0].value.lat", "must be <= 90"), ("filters[0].value.radius_km", "must be > 0")},
        7: {("filters[0].value", "must be an object with lat, lng, and radius_km")}, 8: {("filters[0].value", "must be a non-empty string")},
        10: {("filters[0].value.lat", "must be a finite number")},
    }


def test_criteria_later_filter_wins(spark):
    rows = [(1, 0, "price", "lte", "900"), (1, 1, "price", "lte", "800"), (1, 2, "price", "gte", "100"), (1, 3, "balcony", "eq", "true"), (1, 4, "city", "eq", '"Berlin"')]
    got = json.loads(profiles.build_criteria(spark.createDataFrame(rows, FILTER)).first().criteria)
    assert got == {"price": {"lte": 800, "gte": 100}, "attrs": {"balcony": True}, "city": "Berlin"}


def test_search_areas(spark):
    f = [
        (1, 0, "city", "eq", '"Berlin "'), (1, 1, "location", "within", '{"lat":52.5,"lng":13.4,"radius_km":9.5}'), (1, 2, "price", "lte", "90000"),
        (2, 0, "city", "eq", '"berlin"'), (2, 1, "location", "within", '{"lat":1,"lng":2,"radius_km":10}'), (2, 2, "price", "lte", "50000"),
        (3, 0, "city", "eq", '"Bonn"'), (3, 1, "price", "lte", "40"), (4, 0, "price", "lte", "400"), (5, 0, "city", "eq", '"Off"'),
    ]
    p = spark.createDataFrame([(i, i != 5) for i in range(1, 6)], "profile_id long, is_active boolean")
    got = profiles.derive_search_areas(p, spark.createDataFrame(f, FILTER)).collect()
    assert [(r.location, r.radius_km, r.max_price, r.lat) for r in got] == [("Berlin", 10.0, 50000.0, 52.5), ("Bonn", None, None, None)]
    assert profiles.derive_search_areas(p, spark.createDataFrame(f, FILTER), max_areas=1).count() == 1


def test_first_match_speaks_for_the_user(spark):
    ev = spark.createDataFrame([(1, 9, "l", 5), (2, 9, "l", 4), (3, 8, "l", 1)], "profile_id long, user_id long, listing_id string, matched_at int")
    subs = spark.createDataFrame([(7, 9, 70, True), (6, 9, 60, False), (5, 9, 50, True)], "subscription_id long, user_id long, chat_id long, enabled boolean")
    got = notify.fan_out_subscriptions(ev, subs).collect()
    assert sorted((r.subscription_id, r.profile_id) for r in got) == [(5, 2), (7, 2)]
    assert [r.user_id for r in notify.unreachable(ev, subs).collect()] == [8]
    sent = spark.createDataFrame([(7, "l", "sent"), (5, "l", "failed")], "subscription_id long, listing_id string, status string")
    assert [r.subscription_id for r in notify.without_delivered(notify.fan_out_subscriptions(ev, subs), sent).collect()] == [5]


def test_replies_once_and_only_with_text(spark):
    m = spark.createDataFrame([(1, "a", "s"), (1, "a", "s"), (2, "a", "s"), (3, "a", "s")], "profile_id long, listing_id string, source_slug string")
    p = spark.createDataFrame([(1, True, " hi "), (2, True, "  "), (3, False, "x")], "profile_id long, auto_reply_enabled boolean, auto_reply_text string")
    none = spark.createDataFrame([], "dedupe_key string")
    out = notify.auto_replies(m, p, none)
    assert [(r.profile_id, r.body, r.status) for r in out.collect()] == [(1, "hi", "skipped_no_channel")]
    assert notify.auto_replies(m, p, out.select("dedupe_key")).count() == 0


def test_tick_outcomes(spark):
    ticks = spark.createDataFrame([(s, f"2024-01-01 00:00:{i:02d}", i) for s in ("a", "b", "zero", "gone") for i in range(4)], "source_slug string, ts string, seq long").withColumn("ts", F.to_timestamp("ts"))
    sources = spark.createDataFrame([("a", True, 2), ("b", False, 9), ("zero", True, 0)], "slug string, is_active boolean, rate_limit_rpm int")
    running = spark.createDataFrame([("a", "2023-12-31 23:50:00", "2024-01-01 00:00:01")], "source_slug string, started string, finished string").select("source_slug", F.to_timestamp("started").alias("started"), F.to_timestamp("finished").alias("finished"))
    got = {(r.source_slug, r.seq): r.outcome for r in monitor.classify_ticks(ticks, sources, running).collect()}
    assert [got["a", i] for i in range(4)] == ["duplicate_active", "queued", "queued", "rate_limited"]
    assert {got["b", i] for i in range(4)} == {got["gone", i] for i in range(4)} == {"skipped_inactive"}
    assert {got["zero", i] for i in range(4)} == {"rate_limited"}


def test_search_pages_follow_the_cursor(spark):
    rows = [(f"l{i:02d}", "active", i // 3, "A", 100.0 + i, 2.0, 50.0) for i in range(25)] + [("x", "removed", 99, "A", 100.0, 2.0, 50.0)]
    df = spark.createDataFrame(rows, "listing_id string, status string, first_seen_at int, city string, price double, rooms double, area double")
    seen, cursor = [], None
    while True:
        page, more, cursor = serve.page_of(serve.search_listings(df, "A", cursor=cursor, limit=10), 10)
        seen += [r.listing_id for r in page]
        if not more:
            break
    assert seen == sorted((f"l{i:02d}" for i in range(25)), reverse=True)
    for bad in ({"limit": 0}, {"limit": 101}, {"price_min": -1}, {"price_min": 5, "price_max": 4}):
        with pytest.raises(ValueError):
            serve.search_listings(df, **bad)


PAGE = """<html><head><title> A &amp; B </title><link rel="canonical" href="https://p.example/expose/x1/?utm_source=a"><meta property="og:image" content="/i.jpg">
<script type="application/ld+json">{"@type": oops</script>
<script type='application/ld+json'>[{"@type":"WebSite"},{"@graph":[{"@type":["Product"],"name":"P"},{"@type":"Residence","name":" Flat  one ","offers":[{"price":"1.250,50"}],"floorSize":{"value":"65,88"},"address":{"addressLocality":"Berlin","postalCode":"10115"}}]}]</script>
</head><body><h1>head</h1><dl><dt>Warm-Miete</dt><dd>1.400 €</dd><dt>Zimmer</dt><dd>2,5</dd><dt>leer</dt><dd></dd></dl><style>x</style><p>Quelle: Makler GmbH</p></body></html>"""


def test_page_extraction(spark):
    raw = spark.createDataFrame([(1, "https://p.example/other", PAGE), (2, "https://p.example/expose/2", "<h1>Gewerbe</h1>"), (3, "https://p.example/expose/3", None)], "page_id long, url string, html string")
    objects = jsonld.with_objects(raw).select("page_id", "objects")
    rows = details.aggregator_rows(pages.parse_pages(raw).join(objects, "page_id"), "https://p.example")
    got = mapping.to_canonical(rows, "aggregator").orderBy("external_id").collect()
    assert [r.external_id for r in got] == ["3", "x1"]
    r = got[1]
    assert (r.title, r.price, r.warm_rent, r.area, r.rooms, r.city, r.postal_code) == ("Flat one", 1250.5, 1400.0, 65.88, 2.5, "Berlin", "10115")
    assert r.attributes["original_source_name"] == '"Makler GmbH"' and [i.url for i in r.images] == ["https://p.example/i.jpg"]


def test_sitemap_entries(spark):
    xml = "<urlset><url><loc> https://p.example/expose/1 </loc><lastmod>2024-01-02</lastmod></url><url><loc>https://p.example/a?x=1&amp;y=2</loc></url><url></url></urlset>"
    got = sitemap.sitemap_entries(spark.createDataFrame([("m", xml)], "map_url string, xml string")).collect()
    assert [(r.pos, r.loc) for r in got] == [(0, "https://p.example/expose/1"), (1, "https://p.example/a?x=1&y=2")]
    assert got[0].lastmod.day == 2 and got[1].lastmod is None


def test_xml_source(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc>a</loc><lastmod>2024-01-02T00:00:00Z</lastmod></url><url><loc>b</loc></url></urlset>")
    got = sitemap.read_sitemap_files(spark, str(tmp_path / "s.xml")).orderBy("loc").collect()
    assert [(r.loc, r.lastmod is None) for r in got] == [("a", False), ("b", True)]


def test_index_without_maps_falls_back_to_itself(spark):
    entries = spark.createDataFrame([("i", 0, "https://p.example/expose/1", None)], "map_url string, pos int, loc string, lastmod timestamp")
    assert [r.loc for r in sitemap.expand_index("i", entries, ["-exp-"], "https://p.example").collect()] == ["https://p.example/expose/1"]


def test_seed_twice_changes_nothing(spark):
    seed = source_rows(spark)
    once = upsert_by_key(seed.limit(0), seed, "slug")
    twice = upsert_by_key(once, seed, "slug")
    assert twice.count() == seed.count() == 8


def test_monthly_log(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-05",), ("2024-02-05",)], "t string").withColumn("t", F.to_timestamp("t"))
    write_monthly(df, str(tmp_path / "m"), "t")
    assert sorted(r.month for r in spark.read.parquet(str(tmp_path / "m")).collect()) == ["2024-01", "2024-02"]


def test_quiet_hours_and_mute(spark):
    ts = lambda s: F.to_timestamp(F.lit(s))
    due = lambda t, mute=None: str(one(spark, notify.due_time(ts(t), 22, 7, ts(mute) if mute else F.lit(None).cast("timestamp")).cast("string")))
    assert due("2024-01-01 23:30:00") == "2024-01-02 07:00:00"
    assert due("2024-01-01 06:59:00") == "2024-01-01 07:00:00"
    assert due("2024-01-01 12:00:00") == "2024-01-01 12:00:00"
    assert due("2024-01-01 12:00:00", "2024-01-01 22:10:00") == "2024-01-02 07:00:00"


def test_search_arguments():
    from dwellmatch.operators.serve import check_search_args

    check_search_args(limit=100, price_min=1, price_max=1)
    for bad in ({"limit": 0}, {"limit": 101}, {"price_min": -1}, {"price_min": 2, "price_max": 1}):
        with pytest.raises(ValueError):
            check_search_args(**bad)


def test_page_sizes_are_refused_not_clipped(spark):
    from dwellmatch.operators import serve

    users = spark.createDataFrame([(1, "a@b", 1)], "user_id long, email string, created_at long")
    with pytest.raises(ValueError):
        serve.search_users(users, "a", limit=201)


def test_deep_json_is_a_broken_block(spark):
    deep = '<script type="application/ld+json">' + "[" * 100_000 + "]" * 100_000 + "</script>"
    ok = '<script type="application/ld+json">{"@graph":[{"@type":"Apartment"},[{"a":1}]]}</script>'
    from dwellmatch.sources import jsonld

    pages = spark.createDataFrame([(deep + ok,)], "html string")
    assert jsonld.with_objects(pages).first()["objects"] == ['{"@type":"Apartment"}', '{"a":1}']
    row = spark.createDataFrame([("[" * 100_000 + "]" * 100_000,)], "t string").select(redact.redact_json(F.col("t")).alias("r")).first()
    assert row["r"] is None


def test_text_attributes_are_valid_json(spark):
    from dwellmatch.sources.mapping import _text_attr

    text = 'a "b" \\ c\nd'
    got = spark.createDataFrame([(text,)], "t string").select(_text_attr("x", F.col("t")).alias("m")).first()["m"]["x"]
    assert json.loads(got) == text


def test_title_index_equals_the_scan(spark, tmp_path):
    import random

    from dwellmatch.operators import serve

    rnd = random.Random(8)
    words = ["flat", "Loft", "balcony", "garden", "südlage", "2", "rooms", "quiet", "x" * 20, "near", "park"] + [f"q{k}z" for k in range(200)]
    rows = [(" ".join(rnd.choice(words) for _ in range(rnd.randrange(6))),) for _ in range(600)] + [(None,), ("",), ("",)]
    titles = spark.createDataFrame(rows, "title string")
    index = serve.TitleIndex(spark, str(tmp_path))
    index.build(titles)
    texts = ["quiet flat near park", "q7z q8z", "", "no such thing", rows[3][0], None]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    for threshold in (0.3, 0.6, 1.0):
        got = {(r.query_id, r.title, r.listings, r.similarity) for r in index.search(queries, threshold).collect()}
        want = {(k, r.title, r.listings, r.similarity) for k, t in enumerate(texts) if t is not None for r in serve.similar_titles(titles, t, threshold).collect()}
        assert got == want
    # The rarest trigrams leave few titles to compare.
    assert index.candidates(queries.where("query_id = 1"), 0.6).count() < 0.1 * titles.distinct().count()


def test_ranked_values_equal_sorting(spark):
    import random

    from dwellmatch.operators import monitor

    rnd = random.Random(9)
    for values in ([5], [3] * 50, [rnd.randrange(-(10**12), 10**12) for _ in range(500)], [7] * 300 + [rnd.randrange(10**6) for _ in range(200)]):
        rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
        ranks = sorted({0, len(values) // 2, len(values) - 1})
        assert monitor.ranked_values(rows, "v", ranks, min(values), max(values)) == [sorted(values)[r] for r in ranks]
    nothing = spark.createDataFrame([], "a timestamp, b timestamp")
    assert tuple(monitor.latency_report(nothing, "a", "b").first())[:3] == (0, 0, 0)


def test_search_requests(spark):
    from dwellmatch.operators.serve import checked_search_args

    names = ["city", "price_max", "price_min", "rooms_min", "area_min", "limit", "cursor"]
    cases = [
        ({}, []), ({"city": "x" * 200}, []), ({"city": " " + "x" * 201}, ["city"]), ({"city": ""}, ["city"]), ({"price_min": "", "price_max": "0"}, []),
        ({"price_min": "2", "price_max": "1.5"}, ["price_min > price_max"]), ({"price_min": "2", "price_max": "-1"}, ["price_max"]), ({"area_min": "Infinity"}, ["area_min"]),
        ({"rooms_min": "1e999"}, ["rooms_min"]), ({"limit": "100"}, []), ({"limit": "101"}, ["limit"]), ({"limit": "0"}, ["limit"]), ({"limit": "1.5"}, ["limit"]), ({"cursor": "7"}, ["cursor"]),
        ({"rooms_min": "x", "limit": "x"}, ["rooms_min", "limit"]),
    ]
    rows = spark.createDataFrame([(k, *[c.get(n) for n in names]) for k, (c, _) in enumerate(cases)], "k int, " + ", ".join(f"`{n}` string" for n in names))
    got = {r.k: r.errors for r in checked_search_args(rows).collect()}
    assert got == {k: e for k, (_, e) in enumerate(cases)}
