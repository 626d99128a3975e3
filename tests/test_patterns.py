"""Patterns up to the first end take time in proportion to the text, and what they find is worked out once."""

import random
import re

import pytest
from pyspark.sql import functions as F

from dwellmatch.functions.keywords import keyword_flags
from dwellmatch.sources import feeds, jsonld, sitemap

# Pattern now, the same one character at a time, and pieces of texts.
CASES = {
    "script": (feeds._SCRIPT, r'<script[^>]*type="application/json"[^>]*>([\s\S]*?)</script>', ['<script type="application/json">', '<script id=x type="application/json" y>', "</script>", "</SCRIPT>", "</script", "<", ">", "{}", "\n", "é"]),
    "model": (feeds._MODEL, r"resultListModel\s*:\s*(\{[\s\S]*?\});\s*\n", ["resultListModel:{", "resultListModel : {", "resultListModel", "{", "}", "};\n", "}; \n\n", ";", "\n", "x"]),
    "block": (jsonld._BLOCK, r"""(?i)<script[^>]*type=["']application/ld\+json["'][^>]*>([\s\S]*?)</script>""", ["<script type='application/ld+json'>", '<SCRIPT type="application/ld+json" x>', "</script>", "</Script>", "</script", "<", ">", "[1]", "\n"]),
}


@pytest.mark.parametrize("name", CASES)
def test_patterns_find_what_they_found(spark, name):
    now, before, pieces = CASES[name]
    rng = random.Random(3)
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        F.regexp_extract_all("t", F.lit(now), 1).alias("now"), F.regexp_extract_all("t", F.lit(before), 1).alias("before")
    )
    assert got.filter("not now <=> before").isEmpty()
    assert got.filter("size(now) > 1").count() > 30 and got.filter("size(now) > 0").count() > 30


def test_no_pattern_goes_on_by_single_characters(spark):
    assert not [n for n, (now, *_) in CASES.items() if r"[\s\S]" in now]
    entries = sitemap.sitemap_entries(spark.createDataFrame([("m", "<url><loc>a<b</loc></url><url>\n<loc>c</loc></sitemap><url><loc>d</loc></url>")], "map_url string, xml string"))
    assert r"[\s\S]" not in plan(entries)
    assert [r["pos"] for r in entries.select("pos").collect()] == [1, 2]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_embedded_blocks_are_read_once(spark):
    pages = spark.createDataFrame(
        [
            (1, '<script type="application/json">{"nav":1}</script><script type="application/json">{"searchresults":{"estates":[{"estateId":"a","mainPrice":5},{"estateId":""}]}}</script>'),
            (2, '<script type="application/json">{"estateListModel":{"estates":[{"estateId":"b"}]},"searchresults":{"estates":[{"estateId":"c"}]}}</script>'),
            (3, None), (4, '<script type="application/json">{"estateListModel": broken</script>'),
        ], "page_id long, html string")
    rows = feeds.embedded_rows(pages, "https://x", "Bonn")
    assert plan(rows).count("regexp_extract_all") == 1
    assert sorted((r["page_id"], r["adid"], r["price"]) for r in rows.collect()) == [(1, "a", 5.0), (2, "b", None)]


def test_result_models_are_read_once(spark):
    whole = lambda entry: "var x = {resultListModel: {\"searchResponseModel\":{\"resultlist.resultlist\":{\"resultlistEntries\":[{\"resultlistEntry\":" + entry + "}]}}};\n};"
    real = lambda i: '{"resultlist.realEstate":{"@id":"%s"}}' % i
    texts = [whole(real("a")), whole(f"[{real('b')},{real('c')}]"), whole("null"), whole("7"), whole('"[]"'), whole("[]"), "no model", None]
    rows = feeds.result_model_rows(spark.createDataFrame(list(enumerate(texts)), "page_no long, html string"), "https://x")
    assert plan(rows).count("regexp_extract(") == 1
    assert sorted((r["page_no"], r["pos"], r["id"]) for r in rows.collect()) == [(0, 0, "a"), (1, 0, "b"), (1, 1, "c")]


def test_link_details_are_worked_out_once(spark):
    parsed = spark.createDataFrame([(1, ["/expose/7/?x", "/impressum", "https://PORTAL.example/expose/7#y", "/expose/8"]), (2, None)], "page_id long, links array<string>")
    found = sitemap.page_links(parsed, "https://portal.example")
    one = plan(spark.range(1).select(sitemap.detail_url(F.col("id").cast("string"), "https://portal.example"))).count("regexp_extract_all")
    assert plan(found).count("regexp_extract_all") <= one
    assert sorted(map(tuple, found.collect())) == [(1, "https://portal.example/expose/7", 0), (1, "https://portal.example/expose/8", 3)]


def test_candidates_come_from_details_and_search_pages(spark):
    base = "https://portal.example"
    entries = spark.createDataFrame(
        [(f"{base}/expose/1/?a=1", 0, 1, 1, None), (f"{base}/wohnung-mieten/seite-2", 0, 1, 2, None), (f"{base}/news", 0, 1, 3, None), (None, 0, 1, 4, None)],
        "loc string, priority int, map_pos int, pos int, lastmod timestamp",
    )
    links = spark.createDataFrame([(f"{base}/wohnung-mieten/seite-2", f"{base}/expose/1", 5), (f"{base}/wohnung-mieten/seite-2", f"{base}/expose/3", 6)], "page_url string, url string, pos int")
    found = sitemap.candidates(entries, links, base)
    assert sorted((r["url"], r["pos"], r["sub"]) for r in found.collect()) == [(f"{base}/expose/1", 1, 0), (f"{base}/expose/3", 2, 6)]
    filters = [x for x in plan(found).splitlines() if "Filter" in x]
    assert not [x for x in filters if "regexp_extract_all" in x]


def test_keyword_texts_are_made_once(spark):
    made = F.regexp_replace("t", "x", "")
    flags = keyword_flags(made, {"a": "balkon", "b": "lift|aufzug", "c": r"\bebk\b"})
    rows = spark.createDataFrame([("Balxkon mit EBK",), (None,), ("ebkx1 Lift",)], "t string").select("t", flags.alias("f"))
    assert plan(rows).count("regexp_replace") == 1
    assert [r["f"] for r in rows.collect()] == [{"a": "true", "c": "true"}, {}, {"b": "true"}]
