"""Scalar function queries over the given texts, pages and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellmatch.functions import keys as K
from dwellmatch.functions import numbers as N
from dwellmatch.functions import redact as R
from dwellmatch.functions import text as X
from dwellmatch.functions import urls as U
from dwellmatch.functions.geo import haversine_km
from dwellmatch.functions.keywords import KEYWORDS, keyword_flags
from dwellmatch.functions.lifecycle import resolve_binding
from dwellmatch.functions.render import escape_html
from dwellmatch.plans import adapter as A
from dwellmatch.plans import frames as fr
from dwellmatch.plans.registry import query
from dwellmatch.plans.sqltext import haversine, num_text
from dwellmatch.session import read_table

@query(
    "c1_clean_text",
    "SELECT doc_id, md5(nullif(trim(regexp_replace(concat('  ', text, chr(160), ' x '), '[\\s\\x{00a0}]+', ' ', 'g')), '')) AS cleaned FROM documents",
)
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    padded = F.concat(F.lit("  "), "text", F.lit("  x "))
    return read_table(spark, d, "documents").select("doc_id", F.md5(X.clean_text(padded)).alias("cleaned"))


_FOLD = "replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"


@query(
    "c2_folded_keys",
    f"SELECT doc_id, md5(regexp_replace({_FOLD}, '[^a-z0-9]', '', 'g')) AS key, md5(trim(regexp_replace({_FOLD}, '[\\s\\x{{00a0}}]+', ' ', 'g'))) AS label FROM documents",
)
def folded_keys(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select(
        "doc_id", F.md5(X.fold_key(F.col("text"))).alias("key"), F.md5(X.fold_label(F.col("text"))).alias("label")
    )


@query(
    "c3_identity_text",
    "SELECT doc_id, md5(trim(regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g'))) AS folded FROM documents",
)
def identity_text(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", F.md5(X.normalize_identity(F.col("text"))).alias("folded"))


@query(
    "c4_number_parsers",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS comma, floor(l_extendedprice) AS grouped, floor(l_extendedprice) AS spaced, l_quantity / 2 AS dotted, "
    "l_extendedprice AS stripped, CASE WHEN l_quantity > 25 THEN l_quantity END AS naive FROM lineitem",
)
def number_parsers(spark: SparkSession, d: str) -> DataFrame:
    german = lambda c, n: F.translate(F.format_number(c, n), ",.", ".,")
    price, whole = F.col("l_extendedprice"), F.floor("l_extendedprice").cast("double")
    return read_table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        N.first_number(F.concat(F.lit("ab "), german(price, 2), F.lit(" € kalt"))).alias("comma"),
        N.first_number(german(whole, 0)).alias("grouped"),
        N.spaced_number(F.concat(F.replace(german(whole, 0), F.lit("."), F.lit(" ")), F.lit(" €"))).alias("spaced"),
        N.spaced_number((F.col("l_quantity") / 2).cast("string")).alias("dotted"),
        N.stripped_number(F.concat(F.lit("EUR "), german(price, 2))).alias("stripped"),
        N.naive_number(F.when(F.col("l_quantity") > 25, F.concat(N.js_num(F.col("l_quantity")), F.lit(" m²"))).otherwise("0 m²")).alias("naive"),
    )


@query(
    "c5_range_gates",
    "SELECT source_slug, count(*) FILTER (price BETWEEN 50 AND 50000) AS price, count(*) FILTER (area BETWEEN 5 AND 1000) AS area, count(*) FILTER (rooms BETWEEN 0.5 AND 20) AS rooms, count(*) FILTER (price >= 50) AS priced FROM obs GROUP BY source_slug",
)
def range_gates(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c, name: F.count(c).alias(name)
    return A.observations(spark, d).groupBy("source_slug").agg(
        n(N.in_range(F.col("price"), "price"), "price"), n(N.in_range(F.col("area"), "area"), "area"),
        n(N.in_range(F.col("rooms"), "rooms"), "rooms"), n(N.at_least(F.col("price")), "priced"),
    )


@query(
    "c6_text_facts",
    "SELECT listing_id, area, rooms, price AS cold_rent, price AS labelled, CASE WHEN s3 % 2 = 0 THEN 1 ELSE rooms END AS shared_rooms FROM live",
)
def text_facts(spark: SparkSession, d: str) -> DataFrame:
    comma = lambda c: F.replace(N.js_num(F.col(c)), F.lit("."), F.lit(","))
    text = F.concat(comma("rooms"), F.lit(" Zimmer, "), comma("area"), F.lit(" m²"), F.coalesce(F.concat(F.lit(", für "), comma("price"), F.lit(" € kalt")), F.lit("")))
    labelled = F.concat(F.lit("Top! Kaltmiete: ca. "), comma("price"), F.lit(" EUR warm"))
    shared = F.when(F.col("s3") % 2 == 0, "Platz in WG").otherwise(text)
    live = fr.live(spark, d).select(
        "listing_id", "s3", text.alias("t"), labelled.alias("l"), shared.alias("s"), X.rental_type(F.lit("WG")).alias("kind")
    )
    return live.select(
        "listing_id",
        N.area_from_text(F.col("t")).alias("area"),
        N.rooms_from_text(F.col("t")).alias("rooms"),
        N.cold_rent_from_text(F.col("t")).alias("cold_rent"),
        N.price_from_text(F.col("l")).alias("labelled"),
        N.rooms_or_shared(F.col("s"), F.col("kind")).alias("shared_rooms"),
    )


@query(
    "c7_addresses",
    "SELECT listing_id, postal_code, city, concat('Weg ', cast(s1 as varchar)) AS street, CASE WHEN s3 % 2 = 0 THEN 'Mitte' END AS district, "
    "concat('Weg ', cast(s1 as varchar), ', ', postal_code, ' ', city, CASE WHEN s3 % 2 = 0 THEN ', Mitte' ELSE '' END) AS address, city AS after_postal, city AS split_city, bundesland AS split_district FROM live",
)
def addresses(spark: SparkSession, d: str) -> DataFrame:
    tail = F.when(F.col("s3") % 2 == 0, F.lit(" , Mitte")).otherwise("")
    block = F.concat(F.lit("Lage:\n  Weg "), F.col("s1").cast("string"), F.lit(" \n"), "postal_code", F.lit("  "), "city", tail, F.lit("\nMap"))
    rows = fr.live(spark, d).select(
        "listing_id", X.split_address(block).alias("a"),
        X.city_after_postal(F.concat(F.lit("Weg 1, "), "postal_code", F.lit(" "), "city", F.lit(", x"))).alias("after_postal"),
        X.split_location(F.concat("city", F.lit("  - "), "bundesland")).alias("l"),
    )
    return rows.select(
        "listing_id", "a.postal_code", "a.city", "a.street", "a.district", "a.address", "after_postal",
        F.col("l.city").alias("split_city"), F.col("l.district").alias("split_district"),
    )


_RULES = {"first": r"thou|heron|leaux", "second": r"\bque\b|\bthe\b", "third": "zzzz"}


@query(
    "c8_keyword_flags",
    "SELECT doc_id, concat('{', array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)thou|heron|leaux') THEN '\"first\":true' END, CASE WHEN regexp_matches(text, '(?i)\\bque\\b|\\bthe\\b') THEN '\"second\":true' END], lambda x: x IS NOT NULL), ','), '}') AS flags FROM documents",
)
def keyword_rules(spark: SparkSession, d: str) -> DataFrame:
    flags = keyword_flags(F.col("text"), _RULES)
    return read_table(spark, d, "documents").select("doc_id", K.canonical_json(flags).alias("flags"))


@query(
    "c8_source_vocabularies",
    "SELECT doc_id, '{\"balcony\":true,\"elevator\":true,\"furnished\":true}' AS marketplace, CASE WHEN doc_id % 2 = 0 THEN '{\"balcony\":true,\"elevator\":true,\"furnished\":true,\"pets_allowed\":true,\"provisionfrei\":true}' ELSE '{\"balcony\":true,\"elevator\":true,\"furnished\":true}' END AS exchange FROM documents",
)
def source_vocabularies(spark: SparkSession, d: str) -> DataFrame:
    """Words of the vocabularies added to the invented texts, capitals and umlauts included."""
    tail = F.when(F.col("doc_id") % 2 == 0, " ohne  Provision, TIERHALTUNG").otherwise("")
    text = F.concat(F.regexp_replace("text", "(?i)ebk|lift|keller|hunde|garage", ""), F.lit(" BALKON, Fahrstuhl, MÖBLIERT"), tail)
    flags = lambda kind: K.canonical_json(keyword_flags(text, KEYWORDS[kind]))
    return read_table(spark, d, "documents").select("doc_id", flags("marketplace").alias("marketplace"), flags("exchange").alias("exchange"))


@query(
    "c9_rental_types",
    "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'sublet' WHEN 1 THEN 'wg_room' WHEN 2 THEN 'apartment' WHEN 3 THEN 'wg_room' ELSE 'unknown' END AS kind FROM documents",
)
def rental_types(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("Wohnung zur Untermiete", "WG in Wohnung", "schöne Wohnungen", "Zimmer in einer WG", "wg-gesucht")])
    base = F.regexp_replace("text", r"(?i)\bwg\b|sublet|befristet|apartment", "")
    text = F.concat(base, F.lit(" "), F.element_at(words, (F.col("doc_id") % 5 + 1).cast("int")))
    return read_table(spark, d, "documents").select("doc_id", X.rental_type(text).alias("kind"))


_CANON = (
    "regexp_replace(concat('https://', regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', ''), "
    "CASE WHEN url LIKE '%?page%' THEN concat('?', regexp_extract(url, '\\?([^#]*)', 1)) ELSE '' END), '/$', '')"
)


@query(
    "c10_canonical_urls",
    f"SELECT page_id, {_CANON} AS canonical, regexp_replace({_CANON}, '\\?.*$', '') AS bare, url LIKE '%example.org%' AS at_org FROM pages",
)
def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    noisy = F.when(F.col("url").contains("?page"), F.concat("url", F.lit("&fbclid=9&UTM_medium=x"))).otherwise(F.col("url"))
    url = F.concat(F.upper(F.substring_index(noisy, ":", 1)), F.substring(noisy, F.length(F.substring_index(noisy, ":", 1)) + 1, F.length(noisy)))
    base = read_table(spark, d, "pages").select("page_id", "url", url.alias("u"))
    return base.select(
        "page_id",
        U.canonical_url(F.col("u")).alias("canonical"),
        U.canonical_url(F.col("u"), strip_query=True).alias("bare"),
        U.url_host(F.col("u")).endswith("example.org").alias("at_org"),
    )


@query(
    "b8_rent_search_pages",
    "SELECT page_id, page_id % 4 IN (0, 2) AS rent FROM pages",
)
def rent_search_pages(spark: SparkSession, d: str) -> DataFrame:
    parts = F.array(*[F.lit(p) for p in ("/Mieten/", "/wohnung-kaufen/", "/wohnungen/", "/haus/")])
    path = F.element_at(parts, (F.col("page_id") % 4 + 1).cast("int"))
    url = F.concat(F.lit("https://"), U.url_host(F.col("url")), path, "page_id", F.lit("?q=kaufen"))
    return read_table(spark, d, "pages").select("page_id", U.is_rent_search_url(url).alias("rent"))


@query(
    "c11_external_ids",
    "SELECT o_orderkey, concat('a b-', cast(o_orderkey as varchar)) AS expose, concat('Z', cast(o_orderkey as varchar)) AS estate, cast(o_orderkey as varchar) AS detail, cast(o_orderkey as varchar) AS immodetail, "
    "cast(o_orderkey as varchar) AS numeric_html, concat('zimmer-', cast(o_orderkey as varchar)) AS last_segment FROM orders",
)
def external_ids(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey").cast("string")
    at = lambda *parts: F.concat(F.lit("https://p.example/"), *[F.lit(x) if isinstance(x, str) else x for x in parts])
    return read_table(spark, d, "orders").select(
        "o_orderkey",
        U.external_id(at("Expose/a%20b-", n, "/?x=1"), "expose").alias("expose"),
        U.external_id(at("immobilien/schoene-wohnung-Z", n), "expose").alias("estate"),
        U.external_id(at("immobilien/detail/", n, "/"), "detail").alias("detail"),
        U.external_id(at("immodetail/", n, "#a"), "immodetail").alias("immodetail"),
        U.external_id(at("wg-zimmer.", n, ".html?asset=1"), "numeric_html").alias("numeric_html"),
        U.external_id(at("x/zimmer-", n, ".HTML"), "numeric_html").alias("last_segment"),
    )


@query(
    "c12_availability",
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('ab ', strftime(o_orderdate, '%d.%m.%Y')) WHEN 1 THEN 'sofort frei' WHEN 2 THEN 'Nach Absprache' ELSE NULL END AS available FROM orders",
)
def availability(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(F.lit(" "), F.date_format("o_orderdate", "dd.MM.yyyy"))).when(k == 1, "sofort  frei").when(k == 2, "Nach Absprache").otherwise("  ")
    return read_table(spark, d, "orders").select("o_orderkey", X.availability(text).alias("available"))


@query(
    "c13_titles_and_origins",
    "SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, concat('Makler ', cast(page_id as varchar), '-Nord') AS origin FROM pages",
)
def titles_and_origins(spark: SparkSession, d: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    origin = F.concat(F.lit("x Quelle:  Makler "), "page_id", F.lit("-Nord (Stand heute)"))
    return read_table(spark, d, "pages").select(
        "page_id", X.strip_title_suffix(F.concat(title, F.lit(" - Portal.example ")), "portal.example").alias("title"), X.origin_name(origin).alias("origin")
    )


@query(
    "c14_image_lists",
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat('https://i.example/assets/a?id=', cast(p_partkey as varchar), ' https://i.example/assets/b.jpg') "
    "WHEN p_partkey % 3 = 1 THEN concat('https://i.example/assets/t', cast(p_partkey as varchar)) ELSE 'https://i.example/assets/meta.jpg' END AS images FROM part",
)
def image_lists(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey").cast("string")
    none = F.array().cast("array<string>")
    gallery = F.when(
        F.col("p_partkey") % 3 == 0,
        F.array(
            F.concat(F.lit("/assets/a?id="), n), F.lit("//i.example/assets/b.jpg"), F.concat(F.lit("/assets/big/a?w=9&id="), n),
            F.lit("/assets/objnoimg.png"), F.lit("/other/c.jpg"), F.lit("/assets/b.jpg?w=1"), F.lit("ftp://i.example/assets/d.jpg"),
        ),
    ).otherwise(none)
    thumbs = F.when(F.col("p_partkey") % 3 == 1, F.array(F.concat(F.lit("/assets/t"), n))).otherwise(none)
    out = U.image_list(gallery, thumbs, F.lit("/assets/meta.jpg"), "https://i.example", "/assets/")
    return read_table(spark, d, "part").select("p_partkey", F.array_join(out, " ").alias("images"))


@query(
    "c15_distances",
    f"SELECT listing_id, {haversine('lat', 'lng', 'cast(52.52 as double)', 'cast(13.405 as double)')} AS km FROM live",
)
def distances(spark: SparkSession, d: str) -> DataFrame:
    km = haversine_km(F.col("lat"), F.col("lng"), F.lit(52.52), F.lit(13.405))
    return fr.live(spark, d).select("listing_id", km.alias("km"))


@query(
    "c16_escaped_text",
    "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped FROM pages",
)
def escaped_text(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "pages").select("page_id", F.md5(escape_html(F.col("html"))).alias("escaped"))


@query(
    "c17_redaction",
    "SELECT event_id, concat('{\"k\":', cast(event_id % 9 as varchar), ',\"Token\":\"[REDACTED]\",\"n\":{\"a\":[{\"password\":\"[REDACTED]\"}]}}') AS nested, '[REDACTED]' AS flat, "
    "concat('call bot<redacted> ', cast(event_id as varchar)) AS masked, event_id % 2 = 0 AS raw_secret FROM events",
)
def redaction(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    doc = F.concat(F.lit('{"k": '), (F.col("event_id") % 9).cast("string"), F.lit(', "Token": "'), n, F.lit('", "n": {"a": [{"password": '), n, F.lit("}]}}"))
    flat = R.redact_map(F.create_map(F.lit("API_KEY"), n, F.lit("x"), n))
    name = F.when(F.col("event_id") % 2 == 0, "db-password").otherwise("password_ref")
    return read_table(spark, d, "events").select(
        "event_id",
        R.redact_json(doc).alias("nested"),
        F.element_at(flat, F.lit("API_KEY")).alias("flat"),
        R.mask_token(F.concat(F.lit("call bot12:Ab_-9 "), n)).alias("masked"),
        R.has_raw_secret(F.concat(F.lit('{"a":{"'), name, F.lit('":1}}'))).alias("raw_secret"),
    )


@query(
    "c18_canonical_json",
    "SELECT event_id, concat('{\"a\":[1,null],\"k\":', regexp_extract(props, '([0-9]+)', 1), ',\"z\":{\"b\":1,\"c\":2}}') AS canonical, "
    "concat('{\"a\":', cast(event_id as varchar), ',\"b\":', CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '1.5' END, '}') AS of_map FROM events",
)
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    doc = F.concat(F.lit('{"z": {"c": 2, "b": 1}, "k": '), F.regexp_extract("props", "([0-9]+)", 1), F.lit(', "a": [1, NaN]}'))
    number = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.lit(1.5))
    of_map = F.create_map(F.lit("b"), K.json_number(number), F.lit("a"), F.col("event_id").cast("string"))
    return read_table(spark, d, "events").select(
        "event_id", R.canonical_json_text(doc).alias("canonical"), K.canonical_json(of_map).alias("of_map")
    )


@query(
    "c22_bindings",
    "SELECT key, CASE key WHEN 'location' THEN 'geo' WHEN 'balcony' THEN NULL ELSE key END AS bound_column, CASE key WHEN 'balcony' THEN 'balcony' END AS bound_attribute, "
    "concat('c', cast(min(profile_id) as varchar)) AS configured, count(*) AS n FROM filters GROUP BY key",
)
def bindings(spark: SparkSession, d: str) -> DataFrame:
    f = A.filters(spark, d).groupBy("key").agg(F.count("*").alias("n"), F.min("profile_id").cast("string").alias("m"))
    kind = F.when(F.col("key") == "balcony", "bool").otherwise("number")
    plain = resolve_binding(F.col("key"), kind, F.lit("{}"))
    own = resolve_binding(F.col("key"), kind, F.concat(F.lit('{"binding":{"column":"c'), "m", F.lit('","attribute":"x"}}')))
    return f.select(
        "key", plain["column"].alias("bound_column"), plain["attribute"].alias("bound_attribute"), own["column"].alias("configured"), "n"
    )


@query(
    "c20_number_texts",
    f"SELECT listing_id, {num_text('price')} AS price, {num_text('rooms')} AS rooms, floor(price / 50 + 0.5) AS rounded FROM live",
)
def number_texts(spark: SparkSession, d: str) -> DataFrame:
    return fr.live(spark, d).select(
        "listing_id", N.js_num(F.col("price")).alias("price"), N.js_num(F.col("rooms")).alias("rooms"), N.round_half_up(F.col("price") / 50).alias("rounded")
    )
