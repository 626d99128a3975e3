"""JSON feeds and pages with embedded JSON → raw listing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dwellmatch.functions.numbers import naive_number
from dwellmatch.functions.text import let, text_or_null
from dwellmatch.operators.skew import latest_per_key

SEARCH_BODY = (
    "results array<struct<adid:string,url:string,title:string,price:string,description:string,published_at:string>>"
)
DETAIL_BODY = (
    "data struct<location:struct<zip:string,city:string>,description:string,images:array<string>,details:map<string,string>>"
)
PORTAL_BODY = (
    "results array<struct<id:string,url:string,title:string,price:double,city:string,area:double,rooms:double,postalCode:string,street:string>>"
)
MIN_PRICE = 50.0  # fixed value


def read_json_feed(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def cap_per_area(rows: DataFrame, area: str, order: list[str], per_area: int | None, total: int | None) -> DataFrame:
    """Item budget: per area when several areas are collected, else one overall cap."""
    if per_area is not None:
        w = Window.partitionBy(area).orderBy(*order)
        return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= per_area).drop("_rn")
    return rows if total is None else rows.orderBy(*order).limit(total)


def marketplace_rows(search: DataFrame, details: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """Search pages joined with detail bodies by ad id.

    ``search``: area_key, body. ``details``: adid, body. ``areas``: area_key, location,
    lat, lng. Items under the minimum price drop out; a missing detail is tolerated.
    """
    items = search.select(
        "area_key", F.posexplode(F.from_json("body", SEARCH_BODY)["results"]).alias("pos", "r")
    ).select("area_key", "pos", "r.*")
    items = items.withColumn("price", F.col("price").try_cast("double")).filter(F.col("price") >= MIN_PRICE)
    d = details.select("adid", F.from_json("body", DETAIL_BODY)["data"].alias("d"))
    fact = lambda *names: F.coalesce(*[F.element_at("d.details", F.lit(n)) for n in names])
    # Read before the join, so that no body is moved as a whole.
    d = d.select(
        "adid",
        naive_number(fact("Wohnfläche", "Wohnflaeche", "Fläche")).alias("area"),
        naive_number(fact("Zimmer", "Zimmeranzahl")).alias("rooms"),
        F.col("d.images").alias("images"),
        F.col("d.description").alias("full_description"),
        F.col("d.location.zip").alias("postal_code"),
    )
    rows = items.join(d, "adid", "left").select(
        "area_key",
        "pos",
        "adid",
        "url",
        F.coalesce("title", F.lit("")).alias("title"),
        "price",
        F.coalesce("description", F.lit("")).alias("description"),
        "published_at",
        "area",
        "rooms",
        F.coalesce("images", F.array().cast("array<string>")).alias("images"),
        F.coalesce("full_description", F.lit("")).alias("full_description"),
        F.coalesce("postal_code", F.lit("")).alias("postal_code"),
    )
    return rows if areas is None else stamp_area(rows, areas)


def stamp_area(rows: DataFrame, areas: DataFrame) -> DataFrame:
    """City and centre of the area a row was collected for."""
    return rows.join(areas.select("area_key", F.col("location").alias("city"), "lat", "lng"), "area_key", "left")


def portal_rows(pages: DataFrame, city: str | None = None) -> DataFrame:
    """Portal API bodies → rows with price at or above the minimum. ``pages``: body."""
    r = pages.select(F.explode(F.from_json("body", PORTAL_BODY)["results"]).alias("r")).select("r.*")
    address = F.concat("street", F.lit(", "), F.coalesce("postalCode", F.lit("")), F.lit(" "), F.coalesce("city", F.lit("")))
    return r.filter(F.col("price") >= MIN_PRICE).select(
        F.col("id").alias("adid"),
        "url",
        F.coalesce("title", F.lit("")).alias("title"),
        "price",
        F.coalesce("city", F.lit(city)).alias("city"),
        "area",
        "rooms",
        F.coalesce("postalCode", F.lit("")).alias("postal_code"),
        F.coalesce(F.when(F.length("street") > 0, address), F.lit("")).alias("description"),
    )


# Up to the first end: runs of other characters are taken whole, not one character at a time.
_SCRIPT = r'<script[^>]*type="application/json"[^>]*>((?:[^<]++|<(?!/script>))*+)</script>'
_MODEL = r"resultListModel\s*:\s*(\{(?:[^}]++|\}(?!;\s*\n))*+\});\s*\n"


def _scripts(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(_SCRIPT), 1)


def embedded_rows(pages: DataFrame, base_url: str, city: str) -> DataFrame:
    """First embedded JSON block that speaks of estates; two layouts; rows without id drop.

    ``pages``: page_id, html.
    """
    block = F.get(
        F.filter(
            _scripts(F.col("html")),
            lambda b: b.contains('"estate"') | b.contains('"estateListModel"') | b.contains('"searchresults"'),
        ),
        F.lit(0),
    )
    data = F.try_parse_json(F.regexp_replace(block, "<[^>]*>", ""))
    at = lambda d, name: F.try_variant_get(d, f"$.{name}.estates", "array<variant>")
    estates = let(data, lambda d: F.coalesce(at(d, "estateListModel"), at(d, "searchresults")))
    text = lambda n: F.try_variant_get("e", f"$.{n}", "string")
    number = lambda n: F.nullif(text(n).try_cast("double"), F.lit(0.0))
    rows = pages.select("page_id", F.posexplode(estates).alias("pos", "e"))
    return rows.select(
        "page_id",
        "pos",
        text("estateId").alias("adid"),
        F.concat(F.lit(f"{base_url}/expose/"), text("estateId")).alias("url"),
        F.coalesce(text("headline"), text("title"), F.lit("")).alias("title"),
        number("mainPrice").alias("price"),
        F.lit(city).alias("city"),
        number("livingArea").alias("area"),
        number("numberOfRooms").alias("rooms"),
        F.coalesce(text("postalCode"), F.lit("")).alias("postal_code"),
        F.coalesce(text("description"), F.lit("")).alias("description"),
    ).filter(F.length("adid") > 0)


def result_model_rows(pages: DataFrame, base_url: str) -> DataFrame:
    """Result-list model inside a script: object or array of entries, first row per id wins.

    ``pages``: page_no, html.
    """
    data = F.try_parse_json(text_or_null(F.regexp_extract("html", _MODEL, 1)))
    at = "$.searchResponseModel['resultlist.resultlist'].resultlistEntries[0].resultlistEntry"
    # What is no array has none of the first type.
    entries = let(data, lambda d: F.coalesce(F.try_variant_get(d, at, "array<variant>"), F.array(F.try_variant_get(d, at, "variant"))))
    rows = pages.select("page_no", F.posexplode(entries).alias("pos", "x")).select(
        "page_no", "pos", F.try_variant_get("x", "$['resultlist.realEstate']", "variant").alias("e")
    )
    text = lambda p: F.try_variant_get("e", f"$.{p}", "string")
    number = lambda p: F.coalesce(text(p).try_cast("double"), F.lit(0.0))
    id_ = F.coalesce(F.try_variant_get("e", "$['@id']", "string"), F.lit(""))
    out = rows.filter("e is not null").select(
        "page_no",
        "pos",
        id_.alias("id"),
        F.concat(F.lit(f"{base_url}/expose/"), id_).alias("url"),
        F.coalesce(text("title"), F.lit("")).alias("title"),
        number("price.value").alias("price"),
        number("livingSpace").alias("area"),
        number("numberOfRooms").alias("rooms"),
        text("address.city").alias("city"),
        F.coalesce(text("address.postcode"), F.lit("")).alias("postal_code"),
        F.coalesce(text("address.quarter"), F.lit("")).alias("district"),
        F.trim(F.concat_ws(" ", text("address.street"), text("address.houseNumber"))).alias("street"),
    )
    # First in page order: the negated position makes the earliest row the greatest.
    ranked = out.withColumn("_o", F.struct(-F.col("page_no"), -F.col("pos")))
    return latest_per_key(ranked, ["id"], ["_o"]).drop("_o")
