"""Quality gate, quarantine rows and mapping failures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellmatch.functions.keys import map_over
from dwellmatch.functions.redact import canonical_json_text
from dwellmatch.functions.text import normalize_identity
from dwellmatch.functions.urls import looks_like_url
from dwellmatch.schema import BBOX, DEAL_TYPES, RANGES, STATES

# Field names in issues; the issue texts below are fixed values as well.
ISSUE_NAMES = {
    "source_slug": "sourceSlug",
    "external_id": "externalId",
    "warm_rent": "warmRent",
    "postal_code": "postalCode",
    "deal_type": "dealType",
}


Check = tuple[Column, Column]  # (row is bad, message)


def _fmt(v: float) -> str:
    return str(int(v)) if float(v).is_integer() else str(v)


def _check(bad: Column, path: str, message: str) -> Check:
    return bad, F.lit(f"{path}: {message}")


def _required(name: str) -> list[Check]:
    c, path = F.col(name), ISSUE_NAMES.get(name, name)
    return [_check(c.isNull(), path, "Required"), _check(c == "", path, "String must contain at least 1 character(s)")]


def _length(name: str, limit: int) -> list[Check]:
    c = F.col(name)
    return [
        _check(c == "", name, "String must contain at least 1 character(s)"),
        _check(F.length(c) > limit, name, f"String must contain at most {limit} character(s)"),
    ]


def _range(c: Column, path: str, lo: float, hi: float) -> list[Check]:
    return [
        _check(c < lo, path, f"Number must be greater than or equal to {_fmt(lo)}"),
        _check(c > hi, path, f"Number must be less than or equal to {_fmt(hi)}"),
    ]


def _one_of(name: str, allowed: Sequence[str]) -> Check:
    c, path = F.col(name), ISSUE_NAMES.get(name, name)
    expected = " | ".join(f"'{a}'" for a in allowed)
    message = F.concat(F.lit(f"{path}: Invalid enum value. Expected {expected}, received '"), c, F.lit("'"))
    return ~c.isin(list(allowed)), message


def _bad_image(image: Column) -> Column:
    return ~looks_like_url(image["url"]) | (image["position"] < 0)


def _image_issues() -> Column:
    def of(image: Column, i: Column) -> Column:
        at = F.concat(F.lit("images."), i.cast("string"))
        return F.array_compact(
            F.array(
                F.when(~looks_like_url(image["url"]), F.concat(at, F.lit(".url: Invalid url"))),
                F.when(
                    image["position"] < 0,
                    F.concat(at, F.lit(".position: Number must be greater than or equal to 0")),
                ),
            )
        )

    return F.flatten(F.transform("images", of))


def gate_checks(states: Sequence[str] = STATES) -> list[Check]:
    """Every rule but the image rules, in reporting order.

    The price-or-warm-rent rule is checked unless a required value is missing or an
    enumeration value is unknown; out-of-range values do not suppress it.
    """
    has_geo = F.col("lat").isNotNull() | F.col("lng").isNotNull()
    checks = [
        *_required("source_slug"),
        *_required("external_id"),
        _check(F.col("url").isNull(), "url", "Required"),
        _check(F.col("url").isNotNull() & ~looks_like_url(F.col("url")), "url", "Invalid url"),
        *_length("title", 500),
        _one_of("deal_type", DEAL_TYPES),
    ]
    for name, (lo, hi) in RANGES.items():
        checks += _range(F.col(name), ISSUE_NAMES.get(name, name), lo, hi)
    checks += [
        *_length("city", 120),
        _one_of("bundesland", states),
        _check(~F.col("postal_code").rlike(r"^\d{5}$"), "postalCode", "PLZ must be exactly 5 digits"),
        *[c for axis in ("lat", "lng") for c in _range(F.col(axis), f"geo.{axis}", *BBOX[axis])],
        *[_check(has_geo & F.col(axis).isNull(), f"geo.{axis}", "Required") for axis in ("lat", "lng")],
    ]
    aborted = (
        F.col("source_slug").isNull()
        | F.col("external_id").isNull()
        | F.col("url").isNull()
        | (has_geo & (F.col("lat").isNull() | F.col("lng").isNull()))
        | F.coalesce(~F.col("deal_type").isin(DEAL_TYPES), F.lit(False))
        | F.coalesce(~F.col("bundesland").isin(list(states)), F.lit(False))
    )
    neither = ~aborted & F.col("price").isNull() & F.col("warm_rent").isNull()
    return [*checks, _check(neither, "price", "At least one of price or warmRent is required")]


NO_IMAGES = "cast(array() as array<struct<url:string,position:int>>)"


def quality_gate(df: DataFrame, states: Sequence[str] = STATES) -> DataFrame:
    """Add ``issues`` ('path: message' texts) and ``ok``; fill the defaults.

    One narrow projection, no exchange. Messages are built only for rows that fail.
    A mapping failure arrives as a non-null ``map_error`` and is the row's only issue.
    """
    filled = (
        df.withColumn("deal_type", F.coalesce("deal_type", F.lit("rent")))
        .withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))
        .withColumn("images", F.coalesce("images", F.expr(NO_IMAGES)))
    )
    *rules, last = gate_checks(states)
    bad = F.exists("images", _bad_image) & (F.size("images") > 0)
    for test, _ in [*rules, last]:
        bad = bad | F.coalesce(test, F.lit(False))
    texts = lambda items: F.array_compact(F.array(*[F.when(test, message) for test, message in items]))
    issues = F.concat(texts(rules), _image_issues(), texts([last]))
    if "map_error" in df.columns:
        failed = F.col("map_error").isNotNull()
        bad = failed | bad
        issues = F.when(failed, F.array(F.concat(F.lit("map failed: "), "map_error"))).otherwise(issues)
    none = F.array().cast("array<string>")
    return filled.withColumn("ok", ~bad).withColumn("issues", F.when(F.col("ok"), none).otherwise(issues))


def split_gate(gated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected); both are narrow filters of the same scan."""
    return gated.filter("ok").drop("ok", "issues"), gated.filter("not ok")


def quarantine_rows(rejected: DataFrame) -> DataFrame:
    """Rejected rows in stored shape: flag and issues in the attributes, synthetic id and
    URL where missing, no geo, no images. A row without an id is known by its whole raw text (not only by its start, so that
    different rows stay different listings)."""
    raw = canonical_json_text(F.col("raw")) if "raw" in rejected.columns else F.lit("null")
    basis = F.when(F.length(F.trim("external_id")) > 0, F.col("external_id")).otherwise(raw)
    key = F.sha2(normalize_identity(F.concat_ws("|", "source_slug", basis)), 256)
    extra = F.create_map(
        F.lit("_quarantine"), F.lit("true"), F.lit("_quality_issues"), F.to_json("issues")
    )
    return (
        rejected.withColumn("_key", key)
        .withColumn("external_id", F.coalesce(F.nullif("external_id", F.lit("")), "_key"))
        .withColumn("url", F.coalesce("url", F.concat(F.lit("https://quarantine.local/"), "source_slug", F.lit("/"), "_key")))
        .withColumn("attributes", map_over(F.col("attributes"), extra))
        .withColumn("lat", F.lit(None).cast("double"))
        .withColumn("lng", F.lit(None).cast("double"))
        .withColumn("images", F.expr(NO_IMAGES))
        .drop("ok", "issues", "_key")
    )


def gated_rows(gated: DataFrame) -> DataFrame:
    """Valid and quarantined rows as one frame with a ``quarantined`` flag.

    Same result as ``split_gate`` + ``quarantine_rows`` + union, without reading twice;
    for rows that carry an external id. ``stored_rows`` also takes rows without one.
    """
    bad = ~F.col("ok")
    extra = F.create_map(F.lit("_quarantine"), F.lit("true"), F.lit("_quality_issues"), F.to_json("issues"))
    none = F.expr(NO_IMAGES)
    return (
        gated.withColumn("quarantined", bad)
        .withColumn("attributes", F.when(bad, map_over(F.col("attributes"), extra)).otherwise(F.col("attributes")))
        .withColumn("lat", F.when(~bad, F.col("lat")))
        .withColumn("lng", F.when(~bad, F.col("lng")))
        .withColumn("images", F.when(bad, none).otherwise(F.col("images")))
        .drop("ok", "issues")
    )


def stored_rows(gated: DataFrame) -> DataFrame:
    """``gated_rows`` for feeds in which the external id may be missing.

    Only the nameless rows pass through the raw-text key.
    """
    nameless = F.length(F.coalesce("external_id", F.lit(""))) == 0
    named = gated_rows(gated.filter(~nameless))
    rest = quarantine_rows(gated.filter(nameless)).withColumn("quarantined", F.lit(True))
    return named.unionByName(rest, allowMissingColumns=True)


def issue_counts(gated: DataFrame) -> DataFrame:
    return gated.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))

