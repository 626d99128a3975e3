"""Identity keys: fingerprints, dedupe keys, safe version parts, canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dwellmatch.functions.numbers import js_num, round_half_up
from dwellmatch.functions.text import normalize_identity


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def identity_basis(
    source: Column, external: Column, postal: Column, area: Column, rooms: Column, price: Column, warm: Column, title: Column
) -> Column:
    by_id = F.concat(source, F.lit("|"), external)
    by_content = F.concat_ws(
        "|",
        source,
        _blank(postal),
        _blank(js_num(area)),
        _blank(js_num(rooms)),
        _blank(js_num(F.coalesce(price, warm))),
        _blank(title),
    )
    return F.when(F.length(F.trim(external)) > 0, by_id).otherwise(by_content)


def fingerprint(df_cols: dict[str, Column] | None = None, ascii_only: bool = False) -> Column:
    """sha256 over source and external id, or over the content where the id is blank."""
    names = ["source_slug", "external_id", "postal_code", "area", "rooms", "price", "warm_rent", "title"]
    c = {n: F.col(n) for n in names} | (df_cols or {})
    return F.sha2(normalize_identity(identity_basis(*[c[n] for n in names]), ascii_only), 256)


def soft_identity(ascii_only: bool = True) -> Column:
    """What a cross-source group has in common: postal code, area to 2, rooms, price to 50."""
    basis = F.concat_ws(
        "|",
        _blank(F.col("postal_code")),
        _blank(js_num(round_half_up(F.col("area") / 2) * 2)),
        _blank(js_num(F.col("rooms"))),
        _blank(js_num(round_half_up(F.col("price") / 50) * 50)),
    )
    return normalize_identity(basis, ascii_only)


def soft_fingerprint(ascii_only: bool = True) -> Column:
    """Cross-source group key: the digest of ``soft_identity``."""
    return F.sha2(soft_identity(ascii_only), 256)


def delivery_key(subscription: Column, listing: Column) -> Column:
    return F.concat(F.lit("telegram:"), F.sha2(F.concat_ws(":", subscription, listing), 256))


def reply_key(profile: Column, listing: Column) -> Column:
    return F.concat(F.lit("seller_reply:"), F.sha2(F.concat_ws(":", profile, listing), 256))


def iso_time(ts: Column) -> Column:
    """UTC instant as 2024-01-31T10:00:00.000Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def safe_part(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9_-]", "-")


def job_key(prefix: str, listing: Column, event: Column, version: Column) -> Column:
    """Idempotence key of one event."""
    return F.concat_ws("-", F.lit(prefix), listing, F.coalesce(safe_part(version), event))


def canonical_json(attributes: Column) -> Column:
    """Object text with sorted keys from a map of key → JSON text; null map is null."""
    entries = F.array_sort(F.map_entries(attributes))
    pairs = F.transform(
        entries, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.coalesce(e["value"], F.lit("null")))
    )
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def json_string(c: Column) -> Column:
    """JSON string literal of a text column."""
    body = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNotNull(), F.substring(body, F.lit(6), F.length(body) - 6))


def json_number(c: Column) -> Column:
    """JSON number text; not-a-number and infinities are null."""
    d = c.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), js_num(d))


def map_over(below: Column, above: Column) -> Column:
    """Both maps in one; ``above`` wins on shared keys, whatever the session's policy."""
    kept = F.map_filter(below, lambda k, _: ~F.array_contains(F.map_keys(above), k))
    return F.map_concat(kept, above)
