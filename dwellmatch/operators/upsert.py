"""Change-detecting upsert of listing versions: snapshot, history, events, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellmatch.functions.keys import canonical_json, fingerprint, iso_time, soft_identity
from dwellmatch.functions.numbers import js_num
from dwellmatch.operators.skew import MIN_ROWS, SHARE, KeyedHistory
from dwellmatch.schema import BOOLEAN_ATTRIBUTES, STORED_DECIMALS

TEXT_FIELDS = ["url", "title", "city", "bundesland", "postal_code"]
NUMBER_FIELDS = ["price", "warm_rent", "area", "rooms"]
# Fields whose change is always worth a new look by the matcher.
SIGNIFICANT_FIELDS = ["area", "rooms", "city", "bundesland", "postal_code"]
DIFF_FIELDS = ["url", "title", "price", "warm_rent", "area", "rooms", "city", "bundesland", "postal_code", "attributes"]


def stored_numbers(df: DataFrame) -> DataFrame:
    """Numbers rounded to the stored decimals, so that only real changes differ."""
    for name, kind in STORED_DECIMALS.items():
        df = df.withColumn(name, F.col(name).cast(kind).cast("double"))
    return df


def with_identity(df: DataFrame, ascii_only: bool = False) -> DataFrame:
    return df.withColumn("fingerprint", fingerprint(ascii_only=ascii_only))


def resolve_existing(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Add ``listing_id`` and the stored last-seen time: found by (source, external id),
    else by fingerprint; a new listing takes its fingerprint as id."""
    by_id = stored.select("source_slug", "external_id", F.col("listing_id").alias("_a"), F.col("last_seen_at").alias("_ta"))
    by_fp = stored.select("fingerprint", F.col("listing_id").alias("_b"), F.col("last_seen_at").alias("_tb"))
    first = incoming.join(by_id, ["source_slug", "external_id"], "left")
    # Only rows that were not found go on to the second look-up.
    found = first.filter("_a is not null").withColumn("listing_id", F.col("_a")).withColumn("stored_seen_at", F.col("_ta"))
    rest = first.filter("_a is null").join(by_fp, "fingerprint", "left")
    rest = rest.withColumn("listing_id", F.coalesce("_b", "fingerprint")).withColumn("stored_seen_at", F.col("_tb"))
    return found.drop("_a", "_ta").unionByName(rest.drop("_a", "_ta", "_b", "_tb"))


def _lookups(df: DataFrame) -> Column:
    """The two keys a listing is found by: source and external id, and fingerprint."""
    by_id = F.when(F.col("source_slug").isNotNull() & F.col("external_id").isNotNull(), F.concat(F.lit("i"), F.length("source_slug").cast("string"), F.lit("|"), "source_slug", F.lit("|"), "external_id"))
    return F.array_compact(F.array(by_id, F.concat(F.lit("f|"), "fingerprint")))


def lookup_keys(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(_lookups(rows)).alias("lookup")).distinct()


def resolve_by_lookup(incoming: DataFrame, found: DataFrame) -> DataFrame:
    """As ``resolve_existing``, with the look-up rows (lookup, found_id, last_seen_at) of the incoming keys
    in place of all stored listings."""
    known = found.where("found_id is not null").select("lookup", F.struct(F.col("found_id").alias("id"), F.col("last_seen_at").alias("seen")).alias("_at"))
    keyed = incoming.withColumn("_keys", _lookups(incoming))
    by_print = known.withColumnRenamed("_at", "_p")
    first = keyed.join(known, F.when(F.size("_keys") == 2, F.col("_keys")[0]) == F.col("lookup"), "left").drop("lookup")
    both = first.join(by_print, F.concat(F.lit("f|"), "fingerprint") == F.col("lookup"), "left").drop("lookup")
    hit = F.coalesce("_at", "_p")
    return both.withColumn("listing_id", F.coalesce(hit["id"], F.col("fingerprint"))).withColumn("stored_seen_at", hit["seen"]).drop("_keys", "_at", "_p")


def changed_lookups(snapshot: DataFrame, touched: DataFrame | None) -> DataFrame:
    """Look-up rows of a batch's listings; a key that a listing no longer has is written without an id."""
    now = snapshot.select(F.explode(_lookups(snapshot)).alias("lookup"), F.struct(F.col("listing_id").alias("found_id"), "last_seen_at").alias("_at"))
    # Of listings that came to share a key the one with the smallest id is found by it.
    now = now.groupBy("lookup").agg(F.min("_at").alias("_at")).select("lookup", "_at.*")
    if touched is None:
        return now
    gone = touched.select(F.explode(_lookups(touched)).alias("lookup")).distinct().join(now.select("lookup"), "lookup", "left_anti")
    return now.unionByName(gone, allowMissingColumns=True)


def split_late(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(in order, late): rows older than the stored listing never overwrite it."""
    late = F.coalesce(F.col("seen_at") < F.col("stored_seen_at"), F.lit(False))
    return resolved.filter(~late).drop("stored_seen_at"), resolved.filter(late).drop("stored_seen_at")


def late_history(late: DataFrame) -> DataFrame:
    return late.select(
        "listing_id",
        F.lit("late").alias("field"),
        F.lit(None).cast("string").alias("old_value"),
        F.to_json(F.struct("price", "warm_rent", "area", "rooms", "city")).alias("new_value"),
        F.col("seen_at").alias("changed_at"),
    )


def _image_urls() -> Column:
    return F.transform("images", lambda i: i["url"])


def _field_text(c: Column, name: str) -> Column:
    return js_num(c) if name in NUMBER_FIELDS else c


def _changed(name: str) -> Column:
    return ~F.col(f"_prev.{name}").eqNullSafe(F.col(name))


def _changes() -> Column:
    items = []
    for name in [*DIFF_FIELDS, "geo"]:
        column = {"attributes": "attr_text", "geo": "geo_text"}.get(name, name)
        old, new = F.col(f"_prev.{column}"), F.col(column)
        row = F.struct(
            F.lit(name).alias("field"),
            _field_text(old, name).alias("old_value"),
            _field_text(new, name).alias("new_value"),
        )
        items.append(F.when(~old.eqNullSafe(new), row))
    return F.array_compact(F.array(*items))


def _significant() -> Column:
    """Whether a version deserves a changed event."""
    fell = lambda n: F.coalesce(F.col(n) < F.col(f"_prev.{n}"), F.lit(False))
    moved = _changed("geo_text")
    for name in SIGNIFICANT_FIELDS:
        moved = moved | _changed(name)
    flag = lambda m: F.array(*[F.get_json_object(m, f"$.{k}") for k in BOOLEAN_ATTRIBUTES])
    # Comparing the whole text first spares the per-key look on unchanged rows.
    flags = _changed("attr_text") & ~flag(F.col("_prev.attr_text")).eqNullSafe(flag(F.col("attr_text")))
    return fell("price") | fell("warm_rent") | moved | flags | F.col("_prev.quarantined")


def listing_versions(
    incoming: DataFrame,
    stored: DataFrame | None = None,
    seq: Sequence[str] = ("seq",),
    share: int = SHARE,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """One row per incoming version with its change list, outcome, status and event.

    ``incoming``: gated rows with listing_id, fingerprint, quarantined, seen_at and the
    ``seq`` tie-break. ``stored``: snapshot rows of earlier runs; each is the version
    before the first incoming one. Everything is look-back within a listing's ordered
    versions, so serial processing is reproduced with one shuffle by listing.

    With a boolean ``handed`` on the incoming rows, an event that was not handed over stays
    pending and goes out with the next version: a created one as created, else the newest
    changed one. Without it every event counts as handed over with its version; only the
    pending event of the stored row is taken up.
    """
    base = incoming.withColumn("_old", F.lit(0)).withColumn("stored_status", F.lit(None).cast("string"))
    base = base.withColumn("stored_pending", F.lit(None).cast("struct<event:string,version:string>"))
    if stored is not None:
        touched = stored.join(incoming.select("listing_id"), "listing_id", "left_semi")
        old = (
            touched.withColumn("_old", F.lit(1))
            .withColumn("stored_status", F.col("status"))
            .withColumn(
                "stored_pending",
                F.when(
                    F.col("pending_event").isNotNull(),
                    F.struct(F.col("pending_event").alias("event"), F.col("pending_version").alias("version")),
                ),
            )
            .withColumn("seen_at", F.col("last_seen_at"))
            .drop("status", "first_seen_at", "last_seen_at", "pending_event", "pending_version")
        )
        for name in seq:
            old = old.withColumn(name, F.lit(None).cast(incoming.schema[name].dataType))
        base = base.unionByName(old, allowMissingColumns=True)
    base = stored_numbers(base).withColumn("_new", 1 - F.col("_old"))

    hist = KeyedHistory(base, ["listing_id"], "seen_at", ["_new", "seen_at", *seq], share, min_rows)
    here = F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.struct("lat", "lng"))
    none = F.lit(None).cast("struct<lat:double,lng:double>")
    # A quarantined version clears the position, one without a position keeps it.
    mark = F.when(F.col("quarantined"), F.struct(none.alias("p"))).when(here.isNotNull(), F.struct(here.alias("p")))
    hist.add_latest("_geo", mark)
    hist.df = (
        hist.df.withColumn("lat", F.col("_geo.p.lat"))
        .withColumn("lng", F.col("_geo.p.lng"))
        .drop("_geo")
        .withColumn("geo_text", F.concat(F.col("lat").cast("string"), F.lit(","), F.col("lng").cast("string")))
        .withColumn("attr_text", canonical_json(F.col("attributes")))
        .withColumn("image_urls", _image_urls())
    )
    fields = [*TEXT_FIELDS, *NUMBER_FIELDS, "geo_text", "attr_text", "image_urls", "quarantined", "stored_status", "stored_pending"]
    hist.add_previous("_prev", F.struct(*fields))

    revived = ~F.col("quarantined") & ~F.col("_prev.quarantined") & F.col("_prev.stored_status").isin("expired", "removed")
    exists = F.col("_prev").isNotNull()
    hist.df = (
        hist.df.withColumn("changes", F.when(exists, _changes()))
        .withColumn("images_changed", exists & _changed("image_urls"))
        .withColumn("revived", F.coalesce(revived, F.lit(False)))
        .withColumn(
            "significant",
            exists & ~F.col("quarantined") & (F.col("revived") | F.coalesce(_significant(), F.lit(False))),
        )
    )
    set_status = (
        F.when(F.col("_old") == 1, F.col("stored_status"))
        .when(F.col("quarantined"), "removed")
        .when(~exists, "active")
        .when(F.col("significant"), "updated")
    )
    hist.df = hist.df.withColumn("_set", set_status)
    hist.add_latest("status", F.col("_set"))
    hist.add_previous("prev_status", F.col("_set"))

    is_changed = (F.size("changes") > 0) | F.col("images_changed") | F.col("revived")
    outcome = F.when(~exists, "new").when(is_changed, "updated").otherwise("touched")
    if "handed" in incoming.columns:
        event, version = _with_pending(hist, exists, seq)
        return _finished(hist, outcome, event, version)
    pending = F.col("_prev.stored_pending")
    event = (
        F.when(~exists & ~F.col("quarantined"), "created")
        .when(pending["event"] == "created", "created")
        .when(F.col("significant"), "changed")
        .otherwise(pending["event"])
    )
    version = F.when(
        (F.col("event") == "changed") & F.col("significant"), iso_time(F.col("seen_at").cast("timestamp"))
    ).otherwise(pending["version"])
    return _finished(hist, outcome, event, version)


def _with_pending(hist: KeyedHistory, exists: Column, seq: Sequence[str]) -> tuple[Column, Column]:
    """Event and version of each row when earlier events may not have been handed over.

    What counts is what came up after the last row before this one that was handed over. The
    stored row comes up with its pending event.
    """
    at = F.struct("_new", "seen_at", *seq)
    stored = F.col("stored_pending")
    created = (F.col("_old") == 0) & ~exists & ~F.col("quarantined") | (stored["event"] == "created")
    own = F.when(F.col("_old") == 1, stored["version"]).otherwise(iso_time(F.col("seen_at").cast("timestamp")))
    changed = (F.col("_old") == 0) & F.col("significant") | (stored["event"] == "changed")
    hist.add_previous("_cut", F.when((F.col("_old") == 0) & F.coalesce("handed", F.lit(True)), at))
    hist.add_latest("_created", F.when(created, at))
    hist.add_latest("_changed", F.when(changed, F.struct(at.alias("at"), own.alias("version"))))
    open_ = lambda c: c.isNotNull() & (F.col("_cut").isNull() | (c > F.col("_cut")))
    event = F.when(open_(F.col("_created")), "created").when(open_(F.col("_changed.at")), "changed")
    # A created event carries no version.
    return event, F.when(F.col("event") == "changed", F.col("_changed.version"))


def _finished(hist: KeyedHistory, outcome: Column, event: Column, version: Column) -> DataFrame:
    return (
        hist.result()
        .filter("_old = 0")
        .withColumn("outcome", outcome)
        .withColumn("event", event)
        .withColumn("change_version", version)
        .withColumn("prev_images", F.col("_prev.image_urls"))
        .drop("_prev", "_old", "_new", "_set", "stored_status", "stored_pending", "geo_text", "_cut", "_created", "_changed")
    )


def history_rows(versions: DataFrame) -> DataFrame:
    """Field, status and image changes of the updated versions."""
    status = F.when(
        ~F.col("status").eqNullSafe(F.col("prev_status")),
        F.struct(
            F.lit("status").alias("field"), F.col("prev_status").alias("old_value"), F.col("status").alias("new_value")
        ),
    )
    images = F.when(
        F.col("images_changed"),
        F.struct(
            F.lit("images").alias("field"),
            F.to_json("prev_images").alias("old_value"),
            F.to_json("image_urls").alias("new_value"),
        ),
    )
    rows = F.concat("changes", F.array_compact(F.array(status, images)))
    return (
        versions.filter("outcome = 'updated'")
        .select("listing_id", F.col("seen_at").alias("changed_at"), F.inline(rows))
        .select("listing_id", "field", "old_value", "new_value", "changed_at")
    )


def match_events(versions: DataFrame) -> DataFrame:
    return versions.filter(F.col("event").isNotNull()).select(
        "listing_id", "event", "change_version", F.col("seen_at").alias("at")
    )


def undelivered(events: DataFrame, delivered: DataFrame) -> DataFrame:
    """Events whose exact (listing, event, version) was not handed over yet."""
    keys = ["listing_id", "event", "_v"]
    v = F.coalesce("change_version", F.lit(""))
    return (
        events.withColumn("_v", v)
        .join(delivered.withColumn("_v", v).select(*keys), keys, "left_anti")
        .drop("_v")
    )


SNAPSHOT_FIELDS = [
    "source_slug",
    "external_id",
    "fingerprint",
    *TEXT_FIELDS,
    "deal_type",
    *NUMBER_FIELDS,
    "lat",
    "lng",
    "attributes",
    "images",
    "quarantined",
    "status",
]


PENDING_FIELDS = ["pending_event", "pending_version"]


def snapshot(versions: DataFrame, stored: DataFrame | None = None, seq: Sequence[str] = ("seq",)) -> DataFrame:
    """Next snapshot: untouched stored rows plus the last effective version per listing.

    An unchanged version only moves last_seen_at. Versions with ``handed`` leave the event of a
    listing's last version pending if it wasn't handed over; with ``stored`` pending events of
    listings that were not seen stay. Aggregates combine before the shuffle.
    """
    at = F.struct("seen_at", *seq)
    effective = F.col("outcome") != "touched"
    fields = [f for f in SNAPSHOT_FIELDS if f in versions.columns]
    body = F.struct(*[F.col(f) for f in fields])
    latest = versions.groupBy("listing_id").agg(
        F.max_by(body, F.when(effective, at)).alias("b"),
        F.min(F.when(F.col("outcome") == "new", F.col("seen_at"))).alias("first_seen_at"),
        F.max("seen_at").alias("last_seen_at"),
        F.max_by(_pending(versions), at).alias("p"),
    )
    keeps = "handed" in versions.columns
    pending = [F.col(f"p.{c}").alias(c) for c in PENDING_FIELDS] if keeps else []
    if stored is None:
        return latest.select("listing_id", "b.*", "first_seen_at", "last_seen_at", *pending)
    old = stored.select(
        "listing_id", F.struct(*[F.col(f) for f in fields]).alias("_ob"), F.col("first_seen_at").alias("_of"), F.col("last_seen_at").alias("_ol"),
        *([F.struct(*PENDING_FIELDS).alias("_op")] if keeps else []),
    )
    merged = old.join(latest, "listing_id", "full_outer")
    body = F.coalesce("b", "_ob")
    if keeps:
        left = F.when(F.col("last_seen_at").isNull(), F.col("_op")).otherwise(F.col("p"))
        pending = [left[c].alias(c) for c in PENDING_FIELDS]
    return merged.select(
        "listing_id",
        *[body[f].alias(f) for f in fields],
        F.coalesce("_of", "first_seen_at").alias("first_seen_at"),
        F.coalesce("last_seen_at", "_ol").alias("last_seen_at"),
        *pending,
    )


def _pending(versions: DataFrame) -> Column:
    """The event that a version leaves pending."""
    left = F.col("event").isNotNull() & ~F.coalesce("handed", F.lit(True)) if "handed" in versions.columns else F.lit(False)
    return F.struct(F.when(left, F.col("event")).alias("pending_event"), F.when(left, F.col("change_version")).alias("pending_version"))


def clear_pending(listings: DataFrame, delivered: DataFrame) -> DataFrame:
    """``listings`` without the pending events of ``delivered`` (listing_id, event, change_version).

    A delivery clears exactly what it delivered: one of another event or version, overtaken by a later
    change, clears nothing. Deliveries may repeat.
    """
    version = lambda c: F.coalesce(c, F.lit(""))
    done = delivered.where("event is not null").select("listing_id", F.col("event").alias("pending_event"), version("change_version").alias("_v"), F.lit(True).alias("_done")).distinct()
    marked = listings.withColumn("_v", version("pending_version")).join(done, ["listing_id", "pending_event", "_v"], "left")
    kept = {c: F.when(F.col("_done").isNull(), F.col(c)).alias(c) for c in PENDING_FIELDS}
    return marked.select(*[kept.get(c, F.col(c)) for c in listings.columns])


def run_counters(versions: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Fetched, new, updated and error counts per source, with the run's final status."""
    counts = versions.groupBy("source_slug").agg(
        F.count("*").alias("items_fetched"),
        F.count_if(F.col("outcome") == "new").alias("items_new"),
        F.count_if(F.col("outcome") == "updated").alias("items_updated"),
    )
    if errors is None:
        counts = counts.withColumn("errors", F.lit(0).cast("long"))
    else:
        failed = errors.groupBy("source_slug").agg(F.count("*").alias("errors"))
        counts = counts.join(failed, "source_slug", "full_outer").fillna(0)
    return counts.withColumn("status", F.when(F.col("errors") > 0, "partial").otherwise("success"))


def duplicate_groups(listings: DataFrame) -> DataFrame:
    """Soft groups across sources: size, smallest id, number of sources.

    Counts only: no group is gathered in one place, whatever its size. Rows are grouped by what the
    digest is made of, which is shorter and compresses; the digest is made once for each group.
    """
    return (
        listings.groupBy(soft_identity().alias("_same"))
        .agg(
            F.min("listing_id").alias("group_id"),
            F.count("*").alias("listings"),
            F.count_distinct("source_slug").alias("sources"),
        )
        .select(F.sha2("_same", 256).alias("soft_fingerprint"), "group_id", "listings", "sources", (F.col("sources") > 1).alias("cross_source"))
    )


def expire(listings: DataFrame, as_of: Column, max_age: str) -> tuple[DataFrame, DataFrame]:
    """(listings with unseen ones expired, history rows of the expiry)."""
    stale = F.col("status").isin("active", "updated") & (F.col("last_seen_at") < as_of - F.expr(f"interval {max_age}"))
    rows = listings.filter(stale).select(
        "listing_id",
        F.lit("status").alias("field"),
        F.col("status").alias("old_value"),
        F.lit("expired").alias("new_value"),
        as_of.alias("changed_at"),
    )
    return listings.withColumn("status", F.when(stale, "expired").otherwise(F.col("status"))), rows


def retention_split(df: DataFrame, removed: Column, time: str, as_of: Column, keep: str) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): archived rows satisfy ``removed`` and are older than ``keep``; both carry a month column."""
    old = F.coalesce(removed & (F.col(time) < as_of - F.expr(f"interval {keep}")), F.lit(False))
    dated = df.withColumn("month", F.date_format(time, "yyyy-MM"))
    return dated.filter(~old), dated.filter(old)
