"""Inverse matching: which saved searches does a listing satisfy?

Filters are rows (profile, key, operator, JSON value) read through the definition
table, so a new filter is a new row. Two evaluations share one meaning:

* ``compile_profiles`` + ``inverse_match``: one wide rule row per profile, joined to
  listings on the most selective key the profile offers. Every profile is reached by
  exactly one kind of key, so each pair appears once and no side is ever crossed.
* ``explain_pairs``: row-by-row evaluation of given pairs with the failed keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dwellmatch.functions.geo import GRIDS, circle_grid_cells, haversine_km, point_grid_cells
from dwellmatch.functions.keys import json_number, json_string
from dwellmatch.functions.numbers import js_num
from dwellmatch.operators.skew import sliced_join
from dwellmatch.schema import BOOLEAN_ATTRIBUTES, MATCHABLE_STATUSES
from dwellmatch.session import ensure_checkpoint_dir
from dwellmatch.sources.registry import bind_definitions

NUMBER_COLUMNS = ["price", "warm_rent", "area", "rooms"]
PLACE_COLUMNS = ["city", "postal_code", "bundesland"]
TEXT_COLUMNS = [*PLACE_COLUMNS, "title", "url", "deal_type", "source_slug", "external_id"]
BANDS = 4096  # number bands; the largest number falls into the last one
STEP_BITS, STEPS = 4, 4  # band hierarchy: 16 bands of a step are one of the next
_NUMBER = r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"


def _canonical(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), js_num(text.try_cast("double"))).otherwise(text)


def typed_filters(filters: DataFrame, definitions: DataFrame) -> DataFrame:
    """Filter rows with their binding and typed values.

    The JSON type decides: a quoted "2" has no number value. ``usable`` is false for
    unknown or inactive keys, operators outside the definition and malformed circles:
    such a filter fails for every listing.
    """
    value = F.col("value_json")
    circle = F.from_json(value, "lat double, lng double, radius_km double")
    # JSON strings in the numeric members are refused.
    strict = ~value.rlike(r'"(?:lat|lng|radius_km)"\s*:\s*"')
    circle_ok = (
        circle["lat"].between(-90, 90) & circle["lng"].between(-180, 180) & (circle["radius_km"] > 0) & strict
    )
    items = F.transform(F.try_parse_json(value).try_cast("array<variant>"), lambda v: _canonical(F.to_json(v)))
    is_circle = (F.col("data_type") == "geo") & (F.col("operator") == "within")
    bound = F.col("bound_column").isNotNull() | F.col("bound_attribute").isNotNull()
    scalar_ok = bound & F.col("operator").isin("eq", "gte", "lte", "in")
    usable = F.array_contains("operator_set", F.col("operator")) & F.when(is_circle, circle_ok).otherwise(scalar_ok)
    return (
        filters.join(bind_definitions(definitions), "key", "left")
        .withColumn("is_circle", F.coalesce(is_circle, F.lit(False)))
        .withColumn("usable", F.coalesce(usable, F.lit(False)))
        .withColumn("circle", F.when(F.col("is_circle"), circle))
        .withColumn("num", F.when(value.rlike(_NUMBER), value.try_cast("double")))
        .withColumn("txt", F.when(value.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"]))
        .withColumn("json", _canonical(value))
        .withColumn("items", F.when(value.startswith("["), items))
    )


def _unquote(items: Column) -> Column:
    strings = F.filter(items, lambda x: x.startswith('"'))
    return F.transform(strings, lambda x: F.from_json(F.concat(F.lit('{"v":'), x, F.lit("}")), "v string")["v"])


def compile_profiles(filters: DataFrame, definitions: DataFrame) -> DataFrame:
    """One rule row per profile that has filters.

    Columns: impossible, allowed sets per place column, lo/hi per number column, bit
    masks of required true/false attributes, one circle, and ``extra`` for the rest.
    """
    t = typed_filters(filters, definitions)
    op, column, attr = F.col("operator"), F.col("bound_column"), F.col("bound_attribute")
    is_place, is_number = column.isin(PLACE_COLUMNS), column.isin(NUMBER_COLUMNS)
    known_flag = attr.isin(BOOLEAN_ATTRIBUTES) & (op == "eq") & F.col("json").isin("true", "false")
    role = (
        F.when(~F.col("usable"), "never")
        .when(F.col("is_circle"), "circle")
        .when(is_place & (op == "eq") & F.col("txt").isNotNull(), "place")
        .when(is_place & (op == "in") & F.col("items").isNotNull(), "place")
        .when(is_number & op.isin("gte", "lte", "eq") & F.col("num").isNotNull(), "number")
        .when(known_flag, "flag")
        .when(attr.isNotNull() | is_number | column.isin(TEXT_COLUMNS), "extra")
        .otherwise("never")
    )
    allowed = F.when(op == "in", _unquote(F.col("items"))).otherwise(F.array("txt"))
    rule = F.struct(
        column.alias("column"), attr.alias("attribute"), op.alias("operator"), F.col("json").alias("json"),
        F.col("num").alias("num"), F.col("items").alias("items"),
    )
    t = t.withColumn("role", F.coalesce(role, F.lit("never"))).withColumn("allowed", allowed).withColumn("rule", rule)
    when = lambda r, c: F.when(F.col("role") == r, c)
    aggs = [
        F.max(F.col("role") == "never").alias("impossible"),
        F.min_by(when("circle", F.col("circle")), F.when(F.col("role") == "circle", F.col("position"))).alias("circle"),
        F.collect_list(when("circle", F.col("circle"))).alias("circles"),
        F.collect_list(when("extra", F.col("rule"))).alias("extra"),
    ]
    for name in PLACE_COLUMNS:
        aggs.append(F.collect_list(when("place", F.when(column == name, F.col("allowed")))).alias(f"_{name}"))
    for name in NUMBER_COLUMNS:
        here = when("number", F.when(column == name, F.col("num")))
        aggs.append(F.max(F.when(op.isin("gte", "eq"), here)).alias(f"{name}_lo"))
        aggs.append(F.min(F.when(op.isin("lte", "eq"), here)).alias(f"{name}_hi"))
    for word in ("true", "false"):
        bits = F.lit(0)
        for i, name in enumerate(BOOLEAN_ATTRIBUTES):
            hit = (F.col("role") == "flag") & (attr == name) & (F.col("json") == word)
            bits = F.when(hit, F.lit(1 << i)).otherwise(bits)
        aggs.append(F.bit_or(bits).alias(f"need_{word}"))
    out = t.groupBy("profile_id").agg(*aggs)
    for name in PLACE_COLUMNS:
        sets = F.col(f"_{name}")
        both = F.aggregate(sets, F.array_distinct(F.get(sets, F.lit(0))), lambda a, x: F.array_intersect(a, x))
        out = out.withColumn(f"{name}_in", F.when(F.size(sets) > 0, both)).drop(f"_{name}")
    more = F.filter("circles", lambda c: ~c.eqNullSafe(F.col("circle")))
    return (
        out.withColumn("more_circles", F.when(F.size(more) > 0, more))
        .withColumn("extra", F.when(F.size("extra") > 0, F.col("extra")))
        .drop("circles")
    )


def rule_rows(profiles: DataFrame, filters: DataFrame, definitions: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Compiled rules of the active profiles, with the columns of the profile named in ``carry``; a
    profile without filters matches everything."""
    rules = compile_profiles(filters, definitions)
    active = profiles.filter("is_active").select("profile_id")
    if carry:
        active = active.join(profiles.select("profile_id", *carry), "profile_id")
    return (
        active
        .join(rules, "profile_id", "left")
        .filter(~F.coalesce("impossible", F.lit(False)))
        .drop("impossible")
        .fillna(0, ["need_true", "need_false"])
    )


def number_band(c: Column) -> Column:
    """Band of a number, without an upper end: a quarter of a doubling from an eighth upwards; every
    number below (negative ones too) is in the first band."""
    return F.least(F.floor(F.log2(F.greatest(c * 8, F.lit(1.0))) * 4), F.lit(BANDS - 1)).cast("int")


def _range_keys(lo: Column, hi: Column) -> Column:
    """Keys of the bands of [lo, hi]; an open end costs no more than a bound."""
    last = F.when(hi.isNull(), F.lit(BANDS - 1)).otherwise(number_band(hi))
    return _bands_between(F.when(lo.isNull(), F.lit(0)).otherwise(number_band(lo)), last)


def _bands_between(first: Column, last: Column) -> Column:
    """Keys "step:band" that cover the bands from ``first`` to ``last``.

    From each step, only the bands outside whole bands of the next step are taken: at most 30 keys
    a step.
    """
    none = F.array().cast("array<int>")
    between = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(none)
    live = first <= last
    out = []
    for step in range(STEPS):
        up_first = F.shiftright(first + F.lit((1 << STEP_BITS) - 1), STEP_BITS)
        up_last = F.shiftright(last + F.lit(1), STEP_BITS) - F.lit(1)
        if step < STEPS - 1:
            higher = live & (up_first <= up_last)
            ends = F.concat(between(first, up_first * (1 << STEP_BITS) - 1), between((up_last + 1) * (1 << STEP_BITS), last))
            here = F.when(higher, ends).when(live, between(first, last)).otherwise(none)
        else:
            higher, here = F.lit(False), F.when(live, between(first, last)).otherwise(none)
        out.append(_with_step(here, step))
        first, last, live = up_first, up_last, higher
    return F.concat(*out)


def _with_step(bands: Column, step: int) -> Column:
    return F.transform(bands, lambda x: F.concat(F.lit(f"{step}:"), x.cast("string")))


def _band_keys(c: Column) -> list[Column]:
    """One key per step for a listing's number."""
    band = number_band(c)
    return [F.concat(F.lit(f"{step}:"), F.shiftright(band, STEP_BITS * step).cast("string")) for step in range(STEPS)]


def _cell_key(c: Column) -> Column:
    return F.concat_ws("|", c["g"], c["i"], c["j"])


def profile_keys(rules: DataFrame) -> DataFrame:
    """Rules with (path, key) rows: the inverted index over saved searches.

    Order of preference: place sets, circle cells, ranges, a required attribute, and one common key
    for a profile that offers nothing. A rule has as many keys as its sets have values, at most 100
    cells for a circle of any size, and at most 120 bands for a range of any length.
    """
    c = F.col("circle")
    paths = [
        ("city", F.col("city_in").isNotNull(), F.col("city_in")),
        ("postal_code", F.col("postal_code_in").isNotNull(), F.col("postal_code_in")),
        ("circle", c.isNotNull(), F.transform(circle_grid_cells(c["lat"], c["lng"], c["radius_km"]), _cell_key)),
        ("bundesland", F.col("bundesland_in").isNotNull(), F.col("bundesland_in")),
    ]
    for name in NUMBER_COLUMNS:
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        paths.append((name, lo.isNotNull() | hi.isNotNull(), _range_keys(lo, hi)))
    flags = lambda mask, word: [
        F.when(F.col(mask).bitwiseAND(F.lit(1 << i)) != 0, F.lit(f"{k}={word}")) for i, k in enumerate(BOOLEAN_ATTRIBUTES)
    ]
    first_flag = F.coalesce(*flags("need_true", "true"), *flags("need_false", "false"))
    paths.append(("flag", first_flag.isNotNull(), F.array(first_flag)))
    path, keys = F.lit("any"), F.array(F.lit("*"))
    for name, test, values in reversed(paths):
        path = F.when(test, F.lit(name)).otherwise(path)
        keys = F.when(test, values).otherwise(keys)
    return rules.withColumn("path", path).withColumn("key", F.explode(keys))


def match_columns(listings: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """The columns matching reads and those named in ``carry``, with attribute bit masks instead of map look-ups."""
    masks = {}
    for word in ("true", "false"):
        bits = F.lit(0)
        for i, name in enumerate(BOOLEAN_ATTRIBUTES):
            hit = F.element_at("attributes", F.lit(name)) == word
            bits = bits + F.when(hit, F.lit(1 << i)).otherwise(F.lit(0))
        masks[f"is_{word}"] = bits
    wanted = ["listing_id", *TEXT_COLUMNS, *NUMBER_COLUMNS, "lat", "lng", "attributes"]
    wanted += [c for c in carry if c not in wanted]
    return listings.select(*[c for c in wanted if c in listings.columns]).withColumns(masks)


def listing_keys(listings: DataFrame, used: set[tuple[str, str | None]]) -> DataFrame:
    """Listings repeated once per key kind in ``used``: (path, key of a flag or None)."""
    paths = {path for path, _ in used}
    keys = [(n, F.col(n)) for n in PLACE_COLUMNS]
    here = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    cells = point_grid_cells(F.col("lat"), F.col("lng"))
    keys += [("circle", F.when(here, _cell_key(F.get(cells, F.lit(g))))) for g in range(len(GRIDS))]
    for name in NUMBER_COLUMNS:
        keys += [(name, F.when(F.col(name).isNotNull(), k)) for k in _band_keys(F.col(name))]
    for i, name in enumerate(BOOLEAN_ATTRIBUTES):
        for word in ("true", "false"):
            if ("flag", f"{name}={word}") in used:
                has = F.col(f"is_{word}").bitwiseAND(F.lit(1 << i)) != 0
                keys.append(("flag", F.when(has, F.lit(f"{name}={word}"))))
    keys.append(("any", F.lit("*")))
    # No array_compact here: its lambda would keep the explode out of generated code.
    rows = [F.struct(F.lit(path).alias("path"), key.alias("key")) for path, key in keys if path in paths]
    return (
        listings.withColumn("_k", F.explode(F.array(*rows)))
        .withColumn("path", F.col("_k.path"))
        .withColumn("key", F.col("_k.key"))
        .drop("_k")
        .filter(F.col("key").isNotNull())
    )


def crowded_keys(keyed: DataFrame, tasks: int) -> DataFrame:
    """(path, key, slices) of the keys that hold more than one task's share of the rows.

    No more rows than there are tasks, whatever the data, so it can be broadcast. The keys are
    counted once, into a checkpoint.
    """
    ensure_checkpoint_dir(keyed.sparkSession)
    counts = keyed.groupBy("path", "key").agg(F.count("*").alias("n")).checkpoint()
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(1, total // tasks)
    return counts.filter(F.col("n") > share).select("path", "key", F.ceil(F.col("n") / share).cast("int").alias("slices"))


def _field_json(rule: Column) -> Column:
    """JSON text of the listing value a rule reads."""
    value = F.element_at("attributes", rule["attribute"])
    for name in TEXT_COLUMNS:
        value = F.when(rule["column"] == name, json_string(F.col(name))).otherwise(value)
    for name in NUMBER_COLUMNS:
        value = F.when(rule["column"] == name, json_number(F.col(name))).otherwise(value)
    return value


def scalar_passes(rule: Column) -> Column:
    """Type-strict comparison of one rule with the listing columns in scope."""
    have = _field_json(rule)
    number = F.when(have.rlike(_NUMBER), have.try_cast("double"))
    op = rule["operator"]
    hit = (
        F.when(op == "eq", have == rule["json"])
        .when(op == "gte", number >= rule["num"])
        .when(op == "lte", number <= rule["num"])
        .when(op == "in", F.array_contains(rule["items"], have))
    )
    return F.coalesce(hit, F.lit(False))


def _circle_passes(circle: Column) -> Column:
    inside = haversine_km(F.col("lat"), F.col("lng"), circle["lat"], circle["lng"]) <= circle["radius_km"]
    return F.coalesce(inside, F.lit(False))


def residual(with_extra: bool = True) -> Column:
    """All conditions of a rule on listing columns in scope; cheap ones first."""
    cond = F.lit(True)
    for name in NUMBER_COLUMNS:
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        cond = cond & (lo.isNull() | (F.col(name) >= lo)) & (hi.isNull() | (F.col(name) <= hi))
    for word in ("true", "false"):
        need = F.col(f"need_{word}")
        cond = cond & (need.bitwiseAND(F.col(f"is_{word}")) == need)
    for name in PLACE_COLUMNS:
        allowed = F.col(f"{name}_in")
        # The join key already decides the path's own column.
        cond = cond & (allowed.isNull() | (F.col("path") == name) | F.array_contains(allowed, F.col(name)))
    cond = cond & (F.col("circle").isNull() | _circle_passes(F.col("circle")))
    if with_extra:
        cond = cond & (F.col("more_circles").isNull() | F.forall("more_circles", _circle_passes))
        cond = cond & (F.col("extra").isNull() | F.forall("extra", scalar_passes))
    return cond


def inverse_match(
    listings: DataFrame,
    profiles: DataFrame,
    filters: DataFrame,
    definitions: DataFrame,
    slices: int | None = None,
    carry: Sequence[str] = (),
    carry_profile: Sequence[str] = (),
) -> DataFrame:
    """(profile_id, listing_id) of every active profile a listing satisfies.

    Columns of the listing named in ``carry``, and of the profile in ``carry_profile``, come with each
    pair: there are far more pairs than either, so joining them on afterwards would move every pair.

    A listing with a status column takes part only while active or updated. A key that
    holds more than one task's share of the listings (one city, one price band) is cut into
    slices by a count of the listings' keys: a listing falls into one slice, and only the rules
    under such a key are repeated. ``slices`` cuts every key into as many instead. The rule
    side is broadcast only when Spark's own size check allows it.

    The columns that matching reads are checkpointed, since the count and the joins read them:
    what makes the listings runs once, and the plan keeps its size estimates.
    """
    if "status" in listings.columns:
        listings = listings.filter(F.col("status").isin(MATCHABLE_STATUSES))
    ensure_checkpoint_dir(listings.sparkSession)
    rules = profile_keys(rule_rows(profiles, filters, definitions, carry_profile).checkpoint())
    fields = match_columns(listings, carry)
    out = ["profile_id", "listing_id", *carry, *carry_profile]
    odd = "extra is not null or more_circles is not null"
    # Key kinds in use: at most nine paths and eighteen flags for either group of rules.
    flag = F.when(F.col("path") == "flag", F.col("key"))
    kinds = rules.select("path", flag.alias("flag"), F.expr(odd).alias("odd")).distinct().collect()
    tasks = int(listings.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    used = {odd_ones: {(r["path"], r["flag"]) for r in kinds if r["odd"] == odd_ones} for odd_ones in (False, True)}
    if slices is None:
        fields, read = fields.checkpoint(), {*PLACE_COLUMNS, *NUMBER_COLUMNS, "lat", "lng"}
        counted = fields.drop("title", "url", "deal_type", "source_slug", "external_id", "attributes", *[c for c in carry if c not in read])
        crowded = F.broadcast(crowded_keys(listing_keys(counted, used[False] | used[True]).select("path", "key"), tasks))

    def join(part: DataFrame, with_extra: bool) -> DataFrame:
        narrow = [c for c in fields.columns if with_extra or c not in ("attributes", *TEXT_COLUMNS) or c in PLACE_COLUMNS or c in carry]
        keyed = listing_keys(fields.select(narrow), used[with_extra])
        if slices is None:
            keyed, part = (x.join(crowded, ["path", "key"], "left").withColumn("slices", F.coalesce("slices", F.lit(1))) for x in (keyed, part))
        else:
            keyed, part = (x.withColumn("slices", F.lit(slices)) for x in (keyed, part))
        keyed = keyed.withColumn("slice", F.pmod(F.xxhash64("listing_id", F.lit("slice")), F.col("slices")).cast("int")).drop("slices")
        part = part.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
        keys = ["path", "key", "slice"]
        right = part.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in part.columns])
        same = residual(with_extra)
        for k in keys:
            same = same & (F.col(k) == F.col(f"_r_{k}"))
        return keyed.join(right, same).select(*out)

    # Free-form conditions need array lambdas, which would keep the whole join out of
    # generated code; the rare profiles that have them are joined apart.
    parts = []
    for is_odd in (False, True):
        if used[is_odd]:
            some = rules.filter(odd if is_odd else f"not ({odd})")
            parts.append(join(some if is_odd else some.drop("extra", "more_circles"), is_odd))
    if not parts:
        types = dict(listings.dtypes)
        return rules.select("profile_id", F.lit("").alias("listing_id"), *[F.lit(None).cast(types[c]).alias(c) for c in carry], *carry_profile).limit(0)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def still_matched(pairs: DataFrame, listings: DataFrame, profiles: DataFrame, filters: DataFrame, definitions: DataFrame) -> DataFrame:
    """Those of the given (profile_id, listing_id) pairs, once each, that ``inverse_match`` has.

    Each pair is brought together with its listing and its rule, so work grows with the pairs asked for.
    """
    if "status" in listings.columns:
        listings = listings.filter(F.col("status").isin(MATCHABLE_STATUSES))
    ensure_checkpoint_dir(listings.sparkSession)
    rules = rule_rows(profiles, filters, definitions).checkpoint()
    with_extra = not rules.filter("extra is not null or more_circles is not null").isEmpty()
    fields = match_columns(listings)
    if not with_extra:
        rules = rules.drop("extra", "more_circles")
        fields = fields.drop("attributes", *[c for c in TEXT_COLUMNS if c not in PLACE_COLUMNS])
    asked = pairs.select("profile_id", "listing_id").distinct()
    met = asked.join(fields, "listing_id").withColumn("path", F.lit("")).join(rules, "profile_id").filter(residual(with_extra))
    return met.select("profile_id", "listing_id").distinct()


def filter_passes(f: Column | None = None) -> Column:
    """Row-by-row evaluation of one typed filter row against the listing in scope."""
    rule = F.struct(
        F.col("bound_column").alias("column"), F.col("bound_attribute").alias("attribute"),
        F.col("operator"), F.col("json"), F.col("num"), F.col("items"),
    )
    hit = F.when(~F.col("usable"), F.lit(False)).when(F.col("is_circle"), _circle_passes(F.col("circle")))
    return F.coalesce(hit.otherwise(scalar_passes(rule)), F.lit(False))


def explain_pairs(pairs: DataFrame, listings: DataFrame, filters: DataFrame, definitions: DataFrame) -> DataFrame:
    """For given (profile_id, listing_id) pairs: matched, and the failed keys in filter order.

    A pair's profile without filters is matched. Work grows with the pairs asked for.
    """
    asked = pairs.select("profile_id", "listing_id").distinct()
    typed = typed_filters(filters, definitions)
    wide = asked.join(match_columns(listings), "listing_id").join(typed, "profile_id", "left")
    failed = F.when(F.col("key").isNotNull() & ~filter_passes(), F.struct("position", "key"))
    return (
        wide.groupBy("profile_id", "listing_id")
        .agg(F.array_sort(F.collect_list(failed)).alias("_f"))
        .select(
            "profile_id",
            "listing_id",
            (F.size("_f") == 0).alias("matched"),
            F.transform("_f", lambda x: x["key"]).alias("failed_keys"),
        )
    )


def _distinct_rules(filters: DataFrame, definitions: DataFrame) -> DataFrame:
    """Usable distinct filters with the ``field`` they read; ``circle:`` stands for the position."""
    bound = F.coalesce(F.concat(F.lit("column:"), "bound_column"), F.concat(F.lit("attribute:"), "bound_attribute"))
    rules = typed_filters(filters, definitions).filter("usable").dropDuplicates(["key", "operator", "value_json"])
    return rules.withColumn("field", F.when(F.col("is_circle"), F.lit("circle:")).otherwise(bound))


def field_counts(listings: DataFrame, rules: DataFrame) -> DataFrame:
    """(field, have, lat, lng, n): listings by each distinct value of a field that the rules read, and by
    position; the empty field has all of them.

    What makes the listings runs once: the counts, which are read several times, are checkpointed.
    """
    ensure_checkpoint_dir(listings.sparkSession)
    cols = match_columns(listings)
    # Field names in use: no more than there are definitions.
    used = [r["field"] for r in rules.select("field").distinct().collect()]
    none = F.lit(None)
    row = lambda field, have, lat=none, lng=none: F.struct(
        F.lit(field).alias("field"), have.cast("string").alias("have"), lat.cast("double").alias("lat"), lng.cast("double").alias("lng")
    )
    cells = [row("", F.lit(""))]
    for field in used:
        kind, name = field.split(":", 1)
        if kind == "circle":
            here = F.col("lat").isNotNull() & F.col("lng").isNotNull()
            cells.append(row(field, F.when(here, F.lit("")), F.col("lat"), F.col("lng")))
            continue
        if kind == "attribute":
            have = F.element_at("attributes", F.lit(name))
        elif name in NUMBER_COLUMNS:
            have = json_number(F.col(name))
        elif name in TEXT_COLUMNS and name in cols.columns:
            have = json_string(F.col(name))
        else:
            continue
        cells.append(row(field, have))
    return (
        cols.select(F.inline(F.array(*cells)))
        .filter(F.col("have").isNotNull())
        .groupBy("field", "have", "lat", "lng")
        .agg(F.count("*").alias("n"))
        .checkpoint()
    )


def pass_counts(listings: DataFrame, filters: DataFrame, definitions: DataFrame) -> DataFrame:
    """How many listings pass each distinct filter (key, operator, value_json).

    No pairs are formed: listings are first counted per distinct field value (or
    position), and only distinct filters meet those counts, on equality, on value
    bucket, or on grid cell.
    """
    rules = _distinct_rules(filters, definitions)
    return _passes(rules, field_counts(listings, rules))


def _passes(rules: DataFrame, counted: DataFrame) -> DataFrame:
    key = ["key", "operator", "value_json"]
    scalar = rules.filter("not is_circle")
    counts = counted.filter("field not in ('', 'circle:')").select("field", "have", "n")
    wanted = F.when(F.col("operator") == "in", F.array_distinct("items")).otherwise(F.array("json"))
    equal = (
        scalar.filter(F.col("operator").isin("eq", "in"))
        .select(*key, "field", F.explode(wanted).alias("have"))
        .join(counts, ["field", "have"])
        .groupBy(*key)
        .agg(F.sum("n").alias("passes"))
    )

    # Distinct values and their counts in order per field, cut into bands: a band knows how much lies
    # above and below it, so a filter meets one row for all other bands and the values of its own.
    number = F.when(F.col("have").rlike(_NUMBER), F.col("have").try_cast("double"))
    values = counts.withColumn("v", number).filter("v is not null").withColumn("b", number_band(F.col("v")))
    ranged = (
        scalar.filter(F.col("operator").isin("gte", "lte") & F.col("num").isNotNull())
        .select(*key, "field", "num", number_band(F.col("num")).alias("b"))
    )
    up = F.col("operator") == "gte"
    # A field has fewer than 4096 bands; a filter takes those of one side as at most 60 keys.
    per_band = values.groupBy("field", "b").agg(F.sum("n").alias("bn"))
    steps = F.array(*[F.concat(F.lit(f"{s}:"), F.shiftright("b", STEP_BITS * s).cast("string")) for s in range(STEPS)])
    stepped = per_band.select("field", F.explode(steps).alias("k"), "bn").groupBy("field", "k").agg(F.sum("bn").alias("bn"))
    low = F.when(up, F.col("b") + 1).otherwise(F.lit(0))
    high = F.when(up, F.lit(BANDS - 1)).otherwise(F.col("b") - 1)
    whole = ranged.withColumn("k", F.explode(_bands_between(low, high))).join(stepped, ["field", "k"])
    whole = whole.groupBy(*key).agg(F.sum("bn").alias("passes"))
    edge = _at_threshold(ranged, values, key)

    at = counted.filter("field = 'circle:'").select("lat", "lng", "n", F.inline(point_grid_cells(F.col("lat"), F.col("lng"))))
    c = F.col("circle")
    circles = rules.filter("is_circle").select(*key, "circle", F.inline(circle_grid_cells(c["lat"], c["lng"], c["radius_km"])))
    inside = sliced_join(at, circles, ["g", "i", "j"], ["lat", "lng"]).filter(_circle_passes(c)).groupBy(*key).agg(F.sum("n").alias("passes"))
    parts = equal.unionByName(whole).unionByName(edge).unionByName(inside)
    return parts.groupBy(*key).agg(F.sum("passes").alias("passes"))


def _at_threshold(ranged: DataFrame, values: DataFrame, key: list[str]) -> DataFrame:
    """Passes within a filter's own band, from running counts over the band's values and thresholds.

    Values and thresholds of a band are laid in one order and counted along it, so no threshold
    meets the values one by one.
    """
    up = F.col("operator") == "gte"
    none = F.lit(None)
    marks = ranged.select("field", "b", F.col("num").alias("v"), F.when(up, F.lit(0)).otherwise(F.lit(2)).alias("side"), F.lit(0).cast("long").alias("n"), *key)
    points = values.select("field", "b", "v", F.lit(1).alias("side"), "n", *[none.cast("string").alias(k) for k in key])
    line = Window.partitionBy("field", "b").orderBy("v", "side")
    upto = F.sum("n").over(line.rangeBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy("field", "b"))
    counted = marks.unionByName(points).withColumn("upto", upto).withColumn("total", total).filter("operator is not null")
    # A lower bound stands before equal values, an upper bound after them.
    return counted.select(*key, F.when(up, F.col("total") - F.col("upto")).otherwise(F.col("upto")).alias("passes"))


def failure_counts(
    listings: DataFrame, profiles: DataFrame, filters: DataFrame, definitions: DataFrame
) -> DataFrame:
    """Per filter key: how many (active profile, listing) evaluations failed on it."""
    mine = filters.join(profiles.filter("is_active").select("profile_id"), "profile_id", "left_semi")
    uses = mine.groupBy("key", "operator", "value_json").agg(F.count("*").alias("uses"))
    rules = _distinct_rules(mine, definitions)
    found = field_counts(listings, rules)
    total = found.agg(F.coalesce(F.sum(F.when(F.col("field") == "", F.col("n"))), F.lit(0)).alias("total"))
    counted = uses.join(_passes(rules, found), ["key", "operator", "value_json"], "left")
    # The total is one row.
    counted = counted.withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one")
    failing = F.col("uses") * (F.col("total") - F.coalesce("passes", F.lit(0)))
    return counted.groupBy("key").agg(F.sum(failing).alias("failures"))


def radius_join(points: DataFrame, circles: DataFrame, slices: int | None = None) -> DataFrame:
    """All (point, circle) pairs within the radius, with the distance.

    ``points``: point_id, lat, lng. ``circles``: circle_id, c_lat, c_lng, radius_km.
    Meets on grids: a circle lists cells of the grid that fits its size, a point has one
    cell on each, so no pair appears twice. Points of a crowded cell spread over the slices.
    """
    p = points.filter("lat is not null and lng is not null").select("*", F.inline(point_grid_cells(F.col("lat"), F.col("lng"))).alias("_g", "_i", "_j"))
    c = circles.select("*", F.inline(circle_grid_cells(F.col("c_lat"), F.col("c_lng"), F.col("radius_km"))).alias("_g", "_i", "_j"))
    return (
        sliced_join(p, c, ["_g", "_i", "_j"], ["point_id"], slices)
        .withColumn("km", haversine_km(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng")))
        .filter(F.col("km") <= F.col("radius_km"))
        .drop("_g", "_i", "_j")
    )


def radius_counts(points: DataFrame, circles: DataFrame) -> DataFrame:
    """(circle_id, points, nearest_km) of the circles that hold any point: how many, and the least distance.

    Points at one place are counted first, and each place meets the circles once.
    """
    places = points.groupBy("lat", "lng").agg(F.min("point_id").alias("point_id"), F.count("*").alias("n"))
    return radius_join(places, circles).groupBy("circle_id").agg(F.sum("n").alias("points"), F.min("km").alias("nearest_km"))


def reject_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, errors): a changed event needs its version."""
    bad = (F.col("event") == "changed") & (F.coalesce("change_version", F.lit("")) == "")
    errors = events.filter(bad).withColumn("error", F.lit("changed match events require changeVersion"))
    return events.filter(~bad), errors


def match_key() -> Column:
    return F.sha2(F.concat_ws(":", "profile_id", "listing_id"), 256)


def record_matches(pairs: DataFrame, existing: DataFrame) -> DataFrame:
    """Insert-if-absent on (profile, listing), keeping what each pair should trigger.

    ``pairs``: profile_id, listing_id, event, change_version. ``existing``: profile_id,
    listing_id, state. A known pair triggers again only on a changed event or while its
    match is still pending.
    """
    known = existing.select("profile_id", "listing_id", F.col("state").alias("_state"))
    return _recorded(pairs.join(known, ["profile_id", "listing_id"], "left"))


def _recorded(joined: DataFrame) -> DataFrame:
    is_new = F.col("_state").isNull()
    return (
        joined.withColumn("is_new", is_new)
        .withColumn("state", F.coalesce("_state", F.lit("pending")))
        .withColumn("triggers", is_new | (F.col("event") == "changed") | (F.col("_state") == "pending"))
        .withColumn("match_id", match_key())
        .drop("_state")
    )


#: Known matches that travel with their listing.
KNOWN = 256


def known_states(existing: DataFrame, most: int = KNOWN) -> DataFrame:
    """(listing_id, _known, _many): states of a listing's known matches by profile. ``_many`` listings, which
    have more than ``most`` or one twice, get none: their pairs are to be joined."""
    rows = existing.filter("profile_id is not null and listing_id is not null")
    first = Window.partitionBy("listing_id").orderBy("profile_id")
    few = rows.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= most + 1)
    held = few.groupBy("listing_id").agg(F.collect_list(F.struct("profile_id", F.coalesce("state", F.lit("")).alias("state"), F.col("state").isNull().alias("none"))).alias("_k"))
    many = (F.size("_k") > most) | (F.size(F.array_distinct(F.transform("_k", lambda k: k["profile_id"]))) < F.size("_k")) | F.exists("_k", lambda k: k["none"])
    entries = F.transform("_k", lambda k: F.struct(k["profile_id"].alias("key"), k["state"].alias("value")))
    return held.withColumn("_many", many).select("listing_id", F.when(~F.col("_many"), F.map_from_entries(entries)).alias("_known"), "_many")


def match_and_record(
    listings: DataFrame,
    profiles: DataFrame,
    filters: DataFrame,
    definitions: DataFrame,
    existing: DataFrame,
    carry: Sequence[str] = ("event", "change_version", "at"),
    carry_profile: Sequence[str] = (),
    most: int = KNOWN,
) -> DataFrame:
    """``record_matches`` of the pairs that ``inverse_match`` finds, with no exchange of pairs.

    ``listings`` have their event (event, change_version, at). The states of a listing's known matches
    travel with it; only pairs of listings with very many known matches are joined with them.
    """
    known = known_states(existing, most)
    held = listings.join(known, "listing_id", "left").withColumn("_many", F.coalesce("_many", F.lit(False)))
    find = lambda rows, extra: inverse_match(rows, profiles, filters, definitions, carry=[*carry, *extra], carry_profile=carry_profile)
    pairs = find(held.filter("not _many"), ["_known"])
    out = _recorded(pairs.withColumn("_state", F.element_at("_known", F.col("profile_id"))).drop("_known"))
    if known.filter("_many").isEmpty():
        return out
    rest = record_matches(find(held.filter("_many"), []), existing.select("profile_id", "listing_id", "state"))
    return out.unionByName(rest)


def wants_reply() -> Column:
    return F.coalesce(F.col("auto_reply_enabled") & (F.length(F.trim("auto_reply_text")) > 0), F.lit(False))


#: What the fan-out reads of a profile; recorded pairs may bring it along.
PROFILE_COLUMNS = ["user_id", "notify", "auto_reply_enabled", "auto_reply_text"]


def fan_out(recorded: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notification events, reply events): two independent gates on the profile."""
    joined = recorded.filter("triggers")
    if not set(PROFILE_COLUMNS) <= set(recorded.columns):
        joined = joined.join(profiles.select("profile_id", *PROFILE_COLUMNS), "profile_id")
    notify = joined.filter("notify").drop("auto_reply_enabled", "auto_reply_text", "notify")
    return notify, joined.filter(wants_reply()).drop("notify")


def match_rate(matches: DataFrame, listings: DataFrame) -> DataFrame:
    """Matches per thousand listings and the share of matches dismissed by their owner."""
    m = matches.agg(
        F.count("*").alias("matches"), F.count_if(F.col("state") == "dismissed").alias("dismissed")
    ).withColumn("_one", F.lit(1))
    n = listings.agg(F.count("*").alias("listings")).withColumn("_one", F.lit(1))
    return m.join(n, "_one").select(
        "matches",
        "listings",
        (F.col("matches") * 1000 / F.col("listings")).alias("per_thousand"),
        (F.col("dismissed") / F.col("matches")).alias("dismissed_share"),
    )
