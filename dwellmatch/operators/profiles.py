"""Saved searches: validation, criteria snapshots, forms, limits, changes, search areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dwellmatch.functions.numbers import js_num, round_half_up
from dwellmatch.operators.match import typed_filters

# Fixed values.
RANGE_KEYS = ["price", "area", "rooms"]
PLACE_KEYS = ["city", "bundesland", "postal_code"]
PLAN_LIMITS = {"free": 3, "paid": 20}
PAID_ROLES = ["premium", "admin", "super_admin"]
_NUMBER = r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"


def _config(*names: str) -> Column:
    """Number under the validation object, else under the config itself."""
    c = F.col("config")
    inside = F.get_json_object(c, "$.validation").isNotNull()
    first = lambda root: F.coalesce(*[F.get_json_object(c, f"{root}.{n}").try_cast("double") for n in names])
    return F.when(inside, first("$.validation")).otherwise(first("$"))


def _allowed_values() -> Column:
    """First non-empty list of allowed values among its accepted spellings."""
    names = ["values", "allowedValues", "allowed_values", "options"]
    paths = [f"$.validation.{n}" for n in names] + [f"$.{n}" for n in names]
    c = F.col("config")

    def strings(path: str) -> Column:
        items = F.from_json(F.get_json_object(c, path), "array<string>")
        plain = F.transform(items, lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.value")).otherwise(x))
        kept = F.filter(plain, lambda x: x.isNotNull())
        return F.when(F.size(kept) > 0, kept)

    return F.coalesce(*[strings(p) for p in paths])


# The issue texts of the following functions are fixed values.


def _issue(field: Column, text) -> Column:
    return F.struct(field.alias("field"), (F.lit(text) if isinstance(text, str) else text).alias("issue"))


def _number_issue(field: Column, json: Column, lo: Column, hi: Column) -> Column:
    value = F.when(json.rlike(_NUMBER), json.try_cast("double"))
    return (
        F.when(value.isNull(), _issue(field, "must be a finite number"))
        .when(value < lo, _issue(field, F.concat(F.lit("must be >= "), js_num(lo))))
        .when(value > hi, _issue(field, F.concat(F.lit("must be <= "), js_num(hi))))
    )


def _string_issue(field: Column, json: Column, lo: Column, hi: Column) -> Column:
    text = F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v")
    size = F.length(F.trim(text))
    return (
        F.when(~json.startswith('"'), _issue(field, "must be a string"))
        .when(size == 0, _issue(field, "must be a non-empty string"))
        .when(size < lo, _issue(field, F.concat(F.lit("length must be >= "), js_num(lo))))
        .when(size > hi, _issue(field, F.concat(F.lit("length must be <= "), js_num(hi))))
    )


def _enum_issue(field: Column, json: Column, lo: Column, hi: Column, allowed: Column) -> Column:
    text = F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v")
    unknown = allowed.isNotNull() & ~F.array_contains(allowed, text)
    return F.coalesce(
        _string_issue(field, json, lo, hi),
        F.when(unknown, _issue(field, F.concat(F.lit("must be one of: "), F.array_join(allowed, ", ")))),
    )


def _bool_issue(field: Column, json: Column) -> Column:
    return F.when(~json.isin("true", "false"), _issue(field, "must be a boolean"))


def filter_issues(filters: DataFrame, definitions: DataFrame) -> DataFrame:
    """Issues of each filter row on its own: one (profile_id, position, field, issue) per issue."""
    t = typed_filters(filters, definitions)
    at = F.concat(F.lit("filters["), F.col("position").cast("string"), F.lit("]"))
    value_at, op, kind, json = F.concat(at, F.lit(".value")), F.col("operator"), F.col("data_type"), F.col("value_json")
    lo, hi = _config("min", "minValue", "min_value"), _config("max", "maxValue", "max_value")
    min_len, max_len = _config("minLength", "min_length", "min"), _config("maxLength", "max_length", "max")
    allowed = _allowed_values()
    number = kind.isin("number", "range")
    text, flag, place = kind.isin("text", "string"), kind.isin("bool", "boolean"), kind.isin("geo", "location")
    fits = (
        (number & op.isin("eq", "gte", "lte", "in"))
        | ((text | (kind == "enum") | flag) & op.isin("eq", "in"))
        | (place & (op == "within"))
    )

    def of_value(field: Column, value: Column) -> Column:
        return (
            F.when(number, _number_issue(field, value, lo, hi))
            .when(flag, _bool_issue(field, value))
            .when(kind == "enum", _enum_issue(field, value, min_len, max_len, allowed))
            .when(text, _string_issue(field, value, min_len, max_len))
        )

    items = F.transform(F.try_parse_json(json).try_cast("array<variant>"), lambda v: F.to_json(v))
    one = lambda c: F.array_compact(F.array(c))
    # The first bad item of a list is reported, as the check stops there.
    item_issues = F.filter(
        F.transform(items, lambda x, i: of_value(F.concat(value_at, F.lit("["), i.cast("string"), F.lit("]")), x)),
        lambda x: x.isNotNull(),
    )
    listed = F.when(F.coalesce(F.size(items), F.lit(0)) == 0, one(_issue(value_at, "must be a non-empty array"))).otherwise(
        F.slice(item_issues, 1, 1)
    )
    part = lambda n: F.coalesce(F.get_json_object(json, f"$.{n}"), F.lit("null"))
    # get_json_object drops quotes: a quoted number is marked so that it is refused.
    strict = lambda n: F.when(json.rlike(f'"{n}"\\s*:\\s*"'), F.lit('"')).otherwise(part(n))
    sub = lambda n: F.concat(value_at, F.lit(f".{n}"))
    min_r = F.coalesce(_config("minRadiusKm", "min_radius_km", "radiusMinKm", "radius_min_km"), F.lit(0.0))
    max_r = _config("maxRadiusKm", "max_radius_km", "radiusMaxKm", "radius_max_km")
    zero = F.when(strict("radius_km").try_cast("double") <= 0, _issue(sub("radius_km"), "must be > 0"))
    circle = F.array_compact(
        F.array(
            _number_issue(sub("lat"), strict("lat"), F.lit(-90.0), F.lit(90.0)),
            _number_issue(sub("lng"), strict("lng"), F.lit(-180.0), F.lit(180.0)),
            F.coalesce(_number_issue(sub("radius_km"), strict("radius_km"), min_r, max_r), zero),
        )
    )
    issues = (
        F.when(kind.isNull(), F.array(_issue(F.concat(at, F.lit(".key")), "unknown filter key")))
        .when(
            ~F.array_contains("operator_set", op),
            F.array(_issue(F.concat(at, F.lit(".operator")), "operator is not allowed for this filter")),
        )
        .when(
            ~fits,
            F.array(_issue(F.concat(at, F.lit(".operator")), "operator is not compatible with this filter data type")),
        )
        .when(
            place,
            F.when(
                json.startswith("{"), circle
            ).otherwise(F.array(_issue(value_at, "must be an object with lat, lng, and radius_km"))),
        )
        .when(op == "in", listed)
        .otherwise(one(of_value(value_at, json)))
    )
    return t.select(
        "profile_id", "position", "key", "operator", "num", F.explode_outer(issues).alias("i")
    ).select("profile_id", "position", "key", "operator", "num", "i.field", "i.issue")


def validate_filters(filters: DataFrame, definitions: DataFrame) -> DataFrame:
    """All issues per profile: each row on its own, then lower bound over upper bound."""
    rows = filter_issues(filters, definitions)
    last = lambda o: F.max_by(F.when(F.col("operator") == o, F.col("num")), F.when(F.col("operator") == o, F.col("position")))
    ranges = (
        rows.filter(F.col("issue").isNull() & F.col("key").isin(RANGE_KEYS))
        .groupBy("profile_id", "key")
        .agg(last("gte").alias("lo"), last("lte").alias("hi"))
        .filter("lo > hi")
        .select("profile_id", F.col("key").alias("field"), F.lit("gte must be <= lte").alias("issue"))
    )
    return rows.filter("issue is not null").select("profile_id", "field", "issue").unionByName(ranges)


def build_criteria(filters: DataFrame) -> DataFrame:
    """Criteria JSON per profile: bounds per number key, location, places, attributes.

    A later filter of the same key (and operator) wins. A profile's filters are a form's
    worth of rows, so they are gathered per profile.
    """
    key, op = F.col("key"), F.col("operator")
    group = (
        F.when(key.isin(RANGE_KEYS), "range")
        .when((key == "location") & (op == "within"), "location")
        .when(key.isin(PLACE_KEYS), "place")
        .otherwise("attr")
    )
    slot = F.when(group == "range", F.concat_ws("|", key, op)).otherwise(F.concat_ws("|", group, key))
    kept = (
        filters.withColumn("grp", group)
        .groupBy("profile_id", "grp", slot.alias("slot"))
        .agg(F.max_by(F.struct("key", "operator", "value_json"), "position").alias("f"))
    )
    pair = lambda k: F.concat(F.lit('"'), k, F.lit('":'), F.col("f.value_json"))
    text = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    of = lambda g, c: F.when(F.col("grp") == g, c)
    per = kept.groupBy("profile_id").agg(
        text(of("place", pair(F.col("f.key")))).alias("places"),
        text(of("location", F.concat(F.lit('"location":'), F.col("f.value_json")))).alias("location"),
        text(of("attr", pair(F.col("f.key")))).alias("attrs"),
        *[
            text(F.when((F.col("grp") == "range") & (F.col("f.key") == k), pair(F.col("f.operator")))).alias(k)
            for k in RANGE_KEYS
        ],
    )
    some = lambda c, wrapped: F.when(F.col(c) != "", wrapped)
    ranges = [some(k, F.concat(F.lit(f'"{k}":{{'), F.col(k), F.lit("}"))) for k in sorted(RANGE_KEYS)]
    attrs = some("attrs", F.concat(F.lit('"attrs":{'), F.col("attrs"), F.lit("}")))
    members = F.concat_ws(",", attrs, some("location", F.col("location")), some("places", F.col("places")), *ranges)
    return per.select("profile_id", F.concat(F.lit("{"), members, F.lit("}")).alias("criteria"))


def form_values(criteria: DataFrame) -> DataFrame:
    """Criteria JSON back to flat form columns."""
    get = lambda p: F.get_json_object("criteria", p)
    number = lambda p: get(p).try_cast("double")
    cols = [number(f"$.{k}.{o}").alias(f"{k}_{s}") for k in RANGE_KEYS for o, s in (("gte", "min"), ("lte", "max"))]
    return criteria.select(
        "profile_id",
        *[get(f"$.{k}").alias(k) for k in PLACE_KEYS],
        *cols,
        *[number(f"$.location.{n}").alias(n) for n in ("lat", "lng", "radius_km")],
        get("$.attrs").alias("attrs"),
    )


def filters_from_form(forms: DataFrame, definitions: DataFrame) -> DataFrame:
    """Wide form rows to filter rows, driven by the definitions.

    ``forms``: profile_id and ``values`` map<string,string> of form field → JSON text.
    Numbers give gte from _min, lte from _max, in from _in; text gives eq, else in; a
    circle only when complete; a boolean only when true.
    """
    defs = definitions.filter("is_active").select("key", "data_type", "operator_set")
    suffix = r"_(min|max|in|eq|lat|lng|radius_km)$"
    cells = forms.select("profile_id", F.explode("values").alias("cell", "value_json")).filter(
        F.col("value_json").isNotNull() & ~F.col("value_json").isin("null", '""')
    )
    cells = cells.withColumn(
        "cell", F.when(F.col("cell").isin("lat", "lng", "radius_km"), F.concat(F.lit("location_"), "cell")).otherwise(F.col("cell"))
    )
    split = cells.withColumn("part", F.regexp_extract("cell", suffix, 1)).withColumn(
        "key", F.regexp_replace("cell", suffix, "")
    )
    joined = split.join(defs, "key")
    has = lambda o: F.array_contains("operator_set", o)
    number, text = F.col("data_type").isin("number", "range"), F.col("data_type").isin("text", "enum")
    is_list = F.col("value_json").startswith("[")
    op = (
        F.when(number & (F.col("part") == "min") & has("gte"), "gte")
        .when(number & (F.col("part") == "max") & has("lte"), "lte")
        .when(number & (F.col("part") == "in") & has("in"), "in")
        .when(text & F.col("part").isin("", "eq") & has("eq") & ~is_list, "eq")
        .when(text & F.col("part").isin("", "in") & ~has("eq") & has("in"), "in")
        .when((F.col("data_type") == "bool") & (F.col("part") == "") & has("eq") & (F.col("value_json") == "true"), "eq")
    )
    scalar = joined.withColumn("operator", op).filter("operator is not null").select("profile_id", "key", "operator", "value_json")
    member = lambda n: F.max(F.when(F.col("part") == n, F.col("value_json")))
    circle = (
        joined.filter((F.col("data_type") == "geo") & has("within"))
        .groupBy("profile_id", "key")
        .agg(member("lat").alias("lat"), member("lng").alias("lng"), member("radius_km").alias("r"))
        .filter("lat is not null and lng is not null and cast(r as double) > 0")
        .select(
            "profile_id",
            "key",
            F.lit("within").alias("operator"),
            F.format_string('{"lat":%s,"lng":%s,"radius_km":%s}', "lat", "lng", "r").alias("value_json"),
        )
    )
    return scalar.unionByName(circle)


def admit_profiles(requests: DataFrame, existing: DataFrame, users: DataFrame) -> DataFrame:
    """Which profile creations fit the user's plan.

    ``requests``: user_id, profile_id, requested_at. A user holds at most 3 profiles,
    20 with a paid role; stored ones count first. Only the first 20 requests per user
    are ranked (group limit before the shuffle); later ones cannot fit.
    """
    held = existing.groupBy("user_id").agg(F.count("*").alias("held"))
    w = Window.partitionBy("user_id").orderBy("requested_at", "profile_id")
    top = max(PLAN_LIMITS.values())
    first = (
        requests.select("user_id", "profile_id", "requested_at")
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= top)
        .select("user_id", "profile_id", "rank")
    )
    limit = F.when(F.col("role").isin(PAID_ROLES), PLAN_LIMITS["paid"]).otherwise(PLAN_LIMITS["free"])
    return (
        requests.join(first, ["user_id", "profile_id"], "left")
        .join(users.select("user_id", "role"), "user_id", "left")
        .join(held, "user_id", "left")
        .withColumn("admitted", F.coalesce(F.col("rank") + F.coalesce("held", F.lit(0)) <= limit, F.lit(False)))
        .drop("rank", "held", "role")
    )


def apply_profile_changes(
    profiles: DataFrame, filters: DataFrame, changes: DataFrame, new_filters: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Profiles and filters after a batch of create / update / toggle / delete events.

    ``changes``: profile_id, kind, is_active, at. The latest event per profile counts;
    create and update replace all filter rows by those in ``new_filters``.
    """
    last = changes.groupBy("profile_id").agg(F.max_by(F.struct("kind", "user_id", "is_active"), "at").alias("c"))
    joined = profiles.join(last, "profile_id", "full_outer")
    kept = joined.filter(F.coalesce(F.col("c.kind"), F.lit("")) != "delete")
    out = kept.withColumn("is_active", F.coalesce("c.is_active", "is_active")).withColumn(
        "user_id", F.coalesce("user_id", "c.user_id")
    )
    replaced = last.filter(F.col("c.kind").isin("create", "update", "delete")).select("profile_id")
    added = new_filters.join(last.filter(F.col("c.kind").isin("create", "update")).select("profile_id"), "profile_id", "left_semi")
    return out.drop("c"), filters.join(replaced, "profile_id", "left_anti").unionByName(added)


def derive_search_areas(profiles: DataFrame, filters: DataFrame, max_areas: int | None = None) -> DataFrame:
    """Search areas of the active profiles: city, radius with centre, price cap.

    One area per (lower-case city, radius, price), the smallest profile id speaking for
    it; the first ``max_areas`` in profile order if given.
    """
    text = lambda c: F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")
    first = lambda cond, c: F.min_by(F.when(cond, c), F.when(cond, F.col("position")))
    is_ = lambda k, o: (F.col("key") == k) & (F.col("operator") == o)
    v = F.col("value_json")
    circle = F.from_json(v, "lat double, lng double, radius_km double")
    per = (
        filters.join(profiles.filter("is_active").select("profile_id"), "profile_id", "left_semi")
        .groupBy("profile_id")
        .agg(
            F.trim(first(is_("city", "eq"), F.when(v.startswith('"'), text(v)))).alias("location"),
            first(is_("location", "within"), circle).alias("c"),
            first(is_("price", "lte"), F.when(v.rlike(_NUMBER), v.try_cast("double"))).alias("p"),
        )
        .filter(F.length("location") > 0)
    )
    areas = per.select(
        "profile_id",
        "location",
        F.when(F.col("c.radius_km") > 0, round_half_up(F.col("c.radius_km"))).alias("radius_km"),
        F.when(F.col("p") >= 50, F.least("p", F.lit(50000.0))).alias("max_price"),
        F.col("c.lat").alias("lat"),
        F.col("c.lng").alias("lng"),
    )
    first_of = areas.groupBy(F.lower("location").alias("_l"), "radius_km", "max_price").agg(
        F.min_by(F.struct("profile_id", "location", "lat", "lng"), "profile_id").alias("a")
    )
    areas = first_of.select("a.profile_id", "a.location", "radius_km", "max_price", "a.lat", "a.lng")
    return areas if max_areas is None else areas.orderBy("profile_id").limit(max_areas)


def set_radius(filters: DataFrame, definitions: DataFrame, radius_km: float) -> tuple[DataFrame, DataFrame]:
    """(preview, rewritten filters): every circle filter gets the radius."""
    geo = definitions.filter("data_type = 'geo'").select("key").withColumn("_geo", F.lit(True))
    marked = filters.join(geo, "key", "left").withColumn(
        "_hit", F.coalesce(F.col("_geo") & (F.col("operator") == "within"), F.lit(False))
    )
    get = lambda n: F.get_json_object("value_json", f"$.{n}")
    preview = marked.filter("_hit").select(
        "profile_id", "position", get("lat").alias("lat"), get("lng").alias("lng"), get("radius_km").alias("current_radius_km")
    )
    text = F.concat(
        F.lit('{"lat":'), get("lat"), F.lit(',"lng":'), get("lng"), F.lit(',"radius_km":'), js_num(F.lit(radius_km)), F.lit("}")
    )
    out = marked.withColumn("value_json", F.when(F.col("_hit"), text).otherwise(F.col("value_json"))).drop("_geo", "_hit")
    return preview, out.select(*filters.columns)
