"""Domain frames derived from the given tables.

Column texts are shared with the check queries: each is valid in Spark and in standard
SQL, with casts to double so that both engines compute the same type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellmatch.operators.skew import latest_per_key
from dwellmatch.session import read_table, spread

# Allowed states of the driver data: its region names.
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]

OBSERVATION_SQL = {
    "source_slug": "concat('src', cast(l_suppkey % 8 as string))",
    "external_id": "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string))",
    "url": "concat('https://listings.example/', cast(l_suppkey % 8 as string), '/', cast(l_orderkey as string), '-', cast(l_linenumber as string))",
    "title": "p_name",
    "deal_type": "'rent'",
    "price": "CASE WHEN l_discount <> cast(0.03 as double) THEN cast(floor(l_extendedprice/40) as double) END",
    "warm_rent": "CASE WHEN l_discount IN (cast(0.03 as double), cast(0.05 as double)) AND l_tax > 0 THEN cast(floor(l_extendedprice/40) as double)+150 END",
    "area": "cast(p_size*2 + l_linenumber as double)",
    "rooms": "cast(cast(l_quantity as bigint) % 10 as double)/2 + cast(0.5 as double)",
    "city": "n_name",
    "bundesland": "r_name",
    "postal_code": "lpad(cast((s_suppkey*997)%100000 as string),5,'0')",
    "lat": "cast(47 as double)+cast((n_nationkey*31+s_suppkey)%82 as double)/10",
    "lng": "cast(5.5 as double)+cast((n_nationkey*17+s_suppkey)%97 as double)/10",
    "balcony": "l_linestatus='O'",
    "elevator": "CASE WHEN l_returnflag<>'N' THEN l_returnflag='A' END",
    "n_images": "p_size % 4",
    "image_of": "p_partkey",
    "seen_at": "l_shipdate",
    "s1": "l_partkey",
    "s2": "l_suppkey",
    "s3": "l_quantity",
    "s4": "l_extendedprice",
}
SEQ = ["s1", "s2", "s3", "s4"]


#: What the observations are derived from; columns that a join makes equal come once.
LINE_COLUMNS = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    "l_linestatus", "l_shipdate", "p_name", "p_size", "s_nationkey", "n_name", "r_name",
]
EQUAL = {"p_partkey": "l_partkey", "s_suppkey": "l_suppkey", "n_nationkey": "s_nationkey"}


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined rows of the tables, narrow: texts are made of them after shuffles. Order and line
    number are both there or both null, as the external id is."""
    t = lambda n: read_table(spark, sf_dir, n)
    joined = (
        spread(t("lineitem"))
        .join(t("part"), F.expr("l_partkey = p_partkey"))
        .join(t("supplier"), F.expr("l_suppkey = s_suppkey"))
        .join(t("nation"), F.expr("s_nationkey = n_nationkey"))
        .join(t("region"), F.expr("n_regionkey = r_regionkey"))
    )
    named = F.col("l_orderkey").isNotNull() & F.col("l_linenumber").isNotNull()
    return joined.select(
        *[F.when(named, F.col(c)).alias(c) if c in ("l_orderkey", "l_linenumber") else F.col(c) for c in LINE_COLUMNS]
    )


def _observed(lines: DataFrame) -> DataFrame:
    keep = [F.col(c) for c in lines.columns if c not in LINE_COLUMNS]
    base = lines.withColumns({c: F.col(same) for c, same in EQUAL.items()}).select(
        *[F.expr(sql).alias(name) for name, sql in OBSERVATION_SQL.items()], *keep
    )
    flag = lambda n: F.when(
        F.col(n).isNotNull(), F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value"))
    )
    image = lambda i: F.struct(
        F.concat(F.lit("https://img.example/"), "image_of", F.lit(f"/{i}.jpg")).alias("url"), F.lit(i - 1).alias("position")
    )
    images = F.expr("cast(array() as array<struct<url:string,position:int>>)")
    for n in (1, 2, 3):
        images = F.when(F.col("n_images") == n, F.array(*[image(i) for i in range(1, n + 1)])).otherwise(images)
    return (
        base.withColumn("attributes", F.map_from_entries(F.array_compact(F.array(flag("balcony"), flag("elevator")))))
        .withColumn("images", images)
        .drop("balcony", "elevator", "n_images", "image_of")
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing observations in canonical shape plus seen_at and the tie-break columns."""
    return _observed(_lines(spark, sf_dir))


LISTING_ID = "concat_ws('|', {source_slug}, {external_id})".format(**OBSERVATION_SQL)


def listed_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with their ``listing_id``, dealt out by it while the rows are narrow: what then works
    by listing needs no further exchange."""
    return _observed(_lines(spark, sf_dir).withColumn("listing_id", F.expr(LISTING_ID)).repartition("listing_id"))


def newest_observations(spark: SparkSession, sf_dir: str, by_order: bool = False) -> DataFrame:
    """The newest observation of each source and external id, chosen among the narrow rows, with its
    ``listing_id``; rows are dealt out by it, or by ``order_no`` for what gathers the lines of an order."""
    lines, keys = _lines(spark, sf_dir).withColumn("listing_id", F.expr(LISTING_ID)), ["listing_id"]
    if by_order:
        # The number that an external id begins with.
        lines = lines.withColumn("order_no", F.when(F.col("l_orderkey") >= 0, F.col("l_orderkey"))).repartition("order_no")
        keys = ["order_no", "listing_id"]
    return _observed(latest_per_key(lines, keys, [OBSERVATION_SQL[c] for c in ("seen_at", *SEQ)]))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("profile_id"),
        (F.col("c_custkey") % 500).alias("user_id"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
        (F.col("c_mktsegment") != "HOUSEHOLD").alias("notify"),
        (F.col("c_custkey") % 6 == 0).alias("auto_reply_enabled"),
        F.when(F.col("c_custkey") % 12 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" Hello from "), "c_name")).alias("auto_reply_text"),
    )


# (key, operator, condition, value as JSON text)
FILTER_SQL = [
    ("city", "eq", "c_custkey % 10 <> 0", "concat('\"', n_name, '\"')"),
    ("price", "lte", "true", "cast(cast(floor(400 + c_acctbal/8) as bigint) as string)"),
    ("rooms", "gte", "c_custkey % 3 = 0", "cast(1 + c_custkey % 4 as string)"),
    ("balcony", "eq", "c_custkey % 4 = 1", "'true'"),
    (
        "location",
        "within",
        "c_custkey % 5 = 0",
        "concat('{\"lat\":', cast(cast(47.5 as double)+cast(c_custkey%75 as double)/10 as string), ',\"lng\":', "
        "cast(cast(6 as double)+cast(c_custkey%90 as double)/10 as string), ',\"radius_km\":', cast(25 + c_custkey % 100 as string), '}')",
    ),
]


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter rows of all profiles: one scan of the customers."""
    joined = read_table(spark, sf_dir, "customer").join(
        read_table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey")
    )
    rows = [
        F.when(
            F.expr(cond),
            F.struct(
                F.lit(i).alias("position"), F.lit(key).alias("key"), F.lit(op).alias("operator"), F.expr(value).alias("value_json")
            ),
        )
        for i, (key, op, cond, value) in enumerate(FILTER_SQL)
    ]
    return joined.select(F.col("c_custkey").alias("profile_id"), F.inline(F.array_compact(F.array(*rows))))


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("subscription_id"),
        (F.col("c_custkey") % 500).alias("user_id"),
        (F.col("c_custkey") + 100000).alias("chat_id"),
        (F.col("c_custkey") % 7 != 0).alias("enabled"),
    )


def past_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier notifications: an order tells its customer's chat about its first line."""
    status = F.when(F.col("o_orderstatus") == "F", "sent").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("notification_id"),
        F.col("o_custkey").alias("subscription_id"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit("-1")).alias("external_id"),
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


def past_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known matches: an order's customer and each of its lines.

    Repeats stand in one order, so they are dropped where the join has brought the order's lines together;
    only lines without a number, whose external id is null, can repeat across orders.
    """
    state = F.when(F.col("o_orderstatus") == "F", "notified").when(F.col("o_orderstatus") == "O", "pending").otherwise("dismissed")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    source = F.expr("l_suppkey % 8").alias("l_suppkey")
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", source)
    joined = lambda cond: lines.filter(cond).join(orders, F.expr("l_orderkey = o_orderkey"))
    made = lambda rows: rows.select(
        F.col("o_custkey").alias("profile_id"),
        F.expr(OBSERVATION_SQL["source_slug"]).alias("source_slug"),
        F.expr(OBSERVATION_SQL["external_id"]).alias("external_id"),
        state.alias("state"),
        F.col("o_orderdate").alias("matched_at"),
    )
    named = joined("l_linenumber is not null").dropDuplicates(["o_custkey", "l_suppkey", "l_orderkey", "l_linenumber"])
    unnamed = made(joined("l_linenumber is null")).dropDuplicates(["profile_id", "source_slug", "external_id"])
    return made(named).unionByName(unnamed)


def source_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "partial").otherwise("success")
    return read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        F.concat(F.lit("src"), (F.col("user_id") % 8).cast("string")).alias("source_slug"),
        status.alias("status"),
        F.floor(F.col("value") / 10).cast("long").alias("items_new"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).cast("long").alias("errors"),
        F.col("ts").alias("finished_at"),
    )
