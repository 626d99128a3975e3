"""Catalogue search, histories, dashboards and account queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dwellmatch.functions.lifecycle import activation_reasons, health, lifecycle

QUEUE_STATES = ["waiting", "active", "completed", "failed", "delayed"]  # fixed values


def check_search_args(limit: int = 20, **bounds: float | None) -> None:
    """Refuse a page size outside 1..100, negative bounds and crossed price bounds."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    for name, value in bounds.items():
        if value is not None and value < 0:
            raise ValueError(f"{name} must be >= 0")
    lo, hi = bounds.get("price_min"), bounds.get("price_max")
    if lo is not None and hi is not None and lo > hi:
        raise ValueError("price_min must be <= price_max")


#: Numbers of a search and the city, as texts.
SEARCH_NUMBERS = ["price_max", "price_min", "rooms_min", "area_min"]
# Fixed value: the layout of an id.
_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def _argument(name: str) -> Column:
    """A number from an argument's text: blank is 0, what is no number gives NaN."""
    text = F.trim(F.col(name))
    plain = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(text == "", 0.0).when(plain, text.cast("double")).when(text.isNotNull(), F.lit(float("nan")))


def checked_search_args(args: DataFrame) -> DataFrame:
    """Logged search requests with their parsed arguments and ``errors``, the arguments that are refused.

    ``args`` has text columns city, price_max, price_min, rooms_min, area_min, limit and cursor; null is
    an argument that wasn't given. A city has 1 to 200 characters without outer blanks, a number is
    finite and not negative, the limit a whole number from 1 to 100 (20 if not given), the cursor
    an id; the lowest price must not exceed the highest. A request is accepted if ``errors`` is empty.
    """
    rows = args.withColumn("city", F.trim("city"))
    wrong = [F.when(~F.length("city").between(1, 200), "city")]
    for name in SEARCH_NUMBERS:
        rows = rows.withColumn(name, _argument(name))
        wrong.append(F.when(F.isnan(name) | (F.col(name) < 0) | (F.col(name) == float("inf")), name))
    rows = rows.withColumn("limit", F.coalesce(_argument("limit"), F.lit(20.0)))
    wrong.append(F.when(F.isnan("limit") | (F.col("limit") != F.floor("limit")) | ~F.col("limit").between(1, 100), "limit"))
    wrong.append(F.when(~F.col("cursor").rlike(_UUID), "cursor"))
    first = F.array_compact(F.array(*wrong))
    # Bounds are compared once all arguments are valid by themselves.
    crossed = F.when(F.col("price_min") > F.col("price_max"), F.array(F.lit("price_min > price_max"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("errors", F.when(F.size(first) > 0, first).otherwise(crossed)).withColumn("limit", F.when(F.size("errors") == 0, F.col("limit").cast("int")))


def _check_page(limit: int, most: int) -> None:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")


def search_listings(
    listings: DataFrame,
    city: str | None = None,
    price_min: float | None = None,
    price_max: float | None = None,
    rooms_min: float | None = None,
    area_min: float | None = None,
    cursor: tuple | None = None,
    limit: int = 20,
) -> DataFrame:
    """One page of live listings, newest first, plus one row that tells whether more follow.

    ``cursor`` is the (first_seen_at, listing_id) of the last row of the page before.
    """
    check_search_args(limit, price_min=price_min, price_max=price_max, rooms_min=rooms_min, area_min=area_min)
    df = listings.filter(F.col("status").isin("active", "updated"))
    if city is not None:
        df = df.filter(F.col("city") == city)
    for column, op, value in (
        ("price", "ge", price_min),
        ("price", "le", price_max),
        ("rooms", "ge", rooms_min),
        ("area", "ge", area_min),
    ):
        if value is not None:
            df = df.filter(F.col(column) >= value if op == "ge" else F.col(column) <= value)
    if cursor is not None:
        seen, last = F.lit(cursor[0]), F.lit(cursor[1])
        df = df.filter(
            (F.col("first_seen_at") < seen) | ((F.col("first_seen_at") == seen) & (F.col("listing_id") < last))
        )
    return df.orderBy(F.desc("first_seen_at"), F.desc("listing_id")).limit(limit + 1)


def page_of(rows: DataFrame, limit: int = 20) -> tuple[list, bool, tuple | None]:
    """(page rows, has more, next cursor) of a search result; at most limit + 1 rows."""
    found = rows.collect()
    page = found[:limit]
    more = len(found) > limit
    return page, more, (page[-1]["first_seen_at"], page[-1]["listing_id"]) if more else None


def listing_detail(listings: DataFrame, images: DataFrame) -> DataFrame:
    """Listings with all their images in order."""
    ordered = images.groupBy("listing_id").agg(F.array_sort(F.collect_list(F.struct("position", "url"))).alias("images"))
    return listings.drop("images").join(ordered, "listing_id", "left")


def listing_history(history: DataFrame, listing_id: str) -> DataFrame:
    return history.filter(F.col("listing_id") == listing_id).orderBy(F.desc("changed_at"), "field")


def top_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per group; ranks are cut per task before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def profiles_with_filters(profiles: DataFrame, filters: DataFrame) -> DataFrame:
    """Profiles with their filter rows nested in order (a form's worth per profile)."""
    nested = filters.groupBy("profile_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "key", "operator", "value_json"))).alias("filters")
    )
    return profiles.join(nested, "profile_id", "left")


def profile_matches(matches: DataFrame, listings: DataFrame, n: int = 100) -> DataFrame:
    """Newest ``n`` matches of every profile with their listing."""
    top = top_per_group(matches, "profile_id", [F.desc("matched_at"), F.asc("listing_id")], n)
    return top.join(listings, "listing_id", "left")


def notification_history(notifications: DataFrame, subscriptions: DataFrame, listings: DataFrame, n: int = 50) -> DataFrame:
    """Newest ``n`` (at most 200) notifications of every user with their listing."""
    if not 1 <= n <= 200:
        raise ValueError("n must be between 1 and 200")
    mine = notifications.join(subscriptions.select("subscription_id", "user_id"), "subscription_id")
    top = top_per_group(mine, "user_id", [F.desc("created_at"), F.asc("notification_id"), F.asc("listing_id")], n)
    return top.join(listings, "listing_id", "left")


def system_totals(users: DataFrame, profiles: DataFrame, listings: DataFrame, matches: DataFrame, notifications: DataFrame) -> DataFrame:
    """Five totals as (name, n) rows, one aggregate each."""
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    parts = [
        one("users", users.filter("status <> 'deleted'")),
        one("active_profiles", profiles.filter("is_active")),
        one("listings", listings),
        one("matches", matches),
        one("sent_notifications", notifications.filter("status = 'sent'")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def latest_finished_run(runs: DataFrame) -> DataFrame:
    """Newest finished run per source; combines map-side."""
    done = runs.filter("finished_at is not null")
    cols = [c for c in done.columns if c != "source_slug"]
    return done.groupBy("source_slug").agg(F.max_by(F.struct(*cols), F.struct("finished_at", "run_id")).alias("run"))


def source_dashboard(sources: DataFrame, listings: DataFrame, runs: DataFrame, registered: list[str]) -> DataFrame:
    """Per source: listing count, latest run, activation decision, health."""
    counts = listings.groupBy("source_slug").agg(F.count("*").alias("listings"))
    joined = (
        sources.withColumnRenamed("slug", "source_slug")
        .join(counts, "source_slug", "left")
        .join(latest_finished_run(runs), "source_slug", "left")
    )
    life = lifecycle(F.col("config"))
    reasons = activation_reasons(F.col("source_slug"), F.col("kind").isin(registered), life)
    return joined.select(
        "source_slug",
        "is_active",
        F.coalesce("listings", F.lit(0)).alias("listings"),
        F.col("run.status").alias("last_run_status"),
        F.coalesce("run.items_new", F.lit(0)).alias("items_new"),
        F.coalesce("run.errors", F.lit(0)).alias("errors"),
        F.col("run.finished_at").alias("finished_at"),
        life["status"].alias("lifecycle_status"),
        (F.size(reasons) == 0).alias("activatable"),
        reasons.alias("reasons"),
        health(F.col("is_active"), F.col("breaker_state"), F.col("run.status"), F.col("run.errors")).alias("health"),
    )


def activation_list(sources: DataFrame, registered: list[str]) -> DataFrame:
    life = lifecycle(F.col("config"))
    reasons = activation_reasons(F.col("slug"), F.col("kind").isin(registered), life)
    return sources.select(
        "slug", life["status"].alias("lifecycle_status"), (F.size(reasons) == 0).alias("activatable"), reasons.alias("reasons")
    )


def search_users(users: DataFrame, text: str | None, limit: int = 200) -> DataFrame:
    """Users whose e-mail contains the text, newest first."""
    df = users if not text else users.filter(F.lower("email").contains(text.lower()))
    _check_page(limit, 200)
    return df.orderBy(F.desc("created_at"), F.asc("user_id")).limit(limit)


def runs_of_source(runs: DataFrame, n: int = 50) -> DataFrame:
    return top_per_group(runs, "source_slug", [F.desc("finished_at"), F.desc("run_id")], n)


def audit_log(log: DataFrame, users: DataFrame, limit: int = 500) -> DataFrame:
    """Newest audit rows with the actor's e-mail; limited before the join."""
    _check_page(limit, 500)
    newest = log.orderBy(F.desc("at"), F.asc("audit_id")).limit(limit)
    return newest.join(users.select(F.col("user_id").alias("actor_id"), "email"), "actor_id", "left")


def queue_counts(audit: DataFrame) -> DataFrame:
    """Jobs per queue and state; depth is what waits."""
    counts = audit.groupBy("queue").pivot("status", QUEUE_STATES).count().fillna(0)
    return counts.withColumn("depth", F.col("waiting"))


def personal_export(users: DataFrame, profiles: DataFrame, filters: DataFrame, subscriptions: DataFrame, matches: DataFrame) -> DataFrame:
    """Everything held about each user as (user_id, section, item JSON) rows.

    Long form: write it partitioned by user; no user's data is gathered in one row.
    """
    nested = profiles_with_filters(profiles, filters)
    mine = matches.join(profiles.select("profile_id", "user_id"), "profile_id")
    section = lambda name, df, cols: df.select("user_id", F.lit(name).alias("section"), F.to_json(F.struct(*cols)).alias("item"))
    return (
        section("account", users, ["email", "status"])
        .unionByName(section("profile", nested, ["profile_id", "is_active", "filters"]))
        .unionByName(section("subscription", subscriptions, ["subscription_id", "chat_id", "enabled"]))
        .unionByName(section("match", mine, ["profile_id", "listing_id", "state"]))
    )


def erase_users(users: DataFrame, profiles: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users marked deleted, profiles switched off, audit rows) for the erasure requests."""
    ids = requests.select("user_id").distinct().withColumn("_erase", F.lit(True))
    hit = F.coalesce("_erase", F.lit(False))
    u = users.join(ids, "user_id", "left")
    u = u.withColumn("status", F.when(hit, "deleted").otherwise(F.col("status"))).drop("_erase")
    p = profiles.join(ids, "user_id", "left").withColumn("is_active", F.col("is_active") & ~hit).drop("_erase")
    audit = users.join(ids, "user_id", "left_semi").select("user_id", F.lit("user.delete").alias("action"))
    return u, p, audit


def purge(table: DataFrame, requests: DataFrame, key: str = "user_id") -> DataFrame:
    return table.join(requests.select(key).distinct(), key, "left_anti")


def city_overview(listings: DataFrame) -> DataFrame:
    """Listings per city with one sample title."""
    return listings.groupBy("city").agg(F.count("*").alias("listings"), F.min("title").alias("sample_title"))


def subscription_state(commands: DataFrame) -> DataFrame:
    """Enabled flag per (user, chat) after the command log.

    link and resume switch on, pause and stop switch off; the last command counts.
    """
    effect = F.when(F.col("command").isin("link", "resume"), True).when(F.col("command").isin("pause", "stop"), False)
    rows = commands.withColumn("_on", effect).filter("_on is not null")
    return rows.groupBy("user_id", "chat_id").agg(
        F.max_by("_on", F.struct("at", "command_id")).alias("enabled"),
        F.min(F.when(F.col("command") == "link", F.col("at"))).alias("linked_at"),
    )


def filter_metadata(definitions: DataFrame, locale: str = "de") -> DataFrame:
    label = F.coalesce(F.element_at("label", F.lit(locale)), F.element_at("label", F.lit("de")), F.col("key"))
    return definitions.filter("is_active").select("key", label.alias("label"), "data_type").orderBy("key")


def title_trigrams(c: Column) -> Column:
    """Distinct trigrams of the lower-cased text, padded like the usual index does."""
    t = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3))))


def similar_titles(listings: DataFrame, query: str, threshold: float = 0.3) -> DataFrame:
    """Distinct titles with trigram similarity to the query; counts instead of repeats."""
    titles = listings.filter("title is not null").groupBy("title").agg(F.count("*").alias("listings"))
    q = title_trigrams(F.lit(query))
    both = F.size(F.array_intersect(title_trigrams(F.col("title")), q))
    sim = both / (F.size(title_trigrams(F.col("title"))) + F.size(q) - both)
    return titles.withColumn("similarity", sim).filter(F.col("similarity") >= threshold)


WORDS = 4


def _signature(grams: str) -> list[Column]:
    """Which of 256 bits the trigrams fall on, as four longs."""
    place = lambda g: F.pmod(F.xxhash64(g), F.lit(64 * WORDS))
    bit = lambda g, k: F.when(F.floor(place(g) / 64) == k, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place(g), F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long"))
    word = lambda k: F.aggregate(grams, F.lit(0).cast("long"), lambda have, g: have.bitwiseOR(bit(g, k)))
    return [word(k) for k in range(WORDS)]


class TitleIndex:
    """Titles with the posting lists of their trigrams, as tables under ``path``.

    Two sets of ``n`` and ``m`` trigrams with similarity ``t`` or more share at least
    ``t / (1 + t) (n + m)`` of them. With all trigrams in one order, rarest first, the first one they share
    stands early enough in both for that many to follow: only such postings make candidates, and
    common trigrams, which stand late, make hardly any. A posting also tells which of 256 bits the
    title's trigrams fall on; bits that only one side has are trigrams that are not shared, so most
    pairs go before they are shuffled. Postings are sorted by trigram and length.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def build(self, listings: DataFrame) -> None:
        """Of the distinct titles; null ones are left out."""
        titles = listings.filter("title is not null").groupBy("title").agg(F.count("*").alias("listings"))
        titles = titles.withColumn("grams", title_trigrams(F.col("title"))).withColumn("n_grams", F.size("grams")).withColumn("key", F.xxhash64("title"))
        titles.write.parquet(f"{self.path}/titles")
        signature = [f"s{k}" for k in range(WORDS)]
        titles = self._table("titles").select("key", "n_grams", "grams", *[c.alias(n) for c, n in zip(_signature("grams"), signature)])
        grams = titles.select("key", "n_grams", F.explode("grams").alias("gram"), *signature)
        grams.groupBy("gram").agg(F.count("*").alias("titles")).write.parquet(f"{self.path}/counts")
        rarest = Window.partitionBy("key", "n_grams").orderBy("titles", "gram")
        postings = grams.join(self._table("counts"), "gram").select("gram", "n_grams", F.row_number().over(rarest).alias("place"), "key", *signature)
        postings.repartitionByRange("gram", "n_grams").sortWithinPartitions("gram", "n_grams").write.parquet(f"{self.path}/postings")

    def _signed(self, queries: DataFrame) -> DataFrame:
        """Trigrams and bits of the queries as a table: bits are folded over stored trigrams, once."""
        root = f"{self.path}/queries-{uuid.uuid4().hex}"
        queries.filter("text is not null").select("query_id", title_trigrams(F.col("text")).alias("grams")).write.parquet(root)
        return self.spark.read.parquet(root).select("*", *[c.alias(f"q{k}") for k, c in enumerate(_signature("grams"))])

    def candidates(self, queries: DataFrame, threshold: float) -> DataFrame:
        """(query_id, key) of the titles that may be similar enough; ``queries``: query_id, text."""
        signed = self._signed(queries)
        grams = signed.select("query_id", F.explode("grams").alias("gram"), F.size("grams").alias("n"), *[f"q{k}" for k in range(WORDS)])
        # Trigrams of no title come first: they take places that nothing is shared at.
        rarest = Window.partitionBy("query_id").orderBy(F.coalesce("titles", F.lit(0)), "gram")
        ranked = grams.join(self._table("counts"), "gram", "left").withColumn("rank", F.row_number().over(rarest))
        shared = F.ceil((F.col("n") + F.col("n_grams")) * (threshold / (1 + threshold)) - 1e-9)
        early = F.least(F.col("n") - F.col("rank"), F.col("n_grams") - F.col("place")) + 1 >= shared
        only = lambda a, b: sum((F.bit_count(F.col(f"{a}{k}").bitwiseAND(F.bitwise_not(F.col(f"{b}{k}")))) for k in range(WORDS)), F.lit(0))
        alike = (F.col("n") - only("q", "s") >= shared) & (F.col("n_grams") - only("s", "q") >= shared)
        # The shortest title that can match bounds the rank before any posting is read.
        ranked = ranked.filter("titles is not null").filter(F.col("n") - F.col("rank") + 1 >= F.col("n") * threshold - 1e-9)
        found = ranked.join(self._table("postings"), "gram").filter(early & alike & (F.col("n_grams") * threshold <= F.col("n") + 1e-9))
        return found.select("query_id", "key").distinct()

    def search(self, queries: DataFrame, threshold: float = 0.3) -> DataFrame:
        """(query_id, title, listings, similarity) of all titles of at least that similarity."""
        texts = queries.filter("text is not null").select("query_id", title_trigrams(F.col("text")).alias("wanted"))
        found = self.candidates(queries, threshold).join(self._table("titles"), "key").join(texts, "query_id")
        both = F.size(F.array_intersect("grams", "wanted"))
        found = found.withColumn("similarity", both / (F.col("n_grams") + F.size("wanted") - both))
        return found.filter(F.col("similarity") >= threshold).select("query_id", "title", "listings", "similarity")


def current_consents(log: DataFrame) -> DataFrame:
    """Current consent per user and type from the append-only log."""
    return log.groupBy("user_id", "consent_type").agg(
        F.max_by("granted", F.struct("recorded_at", "consent_id")).alias("granted"), F.max("recorded_at").alias("recorded_at")
    )
