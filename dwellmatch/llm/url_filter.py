"""URL filter: domain rules, then a blocked Bloom filter in front of an exact join with a list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellmatch.llm.common import Shelf

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Parameters that say where a visitor came from, not which page is meant.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|msclkid|mc_cid|mc_eid|igshid)(=|$)"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains, and paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_after(url), "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def canonical(url: Column) -> Column:
    """Scheme, user, port, ``www.``, fragment, tracking parameters, a trailing slash and ``.html`` are dropped;
    parameters are sorted. Null without ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^.*@", ""), ":[0-9]*$", "")
    host = F.regexp_replace(host, "^www[.]", "")
    path = F.regexp_replace(path_of(url), "([.]html?|/+)$", "")
    query = F.regexp_extract(_after(url), "^[^?#]*[?]([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, tail))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (of equally long ones the first); null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


WORDS = 4


def bits_of(key: Column) -> list[Column]:
    """One bit for each of the four words of a block, from a hash other than the block's."""
    h = F.xxhash64(key, F.lit(7))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_blocks(listed: DataFrame, column: str, n_blocks: int) -> DataFrame:
    """(block, w0..w3): 256 bits a block, set by or-ing masks, which combines before the shuffle.

    At most ``n_blocks`` rows of 40 bytes, whatever the length of the list.
    """
    key = F.col(column)
    rows = listed.where(key.isNotNull()).select(F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits_of(key))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    bits_per_url: int = 16,
    max_blocks: int = 1 << 18,
) -> DataFrame:
    """Verdict per page: (id, host, path, rule, verdict).

    ``listed`` has one column of canonical urls to block (nulls and repeats are harmless). A page
    that a rule fits gets the rule's verdict. Of the others, those whose canonical url may be in
    the list by a blocked Bloom filter meet the list in an exact join, which removes the false
    positives; all the rest are allowed without a shuffle. The filter is broadcast: it has at most
    ``max_blocks`` blocks (40 bytes each, 10 MB by default); a longer list makes it fuller, so
    that more pages go to the join, and changes no verdict.

    A null url, or one without ``://``, has empty host and path and is allowed. Repeated rows each
    get their row; an empty table gives no rows; other columns are not looked at.
    """
    shelf = Shelf(pages.sparkSession, "url-filter")
    keys = shelf.put(listed.select(F.col(listed.columns[0]).cast("string").alias("key")).where("key is not null").distinct(), "listed")
    wanted = -(-keys.count() * bits_per_url // 256)
    n_blocks = max(1, min(max_blocks, wanted))
    blocks = F.broadcast(bloom_blocks(keys, "key", n_blocks))

    url = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"), canonical(url).alias("key"))
    text, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    base = base.select("*", text.alias("rule"), verdict.alias("by_rule"), F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("block"))
    may = F.lit(True)
    for i, bit in enumerate(bits_of(F.col("key"))):
        may = may & (F.col(f"w{i}").bitwiseAND(bit) == bit)
    may = F.coalesce(F.col("by_rule").isNull() & F.col("key").isNotNull() & may, F.lit(False))
    probed = base.join(blocks, "block", "left").select(id_col, "host", "path", "key", "rule", "by_rule", may.alias("may"))

    out = [id_col, "host", "path", "rule"]
    passed = probed.where(~F.col("may")).select(*out, F.coalesce("by_rule", F.lit("allow")).alias("verdict"))
    exact = probed.where("may").join(keys.select("key", F.lit(True).alias("hit")), "key", "left")
    checked = exact.select(*out, F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
    return passed.unionByName(checked)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def possible(df: DataFrame, key: Column, keys: DataFrame, bits_per_key: int = 16, max_blocks: int = 1 << 18, made: str = "possible") -> DataFrame:
    """``df`` with a column ``made``: false only where ``key`` (not null) is surely not among ``keys``.

    ``keys`` has one column and should be a written table; the broadcast filter is bounded as in
    ``filter_urls``. The row's own columns are set aside while it meets the filter, so that they may have
    any names but ``made``.
    """
    name = keys.columns[0]
    n_blocks = max(1, min(max_blocks, -(-keys.count() * bits_per_key // 256)))
    blocks = F.broadcast(bloom_blocks(keys, name, n_blocks))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), key.alias("_key"))
    probed = rows.withColumn("block", F.pmod(F.xxhash64("_key"), F.lit(n_blocks))).join(blocks, "block", "left")
    may = F.lit(True)
    for i, bit in enumerate(bits_of(F.col("_key"))):
        may = may & (F.col(f"w{i}").bitwiseAND(bit) == bit)
    return probed.select("_row.*", F.coalesce(may, F.lit(False)).alias(made))
