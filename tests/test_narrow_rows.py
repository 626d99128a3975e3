"""What queries shuffle: narrow rows and short keys."""

import datetime

import pytest

from dwellmatch.functions.keys import soft_fingerprint
from dwellmatch.operators import upsert
from dwellmatch.plans import frames as fr
from dwellmatch.plans import q_extract, q_upsert

TABLES = {
    "region": ("r_regionkey long, r_name string", [(0, "ASIA"), (1, "NOWHERE")]),
    "nation": ("n_nationkey long, n_name string, n_regionkey long", [(0, "N0", 0), (1, "N1", 1)]),
    "supplier": ("s_suppkey long, s_nationkey long", [(17, 0), (2, 1), (9, 0)]),
    "part": ("p_partkey long, p_name string, p_size int", [(1, "one", 10), (2, None, 11), (3, "x" * 501, 12)]),
}
LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Listings whose newest observation fails the gate, rows without keys, rows that come twice."""
    root = str(tmp_path_factory.mktemp("odd"))
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    line = lambda order, no, part, supp, day, price=40000.0: (order, no, part, supp, 5.0, price, 0.0, 0.0, "N", "O", datetime.datetime(1998, 1, day))
    rows = [
        line(1, 1, 1, 17, 1), line(1, 1, 3, 17, 2),  # the newest title is too long
        line(2, 1, 3, 17, 1), line(2, 1, 1, 17, 2, 44000.0),  # the newest one is fine again
        line(3, 1, 1, 2, 1), line(4, 1, 2, 17, 1), line(5, 2, 1, 9, 1), line(5, 2, 1, 9, 1),
        line(None, 1, 1, 17, 1), line(6, None, 1, 17, 3), line(7, 1, None, 17, 1), line(8, 1, 1, None, 1), line(9, 1, 99, 17, 1),
    ]
    spark.createDataFrame(rows, LINE).coalesce(1).write.parquet(f"{root}/lineitem.parquet")
    return root


def nodes(plan):
    yield plan
    children = plan.children()
    for k in range(children.size()):
        yield from nodes(children.apply(k))


def windowed(df):
    """Columns that windows of the plan work on."""
    found = [n for n in nodes(df._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Window"]
    return {c.split("#")[0] for n in found for c in n.output().mkString(" ").split()}


def test_live_columns_are_those_of_live(spark, odd):
    columns = ["listing_id", "source_slug", "title", "price", "area", "s3"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    got = fr.live_columns(spark, odd, *columns[1:])
    assert rows(got) == rows(fr.live(spark, odd)) and got.columns == columns
    ids = {r.listing_id for r in got.collect()}
    assert {"src1|2-1", "src1|5-2"} <= ids and "src1|1-1" not in ids


def test_soft_groups_shuffle_neither_titles_nor_digests(spark, odd):
    out = q_upsert.soft_groups(spark, odd)
    assert "p_name" not in windowed(out) and "n_name" not in windowed(out) and "ok" in windowed(out)
    assert "hashpartitioning(soft_fingerprint" not in out._jdf.queryExecution().executedPlan().toString()


def test_group_digest_is_that_of_each_member(spark):
    rows = [("a", "s1", "10115", 50.4, 2.0, 624.0), ("b", "s2", "10115", 51.0, 2.0, 625.0), ("c", "s2", "10115", 50.9, 2.0, 649.0), ("d", "s1", None, None, None, None), ("e", "s1", "", None, 2.5, None)]
    df = spark.createDataFrame(rows, "listing_id string, source_slug string, postal_code string, area double, rooms double, price double")
    want: dict = {}
    for r in df.withColumn("f", soft_fingerprint()).collect():
        want.setdefault(r.f, []).append(r)
    got = {r.soft_fingerprint: (r.group_id, r.listings, r.sources, r.cross_source) for r in upsert.duplicate_groups(df).collect()}
    assert got == {f: (min(m.listing_id for m in ms), len(ms), len({m.source_slug for m in ms}), len({m.source_slug for m in ms}) > 1) for f, ms in want.items()}


def test_details_are_merged_where_the_listings_are(spark, odd):
    plan = q_extract.merged_details(spark, odd)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(adid" not in plan and "hashpartitioning(replace" not in plan
