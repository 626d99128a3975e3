"""Pending events against a serial replay, with many versions a listing and with hot listings."""

import pytest
from pyspark.sql import functions as F

from dwellmatch.operators import upsert
from dwellmatch.plans import adapter as A
from dwellmatch.plans import frames as fr


@pytest.mark.parametrize("min_rows", [500_000, 50])
def test_pending_events_equal_serial_replay(spark, sf, min_rows):
    rows = fr.incoming(spark, sf).where("s1 % 4 = 0").withColumn("listing_id", (F.col("s1") % 20).cast("string"))
    rows = rows.withColumn("fingerprint", F.col("listing_id")).withColumn("handed", F.when(F.col("s3") % 5 > 0, F.col("s3") % 3 == 0))
    got = upsert.listing_versions(rows, seq=A.SEQ, min_rows=min_rows).select("listing_id", "seen_at", *A.SEQ, "outcome", "quarantined", "significant", "handed", "event", "change_version").collect()
    pending, again = {}, 0
    for r in sorted(got, key=lambda r: (r.listing_id, r.seen_at, *[r[c] for c in A.SEQ])):
        before = pending.get(r.listing_id)
        stamp = r.seen_at.strftime("%Y-%m-%dT%H:%M:%S.000Z")
        if r.outcome == "new" and not r.quarantined or before and before[0] == "created":
            event = ("created", None)
        elif r.significant:
            event = ("changed", stamp)
        else:
            event = before
        assert (r.event, r.change_version) == (event or (None, None))
        again += event is not None and event == before
        # A row that says nothing counts as handed over.
        pending[r.listing_id] = event if r.handed is False else None
    assert again > 20 and len({r.listing_id for r in got}) <= 20
