"""Sign-ups against participation that is grouped first: rows of drives the batch doesn't name are left out before."""

import pytest
from micro import micro_tables, values

from tidecrew.operators import changes
from tidecrew.plans import keyed
from tidecrew.sources.requests import request_batch


@pytest.mark.parametrize("few", [0, 1, 1 << 16])
def test_sign_ups_with_few_and_many_drives(spark, monkeypatch, few):
    monkeypatch.setattr(keyed, "FEW", few)
    t = micro_tables(spark, drive_volunteers=[{"event_id": e, "volunteer_id": v} for e, v in [(1, 5), (1, 5), (2, 6), (3, 7), (None, 5), (1, None)]])
    batch = [(1, 1, 5), (2, 1, 6), (3, 1, 6), (4, 2, 6), (5, None, 5), (6, None, 5), (7, 1, None), (8, 9, 9)]
    requests = spark.createDataFrame(batch, "request_id long, event_id long, volunteer_id long")
    rows = values(changes.join_drives(t, requests).verdicts, "request_id", "reason")
    assert len(rows) == len(batch) and {r for r, reason in rows if reason} == {1, 3, 4}


def test_drives_outside_the_batch_are_dropped_before_the_grouping(spark, small):
    """All participation was grouped and sorted, however few drives a batch named."""
    verdicts = changes.join_drives(small, request_batch(small, "join_requests")).verdicts
    lines = verdicts._jdf.queryExecution().optimizedPlan().toString().split("\n")
    scan = next(i for i, line in enumerate(lines) if "Relation [l_orderkey" in line)
    grouped, dropped = (max(i for i, line in enumerate(lines[:scan]) if word in line) for word in ("Aggregate [l_orderkey", "Join LeftSemi, (l_orderkey"))
    assert grouped < dropped
