"""The publish history takes every event."""

import datetime as dt
from types import SimpleNamespace

from placewise.plans import queries


def test_every_event_counts(spark):
    days = [(1, 0), (2, 2), (3, 2), (4, 3), (5, 9), (6, 9), (7, 10)]
    rows = [(i, "click", dt.datetime(2024, 1, 1, 7) + dt.timedelta(days=d)) for i, d in days] + [(8, "view", dt.datetime(2024, 1, 1))]
    t = SimpleNamespace(events=spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp"))
    got = sorted((r.layer, r.edited_at.day, r.seconds) for r in queries.source_intervals.__wrapped__(t).collect())
    day = 86_400
    assert got == [("click", 1, None), ("click", 3, 2 * day), ("click", 4, day), ("click", 10, 6 * day), ("click", 11, day), ("view", 1, None)]
    est = {r.layer: r for r in queries.source_estimate.__wrapped__(t).collect()}
    assert (est["click"].intervals, est["click"].median_days, est["click"].estimated_next) == (4, 1.5, dt.datetime(2024, 1, 12, 12))
    assert not est["view"].known
