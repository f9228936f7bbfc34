"""Late and repeated rows in a stream against a batch version of the same arrival."""

import time
from datetime import datetime, timedelta, timezone

from lexloom.streaming import live


def test_late_rows_are_dropped_and_counted(spark, monkeypatch):
    monkeypatch.setattr(live, "ARRIVAL_FILES", 1)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    at = lambda m: start + timedelta(minutes=m)
    # (key, minute, place): five parts of ten places; the delay is ten minutes, and Spark drops what is behind the watermark of the micro-batch before
    rows = [(1, 0, 0), (2, 5, 1), (1, 0, 2), (3, 60, 9), (4, 55, 10), (5, 49, 11), (5, 51, 12), (2, 5, 13), (None, 58, 14), (None, 59, 15), (6, 100, 20), (3, 60, 30), (7, 95, 31), (4, 55, 32), (6, 100, 39), (3, 60, 40), (4, 55, 41), (8, 91, 49)]
    frame = spark.createDataFrame([(k, at(m), p) for k, m, p in rows], "event_id long, ts timestamp, place long")
    heard, progress = [], []
    listener = live.LateRows(lambda name, n: heard.append(n))
    spark.streams.addListener(listener)
    try:
        kept = live.finished(live.first_events(live.arriving(frame, "place", 5), delay="10 minutes"), progress=progress).collect()
        for _ in range(100):
            if heard and heard[-1] == 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sorted((r.event_id is not None, r.event_id) for r in kept if r.event_id is not None) == [(True, k) for k in range(1, 9)]
    assert sum(r.event_id is None for r in kept) == 1  # a missing key is a key
    assert live.dropped_late(progress) == 2 and heard[-1] == 2  # minutes 60 and 55 of the last part
