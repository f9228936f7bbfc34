"""The stateful health checks against the batch operator, with ranks that come late, in any order, and runs that fall silent."""

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexloom.operators.evaluation import health_alerts
from lexloom.streaming import health, live

LOG = "run long, step long, rank long, ts timestamp, loss double, grad_norm double, seconds double, last_saved long, param_hash long, place long"


@pytest.fixture
def rocksdb(spark):
    for k, v in live.ROCKSDB.items():
        spark.conf.set(k, v)
    yield
    for k in live.ROCKSDB:
        spark.conf.unset(k)


def test_stream_equals_batch(spark, rocksdb):
    r, rows, start = random.Random(3), [], datetime(2024, 1, 1, tzinfo=timezone.utc)
    for run, begin, n in ((1, 0, 90), (2, 300, 150), (3, 100, 5)):
        for step in range(n):
            for rank in range(3):
                odd = r.random()
                loss = None if odd < 0.02 else float("inf") if odd < 0.04 else r.random() * 3
                rows.append([run, step, rank, start + timedelta(seconds=begin + 10 * step + rank), loss, r.choice([0.0, 1.0, 5.0, 11.0, None]), r.choice([1.0, 1.1, 1.2, 4.0]), step // 40 * 40, step if odd < 0.97 else -1])
    end = start + timedelta(seconds=4000)
    rows.append([9, 0, 0, end, 1.0, 1.0, 1.0, 0, 1])  # moves the watermark on
    # a rank comes up to 20 seconds late, across micro-batches
    rows.sort(key=lambda x: x[3] + timedelta(seconds=r.random() * 20))
    frame = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], LOG)
    bounds = health.Bounds(stale=30, recent=20, slot_ms=5_000, silence_ms=60_000)
    got = live.finished(health.health_checks(live.arriving(frame, "place", 6), bounds)).collect()
    want = set()
    for run in (1, 2, 3):
        batch = health_alerts(frame.where(F.col("run") == run), stale=30, recent=20).collect()
        want |= {(run, x.step, x.non_finite, x.spike, x.explosion, x.collapse, x.slow, x.stale, x.diverged, False) for x in batch}
    want |= {(run, n - 1, *[False] * 7, True) for run, n in ((1, 90), (2, 150), (3, 5))}
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert sum(any(x[2:9]) for x in want) > 20


def test_judging_of_missing_values():
    steps = pd.DataFrame([(0, 0, None, None, None, None, None, None, 0), (1, 0, 5.0, 0.0, 1.0, 0, 7, 8, 1), (2, 1, None, 20.0, 9.0, 0, 7, 7, 2)], columns=health.FIELDS)
    out, loss, times = health.judged(steps, 1.0, [], health.Bounds())
    assert [x[1:] for x in out] == [(False, False, False, False, False, True, False, False), (False, False, False, True, False, False, True, False), (True, False, True, False, True, False, False, False)]
    assert loss is None and times == [1.0, 9.0]
    assert health.slot_end(59_999, 60_000) == 60_000 and health.slot_end(60_000, 60_000) == 120_000
