"""Pairs of near hashes against brute force, and the rows that their join makes."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import dedup


@pytest.mark.parametrize(("bits", "most"), [(64, 3), (16, 1), (6, 1), (2, 1), (9, 0)])
def test_pairs_of_copies_and_near_hashes(spark, monkeypatch, bits, most):
    monkeypatch.setattr(dedup, "TOGETHER", 7)
    monkeypatch.setattr(dedup, "LISTED_PAIRS", 50)
    r = random.Random(bits)
    some = [r.getrandbits(bits) for _ in range(20)]
    some += [x ^ sum(1 << b for b in r.sample(range(bits), min(bits, r.choice([1, 2, 3, 4])))) for x in some * 3]
    rows = list(enumerate([*some, *[some[0]] * 30, *[some[1]] * 12]))
    signed = [(k, x - (1 << 64) if x >> 63 else x) for k, x in rows]
    df = spark.createDataFrame([*signed, (None, signed[0][1]), (900, None)], "k long, h long")
    got = [tuple(x) for x in dedup.hamming_pairs(df, "k", "h", bits, most).collect()]
    want = {(a, b, (x ^ y).bit_count()) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= most}
    assert len(got) == len(want) and set(got) == want


def test_a_common_slice_is_not_compared_pair_by_pair(spark):
    """2000 hashes share their lowest sixteen bits: by slices of sixteen bits two million pairs meet, by three of six slices few do."""
    r = random.Random(1)
    df = spark.createDataFrame([(r.getrandbits(47) << 16,) for _ in range(2000)], "h long").distinct()
    near = dedup.near_hashes(df, "h", 64, 3)
    assert near.isEmpty()
    plan = near._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("bit_count" in line for line in joins)


def test_written_pairs_of_large_groups_are_small(spark, tmp_path):
    """Eight hashes of 250 documents each, which come in no order: a million pairs, in rows whose columns repeat themselves. F6."""
    df = spark.range(2000).selectExpr("id * 12 k", "pmod(xxhash64(id), 8) h").orderBy("h", F.xxhash64("k"))
    out = dedup.hamming_pairs(df, "k", "h", 3, 1)
    out.coalesce(1).write.parquet(str(tmp_path / "pairs"))
    n, size = spark.read.parquet(str(tmp_path / "pairs")).count(), sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet"))
    rows = df.collect()
    assert n == sum(a.k < b.k and (a.h ^ b.h).bit_count() <= 1 for a in rows for b in rows)
    assert size < 0.8 * n


def test_a_key_with_two_hashes_is_no_pair_with_itself(spark):
    df = spark.createDataFrame([(1, 4), (1, 5), (2, 4), (3, 7)], "k long, h long")
    got = sorted(tuple(x) for x in dedup.hamming_pairs(df, "k", "h", 3, 1).collect())
    assert got == [(1, 2, 0), (1, 2, 1), (1, 3, 1)]
