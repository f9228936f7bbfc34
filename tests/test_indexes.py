"""Suffix automaton, Bloom filter, sketches and the packing function against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import bloom, runs, sketches
from lexloom.operators.training_rows import next_fit

TEXTS = "doc_id long, text string, source string, key int, w int"
ITEMS = "item_id long, text string, key int"


def some_texts(r, n, words):
    return [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 8, 30, 120]))) for _ in range(n)]


def longest(a, b):
    """The longest common run of two lists, by all places."""
    best, row = 0, defaultdict(int)
    for x in a:
        row = defaultdict(int, {j: row[j - 1] + 1 for j, y in enumerate(b) if x == y})
        best = max([best, *row.values()])
    return best


@pytest.mark.parametrize("most_words", [10**6, 40])
def test_longest_runs_of_any_length(spark, most_words):
    r = random.Random(2)
    for alphabet in (["a", "b"], [f"w{i}" for i in range(40)]):
        texts, items = some_texts(r, 30, alphabet), some_texts(r, 12, alphabet)
        items += [items[3], "nothing shared", None, ""]
        rows = [(i % 25, t, "s", 1, 2) for i, t in enumerate(texts)] + [(None, items[0], "s", 1, 2), (3, None, "s", 1, 2)]
        docs = spark.createDataFrame(rows, TEXTS).repartition(4)
        got = {x.item_id: (x.longest, x.doc_id) for x in runs.longest_runs(docs, spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], ITEMS), most_words=most_words).collect()}
        for i, t in enumerate(items):
            by_doc = [(longest((x or "").split(), (t or "").split()), -k) for k, x, *_ in rows if k is not None]
            n, k = max(by_doc)
            assert got[i] == ((n, -k) if n else (0, None))
        assert runs.longest_runs(docs.limit(0), spark.createDataFrame([(1, "a", 0)], ITEMS)).collect() == [(1, 0, None)]


def test_filter_keeps_all_and_little_else(spark, monkeypatch):
    monkeypatch.setattr(bloom, "HASHES_AT_ONCE", 3000)
    r = random.Random(3)
    hashes = [[r.randrange(-(1 << 63), 1 << 63) for _ in range(r.choice([0, 1, 400]))] for _ in range(150)]
    hashes += [hashes[0], None, [hashes[1][0]] * 500 if hashes[1] else [5] * 500]
    own = {h for x in hashes if x for h in x}
    f = bloom.build(spark.createDataFrame([(x,) for x in hashes], "hs array<long>").repartition(5), len(own))
    rows = spark.createDataFrame([(h,) for h in [*own, None]], "h long")
    assert {x.h for x in bloom.maybe(f, rows).collect()} == own
    others = spark.createDataFrame([(r.randrange(-(1 << 63), 1 << 63),) for _ in range(40_000)], "h long")
    assert bloom.maybe(f, others).count() <= 0.012 * 40_000
    empty = bloom.build(spark.createDataFrame([], "hs array<long>"), 0)
    assert bloom.maybe(empty, rows).count() == 0


def test_large_filters_are_dealt_by_block(spark):
    """The same blocks by Spark and by numpy, also for the largest filter; shards stay bounded."""
    hs = [0, 1, -1, 1 << 62, -(1 << 63), (1 << 63) - 1, 12345678901234567]
    for blocks in (1, 3, 1000, (1 << 31) - 1):
        want = (bloom.positions(np.array(hs, np.int64).view(np.uint64), blocks)[:, 0] >> np.uint64(bloom.BLOCK_LOG2)).tolist()
        frame = spark.createDataFrame([(i, h) for i, h in enumerate(hs)], "i int, h long")
        assert [x.b for x in frame.select("i", bloom.block_of(F.col("h"), blocks).alias("b")).orderBy("i").collect()] == want and max(want) < blocks
    assert bloom.shape(0) == (1, 20) and bloom.shape(10**10)[1] == 25 and bloom.shape(10**11)[1] == 26
    with pytest.raises(ValueError):
        bloom.shape(10**12)


def test_items_met(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "s", 1, 1), (2, None, "s", 1, 1), (3, "x", "s", 1, 1)], TEXTS)
    items = spark.createDataFrame([(1, "z b c d", 0), (2, "c d e f", 0), (3, None, 0), (4, "a b", 0)], ITEMS)
    assert sorted(tuple(x) for x in bloom.items_met(docs, items, 3).collect()) == [(1, 1), (2, 1)]


def test_sketches_merge(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["u", "v", "w", "x", "y"]) for _ in range(60)), r.choice(["s", "t", None]), 1, 2) for i in range(60)]
    docs = spark.createDataFrame([*rows, (99, None, "s", 1, 1), (98, "too short", "t", 1, 1)], TEXTS)
    exact = defaultdict(set)
    for _, t, s, *_ in rows:
        w = t.split()
        exact[s] |= {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    kept = sketches.ngram_sketches(docs, ["source", "key"])
    by = {x.source: (x.by_hll, x.by_theta) for x in sketches.estimated(sketches.rolled_up(kept, ["source"])).collect()}
    assert by.keys() == exact.keys()
    for s, (hll, theta) in by.items():
        assert abs(hll - len(exact[s])) <= 0.03 * len(exact[s]) and theta == len(exact[s])  # few enough to be kept whole
    pair = {(x.a, x.b): x.common for x in sketches.overlaps(sketches.rolled_up(kept, ["source"]), "source").collect()}
    assert pair == {("s", "t"): len(exact["s"] & exact["t"])}


def test_next_fit_streams(spark):
    rows = [(0, 5), (1, 5), (2, 1), (3, 11), (4, None), (7, 10), (10, 4), (12, 4), (13, 3), (13, 1)]
    got = sorted(tuple(x) for x in next_fit(spark.createDataFrame(rows, "id long, size int").repartition(3), "id", "size", 10, shard=10).collect())
    assert got == [(0, 0, 0, 0), (0, 1, 0, 5), (0, 2, 1, 0), (0, 7, 2, 0), (1, 10, 0, 0), (1, 12, 0, 4), (1, 13, 0, 8), (1, 13, 1, 0)]


def test_probes_meet_one_shard_at_a_time(spark, monkeypatch):
    """However many shards a filter has, a task holds one of them; hashes are counted by shard."""
    monkeypatch.setattr(bloom, "SHARD_LOG2", 12)
    monkeypatch.setattr(bloom, "POSITIONS_AT_ONCE", 50)
    r = random.Random(5)
    own = [r.randrange(-(1 << 63), 1 << 63) for _ in range(30_000)]
    frame = spark.createDataFrame([(own[i : i + 100] + own[:3],) for i in range(0, len(own), 100)], "hs array<long>").repartition(4)
    f = bloom.build(frame, len(own))
    assert f.table.count() > 50
    assert tuple(bloom.counted(f, frame).first()) == (len(set(own)), len(set(own)))
    absent = spark.createDataFrame([([r.randrange(-(1 << 63), 1 << 63) for _ in range(40_000)],)], "hs array<long>")
    n, held = bloom.counted(f, absent).first()
    assert n == 40_000 and held <= 500
    assert tuple(bloom.counted(f, absent.limit(0)).first()) == (0, 0)
    plan = bloom.maybe(f, spark.createDataFrame([(h,) for h in own], "h long"))._jdf.queryExecution().toString()
    assert "collect_list" not in plan
