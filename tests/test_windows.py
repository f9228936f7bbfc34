"""Windows of words by shard against brute force."""

import hashlib
import random

import numpy as np
import pytest

from lexloom.operators import dedup, windows


def some_docs(spark):
    r = random.Random(11)
    texts = [" ".join(r.choice("abcde") for _ in range(r.choice([0, 1, 4, 5, 12, 60]))) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate([*texts, texts[5], " ".join(["x"] * 90), None, ""])] + [(None, texts[7]), (-4, texts[9]), (200, "A b.c'd E-f")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows


def grams(text, n):
    import re

    w = re.findall("[a-z0-9']+", (text or "").lower())
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("at_once", [2_000_000, 100])
def test_distinct_windows_send_few_bytes(spark, monkeypatch, at_once):
    monkeypatch.setattr(windows, "WORDS_AT_ONCE", at_once)
    docs, rows = some_docs(spark)
    got = {x.n: x.grams for x in windows.distinct_windows(docs, (1, 3, 5, 400)).collect()}
    assert got == {n: len({g for _, t in rows for g in grams(t, n)}) for n in (1, 3, 5, 400)}
    assert [x.grams for x in windows.distinct_windows(docs.limit(0), (2,)).collect()] == [0]


def test_windows_take_under_eight_bytes_each(spark):
    """What is sent of a large task is less than half of the sixteen bytes of two hashes."""
    docs = spark.range(300).selectExpr("id doc_id", "array_join(transform(sequence(1, 2000), i -> md5(concat(id, ':', i))), ' ') text").coalesce(1)
    blobs = windows.sent(windows.word_hashes(docs, None, "text"), (5,), False)
    assert blobs.selectExpr("sum(length(hs)) n").first().n < 8 * 300 * 1996


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    r = np.random.default_rng(3)
    sizes = np.array([3, 1, 40, 7, 2, 60])
    x = r.integers(0, 1 << 62, sizes.sum()).astype(np.uint64)
    whole = windows.hashed(x, sizes, 4)
    monkeypatch.setattr(windows, "HASHED_AT_ONCE", 9)
    assert all((a == b).all() for a, b in zip(whole, windows.hashed(x, sizes, 4), strict=True))
    assert len(whole[1]) == sum(max(0, s - 3) for s in sizes)


@pytest.mark.parametrize("own_keys", [True, False])
def test_repeated_windows_of_rows_that_share_a_key(spark, monkeypatch, own_keys):
    monkeypatch.setattr(windows, "WORDS_AT_ONCE", 100)
    docs, rows = some_docs(spark)
    if not own_keys:
        rows = [(None if k is None else k // 2, t) for k, t in rows] + [(None, "new " + rows[9][1])]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    met = {}
    for k, t in rows:
        for g in grams(t, 4):
            met.setdefault(hashlib.md5(" ".join(g).encode()).hexdigest(), []).append(k)
    want = {(h, len(ks), min((k for k in ks if k is not None), default=None)) for h, ks in met.items() if len(ks) > 1}
    got = [tuple(x) for x in dedup.repeated_windows(docs, 4).collect()]
    assert len(got) == len(want) and set(got) == want


def test_masked_words_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(windows, "WORDS_AT_ONCE", 100)
    docs, rows = some_docs(spark)
    rows = [(k, t) for k, t in rows if k is not None]
    seen, want = set(), {}
    for k, t in sorted(rows, key=lambda x: x[0]):
        w, gone = [g[0] for g in grams(t, 1)], set()
        for i, g in enumerate(grams(t, 4)):
            gone |= set(range(i, i + 4)) if g in seen else set()
            seen.add(g)
        want[k] = ([x for i, x in enumerate(w) if i not in gone], len(gone))
    got = {x.doc_id: (list(x.words), x.n_removed) for x in dedup.mask_repeated_windows(docs.where("doc_id is not null"), 4).collect()}
    assert got == want


def test_places_take_few_bytes(spark):
    """A window is sent with its place in less than the 24 bytes of two hashes and a key."""
    docs = spark.range(300).selectExpr("id doc_id", "array_join(transform(sequence(1, 2000), i -> md5(concat(id, ':', i))), ' ') text").coalesce(1)
    blobs = windows.sent(windows.word_hashes(docs, "doc_id", "text"), (20,), True)
    assert blobs.selectExpr("sum(length(hs) + length(keys) + length(places)) n").first().n < 12 * 300 * 1981


def test_windows_shared_by_groups_equal_brute_force(spark, monkeypatch):
    """Numbers of windows that groups share; with several sends a task, many groups, null ones and texts that are too short."""
    import random
    from itertools import combinations

    from lexloom.operators import windows

    monkeypatch.setattr(windows, "WORDS_AT_ONCE", 300)
    r = random.Random(9)
    rows = [(r.choice(["en", "fr", "é", "z", "empty", None]), " ".join(r.choice("abc") for _ in range(r.randrange(60)))) for _ in range(150)]
    rows = [(g, "a b" if g == "empty" else t) for g, t in rows] + [("en", None)]
    got = {(x.a, x.b): x.n for x in windows.shared_by(spark.createDataFrame(rows, "g string, text string"), "g", 5).collect()}
    sets = {}
    for g, t in rows:
        w = (t or "").split()
        if g and len(w) >= 5:
            sets.setdefault(g, set()).update(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = {(a, a): len(v) for a, v in sets.items()} | {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sorted(sets), 2)}
    assert got == {k: v for k, v in want.items() if v}


def test_overlap_of_languages_sends_windows_in_blobs(spark, monkeypatch):
    """The exact counts shuffle sorted hashes in blobs, not a row for each window; only the sketches read these."""
    from lexloom.operators import bloom
    from lexloom.plans import catalogue

    def rows(*args):
        raise AssertionError("a row for each window")

    query = catalogue.queries()["ngram_overlap_by_lang"]
    monkeypatch.setattr(bloom, "ngram_hashes", rows)  # sketches know the function by a name of their own
    assert query(spark, "/root/testdata/sf0.001").count() == 6
