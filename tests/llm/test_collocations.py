"""Collocations against a brute-force count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexloom.llm import collocations

DOCS = "doc_id long, text string, lang string, phrase string, k int, n long, w int"


def brute(docs, least=30, top=2000):
    words, found = Counter(), defaultdict(Counter)
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, 5):
                found[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in found.items():
        rows = []
        for g, a in f.items():
            if len(g) < 2 or a < least:
                continue
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            inside = (h for h, b in f.items() if len(h) > len(g) and b >= least and 100 * b >= 80 * a)
            if not any(h[i : i + len(g)] == g for h in inside for i in range(len(h) - len(g) + 1)):
                rows.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, words[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def odd_docs():
    r = random.Random(8)
    common = ["The", "of", "A", "é", "ÀB", "x-y", "e f", "\x1c", "漢字", "q"]
    docs = []
    for i in range(2500):
        w = [r.choice(common) if r.random() < 0.8 else f"w{r.randrange(500)}" for _ in range(r.randrange(60))]
        if i % 3 == 0:
            w[r.randrange(len(w) + 1) :] = "Hot phrase of words".split()
        sep = lambda: r.choice([" ", " ", " ", "  ", "\t", " \t ", ". ", ",", "\n", "\x0b", "\r\n", "; ", "?!"])
        docs.append((r.choice(["en", "en", "fr", "", None, "und"]), "".join(x + sep() for x in w)))
    return [*docs, ("en", None), (None, ""), ("fr", " \n"), ("en", "long word " * 20_000), ("de", "z" * 150_000), *[("es", "the same words in every text")] * 60]


@pytest.mark.parametrize("at_most", [collocations.BROADCAST_BYTES, 0])
def test_collocations_equal_brute_force(spark, monkeypatch, at_most):
    docs = odd_docs()
    monkeypatch.setattr(collocations, "FEWEST_CELLS_LOG2", 14)  # so many phrases share cells
    monkeypatch.setattr(collocations, "RANGE_LOG2", 11)
    frame = spark.createDataFrame([(i % 7, t, lang, "x", 1, 2, 3) for i, (lang, t) in enumerate(docs)], DOCS).repartition(6)
    got = collocations.collocations(frame, at_most=at_most)
    assert got.columns == "lang rank phrase a l r n score".split()
    want = brute(docs)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 40
    assert sorted(map(tuple, collocations.collocations(frame, top=3, at_most=at_most).collect())) == [x for x in want if x[1] <= 3]


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, 1, 1, 1), (2, "a b", "en", None, 1, 1, 1)], DOCS)).count() == 0


def test_scores_past_64_bits(spark):
    big = 4 * 10**18
    known = [("en", "a b", 2, big), ("en", "a", 1, big + 3), ("en", "b", 1, 9 * 10**18), ("en", "a b c", 3, big // 2), ("en", "b c", 2, big), ("en", "c", 1, big + 1)]
    frame = spark.createDataFrame(known, collocations.PARTIAL.replace("k int, n long", "k int, n long"))
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in collocations.scored(frame).collect()}
    f = {p: n for _, p, _, n in known}
    assert got["a b"] == (big, f["a"], f["b"], 2_000_000 * big // (f["a"] + f["b"]))
    cuts = [(2_000_000 * f["a b c"] // (f["a"] + f["b c"]), 1, f["a"], f["b c"]), (2_000_000 * f["a b c"] // (f["a b"] + f["c"]), 2, f["a b"], f["c"])]
    assert got["a b c"] == (f["a b c"], *min(cuts)[2:], min(cuts)[0])


def test_a_sketch_never_counts_less(spark):
    """Every phrase that occurs often enough has both its cells set, also when they are merged from many batches."""
    docs = [("en", "one two three four five " * 3)] * 20
    rows = spark.createDataFrame(docs, "lang string, text string").repartition(20)
    bits = {(r.row, r.range): bytes(r.bits) for r in collocations.sketch(rows, 16, 12).collect()}
    for _, h in collocations.phrases(collocations.normal([docs[0][1]]), "en")[2]:
        for row in range(collocations.ROWS):
            for c in collocations.cell(h, row, 16).tolist():
                assert bits[row, c >> 12][(c & 4095) >> 3] >> (c & 7) & 1


def test_folded_bits_lose_no_cell_and_rare_phrases_are_not_shuffled(spark):
    r = random.Random(6)
    docs = [("en", " ".join(f"w{r.randrange(20_000)}" for _ in range(200)) + " one two three") for _ in range(200)]
    rows = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    bits = collocations.sketch(rows, 18, 12).cache()
    at = lambda frame, inner: {(x.row, (x.range << inner) + int(c)) for x in frame.collect() for c in np.flatnonzero(np.unpackbits(np.frombuffer(bytes(x.bits), np.uint8), bitorder="little"))}
    for to_log2 in (15, 10):  # more and fewer cells than a range has
        fold, inner = collocations.folded(bits, 18, 12, to_log2)
        assert inner == min(12, to_log2) and at(fold, inner) == {(row, c & ((1 << to_log2) - 1)) for row, c in at(bits, 12)}
    got = collocations.exact(rows, bits, 18, 12, 2 << 13)  # 2^16 cells a row
    assert "Join" not in got._jdf.queryExecution().toString()
    assert {"one two three", "one two", "two three"} == {x.phrase for x in got.collect() if x.k >= 2}
