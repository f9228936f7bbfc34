"""Blocks, byte-level pieces, contexts with needles and replicated mixes against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions import byte_level
from lexloom.operators import blocks, contexts

DOCS = "doc_id long, text string, name string, json string, source string, size int"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "n", "j", "s", 1) for i, t in enumerate(texts)], DOCS)


def test_states_of_blocks(spark):
    mark = lambda n, b: f"<!-- block:{n} -->\n{b}\n<!-- /block -->"
    texts = [
        "x\n" + mark("a", '{"y": [1, 2], "x": "é"}') + "\ntext\n" + mark("a", '{\n "x": "é",\n "y": [2, 1]\n}') + mark("b", "{") + mark("gone", "1"),
        mark("c", "null"), mark("d", "1.0"), None, "", "<!-- block:a -->\nnever closed", mark("bad", "{}") + "\n" + mark("a", ""),
    ]
    records = spark.createDataFrame([("a", '{"x":"é","y":[1,2]}'), ("b", '{"k":1}'), ("c", "null"), ("d", "1"), ("bad", "not json"), (None, "1")], "name string, json string")
    got = sorted(tuple(r) for r in blocks.states(docs_of(spark, texts), records).collect())
    assert got == [(0, 0, "a", "current"), (0, 1, "a", "stale"), (0, 2, "b", "malformed"), (0, 3, "gone", "unknown"), (1, 0, "c", "current"), (2, 0, "d", "current"), (6, 0, "bad", "unknown"), (6, 1, "a", "malformed")]
    fresh = blocks.refreshed(docs_of(spark, texts), records)
    rows = {r.doc_id: (r.text, r.n_refreshed) for r in fresh.collect()}
    assert rows[3] == (None, 0) and rows[5] == (texts[5], 0) and rows[2] == (mark("d", "1.0"), 0)
    assert rows[0][1] == 2 and rows[0][0].startswith("x\n" + mark("a", '{"y": [1, 2], "x": "é"}')) and rows[0][0].count('{"x":"é","y":[1,2]}') == 1
    again = blocks.states(fresh, records).groupBy("state").count().collect()
    assert {r.state: r["count"] for r in again} == {"current": 6, "unknown": 2}


def test_byte_level_pieces(spark):
    texts = ["hello", " the", "é", "漢字", "かな", "한국", "Привет", "123", "!?\n\t", "", "🙂", "a漢", "\x00\xad", None]
    rows = docs_of(spark, texts).select("doc_id", "text", byte_level.encoded(F.col("text")).alias("piece"))
    out = {r.doc_id: r for r in rows.select("*", byte_level.decoded(F.col("piece")).alias("raw")).withColumn("script", byte_level.script_of(F.col("raw"))).collect()}
    chars = byte_level.alphabet()
    assert len(set(chars)) == 256 and chars[0x21] == "!" and chars[0x20] == "Ġ" and chars[0x0A] == "Ċ" and chars[0xAD] != "\xad"
    for i, t in enumerate(texts):
        assert out[i].piece == (None if t is None else "".join(chars[b] for b in t.encode()))
        assert (out[i].raw and bytes(out[i].raw)) == (t and t.encode() or (None if t is None else bytearray()))
        assert t is None or byte_level.to_bytes(out[i].piece) == t.encode()
    assert [out[i].script for i in range(14)] == ["latin", "latin", "latin", "han", "hiragana", "hangul", "cyrillic", "digits", "other", "other", "other", "han", "other", None]
    pieces = spark.createDataFrame([("æ",), ("æ¼",), ("æ¼¢",), ("Ġæ¼¢å",), ("no piece: 漢",)], "p string")
    raw = byte_level.decoded(F.col("p"))
    assert [r.s for r in pieces.select(byte_level.script_of(raw).alias("s")).collect()] == ["partial", "partial", "han", "partial", None]


@pytest.mark.parametrize("texts", [["a b c", None, "", "d", "e f g h i j k l", "m n"], []])
def test_contexts_are_the_running_words(spark, texts):
    w = [x for t in texts for x in (t or "").split()]
    found = contexts.contexts(docs_of(spark, texts).repartition(3), [3, 5, 40])
    got = {(r.length, r.context): r.words for r in found.collect()}
    assert got == {(n, c): w[c * n : (c + 1) * n] for n in (3, 5, 40) for c in range(len(w) // n)}
    judged = contexts.searched(contexts.needled(found, F.lit("N N"), [0.0, 0.5, 1.0]), F.lit("N N"), 4).collect()
    for r in judged:
        want = w[r.context * r.length : (r.context + 1) * r.length]
        want.insert(int(r.length * r.fraction), "N N")
        assert r.prompt == want and r.right == (int(r.length * r.fraction) >= len(want) - 4) and (r.found > 0) == r.right


def test_replication_meets_targets(spark):
    r = random.Random(9)
    rows = [(i, "t", "n", "j", r.choice(["a", "b", "c", None]), r.choice([0, 1, 5, 40, None])) for i in range(400)] + [(None, "t", "n", "j", "a", 7), (5, "t", "n", "j", "a", 7), (5, "t", "n", "j", "a", 7)]
    available = {s: sum(x[5] or 0 for x in rows if x[4] == s) for s in ("a", "b", "c", None)}
    target = {"a": 3.4 * available["a"], "b": 0.3 * available["b"], "c": 0.0, None: 2.0 * available[None], "absent": 100.0}
    plan = spark.createDataFrame(list(target.items()), "source string, target double")
    got = contexts.replicated(spark.createDataFrame(rows, DOCS), plan, "size").collect()
    for s in ("a", "b", None):
        mine = [x for x in got if x.source == s]
        assert target[s] <= sum(x.size for x in mine) + 1e-6 and sum(x.size for x in mine) < target[s] + 40
        whole = int(target[s] / available[s])
        for e in range(1, whole + 1):
            assert sorted(repr((x.doc_id, x.size)) for x in mine if x.epoch == e) == sorted(repr((x[0], x[5] or 0)) for x in rows if x[4] == s)
    assert {x.source for x in got} == {"a", "b", None}
