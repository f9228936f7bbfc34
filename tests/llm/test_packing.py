"""Packing against the tokenizers library: every id in one piece, every limit held, little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexloom.llm import packing
from lexloom.llm.packing import Limits

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, group long, key int, ids int, tail string, size int"


def odd_texts():
    r = random.Random(5)
    bits = [" ", "  ", "\n", " \n", "\t", "a", "B", "é", "don't", "123", "<|endoftext|>", "!?", "\x1c", "\x85", "漢字", " x", " ", "🙂"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(300)]
    return [*texts, None, "", " ", "x" * 50_000, "word " * 9000, " ".join(f"w{i}" for i in range(5000)), *["the same text of some words "] * 200]


def checked(rows, ids_of, limits, lead_of=lambda k: 1):
    """The pieces of each key give its ids once each; sequences hold their limits without gaps. Returns sequence lengths."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == {k for k, x in ids_of.items() if len(x)}
    for k, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids_of[k])) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids_of[k][p.start : p.start + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids_of[k])
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        loss = sum(max(0, p.start + p.length - max(p.start, lead_of(p.doc_id))) for p in pieces)
        assert at <= limits.tokens and len(pieces) <= limits.segments and loss <= limits.loss
    return {s: sum(p.length for p in pieces) for s, pieces in by_sequence.items()}


def test_units_give_the_librarys_ids():
    texts = [t or "" for t in odd_texts()]
    tokenizer = Tokenizer.from_file(PATH)
    encoder = packing.Encoder(tokenizer.to_str())
    assert encoder.ranks
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    whole = packing.Encoder(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).to_str())
    assert not whole.unitwise and len(whole.encode(["a b"])[0]) == 8


def test_packing_of_texts(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, 3, 4, 5, "x", 6) for i, t in enumerate(texts)], DOCS).repartition(5)
    tokenizer = Tokenizer.from_file(PATH)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END] for i, t in enumerate(texts)}
    rows = packing.pack_texts(docs, PATH).collect()
    lengths = checked(rows, ids, Limits())
    assert sum(n < 2048 - packing.SLACK for n in lengths.values()) <= 1  # the last of the one group
    assert packing.pack_texts(docs.limit(0), PATH).count() == 0


def test_keys_without_a_number_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "some words"), (None, "some words"), (7, "a b"), (7, "a b"), (7, None)], "doc_id long, text string")
    rows = packing.pack_texts(docs, PATH).collect()
    assert sorted((r.doc_id is None, r.doc_tokens) for r in rows) == [(False, 1), (False, 3), (False, 3), (True, 3), (True, 3)]


@pytest.mark.parametrize("limits", [Limits(64, 4, 30), Limits(100, 2, 100), Limits(50, 50, 8)])
def test_instruction_data_under_three_limits(spark, monkeypatch, limits):
    """Prompts and answers: tokens before the answer bear no loss; groups of some twenty rows."""
    monkeypatch.setattr(packing, "GROUP_ROWS", 20)
    r = random.Random(6)
    rows, ids, lead = [], {}, {}
    for k in range(150):
        n = r.choice([0, 1, 2, 5, 20, 40, 63, 64, 65, 130, 400])
        ids[k], lead[k] = [r.randrange(1 << 20) for _ in range(n)], r.choice([0, 1, n // 2, n, n + 5])
        rows.append((k, bytearray(np.array(ids[k], "<u4").tobytes()), lead[k]))
    frame = spark.createDataFrame([*rows, (999, None, None)], "doc_id long, ids binary, answer int").repartition(3)
    lengths = checked(packing.pack(frame, limits, loss_from="answer", slack=2).collect(), ids, limits, lead.get)
    assert len(lengths) >= sum(map(len, ids.values())) / limits.tokens
    assert [s for s in lengths if not 0 < lengths[s] <= limits.tokens] == []


def test_dot_product_prefers_what_fits_best():
    # three limits: the second piece uses the scarce one least when that is nearly gone
    got = packing.packed([10, 10, 6, 6], [0, 9, 0, 6], Limits(16, 2, 10), slack=0)
    assert sorted(n for s in got for _, _, n in s) and sum(n for s in got for _, _, n in s) == 32
    assert packing.packed([], [], Limits()) == []
    full = packing.packed([1000] * 40, [1] * 40, Limits())
    assert sum(sum(n for *_, n in s) >= 2048 - packing.SLACK for s in full) >= len(full) - 1  # equal pieces that fit no sequence evenly are cut
