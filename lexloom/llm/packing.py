"""Operator 13: vector bin packing of examples into training sequences.

A sequence has three limits at once: tokens, segments (pieces of examples) and
loss-bearing tokens. Pieces that fill a sequence on their own are cut off an
example first. What is left of each example, less than a sequence, is dealt to
groups of about GROUP_ROWS rows, each packed in one task: a sequence takes, while
any fits, the piece whose sizes have the largest dot product with what the
sequence has left, each limit weighted by how scarce it is in the group. If none
fits and more than SLACK tokens are left, the largest piece is cut and its head
fills the sequence; so all but the last sequence of a group are full in one of
the limits. Ids go with their piece, so that cuts need no second pass.

Every row is dealt by a hash of its place in the input, so repeated ids or texts,
however many, never meet in one group.

Encoding: a byte-level vocabulary breaks a text before each blank that a
non-blank follows, whatever else the text holds; so units between such blanks are
encoded once a worker, by the tokenizers library, and looked up after that.

Defined results: a null or empty text is one id, the end mark; a null key is kept;
rows of one key are examples of their own. Empty tables give no rows. Other
columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from math import ceil
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.byte_level import alphabet, to_bytes
from lexloom.llm.common import frugal


class Limits(NamedTuple):
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


#: Rows that are packed together on average; a piece is under 8 KB, so a group is 16 MB at most.
GROUP_ROWS = 2048
#: Places of a sequence that may stay empty, and the shortest head that is cut off.
SLACK = 16
#: Units that a worker keeps; when there are more, it starts anew.
MAX_UNITS = 150_000
LONGEST_UNIT = 64
#: Fixed value: the published pre-token pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNITS_AT_ONCE = 5000
#: Characters of text that are encoded at once.
SLICE_CHARS = 1_000_000
MAX_VOCABULARY_BYTES = 64 << 20
END = 1
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Texts to ids, four little-endian bytes each."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_str(vocabulary), {}
        spec = json.loads(vocabulary)
        pre = spec.get("pre_tokenizer") or {}
        self.unitwise = (
            spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
        )
        self.ranks = self._ranks(spec) if self.unitwise else None
        if self.ranks:
            import tiktoken

            marks = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
            self.pairs = tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=marks)
            self.n_bytes = np.zeros(max([*self.ranks.values(), *marks.values()]) + 1, np.int64)
            for word, i in (self.ranks | {m.encode(): i for m, i in marks.items()}).items():
                self.n_bytes[i] = len(word)

    def _ranks(self, spec: dict) -> dict[bytes, int] | None:
        """Bytes to ids if ids rise with the order of the merges, so that they can stand for it; a second library then merges faster."""
        marks = {t["content"] for t in spec.get("added_tokens", [])}
        vocabulary, byte_of = spec["model"]["vocab"], {c: b for b, c in enumerate(alphabet())}
        merges = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if spec["model"]["type"] != "BPE" or merges != sorted(set(merges)) or spec["model"].get("dropout"):
            return None
        ranks = {to_bytes(w, byte_of): i for w, i in vocabulary.items() if w not in marks}
        whole = all(bytes([b]) in ranks for b in range(256)) and len(merges) + 256 == len(ranks)
        return ranks if whole else None

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]

    def _ids_of_units(self, units: list[str]) -> dict[str, bytes]:
        """Units that begin with a blank are encoded as one text, whose ids are cut again where the units' bytes end."""
        out = {}
        inner = [u for u in units if self.ranks and u[:1] == " " and u[1:2].strip() and len(u) <= LONGEST_UNIT]
        for at in range(0, len(inner), UNITS_AT_ONCE):
            some = inner[at : at + UNITS_AT_ONCE]
            ids = np.array(self.pairs.encode("".join(some), allowed_special="all"), "<u4")
            ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum([len(u.encode()) for u in some])) + 1
            raw, starts = ids.tobytes(), [0, *(4 * ends).tolist()]
            out.update({u: raw[a:b] for u, a, b in zip(some, starts, starts[1:], strict=False)})
        rest = [u for u in units if u not in out]
        return out | dict(zip(rest, self._ids(rest), strict=True))

    def units(self, text: str) -> list[str]:
        """The text cut before blanks that a character other than white space follows."""
        if not self.unitwise:
            return [text]
        parts = re.split(r" (?=\S)", text) if re.search(r" (?:\s|$)", text) else text.split(" ")
        return [parts[0], *[" " + p for p in parts[1:]]]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > MAX_UNITS:
            self.known.clear()
        split = [self.units(t) for t in texts]
        new = list({u for units in split for u in units if u not in self.known})
        found = self._ids_of_units(new)
        long = {u: found.pop(u) for u in new if len(u) > LONGEST_UNIT}
        self.known.update(found)
        get = self.known.__getitem__
        return [b"".join(map(get, units)) if long.keys().isdisjoint(units) else b"".join(long.get(u) or self.known.get(u, b"") for u in units) for units in split]


_ENCODERS: dict[int, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One a worker for each vocabulary."""
    at = zlib.crc32(vocabulary.encode())
    if at not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[at] = Encoder(vocabulary)
    return _ENCODERS[at]


def prefix(n: int, loss_from: int, tokens: int, loss: int) -> int:
    """The most tokens from the start of a piece of n that stay within `tokens` and `loss`; tokens before `loss_from` bear none."""
    return max(0, min(n, tokens, max(0, loss_from) + loss))


def loss_of(n: int, loss_from: int) -> int:
    return max(0, n - max(0, loss_from))


def headed(ids: bytes, loss_from: int, limits: Limits) -> tuple[list[int], int]:
    """Lengths of the leading pieces that are full on their own, and where the rest starts."""
    n, at, out = len(ids) // 4, 0, []
    while n > at and (k := prefix(n - at, loss_from - at, limits.tokens, limits.loss)) < n - at or n - at == limits.tokens:
        out.append(k)
        at += k
    return out, at


def packed(sizes: list[int], loss_from: list[int], limits: Limits, slack: int = SLACK) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) by the dot-product rule; items are shorter than a sequence and within its limits."""
    room = np.array(limits, float)
    item, start = list(range(len(sizes))), [0] * len(sizes)
    left, lead = list(sizes), list(loss_from)
    m = len(item)
    size = np.array([[n, 1, loss_of(n, f)] for n, f in zip(sizes, loss_from, strict=True)], np.int64).reshape(-1, 3)
    share = size / room
    weight = share.mean(axis=0) if m else room
    out = []

    def remove(k: int) -> None:
        nonlocal m
        m -= 1
        size[k], share[k] = size[m], share[m]
        for x in (item, start, left, lead):
            x[k] = x[m]

    while m:
        residual, sequence = np.array(limits, np.int64), []
        while m and residual[0] > 0 and residual[1] > 0:
            score = share[:m] @ (weight * residual / room)
            score[(size[:m] > residual).any(axis=1)] = -1
            k = int(score.argmax())
            if score[k] >= 0:
                sequence.append((item[k], start[k], left[k]))
                residual = residual - size[k]
                remove(k)
                continue
            if residual[0] <= slack:
                break
            k = int(size[:m, 0].argmax())
            head = prefix(left[k], lead[k], int(residual[0]), int(residual[2]))
            if head < min(slack, left[k]):
                break
            sequence.append((item[k], start[k], head))
            residual = residual - np.array([head, 1, loss_of(head, lead[k])])
            start[k], left[k], lead[k] = start[k] + head, left[k] - head, lead[k] - head
            size[k] = left[k], 1, loss_of(left[k], lead[k])
            share[k] = size[k] / room
        out.append(sequence)
    return out


def crc(ids: bytes, start: int, length: int) -> int:
    return zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]) & 0xFFFFFFFF


TAILS = "group long, doc_tokens long, loss_from long, lengths array<long>, crcs array<long>, rest binary"


def tails_of(keys: list, groups: list[int], ids: list[bytes], loss_from: list[int], limits: Limits) -> dict[str, list]:
    """One row an example: checksums of the pieces that are full on their own, and the ids of the rest."""
    out: dict[str, list] = {k: [] for k in ("key", "group", "doc_tokens", "loss_from", "lengths", "crcs", "rest")}
    for key, group, x, f in zip(keys, groups, ids, loss_from, strict=True):
        lengths, at = headed(x, f, limits)
        starts = np.cumsum([0, *lengths])[:-1].tolist()
        row = (key, group, len(x) // 4, max(0, f - at), lengths, [crc(x, s, n) for s, n in zip(starts, lengths, strict=True)], x[4 * at :])
        for k, v in zip(out, row, strict=True):
            out[k].append(v)
    return out


def sequences(tails: DataFrame, key: str, limits: Limits, slack: int = SLACK) -> DataFrame:
    """key and PIECES: each group's rows packed in one task."""

    def run(frame):
        import pandas as pd

        rows, at = [], int(frame.group.iloc[0]) << 31
        # the largest first, then in an order that does not depend on the shuffle
        frame = frame.assign(size=frame.rest.map(len), crc=frame.rest.map(zlib.crc32)).sort_values(["size", key, "crc", "doc_tokens"], ascending=[False, True, True, True], kind="stable")
        keys, n_tokens = frame[key].tolist(), frame.doc_tokens.tolist()
        for k, n, lengths, crcs in zip(keys, n_tokens, frame.lengths, frame.crcs, strict=True):
            start = 0
            for length, c in zip(lengths, crcs, strict=True):
                rows.append((k, start, length, c, n, at, 0))
                start, at = start + length, at + 1
        heads, tails = frame.lengths.map(sum).tolist(), frame.rest.tolist()
        real = [i for i, t in enumerate(tails) if len(t)]
        froms = frame.loss_from.tolist()
        for sequence in packed([len(tails[i]) // 4 for i in real], [froms[i] for i in real], limits, slack):
            offset = 0
            for j, start, length in sequence:
                i = real[j]
                rows.append((keys[i], heads[i] + start, length, crc(tails[i], start, length), n_tokens[i], at, offset))
                offset += length
            at += 1
        out = pd.DataFrame(rows, columns=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        return out.astype({key: "Int64"})

    return tails.groupBy("group").applyInPandas(run, f"`{key}` long, {PIECES}")


def group_of(n_rows: int) -> Column:
    """A hash of the row's place in its input, into groups of about GROUP_ROWS."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, ceil(n_rows / GROUP_ROWS))))


def mapped(rows: DataFrame, key: str, tails: callable) -> DataFrame:
    """`tails(batch)` over Arrow batches; a batch's columns come as lists."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"`{key}` long, {TAILS}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            for found in tails(b):
                found[key] = found.pop("key")
                yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in arrow], schema=arrow)

    return rows.mapInArrow(frugal(run), schema)


def pack(examples: DataFrame, limits: Limits = Limits(), key: str = "doc_id", ids: str = "ids", loss_from: str | None = None, slack: int = SLACK) -> DataFrame:
    """Pieces of examples whose ids are little-endian 32-bit numbers in a binary column.

    Tokens from `loss_from` (of a prompt and its answer: where the answer starts;
    null or no column: the second) on bear loss. Null ids are an example of no tokens, which has no piece.
    """
    lead = F.coalesce(F.col(loss_from), F.lit(1)) if loss_from else F.lit(1)
    rows = examples.select(F.col(key).cast("long").alias("key"), group_of(examples.count()).alias("group"), F.coalesce(F.col(ids), F.lit(b"")).alias("ids"), lead.cast("long").alias("lead"))

    def tails(b):
        for at in range(0, b.num_rows, 256):
            x = b.slice(at, 256).to_pydict()
            yield tails_of(x["key"], x["group"], x["ids"], x["lead"], limits)

    return sequences(mapped(rows, key, tails), key, limits, slack)


def pack_texts(docs: DataFrame, vocabulary_path: str, limits: Limits = Limits(), key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """Pieces of texts, each encoded and ended by `end`; all tokens but the first of a text bear loss."""
    from pathlib import Path

    vocabulary = Path(vocabulary_path).read_text(encoding="utf-8")
    if len(vocabulary) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary_path} is too large to be sent to every executor")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(key).cast("long").alias("key"), group_of(docs.count()).alias("group"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    last = np.array([end], "<u4").tobytes()

    def tails(b):
        encode = encoder(shared.value).encode
        at, texts, size = 0, [], 0
        keys, groups = b.column("key").to_pylist(), b.column("group").to_pylist()
        for i, t in enumerate(b.column("text")):
            texts.append(t.as_py())
            size += len(texts[-1])
            if size >= SLICE_CHARS or i == b.num_rows - 1:
                ids = [x + last for x in encode(texts)]
                yield tails_of(keys[at : i + 1], groups[at : i + 1], ids, [1] * len(ids), limits)
                at, texts, size = i + 1, [], 0

    return sequences(mapped(rows, key, tails), key, limits)
