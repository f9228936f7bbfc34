"""Byte-pair training over a distributed chunk histogram, and encoding of distinct chunks.

The histogram is a groupBy and is never cut. Its chunks stay on the executors as
blocks of ids; each round counts all pairs there and only the commonest pairs come
to the driver, which takes as many merges of them as cannot affect one another.
Chunks are encoded once each in Arrow batches and joined back.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import ws_words
from lexloom.operators.shared import written

#: Pre-token pattern without look-around, so that other regex engines agree.
PATTERN = r"[^\s\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+|\s+"
#: Pairs that one round brings to the driver; a round that takes them all is followed by another.
ROUND_PAIRS = 1000
#: Merges after which the blocks are written anew, so that a round does not apply all merges again.
FOLD_MERGES = 32


def chunk_counts(docs: DataFrame, pattern: str = PATTERN) -> DataFrame:
    """(chunk, n): the histogram of pre-tokens."""
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n"))


def blocks(counts: DataFrame) -> DataFrame:
    """(x, w): the chunks of a batch as int32 ids, each chunk ended by -1, and its counts as int64."""

    def run(frames):
        for f in frames:
            raw = [c.encode() for c in f.chunk]
            ends = np.cumsum([len(c) + 1 for c in raw], dtype=np.int64) - 1
            if len(ends):
                x = np.full(ends[-1] + 1, -1, np.int32)
                x[np.delete(np.arange(len(x)), ends)] = np.frombuffer(b"".join(raw), np.uint8)
                yield f.iloc[:1].assign(x=[x.tobytes()], w=[f.n.to_numpy(np.int64).tobytes()])[["x", "w"]]

    return counts.select("chunk", "n").mapInPandas(run, "x binary, w binary")


def replaced(x: np.ndarray, pair: tuple[int, int], new: int) -> np.ndarray:
    """The block with every occurrence of a pair as the new id, from left to right in each chunk."""
    at = np.flatnonzero((x[:-1] == pair[0]) & (x[1:] == pair[1]))
    if pair[0] == pair[1] and len(at):  # of a run of one id every second place
        k = np.arange(len(at))
        first = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, k, 0))
        at = at[(k - first) % 2 == 0]
    if not len(at):
        return x
    x = x.copy()
    x[at] = new
    return np.delete(x, at + 1)


def folded(state: DataFrame, merges: list[tuple[tuple[int, int], int]], schema: str, out) -> DataFrame:
    """`out` (a frame of `schema`) of the ids and counts of each block after the merges."""

    def run(frames):
        for f in frames:
            for raw, w in zip(f.x, f.w, strict=True):
                x = np.frombuffer(raw, np.int32)
                for pair, new in merges:
                    x = replaced(x, pair, new)
                yield out(x, w)

    return state.mapInPandas(run, schema)


def block_rows(x: np.ndarray, w: bytes):
    import pandas as pd

    return pd.DataFrame({"x": [x.tobytes()], "w": [w]})


def pair_rows(x: np.ndarray, w: bytes):
    """(pair, n): pair is left id * 2^32 + right id."""
    import pandas as pd

    inside = np.flatnonzero((x[:-1] >= 0) & (x[1:] >= 0))
    keys = (x[inside].astype(np.int64) << 32) | x[inside + 1]
    n = np.frombuffer(w, np.int64)[np.cumsum(x == -1)[inside]]
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return pd.DataFrame({"pair": keys[first], "n": np.add.reduceat(n, first) if len(first) else n})


def independent(ranked: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The first pairs of a ranking that stay the next ones while they are merged in turn.

    A merge changes only pairs with one of its ids, and a pair with the new id is
    at most as common as the pair it came from, which ranks behind all that are
    taken here; on a tie its larger new id comes later. A pair of one id twice
    ends the round, as what follows it came from no other pair.
    """
    out, met = [], set()
    for a, b in ranked:
        if a in met or b in met:
            break
        out.append((a, b))
        met |= {a, b}
        if a == b:
            break
    return out


def train(counts: DataFrame, vocab_size: int) -> list[tuple[int, int]]:
    """Merges in order; ties go to the smaller left id, then the smaller right id; stops when no pair occurs twice."""
    state, out, done = None, [], 0
    while 256 + len(out) < vocab_size:
        if state is None:
            state = written(blocks(counts))
        pending = [(p, 256 + k) for k, p in enumerate(out)][done:]
        if len(pending) >= FOLD_MERGES:
            state, done, pending = written(folded(state, pending, "x binary, w binary", block_rows)), len(out), []
        pairs = folded(state, pending, "pair long, n long", pair_rows).groupBy("pair").agg(F.sum("n").alias("n")).where("n >= 2")
        ranked = [(r.pair >> 32, r.pair & 0xFFFFFFFF) for r in pairs.orderBy(F.desc("n"), "pair").limit(ROUND_PAIRS).collect()]
        if not ranked:
            break
        out += independent(ranked)[: vocab_size - 256 - len(out)]
    return out


class Codec:
    """Encoding and decoding by a list of merges; the bytes of each id are laid out once."""

    def __init__(self, merges: list[tuple[int, int]]):
        self.rank = {p: i for i, p in enumerate(merges)}
        self.bytes_of = [bytes([i]) for i in range(256)]
        for a, b in merges:
            self.bytes_of.append(self.bytes_of[a] + self.bytes_of[b])

    def encode(self, text: str) -> list[int]:
        """Lowest-rank merge first, the leftmost of equals: a heap of pairs over links between the ids that are left."""
        ids = list(text.encode())
        n = len(ids)
        after, before = [*range(1, n), n], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] < 0 or self.rank.get((ids[i], ids[j])) != r:
                continue  # a side has been merged since
            ids[i], ids[j], after[i] = 256 + r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n and (r := self.rank.get((ids[left], ids[right]))) is not None:
                    heapq.heappush(heap, (r, left))
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def encoded(counts: DataFrame, merges: list[tuple[int, int]]) -> DataFrame:
    """counts + n_tokens and ok (whether decoding gives the chunk back)."""

    def run(frames):
        codec = Codec(merges)
        for f in frames:
            ids = [codec.encode(x) for x in f.chunk]
            yield f.assign(ids=ids, n_tokens=[len(x) for x in ids], ok=[codec.decode(x) == y for x, y in zip(ids, f.chunk, strict=True)])

    return counts.mapInPandas(run, ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in counts.schema) + ", ids array<int>, n_tokens long, ok boolean")


def fertility(docs: DataFrame, merges: list[tuple[int, int]], by: str, pattern: str = PATTERN) -> DataFrame:
    """by, n_tokens, n_words, n_bytes, n_chars, fertility (tokens a word), bytes_per_token, chars_per_token: each distinct chunk is encoded once for each group."""
    chunks = docs.select(by, F.explode(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))).alias("chunk")).groupBy(by, "chunk").agg(F.count("*").alias("n"))
    tokens = encoded(chunks, merges).groupBy(by).agg(F.sum(F.col("n") * F.col("n_tokens")).alias("n_tokens"))
    sizes = docs.groupBy(by).agg(F.sum(F.size(ws_words(F.col("text")))).alias("n_words"), F.sum(F.octet_length("text")).alias("n_bytes"), F.sum(F.length("text")).alias("n_chars"))
    out = sizes.join(tokens, sizes[by].eqNullSafe(tokens[by])).drop(tokens[by])
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return out.select(by, "n_tokens", "n_words", "n_bytes", "n_chars", ratio("n_tokens", "n_words").alias("fertility"), ratio("n_bytes", "n_tokens").alias("bytes_per_token"), ratio("n_chars", "n_tokens").alias("chars_per_token"))
