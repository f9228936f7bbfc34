"""Windows of n words as numbers, dealt by hash: how many there are, which ones a corpus repeats, and where.

A window is known by 74 bits: ten choose its shard, 64 tell it apart there (with
2 x 10^9 different windows the chance that any two are taken for one is about 10^-4).
Tasks send the windows of some million words at a time, sorted, as the byte planes of
their gaps, compressed; a shard is looked at in one task, shard after shard. Copies of
a window are numbers in an array there, so a frequent one costs no more than others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import held, words
from lexloom.operators.bloom import loosened, squeezed

U = np.uint64
SHARD_LOG2 = 10
#: Words whose windows a task sends at once, and those that are hashed together.
WORDS_AT_ONCE, HASHED_AT_ONCE = 2_000_000, 250_000
#: Two odd multipliers for each place of a window; words have 64-bit hashes already.
A, B, C = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(B)
    h = (h ^ (h >> U(27))) * U(C)
    return h ^ (h >> U(31))


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mixed(np.arange(1, 2 * n + 1, dtype=U) * U(A)) | U(1)
    return x[:n], x[n:]


def hashed(x: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, hash and place in x of all windows of n words; x has the words of texts of these sizes, one after the other."""
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(x))  # words from here to the text's end
    shard, h, at = [], [], []
    one, two = multipliers(n)
    for lo in range(0, max(0, len(x) - n + 1), HASHED_AT_ONCE):
        hi = min(lo + HASHED_AT_ONCE, len(x) - n + 1)
        p, q = np.full(hi - lo, U(n)), np.full(hi - lo, U(n))
        for i in range(n):
            p += x[lo + i : hi + i] * one[i]
            q += x[lo + i : hi + i] * two[i]
        whole = np.flatnonzero(left[lo:hi] >= n)
        shard.append((mixed(q[whole]) >> U(64 - SHARD_LOG2)).astype(np.int16))
        h.append(mixed(p[whole]))
        at.append(whole + lo)
    return tuple(np.concatenate(v) if v else np.zeros(0, t) for v, t in ((shard, np.int16), (h, U), (at, np.int64)))


def planes(v: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(v.view(np.uint8).reshape(len(v), -1).T).tobytes())


def from_planes(raw: bytes, kind) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def word_hashes(df: DataFrame, key: str | None, text: str) -> DataFrame:
    """(key, x): the 64-bit hashes of a text's words; null keys are `NO_KEY`."""
    k = F.lit(0).cast("long") if key is None else F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY))
    return held(df.select(k.alias("key"), F.col(text).alias("__t")), "x", F.transform(words(F.col("__t")), lambda w: F.xxhash64(w))).where("size(x) > 0").select("key", "x")


#: The number of a key that is null: the least, as Spark orders it.
NO_KEY = -(1 << 63)


def sent(rows: DataFrame, ns: tuple[int, ...], places: bool) -> DataFrame:
    """shard, n, hs, keys, places: windows of `word_hashes`; without places each window of some million words once."""

    def run(batches):
        import pyarrow as pa

        def out(keys, xs):
            key, sizes, x = np.concatenate(keys), np.concatenate([s for s, _ in xs]), np.concatenate([v for _, v in xs])
            keys.clear(), xs.clear()
            row = np.repeat(np.arange(len(sizes)), sizes) if places else None
            start = np.cumsum(sizes) - sizes
            for n in ns:
                shard, h, at = hashed(x, sizes, n)
                if not len(h):
                    continue
                order = np.argsort(shard, kind="stable")
                cut = np.flatnonzero(np.diff(shard[order], prepend=-1))
                spans = list(zip(cut, [*cut[1:], len(order)], strict=True))
                for lo in range(0, len(spans), 256):
                    made = []
                    for a, b in spans[lo : lo + 256]:
                        some = order[a:b]
                        if places:
                            some = some[np.argsort(h[some], kind="stable")]
                            of = row[at[some]]
                            made.append((int(shard[some[0]]), n, squeezed(h[some]), planes(key[of]), planes((at[some] - start[of] + 1).astype(np.int32))))
                        else:
                            made.append((int(shard[some[0]]), n, squeezed(np.unique(h[some])), None, None))
                    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], ["shard", "n", "hs", "keys", "places"])

        keys, xs, m = [], [], 0
        for whole in batches:
            sizes = whole.column("x").value_lengths().to_numpy().astype(np.int64)
            part = np.cumsum(sizes) // WORDS_AT_ONCE
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            for lo, hi in zip(cut, [*cut[1:], len(sizes)], strict=True):
                b = whole.slice(lo, hi - lo)
                keys.append(b.column("key").to_numpy())
                xs.append((sizes[lo:hi], b.column("x").flatten().to_numpy().astype(np.int64).view(U)))
                m += int(sizes[lo:hi].sum())
                if m >= WORDS_AT_ONCE:
                    yield from out(keys, xs)
                    m = 0
        if m:
            yield from out(keys, xs)

    return rows.mapInArrow(run, "shard int, n int, hs binary, keys binary, places binary")


def distinct_windows(docs: DataFrame, ns: tuple[int, ...], text: str = "text") -> DataFrame:
    """n, grams: how many different windows of n words a corpus has, for each n."""

    def run(frame):
        rows = [(n, len(np.unique(np.concatenate([loosened(raw) for raw in part["hs"]])))) for n, part in frame.groupby("n")]
        return pd.DataFrame(rows, columns=["n", "grams"])

    counted = sent(word_hashes(docs, None, text), ns, False).groupBy("shard").applyInPandas(run, "n long, grams long")
    every = docs.sparkSession.createDataFrame([(n,) for n in ns], "n long")
    return every.join(F.broadcast(counted.groupBy("n").agg(F.sum("grams").alias("grams"))), "n", "left").select("n", F.coalesce("grams", F.lit(0).cast("long")).alias("grams"))


def shared_by(docs: DataFrame, by: str, n: int, text: str = "text") -> DataFrame:
    """a, b, n: how many different windows of n words two groups share, a < b, where they share any; and how many a group has, a = b. `by` is a string; null is no group."""
    x = F.transform(words(F.col("__t")), lambda w: F.xxhash64(w))
    rows = held(docs.where(F.col(by).isNotNull()).select(F.col(by).alias("of"), F.col(text).alias("__t")), "x", x).where(F.size("x") >= n).select("of", "x")

    def send(batches):
        import pyarrow as pa

        def out(of, x, sizes):
            shard, h, _ = hashed(x, sizes, n)
            order = np.lexsort((h, shard))
            shard, h = shard[order], h[order]
            new = np.r_[True, (shard[1:] != shard[:-1]) | (h[1:] != h[:-1])][: len(h)]
            shard, h = shard[new], h[new]
            cut = np.flatnonzero(np.diff(shard, prepend=-1))
            spans = list(zip(cut, [*cut[1:], len(h)], strict=True))
            for lo in range(0, len(spans), 256):
                some = spans[lo : lo + 256]
                columns = [pa.array([int(shard[a]) for a, _ in some], pa.int32()), pa.array([of] * len(some), pa.string()), pa.array([squeezed(h[a:b]) for a, b in some], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "of", "hs"])

        kept, m = {}, 0
        for whole in batches:
            sizes = whole.column("x").value_lengths().to_numpy().astype(np.int64)
            flat, ends = whole.column("x").flatten().to_numpy().astype(np.int64).view(U), np.cumsum(sizes)
            for i, of in enumerate(whole.column("of").to_pylist()):
                kept.setdefault(of, []).append(flat[ends[i] - sizes[i] : ends[i]])
                m += int(sizes[i])
                if m >= WORDS_AT_ONCE:
                    for k, xs in kept.items():
                        yield from out(k, np.concatenate(xs), np.array([len(v) for v in xs]))
                    kept, m = {}, 0
        for k, xs in kept.items():
            yield from out(k, np.concatenate(xs), np.array([len(v) for v in xs]))

    def meet(frame):
        names = sorted(frame["of"].unique())
        own = [np.unique(np.concatenate([loosened(raw) for raw in frame["hs"][frame["of"] == name]])) for name in names]
        h, of = np.concatenate(own), np.repeat(np.arange(len(own)), [len(v) for v in own])
        order = np.argsort(h, kind="stable")  # so that the groups of one window are in order
        h, of = h[order], of[order]
        out, apart = {(i, i): len(v) for i, v in enumerate(own)}, 1
        while len(at := np.flatnonzero(h[apart:] == h[: max(0, len(h) - apart)])):
            for code, c in zip(*np.unique(of[at] * len(own) + of[at + apart], return_counts=True), strict=True):
                pair = divmod(int(code), len(own))
                out[pair] = out.get(pair, 0) + int(c)
            apart += 1
        return pd.DataFrame([(names[i], names[j], c) for (i, j), c in out.items()], columns=["a", "b", "n"])

    met = rows.mapInArrow(send, "shard int, of string, hs binary").groupBy("shard").applyInPandas(meet, "a string, b string, n long")
    return met.groupBy("a", "b").agg(F.sum("n").alias("n"))


def repeated(docs: DataFrame, n: int, key: str, text: str, firsts: bool) -> DataFrame:
    """key, place, h, n of windows that the corpus has more than once, in the order of key and place (from 1).

    With `firsts`, one row a window: its first place, under the least key that is not
    null if there is one, and its count. Without, all places but the first, n null.
    Keys are whole numbers, `NO_KEY` for null.
    """

    def run(frame):
        h = np.concatenate([loosened(raw) for raw in frame["hs"]])
        k = np.concatenate([from_planes(raw, np.int64) for raw in frame["keys"]])
        at = np.concatenate([from_planes(raw, np.int32) for raw in frame["places"]])
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        order = order[np.r_[False, same] | np.r_[same, False]]  # the others are met once
        h, k, at = h[order], k[order], at[order]
        order = np.lexsort((at, k, k == NO_KEY, h) if firsts else (at, k, h))
        h, k, at = h[order], k[order], at[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        counts = np.diff(np.r_[first, len(h)])
        if firsts:
            return pd.DataFrame({"key": k[first], "place": at[first], "h": h[first].view(np.int64), "n": counts})
        of = np.repeat(first, counts)
        later = (k != k[of]) | (at != at[of])
        return pd.DataFrame({"key": k[later], "place": at[later], "h": h[later].view(np.int64), "n": 0})

    return sent(word_hashes(docs, key, text), (n,), True).groupBy("shard").applyInPandas(run, "key long, place int, h long, n long")


def same_windows(n: int):
    """A function of (hashes of a text's words, places, hashes): whether the window at each place has that hash."""

    @F.pandas_udf("array<boolean>")
    def same(x: pd.Series, places: pd.Series, hs: pd.Series) -> pd.Series:
        def row(x, places, h):
            own = hashed(np.asarray(x, np.int64).view(U), np.array([len(x)]), n)[1]
            at = np.asarray(places, np.int64) - 1
            return (at < len(own)) & (own[np.minimum(at, len(own) - 1)].view(np.int64) == np.asarray(h, np.int64))

        return pd.Series([row(*r) for r in zip(x, places, hs, strict=True)])

    return same
