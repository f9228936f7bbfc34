"""Deduplication operators: MinHash signatures, LSH candidates, exact similarity joins, components, elections."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import held, md5_bucket, shingles, words
from lexloom.operators import windows
from lexloom.operators.shared import BROADCAST_ROWS, freed, small, written

MERSENNE = (1 << 61) - 1
EMPTY_HASH = 0xFFFFFFFF


def permutations(k: int, seed: int = 0) -> list[tuple[int, int]]:
    """k pairs (a, b) of the family (a x + b) mod (2^61 - 1), a not 0, from hashes of seed and place."""
    half = lambda i, part, n: int(hashlib.md5(f"{seed}:{i}:{part}".encode()).hexdigest(), 16) % n
    return [(1 + half(i, "a", MERSENNE - 1), half(i, "b", MERSENNE)) for i in range(k)]


def permuted(x: Column, a: int, b: int) -> Column:
    """((a x + b) mod (2^61 - 1)) mod 2^32 in bigint arithmetic; a is split at bit 30, and times 2^30 is a rotation of 61 bits."""
    m = F.lit(MERSENNE)
    t = (F.lit(a >> 30) * x) % m
    rotated = F.shiftleft(t.bitwiseAND(F.lit((1 << 31) - 1)), 30).bitwiseOR(F.shiftright(t, 31))
    return ((((rotated % m) + (F.lit(a & ((1 << 30) - 1)) * x) % m) % m + F.lit(b)) % m).bitwiseAND(F.lit(0xFFFFFFFF))


def shingle_table(docs: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, g): distinct shingles; none for a document without words."""
    return held(docs.select("doc_id", "text"), "w", words(F.col("text"))).select("doc_id", F.explode(shingles(F.col("w"), n)).alias("g"))


#: Shingle hashes that are permuted at once, so that they stay in a core's cache.
PERMUTED_AT_ONCE = 16_384


def minima(x, starts, perms: list[tuple[int, int]]):
    """(len(starts), len(perms)) least permuted hashes, by `permuted`, of the stretches of x (uint64 under 2^32) that begin at `starts`."""
    import numpy as np

    u = np.uint64
    out = np.empty((len(starts), len(perms)), np.int64)
    for i, (a, b) in enumerate(perms):
        t = u(a >> 30) * x  # times 2^30 is a rotation of 61 bits; sums stay under 2^64
        v = (t >> u(31)) + ((t & u((1 << 31) - 1)) << u(30)) + u(a & ((1 << 30) - 1)) * x + u(b)
        v = (v & u(MERSENNE)) + (v >> u(61))
        v = np.where(v >= u(MERSENNE), v - u(MERSENNE), v) & u(0xFFFFFFFF)
        out[:, i] = np.minimum.reduceat(v, starts)
    return out


def signatures(docs: DataFrame, perms: list[tuple[int, int]], n: int = 5) -> DataFrame:
    """(doc_id, sig): minima of the permuted shingle hashes; a document without shingles has all ones. Rows of one id are one document."""
    w = held(docs.select("doc_id", "text"), "w", words(F.col("text")))
    hashed = held(w, "g", shingles(F.col("w"), n)).where(F.size("g") > 0).select("doc_id", F.transform("g", md5_bucket).alias("x"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            sizes = whole.column("x").value_lengths().to_numpy().astype(np.int64)
            part = (np.cumsum(sizes) - sizes) // PERMUTED_AT_ONCE
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            for lo, hi in zip(cut, [*cut[1:], len(sizes)], strict=True):
                b, m = whole.slice(lo, hi - lo), sizes[lo:hi]
                mins = minima(b.column("x").flatten().to_numpy().astype(np.uint64), np.cumsum(m) - m, perms)
                sig = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * len(perms), pa.int32()), pa.array(mins.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), sig], ["doc_id", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = hashed.mapInArrow(run, f"doc_id {kind}, sig array<bigint>")
    mins = rows.groupBy("doc_id").agg(F.array(*(F.min(F.col("sig")[i]) for i in range(len(perms)))).alias("sig"))
    return docs.select("doc_id").join(mins, "doc_id", "left").withColumn("sig", F.coalesce("sig", F.array_repeat(F.lit(EMPTY_HASH).cast("bigint"), len(perms))))


def lsh_candidates(sigs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(a, b), a < b: documents that agree in a whole band."""
    keyed = sigs.select("doc_id", F.posexplode(F.array(*(F.xxhash64(F.slice("sig", i * rows + 1, rows)) for i in range(bands)))).alias("band", "key"))
    x, y = keyed.alias("x"), keyed.alias("y")
    met = x.join(y, F.expr("x.band = y.band and x.key = y.key and x.doc_id < y.doc_id"))
    return met.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()


def shingle_sets(docs: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, s, n): the sorted distinct 64-bit hashes of a document's shingles; texts without words are left out."""
    w = held(docs.select("doc_id", "text"), "w", F.transform(words(F.col("text")), lambda x: F.xxhash64(x))).where("size(w) > 0")
    several = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.slice("w", i, F.lit(n))))
    hashed = F.when(F.size("w") >= n, several).otherwise(F.array(F.xxhash64("w")))
    return held(w.select("doc_id", "w"), "s", F.array_sort(F.array_distinct(hashed))).select("doc_id", "s", F.size("s").alias("n"))


def nodes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, s, n): one row for each set, named by its smallest document; and (node, doc_id, n) for all documents. Copies meet here by two hashes, not by their sets, and never in a join of pairs."""
    kept = written(sets.withColumns({"k1": F.xxhash64("s"), "k2": F.xxhash64("n", "s")}))
    keyed = kept.select("doc_id", "k1", "k2", "n")
    of = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"))
    members = written(keyed.join(of, ["k1", "k2"]).select("node", "doc_id", "k1", "k2", "n"))
    copies = members.where("node <> doc_id").select("doc_id", "k1", "k2")
    first = kept.join(small(copies), ["doc_id", "k1", "k2"], "left_anti")
    return first.select(F.col("doc_id").alias("node"), "s", "n"), members.select("node", "doc_id", "n")


#: One node in so many is asked which shingles are common; those that COMMON of them have go last, the MOST_COMMON most frequent at most.
ASKED, COMMON, MOST_COMMON = 8, 3, 1_000_000


def common_shingles(of: DataFrame) -> DataFrame:
    """(g): shingles of many sets. This only sets the order of shingles in `similar_nodes`, which finds the same pairs in any order."""
    some = of.where(F.pmod(F.xxhash64("node"), F.lit(ASKED)) == 0).select(F.explode("s").alias("g"))
    often = some.groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON)
    return often.orderBy(F.desc("c"), "g").limit(MOST_COMMON).select("g")


def prefixes(of: DataFrame, threshold: float) -> DataFrame:
    """(g, node, n): the first n - ceil(t n) + 1 shingles of each set, common ones last, else by number."""
    import numpy as np

    last = np.array([r.g for r in common_shingles(of).toLocalIterator()], np.int64)
    last.sort()
    shared = of.sparkSession.sparkContext.broadcast(last)

    def run(batches):
        import pyarrow as pa

        last = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                s, n = b.column("s"), b.column("n").to_numpy().astype(np.int64)
                g, row = s.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(n)), n)
                late = np.zeros(len(g), bool)
                if len(last):
                    at = np.minimum(np.searchsorted(last, g), len(last) - 1)
                    late = last[at] == g
                order = np.lexsort((g, late, row))
                place = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
                held = place < np.repeat(n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1, n)
                out, row = g[order][held], row[held]
                yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(b.column("node").to_numpy()[row]), pa.array(n[row].astype(np.int32))], ["g", "node", "n"])

    return of.select("node", "s", "n").mapInArrow(run, "g long, node long, n int")


def similar_nodes(of: DataFrame, threshold: float) -> DataFrame:
    """(a, b, inter, uni), a < b: sets of Jaccard `threshold` or more, by prefixes.

    Two such sets share one of the first n - ceil(t n) + 1 shingles of each, in any
    order that all sets have. Here shingles go by their hashes, and those that many
    sets have come last, so a passage of many documents is in no prefix unless a set
    has little else. Only prefixes are shuffled, and whole sets only of the nodes
    that meet one of about their size.
    """
    prefix = prefixes(of, threshold)
    x, y = prefix.alias("x"), prefix.alias("y")
    met = x.join(y, F.expr(f"x.g = y.g and x.node < y.node and least(x.n, y.n) >= {threshold} * greatest(x.n, y.n) - 1e-9"))
    shared = met.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count("*").alias("c"), F.first("x.n").alias("p"), F.first("y.n").alias("q"))
    behind = F.ceil(F.greatest("p", "q") * threshold - 1e-9) - 1  # of the larger set, which has more
    pairs = written(shared.where(F.col("c") + behind >= (F.col("p") + F.col("q")) * (threshold / (1 + threshold)) - 1e-6).select("a", "b"))
    some = of.join(small(written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())), "node", "left_semi")
    side = lambda k: some.select(F.col("node").alias(k), F.col("s").alias("s" + k), F.col("n").alias("n" + k))
    both = held(pairs.join(side("a"), "a").join(side("b"), "b"), "inter", F.size(F.array_intersect("sa", "sb")).cast("long"))
    found = both.withColumn("uni", F.col("na") + F.col("nb") - F.col("inter")).where(F.col("inter") >= threshold * F.col("uni"))
    out = written(found.select("a", "b", "inter", F.col("uni").cast("long").alias("uni")).distinct())
    freed(pairs)
    return out


def expanded(found: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, inter, uni) of documents, a < b, from those of nodes; copies are listed pair by pair."""
    x, y = members.select(F.col("node").alias("a"), F.col("doc_id").alias("da"), "n"), members.select(F.col("node").alias("b"), F.col("doc_id").alias("db"))
    across = found.join(x.drop("n"), "a").join(y, "b").select(F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b"), "inter", "uni")
    size = F.col("n").cast("long")
    inside = x.join(y.withColumnRenamed("b", "a"), "a").where("da < db").select(F.col("da").alias("a"), F.col("db").alias("b"), size.alias("inter"), size.alias("uni"))
    return across.union(inside)


def similar_pairs(docs: DataFrame, threshold: float, n: int = 5) -> DataFrame:
    """(a, b, inter, uni), a < b: all pairs of documents at the threshold or above, copies listed pair by pair; texts without words are in no pair. For components take `links`, which does not list them."""
    of, members = nodes(shingle_sets(docs, n))
    return expanded(similar_nodes(of, threshold), members)


@dataclass
class Weighed:
    """The exact pairs of a corpus without its copies: one row for two sets, with the number of pairs of documents that have them."""

    pairs: DataFrame  # a, b, inter, uni, w
    sizes: DataFrame  # node, c: how many documents have a set
    inside: int  # pairs of copies
    documents: int  # documents with words and an id


def weighed_pairs(docs: DataFrame, threshold: float, n: int = 5) -> Weighed:
    """`similar_pairs` for counts and means: pairs of copies are multiplied, not listed, so the rows are those of a corpus without copies."""
    of, members = nodes(shingle_sets(docs.where("doc_id is not null"), n))
    sizes = written(members.groupBy("node").agg(F.count("*").alias("c")))
    side = lambda k: sizes.select(F.col("node").alias(k), F.col("c").alias("c" + k))
    found = similar_nodes(of, threshold).join(side("a"), "a").join(side("b"), "b")
    pairs = written(found.select("a", "b", "inter", "uni", (F.col("ca") * F.col("cb")).alias("w")))
    inside, every = sizes.agg(F.sum(F.expr("c * (c - 1) div 2")), F.sum("c")).first()
    return Weighed(pairs, sizes, inside or 0, every or 0)


def of_ids(docs: DataFrame, ids: DataFrame, every: DataFrame) -> DataFrame:
    """The documents of `ids`, a part of `every` (both doc_id): the texts are shuffled only if neither these nor the others fit a broadcast."""
    if ids.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(ids), "doc_id", "left_semi")
    others = written(every.join(ids, "doc_id", "left_anti"))
    return docs.join(F.broadcast(others), "doc_id", "left_anti") if others.count() <= BROADCAST_ROWS else docs.join(ids, "doc_id", "left_semi")


def lsh_counts(docs: DataFrame, perms: list[tuple[int, int]], configs, threshold: float) -> DataFrame:
    """bands, candidates, truth, hits of each (bands, rows): pairs of documents that agree in a whole band, pairs of Jaccard `threshold` or more, and both.

    One document of each set is signed. Documents of one signature agree in all bands, so they are one row with their number (those without words, too);
    a row is compared with the others, and a pair counts as many times as it has documents. Hits are the exact pairs whose signatures agree in a band.
    """
    docs = docs.where("doc_id is not null")
    found = weighed_pairs(docs, threshold)
    spark, k = docs.sparkSession, len(perms)
    firsts = found.sizes.select(F.col("node").alias("doc_id"))
    sigs = written(signatures(of_ids(docs, firsts, docs.select("doc_id")), perms).join(found.sizes.withColumnRenamed("node", "doc_id"), "doc_id"))
    wordless = docs.count() - found.documents
    none = spark.range(1).select(F.array_repeat(F.lit(EMPTY_HASH).cast("bigint"), k).alias("sig"), F.lit(wordless).cast("long").alias("c")).where("c > 0")
    alike = written(sigs.select("sig", "c").union(none).groupBy("sig").agg(F.sum("c").alias("c")).select(F.monotonically_increasing_id().alias("doc_id"), "sig", "c"))
    own = alike.agg(F.sum(F.expr("c * (c - 1) div 2"))).first()[0] or 0
    side = lambda e: sigs.select(F.col("doc_id").alias(e), F.col("sig").alias("s" + e))
    some = written(found.pairs.select("a", "b", "w").join(side("a"), "a").join(side("b"), "b"))
    times = lambda e: alike.select(F.col("doc_id").alias(e), F.col("c").alias("c" + e))
    out = None
    for bands, rows in configs:
        met = lsh_candidates(alike, bands, rows).join(times("a"), "a").join(times("b"), "b").agg(F.coalesce(F.sum(F.col("ca") * F.col("cb")), F.lit(0)).alias("across"))
        band = lambda e, i, rows=rows: F.slice(e, i * rows + 1, rows)
        agree = reduce(lambda x, y: x | y, [band("sa", i) == band("sb", i) for i in range(bands)])
        hit = some.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("t"), F.coalesce(F.sum(F.when(agree, F.col("w"))), F.lit(0)).alias("h"))
        counts = {"bands": F.lit(bands), "candidates": F.col("across") + F.lit(own), "truth": F.col("t") + F.lit(found.inside), "hits": F.col("h") + F.lit(found.inside)}
        row = met.crossJoin(hit).select(*(v.cast("long").alias(c) for c, v in counts.items()))
        out = row if out is None else out.union(row)
    return out


def lsh_pairs(docs: DataFrame, perms: list[tuple[int, int]], bands: int, rows: int, threshold: float) -> DataFrame:
    """(a, b, inter, uni), a < b: pairs that agree in a whole band of their signatures and have Jaccard `threshold` or more. Only one document of each set is signed and compared; its copies agree with it in all."""
    of, members = nodes(shingle_sets(docs))
    firsts = members.where("node = doc_id").select("doc_id")
    sigs = written(signatures(docs.join(small(members.where("node <> doc_id").select("doc_id")), "doc_id", "left_anti"), perms).join(firsts, "doc_id", "left_semi"))
    return expanded(verified(written(lsh_candidates(sigs, bands, rows)), of.withColumnRenamed("node", "doc_id"), threshold), members)


def links(docs: DataFrame, threshold: float, n: int = 5) -> DataFrame:
    """(a, b): links enough to join all documents that belong together; a copy has one, to its node."""
    of, members = nodes(shingle_sets(docs, n))
    copies = members.where("node <> doc_id").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    return similar_nodes(of, threshold).select("a", "b").union(copies)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, component): the smallest id reachable; minimum labels with pointer jumping, one written table a round."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = written(nodes.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("comp")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("m"))
        low = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "comp", F.least("comp", F.coalesce("m", "comp")).alias("low"))
        jump = labels.select(F.col("node").alias("n2"), F.col("comp").alias("c2"))
        out = written(low.join(jump, F.col("low") == F.col("n2")).select("node", F.col("comp").alias("was"), F.least("low", "c2").alias("comp")))
        labels = out.select("node", "comp")
        if out.where("comp <> was").isEmpty():
            return labels.select(F.col("node").alias("doc_id"), F.col("comp").alias("component"))


def keep_first(members: DataFrame) -> DataFrame:
    """One survivor a component: the smallest id."""
    return members.groupBy("component").agg(F.min("doc_id").alias("doc_id"))


def keep_best(members: DataFrame, score: str) -> DataFrame:
    """One survivor a component: the highest score, ties to the smallest id."""
    return members.groupBy("component").agg(F.max_by("doc_id", F.struct(F.col(score), -F.col("doc_id"))).alias("doc_id"))




def keep_first_units(docs: DataFrame, mark: str, least: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, n_removed: of units between `mark`s (trimmed, longer than `least` characters) that the corpus repeats, only the first in the order of key and place stays.

    First places are combined before the shuffle, and only repeated units, 16 bytes each, are joined back. Texts
    are put together again with the mark; shorter units stay.
    """
    u = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), mark)).alias("pos", "unit")).withColumn("t", F.trim("unit"))
    u = u.withColumns({"h": F.when(F.length("t") > least, F.xxhash64("t")), "g": F.xxhash64(F.lit(1), "t")})
    again = u.where("h is not null").groupBy("h", "g").agg(F.min(F.struct(key, "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    marked = u.join(small(written(again.select("h", "g", "first"))), ["h", "g"], "left")
    gone = F.coalesce(F.struct(key, "pos") != F.col("first"), F.lit(False))
    kept = marked.groupBy(key).agg(F.array_sort(F.collect_list(F.when(~gone, F.struct("pos", "unit")))).alias("x"), F.count_if(gone).alias("n_removed"))
    return kept.select(key, F.array_join(F.transform("x", lambda v: v["unit"]), mark.replace("[.]", ".")).alias(text), "n_removed")


def repeated_windows(docs: DataFrame, n: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """h, n, first_doc: the md5 of each window of n words that the corpus has more than once, its count and the least key that has it. Texts are joined only to the first places of such windows."""
    first = windows.repeated(docs, n, key, text, firsts=True).groupBy("key").agg(F.collect_list(F.struct("place", "h", "n")).alias("x"))
    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(windows.NO_KEY)).alias("key"), F.col(key).alias("first_doc"), F.col(text).alias("t"))
    met = held(texts.join(first, "key"), "w", words(F.col("t"))).where(F.size("w") >= n)
    several = not texts.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    if several:  # of rows that share a key, those that have the window there
        same = windows.same_windows(n)(F.transform("w", lambda v: F.xxhash64(v)), F.col("x.place"), F.col("x.h"))
        met = met.withColumn("x", F.transform(F.filter(F.arrays_zip(F.col("x"), same.alias("same")), lambda v: v["same"]), lambda v: v["x"]))
    out = met.select("first_doc", "w", F.inline("x")).select(F.md5(F.array_join(F.slice("w", F.col("place"), F.lit(n)), " ")).alias("h"), "n", "first_doc")
    return out.dropDuplicates(["h"]) if several else out


def mask_repeated_windows(docs: DataFrame, n: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, words, n_removed: a text's words without those in a window of n words that came before in the corpus (in the order of key and place). Keys are whole numbers; only the places of repeated windows are sent back to the texts."""
    bad = windows.repeated(docs, n, key, text, firsts=False).where(F.col("key") != windows.NO_KEY)
    spans = bad.groupBy("key").agg(F.collect_set("place").alias("starts")).withColumn("key", F.col("key").cast(docs.schema[key].dataType)).withColumnRenamed("key", key)
    out = held(docs.select(key, F.col(text).alias("t")).join(spans, key, "left"), "w", words(F.coalesce("t", F.lit(""))))
    # a word goes if a window that starts at it or up to n - 1 words before is bad
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda i: F.sequence(i, i + (n - 1)))))
    out = held(out, "gone", F.coalesce(covered, F.array().cast("array<int>")))
    kept = F.transform(F.array_except(F.sequence(F.lit(1), F.size("w")), F.col("gone")), lambda i: F.element_at("w", i))
    kept = F.when(F.size("w") > 0, kept).otherwise(F.array().cast("array<string>"))
    return out.select(key, kept.alias("words"), F.size("gone").cast("long").alias("n_removed"))


#: Rows of keyed hashes, and pairs of documents, that a task of `hamming_pairs` is to compare or list; documents of one hash that go together.
KEYED_ROWS, LISTED_PAIRS, TOGETHER = 100_000, 4_000_000, 1000


def near_hashes(one: DataFrame, h: str, bits: int, most: int) -> DataFrame:
    """(p, q, distance), p < q: of distinct hashes those that differ in at most `most` bits. Of most + 3 slices such a pair agrees in some three whole ones, so these are the keys: longer than one of most + 1 slices, and pairs too far apart go in the join itself."""
    slices = min(bits, most + 3)
    cuts = [round(i * bits / slices) for i in range(slices + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [signed(sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in kept)) for kept in combinations(range(slices), max(1, slices - most))]
    pieces = F.array(*[F.struct(F.lit(i).alias("i"), F.col(h).bitwiseAND(F.lit(m).cast("long")).alias("v")) for i, m in enumerate(masks)])
    parts = max(int(one.sparkSession.conf.get("spark.sql.shuffle.partitions")), one.count() * len(masks) // KEYED_ROWS)
    keyed = one.select(F.col(h).cast("long").alias(h)).select(h, F.inline(pieces)).repartition(parts, "i", "v")
    x, y = keyed.alias("x"), keyed.alias("y")
    met = x.join(y, F.expr(f"x.i = y.i and x.v = y.v and x.{h} < y.{h} and bit_count(x.{h} ^ y.{h}) <= {most}"))
    return met.select(F.col(f"x.{h}").alias("p"), F.col(f"y.{h}").alias("q")).distinct().withColumn("distance", F.bit_count(F.col("p").bitwiseXOR(F.col("q"))))


def hamming_pairs(hashes: DataFrame, key: str, h: str, bits: int, most: int) -> DataFrame:
    """(a, b, distance), a < b: hashes that differ in at most `most` bits. Equal hashes are one row until the end; then their documents, some hundred at a time, are listed pair by pair in tasks of about LISTED_PAIRS.

    A key goes through a sorted list, the smaller ones upward, then the larger ones downward: each column repeats one key or begins as it did for
    the key before, so that a table of the pairs compresses.
    """
    spark = hashes.sparkSession
    rows = written(hashes.where(F.col(key).isNotNull() & F.col(h).isNotNull()).select(key, F.col(h).cast("long").alias(h)))
    one = written(rows.groupBy(h).agg(F.count("*").alias("c")))
    own = one.where("c > 1").select(F.col(h).alias("p"), F.col(h).alias("q"), F.lit(0).alias("distance"))
    near = written(near_hashes(one, h, bits, most).union(own))
    size = lambda k: one.select(F.col(h).alias(k), F.col("c").alias("c" + k))
    total = near.join(size("p"), "p").join(size("q"), "q").agg(F.sum(F.col("cp").cast("double") * F.col("cq"))).first()[0] or 0
    many = F.broadcast(one.where(F.col("c") > TOGETHER).select(h, F.ceil(F.col("c") / TOGETHER).alias("several")))
    slot = F.pmod(F.xxhash64(key), F.coalesce("several", F.lit(1).cast("long")))
    lists = rows.join(many, h, "left").groupBy(h, slot.alias("slot")).agg(F.sort_array(F.collect_list(key)).alias("ks"))
    side = lambda k, e: lists.select(F.col(h).alias(k), F.col("slot").alias("slot" + e), F.col("ks").alias("k" + e))
    met = near.join(side("p", "a"), "p").join(side("q", "b"), "q").where("p <> q or slota <= slotb")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total / LISTED_PAIRS))
    dealt = met.repartition(parts, "p", "q", "slota", "slotb")
    same = (F.col("p") == F.col("q")) & (F.col("slota") == F.col("slotb"))
    each = dealt.select(F.col("distance").cast("long").alias("distance"), same.alias("same"), "kb", F.explode("ka").alias("one"))
    below, above = F.filter("kb", lambda k: k < F.col("one")), F.reverse(F.filter("kb", lambda k: k > F.col("one")))
    pairs = each.select("distance", "one", F.explode(F.when(F.col("same"), below).otherwise(F.concat(below, above))).alias("two"))
    return pairs.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"), "distance")


def simhash(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, simhash): bit b is set if more words of the text have bit b in their hash (of an md5) than have not; texts without words are left out."""
    w = docs.select("doc_id", F.explode(words(F.col("text"))).alias("w"))
    part = lambda at: F.conv(F.substring(F.md5("w"), at, 8), 16, 10).cast("long")
    h = w.select("doc_id", part(1).alias("lo"), part(9).alias("hi"))
    votes = [F.sum(F.when(F.getbit("lo" if b < 32 else "hi", F.lit(b % 32)) == 1, 1).otherwise(-1)).alias(f"v{b}") for b in range(bits)]
    voted = h.groupBy("doc_id").agg(*votes)
    bit = lambda b: F.when(F.col(f"v{b}") > 0, F.lit((1 << b) if b < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long")
    out = bit(0)
    for b in range(1, bits):
        out = out.bitwiseOR(bit(b))
    return voted.select("doc_id", out.alias("simhash"))


def verified(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, inter, uni) of candidate pairs whose sets (`shingle_sets`) have Jaccard `threshold` or more; documents without shingles are in no pair. Pairs of too different sizes go before any set is shuffled."""
    size = lambda k: sets.select(F.col("doc_id").alias(k), F.col("n").alias("n" + k))
    alike = candidates.join(size("a"), "a").join(size("b"), "b").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)
    pairs = written(alike.select("a", "b"))
    some = sets.join(small(written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())), "doc_id", "left_semi")
    side = lambda k: some.select(F.col("doc_id").alias(k), F.col("s").alias("s" + k), F.col("n").alias("n" + k))
    both = held(pairs.join(side("a"), "a").join(side("b"), "b"), "inter", F.size(F.array_intersect("sa", "sb")).cast("long"))
    found = both.withColumn("uni", (F.col("na") + F.col("nb") - F.col("inter")).cast("long"))
    return found.where(F.col("inter") >= threshold * F.col("uni")).select("a", "b", "inter", "uni")


def copy_kinds(docs: DataFrame, source: str = "source") -> DataFrame:
    """doc_id, kind: `original` (the first with its text), `mirror` (its text was first in another source) or `copy` (in its own). Firsts are combined before the shuffle."""
    rows = docs.select("doc_id", F.col(source).alias("s"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    firsts = rows.groupBy("h").agg(F.min(F.struct("doc_id", "s")).alias("f"))
    kind = F.when(F.col("doc_id") == F.col("f.doc_id"), "original").when(F.col("s").eqNullSafe(F.col("f.s")), "copy").otherwise("mirror")
    return rows.join(firsts, "h").select("doc_id", kind.alias("kind"))
