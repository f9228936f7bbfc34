"""Planted truth, golden values and invariants of the reference operators."""

import pytest
from pyspark.sql import functions as F

from lexloom.operators import bpe, dedup
from lexloom.operators.prefix import running_sum
from lexloom.plans import catalogue
from lexloom.plans.dialect import expand


def test_components_close_over_paths(spark):
    nodes = spark.range(40).withColumnRenamed("id", "doc_id")
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 19)] + [(25, 30), (30, 39)], "a long, b long")
    got = {r.doc_id: r.component for r in dedup.components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(20)) and got[39] == got[25] == 25 and got[24] == 24


def test_minhash_matches_python_integers(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, ""), (3, None)], "doc_id long, text string")
    perms = dedup.permutations(8, 3)
    got = {r.doc_id: list(r.sig) for r in dedup.signatures(docs, perms).collect()}
    import hashlib

    x = [int(hashlib.md5(" ".join("abcdefg"[i : i + 5]).encode()).hexdigest()[:8], 16) for i in range(3)]
    assert got[1] == [min((a * v + b) % dedup.MERSENNE & 0xFFFFFFFF for v in x) for a, b in perms]
    assert got[2] == got[3] == [dedup.EMPTY_HASH] * 8


def test_minima_match_python_integers_at_the_edges():
    import numpy as np

    x = [0, 1, 2**31 - 1, 2**31, 2**32 - 1, 12345, 987654321]
    perms = [(1, 0), (dedup.MERSENNE - 1, dedup.MERSENNE - 1), (1 << 60, 5), ((1 << 30) - 1, 0), *dedup.permutations(40, 9)]
    want = [[min((a * v + b) % dedup.MERSENNE & 0xFFFFFFFF for v in x[lo:hi]) for a, b in perms] for lo, hi in ((0, 3), (3, 7))]
    assert dedup.minima(np.array(x, np.uint64), np.array([0, 3]), perms).tolist() == want


@pytest.mark.parametrize("common", [1, 10**9])
def test_similar_pairs_equal_brute_force_and_ship_few_sets(spark, monkeypatch, common):
    """The same pairs whatever shingles count as common; sets of one passage in common are ruled out by their prefixes."""
    import random

    monkeypatch.setattr(dedup, "COMMON", common)
    r = random.Random(8)
    fresh = lambda k: [f"w{r.randrange(10**6)}" for _ in range(k)]
    passage, texts = fresh(12), []
    for size in (6, 20, 60, 150):
        base = fresh(size)
        for changes in (0, 0, 1, 2, 5):
            w = list(base)
            for _ in range(changes):
                w[r.randrange(len(w))] = "changed"
            texts += [w, w[: len(w) * 3 // 4], w + fresh(2)]
    texts += [fresh(150) + passage + fresh(150) for _ in range(12)] + [["one"], ["one"], ["a", "b"], []]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in texts]
    want = sorted((i, j, len(x & y), len(x | y)) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if x | y and len(x & y) >= 0.7 * len(x | y))
    tables = []
    monkeypatch.setattr(dedup, "written", lambda df, f=dedup.written: tables.append(f(df)) or tables[-1])
    monkeypatch.setattr(dedup, "freed", lambda *t: None)
    assert sorted(map(tuple, dedup.similar_pairs(docs, 0.7).collect())) == want and len(want) > 30
    ends = set(range(len(texts) - 16, len(texts) - 4))  # the twelve with the passage
    met = [(x.a, x.b) for t in tables if t.columns == ["a", "b"] for x in t.collect()]
    assert met and not [p for p in met if ends & set(p)]


def test_banding_compares_one_document_of_each_set(spark, monkeypatch):
    """Copies are listed pair by pair, but only their first document is signed; pairs of too different sizes ship no set."""
    text = "a b c d e f g h i j k l"
    docs = spark.createDataFrame([(i, text) for i in range(30)] + [(50, text + " m"), (60, ""), (61, None), (70, " ".join(f"v{i}" for i in range(30)))], "doc_id long, text string")
    signed = []
    monkeypatch.setattr(dedup, "signatures", lambda df, perms, f=dedup.signatures: signed.append(f(df, perms)) or signed[-1])
    got = sorted(tuple(x) for x in dedup.lsh_pairs(docs, dedup.permutations(16), 16, 1, 0.7).collect())
    copies = [(i, j, 8, 8) for i in range(30) for j in range(i + 1, 30)]
    assert got == sorted(copies + [(i, 50, 8, 9) for i in range(30)])
    assert {x.doc_id for x in signed[0].collect()} == {0, 50, 60, 61, 70}


def test_best_member_wins_ties_by_smallest_id(spark):
    m = spark.createDataFrame([(5, 1, 0.5), (4, 1, 0.9), (3, 1, 0.9)], "doc_id long, component long, score double")
    assert dedup.keep_best(m, "score").first().doc_id == 3


def test_bpe_round_trip_and_order(spark):
    counts = spark.createDataFrame([("abab", 5), ("abc", 3), ("é", 1)], "chunk string, n long")
    merges = bpe.train(counts, 260)
    assert merges[0] == (97, 98)
    assert bpe.encoded(counts, merges).where("not ok").count() == 0


def test_bpe_counts_rare_chunks(spark):
    common = spark.range(200_000).select(F.col("id").cast("string").alias("chunk"), F.lit(2).cast("long").alias("n"))
    rare = spark.range(150_000).select(F.concat(F.lit("zq"), F.col("id").cast("string")).alias("chunk"), F.lit(1).cast("long").alias("n"))
    assert bpe.train(common.union(rare), 257) == [(ord("z"), ord("q"))]


def merged(ids, pair, new):
    out = []
    for x in ids:
        out.append(x)
        if tuple(out[-2:]) == pair and len(out) > 1:
            out[-2:] = [new]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_bpe_merges_match_one_merge_at_a_time(spark, seed):
    import random
    from collections import Counter

    r = random.Random(seed)
    words = Counter("".join(r.choice("aab c") for _ in range(r.randint(1, 12))) + r.choice(["", "aaaa", "éé", "zzzzz"]) for _ in range(120))
    want, state = [], [(list(c.encode()), n) for c, n in words.items()]
    while len(want) < 60:
        pairs = Counter()
        for ids, n in state:
            for p in zip(ids, ids[1:], strict=False):
                pairs[p] += n
        best = min(pairs, key=lambda p: (-pairs[p], p), default=None)
        if best is None or pairs[best] < 2:
            break
        state = [(merged(ids, best, 256 + len(want)), n) for ids, n in state]
        want.append(best)
    assert bpe.train(spark.createDataFrame(list(words.items()), "chunk string, n long"), 316) == want


def test_prefix_sum_over_ranges(spark):
    df = spark.range(1, 500).withColumn("v", F.col("id") % 7)
    got = {r.id: r.s for r in running_sum(df, "id", "v", "s", 37).collect()}
    total = 0
    for i in range(1, 500):
        assert got[i] == total
        total += i % 7


def test_pack_positions_keeps_large_and_null_ids(spark, tmp_path):
    rows = [(1, 3000), (5, 10), (2_000_000_000, 100), (1 << 60, 7), (None, 4), (None, 9)]
    spark.createDataFrame(rows, "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in catalogue.queries()["pack_positions"](spark, str(tmp_path)).collect()), key=lambda r: r[1])
    starts = [(1, 0), (5, 3000), (2_000_000_000, 3010), (1 << 60, 3110), (None, 3117), (None, 3121)]
    assert got == [(i, s, s % 2048, s // 2048) for i, s in starts]


@pytest.mark.parametrize(("name", "column", "want"), [
    ("packing_win", "speed_up", 11.377778), ("funnel_arithmetic", "petabytes", 0.675), ("stratified_golden", "acc", 0.7455), ("zipf_harmonic", "head", 0.606),
])
def test_golden_values(spark, name, column, want):
    assert abs(catalogue.queries()[name](spark, "").first()[column] - want) < 1e-3


def test_s_curve(spark):
    got = {(r.b, float(r.s)): r.p for r in catalogue.queries()["lsh_s_curve"](spark, "").collect()}
    assert [got[16, s] for s in (0.5, 0.7, 0.8, 0.9)] == pytest.approx([0.0607, 0.6133, 0.9471, 0.99988], abs=1e-4)


def test_supervised_token_golden(spark):
    assert tuple(catalogue.queries()["sft_golden_counts"](spark, "").first()) == (473, 470, 151)


def test_macros_keep_brackets():
    assert expand("IDIV(a + 1, 2)", True) == "((a + 1) div (2))"


def test_library_does_not_need_the_llm_package():
    import ast
    import pathlib

    root = pathlib.Path(catalogue.__file__).parent.parent
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            for node in ast.walk(ast.parse(f.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any("llm" in n for n in names), f


def test_ranks_without_one_sorting_task(spark):
    import random

    from lexloom.operators.prefix import ranked, tiled

    r = random.Random(3)
    rows = [(i, r.choice([None, 5.0, 5.0, 5.0, r.random() * 10, float(r.randint(0, 9))])) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, v double")
    for down in (False, True):
        want = {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda x: (x[1] is None, (-x[1] if down else x[1]) if x[1] is not None else 0, x[0])), 1)}
        got = {x.i: x.rk for x in ranked(df, "v", "i", "rk", down, parts=16, width=100).collect()}
        assert got == want
    n = spark.range(1, 24).select(F.col("id"), tiled(F.col("id"), F.lit(23), 5).alias("t")).groupBy("t").count().orderBy("t").collect()
    assert [x["count"] for x in n] == [5, 5, 5, 4, 4]


def test_similar_pairs_and_links_with_copies(spark):
    import random

    r = random.Random(5)
    words = [f"w{i}" for i in range(80)]
    base = [[r.choice(words) for _ in range(r.choice([1, 4, 6, 20, 50]))] for _ in range(15)]
    rows = []
    for i in range(120):
        w = list(r.choice(base))
        if r.random() < 0.6:
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(200, ""), (201, None), (202, "...")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows if (w := (t or "").replace(".", "").split())}
    want = {(a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    got = [tuple(x) for x in dedup.similar_pairs(docs, 0.7).collect()]
    assert set(got) == want and len(got) == len(want)
    named = lambda edges: {x.doc_id: x.component for x in dedup.components(docs.select("doc_id"), edges).collect()}
    assert named(dedup.links(docs, 0.7)) == named(spark.createDataFrame([x[:2] for x in want], "a long, b long"))


def test_codec_takes_the_lowest_rank_first(spark):
    import random

    r = random.Random(2)
    counts = spark.createDataFrame([("".join(r.choice("abc é") for _ in range(r.randint(1, 30))), r.randint(1, 9)) for _ in range(60)], "chunk string, n long")
    merges = bpe.train(counts, 300)
    codec, rank = bpe.Codec(merges), {p: i for i, p in enumerate(merges)}
    for _ in range(300):
        text = "".join(r.choice("aabc é") for _ in range(r.randint(0, 25)))
        ids = list(text.encode())
        while len(ids) > 1 and (best := min(zip(ids, ids[1:], strict=False), key=lambda p: rank.get(p, 1 << 30))) in rank:
            ids = merged(ids, best, 256 + rank[best])
        assert codec.encode(text) == ids and codec.decode(ids) == text


def test_next_fit_padding_and_resumed_loader(spark):
    from lexloom.operators import training_rows as T

    sizes = [5, 4, 3, 9, 1, 20, 2, 8, 8]
    df = spark.createDataFrame(list(enumerate(sizes)), "k long, n long")
    got = [(x.k, x.pack, x.start_at) for x in T.next_fit(df, "k", "n", 10).orderBy("k").collect()]
    assert got == [(0, 0, 0), (1, 0, 5), (2, 1, 0), (3, 2, 0), (4, 2, 9), (6, 3, 0), (7, 3, 2), (8, 4, 0)]  # 20 is over the limit
    turns = spark.createDataFrame([(1, 1, "user", "hé"), (1, 2, "assistant", "ok"), (1, 3, "user", None), (1, 4, "assistant", "bye"), (2, 1, "system", "")], "conv_id long, turn long, role string, text string")
    rows = {m: {x.conv_id: (list(x.ids), list(x.labels)) for x in T.examples(turns, m).collect()} for m in T.MODES}
    ids = [256, 104, 195, 169, 257, 111, 107, 259, 256, 257, 98, 121, 101, 259]
    assert rows["correct"][1] == (ids, [-100] * 5 + [111, 107, 259] + [-100] * 2 + [98, 121, 101, 259]) and rows["correct"][2] == ([258], [-100])
    assert rows["no_eos"][1][1] == [-100] * 5 + [111, 107, -100] + [-100] * 2 + [98, 121, 101, -100] and rows["no_mask"][1][1] == ids
    assert rows["last_turn"][1][1] == [-100] * 10 + [98, 121, 101, 259]
    assert T.examples(turns, generation_prompt=True).where("conv_id = 2").first()["ids"] == [258, 257]
    padded = {x.conv_id: (list(x.ids), x.longest) for x in T.padded(T.examples(turns), "conv_id", 2).collect()}
    assert padded[2] == ([258] + [0] * 13, 14)
    docs = spark.range(100).withColumnRenamed("id", "doc_id")
    a, b = T.Loader(docs, batch=8), T.Loader(docs.repartition(5), batch=8)
    first = a.next(5)
    b.load_state_dict(a.state_dict())
    assert first.count() == 40 and T.first_difference(a.next(10), b.next(10)).first().differing == 0
    assert T.first_difference(first, first.where("not (step = 3 and doc_id % 2 = 0)")).first().first_step == 3
    with pytest.raises(ValueError):
        b.load_state_dict({"seed": 1, "batch": 8, "epoch": 0, "step": 0})


def test_markdown_links_anchors_fences_and_cells(spark):
    from lexloom.operators import markdown as K

    files = [
        ("README.md", "# Top *level*\n\n[a](docs/a.md#part-one) [gone](docs/b.md) ![pic](no.png) [self](#top-level) [far](https://x.org/y)\n```\n[in code](nowhere.md)\n# not a heading\n```\n## Part\n## Part\n"),
        ("docs/a.md", "# [Part](../README.md) one\n[up](../README.md#part-1) [bad](../README.md#part-2)"), ("docs/c.md", None),
    ]
    df = spark.createDataFrame(files, "path string, text string")
    got = {(x.path, x.target, x.problem) for x in K.broken_links(df).collect()}
    assert got == {("README.md", "docs/b.md", "no such file"), ("docs/a.md", "../README.md#part-2", "no such anchor")}
    assert [x.anchor for x in K.anchors(df).where("path = 'README.md'").orderBy("place").collect()] == ["top-level", "part", "part-1"]
    f = spark.createDataFrame([("a\n```py\nb\n```\nc\n~~~\nd",)], "t string").select(K.fenced(F.col("t")).alias("f")).first().f
    assert (f.inside, f.outside) == (["b", "d"], ["a", "c"])
    c = spark.createDataFrame([("x\n# %%\na\nb\n# %% [markdown]\n# hi",)], "t string").select(K.cells(F.col("t")).alias("c")).first().c
    assert [tuple(x) for x in c] == [("code", "a\nb\n"), ("markdown", "# hi\n")]


def test_stage_outputs_and_readers(spark, tmp_path):
    import gzip

    from lexloom.sources.files import blob_name, read_binary, read_lines, read_warc
    from lexloom.sources.stages import Stages

    stages = Stages(spark, f"file://{tmp_path}/stages")
    df = spark.createDataFrame([(1, 2.0), (2, None)], "k long, v double")
    stages.write("s", "1", df, v=F.sum("v"))
    again = stages.write("s", "1", df.limit(0))  # complete: not written again
    assert again.count() == 2 and {x.name: x.value for x in stages.statistics("s", "1").collect()} == {"n_rows": 2.0, "v": 2.0}
    assert stages.write("s", "2", df.limit(0)).count() == 0 and stages.done("s", "2") and not stages.done("s", "3")
    (tmp_path / "a.txt").write_bytes(b"one\ntwo\n")
    assert sorted(x.line for x in read_lines(spark, f"file://{tmp_path}/a.txt").collect()) == ["one", "two"]
    assert read_binary(spark, f"file://{tmp_path}/a.txt").first().git_name == "814f4a422927b82f5f8a43f8fab6d3839e3983f2"
    assert spark.range(1).select(blob_name(F.lit(b"")).alias("n")).first().n == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"
    record = lambda kind, body: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://a/{kind}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(record("warcinfo", b"")) + gzip.compress(record("response", b"HTTP/1.1 200 OK\r\n\r\nWARC/ in text")))
    got = [(x.type, x.uri, x.length, bytes(x.block)) for x in read_warc(spark, f"file://{tmp_path}/x.warc.gz").collect()]
    assert got == [("warcinfo", "http://a/warcinfo", 0, b""), ("response", "http://a/response", 32, b"HTTP/1.1 200 OK\r\n\r\nWARC/ in text")]


def test_votes_rewards_and_health(spark):
    from lexloom.operators import evaluation as E
    from lexloom.operators import rewards as R
    from lexloom.operators import voting as V

    s = spark.createDataFrame([(1, 1, 3, 0.1, 0), (1, 2, 2, 0.9, 1), (1, 3, 2, 0.9, 0), (1, 4, 3, 0.2, 1), (2, 1, None, 0.5, 1)], "g long, i long, a long, score double, ok int")
    assert {(x.g, x.a, x.n) for x in V.majority_vote(s, "g", "a").collect()} == {(1, 2, 2)}  # ties to the smallest answer, nulls do not vote
    assert {(x.g, x.a) for x in V.majority_vote(s, "g", "a", "i").collect()} == {(1, 3)}  # or to the one seen first
    assert V.best_of_n(s, "g", "i", "score", 4).where("g = 1").first().i == 2
    curve = {x.n: (x.acc, x.oracle) for x in V.best_of_n_curve(s.where("g = 1"), "g", "i", "ok", "score", [1, 2]).collect()}
    assert curve == {1: (0.0, 0.0), 2: (1.0, 1.0)}
    adv = {(x.g, x.i): x.adv for x in R.rloo(s, "g", "score").collect()}
    assert adv[2, 1] is None and abs(adv[1, 1] - (0.1 - 2.0 / 3)) < 1e-9
    t = spark.createDataFrame([(1, k, float(k)) for k in range(1, 6)], "g long, t long, r double")
    gae, want = {x.t: x.adv for x in R.gae(t, "g", "t", "r", "r").collect()}, 0.0
    for k in range(5, 0, -1):
        want = k + 0.99 * (k + 1 if k < 5 else 0) - k + 0.99 * 0.95 * want
        assert abs(gae[k] - want) < 1e-9
    tokens = spark.createDataFrame([([0, 1, 5],), ([1, 1, 5],), ([3, 1],), ([],)], "x array<long>")
    parts = R.token_score(F.col("x"), F.lit(3), think_bonus=0.5)
    assert [tuple(x) for x in tokens.select(*parts.values()).collect()] == [(1.0, 1.0, 0.5, 0.0), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0)]
    rows = [(k, 0, 1.0, 1.0, 1.0, 0, 7) for k in range(10)] + [(k, 1, 1.0, 1.0, 1.0, 0, 7) for k in range(10)]
    rows[3], rows[4], rows[5] = (3, 0, float("nan"), 1.0, 1.0, 0, 7), (4, 0, 5.0, 50.0, 1.0, 0, 7), (5, 0, 1.0, 1.0, 9.0, 0, 8)
    log = spark.createDataFrame(rows, "step long, rank long, loss double, grad_norm double, seconds double, last_saved long, param_hash long")
    got = {x.step: {k for k, v in x.asDict().items() if v is True} for x in E.health_alerts(log, stale=8).collect()}
    assert got[3] == {"non_finite"} and got[4] == {"spike", "explosion"} and got[5] == {"slow", "diverged"} and got[9] == {"stale"} and not got[2]


def test_nearest_blocks_equal_brute_force(spark):
    import numpy as np

    from lexloom.operators.neighbours import nearest

    r = np.random.default_rng(4)
    x = r.integers(-3, 4, (60, 5)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    got = {(row.a, row.b) for row in nearest(df, df.where("k % 7 = 0"), "k", "v", 3, block=4).collect()}
    want = {(a, b) for a in range(0, 60, 7) for b in sorted((b for b in range(60) if b != a), key=lambda b: (-round(x[a] @ x[b], 6), b))[:3]}
    assert got == want


@pytest.mark.parametrize(("rows", "queries"), [(7, 3), (2, 1)])
def test_nearest_in_slices_equals_brute_force(spark, monkeypatch, rows, queries):
    """Products are taken slice by slice, however large a batch is: also slices with fewer rows than neighbours, and equal products."""
    import numpy as np

    from lexloom.operators import neighbours

    monkeypatch.setattr(neighbours, "ROWS", rows)
    monkeypatch.setattr(neighbours, "QUERIES", queries)
    r = np.random.default_rng(5)
    x = r.integers(-1, 2, (40, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    got = sorted((row.a, row.b) for row in neighbours.nearest(df, df.where("k % 5 = 0"), "k", "v", 3).collect())
    want = sorted((a, b) for a in range(0, 40, 5) for b in sorted((b for b in range(40) if b != a), key=lambda b: (-round(x[a] @ x[b], 6), b))[:3])
    assert got == want


def test_embedding_neighbours_has_three_of_every_row(spark, tmp_path):
    """Every vector is a query; also with many equal products and rows in several blocks."""
    import numpy as np

    r = np.random.default_rng(6)
    x = r.integers(-2, 3, (9000, 64)).astype(np.float32) / 8
    x[:3000] = x[0]
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for row in catalogue.queries()["embedding_neighbours"](spark, str(tmp_path)).collect():
        got.setdefault(row.a, []).append((-row.dot, row.b))
    dot = np.round(x.astype(float) @ x.T.astype(float), 6)
    np.fill_diagonal(dot, -np.inf)
    best = np.argsort(-dot, axis=1, kind="stable")[:, :3]
    assert {a: [b for _, b in sorted(v)] for a, v in got.items()} == {a: b.tolist() for a, b in enumerate(best)}


def test_streams_filter_and_alert(spark):
    names = ("contamination_stream", "clean_documents_stream")
    bad, good = ({x.doc_id for x in catalogue.queries()[n](spark, "/root/testdata/sf0.001").collect()} for n in names)
    assert bad and not bad & good and len(bad | good) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_cost_models_meet_published_figures(spark):
    from lexloom.operators import costs as K

    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert [round(value(K.checkpoint_interval(c, h))) for c, h in ((60, 12), (10, 3), (2, 3))] == [2277, 465, 208]
    assert [round(value(K.kv_bytes(80, h, 128)) / 1e6, 3) for h in (64, 8, 1)] == [2.621, 0.328, 0.041]
    exposed = [value(K.ring_allreduce(140e9, 1024, *link)) for link in ((40, 5), (10, 15))]
    assert [round(x, 1) for x in exposed] == [7.0, 28.0]
    freq = {k: value(K.rope_frequency(63, 128, scale=4, kind=k)) for k in ("none", "pi", "ntk", "yarn")}
    assert abs(freq["pi"] * 4 - freq["none"]) < 1e-12 and abs(freq["yarn"] - freq["pi"]) < 1e-12 and abs(freq["ntk"] - freq["pi"]) < 1e-9
    assert abs(value(K.rope_frequency(0, 128, scale=4, kind="yarn")) - 1) < 1e-12
    runs = spark.createDataFrame([(float(n), 1.5 + 40 * n**-0.3) for n in (1e5, 1e6, 1e7, 1e8)], "n double, loss double")
    fit = K.predicted(K.fit_scaling(runs, "n", "loss"), 1e9).first()
    assert abs(fit.e - 1.5) < 1e-3 and abs(fit.slope + 0.3) < 1e-2 and abs(fit.predicted - (1.5 + 40 * 1e9**-0.3)) < 1e-2


def test_repeated_units_windows_and_hamming_pairs(spark):
    line = "a sentence that is long enough"
    docs = spark.createDataFrame([(1, f"{line}\nshort\n{line}"), (2, f"x\n {line} \nshort"), (3, None), (4, "")], "doc_id long, text string")
    got = {x.doc_id: (x.text, x.n_removed) for x in dedup.keep_first_units(docs, "\n").collect()}
    assert got == {1: (f"{line}\nshort", 1), 2: ("x\nshort", 1), 3: ("", 0), 4: ("", 0)}
    w = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, "new " + " ".join(w[3:9]) + " end"), (3, None)], "doc_id long, text string")
    got = {x.doc_id: (list(x.words), x.n_removed) for x in dedup.mask_repeated_windows(docs, 5).collect()}
    assert got == {1: (w, 0), 2: (["new", "end"], 6), 3: ([], 0)}
    rows = [(i, (i * 2654435761) % 64) for i in range(50)] + [(90, 5), (91, 5), (92, 4)]
    got = {tuple(x) for x in dedup.hamming_pairs(spark.createDataFrame(rows, "k long, h long"), "k", "h", 6, 1).collect()}
    assert got == {(a, b, bin(x ^ y).count("1")) for a, x in rows for b, y in rows if a < b and bin(x ^ y).count("1") <= 1}
