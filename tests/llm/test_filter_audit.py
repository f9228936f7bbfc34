"""The filter audit against every order run over the rows themselves."""

from collections import Counter
from itertools import permutations

import pytest

from lexloom.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int, mask int"
DOCS = "doc_id long, text string, source string, part string, mask int, bits int, n int"


def rows_of_audit(docs, labels):
    """One pass a (part, order): rows of (doc_id, text, source)."""
    split = lambda t: [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    texts, smallest, out = [(k, t or "", s or "") for k, t, s in docs], {}, {}
    for k, t, _ in texts:
        if k is not None:
            smallest[t] = min(smallest.get(t, k), k)
    fails = []
    for k, t, s in texts:
        w = split(t)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": k is not None and smallest[t] < k}
        fails.append((s, bad, k in good, k in toxic))
    total = Counter()
    for part in {s for s, *_ in fails}:
        for order in permutations("ABCDE"):
            left = [x for x in fails if x[0] == part]
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                own = [x for x in fails if x[0] == part and x[1][f]]
                out[part, "".join(order), step] = [len(left), len(gone), len(own) - len(gone), sum(sum(x[1].values()) == 1 for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                total[part, f] += len(gone)
    return {(p, o, s): (*v, total[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_filter_audit_equals_every_order(spark):
    long = " ".join(f"w{i}" for i in range(60))
    texts = [long, long.upper(), long + " #", "ab " * 70, "AB# " * 80, "short", "", None, " \n\x0b ", "é" * 300, long + "\x0cx" * 40, "word " * 40_000]
    docs = [(i, texts[(i * 7) % len(texts)], [None, "", "s1", "s2"][i % 4]) for i in range(120)]
    docs += [(3, texts[0], "s1"), (3, texts[0], "s1"), (None, texts[0], "s1"), (None, None, None), (0, None, "s2")]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (5, None, None), (None, 1, 1), (9, 0, 1), (14, 1, None), (999, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", 3, 4, 5) for d in docs], DOCS)
    got = filter_audit.audit(frame, spark.createDataFrame([(*x, 1) for x in labels], LABELS))
    assert got.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    found = {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()}
    assert found == rows_of_audit(docs, labels)
    assert len(found) == 3 * 600  # null and empty sources are one part


@pytest.mark.parametrize("label_rows", [[], [(1, 1, 1, 0)]])
def test_filter_audit_of_nothing(spark, label_rows):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame(label_rows, LABELS)
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "s", None, None, None, None)], DOCS)
    got = filter_audit.audit(one, labels).collect()
    assert len(got) == 600
    assert {(r.filter_order[r.step - 1], r.removed) for r in got if r.filter_order.startswith("A")} == {("A", 1), ("B", 0), ("C", 0), ("D", 0), ("E", 0)}
