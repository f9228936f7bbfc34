"""Counts over pairs of documents: copies are multiplied, not listed, and the counts are those of the SQL."""

import random

import duckdb
import pytest

from lexloom.operators import dedup
from lexloom.plans import catalogue


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, rows = random.Random(3), []
    for size in (3, 12, 40, 90):
        base = [f"w{r.randrange(10**6)}" for _ in range(size)]
        for changes in (0, 0, 0, 1, 1, 2, 5):
            w = list(base)
            for _ in range(changes):
                w[r.randrange(size)] = f"x{r.randrange(10**6)}"
            rows += [" ".join(w)] * r.choice((1, 3))
    rows += ["one text of many copies that has some words and more of them"] * 60 + ["", "...", None, " "] * 3
    r.shuffle(rows)
    path = tmp_path_factory.mktemp("weighed")
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(2).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["lsh_precision_recall", "lsh_wide", "minhash_error_wide"])
def test_counts_equal_the_sql_and_no_copy_is_listed(spark, folder, name, monkeypatch):
    listed, old = [], dedup.lsh_candidates

    def candidates(*args):
        out = old(*args)
        listed.append(out.count())
        return out

    def pairs(*args):
        raise AssertionError("copies are listed pair by pair")

    monkeypatch.setattr(dedup, "lsh_candidates", candidates)
    monkeypatch.setattr(dedup, "expanded", pairs)
    got = sorted(map(tuple, catalogue.queries()[name](spark, folder).collect()))
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
        want = sorted(con.execute(catalogue.oracle_sql()[name]).fetchall())
    assert [tuple(map(pytest.approx, x)) for x in want] == got
    assert all(n < 150 for n in listed)  # 60 copies alone are 1770 pairs


def test_documents_of_ids_whatever_fits_a_broadcast(spark, monkeypatch):
    docs = spark.range(40).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "string(doc_id) text")
    for ids in ((1, 5), range(30), ()):
        part = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        for most in (100, 15, 0):
            monkeypatch.setattr(dedup, "BROADCAST_ROWS", most)
            assert sorted(r.doc_id for r in dedup.of_ids(docs, part, docs.select("doc_id")).collect()) == list(ids)
