"""Texts without words: filters that divide by a number of words leave them out, as DuckDB does."""

import duckdb
import pytest

from lexloom.plans import catalogue


@pytest.fixture
def folder(spark, tmp_path):
    texts = ["the words of the house and the end of it", "", " \n\t ", None, "123 !!! 45", "a b", "la casa de los que no es", "é", "ça et là"]
    rows = [(i, t, lang, "web", len(t or "")) for i, (t, lang) in enumerate((t, lang) for t in texts for lang in ("en", "es", "fr"))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["filter_mean_word_length", "langid_filter"])
def test_wordless_texts_are_left_out(spark, folder, name):
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
        want = con.execute(catalogue.oracle_sql()[name]).fetchall()
    assert want and sorted(map(tuple, catalogue.queries()[name](spark, folder).collect())) == sorted(want)
