"""Tokenizers measured on documents they never saw, and paraphrases and SQL rewards on odd rows."""

import random

from pyspark.sql import functions as F

from lexloom.operators import paraphrase, sql_rewards
from lexloom.plans.tokens import penalty


def test_penalty_of_an_unseen_language(spark):
    r = random.Random(1)
    made = {lang: ["".join(r.choice(letters) for _ in range(r.randrange(3, 7))) for _ in range(25)] for lang, letters in (("en", "etaoins"), ("xx", "çéñüøßå"))}
    rows = [(i, " ".join(r.choice(made[lang]) for _ in range(60)), lang) for i in range(60) for lang in ("en", "xx")] + [(99, "etao", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.lang: x for x in penalty(docs, F.col("doc_id") % 3 == 0, 300).collect()}
    assert got.keys() == {"en", "xx", None}
    assert got["en"].penalty <= 1.0 and got["xx"].penalty > 1.2 and got["xx"].english_fertility > 2 * got["en"].english_fertility


def test_paraphrase_of_odd_texts(spark):
    got = {r.k: r.p for r in paraphrase.paraphrased(spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "The"), (5, "a " * 40)], "k long, t string"), "k", "t", "p").collect()}
    assert got[1] == got[2] == got[3] == "" and got[4].endswith(" this")
    assert sum(got[5].count(f) for f in paraphrase.FILLERS) in (40 // 4, 40 // 5, 40 // 6)


def test_sql_rewards_run_nothing_but_queries(spark):
    t = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k long, v string")
    wanted = t.select("k", "v")
    ask = lambda sql: sql_rewards.reward(spark, f"so:\n```sql\n{sql}\n```", wanted, {"t": t})
    assert ask("select k, v from t") == ask("SELECT x.k, x.v FROM t AS x WHERE true ORDER BY 1") == ask("with u as (select * from t) select * from u") == sql_rewards.RIGHT
    assert ask("select distinct k, v from t") == ask("select k from t") == ask("select v, k from t") == sql_rewards.WRONG
    assert ask("select k, raise_error('x') v from t") == sql_rewards.NO_RUN
    assert ask("insert into t values (1, 'a')") == ask("select k from (") == sql_rewards.NO_PARSE
    assert ask("select z from t") == sql_rewards.NO_SUCH_NAME
    assert sql_rewards.reward(spark, "```sql\nselect 1\n```\n```sql\nselect 2\n```", wanted, {}) == sql_rewards.NO_QUERY
