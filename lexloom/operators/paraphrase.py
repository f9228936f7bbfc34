"""Paraphrases that keep what a text says: synonyms, fillers every few words and an opener, all fixed by a hash of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import md5_bucket, ws_words

#: Words and what stands for them, fillers, openers.
SYNONYMS = {"the": "this", "and": "plus", "of": "from", "is": "remains", "with": "alongside", "for": "toward", "was": "became", "that": "which", "his": "their", "all": "every", "said": "stated", "not": "hardly"}
FILLERS = ("of course", "in fact", "so to speak", "as it were", "by and large")
OPENERS = ("To begin with,", "As many have noted,", "It is often said that")
#: A filler stands after every 4th, 5th or 6th word of a text.
GAPS = (4, 5, 6)


def _pick(values: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def paraphrased(df: DataFrame, key: str, text: str = "text", out: str = "paraphrase") -> DataFrame:
    """key, out: the text's words in another dress; a text without words or null stays empty."""
    h = md5_bucket(F.col(key).cast("string"))
    pairs = [F.lit(x) for kv in SYNONYMS.items() for x in kv]
    known = F.create_map(*pairs)
    gap = F.element_at(F.array(*map(F.lit, GAPS)), (h % len(GAPS) + 1).cast("int"))
    same = lambda w: F.coalesce(F.try_element_at(known, F.lower(w)), w)
    each = F.transform(ws_words(F.coalesce(F.col(text), F.lit(""))), lambda w, i: F.when((i + 1) % gap == 0, F.array(same(w), _pick(FILLERS, h + F.floor(i / gap)))).otherwise(F.array(same(w))))
    body = F.array_join(F.flatten(each), " ")
    return df.select(key, F.when(body == "", "").otherwise(F.concat_ws(" ", _pick(OPENERS, h), body)).alias(out))
