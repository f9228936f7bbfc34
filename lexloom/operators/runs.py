"""The longest run of words that each benchmark item shares with a corpus, of any length.

A suffix automaton of all items is small (two states a word at most) and goes to
every task, which walks each document once: after each word the automaton is in
the state of the longest suffix that occurs in an item. A task keeps one length
and one document a state, so what it sends is a row an item, whatever it reads.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import words

#: Words of items in one automaton (some 500 bytes each); with more, items are dealt to several, each walked by all documents.
AUTOMATON_WORDS = 500_000


class Automaton:
    """States by number, 0 the empty run: transitions, suffix links, longest lengths, and the items a state's runs occur in."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.next, self.link, self.length = [{}], [-1], [0]
        for _, w in items:
            last = 0
            for x in w:
                last = self._extended(last, x)
        self.items: list[list[int]] = [[] for _ in self.next]
        for item, w in items:
            state = 0
            for x in w:
                at = state = self.next[state][x]
                while at > 0 and (not self.items[at] or self.items[at][-1] != item):
                    self.items[at].append(item)
                    at = self.link[at]

    def _state(self, length: int, link: int, following: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.next) - 1

    def _split(self, before: int, x: str) -> int:
        """The state of exactly the longest run of `before` and x; a state that also stands for longer runs is divided."""
        whole = self.next[before][x]
        if self.length[whole] == self.length[before] + 1:
            return whole
        part = self._state(self.length[before] + 1, self.link[whole], dict(self.next[whole]))
        self.link[whole] = part
        while before >= 0 and self.next[before].get(x) == whole:
            self.next[before][x] = part
            before = self.link[before]
        return part

    def _extended(self, last: int, x: str) -> int:
        if x in self.next[last]:  # another item has this run
            return self._split(last, x)
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and x not in self.next[last]:
            self.next[last][x] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, x)
        return new

    def walk(self, w: list[str], key: int, best: dict[int, tuple[int, int]]) -> None:
        """best: of each state met, the longest run and, negated, the smallest key that has it."""
        state = n = 0
        known = self.next[0]
        for x in w:
            if x not in known:
                state = n = 0
                continue
            while x not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            state, n = self.next[state][x], n + 1
            if (n, -key) > best.get(state, (0, 0)):
                best[state] = n, -key

    def by_item(self, best: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
        """The longest run and negated key of each item: a state's suffixes are in all items of its links."""
        out: dict[int, tuple[int, int]] = {}
        for state in sorted(best, key=self.length.__getitem__, reverse=True):
            n, key = best[state]
            at = state
            while at > 0:
                here = (min(n, self.length[at]), key)
                if at != state and best.get(at, (0, 0)) >= here:
                    break  # what is met there counts as much or more, and goes on to the links itself
                for item in self.items[at]:
                    if here > out.get(item, (0, 0)):
                        out[item] = here
                at = self.link[at]
        return out


def longest_runs(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", most_words: int = AUTOMATON_WORDS) -> DataFrame:
    """item, longest (words), key (the smallest document with such a run; null and 0 if no word is shared).

    Null texts have no words; documents without a key are left out.
    """
    known = items.select(F.col(item).alias("item"), F.coalesce(words(F.col(text)), F.array().cast("array<string>")).alias("w"))
    n = known.agg(F.sum(F.size("w")).alias("n")).first().n or 0
    parts = max(1, ceil(n / most_words))
    rows = docs.select(F.col(key).cast("long").alias("key"), words(F.col(text)).alias("w")).where(F.col("key").isNotNull() & (F.size("w") > 0))
    found = None
    for part in range(parts):
        some = [(r.item, r.w) for r in known.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect()]  # about `most_words` words
        shared = docs.sparkSession.sparkContext.broadcast(some)

        def run(batches, shared=shared):
            import pyarrow as pa

            automaton, best = Automaton(shared.value), {}
            for b in batches:
                for k, w in zip(b.column("key").to_pylist(), b.column("w"), strict=True):
                    automaton.walk(w.as_py(), k, best)
            out = [(i, n, -k) for i, (n, k) in automaton.by_item(best).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], ["item", "longest", "key"])

        met = rows.mapInArrow(run, "item long, longest long, key long")
        found = met if found is None else found.union(met)
    top = found.groupBy("item").agg(F.max(F.struct("longest", (-F.col("key")).alias("key"))).alias("m"))
    all_items = items.select(F.col(item).alias("item")).join(top, "item", "left")
    return all_items.select(F.col("item").alias(item), F.coalesce("m.longest", F.lit(0)).cast("long").alias("longest"), (-F.col("m.key")).alias(key))
