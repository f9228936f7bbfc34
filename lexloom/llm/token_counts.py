"""Operator 1: exact token counts by heap-and-linked-list byte-pair merging.

A word is a doubly linked list of symbols; a heap holds the ranks of adjacent
pairs. The lowest rank (leftmost on ties) is merged until no ranked pair is
left. Only counts come out: initial symbols minus merges. No identifier is
built, so the merge table is all that is needed beside the pre-tokeniser.

Defined results: null and empty texts have 0 bytes and 0 tokens; every input
row gives one output row, repeated rows included; other input columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import regex
from pyspark.sql import DataFrame

from lexloom.llm.common import map_batches

#: Words whose counts one Python worker remembers.
CACHE = 300_000
#: A tokenizer file larger than this is not broadcast but refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: The final sigma is the only lower-casing that looks at neighbours; the tokenizer's is by character.
SIGMA = "Σ"
#: Two letters of Unicode 16 and their lower case, which the library knows and `str.lower` does not yet.
LATER_LETTERS = {0xA7CB: 0x264, 0xA7DC: 0x19B}
#: What a code point without a class of its own is cut as.
OTHER = "\U0010fffd"


def later_letters(split) -> frozenset[str]:
    """Letters and numbers of the pattern engine that are not yet assigned for the library, by its own `split`: 'a' and such a character are two words to it.

    Only code points that are unassigned for Python can be among them.
    """
    unassigned = "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn")
    return frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", unassigned) if len(split("a" + c)) != len(split("ab")) and len(split("!" + c)) == 1)


def any_of(chars) -> re.Pattern:
    """A search for any of some characters, as ranges."""
    spans: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if spans and c == spans[-1][1] + 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in spans) + "]")


def byte_symbols() -> list[str]:
    """The printable character of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Counter:
    """Counts tokens as the tokenizer file's library does, special strings in a text included."""

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        j = json.loads(spec)
        model, norm, pre = j["model"], j["normalizer"]["normalizers"], j["pre_tokenizer"]["pretokenizers"]
        if [x["type"] for x in norm] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in pre] != ["Split", "ByteLevel"] or model["type"] != "BPE" or model["dropout"] or pre[1]["use_regex"] or pre[1]["add_prefix_space"]:
            raise ValueError("this tokenizer file's normaliser or pre-tokeniser is of a kind that is not supported")
        self.suffix = model["end_of_word_suffix"] or ""
        self.symbols = byte_symbols()
        # symbols are numbered as they appear; merges maps a pair of numbers to (rank, number of the union)
        self.ids: dict[str, int] = {}
        number = lambda s: self.ids.setdefault(s, len(self.ids))
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[number(a), number(b)] = (rank, number(a + b))
        self.first = [number(s) for s in self.symbols]
        self.last = [number(s + self.suffix) for s in self.symbols]
        space = r"\p{White_Space}"
        pattern = regex.compile(pre[0]["pattern"]["Regex"].replace(r"[^\s", f"[^{space}"))
        self.words, self.places = pattern.findall, pattern.finditer
        later = later_letters(Tokenizer.from_str(spec.decode()).pre_tokenizer.pre_tokenize_str)
        self.rare, self.as_other = any_of({*later, *map(chr, LATER_LETTERS)}).search, dict.fromkeys(map(ord, later), OTHER)
        specials = sorted((x["content"] for x in j["added_tokens"]), key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, specials)) or "(?!)")
        self.mark = [s[:2] for s in specials]
        self.cache: dict[str, int] = {}

    def rare_words(self, text: str) -> list[str]:
        """Words of a text with characters that the two engines class otherwise."""
        plain = text.translate(self.as_other)
        return [text[m.start() : m.end()] for m in self.places(plain)]

    def word(self, word: str) -> int:
        """Tokens of one pre-token: symbols minus merges."""
        raw = word.encode("utf-8", "surrogatepass")
        symbol = [self.first[b] for b in raw]
        symbol[-1] = self.last[raw[-1]]
        n = left = len(symbol)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        merges = self.merges
        heap = [(m[0], i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (m := merges.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue  # one side has been merged since
            symbol[i], symbol[j] = merges[a, b][1], -1
            left -= 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((symbol[i], symbol[k])):
                    heapq.heappush(heap, (m[0], i, symbol[i], symbol[k]))
            if (h := before[i]) >= 0 and (m := merges.get((symbol[h], symbol[i]))):
                heapq.heappush(heap, (m[0], h, symbol[h], symbol[i]))
        return left

    def plain(self, text: str) -> int:
        rare = None
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            rare = self.rare(text)
        text = text.lower() if SIGMA not in text else "".join(map(str.lower, text))
        if rare:
            text = text.translate(LATER_LETTERS)
        cache, total = self.cache, 0
        for w in self.rare_words(text) if rare else self.words(text):
            c = cache.get(w)
            if c is None:
                c = self.word(w)
                if len(w) <= 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[w] = c
            total += c
        return total

    def count(self, text: str) -> int:
        if not any(m in text for m in self.mark):
            return self.plain(text)
        at = total = 0
        for m in self.specials.finditer(text):
            total += self.plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self.plain(text[at:])


#: A worker process builds a counter once for each tokenizer file, known by its digest.
_counters: dict[str, Counter] = {}


def token_counts(df: DataFrame, tokenizer_file: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for each row."""
    with open(tokenizer_file, "rb") as f:
        spec = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(spec) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{tokenizer_file} is over {MAX_VOCABULARY_BYTES} bytes")
    sent, digest = df.sparkSession.sparkContext.broadcast(spec), hashlib.sha256(spec).hexdigest()

    def count(rows: dict) -> dict:
        counter = _counters.get(digest) or _counters.setdefault(digest, Counter(sent.value))
        texts = [t or "" for t in rows["text"]]
        n = [counter.count(t) for t in texts]
        return {key: rows[key], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(key, df[text].alias("text")), count, f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean")
