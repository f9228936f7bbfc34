"""Operator 5: personal data, base patterns joined by boosted trees over candidate spans.

High-recall generators propose overlapping spans (spelled-out addresses, phone
numbers without a plus, social security numbers, account numbers). Boosted
regression trees score each candidate from its format and the text around it;
a threshold for each kind, calibrated on held-out generated lines, selects.
Selected spans that touch a base span or a better selected span are dropped.
The trees are trained here, on lines generated from a fixed seed.

Defined results: null and empty texts have no spans; each input row gives one
output row; other columns are ignored. `redacted` replaces the spans of a text
by [KIND] marks.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from lexloom.llm.common import ROWS, frugal, map_batches

#: The base kinds in their order, then those that the trees add.
KINDS = ("email", "ip", "card", "phone", "spelled", "national", "ssn", "account")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is tried from its first digit alone: what fails there fails inside it, too.
# Patterns start with a set of characters and look back after it, so that the engine skips to those.
IP = re.compile(r"(?s)[0-9](?<![0-9].)[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT = re.compile("[0-9]").search

#: Generators: all starts are rare, so scanning is cheap.
SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:[\[({]\x20?(?i:at)\x20?[\])}]|\x20(?i:at)\x20(?=[A-Za-z0-9-]{1,63}\x20(?:(?i:dot)|[\[({])))\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[({]\x20?(?i:dot)\x20?[\])}]|\x20(?i:dot)\x20|\.)\x20?[A-Za-z0-9-]{2,63}){1,4}")
#: Digits in two to five groups, the first perhaps in brackets; and runs of nine to eleven digits.
GROUPED = re.compile(r"(?s)[(0-9](?<![0-9+].)(?:(?<=\()[0-9]{1,5}\)|(?<=[0-9])[0-9]{0,4})[\x20./-]{0,2}[0-9]{2,5}(?:[\x20./-][0-9]{2,8}){1,4}(?![0-9])")
PLAIN_RUN = re.compile(r"(?s)[0-9](?<![0-9+._/-].)[0-9]{8,10}(?![0-9])")
NATIONAL = re.compile(r"(?s)[(0-9](?<![0-9+].)(?:(?<=\()[0-9]{2,5}\)|(?<=[0-9])[0-9]{1,4})[\x20./-]{1,2}[0-9]{3,4}[\x20./-]?[0-9]{3,5}(?![0-9])")
SSN = re.compile(r"(?s)[0-9](?<![0-9-].)[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])")
ACCOUNT = re.compile(r"(?s)[A-Z](?<![A-Za-z0-9].)[A-Z][0-9]{2}\x20?(?:[A-Z0-9]{4}\x20?){2,7}[A-Z0-9]{1,4}(?![A-Za-z0-9])")
GENERATORS = ((5, NATIONAL), (5, GROUPED), (5, PLAIN_RUN), (6, SSN), (7, ACCOUNT))
CUES = (
    r"phone|tel|tél|telephone|téléphone|telefono?|call|calls|appelez|mobile?|cell|cellphone|handy|fax|contact|text|sms|whatsapp|dial|ring|reach|reached|reachable|landline|hotline|number", r"ssn?|social|security|tax|taxpayer", r"iban|account|bank|transfer", r"e-?mail|mail|write|reach|contact|send",
    r"order|invoice|version|page|isbn|part|serial|date|id|ref|reference|item|case|table|model|series|parcel|tracking|catalogue|population|matrix|lottery|score|time|sum|build|between|released|series|article|lot|batch|figure",
)
NEAR = 32


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str):
    end = 0
    for m in DOMAIN.finditer(text):
        s = m.start()
        while s > end and text[s - 1] in LOCAL:
            s -= 1
        if s < m.start():
            end = m.end()
            yield s, end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), in order."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if not DIGIT(text):
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    out = [(k, m.start(), m.end()) for k, p in GENERATORS for m in p.finditer(text)] if DIGIT(text) else []
    if any(d in text for d in ("dot", "DOT", "Dot")) or any(a in text for a in ("(at)", "[at]", "{at}", "(AT)", "[AT]", "{AT}")):
        for at in re.finditer(r"[\[({\x20]\x20?(?i:at)[\])}\x20]", text):  # the pattern runs only around this mark
            lo = max(0, at.start() - 66)
            out += [(4, lo + m.start(), lo + m.end()) for m in SPELLED.finditer(text[lo : at.end() + 330]) if lo + m.start() < at.start() < lo + m.end()]
    return sorted(set(out))


CUE_PATTERNS = [re.compile(rf"\b(?:{c})\b", re.I) for c in CUES]


def described(text: str, kind: int, s: int, e: int) -> list[float]:
    """Format and context of one candidate."""
    t, before, after = text[s:e], text[max(0, s - NEAR) : s], text[e : e + NEAR]
    digits = re.sub("[^0-9]", "", t)
    groups = re.findall("[0-9]+", t)
    sizes = [len(g) for g in groups] + [0] * 4
    return [
        kind, len(t), len(digits), len(groups), *sizes[:4], t.count("-"), t.count("."), t.count(" "), t.count("("), t.count("/"),
        float(luhn(digits)) if digits else 0.0, *(float(bool(p.search(before))) for p in CUE_PATTERNS), float(before[-1:] in ("#", "$", "€", "/", "v", "_", "=")),
        float(after[:1] != "" and after[0] in "-./ " and after[1:2].isdigit()), float(before[-1:] != "" and before[-1] in "-./ " and before[-2:-1].isdigit()), float(len(groups) == 1), float(t[:1] == "0" or t[:2] == "(0"), float(min(map(len, groups), default=0)), float(max(map(len, groups), default=0)), float(sum(bool(p.search(before[-12:])) for p in CUE_PATTERNS[:1])), float(bool(CUE_PATTERNS[4].search(before[-14:]))), float(bool(re.search("[A-Z]", t))),
        float(after[:1] in ("%", "/", "-", "_")), float(before[-2:-1] == ":" or before[-1:] == ":"), float(digits[:2] in ("19", "20")), float(t.count("[") + t.count("{") > 0), float(t.lower().count("dot")),
    ]


class Trees:
    """Gradient boosting of depth-two trees on the logistic loss, with exact splits."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.3):
        self.base, self.rate, self.trees = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), rate, []
        score = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self.grow(x, y - p, p * (1 - p), np.ones(len(y), bool), 2)
            self.trees.append(tree)
            score += rate * np.array([self.leaf(tree, r) for r in x])

    @staticmethod
    def grow(x, g, h, rows, depth):
        value = float(g[rows].sum() / (h[rows].sum() + 1.0))
        if depth == 0 or rows.sum() < 10:
            return value
        best = (1e-6, None, None)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[1:]:
                a = rows & (x[:, f] < cut)
                b = rows & ~(x[:, f] < cut)
                gain = g[a].sum() ** 2 / (h[a].sum() + 1.0) + g[b].sum() ** 2 / (h[b].sum() + 1.0) - whole
                if gain > best[0]:
                    best = (gain, f, float(cut))
        if best[1] is None:
            return value
        left = rows & (x[:, best[1]] < best[2])
        return (best[1], best[2], Trees.grow(x, g, h, left, depth - 1), Trees.grow(x, g, h, rows & ~left, depth - 1))

    @staticmethod
    def leaf(tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
        return tree

    def score(self, row) -> float:
        return self.base + self.rate * sum(self.leaf(t, row) for t in self.trees)


def examples(seed: int, n: int):
    """Generated lines: (text, spans of personal data beyond the base kinds)."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdeghilmnoprstu") for _ in range(r.randint(2, 9)))
    prose = lambda: " ".join(word() + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(2, 7)))
    at = lambda: r.choice([(" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."), ("(at)", ".")])

    bank = lambda: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(4))

    def spelled():
        a, dot = at()
        upper = r.random() < 0.3
        a, dot = (a.upper(), dot.upper()) if upper else (a, dot)
        return f"{word()}{r.choice(['', '.' + word(), '_' + word()])}{a}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'co' + dot + 'uk'])}"

    def number():
        """A phone number in groups, in a national style, or as one run."""
        return r.choice([
            f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)} {d(7)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(4)} {d(6)}", f"0{d(2)}/{d(7)}", f"0{d(3)}/{d(6)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}-{d(2)}-{d(2)}-{d(2)}-{d(2)}",
            f"{d(10)}", f"0{d(9)}", f"0{d(10)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"0{d(3)} {d(3)} {d(3)}", f"{d(3)} {d(3)} {d(4)}", f"0{d(2)}-{d(4)}-{d(4)}", f"0{d(2)} {d(3)} {d(2)} {d(2)}", f"(0{d(2)}) {d(6)}", f"(0{d(3)}) {d(5)}-{d(2)}", f"({d(3)}){d(3)}-{d(4)}", f"{d(5)} {d(5)}", f"{d(4)} {d(3)} {d(3)}", f"0{d(3)} {d(4)}-{d(4)}", f"{d(2)} {d(3)} {d(2)} {d(2)}", f"0{d(3)}-{d(7)}", f"{d(2)}-{d(4)}-{d(4)}",
        ])

    good = [
        lambda: (r.choice(["write to ", "mail ", "reach me at ", "email: ", ""]), spelled()), *[lambda: (r.choice(["call ", "phone: ", "tel ", "mobile ", "contact ", "my number is ", "cell ", "call me on ", "text ", "fax: ", "Tel. ", "dial ", "reach me at ", "the phone is ", "hotline ", "Telefon ", "sms to ", "mobile:"]), number())] * 4,
        lambda: (r.choice(["ssn ", "social security ", "tax ", "SSN: ", "ss ", "SS# ", "her ssn is ", "social security number "]), f"{d(3)}-{d(2)}-{d(4)}"), lambda: (r.choice(["iban ", "account ", "bank: ", ""]), r.choice([r.choice(["DE", "FR", "GB"]) + f"{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", r.choice(["DE", "NL"]) + d(20), f"GB{d(2)}{bank()}{d(14)}", f"NL{d(2)} {bank()} {d(4)} {d(4)} {d(2)}"])),
    ]
    bad = [
        lambda: f"20{d(2)}-{d(3)}-{d(4)}", lambda: f"order {d(3)}-{d(3)}-{d(4)}", lambda: f"ISBN {d(3)}-{d(3)}-{d(4)}", lambda: f"page {d(3)} {d(3)} {d(3)}", lambda: f"part {d(3)}-{d(2)}-{d(4)}", lambda: f"{d(2)}.{d(3)}.{d(3)}",
        lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"{r.choice(['serial', 'part', 'code', 'lot'])} {bank()[:2]}{d(2)}{r.choice(['', ' '])}{d(4)}{r.choice(['', ' '])}{d(4)}{r.choice(['', ' '])}{d(2)}", lambda: f"version {d(2)}.{d(3)}.{d(3)}", lambda: f"{word()} at {word()} dot {word()} {word()}", lambda: f"invoice {d(4)}/{d(3)}{d(3)}", lambda: f"{d(16)}",
        *[lambda: r.choice(["order ", "invoice ", "item ", "ref ", "serial ", "batch ", "", "", "the ", "sum ", "id ", "lot ", "figure ", "article "]) + number()] * 4, lambda: f"{d(1)} {d(3)} {d(3)} {word()}", lambda: f"{d(10)} {word()}", lambda: f"{d(2)}-{d(2)} {d(2)}-{d(2)}", lambda: f"20{d(2)}-20{d(2)} and 19{d(2)}-20{d(2)}", lambda: f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"{d(2)}.{d(1)}.{d(5)}.{d(4)}", lambda: f"{d(2)}.{d(4)} {d(1)}.{d(4)}", lambda: f"0{d(1)}.0{d(1)}.20{d(2)} {word()}", lambda: f"{word()} at {word()} dot",
    ]
    for _ in range(n):
        head, tail = prose() + " ", " " + prose()
        if r.random() < 0.5:
            cue, v = r.choice(good)()
            yield head + cue + v + tail, [(len(head + cue), len(head + cue + v))]
        else:
            yield head + r.choice(bad)() + tail, []


@lru_cache(maxsize=1)
def trained(seed: int = 5, n: int = 6000, precision: float = 0.97) -> tuple[Trees, dict[int, float]]:
    """The trees and, for each kind, the lowest score, of one half at least as a probability, at which held-out candidates reach the precision."""
    rows = [(i, described(t, k, s, e), (s, e) in gold) for i, (t, gold) in enumerate(examples(seed, n)) for k, s, e in candidates(t)]
    fit = [x for x in rows if x[0] % 3]
    trees = Trees(np.array([x for _, x, _ in fit]), np.array([y for *_, y in fit], float))
    at: dict[int, float] = {}
    for kind in range(4, len(KINDS)):
        held = sorted(((trees.score(x), y) for i, x, y in rows if i % 3 == 0 and x[0] == kind), reverse=True)
        right, at[kind] = 0, float("inf")
        for n_, (score, y) in enumerate(held, 1):
            right += y
            if right >= precision * n_ and (n_ == len(held) or held[n_][0] < score):
                at[kind] = max(score, 0.0)
    return trees, at


def added_spans(text: str, base: list, model: tuple[Trees, dict[int, float]]) -> list[tuple[int, int, int]]:
    found = candidates(text)
    if not found:
        return []
    trees, at = model
    scored = sorted((-v, k, s, e) for k, s, e in found if (v := trees.score(described(text, k, s, e))) >= at[k])
    taken = sorted((s, e) for _, s, e in base)
    out = []
    for _, k, s, e in scored:
        if all(e <= a or b <= s for a, b in taken):
            taken.append((s, e))
            out.append((k, s, e))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or union of overlapping spans, replaced by the mark of its first kind."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], x[0])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def all_spans(text: str, model) -> tuple[list, list]:
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base, model))


def personal(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    sent = df.sparkSession.sparkContext.broadcast(trained())

    def scan(rows: dict) -> dict:
        found = [all_spans(t or "", sent.value) for t in rows["text"]]
        count = lambda k: [sum(x[0] == k for x in base) for base, _ in found]
        return {
            key: rows[key], **{f"n_{KINDS[k]}": count(k) for k in range(4)}, "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found],
            "spans": [joined(a) for _, a in found], "n_added": [len(a) - len(b) for b, a in found],
        }

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(key, df[text].alias("text")), scan, f"{key} {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(df: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """All columns of the input, personal data in `text` replaced by marks and `length` brought up to date; the other columns pass as they are."""
    sent, names = df.sparkSession.sparkContext.broadcast(trained()), df.columns
    at, of = names.index(text), names.index(length) if length in names else None

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                b = whole.slice(first, ROWS)
                columns = list(b.columns)
                changed = [t and redacted(t, all_spans(t, sent.value)[1]) for t in columns[at].to_pylist()]
                columns[at] = pa.array(changed, columns[at].type)
                if of is not None:
                    columns[of] = pa.array([None if t is None else len(t) for t in changed], columns[of].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(frugal(run), df.schema)
