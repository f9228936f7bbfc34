"""Operator 3: secret scans, base patterns joined by a linear-chain conditional random field.

The text is cut into value tokens (runs of letters, digits and +/_.- with the
'=' that pad their end) and single other characters; so `name=value` is three. Tokens are tagged outside, begin or inside from their
shape, the tokens around them and features of the whole file, and decoded by
Viterbi. Tags have a hard part: only tokens of 8 characters or more that have a
digit, are as long as LONG, stand among the CUE_REACH tokens after a cue word or in
the credentials of a URL may begin or continue a secret, and a secret continues
only over one joining character. So the chain falls into independent pieces around
such tokens, and decoding these pieces alone equals decoding the whole text
(`whole_text` lays out that chain; tests compare the two).

The field is trained here on generated lines (a fixed seed; keys, headers and
connection strings against dates, versions, links, order numbers and prose).
Base spans always stay; a field span is added unless it lies inside one.

Defined results: null and empty texts have no spans; each input row gives one
output row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame

from lexloom.llm.common import map_batches

#: The base patterns, their kinds in the order of ties, and the least lengths.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # the maximal run decides, so a bound in the pattern equals a check after it
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN = 12
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

PADDING = r"(?:=+(?![A-Za-z0-9+/_.=\-]))?"
TOKEN = re.compile(r"[A-Za-z0-9+/_.\-]+" + PADDING + r"|[^\sA-Za-z0-9+/_.\-]")
DIGIT_RUN = re.compile(r"[0-9][A-Za-z0-9+/_.\-]*" + PADDING)
VALUE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-")
MIN_TOKEN, LONG = 8, 20
LONG_RUN = re.compile(r"[A-Za-z0-9+/_.\-]{20,}" + PADDING)
#: A password between a URL's user name and host.
IN_URL = re.compile(r"(?<=://)[A-Za-z0-9_.%\-]*:([A-Za-z0-9+/_.\-]{8,}" + PADDING + ")(?=@)")
#: Tokens that the features look back or ahead.
REACH = 3
#: Tokens after a cue word that need no digit: `key => "` alone is three.
CUE_REACH = 5
CUES = frozenset("password passwd pass passphrase pwd secret token key apikey api_key auth authorization bearer basic credential credentials private access accesskey accountkey client_secret signature sas".split())
CUE_PARTS = ("secret", "token", "passw", "passphrase", "pwd", "api_key", "apikey", "api-key", "access_key", "accesskey", "accountkey", "private_key", "credential")
#: What every cue word holds.
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "basic", "credential", "private", "access", "signature", "sas")
CUE_HINT = re.compile(f"(?ai:{'|'.join(HINTS)})")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGN]
    return sorted(out)


def shape(t: str) -> str:
    """Runs of one class of characters as one letter."""
    return re.sub(r"(.)\1+", r"\1", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", t))).replace("9", "0"))


def described(t: str) -> list[str]:
    """Features of a token itself."""
    n = len(t)
    share = sum(c.isdigit() for c in t) / n
    bits = -sum(k / n * math.log2(k / n) for k in map(t.count, set(t)))
    s = shape(t)
    letters = [c for c in t.lower() if c.isalpha()]
    vowels = sum(c in "aeiouy" for c in letters) / max(1, len(letters))
    return [
        f"len{min(n.bit_length(), 8)}", f"digits{int(share * 5)}", f"bits{int(min(bits, 5.9))}", f"turns{min(len(s), 12) // 2}",
        f"case{int(any(map(str.isupper, t)))}{int(any(map(str.islower, t)))}", f"dots{min(t.count('.'), 3)}", f"dash{min(t.count('-'), 3)}", f"slash{min(t.count('/'), 2)}",
        f"start:{s[:2]}", f"vowels{int(vowels * 5)}", f"mixed{min(int(6 * len(s) / n), 5)}", f"mixed{min(int(6 * len(s) / n), 5)}:len{min(n.bit_length(), 8)}", f"zero{int(t[0] == '0')}",
        f"bits{int(min(bits, 5.9))}:case{int(any(map(str.isupper, t)))}{int(any(map(str.islower, t)))}{int(any(map(str.isdigit, t)))}",
    ]


def is_cue(t: str) -> bool:
    low = t.strip(".=").lower()
    return low in CUES or any(c in low for c in CUE_PARTS)


def neighbour(side: str, t: str) -> str:
    return f"{side}:" + ("cue" if is_cue(t) else t if len(t) == 1 and not t.isalnum() else shape(t)[:3])


def words_near(t: list[str], i: int) -> list[str]:
    """The neighbouring words themselves, and whether a cue is among those before."""
    near = [f"n{d}:{t[i + d].strip('.').lower()[:16]}" for d in (-3, -2, -1, 1) if 0 <= i + d < len(t) and not any(map(str.isdigit, t[i + d]))]
    return [*near, f"cued{int(any(map(is_cue, t[max(0, i - REACH) : i])))}"]


def file_features(text: str) -> list[str]:
    """Features of the whole file, from counts of a few characters."""
    n = len(text) + 1
    code, assigns = sum(map(text.count, "{};()")), text.count("=") + text.count(":")
    return [f"code{min(int(200 * code / n), 4)}", f"assigns{min(int(200 * assigns / n), 4)}"]


def after_cues(text: str) -> list[tuple[int, int]]:
    """Tokens of MIN_TOKEN characters or more among the CUE_REACH tokens after a cue word."""
    found, end, low = set(), 0, text.lower()
    if not any(h in low for h in HINTS):
        return []
    for m in CUE_HINT.finditer(text):
        if m.start() < end:
            continue
        s = m.start()
        while s > end and text[s - 1] in VALUE:
            s -= 1
        end = TOKEN.match(text, s).end()
        if is_cue(text[s:end]):
            found.update(t.span() for t in islice(TOKEN.finditer(text, end), CUE_REACH) if len(t[0]) >= MIN_TOKEN)
    return sorted(found)


def eligible(text: str) -> list[tuple[int, int]]:
    """The tokens that may be tagged, in order."""
    found, end = set(after_cues(text)), 0
    for m in DIGIT_RUN.finditer(text):
        s = m.start()
        while s > end and text[s - 1] in VALUE:
            s -= 1
        if m.end() - s >= MIN_TOKEN:
            found.add((s, m.end()))
        end = m.end()
    found.update(m.span() for m in LONG_RUN.finditer(text))
    if "://" in text:
        found.update(m.span(1) for m in IN_URL.finditer(text))
    return sorted(found)


def before(text: str, s: int) -> list[tuple[int, int]]:
    """The REACH tokens before the token that starts at s."""
    out: list[tuple[int, int]] = []
    while s > 0 and len(out) < REACH:
        if text[s - 1].isspace():
            s -= 1
            continue
        a = after = s
        while a > 0 and text[a - 1] == "=":
            a -= 1
        while after < len(text) and text[after] == "=":
            after += 1
        if a < s and not (a > 0 and text[a - 1] in VALUE and (after == len(text) or text[after] not in VALUE)):
            a = s - 1  # '=' that pads no value is a token of its own
        elif text[a - 1] in VALUE:
            while a > 0 and text[a - 1] in VALUE:
                a -= 1
        else:
            a = s - 1
        out.append((a, s))
        s = a
    return out[::-1]


def pieces(text: str) -> list[list[tuple[int, int, bool]]]:
    """Windows of (start, end, eligible) tokens, one around each chain of eligible tokens."""
    chains: list[list[tuple[int, int]]] = []
    for s, e in eligible(text):  # one joining character: the next token may continue this secret
        if chains and s - chains[-1][-1][1] == 1 and not text[s - 1].isspace():
            chains[-1].append((s, e))
        else:
            chains.append([(s, e)])
    out = []
    for chain in chains:
        s, e = chain[0][0], chain[-1][1]
        inner = []
        for k, (a, b) in enumerate(chain):
            if k:
                inner.append((a - 1, a, False))
            inner.append((a, b, True))
        ends = [(*m.span(), False) for m in islice(TOKEN.finditer(text, e), REACH)]
        out.append([(*x, False) for x in before(text, s)] + inner + ends)
    return out


def whole_text(text: str) -> list[tuple[int, int, bool]]:
    """All tokens of a text as one chain: what `pieces` cuts to the parts that can be tagged."""
    some = set(eligible(text))
    return [(*m.span(), m.span() in some) for m in TOKEN.finditer(text)]


def observed(text: str, tokens: list[tuple[int, int, bool]], whole: list[str]) -> list[list[str]]:
    """The features of each token of a piece; tokens that cannot be tagged have none."""
    t = [text[a:b] for a, b, _ in tokens]
    at = lambda i, side: neighbour(side, t[i]) if 0 <= i < len(t) else f"{side}:edge"
    return [
        [*described(t[i]), *(at(i + d, f"w{d}") for d in (-3, -2, -1, 1, 2)), *words_near(t, i), *whole, "any"] if ok else []
        for i, (_, _, ok) in enumerate(tokens)
    ]


#: Tags: outside, begin, inside. A secret goes on over one joining character, which is tagged inside too.
O, B, I = range(3)  # noqa: E741


def allowed(tokens: list[tuple[int, int, bool]]) -> np.ndarray:
    """Log mask (token, tag)."""
    mask = np.full((len(tokens), 3), -np.inf)
    mask[:, O] = 0
    for i, (_, _, ok) in enumerate(tokens):
        if ok:
            mask[i, [B, I]] = 0
        elif 0 < i < len(tokens) - 1 and tokens[i - 1][2] and tokens[i + 1][2] and tokens[i - 1][1] + 1 == tokens[i + 1][0]:
            mask[i, I] = 0
    return mask


def gaps(tokens: list[tuple[int, int, bool]]) -> list[bool]:
    """Whether a blank is before each token."""
    return [k > 0 and tokens[k - 1][1] < s for k, (s, _, _) in enumerate(tokens)]


class Field:
    """Weights of a linear-chain conditional random field. A blank ends a secret, so after one the chain goes on as from outside."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        self.moves = np.zeros((4, 3))  # from outside, begin, inside, the start

    def scores(self, seen: list[list[str]], mask: np.ndarray) -> np.ndarray:
        e = mask.copy()
        for i, fs in enumerate(seen):
            for f in fs:
                if (w := self.weights.get(f)) is not None:
                    e[i] += w
        return e

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the moves within a word and after a blank, and of the start."""
        m = self.moves.copy()
        m[O, I] = m[3, I] = -np.inf
        return np.stack([m[:3], np.tile(m[O], (3, 1))]), m[3]

    def decode(self, seen: list[list[str]], mask: np.ndarray, blank: list[bool]) -> list[int]:
        """Viterbi; ties go to the earlier tag."""
        e, (m, start) = self.scores(seen, mask), self.steps()
        best, back = start + e[0], []
        for x, gap in zip(e[1:], blank[1:], strict=True):
            all_ = best[:, None] + m[int(gap)]
            back.append(all_.argmax(0))
            best = all_.max(0) + x
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def learn(self, seen, mask, blank, gold, rate: float, squares: dict, penalty: float) -> None:
        """One step of adaptive gradient ascent on the log likelihood, by forward-backward."""
        e, (m, start), n = self.scores(seen, mask), self.steps(), len(seen)
        lse = lambda a, axis: np.logaddexp.reduce(a, axis)
        with np.errstate(invalid="ignore"):
            f, b = np.empty((n, 3)), np.zeros((n, 3))
            f[0] = start + e[0]
            for i in range(1, n):
                f[i] = lse(f[i - 1][:, None] + m[int(blank[i])], 0) + e[i]
            for i in range(n - 2, -1, -1):
                b[i] = lse(m[int(blank[i + 1])] + (e[i + 1] + b[i + 1])[None], 1)
            z = lse(f[-1], 0)
            p = np.exp(f + b - z)
        grads: dict = {}
        for i, fs in enumerate(seen):
            d = -p[i]
            d[gold[i]] += 1
            for x in fs:
                grads[x] = grads.get(x, 0) + d
        move = np.zeros((4, 3))
        move[3] -= p[0]
        move[3, gold[0]] += 1
        for i in range(1, n):
            q = np.exp(f[i - 1][:, None] + m[int(blank[i])] + (e[i] + b[i])[None] - z)
            if blank[i]:
                move[O] -= q.sum(0)
                move[O, gold[i]] += 1
            else:
                move[:3] -= q
                move[gold[i - 1], gold[i]] += 1
        for x, g in [*grads.items(), (None, move)]:
            w = self.moves if x is None else self.weights.setdefault(x, np.zeros(3))
            g = g - penalty * w
            squares[x] = squares.get(x, 1e-2) + g * g
            w += rate * g / np.sqrt(squares[x])


def examples(seed: int, n: int):
    """Generated lines: (text, spans of secrets)."""
    r = random.Random(seed)
    hexes, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    run = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: run("abcdeghilmnoprstu", r.randint(2, 9))
    digits = lambda k: run("0123456789", k)
    prose = lambda: " ".join(word() + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(2, 7)))
    value = lambda: r.choice([lambda: run(base, r.randint(20, 44)) + digits(1), lambda: run(hexes, r.choice([32, 40, 64])), lambda: digits(1) + run(base + "+/", 39) + "=", lambda: "sk_live_" + run(base, 24) + digits(1), lambda: "ghp_" + run(base, 35) + digits(1), lambda: run(base, 10) + digits(2) + "-" + run(base, 12), lambda: f"{word()}-{digits(12)}-{run(base, 20)}"])()
    secret = [
        lambda v: ("Authorization: Bearer ", v), lambda v: ("client_secret = '", v), lambda v: ("private key: ", v), lambda v: ("export AWS_SECRET_ACCESS_KEY=", v),
        lambda v: ("auth_token \"", v), lambda v: ("credential ", v), lambda v: ("signature=", v), lambda v: (f"postgres://{word()}:", v), lambda v: ("key => \"", v),
    ]
    plain = [
        lambda: f"20{digits(2)}-0{r.randint(1, 9)}-1{digits(1)}", lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}-beta{digits(1)}", lambda: f"https://www.{word()}.com/{word()}/{digits(6)}/{word()}-{word()}-{digits(3)}.html",
        lambda: f"{word()}{digits(2)}@{word()}.example.com", lambda: f"order {digits(10)}", lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(16)}", lambda: f"{digits(3)}.{digits(2)}.{digits(3)}.{digits(2)}",
        lambda: f"{word()}_{word()}_{digits(2)}", lambda: f"ISBN 978-{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}", lambda: f"{word().title()}{word().title()}{digits(2)}", lambda: f"page{digits(5)}.{word()}", lambda: f"key {word()}-{digits(4)}-{word()}",
    ]
    for _ in range(n):
        left, right = r.choice([prose(), prose(), ""]), r.choice([prose(), prose(), ""])
        if r.random() < 0.5:
            cue, v = r.choice(secret)(value())
            head = f"{left} {cue}"
            text = head + v + r.choice(["", '"', "'", "@db.local", ";"]) + " " + right
            yield text, [(len(head), len(head) + len(v))]
        else:
            yield f"{left} {r.choice(plain)()} {right}", []


def digitless_examples(seed: int, n: int):
    """Generated lines with a cue word: (text, spans of secrets), all values without a digit."""
    r = random.Random(seed)
    small, letters = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    run = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda a=2, b=9: run("abcdeghilmnoprstu", r.randint(a, b))
    prose = lambda: " ".join(word() + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(2, 7)))
    blocks = lambda parts: "".join(run(r.choice(parts), r.randint(2, 9)) for _ in range(r.randint(4, 6)))
    value = lambda: r.choice([lambda: blocks((small, small.upper())), lambda: blocks((small, small.upper(), "0123456789")), lambda: run(letters, r.randint(18, 44)), lambda: run(letters + "+/", 39) + "=", lambda: "sk_live_" + run(letters, 24), lambda: "ghp_" + run(letters, 36), lambda: run(letters, 12) + "-" + run(letters, 12), lambda: run(small.upper(), r.randint(20, 32)), lambda: run(small, r.randint(22, 36))])()
    url = lambda: f"{r.choice(['postgres', 'mysql', 'amqp', 'https'])}://{word()}:"
    cues = ["Authorization: Bearer ", "client_secret = '", "private key: ", "export AWS_SECRET_ACCESS_KEY=", "auth_token \"", "credential ", "signature=", "key => \"", "token=", "password: "]
    long = [lambda: f"https://www.{word()}.com/{word(4)}/{word(4)}-{word(4)}-{word()}", lambda: f"/usr/{word(4)}/{word(5)}/{word(5)}/{word(4)}.{run(small, 3)}", lambda: f"org.{word(4)}.{word(4)}.{word(5).title()}{word(5).title()}", lambda: "-".join(word(4) for _ in range(4)), lambda: "_".join(word(4) for _ in range(4)), lambda: r.choice([word(3), ""]) + "".join(word(4).title() for _ in range(r.randint(3, 6)))]
    plain = [lambda: word(8, 14), lambda: word(8, 14).title(), lambda: f"{word(4)}_{word(4)}_{word()}", lambda: f"{word(4)}{word(4).title()}()", lambda: f"{word(4)}-{word(4)}", lambda: word(8, 12).upper(), lambda: f"{word(3)}/{word(4)}/{word(3)}.{run(small, 3)}"]
    for _ in range(n):
        left, right = r.choice([prose(), prose(), ""]), r.choice([prose(), prose(), ""])
        kind = r.random()
        if kind < 0.1:
            head, v = f"{left} {url()}", value()
            yield f"{head}{v}@{word()}.local {right}", [(len(head), len(head) + len(v))]
        elif kind < 0.45:
            head, v = f"{left} {r.choice(cues)}", value()
            yield head + v + r.choice(["", '"', "'", ";"]) + " " + right, [(len(head), len(head) + len(v))]
        elif kind < 0.7:
            yield f"{left} {r.choice(long)()} {right}", []
        else:
            yield f"{left} {r.choice([*cues, 'secret ', 'access ', 'the token ', 'key '])}{r.choice(plain + long)()} {right}", []


def formatted_examples(seed: int, n: int):
    """Generated lines of settings, commands and connection strings against names, paths and numbers that look alike: (text, spans of secrets)."""
    r = random.Random(seed)
    small = "abcdefghijklmnopqrstuvwxyz"
    base, web, numerals = small + small.upper() + "0123456789", small + small.upper() + "0123456789-_", "0123456789"
    run = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda a=2, b=9: run("abcdeghilmnoprstu", r.randint(a, b))
    prose = lambda: " ".join(word() + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(2, 7)))
    leet = lambda x: "".join({"a": "4", "e": "3", "i": "1", "o": "0", "s": "5"}.get(c, c) if r.random() < 0.5 else c for c in x)
    human = lambda: r.choice([lambda: leet(word(5, 9)).title() + run(numerals, r.randint(2, 4)), lambda: leet(word(4, 8)) + leet(word(3, 6)).title() + run(numerals, r.randint(1, 2)), lambda: word(4, 7).title() + run(numerals, 2) + word(4, 7).title() + r.choice(["", run(numerals, 2)]), lambda: run(base, r.randint(9, 16)) + run(numerals, 1)])()
    mark = lambda: run(small + small.upper(), r.randint(2, 5)) + r.choice("-_.")
    made = lambda: r.choice([lambda: mark() + run(web, r.randint(16, 44)), lambda: mark() + run(numerals, r.randint(9, 13)) + "-" + run(base, r.randint(16, 30)), lambda: ".".join(run(web, r.randint(12, 60)) for _ in range(r.randint(2, 3))), lambda: mark() + mark() + run(base, r.randint(16, 40)), lambda: run(base, r.randint(16, 60)) + r.choice(["", "=", "=="]), lambda: run(base + "+/", r.randint(24, 88)) + r.choice(["", "=", "=="]), lambda: mark() + run("0123456789abcdef", r.choice([24, 32, 40, 64])), lambda: run(small.upper(), 2) + run("0123456789abcdef", 32)])()
    cue = lambda: r.choice(["api key", "API_KEY", "apiKey", "access_key", "accessKey", "client_secret", "clientSecret", "auth_token", "authToken", "token", "secret", "password", "pwd", "PASSWORD", "passphrase", "credential", "Token", word(3, 6).upper() + "_TOKEN", word(3, 6).upper() + "_KEY", word(3, 6).upper() + "_SECRET", word(3, 6) + "Key"])
    short_cue = lambda: r.choice(["password", "pwd", "Pwd", "passwd", "PASS", word(2, 5).upper() + "PASSWORD", "passphrase", "pass", "key"])
    name = lambda: r.choice([lambda: word(4) + run(numerals, r.randint(1, 4)), lambda: word(4).title() + word(4).title() + run(numerals, r.randint(1, 2)), lambda: f"{word(3)}_{run(numerals, 4)}.{run(small, 3)}", lambda: f"{run(small.upper(), 3)}-20{run(numerals, 2)}-{run(numerals, 5)}", lambda: f"{word(4)}:{run(numerals, 1)}.{run(numerals, 2)}.{run(numerals, 1)}-{word(3)}{run(numerals, 1)}", lambda: f"20{run(numerals, 2)}-0{r.randint(1, 9)}-1{run(numerals, 1)}T1{run(numerals, 1)}:{run(numerals, 2)}:00Z", lambda: "-".join(run("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), lambda: f"{run(numerals, 1)}Z{run(numerals, 3)}{run(small.upper(), 2)}{run(numerals, 10)}", lambda: f"SKU-{run(small.upper(), 2)}{run(numerals, 2)}-{run(numerals, 4)}", lambda: f"{run(numerals, 2)}.{run(numerals, 6)},-{run(numerals, 2)}.{run(numerals, 6)}", lambda: f"{run(small.upper(), 2)}{run(numerals, 2)} {run(numerals, 4)} {run(numerals, 4)} {run(numerals, 4)}", lambda: f"https://{word()}.{word(3, 6)}.org/{word(4)}/{word()}-{run(numerals, 4)}/{word(4)}.{run(small, 3)}?{word(1, 3)}={run(numerals, 3)}", lambda: f"{word(5)}@{word(4)}{run(numerals, 2)}.com", lambda: f"/{word(3)}/{word(4)}{run(numerals, 1)}/{word(4)}-{run(numerals, 1)}.{run(numerals, 2)}/{word(4)}.so.{run(numerals, 1)}", lambda: f"{word(3)}-{word(3)}-{run(numerals, 1)}.{run(numerals, 1)}.{run(numerals, 1)}.tar.gz", lambda: f"#{run(numerals, 8)}", lambda: f"0x{run('0123456789abcdef', 8)}"])()
    about = lambda: r.choice(["key size 20{0}-bit", "token count {0}000000", "the password has 8-{0} characters", "secret number {0}{0}{0}{0}", "key {1}", "the token bucket {1}", "access road {1}", "basic {1}", "signature page {1}", "private room {1}", "credential form {1}", "pass {1}", 'api_key = os.environ["{2}_KEY_V2"]', "token: ${{{2}_TOKEN_{0}}}", "password = get_{3}_{0}()", "auth{0}.{3}.local", "pass the {1} to"]).format(run(numerals, 2), name(), word(4).upper(), word(4))
    for _ in range(n):
        left, right = r.choice([prose(), prose(), ""]), r.choice([prose(), prose(), ""])
        kind = r.random()
        if kind < 0.14:
            head, v = f"{left} {r.choice(['postgres', 'mysql', 'amqp', 'redis', 'ftp', 'http', 'sftp', 'smtp', word(3, 6), word(2, 5) + '+' + word(2, 3)])}://{word()}:", r.choice([human, human, made])().replace("/", "")
            yield f"{head}{v}@{word()}{r.choice(['', '.' + word(2, 4), '.' + word() + '.com', ':' + run(numerals, 4)])}{r.choice(['', '/' + word(), '/' + word() + '.git'])} {right}", [(len(head), len(head) + len(v))]
        elif kind < 0.28:
            head, v = f"{left} {r.choice(['', word() + '=' + word() + ';', '--', '-'])}{short_cue()}{r.choice(['=', '=', ': ', ' ', ' is ', '="', ' = '])}", human()
            yield head + v + r.choice(["", ";", '"', ",", ")"]) + " " + right, [(len(head), len(head) + len(v))]
        elif kind < 0.5:
            head, v = f"{left} {cue()}{r.choice(['=', ': ', ' ', ' is ', ' = "', '": "', ':', ' was ', ' => ', ' -> '])}", made()
            yield head + v + r.choice(["", ";", '"', ",", "'"]) + " " + right, [(len(head), len(head) + len(v))]
        elif kind < 0.56:
            head, v = f"{left} ", made()
            if len(v) > 24 and any(c.isdigit() for c in v):
                yield f"{head}{v} {right}", [(len(head), len(head) + len(v))]
        elif kind < 0.8:
            yield f"{left} {name()} {right}", []
        else:
            yield f"{left} {about()} {right}", []


@lru_cache(maxsize=1)
def trained(seed: int = 11, n: int = 700, rounds: int = 4, rate: float = 0.3, penalty: float = 0.003) -> Field:
    field, squares = Field(), {}
    data = []
    for text, gold in [*examples(seed, n), *digitless_examples(seed, n), *formatted_examples(seed, 2 * n)]:
        for tokens in pieces(text):
            tags = [next((B if k == 0 else I for a, b in gold if a <= s < b for k in [int(s > a)]), O) if ok else O for s, e, ok in tokens]
            data.append((observed(text, tokens, file_features(text)), allowed(tokens), gaps(tokens), tags))
    order = random.Random(seed)
    for _ in range(rounds):
        order.shuffle(data)
        for seen, mask, blank, tags in data:
            field.learn(seen, mask, blank, tags, rate, squares, penalty)
    return field


def field_spans(text: str, field: Field, chains=pieces) -> list[tuple[int, int]]:
    out, whole = [], None
    for tokens in chains(text):
        whole = whole or file_features(text)
        open_ = None
        for (s, e, _), tag in zip(tokens, field.decode(observed(text, tokens, whole), allowed(tokens), gaps(tokens)), strict=True):
            if tag == B:
                out.append(open_) if open_ else None
                open_ = (s, e)
            elif tag == I and open_:
                open_ = (open_[0], e)
            elif open_:
                out.append(open_)
                open_ = None
        if open_:
            out.append(open_)
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def all_spans(text: str, field: Field) -> tuple[list, list]:
    base = base_spans(text)
    added = [(s, 3, e) for s, e in field_spans(text, field) if not any(a <= s and e <= b for a, _, b in base)]
    return base, sorted(base + added)


def secrets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_assign, n_access, n_hex, base_sha256, spans, n_added."""
    sent = df.sparkSession.sparkContext.broadcast(trained())

    def scan(rows: dict) -> dict:
        found = [all_spans(t or "", sent.value) for t in rows["text"]]
        count = lambda k: [sum(x[1] == k for x in base) for base, _ in found]
        return {
            key: rows[key], "n_assign": count(0), "n_access": count(1), "n_hex": count(2), "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found],
            "spans": [joined(a) for _, a in found], "n_added": [len(a) - len(b) for b, a in found],
        }

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(key, df[text].alias("text")), scan, f"{key} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")
