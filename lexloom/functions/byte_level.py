"""The alphabet of byte-level vocabularies: every byte is written as one character that prints.

Bytes that print in Latin-1 stand for themselves; the others, in order, are the
characters from U+0100 on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ranges of Latin-1 whose characters print.
PRINTING = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))


def alphabet() -> list[str]:
    """The character of each byte, 0 to 255."""
    prints = {b for a, z in PRINTING for b in range(a, z + 1)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(hidden)) for b in range(256)]


def to_bytes(piece: str, byte_of: dict[str, int] | None = None) -> bytes:
    """The bytes that a piece of a byte-level vocabulary stands for; characters outside the alphabet stand for their UTF-8."""
    byte_of = byte_of or {c: b for b, c in enumerate(alphabet())}
    return b"".join(bytes([byte_of[c]]) if c in byte_of else c.encode() for c in piece)


def _map(pairs: list[tuple[str, str]]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(a) for a, _ in pairs]), F.array(*[F.lit(b) for _, b in pairs]))


def encoded(text: Column) -> Column:
    """A text as a byte-level vocabulary writes it: one character for each byte of its UTF-8."""
    chars = _map([(f"{b:02X}", c) for b, c in enumerate(alphabet())])
    return F.array_join(F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1)), lambda h: F.element_at(chars, h)), "")


def decoded(piece: Column) -> Column:
    """The bytes of a piece, which need not be whole characters; null if it has a character outside the alphabet."""
    hexes = _map([(c, f"{b:02X}") for b, c in enumerate(alphabet())])
    found = F.transform(F.filter(F.split(piece, ""), lambda c: c != ""), lambda c: F.try_element_at(hexes, c))
    return F.when(~F.exists(found, lambda h: h.isNull()), F.unhex(F.array_join(found, "")))


#: Scripts in the order in which a piece is looked at; the first that it has a letter of is its own.
SCRIPTS = ("Han", "Hiragana", "Katakana", "Hangul", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Thai", "Latin")


def script_of(raw: Column) -> Column:
    """The script of a piece's letters; `digits` without letters, `other` without either, and `partial` if the bytes are not whole characters."""
    text = F.try_validate_utf8(raw.cast("string"))
    out = F.when(text.isNull(), "partial")
    for s in SCRIPTS:
        out = out.when(text.rlike(rf"\p{{Is{s}}}"), s.lower())
    return F.when(raw.isNotNull(), out.when(text.rlike(r"\p{Nd}"), "digits").otherwise("other"))
