"""Characters that print alike: fixed look-alike values, rules over the Unicode database, a JVM-side fold.

The tables are derived when the module is imported: wide, narrow, font and ligature forms come from the
compatibility decompositions of Python's ``unicodedata``; only letters of other scripts that look like Latin ones
are listed, as fixed values.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of other scripts and the Latin letters that they look like.
LOOKALIKES: dict[str, str] = {
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Greek small letters
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ι": "i", "ρ": "p", "υ": "u", "α": "a", "γ": "y", "κ": "k", "χ": "x", "ω": "w", "σ": "o", "τ": "t",
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ԁ": "D", "Һ": "H", "Ғ": "F", "Ӏ": "I",
    # Cyrillic small letters
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "ү": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "к": "k", "т": "t", "м": "m", "н": "h", "в": "b", "г": "r", "п": "n",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "զ": "q", "ց": "g", "Ս": "U", "Օ": "O", "Տ": "S", "Լ": "L",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Latin letters outside the basic block
    "ɡ": "g", "ɑ": "a", "ꓲ": "I", "ѡ": "w", "ꜱ": "s", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꞵ": "B", "ı": "i", "ȷ": "j",
    # signs
    "‐": "-", "‑": "-", "⁄": "/", "∕": "/", "ǃ": "!", "‚": ",", "․": ".", "꞉": ":", "∶": ":", "ː": ":", "⁎": "*", "∗": "*", "˜": "~",
}

#: Letters that a capital or bold reading of the small form may confuse but a reader tells apart: kept out of the visible form.
LOOSE = set("αγκχωστυριкмнтвгп")

#: Decompositions that change the width, the font or the coding of a letter, not what it shows.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>")


def ignorable(ch: str) -> bool:
    """Whether a character shows nothing: format characters, variation selectors, joiners and fillers."""
    o = ord(ch)
    return (unicodedata.category(ch) == "Cf" and not 0x600 <= o <= 0x6DD and o not in (0x70F, 0x8E2)) or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0) or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF


def blank(ch: str) -> bool:
    """Whether a character is some kind of blank (one blank wide, whatever its width)."""
    return unicodedata.category(ch) in ("Zs", "Zl", "Zp") or ch in "\t\n\v\f\r\x85"


def same_look(ch: str) -> str | None:
    """The plain text that a form of another width, font or coding stands for; None if it is plain already."""
    if ch in LOOKALIKES and ch not in LOOSE:
        return LOOKALIKES[ch]
    d = unicodedata.decomposition(ch)
    if d.startswith(SAME_LOOK) or (d.startswith("<compat>") and 0xFB00 <= ord(ch) <= 0xFB06) or (d and not d.startswith("<") and " " not in d):
        out = "".join(chr(int(x, 16)) for x in d.split() if x[0] != "<")
        return "".join(same_look(c) or c for c in out)
    return None


@lru_cache(maxsize=1)
def tables() -> tuple[dict[str, str], str, str]:
    """Mapped characters, blanks and ignorable characters, over the planes that hold letters, forms and format characters."""
    mapped, blanks, nothing = {}, [], []
    for o in (*range(0x20000), *range(0xE0000, 0xE0200)):
        if 0xD800 <= o <= 0xDFFF or 0x20 <= o < 0x7F:
            continue
        ch = chr(o)
        if ignorable(ch):
            nothing.append(ch)
        elif blank(ch):
            blanks.append(ch)
        elif m := same_look(ch):
            mapped[ch] = m
    return mapped, "".join(blanks), "".join(nothing)


@lru_cache(maxsize=1)
def _translation() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to) for ``translate`` over the basic plane, accents taken off; and the forms that need more than one letter."""
    mapped, blanks, _ = tables()
    src, dst, multi = [], [], []
    for o in range(0x80, 0x10000):
        if 0xD800 <= o <= 0xDFFF:
            continue
        ch = chr(o)
        if ch in blanks:
            to = " "
        else:
            to = mapped.get(ch) or LOOKALIKES.get(ch) or ch
            to = "".join(mapped.get(c) or c for c in unicodedata.normalize("NFD", to) if not unicodedata.combining(c))
        if to != ch and to.isascii():
            if len(to) == 1:
                src.append(ch)
                dst.append(to)
            elif len(to) > 1:
                multi.append((ch, to))
    return "".join(src), "".join(dst), tuple(multi)


def plain(col: Column) -> Column:
    """JVM-side fold to plain letters: width, kind of blank, look-alikes and accents go; ASCII rows pass untouched.

    Nulls stay null. Only texts with a character outside ASCII take the translating branch.
    """
    src, dst, multi = _translation()
    out = F.regexp_replace(F.translate(col, src, dst), r"[\p{Mn}\p{Cf}ᅟᅠㅤ]", "")
    for a, b in multi:
        if 0xFB00 <= ord(a) <= 0xFB06:
            out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(col.rlike(r"[^\x00-\x7F]"), out).otherwise(col)


@lru_cache(maxsize=1)
def _plain_map() -> dict[int, str]:
    mapped, blanks, nothing = tables()
    src, dst, multi = _translation()
    return {**{ord(c): "" for c in nothing}, **{ord(c): " " for c in blanks}, **{ord(a): b for a, b in multi}, **{ord(a): b for a, b in zip(src, dst, strict=True)}, **{ord(a): m for a, m in mapped.items() if ord(a) > 0xFFFF}}


def plain_text(s: str) -> str:
    """What :func:`plain` does, for code that runs in a batch in Python."""
    if s.isascii():
        return s
    return "".join(c for c in s.translate(_plain_map()) if not unicodedata.category(c).startswith("M"))
