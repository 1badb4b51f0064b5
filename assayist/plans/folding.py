"""What a reader sees, written as SQL from lists of its own, so that it can be held against the engine's mapping."""

from __future__ import annotations

#: Fixed values, plainly: letters of other scripts and the Latin ones that they look like.
GREEK, AS_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo"
CYRILLIC, AS_CYRILLIC = "ЅІЈАВЕКМНОРСТХаеорсухѕіјҮһԁ", "SIJABEKMHOPCTXaeopcyxsijYhd"
OTHERS, AS_OTHERS = "ɡօK", "goK"
#: Kinds of blank; what shows nothing.
BLANKS = "              　\t\r\n  "
NOTHING = "­͏᠎​‌‍‎‏⁠︎️﻿"
#: Full-width forms of the printable ASCII characters, by rule.
WIDE, AS_WIDE = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94))
LIGATURES = {"ﬃ": "ffi", "ﬄ": "ffl", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl"}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def seen(column: str) -> str:
    """An expression for the form that a reader sees: case, accents, punctuation and the number of blanks stay."""
    out = f"regexp_replace({column}, '[{NOTHING}]', '', 'g')"
    for k, v in LIGATURES.items():
        out = f"replace({out}, '{k}', '{v}')"
    old, new = GREEK + CYRILLIC + OTHERS + WIDE, AS_GREEK + AS_CYRILLIC + AS_OTHERS + AS_WIDE
    return f"nfc_normalize(translate(translate(nfc_normalize({out}), {_quoted(BLANKS)}, {_quoted(' ' * len(BLANKS))}), {_quoted(old)}, {_quoted(new)}))"


def letters(column: str) -> str:
    """The same in lower case without accents."""
    return f"lower(strip_accents({seen(column)}))"
