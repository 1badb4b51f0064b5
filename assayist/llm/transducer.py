"""Visually identical text with different characters: one consistent form, by a compiled longest-match transducer.

The mapping is compiled once from :mod:`assayist.functions.characters`: forms of another width or coding, every kind of
blank, look-alike letters, and letters with accents however they are put together. It is checked for conflicts: an output
may hold nothing that is itself mapped, so one pass reaches the final form and a second changes nothing. The text is then
read once, from the left; at each place the longest entry or grapheme cluster (a character with its marks) is replaced.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayist.functions.characters import tables


_RUN = re.compile(r"[ -~]?[^ -~]+")


class Conflict(ValueError):
    """Entries of a mapping that contradict each other."""


def check(mapping: dict[str, str]) -> None:
    """Refuse a mapping with an empty key, or one whose outputs would be mapped again."""
    if "" in mapping:
        raise Conflict("an empty key")
    keys = {k for k in mapping if len(k) == 1}
    for k, v in mapping.items():
        if again := keys & set(v):
            raise Conflict(f"{k!r} becomes {v!r}, of which {sorted(again)} is mapped again")
    for k in mapping:
        if len(k) > 1 and (part := next((k[:i] for i in range(1, len(k)) if k[:i] in mapping and mapping[k[:i]] + "".join(mapping.get(c, c) for c in k[i:]) == mapping[k]), None)):
            raise Conflict(f"{k!r} does no more than its part {part!r}")


def resolved(entries: list[tuple[str, str]]) -> dict[str, str]:
    """A mapping of entries whose outputs are final: an output that is mapped itself is replaced by its own output.

    Two entries of one key with different outputs, or outputs that lead back to their key, are conflicts.
    """
    given: dict[str, str] = {}
    for k, v in entries:
        if given.setdefault(k, v) != v:
            raise Conflict(f"{k!r} becomes {given[k]!r} and {v!r}")

    def final(k: str, path: tuple[str, ...]) -> str:
        if k in path:
            raise Conflict(f"{' becomes '.join(map(repr, (*path, k)))}")
        return "".join(final(c, (*path, k)) if c in given and c != k else c for c in given[k])

    return {k: final(k, ()) for k in given}


class Transducer:
    """A mapping compiled to one scan. Clusters with marks are composed when first met and remembered."""

    def __init__(self, mapping: dict[str, str], nothing: str, marks: str):
        check(mapping)
        self.mapping, self.nothing = mapping, frozenset(nothing)
        extend = "[" + re.escape(marks + nothing) + "]"
        longest = sorted((k for k in mapping if len(k) > 1), key=len, reverse=True)
        single = "[" + re.escape("".join(k for k in mapping if len(k) == 1)) + "]"
        self.scan = re.compile("|".join([*map(re.escape, longest), rf"[\s\S]?{extend}+", single]))
        self.known = dict(mapping)
        self.runs: dict[str, str] = {}

    def _cluster(self, m: re.Match) -> str:
        text = m[0]
        if (out := self.known.get(text)) is None:
            shown = "".join(c for c in text if c not in self.nothing)
            out = unicodedata.normalize("NFC", "".join(self.mapping.get(c, c) for c in shown))
            if len(self.known) < 200_000:
                self.known[text] = out
        return out

    def __call__(self, text: str) -> str:
        """The text in one pass. Only runs that aren't printable ASCII, with the character before them, are looked into."""
        return text if text.isascii() and text.isprintable() else _RUN.sub(self._run, text)

    def _run(self, m: re.Match) -> str:
        text = m[0]
        if (out := self.runs.get(text)) is None:
            out = unicodedata.normalize("NFC", self.scan.sub(self._cluster, text))  # letters put together of several that are no marks
            if len(text) <= 64 and len(self.runs) < 200_000:
                self.runs[text] = out
        return out


@lru_cache(maxsize=1)
def visible_form() -> Transducer:
    """The transducer for what a reader sees: case, spelling, punctuation, accents and the number of blanks stay."""
    mapped, blanks, nothing = tables()
    entries = [*((b, " ") for b in blanks), ("\r\n", " "), *((ch, unicodedata.normalize("NFC", plain)) for ch, plain in mapped.items())]
    keys = {k for k, _ in entries}
    for o in range(0xC0, 0x2000):  # accented look-alikes: their letter is mapped, their accents stay
        d = unicodedata.normalize("NFD", ch := chr(o))
        if ch not in keys and len(d) > 1 and d[0] in mapped:
            entries.append((ch, unicodedata.normalize("NFC", mapped[d[0]] + d[1:])))
    mapping = resolved(entries)
    marks = "".join(c for o in range(0x300, 0x20000) if unicodedata.category(c := chr(o)) in ("Mn", "Me") and c not in nothing)
    return Transducer({k: v for k, v in mapping.items() if k != v}, nothing, marks)


def _apply(values: pa.Array) -> pa.Array:
    f, codes = visible_form(), values.dictionary_encode()
    return pa.array([v if v is None else f(v) for v in codes.dictionary.to_pylist()], pa.string()).take(codes.indices)


_arrow = F.arrow_udf(_apply, T.StringType())


def visible(col: Column) -> Column:
    """The consistent form of a text column. Null stays null, empty stays empty; texts of any length are read once."""
    return _arrow(col)


def visibly_same(df: DataFrame, left: str, right: str) -> DataFrame:
    """The rows whose two texts differ as strings and yet show a reader the same; neither may be empty or null.

    Rows whose texts are both printable ASCII can't be among them and never leave the JVM.
    """
    special = r"[^\x20-\x7E]"
    l, r = F.col(left), F.col(right)
    rows = df.filter((l != r) & (l != "") & (r != "") & (l.rlike(special) | r.rlike(special)))
    cols = [F.col(c) for c in df.columns if c not in ("_l", "_r")]
    both = rows.select(*cols, visible(l).alias("_l"), visible(r).alias("_r"))
    return both.filter((F.col("_l") == F.col("_r")) & (F.col("_l") != "")).drop("_l", "_r")
