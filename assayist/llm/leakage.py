"""Evaluation texts leaking into training text: pigeonhole edit matching.

Errors cut a run of ``words`` consecutive words of a test item into ``budget + 1`` pieces at most, so one piece keeps a
fair share of the words, and with them a whole block of the item, letter for letter, if blocks are half as long. Blocks are found in the letters of
each document (what a reader sees: form, case, markup, punctuation, blanks and line breaks don't count) by one automaton;
Myers' bit-parallel distance verifies the runs around a hit: without it nothing is found. Documents are read whole, one at a time, in Arrow batches and
without a shuffle. The automaton is built once a worker; items of more than ``LETTERS`` characters are taken in blocks by a hash, each block
against all documents.
"""

from __future__ import annotations

import bisect
import html
import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayist.llm.transducer import visible_form

#: Characters of items in one automaton (about 40 bytes each in a worker).
LETTERS = 8_000_000
#: Elements of HTML; attributes without a value.
ELEMENTS = "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark marquee menu meta meter nav nobr noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script search section select slot small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
BARE = "async autofocus autoplay checked compact controls default defer disabled download hidden inert ismap itemscope loop multiple muted nohref noresize noshade novalidate nowrap open readonly required reversed selected"
_NAME, _QUOTED = r"[a-z][\w:.-]*+", r"""\s*+=\s*+(?:"[^"]*+"|'[^']*+')"""
_ATTRIBUTE = rf"""\s++(?:[a-z_:@][\w:.@-]*+(?:{_QUOTED}|\s*+=\s*+[^\s"'=<>`]++)|(?:{'|'.join(BARE.split())})(?![\w=-]))"""
#: Markup: known elements, or others that can't be a text in angle brackets (closing, empty, or with quoted attributes). Other brackets are punctuation.
_TAG = re.compile(rf"</{_NAME}\s*+>|<(?:{'|'.join(ELEMENTS.split())})(?![\w:.-])(?:{_ATTRIBUTE})*+\s*+/?>|<{_NAME}(?:\s++{_NAME}{_QUOTED})++\s*+/?>|<{_NAME}\s*+/>", re.I)
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """The words of a text as a reader sees them, without case, markup and punctuation."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(visible_form()(html.unescape(text)).casefold())


def letters(text: str | list[str]) -> tuple[str, list[int], list[int]]:
    """The letters and digits of a text without anything between them, and where its words start and end in them."""
    words = words_of(text) if isinstance(text, str) else text
    ends = list(accumulate(map(len, words)))
    return "".join(words), [0, *ends[:-1]] if ends else [], ends


def myers(pattern: str, text: str) -> int:
    """Smallest edit distance of ``pattern`` to any part of ``text`` (bit-parallel, any length)."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        best = min(best, score)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
    return best


def _ahead(a: str, i: int, b: str, j: int, step: int = 16) -> int:
    """Length of the common run of ``a`` from i and ``b`` from j."""
    n = 0
    while (x := a[i + n : i + n + step]) and x == b[j + n : j + n + step]:
        n += len(x)
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    return n


def _reach(a: str, i: int, b: str, j: int, errors: int) -> int:
    """Furthest place in ``b`` that a match from (i, j) gets to with at most ``errors`` edits (diagonal transition)."""
    front = {0: _ahead(a, i, b, j)}  # by diagonal: letters of b taken
    for _ in range(errors):
        nxt: dict[int, int] = {}
        for d, y in front.items():
            for e, z in ((d, y + 1), (d - 1, y + 1), (d + 1, y)):  # another letter, one left out of a, one put into a
                if z + e >= 0 and z <= len(b) - j and z + e <= len(a) - i:
                    nxt[e] = max(nxt.get(e, -1), z)
        front = {d: y + _ahead(a, i + y + d, b, j + y) for d, y in nxt.items()} | {d: y for d, y in front.items() if d not in nxt}
    return max(front.values())


class Matcher:
    """Automaton over the blocks of test items. An item of fewer than ``words`` words counts as a whole."""

    def __init__(self, items: list[tuple[int, str]], words: int = 12, budget: int = 1):
        import ahocorasick

        self.budget = budget
        self.items = {i: x for i, t in items if t and (x := letters(t))[0]}
        self.words = {i: min(words, len(x[1])) for i, x in self.items.items()}
        self.back = {i: x[0][::-1] for i, x in self.items.items()}
        at: dict[str, list[tuple[int, int]]] = {}
        for i, (s, starts, ends) in self.items.items():
            size = max(1, self.run(i) // 2)  # a piece of 2 * size - 1 words holds a whole block
            for b in range(0, len(starts) - size + 1, size):
                at.setdefault(s[starts[b] : ends[b + size - 1]], []).append((i, starts[b]))
        self.automaton = ahocorasick.Automaton() if at else None
        for block, places in at.items():
            self.automaton.add_word(block, (len(block), places))
        if at:
            self.automaton.make_automaton()

    def run(self, item: int) -> int:
        """Whole words that a run keeps in one piece, whatever words the errors hit."""
        return max(1, -(-(self.words[item] - self.budget) // (self.budget + 1)))

    def hits(self, doc: str) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """Block hits by (item, diagonal): places (in the document, in the item)."""
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for end, (n, places) in self.automaton.iter(doc) if self.automaton else ():
            p = end - n + 1
            for i, q in places:
                out.setdefault((i, p - q), []).append((p, q))
        return out

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, errors, exact words) for the items of which the text holds a run of words within the budget.

        ``errors``: the least distance that Myers' algorithm gives for a run of the item. ``exact words``, checked
        afterwards where it is 0: the longest run of whole words of the item that the text holds.
        """
        found_words = words_of(text)
        doc = "".join(found_words)
        hits = self.hits(doc)
        if not hits:
            return []
        _, d_start, d_end = letters(found_words)
        starts, ends, r_doc = set(d_start), set(d_end), doc[::-1]
        best: dict[int, tuple[int, int]] = {}
        for (i, _), places in hits.items():
            s, w_start, w_end = self.items[i]
            r_s, words, run = self.back[i], self.words[i], self.run(i)
            near, exact, done = self.budget + 1, 0, -1
            for p, q in places:
                if p < done:
                    continue
                left, right = _ahead(r_doc, len(doc) - p, r_s, len(s) - q), _ahead(doc, p, s, q)
                done = p + right
                whole = range(bisect.bisect_left(w_start, q - left), bisect.bisect_right(w_end, q + right))
                if len(whole) < run:
                    continue
                if near:
                    near = min(near, self._nearest(doc, p, s, q, w_start, w_end, whole, words, r_doc, r_s))
                if near:
                    continue
                lo, hi = whole[0], whole[-1]
                while lo <= hi and w_start[lo] + p - q not in starts:
                    lo += 1
                while lo <= hi and w_end[hi] + p - q not in ends:
                    hi -= 1
                exact = max(exact, hi - lo + 1)
            if near <= self.budget:
                old = best.get(i, (self.budget + 1, 0))
                best[i] = (min(old[0], near), max(old[1], exact))
        return [(i, e, w) for i, (e, w) in sorted(best.items())]

    def _nearest(self, doc: str, p: int, s: str, q: int, w_start: list[int], w_end: list[int], whole: range, words: int, r_doc: str, r_s: str) -> int:
        """The least distance of a run of ``words`` words around a hit (p, q), by Myers; runs out of reach are left out."""
        near, budget = self.budget + 1, self.budget
        from_, to = q - _reach(r_doc, len(doc) - p, r_s, len(s) - q, budget), q + _reach(doc, p, s, q, budget)
        first, last = max(0, whole[0] - words + 1), min(whole[-1], len(w_start) - words)
        inside = range(whole[0], whole[-1] - words + 2)  # runs without an error first
        for a in [*inside, *(a for a in range(first, last + 1) if a not in inside)]:
            if w_start[a] < from_ - budget or w_end[a + words - 1] > to + budget:
                continue
            window, at = s[w_start[a] : w_end[a + words - 1]], p - (q - w_start[a])
            near = min(near, myers(window, doc[max(0, at - budget) : at + len(window) + budget]))
            if not near:
                break
        return near


_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(name: str, items: list[tuple[int, str]], words: int, budget: int) -> Matcher:
    """The matcher of a block of items, built once in a worker; only the last few are kept."""
    key = (name, words, budget)
    if key not in _MATCHERS:
        while len(_MATCHERS) > 1:
            _MATCHERS.pop(next(iter(_MATCHERS)))
        _MATCHERS[key] = Matcher(items, words, budget)
    return _MATCHERS[key]


def leaks(docs: DataFrame, items: DataFrame, words: int = 12, budget: int = 1, letters_at_once: int = LETTERS) -> DataFrame:
    """(doc_id, item_id, errors, exact_words) for each document and test item of which it holds a passage.

    ``docs``: doc_id, text; ``items``: item_id, item_text. Null and empty texts leak nothing; an item of fewer than
    ``words`` words leaks where all of it stands (with an error only if it has more words than ``budget``); copies of a document have a row each; no items give no rows.
    """
    rows = docs.select("doc_id", "text").filter(F.length("text") > 0)
    given = items.select("item_id", "item_text").filter("item_id is not null and item_text is not null").dropDuplicates(["item_id"])
    size = given.agg(F.sum(F.length("item_text"))).first()[0] or 0
    blocks = max(1, -(-size // letters_at_once))
    passes = []
    for k in range(blocks):
        listed = sorted(tuple(r) for r in given.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect())
        sent, name = docs.sparkSession.sparkContext.broadcast(listed), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name: str = name) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(name, sent.value, words, budget)
            for b in batches:
                out = [(d, *x) for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True) for x in matcher.find(t)]
                cols = list(zip(*out, strict=True)) or [(), (), (), ()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "errors", "exact_words"])

        passes.append(rows.mapInArrow(run, "doc_id bigint, item_id bigint, errors int, exact_words int"))
    return reduce(DataFrame.unionByName, passes)
