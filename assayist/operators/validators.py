"""Comparison operators: builders of Column expressions, registered by name.

A validator takes an :class:`Inputs` of columns and gives ``struct<outcome, code, lean>``. Outcomes: PASS, FAIL,
NOT_APPLICABLE, INSUFFICIENT (a person has to look). Nulls are "not stated"; an element counts as *unlocated* if
its reading is blank and nothing was seen of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayist.functions import marks as M
from assayist.functions import text as X


def none() -> Column:
    return F.lit(None).cast("string")


@dataclass
class Inputs:
    """What a validator may look at; columns that a rule doesn't need stay null."""

    reading: Column
    expected: Column = field(default_factory=none)
    seen: Column = field(default_factory=lambda: F.lit(True))
    extra: dict = field(default_factory=dict)
    parameters: dict = field(default_factory=dict)

    @property
    def blank(self) -> Column:
        return F.trim(F.coalesce(self.reading, F.lit(""))) == ""

    @property
    def unlocated(self) -> Column:
        return self.blank & ~F.coalesce(self.seen, F.lit(False))

    @property
    def undeclared(self) -> Column:
        return F.trim(F.coalesce(self.expected, F.lit(""))) == ""


REGISTRY: dict[str, Callable[[Inputs], Column]] = {}


def register(name: str):
    """Add a validator; a name can be taken once."""

    def add(f: Callable[[Inputs], Column]) -> Callable[[Inputs], Column]:
        if name in REGISTRY:
            raise ValueError(f"validator {name} exists")
        REGISTRY[name] = f
        return f

    return add


def verdict(outcome: str, code: str | None = None, lean: str | None = None) -> Column:
    return F.struct(F.lit(outcome).alias("outcome"), F.lit(code).cast("string").alias("code"), F.lit(lean).cast("string").alias("lean"))


def cases(*pairs: tuple[Column, Column], otherwise: Column) -> Column:
    """The first case that holds; an unknown condition doesn't."""
    out = reduce(lambda w, p: F.when(F.coalesce(p[0], F.lit(False)), p[1]) if w is None else w.when(F.coalesce(p[0], F.lit(False)), p[1]), pairs, None)
    return out.otherwise(otherwise)


def ok() -> Column:
    return verdict("PASS")


def not_applicable() -> Column:
    return verdict("NOT_APPLICABLE")


def not_read() -> Column:
    return verdict("INSUFFICIENT", "READ.MISSING", "fail")


@register("presence")
def presence(i: Inputs) -> Column:
    licence = F.lit(bool(i.parameters.get("unlocated_is_absent", False)))
    heading = i.extra.get("heading_unread", F.lit(False))
    return cases((heading, verdict("INSUFFICIENT", "READ.HEADING")), (i.unlocated & ~licence, not_read()), (~i.blank, ok()), otherwise=verdict("FAIL", "PRESENCE.ABSENT"))


@register("conditional_presence")
def conditional_presence(i: Inputs) -> Column:
    needed = F.coalesce(i.extra.get("required", F.lit(True)), F.lit(False))
    return cases((~needed, not_applicable()), (i.unlocated, not_read()), (~i.blank, ok()), otherwise=verdict("FAIL", "PRESENCE.ABSENT"))


@register("enumerated")
def enumerated(i: Inputs) -> Column:
    """The reading is, or holds as whole words, one of the allowed values."""
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)
    words = X.padded(tokens(i.reading))
    allowed = [F.lit(a) for a in i.parameters["allowed"]]
    hit = reduce(lambda a, b: a | b, [words.contains(X.padded(tokens(a))) for a in allowed])
    return cases((i.unlocated, not_read()), (hit, ok()), otherwise=verdict("FAIL", "CLASS.NOT_LISTED"))


@register("designation")
def designation(i: Inputs) -> Column:
    """Declared and read designations agree: a segment as a run, a shared class, a class within another.

    The classes that each holds come from ``parameters["classes"]``, or joined, in ``extra``: known, declared_known.
    """
    classes: list[str] = i.parameters.get("classes", [])
    within: list[tuple[str, str]] = i.parameters.get("within", [])
    read, declared = X.norm_words(i.reading), X.norm_words(i.expected)
    segments = F.transform(F.split(i.expected, r"[/()]"), lambda s: X.norm_words(s))
    run = F.exists(segments, lambda s: X.has_run(read, s))
    known = lambda w: F.filter(F.array(*map(F.lit, classes)), lambda c: F.size(F.array_except(F.split(c, " "), w)) == 0)
    given = lambda k, w: F.coalesce(i.extra[k], F.array().cast("array<string>")) if k in i.extra else known(w)
    own, theirs = given("known", read), given("declared_known", declared)
    inner = reduce(lambda a, b: a | b, [F.array_contains(own, a) & F.array_contains(theirs, b) for a, b in within], F.lit(False))
    class_words = F.array_distinct(F.flatten(F.transform(own, lambda c: F.split(c, " "))))
    both = (F.size(own) > 0) & (F.size(theirs) > 0)
    return cases(
        (i.unlocated, not_read()), (i.blank, verdict("FAIL", "CLASS.ABSENT")), (i.undeclared, not_applicable()), (run, ok()), (F.size(F.array_intersect(own, theirs)) > 0, ok()), (inner, ok()),
        (both & (F.size(F.array_except(read, class_words)) > 0), verdict("INSUFFICIENT", "CLASS.UNCERTAIN")), (both, verdict("FAIL", "CLASS.DIFFERS")), otherwise=verdict("INSUFFICIENT", "CLASS.UNCERTAIN"),
    )


@register("format")
def regex_format(i: Inputs) -> Column:
    """The reading has the format; one that hasn't is for a person to look at, never a failure."""
    return cases((i.unlocated, not_read()), (i.reading.rlike("(?iu)" + i.parameters["pattern"]), ok()), otherwise=verdict("INSUFFICIENT", "FORMAT.UNCERTAIN"))


@register("brand")
def brand(i: Inputs) -> Column:
    """A cascade over the admissible names: the declared one, the ``fanciful`` one and the ``trade_names``. Never fails.

    ``extra``: fanciful, trade_names (array), lines (array of the label's other lines). The declared and trade names are
    searched for in the lines where the reading shows none, and where nothing was read.
    """
    none_, no_list = F.lit(None).cast("string"), F.array().cast("array<string>")
    fanciful, trade, lines = i.extra.get("fanciful", none_), F.coalesce(i.extra.get("trade_names", no_list), no_list), F.coalesce(i.extra.get("lines", no_list), no_list)
    stated = lambda a: F.filter(a, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    names = stated(F.concat(F.array(i.expected, fanciful), trade))
    found = X.best_route(lines, stated(F.concat(F.array(i.expected), trade)), i.parameters.get("droppable", ["co"])).isNotNull()
    read, rw = X.canonical(i.reading), X.without_article(X.norm_words(i.reading))
    same = F.exists(names, lambda n: X.canonical(n) == read)
    run = F.exists(names, lambda n: X.has_run(rw, X.without_article(X.norm_words(n))) | X.has_run(X.without_article(X.norm_words(n)), rw))
    bare = X.skeleton(read)
    marks = F.exists(names, lambda n: (X.skeleton(X.canonical(n)) == bare) & bare.rlike(r"[\p{L}\p{N}]"))
    canon = F.transform(names, X.canonical)
    sim = i.extra["similarity"] if "similarity" in i.extra else X.best_similarity(read, canon)
    near, other = i.parameters.get("near", 0.85), X.best_variant(read, canon)
    return cases(
        (i.undeclared, not_applicable()), (i.unlocated & found, ok()), (i.unlocated, not_read()), (same, ok()), (run, ok()), (marks, ok()), (sim >= i.parameters.get("same", 0.92), ok()), (found, ok()),
        (sim >= near, verdict("INSUFFICIENT", "BRAND.NEAR", "pass")), (other >= near, verdict("INSUFFICIENT", "BRAND.NEAR", "pass")), otherwise=verdict("INSUFFICIENT", "BRAND.UNCERTAIN", "fail"),
    )


@register("heading_style")
def heading_style(i: Inputs) -> Column:
    """Wording, capitals and weight of a heading; each of caps and bold may be true, false or not measured."""
    caps, bold, sure = (i.extra.get(k, F.lit(None).cast("boolean")) for k in ("all_caps", "bold", "confident"))
    wording = X.canonical(i.reading) != X.canonical(F.lit(i.parameters["heading"]))
    return cases((i.unlocated & caps.isNull() & bold.isNull(), not_read()), (wording | (caps == F.lit(False)), verdict("FAIL", "HEADING.STYLE")), (bold & sure, ok()), ((bold == F.lit(False)) & sure, verdict("FAIL", "HEADING.WEIGHT")), otherwise=verdict("INSUFFICIENT", "HEADING.UNMEASURED"))


@register("same_field_of_vision")
def same_field_of_vision(i: Inputs) -> Column:
    """Some panel holds all the fields; ``panels`` is a map of panel to fields."""
    panels, need = i.extra["panels"], F.array(*map(F.lit, i.parameters["fields"]))
    together = F.exists(F.map_values(panels), lambda f: F.size(F.array_except(need, f)) == 0)
    return cases((panels.isNull() | (F.size(panels) == 0), not_read()), (together, ok()), otherwise=verdict("FAIL", "LAYOUT.APART"))


@register("name_address")
def name_address(i: Inputs) -> Column:
    """The first two words after "... by" are a run of what is declared, and another word is shared."""
    states = i.parameters.get("states", {})

    def folded(c: Column) -> Column:
        s = X.padded(X.norm_words(c))
        for long in sorted(states, key=lambda k: -k.count(" ")):
            s = F.replace(s, F.lit(f" {long} "), F.lit(f" {states[long]} "))
        return F.filter(F.split(F.trim(s), " "), lambda w: w != "")

    read, declared = folded(i.reading), folded(i.expected)
    lead = F.slice(read, F.lit(1), F.lit(8))
    after = F.size(lead) - F.array_position(F.reverse(lead), "by") + 1
    body = F.when(F.array_contains(lead, "by"), F.slice(read, after.cast("int") + 1, F.greatest(F.size(read), F.lit(1)))).otherwise(read)
    two = F.slice(body, F.lit(1), F.lit(2))
    shared = F.size(F.array_except(F.array_intersect(body, declared), two))
    return cases((i.undeclared, not_applicable()), (i.blank, not_read()), ((F.size(two) == 2) & X.has_run(declared, two) & (shared >= 1), ok()), otherwise=verdict("INSUFFICIENT", "BOTTLER.UNCERTAIN"))


@register("origin")
def origin(i: Inputs) -> Column:
    imported = F.coalesce(i.extra.get("imported", F.lit(False)), F.lit(False))
    return cases((~imported, not_applicable()), (i.undeclared, verdict("INSUFFICIENT", "ORIGIN.UNDECLARED")), (i.blank, not_read()), (X.has_run(X.norm_words(i.reading), X.norm_words(i.expected)), ok()), otherwise=verdict("INSUFFICIENT", "ORIGIN.UNCERTAIN"))


@register("proof_agreement")
def proof_agreement(i: Inputs) -> Column:
    """Every proof figure (``proofs``: array of value string, beside boolean) is judged against twice the percentage; the worst counts."""
    proofs, abv = i.extra["proofs"], i.extra["abv"].cast("decimal(9,4)")
    twice = abv * 2

    def judge(p: Column) -> Column:
        v = p.value.try_cast("decimal(9,4)")
        places = F.length(F.regexp_extract(p.value, r"\.(\d+)$", 1))
        unit = F.pow(F.lit(10.0), -places)
        text = F.regexp_replace(twice.cast("string"), r"\.?0+$", "")
        one_off = F.exists(F.sequence(F.lit(1), F.greatest(F.length(p.value), F.lit(1))), lambda k: (F.substr(p.value, k, F.lit(1)) == "1") & (F.concat(F.substr(p.value, F.lit(1), k - 1), F.substr(p.value, k + 1)) == text))
        return F.when(v.isNull() | (v > 200), 1).when(v == twice, 0).when(one_off | (F.abs(v - twice) < unit), 1).when(F.coalesce(p.beside, F.lit(False)), 2).otherwise(1)

    grade = F.array_max(F.transform(proofs, judge))
    return cases((proofs.isNull() | (F.size(proofs) == 0), not_applicable()), (abv.isNull(), verdict("INSUFFICIENT", "PROOF.NO_ABV")), (grade == 2, verdict("FAIL", "PROOF.DIFFERS")), (grade == 1, verdict("INSUFFICIENT", "PROOF.UNCERTAIN", "pass")), otherwise=ok())


@register("verbatim")
def verbatim(i: Inputs) -> Column:
    """The text has the pinned hash after the canonical steps, with the named words (``initials``) in capitals; else the kind of difference decides.

    Only hash misses are compared: what readers make, words that ``words`` hasn't and rearranged words are for a person.
    """
    steps, pinned = i.parameters.get("steps", ["plain", "join_hyphens", "drop_ws", "casefold"]), i.parameters["text"]
    canon, want = X.apply_ops(i.reading, steps), X.apply_ops(F.lit(pinned), steps)
    hit = X.fingerprint(canon) == X.fingerprint(want)
    first, second = i.parameters.get("initials", ("surgeon", "general"))
    spaced = [x for x in steps if x != "drop_ws"]
    kind = M.difference_to(F.when(~hit, X.apply_ops(i.reading, spaced)), i.parameters.get("spaced", pinned), i.parameters.get("words", []))
    return cases(
        (i.unlocated, not_read()), (hit & M.small_initials(i.reading, first, second).isNotNull(), verdict("INSUFFICIENT", "TEXT.INITIALS")), (hit, ok()),
        (kind == "reader", verdict("INSUFFICIENT", "TEXT.READING")), (kind == "unsure", verdict("INSUFFICIENT", "TEXT.UNSURE")), otherwise=verdict("FAIL", "TEXT.DIFFERS"),
    )


@register("quantity")
def quantity(i: Inputs) -> Column:
    """``amount`` in ``unit`` against ``declared`` in the base unit: equal, or within ``cross`` of it if the units differ."""
    amount, unit, declared = i.extra["amount"], i.extra["unit"], i.extra["declared"]
    factors: dict[str, float] = i.parameters["factors"]
    factor = reduce(lambda w, kv: w.when(unit == kv[0], F.lit(kv[1])), factors.items(), F.when(F.lit(False), 0.0))
    margin = F.when(factor == 1.0, F.greatest(F.abs(declared) * 1e-9, F.lit(1e-9))).otherwise(F.greatest(F.abs(declared) * i.parameters.get("cross", 1e-9), F.lit(1e-9)))
    return cases((declared.isNull() & i.undeclared, not_applicable()), (declared.isNull(), verdict("INSUFFICIENT", "QUANTITY.UNSTATED")), (amount.isNull(), verdict("INSUFFICIENT", "QUANTITY.UNREAD")), (factor.isNull(), verdict("INSUFFICIENT", "QUANTITY.UNIT")), (F.abs(amount * factor - declared) <= margin, ok()), otherwise=verdict("FAIL", "QUANTITY.DIFFERS"))


@register("unmeasurable")
def unmeasurable(i: Inputs) -> Column:
    return verdict("INSUFFICIENT", "NOT.MEASURABLE")


def run(name: str, inputs: Inputs) -> Column:
    """The named validator; an unknown name gives an error outcome, not an exception."""
    return REGISTRY[name](inputs) if name in REGISTRY else verdict("ERROR", "ENGINE.VALIDATOR.NOT_FOUND")
