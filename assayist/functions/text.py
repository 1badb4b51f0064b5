"""Scalar functions on text, as Column expressions (Arrow functions where Spark has none)."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayist.functions.characters import plain


def norm_words(c: Column) -> Column:
    """Words of a text for comparison: accents off, lower case; '&' is "and"; the spellings of whiskey are one."""
    words = F.regexp_extract_all(F.lower(plain(c)), F.lit(r"([0-9a-z]+|&)"), 1)
    return F.transform(words, lambda w: F.when(w == "&", "and").when(w.isin("whisky", "whiskies"), "whiskey").otherwise(w))


def canonical(c: Column) -> Column:
    """Trade marks off, plain letters, straight quotes, single blanks, lower case."""
    s = F.translate(F.regexp_replace(c, "[®™©]", ""), "‘’ʼ“”", "'''\"\"")
    return F.lower(F.trim(F.regexp_replace(plain(s), r"\s+", " ")))


def skeleton(c: Column) -> Column:
    """A canonical text without blanks and punctuation; ``&#@%`` and marks between two digits stay."""
    p = r"[\p{Punct}&&[^&#@%]]"
    return F.regexp_replace(c, rf"\s|(?<![0-9]){p}|{p}(?![0-9])", "")


def padded(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def has_run(words: Column, run: Column) -> Column:
    """Whether ``run`` stands in ``words`` as consecutive whole words; false for an empty run."""
    return (F.size(run) > 0) & padded(words).contains(padded(run))


def without_article(words: Column) -> Column:
    return F.when((F.size(words) > 1) & (F.get(words, F.lit(0)) == "the"), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)


def shortened(words: Column, droppable: list[str]) -> Column:
    """``words`` without the droppable ones at its end; empty if none or all would go."""
    drop = F.array(*map(F.lit, droppable))
    last = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), F.lit(0), lambda a, i: F.when(~F.array_contains(drop, F.coalesce(F.get(words, i - 1), F.lit(""))), i).otherwise(a))
    return F.when((last == 0) | (last == F.size(words)), F.array().cast("array<string>")).otherwise(F.slice(words, F.lit(1), F.greatest(last, F.lit(0))))


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


#: How a line shows a name, the strongest first.
ROUTES = ["exact", "punctuation", "within", "shortened", "misread"]


def search_route(line: Column, name: Column, droppable: list[str], least: int = 3, within: int = 5, misread: int = 8) -> Column:
    """Number (from 1) of the ROUTES by which a ``line`` shows a ``name``; null for none.

    The line is the name; or is it without punctuation and blanks; or holds its words as a run, if the name has two words or
    ``within`` letters; or is the name less its droppable last words; or is either of these with one letter different, if
    that has ``misread`` letters. Names of fewer than ``least`` letters aren't searched for.
    """
    a, b = canonical(line), canonical(name)
    seen, target = skeleton(a), skeleton(b)
    words = without_article(norm_words(name))
    short = F.array_join(shortened(words, droppable), "")
    run = ((F.size(words) >= 2) | (F.length(target) >= within)) & has_run(without_article(norm_words(line)), words)
    near = lambda form: (F.length(form) >= misread) & within_one_edit(seen, form)
    route = F.when(a == b, 1).when(seen == target, 2).when(run, 3).when((F.length(short) >= least) & (seen == short), 4).when(near(target) | near(short), 5)
    return F.when(F.length(target) >= least, route)


def best_route(lines: Column, names: Column, droppable: list[str], **lengths: int) -> Column:
    """struct<route, name, line> (numbers, names and lines from 0) of the strongest route of any line to any name, the earlier name and line on a tie; null for none."""
    pairs = F.flatten(F.transform(names, lambda n, j: F.transform(lines, lambda x, i: F.struct(search_route(x, n, droppable, **lengths).alias("route"), j.alias("name"), i.alias("line")))))
    return F.array_min(F.filter(pairs, lambda p: p.route.isNotNull()))


def _jw(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, first = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                first.append(ch)
                break
    if not first:
        return 0.0
    second = [b[j] for j, u in enumerate(used) if u]
    m, t = len(first), sum(x != y for x, y in zip(first, second, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _jaro_winkler(a: pa.Array, b: pa.Array) -> pa.Array:
    seen: dict[tuple, float | None] = {}
    return pa.array([seen[p] if p in seen else seen.setdefault(p, _jw(*p)) for p in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


jaro_winkler = F.arrow_udf(_jaro_winkler, T.DoubleType())


def _best(score):
    """The best score of a text with any of an array of others, in Arrow batches; 0 without any. Each pair is rated once."""

    def run(a: pa.Array, others: pa.Array) -> pa.Array:
        seen: dict[tuple[str, str], float] = {}
        rate = lambda x, y: seen[x, y] if (x, y) in seen else seen.setdefault((x, y), score(x, y))
        return pa.array([max((rate(x, y) for y in ys or () if y is not None), default=0.0) if x is not None else 0.0 for x, ys in zip(a.to_pylist(), others.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(run, T.DoubleType())


best_similarity = _best(lambda a, b: _jw(a, b) if a and b else 0.0)
#: The same without first letters, where these differ; else 0.
best_variant = _best(lambda a, b: _jw(a[1:], b[1:]) if len(a) > 1 and len(b) > 1 and a[0] != b[0] else 0.0)


def nfkc(form: str = "NFKC"):
    """Unicode normalization in Arrow batches."""
    return F.arrow_udf(lambda v: pa.array([x if x is None else unicodedata.normalize(form, x) for x in v.to_pylist()], pa.string()), T.StringType())


def first_number(c: Column) -> Column:
    return F.regexp_extract(c, r"[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")


OPS = {"trim": F.trim, "casefold": F.lower, "plain": plain, "join_hyphens": lambda c: F.regexp_replace(c, r"-\s*\n\s*", ""), "collapse_ws": lambda c: F.regexp_replace(c, r"\s+", " "), "drop_ws": lambda c: F.regexp_replace(c, r"\s+", "")}


def apply_ops(c: Column, ops: list[str]) -> Column:
    """Canonicalization steps in the order given; an unknown step is refused."""
    if unknown := set(ops) - set(OPS):
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    return reduce(lambda x, op: OPS[op](x), ops, c)


def fingerprint(c: Column) -> Column:
    return F.sha2(c, 256)


def framed(*parts: Column) -> Column:
    """Digest of several values, each led by its length in 8 bytes, so that no two splits coincide."""
    frame = lambda c: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(c)), 16, "0")), c.cast("binary"))
    return F.sha2(F.concat(*(frame(F.coalesce(c, F.lit(""))) for c in parts)), 256)


def sorted_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with its keys in order."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def file_key(c: Column) -> Column:
    """The label that an image file belongs to: lower case, without extension and the name of one of the two faces."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\.(jpg|jpeg|png)$", ""), "-(front|back)$", "")


def file_face(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace(F.lower(F.trim(c)), r"\.(jpg|jpeg|png)$", ""), "-(front|back)$", 1), F.lit("")), F.lit("front"))


def trade_names(c: Column, mark: str = "(used on label)") -> Column:
    """Names that stand before each mark, after the last ZIP code of an address block."""
    tail = F.regexp_replace(c, r"(?s)^.*\b\d{5}(-\d{4})?\b", "")
    parts = F.split(tail, r"(?i)" + mark.replace("(", r"\(").replace(")", r"\)"))
    named = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.trim(F.regexp_replace(x, r"^[\s,;]+|[\s,;]+$", "")))
    return F.array_distinct(F.filter(named, lambda x: x != ""))


_TARGET = "struct<title:int,part:string,section:string,subpart:string,paragraph:string>"


def citations(c: Column) -> Column:
    """Targets of a regulation citation such as "27 CFR §5.63(a), §5 Subpart I, Subpart J": array of (title, part, section,
    subpart, paragraph); null if any part of it can't be read. The title leads; it may change on the way, and a subpart
    takes the part of the reference before it, within one title."""
    title_, section_, part_, bare_ = r"^(\d+)\s+CFR\s*(.*)$", r"^§\s*(\d+)\.(\d+[a-z]?)((?:\([^()]+\))*)$", r"^§\s*(\d+)\s+Subpart\s+([A-Z]+)$", r"^Subpart\s+([A-Z]+)$"
    none, group = F.lit(None).cast("string"), lambda x, p, i: F.nullif(F.regexp_extract(x, p, i), F.lit(""))
    start = F.struct(none.cast("int").alias("title"), none.alias("part"), F.array().cast(f"array<{_TARGET}>").alias("acc"), F.lit(True).alias("ok"))

    def step(s: Column, chunk: Column) -> Column:
        x = F.trim(chunk)
        anew = x.rlike(title_)
        ref = F.when(anew, F.trim(F.regexp_extract(x, title_, 2))).otherwise(x)
        title, kept = F.coalesce(group(x, title_, 1).cast("int"), s.title), F.when(~anew, s.part)
        part = F.coalesce(group(ref, section_, 1), group(ref, part_, 1), kept)
        number = F.when(ref.rlike(section_), F.concat(part, F.lit("."), F.regexp_extract(ref, section_, 2)))
        subpart = F.coalesce(group(ref, part_, 2), group(ref, bare_, 1))
        good = s.ok & title.isNotNull() & (ref.rlike(section_) | ref.rlike(part_) | (ref.rlike(bare_) & part.isNotNull()))
        target = F.struct(title.alias("title"), part.alias("part"), number.alias("section"), subpart.alias("subpart"), group(ref, section_, 3).alias("paragraph")).cast(_TARGET)
        return F.struct(title.alias("title"), part.alias("part"), F.when(good, F.concat(s.acc, F.array(target))).otherwise(s.acc).alias("acc"), good.alias("ok"))

    return F.aggregate(F.split(c, ","), start, step, lambda s: F.when(s.ok, s.acc))


def target_key(t: Column) -> Column:
    """The name under which a citation's target is kept: title and section, or title, part and subpart."""
    return F.coalesce(F.concat_ws(" ", t.title.cast("string"), F.when(t.subpart.isNull(), t.section).otherwise(F.concat(t.part, F.lit(" Subpart "), t.subpart))), F.lit(""))


def uncertain_code(code: Column) -> Column:
    """The code that stands for an uncertain reading in the same bin."""
    return F.concat(F.split_part(code, F.lit("."), F.lit(1)), F.lit(".READ.UNCERTAIN"))


def version_key(c: Column) -> Column:
    """Version parts as numbers, so that 0.10.0 comes after 0.2.0."""
    return F.transform(F.split(c, r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^\d+", 0).try_cast("int"), F.lit(0)))
