"""Free-entered values mapped to a canonical list: a partition-based pigeonhole join, in SQL expressions only.

A value becomes a *key*: plain letters, its parts in natural order, common abbreviations written out, company forms and
batch marks taken off, no blanks. Up to ``typos`` typing errors (a letter missing, doubled, wrong, or two neighbours
swapped) are k = 2 * typos edits at most, so each reference key is cut into k + 1 segments, of which a value keeps at least one,
moved by at most ``typos`` places, as a swap moves nothing. Values and references meet in an equality join on (list, length, segment number, substring);
the built-in levenshtein and a count of the letters verify them; what finds no reference is reported with entry 0.
All values go this way, those with the key of a reference too.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayist.functions.characters import plain
from assayist.session import BROADCAST_ROWS, small, spread, written

#: Learnt abbreviations that one expression writes out; more are joined, with the same keys.
AT_ONCE = 50
#: Common trade abbreviations in classes. Those of names are learnt (:func:`learnt`).
TRADE = {"str": "straight", "liq": "liqueur", "flav": "flavored", "bl": "blended", "carb": "carbonated", "dist": "distilled", "bev": "beverage", "whsky": "whiskey", "whisky": "whiskey", "vdka": "vodka", "xing": "crossing", "spklg": "sparkling"}
#: What is said around a name without being part of it.
AROUND = [r"\([^)]*\)", r"batch\s*\d+", r"lot\s*[a-z0-9]\b", r"\b\d+\b", r"(?<=[a-z]{3})\d+\b", r"&\s*sons\b", r"\b(brewing|distilling)\s*company\b", r"(brewing|distilling)company$", r"\b(brewing|distilling)\s*co\b\.?", r"(brewing|distilling)co\.?$", r"\bco\b\.?", r"\bcompany\b", r"\b(cellars|brand)\b"]
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789&"


def _opened(col: Column) -> Column:
    """A value as it is read: plain letters, parts in natural order, without what is said around it."""
    the = lambda c: F.regexp_replace(c, r"^\s*(the\b[\s-]*)+", "")
    s = the(F.regexp_replace(F.lower(plain(col)), r"[-_]+", " "))
    s = the(F.regexp_replace(s, r"^([^,]+?)\s*,\s*(.+)$", "$2 $1"))
    s = F.regexp_replace(s, r"(?<=\d)(?=[a-z]{3})", " ")
    return F.regexp_replace(s, "|".join(AROUND), " ")


def _closed(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9&]", ""), "^(the)+", ""), r"(&sons|(brewing|distilling)?co(mpany)?|cellars|brand)+$", "")


def key(col: Column, short: dict[str, str] | None = None) -> Column:
    """The comparable key of a value: letters, digits and '&' only; empty if none are left. ``short``: abbreviations to write out."""
    s = _opened(col)
    for a, b in sorted((TRADE | (short or {})).items()):
        # with a point also inside a word, if it has letters enough; never the initial of several
        s = F.regexp_replace(s, rf"{a}\.(?!\w\.)" if len(a) > 2 else rf"\b{a}\.(?=\s*[a-z])(?!\w\.)", f"{b} ")
        s = F.regexp_replace(s, rf"{a}\b", b) if len(a) > 2 else s
    return _closed(s)


def keyed(rows: DataFrame, value: str, name: str, short: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """``rows`` with the key of the column ``value`` as ``name``. ``short``: all abbreviations (short, word), of any number.

    More than ``at_once`` of them meet the ends of the words in joins: each round writes out the next one of a text, in the
    order of :func:`key`, until none fits; a text takes as many rounds as abbreviations stand in it.
    """
    few = short.limit(at_once + 1).collect()
    if len(few) <= at_once:
        return rows.withColumn(name, key(F.col(value), {r["short"]: r["word"] for r in few}))
    trade = rows.sparkSession.createDataFrame(list(TRADE.items()), "short string, word string")
    known = small(written(short.unionByName(trade.join(short, "short", "left_anti")), "known"))
    runs = F.filter(F.regexp_extract_all("s", F.lit(r"([a-z0-9_]+)"), 1), lambda r: F.length(r) > 1)
    tails = F.explode(F.array_distinct(F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.length(r)))))))
    is_long, put = F.length("short") > 2, lambda pre, post: F.concat(F.lit(pre), "short", F.lit(post))
    out = F.regexp_replace("s", F.when(is_long, put("", r"\.(?!\w\.)")).otherwise(put(r"\b", r"\.(?=\s*[a-z])(?!\w\.)")), F.concat("word", F.lit(" ")))
    out = F.when(is_long, F.regexp_replace(out, put("", r"\b"), F.col("word"))).otherwise(out)
    texts = rows.withColumn("text", _opened(F.col(value)))
    now = written(texts.select("text").distinct().select("text", F.col("text").alias("s"), F.lit("").alias("last")), "texts")
    done = []
    while not now.isEmpty():
        fit = now.select("*", tails.alias("short")).join(known, "short").filter(F.col("short") > F.col("last")).withColumn("out", out).filter(F.col("out") != F.col("s"))
        then = written(fit.groupBy("text").agg(F.min(F.struct("short", "out")).alias("b")).select("text", F.col("b.out").alias("s"), F.col("b.short").alias("last")), "texts")
        done.append(now.join(then.select("text"), "text", "left_anti").select("text", "s"))
        now = then
    if not done:
        return rows.withColumn(name, F.lit(None).cast("string"))
    return texts.join(reduce(DataFrame.unionByName, done), "text").select(*rows.columns, _closed(F.col("s")).alias(name))


def learnt(values: DataFrame, refs: DataFrame, support: int = 3, rounds: int | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """What values write in place of one word of a reference, in ``support`` different references or more: (short, word), all there are.

    ``values``: value; ``refs``: name. A value and a name meet in an equality join on their words with one left open;
    the word of the value is known in no name and has the first letter of the name's, and others of its letters in their
    order. Further rounds read the values with what is learnt written out, until nothing more is learnt (or ``rounds`` are
    over); what is learnt is no unknown word any more, so they end. A short form that stands for several words is none.
    """
    read = lambda c: F.regexp_extract_all(F.lower(plain(F.col(c))), F.lit(r"([a-z0-9&]+)"), 1)
    opened = lambda w: F.transform(w, lambda x, i: F.struct(x.alias("word"), F.array_join(F.transform(w, lambda y, j: F.when(i == j, "*").otherwise(y)), " ").alias("frame")))
    names = refs.select(read("name").alias("w")).filter(F.size("w") > 1).distinct()
    known = names.select(F.explode("w").alias("word")).distinct()
    b = small(names.select(F.explode(opened(F.col("w"))).alias("o")).select("o.word", "o.frame"))
    spelled = written(values.select(read("value").alias("w")).filter(F.size("w") > 1).distinct(), "words")
    in_order = F.rlike("word", F.concat(F.lit("^"), F.regexp_replace("short", "(.)", "$1.*")))
    found = values.sparkSession.createDataFrame([], "short string, word string")
    done = 0
    while rounds is None or done < rounds:
        a = _reworded(spelled, found, at_once).select(F.explode(opened(F.col("w"))).alias("o")).select(F.col("o.word").alias("short"), "o.frame")
        a = a.filter((F.length("short") > 1) & F.col("short").rlike("^[a-z]+$")).join(small(known), F.col("short") == F.col("word"), "left_anti")
        met = a.join(b, "frame").filter((F.length("word") - F.length("short") > 1) & in_order)
        counted = met.groupBy("short", "word").agg(F.countDistinct("frame").alias("n"))
        best = counted.groupBy("short").agg(F.max(F.struct("n", "word")).alias("b"), F.sum("n").alias("all")).filter((F.col("b.n") >= support) & (F.col("b.n") > 0.8 * F.col("all")))
        new = written(best.select("short", "b.word"), "abbreviations")
        if new.isEmpty():
            break
        found, done = found.unionByName(new) if done else new, done + 1
    return found


def abbreviations(values: DataFrame, refs: DataFrame, support: int = 3, rounds: int | None = None) -> dict[str, str]:
    """What is :func:`learnt`, as {short: word}."""
    return {r["short"]: r["word"] for r in learnt(values, refs, support, rounds).collect()}


def _reworded(spelled: DataFrame, found: DataFrame, at_once: int) -> DataFrame:
    """Lists of words (w) with what is ``found`` written out."""
    few = found.limit(at_once + 1).collect()
    if not few:
        return spelled
    if len(few) <= at_once:
        out = F.create_map(*(F.lit(x) for r in few for x in (r["short"], r["word"])))
        return spelled.select(F.transform("w", lambda x: F.coalesce(F.try_element_at(out, x), x)).alias("w"))
    each = spelled.select("w", F.posexplode("w").alias("i", "short")).join(small(found), "short", "left")
    lists = each.groupBy("w").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("word", "short").alias("x")))).alias("l"))
    return lists.select(F.transform("l", lambda e: e["x"]).alias("w"))


def _typos(a: Column, b: Column, counts_a: Column, counts_b: Column, distance: Column) -> Column:
    """Typing errors between two keys: letters that differ count one each, the rest of the distance is swaps of two."""
    moved = F.aggregate(F.zip_with(counts_a, counts_b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    bag = (moved + F.abs(F.length(a) - F.length(b))) / F.lit(2)
    return bag + F.greatest(distance - bag, F.lit(0)) / F.lit(2)


def _counts(k: Column) -> Column:
    return F.transform(F.array(*(F.lit(c) for c in _LETTERS)), lambda c: F.length(k) - F.length(F.replace(k, c, F.lit(""))))


def segments(refs: DataFrame, k: int) -> DataFrame:
    """References (list, entry, ref) cut into k+1 segments: adds n (length), seg and piece."""
    n = F.length("ref")
    cut = lambda i: F.floor(n * F.lit(i) / F.lit(k + 1)).cast("int")
    pieces = F.array(*(F.struct(F.lit(i).alias("seg"), F.substring(F.col("ref"), cut(i) + 1, cut(i + 1) - cut(i)).alias("piece")) for i in range(k + 1)))
    return refs.select("*", n.alias("n"), F.explode(pieces).alias("p")).select(*refs.columns, "n", "p.*")


def probes(values: DataFrame, k: int, typos: int) -> DataFrame:
    """Substrings of values (list, key, lengths) that a segment of a reference of one of the ``lengths`` may equal.

    A surviving segment is moved by what was put in or left out before it, and the rest of the length's change lies
    behind it: |shift| + |change - shift| <= typos.
    """
    moves = [(d, s) for d in range(-typos, typos + 1) for s in range(-typos, typos + 1) if abs(s) + abs(d - s) <= typos]
    shapes = F.array(*(F.struct(F.lit(i).alias("seg"), F.lit(d).alias("d"), F.lit(s).alias("s")) for i in range(k + 1) for d, s in moves))
    m = F.length("key")
    rows = values.select("list", "key", F.explode(F.filter(shapes, lambda p: F.array_contains("lengths", m - p.d))).alias("p"))
    n = m - F.col("p.d")
    cut = lambda i: F.floor(n * i / F.lit(k + 1)).cast("int")
    start, size = cut(F.col("p.seg")) + F.col("p.s"), cut(F.col("p.seg") + 1) - cut(F.col("p.seg"))
    rows = rows.select("list", "key", n.alias("n"), F.col("p.seg").alias("seg"), start.alias("start"), size.alias("size"), m.alias("m"))
    rows = rows.filter((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("m")))
    return rows.select("list", "key", "n", "seg", F.substring(F.col("key"), F.col("start") + 1, F.col("size")).alias("piece"))


def short_pairs(values: DataFrame, refs: DataFrame, side: Callable[[DataFrame], DataFrame], k: int, typos: int) -> DataFrame:
    """Pairs (list, key, entry, ref) of which one has at most k letters, with lengths at most ``typos`` apart."""
    brief = lambda c: F.length(c).between(1, k + typos)
    by_length = refs.filter(brief("ref")).select("list", "entry", "ref", F.length("ref").alias("n"))
    near = values.filter(brief("key")).select("list", "key", F.explode(F.sequence(F.length("key") - typos, F.length("key") + typos)).alias("n"))
    return near.join(side(by_length), ["list", "n"]).filter(F.least(F.length("key"), F.length("ref")) <= k).select("list", "key", "entry", "ref")


def pigeonhole(values: DataFrame, refs: DataFrame, typos: int = 2) -> DataFrame:
    """The nearest reference of each distinct (list, key), within ``typos`` typing errors: (list, key, entry).

    ``refs``: (list, entry, ref). A tie in errors goes to the smaller distance, then to the smaller entry. Keys without a
    reference are left out. A pair with a key of at most k = 2 * typos letters, too short to cut, meets by its lengths. The references are
    broadcast if there are few of them, else all joins shuffle.
    """
    k = 2 * typos
    few = refs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = F.broadcast if few else lambda df: df
    long = refs.filter(F.length("ref") > k)
    lengths = long.groupBy("list").agg(F.collect_set(F.length("ref")).alias("lengths"))
    cut = segments(long, k)
    wanted = values.filter(F.length("key") > k).join(small(lengths), "list")
    pairs = probes(wanted, k, typos).join(side(cut.select("list", "n", "seg", "piece", "entry", "ref")), ["list", "n", "seg", "piece"]).select("list", "key", "entry", "ref").distinct()
    near = pairs.unionByName(short_pairs(values, refs, side, k, typos)).select("*", F.levenshtein("key", "ref", k).alias("distance")).filter(F.col("distance") >= 0)
    rated = near.select("list", "key", "entry", "distance", _typos(F.col("key"), F.col("ref"), _counts(F.col("key")), _counts(F.col("ref")), F.col("distance")).alias("typos")).filter(F.col("typos") <= typos)
    best = rated.groupBy("list", "key").agg(F.min(F.struct("typos", "distance", "entry")).alias("b"))
    return best.select("list", "key", F.col("b.entry").alias("entry"))


def named_values(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """Both values of the findings of the entries' fields, as (finding_id, list, side, value); blank ones left out."""
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_value").alias("value")) for s in ("extracted", "expected"))))
    lists = entries.select(F.col("field_name").alias("list")).distinct()
    rows = findings.select("finding_id", F.col("field_name").alias("list"), sides.alias("v")).select("finding_id", "list", "v.side", "v.value")
    return rows.filter(F.trim(F.coalesce("value", F.lit(""))) != "").join(small(lists), "list", "left_semi")


def canonicalized(findings: DataFrame, entries: DataFrame, typos: int = 2) -> DataFrame:
    """(finding_id, side, entry_id) of every non-blank value that isn't a canonical name as it stands; 0 for none.

    ``findings``: finding_id, field_name, extracted_value, expected_value; ``entries``: entry_id, field_name,
    canonical_name. Values are matched once for each distinct spelling. Null and blank values have no row; values that
    a reader sees as blank, or that hold no letter, have entry 0; an empty list gives 0 throughout.
    """
    entries = entries.select("entry_id", "field_name", "canonical_name").filter(F.col("canonical_name").isNotNull())
    rows = named_values(findings, entries)
    exact = entries.select(F.col("field_name").alias("list"), F.col("canonical_name").alias("value")).distinct()
    rows = rows.join(small(exact), ["list", "value"], "left_anti")
    values = written(rows.select("list", "value").distinct(), "values")
    short = learnt(values.select("value"), entries.select(F.col("canonical_name").alias("name")))
    spelled = written(keyed(spread(values).select("list", "value"), "value", "key", short), "spellings")
    refs = written(keyed(entries.select(F.col("field_name").alias("list"), F.col("entry_id").alias("entry"), "canonical_name"), "canonical_name", "ref", short).drop("canonical_name"), "references")
    matched = pigeonhole(spread(spelled.select("list", "key").filter(F.col("key") != "").distinct()), refs, typos)
    meaning = spelled.join(matched, ["list", "key"]).select("list", "value", "entry")
    return rows.join(meaning, ["list", "value"], "left").select("finding_id", "side", F.coalesce("entry", F.lit(0)).cast("bigint").alias("entry_id"))
