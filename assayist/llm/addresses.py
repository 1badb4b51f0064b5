"""Same postal address written differently: blocking, component comparison and probabilistic linkage by EM.

Addresses are parsed into components (in Arrow batches, once for each distinct spelling), and the town of a post code and
the post code of a town, as most rows have them, fill gaps. Equal component rows become one *record*; records are paired
within blocks (house number with post code; house number with the street's sound, first or last letters and the town's sound or
last letters; without a town, house number with the street), and each pair becomes a pattern of agreement levels, from
the same over two grades of likeness to different, missing among them. The patterns are counted, so the EM that estimates
the weights works on a table of at most 6**6 rows. The weights decide: a pair whose probability reaches the threshold is a link. Links of records are
expanded to the rows that the records stand for.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayist.functions.characters import plain_text
from assayist.session import small, written

#: Postal codes of the states, and the names and older abbreviations that stand for them.
STATES = {
    "AL": "alabama ala", "AK": "alaska", "AZ": "arizona ariz", "AR": "arkansas ark", "CA": "california calif cal", "CO": "colorado colo", "CT": "connecticut conn", "DE": "delaware del", "DC": "districtofcolumbia", "FL": "florida fla",
    "GA": "georgia", "HI": "hawaii", "ID": "idaho", "IL": "illinois ill", "IN": "indiana ind", "IA": "iowa", "KS": "kansas kans", "KY": "kentucky", "LA": "louisiana", "ME": "maine", "MD": "maryland", "MA": "massachusetts mass",
    "MI": "michigan mich", "MN": "minnesota minn", "MS": "mississippi miss", "MO": "missouri", "MT": "montana mont", "NE": "nebraska nebr neb", "NV": "nevada nev", "NH": "newhampshire", "NJ": "newjersey", "NM": "newmexico nmex", "NY": "newyork", "NC": "northcarolina ncar",
    "ND": "northdakota ndak", "OH": "ohio o", "OK": "oklahoma okla", "OR": "oregon ore oreg", "PA": "pennsylvania penna penn", "RI": "rhodeisland", "SC": "southcarolina scar", "SD": "southdakota sdak", "TN": "tennessee tenn", "TX": "texas tex", "UT": "utah", "VT": "vermont",
    "VA": "virginia", "WA": "washington wash", "WV": "westvirginia wva", "WI": "wisconsin wis wisc", "WY": "wyoming wyo",
}
#: Types of streets and their abbreviations.
TYPES = {
    "avenue": "ave av aven avn", "boulevard": "blvd boul bvd", "circle": "cir", "court": "ct crt", "drive": "dr drv", "highway": "hwy hiway hway", "lane": "ln", "parkway": "pkwy pky pkway", "place": "pl", "road": "rd", "square": "sq",
    "street": "st str strt", "terrace": "ter terr", "trail": "trl", "turnpike": "tpke", "alley": "aly", "way": "wy",
}
#: Directions, parts of town names, what introduces a part of a building or a house number.
DIRECTIONS = {"n": "north no", "s": "south so", "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest"}
TOWN = {"saint": "st", "fort": "ft", "mount": "mt", "springs": "spgs sprgs spg", "heights": "hts", "north": "n", "south": "s", "east": "e", "west": "w", "point": "pt", "junction": "jct"}
_UNIT = r"\b(?:suite|ste|apt|apartment|unit|floor|fl|bldg|building|room|rm)\s*#?\s*(?:\d+[a-z]?|[a-z])\b|\b\d+(?:st|nd|rd|th)\s+(?:floor|fl)\b"
_NO_PLACE = re.compile(r"\bp\s*o\s*box\b|\bpost\s*(?:office)?\s*box\b|^\s*box\s+\d|\bgeneral delivery\b")
_flip = lambda d: {x: k for k, v in d.items() for x in (k.lower(), *v.split())}
_STATE, _TYPE, _DIR, _TOWN = _flip(STATES), _flip(TYPES), _flip(DIRECTIONS), _flip(TOWN)
_STATE_RE = "|".join(sorted({*(k for k in _STATE if k != "o"), "new york", "new jersey", "new mexico", "new hampshire", "north carolina", "south carolina", "north dakota", "south dakota", "rhode island", "west virginia", "n y", "n j", "n h", "n m", "n c", "s c", "n d", "s d", "r i", "w va", "district of columbia"}, key=len, reverse=True))
_ZIP = r"(\d{5})(?:\s*-?\s*\d{4})?"
_PATTERNS = [re.compile(p) for p in (rf"^{_ZIP}\s+(?P<city>[a-z ]+?)[\s,]+(?P<state>{_STATE_RE})\s+-\s+(?P<street>.+)$", rf"^(?P<city>[a-z ]+?)[\s,]+(?P<state>{_STATE_RE})\s+{_ZIP}\s*,\s*(?P<street>.+)$", rf"^(?P<both>.+?)[\s,]+(?P<state>{_STATE_RE})\s+{_ZIP}$")]
FIELDS = ["number", "name", "type", "direction", "town", "state", "zip"]


def _clean(s: str | None) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[.|;]", " ", plain_text(s).lower())).strip(" ,") if s else ""


def _state(s: str) -> str | None:
    return _STATE.get(s.replace(" ", ""))


def _town(s: str) -> str:
    words = re.findall(r"[a-z]+", s)
    return "".join(_TOWN.get(w, w) if len(words) > 1 else w for w in words)


def _split(both: str) -> tuple[str, str]:
    """A street and a town without a mark between them: the street ends with its type, direction or number."""
    both = re.sub(_UNIT, ",", both)
    parts = [p.strip() for p in both.split(",") if p.strip()]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = both.split()
    digit = next((i for i, w in enumerate(words) if re.search(r"\d", w)), -1)
    end = next((i for i, w in enumerate(words) if w in _TYPE and i > 0 and any(x.isalpha() and x not in _DIR for x in words[:i])), None)
    if end is None:
        end = digit + 1 if words[digit + 1 : digit + 2] and words[digit + 1] not in _DIR else digit + 2
        end = digit if digit > 0 else end
    elif words[end + 1 : end + 2] and words[end + 1] in _DIR and len(words) > end + 2:
        end += 1
    end = max(end, digit)
    return " ".join(words[: end + 1]), " ".join(words[end + 1 :])


def _street(s: str) -> tuple[str, str, str | None, str | None] | None:
    """(number, name, type, direction) of a street line; None without a house number."""
    if _NO_PLACE.search(s):
        return None
    s = re.sub(r"[,\-]", " ", re.sub(_UNIT, " ", s))
    s = re.sub(r"\b(?:no|nr|num|number)\s+(?=\d)|#\s*(?=\d)", " ", s)
    words = re.findall(r"[a-z']+|\d+[a-z]?\b", s)
    at = next((i for i, w in enumerate(words) if w[0].isdigit()), None)
    if at is None:
        return None
    number = words[at].lstrip("0")
    rest = [w.replace("'", "") for i, w in enumerate(words) if i != at and not w[0].isdigit()]
    direction = kind = None
    if len(rest) > 1 and rest[-1] in _DIR:
        direction = _DIR[rest.pop()]
    if len(rest) > 1 and rest[-1] in _TYPE:
        kind = _TYPE[rest.pop()]
    if len(rest) > 1 and rest[-1] in _DIR and direction is None:
        direction = _DIR[rest.pop()]
    if len(rest) > 1 and rest[0] in _DIR and direction is None:
        direction = _DIR[rest.pop(0)]
    return (number, "".join(rest), kind, direction) if rest and number else None


def parse(street: str | None, city: str | None, state: str | None, zip_code: str | None) -> tuple[str | None, ...] | None:
    """FIELDS of an address, None for a part that is missing; None for what has no house number and street."""
    st, ci, sa, zi = map(_clean, (street, city, state, zip_code))
    if m := re.match(rf"^(.+?)[\s,]+{_ZIP}$", zi):
        sa, zi = sa or m[1], m[2]
    if not (ci or sa or zi):
        for p in _PATTERNS:
            if m := p.match(st):
                g = m.groupdict()
                st, ci = (g["street"], g["city"]) if "street" in g else _split(g["both"])
                sa, zi = g["state"], next(x for x in m.groups() if x and re.fullmatch(r"\d{5}", x))
                break
    if m := re.match(rf"^(.+?)\s*,\s*({_STATE_RE})$", ci):
        ci, sa = m[1], sa or m[2]
    z = re.match(_ZIP, zi)
    if not (line := _street(st)):
        return None
    return (*line, _town(ci) or None, _state(sa) if sa else None, z[1] if z else None)


def _parse(street: pa.Array, city: pa.Array, state: pa.Array, zip_code: pa.Array) -> pa.Array:
    seen: dict[tuple, tuple | None] = {}
    out = []
    for row in zip(*(a.to_pylist() for a in (street, city, state, zip_code)), strict=True):
        if row not in seen:
            seen[row] = parse(*row)
        out.append(dict(zip(FIELDS, seen[row], strict=True)) if seen[row] else None)
    return pa.array(out, pa.struct([(f, pa.string()) for f in FIELDS]))


parsed = F.arrow_udf(_parse, T.StructType([T.StructField(f, T.StringType()) for f in FIELDS]))


def completed(rows: DataFrame) -> DataFrame:
    """Fill a missing town or state from the post code, and a missing post code from town and state, by majority.

    A town that is near its post code's usual one takes that one's spelling.
    """
    towns = rows.filter("zip is not null and town is not null and state is not null").groupBy("zip", "town", "state").count()
    usual = towns.groupBy("zip").agg(F.max(F.struct("count", "town", "state")).alias("u")).filter("u.count > 1").select("zip", F.col("u.count").alias("n"), F.col("u.town").alias("town_u"), F.col("u.state").alias("state_u"))
    usual = written(usual, "towns")
    codes = usual.groupBy(F.col("town_u").alias("town"), F.col("state_u").alias("state")).agg(F.max(F.struct("n", "zip")).alias("c"), F.sum("n").alias("all")).filter("c.n > 0.8 * all").select("town", "state", F.col("c.zip").alias("zip_u"))
    known = rows.join(small(usual), "zip", "left")
    near = F.levenshtein("town", "town_u", 3) >= 0
    fits = F.col("town_u").isNotNull() & (F.col("town").isNull() | near) & (F.col("state").isNull() | (F.col("state") == F.col("state_u")))
    town = F.when(fits, F.col("town_u")).otherwise(F.col("town"))
    state = F.when(fits, F.col("state_u")).otherwise(F.col("state"))
    keep = [c for c in rows.columns if c not in ("town", "state", "zip")]
    filled = known.select(*keep, town.alias("town"), state.alias("state"), "zip")
    return filled.join(small(codes), ["town", "state"], "left").select(*keep, "town", "state", F.coalesce("zip", "zip_u").alias("zip"))


#: Levels of agreement of a component.
SAME, TYPED, NEAR, FAR, DIFFERENT, MISSING = range(6)


def _letters(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, "")), "")


def _typed(a: Column, b: Column) -> Column:
    """At most one typing error: a letter missing, doubled or wrong, or two neighbours swapped."""
    d = F.levenshtein(a, b, 2)
    return (d == 0) | (d == 1) | ((d == 2) & (F.length(a) == F.length(b)) & (_letters(a) == _letters(b)))


def _level(a: Column, b: Column, *grades: tuple[Column, int]) -> Column:
    """The level of two values: missing, the same, the first grade that holds, else different."""
    out = F.when(a.isNull() | b.isNull(), MISSING).when(a == b, SAME)
    for holds, level in grades:
        out = out.when(holds, level)
    return out.otherwise(DIFFERENT)


def _spelled(a: Column, b: Column) -> list[tuple[Column, int]]:
    """Grades of likeness of two names, by the edits in proportion to their letters (at most three)."""
    edits = F.levenshtein(a, b, 3)
    share = edits / F.greatest(F.length(a), F.length(b))
    return [(_typed(a, b), TYPED), ((edits >= 0) & (share <= 0.3), NEAR), ((edits >= 0) & (share <= 0.6), FAR)]


def block_keys(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys, street keys) of records, as hashes: the first within a post code or town, the second by street alone.

    All hold the house number. A missing town agrees with any, so records without one meet the others by street alone.
    """
    n, name, town = F.col("number"), F.col("name"), F.col("town")
    streets = [F.soundex(name), F.concat(F.lit("p"), F.substring(name, 1, 3)), F.concat(F.lit("e"), F.substring(name, -3, 3))]
    towns = [F.soundex(town), F.concat(F.lit("e"), F.substring(town, -3, 3))]
    near = [F.when(F.col("zip").isNotNull(), F.xxhash64(F.lit("z"), n, "zip")), *(F.when(town.isNotNull(), F.xxhash64(n, s, t)) for s in streets for t in towns)]
    keys = r.select("rec", F.explode(F.filter(F.array(*near), lambda k: k.isNotNull())).alias("block"))
    return keys, r.select("rec", town.isNull().alias("open"), F.explode(F.array(*(F.xxhash64(n, s) for s in streets))).alias("block"))


LEVELS = ["l_name", "l_type", "l_direction", "l_town", "l_state", "l_zip"]


def compared(records: DataFrame) -> DataFrame:
    """Pairs of records of a block with one house number, each once, with their agreement levels."""
    keys, streets = block_keys(records)
    near = keys.alias("a").join(keys.alias("b"), (F.col("a.block") == F.col("b.block")) & (F.col("a.rec") < F.col("b.rec"))).select(F.col("a.rec").alias("a"), F.col("b.rec").alias("b"))
    open_ = small(streets.filter("open").select(F.col("rec").alias("o"), "block"))
    any_town = streets.join(open_, "block").filter("rec <> o").select(F.least("rec", "o").alias("a"), F.greatest("rec", "o").alias("b"))
    side = lambda s: records.select(F.col("rec").alias(s), *(F.col(f).alias(f"{s}_{f}") for f in FIELDS))
    p = near.unionByName(any_town).distinct().join(side("a"), "a").join(side("b"), "b").filter("a_number = b_number")
    a, b = (lambda f, s=s: F.col(f"{s}_{f}") for s in "ab")
    same = lambda f: _level(a(f), b(f))
    name, town = (_level(a(f), b(f), *_spelled(a(f), b(f))) for f in ("name", "town"))
    code = _level(a("zip"), b("zip"), (_typed(a("zip"), b("zip")), TYPED), (_letters(a("zip")) == _letters(b("zip")), NEAR))
    return p.select("a", "b", *(v.alias(c) for c, v in zip(LEVELS, (name, same("type"), same("direction"), town, same("state"), code), strict=True)))


#: Shares of the levels among matches and among others that the estimation starts from.
START = [0.7, 0.1, 0.04, 0.02, 0.02, 0.12], [0.2, 0.03, 0.05, 0.1, 0.5, 0.12]


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60, error: float = 1e-6, prior: float = 50.0) -> dict[tuple[int, ...], float]:
    """EM of the Fellegi-Sunter model over counted patterns of levels; gives each pattern's probability of a match.

    Two records of one place never differ outright in a component but by an error of the source, which ``error`` bounds the
    share of; everything else is estimated. The starting shares count as ``prior`` pairs, so that a handful of pairs doesn't
    overturn them.
    """
    if not patterns:
        return {}
    x = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    width = x.shape[1]
    share, m, u = 0.1, np.array([START[0]] * width), np.array([START[1]] * width)
    for _ in range(rounds):
        odds = math.log(share / (1 - share)) + sum(np.log(m[i, x[:, i]]) - np.log(u[i, x[:, i]]) for i in range(width))
        post = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        share = min(max(float((n * post).sum() / n.sum()), 1e-6), 1 - 1e-6)
        m, u = (np.array([(prior * np.array(s) + np.bincount(x[:, i], n * w, MISSING + 1)) / (prior + (n * w).sum()) for i in range(width)]) for w, s in ((post, START[0]), (1 - post, START[1])))
        m[:, DIFFERENT] = np.minimum(m[:, DIFFERENT], error)
        m /= m.sum(axis=1, keepdims=True)
    return {p: float(v) for (p, _), v in zip(patterns, post, strict=True)}


def linked(records: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs of records (a, b, probability) that denote one place by the estimated weights.

    The patterns (at most 6**6) are all that reaches the driver.
    """
    pairs = written(compared(records), "pairs")
    counted = sorted((tuple(r)[:-1], r[-1]) for r in pairs.groupBy(*LEVELS).count().collect())
    weights = records.sparkSession.createDataFrame([(*x, p) for x, p in estimate(counted).items()], ", ".join(f"{c} int" for c in LEVELS) + ", probability double")
    return pairs.join(F.broadcast(weights), LEVELS).filter(F.col("probability") >= threshold).select("a", "b", "probability")


def located(rows: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(members, records): the record of each row that has a street and number, and the records' components.

    Records are named by a 128-bit hash of their components, so that they come out alike after a lost task.
    """
    one = rows.select(F.col(id_col).alias("id"), parsed("street", "city", "state", "zip").alias("p"))
    parts = written(one, "parsed").filter(F.col("p").isNotNull()).select("id", "p.*")  # filtered behind the function, else it runs twice
    full = completed(parts)
    rec = F.unhex(F.md5(F.concat_ws("\1", *(F.coalesce(F.col(f), F.lit("\0")) for f in FIELDS))))
    members = written(full.select("id", rec.alias("rec"), *FIELDS), "members")
    return members.select("id", "rec"), written(members.groupBy("rec").agg(*(F.first(f).alias(f) for f in FIELDS)), "records")


def places(rows: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(members, links): the record of each row, named by its smallest id, and the links between records.

    members: id, record; links: record_a < record_b, probability. Rows with one record denote one place; so do rows of
    linked records. This is the result without its pairs written out; :func:`same_place` writes them.
    """
    members, records = located(rows, id_col)
    named = written(members.groupBy("rec").agg(F.min("id").alias("record")), "named")
    a, b = (named.select(F.col("rec").alias(s), F.col("record").alias(f"r_{s}")) for s in "ab")
    links = linked(records).join(a, "a").join(b, "b").select(F.least("r_a", "r_b").alias("record_a"), F.greatest("r_a", "r_b").alias("record_b"), "probability")
    return members.join(named, "rec").select("id", "record"), links


def same_place(rows: DataFrame, id_col: str) -> DataFrame:
    """All pairs of ids (a < b) whose addresses denote the same place.

    ``rows``: street, city, state, zip and a unique ``id_col``. Null, empty and placeholder addresses, post boxes and
    what has no house number are in no pair; rows with equal components pair with each other.
    """
    members, links = places(rows, id_col)
    members, links = written(members, "members"), written(links, "links")
    own = members.select(F.col("record").alias("a"), F.col("record").alias("b")).distinct()
    both = links.select(F.col("record_a").alias("a"), F.col("record_b").alias("b")).unionByName(links.select(F.col("record_b").alias("a"), F.col("record_a").alias("b"))).unionByName(own)
    left = members.select(F.col("id").alias("id_a"), F.col("record").alias("a"))
    right = members.select(F.col("id").alias("id_b"), F.col("record").alias("b"))
    return left.join(both, "a").join(right, "b").filter("id_a < id_b").select("id_a", "id_b")
