"""Quantities recorded in different units: readings of a text, and the units that a physical identity singles out.

A *reading* is ``struct<amount double, unit string>`` with the amount in the common unit of its kind (millilitres, or
per cent of alcohol by volume). A text has a reading for each amount that it states ("75 cl (25.4 fl oz)", "40 % (80 proof)"), for each way
to read a number ("1,057" is a thousand or a decimal), and, where no unit is stated, for each unit that a bare number may be
in, marked with a "?". An identity among columns, such as mass = density x volume or extracted = expected, is a product of
powers that must be 1; :func:`solve_identity` takes the combination of readings whose log residual is smallest and
flags the rows where another combination does as well.
"""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayist.functions.characters import plain_text

#: Millilitres in a unit of volume (US liquid measures).
ML = {"ml": 1.0, "cl": 10.0, "dl": 100.0, "l": 1000.0, "floz": 29.5735295625, "pint": 473.176473, "quart": 946.352946, "gallon": 3785.411784}
#: Units that may make up one amount, the second smaller than the first.
KINDS = ({"l", "dl", "cl", "ml"}, {"gallon", "quart", "pint", "floz"})
#: The spellings of a unit of volume.
SPELLED = {
    "ml": r"millilit(?:er|re)s?|mls?\b\.?|cc\b", "cl": r"centilit(?:er|re)s?|cls?\b\.?", "dl": r"decilit(?:er|re)s?|dls?\b\.?", "l": r"lit(?:er|re)s?|ltrs?\b\.?|l\b\.?",
    "floz": r"(?:u\.?\s*s\.?\s*)?fl(?:uid|\.)?\s*(?:ounces?|ozs?\b\.?)", "pint": r"(?:u\.?\s*s\.?\s*)?(?:liquid\s*)?(?:pints?|pts?\b\.?)", "quart": r"(?:u\.?\s*s\.?\s*)?(?:liquid\s*)?(?:quarts?|qts?\b\.?)", "gallon": r"(?:u\.?\s*s\.?\s*)?(?:gallons?|gals?\b\.?)",
}
#: Per cent of alcohol by volume in a scale.
ABV = {"percent": 1.0, "proof": 0.5, "ml/l": 0.1, "fraction": 100.0}

#: A point after a letter is punctuation ("Alc.40%"), not a decimal mark; after "fraction" it is one.
_NUM_N = r"(?:(?<![\d.,/])|(?<=[a-z]\.))(?P<n>\d+\s+\d+/\d+|\d+/\d+|\d+(?:[.,]\d+)*|(?<![a-z.])\.\d+)"
_NUM = _NUM_N.replace("?P<n>", "")
_PART = r"(?<![\d.,/])(\d+/\d+|\d+(?:[.,]\d+)*|\.\d+)"
_UNITS = "|".join(SPELLED.values())
_PER_LITRE = rf"{_NUM}\s*(?:ml|millilit(?:er|re)s?)\s*(?:of\s+)?(?:alcohol|ethanol)?\s*(?:/|per)\s*(?:l\b|lit)"
_DEGREE = r"(?:degrees?|deg\.?|°|º)?\s*"
_PROOF = rf"{_NUM}\s*{_DEGREE}(?:u\.?\s*s\.?\s*)?{_DEGREE}proof|proof\s*[.:=]?\s*{_NUM}"
_FRACTION = rf"fraction[^\d.]*{_PART}|{_NUM}[^\d]*fraction"
_PERCENT = rf"{_NUM}\s*(?:%|percent\b|per\s+cent\b|pct\b)"
_HALF = rf"\bhalf(?:\s+an?)?\s+(?=(?:{_UNITS})(?![a-z]))"
_SINGLE = rf"\b(?:one|an?)\s+(?=(?:{_UNITS})(?![a-z]))"
_VOLUME, _SECOND = re.compile(rf"{_NUM_N}\s*-?\s*(?P<u>{_UNITS})(?![a-z])"), re.compile(rf"\s*(?:,|&|and)?\s*{_NUM_N}\s*(?P<u>{_UNITS})(?![a-z])")
_STRENGTHS = [(u, re.compile(p)) for u, p in (("proof", _PROOF), ("fraction", _FRACTION), ("ml/l", _PER_LITRE), ("percent", _PERCENT))]
_BARE = r"\d+(?:[.,]\d+)*|\.\d+|\d+/\d+|\d+\s+\d+/\d+"
READING = T.ArrayType(T.StructType([T.StructField("amount", T.DoubleType()), T.StructField("unit", T.StringType())]))


def _number(s: str) -> list[float]:
    """Readings of a written number, the likelier first: a comma before exactly three digits may group or be decimal."""
    if "/" in s:
        *whole, ratio = s.split()
        a, b = map(float, ratio.split("/"))
        return [sum(map(float, whole)) + a / b] if b else []
    if re.fullmatch(r"[1-9]\d{0,2}(,\d{3})+(\.\d+)?", s):
        return [float(s.replace(",", "")), *([float(s.replace(",", "."))] if re.fullmatch(r"\d+,\d{3}", s) else [])]
    if re.fullmatch(r"[1-9]\d{0,2}(\.\d{3}){2,}", s):
        return [float(s.replace(".", ""))]
    return [float(s.replace(",", "."))] if re.fullmatch(r"\d*[.,]?\d+", s) else []


def _unit(spelled: str) -> str | None:
    return next((u for u, p in SPELLED.items() if re.fullmatch(p, spelled)), None)


def _text(value: str) -> str:
    return re.sub(_SINGLE, "1 ", re.sub(_HALF, "1/2 ", plain_text(value).lower()))


def _joined(unit: str, amount: float, more: float) -> float:
    """Two parts of one amount; a metric one may be said twice ("75 cl 750 ml")."""
    return amount if unit in KINDS[0] and abs(amount - more) <= 0.01 * amount else amount + more


def read_volume(value: str) -> list[tuple[float, str]]:
    """Readings in millilitres of all amounts in a text. "3 pt. 2.7 fl. oz." is one amount, in pints."""
    t, out, at = _text(value), [], 0
    while m := _VOLUME.search(t, at):
        first, unit, at = m["n"], _unit(m["u"]), m.end()
        more = 0.0
        if (p := _SECOND.match(t, at)) and (second := _unit(p["u"])) and any({second, unit} <= k for k in KINDS) and ML[second] < ML[unit]:
            more, at = ML[second] * next(iter(_number(p["n"])), 0.0), p.end()
        out += [(_joined(unit, x * ML[unit], more), unit) for x in _number(first)]
    return list(dict.fromkeys(out))


def read_alcohol(value: str) -> list[tuple[float, str]]:
    """Readings in per cent by volume of all strengths in a text: US proof, fractions, ml per litre, percentages."""
    t = _text(value)
    found = [(m.start(), x * ABV[unit], unit) for unit, pattern in _STRENGTHS for m in pattern.finditer(t) for x in _number(next(g for g in m.groups() if g))]
    return list(dict.fromkeys((x, u) for _, x, u in sorted(found, key=lambda f: f[0])))


def read_bare(value: str, factors: dict[str, float]) -> list[tuple[float, str]]:
    """Readings of a text that is a number without a unit: one for each unit it may be in, marked with "?"."""
    t = _text(value).strip(" .:")
    return [(x * f, f"?{u}") for x in (_number(t) if re.fullmatch(_BARE, t) else []) for u, f in factors.items()]


@F.arrow_udf(READING)
def readings(values: pa.Array, alcohol: pa.Array) -> pa.Array:
    """Readings of each text, of alcohol where the flag is set, else of volume; null counts as no text.

    Each distinct text of a batch is parsed once.
    """
    seen: dict[tuple[str | None, bool], list[tuple[float, str]]] = {}
    rows = []
    for key in zip(values.to_pylist(), alcohol.to_pylist(), strict=True):
        if key not in seen:
            read, factors = (read_alcohol, ABV) if key[1] else (read_volume, ML)
            seen[key] = (read(key[0]) or read_bare(key[0], factors)) if key[0] else []
        rows.append(seen[key])
    flat = [x for r in rows for x in r]
    parts = pa.StructArray.from_arrays([pa.array([a for a, _ in flat], pa.float64()), pa.array([u for _, u in flat], pa.string())], names=["amount", "unit"])
    return pa.ListArray.from_arrays(pa.array(list(itertools.accumulate(map(len, rows), initial=0)), pa.int32()), parts)


def unit_options(col: Column, factors: dict[str, float]) -> Column:
    """Readings of a bare number whose unit isn't known: one for each unit it may be in."""
    return F.filter(F.array(*(F.struct((col.cast("double") * f).alias("amount"), F.lit(u).alias("unit")) for u, f in factors.items())), lambda r: r.amount.isNotNull())


def _logs(readings: Column, exponent: int) -> Column:
    return F.transform(F.filter(readings, lambda r: r.amount > 0), lambda r: F.struct((F.log(r.amount) * exponent).alias("log"), F.array(r.amount).alias("amounts"), F.array(r.unit).alias("units")))


def _pairs(left: Column, right: Column) -> Column:
    both = lambda a: F.transform(right, lambda b: F.struct((a.log + b.log).alias("log"), F.concat(a.amounts, b.amounts).alias("amounts"), F.concat(a.units, b.units).alias("units")))
    return F.flatten(F.transform(left, both))


def solve_identity(df: DataFrame, terms: dict[str, int], tolerance: float = 0.01, out: str = "solved") -> DataFrame:
    """Choose for each row the readings that fit the identity prod(column ** exponent) = 1 best.

    ``terms``: columns of readings and their exponents, as {"mass": 1, "density": -1, "volume": -1}. Adds ``out``:
    struct<residual double, amounts array<double>, units array<string>, fits boolean, unique boolean>; the residual is the
    absolute log of the product, ``fits`` says that it's within ``tolerance`` of 1, ``unique`` that no combination of
    other units does as well (within the same tolerance). Null where a column has no positive reading. Ties go to the
    earlier reading. A clashing column ``out`` is replaced.
    """
    combos = None
    for name, exp in terms.items():
        own = _logs(F.col(name), exp)
        combos = own if combos is None else _pairs(combos, own)
    rated = F.transform(combos, lambda c, i: F.struct(F.abs(c.log).alias("residual"), i.alias("pos"), c.amounts.alias("amounts"), c.units.alias("units")))
    limit = -F.log(F.lit(1.0 - tolerance)) + 1e-9
    keep = [F.col(c) for c in df.columns if c != out]
    df = df.select(*keep, rated.alias("_rated"))
    df = df.select("*", F.array_min("_rated").alias("_best"))
    b = F.col("_best")
    others = F.exists(F.col("_rated"), lambda c: (c.units != b.units) & (c.residual <= limit))
    return df.select(*keep, F.when(b.isNotNull(), F.struct(b.residual.alias("residual"), b.amounts.alias("amounts"), b.units.alias("units"), (b.residual <= limit).alias("fits"), (~others).alias("unique"))).alias(out))


def finding_readings(findings: DataFrame) -> DataFrame:
    """``findings`` of alcohol_content and net_contents, with the readings of both values."""
    rows = findings.filter(F.col("field_name").isin("alcohol_content", "net_contents"))
    for side in ("extracted", "expected"):
        rows = rows.withColumn(f"{side}_readings", readings(F.col(f"{side}_value"), F.col("field_name") == "alcohol_content"))
    return rows


def equal_amounts(findings: DataFrame) -> DataFrame:
    """Findings whose two values state the same amount, within 1 % of the larger, in different units.

    The solver chooses among the readings of both; an amount counts only if its unit is stated. Where one unit fits on both
    sides as well, the text says the same amount in it, and the units don't differ.
    """
    rows = findings.filter(F.col("extracted_value") != F.col("expected_value")).select("finding_id", "field_name", "extracted_value", "expected_value")
    solved = solve_identity(finding_readings(rows), {"extracted_readings": 1, "expected_readings": -1})
    s = F.col("solved")
    stated = ~F.exists(s.units, lambda u: u.startswith("?"))
    return solved.filter(s.fits & stated & (F.get(s.units, F.lit(0)) != F.get(s.units, F.lit(1))))
