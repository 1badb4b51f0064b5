"""Amounts and strengths of texts in SQL, with lists of its own, to be held against the engine's readings."""

from __future__ import annotations

from assayist.plans.folding import letters

#: Spellings of units of volume (a point behind them doesn't matter) and their millilitres.
_US = r"(?:u\.?\s*s\.?\s*)?"
VOLUMES = {
    "ml": (r"millilit(?:er|re)s?|mls?|cc", 1.0), "cl": (r"centilit(?:er|re)s?|cls?", 10.0), "dl": (r"decilit(?:er|re)s?|dls?", 100.0), "l": (r"lit(?:er|re)s?|ltrs?|l", 1000.0), "floz": (rf"{_US}fl(?:uid|\.)?\s*(?:ounces?|ozs?)", 29.5735295625),
    "pint": (rf"{_US}(?:liquid\s*)?(?:pints?|pts?)", 473.176473), "quart": (rf"{_US}(?:liquid\s*)?(?:quarts?|qts?)", 946.352946), "gallon": (rf"{_US}(?:gallons?|gals?)", 3785.411784),
}
#: Per cent by volume in a scale of alcohol.
STRENGTHS = {"proof": 0.5, "fraction": 100.0, "ml/l": 0.1, "percent": 1.0}
_NUMBER = r"\d+\s+\d+/\d+|\d+/\d+|\d+(?:[.,]\d+)*|\.\d+"
_PLAIN = r"(\d+(?:[.,]\d+)*|\.\d+)"
_UNIT = "|".join(p for p, _ in VOLUMES.values())


def _case(key: str, pairs: dict[str, object]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pairs.items()) + " END"


def _unit(text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_full_match({text}, '{p}') THEN '{k}'" for k, (p, _) in VOLUMES.items()) + " END"


def _number(text: str) -> str:
    part = lambda p: f"try_cast(regexp_extract({text}, '{p}', 1) AS DOUBLE)"
    fraction = f"coalesce({part(r'^(\d+)\s')}, 0) + {part(r'(\d+)/')} / {part(r'/(\d+)')}"
    return f"CASE WHEN {text} LIKE '%/%' THEN {fraction} WHEN regexp_matches({text}, '^[1-9]\\d?\\d?(,\\d\\d\\d)+$') THEN try_cast(replace({text}, ',', '') AS DOUBLE) ELSE try_cast(replace({text}, ',', '.') AS DOUBLE) END"


def _equal(rows: str) -> str:
    return f"SELECT finding_id FROM ({rows}) WHERE x_a > 0 AND x_b > 0 AND u_a <> u_b AND abs(x_a - x_b) <= 0.01 * greatest(x_a, x_b)"


def _volumes() -> str:
    spelled = lambda c: f"regexp_replace(regexp_replace({letters(c)}, '\\bhalf(?:\\s+an?)?\\s+', '1/2 ', 'g'), '\\b(?:one|an?)\\s+', '1 ', 'g')"
    one, two = rf"({_NUMBER})\s*-?\s*({_UNIT})(?:[^a-z]|$)", rf"({_NUMBER})\s*-?\s*({_UNIT})\.?\s*(?:,|&|and)?\s*({_NUMBER})\s*({_UNIT})(?:[^a-z]|$)"
    found = lambda s: f"regexp_extract(t_{s}, '{two}', ['n', 'u', 'm', 'v']) AS two_{s}, regexp_extract(t_{s}, '{one}', ['n', 'u']) AS one_{s}"
    in_ml = lambda n, u: f"({_number(n)}) * {_case(f'({_unit(u)})', {k: f for k, (_, f) in VOLUMES.items()})}"
    amount = lambda s: f"CASE WHEN two_{s}.n <> '' THEN {in_ml(f'two_{s}.n', f'two_{s}.u')} + {in_ml(f'two_{s}.m', f'two_{s}.v')} ELSE {in_ml(f'one_{s}.n', f'one_{s}.u')} END AS x_{s}, CASE WHEN two_{s}.n <> '' THEN {_unit(f'two_{s}.u')} ELSE {_unit(f'one_{s}.u')} END AS u_{s}"
    texts = f"SELECT finding_id, {spelled('extracted_value')} AS t_a, {spelled('expected_value')} AS t_b FROM field_finding WHERE field_name = 'net_contents'"
    return _equal(f"SELECT finding_id, {amount('a')}, {amount('b')} FROM (SELECT *, {found('a')}, {found('b')} FROM ({texts}))")


def _strengths() -> str:
    def side(s: str) -> str:
        get = lambda p: f"nullif(regexp_extract(t_{s}, '{p}', 1), '')"
        said = {
            "proof": f"coalesce({get(_PLAIN + r'\s*(?:degrees?|deg\.?|°|º)?\s*' + _US + 'proof')}, {get(r'proof\s*[.:=]?\s*' + _PLAIN)})", "fraction": f"coalesce({get('fraction[^0-9.]*' + _PLAIN)}, {get(_PLAIN + '[^0-9]*fraction')})",
            "ml/l": get(_PLAIN + r"\s*(?:ml|millilit(?:er|re)s?)\s*(?:of\s+)?(?:alcohol|ethanol)?\s*(?:/|per)\s*(?:l|lit)"), "percent": get(_PLAIN + r"\s*(?:%|percent|per\s+cent|pct)"),
        }
        return f"coalesce({', '.join(said.values())}) AS n_{s}, CASE " + " ".join(f"WHEN {v} IS NOT NULL THEN '{k}'" for k, v in said.items()) + f" END AS u_{s}"

    texts = f"SELECT finding_id, {letters('extracted_value')} AS t_a, {letters('expected_value')} AS t_b FROM field_finding WHERE field_name = 'alcohol_content'"
    amount = lambda s: f"try_cast(replace(n_{s}, ',', '.') AS DOUBLE) * {_case(f'u_{s}', STRENGTHS)} AS x_{s}, u_{s}"
    return _equal(f"SELECT finding_id, {amount('a')}, {amount('b')} FROM (SELECT *, {side('a')}, {side('b')} FROM ({texts}))")


def p2_found() -> str:
    """Findings whose two values state one amount in different units: the first amount of each text."""
    return f"{_volumes()} UNION ALL {_strengths()}"
