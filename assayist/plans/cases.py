"""Queries over small given rows, for operators whose tables the test data doesn't have; each beside the rows it must give.

The SQL of a case is a list of VALUES: the expected rows, worked out by hand from what the operator is to do.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayist.functions import marks as M
from assayist.functions import text as X
from assayist.operators import cards, images, layout, panels, projections, records, validators
from assayist.session import shared_dir
from assayist.sources import readers, sinks

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return f"{v}::BIGINT" if isinstance(v, int) else f"{v}::DOUBLE" if isinstance(v, float) else "'" + v.replace("'", "''") + "'"


def case(columns: str, *rows: tuple):
    """Register a query that takes the session only, with the rows (of ``columns``) that it must give."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark).select(*columns.split())
        ORACLE[f.__name__] = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) t({', '.join(columns.split())})"
        return f

    return add


def _texts(spark: SparkSession, *texts: str | None) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")


def _bigint(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


# --- searching names in lines

_TRAILING = ["distillery", "bourbon", "company", "brewing", "co"]


@case("id route", (0, "exact"), (1, "punctuation"), (2, "within"), (3, None), (4, "shortened"), (5, None), (6, "misread"), (7, "misread"), (8, None), (9, None), (10, "within"))
def search_routes(spark: SparkSession) -> DataFrame:
    """How a line shows a name: a short word within a line, a shortened name within one and too short a name don't count."""
    rows = [("Höp  River", "hop river"), ("HOP-RIVER!", "Hop River"), ("fine HOP RIVER ale", "Hop River"), ("the Hop shop", "Hop"), ("VIKRE", "Vikre Distillery"), ("by VIKRE of Duluth", "Vikre Distillery"), ("Southerm Cross", "Southern Cross"), ("Threc Doctors", "Three Doctors Bourbon"), ("Vikke", "Vikre"), ("ab", "AB"), ("old Juniper lane", "The Juniper")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, line string, name string")
    return df.select("id", F.get(F.array(*map(F.lit, X.ROUTES)), X.search_route(F.col("line"), F.col("name"), _TRAILING) - 1).alias("route"))


@case("id route name line", (0, 1, 0, 2), (1, 3, 0, 1), (2, 1, 1, 0), (3, None, None, None), (4, None, None, None))
def brand_search(spark: SparkSession) -> DataFrame:
    """The strongest route of any line to any name; on a tie the earlier name, then the earlier line."""
    rows = [(["fine HOP RIVER ale", "hop-river", "Hop River"], ["Hop River"]), (["ale", "a HOP RIVER ale", "more HOP RIVER"], ["Hop River", "Lone Rider"]), (["lone rider", "a hop river ale"], ["Hop River", "Lone Rider"]), (["nothing"], ["Hop River"]), ([], ["Hop River"])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, lines array<string>, names array<string>")
    return _bigint(df.select("id", X.best_route(F.col("lines"), F.col("names"), _TRAILING).alias("r")).select("id", "r.*"), "route", "name", "line")


@case("id outcome code", (0, "NOT_APPLICABLE", None), (1, "PASS", None), (2, "INSUFFICIENT", "READ.MISSING"), (3, "PASS", None), (4, "PASS", None), (5, "PASS", None), (6, "PASS", None), (7, "PASS", None), (8, "PASS", None), (9, "INSUFFICIENT", "BRAND.NEAR"), (10, "INSUFFICIENT", "BRAND.UNCERTAIN"), (11, "INSUFFICIENT", "BRAND.UNCERTAIN"), (12, "INSUFFICIENT", "BRAND.NEAR"))
def brand_cascade(spark: SparkSession) -> DataFrame:
    """The cascade over all admissible names. The fanciful name counts for the reading, but isn't searched for in other lines."""
    none: list = []
    rows = [
        ("Hop River", "", None, none, none), ("", "Hop River", None, none, ["HOP RIVER"]), ("", "Hop River", None, none, ["lager"]), ("HOP  RIVER", "Hop River", None, none, none), ("Night Owl", "Hop River", "night owl", none, none), ("Mill Trading", "Hop River", None, ["x", "y", "Mill Trading"], none), ("the hop river ale", "Hop River", None, none, none),
        ("Hop-River", "Hop River", None, none, none), ("lager", "Hop River", None, ["Mill Trading"], ["by MILL TRADING"]), ("Hop Raver Mills", "Hop River", None, none, none), ("lager", "Hop River", "Night Owl", none, ["night owl"]), ("lager", "Hop River", None, none, none), ("Kop River", "Hop Rivor", None, none, none),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, reading string, expected string, fanciful string, trade array<string>, lines array<string>")
    i = validators.Inputs(F.col("reading"), F.col("expected"), seen=F.lit(False), extra={"fanciful": F.col("fanciful"), "trade_names": F.col("trade"), "lines": F.col("lines")}, parameters={"droppable": _TRAILING})
    return df.select("id", validators.run("brand", i).alias("v")).select("id", "v.*")


# --- pinned texts, proofs, amounts, citations

_TEXT = "GOVERNMENT WARNING: (1) According to the Surgeon General, women should not drink. (2) Consumption impairs health."
_WORDS = "government warning according to the surgeon general women should not drink consumption impairs health always men may often".split()


@case("id outcome code", (0, "PASS", None), (1, "INSUFFICIENT", "TEXT.INITIALS"), (2, "INSUFFICIENT", "TEXT.READING"), (3, "INSUFFICIENT", "TEXT.READING"), (4, "INSUFFICIENT", "TEXT.READING"), (5, "INSUFFICIENT", "TEXT.UNSURE"), (6, "FAIL", "TEXT.DIFFERS"), (7, "INSUFFICIENT", "TEXT.UNSURE"), (8, "INSUFFICIENT", "READ.MISSING"), (9, "INSUFFICIENT", "TEXT.READING"))
def verbatim_kinds(spark: SparkSession) -> DataFrame:
    """Hash, small initials, what readers make, words of no list, a changed word, rearranged words, nothing read, text that runs on."""
    texts = [_TEXT.replace(" ", "  "), _TEXT.replace("Surgeon General", "surgeon General"), _TEXT.replace("(1)", "(I)"), _TEXT.replace("health", "heailth"), _TEXT.replace("drink", "0rink").replace("Surgeon", "Surgeön"), _TEXT.replace("impairs", "impxirs"), _TEXT.replace("women", "men").replace("should", "may"), "(2) Consumption impairs health. " + _TEXT[: _TEXT.index(" (2)")], "", _TEXT + " 750 ML"]
    i = validators.Inputs(F.col("text"), seen=F.lit(False), parameters={"text": _TEXT, "words": _WORDS})
    return _texts(spark, *texts).select("id", validators.run("verbatim", i).alias("v")).select("id", "v.*")


@case("id proofs", (0, "90,91"), (1, "124.6"), (2, ""), (3, ""), (4, "96"), (5, "86.5"), (6, ""), (7, "90"), (8, None))
def proof_figures(spark: SparkSession) -> DataFrame:
    """Figures before and after the word; ranges, the distillation and figures of another row don't count."""
    df = _texts(spark, "90 PROOF or 91-proof", "Barrel Proof: 124,6", "80-89 PROOF", "distilled at 160 proof", "PROD: 80 PROOF: 96", "86.5° U.S. pr00f", "PROOF 80-89", "DISTILLED IN KENTUCKY, 90 PROOF", None)
    return df.select("id", F.array_join(M.proofs("text"), ",").alias("proofs"))


@case("id ml", (0, 350.0), (1, 473.176473), (2, None), (3, 750.0), (4, None), (5, 1000.0), (6, None), (7, None), (8, 750.0))
def declared_millilitres(spark: SparkSession) -> DataFrame:
    """A metric figure wins, customary ones must agree, a bare number is millilitres, an unknown unit nothing."""
    df = _texts(spark, "NET CONT. 350 ML / 12 FL OZ", "1 PINT", "1 PINT 9 FL. OZ.", "750", "3 hogsheads", "1 L", "no figure", None, "CASK 7 of 750 mL")
    return df.select("id", F.round(M.millilitres("text"), 6).alias("ml"))


@case("id targets", (0, "27 5.63 (a)(1)|27 5 Subpart I|27 5 Subpart J"), (1, "27 4.32|28 16.21"), (2, None), (3, None), (4, None), (5, None), (6, "27 7.22a"), (7, None))
def citation_targets(spark: SparkSession) -> DataFrame:
    """All or nothing: a part carries over to a subpart, within one title only."""
    df = _texts(spark, "27 CFR §5.63(a)(1), §5 Subpart I, Subpart J", "27 CFR §4.32, 28 CFR §16.21", "§5.63", "27 CFR §5.63, nonsense", "27 CFR §5.63, 28 CFR Subpart A", "27 CFR", "27 CFR § 7.22a", "")
    t = F.transform(X.citations(F.col("text")), lambda t: F.concat_ws(" ", X.target_key(t), t.paragraph))
    return df.select("id", F.array_join(t, "|").alias("targets"))


@case("id text", (0, "standards"), (0, "malt"))
def held_sections(spark: SparkSession) -> DataFrame:
    """The texts behind a citation, if all of its targets are held; else none of them."""
    df = _texts(spark, "27 CFR §5.63, §7.22", "27 CFR §5.63, §9.9", "unreadable")
    held = spark.createDataFrame([("27 5.63", "standards"), ("27 7.22", "malt")], "key string, text string")
    return held_texts(df.select("id", X.citations(F.col("text")).alias("targets")), held, "id")


def held_texts(cited: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """(key, position, target, text) of the citations (key, targets) of which ``held`` (key, text) has every target."""
    each = cited.select(F.col(key).alias("_id"), F.posexplode("targets").alias("position", "t")).select("_id", "position", X.target_key(F.col("t")).alias("target"))
    found = each.join(F.broadcast(held.select(F.col("key").alias("target"), "text")), "target", "left")
    whole = found.groupBy("_id").agg(F.bool_and(F.col("text").isNotNull()).alias("ok")).filter("ok")
    return found.join(whole, "_id").select(F.col("_id").alias(key), "position", "target", "text")


# --- validators without a table of their own


def _outcomes(df: DataFrame, name: str, i: validators.Inputs) -> DataFrame:
    return df.select("id", validators.run(name, i).alias("v")).select("id", "v.outcome", "v.code")


@case("id outcome code", (0, "PASS", None), (1, "FAIL", "HEADING.STYLE"), (2, "FAIL", "HEADING.STYLE"), (3, "FAIL", "HEADING.WEIGHT"), (4, "INSUFFICIENT", "HEADING.UNMEASURED"), (5, "INSUFFICIENT", "READ.MISSING"))
def heading_style(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(0, "GOVERNMENT WARNING:", True, True, True), (1, "Government Warning:", False, True, True), (2, "WARNING:", True, True, True), (3, "GOVERNMENT WARNING:", True, False, True), (4, "GOVERNMENT WARNING:", True, True, False), (5, "", None, None, None)], "id bigint, text string, caps boolean, bold boolean, sure boolean")
    return _outcomes(df, "heading_style", validators.Inputs(F.col("text"), seen=F.lit(False), extra={"all_caps": F.col("caps"), "bold": F.col("bold"), "confident": F.col("sure")}, parameters={"heading": "GOVERNMENT WARNING:"}))


@case("id outcome", (0, "PASS"), (1, "FAIL"), (2, "INSUFFICIENT"))
def same_field_of_vision(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(0, {"front": ["brand", "class", "abv"]}), (1, {"front": ["brand"], "back": ["class", "abv"]}), (2, {})], "id bigint, panels map<string,array<string>>")
    return _outcomes(df, "same_field_of_vision", validators.Inputs(F.lit(""), extra={"panels": F.col("panels")}, parameters={"fields": ["brand", "class"]}))


@case("id outcome", (0, "PASS"), (1, "INSUFFICIENT"), (2, "NOT_APPLICABLE"), (3, "INSUFFICIENT"), (4, "INSUFFICIENT"))
def name_address(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(0, "Bottled by Hop River, Stamford, Connecticut", "Hop River LLC, 1 Main St, Stamford, CT 06901"), (1, "Bottled by Lone Rider, Stamford, CT", "Hop River LLC, Stamford, CT"), (2, "Bottled by Hop River", ""), (3, "", "Hop River"), (4, "by Hop River", "Hop River LLC, Stamford")], "id bigint, text string, expected string")
    return _outcomes(df, "name_address", validators.Inputs(F.col("text"), F.col("expected"), parameters={"states": {"connecticut": "ct", "new york": "ny"}}))


@case("id outcome", (0, "PASS"), (1, "FAIL"), (2, "INSUFFICIENT"), (3, "INSUFFICIENT"), (4, "NOT_APPLICABLE"), (5, "INSUFFICIENT"), (6, "INSUFFICIENT"))
def proof_agreement(spark: SparkSession) -> DataFrame:
    """Equal; other and beside; other and apart; a one too many; none; no percentage; over 200."""
    rows = [(0, 45.0, [("90", True)]), (1, 45.0, [("90", True), ("80", True)]), (2, 45.0, [("80", False)]), (3, 45.0, [("190", True)]), (4, 45.0, []), (5, None, [("90", True)]), (6, 45.0, [("900", True)])]
    df = spark.createDataFrame(rows, "id bigint, abv double, proofs array<struct<value:string,beside:boolean>>")
    return _outcomes(df, "proof_agreement", validators.Inputs(F.lit(""), extra={"abv": F.col("abv"), "proofs": F.col("proofs")}))


@case("id outcome code", (0, "PASS", None), (1, "PASS", None), (2, "PASS", None), (3, "FAIL", "CLASS.DIFFERS"), (4, "INSUFFICIENT", "CLASS.UNCERTAIN"), (5, "FAIL", "CLASS.ABSENT"), (6, "NOT_APPLICABLE", None), (7, "INSUFFICIENT", "CLASS.UNCERTAIN"))
def designations(spark: SparkSession) -> DataFrame:
    """A segment as a run, a shared class, a class within another, only class words, further words, blank, undeclared, no class."""
    df = spark.createDataFrame([(0, "fine pale ale", "Beer / Pale Ale"), (1, "straight rye whisky", "rye whiskey blend"), (2, "lager", "beer style"), (3, "gin", "vodka spirit"), (4, "dry gin", "vodka spirit"), (5, " ", "gin"), (6, "gin", ""), (7, "nectar", "gin")], "id bigint, text string, expected string")
    return _outcomes(df, "designation", validators.Inputs(F.col("text"), F.col("expected"), parameters={"classes": ["pale ale", "rye whiskey", "lager", "beer", "gin", "vodka"], "within": [("lager", "beer")]}))


@case("id class", (0, "straight rye whiskey"), (1, "rye whiskey"), (2, None))
def longest_class(spark: SparkSession) -> DataFrame:
    """The recognised class of most words that a reading holds."""
    known = F.array(*(F.array(*map(F.lit, c.split())) for c in ("rye whiskey", "whiskey", "straight rye whiskey")))
    held = F.filter(known, lambda c: F.size(F.array_except(c, X.norm_words(F.col("text")))) == 0)
    best = F.array_max(F.transform(held, lambda c: F.struct(F.size(c).alias("n"), F.array_join(c, " ").alias("c"))))
    return _texts(spark, "Straight Rye Whisky aged", "whiskey of rye", "gin").select("id", best.c.alias("class"))


# --- cards, corrections, trace

_SLOTS = [("brand_name", "brand_name", 0), ("class_type", "class_type", 0), ("alcohol_content", "alcohol_content", 0), ("abv", "alcohol_content", 1), ("warning", "warning", 0)]
_RESULTS = [("L1", "r.brand", "brand_name", "PASS", "reject", None, None, 0.9), ("L1", "r.alc", "abv", "INSUFFICIENT", "reject", "ALC.READ.UNCERTAIN", "fail", 0.4), ("L1", "a.alc", "alcohol_content", "PASS", "reject", None, None, 0.7), ("L1", "r.na", "warning", "NOT_APPLICABLE", "reject", None, None, 0.1), ("L2", "r.brand", "brand_name", "FAIL", "warn", "BRAND.NAME.DIFFERS", "pass", 0.8), ("L1", "r.none", None, "FAIL", "reject", "X.Y", None, 0.0)]
_OBSERVED = [("L1", "brand_name", "Hop River", 0.95), ("L1", "abv", "5%", 0.6), ("L1", "warning", "text", 0.8), ("L2", "brand_name", "Lone", 0.5), ("L2", "class_type", "ale", None)]
_EXPECTED = [("L1", "brand_name", "Hop River"), ("L1", "alcohol_content", "5 %"), ("L1", "class_type", "beer"), ("L2", "brand_name", "Lone Rider")]
_TRACE = [("L1", "vr/1", "r.brand", "pass", None), ("L1", "vr/2", "r.alc", "needs_review", None), ("L1", "rc/1", "r.other", "needs_review", "reason_code/r.alc"), ("L1", "vr/3", "a.alc", "pass", None), ("L2", "vr/1", "r.brand", "needs_review", None), ("L2", "en/1", "engine.stopped", "needs_review", "engine"), ("L3", "vr/1", "r.brand", "pass", None)]
_OVERRIDES = [("L1", "alcohol_content", "fail", 1, "ALC"), ("L1", "alcohol_content", "pass", 2, "ALC"), ("L2", "brand_name", "pass", 3, "BRAND"), ("L3", None, "needs_review", 4, "NOPE"), ("L3", None, "fail", 5, "BRAND")]
_LABELS = [("L1", "needs_review"), ("L2", "needs_review"), ("L3", "pass"), ("L4", "fail")]


def _cards(spark: SparkSession) -> DataFrame:
    f = spark.createDataFrame
    return cards.cards(f(_RESULTS, "label string, rule_id string, field string, outcome string, severity string, code string, lean string, confidence double"), f(_OBSERVED, "label string, field string, value string, confidence double"), f(_EXPECTED, "label string, field string, value string"), f(_SLOTS, "field string, slot string, rank int"))


def _overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_OVERRIDES, "label string, slot string, applied string, seq bigint, code string")


def _trace(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_TRACE, "label string, row string, rule_id string, disposition string, evidence_ref string")


def _labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_LABELS, "label string, disposition string")


@case("label slot observed expected rules disposition confidence lean", ("L1", "brand_name", "Hop River", "Hop River", "r.brand=pass", "pass", 0.9, "pass"), ("L1", "alcohol_content", "5%", "5 %", "a.alc=pass,r.alc=needs_review", "needs_review", 0.4, "fail"), ("L1", "warning", "text", None, "", None, 0.8, None), ("L2", "brand_name", "Lone", "Lone Rider", "r.brand=needs_review", "needs_review", 0.8, "pass"))
def envelope_findings(spark: SparkSession) -> DataFrame:
    """Cards: a slot joins what the reader and the application name differently; no card without evidence."""
    rules = F.array_join(F.transform("findings", lambda x: F.concat_ws("=", x.rule_id, x.disposition)), ",")
    return _cards(spark).select("label", "slot", "observed", "expected", rules.alias("rules"), "disposition", "confidence", "lean")


@case("label slot disposition lean", ("L1", "brand_name", "pass", "pass"), ("L1", "alcohol_content", "pass", "pass"), ("L1", "warning", None, None), ("L2", "brand_name", "pass", "pass"))
def corrected_fields(spark: SparkSession) -> DataFrame:
    return cards.corrected_cards(_cards(spark), _overrides(spark))


@case("label n_pass n_review", ("L1", 2, 0), ("L2", 1, 1), ("L3", 1, 0))
def corrected_trace(spark: SparkSession) -> DataFrame:
    """The trace without the rows of corrected cards, by rule and by reference, and with the corrections."""
    rows = cards.corrected_trace(_trace(spark), _cards(spark), _overrides(spark))
    return rows.groupBy("label").agg(F.count_if(F.col("disposition") == "pass").alias("n_pass"), F.count_if(F.col("disposition") == "needs_review").alias("n_review"))


@case("label disposition", ("L1", "pass"), ("L2", "needs_review"), ("L3", "fail"), ("L4", "fail"))
def corrected_labels(spark: SparkSession) -> DataFrame:
    """Corrected cards lift a label, a row of the engine keeps its say, the last word on the whole label holds one back."""
    return cards.corrected_labels(_labels(spark), _trace(spark), _cards(spark), _overrides(spark))


@case("label lean", ("L1", "fail"), ("L2", "fail"), ("L3", "pass"), ("L4", "fail"))
def label_leans(spark: SparkSession) -> DataFrame:
    return cards.label_leans(_labels(spark), _trace(spark), _cards(spark))


@case("label confirm", ("L1", False), ("L2", True))
def to_confirm(spark: SparkSession) -> DataFrame:
    """Whether a card in review has no correction; L2's correction is left out here."""
    return cards.to_confirm(_cards(spark), _overrides(spark).filter("label <> 'L2'")).withColumn("confirm", F.coalesce("confirm", F.lit(False)))


@case("seq taken", (1, False), (2, False), (3, True), (4, False), (5, True))
def accepted_codes(spark: SparkSession) -> DataFrame:
    yes, no = cards.accepted(_overrides(spark), spark.createDataFrame([("BRAND",)], "code string"))
    return yes.select("seq", F.lit(True).alias("taken")).unionByName(no.select("seq", F.lit(False).alias("taken")))


@case("label rule_id disposition code", ("L1", "r.1", "fail", "A.B"), ("L1", "r.2", "needs_review", None), ("L2", "r.1", "pass", None))
def traced_outcomes(spark: SparkSession) -> DataFrame:
    rows = [("L1", "r.1", "fail", "vr/r.1"), ("L1", "A.B", "fail", "reason_code/r.1"), ("L1", "r.2", "needs_review", "vr/r.2"), ("L2", "r.1", "pass", "vr/r.1"), ("L2", "E", "needs_review", "engine")]
    return cards.traced_outcomes(spark.createDataFrame(rows, "label string, rule_id string, disposition string, evidence_ref string"))


@case("label rule_id fault", ("L1", "r.2", "no code"), ("L1", "r.3", "unknown code"), ("L2", "r.1", "a code of warn"))
def code_faults(spark: SparkSession) -> DataFrame:
    """Codes that contradict the outcome; what passes or doesn't apply needs none."""
    rows = [("L1", "r.1", "fail", "A"), ("L1", "r.2", "fail", None), ("L1", "r.3", "needs_review", "Z"), ("L2", "r.1", "fail", "B"), ("L2", "r.2", "pass", None), ("L2", "r.3", "needs_review", "B")]
    return cards.code_faults(spark.createDataFrame(rows, "label string, rule_id string, disposition string, code string"), spark.createDataFrame([("A", "reject"), ("B", "warn")], "code string, severity string"))


@case("code side", ("Z", "emitted"), ("B", "registered"))
def unregistered_codes(spark: SparkSession) -> DataFrame:
    return cards.unregistered(spark.createDataFrame([("A",), ("Z",), ("A",), (None,)], "code string"), spark.createDataFrame([("A",), ("B",)], "code string"))


@case("label field class", ("L1", "brand", "wine"))
def retagged(spark: SparkSession) -> DataFrame:
    """The application's class replaces the reader's; a label without one reaches no rule."""
    return cards.retagged(spark.createDataFrame([("L1", "brand", "beer"), ("L2", "brand", "beer"), ("L3", "brand", "wine")], "label string, field string, class string"), spark.createDataFrame([("L1", "wine"), ("L2", None)], "label string, class string"))


@case("label lines figures", ("L1", "front a,front b,back a", "90,91"), ("L2", "only", None))
def gathered_faces(spark: SparkSession) -> DataFrame:
    """All faces' candidate lines in the order of the faces, and each proof figure once."""
    rows = [("L1", "brand", 1, ["back a"], None), ("L1", "brand", 0, ["front a", "front b"], None), ("L2", "brand", 0, ["only"], None), ("L1", "abv", 1, None, ["91", "90"]), ("L1", "abv", 0, None, ["90"]), ("L2", "abv", 0, None, None)]
    df = spark.createDataFrame(rows, "label string, field string, face_position int, lines array<string>, figures array<string>")
    return cards.gathered(df, "brand", "lines", False).join(cards.gathered(df, "abv", "figures", True), "label", "left").select("label", F.array_join("lines", ",").alias("lines"), F.array_join("figures", ",").alias("figures"))


@case("label rule_id disposition", ("L1", "r.1", "pass"), ("L1", "ENGINE.TIMEOUT", "needs_review"), ("L2", "ENGINE.STOPPED", "needs_review"))
def with_failures(spark: SparkSession) -> DataFrame:
    trace = spark.createDataFrame([("L1", "r.1", "pass", "vr/r.1")], "label string, rule_id string, disposition string, evidence_ref string")
    return cards.with_failures(trace, spark.createDataFrame([("L1", "ENGINE.TIMEOUT"), ("L2", "ENGINE.STOPPED")], "label string, rule_id string"))


@case("label rule_id", ("L1", "ENGINE.B"))
def first_failure(spark: SparkSession) -> DataFrame:
    rows = [("L1", 0, "r.1"), ("L1", 2, "ENGINE.A"), ("L1", 1, "ENGINE.B"), ("L2", 0, "r.1")]
    return cards.first_failure(spark.createDataFrame(rows, "label string, position int, rule_id string"), "ENGINE.")


@case("position rank", (2, 0), (3, 0), (0, 1), (1, 2))
def batch_order(spark: SparkSession) -> DataFrame:
    """Pass, review, fail: the rank that rows of a batch are sorted by, then by position."""
    df = spark.createDataFrame([(0, "needs_review"), (1, "fail"), (2, "pass"), (3, "pass")], "position bigint, disposition string")
    return _bigint(cards.by_disposition(df), "rank")


@case("evaluation disposition origin", ("a", "pass", "running"), ("b", "fail", "stored"), ("c", None, None))
def current_results(spark: SparkSession) -> DataFrame:
    f = lambda *rows: spark.createDataFrame(list(rows), "evaluation string, disposition string")
    return cards.current(spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "evaluation string"), f(("a", "pass")), f(("a", "fail"), ("b", "fail")))


# --- records


def _entries(spark: SparkSession) -> DataFrame:
    rows = [("e1", "spirits", ("Hop", "Owl", "gin", ("40% alc", 40.0), ("750 mL", 750.0), "Hop LLC 12345 Mill Co (used on label)", "Imported", "France", None), "real"), ("e2", "wine", ("Vine", None, None, None, None, None, "domestic", "Oregon", "Willamette"), "real"), ("e3", "malt", ("Ale", None, None, None, (None, 355.0), None, None, None, None), "made")]
    return spark.createDataFrame(rows, records.ENTRY + ", kind string")


@case("id field value amount names required", ("e1", "brand_name", "Hop", None, "Owl,Mill Co", None), ("e1", "class_type", "gin", None, None, None), ("e1", "alcohol_content", "40% alc", 40.0, None, True), ("e1", "net_contents", "750 mL", 750.0, None, None), ("e1", "name_address", "Hop LLC 12345 Mill Co (used on label)", None, None, None), ("e1", "origin", "France", None, None, True), ("e2", "brand_name", "Vine", None, "", None), ("e2", "alcohol_content", None, None, None, False), ("e2", "origin", None, None, None, False), ("e2", "appellation", "Willamette", None, None, None), ("e3", "brand_name", "Ale", None, "", None), ("e3", "alcohol_content", None, None, None, False), ("e3", "net_contents", None, 355.0, None, None))
def expected_of_records(spark: SparkSession) -> DataFrame:
    out = records.expected_values(records.record_of_entry(_entries(spark)), "id")
    return out.withColumn("names", F.array_join("other_names", ","))


@case("id brand_name alcohol_text source origin appellation", ("e1", "Hop", "40% alc", "imported", "France", ""), ("e2", "Vine", "", "domestic", "", "Willamette"), ("e3", "Ale", "", "", "", ""))
def posted_forms(spark: SparkSession) -> DataFrame:
    return records.form_of_entry(_entries(spark).drop("kind"))


@case("id file brand_name", ("e1", "e1-front.png", "Hop"), ("e1", "e1-back.png", "Hop"))
def sample_pack(spark: SparkSession) -> DataFrame:
    """Sampled files with their entry's form; files of no real entry are left out."""
    return records.packed(spark.createDataFrame([("e1", "e1-front.png"), ("e1", "e1-back.png"), ("e3", "e3.png"), ("e9", "e9.png")], "id string, file string"), _entries(spark))


@case("id brand_name name_address front back fault", ("1", "Hop", "Hop LLC Mill St", "b1.jpg", "k1.jpg", None), ("2", None, None, None, None, "not mapped: imported spirits"), ("3", None, None, None, None, "not mapped: domestic wine"))
def registry_records(spark: SparkSession) -> DataFrame:
    rows = [("1", "spirits", "domestic", "Hop", None, "gin", ["Hop LLC", "Mill St"], [("Neck", "n.jpg"), ("Brand (front)", "b1.jpg"), ("Brand (front)", "b2.jpg"), ("Back", "k1.jpg")]), ("2", "spirits", "imported", "A", None, None, [], []), ("3", "wine", "domestic", "B", None, None, [], [])]
    return records.registry_cases(spark.createDataFrame(rows, records.REGISTRY))


@case("file brand", ("lucy-front.jpg", "Lucy"), ("LUCY-Back.PNG", "Lucy"), ("lucy-neck.jpg", None), ("dora.jpeg", "Dora"))
def application_rows(spark: SparkSession) -> DataFrame:
    """Labels with the row of the file that names either face; a neck is a label of its own."""
    rows = spark.createDataFrame([("lucy.jpg", "Lucy"), ("Dora-front", "Dora"), ("x", "X")], "filename string, brand string")
    return records.with_applications(spark.createDataFrame([("lucy-front.jpg",), ("LUCY-Back.PNG",), ("lucy-neck.jpg",), ("dora.jpeg",)], "file string"), rows)


@case("id keys text", (0, "abv", "5% alc"), (1, "", "as read"), (2, None, ""))
def payloads(spark: SparkSession) -> DataFrame:
    """Payload maps without audit keys, and the statement in them: a text is itself."""
    df = spark.createDataFrame([(0, None, {"abv": "5", "alc_text": "5% alc", "prompt": "x"}), (1, "as read", {"trace": "t"}), (2, None, None)], "id bigint, said string, payload map<string,string>")
    return df.select("id", F.array_join(F.map_keys(records.stripped(F.col("payload"), ["prompt", "trace", "alc_text"])), ",").alias("keys"), records.payload_text(F.col("said"), F.col("payload"), "alc_text").alias("text"))


@case("text face x score", ("HOP", "back", 1.24, 0.9877), ("RIVER", "back", 2.0, 1.0))
def frozen_boxes(spark: SparkSession) -> DataFrame:
    """Rounded boxes with the face they were read on."""
    df = spark.createDataFrame([([([1.239, 2.0], "HOP", 0.98767), ([2.0, 0.0], "RIVER", 1.0)],)], "boxes array<struct<box:array<double>,text:string,score:double>>")
    b = records.with_face(records.rounded_boxes(F.col("boxes")), F.lit("back"))
    return df.select(F.explode(b).alias("b")).select("b.text", "b.face", F.get("b.box", F.lit(0)).alias("x"), "b.score")


@case("batch_id position evaluation disposition", ("b1", 0, "e1", "pass"), ("b1", 1, "e2", "fail"))
def streamed_events(spark: SparkSession) -> DataFrame:
    return records.streamed(spark.createDataFrame([("b1", 0, ("e1", "pass")), ("b1", 1, ("e2", "fail"))], "batch_id string, position bigint, envelope struct<evaluation:string,disposition:string>"))


@case("effective_date", ("2024-05-01",))
def effective_date(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([("a", "2023-01-01"), ("b", "2024-05-01"), ("c", None)], "rule_id string, d string")
    return records.effective(df.select("rule_id", F.to_date("d").alias("effective_date"))).select(F.col("effective_date").cast("string").alias("effective_date"))


@case("key n median mean least largest", ("a", 3, 20.0, 20.0, 10.0, 30.0), ("b", 0, None, None, None, None))
def gap_summary(spark: SparkSession) -> DataFrame:
    return records.timing(spark.createDataFrame([("a", None), ("a", 10.0), ("a", 30.0), ("a", 20.0), ("b", None)], "key string, gap double"), "key", "gap")


@case("id once", (0, "b,a,c"), (1, ""))
def first_seen(spark: SparkSession) -> DataFrame:
    """Each item once, where it first came."""
    return spark.createDataFrame([(0, ["b", "a", "b", "c", "a"]), (1, [])], "id bigint, items array<string>").select("id", F.array_join(F.array_distinct("items"), ",").alias("once"))


@case("label rule_id field place", ("L1", "a.1", "abv", 1), ("L1", "a.1", "brand", 2), ("L1", "b.0", "abv", 3), ("L2", "z", "abv", 1))
def sorted_results(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([("L1", "b.0", "abv"), ("L2", "z", "abv"), ("L1", "a.1", "brand"), ("L1", "a.1", "abv")], "label string, rule_id string, field string")
    return _bigint(cards.result_order(df), "place")


@case("rule_id factor words", ("net.same", 29.5735295625, None), ("brand.same", None, "co,distillery"), ("plain", None, None))
def rule_tables(spark: SparkSession) -> DataFrame:
    """Rules with what their decision table says: a unit's factor, or the words a name may lose."""
    rules = spark.createDataFrame([("net.same", "units", "floz"), ("brand.same", "trailing", None), ("plain", None, None)], "rule_id string, table_ref string, unit string")
    units = spark.createDataFrame([("units", "floz", 29.5735295625), ("units", "ml", 1.0)], "table_ref string, unit string, factor double")
    trailing = spark.createDataFrame([("trailing", ["co", "distillery"])], "table_ref string, listed array<string>")
    return rules.join(F.broadcast(units), ["table_ref", "unit"], "left").join(F.broadcast(trailing), "table_ref", "left").withColumn("words", F.array_join("listed", ","))


# --- fields of a face


def _flags(spark: SparkSession, f, *texts: str) -> DataFrame:
    flag = F.arrow_udf(M._each(f, pa.bool_()), "boolean")
    return _texts(spark, *texts).select("id", flag("text").alias("hit"))


@case("id hit", (0, False), (1, True), (2, True), (3, True), (4, False), (5, True))
def not_contents(spark: SparkSession) -> DataFrame:
    """What stands around a volume ("|" marks it) says that it's a serving, a vessel or the object of a preposition."""
    return _flags(spark, lambda t: panels.not_contents(*t.split("|")), "NET |", "aged in |", "| oak casks", "serving size |", "| BARREL PROOF", "| of alcohol")


@case("id hit", (0, True), (1, False), (2, False), (3, True), (4, False))
def ingredient_shares(spark: SparkSession) -> DataFrame:
    def share(t: str) -> bool:
        m = panels.PERCENT.search(t)
        return panels.names_ingredient(t, m.start(), m.end())

    return _flags(spark, share, "75% CORN", "45% Akc. by Vol.", "40%", "WHEAT: 30%", "12.5% alcohol")


@case("id hit", (0, True), (1, False), (2, False), (3, False), (4, True), (5, True))
def designation_lines(spark: SparkSession) -> DataFrame:
    """A class as whole words; "Virginia" has no gin in it and a bottler's line is none."""
    return _flags(spark, panels.names_designation, "Straight RYE Whisky", "Distilled in Virginia", "imported by Wine World", "Portland", "a MALT BEVERAGE", "india pale ale")


@case("id hit", (0, True), (1, False), (2, False))
def lead_in_lines(spark: SparkSession) -> DataFrame:
    return _flags(spark, panels.only_lead_in, "PRODUCED AND BOTTLED BY:", "Bottled by Hop River", "Hop River")


@case("id hit", (0, True), (1, False), (2, True), (3, False))
def state_or_barcode(spark: SparkSession) -> DataFrame:
    """A State is no country, and a run of digits and bars is no text."""
    return _flags(spark, lambda t: panels.names_state(t) or bool(panels.BARCODE.match(t)), "New  York", "Ireland", "0 12345 | 67890", "No. 66")


_FACES = [
    ("a", 10, 10, 110, 40, "HOP", 0.9), ("a", 12, 44, 112, 74, "RIVER", 0.9), ("a", 10, 100, 140, 112, "India Pale Ale", 0.8), ("a", 10, 120, 100, 130, "5.5% ALC. BY VOL.", 1.0), ("a", 10, 140, 90, 150, "12 FL OZ (355 mL)", 1.0), ("a", 10, 160, 90, 170, "PRODUCT", 0.7), ("a", 10, 172, 90, 182, "OF IRELAND", 0.7),
    ("a", 10, 200, 120, 210, "BOTTLED BY", 1.0), ("a", 10, 212, 120, 222, "Hop River LLC, Stamford, Connecticut", 1.0), ("a", 10, 260, 160, 270, "GOVERNMENT WARNING: (1) According to", 0.9), ("a", 10, 272, 160, 282, "the Surgeon General, alcohol causes health problems. Recycle", 0.9), ("a", 10, 330, 160, 340, "0 12345 67890 1", 0.9),
    ("b", 0, 0, 50, 10, "90", 1.0), ("b", 55, 0, 90, 10, "PROOF", 1.0), ("b", 0, 12, 90, 22, "45% ALC/VOL", 1.0), ("b", 0, 60, 90, 70, "aged in 200 L casks", 1.0), ("b", 0, 80, 90, 90, "75% CORN", 1.0), ("b", 0, 120, 90, 130, "women should not drink", 1.0),
]


def _faces(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, *map(float, r[:4]), *r[4:]) for f, *r in _FACES], "face string, x0 double, y0 double, x1 double, y1 double, text string, score double")


@case("face field found confidence", ("a", "brand_name", "HOP RIVER", 0.675), ("a", "class_type", "India Pale Ale", 0.68), ("a", "abv", "5.5% ALC. BY VOL.", 0.95), ("a", "net_contents", "mL", 0.95), ("a", "country_origin", "IRELAND", 0.665), ("a", "name_address", "Stamford", 0.773333), ("a", "gov_warning", "GOVERNMENT WARNING: (1) According to the Surgeon General, alcohol causes health problems.", 0.9), ("b", "brand_name", "90 PROOF", 0.75), ("b", "class_type", "", 0.0), ("b", "abv", "45% ALC/VOL", 0.95), ("b", "net_contents", "", 0.0), ("b", "country_origin", "", 0.0), ("b", "name_address", "", 0.0), ("b", "gov_warning", "", 0.0))
def face_fields(spark: SparkSession) -> DataFrame:
    """The seven fields of two faces from their boxes."""
    said = F.coalesce(*(F.get_json_object("payload", f"$.{k}") for k in ("text", "unit", "country", "city")))
    return panels.read_faces(_faces(spark), ["face"]).select("face", "field", said.alias("found"), "confidence")


@case("face value beside", ("b", "90", True))
def face_proofs(spark: SparkSession) -> DataFrame:
    """Proof figures across the boxes of a line, and whether they stand beside the alcohol statement."""
    p = F.from_json(F.get_json_object("payload", "$.proofs"), "array<struct<value:string,beside:boolean>>")
    return panels.read_faces(_faces(spark), ["face"]).filter("field = 'abv'").select("face", F.explode(p).alias("p")).select("face", "p.value", "p.beside")


@case("face words wording_only", ("a", 0, False), ("b", 2, False))
def statement_words(spark: SparkSession) -> DataFrame:
    """Words of the warning's statement where its heading isn't read."""
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    return panels.read_faces(_faces(spark), ["face"]).filter("field = 'gov_warning'").select("face", get("words_seen").cast("bigint").alias("words"), get("wording_only").cast("boolean").alias("wording_only"))


@case("face n_candidates joined", ("b", 9, False), ("a", 16, True))
def brand_candidates(spark: SparkSession) -> DataFrame:
    """Candidate names of a face: boxes, runs along a line, runs down a block."""
    c = F.from_json(F.get_json_object("payload", "$.candidates"), "array<string>")
    return panels.read_faces(_faces(spark), ["face"]).filter("field = 'brand_name'").select("face", F.size(c).cast("bigint").alias("n_candidates"), F.array_contains(c, "HOP RIVER").alias("joined"))


@case("face rotation", ("a", 90), ("b", 0))
def best_frame(spark: SparkSession) -> DataFrame:
    """The rotated frame that reaches the warning's end, then the one of most words, then the least turned."""
    rows = [("a", 0, False, 90), ("a", 90, True, 20), ("a", 180, True, 10), ("b", 0, False, 5), ("b", 90, False, 5)]
    return panels.best_frames(spark.createDataFrame(rows, "face string, rotation bigint, reaches_end boolean, n_words int"), ["face"])


@case("face text", ("a", "RIVER"), ("b", "first"))
def largest_type(spark: SparkSession) -> DataFrame:
    """The text in the largest type, the first one of two alike."""
    df = spark.createDataFrame([("a", 0, 0.0, 10.0, "hop"), ("a", 1, 0.0, 30.0, "RIVER"), ("b", 0, 0.0, 10.0, "first"), ("b", 1, 5.0, 15.0, "second")], "face string, box int, y0 double, y1 double, text string")
    return layout.largest_type(df, "face")


@case("box line", (0, 0), (1, 1), (2, 0), (3, 2))
def text_lines(spark: SparkSession) -> DataFrame:
    """Boxes by line: one that overlaps the last box of a line by half its height joins it."""
    rows = [("a", 0, 0.0, 0.0, 10.0, 10.0), ("a", 1, 1.0, 20.0, 10.0, 30.0), ("a", 2, 12.0, 2.0, 20.0, 12.0), ("a", 3, 12.0, 50.0, 20.0, 60.0)]
    return _bigint(layout.lines(spark.createDataFrame(rows, "face string, box bigint, x0 double, y0 double, x1 double, y1 double"), "face"), "line")


# --- scalar functions


@case("id canonical skeleton", (0, "stone's throw", "stonesthrow"), (1, "acme", "acme"), (2, "a&w #7", "a&w#7"), (3, "no. 1.5", "no1.5"), (4, "", ""))
def canonical_forms(spark: SparkSession) -> DataFrame:
    """Trade marks off, straight quotes, no accents, single blanks; then without marks but those that stand for something."""
    c = X.canonical(F.col("text"))
    return _texts(spark, " Stone’s  THROW ", "ÄCMÉ™", "A&W #7", "No. 1.5", "®").select("id", c.alias("canonical"), X.skeleton(c).alias("skeleton"))


@case("id article short", (0, "old mill distillery", "old mill"), (1, "the", ""), (2, "company", ""), (3, "brewing dog", ""))
def shortened_names(spark: SparkSession) -> DataFrame:
    """A leading article off; then the last words that a name may lose, unless none or all would go."""
    w = X.without_article(X.norm_words(F.col("text")))
    return _texts(spark, "The Old Mill Distillery", "The", "Company", "Brewing Dog").select("id", F.array_join(w, " ").alias("article"), F.array_join(X.shortened(w, _TRAILING), " ").alias("short"))


@case("id one", (0, True), (1, True), (2, False), (3, True))
def one_edit(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame([(0, "mill", "mills"), (1, "étoile", "etoile"), (2, "mill", "lmil"), (3, "", "x")], "id bigint, a string, b string")
    return df.select("id", X.within_one_edit(F.col("a"), F.col("b")).alias("one"))


@case("id written", (0, "OLD—Mill"), (1, None), (2, "a b"))
def written_forms(spark: SparkSession) -> DataFrame:
    """The stretch of a text that spells given words, as it is written there."""
    df = spark.createDataFrame([(0, "By the OLD—Mill, Co.", ["old", "mill"]), (1, "gold mill", ["old", "mill"]), (2, "x a b a b", ["a", "b"])], "id bigint, text string, words array<string>")
    return df.select("id", projections.text_as_written(F.col("text"), F.col("words")).alias("written"))


def _digest(*parts: str) -> str:
    return hashlib.sha256(b"".join(len(p.encode()).to_bytes(8, "big") + p.encode() for p in parts)).hexdigest()


@case("id digest", (0, _digest("ab", "c")), (1, _digest("a", "bc")), (2, _digest("é", "")))
def framed_digests(spark: SparkSession) -> DataFrame:
    """Digests of several values, each led by its length: no two splits coincide."""
    df = spark.createDataFrame([(0, "ab", "c"), (1, "a", "bc"), (2, "é", None)], "id bigint, a string, b string")
    return df.select("id", X.framed(F.col("a"), F.col("b")).alias("digest"))


@case("id names", (0, "Blue Hen,Red Hen"), (1, ""), (2, "Blue Hen"))
def names_used(spark: SparkSession) -> DataFrame:
    """Trade names behind the last ZIP code, before each mark, each once."""
    df = _texts(spark, "A Co, 1 Main St 10001 Albany NY 12345 Blue Hen (Used on label), Red Hen (used on label)", "A Co, Albany NY 12345", "A Co 12345-6789 Blue Hen (Used on label) Blue Hen (used on label)")
    return df.select("id", F.array_join(X.trade_names(F.col("text")), ",").alias("names"))


@case("version place", ("0.2.0", 1), ("0.10.0", 2), ("0.10.1-rc", 3))
def version_order(spark: SparkSession) -> DataFrame:
    """Versions by their numbers."""
    df = spark.createDataFrame([("0.10.1-rc",), ("0.2.0",), ("0.10.0",)], "version string")
    return df.select("version", F.array_position(F.array_sort(F.array(*(X.version_key(F.lit(v)) for v in ("0.10.1-rc", "0.2.0", "0.10.0")))), X.version_key(F.col("version"))).cast("bigint").alias("place"))


@case("id shown", (0, "40% ALC. BY VOL."), (1, "40 %"), (2, "750 mL"), (3, "GOVERNMENT WARNING: drink less"), (4, "Government Warning: x"), (5, "Hop River"), (6, ""))
def display_readings(spark: SparkSession) -> DataFrame:
    rows = [(0, "alcohol", None, "40% ALC. BY VOL.", 40.0, "%", None), (1, "alcohol", None, " ", 40.0, "%", None), (2, "contents", None, None, 750.0, "mL", None), (3, "warning", "drink less", None, None, None, "GOVERNMENT WARNING:"), (4, "warning", "Government Warning: x", None, None, None, "GOVERNMENT WARNING:"), (5, "brand", "Hop River", None, None, None, None), (6, "brand", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id bigint, field string, text string, printed string, amount double, unit string, heading string")
    return df.select("id", projections.display_reading(*map(F.col, ("field", "text", "printed", "amount", "unit", "heading"))).alias("shown"))


@case("id unreadable photo", (0, True, "BLUR"), (1, False, "DARK"), (2, False, None))
def photo_faults(spark: SparkSession) -> DataFrame:
    """Faces that only the quality gate spoke for, and the first code that asks for a better photograph: of the findings, else of the trace."""
    df = spark.createDataFrame([(0, ["quality"], ["A", "BLUR"], ["DARK"]), (1, ["quality", "brand"], ["A"], ["X", "DARK"]), (2, [], [], [])], "id bigint, fields array<string>, findings array<string>, traced array<string>")
    return df.select("id", projections.unreadable(F.col("fields")).alias("unreadable"), projections.photo_needed(F.col("findings"), F.col("traced"), ["BLUR", "DARK"]).alias("photo"))


@case("id confidence", (0, 0.4), (1, 0.0), (2, 0.0))
def evidence_confidence(spark: SparkSession) -> DataFrame:
    """The least confidence of the evidence; 0 without any."""
    df = spark.createDataFrame([(0, [0.9, 0.4]), (1, []), (2, None)], "id bigint, evidence array<double>")
    return df.select("id", F.coalesce(F.array_min("evidence"), F.lit(0.0)).alias("confidence"))


# --- images, files, packs


@case("id fault", (0, "low_resolution"), (1, None), (2, None))
def image_quality(spark: SparkSession) -> DataFrame:
    """A flat image is without detail, one of noise is sharp, none has no verdict."""
    flat, noisy = [[5.0] * 16] * 16, [[float((x * 37 + y * 91) % 255) for x in range(16)] for y in range(16)]
    df = spark.createDataFrame([(0, flat), (1, noisy), (2, None)], "id bigint, grey array<array<double>>").select("id", images.measure("grey").alias("m"))
    return df.select("id", images.quality(F.col("m")).alias("fault"))


@case("id kind dpi", (0, "png", 300.0), (1, "jpeg", 254.0), (2, None, 72.0))
def image_facts(spark: SparkSession) -> DataFrame:
    """Kinds by the first bytes; dots an inch from the file, else EXIF (by centimetre, too), else as declared."""
    df = spark.createDataFrame([(0, "89504E470D0A1A0A00", 300.0, None, None, 72.0), (1, "FFD8FFE0", None, 100.0, "cm", 72.0), (2, "474946", None, None, None, 72.0)], "id bigint, head string, stated double, exif double, unit string, declared double")
    return df.select("id", images.image_kind(F.unhex("head")).alias("kind"), images.resolution(F.col("stated"), F.col("exif"), F.col("unit"), F.col("declared")).alias("dpi"))


@case("name refused", ("ok.png", None), ("big.png", "too large"), ("wide.png", "too many pixels"), ("a.png", "too many files"), ("b.png", "too many files"))
def admitted_files(spark: SparkSession) -> DataFrame:
    rows = [("r1", "ok.png", 1000, 100, 100), ("r1", "big.png", 2_000_000, 100, 100), ("r1", "wide.png", 1000, 100_000, 100_000), ("r2", "a.png", 1, 1, 1), ("r2", "b.png", 1, 1, 1)]
    df = spark.createDataFrame(rows, "request string, name string, length bigint, width int, height int")
    return readers.admitted(df.filter("request = 'r1'")).unionByName(readers.admitted(df.filter("request = 'r2'"), most_files=1))


_PIN = hashlib.sha256(b"keep away").hexdigest()


@case("fault", ("reason code a.b: bad form",), ("w: r1: twice",), ("w: r1: unknown validator none",), ("w: r1: unknown reason code X.Y",), ("w: r2: no table units",), ("w: r2: unknown severity odd",), ("w: r2: floor outside [0, 1]",), ("w: r2: asset gone.txt has another hash",), ("w: ?: no rule_id",), ("w: ?: no classes",), ("w: ?: no asset none.txt",))
def pack_faults(spark: SparkSession) -> DataFrame:
    """All faults of a rule pack together: an asset is hashed after the steps that it states."""
    ok = {"_file": "w", "validator": "presence", "classes": ["wine"], "severity": "warn"}
    rules = [ok | {"rule_id": "r1", "asset": "text.txt", "sha256": _PIN, "canonical": ["collapse_ws", "casefold"]}, ok | {"rule_id": "r1", "validator": "none", "reason_code": "X.Y"}, ok | {"rule_id": "r2", "severity": "odd", "floor": 2, "table_ref": "units", "asset": "gone.txt", "sha256": _PIN}, {k: v for k, v in ok.items() if k != "classes"} | {"asset": "none.txt"}]
    texts = {"text.txt": "Keep\n AWAY ", "gone.txt": "Keep AWAY"}
    faults = readers.faults_of(rules, [{"code": "A.B"}, {"code": "a.b"}], {}, {"presence"}, texts.get)
    return spark.createDataFrame([(f,) for f in faults], "fault string")


@case("image box x0 text score", ("a.png", 0, 1.24, "HOP", 0.9877), ("a.png", 1, 3.0, "RIVER", 1.0), ("b.png", 0, 0.0, "ale", 0.5))
def frozen_readings(spark: SparkSession) -> DataFrame:
    """Readings frozen as JSON and read back: rounded, one row a box."""
    rows = [("a.png", [10, 10], 0, [([1.239, 2.0, 3.0, 4.0], "HOP", 0.98767), ([3.0, 2.0, 5.0, 4.0], "RIVER", 1.0)]), ("b.png", [10, 10], 90, [([0.0, 0.0, 1.0, 1.0], "ale", 0.5)])]
    df = spark.createDataFrame(rows, f"image string, frame_size array<int>, rotation_deg int, boxes array<{readers.BOX}>")
    sinks.freeze_readings(df, path := f"{shared_dir(spark).rstrip('/')}/readings-{uuid.uuid4().hex}")
    return _bigint(readers.readings(spark, path, lines=True), "box")


@case("id face image rank", ("c1", "front", "f.png", 0), ("c1", "back", "b.png", 1))
def manifest_cases(spark: SparkSession) -> DataFrame:
    """Images of the real entries of a manifest, in the order of the faces."""
    entries = [{"id": "c1", "kind": "real", "beverage_type": "wine", "images": {"back": "b.png", "front": "f.png"}}, {"id": "c2", "kind": "made", "images": {"front": "x.png"}}]
    path = f"{shared_dir(spark).rstrip('/')}/manifest-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(entries),)], "value string").coalesce(1).write.text(path)
    return _bigint(readers.manifest(spark, path), "rank")


@case("id brand abv net place", (0, True, True, True, True), (1, False, False, False, False), (2, None, None, None, True), (3, True, None, True, False))
def reading_scores(spark: SparkSession) -> DataFrame:
    """Whether a reader got what a label prints; null where the label gives nothing to score against, which leaves the denominator."""
    rows = [(0, "Hop River", "the HOP RIVER ale", 5.0, 5.04, 750.0, 752.0, "Bottled by Hop River, Stamford", "Hop River, Stamford"), (1, "Hop River", "lone rider", 5.0, 5.1, 750.0, None, "Bottled by Hop River", "Hop Stamford River"), (2, None, "x", None, 5.0, None, 1.0, None, ""), (3, "Hop", "hop", None, None, 1.0, 2.0, None, "Hop River")]
    df = spark.createDataFrame(rows, "id bigint, brand string, brand_read string, abv double, abv_read double, ml double, ml_read double, place string, place_read string")
    return df.select("id", *(v.alias(k) for k, v in records.scores().items()))
