"""Queries of the record-verification operators over the label tables, each beside the SQL it must agree with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayist.functions import text as X
from assayist.operators import engine, layout, projections, validators, verdict, windows
from assayist.plans import folding
from assayist.session import read_table, shared_dir, small
from assayist.sources.readers import batch_items
from assayist.sources.sinks import blanked
from assayist.streaming import events as stream

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


RULES = [
    ("name.present", ["spirits", "wine", "malt"], ["brand_name"], False), ("class.listed", ["spirits"], ["class_type"], False), ("strength.stated", ["spirits", "wine"], ["alcohol_content", "abv"], False),
    ("volume.stated", ["spirits", "wine", "malt"], ["net_contents"], False), ("caution.verbatim", ["malt"], ["warning"], True), ("any.legible", ["wine"], None, False),
]
CLASSES = ["spirits", "wine", "malt"]
_FLAT_RULES = ", ".join(f"('{r}', '{c}', {'NULL' if e is None else repr(n)})" for r, cs, e, off in RULES if not off for c in cs for n in (e or [None]))


@query(f"""SELECT DISTINCT r.rule_id, f.finding_id FROM field_finding f JOIN (VALUES {_FLAT_RULES}) r(rule_id, class, name)
  ON r.class = CASE f.finding_id % 3 WHEN 0 THEN 'spirits' WHEN 1 THEN 'wine' ELSE 'malt' END AND (r.name IS NULL OR r.name = f.field_name OR (f.field_name = 'alcohol_content' AND r.name = 'abv'))""")
def rule_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, CLASSES)), F.pmod("finding_id", F.lit(3)).cast("int"))
    obs = read_table(spark, sf_dir, "field_finding").select(F.col("finding_id").alias("obs_id"), F.col("field_name").alias("field"), kind.alias("class"))
    rules = spark.createDataFrame(RULES, "rule_id string, classes array<string>, evidence array<string>, disabled boolean")
    return engine.applicable(obs, rules, {"alcohol_content": ["abv"]}).select("rule_id", F.col("obs_id").alias("finding_id"))


@query("SELECT application_id, 'fanciful_name' AS field, coalesce(fanciful_name, brand_name) AS expected_value FROM application UNION ALL SELECT application_id, 'brand_name', brand_name FROM application")
def expected_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    app = read_table(spark, sf_dir, "application")
    expected = app.select("application_id", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("brand_name", "fanciful_name")))).alias("e")).select("application_id", "e.*").filter("value is not null")
    obs = app.select("application_id", F.explode(F.array(F.lit("fanciful_name"), F.lit("brand_name"))).alias("field"))
    return engine.expected_of(obs, expected, ["application_id"], spark.createDataFrame([("fanciful_name", "brand_name", 1)], "field string, alias string, priority int"))


_DECLARED = ["brand_name", "fanciful_name", "wine_appellation", "source_of_product", "applicant_name"]


@query(" UNION ALL ".join(f"SELECT application_id, '{c}' AS field, {c} AS value FROM application WHERE trim({c}) <> ''" for c in _DECLARED))
def expected_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in _DECLARED))
    return read_table(spark, sf_dir, "application").select("application_id", F.explode(F.filter(rows, lambda x: F.trim(x.value) != "")).alias("e")).select("application_id", "e.*")


_RANK = "coalesce(list_position(['front', 'back', 'neck', 'side'], evidence.face_tag), 5)"


@query(f"SELECT finding_id FROM (SELECT finding_id, row_number() OVER (PARTITION BY evaluation_id, field_name ORDER BY (extracted_value <> '') DESC NULLS LAST, evidence.extraction_confidence DESC NULLS LAST, {_RANK}, finding_id) AS n FROM field_finding) WHERE n = 1")
def face_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = read_table(spark, sf_dir, "field_finding").select("finding_id", "evaluation_id", "field_name", "extracted_value", "evidence")
    pos = F.struct(windows.face_rank(F.col("evidence.face_tag")), F.col("finding_id"))
    return windows.merged_faces(f, ["evaluation_id", "field_name"], [F.col("extracted_value") != "", F.col("evidence.extraction_confidence")], pos).select("finding_id")


@query(f"SELECT evaluation_id, field_name, arg_min(extracted_value, {_RANK} * 1000000000000 + finding_id) FILTER (WHERE trim(extracted_value) <> '') AS extracted_value FROM field_finding GROUP BY 1, 2")
def first_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = read_table(spark, sf_dir, "field_finding").select("finding_id", "evaluation_id", "field_name", "extracted_value", "evidence")
    return windows.first_readable(f, ["evaluation_id", "field_name"], "extracted_value", F.struct(windows.face_rank(F.col("evidence.face_tag")), F.col("finding_id")))


@query("SELECT finding_id, CASE WHEN coalesce(trim(extracted_value), '') = '' AND evidence.bbox IS NULL THEN 'INSUFFICIENT' WHEN coalesce(trim(extracted_value), '') <> '' THEN 'PASS' ELSE 'FAIL' END AS outcome FROM field_finding")
def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = read_table(spark, sf_dir, "field_finding")
    return f.select("finding_id", validators.run("presence", validators.Inputs(F.col("extracted_value"), seen=F.col("evidence.bbox").isNotNull())).outcome.alias("outcome"))


@query("SELECT application_id, CASE WHEN coalesce(type_of_product <> 'wine', true) THEN 'NOT_APPLICABLE' WHEN coalesce(trim(wine_appellation), '') = '' THEN 'INSUFFICIENT' ELSE 'PASS' END AS outcome FROM application")
def conditional_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read_table(spark, sf_dir, "application")
    i = validators.Inputs(F.col("wine_appellation"), seen=F.lit(False), extra={"required": F.col("type_of_product") == "wine"})
    return a.select("application_id", validators.run("conditional_presence", i).outcome.alias("outcome"))


@query("SELECT p_partkey, CASE WHEN ' ' || lower(p_name) || ' ' LIKE '% ring %' OR ' ' || lower(p_name) || ' ' LIKE '% red widget %' THEN 'PASS' ELSE 'FAIL' END AS outcome FROM part")
def enumerated_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return p.select("p_partkey", validators.run("enumerated", validators.Inputs(F.col("p_name"), parameters={"allowed": ["Ring", "red widget"]})).outcome.alias("outcome"))


@query("SELECT application_id, CASE WHEN regexp_matches(permit_number, '(?i)^(DSP|BR|BWN|IMP)-[A-Z]{2}-[0-9]{5}$') THEN 'PASS' ELSE 'INSUFFICIENT' END AS outcome FROM application")
def format_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read_table(spark, sf_dir, "application")
    return a.select("application_id", validators.run("format", validators.Inputs(F.col("permit_number"), parameters={"pattern": "^(DSP|BR|BWN|IMP)-[A-Z]{2}-[0-9]{5}$"})).outcome.alias("outcome"))


@query("""SELECT unit, outcome, count(*) AS n FROM (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'ml' WHEN 1 THEN 'cl' ELSE 'floz' END AS unit, CASE WHEN p_size IS NULL THEN 'NOT_APPLICABLE'
  WHEN abs(l_quantity * f - p_size * 30.0) <= CASE WHEN f = 1.0 THEN greatest(abs(p_size * 30.0) * 1e-9, 1e-9) ELSE abs(p_size * 30.0) * 0.01 END THEN 'PASS' ELSE 'FAIL' END AS outcome
  FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 10.0::DOUBLE ELSE 29.5735295625::DOUBLE END AS f FROM lineitem) l JOIN part ON p_partkey = l_partkey) GROUP BY ALL""")
def quantity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").join(read_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    unit = F.get(F.array(F.lit("ml"), F.lit("cl"), F.lit("floz")), F.pmod("l_linenumber", F.lit(3)))
    i = validators.Inputs(F.lit(""), extra={"amount": F.col("l_quantity"), "unit": F.col("unit"), "declared": F.col("p_size") * 30.0}, parameters={"factors": {"ml": 1.0, "cl": 10.0, "floz": 29.5735295625}, "cross": 0.01})
    return rows.withColumn("unit", unit).select("unit", validators.run("quantity", i).outcome.alias("outcome")).groupBy("unit", "outcome").agg(F.count("*").alias("n"))


_WORDS = "' ' || array_to_string(regexp_extract_all(lower(country), '([0-9a-z]+)'), ' ') || ' '"


@query(f"SELECT application_id, CASE WHEN coalesce(source_of_product <> 'imported', true) THEN 'NOT_APPLICABLE' WHEN coalesce(trim(country), '') = '' THEN 'INSUFFICIENT' WHEN contains({_WORDS}, ' united states ') THEN 'PASS' ELSE 'INSUFFICIENT' END AS outcome FROM application")
def origin_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = validators.Inputs(F.col("country"), F.lit("United States"), extra={"imported": F.col("source_of_product") == "imported"})
    return read_table(spark, sf_dir, "application").select("application_id", validators.run("origin", i).outcome.alias("outcome"))


_CAUTION = "CONSUMER CAUTION: (1) This drink holds alcohol and slows your judgement. (2) Keep it out of the reach of minors."


@query(f"SELECT finding_id FROM field_finding WHERE field_name = 'warning' AND sha256(lower(trim(regexp_replace(extracted_value, '\\s+', ' ', 'g')))) = sha256(lower('{_CAUTION}'))")
def verbatim_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = validators.Inputs(F.col("extracted_value"), parameters={"text": _CAUTION, "steps": ["collapse_ws", "trim", "casefold"]})
    return read_table(spark, sf_dir, "field_finding").filter("field_name = 'warning'").filter(validators.run("verbatim", i).outcome == "PASS").select("finding_id")


@query(f"SELECT finding_id, CASE WHEN a = '' OR b = '' THEN 0 ELSE round(jaro_winkler_similarity(a, b), 6) END AS similarity FROM (SELECT finding_id, {folding.letters('extracted_value')} AS a, {folding.letters('expected_value')} AS b FROM field_finding WHERE field_name = 'brand_name' AND extracted_value <> '' AND expected_value <> '')")
def jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand finding with two values, in plain letters; each distinct pair is rated once. What shows no letter is like nothing."""
    folded = lambda c: F.lower(X.plain(F.col(c)))
    f = read_table(spark, sf_dir, "field_finding").filter("field_name = 'brand_name' and extracted_value <> '' and expected_value <> ''").select("finding_id", folded("extracted_value").alias("a"), folded("expected_value").alias("b"))
    return f.select("finding_id", F.when((F.col("a") == "") | (F.col("b") == ""), 0.0).otherwise(F.round(X.jaro_winkler("a", "b"), 6)).alias("similarity"))


def _canon(c: str) -> str:
    quotes = "'" + "''" * 3 + '""' + "'"
    return f"trim(regexp_replace({folding.letters(f"translate(regexp_replace({c}, '[®™©]', '', 'g'), '‘’ʼ“”', {quotes})")}, '\\s+', ' ', 'g'))"


def _words(c: str) -> str:
    """Words of a column as a list, '&' as "and", one spelling of whiskey."""
    return f"list_transform(regexp_extract_all({folding.letters(c)}, '([0-9a-z]+|&)'), lambda w: CASE WHEN w = '&' THEN 'and' WHEN w IN ('whisky', 'whiskies') THEN 'whiskey' ELSE w END)"


def _unled(w: str) -> str:
    return f"CASE WHEN len({w}) > 1 AND {w}[1] = 'the' THEN {w}[2:] ELSE {w} END"


_RUN = "len({1}) > 0 AND contains(' ' || array_to_string({0}, ' ') || ' ', ' ' || array_to_string({1}, ' ') || ' ')"
_BARE = "regexp_replace({0}, '\\s|[!\"''()*+,\\-./:;<=>?\\[\\\\\\]\\^_`{{|}}~$]', '', 'g')"


@query(f"""SELECT finding_id, o[1] AS outcome, o[2] AS code FROM (SELECT finding_id, CASE WHEN coalesce(trim(expected_value), '') = '' THEN ['NOT_APPLICABLE', NULL] WHEN a = b OR ({_RUN.format('v', 'w')}) OR ({_RUN.format('w', 'v')}) OR (sa = sb AND regexp_matches(sa, '[a-z0-9]')) OR jw >= 0.92 THEN ['PASS', NULL]
  WHEN trim(coalesce(extracted_value, '')) = '' AND NOT true THEN ['INSUFFICIENT', 'READ.MISSING'] WHEN jw >= 0.85 OR (len(a) > 1 AND len(b) > 1 AND a[1] <> b[1] AND jaro_winkler_similarity(a[2:], b[2:]) >= 0.85) THEN ['INSUFFICIENT', 'BRAND.NEAR'] ELSE ['INSUFFICIENT', 'BRAND.UNCERTAIN'] END AS o
  FROM (SELECT *, CASE WHEN a <> '' AND b <> '' THEN jaro_winkler_similarity(a, b) ELSE 0 END AS jw, {_BARE.format('a')} AS sa, {_BARE.format('b')} AS sb, {_unled('va')} AS v, {_unled('vb')} AS w FROM (SELECT finding_id, extracted_value, expected_value, {_canon('extracted_value')} AS a, {_canon('expected_value')} AS b, {_words('extracted_value')} AS va, {_words('expected_value')} AS vb FROM field_finding WHERE field_name = 'brand_name')))""")
def brand_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole brand cascade over both values of every brand finding; each distinct pair is compared once."""
    f = read_table(spark, sf_dir, "field_finding").filter("field_name = 'brand_name'").select("finding_id", "extracted_value", "expected_value")
    pair = ["extracted_value", "expected_value"]
    v = validators.run("brand", validators.Inputs(F.col("extracted_value"), F.col("expected_value")))
    rated = f.select(*pair).distinct().select(F.col(pair[0]).alias("a"), F.col(pair[1]).alias("b"), v.alias("v"))
    return f.join(rated, F.col(pair[0]).eqNullSafe(F.col("a")) & F.col(pair[1]).eqNullSafe(F.col("b"))).select("finding_id", "v.outcome", "v.code")


_KNOWN = "list_filter(k, lambda c: list_has_all({0}, string_split(c, ' ')))"


@query(f"""SELECT finding_id, o[1] AS outcome, o[2] AS code FROM (SELECT finding_id, CASE WHEN trim(coalesce(extracted_value, '')) = '' THEN ['FAIL', 'CLASS.ABSENT'] WHEN trim(coalesce(expected_value, '')) = '' THEN ['NOT_APPLICABLE', NULL]
  WHEN len(list_filter(s, lambda x: {_RUN.format('r', 'x')})) > 0 OR list_has_any(own, theirs) THEN ['PASS', NULL] WHEN len(own) > 0 AND len(theirs) > 0 AND list_has_all(list_distinct(flatten(list_transform(own, lambda c: string_split(c, ' ')))), r) THEN ['FAIL', 'CLASS.DIFFERS'] ELSE ['INSUFFICIENT', 'CLASS.UNCERTAIN'] END AS o
  FROM (SELECT *, {_KNOWN.format('r')} AS own, {_KNOWN.format('d')} AS theirs FROM (SELECT finding_id, extracted_value, expected_value, {_words('extracted_value')} AS r, {_words('expected_value')} AS d, list_transform(regexp_split_to_array(expected_value, '[/()]'), lambda x: {_words('x')}) AS s FROM field_finding WHERE field_name = 'class_type'), (SELECT list(DISTINCT regexp_replace(trim(lower(canonical_name)), '\\s+', ' ', 'g')) AS k FROM canonical_entry WHERE field_name = 'class_type')))""")
def designation_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared and read designations of every class finding, against the canonical classes.

    The classes meet the distinct values by their first word, an equality join, so a value sees only classes that begin with
    one of its words.
    """
    f = read_table(spark, sf_dir, "field_finding").filter("field_name = 'class_type'").select("finding_id", "extracted_value", "expected_value")
    names = read_table(spark, sf_dir, "canonical_entry").filter("field_name = 'class_type' and canonical_name is not null")
    classes = small(names.select(F.regexp_replace(F.lower(F.trim("canonical_name")), r"\s+", " ").alias("class")).distinct().select("class", F.get(F.split("class", " "), F.lit(0)).alias("word")))
    values = f.select(F.explode(F.array("extracted_value", "expected_value")).alias("value")).filter("value is not null").distinct()
    words = values.select("value", F.array_distinct(X.norm_words(F.col("value"))).alias("words"))
    met = words.select("value", "words", F.explode("words").alias("word")).join(classes, "word").filter(F.size(F.array_except(F.split("class", " "), "words")) == 0)
    known = met.groupBy("value").agg(F.collect_set("class").alias("known"))
    rows = f
    for side in ("extracted", "expected"):
        rows = rows.join(known.select(F.col("value").alias(f"{side}_value"), F.col("known").alias(f"{side}_known")), f"{side}_value", "left")
    v = validators.run("designation", validators.Inputs(F.col("extracted_value"), F.col("expected_value"), extra={"known": F.col("extracted_known"), "declared_known": F.col("expected_known")}))
    return rows.select("finding_id", v.alias("v")).select("finding_id", "v.outcome", "v.code")


@query("SELECT delivery_id, CASE WHEN confidence_numeric < 0.5 THEN 'low' WHEN confidence_numeric < 0.85 THEN 'medium' WHEN confidence_numeric <= 1 THEN 'high' END AS band FROM batch_message")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "batch_message").select("delivery_id", verdict.band(F.col("confidence_numeric")).alias("band"))


@query("""SELECT finding_id, CASE WHEN low THEN 'INSUFFICIENT' ELSE o END AS outcome, CASE WHEN low THEN split_part(reason_code, '.', 1) || '.READ.UNCERTAIN' ELSE reason_code END AS reason_code, CASE WHEN low THEN 'needs_review' WHEN o = 'PASS' THEN 'pass' WHEN o = 'FAIL' THEN 'fail' ELSE 'needs_review' END AS disposition
  FROM (SELECT *, CASE disposition WHEN 'pass' THEN 'PASS' WHEN 'fail' THEN 'FAIL' ELSE 'INSUFFICIENT' END AS o, coalesce(disposition = 'fail' AND evidence IS NOT NULL AND evidence.extraction_confidence < 0.8, false) AS low FROM field_finding)""")
def confidence_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("disposition")
    rows = read_table(spark, sf_dir, "field_finding").select(
        "finding_id", F.when(d == "pass", "PASS").when(d == "fail", "FAIL").otherwise("INSUFFICIENT").alias("outcome"), F.lit("reject").alias("severity"), "reason_code", F.lit(None).cast("string").alias("lean"),
        F.col("evidence.extraction_confidence").alias("confidence"), F.lit(0.8).alias("floor"), F.col("evidence").isNotNull().alias("has_evidence"), F.lit(False).alias("exempt"),
    )
    return verdict.with_floor(rows).select("finding_id", "outcome", "reason_code", verdict.rule_disposition(F.col("outcome"), F.col("severity")).alias("disposition"))


_LATTICE = "CASE WHEN count(disposition) = 0 THEN 'needs_review' WHEN bool_or(disposition = 'fail') THEN 'fail' WHEN bool_and(coalesce(disposition IN ('pass', 'not_applicable'), false)) THEN 'pass' ELSE 'needs_review' END"


@query(f"SELECT evaluation_id, {_LATTICE} AS disposition, count(*) AS n_fields FROM field_finding GROUP BY 1")
def disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "field_finding").groupBy("evaluation_id").agg(verdict.lattice(F.col("disposition")).alias("disposition"), F.count("*").alias("n_fields"))


@query(f"""SELECT v.label_ref, coalesce(o.applied, v.disposition) AS disposition, o.applied IS NOT NULL AS overridden FROM (SELECT label_ref, {_LATTICE} AS disposition FROM field_finding GROUP BY 1) v
  LEFT JOIN (SELECT label_ref, arg_max(lean, (delivered_at, delivery_id)) AS applied FROM batch_message WHERE lean IS NOT NULL AND delivered_at IS NOT NULL AND label_ref IS NOT NULL GROUP BY 1) o USING (label_ref)""")
def disposition_after_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read_table(spark, sf_dir, "field_finding").groupBy("label_ref").agg(verdict.lattice(F.col("disposition")).alias("disposition"))
    o = read_table(spark, sf_dir, "batch_message").filter("lean is not null and delivered_at is not null and label_ref is not null").select("label_ref", F.col("lean").alias("applied"), "delivered_at", "delivery_id")
    return verdict.corrected(v, o, ["label_ref"], ["delivered_at", "delivery_id"])


@query("SELECT evaluation_id, field_name, CASE max(CASE disposition WHEN 'fail' THEN 3 WHEN 'needs_review' THEN 2 WHEN 'pass' THEN 1 ELSE 0 END) WHEN 3 THEN 'fail' WHEN 2 THEN 'needs_review' WHEN 1 THEN 'pass' ELSE 'not_applicable' END AS disposition FROM field_finding GROUP BY 1, 2")
def field_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "field_finding").groupBy("evaluation_id", "field_name").agg(verdict.worst(F.col("disposition")).alias("disposition"))


@query("SELECT evaluation_id, coalesce(min(confidence_numeric), 0) AS confidence, CASE WHEN coalesce(min(confidence_numeric), 0) < 0.5 THEN 'low' WHEN min(confidence_numeric) < 0.85 THEN 'medium' ELSE 'high' END AS band FROM field_finding GROUP BY 1")
def min_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.coalesce(F.min("confidence_numeric"), F.lit(0.0))
    return read_table(spark, sf_dir, "field_finding").groupBy("evaluation_id").agg(c.alias("confidence")).withColumn("band", verdict.band(F.col("confidence")))


@query("SELECT evaluation_id, arg_min(coalesce(reason_code, '-'), CASE WHEN disposition = 'pass' THEN 1000000000000 ELSE 0 END + finding_id) AS headline_code FROM field_finding GROUP BY 1")
def headline_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.headline(read_table(spark, sf_dir, "field_finding").withColumn("reason_code", F.coalesce("reason_code", F.lit("-"))), ["evaluation_id"], "disposition", "reason_code", "finding_id")


@query("SELECT evaluation_id, finding_id FROM (SELECT evaluation_id, finding_id, row_number() OVER (PARTITION BY evaluation_id ORDER BY CASE disposition WHEN 'fail' THEN 0 WHEN 'needs_review' THEN 1 ELSE 2 END, CASE WHEN reason_code IS NOT NULL THEN 0 ELSE 1 END, finding_id) AS n FROM field_finding) WHERE n = 1")
def deciding_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = read_table(spark, sf_dir, "field_finding").select("evaluation_id", "finding_id", "disposition", "reason_code")
    return verdict.deciding(f, ["evaluation_id"], "disposition", F.col("reason_code").isNotNull(), "finding_id").select("evaluation_id", "finding_id")


_RECUR = "SELECT *, len(list_filter(list(coalesce(disposition, '')) OVER (PARTITION BY batch_id ORDER BY queue_position NULLS FIRST, delivery_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), lambda x: x = disposition)) AS times FROM batch_message WHERE batch_id IS NOT NULL"


@query(f"SELECT delivery_id, times::BIGINT AS times FROM ({_RECUR}) WHERE disposition IS NOT NULL AND times >= 5")
def anomaly_m_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read_table(spark, sf_dir, "batch_message").filter("batch_id is not null").select("batch_id", "queue_position", "delivery_id", "disposition")
    return windows.recurring(m, "batch_id", ["queue_position", "delivery_id"], "disposition").select("delivery_id", F.col("times").cast("bigint").alias("times"))


_FIRST = "SELECT *, len(list_filter(list(coalesce(disposition, '')) OVER (PARTITION BY batch_id ORDER BY delivery_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), lambda x: x = disposition)) AS times FROM batch_message WHERE batch_id IS NOT NULL"


@query(f"SELECT batch_id AS key, arg_min(disposition, delivery_id) AS advisory_code, min(delivery_id) AS seq FROM ({_FIRST}) WHERE disposition IS NOT NULL AND times >= 5 GROUP BY 1")
def stream_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latched advisories of a stream of batch results."""
    schema = read_table(spark, sf_dir, "batch_message").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/batch_message.parque[t]").filter("batch_id is not null")
    ev = rows.select("batch_id", F.col("delivery_id").alias("seq"), F.lit("label-result").alias("event"), F.col("disposition").alias("code"))
    return _streamed(stream.advisories(ev, "batch_id"), "advisories")


@query("SELECT evaluation_id, count(*) AS n FROM (SELECT DISTINCT evaluation_id FROM batch_message WHERE evaluation_id IS NOT NULL) GROUP BY 1")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each identifier of a stream of deliveries once; what is older than sixty days is let go, so the state is bounded. Rows without a time count as of the first day."""
    schema = read_table(spark, sf_dir, "batch_message").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/batch_message.parque[t]").filter("evaluation_id is not null").select("evaluation_id", F.coalesce("delivered_at", F.timestamp_seconds(F.lit(0))).alias("delivered_at"))
    return _streamed(stream.once(rows, ["evaluation_id"], "delivered_at", "60 days"), "once").groupBy("evaluation_id").agg(F.count("*").alias("n"))


def _streamed(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there into a table in the shared folder."""
    return stream.run_to_end(df, f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}")


@query("SELECT batch_id, sum(ok)::BIGINT AS cursor FROM (SELECT batch_id, min(CASE WHEN disposition IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY batch_id ORDER BY delivery_id) AS ok FROM batch_message) GROUP BY 1")
def cursor_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.completed_prefix(read_table(spark, sf_dir, "batch_message"), "batch_id", "delivery_id", F.col("disposition").isNotNull())


@query("SELECT count(*) AS n, count(*) FILTER (WHERE disposition = 'pass') AS n_pass, count(*) FILTER (WHERE disposition = 'fail') AS n_fail, count(*) FILTER (WHERE disposition = 'needs_review') AS n_needs_review, round_even(count(*) FILTER (WHERE disposition IN ('pass', 'fail')) / nullif(count(*), 0), 3) AS clear_share FROM batch_message")
def scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.scoreboard(read_table(spark, sf_dir, "batch_message"), "disposition")


@query("SELECT reason_code, count(*) AS n, min(finding_id) AS first_at FROM field_finding WHERE reason_code IS NOT NULL GROUP BY 1")
def causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.causes(read_table(spark, sf_dir, "field_finding"), "reason_code", "finding_id")


@query("SELECT rule_id, count(*) FILTER (WHERE disposition = 'pass') AS n_correct, count(disposition) AS n_scoreable, round(count(*) FILTER (WHERE disposition = 'pass') / nullif(count(disposition), 0), 6) AS accuracy FROM field_finding GROUP BY 1")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    right, all_ = F.count_if(F.col("disposition") == "pass"), F.count("disposition")
    return read_table(spark, sf_dir, "field_finding").groupBy("rule_id").agg(right.alias("n_correct"), all_.alias("n_scoreable"), F.round(right / F.nullif(all_, F.lit(0)), 6).alias("accuracy"))


@query("SELECT model_version, count(*) AS n, median(total_duration_ms)::DOUBLE AS median_ms, max(total_duration_ms) AS max_ms, round(count(*) FILTER (WHERE total_duration_ms <= 5000) / count(*), 6) AS within_5s FROM metrics WHERE total_duration_ms > 0 GROUP BY 1")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.col("total_duration_ms")
    return read_table(spark, sf_dir, "metrics").filter(ms > 0).groupBy("model_version").agg(F.count("*").alias("n"), F.median(ms).cast("double").alias("median_ms"), F.max(ms).alias("max_ms"), F.round(F.count_if(ms <= 5000) / F.count("*"), 6).alias("within_5s"))


@query("SELECT r.rule_id, count(*) AS n, sum(r.duration_ms)::BIGINT AS total_ms, max(r.duration_ms) AS max_ms FROM (SELECT unnest(per_rule_durations_ms) AS r FROM metrics) GROUP BY 1")
def rule_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "metrics").select(F.explode("per_rule_durations_ms").alias("r")).select("r.*")
    return rows.groupBy("rule_id").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"))


@query("SELECT delivery_id, floor((epoch_us(delivered_at) - epoch_us(lag(delivered_at) OVER (PARTITION BY batch_id ORDER BY delivered_at NULLS FIRST, delivery_id))) / 1000)::BIGINT AS gap_ms FROM batch_message")
def delivery_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read_table(spark, sf_dir, "batch_message").select("batch_id", "delivery_id", "delivered_at")
    return windows.gaps(m, "batch_id", "delivered_at", "delivery_id").select("delivery_id", "gap_ms")


@query("SELECT batch_id, queue_position, arg_max(coalesce(disposition, '-'), delivery_id) AS disposition, min(delivery_id) AS position FROM batch_message GROUP BY 1, 2")
def trace_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read_table(spark, sf_dir, "batch_message").withColumn("disposition", F.coalesce("disposition", F.lit("-")))
    return windows.upserted(m, ["batch_id", "queue_position"], "delivery_id", "disposition")


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def dedupe_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").filter("text is not null").groupBy(X.fingerprint(F.col("text")).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT b.batch_id, b.position::INT AS position, b.i.label_ref AS label_ref, a.application_id, a.brand_name FROM (SELECT batch_id, agent_id, unnest(items) AS i, unnest(range(len(items))) AS position FROM batch_submission WHERE len(items) BETWEEN 1 AND 100) b LEFT JOIN application a ON b.i.application_ref = 'app-' || a.application_id")
def batch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = batch_items(read_table(spark, sf_dir, "batch_submission"))
    app = read_table(spark, sf_dir, "application").select("application_id", "brand_name", F.concat(F.lit("app-"), F.col("application_id").cast("string")).alias("application_ref"))
    return items.join(app, "application_ref", "left").select("batch_id", "position", "label_ref", "application_id", "brand_name")


_IMAGES = "SELECT application_id, unnest(labels).image_ref AS image_ref FROM application"


@query(f"SELECT application_id, image_ref, regexp_replace(lower(image_ref), '-(front|back)$', '') AS file_key, coalesce(nullif(regexp_extract(lower(image_ref), '-(front|back)$', 1), ''), 'front') AS face FROM ({_IMAGES})")
def image_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = read_table(spark, sf_dir, "application").select("application_id", F.explode("labels.image_ref").alias("image_ref"))
    return f.select("application_id", "image_ref", X.file_key(F.col("image_ref")).alias("file_key"), X.file_face(F.col("image_ref")).alias("face"))


@query(f"SELECT label, count(*) AS n_faces, min(image_ref) AS arrived FROM (SELECT image_ref, CASE WHEN n = 1 THEN key ELSE key || '#' || face || '#' || n END AS label FROM (SELECT image_ref, regexp_replace(lower(image_ref), '-(front|back)$', '') AS key, coalesce(nullif(regexp_extract(lower(image_ref), '-(front|back)$', 1), ''), 'front') AS face, row_number() OVER (PARTITION BY regexp_replace(lower(image_ref), '-(front|back)$', ''), coalesce(nullif(regexp_extract(lower(image_ref), '-(front|back)$', 1), ''), 'front') ORDER BY image_ref) AS n FROM ({_IMAGES}))) GROUP BY 1")
def face_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = read_table(spark, sf_dir, "application").select(F.explode("labels.image_ref").alias("image_ref"))
    f = f.select("image_ref", X.file_key(F.col("image_ref")).alias("stem"), X.file_face(F.col("image_ref")).alias("face"))
    return windows.paired_faces(f, "stem", "face", "image_ref").select("label", F.size("faces").cast("bigint").alias("n_faces"), "arrived")


_BOX = "SELECT finding_id AS box, evaluation_id, evidence.bbox[1] AS x0, evidence.bbox[2] AS y0, evidence.bbox[1] + evidence.bbox[3] AS x1, evidence.bbox[2] + evidence.bbox[4] AS y1 FROM field_finding WHERE evidence.bbox IS NOT NULL AND evaluation_id IS NOT NULL"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = lambda i: F.get(F.col("evidence.bbox"), F.lit(i))
    f = read_table(spark, sf_dir, "field_finding").filter("evidence.bbox is not null and evaluation_id is not null")
    return f.select(F.col("finding_id").alias("box"), "evaluation_id", b(0).alias("x0"), b(1).alias("y0"), (b(0) + b(2)).alias("x1"), (b(1) + b(3)).alias("y1"), F.col("extracted_value").alias("text"))


@query(f"SELECT evaluation_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ({_BOX}) GROUP BY 1")
def union_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.union_box(_boxes(spark, sf_dir), ["evaluation_id"])


@query(f"SELECT evaluation_id, box, other, rank FROM (SELECT a.evaluation_id, a.box, b.box AS other, row_number() OVER (PARTITION BY a.evaluation_id, a.box ORDER BY b.y0 - a.y1, b.box) AS rank FROM ({_BOX}) a JOIN ({_BOX}) b ON a.evaluation_id = b.evaluation_id AND b.y0 >= a.y1 AND b.x0 < a.x1 AND b.x1 > a.x0) WHERE rank <= 3")
def nearest_beneath(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.beneath(_boxes(spark, sf_dir), "evaluation_id").select("evaluation_id", "box", "other", F.col("rank").cast("bigint").alias("rank"))


_COLS = f"SELECT *, sum(CASE WHEN n >= 4 AND x0 - reach >= greatest(span * 0.08, 8.0) THEN 1 ELSE 0 END) OVER (PARTITION BY evaluation_id ORDER BY x0, x1, box ROWS UNBOUNDED PRECEDING) AS col FROM (SELECT *, max(x1) OVER (PARTITION BY evaluation_id ORDER BY x0, x1, box ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, max(x1) OVER (PARTITION BY evaluation_id) - min(x0) OVER (PARTITION BY evaluation_id) AS span, count(*) OVER (PARTITION BY evaluation_id) AS n FROM ({_BOX}))"


@query(f"SELECT box, col::BIGINT AS column_no, row_no, row_number() OVER (PARTITION BY evaluation_id ORDER BY col, row_no, x0, box) AS position FROM (SELECT c.*, round_even(y0 / greatest(h * 0.7, 1e-9), 0)::BIGINT AS row_no FROM ({_COLS}) c JOIN (SELECT evaluation_id, col, median(y1 - y0) AS h FROM ({_COLS}) GROUP BY 1, 2) USING (evaluation_id, col))")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(_boxes(spark, sf_dir), "evaluation_id").select("box", F.col("column").cast("bigint").alias("column_no"), F.col("row").alias("row_no"), F.col("position").cast("bigint").alias("position"))


@query("SELECT finding_id, CASE WHEN extracted_value IS NOT NULL THEN '' END AS extracted_value, CASE WHEN label_ref IS NOT NULL THEN '' END AS label_ref, reason_code FROM field_finding")
def privacy_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blanked(read_table(spark, sf_dir, "field_finding").select("finding_id", "extracted_value", "label_ref", "reason_code"))


@query(f"SELECT doc_id, contains(' ' || array_to_string(regexp_extract_all({folding.letters('text')}, '([0-9a-z]+|&)'), ' ') || ' ', ' net contents line ') AS has_run FROM documents")
def word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of words in every document, accents, widths and look-alikes folded. A null text has a null."""
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", X.has_run(X.norm_words(F.col("text")), F.array(F.lit("net"), F.lit("contents"), F.lit("line"))).alias("has_run"))


@query("SELECT finding_id, try_cast(regexp_extract(extracted_value, '[0-9]+(?:\\.[0-9]+)?', 0) AS DOUBLE) AS number FROM field_finding WHERE field_name = 'net_contents'")
def first_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "field_finding").filter("field_name = 'net_contents'").select("finding_id", X.first_number(F.col("extracted_value")).alias("number"))


_CODES = [("BRAND.NAME.DIFFERS", "the name is another one", "fail"), ("CLASS.TYPE.DIFFERS", "the class is another one", "fail"), ("CAUTION.TEXT.DIFFERS", "the text is another one", "pass")]


@query(f"SELECT f.finding_id, f.reason_code, r.description AS explanation, CASE WHEN f.disposition = 'needs_review' THEN coalesce(r.lean, 'fail') END AS lean FROM field_finding f LEFT JOIN (VALUES {', '.join(map(str, _CODES))}) r(code, description, lean) ON f.reason_code = r.code")
def explain_and_lean(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame(_CODES, "code string, description string, lean string")
    none = F.lit(None).cast("string")
    out = engine.explained(read_table(spark, sf_dir, "field_finding"), registry, "reason_code", none)
    return out.select("finding_id", "reason_code", "explanation", verdict.lean(F.col("disposition"), none, F.col("registered_lean")).alias("lean"))


_PACK = [
    {"rule_id": "name.same", "field": "brand_name", "validator": "format", "severity": "warn", "parameters": {"pattern": r"^[A-Za-z& ]+$"}},
    {"rule_id": "strength.stated", "field": "alcohol_content", "validator": "format", "severity": "reject", "parameters": {"pattern": r"^[^0-9]*[0-9]"}},
    {"rule_id": "volume.stated", "field": "net_contents", "validator": "presence", "severity": "reject", "parameters": {"unlocated_is_absent": True}},
]


@query(f"""SELECT evaluation_id, {_LATTICE} AS disposition, count(*) AS n_results FROM (SELECT evaluation_id, CASE WHEN field_name = 'net_contents' THEN CASE WHEN coalesce(trim(extracted_value), '') <> '' THEN 'pass' ELSE 'fail' END
  WHEN field_name = 'brand_name' THEN CASE WHEN regexp_full_match(extracted_value, '[A-Za-z& ]+') AND trim(extracted_value) <> '' THEN 'pass' ELSE 'needs_review' END ELSE CASE WHEN regexp_matches(extracted_value, '^[^0-9]*[0-9]') THEN 'pass' ELSE 'needs_review' END END AS disposition
  FROM field_finding WHERE field_name IN ('brand_name', 'alcohol_content', 'net_contents')) GROUP BY 1""")
def verified_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path: rules over findings, dispositions, the verdict of each evaluation. One scan and one shuffle."""
    f = read_table(spark, sf_dir, "field_finding").select("evaluation_id", "field_name", "extracted_value")
    results = engine.checked(f, _PACK, lambda r: validators.Inputs(F.col("extracted_value"), seen=F.lit(False), parameters=r["parameters"]))
    return results.groupBy("evaluation_id").agg(verdict.lattice(verdict.rule_disposition(F.col("outcome"), F.col("severity"))).alias("disposition"), F.count("*").alias("n_results"))


@query("SELECT application_id, concat_ws(', ', nullif(trim(street), ''), nullif(trim(city), ''), nullif(trim(state), ''), nullif(trim(zip), '')) AS address FROM (SELECT application_id, CASE WHEN trim(street) <> '' THEN street END AS street, CASE WHEN trim(city) <> '' THEN city END AS city, CASE WHEN trim(state) <> '' THEN state END AS state, CASE WHEN trim(zip) <> '' THEN zip END AS zip FROM application)")
def reading_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.trim(F.col(c)) for c in ("street", "city", "state", "zip")]
    return read_table(spark, sf_dir, "application").select("application_id", projections.reading_text(parts).alias("address"))


_SLOTS = {"brand_name": "name", "class_type": "class", "alcohol_content": "strength", "net_contents": "volume"}


@query(f"SELECT slot, count(*) AS n FROM (SELECT CASE field_name {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _SLOTS.items())} END AS slot FROM field_finding) GROUP BY 1")
def field_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "field_finding").groupBy(projections.slot(F.col("field_name"), _SLOTS).alias("slot")).agg(F.count("*").alias("n"))


@query("""SELECT finding_id, 'vr/' || rule_id AS trace_id, disposition, NULL::VARCHAR AS evidence_ref FROM field_finding UNION ALL
  SELECT finding_id, 'rc/' || rule_id, disposition, 'reason_code/' || reason_code FROM field_finding WHERE disposition <> 'pass' AND reason_code IS NOT NULL""")
def audit_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.trace(read_table(spark, sf_dir, "field_finding"), ["finding_id"])


@query("SELECT application_id, CASE WHEN nullif(trim(type_of_product), '') IS NULL AND (nullif(trim(brand_name), '') IS NOT NULL OR nullif(trim(fanciful_name), '') IS NOT NULL) THEN 'no type' WHEN nullif(trim(type_of_product), '') NOT IN ('wine', 'malt_beverages') THEN 'unknown type' END AS fault FROM application")
def form_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    app = read_table(spark, sf_dir, "application").select("application_id", "type_of_product", "brand_name", "fanciful_name")
    return projections.form_record(app, ["type_of_product", "brand_name", "fanciful_name"], "type_of_product", ["wine", "malt_beverages"]).select("application_id", "fault")
