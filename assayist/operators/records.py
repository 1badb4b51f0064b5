"""Declared records: what an application states, in the shapes that the rules, the form and the corpus need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayist.functions.text import file_key, has_run, norm_words, trade_names

_EXPECTED = "struct<field:string,value:string,amount:double,other_names:array<string>,required:boolean>"


def _stated(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def expected_values(records: DataFrame, key: str) -> DataFrame:
    """Expected values of records: (key, field, value, amount, other_names, required), one to seven for each.

    ``records``: brand_name, fanciful_name, class_type, alcohol_text, alcohol_amount, net_text, net_amount, name_address,
    source, origin, appellation. The alcohol row is always there and says whether it is required; the origin row is there
    if a source is stated, without a value unless it is imported; the brand row carries the other admissible names.
    """

    def row(field: str, value: Column, amount: Column | None = None, names: Column | None = None, required: Column | None = None) -> Column:
        none = lambda t: F.lit(None).cast(t)
        return F.struct(F.lit(field).alias("field"), value.alias("value"), (none("double") if amount is None else amount.cast("double")).alias("amount"), (none("array<string>") if names is None else names).alias("other_names"), (none("boolean") if required is None else required).alias("required")).cast(_EXPECTED)

    c = lambda name: _stated(F.col(name))
    names = F.array_compact(F.concat(F.array(c("fanciful_name")), F.coalesce(trade_names(F.col("name_address")), F.array().cast("array<string>"))))
    if_stated = lambda name, r: F.when(c(name).isNotNull(), r)
    rows = F.array(
        if_stated("brand_name", row("brand_name", c("brand_name"), names=names)), if_stated("class_type", row("class_type", c("class_type"))),
        row("alcohol_content", c("alcohol_text"), F.col("alcohol_amount"), required=c("alcohol_text").isNotNull()),
        F.when(c("net_text").isNotNull() | F.col("net_amount").isNotNull(), row("net_contents", c("net_text"), F.col("net_amount"))),
        if_stated("name_address", row("name_address", c("name_address"))), if_stated("source", row("origin", F.when(F.lower(c("source")) == "imported", c("origin")), required=F.lower(c("source")) == "imported")), if_stated("appellation", row("appellation", c("appellation"))),
    )
    return records.select(key, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("e")).select(key, "e.*")


ENTRY = "id string, beverage_type string, application struct<brand_name:string,fanciful_name:string,class_type:string,alcohol_content:struct<value:string,percent:double>,net_contents:struct<value:string,ml:double>,applicant_name_address:string,source_of_product:string,origin:string,wine_appellation:string>"


def record_of_entry(entries: DataFrame) -> DataFrame:
    """Flat records of manifest entries (ENTRY)."""
    a = F.col("application")
    return entries.select(
        "id", "beverage_type", a.brand_name.alias("brand_name"), a.fanciful_name.alias("fanciful_name"), a.class_type.alias("class_type"), a.alcohol_content.value.alias("alcohol_text"), a.alcohol_content.percent.alias("alcohol_amount"), a.net_contents.value.alias("net_text"), a.net_contents.ml.alias("net_amount"),
        a.applicant_name_address.alias("name_address"), F.lower(a.source_of_product).alias("source"), a.origin.alias("origin"), a.wine_appellation.alias("appellation"),
    )


def form_of_entry(entries: DataFrame) -> DataFrame:
    """What the form posts for a manifest entry: texts, blank where absent; the origin of imported products only."""
    r = record_of_entry(entries)
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    plain = ["beverage_type", "brand_name", "fanciful_name", "class_type", "alcohol_text", "net_text", "name_address", "source", "appellation"]
    return r.select("id", *(text(c).alias(c) for c in plain), F.when(text("source") == "imported", text("origin")).otherwise("").alias("origin"))


REGISTRY = "record_id string, beverage_type string, source string, brand string, fanciful_name string, class_type_description string, applicant_name_address array<string>, images array<struct<type:string,file:string>>"


def registry_cases(records: DataFrame, kind: str = "spirits", source: str = "domestic", id_col: str = "record_id") -> DataFrame:
    """Cases of registry records (REGISTRY): front is the first image whose type begins with Brand, back with Back; other images are left out.

    Records of another kind or source are refused: they have a ``fault`` and no fields.
    """
    ok = F.coalesce((F.col("beverage_type") == kind) & (F.col("source") == source), F.lit(False))
    image = lambda prefix: F.get(F.filter("images", lambda i: i.type.startswith(prefix)), F.lit(0)).file
    fields = {"brand_name": F.col("brand"), "fanciful_name": F.col("fanciful_name"), "class_type": F.col("class_type_description"), "name_address": F.nullif(F.array_join("applicant_name_address", " "), F.lit("")), "front": image("Brand"), "back": image("Back")}
    return records.select(F.col(id_col).alias("id"), *(F.when(ok, v).alias(k) for k, v in fields.items()), F.when(~ok, F.concat_ws(" ", F.lit("not mapped:"), "source", "beverage_type")).alias("fault"))


def with_applications(labels: DataFrame, applications: DataFrame) -> DataFrame:
    """Labels (file) with the row of the applications file (filename, ...) that names one of their faces; null columns without one."""
    rows = applications.drop("file_key").withColumn("_key", file_key(F.col("filename"))).drop("filename")
    return labels.withColumn("_key", file_key(F.col("file"))).join(rows, "_key", "left").drop("_key")


def packed(samples: DataFrame, entries: DataFrame) -> DataFrame:
    """Samples (id, file) with their manifest entry's form; samples without an entry of kind ``real`` are left out."""
    return samples.join(form_of_entry(entries.filter("kind = 'real'").drop("kind")), "id")


def stripped(value: Column, keys: list[str]) -> Column:
    """A map of payload values without the keys that only the audit may see."""
    return F.map_filter(value, lambda k, v: ~k.isin(keys))


def payload_text(text: Column, payload: Column, key: str) -> Column:
    """A reading as text: itself, or the entry of its payload map; blank without either."""
    return F.coalesce(text, F.try_element_at(payload, F.lit(key)), F.lit(""))


def with_face(candidates: Column, face: Column) -> Column:
    """Candidate lines with the face that they were read on."""
    return F.transform(candidates, lambda c: c.withField("face", face))


def rounded_boxes(boxes: Column) -> Column:
    """Frozen boxes: coordinates with two decimals, scores with four (half to even)."""
    return F.transform(boxes, lambda b: F.struct(F.transform(b.box, lambda x: F.bround(x, 2)).alias("box"), b.text.alias("text"), F.bround(b.score, 4).alias("score")))


def streamed(envelopes: DataFrame) -> DataFrame:
    """Result events (batch_id, position, envelope struct) as flat rows."""
    return envelopes.select("batch_id", "position", "envelope.*")


def effective(rules: DataFrame) -> DataFrame:
    """The version date of a rule set: the latest effective date; null without any."""
    return rules.agg(F.max("effective_date").alias("effective_date"))


def timing(gaps: DataFrame, key: str, gap: str) -> DataFrame:
    """n, median, mean, least and largest gap between the results of a batch; the first result has none."""
    g = F.col(gap)
    return gaps.groupBy(key).agg(F.count(g).alias("n"), F.median(g).alias("median"), F.round(F.mean(g), 6).alias("mean"), F.min(g).alias("least"), F.max(g).alias("largest"))


def scores() -> dict[str, Column]:
    """Checks of a reading against what is printed (brand, abv, ml, place and their ``_read`` columns): true, false, or null if nothing is printed to check against.

    The brand is a run of the reading; figures are near; two neighbouring words of the place read stand in the place printed; where none is printed, reading none is right.
    """
    c, words = F.col, lambda x: norm_words(F.coalesce(F.col(x), F.lit("")))
    read, printed = words("place_read"), words("place")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(read) - 1, F.lit(1))), lambda i: F.slice(read, i, F.lit(2)))
    near = lambda a, b, most: F.when(a.isNotNull(), F.coalesce(F.abs(a - b) <= most, F.lit(False)))
    return {
        "brand": F.when(F.size(words("brand")) > 0, has_run(words("brand_read"), words("brand"))), "abv": near(c("abv"), c("abv_read"), F.lit(0.05)), "net": near(c("ml"), c("ml_read"), F.greatest(F.lit(1.0), c("ml") * 0.01)),
        "place": F.when(c("place").isNull(), F.size(read) == 0).otherwise(F.exists(pairs, lambda p: (F.size(p) == 2) & has_run(printed, p))),
    }
