"""Cards, records, faces and streams on empty tables, nulls, repeated rows and clashing names."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from assayist.functions import marks as M
from assayist.operators import cards, panels, records, validators
from assayist.plans import cases
from assayist.streaming import events


def test_empty_tables(spark):
    shown, trace, overrides, labels = (f(spark) for f in (cases._cards, cases._trace, cases._overrides, cases._labels))
    assert cards.corrected_cards(shown.limit(0), overrides).count() == 0 and cards.corrected_cards(shown, overrides.limit(0)).count() == shown.count()
    assert {tuple(r) for r in cards.corrected_labels(labels, trace, shown, overrides.limit(0)).collect()} == set(cases._LABELS)
    assert cards.corrected_labels(labels.limit(0), trace, shown, overrides).count() == 0 and cards.label_leans(labels, trace.limit(0), shown.limit(0)).count() == 4
    assert cards.corrected_trace(trace, shown.limit(0), overrides.limit(0)).count() == len(cases._TRACE)
    entries = cases._entries(spark)
    assert records.expected_values(records.record_of_entry(entries.limit(0)), "id").count() == 0 and records.packed(spark.createDataFrame([], "id string, file string"), entries).count() == 0


def test_labels_of_which_nothing_is_known(spark):
    """A null lean or code counts as none; repeated corrections with one number give one row."""
    shown = cases._cards(spark)
    twice = cases._overrides(spark).unionByName(cases._overrides(spark))
    once = cards.corrected_labels(cases._labels(spark), cases._trace(spark), shown, cases._overrides(spark))
    assert sorted(map(tuple, cards.corrected_labels(cases._labels(spark), cases._trace(spark), shown, twice).collect())) == sorted(map(tuple, once.collect()))
    bare = spark.createDataFrame([("L9", "brand_name", None, None, None, None, None, None)], "label string, slot string, observed string, expected string, findings array<struct<rule_id:string,disposition:string,code:string,lean:string>>, disposition string, confidence double, lean string")
    assert cards.label_leans(spark.createDataFrame([("L9", "needs_review")], "label string, disposition string"), cases._trace(spark), bare).first().lean == "pass"


def test_faces_without_text(spark):
    boxes = spark.createDataFrame([("a", 0.0, 0.0, 0.0, 0.0, None, 0.0), ("a", 0.0, 0.0, 10.0, 10.0, "", 1.0), ("b", 0.0, 0.0, 10.0, 10.0, "x" * 50_000, 1.0)], "face string, x0 double, y0 double, x1 double, y1 double, text string, score double")
    got = panels.read_faces(boxes, ["face"]).collect()
    assert len(got) == 14 and all(r.confidence == 0.0 for r in got if r.face == "a")
    assert {r.field: json.loads(r.payload) for r in got if r.face == "b"}["brand_name"]["text"] == "x" * 50_000
    assert panels.read_faces(boxes.limit(0), ["face"]).count() == 0


def test_order_does_not_change_a_face(spark):
    faces = cases._faces(spark)
    one, other = ({tuple(r) for r in panels.read_faces(df, ["face"]).collect()} for df in (faces, faces.orderBy(F.desc("y1"), "text").repartition(3)))
    assert one == other


def test_brand_with_nulls(spark):
    df = spark.createDataFrame([(None, "Old Mill", None, None), ("Old Mill", "Old Mill", [None, "x"], [None]), ("x", None, None, None), ("y" * 20_000, "Old Mill", [], ["OLD-MILL"])], "r string, e string, t array<string>, l array<string>")
    v = validators.run("brand", validators.Inputs(F.col("r"), F.col("e"), seen=F.lit(None).cast("boolean"), extra={"trade_names": F.col("t"), "lines": F.col("l")}))
    assert [x.v.outcome for x in df.select(v.alias("v")).collect()] == ["INSUFFICIENT", "PASS", "NOT_APPLICABLE", "PASS"]


def test_differences():
    known = frozenset("keep away from fire and water".split())
    kinds = {"keep away from fire": "same", "keep away from flre": "reader", "keep away from fiire": "reader", "keep away from fyre": "unsure", "keep away and fire": "differs", "fire keep away from": "differs", "from fire keep away": "unsure", "": "unsure", "keep away from fire 750 ml": "reader"}
    assert {k: M.difference("keep away from fire", k, known) for k in kinds} == kinds


def test_snapshot_of_an_empty_stream(spark, tmp_path):
    spark.createDataFrame([], "label string, seq bigint, applied string").write.parquet(f"{tmp_path}/in")
    rows = events.intake(spark, f"{tmp_path}/in", "label string, seq bigint, applied string")
    assert events.snapshot(events.last_of(rows, ["label"], ["seq"], "applied"), f"{tmp_path}/out").count() == 0
