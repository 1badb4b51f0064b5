import hashlib
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayist.operators import images, layout
from assayist.operators.validators import REGISTRY
from assayist.sources import readers, sinks
from assayist.streaming import events

RULE = "- {rule_id: r1, validator: presence, classes: [wine], severity: reject, reason_code: A.B, asset: text.txt, sha256: %s}\n"


def test_rule_pack(spark, tmp_path):
    (tmp_path / "tables").mkdir()
    (tmp_path / "tables" / "units.yaml").write_text("- {unit: ml, factor: 1}\n")
    (tmp_path / "text.txt").write_text("hello\n")
    (tmp_path / "reason_codes.yaml").write_text("- {code: A.B, description: d}\n")
    (tmp_path / "wine.yaml").write_text(RULE % hashlib.sha256(b"hello").hexdigest())
    pack = readers.rule_pack(spark, str(tmp_path), set(REGISTRY))
    assert pack["rules"].first().rule_id == "r1" and pack["reason_codes"].first().lean == "fail" and pack["table:units"].count() == 1
    (tmp_path / "bad.yaml").write_text(RULE % "0" + "- {rule_id: r2, validator: none, classes: [wine], severity: odd, reason_code: X, table_ref: t, floor: 2}\n- {rule_id: r3}\n")
    with pytest.raises(readers.PackError) as e:
        readers.rule_pack(spark, str(tmp_path), set(REGISTRY))
    for fault in ("r1: twice", "another hash", "unknown validator none", "unknown reason code X", "no table t", "unknown severity odd", "floor outside", "r3: no validator"):
        assert fault in str(e.value)


def test_applications(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿FileName, Brand_Name ,extra\r\na-front.jpg,X,1\r\nA.png,Y,2\r\n,Z,3\r\n,,\r\nb.jpg,,\r\n".encode())
    good, bad = readers.applications(spark, str(p))
    assert [(r.filename, r.brand_name) for r in good.collect()] == [("b.jpg", None)]
    assert sorted(r.fault for r in bad.collect()) == ["no file name", "two rows of one label", "two rows of one label"]
    sinks.write_applications(good, str(tmp_path / "out"))
    assert b"\r\n" in next((tmp_path / "out").glob("part*")).read_bytes()
    (tmp_path / "n.csv").write_text("x\n1\n")
    with pytest.raises(ValueError):
        readers.applications(spark, str(tmp_path / "n.csv"))


def test_readings_and_layout(spark, tmp_path):
    boxes = [{"box": [x, y, x + 40, y + 10], "text": t, "score": 0.9} for x, y, t in ((0, 0, "a"), (200, 0, "c"), (0, 20, "b"), (200, 20, "d"))]
    (tmp_path / "r.json").write_text(json.dumps({"image": "i", "schema_version": 2, "boxes": boxes}))
    df = readers.readings(spark, str(tmp_path / "r.json"))
    assert [r.text for r in layout.reading_order(df, "image").orderBy("position").collect()] == ["a", "b", "c", "d"]
    assert sorted((r.box, r.other) for r in layout.beneath(df, "image").collect()) == [(0, 2), (1, 3)]
    assert {r.text: r.line for r in layout.lines(df.drop("heading_measurement"), "image").collect()} == {"a": 0, "b": 1, "c": 0, "d": 1}
    assert layout.largest_type(df, "image").first().text == "a"
    (tmp_path / "old.json").write_text(json.dumps({"image": "i", "schema_version": 1, "boxes": boxes}))
    with pytest.raises(Exception, match="unknown version"):
        readers.readings(spark, str(tmp_path / "old.json")).collect()


def test_manifest_batches_images(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"id": "1", "kind": "real", "images": {"back": "b", "front": "f"}}, {"id": "2", "kind": "variant", "images": {"front": "x"}}]))
    assert [(r.face, r.image) for r in readers.manifest(spark, str(tmp_path / "m.json")).orderBy("rank").collect()] == [("front", "f"), ("back", "b")]
    b = spark.createDataFrame([("a", [("l1", "app-1"), ("l2", None)]), ("b", []), ("c", None), ("d", [("l", "x")] * 101)], "batch_id string, items array<struct<label_ref:string,application_ref:string>>").withColumn("agent_id", F.lit(None).cast("string")).withColumn("submitted_at", F.lit(None).cast("timestamp"))
    good, bad = readers.batch_items(b)
    assert [(r.position, r.label_ref) for r in good.collect()] == [(0, "l1"), (1, "l2")] and sorted(r.batch_id for r in bad.collect()) == ["b", "c", "d"]
    (tmp_path / "x.png").write_bytes(bytes.fromhex("89504E470D0A1A0A") + b"..")
    (tmp_path / "y.png").write_bytes(b"text")
    assert {r.kind: r.refused for r in readers.images(spark, str(tmp_path / "*.png")).collect()} == {"png": None, None: "not an image"}
    flat, noisy = [[5.0] * 16] * 16, [[float((x * 37 + y * 91) % 255) for x in range(16)] for y in range(16)]
    q = spark.createDataFrame([(0, flat), (1, noisy), (2, None)], "i int, g array<array<double>>").select("i", images.measure("g").alias("m")).select("i", images.quality(F.col("m")).alias("q"))
    assert {r.i: r.q for r in q.collect()} == {0: "low_resolution", 1: None, 2: None}


def test_section_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("words")
    (tmp_path / "manifest.json").write_text(json.dumps([{"section": "5.1", "file": "a.txt", "sha256": hashlib.sha256(b"words").hexdigest()}]))
    assert readers.section_texts(spark, str(tmp_path)).first().text == "words"


def test_results_and_log(spark, tmp_path):
    df = spark.createDataFrame([("e", "secret", None)], "evaluation_id string, extracted_value string, label_ref string")
    sinks.write_results(df, str(tmp_path / "r"), F.current_date())
    assert sinks.retained(spark, str(tmp_path / "r")).first().extracted_value == ""
    assert sinks.log_lines(df, ["evaluation_id", "extracted_value"], ["extracted_value"]).first().value == '{"evaluation_id":"e","extracted_value":""}'
    assert sinks.replay(spark.range(5).withColumn("k", F.lit(1)), "k", ["id"], 2).count() == 2


def test_latched_advisories(spark, tmp_path):
    """Four of a kind are silent, five fire once until that code is dismissed; a wrong dismissal and nulls do nothing."""
    seq = [("e", "a")] * 4 + [("e", None)] + [("e", "a")] * 3 + [("dismiss", "b")] + [("e", "a")] + [("dismiss", "a")] + [("e", "a")] * 5
    pd.DataFrame([("k", i, e, c) for i, (e, c) in enumerate(seq)], columns=["k", "seq", "event", "code"]).to_parquet(tmp_path / "e.parquet")
    s = spark.readStream.schema("k string, seq bigint, event string, code string").parquet(str(tmp_path / "*.parquet"))
    got = events.run_to_end(events.advisories(s, "k"), str(tmp_path / "adv")).collect()
    assert [(r.advisory_code, r.seq) for r in sorted(got, key=lambda r: r.seq)] == [("a", 5), ("a", 15)]
    e = spark.createDataFrame([("b1", "label-result"), ("b1", "refusal"), ("b2", "label-result")], "k string, event string")
    assert [(r.k, r.total, r.failed) for r in events.ended(e, spark.createDataFrame([("b1", 2), ("b2", 2)], "k string, expected int"), "k").collect()] == [("b1", 2, 1)]
