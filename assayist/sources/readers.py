"""Sources: rule packs, application CSV, frozen readings, manifests, batch submissions, image files."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayist.functions.text import file_key
from assayist.operators.images import image_kind

RULE = "rule_id string, validator string, classes array<string>, evidence array<string>, severity string, floor double, reason_code string, table_ref string, asset string, sha256 string, disabled boolean, effective_date date, parameters string"
REASON = "code string, description string, lean string"
BOX = "struct<box:array<double>,text:string,score:double>"
READING = f"image string, schema_version int, frame_size array<int>, rotation_deg int, boxes array<{BOX}>, warning_boxes array<{BOX}>, heading_measurement struct<is_bold:boolean,relative_weight:double,confident:boolean>"
BATCH = "batch_id string, agent_id string, submitted_at timestamp, items array<struct<label_ref:string,application_ref:string>>"
APPLICATION = ["filename", "beverage_type", "brand_name", "fanciful_name", "class_type", "alcohol_content", "net_contents", "applicant_name_address", "source_of_product", "origin", "wine_appellation"]


class PackError(ValueError):
    """Everything that is wrong with a rule pack, together."""


#: Steps that an asset goes through before it is hashed, by name.
ASSET_STEPS = {"nfkc": lambda t: unicodedata.normalize("NFKC", t), "join_hyphens": lambda t: re.sub(r"-\s*\n\s*", "", t), "collapse_ws": lambda t: " ".join(t.split()), "drop_ws": lambda t: "".join(t.split()), "casefold": str.casefold, "trim": str.strip}


def canonical_asset(text: str, steps: list[str] | None = None) -> str:
    """An asset's text after the steps, in order; trimmed without any given, as it stands for an empty list. An unknown step is refused."""
    for step in ["trim"] if steps is None else steps:
        if step not in ASSET_STEPS:
            raise PackError(f"unknown step {step}")
        text = ASSET_STEPS[step](text)
    return text


def faults_of(rules: list[dict], codes: list[dict], tables: dict, validators: set[str], asset: Callable[[str], str | None]) -> list[str]:
    """All faults of loaded rules: what is missing, stands twice, is unknown, out of its range, or has another hash than it states."""
    known, seen, faults = {c["code"] for c in codes}, set(), [f"reason code {c['code']}: bad form" for c in codes if not re.fullmatch(r"[A-Z]+(\.[A-Z_]+)+", c["code"])]
    for r in rules:
        name = f"{r['_file']}: {r.get('rule_id', '?')}"
        text = asset(r["asset"]) if r.get("asset") else None
        checks = [
            *((not r.get(k), f"no {k}") for k in ("rule_id", "validator", "classes", "severity")), (r.get("rule_id") in seen, "twice"), (r.get("validator") not in validators, f"unknown validator {r.get('validator')}"), (bool(r.get("reason_code")) and r["reason_code"] not in known, f"unknown reason code {r.get('reason_code')}"),
            (bool(r.get("table_ref")) and r["table_ref"] not in tables, f"no table {r.get('table_ref')}"), (r.get("severity") not in ("reject", "warn", None), f"unknown severity {r.get('severity')}"), (not 0 <= float(r.get("floor", 0.5)) <= 1, "floor outside [0, 1]"), (bool(r.get("asset")) and text is None, f"no asset {r.get('asset')}"),
            (text is not None and hashlib.sha256(canonical_asset(text or "", r.get("canonical")).encode()).hexdigest() != r.get("sha256"), f"asset {r.get('asset')} has another hash"),
        ]
        seen.add(r.get("rule_id"))
        faults += [f"{name}: {what}" for bad, what in checks if bad]
    return faults


def rule_pack(spark: SparkSession, folder: str, validators: set[str]) -> dict[str, DataFrame]:
    """Rules, reason codes and tables of a folder of YAML files; raises one :class:`PackError` with all faults.

    ``reason_codes.yaml`` holds the codes, ``tables/*.yaml`` the decision tables, every other file a list of rules.
    """
    import json

    import yaml

    root, faults, rules, tables = Path(folder), [], [], {}
    codes = yaml.safe_load((root / "reason_codes.yaml").read_text()) if (root / "reason_codes.yaml").exists() else []
    if isinstance(codes, dict):  # {version, codes: {code: {...}}}
        if not re.fullmatch(r"\d+\.\d+\.\d+", str(codes.get("version", ""))):
            faults.append(f"reason codes: bad version {codes.get('version')}")
        codes = [{"code": k, **(v or {})} for k, v in (codes.get("codes") or {}).items()]
    for p in sorted(root.rglob("*.yaml")):
        if p.name == "reason_codes.yaml":
            continue
        if p.parent.name == "tables":
            tables[p.stem] = yaml.safe_load(p.read_text())
            continue
        rules += [r | {"_file": p.name} for r in yaml.safe_load(p.read_text()) or []]
    faults += faults_of(rules, codes, tables, validators, lambda a: (root / a).read_text() if (root / a).exists() else None)
    if faults:
        raise PackError("\n".join(faults))
    rows = [(r["rule_id"], r["validator"], r["classes"], r.get("evidence"), r["severity"], float(r.get("floor", 0.5)), r.get("reason_code"), r.get("table_ref"), r.get("asset"), r.get("sha256"), bool(r.get("disabled")), r.get("effective_date"), json.dumps(r.get("parameters", {}), sort_keys=True)) for r in sorted(rules, key=lambda r: r["rule_id"])]
    out = {"rules": spark.createDataFrame(rows, RULE), "reason_codes": spark.createDataFrame([(c["code"], c.get("description"), c.get("lean", "fail")) for c in codes], REASON)}
    return out | {f"table:{k}": spark.createDataFrame([{a: str(b) for a, b in row.items()} for row in v]) for k, v in tables.items() if v}


def applications(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, refused) of an application CSV: header names in any case, unknown columns ignored, blank rows skipped.

    Refused: a row without file name, and every row whose file key occurs twice.
    """
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).csv(path)
    by = {re.sub(r"^﻿", "", c).strip().casefold(): c for c in raw.columns}
    if "filename" not in by:
        raise ValueError("the file has no column filename")
    cols = [F.nullif(F.trim(F.col(f"`{by[c]}`")), F.lit("")).alias(c) if c in by else F.lit(None).cast("string").alias(c) for c in APPLICATION]
    df = raw.select(cols).filter(F.coalesce(*map(F.col, APPLICATION)).isNotNull()).withColumn("file_key", file_key(F.col("filename")))
    twice = df.groupBy("file_key").count().filter("count > 1 and file_key is not null").select("file_key")
    bad = df.filter("filename is null").withColumn("fault", F.lit("no file name")).unionByName(df.join(twice, "file_key", "left_semi").select(*df.columns, F.lit("two rows of one label").alias("fault")))
    return df.filter("filename is not null").join(twice, "file_key", "left_anti"), bad


def readings(spark: SparkSession, path: str, version: int = 2, lines: bool = False) -> DataFrame:
    """Boxes of frozen readings (JSON, one a file, or one a line): image, box number and position, text, score. Another version is refused."""
    df = spark.read.schema(READING).option("multiLine", not lines).json(path)
    ok = F.when(F.col("schema_version") == version, F.col("image")).otherwise(F.raise_error(F.concat(F.lit("unknown version of a reading: "), F.coalesce(F.col("schema_version").cast("string"), F.lit("none")))))
    boxes = df.select(ok.alias("image"), "rotation_deg", "heading_measurement", F.posexplode("boxes").alias("box", "b"))
    return boxes.select("image", "rotation_deg", "heading_measurement", "box", *(F.get("b.box", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))), "b.text", "b.score")


def manifest(spark: SparkSession, path: str, kind: str = "real") -> DataFrame:
    """Label cases of a manifest (JSON array): one row for each image, in the order of the faces."""
    df = spark.read.schema("id string, kind string, beverage_type string, images map<string,string>").option("multiLine", True).json(path)
    faces = ["front", "back", "neck", "side"]
    images = F.filter(F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(f).alias("face"), F.try_element_at("images", F.lit(f)).alias("image")) for i, f in enumerate(faces))), lambda x: x.image.isNotNull())
    return df.filter(F.col("kind") == kind).select("id", "beverage_type", F.explode(images).alias("i")).select("id", "beverage_type", "i.*")


def batch_items(batches: DataFrame, cap: int = 100) -> tuple[DataFrame, DataFrame]:
    """(queued items in order, refused batches) of submissions; a batch over the cap or empty is refused. Batch or stream."""
    size = F.coalesce(F.size("items"), F.lit(0))
    good = batches.filter((size > 0) & (size <= cap))
    return good.select("batch_id", "agent_id", "submitted_at", F.posexplode("items").alias("position", "i")).select("batch_id", "agent_id", "submitted_at", "position", "i.*"), batches.filter((size == 0) | (size > cap))


def admitted(files: DataFrame, most_bytes: int = 1_572_864, most_pixels: int = 50_000_000, most_files: int = 100, most_request: int = 33_030_144) -> DataFrame:
    """Files of requests (request, name, length, width, height) with why each is refused (null if it isn't): too large, too many pixels, or a request of too many files or bytes."""
    sums = files.groupBy("request").agg(F.count("*").alias("_n"), F.sum("length").alias("_all"))
    why = F.when(F.col("_n") > most_files, "too many files").when(F.col("_all") > most_request, "request too large").when(F.col("length") > most_bytes, "too large").when(F.col("width").cast("bigint") * F.col("height") > most_pixels, "too many pixels")
    return files.join(sums, "request").select(*files.columns, why.alias("refused"))


def images(spark: SparkSession, path: str, most_bytes: int = 1_572_864) -> DataFrame:
    """Image files by their first bytes: path, kind, refused (why, else null); the content is kept."""
    df = spark.read.format("binaryFile").load(path)
    kind = image_kind(F.col("content"))
    return df.select("path", "length", "content", kind.alias("kind"), F.when(kind.isNull(), "not an image").when(F.col("length") > most_bytes, "too large").alias("refused"))


def section_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of regulation sections (section, text) from a manifest of files whose hashes are pinned; another text is refused."""
    m = spark.read.option("multiLine", True).schema("section string, file string, sha256 string").json(f"{folder}/manifest.json")
    texts = spark.read.option("wholetext", True).text(f"{folder}/*.txt").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("text"))
    same: Column = F.sha2("text", 256) == F.col("sha256")
    return m.join(texts, "file", "left").select("section", F.when(same, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("another text: "), F.col("file")))).alias("text"))
