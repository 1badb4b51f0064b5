"""Queries that fold what they read, over all rows."""

from __future__ import annotations

import re

import duckdb

import __spark_entry__ as entry
from assayist.functions.characters import plain_text
from tests.oracle import rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"


def rows(name: str, columns: str) -> list[tuple]:
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()


def has_run(text: str | None) -> int | None:
    if text is None:
        return None
    words = ["and" if w == "&" else w for w in re.findall("[0-9a-z]+|&", plain_text(text).lower())]
    return int(any(words[i : i + 3] == ["net", "contents", "line"] for i in range(len(words))))


def test_word_runs_of_all_documents(spark, tmp_path):
    texts = ["the net contents line", "Thé NÉT cóntents Líne", "ｎｅｔ　ｃｏｎｔｅｎｔｓ ｌｉｎｅ", "nеt соntеnts line", "n​et contents li­ne", "nét-contents\nline", "nett contents line", "Ωnet contents lineΩ", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.has_run for r in entry.queries()["word_runs"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == [True, True, True, True, True, True, False, True, False, None]
    whole = rows_of_spark(entry.queries()["word_runs"](spark, SF))[1]
    assert dict(whole.keys()) == {d: has_run(t) for d, t in rows("documents", "doc_id, text")} and whole.total() == len(rows("documents", "doc_id"))
    assert rows_of_sql(entry.oracle_sql()["word_runs"], SF)[1] == whole


def test_similarity_of_all_brand_findings(spark, tmp_path):
    pairs = [("Étoile Vineyard", "etoile vineyard"), ("Ｏｌｄ Quаrry", "Old Quarry"), ("Old​ Mill", "Old Mill"), ("Märtha", "Marhta"), ("​", "Old Mill"), ("​", "​"), ("Martha", "Marhta"), ("", "x"), (None, "x"), ("x", None)]
    table = [(i, "brand_name", a, b) for i, (a, b) in enumerate(pairs)] + [(99, "class_type", "é", "e")]
    spark.createDataFrame(table, "finding_id bigint, field_name string, extracted_value string, expected_value string").write.parquet(f"{tmp_path}/field_finding.parquet")
    got = {r.finding_id: r.similarity for r in entry.queries()["jaro_winkler"](spark, str(tmp_path)).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 1.0, 3: 0.961111, 4: 0.0, 5: 0.0, 6: 0.961111}
    whole = rows_of_spark(entry.queries()["jaro_winkler"](spark, SF))[1]
    want = {i for i, f, a, b in rows("field_finding", "finding_id, field_name, extracted_value, expected_value") if f == "brand_name" and a and b}
    assert {i for i, _ in whole} == want and whole.total() == len(want)
    assert rows_of_sql(entry.oracle_sql()["jaro_winkler"], SF)[1] == whole
