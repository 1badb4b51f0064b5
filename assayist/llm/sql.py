"""SQL of the text queries, on lists of its own for what a reader sees (:mod:`assayist.plans.folding`)."""

from __future__ import annotations

from assayist.plans.folding import seen


def p1_found() -> str:
    a, b = seen("extracted_value"), seen("expected_value")
    return f"SELECT finding_id FROM field_finding WHERE extracted_value <> expected_value AND extracted_value <> '' AND expected_value <> '' AND {a} = {b} AND {a} <> ''"


def p1_forms() -> str:
    return f"SELECT finding_id, {seen('extracted_value')} AS extracted_form, {seen('expected_value')} AS expected_form FROM field_finding"


def p7_found(words: int = 12) -> str:
    plain = lambda c: seen(f"regexp_replace(replace({c}, '&nbsp;', ' '), '</?[A-Za-z][^<>]*>', ' ', 'g')")
    text = lambda c: f"regexp_extract_all(lower({plain(c)}), '[\\p{{L}}\\p{{N}}]+')"
    grams = lambda key, col, table: f"SELECT DISTINCT {key}, array_to_string(w[i:i + {words - 1}], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - {words - 2})) AS i FROM (SELECT {key}, {text(col)} AS w FROM {table}))"
    return f"SELECT DISTINCT d.doc_id, t.item_id FROM ({grams('doc_id', 'text', 'documents')}) d JOIN ({grams('item_id', 'item_text', 'eval_item')}) t USING (g)"
