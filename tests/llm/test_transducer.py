import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayist.llm.transducer import Conflict, Transducer, resolved, visible, visible_form, visibly_same


@pytest.mark.parametrize(("a", "b"), [("Ｒｙｅ　３", "Rye 3"), ("Brûlé", "Brûlé"), ("Ne⁠utral", "Neutral"), ("а́", "á"), ("ﬂ oz", "fl oz"), ("a͏́", "á"), ("x y", "x y"), ("x\ty", "x y"), ("K", "K"), ("ё", "ё"), ("ậ", "ậ"), ("Å", "Å")])
def test_same(a, b):
    assert visible_form()(a) == visible_form()(b)


@pytest.mark.parametrize(("a", "b"), [("Rye", "rye"), ("cafe", "café"), ("a  b", "a b"), ("a-b", "a b"), ("a", "a."), ("’", "'"), ("а", "б")])
def test_different(a, b):
    assert visible_form()(a) != visible_form()(b)


@given(st.text(max_size=60))
def test_one_pass_is_enough(s):
    f = visible_form()
    assert f(f(s)) == f(s) == f(unicodedata.normalize("NFD", s)) == f(unicodedata.normalize("NFC", s))


def test_conflicts():
    for bad in ({"": "x"}, {"a": "b", "b": "c"}, {"ab": "xb", "a": "x"}):
        with pytest.raises(Conflict):
            Transducer(bad, "", "")
    t = Transducer({"ab": "1", "a": "2", "abc": "3"}, "", "́")
    assert t("é\x00") and t.scan.sub(t._cluster, "abcabaxa") == "312x2"


def test_rows(spark):
    rows = [(1, "Ｒｙｅ", "Rye", 1), (2, "Rye", "Rye", 1), (3, None, "Rye", 1), (4, "", "​", 1), (5, "​", "‍", 1), (6, "Ｒｙｅ" * 50_000, "Rye" * 50_000, 1), (7, "a\tb", "a b", 1), (8, "a", "b", 1), (1, "Ｒｙｅ", "Rye", 1)]
    df = spark.createDataFrame(rows, "id int, a string, b string, _l int")
    assert sorted(r.id for r in visibly_same(df.drop("_l"), "a", "b").collect()) == [1, 1, 6, 7]
    assert visibly_same(df, "a", "b").count() == 4 and visibly_same(df.limit(0), "a", "b").count() == 0
    assert df.select(visible(F.col("a")).alias("v")).filter("v is null").count() == 1


def test_conflicts_of_entries_are_found_before_they_are_resolved():
    assert resolved([("a", "b"), ("b", "c"), ("x", "ab"), ("a", "b")]) == {"a": "c", "b": "c", "x": "cc"}
    for bad in ([("a", "b"), ("a", "c")], [("a", "b"), ("b", "a")], [("a", "b"), ("b", "xc"), ("c", "a")]):
        with pytest.raises(Conflict):
            resolved(bad)
