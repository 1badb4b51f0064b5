import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from assayist.llm import leakage
from assayist.llm.leakage import Matcher, leaks, letters, myers


def brute(pattern: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        prev, row = row, [i + 1]
        for j, d in enumerate(text):
            row.append(min(prev[j] + (c != d), prev[j + 1] + 1, row[j] + 1))
    return min(row)


@given(st.text("abc", min_size=1, max_size=80), st.text("abc", max_size=90))
def test_myers(pattern, text):
    assert myers(pattern, text) == brute(pattern, text)


ITEM = "Suppose a ribbed carafe from Pellworth shows 11 degrees on the tear strip yet 38 on the medallion of another"
WORDS = ITEM.split()


@pytest.mark.parametrize(("text", "exact"), [
    (" ".join(WORDS[:12]), 12), (" ".join(WORDS[:11]), None), ("x " + " ".join(WORDS[3:16]).upper() + " y", 13), ("<p>" + "<br/>\n> ".join(WORDS[:12]) + "</p>", 12), ("**" + "**, &nbsp;".join(WORDS[2:14]), 12),
    (" ".join(w[:2] + "-\n" + w[2:] for w in WORDS[:12]), 12), ("Ｓuppose а ribbed carafe from Pell​worth shows 11 degrees on the tear", 12), ("un" + " ".join(WORDS[:11]) + " tear", 11), (" ".join(reversed(WORDS)), None), ("", None),
])
def test_runs(text, exact):
    got = {i: w for i, _, w in Matcher([(1, ITEM)]).find(text)}
    assert (got.get(1, 0) >= 12) == (exact is not None and exact >= 12) and (exact is None or got.get(1) in (exact, None))


def test_random_passages_against_brute_force():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(30))) for i in range(20)]
    m = Matcher(items)
    for _ in range(150):
        i = rng.randrange(20)
        w = items[i][1].split()
        n, a = rng.randint(8, 16), rng.randrange(10)
        text = " ".join([*(rng.choice(vocab) for _ in range(5)), *w[a : a + n], *(rng.choice(vocab) for _ in range(5))])
        tokens = text.split()
        runs = {" ".join(tokens[k : k + 12]) for k in range(len(tokens) - 11)}
        want = {j for j, t in items if any(" ".join(t.split()[k : k + 12]) in runs for k in range(len(t.split()) - 11))}
        assert {j for j, _, x in m.find(text) if x >= 12} == want


def test_one_error_is_near():
    damaged = ITEM.replace("degrees", "degreees")
    assert [(i, e) for i, e, w in Matcher([(1, ITEM)]).find(damaged) if w < 12] == [(1, 1)]


def test_rows(spark):
    docs = spark.createDataFrame([(1, ITEM, "c"), (2, None, "c"), (3, "", "c"), (4, ITEM, "c"), (5, "word " * 200_000 + ITEM, "c"), (6, "other", "c")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short"), (10, "")], "item_id bigint, item_text string")
    assert sorted((r.doc_id, r.item_id) for r in leaks(docs, items).collect()) == [(1, 7), (4, 7), (5, 7)]
    assert leaks(docs, items.limit(0)).count() == 0 and leaks(docs.limit(0), items).count() == 0
    assert letters("A-b <b>c</b>")[0] == "abc" and re.fullmatch(r"\w+", letters(ITEM)[0])


@pytest.mark.parametrize("text", [
    f"<{ITEM}>", f"if a <b then {ITEM} and c> d", f"x <Suppose> {ITEM}", f"<b {ITEM}>", " <em class='x y' hidden>".join(WORDS[:12]), ' <br data-k=1 />'.join(WORDS[:12]), ' <o:p a="b c">'.join(WORDS[:12]), " </foo>".join(WORDS[:12]), " <foo/>".join(WORDS[:12]),
])
def test_only_markup_is_left_out(text):
    assert [i for i, _, w in Matcher([(1, ITEM)]).find(text) if w >= 12] == [1]


def test_long_open_brackets_take_no_time():
    assert letters("<b " + "a='1' " * 50_000 + "<" * 50_000)[0].startswith("ba1a1")


def test_without_the_distance_nothing_is_found(monkeypatch):
    assert Matcher([(1, ITEM)]).find(ITEM) == [(1, 0, len(WORDS))]
    monkeypatch.setattr(leakage, "myers", lambda pattern, text: len(pattern))
    assert Matcher([(1, ITEM)]).find(ITEM) == []


def test_short_items_leak_as_a_whole():
    m = Matcher([(1, "blue tin plate"), (2, "vat"), (3, "!"), (4, "grey flax")])
    assert m.find("The BLUE-tin plate, a vat.") == [(1, 0, 3), (2, 0, 1)]
    assert m.find("a blve tin plate") == [(1, 1, 0)] and m.find("blue tin") == [] and m.find("grey flox") == [(4, 1, 0)]


def test_recall_of_passages_with_one_error():
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(40))) for i in range(30)]
    m, found, tried = Matcher(items), 0, 300
    for _ in range(tried):
        i, a = rng.randrange(30), rng.randrange(28)
        passage = " ".join(items[i][1].split()[a : a + 12])
        at = rng.randrange(len(passage))
        passage = passage[:at] + "z" + passage[at + 1 :] if passage[at] != " " else passage
        found += i in {j for j, e, _ in m.find(f"xx yy {passage} vv ww") if e <= 1}
    assert found == tried


def test_blocks_of_items_find_alike(spark):
    docs = spark.createDataFrame([(1, ITEM), (2, "x " + " ".join(reversed(WORDS)) + " y"), (3, "z")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, ITEM), (8, " ".join(reversed(WORDS))), (7, ITEM)], "item_id bigint, item_text string")
    one, many = ({tuple(r) for r in leaks(docs, items, letters_at_once=n).collect()} for n in (10**6, 30))
    assert one == many and {r[:2] for r in one} == {(1, 7), (2, 8)}
