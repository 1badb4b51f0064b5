import random

from pyspark.sql import functions as F

from assayist.llm.canonical import abbreviations, canonicalized, key, keyed, pigeonhole

ENTRIES = [(1, "b", "Granite & Summit"), (2, "b", "Old Quarry Barrel"), (3, "b", "Étoile Vineyard"), (4, "c", "Straight Rye Whiskey"), (5, "c", "Pale Ale"), (6, "c", "Rye Whiskey"), (7, "c", None)]


def entries(spark):
    return spark.createDataFrame(ENTRIES, "entry_id bigint, field_name string, canonical_name string").withColumn("key", F.lit("clash"))


def test_values(spark):
    cases = {
        "Granite & Summit": None, "GRANITE & SUMMIT": 1, "Summit, Granite &": 1, "The Granite & Sumit Co.": 1, "Grnaite & Summti - batch 12": 1, "Ｏｌｄ　Quаrry Barrel": 2, "Old-Quarry-Barrel lot B": 2, "OldQuarryBarrel": 2, "OldQuarryBarrel750": 2, "Quarry Barrel": 0,
        "Etoile Vineyard": 3, "Étoile Vineyrad (see front)": 3, "see label": 0, "-": 0, "​": 0, "Old Brixtane Barrel": 0, "x" * 60_000: 0,
    }
    rows = [(i, "b", v, None) for i, v in enumerate(cases)] + [(100, "c", "Whsky, Str. Rye", "Rye Whisky"), (101, "c", "pale alle", ""), (102, "d", "Pale Ale", "x"), (103, None, "Pale Ale", None), (101, "c", "pale alle", "")]
    df = spark.createDataFrame(rows, "finding_id bigint, field_name string, extracted_value string, expected_value string")
    got = canonicalized(df, entries(spark)).collect()
    by = {(r.finding_id, r.side): r.entry_id for r in got}
    want = {(i, "extracted"): e for i, (v, e) in enumerate(cases.items()) if e is not None} | {(100, "extracted"): 4, (100, "expected"): 6, (101, "extracted"): 5}
    assert by == want and len(got) == len(want) + 1
    assert canonicalized(df.limit(0), entries(spark)).count() == 0
    assert {r.entry_id for r in canonicalized(df.filter("field_name = 'b'"), entries(spark).filter("entry_id = 1")).collect()} == {0, 1}


def test_join_against_brute_force(spark):
    """The pigeonhole join loses no pair within two typing errors."""
    rng, letters = random.Random(3), "abcdefg"
    refs = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(5, 14))) for _ in range(40)})

    def typo(s: str) -> str:
        i, k = rng.randrange(len(s) - 1), rng.randrange(4)
        return [s[:i] + s[i + 1 :], s[:i] + s[i] + s[i:], s[:i] + rng.choice(letters) + s[i + 1 :], s[:i] + s[i + 1] + s[i] + s[i + 2 :]][k]

    values = sorted({v for r in refs for _ in range(6) for v in [typo(typo(r)) if rng.random() < 0.6 else typo(r)] if len(v) > 4})
    ref_df = spark.createDataFrame([("l", i, r) for i, r in enumerate(refs)], "list string, entry bigint, ref string")
    got = {r.key: r.entry for r in pigeonhole(spark.createDataFrame([("l", v) for v in values], "list string, key string"), ref_df).collect()}
    assert set(got) == set(values)
    assert spark.createDataFrame([("The Old Mill & Sons",), (None,)], "v string").select(key(F.col("v")).alias("k")).collect()[0].k == "oldmill"


def test_short_names_against_brute_force(spark):
    """Keys of at most four letters find what lies within two typing errors, as longer ones do."""
    names = [(1, "b", "Gin"), (2, "b", "Rum"), (3, "b", "Vodka"), (4, "b", "Absinthe"), (5, "b", "Co")]
    values = ["Gni", "Ruum", "Vdka", "Vodk", "Absith", "Mezcal", "Rum!", "qz", "x"]
    df = spark.createDataFrame([(i, "b", v, None) for i, v in enumerate(values)], "finding_id bigint, field_name string, extracted_value string, expected_value string")
    refs = spark.createDataFrame(names, "entry_id bigint, field_name string, canonical_name string")
    assert {r.finding_id: r.entry_id for r in canonicalized(df, refs).collect()} == {0: 1, 1: 2, 2: 3, 3: 3, 4: 4, 5: 0, 6: 2, 7: 0, 8: 0}

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y)))
        return row[-1]

    def typos(a: str, b: str) -> float:
        bag = (sum(abs(a.count(c) - b.count(c)) for c in {*a, *b}) + abs(len(a) - len(b))) / 2
        return bag + max(distance(a, b) - bag, 0) / 2

    rng = random.Random(5)
    keys, words = ({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(40)} for _ in range(2))
    want = {v: min((typos(v, r), distance(v, r), i) for i, r in enumerate(sorted(words)))[2] for v in keys if min(typos(v, r) for r in words) <= 2}
    got = pigeonhole(spark.createDataFrame([("l", v) for v in sorted(keys)], "list string, key string"), spark.createDataFrame([("l", i, r) for i, r in enumerate(sorted(words))], "list string, entry bigint, ref string"))
    assert {r.key: r.entry for r in got.collect()} == want and got.count() == len(want)


def test_abbreviations_are_learnt(spark):
    """A short form counts if it stands for one word in three names; what is a word of a name, or stands for several words, doesn't."""
    names = ["Hop Creek", "Owl Creek", "Rye Creek", "Northern Creek", "Northern Mill", "Northern Farm", "Cork Creek", "Rye Crook", "Owl Crook", "Hop Cork", "Fog", None]
    values = ["Hop Crk.", "OWL crk", "rye crk", "No. Crk.", "No. Mill", "no farm", "Hop Cr", "Owl Cr", "Hop Zz", "Hop Cork", "", None, "Owl Crk", "Owl Crk"]
    df = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    refs = df(names, "name")
    assert abbreviations(df(values, "value"), refs, rounds=1) == {}  # "crk" may be crook as well
    fewer = refs.filter("name not like '%Crook'")
    assert abbreviations(df(values, "value"), fewer, rounds=1) == {"crk": "creek"} and abbreviations(df(values, "value"), fewer) == {"crk": "creek", "no": "northern"}
    assert abbreviations(df([], "value"), refs) == {} == abbreviations(df(values, "value"), df([], "name"))
    assert df(["Old No. Crk. Co."], "v").select(key(F.col("v"), {"crk": "creek", "no": "northern"}).alias("k")).first().k == "oldnortherncreek"


def test_all_abbreviations_are_learnt(spark):
    """No number of abbreviations is too large: each of 1,020 is learnt and written out."""
    codes = [a + b + c for a in "abcdefghijk" for b in "abcdefghijk" for c in "abcdefghijk"][:1020]
    names = [f"{x} {'xy'.join(c)}" for c in codes for x in ("Tall", "Quiet", "Lower")]
    values = [f"{x} {c.upper()}." for c in codes for x in ("Tall", "Quiet", "Lower")]
    refs = spark.createDataFrame([(i, "b", n) for i, n in enumerate(names, 1)], "entry_id bigint, field_name string, canonical_name string")
    df = spark.createDataFrame([(i, "b", v, None) for i, v in enumerate(values, 1)], "finding_id bigint, field_name string, extracted_value string, expected_value string")
    assert abbreviations(df.selectExpr("extracted_value as value"), refs.selectExpr("canonical_name as name")) == {c: "xy".join(c) for c in codes}
    some = df.filter("finding_id % 50 = 0 or finding_id > 3000")
    assert canonicalized(some, refs).filter("entry_id > 0").count() < some.count()  # too few values to learn from
    got = canonicalized(df, refs).collect()
    assert len(got) == len(names) and all(r.entry_id == r.finding_id for r in got)


def test_joined_abbreviations_give_the_same_keys(spark):
    """Written out in joins or by an expression: the same keys, with abbreviations of what another one wrote, points, and initials."""
    short = {"crk": "creek", "no": "northern", "mtn": "mountain", "tain": "tavernmain", "ain": "abbotin", "whisky": "whiskyard", "zcreek": "zoocreek", "reek": "roebeek", "st": "saint"}
    values = ["Old Crk.", "Old No. Crk", "no.1 crk.x.", "zcrk", "Mtn Mtn.Crk", "mtn.tain", "N.o. Mtn.", "Str. Rye Whisky", "whsky liq", "The Crk, No. Co.", "", "-", "no", "st. mtn", "st.x.", "crkж mtn", "mtn1", "Étain crk_", "&mtn"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values + values[:3])], "i int, v string")
    table = spark.createDataFrame(list(short.items()), "short string, word string")
    one, other = ({r.i: r.k for r in keyed(rows, "v", "k", table, n).collect()} for n in (50, 2))
    assert one == other == {r.i: r.k for r in rows.select("i", key(F.col("v"), short).alias("k")).collect()} and len(one) == len(values) + 3
    assert keyed(rows.limit(0), "v", "k", table, 2).count() == 0
