import pytest

from assayist.llm.addresses import compared, estimate, linked, located, parse, places, same_place

SCHEMA = "id bigint, street string, city string, state string, zip string, rec int, number string"


@pytest.mark.parametrize(("row", "want"), [
    (("Ste. 4, 12 N. Main St.", "Mt Vernon", "Ore.", "97001-1234"), ("12", "main", "street", "n", "mountvernon", "OR", "97001")),
    (("birchwood dr. 1454 mount carrow vt 55602", None, None, None), ("1454", "birchwood", "drive", None, "mountcarrow", "VT", "55602")),
    (("67370 Varden TX - 14323 Partridge Boulevard", None, None, None), ("14323", "partridge", "boulevard", None, "varden", "TX", "67370")),
    (("Easton, OR 63791, 12020 S Dogwood Blvd", None, None, None), ("12020", "dogwood", "boulevard", "s", "easton", "OR", "63791")),
    (("No. 5 No. Oak Ct", "X, Calif.", None, None), ("5", "oak", "court", "n", "x", "CA", None)),
    (("Oak Highway South 7", None, None, "KY 40001"), ("7", "oak", "highway", "s", None, "KY", "40001")),
])
def test_parse(row, want):
    assert parse(*row) == want


@pytest.mark.parametrize("street", [None, "", "PO Box 12", "General Delivery", "N/A", "see mailing address", "12", "#"])
def test_no_place(street):
    assert parse(street, "Town", "OR", "97001") is None


def test_pairs(spark):
    rows = [
        (1, "12 N Main St", "Greenfield", "OR", "97001"), (2, "12 Main Street, Apt 3", "GREENFIELD", "Oregon", "97001-1111"), (3, "12 S Main St", "Greenfield", "OR", "97001"), (4, "12 Main St", "Greenfeild", "OR", None), (5, "Main Street 12 Greenfield OR 97001", None, None, None),
        (6, "12 Mian St", None, None, "97001"), (7, "12 Main Ave", "Greenfield", "OR", "97001"), (8, "13 Main St", "Greenfield", "OR", "97001"), (9, "12 Main St", "Lakeport", "OR", "97555"), (10, "PO Box 12", "Greenfield", "OR", "97001"), (11, None, None, None, None), (12, "12 N Main St", "Greenfield", "OR", "97001"),
        (13, "x" * 50_000, "Greenfield", "OR", "97001"), (14, "40 Oak Ln", "Greenfield", "OR", "97001"), (15, "41 Elm Rd", "Lakeport", "OR", "97555"),
    ]
    df = spark.createDataFrame([(*r, 0, "clash") for r in rows], SCHEMA)
    got = {(r.id_a, r.id_b) for r in same_place(df, "id").collect()}
    alike, north, south = {2, 4, 5, 6}, {1, 12}, {3}
    want = {(a, b) for a in alike | north | south for b in alike | north | south if a < b and not ({a, b} & north and {a, b} & south)}
    assert got == want
    assert same_place(df.limit(0), "id").count() == 0


def test_em_parts_the_classes():
    p = [((0, 0, 0, 0, 0, 0), 100), ((1, 0, 5, 0, 0, 0), 40), ((4, 4, 5, 0, 0, 0), 300), ((4, 4, 4, 4, 4, 4), 500), ((0, 5, 5, 5, 5, 0), 10)]
    post = estimate(p)
    assert post[0, 0, 0, 0, 0, 0] > 0.95 and post[4, 4, 4, 4, 4, 4] < 0.05 and post[4, 4, 5, 0, 0, 0] < 0.5 and post[0, 5, 5, 5, 5, 0] > 0.5
    assert estimate([]) == {}


def test_the_weights_decide(spark):
    """Whatever shares a block is a candidate; only the estimated weights tell places apart."""
    rows = [(1, "12 Main St", "Greenfield", "OR", "97001"), (2, "12 Main Ave", "Greenfield", "OR", "97001"), (3, "12 Oak St", "Greenfield", "OR", "97001"), (4, "12 Mian Str", "Greenfeild", "OR", "97001"), (5, "12 Mapel Lane", "Lakeport", "OR", "97555"), (6, "12 Maple Ln", "Lakeport", None, "97556")]
    df = spark.createDataFrame([(*r, 0, "clash") for r in rows], SCHEMA)
    members, links = places(df, "id")
    assert {(r.record_a, r.record_b) for r in links.collect()} == {(1, 4), (5, 6)}
    assert {(r.id, r.record) for r in members.collect()} == {(i, i) for i in range(1, 7)}
    _, records = located(df, "id")
    assert {tuple(r)[2:4] for r in compared(records).collect()} >= {(0, 4), (4, 0)} and linked(records, 0.0).count() > 2


def test_links_and_members_give_the_pairs(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/application.parquet")
    members, links = places(df, "application_id")
    m = {r.id: r.record for r in members.collect()}
    near = {(r.record_a, r.record_b) for r in links.collect()}
    ids = sorted(m)
    want = {(a, b) for a in ids for b in ids if a < b and (m[a] == m[b] or tuple(sorted((m[a], m[b]))) in near)}
    assert want and {(r.id_a, r.id_b) for r in same_place(df, "application_id").collect()} == want
