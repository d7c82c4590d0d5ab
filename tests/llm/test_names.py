"""Problem 7: variants that mean a known name, and names that don't."""

import pytest

from feedmill.llm.names import edits, form_of, link_names, mentions, name_groups

ORGS = [
    ("rosjing pharma", "Rosjing Pharma", "organisation"), ("zoumfing logistics", "Zoumfing Logistics LLC", "organisation"), ("zoumfing software", "Zoumfing Software", "organisation"),
    ("klaendbrek skaesfliv shipping", "Klaendbrek & Skaesfliv Shipping", "organisation"), ("national institute for orchard research", "National Institute for Orchard Research", "organisation"), ("national institute for oyster research", "National Institute for Oyster Research", "organisation"),
    ("katherine daestravberg", "Katherine L. Daestravberg", "person"), ("charlotte kiastbevova", "Charlotte Kiastbevova", "person"), ("magdalena kiastbevova", "Magdalena Kiastbevova", "person"), ("dyvtréild foods", "Dyvtréild Foods", "organisation"), (None, "Nobody", "person"),
]
MEANT = {
    "Rosjing Pharma": "rosjing pharma", "ROSJJING PHARMA": "rosjing pharma", "The Rosjing Pharma Company": "rosjing pharma", "Rosjing": "rosjing pharma", "pharma, rosjing": "rosjing pharma", "rosjing_pharmaceuticals": "rosjing pharma", "RosjingPharma": "rosjing pharma",
    "Zoumfing SW": "zoumfing software", "  Zoumfing  Logistics ": "zoumfing logistics", "Skaesfliv/Klaendbrek Shipping": "klaendbrek skaesfliv shipping", "Klaendbrek and Skaesfliv": "klaendbrek skaesfliv shipping",
    "Natl. Inst. for Orchard Res.": "national institute for orchard research", "Orchard Research National Institute": "national institute for orchard research", "Kate Daestravberg": "katherine daestravberg", "Daestravberg, Katherine": "katherine daestravberg", "K. Daestravberg": "katherine daestravberg", "Prof. Katherine Daestravebrg": "katherine daestravberg",
    "Lottie Kiastbevova": "charlotte kiastbevova", "M. Kiastbevova": "magdalena kiastbevova", "Dyvtreild Foods AS": "dyvtréild foods",
}
OTHERS = ["Rosjing Airways", "Frederik Kiastbevova", "Kiastbevova", "National Institute for Beetle Research", "Nobody", "Baelford Timber", "&", "plc", "N.I.O.R."]


@pytest.fixture(scope="module")
def orgs(spark):
    return spark.createDataFrame([(*o, 1) for o in ORGS], "key string, display string, kind string, form int")


def test_links(spark, orgs):
    rows = [(k, s) for k, s in enumerate([*MEANT, *OTHERS])]
    named = spark.createDataFrame(rows + rows[:3], "item_id long, spelling string")
    got = {r.spelling: r.org_key for r in link_names(named, orgs).collect()}
    assert got == MEANT


def test_item_decides(spark, orgs):
    named = spark.createDataFrame([(1, "N.I.O.R."), (1, "National Institute for Oyster Research"), (2, "NIOR")], "item_id long, spelling string")
    got = {(r.item_id, r.spelling): r.org_key for r in link_names(named, orgs).collect()}
    assert got == {(1, "N.I.O.R."): "national institute for oyster research", (1, "National Institute for Oyster Research"): "national institute for oyster research"}


def test_linkage_decides(spark, orgs, monkeypatch):
    """Without clusters nothing is linked, whatever the exact check says."""
    monkeypatch.setattr("feedmill.llm.names.LEVELS", (2.0,))
    named = spark.createDataFrame(list(enumerate(MEANT)), "item_id long, spelling string")
    assert link_names(named, orgs).collect() == []


def test_unknown_names_are_grouped(spark, orgs):
    variants = [["Baelford Timber", "BAELFORD TIMBER AS", "Timber, Baelford", "Baelfordd Timber"], ["Hjalmar Quistgaard", "Quistgaard, Hjalmar", "Hjalmar Qiustgaard"], ["Rosjing Pharma", "ROSJJING PHARMA"]]
    named = spark.createDataFrame([(k, s) for k, g in enumerate(variants) for s in g], "item_id long, spelling string")
    rows = {r.spelling: (r.name, r.org_key) for r in name_groups(named, orgs).collect()}
    assert len(rows) == 9
    assert [len({rows[s] for s in g}) for g in variants] == [1, 1, 1] and len(set(rows.values())) == 3
    assert rows["Rosjing Pharma"][1] == "rosjing pharma" and rows["Baelford Timber"][1] is None


def test_mentions(spark):
    e = spark.createDataFrame([(1, '["A", "B", "A"]'), (2, "["), (3, ""), (4, None), (5, "null"), (6, '[null, " "]')], "item_id long, orgs string")
    n = spark.createDataFrame([(1, "k", "A"), (7, "k", None), (8, None, None), (9, None, "")], "item_id long, key string, name string")
    assert {tuple(r) for r in mentions(e, n).collect()} == {(1, "A"), (1, "B"), (7, "k")}


def test_empty(spark, orgs):
    none = spark.createDataFrame([], "item_id long, spelling string")
    some = spark.createDataFrame([(1, "x" * 20_000), (2, "Rosjing Pharma")], "item_id long, spelling string")
    assert link_names(none, orgs).collect() == []
    assert link_names(some, orgs.limit(0)).collect() == []
    assert [r.org_key for r in link_names(some, orgs).collect()] == ["rosjing pharma"]


def test_helpers():
    assert form_of("Dr. Ångström & Bjørn S.p.A.") == "angstrom bjorn" and form_of("N.I.O.R.") == "nior" and form_of("&") == ""
    assert edits("abcd", "abdc") == 1 and edits("abc", "abcd") == 1 and edits("abc", "xyz") == 3
