"""Problem 10: clean records garbled on purpose are found and restored, clean ones left alone."""

import random

import pytest

from feedmill.llm.garbled import LEAST_MARGIN, find_garbled, margins_of, restore

CLEAN = {
    "no": "Rådet åpnet en ny kai på øya, og bøndene får støtte til å bære på tømmer. “Vi må gå videre,” sa ordføreren.",
    "de": "Die Behörde prüft die Gebühr, weil das Gericht überraschend den Küstenplan für größer hielt – ein schöner Tag.",
    "fr": "L'hôpital a approuvé un rapport de sûreté à la mairie, où la météo était déjà très froide. “Ça été,” dit-elle.",
    "es": "El año pasado la compañía aprobó un plan según el acta, y la estación científica vendió más de cien números.",
    "pt": "A inspeção sanitária não aprovou a emissão de títulos até ao verão, são ações e opções de três órgãos.",
    "el": "Η ακτοπλοϊκή εταιρεία ενέκρινε το παράκτιο σχέδιο, για να μη χαθεί χρόνος στο λιμάνι.",
}
CHAINS = {
    "utf-8 as cp1252": lambda t: t.encode().decode("cp1252", "ignore"),
    "utf-8 as latin-1": lambda t: t.encode().decode("latin-1"),
    "utf-8 as mac": lambda t: t.encode().decode("mac_roman"),
    "utf-8 as cp437": lambda t: t.encode().decode("cp437"),
    "utf-8 twice": lambda t: t.encode().decode("latin-1").encode().decode("latin-1"),
}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(0)
    rows = []
    for k in range(600):
        lang = rng.choice(list(CLEAN))
        rows.append((k, CLEAN[lang] + f" Nr {k}."))
    planted = {}
    for k, (name, chain) in enumerate(CHAINS.items()):
        for j, lang in enumerate(("no", "fr", "es")):
            planted[1000 + 10 * k + j] = (name, CLEAN[lang])
            rows.append((1000 + 10 * k + j, "Intro. " + chain(CLEAN[lang])))
    decoys = ["NÃO HÁ ALTERAÇÃO NO PREÇO", "ÂGE, PÂTE ET CHÂTEAU", "ыьжпг ъэ шгшхыб уяфем", "中文 字符", "prices rise €2 – naïve? ™", "plain", "", None, "🐟📈 below 👇🏽", "z" * 100_000]
    rows += [(2000 + k, t) for k, t in enumerate(decoys)]
    rows += [(3000, "lost � sign"), (3000, "lost � sign")]
    return spark.createDataFrame(rows, "doc_id long, text string"), planted


def test_found(corpus):
    docs, planted = corpus
    assert {r.doc_id for r in find_garbled(docs).collect()} == {*planted, 3000}


def test_restored(corpus):
    docs, planted = corpus
    got = {r.doc_id: r.restored for r in restore(docs).collect()}
    whole = [k for k, (name, text) in planted.items() if name != "utf-8 as cp1252"]
    assert [k for k in whole if got[k] != "Intro. " + planted[k][1]] == []


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, segment string")
    assert find_garbled(empty).collect() == [] and restore(empty).collect() == []


def test_margins_are_validated(spark):
    """Held-out clean segments keep the rate of false alarms, and most of those garbled on purpose come back."""
    rows = [(k, f"{text} Nr {k}.") for k in range(60) for text in CLEAN.values()]
    found = {r.kind: r for r in margins_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(found) == set(LEAST_MARGIN)
    assert all(r.false_alarms <= 2e-3 and r.margin >= LEAST_MARGIN[k] for k, r in found.items())
    assert found["known"].found > 0.8


def test_gains_of_a_document_are_pooled(spark):
    """Single letters read in a wrong one-byte encoding prove nothing alone, but a document of them does; a few Cyrillic words don't."""
    clean = [(k, CLEAN["es"] + CLEAN["no"] + CLEAN["pt"] + f" Nr {k}.") for k in range(300)]
    wrong = CLEAN["es"].encode("cp1252").decode("cp1251")
    rows = [*clean, (1000, wrong), (1001, "A word from afar: пример слово."), (1002, "x" * 100 + "ÿ" * 100_000)]
    found = {r.doc_id for r in find_garbled(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 1000 in found and not found & {k for k, _ in clean} and 1001 not in found
