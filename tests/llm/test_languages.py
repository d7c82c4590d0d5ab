"""Problem 5: held-out accuracy on generated texts with wrong and missing labels."""

import random

import numpy as np
import pandas as pd
import pytest

from feedmill.llm.languages import identify, mislabelled, prior_shares

WORDS = {
    "en": "the harbour and ferry of that with from which board has opened new plan for this city but not they".split(),
    "no": "havnen og fergen av som med fra hvilket styret har åpnet ny plan for denne byen men ikke de".split(),
    "de": "der hafen und die fähre von dem mit aus welcher rat hat neuen plan für diese stadt aber nicht sie".split(),
    "fr": "le port et la ferry de que avec des dont conseil a ouvert nouveau plan pour cette ville mais pas ils".split(),
    "es": "el puerto y la balsa de que con desde cual consejo ha abierto nuevo plan para esta ciudad pero no ellos".split(),
    "pt": "o porto e a balsa de que com desde qual conselho abriu novo plano para esta cidade mas não eles".split(),
    "it": "il porto e il traghetto di che con dal quale consiglio ha aperto nuovo piano per questa città ma non loro".split(),
    "el": "το λιμάνι και το πλοίο του που με από οποίο συμβούλιο έχει ανοίξει νέο σχέδιο για αυτή πόλη αλλά δεν".split(),
}


def _line(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows, want = [], set()
    codes = list(WORDS)
    notation = {"en": "en-GB", "no": "nb", "de": "ger", "fr": "FR", "es": "spanish", "pt": "pt_BR", "it": "ita", "el": "el"}
    for k in range(480):
        lang = codes[k % 8]
        lines = [_line(rng, lang, rng.randint(12, 20)) for _ in range(4)]
        label = notation[lang] if k % 3 else lang
        if k % 10 == 0:
            label = rng.choice([None, "", "und", "da", codes[(k + 3) % 8]])
            want.add((k, 0, lang))
        if k % 7 == 0:
            other = codes[(k + 1) % 8]
            lines.insert(2, _line(rng, other, 14))
            want.add((k, 3, other))
        rows.append((k, "\n".join(lines), label, f"https://{lang}.site{k % 5}.example/a/{k}"))
    rows += [(900, None, "en", None), (901, "", None, ""), (902, "too few words", None, "x"), (903, " \n ", "en", None), (904, (" ".join(WORDS["de"]) + "\n") * 3000, "de", "https://de.site1.example/x")]
    return spark.createDataFrame(rows, "id long, text string, lang string, url string"), want


def test_cases(corpus):
    docs, want = corpus
    got = {tuple(r) for r in mislabelled(docs).collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_confidence(corpus):
    docs, _ = corpus
    rows = identify(docs).where("line_no = 0").collect()
    assert {r.id for r in rows} & {900, 901, 903} == set()
    assert all(0 < r.confidence <= 1.0001 for r in rows)


def test_empty(spark):
    empty = spark.createDataFrame([], "id long, text string, lang string, url string, label string, host string")
    assert mislabelled(empty).collect() == []


def _torn(spark):
    """Texts of words that two languages share; only the host tells which it is."""
    rng = random.Random(2)
    shared = "plan casa mar luna mesa vida hora nota".split()
    rows = [(k, "\n".join(" ".join(rng.choice(WORDS[lang] + shared) for _ in range(14)) for _ in range(3)), lang, f"https://news.{host}.example/{k}") for k in range(400) for lang, host in [(("es", "uno"), ("pt", "dois"))[k % 2]]]
    torn = [(1000 + k, " ".join(rng.choice(shared) for _ in range(24)), None, f"https://news.{('uno', 'dois')[k % 2]}.example/x{k}") for k in range(20)]
    return spark.createDataFrame(rows + torn, "id long, text string, lang string, url string"), {(1000 + k, 0, ("es", "pt")[k % 2]) for k in range(20)}


def test_priors_decide(spark, monkeypatch):
    """With host and suffix shares smoothed away, the torn texts of one host get the wrong language."""
    docs, want = _torn(spark)
    assert want <= {tuple(r) for r in mislabelled(docs).collect()}
    monkeypatch.setattr("feedmill.llm.languages.SMOOTHING", 1e12)
    assert len(want - {tuple(r) for r in mislabelled(docs).collect()}) >= 5


def test_own_verdict_is_left_out():
    base = np.full(8, 1 / 8)
    one = [1.0] + [0.0] * 7
    alone = pd.DataFrame({"lang": ["en"], "label": [None], "host_counts": [one], "suffix_counts": [one], "label_counts": [None]})
    assert np.allclose(prior_shares(alone, base), base)


def test_calibration(spark):
    """Among short torn and clear texts alike, what is said with some confidence is right about as often."""
    rng = random.Random(3)
    rows = []
    for k in range(1600):
        lang = list(WORDS)[k % 8]
        other = list(WORDS)[(k // 8) % 8]
        pool = WORDS[lang] * 2 + WORDS[other]
        rows.append((k, " ".join(rng.choice(pool) for _ in range(rng.choice((3, 6, 30)))), lang if k % 5 else None, None))
    got = identify(spark.createDataFrame(rows, "id long, text string, lang string, url string")).where("line_no = 0").collect()
    right = [(r.confidence, r.lang == list(WORDS)[r.id % 8]) for r in got]
    assert abs(sum(c for c, _ in right) - sum(ok for _, ok in right)) / len(right) < 0.08
    sure = [ok for c, ok in right if c >= 0.95]
    assert sum(sure) / len(sure) > 0.93
