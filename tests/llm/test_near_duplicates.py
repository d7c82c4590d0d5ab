"""Problem 2 against all pairs by brute force, and the sketch's promises."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from feedmill.llm import registry
from feedmill.llm.near_duplicates import near_duplicates, sketch

WORDS = [f"w{k}" for k in range(400)]


def _sets(text, n):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def _texts(seed=1):
    rng = random.Random(seed)
    texts = []
    for _ in range(40):
        base = [rng.choice(WORDS) for _ in range(rng.randint(80, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            other = list(base)
            for _ in range(rng.randint(1, 14)):
                other[rng.randrange(len(other))] = rng.choice(WORDS)
            texts.append("\n".join(other) if rng.random() < 0.5 else " ".join(other).upper())
    return texts + texts[:5]


@pytest.mark.parametrize(("words", "threshold"), [(3, 0.5), (5, 0.8)])
def test_pairs(spark, words, threshold):
    texts = _texts()
    sets = [_sets(t, words) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = near_duplicates(rows, "id", words=words, threshold=threshold)
    got = {(r.a, r.b) for r in found.pairs().collect()}
    assert len(want) > 20
    assert got <= want and len(got) >= 0.99 * len(want)
    classes = found.classes().collect()
    assert len(classes) == len(texts)
    assert {r.representative for r in classes if r.key >= len(texts) - 5} == set(range(5))


def test_edges(spark):
    text = "one two three four five six seven eight"
    rows = spark.createDataFrame([(1, text), (2, text), (2, text), (3, None), (4, ""), (5, "one two"), (None, text), (6, "long " * 100_000)], "id long, text string")
    found = near_duplicates(rows, "id")
    assert {(r.a, r.b) for r in found.pairs().collect()} == {(1, 2)}
    assert near_duplicates(rows.limit(0), "id").pairs().collect() == []


def test_every_row_has_a_class(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text), (2, text), (3, None), (4, None), (5, ""), (6, " \n"), (7, "one two"), (8, "One  two\n"), (9, "onetwo"), (10, "two one"), (11, text + " nine"), (1 << 60 | 1, None)]
    frame = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    got = {r.key: (r.representative, r.links) for r in near_duplicates(frame, "id").classes().collect()}
    assert got == {k: ({2: 1, 8: 7}.get(k, k), 1 if k in (1, 2, 11) else 0) for k, _ in rows}
    # below the least length copies have no pairs, but a class
    found = near_duplicates(frame, "id", least_words=60)
    assert found.pairs().collect() == []
    assert {r.key: r.representative for r in found.classes().collect()} == {k: {2: 1, 8: 7}.get(k, k) for k, _ in rows}


def test_leftovers_are_looked_for_once(spark, tmp_path, monkeypatch):
    """p2's costly look for leftovers was run again over all items when the texts of the likely pairs were fetched."""
    asked = spark.sparkContext.accumulator(0)

    def counted(text):
        @F.pandas_udf("boolean")
        def run(texts: pd.Series) -> pd.Series:
            asked.add(len(texts))
            return texts.map(lambda t: bool(t) and t.startswith("error"))

        return run(text)

    monkeypatch.setattr(registry.residue, "leftover", counted)
    text = " ".join(WORDS[:80])
    rows = [(1, text), (2, text + " more"), (3, "error " + text), (4, "error " + text + " more"), (5, None), (6, text + " else")]
    spark.createDataFrame(rows, "id long, text string").coalesce(1).write.parquet(str(tmp_path / "items.parquet"))
    found = registry._similar_items(spark, str(tmp_path))
    assert {(r.a, r.b) for r in found.pairs().collect()} == {(1, 2), (1, 6), (2, 6)}
    assert {r.key: r.representative for r in found.classes().collect()} == {k: k for k in range(1, 7)}
    assert asked.value == len(rows)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    one = sketch(np.array([7], dtype=np.uint64), 256)
    assert one.max() < np.uint64(512) << np.uint64(48)
    a = rng.integers(0, 1 << 62, 600, dtype=np.uint64)
    shares = [np.mean(sketch(a[:400], 256) == sketch(a[k : 400 + k], 256)) for k in (0, 100, 200)]
    assert shares[0] == 1 and abs(shares[1] - 300 / 500) < 0.12 and abs(shares[2] - 200 / 600) < 0.12
