"""Problem 8 against the tokenizer itself, and the round trip; problem 9 against its bounds."""

import random
from collections import defaultdict

import numpy as np
import pytest

from feedmill.llm import encoding
from feedmill.llm.encoding import PATTERN, RANKS, decode_documents, encode_documents, read_ranks
from feedmill.llm.packing import best_fit, pack

TEXTS = [
    None, "", " ", "Hello world", "Hello  world\n\n\tit's  we'll 'tis", "naïve café ½ ∑ ≈ 461 µm", "🐟📈👇🏽 updates", "Η ακτοπλοϊκή ενέκρινε", "no​break é x y z \u0085",
    "<|endoftext|> ordinary", "a" * 3000, "word " * 20_000, "中文字符 混合 text١٢٣", "trailing   ", "\r\nline\r\n", "Hello world",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, ids string")


def test_ids(spark, docs):
    import tiktoken

    direct = tiktoken.Encoding("direct", pat_str=PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    got = {r.doc_id: list(r.ids) for r in encode_documents(docs, rows_per_block=4).collect()}
    assert got == {k: direct.encode_ordinary(t) if t else [] for k, t in enumerate(TEXTS)}


def test_round_trip_and_counts(docs):
    ids = encode_documents(docs)
    assert {r.doc_id: r.text for r in decode_documents(ids).collect()} == {k: t or "" for k, t in enumerate(TEXTS)}
    assert {r.doc_id: r.n_tokens for r in encode_documents(docs, counts=True).collect()} == {r.doc_id: len(r.ids) for r in ids.collect()}
    assert encode_documents(docs.limit(0)).collect() == []


def test_best_fit():
    assert best_fit(np.array([6, 5, 4, 5]), 10, 4).tolist() == [0, 1, 0, 1]
    # one open container: the fullest closes before another opens
    assert best_fit(np.array([6, 7, 3, 4]), 10, 1).tolist() == [0, 1, 1, 2]


def test_pack(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([0, 1, 5, 30, 99, 100, 101, 250, rng.randint(1, 100)])) for k in range(3000)] + [(3000, None), (3001, -4), (0, 50)]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    got = pack(items, capacity=100, rows_per_block=700).collect()
    held, parts = defaultdict(int), defaultdict(list)
    for r in got:
        if r.container is None:
            assert r.size == 0
        else:
            held[r.container] += r["size"]
        parts[r.doc_id].append(r["size"])
    assert max(held.values()) <= 100 and sum(held.values()) == sum(max(n or 0, 0) for _, n in rows)
    assert all(len(p) == 1 or k == 0 or sum(p) > 100 for k, p in parts.items())
    assert sum(held.values()) / (100 * len(held)) > 0.97
    assert pack(items.limit(0)).collect() == []


def test_patterns_are_the_public_ones():
    import public_tokenizers

    assert public_tokenizers.PATTERN == encoding.PATTERN
