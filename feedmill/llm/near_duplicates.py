"""Problem 2: items that share most of their text.

A text is the set of its runs of successive lower-cased words. Each set gets a similarity sketch by
rounds of hashed bin placement: in round i every element is thrown into a random bin with a value between
i and i + 1, and a bin keeps its least value. Rounds go on until every bin is filled; from round t on (t:
the number of bins) elements are thrown into bin i - t only, so t further rounds always suffice. Two sets agree in
a bin with a probability that is their Jaccard similarity. Bands of bins give candidate pairs, bits of all
bins sort out nearly all chance candidates, and the sets themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmill.session import materialise

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 64, 4
#: How far below their expectation the agreeing bits of a pair at the threshold may be.
SIGMAS = 4.5
_MIX1, _MIX2, _ROUND = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted distinct hashes of their runs of words; hashes of words are kept between texts."""

    def __init__(self, words: int) -> None:
        self.words, self.known = words, {}

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        known, hashes = self.known, []
        if len(known) > 500_000:
            known.clear()
        for word in text.lower().split():
            h = known.get(word)
            if h is None:
                h = known[word] = xxhash.xxh64_intdigest(word)
            hashes.append(h)
        w = np.array(hashes, dtype=np.uint64)
        n = len(w) - self.words + 1
        if n < 1:
            return w[:0]
        runs = np.zeros(n, dtype=np.uint64)
        for k in range(self.words):
            runs = mix(runs * _ROUND + w[k : k + n])
        return np.unique(runs)


def sketch(elements: np.ndarray, bins: int) -> np.ndarray:
    """``bins`` values of a set of at least one element; in equal sets equal, and equal bin by bin with the sets' similarity."""
    least = np.full(bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    n, i = len(elements), 0
    # as many rounds at once as fill the bins most times; a bin keeps the least (round, value)
    batch = max(1, int(np.ceil(bins * (np.log(bins) + 2) / n)))
    while i < 2 * bins:
        rounds = np.arange(i, min(i + batch, 2 * bins), dtype=np.uint64)
        h = mix(elements[None, :] + (rounds[:, None] + np.uint64(1)) * _ROUND)
        where = np.where(rounds[:, None] < bins, (h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32), rounds[:, None] - np.uint64(bins))
        value = (rounds[:, None] << np.uint64(48)) | (mix(h) >> np.uint64(16))
        np.minimum.at(least, where.ravel().astype(np.int64), value.ravel())
        i += len(rounds)
        if least.max() < np.uint64(i) << np.uint64(48):
            break
    return least


def _prepare(words: int, least_words: int, bands: int, rows: int):
    salts = mix(np.arange(1, bands + 1, dtype=np.uint64) * _ROUND)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        shingles = Shingler(words)
        for batch in batches:
            out = []
            for key, text in zip(batch["key"], batch["text"]):
                split = (text or "").lower().split()
                elements = shingles(text) if len(split) >= least_words else ()
                if not len(elements):
                    # no sketch: the words as they are make copies; without words there are none
                    out.append((key, xxhash.xxh64_intdigest(" ".join(split), seed=1) - (1 << 63) if split else None, None, None))
                    continue
                s = mix(sketch(elements, bands * rows))
                keys = salts.copy()
                for r in range(rows):
                    keys = mix(keys ^ s[r::rows][:bands])
                bits = np.packbits((s & np.uint64(1)).astype(np.uint8)).view(np.int64)
                copy = mix(elements[-1:] ^ mix(np.bitwise_xor.reduce(elements, keepdims=True) + np.add.reduce(elements, keepdims=True) * _ROUND))
                out.append((key, int(copy.view(np.int64)[0]), bits, keys.view(np.int64)))
            columns = dict(zip(("key", "copy", "bits", "bands"), zip(*out) if out else [()] * 4))
            # as a nullable integer: with a missing value among them, 64 bits would be read as floats
            yield pd.DataFrame(columns | {"copy": pd.array(columns["copy"], dtype="Int64")})

    return run


def _similarity(words: int):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        shingles = Shingler(words)
        out = []
        for x, y in zip(a, b):
            s, t = shingles(x), shingles(y)
            common = len(np.intersect1d(s, t, assume_unique=True))
            out.append(common / max(1, len(s) + len(t) - common))
        return pd.Series(out, dtype=float)

    return run


def _agreeing(bins: int) -> Column:
    """How many of the bins' bits agree between ``bits_a`` and ``bits_b``."""
    differing = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, n: total + n)
    return F.lit(bins) - differing


class NearDuplicates:
    """The result of :func:`near_duplicates`.

    members: ``key, copy``, each text with the number of its class of texts with equal sets, whose least key
    represents it as ``representative``. links: ``a, b, similarity`` between the representatives, a < b.
    rest: ``key, copy`` of the rows without a sketch, which have no similar rows; ``copy`` is null without words.
    """

    def __init__(self, members: DataFrame, links: DataFrame, rest: DataFrame) -> None:
        self.members, self.links, self.rest = members, links, rest

    def pairs(self) -> DataFrame:
        """``a, b`` of all pairs of rows, a < b, copies expanded."""
        m = self.members.select("key", "representative")
        same = m.alias("x").join(m.alias("y"), F.col("x.representative") == F.col("y.representative")).where(F.col("x.key") < F.col("y.key")).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
        left = self.links.select("a", "b").join(m.select(F.col("representative").alias("a"), F.col("key").alias("one")), "a")
        both = left.join(m.select(F.col("representative").alias("b"), F.col("key").alias("other")), "b")
        return same.unionByName(both.select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b")))

    def classes(self) -> DataFrame:
        """``key, representative, links`` of each row with a key: its class of equal sets and the number of other classes linked to it.

        Rows without a sketch are of one class if their words are the same; each row without words is a class of its own.
        """
        ends = self.links.select(F.explode(F.array("a", "b")).alias("representative")).groupBy("representative").agg(F.count("*").alias("links"))
        linked = self.members.select("key", "representative").join(ends, "representative", "left").select("key", "representative", F.coalesce("links", F.lit(0)).alias("links"))
        short = self.rest.where("copy is not null")
        alike = short.join(short.groupBy("copy").agg(F.min("key").alias("representative")), "copy").select("key", "representative")
        alone = self.rest.where("copy is null").select("key", F.col("key").alias("representative"))
        return linked.unionByName(alike.unionByName(alone).withColumn("links", F.lit(0).cast("bigint")))


def near_duplicates(docs: DataFrame, id_col: str, text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, least_words: int = 1, bands: int = BANDS, rows: int = ROWS, without: Column | None = None) -> NearDuplicates:
    """Rows whose sets of runs of ``words`` words have a Jaccard similarity of ``threshold`` or more.

    Rows with a null key, a null text, fewer than ``least_words`` words or fewer words than a run have no
    similar rows, but a class (``rest``). Those that ``without``, a condition on the columns of ``docs``, holds for count as without
    text; it is asked once for each row. Equal sets are linked through one representative, so a text copied any number of times
    costs one row for each copy. A pair at the threshold is missed with probability (1 - threshold**rows)**bands
    or where its bits agree by chance far less than they should (SIGMAS standard deviations: one in 300,000 at the threshold, fewer above).
    """
    text = F.col(text_col)
    boxed = docs.select(F.col(id_col).alias("key"), (text if without is None else F.when(~without, text)).alias("text")).where("key is not null")
    kind = boxed.schema["key"].dataType.simpleString()
    prepared = materialise(boxed.mapInPandas(_prepare(words, least_words, bands, rows), f"key {kind}, copy bigint, bits array<bigint>, bands array<bigint>"))
    sketched, rest = prepared.where("bands is not null"), prepared.where("bands is null").select("key", "copy")
    representatives = sketched.groupBy("copy").agg(F.min("key").alias("representative"))
    members = materialise(sketched.select("key", "copy").join(representatives, "copy"))
    one_each = sketched.join(members.where("key = representative").select("key"), "key", "left_semi")
    # the same band and key: the position salts the key, so one number carries both
    keyed = one_each.select("key", F.explode("bands").alias("band"))
    found = keyed.alias("x").join(keyed.alias("y"), F.col("x.band") == F.col("y.band")).where(F.col("x.key") < F.col("y.key"))
    candidates = found.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
    bits = one_each.select("key", "bits")
    for side in ("a", "b"):
        candidates = candidates.join(bits.select(F.col("key").alias(side), F.col("bits").alias(f"bits_{side}")), side)
    bins = bands * rows
    expected = bins * (1 + threshold) / 2
    least = expected - SIGMAS * (bins * (1 + threshold) / 2 * (1 - threshold) / 2) ** 0.5
    likely = materialise(candidates.where(_agreeing(bins) >= F.lit(int(least))).select("a", "b"))
    # only texts that stand in a likely pair move; none of them falls under ``without``
    needed = likely.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    texts = materialise(docs.select(F.col(id_col).alias("key"), text.alias("text")).join(needed, "key", "left_semi"))
    judged = likely
    for side in ("a", "b"):
        judged = judged.join(texts.select(F.col("key").alias(side), F.col("text").alias(f"text_{side}")), side)
    links = materialise(judged.select("a", "b", _similarity(words)("text_a", "text_b").alias("similarity")).where(F.col("similarity") >= threshold))
    return NearDuplicates(members, links, rest)
