"""64-bit fingerprints of texts and pairs of texts whose fingerprints differ in few bits."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORDS = re.compile("[a-z0-9]+")


@F.pandas_udf(T.LongType())
def simhash64(texts: pd.Series) -> pd.Series:
    """Of each text: the bits that most of its runs of three words (MD5, first 8 bytes) have set; 0 with fewer than six words."""

    def one(text: str | None) -> int:
        words = _WORDS.findall((text or "").lower())
        if len(words) < 6:
            return 0
        runs = [hashlib.md5(" ".join(words[i : i + 3]).encode()).digest()[:8] for i in range(len(words) - 2)]
        bits = np.unpackbits(np.frombuffer(b"".join(runs), dtype=np.uint8).reshape(-1, 8), axis=1)
        votes = bits.sum(axis=0, dtype=np.int64) * 2 > len(runs)
        return int(np.packbits(votes).view(">i8")[0])

    return texts.map(one)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _keys(fingerprint: Column, most: int, together: int) -> Column:
    """Of most + ``together`` blocks of bits every ``together`` of them; two fingerprints that differ in at most ``most`` bits agree in one such choice."""
    count = most + together
    edges = [round(64 * k / count) for k in range(count + 1)]
    blocks = [F.shiftrightunsigned(F.shiftleft(fingerprint, 64 - hi), 64 - hi + lo) for lo, hi in zip(edges, edges[1:])]
    return F.array(*[F.xxhash64(F.lit(n), *[blocks[k] for k in chosen]) for n, chosen in enumerate(combinations(range(count), together))])


def similar_prints(prints: DataFrame, most: int, print_col: str = "simhash", together: int = 2) -> DataFrame:
    """``f, g, distance`` of the distinct fingerprints f < g, neither 0 nor null, that differ in 1 to ``most`` bits.

    A choice of blocks must agree exactly, which by counting misses no pair. With two blocks of eight together a key has 16 bits; three of nine
    have 21, for larger tables.
    """
    distinct = prints.select(F.col(print_col).alias("f")).where("f is not null and f <> 0").distinct()
    keyed = distinct.select("f", F.explode(_keys(F.col("f"), most, together)).alias("key"))
    # Spark sizes the keys as one row for each fingerprint and would broadcast tens of times its threshold
    near = keyed.alias("x").hint("merge").join(keyed.alias("y"), "key").select(F.col("x.f").alias("f"), F.col("y.f").alias("g")).where("f < g")
    return near.withColumn("distance", hamming(F.col("f"), F.col("g"))).where(F.col("distance") <= most).distinct()


def similar_pairs(prints: DataFrame, most: int, id_col: str = "id", print_col: str = "simhash", together: int = 2) -> DataFrame:
    """``a, b, distance`` of all ids a < b whose fingerprints differ in at most ``most`` bits, copies expanded; :func:`similar_prints` is the compact form, with the fingerprint as the class of copies."""
    own = prints.select(F.col(id_col).alias("id"), F.col(print_col).alias("f")).where("f is not null and f <> 0")
    near = similar_prints(prints, most, print_col, together)
    same = own.alias("x").join(own.alias("y"), "f").where(F.col("x.id") < F.col("y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(0).alias("distance"))
    other = near.join(own.select("f", F.col("id").alias("i")), "f").join(own.select(F.col("f").alias("g"), F.col("id").alias("j")), "g")
    return same.unionByName(other.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "distance"))
