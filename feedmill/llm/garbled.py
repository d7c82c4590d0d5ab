"""Problem 10: text decoded with the wrong character encoding, found and restored.

Only characters beyond ASCII can be wrong, so the unit of work is the segment: a run of such characters
with one ASCII character on either side. The corpus's distinct segments are counted by a grouped
aggregation; a smoothed character bigram model is trained on the clean ones; for each distinct segment every
chain of encoding back and decoding again is scored, and the likeliest is accepted if it beats the text
as it stands by a margin. The margins are validated on the corpus at hand (``validate``): each clean segment is scored by a model that
doesn't know it, and a margin is what all but FALSE_ALARMS of the clean occurrences stay below. The verdicts go back to the documents by a join on the
segment; a chain into a one-byte encoding, which a single short segment can't prove, is also accepted for a document in which the gains of its
segments together beat the margin.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmill.session import materialise

SEGMENT = r"[\x00-\x7F]?[^\x00-\x7F]+[\x00-\x7F]?"
BIGRAM_BITS, UNIGRAM_BITS = 18, 14
#: Encodings that text was wrongly decoded with.
WRONG = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "iso8859_2", "iso8859_7", "cp866", "koi8_r", "cp852", "cp737", "mac_cyrillic", "mac_greek")
#: One-byte encodings that text was really in.
RIGHT = ("cp1252", "mac_roman", "cp437", "cp850", "cp1253", "cp1250")
#: Gains in log likelihood from which a chain is accepted, by kind, before they are validated: it ends in UTF-8 and gives pairs known from clean
#: text; it ends in UTF-8 and gives others; it ends in a one-byte encoding. No margin goes below LEAST_MARGIN.
START = {"known": 4.0, "new": 12.0, "byte": 8.7}
LEAST_MARGIN = {"known": 3.0, "new": 9.0, "byte": 6.0}
#: Share of the clean occurrences that may be taken for garbled.
FALSE_ALARMS = 2e-3
#: Occurrences, beside three times the mean load of a hashed cell, from which a pair is known.
KNOWN = 3
#: Gain from which a weaker segment is restored where its document has the same chain accepted elsewhere.
WEAK = 1.5
LOST = "\ufffd"
#: Symbols that stand for many characters, so that their pairs are no evidence.
BLOCKS = {"一", "\U0001f300"}


def _tables() -> tuple[dict[str, dict[str, int]], dict[str, list[str | None]]]:
    """Of each encoding: character to byte, and byte to character. Bytes without a character stand for the control of that number, as browsers and many tools read them."""
    to_byte, to_char = {}, {}
    for name in {*WRONG, *RIGHT}:
        chars: list[str | None] = []
        for b in range(256):
            try:
                chars.append(bytes([b]).decode(name))
            except UnicodeDecodeError:
                chars.append(None)
        to_char[name] = chars
        to_byte[name] = {chr(b): b for b in range(128, 256)} if name == "cp1252" else {}
        to_byte[name] |= {c: b for b, c in enumerate(chars) if c is not None and b > 127}
        if None in chars:
            to_byte[name] |= {chr(b): b for b, c in enumerate(chars) if c is None}
    return to_byte, to_char


TO_BYTE, TO_CHAR = _tables()


def symbol(c: str) -> str:
    """What the model sees: ASCII capitals, digits and blanks by kind, ideographs and what has no plane-0 letter by block."""
    o = ord(c)
    if o < 128:
        return "A" if "A" <= c <= "Z" else "0" if c.isdigit() else " " if c.isspace() else c
    if 0x80 <= o < 0xA0:
        return "\x80"
    return "一" if 0x2E80 <= o < 0xE000 else "\U0001f300" if o > 0xFFFF else c


def _hash(s: str, bits: int) -> int:
    """A fixed multiplicative hash, the same in every process."""
    h = 0
    for c in s:
        h = (h * 1000003 ^ ord(c)) & 0xFFFFFFFF
    return (h * 2654435761 & 0xFFFFFFFF) >> (32 - bits)


@dataclass
class Model:
    """Hashed counts of one and two symbols; its size is fixed, whatever the corpus."""

    one: np.ndarray
    two: np.ndarray
    cache: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.total = float(self.one.sum()) + 1.0
        self.known = KNOWN + 3 * float(self.two.sum()) / len(self.two)

    def without(self, s: str, n: int) -> Model:
        """The model as it would be had it not seen ``n`` times the segment ``s``, for scoring ``s`` and what it is made into."""
        t = [symbol(c) for c in s]
        return _Less(self.one, self.two, less_one=Counter(_hash(c, UNIGRAM_BITS) for c in t), less_two=Counter(_hash(x + y, BIGRAM_BITS) for x, y in zip(t, t[1:])), n=n)

    def pair(self, pair: str) -> float:
        return self.two[_hash(pair, BIGRAM_BITS)]

    def single(self, c: str) -> float:
        return self.one[_hash(c, UNIGRAM_BITS)]

    def step(self, pair: str) -> float:
        """log P(second | first)."""
        if (got := self.cache.get(pair)) is None:
            a, b = self.single(pair[0]), self.single(pair[1])
            p = 0.8 * self.pair(pair) / (a + 2.0) + 0.2 * (b + 0.02) / self.total
            got = self.cache[pair] = math.log(p)
        return got

    def score(self, s: str) -> float:
        t = [symbol(c) for c in s]
        return sum(self.step(a + b) for a, b in zip(t, t[1:])) if len(t) > 1 else self.step(" " + t[0])


@dataclass
class _Less(Model):
    """A model less a segment's own counts."""

    less_one: Counter = field(default_factory=Counter)
    less_two: Counter = field(default_factory=Counter)
    n: int = 0

    def pair(self, pair: str) -> float:
        at = _hash(pair, BIGRAM_BITS)
        return max(0.0, self.two[at] - self.n * self.less_two[at])

    def single(self, c: str) -> float:
        at = _hash(c, UNIGRAM_BITS)
        return max(0.0, self.one[at] - self.n * self.less_one[at])


def _run_of(segment: str) -> tuple[int, int]:
    return int(ord(segment[0]) < 128), len(segment) - int(len(segment) > 1 and ord(segment[-1]) < 128)


def _as_bytes(run: str, name: str) -> bytes | None:
    table = TO_BYTE[name]
    try:
        return bytes([table[c] for c in run])
    except KeyError:
        return None


def chains(run: str, depth: int = 2) -> Iterator[tuple[str, str, bool]]:
    """(chain, text, whether it ends in UTF-8) of every chain that ``run`` can be led back through."""
    for wrong in WRONG:
        raw = _as_bytes(run, wrong)
        if raw is None:
            continue
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            text = None
        if text is not None:
            yield f"{wrong}>utf-8", text, True
            if depth > 1 and not text.isascii():
                for name, deeper, utf in chains(text, depth - 1):
                    if utf:
                        yield f"{wrong}>utf-8 {name}", deeper, True
        for right in RIGHT:
            if right != wrong:
                chars = [TO_CHAR[right][b] for b in raw]
                if None not in chars:
                    yield f"{wrong}>{right}", "".join(chars), False


def plausible(s: str) -> bool:
    """No controls, private or unassigned characters."""
    return all(unicodedata.category(c) not in ("Cc", "Co", "Cn", "Cs") for c in s)


def best_chain(model: Model, segment: str, margins: dict[str, float] = START) -> tuple[float, str, str, str]:
    """(gain, kind, chain, restored segment) of the chain that exceeds its margin most, or by which it falls short least."""
    a, z = _run_of(segment)
    head, run, tail = segment[:a], segment[a:z], segment[z:]
    now = model.score(segment)
    best, most = (-math.inf, "byte", "", segment), -math.inf
    for name, text, utf in chains(run):
        if text == run or not plausible(text):
            continue
        fixed = head + text + tail
        t = [symbol(c) for c in fixed]
        known = not BLOCKS & {*t} and all(model.pair(x + y) >= model.known for x, y in zip(t, t[1:]))
        # any bytes can be read in a one-byte encoding, and a few happen to be UTF-8: only pairs known from clean text count there
        if not known and (not utf or len(text) < 3):
            continue
        gain, kind = model.score(fixed) - now, "byte" if not utf else "known" if known else "new"
        if gain - margins[kind] > most:
            best, most = (gain, kind, name, fixed), gain - margins[kind]
    return best


def _segments(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(0)))


def train(segments: DataFrame) -> Model:
    """The model from ``segment, n``. Only the hashed counts, of fixed size, reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        two, one = np.zeros(1 << BIGRAM_BITS), np.zeros(1 << UNIGRAM_BITS)
        for batch in batches:
            for segment, n in zip(batch["segment"], batch["n"]):
                t = [symbol(c) for c in segment]
                for c in t:
                    one[_hash(c, UNIGRAM_BITS)] += n
                for x, y in zip(t, t[1:]):
                    two[_hash(x + y, BIGRAM_BITS)] += n
        for kind, counts in enumerate((one, two)):
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"kind": np.int32(kind), "at": at.astype(np.int32), "n": counts[at]})

    counts = segments.select("segment", "n").mapInPandas(count, "kind int, at int, n double").groupBy("kind", "at").agg(F.sum("n").alias("n")).toPandas()
    arrays = [np.zeros(1 << UNIGRAM_BITS, np.float32), np.zeros(1 << BIGRAM_BITS, np.float32)]
    for kind, array in enumerate(arrays):
        own = counts[counts["kind"] == kind]
        array[own["at"].to_numpy(int)] = own["n"].to_numpy()
    return Model(*arrays)


def judge(segments: DataFrame, model: Model, margins: dict[str, float] = START) -> DataFrame:
    """``segment, n, gain, kind, chain, restored, garbled`` of each segment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(model.one, model.two)
        for batch in batches:
            found = [best_chain(own, s, margins) for s in batch["segment"]]
            gains = np.array([g for g, *_ in found], dtype=float)
            lost = batch["segment"].str.contains(LOST, regex=False).to_numpy(bool)
            garbled = (gains >= np.array([margins[k] for _, k, *_ in found], dtype=float)) | lost
            yield batch.assign(gain=gains, kind=[k for _, k, *_ in found], chain=[c for *_, c, _ in found], restored=[f for *_, f in found], garbled=garbled)

    return segments.select("segment", "n").mapInPandas(run, "segment string, n bigint, gain double, kind string, chain string, restored string, garbled boolean")


def validate(clean: DataFrame, model: Model, false_alarms: float = FALSE_ALARMS, recall: bool = False) -> dict[str, tuple[float, float, float]]:
    """(margin, share of clean occurrences at or above it, share of garbled ones found) by kind, from clean segments (``segment, n``).

    Each clean segment is scored by the model less its own counts: as it stands, which is a false alarm if a chain gains, and garbled by every
    chain (written in UTF-8 or a one-byte encoding, read in a wrong one). A margin is the least tenth that all but ``false_alarms`` of the clean occurrences stay
    below, but LEAST_MARGIN at least. The garbled ones tell what that costs, and are made only where ``recall`` is asked for. Only counts by kind and tenth of a gain reach the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = Model(model.one, model.two)
        for batch in batches:
            counts: Counter = Counter()
            for segment, n in zip(batch["segment"], batch["n"]):
                less = whole.without(segment, int(n))
                gain, kind, *_ = best_chain(less, segment)
                counts[kind, False, _tenth(gain)] += int(n)
                a, z = _run_of(segment)
                for garbled in _garble(segment[a:z]) if recall else ():
                    gain, kind, _, fixed = best_chain(less, segment[:a] + garbled + segment[z:])
                    if gain > -math.inf:
                        counts[kind, True, _tenth(gain if fixed == segment else -math.inf)] += 1
            yield pd.DataFrame([(k, g, t, n) for (k, g, t), n in counts.items()], columns=["kind", "garbled", "tenth", "n"])

    rows = clean.select("segment", "n").mapInPandas(run, "kind string, garbled boolean, tenth int, n bigint").groupBy("kind", "garbled", "tenth").agg(F.sum("n").alias("n")).collect()
    every = max(1, sum(r["n"] for r in rows if not r["garbled"]))
    found = {}
    for kind, least in LEAST_MARGIN.items():
        over = lambda m, g: sum(r["n"] for r in rows if r["kind"] == kind and r["garbled"] == g and r["tenth"] >= round(10 * m))  # noqa: E731, B023
        margin = least
        while over(margin, False) > false_alarms * every:
            margin = round(margin + 0.1, 1)
        made = sum(r["n"] for r in rows if r["kind"] == kind and r["garbled"])
        found[kind] = (margin, over(margin, False) / every, over(margin, True) / max(1, made))
    return found


def _tenth(gain: float) -> int:
    return -1000 if gain < -100 else min(10_000, math.floor(10 * gain))


def _garble(run: str) -> Iterator[str]:
    """The run as every chain would garble it, where it can."""
    for right in ("utf-8", *RIGHT):
        try:
            raw = run.encode(right)
        except UnicodeEncodeError:
            continue
        for wrong in WRONG:
            chars = [TO_CHAR[wrong][b] for b in raw]
            if wrong != right and None not in chars and (made := "".join(chars)) != run and not made.isascii():
                yield made


def judged_segments(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The verdict on each distinct segment of ``docs``: trained on segments that no UTF-8 chain explains, then again on all that were not found garbled."""
    counted = docs.select(F.explode(_segments(F.col(text_col))).alias("segment")).groupBy("segment").agg(F.count("*").alias("n"))
    counted = materialise(counted)

    @F.pandas_udf("boolean")
    def explained(segments: pd.Series) -> pd.Series:
        return segments.map(lambda s: any(utf for *_, utf in chains(s[slice(*_run_of(s))], 1)))

    first = train(counted.where(~explained("segment")))
    clean = materialise(judge(counted, first).where("not garbled").select("segment", "n"))
    second = train(clean)
    margins = {kind: margin for kind, (margin, *_) in validate(clean, second).items()}
    return materialise(judge(counted, second, margins).withColumn("margin", F.lit(margins["byte"])))


def margins_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``kind, margin, false_alarms, found``: the validated margins on these texts, with both rates."""
    counted = materialise(docs.select(F.explode(_segments(F.col(text_col))).alias("segment")).groupBy("segment").agg(F.count("*").alias("n")))
    clean = materialise(judge(counted, train(counted)).where("not garbled").select("segment", "n"))
    return docs.sparkSession.createDataFrame([(k, *v) for k, v in validate(clean, train(clean), recall=True).items()], "kind string, margin double, false_alarms double, found double")


def _held(docs: DataFrame, verdicts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key, segment, ...`` of each document's segments that have a verdict."""
    return docs.select(F.col(id_col).alias("key"), F.explode(_segments(F.col(text_col))).alias("segment")).join(verdicts, "segment")


def find_garbled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` of each row whose text holds a garbled segment or characters lost in decoding.

    Null, empty and pure ASCII texts are never found. Rows that repeat an id count once.
    """
    verdicts = judged_segments(docs, text_col).where("garbled or gain > 0")
    return _accepted(_held(docs, verdicts, id_col, text_col)).select(F.col("key").alias(id_col)).distinct()


def _accepted(held: DataFrame) -> DataFrame:
    """``key, chain`` of what is accepted: a chain of a garbled segment (none where characters were only lost), and a one-byte chain whose gains in the document together beat the margin."""
    pooled = held.groupBy("key", "chain").agg(F.max("garbled").alias("any"), F.sum(F.when((F.col("kind") == "byte") & (F.col("gain") > 0), F.col("gain"))).alias("gains"), F.max("margin").alias("margin"))
    return pooled.where(F.col("any") | (F.col("gains") >= F.col("margin"))).select("key", "chain")


def restore(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, chain, restored`` of each garbled row: the text with every garbled segment led back.

    ``chain`` lists the chains used, sorted. Characters that the wrong decoding lost stay U+FFFD.
    """
    verdicts = judged_segments(docs, text_col).where("garbled or gain > 0").withColumn("chain", F.nullif("chain", F.lit("")))
    held = materialise(_held(docs, verdicts, id_col, text_col))
    chains = _accepted(held).groupBy("key").agg(F.array_sort(F.collect_set("chain")).alias("chains"))
    own = held.join(chains, "key").where(F.col("garbled") | (F.col("gain") >= WEAK) & F.array_contains("chains", F.col("chain")))
    fixes = own.groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("segment", "restored"))).alias("fixes"))
    found = chains.join(fixes, "key", "left").select("key", F.array_join("chains", " + ").alias("chain"), F.coalesce("fixes", F.create_map().cast("map<string,string>")).alias("fixes"))

    @F.pandas_udf("string")
    def apply(texts: pd.Series, fixes: pd.Series) -> pd.Series:
        pattern = re.compile(SEGMENT)
        return pd.Series([pattern.sub(lambda m, f=dict(fix): f.get(m[0], m[0]), text) for text, fix in zip(texts, fixes)])

    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    return texts.join(found, "key").select(F.col("key").alias(id_col), "chain", apply("text", "fixes").alias("restored"))
