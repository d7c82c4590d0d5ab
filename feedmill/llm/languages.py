"""Problem 5: the language of each document and of its lines in another language.

Bayesian fusion of evidence. The text speaks through a word model (likelihood of each line under each
language), trained here. The other evidence is prior: what the declared label is worth, learnt as the
share of each language behind each label; the address suffix and the host, as shares of languages
smoothed from all documents to the suffix to the host by grouped counts. A document's own verdict is left out of the counts that become
its prior, and a line's own words out of what the rest of the text says about it, so that no evidence counts twice.
Words of a text hang together, so their log likelihoods count by TEMPER; the posteriors are then about as often right as they
say. A line's posterior gives its language and confidence; a document's language is that of most of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmill.session import materialise

LANGUAGES = ("en", "no", "de", "fr", "es", "pt", "it", "el")
#: Bound of the labelled rows that the word model is fitted on, and the bits of its hashed words, of which none is dropped.
TRAIN_ROWS, CELL_BITS = 20_000, 18
#: What a word's log likelihood counts, and how far a line may differ from the rest of its text.
TEMPER, MIXED = 0.5, 0.1
SMOOTHING = 20.0
LEAST_WORDS, LEAST_LINE_WORDS = 20, 10
CONFIDENT = 0.9
MARKS = '.,;:!?"“”«»()’…–•-'
# Other notations of the languages' codes.
NOTATIONS = {
    "en": "en eng english engelsk englisch anglais inglés inglese", "no": "no nb nn nor nob nno norsk norwegian bokmål bokmal nynorsk norwegisch", "de": "de deu ger german deutsch tysk allemand", "fr": "fr fra fre french français francais fransk",
    "es": "es spa spanish español espanol castellano", "pt": "pt por portuguese português portugues", "it": "it ita italian italiano", "el": "el ell gre gr greek ελληνικά ελληνικα",
}


def normal_label(label: Column) -> Column:
    """The two-letter code that a label means, null where it means none of LANGUAGES."""
    names = F.create_map(*[F.lit(x) for code, ns in NOTATIONS.items() for n in ns.split() for x in (n, code)])
    return names[F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}]+)(?:[-_ ].*)?$", 1)]


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)


def suffix_of(host: Column) -> Column:
    """The last two labels of a host: its registry, or a registry's section."""
    return F.regexp_extract(host, r"([^.]+\.[^.]+|[^.]+)$", 1)


def _cell(word: str) -> int:
    # the same as Spark's xxhash64, of which these are the low bits
    import xxhash

    return xxhash.xxh64_intdigest(word, seed=42) & ((1 << CELL_BITS) - 1)


class WordModel:
    """log P(word | language) by the word's hashed cell; cells that hardly occurred say nothing. Its size is fixed, whatever the corpus."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray) -> None:
        self.logs = np.zeros((1 << CELL_BITS, len(LANGUAGES)), dtype=np.float32)
        if len(cells):
            known = np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * len(cells)))
            self.logs[cells] = np.clip(known - known.max(axis=1, keepdims=True), -6, 0)
        self.told = np.abs(self.logs).sum(axis=1) > 0
        self.at: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"at": {}}

    def cell(self, word: str) -> int:
        """The word's cell, or that of the word without the marks around it; -1 where it says nothing. Kept between texts."""
        if (found := self.at.get(word)) is None:
            if len(self.at) > 500_000:
                self.at.clear()
            found = _cell(word)
            if not self.told[found]:
                found = _cell(word.strip(MARKS))
            found = self.at[word] = found if self.told[found] else -1
        return found

    def lines(self, text: str) -> tuple[list[int], list[int], np.ndarray]:
        """(numbers from 1, words, log likelihoods less the greatest) of the lines that have words."""
        numbers, sizes, known, bounds = [], [], [], []
        cell = self.cell
        for number, line in enumerate(text.lower().split("\n"), 1):
            words = line.split()
            if not words:
                continue
            numbers.append(number)
            sizes.append(len(words))
            bounds.append(len(known))
            known += [i for w in words if (i := cell(w)) >= 0]
        logs = np.zeros((len(numbers), len(LANGUAGES)), dtype=np.float32)
        if known:
            total = np.concatenate([np.zeros((1, len(LANGUAGES)), np.float32), np.cumsum(self.logs[known], axis=0, dtype=np.float64)])
            logs = (total[bounds[1:] + [len(known)]] - total[bounds]).astype(np.float32)
            logs -= logs.max(axis=1, keepdims=True)
        return numbers, sizes, logs


def _counts_to_model(counted: DataFrame) -> WordModel:
    """From ``lang, word, n``: counts by cell, summed in Spark, so that a bounded number of rows reaches the driver."""
    cell = F.xxhash64("word").bitwiseAND(F.lit((1 << CELL_BITS) - 1)).cast("int")
    by_lang = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).cast("double").alias(x) for x in LANGUAGES]
    rows = counted.groupBy(cell.alias("cell")).agg(*by_lang, F.sum("n").alias("total")).where("total >= 3").toPandas()
    return WordModel(rows["cell"].to_numpy(int), rows[list(LANGUAGES)].to_numpy(float).reshape(-1, len(LANGUAGES)))


def train(documents: DataFrame, labelled: int) -> WordModel:
    """The word model from ``key, label, text``: fitted on at most TRAIN_ROWS labelled rows, then again with their lines labelled by the first fit, since labels are often wrong and texts mixed.

    ``labelled``: about how many rows have a label. Rows are taken by a hash of the key that leaves some more than TRAIN_ROWS, so
    that hardly more texts than that are read and sorted, however large the corpus.
    """
    share = min(1.0, 2.0 * TRAIN_ROWS / max(1, labelled))
    drawn = documents.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    taken = drawn.where("label is not null and length(text) > 0").orderBy(F.xxhash64("key"), "key").limit(TRAIN_ROWS).select("label", "text")
    # a limit leaves one partition; the counting below is for all cores
    sample = materialise(taken.repartition(documents.sparkSession.sparkContext.defaultParallelism, "text"))
    tokens = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}'’]+"), F.lit(0)))
    first = _counts_to_model(sample.select(F.col("label").alias("lang"), tokens.alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")))

    def relabel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[tuple[str, str], int] = {}
            for text in batch["text"]:
                lines = text.lower().split("\n")
                numbers, sizes, logs = first.lines(text)
                for number, size, row in zip(numbers, sizes, logs):
                    order = np.sort(row)
                    if size < 5 or order[-1] - order[-2] < 3:
                        continue
                    lang = LANGUAGES[int(row.argmax())]
                    for w in lines[number - 1].split():
                        w = w.strip(MARKS)
                        if w and w.replace("'", "").replace("’", "").isalpha():
                            counts[lang, w] = counts.get((lang, w), 0) + 1
            yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["lang", "word", "n"])

    return _counts_to_model(sample.select("text").mapInPandas(relabel, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")))


def _shares(counted: DataFrame, by: str) -> DataFrame:
    """``by, counts``: documents of each language, in LANGUAGES' order."""
    return counted.groupBy(by).agg(F.array(*[F.count_if(F.col("lang") == x).cast("double") for x in LANGUAGES]).alias(f"{by}_counts"))


def _smooth(own: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Shares of ``own`` counts (a row each), drawn towards the shares ``above`` them."""
    return (own + above * SMOOTHING) / (own.sum(axis=1, keepdims=True) + SMOOTHING)


def _counts(column: pd.Series, own: np.ndarray) -> np.ndarray:
    """A column of count arrays as rows, less each document's own verdict; none where there is no array."""
    none = np.zeros(len(LANGUAGES))
    return np.maximum(np.array([none if x is None else x for x in column], dtype=float).reshape(-1, len(LANGUAGES)) - own, 0)


def prior_shares(batch: pd.DataFrame, base: np.ndarray) -> np.ndarray:
    """The prior of each document of ``lang, label, host_counts, suffix_counts, label_counts``: its host's shares, smoothed from all to suffix to host, times what its label is worth."""
    own = np.array([[x == lang for x in LANGUAGES] for lang in batch["lang"]], dtype=float).reshape(-1, len(LANGUAGES))
    host = _smooth(_counts(batch["host_counts"], own), _smooth(_counts(batch["suffix_counts"], own), base))
    labelled = np.array([x is not None for x in batch["label"]])[:, None]
    # a label's worth: the languages found behind it, against how frequent they are anyway
    worth = np.where(labelled, _smooth(_counts(batch["label_counts"], own), base) / base, 1.0)
    prior = host * worth
    return prior / prior.sum(axis=1, keepdims=True)


def identify(documents: DataFrame, id_col: str = "id", text_col: str = "text", label_col: str = "lang", url_col: str = "url", without: Column | None = None) -> DataFrame:
    """``id_col, line_no, words, lang, confidence, label, main`` of each text and of each of its lines with words.

    line_no 0 stands for the whole text: the language of most of its words, with the share-weighted
    confidence of its lines; ``main`` repeats it in each line's row; ``label`` is what the declared label means, null where it means nothing.
    Null, empty and blank texts have no rows. Words are separated by blanks and line ends. Rows with equal ids stay apart.
    Rows for which ``without`` is true are left out.
    """
    named = documents.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), normal_label(F.col(label_col)).alias("label"), host_of(F.col(url_col)).alias("host"))
    labelled = named.where("label is not null").count()
    if without is not None:
        named = documents.where(~without).select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), normal_label(F.col(label_col)).alias("label"), host_of(F.col(url_col)).alias("host"))
    kind = named.schema["key"].dataType.simpleString()
    model = train(named, labelled)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, label, host in zip(batch["key"], batch["text"], batch["label"], batch["host"]):
                numbers, sizes, logs = model.lines(text)
                if numbers:
                    weight = np.bincount(logs.argmax(axis=1), weights=sizes, minlength=len(LANGUAGES))
                    out.append((key, label, host, numbers, sizes, np.round(logs, 1).ravel(), LANGUAGES[int(weight.argmax())] if logs.any() else None))
            yield pd.DataFrame(out, columns=["key", "label", "host", "numbers", "sizes", "logs", "lang"])

    texts = named.where("length(text) > 0")
    first = materialise(texts.mapInPandas(read, f"key {kind}, label string, host string, numbers array<int>, sizes array<int>, logs array<float>, lang string").withColumn("suffix", suffix_of(F.col("host"))))
    told = first.where("lang is not null")
    every = told.agg(*[F.count_if(F.col("lang") == x).alias(x) for x in LANGUAGES]).first()
    base = np.array([every[x] + 1.0 for x in LANGUAGES])
    base /= base.sum()
    fused = first.join(_shares(told, "host"), "host", "left").join(_shares(told, "suffix"), "suffix", "left").join(_shares(told.where("label is not null"), "label"), "label", "left")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            priors = np.log(prior_shares(batch, base) + 1e-9)
            for key, label, numbers, sizes, logs, prior in zip(batch["key"], batch["label"], batch["numbers"], batch["sizes"], batch["logs"], priors):
                logs = TEMPER * np.asarray(logs, dtype=float).reshape(len(numbers), len(LANGUAGES))
                sizes = np.asarray(sizes)

                def posterior(scores: np.ndarray) -> np.ndarray:
                    e = np.exp(scores - scores.max(axis=1, keepdims=True))
                    return e / e.sum(axis=1, keepdims=True)

                # the lines of a text mostly share its language: the words of the others are a line's prior, beside the document's
                mass = sizes[:, None] * posterior(logs + prior)
                others = mass.sum(axis=0) - mass
                rest = (1 - MIXED) * (others + np.exp(prior)) / (others.sum(axis=1, keepdims=True) + 1) + MIXED / len(LANGUAGES)
                lines = posterior(logs + np.log(rest))
                mass = sizes @ lines
                top = int(mass.argmax())
                out.append((key, 0, int(sizes.sum()), LANGUAGES[top], float(mass[top] / mass.sum()), label, LANGUAGES[top]))
                best = lines.argmax(axis=1)
                for n, size, k, c in zip(numbers, sizes, best, lines.max(axis=1)):
                    out.append((key, int(n), int(size), LANGUAGES[int(k)], float(c), label, LANGUAGES[top]))
            yield pd.DataFrame(out, columns=["key", "line_no", "words", "lang", "confidence", "label", "main"])

    decided = fused.select("key", "label", "lang", "numbers", "sizes", "logs", "host_counts", "suffix_counts", "label_counts").mapInPandas(decide, f"key {kind}, line_no int, words int, lang string, confidence double, label string, main string")
    return decided.withColumnRenamed("key", id_col)


def mislabelled(documents: DataFrame, id_col: str = "id", text_col: str = "text", label_col: str = "lang", url_col: str = "url", without: Column | None = None) -> DataFrame:
    """``id_col, line_no, lang``: texts of at least LEAST_WORDS words whose label is missing, unknown or another language (line_no 0), and lines of at least LEAST_LINE_WORDS words in another language than the text's."""
    found = identify(documents, id_col, text_col, label_col, url_col, without)
    whole = (F.col("line_no") == 0) & (F.col("words") >= LEAST_WORDS) & ~F.col("label").eqNullSafe(F.col("lang"))
    line = (F.col("line_no") > 0) & (F.col("words") >= LEAST_LINE_WORDS) & (F.col("confidence") >= CONFIDENT) & (F.col("lang") != F.col("main"))
    return found.where(whole | line).select(id_col, "line_no", "lang")
