"""Checks and repairs of short texts that a model or a person wrote, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedmill.functions import text as X
from feedmill.functions.timestamps import let

TARGET_WORDS, SPARE_TOKENS = 190, 320
# Tokens a word takes, by language; 3.2 for any other.
TOKENS_PER_WORD = {
    "en": 1.7, "es": 2.4, "fr": 2.4, "it": 2.4, "pt": 2.4, "de": 2.6, "nl": 2.6, "no": 2.8, "da": 2.8, "sv": 2.8,
    "fi": 3.4, "pl": 3.4, "tr": 3.4, "ru": 3.8, "el": 5.0, "ar": 4.4, "hi": 5.0, "zh": 2.6, "ja": 3.0, "ko": 3.4,
}
# Languages whose words aren't spaced, characters that end a sentence, and those that may close a finished text.
UNSPACED = ("zh", "ja", "ko")
STOPS = ".!?…。！？؟।"
CLOSERS = STOPS + "\"')»”』」"
# Languages not written in Latin letters.
NOT_LATIN = ("el", "ru", "ar", "zh", "ja", "ko", "hi")
# Suffixes tried for a bare name, in this order.
TLDS = (".com", ".org", ".net", ".io", ".co", ".news", ".eu")
# Calls that need more supportive, and more adverse, observations.
CALLS_UP, CALLS_DOWN = ("buy", "accumulate"), ("reduce", "sell")

# How thinking aloud begins; headings and openings that restate a task; marks after which the answer begins.
THINKING = ("okay", "ok", "alright", "so", "right", "hmm", "let me", "let's", "first,", "i need to", "i should", "i'll", "the user wants", "the user is asking", "we need to", "to write this")
HEADINGS = ("abstract", "summary", "résumé", "resumen", "zusammenfassung", "περίληψη")
RESTATED = ("here is", "here's", "below is")
ANSWER_MARKS = ("</think>", "</thinking>", "\n\nAbstract:", "\n\nHere is", "\n\n---\n\n")
# Words that are true of every article; words with which a wish to follow something begins.
EMPTY_WORDS = "news article articles update updates report reports story stories latest new about and the for with from into that this topic anything everything related regarding want follow track interested please would like".split()
WISHES = "i just want would like need please let me to follow track watch see get show read about on news anything article articles update updates everything stories".split()


def iso(at: Column) -> Column:
    """An instant as ISO 8601 text in UTC, in whole seconds; the session's time zone must be UTC."""
    return F.date_format(F.date_trunc("second", at), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)(\S+)"), F.lit(1))


def truncate_words(text: Column, most: int, mark: str = " […]") -> Column:
    """The first ``most`` words and a mark, where there are more; else the text as it is."""
    return F.when(X.word_count(text) > most, F.concat(F.array_join(F.slice(words_of(text), 1, most), " "), F.lit(mark))).otherwise(text)


def token_budget(lang: Column, words: int = TARGET_WORDS) -> Column:
    """The tokens that so many words of a language may take, and some to spare."""
    each = F.create_map(*[F.lit(x) for pair in TOKENS_PER_WORD.items() for x in pair])
    return (F.floor(F.round(words * F.coalesce(each[lang], F.lit(3.2)), 6)) + SPARE_TOKENS).cast("int")


def length_in_words(text: Column, lang: Column) -> Column:
    """Words; where a language has no blanks between them, 1.6 characters each."""
    characters = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""))
    return F.when(lang.isin(*UNSPACED), F.bround(characters / 1.6).cast("int")).otherwise(X.word_count(text))


def looks_truncated(text: Column) -> Column:
    """Whether a text ends in the middle of a sentence; an empty one doesn't."""
    return F.coalesce(F.rtrim(text).rlike(f"(?s)[^{_escaped(CLOSERS)}]$"), F.lit(False))


def _escaped(chars: str) -> str:
    return "".join("\\" + c if c in "\\]^-[" else c for c in chars)


def trim_to_sentence(text: Column) -> Column:
    """Up to the last end of a sentence; the whole text where there is none."""
    cut = F.regexp_extract(F.rtrim(text), f"(?s)^(..*[{_escaped(STOPS)}])", 1)
    return F.when(cut != "", cut).otherwise(F.rtrim(text))


def finished(text: Column, lang: Column) -> Column:
    """A text cut in the middle of a sentence goes back to the last whole one, if that leaves two fifths of the wanted length."""
    cut = trim_to_sentence(text)
    return F.when(looks_truncated(text) & (length_in_words(cut, lang) >= TARGET_WORDS * 0.4), cut).otherwise(text)


def looks_like_reasoning(text: Column, lang: Column) -> Column:
    """Whether a text opens like thinking aloud, or is in Latin letters though its language isn't written so (from 121 characters on)."""
    opens = text.rlike(rf"(?i)^\s*(?:{'|'.join(THINKING)})(?!\w)")
    letters = F.greatest(F.regexp_count(text, F.lit(r"\p{L}")), F.lit(1))
    latin = (F.length(F.trim(text)) > 120) & lang.isin(*NOT_LATIN) & (F.regexp_count(text, F.lit("[A-Za-z]")) / letters > 0.92)
    return F.coalesce(opens | latin, F.lit(False))


def without_reasoning(text: Column) -> Column:
    """What follows the last mark that ends a block of thinking."""
    return F.trim(F.regexp_replace(text, f"(?s)^.*(?:{'|'.join(ANSWER_MARKS)})", ""))


def clean_answer(text: Column) -> Column:
    """Without a heading or an opening that restates the task, as one paragraph."""
    s = F.regexp_replace(F.trim(text), rf"(?i)^(?:{'|'.join(HEADINGS)})\s*[:–-]\s*", "")
    s = F.regexp_replace(s, rf"(?i)^(?:{'|'.join(RESTATED)})[^.\n]{{0,60}}[.:]\s*", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def seed_phrases(description: Column) -> Column:
    """The phrases of a description, at most six: quoted ones, then what commas, slashes and conjunctions separate, of one to five words that aren't all EMPTY_WORDS."""
    text = F.trim(F.coalesce(description, F.lit("")))
    quoted = F.transform(F.regexp_extract_all(text, F.lit('"([^"]{3,40})"'), F.lit(1)), lambda q: F.lower(F.trim(q)))
    plain = F.trim(F.regexp_replace(text, '"[^"]*"', " "))
    plain = F.regexp_replace(plain, rf"(?i)^(?:(?:{'|'.join(WISHES)})\s+)+", "")
    parts = F.transform(F.split(plain, r"\s*(?:,|;|/|\band\b|\bor\b|\bplus\b)\s*"), lambda p: F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.trim(p), r"^[.!?]+|[.!?]+$", "")), r"^(?:the|a|an|about|on|in|of)\s+", "")))
    common = F.array(*map(F.lit, EMPTY_WORDS))
    kept = F.filter(parts, lambda p: (F.length(p) >= 3) & (F.size(F.split(p, r"\s+")) <= 5) & F.exists(F.split(p, r"\s+"), lambda w: ~F.array_contains(common, w)))
    return F.slice(F.array_distinct(F.concat(quoted, kept)), 1, 6)


def tidy_names(names: Column, most: int = 14) -> Column:
    """Names without outer punctuation and closing brackets, in lower case, of 3 to 40 characters and at most five words, each once."""
    bare = lambda n: F.trim(F.regexp_replace(n, r"^[\"'`*_.,;:\s]+|[\"'`*_.,;:\s]+$", ""))
    plain = F.transform(names, lambda n: bare(F.regexp_replace(bare(F.regexp_replace(F.lower(n), r"\s+", " ")), r"\s*\([^()]*\)$", "")))
    return F.slice(F.array_distinct(F.filter(plain, lambda n: F.length(n).between(3, 40) & (F.size(F.split(n, " ")) <= 5))), 1, most)


def probe_terms(include: Column, require: Column, entities: Column, name: Column) -> Column:
    """The first eight words or phrases that a rule can be recognised by; those of its name (from four letters) where it has none."""
    none = F.array().cast("array<string>")
    own = F.concat(F.transform(F.coalesce(include, none), F.lower), F.transform(F.coalesce(require, none), F.lower), F.transform(F.coalesce(entities, none), lambda e: F.lower(F.replace(e, F.lit("_"), F.lit(" ")))))
    of_name = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"(?U)\W+"), lambda w: F.length(w) > 3)
    return F.slice(F.array_distinct(F.when(F.size(own) > 0, own).otherwise(of_name)), 1, 8)


def text_to_embed(title: Column, headline: Column, summary: Column, text: Column, words: int = 220) -> Column:
    """What is turned into a vector: title, headline, summary and the body's first words, a line each; empty ones left out."""
    body = F.array_join(F.slice(words_of(text), 1, words), " ")
    return F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in (title, headline, summary, body)])


def stance_conflict(call: Column, supportive: Column, adverse: Column, observations: Column) -> Column:
    """``unsupported`` without observations, ``conflict`` where a call goes against most of them, else empty."""
    against = call.isin(*CALLS_UP) & (adverse > supportive) | call.isin(*CALLS_DOWN) & (supportive > adverse)
    return F.when(observations == 0, "unsupported").when(against, "conflict").otherwise("")


def cited(ids: Column, valid: Column, most: int = 6) -> Column:
    """The cited ids that exist, each once, in their order, at most ``most``."""
    return F.slice(F.array_intersect(ids, valid), 1, most)


def clean_terms(found: Column, known: tuple[str, ...], most: int = 5) -> Column:
    """The terms that the vocabulary knows, each once, in their order."""
    return F.slice(F.array_intersect(found, F.array(*map(F.lit, known))), 1, most)


def relevance(relevant: Column, content_class: Column, primary_hits: Column, exclusive: Column, significance: Column, confidence: Column) -> Column:
    """``relevant, significance, confidence`` after the override: what is no article is never relevant; what was rejected though the vocabulary names it stays, at low weight."""
    kept = ~relevant & ((primary_hits > 0) | exclusive)
    article = F.coalesce(content_class, F.lit("")) != "not_article"
    return F.struct((article & (relevant | kept)).alias("relevant"), F.when(article & kept, F.least(significance, F.lit(1.5))).otherwise(significance).alias("significance"), F.when(article & kept, F.least(confidence, F.lit(0.5))).otherwise(confidence).alias("confidence"))


def candidate_urls(text: Column) -> Column:
    """The addresses that a typed site name, host or address may mean, the likeliest first; none for an empty text."""

    def build(t: Column) -> Column:
        https = lambda x: F.concat(F.lit("https://"), x)
        www = lambda x: F.concat(F.lit("https://www."), x)
        bare = F.flatten(F.array(*[F.array(https(F.concat(F.lower(t), F.lit(tld))), www(F.concat(F.lower(t), F.lit(tld)))) for tld in TLDS]))
        host = F.when(t.startswith("www."), F.array(https(t))).otherwise(F.array(https(t), www(t)))
        return F.when(t == "", F.array().cast("array<string>")).when(t.rlike("^https?://"), F.array(t)).when(t.rlike("[/.]"), host).when(t.rlike(r"^[A-Za-z0-9-]+$"), bare).otherwise(F.array(https(t)))

    edge = r"^[\s.,;:\"'<>()\[\]]+|[\s.,;:\"'<>()\[\]]+$"
    return let(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), edge, ""), r"\s+", ""), "^//", ""), build)


def paragraphs_packed(text: Column, most: int = 550) -> Column:
    """The text's paragraphs packed into pieces of at most ``most`` words, blank lines between them; a longer paragraph is a piece of its own."""
    paras = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), F.trim), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def add(held: Column, p: Column) -> Column:
        w = X.word_count(p)
        full = (held["open"] != "") & (held["n"] + w > most)
        done = F.when(full, F.concat(held["done"], F.array(held["open"]))).otherwise(held["done"])
        now = F.when(full | (held["open"] == ""), p).otherwise(F.concat(held["open"], F.lit("\n\n"), p))
        n = F.when(full, w).otherwise(held["n"] + w)
        return F.struct(F.when(n >= most, F.concat(done, F.array(now))).otherwise(done).alias("done"), F.when(n >= most, F.lit("")).otherwise(now).alias("open"), F.when(n >= most, F.lit(0)).otherwise(n).alias("n"))

    return F.aggregate(paras, start, add, lambda held: F.when(held["open"] != "", F.concat(held["done"], F.array(held["open"]))).otherwise(held["done"]))
