"""Problem 6: what stands around the article on a page.

Nearest-URL page differencing. Pages are ordered by host and path, so that a page's neighbours come from the same
template; the order is a range partitioning, which spreads a large site over many tasks. Each page's lines are
aligned with those of its nearest neighbours of the same host by longest common subsequence, once as they are and once
by their template (what stands before a colon, the separators of a path or of a menu in one line), and a
line that neighbours share is page furniture. A heading that neighbours share, with a list of other headings under it, is a slot of the
template whose filling differs from page to page; the list goes with its heading. Near copies of the page are
passed over as neighbours, since they share the article, and the next pages take their place (behind a page any number are
passed over, ahead of it up to AHEAD pages). Bylines stay. Stray placeholders go by
the grammar of their delimiters. Word lists are a tie-break: they are asked only where a page has fewer than
FEW neighbours, so that sharing can't tell.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmill.llm.languages import host_of
from feedmill.llm.residue import BULLET, CLOSING, EMPTY_VALUE, END, OPENERS, PLACEHOLDER, WORD, is_leftover

#: Neighbours on either side; lines from which a line is a paragraph, and neighbours that must share a paragraph.
SIDE, PARAGRAPH_WORDS, PARAGRAPH_SHARED = 16, 12, 3
#: Pages looked ahead for neighbours; behind a page all are looked at.
AHEAD = 4 * SIDE
#: Fewer neighbours than these can't tell the template from chance.
FEW = 3
BYLINE = re.compile(
    r"(?:by|av|von|par|por|di|da|dal|dalla|de|από|του|της|text|texto|texte|testo|tekst|report|reportage|reportaje|reportagem|bericht|foto|κείμενο|ρεπορτάζ|γράφει|skrevet av|escrito por|scritto da|redacción|redazione|redaktion)\b(?! the page)",
    re.I,
)
# Tie-break: usual words of headings of lists of other articles, and of notices and prompts.
LIST_HEADING = re.compile(
    r"related|you may also|more (?:from|on|stories)|read (?:more|next)|recommended|most (?:read|popular|viewed)|editor'?s picks|trending"
    r"|les (?:mer|også)\b|flere saker|mest lest|se også|siste saker|anbefalt|meistgelesen|siehe auch|mehr (?:zum thema|aus)|lesen sie|weitere artikel|empfohlen|auch interessant"
    r"|à (?:lire|voir)|les plus lus|sur le même|articles liés|(?:voir|lire) aussi|recommandé|te puede interesar|sobre el mismo|(?:lee|ver|lea) también|lo más|recomendad|otras noticias"
    r"|leia|mais lid|(?:ver|veja) também|mais notícias|relacionad|sullo stesso|i più letti|leggi (?:anche|pure)|potrebbe interess|altri articoli|correlati|vedi anche|σχετικά|διαβάστε|περισσότερα|δημοφιλή|δείτε (?:επίσης|ακόμη)",
    re.I,
)
NOTICE = re.compile(
    r"cookie|©|all rights reserved|privacy|terms of use|rechte vorbehalten|datenschutz|impressum|droits réservés|confidentialité|mentions légales|(?:derechos|direitos) reservados|privacidade?|diritti riservati|rettigheter|personvern"
    r"|subscri|sign up|newsletter|share (?:this|on)|nyhetsbrev|abonn|partag|compart|condivid|artikel teilen|suscr|assine|κοινοποι|μοιραστείτε|εγγραφείτε|συνδρομή",
    re.I,
)
_SEPARATORS = re.compile(r" (?:›|»|>|\||·|/) ")


def key_of(line: str) -> str:
    """A line for aligning: without bullet, case, runs of blanks and digits."""
    s = " ".join(BULLET.sub("", line).lower().split())
    return re.sub(r"\d+", "0", s)


def template_of(key: str, words: int) -> str:
    """What lines of one slot have in common though they differ: the separators of a path or menu, the words before a colon; empty for other lines."""
    if words <= 30 and (marks := _SEPARATORS.findall(key)):
        return f"{marks[0].strip()}{min(len(marks), 2)}"
    head, colon, rest = key.partition(":")
    if colon and rest.strip() and words <= 25 and len(head.split()) <= 6 and _heading_like(rest + " x"):
        return head.rstrip() + ":"
    return ""


def _numbered(lines: list[str]) -> dict[tuple[str, int], int]:
    """Each line with the number of its repetition, to its place; empty ones are left out."""
    seen: dict[str, int] = {}
    places = {}
    for at, line in enumerate(lines):
        if line:
            n = seen[line] = seen.get(line, -1) + 1
            places[line, n] = at
    return places


def common_subsequence(a: dict[tuple[str, int], int], b: dict[tuple[str, int], int]) -> list[int]:
    """The places in ``a`` of a longest common subsequence of two numbered texts: the longest run of common lines whose places in ``b`` increase."""
    both = sorted((a[line], b[line]) for line in a.keys() & b.keys())
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for n, (_, place) in enumerate(both):
        k = bisect_left(tails, place)
        back.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(place)
            ends.append(n)
        else:
            tails[k], ends[k] = place, n
    found, n = [], ends[-1] if ends else -1
    while n >= 0:
        found.append(both[n][0])
        n = back[n]
    return found


def _heading_like(line: str) -> bool:
    s = line.rstrip()
    return s.rstrip(CLOSING)[-1:] not in END and s[-1:] not in "”»\"" and 2 <= len(s.split()) <= 20


def _mark(line: str) -> str:
    s = line.strip()
    return s[0] if s and not s[0].isalnum() else ""


class Page:
    """The non-empty lines of a text with what is asked of them again and again."""

    def __init__(self, key, host: str, text: str) -> None:
        self.key, self.host = key, host
        self.lines = [(n, line) for n, line in enumerate(text.split("\n"), 1) if line.strip()]
        self.words = [len(line.split()) for _, line in self.lines]
        self.keys = [key_of(line) for _, line in self.lines]
        self.templates = [template_of(key, n) for key, n in zip(self.keys, self.words)]
        self.placed, self.slots = _numbered(self.keys), _numbered(self.templates)
        self.long = {k for k, n in zip(self.keys, self.words) if n >= 2 * PARAGRAPH_WORDS}

    def copies(self, other: Page) -> bool:
        return bool(self.long) and len(self.long & other.long) * 4 >= len(self.long)

    def byline(self, at: int) -> bool:
        return self.words[at] <= 12 and BYLINE.match(self.keys[at]) is not None and "·" not in self.lines[at][1]

    def placeholder(self, at: int) -> bool:
        line = self.lines[at][1]
        s = BULLET.sub("", line).strip()
        if not s or EMPTY_VALUE.fullmatch(s):
            return True
        return bool(OPENERS.search(line) and (held := PLACEHOLDER.findall(line)) and len(WORD.findall(PLACEHOLDER.sub(" ", line))) <= len(held))


def surroundings(page: Page, neighbours: list[Page]) -> set[int]:
    """The numbers of the page's lines that are no part of its article."""
    count = len(page.lines)
    shared, alike = [0] * count, [0] * count
    for other in neighbours:
        for at in common_subsequence(page.placed, other.placed):
            shared[at] += 1
        for at in common_subsequence(page.slots, other.slots):
            alike[at] += 1
    unsure = len(neighbours) < FEW
    drop = [False] * count
    for at in range(count):
        if page.placeholder(at):
            drop[at] = True
        elif page.byline(at):
            continue
        elif shared[at]:
            # a paragraph that one or two neighbours share may be the article's: the words of notices break the tie
            drop[at] = page.words[at] < PARAGRAPH_WORDS or shared[at] >= min(PARAGRAPH_SHARED, len(neighbours)) or page.words[at] <= 45 and NOTICE.search(page.keys[at]) is not None
        elif alike[at] or page.templates[at] and LIST_HEADING.match(page.keys[at]):
            drop[at] = True
        elif unsure and page.words[at] <= 25:
            drop[at] = NOTICE.search(page.keys[at]) is not None or bool(page.templates[at]) and (page.templates[at][-1].isdigit() or LIST_HEADING.match(page.keys[at]) is not None)
    _menus(page, drop)
    _slots(page, drop, shared, unsure)
    return {n for (n, _), out in zip(page.lines, drop) if out}


def _menus(page: Page, drop: list[bool]) -> None:
    """Entries of a menu one below the other; one that no neighbour happens to share goes with the others of its run."""
    at = 0
    while at < len(page.lines):
        end = at
        while end < len(page.lines) and page.words[end] <= 3 and page.lines[end][1].rstrip()[-1:].isalpha() and not page.byline(end) and not page.keys[end][:1].isdigit():
            end += 1
        if end - at >= 4 and (2 * sum(drop[at:end]) >= end - at or not any(drop)):
            drop[at:end] = [True] * (end - at)
        at = max(end, at + 1)


def _slots(page: Page, drop: list[bool], shared: list[int], unsure: bool) -> None:
    """The lists under headings that neighbours share: lines in the way of headings, all with the same bullet or all without."""
    count = len(page.lines)
    for at in range(count):
        heading = unsure and LIST_HEADING.match(page.keys[at]) is not None
        if not (heading or shared[at] and drop[at]) or page.words[at] > 8 or page.lines[at][1].rstrip()[-1:] in ".”":
            continue
        ahead, last, bullet = [], at + 1, None
        while last < count:
            if page.placeholder(last):
                last += 1  # a stray placeholder within the list
                continue
            line = page.lines[last][1]
            if drop[last] or not _heading_like(line) or bullet not in (None, _mark(line)) or page.byline(last) or page.keys[last][:1].isdigit():
                break
            bullet = _mark(line)
            ahead.append(last)
            last += 1
        # without bullets the last line before a paragraph may be the article's own subhead, which is much shorter than the headlines
        if not bullet and len(ahead) >= 2 and last < count and not drop[last] and 2 * page.words[ahead[-1]] * (len(ahead) - 1) <= sum(page.words[k] for k in ahead[:-1]):
            ahead.pop()
        if len(ahead) >= 2 or ahead and (bullet or heading):
            drop[at] = True
            for k in ahead:
                drop[k] = True
        elif heading and page.words[at] <= 5:
            drop[at] = True


def _path_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _difference(side: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ahead: deque[Page] = deque()
        behind: list[Page] = []  # the last pages of the host, no two of them copies

        def judged() -> tuple | None:
            page = ahead.popleft()
            if behind and behind[-1].host != page.host:
                behind.clear()
            after: list[Page] = []
            for other in ahead:
                if other.host != page.host or len(after) == side:
                    break
                if not page.copies(other) and not any(p.copies(other) for p in after):
                    after.append(other)
            numbers = surroundings(page, [p for p in behind if not page.copies(p)][-side:] + after)
            behind[:] = [p for p in behind if not p.copies(page)][-side:] + [page]
            return (page.key, sorted(numbers)) if numbers else None

        for batch in batches:
            out = []
            for key, host, text in zip(batch["key"], batch["host"], batch["text"]):
                if is_leftover(text):
                    continue
                ahead.append(Page(key, host, text))
                if len(ahead) > AHEAD:
                    out.append(judged())
            yield pd.DataFrame([x for x in out if x], columns=["key", "lines"])
        rest = [judged() for _ in range(len(ahead))]
        yield pd.DataFrame([x for x in rest if x], columns=["key", "lines"])

    return run


def _judged(pages: DataFrame, id_col: str, text_col: str, url_col: str, side: int) -> DataFrame:
    boxed = pages.select(F.col(id_col).alias("key"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.coalesce(_path_of(F.col(url_col)), F.lit("")).alias("path"), F.col(text_col).alias("text")).where("length(text) > 0")
    ordered = boxed.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key").select("key", "host", "text")
    kind = boxed.schema["key"].dataType.simpleString()
    return ordered.mapInPandas(_difference(side), f"key {kind}, lines array<int>")


def boilerplate_lines(pages: DataFrame, id_col: str = "id", text_col: str = "text", url_col: str = "url", side: int = SIDE) -> DataFrame:
    """``id_col, line_no`` of the non-empty lines that are no part of the page's article.

    Leftovers of a publishing system, null and empty texts have none. Pages without url are neighbours of one another.
    """
    return _judged(pages, id_col, text_col, url_col, side).select(F.col("key").alias(id_col), F.explode("lines").alias("line_no"))


def main_text(pages: DataFrame, id_col: str = "id", text_col: str = "text", url_col: str = "url", side: int = SIDE) -> DataFrame:
    """``id_col, text_col`` of each row, the text without its boilerplate lines; ``id_col`` must be unique. Other texts stay as they are."""
    drop = _judged(pages, id_col, text_col, url_col, side)
    texts = pages.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(drop, "key", "left")
    kept = F.filter(F.split("text", "\n"), lambda line, at: ~F.array_contains("lines", at + 1))
    return texts.select(F.col("key").alias(id_col), F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias(text_col))
