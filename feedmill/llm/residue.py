"""Problem 1: leftovers of a publishing system in place of an article.

Each line is read by a grammar for every kind of placeholder delimiter, by patterns for empty values,
server and script notices and filler, and else as prose or as page furniture. A text is a leftover if
its residue outweighs its prose: an article that mentions a placeholder, quotes an error page or shows
code has more prose than that, a leftover with menus and notices around it has none.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One alternative for each kind of delimiter.
PLACEHOLDER = re.compile(
    r"\{%.*?%\}|\{\{.*?\}\}|<%.*?%>|<\?php.*?\?>|\$\{[^}\n]*\}|\[\[[^\]\n]*\]\]|<<[^>\n]*>>|\*\|[^|\n]*\|\*|%%\w+%%|%[A-Za-z_]+%|\$[A-Za-z_]+\$|#[A-Za-z_]+#|__\w+?__"
    r"|\[caption[^\]]*\]|<!--.*?-->|\{[A-Za-z_][\w.]*\}|\[(?:insert |your )[^\]\n]*\]|\[[A-Z][A-Z_ ]+\]|\[[a-z]+(?:_[a-z]+)*\]",
    re.I,
)
OPENERS = re.compile(r"[{\[<%$#_*]")
EMPTY_VALUE = re.compile(r"(?:[\w ]+:\s*)?(?:null|undefined|nan|none|n/a|\[object object\]|tk|tktk|tbd|xx\.xx)\.?", re.I)
# Lines that technology writes: status lines, traces, ids, reload marks.
TECHNICAL = re.compile(
    r"(?:http[ /]?[\d. ]*)?[345]\d\d\b(?: [a-z -]{3,30})?|(?:error|oops|noscript|reload|↻|loading|retry)\W*|traceback \(most recent call last\):?|\s*file \"[^\"]+\", line \d+.*|\w*(?:error|exception): .*"
    r"|at [\w.$]+\(.*\)|\{\s*\"[^{}]*\}|(?:incident|request id|ray|trace|reference|error id|ref)\W{1,3}[\w-]+|(?:warning|fatal error|notice): .* on line \d+|fatal: .*|(?:<[/?!]?\w[^<>]*>[^<>]{0,80}){2,}",
    re.I,
)
# Parts of notices, filler and page furniture; looked for in lower case behind a blank.
NOTICE = tuple(
    "javascript|java script|page not found|could not find what you|access denied|permission to view|permission to access|too many requests|took too long|gateway timeout|went wrong"
    "|internal error|internal server error|connect to database|session has expired|not available in your|checking your connection|you are human|error 4|error 5"
    "|siden finnes ikke|ikke tilgang|noe gikk galt"
    "|seite nicht gefunden|zugriff verweigert|fehler aufgetreten"
    "|page introuvable|accès refusé|erreur interne"
    "|no encontrada|acceso denegado|algo ha fallado|se ha producido un error"
    "|não encontrada|acesso negado|erro interno"
    "|non trovata|accesso negato|errore interno"
    "|δεν βρέθηκε|σφάλμα|δεν έχετε πρόσβαση".split("|")
)
# Words that also stand in articles; a notice has a word of the web beside them.
STATES = tuple(" script| skript|unavailable|maintenance|wartung|vedlikehold|svarer ikke|indisponible|no disponible|indisponível|non disponibile|nicht verfügbar|ikke tilgjengelig|δεν είναι διαθέσιμη|mantenimiento|manutenção|manutenzione".split("|"))
WEB = re.compile(r"\b(?:web\w*|sites?|pages?|server\w*|services?|browser\w*|requests?|reload|seite|dienst|siden|nettside\w*|nettleser\w*|tjenesten|navigateur|navegador|página|servicio|serviço|servidor|pagina|servizio|sito|sitio|σελίδα|υπηρεσία|content|enable|turn on|allow|activate|aktivieren|activez|active|ative|attiva|slå på)\b")
NUMBERED = re.compile(r"(?:error|feil|fehler|erreur|erro|errore|http|status|σφάλμα) \d")
NUMBERED_WORDS = ("error ", "feil ", "fehler ", "erreur ", "erro ", "errore ", "http ", "status ", "σφάλμα ")
FILLER = tuple(
    "headline goes here|body copy|text goes here|title goes here|story goes here|text to follow|insert your|insert story|insert headline|insert title|sample paragraph|sample text|dummy text|test article|placeholder text"
    "|her kommer brødteksten|her kommer teksten|her kommer tittelen|prøvetekst|sett inn tittel|fylltekst|hier steht später|blindtext|platzhalter|hier einfügen|hier kommt der text"
    "|texte provisoire|viendra ici|insérer le titre|va el texto|escriba aquí|texto de relleno|texto de prueba|entra aqui|texto provisório|inserir o título|va il testo|testo provvisorio|inserire il titolo|testo di prova"
    "|θα μπει το|δοκιμαστικό κείμενο|γράψτε εδώ|κείμενο δοκιμής".split("|")
)
FURNITURE = tuple(
    "cookie|small files|små filer|kleine dateien|petits fichiers|archivos pequeños|pequeños archivos|pequenos ficheiros|piccoli file|μικρά αρχεία|©|all rights reserved|rettigheter|rechte vorbehalten|droits réservés|derechos reservados|direitos reservados|diritti riservati"
    "|registered office|company number|not liable|press code|terms of use|privacy|personvern|datenschutz|confidentialité|privacidad|privacidade|responsab|responsáv|haftet nicht|ansvarlig|impressum|mentions légales|redaktør|redaktion"
    "|subscribe|abonn|suscr|assine|sign up|newsletter|nyhetsbrev|share this|del saken|partager|compart|condividi|teilen|tell a friend|pass it on|free account|read also|see also|more on this|se også|les også|lesen sie auch|à lire|lire aussi|voir aussi|lea también|leia também|leggi anche|download our app".split("|")
)
# Frequent function words of the eight languages; prose has some in every line.
FUNCTION_WORDS = frozenset(
    "the a an of in to and on for with which they that is was has have not but by its from so or as it this will at "
    "og i på det en et som til med av for ikke den har at ved vi men om før etter mot de nord "
    "der die das und in den zu von für auf ist mit ein eine dem des nicht bei es nach im aber so dass an "
    "le la les de et un une du des à au est pour dans qui sur pas par en mais ce se "
    "el los las y con para que del al por se su no una pero más lo "
    "o os as do da e em um uma ao não na com dos das mas se no "
    "il lo gli di per della con ha alla non al ma si un una "
    "και το η ο του της με στη στο για τα των ένα μια από σε την τον να θα".split()
)
# Words of dummy text.
DUMMY_WORDS = frozenset(
    "lorem ipsum dolor amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure "
    "reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa officia deserunt mollit anim laborum".split()
)
BULLET = re.compile(r"^[\s•»›>*\-–—·#]+")
END = ".!?…;:"
CLOSING = "\"”’»)] \t\r"
SENTENCE = re.compile(r"(?<=[.!?…;:])\s+")
WORD = re.compile(r"[^\W\d_]+")
FENCE = ("```", "~~~", "<code", "</code", "<pre", "</pre")


def _any(parts: tuple[str, ...], low: str) -> bool:
    for part in parts:
        if part in low:
            return True
    return False


def _notice(s: str, low: str) -> bool:
    return s[0] not in "“\"«„" and (_any(NOTICE, low) or _any(FILLER, low) or NUMBERED.match(low, 1) is not None or _any(STATES, low) and WEB.search(low) is not None)


def _notices(s: str, low: str) -> bool:
    """Whether a line is a notice or filler: a long one if the sentences that are make up half of its words."""
    if len(s.split()) <= 25:
        return _notice(s, low)
    if not (_any(NOTICE, low) or _any(FILLER, low) or _any(NUMBERED_WORDS, low) or _any(STATES, low)):
        return False
    told = sum(len(x.split()) for x in SENTENCE.split(s) if x and _notice(x, " " + x.lower()))
    return 2 * told >= len(s.split())


def _dummy(lower: list[str], ended: bool = False) -> bool:
    """Dummy text: half of the words are those of the usual one, or a whole sentence has hardly any function word, which in prose make up a quarter."""
    if len(lower) < 4:
        return False
    if 2 * sum(w in DUMMY_WORDS for w in lower) >= len(lower):
        return True
    return ended and len(lower) >= 8 and 10 * sum(w in FUNCTION_WORDS for w in lower) < len(lower)


def weigh(text: str) -> tuple[int, int]:
    """(words of residue, words of prose) of a text, as far as they decide. Lines of fenced code count as neither."""
    residue = prose = 0
    fenced = False
    most = len(text.split()) // 2
    # lines are only asked for parts that the text has at all
    flat = " " + text.lower().replace("\n", " ")
    told = _any(NOTICE, flat) or _any(FILLER, flat) or _any(STATES, flat) or _any(NUMBERED_WORDS, flat)
    furnished = _any(FURNITURE, flat)
    for line in text.split("\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        opened = OPENERS.search(line) is not None
        ended = line.rstrip(CLOSING)[-1:] in END
        if n > 25 and not opened and not fenced and ended:
            s = line.strip()
            low = " " + s.lower()
            # prose has a function word in four; only a line with few of them is looked at word by word
            small = sum(map(FUNCTION_WORDS.__contains__, low.split()))
            if 6 * small < n and _dummy(WORD.findall(low), True) or told and _notices(s, low):
                residue += n
                continue
            prose += n
            if prose > most:  # the rest can't outweigh it
                break
            continue
        if words[0].startswith(FENCE):
            fenced = not fenced
            continue
        s = line.strip() if line[0].isalnum() else BULLET.sub("", line).strip()
        if fenced:
            continue
        if opened:
            held = PLACEHOLDER.findall(line)
            if held:
                rest = len(WORD.findall(PLACEHOLDER.sub(" ", line)))
                # density: a mention stands among many more words
                if len(held) * 4 >= rest:
                    residue += len(held) + rest
                    continue
        if not s:
            residue += line.strip() == "↻"
            continue
        low = " " + s.lower()
        lower = WORD.findall(low)
        if n <= 30 and (EMPTY_VALUE.fullmatch(s) or TECHNICAL.fullmatch(s)):
            residue += n
        elif len(lower) >= 4 and len(set(lower)) <= max(2, len(lower) // 8) or _dummy(lower, ended):
            residue += n
        elif told and _notices(s, low):
            residue += n
        elif n >= 5 and ended and not FUNCTION_WORDS.isdisjoint(lower) and not (furnished and _any(FURNITURE, low)):
            prose += n
    return residue, prose


def is_leftover(text: str | None) -> bool:
    """Whether residue outweighs prose; null, empty and blank texts are no leftovers."""
    if not text:
        return False
    residue, prose = weigh(text)
    return residue > 0 and residue > prose


def leftover(text: Column) -> Column:
    """``is_leftover`` as a column, by Arrow batches."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(is_leftover).astype(bool)

    return run(text)


def find_leftovers(items: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id_col`` of each row whose text is a leftover, whatever its state says; repeated rows stay repeated."""
    return items.select(id_col, text_col).where(leftover(F.col(text_col))).select(id_col)


def keep_articles(items: DataFrame, text_col: str = "text") -> DataFrame:
    """``items`` without the leftovers; all else, null and empty texts too, stays."""
    return items.where(~leftover(F.col(text_col)))
