"""Column expressions that read a publication time in any of the usual notations.

Everything stays in built-in expressions: the string is matched against a few anchored patterns,
which give local calendar fields and, if there is one, a zone; the instant follows by arithmetic and
``to_utc_timestamp``, whose rules for repeated and skipped local times (the earlier instant; moved on
by the length of the gap) are the wanted ones. The result does not depend on the session's time zone.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and usual short forms, in English, Norwegian/Danish, German, French, Spanish, Portuguese, Italian and Greek.
MONTHS = {
    1: "january jan januar janvier janv enero ene janeiro gennaio gen jänner ιανουαρίου ιανουάριος ιαν",
    2: "february feb februar februari février fevrier févr febrero fevereiro fev febbraio φεβρουαρίου φεβρουάριος φεβ",
    3: "march mar mars märz maerz mär mrz marzo março marco μαρτίου μάρτιος μαρ",
    4: "april apr avril avr abril abr aprile απριλίου απρίλιος απρ",
    5: "may mai maj mayo maio mag maggio μαΐου μαίου μάιος μαϊ μαι",
    6: "june jun juni juin junio junho giugno giu ιουνίου ιούνιος ιουν",
    7: "july jul juli juillet juil julio julho luglio lug ιουλίου ιούλιος ιουλ",
    8: "august aug août aout agosto ago αυγούστου αύγουστος αυγ",
    9: "september sep sept septembre septiembre setiembre set setembro settembre σεπτεμβρίου σεπτέμβριος σεπ",
    10: "october oct oktober okt octobre octubre outubro out ottobre ott οκτωβρίου οκτώβριος οκτ",
    11: "november nov novembre noviembre novembro νοεμβρίου νοέμβριος νοε",
    12: "december dec desember des dezember dez décembre decembre déc diciembre dic dezembro dicembre δεκεμβρίου δεκέμβριος δεκ",
}

# Zone letters in their European or North American meaning, as minutes east of UTC.
ZONE_MINUTES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "ist": 60, "cet": 60, "met": 60, "mez": 60,
    "cest": 120, "mest": 120, "mesz": 120, "eet": 120, "eest": 180, "msk": 180, "trt": 180,
    "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "hdt": -540,
}

_ZONE = r"(?:\s*(z|[+-]\d{2}(?::?\d{2})?)(?:\[[\w/+-]+\])?|\s+([a-z]{2,5})|\s+([a-z]+/[a-z_/+-]+))?"
_CLOCK = r"(\d{1,2})[:.h](\d{2})(?:[:.](\d{2})(?:[.,]\d+)?)?"
_WORD = r"[\p{L}]+"
_HALF = r"\s*([ap])?\.?(?:m\.?)?"

# Anchored patterns and what a match is rewritten to: kind, year, month, day, hour, minute, second, half of day, offset, letters, region.
# A rewritten value starts with a capital, which no lower-cased value does, so at most one pattern applies.
_NOTATIONS = (
    (r"^(\d{10})(?:\d{3}|\d{6}|\d{9}|\.\d+)?$", "E|$1"),
    (rf"^(\d{{4}})([-/.])(\d{{1,2}})(?:\2(\d{{1,2}})(?:[t ]+{_CLOCK}{_ZONE})?)?$", "I|$1|$3|$4|$5|$6|$7||$8|$9|$10"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:t(\d{{2}})(\d{{2}})(\d{{2}})?{_ZONE})?$", "I|$1|$2|$3|$4|$5|$6||$7|$8|$9"),
    (rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:,?\s+{_CLOCK}{_HALF}{_ZONE})?$", "N$2|$4|$3|$1|$5|$6|$7|$8|$9|$10|$11"),
    (rf"^(?:{_WORD}\.?,?\s+|{_WORD}(?:\s+{_WORD})?:?\s+)?(\d{{1,2}})(?:\.|º|st|nd|rd|th)?[\s-]+(?:de\s+)?({_WORD})\.?[\s,-]+(?:de\s+)?(\d{{4}})(?:,?\s+(?:{_WORD}\.?\s+)?{_CLOCK}\s*(?:uhr)?{_ZONE})?$", "I|$3|$2|$1|$4|$5|$6||$7|$8|$9"),
    (rf"^(?:{_WORD}\.?,?\s+)?({_WORD})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:,?\s+(?:at\s+)?{_CLOCK}{_HALF}{_ZONE})?$", "I|$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    (rf"^({_WORD})\.?\s+(?:de\s+)?(\d{{4}})$", "I|$2|$1"),
)
FIELDS = ("epoch", "y", "mo", "d", "h", "mi", "s", "offset", "letters", "region")


def zone_names() -> list[str]:
    """The names of places that the time zone database knows; others would end the job."""
    return sorted(z for z in zoneinfo.available_timezones() if "/" in z or z in ("UTC", "GMT"))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _lookup(words: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in words.items() for x in pair])


def _month(word: Column) -> Column:
    return F.coalesce(word.try_cast("int"), _lookup({w: n for n, ws in MONTHS.items() for w in ws.split()})[word])


def parsed(value: Column, date_order: Column) -> Column:
    """The calendar fields of ``value`` as a struct of FIELDS, or null where it has no known notation.

    ``epoch`` is set for counts of seconds, milli- or microseconds; else ``y mo d h mi s`` are local
    fields (first instants for parts left out) and ``offset``, ``letters`` or ``region`` the value's own
    zone, empty where it has none. ``date_order`` (``dmy`` or ``mdy``) decides about numeric dates; where it
    is null, a date with a.m./p.m. and slashes is read month first and any other day first, unless only
    the other order is possible.
    """
    text = F.lower(F.regexp_replace(F.trim(value), r"[\s\u00a0]+", " "))
    for pattern, rewritten in _NOTATIONS:
        text = F.regexp_replace(text, pattern, rewritten)

    def fields(f: Column) -> Column:
        kind = F.get(f, F.lit(0))
        at = lambda i: F.coalesce(F.get(f, F.lit(i)), F.lit(""))
        number = lambda i, least: F.coalesce(at(i).try_cast("int"), F.lit(least))
        a, b = at(3).try_cast("int"), at(2).try_cast("int")
        numeric = kind.startswith("N")
        guess = F.when(a > 12, False).when(b > 12, True).otherwise((kind == "N/") & (at(7) != ""))
        american = numeric & F.coalesce(date_order == "mdy", guess)
        year = at(1).try_cast("int")
        hour = number(4, 0)
        hour = F.when((at(7) != "") & ~hour.between(1, 12), 99).when(at(7) == "a", hour % 12).when(at(7) == "p", hour % 12 + 12).otherwise(hour)
        first = F.when(at(3) == "", 1).otherwise(a)
        named = (
            F.when(kind == "E", at(1)).try_cast("long"), F.when(F.length(at(1)) > 2, year).when(year < 70, year + 2000).otherwise(year + 1900),
            F.when(american, a).otherwise(_month(at(2))), F.when(american, b).otherwise(first), hour, number(5, 0), number(6, 0), at(8), at(9), at(10),
        )
        return F.when(kind.rlike("^[A-Z]"), F.struct(*[c.alias(n) for n, c in zip(FIELDS, named, strict=True)]))

    return let(F.split(text, r"\|"), fields)


def local_seconds(p: Column) -> Column:
    """Seconds from 1970-01-01 00:00 to the local fields of ``parsed``; null where they name no real date or time."""
    first = F.when(p["y"].between(1, 9999) & p["mo"].between(1, 12), F.make_date(p["y"], p["mo"], F.lit(1)))
    real = p["d"].between(1, F.dayofmonth(F.last_day(first))) & p["h"].between(0, 23) & p["mi"].between(0, 59) & p["s"].between(0, 59)
    return F.when(real, (F.unix_date(first) + p["d"] - 1).cast("long") * 86400 + p["h"] * 3600 + p["mi"] * 60 + p["s"])


def own_offset_minutes(p: Column) -> Column:
    """Minutes east of UTC that the value itself gives, or null; unknown letters give null."""
    digits = F.regexp_replace(p["offset"], ":", "")
    size = F.substring(digits, 2, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 4, 2).try_cast("int"), F.lit(0))
    known = _lookup(ZONE_MINUTES)[F.when(p["offset"] == "z", F.lit("z")).otherwise(p["letters"])]
    return F.when(p["offset"].rlike("^[+-]"), F.when(p["offset"].startswith("-"), -size).otherwise(size)).otherwise(known)


def epoch_seconds(parsed_value: Column, zone: Column) -> Column:
    """The instant of ``parsed`` in whole seconds since 1970 UTC; ``zone`` (an IANA name) is used where the value has none.

    Null where the value names no time, an impossible one, unknown zone letters or an unknown zone.
    """

    def instant(p: Column) -> Column:
        local, minutes = local_seconds(p), own_offset_minutes(p)
        region = F.array_join(F.transform(F.split(p["region"], "/"), lambda part: F.array_join(F.transform(F.split(part, "_"), F.initcap), "_")), "/")
        given = F.when(p["region"] != "", region).otherwise(F.coalesce(zone, F.lit("UTC")))
        where = F.when(given.isin(zone_names()), given)
        by_zone = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), where))
        return F.when(p["epoch"].isNotNull(), p["epoch"]).when(minutes.isNotNull(), local - minutes * 60).when(p["letters"] == "", by_zone)

    return let(parsed_value, instant)
