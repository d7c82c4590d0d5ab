"""Vocabularies as data: facets with terms and their aliases, known organisations, words that tell a subject."""

from __future__ import annotations

import glob
import os
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedmill.functions import text as X
from feedmill.operators import feed

# Hosts that sell market reports or carry unedited releases, and hosts that are linked to but not read.
FARM_HOSTS = (
    "gminsights.com", "grandviewresearch.com", "coherentmarketinsights.com", "indexbox.io", "marketsandmarkets.com", "mordorintelligence.com", "fortunebusinessinsights.com",
    "alliedmarketresearch.com", "researchandmarkets.com", "marketresearchfuture.com", "imarcgroup.com", "precedenceresearch.com", "futuremarketinsights.com", "openpr.com",
    "einpresswire.com", "globenewswire.com", "prnewswire.com", "marketwatch.com", "benzinga.com", "digitaljournal.com",
)
LINK_ONLY_HOSTS = ("linkedin.com", "facebook.com", "instagram.com", "x.com", "twitter.com", "researchgate.net", "academia.edu")
# What titles of market reports say.
MARKET_SPAM = r"market\s+(?:size|share|trends?|forecast|outlook|analysis|report|research)|\bcagr\b|market.{0,30}\b20\d\d\s*[-–to]{1,3}\s*20\d\d|\bindustry\s+(?:report|outlook)\b"


@dataclass(frozen=True)
class Pack:
    """facets: id to (request key, whether primary, terms to aliases). orgs: id to (whether naming it tells the subject, aliases)."""

    name: str
    facets: dict[str, tuple[str, bool, dict[str, tuple[str, ...]]]] = field(default_factory=dict)
    orgs: dict[str, tuple[bool, tuple[str, ...]]] = field(default_factory=dict)
    strong: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()
    accept_all: bool = True

    @classmethod
    def read(cls, toml: str, name: str = "pack") -> Pack:
        """From TOML: ``[facets.ID]`` with key, primary and terms, ``[organisations]`` with terms, exclusive_ids and exclusive_groups, ``[relevance]`` with strong, weak and accept_all."""
        raw = tomllib.loads(toml)
        as_terms = lambda found: {t["id"]: t for t in found or ()} if isinstance(found, list | tuple | type(None)) else {k: {"id": k, **v} if isinstance(v, dict) else {"id": k, "aliases": v} for k, v in found.items()}
        facets = {f: (spec.get("key", f), bool(spec.get("primary", False)), {t: tuple(v.get("aliases", ())) for t, v in as_terms(spec.get("terms")).items()}) for f, spec in (raw.get("facets") or {}).items()}
        known = raw.get("organisations") or {}
        ids, groups = set(known.get("exclusive_ids", ())), set(known.get("exclusive_groups", ()))
        orgs = {o: (o in ids or v.get("group") in groups, tuple(v.get("aliases", ()))) for o, v in as_terms(known.get("terms")).items()}
        told = raw.get("relevance") or {}
        return cls(raw.get("name", name), facets, orgs, tuple(told.get("strong", ())), tuple(told.get("weak", ())), bool(told.get("accept_all", not told.get("strong"))))

    def terms(self) -> tuple[tuple[str, str, tuple[str, ...]], ...]:
        """facet, term, aliases, as :func:`feed.tag` takes them."""
        return tuple((f, t, names) for f, (_, _, terms) in self.facets.items() for t, names in terms.items() if names)

    @property
    def keys(self) -> dict[str, str]:
        """Request key to facet."""
        return {key: f for f, (key, _, _) in self.facets.items()}

    def relevant(self, text: Column) -> Column:
        """Whether a text belongs to the subject: a strong word, an organisation that does nothing else, two terms of primary facets, or one with a weak word. Null and empty texts don't."""
        if self.accept_all:
            return F.lit(True)
        named = lambda words: F.coalesce(X.any_phrase(text, words), F.lit(False))
        primary = [names for _, first, terms in self.facets.values() if first for names in terms.values() if names]
        hits = F.lit(0)
        for names in primary:
            hits = hits + named(names).cast("int")
        exclusive = [a for alone, names in self.orgs.values() if alone for a in names]
        return named(self.strong) | named(exclusive) | (hits > 1) | (hits == 1) & named(self.weak)


def read_packs(folder: str) -> dict[str, Pack]:
    """The packs of a folder's TOML files by name; broken files are left out."""
    found = {}
    for path in sorted(glob.glob(f"{folder}/*.toml")):
        try:
            with open(path, encoding="utf-8") as f:
                pack = Pack.read(f.read(), os.path.basename(path)[:-5])
        except (tomllib.TOMLDecodeError, AttributeError, TypeError, KeyError):
            continue
        found[pack.name] = pack
    return found


def check_facets(asked: dict[str, list[str]], pack: Pack) -> dict:
    """``keys`` that the pack doesn't have, ``values`` by key that it doesn't have, and ``known_keys``; ``entities`` is always known, whatever its values."""
    known = {key: set(pack.facets[f][2]) for key, f in pack.keys.items()}
    return {
        "keys": sorted(k for k in asked if k not in known and k != "entities"),
        "values": {k: bad for k, vs in asked.items() if k in known and (bad := [v for v in vs if v not in known[k]])},
        "known_keys": sorted(known),
    }


def facet_notices(asked: dict[str, list[str]], pack: Pack) -> list[str]:
    """A sentence for each part of a filter that can't be applied."""
    bad = check_facets(asked, pack)
    told = [f"No facet {', '.join(bad['keys'])} here, so that part of the filter was left out. Facets: {', '.join(bad['known_keys'])}."] if bad["keys"] else []
    return told + [f"{k} has no value {', '.join(vs)} here, so that part matched nothing." for k, vs in bad["values"].items()]


def tags_of(docs: DataFrame, pack: Pack, **columns: str) -> DataFrame:
    return feed.tag(docs, pack.terms(), **columns)


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)


def content_farm(url: Column) -> Column:
    """Whether an address names a host that sells reports or carries unedited releases."""
    return F.coalesce(F.exists(F.array(*map(F.lit, FARM_HOSTS)), lambda h: F.contains(F.lower(url), h)), F.lit(False))


def market_spam(title: Column, url: Column) -> Column:
    return F.concat_ws(" ", title, url).rlike(f"(?i){MARKET_SPAM}")


def link_only(url: Column) -> Column:
    """Whether an address is of a host, or of one below it, that is linked to but not read."""
    host = host_of(url)
    return F.coalesce(F.exists(F.array(*map(F.lit, LINK_ONLY_HOSTS)), lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h))), F.lit(False))
