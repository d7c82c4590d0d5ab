"""Problem 7: names typed in many ways, grouped, and linked to the known entries they mean.

Spellings are reduced to forms (distinct, so each is worked on once). Forms and entries are nodes; each has a
few looks (a form as typed and with its short words written out; an entry by its initials, without its trade word, with a pet name or
an initial), and a look is a weighted vector of character 3-grams. A sparse join on the grams gives all pairs of a form and an entry with a
cosine of EDGE or more, and of two forms with FORM_EDGE or more: of each vector only those grams are joined, the rarest, that a
partner so similar can't do without, so that no pair is lost and no count of partners is set. Average-linkage clustering then
merges the nodes from the most similar down to LEVELS' last; clusters with different entries never merge, and a cluster that two
entries attract about equally waits. So a form means the entry of its cluster, and what is in no entry's cluster forms groups of
unknown names. An exact check by tokens follows (typing errors, abbreviations, initials, nicknames, order,
missing trade words): it removes names that only resemble the entry. What two entries attract alike is linked to
the one that the same item names otherwise, if any.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedmill.session import materialise

#: The least cosine of a form and an entry, and of two forms, that counts, the levels of average linkage, and the lead that the nearer of two entries needs.
EDGE, FORM_EDGE = 0.3, 0.5
LEVELS = (0.9, 0.75, 0.6, 0.45, 0.3, 0.2, 0.1)
CLEAR = 0.02

# Words that add nothing to a name, shortened words and pet names.
LEGAL = frozenset("plc inc incorporated ltd limited llc lp ag as asa ab bv nv gmbh kg oy oyj sa sas srl spa ae aps co corp corporation company holding holdings group".split())
TITLES = frozenset("dr prof professor mr mrs ms miss mx sir madam dame".split())
SMALL = frozenset("the of for and und og et".split())
SHORT = {
    "natl": "national", "nat": "national", "inst": "institute", "res": "research", "fed": "federal", "dept": "department", "dep": "department", "stds": "standards", "std": "standards", "intl": "international", "int": "international",
    "assoc": "association", "assn": "association", "univ": "university", "ctr": "centre", "center": "centre", "cent": "centre", "sci": "science", "lab": "laboratory", "labs": "laboratory", "eur": "european", "stud": "studies", "council": "council", "cncl": "council",
    "pharmaceuticals": "pharma", "shpg": "shipping", "sw": "software", "ins": "insurance", "fin": "finance", "log": "logistics", "semi": "semiconductors", "semis": "semiconductors", "semicon": "semiconductors", "bio": "biotech", "mat": "materials", "mats": "materials", "tex": "textiles", "min": "minerals", "rob": "robotics", "opt": "optics", "air": "airways", "tmbr": "timber", "engy": "energy", "nrg": "energy",
}
PET = {
    "alexander": "alex alec sandy sasha", "andreas": "andy andi", "benjamin": "ben benny benji", "charlotte": "lottie lotte charlie", "christopher": "chris kit topher", "elizabeth": "liz beth lizzie eliza betty lisa libby", "francisco": "paco fran pancho", "frederik": "fred freddie",
    "gabriela": "gabi gaby", "giuseppe": "beppe peppe pino", "johannes": "hannes jo johan", "josephine": "josie jo", "katherine": "kate kathy katie kit", "leonardo": "leo", "magdalena": "lena magda", "margaret": "maggie meg peggy", "michael": "mike mick micky",
    "nikolaos": "nikos niko nick", "rebecca": "becky becca", "robert": "bob rob bobby bert", "susanna": "sue susie sanna suzy", "theodore": "ted theo teddy", "thomas": "tom tommy", "victoria": "vicky vicki vic tori", "william": "bill will billy willy liam",
}
_FOLDED = str.maketrans({"ø": "o", "å": "a", "æ": "ae", "ß": "ss", "ð": "d", "þ": "th", "ł": "l", "đ": "d", "œ": "oe"})


def form_of(name: str) -> str:
    """The tokens of a name in one notation, in their order, without titles, legal forms and small words; empty where none is left."""
    s = unicodedata.normalize("NFKC", name).lower().replace("_", " ").strip()
    s = unicodedata.normalize("NFD", s.translate(_FOLDED))
    s = "".join(c for c in s if not unicodedata.combining(c))
    s = re.sub(r"['’`]s\b", "", s)
    s = re.sub(r"(?<=\w)['’`](?=\w)", "", s)
    s = re.sub(r"\bs\.? ?p\.? ?a\b\.?", " spa ", s)
    s = re.sub(r"\bmr/ms\b", " ", s)
    tokens = [t for t in re.split(r"[^\w]+", s) if t]
    if len(tokens) > 2 and all(len(t) == 1 for t in tokens):
        return "".join(tokens)
    kept = [t for t in tokens if t not in SMALL and t not in TITLES]
    while len(kept) > 1 and kept[-1] in LEGAL:
        kept.pop()
    return " ".join(kept)


def edits(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between two words; ``most`` + 1 stands for any more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def token_cost(typed: str, known: str, given: bool) -> float | None:
    """What it costs to read ``typed`` as ``known``, none where it can't be; ``given``: it is a person's first name."""
    if typed == known:
        return 0.0
    if given and (len(typed) == 1 and known.startswith(typed) or typed in PET.get(known, "").split()):
        return 0.3
    if SHORT.get(typed) == known:
        return 0.2
    if not given and len(known) >= 5 and typed.startswith(known):
        return 0.3
    if not given and 2 <= len(typed) <= len(known) - 2 and typed[0] == known[0] and len(known) >= 6:
        rest = iter(known)
        if known.startswith(typed) and len(typed) >= 3 or len(typed) <= 5 and all(c in rest for c in typed) and typed[-1] == known[-1]:
            return 0.4
    if min(len(typed), len(known)) >= 4 and (n := edits(typed, known, 2)) <= (2 if len(known) >= 9 else 1):
        return float(n)
    if given:
        for pet in PET.get(known, "").split():
            if min(len(typed), len(pet)) >= 4 and edits(typed, pet, 1) <= 1:
                return 1.3
    return None


def reading_cost(form: str, known: str, person: bool) -> float | None:
    """What it costs to read the form as the known form, none where it can't be."""
    f, o = form.split(), known.split()
    if not f or not o:
        return None
    if f == o or sorted(f) == sorted(o):
        return 0.0
    initials = "".join(t[0] for t in o)
    if len(f) == 1 and len(o) >= 3 and f[0] == initials:
        return 0.5
    joined = edits("".join(f), "".join(o), 1)
    if joined <= 1 and min(len(form), len(known)) >= 8:
        return 0.1 + joined
    free = list(range(len(o)))
    cost = 0.0
    for t in sorted(f, key=len, reverse=True):
        best = None
        for k in free:
            if (c := token_cost(t, o[k], person and k == 0)) is not None and (best is None or c < best[0]):
                best = (c, k)
        if best is None:
            # an initial between a person's names says little
            if person and len(t) == 1 and len(f) > 2:
                cost += 0.1
                continue
            return None
        cost += best[0]
        free.remove(best[1])
    for k in free:
        if person and len(o[k]) == 1:
            cost += 0.05
        elif not person and k == len(o) - 1 and len(o) in (2, 3) and len(f) == len(o) - 1:
            cost += 0.6  # the trade word is left out
        else:
            return None
    return cost if cost <= 2.3 else None


def _grams(form: Column) -> Column:
    words = F.transform(F.split(form, " "), lambda w: F.concat(F.lit("^"), w, F.lit("$")))
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substring(w, i, F.lit(3)))
    return F.flatten(F.transform(words, cut))


def _vectors(looks: DataFrame) -> DataFrame:
    """``look, gram, w``: unit vectors of the looks' grams (``look, form``), weighted by how few looks have them."""
    counted = materialise(looks.select("look", F.explode(_grams(F.col("form"))).alias("gram")).groupBy("look", "gram").agg(F.count("*").alias("tf")))
    total = looks.count()
    idf = counted.groupBy("gram").agg((F.log(F.lit(1.0 + total)) - F.log(F.count("*") + 0.5)).alias("idf"))
    weighted = counted.join(idf, "gram").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy("look").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, "look").select("look", "gram", (F.col("w") / F.col("norm")).alias("w"))


@F.pandas_udf(T.DoubleType())
def _dots(l_ids: pd.Series, l_ws: pd.Series, r_ids: pd.Series, r_ws: pd.Series) -> pd.Series:
    """The products of sparse vectors, given as sorted numbers of grams and their weights; all rows of a batch at once."""
    if not len(l_ids):
        return pd.Series([], dtype=float)

    def flat(ids: pd.Series, ws: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(ids)), ids.map(len))
        return row, (row.astype(np.int64) << 40) + np.concatenate(ids.to_numpy()), np.concatenate(ws.to_numpy())

    row, left, w = flat(l_ids, l_ws)
    _, right, v = flat(r_ids, r_ws)
    at = np.minimum(np.searchsorted(right, left), len(right) - 1)
    same = right[at] == left
    return pd.Series(np.bincount(row[same], weights=w[same] * v[at[same]], minlength=len(l_ids)))


def similar_nodes(looks: DataFrame) -> DataFrame:
    """``a, b, cosine`` of all pairs of nodes with looks (``node, look, form, entry``), a < b, whose cosine is EDGE or more where one is an entry, FORM_EDGE or more where none is; two entries are no pair."""
    vectors = materialise(_vectors(looks).join(looks.select("look", "entry"), "look").withColumn("gram", F.xxhash64("gram").bitwiseAND(F.lit((1 << 40) - 1))))
    common = Window.partitionBy("look").orderBy("w", "gram").rowsBetween(Window.unboundedPreceding, 0)
    massed = materialise(vectors.withColumn("mass", F.sum(F.col("w") * F.col("w")).over(common)).select("look", "entry", "gram", "mass"))

    def needed(edge: float, entry: bool) -> DataFrame:
        # the commonest grams that together have less than the edge of the length can't make that cosine alone
        return massed.where((F.col("entry") == F.lit(entry)) & (F.col("mass") >= edge * edge * 0.999)).select("look", "gram")

    meet = lambda x, y: x.withColumnRenamed("look", "l").join(y.withColumnRenamed("look", "r"), "gram").select("l", "r")
    with_entry = meet(needed(EDGE, False), needed(EDGE, True)).distinct().withColumn("least", F.lit(EDGE))
    forms = meet(needed(FORM_EDGE, False), needed(FORM_EDGE, False)).where("l < r").distinct().withColumn("least", F.lit(FORM_EDGE))
    whole = vectors.groupBy("look").agg(F.array_sort(F.collect_list(F.struct("gram", F.col("w").cast("float").alias("w")))).alias("v")).select("look", F.col("v.gram").alias("ids"), F.col("v.w").alias("ws"))
    whole = materialise(whole)
    met = with_entry.unionByName(forms)
    for side in ("l", "r"):
        met = met.join(whole.select(F.col("look").alias(side), F.col("ids").alias(f"ids_{side}"), F.col("ws").alias(f"ws_{side}")), side)
    near = met.select("l", "r", "least", _dots("ids_l", "ws_l", "ids_r", "ws_r").alias("cosine")).where(F.col("cosine") >= F.col("least"))
    for side in ("l", "r"):
        near = near.join(looks.select(F.col("look").alias(side), F.col("node").alias(f"node_{side}")), side)
    return near.where("node_l <> node_r").select(F.least("node_l", "node_r").alias("a"), F.greatest("node_l", "node_r").alias("b"), "cosine").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def average_linkage(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``node, cluster``, ``cluster, entry`` of what two entries attract alike) of ``nodes`` (``node, entry``) with ``edges`` (``a, b, cosine``).

    The similarity of two clusters is the mean over all pairs of their nodes, 0 where there is no edge. Each level is one round, in which clusters
    merge into the most similar one if it is at least that similar, and the last goes on until nothing merges: into an entry's cluster or into one that has itself no better
    to merge into, so that merges don't chain. Clusters with different entries never merge. Each round is written to cut the lineage.
    """
    state = nodes.select("node", F.col("node").alias("cluster"))
    clusters = materialise(nodes.select(F.col("node").alias("cluster"), F.lit(1).cast("bigint").alias("size"), F.when(F.col("entry"), F.col("node")).alias("seed")))
    # the graph of clusters, either way round; merging adds its edges up, so that it shrinks
    links = materialise(edges.select(F.explode(F.array(F.struct(F.col("a").alias("cluster"), F.col("b").alias("to"), F.col("cosine").alias("total")), F.struct(F.col("b").alias("cluster"), F.col("a").alias("to"), F.col("cosine").alias("total")))).alias("e")).select("e.*"))
    near = F.col("mean") >= F.col("best") - CLEAR
    waiting: list[DataFrame] = []
    for level in chain(LEVELS, repeat(LEVELS[-1])):
        linked = links.join(clusters, "cluster").join(clusters.select(F.col("cluster").alias("to"), F.col("size").alias("to_size"), F.col("seed").alias("to_seed")), "to")
        linked = linked.where("seed is null").withColumn("mean", F.col("total") / (F.col("size") * F.col("to_size"))).where(F.col("mean") >= level)
        ranked = linked.withColumn("best", F.max("mean").over(Window.partitionBy("cluster")))
        order = F.struct(-F.round("mean", 9), F.col("to_seed").isNull(), "to")
        first = materialise(ranked.groupBy("cluster").agg(F.min_by(F.struct("to", "to_seed"), order).alias("to"), F.collect_set(F.when(near, F.col("to_seed"))).alias("seeds")).select("cluster", "to.*", "seeds"))
        # what several entries attract about equally is undecided; else into an entry's cluster, or into one that has itself no better than a later one
        clear = first.where("size(seeds) <= 1")
        later = first.select(F.col("cluster").alias("to"), (F.col("to_seed").isNull() & (F.col("to") > F.col("cluster")) & (F.size("seeds") <= 1)).alias("stays"))
        moves = clear.join(later, "to", "left").where("to_seed is not null or (to < cluster and coalesce(stays, true))").select("cluster", "to")
        undecided = first.where("size(seeds) > 1").select("cluster", F.explode("seeds").alias("entry"))
        waiting.append(state.join(undecided, "cluster").select("node", "entry"))
        moves = materialise(moves.unionByName(undecided.select("cluster", F.lit(None).cast("string").alias("to")).distinct()))
        if moves.isEmpty():
            if level > LEVELS[-1]:
                continue
            break
        renamed = lambda df, c: df.join(moves.where("to is not null").select(F.col("cluster").alias(c), F.col("to").alias("new")), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
        state = materialise(renamed(state, "cluster"))
        clusters = materialise(renamed(clusters, "cluster").groupBy("cluster").agg(F.sum("size").alias("size"), F.max("seed").alias("seed")))
        out = moves.where("to is null").select("cluster")
        left = links.join(out, "cluster", "left_anti").join(out.withColumnRenamed("cluster", "to"), "to", "left_anti")
        links = materialise(renamed(renamed(left, "cluster"), "to").where("cluster <> to").groupBy("cluster", "to").agg(F.sum("total").alias("total")))
    return state.join(clusters.select("cluster", "seed"), "cluster").select("node", "cluster", "seed"), reduce(DataFrame.unionByName, waiting)


@F.pandas_udf(T.StringType())
def _form(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else form_of(x))


@F.pandas_udf(T.DoubleType())
def _cost(forms: pd.Series, known: pd.Series, persons: pd.Series) -> pd.Series:
    return pd.Series([reading_cost(f, k, bool(p)) for f, k, p in zip(forms, known, persons)], dtype=float)


def mentions(enrichment: DataFrame, entities: DataFrame) -> DataFrame:
    """``item_id, spelling``, distinct: the elements of ``orgs`` (a JSON array; null, empty or broken ones have none) and the entities' names, or keys where the name is null. Empty spellings are left out."""
    listed = enrichment.select("item_id", F.explode(F.from_json("orgs", "array<string>")).alias("spelling"))
    typed = entities.select("item_id", F.coalesce("name", "key").alias("spelling"))
    return listed.unionByName(typed).where("spelling is not null and trim(spelling) <> ''").distinct()


def _looks(name: Column, person: Column) -> Column:
    """How an entry is typed besides its full form: an organisation by its initials and without its trade word, a person with an initial or a pet name."""
    tokens = F.split(name, " ")
    size = F.size(tokens)
    initials = F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), "")
    shorter = F.array_join(F.slice(tokens, 1, F.greatest(size - 1, F.lit(1))), " ")
    rest = F.array_join(F.filter(F.slice(tokens, 2, F.greatest(size - 1, F.lit(1))), lambda t: F.length(t) > 1), " ")
    pets = F.create_map(*[F.lit(x) for full, short in PET.items() for x in (full, short)])[tokens[0]]
    given = F.concat(F.array(F.substring(tokens[0], 1, 1), tokens[0]), F.coalesce(F.split(pets, " "), F.array().cast("array<string>")))
    typed = F.when(person & (size > 1), F.transform(given, lambda g: F.concat_ws(" ", g, rest))).otherwise(F.array(F.when(size > 2, initials), F.when(size.between(2, 3), shorter)))
    return F.array_distinct(F.filter(F.concat(F.array(name), typed), lambda x: x.isNotNull()))


def _written_out(form: Column) -> Column:
    short = F.create_map(*[F.lit(x) for pair in SHORT.items() for x in pair])
    return F.array_distinct(F.array(form, F.array_join(F.transform(F.split(form, " "), lambda t: F.coalesce(short[t], t)), " ")))


class Linked:
    """The result of :func:`group_names`: ``groups`` (``spelling, form, node, cluster, seed``), ``links`` (``item_id, spelling, org_key``)."""

    def __init__(self, groups: DataFrame, links: DataFrame) -> None:
        self.groups, self.links = groups, links


def group_names(named: DataFrame, orgs: DataFrame) -> Linked:
    """Mentions (``item_id, spelling``) grouped by what they mean, and linked to ``orgs`` (``key, display, kind``) where that is an entry.

    Entries with a null key or without any token are never meant; of entries with equal keys the first kind
    counts. A spelling that can mean several entries equally well is linked only where its item names one of them otherwise.
    """
    named = named.select("item_id", "spelling").distinct()
    typed = materialise(named.select("spelling").distinct().withColumn("form", _form("spelling")).where("form <> ''"))
    spelled = named.join(typed, "spelling")
    entries = orgs.where("key is not null").groupBy("key").agg(F.min_by(F.coalesce("display", "key"), F.coalesce("display", "key")).alias("display"), F.min("kind").alias("kind"))
    entries = entries.select(F.col("key").alias("org_key"), _form("display").alias("known"), F.coalesce(F.col("kind") == "person", F.lit(False)).alias("person")).where("known <> ''")
    entries = materialise(entries.withColumn("node", F.concat(F.lit("\x00"), "org_key")))
    forms = typed.select("form").distinct()
    looks = entries.select("node", F.lit(True).alias("entry"), F.explode(_looks(F.col("known"), F.col("person"))).alias("form")).unionByName(forms.select(F.col("form").alias("node"), F.lit(False).alias("entry"), F.explode(_written_out(F.col("form"))).alias("form")))
    looks = materialise(looks.withColumn("look", F.xxhash64("node", "form")))
    nodes = looks.select("node", "entry").distinct()
    state, undecided = average_linkage(nodes, materialise(similar_nodes(looks)))
    # the exact check: what the cluster says must be readable as the entry
    said = state.where("seed is not null").select(F.col("node").alias("form"), F.col("seed").alias("node"), F.lit(True).alias("sure")).unionByName(undecided.select(F.col("node").alias("form"), F.col("entry").alias("node"), F.lit(False).alias("sure")))
    read = materialise(said.join(entries, "node").withColumn("cost", _cost("form", "known", "person")).where("cost is not null").select("form", "org_key", "sure"))
    at = spelled.join(read, "form")
    sure = materialise(at.where("sure").select("item_id", "spelling", "org_key"))
    rest = at.where("not sure").join(sure.select("item_id", "org_key").distinct(), ["item_id", "org_key"])
    by_item = rest.groupBy("item_id", "spelling").agg(F.min("org_key").alias("org_key"), F.count_distinct("org_key").alias("n")).where("n = 1").drop("n")
    groups = typed.join(state.select(F.col("node").alias("form"), "cluster"), "form").join(read.where("sure").select("form", "org_key"), "form", "left")
    return Linked(groups, sure.unionByName(by_item))


def link_names(named: DataFrame, orgs: DataFrame) -> DataFrame:
    """``item_id, spelling, org_key`` of each distinct mention in ``named`` that means an entry of ``orgs``, as :func:`group_names` links them."""
    return group_names(named, orgs).links


def name_groups(named: DataFrame, orgs: DataFrame) -> DataFrame:
    """``spelling, name, org_key``: one row for each distinct spelling with its group's name, the least form in it, and the entry meant, null where none is.

    Spellings of an entry that the check doesn't let pass are groups of their own, by cluster and without the entry.
    """
    groups = group_names(named, orgs).groups
    return groups.select("spelling", F.min("form").over(Window.partitionBy("cluster", "org_key")).alias("name"), "org_key")
