"""Postal addresses: parsing, linkage weights by expectation-maximization, and pairs of one place.

An address is parsed to house number, street, kind of street, town and
postcode.  Equal parses are one row.  Rows are blocked on house number with
postcode, on house number with town (also with a letter left out) and an end of
the street's sound, and where town and postcode are missing on house number with
the sound of the street; in a block the components are compared to levels (equal,
slip, different, missing).  The weights of the levels are estimated by
expectation-maximization over the counts of all patterns, and the posterior of
a pattern decides whether its pairs are one place.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.blocks import group_pairs, split_join
from quillon.llm.components import connected_components
from quillon.llm.names import COUNTRIES, cuts
from quillon.llm.text import edits, fold, sound
from quillon.runtime import drop_table, spread, table

SEP = "\x1f"
# Kinds of streets; the first of a line is the code.
KINDS = (
    "street st str strt", "road rd", "lane ln la", "avenue ave av avn aven", "drive dr drv", "square sq sqr", "terrace ter terr tce", "boulevard blvd bd boul bvd bld",
    "rue r", "place pl plc", "strasse str", "weg wg", "platz pl", "straat str", "laan ln", "gracht gr", "via v", "corso cso", "piazza pza p za pzza",
    "calle cl", "c", "avenida avda avd av", "plaza pza plz", "ulica ul", "aleja al aleje", "plac pl",
    "close cl", "court ct crt", "way wy", "crescent cres", "gardens gdns", "allee", "quai", "chemin", "viale", "vicolo", "paseo", "camino", "dijk", "plein", "ring", "ufer",
)
#: Kinds before the name, after it, and written together with it.
BEFORE = frozenset("c rue avenue boulevard place via corso piazza calle avenida plaza ulica aleja plac quai chemin viale vicolo paseo camino".split())
GLUED = ("strasse", "strass", "straat", "platz", "gracht", "laan", "weg", "allee", "dijk", "plein", "ring", "ufer", "str", "ln", "gr", "wg", "pl")
# Number words.
NUMBERS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
# Countries whose names and codes are taken out of addresses; other codes are words of some language.
_NATIONS = {x for c in "gb us de fr it es nl pl cy vg pa ie ch".split() for x in COUNTRIES[c].split()}
_NATION = re.compile(
    r"\b(?:united kingdom|great britain|united states(?: of america)?|u\.? ?s\.? ?a\.?|u\.? ?k\.?|the netherlands|deutschland|polska|espana|italia|france|germany|poland|spain|italy|netherlands|nederland|cyprus|"
    + "|".join(sorted((x for x in _NATIONS if len(x) == 3), key=len, reverse=True)) + r")\b\.?"
)
_CARE = re.compile(r"\bc\s*/\s*o\b\s*(?:[^,;/|\n]*?\b(?:agents|nominees|secretaries|registrars|trustees|services)\b|[^,;/|\n]*)|\b(?:care of|attn:?)\b[^,;/|\n]*")
_UNIT = re.compile(
    r"\b\d{1,3}(?:st|nd|rd|th|e|er|o|a|ª|º)?\.? ?(?:floor|fl|etage|og|stock|piso|izq|dcha|dch)\b\.?|\b\d{1,2}\. ?og\b"
    r"|\b(?:flat|suite|ste|apt|apartment|appt|unit|room|rm|office|floor|piso|planta|puerta|etage|interno|int|scala|sc|batiment|bat|lokal|lok|mieszkanie|m|wohnung|whg|bus|app|po box|box)\b\.? ?(?:no\.? ?|nr\.? ?|#)?(?:\d{1,4}[a-z]?|[a-z])\b|\bburo ?\d+"
)
_HOUSE = re.compile(r"^[a-z' ]*\b(?:house|haus|building|tower|gebouw|hause|huis|immeuble|edificio|palazzo|mill|centre|center)$")
_NUMERO = re.compile(r"(?:\b(?:no|nr|num|numero|number|nº|n°)\b\.? ?|#\s?)(?=\d)")
_POST = (
    re.compile(r"\b[a-z]{1,2}\d{1,2}[a-z]? ?\d[a-z]{2}\b"),  # GB
    re.compile(r"\b(?:nl-?)?\d{4} ?[a-z]{2}\b"),  # NL
    re.compile(r"\b\d{2}-\d{3}\b"),  # PL
    re.compile(r"\b(?:[a-z]{1,2} ?-? ?)?\d{5}(?:-\d{4})?\b"),
)
_NUM = re.compile(r"\b\d{1,6}[a-z]?\b")


_KIND = {}
for _k in KINDS:
    for _x in _k.split():
        _KIND.setdefault(_x, _k.split()[0])
#: Codes that a short form may stand for are told apart by the whole form only.
_SHORT = {x for k in KINDS for x in k.split()[1:]}


@lru_cache(100_000)
def _near_kind(w: str) -> str:
    if w in _KIND:
        return _KIND[w]
    if len(w) >= 5:
        for k in _KIND:
            if len(k) >= 5 and edits(w, k, 1) <= 1:
                return _KIND[k]
    return ""


Place = tuple[str, str, str, str, str]


def parse_address(text: str | None) -> Place | None:
    """House number, street, kind, town and postcode of an address, empty where missing; null without number or street.

    Flat, floor, suite, building name and care-of are left out, a number word
    is a number, digits that stand for letters are mended.
    """
    s = fold((text or "").replace("\r", "\n").replace("\n", " , "))
    if not re.search(r"\d|" + "|".join(NUMBERS), s):
        return None
    s = _CARE.sub(" , ", s)
    s = re.sub(r"\bc/(?!o)", "calle ", re.sub(r"\bc\.so\b", "corso", re.sub(r"\bp\.? ?z+\.?a\b\.?", "piazza", s)))
    s = re.sub(r"[^\s,;/|]{5,}", lambda m: re.sub(r"(?<=[a-z])[01](?=[a-z])|(?<=[a-z])[01](?=[,.]?$)", lambda d: "o" if d[0] == "0" else "l", m[0]) if sum(c.isalpha() for c in m[0]) > 3 else m[0], s)
    s = re.sub(r"[;/|]| [-–—] ", " , ", s)
    s = _NATION.sub(" , ", s)
    s = re.sub(r"(?:^|,)\s*[a-z]{2}\s*(?=,|$)", " , ", s)
    s = _UNIT.sub(" , ", s)
    s = _NUMERO.sub("", s)
    post = ""
    for p in _POST:
        m = None
        for m in p.finditer(s) if p is _POST[-1] else (p.search(s),):  # of several bare numbers the last one
            pass
        if m and p is _POST[-1] and m[0].isdigit() and not re.search(r"\d", s[: m.start()] + s[m.end() :]):
            m = None  # the only number is that of the house
        if m:
            post = re.sub(r"[^a-z0-9]", "", m[0])
            if not re.match(r"[a-z]{1,2}\d{1,2}[a-z]?\d[a-z]{2}$", post):
                post = re.sub(r"^[a-z]+", "", post)
            s = s[: m.start()] + " , " + s[m.end() :]
            break
    segs = [x.strip(" -'") for x in s.split(",")]
    segs = [x for x in segs if x.strip('.') and not _HOUSE.match(x.rstrip('.'))]
    number = ""
    parts: list[str] = []
    for x in segs:
        if not number and (m := _NUM.search(x)):
            number = m[0].lstrip("0") or "0"
            parts += [x[: m.start()].strip(" -"), x[m.end() :].strip(" -.")]
        else:
            parts.append(x)
    parts = [x for x in parts if not _HOUSE.match(x.rstrip("."))]
    if not number:
        for i, x in enumerate(parts):
            ws = x.replace("-", " ").split()
            if ws and (ws[0] in NUMBERS or ws[0] in TENS):
                n, k = TENS.get(ws[0], NUMBERS.get(ws[0], 0)), 1
                if ws[0] in TENS and len(ws) > 1 and ws[1] in NUMBERS:
                    n, k = n + NUMBERS[ws[1]], 2
                number, parts[i] = str(n), " ".join(ws[k:])
                break
    street = kind = ""
    towns: list[str] = []
    for x in parts:
        ws = [w for w in re.sub(r"[.']", " ", x).replace("-", " ").split() if w]
        if not ws:
            continue
        if street:
            towns.append(" ".join(ws))
            continue
        k0, k1 = _near_kind(ws[0]), [(_near_kind(w), i) for i, w in enumerate(ws) if i]
        if k0 and len(ws) > 1 and (k0 in BEFORE or ws[0] in _SHORT and not any(k for k, _ in k1)):
            kind, street = k0, " ".join(ws[1:])
            if len(ws) >= 3 and len(ws[1]) > 3 and len(parts) <= 3:  # nothing separates the street from what follows
                street = ws[1]
                towns.append(" ".join(ws[2:]))
        elif k1 and any(k for k, _ in k1):
            kind, i = [(k, i) for k, i in k1 if k][0]
            street = "".join(ws[:i])
            if ws[i + 1 :]:
                towns.append(" ".join(ws[i + 1 :]))
        else:
            g = next((g for g in GLUED if ws[0].endswith(g) and len(ws[0]) - len(g) >= 4 and (len(g) > 2 or x.split()[0].endswith(".") or g == "ln")), "")
            if g and (number or len(ws) == 1):
                street, kind = ws[0][: -len(g)], _KIND.get(g, g)
                if ws[1:]:
                    towns.append(" ".join(ws[1:]))
            else:
                towns.append(" ".join(ws))
    if not number or not street:
        return None
    towns = [re.sub(r"^(?:[a-z]{2}) | (?:[a-z]{2})$", "", t) for t in towns]
    towns = [t for t in towns if len(t) > 2 and t not in _NATIONS]
    # "c." is short for several kinds
    return number, street.replace(" ", ""), "" if kind == "c" else kind, max(towns, key=len, default="").replace(" ", ""), post


def _square(kind: str) -> str:
    """Kinds whose short forms cannot be told apart count as one."""
    return "pl" if kind in ("place", "platz", "plac", "plaza", "piazza") else kind[:2]


def _slip(a: str, b: str) -> bool:
    return sound(a) == sound(b) or edits(a, b, 2) <= (1 if min(len(a), len(b)) < 8 else 2)


#: Number of levels of street, kind, town and postcode: 0 different, 1 missing, 2 slip, 3 equal.
LEVELS = 4


def levels(a: Place, b: Place) -> tuple[int, int, int, int]:
    """Levels of agreement of street, kind, town and postcode of two places with one house number."""
    out = []
    for x, y, near in (
        (a[1], b[1], _slip), (_square(a[2]), _square(b[2]), lambda x, y: False), (a[3], b[3], _slip),
        (a[4], b[4], lambda x, y: edits(x, y, 1) <= 1),
    ):
        out.append(1 if not x or not y else 3 if x == y else 2 if near(x, y) else 0)
    return tuple(out)  # type: ignore[return-value]


def same_place(v: tuple[int, int, int, int]) -> bool:
    """Exact check of a pattern: the same street of the same town."""
    street, kind, town, post = v
    if street < 2 or kind == 0 or town == 0:
        return False
    if town == 1:
        return post == 3 or post == 2 and street == 3
    return post != 0 or street == 3 and town == 3


#: Least shares of all places that make a street's name frequent, for classes 0 to 2; all others are of class 3.
FREQUENT = (0.1, 0.01, 0.001)
#: Levels of the street: different, missing, slip, and equal by class of its name.
STREET = 3 + len(FREQUENT) + 1
# What unmistaken places agree on before anything has been counted: street, kind, town, postcode.
START = ([0.02, 0.02, 0.2, 0.19, 0.19, 0.19, 0.19], [0.001, 0.03, 0.019, 0.95], [0.02, 0.3, 0.2, 0.48], [0.02, 0.25, 0.05, 0.68])
Pattern = tuple[int, int, int, int]


class Chances:
    """Chances of each level for two unrelated places, from the values of all places.

    ``counts`` has of number, street, kind, town and postcode the rows, the rows
    that miss it, and the numbers of ordered pairs of rows with an equal value;
    ``classes`` has those of the street by class of its name.  A hundred pairs of
    which one agrees are added, so that a small table says little.  Places with
    one postcode are in one town as a rule: the town counts for little beside it.
    """

    def __init__(self, counts: list[tuple[float, float, float]], classes: list[float]):
        n = max(counts[0][0], 1.0)
        self.pairs = max(1.0, n * (n - 1) / 2)
        all_pairs = n * (n - 1) + 100
        same = [(sq + 1) / all_pairs for _, _, sq in counts]
        gap = [max(1e-4, 1 - (1 - missing / n) ** 2) for _, missing, _ in counts]
        self.number = same[0]
        self.u = []
        for f in range(1, 5):
            slip = min(0.05, 2 * same[f])
            equal = [(c + 0.25) / all_pairs for c in classes] if f == 1 else [same[f]]
            row = [max(1e-6, 1 - gap[f] - slip - sum(equal)), gap[f], slip, *equal]
            self.u.append([x / sum(row) for x in row])
        rest = 1 - min(0.9, gap[3])
        self.town_beside_post = [0.01 * rest, 1 - rest, 0.09 * rest, 0.9 * rest]

    def of(self, v: Pattern) -> float:
        """Chance that two unrelated places have one house number and this pattern."""
        town = self.town_beside_post if v[3] == 3 else self.u[2]
        return self.number * self.u[0][v[0]] * self.u[1][v[1]] * town[v[2]] * self.u[3][v[3]]


def estimate(counts: dict[Pattern, int], chances: Chances, *, rounds: int = 50) -> tuple[float, list[list[float]]]:
    """Share of matches among all pairs of places, and the chances of each level among matches, by expectation-maximization.

    ``counts`` has the number of candidate pairs of each pattern, at most 7 * 4**3
    of them.  The chances among unrelated places are held, as blocks contain
    hardly any unrelated pair.  The level "missing" has chances of its own among
    matches, so it counts for as much as the data say.
    """
    m = [list(r) for r in START]
    p = min(0.5, max(1, sum(counts.values())) / chances.pairs)
    for _ in range(rounds):
        sums, weight = [[10 * x for x in r] for r in START], 0.0
        for v, n in counts.items():
            g = n * weigh(v, (p, m), chances)
            weight += g
            for f, x in enumerate(v):
                sums[f][x] += g
        p = min(0.5, max(1e-15, weight / chances.pairs))
        m = [[x / sum(r) for x in r] for r in sums]
    return p, m


def weigh(v: Pattern, model: tuple[float, list[list[float]]], chances: Chances) -> float:
    """Posterior of a pattern: the chance that two places with it are one."""
    p, m = model
    x = math.log(p / (1 - p)) + sum(math.log(m[f][i]) for f, i in enumerate(v)) - math.log(chances.of(v))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def blocks(p: Place) -> list[tuple[str, str]]:
    """``(key, role)`` of a place.

    Under number with postcode, with town and the street's last sound, and with its
    first sound and the town with up to one letter left out, all meet (role ``x``).  Under number and
    street alone meet only pairs that have neither town nor postcode on both
    sides: ``n`` (neither) meets all, ``t`` (no town) meets ``p`` (no postcode).
    """
    number, street, _, town, post = p
    s, t = sound(street), sound(town)
    out = [(f"p{number}.{post}", "x")] * bool(post)
    if town:
        out += [(f"t{number}.{c}.{s[:1]}", "x") for c in ({"!" + t} | cuts(town, 1) if len(town) > 3 else {"!" + t})] + [(f"e{number}.{t}.{s[-1:]}", "x")]
    return out + [(f"b{number}.{s}", "c" if town and post else "p" if town else "t" if post else "n")]


def _fill_towns(held: DataFrame, *, least: int = 3, share: float = 0.8) -> DataFrame:
    """Places without a town get the one that nearly all places of their postcode area have.

    An area is the leading letters or three digits of the postcode, by its length and the kind of street.
    """
    f = F.split("place", SEP)
    number, street, kind, town, post = (f[i] for i in range(5))
    area = F.concat_ws(".", F.length(post), F.when(post.rlike("^[a-z]"), F.regexp_extract(post, "^([a-z]+)", 1)).otherwise(F.substring(post, 1, 3)), F.substring(kind, 1, 2))
    rows = held.withColumns({"town": town, "area": F.when(post != "", area)})
    n = rows.where("town != '' and area is not null").groupBy("area", "town").count()
    known = n.groupBy("area").agg(F.max_by("town", F.struct("count", "town")).alias("t"), F.max("count").alias("m"), F.sum("count").alias("n"))
    known = known.where((F.col("m") >= least) & (F.col("m") >= share * F.col("n"))).select("area", "t")
    gap = rows.where("town = '' and area is not null").join(known, "area", "left")
    filled = gap.select("id", F.concat_ws(SEP, number, street, kind, F.coalesce("t", F.lit("")), post).alias("place"))
    return rows.where("town != '' or area is null").select("id", "place").unionByName(filled)


def _loose(links: DataFrame) -> DataFrame:
    """Links ``(a, b, v)`` without those by number and street alone of places whose partners are not in one town."""
    town = lambda c: F.split(c, SEP)[3]
    told = F.coalesce(F.nullif(town("a"), F.lit("")), F.nullif(town("b"), F.lit("")))
    bare = links.where(F.substring("v", 3, 2) == "11").select("a", "b", told.alias("town"))
    ends = bare.select(F.explode(F.array("a", "b")).alias("place"), "town").groupBy("place").agg(F.min("town").alias("low"), F.max("town").alias("high"))
    torn = ends.where("low != high").select("place")
    kept = bare.join(torn.withColumnRenamed("place", "a"), "a", "left_anti").join(torn.withColumnRenamed("place", "b"), "b", "left_anti")
    return links.where(F.substring("v", 3, 2) != "11").select("a", "b").unionByName(kept.select("a", "b"))


def candidate_places(places: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: the pairs of distinct ``(place)`` that meet in a block, each once."""
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ps, ks, rs = [], [], []
            for x in b.column(0).to_pylist():
                for k, r in blocks(tuple(x.split(SEP))):
                    ps.append(x)
                    ks.append(k)
                    rs.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.string()), pa.array(ks, pa.string()), pa.array(rs, pa.string())], ["place", "k", "r"])

    keys = table(places.mapInArrow(block, "place string, k string, r string").select(F.xxhash64("k").alias("h"), "place", "r"), "blocks")
    full, bare = keys.where("r = 'x'"), keys.where("r != 'x'")
    a = lambda df: df.select("h", F.col("place").alias("a"), "r")
    b = lambda df: df.select("h", F.col("place").alias("b"), F.col("r").alias("q"))
    pairs = split_join(a(full), b(full), ["h"], alike=True).where("a < b").select("a", "b")
    part = split_join(a(bare.where("r in ('n', 't')")), b(bare), ["h"]).where("a != b and (r = 'n' or q = 'p')")
    return pairs.unionByName(part.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def place_groups(rows: DataFrame, id_col: str, address_col: str, *, least: float = 0.5) -> DataFrame:
    """``(id, group)``, a row per id and place: rows of one group are the same house of the same street and town.

    Null, empty and meaningless addresses, and those without a number or a street,
    are in no group.  Equal addresses are compared once; repeated ids give one
    row a place.  A missing town is made up for by an equal postcode.  A pattern of
    agreement links if its posterior reaches ``least`` and the kinds of the streets do not differ; with neither a town nor a postcode
    in common, a place joins others only if these are in one town.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ps = [parse_address(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p and SEP.join(p) for p in ps], pa.string())], ["id", "place"])

    src = spread(rows.where(F.col(id_col).isNotNull() & F.col(address_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(address_col).alias("a")))
    parsed = table(src.mapInArrow(parse, "id string, place string").where("place is not null"), "places")
    held = table(_fill_towns(parsed), "filled")
    drop_table(parsed)
    places = held.select("place").distinct()
    f = F.split("place", SEP)
    values = table(places.select(F.explode(F.array(*(
        F.struct(F.lit(i).alias("i"), (F.substring(f[i], 1, 2) if i == 2 else f[i]).alias("x")) for i in range(5)
    ))).alias("s")).groupBy("s.i", "s.x").count(), "values")
    n = F.col("count").cast("double")
    pairs = F.sum(F.when(F.col("x") != "", n * (n - 1)).otherwise(0.0))
    sums = values.groupBy("i").agg(F.sum(n).alias("n"), F.sum(F.when(F.col("x") == "", n).otherwise(0.0)).alias("gap"), pairs.alias("same")).orderBy("i").collect()  # five rows
    total = max(1.0, sums[0].n if sums else 0.0)
    share = [F.lit(total * x) for x in FREQUENT]
    rank = F.when(n >= share[0], 0).when(n >= share[1], 1).when(n >= share[2], 2).otherwise(3)
    streets = values.where("i = 1 and x != ''").withColumn("class", rank)
    by_class = {r["class"]: r.same for r in streets.groupBy("class").agg(pairs.alias("same")).collect()}  # four rows
    known = {r.x: r["class"] for r in streets.where("class < 3").select("x", "class").collect()}  # at most 1 / 0.001 names
    chances = Chances([(r.n, r.gap, r.same) for r in sums], [by_class.get(c, 0.0) for c in range(4)]) if sums else None

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = []
            for p, q in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p, q = tuple(p.split(SEP)), tuple(q.split(SEP))
                street, *rest = levels(p, q)
                vs.append("".join(map(str, (street + known.get(p[1], 3) if street == 3 else street, *rest))) if p[0] == q[0] else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vs, pa.string())], ["a", "b", "v"])

    patterns = table(candidate_places(places).mapInArrow(compare, "a string, b string, v string").where("v is not null"), "patterns")
    counts: dict[Pattern, int] = {tuple(map(int, r.v)): r["count"] for r in patterns.groupBy("v").count().collect()}  # at most 448 patterns
    model = estimate(counts, chances) if counts else None
    good = ["".join(map(str, v)) for v in counts if weigh(v, model, chances) >= least and v[1]]  # streets of two kinds are two, where a table is too small to tell
    links = _loose(patterns.where(F.col("v").isin(*good) if good else F.lit(False)))
    roots = connected_components(links, "a", "b").select(F.col("v").alias("place"), "root")
    return held.distinct().join(roots, "place", "left").select("id", F.coalesce("root", "place").alias("group")).distinct()


def link_places(rows: DataFrame, id_col: str, address_col: str, *, least: float = 0.5) -> DataFrame:
    """``(left_id, right_id)``, smaller first: the pairs of rows of :func:`place_groups`, each once."""
    groups = table(place_groups(rows, id_col, address_col, least=least), "groups")
    return group_pairs(groups, "id", "group").distinct()
