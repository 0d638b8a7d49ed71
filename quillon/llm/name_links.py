"""Variant spellings of names: which ids name the same person or organisation.

Names are folded, parsed and compared as in :mod:`quillon.llm.names`.  A
profile is a distinct parsed name with its date; equal profiles are one row
however often they are delivered.  Blocks are phonetic codes of the tokens: the
sound of the distinguishing token, and its spelling with one letter left out,
find the distinguishing tokens that are at most a slip apart; profiles with such
tokens meet if their years can be one or, where a date is missing, if their
given names share a letter.  Names two slips apart meet under an equal day.
Accepted pairs and the ids of the profiles are clustered by connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import names as N
from quillon.llm.blocks import group_pairs, split_join
from quillon.llm.components import connected_components
from quillon.llm.text import fold, sound, unscan
from quillon.runtime import deal, drop_table, table

SEP = "\x1f"
#: Least likeness of two names of one person or organisation.
LEAST = 0.78
PAYLOAD = (
    "schema string, properties struct<name:array<string>,alias:array<string>,birthDate:array<string>,incorporationDate:array<string>>"
)


def queue_names(queue: DataFrame) -> DataFrame:
    """``(entity_id, person, name, date)`` of the waiting rows, each once; the date is the entity's most detailed one."""
    p = queue.where(F.col("status").isin("pending", "pending_review") & F.col("entity_id").isNotNull()).select(
        "entity_id", F.from_json("raw_entity", PAYLOAD).alias("p")
    )
    none = F.array().cast("array<string>")
    values = lambda *fs: F.concat(*(F.coalesce(f"p.properties.{f}", none) for f in fs))
    told = F.transform(F.filter(values("birthDate", "incorporationDate"), lambda d: d.rlike("[1-9]")), lambda d: F.named_struct(F.lit("n"), F.length(d), F.lit("date"), d))
    rows = p.where(F.col("p.properties").isNotNull()).select(
        "entity_id", (F.col("p.schema") == "Person").alias("person"), F.explode(values("name", "alias")).alias("name"), F.array_max(told).alias("d"),
    ).where(F.col("person").isNotNull() & F.col("name").isNotNull() & (F.trim("name") != ""))
    once = table(rows.groupBy("entity_id", "person", "name").agg(F.max("d").alias("d")), "names")  # read twice, parsed once
    best = once.groupBy("entity_id").agg(F.max("d").alias("d"))
    return once.drop("d").join(best, "entity_id").select("entity_id", "person", "name", F.coalesce("d.date", F.lit("")).alias("date"))


def frequent_words(folded: DataFrame, share: float = 1e-3) -> dict[bool, frozenset[str]]:
    """Words that stand beside many different main words, in names ``(person, folded)``, of persons and of others.

    The main word of a name is its longest; a word counts once for each main word
    other than itself, so a name that is delivered often makes no word frequent.
    Those whose count is at least ``share`` of all main words, less two standard
    errors of the count, are at most some thousands, as a name has few words.
    """
    ws = F.array_distinct(F.split(F.regexp_replace("folded", "['.-]", ""), "[^a-z]+"))
    names = folded.select("person", F.filter(ws, lambda w: F.length(w) > 2).alias("ws")).where(F.size("ws") > 0)
    main = F.substring(F.array_max(F.transform("ws", lambda w: F.concat(F.lpad(F.length(w).cast("string"), 6, "0"), w))), 7, 1 << 20)
    pairs = table(names.select("person", main.alias("main"), F.explode("ws").alias("w")).distinct(), "words")
    totals = {r.person: r.n for r in pairs.where("w = main").groupBy("person").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    least = F.when(F.col("person"), F.lit(share * totals.get(True, 0))).otherwise(F.lit(share * totals.get(False, 0)))
    n = pairs.where("w != main").groupBy("person", "w").count()
    rows = n.where(F.col("count") - 2 * F.sqrt("count") >= least).where("count > 4").select("person", "w").collect()
    drop_table(pairs)
    return {k: frozenset(r.w for r in rows if r.person == k) for k in (True, False)}


@lru_cache(100_000)
def _dates(s: str) -> tuple[N.Date, ...]:
    return N.parse_date(s)


def _profile(person: bool, name: str, date: str, given: frozenset[str], common: frozenset[str]) -> str | None:
    date = date if _dates(date) else ""
    if person:
        x = N.parse_person(name, given)
        return x and SEP.join(("p", x[2], x[0], " ".join(x[1]), x[3], date))
    y = N.parse_org(name, common)
    return y and SEP.join(("o", y[0], "", " ".join(y[1]), y[2], date))


def stem_codes(stem: str) -> list[str]:
    """A distinguishing token and its sound, each with up to one letter left out: tokens one slip apart by either have one in common."""
    s = sound(stem.replace(" ", ""))
    return sorted(N.cuts(stem, 1) | N.cuts(s, 1)) if len(s) >= 4 else sorted({stem, s})


def near_stems(stems: DataFrame) -> DataFrame:
    """``(kind, a, b)``, a < b: the stems of distinct ``(kind, stem)`` of which :func:`names.same_stem` finds at most one slip.

    Most codes are one stem's alone; one aggregation over numbers leaves those of
    two, which are a pair, and those of more, which are joined.
    """
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [stem_codes(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.list_(pa.string()))], ["kind", "stem", "codes"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            good = [N.same_stem(x, y) not in (0.0, N.TWO_SLIPS) for x, y in zip(t.column(1).to_pylist(), t.column(2).to_pylist())]
            yield t.filter(pa.array(good, pa.bool_()))

    coded = stems.mapInArrow(code, "kind string, stem string, codes array<string>").select(F.xxhash64("kind", "stem").alias("s"), "kind", F.explode("codes").alias("c"))
    coded = table(coded.select(F.xxhash64("kind", "c").alias("h"), "s"), "codes")
    met = table(coded.groupBy("h").agg(F.min("s").alias("x"), F.max("s").alias("y"), F.count(F.lit(1)).alias("n")).where("x != y"), "met")
    more = coded.join(met.where("n > 2").select("h"), "h", "left_semi")
    many = split_join(more.select("h", F.col("s").alias("x")), more.select("h", F.col("s").alias("y")), ["h"], alike=True).where("x < y")
    pairs = met.where("n = 2").select("x", "y").unionByName(many.select("x", "y")).distinct()
    # a number that two stems share leads to both
    name = lambda n, c: stems.select(F.xxhash64("kind", "stem").alias(n), F.col("kind").alias("k" + n), F.col("stem").alias(c))
    named = pairs.join(name("x", "a"), "x").join(name("y", "b"), "y").where("kx = ky").select(F.col("kx").alias("kind"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return table(named.mapInArrow(check, "kind string, a string, b string"), "near")


def heads(given: str) -> list[str]:
    """Letters of a given name of which two names that :func:`names.same_given` takes for one share at least one."""
    if not given:
        return ["?"]
    firsts = {given[0], *(c[0] for c in N._canonical_given(given) or N.near_given(given))}
    out = {sound(f) or f for f in firsts} | {sound(given)[:1] or given[0]}
    return sorted(out | ({"2" + given[1:2]} if len(given) > 3 else set()))


def meetings(profile: str) -> list[str]:
    """Places at which a profile meets others with its stem: by year, and by a letter of the given name.

    Dated profiles meet by their year (its digits sorted, as a slip may swap
    them); one without a date meets all that share a letter of the given name, at
    places where the dated ones (marked 1) do not meet each other.
    """
    kind, _, given, _, _, date = profile.split(SEP)
    dates = _dates(date)
    out = [f"{int(bool(dates))}u{h}" for h in (heads(given) if kind == "p" else ("",))]
    return out + ["0y" + "".join(sorted(str(d[0]))) for d in dates[:1]]


def days(profile: str) -> list[str]:
    """Full dates of a profile whose stem is long enough for two slips, day and month in either order."""
    kind, stem, _, _, _, date = profile.split(SEP)
    return [f"{kind}{y}-{min(m, d)}-{max(m, d)}" for y, m, d in _dates(date)[:1] if d and len(sound(stem.replace(" ", ""))) >= 9]


@lru_cache(50_000)
def _parts(profile: str):
    kind, main, given, rest, tail, date = profile.split(SEP)
    words = tuple(rest.split())
    return kind, ((given, words, main, tail) if kind == "p" else (main, words, tail)), _dates(date)


def likeness(a: str, b: str) -> tuple[float, int]:
    """Likeness of two profiles and how their dates compare; 0 if they cannot be one.

    A distinguishing token with two slips, and a person without a given name, need an equal date.
    """
    ka, xa, da = _parts(a)
    kb, xb, db = _parts(b)
    if ka != kb:
        return 0.0, 0
    when = N.compare_dates(da, db)
    if when < 0 and {d[0] for d in da} & {d[0] for d in db}:
        when = 1
    if when < 0:
        return 0.0, when
    stem = 2 if ka == "p" else 0
    if when < 3 and N.same_stem(xa[stem], xb[stem]) == N.TWO_SLIPS:
        return 0.0, when
    if ka == "p":
        if when < 2 and bool(xa[0]) != bool(xb[0]):
            return 0.0, when
        s = N.compare_persons(xa, xb)
        if xa[3] != xb[3] and when <= 0:
            return 0.0, when  # father and son, unless the dates say otherwise
        if when >= 2:
            s = min(1.0, s * 1.12)
        return s, when
    s = N.compare_orgs(xa, xb)
    return (min(1.0, s * 1.1) if when >= 2 else s), when


def candidate_pairs(profiles: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: the pairs of distinct ``(profile)`` that meet in a block, each once."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ps = t.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [t.column(0), pa.array([meetings(p) for p in ps], pa.list_(pa.string())), pa.array([days(p) for p in ps], pa.list_(pa.string()))], ["profile", "places", "days"]
            )

    part = F.split("profile", SEP)
    placed = table(profiles.mapInArrow(meet, "profile string, places array<string>, days array<string>").select("*", part[0].alias("kind"), part[1].alias("stem")), "placed")
    near = near_stems(placed.select("kind", "stem").distinct())
    # each profile is at home under its own stem and visits the near ones
    home = placed.select("kind", "stem", "places", "profile")
    ways = near.select("kind", F.col("a").alias("stem"), F.col("b").alias("to")).unionByName(near.select("kind", F.col("b").alias("stem"), F.col("a").alias("to")))
    guests = split_join(home, ways, ["kind", "stem"]).select("kind", F.col("to").alias("stem"), "places", "profile")
    at = lambda df, c, r: df.select("kind", "stem", F.explode("places").alias("p"), "profile").select(
        F.xxhash64("kind", "stem", F.substring("p", 2, 99)).alias("h"), (F.substring("p", 1, 1) == "1").alias(r), F.col("profile").alias(c)
    )
    by_stem = split_join(at(home.unionByName(guests), "a", "ra"), at(home, "b", "rb"), ["h"], alike=True).where("a < b and not (ra and rb)")
    d = placed.where(F.size("days") > 0).select(F.explode("days").alias("day"), F.col("profile").alias("a"))
    by_day = split_join(d, d.withColumnRenamed("a", "b"), ["day"], alike=True).where("a < b")
    return by_stem.select("a", "b").unionByName(by_day.select("a", "b")).distinct()


def name_groups(rows: DataFrame) -> DataFrame:
    """``(entity_id, group)``: ids of one group name the same person or organisation; an id is in one group only.

    ``rows`` is ``(entity_id, person, name, date)``.  Persons whose birth years
    differ are apart even if spelled alike, as are generations (junior) of which
    no date says that they are one; a person without a date joins dated ones only
    if these have one year among them.  Sister firms differ in a word of the
    name.  Null and blank names link nothing, repeated rows change nothing, an
    empty table gives no row.
    """
    def fold_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            folded = [unscan(fold(x)) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(folded, pa.string()), b.column(3)], ["entity_id", "person", "folded", "date"])

    folded = table(
        deal(rows.select("entity_id", "person", "name", "date")).mapInArrow(fold_names, "entity_id string, person boolean, folded string, date string"), "folded"
    )
    frequent = frequent_words(folded)
    given, common = frequent[True], frequent[False] | N.COMMON

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_profile(*x, given, common) for x in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["entity_id", "profile"])

    held = table(folded.mapInArrow(parse, "entity_id string, profile string").where("profile is not null").distinct(), "held")
    drop_table(folded)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y, w = [], [], []
            for p, q in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
                s, when = likeness(p, q)
                if s >= LEAST:
                    x.append(p)
                    y.append(q)
                    w.append(when)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()), pa.array(y, pa.string()), pa.array(w, pa.int32())], ["a", "b", "w"])

    alike = table(candidate_pairs(held.select("profile").distinct()).mapInArrow(compare, "a string, b string, w int"), "alike")
    edges = _settle(alike).unionByName(held.select(F.col("entity_id").alias("a"), F.concat(F.lit("\x1e"), "profile").alias("b")))
    groups = connected_components(edges, "a", "b").where(~F.col("v").startswith("\x1e"))
    return groups.select(F.col("v").alias("entity_id"), F.col("root").alias("group"))


def link_names(rows: DataFrame) -> DataFrame:
    """``(left_id, right_id)``, smaller first: the pairs of ids of :func:`name_groups`."""
    return group_pairs(table(name_groups(rows), "groups"), "entity_id", "group")


def _settle(alike: DataFrame) -> DataFrame:
    """Links between profiles, without those of undated persons that fit dated ones of several years."""
    year = lambda c: F.regexp_extract(F.element_at(F.split(c, SEP), 6), r"(\d{4})", 1)
    both = alike.select("a", "b", year("a").alias("ya"), year("b").alias("yb"), F.col("a").startswith("p").alias("person"))
    loose = both.where("person and (ya = '') != (yb = '')").select(
        F.when(F.col("ya") == "", F.col("a")).otherwise(F.col("b")).alias("u"), F.when(F.col("ya") == "", F.col("yb")).otherwise(F.col("ya")).alias("y")
    )
    years = loose.groupBy("u").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    k = lambda c: years.select(F.col("u").alias(c), F.col("low").alias(f"l{c}"), F.col("high").alias(f"h{c}"))
    j = both.join(k("a"), "a", "left").join(k("b"), "b", "left")
    torn = lambda c: F.coalesce(F.col(f"h{c}") > F.col(f"l{c}"), F.lit(False))
    fits = ~torn("a") & ~torn("b") & F.coalesce(F.col("la") == F.col("lb"), F.lit(True))
    kept = j.where(~F.col("person") | ((F.col("ya") != "") & (F.col("yb") != "")) | fits)
    mark = lambda c: F.concat(F.lit("\x1e"), c).alias(c)
    return kept.select(mark("a"), mark("b"))
