"""Probabilistic matching of entities: flat rows, blocking, comparison levels and posteriors."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon import ontology as O
from quillon.functions.close_names import CloseNames
from quillon.functions.python_udfs import jaro_winkler, name_fingerprint
from quillon.functions.scalars import first_value
from quillon.runtime import table
from quillon.schema import ANCHORS

PRIOR = 0.001
PREDICT = 0.5
# Chances of each level among matches and others.
NAME = ((0.99, 0.0001), (0.88, 0.003), (0.6, 0.03), (0.04, 0.95))
NAME_EDGES = (0.92, 0.82)
COUNTRY = (0.85, 0.15)
BIRTH = (0.9, 0.02)
WIKIDATA = (0.999, 0.02)
REG_SHARED, REG_CLASH = (0.95, 0.01), (0.0005, 0.30)
ANCHOR_CLASH = (0.0005, 0.30)


def flatten(entities: DataFrame) -> DataFrame:
    """Matching rows: name key, first country, birth date, wikidata id, registration numbers, one value per anchor.

    Absent numbers and anchors are empty, other absent fields null.
    """
    p = F.col("props")
    none = F.array().cast("array<string>")
    clean = lambda v: F.upper(F.regexp_replace(v, r"[\s./-]", ""))
    regs = F.array_sort(F.array_distinct(F.filter(F.transform(F.array_union(F.coalesce(p["registrationNumber"], none), F.coalesce(p["taxNumber"], none)), clean), lambda v: v != "")))
    country = F.coalesce(first_value(p, "country"), first_value(p, "jurisdiction"), first_value(p, "nationality"))
    anchors = [F.coalesce(F.get(F.filter(F.coalesce(F.col("anchors")[a], none), lambda v: v != ""), F.lit(0)), F.lit("")).alias(f"anchor_{a}") for a in ANCHORS]
    return entities.where(O.matchable(F.col("schema"))).select(
        "id", "schema", name_fingerprint(first_value(p, "name")).alias("name_fp"), country.alias("country"), first_value(p, "birthDate").alias("birth_date"),
        first_value(p, "wikidataId").alias("wikidata_id"), regs.alias("reg_ids"), *anchors,
    )


def _named_keys(keys: dict[str, Column] | None) -> dict[str, Column]:
    return keys or {"c": F.col("country"), "n": F.when(F.col("name_fp") != "", F.substring("name_fp", 1, 4)), "w": F.col("wikidata_id")}


def _keys(keys: dict[str, Column] | None) -> Column:
    return F.array_compact(F.array(*(F.when(k.isNotNull(), F.concat(F.lit(f"{t}:"), k)) for t, k in _named_keys(keys).items())))


def _parts(rows: DataFrame) -> int:
    spark = rows.sparkSession
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _block(rows: DataFrame, keys: dict[str, Column] | None, columns: list[str], block_rows: int = 1000) -> DataFrame:
    """Pairs of rows with their columns suffixed ``_l`` and ``_r``, each pair once.

    One equi-join over the exploded keys; a pair is kept under the first key that
    both have, so no second shuffle has to make the pairs distinct.  A block of
    more than ``block_rows`` rows is salted: its left rows are dealt out to
    several parts and its right rows are in each, so that no task holds all
    pairs of a hot key.
    """
    k = rows.select(*columns, _keys(keys).alias("ks")).select("*", F.explode("ks").alias("k"))
    hot = k.groupBy("k").count().where(F.col("count") > block_rows).select("k", F.ceil(F.col("count") / block_rows).cast("int").alias("parts"))
    k = k.join(hot, "k", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    side = lambda s, salt: k.select("k", salt.alias("salt"), *(F.col(c).alias(c + s) for c in (*columns, "ks")))
    n = _parts(rows)
    first = F.get(F.array_intersect("ks_l", "ks_r"), F.lit(0))
    # few rows make many pairs: the number of parts follows the pairs, not the bytes of the rows
    l, r = side("_l", own).repartition(n, "k", "salt"), side("_r", every).repartition(n, "k", "salt")
    return l.join(r, ["k", "salt"]).where((F.col("id_l") < F.col("id_r")) & (first == F.col("k"))).drop("k", "salt", "ks_l", "ks_r")


def candidate_pairs(rows: DataFrame, keys: dict[str, Column] | None = None) -> DataFrame:
    """``(id_l, id_r)`` of rows that share any key, each pair once; null keys never meet."""
    return _block(rows, keys, ["id"])


def count_pairs(rows: DataFrame, by: Column, keys: dict[str, Column] | None = None) -> DataFrame:
    """``(by, n)``: the number of distinct pairs of :func:`candidate_pairs` by an expression of the smaller id, without making the pairs.

    The pairs that share any key are those that share a set of keys, summed over
    all sets with the sign of inclusion and exclusion.  A row has as many pairs
    under a set as rows with greater ids have its values: ids are laid out in
    ranges, a row is numbered within its range and the counts of later ranges are
    added.  The work is in proportion to the rows.  Ids with several key sets,
    which this rule would count twice, are joined with their partners instead.
    """
    names = _named_keys(keys)
    flat = rows.where("id is not null").select("id", F.array(*names.values()).alias("ks")).groupBy("id").agg(F.collect_set("ks").alias("kss"))
    ranged = flat.repartitionByRange(_parts(rows), "id").withColumn("part", F.spark_partition_id())
    held = table(ranged.select("id", by.alias("by"), "part", F.size("kss").alias("many"), F.explode("kss").alias("ks")), "ranged")

    at = range(len(names))
    sets = [c for k in at for c in combinations(at, k + 1)]
    value = lambda c: [F.col("ks")[i] for i in c]
    whole = lambda c: F.when(~F.array_contains(F.transform(F.array(*value(c)), lambda v: v.isNull()), True), F.struct(F.lit(1 if len(c) % 2 else -1).alias("sign"), F.array(F.lit(str(sets.index(c))), *value(c)).alias("key")))
    one = held.where("many = 1").select("part", "id", "by", F.inline(F.array_compact(F.array(*map(whole, sets)))))
    numbered = one.withColumn("k", F.row_number().over(W.partitionBy("part", "key").orderBy(F.desc("id"))) - 1)
    cells = table(numbered.groupBy("part", "key", "sign", "by").agg(F.count(F.lit(1)).alias("rows"), F.sum("k").alias("k")), "cells")
    after = W.partitionBy("key").orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    later = cells.groupBy("part", "key").agg(F.sum("rows").alias("rows")).select("part", "key", F.coalesce(F.sum("rows").over(after), F.lit(0)).alias("later"))
    n = F.sum(F.col("sign") * (F.col("k") + F.col("rows") * F.col("later"))).alias("n")
    single = cells.join(later, ["part", "key"]).groupBy("by").agg(n)

    keyed = held.select("id", "by", "many", F.posexplode("ks").alias("t", "k")).where("k is not null")
    side = lambda df, s: df.select("t", "k", *(F.col(c).alias(c + s) for c in ("id", "by", "many")))
    met = side(keyed.where("many > 1"), "_a").join(side(keyed, "_b"), ["t", "k"]).where("id_a <> id_b")
    least = F.col("id_a") < F.col("id_b")
    pairs = met.select(F.least("id_a", "id_b").alias("l"), F.greatest("id_a", "id_b").alias("r"), F.when(least, F.col("by_a")).otherwise(F.col("by_b")).alias("by")).distinct()
    return single.unionByName(pairs.groupBy("by").agg(F.count(F.lit(1)).alias("n"))).groupBy("by").agg(F.sum("n").alias("n")).where("n > 0")


def _factor(level: tuple[float, float]) -> Column:
    return F.lit(level[0] / level[1])


def _sides(l: str, r: str):
    return (lambda c: F.col(c + l)), (lambda c: F.col(c + r))


def name_factor(l: str = "_l", r: str = "_r") -> Column:
    """Factor of the names, by ``jw`` where they differ; a missing name is neutral."""
    x, y = _sides(l, r)
    return (
        F.when(x("name_fp").isNull() | y("name_fp").isNull(), 1.0).when(x("name_fp") == y("name_fp"), _factor(NAME[0]))
        .when(F.col("jw") >= NAME_EDGES[0], _factor(NAME[1])).when(F.col("jw") >= NAME_EDGES[1], _factor(NAME[2])).otherwise(_factor(NAME[3]))
    )


def other_factors(l: str = "_l", r: str = "_r") -> Column:
    """Product of the factors of all comparisons but the name; a missing value is neutral."""
    x, y = _sides(l, r)

    def exact(c: str, mu: tuple[float, float]) -> Column:
        m, u = mu
        return F.when(x(c).isNull() | y(c).isNull(), 1.0).when(x(c) == y(c), m / u).otherwise((1 - m) / (1 - u))

    reg = F.when((F.size(x("reg_ids")) == 0) | (F.size(y("reg_ids")) == 0), 1.0).when(F.arrays_overlap(x("reg_ids"), y("reg_ids")), _factor(REG_SHARED)).otherwise(_factor(REG_CLASH))
    clash = F.lit(False)
    for a in ANCHORS:
        c = f"anchor_{a}"
        clash = clash | ((x(c) != "") & (y(c) != "") & (x(c) != y(c)))
    anchor = F.when(clash, _factor(ANCHOR_CLASH)).otherwise(1.0)
    return exact("country", COUNTRY) * exact("birth_date", BIRTH) * exact("wikidata_id", WIKIDATA) * reg * anchor


def score_pairs(rows: DataFrame, *, prior: float = PRIOR, predict: float = PREDICT, keys: dict[str, Column] | None = None) -> DataFrame:
    """``(left_id, right_id, probability)`` of the candidate pairs of compatible schemata that reach ``predict``.

    The other comparisons come first, in Catalyst: a pair that could not reach
    ``predict`` with the best factor that unequal names can have is dropped, so
    the string distance is asked for few pairs, and only of comparable length.
    """
    both = _block(rows, keys, rows.columns)
    compat = O.compatibility(rows.sparkSession).select(F.col("schema_l"), F.col("schema_r"))
    both = both.join(F.broadcast(compat), ["schema_l", "schema_r"], "left_semi")  # below 300 rows by construction
    x, y = F.col("name_fp_l"), F.col("name_fp_r")
    unequal = x.isNotNull() & y.isNotNull() & (x != y)
    rest = F.lit(prior / (1 - prior)) * other_factors()
    need = predict / (1 - predict)
    best = F.when(x.isNull() | y.isNull(), 1.0).when(unequal, _factor(NAME[1])).otherwise(_factor(NAME[0]))
    both = both.withColumn("rest", rest).where(F.col("rest") * best >= need * (1 - 1e-9))
    far = F.greatest(F.length(x), F.length(y)) > 3 * F.least(F.length(x), F.length(y))
    asked = both.withColumn("_a", F.when(unequal & ~far, x)).withColumn("jw", F.coalesce(jaro_winkler(F.col("_a"), y), F.lit(0.0)))
    odds = F.col("rest") * name_factor()
    return asked.select(F.col("id_l").alias("left_id"), F.col("id_r").alias("right_id"), (odds / (1 + odds)).alias("probability")).where(F.col("probability") >= predict)


def gamma_levels(both: DataFrame) -> DataFrame:
    """Comparison levels of joined pairs with ``jw``: the sufficient counts for training."""
    eq = lambda c: F.when(F.col(c + "_l").isNull() | F.col(c + "_r").isNull(), -1).when(F.col(c + "_l") == F.col(c + "_r"), 1).otherwise(0)
    name = F.when(F.col("name_fp_l").isNull() | F.col("name_fp_r").isNull(), -1).when(F.col("name_fp_l") == F.col("name_fp_r"), 3).when(F.col("jw") >= 0.92, 2).when(F.col("jw") >= 0.82, 1).otherwise(0)
    return both.groupBy(name.alias("g_name"), eq("country").alias("g_country"), eq("birth_date").alias("g_birth"), eq("wikidata_id").alias("g_wikidata")).count()


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers of the values of a column, -1 where there is none."""
    return pc.fill_null(column.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _counted(counts: dict[tuple[int, ...], int]) -> pa.Table:
    got = [(*g, n) for g, n in counts.items() if n]
    return pa.Table.from_arrays([pa.array([r[i] for r in got], pa.int64() if c == "n" else pa.int32()) for i, c in enumerate([*TRAINED, "n"])], names=[*TRAINED, "n"])


def _block_totals(block: pa.Table) -> pa.Table:
    """Counts of the levels over the pairs of one block, all unequal names as different.

    No pair is made: the pairs with any values, with known ones and with equal ones of each
    field follow from the sizes of groups of rows, and their differences are the levels.  Pairs that
    share an id or an earlier key are taken off by inclusion and exclusion.
    """
    ident, fields = _codes(block.column("id")), [_codes(block.column(c)) for c in ("name_fp", *FIELDS)]
    off = [_codes(block.column(f"k{i}")) for i in range(block.column("t")[0].as_py())]
    off += [ident] if len(np.unique(ident)) < len(ident) else []
    n = np.zeros([3] * len(fields), np.int64)  # any, known, equal

    def within(rows: np.ndarray, group: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = c[rows] >= 0
        rows = rows[known]
        return rows, np.unique(group[known] * (int(c.max(initial=0)) + 1) + c[rows], return_inverse=True)[1]

    def pairs(rows: np.ndarray, group: np.ndarray, less: list[np.ndarray]) -> int:
        if len(rows) < 2:
            return 0
        if less:
            return pairs(rows, group, less[1:]) - pairs(*within(rows, group, less[0]), less[1:])
        size = np.bincount(group)
        return int((size * (size - 1) // 2).sum())

    def fill(state: tuple[int, ...], rows: np.ndarray, group: np.ndarray) -> None:
        if len(rows) < 2:
            return
        if len(state) == len(fields):
            n[state] = pairs(rows, group, off)
            return
        c = fields[len(state)]
        known = c[rows] >= 0
        fill((*state, 1), rows[known], group[known])
        fill((*state, 2), *within(rows, group, c))
        if known.all():
            n[(*state, 0)] = n[(*state, 1)]
        else:
            fill((*state, 0), rows, group)

    fill((), np.arange(len(ident)), np.zeros(len(ident), np.int64))
    for f in range(len(fields)):
        of, known, equal = np.moveaxis(n, f, 0).copy()
        n = np.stack([of - known, known - equal, equal], f)
    tops = [k - 1 for k in TRAINED.values()]
    return _counted({tuple((-1, 0, top)[x] for x, top in zip(at, tops)): int(n[tuple(at)]) for at in np.argwhere(n)})


def _close_levels(cell: pa.Table) -> pa.Table:
    """What the levels of one cell of a block change by the pairs with names that are unequal but close."""
    t, i, j = (cell.column(c)[0].as_py() for c in ("t", "i", "j"))
    text = cell.column("name_fp").to_pylist()
    names = sorted(set(text))
    place = {v: k for k, v in enumerate(names)}
    name, part = np.array([place[v] for v in text]), cell.column("p").to_numpy()
    ident = _codes(cell.column("id"))
    fields, off = [_codes(cell.column(c)) for c in FIELDS], [_codes(cell.column(f"k{x}")) for x in range(t)]
    by = np.argsort(name, kind="stable")
    many = np.bincount(name, minlength=len(names))
    start = np.cumsum(many) - many
    close = CloseNames(names, NAME_EDGES)
    of = np.zeros(len(names), np.int64)
    of[name] = part
    a, b = np.flatnonzero(of == i), np.flatnonzero(of == j)
    key = np.cumsum([x == 0 or names[x][:4] != names[x - 1][:4] for x in range(len(names))])
    found = close.unlike(a, None if i == j else b, key) if t else close.alike(a, None if i == j else b)
    kinds = 3 ** len(FIELDS)
    total = np.zeros(3 * kinds, np.int64)

    def count(p: np.ndarray, q: np.ndarray, level: np.ndarray) -> None:
        keep = ident[p] != ident[q]
        for k in off:  # the pairs that share an earlier key are counted there
            keep &= (k[p] != k[q]) | (k[p] < 0)
        p, q, kind = p[keep], q[keep], level[keep].astype(np.int64)
        for f in fields:
            x, y = f[p], f[q]
            kind = kind * 3 + np.where((x < 0) | (y < 0), 0, 1 + (x == y))
        total[:] += np.bincount(kind, minlength=len(total))

    def rows(first: np.ndarray, second: np.ndarray, level: np.ndarray) -> None:
        n = many[first] * many[second]
        if (n == 1).all():
            count(by[start[first]], by[start[second]], level)
            return
        lot = np.cumsum(n) // ROWS
        for g in np.split(np.arange(len(n)), np.flatnonzero(np.diff(lot)) + 1):
            for at in range(0, int(n[g].sum()), ROWS):  # a pair of names may have more pairs of rows than fit
                k = np.arange(at, min(at + ROWS, int(n[g].sum())))
                pair = np.searchsorted(np.cumsum(n[g]), k, "right")
                k, pair = k - (np.cumsum(n[g]) - n[g])[pair], g[pair]
                count(by[start[first[pair]] + k // many[second[pair]]], by[start[second[pair]] + k % many[second[pair]]], level[pair])

    held, size = [], 0
    for f in found:
        held.append(f)
        size += len(f[0])
        if size > 1 << 18:
            rows(*(np.concatenate(x) for x in zip(*held)))
            held, size = [], 0
    if size:
        rows(*(np.concatenate(x) for x in zip(*held)))
    counts: dict[tuple[int, ...], int] = {}
    for at in np.flatnonzero(total).tolist():
        kind = tuple(at // 3 ** (len(FIELDS) - 1 - k) % 3 - 1 for k in range(len(FIELDS)))
        counts[(at // kinds, *kind)] = int(total[at])
        counts[(0, *kind)] = counts.get((0, *kind), 0) - int(total[at])
    return _counted(counts)


def block_levels(rows: DataFrame, block_rows: int = 4000) -> DataFrame:
    """:func:`gamma_levels` over all candidate pairs, which are never made as rows.

    The levels but for those of close names follow from the sizes of groups in each block.
    Close names are looked for among the names of a block, once each: a block of more than
    ``block_rows`` rows (four times as many where most pairs are left out sooner) is dealt by name
    to parts, and each two parts meet in one cell. A pair counts under the first key that it shares, that of the beginning of the name first.
    """
    named = _named_keys(None)
    keys = [named[k] for k in ("n", "c", "w")]
    base = rows.where("id is not null").select("id", "name_fp", *FIELDS, *(k.alias(f"k{i}") for i, k in enumerate(keys)))
    k = base.select("*", F.posexplode(F.array(*(f"k{i}" for i in range(len(keys))))).alias("t", "k")).where("k is not null")
    levels = ", ".join(f"{g} int" for g in TRAINED) + ", n long"
    n = 4 * _parts(rows)
    totals = k.repartition(n, "t", "k").groupBy("t", "k").applyInArrow(_block_totals, levels)

    spelled = k.where("name_fp <> ''")
    limit = F.when(F.col("t") == 0, block_rows).otherwise(4 * block_rows)
    size = spelled.groupBy("t", "k").count().where("count > 1").select("t", "k", F.ceil(F.col("count") / limit).cast("int").alias("parts"))
    laid = spelled.join(size, ["t", "k"]).withColumn("p", F.pmod(F.xxhash64("name_fp"), F.col("parts")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = ["t", "k", "i", "j"]
    cells = laid.withColumns({"i": F.least("p", "q"), "j": F.greatest("p", "q")}).drop("parts", "q").repartition(n, *cell)
    close = cells.groupBy(*cell).applyInArrow(_close_levels, levels)
    return totals.unionByName(close).groupBy(*TRAINED).agg(F.sum("n").alias("count")).where("count > 0")


def train(counts: DataFrame, u: dict[str, list[float]], *, rounds: int = 25, prior: float = PRIOR) -> dict[str, list[float]]:
    """Match chances of the levels by expectation-maximization over pattern counts (at most 5 * 3**3 rows)."""
    rows = [(tuple(r)[:-1], r["count"]) for r in counts.select(*u, "count").collect()]
    m = {f: [(i + 1) / sum(range(1, len(us) + 1)) for i in range(len(us))] for f, us in u.items()}
    p = prior
    for _ in range(rounds):
        acc = {f: [1e-6] * len(us) for f, us in u.items()}
        got = total = 0.0
        for v, n in rows:
            a, b = math.log(p), math.log(1 - p)
            for f, x in zip(u, v):
                if x >= 0:
                    a, b = a + math.log(m[f][x]), b + math.log(max(u[f][x], 1e-9))
            g = n / (1 + math.exp(max(-500, min(500, b - a))))
            got, total = got + g, total + n
            for f, x in zip(u, v):
                if x >= 0:
                    acc[f][x] += g
        m = {f: [x / sum(xs) for x in xs] for f, xs in acc.items()}
        p = min(0.999, max(1e-6, got / max(total, 1)))
    return m


#: Levels of the trained comparisons, from different to equal.
TRAINED = {"g_name": 4, "g_country": 2, "g_birth": 2, "g_wikidata": 2}
#: Fields of the trained comparisons after the name, in that order.
FIELDS = ("country", "birth_date", "wikidata_id")
#: Pairs of rows that a cell lays out at once.
ROWS = 1 << 20


def train_on(rows: DataFrame, *, prior: float = PRIOR, draws: int = 8, seed: int = 42) -> tuple[dict[str, list[float]], dict[str, list[float]]]:
    """``(m, u)`` of the levels: u from pairs drawn by hash over all rows, m by expectation-maximization over the candidate pairs.

    Each row is drawn with ``draws`` others, in as many deals of all rows into
    hash buckets of about two; such pairs are unrelated but for a share too small to matter.
    """
    n = max(2, rows.count())
    dealt = rows.withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), "_d", "id"), F.lit(max(1, n // 2))))
    side = lambda s: dealt.select("_d", "_b", *(F.col(c).alias(c + s) for c in rows.columns))
    drawn = side("_l").join(side("_r"), ["_d", "_b"]).where("id_l < id_r")

    def levels(both: DataFrame) -> DataFrame:
        x, y = F.col("name_fp_l"), F.col("name_fp_r")
        return gamma_levels(both.withColumn("jw", F.coalesce(jaro_winkler(F.when(x != y, x), y), F.lit(0.0))))

    u = {f: [1.0] * k for f, k in TRAINED.items()}
    for r in levels(drawn).collect():  # at most 5 * 3**3 rows
        for f in TRAINED:
            if r[f] >= 0:
                u[f][r[f]] += r["count"]
    u = {f: [x / sum(xs) for x in xs] for f, xs in u.items()}
    return train(block_levels(rows), u, prior=prior), u
