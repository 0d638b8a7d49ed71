"""Quality of clusters and pairs: cluster metrics, threshold sweeps, labels from external ids, samples and intervals."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.scalars import harmonic_mean, phi4
from quillon.operators.claims import running_sums
from quillon.operators.clustering import components

#: External ids that are unique by themselves, and those unique within a jurisdiction.
UNIQUE = ("wikidataId", "leiCode", "opencorporatesId", "geonamesId")
SCOPED = ("registrationNumber",)
BAND = (0.5, 0.95)


def overlaps(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """``(gold, pred, n, gold_size, pred_size)`` of partitions ``(record, label)``; records missing in the prediction are alone."""
    j = gold.select("record", F.col("label").alias("gold")).join(predicted.select("record", F.col("label").alias("pred")), "record", "left")
    j = j.withColumn("pred", F.coalesce("pred", F.concat(F.lit("alone:"), "record")))
    n = j.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    g = n.groupBy("gold").agg(F.sum("n").alias("gold_size"))
    p = n.groupBy("pred").agg(F.sum("n").alias("pred_size"))
    return n.join(g, "gold").join(p, "pred")


def bcubed(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """B-cubed precision, recall and F1 in one row, from the contingency table alone."""
    o = overlaps(gold, predicted).agg(
        F.try_divide(F.sum(F.col("n") * F.col("n") / F.col("pred_size")), F.sum("n")).alias("precision"),
        F.try_divide(F.sum(F.col("n") * F.col("n") / F.col("gold_size")), F.sum("n")).alias("recall"),
    ).fillna(0.0)
    return o.withColumn("f1", harmonic_mean(F.col("precision"), F.col("recall")))


def over_merge_rate(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Share of predicted clusters that hold more than one gold label."""
    per = overlaps(gold, predicted).groupBy("pred").agg(F.count(F.lit(1)).alias("labels"))
    return per.agg(F.coalesce(F.avg((F.col("labels") >= 2).cast("double")), F.lit(0.0)).alias("over_merge_rate"))


def assign(weights: list[list[float]]) -> float:
    """Largest total weight of a one-to-one assignment (Hungarian method on the smaller side)."""
    rows = weights if len(weights) <= len(weights[0]) else [list(c) for c in zip(*weights)]
    n, m = len(rows), len(rows[0])
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = -rows[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return sum(rows[match[j] - 1][j - 1] for j in range(1, m + 1) if match[j])


def ceafe(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Entity-based CEAF in one row.

    Clusters without a record in common have likeness 0, so the assignment is
    solved within each connected part of the overlap graph, and is exact.
    """
    o = overlaps(gold, predicted)
    tag = o.withColumns({"g": F.concat(F.lit("g:"), F.col("gold").cast("string")), "p": F.concat(F.lit("p:"), F.col("pred").cast("string")), "w": phi4(F.col("n"), F.col("gold_size"), F.col("pred_size"))})
    part = components(tag, "g", "p").select(F.col("id").alias("g"), "root")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        gs, ps = pdf["g"].unique().tolist(), pdf["p"].unique().tolist()
        if len(gs) == 1 or len(ps) == 1:
            return pd.DataFrame({"w": [pdf["w"].max()]})
        m = [[0.0] * len(ps) for _ in gs]
        gi, pi = {g: i for i, g in enumerate(gs)}, {p: i for i, p in enumerate(ps)}
        for g, p, w in zip(pdf["g"], pdf["p"], pdf["w"]):
            m[gi[g]][pi[p]] = w
        return pd.DataFrame({"w": [assign(m)]})

    total = tag.join(part, "g").select("root", "g", "p", "w").groupBy("root").applyInPandas(solve, "w double").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("s"))
    sizes = o.agg(F.count_distinct("gold").alias("ng"), F.count_distinct("pred").alias("np"))
    both = total.withColumn("k", F.lit(1)).join(sizes.withColumn("k", F.lit(1)), "k")  # one row each
    out = both.select(F.coalesce(F.try_divide("s", "np"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("s", "ng"), F.lit(0.0)).alias("recall"))
    return out.withColumn("f1", harmonic_mean(F.col("precision"), F.col("recall")))


def floor(pairs: DataFrame, threshold: float) -> DataFrame:
    """Precision, recall, F1 and over-merge of scored labelled pairs ``(label, probability)`` at a threshold."""
    hit, true = F.col("probability") >= threshold, F.col("label") == "match"
    c = pairs.agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"))
    zero = F.lit(0.0)
    p = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), zero)
    r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), zero)
    return c.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), harmonic_mean(p, r).alias("f1"), F.coalesce(F.try_divide("fp", F.col("tp") + F.col("fp")), zero).alias("over_merge"))


def precision_recall(pairs: DataFrame) -> DataFrame:
    """``(threshold, tp, fp, fn)`` at each probability that occurs, ``>=``: running sums over the counts per probability."""
    true = F.col("label") == "match"
    per = pairs.groupBy(F.col("probability").alias("threshold")).agg(F.count_if(true).alias("tp"), F.count_if(~true).alias("fp"))
    run = running_sums(per, [F.desc("threshold")], ["tp", "fp"])
    every = pairs.agg(F.count_if(true).alias("all")).withColumn("k", F.lit(1))  # one row
    return run.withColumn("k", F.lit(1)).join(F.broadcast(every), "k").select("threshold", "tp", "fp", (F.col("all") - F.col("tp")).alias("fn"))


def recommended_threshold(table: DataFrame, false_merge: float = 10.0, false_split: float = 1.0) -> DataFrame:
    """The cheapest threshold; of equals the highest."""
    cost = F.lit(false_merge) * F.col("fp") + F.lit(false_split) * F.col("fn")
    return table.select("threshold", cost.alias("cost")).orderBy("cost", F.desc("threshold")).limit(1)


def labels_by_source(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("source", "label").agg(F.count(F.lit(1)).alias("pairs"))


def sufficiency(pairs: DataFrame) -> DataFrame:
    """Numbers of pairs, of distinct records, and the share in the band of doubt (half-open)."""
    n = pairs.agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("label") == "match").alias("matches"),
        F.coalesce(F.avg(((F.col("clerical_score") >= BAND[0]) & (F.col("clerical_score") < BAND[1])).cast("double")), F.lit(0.0)).alias("band_share"),
    )
    ids = pairs.select(F.explode(F.array("left_id", "right_id")).alias("id")).where("id is not null").agg(F.count_distinct("id").alias("records"))
    return n.withColumn("k", F.lit(1)).join(ids.withColumn("k", F.lit(1)), "k").drop("k")  # one row each


def gold_partition(pairs: DataFrame) -> DataFrame:
    """``(record, label)``: sets linked by matches, named by their smallest record; records of other pairs stand alone."""
    ids = pairs.select(F.explode(F.array("left_id", "right_id")).alias("record")).where("record is not null").distinct()
    roots = components(pairs.where(F.col("label") == "match")).select(F.col("id").alias("record"), "root")
    return ids.join(roots, "record", "left").select("record", F.coalesce("root", "record").alias("label"))


def predicted_partition(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """``(record, label)`` by the latest ledger row of each alias; unknown records are their own."""
    now = ledger.groupBy(F.col("canonical_alias").alias("record")).agg(F.max_by("canonical_id", F.struct("created_at", "canonical_id")).alias("c"))
    return records.select("record").distinct().join(now, "record", "left").select("record", F.coalesce("c", "record").alias("label"))


def canonical_pair(left: str = "left_id", right: str = "right_id"):
    return F.least(left, right).alias(left), F.greatest(left, right).alias(right)


def silver_pairs(entities: DataFrame) -> DataFrame:
    """Labels from external ids: ``(left_id, right_id, label)`` of entities that both state the same kind.

    A shared value of a unique kind, or of a scoped kind within one jurisdiction,
    speaks for a match, differing values against it; both at once say nothing, and a
    match needs two known, different sources.  The pairs of a kind with many
    holders are inherent in the definition: conflicts need pairs with different values.
    """
    p = F.col("props")
    none = F.array().cast("array<string>")
    real = lambda k: F.filter(F.coalesce(p[k], none), lambda v: v != "")
    jur = F.array_distinct(F.transform(F.array_union(real("jurisdiction"), real("country")), lambda v: F.lower(F.trim(v))))
    rows = entities.select("id", F.col("prov.source_id").alias("source"), jur.alias("jur"), F.explode(F.array(*(
        F.struct(F.lit(k).alias("kind"), real(k).alias("vs")) for k in (*UNIQUE, *SCOPED)
    ))).alias("a")).where(F.size("a.vs") > 0).select("id", "source", "jur", "a.kind", "a.vs")
    l, r = (rows.select("kind", *(F.col(c).alias(s + c) for c in ("id", "source", "jur", "vs"))) for s in ("l", "r"))
    j = l.join(r, "kind").where("lid < rid")
    counts = F.col("kind").isin(*UNIQUE) | F.arrays_overlap("ljur", "rjur")
    shared = F.arrays_overlap("lvs", "rvs")
    votes = j.where(counts).groupBy("lid", "rid").agg(
        F.bool_or(shared).alias("shared"), F.bool_or(~shared).alias("clash"), F.first("lsource").alias("ls"), F.first("rsource").alias("rs")
    )
    label = F.when(F.col("shared") & F.col("clash"), None).when(F.col("shared"), F.when(F.col("ls") != F.col("rs"), "match")).otherwise("non_match")
    return votes.select(F.col("lid").alias("left_id"), F.col("rid").alias("right_id"), label.alias("label")).where("label is not null")


def identity_keys(entities: DataFrame) -> DataFrame:
    """``(id, keys)``: an entity's id and all its external ids."""
    p = F.col("props")
    none = F.array().cast("array<string>")
    return entities.select("id", F.array_distinct(F.concat(F.array("id"), *(F.coalesce(p[k], none) for k in UNIQUE))).alias("keys"))


def drop_contaminated(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """Pairs ``(left_id, right_id, keys)`` none of whose keys is among ``keys (key)``."""
    bad = pairs.select("left_id", "right_id", F.explode("keys").alias("key")).join(keys.select("key"), "key", "left_semi").select("left_id", "right_id").distinct()
    return pairs.join(bad, ["left_id", "right_id"], "left_anti")


def visible_pairs(gold: DataFrame, candidates: DataFrame) -> DataFrame:
    """Gold pairs that blocking would compare."""
    c = candidates.select(F.least("id_l", "id_r").alias("left_id"), F.greatest("id_l", "id_r").alias("right_id"))
    return gold.select(*canonical_pair(), *(x for x in gold.columns if x not in ("left_id", "right_id"))).join(c, ["left_id", "right_id"], "left_semi")


def stratified_sample(scored: DataFrame, *, per: int = 4, strata: int = 3, seed: int = 42) -> DataFrame:
    """Some pairs of each stratum of the band of doubt, closed at both ends, labelled by its middle; a pair on a border counts once."""
    low, high = BAND
    width = (high - low) / strata
    borders = F.array(*(F.struct(F.lit(i).alias("stratum"), F.lit(low + i * width).alias("lo"), F.lit(low + (i + 1) * width).alias("hi")) for i in range(strata)))
    rows = scored.select("left_id", "right_id", "probability", F.explode(borders).alias("s")).where((F.col("probability") >= F.col("s.lo")) & (F.col("probability") <= F.col("s.hi")))
    k = F.row_number().over(W.partitionBy("s.stratum").orderBy(F.xxhash64(F.lit(seed), "left_id", "right_id"), "left_id", "right_id"))
    picked = rows.withColumn("k", k).where(F.col("k") <= per)
    label = F.when(F.col("probability") >= (low + high) / 2, "match").otherwise("non_match")
    return picked.select(*canonical_pair(), label.alias("label")).dropDuplicates(["left_id", "right_id"])


def with_hard_cases(pairs: DataFrame, hard: DataFrame) -> DataFrame:
    """Pairs with the hard cases in front: of one key the hard case stays."""
    both = hard.select("left_id", "right_id", "label", F.lit(0).alias("rank")).unionByName(pairs.select("left_id", "right_id", "label", F.lit(1).alias("rank")))
    return both.groupBy("left_id", "right_id").agg(F.min_by("label", "rank").alias("label")).orderBy("left_id", "right_id")


def bootstrap(gold: DataFrame, predicted: DataFrame, *, draws: int = 200, seed: int = 42) -> DataFrame:
    """``(metric, low, high)``: 95 % intervals of B-cubed by drawing gold clusters with replacement, each draw a set.

    A gold cluster is in a draw with the chance that it is drawn at least once in
    as many draws as there are clusters; one pass over the contingency table serves all draws.
    """
    o = overlaps(gold, predicted).select("gold", "pred", "n", "gold_size")
    n = max(1, gold.select("label").distinct().count())
    chance = 1 - (1 - 1 / n) ** n
    rows = o.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    u = F.pmod(F.xxhash64(F.lit(seed), "draw", "gold"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    kept = rows.where(u < chance)
    sizes = kept.groupBy("draw", "pred").agg(F.sum("n").alias("ps"))
    per = kept.join(sizes, ["draw", "pred"]).groupBy("draw").agg(
        F.try_divide(F.sum(F.col("n") * F.col("n") / F.col("ps")), F.sum("n")).alias("precision"), F.try_divide(F.sum(F.col("n") * F.col("n") / F.col("gold_size")), F.sum("n")).alias("recall")
    )
    per = per.withColumn("f1", harmonic_mean(F.col("precision"), F.col("recall")))
    longer = per.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in ("precision", "recall", "f1")))).alias("s")).select("s.metric", "s.x")
    return longer.groupBy("metric").agg(F.percentile("x", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select("metric", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def labelled_pairs(raw: DataFrame) -> DataFrame:
    """Labelled pairs from JSON lines ``(value)``: judgements positive and negative, all else is dropped."""
    ent = "struct<id:string,schema:string,properties:map<string,array<string>>>"
    p = raw.select(F.from_json("value", f"left {ent}, right {ent}, judgement string").alias("p"))
    label = F.when(F.col("p.judgement") == "positive", "match").when(F.col("p.judgement") == "negative", "non_match")
    return p.where("p.left.id is not null and p.right.id is not null").select("p.left", "p.right", label.alias("label")).where("label is not null")


HARD = tuple((a, b, l) for a, b, l in itertools.chain([("h1", "h2", "match"), ("h3", "h4", "non_match")]))
