"""Clusters of scored pairs under human judgements, merged entities and the merge guard."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon import ontology as O
from quillon.functions.scalars import canonical_id
from quillon.runtime import drop_table, table

MERGE = 0.92


def components(pairs: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """``(id, root)`` of linked ids, root the smallest of each set.

    Each round every id takes the smallest root among its own and its
    partners', then the root's root; both are aggregations with a map-side part,
    so a hub costs no more than its distinct partners.
    """
    e = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    both = table(e.select(F.col(left).alias("a"), F.col(right).alias("b")).unionByName(e.select(F.col(right).alias("a"), F.col(left).alias("b"))).distinct(), "both")
    now = table(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("root")).withColumnRenamed("a", "id"), "roots")
    while True:
        near = both.join(now.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        hooked = now.join(near, "id", "left").select("id", "root", F.least("root", F.coalesce("near", "root")).alias("best"))
        # the old root follows too, so that trees join and do not only grow at their edge
        lower = hooked.groupBy(F.col("root").alias("id")).agg(F.min("best").alias("low"))
        moved = hooked.select("id", F.col("best").alias("r")).join(lower, "id", "left").select("id", F.least("r", F.coalesce("low", "r")).alias("r"))
        jumped = table(moved.alias("m").join(moved.select(F.col("id").alias("r"), F.col("r").alias("rr")), "r", "left").select("id", F.coalesce("rr", "r").alias("root")), "roots")
        done = jumped.join(now, ["id", "root"], "left_anti").isEmpty()
        drop_table(now)
        now = jumped
        if done:
            return now


def approved_groups(judgements: DataFrame) -> DataFrame:
    return components(judgements.where(F.col("judgement") == "positive"))


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """Strongest first within one component; a link across a negative judgement is left out."""
    ids = sorted({*pdf["left_id"], *pdf["right_id"]})
    parent = {i: i for i in ids}
    foes: dict[str, set[str]] = {i: set() for i in ids}

    def find(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a: str, b: str) -> None:
        a, b = find(a), find(b)
        if a != b:
            parent[b] = a
            foes[a] |= foes.pop(b)

    told = set()
    for r in pdf[pdf["kind"] == "positive"].itertuples():
        join(r.left_id, r.right_id)
        told.add(frozenset((r.left_id, r.right_id)))
    for r in pdf[pdf["kind"] == "negative"].itertuples():
        foes[find(r.left_id)].add(r.right_id)
        foes[find(r.right_id)].add(r.left_id)
        told.add(frozenset((r.left_id, r.right_id)))
    for r in pdf[pdf["kind"] == "pair"].sort_values(["probability", "left_id", "right_id"], ascending=[False, True, True]).itertuples():
        if frozenset((r.left_id, r.right_id)) in told:
            continue
        a, b = find(r.left_id), find(r.right_id)
        if a == b or any(find(x) == b for x in foes[a]) or any(find(x) == a for x in foes[b]):
            continue
        join(a, b)
    return pd.DataFrame({"id": ids, "root": [find(i) for i in ids]})


def cluster(entities: DataFrame, pairs: DataFrame, judgements: DataFrame | None = None, *, threshold: float = MERGE) -> DataFrame:
    """``(canonical_id, member_id, score)``, a row per entity id.

    Pairs at the threshold link; people's judgements come first and are never
    overruled, and a negative one holds transitively.  Components without a
    negative judgement are final as they are; only those with one are settled
    pair by pair, each as a group of its own.  The score is the weakest pair
    within a cluster, 1 where there is none.
    """
    ids = entities.select("id").distinct()
    strong = table(pairs.where(F.col("probability") >= threshold).select("left_id", "right_id", "probability", F.lit("pair").alias("kind")), "strong")
    links = strong
    if judgements is not None:
        known = ids.select(F.col("id").alias("left_id"))
        j = judgements.join(known, "left_id", "left_semi").join(ids.select(F.col("id").alias("right_id")), "right_id", "left_semi")
        j = j.select("left_id", "right_id", F.lit(1.0).alias("probability"), F.col("judgement").alias("kind"))
        links = table(strong.unionByName(j), "links")
    parts = components(links.where("kind != 'negative'"))
    if judgements is None:
        return _scored_sets(ids, parts, strong)
    torn = links.where("kind = 'negative'").join(parts.select(F.col("id").alias("left_id"), F.col("root").alias("rl")), "left_id").join(
        parts.select(F.col("id").alias("right_id"), F.col("root").alias("rr")), "right_id"
    ).where("rl = rr").select(F.col("rl").alias("root")).distinct()
    torn = table(torn, "torn")
    inside = links.join(parts.select(F.col("id").alias("left_id"), "root"), "left_id").join(torn, "root", "left_semi")
    settled = inside.groupBy("root").applyInPandas(_greedy, "id string, root string")
    roots = parts.join(torn, "root", "left_anti").select("id", "root").unionByName(settled)
    return _scored_sets(ids, table(roots, "roots"), strong)


def _scored_sets(ids: DataFrame, roots: DataFrame, strong: DataFrame) -> DataFrame:
    placed = ids.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    sets = placed.groupBy("root").agg(F.array_sort(F.collect_list("id")).alias("members"))
    r = lambda c, o: roots.select(F.col("id").alias(c), F.col("root").alias(o))
    weakest = strong.join(r("left_id", "root"), "left_id").join(r("right_id", "r2"), "right_id").where("root = r2").groupBy("root").agg(F.min("probability").alias("score"))
    return sets.join(weakest, "root", "left").select(canonical_id(F.col("members")).alias("canonical_id"), F.explode("members").alias("member_id"), F.coalesce("score", F.lit(1.0)).alias("score"))


def merge_entities(clusters: DataFrame, entities: DataFrame) -> DataFrame:
    """Clusters as entities: the union of values and datasets, the common schema, the first member's provenance.

    Members are taken in id order; one without a schema in common with those
    before it stays an entity of its own, and the rest gets a new id of what was merged.
    """
    m = clusters.select("canonical_id", F.col("member_id").alias("id")).join(entities, "id")
    order = m.groupBy("canonical_id").agg(F.array_sort(F.collect_list(F.struct("id", "schema"))).alias("ms"))
    pairs = O.common_pairs()
    common = F.create_map(*[x for a, b, c in pairs for x in (F.lit(f"{a}|{b}"), F.lit(c))])
    start = F.struct(F.get("ms", F.lit(0))["schema"].alias("schema"), F.array().cast("array<string>").alias("kept"))
    kept = F.aggregate("ms", start, lambda acc, x: F.when(
        (acc["schema"] == x["schema"]) | F.try_element_at(common, F.concat_ws("|", acc["schema"], x["schema"])).isNotNull(),
        F.struct(F.coalesce(F.try_element_at(common, F.concat_ws("|", acc["schema"], x["schema"])), acc["schema"]).alias("schema"), F.array_append(acc["kept"], x["id"]).alias("kept")),
    ).otherwise(acc))
    k = order.select("canonical_id", kept.alias("k"), F.size("ms").alias("n")).select("canonical_id", F.col("k.schema").alias("merged_schema"), F.col("k.kept").alias("kept"), "n")
    j = m.join(k, "canonical_id").withColumn("in", F.array_contains("kept", F.col("id")))
    j = j.withColumn("new_id", F.when(~F.col("in"), F.col("id")).when(F.size("kept") == F.col("n"), F.col("canonical_id")).otherwise(canonical_id(F.col("kept")))).withColumn("new_schema", F.when(F.col("in"), F.col("merged_schema")).otherwise(F.col("schema")))
    values = j.select("new_id", F.explode("props").alias("prop", "vs")).select("new_id", "prop", F.explode("vs").alias("v")).groupBy("new_id", "prop").agg(F.array_sort(F.collect_set("v")).alias("vs"))
    props = values.groupBy("new_id").agg(F.map_from_entries(F.collect_list(F.struct("prop", "vs"))).alias("props"))
    heads = j.groupBy("new_id").agg(
        F.first("new_schema").alias("schema"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("datasets")))).alias("datasets"), F.min_by("prov", "id").alias("prov"), F.array_sort(F.collect_list("id")).alias("members"),
    )
    return heads.join(props, "new_id", "left").select(F.col("new_id").alias("id"), "schema", F.coalesce("props", F.create_map().cast("map<string,array<string>>")).alias("props"), "datasets", "prov", "members")


def needs_review(clusters: DataFrame, entities: DataFrame, conflicts: DataFrame, near_risk: DataFrame | None = None, *, largest: int = 10, band: tuple[float, float] = (0.92, 0.92)) -> DataFrame:
    """``(canonical_id, flagged, reason)`` of merges: size, sensitive member, conflicting ids, risk nearby, doubtful score; the first that holds."""
    m = clusters.join(entities.select(F.col("id").alias("member_id"), F.col("props")["topics"].alias("topics")), "member_id", "left")
    if near_risk is not None:
        m = m.join(near_risk.select(F.col("id").alias("member_id"), F.col("flagged").alias("near")), "member_id", "left")
    else:
        m = m.withColumn("near", F.lit(False))
    g = m.groupBy("canonical_id").agg(
        F.count_distinct("member_id").alias("n"), F.min(F.when(O.is_sensitive(F.col("topics")), F.col("member_id"))).alias("sensitive"),
        F.min(F.when(F.col("near"), F.col("member_id"))).alias("near"), F.max("score").alias("score"),
    ).where("n > 1")
    c = conflicts.groupBy("canonical_id").agg(F.concat_ws("; ", F.array_sort(F.collect_list(F.concat("field", F.lit(": "), F.concat_ws(", ", "values"))))).alias("conflict"))
    g = g.join(c, "canonical_id", "left")
    reason = (
        F.when(F.col("n") > largest, F.concat(F.lit("size "), F.col("n").cast("string")))
        .when(F.col("sensitive").isNotNull(), F.concat(F.lit("sensitive member "), "sensitive"))
        .when(F.col("conflict").isNotNull(), F.concat(F.lit("conflicting ids "), "conflict"))
        .when(F.col("near").isNotNull(), F.concat(F.lit("risk near "), "near"))
        .when((F.col("score") >= band[0]) & (F.col("score") < band[1]), F.lit("doubtful score"))
    )
    return g.select("canonical_id", reason.isNotNull().alias("flagged"), F.coalesce(reason, F.lit("")).alias("reason"))


def judgement_pairs(members: Column) -> Column:
    """All pairs of a reviewed set of members (at most some tens), smaller first."""
    s = F.array_sort(F.array_distinct(members))
    return F.flatten(F.transform(s, lambda a: F.transform(F.filter(s, lambda b: b > a), lambda b: F.struct(a.alias("left_id"), b.alias("right_id")))))
