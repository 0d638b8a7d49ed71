"""The claim log: statements, decisions, ledger, alias closure and the fold into entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon import ontology as O
from quillon.functions.scalars import anchor_id, first_value
from quillon.runtime import drop_table, table
from quillon.schema import ANCHORS, EXISTS

NUL = "\0"


def member_source(prov: Column, own: Column) -> Column:
    return F.coalesce(F.nullif(prov["source_id"], F.lit("")), own)


def statements(clusters: DataFrame, entities: DataFrame) -> DataFrame:
    """Claim rows of the members of clusters ``(canonical_id, member_id)``: one per property and value.

    A member without a source makes no claim; a member without any property
    makes one that says that it exists.
    """
    m = clusters.select("canonical_id", F.col("member_id").alias("id")).join(entities, "id")
    m = m.where(F.coalesce(F.col("prov.source_id") != "", F.lit(False)))
    base = ["canonical_id", F.col("id").alias("entity_id"), "schema"]
    prov = [F.col("prov.source_id").alias("dataset"), F.col("prov.reliability").alias("reliability"), F.col("prov.retrieved_at").alias("retrieved_at"), F.col("prov.source_record").alias("raw_pointer")]
    filled = F.map_filter(F.coalesce("props", F.create_map().cast("map<string,array<string>>")), lambda k, v: F.size(v) > 0)
    rows = m.select(*base, F.explode(filled).alias("prop", "vs"), *prov).select("*", F.explode("vs").alias("value")).drop("vs")
    rows = rows.withColumn("statement_id", F.sha1(F.concat_ws(NUL, "dataset", "entity_id", "prop", "value")))
    bare = m.where(F.size(filled) <= 0).select(*base, F.lit(EXISTS).alias("prop"), *prov, F.col("id").alias("value"))
    bare = bare.withColumn("statement_id", F.sha2(F.concat_ws(NUL, "canonical_id", "entity_id", F.lit(EXISTS), "dataset"), 256))
    return rows.unionByName(bare).dropDuplicates(["canonical_id", "statement_id"])


def decisions(clusters: DataFrame) -> DataFrame:
    """One merge decision per cluster of more than one member."""
    c = clusters.groupBy("canonical_id").agg(F.array_sort(F.collect_set("member_id")).alias("member_ids"), F.max("score").alias("score"))
    return c.where(F.size("member_ids") > 1).select("canonical_id", F.lit("merge").alias("kind"), "member_ids", "score")


def context_claims(clusters: DataFrame, entities: DataFrame) -> DataFrame:
    """Claims of external ids by members with a source and a retrieval time."""
    m = clusters.select("canonical_id", F.col("member_id").alias("id")).join(entities, "id").where("prov.source_id != '' and prov.retrieved_at != ''")
    rows = m.select("canonical_id", F.col("id").alias("entity_id"), F.explode("anchors").alias("key", "vs"), F.col("prov.source_id").alias("dataset"), F.col("prov.retrieved_at").alias("retrieved_at"))
    return rows.where(F.col("key").isin(*ANCHORS)).select("canonical_id", "entity_id", "key", F.explode("vs").alias("value"), "dataset", "retrieved_at").distinct()


def running_sums(rows: DataFrame, order: list, sums: list[str]) -> DataFrame:
    """``rows`` with running sums of columns, each in place of its column, in the given order.

    The rows are ranged by the order into parts, summed up within each part, and
    the parts' sums added up, so that no single task orders all rows.
    """
    n = max(2, rows.sparkSession.sparkContext.defaultParallelism)
    placed = table(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row a part
    parts = placed.groupBy("_part").agg(*(F.sum(c).alias("_" + c) for c in sums)).select("_part", *(F.coalesce(F.sum("_" + c).over(before), F.lit(0)).alias("_" + c) for c in sums))
    own = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = placed.join(parts, "_part").withColumns({c: F.col("_" + c) + F.sum(c).over(own) for c in sums})
    return out.drop("_part", *("_" + c for c in sums))


def numbered(new: DataFrame, last: int, *order: str) -> DataFrame:
    """The rows of one batch with gap-free numbers after ``last``."""
    return running_sums(new.withColumn("seq", F.lit(1).cast("long")), list(order), ["seq"]).withColumn("seq", F.col("seq") + last)


def alias_map(ledger: DataFrame) -> DataFrame:
    """Superseded ids and their successor, the latest row of each alias; self rows are no supersession."""
    rows = ledger.where(F.col("canonical_id") != F.col("canonical_alias"))
    return rows.groupBy(F.col("canonical_alias").alias("alias")).agg(F.max_by("canonical_id", F.struct("created_at", "canonical_id")).alias("target"))


def alias_closure(aliases: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(alias, survivor)`` by pointer jumping: each round doubles the length of the chains that are followed.

    On a cycle of any length every id of it, and every id that leads into it, ends at the smallest of the cycle.
    """
    start = table(aliases.select("alias", "target").where(F.col("alias") != F.col("target")).distinct(), "alias")
    # low is the smallest id passed so far; an id that has passed itself and nothing smaller is the smallest of its cycle
    now, cut = start.withColumn("low", F.col("target")), False
    for _ in range(2 * max_rounds):
        nxt = now.select(F.col("alias").alias("target"), F.col("target").alias("further"), F.col("low").alias("beyond"))
        moved = table(now.join(nxt, "target", "left").select(
            "alias", F.coalesce("further", "target").alias("target"), F.least("low", "beyond").alias("low"),
            F.col("further").isNotNull().alias("moves"), F.coalesce(F.col("beyond") < F.col("low"), F.lit(False)).alias("falls"),
        ), "alias")
        drop_table(now)
        if moved.where("moves").isEmpty():
            drop_table(start)
            return moved.select("alias", F.col("target").alias("survivor"))
        now = moved
        # once nothing falls any more, every cycle has been gone round: its smallest id becomes a survivor
        if not cut and moved.where("falls").isEmpty():
            cut, ends = True, moved.where("alias = low").select("alias").distinct()
            if not ends.isEmpty():
                now = table(start.join(ends, "alias", "left_anti").withColumn("low", F.col("target")), "alias")
                drop_table(moved)
    raise RuntimeError("alias chains are longer than expected")


def survivors_of(rows: DataFrame, closure: DataFrame, column: str, out: str = "survivor") -> DataFrame:
    """``rows`` with the surviving id of a column: its successor, or itself."""
    c = closure.select(F.col("alias").alias(column), F.col("survivor").alias("_s"))
    return rows.join(c, column, "left").withColumn(out, F.coalesce("_s", column)).drop("_s")


def fold(claims: DataFrame, closure: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Entities from the log: values, datasets, witnesses, provenance of the smallest member, anchors.

    Repeated statements count once; the result does not depend on the order of the rows.
    """
    rows = survivors_of(claims.dropDuplicates(["statement_id"]), closure, "canonical_id")
    target = O.entity_typed(F.col("schema"), F.col("prop"))
    rows = survivors_of(rows.withColumn("_link", target), closure, "value", "moved").withColumn("value", F.when(F.col("_link"), F.col("moved")).otherwise(F.col("value")))
    real = ~F.col("prop").isin("id", EXISTS)
    per_prop = rows.where(real).groupBy("survivor", "prop").agg(F.array_sort(F.collect_set("value")).alias("values"), F.array_sort(F.collect_set("dataset")).alias("sources"))
    maps = per_prop.groupBy("survivor").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("prop", "values")))).alias("props"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("prop", "sources")))).alias("witnesses"),
    )
    prov = F.struct(F.col("dataset").alias("source_id"), F.coalesce("retrieved_at", F.lit("")).alias("retrieved_at"), F.coalesce("reliability", F.lit("")).alias("reliability"), F.coalesce("raw_pointer", F.lit("")).alias("source_record"))
    heads = rows.groupBy("survivor").agg(
        F.array_sort(F.collect_set("schema")).alias("schemata"),
        F.array_sort(F.collect_set(F.when(F.col("prop") != "id", F.col("dataset")))).alias("datasets"),
        F.min_by(prov, F.struct("entity_id", "seq", "statement_id")).alias("prov"),
    )
    none = F.create_map().cast("map<string,array<string>>")
    out = heads.join(maps, "survivor", "left").select(
        F.col("survivor").alias("id"), O.common_of(F.col("schemata")).alias("schema"), F.coalesce("props", none).alias("props"), "datasets", "prov", F.coalesce("witnesses", none).alias("witnesses")
    )
    if context is None:
        return out.withColumn("anchors", none)
    a = survivors_of(context, closure, "canonical_id").groupBy("survivor", "key").agg(F.array_sort(F.collect_set("value")).alias("vs"))
    a = a.groupBy(F.col("survivor").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "vs")))).alias("anchors"))
    return out.join(a, "id", "left").withColumn("anchors", F.coalesce("anchors", none))


def fold_since(claims: DataFrame, closure: DataFrame, watermark: int, context: DataFrame | None = None) -> DataFrame:
    """Entities touched by the claims after ``watermark``, folded from their whole history."""
    all_rows = survivors_of(claims, closure, "canonical_id", "_survivor")
    touched = all_rows.where(F.col("seq") > watermark).select("_survivor").distinct()
    return fold(all_rows.join(touched, "_survivor", "left_semi").drop("_survivor"), closure, context)


def incomplete_survivors(closure: DataFrame, claims: DataFrame) -> DataFrame:
    """Targets of aliases that no claim covers."""
    covered = survivors_of(claims.select("canonical_id").distinct(), closure, "canonical_id").select("survivor")
    return closure.select("survivor").distinct().join(covered, "survivor", "left_anti")


def rewrite_referents(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entity-typed values moved to their canonical ids; ``aliases`` is ``(alias, survivor)``."""
    flat = entities.select("id", "schema", F.explode_outer("props").alias("prop", "vs")).select("id", "schema", "prop", F.posexplode_outer("vs").alias("k", "value"))
    moved = survivors_of(flat.withColumn("_link", O.entity_typed(F.col("schema"), F.col("prop"))), aliases, "value", "m")
    v = F.when(F.col("_link"), F.col("m")).otherwise(F.col("value"))
    per = moved.withColumn("v", v).where("prop is not null").groupBy("id", "prop").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"])).alias("vs"))
    props = per.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("prop", "vs"))).alias("p"))
    return entities.join(props, "id", "left").withColumn("props", F.coalesce("p", "props")).drop("p")


#: Durable ids by precedence: kind, property, context key, shape.
TIERS = (
    ("qid", "wikidataId", "wikidata_id", r"^Q\d+$"), ("lei", "leiCode", "lei", r"^[A-Za-z0-9]{20}$"), ("gid", "", "mitre_gid", r"^G\d{4}$"),
    ("regno", "registrationNumber", "", r".+"), ("taxno", "taxNumber", "", r".+"),
)


def pick_anchor(clusters: DataFrame, entities: DataFrame) -> DataFrame:
    """``(canonical_id, kind, value, anchor)``: the first tier with exactly one value among the members.

    A tier whose members disagree falls through to the next.
    """
    m = clusters.select("canonical_id", F.col("member_id").alias("id")).join(entities.select("id", "props", "anchors"), "id")
    none = F.array().cast("array<string>")

    def shaped(vs: Column, shape: str) -> Column:
        return F.filter(vs, lambda v: F.trim(v).rlike(shape))

    tiers = F.array(*(
        F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), shaped(
            F.concat(F.coalesce(F.col("props")[p], none) if p else none, F.coalesce(F.col("anchors")[c], none) if c else none), r
        ).alias("vs")) for i, (k, p, c, r) in enumerate(TIERS)
    ))
    rows = m.select("canonical_id", F.explode(tiers).alias("t")).select("canonical_id", "t.rank", "t.kind", F.explode("t.vs").alias("value"))
    one = rows.groupBy("canonical_id", "rank", "kind").agg(F.count_distinct(F.trim("value")).alias("n"), F.min(F.trim("value")).alias("value")).where("n = 1")
    best = one.groupBy("canonical_id").agg(F.min(F.struct("rank", "kind", "value")).alias("b"))
    return best.select("canonical_id", "b.kind", "b.value", anchor_id(F.col("b.kind"), F.col("b.value")).alias("anchor"))


def anchor_conflicts(clusters: DataFrame, entities: DataFrame) -> DataFrame:
    """``(canonical_id, field, values)`` of external ids on which the members disagree."""
    m = clusters.select("canonical_id", F.col("member_id").alias("id")).join(entities.select("id", "anchors"), "id")
    rows = m.select("canonical_id", F.explode("anchors").alias("field", "vs")).select("canonical_id", "field", F.explode("vs").alias("value")).where("value != ''")
    return rows.groupBy("canonical_id", "field").agg(F.array_sort(F.collect_set("value")).alias("values")).where(F.size("values") > 1)


def single_anchors(anchors: Column) -> Column:
    """External ids with one value; those in conflict are left out."""
    return F.map_filter(anchors, lambda k, v: F.size(F.array_distinct(v)) == 1)


def set_anchor(anchors: Column, field: str, values: Column) -> Column:
    if field not in ANCHORS:
        raise ValueError(f"unknown anchor {field}")
    old = F.coalesce(anchors[field], F.array().cast("array<string>"))
    rest = F.map_filter(anchors, lambda k, v: k != field)
    return F.map_concat(rest, F.create_map(F.lit(field), F.array_sort(F.array_union(old, values))))


def ledger_rows(durable: DataFrame, clusters: DataFrame, ledger: DataFrame) -> DataFrame:
    """New ledger rows: each durable id itself, its members and its prior id, without those there are.

    ``durable`` is ``(canonical_id, durable_id)``.
    """
    c = durable.join(clusters.select("canonical_id", "member_id"), "canonical_id")
    aliases = F.explode(F.array(F.col("durable_id"), F.col("member_id"), F.col("canonical_id")))
    rows = c.select(F.col("durable_id").alias("canonical_id"), aliases.alias("canonical_alias")).distinct()
    return rows.join(ledger.select("canonical_id", "canonical_alias"), ["canonical_id", "canonical_alias"], "left_anti")


def durable_ids(clusters: DataFrame, entities: DataFrame, ledger: DataFrame) -> DataFrame:
    """``(canonical_id, durable_id)`` of merges: the anchor's id, as it is in the ledger or new, else the merge id itself."""
    merges = clusters.groupBy("canonical_id").agg(F.count_distinct("member_id").alias("n")).where("n > 1").select("canonical_id")
    known = ledger.where(F.col("canonical_id") == F.col("canonical_alias")).select(F.col("canonical_id").alias("anchor"), F.lit(True).alias("in_ledger"))
    picked = pick_anchor(clusters, entities).join(known, "anchor", "left")
    return merges.join(picked, "canonical_id", "left").select(
        "canonical_id", F.coalesce("anchor", "canonical_id").alias("durable_id"), F.coalesce("in_ledger", F.lit(False)).alias("known")
    )


def resolve_once(ids: DataFrame, ledger: DataFrame) -> DataFrame:
    """Single-hop lookup of ``(alias)``; not for the fold."""
    one = ledger.groupBy(F.col("canonical_alias").alias("alias")).agg(F.min_by("canonical_id", F.struct("created_at", "canonical_id")).alias("durable"))
    return ids.join(one, "alias", "left").withColumn("durable", F.coalesce("durable", "alias"))


def referent_map(clusters: DataFrame) -> DataFrame:
    return clusters.where(F.col("member_id") != F.col("canonical_id")).select(F.col("member_id").alias("alias"), F.col("canonical_id").alias("survivor")).distinct()


def evidence_diff(members: DataFrame) -> DataFrame:
    """``(prop, agrees, values)`` over members ``(id, props)``: whether at most one distinct non-empty list is stated."""
    rows = members.select("id", F.explode("props").alias("prop", "vs")).where(F.size("vs") > 0)
    return rows.groupBy("prop").agg(F.array_sort(F.collect_set(F.concat_ws("; ", F.array_sort("vs")))).alias("values")).select("prop", (F.size("values") <= 1).alias("agrees"), "values")


def first_name(entities: DataFrame) -> DataFrame:
    return entities.withColumn("caption", first_value(F.col("props"), "name"))


def backfill(queue: DataFrame, statements_: DataFrame, erased: DataFrame, parsed: DataFrame) -> DataFrame:
    """Disposition of each queue row for replay: erased, unparseable, redacted, present or kept.

    ``parsed`` is ``(item, entity_id, source, redacted)``; ``erased`` is ``(source)``.
    """
    p = parsed.join(erased.select(F.col("source"), F.lit(True).alias("gone")).distinct(), "source", "left")
    there = statements_.select("entity_id", F.lit(True).alias("there")).distinct()
    rows = queue.select(F.col("id").alias("item")).join(p, "item", "left").join(there, "entity_id", "left")
    fate = (
        F.when(F.col("gone"), "erased").when(F.col("entity_id").isNull(), "unparseable").when(F.col("redacted"), "redacted").when(F.col("there"), "present").otherwise("kept")
    )
    return rows.select("item", fate.alias("disposition"))


def erased_sources(runs: DataFrame) -> DataFrame:
    """Sources of good erasure runs, each once."""
    s = runs.where((F.col("kind") == "erase") & (F.col("status") == "ok")).select(F.get_json_object("stats", "$.source_id").alias("source"))
    return s.where("source is not null").distinct()


def load_members(ids: DataFrame, queue: DataFrame) -> DataFrame:
    """Queue rows of a cluster's members ``(source_ids)`` in their order; missing ones are left out."""
    pos = ids.select(F.posexplode("source_ids").alias("pos", "entity_id"))
    return pos.join(queue, "entity_id").orderBy("pos")


def outbound(claims: DataFrame, members: DataFrame) -> DataFrame:
    """Edges that leave members ``(id)``: claims of link properties."""
    links = claims.where(O.entity_typed(F.col("schema"), F.col("prop")))
    return links.join(members.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("entity_id", "prop", "value").distinct()


def batches(queue: DataFrame, size: int = 1000) -> DataFrame:
    """Waiting rows with the number of their micro-batch, oldest first."""
    rows = queue.where(F.col("status") == "pending").withColumn("seq", F.lit(1).cast("long"))
    return running_sums(rows, ["created_at", "id"], ["seq"]).withColumn("batch", F.floor((F.col("seq") - 1) / size)).drop("seq")
