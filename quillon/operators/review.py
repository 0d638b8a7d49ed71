"""Review of parked merges: listing, approval and rejection as tables of what changes; quarantine, alerts and ids.

Decisions change several tables at once.  Each operator gives the rows to write,
so that the caller can append them in the order audit, judgements, log, graph and repeat a
step that a crash has interrupted; a repeated decision gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon import ontology as O
from quillon.functions.python_udfs import uuid5
from quillon.functions.scalars import short_hash
from quillon.operators import claims as C
from quillon.operators.clustering import judgement_pairs, merge_entities

PENDING, MERGED, REJECTED = "pending_review", "merged", "rejected"
STAGES = ("parse", "validate", "score", "write")


def said(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def latest_audit(audit: DataFrame) -> DataFrame:
    """The newest row of each canonical id; equal times by id."""
    best = F.max_by(F.struct(*(F.col(c) for c in audit.columns if c != "canonical_id")), F.struct("created_at", "id"))
    return audit.where("canonical_id is not null").groupBy("canonical_id").agg(best.alias("x")).select("canonical_id", "x.*")


def any_exists(groups: DataFrame, nodes: DataFrame, id_col: str = "id") -> DataFrame:
    """``(canonical_id)`` of groups ``(canonical_id, id)`` of which any id is a node."""
    return groups.join(nodes.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi").select("canonical_id").distinct()


def list_parked(audit: DataFrame, nodes: DataFrame) -> DataFrame:
    """Merges that wait for review, each with whether a node of it or of a member is in the graph already.

    A parked merge is not written, so such a node tells of a decision that was interrupted.
    """
    waiting = audit.where(said("decision") == PENDING).where("canonical_id is not null")
    ids = waiting.select("canonical_id", F.explode(F.array_union(F.array("canonical_id"), F.coalesce("source_ids", F.array().cast("array<string>")))).alias("id"))
    there = any_exists(ids, nodes).withColumn("graph_written", F.lit(True))
    return waiting.join(there, "canonical_id", "left").withColumn("graph_written", F.coalesce("graph_written", F.lit(False)))


def decide(audit: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """State of requested decisions ``(canonical_id, wanted)``: ``apply``, ``already``, or why it is refused.

    A merge that was decided the other way is refused, as is one whose members are
    in the graph (approval after an interrupted rejection) or whose merged node is
    (rejection after an interrupted approval).
    """
    last = latest_audit(audit).select("canonical_id", "source_ids", "score", said("decision").alias("held"))
    j = asked.join(last, "canonical_id", "left")
    members = any_exists(j.select("canonical_id", F.explode("source_ids").alias("id")), nodes).withColumn("member_node", F.lit(True))
    own = j.select("canonical_id", F.col("canonical_id").alias("id"))
    merged = any_exists(own, nodes).withColumn("merged_node", F.lit(True))
    j = j.join(members, "canonical_id", "left").join(merged, "canonical_id", "left")
    up = F.col("wanted") == MERGED
    state = (
        F.when(F.col("held").isNull(), "no merge").when(F.col("held") == F.col("wanted"), "already").when(F.col("held").isin(MERGED, REJECTED), F.concat(F.lit("was "), "held"))
        .when(up & F.coalesce("member_node", F.lit(False)), "rejection was begun").when(~up & F.coalesce("merged_node", F.lit(False)), "approval was begun").otherwise("apply")
    )
    return j.select("canonical_id", "wanted", "source_ids", "score", state.alias("state"))


def judgements(decided: DataFrame) -> DataFrame:
    """Judged pairs of applied decisions: all members of an approved merge belong together, those of a rejected one are apart."""
    rows = decided.where("state = 'apply'").select(F.explode(judgement_pairs(F.col("source_ids"))).alias("p"), F.when(F.col("wanted") == MERGED, "positive").otherwise("negative").alias("judgement"))
    return rows.select("p.left_id", "p.right_id", "judgement").distinct()


def signed(decided: DataFrame, by: str, reason: str = "") -> DataFrame:
    """Sign-off rows of applied decisions."""
    return decided.where("state = 'apply'").select(
        short_hash(F.col("canonical_id"), F.col("wanted"), F.lit(by)).alias("id"), "canonical_id", F.array_sort(F.array_distinct("source_ids")).alias("source_ids"),
        F.when(F.col("wanted") == MERGED, "approved").otherwise("rejected").alias("decision"), F.lit(by).alias("decided_by"), F.lit(reason).alias("reason"),
    )


def settle_audit(audit: DataFrame, decided: DataFrame) -> DataFrame:
    """The audit with the decision of the applied requests in the rows that waited."""
    d = decided.where("state = 'apply'").select("canonical_id", F.col("wanted").alias("_w"))
    return audit.join(d, "canonical_id", "left").withColumn("decision", F.when(F.col("_w").isNotNull() & (said("decision") == PENDING), F.col("_w")).otherwise(F.col("decision"))).drop("_w")


def settle_queue(queue: DataFrame, decided: DataFrame) -> DataFrame:
    """The queue with the members' waiting rows resolved."""
    m = decided.where("state = 'apply'").select(F.explode("source_ids").alias("entity_id")).distinct().withColumn("_d", F.lit(True))
    done = F.col("_d") & F.col("status").isin("pending", PENDING)
    return queue.join(m, "entity_id", "left").withColumn("status", F.when(F.coalesce(done, F.lit(False)), "resolved").otherwise(F.col("status"))).drop("_d")


def outcome(decided: DataFrame, entities: DataFrame) -> dict[str, DataFrame]:
    """What an applied decision writes: ``clusters``, ``statements``, ``decisions`` and the ``entities`` of the graph.

    An approval gives the merged entity, a rejection each member as it is.
    """
    rows = decided.where("state = 'apply'").select("canonical_id", "wanted", "score", F.explode(F.array_distinct("source_ids")).alias("member_id"))
    clusters = rows.select(F.when(F.col("wanted") == MERGED, F.col("canonical_id")).otherwise(F.col("member_id")).alias("canonical_id"), "member_id", F.when(F.col("wanted") == MERGED, F.col("score")).otherwise(1.0).alias("score")).distinct()
    return {"clusters": clusters, "statements": C.statements(clusters, entities), "decisions": C.decisions(clusters), "entities": merge_entities(clusters, entities)}


def nonexemptible(clusters: DataFrame, entities: DataFrame, near_risk: DataFrame | None = None, *, band: tuple[float, float] = (0.92, 0.92)) -> DataFrame:
    """``(canonical_id, fenced)``: whether a cluster has a risk that no earlier approval can have weighed.

    A topic that only the broader test takes for a risk, a risk near in the graph
    ``(id, flagged)``, or a score in the band of doubt.  Size, conflicting ids and topics of
    the older test don't count: an approval has seen them.
    """
    e = entities.select(F.col("id").alias("member_id"), O.newly_sensitive(F.col("props")["topics"]).alias("new"))
    m = clusters.join(e, "member_id", "left")
    near = F.lit(False)
    if near_risk is not None:
        m = m.join(near_risk.select(F.col("id").alias("member_id"), F.col("flagged").alias("near")), "member_id", "left")
        near = F.coalesce("near", F.lit(False))
    doubt = (F.col("score") >= band[0]) & (F.col("score") < band[1])
    return m.groupBy("canonical_id").agg(F.bool_or(F.coalesce("new", F.lit(False)) | near | F.coalesce(doubt, F.lit(False))).alias("fenced"))


def quarantine(queue: DataFrame, failed: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """The queue with failed items ``(id, reason)`` invalid, and their dead letters; the reason is cut to 2000 characters."""
    bad = failed.groupBy("id").agg(F.min("reason").alias("_r"))
    j = queue.join(bad, "id", "left")
    return j.withColumn("status", F.when(F.col("_r").isNotNull(), "invalid").otherwise(F.col("status"))).drop("_r"), _letters(j.where("_r is not null"), stage)


def skipped(queue: DataFrame, failed: DataFrame, stage: str) -> DataFrame:
    """Dead letters of items that are passed over; their state stays."""
    return _letters(queue.join(failed.groupBy("id").agg(F.min("reason").alias("_r")), "id"), stage)


def _letters(rows: DataFrame, stage: str) -> DataFrame:
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage}")
    return rows.select("connector_id", "source_record", F.lit(stage).alias("stage"), F.substring("_r", 1, 2000).alias("error"))


def merge_alerts(review: DataFrame) -> DataFrame:
    """Alerts of flagged merges that are promoted all the same."""
    return review.where("flagged").select("canonical_id", F.lit("merge_alert").alias("kind"), "reason")


def merge_rows(clusters: DataFrame, decision: str, reason: str = "") -> DataFrame:
    """Audit rows of merges: a row per cluster of more than one member."""
    g = clusters.groupBy("canonical_id").agg(F.array_sort(F.collect_set("member_id")).alias("source_ids"), F.max("score").alias("score")).where(F.size("source_ids") > 1)
    return g.select("canonical_id", "source_ids", "score", F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))


def mint(rows: DataFrame, column: str = "durable_id") -> DataFrame:
    """Rows with a new random id each; write them once, as each evaluation draws anew."""
    return rows.withColumn(column, F.concat(F.lit("wm-mint-"), F.uuid()))


def ledger_row_id(canonical: Column, alias: Column) -> Column:
    """Stable key of a ledger row, without dashes."""
    return F.regexp_replace(uuid5(F.concat_ws("\0", canonical, alias)), "-", "")


def canonical_rows(ids: DataFrame, ledger: DataFrame) -> DataFrame:
    """New self rows ``(canonical_id, canonical_alias, anchor_kind, anchor_value, id)`` of durable ids that the ledger lacks."""
    new = ids.join(ledger.where("canonical_id = canonical_alias").select("canonical_id"), "canonical_id", "left_anti").dropDuplicates(["canonical_id"])
    return new.select("canonical_id", F.col("canonical_id").alias("canonical_alias"), "anchor_kind", "anchor_value", ledger_row_id(F.col("canonical_id"), F.col("canonical_id")).alias("id"))


def witness_property(nodes: DataFrame) -> DataFrame:
    """Nodes with their witnesses as one JSON property ``prov_witnesses``, none where nothing is witnessed."""
    w = F.map_filter("witnesses", lambda k, v: F.size(v) > 0)
    flat = F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(w, lambda k, v: F.array_sort(v)))))
    json = F.create_map(F.lit("prov_witnesses"), F.array(F.to_json(flat)))
    return nodes.withColumn("props", F.when(F.size(F.map_keys(w)) > 0, F.map_concat("props", json)).otherwise(F.col("props")))


def seed_rows(specs: DataFrame, namespace: Column | None = None) -> DataFrame:
    """Seed specifications with their instance id, a digest of connector and natural key."""
    return specs.withColumn("instance_id", uuid5(F.concat_ws(":", "connector_id", "natural_key")))


def plant(specs: DataFrame, instances: DataFrame) -> DataFrame:
    """Seeds that are not planted yet, each once."""
    return seed_rows(specs).dropDuplicates(["instance_id"]).join(instances.select("instance_id"), "instance_id", "left_anti")


def assert_complete(missing: DataFrame) -> None:
    """Raise if an aliased survivor has no statement."""
    n = missing.count()
    if n:
        raise ValueError(f"{n} survivors without statements")


def load_labelled(pairs: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Labelled pairs of some or all sources, in a stable order of pairs."""
    rows = pairs.where(F.col("source").isin(*sources)) if sources else pairs
    return rows.orderBy("left_id", "right_id", "label")


def escape_literal(c: Column) -> Column:
    """Text within the quotes of a query literal."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def same_target(a: Column, b: Column, port: int = 7687) -> Column:
    """Whether two service addresses lead to one server: names of the own machine are one, and the usual port may be left out."""
    def host(c: Column) -> Column:
        rest = F.lower(F.regexp_replace(F.trim(c), r"^[A-Za-z0-9+]+://", ""))
        rest = F.regexp_extract(F.regexp_replace(rest, r"^[^@/]*@", ""), r"^([^/?#]*)", 1)
        named = F.regexp_replace(F.regexp_replace(rest, r":\d+$", ""), r"^(localhost|127\.0\.0\.1|\[::1\]|0\.0\.0\.0)$", "localhost")
        return F.concat_ws(":", named, F.coalesce(F.nullif(F.regexp_extract(rest, r":(\d+)$", 1), F.lit("")), F.lit(str(port))))

    return host(a) == host(b)
