"""The whole write path: ingest of landed records, and resolution of the queue into claims and graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import ontology as O
from quillon import plugins
from quillon.operators import claims as C
from quillon.operators import clustering as K
from quillon.operators import graph as G
from quillon.operators import mapping as M
from quillon.operators import matching as T
from quillon.operators import sinks as W
from quillon.runtime import table
from quillon.schema import VALUES

PAYLOAD = f"id string, schema string, properties {VALUES}, datasets array<string>, context struct<wm_prov_source_id:string,wm_prov_retrieved_at:string,wm_prov_reliability:string,wm_prov_source_record:string>"


def ingest(spark: SparkSession, connector: str, path: str, source: str, root: str, retrieved_at: str) -> tuple[int, int]:
    """Scan, land, map, validate and enqueue; gives the numbers of entities and of dead letters."""
    raw = W.land(plugins.get("connector", connector)(spark, path, retrieved_at), f"{root}/landing", source)
    rows = table(M.validate(plugins.get("mapper", connector)(raw, source), tuple(s for s, *_ in O.SCHEMATA)), "mapped")
    good, bad = W.split_errors(rows)
    W.enqueue(good, f"{root}/queue", connector)
    letters = bad.select(F.lit(connector).alias("connector_id"), F.col("prov.source_record").alias("source_record"), F.lit("map").alias("stage"), "error")
    W.append(letters, f"{root}/dead_letters")
    return good.count(), bad.count()


def queue_entities(queue: DataFrame) -> DataFrame:
    """Waiting queue rows as entities, one per id, the latest retrieved."""
    p = queue.where(F.col("status") == "pending").select(F.from_json("raw_entity", PAYLOAD).alias("p")).where("p.id is not null and p.schema is not null").select("p.*")
    prov = F.struct(
        F.coalesce("context.wm_prov_source_id", F.lit("")).alias("source_id"), F.coalesce("context.wm_prov_retrieved_at", F.lit("")).alias("retrieved_at"),
        F.coalesce("context.wm_prov_reliability", F.lit("")).alias("reliability"), F.coalesce("context.wm_prov_source_record", F.lit("")).alias("source_record"),
    )
    none = F.create_map().cast(VALUES)
    e = p.select("id", "schema", F.coalesce("properties", none).alias("props"), F.coalesce("datasets", F.array().cast("array<string>")).alias("datasets"), prov.alias("prov"), none.alias("anchors"))
    return e.groupBy("id").agg(F.max_by(F.struct("schema", "props", "datasets", "prov", "anchors"), F.struct("prov.retrieved_at", "prov.source_record")).alias("e")).select("id", "e.*")


def resolve(entities: DataFrame, judgements: DataFrame | None = None, *, ledger: DataFrame | None = None, block: bool = True, largest: int = 10) -> dict[str, DataFrame]:
    """Score, cluster, guard and record entities.

    Gives ``clusters`` (with durable ids), ``parked`` merges, ``statements``,
    ``decisions``, ``audit``, and the ``nodes``, ``links``, ``ghosts`` and ``edges`` of what is promoted.
    A flagged merge is parked with its members if ``block``, else promoted with its reason in the audit.
    """
    spark = entities.sparkSession
    entities = table(entities, "entities")
    pairs = table(T.score_pairs(T.flatten(entities)), "pairs")
    clusters = table(K.cluster(entities, pairs, judgements), "clusters")
    review = K.needs_review(clusters, entities, C.anchor_conflicts(clusters, entities), largest=largest)
    sizes = clusters.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("members"), F.max("score").alias("score"))
    decided = sizes.join(review, "canonical_id", "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    audit = table(decided.select("canonical_id", "members", "score", F.when(F.col("flagged") & F.lit(block), "pending_review").otherwise("merged").alias("decision"), F.coalesce("reason", F.lit("")).alias("reason")), "audit")
    passed = clusters.join(audit.where("decision = 'merged'").select("canonical_id"), "canonical_id", "left_semi")
    ledger = ledger if ledger is not None else spark.createDataFrame([], "canonical_id string, canonical_alias string")
    durable = C.durable_ids(passed, entities, ledger).select("canonical_id", "durable_id")
    named = passed.join(durable, "canonical_id", "left").select(F.coalesce("durable_id", "canonical_id").alias("canonical_id"), "member_id", "score")
    named = table(named, "named")
    merged = K.merge_entities(named, entities)
    ids = C.referent_map(named)
    out = table(C.rewrite_referents(merged.drop("members").withColumn("anchors", F.create_map().cast(VALUES)), ids), "merged")
    nodes = table(G.build_nodes(out), "nodes")
    links, ghosts = G.build_links(out, nodes)
    return {
        "clusters": named, "parked": audit.where("decision = 'pending_review'"), "audit": audit, "statements": C.statements(named, entities), "decisions": C.decisions(named),
        "entities": out, "nodes": nodes, "links": links, "ghosts": ghosts, "edges": G.build_edges(out, nodes),
    }
