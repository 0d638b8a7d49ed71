"""Comparison of a live graph with the fold of its log, and erasure of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.claims import survivors_of
from quillon.schema import ANCHORS


def excluded(prop: Column) -> Column:
    """Properties that may differ by nature."""
    return prop.isin("id", "caption", "datasets", *ANCHORS) | prop.startswith("prov_")


def node_values(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """``(id, prop, value)`` of the compared properties, ids and values by survivor, each once."""
    rows = survivors_of(nodes, closure, "id").select(F.col("survivor").alias("id"), F.explode("props").alias("prop", "vs")).where(~excluded(F.col("prop")))
    rows = rows.select("id", "prop", F.explode("vs").alias("value"))
    return survivors_of(rows, closure, "value", "v").select("id", "prop", F.col("v").alias("value")).distinct()


def surviving_edges(edges: DataFrame, closure: DataFrame) -> DataFrame:
    e = survivors_of(survivors_of(edges.select("type", "src", "dst"), closure, "src", "s"), closure, "dst", "d")
    return e.select("type", F.col("s").alias("src"), F.col("d").alias("dst"))


def divergence(live_nodes: DataFrame, live_edges: DataFrame, fold_nodes: DataFrame, fold_edges: DataFrame, closure: DataFrame) -> DataFrame:
    """Live nodes and edges that the fold lacks, or whose values it lacks: counts in one row."""
    live = survivors_of(live_nodes.select("id"), closure, "id").select("id", "survivor")
    missing = live.join(fold_nodes.select(F.col("id").alias("survivor")), "survivor", "left_anti")
    own = survivors_of(live_nodes, closure, "id").select("id", "survivor", F.explode("props").alias("prop", "vs")).where(~excluded(F.col("prop"))).select("id", "survivor", "prop", F.explode("vs").alias("value"))
    own = survivors_of(own, closure, "value", "v").select("id", F.col("survivor"), "prop", F.col("v").alias("value"))
    have = node_values(fold_nodes, closure).select(F.col("id").alias("survivor"), "prop", "value")
    present = own.join(fold_nodes.select(F.col("id").alias("survivor")), "survivor", "left_semi")
    stale = present.join(have, ["survivor", "prop", "value"], "left_anti").select("id").distinct()
    lost = surviving_edges(live_edges, closure).join(surviving_edges(fold_edges, closure).distinct(), ["type", "src", "dst"], "left_anti")
    parts = [missing.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("missing_nodes")), stale.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("stale_nodes")),
             lost.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("missing_edges"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("what", "n")


def fold_extras(live_nodes: DataFrame, live_edges: DataFrame, fold_nodes: DataFrame, fold_edges: DataFrame, closure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the fold that no live one stands for."""
    n = survivors_of(live_nodes.select("id"), closure, "id").select(F.col("survivor").alias("id")).distinct()
    e = surviving_edges(live_edges, closure).distinct()
    return fold_nodes.select("id").join(n, "id", "left_anti"), fold_edges.select("type", "src", "dst").join(e, ["type", "src", "dst"], "left_anti")


def extra_values(live_nodes: DataFrame, fold_nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """Values that the fold has and the live node of the same survivor lacks."""
    live = node_values(live_nodes, closure)
    ids = survivors_of(live_nodes.select("id"), closure, "id").select(F.col("survivor").alias("id")).distinct()
    return node_values(fold_nodes, closure).join(ids, "id", "left_semi").join(live, ["id", "prop", "value"], "left_anti")


def label_differences(live_nodes: DataFrame, fold_nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """``(id, label, side)``: labels that one side of a node present on both lacks."""
    live = survivors_of(live_nodes, closure, "id").select(F.col("survivor").alias("id"), F.explode("labels").alias("label")).distinct()
    fold = fold_nodes.select("id", F.explode("labels").alias("label")).distinct()
    ids = live.select("id").distinct().join(fold_nodes.select("id"), "id", "left_semi")
    a = live.join(ids, "id", "left_semi").join(fold, ["id", "label"], "left_anti").withColumn("side", F.lit("missing_in_fold"))
    b = fold.join(ids, "id", "left_semi").join(live, ["id", "label"], "left_anti").withColumn("side", F.lit("extra_in_fold"))
    return a.unionByName(b)


def residue(fold_nodes: DataFrame, erased: DataFrame) -> DataFrame:
    """Nodes whose datasets or witnesses still name an erased source."""
    named = fold_nodes.select("id", F.explode(F.array_distinct(F.concat(F.coalesce("datasets", F.array().cast("array<string>")), F.flatten(F.map_values("witnesses"))))).alias("source"))
    return named.join(erased.select("source"), "source", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def count_reconcile(live_nodes: DataFrame, fold_nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """Numbers of nodes on both sides and what they leave unexplained, in one row."""
    s = survivors_of(live_nodes.select("id"), closure, "id")
    live = s.agg(F.count(F.lit(1)).alias("live"), F.count_distinct("survivor").alias("live_survivors"), (F.count(F.lit(1)) - F.count_distinct("id")).alias("duplicates"))
    extra = fold_nodes.select("id").join(s.select(F.col("survivor").alias("id")).distinct(), "id", "left_anti").agg(F.count(F.lit(1)).alias("extras"))
    fold = fold_nodes.agg(F.count(F.lit(1)).alias("fold"))
    k = lambda d: d.withColumn("k", F.lit(1))  # noqa: E731  one row each
    j = k(live).join(k(extra), "k").join(k(fold), "k").drop("k")
    return j.withColumn("residual", F.col("duplicates") + (F.col("fold") - F.col("live_survivors") - F.col("extras")))


def checks(diff: DataFrame, extras: DataFrame, left_over: DataFrame) -> DataFrame:
    """Named checks with what they counted and whether they pass."""
    bad = diff.select(F.col("what").alias("check"), "n")
    more = extras.agg(F.count(F.lit(1)).alias("n")).select(F.lit("fold_extras").alias("check"), "n")
    rest = left_over.agg(F.count(F.lit(1)).alias("n")).select(F.lit("erased_residue").alias("check"), "n")
    return bad.unionByName(more).unionByName(rest).withColumn("passed", F.col("n") == 0)


def erase_source(claims: DataFrame, source: str) -> DataFrame:
    """The log without a source: rows of its dataset, and rows of any entity that it ever stated."""
    members = claims.where(F.col("dataset") == source).select("entity_id").distinct()
    return claims.where(F.col("dataset") != source).join(members, "entity_id", "left_anti")


def erase_sources(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """The same for all erased sources ``(source)`` at once."""
    s = sources.select(F.col("source").alias("dataset")).distinct()
    members = claims.join(s, "dataset", "left_semi").select("entity_id").distinct()
    return claims.join(s, "dataset", "left_anti").join(members, "entity_id", "left_anti")


def prune_nodes(nodes: DataFrame, source: str) -> DataFrame:
    """Nodes ``(id, props, witnesses)`` after an erasure: those of the source alone go, others lose the values only it states."""
    w = F.col("witnesses")
    named = F.array_distinct(F.flatten(F.map_values(w)))
    only = (F.size(named) == 1) & F.array_contains(named, source)
    lone = lambda k: F.array_distinct(F.coalesce(w[k], F.array().cast("array<string>"))) == F.array(F.lit(source))
    props = F.map_filter("props", lambda k, v: ~lone(k))
    rest = F.map_filter(F.transform_values(w, lambda k, v: F.array_except(v, F.array(F.lit(source)))), lambda k, v: F.size(v) > 0)
    return nodes.where(~only).withColumns({"props": props, "witnesses": rest})


def redact_queue(queue: DataFrame, source: str) -> DataFrame:
    """Payloads of a source replaced by a shell with the id alone."""
    own = F.get_json_object("raw_entity", "$.context.wm_prov_source_id") == source
    shell = F.to_json(F.struct(F.col("entity_id").alias("id"), F.lit(True).alias("redacted")))
    return queue.withColumn("raw_entity", F.when(F.coalesce(own, F.lit(False)), shell).otherwise(F.col("raw_entity")))


def landing_prefix(source: str) -> str:
    """Path prefix of a source ``connector:dataset``; a blank dataset is refused, as it would reach too far."""
    connector, _, dataset = source.partition(":")
    if not connector.strip() or not dataset.strip():
        raise ValueError("a source has a connector and a dataset")
    return f"{connector}/{dataset}/"


def redact_errors(letters: DataFrame, prefix: str) -> DataFrame:
    return letters.withColumn("error", F.when(F.col("source_record").startswith(prefix), "").otherwise(F.col("error")))
