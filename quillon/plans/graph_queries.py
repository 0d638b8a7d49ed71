"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import scalars as X
from quillon.operators import graph as G
from quillon.plans import adapters as A
from quillon.runtime import read

START = "supplier:7"
N, E, B = A.SQL_NODES, A.SQL_EDGES, A.SQL_BOTH


def _centroids(s, d):
    k = F.col("n_nationkey")
    return read(s, d, "nation").select(F.lower("n_name").alias("country"), (k * 2.5 - 30).alias("c_lat"), (k * 7.0 - 90).alias("c_lon"))


def _places(s, d):
    """Suppliers as places: some with coordinates, some with garbage, all with a country."""
    sup = read(s, d, "supplier").join(read(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    lat = F.when(k % 3 == 0, (k % 90).cast("string")).when(k % 3 == 1, "north")
    lon = F.when(k % 3 == 0, (k % 180).cast("string"))
    return sup.select(F.concat(F.lit("supplier:"), k.cast("string")).alias("id"), lat.alias("lat"), lon.alias("lon"), F.lower("n_name").alias("country"))


def _articles(s, d):
    """Documents as article nodes."""
    doc = read(s, d, "documents")
    p = F.map_from_arrays(F.array(*map(F.lit, ("title", "publishedAt", "prov_retrieved_at"))), F.array(
        F.array(F.substring("text", 1, 80)), F.filter(F.array(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")), lambda v: v.isNotNull()), F.filter(F.array(F.date_format("retrieved_at", "yyyy-MM-dd HH:mm:ss")), lambda v: v.isNotNull())
    ))
    return doc.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.array(F.lit("Entity"), F.lit("Article")).alias("labels"), p.alias("props"))


def _risk_nodes(s, d):
    rich = read(s, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), (F.col("c_acctbal") < 0).alias("r"))
    return A.nodes(s, d).join(rich, "id", "left").withColumn("labels", F.when(F.coalesce("r", F.lit(False)), F.array_append("labels", F.lit("Sanction"))).otherwise(F.col("labels"))).drop("r")


def _hops(n: int) -> str:
    steps = ", ".join(f"h{i + 1} AS (SELECT DISTINCT b.dst AS id FROM h{i} JOIN both_ways b ON b.src = h{i}.id)" for i in range(n))
    union = " UNION ".join(f"SELECT id FROM h{i + 1}" for i in range(n))
    return f"WITH {N}, {E}, {B}, h0 AS (SELECT '{START}' AS id), {steps} SELECT u.id, nodes.name FROM ({union}) u JOIN nodes ON nodes.id = u.id WHERE u.id <> '{START}'"


def _named(df):
    return df.select("id", X.first_value(F.col("props"), "name").alias("name"))


QUERIES = {
    "graph_stats": (
        lambda s, d: G.stats(A.nodes(s, d), A.edges(s, d)),
        f"WITH {N}, {E} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, 0::BIGINT AS articles",
    ),
    "degree_top10": (
        lambda s, d: G.degree_top(A.nodes(s, d), A.edges(s, d).select("type", F.col("dst").alias("src"), F.col("src").alias("dst"))),
        f"WITH {N}, {E} SELECT nodes.id, count(edges.dst) AS score, false AS sanctioned FROM nodes LEFT JOIN edges ON edges.dst = nodes.id GROUP BY nodes.id ORDER BY score DESC, id LIMIT 10",
    ),
    "get_entity": (lambda s, d: _named(G.get_entity(A.nodes(s, d), START)), f"WITH {N} SELECT id, name FROM nodes WHERE id = '{START}'"),
    "get_provenance": (
        lambda s, d: G.get_provenance(_articles(s, d), "doc:5").select("id", F.get(F.col("provenance")["prov_retrieved_at"], F.lit(0)).alias("retrieved_at")),
        "SELECT 'doc:' || doc_id AS id, strftime(retrieved_at, '%Y-%m-%d %H:%M:%S') AS retrieved_at FROM documents WHERE doc_id = 5",
    ),
    "entity_by_alias": (
        lambda s, d: _named(G.by_alias(A.nodes(s, d), A.ledger(s, d), "customer:8")),
        f"WITH {N} SELECT id, name FROM nodes WHERE id IN ('customer:8', 'customer:7')",
    ),
    "neighborhood": (
        lambda s, d: G.neighborhood(A.nodes(s, d), A.edges(s, d), "nation:3", 500).select("id", "type"),
        f"WITH {N}, {E}, {B} SELECT dst AS id, type FROM both_ways WHERE src = 'nation:3' ORDER BY id, type LIMIT 500",
    ),
    "neighbors_2hop": (lambda s, d: _named(G.neighbors(A.nodes(s, d), A.edges(s, d), START, 2, None)), _hops(2)),
    "neighbors_4hop": (lambda s, d: _named(G.neighbors(A.nodes(s, d), A.edges(s, d), START, 9, None)), _hops(4)),
    "neighbors_capped": (lambda s, d: _named(G.neighbors(A.nodes(s, d), A.edges(s, d), START, 2, 20)), f"SELECT * FROM ({_hops(2)}) ORDER BY id LIMIT 20"),
    "shortest_path": (
        lambda s, d: G.shortest_path(A.edges(s, d), "customer:1", START).select(F.size("types").cast("long").alias("steps"), F.array_join("ids", " ").alias("path")),
        f"""WITH {N}, {E}, {B}, p1 AS (SELECT dst AS id, ['customer:1', dst] AS ids FROM both_ways WHERE src = 'customer:1' AND type <> 'PLACED_BY'),
        p2 AS (SELECT b.dst AS id, list_append(ids, b.dst) AS ids FROM p1 JOIN both_ways b ON b.src = p1.id AND b.type <> 'PLACED_BY'),
        p3 AS (SELECT b.dst AS id, list_append(ids, b.dst) AS ids FROM p2 JOIN both_ways b ON b.src = p2.id AND b.type <> 'PLACED_BY' WHERE b.dst NOT LIKE 'customer:%'),
        p4 AS (SELECT b.dst AS id, list_append(ids, b.dst) AS ids FROM p3 JOIN both_ways b ON b.src = p3.id AND b.type <> 'PLACED_BY' WHERE b.dst = '{START}'),
        a AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4)
        SELECT len(ids) - 1 AS steps, array_to_string(ids, ' ') AS path FROM a WHERE id = '{START}' ORDER BY len(ids), ids LIMIT 1""",
    ),
    "risk_within_2": (
        lambda s, d: G.risk_within(_risk_nodes(s, d), A.edges(s, d), A.nodes(s, d).where(F.array_contains("labels", "Supplier")), 2),
        """WITH near AS (SELECT DISTINCT 'supplier:' || s_suppkey AS id FROM supplier JOIN customer ON c_nationkey = s_nationkey WHERE c_acctbal < 0)
        SELECT 'supplier:' || s_suppkey AS id, near.id IS NOT NULL AS flagged FROM supplier LEFT JOIN near ON near.id = 'supplier:' || s_suppkey""",
    ),
    "dossier": (
        lambda s, d: G.dossier(A.nodes(s, d), A.edges(s, d), "nation:4", 1).select("id", F.size("neighbors").cast("long").alias("near"), "merge_history"),
        f"WITH {N}, {E}, {B} SELECT 'nation:4' AS id, least(500, count(DISTINCT dst)) AS near, 'unavailable' AS merge_history FROM both_ways WHERE src = 'nation:4'",
    ),
    "summarize_sample": (
        lambda s, d: G.summarize(A.nodes(s, d).select("id")).select("count", F.array_join("sample", " ").alias("sample")),
        f"""WITH {N}, j AS (SELECT '{{"id":"' || id || '"}}' AS j FROM nodes) SELECT (SELECT count(*) FROM j) AS count, (SELECT string_agg(j, ' ' ORDER BY j) FROM (SELECT j FROM j ORDER BY j LIMIT 3)) AS sample""",
    ),
    "search_nodes": (
        lambda s, d: _named(G.search(A.nodes(s, d), "CUSTOMER#00000001", 50)),
        f"WITH {N} SELECT id, name FROM nodes WHERE contains(lower(name), 'customer#00000001') ORDER BY id LIMIT 50",
    ),
    "first_label": (
        lambda s, d: A.nodes(s, d).groupBy(G.first_label(F.col("labels")).alias("label")).agg(F.count(F.lit(1)).alias("n")),
        f"WITH {N} SELECT label, count(*) AS n FROM nodes GROUP BY label",
    ),
    "feed_recent": (
        lambda s, d: G.recent_articles(_articles(s, d), 50),
        """SELECT 'doc:' || doc_id AS id, text[1:80] AS title, strftime(coalesce(published_at, retrieved_at), '%Y-%m-%d %H:%M:%S') AS "at" FROM documents ORDER BY "at" DESC NULLS FIRST, id LIMIT 50""",
    ),
    "points_bbox": (
        lambda s, d: G.points(_places(s, d), _centroids(s, d), (-60.0, -25.0, 60.0, 45.0)).select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "geo_precision"),
        """WITH p AS (SELECT 'supplier:' || s_suppkey AS id, s_suppkey % 3 = 0 AS precise, CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey % 90)::DOUBLE ELSE n_nationkey * 2.5 - 30 END AS lat,
        CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey % 180)::DOUBLE ELSE n_nationkey * 7.0 - 90 END AS lon FROM supplier JOIN nation ON s_nationkey = n_nationkey)
        SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, CASE WHEN precise THEN 'precise' ELSE 'country' END AS geo_precision FROM p WHERE lat BETWEEN -25 AND 45 AND lon BETWEEN -60 AND 60""",
    ),
    "brief_sources": (
        lambda s, d: G.brief_sources(read(s, d, "article_text").select(F.col("entity_id").alias("pos"), "url", F.col("source_id").alias("title"))).select("pos", "url", "title"),
        """SELECT min(entity_id) AS pos, url, arg_min(source_id, entity_id) AS title FROM article_text WHERE url <> '' GROUP BY url ORDER BY pos LIMIT 12""",
    ),
    "anchor_uniqueness": (
        lambda s, d: G.anchor_violations(A.nodes(s, d), ("segment",)),
        "SELECT 'segment' AS anchor, c_mktsegment AS value, count(DISTINCT c_custkey) AS holders FROM customer GROUP BY c_mktsegment HAVING count(*) > 1",
    ),
    "set_node_values": (
        lambda s, d: _named(G.get_entity(G.set_node_values(A.nodes(s, d), START, {"name": ["Renamed"], "gone": []}, caption="R"), START)),
        f"SELECT '{START}' AS id, 'Renamed' AS name",
    ),
    "graph_snapshot": (
        lambda s, d: G.snapshot(A.nodes(s, d)).select("id", F.array_join("labels", ",").alias("labels"), F.array_join(F.col("props")["name"], ",").alias("name")),
        f"WITH {N} SELECT id, CASE WHEN label < 'Entity' THEN label || ',Entity' ELSE 'Entity,' || label END AS labels, name FROM nodes",
    ),
}
