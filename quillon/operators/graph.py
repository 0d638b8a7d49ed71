"""The property graph: building nodes and edges from entities, and bounded reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon import ontology as O
from quillon.functions.scalars import clamp, first_value, in_box, to_float
from quillon.runtime import table

MAX_HOPS = 4


def build_nodes(entities: DataFrame) -> DataFrame:
    """Node rows of the entities that are no edges: schema and topic labels, properties, provenance.

    Entities without a source are refused by the ``source_id`` filter, as a node must say where it is from.
    """
    e = entities.where(~O.is_edge(F.col("schema")) & F.coalesce(F.col("prov.source_id") != "", F.lit(False)))
    topics = F.coalesce(F.col("props")["topics"], F.array().cast("array<string>"))
    labels = F.array_distinct(F.concat(F.array(F.lit("Entity"), F.col("schema")), F.transform(topics, O.topic_label)))
    prov = F.map_from_entries(F.array(*(
        F.struct(F.lit(f"prov_{k}").alias("key"), F.array(F.col(f"prov.{k}")).alias("value")) for k in ("source_id", "retrieved_at", "reliability", "source_record")
    )))
    single = F.map_filter(F.coalesce("anchors", F.create_map().cast("map<string,array<string>>")), lambda k, v: F.size(v) == 1)
    return e.select("id", labels.alias("labels"), F.map_concat(F.col("props"), single, prov).alias("props"))


def build_links(entities: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of entity-typed properties, and ghost nodes for targets that are no nodes.

    The first source, by retrieval time, gives an edge its properties.
    """
    pairs = entities.where(~O.is_edge(F.col("schema"))).select(
        F.col("id").alias("src"), "schema", "prov", F.explode("props").alias("prop", "values")
    ).withColumn("type", O.link_label(F.col("schema"), F.col("prop"))).where("type is not null")
    rows = pairs.select("src", "type", "prov", F.explode("values").alias("dst")).where(F.col("dst") != "")
    links = rows.groupBy("type", "src", "dst").agg(F.min_by("prov", F.col("prov.retrieved_at")).alias("prov")).select(
        F.concat_ws("|", "type", "src", "dst").alias("edge_id"), "type", "src", "dst", _prov_props("prov").alias("props")
    )
    ghosts = links.select(F.col("dst").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti").select(
        "id", F.array(F.lit("Entity"), F.lit("Ghost")).alias("labels"), F.create_map().cast("map<string,array<string>>").alias("props")
    )
    return links, ghosts


def _prov_props(prov: str) -> Column:
    return F.map_from_entries(F.array(*(
        F.struct(F.lit(f"prov_{k}").alias("key"), F.array(F.col(f"{prov}.{k}")).alias("value")) for k in ("source_id", "retrieved_at")
    )))


def build_edges(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of edge entities: each source with each target, no self-loops, both ends must be nodes, one row per id."""
    held = {k: F.create_map(*[x for schema, ends in O.EDGES.items() for x in (F.lit(schema), F.lit(ends[i]))]) for i, k in enumerate(("source", "target", "label"))}
    of = {k: F.try_element_at(m, F.col("schema")) for k, m in held.items()}
    e = entities.where(F.col("schema").isin(*O.EDGES)).select("id", "prov", of["label"].alias("type"), F.try_element_at("props", of["source"]).alias("ss"), F.try_element_at("props", of["target"]).alias("ts"))
    rows = e.select(F.col("id").alias("own"), "prov", "type", F.explode("ss").alias("src"), "ts").select("own", "prov", "type", "src", F.explode("ts").alias("dst"))
    ids = nodes.select("id")
    rows = rows.where(F.col("src") != F.col("dst"))
    rows = rows.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    once = rows.groupBy("own", "type", "src", "dst").agg(F.min_by("prov", F.col("prov.retrieved_at")).alias("prov"))
    return once.select(F.concat_ws("|", "own", "src", "dst").alias("edge_id"), "type", "src", "dst", _prov_props("prov").alias("props"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Numbers of nodes, edges and articles in one row."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.array_contains("labels", "Article")).alias("articles"), F.lit(0).cast("long").alias("edges"))
    e = edges.agg(F.lit(0).cast("long").alias("nodes"), F.lit(0).cast("long").alias("articles"), F.count(F.lit(1)).alias("edges"))
    return n.unionByName(e).agg(*(F.sum(c).alias(c) for c in ("nodes", "edges", "articles")))


def degree_top(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """Nodes by outgoing edges, zero included, ties by id."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("score"))
    rows = nodes.select("id", F.array_contains("labels", "Sanction").alias("sanctioned")).join(out, "id", "left")
    return rows.select("id", F.coalesce("score", F.lit(0)).alias("score"), "sanctioned").orderBy(F.desc("score"), "id").limit(top)


def get_entity(nodes: DataFrame, entity_id: str) -> DataFrame:
    return nodes.where(F.col("id") == entity_id)


def get_provenance(nodes: DataFrame, entity_id: str) -> DataFrame:
    return get_entity(nodes, entity_id).select("id", F.map_filter("props", lambda k, v: k.startswith("prov_")).alias("provenance"))


def by_alias(nodes: DataFrame, ledger: DataFrame, entity_id: str) -> DataFrame:
    """Lookup by an id or an alias of it."""
    ids = ledger.where(F.col("canonical_alias") == entity_id).select(F.col("canonical_id").alias("id"))
    own = nodes.where(F.col("id") == entity_id).select("id")
    return nodes.join(ids.unionByName(own).distinct(), "id", "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "type").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type"))


def neighborhood(nodes: DataFrame, edges: DataFrame, entity_id: str, limit: int = 500) -> DataFrame:
    """One row per edge of a node, either direction, with the type and the other node."""
    near = both_ways(edges.where((F.col("src") == entity_id) | (F.col("dst") == entity_id))).where(F.col("src") == entity_id)
    return near.select(F.col("dst").alias("id"), "type").join(nodes, "id").orderBy("id", "type").limit(limit)


def neighbors(nodes: DataFrame, edges: DataFrame, entity_id: str, hops: int = 1, limit: int | None = 500, avoid: DataFrame | None = None) -> DataFrame:
    """Distinct nodes within 1 to ``hops`` steps (at most four), without the start; ordered by id so that a cap is stable."""
    spark = nodes.sparkSession
    n = clamp(hops, 1, MAX_HOPS)
    step = both_ways(edges).select("src", "dst")
    if n > 1:  # all hops walk one written table
        step = table(step, "steps")
    if avoid is not None:
        step = step.join(avoid.select(F.col("id").alias("dst")), "dst", "left_anti")
    seen = front = spark.createDataFrame([(entity_id,)], "id string")
    for k in range(n):
        front = front.join(step, front["id"] == step["src"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        front = table(front, "front") if k + 1 < n else front  # each hop is walked once
        seen = seen.unionByName(front)
    out = nodes.join(seen.where(F.col("id") != entity_id), "id", "left_semi")
    return out if limit is None else out.orderBy("id").limit(limit)


def risk_within(nodes: DataFrame, edges: DataFrame, members: DataFrame, hops: int = 1) -> DataFrame:
    """``(id, flagged)``: whether a path of at most ``hops`` steps without ghosts leads to another node with a risk label.

    The walk goes backwards from the risky nodes.  A node keeps the least and the
    greatest of the risky ids that it reaches, which tells whether any is not the
    node itself, so a round has a row a node and never a row a pair.
    """
    ghosts = nodes.where(F.array_contains("labels", "Ghost")).select(F.col("id").alias("dst")).distinct()
    labels = [F.lit("".join(p.title() for p in r.split("."))) for r in O.RISKS]
    risky = nodes.where(F.arrays_overlap("labels", F.array(*labels)) & F.col("id").isNotNull()).select("id").distinct()
    starts = table(members.select("id").distinct(), "members")
    held = table(risky.select("id", F.col("id").alias("lo"), F.col("id").alias("hi")), "risks")
    n = clamp(hops, 1, MAX_HOPS)
    for k in range(n):
        step = both_ways(edges).select("src", "dst")
        if k + 1 == n:  # the last step is asked for the members only
            step = step.join(starts.select(F.col("id").alias("src")), "src", "left_semi")
        ends = held.select(F.col("id").alias("dst"), "lo", "hi").join(ghosts, "dst", "left_anti")
        near = step.join(ends, "dst").select(F.col("src").alias("id"), "lo", "hi")
        held = table(held.unionByName(near).groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "risks")
    hit = held.where((F.col("lo") != F.col("id")) | (F.col("hi") != F.col("id"))).select("id", F.lit(True).alias("flagged"))
    return starts.join(hit, "id", "left").select("id", F.coalesce("flagged", F.lit(False)).alias("flagged"))


def shortest_path(edges: DataFrame, from_id: str, to_id: str, max_hops: int = MAX_HOPS) -> DataFrame:
    """One undirected shortest path as ``(ids, types)``: the smallest by its ids; no row if there is none.

    Each step keeps one path per reached node, the smallest, so the frontier never exceeds the nodes.
    """
    spark = edges.sparkSession
    step = table(both_ways(edges), "steps")
    front = spark.createDataFrame([(from_id, [from_id], [])], "id string, ids array<string>, types array<string>")
    seen, goals = front.select("id"), []
    for k in range(clamp(max_hops, 1, MAX_HOPS)):
        nxt = front.join(step, front["id"] == step["src"]).select(
            F.col("dst").alias("id"), F.concat("ids", F.array("dst")).alias("ids"), F.concat("types", F.array("type")).alias("types")
        ).join(seen, "id", "left_anti")
        front = table(nxt.groupBy("id").agg(F.min(F.struct("ids", "types")).alias("p")).select("id", "p.ids", "p.types"), "front")
        goals.append(front.where(F.col("id") == to_id))
        seen = seen.unionByName(front.select("id"))
    rows = goals[0]
    for g in goals[1:]:
        rows = rows.unionByName(g)
    return rows.select("ids", "types").orderBy(F.size("ids"), "ids").limit(1)


def summarize(items: DataFrame, sample: int = 3) -> DataFrame:
    """``(count, sample)``: the number of rows and the first few by their JSON."""
    j = items.select(F.to_json(F.struct(*sorted(items.columns))).alias("j"))
    first = j.orderBy("j").limit(sample).agg(F.array_sort(F.collect_list("j")).alias("sample"))
    n = j.agg(F.count(F.lit(1)).alias("count"))
    # two tables of one row
    return n.withColumn("k", F.lit(1)).join(first.withColumn("k", F.lit(1)), "k").drop("k")


def dossier(nodes: DataFrame, edges: DataFrame, entity_id: str, hops: int = 1) -> DataFrame:
    """An entity with its provenance and neighbours in one row; no row for an unknown id."""
    near = neighbors(nodes, edges, entity_id, hops).agg(F.array_sort(F.collect_list("id")).alias("neighbors")).withColumn("id", F.lit(entity_id))
    return get_entity(nodes, entity_id).join(get_provenance(nodes, entity_id), "id").join(near, "id").withColumn("merge_history", F.lit("unavailable"))


def search(nodes: DataFrame, term: str, limit: int = 50) -> DataFrame:
    """Nodes any of whose names or titles contains a term, whatever the case."""
    t = term.lower()
    hit = F.lit(False)
    for p in ("name", "title"):
        hit = hit | F.coalesce(F.exists(F.col("props")[p], lambda v: F.lower(v).contains(t)), F.lit(False))
    return nodes.where(hit).orderBy("id").limit(limit)


def first_label(labels: Column) -> Column:
    """First label that is not the general one."""
    return F.get(F.filter(labels, lambda x: x != "Entity"), F.lit(0))


def recent_articles(nodes: DataFrame, limit: int = 50) -> DataFrame:
    """Articles by publishing or retrieval time, newest first, null first; ties by id."""
    at = F.coalesce(first_value(F.col("props"), "publishedAt"), first_value(F.col("props"), "prov_retrieved_at"))
    rows = nodes.where(F.array_contains("labels", "Article")).select("id", first_value(F.col("props"), "title").alias("title"), at.alias("at"))
    return rows.orderBy(F.desc_nulls_first("at"), "id").limit(clamp(limit, 1, 500))


def recent_events(nodes: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    """Events newest first with each proof's source; events without proof stay."""
    e = nodes.where(F.array_contains("labels", "Event")).select("id", first_value(F.col("props"), "date").alias("date"), first_value(F.col("props"), "summary").alias("summary"))
    proof = edges.where(F.col("type") == "PROOF").select(F.col("src").alias("id"), F.col("dst").alias("source_id"))
    source = nodes.select(F.col("id").alias("source_id"), first_value(F.col("props"), "sourceUrl").alias("source_url"))
    return e.join(proof, "id", "left").join(source, "source_id", "left").orderBy(F.desc_nulls_first("date"), "id", "source_id").limit(clamp(limit, 1, 500))


def geo_candidates(nodes: DataFrame, edges: DataFrame, limit: int = 500) -> DataFrame:
    """Nodes with coordinates or a country; an event at an address lends it its own attributes."""
    p = F.col("props")
    places = nodes.select("id", first_value(p, "latitude").alias("lat"), first_value(p, "longitude").alias("lon"), F.lower(first_value(p, "country")).alias("country"),
                          first_value(p, "name").alias("name"), first_label(F.col("labels")).alias("schema"))
    at = edges.where(F.col("type") == "ADDRESS_ENTITY").select(F.col("src").alias("event_id"), F.col("dst").alias("id"))
    event = nodes.where(F.array_contains("labels", "Event")).select(F.col("id").alias("event_id"), first_value(p, "summary").alias("event_name"))
    rows = places.where("lat is not null or country is not null").join(at.join(event, "event_id"), "id", "left")
    return rows.select(
        F.coalesce("event_id", "id").alias("id"), F.coalesce("event_name", "name").alias("name"), "lat", "lon", "country",
        F.when(F.col("event_id").isNotNull(), "Event").otherwise(F.col("schema")).alias("schema"),
    ).orderBy("id").limit(clamp(limit, 1, 500))


def points(candidates: DataFrame, centroids: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Precise coordinates, else the country's centroid, else no row; the box is tested after any earlier limit.

    ``centroids`` is ``(country, c_lat, c_lon)``, a row per country.
    """
    rows = candidates.join(centroids, "country", "left")
    precise = to_float(F.col("lat")).isNotNull() & to_float(F.col("lon")).isNotNull()
    out = rows.select(
        "id", F.when(precise, to_float(F.col("lat"))).otherwise(F.col("c_lat")).alias("lat"), F.when(precise, to_float(F.col("lon"))).otherwise(F.col("c_lon")).alias("lon"),
        F.when(precise, "precise").otherwise("country").alias("geo_precision"),
    ).where("lat is not null and lon is not null")
    return out.where(in_box(F.col("lat"), F.col("lon"), box)) if box else out


def brief_sources(rows: DataFrame, most: int = 12) -> DataFrame:
    """First occurrence of each url by position, then the first few. ``rows`` is ``(pos, url, title)``."""
    once = rows.where(F.coalesce(F.col("url") != "", F.lit(False))).groupBy("url").agg(F.min(F.struct("pos", "title")).alias("f"))
    return once.select("f.pos", "url", "f.title").orderBy("pos").limit(most)


def set_node_values(nodes: DataFrame, node_id: str, values: dict[str, list[str]], drop_anchors: tuple[str, ...] = (), caption: str | None = None, drop_datasets: tuple[str, ...] = ()) -> DataFrame:
    """One node's values replaced: an empty list drops a property."""
    gone = [k for k, v in values.items() if not v] + list(drop_anchors)
    put = {k: v for k, v in values.items() if v} | ({"caption": [caption]} if caption is not None else {})
    props = F.map_filter("props", lambda k, v: ~k.isin(*gone, *put) if gone or put else F.lit(True))
    props = F.transform_values(props, lambda k, v: F.when(k == "datasets", F.array_except(v, F.array(*map(F.lit, drop_datasets)))).otherwise(v)) if drop_datasets else props
    if put:
        props = F.map_concat(props, F.create_map(*[x for k, v in put.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]))
    return nodes.withColumn("props", F.when(F.col("id") == node_id, props).otherwise(F.col("props")))


def anchor_violations(nodes: DataFrame, anchors: tuple[str, ...]) -> DataFrame:
    """External ids that more than one node has: ``(anchor, value, holders)``."""
    rows = nodes.select("id", F.explode("props").alias("anchor", "vs")).where(F.col("anchor").isin(*anchors)).select("id", "anchor", F.explode("vs").alias("value"))
    return rows.groupBy("anchor", "value").agg(F.count_distinct("id").alias("holders")).where("holders > 1")


def snapshot(nodes: DataFrame) -> DataFrame:
    """Nodes with each property as a set of strings."""
    return nodes.select("id", F.array_sort(F.array_distinct("labels")).alias("labels"), F.transform_values("props", lambda k, v: F.array_sort(F.array_distinct(v))).alias("props"))


def materialize(df: DataFrame) -> DataFrame:
    """A graph table written once and read by many bounded reads."""
    return table(df, "graph")
