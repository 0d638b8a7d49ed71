"""Views of the test tables in the engine's shapes: graph, runs, claims, ledger, entities, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.runtime import read

NOW = "2024-01-31 00:00:00"
Q = DataFrame


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _id(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.col(c).cast("string"))


def _props(**p: Column) -> Column:
    return F.map_from_arrays(F.array(*(F.lit(k) for k in p)), F.array(*(F.array(v.cast("string")) for v in p.values())))


def nodes(spark: SparkSession, d: str) -> Q:
    node = lambda df, i, label, **p: df.select(i.alias("id"), F.array(F.lit("Entity"), F.lit(label)).alias("labels"), _props(**p).alias("props"))
    c = F.col
    parts = [
        node(read(spark, d, "region"), _id("region", "r_regionkey"), "Region", name=c("r_name")),
        node(read(spark, d, "nation"), _id("nation", "n_nationkey"), "Nation", name=c("n_name")),
        node(read(spark, d, "customer"), _id("customer", "c_custkey"), "Customer", name=c("c_name"), segment=c("c_mktsegment")),
        node(read(spark, d, "supplier"), _id("supplier", "s_suppkey"), "Supplier", name=c("s_name")),
        node(read(spark, d, "orders"), _id("order", "o_orderkey"), "Order", name=c("o_orderstatus")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, d: str, orders: bool = True) -> Q:
    edge = lambda df, t, s, x: df.select(F.lit(t).alias("type"), s.alias("src"), x.alias("dst"))
    out = edge(read(spark, d, "nation"), "PART_OF", _id("nation", "n_nationkey"), _id("region", "n_regionkey"))
    out = out.unionByName(edge(read(spark, d, "customer"), "IN", _id("customer", "c_custkey"), _id("nation", "c_nationkey")))
    out = out.unionByName(edge(read(spark, d, "supplier"), "IN", _id("supplier", "s_suppkey"), _id("nation", "s_nationkey")))
    if orders:
        out = out.unionByName(edge(read(spark, d, "orders"), "PLACED_BY", _id("order", "o_orderkey"), _id("customer", "o_custkey")))
    return out.withColumn("edge_id", F.concat_ws("|", "type", "src", "dst"))


# the same in SQL
SQL_NODES = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'Region' AS label, r_name AS name FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'Customer', c_name FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier', s_name FROM supplier UNION ALL SELECT 'order:' || o_orderkey, 'Order', o_orderstatus FROM orders)"""
SQL_EDGES = """edges AS (
  SELECT 'PART_OF' AS type, 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 'IN', 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'IN', 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'PLACED_BY', 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders)"""
SQL_BOTH = "both_ways AS (SELECT src, dst, type FROM edges UNION ALL SELECT dst, src, type FROM edges)"


def runs(spark: SparkSession, d: str) -> Q:
    e = read(spark, d, "events")
    return e.select(
        F.col("user_id").alias("instance_id"), F.col("event_id").alias("run_id"), F.when(F.col("event_type") == "signup", "resolve").otherwise("ingest").alias("kind"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("ts").alias("started_at"), F.col("ts").alias("finished_at"), F.col("props").alias("stats"),
    )


def instances(spark: SparkSession, d: str) -> Q:
    i = read(spark, d, "events").select(F.col("user_id").alias("instance_id")).distinct()
    k = F.col("instance_id")
    return i.withColumn("status", F.when(k % 10 == 0, "disabled").when(k % 7 == 0, "error").otherwise("enabled")).withColumn("stream", k % 3 == 0)


SQL_RUNS = """runs AS (SELECT user_id AS instance_id, event_id AS run_id, CASE WHEN event_type = 'signup' THEN 'resolve' ELSE 'ingest' END AS kind,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, ts FROM events)"""
SQL_INSTANCES = """instances AS (SELECT DISTINCT user_id AS instance_id,
  CASE WHEN user_id % 10 = 0 THEN 'disabled' WHEN user_id % 7 = 0 THEN 'error' ELSE 'enabled' END AS status, user_id % 3 = 0 AS stream FROM events)"""


def claims(spark: SparkSession, d: str) -> Q:
    """Customers, suppliers and parts unpivoted; the canonical id is the entity's own."""
    def unpivot(df: Q, kind: str, key: str, dataset: str, **p: Column) -> Q:
        pairs = F.array(*(F.struct(F.lit(k).alias("prop"), v.cast("string").alias("value")) for k, v in p.items()))
        return df.select(_id(kind, key).alias("entity_id"), F.lit(dataset).alias("dataset"), F.explode(pairs).alias("x")).select("entity_id", "dataset", "x.prop", "x.value")

    c = F.col
    rows = unpivot(read(spark, d, "customer"), "customer", "c_custkey", "crm", name=c("c_name"), segment=c("c_mktsegment"), nation=c("c_nationkey"))
    rows = rows.unionByName(unpivot(read(spark, d, "supplier"), "supplier", "s_suppkey", "erp", name=c("s_name"), nation=c("s_nationkey")))
    rows = rows.unionByName(unpivot(read(spark, d, "part"), "part", "p_partkey", "catalog", name=c("p_name"), brand=c("p_brand"), size=c("p_size")))
    k = F.regexp_extract("entity_id", r"(\d+)$", 1).cast("long")
    return rows.withColumns({
        "canonical_id": F.col("entity_id"), "schema": F.lit("Company"), "statement_id": F.sha1(F.concat_ws("\0", "dataset", "entity_id", "prop", "value")),
        "reliability": F.lit("B"), "retrieved_at": F.lit("2024-01-01T00:00:00Z"), "raw_pointer": F.concat(F.lit("s3://landing/"), "entity_id"), "seq": k,
    })


SQL_CLAIMS = """claims AS (
  SELECT 'customer:' || c_custkey AS entity_id, 'crm' AS dataset, unnest(['name', 'segment', 'nation']) AS prop, unnest([c_name, c_mktsegment, c_nationkey::VARCHAR]) AS value, c_custkey AS seq FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'erp', unnest(['name', 'nation']), unnest([s_name, s_nationkey::VARCHAR]), s_suppkey FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'catalog', unnest(['name', 'brand', 'size']), unnest([p_name, p_brand, p_size::VARCHAR]), p_partkey FROM part)"""


def ledger(spark: SparkSession, d: str) -> Q:
    """A chained ledger: customer k gives way to k - 1 unless k divides by five."""
    k = F.col("c_custkey")
    c = read(spark, d, "customer")
    alias = F.concat(F.lit("customer:"), k.cast("string"))
    rows = c.where(k % 5 != 0).select(F.concat(F.lit("customer:"), (k - 1).cast("string")).alias("canonical_id"), alias.alias("canonical_alias"))
    own = c.select(alias.alias("canonical_id"), alias.alias("canonical_alias"))
    return rows.unionByName(own).withColumn("created_at", now())


SQL_SURVIVOR = """CASE WHEN {0} LIKE 'customer:%' THEN 'customer:' || (CAST(split_part({0}, ':', 2) AS BIGINT) - CAST(split_part({0}, ':', 2) AS BIGINT) % 5) ELSE {0} END"""


def entities(spark: SparkSession, d: str) -> Q:
    """The listed entities with their source as provenance."""
    e = read(spark, d, "ftm_entity")
    none = F.create_map().cast("map<string,array<string>>")
    prov = F.struct(F.get("datasets", F.lit(0)).alias("source_id"), F.col("last_seen").alias("retrieved_at"), F.lit("B").alias("reliability"), F.concat(F.lit("s3://landing/"), "id").alias("source_record"))
    return e.select("id", F.col("schema_name").alias("schema"), F.coalesce("properties", none).alias("props"), "datasets", prov.alias("prov"), none.alias("anchors"))


def companies_raw(spark: SparkSession, d: str) -> Q:
    c = read(spark, d, "company")
    return c.select(F.col("id").alias("key"), F.to_json(F.struct(*(x for x in c.columns if x not in ("id", "retrieved_at", "inactive")))).alias("value"), F.date_format("retrieved_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("retrieved_at"))


def gold(spark: SparkSession, d: str) -> Q:
    """Judged pairs with evenly spelled labels."""
    return read(spark, d, "er_gold_pair").withColumn("label", F.lower(F.trim("label")))


def partitions(spark: SparkSession, d: str) -> tuple[Q, Q]:
    """Embeddings by their label as gold, and by label and a bucket of ids as prediction."""
    e = read(spark, d, "embeddings")
    rec = F.col("vec_id").cast("string").alias("record")
    g = e.select(rec, F.concat(F.lit("g"), F.col("label").cast("string")).alias("label"))
    k = F.when(F.col("vec_id") % 11 == 0, F.lit("mixed")).otherwise(F.concat(F.lit("p"), F.col("label").cast("string"), F.lit("."), (F.col("vec_id") % 3).cast("string")))
    return g, e.select(rec, k.alias("label"))


SQL_PARTITIONS = """gold AS (SELECT vec_id::VARCHAR AS record, 'g' || label AS g FROM embeddings),
pred AS (SELECT vec_id::VARCHAR AS record, CASE WHEN vec_id % 11 = 0 THEN 'mixed' ELSE 'p' || label || '.' || (vec_id % 3) END AS p FROM embeddings),
cells AS (SELECT g, p, count(*) AS n FROM gold JOIN pred USING (record) GROUP BY ALL),
o AS (SELECT *, sum(n) OVER (PARTITION BY g) AS gs, sum(n) OVER (PARTITION BY p) AS ps FROM cells)"""


def scored(spark: SparkSession, d: str) -> Q:
    """Judged pairs with their clerical score as probability; none counts as 0.5."""
    return gold(spark, d).select("left_id", "right_id", "label", "source", F.coalesce("clerical_score", F.lit(0.5)).alias("probability"))


SQL_SCORED = "scored AS (SELECT left_id, right_id, lower(trim(label)) AS label, source, coalesce(clerical_score, 0.5) AS probability FROM er_gold_pair)"
