"""Queries of the claim log: unpivoting, closure, fold, reconciliation and erasure."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import scalars as X
from quillon.operators import claims as C
from quillon.operators import graph as G
from quillon.operators import mapping as M
from quillon.operators import reconcile as R
from quillon.plans import adapters as A
from quillon.runtime import read

CL = A.SQL_CLAIMS
SV = A.SQL_SURVIVOR


def _closure(s, d):
    return C.alias_closure(C.alias_map(A.ledger(s, d)))


def _folded(s, d):
    return C.fold(A.claims(s, d), _closure(s, d))


def _values(df, m="props"):
    return df.select("id", F.explode(m).alias("prop", "vs")).select("id", "prop", F.array_join("vs", ";").alias("vs"))


def _fold_nodes(s, d):
    return _folded(s, d).select("id", F.array(F.lit("Entity"), "schema").alias("labels"), "props", "datasets", "witnesses")


def _live_nodes(s, d):
    """The nodes of the single claims, without parts, with one spelling changed: a graph that has drifted from its log."""
    c = A.claims(s, d).where(~F.col("entity_id").startswith("part:"))
    v = F.when((F.col("prop") == "segment") & F.col("entity_id").endswith("7"), F.lit("DRIFTED")).otherwise(F.col("value"))
    per = c.groupBy("entity_id", "prop").agg(F.collect_set(v).alias("vs")).groupBy(F.col("entity_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("prop", "vs"))).alias("props"))
    return per.select("id", F.array(F.lit("Entity"), F.lit("Company"), F.lit("Old")).alias("labels"), "props")


FOLD = f"folded AS (SELECT {SV.format('entity_id')} AS id, prop, value, dataset, entity_id FROM claims)"
LIVE = f"""live AS (SELECT entity_id AS id, {SV.format('entity_id')} AS survivor, prop, CASE WHEN prop = 'segment' AND entity_id LIKE '%7' THEN 'DRIFTED' ELSE value END AS value
  FROM claims WHERE entity_id NOT LIKE 'part:%')"""

QUERIES = {
    "statement_unpivot": (
        lambda s, d: C.statements(A.entities(s, d).select(F.col("id").alias("canonical_id"), F.col("id").alias("member_id")), A.entities(s, d)).select("entity_id", "prop", "value", "dataset"),
        """SELECT DISTINCT id AS entity_id, e.key AS prop, unnest(e.value) AS value, datasets[1] AS dataset FROM (SELECT id, datasets, unnest(map_entries(properties)) AS e FROM ftm_entity) WHERE datasets[1] <> ''""",
    ),
    "statement_dedup": (
        lambda s, d: A.claims(s, d).unionByName(A.claims(s, d)).dropDuplicates(["statement_id"]).groupBy("dataset").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {CL} SELECT dataset, count(*) AS n FROM claims GROUP BY dataset",
    ),
    "alias_closure": (
        lambda s, d: _closure(s, d),
        "SELECT 'customer:' || c_custkey AS alias, 'customer:' || (c_custkey - c_custkey % 5) AS survivor FROM customer WHERE c_custkey % 5 <> 0",
    ),
    "incomplete_survivors": (
        lambda s, d: C.incomplete_survivors(_closure(s, d), A.claims(s, d).where("entity_id != 'customer:0'").where(~F.col("entity_id").rlike("customer:[0-4]$"))),
        """SELECT 'customer:0' AS survivor""",
    ),
    "resolve_single_hop": (
        lambda s, d: C.resolve_once(read(s, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("alias")), A.ledger(s, d).where("canonical_id != canonical_alias")),
        "SELECT 'customer:' || c_custkey AS alias, 'customer:' || (c_custkey - (c_custkey % 5 <> 0)::INT) AS durable FROM customer",
    ),
    "fold_values": (
        lambda s, d: _values(_folded(s, d)),
        f"WITH {CL}, {FOLD} SELECT id, prop, string_agg(DISTINCT value, ';' ORDER BY value) AS vs FROM folded GROUP BY id, prop",
    ),
    "fold_witness": (
        lambda s, d: _values(_folded(s, d), "witnesses"),
        f"WITH {CL}, {FOLD} SELECT id, prop, string_agg(DISTINCT dataset, ';' ORDER BY dataset) AS vs FROM folded GROUP BY id, prop",
    ),
    "fold_representative": (
        lambda s, d: _folded(s, d).select("id", "schema", F.col("prov.source_record").alias("record"), F.array_join("datasets", ";").alias("datasets")),
        f"WITH {CL}, {FOLD} SELECT id, 'Company' AS schema, 's3://landing/' || min(entity_id) AS record, string_agg(DISTINCT dataset, ';') AS datasets FROM folded GROUP BY id",
    ),
    "fold_incremental": (
        lambda s, d: _values(C.fold_since(A.claims(s, d), _closure(s, d), 90)),
        f"""WITH {CL}, {FOLD}, touched AS (SELECT DISTINCT {SV.format('entity_id')} AS id FROM claims WHERE seq > 90)
        SELECT id, prop, string_agg(DISTINCT value, ';' ORDER BY value) AS vs FROM folded JOIN touched USING (id) GROUP BY id, prop""",
    ),
    "numbered_batch": (
        lambda s, d: C.numbered(read(s, d, "customer").select("c_custkey"), 1000, "c_custkey").select("c_custkey", "seq"),
        "SELECT c_custkey, 1000 + row_number() OVER (ORDER BY c_custkey) AS seq FROM customer",
    ),
    "rewrite_referents": (
        lambda s, d: C.rewrite_referents(
            read(s, d, "orders").select(F.concat(F.lit("evt:"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("Event").alias("schema"),
                                        F.create_map(F.lit("involved"), F.array(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")))).alias("props")), _closure(s, d)
        ).select("id", F.get(F.col("props")["involved"], F.lit(0)).alias("involved")),
        "SELECT 'evt:' || o_orderkey AS id, 'customer:' || (o_custkey - o_custkey % 5) AS involved FROM orders",
    ),
    "ledger_rows": (
        lambda s, d: C.ledger_rows(
            read(s, d, "merge_audit").select("canonical_id", F.concat(F.lit("wm-"), "canonical_id").alias("durable_id")).distinct(),
            read(s, d, "merge_audit").select("canonical_id", F.explode("source_ids").alias("member_id")).distinct(), A.ledger(s, d)),
        """WITH c AS (SELECT canonical_id, unnest(source_ids) AS m FROM merge_audit) SELECT DISTINCT 'wm-' || canonical_id AS canonical_id, unnest(['wm-' || canonical_id, m, canonical_id]) AS canonical_alias FROM c""",
    ),
    "decision_rows": (
        lambda s, d: C.decisions(read(s, d, "merge_audit").select("canonical_id", F.explode("source_ids").alias("member_id"), "score")).select("canonical_id", "kind", F.array_join("member_ids", ",").alias("members"), F.round("score", 6).alias("score")),
        """WITH c AS (SELECT canonical_id, unnest(source_ids) AS m, score FROM merge_audit) SELECT canonical_id, 'merge' AS kind, string_agg(DISTINCT m, ',' ORDER BY m) AS members, round(max(score), 6) AS score FROM c GROUP BY canonical_id HAVING count(DISTINCT m) > 1""",
    ),
    "latest_audit": (
        lambda s, d: read(s, d, "merge_audit").groupBy("canonical_id").agg(F.max_by(F.struct("id", "decision"), F.struct("created_at", "id")).alias("x")).select("canonical_id", "x.id", "x.decision"),
        "SELECT canonical_id, id, decision FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY created_at DESC, id DESC) AS k FROM merge_audit) WHERE k = 1",
    ),
    "evidence_diff": (
        lambda s, d: C.evidence_diff(A.entities(s, d).where("schema = 'Vessel'")).select("prop", "agrees", F.size("values").cast("long").alias("n")),
        """WITH e AS (SELECT id, unnest(map_entries(properties)) AS e FROM ftm_entity WHERE schema_name = 'Vessel') SELECT e.key AS prop, count(DISTINCT array_to_string(list_sort(e.value), '; ')) <= 1 AS agrees, count(DISTINCT array_to_string(list_sort(e.value), '; ')) AS n FROM e WHERE len(e.value) > 0 GROUP BY e.key""",
    ),
    "divergence": (
        lambda s, d: R.divergence(_live_nodes(s, d), A.edges(s, d), _fold_nodes(s, d).where("id != 'supplier:9'"), A.edges(s, d).where("type != 'PART_OF'"), _closure(s, d)),
        f"""WITH {CL}, {FOLD}, {LIVE}, f AS (SELECT DISTINCT id, prop, value FROM folded WHERE id <> 'supplier:9')
        SELECT 'missing_nodes' AS what, count(DISTINCT live.id) AS n FROM live WHERE survivor NOT IN (SELECT id FROM f)
        UNION ALL SELECT 'stale_nodes', count(DISTINCT live.id) FROM live WHERE survivor IN (SELECT id FROM f) AND NOT EXISTS (SELECT 1 FROM f WHERE f.id = survivor AND f.prop = live.prop AND f.value = live.value)
        UNION ALL SELECT 'missing_edges', count(*) FROM nation""",
    ),
    "fold_extras": (
        lambda s, d: R.fold_extras(_live_nodes(s, d), A.edges(s, d), _fold_nodes(s, d), A.edges(s, d), _closure(s, d))[0],
        "SELECT 'part:' || p_partkey AS id FROM part",
    ),
    "copresent_values": (
        lambda s, d: R.extra_values(_live_nodes(s, d), _fold_nodes(s, d), _closure(s, d)),
        f"WITH {CL}, {FOLD}, {LIVE} SELECT DISTINCT id, prop, value FROM folded f WHERE id IN (SELECT survivor FROM live) AND NOT EXISTS (SELECT 1 FROM live WHERE survivor = f.id AND live.prop = f.prop AND live.value = f.value)",
    ),
    "label_parity": (
        lambda s, d: R.label_differences(_live_nodes(s, d), _fold_nodes(s, d), _closure(s, d)),
        f"WITH {CL}, {LIVE} SELECT DISTINCT survivor AS id, 'Old' AS label, 'missing_in_fold' AS side FROM live",
    ),
    "count_reconcile": (
        lambda s, d: R.count_reconcile(_live_nodes(s, d), _fold_nodes(s, d), _closure(s, d)),
        f"""WITH {CL}, {FOLD}, {LIVE}, x AS (SELECT (SELECT count(DISTINCT id) FROM live) AS live, (SELECT count(DISTINCT survivor) FROM live) AS live_survivors, 0::BIGINT AS duplicates,
        (SELECT count(*) FROM part) AS extras, (SELECT count(DISTINCT id) FROM folded) AS fold) SELECT *, duplicates + (fold - live_survivors - extras) AS residual FROM x""",
    ),
    "erased_residue": (
        lambda s, d: R.residue(_fold_nodes(s, d), s.createDataFrame([("erp",), ("gone",)], "source string")).select("id", F.array_join("sources", ",").alias("sources")),
        "SELECT 'supplier:' || s_suppkey AS id, 'erp' AS sources FROM supplier",
    ),
    "erase_source": (
        lambda s, d: R.erase_source(A.claims(s, d), "crm").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("entities")),
        f"WITH {CL} SELECT dataset, count(*) AS n, count(DISTINCT entity_id) AS entities FROM claims WHERE dataset <> 'crm' GROUP BY dataset",
    ),
    "prune_nodes": (
        lambda s, d: R.prune_nodes(_fold_nodes(s, d), "erp").groupBy(F.substring_index("id", ":", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
        f"WITH {CL}, {FOLD} SELECT split_part(id, ':', 1) AS kind, count(DISTINCT id) AS n FROM folded WHERE id NOT LIKE 'supplier:%' GROUP BY 1",
    ),
    "redact_shell": (
        lambda s, d: R.redact_queue(read(s, d, "er_queue_item"), "bluesky:firehose").select("id", F.coalesce(F.get_json_object("raw_entity", "$.redacted") == "true", F.lit(False)).alias("redacted")),
        "SELECT id, CASE WHEN json_valid(raw_entity) THEN coalesce(json_extract_string(raw_entity, '$.context.wm_prov_source_id') = 'bluesky:firehose', false) ELSE false END AS redacted FROM er_queue_item",
    ),
    "map_companies": (
        lambda s, d: M.companies(A.companies_raw(s, d), "opencorporates:main").select("id", F.get(F.col("props")["name"], F.lit(0)).alias("name"), F.get(F.col("anchors")["opencorporates_id"], F.lit(0)).alias("anchor"), F.col("prov.source_record").alias("record")),
        """SELECT 'opencorporates-' || concat_ws('-', jurisdiction_code, company_number) AS id, CASE WHEN trim(name) <> '' THEN name END AS name, concat_ws('/', jurisdiction_code, company_number) AS anchor, 's3://landing/opencorporates/main/' || id AS record
        FROM company WHERE name <> '' AND company_number <> ''""",
    ),
    "map_victims": (
        lambda s, d: M.ransomware(read(s, d, "company").select(F.col("id").alias("key"), F.to_json(F.struct(F.col("name").alias("victim"), F.lit("Lock-Group 9").alias("group"), F.col("opencorporates_url").alias("url"))).alias("value"), F.lit("2024").alias("retrieved_at")), "rw:x")
        .groupBy("schema").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")),
        """WITH v AS (SELECT coalesce(opencorporates_url, concat_ws('|', name, 'Lock-Group 9')) AS k FROM company WHERE name <> '')
        SELECT unnest(['Company', 'Organization', 'UnknownLink']) AS schema, count(*) AS n, unnest([count(DISTINCT k), 1, count(DISTINCT k)]) AS ids FROM v""",
    ),
    "links_and_ghosts": (
        lambda s, d: G.build_links(
            read(s, d, "orders").select(F.concat(F.lit("evt:"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("Event").alias("schema"),
                                        F.create_map(F.lit("involved"), F.array(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")))).alias("props"),
                                        F.struct(F.lit("a:b").alias("source_id"), F.lit("2024").alias("retrieved_at"), F.lit("A").alias("reliability"), F.lit("r").alias("source_record")).alias("prov")),
            A.nodes(s, d).where(~F.col("id").endswith("3")))[1].select("id"),
        "SELECT DISTINCT 'customer:' || o_custkey AS id FROM orders WHERE o_custkey % 10 = 3",
    ),
    "edge_entities": (
        lambda s, d: G.build_edges(
            read(s, d, "customer").select(F.concat(F.lit("own:"), F.col("c_custkey").cast("string")).alias("id"), F.lit("Ownership").alias("schema"),
                                          F.create_map(F.lit("owner"), F.array(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string"))), F.lit("asset"), F.array(
                                              F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")), F.lit("nowhere"))).alias("props"),
                                          F.struct(F.lit("a:b").alias("source_id"), F.lit("2024").alias("retrieved_at"), F.lit("A").alias("reliability"), F.lit("r").alias("source_record")).alias("prov")),
            A.nodes(s, d)).select("type", "src", "dst"),
        "SELECT 'OWNS' AS type, 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst FROM customer",
    ),
    "ioc_ids": (
        lambda s, d: read(s, d, "article_text").select("entity_id", X.indicator_id(F.col("url")).alias("ioc"), X.safe_segment(F.col("url")).alias("segment"), X.url_slug(F.col("url")).alias("slug")),
        """SELECT entity_id, 'ioc-' || sha1(lower(trim(url))) AS ioc, coalesce(nullif(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), '^\\.+', ''), ''), '_') AS segment, string_split(rtrim(url, '/'), '/')[-1] AS slug FROM article_text""",
    ),
    "canonical_ids": (
        lambda s, d: read(s, d, "merge_audit").select("id", X.canonical_id(F.array_distinct("source_ids")).alias("cid")),
        """WITH m AS (SELECT id, list_sort(list_distinct(source_ids)) AS m FROM merge_audit) SELECT id, CASE WHEN len(m) = 1 THEN m[1] WHEN len(m) > 1 THEN 'wmc-' || sha256(array_to_string(m, chr(0)))[1:40] END AS cid FROM m""",
    ),
    "anchor_ids": (
        lambda s, d: read(s, d, "company").where("company_number != ''").select("id", X.anchor_id(F.lit("regno"), F.col("company_number")).alias("anchor")),
        """WITH c AS (SELECT id, company_number AS v, regexp_replace(company_number, '[^A-Za-z0-9.-]', '-', 'g') AS s FROM company WHERE company_number <> '')
        SELECT id, CASE WHEN s <> v OR regexp_matches(v, '[.-]$') OR regexp_matches('wm-anchor-regno-' || s, '-[0-9a-f]{12}$') THEN 'wm-anchor-regno-' || s || '-' || sha256(v)[1:12] ELSE 'wm-anchor-regno-' || s END AS anchor FROM c""",
    ),
}
