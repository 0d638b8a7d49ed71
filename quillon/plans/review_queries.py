"""Queries of the review of merges, of ids, and of the upkeep of the log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon import ontology as O
from quillon.functions import python_udfs as P
from quillon.functions import scalars as X
from quillon.operators import claims as C
from quillon.operators import clustering as K
from quillon.operators import evaluation as V
from quillon.operators import graph as G
from quillon.operators import reconcile as R
from quillon.operators import review as W
from quillon.operators import sinks as S
from quillon.operators import upkeep as U
from quillon.plans import adapters as A
from quillon.runtime import read, shared_dir, table

c = F.col


def _nodes(s, d):
    """Every third queue entity is in the graph already."""
    return read(s, d, "er_queue_item").where("entity_id is not null").select(c("entity_id").alias("id")).distinct().where(F.substring(F.md5("id"), 1, 1).isin("0", "1", "2", "3"))


NODES = "nodes AS (SELECT DISTINCT entity_id AS id FROM er_queue_item WHERE entity_id IS NOT NULL AND md5(entity_id)[1] IN ('0', '1', '2', '3'))"
LAST = "last AS (SELECT canonical_id, arg_max({'s': source_ids, 'd': lower(trim(decision))}, (created_at, id)) AS x FROM merge_audit WHERE canonical_id IS NOT NULL GROUP BY canonical_id)"
ASKED = "asked AS (SELECT DISTINCT canonical_id, CASE WHEN md5(canonical_id)[2] < '8' THEN 'merged' ELSE 'rejected' END AS wanted FROM merge_audit WHERE canonical_id IS NOT NULL)"
STATE = f"""{NODES}, {LAST}, {ASKED}, j AS (SELECT canonical_id, wanted, x.s AS s, x.d AS d, EXISTS (SELECT 1 FROM nodes WHERE list_contains(x.s, id)) AS m, canonical_id IN (SELECT id FROM nodes) AS o FROM asked JOIN last USING (canonical_id)),
state AS (SELECT canonical_id, wanted, s, CASE WHEN d = wanted THEN 'already' WHEN d IN ('merged', 'rejected') THEN 'was ' || d WHEN wanted = 'merged' AND m THEN 'rejection was begun' WHEN wanted = 'rejected' AND o THEN 'approval was begun' ELSE 'apply' END AS state FROM j)"""


def _decided(s, d):
    audit = read(s, d, "merge_audit")
    asked = audit.where("canonical_id is not null").select("canonical_id").distinct().withColumn("wanted", F.when(F.substring(F.md5("canonical_id"), 2, 1) < "8", W.MERGED).otherwise(W.REJECTED))
    return table(W.decide(audit, _nodes(s, d), asked), "decided")


def _queue_entities(s, d):
    """Queue payloads as entities, one per entity id."""
    from quillon.plans.pipeline import queue_entities

    q = read(s, d, "er_queue_item").where("entity_id is not null").withColumn("status", F.lit("pending"))
    return queue_entities(q)


def _seeds(s, d):
    return read(s, d, "seed_spec").select("connector_id", "natural_key", "enabled")


def _uuid5(text: str) -> str:
    """DuckDB text of a name-based uuid in the namespace of urls."""
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({text}))"
    nib = f"substr('89ab', (('0x' || substr({h}, 17, 1))::INT % 4) + 1, 1)"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {nib} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


def _reg(s, d):
    """Customers as entities with external ids."""
    k = c("c_custkey")
    props = F.create_map(F.lit("leiCode"), F.array(F.concat(F.lit("L"), (k % 50).cast("string"))), F.lit("wikidataId"), F.array(F.concat(F.lit("Q"), k.cast("string"))))
    return read(s, d, "customer").select(F.concat(F.lit("customer:"), k.cast("string")).alias("id"), props.alias("props"), F.create_map(F.lit("lei"), F.array(F.concat(F.lit("L"), (k % 50).cast("string")), F.lit("L1"))).alias("anchors"), k)


def _enqueued(s, d):
    path = f"{shared_dir(s)}/queue-{uuid.uuid4().hex[:8]}"
    e = A.entities(s, d)
    for _ in range(2):  # the second time adds nothing
        S.enqueue(e, path, "lists")
    return s.read.parquet(path)


def _upserted(s, d):
    path = f"{shared_dir(s)}/texts-{uuid.uuid4().hex[:8]}"
    t = read(s, d, "article_text").select("entity_id", "url", "text", "raw_pointer", "last_error")
    S.upsert_text(t.withColumn("last_error", F.lit("")), path)
    S.upsert_text(t.withColumns({"text": F.lit("new"), "last_error": F.when(c("entity_id") < "m", "boom").otherwise("")}), path)
    return S.read_or_none(s, path)


def _graph_merged(s, d):
    root = f"{shared_dir(s)}/graph-{uuid.uuid4().hex[:8]}"
    n, e = A.nodes(s, d), A.edges(s, d).withColumn("props", F.create_map().cast("map<string,array<string>>"))
    ghosts = n.where("id like 'nation:%'").select("id", F.array(F.lit("Entity"), F.lit("Ghost")).alias("labels"), F.create_map().cast("map<string,array<string>>").alias("props"))
    S.write_graph(n.where("id not like 'nation:%'").unionByName(ghosts), e.limit(0), root)
    S.write_graph(n.where("id not like 'order:%'"), e, root)
    S.write_graph(ghosts, e.where("type = 'IN'"), root)
    nodes, edges = S.read_or_none(s, f"{root}/nodes"), S.read_or_none(s, f"{root}/edges")
    a = nodes.select(F.concat_ws(",", F.array_sort("labels")).alias("what"), c("id"))
    return a.groupBy("what").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).unionByName(
        edges.groupBy(c("type").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("edge_id").alias("ids")))


def _real_places(s, d):
    """Events at addresses: customers with a country are the addresses of some orders' events."""
    nat = read(s, d, "nation").select(c("n_nationkey").alias("k"), "n_name")
    cu = read(s, d, "customer").join(nat, c("c_nationkey") == c("k"))
    one = lambda k, v: F.create_map(F.lit(k), F.array(v))
    addr = cu.select(F.concat(F.lit("customer:"), c("c_custkey").cast("string")).alias("id"), F.array(F.lit("Entity"), F.lit("Address")).alias("labels"), F.map_concat(one("name", c("c_name")), one("country", c("n_name"))).alias("props"))
    o = read(s, d, "orders").where("o_orderkey % 7 = 0")
    ev = o.select(F.concat(F.lit("evt:"), c("o_orderkey").cast("string")).alias("id"), F.array(F.lit("Entity"), F.lit("Event")).alias("labels"), F.map_concat(one("summary", c("o_orderstatus")), one("date", F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("props"))
    e = o.select(F.lit("ADDRESS_ENTITY").alias("type"), F.concat(F.lit("evt:"), c("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("customer:"), c("o_custkey").cast("string")).alias("dst"))
    p = o.where("o_orderkey % 2 = 0").select(F.lit("PROOF").alias("type"), F.concat(F.lit("evt:"), c("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("customer:"), c("o_custkey").cast("string")).alias("dst"))
    return addr.unionByName(ev), e.unionByName(p)


def _trained(s, d):
    from quillon.operators import matching as M
    from quillon.plans.quality_queries import _rows

    m, u = M.train_on(_rows(s, d))
    rows = [(f, i, float(x), float(y)) for f in m for i, (x, y) in enumerate(zip(m[f], u[f]))]
    return s.createDataFrame(rows, "field string, level int, m double, u double")


TOPICS = "properties['topics']"
RISKS = ", ".join(repr(x) for x in O.RISKS)
BENIGN = ", ".join(repr(x) for x in (*O.RISKS, *O.BENIGN_TOPICS))
OLD = ", ".join(repr(x) for x in O.OLD_RISKS)

QUERIES = {
    "parked_merges": (
        lambda s, d: W.list_parked(read(s, d, "merge_audit"), _nodes(s, d)).select("id", "canonical_id", "graph_written"),
        f"WITH {NODES} SELECT id, canonical_id, EXISTS (SELECT 1 FROM nodes WHERE nodes.id = canonical_id OR list_contains(source_ids, nodes.id)) AS graph_written FROM merge_audit WHERE lower(trim(decision)) = 'pending_review' AND canonical_id IS NOT NULL",
    ),
    "review_state": (lambda s, d: _decided(s, d).select("canonical_id", "wanted", "state"), f"WITH {STATE} SELECT canonical_id, wanted, state FROM state"),
    "approve_merge": (
        lambda s, d: W.judgements(_decided(s, d).where("wanted = 'merged'")),
        f"WITH {STATE}, m AS (SELECT DISTINCT canonical_id, unnest(s) AS m FROM state WHERE state = 'apply' AND wanted = 'merged') SELECT DISTINCT a.m AS left_id, b.m AS right_id, 'positive' AS judgement FROM m a JOIN m b ON a.canonical_id = b.canonical_id AND a.m < b.m",
    ),
    "reject_merge": (
        lambda s, d: W.judgements(_decided(s, d).where("wanted = 'rejected'")),
        f"WITH {STATE}, m AS (SELECT DISTINCT canonical_id, unnest(s) AS m FROM state WHERE state = 'apply' AND wanted = 'rejected') SELECT DISTINCT a.m AS left_id, b.m AS right_id, 'negative' AS judgement FROM m a JOIN m b ON a.canonical_id = b.canonical_id AND a.m < b.m",
    ),
    "settled_audit": (
        lambda s, d: W.settle_audit(read(s, d, "merge_audit"), _decided(s, d)).select("id", W.said("decision").alias("decision")),
        f"WITH {STATE} SELECT id, CASE WHEN state = 'apply' AND lower(trim(decision)) = 'pending_review' THEN wanted ELSE lower(trim(decision)) END AS decision FROM merge_audit LEFT JOIN state USING (canonical_id)",
    ),
    "settled_queue": (
        lambda s, d: W.settle_queue(read(s, d, "er_queue_item"), _decided(s, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {STATE}, m AS (SELECT DISTINCT unnest(s) AS m FROM state WHERE state = 'apply') SELECT CASE WHEN entity_id IN (SELECT m FROM m) AND status IN ('pending', 'pending_review') THEN 'resolved' ELSE status END AS status, count(*) AS n FROM er_queue_item GROUP BY 1",
    ),
    "sign_offs": (
        lambda s, d: W.signed(_decided(s, d), "ann").select("canonical_id", "decision", F.array_join("source_ids", ",").alias("members")),
        f"WITH {STATE} SELECT canonical_id, CASE wanted WHEN 'merged' THEN 'approved' ELSE 'rejected' END AS decision, array_to_string(list_sort(list_distinct(s)), ',') AS members FROM state WHERE state = 'apply'",
    ),
    "review_outcome": (
        lambda s, d: W.outcome(_decided(s, d), _queue_entities(s, d))["clusters"].groupBy("canonical_id").agg(F.count(F.lit(1)).alias("members"), F.max("score").alias("score")),
        f"""WITH {STATE}, l AS (SELECT canonical_id, arg_max(score, (created_at, id)) AS score FROM merge_audit WHERE score IS NOT NULL GROUP BY canonical_id), m AS (SELECT DISTINCT canonical_id AS g, wanted, unnest(s) AS m FROM state WHERE state = 'apply'),
        r AS (SELECT DISTINCT CASE WHEN wanted = 'merged' THEN g ELSE m END AS canonical_id, m, CASE WHEN wanted = 'merged' THEN l.score ELSE 1.0 END AS score FROM m JOIN l ON l.canonical_id = g) SELECT canonical_id, count(*) AS members, max(score) AS score FROM r GROUP BY 1""",
    ),
    "nonexemptible": (
        lambda s, d: W.nonexemptible(
            read(s, d, "merge_audit").select("canonical_id", F.explode("source_ids").alias("member_id"), "score").distinct(),
            read(s, d, "er_queue_item").where("entity_id is not null").select(c("entity_id").alias("id")).distinct().select("id", F.create_map(F.lit("topics"), F.when(c("id").endswith("7"), F.array(F.lit("mare.shadow"))).when(c("id").endswith("5"), F.array(F.lit("sanction")))).alias("props")),
            band=(0.90, 0.92)),
        """WITH m AS (SELECT DISTINCT canonical_id, unnest(source_ids) AS m, score FROM merge_audit), q AS (SELECT DISTINCT entity_id FROM er_queue_item WHERE entity_id LIKE '%7')
        SELECT canonical_id, bool_or(m IN (SELECT entity_id FROM q) OR coalesce(score >= 0.90 AND score < 0.92, false)) AS fenced FROM m GROUP BY canonical_id""",
    ),
    "newly_sensitive": (
        lambda s, d: read(s, d, "ftm_entity").select("id", O.newly_sensitive(c("properties")["topics"]).alias("fresh")),
        f"""SELECT id, coalesce(len(list_filter({TOPICS}, lambda t: t IN ({RISKS}) OR NOT t IN ({BENIGN}))) > 0, false) AND NOT coalesce(len(list_filter({TOPICS}, lambda t: t IN ({OLD}) OR t LIKE 'role.pep%' OR t LIKE 'sanction%')) > 0, false) AS fresh FROM ftm_entity""",
    ),
    "quarantined": (
        lambda s, d: W.quarantine(read(s, d, "er_queue_item"), read(s, d, "er_queue_item").where("entity_id is null").select("id", F.lit("no entity id").alias("reason")), "parse")[0].groupBy("status").agg(F.count(F.lit(1)).alias("n")),
        "WITH bad AS (SELECT DISTINCT id FROM er_queue_item WHERE entity_id IS NULL) SELECT CASE WHEN id IN (SELECT id FROM bad) THEN 'invalid' ELSE status END AS status, count(*) AS n FROM er_queue_item GROUP BY 1",
    ),
    "skipped_items": (
        lambda s, d: W.skipped(read(s, d, "er_queue_item"), read(s, d, "er_queue_item").where("entity_id is null").select("id", F.repeat(F.lit("x"), F.lit(3000)).alias("reason")), "score").select("source_record", "stage", F.length("error").cast("long").alias("n")),
        "SELECT source_record, 'score' AS stage, 2000 AS n FROM er_queue_item WHERE entity_id IS NULL",
    ),
    "merge_alerts": (
        lambda s, d: W.merge_alerts(read(s, d, "merge_audit").groupBy("canonical_id").agg(F.max("score").alias("score")).select("canonical_id", (c("score") < 0.9).alias("flagged"), F.lit("low score").alias("reason"))),
        "SELECT canonical_id, 'merge_alert' AS kind, 'low score' AS reason FROM merge_audit GROUP BY canonical_id HAVING max(score) < 0.9",
    ),
    "merge_rows": (
        lambda s, d: W.merge_rows(read(s, d, "merge_audit").select("canonical_id", F.explode("source_ids").alias("member_id"), "score"), "merged").select("canonical_id", F.array_join("source_ids", ",").alias("members"), "decision"),
        "SELECT canonical_id, string_agg(DISTINCT m, ',' ORDER BY m) AS members, 'merged' AS decision FROM (SELECT canonical_id, unnest(source_ids) AS m FROM merge_audit) GROUP BY canonical_id HAVING count(DISTINCT m) > 1",
    ),
    "minted_ids": (
        lambda s, d: table(W.mint(read(s, d, "customer").select("c_custkey")), "minted").agg(F.count_distinct("durable_id").alias("n"), F.count_if(c("durable_id").rlike("^wm-mint-[0-9a-f-]{36}$")).alias("shaped")),
        "SELECT count(*) AS n, count(*) AS shaped FROM customer",
    ),
    "ledger_row_ids": (
        lambda s, d: A.ledger(s, d).select("canonical_id", "canonical_alias", W.ledger_row_id(c("canonical_id"), c("canonical_alias")).alias("id")),
        f"""WITH l AS (SELECT 'customer:' || (c_custkey - 1) AS a, 'customer:' || c_custkey AS b FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT 'customer:' || c_custkey, 'customer:' || c_custkey FROM customer)
        SELECT a AS canonical_id, b AS canonical_alias, replace({_uuid5("a || chr(0) || b")}, '-', '') AS id FROM l""",
    ),
    "canonical_rows": (
        lambda s, d: W.canonical_rows(read(s, d, "merge_audit").where("canonical_id is not null").select("canonical_id", F.lit("").alias("anchor_kind"), F.lit("").alias("anchor_value")), A.ledger(s, d)).select("canonical_id", "canonical_alias"),
        "SELECT DISTINCT canonical_id, canonical_id AS canonical_alias FROM merge_audit WHERE canonical_id IS NOT NULL",
    ),
    "seed_instances": (
        lambda s, d: W.seed_rows(_seeds(s, d)).select("connector_id", "natural_key", "instance_id"),
        f"SELECT connector_id, natural_key, {_uuid5('connector_id || chr(58) || natural_key')} AS instance_id FROM seed_spec",
    ),
    "planted_seeds": (
        lambda s, d: W.plant(_seeds(s, d), W.seed_rows(_seeds(s, d).where("connector_id < 'm'"))).select("connector_id", "natural_key"),
        "SELECT DISTINCT connector_id, natural_key FROM seed_spec WHERE NOT connector_id < 'm'",
    ),
    "witness_properties": (
        lambda s, d: W.witness_property(C.fold(A.claims(s, d), C.alias_closure(C.alias_map(A.ledger(s, d))))).select("id", X.first_value(c("props"), "prov_witnesses").alias("w")),
        f"""WITH {A.SQL_CLAIMS}, f AS (SELECT {A.SQL_SURVIVOR.format('entity_id')} AS id, prop, '"' || prop || '":[' || string_agg(DISTINCT '"' || dataset || '"', ',') || ']' AS j FROM claims GROUP BY 1, 2)
        SELECT id, '{{' || string_agg(j, ',' ORDER BY prop) || '}}' AS w FROM f GROUP BY id""",
    ),
    "query_literals": (lambda s, d: read(s, d, "company").where("name is not null").select("id", W.escape_literal(c("name")).alias("n")), r"""SELECT id, replace(replace(name, '\', '\\'), '"', '\"') AS n FROM company WHERE name IS NOT NULL"""),
    "same_targets": (
        lambda s, d: read(s, d, "customer").select("c_custkey", W.same_target(
            F.when(c("c_custkey") % 2 == 0, "bolt://localhost:7687").otherwise("neo4j://user@127.0.0.1"), F.when(c("c_custkey") % 3 == 0, "bolt://[::1]").when(c("c_custkey") % 3 == 1, "bolt://graph:7687").otherwise("bolt://localhost:7688")).alias("same")),
        "SELECT c_custkey, c_custkey % 3 = 0 AS same FROM customer",
    ),
    "labelled_pairs": (
        lambda s, d: W.load_labelled(A.gold(s, d).where("right_id is not null"), ["uncertainty", "silver"]).select("left_id", "right_id", "label", "source"),
        "SELECT left_id, right_id, lower(trim(label)) AS label, source FROM er_gold_pair WHERE right_id IS NOT NULL AND source IN ('uncertainty', 'silver')",
    ),
    "survivors_complete": (
        lambda s, d: C.incomplete_survivors(C.alias_closure(C.alias_map(A.ledger(s, d))), A.claims(s, d).where(~c("entity_id").rlike("customer:\\d*[0-4]$"))).groupBy(F.substring("survivor", 1, 9).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
        "SELECT 'customer:' AS kind, count(DISTINCT c_custkey - c_custkey % 5) AS n FROM customer WHERE c_custkey % 5 <> 0 AND (c_custkey - c_custkey % 5) % 10 = 0",
    ),
    "context_claims": (
        lambda s, d: C.context_claims(_reg(s, d).select(c("id").alias("canonical_id"), c("id").alias("member_id")), _reg(s, d).withColumn("prov", F.struct(F.lit("crm").alias("source_id"), F.when(c("c_custkey") % 4 > 0, "2024").otherwise("").alias("retrieved_at")))).select("entity_id", "key", "value"),
        "SELECT DISTINCT 'customer:' || c_custkey AS entity_id, 'lei' AS key, unnest(['L' || c_custkey % 50, 'L1']) AS value FROM customer WHERE c_custkey % 4 > 0",
    ),
    "existence_claims": (
        lambda s, d: C.statements(_reg(s, d).select(c("id").alias("canonical_id"), c("id").alias("member_id")), _reg(s, d).withColumns({"schema": F.lit("Company"), "props": F.create_map().cast("map<string,array<string>>"), "prov": F.struct(F.lit("crm").alias("source_id"), F.lit("2024").alias("retrieved_at"), F.lit("B").alias("reliability"), F.lit("r").alias("source_record"))})).select("entity_id", "prop", "statement_id"),
        "SELECT 'customer:' || c_custkey AS entity_id, 'wm:exists' AS prop, sha256('customer:' || c_custkey || chr(0) || 'customer:' || c_custkey || chr(0) || 'wm:exists' || chr(0) || 'crm') AS statement_id FROM customer",
    ),
    "single_anchors": (
        lambda s, d: _reg(s, d).select("id", F.size(C.single_anchors(c("anchors"))).cast("long").alias("n"), F.array_join(C.set_anchor(c("anchors"), "wikidata_id", F.array(F.lit("Q1")))["wikidata_id"], ",").alias("put")),
        "SELECT 'customer:' || c_custkey AS id, CASE WHEN c_custkey % 50 = 1 THEN 1 ELSE 0 END AS n, 'Q1' AS put FROM customer",
    ),
    "identity_keys": (
        lambda s, d: V.identity_keys(_reg(s, d)).select("id", F.array_join(F.array_sort("keys"), ",").alias("keys")),
        "SELECT 'customer:' || c_custkey AS id, array_to_string(list_sort(['customer:' || c_custkey, 'L' || c_custkey % 50, 'Q' || c_custkey]), ',') AS keys FROM customer",
    ),
    "approved_groups": (
        lambda s, d: K.approved_groups(A.gold(s, d).withColumn("judgement", F.when(c("label") == "match", "positive").otherwise("negative"))),
        """WITH RECURSIVE p AS (SELECT left_id AS u, right_id AS v FROM er_gold_pair WHERE lower(trim(label)) = 'match' AND left_id <> right_id), b AS (SELECT u, v FROM p UNION SELECT v, u FROM p),
        reach(id, r) AS (SELECT DISTINCT u, u FROM b UNION SELECT reach.id, b.v FROM reach JOIN b ON b.u = reach.r) SELECT id, min(r) AS root FROM reach GROUP BY id""",
    ),
    "outbound_edges": (
        lambda s, d: C.outbound(read(s, d, "orders").select(F.concat(F.lit("own:"), c("o_orderkey").cast("string")).alias("entity_id"), F.lit("Ownership").alias("schema"), F.explode(F.map_from_arrays(F.array(F.lit("owner"), F.lit("date")), F.array(c("o_custkey").cast("string"), c("o_orderstatus")))).alias("prop", "value")), read(s, d, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("own:"), c("o_orderkey").cast("string")).alias("id"))),
        "SELECT 'own:' || o_orderkey AS entity_id, 'owner' AS prop, o_custkey::VARCHAR AS value FROM orders WHERE o_orderkey % 3 = 0",
    ),
    "member_rows": (
        lambda s, d: C.load_members(read(s, d, "merge_audit").groupBy("canonical_id").agg(F.min_by("source_ids", "id").alias("source_ids")), read(s, d, "er_queue_item").select("entity_id", "id")).select("pos", "entity_id", "id"),
        "WITH m AS (SELECT canonical_id, arg_min(source_ids, id) AS s FROM merge_audit GROUP BY canonical_id), p AS (SELECT unnest(s) AS entity_id, generate_subscripts(s, 1) - 1 AS pos FROM m) SELECT pos, entity_id, er_queue_item.id FROM p JOIN er_queue_item USING (entity_id)",
    ),
    "replay_dispositions": (
        lambda s, d: C.backfill(
            read(s, d, "er_queue_item"), read(s, d, "merge_audit").select(F.explode("source_ids").alias("entity_id")), s.createDataFrame([("bluesky:firehose",)], "source string"),
            read(s, d, "er_queue_item").select(c("id").alias("item"), F.get_json_object("raw_entity", "$.id").alias("entity_id"), F.get_json_object("raw_entity", "$.context.wm_prov_source_id").alias("source"), F.lit(False).alias("redacted"))).groupBy("disposition").agg(F.count(F.lit(1)).alias("n")),
        """WITH q AS (SELECT CASE WHEN json_valid(raw_entity) THEN json_extract_string(raw_entity, '$.id') END AS e, CASE WHEN json_valid(raw_entity) THEN json_extract_string(raw_entity, '$.context.wm_prov_source_id') END AS s FROM er_queue_item), m AS (SELECT DISTINCT unnest(source_ids) AS m FROM merge_audit)
        SELECT CASE WHEN s = 'bluesky:firehose' THEN 'erased' WHEN e IS NULL THEN 'unparseable' WHEN e IN (SELECT m FROM m) THEN 'present' ELSE 'kept' END AS disposition, count(*) AS n FROM q GROUP BY 1""",
    ),
    "erased_sources": (
        lambda s, d: C.erased_sources(read(s, d, "events").select(F.when(c("event_type") == "signup", "erase").otherwise("ingest").alias("kind"), F.when(c("event_id") % 2 == 0, "ok").otherwise("error").alias("status"), F.to_json(F.struct(F.concat(F.lit("s:"), (c("user_id") % 20).cast("string")).alias("source_id"))).alias("stats"))),
        "SELECT DISTINCT 's:' || user_id % 20 AS source FROM events WHERE event_type = 'signup' AND event_id % 2 = 0",
    ),
    "erase_sources": (
        lambda s, d: R.erase_sources(A.claims(s, d), s.createDataFrame([("crm",), ("erp",)], "source string")).groupBy("dataset").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {A.SQL_CLAIMS} SELECT dataset, count(*) AS n FROM claims WHERE dataset NOT IN ('crm', 'erp') GROUP BY dataset",
    ),
    "redacted_letters": (
        lambda s, d: R.redact_errors(read(s, d, "er_queue_item").select("id", "source_record", F.lit("broken").alias("error")), "s3://landing/a").select("id", "error"),
        "SELECT id, CASE WHEN starts_with(source_record, 's3://landing/a') THEN '' ELSE 'broken' END AS error FROM er_queue_item",
    ),
    "micro_batches": (
        lambda s, d: C.batches(read(s, d, "er_queue_item"), 100).select("id", "batch"),
        "SELECT id, (row_number() OVER (ORDER BY created_at, id) - 1) // 100 AS batch FROM er_queue_item WHERE status = 'pending'",
    ),
    "enqueued": (
        lambda s, d: _enqueued(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("ids"), F.count_if(F.get_json_object("raw_entity", "$.id") == c("entity_id")).alias("payloads")),
        "SELECT 'pending' AS status, count(*) AS n, count(*) AS ids, count(*) AS payloads FROM ftm_entity",
    ),
    "upserted_texts": (
        lambda s, d: _upserted(s, d).groupBy("attempts", (c("text") == "new").alias("fresh"), "last_error").agg(F.count(F.lit(1)).alias("n")),
        "SELECT 2 AS attempts, CASE WHEN entity_id < 'm' THEN text = 'new' ELSE true END AS fresh, CASE WHEN entity_id < 'm' THEN 'boom' ELSE '' END AS last_error, count(*) AS n FROM article_text GROUP BY ALL",
    ),
    "written_graph": (
        lambda s, d: _graph_merged(s, d),
        f"""WITH {A.SQL_NODES}, {A.SQL_EDGES} SELECT CASE WHEN label < 'Entity' THEN label || ',Entity' ELSE 'Entity,' || label END AS what, count(*) AS n, count(DISTINCT id) AS ids FROM nodes GROUP BY 1
        UNION ALL SELECT type, count(*), count(*) FROM edges GROUP BY 1""",
    ),
    "silver_written": (
        lambda s, d: S.silver(A.gold(s, d).where("right_id is not null").select("left_id", "right_id", "label", F.lit("silver").alias("source"), F.lit(None).cast("double").alias("clerical_score"))).groupBy("label", "source").agg(F.count(F.lit(1)).alias("n")),
        "SELECT lower(trim(label)) AS label, 'silver' AS source, count(*) AS n FROM er_gold_pair WHERE right_id IS NOT NULL GROUP BY 1",
    ),
    "call_attempts": (
        lambda s, d: S.attempt_rows(read(s, d, "seed_spec").select(c("instance_id").alias("call_id"), F.lit("m1").alias("model"), F.array(F.struct(F.lit("user").alias("role"), c("natural_key").alias("content"))).alias("messages"), F.array("connector_id").alias("entity_ids"))).select("call_id", "fingerprint", c("n_messages").cast("long").alias("n")),
        """SELECT instance_id AS call_id, sha256('[{"role":"user","content":"' || natural_key || '"}]') AS fingerprint, 1 AS n FROM seed_spec""",
    ),
    "valid_targets": (
        lambda s, d: read(s, d, "article_text").select("entity_id", X.valid_target(F.regexp_extract("url", "//([^/]*)", 1)).alias("host"), X.valid_entity_id(c("entity_id")).alias("own"), X.valid_target(F.concat(c("entity_id"), F.lit("\n"))).alias("line"), X.target_allowed(F.regexp_extract("url", "//([^/]*)", 1), ["*.example", "a.test"]).alias("allowed")),
        """SELECT entity_id, regexp_full_match(h, '[A-Za-z0-9.:-]+') AND length(h) <= 253 AND NOT starts_with(h, '-') AND NOT contains(h, '..') AS host, regexp_full_match(entity_id, '[A-Za-z0-9:._-]+') AS own, false AS line,
        ends_with(h, '.example') OR h = 'a.test' AS allowed FROM (SELECT entity_id, regexp_extract(url, '//([^/]*)', 1) AS h FROM article_text)""",
    ),
    "blocked_addresses": (
        lambda s, d: read(s, d, "customer").select("c_custkey", P.is_blocked_ip(F.concat_ws(".", F.when(c("c_custkey") % 4 == 0, "10").when(c("c_custkey") % 4 == 1, "93").when(c("c_custkey") % 4 == 2, "127").otherwise("nonsense"), (c("c_custkey") % 250).cast("string"), F.lit("1"), F.lit("2"))).alias("blocked")),
        "SELECT c_custkey, c_custkey % 4 <> 1 AS blocked FROM customer",
    ),
    "latest_stop": (
        lambda s, d: U.latest_stat(A.runs(s, d).withColumn("stats", F.to_json(F.struct(F.when(c("run_id") % 2 == 0, "timeout").otherwise("empty").alias("reason")))), "reason", ("timeout", "empty")),
        "SELECT arg_max(CASE WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'empty' END, ts) AS reason FROM events WHERE event_type = 'signup'",
    ),
    "recent_events": (
        lambda s, d: G.recent_events(*_real_places(s, d), 60).select("id", "date", "source_id"),
        "SELECT 'evt:' || o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 2 = 0 THEN 'customer:' || o_custkey END AS source_id FROM orders WHERE o_orderkey % 7 = 0 ORDER BY date DESC, id LIMIT 60",
    ),
    "geo_candidates": (
        lambda s, d: G.geo_candidates(*_real_places(s, d), 400).select("id", "name", "country", "schema"),
        """WITH o AS (SELECT * FROM orders WHERE o_orderkey % 7 = 0), p AS (SELECT c_custkey, c_name, lower(n_name) AS country FROM customer JOIN nation ON n_nationkey = c_nationkey)
        SELECT coalesce('evt:' || o_orderkey, 'customer:' || c_custkey) AS id, coalesce(o_orderstatus, c_name) AS name, country, CASE WHEN o_orderkey IS NULL THEN 'Address' ELSE 'Event' END AS schema FROM p LEFT JOIN o ON o_custkey = c_custkey ORDER BY id LIMIT 400""",
    ),
    "node_labels": (
        lambda s, d: G.build_nodes(A.entities(s, d)).select("id", F.array_join(F.array_sort("labels"), ",").alias("labels"), X.first_value(c("props"), "prov_source_id").alias("source")),
        """SELECT id, array_to_string(list_sort(list_distinct(list_concat(['Entity', schema_name], list_transform(coalesce(properties['topics'], []), lambda t: array_to_string(list_transform(string_split(t, '.'), lambda p: upper(p[1]) || lower(p[2:])), ''))))), ',') AS labels, datasets[1] AS source
        FROM ftm_entity WHERE datasets[1] <> ''""",
    ),
    "trained_model": (_trained, None),
}
