"""Queries of the sources: test tables written as files of each source's format, scanned and mapped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon import plugins
from quillon.functions import scalars as X
from quillon.operators import evaluation as V
from quillon.operators import mapping as M
from quillon.operators import upkeep as U
from quillon.plans import adapters as A
from quillon.runtime import read, shared_dir
from quillon.sources import files as S

c = F.col
AT = "2024-01-01T00:00:00Z"


def _put(lines: DataFrame) -> str:
    """Texts ``(value)`` as files below the shared folder, a line per row."""
    path = f"{shared_dir(lines.sparkSession)}/landed-{uuid.uuid4().hex[:8]}"
    lines.select("value").write.text(path)
    return path


def _documents(rows: DataFrame, wrap) -> str:
    """JSON objects ``(value)`` as whole documents of about fifty objects, a file each."""
    n = F.pmod(F.xxhash64("value"), F.lit(max(1, rows.count() // 50))).cast("int")  # of the test tables' size
    docs = rows.groupBy(n.alias("doc")).agg(wrap(F.array_join(F.collect_list("value"), ",")).alias("value"))
    path = f"{shared_dir(rows.sparkSession)}/landed-{uuid.uuid4().hex[:8]}"
    docs.write.partitionBy("doc").text(path)
    return path + "/*"


def _array(rows: DataFrame) -> str:
    return _documents(rows, lambda v: F.concat(F.lit("["), v, F.lit("]")))


def _p(name: str):
    return X.first_value(c("props"), name)


def _json(df: DataFrame, **fields) -> DataFrame:
    return df.select(F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))).alias("value"))


def _map(name: str, raw: DataFrame, source: str) -> DataFrame:
    return plugins.get("mapper", name)(raw, source)


def _scan(name: str, s, path: str) -> DataFrame:
    return plugins.get("connector", name)(s, path, AT)


def _bulk(s, d):
    e = read(s, d, "ftm_entity")
    path = _put(_json(e, id=c("id"), schema=c("schema_name"), properties=c("properties")).unionByName(s.createDataFrame([('{"id": "x"}',), ("",), ("[broken",)], "value string")))
    return _map("opensanctions", _scan("opensanctions", s, path), "os:main").select("id", "schema", F.size("props").cast("long").alias("n"), c("prov.source_record").alias("record"))


def _places(s, d):
    k = c("s_suppkey")
    rows = read(s, d, "supplier").select(F.concat_ws("\t", k.cast("string"), "s_name", "s_name", F.lit("x"), (k % 90).cast("string"), (k % 180).cast("string"), F.lit("P"), F.lit("PPL"), F.lit("FR")).alias("value"))
    path = _put(rows.unionByName(s.createDataFrame([("short\tline",)], "value string")))
    return _map("geonames", _scan("geonames", s, path), "geonames:all").select("id", _p("name").alias("name"), _p("latitude").alias("lat"), _p("country").alias("country"), F.get(c("anchors")["geonames_id"], F.lit(0)).alias("anchor"))


def _feed(s, d):
    t = read(s, d, "article_text")
    esc = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    item = F.concat(F.lit("<item><title>"), esc(c("source_id")), F.lit("</title><link>"), esc(c("url")), F.lit("</link><guid>"), c("entity_id"), F.lit("</guid><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item>"))
    path = _documents(t.select(item.alias("value")), lambda v: F.concat(F.lit("<rss><channel>"), v, F.lit("</channel></rss>")))
    return _map("feeds", S.feed_entries(s, path, AT, max_items=1 << 30), "feeds:w").select("id", "schema", _p("sourceUrl").alias("url"), _p("publishedAt").alias("published"))


def _companies(s, d):
    cols = ("name", "company_number", "jurisdiction_code", "registered_address_in_full")
    rows = _json(read(s, d, "company"), company=F.struct(*cols))
    path = _documents(rows, lambda v: F.concat(F.lit('{"results": {"companies": ['), v, F.lit('], "page": 1, "total_pages": 1}}')))
    return _map("opencorporates", _scan("opencorporates", s, path), "opencorporates:main").groupBy(_p("jurisdiction").alias("land")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


def _sets(s, d):
    k = c("s_suppkey")
    ref = F.array(F.struct(F.lit("mitre-attack").alias("source_name"), F.when(k % 2 == 0, F.concat(F.lit("G"), F.lpad(k.cast("string"), 4, "0"))).otherwise("none").alias("external_id")))
    rows = _json(read(s, d, "supplier"), id=F.concat(F.lit("is-"), k.cast("string")), type=F.when(k % 5 == 0, "tool").otherwise("intrusion-set"), name=c("s_name"), revoked=k % 7 == 0, aliases=F.array("s_name", F.lit("Other"), F.lit("Other")), external_references=ref)
    path = _documents(rows, lambda v: F.concat(F.lit('{"objects": ['), v, F.lit("]}")))
    return _map("mitre_attack", _scan("mitre_attack", s, path), "mitre:groups").select("id", F.array_join(c("props")["alias"], ",").alias("alias"), F.get(c("anchors")["mitre_gid"], F.lit(0)).alias("gid"))


def _blocklist(s, d):
    k = c("p_partkey")
    rows = _json(read(s, d, "part"), ip_address=F.concat(F.lit("10.0."), (k % 200).cast("string"), F.lit(".7")), port=k.cast("string"), malware=F.when(k % 3 == 0, "Unknown").otherwise(c("p_brand")), first_seen=F.lit("2024-01-01 00:00:00 UTC"), last_online=F.lit("2024-01-02"))
    return _map("feodo", _scan("feodo", s, _array(rows)), "feodo:block").select("id", _p("indicatorType").alias("kind"), _p("malwareFamily").alias("family"), _p("firstSeen").alias("first"))


def _of_arrays(rows: DataFrame) -> str:
    return _documents(rows.select(F.concat(F.lit('"'), F.md5("value"), F.lit('": ['), c("value"), F.lit("]")).alias("value")), lambda v: F.concat(F.lit("{"), v, F.lit("}")))


def _iocs(s, d):
    k = c("p_partkey")
    kind = F.when(k % 4 == 0, "ip:port").when(k % 4 == 1, "MD5_hash").when(k % 4 == 2, "sha256_hash").otherwise("domain")
    rows = _json(read(s, d, "part"), ioc_value=F.concat(F.lit("V"), k.cast("string")), ioc_type=kind, malware=F.lit("win.x"), malware_printable=F.when(k % 2 == 0, c("p_brand")), first_seen_utc=F.lit("2024-01-01 00:00:00"), last_seen_utc=F.lit(None).cast("string"))
    return _map("threatfox", _scan("threatfox", s, _of_arrays(rows)), "threatfox:r").select("id", _p("indicatorType").alias("kind"), _p("malwareFamily").alias("family"))


def _urls(s, d):
    rows = _json(read(s, d, "article_text").where("url is not null").select("url").distinct(), url=c("url"), dateadded=F.lit("2024-01-01 10:00:00 UTC"))
    return _map("urlhaus", _scan("urlhaus", s, _of_arrays(rows)), "urlhaus:r").select("id", _p("indicatorValue").alias("url"), _p("firstSeen").alias("first"))


def _certificates(s, d):
    k = c("p_partkey")
    reason = F.when(k % 3 == 0, F.concat("p_brand", F.lit(", x C&C"))).when(k % 3 == 1, "malware C&C").otherwise("Dridex malware distribution")
    lines = read(s, d, "part").select(F.concat_ws(",", F.lit("2024-01-01 00:00:00"), F.sha1(k.cast("string")), reason).alias("value"))
    path = _put(lines.unionByName(s.createDataFrame([("# note",), ("Listingdate,SHA1,Listingreason",), ("2024,short,x",)], "value string")))
    return _map("sslbl", _scan("sslbl", s, path), "sslbl:c").select("id", _p("malwareFamily").alias("family"))


def _groups(s, d):
    k = c("s_suppkey")
    text = F.when(k % 3 == 0, " [AI generated] N/A").when(k % 3 == 1, "").otherwise("A group")
    rows = _json(read(s, d, "supplier"), name=c("s_name"), altname=F.lit("Alt"), description=text, url=F.concat(F.lit("http://x/g/"), k.cast("string")), locations=F.array(F.struct(F.lit("a.onion").alias("slug")), F.struct(F.lit("a.onion").alias("slug"))))
    return _map("ransomware_groups", _scan("ransomware_groups", s, _array(rows)), "rw:groups").select("id", _p("description").alias("text"), F.size(c("props")["website"]).cast("long").alias("sites"))


def _posts(s, d):
    doc = read(s, d, "documents")
    k = c("doc_id")
    commit = F.struct(k.cast("string").alias("rkey"), F.lit("app.bsky.feed.post").alias("collection"), F.when(k % 10 == 0, "delete").otherwise("create").alias("operation"), F.struct(c("text"), F.lit("2024").alias("createdAt")).alias("record"))
    rows = _json(doc, did=F.concat(F.lit("did:"), k.cast("string")), time_us=k, kind=F.when(k % 7 == 0, "identity").otherwise("commit"), commit=commit)
    raw = rows.select(F.sha1("value").alias("key"), "value", F.lit(AT).alias("retrieved_at"))
    return M.posts(raw, "bluesky:firehose").select("id", F.length(_p("title")).cast("long").alias("n"))


def _tools(s, d):
    k = c("s_suppkey")
    sup = read(s, d, "supplier").select(F.concat(F.lit("h"), k.cast("string")).alias("key"), F.lit(AT).alias("retrieved_at"), k.alias("k"), "s_name")
    ip = F.concat(F.lit("10.1.0."), (c("k") % 200).cast("string"))
    digs = M.dig(sup.withColumn("value", F.concat(F.lit("cname.example.\n"), ip, F.lit("\n"), ip, F.lit("\n;; note"))), "dig:x")
    maps = M.nmap(sup.withColumn("value", F.concat(F.lit('<host><address addr="'), ip, F.lit('" addrtype="ipv4"/></host>'))), "nmap:x")
    who = M.whois(sup.withColumn("value", F.concat(F.lit("Domain Name: A.EXAMPLE\nRegistrant Organization: "), F.when(c("k") % 2 == 0, c("s_name")).otherwise(" "), F.lit("\nRegistrant Country: FR\n"))), "whois:x")
    out = lambda df, t, p: df.select(F.lit(t).alias("tool"), "id", _p(p).alias("value"), F.size(c("props")[p]).cast("long").alias("n"))
    return out(digs, "dig", "ipAddress").unionByName(out(maps, "nmap", "ipAddress")).unionByName(out(who, "whois", "country"))


def _enriched(s, d):
    k = c("c_custkey")
    q = F.when(k % 3 == 0, F.array(F.concat(F.lit("http://www.wikidata.org/entity/Q"), k.cast("string"))))
    props = F.map_filter(F.create_map(F.lit("name"), F.array("c_name"), F.lit("wikidataId"), q), lambda k, v: v.isNotNull())
    e = read(s, d, "customer").select(k.cast("string").alias("id"), props.alias("props"), F.create_map().cast("map<string,array<string>>").alias("anchors"))
    labels = read(s, d, "customer").where(k % 2 == 0).select(F.upper("c_name").alias("label"), F.concat(F.lit("Q9"), k.cast("string")).alias("item"))
    return M.enrich_wikidata(e, labels).select("id", F.get(c("anchors")["wikidata_id"], F.lit(0)).alias("qid"))


def _answers(s, d):
    """Customers as articles with a model's answer: every fifth is no event, some broken."""
    nat = read(s, d, "nation").select(c("n_nationkey").alias("nk"), "n_name")
    cu = read(s, d, "customer").join(nat, c("c_nationkey") == c("nk"))
    k = c("c_custkey")
    actors = F.array(F.struct(c("c_name").alias("name"), F.when(k % 2 == 0, "person").otherwise("company").alias("kind")), F.struct(F.lit(" ").alias("name"), F.lit("x").alias("kind")))
    body = F.to_json(F.struct((k % 5 > 0).alias("is_event"), F.lit("strike").alias("event_type"), F.lit("s").alias("summary"), F.when(k % 3 == 0, "2024-02-03").otherwise("soon").alias("date"), F.lit("Nowhere").alias("country"), c("n_name").alias("place"), actors.alias("actors")))
    content = F.when(k % 11 == 0, F.lit("no json")).otherwise(F.concat(F.lit("Sure: "), body, F.lit(" done")))
    return cu.select(k.cast("string").alias("key"), F.concat(F.lit("doc:"), k.cast("string")).alias("id"), content.alias("content"), F.lit(AT).alias("retrieved_at"))


def _derived(s, d):
    cities = read(s, d, "nation").where("n_nationkey % 2 = 0").select(F.lower("n_name").alias("city"), c("n_nationkey").cast("double").alias("lat"), F.lit(1.0).alias("lon"))
    return M.derive(_answers(s, d), cities, s.createDataFrame([("fr",)], "country string"), "extraction:m").select("schema", "id", _p("date").alias("date"), _p("latitude").alias("lat"))


EVENTS = "e AS (SELECT c_custkey AS k, c_name, n_name, n_nationkey, 'doc:' || c_custkey AS doc FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 5 > 0 AND c_custkey % 11 <> 0)"


def _febrl(s, d):
    k = c("c_custkey")
    name = F.concat(F.lit("rec-"), (k % 501).cast("string"), F.when(k % 2 == 0, "-org").otherwise("-dup-0"))
    rows = read(s, d, "customer").select(name.alias("rec_id"), c("c_name").alias("given_name"), F.lit(" ").alias("surname"), F.lit("Main St").alias("address_1"), F.lit("19900101").alias("date_of_birth"))
    path = f"{shared_dir(s)}/landed-{uuid.uuid4().hex[:8]}"
    rows.write.option("header", "true").csv(path)
    return S.febrl(s, path)


QUERIES = {
    "map_bulk": (_bulk, "SELECT id, schema_name AS schema, cardinality(properties)::BIGINT AS n, 's3://landing/os/main/' || id AS record FROM ftm_entity WHERE id <> '' AND schema_name <> ''"),
    "map_places": (_places, "SELECT 'geonames-' || s_suppkey AS id, s_name AS name, (s_suppkey % 90)::VARCHAR AS lat, 'fr' AS country, s_suppkey::VARCHAR AS anchor FROM supplier"),
    "map_feed": (_feed, "SELECT 'feed-' || sha1(entity_id) AS id, 'Article' AS schema, url, '2024-01-01T10:00:00Z' AS published FROM article_text"),
    "map_company_pages": (
        _companies,
        "SELECT CASE WHEN trim(jurisdiction_code) <> '' THEN jurisdiction_code END AS land, count(*) AS n, count(DISTINCT concat_ws('-', jurisdiction_code, company_number)) AS ids FROM company WHERE name <> '' AND company_number <> '' GROUP BY 1",
    ),
    "map_intrusion_sets": (
        _sets,
        """SELECT 'mitre-' || CASE WHEN s_suppkey % 2 = 0 THEN 'G' || lpad(s_suppkey::VARCHAR, 4, '0') ELSE 'is-' || s_suppkey END AS id, 'Other' AS alias, CASE WHEN s_suppkey % 2 = 0 THEN 'G' || lpad(s_suppkey::VARCHAR, 4, '0') END AS gid
        FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey % 7 > 0""",
    ),
    "map_blocklist": (
        _blocklist,
        "SELECT 'ioc-' || sha1('10.0.' || p_partkey % 200 || '.7:' || p_partkey) AS id, 'ipv4' AS kind, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS family, '2024-01-01 00:00:00' AS first FROM part",
    ),
    "map_iocs": (
        _iocs,
        "SELECT 'ioc-' || sha1('v' || p_partkey) AS id, ['ipv4', 'md5', 'sha256', 'domain'][p_partkey % 4 + 1] AS kind, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'win.x' END AS family FROM part",
    ),
    "map_urls": (_urls, "SELECT DISTINCT 'ioc-' || sha1(lower(trim(url))) AS id, url, '2024-01-01 10:00:00' AS first FROM article_text WHERE trim(url) <> ''"),
    "map_certificates": (_certificates, "SELECT 'ioc-' || sha1(sha1(p_partkey::VARCHAR)) AS id, CASE p_partkey % 3 WHEN 0 THEN p_brand || ', x' WHEN 2 THEN 'Dridex' END AS family FROM part"),
    "map_groups": (_groups, "SELECT 'ransomware-group-' || regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS id, CASE WHEN s_suppkey % 3 = 2 THEN 'A group' END AS text, 1 AS sites FROM supplier"),
    "map_posts": (
        _posts, "SELECT 'bsky-' || sha1('did:' || doc_id || '/' || doc_id) AS id, length(text[1:80]) AS n FROM documents WHERE doc_id % 10 > 0 AND doc_id % 7 > 0 AND text <> '' AND trim(text[1:80]) <> ''"
        " UNION ALL SELECT 'bsky-' || sha1('did:' || doc_id || '/' || doc_id), NULL FROM documents WHERE doc_id % 10 > 0 AND doc_id % 7 > 0 AND text <> '' AND trim(text[1:80]) = ''",
    ),
    "map_tools": (
        _tools,
        """SELECT 'dig' AS tool, 'dig-' || sha1('h' || s_suppkey) AS id, '10.1.0.' || s_suppkey % 200 AS value, 1 AS n FROM supplier UNION ALL SELECT 'nmap', 'nmap-' || sha1('h' || s_suppkey), '10.1.0.' || s_suppkey % 200, 1 FROM supplier
        UNION ALL SELECT 'whois', 'whois-' || sha1(lower(s_name)), 'fr', 1 FROM supplier WHERE s_suppkey % 2 = 0""",
    ),
    "enriched_anchors": (_enriched, "SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 3 = 0 THEN 'Q' || c_custkey WHEN c_custkey % 2 = 0 THEN 'Q9' || c_custkey END AS qid FROM customer"),
    "derived_events": (
        _derived,
        f"""WITH {EVENTS} SELECT 'Event' AS schema, 'evt-' || sha1(doc) AS id, CASE WHEN k % 3 = 0 THEN '2024-02-03' ELSE '{AT}' END AS date, NULL AS lat FROM e
        UNION ALL SELECT CASE WHEN k % 2 = 0 THEN 'Person' ELSE 'Company' END, CASE WHEN k % 2 = 0 THEN 'per-' ELSE 'com-' END || sha1(doc || ':' || lower(c_name)), NULL, NULL FROM e
        UNION ALL SELECT 'Address', 'addr-' || sha1(doc || ':' || lower(n_name)), NULL, n_nationkey || '.0' FROM e WHERE n_nationkey % 2 = 0""",
    ),
    "prompt_texts": (
        lambda s, d: M.prompts(read(s, d, "article_text").select(c("entity_id").alias("id"), c("source_id").alias("title"), F.lit(" ").alias("summary"), c("url").alias("body"))),
        "SELECT entity_id AS id, concat_ws(chr(10), CASE WHEN trim(source_id) <> '' THEN 'Title: ' || source_id END, CASE WHEN trim(url) <> '' THEN 'Body: ' || url END) AS prompt FROM article_text",
    ),
    "benchmark_pairs": (
        lambda s, d: V.labelled_pairs(_json(A.gold(s, d).where("right_id is not null"), left=F.struct(c("left_id").alias("id")), right=F.struct(c("right_id").alias("id")), judgement=F.when(c("label") == "match", "positive").when(c("clerical_score") > 0.5, "unsure").otherwise("negative")))
        .groupBy("label").agg(F.count(F.lit(1)).alias("n")),
        "SELECT CASE WHEN lower(trim(label)) = 'match' THEN 'match' ELSE 'non_match' END AS label, count(*) AS n FROM er_gold_pair WHERE right_id IS NOT NULL AND left_id IS NOT NULL AND (lower(trim(label)) = 'match' OR NOT coalesce(clerical_score > 0.5, false)) GROUP BY 1",
    ),
    "headed_records": (_febrl, "SELECT 'rec-' || c_custkey % 501 || CASE WHEN c_custkey % 2 = 0 THEN '-org' ELSE '-dup-0' END AS id, c_name AS name, '19900101' AS birth_date, 'Main St' AS address FROM customer"),
    "record_matches": (
        lambda s, d: S.febrl_pairs(_febrl(s, d).select("id").distinct(), 0).where("label = 'match'").select("left_id", "right_id"),
        "SELECT DISTINCT 'rec-' || c_custkey % 501 || '-dup-0' AS left_id, 'rec-' || c_custkey % 501 || '-org' AS right_id FROM customer WHERE c_custkey % 501 IN (SELECT c_custkey % 501 FROM customer WHERE c_custkey % 2 = 0) AND c_custkey % 501 IN (SELECT c_custkey % 501 FROM customer WHERE c_custkey % 2 = 1)",
    ),
    "stored_objects": (
        lambda s, d: S.objects(s, _put(read(s, d, "supplier").select(c("s_name").alias("value")).coalesce(1))).where(c("uri").contains("part-")).select((c("length") > 0).alias("filled")),
        "SELECT true AS filled",
    ),
    "feed_backlog": (
        lambda s, d: U.extraction_candidates(read(s, d, "article_text").select(c("entity_id").alias("id"), c("created_at").alias("at"), (F.length("text") > 0).alias("processed"), c("url").alias("title"), c("raw_pointer").alias("source_record")), 60).select("id"),
        "WITH n AS (SELECT entity_id AS id, url, raw_pointer FROM article_text WHERE NOT coalesce(length(text) > 0, false) ORDER BY created_at DESC NULLS FIRST, entity_id LIMIT 60) SELECT id FROM n WHERE url IS NOT NULL AND raw_pointer IS NOT NULL",
    ),
}
