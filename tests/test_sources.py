import json

import pytest
from pyspark.sql import functions as F

from quillon.operators import mapping as M
from quillon.operators import sinks as W
from quillon.sources import files as S
from quillon.streaming import cursor as T

AT = "2024-01-01T00:00:00Z"


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(p)


def rows(df):
    return {r.id: r for r in df.collect()}


def test_lines_places_and_certificates(spark, tmp_path):
    p = put(tmp_path, "e.json", '{"id": "a", "schema": "Person", "properties": {"name": ["A"]}}\n\n{"schema": "Person"}\n')
    raw = S.entity_lines(spark, p, AT)
    assert raw.count() == 2 and [r.id for r in M.bulk(raw, "os:l").collect()] == ["a"]
    line = "\t".join(["1", "Andorra", "x", "", "42.5", "1.5", "P", "PPL", "AD"] + [""] * 10)
    got = rows(M.places(S.places(spark, put(tmp_path, "p.txt", line + "\nshort\tx\n"), AT), "geonames:p"))
    assert got["geonames-1"].props["country"] == ["ad"] and got["geonames-1"].anchors == {"geonames_id": ["1"]}
    c = S.certificate_lines(spark, put(tmp_path, "c.csv", "# note\nListingdate,SHA1,Listingreason\n2024-01-01,%s,Dridex C&C\n2024-01-01,%s,a, b malware distribution\nbad,row\n" % ("a" * 40, "b" * 40)), AT)
    got = sorted(r.props.get("malwareFamily", [""])[0] for r in M.certificates(c, "sslbl:c").collect())
    assert got == ["Dridex", "a, b"]


def test_feeds(spark, tmp_path):
    rss = "<rss><channel><item><title>T1</title><link>http://x/1</link><guid>g1</guid><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item><item><title> </title><link></link></item></channel></rss>"
    got = rows(M.feed(S.feed_entries(spark, put(tmp_path, "f.xml", rss), AT), "feeds:w"))
    assert len(got) == 1 and next(iter(got.values())).props["publishedAt"] == ["2024-01-01T10:00:00Z"]
    atom = '<feed><entry><id>i</id><title>A</title><link href="http://y"/><updated>2024-02-01T00:00:00+02:00</updated></entry></feed>'
    got = rows(M.feed(S.feed_entries(spark, put(tmp_path, "a.xml", atom), AT), "feeds:w"))
    assert next(iter(got.values())).props["publishedAt"] == ["2024-01-31T22:00:00Z"]


def test_json_documents(spark, tmp_path):
    page = {"results": {"companies": [{"company": {"name": "N", "company_number": "1", "jurisdiction_code": "gb"}}, {"company": {"name": "", "company_number": "2"}}], "page": 1, "total_pages": 9}}
    got = rows(M.companies(S.company_pages(spark, put(tmp_path, "c.json", page), AT), "oc:m"))
    assert list(got) == ["opencorporates-gb-1"] and S.company_pages(spark, put(tmp_path, "bad.json", "[1"), AT).count() == 0
    bundle = {"objects": [{"id": "i1", "type": "intrusion-set", "name": "N", "aliases": ["N", "M", "M"], "external_references": [{"source_name": "mitre-attack", "external_id": "G0001"}]}, {"id": "i2", "type": "intrusion-set", "revoked": True}, {"id": "t", "type": "tool"}]}
    got = rows(M.intrusion_sets(S.intrusion_sets(spark, put(tmp_path, "m.json", bundle), AT), "mitre:g"))
    assert got["mitre-G0001"].props["alias"] == ["M"] and len(got) == 1
    iocs = {"7": [{"ioc_value": "1.2.3.4:80", "ioc_type": "IP:port ", "malware": "Unknown"}, {"ioc_value": "", "ioc_type": "url"}]}
    got = list(rows(M.indicators(S.ioc_records(spark, put(tmp_path, "i.json", iocs), AT), "tf:r")).values())
    assert len(got) == 1 and got[0].props["indicatorType"] == ["ipv4"] and "malwareFamily" not in got[0].props
    urls = {"9": [{"url": "http://e/x", "dateadded": "2024-01-01 10:00:00 UTC"}]}
    assert list(rows(M.urls(S.url_records(spark, put(tmp_path, "u.json", urls), AT), "uh:r")).values())[0].props["firstSeen"] == ["2024-01-01 10:00:00"]
    block = [{"ip_address": "9.9.9.9", "port": 443, "malware": "X"}, "junk"]
    assert S.blocklist(spark, put(tmp_path, "b.json", block), AT).first().key == "9.9.9.9:443"


def test_one_victim_gives_three_rows(spark, tmp_path):
    v = S.victims(spark, put(tmp_path, "v.json", [{"victim": "V", "group": "Lock Bit", "url": "http://c/1", "description": "N/A"}]), AT)
    got = M.ransomware(v, "rw:r").collect()
    assert sorted(r.schema for r in got) == ["Company", "Organization", "UnknownLink"]
    link = next(r for r in got if r.schema == "UnknownLink")
    assert link.props["subject"] == ["ransomware-group-lockbit"] and link.props["object"][0].startswith("victim-")
    g = S.groups(spark, put(tmp_path, "g.json", [{"name": "???", "locations": [{"slug": "http://o"}, {}]}]), AT)
    one = M.ransomware(g, "rw:g").first()
    assert one.id.startswith("ransomware-group---") and one.props["website"] == ["http://o"]


def test_tools(spark, tmp_path):
    raw = spark.createDataFrame([("d", "1.1.1.1\nns1\n1.1.1.1\n"), ("e", "none")], "key string, value string").withColumn("retrieved_at", F.lit(AT))
    assert [r.props["ipAddress"] for r in M.dig(raw, "dig:x").collect()] == [["1.1.1.1"]]
    raw = spark.createDataFrame([("w", "Domain Name: A.COM\nregistrant organization: Acme\nRegistrant Country: FR")], "key string, value string").withColumn("retrieved_at", F.lit(AT))
    assert M.whois(raw, "w:x").first().props == {"name": ["Acme"], "country": ["fr"], "website": ["a.com"]}
    raw = spark.createDataFrame([("n", '<address addr="10.0.0.1" addrtype="ipv4"/>')], "key string, value string").withColumn("retrieved_at", F.lit(AT))
    assert M.nmap(raw, "n:x").first().props["ipAddress"] == ["10.0.0.1"]


def test_extraction(spark):
    say = 'Sure: {"is_event": true, "event_type": "strike", "summary": "S", "date": "soon", "country": "FR", "place": "Paris", "actors": [{"name": " "}, {"name": "P", "kind": "person"}, {"name": "a"}, {"name": "b"}, {"name": "c"}, {"name": "late"}]} ok'
    a = spark.createDataFrame([("k", "art", say, AT), ("k2", "art2", '{"is_event": false}', AT), ("k3", "art3", "no", AT)], "key string, id string, content string, retrieved_at string")
    cities = spark.createDataFrame([("paris", 48.8, 2.3)], "city string, lat double, lon double")
    got = M.derive(a, cities, spark.createDataFrame([("fr",)], "country string"), "x:y").collect()
    assert sorted(r.schema for r in got) == ["Address", "Event", "Organization", "Organization", "Organization", "Person"]  # five are cut before the blank one goes
    event = next(r for r in got if r.schema == "Event")
    assert event.props["date"] == [AT] and len(event.props["involved"]) == 4


def test_queue_and_upsert(spark, tmp_path):
    e = M.bulk(spark.createDataFrame([("k", '{"id": "a", "schema": "Person", "properties": {}}', AT)], "key string, value string, retrieved_at string"), "s:a")
    q = str(tmp_path / "q")
    W.enqueue(e, q, "s")
    W.enqueue(e.unionByName(e), q, "s")
    assert spark.read.parquet(q).count() == 1
    t = str(tmp_path / "t")
    new = lambda text, err: spark.createDataFrame([("a", "u", text, "p", err)], "entity_id string, url string, text string, raw_pointer string, last_error string")
    W.upsert_text(new("one", None), t)
    W.upsert_text(new("", "boom"), t)
    r = W.read_or_none(spark, t).first()
    assert (r.text, r.attempts, r.last_error) == ("one", 2, "boom")
    # a version that a crash has left unfinished is not read, and the next one follows the last whole one
    spark.createDataFrame([("broken",)], "entity_id string").write.parquet(f"{t}/v-000000000009-x")
    (tmp_path / "t" / "v-000000000009-x" / "_SUCCESS").unlink()
    assert W.read_or_none(spark, t).first().attempts == 2
    W.upsert_text(new("two", None), t)
    assert (W.read_or_none(spark, t).first().text, W.read_or_none(spark, t).count()) == ("two", 1)


def test_delete_prefix(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "root" / "feeds" / "a"))
    assert W.delete_prefix(spark, str(tmp_path / "root"), "feeds/a/") > 0 and W.delete_prefix(spark, str(tmp_path / "root"), "feeds/a/") == 0
    for bad in ("feeds", "feeds/", "a/../b"):
        with pytest.raises(ValueError):
            W.delete_prefix(spark, str(tmp_path / "root"), bad)


def test_backup(spark, tmp_path):
    b = str(tmp_path / "b")
    assert W.backup({"t": spark.range(5).toDF("x")}, b) == {"t": 5}
    assert W.restore(spark, b)["t"].count() == 5
    spark.range(1).toDF("x").write.mode("append").parquet(f"{b}/t")
    with pytest.raises(ValueError):
        W.restore(spark, b)


def test_stream_resumes_and_repeats_nothing(spark, tmp_path):
    event = lambda i: json.dumps({"did": "d", "time_us": i, "kind": "commit", "commit": {"rkey": str(i), "collection": "app.bsky.feed.post", "operation": "create", "record": {"text": f"t{i}", "createdAt": AT}}})
    log = put(tmp_path, "log.json", "\n".join([event(1), "junk", event(2)]) + "\n")
    q, ck = str(tmp_path / "q"), str(tmp_path / "ck")

    def mapping(df):
        return M.posts(df.select(F.col("cursor").cast("string").alias("key"), "value", F.lit(AT).alias("retrieved_at")), "bluesky:f")

    T.enqueue_stream(T.events(spark, log, 1), mapping, q, ck, "bluesky").awaitTermination()
    n = spark.read.parquet(q).count()
    with open(log, "a") as f:
        f.write(event(3) + "\n")
    for _ in range(4):
        T.enqueue_stream(T.events(spark, log, 1), mapping, q, ck, "bluesky").awaitTermination()
    assert n >= 1 and spark.read.parquet(q).count() == 3


def test_stream_loses_no_equal_or_late_events(tmp_path):
    lines = [json.dumps({"time_us": t, "n": i}) for i, t in enumerate([5, 5, 5, 3, 6, 6])]
    log = put(tmp_path, "log.json", "\n".join(lines) + "\n" + '{"time_us": 7, "n"')
    r = T._Reader({"path": log, "max_events": "2"})
    at, got = r.initialOffset(), []
    for _ in range(5):
        rows, end = r.read(at)
        rows = list(rows)
        assert rows == list(r.readBetweenOffsets(at, end))
        got += [json.loads(v)["n"] for _, v in rows]
        at = end
    assert got == [0, 1, 2, 3, 4, 5] and at["cursor"] == 6
    with open(log, "a") as f:
        f.write(": 6}\n")
    assert [json.loads(v)["n"] for _, v in r.read(at)[0]] == [6]


def test_projection(spark, tmp_path):
    from tests.test_claims import LOG
    from quillon.schema import CLAIM

    log, target, state = (str(tmp_path / x) for x in ("log", "t", "s"))
    ledger = spark.createDataFrame([("a", "b", "2024")], "canonical_id string, canonical_alias string, created_at string")
    spark.createDataFrame(LOG[:2], CLAIM).write.parquet(log)
    assert T.project(spark, log, ledger, target, state) == 2 and T.project(spark, log, ledger, target, state) == 0
    spark.createDataFrame(LOG[2:], CLAIM).write.mode("append").parquet(log)
    assert T.project(spark, log, ledger, target, state) == 4
    step = {r.id: r.props for r in W.read_or_none(spark, target).collect()}
    T.project(spark, log, ledger, target, state, full=True)
    assert step == {r.id: r.props for r in W.read_or_none(spark, target).collect()}
