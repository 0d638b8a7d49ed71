import json

import pytest
from pyspark.sql import functions as F

from quillon import plugins
from quillon.engine import Engine
from quillon.operators import claims as C
from quillon.plans import pipeline as P

AT = "2024-01-01T00:00:00Z"


def test_ingest_and_resolve(spark, tmp_path):
    line = lambda i, schema, **p: json.dumps({"id": i, "schema": schema, "properties": p})
    f = tmp_path / "e.json"
    f.write_text("\n".join([
        line("a", "Company", name=["Legion Komplekt LLC"], country=["ru"], registrationNumber=["77"]), line("b", "Company", name=["OOO Legion Komplekt"], country=["ru"]),
        line("o", "Ownership", owner=["c"], asset=["b"]), line("c", "Person", name=["Ann"]), line("s1", "Person", name=["Same Name"], country=["fr"], topics=["sanction"]),
        line("s2", "Person", name=["Name Same"], country=["fr"]), line("x", "Unheard", name=["?"]), "{broken",
    ]))
    root = str(tmp_path / "r")
    assert P.ingest(spark, "opensanctions", str(f), "opensanctions:l", root, AT) == (6, 1)
    queue = spark.read.parquet(f"{root}/queue").withColumn("id", F.col("entity_id")).withColumn("created_at", F.lit(AT))
    got = P.resolve(P.queue_entities(queue))
    members = {}
    for r in got["clusters"].collect():
        members.setdefault(r.canonical_id, set()).add(r.member_id)
    assert members["wm-anchor-regno-77"] == {"a", "b"}  # a merge takes the id of its anchor
    assert [r.reason for r in got["parked"].collect()] == ["sensitive member s1"] and not any("s1" in m for m in members.values())
    assert [(r.src, r.dst) for r in got["edges"].collect()] == [("c", "wm-anchor-regno-77")]
    assert [sorted(r.member_ids) for r in got["decisions"].collect()] == [["a", "b"]]
    e = Engine(got["nodes"], got["edges"])
    assert e.entity("wm-anchor-regno-77").count() == 1 and e.search("legion").count() == 1 and e.stats().first().nodes == 2
    assert P.queue_entities(queue.limit(0)).count() == 0


def test_batches_and_running_sums(spark):
    q = spark.range(25).select(F.concat(F.lit("q"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("id"), F.lit("pending").alias("status"), (100 - F.col("id")).alias("created_at"))
    got = {r.id: r.batch for r in C.batches(q, 10).collect()}
    assert got["q24"] == 0 and got["q15"] == 0 and got["q14"] == 1 and got["q00"] == 2


def test_members_keep_their_order(spark):
    q = spark.createDataFrame([("a", 1), ("b", 2)], "entity_id string, n int")
    ids = spark.createDataFrame([(["b", "gone", "a"],)], "source_ids array<string>")
    assert [r.entity_id for r in C.load_members(ids, q).collect()] == ["b", "a"]


def test_plugins():
    assert {"feeds", "opencorporates", "whois"} <= set(plugins.names("connector"))
    with pytest.raises(ValueError):
        plugins.register("connector", "feeds")(len)
    with pytest.raises(ValueError):
        plugins.register("nothing", "x")
