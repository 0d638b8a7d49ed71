from pyspark.sql import functions as F

from quillon import ontology as O
from quillon.operators import review as W

AUDIT = "id string, canonical_id string, source_ids array<string>, score double, decision string, created_at string"


def test_decisions(spark):
    audit = spark.createDataFrame(
        [("1", "A", ["a", "b"], 0.9, "pending_review", "1"), ("2", "B", ["c", "d"], 0.9, " Merged", "1"), ("3", "C", ["e", "f", "e"], 0.9, "pending_review", "1"), ("4", "D", ["g", "h"], 0.9, "rejected", "2"), ("5", "D", ["g"], 0.9, "pending_review", "1"), ("6", None, ["x"], None, None, None)], AUDIT,
    )
    nodes = spark.createDataFrame([("e",), ("A",)], "id string")
    asked = spark.createDataFrame([("A", W.MERGED), ("B", W.MERGED), ("C", W.MERGED), ("D", W.MERGED), ("Z", W.MERGED)], "canonical_id string, wanted string")
    d = W.decide(audit, nodes, asked)
    assert {r.canonical_id: r.state for r in d.collect()} == {"A": "apply", "B": "already", "C": "rejection was begun", "D": "was rejected", "Z": "no merge"}
    assert [tuple(r) for r in W.judgements(d).collect()] == [("a", "b", "positive")]
    back = W.decide(audit, nodes, asked.withColumn("wanted", F.lit(W.REJECTED)))
    assert {r.canonical_id: r.state for r in back.collect()} == {"A": "approval was begun", "B": "was merged", "C": "apply", "D": "already", "Z": "no merge"}
    assert [tuple(r) for r in W.judgements(back).collect()] == [("e", "f", "negative")]
    settled = W.settle_audit(audit, d)
    assert {r.id: r.decision for r in settled.collect()}["1"] == W.MERGED
    assert {r.state for r in W.decide(settled, nodes, asked.where("canonical_id = 'A'")).collect()} == {"already"}  # a repeated request changes nothing
    assert {r.canonical_id: r.graph_written for r in W.list_parked(audit, nodes).collect()} == {"A": True, "C": True, "D": False}
    queue = spark.createDataFrame([("q1", "a", "pending_review"), ("q2", "e", "pending"), ("q3", None, "pending")], "id string, entity_id string, status string")
    assert {r.id: r.status for r in W.settle_queue(queue, d).collect()} == {"q1": "resolved", "q2": "pending", "q3": "pending"}
    assert W.decide(audit.limit(0), nodes, asked.limit(0)).count() == 0


def test_fence_ignores_what_an_approval_has_seen(spark):
    clusters = spark.createDataFrame([("A", "a", 1.0), ("A", "b", 1.0), ("B", "c", 1.0), ("C", "d", 0.915), ("D", "gone", 1.0)], "canonical_id string, member_id string, score double")
    e = spark.createDataFrame([("a", {"topics": ["sanction"]}), ("b", {"topics": ["poi"]}), ("c", {"topics": ["mare.shadow"]}), ("d", None)], "id string, props map<string,array<string>>")
    got = {r.canonical_id: r.fenced for r in W.nonexemptible(clusters, e, band=(0.9, 0.92)).collect()}
    assert got == {"A": False, "B": True, "C": True, "D": False}
    near = spark.createDataFrame([("gone", True)], "id string, flagged boolean")
    assert {r.canonical_id: r.fenced for r in W.nonexemptible(clusters, e, near).collect()}["D"]


def test_another_ontology(spark):
    mine = (("Base", (), False, True), ("Kind", ("Base",), False, True), ("Tie", (), True, False))
    assert O.common_schema("Base", "Kind", mine) == "Kind" and O.common_schema("Tie", "Kind", mine) is None
    df = spark.createDataFrame([("Tie",), ("Kind",), ("Other",)], "s string")
    assert [tuple(r) for r in df.select(O.is_edge(F.col("s"), mine), O.matchable(F.col("s"), mine)).collect()] == [(True, False), (False, True), (False, True)]
    assert O.common_schema("Airplane", "Asset") == "Airplane" and O.common_schema("Vessel", "Airplane") is None and "PublicBody" in O.NAMES
