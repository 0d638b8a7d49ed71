import random

import pytest
from pyspark.sql import functions as F

from quillon import ontology as O
from quillon.operators import claims as C
from quillon.schema import CLAIM, ENTITY, EXISTS

NONE = "map<string,array<string>>"


def claim(seq, canon, entity, prop, value, dataset, schema="Company"):
    return (seq, f"{dataset}|{entity}|{prop}|{value}", canon, entity, schema, prop, value, dataset, "B", f"2024-01-{seq:02d}", f"s3://{entity}")


LOG = [
    claim(1, "a", "a", "name", "Acme", "x"), claim(2, "b", "b", "name", "ACME", "y"), claim(3, "b", "b", "country", "fr", "y"),
    claim(4, "c", "c", "name", "Other", "z", "Organization"), claim(5, "d", "d", EXISTS, "d", "x"), claim(6, "e", "e", "involved", "b", "x", "Event"),
]


def folded(spark, rows, aliases, **kw):
    log = spark.createDataFrame(rows, CLAIM)
    closure = C.alias_closure(spark.createDataFrame(aliases, "alias string, target string"))
    return {r.id: r for r in C.fold(log, closure, **kw).collect()}


def test_fold(spark):
    got = folded(spark, LOG, [("b", "a")])
    assert set(got) == {"a", "c", "d", "e"}
    a = got["a"]
    assert a.props == {"name": ["ACME", "Acme"], "country": ["fr"]} and a.datasets == ["x", "y"]
    assert a.witnesses == {"name": ["x", "y"], "country": ["y"]} and a.prov.source_id == "x" and a.prov.source_record == "s3://a"
    assert got["d"].props == {} and got["d"].datasets == ["x"]
    assert got["e"].props["involved"] == ["a"]  # the value of a link moves with its target


def test_fold_is_order_free_and_ignores_repeats(spark):
    rows = LOG * 2
    random.Random(1).shuffle(rows)
    assert folded(spark, rows, [("b", "a")]) == folded(spark, LOG, [("b", "a")])
    assert folded(spark, [], [("b", "a")]) == {}


def test_incremental_fold_equals_the_full_one(spark):
    log = spark.createDataFrame(LOG, CLAIM)
    closure = C.alias_closure(spark.createDataFrame([("b", "a")], "alias string, target string"))
    full = {r.id: r for r in C.fold(log, closure).collect()}
    part = {r.id: r for r in C.fold_since(log, closure, 2).collect()}
    assert set(part) == {"a", "c", "d", "e"} and all(part[k] == full[k] for k in part)
    assert C.fold_since(log, closure, 6).count() == 0


def test_common_schema_and_context(spark):
    rows = [claim(1, "a", "a", "name", "A", "x", "Company"), claim(2, "b", "b", "name", "B", "y", "Organization")]
    context = spark.createDataFrame([("a", "lei", "1"), ("b", "lei", "2")], "canonical_id string, key string, value string")
    got = folded(spark, rows, [("b", "a")], context=context)
    assert got["a"].schema == "Company" and got["a"].anchors == {"lei": ["1", "2"]}
    assert O.common_schema("Company", "Vessel") is None and O.common_schema("Person", "LegalEntity") == "Person"


def test_alias_closure(spark):
    chain = [(f"n{i:03d}", f"n{i - 1:03d}") for i in range(1, 40)] + [("p", "q"), ("q", "p"), ("s", "s")]
    got = {r.alias: r.survivor for r in C.alias_closure(spark.createDataFrame(chain, "alias string, target string")).collect()}
    assert all(got[f"n{i:03d}"] == "n000" for i in range(1, 40))
    assert got == {**{f"n{i:03d}": "n000" for i in range(1, 40)}, "q": "p"}  # of a cycle the smallest survives
    assert C.alias_closure(spark.createDataFrame([], "alias string, target string")).count() == 0


def test_alias_closure_of_long_cycles(spark):
    rng = random.Random(3)
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "d")]  # cycles of 3 and 4
    rows += [("t2", "t1"), ("t1", "x3"), ("x1", "x2"), ("x2", "x3"), ("x3", "x1")]  # one with a tail
    rows += [(f"k{i:02d}", f"k{i + 1:02d}") for i in range(30)] + [("k30", "k21")]  # a long tail of smaller ids
    rows += [(f"r{i:03d}", f"r{rng.randrange(120):03d}") for i in range(100)]
    after, want = {a: b for a, b in rows if a != b}, {}
    for a in after:
        seen, at = [], a
        while at in after and at not in seen:
            seen.append(at)
            at = after[at]
        end = min(seen[seen.index(at) :]) if at in seen else at
        if a != end:
            want[a] = end
    got = sorted((r.alias, r.survivor) for r in C.alias_closure(spark.createDataFrame(rows, "alias string, target string")).collect())
    assert got == sorted(want.items())
    assert want["b"] == want["c"] == "a" and want["g"] == "d" and want["t2"] == "x1" and want["k00"] == "k21"


def entity(i, schema="Company", props=None, source="s:a", anchors=None):
    return (i, schema, props or {}, [source], (source, "2024", "A", f"s3://{i}"), anchors or {})


def test_statements_and_decisions(spark):
    e = spark.createDataFrame([entity("a", props={"name": ["A", "B"]}), entity("b"), entity("c", source="")], ENTITY)
    c = spark.createDataFrame([("m", "a", 0.9), ("m", "b", 0.9), ("c", "c", 1.0)], "canonical_id string, member_id string, score double")
    rows = C.statements(c, e).collect()
    assert sorted((r.entity_id, r.prop, r.value) for r in rows) == [("a", "name", "A"), ("a", "name", "B"), ("b", EXISTS, "b")]
    assert [(r.canonical_id, r.member_ids) for r in C.decisions(c).collect()] == [("m", ["a", "b"])]


def test_anchor_tiers_fall_through(spark):
    e = spark.createDataFrame(
        [entity("a", props={"wikidataId": ["Q1"], "registrationNumber": ["7"]}), entity("b", props={"wikidataId": ["Q2"], "registrationNumber": ["7"]}), entity("x", anchors={"mitre_gid": ["G0001"]}), entity("y", anchors={"lei": ["bad"]})], ENTITY
    )
    c = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "x"), ("n", "y")], "canonical_id string, member_id string")
    got = {r.canonical_id: (r.kind, r.value) for r in C.pick_anchor(c, e).collect()}
    assert got == {"m": ("regno", "7"), "n": ("gid", "G0001")}
    known = spark.createDataFrame([("wm-anchor-regno-7", "wm-anchor-regno-7")], "canonical_id string, canonical_alias string")
    ids = {r.canonical_id: (r.durable_id, r.known) for r in C.durable_ids(c, e, known).collect()}
    assert ids == {"m": ("wm-anchor-regno-7", True), "n": ("wm-anchor-gid-G0001", False)}


def test_ledger_is_idempotent(spark):
    durable = spark.createDataFrame([("m", "w")], "canonical_id string, durable_id string")
    c = spark.createDataFrame([("m", "a"), ("m", "b")], "canonical_id string, member_id string")
    empty = spark.createDataFrame([], "canonical_id string, canonical_alias string")
    first = C.ledger_rows(durable, c, empty)
    assert first.count() == 4 and C.ledger_rows(durable, c, first).count() == 0


def test_numbering_is_gap_free(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"))
    got = sorted((r.k, r.seq) for r in C.numbered(df, 10, "k").collect())
    assert got == [(k, 11 + k) for k in range(500)]


@pytest.mark.parametrize("topics, now", [(["sanction"], True), (["sanction.linked.x"], True), (["unheard.of"], True), (["media"], False), ([], False), (None, False)])
def test_sensitive(spark, topics, now):
    df = spark.createDataFrame([(topics,)], "t array<string>")
    assert df.select(O.is_sensitive(F.col("t"))).first()[0] is now
