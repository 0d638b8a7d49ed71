import random

import pytest
from pyspark.sql import functions as F

from quillon.llm import components as C
from quillon.llm import fusion, mixing


def brute(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)), key=str.encode)
        root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("cell", [250_000, 40])
def test_components_match_brute_force(spark, cell):
    rng = random.Random(3)
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(60)]  # a chain
    pairs += [("hub", f"h{i}") for i in range(150)]  # a hot vertex
    pairs += [(f"x{rng.randrange(80)}", f"x{rng.randrange(80)}") for _ in range(60)]
    pairs += [("n3", "n2"), ("n3", "n2"), ("é", "z")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {r.v: r.root for r in C.connected_components(df, "a", "b", cell_edges=cell).collect()}
    want = {k: v for k, v in brute([p for p in pairs if p[0] != p[1]]).items()}
    assert got == want


def test_components_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a", None), (None, "b"), ("c", "c")], "a string, b string")
    assert C.connected_components(df, "a", "b").count() == 0
    assert C.connected_components(df.limit(0), "a", "b").count() == 0


def test_group_ids_of_decisions(spark):
    audit = spark.createDataFrame(
        [("w", ["a", "b", "a", None], " Merged "), ("w", ["c"], "merged"), ("p", ["d", "a"], "pending_review"), ("q", None, "merged"), (None, ["y", "z"], "merged")],
        "canonical_id string, source_ids array<string>, decision string",
    ).withColumn("record_id", F.lit("clash"))
    gold = spark.createDataFrame([("b", "e", "MATCH"), ("e", "e", "match"), ("f", None, "match"), ("g", "a", "non_match")], "left_id string, right_id string, label string")
    pairs, ids = C.merge_links(audit, gold)
    got = {r.record_id: r.group_id for r in C.group_ids(pairs, ids, "left", "right").collect()}
    assert got == {"w": "a", "a": "a", "b": "a", "c": "a", "e": "a", "p": "p", "d": "d", "q": "q", "f": "f", "g": "g", "y": "y", "z": "y"}


QUEUE = "id string, entity_id string, raw_entity string, status string"


def payload(source, at, **props):
    import json

    return json.dumps({"id": "x", "properties": props, "context": {k: v for k, v in (("wm_prov_source_id", source), ("wm_prov_retrieved_at", at)) if v}})


def test_survivors(spark):
    rows = [
        ("q1", "e1", payload("s:b", "2024-01-01T10:00:00Z", name=["Old"], country=["--"]), "resolved"),
        ("q2", "e1", payload("s:b", "2024-01-01T12:30:00+02:00", name=["New"], country=["zz"], size=[]), "resolved"),  # later as an instant
        ("q0", "e2", payload("s:b", "2024-01-01T10:30:00Z", name=["Tie"], country=["fr", "n/a"]), "resolved"),
        ("q4", "e2", payload("s:a", None, city=["Paris"], name=["0000-00-00"]), "resolved"),
        ("q5", "e2", payload(None, "2030-01-01T00:00:00Z", city=["Rome"], zip=["1"]), "resolved"),
        ("q6", "e2", payload("s:a", "2030-01-01T00:00:00Z", name=["Waiting"]), "pending"),
        ("q7", "e2", "{broken", "resolved"),
        ("q8", None, payload("s:a", None, name=["Nobody"]), "resolved"),
    ]
    seeds = spark.createDataFrame([("s", "a", "A"), ("s", "b", None), ("s", "c", "F")], "connector_id string, natural_key string, reliability string")
    audit = spark.createDataFrame([("c", ["e1", "e2", "e2"], "MERGED "), ("d", ["e1"], "pending_review")], "canonical_id string, source_ids array<string>, decision string")
    claims = fusion.claims(spark.createDataFrame(rows, QUEUE), seeds)
    got = {(r.canonical_id, r.field): r.queue_item_id for r in fusion.survivors(claims, fusion.members(audit)).collect()}
    assert got == {("c", "name"): "q0", ("c", "country"): "q0", ("c", "city"): "q4", ("c", "zip"): "q5"}
    empty = fusion.claims(spark.createDataFrame([], QUEUE), seeds)
    assert fusion.survivors(empty, fusion.members(audit)).count() == 0


def test_fusion_discounts_copied_votes(spark):
    rows, groups = [], []
    for g in range(40):
        groups.append((f"g{g}", f"e{g}"))
        true, false = f"t{g}", f"f{g}"
        say = {"a": true if g % 5 else "x", "b": true if g % 4 else "y", "f": true if g % 7 else "z"}
        say |= dict.fromkeys("cde", true if g % 3 else false)  # d and e copy c
        rows += [(f"i{g}{s}", f"e{g}", "name", [v], s, 1, None) for s, v in say.items()]
    claims = spark.createDataFrame(rows, "item string, entity_id string, field string, values array<string>, source string, grade int, at timestamp")
    members = spark.createDataFrame(groups, "canonical_id string, entity_id string")
    got = {r.canonical_id: r.value for r in fusion.fuse(claims, members).collect()}
    assert len(got) == 40 and sum(v.startswith("t") for v in got.values()) >= 36
    assert fusion.fuse(claims.limit(0), members).count() == 0


def test_mix_reaches_its_budgets(spark):
    docs = [(i, "word " * (5 + i % 7), "small" if i < 20 else "big") for i in range(400)] + [(900, None, "big"), (901, "", "small"), (902, "x", None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("mix_id", F.lit("clash"))
    targets = spark.createDataFrame(
        [("m", 0.5, "big", 1.0, 1), ("m", 0.5, "small", 1.0, 3), ("n", 0.1, "big", 3.0, 1), ("n", 0.1, "gone", 1.0, 1), ("z", 0.1, "big", 0.0, 2)],
        "mix_id string, size_factor double, source string, target_weight double, max_repeats int",
    )
    chosen, shares = mixing.mix(docs, targets, range_rows=50)
    s = {(r.mix_id, r.source): r for r in shares.collect()}
    c = chosen.collect()
    assert max(r.repeats for r in c if r.source == "small") == 3  # capped, and short of its target
    assert s["m", "small"].actual_tokens < s["m", "small"].target_tokens
    assert abs(s["m", "big"].actual_tokens - s["m", "big"].target_tokens) <= 12
    assert s["n", "gone"].actual_tokens == 0 and s["z", "big"].documents == 0
    for (m, src), r in s.items():
        assert r.actual_tokens == sum(x.n_tokens * x.repeats for x in c if (x.mix_id, x.source) == (m, src))
    again = mixing.mix(docs.repartition(7), targets, range_rows=13)[0]
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in c}  # whatever the partitions and ranges are
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0
