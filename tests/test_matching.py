import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions.python_udfs import Spellings, blocked_address, jaro_winkler, jaro_winkler_bytes, name_key, text_of_html
from quillon.operators import clustering as K
from quillon.operators import evaluation as V
from quillon.operators import matching as M
from quillon.schema import ENTITY


def entity(i, name, schema="Company", anchors=None, **props):
    p = {k: v if isinstance(v, list) else [v] for k, v in props.items()}
    return (i, schema, {"name": [name], **p}, ["d"], (f"s:{i}", "2024", "A", "r"), anchors or {})


@pytest.mark.parametrize(
    "a, b, want",
    [
        ({}, {}, 0.9825),  # name and country
        ({"registrationNumber": "1"}, {"registrationNumber": "2"}, 0.0856),
        ({"registrationNumber": "1"}, {"taxNumber": "1"}, 0.9998),
    ],
)
def test_golden_probabilities(spark, a, b, want):
    rows = M.flatten(spark.createDataFrame([entity("l", "Legion Ltd", country="fr", **a), entity("r", "LEGION LLC", country="fr", **b), entity("x", "Unlike", "Article")], ENTITY))
    got = M.score_pairs(rows, predict=0.001).collect()
    assert len(got) == 1 and round(got[0].probability, 4) == want


def test_anchor_clash_is_stronger_than_names(spark):
    rows = M.flatten(spark.createDataFrame([entity("l", "Legion", country="fr", anchors={"lei": ["1"]}), entity("r", "Legion", country="fr", anchors={"lei": ["2"]})], ENTITY))
    assert M.score_pairs(rows, predict=0.0001).first().probability < 0.1
    assert M.score_pairs(rows.limit(0)).count() == 0


def test_names_and_scripts():
    assert name_key("ООО Легион Комплект") == name_key("LIMITED LIABILITY COMPANY LEGION KOMPLEKT") == "komplekt legion"
    assert name_key("International Trading Co Ltd") != name_key("Import Export Trading Co Ltd")
    assert name_key(None) is None and name_key("!!") is None
    assert round(jaro_winkler_bytes("martha", "marhta"), 5) == 0.96111 and jaro_winkler_bytes("", "") == 0.0


def test_blocking_salts_hot_keys(spark):
    df = spark.range(60).select(F.col("id").cast("string").alias("id"), F.lit("fr").alias("country"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name_fp"), F.lit(None).cast("string").alias("wikidata_id"))
    pairs = M._block(df, None, ["id"], block_rows=7)
    assert pairs.count() == pairs.distinct().count() == 60 * 59 // 2


def test_pairs_are_counted_without_making_them(spark, tmp_path):
    from quillon.plans.quality_queries import QUERIES

    q = QUERIES["blocked_pairs"][0]
    company = lambda rows: rows.selectExpr("id", "name", "land AS jurisdiction_code", "'2000' AS incorporation_date", "'' AS company_number")
    rows = [(f"c{i % 90:02d}" if i else None, None if i % 11 == 0 else f"{'abcde'[i % 5]}xyz z{i}", None if i % 7 == 0 else ["fr", "de", ""][i % 3]) for i in range(120)]
    some = company(spark.createDataFrame(rows, "id string, name string, land string"))
    some.unionByName(some).write.parquet(f"{tmp_path}/some/company.parquet")  # rows repeated, and ids with several keys
    want = {}
    for x in {(i, j) for i, n, c in rows for j, m, e in rows if i and j and i < j and (c and c == e or n and m and n[:4] == m[:4])}:
        want[x[0][-1]] = want.get(x[0][-1], 0) + 1
    assert {r["last"]: r.n for r in q(spark, f"{tmp_path}/some").collect()} == want
    many = 300_000  # 45 thousand million pairs of one block
    company(spark.range(many).selectExpr("format_string('%07d', id) AS id", "'n' AS name", "'fr' AS land")).write.parquet(f"{tmp_path}/many/company.parquet")
    assert sum(r.n for r in q(spark, f"{tmp_path}/many").collect()) == many * (many - 1) // 2
    some.limit(0).write.parquet(f"{tmp_path}/none/company.parquet")
    assert q(spark, f"{tmp_path}/none").count() == 0


def test_levels_of_blocks_equal_those_of_pairs(spark):
    rng = random.Random(3)
    name = lambda: None if rng.random() < 0.05 else "".join(rng.choice("abcé ") for _ in range(rng.choice((1, 4, 8, 12, 90))))
    rows = [(f"r{i}", name(), rng.choice(("fr", "de", None)), rng.choice(("2000", "2001", None)), rng.choice(("Q1", "Q2", None, None))) for i in range(150)]
    rows += [("r1", "abc", "fr", None, None), (None, "abc", "fr", None, None), ("e", "", "fr", None, None)]
    df = spark.createDataFrame(rows, "id string, name_fp string, country string, birth_date string, wikidata_id string")
    got = {tuple(r) for r in M.block_levels(df, block_rows=20).collect()}
    x, y = F.col("name_fp_l"), F.col("name_fp_r")
    pairs = M._block(df, None, df.columns).withColumn("jw", F.coalesce(jaro_winkler(F.when(x != y, x), y), F.lit(0.0)))
    assert got == {tuple(r) for r in M.gamma_levels(pairs).collect()} and {g[0] for g in got} == {-1, 0, 1, 2, 3}
    assert M.block_levels(df.limit(0)).count() == 0


def test_spellings_equal_the_distance_of_two():
    rng = random.Random(5)
    names = ["", "martha", "marhta", "dixon", "dicksonx", *("".join(rng.choice("abcde") for _ in range(rng.choice((1, 3, 7, 10, 64, 65, 70)))) for _ in range(120))]
    s, n = Spellings(names), len(names)
    a, b = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
    want = np.array([jaro_winkler_bytes(x, y) for x in names for y in names])
    a, b, want = a[a != b], b[a != b], want[a != b]
    a, b, want = (v[[names[i] != names[j] for i, j in zip(a, b)]] for v in (a, b, want))
    may = s.may_reach(np.arange(n), np.arange(n), 0.82)
    for least in (0.75, 0.82):
        assert (s.jaro_winkler(a, b, least) == np.where(want >= least, want, 0)).all()
    assert may[a, b][want >= 0.82].all() and (want >= 0.82).any()


def test_training_compares_a_large_block_in_time(spark):
    """Eight million pairs of one block; as rows through a pandas UDF they take minutes."""
    df = spark.range(4000).selectExpr("concat('r', id) AS id", "concat(substring(sha1(concat(id)), 1, 12), ' ', substring(sha1(concat(id + 7)), 1, 6)) AS name_fp", "'fr' AS country", "'2000' AS birth_date", "cast(NULL AS string) AS wikidata_id")
    took = time.time()
    assert sum(r["count"] for r in M.block_levels(df).collect()) == 4000 * 3999 // 2
    assert time.time() - took < 60


def test_training_compares_names_with_one_beginning_in_time(spark):
    """Two hundred million pairs of one block whose letters rule out few; as single pairs they take minutes."""
    df = spark.range(20_000).selectExpr("concat('r', id) AS id", "concat('atlas ', translate(substring(sha1(concat(id)), 1, 12), '0123456789', 'aeiouaeiou'), ' limited') AS name_fp", "cast(NULL AS string) AS country", "concat(id % 3) AS birth_date", "cast(NULL AS string) AS wikidata_id")
    took = time.time()
    got = M.block_levels(df).collect()
    assert time.time() - took < 60
    assert sum(r["count"] for r in got) == 20_000 * 19_999 // 2 and all(r["count"] > 0 for r in got)


def test_close_names_are_those_of_all_pairs(monkeypatch):
    from quillon.functions import close_names

    monkeypatch.setattr(close_names, "TILE", 50)
    rng = random.Random(7)
    end = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.choice((0, 2, 8, 14, 30, 58, 61, 80, 130))))
    for few, begin in ((0, ["atla"]), (200, ["atla"]), (0, ["atla", "atlb", "atz ", "ax", "b", "é"])):
        monkeypatch.setattr(close_names, "FEW", few)
        names = sorted({rng.choice(begin) + end() for _ in range(220)})
        close, part = close_names.CloseNames(names, (0.92, 0.82)), np.array([rng.random() < 0.4 for _ in names])
        key = np.cumsum([i == 0 or names[i][:4] != names[i - 1][:4] for i in range(len(names))])
        find = close.alike if len(begin) == 1 else lambda a, b: close.unlike(a, b, key)
        jw = lambda i, j: jaro_winkler_bytes(names[i], names[j])
        assert all(jw(i, j) == jw(j, i) for i in range(len(names)) for j in range(i))
        for a, b in ((np.arange(len(names)), None), (np.flatnonzero(part), np.flatnonzero(~part))):
            got = [(min(x, y), max(x, y), lv) for f in find(a, b) for x, y, lv in zip(*(v.tolist() for v in f))]
            want = {(i, j, 1 + (jw(i, j) >= 0.92)) for i in range(len(names)) for j in range(i + 1, len(names)) if (b is None or part[i] != part[j]) and (len(begin) == 1 or key[i] != key[j]) and jw(i, j) >= 0.82}
            assert set(got) == want and len(got) == len(want) > 5


def clusters(spark, ids, pairs, judgements=None):
    e = spark.createDataFrame([(i,) for i in ids], "id string")
    p = spark.createDataFrame(pairs, "left_id string, right_id string, probability double")
    j = spark.createDataFrame(judgements, "left_id string, right_id string, judgement string") if judgements else None
    out = {}
    for r in K.cluster(e, p, j).collect():
        out.setdefault(r.canonical_id, set()).add(r.member_id)
    return sorted(map(sorted, out.values())), out


def test_clusters(spark):
    got, named = clusters(spark, "abcdef", [("a", "b", 0.95), ("b", "c", 0.93), ("d", "e", 0.91)])
    assert got == [["a", "b", "c"], ["d"], ["e"], ["f"]] and "d" in named
    again, other = clusters(spark, "fedcba", [("b", "c", 0.93), ("a", "b", 0.95)])
    assert set(other) == set(named)


def test_negative_judgements_hold_transitively(spark):
    pairs = [("a", "b", 0.99), ("b", "c", 0.95), ("c", "d", 0.97), ("x", "y", 0.99)]
    got, _ = clusters(spark, "abcdxy", pairs, [("a", "c", "negative")])
    assert got == [["a", "b"], ["c", "d"], ["x", "y"]]
    got, _ = clusters(spark, "abcdxy", pairs, [("x", "y", "negative"), ("a", "x", "positive")])
    assert got == [["a", "b", "c", "d", "x"], ["y"]]


def test_merge_leaves_out_foreign_schemata(spark):
    e = spark.createDataFrame([entity("a", "A", "Organization"), entity("b", "B", "Company"), entity("c", "C", "Vessel")], ENTITY)
    c = spark.createDataFrame([("m", x) for x in "abc"], "canonical_id string, member_id string")
    got = {tuple(r.members): r for r in K.merge_entities(c, e).collect()}
    assert got[("a", "b")].schema == "Company" and got[("a", "b")].props["name"] == ["A", "B"] and got[("c",)].id == "c"


def test_guard(spark):
    e = spark.createDataFrame([entity("a", "A", topics=["sanction"]), entity("b", "B"), *(entity(f"m{i}", "M") for i in range(12))], ENTITY)
    c = spark.createDataFrame([("s", "a", 0.99), ("s", "b", 0.99), ("one", "b", 1.0), *(("big", f"m{i}", 0.99) for i in range(12))], "canonical_id string, member_id string, score double")
    none = spark.createDataFrame([], "canonical_id string, field string, values array<string>")
    got = {r.canonical_id: (r.flagged, r.reason) for r in K.needs_review(c, e, none).collect()}
    assert got == {"s": (True, "sensitive member a"), "big": (True, "size 12")}


def parts(spark, gold, pred):
    f = lambda d: spark.createDataFrame(list(d.items()), "record string, label string")
    return f(gold), f(pred)


def test_cluster_metrics(spark):
    gold, pred = parts(spark, {"1": "a", "2": "a", "3": "b", "4": "b"}, dict.fromkeys("1234", "x"))
    b = V.bcubed(gold, pred).first()
    assert (b.precision, b.recall, round(b.f1, 6)) == (0.5, 1.0, round(2 / 3, 6)) and V.over_merge_rate(gold, pred).first()[0] == 1.0
    gold, pred = parts(spark, {"1": "a", "2": "a", "3": "b", "4": "b"}, {"1": "x", "2": "x", "3": "x", "4": "y"})
    b, c = V.bcubed(gold, pred).first(), V.ceafe(gold, pred).first()
    assert (round(b.precision, 6), b.recall) == (round(2 / 3, 6), 0.75) and round(c.f1, 6) == round(11 / 15, 6)
    same = V.ceafe(gold, gold).first()
    assert (same.precision, same.recall) == (1.0, 1.0)


def test_assignment_is_optimal():
    import itertools
    import random

    rng = random.Random(4)
    for _ in range(30):
        n, m = rng.randrange(1, 5), rng.randrange(1, 6)
        w = [[rng.random() for _ in range(m)] for _ in range(n)]
        t = w if n <= m else [list(c) for c in zip(*w)]
        best = max(sum(t[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(len(t[0])), len(t)))
        assert abs(V.assign(w) - best) < 1e-9


def test_floor_and_threshold(spark):
    df = spark.createDataFrame([("match", 1.0), ("non_match", 0.0), ("match", 0.9)], "label string, probability double")
    f = V.floor(df, 0.5).first()
    assert (f.precision, f.recall, f.f1, f.over_merge) == (1.0, 1.0, 1.0, 0.0)
    assert V.floor(df.limit(0), 0.5).first().f1 == 0.0
    assert V.recommended_threshold(V.precision_recall(df)).first().threshold == 0.9


def test_silver(spark):
    rows = [entity("a", "A", leiCode="1"), entity("b", "B", leiCode="1"), entity("c", "C", leiCode="2", registrationNumber="9", country="fr"), entity("d", "D", registrationNumber="9", country="de")]
    got = {(r.left_id, r.right_id): r.label for r in V.silver_pairs(spark.createDataFrame(rows, ENTITY)).collect()}
    assert got == {("a", "b"): "match", ("a", "c"): "non_match", ("b", "c"): "non_match"}


def test_html_and_addresses():
    page = "<html><nav><p>Menu entry that is quite long enough to count as text here</p></nav><p>short</p><p>This paragraph is certainly longer than forty characters.</p></html>"
    assert text_of_html(page) == "This paragraph is certainly longer than forty characters." and text_of_html(None) == "" and text_of_html("<b>x</b>") == "x"
    assert blocked_address("10.0.0.1") and blocked_address("100.64.1.1") and blocked_address("::ffff:127.0.0.1") and blocked_address("nope") and not blocked_address("8.8.8.8")
