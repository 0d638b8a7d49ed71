from pyspark.sql import functions as F

from quillon.functions import scalars as X
from quillon.operators import graph as G
from quillon.operators import reconcile as R
from quillon.operators import upkeep as U
from quillon.schema import ENTITY


def entity(i, schema, props, source="s:a", at="2024"):
    return (i, schema, props, ["a"], (source, at, "A", "r"), {})


def test_build_graph(spark):
    e = spark.createDataFrame(
        [
            entity("p", "Person", {"name": ["P"], "topics": ["sanction.linked"]}), entity("c", "Company", {"addressEntity": ["addr", "gone"]}, at="2025"), entity("c2", "Company", {"addressEntity": [""]}),
            entity("o", "Ownership", {"owner": ["p", "c", "ghostly"], "asset": ["c"]}), entity("n", "Company", {}, source=""), entity("addr", "Address", {}),
        ], ENTITY,
    )
    nodes = G.build_nodes(e)
    got = {r.id: r.labels for r in nodes.collect()}
    assert got["p"] == ["Entity", "Person", "SanctionLinked"] and "n" not in got and "o" not in got
    links, ghosts = G.build_links(e, nodes)
    assert sorted(r.dst for r in links.collect()) == ["addr", "gone"] and [r.id for r in ghosts.collect()] == ["gone"]
    edges = G.build_edges(e, nodes)
    assert [(r.type, r.src, r.dst) for r in edges.collect()] == [("OWNS", "p", "c")]  # no self-loop, no unknown end


def small(spark):
    nodes = spark.createDataFrame([(c, ["Entity", "Ghost" if c == "d" else "Thing"], {}) for c in "abcdez"], "id string, labels array<string>, props map<string,array<string>>")
    nodes = nodes.withColumn("labels", F.when(F.col("id") == "e", F.array(F.lit("Entity"), F.lit("Sanction"))).otherwise(F.col("labels")))
    edges = spark.createDataFrame([("1", "T", "a", "b"), ("2", "T", "c", "b"), ("3", "U", "c", "d"), ("4", "U", "d", "e"), ("5", "V", "a", "c"), ("6", "W", "a", "b")], "edge_id string, type string, src string, dst string")
    return nodes, edges


def test_reads(spark):
    n, e = small(spark)
    assert sorted(r.id for r in G.neighbors(n, e, "a", 1).collect()) == ["b", "c"]
    assert sorted(r.id for r in G.neighbors(n, e, "a", 99).collect()) == ["b", "c", "d", "e"]
    assert [(r.id, r.type) for r in G.neighborhood(n, e, "a").collect()] == [("b", "T"), ("b", "W"), ("c", "V")]
    p = G.shortest_path(e, "a", "e", 4).first()
    assert p.ids == ["a", "c", "d", "e"] and p.types == ["V", "U", "U"]
    assert G.shortest_path(e, "a", "z").count() == 0 and G.dossier(n, e, "nobody").count() == 0
    near = {r.id: r.flagged for r in G.risk_within(n, e, spark.createDataFrame([("a",), ("z",)], "id string"), 4).collect()}
    assert near == {"a": False, "z": False}  # the only way leads through a ghost
    assert G.risk_within(n.where("id != 'd'"), e, spark.createDataFrame([("c",)], "id string"), 2).first().flagged
    assert {r.id: r.score for r in G.degree_top(n, e, 3).collect()} == {"a": 3, "c": 2, "d": 1}
    s = G.summarize(n.select("id"), 2).first()
    assert s["count"] == 6 and s.sample == ['{"id":"a"}', '{"id":"b"}']


def test_risk_of_a_hub_is_kept_by_node(spark, monkeypatch):
    ids = [f"m{i}" for i in range(300)]
    risky = {"m3", "m250", "far", "gr"}
    ghosts = {"gr", "g"}
    label = lambda i: ["Entity", *(["Sanction"] if i in risky else []), *(["Ghost"] if i in ghosts else [])]
    n = spark.createDataFrame([(i, label(i), {}) for i in [*ids, "hub", "far", "gr", "g", "a", "b", "lone"]], "id string, labels array<string>, props map<string,array<string>>")
    links = [(i, "hub") for i in ids] + [("g", "a"), ("far", "g"), ("b", "gr"), ("far", "lone"), ("lone", "lone")]
    e = spark.createDataFrame([("x", a, b, f"{a}|{b}") for a, b in links], "type string, src string, dst string, edge_id string")
    written = []
    held = G.table
    monkeypatch.setattr(G, "table", lambda df, name="t": (t := held(df, name), written.append(t.count()))[0])
    got = {r.id: r.flagged for r in G.risk_within(n, e, n.select("id"), 3).collect()}
    near: dict[str, set[str]] = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for i in got:
        seen = front = {i}
        for _ in range(3):
            front = {y for x in front for y in near.get(x, ()) if y not in ghosts} - seen
            seen = seen | front
        assert got[i] == bool((seen - {i}) & risky), i
    assert got["m3"] and got["g"] and not got["a"] and not got["b"] and not got["far"]
    assert max(written) <= 4 * len(links)  # a table of pairs would have 300 * 300 rows


def test_points_after_limit(spark):
    rows = spark.createDataFrame([("1", "10", "20", "fr"), ("2", "x", None, "fr"), ("3", None, None, "??"), ("4", "80", "170", None)], "id string, lat string, lon string, country string")
    cent = spark.createDataFrame([("fr", 46.0, 2.0)], "country string, c_lat double, c_lon double")
    got = [(r.id, r.geo_precision) for r in G.points(rows, cent, X.parse_box("-10,0,30,50")).orderBy("id").collect()]
    assert got == [("1", "precise"), ("2", "country")]


def test_freshness_borders(spark):
    rows = [("a", "enabled", 14399), ("b", "enabled", 14400), ("c", "enabled", 86400), ("d", "disabled", 1), ("e", "error", 1), ("f", "enabled", None)]
    df = spark.createDataFrame(rows, "instance_id string, status string, age int").withColumn("last", F.expr("timestamp'2024-01-31 00:00:00' - make_dt_interval(0, 0, 0, age)"))
    got = {r.instance_id: r.s for r in df.select("instance_id", U.freshness_state(F.col("status"), F.col("last"), F.lit("2024-01-31").cast("timestamp")).alias("s")).collect()}
    assert got == {"a": "fresh", "b": "stale", "c": "very_stale", "d": "disabled", "e": "error", "f": "no_data"}
    total = {r.state: r.n for r in U.freshness_summary(spark.createDataFrame(list(got.items()), "i string, state string")).collect()}
    assert total["total"] == 6 and total["fresh"] == 1


def test_streaks(spark):
    rows = [("a", i, s) for i, s in enumerate(["ok", "error", "running", "error", "error"])] + [("b", 1, "error"), ("c", 1, "ok")]
    df = spark.createDataFrame(rows, "instance_id string, run_id int, status string").withColumn("started_at", F.col("run_id"))
    assert {r.instance_id: r.streak for r in U.failure_streaks(df).collect()} == {"a": 2, "b": 1, "c": 0}


def test_orphans_are_strictly_older(spark):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    df = spark.createDataFrame([("u1", 100), ("u2", 101), ("u3", 500), ("u4", None)], "uri string, age int").withColumn("modified", F.expr("timestamp'2024-01-31 00:00:00' - make_dt_interval(0, 0, 0, age)"))
    refs = spark.createDataFrame([("u3",), (None,)], "uri string")
    assert [r.uri for r in U.orphans(df, refs, now, 100).collect()] == ["u2"]


def test_erasure(spark):
    rows = [("e1", "x", "n", "1"), ("e1", "y", "n", "2"), ("e2", "y", "n", "3")]
    log = spark.createDataFrame(rows, "entity_id string, dataset string, prop string, value string")
    assert [r.entity_id for r in R.erase_source(log, "x").collect()] == ["e2"]
    nodes = spark.createDataFrame([("a", {"n": ["1"]}, {"n": ["x"]}), ("b", {"n": ["1"], "m": ["2"]}, {"n": ["x", "y"], "m": ["x"]})], "id string, props map<string,array<string>>, witnesses map<string,array<string>>")
    assert [(r.id, r.props, r.witnesses) for r in R.prune_nodes(nodes, "x").collect()] == [("b", {"n": ["1"]}, {"n": ["y"]})]
    assert R.landing_prefix("a:b") == "a/b/"


def test_scalars(spark):
    one = spark.range(1)
    f = lambda c: one.select(c).first()[0]
    assert f(X.safe_segment(F.lit("../a b"))) == "_a_b" and f(X.safe_segment(F.lit("..."))) == "_"
    assert f(X.url_slug(F.lit("http://x/y/z/"))) == "z" and f(X.qid(F.lit("x Q12 y"))) == "Q12" and f(X.qid(F.lit("x"))) is None
    assert f(X.anchor_id(F.lit("regno"), F.lit("HRB/12"))) != f(X.anchor_id(F.lit("regno"), F.lit("HRB-12"))) == "wm-anchor-regno-HRB-12"
    assert f(X.to_float(F.lit("abc"))) is None and f(X.backoff_seconds(F.lit(3))) == 240.0 and f(X.backoff_seconds(F.lit(99))) == 3600.0
    assert f(X.target_allowed(F.lit("a.example.org"), ["*.example.org"])) and not f(X.target_allowed(F.lit("example.com"), ["x"])) and f(X.target_allowed(F.lit("q"), []))
    assert f(X.placeholder_text(F.lit("[AI generated] "))) and not f(X.placeholder_text(F.lit("real")))
