"""Grouping of pairwise matches: connected components on a two-dimensional grid.

Vertices are hashed into ``b`` blocks, so that an edge lies in one of ``b * b``
cells.  Each cell runs a local union-find and reports, for each of its
vertices, the smallest id of the vertex's local set.  The reports of the cells
of a vertex's row and column are exchanged by one aggregation per vertex: the
smallest is its parent, and all others get an edge to it.  These edges form
the next, smaller graph, until none is left; the parents of all rounds are
then composed from the smallest table to the largest.

A cell with more than ``cell_edges`` edges (a vertex with very many partners
fills its whole row and column) is cut into several by a hash of the edge:
any division of the edges gives the same sets, as the exchange unites them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import drop_table, table


def local_union_find(left: list[str], right: list[str]) -> tuple[list[str], list[str]]:
    """Vertices of the edges and the smallest id of each one's set."""
    codes, ids = pd.factorize(pd.Series(left + right, dtype=object), sort=False)
    order = sorted(range(len(ids)), key=lambda i: ids[i].encode("utf-8"))
    rank = [0] * len(ids)
    for r, i in enumerate(order):
        rank[i] = r
    names = [ids[i] for i in order]
    parent = list(range(len(names)))
    n = len(left)
    codes = [rank[c] for c in codes.tolist()]
    for k in range(n):
        a, b = codes[k], codes[n + k]
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    roots = []
    for i in range(len(names)):  # a parent is never larger than its child
        parent[i] = parent[parent[i]]
        roots.append(names[parent[i]])
    return names, roots


def _cell(batch: pa.Table) -> pa.Table:
    v, rep = local_union_find(batch.column("u").to_pylist(), batch.column("v").to_pylist())
    return pa.table({"v": pa.array(v, pa.string()), "rep": pa.array(rep, pa.string())})


def _grid(edges: DataFrame, n: int, cell_edges: int) -> DataFrame:
    b = max(1, math.ceil(math.sqrt(n / cell_edges)))
    cells = edges.select(
        "u", "v",
        F.pmod(F.xxhash64("u"), F.lit(b)).alias("row"),
        F.pmod(F.xxhash64("v"), F.lit(b)).alias("col"),
    )
    if b == 1:
        return cells.withColumn("part", F.lit(0))
    # at most b * b rows, and only those of overfull cells, about n / cell_edges in all
    parts = (
        cells.groupBy("row", "col").count().where(F.col("count") > 2 * cell_edges)
        .select("row", "col", F.ceil(F.col("count") / cell_edges).alias("parts"))
    )
    return cells.join(parts, ["row", "col"], "left").withColumn(
        "part", F.pmod(F.xxhash64(F.lit(7), "u", "v"), F.coalesce("parts", F.lit(1)))
    )


def connected_components(pairs: DataFrame, left: str, right: str, *, cell_edges: int = 250_000) -> DataFrame:
    """One row ``(v, root)`` per id that is linked to another id.

    ``root`` is the smallest id, as bytes, of all ids linked to ``v`` directly or
    indirectly.  Rows with a null on either side and pairs of an id with itself
    link nothing; repeated and reversed pairs count once; an empty input gives
    no row.  Ids that are in no pair are not in the result.
    """
    e = pairs.select(F.col(left).cast("string").alias("u"), F.col(right).cast("string").alias("v"))
    e = e.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    edges = table(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while n := edges.count():
        reps = _grid(edges, n, cell_edges).groupBy("row", "col", "part").applyInArrow(_cell, "v string, rep string")
        step = table(
            reps.groupBy("v").agg(F.min("rep").alias("p"), F.collect_set("rep").alias("reps"))
            .where((F.col("v") != F.col("p")) | (F.size("reps") > 1)), "step"
        )  # the reports of a vertex are at most as many as its cells
        rounds.append(step.where(F.col("v") != F.col("p")).select("v", "p"))
        drop_table(edges)
        edges = table(
            step.where(F.size("reps") > 1).select("p", F.explode("reps").alias("r")).where(F.col("r") != F.col("p"))
            .select(F.col("p").alias("u"), F.col("r").alias("v")).distinct(), "edges"
        )
    if not rounds:
        return edges.select("v", F.col("u").alias("root"))
    labels = rounds[-1].select("v", F.col("p").alias("root"))
    for step in reversed(rounds[:-1]):
        up = labels.select(F.col("v").alias("p"), F.col("root"))
        # a vertex that takes part in a later round has its own row there
        below = step.join(up, "p", "left").select("v", F.coalesce("root", "p").alias("root"))
        labels = table(below.unionByName(labels).groupBy("v").agg(F.min("root").alias("root")), "labels")
    return labels.unionByName(labels.select(F.col("root").alias("v"), "root").distinct())


def group_ids(pairs: DataFrame, ids: DataFrame, left: str, right: str, *, id_col: str = "record_id", cell_edges: int = 250_000) -> DataFrame:
    """``(record_id, group_id)`` for every non-null id of ``ids`` and of the pairs.

    An id without a link is its own group; repeated ids give one row.
    """
    linked = connected_components(pairs, left, right, cell_edges=cell_edges)
    own = ids.select(F.col(id_col).cast("string").alias("v")).where(F.col("v").isNotNull())
    rows = linked.select("v", "root").unionByName(own.select("v", F.col("v").alias("root")))
    return rows.groupBy("v").agg(F.min("root").alias("group_id")).select(F.col("v").alias("record_id"), "group_id")


def merge_links(audit: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs that the decisions of both tables link, and all ids that they name."""
    said = lambda c: F.lower(F.trim(F.col(c)))
    members = audit.select("canonical_id", F.explode_outer("source_ids").alias("member"), (said("decision") == "merged").alias("linked"))
    judged = gold.select("left_id", "right_id", (said("label") == "match").alias("linked"))
    pairs = members.where("linked").select(F.col("canonical_id").alias("left"), F.col("member").alias("right")).unionByName(
        judged.where("linked").select(F.col("left_id").alias("left"), F.col("right_id").alias("right"))
    )
    # null canonical ids: the members are still linked to each other through the first of them
    headless = audit.where((said("decision") == "merged") & F.col("canonical_id").isNull()).select(
        F.expr("filter(source_ids, x -> x is not null)").alias("m")
    ).where(F.size("m") > 1).select(F.expr("m[0]").alias("left"), F.explode("m").alias("right"))
    ids = (
        members.select(F.explode(F.array("canonical_id", "member")).alias("record_id"))
        .unionByName(judged.select(F.explode(F.array("left_id", "right_id")).alias("record_id")))
    )
    return pairs.unionByName(headless), ids
