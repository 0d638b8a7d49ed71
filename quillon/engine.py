"""Reads over the graph tables as one object."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import parse_box
from quillon.operators import graph as G
from quillon.operators import upkeep as U


@dataclass
class Engine:
    """``nodes`` and ``edges``, and for some reads the ledger, centroids, instances and runs."""

    nodes: DataFrame
    edges: DataFrame
    ledger: DataFrame | None = None
    centroids: DataFrame | None = None
    instances: DataFrame | None = None
    runs: DataFrame | None = None

    def entity(self, entity_id: str) -> DataFrame:
        return G.get_entity(self.nodes, entity_id) if self.ledger is None else G.by_alias(self.nodes, self.ledger, entity_id)

    def provenance(self, entity_id: str) -> DataFrame:
        return G.get_provenance(self.nodes, entity_id)

    def neighbors(self, entity_id: str, hops: int = 1, summary: bool = False) -> DataFrame:
        rows = G.neighbors(self.nodes, self.edges, entity_id, hops)
        return G.summarize(rows) if summary else rows

    def paths(self, from_id: str, to_id: str, max_hops: int = 4) -> DataFrame:
        return G.shortest_path(self.edges, from_id, to_id, max_hops)

    def dossier(self, entity_id: str, hops: int = 1) -> DataFrame:
        return G.dossier(self.nodes, self.edges, entity_id, hops)

    def search(self, term: str, limit: int = 50) -> DataFrame:
        return G.search(self.nodes, term, limit)

    def stats(self) -> DataFrame:
        return G.stats(self.nodes, self.edges)

    def feed(self, limit: int = 50) -> DataFrame:
        return G.recent_articles(self.nodes, limit)

    def events(self, limit: int = 50) -> DataFrame:
        return G.recent_events(self.nodes, self.edges, limit)

    def points(self, limit: int = 500, bbox: str | None = None) -> DataFrame:
        return G.points(G.geo_candidates(self.nodes, self.edges, limit), self.centroids, parse_box(bbox) if bbox else None)

    def freshness(self) -> DataFrame:
        return U.freshness_summary(U.freshness(self.instances, self.runs, F.current_timestamp()))
