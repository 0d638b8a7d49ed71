"""Row types of the engine: typed multi-valued entities, claims, decisions and graph tables."""

from __future__ import annotations

VALUES = "map<string,array<string>>"
PROVENANCE = "struct<source_id:string,retrieved_at:string,reliability:string,source_record:string>"
ENTITY = f"id string, schema string, props {VALUES}, datasets array<string>, prov {PROVENANCE}, anchors {VALUES}"
CLAIM = (
    "seq long, statement_id string, canonical_id string, entity_id string, schema string, prop string, value string, dataset string, "
    "reliability string, retrieved_at string, raw_pointer string"
)
CONTEXT_CLAIM = "seq long, canonical_id string, entity_id string, key string, value string, dataset string, retrieved_at string"
NODE = f"id string, labels array<string>, props {VALUES}"
EDGE = f"edge_id string, type string, src string, dst string, props {VALUES}"
RAW = "key string, value string, retrieved_at string"

#: Property of a claim that only says that an entity exists.
EXISTS = "wm:exists"
#: Canonical external ids.
ANCHORS = ("wikidata_id", "geonames_id", "lei", "opencorporates_id", "mitre_gid")
