"""Writers: landing, queue, dead letters, keyed upserts, logs, backup and restore.

Tables are parquet folders.  An insert that ignores known keys appends the
anti-joined rows.  An updated table is a folder of numbered versions: a new one is
written whole beside the old, and readers take the newest that is complete, so
a crash at any moment leaves a whole table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.scalars import safe_segment
from quillon.runtime import _fs


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions of an updated table, oldest first."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    found = [f.getPath() for f in fs.listStatus(p) if f.isDirectory() and f.getPath().getName().startswith("v-")]
    done = [q.toString() for q in found if _fs(spark, q.toString() + "/_SUCCESS")[0].exists(_fs(spark, q.toString() + "/_SUCCESS")[1])]
    return sorted(done)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, of an updated one the newest version; null if there is none."""
    if held := versions(spark, path):
        return spark.read.parquet(held[-1])
    return spark.read.parquet(path) if exists(spark, path) and not _only_versions(spark, path) else None


def _only_versions(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return all(n.startswith("v-") for n in names)


def append(df: DataFrame, path: str, *partitions: str) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*partitions) if partitions else w).parquet(path)


def land(raw: DataFrame, root: str, source: str) -> DataFrame:
    """Raw records written before they are mapped; gives them with their pointer."""
    uri = F.concat(F.lit(f"{root.rstrip('/')}/{source.replace(':', '/')}/"), safe_segment(F.col("key")))
    out = raw.withColumn("source_record", uri)
    append(out, f"{root.rstrip('/')}/{source.replace(':', '/')}")
    return out


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and dead letters with the error cut to 2000 characters."""
    bad = rows.where("error is not null").withColumn("error", F.substring("error", 1, 2000))
    return rows.where("error is null").drop("error"), bad


def insert_ignore(new: DataFrame, path: str, keys: list[str]) -> None:
    """Append rows whose keys are not there yet; within the new rows one of each key."""
    spark = new.sparkSession
    new = new.dropDuplicates(keys)
    old = read_or_none(spark, path)
    append(new if old is None else new.join(old.select(*keys), keys, "left_anti"), path)


def enqueue(entities: DataFrame, path: str, connector: str) -> None:
    """Queue rows of entities, once per source record and entity."""
    payload = F.to_json(F.struct("id", "schema", F.col("props").alias("properties"), "datasets", F.struct(
        F.col("prov.source_id").alias("wm_prov_source_id"), F.col("prov.retrieved_at").alias("wm_prov_retrieved_at"), F.col("prov.reliability").alias("wm_prov_reliability"), F.col("prov.source_record").alias("wm_prov_source_record")
    ).alias("context")))
    rows = entities.select(F.lit(connector).alias("connector_id"), F.col("id").alias("entity_id"), payload.alias("raw_entity"), F.col("prov.source_record").alias("source_record"), F.lit("pending").alias("status"))
    insert_ignore(rows, path, ["source_record", "entity_id"])


def replace(df: DataFrame, path: str) -> None:
    """Write the next version of a table, then drop those before the last; the last stays for readers that have begun."""
    spark = df.sparkSession
    held = versions(spark, path)
    last = int(held[-1].rsplit("v-", 1)[1].split("-")[0]) if held else 0
    df.write.parquet(f"{path.rstrip('/')}/v-{last + 1:012d}-{uuid.uuid4().hex[:8]}")
    for old in held[:-1]:
        fs, p = _fs(spark, old)
        fs.delete(p, True)


def delete_prefix(spark: SparkSession, root: str, prefix: str) -> int:
    """Delete all stored objects below a prefix ``connector/dataset/``; gives their number, and raises if any stays."""
    parts = [x for x in prefix.split("/") if x.strip()]
    if len(parts) < 2 or ".." in parts:
        raise ValueError("a prefix names a connector and a dataset")
    fs, p = _fs(spark, f"{root.rstrip('/')}/{'/'.join(parts)}")
    if not fs.exists(p):
        return 0
    n = int(fs.getContentSummary(p).getFileCount())
    if not fs.delete(p, True) or fs.exists(p):
        raise OSError(f"objects below {prefix} stay")
    return n


def write_graph(nodes: DataFrame, edges: DataFrame, root: str) -> None:
    """Merge nodes and edges into the graph's tables by id: labels unite, values of a property are replaced, no row is doubled."""
    spark = nodes.sparkSession
    old = read_or_none(spark, f"{root}/nodes")
    new = nodes.select("id", "labels", "props").dropDuplicates(["id"])
    if old is not None:
        o = old.select("id", F.col("labels").alias("_l"), F.col("props").alias("_p"))
        j = o.join(new, "id", "full_outer")
        kept = F.map_filter("_p", lambda k, v: ~F.array_contains(F.map_keys("props"), k))
        # a ghost that has become an entity is a ghost no more
        labels = F.array_distinct(F.concat("labels", F.filter("_l", lambda x: (x != "Ghost") | F.array_contains("labels", "Ghost"))))
        ghost = F.array_contains("labels", "Ghost") & ~F.array_contains("_l", "Ghost")
        new = j.select(
            "id", F.when(F.col("labels").isNull() | ghost, F.col("_l")).when(F.col("_l").isNull(), F.col("labels")).otherwise(labels).alias("labels"),
            F.when(F.col("props").isNull(), F.col("_p")).when(F.col("_p").isNull(), F.col("props")).otherwise(F.map_concat("props", kept)).alias("props"),
        )
    replace(new, f"{root}/nodes")
    fresh = edges.select("edge_id", "type", "src", "dst", "props").dropDuplicates(["edge_id"])
    held = read_or_none(spark, f"{root}/edges")
    replace(fresh if held is None else held.join(fresh.select("edge_id"), "edge_id", "left_anti").unionByName(fresh), f"{root}/edges")


def upsert_text(new: DataFrame, path: str) -> None:
    """Article texts by ``entity_id``: attempts add up, text and pointer change only without an error."""
    spark = new.sparkSession
    n = new.select("entity_id", *(F.col(c).alias("n_" + c) for c in ("url", "text", "raw_pointer", "last_error")))
    old = read_or_none(spark, path)
    if old is None:
        old = spark.createDataFrame([], "entity_id string, url string, text string, raw_pointer string, last_error string, attempts int")
    j = old.join(n, "entity_id", "full_outer")
    fresh = F.col("n_url").isNotNull()
    good = fresh & (F.coalesce("n_last_error", F.lit("")) == "")
    replace(j.select(
        "entity_id", F.coalesce("n_url", "url").alias("url"), F.when(good, F.col("n_text")).otherwise(F.col("text")).alias("text"),
        F.when(good, F.col("n_raw_pointer")).otherwise(F.col("raw_pointer")).alias("raw_pointer"), F.when(fresh, F.col("n_last_error")).otherwise(F.col("last_error")).alias("last_error"),
        (F.coalesce("attempts", F.lit(0)) + fresh.cast("int")).alias("attempts"),
    ), path)


def silver(pairs: DataFrame) -> DataFrame:
    """Silver pairs ready to append; a wrong source or a score raises."""
    ok = (F.col("source") == "silver") & F.col("clerical_score").isNull()
    return pairs.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("not a silver pair")).cast("boolean")))


def backup(tables: dict[str, DataFrame], dest: str) -> dict[str, int]:
    """Every table written and counted from what was written; the manifest comes last."""
    spark = next(iter(tables.values())).sparkSession
    counts = {}
    for name, df in tables.items():
        df.write.parquet(f"{dest}/{name}")
        counts[name] = spark.read.parquet(f"{dest}/{name}").count()
    fs, p = _fs(spark, f"{dest}/manifest.json")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(counts, sort_keys=True).encode()))
    out.close()
    return counts


def restore(spark: SparkSession, src: str) -> dict[str, DataFrame]:
    """The tables of a backup; a missing manifest or a wrong count raises before anything is used."""
    text = spark.read.text(f"{src}/manifest.json", wholetext=True).first()[0]
    tables = {}
    for name, n in json.loads(text).items():
        tables[name] = spark.read.parquet(f"{src}/{name}")
        if tables[name].count() != n:
            raise ValueError(f"{name} has not the rows of the manifest")
    return tables


def notification(rows: DataFrame) -> DataFrame:
    """Message text of ``(severity, title, body)``."""
    head = F.when(F.col("severity") != "info", F.concat(F.lit("["), F.upper("severity"), F.lit("] "))).otherwise("")
    return rows.withColumn("message", F.concat(head, "title", F.lit("\n\n"), "body"))


def attempt_rows(calls: DataFrame) -> DataFrame:
    """Audit rows of outgoing model calls ``(call_id, model, messages, entity_ids)``: a digest instead of the text."""
    return calls.select("call_id", "model", F.sha2(F.to_json("messages"), 256).alias("fingerprint"), "entity_ids", F.size("messages").alias("n_messages"))
