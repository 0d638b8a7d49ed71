"""Freshness, failure streaks, metrics, retention and clean-up of stored objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATES = ("disabled", "error", "no_data", "very_stale", "stale", "fresh")


def freshness_state(status: Column, last: Column, now: Column, stale: int = 4 * 3600, very: int = 24 * 3600) -> Column:
    """Of six states the first that holds; ages at a border are the staler state."""
    age = F.unix_timestamp(now) - F.unix_timestamp(last)
    return F.when(status == "disabled", "disabled").when(status == "error", "error").when(last.isNull(), "no_data").when(age >= very, "very_stale").when(age >= stale, "stale").otherwise("fresh")


def last_success(instances: DataFrame, runs: DataFrame) -> DataFrame:
    """Instances with the end of their last good ingest; null for none."""
    ok = runs.where((F.col("kind") == "ingest") & (F.col("status") == "ok")).groupBy("instance_id").agg(F.max("finished_at").alias("last_success"))
    return instances.join(ok, "instance_id", "left")


def freshness(instances: DataFrame, runs: DataFrame, now: Column, stale: int = 4 * 3600, very: int = 24 * 3600) -> DataFrame:
    return last_success(instances, runs).withColumn("state", freshness_state(F.col("status"), F.col("last_success"), now, stale, very))


def freshness_summary(rows: DataFrame) -> DataFrame:
    """Instances by state, each state listed, and the total."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(s, i) for i, s in enumerate((*STATES, "total"))], "state string, pos int")
    n = rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    all_ = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("state"), "n")
    return every.join(n.unionByName(all_), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"), "pos").orderBy("pos").drop("pos")


def failure_streaks(runs: DataFrame) -> DataFrame:
    """``(instance_id, streak)``: runs with an error since the last that was none, newest first.

    Two aggregations instead of an ordered walk: the newest run that is no
    error, and the errors after it.
    """
    at = F.struct("started_at", "run_id")
    good = runs.where(F.col("status") != "error").groupBy("instance_id").agg(F.max(at).alias("good"))
    j = runs.join(good, "instance_id", "left")
    since = (F.col("status") == "error") & (F.col("good").isNull() | (at > F.col("good")))
    return j.groupBy("instance_id").agg(F.count_if(since).alias("streak"))


def latest_by(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The value of the newest row of each key."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def latest_stat(runs: DataFrame, field: str, domain: tuple[str, ...]) -> DataFrame:
    """A JSON field of the newest finished resolve run, null outside its domain."""
    last = runs.where((F.col("kind") == "resolve") & F.col("finished_at").isNotNull()).agg(F.max_by("stats", "started_at").alias("stats"))
    v = F.get_json_object("stats", f"$.{field}")
    return last.select(F.when(v.isin(*domain), v).alias(field))


def finalize(runs: DataFrame, instances: DataFrame, streaks: DataFrame, now: Column, *, disable_at: int = 10) -> DataFrame:
    """Instances after a run: next start by kind and failures; a long streak disables."""
    from quillon.functions.scalars import backoff_seconds

    done = latest_by(runs, "instance_id", "status", "started_at", "run_id").withColumnRenamed("status", "last_status")
    j = instances.join(done, "instance_id", "left").join(streaks, "instance_id", "left")
    failed = F.col("last_status") == "error"
    wait = F.when(failed, backoff_seconds(F.coalesce("streak", F.lit(1)))).when(F.col("stream"), 0.0).otherwise(3600.0)
    status = F.when(failed & (F.col("streak") >= disable_at), "disabled").otherwise(F.col("status"))
    return j.select("instance_id", status.alias("status"), (now + F.make_dt_interval(secs=wait.cast("decimal(18,6)"))).alias("next_run"))


def due(instances: DataFrame, now: Column) -> DataFrame:
    return instances.where((F.col("status") == "enabled") & (F.col("next_run").isNull() | (F.col("next_run") <= now)))


def recover(runs: DataFrame) -> DataFrame:
    """Runs that a crash left running become errors."""
    return runs.withColumn("status", F.when(F.col("status") == "running", "error").otherwise(F.col("status")))


def prune(rows: DataFrame, at: str, now: Column, days: int, *, finished: bool = True) -> DataFrame:
    """Rows that are kept: younger than so many days, or not finished."""
    old = F.col(at) < now - F.make_dt_interval(days=F.lit(days))
    return rows.where(~F.coalesce(old, F.lit(not finished)))


def orphans(objects: DataFrame, referenced: DataFrame, now: Column, min_age: int) -> DataFrame:
    """Objects ``(uri, modified)`` that nothing refers to and that are older than ``min_age`` seconds (strictly)."""
    old = objects.where(F.col("modified").isNotNull() & (F.unix_timestamp(now) - F.unix_timestamp("modified") > min_age))
    return old.join(referenced.select("uri").where("uri is not null").distinct(), "uri", "left_anti")


def crosstab(rows: DataFrame, group: str, values: list[str], by: str) -> DataFrame:
    """Counts of the listed values per group in one pass."""
    return rows.groupBy(group).agg(*(F.count_if(F.col(by) == v).alias(v) for v in values))


def metrics(*families: tuple[str, DataFrame, list[str], str]) -> DataFrame:
    """One long table ``(name, labels, value)`` of gauge families ``(name, rows, label columns, value column)``."""
    out = None
    for name, rows, labels, value in families:
        m = F.map_from_arrays(F.array(*map(F.lit, labels)), F.array(*(F.col(c).cast("string") for c in labels))) if labels else F.create_map().cast("map<string,string>")
        part = rows.select(F.lit(name).alias("name"), m.alias("labels"), F.col(value).cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def host_capped(pages: DataFrame, per_host: int = 5, host: str = "host", position: str = "pos") -> DataFrame:
    """At most so many candidates of each host, in candidate order."""
    k = F.row_number().over(W.partitionBy(host).orderBy(position))
    return pages.withColumn("_k", k).where(F.col("_k") <= per_host).drop("_k")


def fetch_candidates(articles: DataFrame, cache: DataFrame, limit: int = 50, attempts: int = 3) -> DataFrame:
    """The newest articles whose text is not fetched and whose attempts are not used up, out of four times as many."""
    newest = articles.orderBy(F.desc_nulls_first("at"), "id").limit(4 * limit)
    c = cache.select(F.col("entity_id").alias("id"), "text", F.col("attempts").alias("tries"))
    j = newest.join(c, "id", "left").where((F.coalesce("text", F.lit("")) == "") & (F.coalesce("tries", F.lit(0)) < attempts))
    return j.select(*articles.columns).orderBy(F.desc_nulls_first("at"), "id").limit(limit)


def extraction_candidates(articles: DataFrame, limit: int = 50) -> DataFrame:
    """The newest unprocessed articles; those without title or record are dropped after the limit."""
    top = articles.where(~F.coalesce("processed", F.lit(False))).orderBy(F.desc_nulls_first("at"), "id").limit(limit)
    return top.where("title is not null and source_record is not null")


def body(articles: DataFrame, cache: DataFrame, most: int = 4000) -> DataFrame:
    """Articles with the beginning of their cached text, null if blank."""
    t = cache.select(F.col("entity_id").alias("id"), F.nullif(F.trim(F.substring("text", 1, most)), F.lit("")).alias("body"))
    return articles.join(t, "id", "left")
