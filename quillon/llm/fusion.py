"""One surviving record per duplicate group.

Two operators share the claims table ``(group, field, item, value, source,
grade, at)``:

* :func:`survivors` picks, field by field, the record of the best graded
  source, then the latest, then the smallest id.
* :func:`fuse` is Bayesian fusion with copy detection: accuracies of the
  sources and their dependence are estimated from the claims, the votes of
  copiers are discounted and the value with the largest posterior survives.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.runtime import drop_table, table

# Spellings that stand for "not known", lower case.
STAND_INS = (
    "", "-", "--", "—", "–", "?", "??", ".", "0", "n/a", "n.a.", "na", "n.a", "nil", "nan", "none", "null", "tbc", "tbd",
    "unknown", "not known", "not disclosed", "none given", "not given", "not available", "not provided", "not stated",
    "not applicable", "undisclosed", "unspecified", "see filing", "see above", "same as above", "as above", "pending",
    "address withheld", "withheld", "name withheld", "no fixed address", "no address", "unknown entity", "unknown person",
    "unknown company", "unknown address", "no name", "unnamed", "redacted", "various", "missing", "empty", "to be confirmed",
)
# Codes that stand for "not known" in country fields.
COUNTRY_STAND_INS = ("xx", "zz", "xxx", "zzz", "un", "und")
COUNTRY_FIELDS = ("country", "nationality", "jurisdiction", "flag")
GRADES = "ABCDEF"
#: Share of its values that a copier takes from the source it copies.
COPIED = 0.8

PAYLOAD = (
    "id string, schema string, properties map<string,array<string>>, "
    "context struct<wm_prov_source_id:string,wm_prov_retrieved_at:string,wm_prov_reliability:string,wm_prov_source_record:string>"
)


def is_real(value: Column, field: Column) -> Column:
    """Whether a value says something; null and stand-ins do not."""
    v = F.lower(F.trim(F.regexp_replace(value, r"[\s ​]+", " ")))
    bare = F.trim(F.regexp_replace(v, r"^[\[\(<{\"']+|[\]\)>}\"'.]+$", ""))
    return F.coalesce(
        ~v.isin(*STAND_INS) & ~bare.isin(*STAND_INS)
        & v.rlike(r"[\p{L}\p{N}]")  # punctuation alone
        & ~v.rlike(r"^(0[\s./-]*)+$") & ~v.rlike(r"^(x[\s./-]*){2,}$|^(9[\s./-]*){6,}$")
        & ~(field.isin(*COUNTRY_FIELDS) & bare.isin(*COUNTRY_STAND_INS)),
        F.lit(False),
    )


def claims(queue: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(item, entity_id, field, values, source, grade, at)`` of the resolved queue rows.

    One row per record and property that has a real value.  ``grade`` is 0 for A
    to 5 for F; a source without a grade counts as B, a payload without a source
    comes after F, a source that no seed lists too.  ``at`` is the instant of
    retrieval, null if missing or unreadable.  Broken payloads make no claim.
    """
    p = queue.where((F.col("status") == "resolved") & F.col("entity_id").isNotNull()).select(
        F.col("id").alias("item"), "entity_id", F.from_json("raw_entity", PAYLOAD).alias("p")
    ).where("p is not null")
    rows = p.select(
        "item", "entity_id",
        F.col("p.context.wm_prov_source_id").alias("source"),
        F.expr("try_to_timestamp(p.context.wm_prov_retrieved_at)").alias("at"),
        F.explode("p.properties").alias("field", "vs"),
    ).withColumn("values", F.filter("vs", lambda v: is_real(v, F.col("field")))).where(F.size("values") > 0)
    # the seeds are the configured sources, some dozens; one grade per source, the best if listed twice
    graded = seeds.groupBy(F.concat_ws(":", "connector_id", "natural_key").alias("source")).agg(
        F.min(F.expr(f"instr('{GRADES}', upper(trim(coalesce(reliability, 'B')))) - 1")).alias("grade")
    )
    return rows.join(graded, "source", "left").select(
        "item", "entity_id", "field", "values", "source",
        F.when(F.col("grade") >= 0, F.col("grade")).otherwise(len(GRADES)).alias("grade"), "at",
    )


def members(audit: DataFrame) -> DataFrame:
    """``(canonical_id, entity_id)`` of the merged decisions, each once."""
    merged = audit.where((F.lower(F.trim("decision")) == "merged") & F.col("canonical_id").isNotNull())
    return merged.select("canonical_id", F.explode("source_ids").alias("entity_id")).where(F.col("entity_id").isNotNull()).distinct()


def survivors(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``(canonical_id, field, queue_item_id)``: the record whose value survives.

    Order: smallest grade, latest ``at`` (null is oldest), smallest item id.
    The best record of each entity and field is found first, so a much delivered
    entity is one row a field before the join with its groups.
    """
    best = F.min(F.struct("grade", F.coalesce(-F.unix_micros("at"), F.lit(2**63 - 1)).alias("age"), "item"))
    per_entity = rows.groupBy("entity_id", "field").agg(best.alias("b"))
    return (
        per_entity.join(groups, "entity_id").groupBy("canonical_id", "field").agg(F.min("b").alias("b"))
        .select("canonical_id", "field", F.col("b.item").alias("queue_item_id"))
    )


def _votes(facts: DataFrame, acc: DataFrame, copies: DataFrame | None, n_false: int) -> DataFrame:
    """Posterior of each ``(group, field, value)``; the votes of copiers are discounted."""
    key = ["canonical_id", "field", "value"]
    weight = F.log(F.lit(float(n_false)) * F.col("acc") / (1 - F.col("acc")))
    v = facts.join(acc, "source").withColumn("w", weight)
    if copies is not None:
        # independence of a vote: the product of 1 - c * P(copy) over the better sources of the same value
        better = v.select(*key, F.col("source").alias("b"), F.col("acc").alias("ab"))
        d = (
            v.select(*key, F.col("source").alias("a"), "acc").join(better, key)
            .where((F.col("ab") > F.col("acc")) | ((F.col("ab") == F.col("acc")) & (F.col("b") < F.col("a"))))
            .join(copies, ["a", "b"])
            .groupBy(*key, F.col("a").alias("source")).agg(F.exp(F.sum(F.log(1 - COPIED * F.col("p")))).alias("own"))
        )
        v = v.join(d, [*key, "source"], "left").withColumn("w", F.col("w") * F.coalesce("own", F.lit(1.0)))
    v = v.groupBy(*key).agg(F.sum("w").alias("score"))
    best = v.groupBy("canonical_id", "field").agg(F.max("score").alias("m"))
    p = v.join(best, ["canonical_id", "field"]).withColumn("e", F.exp(F.col("score") - F.col("m")))
    z = p.groupBy("canonical_id", "field").agg((F.sum("e") + F.lit(float(n_false)) * F.exp(-F.first("m"))).alias("z"))
    return p.join(z, ["canonical_id", "field"]).select("canonical_id", "field", "value", (F.col("e") / F.col("z")).alias("posterior"))


def fuse(rows: DataFrame, groups: DataFrame, *, rounds: int = 3, n_false: int = 20, copy_prior: float = 0.1) -> DataFrame:
    """``(canonical_id, field, value, posterior)``: the value with the largest posterior.

    Each round estimates for each pair of sources the chance that one copies the
    other, scores the values by ``sum of log(n * A / (1 - A))`` over the sources
    that state them, and sets each source's accuracy ``A`` to the mean posterior
    of its values.  Shared values that are probably false are strong evidence of
    copying, shared true values weak, differing values evidence against it;
    copies are sought first, so that copied votes do not settle which values are
    true.  A vote counts less the likelier its source copies a better source
    that states the same.  Sources are the configured
    instances, so the tables per source and per pair of sources are small by
    nature; all counting is done in aggregations over all claims.
    Ties go to the smallest value; a field without a real value gives no row.
    """
    facts = table(
        rows.select("entity_id", "field", F.explode("values").alias("value"), F.coalesce("source", F.lit("")).alias("source"), "grade")
        .withColumn("value", F.lower(F.trim(F.regexp_replace("value", r"\s+", " ")))).distinct().join(groups, "entity_id")
        .groupBy("canonical_id", "field", "value", "source").agg(F.min("grade").alias("grade")), "facts"
    )
    acc = table(facts.groupBy("source").agg((0.95 - 0.1 * F.min("grade")).alias("acc")), "acc")
    copies: DataFrame | None = None
    post = table(_votes(facts, acc, copies, n_false), "post")
    ln = math.log
    for _ in range(rounds):
        scored = facts.join(post, ["canonical_id", "field", "value"])
        # pairs of sources over the same group and field; a pair's counts are pre-aggregated map-side
        both = scored.select("canonical_id", "field", F.col("source").alias("a"), F.col("value").alias("va"), "posterior").join(
            facts.select("canonical_id", "field", F.col("source").alias("b"), F.col("value").alias("vb")), ["canonical_id", "field"]
        ).where(F.col("a") != F.col("b"))
        same = F.col("va") == F.col("vb")
        counts = both.groupBy("a", "b").agg(
            F.sum(F.when(same, F.col("posterior")).otherwise(0.0)).alias("kt"),
            F.sum(F.when(same, 1 - F.col("posterior")).otherwise(0.0)).alias("kf"),
            F.sum(F.when(same, 0.0).otherwise(1.0)).alias("kd"),
        )
        c = COPIED
        a = acc.select(F.col("source").alias("a"), F.col("acc").alias("aa"))
        b = acc.select(F.col("source").alias("b"), F.col("acc").alias("ab"))
        d = counts.join(a, "a").join(b, "b")
        pt, pf = F.col("aa") * F.col("ab"), (1 - F.col("aa")) * (1 - F.col("ab")) / n_false
        pd = F.greatest(F.lit(1e-6), 1 - pt - pf)
        # log odds of "a copies b" against independence
        odds = (
            F.col("kt") * F.log((c * F.col("ab") + (1 - c) * pt) / pt)
            + F.col("kf") * F.log((c * (1 - F.col("ab")) + (1 - c) * pf) / pf)
            + F.col("kd") * F.log(F.lit(1 - c) * pd / pd)
            + ln(copy_prior / (1 - copy_prior))
        )
        copies = table(
            d.select("a", "b", (1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds))))).alias("p")).where("p > 0.01"), "copies"
        )
        old, post = post, table(_votes(facts, acc, copies, n_false), "post")
        drop_table(old)
        scored = facts.join(post, ["canonical_id", "field", "value"])
        acc = table(
            scored.groupBy("source").agg(F.least(F.lit(0.99), F.greatest(F.lit(0.05), F.avg("posterior"))).alias("acc")), "acc"
        )
    best = F.min(F.struct((-F.round("posterior", 12)).alias("least"), "value", "posterior")).alias("x")
    return post.groupBy("canonical_id", "field").agg(best).select("canonical_id", "field", "x.value", "x.posterior")
