"""Mixing of sources to target weights.

Each document gets a hash-random key.  Within a source the documents are
ordered by it; ranges of the key with a bounded number of documents are summed
first, the sums of the ranges are added up, and the prefix sum of a document
is its range's offset plus the sum within the range.  So no source, however
large, is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm.bpe import count_tokens
from quillon.runtime import table

KEY_BITS = 52


def prefix_sums(sized: DataFrame, *, seed: int, range_rows: int) -> DataFrame:
    """``sized (doc_id, source, n_tokens)`` with ``before``, the tokens of the documents of its source ahead of it."""
    keyed = sized.withColumn("key", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "source", "doc_id"), 64 - KEY_BITS))
    ranges = sized.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / range_rows).alias("ranges"))
    keyed = keyed.join(ranges, "source").withColumn(
        "range", F.floor(F.col("key").cast("double") / float(1 << KEY_BITS) * F.col("ranges")).cast("long")
    )
    sums = keyed.groupBy("source", "range").agg(F.sum("n_tokens").alias("s"))
    over = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("source", "range", F.coalesce(F.sum("s").over(over), F.lit(0)).alias("offset"))  # a row per range_rows documents
    inner = W.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    return keyed.join(offsets, ["source", "range"]).select(
        "doc_id", "source", "n_tokens",
        (F.col("offset") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).alias("before"),
    )


def plan_mix(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per mix and source with its budget in tokens, full epochs and the rest of the budget."""
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("all_tokens"))
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    t = (
        targets.where(F.col("mix_id").isNotNull() & F.col("source").isNotNull())
        .groupBy("mix_id", "source").agg(
            F.max("size_factor").alias("size_factor"), F.sum(F.greatest(F.lit(0.0), F.coalesce("target_weight", F.lit(0.0)))).alias("weight"),
            F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"),
        )
        .withColumn("size_factor", F.max("size_factor").over(W.partitionBy("mix_id")))
        .withColumn("share", F.coalesce(F.try_divide("weight", F.sum("weight").over(W.partitionBy("mix_id"))), F.lit(0.0)))
    )
    n = F.coalesce("source_tokens", F.lit(0))
    tokens = int(total.first()[0])
    t = t.join(have, "source", "left").withColumn("budget", F.round(F.col("size_factor") * F.lit(tokens) * F.col("share")).cast("long"))
    capped = F.least("budget", n * F.greatest(F.lit(0), F.col("max_repeats")))
    return t.withColumn("take", F.greatest(F.lit(0), capped)).select(
        "mix_id", "source", "share", "max_repeats", "budget", n.alias("source_tokens"), "take",
        F.coalesce(F.floor(F.try_divide("take", n)), F.lit(0)).cast("int").alias("epochs"),
        F.coalesce(F.try_mod("take", n), F.lit(0)).alias("rest"),
    )


def mix(docs: DataFrame, targets: DataFrame, *, seed: int = 20, range_rows: int = 100_000, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The chosen documents with their repeats, and the shares reached.

    The first result has ``(mix_id, doc_id, source, n_tokens, repeats)``, a row per
    chosen document; the second ``(mix_id, source, target_share, actual_share,
    target_tokens, actual_tokens, documents, max_repeats)``, a row per mix and source.

    A source's budget is its normalised weight times ``size_factor`` times the
    tokens of all documents.  It takes whole epochs of the source and then the
    documents whose prefix sum stays below the rest; the document on the cut is
    taken if more than half of it lies below.  A budget beyond ``max_repeats``
    epochs is cut there, and the share falls short; other sources keep theirs.
    A source without documents has 0 tokens; documents of sources that no mix
    names, or of a null source, count only for the size.  A source listed twice
    in a mix adds its weights.  Documents without a token are in no mix.
    """
    sized = table(count_tokens(docs.select("doc_id", "source", "text"), folder=folder), "sized")
    plan = table(plan_mix(sized, targets), "plan")  # a row per row of targets
    placed = prefix_sums(sized.where(F.col("source").isNotNull() & (F.col("n_tokens") > 0)), seed=seed, range_rows=range_rows)
    more = (F.col("before") + F.col("n_tokens") / 2 < F.col("rest")).cast("int")
    chosen = table(
        placed.join(plan.where("take > 0").select("mix_id", "source", "epochs", "rest"), "source")
        .select("mix_id", "doc_id", "source", "n_tokens", (F.col("epochs") + more).alias("repeats"))
        .where("repeats > 0"), "chosen"
    )
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("actual"), F.count(F.lit(1)).alias("documents"))
    shares = plan.join(got, ["mix_id", "source"], "left").select(
        "mix_id", "source", F.col("share").alias("target_share"),
        F.coalesce(F.try_divide(F.coalesce("actual", F.lit(0)), F.sum("actual").over(W.partitionBy("mix_id"))), F.lit(0.0)).alias("actual_share"),
        F.col("budget").alias("target_tokens"), F.coalesce("actual", F.lit(0)).alias("actual_tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"), "max_repeats",
    )
    return chosen, shares
