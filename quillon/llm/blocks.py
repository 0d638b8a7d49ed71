"""Joins over blocking keys whose hot keys are split, and the pairs of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import drop_table, table

#: Rows of one key on one side that one task takes; more are cut into cells.
HOT = 20_000


def _heavy(df: DataFrame, keys: list[str], out: str, hot: int) -> DataFrame:
    n = df.groupBy(*keys).count().where(F.col("count") > hot)
    return n.select(*keys, F.ceil(F.col("count") / hot).cast("int").alias(out))


def split_join(left: DataFrame, right: DataFrame, keys: list[str], *, hot: int = HOT, alike: bool = False) -> DataFrame:
    """The inner join of two tables, with the rows of a hot key on a grid of cells.

    A key with more than ``hot`` rows on a side is cut: each row of that side
    gets one of its parts by a hash, and each row of the other side meets all
    parts.  Every pair is in exactly one cell, so no pair is lost and none is
    doubled, and no task holds more than ``hot`` rows of a key on either side.
    The table of hot keys has at most one row per ``hot`` input rows.  ``alike``
    says that both sides have the same keys, which are then counted once.
    Null keys meet nothing.
    """
    heavy = _heavy(left, keys, "_p", hot)
    other = heavy.withColumnRenamed("_p", "_q") if alike else _heavy(right, keys, "_q", hot)
    cells = heavy.withColumn("_q", F.col("_p")) if alike else heavy.join(other, keys, "full_outer")
    cells = table(cells, "hot")
    if cells.isEmpty():
        drop_table(cells)
        return left.join(right, keys)

    def laid(df: DataFrame, own: str, many: str, i: str, j: str) -> DataFrame:
        own_parts, other_parts = F.coalesce(own, F.lit(1)), F.coalesce(many, F.lit(1))
        part = F.pmod(F.xxhash64(*df.columns), own_parts).cast("int")
        return df.join(cells, keys, "left").withColumns({i: part, j: F.explode(F.sequence(F.lit(0), other_parts - 1))}).drop("_p", "_q")

    return laid(left, "_p", "_q", "_i", "_j").join(laid(right, "_q", "_p", "_j", "_i"), [*keys, "_i", "_j"]).drop("_i", "_j")


def group_pairs(groups: DataFrame, id_col: str, group_col: str, *, hot: int = HOT) -> DataFrame:
    """``(left_id, right_id)``, smaller first: the pairs of ids of one group, for results that ask for pairs.

    The number of pairs is the square of a group's size; what needs no pairs should use the groups.
    """
    g = groups.select(F.col(group_col).alias("g"), F.col(id_col).alias("left_id"))
    pairs = split_join(g, g.withColumnRenamed("left_id", "right_id"), ["g"], hot=hot, alike=True)
    return pairs.where("left_id < right_id").select("left_id", "right_id")
