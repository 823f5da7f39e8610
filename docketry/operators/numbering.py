"""Places of rows in the order of their group, without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docketry.session import cut_lineage

#: Bits of ``monotonically_increasing_id`` below the number of the partition.
SLICE_BITS = 33


def numbered(rows: DataFrame, keys: list[str], order: list[str], place: str = "place") -> DataFrame:
    """Rows with their place, from 0 without gaps, in ``order`` inside each group of equal ``keys``.

    Spark samples the rows and cuts their whole order into ranges of equal size, so a large group lies in many
    partitions, however its values are spread. The sorted ranges are written once; a group's rows in one range are
    consecutive there, so only their first number and their count are needed to place all of them, and what
    crosses groups is one row for each range that a group touches. Rows equal in keys and order are placed in any order.
    """
    sort = [F.asc_nulls_first(c) for c in (*keys, *order)]
    ranged = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id())
    stored = cut_lineage(ranged.withColumn("__slice", F.shiftright("__at", SLICE_BITS)), "numbered")
    parts = stored.groupBy(*keys, "__slice").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__slice").alias("__of"),
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__start"),
    )
    same = F.col("__slice") == F.col("__of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return stored.join(starts, same).select(*rows.columns, (F.col("__start") + F.col("__at")).alias(place))


def block_of(place: str, block: int) -> Column:
    """Number of the block of ``block`` consecutive places."""
    return F.expr(f"{place} div {block}")
