"""Storage and running totals for the operators of this subpackage; connected components are the session's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import components, cut  # noqa: F401


def fresh(df: DataFrame, name: str) -> str:
    """A name for a column that df doesn't have, however it spells them."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def sized(ids: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Stored ids with a broadcast hint while they are few (the default is some tens of MB); beyond that a join with them shuffles."""
    return F.broadcast(ids) if ids.count() <= rows else ids


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` up to and with each row, in the given order within each group.

    A group is not one task: rows are split into ranges of (group, order), each range is summed on its own, and the totals of
    earlier ranges (one number a range) are added. Rows that tie in every order column get their sums in any order.
    """
    ranged = cut(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range", *group).agg(F.sum(value).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    totals = totals.select(F.col("_range").alias("_range2"), "_before", *[F.col(g).alias(f"_group_{g}") for g in group])
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same: Column = F.col("_range") == F.col("_range2")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_group_{g}"))
    out = ranged.withColumn(name, F.sum(value).over(inside)).join(totals, same)
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_range2", "_before", *[f"_group_{g}" for g in group])
