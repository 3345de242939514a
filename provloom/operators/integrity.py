"""Declarative checks: each returns its violations as rows (check, source, missing)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dangling(check: str, rows: DataFrame, source: str, target: str, universe: DataFrame, key: str) -> DataFrame:
    """References whose target is in no row of the universe."""
    lost = rows.where(F.col(target).isNotNull()).join(universe.select(F.col(key).alias(target)).distinct(), target, "left_anti")
    return lost.select(F.lit(check).alias("check"), F.col(source).cast("string").alias("source"), F.col(target).cast("string").alias("missing"))


def all_violations(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def unequal_registries(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): what only one of two registries has."""
    a, b = (x.select(key).distinct().withColumn(n, F.lit(True)) for x, n in ((left, "_l"), (right, "_r")))
    side = F.when(F.col("_r").isNull(), "left").otherwise("right")
    return a.join(b, key, "full_outer").where("_l is null or _r is null").select(key, side.alias("side"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def conflicts(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Keys with different contents; null is a content of its own."""
    return rows.withColumn("_c", F.to_json(F.struct(content))).groupBy(key).agg(F.min("_c").alias("_a"), F.max("_c").alias("_b")).where("_a <> _b").select(key)


def unsorted_pairs(rows: DataFrame, group: str, position: str, value: str) -> DataFrame:
    """Rows whose value is less than the one before it in the group."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(position))
    return rows.withColumn("before", before).where(F.col("before") > F.col(value)).select(group, position, "before", value)
