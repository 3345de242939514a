"""Orders that Spark does not have: by UTF-16 code units, and places without a one-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provloom.storage import Scratch


def code_units(text: Column) -> Column:
    """A binary key that orders texts by their UTF-16 code units; Spark itself orders by UTF-8 bytes.

    The two differ where a character beyond the basic plane meets one of U+E000 to U+FFFF.
    """
    return F.encode(text, "UTF-16BE")


def code_units_of_all(texts: Column) -> Column:
    """The same for arrays: element by element, a shorter one first where it begins the longer."""
    return F.transform(texts, code_units)


def sorted_by_units(texts: Column) -> Column:
    """An array of texts in code-unit order, each once."""
    pairs = F.transform(F.array_distinct(texts), lambda t: F.named_struct(F.lit("k"), code_units(t), F.lit("t"), t))
    return F.transform(F.array_sort(pairs), lambda p: p["t"])


#: Groups up to this many have their first numbers broadcast; more are joined as Spark chooses.
FEW_GROUPS = 20_000


def numbered(rows: DataFrame, group: list[str], order: list[Column], place: str, scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with their place from 1 in each group, whatever a group's size.

    Rows are sorted over range partitions and numbered through; a group's places are counted
    from its first number, so that a large group may lie in many partitions.  Rows that
    ``order`` does not tell apart come in any order.  Keys are made before and after the shuffle
    and not moved by it; rows are moved once, for a few groups do not meet their firsts in a join by group.
    """
    keys = [F.col(c) for c in group] + order
    names = [f"_k{i}" for i in range(len(keys))]
    spread = rows.repartitionByRange(*keys).select("*", *[k.alias(n) for k, n in zip(keys, names)]).sortWithinPartitions(*names)
    numbers = spread.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    kept = scratch.keep(numbers.drop(*names), f"{name}-sorted")
    # One row a partition: bounded by the shuffle's partitions.
    before, total = [], 0
    for r in kept.groupBy("_part").count().orderBy("_part").collect():
        before.append((r["_part"], total))
        total += r["count"]
    starts = kept.sparkSession.createDataFrame(before, "_part int, _start long")
    through = kept.join(F.broadcast(starts), "_part").withColumn("_n", F.col("_at") + F.col("_start"))
    if not group:
        return through.withColumn(place, F.col("_n") + 1).select(*rows.columns, place)
    firsts = scratch.keep(through.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]).agg(F.min("_n").alias("_first")), f"{name}-firsts")
    if firsts.count() <= FEW_GROUPS:
        firsts = F.broadcast(firsts)
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)]
    return through.join(firsts, same).withColumn(place, F.col("_n") - F.col("_first") + 1).select(*rows.columns, place)


#: Severities of issues, the gravest first.
SEVERITIES = ["FATAL", "RECOVERABLE", "UNKNOWN", "UNSUPPORTED"]


def issues_in_order(issues: DataFrame) -> DataFrame:
    """``issues`` with their ``place`` from 1: by severity, code, file, lines, count and message.

    Texts are compared by code units; an absent or null file or message counts as empty, an absent or
    null number as 0; other columns stay and do not order.  Issues that agree in all seven come in any
    order.  A severity that is none of the four, or null, is refused.  No task holds all issues.
    """
    have = set(issues.columns)
    text = lambda c: code_units(F.coalesce(F.col(c), F.lit(""))) if c in have else code_units(F.lit(""))
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)) if c in have else F.lit(0).cast("long")
    place = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    grave = F.when(place > 0, place).otherwise(F.raise_error(F.concat(F.lit("no severity: "), F.coalesce("severity", F.lit("null")))).cast("long"))
    order = [grave, text("code"), text("file"), number("line_start"), number("line_end"), number("count"), text("message")]
    return numbered(issues, [], order, "place", Scratch(issues.sparkSession, "issues"), "issues")
