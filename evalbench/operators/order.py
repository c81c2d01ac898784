"""Places in a sorted order without a window over all rows of a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalbench.sources.shared import rewritten


def same(keys: list[str], other: str) -> Column:
    """Null-safe equality of ``keys`` with the columns that have ``other`` before their names."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(other + k)) for k in keys], F.lit(True))


def placed(rows: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place (from 0) among those of the same ``by`` in ``order``; rows that tie stand in any order.

    One sort by range: a number of each row's own is the last key, so a hot group and rows that tie are many ranges. A
    row's place is what comes before it in its range and in the ranges before, which is a sum of a row a range and group.
    The numbered rows are written once.
    """
    keys = [F.asc_nulls_first(k) for k in by] + [*order, F.col("__own")]
    dealt = rows.withColumn("__own", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__own")
    dealt = rewritten(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "order")
    runs = dealt.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    ahead = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = rewritten(runs.select(*[F.col(k).alias("__of_" + k) for k in by], F.col("__part").alias("__of_part"), (ahead - F.col("__first")).alias("__ahead")), "order-runs")
    met = dealt.join(runs, (F.col("__part") == F.col("__of_part")) & same(by, "__of_"))
    return met.withColumn(name, F.col("__at") + F.col("__ahead")).select(*rows.columns, name)
