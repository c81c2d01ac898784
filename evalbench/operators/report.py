"""Leaderboards, selections and cost tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exact_mean(c: str, places: int = 6) -> Column:
    """Mean of a number as decimal, rounded half up once."""
    total = F.sum(F.col(c).cast("decimal(38,12)"))
    return F.round((total / F.count(c)).cast("decimal(38,18)"), places).cast("double")


def leaderboard(results: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("questions"), *[exact_mean(m).alias(m) for m in metrics])


def ordered(board: DataFrame) -> DataFrame:
    """Place by recall, mrr (high first), latency (low first), hash."""
    w = Window.orderBy(F.col("recall").desc(), F.col("mrr").desc(), "latency_ms", "config_hash")  # one row a configuration
    return board.withColumn("place", F.row_number().over(w))


def axes(results: DataFrame, sets: list[list[str]], metrics: list[str]) -> DataFrame:
    """The same aggregates along several axes in one pass; columns outside a row's axis are null."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    return results.groupingSets(sets, *names).agg(F.count(F.lit(1)).alias("questions"), *[exact_mean(m).alias(m) for m in metrics])


def long_form(results: DataFrame, metrics: list[str], by: list[list[str]]) -> DataFrame:
    """Mean and number of each defined metric by each grouping, one row a metric."""
    ids = list(dict.fromkeys(c for s in by for c in s))
    rows = results.unpivot(ids, metrics, "metric", "value").where("value is not null")
    return rows.groupingSets([[*s, "metric"] for s in by], *ids, "metric").agg(F.count(F.lit(1)).alias("n"), exact_mean("value").alias("mean"))


def pareto(points: DataFrame, key: str, high: str, low: str) -> DataFrame:
    """Rows that no other beats: none is at least as good in both and better in one.

    Sorted by cost, a row stays if its quality is above all cheaper ones; of equal costs only the best stay.
    One row a configuration.
    """
    cheaper = Window.orderBy(low).rangeBetween(Window.unboundedPreceding, -1)
    grouped = points.groupBy(low).agg(F.max(high).alias("top"))
    front = grouped.withColumn("before", F.max("top").over(Window.orderBy(low).rowsBetween(Window.unboundedPreceding, -1))).where("before is null or top > before")
    del cheaper
    return points.join(F.broadcast(front.select(F.col(low).alias("__low"), "top")), (F.col(low) == F.col("__low")) & (F.col(high) == F.col("top"))).drop("__low", "top")


def marginal_cost(front: DataFrame, high: str, low: str) -> DataFrame:
    """Cost per point of quality over the row before, in order of quality and cost."""
    w = Window.orderBy(high, low)
    dq, dc = F.col(high) - F.lag(high).over(w), F.col(low) - F.lag(low).over(w)
    return front.withColumn("marginal", F.when(dq > 0, dc / dq))


def best_per_family(board: DataFrame, family: list[str], order: list[Column]) -> DataFrame:
    return board.withColumn("__r", F.row_number().over(Window.partitionBy(*family).orderBy(*order))).where("__r = 1").drop("__r")


def shortlist(board: DataFrame, size: int, caps: list[str]) -> DataFrame:
    """First ``size`` rows by ``place`` with at most half (rounded up) from one value of each of ``caps``.

    The two caps interact, so the choice is sequential; it runs on the driver over the leaderboard, which has
    one row a configuration.
    """
    most, taken, used = -(-size // 2), [], {c: {} for c in caps}
    for row in board.orderBy("place").collect():
        if len(taken) < size and all(used[c].get(row[c], 0) < most for c in caps):
            taken.append(row)
            for c in caps:
                used[c][row[c]] = used[c].get(row[c], 0) + 1
    return board.sparkSession.createDataFrame(taken, board.schema)


def top_three(outcomes: DataFrame) -> DataFrame:
    """The three best by quality, the third replaced by the cheapest that competes with the leader.

    ``outcomes``: id, quality, ci_low, ci_high, cost. One row a configuration.
    """
    w = Window.orderBy(F.col("quality").desc(), "id")
    ranked = outcomes.withColumn("place", F.row_number().over(w))
    leader = ranked.where("place = 1").select(F.col("ci_low").alias("least"))
    value = ranked.join(F.broadcast(leader)).where("place > 2 and ci_high >= least").agg(F.min_by("id", F.struct("cost", "place")).alias("chosen"))
    out = ranked.join(F.broadcast(value))
    return out.where((F.col("place") <= 2) | (F.col("id") == F.coalesce("chosen", F.when(F.col("place") == 3, F.col("id"))))).drop("chosen", "place").withColumn("place", F.row_number().over(w))


def cost_breakdown(usage: DataFrame, vat: str = "1.10") -> DataFrame:
    """Calls, net and gross by experiment, operation, model, question type and cache; parse cost shared among generated rows."""
    by = ["experiment_id", "operation", "model_id", "question_type", "cached"]
    net = F.sum("cost").cast("decimal(38,6)")
    rows = usage.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), net.alias("net"), F.countDistinct(F.when(F.col("operation") == "generate", F.col("question_id"))).alias("covered"))
    parse = usage.where("operation = 'parse'").groupBy("experiment_id").agg(net.alias("parse_total"))
    covered = usage.where("operation = 'generate'").groupBy("experiment_id").agg(F.countDistinct("question_id").alias("result_count"))
    out = rows.join(parse, "experiment_id", "left").join(covered, "experiment_id", "left")
    share = F.when(F.col("operation") == "generate", F.round((F.coalesce("parse_total", F.lit(0).cast("decimal(38,6)")) * F.col("covered") / F.col("result_count")).cast("decimal(38,18)"), 6))
    return out.select(*by, "calls", "net", F.round(F.col("net") * F.lit(vat).cast("decimal(4,2)"), 6).alias("gross"), share.alias("parse_share"))


def reconcile(usage: DataFrame, console: str | None, vat: str = "1.10") -> DataFrame:
    gross = F.round(F.sum("cost").cast("decimal(38,6)") * F.lit(vat).cast("decimal(4,2)"), 6)
    known = F.lit(console).cast("decimal(38,6)")
    out = usage.agg(gross.alias("gross")).withColumn("console", known).withColumn("delta", F.col("console") - F.col("gross"))
    return out.withColumn("status", F.when(F.col("console").isNull(), "not_reconciled").when(F.col("delta") == 0, "reconciled").otherwise("difference"))


def same_cohort(results: DataFrame, by: str = "experiment_id", item: str = "question_id") -> DataFrame:
    """One row: groups, and distinct item sets among them (1: all alike). Sets are compared by sums of hashes."""
    one = results.select(by, item).distinct().groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(item).cast("decimal(38,0)")).alias("h"))
    return one.agg(F.count(F.lit(1)).alias("groups"), F.countDistinct("n", "h").alias("cohorts"))


def paired_differences(results: DataFrame, left: str, right: str, metric: str) -> DataFrame:
    """question_id and both values of two experiments; a question of one side alone is an error row with a null."""
    side = lambda e, n: results.where(F.col("experiment_id") == e).select("question_id", F.col(metric).alias(n))
    return side(left, "left").join(side(right, "right"), "question_id", "full_outer")
