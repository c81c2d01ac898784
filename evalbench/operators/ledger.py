"""Prices, budgets and the usage ledger. Money is decimal from end to end and rounded once."""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def estimate(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each call, rounded up at 6 places. ``prices``: model_id, page_rate, in_rate, out_rate, embed_rate, promo_rate, promo_end."""
    d = lambda c: F.col(c).cast("decimal(20,6)")
    million = F.lit(1000000).cast("decimal(20,0)")
    embed = F.when(F.col("ts") < F.col("promo_end"), F.coalesce("promo_rate", "embed_rate")).otherwise(F.col("embed_rate"))
    raw = (
        F.when(F.col("operation") == "parse", d("pages") * d("page_rate"))
        .when(F.col("operation") == "embed", d("tokens_in") * embed.cast("decimal(20,6)") / million)
        .otherwise((d("tokens_in") * d("in_rate") + d("tokens_out") * d("out_rate")) / million)
    )
    return usage.join(F.broadcast(prices), "model_id").withColumn("estimate", F.ceil(raw.cast("decimal(38,12)"), F.lit(6)).cast("decimal(38,6)"))  # a price book: one row a model


def stale(prices: DataFrame, now: Column) -> DataFrame:
    """Blockers of a price book: older than a day, promotion without its end or rate."""
    age = now.cast("long") - F.col("as_of").cast("long")
    rules = {"stale": age > 86400, "promotion_incomplete": F.col("promo_rate").isNull() != F.col("promo_end").isNull()}
    return prices.select("model_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("blocker"))


def totals(ledger: DataFrame) -> DataFrame:
    """Settled and open sums; 0 for none. ``ledger``: state, amount."""
    part = lambda s: F.coalesce(F.sum(F.when(F.col("state") == s, F.col("amount"))), F.lit(0)).cast("decimal(38,6)")
    return ledger.agg(part("settled").alias("settled"), part("open").alias("open"))


def replay(requests: DataFrame, cap: str) -> DataFrame:
    """Requests (account, ord, amount) in order, with what the account has reserved after each and whether it was accepted.

    A request that would reach the cap is rejected and reserves nothing, so a later, smaller one may fit. As each
    answer depends on the ones before, an account is read in order by one task, row by row: its requests are sorted
    by Spark and never held together.
    """
    kind = requests.schema["amount"].dataType.simpleString()
    limit = Decimal(cap)

    def run(batches):
        account, spent = object(), Decimal(0)
        for batch in batches:
            sums, accepted = [], []
            for a, amount in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if a != account:
                    account, spent = a, Decimal(0)
                ok = amount is not None and spent + amount < limit
                spent += amount if ok else 0
                sums.append(spent)
                accepted.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.decimal128(38, 6)), pa.array(accepted, pa.bool_())], ["account", "ord", "amount", "spent", "accepted"])

    types = [requests.schema[c].dataType.simpleString() for c in ("account", "ord")]
    rows = requests.select("account", "ord", "amount").repartition("account").sortWithinPartitions("account", "ord")
    return rows.mapInArrow(run, f"account {types[0]}, ord {types[1]}, amount {kind}, spent decimal(38,6), accepted boolean")


TRANSITIONS = {"open": {"settled", "released", "reconciliation_required"}, "reconciliation_required": {"settled", "released"}, "settled": set(), "released": set()}


def latest_states(history: DataFrame, key: str = "id") -> DataFrame:
    return history.groupBy(key).agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))


def bad_transitions(history: DataFrame, allowed: dict[str, set[str]], key: str = "id") -> DataFrame:
    """Steps of a state history that the machine does not have."""
    rows = history.withColumn("before", F.lag("state").over(Window.partitionBy(key).orderBy("seq"))).where("before is not null")
    pairs = [f"{a}>{b}" for a, bs in allowed.items() for b in bs]
    return rows.where(~F.concat_ws(">", "before", "state").isin(*pairs)).select(key, "seq", "before", "state")


def dry_run(questions: DataFrame, cache: DataFrame, tokens_each: int, price_in: str, vat: str = "1.10") -> DataFrame:
    """Cached and new calls, worst-case tokens and cost."""
    met = questions.join(cache.select("question_id").distinct().withColumn("hit", F.lit(True)), "question_id", "left")
    new = F.count(F.when(F.col("hit").isNull(), 1))
    out = met.agg(F.count("hit").alias("cached_calls"), new.alias("new_calls")).withColumn("worst_tokens", F.col("new_calls") * tokens_each)
    net = F.ceil((F.col("worst_tokens").cast("decimal(20,0)") * F.lit(price_in).cast("decimal(12,6)") / 1000000).cast("decimal(38,12)"), F.lit(6)).cast("decimal(38,6)")
    return out.withColumn("net", net).withColumn("gross", F.round(F.col("net") * F.lit(vat).cast("decimal(4,2)"), 6))


def error_window(outcomes: DataFrame, size: int, thresholds: dict[str, float]) -> DataFrame:
    """First step at which the share of an outcome in the last ``size`` reaches its threshold, by run."""
    w = Window.partitionBy("run_id").orderBy("step").rowsBetween(-(size - 1), 0)
    out = outcomes.withColumn("seen", F.count(F.lit(1)).over(w))
    stop = F.lit(False)
    for name, at in thresholds.items():
        out = out.withColumn(f"share_{name}", F.sum((F.col("outcome") == name).cast("double")).over(w) / size)
        stop = stop | (F.col(f"share_{name}") >= at)
    return out.where((F.col("seen") == size) & stop).groupBy("run_id").agg(F.min("step").alias("stop_step"))
