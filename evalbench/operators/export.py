"""The public analysis export: one fact table, thirteen tables with declared schemas, a manifest, published at once.

Relations: configs (experiment_id, config_hash, parse_mode, chunk_strategy, retriever, top_k, prompt_version, model_id),
results (experiment_id, question_id, question_type, the METRICS, latency_ms), usage (experiment_id, question_id,
question_type, operation, model_id, cached, cost), failures (experiment_id, question_id, question_type, primary_label,
secondary_label). Public tables name a configuration or a failure by a salted hash. Configurations are few; results,
usage and failures grow, and only aggregates of them leave the executors.
"""

from __future__ import annotations

import functools
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalbench.functions import text as tx
from evalbench.operators import report
from evalbench.operators.report import exact_mean
from evalbench.sources import sinks
from evalbench.sources.shared import rewritten

METRICS = ["correctness", "faithfulness", "citation", "abstention", "hit", "recall", "mrr"]
_MEANS = ", ".join(f"mean_{m} double" for m in METRICS)
_AXIS = "question_count long, mean_correctness double, mean_abstention double, mean_recall double, mean_latency_ms double"
SCHEMAS = {
    "leaderboard": f"public_config_id string, parse_mode string, chunk_strategy string, retriever string, top_k int, prompt_version string, model_id string, question_count long, {_MEANS}, mean_latency_ms double",
    "parse_paired_difference": "pair_id string, chunk_strategy string, retriever string, top_k int, prompt_version string, model_id string, sample_count long, correctness_effect double, ci_low double, ci_high double",
    "chunk_heatmap": f"chunk_strategy string, parse_mode string, {_AXIS}",
    "retriever_by_type": f"retriever string, question_type string, {_AXIS}",
    "top_k_tradeoff": f"top_k int, {_AXIS}",
    "prompt_abstention": f"prompt_version string, {_AXIS}",
    "pareto_frontier": "public_config_id string, quality double, gross_cost_usd decimal(38,6), pareto boolean",
    "latency_distribution": "public_config_id string, count long, p50_ms double, p95_ms double, p99_ms double",
    "failure_taxonomy": "public_config_id string, question_type string, primary string, secondary string, count long",
    "failure_sample_plan": "public_failure_id string, public_config_id string, question_type string, primary string, secondary string, inspection_order int",
    "cost_breakdown": "public_config_id string, operation string, model_id string, question_type string, cache_status string, call_count long, net_cost_usd decimal(38,6), gross_cost_usd decimal(38,6), parse_amortized_cost_usd decimal(38,6)",
    "marginal_cost_quality": "public_config_id string, quality double, gross_cost_usd decimal(38,6), marginal_usd_per_point double",
    "reconciliation": "status string, local_gross_usd decimal(38,6), console_gross_usd decimal(38,6), delta_usd decimal(38,6)",
}


def public_id(salt: str, config_hash: Column) -> Column:
    return tx.canonical_hash(public_salt=F.lit(salt), config_hash=config_hash)


AXES = {"chunk_heatmap": ["chunk_strategy", "parse_mode"], "retriever_by_type": ["retriever", "question_type"], "top_k_tradeoff": ["top_k"], "prompt_abstention": ["prompt_version"]}


class Export:
    """The thirteen tables by name. What several of them need - facts, board, axes, costs, the frontier - is written once, when the first one asks."""

    def __init__(self, results: DataFrame, configs: DataFrame, usage: DataFrame, failures: DataFrame, salt: str, sample: int = 50, vat: str = "1.10", console: str | None = None):
        self.results, self.usage, self.failures, self.salt, self.sample, self.vat, self.console = results, usage, failures, salt, sample, vat, console
        self.configs = configs.withColumn("public_config_id", public_id(salt, F.col("config_hash")))
        self.of = F.broadcast(self.configs.select("experiment_id", "public_config_id"))  # a row a configuration
        self.zero = F.lit(0).cast("decimal(38,6)")

    def table(self, name: str) -> DataFrame:
        return _declared(getattr(self, f"_{'axis' if name in AXES else name}")(*([name] if name in AXES else [])), SCHEMAS[name])

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in SCHEMAS}

    @functools.cached_property
    def facts(self) -> DataFrame:
        return rewritten(self.results.join(F.broadcast(self.configs), "experiment_id"), "facts")

    @functools.cached_property
    def board(self) -> DataFrame:
        own = ["public_config_id", "parse_mode", "chunk_strategy", "retriever", "top_k", "prompt_version", "model_id"]
        means = [exact_mean(m).alias(f"mean_{m}") for m in [*METRICS, "latency_ms"]]
        return rewritten(self.facts.groupBy(*own).agg(F.count(F.lit(1)).alias("question_count"), *means), "board")

    @functools.cached_property
    def along(self) -> DataFrame:
        """Aggregates along all axes in one pass, with what each row leaves open."""
        names = list(dict.fromkeys(c for by in AXES.values() for c in by))
        means = [F.count(F.lit(1)).alias("question_count"), *[exact_mean(m).alias(f"mean_{m}") for m in ("correctness", "abstention", "recall", "latency_ms")]]
        return rewritten(self.facts.groupingSets(list(AXES.values()), *names).agg(*means, *[F.grouping(c).alias(f"__no_{c}") for c in names]), "axes")

    @functools.cached_property
    def costs(self) -> DataFrame:
        return rewritten(cost_rows(self.usage.join(self.of, "experiment_id"), self.results.join(self.of, "experiment_id"), self.vat), "costs")

    @functools.cached_property
    def points(self) -> DataFrame:
        spent = self.costs.groupBy("public_config_id").agg(F.sum("gross_cost_usd").alias("gross_cost_usd"))
        points = self.board.select("public_config_id", F.col("mean_correctness").alias("quality")).join(spent, "public_config_id", "left")
        return points.withColumn("gross_cost_usd", F.coalesce("gross_cost_usd", self.zero))

    @functools.cached_property
    def front(self) -> DataFrame:
        return rewritten(report.pareto(self.points, "public_config_id", "quality", "gross_cost_usd"), "front")

    @property
    def failed(self) -> DataFrame:
        return self.failures.join(self.of, "experiment_id").withColumns({"primary": F.col("primary_label"), "secondary": F.coalesce("secondary_label", F.lit(""))})

    def _leaderboard(self) -> DataFrame:
        return self.board

    def _axis(self, name: str) -> DataFrame:
        open_ = [F.col(c) == int(c.removeprefix("__no_") not in AXES[name]) for c in self.along.columns if c.startswith("__no_")]
        return self.along.where(reduce(lambda a, b: a & b, open_))

    def _parse_paired_difference(self) -> DataFrame:
        return parse_pairs(self.facts, self.configs, self.salt)

    def _cost_breakdown(self) -> DataFrame:
        return self.costs

    def _pareto_frontier(self) -> DataFrame:
        best = self.front.select("public_config_id", F.lit(True).alias("pareto"))
        return self.points.join(best, "public_config_id", "left").withColumn("pareto", F.coalesce("pareto", F.lit(False)))

    def _marginal_cost_quality(self) -> DataFrame:
        steps = report.marginal_cost(self.front.withColumn("cost", F.col("gross_cost_usd").cast("double")), "quality", "cost")
        return steps.withColumn("marginal_usd_per_point", F.round("marginal", 6))

    def _latency_distribution(self) -> DataFrame:
        p = F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
        slow = self.facts.groupBy("public_config_id").agg(F.count(F.lit(1)).alias("count"), p.alias("p"))
        return slow.select("public_config_id", "count", *[F.round(F.element_at("p", i + 1), 6).alias(n) for i, n in enumerate(("p50_ms", "p95_ms", "p99_ms"))])

    def _failure_taxonomy(self) -> DataFrame:
        return self.failed.groupBy("public_config_id", "question_type", "primary", "secondary").agg(F.count(F.lit(1)).alias("count"))

    def _failure_sample_plan(self) -> DataFrame:
        return failure_sample(self.failed, self.salt, self.sample)

    def _reconciliation(self) -> DataFrame:
        local = self.costs.agg(F.coalesce(F.sum("gross_cost_usd"), self.zero).alias("local_gross_usd"))
        known = F.lit(self.console).cast("decimal(38,6)")
        return local.select(F.lit("not_reconciled" if self.console is None else "reconciled").alias("status"), "local_gross_usd", known.alias("console_gross_usd"), (known - F.col("local_gross_usd")).alias("delta_usd"))


def _declared(df: DataFrame, schema: str) -> DataFrame:
    wanted = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])


def parse_pairs(facts: DataFrame, configs: DataFrame, salt: str) -> DataFrame:
    """Correctness of enhanced less standard parses of the same questions, with a 95 % interval, for configurations equal in all else; raises if their questions differ."""
    same = ["chunk_strategy", "retriever", "top_k", "prompt_version", "model_id"]
    pairs = configs.groupBy(*same).agg(*[F.max(F.when(F.col("parse_mode") == m, F.struct("experiment_id", "config_hash"))).alias(m) for m in ("standard", "enhanced")]).where("standard is not null and enhanced is not null")
    side = lambda m: facts.join(F.broadcast(pairs.select(F.col(f"{m}.experiment_id").alias("experiment_id"), F.col("standard.config_hash").alias("s"), F.col("enhanced.config_hash").alias("e"))), "experiment_id").select("s", "e", "question_id", F.col("correctness").alias(m))
    both = rewritten(side("standard").join(side("enhanced"), ["s", "e", "question_id"], "full"), "parse-pairs")
    if not both.where("standard is null or enhanced is null").isEmpty():
        raise ValueError("the two parses of a pair have different questions")
    d = F.col("enhanced") - F.col("standard")
    half = F.coalesce(1.96 * F.stddev_samp(d) / F.sqrt(F.count(d)), F.lit(0.0))
    g = both.groupBy("s", "e").agg(F.count(F.lit(1)).alias("sample_count"), F.round(F.avg(d), 6).alias("correctness_effect"), F.round(F.avg(d) - half, 6).alias("ci_low"), F.round(F.avg(d) + half, 6).alias("ci_high"))
    named = pairs.select(*same, F.col("standard.config_hash").alias("s"), F.col("enhanced.config_hash").alias("e"))
    return g.join(F.broadcast(named), ["s", "e"]).withColumn("pair_id", tx.canonical_hash(salt=F.lit(salt), standard=F.col("s"), enhanced=F.col("e")))


def cost_rows(usage: DataFrame, results: DataFrame, vat: str) -> DataFrame:
    """Calls, net and gross cost; new parse costs are shared among generated rows by the part of the results' questions that they cover."""
    net = F.sum("cost").cast("decimal(38,6)")
    by = ["public_config_id", "operation", "model_id", "question_type", "cached"]
    rows = usage.groupBy(*by).agg(F.count(F.lit(1)).alias("call_count"), net.alias("net_cost_usd"), F.count_distinct(F.when(F.col("operation") == "generate", F.col("question_id"))).alias("covered"))
    parse = usage.where("operation = 'parse' and not cached").groupBy("public_config_id").agg(net.alias("parse_total"))
    asked = results.groupBy("public_config_id").agg(F.count(F.lit(1)).alias("asked"))
    share = F.coalesce("parse_total", F.lit(0).cast("decimal(38,6)")) * F.col("covered") / F.col("asked")
    out = rows.join(parse, "public_config_id", "left").join(asked, "public_config_id", "left")
    return out.withColumns({
        "cache_status": F.when(F.col("cached"), "cached").otherwise("new"), "gross_cost_usd": F.round(F.col("net_cost_usd") * F.lit(vat).cast("decimal(4,2)"), 6),
        "parse_amortized_cost_usd": F.when((F.col("operation") == "generate") & (F.col("asked") > 0), F.round(share.cast("decimal(38,18)"), 6)).otherwise(F.lit(0).cast("decimal(38,6)")),
    })


def failure_sample(failures: DataFrame, salt: str, size: int) -> DataFrame:
    """``size`` failures, in turn from each system and question type in the order of a hash; raises if there are fewer."""
    name = tx.canonical_hash(salt=F.lit(salt), experiment=F.col("experiment_id"), question=F.col("question_id"))
    rows = failures.withColumn("public_failure_id", name)
    turn = F.row_number().over(Window.partitionBy("experiment_id", "question_type").orderBy("public_failure_id"))
    first = rows.withColumn("turn", turn).where(F.col("turn") <= size).orderBy("turn", "experiment_id", "question_type").limit(size)
    found = rewritten(first.withColumn("inspection_order", F.row_number().over(Window.orderBy("turn", "experiment_id", "question_type"))), "failure-sample")  # of ``size`` rows
    if found.count() < size:
        raise ValueError("not enough failures for the sample")
    return found


def publish(spark: SparkSession, built: dict[str, DataFrame], path: str) -> DataFrame:
    """Write the tables as Parquet and CSV into a folder beside ``path``, then its manifest, then rename it to ``path``, which must not exist.

    Returns the manifest: file (below ``path``), bytes and sha256.
    """
    of = spark._jvm.org.apache.hadoop.fs.Path
    target = of(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(target):
        raise ValueError(f"{path} is published already")
    draft = f"{path.rstrip('/')}.partial"
    system.delete(of(draft), True)
    for name, df in built.items():
        sinks.parquet(df, f"{draft}/tables/{name}.parquet")
        sinks.csv(df, f"{draft}/tables/{name}.csv")
    found = rewritten(_files(spark, draft), "manifest")
    found.coalesce(1).orderBy("file").write.json(f"{draft}/manifest")
    if system.exists(target) or not system.rename(of(draft), target):
        raise ValueError(f"{path} was published meanwhile")
    return found


def _files(spark: SparkSession, base: str) -> DataFrame:
    kept = sinks.manifest(spark, f"{base}/tables").where("path not like '%/_SUCCESS'")
    return kept.select(F.regexp_extract("path", r"/(tables/.*)$", 1).alias("file"), "bytes", "sha256")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """file and problem (missing, extra, changed) of a published export against its manifest."""
    said = spark.read.schema("file string, bytes long, sha256 string").json(f"{path}/manifest")
    have = _files(spark, path).withColumnsRenamed({"bytes": "b", "sha256": "s"})
    both = said.join(have, "file", "full")
    problem = F.when(F.col("s").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when((F.col("b") != F.col("bytes")) | (F.col("s") != F.col("sha256")), "changed")
    return both.select("file", problem.alias("problem")).where("problem is not null")
