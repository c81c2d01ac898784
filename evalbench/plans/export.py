"""Queries of the public analysis export: its thirteen tables, and the published folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalbench.operators import export as op
from evalbench.plans import relations as rel
from evalbench.plans.catalog import register
from evalbench.sources.shared import fresh

_METRICS = {"correctness": (7, 3, 11), "faithfulness": (5, 1, 9), "citation": (3, 1, 7), "abstention": (1, 1, 5), "hit": (1, 1, 2), "recall": (5, 1, 13), "mrr": (3, 1, 8)}


def relations(spark, d):
    """results, configs, usage and failures: each event is a question that both parse modes of one of six configurations answer."""
    e, i, x = rel.read(spark, d, "events"), F.col("event_id"), F.col("x")
    answered = e.select("*", F.explode(F.array(F.col("user_id") % 6 * 2, F.col("user_id") % 6 * 2 + 1)).alias("x"))
    metrics = [((i * a + x * b) % n / float(n - 1)).alias(m) for m, (a, b, n) in _METRICS.items()]
    results = answered.select(F.format_string("e%02d", "x").alias("experiment_id"), i.cast("string").alias("question_id"), F.col("event_type").alias("question_type"), *metrics, (F.col("value") + x).alias("latency_ms"))
    j = F.floor(F.col("id") / 2)
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    configs = spark.range(12).select(
        F.format_string("e%02d", "id").alias("experiment_id"), F.sha2(F.format_string("export-%d", "id"), 256).alias("config_hash"), pick(["standard", "enhanced"], F.col("id") % 2).alias("parse_mode"), pick(["fixed", "heading"], j % 2).alias("chunk_strategy"),
        pick(["dense", "bm25", "hybrid"], F.floor(j / 2)).alias("retriever"), (5 * (j % 2 + 1)).cast("int").alias("top_k"), F.format_string("v%d", j % 3 + 1).alias("prompt_version"), F.format_string("m%d", j % 2).alias("model_id"),
    )
    of = lambda at: pick(["retrieval", "context", "answer", "citation", "other"], at)
    failures = e.where("event_type = 'error'").select(F.format_string("e%02d", F.col("user_id") % 12).alias("experiment_id"), i.cast("string").alias("question_id"), F.substring("props", -2, 1).alias("question_type"), of(i % 5).alias("primary_label"), F.when(i % 3 == 0, of(i % 4)).alias("secondary_label"))
    return results, configs, rel.usage(spark, d), failures


def export(spark, d):
    return op.Export(*relations(spark, d), "pepper", 50, "1.10", "550000")


_CTES = f"""x as (select event_id, user_id, event_type, value, user_id % 6 * 2 + s as x from events, range(2) r(s)),
    results as (select printf('e%02d', x) as experiment_id, cast(event_id as varchar) as question_id, event_type as question_type, {', '.join(f'((event_id * {a} + x * {b}) % {n}) / {n - 1}.0::double as {m}' for m, (a, b, n) in _METRICS.items())}, value + x as latency_ms from x),
    configs as (select *, sha256('{{"config_hash":"' || config_hash || '","public_salt":"pepper"}}') as public_config_id from (select printf('e%02d', i) as experiment_id, sha256(printf('export-%d', i)) as config_hash, ['standard','enhanced'][i % 2 + 1] as parse_mode, ['fixed','heading'][(i // 2) % 2 + 1] as chunk_strategy,
        ['dense','bm25','hybrid'][i // 4 + 1] as retriever, cast(5 * ((i // 2) % 2 + 1) as integer) as top_k, printf('v%d', (i // 2) % 3 + 1) as prompt_version, printf('m%d', (i // 2) % 2) as model_id from range(12) t(i))),
    {rel.SQL['usage']}, failures as (select printf('e%02d', user_id % 12) as experiment_id, cast(event_id as varchar) as question_id, substr(props, -2, 1) as question_type, ['retrieval','context','answer','citation','other'][event_id % 5 + 1] as primary, case when event_id % 3 = 0 then ['retrieval','context','answer','citation','other'][event_id % 4 + 1] else '' end as secondary from events where event_type = 'error'),
    facts as (select * from results join configs using (experiment_id)),
""" + """    spend as (select experiment_id, operation, model_id, question_type, cached, count(*) as call_count, sum(cost) as net, count(distinct case when operation = 'generate' then question_id end) as covered from usage group by all),
    costs as (select public_config_id, operation, s.model_id, question_type, case when cached then 'cached' else 'new' end as cache_status, call_count, net as net_cost_usd, round(net * 1.10, 6) as gross_cost_usd, case when operation = 'generate' then coalesce(parse_total, 0)::double * covered / asked else 0 end as share
        from spend s join (select experiment_id, public_config_id from configs) using (experiment_id) left join (select experiment_id, sum(cost) as parse_total from usage where operation = 'parse' and not cached group by 1) using (experiment_id) left join (select experiment_id, count(*) as asked from results group by 1) using (experiment_id)),
    board as (select public_config_id, parse_mode, chunk_strategy, retriever, top_k, prompt_version, model_id, count(*) as question_count, """ + ", ".join(f"round(avg({m}), 6) as mean_{m}" for m in [*_METRICS, "latency_ms"]) + """ from facts group by all),
    points as (select public_config_id, mean_correctness as quality, coalesce(g, 0)::decimal(38,6) as gross_cost_usd from board left join (select public_config_id, sum(gross_cost_usd) as g from costs group by 1) using (public_config_id)),
    front as (select * from points a where not exists (select 1 from points b where b.quality >= a.quality and b.gross_cost_usd <= a.gross_cost_usd and (b.quality > a.quality or b.gross_cost_usd < a.gross_cost_usd)))
"""
_AXIS = "count(*) as question_count, " + ", ".join(f"round(avg({m}), 6) as mean_{m}" for m in ("correctness", "abstention", "recall", "latency_ms"))
_TABLES = {
    "leaderboard": f"select public_config_id, parse_mode, chunk_strategy, retriever, top_k, prompt_version, model_id, question_count, {', '.join(f'mean_{m}' for m in [*_METRICS, 'latency_ms'])} from board",
    "parse_paired_difference": """select sha256('{"enhanced":"' || e || '","salt":"pepper","standard":"' || s || '"}') as pair_id, chunk_strategy, retriever, top_k, prompt_version, model_id, count(*) as sample_count, round(avg(d), 6) as correctness_effect, round(avg(d) - 1.96 * stddev_samp(d) / sqrt(count(*)), 6) as ci_low, round(avg(d) + 1.96 * stddev_samp(d) / sqrt(count(*)), 6) as ci_high
        from (select a.config_hash as s, b.config_hash as e, b.correctness - a.correctness as d, chunk_strategy, retriever, top_k, prompt_version, model_id from facts a join facts b using (chunk_strategy, retriever, top_k, prompt_version, model_id, question_id) where a.parse_mode = 'standard' and b.parse_mode = 'enhanced') group by all""",
    "chunk_heatmap": f"select chunk_strategy, parse_mode, {_AXIS} from facts group by all",
    "retriever_by_type": f"select retriever, question_type, {_AXIS} from facts group by all",
    "top_k_tradeoff": f"select top_k, {_AXIS} from facts group by all",
    "prompt_abstention": f"select prompt_version, {_AXIS} from facts group by all",
    "pareto_frontier": "select public_config_id, quality, cast(gross_cost_usd as double) as gross_cost_usd, public_config_id in (select public_config_id from front) as pareto from points",
    "latency_distribution": "select public_config_id, count(*) as count, " + ", ".join(f"round(quantile_cont(latency_ms, {q}), 6) as {n}" for q, n in ((0.5, "p50_ms"), (0.95, "p95_ms"), (0.99, "p99_ms"))) + " from facts group by 1",
    "failure_taxonomy": "select public_config_id, question_type, f.primary, secondary, count(*) as count from failures f join (select experiment_id, public_config_id from configs) using (experiment_id) group by all",
    "failure_sample_plan": """select public_failure_id, public_config_id, question_type, f.primary, secondary, cast(row_number() over (order by turn, experiment_id, question_type) as integer) as inspection_order
        from (select *, row_number() over (partition by experiment_id, question_type order by public_failure_id) as turn from (select *, sha256('{"experiment":"' || experiment_id || '","question":"' || question_id || '","salt":"pepper"}') as public_failure_id from failures)) f join (select experiment_id, public_config_id from configs) using (experiment_id) order by inspection_order limit 50""",
    "cost_breakdown": "select public_config_id, operation, model_id, question_type, cache_status, call_count, cast(net_cost_usd as double) as net_cost_usd, cast(gross_cost_usd as double) as gross_cost_usd, round(cast(share as double), 3) as parse_amortized_cost_usd from costs",
    "marginal_cost_quality": "select public_config_id, quality, cast(gross_cost_usd as double) as gross_cost_usd, round(case when quality > lag(quality) over x then (gross_cost_usd::double - lag(gross_cost_usd::double) over x) / (quality - lag(quality) over x) end, 3) as marginal_usd_per_point from front window x as (order by quality, gross_cost_usd)",
    "reconciliation": "select 'reconciled' as status, cast(sum(gross_cost_usd) as double) as local_gross_usd, 550000.0::double as console_gross_usd, cast(550000 - sum(gross_cost_usd) as double) as delta_usd from costs",
}
_PLACES = {"parse_amortized_cost_usd": 3, "marginal_usd_per_point": 3}


def _with(query: str) -> str:
    return f"with {_CTES} {query}"


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and doubles rounded, as SQL engines differ in the last digits."""
    money = [f.name for f in df.schema if f.dataType.typeName() == "decimal"]
    df = df.withColumns({c: F.col(c).cast("double") for c in money})
    return df.withColumns({f.name: F.round(f.name, _PLACES.get(f.name, 6)) for f in df.schema if f.dataType.typeName() == "double" and (f.name not in money or f.name in _PLACES)})


def _table(name: str):
    def query(spark, d):
        return _plain(export(spark, d).table(name))

    register(f"x8_{name}", _with(_TABLES[name]))(query)


for _name in op.SCHEMAS:
    _table(_name)


@register("x8_published", " union all ".join(f"select '{name}' as table_name, (select count(*) from ({_with(sql)})) as parquet_rows, (select count(*) from ({_with(sql)})) as csv_rows, 0::bigint as problems" for name, sql in _TABLES.items()))
def x8_published(spark, d):
    """All tables, published and read back by both formats, and the files that differ from the manifest."""
    path = fresh(spark, "published")
    op.publish(spark, export(spark, d).tables(), path)
    problems = op.verify(spark, path).groupBy(F.regexp_extract("file", r"tables/(\\w+)\\.", 1).alias("table_name")).agg(F.count(F.lit(1)).alias("problems"))
    read = lambda schema: spark.read.schema(schema).option("header", True)
    rows = [(name, read(schema).parquet(f"{path}/tables/{name}.parquet").count(), read(schema).csv(f"{path}/tables/{name}.csv").count()) for name, schema in op.SCHEMAS.items()]
    return spark.createDataFrame(rows, "table_name string, parquet_rows long, csv_rows long").join(problems, "table_name", "left").fillna(0, ["problems"])
