"""Queries of tokenizers, planners, sources, sinks and gates; those without SQL depend on order or on hashes of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalbench.functions import text as tx
from evalbench.functions import tokenizer
from evalbench.operators import curate, gates, lifecycle
from evalbench.operators import ledger as led
from evalbench.plans import relations as rel
from evalbench.plans.catalog import register
from evalbench.sources import files, sinks
from evalbench.sources.shared import fresh as folder
from evalbench.streaming import ledger, runner


def _vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@register("c7_token_encode")
def c7(spark, d):
    ids = tokenizer.encode(F.col("text"), *_vocabulary())
    return rel.read(spark, d, "benchmark").select("item_id", F.size(ids).alias("n_tokens"))


@register("c8_safe_token_windows")
def c8(spark, d):
    w = tokenizer.windows(F.col("text"), *_vocabulary(), 64, 16)
    return rel.read(spark, d, "benchmark").select("item_id", F.posexplode(w).alias("ordinal", "w")).select("item_id", "ordinal", "w.token_start", "w.token_end")


def _windows(spark, d):
    i = F.col("doc_id")
    return rel.read(spark, d, "documents").select(F.format_string("w%06d", i).alias("window_id"), F.col("source").alias("document_id"), (i % 9).alias("page"))


QUOTAS = {"fact": 30, "numeric": 20, "summary": 10}


@register("b10_generation_plan")
def b10(spark, d):
    return curate.plan_jobs(_windows(spark, d), QUOTAS, 5, 2)


@register("b11_replacement_plan")
def b11(spark, d):
    first = curate.plan_jobs(_windows(spark, d), QUOTAS, 5, 2).where("ordinal % 4 <> 0")
    return curate.plan_replacements(first, _windows(spark, d), QUOTAS, 5, 2)


@register("e8_bootstrap_input_hash", rel.ordered_hash_sql("events", "", "event_id", "cast(event_id as varchar) || ':' || cast(cast(value as decimal(18,6)) as varchar)"))
def e8(spark, d):
    line = F.concat_ws(":", F.col("event_id").cast("string"), F.col("value").cast("decimal(18,6)").cast("string"))
    return lifecycle.ordered_hash(rel.read(spark, d, "events"), [], "event_id", line)


@register("s2_chunk_dataset", "select source as document_id, count(*) as n from documents group by source")
def s2(spark, d):
    path = folder(spark, "chunks")
    rel.chunks(spark, d).select("chunk_id", "document_id", "content", F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit("p").alias("parse_snapshot"), F.lit("s").alias("strategy")).write.json(path)
    return files.chunk_dataset(spark, path).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


@register("s6_sealed_source", "select count(*) as lines from benchmark")
def s6(spark, d):
    path = folder(spark, "sealed")
    rel.read(spark, d, "benchmark").coalesce(1).write.json(path)
    one = sinks.manifest(spark, path).where("path like '%.json'").first()
    return files.sealed_lines(spark, one["path"], one["sha256"]).agg(F.count(F.lit(1)).alias("lines"))


@register("s12_immutable_sink", "select count(*) as n, true as same from benchmark")
def s12(spark, d):
    base, b = folder(spark, "immutable"), rel.read(spark, d, "benchmark")
    first, second = sinks.immutable_json(b, base), sinks.immutable_json(b.orderBy(F.col("item_id").desc()), base)
    return spark.read.json(first).agg(F.count(F.lit(1)).alias("n")).withColumn("same", F.lit(first == second))


@register("s15_export_manifest", "select * from (values ('region', 64), ('nation', 64)) t(table_name, hash_length)")
def s15(spark, d):
    base = folder(spark, "export")
    sinks.parquet(rel.read(spark, d, "region"), f"{base}/region")
    sinks.csv(rel.read(spark, d, "nation"), f"{base}/nation")
    return sinks.manifest(spark, base).groupBy(F.regexp_extract("path", r"/(region|nation)/", 1).alias("table_name")).agg(F.min(F.length("sha256")).alias("hash_length"))


@register("x3_question_runner", "select user_id as run_id, count(*) filter (event_id < coalesce(stop_step, 9223372036854775807)) as answered from events left join (select user_id, min(event_id) as stop_step from (select user_id, event_id, count(*) over x as seen, count(*) filter (event_type = 'error') over x / 10.0 as s1 from events window x as (partition by user_id order by event_id rows between 9 preceding and current row)) where seen = 10 and s1 >= 0.5 group by user_id) using (user_id) group by user_id")
def x3(spark, d):
    e = rel.read(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.col("event_type").alias("outcome"))
    stop = led.error_window(e, 10, {"error": 0.5})
    return e.join(stop, "run_id", "left").groupBy("run_id").agg(F.count(F.when(F.col("stop_step").isNull() | (F.col("step") < F.col("stop_step")), 1)).alias("answered"))


_X3 = """with e as (select cast(user_id as varchar) as run_id, event_id as step, case event_type when 'error' then 'schema' when 'signup' then 'provider' else 'ok' end as outcome from events),
    seen as (select *, count(*) over x as n, count(*) filter (outcome = 'schema') over x as s, count(*) filter (outcome = 'provider') over x as p from e window x as (partition by run_id order by step rows between 9 preceding and current row)),
    stops as (select run_id, min(step) as stop_step, arg_min(case when s >= 4 then 'schema_error_threshold' else 'provider_error_threshold' end, step) as reason from seen where n = 10 and outcome <> 'ok' and (s >= 4 or p >= 5) group by run_id)
select run_id, max(step) as step, case when any_value(stop_step) is null then 'running' else 'stopped' end as status, any_value(reason) as reason, any_value(stop_step) as stop_step,
    count(*) filter (outcome = 'ok' and (stop_step is null or step < stop_step)) as answered, count(*) filter (outcome <> 'ok' and (stop_step is null or step <= stop_step)) as failed, count(*) filter (step > stop_step) as skipped
from e left join stops using (run_id) group by run_id"""


@register("x3_streamed_runs", _X3)
def x3_streamed(spark, d):
    """All events as outcomes, in four parts; the stream stops after each and starts again from its checkpoint."""
    e = rel.read(spark, d, "events")
    outcome = F.when(F.col("event_type") == "error", "schema").when(F.col("event_type") == "signup", "provider").otherwise("ok")
    rows = e.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("step"), outcome.alias("outcome"))
    low, high = rows.agg(F.min("step"), F.max("step")).first()
    source, out, checkpoint = folder(spark, "outcomes"), folder(spark, "runs"), folder(spark, "checkpoint")
    width = ((high or 0) - (low or 0)) // 4 + 1
    for part in range(4):
        rows.where(F.floor((F.col("step") - (low or 0)) / width) == part).write.mode("append").parquet(source)
        stream = runner.run_states(spark.readStream.schema(rows.schema).parquet(source), 10, 0.4, 0.5)
        ledger.run_once(stream, out, checkpoint)
    return lifecycle.newest(spark.read.schema(runner.ROWS).parquet(out), ["run_id"], [F.col("step").desc()])


@register("c2_canonical_ids", """select item_id, sha256('{"item":"' || cast(item_id as varchar) || '","text":' || cast(to_json(text) as varchar) || '}') as id from benchmark""")
def c2_ids(spark, d):
    return rel.read(spark, d, "benchmark").select("item_id", tx.canonical_hash(item=F.col("item_id").cast("string"), text=F.col("text")).alias("id"))


def _json(rows, path):
    rows.write.json(path)


@register("s3_source_windows", "select count(*) as windows, count(distinct doc_id % 9) as pages, cast(sum(length(text)) as bigint) as characters from documents")
def s3(spark, d):
    path, i = folder(spark, "windows"), F.col("doc_id")
    page = (i % 9).cast("int")
    _json(rel.read(spark, d, "documents").select(F.format_string("w%06d", i).alias("window_id"), F.col("source").alias("document_id"), page.alias("page_start"), page.alias("page_end"), F.col("text").alias("content")), path)
    return files.source_windows(spark, path).agg(F.count(F.lit(1)).alias("windows"), F.count_distinct("page_start").alias("pages"), F.sum(F.length("content")).alias("characters"))


@register("s4_parse_checkpoints", "select doc_id as document_id, idx, idx + 1 as page, substr(text, idx * 10 + 1, 10) as content from documents, range(0, 3) r(idx) where doc_id % 4 <> 0")
def s4(spark, d):
    path, i = folder(spark, "checkpoints"), F.col("doc_id")
    element = lambda k: F.struct(F.lit(k + 1).alias("page"), F.lit("paragraph").alias("category"), F.substring("text", k * 10 + 1, 10).alias("content"))
    rows = rel.read(spark, d, "documents").select(i.cast("string").alias("document_id"), F.sha2("text", 256).alias("source_sha256"), F.lit(3).alias("expected_pages"), F.lit("standard").alias("mode"), F.when(i % 4 == 0, "failed").otherwise("succeeded").alias("status"), F.array(*[element(k) for k in range(3)]).alias("elements"))
    _json(rows, path)
    done = files.checkpoints(spark, path).where("status = 'succeeded'")
    return files.elements(done).select(F.col("document_id").cast("long").alias("document_id"), F.col("idx").cast("long").alias("idx"), F.col("page").cast("long").alias("page"), "content")


@register("s5_analysis_bundle", "select 'nation' as collection, count(*) as n, cast(sum(n_nationkey) as bigint) as keys from nation union all select 'region', 2 * count(*), cast(2 * sum(r_regionkey) as bigint) from region")
def s5(spark, d):
    """Two bundles: nations in one of them, regions in both."""
    base = folder(spark, "bundle")
    table = lambda name, key, text: rel.read(spark, d, name).agg(F.collect_list(F.struct(F.col(key).cast("long").alias("key"), F.col(text).alias("name"))).alias(name))  # noqa: E731  (25 and 5 rows)
    regions, nations = table("region", "r_regionkey", "r_name"), table("nation", "n_nationkey", "n_name")
    regions.join(nations).coalesce(1).write.json(f"{base}/a")
    regions.withColumn("nation", F.array().cast("array<struct<key:bigint,name:string>>")).coalesce(1).write.json(f"{base}/b")
    found = files.bundle(spark, [f"{base}/a", f"{base}/b"], {"nation": "key:bigint,name:string", "region": "key:bigint,name:string"})
    count = lambda name: found[name].agg(F.lit(name).alias("collection"), F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"))
    return count("nation").unionByName(count("region"))


@register("s10_parquet_sink", "select o_orderkey, o_orderstatus from orders")
def s10(spark, d):
    path = f"{folder(spark, 'parquet')}/orders"
    sinks.parquet(rel.read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path)
    return spark.read.parquet(path)


@register("s11_csv_sink", "select cast(n_nationkey as varchar) as n_nationkey, n_name, cast(cast(n_nationkey as decimal(12,6)) / 8 as decimal(12,6))::varchar as share from nation")
def s11(spark, d):
    path = f"{folder(spark, 'csv')}/nation"
    share = (F.col("n_nationkey").cast("decimal(12,6)") / 8).cast("decimal(12,6)")
    sinks.csv(rel.read(spark, d, "nation").select("n_nationkey", "n_name", share.alias("share")), path)
    return spark.read.option("header", True).csv(path)


_MANIFEST = """
version: "1"
documents:
  - {document_id: law, pages: 120, language: ko}
  - {document_id: tax, pages: 95, language: ko}
  - document_id: health
    pages: 230
    language: en
"""
_CONFIG = """
name: first try
output_dir: /runs/one
retriever: hybrid
rrf: {k: 60}
top_k: 5
"""


@register("s1_yaml_manifest", "select * from (values ('law', 120, 'ko'), ('tax', 95, 'ko'), ('health', 230, 'en')) t(document_id, pages, language)")
def s1(spark, d):
    return files.yaml_rows(spark, _MANIFEST, "documents", "document_id string, pages int, language string")


@register("s7_yaml_config", "select 'hybrid' as retriever, 5 as top_k, 60 as rrf_k")
def s7(spark, d):
    c = files.yaml_mapping(_CONFIG)
    return spark.createDataFrame([(c["retriever"], c["top_k"], c["rrf"]["k"])], "retriever string, top_k int, rrf_k int")


@register("x1_semantic_config_hash", """select sha256('{"retriever":"hybrid","rrf":{"k":60},"top_k":5}') as config_hash, true as same_under_another_name""")
def x1(spark, d):
    c = files.yaml_mapping(_CONFIG)
    one, two = gates.semantic_hash(c), gates.semantic_hash({**c, "name": "second", "output_dir": "/else"})
    return spark.createDataFrame([(one, one == two)], "config_hash string, same_under_another_name boolean")


@register("p9_search_bounds", "select item_id, case when trim(q) = '' then 'blank_query' when length(q) > 10000 then 'long_query' when k < 1 or k > 100 then 'top_k' end as problem from (select item_id, case when item_id % 7 = 0 then '  ' when item_id % 11 = 0 then repeat('x', 10001) else text end as q, item_id % 13 * 10 as k from benchmark)")
def p9(spark, d):
    i = F.col("item_id")
    q = F.when(i % 7 == 0, "  ").when(i % 11 == 0, F.repeat(F.lit("x"), 10001)).otherwise(F.col("text"))
    return rel.read(spark, d, "benchmark").select("item_id", gates.search_problem(q, i % 13 * 10).alias("problem"))


@register("b16_campaign_hash", """select sha256('{"allow_reduced_scope":' || case when reduced then 'true' else 'false' end || ',"initial_plan_hash":"' || sha256('plan') || '","max_replacement_rounds":' || cast(rounds as varchar) || '}') as campaign_hash, rounds from (values (0, false), (2, false), (2, true)) t(rounds, reduced)""")
def b16(spark, d):
    rows = spark.createDataFrame([(0, False), (2, False), (2, True)], "rounds int, reduced boolean")
    return rows.select(gates.campaign_hash(F.sha2(F.lit("plan"), 256), F.col("rounds"), F.col("reduced")).alias("campaign_hash"), "rounds")


@register("b17_gold_access_gate", "select * from (values ('1', true, 'evaluate-gold', null), ('0', true, 'evaluate-gold', 'environment'), (null, true, 'evaluate-gold', 'environment'), ('1', false, 'evaluate-gold', 'not_explicit'), ('1', true, 'export', 'command')) t(allowed, explicit, command, refusal)")
def b17(spark, d):
    rows = [("1", True, "evaluate-gold"), ("0", True, "evaluate-gold"), (None, True, "evaluate-gold"), ("1", False, "evaluate-gold"), ("1", True, "export")]
    return spark.createDataFrame([(*r, gates.gold_refusal(*r)) for r in rows], "allowed string, explicit boolean, command string, refusal string")


@register("x18_gold_dry_run", "select 3 as config_count, count(*) as item_count, 5 as metric_count, 1000 as bootstrap_resamples from benchmark")
def x18(spark, d):
    """Counts only: no item, path or answer."""
    return rel.read(spark, d, "benchmark").agg(F.lit(3).alias("config_count"), F.count(F.lit(1)).alias("item_count"), F.lit(5).alias("metric_count"), F.lit(1000).alias("bootstrap_resamples"))
