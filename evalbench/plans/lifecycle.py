"""Queries of context building, runs, caches and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalbench.functions import text as tx
from evalbench.operators import context as ctx
from evalbench.operators import lifecycle as op
from evalbench.operators import retrieval as ret
from evalbench.operators.screening import Screening
from evalbench.plans import relations as rel
from evalbench.plans.catalog import register
from evalbench.plans.relations import with_sql as w
from evalbench.plans.retrieval import _BM25, _top
from evalbench.sources.shared import fresh
from evalbench.sources.store import Store

_HITS = _top(_BM25, 10)
_NEED = "qterms postings dfs stats"


def hits(spark, d):
    """With texts and their tokens, which are counted for chunks that were found only."""
    c = rel.chunks(spark, d)
    found = ret.bm25(c, rel.questions(spark, d), 10).withColumn("score", F.round("score", 6))
    met = ret.small(found).join(c.select("chunk_id", "content"), "chunk_id")
    return met.withColumn("tokens", F.size(tx.tokens(F.col("content"))))


_CTX = f"hits as ({_HITS}), ctx as (select *, 'C' || cast(row_number() over (partition by question_id order by rank) as varchar) as citation_id from (select h.question_id, h.chunk_id, h.rank, len(terms) as tokens, sum(len(terms)) over (partition by question_id order by rank) as used from hits h join tokens using (chunk_id)) where used <= 2000)"


def _ctx(q):
    return w(_NEED, q).replace("\n" + q, ",\n" + _CTX + "\n" + q)


@register("g1_context_builder", _ctx("select question_id, chunk_id, rank, cast(tokens as bigint) as tokens, cast(used as bigint) as used, citation_id from ctx"))
def g1(spark, d):
    c = ctx.build_context(hits(spark, d), 2000)
    return c.select("question_id", "chunk_id", "rank", F.col("tokens").cast("long").alias("tokens"), "used", "citation_id")


@register("w13_budget_prefix", _ctx("select question_id, count(*) as n, cast(max(used) as bigint) as used from ctx group by question_id"))
def w13(spark, d):
    return ctx.build_context(hits(spark, d), 2000).groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.max("used").alias("used"))


@register("w14_citation_ids", _ctx("select question_id, string_agg(citation_id, ',' order by rank) as ids from ctx group by question_id"))
def w14(spark, d):
    g = ctx.build_context(hits(spark, d), 2000).groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", "citation_id"))).alias("x"))
    return g.select("question_id", F.array_join(F.transform("x", lambda x: x["citation_id"]), ",").alias("ids"))


@register("j5_hits_provenance", _ctx("select question_id, count(*) as matched from hits join chunks using (chunk_id) group by question_id"))
def j5(spark, d):
    h = ret.bm25(rel.chunks(spark, d), rel.questions(spark, d), 10)
    return h.join(rel.chunks(spark, d).select("chunk_id"), "chunk_id").groupBy("question_id").agg(F.count(F.lit(1)).alias("matched"))


@register("g2_safe_serialisation", "select page_id, md5(replace(replace(replace('{\"url\":' || to_json(url) || '}', '&', chr(92) || 'u0026'), '<', chr(92) || 'u003c'), '>', chr(92) || 'u003e')) as body from pages")
def g2(spark, d):
    return rel.read(spark, d, "pages").select("page_id", F.md5(ctx.safe_json(F.struct("url"))).alias("body"))


@register("g3_prompt_render", "select item_id, md5('Q: ' || text || ' in ' || cast(item_id as varchar)) as prompt from benchmark")
def g3(spark, d):
    return rel.read(spark, d, "benchmark").select("item_id", F.md5(ctx.render(F.lit("Q: {{question}} in {{place}}"), question=F.col("text"), place=F.col("item_id").cast("string"))).alias("prompt"))


_ANS = """ans as (select event_id, case event_id % 4 when 0 then '{"answer":"' || event_type || '","citations":["C1"],"abstained":false}' when 1 then '{"answer":"","citations":["C1"],"abstained":true}' when 2 then '{"answer":"x","citations":[],"abstained":false}' else 'not json' end as raw from events)"""


def answers(spark, d):
    i = F.col("event_id")
    good = F.concat(F.lit('{"answer":"'), F.col("event_type"), F.lit('","citations":["C1"],"abstained":false}'))
    raw = F.when(i % 8 == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(i % 4 == 0, good).when(i % 4 == 1, '{"answer":"","citations":["C1"],"abstained":true}').when(i % 4 == 2, '{"answer":"x","citations":[],"abstained":false}').otherwise("not json")
    return rel.read(spark, d, "events").select("event_id", ctx.parse_answer(raw).alias("a"))


@register("g4_answer_parse", f"with {_ANS} select event_id, json_extract_string(case when event_id % 4 <> 3 then raw end, '$.answer') as answer, cast(json_extract(case when event_id % 4 <> 3 then raw end, '$.abstained') as boolean) as abstained from ans")
def g4(spark, d):
    return answers(spark, d).select("event_id", F.col("a.answer").alias("answer"), F.col("a.abstained").alias("abstained"))


@register("g5_answer_policy", "select event_id, case event_id % 4 when 1 then 'abstained_with_citations' when 2 then 'no_citation' when 3 then 'unparsed' end as violation from events")
def g5(spark, d):
    return answers(spark, d).select("event_id", ctx.policy_violation(F.col("a")).alias("violation"))


@register("g6_citation_resolution", _ctx("select question_id, 'C9' as citation_id from questions where question_id not in (select question_id from ctx where citation_id = 'C9')"))
def g6(spark, d):
    a = rel.questions(spark, d).select("question_id", F.array(F.lit("C1"), F.lit("C9")).alias("citations"))
    return ctx.unknown_citations(a, ctx.build_context(hits(spark, d), 2000)).where("citation_id = 'C9'")


@register("g7_end_to_end_answer", _ctx("select c.question_id, left(content, 200) as answer, cast(null as varchar) as violation, c.chunk_id, c.n as cited_of from (select *, count(*) over (partition by question_id) as n from ctx) c join chunks using (chunk_id) where citation_id = 'C1'"))
def g7(spark, d):
    """Context, prompt, an offline generator that quotes the first cited chunk, parsing, policy, and the cited chunk."""
    cited = ctx.build_context(hits(spark, d), 2000)
    each = cited.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", "citation_id", "content"))).alias("x"), F.count(F.lit(1)).alias("cited_of"))  # within a budget of tokens
    shown = F.array_join(F.transform("x", lambda c: F.concat(F.lit("["), c["citation_id"], F.lit("] "), c["content"])), "\n")
    prompt = ctx.render(F.lit("Answer from:\n{{context}}\nQuestion: {{question}}"), context=shown, question=F.col("query"))
    asked = each.join(rel.questions(spark, d).select("question_id", "query"), "question_id").withColumn("prompt", prompt).where("prompt is not null")
    reply = F.to_json(F.struct(F.substring(F.col("x")[0]["content"], 1, 200).alias("answer"), F.array(F.col("x")[0]["citation_id"]).alias("citations"), F.lit(False).alias("abstained")))
    answered = asked.select("question_id", "cited_of", ctx.parse_answer(reply).alias("a"))
    found = cited.select("question_id", F.col("citation_id").alias("c"), "chunk_id")
    out = answered.withColumn("c", F.explode("a.citations")).join(found, ["question_id", "c"])
    return out.select("question_id", F.col("a.answer").alias("answer"), ctx.policy_violation(F.col("a")).alias("violation"), "chunk_id", "cited_of")


@register("g8_offline_experiment", w("evidence " + _NEED, f"select question_id, count(*) as retrieved, count(e.chunk_id) as cited from ({_HITS}) h left join evidence e using (question_id, chunk_id) group by question_id"))
def g8(spark, d):
    h = ret.bm25(rel.chunks(spark, d), rel.questions(spark, d), 10).join(rel.evidence(spark, d).withColumn("e", F.lit(1)), ["question_id", "chunk_id"], "left")
    return h.groupBy("question_id").agg(F.count(F.lit(1)).alias("retrieved"), F.count("e").alias("cited"))


@register("g10_usage_extraction", "select event_id, case when regexp_full_match(json_extract_string(props, '$.k'), '[0-9]+') then cast(json_extract_string(props, '$.k') as bigint) end as tokens from events")
def g10(spark, d):
    return rel.read(spark, d, "events").select("event_id", ctx.token_usage(F.col("props"), "k").alias("tokens"))


_GOOD = '{"correctness":0.5,"correctness_evidence_ids":["e1"],"claims":[{"claim_id":"c1","supported":true,"evidence_ids":["e1"],"rationale":"e1 shows it"},{"claim_id":"c2","supported":false,"evidence_ids":[],"rationale":"none"}],"citations":[{"citation_id":"e1","claim_ids":["c1"],"supported":true,"evidence_ids":["e1"],"rationale":"e1"}],"benchmark_defect":false,"benchmark_defect_evidence_ids":[],"rationale":"see e1."}'
#: Changes to a good answer of a judge, and the rule that each breaks: one rule a row.
_JUDGED = [
    ("", "", None),
    ('"correctness":0.5,', "", "not_strict_json"),
    ('"correctness":0.5', '"correctness":1.5', "not_strict_json"),
    ('"benchmark_defect":false', '"note":1,"benchmark_defect":false', "not_strict_json"),
    ('see e1."}', "see", "not_strict_json"),
    ('"claim_id":"c2"', '"claim_id":"c1"', "claim_coverage"),
    ('"citation_id":"e1"', '"citation_id":"e2"', "citation_coverage"),
    ('"correctness_evidence_ids":["e1"]', '"correctness_evidence_ids":["e9"]', "invented_evidence"),
    ('"claim_ids":["c1"]', '"claim_ids":["c7"]', "invented_claim"),
    ('"supported":false,"evidence_ids":[]', '"supported":false,"evidence_ids":["g1"]', "not_retrieved"),
    ('"claim_ids":["c1"]', '"claim_ids":[]', "citation_without_claim"),
    ('["c1"],"supported":true,"evidence_ids":["e1"]', '["c1"],"supported":true,"evidence_ids":["e2"]', "citation_not_its_own"),
    ('"c1","supported":true,"evidence_ids":["e1"]', '"c1","supported":true,"evidence_ids":[]', "support_without_evidence"),
    ('"correctness_evidence_ids":["e1"]', '"correctness_evidence_ids":[]', "correctness_without_evidence"),
    ('"benchmark_defect":false', '"benchmark_defect":true', "defect_without_evidence"),
    ("e1 shows it", "it shows", "evidence_not_in_rationale"),
    ("see e1.", "see e1 and x-77.", "invented_in_rationale"),
    ('"correctness_evidence_ids":["e1"]', '"correctness_evidence_ids":["e1","e1"]', "blank_or_repeated_evidence"),
    ("see e1.", "(e1)", None),
]


@register("e9_judge_parse", "select event_id, [" + ",".join("null" if p is None else f"'{p}'" for _, _, p in _JUDGED) + f"][event_id % {len(_JUDGED)} + 1] as problem from events")
def e9(spark, d):
    """The rule that each change breaks is written beside it."""
    case = F.col("event_id") % len(_JUDGED)
    raw = F.lit(_GOOD)
    for i, (old, new, _) in enumerate(_JUDGED):
        if old:
            raw = F.when(case == i, _GOOD.replace(old, new, 1)).otherwise(raw)
    names = lambda *x: F.array(*[F.lit(v) for v in x])
    problem = op.judgement_problem(F.col("raw"), names("c1", "c2"), names("e1"), names("g1"), names("e1", "e2"))
    return rel.read(spark, d, "events").select("event_id", raw.alias("raw")).select("event_id", problem.alias("problem"))


@register("e14_blind_judge_prompt", """select conv_id, turn, md5('{"question":' || to_json(text) || ',"turn":' || cast(turn as varchar) || '}') as prompt from conversations""")
def e14(spark, d):
    return rel.read(spark, d, "conversations").select("conv_id", "turn", F.md5(F.to_json(F.struct(F.col("text").alias("question"), "turn"))).alias("prompt"))


@register("p10_sensitive_keys", "select event_id, key from (select event_id, case when event_id % 9 = 0 then 'api_key' else 'k' end as key, case when event_id % 13 = 0 then '/etc/x' else props end as value from events) where regexp_matches(key, '(?i)(secret|password|token|api_?key)') or regexp_matches(value, '^(/|[A-Za-z]:\\\\)')")
def p10(spark, d):
    i = F.col("event_id")
    e = rel.read(spark, d, "events").select("event_id", F.when(i % 9 == 0, "api_key").otherwise("k").alias("key"), F.when(i % 13 == 0, "/etc/x").otherwise(F.col("props")).alias("value"))
    return ctx.sensitive_keys(e).select("event_id", "key")


@register("p1_snapshot_identity", "select count(*) as n, count(*) filter (source <> 'src1' or lang <> 'en') as mismatches from documents where source = 'src1'")
def p1(spark, d):
    return rel.read(spark, d, "documents").where("source = 'src1'").agg(F.count(F.lit(1)).alias("n"), F.count(F.when((F.col("source") != "src1") | (F.col("lang") != "en"), 1)).alias("mismatches"))


@register("p2_document_allow_list", "select doc_id from documents where source in ('src2', 'src5')")
def p2(spark, d):
    allowed = spark.createDataFrame([("src2",), ("src5",)], "source string")
    return rel.read(spark, d, "documents").join(ret.small(allowed), "source", "left_semi").select("doc_id")


@register("p7_split_gate", rel.ordered_hash_sql("(select doc_id from labels where quality = 1 and toxic = 0)", "", "doc_id", "cast(doc_id as varchar)"))
def p7(spark, d):
    return op.ordered_hash(rel.read(spark, d, "labels").where("quality = 1 and toxic = 0"), [], "doc_id", F.col("doc_id").cast("string"))


@register("p8_document_selection", "select doc_id, problem from (select unnest([1, 5, 5, 99999999]) as doc_id, 'unknown' as problem) where doc_id not in (select doc_id from documents) union all select 5, 'duplicate'")
def p8(spark, d):
    asked = spark.createDataFrame([(1,), (5,), (5,), (99999999,)], "doc_id long")
    return op.selection_problems(rel.read(spark, d, "documents").select("doc_id"), asked, "doc_id")


_E5 = "(partition by user_id, event_type order by ts desc, event_id)"


@register("s8_newest_by_key", f"select user_id, event_type, event_id from (select *, row_number() over {_E5} as r from events) where r = 1")
def s8(spark, d):
    return op.newest(rel.read(spark, d, "events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id")]).select("user_id", "event_type", "event_id")


@register("w23_newest_row", "select o_custkey, max(o_orderkey) as o_orderkey from (select *, max(o_orderdate) over (partition by o_custkey) as m from orders) where o_orderdate = m group by o_custkey")
def w23(spark, d):
    return op.newest(rel.read(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey")


@register("s9_checkpoint_export", "select doc_id, source, quality from documents join labels using (doc_id) where quality = 1 order by doc_id")
def s9(spark, d):
    return rel.read(spark, d, "documents").select("doc_id", "source").join(rel.read(spark, d, "labels").where("quality = 1").select("doc_id", "quality"), "doc_id").orderBy("doc_id")


@register("j17_runs_documents", "select source, count(*) as n from labels join documents using (doc_id) group by source")
def j17(spark, d):
    return rel.read(spark, d, "labels").join(rel.read(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@register("s16_upsert", "select doc_id, case when doc_id % 3 = 0 and doc_id < 500 then 'new' else lang end as lang from documents union all select 1000000 + doc_id, 'new' from documents where doc_id < 10")
def s16(spark, d):
    docs = rel.read(spark, d, "documents")
    base = docs.select("doc_id", "lang")
    changed = docs.where("doc_id % 3 = 0 and doc_id < 500").select("doc_id", F.lit("new").alias("lang"))
    fresh = docs.where("doc_id < 10").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("new").alias("lang"))
    return op.insert_missing(op.upsert(base, changed, ["doc_id"]), fresh, ["doc_id"])


@register("s17_idempotent_write", "select 'stored' as side, count(*) as n from documents where doc_id % 100 = 0 union all select 'computed', count(*) from documents where doc_id % 100 = 0")
def s17(spark, d):
    docs = rel.read(spark, d, "documents")
    changed = docs.select("doc_id", F.when(F.col("doc_id") % 100 == 0, "x").otherwise(F.col("lang")).alias("lang"))
    return op.differences(docs.select("doc_id", "lang"), changed).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@register("j15_missing_chunks", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def j15(spark, d):
    return op.pending(rel.read(spark, d, "documents").select("doc_id"), rel.read(spark, d, "labels"), ["doc_id"])


@register("x4_resume_completed", "select item_id from benchmark where item_id % 4 <> 1")
def x4(spark, d):
    b = rel.read(spark, d, "benchmark").select("item_id")
    return op.pending(b, b.where("item_id % 4 = 1"), ["item_id"])


@register("x5_campaign_expansion", w("configs", "select experiment_id, repetition, count(*) as questions from configs, (select unnest([1, 2, 3]) as repetition), benchmark group by all"))
def x5(spark, d):
    return op.expand(rel.configs(spark, d).select("experiment_id"), 3, rel.read(spark, d, "benchmark").select("item_id")).groupBy("experiment_id", "repetition").agg(F.count(F.lit(1)).alias("questions"))


@register("x17_gold_run", w("configs", "select experiment_id, item_id from configs, benchmark where not (item_id % 2 = 0 and experiment_id < 'e06')"))
def x17(spark, d):
    jobs = op.expand(rel.configs(spark, d).select("experiment_id"), 1, rel.read(spark, d, "benchmark").select("item_id")).drop("repetition")
    return op.pending(jobs, jobs.where("item_id % 2 = 0 and experiment_id < 'e06'"), ["experiment_id", "item_id"])


@register("x6_checkpoint_integrity", "select event_id, sha256(props) = sha256(case when event_id % 50 = 0 then props || ' ' else props end) as intact from events")
def x6(spark, d):
    stored = F.sha2(F.when(F.col("event_id") % 50 == 0, F.concat("props", F.lit(" "))).otherwise(F.col("props")), 256)
    return rel.read(spark, d, "events").select("event_id", (F.sha2("props", 256) == stored).alias("intact"))


@register("x7_invalidation_log", "select user_id, seq, place from (select user_id, event_id % 67 as seq, row_number() over (partition by user_id order by event_id % 67, event_id) as place from events) where place <> seq")
def x7(spark, d):
    from pyspark.sql.window import Window

    log = rel.read(spark, d, "events").select("user_id", (F.col("event_id") % 67).alias("seq"), "event_id")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("seq", "event_id"))
    return log.withColumn("place", place.cast("long")).where("place <> seq").select("user_id", "seq", "place")


@register("x9_response_cache", "select event_id from events where event_type = 'click' and (event_id % 3 = 0 or ts > timestamp '2024-01-15') and event_id % 10 <> 0")
def x9(spark, d):
    i = F.col("event_id")
    cache = rel.read(spark, d, "events").select("event_id", "event_type", F.when(i % 3 != 0, F.col("ts")).alias("expires_at"), F.col("props").alias("payload"), F.sha2(F.when(i % 10 == 0, "x").otherwise(F.col("props")), 256).alias("payload_hash"))
    return op.cache_hits(cache, F.col("event_type") == "click", F.lit("2024-01-15").cast("timestamp")).select("event_id")


@register("x10_vector_persist", "select vec_id from embeddings where vec_id % 25 = 0")
def x10(spark, d):
    e = rel.read(spark, d, "embeddings")
    new = e.withColumn("embedding", F.when(F.col("vec_id") % 25 == 0, F.transform("embedding", lambda x: x + 1)).otherwise(F.col("embedding")))
    return op.conflicts(e, new, "vec_id", "embedding")


@register("x12_duplicate_configs", "select sha256(coalesce(text, '')) as content_hash, count(*) as n from documents group by 1 having count(*) > 1")
def x12(spark, d):
    """Documents submitted more than once, by content."""
    return op.duplicates(rel.read(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash")), ["content_hash"])


@register("x13_frozen_inputs", rel.ordered_hash_sql("documents", "", "doc_id", "sha256(coalesce(text, ''))"))
def x13(spark, d):
    """All documents frozen in the order of their ids."""
    return op.ordered_hash(rel.read(spark, d, "documents"), [], "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256))


@register("x14_gold_completeness", w("results", """select experiment_id as config_hash, 'self_hash' as problem, count(*) as n from results where event_id % 31 = 0 group by all union all select experiment_id, 'file_name', count(*) from results where event_id % 43 = 0 group by all
union all select experiment_id, 'unknown_config', count(*) from results where experiment_id = 'e11' group by all union all select c, 'missing', (select count(distinct question_id) from results where event_id % 5 <> 0) - count(distinct case when event_id % 5 <> 0 then question_id end) from (select distinct experiment_id as c from results where experiment_id <> 'e11') left join results on experiment_id = c group by c
union all select experiment_id, 'extra', count(distinct question_id) from results where event_id % 5 = 0 and experiment_id <> 'e11' group by all"""))
def x14(spark, d):
    r, i = rel.results(spark, d), F.col("event_id")
    body = F.to_json(F.struct("hit", "recall"))
    stored = r.select(F.col("experiment_id").alias("config_hash"), F.col("question_id").alias("item_id"), body.alias("payload"), F.when(i % 31 == 0, "x").otherwise(F.sha2(body, 256)).alias("payload_hash"), F.when(i % 43 == 0, "x.json").otherwise(F.concat(F.sha2("question_id", 256), F.lit(".json"))).alias("name"))
    configs = r.select(F.col("experiment_id").alias("config_hash")).where("config_hash <> 'e11'").distinct()
    items = r.where(i % 5 != 0).select(F.col("question_id").alias("item_id")).distinct()
    return op.gold_store_problems(stored, configs, items).groupBy("config_hash", "problem").agg(F.count(F.lit(1)).alias("n"))


@register("x15_experiment_lookup", w("results", "select experiment_id, question_type, count(*) as n from results where experiment_id = 'e03' group by all"))
def x15(spark, d):
    return rel.results(spark, d).where("experiment_id = 'e03'").groupBy("experiment_id", "question_type").agg(F.count(F.lit(1)).alias("n"))


@register("x19_embedding_resume", "select label, count(*) as missing from embeddings where vec_id % 3 <> 0 group by label")
def x19(spark, d):
    e = rel.read(spark, d, "embeddings").select("vec_id", "label")
    return op.pending(e, e.where("vec_id % 3 = 0"), ["vec_id"]).groupBy("label").agg(F.count(F.lit(1)).alias("missing"))


_LOG = "log as (select user_id as run_id, event_id as seq, case event_id % 9 when 0 then 'begin' when 4 then 'interrupt' when 7 then case when event_id % 4 = 0 then 'finish' else 'begin' end else 'question' end as action, case when event_id % 9 in (0, 7) and not (event_id % 9 = 7 and event_id % 4 = 0) then event_id % 45 // 9 // 4 end as inputs, event_id % 6 as question_id from events)"


@register("x20_screening_store", f"""with {_LOG}, given as (select run_id, arg_min(inputs, seq) as g from log where action = 'begin' group by run_id), r as (select log.*, g from log join given using (run_id)),
s as (select run_id, max(seq) filter (action = 'begin' and inputs = g) as begun, max(seq) filter (action in ('interrupt', 'finish')) as stopped, arg_max(action, seq) filter (action in ('interrupt', 'finish')) as last, count(distinct question_id) filter (action = 'question') as completed, count(*) filter (action = 'begin' and inputs <> g) as collisions from r group by run_id)
select run_id, case when last is null then 'running' when last = 'finish' then 'complete' when begun > stopped then 'running' else 'interrupted' end as status, completed, collisions from s""")
def x20(spark, d):
    i = F.col("event_id")
    end = (i % 9 == 7) & (i % 4 == 0)
    action = F.when(i % 9 == 0, "begin").when(i % 9 == 4, "interrupt").when(end, "finish").when(i % 9 == 7, "begin").otherwise("question")
    log = rel.read(spark, d, "events").select(F.col("user_id").alias("run_id"), i.alias("seq"), action.alias("action"), F.when((i % 9).isin(0, 7) & ~end, F.floor(F.floor(i % 45 / 9) / 4)).alias("inputs"), (i % 6).alias("question_id"))
    return op.screening_state(log)


def _stored_runs(spark, d):
    """A run a user over their events: begun, answered but for errors, some interrupted, some of these resumed, errors of even users answered, whole runs finished."""
    e = rel.read(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").cast("string").alias("question_id"), F.col("value").alias("latency_ms"), "event_id", "event_type", "user_id")
    hits = e.select("*", F.explode(F.sequence(F.lit(0), F.col("event_id") % 3)).alias("rank")).where("rank > 0").select("run_id", "question_id", F.format_string("c%d-%d", F.col("event_id") % 97, "rank").alias("chunk_id"), F.col("rank").cast("int").alias("rank"), (1 / F.col("rank")).alias("score"), "event_type", "event_id", "user_id")
    runs = e.select("run_id", "user_id").distinct().select("run_id", "user_id", F.sha2(F.format_string("config-%d", F.col("user_id") % 12), 256).alias("config_hash"), F.lit("all").alias("question_hash"))
    asked, given, runs_of = e.select("run_id", "question_id"), ["run_id", "question_id", "latency_ms"], ["run_id", "config_hash", "question_hash"]
    s = Screening(spark, fresh(spark, "screening"))
    s.begin(runs.select(*runs_of), asked)
    s.answer(e.where("event_type <> 'error'").select(*given), hits.where("event_type <> 'error'"))
    s.interrupt(runs.where("user_id % 5 = 0").select("run_id"))
    again = "event_type = 'error' and user_id % 2 = 0 or event_id % 7 = 0 and event_type <> 'error'"
    s.begin(runs.where("user_id % 10 = 0").select(*runs_of), e.where("user_id % 10 = 0").select("run_id", "question_id"))
    s.answer(e.where(again).select(*given), hits.where(again))
    whole = runs.select("run_id").join(s.pending(), "run_id", "left_anti")
    s.finish(whole.withColumn("evaluation", F.lit("{}")))
    return s


_RUN_SQL = "select cast(user_id as varchar) as run_id, {status} as status, count(*) as expected, count(*) filter ({done}) as completed, cast(coalesce(sum(event_id % 3) filter ({done}), 0) as bigint) as hits from events group by user_id"
_DONE = "event_type <> 'error' or user_id % 2 = 0"


@register("x20_stored_runs", _RUN_SQL.format(done=_DONE, status=f"case when count(*) filter (not ({_DONE})) = 0 then 'complete' when user_id % 5 = 0 and user_id % 10 <> 0 then 'interrupted' else 'running' end"))
def x20_stored(spark, d):
    return _stored_runs(spark, d).state()


@register("x20_stored_version", _RUN_SQL.format(done="event_type <> 'error'", status="case when user_id % 5 = 0 then 'interrupted' else 'running' end"))
def x20_version(spark, d):
    """The third version, after six commits."""
    return _stored_runs(spark, d).state(3)


@register("s16_stored_upsert", "select 1 as version, lang, count(*) as n from documents group by lang union all select 2, case when doc_id % 3 = 0 then 'new' else lang end as l, count(*) from documents group by l")
def s16_stored(spark, d):
    docs = rel.read(spark, d, "documents").select("doc_id", "lang")
    s = Store(spark, fresh(spark, "upsert"), {"languages": "doc_id long, lang string"})
    s.upsert("languages", docs, ["doc_id"])
    s.upsert("languages", docs.where("doc_id % 3 = 0").withColumn("lang", F.lit("new")), ["doc_id"])
    both = [s.read("languages", v).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("version"), "lang", "n") for v in (1, 2)]
    return both[0].unionByName(both[1])


@register("s17_stored_artifacts", "select 1 as version, count(*) as n, count(distinct sha256(text)) as texts from documents where doc_id % 2 = 0 union all select 2, count(*), count(distinct sha256(text)) from documents")
def s17_stored(spark, d):
    """Artifacts by id: what is stored with the same content is left out, and an insert of nothing new makes no version."""
    docs = rel.read(spark, d, "documents").select(F.col("doc_id").alias("artifact_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    s = Store(spark, fresh(spark, "artifacts"), {"artifacts": "artifact_id long, content_hash string"})
    for part in (docs.where("artifact_id % 2 = 0"), docs, docs):
        s.insert("artifacts", part, ["artifact_id"])
    both = [s.read("artifacts", v).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("content_hash").alias("texts")).select(F.lit(v).alias("version"), "n", "texts") for v in s.versions()]
    return reduce(DataFrame.unionByName, both)


@register("x21_attempt_numbers", "select user_id, event_id, cast(row_number() over (partition by user_id order by ts, event_id) as integer) as attempt from events where event_type = 'error'")
def x21(spark, d):
    from pyspark.sql.window import Window

    return rel.read(spark, d, "events").where("event_type = 'error'").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("attempt"))


@register("x11_cost_reconciliation", "select event_id, cast(value as decimal(12,6)) <> cast(case when event_id % 40 = 0 then value + 1 else value end as decimal(12,6)) as differs from events where event_type = 'purchase'")
def x11(spark, d):
    v = F.col("value")
    stored = F.when(F.col("event_id") % 40 == 0, v + 1).otherwise(v).cast("decimal(12,6)")
    return rel.read(spark, d, "events").where("event_type = 'purchase'").select("event_id", (v.cast("decimal(12,6)") != stored).alias("differs"))


@register("set_union", "select lang as k from documents union select event_type from events")
def set_union(spark, d):
    return rel.read(spark, d, "documents").select(F.col("lang").alias("k")).unionByName(rel.read(spark, d, "events").select(F.col("event_type").alias("k"))).distinct()


@register("set_intersection", "select doc_id from documents intersect select item_id from benchmark")
def set_intersection(spark, d):
    return rel.read(spark, d, "documents").select("doc_id").intersect(rel.read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")))


@register("set_difference", "select item_id from benchmark except select doc_id from labels")
def set_difference(spark, d):
    return rel.read(spark, d, "benchmark").select("item_id").subtract(rel.read(spark, d, "labels").select(F.col("doc_id").alias("item_id")))


@register("scalar_numbers", "select doc_id, len(list_distinct(list_transform(regexp_extract_all(text, '[+-]?[0-9][0-9,]*(?:\\.[0-9]+)?'), lambda x: replace(x, ',', '')))) as n from documents")
def scalar_numbers(spark, d):
    return rel.read(spark, d, "documents").select("doc_id", F.size(tx.numbers(F.col("text"))).cast("long").alias("n"))


@register("scalar_squash_fingerprint", "select item_id, md5(regexp_replace(lower(text), '[^0-9a-z가-힣]', '', 'g')) as key from benchmark")
def scalar_squash(spark, d):
    return rel.read(spark, d, "benchmark").select("item_id", F.md5(tx.fingerprint(F.col("text"))).alias("key"))


@register("scalar_hash_index", "select event_id, cast('0x' || substr(md5(cast(event_id as varchar)), 1, 8) as bigint) % 97 as i from events")
def scalar_hash_index(spark, d):
    return rel.read(spark, d, "events").select("event_id", tx.hash_index(F.col("event_id").cast("string"), F.lit(97)).alias("i"))


_U5 = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url))"


@register("scalar_uuid5", f"select page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', cast('0x' || substr(h, 17, 1) as integer) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id from (select page_id, {_U5} as h from pages)")
def scalar_uuid5(spark, d):
    return rel.read(spark, d, "pages").select("page_id", tx.uuid5_url(F.col("url")).alias("id"))


@register("scalar_url_and_date", "select page_id, case page_id % 4 when 0 then true else false end as url_ok, case page_id % 5 when 0 then date '2024-02-29' when 1 then date '2023-12-31' end as day from pages")
def scalar_url_and_date(spark, d):
    """URLs as they are, without scheme, with a blank and without host; dates that are right, of no day, of another form and none."""
    i = F.col("page_id")
    url = F.when(i % 4 == 0, F.col("url")).when(i % 4 == 1, F.regexp_replace("url", "^[a-z]+:", "")).when(i % 4 == 2, F.concat(F.col("url"), F.lit(" x"))).otherwise("https:///path")
    day = F.when(i % 5 == 0, "2024-02-29").when(i % 5 == 1, "2023-12-31").when(i % 5 == 2, "2023-02-30").when(i % 5 == 3, "2024-2-9").otherwise("soon")
    return rel.read(spark, d, "pages").select("page_id", tx.valid_url(url).alias("url_ok"), tx.iso_date(day).alias("day"))


@register("scalar_json_freeze", """select event_id, '{"a":"' || cast(event_id as varchar) || '","k":"' || event_type || '","z":"1"}' as frozen from events""")
def scalar_json_freeze(spark, d):
    i = F.col("event_id").cast("string")
    one = F.concat(F.lit('{"z":"1", "k":"'), F.col("event_type"), F.lit('","a":"'), i, F.lit('"}'))
    two = F.concat(F.lit('{"a":"'), i, F.lit('","z":"1","k":"'), F.col("event_type"), F.lit('"}'))
    return rel.read(spark, d, "events").select("event_id", tx.frozen(F.when(F.col("event_id") % 2 == 0, one).otherwise(two)).alias("frozen"))


@register("scalar_retry_after", "select event_id, case event_id % 5 when 0 then cast(event_id % 60 as double) when 1 then greatest(0, cast(event_id % 300 as double) - 100) when 2 then 1.5 end as wait from events")
def scalar_retry_after(spark, d):
    """Seconds, HTTP dates from 100 seconds before now on, fractions, and texts that are neither."""
    i, now = F.col("event_id"), F.lit("2024-03-01 00:00:00").cast("timestamp")
    dated = F.concat(F.lit("Fri, "), F.date_format(F.timestamp_seconds(now.cast("long") - 100 + i % 300), "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    value = F.when(i % 5 == 0, (i % 60).cast("string")).when(i % 5 == 1, dated).when(i % 5 == 2, "1.5").when(i % 5 == 3, "later").otherwise("-3")
    return rel.read(spark, d, "events").select("event_id", tx.retry_after(value, now).alias("wait"))


@register("scalar_time", "select event_id, strftime(ts, '%Y%m%d') as stamp, epoch(timestamp '2024-01-31') - epoch(date_trunc('second', ts)) > 86400 as old from events")
def scalar_time(spark, d):
    return rel.read(spark, d, "events").select("event_id", F.date_format("ts", "yyyyMMdd").alias("stamp"), ((F.lit("2024-01-31").cast("timestamp").cast("long") - F.date_trunc("second", "ts").cast("long")) > 86400).alias("old"))
