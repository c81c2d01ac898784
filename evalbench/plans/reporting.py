"""Queries of leaderboards, selection, cost and budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalbench.functions import text as tx
from evalbench.operators import ledger as led
from evalbench.operators import report as op
from evalbench.plans import relations as rel
from evalbench.plans.catalog import register
from evalbench.plans.evaluation import failures, rounded
from evalbench.plans.relations import with_sql as w

METRICS = ["hit", "recall", "mrr", "latency_ms"]


def _mean(c):
    return f"cast(round(cast(sum(cast({c} as decimal(38,12))) as double) / count({c}), 6) as double) as {c}"


def star(spark, d):
    return rel.results(spark, d).join(F.broadcast(rel.configs(spark, d)), "experiment_id")


_MEANS = ", ".join(map(_mean, METRICS))
_STAR = "star as (select * from results join configs using (experiment_id))"


def _star(names, q):
    return w("results configs", q).replace("\n" + q, ",\n" + _STAR + "\n" + q)


_R5 = dict.fromkeys(METRICS, 5)


@register("j8_results_configs", w("results configs", "select parse_mode, retriever, count(*) as n from results join configs using (experiment_id) group by all"))
def j8(spark, d):
    return star(spark, d).groupBy("parse_mode", "retriever").agg(F.count(F.lit(1)).alias("n"))


@register("a4_leaderboard", _star("", "select config_hash, count(*) as questions, " + ", ".join(f"round(round(avg({m}), 6), 5) as {m}" for m in METRICS) + " from star group by config_hash"))
def a4(spark, d):
    return rounded(op.leaderboard(star(spark, d), ["config_hash"], METRICS), **_R5)


_BOARD = "board as (select experiment_id, config_hash, parse_mode, chunk_strategy, retriever, count(*) as questions, " + ", ".join(f"round(round(avg({m}), 6), 5) as {m}" for m in METRICS) + " from star group by all)"


def board(spark, d):
    return rounded(op.leaderboard(star(spark, d), ["experiment_id", "config_hash", "parse_mode", "chunk_strategy", "retriever"], METRICS), **_R5)


def _board(q):
    return _star("", q).replace("\n" + q, ",\n" + _BOARD + "\n" + q)


@register("w5_leaderboard_order", _board("select config_hash, cast(row_number() over (order by recall desc, mrr desc, latency_ms, config_hash) as integer) as place from board"))
def w5(spark, d):
    return op.ordered(board(spark, d)).select("config_hash", "place")


@register("w6_best_per_family", _board("select parse_mode, chunk_strategy, retriever, config_hash from (select *, row_number() over (partition by parse_mode, chunk_strategy, retriever order by recall desc, config_hash) as r from board) where r = 1"))
def w6(spark, d):
    return op.best_per_family(board(spark, d), ["parse_mode", "chunk_strategy", "retriever"], [F.col("recall").desc(), F.col("config_hash")]).select("parse_mode", "chunk_strategy", "retriever", "config_hash")


@register("w7_diverse_shortlist")
def w7(spark, d):
    return op.shortlist(op.ordered(board(spark, d)), 6, ["parse_mode", "retriever"]).select("config_hash", "place")


_OUT = "outcomes as (select experiment_id as id, round((hit + recall + mrr) / 3, 4) as quality, round((hit + recall + mrr) / 3, 4) - 0.01 as ci_low, round((hit + recall + mrr) / 3, 4) + 0.01 as ci_high, round(latency_ms, 3) as cost from board)"


def outcomes(spark, d):
    q = F.round((F.col("hit") + F.col("recall") + F.col("mrr")) / 3, 4)
    return board(spark, d).select(F.col("experiment_id").alias("id"), q.alias("quality"), (q - 0.01).alias("ci_low"), (q + 0.01).alias("ci_high"), F.round("latency_ms", 3).alias("cost"))


def _outcomes(q):
    return _board(q).replace("\n" + q, ",\n" + _OUT + "\n" + q)


@register("w8_generation_top3", _outcomes("""select id, cast(row_number() over (order by quality desc, id) as integer) as place from (select o.* from (select *, row_number() over (order by quality desc, id) as p from outcomes) o
where p <= 2 or id = coalesce((select arg_min(id, (cost, p)) from (select *, row_number() over (order by quality desc, id) as p from outcomes) where p > 2 and ci_high >= (select ci_low from outcomes order by quality desc, id limit 1)), case when p = 3 then id end))"""))
def w8(spark, d):
    return op.top_three(outcomes(spark, d)).select("id", "place")


@register("j10_pareto_front", _outcomes("select id, quality, cost from outcomes a where not exists (select 1 from outcomes b where b.quality >= a.quality and b.cost <= a.cost and (b.quality > a.quality or b.cost < a.cost))"))
def j10(spark, d):
    return op.pareto(outcomes(spark, d), "id", "quality", "cost").select("id", "quality", "cost")


@register("w11_marginal_cost", _outcomes("select id, round(case when quality > lag(quality) over x then (cost - lag(cost) over x) / (quality - lag(quality) over x) end, 4) as marginal from (select * from outcomes a where not exists (select 1 from outcomes b where b.quality >= a.quality and b.cost <= a.cost and (b.quality > a.quality or b.cost < a.cost))) window x as (order by quality, cost)"))
def w11(spark, d):
    return rounded(op.marginal_cost(op.pareto(outcomes(spark, d), "id", "quality", "cost"), "quality", "cost").select("id", "marginal"), marginal=4)


@register("a5_axis_aggregates", _star("", "select parse_mode, chunk_strategy, retriever, question_type, top_k, count(*) as questions, round(round(avg(hit), 6), 5) as hit, round(round(avg(recall), 6), 5) as recall from star group by grouping sets ((parse_mode, chunk_strategy), (retriever, question_type), (top_k))"))
def a5(spark, d):
    return rounded(op.axes(star(spark, d), [["parse_mode", "chunk_strategy"], ["retriever", "question_type"], ["top_k"]], ["hit", "recall"]), hit=5, recall=5)


@register("a7_failure_counts", "select experiment_id, question_type, primary_label, coalesce(secondary_label, '') as secondary_label, count(*) as n from (select printf('e%02d', user_id % 12) as experiment_id, event_type as question_type, ['retrieval','context','answer','citation','numeric','refusal','parse','judge','cost','other'][event_id % 10 + 1] as primary_label, case when event_id % 3 = 0 then ['retrieval','context','answer','citation','numeric','refusal','parse','judge','cost','other'][event_id % 7 + 1] end as secondary_label from events) group by all")
def a7(spark, d):
    return failures(spark, d).withColumn("secondary_label", F.coalesce("secondary_label", F.lit(""))).groupBy("experiment_id", "question_type", "primary_label", "secondary_label").agg(F.count(F.lit(1)).alias("n"))


@register("a8_cost_breakdown", w("usage", """select experiment_id, operation, model_id, question_type, cached, calls, cast(net as double) as net, cast(round(net * 1.10, 6) as double) as gross, case when operation = 'generate' then round(cast(coalesce(pt, 0) as double) * covered / rc, 3) end as parse_share
from (select experiment_id, operation, model_id, question_type, cached, count(*) as calls, sum(cost) as net, count(distinct case when operation = 'generate' then question_id end) as covered from usage group by all)
left join (select experiment_id, sum(cost) as pt from usage where operation = 'parse' group by 1) using (experiment_id) left join (select experiment_id, count(distinct question_id) as rc from usage where operation = 'generate' group by 1) using (experiment_id)"""))
def a8(spark, d):
    out = op.cost_breakdown(rel.usage(spark, d))
    return out.select(*[F.col(c) for c in out.columns if c not in ("net", "gross", "parse_share")], F.col("net").cast("double").alias("net"), F.col("gross").cast("double").alias("gross"), F.round(F.col("parse_share").cast("double"), 3).alias("parse_share"))


@register("a9_reconciliation", w("usage", "select cast(round(sum(cost) * 1.10, 6) as double) as gross, 550000.0::double as console, cast(550000 - round(sum(cost) * 1.10, 6) as double) as delta, 'difference' as status from usage"))
def a9(spark, d):
    return op.reconcile(rel.usage(spark, d), "550000").select(*[F.col(c).cast("double").alias(c) for c in ("gross", "console", "delta")], "status")


@register("a10_gold_aggregate", _star("", "select config_hash, question_type, metric, count(*) as n, round(avg(value), 3) as mean from (unpivot (select config_hash, question_type, hit, recall, mrr from star) on hit, recall, mrr into name metric value value) group by grouping sets ((config_hash, metric), (config_hash, question_type, metric))"))
def a10(spark, d):
    return rounded(op.long_form(star(spark, d).select("config_hash", "question_type", "hit", "recall", "mrr"), ["hit", "recall", "mrr"], [["config_hash"], ["config_hash", "question_type"]]), mean=3)


@register("a24_cohort_equality", "select count(*) as groups, count(distinct items) as cohorts from (select user_id % 6 as g, list_sort(list_distinct(list(event_id % 40))) as items from events group by 1)")
def a24(spark, d):
    e = rel.read(spark, d, "events").select((F.col("user_id") % 6).alias("experiment_id"), (F.col("event_id") % 40).alias("question_id"))
    return op.same_cohort(e)


_E = "e as (select user_id % 2 as s, event_id // 10 as q, max(value) as v from events group by all)"


def two_systems(spark, d):
    e = rel.read(spark, d, "events").groupBy((F.col("user_id") % 2).cast("string").alias("experiment_id"), F.floor(F.col("event_id") / 10).alias("question_id")).agg(F.max("value").alias("v"))
    return op.paired_differences(e, "0", "1", "v")


@register("j7_paired_systems", f"with {_E} select q as question_id, a.v as left_value, b.v as right_value from (select q, v from e where s = 0) a full join (select q, v from e where s = 1) b using (q)")
def j7(spark, d):
    return two_systems(spark, d).select("question_id", F.col("left").alias("left_value"), F.col("right").alias("right_value"))


@register("j9_parse_mode_pairs", _star("", "select chunk_strategy, question_type, round(avg(recall) filter (parse_mode = 'enhanced') - avg(recall) filter (parse_mode = 'standard'), 6) as effect from star group by all"))
def j9(spark, d):
    p = star(spark, d).groupBy("chunk_strategy", "question_type").pivot("parse_mode", ["standard", "enhanced"]).agg(F.avg("recall"))
    return p.select("chunk_strategy", "question_type", F.round(F.col("enhanced") - F.col("standard"), 6).alias("effect"))


@register("e11_gold_paired_comparison", f"with {_E} select q % 5 as kind, count(*) as n, round(avg(a.v - b.v), 6) as effect from (select q, v from e where s = 0) a join (select q, v from e where s = 1) b using (q) group by grouping sets ((q % 5), ())")
def e11(spark, d):
    pairs = two_systems(spark, d).where("left is not null and right is not null").withColumn("kind", F.col("question_id") % 5)
    return pairs.groupingSets([["kind"], []], "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("left") - F.col("right")), 6).alias("effect"))


@register("p5_public_projection", _board("select config_hash, retriever, recall from board"))
def p5(spark, d):
    return board(spark, d).select("config_hash", "retriever", "recall")


@register("p6_salted_public_id", """select doc_id, sha256('{"config_hash":"' || sha256(coalesce(text, '')) || '","public_salt":"pepper"}') as public_id from documents""")
def p6(spark, d):
    """Documents named in public by a salted hash of their content."""
    content = F.sha2(F.coalesce("text", F.lit("")), 256)
    return rel.read(spark, d, "documents").select("doc_id", tx.canonical_hash(public_salt=F.lit("pepper"), config_hash=content).alias("public_id"))


@register("x8_export_tables", _board("select 'leaderboard' as table_name, count(*) as n from board union all select 'results', count(*) from star union all select 'configs', count(*) from configs union all select 'by_type', count(*) from (select distinct experiment_id, question_type from results)"))
def x8(spark, d):
    tables = {"leaderboard": board(spark, d), "results": star(spark, d), "configs": rel.configs(spark, d), "by_type": rel.results(spark, d).select("experiment_id", "question_type").distinct()}
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("s13_leaderboard_json", _board("select cast(row_number() over (order by recall desc, mrr desc, latency_ms, config_hash) as integer) as place, config_hash, recall from board"))
def s13(spark, d):
    return op.ordered(board(spark, d)).select("place", "config_hash", "recall").orderBy("place")


# ---- prices and budgets

_PRICES = "prices as (select printf('m%d', i) as model_id, cast(0.01 as decimal(20,6)) as page_rate, cast(0.15 + i as decimal(20,6)) as in_rate, cast(0.6 + i as decimal(20,6)) as out_rate, cast(0.1 as decimal(20,6)) as embed_rate, case when i = 1 then cast(0.05 as decimal(20,6)) end as promo_rate, case when i = 1 then timestamp '2024-01-10' end as promo_end, case when i = 2 then timestamp '2024-01-01' else timestamp '2024-01-30' end as as_of from range(3) t(i))"


def prices(spark):
    i = F.col("id")
    d = lambda c: c.cast("decimal(20,6)")
    return spark.range(3).select(
        F.format_string("m%d", "id").alias("model_id"), d(F.lit("0.01")).alias("page_rate"), d(F.lit("0.15").cast("decimal(20,6)") + i).alias("in_rate"), d(F.lit("0.6").cast("decimal(20,6)") + i).alias("out_rate"), d(F.lit("0.1")).alias("embed_rate"),
        F.when(i == 1, d(F.lit("0.05"))).alias("promo_rate"), F.when(i == 1, F.lit("2024-01-10").cast("timestamp")).alias("promo_end"), F.when(i == 2, F.lit("2024-01-01").cast("timestamp")).otherwise(F.lit("2024-01-30").cast("timestamp")).alias("as_of"),
    )


_EST = """est as (select u.*, ceil((case operation when 'parse' then pages * page_rate * 1000000 when 'embed' then tokens_in * (case when ts < promo_end then coalesce(promo_rate, embed_rate) else embed_rate end) else tokens_in * in_rate + tokens_out * out_rate end)) / 1000000.0 as estimate from usage u join prices using (model_id))"""


@register("m1_price_estimate", w("usage", f"select usage_id, round(cast(estimate as double), 6) as estimate from est").replace("\nselect", f",\n{_PRICES},\n{_EST}\nselect"))
def m1(spark, d):
    return led.estimate(rel.usage(spark, d), prices(spark)).select("usage_id", F.col("estimate").cast("double").alias("estimate"))


@register("m2_staleness_gate", f"with {_PRICES} select model_id, 'stale' as blocker from prices where timestamp '2024-01-30 12:00:00' - as_of > interval 1 day union all select model_id, 'promotion_incomplete' from prices where (promo_rate is null) <> (promo_end is null)")
def m2(spark, d):
    return led.stale(prices(spark), F.lit("2024-01-30 12:00:00").cast("timestamp"))


@register("m8_projected_campaign", w("usage", "select operation, round(cast(sum(estimate) * 3 as double), 6) as projected from est group by operation").replace("\nselect", f",\n{_PRICES},\n{_EST}\nselect"))
def m8(spark, d):
    return led.estimate(rel.usage(spark, d), prices(spark)).groupBy("operation").agg((F.sum("estimate") * 3).cast("double").alias("projected"))


_LED = "ledger as (select case event_id % 4 when 0 then 'open' when 1 then 'released' else 'settled' end as state, cast(value as decimal(12,6)) as amount, user_id as account, event_id as ord from events)"


def ledger(spark, d):
    return rel.read(spark, d, "events").select(F.when(F.col("event_id") % 4 == 0, "open").when(F.col("event_id") % 4 == 1, "released").otherwise("settled").alias("state"), F.col("value").cast("decimal(12,6)").alias("amount"), F.col("user_id").alias("account"), F.col("event_id").alias("ord"))


@register("a23_budget_totals", f"with {_LED} select cast(coalesce(sum(amount) filter (state = 'settled'), 0) as double) as settled, cast(coalesce(sum(amount) filter (state = 'open'), 0) as double) as open from ledger")
def a23(spark, d):
    return led.totals(ledger(spark, d)).select(F.col("settled").cast("double").alias("settled"), F.col("open").cast("double").alias("open"))


@register("m3_reserve_replay", f"with recursive {_LED}, n as (select account, amount, row_number() over (partition by account order by ord) as r from ledger), f as (select distinct account, cast(0 as bigint) as r, cast(0 as decimal(38,6)) as spent, cast(0 as bigint) as accepted from ledger union all select n.account, n.r, case when spent + amount < 1000 then spent + amount else spent end, accepted + case when spent + amount < 1000 then 1 else 0 end from f join n on n.account = f.account and n.r = f.r + 1) select account, max(r) as requests, max(accepted) as accepted, cast(max(spent) as double) as reserved from f group by account")
def m3(spark, d):
    return led.replay(ledger(spark, d), "1000").groupBy("account").agg(F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col("accepted"), 1)).alias("accepted"), F.max("spent").cast("double").alias("reserved"))


_HIST = "hist as (select event_id // 3 as id, event_id % 3 as seq, case when event_id % 3 = 0 then 'open' when event_id % 3 = 1 then ['settled','released','reconciliation_required'][event_id % 7 % 3 + 1] else ['settled','released'][event_id % 2 + 1] end as state from events)"


def history(spark, d):
    i = F.col("event_id")
    pick = lambda v, at: F.element_at(F.array(*[F.lit(x) for x in v]), (at + 1).cast("int"))
    return rel.read(spark, d, "events").select(F.floor(i / 3).alias("id"), (i % 3).alias("seq"), F.when(i % 3 == 0, "open").when(i % 3 == 1, pick(["settled", "released", "reconciliation_required"], i % 7 % 3)).otherwise(pick(["settled", "released"], i % 2)).alias("state"))


@register("m4_reservation_states", f"with {_HIST} select state, count(*) as n from (select id, arg_max(state, seq) as state from hist group by id) group by state")
def m4(spark, d):
    return led.latest_states(history(spark, d)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@register("x2_state_transitions", f"with {_HIST} select id, seq, before, state from (select *, lag(state) over (partition by id order by seq) as before from hist) where before is not null and before || '>' || state not in ('open>settled','open>released','open>reconciliation_required','reconciliation_required>settled','reconciliation_required>released')")
def x2(spark, d):
    return led.bad_transitions(history(spark, d), led.TRANSITIONS)


@register("m5_cache_hit_accounting", w("usage", "select operation, count(*) filter (cached and cost <> 0) as violations from usage group by operation"))
def m5(spark, d):
    return rel.usage(spark, d).groupBy("operation").agg(F.count(F.when(F.col("cached") & (F.col("cost") != 0), 1)).alias("violations"))


@register("m6_dry_run_plan", "select cached_calls, new_calls, new_calls * 900 as worst_tokens, ceil(new_calls * 900 * 0.15) / 1000000.0::double as net, round(ceil(new_calls * 900 * 0.15) / 1000000.0 * 1.10, 6)::double as gross from (select count(*) filter (item_id in (select item_id from benchmark where item_id % 3 = 0)) as cached_calls, count(*) filter (item_id % 3 <> 0) as new_calls from benchmark)")
def m6(spark, d):
    q = rel.read(spark, d, "benchmark").select(F.col("item_id").alias("question_id"))
    out = led.dry_run(q, q.where("question_id % 3 = 0"), 900, "0.15")
    return out.select("cached_calls", "new_calls", "worst_tokens", F.col("net").cast("double").alias("net"), F.col("gross").cast("double").alias("gross"))


@register("m7_authorisation_gates", w("usage", "select experiment_id, unnest(list_filter([case when sum(cost) >= 40000 then 'over_budget' end, case when bool_or(not cached) then 'uncached_calls' end, case when count(distinct model_id) > 3 then 'too_many_models' end], lambda x: x is not null)) as blocker from usage group by experiment_id"))
def m7(spark, d):
    g = rel.usage(spark, d).groupBy("experiment_id").agg(F.sum("cost").alias("c"), F.bool_or(~F.col("cached")).alias("u"), F.countDistinct("model_id").alias("m"))
    rules = F.array_compact(F.array(F.when(F.col("c") >= 40000, "over_budget"), F.when(F.col("u"), "uncached_calls"), F.when(F.col("m") > 3, "too_many_models")))
    return g.select("experiment_id", F.explode(rules).alias("blocker"))


@register("a26_parse_plan_totals", "select count(*) filter (quality is null) as new_calls, cast(sum(case when quality is null then n_chars // 1000 + 1 else 0 end) as bigint) as billable_pages, cast(round(sum(case when quality is null then n_chars // 1000 + 1 else 0 end) * 0.01, 6) as double) as base_cost from documents left join labels using (doc_id)")
def a26(spark, d):
    met = rel.read(spark, d, "documents").select("doc_id", "n_chars").join(rel.read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    pages = F.when(F.col("quality").isNull(), F.floor(F.col("n_chars") / 1000) + 1).otherwise(0)
    return met.agg(F.count(F.when(F.col("quality").isNull(), 1)).alias("new_calls"), F.sum(pages).alias("billable_pages")).withColumn("base_cost", F.round(F.col("billable_pages") * 0.01, 6))


@register("a27_error_window_stop", "select user_id as run_id, min(event_id) as stop_step from (select user_id, event_id, count(*) over x as seen, count(*) filter (event_type = 'error') over x / 10.0 as s1, count(*) filter (event_type = 'signup') over x / 10.0 as s2 from events window x as (partition by user_id order by event_id rows between 9 preceding and current row)) where seen = 10 and (s1 >= 0.5 or s2 >= 0.6) group by user_id")
def a27(spark, d):
    e = rel.read(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), F.col("event_type").alias("outcome"))
    return led.error_window(e, 10, {"error": 0.5, "signup": 0.6})
