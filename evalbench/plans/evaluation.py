"""Queries of answer scoring and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalbench.functions import text as tx
from evalbench.operators import order
from evalbench.operators import stats as op
from evalbench.plans import relations as rel
from evalbench.plans.catalog import register
from evalbench.plans.relations import with_sql as w


def rounded(df, **places):
    return df.select(*[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in df.columns])


#: Generated answers: the number of an event in one of several notations, against another notation.
CASES = """cases as (select event_id, case event_id % 5 when 0 then cast(event_id as varchar) || '%' when 1 then '$' || cast(event_id as varchar) when 2 then cast(event_id as varchar) || ' kg' when 3 then upper(event_type) || '!' else event_type || ' ok' end as predicted,
case event_id % 5 when 0 then printf('%.2f', event_id / 100.0) when 1 then '$' || cast(event_id as varchar) || '.0' when 2 then cast(event_id * 1000 as varchar) || 'g' else event_type end as expected, [event_type || 'ok', 'x'] as aliases from events)"""
_KEY = "regexp_replace(replace(lower({0}), 'ß', 'ss'), '[\\p{{P}}\\p{{Z}}\\s]+', '', 'g')"
_NUM = "regexp_extract(regexp_replace(lower({0}), '\\s+', '', 'g'), '^([$])?([0-9]+(?:\\.[0-9]+)?)(kg|g|%)?$', {1})"
_VAL = "case when {n2} <> '' then cast({n2} as decimal(30,8)) * case {n3} when 'kg' then 1000 when '%' then 0.01 else 1 end end"
_DIM = "case when {n1} = '$' then 'usd' when {n3} in ('kg','g') then 'mass-g' else 'scalar' end"


def _num(c):
    parts = {f"n{i}": _NUM.format(c, i) for i in (1, 2, 3)}
    return _VAL.format(**parts), _DIM.format(**parts)


_PV, _PD = _num("predicted")
_EV, _ED = _num("expected")
_MATCH = f"""matched as (select event_id, exact, num as numeric, ali as alias, exact or num or ali as correct from (select event_id, {_KEY.format('predicted')} <> '' and {_KEY.format('predicted')} = {_KEY.format('expected')} as exact,
coalesce({_PV} = {_EV} and {_PD} = {_ED}, false) as num, len(list_filter(aliases, lambda a: {_KEY.format('a')} = {_KEY.format('predicted')})) > 0 and {_KEY.format('predicted')} <> {_KEY.format('expected')} as ali from cases))"""


def cases(spark, d):
    e = rel.read(spark, d, "events")
    i, t, n = F.col("event_id"), F.col("event_type"), F.col("event_id").cast("string")
    predicted = F.when(i % 5 == 0, F.concat(n, F.lit("%"))).when(i % 5 == 1, F.concat(F.lit("$"), n)).when(i % 5 == 2, F.concat(n, F.lit(" kg"))).when(i % 5 == 3, F.concat(F.upper(t), F.lit("!"))).otherwise(F.concat(t, F.lit(" ok")))
    expected = F.when(i % 5 == 0, F.format_string("%.2f", i / 100.0)).when(i % 5 == 1, F.concat(F.lit("$"), n, F.lit(".0"))).when(i % 5 == 2, F.concat((i * 1000).cast("string"), F.lit("g"))).otherwise(t)
    return e.select("event_id", predicted.alias("predicted"), expected.alias("expected"), F.array(F.concat(t, F.lit("ok")), F.lit("x")).alias("aliases"))


@register("e1_answer_key", w("", f"select event_id, {_KEY.format('predicted')} as key from (with {CASES} select * from cases)"))
def e1(spark, d):
    return cases(spark, d).select("event_id", tx.answer_key(F.col("predicted")).alias("key"))


@register("e2_numeric_value", f"with {CASES} select event_id, cast({_PV} as double) as value, case when {_PV} is not null then {_PD} end as dimension from cases")
def e2(spark, d):
    v = cases(spark, d).select("event_id", op.numeric_value(F.col("predicted")).alias("v"))
    return v.select("event_id", F.col("v.value").cast("double").alias("value"), F.col("v.dimension").alias("dimension"))


@register("e3_answer_match", f"with {CASES}, {_MATCH} select * from matched")
def e3(spark, d):
    return op.match_answers(cases(spark, d)).select("event_id", "exact", "numeric", "alias", "correct")


#: Claims: three a question; supported by event residues; citations of the first two.
_CLAIMS = """claims as (select event_id, i as claim, (event_id + i) % 3 <> 0 as supported, ['e' || cast((event_id + i) % 4 as varchar)] as evidence, case when i < 2 then ['e' || cast(event_id % 4 as varchar), 'e1'] else [] end as cited from events, range(3) t(i) where event_id % 7 <> 0)"""


def claim_cases(spark, d):
    e = rel.read(spark, d, "events").select("event_id")
    i = F.col("event_id")
    name = lambda x: F.concat(F.lit("e"), x.cast("string"))
    claims = F.when(i % 7 != 0, F.array(*[F.struct(F.lit(f"c{k}").alias("id"), ((i + k) % 3 != 0).alias("supported"), F.array(name((i + k) % 4)).alias("evidence")) for k in range(3)])).otherwise(F.array().cast("array<struct<id:string,supported:boolean,evidence:array<string>>>"))
    citations = F.create_map(F.lit("c0"), F.array(name(i % 4), F.lit("e1")), F.lit("c1"), F.array(name(i % 4), F.lit("e1")))
    return e.select(i.alias("question_id"), claims.alias("claims"), citations.alias("citations"))


@register("e4_claim_citation_metrics", f"""with {_CLAIMS} select event_id as question_id, round(avg(cast(supported as double)), 6) as faithfulness, round(sum(len(list_filter(cited, lambda c: list_contains(evidence, c)))) / nullif(sum(len(cited)), 0), 6) as citation_precision,
round(avg(cast(list_has_any(cited, evidence) as double)), 6) as citation_recall from events left join claims using (event_id) group by event_id""")
def e4(spark, d):
    return rounded(op.claim_metrics(claim_cases(spark, d)), faithfulness=6, citation_precision=6, citation_recall=6)


_GEN = f"""{CASES}, {_MATCH}, gen as (select event_type as question_type, event_id % 3 <> 0 as answerable, event_id % 4 = 0 as abstained, case when event_id % 3 <> 0 and event_id % 4 <> 0 then cast(correct as double) end as correctness, case when event_id % 7 <> 0 then cast((event_id % 2) as double) end as faithfulness from events join matched using (event_id))"""
_GENAGG = """count(*) as questions, count(correctness) as scorable, round(avg(correctness), 6) as correctness, round(avg(faithfulness), 6) as faithfulness, round(avg(cast(abstained = (not answerable) as double)), 6) as abstention_accuracy,
round(avg(cast(not abstained as double)) filter (not answerable), 6) as false_answer_rate, round(avg(cast(abstained as double)) filter (answerable), 6) as false_abstention_rate"""


def generation(spark, d):
    m = op.match_answers(cases(spark, d)).select("event_id", "correct").join(rel.read(spark, d, "events").select("event_id", F.col("event_type").alias("question_type")), "event_id")
    i = F.col("event_id")
    answerable, abstained = i % 3 != 0, i % 4 == 0
    g = m.withColumn("answerable", answerable).withColumn("abstained", abstained).withColumn("correctness", F.when(answerable & ~abstained, F.col("correct").cast("double"))).withColumn("faithfulness", F.when(i % 7 != 0, (i % 2).cast("double")))
    return g.withColumns(op.abstention(F.col("answerable"), F.col("abstained")))


_GR = dict.fromkeys(("correctness", "faithfulness", "abstention_accuracy", "false_answer_rate", "false_abstention_rate"), 6)


@register("e5_abstention", "select event_id, cast((event_id % 4 = 0) = (event_id % 3 = 0) as double) as abstention_accuracy, cast(event_id % 3 = 0 and event_id % 4 <> 0 as double) as false_answer, cast(event_id % 3 <> 0 and event_id % 4 = 0 as double) as false_abstention from events")
def e5(spark, d):
    return generation(spark, d).select("event_id", "abstention_accuracy", "false_answer", "false_abstention")


@register("a3_generation_aggregate", f"with {_GEN} select question_type, {_GENAGG} from gen group by question_type")
def a3(spark, d):
    return rounded(op.aggregate_generation(generation(spark, d), ["question_type"]), **_GR)


@register("a3_generation_overall", f"with {_GEN} select {_GENAGG} from gen")
def a3_all(spark, d):
    return rounded(op.aggregate_generation(generation(spark, d), []), **_GR)


@register("a6_latency_percentiles", "select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from events group by event_type")
def a6(spark, d):
    return rounded(op.percentiles(rel.read(spark, d, "events"), ["event_type"], "value"), p50=6, p95=6, p99=6)


def _pairs(spark, d):
    return rel.read(spark, d, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b"))


@register("a18_cohen_kappa", "select n, round(o, 6) as observed, round(e, 6) as expected, round((o - e) / (1 - e), 6) as kappa from (select count(*) as n, avg(cast(quality = toxic as double)) as o, (avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic))) as e from labels)")
def a18(spark, d):
    return rounded(op.kappa(_pairs(spark, d)), observed=6, expected=6, kappa=6)


@register("a19_spearman", "select event_type, round(corr(ra, rb), 6) as rho from (select event_type, rank() over (partition by event_type order by value) + (count(*) over (partition by event_type, value) - 1) / 2.0 as ra, rank() over (partition by event_type order by u) + (count(*) over (partition by event_type, u) - 1) / 2.0 as rb from (select event_type, value, user_id % 17 as u from events)) group by event_type")
def a19(spark, d):
    e = rel.read(spark, d, "events").select("event_type", "value", (F.col("user_id") % 17).alias("u"))
    return rounded(op.spearman(e, ["event_type"], "value", "u"), rho=6)


_JUDGE = "judge as (select event_id, event_type as question_type, (event_id * 13 % 64) / 63.0::double as judge, greatest((event_id * 13 % 64) / 63.0::double - case when event_id % 3 = 0 then 0.2 else 0.0 end, 0.0::double) as human from events)"


def judged(spark, d):
    j = F.col("event_id") * 13 % 64 / 63.0
    return rel.read(spark, d, "events").select("event_id", F.col("event_type").alias("question_type"), j.alias("judge"), F.greatest(j - F.when(F.col("event_id") % 3 == 0, 0.2).otherwise(0.0), F.lit(0.0)).alias("human"))


_THR = "round(avg(cast((judge >= 0.5) = (human >= 0.5) as double)), 6) as agreement, count(*) filter (judge >= 0.5 and human >= 0.5) as tp, count(*) filter (judge >= 0.5 and human < 0.5) as fp, count(*) filter (judge < 0.5 and human >= 0.5) as fn"


@register("a20_threshold_f1", f"with {_JUDGE} select *, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from (select {_THR} from judge)")
def a20(spark, d):
    return rounded(op.threshold_agreement(judged(spark, d), "judge", "human", 0.5), agreement=6, f1=6)


@register("a21_judge_bias", f"with {_JUDGE} select question_type, round(avg(judge - human), 6) as bias from judge group by question_type")
def a21(spark, d):
    return judged(spark, d).groupBy("question_type").agg(F.round(F.avg(F.col("judge") - F.col("human")), 6).alias("bias"))


@register("e10_judge_calibration", f"with {_JUDGE} select n, agreement, f1, round((select corr(ra, rb) from (select rank() over (order by judge) + (count(*) over (partition by judge) - 1) / 2.0 as ra, rank() over (order by human) + (count(*) over (partition by human) - 1) / 2.0 as rb from judge)), 6) as rho, (select round(avg(judge - human), 6) from judge) as bias from (select (select count(*) from judge) as n, agreement, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from (select {_THR} from judge))")
def e10(spark, d):
    j = judged(spark, d)
    one = op.threshold_agreement(j, "judge", "human", 0.5).select(F.round("agreement", 6).alias("agreement"), F.round("f1", 6).alias("f1"))
    rho = op.spearman(j.withColumn("__g", F.lit(0)), ["__g"], "judge", "human").select(F.round("rho", 6).alias("rho"))
    n = j.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("judge") - F.col("human")), 6).alias("bias"))
    return one.join(F.broadcast(rho)).join(F.broadcast(n))


@register("a22_normal_interval", "select event_type, n, round(m, 6) as effect, round(m - coalesce(1.96 * s / sqrt(n), 0), 6) as low, round(m + coalesce(1.96 * s / sqrt(n), 0), 6) as high from (select event_type, count(*) as n, avg(value - 50) as m, stddev_samp(value - 50) as s from events group by event_type)")
def a22(spark, d):
    return rounded(op.normal_interval(rel.read(spark, d, "events").withColumn("v", F.col("value") - 50), ["event_type"], "v"), effect=6, low=6, high=6)


_BP = "bp as (select event_id as place, value as l, 50.0::double as r, user_id % 20 as cluster from events)"
_IDX = "cast('0x' || substr(md5(concat_ws(':', 7, round, draw)), 1, 8) as bigint) % {n}"


def paired(spark, d):
    return rel.read(spark, d, "events").select(F.col("event_id").alias("place"), F.col("value").alias("left"), F.lit(50.0).alias("right"), (F.col("user_id") % 20).alias("cluster"))


@register("e6_bootstrap_observations", f"with {_BP}, draws as (select round, draw, {_IDX.format(n='(select count(*) from bp)')} as place from range(200) a(round), range((select count(*) from bp)) b(draw)), means as (select round, avg(l - r) as m from draws join bp using (place) group by round) select (select round(avg(l - r), 6) from bp) as effect, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high, count(*) as rounds from means")
def e6(spark, d):
    return rounded(op.bootstrap_observations(paired(spark, d), 7, 200), effect=6, low=6, high=6)


@register("e7_bootstrap_clusters", f"with {_BP}, cl as (select cluster, sum(l - r) as s, count(*) as n, row_number() over (order by cluster) - 1 as place from bp group by cluster), draws as (select round, draw, {_IDX.format(n='(select count(*) from cl)')} as place from range(1000) a(round), range((select count(*) from cl)) b(draw)), means as (select round, sum(s) / sum(n) as m from draws join cl using (place) group by round) select (select round(sum(s) / sum(n), 6) from cl) as effect, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high, count(*) as rounds from means")
def e7(spark, d):
    return rounded(op.bootstrap_clusters(paired(spark, d), 7, 1000), effect=6, low=6, high=6)


@register("e6_bootstrap_tree")
def e6_tree(spark, d):
    """Of the observations; the rows are drawn by a tree of binomial splits, so there is no SQL."""
    sums = paired(spark, d).select("place", (F.col("left") - F.col("right")).alias("s"), F.lit(1).alias("n"))
    return rounded(op.bootstrap_tree(sums, 7, 200), effect=6, low=6, high=6)


@register("e7_bootstrap_tree")
def e7_tree(spark, d):
    """Of whole users."""
    p = paired(spark, d)
    sums = rel.read(spark, d, "events").select(F.col("event_id").alias("place"), "user_id").join(p, "place").groupBy("user_id").agg(F.sum(F.col("left") - F.col("right")).alias("s"), F.count(F.lit(1)).alias("n"))
    return rounded(op.bootstrap_tree(order.placed(sums, [], [F.col("user_id")]), 7, 1000), effect=6, low=6, high=6)


@register("e12_failure_labels", "select primary_label, count(*) as n, count(*) filter (primary_label = secondary_label) as same from (select ['retrieval','context','answer','citation','numeric','refusal','parse','judge','cost','other'][event_id % 10 + 1] as primary_label, case when event_id % 3 = 0 then ['retrieval','context','answer','citation','numeric','refusal','parse','judge','cost','other'][event_id % 7 + 1] end as secondary_label from events) group by primary_label")
def e12(spark, d):
    return failures(spark, d).groupBy("primary_label").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("primary_label") == F.col("secondary_label"), 1)).alias("same"))


LABELS = ["retrieval", "context", "answer", "citation", "numeric", "refusal", "parse", "judge", "cost", "other"]


def failures(spark, d):
    of = lambda x: F.element_at(F.array(*[F.lit(v) for v in LABELS]), (x + 1).cast("int"))
    i = F.col("event_id")
    return rel.read(spark, d, "events").select(F.format_string("e%02d", F.col("user_id") % 12).alias("experiment_id"), F.col("event_type").alias("question_type"), of(i % 10).alias("primary_label"), F.when(i % 3 == 0, of(i % 7)).alias("secondary_label"))


_REV = "reviews as (select event_id // 2 as question_id, 'r' || cast(event_id % 2 + (case when event_id % 50 = 0 then 1 else 0 end) as varchar) as reviewer_id, case when event_id % 5 = 0 then 'reject' else 'accept' end as decision from events)"


def reviews(spark, d):
    i = F.col("event_id")
    return rel.read(spark, d, "events").select(F.floor(i / 2).cast("long").alias("question_id"), F.concat(F.lit("r"), (i % 2 + F.when(i % 50 == 0, 1).otherwise(0)).cast("string")).alias("reviewer_id"), F.when(i % 5 == 0, "reject").otherwise("accept").alias("decision"))


@register("e13_adjudication", f"with {_REV} select question_id, case when count(distinct reviewer_id) <> 2 or count(*) <> 2 then 'needs_two_reviewers' when count(distinct decision) > 1 then 'needs_adjudication' else 'agreed' end as status, case when count(distinct reviewer_id) = 2 and count(*) = 2 and count(distinct decision) = 1 then min(decision) end as decision from reviews group by question_id")
def e13(spark, d):
    return op.adjudicate(reviews(spark, d))


@register("j16_two_reviewers", f"with {_REV} select a.question_id, a.reviewer_id as first, b.reviewer_id as second, a.decision = b.decision as agree from reviews a join reviews b on a.question_id = b.question_id and a.reviewer_id < b.reviewer_id")
def j16(spark, d):
    r = reviews(spark, d)
    other = r.select("question_id", F.col("reviewer_id").alias("second"), F.col("decision").alias("other"))
    return r.join(other, "question_id").where("reviewer_id < second").select("question_id", F.col("reviewer_id").alias("first"), "second", (F.col("decision") == F.col("other")).alias("agree"))
