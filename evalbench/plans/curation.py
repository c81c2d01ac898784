"""Queries of benchmark building."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalbench.functions import text as tx
from evalbench.operators import curate as op
from evalbench.operators import validation as val
from evalbench.plans import relations as rel
from evalbench.plans.catalog import register
from evalbench.sources.shared import rewritten as checkpoint


_SQ = "regexp_replace(lower({0}), '[^0-9a-z가-힣]', '', 'g')"
_CAND = "cand as (select doc_id as candidate_id, source as document_id, doc_id % 6 as page, 'k' || cast(doc_id % 5 as varchar) as chunk_id, substr(text, 1, 30) as quote from documents), wnd as (select document_id, page, chunk_id, min(content) as content from (select source as document_id, doc_id % 5 as page, 'k' || cast(doc_id % 4 as varchar) as chunk_id, text as content from documents where doc_id % 2 = 0) group by all)"


def candidates(spark, d):
    docs = rel.read(spark, d, "documents")
    i = F.col("doc_id")
    c = docs.select(i.alias("candidate_id"), F.col("source").alias("document_id"), (i % 6).alias("page"), F.concat(F.lit("k"), (i % 5).cast("string")).alias("chunk_id"), F.substring("text", 1, 30).alias("quote"))
    w = docs.where("doc_id % 2 = 0").select(F.col("source").alias("document_id"), (i % 5).alias("page"), F.concat(F.lit("k"), (i % 4).cast("string")).alias("chunk_id"), F.col("text").alias("content"))
    return c, w.groupBy("document_id", "page", "chunk_id").agg(F.min("content").alias("content"))


_B1 = f"with {_CAND} select candidate_id, case when p.page is null then 'impossible_page' when w.content is null then 'impossible_chunk' when not contains({_SQ.format('w.content')}, {_SQ.format('quote')}) then 'evidence_not_found' end as rule from cand c left join (select distinct document_id, page from wnd) p on p.document_id = c.document_id and p.page = c.page left join wnd w on w.document_id = c.document_id and w.page = c.page and w.chunk_id = c.chunk_id"


@register("b1_evidence_rules", _B1)
def b1(spark, d):
    return op.evidence_rules(*candidates(spark, d))


@register("j11_spans_windows_units", f"with {_CAND} select c.document_id, count(*) as n from cand c join wnd w on w.document_id = c.document_id and w.page = c.page and w.chunk_id = c.chunk_id group by c.document_id")
def j11(spark, d):
    c, w = candidates(spark, d)
    return c.join(w, ["document_id", "page", "chunk_id"]).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


@register("b13_candidate_provenance", f"with {_CAND} select candidate_id from cand c where not exists (select 1 from wnd w where w.document_id = c.document_id and w.page = c.page and w.chunk_id = c.chunk_id)")
def b13(spark, d):
    c, w = candidates(spark, d)
    return c.join(w, ["document_id", "page", "chunk_id"], "left_anti").select("candidate_id")


_TOKS = "list_filter(regexp_extract_all(lower({0}), '[0-9a-z가-힣]+'), lambda t: length(t) >= 2)"
_BI = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
_NUMS = "list_distinct(list_transform(regexp_extract_all({0}, '[+-]?[0-9][0-9,]*(?:\\.[0-9]+)?'), lambda x: replace(x, ',', '')))"
_QA = "qa as (select doc_id, substr(text, 1, 60) as question, case doc_id % 4 when 0 then substr(text, 5, 20) when 1 then '12,345 and ' || cast(doc_id as varchar) when 2 then substr(text, 100, 40) else 'nothing like it' end as answer, substr(text, 80, 200) as quote, case when doc_id % 2 = 0 then 'fact' else 'summary' end as kind from documents)"


def qa(spark, d):
    i = F.col("doc_id")
    answer = F.when(i % 4 == 0, F.substring("text", 5, 20)).when(i % 4 == 1, F.concat(F.lit("12,345 and "), i.cast("string"))).when(i % 4 == 2, F.substring("text", 100, 40)).otherwise(F.lit("nothing like it"))
    return rel.read(spark, d, "documents").select("doc_id", F.substring("text", 1, 60).alias("question"), answer.alias("answer"), F.substring("text", 80, 200).alias("quote"), F.when(i % 2 == 0, "fact").otherwise("summary").alias("kind"))


@register("b3_answer_rules", f"""with {_QA}, x as (select *, {_TOKS.format('answer')} as ta, {_TOKS.format('quote')} as tq from qa), y as (select *, case when len(ta) > 1 then {_BI.format('ta')} else [] end as ba, case when len(tq) > 1 then {_BI.format('tq')} else [] end as bq from x)
select doc_id, case when contains({_SQ.format('question')}, {_SQ.format('answer')}) and {_SQ.format('answer')} <> '' then 'answer_leaked_in_question' when len(list_filter({_NUMS.format('answer')}, lambda z: not list_contains({_NUMS.format('quote')}, z))) > 0 then 'numeric_mismatch'
when not (case when kind = 'fact' then contains({_SQ.format('quote')}, {_SQ.format('answer')}) else len(list_filter(ba, lambda z: not list_contains(bq, z))) = 0 end) then 'answer_not_supported' end as rule from y""")
def b3(spark, d):
    return op.answer_rules(qa(spark, d)).select("doc_id", "rule")


@register("b2_contained_evidence", f"select doc_id, contains({_SQ.format('text')}, {_SQ.format('substr(text, 20, 50)')}) as contained from documents")
def b2_contained(spark, d):
    return rel.read(spark, d, "documents").select("doc_id", F.contains(tx.squash(F.col("text")), tx.squash(F.substring("text", 20, 50))).alias("contained"))


@register("b2_fuzzy_evidence")
def b2(spark, d):
    """Quotes with a letter in ten taken out, against their own text and the one before."""
    docs = rel.read(spark, d, "documents").select("doc_id", "text", "source")
    i = F.col("doc_id")
    units = docs.select(F.col("source").alias("document_id"), (i % 500).cast("int").alias("page"), i.cast("string").alias("chunk_id"), F.col("text").alias("content"))
    quote = F.when(i % 3 == 0, F.substring("text", 20, 60)).when(i % 3 == 1, F.concat(F.substring("text", 20, 25), F.lit("x"), F.substring("text", 46, 35))).otherwise(F.reverse(F.substring("text", 20, 60)))
    spans = docs.select(i.alias("ord"), F.col("source").alias("document_id"), (i % 500).cast("int").alias("page"), i.cast("string").alias("chunk_id"), quote.alias("quote"))
    return val.evidence(spans, units).select(F.col("ord").alias("doc_id"), "rule")


_UN = "un as (select doc_id as ord, 'q ' || case when doc_id % 2 = 0 then substr(text, 1, 10) || ' zzqx' else 'nothing' end as question, case doc_id % 7 when 6 then null when 5 then 'nowhere' else 's' || cast(doc_id % 200 as varchar) end as document_id, case when doc_id % 11 = 0 then 'k9999999' else 'k' || cast(doc_id as varchar) end as chunk_id, substr(text, 1, 10) as original, case when doc_id % 5 = 0 then substr(text, 1, 10) else substr(text, 1, 10) || ' zzqx' end as changed from documents where doc_id % 3 = 0), unit as (select 's' || cast(doc_id % 200 as varchar) as document_id, 'k' || cast(doc_id as varchar) as chunk_id, text as content from documents)"


def unanswerables(spark, d):
    docs, i = rel.read(spark, d, "documents"), F.col("doc_id")
    name, key, start = F.concat(F.lit("s"), (i % 200).cast("string")), F.concat(F.lit("k"), i.cast("string")), F.substring("text", 1, 10)
    units = docs.select(name.alias("document_id"), F.lit(1).alias("page"), key.alias("chunk_id"), F.col("text").alias("content"))
    some = docs.where("doc_id % 3 = 0")
    candidates = some.select(i.alias("ord"), F.concat(F.lit("q "), F.when(i % 2 == 0, F.concat(start, F.lit(" zzqx"))).otherwise("nothing")).alias("question"), F.lit(False).alias("answerable"))
    document = F.when(i % 7 == 5, "nowhere").otherwise(name)
    changes = some.where("doc_id % 7 <> 6").select(i.alias("ord"), document.alias("document_id"), F.lit(1).alias("page"), F.when(i % 11 == 0, "k9999999").otherwise(key).alias("chunk_id"), start.alias("original"), F.when(i % 5 == 0, start).otherwise(F.concat(start, F.lit(" zzqx"))).alias("changed"))
    return candidates, changes, units


@register("b4_unanswerable_rules", f"""with {_UN}, whole as (select document_id, {_SQ.format("string_agg(content, chr(10) order by chunk_id)")} as w from unit group by document_id), x as (select ord, u.document_id, w.w is not null as known, exists (select 1 from unit k where k.document_id = u.document_id and k.chunk_id = u.chunk_id and contains({_SQ.format('k.content')}, {_SQ.format('original')})) as there, contains(w.w, {_SQ.format('changed')}) as present, contains({_SQ.format('question')}, {_SQ.format('changed')}) as asked from un u left join whole w on w.document_id = u.document_id)
select ord, 'malformed_unanswerable' as rule from x where document_id is null union all select ord, 'impossible_target_document' from x where document_id is not null and not known union all select ord, 'original_fact_not_found' from x where known and not there union all select ord, 'asserted_absent_fact_present' from x where known and present union all select ord, 'transformed_fact_not_in_question' from x where known and not asked""")
def b4(spark, d):
    return val.unanswerable(*unanswerables(spark, d))


@register("b5_contamination", f"with {_QA} select doc_id from qa where contains(lower(concat_ws(' ', question, answer)), 'nothing') or contains(lower(concat_ws(' ', question, answer)), '12,345')")
def b5(spark, d):
    return op.contaminated(qa(spark, d), ["nothing", "12,345"]).select("doc_id")


def _questions(spark, d):
    return rel.read(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("question"))


@register("b6_near_duplicate_groups")
def b6(spark, d):
    return op.duplicate_groups(_questions(spark, d), 0.92, checkpoint)


@register("j14_exact_duplicate_questions", f"with f as (select doc_id, {_SQ.format('text')} as f from documents) select (select min(doc_id) from f c where c.f = b.f) as a, b.doc_id as b from f b where b.doc_id <> (select min(doc_id) from f c where c.f = b.f)")
def j14(spark, d):
    return op.exact_duplicates(rel.read(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("question")))


_ITEMS = "items as (select doc_id as item_id, 'd' || cast(doc_id // 3 as varchar) as token from documents union all select doc_id, 'f' || cast(doc_id * 7 // 4 as varchar) from documents)"


def items(spark, d):
    docs = rel.read(spark, d, "documents").select(F.col("doc_id").alias("item_id"))
    token = F.explode(F.array(F.concat(F.lit("d"), F.floor(F.col("item_id") / 3).cast("string")), F.concat(F.lit("x"), (F.col("item_id") % 300).cast("string"))))
    return docs.select("item_id", token.alias("token"))


@register("b8_leakage_components", "with docs as (select doc_id // 3 as g, doc_id % 300 as x from documents) select doc_id as item_id, doc_id % 300 - (doc_id % 300) % 3 as component from documents")
def b8(spark, d):
    labels = op.min_label_components(op.shared_token_links(items(spark, d)), checkpoint)
    return labels.select(F.col("id").alias("item_id"), "component")


_B9 = "(list_sort([" + ", ".join(f"{{'l': {s}, 'h': md5('1:{s}:' || cast(n as varchar)), 's': '{s}'}}" for s in ("dev", "gold", "holdout")) + "]))[1].s"


@register("b9_split_allocation", f"""with recursive comp as (select doc_id % 300 - (doc_id % 300) % 3 as component, count(*) as n from documents group by 1), o as (select n, row_number() over (order by n desc, md5('1:' || cast(component as varchar))) as r from comp),
    f(r, dev, gold, holdout) as (select 0::bigint, 0::bigint, 0::bigint, 0::bigint union all select r, dev + case s when 'dev' then n else 0 end, gold + case s when 'gold' then n else 0 end, holdout + case s when 'holdout' then n else 0 end
        from (select o.r, o.n, dev, gold, holdout, {_B9} as s from f join o on o.r = f.r + 1))
select unnest(['dev', 'gold', 'holdout']) as split, unnest([dev, gold, holdout]) as n from f where r = (select count(*) from comp)""")
def b9(spark, d):
    labels = op.min_label_components(op.shared_token_links(items(spark, d)), checkpoint)
    return op.allocate_splits(labels, ["dev", "gold", "holdout"], 1).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@register("w9_stratified_hash", "select doc_id, lang from (select *, row_number() over (partition by lang order by md5('3:' || cast(doc_id as varchar))) as round from documents) order by round, lang limit 50")
def w9(spark, d):
    return op.stratified(rel.read(spark, d, "documents"), ["lang"], 50, F.md5(F.concat_ws(":", F.lit("3"), "doc_id"))).select("doc_id", "lang")


@register("w10_stratified_two_keys", "select doc_id, lang, source from (select *, row_number() over (partition by lang, source order by md5('9:' || cast(doc_id as varchar))) as round from documents) order by round, lang, source limit 120")
def w10(spark, d):
    return op.stratified(rel.read(spark, d, "documents"), ["lang", "source"], 120, F.md5(F.concat_ws(":", F.lit("9"), "doc_id"))).select("doc_id", "lang", "source")


@register("w21_quota_admission", "select doc_id, row_number() over (partition by lang order by doc_id) <= case lang when 'en' then 100 when 'de' then 20 else 0 end as accepted from documents")
def w21(spark, d):
    rows = rel.read(spark, d, "documents").select("doc_id", F.col("lang").alias("kind"), F.col("doc_id").alias("ord"))
    return op.admit(rows, "kind", {"en": 100, "de": 20}).select("doc_id", "accepted")


@register("w20_caps_admission", """with recursive n as (select doc_id, lang, coalesce(source, '') as source, row_number() over (order by doc_id) as r from documents),
    f(r, doc_id, accepted, used, kept) as (select 0::bigint, null::bigint, false, MAP {'': 0}, MAP {'en': 100, 'de': 50, 'fr': 20} union all
        select r, doc_id, ok, case when ok then map_concat(used, MAP {source: coalesce(used[source], 0) + 1}) else used end, case when ok then map_concat(kept, MAP {lang: kept[lang] - 1}) else kept end
        from (select n.r, n.doc_id, n.source, n.lang, used, kept, coalesce(used[n.source], 0) < 6 and coalesce(kept[n.lang], 0) > 0 as ok from f join n on n.r = f.r + 1))
select doc_id as candidate_id, accepted from f where r > 0""")
def w20(spark, d):
    rows = rel.read(spark, d, "documents").select(F.col("doc_id").alias("candidate_id"), F.col("lang").alias("kind"), F.col("source").alias("document_id"), F.col("doc_id").alias("ord"))
    return op.admit_with_caps(rows, {"en": 100, "de": 50, "fr": 20}, 6).select("candidate_id", "accepted")


@register("b12_controlled_unanswerable", "select event_id, event_id % 4 as place, 'w' || cast(event_id % 4 as varchar) as old, 'changed' as new from events where event_id % 3 = 0")
def b12(spark, d):
    i = F.col("event_id")
    e = rel.read(spark, d, "events").withColumn("a", F.lit("w0 w1 w2 w3")).withColumn("b", F.when(i % 3 == 0, F.replace(F.col("a"), F.concat(F.lit("w"), (i % 4).cast("string")), F.lit("changed"))).otherwise(F.lit("w0 x y w3")))
    out = e.select("event_id", op.one_substitution(F.col("a"), F.col("b")).alias("s")).where("s is not null")
    return out.select("event_id", F.col("s.place").cast("long").alias("place"), F.col("s.old").alias("old"), F.col("s.new").alias("new"))


@register("w12_first_seen", "select text_key, arg_min(doc_id, doc_id) as doc_id, count(distinct lang) > 1 as conflict from (select text as text_key, doc_id, lang from documents) group by text_key")
def w12(spark, d):
    rows = rel.read(spark, d, "documents").select(F.col("text").alias("text_key"), "doc_id", "lang")
    return op.first_seen(rows, "text_key", "doc_id").select("text_key", "doc_id", "conflict")


@register("a16_validation_distributions", f"with {_CAND} select rule, count(*) as n from ({_B1.split(chr(10))[0].replace('with ' + _CAND, '')}) group by rule")
def a16(spark, d):
    return op.evidence_rules(*candidates(spark, d)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@register("a17_quota_deficits", "select kind, target - coalesce(n, 0) as deficit from (select unnest(['en','de','fr','es','it']) as kind, unnest([500, 200, 150, 100, 5]) as target) left join (select lang as kind, count(*) as n from documents group by 1) using (kind) where target - coalesce(n, 0) > 0")
def a17(spark, d):
    quotas = spark.createDataFrame([("en", 500), ("de", 200), ("fr", 150), ("es", 100), ("it", 5)], "kind string, target long")
    return op.quota_deficits(rel.read(spark, d, "documents").select(F.col("lang").alias("kind")), quotas)


@register("a17_completion_level", "select source, case when count(*) >= 60 then 'TARGET' when count(*) >= 50 then 'NORMAL_FLOOR' when count(*) >= 40 then 'EMERGENCY' else 'INSUFFICIENT' end as level from documents group by source")
def a17_level(spark, d):
    return rel.read(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", op.completion_level(F.col("n"), 60, 50, 40).alias("level"))


@register("a25_calibration_balance", "select max(n) - min(n) as spread, count(*) as strata from (select event_type, user_id % 3 as s, count(*) as n from events group by all)")
def a25(spark, d):
    g = rel.read(spark, d, "events").groupBy("event_type", F.col("user_id") % 3).agg(F.count(F.lit(1)).alias("n"))
    return g.agg((F.max("n") - F.min("n")).alias("spread"), F.count(F.lit(1)).alias("strata"))


_VAL = """c as (select doc_id as ord, case when doc_id % 97 = 0 then 'c0' else 'c' || cast(doc_id as varchar) end as candidate_id, case when doc_id % 2 = 0 then 'fact' else 'summary' end as kind, case when doc_id % 29 = 0 then sha256('f' || cast(doc_id as varchar)) || ' forbidden' else sha256(cast(case when doc_id % 41 = 40 then doc_id - 40 else doc_id end as varchar)) end as question,
case doc_id % 4 when 0 then substr(text, 5, 20) when 1 then '12,345 and ' || cast(doc_id as varchar) when 2 then substr(text, 100, 40) else 'nothing like it' end as answer, substr(text, 1, 200) as quote, 's' || cast(doc_id as varchar) as document_id from documents)"""


def validated(spark, d):
    docs, i = rel.read(spark, d, "documents"), F.col("doc_id")
    question = F.when(i % 29 == 0, F.concat(F.sha2(F.concat(F.lit("f"), i.cast("string")), 256), F.lit(" forbidden"))).otherwise(F.sha2(F.when(i % 41 == 40, i - 40).otherwise(i).cast("string"), 256))
    answer = F.when(i % 4 == 0, F.substring("text", 5, 20)).when(i % 4 == 1, F.concat(F.lit("12,345 and "), i.cast("string"))).when(i % 4 == 2, F.substring("text", 100, 40)).otherwise(F.lit("nothing like it"))
    candidates = docs.select(i.alias("ord"), F.when(i % 97 == 0, "c0").otherwise(F.concat(F.lit("c"), i.cast("string"))).alias("candidate_id"), F.when(i % 2 == 0, "fact").otherwise("summary").alias("kind"), question.alias("question"), answer.alias("answer"), F.lit(True).alias("answerable"))
    place = [F.concat(F.lit("s"), i.cast("string")).alias("document_id"), F.lit(1).alias("page"), F.lit("k").alias("chunk_id")]
    spans, units = docs.select(i.alias("ord"), *place, F.substring("text", 1, 200).alias("quote")), docs.select(*place, F.col("text").alias("content"))
    changes = docs.where("false").select(i.alias("ord"), *place, F.lit("").alias("original"), F.lit("").alias("changed"))
    return candidates, spans, units, changes


_NUMQ = _NUMS.format("quote")
#: Questions are hashes, so that only equal ones are like each other, and every document has one, so that only the quotas bind.
@register("b7_full_validator", f"""with {_VAL}, x as (select *, {_SQ.format('question')} as sq, {_SQ.format('answer')} as sa, {_SQ.format('quote')} as se, {_TOKS.format('answer')} as ta, {_TOKS.format('quote')} as tq from c), y as (select *, case when len(ta) > 1 then {_BI.format('ta')} else [] end as ba, case when len(tq) > 1 then {_BI.format('tq')} else [] end as bq, len(list_filter({_NUMS.format('answer')}, lambda z: not list_contains({_NUMQ}, z))) > 0 as nums from x),
r as (select ord, 'duplicate_candidate_id' as rule from (select ord, row_number() over (partition by candidate_id order by ord) as n from c) where n > 1 union all select ord, 'duplicate_question' from (select ord, row_number() over (partition by sq order by ord) as n from x) where n > 1
union all select ord, 'evidence_not_found' from x where se = '' union all select ord, 'answer_leaked_in_question' from x where contains(sq, sa) union all select ord, 'numeric_mismatch' from y where nums
union all select ord, 'answer_not_supported' from y where not nums and not (case when kind = 'fact' then contains(se, sa) else len(list_filter(ta, lambda z: not list_contains(tq, z))) = 0 and len(list_filter(ba, lambda z: not list_contains(bq, z))) = 0 end) union all select ord, 'contamination_detected' from x where contains(sq || sa, 'forbidden')),
q as (select ord, row_number() over (partition by kind order by ord) as n, kind from c where ord not in (select ord from r)), every as (select * from r union all select ord, 'type_quota_exceeded' from q where n > case kind when 'fact' then 60 else 25 end)
select c.ord, candidate_id, count(rule) = 0 as accepted, coalesce(string_agg(distinct rule, ',' order by rule), '') as rules from c left join every using (ord) group by c.ord, candidate_id""")
def b7(spark, d):
    out = val.validate(*validated(spark, d), checkpoint, {"fact": 60, "summary": 25}, 5, 5, ["forbidden"])
    return out.select("ord", "candidate_id", "accepted", F.array_join("rules", ",").alias("rules"))


_GEN = """plan as (select 'b' || cast(doc_id // 8 as varchar) as batch_id, doc_id as ordinal, case when doc_id % 2 = 0 then 'fact' else 'summary' end as kind from documents), got as (select 'b' || cast(doc_id // 8 as varchar) as batch_id, doc_id % 8 as place, case when doc_id % 2 = 0 and doc_id % 50 <> 0 then 'fact' else 'summary' end as kind, case when doc_id % 70 = 1 then 'g' || cast(doc_id - 1 as varchar) else 'g' || cast(doc_id as varchar) end as candidate_id from documents where doc_id % 30 <> 29)"""


def generated(spark, d):
    docs, i = rel.read(spark, d, "documents").select("doc_id"), F.col("doc_id")
    batch = F.concat(F.lit("b"), F.floor(i / 8).cast("string")).alias("batch_id")
    planned = docs.select(F.sha2(F.lit("plan"), 256).alias("plan_hash"), batch, i.alias("ordinal"), F.when(i % 2 == 0, "fact").otherwise("summary").alias("kind"), F.md5(i.cast("string")).alias("window_hash"))
    returned = docs.where("doc_id % 30 <> 29").select(batch, (i % 8).alias("place"), F.when((i % 2 == 0) & (i % 50 != 0), "fact").otherwise("summary").alias("kind"), F.concat(F.lit("g"), F.when(i % 70 == 1, i - 1).otherwise(i).cast("string")).alias("candidate_id"))
    return planned, returned


@register("b15_batch_generation_checks", f"with {_GEN}, p as (select *, row_number() over (partition by batch_id order by ordinal) - 1 as place from plan) select batch_id, 'job_count' as problem from p left join got using (batch_id, place) group by batch_id having count(got.kind) <> count(*) union all select distinct batch_id, 'question_type' from p join got using (batch_id, place) where p.kind <> got.kind union all select batch_id, 'duplicate_candidate_id' from got group by batch_id having count(distinct candidate_id) < count(*)")
def b15(spark, d):
    return val.batch_problems(*generated(spark, d))


@register("b15_resumed_batches", """with plan as (select doc_id as ordinal, doc_id // 8 as batch, sha256('{"job_ordinal":' || cast(doc_id as varchar) || ',"plan_hash":"' || sha256('plan') || '"}') as id from documents), stored as (select ordinal, batch, case when ordinal % 37 = 0 then 'other' else id end as id, ordinal % 53 = 0 as moved from plan where batch % 3 = 0 and ordinal % 61 <> 0) select 'b' || cast(p.batch as varchar) as batch_id, p.ordinal from plan p left join stored s using (ordinal) where p.batch in (select batch from stored) and (s.id is null or s.id <> p.id or s.moved)""")
def b15_resumed(spark, d):
    planned, i = generated(spark, d)[0], F.col("ordinal")
    stored = planned.where(F.floor(i / 8) % 3 == 0).where(i % 61 != 0)
    stored = stored.withColumn("candidate_id", F.when(i % 37 == 0, "other").otherwise(val.assigned_id(F.col("plan_hash"), i))).withColumn("window_hash", F.when(i % 53 == 0, "moved").otherwise(F.col("window_hash")))
    return val.resume_problems(planned, stored)


@register("b14_gold_seal", """with l as (select '{"item_id":' || cast(item_id as varchar) || ',"text":' || cast(to_json(text) as varchar) || '}' as line from benchmark) select sha256(string_agg(line, chr(10) order by line)) as seal, count(*) as n from l""")
def b14(spark, d):
    line = F.to_json(F.struct("item_id", "text"))
    return rel.read(spark, d, "benchmark").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("seal"), F.count(F.lit(1)).alias("n"))


@register("j18_corpus_parity", "select 'standard' as side, count(*) as n from (select doc_id from documents where doc_id % 10 <> 0 except select doc_id from documents where doc_id % 7 <> 0) union all select 'enhanced', count(*) from (select doc_id from documents where doc_id % 7 <> 0 except select doc_id from documents where doc_id % 10 <> 0)")
def j18(spark, d):
    docs = rel.read(spark, d, "documents").select("doc_id")
    a, b = docs.where("doc_id % 10 <> 0"), docs.where("doc_id % 7 <> 0")
    count = lambda df, side: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return count(a.exceptAll(b), "standard").unionByName(count(b.exceptAll(a), "enhanced"))


@register("x16_validation_payload", f"""with {_CAND}, r as ({_B1.replace('with ' + _CAND, '')}) select chr(123) || string_agg('"' || rule || '":' || cast(n as varchar), ',' order by rule) || chr(125) as payload from (select coalesce(rule, 'accepted') as rule, count(*) as n from r group by 1)""")
def x16(spark, d):
    g = op.evidence_rules(*candidates(spark, d)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("rule", F.lit("accepted")).alias("rule"), "n"))))).alias("payload"))
