"""Validation of candidate questions: rule codes by candidate, duplicate groups, admission under caps.

Relations: candidates (ord, candidate_id, kind, question, answer, answerable), spans (ord, document_id, page,
chunk_id, quote), units (document_id, page, chunk_id, content: a chunk's part on a page), changes (ord,
document_id, page, chunk_id, original, changed: the altered fact of an unanswerable candidate). ``ord`` is a
candidate's place in the input and tells rows apart even if their ids are equal. Rules come as (ord, rule).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalbench.functions import text as tx
from evalbench.operators import admission, curate

#: Question kinds whose answer has to stand in the evidence word for word.
LITERAL_KINDS = ("fact", "numeric")


def repeated_ids(candidates: DataFrame) -> DataFrame:
    """Every later row of a candidate_id."""
    place = F.row_number().over(Window.partitionBy("candidate_id").orderBy("ord"))
    return candidates.select("ord", place.alias("p")).where("p > 1").select("ord", F.lit("duplicate_candidate_id").alias("rule"))


def evidence(spans: DataFrame, units: DataFrame, least: float = 0.96) -> DataFrame:
    """For each span the first that holds: no such page, no such chunk on it, in no unit of the chunk even nearly."""
    pages = units.select("document_id", "page").distinct().withColumn("on_page", F.lit(True))
    squashed = units.select("document_id", "page", "chunk_id", tx.squash(F.col("content")).alias("content"))  # once a unit
    met = spans.withColumn("__q", tx.squash(F.col("quote"))).join(pages, ["document_id", "page"], "left").join(squashed, ["document_id", "page", "chunk_id"], "left")
    met = met.withColumn("__in", F.contains("content", "__q") & (F.col("__q") != ""))
    # only what is not contained goes to Python, its content too
    asked = F.col("content").isNotNull() & ~F.col("__in") & (F.col("__q") != "")
    near = tx.nearly_contains(least)(F.when(asked, F.col("__q")), F.when(asked, F.col("content")))
    met = met.withColumn("__ok", F.col("__in") | F.coalesce(near, F.lit(False)))
    each = met.groupBy("ord", "document_id", "page", "chunk_id", "quote").agg(F.bool_or("on_page").alias("on_page"), F.count("content").alias("n"), F.bool_or(F.coalesce("__ok", F.lit(False))).alias("ok"))
    rule = F.when(F.col("on_page").isNull(), "impossible_page").when(F.col("n") == 0, "impossible_chunk").when(~F.col("ok"), "evidence_not_found")
    return each.select("ord", rule.alias("rule")).where("rule is not null").distinct()


def answers(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """Answerable candidates with an answer: leaked in the question; numbers or words that the evidence lacks."""
    quotes = spans.groupBy("ord").agg(F.array_join(F.sort_array(F.collect_list("quote")), " ").alias("quote"))
    rows = candidates.where("answerable and answer is not null").select("ord", "kind", "question", "answer").join(quotes, "ord", "left").withColumn("quote", F.coalesce("quote", F.lit("")))
    leaked = F.contains(tx.squash(F.col("question")), tx.squash(F.col("answer")))
    numbers = F.size(F.array_except(tx.numbers(F.col("answer")), tx.numbers(F.col("quote")))) > 0
    rows = rows.withColumn("__a", curate.content_tokens(F.col("answer"))).withColumn("__q", curate.content_tokens(F.col("quote")))
    words = (F.size(F.array_except("__a", "__q")) == 0) & (F.size(F.array_except(curate.bigrams(F.col("__a")), curate.bigrams(F.col("__q")))) == 0)
    supported = F.when(F.col("kind").isin(*LITERAL_KINDS), F.contains(tx.squash(F.col("quote")), tx.squash(F.col("answer")))).otherwise(words)
    rules = F.array_compact(F.array(F.when(leaked, "answer_leaked_in_question"), F.when(numbers, "numeric_mismatch").when(~supported, "answer_not_supported")))
    return rows.select("ord", F.explode(rules).alias("rule"))


#: Letters of a document that are searched at once.
SEARCHED = 1 << 18


def facts_in_documents(facts: DataFrame, units: DataFrame, block: int = SEARCHED) -> DataFrame:
    """The distinct (document_id, fact) of ``facts`` that the squashed units of the document, joined in order, contain.

    ``facts`` are not empty. A fact may run over the ends of units, so a block of ``block`` letters goes on by as many as the
    longest fact of the document has but one. A text meets its document's facts once, not once a fact.
    """
    facts = facts.groupBy("document_id").agg(F.collect_set("fact").alias("facts"), F.max(F.length("fact")).alias("longest"))
    laid = units.select("document_id", "page", "chunk_id", tx.squash(F.col("content")).alias("unit")).where("unit <> ''").join(facts.select("document_id", "longest"), "document_id")
    end = F.sum(F.length("unit")).over(Window.partitionBy("document_id").orderBy("page", "chunk_id", "unit").rowsBetween(Window.unboundedPreceding, 0))
    laid = laid.withColumn("end", end).withColumn("start", F.col("end") - F.length("unit"))
    blocks = F.sequence(F.floor(F.greatest(F.col("start") - F.col("longest") + 1, F.lit(0)) / block), F.floor((F.col("end") - 1) / block))
    laid = laid.withColumn("block", F.explode(blocks))
    begin = F.greatest(F.col("start"), F.col("block") * block)
    stop = F.least(F.col("end"), (F.col("block") + 1) * block + F.col("longest") - 1)
    part = F.struct(begin.alias("at"), F.substring("unit", (begin - F.col("start") + 1).cast("int"), (stop - begin).cast("int")).alias("part"))
    texts = laid.groupBy("document_id", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["part"]), "").alias("text"))
    return texts.join(facts, "document_id").select("document_id", F.explode(tx.held("text", "facts")).alias("fact")).distinct()


def unanswerable(candidates: DataFrame, changes: DataFrame, units: DataFrame, block: int = SEARCHED) -> DataFrame:
    """Unanswerable candidates: no change given, an unknown document, the original fact not in its chunk, the changed one in the document or not in the question.

    No text of a document or unit is in a row of a candidate beyond the join that looks into its unit.
    """
    rows = candidates.where("not answerable").select("ord", "question").join(changes.withColumn("fact", tx.squash(F.col("changed"))), "ord", "left")
    known = units.where("content is not null").select("document_id").distinct().withColumn("known", F.lit(True))
    present = facts_in_documents(changes.select("document_id", tx.squash(F.col("changed")).alias("fact")).where("fact <> ''"), units, block).withColumn("present", F.lit(True))
    chunk = units.select("document_id", "page", "chunk_id", tx.squash(F.col("content")).alias("unit"))
    found = rows.join(chunk, ["document_id", "page", "chunk_id"]).where(F.contains("unit", tx.squash(F.col("original")))).select("ord").distinct().withColumn("there", F.lit(True))
    out = rows.join(known, "document_id", "left").join(present, ["document_id", "fact"], "left").join(found, "ord", "left")
    known = F.col("known").isNotNull()
    rules = F.array_compact(F.array(
        F.when(F.col("document_id").isNull(), "malformed_unanswerable"), F.when(F.col("document_id").isNotNull() & ~known, "impossible_target_document"),
        F.when(known & F.col("there").isNull(), "original_fact_not_found"), F.when(known & ((F.col("fact") == "") | F.col("present").isNotNull()), "asserted_absent_fact_present"),
        F.when(known & ~F.contains(tx.squash(F.col("question")), F.col("fact")), "transformed_fact_not_in_question"),
    ))
    return out.select("ord", F.explode(rules).alias("rule"))


def contamination(candidates: DataFrame, terms: list[str]) -> DataFrame:
    """Question or answer holds one of a bounded list of terms."""
    both = tx.squash(F.concat_ws(" ", "question", "answer"))
    held = F.exists(F.array(*[tx.squash(F.lit(t)) for t in terms]), lambda t: F.contains(both, t)) if terms else F.lit(False)
    return candidates.where(held).select("ord", F.lit("contamination_detected").alias("rule"))


def broken(candidates: DataFrame, spans: DataFrame, units: DataFrame, changes: DataFrame, checkpoint, terms: list[str] = (), similar: float = 0.92) -> DataFrame:
    """(ord, rule) of all rules but the caps, once a candidate and rule."""
    groups = curate.duplicate_groups(candidates.select(F.col("ord").alias("item_id"), "question"), similar, checkpoint)
    later = groups.where("rejected").select(F.col("item_id").alias("ord"), F.lit("duplicate_question").alias("rule"))
    parts = [repeated_ids(candidates), later, evidence(spans, units), answers(candidates, spans), unanswerable(candidates, changes, units), contamination(candidates, list(terms))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def admitted(clean: DataFrame, quotas: dict[str, int], per_document: int, per_page: int, block: int = admission.BLOCK) -> DataFrame:
    """(ord, rule): what quotas and caps reject of ``clean`` (ord, kind, places array<struct<document_id, page>>), in order; see ``admission``."""
    filled = admission.admission(clean, quotas, per_document, per_page, block)
    return admission.rejected(clean, filled, quotas, clean.sparkSession).where("rule is not null").select("ord", "rule")


def validate(candidates: DataFrame, spans: DataFrame, units: DataFrame, changes: DataFrame, checkpoint, quotas: dict[str, int], per_document: int, per_page: int, terms: list[str] = (), similar: float = 0.92) -> DataFrame:
    """ord, candidate_id, accepted, rules (sorted): all rules, then quotas and caps for what none of them rejects."""
    rules = checkpoint(broken(candidates, spans, units, changes, checkpoint, terms, similar))
    places = spans.select("ord", "document_id", "page").unionByName(changes.select("ord", "document_id", "page")).groupBy("ord").agg(F.collect_set(F.struct("document_id", "page")).alias("places"))
    clean = candidates.select("ord", "kind").join(rules, "ord", "left_anti").join(places, "ord", "left").withColumn("places", F.coalesce("places", F.array().cast("array<struct<document_id:string,page:int>>")))
    clean = checkpoint(clean)  # read once a round of admission
    every = rules.unionByName(admitted(clean, quotas, per_document, per_page)).groupBy("ord").agg(F.sort_array(F.collect_set("rule")).alias("rules"))
    out = candidates.select("ord", "candidate_id").join(every, "ord", "left")
    return out.select("ord", "candidate_id", F.col("rules").isNull().alias("accepted"), F.coalesce("rules", F.array().cast("array<string>")).alias("rules"))


def batch_problems(planned: DataFrame, returned: DataFrame) -> DataFrame:
    """(batch_id, problem) of generated batches against their plan.

    ``planned``: plan_hash, batch_id, ordinal, kind, window_hash; ``returned``: batch_id, place (within the batch),
    kind, candidate_id. A batch has to hold as many rows as jobs, of the jobs' kinds in order, with distinct ids.
    """
    jobs = planned.withColumn("place", F.row_number().over(Window.partitionBy("batch_id").orderBy("ordinal")) - 1)
    met = jobs.select("batch_id", "place", F.col("kind").alias("wanted")).join(returned, ["batch_id", "place"], "full")
    by = met.groupBy("batch_id").agg(
        (F.count("wanted") != F.count("kind")).alias("count"), F.bool_or(F.col("wanted").isNotNull() & F.col("kind").isNotNull() & (F.col("wanted") != F.col("kind"))).alias("types"), (F.count_distinct("candidate_id") < F.count("candidate_id")).alias("ids")
    )
    rules = F.array_compact(F.array(F.when(F.col("count"), "job_count"), F.when(F.col("types"), "question_type"), F.when(F.col("ids"), "duplicate_candidate_id")))
    return by.select("batch_id", F.explode(rules).alias("problem"))


def assigned_id(plan_hash: Column, ordinal: Column) -> Column:
    """The id that the engine gives a generated candidate: a hash of the plan and the job's number."""
    return tx.canonical_hash(job_ordinal=ordinal.cast("int"), plan_hash=plan_hash)


def resume_problems(planned: DataFrame, stored: DataFrame) -> DataFrame:
    """(batch_id, ordinal) of stored candidates that are not what the plan would give: id, kind, plan or window differ, or rows are missing.

    ``stored``: batch_id, ordinal, kind, candidate_id, plan_hash, window_hash.
    """
    theirs = stored.select("batch_id", "ordinal", *[F.col(c).alias(f"__{c}") for c in ("kind", "candidate_id", "plan_hash", "window_hash")])
    same = (F.col("__candidate_id") == assigned_id(F.col("plan_hash"), F.col("ordinal"))) & (F.col("__kind") == F.col("kind")) & (F.col("__plan_hash") == F.col("plan_hash")) & (F.col("__window_hash") == F.col("window_hash"))
    started = planned.join(stored.select("batch_id").distinct(), "batch_id", "left_semi")
    return started.join(theirs, ["batch_id", "ordinal"], "left").where(~F.coalesce(same, F.lit(False))).select("batch_id", "ordinal")
