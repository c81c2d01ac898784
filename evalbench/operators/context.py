"""Grounded answers: context under a token budget, safe serialisation, prompts, parsing and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ANSWER_SCHEMA = "answer string, citations array<string>, abstained boolean"


def build_context(hits: DataFrame, budget: int) -> DataFrame:
    """Hits (question_id, chunk_id, rank, score, content, tokens) in order, each chunk once, cited C1..Cn, cut before the first that passes ``budget``.

    The cut is a prefix: nothing after the first hit that does not fit is taken.
    """
    order = [F.col("rank"), F.col("score").desc(), F.col("chunk_id")]
    first = hits.withColumn("__r", F.row_number().over(Window.partitionBy("question_id", "chunk_id").orderBy(*order))).where("__r = 1").drop("__r")
    w = Window.partitionBy("question_id").orderBy(*order)
    cut = first.withColumn("used", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("used") <= budget)
    return cut.withColumn("citation_id", F.concat(F.lit("C"), F.row_number().over(w).cast("string")))


def safe_json(value: Column) -> Column:
    """JSON text whose markup characters are escapes."""
    out = F.to_json(value, {"ignoreNullFields": "false"})
    for char, code in (("&", "0026"), ("<", "003c"), (">", "003e")):
        code = "\\u" + code
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def render(template: Column, **values: Column) -> Column:
    """Template with each ``{{name}}`` put in once; null where a placeholder is missing or repeated."""
    ok = F.lit(True)
    out = template
    for name, value in values.items():
        mark = F.lit("{{" + name + "}}")
        ok = ok & (F.size(F.split(template, "\\{\\{" + name + "\\}\\}")) == 2)
        out = F.replace(out, mark, value)
    return F.when(ok, out)


def parse_answer(text: Column) -> Column:
    """struct(answer, citations, abstained) of a strict JSON object, fenced as a whole or not; null otherwise."""
    inner = F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)\A\s*```(?:json)?\s*(.*?)\s*```\s*\z", 1), F.lit("")), text)
    parsed = F.from_json(inner, ANSWER_SCHEMA)
    exact = F.array_sort(F.json_object_keys(inner)) == F.array(F.lit("abstained"), F.lit("answer"), F.lit("citations"))
    return F.when(exact & parsed["answer"].isNotNull() & parsed["citations"].isNotNull() & parsed["abstained"].isNotNull(), parsed)


def policy_violation(answer: Column, cite: bool = True) -> Column:
    n = F.size(answer["citations"])
    return F.when(answer.isNull(), "unparsed").when(answer["abstained"] & (n > 0), "abstained_with_citations").when(F.lit(cite) & ~answer["abstained"] & (n == 0), "no_citation")


def unknown_citations(answers: DataFrame, context: DataFrame) -> DataFrame:
    """question_id and citations that are not in its context. ``answers``: question_id, citations."""
    return answers.select("question_id", F.explode("citations").alias("citation_id")).join(context.select("question_id", "citation_id"), ["question_id", "citation_id"], "left_anti")


def sensitive_keys(entries: DataFrame, pattern: str = r"(?i)(secret|password|token|api_?key)") -> DataFrame:
    """Rows of (id, key, value) with a key like ``pattern`` or a value like an absolute path."""
    return entries.where(F.col("key").rlike(pattern) | F.col("value").rlike(r"^(/|[A-Za-z]:\\)"))


def token_usage(raw: Column, name: str) -> Column:
    """A non-negative integer of a raw JSON answer; null where it is missing or not one."""
    text = F.get_json_object(raw, f"$.{name}")
    return F.when(text.rlike("^[0-9]+$"), text.cast("long"))
