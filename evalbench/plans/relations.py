"""The engine's relations over the provided tables, and the same as SQL common table expressions."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalbench.sources.shared import rewritten, spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` for work on its texts; a table that is one piece is dealt out first."""
    return spread(read(spark, sf_dir, "documents"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of one page each; the source is the document."""
    return documents(spark, sf_dir).select(F.format_string("c%08d", "doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("text").alias("content"), "lang", F.col("doc_id").alias("ord"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items: the first 80 characters are the query."""
    kind = F.element_at(F.array(F.lit("fact"), F.lit("numeric"), F.lit("summary")), (F.col("item_id") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "benchmark").select(F.format_string("q%05d", "item_id").alias("question_id"), kind.alias("question_type"), F.substring("text", 1, 80).alias("query"), (F.col("item_id") * 37 % 101).cast("double").alias("latency_ms"), F.col("text").alias("passage"))


#: (letters of a piece, neighbouring pieces): a query's class is the first whose pieces it is long enough for.
PIECES = ((32, 32), (8, 8), (8, 1), (4, 1), (2, 1), (1, 1))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that contain a query word for word; found by a shared key of letters before the text comparison.

    A chunk that contains a query has the query's key, however short that is (see ``text.piece_keys``), and an empty query is in
    every chunk. Chunks get keys of the classes only that queries are of.
    """
    from evalbench.functions import text as tx
    from evalbench.operators.retrieval import small

    q, c = questions(spark, sf_dir).select("question_id", "query").where("query is not null"), chunks(spark, sf_dir).select("chunk_id", "content")
    kind = F.lit(len(PIECES))
    for i, (letters, width) in reversed(list(enumerate(PIECES))):
        kind = F.when(F.length("query") >= letters + width - 1, i).otherwise(kind)
    kinds = sorted(r.kind for r in q.select(kind.alias("kind")).distinct().collect())  # at most as many as there are classes
    none = F.array(F.lit(0).cast("long"))

    def keyed(rows: DataFrame, text: str, first: bool) -> DataFrame:
        """The rows with a column of keys for each class."""
        return rows.select(rows.columns[0], *[(tx.piece_keys(*PIECES[i], first)(text) if i < len(PIECES) else none).alias(f"g{i}") for i in kinds], *([kind.alias("kind")] if first else []))

    key = lambda i, g: F.xxhash64(F.lit(i), g)
    own = F.coalesce(*[F.when(F.col("kind") == i, key(i, F.get(f"g{i}", F.lit(0)))) for i in kinds]) if kinds else F.lit(None).cast("long")
    every = F.concat(*[F.transform(f"g{i}", functools.partial(key, i)) for i in kinds]) if kinds else none
    left = keyed(q, "query", True).select("question_id", own.alias("g"))
    right = keyed(c, "content", False).select("chunk_id", F.explode(every).alias("g"))
    met = rewritten(right.join(small(left), "g").select("question_id", "chunk_id").distinct(), "evidence")
    # texts come in only for chunks that share a key
    pairs = small(met.join(q, "question_id"))
    return c.join(pairs, "chunk_id").where(F.contains("content", "query")).select("question_id", "chunk_id").distinct()


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment results from events: user mod 12 is the experiment, the event the question."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.format_string("e%02d", F.col("user_id") % 12).alias("experiment_id"), F.format_string("q%05d", F.col("event_id")).alias("question_id"), F.col("event_type").alias("question_type"),
        (F.col("event_id") * 7 % 11 / 10.0).alias("hit"), (F.col("event_id") * 5 % 13 / 12.0).alias("recall"), (F.col("event_id") * 3 % 7 / 6.0).alias("mrr"), F.col("value").alias("latency_ms"), "event_id", "user_id",
    )


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve configurations: two parse modes, two chunkers, three retrievers."""
    i = F.col("id")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))
    return spark.range(12).select(
        F.format_string("e%02d", "id").alias("experiment_id"), F.sha2(F.format_string("config-%d", "id"), 256).alias("config_hash"),
        pick(["standard", "enhanced"], i % 2).alias("parse_mode"), pick(["fixed", "heading"], F.floor(i / 2) % 2).alias("chunk_strategy"), pick(["dense", "bm25", "hybrid"], F.floor(i / 4)).alias("retriever"), (F.lit(5) * (i % 3 + 1)).alias("top_k"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage ledger from events: operation, model, tokens, cost as decimal."""
    e = read(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "purchase", "generate").when(F.col("event_type") == "signup", "parse").when(F.col("event_type") == "error", "embed").otherwise("judge")
    return e.select(
        F.col("event_id").alias("usage_id"), F.format_string("e%02d", F.col("user_id") % 12).alias("experiment_id"), F.format_string("q%05d", F.col("event_id") % 500).alias("question_id"), F.col("event_type").alias("question_type"), op.alias("operation"),
        F.format_string("m%d", F.col("event_id") % 3).alias("model_id"), (F.col("event_id") % 997 + 1).alias("tokens_in"), (F.col("event_id") % 89 + 1).alias("tokens_out"), (F.col("event_id") % 5 + 1).alias("pages"),
        F.col("value").cast("decimal(12,6)").alias("cost"), (F.col("event_id") % 4 == 0).alias("cached"), F.col("ts"),
    )


SQL = {
    "chunks": "chunks as (select printf('c%08d', doc_id) as chunk_id, source as document_id, text as content, lang, doc_id as ord from documents)",
    "questions": "questions as (select printf('q%05d', item_id) as question_id, ['fact','numeric','summary'][item_id % 3 + 1] as question_type, substr(text, 1, 80) as query, cast(item_id * 37 % 101 as double) as latency_ms, text as passage from benchmark)",
    "evidence": "evidence as (select question_id, chunk_id from questions join chunks on contains(content, query))",
    "results": "results as (select printf('e%02d', user_id % 12) as experiment_id, printf('q%05d', event_id) as question_id, event_type as question_type, (event_id * 7 % 11) / 10.0::double as hit, (event_id * 5 % 13) / 12.0::double as recall, (event_id * 3 % 7) / 6.0::double as mrr, value as latency_ms, event_id, user_id from events)",
    "configs": "configs as (select printf('e%02d', i) as experiment_id, sha256(printf('config-%d', i)) as config_hash, ['standard','enhanced'][i % 2 + 1] as parse_mode, ['fixed','heading'][(i // 2) % 2 + 1] as chunk_strategy, ['dense','bm25','hybrid'][i // 4 + 1] as retriever, 5 * (i % 3 + 1) as top_k from range(12) t(i))",
    "usage": "usage as (select event_id as usage_id, printf('e%02d', user_id % 12) as experiment_id, printf('q%05d', event_id % 500) as question_id, event_type as question_type, case event_type when 'purchase' then 'generate' when 'signup' then 'parse' when 'error' then 'embed' else 'judge' end as operation, printf('m%d', event_id % 3) as model_id, event_id % 997 + 1 as tokens_in, event_id % 89 + 1 as tokens_out, event_id % 5 + 1 as pages, cast(value as decimal(12,6)) as cost, event_id % 4 = 0 as cached, ts from events)",
    "tokens": r"tokens as (select chunk_id, document_id, regexp_extract_all(replace(lower(content), 'ß', 'ss'), '\p{Nd}{1,3}(?:,\p{Nd}{3})+(?:\.\p{Nd}+)?|\p{Nd}+(?:\.\p{Nd}+)?|[\p{L}\p{Nl}\p{No}]+') as terms from chunks)",
    "qterms": r"qterms as (select distinct question_id, unnest(regexp_extract_all(replace(lower(query), 'ß', 'ss'), '\p{Nd}{1,3}(?:,\p{Nd}{3})+(?:\.\p{Nd}+)?|\p{Nd}+(?:\.\p{Nd}+)?|[\p{L}\p{Nl}\p{No}]+')) as term from questions)",
    "postings": "postings as (select term, chunk_id, document_id, len, count(*) as tf from (select chunk_id, document_id, len(terms) as len, unnest(terms) as term from tokens) group by all)",
    "stats": "stats as (select count(*) as n, avg(len(terms)) as avgdl from tokens)",
    "dfs": "dfs as (select term, count(*) as df from postings group by term)",
    "vectors": "vectors as (select printf('c%08d', vec_id) as chunk_id, list_transform(embedding, lambda x: cast(x as double)) as vector, label from embeddings)",
    "qvectors": "qvectors as (select printf('q%05d', vec_id) as question_id, vector as q from (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as vector from embeddings) where vec_id % 25 = 0)",
}


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.format_string("c%08d", "vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 25th vector is a query."""
    return read(spark, sf_dir, "embeddings").where("vec_id % 25 = 0").select(F.format_string("q%05d", "vec_id").alias("question_id"), F.col("embedding").alias("vector"))


_NEEDS = {"evidence": ["chunks", "questions"], "tokens": ["chunks"], "qterms": ["questions"], "postings": ["tokens"], "stats": ["tokens"], "dfs": ["postings"]}


def with_sql(names: str, query: str) -> str:
    """``query`` after the named common table expressions and those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return ("with " + ",\n".join(SQL[n] for n in order) + "\n" if order else "") + query


def ordered_hash_sql(source: str, by: str, order: str, line: str) -> str:
    """Three nested queries: hashes of blocks of a thousand, of a thousand of these, and of what is left; ``by`` may be empty."""
    keys = f"{by}, " if by else ""
    one = f"select {keys}{order} // 1000 as b, sha256(string_agg({line}, ',' order by {order})) as h, count(*) as n from {source} group by {keys}{order} // 1000"
    two = f"select {keys}b // 1000 as b, sha256(string_agg(h, ',' order by b)) as h, sum(n) as n from ({one}) group by {keys}b // 1000"
    return f"select {keys}cast(sum(n) as bigint) as n, sha256(string_agg(h, ',' order by b)) as hash from ({two}){' group by ' + by if by else ''}"
