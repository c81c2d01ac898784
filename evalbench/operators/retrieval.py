"""Lexical, dense and fused retrieval for whole question sets, and the scoring of rankings.

Relations: chunks (chunk_id, document_id, content), questions (question_id, query), vectors (chunk_id,
vector), hits (question_id, chunk_id, rank, score). Every ranking orders by score, then chunk id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalbench.functions import text as tx
from evalbench.operators import order
from evalbench.sources.shared import rewritten, spread

#: Scores are compared at this many decimals, so that the order of additions does not decide ties.
TIE_DECIMALS = 9
#: A side of a join is broadcast only up to this many rows of bounded width; beyond it Spark shuffles.
BROADCAST_ROWS = 100_000
#: Rows of postings met with questions in one task.
MET_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def rank(df: DataFrame, by: str | list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """Row numbers from 1; with ``k`` the filter stands on the window, so each task keeps k rows a group."""
    w = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w))
    return out if k is None else out.where(F.col(name) <= k)


def best(df: DataFrame, k: int | None, by: str = "question_id", score: str = "score") -> DataFrame:
    return rank(df, by, [F.round(score, TIE_DECIMALS).desc(), F.col("chunk_id")], k)


def tokenised(chunks: DataFrame, unicode_forms: bool = False) -> DataFrame:
    """chunk_id, document_id, terms (sorted) and length (in tokens), written once to the shared folder: the pattern runs once a text."""
    t = chunks.select("chunk_id", "document_id", F.array_sort(tx.tokens(F.col("content"), unicode_forms)).alias("terms"))
    return rewritten(t.withColumn("length", F.size("terms")))


def postings(tokens: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """term, chunk_id, document_id, length, tf of every chunk of ``tokens`` (see ``tokenised``); only of ``wanted`` terms (term), if given.

    Terms are counted in their row, where equal ones stand side by side, without a shuffle. Only chunks that are there
    twice with one length meet, as one.
    """
    key = ["chunk_id", "document_id", "length"]
    t, of = tokens.where("length > 0"), lambda i: F.get("terms", i)
    starts = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda i: (i == 0) | (of(i) != of(i - 1)))
    runs = F.arrays_zip(starts.alias("a"), F.concat(F.slice(starts, 2, F.col("length")), F.array("length")).alias("b"))
    each = F.transform(runs, lambda r: F.struct(of(r["a"]).alias("term"), (r["b"] - r["a"]).cast("long").alias("tf")))

    def counted(rows: DataFrame) -> DataFrame:
        out = rows.select(*key, F.explode(each).alias("e")).select("e.term", *key, "e.tf")
        return out if wanted is None else out.join(wanted, "term", "left_semi")

    again = t.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if again.isEmpty():
        return counted(t)
    again = small(rewritten(again.withColumnsRenamed({c: f"__{c}" for c in key}), "repeated"))
    same = order.same(key, "__")
    met = counted(t.join(again, same, "left_semi")).groupBy("term", *key).agg(F.sum("tf").alias("tf"))
    return counted(t.join(again, same, "left_anti")).unionByName(met)


def corpus_statistics(tokens: DataFrame) -> DataFrame:
    """One row: documents and their mean length in tokens."""
    return tokens.agg(F.count(F.lit(1)).alias("documents"), F.avg("length").alias("mean_length"))


def query_terms(questions: DataFrame, unicode_forms: bool = False) -> DataFrame:
    """Each distinct term of a question once."""
    return questions.select("question_id", F.explode(F.array_distinct(tx.tokens(F.col("query"), unicode_forms))).alias("term"))


def met_by_chunk(post: DataFrame, terms: DataFrame, few: bool) -> DataFrame:
    """Postings with the rows of ``terms`` (question_id, term, df) for their term, dealt by chunk into tasks of about ``MET_ROWS`` rows.

    So what is summed by question and chunk is summed where the rows meet. With ``few`` the terms go to every task.
    """
    met = terms.agg(F.sum("df")).first()[0] or 0
    parts = max(1, -(-int(met) // MET_ROWS))
    by_chunk = lambda rows: rows.repartition(parts, "chunk_id")
    return by_chunk(post).join(F.broadcast(terms), "term") if few else by_chunk(post.join(terms, "term"))


def bm25(chunks: DataFrame, questions: DataFrame, k: int | None = 10, k1: float = 1.2, b: float = 0.75, allowed: DataFrame | None = None, unicode_forms: bool = False) -> DataFrame:
    """Okapi BM25 of all questions at once. ``allowed`` (document_id) drops candidates after the statistics.

    Where the questions' terms are few enough to go to every task, postings meet them where they are and a hot term
    is no hot key; else the join is by term, with Spark's splitting of skewed ones.
    """
    if not k1 > 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be positive and b between 0 and 1")
    if k is not None and k <= 0:
        raise ValueError("k must be positive")
    terms = rewritten(query_terms(questions, unicode_forms))
    few = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    to_all = F.broadcast if few else (lambda df: df)
    tokens = tokenised(chunks, unicode_forms)
    # only terms of some question are counted: a semi join
    post = rewritten(postings(tokens, to_all(terms.select("term").distinct())))
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = rewritten(df.join(F.broadcast(corpus_statistics(tokens))).join(to_all(terms), "term"), "weighed")  # one row of statistics
    if allowed is not None:
        post = post.join(small(allowed.select("document_id").distinct()), "document_id", "left_semi")
    weight = F.log(1 + (F.col("documents") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    rows = met_by_chunk(post, weighed, few)
    scored = rows.groupBy("question_id", "chunk_id").agg(F.sum(part).alias("score"))
    hits = best(scored.where("score > 0"), k)
    return hits if k is None else rewritten(hits, "hits")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def unit(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """``vectors`` with ``column`` scaled to length 1; the norm is computed once a row."""
    scaled = vectors.withColumn(column, doubles(F.col(column))).withColumn("__norm", norm(F.col(column)))
    return scaled.withColumn(column, F.transform(column, lambda x: x / F.col("__norm"))).drop("__norm")


def valid_vector(v: Column, dim: int | None = None) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = v.isNotNull() & finite & (norm(v) > 0)
    return ok if dim is None else ok & (F.size(v) == dim)


def cosine(vectors: DataFrame, queries: DataFrame, k: int | None = 10, prefix: int | None = None) -> DataFrame:
    """Exact cosine top-k of a bounded set of query vectors (question_id, vector) over ``vectors`` (chunk_id, vector).

    The question set is the side sent to every task, after a check of its size; larger sets go through in
    blocks. With ``prefix`` only that many leading components count. With ``k`` a task multiplies blocks of vectors
    with the queries and keeps k rows a query; without, all pairs are ranked. Lengths have to be equal.
    """
    cut = (lambda c: F.slice(c, 1, prefix)) if prefix else (lambda c: c)
    own = queries.select("question_id", cut(doubles(F.col("vector"))).alias("q"))
    rows = vectors.select("chunk_id", cut(doubles(F.col("vector"))).alias("v"))
    n = own.count()
    blocks = max(1, -(-n // 10_000))
    parts = []
    for i in range(blocks):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == i)
        if k is None:
            met = rows.withColumn("nv", norm(F.col("v"))).join(F.broadcast(part.withColumn("nq", norm(F.col("q")))))
            parts.append(best(met.select("question_id", "chunk_id", (dot(F.col("q"), F.col("v")) / (F.col("nq") * F.col("nv"))).alias("score")), None))
            continue
        asked = part.toArrow()  # at most about 10,000 vectors
        ids = asked["question_id"].to_pylist()
        q = np.array(asked["q"].to_pylist(), dtype=float).reshape(len(ids), -1)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, q / np.linalg.norm(q, axis=1, keepdims=True)))
        found = rows.mapInArrow(_best_products(shared, k), "question_id string, chunk_id string, score double")
        parts.append(best(found, k))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cosine_summary(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """question_id, pairs, best and mean cosine of each query (question_id, vector) over all ``vectors`` (chunk_id, vector).

    All pairs, in products of blocks; a task keeps a row a query. A null vector makes pairs without a score.
    """
    spark = vectors.sparkSession
    own = queries.select("question_id", doubles(F.col("vector")).alias("q"))
    blocks = max(1, -(-own.count() // 10_000))
    parts = []
    for i in range(blocks):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == i)
        asked = part.toArrow()  # at most about 10,000 vectors
        shared = spark.sparkContext.broadcast((asked["question_id"].to_pylist(), asked["q"].to_pylist()))
        found = spread(vectors.select(doubles(F.col("vector")).alias("v"))).mapInArrow(_summed_products(shared), "question_id string, pairs long, best double, total double, n long")
        parts.append(rewritten(found, "summary"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("question_id").agg(F.sum("pairs").alias("pairs"), F.max("best").alias("best"), F.try_divide(F.sum("total"), F.sum("n")).alias("mean"))


def _summed_products(shared, width: int = 256):
    """Rows (v) into the number, greatest and sum of the cosines of each query of this task."""

    def run(batches):
        ids, vectors = shared.value
        known = np.array([v is not None for v in vectors], dtype=bool)
        q = np.array([v for v in vectors if v is not None], dtype=float).reshape(int(known.sum()), -1)
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        pairs, n, best, total = 0, 0, np.full(len(q), -np.inf), np.zeros(len(q))
        for batch in batches:
            pairs += batch.num_rows
            column = batch.column(0).drop_null()
            for at in range(0, len(column) if len(q) else 0, width):
                part = column.slice(at, width)
                v = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                scores = q @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
                best, total, n = np.maximum(best, scores.max(axis=1)), total + scores.sum(axis=1), n + len(part)
        if not pairs:
            return
        scored = np.flatnonzero(known)
        bests, totals, counts = [None] * len(ids), [None] * len(ids), [0] * len(ids)
        for j, i in enumerate(scored if n else []):
            bests[i], totals[i], counts[i] = float(best[j]), float(total[j]), n
        columns = zip((ids, [pairs] * len(ids), bests, totals, counts), (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int64()), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["question_id", "pairs", "best", "total", "n"])

    return run


def _best_products(shared, k: int, width: int = 512):
    """Rows (chunk_id, v) into the k best of each query of this task, by rounded score and then id."""

    def run(batches):
        ids, q = shared.value
        held: list[list[tuple[float, str, float]]] = [[] for _ in ids]
        least = np.full(len(ids), -np.inf)
        for batch in batches:
            names, vectors = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(names) if ids else 0, width):
                part = vectors.slice(at, width)
                v = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                scores = q @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
                rounded = np.round(scores, TIE_DECIMALS)
                for i in np.flatnonzero((rounded >= least[:, None]).any(axis=1)):
                    hits = np.flatnonzero(rounded[i] >= least[i])
                    held[i] = sorted([*held[i], *((-float(rounded[i, j]), names[at + j], float(scores[i, j])) for j in hits)])[:k]
                    if len(held[i]) == k:
                        least[i] = -held[i][-1][0]
        out = [(ids[i], name, score) for i, own in enumerate(held) for _, name, score in own]
        columns = zip(*out, strict=True) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)], ["question_id", "chunk_id", "score"])

    return run


def prefix_rerank(vectors: DataFrame, queries: DataFrame, k: int, prefix: int, factor: int = 4) -> DataFrame:
    """Two stages: max(20, factor * k) candidates by the leading components, then the full cosine."""
    found = cosine(vectors, queries, max(20, factor * k), prefix).select("question_id", "chunk_id")
    both = found.join(small(queries), "question_id").withColumnRenamed("vector", "q").join(vectors, "chunk_id")
    q, v = doubles(F.col("q")), doubles(F.col("vector"))
    return best(both.select("question_id", "chunk_id", (dot(q, v) / (norm(q) * norm(v))).alias("score")), k)


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int = 60, weights: list[float] | None = None, top: int | None = None) -> DataFrame:
    """Sum of weight / (k + rank) over the rankings."""
    weights = weights or [1.0] * len(rankings)
    if k < 0 or len(weights) != len(rankings) or any(not 0 < w < float("inf") for w in weights):
        raise ValueError("k must not be negative; one positive weight a ranking")
    parts = [r.select("question_id", "chunk_id", (F.lit(float(w)) / (k + F.col("rank"))).alias("part")) for r, w in zip(rankings, weights, strict=True)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return best(out.groupBy("question_id", "chunk_id").agg(F.sum("part").alias("score")), top)


def branch_size(top_k: int) -> int:
    return max(20, 4 * top_k)


def hybrid(dense: DataFrame, sparse: DataFrame, top_k: int, k: int = 60, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Fusion of two branches fetched to ``branch_size(top_k)``, with each branch's rank and score."""
    d = dense.select("question_id", "chunk_id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    s = sparse.select("question_id", "chunk_id", F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse_score"))
    both = d.join(s, ["question_id", "chunk_id"], "full_outer")
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (k + F.col(r)), F.lit(0.0))
    return best(both.withColumn("score", part(weights[0], "dense_rank") + part(weights[1], "sparse_rank")), top_k)


def ranking_violations(hits: DataFrame, k: int) -> DataFrame:
    """question_id and the rule broken: too many hits, gaps in ranks, repeated chunks, scores not finite or rising."""
    by = Window.partitionBy("question_id").orderBy("rank")
    rows = hits.withColumn("before", F.lag("score").over(by))
    g = rows.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.countDistinct("rank").alias("ranks"), F.countDistinct("chunk_id").alias("chunks"),
        F.max((F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))).cast("int")).alias("bad"), F.max((F.col("score") > F.col("before") + 1e-9).cast("int")).alias("rise"),
    )
    rules = {"too_many": F.col("n") > k, "rank_gap": (F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("ranks") != F.col("n")), "repeated_chunk": F.col("chunks") != F.col("n"), "score_not_finite": F.col("bad") == 1, "score_rises": F.col("rise") == 1}
    named = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return g.select("question_id", F.explode(named).alias("violation"))


def score_rankings(questions: DataFrame, hits: DataFrame, evidence: DataFrame, k: int) -> DataFrame:
    """Per question (question_id, question_type, latency_ms): evidence count, hit and recall in the first k, reciprocal rank over all.

    Questions without evidence have nulls. ``evidence``: question_id, chunk_id.
    """
    wanted = evidence.select("question_id", "chunk_id").distinct()
    total = wanted.groupBy("question_id").agg(F.count(F.lit(1)).alias("evidence_count"))
    met = hits.select("question_id", "chunk_id", "rank").join(wanted, ["question_id", "chunk_id"])
    met = met.groupBy("question_id").agg(F.sum((F.col("rank") <= k).cast("long")).alias("met"), F.min("rank").alias("first"))
    rows = questions.join(total, "question_id", "left").join(met, "question_id", "left")
    some = F.col("evidence_count").isNotNull()
    found = F.coalesce("met", F.lit(0))
    return rows.select(
        "question_id", "question_type", "latency_ms",
        F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"), F.when(some, found).otherwise(0).alias("retrieved_count"),
        F.when(some, (found > 0).cast("double")).alias("hit"), F.when(some, found / F.col("evidence_count")).alias("recall"), F.when(some, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
    )


def _retrieval_aggregates() -> list[Column]:
    scored = F.col("evidence_count") > 0
    return [
        F.count(F.lit(1)).alias("questions"), F.count(F.when(scored, 1)).alias("scorable"), F.count(F.when(~scored, 1)).alias("no_evidence"),
        F.avg("hit").alias("hit"), F.avg("recall").alias("macro_recall"), F.try_divide(F.sum(F.when(scored, F.col("retrieved_count"))), F.sum(F.when(scored, F.col("evidence_count")))).alias("micro_recall"),
        F.avg("mrr").alias("mrr"), F.avg("latency_ms").alias("latency_ms"),
    ]


def aggregate_retrieval(scores: DataFrame) -> DataFrame:
    return scores.agg(*_retrieval_aggregates())


def aggregate_retrieval_by_type(scores: DataFrame) -> DataFrame:
    """By question type, and overall (a null type) in the same pass."""
    return scores.groupingSets([["question_type"], []], "question_type").agg(*_retrieval_aggregates())


ANCHOR = 5  # tokens


def bind_evidence(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Spans (span_id, document_id, page, quote) to the chunk of their document and page that contains them with the least excess.

    A quote's tokens but its first and last are whole tokens of a chunk that contains it. So the two meet under
    ``ANCHOR`` such tokens in a row, of a quote's the run that the fewest chunks of its document have; where it has
    fewer, under all of them. Quotes of less than three tokens have none and meet the chunks of their page.
    """
    key = lambda c: F.trim(F.regexp_replace(tx.fold(c), r"\s+", " "))
    s = rewritten(spans.withColumn("__q", key(F.col("quote"))).withColumn("__t", tx.tokens(F.col("quote"))), "spans")
    c = rewritten(chunks.select("document_id", "chunk_id", "page_start", "page_end", "content").withColumn("__c", key(F.col("content"))).withColumn("__t", tx.tokens(F.col("content"))).drop("content"), "span-chunks")
    inner = F.size("__t") - 2
    grams = lambda first, last, n: F.array_distinct(F.transform(F.sequence(first, last), lambda i: F.xxhash64(F.slice("__t", i, n))))
    long_ = s.where(inner >= ANCHOR).select("*", F.explode(grams(F.lit(2), F.size("__t") - ANCHOR, F.lit(ANCHOR))).alias("__g"))
    every = c.where(F.size("__t") >= ANCHOR).select("document_id", "chunk_id", F.explode(grams(F.lit(1), F.size("__t") - ANCHOR + 1, F.lit(ANCHOR))).alias("__g"))
    asked = long_.select("document_id", "__g").distinct()
    held = rewritten(every.join(small(asked), ["document_id", "__g"], "left_semi"), "span-grams")
    seen = held.groupBy("document_id", "__g").agg(F.count(F.lit(1)).alias("__n"))
    # a gram that no chunk has tells that the quote is missing
    rare = long_.select("span_id", "document_id", "__g").join(seen, ["document_id", "__g"], "left").groupBy("span_id", "document_id").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "__g")).alias("r"))
    pairs = rare.select("span_id", "document_id", F.col("r.__g").alias("__g")).join(held, ["document_id", "__g"]).select("span_id", "chunk_id")
    for n in range(1, ANCHOR):
        own = s.where(inner == n).select("span_id", "document_id", F.xxhash64(F.slice("__t", 2, n)).alias("__g"))
        cut = c.where(F.size("__t") >= n).select("document_id", "chunk_id", F.explode(grams(F.lit(1), F.size("__t") - n + 1, F.lit(n))).alias("__g"))
        pairs = pairs.unionByName(cut.join(small(own), ["document_id", "__g"]).select("span_id", "chunk_id"))
    pages = c.select("document_id", "chunk_id", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    bare = pages.join(small(s.where(inner < 1).select("span_id", "document_id", "page")), ["document_id", "page"]).select("span_id", "chunk_id")
    met = pairs.unionByName(bare).join(s.select("span_id", "document_id", "page", "__q"), "span_id").join(c.drop("__t"), ["document_id", "chunk_id"])
    met = met.where(F.col("page").between(F.col("page_start"), F.col("page_end")) & F.contains("__c", "__q")).withColumn("excess", F.length("__c") - F.length("__q"))
    first = rank(met, "span_id", [F.col("excess"), F.col("chunk_id")], 1, "__r").select("span_id", "chunk_id")
    return spans.join(first, "span_id", "left").withColumn("status", F.when(F.col("chunk_id").isNull(), "missing").otherwise("bound"))
