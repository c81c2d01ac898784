"""Operator 10: document quality by nearest-neighbour voting among labelled latent-semantic vectors.

A document's terms are its byte bigrams and the levels of four form statistics (repeated words, distinct
words, distinct word pairs, length). Terms are weighted by frequency and inverse document frequency - the
latter counted over every document - and projected on the leading singular directions of the labelled
documents. The labelled vectors are broadcast, cosines are computed in blocks against all of them, and the
``NEIGHBOURS`` nearest vote with weight cosine ** ``SHARPNESS``.

Bounds: at most ``PER_CLASS`` labelled documents of each class are used (those with the smallest hashes of
their id); their counts are sparse in the driver and their singular directions come from products with them, so what is broadcast has at most 2 * PER_CLASS vectors of ``DIMENSIONS`` numbers and a projection
of at most 65,536 + 21 rows. Everything else covers all rows.

Defined results: a null text counts as empty; an empty text is scored like any other; a null doc_id counts as
the empty text for the fold and is never labelled; labels that are null or neither 0 nor 1 are ignored, a
document labelled twice has its smaller label, one with several texts is learned by that of the least hash; equally near
neighbours count in the order of their texts' hashes; repeated rows give repeated results; with no usable label
every score is 0.5; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalbench.llm import _text as T
from evalbench.llm._spark import crc_part, release, table

PER_CLASS = 1500
DIMENSIONS = 64
NEIGHBOURS = 15
SHARPNESS = 8
FORM_WEIGHT = 0.3
LEAST_DOCS = 3
ROWS = 256  # texts whose counts are held together
CELLS = 1 << 20  # counts of labelled texts that are dense at a time, or those of 16 texts
#: Levels of the form statistics.
EDGES = ((0.01, 0.05, 0.2), (0.2, 0.4, 0.6, 0.8, 0.9), (0.3, 0.6, 0.8, 0.9, 0.95), (1.5, 3, 4.5, 6, 7.5, 9))
FORMS = sum(len(e) + 1 for e in EDGES)


def bigrams(text: np.ndarray) -> np.ndarray:
    return text[:-1].astype(np.int32) << 8 | text[1:]


def form_statistics(h: np.ndarray) -> tuple[float, float, float, float]:
    n = len(h)
    if n < 2:
        return 0.0, 1.0, 1.0, float(np.log(max(n, 1)))
    pairs = h[:-1] * T.U64(31) + h[1:]
    return float((h[1:] == h[:-1]).mean()), len(np.unique(h)) / n, len(np.unique(pairs)) / len(pairs), float(np.log(n))


def form_levels(stats: np.ndarray) -> np.ndarray:
    return np.concatenate([np.eye(len(e) + 1, dtype=np.float32)[np.digitize(stats[:, j], e)] for j, e in enumerate(EDGES)], axis=1)


def counted(column: pa.Array, place: np.ndarray):
    """(first row, counts of the placed bigrams, all bigrams, form statistics) of each slice of texts."""
    width = int(place.max(initial=-1)) + 1
    for a, b, data, offsets in T.batches(column, 1 << 20, ROWS):
        starts, ends, first = T.words(data, offsets)
        h = T.word_hashes(data, starts, ends, lower=False)
        counts, stats = np.zeros((b - a, width), np.float32), np.zeros((b - a, 4))
        for i in range(b - a):
            at = place[bigrams(data[offsets[i] : offsets[i + 1]])]
            counts[i] = np.bincount(at[at >= 0], minlength=width)
            stats[i] = form_statistics(h[first[i] : first[i + 1]])
        yield a, counts, np.maximum(np.diff(offsets) - 1, 0), stats


class Rows:
    """Counts or weights of placed bigrams by document; only a block of rows is dense at a time."""

    def __init__(self, offsets: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.offsets, self.columns, self.values, self.width = offsets, columns, values, width

    def blocks(self):
        n, step = len(self.offsets) - 1, max(16, min(ROWS, CELLS // max(self.width, 1)))
        return ((a, min(a + step, n)) for a in range(0, n, step))

    def cells(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(b - a), np.diff(self.offsets[a : b + 1])), self.columns[self.offsets[a] : self.offsets[b]]

    def dense(self, a: int, b: int) -> np.ndarray:
        out = np.zeros((b - a, self.width), np.float32)
        out[self.cells(a, b)] = self.values[self.offsets[a] : self.offsets[b]]
        return out


def leading(times, n: int, k: int, steps: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their vectors of a symmetric matrix of ``n`` rows, given by its product with columns.

    Products of a block of columns, made orthogonal, span a space whose best vectors begin the next round, until their
    images are multiples of them (to 1e-5 of the largest). The matrix itself is never held; a small one is solved at once.
    """
    width = k + 32
    if n <= steps * width + k:
        values, vectors = np.linalg.eigh(times(np.eye(n)))
        return values[::-1][:k], vectors[:, ::-1][:, :k]
    q = np.linalg.qr(np.random.RandomState(1).standard_normal((n, width)))[0]
    for _ in range(50):
        basis, images = q, times(q)
        while basis.shape[1] < steps * width:
            new = images[:, -width:]
            for _ in range(3):
                new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
            basis, images = np.concatenate([basis, new], axis=1), np.concatenate([images, times(new)], axis=1)
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:width], turn[:, ::-1][:, :width]
        q, image = basis @ turn, images @ turn
        if np.linalg.norm(image - q * values, axis=0)[:k].max() <= 1e-5 * abs(values[0]):
            break
        q = np.linalg.qr(q)[0]
    return values[:k], q[:, :k]


class Voter:
    """The fitted model: all arrays are bounded by the module's constants."""

    def __init__(self, place: np.ndarray, idf: np.ndarray, rows: Rows, totals: np.ndarray, stats: np.ndarray, labels: np.ndarray):
        self.place, self.idf, self.labels = place, idf.astype(np.float32), labels.astype(np.float32)
        self.projection = np.zeros((len(idf) + FORMS, 0), np.float32)
        if len(labels):
            forms = np.zeros((len(labels), FORMS), np.float32)
            weighed = Rows(rows.offsets, rows.columns, np.zeros(len(rows.columns), np.float32), rows.width)
            for a, b in rows.blocks():
                x = self.weigh(rows.dense(a, b), totals[a:b], stats[a:b])
                weighed.values[rows.offsets[a] : rows.offsets[b]] = x[rows.cells(a, b)]
                forms[a:b] = x[:, rows.width :]
            each = lambda: ((a, b, np.concatenate([weighed.dense(a, b), forms[a:b]], axis=1)) for a, b in rows.blocks())

            def onto(left: np.ndarray) -> np.ndarray:
                left, out = left.astype(np.float32), np.zeros((rows.width + FORMS, left.shape[1]), np.float32)
                for a, b, x in each():
                    out += x.T @ left[a:b]
                return out

            def gram(left: np.ndarray) -> np.ndarray:
                right = onto(left)
                return np.concatenate([x @ right for _, _, x in each()]).astype(float)

            # leading right singular vectors, by the left ones
            values, left = leading(gram, len(labels), DIMENSIONS)
            keep = values > 1e-6 * max(values[0], 1)
            self.projection = onto(left[:, keep]) / np.sqrt(values[keep]).astype(np.float32)
            self.vectors = np.concatenate([self.project(x) for _, _, x in each()])

    def weigh(self, counts: np.ndarray, totals: np.ndarray, stats: np.ndarray) -> np.ndarray:
        x = np.log1p(counts * (1000 / (totals[:, None] + 20)).astype(np.float32)) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        return np.concatenate([x, FORM_WEIGHT * form_levels(stats)], axis=1).astype(np.float32)

    def project(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.projection
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def votes(self, vectors: np.ndarray) -> np.ndarray:
        near = np.maximum(vectors @ self.vectors.T, 0)
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        # where the last place is shared, those that stand first have it: they stand by a hash of their texts
        shared = np.flatnonzero((near >= np.take_along_axis(near, top, 1).min(1, keepdims=True)).sum(1) > k)
        top[shared] = np.argsort(-near[shared], axis=1, kind="stable")[:, :k]
        weight = np.take_along_axis(near, top, 1).astype(np.float64) ** SHARPNESS
        total = weight.sum(1)
        return np.where(total > 0, (weight * self.labels[top]).sum(1) / np.maximum(total, 1e-300), self.labels.mean())

    def score(self, column: pa.Array) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(column), 0.5)
        out = np.zeros(len(column))
        for a, counts, totals, stats in counted(column, self.place):
            out[a : a + len(counts)] = self.votes(self.project(self.weigh(counts, totals, stats)))
        return np.clip(out, 0.0, 1.0)


def training_labels(labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id and label of the training rows: outside the held-out fold, at most ``per_class`` of each class."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (crc_part(F.col("doc_id"), 3) != 1))
    usable = usable.groupBy("doc_id").agg(F.min("label").alias("label"))
    each = [usable.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return each[0].unionByName(each[1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Voter:
    """Learn from labelled ``docs`` (doc_id, text); document frequencies cover all of ``docs``."""
    spark = docs.sparkSession
    chosen = {r.doc_id: r.label for r in training_labels(labels, per_class).collect()}  # at most 2 * per_class
    rows = spark.createDataFrame(sorted(chosen.items()), "id long, label int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))

    def sparse(batches):
        everything = np.arange(1 << 16)
        for batch in batches:
            ids, seen, counts, stats = batch.column(0), [], [], []
            for _, c, _, s in counted(batch.column(1), everything):
                for row in c:
                    at = np.flatnonzero(row)
                    seen.append(at.astype("<u2").tobytes())
                    counts.append(row[at].astype("<f4").tobytes())
                stats += s.tolist()
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(seen, pa.binary()), pa.array(counts, pa.binary()), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "text_hash", "at", "counts", "stats"])

    labelled = texts.join(F.broadcast(rows), texts.doc_id == rows.id, "left_semi").groupBy("doc_id").agg(F.min_by("text", F.struct("text_hash", "text")).alias("text"), F.min("text_hash").alias("text_hash"))
    found = labelled.mapInArrow(sparse, "doc_id long, text_hash long, at binary, counts binary, stats array<double>").collect() if chosen else []
    found.sort(key=lambda r: (r.text_hash, chosen[r.doc_id]))
    at = [np.frombuffer(r["at"], "<u2") for r in found]
    frequency = np.bincount(np.concatenate([*at, np.zeros(0, np.uint16)]), minlength=1 << 16)
    columns = np.flatnonzero(frequency >= min(LEAST_DOCS, max(len(found), 1)))
    place = np.full(1 << 16, -1, np.int32)
    place[columns] = np.arange(len(columns))
    own, totals = [np.frombuffer(r["counts"], "<f4") for r in found], np.zeros(len(found))
    for i, counts in enumerate(own):
        totals[i] = counts.sum()
        keep = place[at[i]] >= 0
        at[i], own[i] = place[at[i][keep]], counts[keep]
    counts = Rows(np.cumsum([0, *map(len, at)]), np.concatenate([*at, np.zeros(0, np.int32)]), np.concatenate([*own, np.zeros(0, np.float32)]), len(columns))
    n, df = document_frequencies(texts, place)
    idf = np.log((1 + n) / (1 + df)) + 0.2
    return Voter(place, idf, counts, totals, np.array([r["stats"] for r in found]).reshape(-1, 4), np.array([chosen[r.doc_id] for r in found]))


def document_frequencies(texts: DataFrame, place: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of documents, and of those that hold each placed bigram; one partial sum a task and bigram."""
    width = int(place.max(initial=-1)) + 1

    def run(batches):
        n, df = 0, np.zeros(width, np.int64)
        for batch in batches:
            n += batch.num_rows
            for _, _, data, offsets in T.batches(batch.column(0), 1 << 20):
                for i in range(len(offsets) - 1):
                    at = place[np.flatnonzero(np.bincount(bigrams(data[offsets[i] : offsets[i + 1]]), minlength=1))]
                    df[at[at >= 0]] += 1
        release()
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(-1, width), pa.int32()), "n": pa.array(np.concatenate([[n], df]), pa.int64())})

    rows = texts.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(width + 1, np.int64)
    for r in rows:
        out[r["at"] + 1] = r["n"]
    return int(out[0]), out[1:]


def score(docs: DataFrame, voter: Voter, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with ``score``, which takes the place of a column of that name."""
    columns = [c for c in columns or docs.columns if c.lower() != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(voter)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shared.value.score(batch.column(batch.num_columns - 1)), pa.float64())], [*batch.schema.names[:-1], "score"])

    kept = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias("__text"))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return kept.mapInArrow(run, f"{fields}, score double")


def accepted(docs: DataFrame, voter: Voter, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, with their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(voter)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(batch.column(at)) >= least))
        release()

    return docs.mapInArrow(run, docs.schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", (crc_part(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
