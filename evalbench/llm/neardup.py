"""Operator 8: near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles, weight = occurrences * idf, idf = sqrt(1 + ln(documents / its documents)). The root keeps a rare shingle
below two and a half common ones, else the edits of a group that is most of a table would outweigh its text.
A shingle found in less than ``COMMON`` of the documents has the idf of one found in just that share (2.2), so only common shingles need
their document frequency: there are at most (mean shingles a document) / COMMON of them, they are found by a
lossy count over all documents (partial counts leave out at most a quarter of COMMON) and counted exactly in
a second pass.

Samples follow improved consistent weighted sampling: shingle s with weight w has, for sample k, variates
r, c ~ Gamma(2, 1) and b ~ U(0, 1), t = floor(ln w / r + b), and the sample is the (s, t) with the least
ln c - r * (t - b) - r. Variates come from a pool indexed by a hash of (s, k), so for the usual weight - once
in the document, not common - a sample costs a look-up; ties between shingles go to the smaller hash.
``BANDS`` bands of ``ROWS`` samples make candidates, and the exact weighted Jaccard similarity of the texts
decides: 0.8 or more links two documents.

Equal texts (as word sequences) become one vertex first. In a band's bucket the candidates are compared with
a leader; where its others are still in several components, they are filed by a prefix filter and meet until
no pair is open (see ``links``), whatever the bucket's size. Classes are the connected components.

Defined results: null and empty texts, and those of white space only, are classes of their own; texts of 1 to
4 words match only equal texts; a row with a null doc_id has a null class; repeated rows are in one class;
a doc_id on several texts is in the class of each, and such classes may have the same name; letters A-Z compare without case and white space of any length is one separator; other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalbench.llm import _text as T
from evalbench.llm._spark import release, stash, table
from evalbench.llm.graph import components

SIMILARITY = 0.8
BANDS, ROWS = 10, 3
SAMPLES = BANDS * ROWS
COMMON = 0.02
RARE_IDF = float(np.sqrt(1 - np.log(COMMON)))
POOL_BITS = 14
GROWTH = 32  # leaders of a key by round: 1, 32, 1024, ... of its largest component, 1, 4, 16, ... of all others together
GATHER = 2_000_000  # shingles that are counted together
ROUNDING = 1e-9  # of a size; covers the order of additions


# ---- document frequencies of common shingles


def _gathered(batches):
    """(documents, shingles, their rows) of about GATHER shingles at a time."""
    n, shingles, rows, held = 0, [], [], 0
    for batch in batches:
        for a, b, data, offsets in T.batches(batch.column(0)):
            starts, ends, first = T.words(data, offsets)
            s, off = T.shingles(T.word_hashes(data, starts, ends), first)
            shingles.append(s)
            rows.append((T.row_of(off) + n).astype(np.int32))
            n, held = n + b - a, held + len(s)
            if held >= GATHER:
                yield n, np.concatenate(shingles), np.concatenate(rows)
                n, shingles, rows, held = 0, [], [], 0
                release()
    if n:
        yield n, np.concatenate(shingles), np.concatenate(rows)


def _often(batches):
    """Shingles in more than a quarter of COMMON of the gathered documents, with their number."""
    seen = 0
    for n, s, rows in _gathered(batches):
        seen += n
        least = int(COMMON / 4 * n) + 1
        order = np.argsort(s)
        s = s[order]
        new = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(new, len(s)))
        big = np.flatnonzero(sizes >= least)
        if len(big):
            member = np.concatenate([order[new[i] : new[i] + sizes[i]] for i in big])
            run = np.repeat(np.arange(len(big)), sizes[big])
            docs = np.bincount(np.unique(run * n + rows[member].astype(np.int64)) // n, minlength=len(big))
            keep = docs >= least
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(T.signed(s[new[big[keep]]]), pa.int64()), "n": pa.array(docs[keep], pa.int64())})


def _recount(wanted: np.ndarray):
    def run(batches):
        total = np.zeros(len(wanted) + 1, np.int64)
        for n, s, rows in _gathered(batches):
            total[-1] += n
            at = np.minimum(np.searchsorted(wanted, s), max(len(wanted) - 1, 0))
            hit = np.flatnonzero(wanted[at] == s) if len(wanted) else np.zeros(0, np.int64)
            total[:-1] += np.bincount(np.unique(at[hit] * n + rows[hit].astype(np.int64)) // max(n, 1), minlength=len(wanted))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(there, pa.int64()), "n": pa.array(total[there], pa.int64())})

    return run


class Weights:
    """Inverse document frequencies: an array of the common shingles, one value for all others."""

    def __init__(self, shingles: np.ndarray, idf: np.ndarray):
        self.shingles, self.idf = shingles, idf

    def of(self, s: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.full(len(s), RARE_IDF)
        at = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        return np.where(self.shingles[at] == s, self.idf[at], RARE_IDF)

    def weigh(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles and their weights."""
        s, n = np.unique(s, return_counts=True)
        return s, n * self.of(s)


def weights(texts: DataFrame) -> Weights:
    """From all ``texts`` (one column)."""
    n = texts.count()
    often = texts.mapInArrow(_often, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = often.where(F.col("n") >= 0.75 * COMMON * n).select("shingle").collect()
    wanted = np.sort(np.array([r.shingle for r in found], np.int64).view(np.uint64))
    counts = np.zeros(len(wanted) + 1, np.int64)
    if len(wanted):
        for r in texts.mapInArrow(_recount(wanted), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            counts[r["at"]] = r["n"]
    df = counts[:-1]
    common = df >= max(COMMON * n, 2)
    return Weights(wanted[common], np.sqrt(1 + np.log(max(n, 1) / np.maximum(df[common], 1))))


# ---- samples


def _sortable(x: np.ndarray) -> np.ndarray:
    """float32 to uint64 keys of the same order, in the upper half."""
    bits = x.astype(np.float32).view(np.uint32)
    return np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000)).astype(np.uint64) << np.uint64(32)


class Sampler:
    def __init__(self, seed: int = 1):
        r, size = np.random.RandomState(seed), (SAMPLES, 1 << POOL_BITS)
        self.r = r.gamma(2, 1, size)
        self.log_c = np.log(r.gamma(2, 1, size))
        self.b = r.uniform(0, 1, size)
        self.odd = (r.randint(0, 1 << 31, SAMPLES).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
        self.usual_t = np.floor(np.log(RARE_IDF) / self.r + self.b)
        self.usual = _sortable(self.log_c - self.r * (self.usual_t - self.b) - self.r)

    def place(self, k: int, s32: np.ndarray) -> np.ndarray:
        return (s32 * self.odd[k]) >> np.uint32(32 - POOL_BITS)

    def sample(self, s: np.ndarray, off: np.ndarray, weigh: Weights) -> np.ndarray:
        """(rows, SAMPLES) of the 32-bit names of the sampled (shingle, t); rows without shingles hold ones."""
        n = len(off) - 1
        rows = T.row_of(off)
        usual = weigh.of(s) == RARE_IDF
        order = np.argsort(s)
        same = s[order][1:] == s[order][:-1]
        touched = np.zeros(len(s), bool)
        touched[order[1:][same]] = touched[order[:-1][same]] = True  # equal shingles, in one row or in several
        again = np.flatnonzero(touched)
        pair = np.lexsort((s[again], rows[again]))
        again = again[pair]
        twin = (s[again][1:] == s[again][:-1]) & (rows[again][1:] == rows[again][:-1])
        repeated = np.zeros(len(s), bool)
        repeated[again[1:][twin]] = repeated[again[:-1][twin]] = True
        usual &= ~repeated
        special = np.flatnonzero(~usual)
        best = np.full((n, SAMPLES), np.iinfo(np.uint64).max, np.uint64)
        s32 = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        at = np.flatnonzero(usual)
        if len(at):
            plain, plain_rows = s32[at], rows[at]
            first = np.flatnonzero(np.append(True, plain_rows[1:] != plain_rows[:-1]))
            own, wide = plain_rows[first], plain.astype(np.uint64)
            for k in range(SAMPLES):
                best[own, k] = np.minimum.reduceat(self.usual[k][self.place(k, plain)] | wide, first)
        if len(special):
            key = np.lexsort((s[special], rows[special]))
            special = special[key]
            new = np.flatnonzero(np.append(True, (s[special][1:] != s[special][:-1]) | (rows[special][1:] != rows[special][:-1])))
            times = np.diff(np.append(new, len(special)))
            special = special[new]
            log_w = np.log(times * weigh.of(s[special]))
            names, special_rows = s32[special], rows[special]
            first = np.flatnonzero(np.append(True, special_rows[1:] != special_rows[:-1]))
            own = special_rows[first]
            for k in range(SAMPLES):
                i = self.place(k, names)
                r, b = self.r[k][i], self.b[k][i]
                t = np.floor(log_w / r + b)
                shift = (t - self.usual_t[k][i]).astype(np.int64).astype(np.uint32) * np.uint32(0x9E3779B1)
                key = _sortable(self.log_c[k][i] - r * (t - b) - r) | (names ^ shift).astype(np.uint64)
                best[own, k] = np.minimum(best[own, k], np.minimum.reduceat(key, first))
        return (best & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    @staticmethod
    def bands(samples: np.ndarray) -> np.ndarray:
        out = np.zeros((len(samples), BANDS), np.uint64)
        for band in range(BANDS):
            h = np.full(len(samples), band + 1, np.uint64)
            for j in range(ROWS):
                h = T.mix(h * np.uint64(0x9E3779B97F4A7C15) + samples[:, band * ROWS + j])
            out[:, band] = h
        return out


@functools.cache
def sampler(seed: int = 1) -> Sampler:
    return Sampler(seed)


def signatures(docs: DataFrame, weigh: Weights, seed: int = 1) -> DataFrame:
    """doc_id and text_hash as given, two hashes of the word sequence, whether there are words, and the band hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(weigh)

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in T.batches(batch.column(1)):
                starts, ends, first = T.words(data, offsets)
                h = T.word_hashes(data, starts, ends)
                s, off = T.shingles(h, first)
                bands = sampler(seed).bands(sampler(seed).sample(s, off, shared.value))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(a, b - a),
                    "text_hash": batch.column(2).slice(a, b - a),
                    "h1": pa.array(T.signed(T.sequence_hash(h, first, 0xD1342543DE82EF95)), pa.int64()),
                    "h2": pa.array(T.signed(T.sequence_hash(h, first, 0xAF251AF3B0F025B5)), pa.int64()),
                    "words": pa.array(np.diff(first) > 0, pa.bool_()),
                    "bands": pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * BANDS, BANDS), pa.int32()), pa.array(T.signed(bands.reshape(-1)), pa.int64())),
                })
            release()

    return docs.select("doc_id", "text", "text_hash").mapInArrow(run, "doc_id long, text_hash long, h1 long, h2 long, words boolean, bands array<long>")


# ---- candidates and links


def _verify(shared, least: float):
    """Pairs (a, b, left, right) into those with a weighted Jaccard similarity of ``least`` or more."""

    def run(batches):
        last, kept = None, None
        for batch in batches:
            first, second = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for i, a in enumerate(first):
                if a != last:
                    last, kept = a, _weighted(batch.column(2).slice(i, 1), shared.value)
                good.append(similarity(kept, _weighted(batch.column(3).slice(i, 1), shared.value)) >= least)
            release()
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good, pa.bool_())) for i in (0, 1)], ["a", "b"])

    return run


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets (sorted distinct shingles, weights)."""
    at = np.minimum(np.searchsorted(x[0], y[0]), len(x[0]) - 1)
    shared = np.minimum(np.where(x[0][at] == y[0], x[1][at], 0), y[1]).sum()
    return float(shared / (x[1].sum() + y[1].sum() - shared))


def _weighted(column: pa.Array, weigh: Weights) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = T.utf8(column)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    starts, ends, first = T.words(data, offsets)
    return weigh.weigh(T.shingles(T.word_hashes(data, starts, ends), first)[0])


def _spell(shared):
    """(doc_id, component, text) into a row a distinct shingle, with its weight and that of the whole text."""

    def run(batches):
        for batch in batches:
            ids, parts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, b, data, offsets in T.batches(batch.column(2)):
                starts, ends, first = T.words(data, offsets)
                s, off = T.shingles(T.word_hashes(data, starts, ends), first)
                rows = T.row_of(off)
                order = np.lexsort((s, rows))
                s, rows = s[order], rows[order]
                new = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (rows[1:] != rows[:-1]))[: len(s)])
                weight = np.diff(np.append(new, len(s))) * shared.value.of(s[new])
                s, rows = s[new], rows[new]
                size = np.bincount(rows, weight, minlength=b - a)
                yield pa.RecordBatch.from_pydict({"doc_id": ids[a:b][rows], "component": parts[a:b][rows], "size": size[rows], "shingle": T.signed(s), "weight": weight})
            release()

    return run


def prefixes(texts: DataFrame, weigh, least: float) -> DataFrame:
    """``key, doc_id, component, size, before``: of each text (doc_id, component, text) the shingles that may be its first in common with a linked text of another component.

    Shingles are ordered: those of one component alone, which are nowhere in common, then the others, rare ones
    first. x and y are linked if what they share is T (x + y) or more, with T = least / (1 + least), and none is
    linked to a text of less than ``least`` times its size. So what stands before their first common shingle,
    which y lacks, has at most the weight (1 - T) x - T y <= (1 - least) x.
    """
    spelt = stash(texts.mapInArrow(_spell(weigh), "doc_id long, component long, size double, shingle long, weight double"), "neardup-spelt")
    held = spelt.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("shingle", "n")
    own = Window.partitionBy("doc_id")
    lighter = F.coalesce(F.sum("weight").over(own.orderBy("n", "shingle").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    keyed = spelt.join(held, "shingle").withColumn("before", F.col("size") - F.sum("weight").over(own) + lighter)
    return keyed.where(F.col("before") <= (1 - least + ROUNDING) * F.col("size")).select(F.col("shingle").alias("key"), "doc_id", "component", "size", "before")


def links(texts: DataFrame, members: DataFrame, weigh: Weights, least: float = SIMILARITY) -> DataFrame:
    """``id, component`` of linked documents among ``members`` (bucket, doc_id) of buckets with two or more.

    ``texts`` (doc_id, text) holds the members' texts. Every member is compared with its bucket's leader, the one
    that meets most others in all its buckets, as an original does among its copies. A bucket is settled if its
    other members are in one component then. The members of the rest are filed under their prefixes (see
    ``prefixes``), so any linked pair of two components meets under its first common shingle. Under a key, one member
    of the largest component and one of all others lead, those that meet most in their buckets: they are compared with all
    of other components that the order allows at that place, and leave the key. Components that are linked grow
    together, so most keys are settled soon; then more lead by round, of the largest component and of all others
    together, until every key is settled. So what meets under a key is its members times the leaders of the round, however
    many components it has, no pair of a bucket that is linked stays between two components, and there is no limit on
    what is compared.
    """
    shared = texts.sparkSession.sparkContext.broadcast(weigh)
    share = least / (1 + least)

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.withColumnsRenamed({"doc_id": "b", "text": "right"}), "b").join(texts.withColumnsRenamed({"doc_id": "a", "text": "left"}), "a")
        return stash(both.select("a", "b", "left", "right").mapInArrow(_verify(shared, least), "a long, b long"), "neardup-links")

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))

    def fits(x: str, before: str, y: str) -> F.Column:
        return F.col(before) <= (1 - share + ROUNDING) * F.col(x) - share * F.col(y)

    central = members.join(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket").groupBy("doc_id").agg(F.sum(-F.col("n")).alias("central"))
    head = members.join(central, "doc_id").groupBy("bucket").agg(F.min(F.struct("central", "doc_id")).alias("h")).select("bucket", F.col("h.doc_id").alias("leader"))
    rest = stash(members.join(head, "bucket").where("doc_id <> leader"), "neardup-rest")
    found = verified(rest.select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct())
    joined = components(found)
    open_ = labelled(rest).groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    wanted = labelled(rest.join(open_, "bucket", "left_semi").select("doc_id").distinct())
    left = prefixes(wanted.join(texts, "doc_id").select("doc_id", "component", "text"), shared, least)
    left = stash(left.join(central, "doc_id"), "neardup-prefixes")
    many, few = 1, 1
    while True:
        sized = left.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
        unsettled = sized.groupBy("key").agg(F.max(F.struct("c", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        left = stash(left.join(unsettled.select("key", F.col("top.component").alias("top")), "key"), "neardup-open")
        if left.isEmpty():
            return joined
        turn = F.row_number().over(Window.partitionBy("key", F.col("component") == F.col("top")).orderBy("central", "before", "doc_id"))
        lead = left.withColumn("turn", turn).where(F.col("turn") <= many).where((F.col("component") == F.col("top")) | (F.col("turn") <= few))
        lead = lead.select("key", F.col("doc_id").alias("leader"), F.col("component").alias("other"), F.col("size").alias("led"), F.col("before").alias("ahead"))
        pairs = left.join(lead, "key").where(F.col("component") != F.col("other")).where(fits("size", "before", "led") & fits("led", "ahead", "size"))
        more = verified(pairs.select(F.least("leader", "doc_id").alias("a"), F.greatest("leader", "doc_id").alias("b")).distinct())
        left = left.drop("top").join(lead.select("key", F.col("leader").alias("doc_id")), ["key", "doc_id"], "left_anti")
        many, few = many * GROWTH, few * GROWTH // 8
        if not more.isEmpty():
            found = found.unionByName(more)
            joined = components(found)
            left = labelled(left.drop("component"))


def _classed(docs: DataFrame, seed: int, least: float) -> DataFrame:
    """doc_id, text_hash, whether there are words, and ``first``: the row (doc_id, text_hash) that stands for the class.

    A vertex is a word sequence, whatever ids it has; its number is its own, as one id may have several texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    weigh = weights(rows.select("text"))
    signed = stash(signatures(rows, weigh, seed), "neardup-signatures")
    vertices = signed.where(F.col("doc_id").isNotNull() & F.col("words")).groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("bands").alias("bands"))
    vertices = stash(vertices.withColumn("vertex", F.monotonically_increasing_id()), "neardup-vertices")
    exploded = vertices.select(F.explode("bands").alias("bucket"), F.col("vertex").alias("doc_id"))
    shared = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = stash(exploded.join(shared, "bucket"), "neardup-members")
    wanted = vertices.join(members.select(F.col("doc_id").alias("vertex")).distinct(), "vertex").select("vertex", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
    texts = stash(rows.join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["vertex"]).select(F.col("vertex").alias("doc_id"), "text"), "neardup-texts")
    joined = links(texts, members, weigh, least).withColumnRenamed("id", "vertex")
    least_first = vertices.join(joined, "vertex").groupBy("component").agg(F.min("first").alias("of_class"))
    linked = joined.join(least_first, "component").select("vertex", "of_class")
    by_text = vertices.select("h1", "h2", "vertex", "first").join(linked, "vertex", "left").select("h1", "h2", F.coalesce("of_class", "first").alias("first"))
    return signed.select("doc_id", "text_hash", "h1", "h2", (F.col("words") & F.col("doc_id").isNotNull()).alias("words")).join(by_text, ["h1", "h2"], "left").drop("h1", "h2")


def classes(docs: DataFrame, seed: int = 1, least: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of the class) for every row of ``docs`` (doc_id, text)."""
    return _classed(docs, seed, least).select("doc_id", F.when(F.col("words"), F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("class_id"))


def keep_one(docs: DataFrame, seed: int = 1) -> DataFrame:
    """``docs`` with one row of each class: that with the smallest doc_id; rows with a null doc_id stay.

    Rows are told apart by id and text: of an id on several texts, each text's class keeps its row.
    """
    first = F.struct("doc_id", "text_hash")
    others = _classed(docs, seed, SIMILARITY).where(F.col("words") & (first != F.col("first"))).select(F.col("doc_id").alias("__other"), F.col("text_hash").alias("__other_text")).distinct()
    told = docs.withColumn("__text", F.xxhash64("text"))
    kept = told.join(others, (told["doc_id"].cast("long") == F.col("__other")) & (F.col("__text") == F.col("__other_text")), "left_anti")
    whole = kept.where("doc_id is null")
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", "__text"]).unionByName(whole).drop("__text")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
