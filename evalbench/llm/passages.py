"""Operator 7: passages that repeat across documents, by compact windows.

For each of two hash functions a text's five-word shingles are hashed. The Cartesian tree of the hashes cuts the
text into compact windows (l, c, r): every stretch of shingles inside [l, r] that holds c has its least hash at
c. The windows of ``STRETCH`` shingles or more belong to the positions that are the least of some stretch of
that length, so sliding minima find them for many texts at a time, and the stretches whose least is c make up
[l, r]. Joining the windows of the two functions by their intervals gives the pairs (c, c') that are the two
signatures of a common stretch, about 4 n / STRETCH of them. A text is filed under the hashes of each pair.

Passages have PASSAGE words or more and a Jaccard similarity of 0.8 or more. In n shingles that allows at most
n / 45 changed words, which leave some STRETCH shingles in a row unchanged: these are in both texts, so both are
filed under their signatures. So both functions must agree, and of two texts alone one pair of them is enough.

What only one text is filed under goes. Under a key, members are compared with the one of smallest text id:
equal words around c are extended both ways, and else the longest stretch around c is sought whose shingles are
in the leader's text near the same place, with the similarity of 0.8; both read the whole texts. A member that
is not in a passage there is filed anew, under longer stretches of its words around those that the key stands for
(see ``refile``). These depend on the key alone, so members that share an equal passage meet again, and after three
rounds equal keys mean equal passages. Members that share a passage with changes meet again by min-hash: each is also
filed under the ``NEARBY`` least of the shingles around the key (see ``nearby``), so two that share what lies beyond a
common phrase meet apart from the texts that have the phrase alone. So groups of a frequent phrase split by their
surroundings, and no pairs within a group are made.

Documents are known by a hash of their words in order, so equal texts are one from the start.

Defined results: null, empty and short texts have no passages; passages within one document do not count, but
a text of PASSAGE words or more under several ids is one; rows repeated with the same id are one document; rows with a null doc_id take no part; letters A-Z compare without case; other columns are not read.
Positions are words, end exclusive. A phrase that stands in a text at several places is filed at each of them, but once
where it follows itself.
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
from evalbench.llm._text import sequence_hash

PASSAGE = 50  # words
WIDTH = 5
LEAST = PASSAGE - WIDTH + 1  # shingles
STRETCH = 20  # shingles; with n / 45 changed words, the longest unchanged run of n >= LEAST shingles is no shorter
SIMILARITY = 0.8
SHARE = SIMILARITY * 2 / (1 + SIMILARITY)  # of the shingles of one of two equally long passages that the other has
DRIFT = 0.25  # words inserted or left out, by distance
CONTEXT = 0xAF251AF3B0F025B5
AROUND, NEARBY = 24, 8  # shingles on either side of a key, and how many of them an unsettled member is filed under
PARTS = 4
ROWS = 16_384  # of a batch of results


def leasts(x: np.ndarray, length: int) -> np.ndarray:
    """The least of each run of ``length`` values."""
    done, m = 1, x
    while 2 * done <= length:
        m = np.minimum(m[: len(m) - done], m[done:])
        done *= 2
    return np.minimum(m[: len(x) - length + 1], m[length - done : length - done + len(x) - length + 1])


def compact_windows(h: np.ndarray, off: np.ndarray, length: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``length`` inside each row, by their first place, and the place of each one's least hash (the first of equal ones)."""
    bits = max(8, len(h).bit_length())
    packed = (h >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(h), dtype=np.uint64)
    starts = np.arange(max(0, len(h) - length + 1))
    ends = off[1:][np.searchsorted(off[1:], starts, side="right")] if len(starts) else starts
    inside = starts + length <= ends
    c = (leasts(packed, length) & np.uint64((1 << bits) - 1)).astype(np.int64) if len(starts) else starts
    return starts[inside], c[inside]


def entries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of some texts: key, row, place (of the first function's least) and the place of the second's, of each joined pair of windows."""
    starts, ends, first = T.words(data, offsets)
    h = T.word_hashes(data, starts, ends)
    s, off = T.shingles(h, first)
    a, b = (T.mix(s ^ np.uint64(seed)) for seed in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
    at, c = compact_windows(a, off)
    _, d = compact_windows(b, off)
    rows = np.searchsorted(off, at, side="right") - 1
    long = np.diff(first)[rows] >= PASSAGE if len(rows) else np.zeros(0, bool)
    c, d, rows = c[long], d[long], rows[long]
    # the windows' intervals end where a least changes; places of one value that follow each other, as in a repeated line, are one
    new = np.append(True, (a[c[1:]] != a[c[:-1]]) | (b[d[1:]] != b[d[:-1]]) | (rows[1:] != rows[:-1]))[: len(c)]
    c, d, rows = c[new], d[new], rows[new]
    return T.mix(a[c] * np.uint64(0x9E3779B97F4A7C15) + b[d]), rows, c - off[rows], d - off[rows]


def known_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text_id and words of each (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in T.batches(batch.column(1)):
                starts, ends, first = T.words(data, offsets)
                ids = T.signed(sequence_hash(T.word_hashes(data, starts, ends), first, 0xD1342543DE82EF95))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "text_id": ids, "words": pa.array(np.diff(first), pa.int64())})
            release()

    return docs.mapInArrow(run, "doc_id long, text_id long, words long")


_UNIT = "bucket long, text_id long, place int, hi int, near boolean"


def _file(batches):
    """(text) into what it is filed under: bucket, text_id, and the words [place, hi) that its key stands for."""
    for batch in batches:
        for _, _, data, offsets in T.batches(batch.column(0)):
            keys, rows, c, d = entries(data, offsets)
            starts, ends, first = T.words(data, offsets)
            ids = T.signed(sequence_hash(T.word_hashes(data, starts, ends), first, 0xD1342543DE82EF95))
            yield pa.RecordBatch.from_pydict({"bucket": T.signed(keys), "text_id": ids[rows], "place": pa.array(np.minimum(c, d), pa.int32()), "hi": pa.array(np.maximum(c, d) + WIDTH, pa.int32()), "near": pa.array(np.zeros(len(c), bool))})
        release()


def led(units: DataFrame) -> DataFrame:
    """The units of keys that two texts or more hold, with the least (text_id, place) of the key as ``leader`` and ``leader_place``."""
    key = Window.partitionBy("bucket")
    held = units.withColumn("h", F.min(F.struct("text_id", "place")).over(key)).withColumn("most", F.max("text_id").over(key)).where("h.text_id < most")
    return held.select("text_id", "place", "hi", "near", F.col("h.text_id").alias("leader"), F.col("h.place").alias("leader_place")).where("text_id <> leader or place <> leader_place")


def _around(hit: np.ndarray, at: int) -> list[tuple[int, int]]:
    """Stretches [i, j) of LEAST shingles or more around ``at`` of which SHARE are hits: the longest one and the densest one."""
    sums = np.concatenate([[0.0], np.cumsum(hit - SHARE)])
    low = np.minimum.accumulate(sums[: at + 1])
    ends = np.arange(at + 1, len(sums))
    begins = np.searchsorted(-low, -(sums[ends] + 1e-9), side="left")
    fits = np.flatnonzero((begins <= at) & (ends - begins >= LEAST))
    out = []
    if len(fits):
        best = fits[int((ends[fits] - begins[fits]).argmax())]
        out.append((int(begins[best]), int(ends[best])))
        i, j = int(sums[: at + 1].argmin()), at + 1 + int(sums[at + 1 :].argmax())
        if j - i >= LEAST and (i, j) != out[0]:
            out.append((i, j))
    return out


class Text:
    """Words of a text by hash, with its shingles sorted by (value, place)."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.shingles, _ = T.shingles(words, np.array([0, len(words)]))

    def sort(self) -> None:
        if not hasattr(self, "values"):
            self.values, rank = np.unique(self.shingles, return_inverse=True)
            self.step = np.int64(len(self.shingles) + 1)
            self.order = np.sort(rank * self.step + np.arange(len(rank)))

    def nearest(self, shingles: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The place nearest to ``wanted`` of each shingle, -1 where there is none."""
        self.sort()
        rank = np.minimum(np.searchsorted(self.values, shingles), len(self.values) - 1)
        there = self.values[rank] == shingles
        low = rank * self.step
        at = np.searchsorted(self.order, low + np.clip(wanted, 0, self.step - 1))
        best = np.full(len(shingles), -1)
        for k in (at - 1, at):
            inside = (k >= 0) & (k < len(self.order))
            place = np.where(inside, self.order[np.clip(k, 0, len(self.order) - 1)] - low, -1)
            good = there & (place >= 0) & (place < self.step - 1)
            closer = good & ((best < 0) | (np.abs(place - wanted) < np.abs(best - wanted)))
            best = np.where(closer, place, best)
        return best


def near(left: Text, right: Text, diagonal: int, at: int) -> tuple[int, int, int, int, float] | None:
    """A passage (left start, left end, start, end, similarity) around shingle ``at`` of ``right`` like the one ``diagonal`` before in ``left``."""
    places = np.arange(len(right.shingles))
    found = left.nearest(right.shingles, places - diagonal)
    hit = (found >= 0) & (np.abs(found - places + diagonal) <= WIDTH + DRIFT * np.abs(places - at))
    for i, j in _around(hit, at):
        ends = np.flatnonzero(hit[i:j])[[0, -1]]
        if ends[1] - ends[0] + 1 >= LEAST:
            i, j = i + int(ends[0]), i + int(ends[1]) + 1
        where = found[i:j][hit[i:j]]
        lo, hi = int(where.min()), int(where.max())
        if hi - lo + 1 >= LEAST:
            x, y = np.unique(left.shingles[lo : hi + 1]), np.unique(right.shingles[i:j])
            both = len(np.intersect1d(x, y, assume_unique=True))
            similar = both / (len(x) + len(y) - both)
            if similar >= SIMILARITY:
                return lo, hi + WIDTH, i, j + WIDTH - 1, similar
    return None


def stretches(left: np.ndarray, right: np.ndarray, diagonal: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end, in ``right``, of the equal words around each place ``at`` (ascending) when ``left`` is ``diagonal`` before."""
    lo, hi = max(0, diagonal), min(len(right), len(left) + diagonal)
    unequal = np.flatnonzero(left[lo - diagonal : hi - diagonal] != right[lo:hi]) + lo
    i = np.searchsorted(unequal, at)
    edges = np.concatenate([[lo - 1], unequal, [hi]])
    return edges[i] + 1, edges[i + 1]


def refile(words: np.ndarray, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(key, lo, hi) of stretches around the words [lo, hi), one of which lies in any passage that holds them.

    Of the words that a passage has besides, some number stands before: it falls into one of PARTS ranges, each of
    which grants so many words before and so many after. The key is a hash of all words of the stretch.
    """
    lack = PASSAGE - (hi - lo)
    step, out = -(-lack // PARTS), []
    for before in range(0, lack + 1, max(1, step)):
        a, b = lo - before, hi + max(0, lack - before - step + 1)
        if lack > 0 and a >= 0 and b <= len(words):
            own = (words[a:b] * T.powers(CONTEXT, b - a + 1)[1:]).sum(dtype=np.uint64)
            out.append((int(T.signed(T.mix(np.array([own + np.uint64(b - a)])))[0]), a, b))
    return out


def nearby(text: Text, lo: int, hi: int) -> list[int]:
    """Keys of the words [lo, hi), told by their first and last shingle, with each of the least NEARBY shingles around them."""
    s, last = text.shingles, hi - WIDTH
    around = np.unique(np.concatenate([s[max(0, lo - AROUND) : lo], s[last + 1 : last + 1 + AROUND]]))
    hashed = T.mix(around ^ np.uint64(CONTEXT))
    least = around[np.argsort(hashed)[:NEARBY]]
    anchor = T.mix(s[[lo]] * np.uint64(0x9E3779B97F4A7C15) + s[[last]])
    return T.signed(T.mix(anchor ^ T.mix(least))).tolist()


def compare(left: Text, right: Text, left_at: np.ndarray, right_at: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """Shared passages (left start, left end, start, end, similarity), and which meets are in none."""
    order = np.lexsort((right_at, right_at - left_at))
    at, diagonals = right_at[order], (right_at - left_at)[order]
    start, end = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    cuts = np.flatnonzero(np.append(True, diagonals[1:] != diagonals[:-1]))
    for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        start[a:b], end[a:b] = stretches(left.words, right.words, int(diagonals[a]), at[a:b])
    whole = end - start >= PASSAGE
    found = [(a - d, b - d, a, b, 1.0) for d, a, b in {(int(d), int(a), int(b)) for d, a, b in zip(diagonals[whole], start[whole], end[whole], strict=True)}]
    short = np.ones(len(order), bool)
    for a, b in {(f[2], f[3]) for f in found}:
        short &= (at < a) | (at >= b)
    tried: set[tuple[int, int]] = set()  # meets in one run of equal words have one answer
    for i in np.flatnonzero(short):
        run = (int(diagonals[i]), int(start[i]))
        if not short[i] or run in tried:
            continue
        tried.add(run)
        more = near(left, right, run[0], int(at[i]))
        if more:
            found.append(more)
            short &= (at < more[2]) | (at >= more[3])
    out = np.zeros(len(order), bool)
    out[order] = short
    return found, out


_OUT = "leader long, text_id long, leader_start int, leader_end int, start int, end int, similarity double, bucket long, place int, hi int, near boolean"
_COMPARED = pa.schema([("leader", pa.int64()), ("text_id", pa.int64()), *((n, pa.int32()) for n in ("leader_start", "leader_end", "start", "end")), ("similarity", pa.float64()), ("bucket", pa.int64()), *((n, pa.int32()) for n in ("place", "hi")), ("near", pa.bool_())])


def _judged(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_COMPARED)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _COMPARED, strict=True)], schema=_COMPARED)


def _compare(batches, first: bool):
    """Pairs (leader, text_id, meets, left, right) into passages, and into units filed anew; places of one text are only filed anew. Surroundings count in the ``first`` round."""
    last, left = None, None
    for batch in batches:
        rows: list[tuple] = []
        leaders, members = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        meets = batch.column(2)
        inner = meets.flatten()
        left_at, right_at, hi, again = (inner.field(n).to_numpy(zero_copy_only=False) for n in ("leader_place", "place", "hi", "near"))
        cut = np.concatenate([[0], np.cumsum(meets.value_lengths().to_numpy(zero_copy_only=False))])
        for i, (leader, member) in enumerate(zip(leaders, members, strict=True)):
            if leader != last:
                last, left = leader, Text(_hashes(batch.column(3).slice(i, 1)))
            own = slice(cut[i], cut[i + 1])
            at, end = right_at[own].astype(np.int64), hi[own].astype(np.int64)
            right, short = left, np.ones(len(at), bool)
            if leader != member:
                right = Text(_hashes(batch.column(4).slice(i, 1)))
                found, short = compare(left, right, left_at[own].astype(np.int64), at)
                rows += [(leader, member, *f, None, None, None, None) for f in found]
            short = short & ~again[own].astype(bool)  # what is filed for its surroundings was filed for its words too
            for lo, stop in set(zip(at[short].tolist(), end[short].tolist(), strict=True)):
                rows += [(None, member, None, None, None, None, None, *f, False) for f in refile(right.words, lo, stop)]
                if first:
                    rows += [(None, member, None, None, None, None, None, key, lo, stop, True) for key in nearby(right, lo, stop)]
            if len(rows) >= ROWS:
                yield _judged(rows)
                rows = []
        yield _judged(rows)
        release()


def _hashes(column: pa.Array) -> np.ndarray:
    data, offsets = T.utf8(column)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    starts, ends, _ = T.words(data, offsets)
    return T.word_hashes(data, starts, ends)


def matches(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """leader, text_id, leader_start, leader_end, start, end, similarity of passages shared with a group's leader; and doc_id, text_id, words of the documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    known = stash(known_texts(rows), "passages-known")
    units = stash(led(rows.select("text").mapInArrow(_file, _UNIT)).distinct(), "passages-units")
    wanted = units.select("text_id").unionByName(units.select(F.col("leader").alias("text_id"))).distinct()
    one = known.groupBy("text_id").agg(F.min("doc_id").alias("doc_id")).join(wanted, "text_id", "left_semi")
    texts = stash(rows.join(one, "doc_id").dropDuplicates(["text_id"]).select("text_id", "text"), "passages-texts")
    found = None
    while True:
        first = found is None
        pairs = units.groupBy("leader", "text_id").agg(F.collect_set(F.struct("leader_place", "place", "hi", "near")).alias("meets"))
        both = pairs.join(texts.withColumnRenamed("text", "right"), "text_id").join(texts.withColumnsRenamed({"text_id": "leader", "text": "left"}), "leader")
        judged = stash(both.select("leader", "text_id", "meets", "left", "right").mapInArrow(functools.partial(_compare, first=first), _OUT), "passages-judged")
        good = judged.where("leader is not null").drop("bucket", "place", "hi", "near")
        found = good if found is None else found.unionByName(good)
        units = stash(led(judged.where("leader is null").select("bucket", "text_id", "place", "hi", "near").distinct()), "passages-open")
        if not units.limit(1).count():
            return found, known


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word, n_words of every repeated stretch, and a document that shares it."""
    found, known = matches(docs)
    member = found.select("text_id", "start", "end", F.col("leader").alias("partner"), "similarity")
    leader = found.select(F.col("leader").alias("text_id"), F.col("leader_start").alias("start"), F.col("leader_end").alias("end"), F.col("text_id").alias("partner"), "similarity")
    each = member.unionByName(leader).groupBy("text_id", "start", "end").agg(F.min("partner").alias("partner"), F.max("similarity").alias("similarity"))
    order = Window.partitionBy("text_id").orderBy("start", "end")
    upto = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("island", F.sum(F.when(F.col("start") < upto, 0).otherwise(1)).over(order))
    merged = each.groupBy("text_id", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("partner").alias("partner"), F.max("similarity").alias("similarity"))
    texts = known.where(F.col("words") >= PASSAGE).groupBy("text_id").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("copies"), F.first("words").alias("words"))
    partner = texts.select(F.col("text_id").alias("partner"), F.col("least").alias("partner_id"))
    stretch = merged.join(partner, "partner").select("text_id", "start_word", "end_word", "partner_id", "similarity")
    # a text on several rows is a passage from its first to its last word
    copied = texts.where("least < most").select("text_id", F.lit(0).alias("start_word"), F.col("words").alias("end_word"), F.col("least").alias("partner_id"), F.lit(1.0).alias("similarity"), F.col("most").alias("other"))
    stretch = stretch.join(copied.select("text_id"), "text_id", "left_anti").withColumn("other", F.lit(None).cast("long")).unionByName(copied)
    out = known.join(stretch, "text_id")
    partner_id = F.when(F.col("other").isNotNull() & (F.col("partner_id") == F.col("doc_id")), F.col("other")).otherwise(F.col("partner_id"))
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), partner_id.alias("partner_id"), "similarity")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
