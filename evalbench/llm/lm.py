"""Operator 6: n-gram language-model scoring with an Elias-Fano trie.

The model has three orders with absolute discounting over an add-one unigram model:

    P(w | u, v) = (c(u, v, w) - D) / c(u, v) + D * t(u, v) / c(u, v) * P(w | v)
    P(w | v)    = (c(v, w) - D) / c(v) + D * t(v) / c(v) * P(w)
    P(w)        = (c(w) + 1) / (N + V + 1)

with t the number of different successors of a context, and D = DISCOUNT; a term of what was never seen is left
out, and a context never seen gives the order below. Texts begin after two start marks. All n-grams of the
training documents count; there is no cut-off, so the trie grows with the corpus.

The trie is kept in shards by the word next to the predicted one. A shard has these levels, each an Elias-Fano
sequence: words; for each word its successors, and its predecessors; for each (word, predecessor) the successors.
A node's value is its parent's place and 32 bits of its word's hash, so a level is monotone; a pointer sequence holds
where each parent's range begins. What is stored at a node is one byte, a smoothed probability quantised on a
logarithmic scale: the discounted terms above and the weights of the order below. The scale has at most SCALE steps a
power of ten and as few as its 255 codes need to reach the least term that N tokens can have, so nothing is clipped at
any size: up to 9 * 10^7 tokens a code is within 4.2 % of its term, at 10^12 within 6.3 %. A pair of a heavy word (see
below) is a share of a bound of that word's count that all tasks know, any other of the count itself. A level is never decoded as a whole: a query finds its parents' ranges by
the pointers, and decodes and searches these ranges. A shard is one file, mapped into memory; it is in the folder
that executors share where that is a plain folder, and goes when its task ends. Else it is viewed in the buffer.

Plan: documents are packed into compressed chunks in the shared folder. A chunk asks each shard once for the
distinct n-grams it holds, and says how often it saw them in training documents; the shard adds up, builds its
trie, and answers by place. A chunk then scores its documents from the answers. So the shuffles carry distinct
n-grams by chunk, not tokens; like the blocks of any shuffle, their rows are as many as chunks times shards. Words
that make up a thousandth of the corpus, and the start mark, have their pairs dealt over all shards by the
successor and their triples by the predecessor; there are at most two thousand such words.

Words are told apart by 64-bit hashes, successors and predecessors of one word by 32 bits of them.

Defined results: a null text counts as empty; an empty text has one token, the end; a null doc_id counts as
the empty text for the fold; repeated rows each count and each score; without training documents N and V are
0; other columns are not read; texts of any length are scored whole.
"""

from __future__ import annotations

import contextlib
import math
import os
import struct
import urllib.parse
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalbench.llm import _text as T
from evalbench.llm._spark import own_dir, release, stash, table

CHUNK_BYTES = 6 << 20
SHARD_BYTES = 4 << 20
DISCOUNT = 0.75
HEAVY = 1000
#: A heavy word's count is at most so many times its count in the chunks where it is heavy: these have half of N / HEAVY
#: at least, and in the others it has less than N / HEAVY.
REFERENCE = 3
END, START = np.uint64(0x8F1BBCDC5A827999), np.uint64(0x6ED9EBA1CA62C1D6)
LOW = np.uint64(32)
TAIL = np.uint64((1 << 32) - 1)
SCALE = 28  # codes a power of ten, at most
SAMPLE = 4096  # ones of a high part between two entries of its directory
BLOCK = 1 << 18  # nodes that are decoded together, about


# ---- Elias-Fano


class EliasFano:
    """A monotone sequence: low bits packed in planes, high parts in unary, and where every SAMPLE-th one is."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, sample: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.sample = n, low_bits, low, high, sample

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        if not n:
            return EliasFano(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint64))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 2, np.uint8)
        high[ones] = 1
        planes = [np.packbits((values >> np.uint64(b) & np.uint64(1)).astype(np.uint8)) for b in range(low_bits % 8)]
        whole = [(values >> np.uint64(low_bits % 8 + 8 * b) & np.uint64(255)).astype(np.uint8) for b in range(low_bits // 8)]
        return EliasFano(n, low_bits, np.concatenate([*planes, *whole, np.zeros(0, np.uint8)]), np.packbits(high), ones[::SAMPLE].astype(np.uint64))

    def range(self, a: int, b: int) -> np.ndarray:
        """The values at places a to b - 1."""
        if b <= a:
            return np.zeros(0, np.uint64)
        bits, first = self.low_bits, a // SAMPLE
        begin = int(self.sample[first]) // 8
        last = (b - 1) // SAMPLE + 1
        end = int(self.sample[last]) // 8 + 1 if last < len(self.sample) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin:end]))
        # ones of the first byte that stand before the sampled one belong to places before it
        skip = int(np.searchsorted(ones, int(self.sample[first]) - 8 * begin)) + a - first * SAMPLE
        ones = ones[skip : skip + b - a] + 8 * begin
        out = (ones - np.arange(a, b)).astype(np.uint64) << np.uint64(bits)
        plane, at, lo = (self.n + 7) // 8, 0, a // 8
        for i in range(bits % 8):
            out |= np.unpackbits(self.low[at + lo : at + (b + 7) // 8])[a - 8 * lo : b - 8 * lo].astype(np.uint64) << np.uint64(i)
            at += plane
        for i in range(bits // 8):
            out |= self.low[at + a : at + b].astype(np.uint64) << np.uint64(bits % 8 + 8 * i)
            at += self.n
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.sample)) + self.low.tobytes() + self.high.tobytes() + self.sample.tobytes()

    @staticmethod
    def view(buffer: np.ndarray, at: int) -> tuple[EliasFano, int]:
        n, bits, low, high, sample = struct.unpack("<QQQQQ", buffer[at : at + 40].tobytes())
        a, b, c = at + 40, at + 40 + low, at + 40 + low + high
        return EliasFano(n, bits, buffer[a:b], buffer[b:c], buffer[c : c + 8 * sample].view(np.uint64)), c + 8 * sample


def scale_of(n: int) -> int:
    """Codes a power of ten with which 255 of them reach the least term of a model of ``n`` tokens."""
    return min(SCALE, int(254 / math.log10(REFERENCE * max(n, 1) / (1 - DISCOUNT))))


def values(scale: int) -> np.ndarray:
    """Probabilities by code; code 0 stands for what was never seen."""
    return np.concatenate([[0.0], 10.0 ** (-np.arange(255) / scale)])


def quantise(p: np.ndarray, scale: int) -> np.ndarray:
    """Codes of probabilities above 0."""
    return np.clip(np.rint(-scale * np.log10(p)) + 1, 1, 255).astype(np.uint8)


class Level:
    """Nodes below the places of a parent level: pointers to their ranges, values and codes."""

    def __init__(self, pointers: EliasFano, nodes: EliasFano, codes: np.ndarray):
        self.pointers, self.nodes, self.codes = pointers, nodes, codes

    @staticmethod
    def of(nodes: np.ndarray, parents: int, codes: np.ndarray) -> Level:
        """``nodes`` sorted and distinct: parent's place << 32 | tail."""
        sizes = np.bincount((nodes >> LOW).astype(np.int64), minlength=parents)
        return Level(EliasFano.of(np.concatenate([[0], np.cumsum(sizes)])), EliasFano.of(nodes), codes)

    def places(self, parents: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """The place of each (parent, tail), sorted by parent; -1 where there is none or the parent is -1."""
        out = np.full(len(parents), -1)
        there = np.flatnonzero(parents >= 0)
        at = 0
        while at < len(there):
            # parents up to about BLOCK nodes, one parent at least; a large one is searched in parts
            first = int(parents[there[at]])
            upto = min(at + BLOCK, len(there))
            pointers = self.pointers.range(first, int(parents[there[upto - 1]]) + 2).astype(np.int64)
            wide = int(np.searchsorted(pointers, pointers[0] + BLOCK, side="right")) - 1
            upto = at + max(1, int(np.searchsorted(parents[there[at:upto]], first + max(1, wide))))
            own = there[at:upto]
            lo, hi = int(pointers[0]), int(pointers[int(parents[own[-1]]) - first + 1])
            wanted = parents[own].astype(np.uint64) << LOW | tails[own].astype(np.uint64)
            for a in range(lo, hi, 4 * BLOCK):
                values = self.nodes.range(a, min(hi, a + 4 * BLOCK))
                i = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
                hit = values[i] == wanted
                out[own[hit]] = a + i[hit]
            at = upto
        return out

    def code(self, places: np.ndarray) -> np.ndarray:
        return np.where(places >= 0, self.codes[places], 0).astype(np.uint8) if len(self.codes) else np.zeros(len(places), np.uint8)

    def parts(self) -> list[bytes]:
        return [self.pointers.to_bytes(), self.nodes.to_bytes(), struct.pack("<Q", len(self.codes)), self.codes.tobytes()]

    @staticmethod
    def view(buffer: np.ndarray, at: int) -> tuple[Level, int]:
        pointers, at = EliasFano.view(buffer, at)
        nodes, at = EliasFano.view(buffer, at)
        n = struct.unpack("<Q", buffer[at : at + 8].tobytes())[0]
        return Level(pointers, nodes, buffer[at + 8 : at + 8 + n]), at + 8 + n


class TrieShard:
    """Words with counts and weights; successors of words; predecessors of words, and successors of these pairs."""

    def __init__(self, words: EliasFano, counts: EliasFano, weights: np.ndarray, pairs: Level, contexts: Level, triples: Level):
        self.words, self.counts, self.weights, self.pairs, self.contexts, self.triples = words, counts, weights, pairs, contexts, triples

    @staticmethod
    def build(words: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_n: np.ndarray, contexts: np.ndarray, triples: np.ndarray, triple_n: np.ndarray, scale: int, below: np.ndarray | None = None) -> TrieShard:
        """All keys sorted and distinct, all counts above 0 but those of words; ``below``: what a word's pairs are shares of, its count unless given."""
        below = counts if below is None else below
        kinds = np.bincount((pairs >> LOW).astype(np.int64), minlength=len(words))
        seen = np.flatnonzero((kinds > 0) & (counts > 0))
        weights = np.zeros(len(words), np.uint8)
        weights[seen] = quantise(DISCOUNT * kinds[seen] / counts[seen], scale)
        parent = (triples >> LOW).astype(np.int64)
        total = np.bincount(parent, triple_n, minlength=len(contexts))
        different = np.bincount(parent, minlength=len(contexts))
        return TrieShard(
            EliasFano.of(words), EliasFano.of(np.concatenate([[0], np.cumsum(counts)])), weights, Level.of(pairs, len(words), quantise((pair_n - DISCOUNT) / below[(pairs >> LOW).astype(np.int64)], scale)),
            Level.of(contexts, len(words), quantise(DISCOUNT * different / np.maximum(total, 1), scale)), Level.of(triples, len(contexts), quantise((triple_n - DISCOUNT) / total[parent], scale)),
        )

    def to_bytes(self) -> bytes:
        return b"".join([self.words.to_bytes(), self.counts.to_bytes(), self.weights.tobytes(), *self.pairs.parts(), *self.contexts.parts(), *self.triples.parts()])

    @staticmethod
    def from_buffer(buffer: np.ndarray) -> TrieShard:
        words, at = EliasFano.view(buffer, 0)
        counts, at = EliasFano.view(buffer, at)
        weights, at = buffer[at : at + words.n], at + words.n
        levels = []
        for _ in range(3):
            level, at = Level.view(buffer, at)
            levels.append(level)
        return TrieShard(words, counts, weights, *levels)

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(self.to_bytes())

    @staticmethod
    def open(path: str) -> TrieShard:
        return TrieShard.from_buffer(np.memmap(path, np.uint8, "r"))

    def places(self, words: np.ndarray) -> np.ndarray:
        """The place of each of some sorted words, -1 where there is none."""
        out = np.full(len(words), -1)
        for a in range(0, self.words.n, BLOCK):
            values = self.words.range(a, min(self.words.n, a + BLOCK))
            lo, hi = np.searchsorted(words, values[0]), np.searchsorted(words, values[-1], side="right")
            i = np.minimum(np.searchsorted(values, words[lo:hi]), len(values) - 1)
            out[lo:hi] = np.where(values[i] == words[lo:hi], a + i, -1)
        return out

    def count(self, places: np.ndarray) -> np.ndarray:
        if not hasattr(self, "sums"):  # asked again and again; one a word
            self.sums = self.counts.range(0, self.counts.n).astype(np.int64)
        return np.where(places >= 0, self.sums[places + 1] - self.sums[places], 0)


@contextlib.contextmanager
def mapped(trie: TrieShard, folder: str | None):
    """``trie`` as a mapped file in a folder that goes at the end, or in a buffer where there is no plain folder."""
    if folder is None:
        yield TrieShard.from_buffer(np.frombuffer(trie.to_bytes(), np.uint8))
        return
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{uuid.uuid4().hex}.trie")
    try:
        trie.save(path)
        yield TrieShard.open(path)
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(path)


def plain_folder(url: str) -> str | None:
    """The path of a file: URL or of a path without a scheme."""
    parts = urllib.parse.urlparse(url)
    return urllib.parse.unquote(parts.path) if parts.scheme in ("", "file") else None


# ---- chunks


def trains(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


class Chunk:
    """The tokens of a chunk of documents: distinct words, pairs, contexts and triples, and each token's place among them."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        self.ids, self.known = ids, known
        self.train = np.array([trains(int(i) if k else None) for i, k in zip(ids, known, strict=True)], dtype=bool)
        hashes, firsts = [], [np.zeros(1, np.int64)]
        for a, b in T.slices(offsets):
            part = offsets[a : b + 1] - offsets[a]
            piece = data[offsets[a] : offsets[b]]
            starts, ends, first = T.words(piece, part)
            hashes.append(T.word_hashes(piece, starts, ends))
            firsts.append(first[1:] + firsts[-1][-1])
        flat = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        first = np.concatenate(firsts)
        n_docs = len(ids)
        self.first = first + np.arange(n_docs + 1)  # one more token, the end, a document
        self.tokens = np.full(len(flat) + n_docs, END)
        inner = np.ones(len(self.tokens), bool)
        inner[self.first[1:] - 1] = False
        self.tokens[inner] = flat
        self.token_train = np.repeat(self.train, np.diff(self.first))

    def index(self) -> None:
        """Words (with START) by hash; pairs (v, w); contexts (v, u); triples (context, w); all sorted. Places are kept in 32 bits."""
        self.words, word_at = np.unique(np.append(self.tokens, START), return_inverse=True)
        start, word_at = word_at[-1], word_at[:-1].astype(np.uint64)
        del self.tokens
        v = np.roll(word_at, 1)
        v[self.first[:-1]] = start
        high = v << LOW
        self.word_at, self.v_at = word_at.astype(np.int32), v.astype(np.int32)
        self.pairs, at = np.unique(high | word_at, return_inverse=True)
        self.pair_at = at.astype(np.int32)
        u = np.roll(v, 1)
        u[self.first[:-1]] = start
        self.contexts, at = np.unique(high | u, return_inverse=True)
        del v, u, high
        self.context_at = at.astype(np.int32)
        self.triples, seen, at = np.unique(at.astype(np.uint64) << LOW | word_at, return_index=True, return_inverse=True)
        self.triple_at, self.triple_pair = at.astype(np.int32), self.pair_at[seen]

    def routes(self, shards: int, heavy: np.ndarray):
        """By shard: the places of its own words, pairs, contexts and triples, all ascending."""
        tail = lambda x: (T.mix(self.words ^ np.uint64(0x5BD1E995)) % np.uint64(shards)).astype(np.int64)[x]
        by_word = tail(np.arange(len(self.words)))
        hot = np.isin(self.words, heavy)

        def dealt(keys: np.ndarray) -> np.ndarray:
            word, other = (keys >> LOW).astype(np.int64), (keys & TAIL).astype(np.int64)
            return np.where(hot[word], by_word[other], by_word[word])

        by_pair, by_context = dealt(self.pairs), dealt(self.contexts)
        by_triple = by_context[(self.triples >> LOW).astype(np.int64)]
        cuts = []
        for by in (by_word, by_pair, by_context, by_triple):
            order = np.argsort(by, kind="stable")
            cuts.append((order, np.searchsorted(by[order], np.arange(shards + 1))))
        for s in range(shards):
            yield s, *(order[cut[s] : cut[s + 1]] for order, cut in cuts)


def _pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out, kinds = 1, [], []
    for _ in range(raw[0]):
        kind, n = struct.unpack_from("<2sQ", raw, at)
        kinds.append((np.dtype(kind.decode()), n))
        at += 10
    for dtype, n in kinds:
        out.append(np.frombuffer(raw, dtype, n, at))
        at += n * dtype.itemsize
    return out


def _small(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def pack_chunks(batches):
    """Documents (doc_id, text) into rows of about CHUNK_BYTES, with their training tokens and heavy words."""
    part, number = TaskContext.get().partitionId(), 0
    ids: list[np.ndarray] = []
    known: list[np.ndarray] = []
    data: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    held = 0

    def out() -> pa.RecordBatch:
        nonlocal number, held
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        chunk = Chunk(np.concatenate(ids), np.concatenate(known), np.concatenate(data), offsets)
        words, counts = np.unique(chunk.tokens[chunk.token_train], return_counts=True)
        n = int(counts.sum())
        often = counts * HEAVY >= n
        row = pa.RecordBatch.from_pydict({
            "chunk": pa.array([part << 24 | number], pa.int64()),
            "blob": pa.array([_pack(chunk.ids, chunk.known.astype(np.uint8), np.concatenate(data), offsets, level=5)], pa.binary()),
            "bytes": pa.array([held], pa.int64()),
            "tokens": pa.array([n], pa.int64()),
            "train_docs": pa.array([int(chunk.train.sum())], pa.int64()),
            "heavy": pa.array([[{"word": int(w), "n": int(c)} for w, c in zip(words[often].view(np.int64), counts[often], strict=True)]], pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))),
        })
        number, held = number + 1, 0
        for x in (ids, known, data, sizes):
            x.clear()
        release()
        return row

    for batch in batches:
        doc_ids = batch.column(0)
        there = doc_ids.is_valid().to_numpy(zero_copy_only=False)
        values = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
        for a, b, piece, offsets in T.batches(batch.column(1)):
            ids.append(values[a:b])
            known.append(there[a:b])
            data.append(np.array(piece))
            sizes.append(np.diff(offsets))
            held += len(piece)
            if held >= CHUNK_BYTES:
                yield out()
    if ids:
        yield out()


def _open(blob: bytes) -> Chunk:
    ids, known, data, offsets = _unpack(blob)
    return Chunk(ids, known.astype(bool), data, offsets)


def _ask(shards: int, heavy: np.ndarray):
    """Chunks into one row a shard: words, their pairs and contexts, and triples, with training counts.

    Words and pairs have their count + 1, or 0 where they only name something that the shard does not answer for.
    Heavy words, which are in all rows, go by their number.
    """

    def run(batches):
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chunk = _open(blob)
                chunk.index()
                train = chunk.token_train
                word_n, pair_n, triple_n = (np.bincount(at[train], minlength=len(keys)) for at, keys in ((chunk.word_at, chunk.words), (chunk.pair_at, chunk.pairs), (chunk.triple_at, chunk.triples)))
                rows: list[tuple[int, bytes]] = []
                for s, own, pairs, contexts, triples in chunk.routes(shards, heavy):
                    if not (len(own) or len(pairs) or len(contexts)):
                        continue
                    named = np.union1d(pairs, chunk.triple_pair[triples])
                    v_pair, v_context = ((x >> LOW).astype(np.int64) for x in (chunk.pairs[named], chunk.contexts[contexts]))
                    words = np.unique(np.concatenate([own, v_pair, v_context]))
                    word_plus, pair_plus = np.zeros(len(words), np.int64), np.zeros(len(named), np.int64)
                    word_plus[np.searchsorted(words, own)] = word_n[own] + 1
                    pair_plus[np.searchsorted(named, pairs)] = pair_n[pairs] + 1
                    of_pair = np.searchsorted(words, v_pair)
                    pair_sizes = np.bincount(of_pair, minlength=len(words))
                    context_sizes = np.bincount(np.searchsorted(words, v_context), minlength=len(words))
                    parent = np.searchsorted(contexts, (chunk.triples[triples] >> LOW).astype(np.int64))
                    # a triple's last word is named by its place among the pairs of the middle one
                    begin = np.cumsum(pair_sizes) - pair_sizes
                    place = np.searchsorted(named, chunk.triple_pair[triples])
                    known = chunk.words[words]
                    hot = np.isin(known, heavy)
                    short = lambda keys: (chunk.words[(keys & TAIL).astype(np.int64)] >> LOW).astype(np.uint32)
                    rows.append((s, _pack(
                        known[~hot], _small(np.searchsorted(heavy, known[hot])), _small(word_plus), _small(pair_sizes), short(chunk.pairs[named]), _small(pair_plus), _small(context_sizes), short(chunk.contexts[contexts]),
                        _small(np.bincount(parent, minlength=len(contexts))), _small(place - begin[of_pair[place]]), _small(triple_n[triples]),
                    )))
                    if sum(len(r[1]) for r in rows) > 8 << 20:
                        yield _rows(rows, number)
                        rows = []
                if rows:
                    yield _rows(rows, number)
                del chunk
                release()

    return run


def _rows(rows: list[tuple[int, bytes]], chunk: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"shard": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})


class Question:
    """What a chunk asks of a shard, with the tails of its triples' words."""

    def __init__(self, blob: bytes, heavy: np.ndarray):
        rest, numbers, self.word_plus, pair_sizes, self.pair_tail, self.pair_plus, context_sizes, self.context_tail, triple_sizes, place, self.triple_n = _unpack(blob)
        self.words = np.sort(np.concatenate([rest, heavy[numbers]]))
        each = np.arange(len(self.words), dtype=np.int32)
        pair_sizes, context_sizes = pair_sizes.astype(np.int64), context_sizes.astype(np.int64)
        self.pair_word, self.context_word = np.repeat(each, pair_sizes), np.repeat(each, context_sizes)
        self.triple_context = np.repeat(np.arange(len(self.context_tail), dtype=np.int32), triple_sizes.astype(np.int64))
        begin = np.cumsum(pair_sizes) - pair_sizes
        self.triple_tail = self.pair_tail[begin[self.context_word[self.triple_context]] + place.astype(np.int64)]


def _sum(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their sums."""
    key, n = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *(c.astype(np.int64) for c in counts)])
    order = np.argsort(key)
    key, n = key[order], n[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[new], np.add.reduceat(n, new) if len(new) else n


def _merge(asked: list[Question], heavy: np.ndarray, bounds: np.ndarray, scale: int, starts: int) -> TrieShard:
    """The trie of what the chunks saw in training; ``starts``: the start mark's count, ``bounds``: those of heavy words."""
    words = np.unique(np.concatenate([q.words for q in asked]))
    counts = np.zeros(len(words), np.int64)
    at = [np.searchsorted(words, q.words) for q in asked]
    for q, a in zip(asked, at, strict=True):
        counts[a] += np.maximum(q.word_plus.astype(np.int64) - 1, 0)
    parts = []
    for q, a in zip(asked, at, strict=True):
        good = q.pair_plus > 1
        parts.append((a[q.pair_word[good]].astype(np.uint64) << LOW | q.pair_tail[good], q.pair_plus[good].astype(np.int64) - 1))
    pairs, pair_n = _sum(*zip(*parts, strict=True))
    above = [a[q.context_word].astype(np.uint64) << LOW | q.context_tail for q, a in zip(asked, at, strict=True)]
    good = [q.triple_n > 0 for q in asked]
    contexts = np.unique(np.concatenate([x[q.triple_context[g]] for x, q, g in zip(above, asked, good, strict=True)]))
    parts = [(np.searchsorted(contexts, x[q.triple_context[g]]).astype(np.uint64) << LOW | q.triple_tail[g], q.triple_n[g]) for x, q, g in zip(above, asked, good, strict=True)]
    triples, triple_n = _sum(*zip(*parts, strict=True))
    total = np.where(words == START, starts, counts)
    # the pairs of a heavy word lie in shards that do not know its count
    held = np.minimum(np.searchsorted(heavy, words), len(heavy) - 1)
    below = np.where(heavy[held] == words, bounds[held], total)
    trie = TrieShard.build(words, total, pairs, pair_n, contexts, triples, triple_n, scale, below)
    trie.counts = EliasFano.of(np.concatenate([[0], np.cumsum(counts)]))
    return trie


def _find(level: Level, parents: list[np.ndarray], tails: list[np.ndarray]) -> np.ndarray:
    """Places of the nodes that several chunks ask for, searched together in the level's order: each range is decoded once."""
    parent, tail = np.concatenate(parents), np.concatenate(tails)
    order = np.argsort((parent + 1).astype(np.uint64) << LOW | tail, kind="stable")
    out = np.empty(len(parent), np.int64)
    out[order] = level.places(parent[order], tail[order])
    return out


def _answer(heavy: np.ndarray, bounds: np.ndarray, scale: int, starts: int, folder: str | None):
    """A shard's trie, built and asked: by chunk the counts and codes in the order of the questions.

    The row of chunk -1 holds the number of words seen in training, and how many successors heavy words have here.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, chunks = int(pdf["shard"].iloc[0]), pdf["chunk"].tolist()
        asked = [Question(b, heavy) for b in pdf["blob"]]
        with mapped(_merge(asked, heavy, bounds, scale, starts), folder) as trie:
            held = trie.places(heavy)
            limits = trie.pairs.pointers.range(0, trie.pairs.pointers.n).astype(np.int64)
            kinds = np.where(held >= 0, limits[held + 1] - limits[held], 0)
            sums = trie.counts.range(0, trie.counts.n)
            out = [(-1, shard, _pack(np.array([int((sums[1:] > sums[:-1]).sum())], np.int64), kinds))]
            del limits, sums
            cut = lambda parts: np.cumsum([0, *map(len, parts)])
            words, back = np.unique(np.concatenate([q.words for q in asked]), return_inverse=True)
            at = np.split(trie.places(words)[back], cut([q.words for q in asked])[1:-1])
            answers = []
            for q, a in zip(asked, at, strict=True):
                own = a[q.word_plus > 0]
                answers.append([_small(trie.count(own)), np.where(own >= 0, trie.weights[own], 0).astype(np.uint8)])
            mine = [q.pair_plus > 0 for q in asked]
            pair = trie.pairs.code(_find(trie.pairs, [a[q.pair_word[m]] for q, a, m in zip(asked, at, mine, strict=True)], [q.pair_tail[m] for q, m in zip(asked, mine, strict=True)]))
            for answer, codes in zip(answers, np.split(pair, np.cumsum([int(m.sum()) for m in mine])[:-1]), strict=True):
                answer.append(codes)
            context = _find(trie.contexts, [a[q.context_word] for q, a in zip(asked, at, strict=True)], [q.context_tail for q in asked])
            ends = cut([q.context_tail for q in asked])
            triple = trie.triples.code(_find(trie.triples, [context[i + q.triple_context] for q, i in zip(asked, ends, strict=False)], [q.triple_tail for q in asked]))
            for answer, c, t in zip(answers, np.split(trie.contexts.code(context), ends[1:-1]), np.split(triple, cut([q.triple_tail for q in asked])[1:-1]), strict=True):
                answer += [c, t]
            out += [(int(chunk), shard, _pack(*answer, level=5)) for chunk, answer in zip(chunks, answers, strict=True)]
            del trie, asked, at, context, triple, pair, answers
        release()
        return pd.DataFrame(out, columns=["chunk", "shard", "blob"])

    return run


def _score(shards: int, heavy: np.ndarray, bounds: np.ndarray, weights: np.ndarray, scale: int, n: int, v: int, starts: int):
    value = values(scale)

    def run(chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        given = dict(zip(answers["shard"], answers["blob"], strict=True))
        parts = []
        for blob in chunks["blob"]:
            chunk = _open(blob)
            chunk.index()
            counts, lower2 = np.zeros(len(chunk.words), np.int64), np.zeros(len(chunk.words))
            pair, lower3, triple = np.zeros(len(chunk.pairs), np.uint8), np.zeros(len(chunk.contexts), np.uint8), np.zeros(len(chunk.triples), np.uint8)
            for s, own, pairs, contexts, triples in chunk.routes(shards, heavy):
                if len(own) or len(pairs) or len(contexts):
                    counts[own], code, pair[pairs], lower3[contexts], triple[triples] = _unpack(given[s])
                    lower2[own] = value[code]
            c = counts[chunk.word_at]
            p = (c + 1) / (n + 1 * (v + 1))
            context = np.where(chunk.words == START, starts, counts)
            hot = np.minimum(np.searchsorted(heavy, chunk.words), len(heavy) - 1)
            hot, at = heavy[hot] == chunk.words, hot
            lower2 = np.where(hot, weights[at] / np.maximum(context, 1), lower2)[chunk.v_at]
            whole = np.where(hot, bounds[at] / np.maximum(context, 1), 1.0)[chunk.v_at]
            two = np.where(context[chunk.v_at] > 0, value[pair][chunk.pair_at] * whole + lower2 * p, p)
            lower3 = lower3[chunk.context_at]
            full = np.minimum(np.where(lower3 > 0, value[triple][chunk.triple_at] + value[lower3] * two, two), 1.0)
            first = chunk.first[:-1]
            parts.append(pd.DataFrame({
                "doc_id": pd.array(np.where(chunk.known, chunk.ids, 0), dtype="Int64"),
                "held_out": ~chunk.train,
                "n_tokens": np.diff(chunk.first),
                "n_known": np.add.reduceat((c > 0).astype(np.int64), first),
                "train_tokens": n,
                "base_score": np.add.reduceat(np.log10(p), first),
                "score": np.add.reduceat(np.log10(full), first),
            }))
            parts[-1].loc[~chunk.known, "doc_id"] = pd.NA
            del chunk, c, context, p, two, whole, full, counts, pair, triple
            release()
        return pd.concat(parts)

    return run


def score(docs: DataFrame) -> DataFrame:
    """Scores of every whole text of ``docs`` (doc_id, text) under the model of those outside the held-out fold."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = stash(rows.mapInArrow(pack_chunks, "chunk long, blob binary, bytes long, tokens long, train_docs long, heavy array<struct<word:long,n:long>>"), "lm-chunks")
    size, n, starts = (int(x or 0) for x in chunks.agg(F.sum("bytes"), F.sum("tokens"), F.sum("train_docs")).first())
    shards = max(1, -(-size // SHARD_BYTES))
    often = chunks.select(F.explode("heavy").alias("h")).groupBy("h.word").agg(F.sum("h.n").alias("n")).where(F.col("n") * 2 * HEAVY >= n)
    known = {r["word"] & (1 << 64) - 1: REFERENCE * r["n"] for r in often.collect()} | {int(START): max(starts, 1)}  # at most 2 * HEAVY
    heavy = np.array(sorted(known), np.uint64)
    bounds, scale = np.array([known[w] for w in sorted(known)], float), scale_of(n)
    folder = plain_folder(own_dir(spark))
    folder = folder and os.path.join(folder, "stash", f"lm-tries-{uuid.uuid4().hex}")
    asked = chunks.select("chunk", "blob").mapInArrow(_ask(shards, heavy), "shard int, chunk long, blob binary")
    answers = stash(asked.groupBy("shard").applyInPandas(_answer(heavy, bounds, scale, starts, folder), "chunk long, shard int, blob binary"), "lm-answers")
    v, kinds = 0, np.zeros(len(heavy))
    for r in answers.where("chunk = -1").select("blob").toLocalIterator():
        words, here = _unpack(bytes(r.blob))
        v, kinds = v + int(words[0]), kinds + here
    ready = chunks.select("chunk", "blob").groupBy("chunk").cogroup(answers.where("chunk >= 0").groupBy("chunk"))
    return ready.applyInPandas(_score(shards, heavy, bounds, DISCOUNT * kinds, scale, n, v, starts), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
