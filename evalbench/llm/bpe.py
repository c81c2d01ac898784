"""Operator 5: byte-level BPE encoding and decoding by prefix-sharing trie traversal.

BPE has one encoding per word, and every prefix of a word's bytes has one too. The last token of a
prefix's encoding is the only vocabulary token that ends there and may follow the last token of the
prefix before it ("may follow": encoding the two tokens' bytes together gives just these two tokens).
So the distinct words of a batch go into a byte trie, a depth-first walk carries the last token of each
prefix downwards, and a prefix shared by many words is encoded once. Reading last tokens backwards from
a word's node gives its encoding.

A text is cut where the tokenizer's own splitting always cuts (before a single space between two other
characters), and the pieces' encodings are kept in a bounded cache of the Python worker.

Defined results: a null text counts as empty; an empty text has no tokens and decodes to the empty text;
repeated rows give repeated results; other columns of the table are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalbench.llm._spark import release, table

#: Fixed value: the splitting pattern of the byte-level pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_PIECES = 600_000
FEWER_PIECES = 200_000  # where a task also holds ids
MEMO = 1_000_000
CACHE_PIECE_CHARS = 256


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, reversed."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_characters()
        raw = {word: bytes(of[c] for c in word) for word in spec["model"]["vocab"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*spec["model"]["vocab"].values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        self.id_of: dict[bytes, int] = {}
        for word, i in spec["model"]["vocab"].items():
            self.bytes_of[i] = raw[word]
            self.id_of[raw[word]] = i
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        #: (left, right) -> (rank, merged); merged -> (rank, left, right)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, both = self.id_of[raw[a]], self.id_of[raw[b]], self.id_of[raw[a] + raw[b]]
            self.merge.setdefault((left, right), (rank, both))
            self.parts.setdefault(both, (rank, left, right))
        self.length = list(map(len, self.bytes_of))
        prefixes = {word[:n] for word in self.id_of for n in range(len(word) + 1)}
        self.prefixes = sorted(prefixes)
        self.prefix_id = {s: i for i, s in enumerate(self.prefixes)}
        ends_with = lambda s: next((self.id_of[s[i:]] for i in range(len(s)) if s[i:] in self.id_of), -1)
        #: by state: the longest token that ends there; by token: the longest shorter one that ends it
        self.longest_token = list(map(ends_with, self.prefixes))
        self.shorter = [ends_with(s[1:]) for s in self.bytes_of]
        self.step: dict[int, int] = {}
        self.follows: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(SPLIT)

    def may_follow(self, left: int, right: int) -> bool:
        """No merge across the border of the two tokens comes before the merges that built them.

        The pair is undone from the later-built side on: at each step the two tokens at the border must
        not merge with a rank below the one of the merge that hid them.
        """
        key = left << 20 | right
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > MEMO:
                self.follows.clear()
            known = self.follows[key] = self._undo(left, right)
        return known

    def _undo(self, left: int, right: int) -> bool:
        endless = 1 << 40
        until = endless
        while True:
            found = self.merge.get((left, right))
            if found is not None and found[0] < until:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            # the side that was built last is the first to be undone; ties go to the left, which BPE merges first
            if b is None or (a is not None and a[0] > b[0]):
                until, left = a[0], a[2]
            else:
                # a merge of equal rank to the left of the border comes first, so it still counts
                until, right = b[0] + 1, b[1]

    def _step(self, state: int, b: int) -> int:
        """From the longest token prefix that ends the path to the one that ends the path and ``b``."""
        s = self.prefixes[state] + bytes([b])
        while s not in self.prefix_id:
            s = s[1:]
        found = self.step[state << 8 | b] = self.prefix_id[s]
        return found

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """The encodings of distinct words, through one trie.

        Words are inserted in byte order, so the trie's nodes come up depth first and the path from the
        root to the last one is all that needs keeping: a node's bytes, its automaton state (which gives
        the longest vocabulary token that ends here) and its last token.
        """
        out: dict[bytes, list[int]] = {}
        path, states, last = b"", [0], []
        step, longest, shorter, length, follows = self.step, self.longest_token, self.shorter, self.length, self.follows
        for word in sorted(words):
            shared, most = 0, min(len(path), len(word))
            if path[:most] == word[:most]:
                shared = most
            else:
                while path[shared] == word[shared]:
                    shared += 1
            del states[shared + 1 :], last[shared:]
            state = states[-1]
            for at in range(shared, len(word)):
                b = word[at]
                state = step.get(state << 8 | b, -1)
                if state < 0:
                    state = self._step(states[-1], b)
                states.append(state)
                token = longest[state]
                while True:
                    before = at - length[token]
                    if before < 0:
                        break
                    key = last[before] << 20 | token
                    known = follows.get(key)
                    if known is None:
                        known = self.may_follow(last[before], token)
                    if known:
                        break
                    token = shorter[token]
                last.append(token)
            path = word
            tokens, at = [], len(word)
            while at:
                token = last[at - 1]
                tokens.append(token)
                at -= length[token]
            tokens.reverse()
            out[word] = tokens
        return out

    def pieces(self, text: str) -> list[str]:
        """Parts of a text whose encodings joined are the text's encoding; special tokens stand alone."""
        if self.cut and any(s in text for s in self.special):
            return [p for part in self.cut.split(text) for p in ([part] if part in self.special else self._plain(part)) if p]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text:
            return []
        parts = text.split(" ")
        out = [parts[0]] if parts[0] else []
        for i in range(1, len(parts)):
            before, now = parts[i - 1], parts[i]
            if before and now and not before[-1].isspace() and not now[0].isspace():
                out.append(" " + now)
            elif out:
                out[-1] += " " + now
            else:
                out.append(" " + now)
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Put the encodings of new pieces into the cache."""
        split = {p: [w.encode("utf-8", "surrogatepass") for w in self.split.findall(p)] for p in pieces if p not in self.special}
        ids = self.encode_words({w for ws in split.values() for w in ws})
        for p, ws in split.items():
            self.cache[p] = np.array([t for w in ws for t in ids[w]], dtype="<u4").tobytes()

    def encode_batch(self, texts: list[str], most: int = CACHE_PIECES) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; at most ``most`` pieces and those of the batch are remembered."""
        if not self.cache:
            self.cache.update({s: np.array([i], dtype="<u4").tobytes() for s, i in self.special.items()})
        cut = [self.pieces(t) for t in texts]
        new = {p for ps in cut for p in ps} - self.cache.keys()
        if new:
            if len(self.cache) + len(new) > most:
                self.cache = {p: self.cache[p] for p in {*self.special, *(p for ps in cut for p in ps)} & self.cache.keys()}
            if len(self.step) > MEMO:
                self.step.clear()
            self.learn(new)
        for ps in cut:
            yield b"".join(map(self.cache.__getitem__, ps))
        for p in new:  # pieces that will hardly come again and are long
            if len(p) > CACHE_PIECE_CHARS:
                self.cache.pop(p, None)

    def forget(self) -> None:
        """Drop what was remembered of texts; the worker may go on with other work."""
        self.cache, self.step, self.follows = {}, {}, {}

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encode_batch([text])), "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.cache
def encoder(path: str) -> TrieBPE:
    return TrieBPE(path)


def _groups(column: pa.Array, most: int = 2 << 20) -> Iterator[list[str]]:
    group, size = [], 0
    for text in column:
        text = text.as_py() or ""
        group.append(text)
        size += len(text)
        if size > most:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>) of each whole text, in place of a column of that name."""
    path, docs = path or vocabulary_path(), docs.drop("ids")

    def run(batches):
        for batch in batches:
            ids = [x for g in _groups(batch.column(column)) for x in encoder(path).encode_batch(g)]
            flat = np.frombuffer(b"".join(ids), "<u4").view(np.int32)
            offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*batch.schema.names, "ids"])

    return docs.mapInArrow(run, _schema(docs, "ids array<int>"))


def decode(docs: DataFrame, path: str | None = None, column: str = "ids") -> DataFrame:
    """``docs`` with ``decoded`` (string), from the ids in ``column``, in place of a column of that name."""
    path, docs = path or vocabulary_path(), docs.drop("decoded")

    def run(batches):
        for batch in batches:
            texts = [encoder(path).decode(x or []) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return docs.mapInArrow(run, _schema(docs, "decoded string"))


def _schema(docs: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), more])


def tokenised(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens, ids, and digests of the ids and of the text decoded from them."""
    path = path or vocabulary_path()

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            done = 0
            for group in _groups(batch.column(2)):
                ids = list(bpe.encode_batch(group, FEWER_PIECES))
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u4").view(np.int32)))
                decoded = [hashlib.sha256(bpe.decode(np.frombuffer(x, "<u4").tolist()).encode()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(ids)), batch.column(1).slice(done, len(ids)), pa.array(np.diff(offsets), pa.int64()), lists, pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array(decoded, pa.string())],
                    ["doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
                )
                done += len(ids)
                del ids, lists, decoded
            release()
        bpe.forget()
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    return rows.mapInArrow(run, "doc_id long, source string, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    path = path or vocabulary_path()

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for group in _groups(batch.column(1)):
                for ids in bpe.encode_batch(group):
                    n.append(len(ids) // 4)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    text_hash.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
