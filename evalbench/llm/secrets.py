"""Operator 2: secret scan by a character convolutional network over candidates in context.

Three base patterns always report. The network reads every candidate and the characters around it: the value of
each base match, whatever its length, and every run of 16 or more token characters that holds a digit or mixes
cases (words and names of one case are no candidates). It sees INNER characters of a candidate at a time with
BEFORE characters of the text before and AFTER after them; a longer candidate is read whole, in windows that overlap by half,
and has the highest probability of these. A run whose calibrated probability reaches the threshold is
reported as ``learned``; a base match that reaches it counts as confirmed. Training is in numpy, on findings
labelled by construction (generated keys, tokens, passwords and hashes in assignments, headers and inside long
paths against identifiers, UUIDs, account and book numbers, class names, compounds, numbers, addresses, words and paths
in prose); a held-out part of them calibrates the
logits (a line fitted to log-odds) and sets the threshold: the highest one that keeps a recall of ``RECALL``
there. Base spans do not depend on it.

Spans are code points, end exclusive. A base span is the whole match. A learned span that lies inside a base span of the same text is
not repeated.

Defined results: a null text counts as empty and has no spans (hash of the empty text); equal starts are
ordered by kind; repeated rows give repeated results; long texts are scanned whole; other columns are kept by
``redact`` and not read by the query.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalbench.llm._spark import release, table

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run, so the same as a run of any length kept from 24 on
KINDS = ("assign", "access", "hex", "learned")
KEYWORDS = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.\-]{16,}")
BEFORE, INNER, AFTER = 20, 40, 12
WINDOW = BEFORE + INNER + AFTER
FILTERS, WIDTH = 24, 5
RECALL = 0.995
ALPHABET = {c: i + 1 for i, c in enumerate(string.ascii_letters + string.digits + string.punctuation + " \n\t")}
SYMBOLS = len(ALPHABET) + 2  # 0: outside the text, the last one: any other character


def matches(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the value) of the three base patterns: leftmost, non-overlapping within each kind."""
    found: list[tuple[int, int, str, int]] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    return [m[:3] for m in matches(text)]


_DIGIT, _MIXED = re.compile("[0-9]"), re.compile("[a-z][A-Z][^ ]*[a-z][A-Z]")


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text) if _DIGIT.search(m[0]) or _MIXED.search(m[0])]


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """The parts of a candidate that the network reads: itself, or windows of INNER characters at steps of a half, the last one at its end."""
    if end - start <= INNER:
        return [(start, end)]
    return [(a, a + INNER) for a in [*range(start, end - INNER, INNER // 2), end - INNER]]


def encode(text: str, start: int, end: int) -> np.ndarray:
    """What the network reads: context, a part of a candidate, context; 0 beyond the text."""
    of = ALPHABET.get
    left = text[max(0, start - BEFORE) : start]
    codes = [0] * (BEFORE - len(left)) + [of(c, SYMBOLS - 1) for c in left + text[start : end + AFTER]]
    return np.array((codes + [0] * WINDOW)[:WINDOW], dtype=np.int16)


class CharCNN:
    """Embedding, one convolution, maximum over positions, one hidden layer, a calibrated logit."""

    def __init__(self, seed: int = 7, dim: int = 12, hidden: int = 24):
        r = np.random.RandomState(seed)
        self.p = {
            "emb": r.randn(SYMBOLS, dim) * 0.3,
            "conv": r.randn(WIDTH * dim, FILTERS) * (2 / (WIDTH * dim)) ** 0.5,
            "cb": np.zeros(FILTERS),
            "w1": r.randn(3 * FILTERS, hidden) * (1 / FILTERS) ** 0.5,
            "b1": np.zeros(hidden),
            "w2": r.randn(hidden) * (1 / hidden) ** 0.5,
            "b2": np.zeros(1),
        }
        self.p = {k: a.astype(np.float32) for k, a in self.p.items()}
        self.dim, self.slope, self.shift, self.threshold = dim, 1.0, 0.0, 0.5

    #: pooled apart: the context before, the candidate, what comes last
    ZONES = ((0, BEFORE - WIDTH + 1), (BEFORE - WIDTH + 1, BEFORE + 28), (BEFORE + 28, WINDOW - WIDTH + 1))

    def _forward(self, x: np.ndarray):
        p = self.p
        e = p["emb"][x]
        length = WINDOW - WIDTH + 1
        conv = sum(e[:, j : j + length] @ p["conv"][j * self.dim : (j + 1) * self.dim] for j in range(WIDTH))
        conv = np.maximum(conv + p["cb"], 0)
        arg = np.stack([conv[:, a:b].argmax(1) + a for a, b in self.ZONES], axis=1)
        pooled = np.take_along_axis(conv, arg, axis=1).reshape(len(x), -1)
        h = np.maximum(pooled @ p["w1"] + p["b1"], 0)
        return e, conv, arg, pooled, h, h @ p["w2"] + p["b2"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 2048])[-1] for i in range(0, len(x), 2048)] or [np.zeros(0)]).astype(float)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.logits(x) + self.shift)))

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 8, seed: int = 3) -> None:
        r, m, v, t = np.random.RandomState(seed), {}, {}, 0
        for _ in range(rounds):
            order = r.permutation(len(x))
            for at in range(0, len(x), 128):
                pick = order[at : at + 128]
                g = self._gradients(x[pick], y[pick])
                t += 1
                for k, d in g.items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * d * d
                    self.p[k] -= (0.004 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, length = self.p, WINDOW - WIDTH + 1
        e, conv, arg, pooled, h, logit = self._forward(x)
        d = ((1 / (1 + np.exp(-logit)) - y) / len(x)).astype(np.float32)
        dh = np.outer(d, p["w2"]) * (h > 0)
        dpool = (dh @ p["w1"].T).reshape(len(x), 3, FILTERS)
        dconv = np.zeros_like(conv)
        for z in range(3):
            np.put_along_axis(dconv, arg[:, z : z + 1], dpool[:, z : z + 1], axis=1)
        dconv *= conv > 0
        flat, de = dconv.reshape(-1, FILTERS), np.zeros_like(e)
        for j in range(WIDTH):
            de[:, j : j + length] += dconv @ p["conv"][j * self.dim : (j + 1) * self.dim].T
        dw = np.concatenate([e[:, j : j + length].reshape(len(flat), -1).T @ flat for j in range(WIDTH)])
        demb = np.stack([np.bincount(x.ravel(), de[:, :, k].ravel(), SYMBOLS) for k in range(self.dim)], axis=1)
        return {"emb": demb, "conv": dw, "cb": flat.sum(0), "w1": pooled.T @ dh, "b1": dh.sum(0), "w2": h.T @ d, "b2": np.array([d.sum()])}

    def calibrate(self, x: np.ndarray, y: np.ndarray, of: np.ndarray, recall: float = RECALL) -> None:
        """A line on the logits by Newton steps on the log loss; then the recall-constrained threshold for whole findings (``of``: ascending number of each part's)."""
        z = self.logits(x)
        a, b = 1.0, 0.0
        for _ in range(25):
            q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = q * (1 - q) + 1e-6
            g = np.array([((q - y) * z).sum() + 0.01 * (a - 1), (q - y).sum()])
            hess = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            a, b = np.array([a, b]) - np.linalg.solve(hess, g)
        self.slope, self.shift = float(a), float(b)
        good = np.flatnonzero(y == 1)
        first = np.flatnonzero(np.append(True, of[good][1:] != of[good][:-1])[: len(good)])
        highest = np.sort(np.maximum.reduceat(self.probability(x[good]), first)) if len(first) else first
        self.threshold = float(highest[int((1 - recall) * len(highest))]) if len(first) else 0.5


def labelled_findings(n: int = 10_000, seed: int = 11) -> list[tuple[str, int, int, int, int]]:
    """(text, start, end, start and end of the secret in it) generated by rule, half of them with a secret (else both are the start)."""
    r = random.Random(seed)
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    some = lambda alphabet, a, b: "".join(r.choice(alphabet) for _ in range(r.randint(a, b)))
    spoken = low + "".join(r.choice("éèêçäöüßñóáí") for _ in range(4))
    word = lambda: some(spoken if r.random() < 0.5 else low, 2, 9)
    gap = lambda: r.choice([" ", " ", " ", " ", ", ", ". ", " | ", "\n", "!! ", "&&& "])
    prose = lambda a, b: "".join(x for _ in range(r.randint(a, b)) for x in (word().title() if r.random() < 0.2 else word(), gap()))
    secret = [
        lambda: some("0123456789abcdef", 24, 64),
        lambda: "AKIA" + some(up + dig, 16, 16),
        lambda: some(low + up + dig, 20, 44),
        lambda: some(low + up + dig + "+/", 28, 60) + r.choice(["", "=", "=="]),
        lambda: r.choice(["ghp_", "gho_", "sk_live_", "xoxb-", "glpat-", "npm_"]) + some(low + up + dig, 20, 36),
        lambda: "eyJ" + some(low + up + dig, 16, 30) + "." + some(low + up + dig + "_-", 20, 40),
        lambda: "AIza" + some(low + up + dig + "_-", 35, 35),
    ]
    vowels, starts = "aeiou", ["b", "c", "d", "f", "g", "h", "l", "m", "n", "p", "r", "s", "t", "v", "st", "tr", "pr", "ch", "th", "sch", "gr"]
    spoken_word = lambda a, b: "".join(r.choice(starts) + r.choice(vowels) + r.choice(["", "", "n", "r", "s", "l", "ng", "ct", "ss"]) for _ in range(r.randint(a, b)))
    camel = lambda a, b: "".join(r.choice([spoken_word(1, 4).capitalize(), spoken_word(1, 4).capitalize(), r.choice(["XML", "HTTP", "ID", "Url", "To", "By", "Is"])]) for _ in range(r.randint(a, b)))
    plain = [
        *[lambda: some(dig, 16, 16)] * 4,
        lambda: some(dig, 16, 24),
        lambda: some(dig, 16, 16) + r.choice(".-,"),
        *[lambda: f"{word()}{r.randint(1, 99)}.{r.choice([word() + '.', ''])}{r.choice([word(), 'example'])}.{r.choice(['com', 'org', 'net'])}"] * 3,
        lambda: f"{word()}.{r.randint(10, 99)}@".replace("@", "") + f"-{word()}-{word()}-{r.randint(1, 2030)}",
        lambda: f"/{word()}/{word()}/{word()}-{r.randint(1, 2030)}.html",
        lambda: f"{r.randint(1970, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}.{r.randint(10, 59)}.{r.randint(10, 59)}",
        lambda: "".join(word().capitalize() for _ in range(r.randint(3, 5))),
        lambda: f"{word()}_{word()}_{word()}_{r.randint(0, 99)}",
        lambda: "-".join(some(dig, 3, 4) for _ in range(r.randint(4, 5))),
        lambda: r.choice(["=", "-", "_", "."]) * r.randint(15, 40) + str(r.randint(0, 9)),
        lambda: f"v{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 20)}-{word()}.{r.randint(0, 99)}.{word()}",
        lambda: some(low, 14, 20) + "." + some(dig, 1, 2),
        *[lambda: "-".join(some("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12))] * 3,
        *[lambda: some(up, 2, 2) + some(dig, 2, 2) + r.choice([lambda: some(dig, 12, 23), lambda: some(up, 4, 4) + some(dig, 8, 18)])()] * 4,
        lambda: f"97{r.choice('89')}-{some(dig, 1, 1)}-{some(dig, 2, 6)}-{some(dig, 2, 6)}-{some(dig, 1, 1)}",
        *[lambda: camel(3, 6) + r.choice(["", "", some(dig, 1, 3)])] * 2,
        lambda: spoken_word(1, 3) + camel(2, 5),
        lambda: "".join(spoken_word(1, 3) for _ in range(r.randint(4, 9))) + r.choice(["", "", some(dig, 1, 2)]),
        lambda: r.choice(low + up) * r.randint(28, 60),
    ]
    naming = ["token", "secret", "key", "api_key", "auth", "credential", "Authorization: Bearer", "access_key", "private"]
    short = lambda: some(low + up + dig, 6, 15)
    known = lambda: r.choice([word(), word() + word(), "true", "false", "null", "string", "value", "required", "changeme" + word(), word() + ".txt", some(dig, 6, 8)])
    path = lambda a, b: "".join(word() + r.choice("/.-_/") for _ in range(r.randint(a, b)))
    out = []
    for i in range(n):
        label = i % 2
        kind = r.random()
        lead = tail = ""
        if kind < 0.12:  # the value of a base match of any length
            core = short() if label else known()
            before = f"{prose(0, 4)} {r.choice(['password', 'passwd', 'token', 'secret', 'api_key'])}{r.choice([' = ', '=', ': ', ':'])}{r.choice(['', chr(34), chr(39)])}"
        else:
            core = r.choice(secret if label else plain)()
            if kind < 0.24:  # inside a long run
                lead, tail = path(1, 9), "/" + path(0, 6) + r.choice(["html", "txt", word()])
                core = core if label else path(1, 3) + str(r.randint(0, 99))
            if label and r.random() < 0.6 and not lead:
                before = f"{prose(0, 4)} {r.choice(naming)}{r.choice([' = ', '=', ': ', ' '])}{r.choice(['', chr(34), chr(39)])}"
            else:
                before = prose(0, 6) + r.choice(["", "", "", "\n", " (", ' "', ": "])
        after = r.choice([" ", " ", '"', "\n", ". ", ") ", ""]) + prose(0, 3)
        at = len(before) + len(lead)
        out.append((before + lead + core + tail + after, len(before), at + len(core) + len(tail), at, at + len(core) if label else at))
    return out


def labelled_parts(found: list[tuple[str, int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, labels and the number of the finding of each part that has a clear label: all of a secret, or INNER / 2 of it, or next to nothing."""
    x, y, of = [], [], []
    for number, (text, start, end, a, b) in enumerate(found):
        for lo, hi in pieces(start, end):
            inside = max(0, min(hi, b) - max(lo, a))
            if inside == b - a or inside >= INNER // 2 or inside < 4:
                x.append(encode(text, lo, hi))
                y.append(float(inside >= 4))
                of.append(number)
    return np.array(x), np.array(y), np.array(of)


@functools.cache
def trained(seed: int = 7) -> CharCNN:
    """The network, trained and calibrated on generated findings; the same in every process."""
    x, y, of = labelled_parts(labelled_findings())
    part = of // 2 % 4 == 3
    net = CharCNN(seed)
    net.fit(x[~part], y[~part])
    net.calibrate(x[part], y[part], of[part])
    return net


def scan(texts: list[str], net: CharCNN) -> Iterator[tuple[list[tuple[int, int, str]], int]]:
    """All spans of each text, by start and kind, and how many base spans the network confirms."""
    base = [matches(t) for t in texts]
    found = [(i, a, b, -1) for i, t in enumerate(texts) for a, b in candidates(t)]
    found += [(i, value, end, k) for i, spans in enumerate(base) for k, (_, end, _, value) in enumerate(spans)]
    more: dict[int, list[tuple[int, int, str]]] = {}
    confirmed = [0] * len(texts)
    for at in range(0, len(found), 2048):
        group = found[at : at + 2048]
        parts = [pieces(a, b) for _, a, b, _ in group]
        first = np.cumsum([0, *map(len, parts)])
        p = net.probability(np.array([encode(texts[i], a, b) for (i, *_), own in zip(group, parts, strict=True) for a, b in own]))
        for (i, a, b, k), highest in zip(group, np.maximum.reduceat(p, first[:-1]), strict=True):
            if highest >= net.threshold:
                if k >= 0:
                    confirmed[i] += 1
                elif not any(s <= a and b <= e for s, e, *_ in base[i]):
                    more.setdefault(i, []).append((a, b, "learned"))
    for i, spans in enumerate(base):
        yield sorted([*(m[:3] for m in spans), *more.get(i, [])], key=lambda s: (s[0], KINDS.index(s[2]), s[1])), confirmed[i]


def _groups(column: pa.Array, most: int = 2 << 20) -> Iterator[list[str]]:
    group, size = [], 0
    for x in column:
        group.append(x.as_py() or "")
        size += len(group[-1])
        if size > most:
            yield group
            group, size = [], 0
    if group:
        yield group


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find(docs: DataFrame, net: CharCNN | None = None) -> DataFrame:
    """doc_id, counts by base kind, the hash of the base spans, all spans, and the base spans that the network confirms, of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net or trained())

    def run(batches):
        for batch in batches:
            both = [s for g in _groups(batch.column(1)) for s in scan(g, shared.value)]
            rows = [spans for spans, _ in both]
            base = [[s for s in spans if s[2] != "learned"] for spans in rows]
            counts = [pa.array([sum(s[2] == kind for s in spans) for spans in base], pa.int64()) for kind in KINDS[:3]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in base], pa.string()), pa.array([joined(s) for s in rows], pa.string()), pa.array([n for _, n in both], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def redact(docs: DataFrame, net: CharCNN | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its ``text`` replaced by ``mark``; texts without spans stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(net or trained())
    at = docs.columns.index("text")
    kind = docs.schema["text"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [x.as_py() for x in batch.column(at)]
            out, i = [], 0
            for group in _groups(batch.column(at)):
                for text, (spans, _) in zip(group, scan(group, shared.value), strict=True):
                    parts, done = [], 0
                    for a, b, _ in spans:
                        if b > done:
                            parts += [text[done:a], mark] if a >= done else []
                            done = b
                    out.append(texts[i] if not spans else "".join(parts) + text[done:])
                    i += 1
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)
        release()

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {kind if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema.fields))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
