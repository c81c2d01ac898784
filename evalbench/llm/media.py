"""Operator 9: baseline JPEG storage, DC-only luminance thumbnails and their hashes, in numpy.

A payload byte is stored as one sample of a DC-only luminance image: block (y, x) of the image is flat, and
its quantised DC coefficient is the byte minus 128 with a DC quantiser of 8, so that the block's mean
luminance - the thumbnail's pixel - is the byte itself, without loss. 64 bytes make one row of blocks and
one restart interval. The decoder is a general baseline decoder for the DC part: it parses the markers,
Huffman-decodes whole scans (AC symbols too, any sampling factors) and advances all restart intervals of all
images at once, one block per step, which keeps the work in numpy.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal values; repeated rows give
repeated results; long texts use wider images (and several images, one after the other, beyond 64 MB);
other columns are not read. Truncated or non-baseline files raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalbench.llm._spark import table

ROW = 64
MOST_ROWS = 8191  # blocks; a side has at most 65535 pixels
MOST_BYTES = ROW * 128 * MOST_ROWS
#: DC code: counts by length 1-16 and symbols (magnitude categories), ordered for text.
DC_COUNTS, DC_SYMBOLS = [0, 1, 5, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], [4, 5, 6, 7, 3, 2, 1, 0, 8]
#: AC code: end of block alone.
AC_COUNTS, AC_SYMBOLS = [1] + [0] * 15, [0]


def codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a canonical Huffman table."""
    out, code, at = {}, 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            out[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def lookup(counts: list[int], symbols: list[int]) -> np.ndarray:
    """By the next 16 bits: symbol << 8 | length; length 0 where no code fits."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in codes(counts, symbols).items():
        table[code << (16 - length) : (code + 1) << (16 - length)] = symbol << 8 | length
    return table


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """By DC difference + 255: the bits of a flat block (category, magnitude, end of block) and their number."""
    dc, end = codes(DC_COUNTS, DC_SYMBOLS), codes(AC_COUNTS, AC_SYMBOLS)[0]
    bits, lengths = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, length = dc[size]
        magnitude = d if d >= 0 else d + (1 << size) - 1
        bits[d + 255] = ((code << size | magnitude) << end[1]) | end[0]
        lengths[d + 255] = length + size + end[1]
    return bits, lengths


_BITS, _LENGTHS = _block_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(width: int, height: int, restart: int) -> bytes:
    """All markers before the scan's data; sides in pixels, one luminance component."""
    quant = bytes([8] + [1] * 63)
    return b"".join([
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
        _segment(0xDB, b"\0" + quant),
        _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\0"),
        _segment(0xC4, b"\0" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS)),
        _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS)),
        _segment(0xDD, struct.pack(">H", restart)),
        _segment(0xDA, b"\x01\x01\0\0\x3f\0"),
    ])


def _rows_to_scan(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of each row of samples (a restart interval), 1-padded and stuffed; and their offsets."""
    n = len(rows)
    q = rows.astype(np.int16) - 128
    diff = np.empty_like(q)
    diff[:, 0] = q[:, 0]
    np.subtract(q[:, 1:], q[:, :-1], out=diff[:, 1:])
    at = diff.astype(np.intp) + 255
    bits, lengths = _BITS[at], _LENGTHS[at]
    ends = np.cumsum(lengths, axis=1)
    wide = int(ends[:, -1].max()) // 8 + 5 if n else 5
    buffer = np.zeros((n, wide), np.uint8)
    flat, base = buffer.reshape(-1), np.arange(n) * wide
    starts = ends - lengths
    for j in range(rows.shape[1]):
        first = base + (starts[:, j] >> 3)
        # at most 15 bits a block, so 4 bytes from the first hold them
        word = bits[:, j] << (32 - lengths[:, j] - (starts[:, j] & 7)).astype(np.uint32)
        flat[first] |= (word >> np.uint32(24)).astype(np.uint8)
        flat[first + 1] |= (word >> np.uint32(16) & np.uint32(255)).astype(np.uint8)
        flat[first + 2] |= (word >> np.uint32(8) & np.uint32(255)).astype(np.uint8)
        flat[first + 3] |= (word & np.uint32(255)).astype(np.uint8)
    total = ends[:, -1]
    used = (total + 7) >> 3
    rest = used * 8 - total
    flat[base + used - 1] |= ((1 << rest) - 1).astype(np.uint8)
    keep = np.arange(wide)[None, :] < used[:, None]
    body = buffer[keep]
    stuffed = body == 0xFF
    place = np.arange(len(body)) + np.concatenate([[0], np.cumsum(stuffed)[:-1]]) if len(body) else np.zeros(0, int)
    out = np.zeros(len(body) + int(stuffed.sum()), np.uint8)
    out[place] = body
    extra = np.concatenate([[0], np.cumsum(stuffed)])
    off = np.concatenate([[0], np.cumsum(used)])
    return out, off + extra[off]


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """One stored form per payload; payload lengths are positive multiples of 64, at most ``MOST_BYTES``."""
    if not payloads:
        return []
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW)
    scan, off = _rows_to_scan(rows)
    scan, out, row = scan.tobytes(), [], 0
    for payload in payloads:
        n = len(payload) // ROW
        across = -(-n // MOST_ROWS)  # rows of 64 blocks side by side
        down = -(-n // across)
        parts = [header(across * ROW * 8, down * 8, ROW)]
        total = across * down
        for i in range(total):
            parts.append(scan[off[row + i] : off[row + i + 1]] if i < n else _BLANK)
            if i + 1 < total:
                parts.append(_RST[i & 7])
        parts.append(b"\xff\xd9")
        out.append(b"".join(parts))
        row += n
    return out


_RST = [bytes([0xFF, 0xD0 + i]) for i in range(8)]
_BLANK = _rows_to_scan(np.zeros((1, ROW), np.uint8))[0].tobytes()


@dataclass
class Frame:
    """What the markers of one image say, and where its restart intervals lie (byte ranges in the file)."""

    width: int
    height: int
    components: list[tuple[int, int, int, int]]  # id, horizontal and vertical sampling, quantiser
    quant: dict[int, int]
    tables: dict[tuple[int, int], np.ndarray]
    scan: list[tuple[int, int, int]]  # component, DC table, AC table
    restart: int
    intervals: list[tuple[int, int]]
    end: int


def parse(data: bytes, at: int = 0) -> Frame:
    """The first image at ``at``: markers in full, scan data by position only."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at, f = at + 2, Frame(0, 0, [], {}, {}, [], 0, [], 0)
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("broken marker")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                f.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + n :]
        elif marker == 0xC0:
            _, f.height, f.width, n = struct.unpack(">BHHB", body[:6])
            f.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a baseline image")
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                n = sum(counts)
                f.tables[body[0] >> 4, body[0] & 15] = _cached_lookup(bytes(body[1 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDD:
            f.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            f.scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            break
    raw = np.frombuffer(data, np.uint8)
    start = at
    # 0xFF followed by neither 0 nor another 0xFF is a marker
    while True:
        found = data.find(b"\xff", at)
        if found < 0 or found + 1 >= len(raw):
            raise ValueError("no end of image")
        after = data[found + 1]
        if 0xD0 <= after <= 0xD7:
            f.intervals.append((start, found))
            start = found + 2
        elif after not in (0, 0xFF):
            f.intervals.append((start, found))
            f.end = found
            break
        at = found + (1 if after == 0xFF else 2)
    if data[f.end : f.end + 2] != b"\xff\xd9":
        raise ValueError("a single scan and no more is read")
    f.end += 2
    return f


_lookups: dict[bytes, np.ndarray] = {}


def _cached_lookup(spec: bytes) -> np.ndarray:
    if spec not in _lookups:
        if len(_lookups) > 64:
            _lookups.clear()
        _lookups[spec] = lookup(list(spec[:16]), list(spec[16:]))
    return _lookups[spec]


def _peek(buf: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The next 16 bits at each bit position."""
    at = pos >> 3
    word = buf[at].astype(np.uint32) << np.uint32(16) | buf[at + 1].astype(np.uint32) << np.uint32(8) | buf[at + 2]
    return (word >> (8 - (pos & 7)).astype(np.uint32)) & np.uint32(0xFFFF)


def _receive(buf: np.ndarray, pos: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed value whose ``size`` bits come next."""
    raw = (_peek(buf, pos) >> (16 - size).astype(np.uint32)).astype(np.int64)
    return np.where(raw < (np.int64(1) << np.maximum(size - 1, 0)), raw - (np.int64(1) << size) + 1, raw) * (size > 0)


def decode_many(files: list[bytes]) -> list[list[np.ndarray]]:
    """By file, its images' DC-only luminance thumbnails (uint8, one pixel a block of the first component)."""
    jobs: list[tuple[int, Frame]] = []
    for i, data in enumerate(files):
        at = 0
        while at < len(data):
            frame = parse(data, at)
            jobs.append((i, frame))
            at = frame.end
    out: list[list[np.ndarray]] = [[] for _ in files]
    alike: dict[tuple, list[tuple[int, Frame]]] = {}
    for i, f in jobs:  # images of one kind advance together
        alike.setdefault((tuple(f.components), tuple(f.scan), f.restart, tuple(sorted((k, id(t)) for k, t in f.tables.items())), tuple(sorted(f.quant.items())), f.restart or (f.width, f.height)), []).append((i, f))
    done: dict[int, np.ndarray] = {}
    for group in alike.values():
        for (i, f), thumbnail in zip(group, _decode_group([(files[i], f) for i, f in group]), strict=True):
            done[id(f)] = thumbnail
    for i, f in jobs:
        out[i].append(done[id(f)])
    return out


def _decode_group(group: list[tuple[bytes, Frame]]) -> list[np.ndarray]:
    f = group[0][1]
    chosen = {c: (dc, ac) for c, dc, ac in f.scan}
    alone = len(f.components) == 1
    #: blocks of an MCU: (component index, block column, block row)
    h_most, v_most = max(c[1] for c in f.components), max(c[2] for c in f.components)
    layout = [(0, 0, 0)] if alone else [(k, x, y) for k, c in enumerate(f.components) for y in range(c[2]) for x in range(c[1])]
    sizes = []  # MCUs across and down
    for _, g in group:
        pixels = (8, 8) if alone else (8 * h_most, 8 * v_most)
        sizes.append((-(-g.width // pixels[0]), -(-g.height // pixels[1])))
    per = [g.restart or across * down for (_, g), (across, down) in zip(group, sizes, strict=True)]
    pieces, lengths, left, owner = [], [], [], []
    for n, ((data, g), (across, down)) in enumerate(zip(group, sizes, strict=True)):
        total = across * down
        if len(g.intervals) != -(-total // per[n]):
            raise ValueError("restart intervals are missing")
        for k, (a, b) in enumerate(g.intervals):
            piece = data[a:b].replace(b"\xff\x00", b"\xff") + b"\0\0\0\0"
            pieces.append(piece)
            lengths.append(len(piece))
            left.append(min(per[n], total - k * per[n]))
            owner.append(n)
    buf = np.frombuffer(b"".join(pieces), np.uint8)
    stop = np.cumsum(lengths)
    pos = (stop - lengths) * 8
    limit = (stop - 4) * 8
    left = np.array(left)
    steps, lum = int(left.max()), [j for j, (k, _, _) in enumerate(layout) if k == 0]
    values = np.zeros((len(left), steps, len(lum)), np.int32)
    prediction = np.zeros((len(f.components), len(left)), np.int64)
    for step in range(steps):
        live = np.flatnonzero(left > step)
        everyone = len(live) == len(left)
        for j, (k, _, _) in enumerate(layout):
            dc, ac = chosen[f.components[k][0]]
            p = pos if everyone else pos[live]
            found = f.tables[0, dc][_peek(buf, p)]
            if not found.all():
                raise ValueError("no such DC code")
            p = p + (found & 255)
            size = found >> 8
            value = (prediction[k] if everyone else prediction[k, live]) + _receive(buf, p, size)
            p = p + size
            # AC: symbols until the block is full or ended
            table, on, filled = f.tables[1, ac], np.arange(len(p)), np.ones(len(p), np.int64)
            while len(on):
                found = table[_peek(buf, p[on])]
                if not found.all():
                    raise ValueError("no such AC code")
                symbol = found >> 8
                p[on] += (found & 255) + (symbol & 15)
                more = symbol != 0
                filled[on] += (symbol >> 4) + 1
                on = on[more & (filled[on] < 64)]
            if everyone:
                pos, prediction[k] = p, value
            else:
                pos[live], prediction[k, live] = p, value
            if k == 0:
                values[live, step, lum.index(j)] = value
    if (pos > limit).any():
        raise ValueError("an interval ends early")
    quant = f.quant[f.components[0][3]]
    shade = np.clip((values * quant + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    out, row, owner = [], 0, np.array(owner)
    counts = np.bincount(owner, minlength=len(group))
    for n, (across, down) in enumerate(sizes):
        own = shade[row : row + counts[n]].reshape(-1, len(lum))[: across * down]
        row += counts[n]
        h, v = (1, 1) if alone else f.components[0][1:3]
        picture = own.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        g = group[n][1]
        out.append(picture[: -(-g.height * v // (8 * (1 if alone else v_most))), : -(-g.width * h // (8 * (1 if alone else h_most)))])
    return out


def thumbnail_hash(picture: np.ndarray) -> str:
    """64 bits: in an 8 x 9 reduction by means, whether each cell is darker than the one at its right."""
    rows = np.linspace(0, picture.shape[0], 9).astype(int)
    cols = np.linspace(0, picture.shape[1], 10).astype(int)
    lo_r, lo_c = np.minimum(rows[:-1], picture.shape[0] - 1), np.minimum(cols[:-1], picture.shape[1] - 1)
    hi_r, hi_c = np.maximum(rows[1:], lo_r + 1), np.maximum(cols[1:], lo_c + 1)
    sums = np.zeros((picture.shape[0] + 1, picture.shape[1] + 1), np.int64)
    sums[1:, 1:] = picture.astype(np.int64).cumsum(0).cumsum(1)
    area = (hi_r - lo_r)[:, None] * (hi_c - lo_c)[None, :]
    mean = (sums[hi_r][:, hi_c] - sums[lo_r][:, hi_c] - sums[hi_r][:, lo_c] + sums[lo_r][:, lo_c]) / area
    return np.packbits(mean[:, :-1] < mean[:, 1:]).tobytes().hex()


def pad(text: bytes) -> bytes:
    return text + bytes(-len(text) % ROW or (0 if text else ROW))


def store(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload: one image, or several for very long ones."""
    parts = [[p[i : i + MOST_BYTES] for i in range(0, len(p), MOST_BYTES)] for p in payloads]
    files = iter(encode_many([x for xs in parts for x in xs]))
    return [b"".join(next(files) for _ in xs) for xs in parts]


def load(pictures: list[np.ndarray], n: int) -> bytes:
    """The first ``n`` stored bytes of a file's thumbnails."""
    return b"".join(p.tobytes() for p in pictures)[:n]


def inspect(media: DataFrame, column: str = "media") -> DataFrame:
    """``media`` with ``width``, ``height``, ``thumbnail`` (binary, row by row) and ``thumbnail_hash`` of the JPEG files in a column, in place of columns of these names."""
    media = media.drop("width", "height", "thumbnail", "thumbnail_hash")

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(column).to_pylist():
                if data is None:
                    rows.append((None, None, None, None))
                else:
                    f, picture = parse(data), decode_many([data])[0][0]
                    rows.append((f.width, f.height, picture.tobytes(), thumbnail_hash(picture)))
            more = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "width", "height", "thumbnail", "thumbnail_hash"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields)
    return media.mapInArrow(run, f"{fields}, width int, height int, thumbnail binary, thumbnail_hash string")


def text_media(docs: DataFrame, keep: bool = False) -> DataFrame:
    """Each whole text as a stored image read back, with its digests; ``keep`` adds the file as ``media``."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            start, size, group = 0, 0, []
            for i in range(len(texts)):
                raw = (texts[i].as_py() or "").encode("utf-8", "surrogatepass")
                group.append(raw)
                size += len(raw)
                if size > 3 << 20 or i + 1 == len(texts):
                    yield _digest(ids.slice(start, len(group)), group, keep)
                    start, size, group = i + 1, 0, []

    more = ", media binary" if keep else ""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + more)


def _digest(ids: pa.Array, texts: list[bytes], keep: bool) -> pa.RecordBatch:
    sizes = [len(pad(t)) for t in texts]
    files = store([pad(t) for t in texts])
    pictures = decode_many(files)
    back = []
    for file, pics, n in zip(files, pictures, sizes, strict=True):
        f = parse_size(file)
        # rows of 64 blocks lie side by side in wide images; the file's order is by restart interval
        back.append(load(pics, n))
        if f[0] // 8 % ROW:
            raise ValueError("not a stored text")
    columns = {
        "doc_id": ids,
        "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
        "payload_bytes": pa.array([len(b) for b in back], pa.int64()),
        "payload_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
        "tail_crc32": pa.array([zlib.crc32(b[-ROW:]) for b in back], pa.int64()),
        "media_bytes": pa.array([len(f) for f in files], pa.int64()),
        "media_sha256": pa.array([hashlib.sha256(f).hexdigest() for f in files], pa.string()),
        "feature": pa.array([";".join(f"{p.shape[1]}x{p.shape[0]}:{thumbnail_hash(p)}" for p in pics) for pics in pictures], pa.string()),
    }
    if keep:
        columns["media"] = pa.array(files, pa.binary())
    return pa.RecordBatch.from_pydict(columns)


def parse_size(data: bytes) -> tuple[int, int]:
    """Width and height from the frame header, without reading the scan."""
    at = 2
    while data[at + 1] != 0xC0:
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))
