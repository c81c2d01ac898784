"""Baseline JPEG files that this package did not write: AC symbols, sampling factors, restart intervals, odd sizes."""

import random
import struct

import numpy as np
import pytest

from evalbench.llm import media


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def bytes(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        raw = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
        return raw.replace(b"\xff", b"\xff\x00")


def magnitude(v):
    n = abs(v).bit_length()
    return n, v if v > 0 else v + (1 << n) - 1


def jpeg(r, width, height, sampling, restart, quant):
    """(file, luminance DC by block row and column) of random blocks; codes are all of 4 bits for DC, 8 for AC."""
    dc_symbols = list(range(12))
    ac_symbols = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 9))]
    dc_code, ac_code = {s: i for i, s in enumerate(dc_symbols)}, {s: i for i, s in enumerate(ac_symbols)}
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    if len(sampling) == 1:  # a scan of one component goes block by block
        across, down, sampling_in_scan = -(-width // 8), -(-height // 8), [(1, 1)]
    else:
        sampling_in_scan = sampling
    h0, v0 = sampling_in_scan[0]
    luminance = np.zeros((down * v0, across * h0), int)
    scan, bits, last = b"", Bits(), [0] * len(sampling)
    for mcu in range(across * down):
        if restart and mcu and mcu % restart == 0:
            scan += bits.bytes() + bytes([0xFF, 0xD0 + (mcu // restart - 1) % 8])
            bits, last = Bits(), [0] * len(sampling)
        y, x = divmod(mcu, across)
        for c, (h, v) in enumerate(sampling_in_scan):
            for by in range(v):
                for bx in range(h):
                    dc = r.randint(-900, 900) // quant
                    if c == 0:
                        luminance[y * v + by, x * h + bx] = dc
                    n, value = magnitude(dc - last[c])
                    last[c] = dc
                    bits.put(dc_code[n], 4)
                    bits.put(value, n)
                    k, ac = 1, [r.randint(-200, 200) if r.random() < r.choice([0, 0.02, 0.3]) else 0 for _ in range(63)]
                    while k < 64 and any(ac[k - 1 :]):
                        run = 0
                        while ac[k - 1] == 0:
                            run, k = run + 1, k + 1
                        while run > 15:
                            bits.put(ac_code[0xF0], 8)
                            run -= 16
                        n, value = magnitude(ac[k - 1])
                        bits.put(ac_code[run << 4 | n], 8)
                        bits.put(value, n)
                        k += 1
                    if k < 64:
                        bits.put(ac_code[0x00], 8)
    scan += bits.bytes()
    segment = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    counts = lambda n, length: bytes(n if i == length else 0 for i in range(1, 17))
    parts = [b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), segment(0xFE, b"a comment \xff\xd9 inside"), segment(0xDB, b"\0" + bytes([quant] * 64))]
    parts.append(segment(0xC0, struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(sampling))))
    parts.append(segment(0xC4, b"\0" + counts(len(dc_symbols), 4) + bytes(dc_symbols) + b"\x10" + counts(len(ac_symbols), 8) + bytes(ac_symbols)))
    if restart:
        parts.append(segment(0xDD, struct.pack(">H", restart)))
    parts.append(segment(0xDA, bytes([len(sampling)]) + b"".join(bytes([c + 1, 0]) for c in range(len(sampling))) + b"\0\x3f\0"))
    return b"".join(parts) + scan + b"\xff\xd9", luminance


@pytest.mark.parametrize("sampling", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 1)]])
@pytest.mark.parametrize("restart", [0, 1, 3])
def test_thumbnails_of_foreign_files(sampling, restart):
    r = random.Random(len(sampling) * 10 + restart)
    files, want = [], []
    for _ in range(12):
        width, height, quant = r.randint(1, 90), r.randint(1, 90), r.choice([1, 3, 8, 16])
        file, dc = jpeg(r, width, height, sampling, restart, quant)
        files.append(file)
        rows, columns = -(-height // 8), -(-width // 8)
        want.append(np.clip(np.rint(dc[:rows, :columns] * quant / 8 + 128), 0, 255).astype(int))
    for got, expected in zip(media.decode_many(files), want, strict=True):
        assert len(got) == 1 and got[0].shape == expected.shape and np.abs(got[0].astype(int) - expected).max() <= 1


def test_broken_files_raise():
    file, _ = jpeg(random.Random(1), 40, 40, [(1, 1)] * 3, 0, 8)
    for bad in (b"", b"GIF89a", file[:100], file[:-2], file.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(ValueError):
            if not media.decode_many([bad])[0]:
                raise ValueError("no image")
