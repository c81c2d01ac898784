"""Byte-level tokens from a rank file that the caller names; word tokens remain the default elsewhere."""

from __future__ import annotations

import base64
import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType


@functools.cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(text: Column, path: str, pattern: str) -> Column:
    """Token ids; the vocabulary is read once in each worker."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        e = _encoding(path, pattern)
        return texts.map(lambda t: None if t is None else e.encode_ordinary(t))

    return run(text)


def safe_boundaries(pieces: list[bytes]) -> list[int]:
    """Numbers of leading tokens after which the bytes are whole characters; 0 and all included."""
    out, open_ = [0], 0
    for i, piece in enumerate(pieces, 1):
        for b in piece:
            if open_ and b & 0xC0 == 0x80:
                open_ -= 1
            else:
                open_ = 3 if b >= 0xF0 else 2 if b >= 0xE0 else 1 if b >= 0xC0 else 0
        if not open_:
            out.append(i)
    return out


def cut(boundaries: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows whose ends are boundaries: the largest that fit, and always further on."""
    import bisect

    n, start, out = boundaries[-1], 0, []
    while start < n:
        i = bisect.bisect_right(boundaries, start + size) - 1
        end = boundaries[i] if boundaries[i] > start else boundaries[bisect.bisect_right(boundaries, start)]
        out.append((start, end))
        if end == n:
            break
        back = boundaries[bisect.bisect_right(boundaries, max(end - overlap, 0)) - 1]
        start = back if back > start else end
    return out


WINDOWS = ArrayType(StructType([StructField("token_start", IntegerType()), StructField("token_end", IntegerType())]))


def windows(text: Column, path: str, pattern: str, size: int, overlap: int) -> Column:
    """Token windows that never split a character."""

    @F.pandas_udf(WINDOWS)
    def run(texts: pd.Series) -> pd.Series:
        e = _encoding(path, pattern)

        def one(t):
            return None if t is None else [{"token_start": a, "token_end": b} for a, b in cut(safe_boundaries([e.decode_single_token_bytes(i) for i in e.encode_ordinary(t)]), size, overlap)]

        return texts.map(one)

    return run(text)
