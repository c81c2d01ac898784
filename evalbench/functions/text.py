"""Text expressions. Built-in functions by default; Unicode forms that Spark lacks are Arrow UDFs."""

from __future__ import annotations

import difflib
import functools
import math
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType

#: Letters without digits and underscore, as Java classes; grouped numbers first, then plain ones.
TOKEN = r"\p{Nd}{1,3}(?:,\p{Nd}{3})+(?:\.\p{Nd}+)?|\p{Nd}+(?:\.\p{Nd}+)?|[\p{L}\p{Nl}\p{No}]+"


@F.pandas_udf(StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity of two texts; asymmetric, so the earlier text comes first."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio_of_at_least(least: float):
    """``sequence_ratio`` where it is ``least`` or more, else null; bags of characters, or of pieces of long texts, are compared first as bounds from above."""

    @F.pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        out, match, last, size, bag, rare = [], difflib.SequenceMatcher(None, "", ""), None, 0, None, 0
        for x, y in zip(a, b, strict=True):
            long, found = len(y) >= INDEXED, 0.0
            if long or 2 * sum((Counter(x) & Counter(y)).values()) >= (least - 1e-9) * (len(x) + len(y)):
                if y != last:
                    last = y
                    if long:
                        rare, size = _rare(y), _piece_size(y, least)[0]
                        bag = _bag(y, size)
                if not long or len(np.intersect1d(_bag(x, size), bag, assume_unique=True)) >= _common_pieces(len(x) + len(y), rare, least, size):
                    if match.b is not y:
                        match.set_seq2(y)
                    match.set_seq1(x)
                    found = match.ratio()
            out.append(found if found >= least else None)
        return pd.Series(out, dtype="float64")

    return ratio


#: Words of bits for the letters of a text, and for its pairs of adjacent letters.
BIT_WORDS = 4


@F.pandas_udf(ArrayType(LongType()))
def letter_bits(text: pd.Series) -> pd.Series:
    """The bags of letters and of pairs of adjacent ones as ``BIT_WORDS`` words of bits each, and how many of each these leave out.

    Common bits of two texts, and the smaller number of left out ones, are no less than what they share.
    """
    n, words = len(text), BIT_WORDS

    def unary(rows: np.ndarray, values: np.ndarray, most: int) -> list[np.ndarray]:
        """A bit for each of the first ``most`` values of a class; the number of values beyond."""
        classes = 64 * words // most
        counts = np.bincount(rows * classes + values % classes, minlength=classes * n).reshape(n, classes)
        held = np.minimum(counts, most)
        return [np.packbits(np.arange(most) < held[:, :, None]).view("<i8").reshape(n, words), (counts - held).sum(axis=1)]

    codes = np.frombuffer("".join(text).encode("utf-32-le"), "<u4").astype(np.int64)
    rows = np.repeat(np.arange(n), text.str.len().to_numpy(dtype=np.int64))
    inner = np.flatnonzero(rows[1:] == rows[:-1])
    pairs = ((codes[inner] * 1_000_003 + codes[inner + 1]) * 0x9E3779B1 >> 20) & 0xFFFFFF
    letters, left = unary(rows, codes, 8)
    paired, unpaired = unary(rows[inner], pairs, 4)
    return pd.Series(list(np.column_stack([letters, paired, left, unpaired])))


def nearly_contains(least: float):
    """Whether a text has a window of the needle's length, at steps of a tenth of it, with a ratio of ``least`` or more; null needles give null."""

    def windows(x: str, y: str, step: int):
        """Starts of windows of which as many letters as needed are in the bag of ``x``, a bound of the ratio from above."""
        n, own, theirs = len(x), np.frombuffer(x.encode("utf-32-le"), "<u4"), np.frombuffer(y.encode("utf-32-le"), "<u4")
        letters, counts = np.unique(own, return_counts=True)
        place = np.minimum(np.searchsorted(letters, theirs), len(letters) - 1)
        at = np.flatnonzero(letters[place] == theirs)
        many, width = (len(y) - n) // step + 1, len(letters)

        def before(first: int) -> np.ndarray:
            """Letters of each kind before the places first, first + step, ..."""
            row = np.maximum((at - first) // step + 1, 0)
            near = row < many
            return np.bincount(row[near] * width + place[at[near]], minlength=many * width).reshape(many, width).cumsum(axis=0)

        shared = np.minimum(before(n) - before(0), counts).sum(axis=1)
        return (np.flatnonzero(shared >= (least - 1e-9) * n) * step).tolist()

    @F.pandas_udf(BooleanType())
    def found(needle: pd.Series, text: pd.Series) -> pd.Series:
        out = []
        match = difflib.SequenceMatcher(None, "", "")
        for x, y in zip(needle, text, strict=True):
            if x is None or y is None:
                out.append(None)
                continue
            n, ok = len(x), False
            for at in windows(x, y, max(1, n // 10)) if 0 < n <= len(y) else [0] * (not n):
                match.set_seqs(x, y[at : at + n])
                if match.ratio() >= least:
                    ok = True
                    break
            out.append(ok)
        return pd.Series(out, dtype="object")

    return found


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def _piece_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` letters, a power of two, from each place on."""
    h, step = codes * np.uint64(0x9E3779B97F4A7C15), 1
    while step < length:
        h = h[:-step] * np.uint64(0xBF58476D1CE4E5B9 + 2 * step) + h[step:] if len(h) > step else h[:0]
        h = h ^ (h >> np.uint64(29))
        step *= 2
    return h


def piece_keys(length: int, width: int, first: bool = False):
    """The distinct least hashes of each ``width`` neighbouring pieces of ``length`` letters; with ``first`` only that of the first ones.

    The first key of a text of ``length + width - 1`` letters or more is a key of every text that contains it. Both are
    powers of two.
    """

    @F.pandas_udf(ArrayType(LongType()))
    def keys(text: pd.Series) -> pd.Series:
        out = []
        for x in text:
            h = _piece_hashes(_codes((x or "")[: length + width - 1 if first else None]), length)
            step = 1
            while step < width:
                h = np.minimum(h[:-step], h[step:]) if len(h) > step else h[:0]
                step *= 2
            out.append(np.unique(h).view(np.int64))
        return pd.Series(out, dtype="object")

    return keys


#: SequenceMatcher looks for no letter that is more than a hundredth of a second text of this length or more (popular ones).
INDEXED = 200
#: Letters of the pieces that are counted of long texts; hashes of a bag of pieces; what long texts that are alike share of these bags at least.
PIECE_SIZES, HASHES, SHARED = (24, 12, 8, 6, 4, 3, 2, 1), 128, 0.25
#: The chance that two bags agree in fewer of their hashes than they are asked to.
MISSED = 1e-8


@functools.cache
def _agreeing(hundredths: int) -> int:
    """Hashes that two bags which share so much agree in, but for a chance of ``MISSED``."""
    p, below, n = hundredths / 100, 0.0, 0
    while n < HASHES:
        below += math.comb(HASHES, n) * p**n * (1 - p) ** (HASHES - n)
        if below > MISSED:
            break
        n += 1
    return n


def _rare(text: str) -> int:
    """Letters of a second text that SequenceMatcher looks for."""
    return sum(c for c in Counter(text).values() if c <= len(text) // 100 + 1)


def _common_pieces(total: float, rare: int, least: float, size: int) -> float:
    """Pieces that two texts of ``total`` letters and of a ratio of ``least`` or more have in common at least.

    Matched letters are in blocks, at most one more than there are unmatched letters. If the second text is long, each
    block has a rare letter of it or is the start of a range without one, so there are at most 2 * rare + 1. A block of
    n letters holds n - size + 1 pieces.
    """
    blocks = min(2 * rare + 1, math.floor((1 - least) * total + 1e-6) + 1)
    return least * total / 2 - 1e-6 - (size - 1) * blocks


def _piece_size(text: str, least: float) -> tuple[int, int]:
    """Letters of the longest pieces of which every text before that is alike shares ``SHARED`` of both bags; hashes that agree then."""
    rare, total = _rare(text), 2 * len(text) / (2 - least)  # with the shortest text that can be alike; longer ones share more
    for size in PIECE_SIZES:
        common = max(least * total / 2 - (size - 1) * (2 * rare + 1), least * total / 2 - (size - 1) * ((1 - least) * total + 1)) - 1e-6
        if common >= SHARED * (total - common):
            break
    return size, _agreeing(int(100 * common / (total - common)))


def _bag(text: str, size: int) -> np.ndarray:
    """Hashes of the pieces of ``size`` letters, where the second of two equal ones is another, and so on."""
    power = 1 << size.bit_length() - 1
    h = _piece_hashes(_codes(text), power)
    if power < size:
        h = h[: power - size] * np.uint64(0x94D049BB133111EB) + h[size - power :] if len(text) >= size else h[:0]
    h = np.sort(h)
    place = np.arange(len(h))
    first = np.maximum.accumulate(np.where(np.r_[True, h[1:] != h[:-1]], place, 0)) if len(h) else place
    h = (h + (place - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def piece_size(least: float):
    """struct(size, agree) of long texts: letters of the pieces that they have in common with each earlier text that is alike, and in how many hashes both agree; nulls for others."""

    @F.pandas_udf("size int, agree int")
    def size(text: pd.Series) -> pd.DataFrame:
        found = [_piece_size(x, least) if len(x) >= INDEXED else (None, None) for x in text]
        return pd.DataFrame(found, columns=["size", "agree"]).astype("Int32")

    return size


def bag_hashes(size: int):
    """The least of the bag of pieces by each of ``HASHES`` hash functions; two bags agree in as large a part of them as they share."""

    odd = np.random.default_rng(128).integers(0, 2**64, HASHES, dtype=np.uint64) | np.uint64(1)

    @F.pandas_udf(ArrayType(LongType()))
    def hashes(text: pd.Series) -> pd.Series:
        out = []
        for x in text:
            bag, least = _bag(x, size), np.zeros(HASHES, dtype=np.uint64)
            for j in range(HASHES if len(bag) else 0):
                least[j] = (bag * odd[j]).min()  # the bag holds hashes already
            out.append(least.view(np.int64) if len(bag) else least[:0].view(np.int64))
        return pd.Series(out, dtype="object")

    return hashes


#: Letters of a needle that are looked up before it is searched for.
LOOKED_UP = 8


@F.pandas_udf(ArrayType(StringType()))
def held(text: pd.Series, needles: pd.Series) -> pd.Series:
    """Those of ``needles`` that the text contains; the text is read once for all of ``LOOKED_UP`` letters or more."""
    out = []
    for x, some in zip(text, needles, strict=True):
        if x is None or some is None:
            out.append([])
            continue
        long = [n for n in some if len(n) >= LOOKED_UP]
        if long:
            starts = _piece_hashes(_codes("".join(n[:LOOKED_UP] for n in long)), LOOKED_UP)[::LOOKED_UP]
            h, marked = _piece_hashes(_codes(x), LOOKED_UP), np.zeros(1 << 16, dtype=bool)
            marked[starts & np.uint64(0xFFFF)] = True
            met = np.isin(starts, h[marked[h & np.uint64(0xFFFF)]])
            long = [n for n, ok in zip(long, met, strict=True) if ok]
        out.append([n for n in [*long, *(n for n in some if len(n) < LOOKED_UP)] if n in x])
    return pd.Series(out, dtype="object")


#: Fixed value: the namespace of names that are URLs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5_url(name: Column) -> Column:
    """The name-based (SHA-1) identifier of a URL: 16 bytes of the hash with version 5 and the usual variant."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def valid_url(text: Column) -> Column:
    """An absolute http or https URL with a host and without blanks."""
    return F.coalesce(text.rlike(r"^https?://[^\s/?#]+\S*$") & F.try_parse_url(text, F.lit("HOST")).isNotNull(), F.lit(False))


def iso_date(text: Column) -> Column:
    """The date of a text of just the form YYYY-MM-DD; null where it is none."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def frozen(json: Column) -> Column:
    """A JSON object of texts with its keys in order, so that equal objects are equal texts."""
    entries = F.array_sort(F.map_entries(F.from_json(json, "map<string,string>")))
    return F.to_json(F.map_from_entries(entries))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header: a number of seconds, or an HTTP date (0 if it has passed); null where it is neither."""
    at = F.try_to_timestamp(F.substring(value, 6, 20), F.lit("dd MMM yyyy HH:mm:ss"))
    dated = F.when(value.rlike(r"^[A-Z][a-z]{2}, [0-9]{2} [A-Z][a-z]{2} [0-9]{4} [0-9:]{8} GMT$"), F.greatest(F.lit(0.0), (at.cast("double") - now.cast("double"))))
    return F.when(value.rlike(r"^[0-9]+(\.[0-9]+)?$"), value.cast("double")).otherwise(dated)


def fold(text: Column, unicode_forms: bool = False) -> Column:
    """Case folding; exact for all scripts with ``unicode_forms``, else lower case with the sharp s written out."""
    return nfkc_casefold(text) if unicode_forms else F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column, unicode_forms: bool = False) -> Column:
    return F.regexp_extract_all(fold(text, unicode_forms), F.lit(TOKEN), 0)


#: The full-width forms of the ASCII letters and digits, these, and all others of both, which squashing drops.
_PLAIN = "".join(c for c in map(chr, range(0x21, 0x7F)) if c.isalnum())
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in _PLAIN)
_DROPPED = "".join(chr(x) for x in [*range(0x80), *range(0xFF01, 0xFF5F)] if chr(x) not in _PLAIN + _WIDE)


def squash(text: Column, unicode_forms: bool = False) -> Column:
    """Search text: digits, a-z and Hangul syllables of the lower-cased text; full-width letters and digits count as plain ones.

    Blanks and other ASCII go before the pattern, so it has one range to look for, as a class of several costs most of
    the time. Other compatibility forms only with ``unicode_forms``, which costs an Arrow UDF.
    """
    plain = F.translate(nfkc(text) if unicode_forms else text, _WIDE + _DROPPED, _PLAIN)
    return F.regexp_replace(F.lower(plain), r"[\x80-\x{10FFFF}](?<![가-힣])", "")


def answer_key(text: Column, unicode_forms: bool = False) -> Column:
    """For exact answers: no punctuation, separators or white space."""
    return F.regexp_replace(fold(text, unicode_forms), r"[\p{P}\p{Z}\s]+", "")


def normal_lines(text: Column) -> Column:
    """One kind of line end, inner runs of blanks closed up, no blanks at line ends, no outer newlines."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"(?m)(?<=[^\n \f\x0B])[ \f\x0B]{2,}", " ")
    return F.regexp_replace(F.regexp_replace(t, r"(?m)[ \t\f\x0B]+$", ""), r"\A\n+|\n+\z", "")


def numbers(text: Column) -> Column:
    """The distinct numbers of a text, without grouping commas."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[+-]?[0-9][0-9,]*(?:\.[0-9]+)?"), 0), lambda x: F.regexp_replace(x, ",", "")))


def fingerprint(question: Column) -> Column:
    """Squashed question without one polite ending."""
    return F.regexp_replace(squash(question), "(인가요|인가|입니까)$", "")


def heading_level(content: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(6), F.length(F.regexp_extract(content, "^(#*)", 1))))


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of the JSON object of string, integer or array fields, keys sorted."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def hash_index(key: Column, n: Column) -> Column:
    """A reproducible index below ``n`` from a text key."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n
