"""SimHash over word shingles (Charikar 2002), as Arrow functions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.functions.text import joined_tokens

#: Words of a shingle, and shingles that are made at a time.
SHINGLE_WORDS = 4
CHUNK = 16_384
#: Bytes of texts whose shingles are hashed at a time.
PIECE = 1 << 20
#: A limit for ``chars``: characters of a text that count. Whole texts count where none is given.
TEXT_CHARS = 262_144


def simhash_md5(rows: DataFrame, key: str, text: str, k: int = SHINGLE_WORDS, chars: int | None = None, chunk: int = PIECE) -> DataFrame:
    """Rows (key, sig), a row each; a shingle's feature is the first half of its MD5.

    Text without words gives 0. Texts come to Python with one space between words, so that shingles are
    slices of them; ``chunk`` bytes or so are taken at a time, and longer texts in runs that overlap by k - 1 words.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    spaced = joined_tokens(whole if chars is None else F.substring(whole, 1, chars))
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_signatures(batch.column(1), k, chunk))], names=[key, "sig"])

    return rows.select(key, spaced.alias("spaced")).mapInArrow(run, f"{key} {kind}, sig long")


def _signatures(texts: pa.Array, k: int, chunk: int) -> np.ndarray:
    """Signatures of texts whose words have one space between them."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    ones, n = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    for row, stops in _pieces(data, ends, k, chunk):
        some, m = _bit_counts(data[stops[0] : stops[-1]], stops - stops[0], k)
        ones[row : row + len(m)] += some
        n[row : row + len(m)] += m
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<i8")[:, 0]


def _pieces(data: np.ndarray, ends: np.ndarray, k: int, chunk: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, where it and those behind it start, and the end) of about ``chunk`` bytes; a longer row comes in runs, each by itself."""
    row, rows = 0, len(ends) - 1
    while row < rows:
        last = int(np.searchsorted(ends, ends[row] + chunk, "right")) - 1
        if last > row:
            yield row, ends[row : last + 1]
            row = last
            continue
        at, end, window = int(ends[row]), int(ends[row + 1]), chunk
        while end - at > window:
            spaces = np.flatnonzero(data[at : at + window] == 32)
            if len(spaces) < k:
                window *= 2
                continue
            yield row, np.array([at, at + spaces[-1]])
            at, window = at + int(spaces[-k]) + 1, max(chunk, window)
        yield row, np.array([at, end])
        row += 1


def _bit_counts(data: np.ndarray, stops: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each bit is set in the features of each text data[stops[i]:stops[i + 1]], and its shingles."""
    spaces = np.flatnonzero(data == 32)
    held = stops[1:] > stops[:-1]
    words = np.diff(np.searchsorted(spaces, stops)) + held
    n = np.where(words >= k, words - k + 1, held)
    ones = np.zeros((len(n), 64), np.int64)
    if not n.any():
        return ones, n
    starts = np.sort(np.concatenate([spaces + 1, stops[:-1][held]]), kind="stable")
    ends = np.sort(np.concatenate([spaces, stops[1:][held]]), kind="stable")
    first = np.repeat(np.cumsum(words) - words, n) + _counting(n)
    starts, ends = starts[first], ends[first + np.repeat(np.minimum(words, k) - 1, n)]
    bits = np.unpackbits(md5_halves(data, starts, ends - starts).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # sums of up to 255 rows fit into a byte, so eight bits are added at a time
    runs = -(-n // 255)
    at = np.repeat(np.cumsum(n) - n, runs) + 255 * _counting(runs)
    sums = np.add.reduceat(bits.view(np.uint64), at, axis=0).view(np.uint8).astype(np.int64)
    ones[n > 0] = np.add.reduceat(sums, (np.cumsum(runs) - runs)[n > 0], axis=0)
    return ones, n


def _counting(n: np.ndarray) -> np.ndarray:
    """0 to n[0] - 1, 0 to n[1] - 1 and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).astype(np.uint32)
_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32)
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
#: Of a word of eight bytes: the mask of its first i, and the bit behind them.
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_STOP = np.array([0x80 << 8 * i for i in range(8)], np.uint64)
#: Messages that are hashed side by side; their columns fit into the cache.
SIDE_BY_SIDE = 8192


def md5_halves(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first eight bytes of the MD5 of each data[start:start + length], as big-endian numbers."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ascontiguousarray(np.ndarray(len(data) + 1, "<u8", padded, strides=(1,)))
    out = np.empty(len(starts), np.uint64)
    blocks = (lengths + 8) // 64 + 1
    order = np.argsort(blocks, kind="stable") if len(blocks) and blocks.max() > 1 else np.arange(len(blocks))
    for i in range(0, len(order), SIDE_BY_SIDE):
        some = order[i : i + SIDE_BY_SIDE]
        start, length, left = starts[some], lengths[some], blocks[some]
        state = np.repeat(_START[:, None], len(some), axis=1)
        for block in range(int(left.max())):
            if block and len(some) > (go := int(np.count_nonzero(left > block))):  # the longest are last
                start, length, left, some = (x[-go:] for x in (start, length, left, some))
                state = np.ascontiguousarray(state[:, -go:])
            state = _md5_block(state, _message(eights, start, length, left == block + 1, block))
            done = left == block + 1
            swapped = state[:2, done].byteswap().astype(np.uint64)
            out[some[done]] = swapped[0] << np.uint64(32) | swapped[1]
    return out


def _message(eights: np.ndarray, start: np.ndarray, length: np.ndarray, last: np.ndarray, block: int) -> np.ndarray:
    """A block of each message as 16 rows of 32 bits, with the padding and, where it is the last, the length in bits."""
    words = np.empty((8, len(start)), np.uint64)
    for i in range(8):
        left = length - 64 * block - 8 * i
        words[i] = eights[np.minimum(start + 64 * block + 8 * i, len(eights) - 1)] & _KEEP[np.clip(left, 0, 8)]
        words[i] |= np.where((left >= 0) & (left < 8), _STOP[left & 7], np.uint64(0))
    words[7] |= np.where(last, length.astype(np.uint64) * np.uint64(8), np.uint64(0))
    out = np.empty((16, len(start)), np.uint32)
    out[0::2], out[1::2] = words & np.uint64(0xFFFFFFFF), words >> np.uint64(32)
    return out


def _md5_block(state: np.ndarray, message: np.ndarray) -> np.ndarray:
    """MD5's compression (RFC 1321) of a column for each message."""
    a, b, c, d = state.copy()
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _SINES[i]
        f += message[(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16]
        turn = _TURNS[i // 16, i % 4]
        np.left_shift(f, turn, out=t)
        np.right_shift(f, np.uint32(32) - turn, out=f)
        f |= t
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return np.stack([a, b, c, d]) + state


_WORD = re.compile(r"\w+")


def _grams(text: str, k: int, chunk: int) -> Iterator[list[bytes]]:
    """The shingles, some at a time; the words of a chunk overlap the next one's by k - 1."""
    found = (m[0].encode() for m in _WORD.finditer(text.lower()))
    words = list(islice(found, k))
    if len(words) < k:
        if words:
            yield [b" ".join(words)]
        return
    while len(words) >= k:
        yield list(map(b" ".join, zip(*(words[j:] for j in range(k)), strict=False)))
        words = words[len(words) - k + 1 :]
        words += islice(found, chunk)


def simhash_blake2(text: str, k: int = SHINGLE_WORDS, chunk: int = CHUNK) -> int:
    """Unsigned signature with 64-bit BLAKE2b features, big-endian; 0 without words."""
    counts, n = np.zeros(64, np.int64), 0
    for some in _grams(text, k, chunk):
        features = b"".join([hashlib.blake2b(gram, digest_size=8).digest() for gram in some])
        bits = np.unpackbits(np.frombuffer(features, np.uint8).reshape(-1, 8)[:, ::-1], axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(some)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def simhash_arrow(rows: DataFrame, key: str, text: str, k: int = SHINGLE_WORDS, chars: int | None = None) -> DataFrame:
    """Rows (key, sig) with BLAKE2b features, one Arrow batch at a time."""
    kind = dict(rows.dtypes)[key]

    def run(batches):
        for batch in batches:
            sigs = [simhash_blake2((t.as_py() or "")[:chars], k) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s - (1 << 64) if s >> 63 else s for s in sigs], pa.int64())], names=[key, "sig"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, sig long")
