"""Vectorised text kernels shared by the operators: NumPy over raw UTF-8 bytes, no per-word Python objects."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

U = np.uint64
_R = U(0x9E3779B97F4A7C15 | 1)
_RINV = U(pow(int(_R), -1, 1 << 64))
#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORDY = np.zeros(256, bool)
_WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: 0 for white space; without and with runs of signs as words of their own.
_KINDS = (~_SPACE).astype(np.uint8), np.where(_SPACE, 0, np.where(_WORDY, 1, 2)).astype(np.uint8)
#: Texts are hashed in runs of whole documents of about this many bytes, which bounds the scratch arrays.
SLICE = (1 << 20) - 4096


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    y = x >> U(33)
    y ^= x
    y *= U(0xFF51AFD7ED558CCD)
    y ^= y >> U(33)
    y *= U(0xC4CEB9FE1A85EC53)
    y ^= y >> U(33)
    return y


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03))


@functools.lru_cache(2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    with np.errstate(over="ignore"):
        up, down = np.full(n, _R, U), np.full(n, _RINV, U)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i up to n."""
    return _powers(max(21, int(n).bit_length()))  # one table for all usual lengths


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * R**i; with them any range hashes in constant time."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def ranges(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges, equal for equal contents (and lengths) wherever they stand."""
    down = powers(len(pre))[1]
    return mix((pre[end] - pre[start]) * down[start] + (end - start).astype(U) * U(0xA0761D6478BD642F))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE) -> list[tuple[int, int]]:
    """Runs [a, b) of documents of at most so many bytes, or one longer document."""
    out, a, n = [], 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        out.append((a, b))
        a = b
    return out


#: The first bytes of a number, by how many there are.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def _named(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words, which have a byte at least: of their bytes where they have 16 at most, else of a hash of ranges."""
    size = end - start
    whole = np.zeros(len(raw) + 24, np.uint8)
    whole[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 16,), "<u8", whole, 0, (1,))  # the eight bytes from each place on, as one number
    a = eight[start] & _FIRST[np.minimum(size, 8)]
    long = np.flatnonzero(size > 16)
    if len(long):
        ends = np.cumsum(size[long])
        a[long] = ranges(prefix(_BYTE[raw[ragged(start[long], size[long])]]), ends - size[long], ends)
    a += size.astype(U) * U(0xA0761D6478BD642F)
    a = mix(a)
    out = follow(a, U(0))
    some = np.flatnonzero((size > 8) & (size <= 16))
    out[some] = follow(a[some], eight[start[some] + 8] & _FIRST[size[some] - 8])
    return out


def word_slices(raw: np.ndarray, off: np.ndarray, lower: bool = False, signs: bool = False, most: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each run of documents of at most so many bytes: its first document, then words' hashes, starts, ends and each document's first word, counted in the run."""
    kinds = _KINDS[signs].tobytes()
    for a, b in slices(off, most):
        part, own = raw[off[a] : off[b]], off[a : b + 1] - off[a]
        kind = np.frombuffer(part.tobytes().translate(kinds), np.uint8)
        edge = np.ones(len(part) + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
        edge[own] = True
        solid = kind > 0
        s, e = np.flatnonzero(edge[:-1] & solid), np.flatnonzero(edge[1:] & solid) + 1
        yield a, _named(_LOWER[part] if lower else part, s, e), s, e, np.searchsorted(s, own, "left")


def words(raw: np.ndarray, off: np.ndarray, lower: bool = False, signs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word, and each document's first word (one more at the end). signs: runs of signs are words of their own."""
    hashes, starts, ends, firsts, seen = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], 0
    for a, h, s, e, first in word_slices(raw, off, lower, signs):
        hashes.append(h)
        starts.append(s + off[a])
        ends.append(e + off[a])
        firsts.append(first[1:] + seen)
        seen += len(h)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends), np.concatenate(firsts)


def follow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a followed by b."""
    return mix(a * U(0x2545F4914F6CDD1D) + (b ^ U(0x9FB21C651E98DF25)))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n symbols from each position on; the last n - 1 positions are left off."""
    size, have, out, at, parts = len(h) - n + 1, h, None, 0, {1: h}
    if size <= 0:
        return np.zeros(0, U)
    step = 1
    while step * 2 <= n:
        have = follow(have[: len(have) - step], have[step:])
        step *= 2
        parts[step] = have
    for step in sorted(parts, reverse=True):
        if n & step:
            piece = parts[step][at : at + size]
            out = piece if out is None else follow(out, piece)
            at += step
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each width consecutive values."""
    size, have, step = len(values) - width + 1, values, 1
    if size <= 0:
        return values[:0]
    while step * 2 <= width:
        have = np.minimum(have[: len(have) - step], have[step:])
        step *= 2
    return np.minimum(have[:size], have[width - step : width - step + size])


def spread(first: np.ndarray, short: int) -> np.ndarray:
    """Positions i such that i .. i + short stay in one document; first: each document's first position, one more at the end."""
    return ragged(first[:-1], np.maximum(np.diff(first) - short, 0))


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... for count[i] numbers, for all i."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = start - (np.cumsum(count) - count)
    return np.arange(total, dtype=np.int64) + np.repeat(shift, count)


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _holder(width: int) -> int:
    """Bytes of the least whole number that has so many bytes."""
    return 1 << (width - 1).bit_length()


def squeeze(x: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers >= 0 in as many bytes as the largest takes, byte planes after each other, compressed; rising: as differences."""
    x = np.asarray(x)
    if rising and len(x):
        x = x.astype(U)  # a copy
        x[1:] = x[1:] - x[:-1]
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    size = _holder(width)
    return bytes([width]) + _SQUEEZE.compress(x.astype(f"<u{size}").view(np.uint8).reshape(-1, size)[:, :width].T.tobytes())


def loosen(data: bytes, rising: bool = False) -> np.ndarray:
    width = data[0]
    size = _holder(width)
    planes = np.frombuffer(_LOOSEN.decompress(data[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], size), np.uint8)
    out[:, :width] = planes.T
    x = out.reshape(-1).view(f"<u{size}")
    return np.cumsum(x, dtype=U) if rising else x.astype(U)


def gathered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which x rises, and where in it each value begins; equal ones in any order, which is much faster than np.unique with positions."""
    order = np.argsort(x)
    return order, changes(x[order])


def find(have: np.ndarray, x: np.ndarray) -> np.ndarray:
    """np.searchsorted, faster where x is long and in no order."""
    order, out = np.argsort(x), np.empty(len(x), np.int64)
    out[order] = np.searchsorted(have, x[order])
    return out


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns begin a new value."""
    new = np.ones(len(columns[0]), bool)
    np.not_equal(columns[0][1:], columns[0][:-1], out=new[1:])
    for c in columns[1:]:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


_SQUEEZE, _LOOSEN = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()
