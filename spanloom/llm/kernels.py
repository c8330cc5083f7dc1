"""Vectorised byte and word kernels that several operators share.

Texts are handled as one UTF-8 byte array with offsets, so that hashes of
words, word windows and byte ranges come from whole-array arithmetic.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and offsets (one more than rows). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    n = len(column)
    if n == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batches, most: int = 4 << 20, least_rows: int = 1, column: int | None = None):
    """Cut record batches so that each part has about `most` bytes of text, or of another column (a row is never cut)."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = text_bytes(b.column(b.schema.get_field_index("text") if column is None else column))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + least_rows, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
            hi = min(hi, b.num_rows)
            yield b.slice(lo, hi - lo)
            lo = hi


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, U64(base), dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@lru_cache(maxsize=2)
def _powers_upto(log: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(_BASE, 1 << log), powers(_BASE_INV, 1 << log)


#: Bytes that a gram of RangeHash has; no shorter range has a hash.
GRAM = 16


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on (zeros after the end) as one number, by position up to len(data) + 8."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))


def _lowest(count: np.ndarray) -> np.ndarray:
    """Masks of the lowest `count` bytes of a number, 0 to 8."""
    return np.where(count >= 8, ~U64(0), (U64(1) << (np.minimum(count, 7).astype(np.uint64) * U64(8))) - U64(1))


def same_ranges(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether `length` bytes are equal from a in one and from b in another array, both given by eights()."""
    out = np.ones(len(a), bool)
    live, k = np.flatnonzero(length > 0), 0
    while len(live):
        rest = length[live] - k
        differ = x[a[live] + k] ^ y[b[live] + k]
        if (rest < 8).any():
            differ &= _lowest(rest)
        equal = differ == 0
        out[live[~equal]] = False
        k += 8
        live = live[equal & (rest > 8)]
    return out


class RangeHash:
    """Hashes of byte ranges of an array, each in constant time.

    Each gram of GRAM bytes is mixed to a number, and a range's hash is the polynomial
    modulo 2**64 of its grams' numbers. Sums over single letters would lose most of their
    bits on doubling patterns (Thue-Morse words); over grams, ranges of some hundred bytes
    keep 30 at least, so equal hashes are to be verified where they decide. Another seed
    gives other numbers.
    """

    def __init__(self, data: np.ndarray, seed: int = 0):
        n = len(data)
        up, self.inv = _powers_upto(max(12, n.bit_length()))
        self.eights = np.ascontiguousarray(eights(data))
        gram = self.eights[:n] * _ODD
        gram ^= gram >> U64(32)
        gram += self.eights[8 : n + 8] if n else gram
        gram ^= U64(seed * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)
        self.gram = mix(gram)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.gram * up[:n], out=self.sums[1:], dtype=np.uint64)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal ranges, of GRAM bytes at least, of any two arrays have equal values."""
        return (self.sums[end - (GRAM - 1)] - self.sums[start]) * self.inv[start]

    def alike(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ranges of this array are equal: by hashes, or by bytes if they are shorter than a gram."""
        out = self.ranges(a, a + length) == self.ranges(b, b + length)
        near = np.flatnonzero(length < GRAM)
        if len(near):
            out[near] = same_ranges(self.eights, a[near], self.eights, b[near], length[near])
        return out

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ranges of this array are equal, byte by byte."""
        return same_ranges(self.eights, a, self.eights, b, length)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that aren't ASCII white space."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cut = np.zeros(n + 1, dtype=bool)
    cut[off] = True
    first |= solid & cut[:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last |= solid & cut[1:]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, side="right") - 1


#: Words of more bytes are hashed by all their parts at once, shorter ones by one part after the other.
LONG_WORD = 64


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each word: parts of eight bytes are mixed with what is before them, or with their place, so no pattern of letters cancels out."""
    size, source = end - start, eights(data)
    h = mix(size.astype(np.uint64) * _ODD + U64(seed))
    live, k = np.flatnonzero(size <= LONG_WORD), 0
    while len(live):
        rest = size[live] - k
        h[live] = mix(h[live] ^ (source[start[live] + k] & _lowest(rest))) * _ODD + U64(k + 1)
        k += 8
        live = live[rest > 8]
    long = np.flatnonzero(size > LONG_WORD)
    if len(long):
        parts = (size[long] + 7) // 8
        at = 8 * spread(np.zeros(len(long), np.int64), parts)
        value = source[np.repeat(start[long], parts) + at] & _lowest(np.repeat(size[long], parts) - at)
        mixed = mix(value ^ mix(at.astype(np.uint64) * _ODD + U64(seed + 1)))
        h[long] = mix(h[long] + np.add.reduceat(mixed, np.cumsum(parts) - parts))
    return h


class Collision(Exception):
    """Two different strings had equal hashes."""


class Vocabulary:
    """The distinct words of a text, found by hash and told apart by their bytes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0):
        self.seed, self.source = seed, eights(data)
        self.words = word_hashes(data, start, end, seed)
        self.hashes, first, self.codes = np.unique(self.words, return_index=True, return_inverse=True)
        self.start, self.length = start[first], (end - start)[first]
        if not self._same(self.source, start, end - start, self.codes).all():
            raise Collision

    def _same(self, source: np.ndarray, start: np.ndarray, length: np.ndarray, code: np.ndarray) -> np.ndarray:
        return (length == self.length[code]) & same_ranges(source, start, self.source, self.start[code], np.minimum(length, self.length[code]))

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Codes of another text's words, given their hashes; -1 for a word that this text hasn't."""
        if not len(self.hashes):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        some = np.flatnonzero(self.hashes[at] == words)
        some = some[self._same(eights(data), start[some], (end - start)[some], at[some])]
        out = np.full(len(words), -1)
        out[some] = at[some]
        return out


def gram_hashes(word: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` consecutive words, by their start."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        h = h * U64(_BASE) + word[j : j + n]
    return mix(h)


def whole_grams(row: np.ndarray, size: int) -> np.ndarray:
    """Which runs of `size` words lie in one row."""
    n = len(row) - size + 1
    return row[:n] == row[size - 1 :] if n > 0 else np.zeros(0, bool)


_pack, _unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(*columns: np.ndarray) -> bytes:
    """Arrays of equal length as compressed byte planes."""
    parts = []
    for c in columns:
        c = np.ascontiguousarray(c)
        parts.append(c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes())
    return _pack.compress(b"".join(parts))


def unsqueeze(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = np.frombuffer(_unpack.decompress(blob), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for k, s in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * s].reshape(s, n).T).view(k).reshape(n))
        at += n * s
    return out


def squeeze_bytes(data: bytes) -> bytes:
    return _pack.compress(data)


def unsqueeze_bytes(blob: bytes) -> bytes:
    return _unpack.decompress(blob)


def runs(starts_of_new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the groups of an array, from a mask of where a new group starts."""
    lo = np.flatnonzero(starts_of_new)
    return lo, np.append(lo[1:], len(starts_of_new))


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for `length[0]` values, then the next range."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) - np.repeat(first, length) + np.repeat(start, length)


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mask of the positions that half-open ranges cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:n]) > 0


def shard_count(df: DataFrame, shard_bytes: int, least: int = 64) -> int:
    """Shards that hold `shard_bytes` of text each, as counted: files may be compressed to any share of it."""
    size = df.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(least, -(-size // shard_bytes))


def xxhash64(ids: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of whole numbers (the algorithm's fixed primes, and Spark's seed, 42)."""
    p1, p2, p3, p4, p5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << U64(n)) | (x >> U64(64 - n))
    h = turn((U64(50) + p5) ^ (turn(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
    h = (h ^ (h >> U64(33))) * p2
    h = (h ^ (h >> U64(29))) * p3
    return (h ^ (h >> U64(32))).view(np.int64)


def shard_of(ids: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each document; shard_column() gives the same."""
    return np.mod(xxhash64(ids), shards).astype(np.int64)


def shard_column(name: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(shards).cast("long"))


def with_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; a column that is missing is null."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{n}`") if n in have else F.lit(None).cast("string").alias(n) for n in names])
