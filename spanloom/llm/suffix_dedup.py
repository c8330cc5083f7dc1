"""Suffix-array dedup of byte strings: suffixes sorted by hash-compared mergesort.

A byte is removed if a string of `span` bytes that covers it also starts anywhere
else. All steps sample the same positions: those whose gram has the smallest hash
of some STRIDE neighbours, so every string of `span` bytes has one near its start,
chosen by its own content.

1. Where documents are read, two strings are hashed at each sampled position: the
   core, which any repeated string around it must hold, and the tile, which spans
   all strings that start before the next sampled position. Of equal ones in a
   block one goes on; the hash brings those of all blocks together.
2. Where all cores repeat that a string must hold, but not its tile, the string is hashed by
   itself and brought together the same way; so are strings of a repeated tile's first
   place, where more places share each core than the tile. That is only near the ends
   of passages.
3. So each shard of documents learns which other passages repeat its own, and has
   them sent. Of equal strings each asks for the one before it, in the order of row
   keys, so a passage that stands everywhere is sent on by all who have it.
4. In its shard, a document's suffixes at sampled positions, and those of the
   passages, are sorted by mergesort. Two suffixes compare by their common
   extension, found by binary search over prefix polynomial hashes. Neighbours in
   the order extend to the right by their order's common prefixes, and to the left
   by binary search again. The order and the matches are verified byte by byte; if
   one of them doesn't hold, the shard is sorted again under other hashes.

Hashes route by 64 bits, and step 4 decides. Since a block sends one row of equal
strings, no frequent passage gathers in one task; shards hold about SHARD_BYTES of
text each, or one row if that is longer. A shard's task needs some 40 bytes of memory
for each byte of the longest row's text.

Rows are told apart by a hash of their id and text, so places found in one row never
apply to a different text, and rows without an id are dealt over all shards. Rows
that are equal in both share a key, and so a shard.

Nulls: a null text is empty; a null id stays null. Repeated rows repeat each
other. An empty table gives no rows. Other columns are ignored by digests() and kept
by remove(), whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

SPAN, STRIDE = 400, 64
#: Bytes of a core at most.
CORE_BYTES = 192
BLOCK_BYTES = 6 << 20
#: Text bytes for each shard of documents, and for each part of the routed hashes.
SHARD_BYTES, PART_BYTES = 7 << 19, 14 << 20
#: How many neighbours in suffix order are looked at, before strings are looked up one by one.
NEIGHBOURS = 6
#: Places repeated so often that it isn't known how often.
MANY = np.iinfo(np.int64).max
#: Columns of this module's own: rows that share the key have the same id and text.
KEY, SHARD = "_suffix_dedup_key", "_suffix_dedup_shard"
CORE, TILE, ONE, REPEATS, ASKS, COUNTS = range(6)


def _slide(x: np.ndarray, better, width: int) -> np.ndarray:
    """Best of each `width` consecutive values."""
    step = 1
    while 2 * step <= width and len(x):
        x = better(x[:-step], x[step:]) if len(x) > step else x[:0]
        step *= 2
    more = width - step
    if not more:
        return x
    return better(x[:-more], x[more:]) if len(x) > more else x[:0]


def _lowest(hashes: K.RangeHash, at: np.ndarray, n: int) -> np.ndarray:
    """The sampled position with the smallest gram of the STRIDE positions from each on.

    It is sampled wherever that string stands, as are those from STRIDE - 1 on; others
    nearer to a string's start may be sampled because of what stands before it.
    """
    bits = K.U64(n.bit_length())
    key = np.full(n + STRIDE - 1, ~K.U64(0))
    key[at] = (hashes.gram[at] >> bits) << bits | at.astype(np.uint64)
    return np.minimum((_slide(key, np.minimum, STRIDE) & ((K.U64(1) << bits) - K.U64(1))).astype(np.int64), n - 1)


def core_size(span: int) -> int:
    return min(CORE_BYTES, span - STRIDE + 1)


def sampled(hashes: K.RangeHash, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions and their rows: grams that are the smallest of STRIDE neighbours in one text."""
    n = int(off[-1])
    if n < K.GRAM + STRIDE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = hashes.gram[: n + 1 - K.GRAM]
    low = _slide(gram, np.minimum, STRIDE)
    # windows that reach into the next text count for nothing
    outside = np.zeros(len(low) + 1, np.int64)
    ends = off[1:-1]
    np.add.at(outside, np.clip(ends - STRIDE - K.GRAM + 2, 0, len(low)), 1)
    np.add.at(outside, np.clip(ends, 0, len(low)), -1)
    low = np.where(np.cumsum(outside[:-1]) > 0, K.U64(0), low)
    pad = np.zeros(STRIDE - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), np.maximum, STRIDE) == gram)
    return at, np.searchsorted(off, at, side="right") - 1


def cores_of(hashes: K.RangeHash, off: np.ndarray, at: np.ndarray, row: np.ndarray, size: int):
    """(hash, row, place) of the cores of `size` bytes at sampled positions that have room for one."""
    fits = at + size <= off[1:][row]
    at, row = at[fits], row[fits]
    return K.mix(hashes.ranges(at, at + size) + K.U64(CORE)), row, at - off[row]


def cores_and_tiles(hashes: K.RangeHash, off: np.ndarray, span: int):
    """Cores, and (hash, row, place, starts) of tiles, in texts of at least `span` bytes."""
    at, row = sampled(hashes, off)
    end = off[1:]
    long = np.flatnonzero(np.diff(off) >= span)
    first, owner = np.unique(np.concatenate([at, off[long]]), return_index=True)
    owner = np.concatenate([row, long])[owner]
    after = np.append(first[1:], off[-1])
    last = np.minimum(np.minimum(after, end[owner]), end[owner] - span + 1)
    some = last > first
    a, z, owner = first[some], last[some], owner[some]
    tile = K.mix(hashes.ranges(a, z + span - 1) + (z - a).astype(np.uint64) * K.U64(8) + K.U64(TILE))
    return cores_of(hashes, off, at, row, core_size(span)), (tile, owner, a - off[owner], z - a)


class Suffixes:
    """Sorting of suffixes of a byte array, each up to the end of its own piece."""

    def __init__(self, data: np.ndarray, off: np.ndarray, most: int = SPAN, back: int = STRIDE - 1, seed: int = 0):
        self.data, self.off, self.most, self.back = data, off, most, back
        self.hashes = K.RangeHash(data, seed)

    def _extent(self, a, b, limit, forward: bool) -> np.ndarray:
        """Longest equal extension of positions a and b, up to `limit`, by binary search over hashes."""
        lo, hi = np.zeros(len(a), np.int64), limit.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_] + 1) >> 1
            x, y = a[open_], b[open_]
            same = self.hashes.alike(x, y, mid) if forward else self.hashes.alike(x - mid, y - mid, mid)
            lo[open_] = np.where(same, mid, lo[open_])
            hi[open_] = np.where(same, hi[open_], mid - 1)

    def right(self, a, b, room) -> np.ndarray:
        return self._extent(a, b, np.minimum(np.minimum(room[0], room[1]), self.most), True)

    def left(self, a, b, room) -> np.ndarray:
        return self._extent(a, b, np.minimum(np.minimum(room[0], room[1]), self.back), False)

    def _less(self, a, b, room_a, room_b, ties: np.ndarray) -> np.ndarray:
        """Whether suffix a stands before b; `ties` says so for equal ones."""
        same = self.right(a, b, (room_a, room_b))
        cap_a, cap_b = np.minimum(room_a, self.most), np.minimum(room_b, self.most)
        size = len(self.data)
        x = np.where(same < cap_a, self.data[np.minimum(a + same, size - 1)].astype(np.int64), -1)
        y = np.where(same < cap_b, self.data[np.minimum(b + same, size - 1)].astype(np.int64), -1)
        return np.where(x == y, ties, x < y)

    def mergesort(self, at: np.ndarray, room: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of suffixes within groups (runs of equal `group`): pairs of sorted runs merge, all at once.

        Every suffix finds its place in the partner run by binary search.
        """
        n = len(at)
        order = np.arange(n)
        lo_g, hi_g = K.runs(np.diff(group, prepend=-1) != 0) if n else (np.zeros(0, np.int64),) * 2
        start, stop = np.repeat(lo_g, hi_g - lo_g), np.repeat(hi_g, hi_g - lo_g)
        width, longest = 1, int((hi_g - lo_g).max(initial=0))
        while width < longest:
            place = np.arange(n)
            run = (place - start) // width
            other = start + (run ^ 1) * width
            live = np.flatnonzero(other < stop)
            lo, hi = other[live], np.minimum(other[live] + width, stop[live])
            floor, later = lo.copy(), (run[live] & 1).astype(bool)
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                m, own = order[mid], order[live[open_]]
                # equal suffixes keep their order: those of the left run go first
                before = self._less(at[m], at[own], room[m], room[own], later[open_])
                lo[open_] = np.where(before, mid + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], mid)
            target = place.copy()
            target[live] = start[live] + (run[live] >> 1) * 2 * width + (place[live] - start[live] - run[live] * width) + (lo - floor)
            new = np.empty(n, np.int64)
            new[target] = order
            order, width = new, width * 2
        return order

    def verify(self, a, b, length) -> None:
        if not self.hashes.same(a, b, length).all():
            raise K.Collision

    def repeats(self, at: np.ndarray, group: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [first, last] of starts of strings of `span` bytes that also start elsewhere.

        `at` are positions in ascending order of `group`; a group shares a core. Near
        neighbours in suffix order settle most: a pair that reaches as far as can be to
        both sides leaves nothing to find. What a few neighbours leave open, as where
        very many passages end at one place, is settled by single().
        """
        piece = np.searchsorted(self.off, at, side="right") - 1
        room, behind = self.off[piece + 1] - at, at - self.off[piece]
        order = self.mergesort(at, room, group)
        at, room, behind = at[order], room[order], behind[order]
        n = len(at)
        full_left, full_right = np.minimum(behind, self.back), np.minimum(room, self.most)
        open_ = np.ones(n, bool)
        lo, hi = K.runs(np.diff(group, prepend=-1) != 0) if n else (np.zeros(0, np.int64),) * 2
        large = np.repeat(hi - lo > NEIGHBOURS + 1, hi - lo)
        first, last = [], []
        i = np.flatnonzero(group[:-1] == group[1:]) if n else np.zeros(0, np.int64)
        near = np.zeros(n, np.int64)
        near[i] = self.right(at[i], at[i + 1], (room[i], room[i + 1]))
        self.verify(at[i], at[i + 1], near[i])  # so the order is the true one
        reach = near[i].copy()
        for step in range(1, NEIGHBOURS + 1):
            look = np.flatnonzero(open_[i] | open_[i + step])  # two that are settled have nothing to tell each other
            x, y, right = i[look], i[look] + step, reach[look]
            left = self.left(at[x], at[y], (behind[x], behind[y]))
            hit = np.flatnonzero(left + right >= span)
            x, y, left, right = x[hit], y[hit], left[hit], right[hit]
            self.verify(at[x] - left, at[y] - left, left)
            for k in (x, y):
                first.append(at[k] - left)
                last.append(at[k] + right - span)
                open_[k[(left >= full_left[k]) & (right >= full_right[k])]] = False
            go = i + step + 1 < n
            i, reach = i[go], reach[go]
            reach = np.minimum(reach, near[i + step])
            go = (group[i + step + 1] == group[i]) & (reach + self.back >= span) & (~large[i] | open_[i] | open_[i + step + 1])
            i, reach = i[go], reach[go]
            if not len(i):
                break
        # smaller groups have had all their pairs looked at, or ruled out
        if (large & open_).any():
            more = self.single(at, behind, room, group, large, open_ & large, span)
            first.append(more)
            last.append(more)
        z = np.zeros(0, np.int64)
        return (np.concatenate(first), np.concatenate(last)) if first else (z, z)

    def single(self, at, behind, room, group, large: np.ndarray, wanted: np.ndarray, span: int) -> np.ndarray:
        """Starts near wanted positions whose string also starts near another position of a group that has wanted ones."""
        has = np.unique(group[wanted])
        member = np.flatnonzero(large & (has[np.minimum(np.searchsorted(has, group), len(has) - 1)] == group))
        low = np.minimum(behind[member], self.back)
        high = np.minimum(room[member] - span, 0)  # the last start that the piece has room for, from the position
        some = high >= -low
        member, low, high = member[some], low[some], high[some]
        mask, ask = np.zeros(len(self.data) + 1, bool), np.zeros(len(self.data) + 1, bool)
        mask[K.spread(at[member] - low, low + high + 1)] = True
        own = wanted[member]
        ask[K.spread(at[member[own]] - low[own], (low + high + 1)[own])] = True
        x = np.flatnonzero(mask)
        h = self.hashes.ranges(x, x + span)
        order = np.argsort(h, kind="stable")
        x, h = x[order], h[order]
        new = np.ones(len(x), bool)
        new[1:] = h[1:] != h[:-1]
        alone = new & np.append(new[1:], True)
        first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(x) else x
        partner = np.where(new, np.minimum(np.arange(len(x)) + 1, len(x) - 1), first)
        found = np.flatnonzero(ask[x] & ~alone)
        self.verify(x[found], x[partner[found]], np.full(len(found), span))
        return x[found]


_ROUTED = "part long, kind int, blob binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["part", "kind", "blob"])


def _split_by(part: np.ndarray, parts: int):
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    return ((p, order[bounds[p] : bounds[p + 1]]) for p in range(parts) if bounds[p] < bounds[p + 1])


class Found:
    """Equal strings' consequences: places that repeat, and passages to be sent to those who repeat them."""

    def __init__(self, shards: int, span: int):
        self.shards, self.span, self.repeats, self.asks, self.counts = shards, span, [], [], []

    def tell(self, kind: int, doc, place, size, count, first) -> None:
        """Rows that repeat: in how many places (0 if not known), and whether this is the first."""
        self.repeats.append((doc, place.astype(np.int64), size.astype(np.int64) * (kind == TILE), count.astype(np.int64), first))

    def ask(self, kind: int, doc: np.ndarray, place: np.ndarray, size: np.ndarray, partner: np.ndarray) -> None:
        """Rows, and the index of a row that each repeats."""
        doc, place, size = doc.astype(np.int64), place.astype(np.int64), size.astype(np.int64)
        if kind != CORE:
            target = K.shard_of(doc, self.shards)
            away = K.shard_of(doc[partner], self.shards) != target
            self.asks.append((doc[partner][away], place[partner][away], size[partner][away] + self.span - 1, target[away]))

    def rows(self, parts: int) -> list[tuple]:
        """As blobs by the shard that they go to, modulo `parts`."""
        out = []
        if self.repeats:
            d, p, s, c, f = (np.concatenate(x) for x in zip(*self.repeats, strict=True))
            for part, own in _split_by(K.shard_of(d, self.shards) % parts, parts):
                out.append((part, REPEATS, K.squeeze(d[own], p[own].astype(np.uint32), s[own].astype(np.uint8), c[own].astype(np.uint32), f[own].astype(np.uint8))))
        if self.asks:
            d, p, n, t = (np.concatenate(c) for c in zip(*self.asks, strict=True))
            order = np.lexsort((p, d, t))
            d, p, n, t = d[order], p[order], n[order], t[order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1]) | (t[1:] != t[:-1]) | (n[1:] != n[:-1])
            d, p, n, t = d[new], p[new], n[new], t[new]
            for part, own in _split_by(K.shard_of(d, self.shards) % parts, parts):
                out.append((part, ASKS, K.squeeze(d[own], p[own].astype(np.uint32), n[own].astype(np.uint16), t[own].astype(np.uint32))))
        if self.counts:
            d, n = (np.concatenate(c) for c in zip(*self.counts, strict=True))
            for part, own in _split_by(K.shard_of(d, self.shards) % parts, parts):
                out.append((part, COUNTS, K.squeeze(d[own], n[own])))
        return out

    def take(self, kind: int, blob: bytes) -> None:
        """Blobs of an earlier step, to be passed on."""
        if kind == REPEATS:
            d, p, s, c, f = K.unsqueeze(blob, np.int64, np.uint32, np.uint8, np.uint32, np.uint8)
            self.repeats.append((d, p.astype(np.int64), s.astype(np.int64), c.astype(np.int64), f.astype(bool)))
        elif kind == COUNTS:
            self.counts.append(K.unsqueeze(blob, np.int64, np.int64))
        else:
            d, p, n, t = K.unsqueeze(blob, np.int64, np.uint32, np.uint16, np.uint32)
            self.asks.append((d, p.astype(np.int64), n.astype(np.int64), t.astype(np.int64)))


def _groups(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From hashes: an order by hash, and by document where hashes are equal; first of each group in it; which are in groups of several.

    The document decides who is next to whom, so that passages which follow each other
    have the same neighbours, wherever their hashes went.
    """
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    several = ~(new & np.append(new[1:], True)) if len(h) else new
    own = order[several]
    order[several] = own[np.lexsort((doc[own], h[own]))]
    return order, np.flatnonzero(new), np.flatnonzero(several)


def _partners(one: np.ndarray, again: np.ndarray) -> np.ndarray:
    """For each of the places `again` of groups of several, its neighbour's index among them: the one before it, or after the first."""
    k = np.arange(len(again))
    return np.where(np.isin(again, one, assume_unique=True), k + 1, k - 1)


def _ship(found: Found, kind: int, h, doc, place, size, parts: int) -> list[tuple]:
    """Resolve equal hashes of a block among themselves, and send on one of each, with its count."""
    order, one, again = _groups(h, doc)
    h, doc, place, size = h[order], doc[order], place[order], size[order]
    if len(again):
        if kind != ONE:
            none = np.zeros(len(again), np.int64)
            found.tell(kind, doc[again], place[again], size[again], none, none.astype(bool))
        found.ask(kind, doc[again], place[again], size[again], _partners(one, again))
    count = np.diff(np.append(one, len(h)))
    h, doc, place, size = h[one], doc[one], place[one], size[one]
    out = []
    for p, own in _split_by((h >> K.U64(40)) % K.U64(parts), parts):
        table, index = np.unique(doc[own], return_inverse=True)
        head = K.squeeze(table)
        body = K.squeeze(np.diff(h[own], prepend=K.U64(0)), index.astype(np.uint32), place[own].astype(np.uint32), size[own].astype(np.uint8), count[own].astype(np.uint32))
        out.append((p, kind, len(head).to_bytes(4, "little") + head + body))
    return out


def _reads(shards: int, parts: int, span: int):
    def block(held: list[tuple]) -> pa.RecordBatch:
        found = Found(shards, span)
        out = []
        for kind, own in ((CORE, [h[0] for h in held]), (TILE, [h[1] for h in held])):
            h, doc, place, size = (np.concatenate(c) for c in zip(*own, strict=True))
            out += _ship(found, kind, h, doc, place, size, parts)
        return _rows(out + found.rows(parts))

    def run(batches):
        held, total = [], 0
        for b in K.slices(batches, 1 << 20):
            data, off = K.text_bytes(b.column(1))
            ids = np.asarray(b.column(0))
            (h, row, place), (h2, row2, place2, size2) = cores_and_tiles(K.RangeHash(data), off, span)
            held.append(((h, ids[row], place, np.ones(len(h), np.int64)), (h2, ids[row2], place2, size2)))
            total += len(data)
            if total >= BLOCK_BYTES:
                yield block(held)
                held, total = [], 0
        if held:
            yield block(held)

    return run


def _pairs(shards: int, span: int):
    """Equal strings of all blocks. Gives repeats and asks by shard."""

    def run(batches):
        found, rows = Found(shards, span), {CORE: [], TILE: [], ONE: []}
        for b in batches:
            for kind, blob in zip(b.column("kind").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if kind in (REPEATS, ASKS, COUNTS):
                    found.take(kind, blob)
                    continue
                n = int.from_bytes(blob[:4], "little")
                ids = K.unsqueeze(blob[4 : 4 + n], np.int64)[0]
                d, i, p, s, c = K.unsqueeze(blob[4 + n :], np.uint64, np.uint32, np.uint32, np.uint8, np.uint32)
                rows[kind].append((np.cumsum(d, dtype=np.uint64), ids[i], p, s, c))
        for kind, own in rows.items():
            if own:
                h, doc, place, size, count = (np.concatenate(c) for c in zip(*own, strict=True))
                order, one, again = _groups(h, doc)
                doc, place, size = doc[order], place[order], size[order]
                found.ask(kind, doc[again], place[again], size[again], _partners(one, again))
                if kind != ONE:
                    total = np.add.reduceat(count[order].astype(np.int64), one)
                    total = np.repeat(total, np.diff(np.append(one, len(h))))
                    first = np.zeros(len(h), bool)
                    first[one] = True
                    many = total > 1
                    found.tell(kind, doc[many], place[many], size[many], total[many], first[many])
        if out := found.rows(shards):
            yield _rows(out)

    return run


def _column(b, name: str):
    return b.column(b.schema.get_field_index(name))


def _singles(shards: int, parts: int, span: int):
    """Strings whose cores repeat but whose tile doesn't; asks of before are passed on. And how many bytes repeated cores cover."""
    size_of_core = core_size(span)
    reach = span - size_of_core + 1  # a string's cores start before this

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        found, seen, out = Found(shards, span), Found(shards, span), []
        for kind, blob in zip(told["kind"].to_pylist(), told["blob"].to_pylist(), strict=True):
            (seen if kind == REPEATS else found).take(kind, blob)
        if seen.repeats and docs.num_rows:
            d, p, s, c, f = (np.concatenate(x) for x in zip(*seen.repeats, strict=True))
            order = np.argsort(d, kind="stable")
            d, p, s, c, f = d[order], p[order], s[order], c[order], f[order]
            held = []
            for b in K.slices(docs.to_batches(), 1 << 20):
                ids = np.asarray(_column(b, KEY))
                lo, hi = np.searchsorted(d, ids, side="left"), np.searchsorted(d, ids, side="right")
                some = np.flatnonzero(hi > lo)
                if not len(some):
                    continue
                data, off = K.text_bytes(_column(b, "text").take(pa.array(some)))
                ids, lo, hi, some = ids[some], lo[some], hi[some], np.arange(len(some))
                told_at, told_row = K.spread(lo[some], (hi - lo)[some]), np.repeat(some, (hi - lo)[some])
                place, size, count, lead = off[told_row] + p[told_at], s[told_at], c[told_at], f[told_at]
                hashes, n = K.RangeHash(data), len(data)
                core = size == 0
                covered = K.covered(n, place[core], place[core] + size_of_core)
                total = np.bincount(np.repeat(np.arange(len(ids)), np.diff(off)), covered, len(ids)).astype(np.int64)
                _, first = np.unique(ids, return_index=True)
                first = first[total[first] > 0]
                found.counts.append((ids[first], total[first]))
                # in how many places each sampled position's core stands; positions between don't matter
                shared = np.full(n + reach + STRIDE, MANY)
                at, row = sampled(hashes, off)
                shared[at[at + size_of_core <= off[1:][row]]] = 1
                known = core & (count > 0)
                shared[place[core]] = MANY  # repeated in a number of places that isn't known here
                shared[place[known]] = count[known]
                least = np.minimum(shared[_lowest(hashes, at, n)], _slide(shared, np.minimum, reach - STRIDE + 1)[STRIDE - 1 :][:n])
                maybe = least > 1
                begin = np.flatnonzero(np.diff(off) < span)  # texts, and ends of texts, too short for a string
                maybe[K.spread(off[begin], np.diff(off)[begin])] = False
                long = np.flatnonzero(np.diff(off) >= span)
                maybe[K.spread(off[1:][long] - span + 1, np.full(len(long), span - 1))] = False
                maybe &= np.repeat(np.isin(np.arange(len(ids)), told_row[core]), np.diff(off))
                tile = ~core
                maybe &= ~K.covered(n, place[tile], place[tile] + size[tile])
                tile &= lead
                y = K.spread(place[tile], size[tile])
                maybe[y[least[y] > np.repeat(count[tile], size[tile])]] = True
                x = np.flatnonzero(maybe)
                r = np.searchsorted(off, x, side="right") - 1
                held.append((K.mix(hashes.ranges(x, x + span) + K.U64(ONE)), ids[r], x - off[r], np.ones(len(x), np.int64)))
            if held:
                h, doc, place, size = (np.concatenate(c) for c in zip(*held, strict=True))
                out = _ship(found, ONE, h, doc, place, size, parts)
        return pa.Table.from_batches([_rows(out + found.rows(parts))])

    return run


def _sends(docs: pa.Table, wanted: pa.Table) -> pa.Table:
    """Passages of a shard's documents for the shards that asked: one row each."""
    out: list[tuple] = []
    if docs.num_rows:
        shard = docs[SHARD][0].as_py()
        out += [(shard, COUNTS, x) for x in wanted.filter(pa.compute.equal(wanted["kind"], COUNTS))["blob"].to_pylist()]
    wanted = wanted.filter(pa.compute.equal(wanted["kind"], ASKS))
    if wanted.num_rows and docs.num_rows:
        d, p, n, t = (np.concatenate(c).astype(np.int64) for c in zip(*(K.unsqueeze(x, np.int64, np.uint32, np.uint16, np.uint32) for x in wanted["blob"].to_pylist()), strict=True))
        order = np.lexsort((p, d, t))
        d, p, n, t = d[order], p[order], n[order], t[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
        # passages that overlap are sent as one; a later one never ends much before an earlier one
        end = p + n
        lo, hi = K.runs(new)
        for a, z in zip(lo.tolist(), hi.tolist(), strict=True):
            end[a:z] = np.maximum.accumulate(end[a:z])
        new[1:] |= p[1:] > end[:-1]
        lo, hi = K.runs(new)
        d, p, end, t = d[lo], p[lo], end[hi - 1], t[lo]
        order = np.argsort(d, kind="stable")
        d, p, end, t = d[order], p[order], end[order], t[order]
        parts: dict[int, list] = {}
        for b in K.slices(docs.to_batches(), 1 << 20):
            data, off = K.text_bytes(_column(b, "text"))
            raw, ids = data.tobytes(), np.asarray(_column(b, KEY))
            lo, hi = np.searchsorted(d, ids, side="left"), np.searchsorted(d, ids, side="right")
            for k in np.flatnonzero(hi > lo).tolist():
                for r in range(lo[k], hi[k]):
                    parts.setdefault(int(t[r]), []).append(raw[off[k] + p[r] : min(off[k] + end[r], off[k + 1])])
        for target, own in parts.items():
            head = K.squeeze(np.array([len(x) for x in own], np.uint32))
            out.append((target, ASKS, len(head).to_bytes(4, "little") + head + K.squeeze_bytes(b"".join(own))))
    return pa.Table.from_batches([_rows(out)])


def repeated_starts(texts: list[tuple[np.ndarray, np.ndarray]], passages: list[tuple[np.ndarray, np.ndarray]], span: int = SPAN) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each (bytes, offsets) of `texts`, ranges of starts of strings that also start elsewhere in it, in others or in the passages."""
    cores = []
    for data, off in [*texts, *passages]:
        hashes = K.RangeHash(data)
        h, row, place = cores_of(hashes, off, *sampled(hashes, off), span - STRIDE + 1)
        cores.append((h, row, place + off[row]))
    every = np.sort(np.concatenate([c[0] for c in cores])) if cores else np.zeros(0, np.uint64)
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    # only what lies around repeated cores goes into the sorted text
    pieces, sizes, at, key, homes, total = [], [], [], [], [], 0
    for k, ((data, off), (h, row, place)) in enumerate(zip([*texts, *passages], cores, strict=True)):
        slot = np.minimum(np.searchsorted(twice, h), max(0, len(twice) - 1))
        good = twice[slot] == h if len(twice) else np.zeros(len(h), bool)
        row, place, slot = row[good], place[good], slot[good]
        lo, hi = np.maximum(place - STRIDE + 1, off[row]), np.minimum(place + span, off[row + 1])
        new = np.ones(len(lo), bool)
        new[1:] = (lo[1:] > np.maximum.accumulate(hi)[:-1]) | (row[1:] != row[:-1])
        a, z = K.runs(new)
        lo, hi = lo[a], np.maximum.reduceat(hi, a) if len(a) else hi[:0]
        size = hi - lo
        base = total + np.cumsum(size) - size
        owner = np.repeat(np.arange(len(a)), z - a)
        pieces.append(data[K.spread(lo, size)])
        sizes.append(size)
        at.append(place - lo[owner] + base[owner])
        key.append(slot)
        homes.append((np.full(len(size), k), lo - base))
        total += int(size.sum())
    if not total:
        return [(np.zeros(0, np.int64),) * 2 for _ in texts]
    size, data = np.concatenate(sizes), np.concatenate(pieces)
    off = np.concatenate([[0], np.cumsum(size)])
    at, key = np.concatenate(at), np.concatenate(key)
    order, seed = np.lexsort((at, key)), 0
    while True:
        try:
            first, last = Suffixes(data, off, span, seed=seed).repeats(at[order], key[order], span)
            break
        except K.Collision:
            seed += 1
    home, shift = (np.concatenate(c) for c in zip(*homes, strict=True))
    piece = np.searchsorted(off, first, side="right") - 1
    return [(first[own] + shift[piece[own]], last[own] + shift[piece[own]]) for own in (np.flatnonzero(home[piece] == k) for k in range(len(texts)))]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long"


def _digest(b, data: np.ndarray, off: np.ndarray, gone: np.ndarray, passages: np.ndarray) -> pa.RecordBatch:
    n = b.num_rows
    row = np.repeat(np.arange(n), np.diff(off))
    begins = gone.copy()
    begins[1:] &= ~gone[:-1] | (row[1:] != row[:-1])
    kept = data[~gone]
    cut = np.concatenate([[0], np.cumsum(np.bincount(row[~gone], minlength=n))]).tolist()
    digest = [hashlib.sha256(kept[a:z]).hexdigest() for a, z in zip(cut[:-1], cut[1:], strict=True)]
    cols = [np.diff(off), np.bincount(row, gone, n).astype(np.int64), np.bincount(row, begins, n).astype(np.int64)]
    return pa.RecordBatch.from_arrays([_column(b, "doc_id"), *map(pa.array, cols), pa.array(digest, pa.string()), pa.array(passages)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"])


def _kept_text(b, data: np.ndarray, off: np.ndarray, gone: np.ndarray, _passages: np.ndarray) -> pa.RecordBatch:
    """All columns, with what is left of each text; a character that lost some of its bytes goes whole."""
    lead = (data & 0xC0) != 0x80
    char = np.cumsum(lead) - 1
    broken = np.zeros(int(lead.sum()), bool)
    broken[char[gone]] = True
    left = ~broken[char] if len(data) else gone
    row = np.repeat(np.arange(b.num_rows), np.diff(off))
    cut = np.concatenate([[0], np.cumsum(np.bincount(row[left], minlength=b.num_rows))]).tolist()
    kept = data[left].tobytes()
    text = pa.array([kept[a:z].decode() for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.string())
    return pa.RecordBatch.from_arrays([text if f.name == "text" else c for f, c in zip(b.schema, b.columns, strict=True)], schema=pa.schema([pa.field("text", pa.string()) if f.name == "text" else f for f in b.schema]))


def _removes(finish, span: int):
    def run(docs: pa.Table, sent: pa.Table) -> pa.Table:
        passages, lengths, texts, size, counts = [], [], [], 0, {}
        for kind, blob in zip(sent["kind"].to_pylist(), sent["blob"].to_pylist(), strict=True):
            if kind == COUNTS:
                counts |= dict(zip(*(x.tolist() for x in K.unsqueeze(blob, np.int64, np.int64)), strict=True))
                continue
            n = int.from_bytes(blob[:4], "little")
            lengths.append(K.unsqueeze(blob[4 : 4 + n], np.uint32)[0].astype(np.int64))
            texts.append(K.unsqueeze_bytes(blob[4 + n :]))
            size += len(texts[-1])
            if size > 1 << 20:
                passages.append(_joined(texts, lengths))
                lengths, texts, size = [], [], 0
        if texts:
            passages.append(_joined(texts, lengths))
        own = list(K.slices(docs.to_batches(), 1 << 20))
        told = [np.array([counts.get(x, 0) for x in _column(b, KEY).to_pylist()], np.int64) for b in own]
        # a row without a repeated core has no repeated string
        parts = [K.text_bytes(_column(b, "text").take(pa.array(np.flatnonzero(n)))) for b, n in zip(own, told, strict=True)]
        out = []
        for b, n, (part, _), (first, last) in zip(own, told, parts, repeated_starts(parts, passages, span), strict=True):
            data, off = K.text_bytes(_column(b, "text"))
            gone, some = np.zeros(len(data), bool), np.flatnonzero(n)
            gone[K.spread(off[some], np.diff(off)[some])] = K.covered(len(part), first, last + span)
            out.append(finish(b.drop_columns([SHARD, KEY]), data, off, gone, n))
        if not out:
            bare = docs.drop([SHARD, KEY]).schema
            out = [finish(pa.RecordBatch.from_pylist([], schema=bare), np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))]
        return pa.Table.from_batches(out)

    return run


def _joined(texts: list[bytes], lengths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64)


def keyed(documents: DataFrame, shards: int) -> DataFrame:
    """The documents with their row keys and shards."""
    return documents.withColumn(KEY, F.xxhash64("doc_id", "text")).withColumn(SHARD, K.shard_column(KEY, shards))


def dedup(documents: DataFrame, span: int = SPAN, finish=_digest, schema=RESULT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes for every row of `documents`.

    `documents` needs doc_id and text (string); further columns reach `finish`, which
    makes the result's columns from a batch, its mask of removed bytes, and n_passage_bytes: the bytes in repeated cores, that is in strings of core_size(span)
    bytes, at positions sampled by content, that also stand elsewhere, by hash. Each
    passage of core_size(span) + STRIDE - 1 bytes that repeats has at least one.
    """
    # a count, and the fewest shards, as K.shard_count would give for both
    shards = K.shard_count(documents, SHARD_BYTES)
    parts = max(64, -(-shards * SHARD_BYTES // PART_BYTES))
    own = keyed(documents, shards)
    routed = own.select(KEY, "text").mapInArrow(_reads(shards, parts, span), _ROUTED).repartition(parts, "part").mapInArrow(_pairs(shards, span), _ROUTED)
    text = own.groupBy(SHARD)
    by_shard = lambda df: df.groupBy(F.col("part").alias(SHARD))
    singles = text.cogroup(by_shard(routed)).applyInArrow(_singles(shards, parts, span), _ROUTED).repartition(parts, "part").mapInArrow(_pairs(shards, span), _ROUTED)
    sent = text.cogroup(by_shard(singles)).applyInArrow(_sends, _ROUTED)
    return text.cogroup(by_shard(sent)).applyInArrow(_removes(finish, span), schema)


def digests(documents: DataFrame, span: int = SPAN) -> DataFrame:
    docs = K.with_columns(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return dedup(docs, span)


def remove(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """The documents with their repeated bytes removed, in the same columns."""
    plain = documents.toDF(*(c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(documents.columns)))
    return dedup(plain, span, _kept_text, plain.schema).toDF(*documents.columns)
