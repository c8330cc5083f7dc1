"""Substring dedup of word windows by compressed FM-indexes, one per shard.

A word is removed if a window of WINDOW words that covers it also starts in a
document with a smaller id.

1. Windows are hashed where documents are read. Of equal windows in one block only
   the first document's goes on; the hash brings the windows of all blocks together,
   and names for each document the one before it, by id, that holds the window. This
   only routes: it says which passages a shard of documents has to be searched for.
   A passage that stands everywhere is so sent on by all who have it, not by the first.
2. The named documents' shards send those passages to the shards that asked.
3. Each shard builds an FM-index (a suffix array's BWT in a wavelet matrix) of the
   passages, and streams its documents through it: backward search over lanes of
   consecutive windows computes matching statistics, and a window counts where the
   interval holds a smaller document's id. Symbols stand for words: words with equal
   hashes are compared byte by byte, and hashed anew if two differ.

The block step leaves one row of a window for each block, so no frequent passage
gathers in one task, and passages go once to each shard. Shards hold about SHARD_BYTES
of text each, or one row if that is longer; a task needs some 60 bytes of memory for
each byte of the longest row's text.

Nulls: a null text has no words; a null id counts as larger than any, and so does an
id from NULL_IDS on. Rows without an id are dealt over all shards by their text; rows
with the same id share a shard and aren't each other's source. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

WINDOW = 13
BLOCK_BYTES = 6 << 20
#: Text bytes for each shard of documents, and of windows.
SHARD_BYTES = 7 << 20
LANE = 32
NO_ID = np.iinfo(np.int64).max
#: Rows without an id are numbered from here on; they have no order.
NULL_IDS = int(NO_ID) - (1 << 40)
ID = "_fm_id"


class RankBits:
    """A bitmap with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)
        self.zeros = n - int(ones.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        at = i >> 6
        mask = (K.U64(1) << (i & 63).astype(np.uint64)) - K.U64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        for b in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bits = ((symbols >> b) & 1).astype(np.uint8)
            self.levels.append((b, RankBits(bits)))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank_pair(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before lo, and before hi."""
        n = len(symbol)
        start, ends = np.zeros(n, np.int64), np.concatenate([lo, hi])
        for b, bits in self.levels:
            ranked = bits.rank(np.concatenate([start, ends]))
            one = ((symbol >> b) & 1).astype(bool)
            one3 = np.concatenate([one, one, one])
            moved = np.where(one3, bits.zeros + ranked, np.concatenate([start, ends]) - ranked)
            start, ends = moved[:n], moved[n:]
        return ends[:n] - start, ends[n:] - start


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by at least their first `depth` symbols, by prefix doubling."""
    n, k = len(symbols), 1
    rank = symbols.astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:] + 1 if k < n else after[:0]
        key = rank * (int(rank.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.zeros(n, np.int64)
        new[1:] = ranked[1:] != ranked[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        k *= 2
        if k >= depth or (n and rank[order[-1]] == n - 1):
            return order


class PassageIndex:
    """An FM-index of passages (codes of words, from 0 on), with the document of each. Searches take codes plus 2; 0 is no word."""

    def __init__(self, codes: np.ndarray, length: np.ndarray, source: np.ndarray):
        # 1 ends each passage, 0 ends the whole text
        text = np.ones(len(codes) + len(length) + 1, np.int64)
        text[K.spread(np.cumsum(length + 1) - length - 1, length)] = codes + 2
        text[-1] = 0
        self.size = int(text.max()) + 1
        order = suffix_order(text, WINDOW + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.size))])
        self.bwt = WaveletMatrix(text[order - 1], self.size)
        owner = np.append(np.repeat(source, length + 1), NO_ID)
        self.owner = np.append(owner[order], NO_ID)
        self.n = len(text)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.bwt.rank_pair(symbol, lo, hi)
        base = self.first[symbol]
        return base + a, base + b

    def least_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest document id in each interval; none in an empty one."""
        out = np.full(len(lo), NO_ID)
        some = np.flatnonzero(hi > lo)
        if len(some):
            pair, back = np.unique(lo[some] * (self.n + 1) + hi[some], return_inverse=True)
            bounds = np.stack([pair // (self.n + 1), pair % (self.n + 1)], 1).ravel()
            out[some] = np.minimum.reduceat(self.owner, bounds)[::2][back]
        return out

    def search(self, symbols: np.ndarray, start: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of symbols[start : start + size]; the intervals."""
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), self.n)
        live = np.arange(len(start))
        for j in range(size - 1, -1, -1):
            lo[live], hi[live] = self.step(symbols[start[live] + j], lo[live], hi[live])
            live = live[hi[live] > lo[live]]
            if not len(live):
                break
        return lo, hi

    def earlier(self, symbols: np.ndarray, start: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which windows, given by ascending starts, a smaller document has.

        Consecutive windows of a document form lanes. A lane is searched backward as
        one pattern: while the match from the lane's end holds and has a smaller
        owner, each window on the way counts. The rest is searched window by window.
        """
        n = len(start)
        out = np.zeros(n, bool)
        if not n:
            return out
        new = np.ones(n, bool)
        new[1:] = (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1])
        lo_run, hi_run = K.runs(new)
        pieces = -(-(hi_run - lo_run) // LANE)
        lane_first = np.repeat(lo_run, pieces) + LANE * K.spread(np.zeros(len(pieces), np.int64), pieces)
        lane_last = np.minimum(lane_first + LANE, np.repeat(hi_run, pieces)) - 1
        lo, hi = np.zeros(len(lane_first), np.int64), np.full(len(lane_first), self.n)
        at, live, step = start[lane_last] + WINDOW - 1, np.arange(len(lane_first)), 0
        while len(live):
            lo[live], hi[live] = self.step(symbols[at[live]], lo[live], hi[live])
            live = live[hi[live] > lo[live]]
            step += 1
            if step >= WINDOW and len(live):
                window = lane_last[live] - (step - WINDOW)
                good = self.least_owner(lo[live], hi[live]) < doc[window]
                out[window[good]] = True
                live = live[good]
                live = live[lane_last[live] - (step - WINDOW) > lane_first[live]]
            at[live] -= 1
        rest = np.flatnonzero(~out)
        for part in np.array_split(rest, -(-len(rest) // 200_000) or 1):
            lo, hi = self.search(symbols, start[part])
            out[part] = self.least_owner(lo, hi) < doc[part]
        return out


def _column(b, name: str):
    return b.column(b.schema.get_field_index(name))


def _order(ids: np.ndarray) -> np.ndarray:
    return np.minimum(ids, NULL_IDS)


_ROUTED = "part long, kind int, blob binary"


def _rows(rows: list[tuple], names=("part", "kind", "blob"), kinds=(pa.int64(), pa.int32(), pa.binary())) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], list(names))


def _asks(source: np.ndarray, place: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (source document, place, asking shard), in order."""
    order = np.lexsort((place, source, target))
    source, place, target = source[order], place[order], target[order]
    new = np.ones(len(source), bool)
    new[1:] = (source[1:] != source[:-1]) | (place[1:] != place[:-1]) | (target[1:] != target[:-1])
    return source[new], place[new], target[new]


def _split_by(part: np.ndarray, parts: int):
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    return ((p, order[bounds[p] : bounds[p + 1]]) for p in range(parts) if bounds[p] < bounds[p + 1])


def _chains(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order by hash, then id; the first of each hash in it; who has a smaller id with the same hash; and the last of those."""
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    several = ~(new & np.append(new[1:], True)) if len(h) else new
    own = order[several]
    order[several] = own[np.lexsort((ids[own], h[own]))]
    rank = _order(ids[order])
    other = new.copy()
    other[1:] |= rank[1:] != rank[:-1]
    at = np.arange(len(h))
    first, least = np.maximum.accumulate(np.where(new, at, 0)), np.maximum.accumulate(np.where(other, at, 0))
    later = np.flatnonzero(least > first)
    return order, np.flatnonzero(new), later, least[later] - 1


def _windows(shards: int, parts: int):
    def block(held: list[tuple]) -> pa.RecordBatch:
        ids = np.concatenate([h[0] for h in held])
        hashes, docs, places, base = [], [], [], 0
        for own, word, row in held:
            inside = K.whole_grams(row, WINDOW)
            at = np.flatnonzero(inside)
            first = np.searchsorted(row, np.arange(len(own)))
            hashes.append(K.gram_hashes(word, WINDOW)[inside])
            docs.append(row[at] + base)
            places.append((at - first[row[at]]).astype(np.int64))
            base += len(own)
        h, doc, place = np.concatenate(hashes), np.concatenate(docs), np.concatenate(places)
        order, one, later, before = _chains(h, ids[doc])
        h, doc, place = h[order], doc[order], place[order]
        out = []
        source, at, target = _asks(ids[doc[before]], place[before], K.shard_of(ids[doc[later]], shards))
        for p, own in _split_by(K.shard_of(source, shards) % parts, parts):
            out.append((p, 1, K.squeeze(source[own], at[own].astype(np.uint32), target[own].astype(np.uint32))))
        h, doc, place = h[one], doc[one], place[one]
        for p, own in _split_by((h >> K.U64(40)) % K.U64(parts), parts):
            used, index = np.unique(ids[doc[own]], return_inverse=True)
            table = K.squeeze(np.diff(used, prepend=0))
            body = K.squeeze(np.diff(h[own], prepend=K.U64(0)), index.astype(np.uint32), place[own].astype(np.uint32))
            out.append((p, 0, len(table).to_bytes(4, "little") + table + body))
        return _rows(out)

    def run(batches):
        held, size = [], 0
        for b in K.slices(batches, 1 << 20):
            data, off = K.text_bytes(_column(b, "text"))
            start, end, row = K.words(data, off)
            held.append((np.asarray(_column(b, ID)), K.word_hashes(data, start, end), row))
            size += len(data)
            if size >= BLOCK_BYTES:
                yield block(held)
                held, size = [], 0
        if held:
            yield block(held)

    return run


def _firsts(shards: int):
    """For each window, who of those that hold it is asked by whose shard."""

    def run(batches):
        h, doc, place, asks = [], [], [], []
        for b in batches:
            for kind, blob in zip(b.column("kind").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if kind:
                    asks.append([x.astype(np.int64) for x in K.unsqueeze(blob, np.int64, np.uint32, np.uint32)])
                    continue
                n = int.from_bytes(blob[:4], "little")
                ids = np.cumsum(K.unsqueeze(blob[4 : 4 + n], np.int64)[0])
                d, i, p = K.unsqueeze(blob[4 + n :], np.uint64, np.uint32, np.uint32)
                h.append(np.cumsum(d, dtype=np.uint64))
                doc.append(ids[i])
                place.append(p)
        if h:
            h, doc, place = np.concatenate(h), np.concatenate(doc), np.concatenate(place)
            order, _, later, before = _chains(h, doc)
            doc, place = doc[order], place[order].astype(np.int64)
            asks.append([doc[before], place[before], K.shard_of(doc[later], shards)])
        if asks:
            source, place, target = _asks(*(np.concatenate(c) for c in zip(*asks, strict=True)))
            out = [(p, 1, K.squeeze(source[own], place[own].astype(np.uint32), target[own].astype(np.uint32))) for p, own in _split_by(K.shard_of(source, shards), shards)]
            if out:
                yield _rows(out)

    return run


def _sends(docs: pa.Table, wanted: pa.Table) -> pa.Table:
    """Passages of a shard's documents, for each shard that asked: one row each."""
    out: list[tuple] = []
    if wanted.num_rows and docs.num_rows:
        source, place, target = _asks(*(np.concatenate(c).astype(np.int64) for c in zip(*(K.unsqueeze(x, np.int64, np.uint32, np.uint32) for x in wanted["blob"].to_pylist()), strict=True)))
        new = np.ones(len(source), bool)
        new[1:] = (source[1:] != source[:-1]) | (place[1:] > place[:-1] + WINDOW) | (target[1:] != target[:-1])
        lo, hi = K.runs(new)
        source, first, last, target = source[lo], place[lo], place[hi - 1] + WINDOW, target[lo]
        parts: dict[int, list] = {}
        by = np.argsort(source, kind="stable")
        ordered = source[by]
        for b in K.slices(docs.to_batches(), 1 << 20):
            data, off = K.text_bytes(_column(b, "text"))
            start, end, row = K.words(data, off)
            raw, edge, ids = data.tobytes(), np.searchsorted(row, np.arange(b.num_rows + 1)), np.asarray(_column(b, ID))
            lo, hi = np.searchsorted(ordered, ids, side="left"), np.searchsorted(ordered, ids, side="right")
            for k in np.flatnonzero(hi > lo).tolist():
                doc = int(ids[k])
                for r in by[lo[k] : hi[k]].tolist():
                    # of rows that share an id each sends what it has there; a window's words decide later
                    x, y = edge[k] + first[r], min(edge[k] + last[r], edge[k + 1]) - 1
                    if y >= x:
                        parts.setdefault(int(target[r]), []).append((doc, raw[start[x] : end[y]]))
        for t, own in parts.items():
            text = b"".join(x for _, x in own)
            head = K.squeeze(np.array([d for d, _ in own], np.int64), np.array([len(x) for _, x in own], np.uint32))
            out.append((t, 0, len(head).to_bytes(4, "little") + head + K.squeeze_bytes(text)))
    return pa.Table.from_batches([_rows(out)])


def searchable(blobs: list[bytes]) -> tuple[K.Vocabulary, PassageIndex, np.ndarray]:
    """The vocabulary and index of passages, and their windows' hashes."""
    docs, texts, lengths = [], [], []
    for blob in blobs:
        n = int.from_bytes(blob[:4], "little")
        d, length = K.unsqueeze(blob[4 : 4 + n], np.int64, np.uint32)
        docs.append(d)
        lengths.append(length)
        texts.append(K.unsqueeze_bytes(blob[4 + n :]))
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum(np.concatenate(lengths).astype(np.int64))])
    start, end, row = K.words(data, off)
    seed = 0
    while True:
        try:
            vocabulary = K.Vocabulary(data, start, end, seed)
            break
        except K.Collision:
            seed += 1
    windows = np.unique(K.gram_hashes(vocabulary.words, WINDOW)[K.whole_grams(row, WINDOW)])
    return vocabulary, PassageIndex(vocabulary.codes, np.bincount(row, minlength=len(off) - 1), np.concatenate(docs)), windows


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_RESULT_NAMES = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def _removes(docs: pa.Table, found: pa.Table) -> pa.Table:
    out = []
    vocabulary, index, windows = searchable(found["blob"].to_pylist()) if found.num_rows else (None, None, None)
    for b in K.slices(docs.to_batches(), 1 << 20):
        data, off = K.text_bytes(_column(b, "text"))
        start, end, row = K.words(data, off)
        n, count = b.num_rows, np.bincount(row, minlength=b.num_rows)
        gone = np.zeros(len(start), bool)
        if index is not None:
            word = K.word_hashes(data, start, end, vocabulary.seed)
            at = np.flatnonzero(K.whole_grams(row, WINDOW))
            at = at[np.isin(K.gram_hashes(word, WINDOW)[at], windows)]
            near = np.flatnonzero(K.covered(len(word), at, at + WINDOW))
            symbols = np.zeros(len(word), np.int64)
            code = vocabulary.encode(data, start[near], end[near], word[near])
            symbols[near] = np.where(code < 0, 0, code + 2)
            at = at[index.earlier(symbols, at, _order(np.asarray(_column(b, ID)))[row[at]])]
            gone = K.covered(len(word), at, at + WINDOW)
        kept = ~gone
        length = (end - start)[kept] + 1
        cut = np.concatenate([[0], np.cumsum(np.bincount(row[kept], length, n).astype(np.int64))])
        text = np.append(data, np.uint8(32))[K.spread(start[kept], length)]
        text[np.cumsum(length) - 1] = 32
        digest = [hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        removed = np.bincount(row, gone, n).astype(np.int64)
        out.append(pa.RecordBatch.from_arrays([_column(b, "doc_id"), pa.array(count.astype(np.int64)), pa.array(removed), pa.array(digest, pa.string())], _RESULT_NAMES))
    return pa.Table.from_batches(out) if out else pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.string())], _RESULT_NAMES)


def dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of `documents`."""
    docs = K.with_columns(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = parts = K.shard_count(docs, SHARD_BYTES)
    unnamed = F.lit(NULL_IDS) + F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    named = docs.withColumn(ID, F.coalesce("doc_id", unnamed))
    routed = named.select(ID, "text").mapInArrow(_windows(shards, parts), _ROUTED).repartition(parts, "part").mapInArrow(_firsts(shards), _ROUTED)
    sharded = named.withColumn("shard", K.shard_column(ID, shards)).groupBy("shard")
    sent = sharded.cogroup(routed.groupBy(F.col("part").alias("shard"))).applyInArrow(_sends, _ROUTED)
    return sharded.cogroup(sent.groupBy(F.col("part").alias("shard"))).applyInArrow(_removes, RESULT)
