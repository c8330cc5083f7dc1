"""Near-duplicate documents: MinHash banding with sequential Bayesian verification.

A document's set is its distinct word shingles. Documents of equal word sequences,
by SHA-256, form one class, and only one of them goes on. Signatures are cut into
bands; classes with an equal band are candidates. A pair's signatures are compared a
batch at a time, and it is dropped once the posterior chance that its similarity
reaches the threshold falls below MISS. Survivors are held against each other's
full sets, and links form components.

Buckets are never expanded into pairs. First each bucket is sorted so that members
with more of the signature in common stand together, and only neighbours that look
alike enough are held against each other. Then only buckets that still hold more
than one component are looked at, and only pairs of different components, of set
sizes that allow it, in the first band that they share:

- in a bucket of at most SMALL members, pairs that pass the Bayesian test go on;
- a larger one is dealt into blocks of about BLOCK members. Members outside the
  bucket's largest component are held against each block, in parts of as many: by the
  Bayesian test, then by full sets of 64-bit shingle hashes. What is linked in a tile (a
  block and a part) joins there, so a tile gives no more links than it holds components.

Every link is confirmed on the texts' own words: words with equal hashes are compared
byte by byte, and shingles with equal hashes word by word. So every pair that shares a
band is either in one component already or has been tested.

At similarity 0.85 a pair shares none of the BANDS bands of ROWS values with a
chance of (1 - 0.85**5)**24 = 8e-7; at 0.80, with a chance of 7e-5. Set sizes are
counts of distinct 64-bit hashes.

Work on a large bucket grows with its members times those outside its largest
component. Tasks and memory are bounded by a tile's rows; one row's text
needs some 60 times its bytes while it is hashed.

Nulls: a null or empty text has an empty set and is linked with nothing; fewer
words than a shingle are one shingle. A null id stays null, is its own component and
links nobody. Rows with the same id but different texts are different documents; if
they aren't linked they have the same component_id all the same, as it is their id. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .shared import drop, kept, small_batches

SHINGLE = 5
BANDS, ROWS, HASHES, BATCH = 24, 5, 128, 32
#: A pair is linked if 100 * intersection >= PERCENT * union, unless link() is told another percentage.
PERCENT = 85
MISS = 1e-6
#: Members of buckets whose pairs are written out; of blocks of larger buckets; and of a block the shingles, about.
SMALL, BLOCK, BLOCK_SHINGLES = 16, 1024, 1 << 20
#: Neighbours are held against each other, before the tiles, if at most so many fewer signature values agree than the threshold's share.
ALIKE = 4
_SEEDS = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, HASHES, dtype=np.uint64) * K.U64(2) + K.U64(1)
_SHIFTS = np.random.Generator(np.random.PCG64(6)).integers(1, 1 << 63, HASHES, dtype=np.uint64)


def least_matches(share: float = PERCENT / 100, miss: float = MISS) -> list[tuple[int, int]]:
    """(values compared, fewest that must agree) after each batch.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1); its upper tail at
    `share` is the chance of at most m successes in n + 1 trials of that chance.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while m < n:
            tail += comb(n + 1, m + 1) * share ** (m + 1) * (1 - share) ** (n - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m + 1))
    return out


def survivors(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which pairs of signatures (rows of a and b) pass every batch; later batches are read for those only."""
    live, agree, at = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in least_matches(percent / 100):
        agree[live] += (a[live, at:n] == b[live, at:n]).sum(1)
        live, at = live[agree[live] >= least], n
    return live


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Shingle hashes and their rows (repeats included), and SHA-256 of each text's words with one space between."""
    docs = len(off) - 1
    low = K.LOWER_AZ[data]
    start, end, row = K.words(low, off)
    word = K.word_hashes(low, start, end)
    count = np.bincount(row, minlength=docs)
    length = end - start + 1
    plain = np.append(low, np.uint8(32))[K.spread(start, length)]
    plain[np.cumsum(length) - 1] = 32
    cut = np.concatenate([[0], np.cumsum(np.bincount(row, length, docs).astype(np.int64))]).tolist()
    whole = [hashlib.sha256(plain[a:z]).digest() for a, z in zip(cut[:-1], cut[1:], strict=True)]
    inside = K.whole_grams(row, SHINGLE)
    h, r = K.gram_hashes(word, SHINGLE)[inside], row[: len(inside)][inside]
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        own = np.array([int.from_bytes(whole[k][:8], "little") for k in short.tolist()], np.uint64)
        h, r = np.concatenate([h, own]), np.concatenate([r, short])
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r, whole


def _distinct(h: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]


def signatures(h: np.ndarray, r: np.ndarray, docs: int) -> np.ndarray:
    """HASHES values for each text; texts without shingles have zeros."""
    out = np.zeros((docs, HASHES), np.uint32)
    if len(h):
        lo, _ = K.runs(np.diff(r, prepend=-1) != 0)
        for k in range(HASHES):
            out[r[lo], k] = np.minimum.reduceat(h * _SEEDS[k] + _SHIFTS[k], lo) >> K.U64(32)
    return out


def _signs(batches):
    for b in K.slices(batches, 2 << 20):
        h, r, whole = shingles(*K.text_bytes(b.column(1)))
        h, r = _distinct(h, r)
        docs = b.num_rows
        n = np.bincount(r, minlength=docs)
        sig = signatures(h, r, docs)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array([x if k else None for x, k in zip(whole, n, strict=True)], pa.binary()), pa.array(n.astype(np.int64)), pa.array([x.tobytes() if k else None for x, k in zip(sig, n, strict=True)], pa.binary())],
            ["doc_id", "mark", "words", "n_shingles", "sig"],
        )


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data, _ = K.text_bytes(column)
    return data.view(np.uint32).reshape(-1, HASHES) if len(data) else np.zeros((0, HASHES), np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A column of keys for each band."""
    keys = []
    for k in range(BANDS):
        key = np.full(len(sig), K.U64(k + 1))
        for c in range(ROWS):
            key = K.mix(key * K.U64(31) + sig[:, k * ROWS + c].astype(np.uint64))
        keys.append(key)
    return np.stack(keys, 1).view(np.int64)


def _banded(batches):
    for b in batches:
        if not b.num_rows:
            continue
        sig, ids = _matrix(b.column(1)), np.asarray(b.column(0))
        nexts = [sig[:, after].astype(np.int64) << 31 | sig[:, after + 1].astype(np.int64) >> 1 for after in range(ROWS, BANDS * ROWS + 1, ROWS)]
        yield pa.RecordBatch.from_arrays([pa.array(band_keys(sig).T.ravel()), pa.array(np.concatenate(nexts)), pa.array(np.tile(ids, BANDS))], ["key", "next", "id"])


def _neighbours(batches):
    """Rows that follow each other in one bucket. Rows come sorted."""
    last = None
    for b in batches:
        if b.num_rows:
            key, ids = np.asarray(b.column(0)), np.asarray(b.column(1))
            if last is not None:
                key, ids = np.append(last[0], key), np.append(last[1], ids)
            last = key[-1], ids[-1]
            at = np.flatnonzero((key[1:] == key[:-1]) & (ids[1:] != ids[:-1]))
            a, z = ids[at], ids[at + 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, z)), pa.array(np.maximum(a, z))], ["a", "b"])


def _alike(percent: int):
    least = HASHES * percent // 100 - ALIKE

    def run(batches):
        for b in batches:
            if b.num_rows:
                live = pa.array(np.flatnonzero((_matrix(b.column(2)) == _matrix(b.column(3))).sum(1) >= least))
                yield pa.RecordBatch.from_arrays([b.column(0).take(live), b.column(1).take(live)], ["a", "b"])

    return run


def _pairs_in_words(a, b, percent: int) -> np.ndarray:
    """Which pairs of texts have sets similar enough, with words compared by their bytes and shingles by their words."""
    n, seed = len(a), 0
    data, off = K.text_bytes(pa.concat_arrays([a, b]))
    low = K.LOWER_AZ[data]
    start, end, row = K.words(low, off)
    inside = np.flatnonzero(K.whole_grams(row, SHINGLE))
    while True:
        try:
            words = K.Vocabulary(low, start, end, seed)
            h, r = K.gram_hashes(words.words, SHINGLE)[inside], row[inside]
            order = np.lexsort((r, h, r % n))
            at, h, r = inside[order], h[order], r[order]
            again = np.flatnonzero((h[1:] == h[:-1]) & (r[1:] % n == r[:-1] % n))
            if any((words.codes[at[again] + j] != words.codes[at[again + 1] + j]).any() for j in range(SHINGLE)):
                raise K.Collision
            break
        except K.Collision:
            seed += 1
    own = np.ones(len(h), bool)
    own[again + 1] = r[again + 1] != r[again]  # the set of one side
    pair = np.ones(len(h), bool)
    pair[again + 1] = False  # the union
    size, union = np.bincount(r[own], minlength=2 * n), np.bincount(r[pair] % n, minlength=n)
    shared = size[:n] + size[n:] - union
    # texts shorter than a shingle are equal to nothing but themselves, which are in their class
    alone = np.bincount(row, minlength=2 * n) < SHINGLE
    return np.flatnonzero((100 * shared >= percent * union) & (shared > 0) & ~alone[:n] & ~alone[n:])


def _exact(percent: int):
    """Pairs whose full sets are similar enough."""

    def run(batches):
        for b in batches:
            size = np.diff(K.text_bytes(b.column(2))[1]) + np.diff(K.text_bytes(b.column(3))[1])
            edge, lo = np.cumsum(size), 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] - size[lo] + (2 << 20), side="right")))
                part = b.slice(lo, hi - lo)
                live = pa.array(_pairs_in_words(part.column(2), part.column(3), percent))
                yield pa.RecordBatch.from_arrays([part.column(0).take(live), part.column(1).take(live)], ["a", "b"])
                lo = hi

    return run


def _sets(batches):
    """Sorted distinct shingle hashes of each text."""
    for b in K.slices(batches, 2 << 20):
        h, r = _distinct(*shingles(*K.text_bytes(b.column(1)))[:2])
        at = np.searchsorted(r, np.arange(b.num_rows + 1)).tolist()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h[x:y].tobytes() for x, y in zip(at, at[1:], strict=False)], pa.binary())], ["id", "shingles"])


def _runs_of(columns: list[np.ndarray]):
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return zip(*(x.tolist() for x in K.runs(new)), strict=True)


class Block:
    """Members of a bucket: ids, components, set sizes, signatures and, if given, sets."""

    def __init__(self, t, percent: int):
        self.ids, self.label, self.size, self.sig = np.asarray(t["id"]), np.asarray(t["label"]), np.asarray(t["n_shingles"]), _matrix(t["sig"])
        self.percent = percent
        if "shingles" in t.schema.names:
            raw, at = K.text_bytes(t["shingles"])
            self.flat, self.at = raw.view(np.uint64), at // 8

    def band(self, key: int) -> int:
        """The band that a key of all members belongs to."""
        return int(np.argmax(band_keys(self.sig[:1])[0] == key))

    def candidates(self, k: int, other: Block, among: np.ndarray, band: int) -> np.ndarray:
        """Which of the other's rows `among` member k is to be held against, by sizes, signatures and the first shared band."""
        size, sig = self.size[k], self.sig[k]
        y = among[100 * np.minimum(other.size[among], size) >= self.percent * np.maximum(other.size[among], size)]
        y = y[survivors(np.broadcast_to(sig, (len(y), HASHES)), other.sig[y], self.percent)] if len(y) else y
        if band and len(y):
            y = y[~(other.sig[y, : band * ROWS] == sig[: band * ROWS]).reshape(len(y), band, ROWS).all(2).any(1)]
        return y

    def reaching(self, k: int, other: Block, y: np.ndarray) -> np.ndarray:
        """Which of the other's rows y have sets similar enough to member k's."""
        own, lengths = self.flat[self.at[k] : self.at[k + 1]], other.at[y + 1] - other.at[y]
        theirs = other.flat[K.spread(other.at[y], lengths)]
        hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
        both = np.add.reduceat(hit.astype(np.int64), np.cumsum(lengths) - lengths)
        return y[100 * both >= self.percent * (len(own) + lengths - both)]


def _link_batch(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) if pairs else np.zeros(0, np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _small(percent: int):
    """Pairs of different components in small buckets that pass the Bayesian test. Rows come sorted by key."""

    def pairs(t: pa.Table):
        key, every, out = np.asarray(t["key"]), Block(t, percent), []
        bands = (band_keys(every.sig) == key[:, None]).argmax(1)
        for lo, hi in _runs_of([key]):
            band = int(bands[lo])
            for k in range(lo, hi - 1):
                y = np.arange(k + 1, hi)
                y = every.candidates(k, every, y[every.label[y] != every.label[k]], band)
                if len(y):
                    out.append((np.full(len(y), every.ids[k]), every.ids[y]))
        return _link_batch(out)

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            if t.num_rows:
                key = np.asarray(t["key"])
                cut = int(np.argmax(key == key[-1]))  # the last bucket may go on in the next batch
                if cut:
                    yield pairs(t.slice(0, cut))
                rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield pairs(rest)

    return run


def _blocks(percent: int, joining: bool = True):
    """Links between the members of each (key, block, part), which come first, and the rows that are held against them.

    What is linked joins, unless told not to: a row gives one link with each component.
    """

    def links(base: Block, more: Block, probed: np.ndarray, band: int, joined: dict[int, int]):
        def root(x: int) -> int:
            while (up := joined.get(x, x)) != x:
                joined[x] = joined.get(up, up)
                x = up
            return x

        out = []
        for k in range(len(more.ids)):
            mine = root(int(more.label[k]))
            # of two rows that are both held against blocks, the smaller id does it
            y = more.candidates(k, base, np.flatnonzero((base.label != more.label[k]) & (~probed | (base.ids > more.ids[k]))), band)
            if joining and len(y):
                y = y[np.array([root(x) != mine for x in base.label[y].tolist()])]
            y = more.reaching(k, base, y) if len(y) else y
            for j in y.tolist():
                if not joining or (theirs := root(int(base.label[j]))) != mine:
                    out.append((more.ids[k : k + 1], base.ids[j : j + 1]))
                    if joining:
                        joined[theirs] = mine
        return out

    def run(batches):
        at, parts, base, probed, band, joined = None, [], None, None, 0, {}
        for b in batches:
            if not b.num_rows:
                continue
            *tile, probe = (np.asarray(b.column(b.schema.get_field_index(c)).cast(pa.int64())) for c in ("key", "block", "part", "probe"))
            found = []
            for lo, hi in _runs_of([*tile, probe]):
                part = b.slice(lo, hi - lo)
                if (here := tuple(int(c[lo]) for c in tile)) != at:
                    at, parts, base = here, [], None
                if not probe[lo]:
                    parts.append(part)
                    continue
                if base is None:
                    if not parts:
                        continue  # an empty block
                    t = pa.Table.from_batches(parts).combine_chunks()
                    base, probed, parts, joined = Block(t, percent), np.asarray(t["label"]) != np.asarray(t["largest"]), [], {}
                    band = base.band(at[0])
                found += links(base, Block(part, percent), probed, band, joined)
            yield _link_batch(found)

    return run


def link(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `documents`; `percent` is the least similarity of a link."""
    with small_batches(documents.sparkSession):
        return _link(documents, percent).drop("mark")


def without_copies(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of `documents` that link() keeps, in the same columns, whatever their names."""
    plain = documents.toDF(*(c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(documents.columns)))
    with small_batches(documents.sparkSession):
        gone = _link(plain, percent).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct()
    own = (plain["doc_id"].cast("long") == gone["gone_id"]) & (F.xxhash64(plain["text"].cast("string")) == gone["gone_mark"])
    return plain.join(gone, own, "left_anti").toDF(*documents.columns)


def _link(documents: DataFrame, percent: int) -> DataFrame:
    docs = K.with_columns(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    signed = kept(docs.mapInArrow(_signs, "doc_id long, mark long, words binary, n_shingles long, sig binary"), "signed")
    first = signed.where("n_shingles > 0 and doc_id is not null").groupBy("words").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    classes = kept(first.select("words", "first.doc_id", "first.mark", F.monotonically_increasing_id().alias("id")), "classes")
    reps = kept(signed.join(classes, ["words", "doc_id", "mark"]).select("id", "sig", "n_shingles").dropDuplicates(["id"]), "reps")
    bands = reps.select("id", "sig").mapInArrow(_banded, "key long, next long, id long")
    shared = kept(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = kept(bands.join(shared, "key"), "members")
    named = classes.select("id", "doc_id", "mark").join(members.select("id").distinct(), "id")
    texts = kept(docs.join(named, ["doc_id", "mark"]).select("id", "text").dropDuplicates(["id"]), "texts")
    sigs = lambda c: reps.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"))
    words = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))

    def exact(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(words("b"), "b").join(words("a"), "a").select("a", "b", "text_a", "text_b")
        return joined.mapInArrow(_exact(percent), "a long, b long")

    order = ["key", "next", "id"]
    chain = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).select("key", "id").mapInArrow(_neighbours, "a long, b long").distinct()
    tested = kept(chain.join(sigs("b"), "b").join(sigs("a"), "a").select("a", "b", "sig_a", "sig_b").mapInArrow(_alike(percent), "a long, b long"), "tested")
    links = kept(exact(tested), "links")
    labels = components(links)
    drop(tested, shared)

    placed = kept(members.select("key", "id", "n").join(labels, "id", "left").select("key", "id", "n", F.coalesce("label", "id").alias("label")), "placed")
    counted = placed.groupBy("key", "label").agg(F.count("*").alias("c"))
    mixed = kept(counted.groupBy("key").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("c", "label")).alias("largest")).where("labels > 1").select("key", "largest"), "mixed")
    dealt = kept(placed.join(mixed, "key").join(reps.select("id", "n_shingles"), "id"), "dealt")
    small = dealt.where(F.col("n") <= SMALL).join(reps.select("id", "sig"), "id").select("key", "id", "label", "n_shingles", "sig")
    small = small.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_small(percent), "a long, b long")

    wide = dealt.where(F.col("n") > SMALL)
    most = lambda c: F.greatest(F.ceil(F.count_if(c) / BLOCK), F.ceil(F.sum(F.when(c, F.col("n_shingles")).otherwise(0)) / BLOCK_SHINGLES), F.lit(1)).cast("long")
    blocks = kept(wide.groupBy("key").agg(most(F.lit(True)).alias("blocks"), most(F.col("label") != F.col("largest")).alias("groups")), "blocks")
    wide = wide.join(blocks, "key")
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    base = wide.withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("part", each("groups")).withColumn("probe", F.lit(0))
    probes = wide.where("label <> largest").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), "groups")).withColumn("block", each("blocks")).withColumn("probe", F.lit(1))
    sets = texts.join(wide.select("id").distinct(), "id", "left_semi").select("id", "text").mapInArrow(_sets, "id long, shingles binary")
    rows = base.unionByName(probes).select("key", "block", "part", "probe", "id", "label", "largest").join(reps, "id").join(sets, "id")
    tile = ("key", "block", "part")
    rows = rows.repartition(*tile).sortWithinPartitions(*tile, "probe", "id").select(*tile, "probe", "id", "label", "largest", "n_shingles", "sig", "shingles")
    joint = kept(rows.mapInArrow(_blocks(percent), "a long, b long").distinct(), "tested")
    tested = kept(small, "tested")
    rest = kept(exact(tested.union(joint)), "links")
    if joint.join(rest, ["a", "b"], "left_anti").limit(1).count():
        # a link was none, so what it joined may have lost others: hold every pair against its texts
        drop(rest)
        rest = kept(exact(tested.union(rows.mapInArrow(_blocks(percent, joining=False), "a long, b long")).distinct()), "links")
    if rest.limit(1).count():
        drop(labels)
        labels = components(links.union(rest))

    own = classes.join(labels, "id", "left").select("words", "doc_id", F.coalesce("label", "id").alias("label"))
    lowest = own.groupBy("label").agg(F.min("doc_id").alias("lowest"))
    marked = kept(own.join(lowest, "label").select("words", "lowest"), "marked")
    drop(reps, members, texts, links, placed, mixed, dealt, blocks, tested, joint, rest, classes, labels)
    out = signed.drop("sig").join(marked, "words", "left").select("doc_id", "mark", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("lowest", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
