"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to whole numbers. A block of rows stores, for each
attribute, one bitmap per bit. For a query, the slices of all attributes are
added with bitmap arithmetic (signed digits of the query's component choose which
slices, and at which weight), giving the slices of every row's score at once.
From the most significant slice downward, rows are kept or left behind by
counting bits, until the rows at the boundary have equal scores; of those the
smallest ids fill up, so the result is exact.

Every block answers every query with its best k; the best k of those are the
result. Nulls: a vector that is null, empty, or holds a null or a non-finite
component takes no part, nor does a row without an id. A shorter vector counts
as filled up with zeros. Rows that repeat a query's id aren't its candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K

BLOCK_ROWS = 8192
QUERIES_AT_ONCE = 2048
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id long, v array<long>) of the vectors that take part."""
    rows = K.with_columns(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("e") > 0) & fine).select("vec_id", F.transform("e", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))


def matrix(column, width: int | None = None) -> np.ndarray:
    """Lists of numbers as rows; short ones are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    flat = np.asarray(column.flatten())
    width = max(int(sizes.max(initial=0)), width or 0)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), K.spread(np.zeros(len(sizes), np.int64), sizes)] = flat
    return out


def signed_digits(n: int) -> list[tuple[int, int]]:
    """n as few powers of two with signs: (power, +1 or -1), none adjacent."""
    out, at = [], 0
    while n:
        if n & 1:
            d = 2 - (n & 3)
            out.append((at, d))
            n -= d
        n >>= 1
        at += 1
    return out


class BitSlicedBlock:
    """Rows (in ascending order of id) as bitmaps."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.n = len(ids)
        self.low = values.min(axis=0)
        self.bits = [int(x).bit_length() for x in values.max(axis=0) - self.low]
        self.size = -(-self.n // 64)
        self.slices: list[list[np.ndarray]] = []
        self.inverse: list[list[np.ndarray]] = []
        padded = np.zeros(self.size * 64, np.uint64)
        for d, b in enumerate(self.bits):
            padded[: self.n] = (values[:, d] - self.low[d]).astype(np.uint64)
            own = [np.packbits(((padded >> np.uint64(i)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64) for i in range(b)]
            self.slices.append(own)
            self.inverse.append([~s for s in own])
        self.everyone = np.packbits(np.arange(self.size * 64) < self.n, bitorder="little").view(np.uint64)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices, least significant first, of every row's score less a constant; and that constant."""
        columns: list[list[np.ndarray]] = [[]]
        constant = 0
        for d, q in enumerate(query.tolist()):
            constant += q * int(self.low[d])
            for power, sign in signed_digits(q):
                # -x of b bits is (its complement) - (2**b - 1)
                own = self.slices[d] if sign > 0 else self.inverse[d]
                if sign < 0:
                    constant -= ((1 << self.bits[d]) - 1) << power
                while len(columns) < power + len(own):
                    columns.append([])
                for i, s in enumerate(own):
                    columns[power + i].append(s)
        out, w = [], 0
        while w < len(columns):
            column = columns[w]
            if len(column) > 1 and w + 1 == len(columns):
                columns.append([])
            while len(column) > 2:  # a full adder turns three slices into one, and a carry
                a, b, c = column.pop(), column.pop(), column.pop()
                x = a ^ b
                column.insert(0, x ^ c)
                x &= c
                x |= a & b
                columns[w + 1].append(x)
            if len(column) == 2:
                a, b = column
                columns[w + 1].append(a & b)
                column = [a ^ b]
            out.append(column[0] if column else np.zeros(self.size, np.uint64))
            w += 1
        return out, constant

    def top(self, query: np.ndarray, k: int, but: int | None = None) -> tuple[np.ndarray, list[int]]:
        """Ids and exact scores of the k best rows, ties to smaller ids, best first."""
        alive = self.everyone.copy()
        if but is not None:
            for r in range(*np.searchsorted(self.ids, [but, but + 1]).tolist()):
                alive[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        slices, constant = self.scores(query)
        sure = np.zeros(self.size, np.uint64)
        have, tied = 0, int(np.bitwise_count(alive).sum())
        for s in reversed(slices):
            if have + tied <= k:
                break
            x = alive & s
            n = int(np.bitwise_count(x).sum())
            if have + n > k:
                alive, tied = x, n
            else:
                sure |= x
                have += n
                alive = alive & ~s
                tied -= n
        # rows still alive have equal scores unless all of them fit
        rows = np.concatenate([_positions(sure), _positions(alive)[: max(0, k - have)]])
        totals = [constant + sum(int(s[r >> 6] >> np.uint64(r & 63)) % 2 << i for i, s in enumerate(slices)) for r in rows.tolist()]
        best = sorted(range(len(rows)), key=lambda i: (-totals[i], rows[i]))
        return self.ids[rows[best]] if len(rows) else self.ids[:0], [totals[i] for i in best]


def _positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows of largest inner product.

    Both frames have vec_id and v, as quantised() gives them. A query asks once: of query
    rows that share an id, that with the smallest vector (compared by components). Candidates
    that share an id are ranked each.
    """
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    counts = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("w")).first()
    blocks = max(1, -(-counts["n"] // BLOCK_ROWS))
    groups = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    width = counts["w"]
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.select(number("vec_id", blocks).alias("block"), every(groups).alias("group"), "vec_id", "v")
    asked = queries.select(every(blocks).alias("block"), number("vec_id", groups).alias("group"), "vec_id", "v")

    def run(own: pa.Table, wanted: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if own.num_rows and wanted.num_rows:
            block = BitSlicedBlock(np.asarray(own["vec_id"]), matrix(own["v"], width))
            for q, v in zip(wanted["vec_id"].to_pylist(), matrix(wanted["v"], width), strict=True):
                ids, scores = block.top(v, k, q)
                out[0].extend([q] * len(ids))
                out[1].extend(ids.tolist())
                out[2].extend(scores)
        return pa.table([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    found = rows.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
