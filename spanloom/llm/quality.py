"""Quality scores by Bradley-Terry pairwise ranking.

Labelled rows give preference pairs: a good document beats a bad one. Weights
minimise the logistic loss on feature differences, so the learned score ranks;
a quantile of the training scores (the share of bad rows among them) then gives the
threshold, and score - threshold passes through the logistic function. All labelled
training rows teach: features, pairs and scores stay spread over tasks, and only sums
over a task's rows go to the driver.

Features come from the text alone: shape of the bytes, repetition, word lengths.

Nulls: a null text is empty, and is scored like any other; a null document id
stays null and is not held out. Labels that are null, or not 0 or 1, teach
nothing, and neither do those of a document that has both. Rows that repeat a document's
id teach each. Repeated rows are scored each. With no pair to learn from, every
score is 0.5. A text of any length is scored whole, in some 40 times its bytes of memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import shared

FEATURES = 24
#: Each row of one label meets so many of the other, by rotation.
RIVALS = 8
_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58] = True, True, True
_HIGH = np.arange(256) >= 128
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _sums(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (total[off[1:]] - total[off[:-1]]).astype(float)


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES numbers for each text; texts are independent of each other."""
    n_docs = len(off) - 1
    out = np.zeros((n_docs, FEATURES))
    if not n_docs:
        return out
    n = np.maximum(1, np.diff(off)).astype(float)
    start, end, row = K.words(data, off)
    nw_true = np.bincount(row, minlength=n_docs).astype(float)
    nw = np.maximum(1, nw_true)
    length = end - start
    cols = [np.log1p(n), np.log1p(nw_true)]
    cols += [_sums(m[data], off) / n for m in (_UPPER, _LOWER, _DIGIT, _HIGH, _PUNCT)]
    cols += [_sums(data == c, off) / n for c in (ord("!"), ord("."), ord(","), 10, ord("#"), ord("<"))]
    mean = np.bincount(row, length, n_docs) / nw
    cols += [mean, np.sqrt(np.maximum(0, np.bincount(row, length.astype(float) ** 2, n_docs) / nw - mean**2))]
    if len(start):
        h = K.word_hashes(data, start, end)
        key = K.mix(h + row.astype(np.uint64) * K.U64(0x9E3779B97F4A7C15))
        uniq, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        distinct = np.bincount(row[first], minlength=n_docs)
        top = np.zeros(n_docs)
        np.maximum.at(top, row[first], count)
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        pair = K.mix(key[1:] * K.U64(3) + key[:-1]) if len(key) > 1 else key[:0]
        inside = row[1:] == row[:-1]
        _, at = np.unique(pair[inside], return_index=True)
        pairs = np.bincount(row[1:][inside][at], minlength=n_docs)
        caps = _UPPER[data[start]]
        shout = caps & _UPPER[data[np.maximum(start, end - 2)]] & (length > 2)
        ends = np.isin(data[end - 1], [33, 46, 63])
        cols += [distinct / nw, top / nw, np.bincount(row, same, n_docs) / nw, pairs / np.maximum(1, nw_true - 1), np.log1p(distinct)]
        cols += [np.bincount(row, x, n_docs) / nw for x in (caps, shout, ends)]
        cols.append(np.bincount(row, length > 18, n_docs) / nw)
    for j, c in enumerate(cols[:FEATURES]):
        out[:, j] = c
    return out


def _slopes(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over pairs with differences `d`: the gradient, then the Hessian's rows."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance that the worse one wins
    return np.vstack([d.T @ p, (d * (p * (1 - p))[:, None]).T @ d])


def _newton(slopes, n: int, size: int, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    w = np.zeros(size)
    for _ in range(steps):
        sums = slopes(w) / n
        step = np.linalg.solve(sums[1:] + ridge * np.eye(size), sums[0] - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def bradley_terry(good: np.ndarray, bad: np.ndarray, share: float | None = None, ridge: float = 1e-3, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights by Newton's method over pairs (good, bad), and the threshold between the two.

    `share` is that of bad rows where these are drawn from; without it, that among these.
    """
    if not len(good) or not len(bad):
        return np.zeros(good.shape[1] if good.ndim == 2 else FEATURES), 0.0
    n = max(len(good), len(bad)) * RIVALS
    i = np.arange(n)
    d = good[i % len(good)] - bad[(i + i // max(len(good), len(bad))) % len(bad)]
    w = _newton(lambda w: _slopes(d, w), n, d.shape[1], ridge, steps)
    return w, threshold(good @ w, bad @ w, len(bad) / (len(good) + len(bad)) if share is None else share)


def threshold(good: np.ndarray, bad: np.ndarray, share: float) -> float:
    """The quantile of all scores at the share of bad rows, half way to the next score. Rows weigh as many as they stand for."""
    scores = np.concatenate([good, bad])
    weight = np.concatenate([np.full(len(good), (1 - share) / len(good)), np.full(len(bad), share / len(bad))])
    order = np.argsort(scores, kind="stable")
    scores = scores[order]
    k = int(np.searchsorted(np.cumsum(weight[order]), share - 1e-9)) + 1
    return float((scores[min(k, len(scores)) - 1] + scores[min(k, len(scores) - 1)]) / 2)


def _featured(*keep: str):
    def run(batches):
        for b in K.slices(batches, 2 << 20):
            data, off = K.text_bytes(b.column(b.schema.get_field_index("text")))
            x = features(data, off)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keep), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))], [*keep, "x"])

    return run


def in_training(doc_id) -> F.Column:
    """Rows that may teach: crc32 of the id as text, modulo 3, is not 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1, F.lit(True))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def _summed(frame: DataFrame, of) -> list[np.ndarray]:
    """For each task with rows, the sum of `of(batch)` over its batches."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                total = of(b) if total is None else total + of(b)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return [np.frombuffer(r["sums"]) for r in frame.mapInArrow(run, "sums binary").collect()]


def _numbered(frame: DataFrame, *order: str) -> DataFrame:
    """The rows, written to the shared folder, with `n`: their number in this order, from 0. No task has more than a range of them."""
    spark = frame.sparkSession
    rows = shared.kept(frame.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    counts = sorted((r["part"], r["count"]) for r in rows.groupBy(F.shiftright("at", 33).alias("part")).count().collect())
    offsets, before = [], 0
    for part, count in counts:
        offsets.append((part, before - (part << 33)))
        before += count
    out = rows.join(F.broadcast(spark.createDataFrame(offsets, "part long, shift long")), F.shiftright("at", 33) == F.col("part")).withColumn("n", F.col("at") + F.col("shift")).drop("at", "part", "shift")
    out._kept_in = rows._kept_in
    return out


def fit(documents: DataFrame, labels: DataFrame) -> dict:
    """Learn from all labelled training rows. Texts stay where they are: features of all rows that may teach meet the labels."""
    own = K.with_columns(labels, "doc_id", "quality").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    own = own.where("doc_id is not null and quality in (0, 1)").where(in_training(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    docs = K.with_columns(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.where("doc_id is not null").where(in_training(F.col("doc_id")))
    # written first, as sorting looks at rows twice
    found = shared.kept(docs.mapInArrow(_featured("doc_id"), "doc_id long, x array<double>").join(own, "doc_id"), "features")
    rows = _numbered(found, "quality", "doc_id", "x")
    try:
        return _fit(rows)
    finally:
        shared.drop(rows, found)


def _fit(rows: DataFrame) -> dict:
    """Rows are (quality, x, n), bad ones first."""

    def sums(b) -> np.ndarray:
        x = _matrix(b.column(1))
        return np.concatenate([[len(x), np.asarray(b.column(0)).sum()], x.sum(0)])

    total = sum(_summed(rows.select("quality", "x"), sums), np.zeros(2 + FEATURES))
    count, n_good = int(total[0]), int(total[1])
    n_bad = count - n_good
    if not count:
        return {"mean": np.zeros(FEATURES), "scale": np.ones(FEATURES), "weights": np.zeros(FEATURES), "threshold": 0.0}
    mean = total[2:] / count
    scale = np.sqrt(sum(_summed(rows.select("x"), lambda b: ((_matrix(b.column(0)) - mean) ** 2).sum(0))) / count)
    scale = np.where(scale > 1e-9, scale, 1.0)
    model = {"mean": mean, "scale": scale, "weights": np.zeros(FEATURES), "threshold": 0.0}
    if not n_good or not n_bad:
        return model
    pairs = shared.kept(_pairs(rows, n_good, n_bad, mean, scale), "pairs")
    unpacked = lambda b: np.frombuffer(b"".join(b.column(0).to_pylist())).reshape(-1, FEATURES)
    slopes = lambda w: sum(_summed(pairs, lambda b: _slopes(unpacked(b), w).ravel())).reshape(-1, FEATURES)
    try:
        model["weights"] = w = _newton(slopes, max(n_good, n_bad) * RIVALS, FEATURES)
    finally:
        shared.drop(pairs)

    def scored(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.clip((_matrix(b.column(0)) - mean) / scale, -8, 8) @ w)], ["score"])

    ranked = _numbered(rows.select("x").mapInArrow(scored, "score double"), "score")
    try:
        # as threshold() has it: half way between the last score that the bad rows' share takes in, and the next
        model["threshold"] = float(np.mean([r["score"] for r in ranked.where(F.col("n").isin(n_bad - 1, n_bad)).collect()]))
    finally:
        shared.drop(ranked)
    return model


#: A label with at most so many rows is sent to all tasks, so that few rows with many rivals each don't end in few tasks.
FEW = 8192


def _pairs(rows: DataFrame, n_good: int, n_bad: int, mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """Differences of the pairs that bradley_terry() has, packed: each row of the larger label meets RIVALS of the other."""
    most, rounds = max(n_good, n_bad), F.explode(F.sequence(F.lit(0), F.lit(RIVALS - 1)))
    good, bad = rows.where("quality = 1").select((F.col("n") - n_bad).alias("n"), F.col("x").alias("good")), rows.where("quality = 0").select("n", F.col("x").alias("bad"))
    if n_good >= n_bad:
        many, few, rival = good, bad, F.pmod(F.col("round") * (most + 1) + F.col("n"), F.lit(n_bad))
    else:
        many, few, rival = bad, good, F.pmod(F.col("round") * most + F.pmod(F.col("n") - F.col("round"), F.lit(most)), F.lit(n_good))
    many = many.withColumn("round", rounds).withColumn("rival", rival.cast("long")).drop("n")
    few = few.withColumnRenamed("n", "rival")
    both = many.join(F.broadcast(few) if min(n_good, n_bad) <= FEW else few, "rival").select("good", "bad")
    z = lambda x: np.clip((x - mean) / scale, -8, 8)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([(z(_matrix(b.column(0))) - z(_matrix(b.column(1)))).tobytes()], pa.binary())], ["d"])

    return both.mapInArrow(run, "d binary")


def scores(data: np.ndarray, off: np.ndarray, model: dict) -> np.ndarray:
    z = np.clip((features(data, off) - model["mean"]) / model["scale"], -8, 8)
    return 1 / (1 + np.exp(-np.clip((z * model["weights"]).sum(1) - model["threshold"], -30, 30)))


def accepted(documents: DataFrame, model: dict) -> DataFrame:
    """The rows of `documents` whose score is 0.5 at least, in the same columns, whatever their names."""
    text = documents.columns.index("text")
    plain = documents.toDF(*(f"column_{i}" for i in range(len(documents.columns))))

    def run(batches):
        for b in K.slices(batches, 2 << 20, column=text):
            yield b.filter(pa.array(scores(*K.text_bytes(b.column(text)), model) >= 0.5))

    return plain.mapInArrow(run, plain.schema).toDF(*documents.columns)


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `documents`."""
    model = fit(documents, labels)
    docs = K.with_columns(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for b in K.slices(batches, 2 << 20):
            data, off = K.text_bytes(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(data, off, model))], ["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
