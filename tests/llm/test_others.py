"""Search, archives and chat against brute force; and the pipeline."""

import gzip
import hashlib
import random

import numpy as np
import pytest

from spanloom.llm import bitsliced, chat, knn_tree, shared, warc

VECTORS = "vec_id long, embedding array<float>, score int, leaf int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    own = rng.normal(size=(300, 8)).astype(np.float32)
    own[50:90] = own[3]
    rows = [(i, v.tolist(), 1, 2) for i, v in enumerate(own)]
    odd = [(400, None, 1, 1), (401, [1.0, None] * 4, 1, 1), (402, [float("nan")] * 8, 1, 1), (403, [float("inf")] * 8, 1, 1), (404, [0.0] * 8, 1, 1), (None, [1.0] * 8, 1, 1), (405, [], 1, 1)]
    return spark.createDataFrame([*rows, *odd, rows[3]], VECTORS), own


def test_bitsliced(spark, vectors):
    frame, own = vectors
    rows = bitsliced.quantised(frame)
    got = {}
    for r in bitsliced.search(rows, rows.where("vec_id % 30 = 0"), 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = np.floor(own.astype(float) * 1024).astype(np.int64)
    every = [*((i, v) for i, v in enumerate(whole)), (404, np.zeros(8, np.int64)), (3, whole[3])]
    for q in [*range(0, 300, 30)]:
        want = sorted(((-int(v @ whole[q]), i) for i, v in every if i != q))[:7]
        assert [(i, s) for _, i, s in sorted(got[q])] == [(i, -s) for s, i in want]
    twice = rows.where("vec_id in (0, 30)").unionByName(rows.where("vec_id = 0"))
    again = {}
    for r in bitsliced.search(rows, twice, 7).collect():
        again.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: sorted(x) for q, x in again.items()} == {q: sorted(got[q]) for q in (0, 30)}
    none = bitsliced.quantised(spark.createDataFrame([], VECTORS))
    assert bitsliced.search(none, none).count() == 0


def test_bitsliced_block():
    rng = np.random.default_rng(1)
    ids, x = np.arange(200), rng.integers(-900, 900, (200, 5))
    block = bitsliced.BitSlicedBlock(ids, x)
    for q in rng.integers(-900, 900, (20, 5)):
        best = sorted(range(200), key=lambda i: (-int(x[i] @ q), i))
        for k in (1, 10, 199, 500):
            got, scores = block.top(q, k)
            assert got.tolist() == best[:k] and scores == [int(x[i] @ q) for i in best[:k]]


def test_kmeans_tree(spark, vectors):
    frame, own = vectors
    rows = knn_tree.usable(frame)
    got = {}
    for r in knn_tree.search(rows, rows.where("vec_id % 10 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    unit = own.astype(float) / np.linalg.norm(own.astype(float), axis=1)[:, None]
    hit = 0
    for q in range(0, 300, 10):
        s = unit @ unit[q]
        near = [i for _, i in sorted((-s[i], i) for i in range(300) if i != q)[:5]]
        hit += len(set(near) & {i for _, i, _ in got[q]})
        scores = [x for _, _, x in sorted(got[q])]
        assert scores == sorted(scores, reverse=True) and q not in {i for _, i, _ in got[q]}
    assert hit >= 0.9 * 150
    twice = rows.where("vec_id in (0, 30)").unionByName(rows.where("vec_id = 0"))
    again = {}
    for r in knn_tree.search(rows, twice, 5).collect():
        again.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert all([k for k, _ in sorted(x)] == [1, 2, 3, 4, 5] and len({v for _, v in x}) == 5 for x in again.values())
    none = knn_tree.usable(spark.createDataFrame([], VECTORS))
    assert knn_tree.search(none, none).count() == 0


def test_kmeans_tree_with_vectors_longer_than_the_sample(spark, monkeypatch):
    monkeypatch.setattr(knn_tree, "FIT_ROWS", 20)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4 if i % 50 else 9).tolist()) for i in range(200)]
    frame = knn_tree.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert knn_tree.search(frame, frame.where("vec_id % 50 = 0"), 5).count() == 20


PAGES = "page_id long, url string, html string, digest string, first long"


def test_warc(spark, tmp_path):
    rng = random.Random(1)
    large = "".join(rng.choice("abcé漢\r\n0 ") for _ in range(150_000))
    rows = [(5, "http://a b/\r\nX: y", large, "d", 1), (2, None, large, None, None), (9, "http://c", "x" * 99, "", 0), (1, "http://c", "x" * 99, "", 0), (3, "http://d", None, "", 0), (4, "http://d", "", "", 0), (7, "u", "y" * 100, "", 0), (6, "u", "y" * 100, "", 0), (6, "u", "y" * 100, "", 0), (None, "u", "WARC/1.1\r\n\r\n" * 20, "", 0)]
    pages = spark.createDataFrame(rows, PAGES)
    warc.write(pages, str(tmp_path / "w"), segment=20_000)
    got = sorted(warc.read(spark, str(tmp_path / "w")).collect(), key=lambda r: (r.page_id or 0, r.record_type))
    first = {}
    for i, _, t, _, _ in rows:
        t = (t or "").encode()
        if i is not None and len(t) >= 100:
            first[t] = min(i, first.get(t, i))
    want = []
    for i, _, t, _, _ in rows:
        t = (t or "").encode()
        again = i is not None and first.get(t, i) < i
        want.append((i, len(t), hashlib.sha256(t).hexdigest(), "revisit" if again else "response", first[t] if again else None))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (r[0] or 0, r[3]))
    warc.write(pages.limit(0), str(tmp_path / "e"))
    # archives are cut by bytes; segments of a page then lie in several
    warc.write(pages, str(tmp_path / "s"), segment=20_000, most=30_000)
    files = list((tmp_path / "s").glob("*.gz"))
    assert len(files) >= 5 and max(len(gzip.decompress(f.read_bytes())) for f in files) < 60_000
    assert sorted(warc.read(spark, str(tmp_path / "s")).collect(), key=lambda r: (r.page_id or 0, r.record_type)) == got


def test_segments_are_put_in_order_and_checked():
    parts = list(warc.parse(b"".join(warc.records(1, "u", b"z" * 5000, hashlib.sha256(b"z" * 5000).hexdigest(), None, 1000))))
    rows = [(int(f["warc-segment-number"]), int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, f if f["warc-segment-number"] == "1" else None, b) for f, b in parts]
    assert len(rows) > 4
    assert warc.page(*warc.reassemble(rows[::-1])[0])[1] == 5000
    for broken in (rows[:-1], rows[1:], [*rows[:2], *rows[3:]]):
        with pytest.raises(warc.ArchiveError):
            warc.reassemble(broken)
    assert warc.unchunked(warc.chunked(b"")) == b"" and warc.unchunked(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"


def test_chat(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", None), (1, 3, "ann", "Bye"), (2, 0, None, "?"), (None, 0, "ann", "x"), (3, 0, "system", "alone")]
    frame = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, name string")
    got = chat.rotate(frame)
    assert got.count() == 4 * 2 + 1 + 1
    whole = {(r.conv_id, r.participant): r for r in chat.assemble(got).collect()}
    ann = whole[1, "ann"]
    assert [ann.dialogue[m.start : m.end] for m in ann.masks] == ["Hi", "Bye"]
    assert ann.dialogue.startswith("<|turn|>system\nBe kind.<|end|>\n<|turn|>assistant\nHi<|end|>\n<|turn|>user|bob\n<|end|>\n")
    assert [m.start for m in whole[1, "bob"].masks] and (2, "unknown") in whole
    assert chat.rotate(frame.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["the", "stove", "burns", "dry", "wood", "and", "water", "boils", "fast", f"x{rng.randint(0, 400)}"]) for _ in range(n)) + "."
    passage, near = say(120), say(200)
    texts = [say(rng.randint(30, 260)) for _ in range(40)] + [near, near + " again", say(30) + " " + passage + " " + say(30), say(20) + " " + passage, "", None]
    texts += ["BUY NOW!! " * 40] * 20
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 40), 0) for i in [*range(40), *range(46, 66)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        new = shared.kept(stage(spark, docs, str(tmp_path)), name)
        seen.append(new)
        if name != "packing":
            assert new.columns == docs.columns
        docs = new
    good = {r.doc_id for r in seen[0].collect()}
    assert set(range(40)) <= good and not good & set(range(46, 66))
    assert (good - {r.doc_id for r in seen[1].collect()}) == {41}
    left = {r.doc_id: r for r in seen[2].collect()}
    assert passage not in left[42].text and left[42].n_chars == len(left[42].text) and left[0].text == texts[0]
    assert {r.doc_id for r in seen[3].collect()} == set(left)
