"""Cases where an operator used to do less than the whole job, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_documents import removed, sets

from spanloom.llm import minhash, packing, shared, suffix_dedup


def say(rng, n):
    return " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))


def edited(text, places):
    return " ".join(f"new{k}" if k in places else w for k, w in enumerate(text.split()))


def near_components(rows, percent):
    """The smallest id linked with each id of (id, text) rows, by the sets of all pairs."""
    s = {i: sets(t) for i, t in rows}
    label = {i: i for i in s}
    links = [(a, b) for a in s for b in s if a < b and s[a] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    for _ in s:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def near_rows():
    rng = random.Random(4)
    base = [say(rng, 200) for _ in range(12)]
    # four single words far from each other: 176 of 216 shingles, 0.81
    return [(2 * k + half, edited(t, {20, 70, 120, 170}) if half else t) for k, t in enumerate(base) for half in (0, 1)]


def test_near_copies_stage_links_from_80_percent(spark):
    import corpus_pipeline

    rows = near_rows()
    a, b = (sets(t) for _, t in rows[:2])
    assert (len(a & b), len(a | b)) == (176, 216)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i for i, c in near_components(rows, 80).items() if i == c}
    assert len(want) == 12
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()} == want
    assert {r.doc_id for r in minhash.link(docs).where("kept").collect()} == {i for i, _ in rows}


def byte_strings(rows):
    """(id, bytes, removed, digest of what is left) of (id, text) rows."""
    contents = [(t or "").encode() for _, t in rows]
    gone = removed(contents, 400)
    return Counter((i, len(t), int(g.sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~g].tobytes()).hexdigest()) for (i, _), t, g in zip(rows, contents, gone, strict=True))


def test_byte_strings_of_rows_without_ids_and_with_equal_ids(spark):
    rng = random.Random(6)
    passage, other = say(rng, 150), say(rng, 110)
    rows = []
    for i in (None, 7):
        rows += [(i, passage + " " + say(rng, 10)), (i, say(rng, 20)), (i, say(rng, 90) + " " + other), (i, other + " " + say(rng, 300)), (i, say(rng, 40) + " " + passage), (i, None), (i, "")]
        rows += [(i, say(rng, rng.randint(1, 500))) for _ in range(8)]
    rows += [(i, say(rng, 80) + " " + passage) for i in range(20, 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.digests(docs).collect())
    assert got == byte_strings(rows)


def test_rows_without_ids_are_dealt_over_shards(spark):
    rng = random.Random(7)
    docs = spark.createDataFrame([(None, say(rng, 9)) for _ in range(200)], "doc_id long, text string")
    by = suffix_dedup.keyed(docs, 64).groupBy(suffix_dedup.SHARD).count().collect()
    assert len(by) > 40 and max(r["count"] for r in by) < 20


@pytest.mark.parametrize("size", [337, 338, 350, 399, 400, 401])
def test_one_short_periodic_text(size):
    text = (b"spam " * 100)[:size]
    part = np.frombuffer(text, np.uint8), np.array([0, size])
    ((first, last),) = suffix_dedup.repeated_starts([part], [])
    assert (suffix_dedup.K.covered(size, first, last + 400) == removed([text], 400)[0]).all()


def near_family(rng, n, words=60):
    """Texts that differ from one in up to a third of their places, so similarities lie all around the threshold."""
    base = say(rng, words)
    return [edited(base, {j: 0 for j in rng.sample(range(words), rng.randint(0, 6))}).replace("new", f"n{k}x") for k in range(n)]


@pytest.mark.parametrize("block", [7, 1024])
def test_large_mixed_buckets(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "ALIKE", -1000)  # leaves all the work to the blocks
    rng = random.Random(12)
    own = [*near_family(rng, 90), *near_family(rng, 40), *near_family(rng, 9)]
    rows = list(enumerate(own))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 85):
        want = near_components(rows, percent)
        assert len(set(want.values())) > 20
        assert {r.doc_id: r.component_id for r in minhash.link(docs, percent).collect()} == want


def test_rows_that_share_an_id(spark):
    rng = random.Random(13)
    a, b, c = (say(rng, 100) for _ in range(3))
    rows = [(7, a), (7, b), (9, b + " more"), (3, a + " again"), (8, c), (8, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in minhash.link(docs).collect())
    assert got == [(3, 3), (7, 3), (7, 7), (8, 8), (8, 8), (9, 7)]


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """The rows of each stage but the fitted classifier's, from its own input."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(9)
    passage = say(rng, 55)  # under 400 bytes
    near = [t for _, t in near_rows()]
    own = [*near, near[0] + " again", *(say(rng, 20) + " " + passage + " " + say(rng, k) for k in (0, 9, 60)), *(say(rng, rng.randint(1, 300)) for _ in range(20)), "", None]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(own)], columns)
    stages, rows = dict(corpus_pipeline.STAGES), {i: t for i, t in enumerate(own)}

    def step(name, frame):
        return shared.kept(stages[name](spark, frame, str(tmp_path)), name)

    docs = step("near_copies", docs)
    rows = {i: rows[i] for i, c in near_components(rows.items(), 80).items() if i == c}
    assert len(rows) == len(own) - 13
    assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter(rows.items())

    docs = step("repeated_passages", docs)
    contents = [(t or "").encode() for t in rows.values()]
    gone = removed(contents, corpus_pipeline.PASSAGE)
    assert sum(g.any() for g in gone) >= 3
    rows = {i: np.frombuffer(t, np.uint8)[~g].tobytes().decode() for i, t, g in zip(rows, contents, gone, strict=True)}
    assert Counter((r.doc_id, r.text, r.n_chars) for r in docs.collect()) == Counter((i, t, len(t)) for i, t in rows.items())

    got, want = step("packing", docs).collect(), Counter()
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in rows.items():
        ids = [*tokens.encode(t, add_special_tokens=False).ids, 2]
        for k, (a, n) in enumerate(packing.cuts(len(ids))):
            want[i, k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


NAMES = "`doc_id` long, `text` string, `quality_score` double, `shard` int, `mark` long, `label` string, `id` long, `_suffix_dedup_key` int"


@pytest.mark.parametrize("name", ["quality", "near_copies", "repeated_passages"])
def test_stages_keep_columns_of_any_name(spark, tmp_path, name):
    import corpus_pipeline

    rng = random.Random(21)
    spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    passage = say(rng, 60)
    texts = [None, "", say(rng, 80), say(rng, 30) + " " + passage, passage + " " + say(rng, 9), say(rng, 30000), "x" * 300_000, "a b " * 70_000]
    rows = [(i if i else None, t, 0.25, i, -i, str(i), 5, None) for i, t in enumerate(texts)]
    rows += [rows[2], rows[0]]
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, spark.createDataFrame(rows, NAMES), str(tmp_path))
    assert got.columns == ["doc_id", "text", "quality_score", "shard", "mark", "label", "id", "_suffix_dedup_key"]
    kept = {(r.doc_id, r.quality_score, r.shard, r.mark, r.label, r.id) for r in got.collect()}
    assert kept <= {(r[0], *r[2:7]) for r in rows} and (name == "quality" or len(kept) == len(texts))
    assert stage(spark, spark.createDataFrame([], NAMES), str(tmp_path)).count() == 0


def test_near_copies_stage_tells_rows_of_one_id_apart(spark):
    import corpus_pipeline

    rng = random.Random(22)
    a, b = say(rng, 100), say(rng, 100)
    docs = spark.createDataFrame([(7, a), (7, b), (3, a + " again")], "doc_id long, text string")
    got = corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(7, b), (3, a + " again")])


def test_an_empty_corpus_goes_through(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_threshold_and_labels(spark):
    from spanloom.llm import quality

    good, bad = np.array([1.0, 2.0, 3.0]), np.array([-3.0, -1.0, 2.5])
    # half are bad: the third smallest of six, and half way to the fourth
    assert quality.threshold(good, bad, 0.5) == (1.0 + 2.0) / 2
    # nine in ten are bad: all bad ones and the smaller good ones lie under it
    assert quality.threshold(good, bad, 0.9) > 2.0
    rng = random.Random(5)
    rows = [(i, say(rng, 40) if i % 2 else "BUY! " * 30) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)]
    want = quality.fit(docs, spark.createDataFrame([x for x in labels if x[0] > 9], "doc_id long, quality int"))
    both = [*labels, *((i, 1 - i % 2) for i in range(10))]
    got = quality.fit(docs, spark.createDataFrame(both, "doc_id long, quality int"))
    assert all(np.allclose(want[k], got[k]) for k in want)


@pytest.mark.parametrize("share", [0.2, 0.7])
def test_quality_learns_from_all_labelled_rows(spark, share):
    from spanloom.llm import kernels, quality

    rng = random.Random(31)
    # more rows of each label than were once learned from
    rows = [(i, " ".join(rng.choice(["dry", "Wood", "BUY", "now!", "x1", "stove."]) for _ in range(rng.randint(1, 9)))) for i in range(33_000)]
    labels = [(i, int(rng.random() > share)) for i in range(33_000)]
    got = quality.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame(labels, "doc_id long, quality int"))
    taught = [i for i in range(33_000) if zlib.crc32(str(i).encode()) % 3 != 1]
    x = quality.features(*kernels.text_bytes(pa.array([rows[i][1] for i in taught])))
    y = np.array([labels[i][1] for i in taught])
    assert min((y == 1).sum(), (y == 0).sum()) > 4000
    assert np.allclose(got["mean"], x.mean(0)) and np.allclose(got["scale"], np.where(x.std(0) > 1e-9, x.std(0), 1))
    z = np.clip((x - got["mean"]) / got["scale"], -8, 8)
    w, least = quality.bradley_terry(z[y == 1], z[y == 0])
    assert np.allclose(got["weights"], w, atol=1e-6) and np.isclose(got["threshold"], least, atol=1e-6)


def test_bradley_terry_against_gradient_descent():
    from spanloom.llm import quality

    rng = np.random.default_rng(6)
    good, bad = rng.normal(0.4, 1, (40, 3)), rng.normal(0, 1, (25, 3))
    w, _ = quality.bradley_terry(good, bad)
    n = 40 * quality.RIVALS
    d = np.array([good[i % 40] - bad[(i + i // 40) % 25] for i in range(n)])
    own = np.zeros(3)
    for _ in range(20000):
        own += 0.5 * (d.T @ (1 / (1 + np.exp(d @ own))) / n - 1e-3 * own)
    assert np.allclose(w, own, atol=1e-6)


def test_a_small_table_is_packed_as_one(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, say(rng, 60)) for i in range(64)] + [(None, None)] * 300, "doc_id long, text string")
    got = packing.pack(docs, path).collect()
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= 1 - -total // 1024
    dealt = packing.place(packing.pieces(docs, path), 8).collect()
    assert len({r.sequence_id >> 36 for r in dealt if r.doc_id is None}) == 8


def test_tokenizer_files_whose_ids_are_not_ranks():
    from spanloom.llm import tokens

    assert tokens._merges_are_ranks({"vocab": {"a": 0, "b": 1, "ab": 2, "abb": 3}, "merges": ["a b", ["ab", "b"]]})
    assert not tokens._merges_are_ranks({"vocab": {"a": 0, "b": 1, "ab": 3, "abb": 2}, "merges": ["a b", "ab b"]})
