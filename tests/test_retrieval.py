import pytest
from pyspark.sql import functions as F

from spanloom.functions import spans as S
from spanloom.operators import chunkers, compare, embedding, generation, retrieval, scoring, store
from spanloom.sources import answer_sets, samples

TEXT = "# Stove\n\nThe stove burns dry wood. It boils water fast. It folds flat for the way home, and it has three legs that lock.\n\n## Warranty\n\nThe warranty lasts two years. Keep the receipt for it. It covers the legs and the plate, but not the paint or rust.\n\n## Storage\n\nStore the stove dry over the winter. Clean it first. Leave the bag open so that the air can get at it while it stands there.\n" * 3


def test_buckets(spark):
    got = spark.range(1).select(embedding.hashed_words(F.lit("Warranty coverage two years receipt")).alias("h")).first().h
    assert got == [242, 363, 102, 119, 69]


def test_dense_vectors_agree_with_counts(spark):
    rows = spark.createDataFrame([(1, "two years two"), (2, "")], "id int, text string")
    got = {r.id: r.vector for r in embedding.HashedBag().embed(rows).collect()}
    assert got[1][102] == pytest.approx(2 / 5**0.5) and sum(x * x for x in got[1]) == pytest.approx(1) and not any(got[2])


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, 1, "How long is the warranty?", TEXT.index("The warranty"), TEXT.index("The warranty") + 29)], "question_id long, doc_id long, question string, ans_start int, ans_end int")
    hits = retrieval.retrieve(asked, chunkers.every(docs, 160, 20, 200)).persist()
    return docs, asked, hits


def test_ranks(found):
    rows = found[2].collect()
    assert {r.strategy for r in rows} == {"fixed", "paragraph", "section"} and all(1 <= r["rank"] <= 5 for r in rows)


def test_matches_are_symmetric_and_never_small(found):
    _, _, hits = found
    rows = {(r.strategy, r["rank"], r.other_strategy, r.other_rank) for r in compare.matches(hits).collect()}
    assert rows and rows == {(c, d, a, b) for a, b, c, d in rows}
    size = {(r.strategy, r["rank"]): r.end - r.start for r in hits.collect()}
    assert all(size[a, b] >= 100 for a, b, _, _ in rows)


def test_overlap(spark):
    def at(*x):
        return spark.range(1).select(S.overlap_ratio(*map(F.lit, x)).alias("r"), S.same_passage(*map(F.lit, x)).alias("s")).first()

    assert at(0, 10, 5, 20).r == pytest.approx(1 / 3) and at(0, 10, 10, 20).r == 0 and at(0, 100, 40, 50).r == pytest.approx(0.1)
    assert [at(*x).s for x in ((100, 122, 100, 420), (0, 400, 100, 420), (0, 1200, 1000, 1150))] == [False, True, False]


def test_contains_answer(spark):
    spans = [(0, 500), (110, 300), (125, 300), (80, 99)]
    assert [spark.range(1).select(S.contains_answer(F.lit(a), F.lit(b), F.lit(100), F.lit(140)).alias("x")).first().x for a, b in spans] == [True, True, False, False]


def test_evaluate(spark):
    ranks = spark.createDataFrame([("fixed", 1), ("fixed", 4), ("fixed", None), ("section", None)], "strategy string, answer_rank int")
    got = {r.strategy: r for r in scoring.evaluate(ranks).collect()}
    assert (got["fixed"].found, got["fixed"].total, got["fixed"].avg_rank, got["fixed"].mrr) == (2, 3, 2.5, 0.417)
    assert (got["section"].avg_rank, got["section"].mrr) == (None, 0.0)


def test_answers_are_ranked(found):
    _, asked, hits = found
    rows = scoring.answer_rank(hits, asked).collect()
    assert len(rows) == 3 and any(r.answer_rank for r in rows)


def test_fragments_and_segments(found):
    docs, _, hits = found
    small = compare.fragments(hits, docs).collect()
    assert all(r.end - r.start < 100 for r in small)
    rows = compare.segments(hits).orderBy("start").collect()
    assert all(a.end <= b.start for a, b in zip(rows, rows[1:]))


def test_cache(spark):
    texts = spark.createDataFrame([("m", "a"), ("m", "b"), ("m", "a")], "model string, text string")
    assert embedding.cache_misses(texts, texts.where("text = 'b'")).count() == 1
    assert embedding.cache_misses(texts, texts).count() == 0


def test_store_keeps_the_newest(spark):
    added = spark.createDataFrame([(i, i) for i in range(8)], "doc_id long, seq long")
    assert sorted(r.doc_id for r in store.newest(added).collect()) == [3, 4, 5, 6, 7]


def test_index_refuses_settings(spark):
    with pytest.raises(ValueError):
        store.index(spark.createDataFrame([(1, "x")], "doc_id long, text string"), size=10)


def test_generation(spark):
    rows = spark.createDataFrame([(1, 1, s, r, f"{s} text {r}") for s in ("fixed", "paragraph", "section") for r in (2, 1)], "question_id long, doc_id long, strategy string, rank int, text string")
    prompts = generation.passages(rows)
    assert prompts.where("strategy = 'fixed'").first().passages == "[1]\nfixed text 1\n\n[2]\nfixed text 2"
    said = generation.answers(prompts)
    assert generation.comparable(said).count() == 1
    refusing = generation.answers(prompts, lambda p: {"text": "x", "refused": p.startswith("[1]\nsection")})
    assert generation.comparable(refusing).count() == 0 and refusing.where("text is null").count() == 1


def test_quotes(spark):
    json = '{"agree": false, "summary": "s", "differences": [], "quotes": {"fixed": ["two years", "made up", ""], "paragraph": [], "section": []}}'
    rows = spark.createDataFrame([(1, 1, "It lasts two years.", "a", "b", json), (2, 1, "a", "b", "c", "{")], "question_id long, doc_id long, fixed string, paragraph string, section string, json string")
    got = {r.question_id: r for r in generation.checked(rows).collect()}
    assert got[1].quotes.fixed == ["two years"] and got[1].error is None


def test_answer_sets(spark, tmp_path):
    docs = spark.createDataFrame([(1, "d", TEXT)], "doc_id long, name string, text string").withColumn("fingerprint", F.substring(F.sha2("text", 256), 1, 16))
    items = spark.createDataFrame([(1, "q1", 0, 20), (1, "q2", 0, 300)], "doc_id long, question string, ans_start int, ans_end int")
    answer_sets.write(items, docs, str(tmp_path / "set"))
    got = {r.question: r.skipped for r in answer_sets.load(answer_sets.read(spark, str(tmp_path / "set")), docs).collect()}
    assert got == {"q1": False, "q2": True}
    other = docs.withColumn("fingerprint", F.lit("0" * 16))
    assert answer_sets.load(answer_sets.read(spark, str(tmp_path / "set")), other).count() == 0


def test_samples(spark):
    assert [len(r.questions) for r in samples.samples(spark).collect()] == [5, 5]


def test_stream(spark, tmp_path):
    from spanloom.streaming import ingest

    spark.createDataFrame([(1, TEXT)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    q = ingest.write_chunks(ingest.documents(spark, str(tmp_path / "in"), "doc_id long, text string"), str(tmp_path / "out"), str(tmp_path / "cp"), size=100, overlap=10)
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).select("strategy").distinct().count() == 3


def test_comparisons_tell_failures_in_their_rows(spark):
    import json

    from spanloom.operators import generation

    rows = [(k, 1, s, f"{s} says {k}", f"q{k}") for k in range(6) for s in ("fixed", "paragraph", "section")]
    given = spark.createDataFrame([*rows, (9, 1, "fixed", "alone", "q9")], "question_id long, doc_id long, strategy string, text string, question string")

    def model(question, answers):
        if question == "q1":
            return {"refused": True}
        if question == "q2":
            return {"truncated": True, "text": "{"}
        if question == "q3":
            raise ConnectionError("no line")
        if question == "q4":
            return {"text": "not JSON"}
        if question == "q5":
            raise generation.ModelError("no key", 401)
        return {"text": json.dumps({"agree": False, "summary": "s", "differences": [{"point": "p", "fixed": "a", "paragraph": "b", "section": "c"}], "quotes": {"fixed": ["says 0", "made up", ""], "paragraph": [], "section": ["section"]}})}

    got = {r.question_id: r for r in generation.comparisons(given, model).collect()}
    assert {k: r.status for k, r in got.items()} == {0: 200, 1: 502, 2: 502, 3: 503, 4: 502, 5: 401}
    assert got[0].error is None and got[0].quotes.fixed == ["says 0"] and got[0].differences[0].point == "p"
    assert all(got[k].error for k in range(1, 6)) and got[5].error == "no key"
    assert generation.status("json", ("SURELY_UNSET_KEY",), "m") == {"installed": True, "has_key": False, "model": "m"}


def test_model_embedder(spark):
    from spanloom.operators.embedding import ModelEmbedder

    own = ModelEmbedder("sizes", lambda: lambda texts: [[len(t), 1] for t in texts])
    rows = own.embed(spark.createDataFrame([("ab",), ("",)], "text string")).withColumn("n", own.tokens(F.col("text"))).collect()
    assert [(r.vector, r.n) for r in rows] == [([2.0, 1.0], 1), ([0.0, 1.0], 0)]


def test_cache_keeps_what_was_used_last(spark):
    from spanloom.operators import embedding

    frame = lambda rows: spark.createDataFrame(rows, "model string, text string, seq long")
    got = embedding.refresh_cache(frame([("m", "a", 1), ("m", "b", 2), ("m", "c", 3)]), frame([("m", "a", 4), ("n", "a", 5)]), 3).collect()
    assert [(r.model, r.text, r.seq) for r in got] == [("n", "a", 5), ("m", "a", 4), ("m", "c", 3)]


def test_a_paper_without_pages_has_an_error(spark):
    from spanloom.sources import documents

    files = spark.createDataFrame([("a.pdf", bytearray(b"one")), ("b.pdf", bytearray(b"two")), ("c.txt", bytearray(b"three"))], "name string, content binary")
    pages = lambda pdfs: pdfs.where("content = X'6F6E65'").select("name", F.lit(1).alias("page_no"), F.lit("Some text.").alias("text"))
    got = {r.name: (r.text, r.error) for r in documents.load(files, pages).collect()}
    assert got == {"a.pdf": ("Some text.\n", None), "b.pdf": (None, "no text in this file"), "c.txt": ("three\n", None)}
