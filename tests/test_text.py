import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import cleanup
from spanloom.sources import documents


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first().x


def test_normalize(spark):
    assert one(spark, "\r\n a\tb \xa0\r\nc\r\n\r\n\r\n\r\nd \n", T.normalize) == "a    b\nc\n\nd\n"


def test_fingerprint(spark):
    assert one(spark, "abc", T.fingerprint) == "ba7816bf8f01cfea"


@pytest.mark.parametrize(
    ("text", "start", "flag"),
    [("One ends. Two goes on.", 10, False), ("One word here", 5, True), ("Title\n\nbody text", 7, False), ("see this:\n- item", 10, False), ("He said (1 mL) then went", 15, True), ("the carton.) then more", 13, False), ("a b    c", 3, False), ("abc", 0, False)],
)
def test_starts_mid_sentence(spark, text, start, flag):
    assert one(spark, text, lambda t: T.starts_mid_sentence(t, F.lit(start))) is flag


@pytest.mark.parametrize(("text", "end", "flag"), [("One ends. Two.", 9, False), ("One word here", 6, True), ("A title\n\nbody", 7, False), ("some words\nGo on", 10, False), ("some words go", 13, False)])
def test_ends_mid_sentence(spark, text, end, flag):
    assert one(spark, text, lambda t: T.ends_mid_sentence(t, F.lit(end))) is flag


@pytest.mark.parametrize(
    ("text", "flag"),
    [("12 34 56\n78 90 11", True), ("The tent weighs 2.1 kg and packs to 45 cm.", False), ("Dose group mean value\n12 34 56", False), ("Revised: 7/2025", False), ("C25 is fine", False)],
)
def test_unlabeled_numbers(spark, text, flag):
    assert one(spark, text, T.unlabeled_numbers) is flag


def test_flags_of_a_lone_heading(spark):
    text = "Some text is here.\n\nHeading\n\nMore text."
    assert one(spark, text, lambda t: T.chunk_flags(t, F.lit(20), F.lit(27))) == ["short"]


@pytest.mark.parametrize(("mean", "least", "verdict"), [(130, 8, "avg"), (150, 40, "avg"), (574, 24, "min"), (314, 207, None)])
def test_too_small(spark, mean, least, verdict):
    assert spark.range(1).select(T.too_small(F.lit(mean), F.lit(least)).alias("x")).first().x == verdict


@pytest.mark.parametrize(("lengths", "cut"), [(list(range(1, 12)), 9.6), (list(range(10, 101, 10)), 88.0)])
def test_exclusive_decile(spark, lengths, cut):
    assert spark.range(1).select(cleanup.full_line(F.array(*map(F.lit, lengths))).alias("x")).first().x == pytest.approx(cut)


def test_hyphens(spark):
    assert one(spark, "a subcuta-\nneous dose", cleanup.rejoin_hyphens) == "a subcutaneous dose"
    assert one(spark, "the Non-\nHDL value", cleanup.rejoin_hyphens) == "the Non-HDL value"
    assert one(spark, "patient care and safety: patient-\nsafety", cleanup.rejoin_hyphens) == "patient care and safety: patient-safety"


def test_running_lines(spark):
    rows = [(1, i, f"Body line number {'abcd'[i]}\nMiddle\nLast\nReference ID: 9\nPage {i + 1} of 4") for i in range(4)]
    out = cleanup.strip_running_lines(spark.createDataFrame(rows, "doc_id int, page_no int, text string")).collect()
    assert all("Reference" not in r.text and "Page" not in r.text and "Body" in r.text for r in out)
    two = cleanup.strip_running_lines(spark.createDataFrame(rows[:2], "doc_id int, page_no int, text string")).collect()
    assert all("Page" in r.text for r in two)


@pytest.mark.parametrize("text", ["café – naïve", "odd"])
def test_decoding(text):
    assert documents.decode_bytes(text.encode("cp1252")) == text
    assert documents.decode_bytes(text.encode("utf-16")) == text
    assert documents.decode_bytes(text.encode("utf-8-sig")) == text


def test_loading_files(spark):
    files = spark.createDataFrame([("a.TXT", bytearray(b"hi\r\n")), ("b.jpg", bytearray(b"x")), ("README", bytearray(b"plain")), ("c.txt", bytearray(bytes(range(256)) * 8)), ("d.md", bytearray(b" \n")), ("e.pdf", bytearray(b"%PDF"))], "name string, content binary")
    got = {r.name: (r.text, r.error) for r in documents.load(files).collect()}
    assert got["a.TXT"] == ("hi\n", None) and got["README"] == ("plain\n", None)
    assert all(got[n][0] is None and got[n][1] for n in ("b.jpg", "c.txt", "d.md", "e.pdf"))
    pages = documents.load(files.where("name = 'e.pdf'"), lambda f: f.select("name", F.lit(1).alias("page_no"), F.lit("From a page.").alias("text")))
    assert pages.first().text == "From a page.\n"
