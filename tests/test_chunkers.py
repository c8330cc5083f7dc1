import pytest
from pyspark.sql import functions as F

from spanloom.functions import spans as S
from spanloom.operators import chunkers, sections

MANUAL = "# Otter Stove\n\nA small stove.\n\n## Setting up\n\nOpen the legs. Put it on flat ground.\n\n### Fuel\n\nUse dry wood. Never use petrol.\n\n## Care\n\nLet it cool.\n"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_fixed_steps_back_and_stops_at_the_end(spark):
    rows = chunkers.fixed(docs(spark, "x" * 300), 100, 20).orderBy("chunk_index").collect()
    assert [r.start for r in rows] == [0, 80, 160, 240]
    assert rows[-1].end == 300


def test_fixed_drops_blank_pieces_and_empty_texts(spark):
    rows = chunkers.fixed(docs(spark, "ab" + " " * 200 + "cd", ""), 50, 0).collect()
    assert [(r.doc_id, r.chunk_index, r.start) for r in rows] == [(0, 0, 0), (0, 1, 200)]


def test_settings():
    with pytest.raises(ValueError):
        S.fixed(F.lit("x"), 0)
    for bad in ((49, 0, 1200), (500, 500, 1200), (500, 100, 199)):
        with pytest.raises(ValueError):
            chunkers.check_settings(*bad)


def test_paragraphs_split_at_sentences(spark):
    rows = chunkers.paragraph(docs(spark, " ".join(f"Sentence number {i} ends." for i in range(40))), 200).collect()
    assert len(rows) > 1 and all(len(r.text) <= 200 and r.text.endswith(".") for r in rows)


def test_a_sentences_trailing_space_counts(spark):
    text = "a" * 9 + "." + " " * 5 + "b" * 9 + "."
    rows = chunkers.paragraph(docs(spark, text), 12).collect()
    assert [r.text for r in rows] == ["a" * 9 + ".", "b" * 9 + "."]


def test_a_long_sentence_is_cut(spark):
    assert [len(r.text) for r in chunkers.paragraph(docs(spark, "y" * 450), 200).collect()] == [200, 200, 50]


def test_section_chunks_carry_their_path(spark):
    rows = chunkers.section(docs(spark, MANUAL)).orderBy("chunk_index").collect()
    fuel = next(r for r in rows if "petrol" in r.text)
    assert fuel.text.startswith("Otter Stove > Setting up > Fuel\n\n") and fuel.headers == ["Otter Stove", "Setting up", "Fuel"]
    assert MANUAL[fuel.start :].startswith("### Fuel")


def paths(spark, text):
    return [r.path for r in sections.sections(docs(spark, text)).orderBy("section_no").collect()]


def test_kinds_of_headings(spark):
    text = "Title One\n=====\nBody text here.\n\n1.2 Parts List\nBody text here.\n\nSAFETY RULES\nBody text is here.\n\nShort line\n\nIt is followed by prose. And more.\n"
    assert [p[-1] for p in paths(spark, text)] == ["Title One", "1.2 Parts List", "SAFETY RULES", "Short line"]


def test_only_neighbouring_guesses_nest(spark):
    text = "First Part\n\nSecond Part\n\nThis is some prose here. It goes on.\n\nThird Part\n\nThis is more prose here. It ends.\n"
    assert paths(spark, text) == [["First Part"], ["First Part", "Second Part"], ["Third Part"]]


def test_numbered_headings_leave_unnumbered_ones(spark):
    text = "6 Harm\n\nText is here.\n\n6.1 Trials\n\nText is here.\n\nTABLE OF RESULTS\n\nText is here.\n\n6.2 Defence\n\nText is here.\n"
    assert paths(spark, text)[-1] == ["6.2 Defence"] or paths(spark, text)[-1][0].startswith("6 ")
    assert "TABLE OF RESULTS" not in paths(spark, text)[-1]


def test_guesses_are_pruned_in_order(spark):
    text = "A closing sentence.\n\nGr1x\n\nPatient Information\n\nACME (ak-me)\n(widget)\n"
    assert ["Patient Information"] in paths(spark, text)


def test_labels_and_addresses_are_no_headings(spark):
    text = "Some prose is here. It ends.\n\nPLACEBO\n\n(N = 12)\n\n45%\n\nMill Road\n\nSee 4 for doses and\n\nReal Subheading\n\nThis prose follows it. It ends.\n"
    assert [p for p in paths(spark, text) if p] == [["Real Subheading"]]


def test_one_character_underline_is_passed_over(spark):
    rows = sections.sections(docs(spark, "1.2 Title Here\n-\nBody is here.\n")).collect()
    assert rows[0].body[0].start == len("1.2 Title Here\n-\n")


def test_section_at(spark):
    tree = sections.section_starts(sections.sections(docs(spark, "intro text.\n\n" + MANUAL)))
    places = spark.createDataFrame([(0, 0), (0, 13), (0, 60), (9, 5)], "doc_id long, pos int")
    got = {(r.doc_id, r.pos): r.section for r in sections.section_at(places, tree).collect()}
    assert got[0, 0] == [] and got[0, 13] == ["Otter Stove"] and got[9, 5] == []
