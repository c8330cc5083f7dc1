"""Corpora that the queries run on, derived from the driver's tables.

`documents` has no blank lines, headings or pages, so each corpus brings out what
an operator is about. All are maps, but for the pages of a book.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that end in a line end."""
    return _texts(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\n")))


def spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line a paragraph."""
    return _texts(spark, sf_dir).withColumn("text", F.concat(F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n")))


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading before every fourth line: three Markdown levels, a dashed and a numbered one in turn."""
    k = lambda i: F.floor(i / 4).cast("int")
    title = lambda i: (
        F.when(k(i) % 5 == 0, F.concat(F.lit("# Part "), k(i).cast("string")))
        .when(k(i) % 5 == 1, F.concat(F.lit("## Topic "), k(i).cast("string")))
        .when(k(i) % 5 == 2, F.concat(F.lit("### Detail "), k(i).cast("string")))
        .when(k(i) % 5 == 3, F.lit("---Field notes---"))
        .otherwise(F.concat(F.lit("2."), k(i).cast("string"), F.lit(" Topic")))
    )
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 4 == 0, F.concat(title(i), F.lit("\n"), x)).otherwise(x))
    return _texts(spark, sf_dir).withColumn("text", F.concat(F.array_join(lines, "\n"), F.lit("\n")))


#: Openings with headings that only layout tells, and lines that look like some. Each ends in two lines of prose.
OPENINGS = (
    "Field Manual\n\nThis is some prose here. It goes on.\n\nPLACEBO\n\nMore prose stands here. It ends.\n\nSAFETY RULES\n\nKeep the stove dry. It may rust.\n\nSetting Up\n\nFirst Steps\n\nOpen the legs first. Then wait.\n\nAnd so it goes on.\n",
    "Some prose is here. It ends.\n\nTABLE OF RESULTS\n\n(N = 12)\n\n45%\n\nMill Road\n\nSee 4 for doses and\n\nReal Subheading\n\nThis prose follows it. It ends.\n\nThere is one more line.\n",
    "A closing sentence stands here.\nHow should I store it?\n\nKeep it in a dry place. Do not freeze it.\n\nWhat else is there?\n\nNothing else is there. It ends.\n\nThat is all of it.\n",
    "Plain Title\n===========\n\nThe text is set out here. It ends.\n\n2.1 Doses\n-\nTake one a day. Then rest.\n\nData\n\nAnimal Data\n\nRats were given some. They lived.\n\nThat is all of it.\n",
    "3 Harm\n\nText is here now. It ends.\n\nGRH0434v1\n\nNotes\n\n3.1 Trials\n\nThe trials went well. They ended.\n\nRevised: 08/2025\n\nPatient Information\n\nACME (ak-me)\n(widget)\n\nthe end of it all.\n",
    "one line goes on\n\nWidget Parts\n\nplain words without an end\n\nTrailhead 2 Tent\n\nPlacebo 8 8 2 5\n\nIt is done now.\n\nClosing Words\n\nYou can use the following items in any order:\n\nthese and those.\n",
)


def guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in one paragraph, each after one of the openings in turn."""
    opening = F.get(F.array(*map(F.lit, OPENINGS)), F.pmod("doc_id", F.lit(len(OPENINGS))).cast("int"))
    body = F.regexp_replace(F.col("text"), f"{P.WS}+", " ")
    return _texts(spark, sf_dir).withColumn("text", F.concat(opening, F.lit("\nBody of "), body, F.lit(" ends.\n")))


def untidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with carriage returns, tabs, trailing blanks and runs of blank lines."""
    return _texts(spark, sf_dir).withColumn("text", F.concat(F.lit("\t"), F.replace("text", F.lit("\n"), F.lit(" \xa0 \r\n\r\n\r\n\n")), F.lit("\r \n")))


def hyphenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every space after a word that ends in `t`, `n` or `e` a split word."""
    return _texts(spark, sf_dir).withColumn("text", F.regexp_replace("text", "([a-z])([tne]) ([a-z])", "$1$2-\n$3"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book for each source and block of 64 documents, a page for each document, with running footers."""
    rows = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.floor(F.col("doc_id") / 64).cast("string")).alias("doc_id"), F.col("doc_id").alias("at"), F.coalesce("text", F.lit("")).alias("text"))
    book = Window.partitionBy("doc_id")
    numbered = rows.withColumn("page_no", F.row_number().over(book.orderBy("at"))).withColumn("n", F.count("*").over(book))
    foot = F.concat(F.lit("\nReference ID: 777\nPage "), F.col("page_no").cast("string"), F.lit(" of "), F.col("n").cast("string"))
    return numbered.select("doc_id", "page_no", F.concat("text", foot).alias("text"))


#: Benchmark items that a document meets in one row.
BLOCK = 512


def questions(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """question_id, doc_id, question, ans_start, ans_end: benchmark passages and the documents that hold them.

    Every document meets every passage, in rows of at most BLOCK passages; documents
    aren't shuffled as long as the passages are few enough to be broadcast.
    """
    bench = table(spark, sf_dir, "benchmark").where("text is not null").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    block = F.floor(F.monotonically_increasing_id() / BLOCK)
    asked = bench.withColumn("block", block).groupBy("block").agg(F.collect_list(F.struct("question_id", "question")).alias("asked")).drop("block")
    found = docs.crossJoin(asked).select("doc_id", "text", F.explode(F.filter("asked", lambda q: F.contains("text", q["question"]))).alias("q"))
    start = F.instr("text", F.col("q.question")) - 1
    return found.select("q.question_id", "doc_id", "q.question", start.alias("ans_start"), (start + F.least(F.length("q.question"), F.lit(250))).alias("ans_end"))
