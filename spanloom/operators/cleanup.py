"""Cleaning up text that comes from pages: running lines, split words, lost paragraph breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import blank, let, rstrip, strip

EDGE = 3


def line_key(line: Column) -> Column:
    """What makes two lines the same running line; short ones are equal whatever their numbers."""
    s = F.lower(strip(line))
    return F.when(F.length(s) <= 40, F.regexp_replace(s, r"\p{Nd}+", "#")).otherwise(s)


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, line, at_edge, key) of pages (doc_id, page_no, text).

    Whether a line is at a page's edge comes from the page's own lines, without a shuffle.
    """
    lines = F.split("text", "\n", -1)
    filled = F.filter(F.transform("lines", lambda x, i: F.when(~blank(x), i)), lambda i: i.isNotNull())
    edge = F.concat(F.slice("filled", F.lit(1), F.lit(EDGE)), F.slice(F.reverse("filled"), F.lit(1), F.lit(EDGE)))
    out = pages.withColumn("lines", lines).withColumn("filled", filled).withColumn("edge", edge)
    out = out.select("doc_id", "page_no", "edge", F.posexplode("lines").alias("line_no", "line"))
    return out.select("doc_id", "page_no", "line_no", "line", F.array_contains("edge", F.col("line_no")).alias("at_edge"), line_key(F.col("line")).alias("key"))


def running_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, key, pages) of keys at the edge of enough pages; documents of fewer than three pages have none."""
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("total"))
    keys = page_lines(pages).where("at_edge and key <> ''").select("doc_id", "page_no", "key").distinct()
    found = keys.groupBy("doc_id", "key").agg(F.count("*").alias("pages")).join(counts, "doc_id")
    return found.where((F.col("total") >= 3) & (F.col("pages") >= F.greatest(F.lit(3), F.floor(F.col("total") / 4)))).select("doc_id", "key", "pages")


def strip_running_lines(pages: DataFrame) -> DataFrame:
    """Pages without their running lines: (doc_id, page_no, text)."""
    running = running_lines(pages).select("doc_id", "key", F.lit(True).alias("running"))
    lines = page_lines(pages).join(running, ["doc_id", "key"], "left").where(~(F.col("at_edge") & F.coalesce("running", F.lit(False))))
    texts = lines.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    texts = texts.select("doc_id", "page_no", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    return pages.select("doc_id", "page_no").join(texts, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.coalesce("text", F.lit("")).alias("text"))


def rejoin_hyphens(text: Column) -> Column:
    """Words split at a line's end put together, with the hyphen where the text shows a compound.

    The text is taken apart at the split words and put together again; whether a
    word occurs is looked up in an array of the words outside the splits.
    """
    pattern = F.lit(P.HYPHEN_SPLIT)
    between = F.split(text, P.HYPHEN_SPLIT, -1)
    left, right = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))
    known = F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(text, P.HYPHEN_SPLIT, " ")), F.lit("[a-z]+"), F.lit(0)))
    flat = F.lower(F.replace(text, F.lit("-\n"), F.lit("-")))

    def joined(v: Column, a: Column, b: Column) -> Column:
        low_a, low_b = F.lower(a), F.lower(b)
        lower = a.rlike(r"\A\p{L}+\z") & b.rlike(r"\A\p{L}+\z") & (a == low_a) & (b == low_b)
        form = F.concat(low_a, F.lit("-"), low_b)
        often = (F.length(v["flat"]) - F.length(F.replace(v["flat"], form, F.lit("")))) / F.length(form) > 1
        apart = ~F.array_contains(v["known"], F.concat(low_a, low_b)) & F.array_contains(v["known"], low_a) & F.array_contains(v["known"], low_b)
        return F.when(~lower | often | apart, F.concat(a, F.lit("-"), b)).otherwise(F.concat(a, b))

    def whole(v: Column) -> Column:
        fixed = F.concat(F.zip_with(v["left"], v["right"], lambda a, b: joined(v, a, b)), F.array(F.lit("")))
        return F.array_join(F.flatten(F.zip_with(v["between"], fixed, lambda x, y: F.array(x, y))), "")

    facts = F.struct(between.alias("between"), left.alias("left"), right.alias("right"), known.alias("known"), flat.alias("flat"))
    return F.when(text.rlike(P.HYPHEN_SPLIT), let(facts, whole)).otherwise(text)


def full_line(lengths: Column) -> Column:
    """Eighth decile cut of an array of lengths, by the exclusive method."""

    def at(x: Column) -> Column:
        n = F.size(x)
        j = F.least(F.greatest(F.floor(8 * (n + 1) / 10), F.lit(1)), n - 1).cast("int")
        d = 8 * (n + 1) - 10 * j
        return (F.get(x, j - 1) * (10 - d) + F.get(x, j) * d) / 10

    return let(F.array_sort(lengths), at)


def infer_paragraphs(text: Column) -> Column:
    """Blank lines put in after lines that look like a paragraph's last, in a text that has next to none."""

    def with_break(x: Column, following: Column, full: Column) -> Column:
        s, nxt = rstrip(x), strip(following)
        ends = lambda c, chars: c.rlike(rf"[{chars}]\z")
        short = F.length(s) < 0.75 * full
        sentence = s.rlike("(?:[.!?:]|\\.\"|\\.”)\\z")
        capital = nxt.rlike(r"\A\p{Lu}")
        heading = F.length(s).between(1, 59) & ~ends(s, ".,;") & capital
        before_heading = F.length(nxt).between(1, 59) & capital & ~ends(nxt, ".,;:!?")
        breaks = (s != "") & (nxt != "") & ((short & (sentence | heading)) | (sentence & before_heading))
        return F.when(breaks, F.concat(x, F.lit("\n"))).otherwise(x)

    def broken(v: Column) -> Column:
        nexts = F.concat(F.slice(v["lines"], F.lit(2), F.greatest(F.size(v["lines"]), F.lit(1))), F.array(F.lit("")))
        return let(full_line(v["filled"]), lambda full: F.array_join(F.zip_with(v["lines"], nexts, lambda x, y: with_break(x, y, full)), "\n"))

    def result(v: Column) -> Column:
        plain = (F.size(v["filled"]) < 10) | ((F.size(v["lines"]) - F.size(v["filled"])) / F.size(v["lines"]) > 0.05)
        return F.when(plain, text).otherwise(broken(v))

    filled = lambda lines: F.transform(F.filter(lines, lambda x: ~blank(x)), F.length)
    return let(F.split(text, "\n", -1), lambda lines: let(F.struct(lines.alias("lines"), filled(lines).alias("filled")), result))


def pages_to_documents(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_no, text; a null text is empty) as one document each, cleaned up."""
    pages = pages.select("doc_id", "page_no", F.coalesce("text", F.lit("")).alias("text"))
    kept = strip_running_lines(pages).withColumn("text", strip(F.col("text"))).where("text <> ''")
    docs = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    docs = pages.select("doc_id").distinct().join(docs, "doc_id", "left")
    text = F.array_join(F.transform(F.coalesce("p", F.array().cast("array<struct<page_no:int,text:string>>")), lambda x: x["text"]), "\n\n")
    docs = docs.select("doc_id", text.alias("text")).withColumn("text", rejoin_hyphens(F.col("text")))
    return docs.withColumn("text", infer_paragraphs(F.col("text")))


__all__ = ["full_line", "infer_paragraphs", "line_key", "page_lines", "pages_to_documents", "rejoin_hyphens", "running_lines", "strip_running_lines"]
