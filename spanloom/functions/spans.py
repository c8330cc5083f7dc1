"""Spans of a text as array columns: chunk rules that need no shuffle.

A span is a half-open range of code points. Every function works on one row's
text, so chunking is a map: whatever the number of documents, nothing moves.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import blank, let, lstrip, strip

SPANS = "array<struct<start:int,end:int>>"


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def cut(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def trim(text: Column, spans: Column) -> Column:
    """Spans without outer white space; empty ones go."""

    def one(s: Column) -> Column:
        piece = F.struct(s["start"].alias("at"), cut(text, s).alias("p"))
        sized = lambda x: let(F.struct((x["at"] + F.length(x["p"]) - F.length(lstrip(x["p"]))).alias("a"), F.length(strip(x["p"])).alias("n")), lambda y: _span(y["a"], y["a"] + y["n"]))
        return let(piece, sized)

    return F.filter(F.transform(spans, one), lambda s: s["end"] > s["start"])


def fixed(text: Column, size: int = P.SIZE, overlap: int = P.OVERLAP) -> Column:
    """A span every size - overlap characters, up to the first that reaches the end; blank ones go."""
    if size <= 0:
        raise ValueError("size must be positive")
    step = size - max(0, min(overlap, size - 1))
    n = F.length(text)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s - step + size < n))
    return F.filter(F.transform(starts, lambda s: _span(s, F.least(s + size, n))), lambda s: ~blank(cut(text, s)) & (s["end"] > s["start"]))


def _running(lengths: Column) -> Column:
    """Running totals of an array of lengths."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda z, x: F.struct((z["at"] + x).alias("at"), F.array_append(z["out"], z["at"] + x).alias("out"))
    return F.aggregate(lengths, start, step, lambda z: z["out"])


def paragraphs(text: Column) -> Column:
    """Trimmed spans of blocks between blank lines."""
    parts = F.split(text, P.BLANK_LINES, -1)
    gaps = F.regexp_extract_all(text, F.lit(P.BLANK_LINES), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    sized = F.zip_with(parts, gaps, lambda p, g: F.struct(F.length(p).alias("n"), F.coalesce(F.length(g), F.lit(0)).alias("gap")))
    step = lambda z, x: F.struct((z["at"] + x["n"] + x["gap"]).alias("at"), F.array_append(z["out"], _span(z["at"], z["at"] + x["n"])).alias("out"))
    return trim(text, F.aggregate(sized, start, step, lambda z: z["out"]))


def sentence_ends(piece: Column) -> Column:
    """Places where a sentence, with the white space after it, ends; the last is the piece's end."""
    return _running(F.transform(F.regexp_extract_all(piece, F.lit(P.SENTENCES), F.lit(0)), F.length))


def split_long(text: Column, spans: Column, most: Column) -> Column:
    """Spans of at most `most` characters: whole sentences packed greedily, longer ones cut."""

    def one(s: Column) -> Column:
        shape = "struct<cur:int,fit:int,out:array<struct<start:int,end:int>>>"
        start = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("fit"), F.array().cast(SPANS).alias("out")).cast(shape)

        def step(z: Column, b: Column) -> Column:
            fits = b - z["cur"] <= most
            packed = F.when(z["fit"] > z["cur"], F.array_append(z["out"], _span(z["cur"], z["fit"]))).otherwise(z["out"])
            begin = F.greatest(z["cur"], z["fit"])
            return F.when(fits, F.struct(z["cur"].alias("cur"), b.alias("fit"), z["out"].alias("out")).cast(shape)).otherwise(
                let(F.struct(packed.alias("packed"), begin.alias("begin"), F.greatest(F.lit(0), F.floor((b - begin - 1) / most)).cast("int").alias("cuts")), lambda v: over(v, b))
            )

        def over(v: Column, b: Column) -> Column:
            begin, cuts = v["begin"], v["cuts"]
            whole = F.when(cuts > 0, F.transform(F.sequence(F.lit(0), F.greatest(cuts - 1, F.lit(0))), lambda i: _span(begin + i * most, begin + (i + 1) * most))).otherwise(F.array().cast(SPANS))
            return F.struct((begin + cuts * most).alias("cur"), b.alias("fit"), F.concat(v["packed"], whole).alias("out")).cast(shape)

        total = s["end"] - s["start"]
        done = lambda z: F.when(z["cur"] < total, F.array_append(z["out"], _span(z["cur"], total))).otherwise(z["out"])
        parts = F.aggregate(sentence_ends(cut(text, s)), start, step, done)
        shifted = F.transform(parts, lambda x: _span(x["start"] + s["start"], x["end"] + s["start"]))
        return F.when(total <= most, F.array(_span(s["start"], s["end"]))).otherwise(trim(text, shifted))

    return F.flatten(F.transform(spans, one))


def pack(spans: Column, budget: Column) -> Column:
    """Neighbouring spans joined while the whole, gaps too, keeps to the budget."""
    start = F.array().cast(SPANS)

    def step(z: Column, x: Column) -> Column:
        last = F.try_element_at(z, F.lit(-1))
        joins = last.isNotNull() & (x["end"] - last["start"] <= budget)
        return F.when(joins, F.array_append(F.slice(z, F.lit(1), F.size(z) - 1), _span(last["start"], x["end"]))).otherwise(F.array_append(z, _span(x["start"], x["end"])))

    return F.aggregate(spans, start, step)


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return overlap(s1, e1, s2, e2) / F.greatest(F.lit(1), e1 - s1, e2 - s2)


def same_passage(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (F.least(e1 - s1, e2 - s2) >= P.SHORT_CHARS) & (overlap_ratio(s1, e1, s2, e2) >= P.SAME_PASSAGE)


def contains_answer(s: Column, e: Column, a: Column, z: Column) -> Column:
    shared = overlap(s, e, a, z)
    return (shared > 0) & (shared / F.greatest(F.lit(1), z - a) >= P.ANSWER_COVERED)
