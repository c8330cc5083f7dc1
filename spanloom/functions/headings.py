"""Headings of a text: rules for a line, in order, and what prunes the guesses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from . import prune
from .text import blank, let, rstrip, strip, words

HEADING = "struct<line:int,level:int,title:string,skips:boolean>"


def _numeric(ws: Column) -> Column:
    return F.filter(ws, lambda w: w.rlike(P.NUMERIC))


def data_numbers(ws: Column) -> Column:
    """Two or more numbers, or one that is exact: a table row rather than a heading."""
    found = _numeric(ws)
    return (F.size(found) >= 2) | F.exists(found, lambda w: w.rlike(P.EXACT_NUMBER))


VERDICT = "struct<level:int,title:string>"


def _said(level: Column, title: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), title.alias("title")).cast(VERDICT)


def classify(line: Column, following: Column, after_blank: Column) -> Column:
    """(level, title) of a line that looks like a heading, else null. `following` is null at the end."""
    return let(strip(line), lambda s: let(F.coalesce(strip(following), F.lit("")), lambda nxt: let(words(s), lambda ws: _classify(s, nxt, ws, following, after_blank))))


def _classify(s: Column, nxt: Column, ws: Column, following: Column, after_blank: Column) -> Column:
    first_word = F.regexp_extract(s, P.NUMBERED, 1)
    rest = F.regexp_extract(s, P.NUMBERED, 2)
    lone = after_blank & following.isNotNull() & (nxt == "") & s.rlike(r"\A\p{Lu}") & (F.length(s) <= 70)
    ends = lambda chars: s.rlike(rf"[{chars}]\z")
    is_numbered = (
        s.rlike(P.NUMBERED)
        & ~ends(".,;:")
        & (F.size(ws) <= 12)
        & ~data_numbers(F.slice(ws, F.lit(2), F.greatest(F.size(ws), F.lit(1))))
        & (after_blank | F.contains(first_word, F.lit(".")) | (F.upper(rest) == rest))
    )
    capitals = after_blank & (F.upper(s) == s) & (F.size(ws) <= 8) & (F.regexp_count(s, F.lit(r"\p{L}")) >= 3) & ~ends(".,;") & ~data_numbers(ws)
    short = lone & (F.size(ws) <= 9) & ~ends(".,;:!?") & ~s.rlike(r"\A[-*•\p{Nd}]") & ~data_numbers(ws)
    return (
        F.when((s == "") | (F.length(s) > 100), F.lit(None).cast(VERDICT))
        .when(s.startswith("#") & s.rlike(P.MARKDOWN), _said(F.length(F.regexp_extract(s, P.MARKDOWN, 1)), strip(F.regexp_extract(s, P.MARKDOWN, 2))))
        .when((F.length(nxt) >= 3) & nxt.rlike(P.UNDERLINE), _said(F.when(nxt.startswith("="), 1).otherwise(2), s))
        .when(s.rlike(P.DASHED), _said(F.lit(2), strip(F.regexp_extract(s, P.DASHED, 1))))
        .when(is_numbered, _said(F.regexp_count(first_word, F.lit(r"\.")) + 1, s))
        .when(capitals, _said(F.when(F.size(ws) >= 2, 1).otherwise(0), s))
        .when((lone & s.endswith("?")) | short, _said(F.lit(0), s))
    )


def marked(lines: Column) -> Column:
    """Headings that their own line marks: in Markdown, between dashes, or by a number with dots, whatever follows it.

    Nothing is guessed: neither what stands around a line nor other numbers on it count.
    `lines` are line texts without their ends.
    """

    def verdict(t: Column) -> Column:
        number, size = F.regexp_extract(t, P.NUMBERED, 1), F.length(strip(t))
        return (
            F.when(~t.rlike(r"\A[#=\-\p{Nd}]") | (size == 0) | (size > 100), F.lit(None).cast(VERDICT))
            .when(t.rlike(P.MARKDOWN), _said(F.length(F.regexp_extract(t, P.MARKDOWN, 1)), F.regexp_extract(t, P.MARKDOWN, 2)))
            .when(t.rlike(P.DASHED), _said(F.lit(2), F.regexp_extract(t, P.DASHED, 1)))
            .when(F.contains(number, F.lit(".")) & ~t.rlike(r"[.,;:]\z"), _said(F.regexp_count(number, F.lit(r"\.")) + 1, strip(t)))
        )

    entry = lambda f, i: F.struct(i.alias("line"), f["level"].alias("level"), f["title"].alias("title"), F.lit(False).alias("skips")).cast(HEADING)
    return F.filter(F.transform(lines, lambda t, i: let(verdict(t), lambda f: entry(f, i))), lambda x: x["level"].isNotNull())


def candidates(lines: Column) -> Column:
    """Headings found line by line, with what the line before has taken.

    `lines` are line texts. Lines are judged one by one; then a fold passes over a
    line that underlines the heading before.
    """
    judged = F.transform(lines, lambda here, i: let(F.struct(here.alias("here"), F.get(lines, i + 1).alias("next"), F.get(lines, i - 1).alias("before")), lambda x: _judge(x, i)))
    likely = F.filter(judged, lambda x: x["level"].isNotNull())
    shape = f"struct<skip:int,out:array<{HEADING}>>"
    start = F.struct(F.lit(-1).alias("skip"), F.array().cast(f"array<{HEADING}>").alias("out")).cast(shape)

    def step(z: Column, x: Column) -> Column:
        taken = F.struct(F.when(x["skips"], x["line"] + 1).otherwise(-1).alias("skip"), F.array_append(z["out"], x).alias("out")).cast(shape)
        return F.when(z["skip"] == x["line"], z).otherwise(taken)

    return F.aggregate(likely, start, step, lambda z: z["out"])


#: A line that isn't after a blank one is a heading only if it begins, or ends, like this, or has an underline.
_MAY_BE = rf"\A{P.WS}*(?:#|[-=]|\p{{Nd}})|\?{P.WS}*\z"


def _judge(x: Column, i: Column) -> Column:
    here, before = x["here"], x["before"]
    may_be = here.rlike(P.NOT_WS) & (before.isNull() | here.rlike(_MAY_BE) | blank(before) | F.coalesce(x["next"].rlike(_UNDERLINED), F.lit(False)))
    return F.when(may_be, _judged(x, i))


_UNDERLINED = rf"\A{P.WS}*(?:=+|-+){P.WS}*\z"


def _judged(x: Column, i: Column) -> Column:
    here, before = x["here"], x["before"]
    rescued = before.isNotNull() & rstrip(here).endswith("?") & rstrip(before).rlike(P.SENTENCE_OR_COLON_END)
    found = F.coalesce(classify(here, x["next"], before.isNull() | blank(before)), F.when(rescued, classify(here, x["next"], F.lit(True))))
    skips = F.coalesce(strip(x["next"]).rlike(P.UNDERLINE), F.lit(False)) & ~strip(here).rlike(P.MARKDOWN)
    entry = lambda f: F.struct(i.alias("line"), f["level"].alias("level"), f["title"].alias("title"), (f.isNotNull() & skips).alias("skips")).cast(HEADING)
    return let(found, entry)


def _settled(facts: pd.Series) -> pd.Series:
    """Lines of the headings that stay. Each deletion changes what later headings see, in order, so this is a loop."""
    return facts.map(lambda x: prune.settle(x.reshape(-1, prune.WIDTH).tolist()))


def stay(facts: Column) -> Column:
    """Lines of the headings that aren't unlikely guesses, from what prune.facts() tells.

    Marked as non-deterministic so that the optimizer works it out once, in a
    projection of its own, rather than copy it into filters and lambdas.
    """
    udf = F.pandas_udf(_settled, "array<int>").asNondeterministic()
    return udf(facts)
