"""Scalar string functions on columns; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with `value` worked out once: inside a lambda nothing else shares a value that is named twice."""
    return F.get(F.transform(F.array(value), use), 0)


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"\A{P.WS}+", ""), rf"{P.WS}+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{P.WS}+\z", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{P.WS}+", "")


def blank(c: Column) -> Column:
    return ~c.rlike(P.NOT_WS)


def words(c: Column) -> Column:
    """Runs without white space."""
    return F.regexp_extract_all(c, F.lit(f"{P.NOT_WS}+"), F.lit(0))


def normalize(c: Column) -> Column:
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.replace(c, F.lit("\t"), F.lit("    "))
    c = F.regexp_replace(c, r"[ \xa0]+\n", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.concat(strip(c), F.lit("\n"))


def looks_like_text(c: Column) -> Column:
    """At most one character in twenty is a control or replacement character."""
    return (F.length(c) == 0) | (F.regexp_count(c, F.lit(P.CONTROL)) / F.greatest(F.length(c), F.lit(1)) <= 0.05)


def fingerprint(c: Column) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 16)


def split_lines(c: Column) -> Column:
    """Lines by any Unicode line end; a last end opens no line."""
    parts = F.split(c, P.LINE_END, -1)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def letter_or_number(c: Column) -> Column:
    return c.rlike(r"\A[\p{L}\p{N}]\z")


def ends_sentence(c: Column) -> Column:
    return c.rlike(P.SENTENCE_END)


# --- flags -----------------------------------------------------------------------------


def _at(text: Column, place: Column) -> Column:
    """The character at a 0-based place; empty outside the text."""
    return F.when(place >= 0, F.substring(text, place + 1, F.lit(1))).otherwise(F.lit(""))


def starts_mid_sentence(text: Column, start: Column) -> Column:
    """Only what stands around `start` is looked at, cut out once: a place in a long text is costly to find."""
    low = F.greatest(start - 300, F.lit(0))
    return let(F.struct(F.substring(text, low + 1, start - low + 5).alias("w"), (start - low).alias("s")), lambda v: _starts_mid(v["w"], v["s"]))


def _starts_mid(text: Column, start: Column) -> Column:
    before = F.substring(text, F.greatest(start - 300, F.lit(0)) + 1, F.least(start, F.lit(300)))
    body = rstrip(before)
    gap = F.substring(before, F.length(body) + 1, F.length(before))
    first = lstrip(F.substring(text, start + 1, F.lit(3)))
    lead = F.substring(first, 1, 1)
    return (
        F.when(start <= 0, False)
        .when(letter_or_number(_at(text, start - 1)) & letter_or_number(_at(text, start)), True)
        .when(body == "", False)
        .when(F.contains(gap, F.lit("\n\n")) | ends_sentence(body), False)
        .when(F.substring(text, start + 1, F.lit(4)).rlike(P.BULLET) | lead.isin("", "•", "▪", "◦"), False)
        .when(F.contains(gap, F.lit("\n")) & lead.rlike(r"\A\p{Lu}"), False)
        .otherwise(True)
    )


def ends_mid_sentence(text: Column, end: Column) -> Column:
    """As above; the whole text is looked at only if what stands before `end` says nothing."""
    low = F.greatest(end - 400, F.lit(0))
    near = F.struct(F.substring(text, low + 1, end - low + 301).alias("w"), (end - low).alias("e"))
    says = lambda v: F.substring(v["w"], F.lit(1), v["e"]).rlike(P.SAYS)
    chosen = lambda v: F.struct(F.when(says(v), v["w"]).otherwise(text).alias("w"), F.when(says(v), v["e"]).otherwise(end).alias("e"))
    return let(near, lambda v: let(chosen(v), lambda c: _ends(c["w"], c["e"])))


def _ends(text: Column, end: Column) -> Column:
    body = rstrip(F.substring(text, F.lit(1), end))
    after = F.substring(text, end + 1, F.lit(300))
    return let(F.struct(body.alias("body"), after.alias("after"), lstrip(after).alias("rest")), lambda x: _ends_mid(text, end, x["body"], x["after"], x["rest"]))


def _ends_mid(text: Column, end: Column, body: Column, after: Column, rest: Column) -> Column:
    gap = F.concat(F.substring(after, F.lit(1), F.length(after) - F.length(rest)), F.substring(text, F.length(body) + 1, end - F.length(body)))
    return (
        F.when(end >= F.length(text), False)
        .when(letter_or_number(_at(text, end - 1)) & letter_or_number(_at(text, end)), True)
        .when((body == "") | ends_sentence(body), False)
        .when(rest == "", False)
        .when(F.contains(gap, F.lit("\n\n")), False)
        .when(F.contains(gap, F.lit("\n")) & (rest.rlike(r"\A\p{Lu}") | F.substring(rest, 1, 4).rlike(P.BULLET)), False)
        .otherwise(True)
    )


def labels(line: Column) -> Column:
    return F.filter(F.regexp_extract_all(line, F.lit(P.LABELS), F.lit(0)), lambda w: ~F.lower(w).isin(*P.NOT_LABELS))


def numbers(line: Column) -> Column:
    """Numbers that don't follow a letter; a match that does is used up."""
    return F.filter(F.regexp_extract_all(line, F.lit(P.NUMBERS), F.lit(0)), lambda w: ~w.rlike(r"\A\p{L}"))


def sentence_with_units(line: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(line), F.lit(P.UNIT_TOKENS), F.lit(0))
    following = F.concat(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1))), F.array(F.lit("")))
    pairs = F.zip_with(tokens, following, lambda a, b: a.rlike(P.NUMBER_TOKEN) & (F.regexp_replace(b, r"\.+\z", "").isin(*P.UNITS) | a.endswith("%")))
    plain = F.size(F.filter(words(line), lambda w: w.rlike(P.PLAIN_WORD)))
    return F.exists(pairs, lambda x: F.coalesce(x, F.lit(False))) & (plain >= 3) & ends_sentence(line)


def unlabeled_numbers(chunk: Column) -> Column:
    """Whether a line of numbers has nothing, on it or up to three lines above, that says what they are.

    A chunk without a digit has none, and dates and units are looked for only in lines with digits.
    """
    return F.when(chunk.rlike(r"\p{Nd}"), _unlabeled(chunk)).otherwise(False)


def _unlabeled(chunk: Column) -> Column:
    digits = lambda x: x.rlike(r"\p{Nd}")
    masked = lambda x: F.when(digits(x), F.regexp_replace(x, f"(?iu){P.DATES}", "date")).otherwise(x)
    lines = F.transform(F.filter(split_lines(chunk), lambda x: ~blank(x)), lambda x: let(strip(x), masked))
    facts = lambda x: F.struct(F.when(digits(x), F.size(numbers(x))).otherwise(0).alias("n"), F.size(labels(x)).alias("w"), F.when(digits(x), sentence_with_units(x)).otherwise(False).alias("s"), (~x.endswith(".")).alias("open"))
    bare = lambda x: ~x["s"] & (((x["n"] >= 2) & (x["w"] < x["n"])) | ((x["n"] == 1) & (x["w"] == 0)))
    head = lambda x: (x["w"] >= 2) & (x["n"] == 0) & x["open"]
    # a fold needs only whether each of the last three lines is a header
    start = F.struct(F.lit(False).alias("a"), F.lit(False).alias("b"), F.lit(False).alias("c"), F.lit(False).alias("found"))
    step = lambda z, x: F.struct(z["b"].alias("a"), z["c"].alias("b"), head(x).alias("c"), (z["found"] | (bare(x) & ~(z["a"] | z["b"] | z["c"]))).alias("found"))
    return F.aggregate(F.transform(lines, facts), start, step, lambda z: z["found"])


def chunk_flags(text: Column, start: Column, end: Column) -> Column:
    piece = F.substring(text, start + 1, end - start)
    return F.array_compact(
        F.array(
            F.when(starts_mid_sentence(text, start), F.lit("starts_mid_sentence")),
            F.when(ends_mid_sentence(text, end), F.lit("ends_mid_sentence")),
            F.when(end - start < P.SHORT_CHARS, F.lit("short")),
            F.when(unlabeled_numbers(piece), F.lit("unlabeled_numbers")),
        )
    )


def too_small(average: Column, least: Column) -> Column:
    return F.when(average < P.SMALL_AVERAGE, "avg").when(least < P.SMALL_LEAST, "min")
