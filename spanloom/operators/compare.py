"""How the strategies' results agree: interval joins within one question and document.

hits: question_id, doc_id, strategy, rank, start, end. A question has at most a few
dozen hits, so each join is by question and document, with the range as a rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S

BY = ["question_id", "doc_id"]


def ordinal(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, P.STRATEGIES)), c)


def _other(hits: DataFrame) -> DataFrame:
    return hits.select(*BY, *(F.col(c).alias(f"other_{c}") for c in ("strategy", "rank", "start", "end")))


def matches(hits: DataFrame) -> DataFrame:
    """Pairs of hits of different strategies at the same passage."""
    both = hits.join(_other(hits), BY)
    same = S.same_passage(F.col("start"), F.col("end"), F.col("other_start"), F.col("other_end"))
    return both.where((F.col("strategy") != F.col("other_strategy")) & same).select(*BY, "strategy", "rank", "other_strategy", "other_rank")


def also_found_by(hits: DataFrame) -> DataFrame:
    """For each hit and other strategy that found its passage, the best rank there."""
    return matches(hits).groupBy(*BY, "strategy", "rank", "other_strategy").agg(F.min("other_rank").alias("best_rank"))


def unique_hits(hits: DataFrame) -> DataFrame:
    """Hits whose passage no other strategy found."""
    return hits.join(matches(hits), [*BY, "strategy", "rank"], "left_anti")


def unique_counts(hits: DataFrame) -> DataFrame:
    """How many of a question's results were found by one strategy only."""
    alone = unique_hits(hits).groupBy(*BY).agg(F.count("*").alias("alone"))
    total = hits.groupBy(*BY).agg(F.count("*").alias("total"))
    return total.join(alone, BY, "left").select(*BY, F.coalesce("alone", F.lit(0)).alias("found_by_one"), "total")


def _covered(spans: DataFrame, keys: list[str]) -> DataFrame:
    """How many characters the spans of each key cover: islands of overlapping spans."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce("reach", F.lit(0))))
    return spans.withColumn("reach", reach).withColumn("new", new).groupBy(*keys).agg(F.sum("new").alias("covered"))


def pairs_of(questions: DataFrame) -> DataFrame:
    """The three pairs of strategies for each question."""
    names = P.STRATEGIES
    listed = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for i, a in enumerate(names) for b in names[i + 1 :]))
    return questions.select(*BY).distinct().withColumn("p", F.explode(listed)).select(*BY, "p.a", "p.b")


def pair_overlap(hits: DataFrame) -> DataFrame:
    """Jaccard overlap of the characters that two strategies' hits cover."""
    pairs = pairs_of(hits)
    sizes = _covered(hits, [*BY, "strategy"])
    union = pairs.join(hits, BY).where((F.col("strategy") == F.col("a")) | (F.col("strategy") == F.col("b")))
    union = _covered(union, [*BY, "a", "b"]).withColumnRenamed("covered", "u")
    side = lambda s: sizes.select(*BY, F.col("strategy").alias(s), F.col("covered").alias(f"n_{s}"))
    out = pairs.join(union, [*BY, "a", "b"], "left").join(side("a"), [*BY, "a"], "left").join(side("b"), [*BY, "b"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    shared = zero("n_a") + zero("n_b") - zero("u")
    return out.select(*BY, "a", "b", F.bround(F.when(zero("u") > 0, shared / F.col("u")).otherwise(0.0), 3).alias("overlap"))


def top1_agreement(hits: DataFrame) -> DataFrame:
    """Whether two strategies' first hits are at the same passage."""
    top = hits.where("rank = 1")
    side = lambda s: top.select(*BY, F.col("strategy").alias(s), F.col("start").alias(f"start_{s}"), F.col("end").alias(f"end_{s}"))
    out = pairs_of(hits).join(side("a"), [*BY, "a"], "left").join(side("b"), [*BY, "b"], "left")
    same = S.same_passage(F.col("start_a"), F.col("end_a"), F.col("start_b"), F.col("end_b"))
    return out.select(*BY, "a", "b", F.coalesce(same, F.lit(False)).alias("top1_agree"))


def all_agree(hits: DataFrame) -> DataFrame:
    return top1_agreement(hits).groupBy(*BY).agg(F.bool_and("top1_agree").alias("top1_all_agree"))


def fragments(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """First hits shorter than a passage, and whose first passages hold at least half of them.

    texts: doc_id, text. The text is joined for these few rows only.
    """
    from ..functions.text import strip

    top = hits.where("rank = 1")
    small = top.where(F.col("end") - F.col("start") < P.SHORT_CHARS)
    large = _other(top).where(F.col("other_end") - F.col("other_start") >= P.SHORT_CHARS).drop("other_rank")
    shared = S.overlap(F.col("start"), F.col("end"), F.col("other_start"), F.col("other_end"))
    holds = (F.col("other_strategy") != F.col("strategy")) & (shared > 0) & (shared / F.greatest(F.lit(1), F.col("end") - F.col("start")) >= P.FRAGMENT_INSIDE)
    found = small.join(large, BY, "left").withColumn("inside", F.when(holds, F.struct(ordinal(F.col("other_strategy")), "other_strategy")))
    found = found.groupBy(*BY, "strategy", "start", "end").agg(F.array_sort(F.collect_list("inside")).alias("i"))
    out = found.join(texts.select("doc_id", "text"), "doc_id")
    piece = strip(F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")))
    return out.select(*BY, "strategy", "start", "end", piece.alias("text"), F.transform("i", lambda x: x["other_strategy"]).alias("inside"))


def with_headings(found: DataFrame, starts: DataFrame) -> DataFrame:
    """Fragments with their title where they are a heading: marked, in the section's path, or looking like one."""
    from ..functions.headings import classify
    from ..functions.text import strip
    from .sections import section_at

    placed = section_at(found, starts, "start")
    title = strip(F.regexp_replace("text", rf"\A#{{1,6}}{P.WS}+", ""))
    heading = F.col("text").startswith("#") | F.array_contains("section", title) | classify(F.col("text"), F.lit(""), F.lit(True)).isNotNull()
    return placed.withColumn("heading", F.when(~F.contains("text", F.lit("\n")) & heading, title)).drop("section")


def segments(hits: DataFrame) -> DataFrame:
    """A document's stretches by the set of strategies whose hits cover them: an endpoint sweep."""
    steps = hits.select(*BY, "strategy", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    flat = steps.groupBy(*BY, F.col("e.pos").alias("pos")).agg(*(F.sum(F.when(F.col("strategy") == s, F.col("e.d")).otherwise(0)).alias(s) for s in P.STRATEGIES))
    order = Window.partitionBy(*BY).orderBy("pos")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    out = flat.select(*BY, F.col("pos").alias("start"), F.lead("pos").over(order).alias("end"), *(F.sum(s).over(running).alias(s) for s in P.STRATEGIES))
    names = F.array_compact(F.array(*(F.when(F.col(s) > 0, F.lit(s)) for s in P.STRATEGIES)))
    return out.withColumn("strategies", names).where(F.col("end").isNotNull() & (F.size("strategies") > 0)).select(*BY, "start", "end", "strategies")


def verdict(hits: DataFrame, found: DataFrame) -> DataFrame:
    """For each question: which strategies' first hits agree, and which are only fragments."""
    agree = top1_agreement(hits).groupBy(*BY).agg(F.bool_and("top1_agree").alias("all_agree"), F.sort_array(F.collect_list(F.when(F.col("top1_agree"), F.concat_ws("+", "a", "b")))).alias("agreeing"))
    small = found.groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct(ordinal(F.col("strategy")).alias("o"), "strategy"))).alias("f"))
    out = agree.join(small, BY, "left")
    names = F.coalesce(F.transform("f", lambda x: x["strategy"]), F.array().cast("array<string>"))
    return out.select(*BY, "all_agree", "agreeing", names.alias("fragments"))
