"""Section trees: headings nested by level, with the paragraph spans of each body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S
from ..functions.headings import candidates, marked, stay
from ..functions.prune import facts
from ..functions.text import blank, let

_ENTRY = "struct<level:int,title:string,numbered:boolean>"
_PLACED = "struct<line:int,level:int,path:array<string>,skips:boolean>"
SECTION = f"struct<path:array<string>,header:struct<start:int,end:int>,body:{S.SPANS}>"


def raw_lines(text: Column) -> Column:
    """Lines with their ends, as (text, start, stop)."""
    other = r"[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
    pieces = F.regexp_extract_all(text, F.lit(f"{other}*(?:{P.LINE_END})|{other}+"), F.lit(0))
    shape = "struct<at:int,out:array<struct<text:string,start:int,stop:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,stop:int>>").alias("out")).cast(shape)
    step = lambda z, x: F.struct((z["at"] + F.length(x)).alias("at"), F.array_append(z["out"], F.struct(x.alias("text"), z["at"].alias("start"), (z["at"] + F.length(x)).alias("stop"))).alias("out")).cast(shape)
    return F.aggregate(pieces, start, step, lambda z: z["out"])


def _numbered(line: Column, title: Column) -> Column:
    return title.rlike(P.NUMBERED) & ~F.ltrim(line).startswith("#")


def nested(lines: Column, found: Column, alone: bool = False) -> Column:
    """Headings with their paths.

    A guess goes just below the last explicit heading, or below the heading that
    only blank lines part it from. A heading keeps those of smaller level above
    it; a numbered one, those up to the deepest numbered one of smaller level, or
    none if numbered ones stand `alone`.
    """
    shape = f"struct<stack:array<{_ENTRY}>,explicit:int,before:int,out:array<{_PLACED}>>"
    start = F.struct(F.array().cast(f"array<{_ENTRY}>").alias("stack"), F.lit(0).alias("explicit"), F.lit(-1).alias("before"), F.array().cast(f"array<{_PLACED}>").alias("out")).cast(shape)

    def step(z: Column, h: Column) -> Column:
        base = z["explicit"] + 1
        top = F.try_element_at(z["stack"], F.lit(-1))["level"]
        between = F.slice(lines, z["before"] + 2, F.greatest(h["line"] - z["before"] - 1, F.lit(0)))
        close = (F.size(z["stack"]) > 0) & (z["before"] >= 0) & F.forall(between, lambda x: blank(x["text"]))
        level = F.when(h["level"] > 0, h["level"]).when(close, F.least(top + 1, base + 1)).otherwise(base)
        return let(F.struct(level.alias("level"), _numbered(F.get(lines, h["line"])["text"], h["title"]).alias("number")), lambda v: placed(z, h, v))

    def placed(z: Column, h: Column, v: Column) -> Column:
        smaller = F.filter(z["stack"], lambda x: x["level"] < v["level"])
        deepest = F.array_max(F.transform(F.filter(smaller, lambda x: x["numbered"]), lambda x: x["level"]))
        numbered = F.array().cast(f"array<{_ENTRY}>") if alone else F.filter(z["stack"], lambda x: x["level"] <= F.coalesce(deepest, F.lit(-1)))
        above = F.when(v["number"], numbered).otherwise(smaller)
        stack = F.array_append(above, F.struct(v["level"].alias("level"), h["title"].alias("title"), v["number"].alias("numbered")).cast(_ENTRY))
        entry = lambda k: F.struct(h["line"].alias("line"), v["level"].alias("level"), F.transform(k, lambda x: x["title"]).alias("path"), h["skips"].alias("skips")).cast(_PLACED)
        explicit = F.when(h["level"] > 0, h["level"]).otherwise(z["explicit"])
        return let(stack, lambda k: F.struct(k.alias("stack"), explicit.alias("explicit"), h["line"].alias("before"), F.array_append(z["out"], entry(k)).alias("out")).cast(shape))

    return F.aggregate(found, start, step, lambda z: z["out"])


def lines_of(docs: DataFrame, marks: bool = False) -> DataFrame:
    """Documents with `lines`, and with `placed`: the headings that stay, in their tree.

    With `marks`, headings are those that their own line marks, none is guessed or taken
    for a table's row, and a numbered one has none above it.
    """
    out = docs.withColumn("lines", raw_lines(F.col("text")))
    bare = F.transform("lines", lambda x: F.regexp_replace(x["text"], r"[\r\n]+\z", ""))
    if marks:
        # the condition always holds, but keeps the optimizer from working lines out again for each heading
        once = lambda c: F.when(F.rand(0) != 2, c)
        out = out.withColumn("lines", once(F.col("lines"))).withColumn("found", once(marked(bare)))
        return out.withColumn("placed", once(nested(F.col("lines"), F.col("found"), alone=True))).drop("found")
    out = out.withColumn("found", candidates(F.transform("lines", lambda x: x["text"])))
    filled = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: ~blank(F.get("lines", i)["text"]))
    # only headings' facts, as numbers, go to Python
    seen = F.when(F.size("found") > 0, let(F.struct(bare.alias("lines"), filled.alias("filled"), F.col("found").alias("found")), lambda x: facts(x["lines"], x["filled"], x["found"])))
    # a condition that always holds, but that the optimizer can't move: lambdas this deep aren't found again in a Python function's argument
    here = F.rand(0) != 2
    out = out.withColumn("told", F.when(here, F.coalesce(seen, F.array().cast("array<int>")))).withColumn("stay", stay(F.col("told"))).drop("told")
    out = out.withColumn("found", F.filter("found", lambda h: F.array_contains("stay", h["line"])))
    return out.withColumn("placed", nested(F.col("lines"), F.col("found"))).drop("stay", "found")


def with_sections(docs: DataFrame, marks: bool = False) -> DataFrame:
    """Documents with `sections`: those with a header or a body."""
    return lines_of(docs, marks).withColumn("sections", _sections(F.col("text"), F.col("lines"), F.col("placed"))).drop("lines", "placed")


def _sections(text: Column, lines: Column, placed: Column) -> Column:
    # a first entry stands for what comes before any heading
    none = F.lit(None).cast(_PLACED)
    opened = F.concat(F.array(none), placed)
    closed = F.concat(placed, F.array(none))

    bare = lambda x: F.length(F.regexp_replace(x, r"[\r\n]+\z", ""))

    def one(h: Column, after: Column) -> Column:
        line = F.get(lines, h["line"])
        begin = F.when(h.isNull(), F.lit(0)).when(h["skips"], F.get(lines, h["line"] + 1)["stop"]).otherwise(line["stop"])
        end = F.coalesce(F.get(lines, after["line"])["start"], F.length(text))
        return let(F.struct(line.alias("line"), begin.alias("begin"), F.substring(text, begin + 1, F.greatest(end - begin, F.lit(0))).alias("body")), lambda v: section(h, v))

    def section(h: Column, v: Column) -> Column:
        header = F.when(h.isNotNull(), F.struct(v["line"]["start"].alias("start"), (v["line"]["start"] + bare(v["line"]["text"])).alias("end")))
        shifted = F.transform(S.paragraphs(v["body"]), lambda s: F.struct((s["start"] + v["begin"]).alias("start"), (s["end"] + v["begin"]).alias("end")))
        return F.struct(F.coalesce(h["path"], F.array().cast("array<string>")).alias("path"), header.alias("header"), shifted.alias("body")).cast(SECTION)

    every = F.zip_with(opened, closed, one)
    return F.filter(every, lambda s: s["header"].isNotNull() | (F.size(s["body"]) > 0))


def sections(docs: DataFrame, marks: bool = False) -> DataFrame:
    """doc_id, section_no, path, header_start, header_end, body."""
    out = with_sections(docs, marks).select("doc_id", F.posexplode("sections").alias("section_no", "s"))
    return out.select("doc_id", "section_no", F.col("s.path").alias("path"), F.col("s.header.start").alias("header_start"), F.col("s.header.end").alias("header_end"), F.col("s.body").alias("body"))


def section_starts(sections: DataFrame) -> DataFrame:
    """doc_id, at, path: where each section begins."""
    return sections.select("doc_id", F.coalesce("header_start", F.get("body", F.lit(0))["start"]).alias("at"), "path")


def section_at(places: DataFrame, starts: DataFrame, place: str = "pos") -> DataFrame:
    """As-of join: the path of the last section that starts at or before each place; none before the first.

    Sections of one document are gathered into one sorted array, so it is an
    equi-join by document and a search in the array, without a range join.
    """
    # a stable order for sections that start at the same place isn't needed: each has a line of its own
    gathered = starts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "path"))).alias("starts"))
    last = F.try_element_at(F.filter("starts", lambda x: x["at"] <= F.col(place)), F.lit(-1))["path"]
    return places.join(gathered, "doc_id", "left").withColumn("section", F.coalesce(last, F.array().cast("array<string>"))).drop("starts")

