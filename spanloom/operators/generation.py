"""The optional generation step: prompts, a pluggable model, and a checked comparison.

A call that fails doesn't end the job: its row says why.

The model is a function of a prompt. Without one, a stub answers with the first
sentence of the passages, so that pipelines run without a network.
"""

from __future__ import annotations

import importlib.util
import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import strip
from .compare import BY

#: The comparison's structure.
COMPARISON = (
    "struct<agree:boolean,summary:string,differences:array<struct<point:string,fixed:string,paragraph:string,section:string>>,"
    "quotes:struct<fixed:array<string>,paragraph:array<string>,section:array<string>>>"
)
ANSWER = "text string, refused boolean, truncated boolean"


def passages(hits: DataFrame) -> DataFrame:
    """Each strategy's retrieved texts, numbered by rank, as one prompt part."""
    listed = hits.groupBy(*BY, "strategy").agg(F.array_sort(F.collect_list(F.struct("rank", strip(F.col("text")).alias("text")))).alias("p"))
    numbered = F.transform("p", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]\n"), x["text"]))
    return listed.select(*BY, "strategy", F.array_join(numbered, "\n\n").alias("passages"))


def stub(prompt: str) -> dict:
    body = prompt.partition("]\n")[2].strip()
    return {"text": body.partition(". ")[0][:200], "refused": not body, "truncated": False}


def answers(prompts: DataFrame, model: Callable[[str], dict] = stub, prompt: str = "passages") -> DataFrame:
    """Add the model's text, refused and truncated to each row; a refusal has no text."""

    @F.pandas_udf("struct<text:string,refused:boolean,truncated:boolean>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = [model(p) for p in b]
            yield pd.DataFrame({"text": [None if s.get("refused") else s.get("text") for s in said], "refused": [bool(s.get("refused")) for s in said], "truncated": [bool(s.get("truncated")) for s in said]})

    return prompts.withColumn("a", call(F.col(prompt))).select("*", "a.text", "a.refused", "a.truncated").drop("a")


def comparable(given: DataFrame) -> DataFrame:
    """Questions that every strategy answered: only those are compared."""
    full = F.count_if(F.coalesce(F.col("text"), F.lit("")) != "")
    texts = [F.max(F.when(F.col("strategy") == s, F.col("text"))).alias(s) for s in P.STRATEGIES]
    return given.groupBy(*BY).agg(full.alias("n"), *texts).where(F.col("n") == len(P.STRATEGIES)).drop("n")


def parse_comparison(json: Column) -> Column:
    return F.from_json(json, COMPARISON)


def real_quotes(quotes: Column, answer: Column) -> Column:
    """Only quotes that stand in the answer, character for character."""
    return F.filter(quotes, lambda q: (q != "") & F.contains(answer, q))


def checked(compared: DataFrame) -> DataFrame:
    """Comparisons (fixed, paragraph, section: answers; json) with structure, and only real quotes."""
    out = compared.withColumn("c", parse_comparison(F.col("json")))
    quotes = F.struct(*(real_quotes(F.col(f"c.quotes.{s}"), F.col(s)).alias(s) for s in P.STRATEGIES))
    return out.select(*BY, "c.agree", "c.summary", "c.differences", quotes.alias("quotes"), F.when(F.col("c.agree").isNull() | F.col("c.quotes").isNull(), "not a comparison").alias("error"))


class ModelError(Exception):
    """A model's failure, with the HTTP status that stands for it."""

    def __init__(self, message: str, status: int = 502):
        super().__init__(message)
        self.status = status


#: What kinds of failure are told as, in order; a ModelError tells its own.
FAILURES = ((PermissionError, 403), (ConnectionError, 503), (TimeoutError, 503), (ImportError, 503))


def failure(e: Exception) -> tuple[int, str]:
    """Status and message of a failed call."""
    if isinstance(e, ModelError):
        return e.status, str(e)
    return next((status for kind, status in FAILURES if isinstance(e, kind)), 502), f"{type(e).__name__}: {e}"


def status(package: str, keys: tuple[str, ...], model: str) -> dict:
    """Whether a model's client can be used here: its package, and a key among environment variables."""
    return {"installed": importlib.util.find_spec(package) is not None, "has_key": any(os.environ.get(k) for k in keys), "model": model}


def stub_comparison(question: str, given: dict[str, str]) -> dict:
    """Answers agree if they are equal; each one's first words are quoted, and some that it doesn't have."""
    same = len(set(given.values())) == 1
    quotes = {s: [t[:20], "invented"] for s, t in given.items()}
    return {"text": json.dumps({"agree": same, "summary": "equal" if same else "different", "differences": [], "quotes": quotes})}


def comparisons(given: DataFrame, model: Callable[[str, dict], dict] = stub_comparison) -> DataFrame:
    """Each comparable question's answers compared by one call: agree, summary, differences, quotes, status, error.

    `given` has answers, and may have `question`. The model gets the question and the answers by
    strategy, and gives text (JSON), refused and truncated. Status is 200, or that of the failure.
    """
    rows = comparable(given)
    asked = given.groupBy(*BY).agg(F.max("question").alias("question")) if "question" in given.columns else rows.select(*BY, F.lit("").alias("question"))

    @F.pandas_udf("struct<json:string,status:int,error:string>")
    def call(questions: pd.Series, fixed: pd.Series, paragraph: pd.Series, section: pd.Series) -> pd.DataFrame:
        out = []
        for question, *texts in zip(questions, fixed, paragraph, section, strict=True):
            try:
                said = model(question, dict(zip(P.STRATEGIES, texts, strict=True)))
                if said.get("refused"):
                    raise ModelError("the model declined to compare these answers")
                if said.get("truncated"):
                    raise ModelError("the comparison was cut off before it finished")
                out.append((said["text"], 200, None))
            except Exception as e:  # told in the row
                out.append((None, *failure(e)))
        return pd.DataFrame(out, columns=["json", "status", "error"])

    called = rows.join(asked, list(BY)).withColumn("said", call("question", *P.STRATEGIES)).select(*BY, *P.STRATEGIES, "said.json", "said.status", F.col("said.error").alias("failed"))
    out = checked(called).join(called.select(*BY, "status", "failed"), list(BY))
    return out.select(*BY, "agree", "summary", "differences", "quotes", F.when(F.col("failed").isNull() & F.col("error").isNotNull(), 502).otherwise(F.col("status")).alias("status"), F.coalesce("failed", "error").alias("error"))
