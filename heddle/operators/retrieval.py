"""Answers to retrieval questions: what a model's text names as its answers, and how they score against the right ones.

The answers of a text are the items of the first line that holds a list literal; without one, or with an empty one, what follows the answer phrase in the first
line that has it. Lists hold quoted strings, numbers and the names True, False and None; a line whose brackets hold anything else is passed over, as is one that is no
list. All of it is expressions over one row: nothing is evaluated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import text as tx
from heddle.operators import answers as an

#: One item of a list literal, and the whole of one (fixed values: what such a literal may hold).
ITEM = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|True|False|None"
LIST = rf"^\[\s*(?:(?:{ITEM})(?:\s*,\s*(?:{ITEM}))*\s*,?\s*)?\]$"


def _bracketed(line: Column) -> Column:
    """From the first opening bracket of a line to its last closing one, quotes inside words escaped; '' where it has none in that order."""
    part = F.regexp_replace(F.regexp_extract(line, r"\[.*\]", 0), "([a-zA-Z0-9])'([a-zA-Z0-9])", r"$1\\'$2")
    return part


def _items(literal: Column) -> Column:
    raw = F.regexp_extract_all(literal, F.lit(f"({ITEM})"), F.lit(1))
    bare = lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1")
    return F.transform(raw, lambda x: F.when(F.left(x, F.lit(1)).isin("'", '"'), bare(x)).otherwise(x))


def extracted(predicted: Column, phrase: str = "final answer") -> Column:
    """The answers that a text names, an empty array if none. Null counts as ''."""
    plain = F.regexp_replace(F.translate(F.coalesce(predicted, F.lit("")), "*`", ""), r"^\s+|\s+$", "")
    lines = F.split(plain, "\n")
    lists = F.filter(F.transform(lines, _bracketed), lambda x: x.rlike(LIST))
    named = F.coalesce(_items(F.get(lists, F.lit(0))), F.array().cast("array<string>"))
    marked = F.get(F.filter(lines, lambda x: F.contains(F.lower(x), F.lit(phrase.lower()))), F.lit(0))
    after = F.substring(marked, F.instr(F.lower(marked), phrase.lower()) + len(phrase), F.length(marked))
    after = F.regexp_replace(F.regexp_replace(after, r"^\s+|\s+$", ""), r"^:+\s*", "")
    return F.when(F.size(named) > 0, named).when(after != "", F.array(after)).otherwise(F.array().cast("array<string>"))


def normalized(values: Column, by: Callable[[Column], Column] = tx.normalize_answer) -> Column:
    return F.transform(values, by)


def composed(rows: DataFrame, predicted: str, answers: str) -> DataFrame:
    """Both columns with letters and marks decomposed, as the multi-lingual normalisation has it; Arrow batches, for texts beyond ASCII."""
    odd = lambda c: F.col(c).rlike(r"[^\x00-\x7F]")
    rows = rows.withColumn("_a", F.to_json(answers))
    rows = rows.withColumn(predicted, F.when(odd(predicted), an.decomposed(predicted)).otherwise(F.col(predicted)))
    return rows.withColumn(answers, F.from_json(F.when(odd("_a"), an.decomposed("_a")).otherwise(F.col("_a")), "array<string>")).drop("_a")


def single_scores(rows: DataFrame, key: str, predicted: str = "predicted", answers: str = "answers", phrase: str = "final answer") -> DataFrame:
    """key, em, subspan_em and f1 of questions with one answer: the best over the right answers of the first named one. 0 where there is no right answer (nulls
    are none) or none is named."""
    cut = rows.select(key, extracted(F.col(predicted), phrase).alias("p"), F.filter(F.coalesce(answers, F.array().cast("array<string>")), lambda a: a.isNotNull()).alias("g"))
    norm = cut.select(key, tx.normalize_answer(F.get("p", F.lit(0))).alias("p"), normalized(F.col("g")).alias("g"), ((F.size("p") > 0) & (F.size("g") > 0)).alias("ok"))
    p = F.col("p")
    best = lambda f: F.when(F.col("ok"), F.coalesce(F.array_max(F.transform("g", f)), F.lit(0.0))).otherwise(0.0)
    return norm.withColumn("w", tx.tokens(p)).select(
        key,
        best(lambda g: (g == p).cast("double")).alias("em"),
        best(lambda g: F.contains(p, g).cast("double")).alias("subspan_em"),
        best(lambda g: an.f1_of(F.col("w"), tx.tokens(g))).alias("f1"),
    )


def multi_scores(rows: DataFrame, key: str, predicted: str = "predicted", answers: str = "answers", phrase: str = "final answer") -> DataFrame:
    """key, em (the same set), subspan_em (each right answer has a named one of its own that holds it or is held by it) and coverage (right answers named, over
    all right ones) of questions with several answers; 0 where there is no right answer or none is named."""
    cut = rows.select(key, extracted(F.col(predicted), phrase).alias("p"), F.filter(F.coalesce(answers, F.array().cast("array<string>")), lambda a: a.isNotNull()).alias("g"))
    norm = cut.select(key, normalized(F.col("p")).alias("p"), normalized(F.col("g")).alias("g"), ((F.size("p") > 0) & (F.size("g") > 0)).alias("ok"))
    when = lambda x: F.when(F.col("ok"), x).otherwise(0.0)
    return norm.select(
        key,
        when((F.array_sort(F.array_distinct("p")) == F.array_sort(F.array_distinct("g"))).cast("double")).alias("em"),
        when(an.all_aligned("g", "p").cast("double")).alias("subspan_em"),
        when(F.size(F.array_intersect("p", "g")) / F.greatest(F.size("g"), F.lit(1))).alias("coverage"),
    )
