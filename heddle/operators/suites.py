"""Scores of whole evaluation suites: one metric for each task, the best answer counts.

A row has predicted STRING, answers ARRAY<STRING>, task and, where a task names classes, classes ARRAY<STRING>. Metrics that need the longest
common subsequence or character alignment run on Arrow batches, and see only the rows of their own tasks; all others are column expressions.
Chinese tasks count characters. Null predictions count as ''; a row without answers scores 0."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions import text as tx
from heddle.operators import answers as an

#: The metric of each task (fixed values).
TASK_METRICS = {
    "narrativeqa": "f1",
    "qasper": "f1",
    "multifieldqa_en": "f1",
    "multifieldqa_zh": "f1_zh",
    "hotpotqa": "f1",
    "2wikimqa": "f1",
    "musique": "f1",
    "dureader": "rouge_zh",
    "gov_report": "rouge",
    "qmsum": "rouge",
    "multi_news": "rouge",
    "vcsum": "rouge_zh",
    "trec": "classes",
    "triviaqa": "f1",
    "samsum": "rouge",
    "lsht": "classes",
    "passage_retrieval_en": "paragraph",
    "passage_count": "number",
    "passage_retrieval_zh": "paragraph_zh",
    "lcc": "code",
    "repobench-p": "code",
}
#: Tasks of which the first line of a prediction is judged (fixed values).
FIRST_LINE = ("trec", "triviaqa", "samsum", "lsht")
#: What stands before the number of a paragraph (fixed values).
PARAGRAPH = {"paragraph": "Paragraph ([0-9]+)", "paragraph_zh": "段落([0-9]+)"}
#: Phrases before the option in an answer about code (fixed values).
CODE_PHRASES = ("answer is:", "is:", "answer:")


def _best(predicted: pd.Series, answers: pd.Series, score) -> pd.Series:
    pairs = zip(predicted, answers, strict=True)
    return pd.Series([None if p is None else max((score(p, x or "") for x in (() if a is None else a)), default=0.0) for p, a in pairs], dtype="float64")


@F.pandas_udf(T.DoubleType())
def best_rouge(predicted: pd.Series, answers: pd.Series) -> pd.Series:
    return _best(predicted, answers, lambda p, a: an.lcs_f(p.split(), a.split()))


@F.pandas_udf(T.DoubleType())
def best_rouge_chars(predicted: pd.Series, answers: pd.Series) -> pd.Series:
    return _best(predicted, answers, lambda p, a: an.lcs_f(list("".join(p.split())), list("".join(a.split()))))


@F.pandas_udf(T.DoubleType())
def best_code(predicted: pd.Series, answers: pd.Series) -> pd.Series:
    return _best(predicted, answers, an.ratio)


@F.pandas_udf(T.DoubleType())
def rouge_l_recall(predicted: pd.Series, truth: pd.Series) -> pd.Series:
    """Longest common subsequence of words as a share of the truth's words."""
    pairs = ((p.split() if p else [], g.split() if g else []) for p, g in zip(predicted, truth, strict=True))
    return pd.Series([an.common_length(p, g) / len(g) if g else 0.0 for p, g in pairs], dtype="float64")


def best(answers: Column, one) -> Column:
    """The best score of any answer, 0 without answers."""
    return F.coalesce(F.array_max(F.transform(answers, one)), F.lit(0.0))


def paragraph_share(predicted: Column, pattern: str):
    return lambda a: an.number_share(predicted, F.regexp_extract(a, pattern, 1))


def suite_scores(rows: DataFrame) -> DataFrame:
    """rows with score appended, by the metric of each row's task. Unknown tasks are an error at run time."""
    task, answers = F.col("task"), F.col("answers")
    plain = F.regexp_replace(tx.filled(F.col("predicted")), r"(?U)^\s+", "")
    p = F.when(task.isin(*FIRST_LINE), F.get(F.split(plain, "\n"), F.lit(0))).otherwise(plain)
    of = lambda metric: task.isin(*(k for k, v in TASK_METRICS.items() if v == metric))
    own = lambda metric, x: F.when(of(metric), x)
    either = lambda words, chars: F.when(of("f1"), words).when(of("f1_zh"), chars)
    f1 = an.best_f1(either(tx.normalize_answer(p), tx.normalize_zh(p)), either(F.transform(answers, tx.normalize_answer), F.transform(answers, tx.normalize_zh)), of("f1_zh"))
    scores = {
        "f1": f1,
        "f1_zh": f1,
        "classes": best(answers, lambda a: an.classification(p, a, F.col("classes"))),
        "number": best(answers, lambda a: an.number_share(p, a)),
        **{m: best(answers, paragraph_share(p, x)) for m, x in PARAGRAPH.items()},
        "rouge": best_rouge(own("rouge", p), answers),
        "rouge_zh": best_rouge_chars(own("rouge_zh", p), answers),
        "code": best_code(own("code", tx.first_code_line(p)), answers),
    }
    out = F.raise_error(F.concat(F.lit("no metric for task "), tx.filled(task))).cast("double")
    for metric, score in scores.items():
        out = F.when(of(metric), score).otherwise(out)
    return rows.withColumn("score", out)


def suite_means(scored: DataFrame, length: str | None = None) -> DataFrame:
    """Percent by task, rounded to 2 places; with a column of lengths, by task and range of length (below 4,000, below 8,000, more)."""
    ranges = F.when(F.col(length) < 4000, "0-4k").when(F.col(length) < 8000, "4-8k").otherwise("8k+") if length else None
    by = ["task"] + ([ranges.alias("bucket")] if length else [])
    return scored.groupBy(*by).agg(F.round(100 * F.avg("score"), 2).alias("score"), F.count("*").alias("n"))


def code_option(predicted: Column, letter: Column, name: Column) -> Column:
    """Whether an answer names the option by its letter or its function: as the last letter A-J that stands alone, at the start, or behind the first phrase that occurs."""
    p = tx.strip(tx.filled(predicted))
    plain = F.regexp_replace(F.regexp_replace(p, "[\n`'\"*-]|[Oo]ption", " "), " {2,}", " ")
    named = lambda s: F.startswith(s, letter) | F.startswith(s, name)
    behind = F.lit(False)
    for phrase in reversed(CODE_PHRASES):
        at = F.instr(plain, phrase)
        behind = F.when(at > 0, named(F.substring(plain, at + len(phrase) + 1, F.length(plain)))).otherwise(behind)
    return (tx.last_choice(p) == letter) | named(plain) | behind


def any_named(predicted: Column, answers: Column) -> Column:
    """Whether the prediction has one of the names, in capitals on both sides."""
    return F.exists(answers, lambda a: F.contains(F.upper(tx.filled(predicted)), F.upper(a)))


def bleu(rows: DataFrame, key: str, predicted: str, truth: str, orders: tuple[int, ...] = (1, 4)) -> DataFrame:
    """key and bleu<n> for each n: clipped precision of n-grams times the brevity penalty, 0 without a common word. N-grams are counted row by row, and never shuffled."""
    every = sorted({1, *orders})

    def counted(predicted: pd.Series, truth: pd.Series) -> pd.Series:
        out = []
        for p, g in zip(predicted, truth, strict=True):
            p, g = (s.split(" ") if s else [] for s in (p, g))
            grams = lambda words, n: zip(*(words[k:] for k in range(n)))
            out.append([len(p), len(g), *(an.common_count(grams(p, n), grams(g, n)) for n in every)])
        return pd.Series(out)

    words = F.pandas_udf(counted, T.ArrayType(T.LongType()))(*(tx.squeeze(tx.filled(F.col(c))) for c in (predicted, truth)))
    size, target = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    same = lambda n: F.get("c", F.lit(2 + every.index(n)))
    penalty = F.when(size > target, 1.0).otherwise(F.exp(1 - target / size))
    precision = lambda n: same(n) / F.greatest(F.lit(1), size - (n - 1))
    value = lambda n: F.when((size == 0) | (same(1) == 0), 0.0).otherwise(penalty * precision(n))
    return rows.select(key, words.alias("c")).select(key, *(value(n).alias(f"bleu{n}") for n in orders))
