"""Answer scoring: predictions in, a score for each row or metrics in long form out.

A prediction row has predicted STRING, answers ARRAY<STRING> and a task. Null predictions count as ''. Scores are expressions
over one row; metrics are one map-side aggregation."""

from __future__ import annotations

import ast
import difflib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions import text as tx


def contains(part: Column, whole: Column) -> Column:
    """Case-insensitive; the empty part is in every text."""
    return F.contains(F.lower(whole), F.lower(part))


def share_contained(predicted: Column, answers: Column) -> Column:
    hits = F.size(F.filter(answers, lambda a: contains(a, predicted)))
    return hits / F.size(answers)


def any_contained(predicted: Column, answers: Column) -> Column:
    return F.exists(answers, lambda a: contains(a, predicted)).cast("double")


def multiset_common(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays: both are sorted together, and one pass pairs the tokens of b with those of a."""
    tagged = lambda xs, side: F.transform(xs, lambda x: F.struct(x.alias("x"), F.lit(side).alias("side")))
    start = F.struct(F.lit(None).cast("string").alias("x"), F.lit(0).alias("left"), F.lit(0).alias("n"))

    def step(acc: Column, t: Column) -> Column:
        same = acc["x"].eqNullSafe(t["x"])
        left = F.when(same, acc["left"]).otherwise(0)
        pairs = (t["side"] == 1) & (left > 0)
        return F.struct(t["x"].alias("x"), (left + F.when(t["side"] == 0, 1).when(pairs, -1).otherwise(0)).alias("left"), (acc["n"] + pairs.cast("int")).alias("n"))

    return F.aggregate(F.sort_array(F.concat(tagged(a, 0), tagged(b, 1))), start, step)["n"]


def f1_of(pred: Column, gold: Column) -> Column:
    """Token F1, twice the common tokens over all tokens; 0 without any."""
    return F.coalesce(2 * multiset_common(pred, gold) / F.nullif(F.size(pred) + F.size(gold), F.lit(0)), F.lit(0.0))


def number_share(predicted: Column, truth: Column) -> Column:
    """Share of the numbers in the prediction that equal the truth."""
    found = tx.digits_all(predicted)
    return F.when(F.size(found) == 0, 0.0).otherwise(F.size(F.filter(found, lambda x: x == truth)) / F.size(found))


def classification(predicted: Column, truth: Column, classes: Column) -> Column:
    """1 / n if the truth is among the n classes named in the prediction. Classes that are a part of the truth, but not it, are left out: every one of
    them, where the original drops some only because it alters a list while walking it."""
    named = F.filter(classes, lambda c: F.contains(predicted, c) & ~(F.contains(truth, c) & (c != truth)))
    return F.when(F.array_contains(named, truth), F.lit(1.0) / F.size(named)).otherwise(0.0)


def matching_prefix(predicted: Column, label: Column) -> Column:
    """Share of the label's numbers met in order before the first difference."""
    found = F.transform(tx.digits_all(predicted), lambda x: F.try_to_number(x, F.lit("9" * 18)).cast("long"))
    run = F.aggregate(
        F.zip_with(label, F.slice(found, F.lit(1), F.size(label)), lambda a, b: F.coalesce(a == b, F.lit(False))),
        F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")),
        lambda s, hit: F.struct((s["on"] & hit).alias("on"), (s["n"] + (s["on"] & hit).cast("int")).alias("n")),
    )["n"]
    return run / F.size(label)


def map_matches(expected: Column, got: Column) -> Column:
    """Keys of the expected map with the same value in the other one; 0 where that is no map."""
    return F.coalesce(F.size(F.filter(F.map_keys(expected), lambda k: F.coalesce(got[k] == expected[k], F.lit(False)))), F.lit(0))


def map_overlaps(expected: Column, got: Column) -> Column:
    """Keys of the expected map whose values share a word."""
    share = lambda k: F.coalesce(F.size(F.array_intersect(tx.tokens(expected[k]), tx.tokens(got[k]))) > 0, F.lit(False))
    return F.coalesce(F.size(F.filter(F.map_keys(expected), lambda k: F.map_contains_key(got, k) & share(k))), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """The n-grams of an array of words, as texts: shifted slices zipped, so that the array is not looked up for each word."""
    count = F.greatest(F.size(words) - (n - 1), F.lit(0))
    out = F.slice(words, F.lit(1), count)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(words, F.lit(k + 1), count), lambda x, y: F.concat_ws(" ", x, y))
    return out


def recall_of_ngrams(rows: DataFrame, key: str, predicted: Column, truth: Column, n: int) -> DataFrame:
    """key and score: the share of the distinct n-grams of the truth that occur in the prediction. Words, and then n-grams, are columns of their own, so
    that no expression cuts a text again."""
    cut = rows.select(key, tx.tokens(predicted).alias("p"), tx.tokens(truth).alias("g"))
    grams = cut.select(key, ngrams(F.col("p"), n).alias("p"), F.array_distinct(ngrams(F.col("g"), n)).alias("g"))
    return grams.select(key, F.coalesce(F.size(F.array_intersect("g", "p")) / F.nullif(F.size("g"), F.lit(0)), F.lit(0.0)).alias("score"))


def choice(predicted: Column, label: Column) -> Column:
    """Option letter of a free answer, in the order: a standing-alone last letter that is right; the first character if A-D; the answer being the
    label; what follows the first answer phrase; the first word that is A-D."""
    p = tx.strip(predicted)
    last = tx.last_choice(p, "A-D")
    plain = F.regexp_replace(F.translate(p, "\n\"'.,?!{}", " " * 9), " {2,}", " ")
    out = F.get(F.filter(F.split(plain, r"\s+"), lambda w: w.isin("A", "B", "C", "D", "AB", "BC", "CD", "ABC", "BCD", "ABCD")), F.lit(0))
    found = F.coalesce(F.array_contains(label, out), F.lit(False))
    starts = lambda after: lambda x: F.startswith(after, x)
    for phrase in reversed(("answer is:", "answer:", "answer is", "option is")):
        at = F.instr(plain, phrase)
        after = F.substring(plain, at + len(phrase) + 1, F.length(plain))
        found = F.when(at > 0, F.exists(label, starts(after)) & (F.length(plain) >= at + len(phrase))).otherwise(found)
    found = F.when(F.array_contains(label, p), True).otherwise(found)
    found = F.when(F.left(p, F.lit(1)).isin("A", "B", "C", "D"), F.array_contains(label, F.left(p, F.lit(1)))).otherwise(found)
    found = F.when(p == "", False).otherwise(found)
    return F.when(F.array_contains(label, last), True).otherwise(found)


# --- rows that have no relational form: Arrow batches ------------------------------------------------------------------


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; the row of the table is the bits of one integer."""
    at: dict[str, int] = {}
    for j, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for w in a:
        hit = row & at.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def lcs_f(a: list[str], b: list[str]) -> float:
    n = common_length(a, b) if a and b else 0
    return 2 * n / (len(a) + len(b)) if n else 0.0


@F.pandas_udf(T.DoubleType())
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    """F of the longest common subsequence of words."""
    return pd.Series([lcs_f((x or "").split(), (y or "").split()) for x, y in zip(a, b, strict=True)], dtype="float64")


def common_count(a: Iterable, b: Iterable) -> int:
    """Size of the multiset intersection, by counting."""
    x, y = Counter(a), Counter(b)
    if len(x) > len(y):
        x, y = y, x
    return sum(min(n, y[k]) for k, n in x.items() if k in y)


@F.pandas_udf(T.DoubleType())
def best_f1(predicted: pd.Series, answers: pd.Series, by_char: pd.Series) -> pd.Series:
    """f1_of a prediction and the answer where it is best, of texts in their normal form: words with single spaces between, or (by_char) characters. Counting is linear in
    the text, where arrays in an expression are sorted and walked by it. 0 without answers, null without a prediction."""

    def one(p: str, each, chars: bool) -> float:
        cut = (lambda s: s) if chars else (lambda s: s.split(" ") if s else [])
        own, best = cut(p), 0.0
        for a in map(cut, each):
            n = common_count(own, a)
            best = max(best, 2 * n / (len(own) + len(a)) if n else 0.0)
        return best

    rows = zip(predicted, answers, by_char, strict=True)
    return pd.Series([None if p is None else one(p, () if a is None else [x or "" for x in a], c) for p, a, c in rows], dtype="float64")


def ratio(a: str | None, b: str | None) -> float:
    """Share of matching characters."""
    return difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).ratio()


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def decomposed(a: pd.Series) -> pd.Series:
    return a.map(lambda x: unicodedata.normalize("NFD", x or ""))


@F.pandas_udf(T.ArrayType(T.StringType()))
def listed(a: pd.Series) -> pd.Series:
    """Items of the first bracketed list in an answer; literals only, nothing is evaluated. Without one, the answer itself."""

    def one(x: str | None) -> list[str]:
        found = re.search(r"\[.*\]", x or "", re.S)
        if not found:
            return [x.strip()] if x and x.strip() else []
        try:
            got = ast.literal_eval(re.sub(r"(?<=\w)'(?=\w)", r"\'", found[0]))
        except (ValueError, SyntaxError):
            got = [y.strip().strip("'\"") for y in found[0][1:-1].split(",")]
        return [str(y) for y in got] if isinstance(got, list) else [str(got)]

    return a.map(one)


@F.pandas_udf(T.DoubleType())
def all_aligned(gold: pd.Series, pred: pd.Series) -> pd.Series:
    """1 if every gold answer can have a prediction of its own of which either contains the other: a perfect matching, by augmenting paths."""

    def one(g: list[str], p: list[str]) -> float:
        g, p = list(g if g is not None else []), list(p if p is not None else [])
        held: dict[int, int] = {}

        def place(i: int, tried: set[int]) -> bool:
            for j in range(len(p)):
                if j not in tried and (g[i] in p[j] or p[j] in g[i]):
                    tried.add(j)
                    if j not in held or place(held[j], tried):
                        held[j] = i
                        return True
            return False

        return float(all(place(i, set()) for i in range(len(g))))

    return pd.Series([one(x, y) for x, y in zip(gold, pred, strict=True)], dtype="float64")


def long_metrics(rows: DataFrame, by: list[str], **metrics: Column) -> DataFrame:
    """Metrics in long form: the columns of `by`, metric, value, n."""
    wide = rows.groupBy(*by).agg(*(m.alias(k) for k, m in metrics.items()), F.count("*").alias("n"))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value")) for k in metrics)))
    return wide.select(*by, pairs.alias("x"), "n").select(*by, "x.metric", "x.value", "n")

