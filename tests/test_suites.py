"""Suite scores against plain loops over the rows."""

import difflib
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heddle.functions import text as tx
from heddle.operators import etl, suites
from heddle.plans import QUERIES
from heddle.plans.suites import suite


def normal(s):
    s = "".join(c for c in s.lower() if c not in string.punctuation)
    return re.sub(r"\b(a|an|the)\b", " ", s).split()


def han(s):
    return list(re.sub(r"\s", "", s.lower().translate({ord(c): None for c in tx.PUNCTUATION + tx.CJK_PUNCTUATION})))


def f1(p, g):
    n = sum((Counter(p) & Counter(g)).values())
    return 2 * n / (len(p) + len(g)) if n else 0.0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def rouge(p, g):
    n = lcs(p, g)
    return 2 * n / (len(p) + len(g)) if n else 0.0


def numbers(p, truth):
    found = re.findall("[0-9]+", p)
    return found.count(truth) / len(found) if found else 0.0


def number_in(pattern, a):
    found = re.search(pattern, a)
    return found[1] if found else ""


def classes(p, truth, names):
    named = [c for c in names if c in p and not (c in truth and c != truth)]
    return 1 / len(named) if truth in named else 0.0


def code(p, a):
    lines = [x for x in p.lstrip("\n").split("\n") if not re.search("[`#]|//", x)]
    return difflib.SequenceMatcher(None, lines[0] if lines else "", a, autojunk=False).ratio()


def one(metric, p, a, names):
    if metric in ("paragraph", "paragraph_zh"):
        return numbers(p, number_in(suites.PARAGRAPH[metric], a))
    return {
        "f1": lambda: f1(normal(p), normal(a)),
        "f1_zh": lambda: f1(han(p), han(a)),
        "rouge": lambda: rouge(p.split(), a.split()),
        "rouge_zh": lambda: rouge(list("".join(p.split())), list("".join(a.split()))),
        "classes": lambda: classes(p, a, names),
        "number": lambda: numbers(p, a),
        "code": lambda: code(p, a),
    }[metric]()


ODD = [
    ("passage_count", "of 3, 3 and 4", ["3", "4"]),
    ("passage_retrieval_en", "Paragraph 12 or 7", ["Paragraph 12"]),
    ("passage_retrieval_zh", "段落5", ["段落5"]),
    ("trec", "\n\nNumber of dates\nDate", ["Number", "Date"]),
    ("lcc", "\n# no\n`no`\nx = 1\ny = 2", ["x = 2"]),
    ("dureader", "好 的 吗", ["好吗"]),
    ("multifieldqa_zh", "天气，好。", ["好 天"]),
    ("samsum", "first line\nsecond", ["first second"]),
    ("gov_report", "", ["x"]),
    ("lcc", None, ["x"]),
    ("qasper", "The cat", []),
    ("narrativeqa", None, ["x"]),
]


def test_suite_scores(spark, sf_dir):
    rows = [tuple(r) for r in suite(type("T", (), {"documents": spark.read.parquet(f"{sf_dir}/documents.parquet")})()).select("task", "predicted", "answers", "classes").collect()]
    rows += [(t, p, a, ["Number", "Date", "Num"]) for t, p, a in ODD]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, task string, predicted string, answers array<string>, classes array<string>")
    got = {r["id"]: r["score"] for r in suites.suite_scores(df).collect()}
    for i, (task, p, answers, names) in enumerate(rows):
        p = (p or "").lstrip()
        p = p.split("\n")[0] if task in suites.FIRST_LINE else p
        assert got[i] == pytest.approx(max((one(suites.TASK_METRICS[task], p, a, names) for a in answers), default=0.0)), (task, p[:40])
    assert sum(v > 0 for v in got.values()) > 100


def test_unknown_task_is_an_error(spark):
    df = spark.createDataFrame([("no such", "x", ["x"], ["x"])], "task string, predicted string, answers array<string>, classes array<string>")
    with pytest.raises(Exception, match="no metric for task"):
        suites.suite_scores(df).collect()


def test_suite_means(spark):
    df = spark.createDataFrame([("a", 3999, 1.0), ("a", 4000, 0.5), ("a", 7999, 0.0), ("b", 8000, 0.25)], "task string, length int, score double")
    assert {tuple(r) for r in suites.suite_means(df, "length").collect()} == {("a", "0-4k", 100.0, 1), ("a", "4-8k", 25.0, 2), ("b", "8k+", 25.0, 1)}
    assert {tuple(r) for r in suites.suite_means(df).collect()} == {("a", 50.0, 3), ("b", 25.0, 1)}


@pytest.mark.parametrize(
    ("answer", "right"),
    [("It is B\nor C", False), ("C", True), ("so B, then C", True), ("*C* is it", True), ("run_it fails", True), ("I think the answer is: run_it", True), ("answer: Csomething", True), ("Answer: D", False), ("answer is:", False), ("", False), (None, False)],
)
def test_code_option(spark, answer, right):
    df = spark.createDataFrame([(answer, "C", "run_it")], "p string, letter string, name string")
    assert df.select(suites.code_option(F.col("p"), F.col("letter"), F.col("name"))).first()[0] is right


def test_recall_of_common_sequence(spark, sf_dir):
    got = {r["doc_id"]: r["score"] for r in QUERIES["rouge_l_recall"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id % 7 = 0").collect():
        g = (r["text"] or "").split()
        assert got[r["doc_id"]] == pytest.approx(lcs((r["text"] or "")[99:].split(), g) / len(g) if g else 0.0, abs=1e-6)


def test_book_questions(spark, sf_dir):
    got = {r["doc_id"]: r["score"] for r in QUERIES["longbook_qa"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        s, i = r["text"] or "", r["doc_id"]
        answers, cut = [s[4:16] if i % 3 == 0 else f"no{i}", s[29:37]], han if r["lang"] == "zh" else normal
        assert got[i] == pytest.approx(max(f1(cut(s), cut(a)) for a in answers), abs=1e-6)


def test_bleu_of_odd_rows(spark):
    rows = [(1, "", "a b"), (2, "a b", ""), (3, None, None), (4, "a a a", "a b"), (5, "x y", "a b"), (6, "a b c d e", "a b c d e f")]
    got = {r["id"]: (r["bleu1"], r["bleu4"]) for r in suites.bleu(spark.createDataFrame(rows, "id int, p string, g string"), "id", "p", "g").collect()}
    short = 2.718281828459045 ** (1 - 6 / 5)
    assert [got[i] for i in (1, 2, 3, 5)] == [(0.0, 0.0)] * 4
    assert got[4] == pytest.approx((1 / 3, 0.0)) and got[6] == pytest.approx((short, short))


def test_config_lines():
    config = {"a": 1, "b": None, "c": "ü: x", "d": 2}
    assert etl.config_lines(config) == ["a: 1", 'c: "ü: x"', "d: 2"] and etl.config_lines(config, {"d": "b"}) == ["a: 1", 'c: "ü: x"']
