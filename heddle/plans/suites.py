"""Queries over whole evaluation suites, reports and run tables. Predictions are whole texts; answers are parts of them or stand for none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions import text as tx
from heddle.operators import answers as an
from heddle.operators import etl, suites
from heddle.plans.answers import predictions
from heddle.plans.etl import scratch
from heddle.plans.registry import query
from heddle.sources.tables import Tables

CLASSES = ("the", "and", "que", "der")


def suite(t: Tables) -> DataFrame:
    """Each document as a prediction of one of the tasks in turn: doc_id, task, length, predicted, answers, classes."""
    tasks, d = list(suites.TASK_METRICS), lambda k: (F.col("doc_id") % k).cast("string")
    metric = F.create_map(*(F.lit(x) for kv in suites.TASK_METRICS.items() for x in kv))
    rows = t.documents.withColumn("task", F.get(F.array(*map(F.lit, tasks)), (F.col("doc_id") % len(tasks)).cast("int"))).withColumn("classes", F.array(*map(F.lit, CLASSES)))
    one = F.when(metric[F.col("task")] == "paragraph", F.concat(F.lit("Paragraph "), d(10))).when(metric[F.col("task")] == "paragraph_zh", F.concat(F.lit("段落"), d(10)))
    one = one.when(metric[F.col("task")] == "number", d(10)).when(metric[F.col("task")] == "classes", F.get("classes", (F.col("doc_id") % len(CLASSES)).cast("int")))
    one = one.otherwise(F.expr("substr(text, 10, 300)"))
    return rows.select("doc_id", "task", F.col("n_chars").alias("length"), F.col("text").alias("predicted"), F.array(one, F.col("lang")).alias("answers"), "classes")


query("longbench_suite")(lambda t: suites.suite_scores(suite(t)).select("doc_id", "task", F.round("score", 6).alias("score")))
query("longbench_suite_means")(lambda t: suites.suite_means(suites.suite_scores(suite(t))))
query("longbench_e_suite_means")(lambda t: suites.suite_means(suites.suite_scores(suite(t)), "length"))
query("code_debug")(
    lambda t: t.documents.select(
        "doc_id", "text", F.expr("substr('ABCDEFGHIJ', CAST(doc_id % 10 AS INT) + 1, 1)").alias("letter"), F.get(tx.tokens(F.col("text")), F.lit(0)).alias("name")
    ).select("doc_id", suites.code_option(F.col("text"), F.col("letter"), F.coalesce("name", F.lit("?"))).alias("score"))
)
query("longdialogue_qa", "SELECT doc_id, (contains(upper(text), upper(substr(text, 40, 9))) AND doc_id % 2 = 0) OR contains(upper(text), upper(lang || ' ')) AS score FROM documents")(
    lambda t: t.documents.select("doc_id", "text", F.array(F.when(F.col("doc_id") % 2 == 0, F.expr("substr(text, 40, 9)")).otherwise(F.lit("\x00")), F.concat("lang", F.lit(" "))).alias("names"))
    .select("doc_id", suites.any_named(F.col("text"), F.col("names")).alias("score"))
)
query("longbook_qa")(
    lambda t: predictions(t)
    .withColumn("zh", F.coalesce(F.col("lang") == "zh", F.lit(False)))
    .select("doc_id", an.best_f1(
        F.when(F.col("zh"), tx.normalize_zh(F.col("predicted"))).otherwise(tx.normalize_answer(F.col("predicted"))),
        F.when(F.col("zh"), F.transform("answers", tx.normalize_zh)).otherwise(F.transform("answers", tx.normalize_answer)), F.col("zh")).alias("score"))
    .select("doc_id", F.round("score", 6).alias("score"))
)
WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda x: x <> '')"
GRAMS = "list_transform(range(1, len({0}) - 2), lambda i: array_to_string({0}[i:i + 3], ' '))"
query(
    "bleu",
    f"""WITH w AS (SELECT doc_id, {WORDS.format('substr(text, 100)')} AS p, {WORDS.format('text')} AS g FROM documents),
u AS (SELECT doc_id, 1 AS n, unnest(p) AS x, 1 AS s FROM w UNION ALL SELECT doc_id, 1, unnest(g), 0 FROM w UNION ALL SELECT doc_id, 4, unnest({GRAMS.format('p')}), 1 FROM w UNION ALL SELECT doc_id, 4, unnest({GRAMS.format('g')}), 0 FROM w),
m AS (SELECT doc_id, n, sum(c) AS c FROM (SELECT doc_id, n, least(sum(s), sum(1 - s)) AS c FROM u GROUP BY doc_id, n, x) GROUP BY doc_id, n),
f AS (SELECT w.doc_id, len(p) AS lp, len(g) AS lg, coalesce(a.c, 0)::DOUBLE AS c1, coalesce(b.c, 0)::DOUBLE AS c4 FROM w LEFT JOIN m a ON a.doc_id = w.doc_id AND a.n = 1 LEFT JOIN m b ON b.doc_id = w.doc_id AND b.n = 4)
SELECT doc_id, round(CASE WHEN lp = 0 OR c1 = 0 THEN 0 ELSE pen * c1 / lp END, 6) AS bleu1, round(CASE WHEN lp = 0 OR c1 = 0 THEN 0 ELSE pen * c4 / greatest(1, lp - 3) END, 6) AS bleu4
FROM (SELECT *, CASE WHEN lp = 0 THEN 0 WHEN lp > lg THEN 1 ELSE exp(1 - lg / lp::DOUBLE) END AS pen FROM f)""",
)(
    lambda t: suites.bleu(t.documents.select("doc_id", F.expr("substr(text, 100)").alias("p"), F.col("text").alias("g")), "doc_id", "p", "g").select(
        "doc_id", F.round("bleu1", 6).alias("bleu1"), F.round("bleu4", 6).alias("bleu4")
    )
)
query(
    "rouge_1_recall",
    f"SELECT doc_id, round(CASE WHEN len(g) = 0 THEN 0 ELSE len(list_intersect(g, p)) / len(g)::DOUBLE END, 6) AS score FROM (SELECT doc_id, {WORDS.format('substr(text, 100)')} AS p, list_distinct({WORDS.format('text')}) AS g FROM documents)",
)(lambda t: an.recall_of_ngrams(t.documents, "doc_id", F.expr("substr(text, 100)"), F.col("text"), 1).withColumn("score", F.round("score", 6)))
query("rouge_l_recall")(lambda t: t.documents.select("doc_id", F.round(suites.rouge_l_recall(F.expr("substr(text, 100)"), "text"), 6).alias("score")))
query(
    "loft_single_f1",
    """WITH k AS (SELECT doc_id, list_filter(string_split_regex(translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''), '\\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the')) AS p FROM documents)
SELECT doc_id, round(CASE WHEN len(list_filter(p, lambda x: x = 'data')) = 0 THEN 0 ELSE 2.0::DOUBLE / (len(p) + 1) END, 6) AS score FROM k""",
)(lambda t: t.documents.select("doc_id", F.round(an.best_f1(tx.normalize_answer(F.col("text")), F.array(F.lit("data")), F.lit(False)), 6).alias("score")))
query("casefold_text", "SELECT doc_id, replace(lower(text), 'ß', 'ss') AS out FROM documents")(lambda t: t.documents.select("doc_id", tx.casefold(F.col("text")).alias("out")))
query("zero_scrolls_metrics", "SELECT source AS task, 'none' AS metric, 0.0::DOUBLE AS value, count(*) AS n FROM documents WHERE false GROUP BY source")(
    lambda t: t.spark.createDataFrame([], "task string, metric string, value double, n long")
)


def language_metrics(t: Tables) -> DataFrame:
    """dataset, metric, value, n: characters and distinct sources of each language."""
    return an.long_metrics(t.documents.withColumnRenamed("lang", "dataset"), ["dataset"], chars=F.sum("n_chars"), sources=F.count_distinct("source"))


LANGS = "l AS (SELECT lang AS dataset, sum(n_chars)::BIGINT AS chars, count(DISTINCT source) AS sources, count(*) AS n FROM documents GROUP BY lang), m AS (SELECT dataset, 'chars' AS metric, chars AS value, n FROM l UNION ALL SELECT dataset, 'sources', sources, n FROM l)"


@query("sink_metrics_json", f"WITH {LANGS} SELECT dataset, metric, value::DOUBLE AS value, n FROM m")
def sink_metrics_json(t: Tables) -> DataFrame:
    """Metrics in long form as JSON lines, and back."""
    path = scratch(t, "metrics")
    language_metrics(t).write.json(path)
    return t.spark.read.schema("dataset string, metric string, value double, n long").json(path)


query(
    "report_markdown",
    f"""WITH {LANGS} SELECT dataset AS section, (row_number() OVER (PARTITION BY dataset ORDER BY metric) + 2)::INT AS line_no, '| ' || metric || ' | ' || value || ' | ' || n || ' |' AS line FROM m
UNION ALL SELECT DISTINCT dataset, line_no, CASE line_no WHEN 0 THEN '## Languages: ' || dataset WHEN 1 THEN '| metric | value | n |' ELSE '|-|-|-|' END FROM m, (VALUES (0), (1), (2)) v(line_no)""",
)(lambda t: etl.report_lines(language_metrics(t).withColumn("value", F.col("value").cast("long")), "Languages"))
CONFIG = {"dataset": "ruler", "press": "knorm", "ratio": 0.5, "fraction": None, "seed": 42}
query("config_yaml", """SELECT * FROM (VALUES ('dataset: "ruler"'), ('press: "knorm"'), ('ratio: 0.5')) v(line)""")(
    lambda t: t.spark.createDataFrame([(x,) for x in etl.config_lines(CONFIG, {"seed": "fraction"})], "line string")
)


@query("scan_jsonl_limit", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 20")
def scan_jsonl_limit(t: Tables) -> DataFrame:
    """JSON lines with a typed schema and a limit, the lowest ids first."""
    path = scratch(t, "jsonl")
    t.documents.select("doc_id", "lang").write.json(path)
    return t.spark.read.schema("doc_id long, lang string").json(path).orderBy("doc_id").limit(20)


query("run_skip", "SELECT doc_id FROM documents WHERE NOT (doc_id % 2 = 0 AND doc_id % 3 = 0)")(
    lambda t: etl.unfinished(
        t.documents.select("doc_id"),
        t.documents.where("doc_id % 2 = 0").select("doc_id", F.lit("predictions").alias("kind")).unionByName(t.documents.where("doc_id % 3 = 0").select("doc_id", F.lit("metrics").alias("kind"))),
        ["doc_id"],
        ("predictions", "metrics"),
    )
)
