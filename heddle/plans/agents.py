"""Queries over agent transcripts, token samples, named data sets and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions import text as tx
from heddle.operators import etl, retrieval, sampling, transcripts
from heddle.operators.progress import Progress
from heddle.plans.etl import scratch
from heddle.plans.registry import query
from heddle.sources import datasets
from heddle.sources.tables import Tables

#: Replies of the fixture transcripts by (conv_id * 3 + turn) % 7; {t}: the turn's own text, {f}: six characters of the conversation's first turn, {o}: of the turn before.
REPLIES = {
    0: "{t}",
    1: "```python\nprint(context)\n```\n{t}",
    2: "I think FINAL(\"{f}\") is it",
    3: "```repl\nx = find(context)\nFINAL('{o}')\n```\n```py\nprint(1)\n```",
    4: "```py\nx = 1\nprint(x)\n```",
    5: "```\nprint(2)\n``` ```python\nFINAL(x)```",
    6: "FINAL('no such words')",
}


def recorded(t: Tables) -> DataFrame:
    """Transcripts made from the conversations: the assistant's turns become replies with code and answers, all other turns stay. The shape's number is a
    remainder of decimals, since three times an id need not fit a long."""
    within = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.withColumns({"first": F.first("text").over(within), "before": F.lag("text").over(within)})
    fill = {"t": F.col("text"), "f": F.expr("translate(substr(first, 3, 6), '\"''()', '    ')"), "o": F.expr("translate(substr(coalesce(before, ''), 3, 6), '\"''()', '    ')")}
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    rows = rows.withColumn("number", ((wide("conv_id") * 3 + wide("turn")) % 7).cast("int"))
    number, reply = F.col("number"), None
    for k, shape in REPLIES.items():
        text = F.lit(shape)
        for name, value in fill.items():
            text = F.replace(text, F.lit("{" + name + "}"), value) if "{" + name + "}" in shape else text
        reply = F.when(number == k, text) if reply is None else reply.when(number == k, text)
    return rows.select("conv_id", "turn", "role", F.when(F.col("role") == "assistant", reply).otherwise(F.col("text")).alias("text"))


def _reply_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    fill = {"t": "text", "f": "translate(substr(f, 3, 6), '\"''()', '    ')", "o": "translate(substr(coalesce(o, ''), 3, 6), '\"''()', '    ')"}
    cases = []
    for k, shape in REPLIES.items():
        text = quoted(shape)
        for name, value in fill.items():
            text = f"replace({text}, '{{{name}}}', {value})" if "{" + name + "}" in shape else text
        cases.append(f"WHEN {k} THEN {text}")
    return "CASE (conv_id * 3 + turn) % 7 " + " ".join(cases) + " END"


_Q = transcripts.QUOTE.replace("'", "''")
TRANSCRIPT_SQL = f"""WITH c AS (SELECT *, first(text) OVER w AS f, lag(text) OVER w AS o FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT conv_id, turn, role = 'assistant' AS reply, CASE WHEN role = 'assistant' THEN {_reply_sql()} ELSE text END AS text FROM c),
s AS (SELECT *, sum(reply::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS step, regexp_extract_all(text, '(?s)```(?:python|repl|py)?[ \\t]*\\n?(.*?)```', 1) AS b FROM t),
l AS (SELECT *, regexp_extract_all(CASE WHEN len(b) > 0 THEN b[1] ELSE text END, '(?s)FINAL\\(\\s*{_Q}(.*?){_Q}\\s*\\)', 1)[1] AS lit FROM s),
k AS (SELECT conv_id, step, len(b) AS b, CASE WHEN len(b) > 0 THEN CASE WHEN lit IS NOT NULL THEN 'cl' WHEN regexp_matches(b[1], '\\bFINAL(_VAR)?\\(') THEN 'cf' ELSE 'c' END WHEN lit IS NOT NULL THEN 'pl' WHEN regexp_matches(text, 'FINAL_VAR\\(\\s*["'']\\w+["'']\\s*\\)') THEN 'pv' ELSE 'p' END AS kind,
  CASE WHEN len(b) > 0 THEN lit WHEN lit IS NOT NULL THEN regexp_replace(lit, '^\\s+|\\s+$', '', 'g') WHEN NOT regexp_matches(text, 'FINAL_VAR\\(') THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS answer FROM l WHERE reply),
seen AS (SELECT conv_id, step AS sx, text FROM s WHERE NOT reply AND (step = 0 OR EXISTS (SELECT 1 FROM k WHERE k.conv_id = s.conv_id AND k.step = s.step AND kind[1] = 'c'))),
g AS (SELECT k.*, EXISTS (SELECT 1 FROM seen WHERE seen.conv_id = k.conv_id AND (sx < step OR (sx = step AND kind = 'cl')) AND contains(seen.text, answer) AND (answer <> '' OR kind = 'cl')) OR (kind = 'cl' AND answer = '') AS found FROM k),
n AS (SELECT *, kind = 'p' OR (kind IN ('cl', 'pl') AND NOT found) AS nudge FROM g),
r AS (SELECT *, sum(nudge::INT) OVER w AS nudges, sum((kind[1] = 'c')::INT) OVER w AS code_steps, sum(greatest(b - 1, 0)) OVER w AS ignored FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY step)),
e AS (SELECT *, CASE WHEN nudge AND nudges > 2 THEN CASE kind WHEN 'p' THEN 'gave_up_no_code' ELSE 'ungrounded_final' END WHEN nudge THEN NULL WHEN kind IN ('cl', 'cf') THEN 'final_called' WHEN kind = 'pl' THEN 'final_in_prose' WHEN kind = 'pv' THEN 'final_var_in_prose' END AS fin FROM r),
x AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY fin IS NULL, CASE WHEN fin IS NULL THEN -step ELSE step END) = 1),
a AS (SELECT DISTINCT conv_id FROM s)
SELECT a.conv_id, coalesce(fin, 'max_steps') AS "end", coalesce(x.step, 0)::BIGINT AS steps, coalesce(code_steps, 0)::BIGINT AS code_steps, coalesce(nudges, 0)::BIGINT AS nudges, coalesce(ignored, 0)::BIGINT AS ignored_blocks,
  coalesce((SELECT sum(length(text)) FROM seen WHERE seen.conv_id = a.conv_id AND sx BETWEEN 1 AND coalesce(x.step, 0)), 0)::BIGINT AS observed,
  CASE WHEN fin IS NOT NULL AND fin <> 'ungrounded_final' THEN answer END AS answer, CASE WHEN fin IS NOT NULL AND fin <> 'ungrounded_final' AND kind IN ('cl', 'pl') THEN found::VARCHAR END AS grounded
FROM a LEFT JOIN x USING (conv_id)"""
query("transcript_replay", TRANSCRIPT_SQL)(lambda t: transcripts.replay(recorded(t)).withColumn("grounded", F.col("grounded").cast("string")))
query("transcript_ends", f"SELECT \"end\", count(*) AS n, round(avg(steps), 6) AS steps, CAST(sum(nudges) AS BIGINT) AS nudges FROM ({TRANSCRIPT_SQL}) GROUP BY \"end\"")(
    lambda t: transcripts.replay(recorded(t)).groupBy("end").agg(F.count("*").alias("n"), F.round(F.avg("steps"), 6).alias("steps"), F.sum("nudges").alias("nudges"))
)


# --- samples of tokens ---------------------------------------------------------------------------------------------------

SAMPLE = 5
query(
    "token_subsample",
    f"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS token, generate_subscripts(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), 1) - 1 AS pos FROM documents)
SELECT doc_id, pos::BIGINT AS pos, token FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY substr(md5(concat_ws(':', '5', doc_id, pos)), 1, 8), pos) <= {SAMPLE}""",
)(lambda t: sampling.sample_tokens(t.documents.select("doc_id", tx.tokens(F.col("text")).alias("tokens")), "doc_id", SAMPLE, "5"))

# --- progress --------------------------------------------------------------------------------------------------------------


@query(
    "stage_progress",
    """WITH d AS (SELECT * FROM documents), b AS (SELECT * FROM d WHERE n_chars > 500 AND n_chars < 5000), h AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 20)
SELECT 0 AS stage, 'scan' AS name, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS chars FROM d UNION ALL SELECT 1, 'band', count(*), CAST(sum(n_chars) AS BIGINT) FROM b UNION ALL SELECT 2, 'heads', count(*), CAST(sum(n_chars) AS BIGINT) FROM h""",
)
def stage_progress(t: Tables) -> DataFrame:
    """Rows and characters that each stage of one job lets through, as the job itself counts them."""
    seen = Progress()
    rows = seen.stage(t.documents, "scan", chars=F.sum("n_chars"))
    rows = seen.stage(rows.where((F.col("n_chars") > 500) & (F.col("n_chars") < 5000)), "band", chars=F.sum("n_chars"))
    rows = seen.stage(etl.head_per_group(rows, "source", ["doc_id"], 20), "heads", chars=F.sum("n_chars"))
    rows.write.format("noop").mode("overwrite").save()
    return seen.table(t.spark)


# --- data sets by name ---------------------------------------------------------------------------------------------------


@query("scan_named", "SELECT 'probe' AS task, item_id AS id, text AS context, length(text) AS n FROM benchmark UNION ALL SELECT lang, doc_id, text, length(text) FROM documents WHERE lang = 'de'")
def scan_named(t: Tables) -> DataFrame:
    """Two data sets by name in the common shape; the task of the second one reaches its scan as a filter."""
    both = datasets.scan(t.spark, "probes", t.sf_dir).unionByName(datasets.scan(t.spark, "corpus", t.sf_dir, task="de"))
    return both.select("task", "id", "context", F.length("context").alias("n"))


@query("scan_named_lines", "SELECT source AS task, doc_id AS id, text AS context FROM documents")
def scan_named_lines(t: Tables) -> DataFrame:
    """JSON lines of one file a task, with blank lines between, read back by name."""
    path = scratch(t, "lines")
    line = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("text").alias("context")))
    t.documents.select(F.concat(line, F.lit("\n")).alias("value"), F.col("source").alias("task")).write.partitionBy("task").text(path)
    return datasets.scan(t.spark, "lines", path).select("task", "id", "context")


# --- retrieval answers -----------------------------------------------------------------------------------------------------

_WORD = "coalesce(nullif(regexp_extract(text, '{0}', 1), ''), 'none')"
W1, W2 = _WORD.format("([a-z]{3,})"), _WORD.format("[a-z]{3,}[^a-z]+([a-z]{3,})")
ANSWERED_SQL = f"""WITH w AS (SELECT doc_id, {W1} AS w1, {W2} AS w2 FROM documents),
a AS (SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN [w1, w2 || chr(39) || 's'] WHEN 2 THEN [w1 || ' ' || w2] WHEN 3 THEN [w2] WHEN 4 THEN [''] ELSE [] END AS p, CASE doc_id % 4 WHEN 0 THEN [w1] WHEN 1 THEN ['the ' || w2, w1 || 'x'] WHEN 2 THEN [w2 || 's', w1, w1] ELSE [] END AS g FROM w),
n AS (SELECT doc_id, list_transform(p, lambda x: trim(regexp_replace(regexp_replace(replace(x, chr(39), ''), '\\b(a|an|the)\\b', ' ', 'g'), ' +', ' ', 'g'))) AS p, list_transform(g, lambda x: trim(regexp_replace(regexp_replace(x, '\\b(a|an|the)\\b', ' ', 'g'), ' +', ' ', 'g'))) AS g FROM a)"""


def answered(t: Tables) -> DataFrame:
    """Model answers around words of the documents, in five shapes, and right answers in four."""
    w = t.documents.select("doc_id", F.expr(W1).alias("w1"), F.expr(W2).alias("w2"))
    by, right = F.col("doc_id") % 5, F.col("doc_id") % 4
    said = F.when(by == 1, F.concat(F.lit("Well.\n**Final Answer:** ['"), "w1", F.lit("', '"), "w2", F.lit("'s']\n[\"later\"]")))
    said = said.when(by == 2, F.concat(F.lit("so\nFinal answer:  "), "w1", F.lit(" "), "w2", F.lit("\nfinal answer: other")))
    said = said.when(by == 3, F.concat(F.lit("[broken\n]odd[\n[f(x)]\nlist `[\""), "w2", F.lit("\"]` end\nFinal Answer: "), "w1")).when(by == 4, F.lit("[]\nfinal answer: :"))
    gold = F.when(right == 0, F.array("w1")).when(right == 1, F.array(F.concat(F.lit("The "), "w2"), F.lit(None), F.concat("w1", F.lit("x")))).when(right == 2, F.array(F.concat("w2", F.lit("s")), "w1", "w1"))
    return w.select("doc_id", said.alias("predicted"), gold.alias("answers"))


query(
    "retrieval_single",
    f"""{ANSWERED_SQL}, b AS (SELECT doc_id, p[1] AS p, list_filter(string_split(p[1], ' '), lambda x: x <> '') AS pt, g, len(p) > 0 AND len(g) > 0 AS ok FROM n)
SELECT doc_id, CASE WHEN ok THEN list_max(list_transform(g, lambda x: CASE WHEN x = p THEN 1.0::DOUBLE ELSE 0 END)) ELSE 0 END AS em, CASE WHEN ok THEN list_max(list_transform(g, lambda x: CASE WHEN contains(p, x) THEN 1.0::DOUBLE ELSE 0 END)) ELSE 0 END AS subspan_em,
  round(CASE WHEN ok THEN list_max(list_transform(g, lambda x: coalesce(2.0::DOUBLE * list_sum(list_transform(list_distinct(pt), lambda w: least(len(list_filter(pt, lambda y: y = w)), len(list_filter(string_split(x, ' '), lambda y: y = w))))) / nullif(len(pt) + len(list_filter(string_split(x, ' '), lambda y: y <> '')), 0), 0))) ELSE 0 END, 6) AS f1 FROM b""",
)(lambda t: retrieval.single_scores(answered(t), "doc_id").withColumn("f1", F.round("f1", 6)))
query(
    "retrieval_multi",
    f"""{ANSWERED_SQL} SELECT doc_id, CASE WHEN len(p) > 0 AND len(g) > 0 AND list_sort(list_distinct(p)) = list_sort(list_distinct(g)) THEN 1.0::DOUBLE ELSE 0 END AS em,
  round(CASE WHEN len(p) > 0 AND len(g) > 0 THEN len(list_intersect(list_distinct(p), g)) / len(g)::DOUBLE ELSE 0 END, 6) AS coverage FROM n""",
)(lambda t: retrieval.multi_scores(answered(t), "doc_id").select("doc_id", "em", F.round("coverage", 6).alias("coverage")))
