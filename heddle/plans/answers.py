"""Queries over text functions and answer scoring. Predictions come from documents, with hits and misses set by the id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions import text as tx
from heddle.operators import answers as an
from heddle.plans.registry import query
from heddle.sources.tables import Tables

P = """p AS (SELECT doc_id, source AS task, text AS predicted,
  [CASE WHEN doc_id % 3 = 0 THEN substr(text, 5, 12) ELSE 'no' || doc_id END, substr(text, 30, 8)] AS answers, n_chars, lang FROM documents)"""


def predictions(t: Tables) -> DataFrame:
    """The rows of P: whole texts as predictions."""
    first = F.when(F.col("doc_id") % 3 == 0, F.substring("text", 5, 12)).otherwise(F.concat(F.lit("no"), F.col("doc_id").cast("string")))
    return t.documents.select("doc_id", F.col("source").alias("task"), F.col("text").alias("predicted"), F.array(first, F.substring("text", 30, 8)).alias("answers"), "n_chars", "lang")


def over_text(name: str, sql: str, f, source: str = "text") -> None:
    query(name, f"SELECT doc_id, {sql} AS out FROM (SELECT doc_id, {source} AS s FROM documents)")(
        lambda t: t.documents.select("doc_id", F.expr(source.replace("\\", "\\\\")).alias("s")).select("doc_id", f(F.col("s")).alias("out"))
    )


PUNCT = tx.PUNCTUATION.replace("'", "''")


def words_sql(s: str, var: str = "x") -> str:
    return "list_filter(string_split_regex(translate(lower(" + s + "), '" + PUNCT + "', ''), '\\s+'), lambda " + var + ": " + var + " NOT IN ('', 'a', 'an', 'the'))"


WHOLE = "text"
over_text("norm_answer", f"array_to_string({words_sql('s')}, ' ')", tx.normalize_answer, WHOLE)
over_text("norm_answer_zh", "regexp_replace(translate(lower(s), '" + (tx.PUNCTUATION + tx.CJK_PUNCTUATION).replace("'", "''") + "', ''), '\\s+', '', 'g')", tx.normalize_zh, WHOLE)
over_text("strip_control", "trim(regexp_replace(trim(s), '[\\x00-\\x1f]', '', 'g'))", tx.strip_control, WHOLE)
over_text("tokens", "len(list_filter(string_split_regex(s, '\\s+'), lambda x: x <> ''))::INT", lambda s: F.size(tx.tokens(s)))
over_text("digits_all", "array_to_string(regexp_extract_all(s, '[0-9]+'), ',')", lambda s: F.array_join(tx.digits_all(s), ","))
over_text("first_int", "regexp_extract(s, '[0-9]+')", tx.first_int)
ONE_LINE = "replace(text, '\n', ' ') || ' ' || substr('ABCDE', CAST(doc_id % 6 AS INT) + 1, 1) || ' x'"
over_text("last_choice", "coalesce(list_last(list_filter(string_split_regex(s, '[^A-Za-z0-9_\\x80-\\x{10FFFF}]+'), lambda x: regexp_full_match(x, '[A-J]'))), '')", tx.last_choice, ONE_LINE)
HEXED = "'id ' || substr(md5(CAST(doc_id AS STRING)), 1, CASE WHEN doc_id % 4 = 0 THEN 13 ELSE 12 END) || ', v_' || substr(md5(CAST(doc_id + 1 AS STRING)), 1, 12) || '.'"
over_text(
    "hex_ids",
    "array_to_string(list_transform(list_filter(string_split_regex(lower(s), '[^a-z0-9_]+'), lambda x: regexp_full_match(x, '(v_)?[a-f0-9]{12}')), lambda x: right(x, 12)), ',')",
    lambda s: F.array_join(tx.hex_ids(s), ","),
    HEXED,
)
BOX = "CASE WHEN doc_id % 3 = 0 THEN text ELSE 'so boxed{' || doc_id || '} or boxed{' || (doc_id + 1) || '}' END"
over_text("boxed_first", "CASE WHEN contains(s, 'boxed{') THEN split_part(split_part(s, 'boxed{', 2), '}', 1) END", lambda s: tx.boxed(s, False), BOX)
over_text("boxed_last", "split_part(list_last(string_split(s, 'boxed{')), '}', 1)", lambda s: tx.boxed(s, True), BOX)
over_text("first_code_line", "coalesce(list_filter(string_split(ltrim(s, '\n'), '\n'), lambda x: NOT regexp_matches(x, '[`#]|//'))[1], '')", tx.first_code_line)
over_text("remove_suffix", "regexp_replace(s, '-suffix$', '')", lambda s: F.regexp_replace(s, "-suffix$", ""), "lang || CASE WHEN doc_id % 2 = 0 THEN '-suffix' ELSE '' END")
SQ = "trim(regexp_replace(s, '\\s+', ' ', 'g'))"
over_text("preview", f"CASE WHEN length({SQ}) > 160 THEN left({SQ}, 157) || '...' ELSE {SQ} END", tx.preview)
over_text("obs_truncate", "CASE WHEN length(s) > 200 THEN left(s, 100) || ' [...] ' || right(s, 100) ELSE s END", lambda s: tx.head_and_tail(s, 200, " [...] "))
over_text("token_count", "greatest(1, length(s) // 4)", tx.token_count)
over_text("truncate_context", "substr(s, 1, 128)", lambda s: F.substring(s, 1, 128))
over_text("needle_chars", "substr(s, 1, length(s) // 3) || '<needle>' || substr(s, length(s) // 3 + 1)", lambda s: tx.insert_at(s, F.lit("<needle>"), F.floor(F.length(s) / 3).cast("int")), WHOLE)
over_text("slice_by_index", "substr(s, length(s) // 4 + 1, length(s) // 2 - length(s) // 4)", lambda s: F.substring(s, F.floor(F.length(s) / 4).cast("int") + 1, (F.floor(F.length(s) / 2) - F.floor(F.length(s) / 4)).cast("int")), WHOLE)
over_text("retrieval_words", "array_to_string(list_filter(string_split_regex(translate(s, '\n:\"''.,?!{}', repeat(' ', 10)), '\\s+'), lambda x: x <> ''), ' ')", lambda s: F.array_join(tx.tokens(tx.spaced(s, "\n:\"'.,?!{}")), " "), WHOLE)
query("norm_answer_nfd")(lambda t: t.documents.select("doc_id", tx.normalize_answer(an.decomposed(F.col("text"))).alias("out")))

query(
    "ruler_split",
    """SELECT doc_id, regexp_extract(s, '(?s)^(.*)(What is .*?)( Answer:.*)$', 1) AS context, regexp_extract(s, '(?s)^(.*)(What is .*?)( Answer:.*)$', 2) AS question, regexp_extract(s, '(?s)^(.*)(What is .*?)( Answer:.*)$', 3) AS answer_prefix
FROM (SELECT doc_id, text || ' What is it? No. What is ' || doc_id || '? Answer: it is' AS s FROM documents)""",
)(
    lambda t: t.documents.select("doc_id", F.concat("text", F.lit(" What is it? No. What is "), F.col("doc_id").cast("string"), F.lit("? Answer: it is")).alias("s")).select(
        "doc_id", *(F.regexp_extract("s", r"(?s)^(.*)(What is .*?)( Answer:.*)$", i).alias(c) for i, c in enumerate(("context", "question", "answer_prefix"), 1))
    )
)

# --- scores ------------------------------------------------------------------------------------------------------------

CLEAN = "trim(regexp_replace(trim(predicted), '[\\x00-\\x1f]', '', 'g'))"
query(
    "ruler_score",
    f"""WITH {P}, c AS (SELECT CASE WHEN doc_id % 20 < 5 THEN 'qa_' ELSE 'niah_' END || task AS task, {CLEAN} AS p, answers FROM p),
s AS (SELECT task, list_sum(list_transform(answers, lambda a: CASE WHEN contains(lower(p), lower(a)) THEN 1.0::DOUBLE ELSE 0 END)) AS hits FROM c)
SELECT task, 'string_match' AS metric, round(avg(CASE WHEN starts_with(task, 'qa') THEN least(hits, 1) ELSE hits / 2 END) * 100, 2) AS value, count(*) AS n FROM s GROUP BY task""",
)(
    lambda t: an.long_metrics(
        predictions(t)
        .withColumn("task", F.concat(F.when(F.col("doc_id") % 20 < 5, "qa_").otherwise("niah_"), "task"))
        .withColumn("p", tx.strip_control(F.col("predicted")))
        .withColumn("s", F.when(F.startswith("task", F.lit("qa")), an.any_contained(F.col("p"), F.col("answers"))).otherwise(an.share_contained(F.col("p"), F.col("answers")))),
        ["task"],
        string_match=F.round(F.avg("s") * 100, 2),
    )
)


def pred_query(name: str, score_sql: str, score, where: str = "") -> None:
    """A score for each prediction row."""
    query(name, f"WITH {P} SELECT doc_id, {score_sql} AS score FROM p")(lambda t: predictions(t).select("doc_id", score(F.col("predicted"), F.col("answers")).alias("score")))


PT = words_sql("predicted")
query(
    "token_f1",
    f"""WITH {P}, k AS (SELECT doc_id, {PT} AS pt, {words_sql('answers[1]')} AS gt FROM p),
pc AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(pt) AS w FROM k) GROUP BY ALL), gc AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(gt) AS w FROM k) GROUP BY ALL),
c AS (SELECT doc_id, sum(least(pc.n, gc.n)) AS c FROM pc JOIN gc USING (doc_id, w) GROUP BY ALL)
SELECT k.doc_id, round(CASE WHEN c IS NULL THEN 0 ELSE 2 * (c / len(pt)) * (c / len(gt)) / (c / len(pt) + c / len(gt)) END, 6) AS score FROM k LEFT JOIN c ON k.doc_id = c.doc_id""",
)(
    lambda t: predictions(t)
    .select("doc_id", F.round(an.best_f1(tx.normalize_answer(F.col("predicted")), F.array(tx.normalize_answer(F.get("answers", F.lit(0)))), F.lit(False)), 6).alias("score"))
)
query(
    "zh_char_f1",
    """WITH k AS (SELECT doc_id, string_split(text, '') AS p, string_split(substr(text, 20), '') AS g FROM documents),
pc AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(p) AS w FROM k) GROUP BY ALL), gc AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(g) AS w FROM k) GROUP BY ALL),
c AS (SELECT doc_id, sum(least(pc.n, gc.n)) AS c FROM pc JOIN gc USING (doc_id, w) GROUP BY ALL)
SELECT k.doc_id, round(CASE WHEN c IS NULL THEN 0 ELSE 2 * (c / len(p)) * (c / len(g)) / (c / len(p) + c / len(g)) END, 6) AS score FROM k LEFT JOIN c ON k.doc_id = c.doc_id""",
)(
    lambda t: t.documents.select("doc_id", F.round(an.best_f1(tx.filled(F.col("text")), F.array(F.expr("substr(text, 20)")), F.lit(True)), 6).alias("score"))
)
NUM = "'Paragraph ' || (doc_id % 7) || ' or ' || (doc_id % 3) || ', not ' || (doc_id % 5)"
query(
    "number_share",
    f"SELECT doc_id, round(list_sum(list_transform(x, lambda v: CASE WHEN v = CAST(doc_id % 3 AS VARCHAR) THEN 1.0::DOUBLE ELSE 0 END)) / len(x), 6) AS score FROM (SELECT doc_id, regexp_extract_all({NUM}, '[0-9]+') AS x FROM documents)",
)(lambda t: t.documents.select("doc_id", F.round(an.number_share(F.expr(NUM), (F.col("doc_id") % 3).cast("string")), 6).alias("score")))
CLASSES = ("the", "th", "and", "an", "que", "der")
query(
    "classification_score",
    f"""SELECT doc_id, round(CASE WHEN list_contains(m, g) THEN 1.0::DOUBLE / len(m) ELSE 0 END, 6) AS score FROM (SELECT doc_id, g, list_filter({list(CLASSES)}, lambda c: contains(p, c) AND NOT (contains(g, c) AND c <> g)) AS m
FROM (SELECT doc_id, text AS p, {list(CLASSES)}[CAST(doc_id % 6 AS INT) + 1] AS g FROM documents))""",
)(
    lambda t: t.documents.withColumn("c", F.array(*map(F.lit, CLASSES)))
    .withColumn("g", F.get("c", (F.col("doc_id") % 6).cast("int")))
    .select("doc_id", F.round(an.classification(F.col("text"), F.col("g"), F.col("c")), 6).alias("score"))
)
query(
    "longbench_e_buckets",
    f"WITH {P} SELECT CASE WHEN n_chars < 1000 THEN '0-1k' WHEN n_chars < 4000 THEN '1-4k' ELSE '4k+' END AS bucket, round(100 * avg(CASE WHEN contains(lower(predicted), lower(answers[1])) THEN 1.0::DOUBLE ELSE 0 END), 2) AS score, count(*) AS n FROM p GROUP BY ALL",
)(
    lambda t: predictions(t)
    .select(F.when(F.col("n_chars") < 1000, "0-1k").when(F.col("n_chars") < 4000, "1-4k").otherwise("4k+").alias("bucket"), an.contains(F.get("answers", F.lit(0)), F.col("predicted")).cast("double").alias("s"))
    .groupBy("bucket")
    .agg(F.round(100 * F.avg("s"), 2).alias("score"), F.count("*").alias("n"))
)
query(
    "longbench_score",
    f"""WITH {P}, q AS (SELECT task, CASE WHEN task IN ('src1', 'src2') THEN split_part(ltrim(predicted, '\n'), '\n', 1) ELSE predicted END AS p, answers FROM p)
SELECT task, round(100 * avg(list_max(list_transform(answers, lambda a: CASE WHEN contains(lower(p), lower(a)) THEN 1.0::DOUBLE ELSE 0 END))), 2) AS score FROM q GROUP BY task""",
)(
    lambda t: predictions(t)
    .withColumn("p", F.when(F.col("task").isin("src1", "src2"), F.get(F.split(F.regexp_replace("predicted", "^\n+", ""), "\n"), F.lit(0))).otherwise(F.col("predicted")))
    .groupBy("task")
    .agg(F.round(100 * F.avg(F.array_max(F.transform("answers", lambda a: an.contains(a, F.col("p")).cast("double")))), 2).alias("score"))
)
LB2 = "replace('The correct answer is *(' || substr('ABCD', CAST(d.doc_id % 4 AS INT) + 1, 1) || ')*', '*', '')"
query(
    "lbv2_grouping_sets",
    f"""WITH s AS (SELECT CASE WHEN quality IS NULL THEN 'unknown' WHEN quality = 1 THEN 'easy' ELSE 'hard' END AS difficulty, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END AS length,
CASE WHEN contains({LB2}, 'The correct answer is (' || substr('ABCD', CAST(d.doc_id % 3 AS INT) + 1, 1) || ')') THEN 1.0::DOUBLE ELSE 0 END AS s FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT difficulty, length, round(avg(s), 6) AS score, count(*) AS n FROM s GROUP BY GROUPING SETS ((), (difficulty), (length))""",
)(
    lambda t: t.documents.alias("d")
    .join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    .select(
        F.when(F.col("quality").isNull(), "unknown").when(F.col("quality") == 1, "easy").otherwise("hard").alias("difficulty"),
        F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long").alias("length"),
        F.contains(F.expr(LB2), F.concat(F.lit("The correct answer is ("), F.expr("substr('ABCD', CAST(d.doc_id % 3 AS INT) + 1, 1)"), F.lit(")"))).cast("double").alias("s"),
    )
    .groupingSets([[], ["difficulty"], ["length"]], "difficulty", "length")
    .agg(F.round(F.avg("s"), 6).alias("score"), F.count("*").alias("n"))
)
for name, last, sql in (
    ("math500", False, "CASE WHEN contains(s, 'boxed{') THEN split_part(split_part(s, 'boxed{', 2), '}', 1) END"),
    ("aime25", True, "split_part(list_last(string_split(s, 'boxed{')), '}', 1)"),
):
    query(
        name,
        f"""WITH b AS (SELECT doc_id, {BOX} AS s FROM documents), e AS (SELECT CAST(doc_id - doc_id % 2 + 1 AS VARCHAR) AS g, {sql} AS x FROM b)
SELECT count(*) FILTER (coalesce(x = g, FALSE)) AS correct, count(x) AS answered, round(avg(CASE WHEN x = g THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, count(*) AS total FROM e""",
    )(
        lambda t, last=last: t.documents.select(tx.boxed(F.expr(BOX), last).alias("x"), (F.col("doc_id") - F.col("doc_id") % 2 + 1).cast("string").alias("g"))
        .agg(F.count_if(F.coalesce(F.col("x") == F.col("g"), F.lit(False))).alias("correct"), F.count("x").alias("answered"), F.round(F.avg(F.when(F.col("x") == F.col("g"), 1.0).otherwise(0.0)), 6).alias("accuracy"), F.count("*").alias("total"))
    )
pred_query(
    "infinite_kv",
    "list_contains(list_filter(string_split_regex(translate(predicted, '\n:\"''.,?!{}', repeat(' ', 10)), '\\s+'), lambda x: x <> ''), CASE WHEN doc_id % 2 = 0 THEN 'the' ELSE answers[2] END)",
    lambda p, a: F.array_contains(tx.tokens(tx.spaced(p, "\n:\"'.,?!{}")), F.when(F.col("doc_id") % 2 == 0, "the").otherwise(F.get(a, F.lit(1)))),
)
pred_query(
    "infinite_passkey",
    "regexp_extract('key ' || (doc_id % 10) || ' ' || predicted, '[0-9]+') = CAST(doc_id % 5 AS VARCHAR)",
    lambda p, a: tx.first_int(F.concat(F.lit("key "), (F.col("doc_id") % 10).cast("string"), F.lit(" "), p)) == (F.col("doc_id") % 5).cast("string"),
)
RUN = "'it gives: ' || (doc_id % 10) || CASE WHEN doc_id % 4 = 0 THEN ' ok' ELSE '.' END"
query(
    "infinite_code_run",
    f"SELECT doc_id, coalesce(TRY_CAST(list_last(list_filter(string_split(translate({RUN}, '\n.`''\":', '      '), ' '), lambda x: x <> '')) AS BIGINT) = doc_id % 5, FALSE) AS score FROM documents",
)(lambda t: t.documents.select("doc_id", F.coalesce(F.element_at(tx.tokens(tx.spaced(F.expr(RUN), "\n.`'\":")), -1).try_cast("long") == F.col("doc_id") % 5, F.lit(False)).alias("score")))
FIND = "'x = ' || (doc_id % 10) || CASE WHEN doc_id % 2 = 0 THEN '.5' ELSE '' END || ' or 3'"
query("math_find", f"SELECT doc_id, TRY_CAST(regexp_extract({FIND}, '[0-9]+\\.[0-9]+|[0-9]+') AS DOUBLE) = (doc_id % 5) + 0.5::DOUBLE AS score FROM documents")(
    lambda t: t.documents.select("doc_id", (F.regexp_extract(F.expr(FIND), r"[0-9]+\.[0-9]+|[0-9]+", 0).try_cast("double") == (F.col("doc_id") % 5) + 0.5).alias("score"))
)
CALC = "(doc_id % 2) || ', ' || (doc_id % 3) || ' then ' || (doc_id % 4)"
query(
    "math_calc",
    f"""SELECT doc_id, round((CASE WHEN x[1] <> 1 THEN 0 WHEN x[2] <> 2 THEN 1 WHEN x[3] <> 3 THEN 2 ELSE 3 END) / 3.0::DOUBLE, 6) AS score FROM (SELECT doc_id, list_transform(regexp_extract_all({CALC}, '[0-9]+'), lambda v: CAST(v AS BIGINT)) AS x FROM documents)""",
)(lambda t: t.documents.select("doc_id", F.round(an.matching_prefix(F.expr(CALC), F.array(F.lit(1), F.lit(2), F.lit(3))), 6).alias("score")))
CHOICE = "CASE doc_id % 5 WHEN 0 THEN 'I say B or C' WHEN 1 THEN 'answer is: (C' WHEN 2 THEN 'Bread' WHEN 3 THEN '' ELSE 'the answer is Charly' END"
query("choice_cascade", f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN lab IN ('B', 'C') WHEN 1 THEN lab = 'C' WHEN 2 THEN lab = 'B' WHEN 3 THEN FALSE ELSE lab = 'C' END AS score FROM (SELECT doc_id, substr('ABCD', CAST(doc_id % 4 AS INT) + 1, 1) AS lab FROM documents)")(
    lambda t: t.documents.select("doc_id", an.choice(F.expr(CHOICE), F.array(F.expr("substr('ABCD', CAST(doc_id % 4 AS INT) + 1, 1)"))).alias("score"))
)
N1 = f"array_to_string({PT}, ' ')"
GOLD = f"list_transform(answers, lambda a: array_to_string({words_sql('a', 'y')}, ' '))"
query(
    "loft_single",
    f"WITH {P}, n AS (SELECT doc_id, {N1} AS p, {GOLD} AS g FROM p) SELECT doc_id, list_contains(g, p)::INT AS em, list_bool_or(list_transform(g, lambda a: contains(p, a)))::INT AS subspan FROM n",
)(
    lambda t: predictions(t)
    .select("doc_id", tx.normalize_answer(F.col("predicted")).alias("p"), F.transform("answers", tx.normalize_answer).alias("g"))
    .select("doc_id", F.array_contains("g", F.col("p")).cast("int").alias("em"), F.exists("g", lambda a: F.contains(F.col("p"), a)).cast("int").alias("subspan"))
)
MULTI = "m AS (SELECT doc_id, [CAST(doc_id % 2 AS VARCHAR), CAST(doc_id % 3 AS VARCHAR), CAST(doc_id % 3 AS VARCHAR)] AS g, [CAST(doc_id % 5 AS VARCHAR), CAST(doc_id % 3 AS VARCHAR)] AS p FROM documents)"


def multi(t: Tables) -> DataFrame:
    d = lambda k: (F.col("doc_id") % k).cast("string")
    return t.documents.select("doc_id", F.array(d(2), d(3), d(3)).alias("g"), F.array(d(5), d(3)).alias("p"))


query("loft_coverage", f"WITH {MULTI} SELECT doc_id, round(len(list_intersect(list_distinct(g), p)) / len(g)::DOUBLE, 6) AS score FROM m")(
    lambda t: multi(t).select("doc_id", F.round(F.size(F.array_intersect("p", "g")) / F.size("g"), 6).alias("score"))
)
query("loft_em_multi", f"WITH {MULTI} SELECT doc_id, list_sort(list_distinct(g)) = list_sort(list_distinct(p)) AS score FROM m")(
    lambda t: multi(t).select("doc_id", (F.array_sort(F.array_distinct("g")) == F.array_sort(F.array_distinct("p"))).alias("score"))
)
query("loft_multi_subspan")(lambda t: multi(t).select("doc_id", an.all_aligned("g", "p").alias("score")))
query("loft_extract")(lambda t: t.documents.select("doc_id", an.listed(F.concat(F.lit("Final Answer: ['it's "), F.col("lang"), F.lit("', 'b']"))).alias("items")))
query("rouge_l")(lambda t: predictions(t).select("doc_id", F.round(an.rouge_l("predicted", F.get("answers", F.lit(0))), 6).alias("score")))
query("code_sim")(lambda t: predictions(t).select("doc_id", F.round(an.similarity(tx.first_code_line(F.col("predicted")), F.get("answers", F.lit(0))), 6).alias("score")))
query(
    "rouge_n_recall",
    """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS p, list_filter(string_split_regex(substr(text, 100), '\\s+'), lambda x: x <> '') AS g FROM documents),
b AS (SELECT doc_id, list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1]) AS p2, list_distinct(list_transform(range(1, len(g)), lambda i: g[i] || ' ' || g[i + 1])) AS g2 FROM w)
SELECT doc_id, round(CASE WHEN len(g2) = 0 THEN 0 ELSE len(list_intersect(g2, p2)) / len(g2)::DOUBLE END, 6) AS score FROM b""",
)(lambda t: an.recall_of_ngrams(t.documents, "doc_id", F.col("text"), F.expr("substr(text, 100)"), 2).withColumn("score", F.round("score", 6)))


def clozes(t: Tables) -> DataFrame:
    """Expected and answered maps of three blanks, as JSON texts read into maps; every seventh answer is no JSON."""
    d = lambda k: (F.col("doc_id") % k).cast("string")
    want = F.to_json(F.create_map(F.lit("a"), F.concat(F.lit("red "), d(2)), F.lit("b"), F.concat(F.lit("blue "), d(3)), F.lit("c"), F.lit("x")))
    got = F.when(F.col("doc_id") % 7 == 0, "none").otherwise(F.to_json(F.create_map(F.lit("a"), F.concat(F.lit("red "), d(4)), F.lit("b"), F.concat(F.lit("green "), d(3)))))
    return t.documents.select("doc_id", F.from_json(want, "map<string,string>").alias("want"), F.from_json(got, "map<string,string>").alias("got"))


query(
    "cloze_exact",
    "SELECT CAST(sum(CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 2 = doc_id % 4 THEN 1 ELSE 0 END) AS BIGINT) AS matched, CAST(sum(3) AS BIGINT) AS total, round(sum(CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 2 = doc_id % 4 THEN 1 ELSE 0 END) / sum(3)::DOUBLE, 4) AS score FROM documents",
)(
    lambda t: clozes(t)
    .agg(F.sum(an.map_matches(F.col("want"), F.col("got"))).alias("matched"), F.sum(F.size("want")).cast("long").alias("total"))
    .withColumn("score", F.round(F.col("matched") / F.col("total"), 4))
)
query("cloze_partial", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 2 END AS score FROM documents")(lambda t: clozes(t).select("doc_id", an.map_overlaps(F.col("want"), F.col("got")).alias("score")))
query(
    "synthetic_kv_score",
    """WITH k AS (SELECT doc_id, 'it is V_' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) || ' ok' AS p, substr(md5(CAST(doc_id - doc_id % 2 AS VARCHAR)), 1, 12) AS g FROM documents)
SELECT count(*) FILTER (lower(p) = g) AS exact, count(*) FILTER (contains(lower(p), g)) AS found, count(*) AS n FROM k""",
)(
    lambda t: t.documents.select(
        F.concat(F.lit("it is V_"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 12), F.lit(" ok")).alias("p"),
        F.substring(F.md5((F.col("doc_id") - F.col("doc_id") % 2).cast("string")), 1, 12).alias("g"),
    ).agg(F.count_if(F.lower("p") == F.col("g")).alias("exact"), F.count_if(F.array_contains(tx.hex_ids(F.col("p")), F.col("g")) | F.contains(F.lower("p"), F.col("g"))).alias("found"), F.count("*").alias("n"))
)
pred_query("rlm_match", "contains(trim(regexp_replace(lower(predicted), '\\s+', ' ', 'g')), trim(regexp_replace(lower(answers[1]), '\\s+', ' ', 'g')))", lambda p, a: F.contains(tx.squeeze(F.lower(p)), tx.squeeze(F.lower(F.get(a, F.lit(0))))))
SCORERS = {
    "substring": (lambda p, a: an.any_contained(p, a), "list_max(list_transform(answers, lambda a: CASE WHEN contains(lower(p), lower(a)) THEN 1.0::DOUBLE ELSE 0 END))"),
    "share": (lambda p, a: an.share_contained(p, a), "list_sum(list_transform(answers, lambda a: CASE WHEN contains(lower(p), lower(a)) THEN 1.0::DOUBLE ELSE 0 END)) / len(answers)"),
}


def score(rows: DataFrame, scorer: str) -> DataFrame:
    """rows with score appended; an unknown scorer or a missing column is an error; a null prediction counts as ''."""
    if scorer not in SCORERS:
        raise ValueError(f"no scorer {scorer}; there are {sorted(SCORERS)}")
    if missing := {"predicted", "answers"} - set(rows.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return rows.withColumn("score", SCORERS[scorer][0](tx.filled(F.col("predicted")), F.col("answers")))


query("score_dispatch", f"WITH {P}, n AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE predicted END AS p, answers FROM p) SELECT doc_id, {SCORERS['share'][1]} AS score FROM n")(
    lambda t: score(predictions(t).withColumn("predicted", F.when(F.col("doc_id") % 4 != 0, F.col("predicted"))), "share").select("doc_id", "score")
)
