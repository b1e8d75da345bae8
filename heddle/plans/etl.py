"""Queries over evaluation tables: scans, sinks, samples, groups, resumption, roll-ups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions import text as tx
from heddle.operators import etl
from heddle.plans.registry import query
from heddle.sources.tables import Tables, shared_folder

query("scan_benchmark", "SELECT item_id, length(text) AS n FROM benchmark")(lambda t: t.benchmark.select("item_id", F.length("text").alias("n")))
query("scan_multi_split", "SELECT item_id, 'dev' AS split, 'nq' AS task FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, 'test', 'nq' FROM benchmark WHERE item_id % 2 = 1")(
    lambda t: etl.union_splits({"dev": t.benchmark.where("item_id % 2 = 0"), "test": t.benchmark.where("item_id % 2 = 1")}).select("item_id", "split", F.lit("nq").alias("task"))
)
query("union_splits", "SELECT o_orderpriority AS p, count(*) AS n FROM (SELECT * FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT * FROM orders WHERE o_orderkey % 3 = 0) GROUP BY ALL")(
    lambda t: etl.union_splits({"a": t.orders.where("o_orderkey % 2 = 0"), "b": t.orders.where("o_orderkey % 3 = 0")}).groupBy(F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
)


def scratch(t: Tables, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("scan_jsonl_dir", "SELECT lang AS task, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def scan_jsonl_dir(t: Tables) -> DataFrame:
    """JSON lines below folders named by task, read with a schema; the task comes from the path."""
    path = scratch(t, "jsonl")
    t.documents.select("doc_id", "n_chars", F.col("lang").alias("task")).write.partitionBy("task").json(path)
    rows = t.spark.read.schema("doc_id long, n_chars long").option("recursiveFileLookup", "true").json(path)
    task = F.regexp_extract(F.input_file_name(), "task=([^/]+)/", 1)
    return rows.withColumn("task", task).groupBy("task").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("sink_predictions", "SELECT doc_id, lang, CAST(n_chars AS BIGINT) AS n_chars FROM documents")
def sink_predictions(t: Tables) -> DataFrame:
    """CSV without the context, columns in a fixed order, and back."""
    path = scratch(t, "csv")
    t.documents.select("doc_id", "lang", "n_chars", F.col("text").alias("context")).drop("context").write.option("header", "true").csv(path)
    return t.spark.read.schema("doc_id long, lang string, n_chars long").option("header", "true").csv(path)


query("run_dir_name", "SELECT DISTINCT concat_ws('__', 'ds', lang, nullif(CASE WHEN doc_id % 2 = 0 THEN 'q' ELSE '' END, '')) AS name FROM documents")(
    lambda t: t.documents.select(F.concat_ws("__", F.lit("ds"), "lang", F.nullif(F.when(F.col("doc_id") % 2 == 0, "q").otherwise(""), F.lit(""))).alias("name")).distinct()
)
CONFIGS = {"base": {"dataset": "ruler", "ratio": "0.5"}, "mid": {"extends": "base", "press": "knorm"}, "top": {"extends": "mid", "ratio": "0.75"}}
query("config_layering", "SELECT * FROM (VALUES ('dataset', 'ruler'), ('press', 'knorm'), ('ratio', '0.75')) v(k, v)")(lambda t: t.spark.createDataFrame(list(etl.layered(CONFIGS, "top").items()), "k string, v string"))
TASKS = ["src1", "src2", "none"]
query("profile_validate", "SELECT * FROM (VALUES ('none')) v(task)")(lambda t: t.spark.createDataFrame([(x,) for x in TASKS], "task string").exceptAll(t.documents.select(F.col("source").alias("task")).distinct()))
query("profile_select", "SELECT i AS id, i * 256 AS budget FROM (VALUES (1), (2), (3), (4)) v(i) WHERE i <= 2")(
    lambda t: t.spark.createDataFrame([(i, i * 256) for i in range(1, 5)], "id int, budget int").where("id <= 2")
)
query("project_rename", "SELECT doc_id AS id, lang AS task FROM documents")(lambda t: t.documents.select("doc_id", "lang").withColumnsRenamed({"doc_id": "id", "lang": "task"}))
query("lookup_column", "SELECT doc_id, CASE lang WHEN 'en' THEN 128 WHEN 'fr' THEN 64 ELSE 32 END AS max_new_tokens FROM documents")(
    lambda t: t.documents.select("doc_id", F.coalesce(F.create_map(F.lit("en"), F.lit(128), F.lit("fr"), F.lit(64)).getItem(F.col("lang")), F.lit(32)).alias("max_new_tokens"))
)
query("prompt_template", "SELECT doc_id, 'Read this: ' || text || ' Question: ' || lang || '?' AS prompt FROM documents")(
    lambda t: t.documents.select("doc_id", F.replace(F.replace(F.lit("Read this: {context} Question: {input}?"), F.lit("{context}"), F.col("text")), F.lit("{input}"), F.col("lang")).alias("prompt"))
)
query("length_band_filter", "SELECT doc_id FROM documents WHERE n_chars > 500 AND n_chars < 2000")(lambda t: t.documents.where((F.col("n_chars") > 500) & (F.col("n_chars") < 2000)).select("doc_id"))
query("limit_rows", "SELECT doc_id, lang FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 20")(lambda t: t.documents.where("lang = 'en'").select("doc_id", "lang").orderBy("doc_id").limit(20))
query("prefix_budget", "SELECT doc_id, CAST(total AS BIGINT) AS total FROM (SELECT doc_id, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS total FROM documents) WHERE total <= 20000")(
    lambda t: etl.prefix_within(t.documents.select("doc_id", "lang", "n_chars"), "lang", ["doc_id"], "n_chars", 20000).select("doc_id", "total")
)
query("group_questions", "SELECT conv_id, len(list(text)) AS n, md5(string_agg(text, '|' ORDER BY turn)) AS joined FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id")(
    lambda t: etl.group_in_order(t.conversations, "conv_id", "turn", "text", "questions").select("conv_id", F.size("questions").cast("long").alias("n"), F.md5(F.array_join("questions", "|")).alias("joined"))
)
query("fd_check", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(DISTINCT role) <> 1")(lambda t: t.conversations.groupBy("conv_id").agg(F.count_distinct("role").alias("n")).where("n <> 1").select("conv_id"))
query("distinct_contexts", "SELECT count(DISTINCT text) AS n FROM documents")(lambda t: t.documents.agg(F.count_distinct("text").alias("n")))
query("expand_compact", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS idx, text AS question, role AS answer FROM conversations")(
    lambda t: etl.expand_pairs(
        t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("x")).select("conv_id", F.col("x.text").alias("questions"), F.col("x.role").alias("answers"))
    )
)
query("context_stats_avg", "SELECT lang, round(avg(n_chars), 6) AS chars, count(*) AS contexts FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1) GROUP BY lang")(
    lambda t: etl.head_per_group(t.documents, "text", ["doc_id"], 1).groupBy("lang").agg(F.round(F.avg("n_chars"), 6).alias("chars"), F.count("*").alias("contexts"))
)
query("sample_fraction", "SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= round_even(0.25 * count(*) OVER (), 0)")(lambda t: etl.sample_exact(t.documents.select("doc_id"), 0.25, "doc_id", 42))
query("head_per_group", "SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 10")(
    lambda t: etl.head_per_group(t.orders, "o_orderpriority", ["o_orderkey"], 10).select("o_orderpriority", "o_orderkey")
)
query("split_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5)")(
    lambda t: t.documents.select("doc_id").join(etl.head_per_group(t.documents.select("doc_id", "source"), "source", ["doc_id"], 5), "doc_id", "left_anti")
)
query("resume_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda t: etl.resume(t.documents.select("doc_id"), t.labels, "doc_id"))
query("matrix_cross", "SELECT s.source AS task, b.b AS budget, p.p AS press FROM (SELECT DISTINCT source FROM documents) s, (VALUES (256), (512), (1024)) b(b), (VALUES ('knorm'), ('snapkv')) p(p)")(
    lambda t: t.documents.select(F.col("source").alias("task")).distinct().select("task", F.explode(F.array(*map(F.lit, (256, 512, 1024)))).alias("budget")).select("task", "budget", F.explode(F.array(F.lit("knorm"), F.lit("snapkv"))).alias("press"))
)
query("worker_shard", "SELECT source FROM (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM documents)) WHERE i % 4 = 1")(
    lambda t: t.documents.select("source").distinct().withColumn("i", F.row_number().over(Window.orderBy("source")) - 1).where("i % 4 = 1").select("source")
)
query("weighted_rollup", "SELECT round(sum(x * n) / sum(n), 6) AS score, CAST(sum(n) AS BIGINT) AS n FROM (SELECT lang, avg(n_chars) AS x, count(*) AS n FROM documents GROUP BY lang)")(
    lambda t: t.documents.groupBy("lang").agg(F.avg("n_chars").alias("x"), F.count("*").alias("n")).agg(F.round(F.sum(F.col("x") * F.col("n")) / F.sum("n"), 6).alias("score"), F.sum("n").alias("n"))
)
query("runtime_rollup", "SELECT count(*) AS n, count(*) FILTER (event_type = 'purchase') AS matched, round(avg(value), 6) AS mean, count(*) FILTER (value IS NULL) AS errors FROM events")(
    lambda t: t.events.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("matched"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("value").isNull()).alias("errors"))
)
query("comparison_table", "SELECT o_orderstatus AS variant, o_orderpriority AS mode, count(*) AS n, round(avg(o_totalprice), 4) AS score FROM orders GROUP BY ALL")(
    lambda t: t.orders.groupBy(F.col("o_orderstatus").alias("variant"), F.col("o_orderpriority").alias("mode")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("score"))
)
query(
    "turn_budget",
    """SELECT conv_id, turn, CAST(held AS BIGINT) AS held FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back,
sum(greatest(1, length(text) // 4) + 4) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS held FROM conversations) WHERE back <= 3 AND held <= 120""",
)(lambda t: etl.keep_recent(t.conversations.withColumn("w", tx.token_count(F.col("text")) + 4), "conv_id", "turn", "w", 3, 120).select("conv_id", "turn", "held"))
query(
    "needle_depth",
    """SELECT doc_id, d AS depth, CAST(floor(len(w) * d / 100) AS INT) AS at, md5(array_to_string(list_concat(list_concat(w[1:CAST(floor(len(w) * d / 100) AS INT)], ['<needle>']), w[CAST(floor(len(w) * d / 100) AS INT) + 1:]), ' ')) AS context
FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents), (VALUES (0), (50), (100)) v(d)""",
)(lambda t: etl.insert_needle(t.documents.select("doc_id", "text"), "<needle>", [0, 50, 100]).select("doc_id", "depth", "at", F.md5("context").alias("context")))
HEXKEY = "upper(substr(sha256('42:' || {0}), 1, 12))"
query("kv_generate", f"SELECT doc_id, 'K_' || {HEXKEY.format('doc_id')} AS key, 'V_' || {HEXKEY.format('(doc_id + 1000000)')} AS value FROM documents")(lambda t: pairs(t))


def pairs(t: Tables) -> DataFrame:
    """Identifiers from a digest of the seed and the row, the same on every run."""
    name = lambda c: F.upper(F.substring(F.sha2(F.concat(F.lit("42:"), c.cast("string")), 256), 1, 12))
    return t.documents.select("doc_id", F.concat(F.lit("K_"), name(F.col("doc_id"))).alias("key"), F.concat(F.lit("V_"), name(F.col("doc_id") + 1000000)).alias("value"))


query("kv_roundtrip", f"SELECT lang, md5(string_agg('V_' || {HEXKEY.format('(doc_id + 1000000)')}, ',' ORDER BY doc_id)) AS found, count(*) AS n FROM documents GROUP BY lang")(
    lambda t: pairs(t)
    .join(t.documents.select("doc_id", "lang"), "doc_id")
    .withColumn("line", F.concat_ws(" ", F.lit("record"), "key", F.lit("holds"), "value"))
    .transform(lambda df: etl.group_in_order(df, "lang", "doc_id", "line", "lines"))
    .select("lang", F.regexp_extract_all(F.array_join("lines", "\n"), F.lit("record K_[0-9A-F]{12} holds (V_[0-9A-F]{12})"), F.lit(1)).alias("v"))
    .select("lang", F.md5(F.array_join("v", ",")).alias("found"), F.size("v").cast("long").alias("n"))
)
query("multikey_sum", "SELECT source, CAST(sum(doc_id % 100) AS BIGINT) AS answer, count(*) AS n FROM documents GROUP BY source")(
    lambda t: t.documents.withColumn("s", F.concat(F.lit("The number is "), (F.col("doc_id") % 100).cast("string"), F.lit(".")))
    .groupBy("source")
    .agg(F.sum(tx.first_int(F.col("s")).cast("long")).alias("answer"), F.count("*").alias("n"))
)
query("explode_qa", "SELECT doc_id, CAST(i AS INT) AS idx, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang || i END AS question FROM documents, (VALUES (0), (1)) v(i) WHERE doc_id % 5 <> 0 OR i = 0")(lambda t: explode_qa(t))


def explode_qa(t: Tables) -> DataFrame:
    """JSON lists of question and answer; 'none' is one empty pair."""
    one = lambda k: F.struct(F.concat("lang", F.lit(str(k))).alias("Q"), F.lit("x").alias("A"))
    text = F.when(F.col("doc_id") % 5 == 0, "none").otherwise(F.to_json(F.array(one(0), one(1))))
    parsed = F.from_json(text, "array<struct<Q:string,A:string>>")
    got = F.when(text == "none", F.array(F.struct(F.lit("").alias("Q"), F.lit("").alias("A")))).otherwise(parsed)
    return t.documents.select("doc_id", F.posexplode(got).alias("idx", "x")).select("doc_id", "idx", F.col("x.Q").alias("question"))


query("example_adapter", "SELECT 'ds:' || source || ':' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS id, lang AS answer FROM documents")(
    lambda t: t.documents.withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).select(F.concat_ws(":", F.lit("ds"), "source", "i").alias("id"), F.col("lang").alias("answer"))
)
query("query_aware", "SELECT doc_id, md5(text || lang) AS context, '' AS question FROM documents")(
    lambda t: t.documents.withColumn("context", F.concat("text", "lang")).select("doc_id", F.md5("context").alias("context"), F.lit("").alias("question"))
)
query("subcall_dedup", "SELECT conv_id, turn, min(conv_id) OVER (PARTITION BY text) AS answered_by FROM conversations")(
    lambda t: t.conversations.join(t.conversations.groupBy("text").agg(F.min("conv_id").alias("answered_by")), "text").select("conv_id", "turn", "answered_by")
)
query("html_paragraphs", "SELECT page_id, md5(array_to_string(list_transform(regexp_extract_all(html, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')), '')) AS out FROM pages")(
    lambda t: t.pages.select("page_id", F.md5(tx.html_paragraphs(F.col("html"))).alias("out"))
)
