"""Queries over the cache relation: scorers, selectors, budgets, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.vectors import dot, norm, norm1
from heddle.operators import attention as att
from heddle.operators import budgets, merging, presses, scoring, selection
from heddle.plans.registry import ORACLES, query
from heddle.sources.tables import HEAD, KEYS, Tables
from heddle.streaming import cache

KV = """kv AS (SELECT CAST(vec_id % 2 AS INT) AS layer, 0 AS batch, CAST((vec_id // 2) % 2 AS INT) AS head, CAST(vec_id // 4 AS INT) AS pos,
  CAST(embedding[1:32] AS DOUBLE[]) AS key, CAST(embedding[33:64] AS DOUBLE[]) AS value FROM embeddings),
sz AS (SELECT max(pos) + 1 AS n FROM kv)"""
ID = "layer, batch, head, pos"
L2 = "sqrt(list_dot_product({0}, {0}))"
KNORM = f"SELECT {ID}, -sqrt(list_dot_product(key, key)) AS score FROM kv"
Q = """q AS (SELECT layer, batch, head, head * 2 + g AS qhead, pos AS q_pos, CASE WHEN g = 0 THEN key ELSE value END AS q FROM kv, (VALUES (0), (1)) t(g))"""


def attention_sql(where: str = "TRUE", causal: bool = True) -> str:
    return f"""{Q},
lg AS (SELECT q.layer, q.batch, q.head, qhead, q_pos, k.pos, list_dot_product(q, key) / sqrt(32) AS x FROM q JOIN kv k ON q.layer = k.layer AND q.batch = k.batch AND q.head = k.head
  {'AND k.pos <= q.q_pos' if causal else ''}, sz WHERE {where}),
ex AS (SELECT *, exp(x - max(x) OVER (PARTITION BY layer, batch, qhead, q_pos)) AS e FROM lg),
a AS (SELECT layer, batch, head, qhead, q_pos, pos, e / sum(e) OVER (PARTITION BY layer, batch, qhead, q_pos) AS w FROM ex)"""


def top(scores: str, ratio: float = 0.5, within: str = "layer, batch, head", least: int = 0) -> str:
    """SQL of keep_top over a named score relation."""
    return f"""SELECT {ID}, round(score, 6) AS score FROM {scores}
QUALIFY row_number() OVER (PARTITION BY {within} ORDER BY round(score, 9) DESC, {ID}) <= greatest(floor(count(*) OVER (PARTITION BY {within}) * CAST({1.0 - ratio!r} AS DOUBLE)), {least})"""


def with_kv(*parts: str) -> str:
    *named, last = parts
    return "WITH " + ",\n".join([KV, *named]) + "\n" + last


def shown(scores: DataFrame) -> DataFrame:
    return scores.select(*KEYS, F.round("score", 6).alias("score"))


def length(t: Tables) -> int:
    """Positions of a head: one number from one aggregate."""
    return (t.kv.agg(F.max("pos")).first()[0] or -1) + 1


def head_shares(t: Tables, share: float) -> dict[tuple[int, int, int], int]:
    """A share of each head's rows: one aggregate, a row for each head."""
    return {tuple(r)[:3]: int(r["count"] * share) for r in t.kv.groupBy(*HEAD).count().collect()}


def scored(name: str, sql: str, f, ratio: float = 0.5, before: tuple[str, ...] = ()) -> None:
    query(name, with_kv(*before, f"s AS ({sql})", top("s", ratio)))(lambda t: shown(selection.keep_top(f(t), ratio)))


scored("knorm", KNORM, lambda t: scoring.key_norm(t.kv))
scored(
    "keydiff",
    f"SELECT {ID}, -list_dot_product(u, m) / sqrt(list_dot_product(m, m)) AS score FROM u JOIN an USING (layer, batch, head)",
    lambda t: scoring.key_difference(t.kv),
    before=(
        f"u AS (SELECT {ID}, list_transform(key, lambda x: x / sqrt(list_dot_product(key, key))) AS u FROM kv)",
        "an AS (SELECT layer, batch, head, list(m ORDER BY i) AS m FROM (SELECT layer, batch, head, i, avg(u[i]) AS m FROM u, (SELECT unnest(range(1, 33)) AS i) GROUP BY ALL) GROUP BY ALL)",
    ),
)
scored(
    "streaming_llm",
    f"SELECT {ID}, CASE WHEN pos >= 4 AND pos < 4 + n - floor(n * CAST(0.5 AS DOUBLE)) THEN 0.0 ELSE 1.0 END AS score FROM kv, sz",
    lambda t: scoring.sink_and_recent(t.kv, 0.5),
)


def dim_filters(t: Tables) -> DataFrame:
    """A filter for each (layer, head), from integer arithmetic."""
    heads = t.kv.select("layer", "head").distinct()
    return heads.withColumn("filter", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: ((i * 7 + F.col("layer") * 3 + F.col("head") * 5) % 11 - 5) / F.lit(10.0)))


FILTERS = "f AS (SELECT layer, head, list_transform(range(0, 32), lambda i: ((i * 7 + layer * 3 + head * 5) % 11 - 5) / CAST(10 AS DOUBLE)) AS filter FROM (SELECT DISTINCT layer, head FROM kv))"
scored("qfilter", f"SELECT {ID}, -list_dot_product(filter, key) AS score FROM kv JOIN f USING (layer, head)", lambda t: scoring.filtered(t.kv, dim_filters(t)), before=(FILTERS,))
query("dim_broadcast", with_kv(FILTERS, f"SELECT {ID}, round(list_dot_product(filter, value), 6) AS v FROM kv JOIN f USING (layer, head)"))(
    lambda t: t.kv.join(F.broadcast(dim_filters(t)), ["layer", "head"]).select(*KEYS, F.round(dot(F.col("filter"), F.col("value")), 6).alias("v"))
)
scored(
    "random_prune",
    f"SELECT {ID}, CAST('0x' || substr(md5(concat_ws(':', '7', layer, batch, head, pos)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS score FROM kv",
    lambda t: scoring.seeded(t.kv, "7"),
)
scored(
    "cur",
    f"SELECT {ID}, CASE WHEN pos < 4 THEN 1.0 ELSE s / sum(s) OVER (PARTITION BY layer, batch, head) END AS score FROM c2",
    lambda t: scoring.leverage_product(t.kv),
    before=(
        f"c1 AS (SELECT {ID}, list_dot_product(key, key) AS k2, list_dot_product(value, value) AS v2 FROM kv)",
        f"c2 AS (SELECT {ID}, k2 / sum(k2) OVER p * (v2 / sum(v2) OVER p) AS s FROM c1 WINDOW p AS (PARTITION BY layer, batch, head, pos // 16))",
    ),
)
scored(
    "lagkv",
    f"SELECT kv.layer, kv.batch, kv.head, kv.pos, coalesce(s.score, 1.0) AS score FROM kv LEFT JOIN l6 s USING ({ID})",
    lambda t: scoring.lag_relative(t.kv, length(t)),
    before=(
        f"l1 AS (SELECT {ID}, (pos - 4) // 16 AS part, key, value FROM kv, sz WHERE pos >= 4 AND pos < 4 + ((n - 4) // 16) * 16)",
        f"l2 AS (SELECT {ID}, part, i, key[i] AS k, value[i] AS v FROM l1, (SELECT unnest(range(1, 33)) AS i))",
        "l3 AS (SELECT layer, batch, head, part - 1 AS part, i, min(k) AS kl, max(k) AS kh, min(v) AS vl, max(v) AS vh FROM l2 GROUP BY ALL)",
        f"l4 AS (SELECT {ID}, part, stddev_samp((k - kl) / (kh - kl)) AS k, stddev_samp((v - vl) / (vh - vl)) AS v FROM l2 JOIN l3 USING (layer, batch, head, part, i) GROUP BY ALL)",
        f"l5 AS (SELECT {ID}, part, (exp(k) / sum(exp(k)) OVER p + exp(v) / sum(exp(v)) OVER p) / 2 AS s FROM l4 WINDOW p AS (PARTITION BY layer, batch, head, part))",
        f"l6 AS (SELECT {ID}, (row_number() OVER (PARTITION BY layer, batch, head, part ORDER BY round(s, 9), pos) - 1) / CAST(16 AS DOUBLE) AS score FROM l5)",
    ),
)

S = f"s AS ({KNORM})"
KEPT = f"kept AS ({top('s')})"
query("prune_semi", with_kv(S, KEPT, f"SELECT {ID}, round(list_sum(value), 6) AS v FROM kv SEMI JOIN kept USING ({ID})"))(
    lambda t: selection.prune(t.kv, selection.keep_top(scoring.key_norm(t.kv), 0.5)).select(*KEYS, F.round(F.aggregate("value", F.lit(0.0), lambda a, x: a + x), 6).alias("v"))
)
query("prune_anti", with_kv(S, KEPT, f"SELECT {ID}, round(list_sum(value), 6) AS v FROM kv ANTI JOIN kept USING ({ID})"))(
    lambda t: selection.mask(t.kv, selection.keep_top(scoring.key_norm(t.kv), 0.5)).select(*KEYS, F.round(F.aggregate("value", F.lit(0.0), lambda a, x: a + x), 6).alias("v"))
)
query("merge_evicted_set", with_kv(S, KEPT, f"SELECT {ID} FROM kv ANTI JOIN kept USING ({ID})"))(lambda t: selection.mask(t.kv, selection.keep_top(scoring.key_norm(t.kv), 0.5)).select(*KEYS))

ADA = f"""ada AS (SELECT *, count(*) OVER (PARTITION BY layer, batch, head) AS n, row_number() OVER (PARTITION BY layer, batch, head ORDER BY round(score, 9) DESC, pos) AS rk FROM s),
ada2 AS (SELECT *, rk <= floor(floor(n * CAST(0.5 AS DOUBLE)) * CAST(0.2 AS DOUBLE)) AS safe FROM ada),
ada3 AS (SELECT *, row_number() OVER (PARTITION BY layer, batch ORDER BY safe, round(score, 9), head DESC, pos DESC) AS low, count(*) OVER (PARTITION BY layer, batch) // n AS heads FROM ada2),
adk AS (SELECT {ID}, score FROM ada3 WHERE low > heads * (n - floor(n * CAST(0.5 AS DOUBLE))))"""
query("adakv", with_kv(S, ADA, f"SELECT {ID}, round(score, 6) AS score FROM adk"))(lambda t: shown(selection.adaptive_heads(scoring.key_norm(t.kv), 0.5)))

EXPK = f"SELECT {ID}, exp(-sqrt(list_dot_product(key, key)) / 8) AS score FROM kv"


def positive(t: Tables) -> DataFrame:
    """A positive score, as two-stage weighting multiplies it by a norm."""
    return t.kv.select(*KEYS, F.exp(-norm(F.col("key")) / 8).alias("score"))


def value_norm1(t: Tables) -> DataFrame:
    return t.kv.select(*KEYS, norm1(F.col("value")).alias("norm"))


CRIT = f"""c1 AS (SELECT *, count(*) OVER (PARTITION BY layer, batch, head) AS n, row_number() OVER (PARTITION BY layer, batch, head ORDER BY round(score, 9) DESC, pos) AS rk FROM s),
c2 AS (SELECT {ID}, n, rk <= floor(CAST(0.5 AS DOUBLE) * n * CAST(0.5 AS DOUBLE)) AS first, (score + 1e-4::DOUBLE) * list_sum(list_transform(value, lambda x: abs(x))) AS score FROM c1 JOIN kv USING ({ID}))"""
query(
    "criticalkv",
    with_kv(f"s AS ({EXPK})", CRIT, f"SELECT {ID} FROM c2 QUALIFY row_number() OVER (PARTITION BY layer, batch, head ORDER BY first DESC, round(score, 9) DESC, pos) <= floor(n * CAST(0.5 AS DOUBLE))"),
)(lambda t: selection.keep_top_first(selection.two_stage(positive(t), value_norm1(t), 0.5), 0.5))


@query(
    "critical_adakv",
    with_kv(
        f"s AS ({EXPK})",
        ADA.replace(f"adk AS (SELECT {ID}, score FROM ada3 WHERE low > heads * (n - floor(n * CAST(0.5 AS DOUBLE))))", "bud AS (SELECT layer, batch, head, count(*) AS budget FROM ada3 WHERE low > heads * (n - floor(n * CAST(0.5 AS DOUBLE))) GROUP BY ALL)"),
        f"st AS (SELECT {ID}, budget, safe OR rk <= floor(budget * CAST(0.5 AS DOUBLE)) AS first, (score + 1e-4::DOUBLE) * list_sum(list_transform(value, lambda x: abs(x))) AS score FROM ada2 JOIN kv USING ({ID}) JOIN bud USING (layer, batch, head))",
        f"SELECT {ID} FROM st QUALIFY row_number() OVER (PARTITION BY layer, batch, head ORDER BY first DESC, round(score, 9) DESC, pos) <= budget",
    ),
)
def critical_adakv(t: Tables) -> DataFrame:
    return selection.two_stage_adaptive(positive(t), value_norm1(t), 0.5)


query("chunk_press", with_kv(S, "s2 AS (SELECT *, pos // 10 AS chunk FROM s)", top("s2", 0.5, "layer, batch, head, chunk", 1)))(
    lambda t: shown(selection.keep_top(scoring.key_norm(t.kv).withColumn("chunk", F.expr("pos div 10")), 0.5, [*HEAD, "chunk"], 1))
)
query(
    "chunkkv",
    with_kv(
        S,
        "m AS (SELECT layer, batch, pos // 10 AS chunk, avg(score) AS score FROM s GROUP BY ALL)",
        "b AS (SELECT layer, batch, chunk FROM m QUALIFY row_number() OVER (PARTITION BY layer, batch ORDER BY round(score, 9) DESC, chunk) <= greatest(floor(count(*) OVER (PARTITION BY layer, batch) * CAST(0.5 AS DOUBLE)), 1))",
        f"SELECT {ID} FROM s JOIN b ON s.layer = b.layer AND s.batch = b.batch AND s.pos // 10 = b.chunk".replace(ID, "s.layer, s.batch, s.head, s.pos"),
    ),
)(lambda t: selection.keep_chunks(scoring.key_norm(t.kv), 0.5, 10))


@query("block_topk", with_kv(S, top("s", 0.75)))
def block_topk(t: Tables) -> DataFrame:
    """Tokens come in blocks of 64; after each a head keeps its best quarter of the whole length. Norms do not change, so what is left is the best of all."""
    held = cache.fold(cache.tokens_of(t.kv), cache.Block(cache.key_norm, head_shares(t, 1 - 0.75), 64))
    return shown(scoring.key_norm(held))


query("block_keydiff")(lambda t: cache.fold(cache.tokens_of(t.kv), cache.Block(cache.key_difference, head_shares(t, 0.5), 64)).select(*KEYS))
query("agg_partial_final", with_kv(S, "SELECT layer, head, round(max(score), 6) AS top, round(avg(score), 6) AS mean, count(*) AS n FROM s GROUP BY ALL"))(
    lambda t: scoring.key_norm(t.kv).groupBy("layer", "head").agg(F.round(F.max("score"), 6).alias("top"), F.round(F.avg("score"), 6).alias("mean"), F.count("*").alias("n"))
)


@query(
    "per_layer",
    with_kv(
        S,
        f"""SELECT {ID}, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY layer, batch, head ORDER BY round(score, 9) DESC, pos)
  <= floor(count(*) OVER (PARTITION BY layer, batch, head) * (CASE WHEN layer = 0 THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END))""",
    ),
)
def per_layer(t: Tables) -> DataFrame:
    """A ratio for each layer, as a dimension table."""
    keep = t.spark.createDataFrame([(0, 0.75), (1, 0.25)], "layer int, keep double")
    rows = selection.counted(selection.ranked(scoring.key_norm(t.kv))).join(F.broadcast(keep), "layer")
    return shown(rows.where(F.col("rank") <= F.floor(F.col("n") * F.col("keep"))))


query("composed", with_kv(S, f"k1 AS ({top('s', 0.5)})", f"s2 AS (SELECT {ID}, sqrt(list_dot_product(value, value)) AS score FROM kv SEMI JOIN k1 USING ({ID}))", top("s2", 0.25)))(
    lambda t: shown(t.kv.transform(lambda kv: selection.prune(kv, selection.keep_top(scoring.key_norm(kv), 0.5))).transform(lambda kv: selection.keep_top(kv.select(*KEYS, norm(F.col("value")).alias("score")), 0.25)))
)


@query(
    "pyramid_budget",
    """WITH p AS (SELECT CAST(layers AS INT) AS layers, CAST(n AS INT) AS n, ratio, n * (1.0::DOUBLE - ratio) AS mean FROM (VALUES (32), (64)) a(layers), (VALUES (512), (2048)) b(n), (VALUES (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) c(ratio)),
h AS (SELECT *, 2 * mean - mean / 20 AS high0 FROM p),
g AS (SELECT *, CASE WHEN high0 >= n - 64 THEN n - 64 ELSE high0 END AS high, CASE WHEN high0 >= n - 64 THEN 2 * mean - (n - 64) ELSE mean / 20 END AS low FROM h),
l AS (SELECT *, unnest(range(0, layers)) AS layer FROM g)
SELECT layers, n, ratio, CAST(layer AS INT) AS layer, CAST(round_even(CASE WHEN n >= high AND high >= low AND low >= 64 THEN high - layer * ((high - low) / (layers - 1)) ELSE mean END, 0) AS BIGINT) AS kept FROM l""",
)
def pyramid_budget(t: Tables) -> DataFrame:
    rows = [(layers, n, r, k, b) for layers in (32, 64) for n in (512, 2048) for r in (0.1, 0.25, 0.5, 0.9) for k, b in enumerate(selection.pyramid_layers(layers, r, n))]
    return t.spark.createDataFrame(rows, "layers int, n int, ratio double, layer int, kept long")


CURVE = "cv AS (SELECT layer, head, ((layer * 5 + head * 3) % 7 + 1) / CAST(10 AS DOUBLE) AS prune FROM (SELECT DISTINCT layer, head FROM kv))"
BUDGET = """b1 AS (SELECT layer, head, (1 - prune) * n AS ideal, floor((1 - prune) * n) AS whole, count(*) OVER (PARTITION BY layer) AS heads, n FROM cv, sz),
b2 AS (SELECT *, greatest(heads, least(heads * n, round_even(sum(ideal) OVER (PARTITION BY layer), 0))) - sum(whole) OVER (PARTITION BY layer) AS rest, row_number() OVER (PARTITION BY layer ORDER BY round(ideal - whole, 9) DESC, head) AS rk FROM b1),
hb AS (SELECT layer, head, CAST(least(greatest(whole + CASE WHEN rk <= rest THEN 1 ELSE 0 END, 1), n) AS BIGINT) AS budget FROM b2)"""


def curve(t: Tables) -> DataFrame:
    return t.kv.select("layer", "head").distinct().withColumn("prune", ((F.col("layer") * 5 + F.col("head") * 3) % 7 + 1) / F.lit(10.0))


query("lukv_budget", with_kv(CURVE, BUDGET, "SELECT layer, head, budget FROM hb"))(lambda t: selection.head_budgets(curve(t), length(t)))
query("lukv_select", with_kv(S, CURVE, BUDGET, f"SELECT {ID} FROM s JOIN hb USING (layer, head) QUALIFY row_number() OVER (PARTITION BY layer, batch, head ORDER BY round(score, 9) DESC, pos) <= budget"))(
    lambda t: selection.ranked(scoring.key_norm(t.kv)).join(F.broadcast(selection.head_budgets(curve(t), length(t))), ["layer", "head"]).where("rank <= budget").select(*KEYS)
)


@query(
    "duo_mask",
    with_kv(
        "hs AS (SELECT layer, head, ((layer * 3 + head * 5) % 4) / CAST(4 AS DOUBLE) AS score FROM (SELECT DISTINCT layer, head FROM kv))",
        "st AS (SELECT layer, head FROM hs QUALIFY row_number() OVER (ORDER BY score, layer, head) <= round_even(count(*) OVER () * CAST(0.5 AS DOUBLE), 0))",
        f"SELECT {ID} FROM kv JOIN st USING (layer, head), sz WHERE pos >= 4 AND pos < n - 16",
    ),
)
def duo_mask(t: Tables) -> DataFrame:
    """Masked rows: the heads with the lowest scores keep sinks and recents only."""
    heads = t.kv.select("layer", "head").distinct().withColumn("score", ((F.col("layer") * 3 + F.col("head") * 5) % 4) / F.lit(4.0))
    order = Window.orderBy("score", "layer", "head")  # a row for each head
    low = heads.withColumn("rank", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy())).where(F.col("rank") <= F.bround(F.col("n") * F.lit(0.5)))
    n = length(t)
    return t.kv.join(F.broadcast(low.select("layer", "head")), ["layer", "head"], "left_semi").where((F.col("pos") >= 4) & (F.col("pos") < n - 16)).select(*KEYS)


GLOBAL = f"lw AS (SELECT * FROM s QUALIFY row_number() OVER (ORDER BY round(score, 9), {ID}) <= floor(count(*) OVER () * CAST(0.3 AS DOUBLE))), bg AS (SELECT layer, count(*) AS budget FROM lw GROUP BY layer)"
query("kvzip_select", with_kv(S, GLOBAL, f"SELECT {ID} FROM s JOIN bg USING (layer) QUALIFY row_number() OVER (PARTITION BY layer ORDER BY round(score, 9), batch, head, pos) <= budget"))(
    lambda t: selection.global_then_layer(scoring.key_norm(t.kv), 0.3)
)
query("kvzip_layer_budget", with_kv(S, GLOBAL, "SELECT l.layer, coalesce(budget, 0) AS budget FROM (SELECT DISTINCT layer FROM kv) l LEFT JOIN bg ON l.layer = bg.layer"))(
    lambda t: t.kv.select("layer").distinct().join(selection.global_rank(scoring.key_norm(t.kv)).where(F.col("low") <= F.floor(F.col("total") * F.lit(0.3))).groupBy("layer").agg(F.count("*").alias("budget")), "layer", "left").na.fill(0)
)
query("quantile_mask", with_kv(S, f"SELECT {ID} FROM s WHERE score < (SELECT quantile_cont(score, 0.4) FROM s)"))(
    lambda t: scoring.key_norm(t.kv).join(F.broadcast(scoring.key_norm(t.kv).agg(F.percentile("score", F.lit(0.4)).alias("cut")))).where("score < cut").select(*KEYS)
)
query("dms_prefill", with_kv(S, f"SELECT {ID} FROM s, sz WHERE round(score, 9) < -0.72 AND pos < n - 16"))(
    lambda t: scoring.key_norm(t.kv).where((F.round("score", 9) < -0.72) & (F.col("pos") < length(t) - 16)).select(*KEYS)
)
query("zscore_global", with_kv(S, f"SELECT {ID}, round((score - avg(score) OVER p) / greatest(stddev_samp(score) OVER p, 1e-6), 6) AS score FROM s WINDOW p AS (PARTITION BY layer)"))(
    lambda t: shown(att.z_scores(scoring.key_norm(t.kv)))
)
query("avg_pool5", with_kv(S, f"SELECT {ID}, round(sum(score) OVER (PARTITION BY layer, batch, head ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS score FROM s"))(
    lambda t: shown(att.pooled(scoring.key_norm(t.kv), 5, HEAD))
)
query("softmax_window", with_kv(S, f"SELECT {ID}, round(exp(score - max(score) OVER p) / sum(exp(score)) OVER p * exp(max(score) OVER p), 6) AS score FROM s WINDOW p AS (PARTITION BY layer, batch, head)"))(
    lambda t: shown(
        scoring.key_norm(t.kv).withColumn("e", F.exp(F.col("score") - F.max("score").over(scoring.every_head()))).withColumn("score", F.col("e") / F.sum("e").over(scoring.every_head()))
    )
)

# --- attention -------------------------------------------------------------------------------------------------------

LAST = "q_pos >= n - {0}"
query("window_attention", with_kv(attention_sql(LAST.format(8)), "SELECT layer, qhead, q_pos, pos, round(w, 6) AS w FROM a"))(
    lambda t: att.attention(att.last_queries(att.queries_of(t.kv), length(t), 8), t.kv).select("layer", "qhead", "q_pos", "pos", F.round("w", 6).alias("w"))
)
query("causal_theta_join", with_kv(Q, "SELECT q.layer, qhead, q_pos, count(*) AS seen, round(sum(list_dot_product(q, key)), 5) AS total FROM q JOIN kv k ON q.layer = k.layer AND q.batch = k.batch AND q.head = k.head AND k.pos <= q.q_pos GROUP BY ALL"))(
    lambda t: att.causal_totals(att.queries_of(t.kv), t.kv).groupBy("layer", "qhead", "q_pos").agg(F.sum("seen").alias("seen"), F.round(F.sum("total"), 5).alias("total"))
)
query("gqa_broadcast", with_kv("SELECT layer, batch, head, head * 2 + g AS qhead, pos, round(list_sum(key), 6) AS k FROM kv, (VALUES (0), (1)) t(g)"))(
    lambda t: t.kv.join(F.broadcast(t.spark.createDataFrame([(0, 0), (0, 1), (1, 2), (1, 3)], "head int, qhead int")), "head").select(*HEAD, "qhead", "pos", F.round(F.aggregate("key", F.lit(0.0), lambda a, x: a + x), 6).alias("k"))
)

PAD = f"s AS (SELECT kv.layer, kv.batch, kv.head, kv.pos, coalesce(b.score, (SELECT max(score) + 1 FROM b x WHERE x.layer = kv.layer)) AS score FROM kv LEFT JOIN b USING ({ID}))"
SNAP = (
    attention_sql(LAST.format(16)),
    "m AS (SELECT layer, batch, head, qhead, pos, avg(w) AS w FROM a, sz WHERE pos < n - 16 GROUP BY ALL)",
    "m5 AS (SELECT layer, batch, head, qhead, pos, sum(w) OVER (PARTITION BY layer, batch, head, qhead ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS w FROM m)",
    "b AS (SELECT layer, batch, head, pos, avg(w) AS score FROM m5 GROUP BY ALL)",
    PAD,
)
query("snapkv", with_kv(*SNAP, top("s")))(lambda t: shown(selection.keep_top(att.window_scores(t.kv, length(t), 16), 0.5)))
query(
    "finch",
    with_kv(
        attention_sql(LAST.format(16)),
        "m AS (SELECT layer, batch, head, qhead, pos, avg(w * q_pos) AS w FROM a, sz WHERE pos < n - 16 GROUP BY ALL)",
        "b AS (SELECT layer, batch, head, pos, avg(w) AS score FROM m GROUP BY ALL)",
        PAD,
        "s2 AS (SELECT *, pos // 50 AS chunk FROM s)",
        f"kp AS ({top('s2', 0.5, 'layer, batch, head, chunk', 1)})",
        f"rn AS (SELECT {ID}, kp.score, CAST(row_number() OVER (PARTITION BY layer, batch, head ORDER BY pos) - 1 AS INT) AS new_pos, key FROM kv JOIN kp USING ({ID}))",
        f"tn AS (SELECT *, list_transform(range(0, 16), lambda i: (new_pos - pos) * pow(10000.0::DOUBLE, -i / 16.0::DOUBLE)) AS g FROM rn)",
        f"SELECT {ID}, score, new_pos, CAST(i - 1 AS INT) AS channel, round(CASE WHEN i <= 16 THEN key[i] * cos(g[i]) - key[i + 16] * sin(g[i]) ELSE key[i] * cos(g[i - 16]) + key[i - 16] * sin(g[i - 16]) END, 5) AS k FROM tn, (SELECT unnest(range(1, 33)) AS i)",
    ),
)(
    lambda t: (
        lambda kept: scoring.rerotated(t.kv.join(kept, KEYS)).select(*KEYS, "score", "new_pos", F.posexplode("key").alias("channel", "x")).select(*KEYS, "score", "new_pos", "channel", F.round("x", 5).alias("k"))
    )(shown(selection.keep_top(att.window_scores(t.kv, length(t), 16, kernel=1, normalize=True).withColumn("chunk", F.expr("pos div 50")), 0.5, [*HEAD, "chunk"], 1)))
)
SEP = "<sep>"
query(
    "finch_window",
    f"""WITH s AS (SELECT doc_id, list_concat(list_concat(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> ''), ['{SEP}']), [lang, source]) AS w FROM documents)
SELECT doc_id, CAST(list_position(w, '{SEP}') - 1 AS INT) AS context_length, CAST(len(w) - list_position(w, '{SEP}') AS INT) AS window FROM s""",
)(
    lambda t: selection.window_after_delimiter(
        t.documents.select("doc_id", F.concat(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != ""), F.array(F.lit(SEP), "lang", "source")).alias("tokens")), SEP
    ).select("doc_id", "context_length", "window")
)
query(
    "tova",
    with_kv(
        attention_sql(LAST.format(1)),
        "m AS (SELECT layer, batch, pos, avg(w) AS score FROM a, sz WHERE pos < n - 1 GROUP BY ALL)",
        f"b AS (SELECT {ID}, score FROM kv JOIN m USING (layer, batch, pos))",
        PAD,
        top("s"),
    ),
)(lambda t: shown(selection.keep_top(att.last_token_scores(t.kv, length(t)), 0.5)))
query(
    "observed_attention",
    with_kv(
        attention_sql(),
        "m AS (SELECT layer, batch, head, qhead, pos, sum(w) / (any_value(n) - pos) AS w FROM a, sz GROUP BY layer, batch, head, qhead, pos)",
        "s AS (SELECT layer, batch, head, pos, avg(w) AS score FROM m GROUP BY ALL)",
        top("s"),
    ),
)(lambda t: shown(selection.keep_top(att.observed_scores(t.kv), 0.5)))
EA = (
    Q,
    "mu AS (SELECT layer, batch, head, qhead, list(m ORDER BY i) AS mu FROM (SELECT layer, batch, head, qhead, i, avg(q[i]) AS m FROM q, (SELECT unnest(range(1, 33)) AS i) WHERE q_pos >= 4 GROUP BY ALL) GROUP BY ALL)",
    """sg AS (SELECT layer, batch, head, qhead, list(r ORDER BY i) AS sigma FROM (SELECT layer, batch, head, qhead, i, list(c ORDER BY j) AS r FROM
  (SELECT layer, batch, head, qhead, i, j, covar_pop(q[i], q[j]) AS c FROM q, (SELECT unnest(range(1, 33)) AS i), (SELECT unnest(range(1, 33)) AS j) WHERE q_pos >= 4 GROUP BY ALL) GROUP BY ALL) GROUP BY ALL)""",
    "av AS (SELECT list(c ORDER BY i) AS c, list(s ORDER BY i) AS s FROM (SELECT i, avg(cos((n + f) * pow(10000.0::DOUBLE, -i / 16.0::DOUBLE))) AS c, avg(sin((n + f) * pow(10000.0::DOUBLE, -i / 16.0::DOUBLE))) AS s FROM sz, (SELECT unnest(range(0, 16)) AS i), (SELECT unnest(range(0, 512)) AS f) GROUP BY i))",
    f"kr AS (SELECT {ID}, value, list_transform(range(1, 33), lambda i: CASE WHEN i <= 16 THEN c[i] * key[i] + s[i] * key[i + 16] ELSE c[i - 16] * key[i] - s[i - 16] * key[i - 16] END) AS key FROM kv, av)",
    """x AS (SELECT kv.layer, kv.batch, kv.head, qhead, pos, value, list_dot_product(mu, key) / sqrt(32) + list_sum(list_transform(range(1, 33), lambda i: key[i] * list_dot_product(sigma[i], key))) / 32 / 2 AS x
  FROM kr AS kv JOIN mu USING (layer, batch, head) JOIN sg USING (layer, batch, head, qhead) WHERE pos >= 4)""",
    "y AS (SELECT *, exp(x - max(x) OVER (PARTITION BY layer, batch, qhead)) AS e FROM x)",
    "z AS (SELECT layer, batch, head, pos, value, e / sum(e) OVER (PARTITION BY layer, batch, qhead) AS w FROM y)",
    "b AS (SELECT layer, batch, head, pos, (avg(w) + 0.01::DOUBLE) * any_value(sqrt(list_dot_product(value, value))) AS score FROM z GROUP BY layer, batch, head, pos)",
    PAD,
)
query("expected_attention", with_kv(*EA, top("s")))(lambda t: shown(selection.keep_top(att.expected_scores(t.kv, epsilon=0.01), 0.5)))
query("expected_attention_stats", with_kv(*EA, top("s", 0.25)))(lambda t: shown(selection.keep_top(att.expected_scores(t.kv, epsilon=0.01, stats=att.query_statistics(t.kv)), 0.25)))
COV_SQL = "SELECT layer, qhead, CAST(i - 1 AS INT) AS i, CAST(j - 1 AS INT) AS j, round({}(q[i], q[j]), 6) AS c FROM q, (SELECT unnest(range(1, 33)) AS i), (SELECT unnest(range(1, 33)) AS j) WHERE q_pos >= 4 GROUP BY ALL"


def covariance(t: Tables, sample: bool) -> DataFrame:
    rows = att.query_statistics(t.kv, sample=sample).select("layer", "qhead", F.posexplode("sigma").alias("i", "r"))
    return rows.select("layer", "qhead", "i", F.posexplode("r").alias("j", "c")).withColumn("c", F.round("c", 6))


query("query_cov", with_kv(Q, COV_SQL.format("covar_pop")))(lambda t: covariance(t, False))
query("query_cov_samp", with_kv(Q, COV_SQL.format("covar_samp")))(lambda t: covariance(t, True))
query(
    "noncausal_attn",
    with_kv(
        Q,
        "cs AS (SELECT layer, batch, head, pos // 16 AS chunk, count(*) AS held FROM kv GROUP BY ALL)",
        "x AS (SELECT q.layer, q.batch, q.head, qhead, q_pos, pos, held, list_dot_product(q, key) AS x FROM q JOIN kv k ON q.layer = k.layer AND q.batch = k.batch AND q.head = k.head AND q_pos // 16 = pos // 16 JOIN cs ON cs.layer = k.layer AND cs.batch = k.batch AND cs.head = k.head AND cs.chunk = pos // 16)",
        "y AS (SELECT *, CASE WHEN held < 16 THEN greatest(max(x) OVER (PARTITION BY layer, batch, qhead, q_pos), -1e-9::DOUBLE) ELSE max(x) OVER (PARTITION BY layer, batch, qhead, q_pos) END AS top FROM x)",
        "z AS (SELECT *, exp(x - top) / (sum(exp(x - top)) OVER (PARTITION BY layer, batch, qhead, q_pos) + (16 - held) * exp(-1e-9::DOUBLE - top)) AS w FROM y)",
        "g AS (SELECT layer, batch, head, qhead, pos, sum(w) + CASE WHEN any_value(held) < 16 THEN (16 - any_value(held)) / (any_value(held) + (16 - any_value(held)) * exp(-1e-9::DOUBLE)) ELSE 0 END AS w FROM z GROUP BY layer, batch, head, qhead, pos)",
        f"h AS (SELECT {ID}, avg(w) AS w FROM g GROUP BY ALL)",
        f"r AS (SELECT {ID}, w * sqrt(list_dot_product(value, value)) AS s FROM h JOIN kv USING ({ID}))",
        f"p AS (SELECT {ID}, sum(s) OVER (PARTITION BY layer, batch, head ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS s FROM r)",
        f"s AS (SELECT {ID}, (s - avg(s) OVER (PARTITION BY layer)) / greatest(stddev_samp(s) OVER (PARTITION BY layer), 1e-6) AS score FROM p)",
        top("s"),
    ),
)(lambda t: shown(selection.keep_top(att.block_scores(t.kv, 16), 0.5)))
LAZY = (
    attention_sql(LAST.format(1)),
    "pm AS (SELECT layer, batch, qhead, q_pos, sum(CASE WHEN pos < 4 OR pos >= n - 16 THEN w ELSE 0 END) AS mass FROM a, sz GROUP BY ALL)",
    "lz AS (SELECT layer, avg(mass) AS mass, round(avg(mass), 9) > 0.2 AS lazy FROM pm GROUP BY layer)",
)
query("simlayer", with_kv(*LAZY, f"SELECT {ID}, round(mass, 6) AS mass FROM kv JOIN lz USING (layer), sz WHERE NOT lazy OR pos < 4 OR pos >= n - 15"))(
    lambda t: t.kv.join(F.broadcast(att.lazy_layers(t.kv, length(t), 0.2)), "layer").where(~F.col("lazy") | (F.col("pos") < 4) | (F.col("pos") >= length(t) - 15)).select(*KEYS, F.round("mass", 6).alias("mass"))
)


@query(
    "think",
    with_kv(
        Q,
        "q2 AS (SELECT layer, batch, head, i, avg(q[i] * q[i]) AS v FROM q, sz, (SELECT unnest(range(1, 33)) AS i) WHERE q_pos >= n - 16 GROUP BY ALL)",
        "k2 AS (SELECT layer, batch, head, i, avg(key[i] * key[i]) AS v FROM kv, (SELECT unnest(range(1, 33)) AS i) GROUP BY ALL)",
        "cz AS (SELECT layer, batch, head, i FROM q2 JOIN k2 USING (layer, batch, head, i) QUALIFY row_number() OVER (PARTITION BY layer, batch, head ORDER BY round(q2.v * k2.v, 9), i) <= floor(32 * CAST(0.5 AS DOUBLE)))",
        "cl AS (SELECT layer, batch, head, list(i) AS z FROM cz GROUP BY ALL)",
        f"SELECT {ID}, round(list_sum(list_transform(key, lambda x, i: CASE WHEN list_contains(z, i) THEN 0 ELSE x END)), 6) AS k FROM kv JOIN cl USING (layer, batch, head)",
    ),
)
def think(t: Tables) -> DataFrame:
    """Keys with the lowest-scored half of each head's channels set to 0; shown by their sums."""
    return att.without_channels(t.kv, length(t), 16, 0.5).select(*KEYS, F.round(F.aggregate("key", F.lit(0.0), lambda a, x: a + x), 6).alias("k"))


COMPOSE = (
    attention_sql(LAST.format(16)),
    "g AS (SELECT layer, batch, head, pos, avg(w) AS score FROM (SELECT layer, batch, head, qhead, pos, max(w) AS w FROM a GROUP BY ALL) GROUP BY ALL)",
    "h AS (SELECT layer, batch, head, pos, score + avg(score) OVER (PARTITION BY layer, batch, pos) AS score FROM g)",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY layer, batch, head ORDER BY round(score, 9) DESC, pos) AS rk FROM h)",
    "cp AS (SELECT layer, batch, rk, avg(score) AS c FROM rk GROUP BY ALL)",
    "c0 AS (SELECT layer, batch, rk, CASE WHEN layer = 0 THEN max(c) OVER (PARTITION BY batch, rk) ELSE c END AS c FROM cp)",
    "cn AS (SELECT layer, batch, count(*) AS budget FROM (SELECT * FROM c0 QUALIFY row_number() OVER (PARTITION BY batch ORDER BY round(c, 9) DESC, layer, rk) <= floor(count(*) OVER (PARTITION BY batch) * CAST(0.5 AS DOUBLE))) GROUP BY ALL)",
    f"SELECT {ID} FROM rk JOIN cn USING (layer, batch) WHERE rk <= budget",
)


@query("kvcompose", with_kv(*COMPOSE))
def kvcompose(t: Tables) -> DataFrame:
    return selection.composed_budget(att.composed_scores(t.kv, length(t), 16), 0.5)


query("kvzip_score", with_kv(attention_sql(), f"SELECT {ID}, round(max(w), 6) AS score FROM a GROUP BY ALL"))(
    lambda t: shown(presses.KVzip().score(t.kv))
)
query(
    "kvzip_chunks",
    with_kv(
        Q,
        "rows AS (SELECT * FROM kv, (VALUES ('own'), ('copy')) t(kind) WHERE pos >= 4 UNION ALL SELECT *, 'sink' FROM kv WHERE pos < 4)",
        """lg AS (SELECT q.layer, q.batch, q.head, qhead, q_pos, k.pos, kind, list_dot_product(q, key) / sqrt(32) AS x FROM q JOIN rows k ON q.layer = k.layer AND q.batch = k.batch AND q.head = k.head
  AND (kind = 'sink' OR ((k.pos - 4) // 96 = (q_pos - 4) // 96 AND (kind = 'own' OR k.pos <= q_pos))) WHERE q_pos >= 4)""",
        "a AS (SELECT *, exp(x) / sum(exp(x)) OVER (PARTITION BY layer, batch, qhead, q_pos) AS w FROM lg)",
        f"SELECT {ID}, round(max(w), 6) AS score FROM a WHERE kind = 'own' GROUP BY ALL UNION ALL SELECT {ID}, 1.0 FROM kv WHERE pos < 4",
    ),
)(lambda t: shown(presses.KVzip(chunk=96).score(t.kv)))


@query(
    "repeat_targets",
    with_kv(
        attention_sql("q_pos >= n // 2"),
        f"b AS (SELECT a.layer, a.batch, a.head, a.pos, max(w / sqrt(list_dot_product(o.key, o.key))) AS w FROM a JOIN kv o ON a.layer = o.layer AND a.batch = o.batch AND a.head = o.head AND a.q_pos = o.pos GROUP BY ALL)",
        f"SELECT {ID}, round(ln(w * sqrt(list_dot_product(value, value))), 6) AS score FROM b JOIN kv USING ({ID}), sz WHERE pos < n // 2",
    ),
)
def repeat_targets(t: Tables) -> DataFrame:
    """The second half of the cache as the copy of the first; a query's hidden state is stood for by its row's key."""
    n = length(t)
    spans = t.kv.groupBy("batch").agg(F.lit(0).alias("start"), F.lit(n // 2).alias("end"), F.lit(n // 2).alias("again_start"), F.lit(n).alias("again_end"))
    norms = t.kv.select(*HEAD, F.col("pos").alias("q_pos"), (1 / norm(F.col("key"))).alias("weight"))
    return shown(att.repeated_targets(t.kv, att.queries_of(t.kv).join(norms, [*HEAD, "q_pos"]), spans))


query("fastkvzip_protect", with_kv(S, f"SELECT {ID}, round(CASE WHEN pos < 4 OR pos >= n - floor(n * CAST(0.02 AS DOUBLE)) THEN 1.0 ELSE score END, 6) AS score FROM s, sz"))(
    lambda t: shown(scoring.key_norm(t.kv).withColumn("score", F.when((F.col("pos") < 4) | (F.col("pos") >= length(t) - F.floor(F.lit(length(t) * 0.02))), 1.0).otherwise(F.col("score"))))
)
query("kvzap_linear", with_kv(FILTERS, f"SELECT {ID}, round(list_dot_product(filter, key) + list_dot_product(filter, value) + layer * 0.5::DOUBLE, 6) AS score FROM kv JOIN f USING (layer, head)"))(
    lambda t: shown(t.kv.join(F.broadcast(dim_filters(t)), ["layer", "head"]).withColumn("score", dot(F.col("filter"), F.col("key")) + dot(F.col("filter"), F.col("value")) + F.col("layer") * 0.5))
)
query(
    "duo_head_score",
    with_kv(
        attention_sql(LAST.format(8)),
        "c AS (SELECT layer, head, qhead, q_pos, pos, sum(w) OVER (PARTITION BY layer, qhead, q_pos ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c FROM a)",
        "SELECT layer, head, round(avg(c), 6) AS score FROM c GROUP BY ALL",
    ),
)(
    lambda t: att.attention(att.last_queries(att.queries_of(t.kv), length(t), 8), t.kv)
    .withColumn("c", F.sum("w").over(Window.partitionBy(*att.QUERY, "q_pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    .groupBy("layer", "head")
    .agg(F.round(F.avg("c"), 6).alias("score"))
)
query(
    "attention_loss_curve",
    with_kv(
        attention_sql(LAST.format(8)),
        f"o AS (SELECT {ID}, sum(w) AS seen FROM a GROUP BY ALL)",
        S,
        f"SELECT {ID}, round(sum(seen) OVER (PARTITION BY layer, batch, head ORDER BY round(score, 9), pos ROWS UNBOUNDED PRECEDING) / sum(seen) OVER (PARTITION BY layer, batch, head), 6) AS lost FROM s JOIN o USING ({ID})",
    ),
)(
    lambda t: scoring.key_norm(t.kv)
    .join(att.attention(att.last_queries(att.queries_of(t.kv), length(t), 8), t.kv).groupBy(*KEYS).agg(F.sum("w").alias("seen")), KEYS)
    .select(*KEYS, F.round(F.sum("seen").over(Window.partitionBy(*HEAD).orderBy(F.round("score", 9), "pos").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("seen").over(scoring.every_head()), 6).alias("lost"))
)

# --- merging and rotation --------------------------------------------------------------------------------------------

NEAREST = (
    S,
    KEPT,
    f"u AS (SELECT {ID}, value, list_transform(key, lambda x: x / greatest(sqrt(list_dot_product(key, key)), 1e-6::DOUBLE)) AS u FROM kv)",
    f"ku AS (SELECT * FROM u SEMI JOIN kept USING ({ID}))",
    f"eu AS (SELECT * FROM u ANTI JOIN kept USING ({ID}))",
    """nr AS (SELECT e.layer, e.batch, e.head, e.pos, k.pos AS target, list_dot_product(e.u, k.u) AS sim FROM eu e JOIN ku k ON e.layer = k.layer AND e.batch = k.batch AND e.head = k.head
  QUALIFY row_number() OVER (PARTITION BY e.layer, e.batch, e.head, e.pos ORDER BY round(list_dot_product(e.u, k.u), 9) DESC, k.pos) = 1)""",
)
half = lambda t: selection.keep_top(scoring.key_norm(t.kv), 0.5)
query("merge_nearest", with_kv(*NEAREST, f"SELECT {ID}, target, round(sim, 6) AS sim FROM nr"))(lambda t: merging.nearest_kept(t.kv, half(t)).withColumn("sim", F.round("sim", 6)))


def merge_sql(gate: str) -> tuple[str, ...]:
    return (
        *NEAREST,
        gate,
        "w AS (SELECT ok.layer, ok.batch, ok.head, ok.target AS pos, greatest(sim, 0) * sqrt(list_dot_product(e.value, e.value)) / (sqrt(list_dot_product(e.value, e.value)) + sqrt(list_dot_product(k.value, k.value)) + 1e-6::DOUBLE) AS w, e.value AS ev FROM ok JOIN u e ON ok.layer = e.layer AND ok.batch = e.batch AND ok.head = e.head AND ok.pos = e.pos JOIN u k ON ok.layer = k.layer AND ok.batch = k.batch AND ok.head = k.head AND ok.target = k.pos)",
        "sm AS (SELECT layer, batch, head, pos, i, sum(w) AS w, sum(w * ev[i]) AS a FROM w, (SELECT unnest(range(1, 33)) AS i) GROUP BY ALL)",
        f"kc AS (SELECT {ID}, i, value[i] AS v FROM ku, (SELECT unnest(range(1, 33)) AS i))",
        f"SELECT {ID}, CAST(i - 1 AS INT) AS channel, round(CASE WHEN w > 0 THEN (v + a) / (1 + w) ELSE v END, 6) AS v FROM kc LEFT JOIN sm USING ({ID}, i)",
    )




def channels(kv: DataFrame, column: str = "value", *more: str) -> DataFrame:
    """A row for each channel of a vector."""
    return kv.select(*KEYS, *more, F.posexplode(column).alias("channel", "x")).select(*KEYS, *more, "channel", F.round("x", 6).alias("v"))


query("merge_on_evict", with_kv(*merge_sql("ok AS (SELECT * FROM nr WHERE sim >= 0)")))(lambda t: channels(merging.merge_evicted(t.kv, half(t))))
query("merge_fraction", with_kv(*merge_sql("ok AS (SELECT nr.* FROM nr JOIN (SELECT layer, batch, head, quantile_cont(sim, 0.75) AS cut FROM nr GROUP BY ALL) c USING (layer, batch, head) WHERE sim >= -1 AND sim >= cut)")))(
    lambda t: channels(merging.merge_evicted(t.kv, half(t), threshold=-1.0, fraction=0.25))
)
SLOTS = f"ks AS (SELECT layer, batch, head, pos, row_number() OVER (PARTITION BY layer, batch, head ORDER BY pos) AS slot FROM kept), ev AS (SELECT {ID} FROM kv ANTI JOIN kept USING ({ID}))"
query(
    "cam_range_join",
    with_kv(S, KEPT, SLOTS, "st AS (SELECT e.layer, e.batch, e.head, e.pos, (SELECT count(*) FROM kept k WHERE k.layer = e.layer AND k.batch = e.batch AND k.head = e.head AND k.pos <= e.pos) AS st FROM ev e)", "SELECT st.layer, st.batch, st.head, st.pos, ks.pos AS target FROM st JOIN ks ON st.layer = ks.layer AND st.batch = ks.batch AND st.head = ks.head AND slot BETWEEN st + 1 AND st + 4"),
)(lambda t: merging.following_slots(half(t), selection.mask(t.kv, half(t)), 4))


@query(
    "cam_merge",
    with_kv(
        attention_sql(LAST.format(32)),
        f"ac AS (SELECT {ID}, sum(w) / 2 AS att FROM a GROUP BY ALL)",
        S,
        "ms AS (SELECT layer, batch, pos, round(avg(score), 9) AS m FROM s GROUP BY ALL)",
        "rk AS (SELECT *, row_number() OVER (PARTITION BY layer, batch ORDER BY m DESC, pos) <= n // 2 AS stays FROM ms, sz)",
        "ks AS (SELECT layer, batch, pos, row_number() OVER (PARTITION BY layer, batch ORDER BY pos) AS slot FROM rk WHERE stays)",
        "ev AS (SELECT layer, batch, pos FROM rk WHERE NOT stays QUALIFY row_number() OVER (PARTITION BY layer, batch ORDER BY m DESC, pos DESC) <= 32)",
        "st AS (SELECT e.layer, e.batch, e.pos, (SELECT count(*) FROM ks k WHERE k.layer = e.layer AND k.batch = e.batch AND k.pos <= e.pos) AS st FROM ev e)",
        "tg AS (SELECT st.layer, st.batch, st.pos, ks.pos AS target FROM st JOIN ks ON st.layer = ks.layer AND st.batch = ks.batch AND slot BETWEEN st + 1 AND st + 4)",
        "pr AS (SELECT tg.layer, tg.batch, me.head, tg.pos, count(*) AS budget, any_value(me.att) / avg(x.att) AS p FROM tg JOIN ac me ON tg.layer = me.layer AND tg.batch = me.batch AND tg.pos = me.pos JOIN ac x ON tg.layer = x.layer AND tg.batch = x.batch AND me.head = x.head AND tg.target = x.pos GROUP BY ALL)",
        "dr AS (SELECT layer, batch, head, pos, budget FROM pr WHERE CAST('0x' || substr(md5(concat_ws(':', '11', layer, batch, head, pos)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < least(greatest(round(p, 9), 0), 1))",
        "sm AS (SELECT tg.layer, tg.batch, dr.head, tg.target AS pos, i, sum(kv.value[i] / budget) AS add1 FROM tg JOIN dr USING (layer, batch, pos) JOIN kv ON dr.layer = kv.layer AND dr.batch = kv.batch AND dr.head = kv.head AND dr.pos = kv.pos, (SELECT unnest(range(1, 33)) AS i) GROUP BY ALL)",
        f"kc AS (SELECT {ID}, i, value[i] AS v FROM kv SEMI JOIN ks USING (layer, batch, pos), (SELECT unnest(range(1, 33)) AS i))",
        "SELECT kc.layer, kc.batch, kc.head, kc.pos, CAST(kc.i - 1 AS INT) AS channel, round(v + coalesce(add1, 0), 6) AS v FROM kc LEFT JOIN sm ON kc.layer = sm.layer AND kc.batch = sm.batch AND kc.head = sm.head AND kc.pos = sm.pos AND kc.i = sm.i",
    ),
)
def cam_merge(t: Tables) -> DataFrame:
    """The last 32 tokens are decoded, then half of the cache goes: the values of the 32 best evicted slots are added to the next ones that stay; every channel is shown."""
    n = length(t)
    policy = cache.Merging(cache.key_norm, interval=32, target=n // 2, prefill=n - 32, budget=4)
    return channels(cache.fold(cache.tokens_of(t.kv, att.queries_of(t.kv), n), policy))


query(
    "rerotation_delta",
    with_kv(
        S,
        KEPT,
        f"rn AS (SELECT {ID}, CAST(row_number() OVER (PARTITION BY layer, batch, head ORDER BY pos) - 1 AS INT) AS new_pos, key FROM kv SEMI JOIN kept USING ({ID}))",
        "tn AS (SELECT *, i, (new_pos - pos) * pow(10000.0::DOUBLE, -((i - 1) % 16) / 16.0::DOUBLE) AS turn FROM rn, (SELECT unnest(range(1, 33)) AS i))",
        f"SELECT {ID}, new_pos, CAST(i - 1 AS INT) AS channel, round(CASE WHEN i <= 16 THEN key[i] * cos(turn) - key[i + 16] * sin(turn) ELSE key[i] * cos(turn) + key[i - 16] * sin(turn) END, 6) AS v FROM tn",
    ),
)(lambda t: channels(scoring.rerotated(selection.prune(t.kv, half(t))), "key", "new_pos"))


@query(
    "dim_histogram",
    """WITH x AS (SELECT i - 1 AS dim, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
b AS (SELECT dim, quantile_cont(x, 0.001) AS lo, quantile_cont(x, 0.999) AS hi FROM x GROUP BY dim),
v AS (SELECT dim, x, lo, hi FROM x JOIN b USING (dim) WHERE x >= lo AND x <= hi)
SELECT CAST(dim AS INT) AS dim, CAST(least(floor((x - lo) / (hi - lo) * 50), 49) AS INT) AS bin, count(*) AS n FROM v GROUP BY ALL""",
)
def dim_histogram(t: Tables) -> DataFrame:
    """Fifty bins between the outer thousandths, for each dimension."""
    x = t.embeddings.select(F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))
    cuts = x.groupBy("dim").agg(F.percentile("x", F.array(F.lit(0.001), F.lit(0.999))).alias("c"))  # a row for each dimension
    rows = x.join(F.broadcast(cuts.select("dim", F.get("c", F.lit(0)).alias("lo"), F.get("c", F.lit(1)).alias("hi"))), "dim").where("x >= lo AND x <= hi")
    return rows.select("dim", F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 50), F.lit(49)).cast("int").alias("bin")).groupBy("dim", "bin").agg(F.count("*").alias("n"))


# --- compositions by name ---------------------------------------------------------------------------------------------


def composition(name: str, sql: str, ratio: float = 0.5, **settings) -> None:
    """A press of the registry, shown by the rows that it keeps."""
    query(f"press_{name}", sql)(lambda t: presses.build(name, ratio, **settings).kept(t.kv))


IDS = f"SELECT {ID} FROM"
composition("no_press", with_kv(f"{IDS} kv"))
composition("adakv_snapkv", with_kv(*SNAP, ADA, f"{IDS} adk"))
composition("expected_attention", with_kv(*EA, ADA, f"{IDS} adk"))
composition("critical_snapkv", with_kv(*SNAP, CRIT, f"{IDS} c2 QUALIFY row_number() OVER (PARTITION BY layer, batch, head ORDER BY first DESC, round(score, 9) DESC, pos) <= floor(n * CAST(0.5 AS DOUBLE))"))
composition(
    "chunkkv",
    with_kv(
        *SNAP,
        "mc AS (SELECT layer, batch, pos // 20 AS chunk, avg(score) AS score FROM s GROUP BY ALL)",
        "bc AS (SELECT layer, batch, chunk FROM mc QUALIFY row_number() OVER (PARTITION BY layer, batch ORDER BY round(score, 9) DESC, chunk) <= greatest(floor(count(*) OVER (PARTITION BY layer, batch) * CAST(0.5 AS DOUBLE)), 1))",
        "SELECT s.layer, s.batch, s.head, s.pos FROM s JOIN bc ON s.layer = bc.layer AND s.batch = bc.batch AND s.pos // 20 = bc.chunk",
    ),
)
composition("kvzip", with_kv(attention_sql(), f"s AS (SELECT {ID}, max(w) AS score FROM a GROUP BY ALL)", GLOBAL.replace("0.3", "0.5"), f"ev AS ({IDS} s JOIN bg USING (layer) QUALIFY row_number() OVER (PARTITION BY layer ORDER BY round(score, 9), batch, head, pos) <= budget)", f"{IDS} kv ANTI JOIN ev USING ({ID})"))
query("press_merging_knorm", ORACLES["merge_on_evict"])(lambda t: channels(presses.build("merging_knorm", 0.5).compress(t.kv)))
composition("kvcompose", with_kv(*COMPOSE))
for name in ("knorm", "streaming_llm", "cur", "tova", "snapkv"):
    composition(name, f"SELECT {ID} FROM ({ORACLES[name]})")


# --- budgets ---------------------------------------------------------------------------------------------------------

PER_TOKEN = budgets.bytes_per_token(32, 8, 128, 2)


@query(
    "budget_tokens",
    f"""SELECT c_custkey, CAST(c_custkey % 40 + 1 AS DOUBLE) AS budget, CAST(floor(floor((c_custkey % 40 + 1) * 1000000::DOUBLE) / {PER_TOKEN}) AS BIGINT) AS tokens FROM customer""",
)
def budget_tokens(t: Tables) -> DataFrame:
    budget = (F.col("c_custkey") % 40 + 1).cast("double")
    return t.customer.select("c_custkey", budget.alias("budget"), F.floor(F.floor(budget * budgets.UNITS["MB"]) / PER_TOKEN).cast("long").alias("tokens"))


query(
    "budget_stats",
    f"""SELECT doc_id, least(n_chars, 1525) AS retained_tokens, round(1.0::DOUBLE - least(n_chars, 1525) / CAST(greatest(n_chars, 1) AS DOUBLE), 6) AS compression_ratio, n_chars * {PER_TOKEN} AS original_bytes,
least(n_chars, 1525) * {PER_TOKEN} AS retained_bytes, round(n_chars * {PER_TOKEN} / 1e6::DOUBLE, 6) AS original_mb, round(least(n_chars, 1525) * {PER_TOKEN} / 1e6::DOUBLE, 6) AS retained_mb FROM documents""",
)(
    lambda t: budgets.budget_columns(t.documents.select("doc_id", "n_chars"), F.col("n_chars"), PER_TOKEN, tokens=budgets.token_budget(200, "MB", PER_TOKEN))
    .drop("n_chars")
    .withColumns({c: F.round(c, 6) for c in ("compression_ratio", "original_mb", "retained_mb")})
)
