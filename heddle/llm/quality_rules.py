"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame operations only (operator 7).

A text is cut into word-like runs and single other characters; single tokens and neighbouring pairs are hashed into
BUCKETS buckets. Two multinomials over the buckets are estimated, one of the trusted documents and one of the whole
corpus, each with the pseudo-count `prior` in every bucket. A document's ratio is the mean, over its n-grams, of
ln(trusted / raw). It is kept if no base rule fails and the ratio is at least `least_ratio`.

Scale. Texts are never shuffled. One pass counts buckets with map-side aggregation; the two multinomials are BUCKETS
rows, broadcast whatever the input; the second pass scores n-grams where they are read and shuffles one number a document.
Raw counts cover all documents. The trusted multinomial is fitted on labelled rows whose id hashes below a threshold
chosen so that TRUSTED_ROWS are expected at most: that bound is what makes the broadcast of their ids safe.

Defined cases: a null or blank text has no words, fails the base rules and is dropped. Without trusted rows the ratio
is 0 for every document, so the base rules decide alone. Repeated rows are scored one by one, null ids are never
trusted. Several labels for one id: it is trusted if any of them says so. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import SPACES, materialize, read, words

BUCKETS, TRUSTED_ROWS, PRIOR, LEAST_RATIO = 1 << 16, 200_000, 1.0, -0.5
#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
HALF = 2**63


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def explode_ngrams(docs: DataFrame, keys: list[str], text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """keys and bucket: one row for each token and one for each pair of neighbouring tokens."""
    tokens = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))
    # tokens become hashes once, in a column of their own: expressions inside lambdas would be evaluated for each element
    hashed = docs.select(*keys, F.transform(tokens, lambda x: F.xxhash64(x)).alias("_t"))
    bucket = lambda *h: F.pmod(F.xxhash64(*h), F.lit(buckets)).cast("int")
    pairs = F.transform("_t", lambda x, i: F.when(i > 0, bucket(x, F.get("_t", i - 1))))
    return hashed.select(*keys, F.explode(F.concat(F.transform("_t", lambda x: bucket(x)), pairs)).alias("bucket")).where("bucket IS NOT NULL")


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("_w", words(F.col(text_col)))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(without(x, SPACES + " ")) > 0)
    out = out.withColumns({"_lines": lines, "_hashes": F.transform(F.slice("_w", 1, F.greatest(F.size("_w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)))})
    # only texts in which some window recurs take the sorted path
    pairs = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_pairs", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), pairs))
    hash_at = lambda i: F.get("_pairs", i)["h"]
    twice = F.filter("_pairs", lambda x, i: x["h"].eqNullSafe(hash_at(i - 1)) | x["h"].eqNullSafe(hash_at(i + 1)))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")))["n"]
    out = out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(without(text, SPACES + " ")).cast("long"),
            "n_symbols": (F.length(text) - F.length(without(text, SYMBOLS))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    )
    return out.drop("_w", "_lines", "_hashes", "_pairs").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def trusted_sample(labels: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of documents labelled as good, all of them or a fixed hash sample of about `most`."""
    ids = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    n = ids.count()
    return ids if n <= most else ids.where(F.xxhash64("doc_id") < F.lit(int(-HALF + 2 * HALF * (most / n))))


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """One row for each bucket that occurs: bucket, weight = ln(trusted / raw)."""
    seen = docs.join(F.broadcast(trusted.withColumn("trusted", F.lit(1))), "doc_id", "left")
    counts = materialize(
        explode_ngrams(seen, ["trusted"], buckets=buckets).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("trusted").alias("good"))
    )
    raw, good = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    share = lambda c, total: F.log((F.col(c) + prior) / (total + prior * buckets))
    return counts.select("bucket", (share("good", good) - share("raw", raw) if good else F.lit(0.0)).alias("weight"))


def judge(docs: DataFrame, weights: DataFrame, least_ratio: float = LEAST_RATIO, buckets: int = BUCKETS) -> DataFrame:
    """docs (doc_id, text) with the base rules, `ratio` (mean ln(trusted / raw) of the text's n-grams) and kept; without the text.
    Rows with the same id and text have the same ratio, so they may share its key."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    grams = explode_ngrams(keyed, ["doc_id", "text_hash"], buckets=buckets)
    # the weights have `buckets` rows at most, whatever the input
    ratios = grams.join(F.broadcast(weights), "bucket").groupBy("doc_id", "text_hash").agg(F.avg("weight").alias("ratio")).alias("r")
    rows = base_rules(keyed).drop("text").alias("d")
    same = F.expr("d.doc_id <=> r.doc_id AND d.text_hash = r.text_hash")
    out = rows.join(ratios, same, "left").select("d.*", F.coalesce("ratio", F.lit(0.0)).alias("ratio")).drop("text_hash")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= least_ratio))


def op7_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    weights = fit(docs, trusted_sample(read(spark, sf_dir, "labels")))
    out = judge(docs, weights)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")
