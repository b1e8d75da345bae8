"""Corpus pipeline: toxicity, near-duplicates, repeated substrings, source mixing, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next stage's docs. All
but the last return the columns of docs. SQL can't express the first and the last stage, so there is no ORACLE_SQL; the tests
compare run() with a brute-force version.

Defined cases follow the operators: null and empty texts score as the bias alone, link with nothing and stay until the mix,
which takes no text without words; a null id is kept like any other; of rows that repeat one id and are near copies, one
stays; an empty table passes through all stages. Further columns pass through unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import mixing, near_documents, pieces, substrings, toxicity
from heddle.llm.common import NO_ID, Owner, join_bounded, materialize, read, words

SHINGLE, PERCENT, BROADCAST_ROWS = 5, 80, 200_000


def packed(docs: DataFrame) -> DataFrame:
    """doc_id and text beside the whole row, so that no column of docs can clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct("*").alias("_row"))


def unpacked(rows: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of docs; text, where given, replaces text and n_chars."""
    new = {} if text is None else {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return unpacked(toxicity.score(packed(docs), model).where(F.col("score") < toxicity.THRESHOLD), docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, that of the smallest id; rows are told apart by a key of their own, as ids may be null or repeat."""
    rows = materialize(docs.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_key")))
    found = near_documents.near_duplicates(rows.select(F.col("_key").alias("doc_id"), F.col("_row.text").alias("text")), SHINGLE, PERCENT)
    found = materialize(found.select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_part")))
    ids = rows.select("_key", F.coalesce(F.col("_row.doc_id").cast("long"), F.lit(NO_ID)).alias("_id"))
    first = found.join(ids, "_key").groupBy("_part").agg(F.min(F.struct("_id", "_key"))["_key"].alias("_key"))
    gone = materialize(found.join(first, "_key", "left_anti").select("_key"))
    return unpacked(join_bounded(rows, gone, ["_key"], "left_anti", gone.count(), BROADCAST_ROWS), docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a repeated passage stay as they are; those of which nothing is left go."""
    cut = substrings.remove(packed(docs)).where("n_removed < n_words OR n_words = 0")
    return unpacked(cut, docs, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))


def parts_of(taken: Column) -> Column:
    """`taken` words as whole documents of `size` words and a rest."""
    return F.transform(F.sequence(F.lit(0), ((taken - 1) / F.col("size")).cast("int")), lambda k: F.least(taken - k * F.col("size"), F.col("size")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole, and once more cut to the words taken last. Rows of equal id, text and source share
    what is taken of them; what does not divide by their number is given once, by one of them."""
    null_safe = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))).alias("_source")
    own = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), null_safe]
    key = ["_id", "_source", "_hash"]
    mixed = mixing.mix(docs.select("doc_id", "text", "source")).select(*own, F.coalesce("text_hash", F.lit(0)).alias("_hash"), "size", "taken")
    plan = mixed.groupBy(*key, "size").agg(F.sum("taken").alias("_taken"), F.count("*").alias("_rows")).where("_taken > 0")
    plan = materialize(plan.select(*key, "size", F.expr("_taken div _rows").alias("_share"), (F.col("_taken") % F.col("_rows")).alias("_rest")))
    rows = docs.select(*own, F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_hash"), F.col("text").alias("_text"), F.struct("*").alias("_row"))
    hashable = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]

    shared, rest = plan.where("_share > 0"), materialize(plan.where("_rest > 0"))
    out = join_bounded(rows, shared, key, "inner", shared.count(), BROADCAST_ROWS).select("_row", "_text", "size", F.explode(parts_of(F.col("_share"))).alias("part"))
    first = join_bounded(rows.withColumn("_order", F.xxhash64(*(F.col("_row")[c] for c in hashable))), rest, key, "inner", rest.count(), BROADCAST_ROWS)
    first = first.groupBy(*key, "size", "_rest").agg(F.min_by("_row", "_order").alias("_row"), F.min("_text").alias("_text"))
    out = out.unionByName(first.select("_row", "_text", "size", F.explode(parts_of(F.col("_rest"))).alias("part")))
    text = F.when(F.col("part") == F.col("size"), F.col("_text")).otherwise(F.array_join(F.slice(words(F.col("_text")), 1, F.col("part").cast("int")), " "))
    return unpacked(out, docs, text)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, piece_ids and lossless: a sampled segmentation for each row."""
    import public_tokenizers

    coded = pieces.encode_pieces(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "source", "piece_ids", "lossless")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_of_near_copies),
    ("repeated_passages", cut_repeated_passages),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: None: SQL can't express learning, nor sampling from a lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    with Owner() as own:  # tables of other results stay
        for k, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = materialize(docs)
                own.release(keep=docs)
    return docs
