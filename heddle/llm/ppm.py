"""Language-model scoring by prediction by partial matching over bytes (operator 1).

Text is taken as its UTF-8 bytes, A-Z lower-cased, ended by an end symbol and preceded by start symbols. The model is a
trie of contexts of ORDER bytes and fewer with the counts of the symbols that followed them in the training texts. A
symbol is predicted from the longest known context. Escapes are estimated by method D: a context with T symbols seen of D
kinds escapes with D / 2T, and a symbol seen n times there has (n - 1/2) / T. On escape the symbols of the longer context are excluded below, so that their counts and
kinds are taken out of T and D there; what no context knows is uniform over the symbols left.

The model here is pretrained: counts do not change while a text is scored, so the score of a symbol depends on its
context alone, and a text's code length is a sum of lookups.

Scale. Training texts are counted in one pass: each batch counts its distinct (ORDER + 1)-grams and its words, Spark adds
them up with map-side aggregation. Shorter contexts are sums of longer ones. While each order has MAX_GRAMS grams at the most
the whole trie is broadcast; beyond that the costs of as many of the most frequent grams are, and all others are joined with the
whole counts, each document's distinct ones once, so no gram is left out. Word counts, exact and unbounded, come in two parts:
the HOT_WORDS most frequent as a broadcast table, all others by a join of each document's distinct rare words, in which
no key is hot because hot keys are in the table.

Defined cases: a null or empty text has the end symbol and the end token alone. Rows of equal id and text are scored once
and given for each row. A null id hashes as the text ''. Without training texts every symbol is uniform, and V = N = 0.
An empty table gives no rows. Further columns are ignored. Words of over 64 bytes are counted under a digest.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import NO_ID, claim, held_out, join_bounded, materialize, read, tidy

ORDER, MAX_GRAMS, HOT_WORDS, LONG_WORD = 5, 3 << 19, 1 << 17, 64
END, START, SYMBOLS, BITS = 256, 257, 257, 9
PIECE_BYTES, COUNT_BYTES, BROADCAST_ROWS = 1 << 20, 1 << 22, 100_000
END_TOKEN = b" end"  # words hold no spaces, so this is none


def word_key(w: bytes) -> bytes:
    return w if len(w) <= LONG_WORD else b" " + hashlib.md5(w).hexdigest().encode()


def symbols_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams (order + 1 symbols, the last one to be predicted) of texts laid end to end, and the number of each text's symbols."""
    counts = np.array([len(x) + 1 for x in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(counts + order)[:-1]])
    line = np.full(int((counts + order).sum()), START, np.uint16)
    inside = np.ones(len(line), bool)
    for k in range(order):
        inside[starts + k] = False
    body = np.full(int(counts.sum()), END, np.uint16)
    keep = np.ones(len(body), bool)
    keep[np.cumsum(counts) - 1] = False
    body[keep] = np.frombuffer(b"".join(texts), np.uint8)
    line[inside] = body
    gram = np.zeros(len(line) - order, np.int64)
    for k in range(order + 1):
        gram <<= BITS
        gram |= line[k : len(line) - order + k]
    return gram[inside[order:]], counts


def pieces(texts: list[str | None], most: int = PIECE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about `most` bytes in all, as lower-cased bytes, with the place of the first."""
    held, size, first = [], 0, 0
    for i, x in enumerate(texts):
        held.append((x or "").encode().lower())
        size += len(held[-1])
        if size >= most:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def count(train: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, word, n: one of gram and word is null. Counts over all rows of train (column text)."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ppm_count")  # a trie that this process still holds from scoring goes first
        for batch in batches:
            words: Counter = Counter()
            for _, held in pieces(batch.column("text").to_pylist(), COUNT_BYTES):
                gram, n = np.unique(symbols_of(held, order)[0], return_counts=True)
                yield rows(pa.array(gram), pa.nulls(len(gram), pa.binary()), pa.array(n))
                for x in held:
                    words.update(x.split())
                words[END_TOKEN] += len(held)
                if len(words) > 150_000:
                    yield word_rows(words)
                    words = Counter()
            if words:
                yield word_rows(words)

    def word_rows(words: Counter) -> pa.RecordBatch:
        return rows(pa.nulls(len(words), pa.int64()), pa.array([word_key(w) if w != END_TOKEN else w for w in words], pa.binary()), pa.array(list(words.values()), pa.int64()))

    def rows(*columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(columns), ["gram", "word", "n"])

    return train.select("text").mapInArrow(tidy(tally), "gram long, word binary, n long").groupBy("gram", "word").agg(F.sum("n").alias("n"))


class Trie:
    """Counts of each order as sorted grams, with the costs that scoring looks up. levels[k]: grams of k + 1 symbols and their counts."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(levels) - 1
        self.grams, self.log_n = [], []
        self.contexts, self.log_den, self.log_esc, self.log_den_x, self.log_esc_x = [], [], [], [], []
        for k, (grams, n) in enumerate(levels):
            contexts, first = np.unique(grams >> BITS, return_index=True)
            kinds = np.diff(np.append(first, len(grams)))
            total = np.add.reduceat(n, first) if len(grams) else np.zeros(0, np.int64)
            self.grams.append(grams)
            self.log_n.append(np.log10(n - 0.5))
            self.contexts.append(contexts)
            self.log_den.append(np.log10(total))
            self.log_esc.append(np.log10(kinds / (2 * total)))
            if k:  # the shorter context, without this context's symbols
                low_grams, low_n = levels[k - 1]
                mask = (1 << (BITS * k)) - 1
                at = np.searchsorted(low_grams, grams & mask)
                out_n = np.add.reduceat(low_n[at], first) if len(grams) else np.zeros(0, np.int64)
                low_contexts, low_first = np.unique(low_grams >> BITS, return_index=True)
                c = np.searchsorted(low_contexts, contexts & (mask >> BITS))
                left_n = np.add.reduceat(low_n, low_first)[c] - out_n
                left_kinds = np.diff(np.append(low_first, len(low_grams)))[c] - kinds
                with np.errstate(divide="ignore", invalid="ignore"):
                    self.log_den_x.append(np.log10(left_n))
                    self.log_esc_x.append(np.where(left_kinds > 0, np.log10(left_kinds / np.maximum(2 * left_n, 1)), 0.0))
            else:
                self.log_den_x.append(None)
                self.log_esc_x.append(None)
        left = SYMBOLS - len(levels[0][0])
        self.log_new = -math.log10(left) if left > 0 else -math.inf
        self.table_keys, self.table_values = open_table(self.grams[-1], self.cost(self.grams[-1])) if len(self.grams[-1]) else (None, None)

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last symbol after the symbols before it."""
        out = np.zeros(len(grams))
        open_, above = np.arange(len(grams)), np.full(len(grams), -1)  # above: place of the longer context that was escaped from
        for k in range(self.order, -1, -1):
            if not len(open_):
                return out
            mask = (1 << (BITS * (k + 1))) - 1
            g = grams[open_] & mask
            if not len(self.grams[k]):
                continue
            at = np.minimum(np.searchsorted(self.grams[k], g), len(self.grams[k]) - 1)
            hit = self.grams[k][at] == g
            c = np.minimum(np.searchsorted(self.contexts[k], g >> BITS), len(self.contexts[k]) - 1)
            known = self.contexts[k][c] == g >> BITS
            was = above >= 0
            den, esc = self.log_den[k][c], self.log_esc[k][c]
            if k < self.order and was.any():
                den = np.where(was, self.log_den_x[k + 1][np.maximum(above, 0)], den)
                esc = np.where(was, self.log_esc_x[k + 1][np.maximum(above, 0)], esc)
            out[open_] += np.where(hit, self.log_n[k][at] - np.where(hit, den, 0.0), np.where(known, esc, 0.0))
            stay = ~hit
            open_, above = open_[stay], np.where(known, c, -1)[stay]
        out[open_] += self.log_new
        return out

    def score(self, grams: np.ndarray) -> np.ndarray:
        """As cost, but grams of the longest order are read off a hash table."""
        if self.table_keys is None:
            return self.cost(grams)
        out, lost = look_up(self.table_keys, self.table_values, grams)
        if len(lost):
            rare, back = np.unique(grams[lost], return_inverse=True)
            out[lost] = self.cost(rare)[back]
        return out


def slots(grams: np.ndarray, size: int) -> np.ndarray:
    x = grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) & np.uint64(size - 1)).astype(np.int64)


def open_table(grams: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(4, int(2 * len(grams)).bit_length())
    keys, held = np.full(size, -1, np.int64), np.zeros(size)
    slot, rest = slots(grams, size), np.arange(len(grams))
    while len(rest):
        free = keys[slot[rest]] == -1
        keys[slot[rest[free]]] = grams[rest[free]]
        placed = free & (keys[slot[rest]] == grams[rest])
        held[slot[rest[placed]]] = values[rest[placed]]
        rest = rest[~placed]
        slot[rest] = (slot[rest] + 1) & (size - 1)
    return keys, held


def look_up(keys: np.ndarray, values: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of grams in an open table, and the places of those that it does not hold."""
    size = len(keys)
    slot = slots(grams, size)
    found = keys[slot]
    out = values[slot]
    open_ = np.flatnonzero(found != grams)
    missing = [open_[found[open_] == -1]]
    open_ = open_[found[open_] != -1]
    while len(open_):
        slot[open_] = (slot[open_] + 1) & (size - 1)
        found_now = keys[slot[open_]]
        hit = found_now == grams[open_]
        out[open_[hit]] = values[slot[open_[hit]]]
        missing.append(open_[found_now == -1])
        open_ = open_[~hit & (found_now != -1)]
    return out, np.concatenate(missing)


def low_bits(k: int, c: str = "gram") -> Column:
    """The last k symbols."""
    return F.col(c).bitwiseAND((1 << (BITS * k)) - 1)


def levels_of(counts: DataFrame, order: int) -> list[tuple[DataFrame, int]]:
    """gram and n of every order, whole, and the number of grams."""
    out = []
    for k in range(order, -1, -1):
        level = counts.groupBy(low_bits(k + 1).alias("gram")).agg(F.sum("n").alias("n")) if k < order else counts
        level = materialize(level)
        out.append((level, level.count()))
    return out[::-1]


def as_arrays(level: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = level.toArrow()
    grams, n = rows.column("gram").to_numpy(), rows.column("n").to_numpy()
    by = np.argsort(grams)
    return grams[by], n[by]


def seen_costs(level: DataFrame) -> DataFrame:
    """gram, n and cost of each gram of the longest order."""
    totals = level.groupBy(F.shiftright("gram", BITS).alias("context")).agg(F.sum("n").alias("total"))
    return level.withColumn("context", F.shiftright("gram", BITS)).join(totals, "context").select("gram", "n", (F.log10(F.col("n") - 0.5) - F.log10("total")).alias("cost"))


def unseen_costs(asked: DataFrame, levels: list[tuple[DataFrame, int]]) -> DataFrame:
    """gram and cost of grams of the longest order (asked, distinct), by all levels: Trie.cost as joins."""
    out = asked.select("gram", F.lit(0.0).alias("cost"), F.lit(False).alias("done"), F.lit(None).cast("long").alias("x_n"), F.lit(None).cast("long").alias("x_kinds"))
    stats = [level.groupBy(F.shiftright("gram", BITS).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds")) for level, _ in levels]
    for k in range(len(levels) - 1, -1, -1):
        level, held = levels[k]
        contexts = stats[k]
        if k:  # the shorter context, without this context's symbols
            low, n_low = levels[k - 1]
            lower = low.select(F.col("gram").alias("low"), F.col("n").alias("low_n"))
            gone = join_bounded(level.select(F.shiftright("gram", BITS).alias("context"), low_bits(k).alias("low")), lower, ["low"], "inner", n_low, BROADCAST_ROWS)
            gone = gone.groupBy("context").agg(F.sum("low_n").alias("gone_n"), F.count("*").alias("kinds")).withColumn("below", low_bits(k - 1, "context"))
            below = stats[k - 1].select(F.col("context").alias("below"), F.col("total").alias("below_n"), F.col("kinds").alias("below_kinds"))
            gone = join_bounded(gone, below, ["below"], "inner", n_low, BROADCAST_ROWS)
            left = gone.select("context", (F.col("below_n") - F.col("gone_n")).alias("left_n"), (F.col("below_kinds") - F.col("kinds")).alias("left_kinds"))
            contexts = contexts.join(left, "context")
        else:
            contexts = contexts.withColumns({"left_n": F.lit(None).cast("long"), "left_kinds": F.lit(None).cast("long")})
        contexts = materialize(contexts)
        out = join_bounded(out.withColumn("own", low_bits(k + 1)), level.select(F.col("gram").alias("own"), "n"), ["own"], "left", held, BROADCAST_ROWS)
        out = join_bounded(out.withColumn("context", F.shiftright("own", BITS)), contexts, ["context"], "left", held, BROADCAST_ROWS)
        hit = F.log10(F.col("n") - 0.5) - F.log10(F.coalesce("x_n", "total"))
        cut = F.when(F.col("x_kinds") > 0, F.log10(F.col("x_kinds") / F.greatest(2 * F.col("x_n"), F.lit(1)))).otherwise(0.0)
        escape = F.when(F.col("total").isNull(), 0.0).when(F.col("x_n").isNotNull(), cut).otherwise(F.log10(F.col("kinds") / (2 * F.col("total"))))
        step = F.when(F.col("done"), 0.0).when(F.col("n").isNotNull(), hit).otherwise(escape)
        out = out.select("gram", (F.col("cost") + step).alias("cost"), (F.col("done") | F.col("n").isNotNull()).alias("done"), F.col("left_n").alias("x_n"), F.col("left_kinds").alias("x_kinds"))
    rest = SYMBOLS - levels[0][1]
    return out.select("gram", (F.col("cost") + F.when(F.col("done"), 0.0).otherwise(-math.log10(rest) if rest > 0 else -math.inf)).alias("cost"))


#: Counts, or ranges of counts, that are looked at in one step of least_count.
COUNT_STEPS = 1 << 16


def least_count(level: DataFrame, most: int, steps: int = COUNT_STEPS) -> int:
    """The smallest count that leaves `most` rows (n) at the most, whatever the counts are: each step cuts the range that still holds the answer into `steps` parts."""
    low, high, above = 1, (level.agg(F.max("n")).first()[0] or 0) + 1, 0
    while low < high:
        width = -(-(high - low) // steps)
        part = F.expr(f"cast((n - {low}) div {width} AS long)")
        held = {r["part"]: r["count"] for r in level.where(F.col("n").between(low, high - 1)).groupBy(part.alias("part")).count().collect()}  # `steps` rows at most
        for k in sorted(held, reverse=True):
            if above + held[k] > most:
                break
            above += held[k]
        else:
            return low
        low, high = low + k * width, min(high, low + (k + 1) * width)
        if width == 1:
            return high
    return low


def hot_words(words: DataFrame, most: int) -> tuple[dict[bytes, int], int]:
    """The most frequent words, `most` at the most, and the count that they all reach."""
    floor = least_count(words, most)
    rows = words.where(F.col("n") >= floor).toArrow()
    return dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist(), strict=True)), floor


@lru_cache(maxsize=1)
def _trie(levels) -> Trie:
    return Trie(levels.value)


@lru_cache(maxsize=1)
def _table(costs) -> tuple[np.ndarray, np.ndarray]:
    return open_table(*costs.value)


def rare_grams(gram: np.ndarray, n: np.ndarray, lost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text, gram and number of each text's distinct grams at the places `lost`; n: symbols of each text."""
    of, own = np.searchsorted(np.cumsum(n), lost, "right"), gram[lost]
    by = np.lexsort((own, of))
    of, own = of[by], own[by]
    first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (own[1:] != own[:-1]))[: len(of)])
    return of[first], own[first], np.diff(np.append(first, len(of)))


def score_texts(docs: DataFrame, counts: DataFrame, order: int = ORDER, max_grams: int = MAX_GRAMS, most_hot: int = HOT_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of docs (doc_id, text)."""
    context = docs.sparkSession.sparkContext
    words = materialize(counts.where("word IS NOT NULL").select("word", "n"))
    levels = levels_of(counts.where("word IS NULL").select("gram", "n"), order)
    whole = all(held <= max_grams for _, held in levels)
    n_all, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    table, floor = hot_words(words, most_hot)
    held_hot = context.broadcast(table)
    if whole:
        held_levels = context.broadcast([as_arrays(level) for level, _ in levels])
    else:
        seen = materialize(seen_costs(levels[-1][0]))
        often = seen.where(F.col("n") >= least_count(seen, max_grams)).select("gram", F.col("cost").alias("n"))
        held_costs = context.broadcast(as_arrays(often))

    names = ["k1", "k2", "word", "m", "tokens", "known", "total", "score", "copies", "gram"]
    kinds_ = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ppm", lambda: (_trie.cache_clear(), _table.cache_clear()))
        hot = held_hot.value
        for batch in batches:
            k1, k2, texts = batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text").to_pylist()
            for first, held in pieces(texts):
                gram, n = symbols_of(held, order)
                if whole:
                    cost = _trie(held_levels).score(gram)
                else:
                    cost, lost = look_up(*_table(held_costs), gram)
                    cost[lost] = 0.0
                    of, own_gram, m = rare_grams(gram, n, lost)
                    a, b = (np.array(k[first : first + len(held)], np.int64)[of] for k in (k1, k2))
                    none = [pa.nulls(len(of), t) for t in kinds_]
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none[2], pa.array(m, pa.int64()), *none[4:9], pa.array(own_gram)], names)
                score = np.add.reduceat(cost, np.concatenate([[0], np.cumsum(n)[:-1]]))
                out: list[tuple] = []
                for i, x in enumerate(held):
                    own = Counter(x.split())
                    own[END_TOKEN] = 1
                    known, total, tokens = 0, 0.0, 0
                    a, b = k1[first + i], k2[first + i]
                    for w, m in own.items():
                        tokens += m
                        c = hot.get(w)
                        if c is None:
                            key = word_key(w) if w != END_TOKEN else w
                            c = hot.get(key)
                        if c is None:
                            out.append((a, b, key, m, None, None, None, None, None, None))
                        else:
                            known += m
                            total += m * math.log10(c + 0.5)
                    # the row of the document itself, under a key that no word has
                    out.append((a, b, b" %d %d" % (a, b), None, tokens, known, total, float(score[i]), 1, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds_, strict=True)], names)

    schema = "k1 long, k2 long, word binary, m long, tokens long, known long, total double, score double, copies long, gram long"
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("k2"), "text").mapInArrow(tidy(apply), schema)
    rare = words.where(F.col("n") < floor)
    if whole:
        met = rows.join(rare, "word", "left")
    else:
        rows = materialize(rows)
        lost = rows.where("gram IS NOT NULL")
        unseen = unseen_costs(materialize(lost.select("gram").distinct().join(seen, "gram", "left_anti")), levels)
        costs = seen.select("gram", "cost").unionByName(unseen)
        met = rows.where("gram IS NULL").join(rare, "word", "left").drop("gram")
        priced = lost.join(costs, "gram").withColumns({"score": F.col("m") * F.col("cost"), "m": F.lit(None).cast("long"), "n": F.lit(None).cast("long")})
        met = met.unionByName(priced.drop("gram", "cost"))
    cost = F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))
    sums = met.groupBy("k1", "k2").agg(
        F.sum("copies").alias("copies"),
        F.sum("tokens").alias("tokens"),
        (F.sum("known") + F.coalesce(F.sum(F.when(F.col("n").isNotNull(), F.col("m"))), F.lit(0))).alias("known"),
        (F.sum("total") + F.coalesce(F.sum(cost), F.lit(0.0))).alias("total"),
        F.sum("score").alias("score"),
    )
    each = lambda c: F.col(c) / F.col("copies")
    n_tokens = F.expr("tokens div copies")
    return sums.select(
        F.when(F.col("k1") != NO_ID, F.col("k1")).alias("doc_id"),
        n_tokens.alias("n_tokens"),
        F.expr("known div copies").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (each("total") - n_tokens * math.log10(n_all + 0.5 * (kinds + 1))).alias("base_score"),
        each("score").alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def op1_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    fold = held_out(F.col("doc_id"), 5, 1)
    counts = materialize(count(docs.where(~fold)))
    scored = score_texts(docs, counts)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
