"""MinHash near-deduplication with odd sketches (operator 6).

A document's set holds the hashes of its word shingles. Documents with equal sets are one class. Each class has
BANDS * ROWS MinHash samples: bands of them are bucket keys, and all of them together are folded into an odd sketch, a
bitmap of SKETCH_BITS parities, whose exclusive-or has few bits set when two sets are alike. Pairs of a bucket are
taken only if their sizes and sketches allow the similarity, and are linked only if their full sets confirm it.

Not all pairs of a bucket are looked at, yet no component is lost. Every bucket names LEADERS leaders, and its members are
compared with these alone; linked ones join. Then what still lies in different components of one bucket is compared: pair
by pair in buckets of PAIR_BUCKET members at most, and in tiles of two blocks of members in larger ones, where sketches
are compared as a matrix and full sets as a product of matrices. A tile holds each text once and gives no pairs.

Scale. Texts are read once for sets and once for the members of shared buckets; bucket rows are numbers. A group of very
many near copies costs LEADERS comparisons for each member, and its tiles only what is still apart. Joins that meet a hot
leader or hot bucket are plain joins, which adaptive execution can split; a hot bucket is dealt to as many tiles as it needs.

With 32 bands of 6, a pair of similarity 0.8 meets in some bucket with probability 0.99994, and the sketch bound lies four
deviations beyond 0.8.

Defined cases: null, blank texts have the empty set and link with nothing. Texts shorter than a shingle are one shingle.
Links are between texts: rows that share an id, or have none, are linked by their own texts alone. A component is named by its
smallest id, and a null id counts as the smallest of all. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import NO_ID, claim, hash_words, join_bounded, materialize, mix64, read, text_slices, tidy
from heddle.llm.components import components

SHINGLE, PERCENT, BANDS, ROWS, SKETCH_BITS, LEADERS = 4, 80, 32, 6, 512, 3
PAIR_BUCKET, TILE, SHARED_COLUMNS, BROADCAST_ROWS = 64, 512, 8192, 100_000

_random = np.random.default_rng(20)
_ODD = _random.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _random.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Of each text, the distinct hashes of its shingles of `size` words, A-Z lower-cased, in order; a shorter text is one shingle."""
    h, counts = hash_words(column, lower=True)
    ends = np.cumsum(counts)
    whole = np.full(max(len(h) - size + 1, 0), size, np.uint64)
    for j in range(size):
        whole = mix64(whole + h[j : len(h) - size + 1 + j]) if len(whole) else whole
    out = []
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        else:
            short = np.full(min(b - a, 1), b - a, np.uint64)
            for j in range(a, b):
                short = mix64(short + h[j : j + 1])
            out.append(short)
    return out


def min_hash(held: np.ndarray) -> np.ndarray:
    """BANDS * ROWS samples of a set of hashes: the smallest of each of as many permutations of their upper halves."""
    upper, out = (held >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for k in range(0, len(upper), 512):
        out = np.minimum(out, (_ODD[:, None] * upper[None, k : k + 512] + _ADD[:, None]).min(axis=1))
    return out.astype(np.uint64)


def bands_of(sample: np.ndarray) -> np.ndarray:
    rows = sample.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        out = mix64(out + rows[:, j])
    return out


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parities as 64-bit words: each sample, with its number, flips one bit."""
    bit = mix64(sample + np.arange(len(sample), dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) % np.uint64(SKETCH_BITS)
    parity = (np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view("<i8")


def most_bits(percent: int) -> int:
    """Bits in which the sketches of two sets of this similarity differ at most: four deviations over the mean."""
    k, n, j = BANDS * ROWS, SKETCH_BITS, percent / 100
    d = 2 * k * (1 - j)
    mean = n / 2 * (1 - (1 - 2 / n) ** d)
    slope = np.exp(-2 * d / n)
    return int(np.ceil(mean + 4 * np.sqrt((2 * slope) ** 2 * k * j * (1 - j) + n / 4 * (1 - slope**2) * slope + 1)))


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """docs: k1, k2, text. k1, k2, n (set size), digest (of the set), bands, sketch."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_documents")
        longs = pa.list_(pa.int64())
        for batch in batches:
            for part in text_slices(batch, "text"):
                n, digest, bands, sketch = [], [], [], []
                for held in shingle_sets(part.column("text"), shingle):
                    sample = min_hash(held)
                    n.append(len(held))
                    digest.append(xxhash.xxh3_128_digest(held.tobytes()))
                    bands.append(bands_of(sample).view(np.int64) if len(held) else None)
                    sketch.append(odd_sketch(sample) if len(held) else None)
                yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, longs), pa.array(sketch, longs)], ["k1", "k2", "n", "digest", "bands", "sketch"])

    return docs.select("k1", "k2", "text").mapInArrow(tidy(sign), "k1 long, k2 long, n long, digest binary, bands array<long>, sketch array<long>")


def likely(percent: int) -> Column:
    """Whether sizes (na, nb) and sketches (sa, sb) allow the similarity."""
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    # written out word by word, as compiled code inside the join; a lambda would be interpreted for each pair
    bits = sum(F.bit_count(F.get("sa", F.lit(i)).bitwiseXOR(F.get("sb", F.lit(i)))) for i in range(SKETCH_BITS // 64))
    return sizes & (bits <= most_bits(percent))


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have the similarity."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    if not len(x):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """pairs (a, b) whose full sets reach the similarity. texts: node, text. A leader's text is cut once for each slice that names it."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_documents")
        for batch in batches:
            for part in text_slices(batch, "tb"):
                leaders, first, of = np.unique(part.column("a").to_numpy(), return_index=True, return_inverse=True)
                held = shingle_sets(part.column("ta").take(pa.array(first)), shingle)
                linked = [reaches(held[i], own, percent) for i, own in zip(of.tolist(), shingle_sets(part.column("tb"), shingle), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    own = lambda k: texts.select(F.col("node").alias(k), F.col("text").alias("t" + k))
    return pairs.join(own("b"), "b").join(own("a"), "a").select("a", "b", "ta", "tb").mapInArrow(tidy(check), "a long, b long, linked boolean").where("linked").select("a", "b")


def possible(rows: pa.Table, bucket: int, percent: int) -> np.ndarray:
    """Which members of a tile (node, part, n, sketch, bands, asks, apart) sizes and sketches allow to be linked: one that asks with one that does not, of another part.
    Two members that both ask somewhere meet where the lower one asks, and a pair that shares several buckets in that of its first shared band."""
    node, part, n, asks, apart = (rows.column(c).to_numpy() for c in ("node", "part", "n", "asks", "apart"))
    sketch, bands = (np.array(rows.column(c).to_pylist(), np.int64) for c in ("sketch", "bands"))
    out = asks[:, None] & ~asks[None, :] & (part[:, None] != part[None, :]) & ~(apart[None, :] & (node[:, None] > node[None, :]))
    out &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    bits = np.zeros(out.shape, np.int32)
    for k in range(sketch.shape[1]):
        bits += np.bitwise_count(sketch[:, None, k].view(np.uint64) ^ sketch[None, :, k].view(np.uint64))
    out &= bits <= most_bits(percent)
    for k in range(int(np.argmax(bands[0] == bucket))):
        out &= bands[:, None, k] != bands[None, :, k]
    return out


def linked_in(sets: list[np.ndarray], asked: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of `asked` whose full sets reach the similarity, by products of the matrices of what several sets hold."""
    sizes = np.array([len(x) for x in sets])
    values, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    kinds, column, held = np.unique(values, return_inverse=True, return_counts=True)
    number = np.cumsum(held > 1) - 1
    of, column = of[held[column] > 1], number[column[held[column] > 1]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    common = np.zeros((len(sets), len(sets)))
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, SHARED_COLUMNS):
        a, b = np.searchsorted(column, [k, k + SHARED_COLUMNS])
        matrix = np.zeros((len(sets), SHARED_COLUMNS), np.float32)
        matrix[of[a:b], column[a:b] - k] = 1
        common += matrix @ matrix.T
    return np.nonzero(asked & (100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)))


def dealt_tiles(labelled: DataFrame, sizes: DataFrame) -> DataFrame:
    """bucket, lo, hi, node, part, asks, apart: members outside a bucket's largest part ask, in blocks of some TILE, all members of it, in blocks of as many. A bucket with
    m members, of which s ask, gives about 2 m s / TILE rows, and m of them if s is small."""
    parts = labelled.join(sizes.select("bucket"), "bucket", "left_semi").groupBy("bucket", "part").agg(F.count("*").alias("own"))
    largest = parts.groupBy("bucket").agg(F.max(F.struct("own", "part")).alias("top"), F.sum("own").alias("held"))
    largest = largest.select("bucket", F.col("top.part").alias("top"), F.ceil((F.col("held") - F.col("top.own")) / TILE).cast("int").alias("askers"), F.ceil(F.col("held") / TILE).cast("int").alias("blocks"))
    rows = labelled.join(largest, "bucket").withColumn("apart", F.col("part") != F.col("top"))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["bucket", "lo", "hi", "node", "part", "asks", "apart"]
    ask = rows.where("apart").withColumns({"lo": block("askers"), "asks": F.lit(True)}).withColumn("hi", every("blocks"))
    told = rows.withColumns({"hi": block("blocks"), "asks": F.lit(False)}).withColumn("lo", every("askers"))
    return ask.select(*columns).unionByName(told.select(*columns))


def tile_links(labelled: DataFrame, sizes: DataFrame, info: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between parts of one bucket, for buckets too large for pairs: blocks of the members that are still apart meet blocks of all members in tiles.
    Members that no other member can be linked with leave a tile before texts are read; each text is in a tile twice at the most, whatever
    its pairs. Of what is linked in a tile, a node is given with the smallest that it hangs on."""

    def sift(key: tuple, rows: pa.Table) -> pa.Table:
        claim("near_documents")
        asked = possible(rows, key[0].as_py(), percent)
        some = np.flatnonzero(asked.any(axis=0) | asked.any(axis=1))
        left = rows.take(pa.array(some))
        partners = [np.packbits(x).tobytes() for x in asked[np.ix_(some, some)]]
        return pa.table({"bucket": left.column("bucket"), "lo": left.column("lo"), "hi": left.column("hi"), "node": left.column("node"), "place": pa.array(np.arange(len(some), dtype=np.int32)), "partners": pa.array(partners, pa.binary())})

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        claim("near_documents")
        rows = rows.sort_by("place")
        nodes, n = rows.column("node").to_numpy(), rows.num_rows
        asked = np.array([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x in rows.column("partners").to_pylist()], bool)
        i, j = linked_in(shingle_sets(rows.column("text"), shingle), asked, percent)
        low = nodes.copy()
        while len(i):
            before = low.copy()
            least = np.minimum(low[i], low[j])
            np.minimum.at(low, i, least)
            np.minimum.at(low, j, least)
            if (low == before).all():
                break
        return pa.table({"a": low[low != nodes], "b": nodes[low != nodes]})

    tile = ["bucket", "lo", "hi"]
    full = dealt_tiles(labelled, sizes).join(info.select("node", "n", "sketch", "bands"), "node")
    sifted = materialize(full.groupBy(*tile).applyInArrow(sift, "bucket long, lo int, hi int, node long, place int, partners binary"))
    return sifted.join(texts, "node").groupBy(*tile).applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("k1", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("k2", F.coalesce(F.xxhash64("text"), F.lit(0)))
    signed = materialize(signatures(rows, shingle))
    classes = signed.where("n > 0").groupBy("digest").agg(F.min(F.struct("k1", "k2")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    # a class is a node by a number of its own, as ids may be null or repeat
    classes = materialize(classes.select("digest", F.monotonically_increasing_id().alias("node"), F.col("rep.k1").alias("k1"), F.col("rep.k2").alias("k2"), "n", "bands", "sketch"))

    bands = classes.select("node", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket")
    members = materialize(bands.join(shared, "bucket").distinct())
    nodes = materialize(members.select("node").distinct())
    n_nodes = nodes.count()
    info = materialize(join_bounded(classes.select("node", "k1", "k2", "n", "sketch", "bands"), nodes, ["node"], "left_semi", n_nodes, BROADCAST_ROWS))
    keys = info.select("node", "k1", "k2")
    texts = materialize(join_bounded(rows.select("k1", "k2", "text"), keys, ["k1", "k2"], "inner", n_nodes, BROADCAST_ROWS).dropDuplicates(["node"]).select("node", "text"))
    side = lambda k: info.select(F.col("node").alias(k), F.col("n").alias("n" + k), F.col("sketch").alias("s" + k))

    def linked(pairs: DataFrame) -> DataFrame:
        new = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return materialize(confirm(new.join(side("a"), "a").join(side("b"), "b").where(likely(percent)).select("a", "b"), texts, shingle, percent))

    # every member of a bucket against its leaders, a few nodes that come first in orders of their own
    order = lambda k: F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("order"), "node"))["node"]
    heads = members.groupBy("bucket").agg(F.array_distinct(F.array(*(order(k) for k in range(LEADERS)))).alias("leaders"))
    pairs = members.join(heads, "bucket").select(F.explode("leaders").alias("a"), F.col("node").alias("b")).where("a <> b")
    parts = materialize(components(linked(pairs)))
    # what is still apart in a bucket, against all of it; links found now are between components
    labelled = members.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    split = labelled.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("held")).where("low < high").select("bucket", "held")
    split, labelled = materialize(split), materialize(labelled)
    few, many = split.where(F.col("held") <= PAIR_BUCKET), split.where(F.col("held") > PAIR_BUCKET)
    late = linked(leftover(labelled.join(few, "bucket", "left_semi"), info, percent))
    if not many.isEmpty():
        late = materialize(late.unionByName(tile_links(labelled, many, info, texts, shingle, percent)))
    if not late.isEmpty():
        known = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
        between = late.join(known("a"), "a", "left").join(known("b"), "b", "left").select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b"))
        joined = components(between).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        every = parts.unionByName(late.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(parts, "node", "left_anti").withColumn("component", F.col("node")))
        parts = materialize(every.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component")))

    # numbers back to ids: a component has the smallest id of its classes
    named = materialize(classes.select("node", "k1").join(parts, "node").groupBy("component").agg(F.min("k1").alias("low")))
    owned = join_bounded(parts, named, ["component"], "inner", named.count(), BROADCAST_ROWS).select("node", "low")
    found = classes.select("digest", "node", "k1").join(owned, "node", "left").select("digest", F.coalesce("low", "k1").alias("component"))
    out = signed.join(found, "digest", "left").select("k1", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("k1")).alias("component"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("k1").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"), (F.col("k1") == F.col("component")).alias("kept"))


def leftover(labelled: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket of PAIR_BUCKET members at most, in different parts, that their sketches allow: members outside the bucket's largest part
    against all members."""
    sizes = labelled.groupBy("bucket", "part").agg(F.count("*").alias("held"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("held", "part")).alias("top")).select("bucket", F.col("top.part").alias("top"))
    full = labelled.join(info.select("node", "n", "sketch"), "node")
    few = full.join(largest, "bucket").where("part <> top").select("bucket", F.col("node").alias("a"), F.col("part").alias("pa"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    every = full.select("bucket", F.col("node").alias("b"), F.col("part").alias("pb"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return few.join(every, "bucket").where((F.col("pa") != F.col("pb")) & likely(percent)).select("a", "b")


def op6_odd_sketch_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(c.low, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON d.doc_id = c.a
"""
