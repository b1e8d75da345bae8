"""Pieces that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return (fixed values).
SPACES = "\t\n\x0b\x0c\r"
#: Stands for a null id in keys.
NO_ID = -(2**63)

_tables: dict[str, SparkSession] = {}


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


#: Rows of an Arrow batch: texts are wide, and both sides of the exchange hold whole batches outside the heap.
BATCH_ROWS = "1024"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of one folder. Where the session has Spark's own number of rows for Arrow batches, it gets BATCH_ROWS from here on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; null and blank texts give an empty array."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(plain, " "), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one only where the setting is absent on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="heddle-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to a table of its own in the shared folder and reads it back: cuts lineage, survives lost executors, and keeps columns prunable."""
    spark = session_of(df)
    path = f"{shared_dir(spark)}/heddle-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables[path] = spark
    if owners := _owners.get():
        owners[-1].paths.add(path)
    return spark.read.schema(df.schema).parquet(path)


class Owner:
    """Within `with Owner() as own`, tables that materialize() writes in this thread belong to `own`, and its release() deletes them alone.
    What is left of an inner owner passes to the outer one; tables without an owner stay until the process ends."""

    def __init__(self):
        self.paths: set[str] = set()

    def __enter__(self) -> Owner:
        self.token = _owners.set((*_owners.get(), self))
        return self

    def __exit__(self, *_) -> None:
        _owners.reset(self.token)
        if outer := _owners.get():
            outer[-1].paths |= self.paths

    def release(self, keep: DataFrame | None = None) -> None:
        """Deletes this owner's tables, but for the one that `keep` reads."""
        read_by = {f.rsplit("/", 2)[-2] for f in keep.inputFiles()} if keep is not None else set()
        gone = {path for path in self.paths if path.rsplit("/", 1)[1] not in read_by}
        self.paths -= gone
        release(gone)


_owners: ContextVar[tuple[Owner, ...]] = ContextVar("owners", default=())


def release(paths: set[str] | None = None) -> None:
    """Deletes tables that materialize() has written: those named, or, as the process ends, all that are left."""
    for path, spark in list(_tables.items()):
        if paths is not None and path not in paths:
            continue
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; its folder goes with the cluster's own clean-up
            pass
        _tables.pop(path, None)


atexit.register(release)


def join_bounded(large: DataFrame, small: DataFrame, on: list[str], how: str, rows: int, most: int) -> DataFrame:
    """large join small. small (already materialized, `rows` rows of some dozens of bytes) is broadcast only if it has at most `most` rows; else both sides are shuffled."""
    return large.join(F.broadcast(small) if rows <= most else small, on, how)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text leaves the remainder; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == remainder


_caches: dict[str, Callable[[], None]] = {}
_owner = ""


def claim(owner: str, clear: Callable[[], None] | None = None) -> None:
    """Says that `owner` now runs in this worker process; what other operators keep there for later tasks is given back.
    clear: empties the owner's own caches, once another operator begins."""
    global _owner
    if owner != _owner:
        for name, empty in _caches.items():
            if name != owner:
                empty()
        _owner = owner
    if clear:
        _caches[owner] = clear


def give_back() -> None:
    """Returns freed memory to the system: a worker process is used again, or waits beside others, with all that its allocators hold."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, a function for mapInArrow, that gives freed memory back after each batch and at its end."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(each(batches))
        gc.collect()
        give_back()

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit number over all its bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Powers kept for later, in all 32 MB for a base.
KEPT_POWERS = 1 << 21


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse: n and n + 1 of them."""

    def __init__(self, base: int):
        self.bases = np.uint64(base), np.uint64(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = self.up, self.down
        if n >= len(up):
            up, down = (np.multiply.accumulate(np.append(np.uint64(1), np.full(1 << n.bit_length(), x, np.uint64))) for x in self.bases)
            if n < KEPT_POWERS:
                self.up, self.down = up, down
        return up[:n], down[: n + 1]


class Rolling:
    """Hashes of any range of an array of numbers, from prefix sums modulo 2**64."""

    def __init__(self, h: np.ndarray, powers: Powers):
        up, self.down = powers(len(h))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))


#: Bytes hashed at once. Powers are kept for some more, however long a text is.
RANGE_BYTES = 1 << 19
_SPACE = np.isin(np.arange(256), list(b" " + SPACES.encode()))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOLDED = _BYTE[np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])]
_powers = Powers(0xD6E8FEB86659FD93)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column laid end to end, and the place where each text begins (and the last one ends). A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data and at[-1] > at[0] else np.zeros(0, np.uint8)), at - at[0]


#: For cuts at all ASCII characters but letters, digits and the underscore.
NO_LETTER = np.array([b < 128 and not (chr(b).isalnum() or b == 95) for b in range(256)])


def hash_words(column: pa.Array, lower: bool = False, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of each text, end to end, and the number of words of each text. lower: A-Z count as a-z; gaps: bytes between words.
    Bytes are looked at all together, so nothing is kept for later and no word is looked up."""
    data, at = utf8(column)
    values, n = (_FOLDED if lower else _BYTE), len(data)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    gap = np.ones(n + 1, bool)
    gap[:n] = gaps[data]
    out, begun, a = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while a < n:
        b = min(a + RANGE_BYTES, n)
        while b < n and not (gap[b] or edge[b]):  # a word lies in one range
            more = np.flatnonzero(gap[b : b + 65536] | edge[b : b + 65536])
            b += int(more[0]) if len(more) else 65536
        b = min(b, n)
        word = ~gap[a:b]
        first, last = word.copy(), word.copy()
        first[1:] &= gap[a : b - 1] | edge[a + 1 : b]
        last[:-1] &= gap[a + 1 : b] | edge[a + 1 : b]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _powers(b - a)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data[a:b]] * up, dtype=np.uint64)])
        out.append(mix64((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64)))
        begun.append(starts + a)
        a = b
    begun = np.concatenate(begun)
    return np.concatenate(out), np.diff(np.searchsorted(begun, at))


def text_slices(batch: pa.RecordBatch, text: str | pa.Array, most_bytes: int = 1 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about most_bytes of text (a column's name, or the column), so that a worker holds one part's arrays at a time."""
    at = utf8(batch.column(text) if isinstance(text, str) else text)[1]
    k = 0
    while k < batch.num_rows:
        stop = max(k + 1, min(k + most_rows, int(np.searchsorted(at, at[k] + most_bytes))))
        yield batch.slice(k, stop - k)
        k = stop


def group_offsets(counts: DataFrame, group: str = "group") -> DataFrame:
    """Of counts (pid, group, n), the rows of each group in each range-sorted partition: pid, group and offset, the group's rows in
    earlier partitions, where there are any. A partition can only continue the group that it begins with, so there is at most
    one row for each partition: that bounds a broadcast of the result."""
    before = F.sum("n").over(Window.partitionBy(group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    return counts.groupBy("pid", group).agg(F.sum("n").alias("n")).select("pid", group, before.alias("offset")).where("offset IS NOT NULL")
