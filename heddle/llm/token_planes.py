"""Token-id output in byte or bit planes (operator 9).

Documents are range-partitioned and sorted by id, encoded, and packed: ids are cut into blocks of a fixed number
of ids, each block is transposed into byte planes (or bit planes), each plane is compressed with zstandard, and
the ends of all planes are kept as the chunk index of their segment. A segment is one row of the written table and
holds whole documents, so any segment can be read alone: (pid, seg) order it, local_start is its first id counted
from the start of its partition, doc_ids and doc_lens are its documents, payload its planes, ends their index.

Scale. The text is shuffled once; ids never are. Global starts need one number for each written partition, which is
all that is broadcast. Segments are flushed at SEGMENT_IDS ids, so memory holds one segment or one document.
The tokenizer is called once for each distinct word that a worker process meets (words are cut at ASCII white space,
which this kind of tokenizer drops and never joins across); the caches are cleared at CACHE_WORDS and CACHE_PIECES.

Defined cases: a null or blank text gives the end id alone. Null ids come first. Rows that repeat are all kept.
An empty table gives an empty file set and no rows. Further columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.llm.common import claim, materialize, read

BLOCK_IDS, SEGMENT_IDS, SEGMENT_DOCS, CACHE_WORDS, CACHE_PIECES = 16384, 1 << 18, 4096, 1_000_000, 500_000
SEGMENT_SCHEMA = "pid int, seg int, local_start long, n_ids long, kind string, doc_ids array<long>, doc_lens binary, payload binary, ends array<int>, widths binary"
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of one block, lowest first; as many as its largest id needs."""
    width = max(1, (int(ids.max()).bit_length() + 7) // 8) if len(ids) else 1
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range(width)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(8 * width)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    raw = np.zeros((n, 4), dtype=np.uint8)
    if kind == "byte":
        for k, plane in enumerate(planes):
            raw[:, k] = np.frombuffer(plane, np.uint8)
    else:
        bits = np.zeros((n, 32), dtype=np.uint8)
        for k, plane in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


def pack(ids: np.ndarray, kind: str = "byte", level: int = 1) -> tuple[bytes, list[int], bytes]:
    """Compressed planes of all blocks, the end of each plane, and the number of planes of each block."""
    press, out, ends, widths, at = zstandard.ZstdCompressor(level=level), [], [], [], 0
    for i in range(0, len(ids), BLOCK_IDS):
        planes = to_planes(ids[i : i + BLOCK_IDS], kind)
        widths.append(len(planes))
        for plane in planes:
            out.append(press.compress(plane))
            at += len(out[-1])
            ends.append(at)
    return b"".join(out), ends, bytes(widths)


def unpack(payload: bytes, ends: list[int], widths: bytes, n: int, kind: str) -> np.ndarray:
    press, out, k, at = zstandard.ZstdDecompressor(), [np.zeros(0, "<u4")], 0, 0
    for block, width in enumerate(widths):
        planes = []
        for _ in range(width):
            planes.append(press.decompress(payload[at : ends[k]]))
            at, k = ends[k], k + 1
        out.append(from_planes(planes, min(BLOCK_IDS, n - block * BLOCK_IDS), kind))
    return np.concatenate(out)


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Words of these characters alone are cut here as the tokenizer's own rules cut them: no control characters,
#: combining marks, white space or letters whose lower case has another length.
PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u017f]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(own))}


class WordEncoder:
    """Ids of a text as little-endian 32-bit bytes, for tokenizers that drop white space and never join across it.

    The first use looks into the tokenizer's settings. If they are lower case, NFC and a regular-expression split before
    a byte-level alphabet, plain words are cut by that expression here and each distinct piece goes to the tokenizer's
    model once; all other words go to the tokenizer whole. Either way a word's ids are those of the library."""

    def __init__(self, path: str):
        import regex

        self.tokenizer = _tokenizer(path)
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.letters, self.cut = _byte_letters(), None
        rules = json.loads(self.tokenizer.to_str())
        steps, cuts = (rules["normalizer"] or {}).get("normalizers", []), (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        if [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["invert"] and not cuts[1]["add_prefix_space"]:
            self.cut = regex.compile(cuts[0]["pattern"]["Regex"]).findall
            self.special = [x["content"] for x in rules["added_tokens"]]

    def piece(self, x: str) -> bytes:
        found = self.pieces.get(x)
        if found is None:
            plain = "".join([self.letters[b] for b in x.encode()])
            found = self.pieces[x] = np.array([t.id for t in self.tokenizer.model.tokenize(plain)], "<u4").tobytes()
        return found

    def learn(self, new: list[bytes]) -> None:
        odd = []
        for w in new:
            text = w.decode()
            if self.cut and PLAIN.fullmatch(text) and not any(x in text for x in self.special):
                self.words[w] = b"".join([self.piece(x) for x in self.cut(text.lower())])
            else:
                odd.append(w)
        for k in range(0, len(odd), 10_000):
            part = odd[k : k + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False), strict=True):
                self.words[w] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        look, out = self.words.get, []
        for x in texts:
            ws = (x or "").encode().split()
            ids = list(map(look, ws))
            if None in ids:
                self.learn(list({w for w, i in zip(ws, ids, strict=True) if i is None}))
                ids = list(map(look, ws))
            out.append(b"".join(ids))
        return out


@cache
def word_encoder(path: str) -> WordEncoder:
    """One for each process, so that tasks share what is known."""
    claim("token_planes", forget)
    return WordEncoder(path)


def forget() -> None:
    word_encoder.cache_clear()
    _tokenizer.cache_clear()


def write_ids(docs: DataFrame, encoder: Callable[[], Callable[[list], list[bytes]]], end_id: int | None = None, kind: str = "byte", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes docs in ascending id order and writes the segment table; returns the table as read back.
    encoder() is called once in each task and gives a function from texts to little-endian 32-bit id bytes."""
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pid, seg, start = encoder(), TaskContext.get().partitionId(), 0, 0
        held_ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seg, start, size
            ids = np.frombuffer(b"".join(held), "<u4")
            payload, ends, widths = pack(ids, kind)
            lens = zstandard.compress(np.array([len(x) // 4 for x in held], "<u8").tobytes())
            row = [pid, seg, start, len(ids), kind, list(held_ids), lens, payload, ends, widths]
            seg, start, size = seg + 1, start + len(ids), 0
            held_ids.clear()
            held.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[f.split()[0] for f in SEGMENT_SCHEMA.split(", ")])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    held_ids.append(doc)
                    held.append(ids + tail)
                    size += len(held[-1]) // 4
                    if size >= SEGMENT_IDS or len(held) >= SEGMENT_DOCS:
                        yield flush()
        if held:
            yield flush()

    # text breaks ties between rows of one id, so that reruns agree
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(segments, SEGMENT_SCHEMA))


def read_ids(segments: DataFrame, rows: Callable[[list, np.ndarray, np.ndarray, int], dict], schema: str) -> DataFrame:
    """Decodes every segment and turns it into rows: rows(doc_ids, ends, ids, start) gives columns; ends are the documents' ends in ids."""
    sums = segments.groupBy("pid").agg(F.sum("n_ids").alias("held"))
    starts = sums.select("pid", F.coalesce(F.sum("held").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("pid_start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                ids = unpack(r["payload"], r["ends"], r["widths"], r["n_ids"], r["kind"])
                ends = np.cumsum(np.frombuffer(zstandard.decompress(r["doc_lens"]), "<u8").astype(np.int64))
                yield pa.RecordBatch.from_pydict(rows(r["doc_ids"], ends, ids, r["pid_start"] + r["local_start"]))

    # one row for each written partition: the bound of this broadcast is their number
    return segments.join(F.broadcast(starts), "pid").mapInArrow(decode, schema)


def digest(doc_ids: list, ends: np.ndarray, ids: np.ndarray, start: int) -> dict:
    first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return {
        "doc_id": pa.array(doc_ids, pa.int64()),
        "start": pa.array(start + first, pa.int64()),
        "n_tokens": pa.array(ends - first, pa.int64()),
        "ids_crc32": pa.array([zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(first, ends, strict=True)], pa.int64()),
    }


def op9_token_planes(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    written = write_ids(read(spark, sf_dir, "documents"), lambda: word_encoder(path), end_id=1)
    return read_ids(written, digest, DOC_SCHEMA)
