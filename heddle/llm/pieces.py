"""SentencePiece encoding with sampled segmentations, and lossless decoding (operator 2).

A text, with one space put before it, is cut into units: spaces and the characters that follow them, which no piece of the
vocabulary crosses. A unit's lattice has an arc for every piece that fits; a character without a piece becomes the pieces
of its bytes. The weight of a piece is Zipf's law of its rank in the vocabulary, to the power `alpha`: a large alpha
prefers frequent, long pieces, 0 makes all segmentations with as many pieces equally likely.

Forward filtering sums the weight of all ways to each place of a unit once for each distinct unit; backward sampling then
draws from the end of each unit which arc led there, with numbers that are a hash of the seed, the row key, the unit's
number and the step. The same key and text give the same pieces anywhere. sample=False takes the likeliest way.

Decoding joins the pieces' bytes and drops the space in front. Every text comes back as it was, white space, unknown
characters and the vocabulary's own space mark included.

Scale. Rows are encoded where they are read; nothing is shuffled. The vocabulary file is read by its path in each worker
process. Units are kept in a table that is cleared at MOST_ARCS arcs.

Defined cases: a null text encodes to null, an empty one to no pieces. A null key counts as the text ''. Repeated rows get
equal pieces. An empty table gives no rows.
Further columns pass through encode_pieces(), whatever their names, and are ignored by the query.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.common import claim, read, text_slices, tidy

MOST_ARCS, PIECE_UNITS, SHORT_UNIT = 2_000_000, 25_000, 48
#: Text encoded at once.
SLICE_BYTES = 1 << 18
ZIPF_SHIFT, ALPHA, SEED = 10.0, 1.0, 0
#: Units: spaces with the letters or the other characters that follow, or a line feed. A piece that would cross their edges
#: is left out when the vocabulary is read; vocabularies split by script and white space, as is usual, have none.
_units = re.compile(r" *[^\W\d_]+| *(?:[\d_]|[^\w \n])+| +|\n").findall


class Vocabulary:
    """Surfaces (with plain spaces) and bytes of the pieces of a SentencePiece file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.surface: dict[str, int] = {}
        self.byte_piece: dict[int, int] = {}
        self.bytes: list[bytes] = []
        ranks = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_piece[int(piece[3:-1], 16)] = i
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                text = piece.replace("▁", " ")
                if _units(text) == [text]:
                    self.surface[text] = i
                self.bytes.append(text.encode())
            ranks.append(i)
        usual = sorted(self.surface.values(), key=lambda i: (-model.get_score(i), i))
        place = {p: k for k, p in enumerate(usual)}
        self.log_weight = [-math.log(ZIPF_SHIFT + place.get(i, len(usual))) - math.log(math.log(len(usual) + ZIPF_SHIFT)) for i in ranks]
        self.singles = {s for s in self.surface if len(s) == 1}
        self.width = np.array([len(x) for x in self.bytes])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lattices:
    """Flat lattices of the units met so far. A node's arcs are neighbours; arc_end is its node's number plus the cumulated probability."""

    def __init__(self, vocabulary: Vocabulary, alpha: float):
        self.v, self.alpha = vocabulary, alpha
        self.weight = np.exp(alpha * np.array(vocabulary.log_weight))
        longest = max(map(len, vocabulary.surface), default=1)
        size = 1 << max(4, (4 * len(vocabulary.surface)).bit_length())
        self.keys, self.values, self.longest = np.zeros(size, np.uint64), np.full(size, -1, np.int32), longest
        by_length: dict[int, list[str]] = {}
        for x in vocabulary.surface:
            by_length.setdefault(len(x), []).append(x)
        for n, group in by_length.items():
            hashes = self.hashes("".join(group))
            for x, h in zip(group, hashes(np.arange(0, n * len(group), n), n), strict=True):
                k = int(h) & (size - 1)
                while self.values[k] >= 0:
                    k = (k + 1) & (size - 1)
                self.keys[k], self.values[k] = h, vocabulary.surface[x]
        self.clear()

    def clear(self) -> None:
        self.of: dict[str, int] = {}
        self.n_nodes, self.n_arcs = 0, 0
        self.arc_end, self.arc_from, self.arc_piece = np.zeros(1 << 16), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.head = np.zeros(1 << 16, np.int64)

    @staticmethod
    def hashes(text: str):
        """Hashes of any runs of characters of text: (starts, length) -> array."""
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
        with np.errstate(over="ignore"):
            power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(chars), base, np.uint64)]))
            back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(chars), inverse, np.uint64)]))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(chars + np.uint64(1)) * power[:-1], dtype=np.uint64)])
            return lambda at, n: _mix((sums[at + n] - sums[at]) * back[at] + np.uint64(n))

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Pieces of these hashes, or -1."""
        mask = np.uint64(len(self.keys) - 1)
        k = (h & mask).astype(np.int64)
        out = np.where(self.keys[k] == h, self.values[k], -1)
        open_ = np.flatnonzero((out < 0) & (self.values[k] >= 0))
        while len(open_):
            k[open_] = (k[open_] + 1) & int(mask)
            hit = self.keys[k[open_]] == h[open_]
            out[open_[hit]] = self.values[k[open_[hit]]]
            open_ = open_[~hit & (self.values[k[open_]] >= 0)]
        return out

    def build(self, new: list[str]) -> None:
        """Filters all new units forward: short ones of known characters together, the others one by one."""
        single = self.v.singles
        plain = [u for u in new if len(u) <= SHORT_UNIT and single.issuperset(u)]
        if plain:
            self.build_plain(plain)
        for u in new:
            if u not in self.of:
                self.build_one(u)

    def build_plain(self, units: list[str]) -> None:
        text = "".join(units)
        sizes = np.array([len(u) for u in units])
        stops = np.cumsum(sizes)
        stop = np.repeat(stops, sizes)
        place = np.arange(len(text)) - np.repeat(stops - sizes, sizes)
        runs, first, last, piece = self.hashes(text), [], [], []
        at = np.arange(len(text))
        for n in range(1, self.longest + 1):
            at = at[at + n <= stop[at]]
            if not len(at):
                break
            found = self.look_up(runs(at, n))
            hit = found >= 0
            first.append(at[hit])
            last.append(at[hit] + n - 1)
            piece.append(found[hit])
        first, last, piece = (np.concatenate(x) for x in (first, last, piece))
        order = np.argsort(last * np.int64(len(self.weight)) + piece)  # arcs of a node side by side
        first, last, piece = first[order], last[order], piece[order]
        # a factor for each character changes no unit's distribution and keeps the sums near 1
        weight = self.weight[piece] * 32.0 ** (last - first + 1)
        alpha, flow = np.zeros(len(text)), np.empty(len(first))
        by_place = np.argsort(place[last].astype(np.int16), kind="stable")  # a place's arcs side by side, still in the order of their nodes
        end, start, gain = last[by_place], first[by_place], weight[by_place]
        new = np.flatnonzero(np.diff(end, prepend=-1))
        cuts = np.searchsorted(place[end], np.arange(int(sizes.max()) + 1))
        nodes = np.searchsorted(new, cuts)
        opens = place[start] == 0
        for a, b, i, j in zip(cuts[:-1], cuts[1:], nodes[:-1], nodes[1:], strict=True):
            gain[a:b] *= np.where(opens[a:b], 1.0, alpha[start[a:b] - 1])
            alpha[end[new[i:j]]] = np.add.reduceat(gain[a:b], new[i:j] - a)
        flow[by_place] = gain
        heads = np.flatnonzero(np.diff(last, prepend=-1))
        share = flow / alpha[last]
        order = np.lexsort((-share, last))  # the likeliest first, so that most draws end there
        first, piece, share = first[order], piece[order], share[order]
        run = np.cumsum(share)
        run -= np.repeat(np.concatenate([[0.0], run[heads[1:] - 1]]), np.diff(np.append(heads, len(last))))
        ends = self.n_nodes + last + np.minimum(run, 1.0)
        tails = np.append(heads[1:], len(last)) - 1
        ends[tails] = self.n_nodes + last[tails] + 1.0
        self.append(ends, np.where(place[first] == 0, -1, self.n_nodes + first - 1), piece, heads)
        self.of.update(zip(units, (self.n_nodes + stops - 1).tolist(), strict=True))
        self.n_nodes += len(text)

    def build_one(self, unit: str) -> None:
        """As build_plain, for one unit of any length and characters, in logarithms."""
        v, alpha = self.v, self.alpha
        # a node is a place in the unit, or (place, byte) inside a character that has no piece; None is the start
        at: dict[tuple, list] = {}
        for i, char in enumerate(unit):
            here = (i, 0) if i else None
            if char in v.surface:
                for j in range(i + 1, min(i + self.longest, len(unit)) + 1):
                    p = v.surface.get(unit[i:j])
                    if p is not None:
                        at.setdefault((j, 0), []).append((here, p))
            else:
                raw = char.encode()
                for k, b in enumerate(raw):
                    there = (i, k + 1) if k + 1 < len(raw) else (i + 1, 0)
                    at.setdefault(there, []).append((here, v.byte_piece[b]))
                    here = there
        base, number, log_sum = self.n_nodes, {None: -1}, {None: 0.0}
        ends, froms, chosen, heads = [], [], [], []
        for k, (node, arcs) in enumerate(sorted(at.items())):
            ways = [log_sum[a] + alpha * v.log_weight[p] for a, p in arcs]
            top = max(ways)
            log_sum[node] = whole = top + math.log(sum([math.exp(w - top) for w in ways]))
            number[node], run = base + k, 0.0
            heads.append(len(ends))
            for w, (a, p) in sorted(zip(ways, arcs, strict=True), key=lambda x: -x[0]):
                run += math.exp(w - whole)
                ends.append(base + k + min(run, 1.0))
                froms.append(number[a])
                chosen.append(p)
            ends[-1] = base + k + 1.0
        self.append(np.array(ends), np.array(froms, np.int64), np.array(chosen, np.int32), np.array(heads))
        self.n_nodes += len(at)
        self.of[unit] = self.n_nodes - 1

    def append(self, ends: np.ndarray, froms: np.ndarray, chosen: np.ndarray, heads: np.ndarray) -> None:
        """Arcs of the nodes from n_nodes on, and the first arc of each node."""
        grow = lambda x, n: np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)]) if n > len(x) else x
        n, m = self.n_arcs + len(ends), self.n_nodes + len(heads)
        self.arc_end, self.arc_from, self.arc_piece, self.head = grow(self.arc_end, n), grow(self.arc_from, n), grow(self.arc_piece, n), grow(self.head, m)
        self.arc_end[self.n_arcs : n], self.arc_from[self.n_arcs : n], self.arc_piece[self.n_arcs : n] = ends, froms, chosen
        self.head[self.n_nodes : m] = self.n_arcs + heads
        self.n_arcs = n


class Encoder:
    def __init__(self, path: str, alpha: float = ALPHA):
        self.v = _vocabulary(path)
        self.lattices = Lattices(self.v, alpha)

    def __call__(self, texts: list[str | None], keys: list[int], seed: int = SEED, sample: bool = True) -> list[np.ndarray | None]:
        """Piece ids of each text. keys: 64-bit row keys."""
        out: list[np.ndarray | None] = []
        k = 0
        while k < len(texts):
            if self.lattices.n_arcs > MOST_ARCS:
                self.lattices.clear()
            cut: list[list[str]] = []
            held = 0
            while k + len(cut) < len(texts) and held < PIECE_UNITS:
                text = texts[k + len(cut)]
                cut.append(_units(" " + text) if text else [])
                held += len(cut[-1])
            known = self.lattices.of
            self.lattices.build(list({u for us in cut for u in us if u not in known}))
            nodes = [known[u] for us in cut for u in us]
            counts = [len(us) for us in cut]
            ids, lengths = self.walk(np.array(nodes, np.int64), np.array(counts), np.array(keys[k : k + len(counts)], np.int64), seed, sample)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            unit_ends = np.concatenate([[0], np.cumsum(counts)])
            for i in range(len(counts)):
                out.append(None if texts[k + i] is None else ids[ends[unit_ends[i]] : ends[unit_ends[i + 1]]])
            k += len(counts)
        return out

    def walk(self, node: np.ndarray, counts: np.ndarray, keys: np.ndarray, seed: int, sample: bool) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling of all units at once: the ids of all units in order, and each unit's number of pieces."""
        t = self.lattices
        number = np.arange(len(node)) - np.repeat(np.cumsum(counts) - counts, counts)
        with np.errstate(over="ignore"):
            own = _mix(np.repeat(keys.view(np.uint64), counts) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) + number.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        lengths, steps, open_ = np.zeros(len(node), np.int64), [], np.arange(len(node))
        at = node.copy()
        while len(open_):
            arc = t.head[at]
            if sample:
                with np.errstate(over="ignore"):
                    u = (_mix(own[open_] + np.uint64(len(steps) + 1) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(12)).astype(float) / 2.0**52
                goal = at + u
                on = np.flatnonzero(t.arc_end[arc] <= goal)
                while len(on):
                    arc[on] += 1
                    on = on[t.arc_end[arc[on]] <= goal[on]]
            steps.append((open_, t.arc_piece[arc]))
            lengths[open_] += 1
            at = t.arc_from[arc]
            stay = at >= 0
            open_, at = open_[stay], at[stay]
        last = np.cumsum(lengths) - 1
        ids = np.zeros(int(lengths.sum()), np.int32)
        for k, (units, piece) in enumerate(steps):
            ids[last[units] - k] = piece
        return ids, lengths


@cache
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@cache
def encoder(path: str, alpha: float = ALPHA) -> Encoder:
    """One for each process."""
    return Encoder(path, alpha)


def forget() -> None:
    encoder.cache_clear()
    _vocabulary.cache_clear()


def decode(ids: np.ndarray | list[int], path: str) -> str:
    held = _vocabulary(path).bytes
    out = b"".join([held[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])
    return out[1:].decode("utf-8", "replace")


def encode_pieces(docs: DataFrame, path: str, alpha: float = ALPHA, seed: int = SEED, sample: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with piece_ids (array of int) and lossless (whether decoding gives the text back) appended; columns of these names are replaced."""
    docs = docs.drop("piece_ids", "lossless")
    place = docs.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pieces", forget)
        encode = encoder(path, alpha)
        for batch in batches:
            for part in text_slices(batch, batch.column("row").field(place), SLICE_BYTES, 512):
                texts = part.column("row").field(place).to_pylist()
                ids = encode(texts, part.column("key").to_pylist(), seed, sample)
                same = [None if t is None else decode(x, path) == t for t, x in zip(texts, ids, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], ["row", "piece_ids", "lossless"])

    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"))
    schema = T.StructType([keyed.schema["row"]]).add("piece_ids", T.ArrayType(T.IntegerType())).add("lossless", "boolean")
    return keyed.mapInArrow(tidy(apply), schema).select("row.*", "piece_ids", "lossless")


def decode_pieces(encoded: DataFrame, path: str, ids_col: str = "piece_ids") -> DataFrame:
    """encoded with decoded (the text of piece_ids) appended."""
    names = encoded.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode(x, path) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(tidy(apply), f"{fields}, decoded string")


def digests(docs: DataFrame, path: str, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian 32-bit ids) and lossless: the encoding without its bulk."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("piece_ids")
            flat, ends = column.values.to_numpy().astype("<u4"), column.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64()), batch.column("lossless")], ["doc_id", "n_pieces", "ids_crc32", "lossless"])

    coded = encode_pieces(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path, alpha, seed)
    return coded.select("doc_id", "piece_ids", "lossless").mapInArrow(tidy(apply), "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")


def op2_sampled_pieces(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("piece_bpe_32k.model"))
