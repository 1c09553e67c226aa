"""Best-fit packing: documents are cut into token pieces and packed into as few sequences as best fit finds.

Best-fit decreasing looks only at lengths, and there are at most ``capacity`` of them. So the driver gets a
histogram (a number per length, however large the corpus), packs runs of equal pieces into runs of equal bins with
a segment tree over remaining capacities, and hands back intervals: "the pieces of length L with ranks a..b lie k to
a bin, from bin s on, at offset o". Each piece finds its place from its length and its rank among the pieces of that
length. The result is that of a global best-fit decreasing; no bin list and no document list leaves the executors.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchglass.llm.common import stored, table

CAPACITY = 2048
END_ID = 0
#: Chunks whose ids a worker remembers; the memory is cleared when it is full.
CACHED = 400_000


class ByteBpe:
    """Byte-level BPE of a ``tokenizers`` file. Ids come as little-endian unsigned 32-bit integers in bytes.

    Text is cut before single spaces, where the pre-tokenizer always ends a token, and the ids of each chunk are
    remembered. A text with a run of white space that such a cut would split goes through as a whole.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(pairs)):
            raise ValueError("ids must follow the order of merges")
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._encode = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._special = {t: array("I", [i]).tobytes() for t, i in special.items()}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._run = re.compile(r"\s (?=\s|\Z)")
        self._known: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        if self._run.search(text):
            return array("I", self._encode(text)).tobytes()
        head, *rest = text.split(" ")
        known, encode = self._known, self._encode
        out = list(map(known.get, rest))
        if None in out:
            if len(known) > CACHED:
                known.clear()
            for i, ids in enumerate(out):
                if ids is None:
                    chunk = rest[i]
                    if (ids := known.get(chunk)) is None:
                        ids = array("I", encode(" " + chunk)).tobytes()
                        if len(chunk) < 64:
                            known[chunk] = ids
                    out[i] = ids
        return array("I", encode(head)).tobytes() + b"".join(out)

    def encode(self, text: str) -> bytes:
        if not self._split or not any(t in text for t in self._special):
            return self._plain(text)
        return b"".join(self._special.get(part) or self._plain(part) for part in self._split.split(text) if part)


_loaded: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, dealt int, nth long"


def _cut(path: str, capacity: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, task = tokenizer(path).encode, TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64).tolist()
        end = array("I", [END_ID]).tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                n = len(ids) // 4
                first = n if n <= capacity else n % capacity or capacity
                start = piece = 0
                while start < n:
                    stop = first if piece == 0 else start + capacity
                    part, length = ids[4 * start : 4 * stop], stop - start
                    for column, value in zip(out, (doc_id, piece, start, length, zlib.crc32(part), task, seen[length], part), strict=True):
                        column.append(value)
                    seen[length] += 1
                    start, piece = stop, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"]
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns if with_ids else columns[:-1], names if with_ids else names[:-1])

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Token pieces of each document's whole text, ``END_ID`` at its end; null text counts as empty.

    ``dealt`` and ``nth`` say which task made a piece and how many of its length that task had made before.
    """
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(_cut(path, capacity, with_ids), PIECES + (", ids binary" if with_ids else ""))


class SegmentTree:
    """Which remaining capacities some open bin has; finds the least one of at least a given size in log time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)

    def put(self, at: int, there: bool) -> None:
        i = self.leaves + at
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = self.leaves + least
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Packs ``counts[length]`` pieces of each length. Returns intervals and the number of bins.

    An interval (length, first rank, first bin, pieces in a bin, offset) holds from its first rank on, up to the next
    one of that length. There are at most a few per length and distinct remaining capacity.
    """
    tree, open_bins, bins = SegmentTree(capacity), [deque() for _ in range(capacity + 1)], 0
    intervals: list[tuple[int, int, int, int, int]] = []

    def fill(length: int, rank: int, first: int, n: int, each: int, left: int) -> int:
        intervals.append((length, rank, first, each, capacity - left))
        after = left - each * length
        open_bins[after].append((first, n))
        tree.put(after, True)
        return rank + n * each

    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            left = tree.tightest(length)
            if left is None:
                left, first, n = capacity, bins, -(-(total - rank) // (capacity // length))
                bins += n
            else:
                first, n = open_bins[left].popleft()
                tree.put(left, bool(open_bins[left]))
            each = left // length
            full, rest = divmod(min(total - rank, n * each), each)
            if full:
                rank = fill(length, rank, first, full, each, left)
            if rest:
                rank = fill(length, rank, first + full, 1, rest, left)
            if unused := n - full - bool(rest):
                open_bins[left].appendleft((first + n - unused, unused))
                tree.put(left, True)
    return np.array(sorted(intervals), np.int64).reshape(-1, 5), bins


def _place(intervals: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    keys = (intervals[:, 0] << 48) + intervals[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            past = rank - intervals[at, 1]
            bin_id, offset = intervals[at, 2] + past // intervals[at, 3], intervals[at, 4] + past % intervals[at, 3] * length
            kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n not in ("rank", "length")]
            kept += [("length", pa.array(length)), ("sequence_id", pa.array(bin_id)), ("offset", pa.array(offset))]
            yield pa.RecordBatch.from_arrays([c for _, c in kept], [n for n, _ in kept])

    return run


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens, best fit, longest pieces first.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian unsigned
    32-bit, ``with_ids``). A null text is an empty one and gives a piece with the end id alone; a null doc_id stays
    null; repeated rows are packed each; an empty table gives no rows. Other columns of ``docs`` are not read.
    """
    made = stored(pieces(docs, path, capacity, with_ids), "pieces")
    dealt = made.groupBy("length", "dealt").agg(F.count("*").alias("n"))
    by_task = Window.partitionBy("length").orderBy("dealt")
    before = dealt.withColumn("before", F.sum("n").over(by_task) - F.col("n")).drop("n")
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    intervals, _ = best_fit_decreasing(counts, capacity)
    ranked = made.join(before, ["length", "dealt"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "nth", "dealt")
    schema = "doc_id long, piece int, start long, ids_crc32 long, " + ("ids binary, " if with_ids else "") + "length long, sequence_id long, offset long"
    order = ["doc_id", "piece", "start", "ids_crc32", *(["ids"] if with_ids else []), "length", "rank"]
    return ranked.select(*order).mapInArrow(_place(intervals), schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), default_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
