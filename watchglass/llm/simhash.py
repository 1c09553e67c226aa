"""SimHash near-duplicates: fingerprints that differ in few bits, found through a Golay code.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. Where two fingerprints differ in at most three
bits, either one segment has no wrong bit and another has one at most, or each of the three has exactly one. Words one
bit apart decode to a codeword that the other also reaches by flipping at most one bit. So each fingerprint is filed,
for each ordered pair of segments, under one's bits and the other's codeword index, and looks up what flips of a bit
in the latter lead to (at most 6); and it is filed under all three indices, and looks up what flips of a bit in each
lead to (at most 6 x 6 x 6). Keys of 33 bits and more keep strangers apart in large corpora. Candidates are verified by
their true distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchglass.llm import golay
from watchglass.llm.common import stored, table
from watchglass.operators.components import connected_components

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: First bit and number of bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
ORDERED = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """Hashes (8 bytes each) of the whole text's word shingles, repeats included; a shorter text is one shingle.

    Words are what lies between ASCII white space, with A-Z in lower case. Without words there are no shingles.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return b""
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest, ends = xxhash.xxh64_digest, ends.tolist()
    if len(words) <= shingle:
        return digest(joined, seed)
    return b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])])  # noqa: B905


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the whole text's word shingles, repeats included; zero if it has no words.

    A bit is 1 if it is in over half of the shingles' hashes.
    """
    hashes = shingle_hashes(text, shingle, seed)
    if not hashes:
        return 0
    n = len(hashes) // 8
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # memory stays bounded for texts of any length
        part = np.frombuffer(hashes, np.uint8, 8 * min(1 << 16, n - at), 8 * at).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's text, as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class _Near:
    """The different codeword indices that each row's segment leads to, one row after the other."""

    def __init__(self, words: np.ndarray, bits: int):
        found = np.sort(golay.near(words, bits), axis=1)
        fresh = np.concatenate([np.ones((len(words), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
        self.counts, self.indices = fresh.sum(1), found[fresh]
        self.starts = np.cumsum(self.counts) - self.counts

    def times(self, rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each of (row, key) with each of the row's indices put behind the key."""
        n = self.counts[rows]
        left = np.repeat(np.arange(len(rows)), n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.starts[rows[left]]
        return rows[left], (keys[left] << golay.INDEX_BITS) + self.indices[right]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, filed): where a fingerprint is filed, and where it looks."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            fp = whole.column(0).slice(at, 2048).to_numpy()
            bits, all_rows = fp.view(np.uint64), np.arange(len(fp))
            parts = [(bits >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
            near = [_Near(p, n) for p, (_, n) in zip(parts, SEGMENTS, strict=True)]
            home = [golay.decode(p) for p in parts]
            keys, rows, filed = [], [], []

            def add(kind: int, row: np.ndarray, key: np.ndarray, is_filed: bool) -> None:
                keys.append(key + (kind << 60))  # noqa: B023
                rows.append(row)  # noqa: B023
                filed.append(np.full(len(row), is_filed))  # noqa: B023

            for kind, (exact, close) in enumerate(ORDERED):
                add(kind, all_rows, (parts[exact] << golay.INDEX_BITS) + home[close], True)
                add(kind, *near[close].times(all_rows, parts[exact]), False)
            row, key = all_rows, np.zeros(len(fp), np.int64)
            for n in near:
                row, key = n.times(row, key)
            add(len(ORDERED), row, key, False)
            add(len(ORDERED), all_rows, (((home[0] << golay.INDEX_BITS) + home[1]) << golay.INDEX_BITS) + home[2], True)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(fp[np.concatenate(rows)]), pa.array(np.concatenate(filed))], ["key", "fp", "filed"])


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) of different fingerprints, a < b, that differ in at most ``distance`` (up to 3) bits, each once."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError("segments are laid out for at most three wrong bits")
    keys = distinct.select("fp").mapInArrow(_keys, "key long, fp long, filed boolean")
    filed = keys.filter("filed").select("key", F.col("fp").alias("b"))
    looked = keys.filter("not filed").select("key", F.col("fp").alias("a"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return looked.join(filed, (looked.key == filed.key) & close).select("a", "b").distinct()


def _grouped(groups: DataFrame, distance: int, more: DataFrame | None) -> DataFrame:
    """``groups`` (a row per fingerprint fp) with ``root``, one for each component."""
    near = links(groups, distance)
    if more is not None:
        near = near.unionByName(more)
    found = connected_components(near)
    return groups.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``; component_id is the smallest doc_id that links lead to.

    Equal fingerprints are linked. A null, empty or blank text has fingerprint zero and is linked like any other. A
    null doc_id never names a component, unless all of a component's ids are null (component_id null). Repeated rows
    each give a row; an empty table gives none. Texts may have any length. Other columns of ``docs`` are not read.
    """
    marked = stored(fingerprints(docs), "fingerprints")
    groups = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-groups")
    joined = _grouped(groups, distance, None)
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def first_of_groups(known: DataFrame, distance: int = DISTANCE, more: DataFrame | None = None) -> DataFrame:
    """The first of each component of ``known`` (fp, doc_id, node), by doc_id (null last) and node, as (doc_id, node).

    ``more`` has further links (a, b) between fingerprints.
    """
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")
    groups = stored(known.groupBy("fp").agg(F.min(place).alias("first")), "fingerprint-groups")
    first = _grouped(groups, distance, more).groupBy("root").agg(F.min("first").alias("first"))
    return first.select("first.doc_id", "first.node")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
