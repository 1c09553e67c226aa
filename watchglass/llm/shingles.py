"""Near copies by their shingles: all pairs of texts that a Jaccard similarity of five-word shingles leads to.

Two sets of similarity t or more share at least a share t of the larger one, so of each set the first
n - ceil(t n) + 1 shingles, in one order for all texts, hold one that the other's first ones hold too (the prefix
filter of Chaudhuri et al., ICDE 2006). Each text is filed under these; rarer shingles come first, so that common
passages seldom bring texts together. How common they are is counted in a sample: any order finds every pair, the
sample only changes how many candidates there are. Candidates are verified by their whole sets.

Each set also has a sketch: the parities of its shingles' numbers in BITS classes by their hashes. Parities that differ
stand for a shingle that is in one set only, so two sketches tell at once of most pairs that they differ too much. A
wide sketch, of four classes for each shingle, does the same for long texts before these are fetched.

Texts under one shingle first meet one of them only, another for each shingle. Texts that this leaves in different
components then meet each other, so a group of near copies never forms all of its pairs, while no component is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchglass.llm.common import small, stored
from watchglass.llm.simhash import fingerprint, shingle_hashes
from watchglass.operators.components import connected_components

WORDS = 5
#: Similarity as a fraction, so that a set's least overlap is exact.
SIMILAR = (4, 5)
#: About so many texts are looked at for the order; of their shingles, so many of those seen in as many texts come last.
SAMPLE, COMMON, SEEN = 5000, 200_000, 3
#: Classes whose parities make a sketch, 64 in a word.
BITS = 512
SKETCH = [f"s{i}" for i in range(BITS // 64)]


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(np.frombuffer(shingle_hashes(text, WORDS), np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the number of shingles in each class, as BITS / 64 integers."""
    odd = np.bincount((shingles & (BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def wide(shingles: np.ndarray) -> bytes:
    """As ``sketch``, in a power of two of classes that is four times the number of shingles or more."""
    bits = max(BITS, 1 << (4 * len(shingles)).bit_length())
    odd = np.bincount((shingles & (bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """In how many classes wide sketches differ, in as many classes as the narrower one has: halves add up to parities."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _first(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest n - ceil(t n) + 1 shingles; ``common`` is sorted."""
    n = len(shingles)
    level = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        level = np.where(common[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, level))[: n - -(-SIMILAR[0] * n // SIMILAR[1]) + 1]]


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that a sample of the texts has often, and in how many of them."""
    each = max(1, texts.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node not in seen:  # copies count once in a task: a shingle is not common for being copied
                    seen.add(node)
                    yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text))], ["h"])

    seen = texts.filter(F.pmod(F.col("node"), F.lit(each)) == 0).select("node", "text").mapInArrow(run, "h long")
    often = seen.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= SEEN).orderBy(F.desc("n"), "h").limit(COMMON)
    rows = sorted((r["h"], r["n"]) for r in often.collect())  # at most COMMON rows
    return np.array([h for h, _ in rows], np.int64), np.array([n for _, n in rows], np.int64)


def _may_be(a: Column, b: Column, a_rest: Column, b_rest: Column) -> Column:
    """Whether sets of a and b shingles can be similar if the first they share has so many of each from it on, itself included."""
    t, u = SIMILAR
    return (u * F.least(a, b) >= t * F.greatest(a, b)) & ((t + u) * F.least(a_rest, b_rest) >= t * (a + b))


def _sketches_near(a: str, b: str) -> Column:
    """Whether sketches of sets (columns a_s0, ..., with a_n shingles) differ in no more classes than similar sets can.

    Similar sets share t (a + b) / (1 + t) shingles or more, so no more than (1 - t) (a + b) / (1 + t) are in one only.
    """
    t, u = SIMILAR
    differ = sum((F.bit_count(F.col(f"{a}_{s}").bitwiseXOR(F.col(f"{b}_{s}"))) for s in SKETCH[1:]), F.bit_count(F.col(f"{a}_{SKETCH[0]}").bitwiseXOR(F.col(f"{b}_{SKETCH[0]}"))))
    return (t + u) * differ <= (u - t) * (F.col(f"{a}_n") + F.col(f"{b}_n"))


def _side(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{name}_{c}") for c in columns])


def _verified(pairs: DataFrame, prints: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, a_fp, b_fp): the similar ones of pairs (a, b) of nodes, with their texts' fingerprints."""
    slim = ["node", "n", "fp", *SKETCH]
    t, u = SIMILAR
    sizes = u * F.least("a_n", "b_n") >= t * F.greatest("a_n", "b_n")
    near = pairs.join(_side(prints, "a", slim), F.col("a") == F.col("a_node")).join(_side(prints, "b", slim), F.col("b") == F.col("b_node")).filter(sizes & _sketches_near("a", "b"))
    near = stored(near.select("a", "b", "a_fp", "b_fp", (F.col("a_n") + F.col("b_n")).alias("both_n")), "copy-candidates")
    nodes = lambda found: small(found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct())
    wides = stored(prints.select("node", "wide").join(nodes(near), "node", "left_semi"), "copy-sketches")
    near = near.join(wides.select(F.col("node").alias("a"), F.col("wide").alias("a_wide")), "a").join(wides.select(F.col("node").alias("b"), F.col("wide").alias("b_wide")), "b")

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *_, n, x, y = (c.to_pylist() for c in batch.columns)
            kept = pa.array([(t + u) * differing(v, w) <= (u - t) * m for v, w, m in zip(x, y, n, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[:4], ["a", "b", "a_fp", "b_fp"]).filter(kept)

    near = near.select("a", "b", "a_fp", "b_fp", "both_n", "a_wide", "b_wide").mapInArrow(narrow, "a long, b long, a_fp long, b_fp long")
    near = stored(near, "copy-pairs")
    ids = nodes(near)
    known = stored(texts.join(ids, "node", "left_semi").dropDuplicates(["node"]), "copy-texts")
    side = lambda name: known.select(F.col("node").alias(name), F.col("text").alias(f"{name}_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = lru_cache(64)(shingle_set)
        for batch in batches:
            a, b, *_, x, y = (c.to_pylist() for c in batch.columns)
            kept = pa.array([similar(sets(t), sets(u)) for t, u in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[:4], ["a", "b", "a_fp", "b_fp"]).filter(kept)

    both = near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_fp", "b_fp", "a_text", "b_text")
    return stored(both.mapInArrow(run, "a long, b long, a_fp long, b_fp long"), "copy-links")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.xxhash64(text).alias("node"), text.alias("text"))


def prints(docs: DataFrame) -> DataFrame:
    """(node, fp, n, keys, wide, s0, ...) of each different text: hash, fingerprint, number of shingles, keys and sketches."""
    texts = _texts(docs)
    common = docs.sparkSession.sparkContext.broadcast(_common(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
                found = [fingerprint(t) for t in batch.column(1).to_pylist()]
                words = np.array([sketch(s) for s in sets], np.int64).reshape(-1, len(SKETCH))
                keys = pa.array([_first(s, *common.value) for s in sets], pa.list_(pa.int64()))
                columns = [batch.column(0), pa.array(found, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), keys, pa.array([wide(s) for s in sets], pa.binary()), *[pa.array(words[:, i]) for i in range(len(SKETCH))]]
                yield pa.RecordBatch.from_arrays(columns, ["node", "fp", "n", "keys", "wide", *SKETCH])

    # Equal texts are one from here on. What leaves Python is much smaller than the texts, so that is what meets.
    schema = "node long, fp long, n int, keys array<long>, wide binary, " + ", ".join(f"{s} long" for s in SKETCH)
    return stored(texts.filter(F.col("text").isNotNull()).mapInArrow(run, schema).dropDuplicates(["node"]), "copy-prints")


def links(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of the fingerprints of similar texts, such that they lead from each text to all that similar ones lead to.

    ``prints`` are those of ``docs``. Texts without words have no shingles and no links here.
    """
    texts = _texts(docs)
    filed = prints.select("node", "n", F.posexplode("keys").alias("at", "key")).select("key", "node", "n", (F.col("n") - F.col("at")).alias("rest"))
    # The hub is the text whose hash is least after a mask that each key has of its own, so plain numbers are compared.
    mask = F.xxhash64(F.lit(1), "key")
    least = filed.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(mask)).alias("hub"), F.count("*").alias("texts")).filter("texts > 1")
    least = stored(least.select("key", F.col("hub").bitwiseXOR(mask).alias("hub")), "copy-hubs")
    met = stored(filed.join(least, "key"), "copy-meetings")
    spokes = met.filter(F.col("node") != F.col("hub")).select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    tried = stored(spokes.distinct(), "copy-tried")
    found = _verified(tried, prints, texts)

    found_groups = connected_components(found.select("a", "b"))
    placed = met.select("key", "node", "n", "rest").join(found_groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
    placed = placed.join(apart, "key", "left_semi").join(prints.select("node", *SKETCH), "node")
    placed = stored(placed, "copy-apart")
    columns = ["key", "node", "n", "rest", "component", *SKETCH]
    meets = (F.col("a_key") == F.col("b_key")) & (F.col("a_component") < F.col("b_component"))
    may_be = _may_be(F.col("a_n"), F.col("b_n"), F.col("a_rest"), F.col("b_rest"))
    cross = _side(placed, "a", columns).join(_side(placed, "b", columns), meets & may_be & _sketches_near("a", "b"))
    fresh = cross.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = _verified(fresh, prints, texts)
    return found.unionByName(more).filter("a_fp <> b_fp").select(F.least("a_fp", "b_fp").alias("a"), F.greatest("a_fp", "b_fp").alias("b")).distinct()
