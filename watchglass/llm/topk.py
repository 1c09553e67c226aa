"""Exact top-k search by inner product, with a uniform threshold in three phases.

Cao and Wang, "Efficient Top-K Query Calculation in Distributed Networks", PODC 2004: a score is a sum over slices of
the components, and each slice of each shard has a list of local scores.

1. Every shard keeps the top of each of its slices' lists and resolves the full scores of these entries alone. The
   k-th best of them over all shards is a cutoff that the true k-th best can't be under.
2. The cutoff goes to all shards. Divided by the number of slices, it is the least local score that a result must have
   in some slice. Each shard collects the entries at or over this share; what a slice didn't list is under the share,
   so entries whose known local scores can't reach the cutoff any more fall away.
3. The remaining local scores of the entries left are resolved, exactly, and the best k stay.

Vectors travel in blocks. A block of queries meets the blocks of a shard in an equi-join on the shard; the queries are
packed into full blocks and copied to every shard, the vectors are dealt once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchglass.llm.common import stored, table

K, SCALE, SLICES, EVERY = 5, 256, 4, 50
#: Vectors in a block.
BLOCK = 512
#: How whole components are kept; "d" has the unscaled doubles of a block with components beyond 64 bits.
KINDS = {"b": np.int8, "h": np.int16, "i": np.int32, "q": np.int64, "d": np.float64}


def finite(vector: Column) -> Column:
    """The components as doubles; null if the vector is null or not all of it finite numbers."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad & vector.isNotNull(), doubles)


def whole(x: float, scale: int) -> int:
    """floor(scale * x) of a double, exact."""
    return int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale)


def encode(data: np.ndarray, scale: int) -> tuple[str, bytes]:
    """Kind and bytes of a matrix of doubles, as whole components in the least type that holds them."""
    most = float(np.abs(data).max(initial=0.0)) * scale
    if most >= 1 << 62:
        return "d", data.astype(np.float64).tobytes()
    made = np.floor(data * scale).astype(np.int64)  # exact: the scaled double of such a size has no error if the scale is a power of two
    if scale & (scale - 1):
        made = np.array([[whole(x, scale) for x in row] for row in data.tolist()], np.int64).reshape(data.shape)
    most = max(int(made.max(initial=0)), -int(made.min(initial=0)))
    kind = next(k for k in "bhiq" if most <= np.iinfo(KINDS[k]).max)
    return kind, made.astype(KINDS[kind]).tobytes()


BLOCKS = "block long, dim int, kind string, ids binary, rows binary, data binary"
NAMES = [x.split()[0] for x in BLOCKS.split(", ")]


def _batch(block: int, dim: int, kind: str, ids: np.ndarray, rows: np.ndarray, data: bytes) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
    values = (block, dim, kind, ids.astype(np.int64).tobytes(), rows.astype(np.int64).tobytes(), data)
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], NAMES)


def _blocks(scale: int):
    """Blocks of vectors of one dimension; ``rows`` tells rows apart that have the same id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, row = TaskContext.get().partitionId(), 0, 0
        held: dict[int, list[tuple[int, int, np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            part = held.pop(dim)
            data = np.stack([v for _, _, v in part]) if dim else np.zeros((len(part), 0))
            made += 1
            kind, raw = encode(data, scale)
            return _batch((task << 32) + made, dim, kind, *(np.array([x[i] for x in part], np.int64) for i in (0, 1)), raw)

        for batch in batches:
            vectors = batch.column(1)
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False))
            rows = range((task << 33) + row, (task << 33) + row + batch.num_rows)
            row += batch.num_rows
            for vec_id, number, end, dim in zip(batch.column(0).to_pylist(), rows, ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True):
                held.setdefault(dim, []).append((vec_id, number, flat[end - dim : end]))
                if len(held[dim]) == BLOCK:
                    yield block(dim)
        for dim in list(held):
            yield block(dim)

    return run


class Block:
    """Vectors of one dimension as whole numbers."""

    def __init__(self, dim: int, kind: str, ids: bytes, rows: bytes, data: bytes, scale: int = SCALE):
        self.ids, self.rows = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64)
        self.data = np.frombuffer(data, KINDS[kind]).reshape(len(self.ids), dim)
        if kind == "d":
            exact = np.empty(self.data.shape, object)
            exact[...] = [[whole(x, scale) for x in row] for row in self.data.tolist()]
            self.data, self.most = exact, max((abs(x) for x in exact.ravel()), default=0)
        else:
            self.most = max(int(self.data.max(initial=0)), -int(self.data.min(initial=0)))


def slices(dim: int) -> list[slice]:
    cuts = np.linspace(0, dim, min(SLICES, max(1, dim)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


class Lists:
    """The lists of local scores that a block of queries has over a block of vectors, one for each slice.

    Scores are exact: doubles while all sums stay under 2^53, then 64-bit integers, then Python's integers.
    """

    def __init__(self, queries: Block, vectors: Block):
        most = queries.data.shape[1] * queries.most * vectors.most
        kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
        self.q, self.v = queries.data.astype(kind), vectors.data.astype(kind)
        self.slices = slices(self.q.shape[1])
        self.own = queries.rows[:, None] == vectors.rows
        self.resolved = 0

    def local(self, s: int) -> np.ndarray:
        part = self.slices[s]
        return self.q[:, part] @ self.v[:, part].T if part.stop > part.start else np.zeros(self.own.shape, self.q.dtype)

    def full(self, j: np.ndarray, at: np.ndarray, missing: slice | None = None) -> np.ndarray:
        """Scores of the pairs (j, at), a slice's alone if given, in parts of bounded size."""
        out = np.zeros(len(j), self.q.dtype)
        part = missing or slice(0, self.q.shape[1])
        step = max(1, (1 << 22) // max(1, part.stop - part.start))
        for a in range(0, len(j), step):
            out[a : a + step] = (self.q[j[a : a + step], part] * self.v[at[a : a + step], part]).sum(1)
        return out


def tops(lists: Lists, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase one: (query, place, full score) of the top of each slice's list.

    ``least`` has for each slice and query the local score that an entry must beat to be among the shard's k best of
    that slice; it is raised on the way. Only what is listed is resolved.
    """
    listed: list[np.ndarray] = []
    n = lists.own.shape[1]
    top = min(k, n)
    for s in range(len(lists.slices)):
        part = lists.local(s)
        low = {"f": -math.inf, "i": -(1 << 63) + 1, "O": -(1 << 2200)}[part.dtype.kind]  # no score is as low
        part[lists.own] = low
        at = np.argpartition(-part, top - 1, axis=1)[:, :top] if part.dtype != object else np.argsort(-part, axis=1)[:, :top]
        found = np.take_along_axis(part, at, 1)
        j, i = np.nonzero((found > least[s][:, None]) & ~np.take_along_axis(lists.own, at, 1))
        listed.append(j * n + at[j, i])
        if top == k:
            least[s] = np.maximum(least[s], found.min(1))
    pairs = np.unique(np.concatenate(listed))
    lists.resolved += len(pairs)
    j, at = pairs // max(n, 1), pairs % max(n, 1)
    return j, at, lists.full(j, at)


def collect(lists: Lists, cutoff: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases two and three: (query, place, full score) of all entries that reach the cutoff, and no others.

    Without a cutoff (fewer than k rows to choose from) every entry is resolved.
    """
    m = len(lists.slices)
    none = np.array([c is None for c in cutoff])
    # A share is rounded up: local scores are whole numbers.
    share = np.array([0 if c is None else -(-c // m) for c in cutoff], object)
    low = np.array([0 if c is None else c for c in cutoff], object)
    if lists.q.dtype != object:
        share, low = share.astype(np.float64 if lists.q.dtype == np.float64 else np.int64), low.astype(np.float64 if lists.q.dtype == np.float64 else np.int64)
    known, missing = np.zeros(lists.own.shape, lists.q.dtype), np.zeros(lists.own.shape, np.int8)
    absent = []
    for s in range(m):
        part = lists.local(s)
        over = (part >= share[:, None]) | none[:, None]
        known += np.where(over, part, 0)
        missing += ~over
        absent.append(~over)
    # What a slice has not listed is under its share, by one at least.
    reach = known + missing * (share[:, None] - 1)
    left = (missing < m) & ((reach >= low[:, None]) | none[:, None]) & ~lists.own
    j, at = np.nonzero(left)
    lists.resolved += len(j)
    score = known[j, at]
    for s in range(m):
        rest = absent[s][j, at]
        score[rest] += lists.full(j[rest], at[rest], missing=lists.slices[s])
    keep = none[j] | (score >= low[j])
    return j[keep], at[keep], score[keep]


FOUND = "query_row long, query_id long, vec_id long, score long"


def _phases(k: int, first: bool, scale: int):
    """Over (query block, block of vectors) pairs: the best ``k`` per query of what each phase gathers.

    The best so far are held for one block of queries; pairs of one block come one after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queries, best, least, cutoff = None, None, [], None, []

        def given() -> pa.RecordBatch:
            rows = [(queries.rows[i], queries.ids[i], vec_id, -score) for i, found in enumerate(best) for score, vec_id in found]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["query_row", "query_id", "vec_id", "score"])

        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            get = lambda name, i: columns[name][i].as_py()  # noqa: B023, E731
            for i in range(batch.num_rows):
                if get("q_block", i) != now:
                    if queries is not None:
                        yield given()
                    now, queries = get("q_block", i), Block(*(get(f"q_{c}", i) for c in ("dim", "kind", "ids", "rows", "data")), scale)
                    best = [[] for _ in queries.ids]
                    least = np.full((len(slices(queries.data.shape[1])), len(queries.ids)), -math.inf, object)
                    cutoff = [] if first else list(get("cutoff", i))
                vectors = Block(*(get(c, i) for c in ("dim", "kind", "ids", "rows", "data")), scale)
                lists = Lists(queries, vectors)
                at_query, place, score = tops(lists, k, least) if first else collect(lists, cutoff)
                starts = np.flatnonzero(np.diff(at_query, prepend=-1))
                for a, b in zip(starts, [*starts[1:], len(at_query)][: len(starts)], strict=True):
                    j, at, found = int(at_query[a]), place[a:b], score[a:b]
                    if b - a > k and found.dtype != object:  # the best k, ties to smaller ids
                        chosen = np.lexsort((vectors.ids[at], -found))[:k]
                        at, found = at[chosen], found[chosen]
                    best[j] = sorted([*best[j], *zip([-int(x) for x in found], vectors.ids[at].tolist(), strict=True)])[:k]
        if queries is not None:
            yield given()

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, shards: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of highest integer inner product for each query row.

    Queries are the rows whose vec_id is divisible by ``every``; each is held against every row but itself, of the
    same dimension. Ties go to the smaller vec_id. Rows with a null id, a null vector or a component that is null or
    not finite take no part. Rows that repeat an id are rows of their own. Components may be any finite doubles and
    sums are exact; a score among the results that doesn't fit in 64 bits raises an error, as it can't be given. An
    empty table gives no rows. Other columns of ``vectors`` are not read.
    """
    spark = vectors.sparkSession
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), finite(F.col("embedding")).alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    blocks = stored(usable.mapInArrow(_blocks(scale), BLOCKS), "vector-blocks")
    # The queries' rows, taken out of the blocks, so that a row is known by one number on both sides, packed anew.
    asked = blocks.mapInArrow(_asked(every), BLOCKS)
    few = max(1, -(-asked.select(F.sum(F.octet_length("ids") / 8)).first()[0] // (8 * BLOCK)) if not asked.isEmpty() else 1)
    asked = stored(asked.repartition(int(few)).mapInArrow(_packed, BLOCKS), "query-blocks")
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = blocks.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int"))
    names = ("block", "kind", "ids", "rows", "data")

    def met(queries: DataFrame) -> DataFrame:
        copies = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        copies = copies.select("shard", "dim", F.col("dim").alias("q_dim"), *[F.col(c).alias(f"q_{c}") for c in names], *[c for c in queries.columns if c == "cutoff"])
        return copies.hint("merge").join(dealt, ["shard", "dim"])

    by_query = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    gathered = met(asked).mapInArrow(_phases(k, True, scale), FOUND)
    cutoffs = gathered.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k).filter(F.col("rank") == k)
    cutoffs = cutoffs.select(F.col("query_row").alias("row"), F.col("score").alias("least"))
    members = asked.mapInArrow(_members, "block long, at int, row long").join(cutoffs, "row", "left")
    listed = members.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "least"))).alias("cutoff"))  # at most BLOCK
    known = asked.join(listed.withColumn("cutoff", F.col("cutoff.least")), "block")
    collected = met(known).mapInArrow(_phases(k, False, scale), FOUND)
    ranked = collected.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _asked(every: int):
    """The query rows of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, rows = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64)
                if (chosen := ids % every == 0).any():
                    data = np.frombuffer(row["data"], KINDS[row["kind"]]).reshape(len(ids), row["dim"])[chosen]
                    yield _batch(row["block"], row["dim"], row["kind"], ids[chosen], rows[chosen], data.tobytes())

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one dimension and kind put together, up to BLOCK vectors in each."""
    held: dict[tuple[int, str], list[dict]] = {}
    size: dict[tuple[int, str], int] = {}

    def joined(key: tuple[int, str]) -> pa.RecordBatch:
        rows = held.pop(key)
        size.pop(key)
        ids, numbers = (np.frombuffer(b"".join(r[c] for r in rows), np.int64) for c in ("ids", "rows"))
        return _batch(rows[0]["block"], *key, ids, numbers, b"".join(r["data"] for r in rows))  # a block's number is in one place only

    for batch in batches:
        for row in batch.to_pylist():
            key, n = (row["dim"], row["kind"]), len(row["ids"]) // 8
            if size.get(key, 0) + n > BLOCK:
                yield joined(key)
            held.setdefault(key, []).append(row)
            size[key] = size.get(key, 0) + n
    for key in list(held):
        yield joined(key)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.select(["block", "rows"]).to_pylist():
            rows = np.frombuffer(row["rows"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), row["block"])), pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(rows)], ["block", "at", "row"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.place, q.vec_id AS query_id, v.vec_id, list_dot_product(q.c, v.c)::BIGINT AS score
          FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.place <> v.place),
ranked AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
