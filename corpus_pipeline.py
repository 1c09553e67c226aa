"""The corpus pipeline: reject toxic and poor documents, take out repeated lines, keep one of each group, pack.

Each stage takes (spark, docs, sf_dir) and gives a frame, which is written and read again for the next one. All but
the last give the columns of documents, as they came in but for what the stage changes, whatever other columns there
are and whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchglass.llm import compression, line_dedup, packing, shingles, simhash, toxicity
from watchglass.llm.common import quoted, small, stored, table, unused
from watchglass.plans.lineage import give_back, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: What goes to Python at once; texts are long, and the workers of all stages share an executor's memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def _in_small_batches(stage: Stage) -> Stage:
    """``stage``, with BATCH set for its session, begun when the driver has given back what earlier stages left free.

    The settings count when the stage's frame is run, which may be after it was returned, so they stay; ``run`` puts
    back what there was.
    """

    @functools.wraps(stage)
    def small_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, value in BATCH.items():
            spark.conf.set(key, value)
        give_back(spark)
        return stage(spark, docs, sf_dir)

    return small_batches


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold; the network learns from the labels of the input's documents.

    A null text is scored as an empty one. Null and repeated ids don't matter: scores come row by row, without a key.
    """
    net, name = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), unused(docs.columns, "score")
    return toxicity.with_score(docs, net, name).filter(F.col(name) < toxicity.THRESHOLD).select(*_columns(docs))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or over the quality threshold; nulls and repeats as for ``drop_toxic``."""
    model, name = compression.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), unused(docs.columns, "score")
    return compression.with_score(docs, model, name).filter(F.col(name) >= compression.THRESHOLD).select(*_columns(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; n_chars follows the text where lines went.

    No document goes, though it may end up empty. A null text stays null. The first line of a class stays, by doc_id
    (null last), the text's hash and position; rows that repeat an id and its text keep the same lines.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    slim = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(others)]).alias("others"))
    done = line_dedup.dedup_lines(slim)

    def value(c: str) -> Column:
        if c in ("doc_id", "text"):
            return F.col(c)
        given = F.col("others")[f"c{others.index(c)}"]
        if c != "n_chars":
            return given.alias(c)
        return F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(given).alias(c)

    return done.select(*[value(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the first by doc_id (null last), then by the text's hash.

    Groups are what links lead to: fingerprints as in op7, and five-word shingles of similarity 0.8 or more. Texts
    without words, null ones among them, have fingerprint zero and are one group. Of rows that repeat an id and its
    text the one whose other columns have the least hash stays.
    """
    prints = shingles.prints(docs)
    others = [F.col(quoted(c)) for c in docs.columns if c not in ("doc_id", "text")]
    keys = [F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("node"), F.xxhash64(F.lit(0), *others).alias("other")]
    rows = docs.select(*keys)
    # Copies are one before anything is joined; the least id stands for them.
    first = rows.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id")).alias("first"))
    known = first.join(prints.select("node", "fp"), "node", "left").select(F.coalesce("fp", F.lit(0)).alias("fp"), F.col("first.id").alias("doc_id"), "node")
    kept = simhash.first_of_groups(known, more=shingles.links(docs, prints)).withColumnRenamed("doc_id", "id")
    same = lambda x, y: (x["node"] == y["node"]) & x["id"].eqNullSafe(y["id"])
    whole = docs.select(F.struct(*_columns(docs)).alias("row"), *keys)
    # Those that go, and those that come more than once, are fewer than those that stay.
    gone = small(rows.join(kept, same(rows, kept), "left_anti").select("id", "node").distinct())
    left = whole.join(gone, same(whole, gone), "left_anti")
    again = small(rows.groupBy("id", "node").agg(F.count("*").alias("n"), F.min("other").alias("least")).filter("n > 1").drop("n"))
    single = left.join(again, same(left, again), "left_anti")
    repeated = left.join(again.withColumnsRenamed({"id": "r_id", "node": "r_node"}), (F.col("node") == F.col("r_node")) & F.col("id").eqNullSafe(F.col("r_id")) & (F.col("other") == F.col("least")))
    one = single.select("row").unionByName(repeated.dropDuplicates(["id", "node"]).select("row"))
    return one.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences; a null text is an empty one, and each row is a document of its own."""
    return packing.pack_documents(docs, packing.default_path()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _in_small_batches(drop_toxic)),
    ("quality classifier", _in_small_batches(drop_poor)),
    ("line dedup", _in_small_batches(drop_lines)),
    ("SimHash near-dedup", _in_small_batches(drop_copies)),
    ("best-fit packing", _in_small_batches(pack)),
]

#: Scores, fingerprints and tokens can't be had in SQL; tests hold each stage against its own definition.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = {key: spark.conf.get(key) for key in BATCH}
    try:
        for name, stage in STAGES:
            with scratch(spark):  # what a stage wrote on its way goes when its result is written
                docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower(), outlives=True)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return docs
