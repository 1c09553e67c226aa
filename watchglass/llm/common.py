"""What the operators of this package share: tables, the shared folder, folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchglass.plans.lineage import stored

__all__ = ["class_share", "held_out", "labelled", "quoted", "scored", "small", "stored", "table", "unused"]

#: Labelled rows of this fold are held out from training.
HELD_OUT_FOLD, FOLDS = 0, 5
#: So many rows of a few numbers (some 8 bytes each) are broadcast, at most.
BROADCAST_ROWS = 1_000_000
#: Characters of labelled texts that a driver takes, at most.
MOST_CHARS = 20_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name for Spark, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def small(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` (of a few numbers each), written to a table and marked for a broadcast if there are ``most`` at most.

    More are joined by a shuffle.
    """
    known = stored(rows, "joined-rows")
    return F.broadcast(known) if known.count() <= most else known


def unused(columns: Sequence[str], name: str) -> str:
    """``name``, with underscores after it until no column has it, in upper or lower case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text falls in the fold kept from training; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT_FOLD, F.lit(True))


def chosen_labels(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(_id, _label, _order): at most ``per_class`` training ids of each class, in an order of their ids' hashes.

    An id counts once, with its least label. Null ids or labels, and ids of the held-out fold, take no part. Each class
    is cut by its own top-k.
    """
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
        .filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
        .groupBy("_id")
        .agg(F.min("_label").alias("_label"))
        .withColumn("_order", F.xxhash64("_id"))
    )
    parts = [known.filter(F.col("_label") == value).orderBy("_order", "_id").limit(per_class) for value in (0, 1)]
    return parts[0].unionByName(parts[1])


def sample_of(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(_id, _label, _order, _text): the whole text of each of ``chosen_labels``, written to a table of its own.

    Of several texts of one id the one whose hash is least is taken. Null texts take no part.
    """
    chosen = chosen_labels(labels, label, per_class)
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text")).filter(F.col("_text").isNotNull())
    met = texts.join(F.broadcast(chosen), "_id")  # 2 * per_class ids
    one = met.groupBy("_id", "_label", "_order").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"))
    return stored(one, "labelled-sample")


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_chars: int = MOST_CHARS) -> list[tuple[str, int]]:
    """The sample on the driver: at most ``per_class`` whole texts of each class, of ``most_chars`` characters in all.

    Texts are taken in the order of their ids' hashes, as long as the characters last.
    """
    sample = sample_of(docs, labels, label, per_class)
    sizes = sample.select("_id", "_order", F.length("_text").alias("_n")).collect()  # 2 * per_class short rows
    left, ids = most_chars, []
    for r in sorted(sizes, key=lambda r: (r["_order"], r["_id"])):
        if r["_n"] <= left:
            ids.append(r["_id"])
            left -= r["_n"]
    rows = sample.filter(F.col("_id").isin(ids)).collect() if len(ids) < len(sizes) else sample.collect()
    return [(r["_text"], r["_label"]) for r in sorted(rows, key=lambda r: (r["_id"], r["_text"]))]


def class_share(labels: DataFrame, label: str) -> float:
    """Share of label 1 among all training labels, kept off 0 and 1; a half without labels."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).cast("int").isin(0, 1) & ~held_out(F.col("doc_id")))
    n, ones = known.agg(F.count("*"), F.sum(F.col(label).cast("int"))).first()
    return ((ones or 0) + 1) / (n + 2)


def scored(docs: DataFrame, chances: Callable[[Sequence[str]], np.ndarray], rows: int = 256, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` (one of that name is replaced); ``chances`` gets whole texts, null ones as empty.

    Rows stay where they are: texts pass through in batches of ``rows``, nothing is shuffled or joined.
    """
    kept = [f for f in docs.schema.fields if f.name != name]
    slim = docs.select(*[F.col(quoted(f.name)) for f in kept])
    at = [f.name for f in kept].index("text")
    schema = T.StructType([*kept, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                found = pa.array(chances([t or "" for t in part.column(at).cast(pa.string()).to_pylist()]), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, name])

    return slim.mapInArrow(run, schema)
