"""Quality by compression: text is good if a dictionary of good text compresses it better than one of bad text.

Two zstandard dictionaries are built from labelled texts. A text is compressed with both, in blocks short enough that
the dictionary counts throughout a long text and not only at its start. The difference of the compressed sizes over
the text's own size goes through a curve that never falls, fitted on labelled texts that the dictionaries have not
seen.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchglass.llm.calibration import fit_logistic, fit_monotone, monotone_chance, prior_weights
from watchglass.llm.common import class_share, held_out, labelled, scored, table

#: Labelled documents of each class that are learned from, at most.
PER_CLASS = 1500
BLOCK, DICTIONARY, LEVEL = 512, 65536, 1
THRESHOLD = 0.3


def blocks(text: str) -> list[bytes]:
    data = text.encode()
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def _dictionary(texts: Sequence[str]) -> bytes:
    """A dictionary of all blocks of the texts; raw text where there is too little to train on."""
    found = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, found)) // 8)), found).as_bytes()
    except zstandard.ZstdError:
        return b"".join(found)[-DICTIONARY:]


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float
    knots: tuple[list[float], list[float]] = ((0.0,), (0.5,))

    def chances(self, found: np.ndarray) -> np.ndarray:
        return monotone_chance(found, self.knots, self.slope, self.intercept)

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for data in (self.good, self.bad):
            kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            known = zstandard.ZstdCompressionDict(data, dict_type=kind)
            known.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
        return made


def differences(model: Model, texts: Sequence[str]) -> np.ndarray:
    """Normalised compressed-size difference of each whole text: above 0 where the good dictionary is the better one."""
    good, bad = (c.compress for c in model.compressors())
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        parts = blocks(text)
        if parts:
            a, b = sum([len(good(p)) for p in parts]), sum([len(bad(p)) for p in parts])
            out[i] = (b - a) / sum(map(len, parts))
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learns from at most ``per_class`` labelled documents of each class, none of the held-out fold.

    Two thirds make the dictionaries, the rest the curve, with the classes weighted as they occur in all labels.
    Without both classes every score is the share of label 1 (a half without labels).
    """
    rows = labelled(docs, labels, "quality", per_class)
    share = class_share(labels, "quality")
    made, rest = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    texts = [[t for t, y in made if y == v] for v in (1, 0)]
    if not all(texts) or len({y for _, y in rest}) < 2:
        return Model(b" " * 64, b" " * 64, 0.0, float(np.log(share / (1 - share))), ((0.0,), (share,)))
    model = Model(*map(_dictionary, texts), 0.0, 0.0)
    marks = np.array([y for _, y in rest])
    found, weight = differences(model, [t for t, _ in rest]), prior_weights(marks, share)
    slope, intercept = fit_logistic(found, marks, weight)
    return replace(model, slope=slope, intercept=intercept, knots=fit_monotone(found, marks, weight))


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score under ``name``, row by row; a column of that name is replaced."""
    return scored(docs, lambda texts: model.chances(differences(model, texts)), name=name)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): the chance of label 1 for each whole text.

    A null or empty text has difference 0 and its score is the curve's at 0. A null doc_id stays null; repeated rows
    each give a row; an empty table gives none. Other columns of ``docs`` are not read.
    """
    return with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model).select("doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
