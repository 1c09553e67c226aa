from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from watchglass.llm.common import stored

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the tables")


def test_stages_do_what_they_say(spark):
    """Each stage against its own definition on its own input."""
    from watchglass.llm import compression, line_dedup, simhash, toxicity
    from watchglass.llm.common import table

    docs = documents = table(spark, FOLDER, "documents")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    outs = []
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), "stage")
        outs.append(docs)
        assert name and docs.count() > 0
    assert all(o.columns == documents.columns for o in outs[:-1])
    labels = table(spark, FOLDER, "labels")
    clean = toxicity.score(documents, toxicity.fit(documents, labels)).filter(F.col("score") < toxicity.THRESHOLD)
    assert ids(outs[0]) == ids(clean)
    good = compression.score(outs[0], compression.fit(documents, labels)).filter(F.col("score") >= compression.THRESHOLD)
    assert ids(outs[1]) == ids(good)
    lines = line_dedup.dedup_lines(outs[1]).select("doc_id", "text")
    assert ids(outs[2]) == ids(outs[1]) and outs[2].select("doc_id", "text").exceptAll(lines).count() == 0
    kept = simhash.near_duplicates(outs[2]).groupBy("component_id").count()
    assert ids(outs[3]) == sorted(r["component_id"] for r in kept.collect())
    assert set(ids(outs[4])) == set(ids(outs[3]))
    assert outs[4].groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


@pytest.mark.parametrize(("step", "operator"), [(0, "toxicity"), (1, "compression")])
def test_a_stage_run_by_itself_hands_over_small_batches(spark, monkeypatch, step, operator):
    """``run`` is not the only one that calls the stages, and a stage's frame is run after it was returned."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": [b.num_rows], "n_chars": [b.nbytes], "score": [0.4]})

    before = {k: spark.conf.get(k) for k in pipeline.BATCH}
    monkeypatch.setattr(getattr(pipeline, operator), "fit", lambda *_: None)
    monkeypatch.setattr(getattr(pipeline, operator), "with_score", lambda docs, *_: docs.mapInArrow(sizes, "doc_id long, n_chars long, score double"))
    monkeypatch.setattr(pipeline, "_columns", lambda docs: [F.col("doc_id"), F.col("n_chars")])
    try:
        for rows, chars in ((4000, 10), (400, 100_000)):
            docs = spark.range(0, rows, 1, 1).select(F.repeat(F.lit("x"), chars).alias("text"))
            found = pipeline.STAGES[step][1](spark, docs, FOLDER).collect()
            assert sum(r["doc_id"] for r in found) == rows
            assert max(r["doc_id"] for r in found) <= 500 and max(r["n_chars"] for r in found) <= 10_000_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_the_driver_holds_each_word_once_and_forgets_inputs(monkeypatch):
    """The driver's Python took 240 MB for the words of 2400 texts and kept most of it."""
    from watchglass.llm import toxicity

    held, windows = [], toxicity.Network.windows

    def seen(net, texts):
        held.append([w for ws in texts for w in ws])
        return windows(net, texts)

    monkeypatch.setattr(toxicity.Network, "windows", seen)
    net = toxicity.train([(f"some words come again and again {i % 3} times", i % 2) for i in range(20)], 0.5)
    assert held and all(len(set(map(id, ws))) == len(set(ws)) for ws in held)
    assert not net._rows and net._inputs is None


def test_remembered_inputs_take_no_more_than_their_bound(monkeypatch):
    from watchglass.llm import toxicity

    net = toxicity._fresh([["one"], ["two"]], np.array([0, 1]), 7)
    net._most = 20_000
    words = [f"w{i}" for i in range(18_000)]
    first = net.inputs(words)
    assert len(net._inputs) == 20_000 and (net.inputs(words) == first).all()
    net.inputs([f"v{i}" for i in range(5000)])
    assert len(net._rows) == 5000


def test_each_stage_begins_with_memory_given_back(spark, monkeypatch):
    asked, before = [], {k: spark.conf.get(k) for k in pipeline.BATCH}
    monkeypatch.setattr(pipeline, "give_back", asked.append)
    try:
        wrapped = pipeline._in_small_batches(lambda spark, docs, sf_dir: len(asked))
        assert wrapped(spark, None, FOLDER) == 1 and asked == [spark]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_memory_is_given_back_or_left(spark):
    from watchglass.plans.lineage import give_back

    assert give_back(spark) in (True, False)
    assert spark.range(3).count() == 3
