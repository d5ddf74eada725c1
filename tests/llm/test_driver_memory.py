"""What the pipeline holds on the driver, and that it reads its inputs by paths that only Spark can open."""

import tracemalloc

import corpus_pipeline
from paperloom.llm import common, language_id


def test_release(spark):
    assert "Trim native heap" in common.release(spark)


def test_stages_release_and_read_by_viewfs(spark, sf, monkeypatch):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.papers.link./in", f"file://{sf}")
    path, begun = "viewfs://papers/in", []
    release = common.release
    monkeypatch.setattr(common, "release", lambda s: (begun.append(len(begun)), release(s))[1])
    docs = common.table(spark, path, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = len(begun)
        docs = common.materialize(stage(spark, docs, path), f"test-{name}")
        assert len(begun) > before, name
    assert docs.count()


def test_model_takes_little_beside_itself(spark):
    """A Python object a row and a list an item took 400 bytes an entry and more."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tracemalloc.start()
    try:
        model = language_id.train(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    entries = sum(map(len, model["items"]))
    assert entries > 20_000
    assert peak < 300 * entries, peak / entries
