"""The pipeline stage by stage against brute force, and on odd rows."""

import corpus_pipeline
from paperloom.llm import pii_surrogates as P

from .test_first_ops import brute_decontamination
from .test_near_dedup import brute


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = {r.doc_id: r.text for r in docs.collect()}
    now = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        before, rows = ({r.doc_id: r.text for r in docs.collect()}, out.collect())
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            now = {r.doc_id: r.text for r in rows}
            assert len(now) == len(rows)
        if name == "language_id":
            assert now.keys() == {d for d, t in before.items() if any(c.isalpha() for c in t or "")}
        elif name == "near_dedup":
            assert now.keys() == {d for d, (_, c) in brute(list(before.items()), corpus_pipeline.NEAR_PERCENT).items() if c == d}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert now.keys() == {r[0] for r in brute_decontamination(before.items(), items) if not r[-1]}
        elif name == "pii_surrogates":
            assert now.keys() == before.keys() and any(now[d] != start[d] for d in now)
        else:
            assert {r.doc_id for r in rows} == before.keys()
        docs = spark.createDataFrame(rows, out.schema)
    got = corpus_pipeline.run(spark, sf).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, rows))


def test_near_duplicates_at_80(spark):
    """Copies between 0.80 and 0.85 go as well."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {d for d, (_, c) in brute(rows, 80).items() if c == d}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()} == kept
    assert len(kept) < sum(c == d for d, (_, c) in brute(rows).items())


def test_odd_rows(spark, sf, odd, nothing):
    for df in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, sf)
            assert name == "best_fit_packing" or out.columns == df.columns
            assert out.count() <= max(df.count(), 500)
    assert P.session_key(spark)
