"""Golden sequences, metrics, dossier files and the streaming forward fill."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from paperloom.operators import evaluate as V
from paperloom.operators import sequence as S
from paperloom.plans import dossier as P
from paperloom.sources import dossier_files as DF
from paperloom.streaming.pages import forward_fill_stream

PAGE = "dossier_id long, page_num long, detected_code string, within_doc_page int, is_new_document boolean, category string, text string, email_start boolean, doc_date string"


def pages(spark, rows):
    return spark.createDataFrame([(1, i, c, w, n, k, "", False, None) for i, (c, w, n, k) in enumerate(rows, 1)], PAGE)


def codes(df):
    return [r.doc_code for r in df.orderBy("page_num").collect()]


def test_forward_fill_golden(spark):
    rows = [(None, None), ("0001", None), (None, None), (None, 1), (None, None), ("0002", None)]
    assert codes(S.forward_fill(pages(spark, [(c, w, False, "Other") for c, w in rows]))) == ["unknown", "0001", "0001", "unknown_1", "unknown_1", "0002"]


def test_forward_fill_split_golden(spark):
    rows = [(None, False, "Other"), ("0001", True, "Nota"), ("0001", True, "Nota"), ("0001", False, "Nota"), (None, True, "Other"), ("0001", False, "Other"), ("0001", True, "Nota")]
    assert codes(S.forward_fill_split(pages(spark, [(c, None, n, k) for c, n, k in rows]))) == ["unknown_1", "0001", "0001_2", "0001_2", "unknown_2", "0001", "0001_3"]


def test_forward_fill_against_a_loop(spark):
    rng = random.Random(2)
    rows = []
    for d in range(150):
        for i in range(1, rng.randrange(2, 15)):
            rows.append((d, i, rng.choice([None, None, "", "0001", "0002"]), rng.choice([None, None, 1, 2]), rng.random() < 0.3, rng.choice(["Nota", "Other"]), rng.choice(["x", "Pagina 1 van 2"]), False, None))
    got = {(r.dossier_id, r.page_num): r.doc_code for r in S.forward_fill(spark.createDataFrame(rows, PAGE)).collect()}
    last, n, at = None, 0, None
    for d, i, det, wpn, _, _, text, *_ in rows:
        if d != at:
            last, n, at = None, 0, d
        if det:
            last = det
        elif last and (wpn == 1 or "Pagina 1 van" in text):
            n += 1
            last = f"unknown_{n}"
        assert got[d, i] == (last or "unknown")


def test_metrics_golden(spark):
    t, p = (spark.createDataFrame([(1, x) for x in xs], "dossier_id long, page0 long") for xs in ([0, 4, 8], [0, 3, 8]))
    n = spark.createDataFrame([(1, 10)], "dossier_id long, n long")
    m = V.page_metrics(t, p).first()
    assert m.precision == m.recall == m.f1 == pytest.approx(2 / 3)
    assert V.tolerant_metrics(t, p, 1).first().f1 == 1.0
    q = V.panoptic(*V.truth_and_prediction(t, p, n)).first()
    assert (q.rq, q.sq, q.pq) == (1.0, pytest.approx(0.85), pytest.approx(0.85))


def test_sample_pages(spark):
    df = spark.createDataFrame([(4, None), (100, None), (100, [3, 50, 60, 70, 99])], "n int, seeds array<int>")
    got = [r.s for r in df.select(S.sample_pages(F.col("n"), 8, F.col("seeds")).alias("s")).collect()]
    assert got[0] == [0, 1, 2, 3] and got[1] == [0, 33, 34, 35, 36, 66, 99]
    assert {3, 50, 99} <= set(got[2]) and len(got[2]) <= 8


def test_dossier_files(spark, tmp_path):
    cache = {"dpi": 200, "pages": [{"page_num": 1, "text": "a", "category": "email", "email_start": True}, {"page_num": 2, "text": "b", "category": "nota", "email_start": True, "doc_subtype": "Kamer-brief"}], "boundary_documents": [{"doc_code": "0007", "start_page": 1, "email_starts": [1]}], "emails_by_doc": {"0007": [{"id": "0007.1", "subject": "s"}]}}
    files = {"cache/A.json": cache, "seg/A.json": {"segments": [{"doc_code": "0001", "start_page": 0, "end_page": 3, "type": "Nota"}]}, "seg/B.json": [{"doc_code": "0002", "start_page": 1, "end_page": 1, "type": "Brief"}],
             "gt/A.json": {"documents": [{"start_page": 0, "type_gt": "E-mail", "num_emails_gt": 2}]}, "gt/B.json": {"boundaries": [3, 3, 5], "annotations": {"3": {"type_gt": "Nota"}}}}
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(body))
    c = DF.read_cache(spark, str(tmp_path / "cache"))
    got = DF.cache_pages(c).orderBy("page_num").collect()
    assert [(r.category, r.doc_subtype, r.email_start, r.is_new_document) for r in got] == [("E-mail", "email", True, False), ("Nota", "nota", False, False)]
    assert [(r.doc_code, r.start_page) for r in DF.cache_boundaries(c).collect()] == [("0007", 1)]
    assert [(r.doc_code, r.n, r.subject) for r in DF.cache_emails(c).collect()] == [("0007", 1, "s")]
    seg, gt = DF.read_segments(spark, str(tmp_path / "seg")), DF.read_truth(spark, str(tmp_path / "gt"))
    assert {(r.dossier_id, r.doc_code) for r in seg.collect()} == {("A", "0001"), ("B", "0002")}
    assert sorted((r.dossier_id, r.start_page, r.type_gt) for r in gt.collect() if r.type_gt) == [("A", 0, "E-mail"), ("B", 3, "Nota"), ("B", 3, "Nota")]
    assert sorted((r.dossier_id, r.page0) for r in DF.read_boundaries(spark, str(tmp_path / "gt")).collect()) == [("A", 0), ("B", 0), ("B", 3), ("B", 5)]
    assert [r.dossier_id for r in DF.complete_dossiers(gt, seg, c).collect()] == ["A"]
    DF.write_cache(DF.cache_pages(c), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        DF.page_range(DF.cache_pages(c), 3, 2)


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [(d, i, rng.choice([None, "0001", "0002"]), rng.random() < 0.3) for i in range(1, 13) for d in range(5)]
    schema = "dossier_id long, page_num long, detected_code string, starts boolean"
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = forward_fill_stream(stream).writeStream.format("memory").queryName("filled").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    batch = spark.createDataFrame([(d, i, c, 1 if s else None, False, "Other", "", False, None) for d, i, c, s in rows], PAGE)
    want = {(r.dossier_id, r.page_num): r.doc_code for r in S.forward_fill(batch).collect()}
    assert {(r.dossier_id, r.page_num): r.doc_code for r in spark.table("filled").collect()} == want


def test_timeline_is_in_order(spark, sf):
    from paperloom import queries

    rows = queries.QUERIES["timeline"](spark, sf).collect()
    assert len(rows) > 100 and {r.category for r in rows} >= {"E-mail", "Nota", "Brief"}
    by = {}
    for r in sorted(rows, key=lambda r: (r.dossier_id, r.position)):
        by.setdefault(r.dossier_id, []).append(r.date)
    for dates in by.values():
        known = [d for d in dates if d]
        assert known == sorted(known) and dates == known + [None] * (len(dates) - len(known))


def test_no_python_in_plans(spark, sf):
    from paperloom import queries

    for name in ("timeline", "seg2_split_emails", "cmp4_chosen_emails", "agg17_panoptic_quality"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct")), name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(5).count() == 5 and P.timeline
