"""Annotation scores, page scans, caches, hints and the dossier document."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom import queries
from paperloom.operators import match as M
from paperloom.plans import profile as H
from paperloom.sources import dossier_files as DF
from paperloom.sources import page_scans as Z


def test_mail_scores(spark):
    cols = "dossier_id long, i int, n int, subject string, sender string, date string"
    truth = spark.createDataFrame([(1, 1, 1, "Besluit versie 2", "Jan", "2024-01-02"), (1, 1, 2, "Iets anders", None, None), (1, 1, 3, None, "X", "2024-01-01"), (1, 2, 1, "abc", "P", "2024-01-03")], cols)
    pred = spark.createDataFrame([(1, 1, 1, "RE: besluit versie 2", "jan de boer", "2024-01-02"), (1, 1, 2, "zzzz", "Y", None), (1, 3, 1, "abc", "P", "2024-01-03")], cols)
    got = {r.i: tuple(r[c] for c in M.MAIL_SCORES) for r in M.match_mails(truth, pred, ["dossier_id", "i"]).collect()}
    assert got == {1: (1, 1, 2, 1, 1, 1, 1), 2: (0, 0, 1, 0, 0, 0, 0), 3: (0, 1, 0, 0, 0, 0, 0)}


def test_dossier_document(spark, sf):
    rows = {r.dossier_id: json.loads(r.json) for r in queries.queries()["snk6_dossier_json"](spark, sf).collect()}
    stats = {r.dossier_id: r for r in queries.queries()["cmp5_dossier_statistics"](spark, sf).collect()}
    assert rows.keys() == stats.keys()
    n_mails = n_chats = 0
    for d, x in rows.items():
        assert list(x) == ["emails", "chats", "timeline", "stats"]
        assert x["stats"]["docs"] == stats[d].docs == len(x["timeline"]) and x["stats"]["pages"] == stats[d].pages
        assert ",".join(f"{k}:{v}" for k, v in sorted(x["stats"]["redactionCodes"].items())) == stats[d].codes
        known = [t["date"] for t in x["timeline"] if t["date"]]
        assert known == sorted(known) and [t["date"] for t in x["timeline"]] == known + [""] * (len(x["timeline"]) - len(known))
        place = {t["id"]: i for i, t in enumerate(x["timeline"])}
        assert [place[m["id"].rpartition(".")[0]] for m in x["emails"]] == sorted(place[m["id"].rpartition(".")[0]] for m in x["emails"])
        assert {m["id"].rpartition(".")[0] for m in x["emails"]} == {t["id"] for t in x["timeline"] if t["raw_type"] == "E-mail"}
        assert all(set(m) == {"id", "subject", "sender", "to", "cc", "date", "time", "attachments", "text", "pdf_page"} for m in x["emails"])
        assert all(c["deelnemers"] and c["berichten"] and c["laatsteBericht"] == c["berichten"][-1]["body"][:200] for c in x["chats"])
        n_mails, n_chats = n_mails + len(x["emails"]), n_chats + len(x["chats"])
    assert n_mails > 300 and n_chats > 50


def test_scans(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two|three")
    (tmp_path / "b.pdf").write_bytes(b"bad")

    def reader(content):
        if content == b"bad":
            yield {"text": "first"}
            raise OSError("cut short")
        for part in content.split(b"|"):
            yield {"text": part.decode(), "image": part}

    got = {(r.dossier_id, r.page_num): (r.text, r.error) for r in Z.scan(spark, str(tmp_path / "*.pdf"), reader, first=2).collect()}
    assert got == {("a", 2): ("two", None), ("a", 3): ("three", None), ("b", 0): (None, "OSError: cut short")}
    whole = Z.scan(spark, str(tmp_path / "a.pdf"), reader, last=2)
    seen = Z.region_texts(whole, {"top": (0, 0, 1, 0.1), "btm": (0, 0.9, 1, 1)}, lambda image, box, allowed: f"{len(image)}{box[1]}{allowed[:1]}").collect()
    assert sorted((r.page_num, r.region, r.text) for r in seen) == [(1, "btm", "30.90"), (1, "top", "300"), (2, "btm", "30.90"), (2, "top", "300")]


def test_recovered_needs_two_codes(spark):
    pages = spark.createDataFrame([(1, 1, "0001"), (1, 2, None), (2, 1, "0001"), (2, 2, "0002"), (2, 3, None), (2, 4, "")], "dossier_id long, page_num long, detected_code string")
    found = spark.createDataFrame([(1, 2, "0009"), (2, 3, "0008"), (2, 1, "0007")], "dossier_id long, page_num long, code string")
    assert [r.detected_code for r in Z.recovered(pages, found).orderBy("dossier_id", "page_num").collect()] == ["0001", None, "0001", "0002", "0008", ""]


def test_requests():
    assert Z.checked_request("OCR ", None, -3, 9) == ("ocr", "openai", 1, 9)
    for bad in (("pdf",), ("vlm", "else"), ("vlm", "gemini", 5, 4)):
        with pytest.raises(ValueError):
            Z.checked_request(*bad)


def test_cache_updates_and_files(spark, tmp_path):
    cache = {"dpi": 200, "pages": [{"page_num": 1, "text": "a é"}], "boundary_documents": None}
    (tmp_path / "c").mkdir()
    (tmp_path / "c/A.json").write_text(json.dumps(cache))
    c = DF.read_cache(spark, str(tmp_path / "c"))
    bounds = spark.createDataFrame([("A", 1, "0002", 3, [3]), ("A", 0, "0001", 1, [])], "dossier_id string, pos int, doc_code string, start_page int, email_starts array<int>")
    mail = spark.createDataFrame([("A", "0001", 1, "0001.1", "s", "x", None, None, None, None, ["f.pdf"], "t", 1)], f"dossier_id string, doc_code string, n int, {DF.EMAIL[len('struct<') : -1].replace(':', ' ', 0)}")
    DF.write_caches(DF.updated_cache(c, bounds, mail), str(tmp_path / "out"))
    back = DF.read_cache(spark, str(tmp_path / "out"))
    assert [(r.dossier_id, r.doc_code, r.start_page) for r in DF.cache_boundaries(back).orderBy("pos").collect()] == [("A", "0001", 1), ("A", "0002", 3)]
    assert [(r.id, r.attachments) for r in DF.cache_emails(back).collect()] == [("0001.1", ["f.pdf"])]
    assert DF.cache_pages(back).first().text == "a é"
    segs = spark.createDataFrame([("A", 2, "0002", 4, 5, "Nota"), ("A", 1, "0001", 0, 3, "Brief")], "dossier_id string, i int, doc_code string, start_page long, end_page long, type string")
    DF.write_segments(segs, str(tmp_path / "seg"), "ocr")
    assert [(r.dossier_id, r.doc_code, r.start_page) for r in DF.read_segments(spark, str(tmp_path / "seg")).orderBy("i").collect()] == [("A", "0001", 0), ("A", "0002", 4)]
    DF.write_annotations(segs.select("dossier_id", F.col("start_page").alias("page0")).where("page0 > 0"), segs.select("dossier_id", "start_page", F.col("type").alias("type_gt")), str(tmp_path / "gt"))
    assert sorted((r.start_page, r.type_gt) for r in DF.read_truth(spark, str(tmp_path / "gt")).collect()) == [(0, "Brief"), (4, "Nota")]


def test_hints(spark):
    told = spark.createDataFrame([([f"{i}:0001" for i in range(1, 5)],), ([f"{i}:0001" for i in range(100, 200)],)], "e array<string>").select(H.listed(F.col("e")).alias("t")).collect()
    assert told[0].t == "  1:0001  2:0001  3:0001  4:0001" and told[1].t.endswith("  ...") and len(told[1].t) <= 502
    pilot = spark.createDataFrame([(1, 1, "Docnr 5"), (1, 2, None), (2, 1, None), (3, 1, "123456"), (3, 2, "123457"), (4, 1, "7601441"), (4, 2, "7601441"), (5, 1, "0012"), (5, 2, "123456")], "dossier_id long, page_num long, raw_code string")
    got = {r.dossier_id: (r.stamp_format, r.stamp_example) for r in H.profile(pilot).collect()}
    assert got == {1: ("docnr", "Docnr 5"), 2: ("none", None), 3: ("6-digit", "3456"), 4: ("7-digit", "0144"), 5: ("4-digit", "0012")}
    hints = [r.h for r in spark.createDataFrame([(f,) for f in (*H.FORMATS, "x")], "f string").select(H.profile_hint(F.col("f"), F.lit("0012")).alias("h")).collect()]
    assert len(set(hints)) == 6 and hints[-1] == "" and '"0012"' in hints[2]


def test_structured_mails(spark):
    from paperloom.plans import product as R

    docs = spark.createDataFrame([(1, "0001", "E-mail", "told"), (1, "0002", "E-mail", "cut"), (1, "0003", "E-mail", "bad"), (1, "0004", "Nota", "told")], "dossier_id long, doc_code string, category string, annotated_text string")
    cols = "dossier_id long, doc_code string, n int, id string, subject string, sender string, to string, cc string, date string, time string, attachments array<string>, text string, pdf_page long"
    page = lambda code, n, subject, p: (1, code, n, f"{code}.{n}", subject, None, None, None, None, None, [], "t", p)
    given = spark.createDataFrame([page("0001", 1, "first one", 4), page("0001", 2, "second", 6), page("0002", 1, "x", 8), page("0003", 1, "y", 9)], cols)

    def provider(text):
        if text == "bad":
            return "no JSON"
        return '{"emails": [{"subject": "second", "body": "b"}, {"subject": "first one", "attachments": ["a.pdf"]}]}' if text == "told" else '{"emails": [{"subject": "x", "body": "cut'

    got = {r.id: (r.subject, r.text, r.pdf_page, r.attachments) for r in R.structured_mails(docs, given, provider).collect()}
    assert got == {"0001.1": ("second", "b", 6, []), "0001.2": ("first one", "", 4, ["a.pdf"]), "0002.1": ("x", "cut", 8, []), "0003.1": ("y", "t", 9, [])}


def test_report(spark):
    from paperloom.plans import annotation as A
    from paperloom.plans import report

    run = spark.createDataFrame([("A", "a", *[0.5] * 10), ("A", "ALL", *[0.25] * 10)], "pipeline string, dossier_id string, " + ", ".join(f"{c} double" for c in A.RUN))
    lines = [r.line for r in report.console(report.tables(run), ["pipeline", "position", "dossier"]).collect()]
    assert lines[0].split()[:2] == ["dossier", "P"] and lines[1].split() == ["A", *["0.500"] * 10] and lines[2].split() == ["Average", *["0.250"] * 10]
    stats = spark.createDataFrame([(1, 2, 1.5, 1.5, 1, 2), (2, 1, 4.0, 4.0, 4, 4)], "dossier_id long, n_docs long, mean_pages double, median_pages double, min_pages long, max_pages long")
    assert tuple(report.statistics(stats).where("dossier = 'Total'").first()) == ("Total", 3, 2.75, 2.75, 1, 4)


def test_dossier_document_reads_its_tables_once(spark, sf):
    plan = queries.queries()["snk6_dossier_json"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("Generate") == 0


def _pages(spark, *texts, category="E-mail", code="0001"):
    rows = [(1, i + 1, code, t, category, i == 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "dossier_id long, page_num long, doc_code string, text string, category string, email_start boolean")


@pytest.mark.parametrize(
    "text",
    [
        "Van: a\nDatum: 25.1.20 maart 2020\nOnderwerp: x\n\nhallo",  # a code within the date
        "Van: a\nOnderwerp: x\nDatum: 1 mei 2021\nt\n---- 5.1.2original message\nDatum: 2 juni 2019\nOnderwerp: y",  # a code within a separator's words
        "Van: b <\n@5.1.2e.nl>\nDatum: 3 mei 2021\nOnderwerp: x",  # a code within an address over two lines
        "Van: 5.1.2e\nDatum: onbekend\nOnderwerp: x\n\nbody 5.1.2e\n\n\n\n\n\n\nVan: c\nDatum: 4-5-2018\nOnderwerp: y",
        "geen kop",
    ],
)
def test_dates_of_marked_texts(spark, text):
    from paperloom.plans import dossier as P
    from paperloom.plans import product as R

    for pages in (_pages(spark, text), _pages(spark, text, "vervolg", "Van: z")):
        docs = R.finalised(pages, started=True)
        want = P.dated(docs).select(F.date_format("date", "yyyy-MM-dd")).first()[0] or ""
        assert [t["date"] for t in json.loads(R.dossier_json(docs).first().json)["timeline"]] == [want]


def test_given_mails_and_messages(spark):
    from paperloom.plans import product as R

    pages = _pages(spark, "Van: a\nOnderwerp: x\n\n[12:05] jan : hoi 5.1.2e\nPiet (12:06): b", "Forbidden").unionByName(_pages(spark, "niets", category="Chat", code="0002"))
    docs = R.finalised(pages, started=True).localCheckpoint()
    own = json.loads(R.dossier_json(docs).first().json)
    assert json.loads(R.dossier_json(docs, R.page_mails(pages.where("category = 'E-mail'"))).first().json) == own
    assert [(m["id"], m["pdf_page"], m["date"]) for m in own["emails"]] == [("0001.1", 1, "")] and own["stats"] == {"docs": 2, "pages": 3, "redactionCodes": {"5.1.2e": 1}}
    assert [(c["deelnemers"], len(c["berichten"]), c["chatName"]) for c in own["chats"]] == [(["jan", "Piet"], 2, "jan, Piet"), ([], 0, "0002")]
    told = spark.createDataFrame([(1, "0002", 2, "B", "t2", "zwei"), (1, "0002", 1, "a", "t1", "5.1.2e"), (1, "0002", 3, " A", "t3", " ")], "dossier_id long, doc_code string, idx long, sender string, timestamp string, body string")
    both = {c["sourceDocId"]: c for c in json.loads(R.dossier_json(docs, messages=told).first().json)["chats"]}
    assert both["0001"]["deelnemers"] == ["jan", "Piet"]
    assert (both["0002"]["deelnemers"], both["0002"]["laatsteBericht"], [m["isRedacted"] for m in both["0002"]["berichten"]]) == (["a", "B"], "zwei", [True, False, False])
    assert {r.doc_code: r.laatsteBericht for r in R.chats(docs, told).collect()} == {"0001": "b", "0002": "zwei"}
    given = spark.createDataFrame([(1, "0001", n, f"0001.{n}", f"s{n}", None, None, None, "2020-01-02T10:00", None, [], t, n) for n, t in ((1, "t"), (2, "Forbidden"), (3, "u"))], "dossier_id long, doc_code string, n int, id string, subject string, sender string, to string, cc string, date string, time string, attachments array<string>, text string, pdf_page long")
    assert [(r.n, r.subject, r.date, r.time, r.pdf_page) for r in R.mails(docs, given).orderBy("n").collect()] == [(1, "s1", "2020-01-02", "10:00", 1), (3, "s3", "2020-01-02", "10:00", 3)]
