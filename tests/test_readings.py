"""Page records, boundaries and summaries from a made provider."""

import json

from paperloom.plans import readings as R


def test_page_records(spark):
    raw = spark.createDataFrame([(1, 1, " a ", "Doc 23", "true", "2", "email", "x", "TRUE"), (1, 2, None, None, None, "two", "nota ", "kamer-brief", "yes"), (1, 3, "b", "2024", "0", None, None, None, "no")],
                                "dossier_id long, page_num long, text string, doc_code string, is_new_document string, within_doc_page string, category string, doc_subtype string, email_start string")
    got = [(r.text, r.detected_code, r.is_new_document, r.within_doc_page, r.category, r.doc_subtype, r.email_start, r.chat_messages) for r in R.page_records(raw).orderBy("page_num").collect()]
    assert got == [("a", "0023", True, 2, "E-mail", "email", True, []), ("", None, False, None, "Nota", "nota", False, []), ("b", None, False, None, "Other", "other", False, [])]


def test_read_pages(spark):
    pages = spark.createDataFrame([(1, 1, b"good"), (1, 2, b"cut"), (1, 3, b"bad"), (1, 4, b"good")], "dossier_id long, page_num long, image binary")

    def provider(image):
        if bytes(image) == b"bad":
            raise RuntimeError("no answer")
        told = json.dumps({"text": "hi", "category": "email", "email_start": True, "within_doc_page": 1})
        return told if bytes(image) == b"good" else told[: told.index(', "within')]

    import functools

    quick = functools.partial(R.providers.ask, tries=1)
    old, R.providers.ask = R.providers.ask, quick
    try:
        got = [(r.page_num, r.text, r.category, r.email_start) for r in R.read_pages(pages, provider).orderBy("page_num").collect()]
    finally:
        R.providers.ask = old
    assert got == [(1, "hi", "E-mail", True), (2, "hi", "E-mail", True), (3, "", "Other", False), (4, "hi", "E-mail", True)]


PAGE = "dossier_id long, page_num long, detected_code string, within_doc_page int, is_new_document boolean, category string, text string, email_start boolean"


def test_boundaries_and_routes(spark):
    rows = [(1, i, None, None, i == 1, "Nota", f"t{i}", False) for i in range(1, 6)] + [(2, i, "0001", None, False, "Nota", "x", False) for i in (1, 2)] + [(3, i, None, None, i == 2, "Nota", f"z{i}", False) for i in (1, 2)]
    pages = spark.createDataFrame(rows, PAGE)

    def provider(summary):
        assert summary.startswith("p001: stamp=null")
        return "nothing" if "z1" in summary else '{"documents": [{"doc_code": "0007", "start_page": 1, "email_starts": [1, "x"]}, {"doc_code": null, "start_page": "4"}'

    got = [(r.pos, r.doc_code, r.start_page, r.email_starts) for r in R.boundary_documents(pages.where("dossier_id = 1"), provider).orderBy("pos").collect()]
    assert got == [(0, "0007", 1, [1]), (1, None, 4, [])]
    codes = {(r.dossier_id, r.page_num): (r.doc_code, r.method) for r in R.assigned(pages, provider).collect()}
    assert [codes[1, i][0] for i in range(1, 6)] == ["0007"] * 3 + ["auto_002"] * 2
    assert codes[2, 1] == codes[2, 2] == ("0001", "stamp") and [codes[3, i][0] for i in (1, 2)] == ["auto_001", "auto_002"]
    plain = {(r.dossier_id, r.page_num): r.doc_code for r in R.assigned(pages).collect()}
    assert plain[1, 5] == "auto_001"


def test_described(spark):
    docs = spark.createDataFrame([(1, "a", "Nota", "nota", "een  twee"), (1, "b", "Chat", "chat_sms", "ruw"), (1, "c", "Nota", "nota", "")], "dossier_id long, doc_code string, category string, doc_subtype string, text string")
    messages = spark.createDataFrame([(1, "b", 2, "Jan", "12:01", "hoi"), (1, "b", 1, "Piet", None, "dag  allen"), (1, "b", 3, "Jan", "12:02", " ")], "dossier_id long, doc_code string, idx long, sender string, timestamp string, body string")
    told = {r.doc_code: r.summary for r in R.described(docs, messages, lambda t: f"<{t}>").collect()}
    assert told["a"] == "<een twee>." and told["b"] == "<Piet: dag allen 12:01 Jan: hoi>." and told["c"]
    own = {r.doc_code: r.summary for r in R.described(docs, messages).collect()}
    assert own["a"].startswith("een twee") and "dag allen" in own["b"] and own["c"] == told["c"]
