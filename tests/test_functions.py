"""Hand-derived values of the column functions, and folds against sequential models."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.functions import dates as D
from paperloom.functions import repair
from paperloom.functions import text as T
from paperloom.operators import emails as E
from paperloom.operators import match as M


def values(spark, f, items):
    df = spark.createDataFrame(list(enumerate(items)), "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def check(spark, f, pairs):
    assert values(spark, f, [a for a, _ in pairs]) == [b for _, b in pairs]


def test_doc_code(spark):
    check(spark, T.doc_code, [
        ("0143", "0143"), ("Doc 23", "0023"), ("7", "0007"), ("7601441", "0144"), ("760143", "0143"), ("542240014", "0014"), ("123456", "3456"), ("1234", None), ("2024", None),
        ("0000", None), ("5.1.2e", None), ("512", None), ("0512", None), ("abc", None), ("", None), (None, None), ("00001", None), ("00012", "0001"),
    ])


def test_parse_date(spark):
    at = lambda x: F.date_format(D.parse(x), "yyyy-MM-dd HH:mm")
    check(spark, at, [
        ("2025-03-25T14:32", "2025-03-25 14:32"), ("18-09-2025 14:32", "2025-09-18 14:32"), ("Thur 6/5/2025 12:58:26 PM", "2025-06-05 00:00"), ("Wednesday, March 25, 2025 10:42:47 AM", "2025-03-25 00:00"),
        ("maandag 17 maart 2025 10:02", "2025-03-17 00:00"), ("17maart2025", "2025-03-17 00:00"), ("31-02-2025", None), ("18/09/2025", None), ("3 okt 2024", None), (None, None), ("", None), ("2025-13-01", None), ("2025-01-01 25:00", None),
    ])


def test_email_date(spark):
    whole = lambda x: F.concat_ws("|", D.email_day(D.email_date(x)), D.email_time(D.email_date(x)))
    check(spark, whole, [
        ("maandag 6 mei 2024 14:32", "2024-05-06|14:32"), ("18/09/2025", "2025-09-18"), ("Mon 3/12/2025", "2025-12-03"), ("3 march 2024", "3 march 2024"),
        ("Tuesday, March 18, 2025 9:00 AM", "|uesday, March 18, 2025 9:00 AM"), ("2024-01-03 9:05 x", "2024-01-03|9:05"),
    ])


def test_redactions(spark):
    text = "5.1.2e x5.1.1 5.1.2el (5.2.3) 5.1.2E [GELAKT: 5.1.1] 5.1.0 5.3.1"
    assert values(spark, T.redaction_codes_ocr, [text]) == [["5.1.2e", "5.1.2e", "5.2.3", "5.1.1"]]
    assert values(spark, T.redaction_codes_vlm, [text]) == [["5.1.2e", "5.1.1", "5.1.2el", "5.2.3", "5.1.2e", "5.1.1"]]
    assert values(spark, T.annotate_ocr, ["a 5.1.2el [GELAKT: 5.1.1]"]) == ["a [GELAKT: 5.1.2e] [GELAKT: [GELAKT: 5.1.1]]"]
    assert values(spark, T.annotate_vlm, ["a 5.1.2E [GELAKT: 5.1.1]"]) == ["a [GELAKT: 5.1.2E] [GELAKT: 5.1.1]"]


def test_chat_lines(spark):
    got = values(spark, T.chat_line, ["[12:05] Jan: hallo", "Piet (gisteren) : weg", "geen chat", "[x] y"])
    assert [tuple(g) if g else None for g in got] == [("Jan", "12:05", "hallo"), ("Piet", "gisteren", "weg"), None, None]
    check(spark, T.chat_body, [("5.1.2e, [GELAKT: 5.1.1]", "[Bericht weggelakt]"), ("ja 5.1.2e", "ja 5.1.2e"), (None, "")])


def test_other_text(spark):
    check(spark, T.continues, [("0143 vervolg", True), ("Begin", False), ("", False), (None, False)])
    check(spark, lambda x: T.small_page_number(x), [(" 12 ", 12), ("1234", None), ("a 7 b", 7)])
    check(spark, T.progress, [("Page 1/2 x", 45), ("page 3/3", 85), ("none", None)])
    check(spark, lambda x: T.summary(x, F.lit("Nota")), [("een  twee.", "een twee."), ("", "Dit nota-document bevat inhoud uit het Woo-dossier.")])
    check(spark, lambda x: T.thread_id(F.lit("0001"), F.split(x, ","), F.lit("")), [("Jan de B.,Piet", "0001-chat-jan-de-b-piet")])
    assert values(spark, lambda x: F.array_join(T.lines(x), "|"), ["a\r\nb\n", "", "x\n\ny", None]) == ["a|b", "", "x||y", ""]
    rows = values(spark, T.inventory_row, ["6839 12 Brief aan minister 5.1.2e", "Nummer titel", "7 ab", "0123 Verslag. openbaar"])
    assert [tuple(r) if r else None for r in rows] == [("0012", "Brief aan minister"), None, None, ("0123", "Verslag")]


def model_split(lines):
    """The split rules, line by line."""
    cuts, head, seen, last, body = [], False, set(), -999, 0
    fields = re.compile(rf"^[ \t]*({T.FIELDS})\s*:", re.I)
    for i, line in enumerate(lines):
        if re.match(T.SEPARATOR, line):
            cuts.append(i)
            head, seen, last, body = True, set(), i, 0
            continue
        m = fields.match(line)
        if not m:
            if head:
                body += 1
                head = body < 6
            continue
        f = T.CANONICAL_FIELD.get(m[1].lower(), m[1].lower())
        near = any(re.match(r"^[ \t]*(?:subject|onderwerp|betreft)\s*:\s*(.+)", x, re.I) for x in lines[i : i + 15])
        if f in seen or ((not head or (i - last > 4 and body > 2)) and near):
            cuts.append(i)
            seen = {f}
        else:
            seen.add(f)
        head, last, body = True, i, 0
    return cuts


def test_split_points(spark):
    rng = random.Random(11)
    pool = ["Van: a", "From: b", "Aan: c", "Onderwerp: d", "Subject: e", "Datum: f", "Sent: g", "tekst", "tekst", "tekst", "", "-----Original Message-----", "cc: h", "  van : x"]
    texts = ["\n".join(rng.choices(pool, k=rng.randrange(1, 40))) for _ in range(300)]
    got = values(spark, lambda x: E.split_points(T.lines(x)), texts)
    for t, g in zip(texts, got):
        lines = t.split("\n")
        assert g == model_split(lines[:-1] if lines[-1] == "" else lines)


def test_split_fields(spark):
    text = "antwoord\nVan: Jan\nAan: A;\n  B\nCC: C\nVerzonden: maandag 6 mei 2024 14:32\nOnderwerp: Verslag\nstuk een.pdf\n\nBijlage: x.docx; y.xlsx\nHallo < ,@min.nl>\n"
    df = spark.createDataFrame([("0003", text)], "doc_code string, text string")
    a, b = E.split(df).orderBy("n").collect()
    assert (a.id, a.text, a.subject) == ("0003.1", "antwoord", None) and a.warning
    assert (b.sender, b.to, b.cc, b.date, b.time, b.subject) == ("Jan", "A; B", "C", "2024-05-06", "14:32", "Verslag")
    assert b.attachments == ["stuk een.pdf", "x.docx", "y.xlsx"] and "<[GELAKT]@min.nl>" in b.text and b.warning is None


def test_json_repair(spark):
    whole = json.dumps({"a": [1, {"b": "x\"{y"}], "c": {"d": "e\\f"}, "g": "h"})
    cuts = [whole[:i] for i in range(1, len(whole) + 1)] + ['{"a": 1,}', '{"a": [1, 2,], }']
    got = values(spark, repair.closed, cuts)
    for cut, g in zip(cuts, got):
        text, stack, inside, escaped = re.sub(r",\s*([}\]])", r"\1", cut.rstrip()), [], False, False
        for c in text:
            if escaped:
                escaped = False
            elif c == "\\" and inside:
                escaped = True
            elif c == '"':
                inside = not inside
            elif not inside and c in "{[":
                stack.append("}" if c == "{" else "]")
            elif not inside and c in "}]" and stack:
                stack.pop()
        assert g == text + '"' * inside + "".join(reversed(stack))
    assert json.loads(got[-1]) == {"a": [1, 2]} and json.loads(got[-2]) == {"a": 1}
    assert got[len(whole) - 1] == whole


def test_similarity():
    assert M.similarity(" A  b", "a B") == 1.0 and M.similarity("", "a") == 0.0
    assert M.partial_ratio("abc", "xxabcxx") == 100.0 and M.partial_ratio("", "a") == 0.0
    assert 60 < M.partial_ratio("abcd", "xxabxdxx") < 80


@pytest.mark.parametrize("tolerance", [1, 2])
def test_tolerant_matches(spark, tolerance):
    from paperloom.operators import evaluate as V

    rng = random.Random(tolerance)
    rows = [(sorted(rng.sample(range(40), rng.randrange(9))), sorted(rng.sample(range(40), rng.randrange(9)))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(rows)], "i int, t array<bigint>, p array<bigint>")
    got = [r.n for r in df.select("i", V.tolerant_matches(F.col("t"), F.col("p"), tolerance).alias("n")).orderBy("i").collect()]
    for (t, p), n in zip(rows, got):
        left, k = list(t), 0
        for x in p:
            hit = next((g for g in left if abs(g - x) <= tolerance), None)
            if hit is not None:
                left.remove(hit)
                k += 1
        assert n == k


def test_literal_starts():
    """Each is a start of the pattern itself, and patterns that may begin otherwise have none."""
    starts = {p: T.literal_start(p) for v in T.RULES.values() for p in v}
    assert starts[r"\bactions?\b"] == "action" and starts[r"\bnota\s+aan\b"] == "nota" and starts[r"\baanbeveling(en)?\b"] == "aanbeveling" and starts[r"@[\w.-]+\.\w{2,}"] == "@"
    assert sum(not x for x in starts.values()) == 1 and T.literal_start("a|b") == "" and T.literal_start(r"^\s*(nota|notitie)\b") == ""
    for p, x in starts.items():
        assert p.removeprefix(r"\b").startswith(x)
