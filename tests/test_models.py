"""E-mail splitting, choices and matches row by row against sequential models written apart from the engine."""

import re
from collections import defaultdict
from difflib import SequenceMatcher

import pytest

from paperloom import queries
from paperloom.operators import emails as E
from paperloom.operators import match as M
from paperloom.operators import sequence as S
from paperloom.sources import fixtures as FX

#: The header fields that the fixtures' texts use, by the field that they are.
FIELDS = {"van": "from", "from": "from", "aan": "to", "to": "to", "onderwerp": "subject", "subject": "subject", "verzonden": "sent", "sent": "sent", "datum": "date"}


def field(line):
    m = re.match(r"[ \t]*(\w+)\s*:", line)
    return FIELDS.get(m[1].lower()) if m else None


def value(block, *names):
    for line in block[:15]:
        m = re.match(r"[ \t]*(\w+)\s*:\s*(.*)", line)
        if m and m[1].lower() in names and m[2].strip():
            return m[2].strip()
    return None


def plain_split(text):
    """(subject, sender, text) of each e-mail, by walking the lines once."""
    lines = re.sub(r"<\s*,?@", "<[GELAKT]@", text).split("\n")
    cuts, seen, head, last, body = [], set(), False, -999, 0
    for i, line in enumerate(lines):
        sep, f = bool(re.match(r"-----Original Message-----", line)), field(line)
        near = any(re.match(r"(?i)[ \t]*(?:subject|onderwerp|betreft)\s*:\s*.+", x) for x in lines[i : i + 15])
        new = sep or (f and (f in seen or ((not head or (i - last > 4 and body > 2)) and near)))
        if new:
            cuts.append(i)
            seen = set() if sep else {f}
        elif f:
            seen.add(f)
        if sep or f:
            head, last, body = True, i, 0
        elif head:
            body += 1
            head = body < 6
    if not cuts:
        return [(None, None, "\n".join(lines).strip())]
    out = []
    if before := "\n".join(lines[: cuts[0]]).strip():
        out.append((None, None, before))
    for a, b in zip(cuts, [*cuts[1:], len(lines)]):
        block = lines[a:b]
        if "\n".join(block).strip():
            out.append((value(block, "subject", "onderwerp", "betreft"), value(block, "from", "van", "afzender"), "\n".join(block).strip()))
    return out


@pytest.fixture(scope="module")
def world(spark, sf):
    """Texts of the e-mail documents, their split e-mails by the model, and the given e-mails."""
    pages = S.forward_fill(FX.pages(spark, sf)).where("category = 'E-mail'").orderBy("dossier_id", "doc_code", "page_num").collect()
    by = defaultdict(list)
    for p in pages:
        by[p.dossier_id, p.doc_code].append(p)
    texts = {k: "\n\n".join(p.text for p in v) for k, v in by.items()}
    given = {}
    for k, v in by.items():
        out = []
        for j, p in enumerate(v):
            if p.email_start or not j:
                out.append([p.page_num, []])
            out[-1][1].append(p.text)
        given[k] = [{"n": n, "subject": f"S{n}", "page": page, "text": "\n\n".join(t)} for n, (page, t) in enumerate(out, 1)]
    return texts, {k: plain_split(t) for k, t in texts.items()}, given


def collected(spark, sf, name):
    out = defaultdict(dict)
    for r in queries.queries()[name](spark, sf).collect():
        out[r.dossier_id, r.doc_code][r.n] = r
    return out


def test_split(spark, sf, world):
    texts, split, _ = world
    got = collected(spark, sf, "seg2_split_emails")
    assert got.keys() == split.keys()
    for k, want in split.items():
        assert [(r.subject, r.sender, r.text) for _, r in sorted(got[k].items())] == want, texts[k]
        assert all(r.id == f"{k[1]}.{n}" for n, r in got[k].items())


def sender(text):
    m = re.search(r"(?i)(?:van|from):\s*(.+)", text[:1000])
    return m[1].strip()[:80] if m else ""


def test_enriched_and_chosen(spark, sf, world):
    _, split, given = world
    enriched, chosen = collected(spark, sf, "jn14_enriched_emails"), collected(spark, sf, "cmp4_chosen_emails")
    sources = set()
    for k, mails in split.items():
        fill = []
        for n, (subject, who, _) in enumerate(mails, 1):
            g = given[k][n - 1] if n <= len(given[k]) else None
            fill.append((subject or (g["subject"] if g else None), who or (sender(g["text"]) if g else None)))
        assert [(r.subject, r.sender) for _, r in sorted(enriched[k].items())] == fill
        got = [(r.subject, r.sender, r.source) for _, r in sorted(chosen[k].items())]
        if len(mails) <= len(given[k]):
            assert got == [(g["subject"], sender(g["text"]), "given") for g in given[k]]
        else:
            assert got == [(*f, "text") for f in fill]
        sources.add(got[0][2])
    assert sources == {"given", "text"}


def test_pages_of_emails(spark, sf, world):
    _, split, given = world
    dates = {k: {n: r.date for n, r in v.items()} for k, v in collected(spark, sf, "seg2_split_emails").items()}
    got = collected(spark, sf, "jn12_emails_to_pages")
    norm = lambda s: re.sub(r"\s+", " ", s or "").strip().lower()
    like = lambda a, b: SequenceMatcher(None, norm(a), norm(b)).ratio() if norm(a) and norm(b) else 0.0
    for k, mails in split.items():
        free, place, late = list(given[k]), {}, []
        for n, (subject, who, _) in enumerate(mails, 1):
            day = (dates[k][n] or "")[:10]
            score = lambda g: 0.5 * like(subject, g["subject"]) + 0.3 * like(who, sender(g["text"])) + 0.3 * (day == "2020-01-01")  # noqa: E731, B023
            best = max(free, key=score, default=None)
            if best is not None and score(best) >= 0.35:
                place[n] = best["page"]
                free.remove(best)
            else:
                late.append(n)
        for j, n in enumerate(late):
            place[n] = free[j]["page"] if j < len(free) else given[k][-1]["page"]
        assert {n: r.pdf_page for n, r in got[k].items()} == place


def brute_ratio(a, b):
    """Indel similarity of the shorter text with every stretch of the other, common subsequences by a table."""
    if not a or not b:
        return 100.0 if a == b else 0.0

    def common(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            before, row = row, [0]
            for j, d in enumerate(y):
                row.append(before[j] + 1 if c == d else max(before[j + 1], row[j]))
        return row[-1]

    best = 0.0
    for s, t in ((a, b), (b, a)):
        if len(s) > len(t):
            continue
        stretches = {t[i : i + len(s)] for i in range(len(t) - len(s) + 1)} | {t[:i] for i in range(1, len(s))} | {t[-i:] for i in range(1, len(s))}
        best = max([best, *(200 * common(s, x) / (len(s) + len(x)) for x in stretches)])
    return best


def test_partial_ratio():
    import random

    rng = random.Random(5)
    pairs = [("".join(rng.choices("abcd e", k=rng.randrange(0, 14))), "".join(rng.choices("abcdf ", k=rng.randrange(0, 20)))) for _ in range(600)]
    words_ = "besluit minister versie stand reactie nota van en de brief kamer".split()
    pairs += [(" ".join(rng.choices(words_, k=3)), " ".join(rng.choices(words_, k=4))) for _ in range(300)]
    for a, b in pairs:
        assert M.partial_ratio(a, b) == pytest.approx(brute_ratio(a, b)), (a, b)
    assert M.partial_ratio("besluit minister versie", "stand minister reactie nota") == pytest.approx(70.0)


def test_subject_matches(spark, sf, world):
    _, split, given = world
    got = {r.dossier_id: (r.tp, r.fp, r.fn) for r in queries.queries()["jn13_subject_matches"](spark, sf).collect()}
    truth, pred = defaultdict(list), defaultdict(list)
    for (d, c), v in given.items():
        truth[d] += [(g["n"], c, sender(g["text"])) for g in v]
    for (d, c), v in split.items():
        pred[d] += [(n, c, who or "") for n, (_, who, _) in enumerate(v, 1)]
    same = 0
    for d in got:
        # an order among e-mails of one number isn't given: compare where it can't matter
        if max(len(truth[d]), len(pred[d])) > 1:
            continue
        tp = sum(bool(t[2]) and bool(p[2]) and brute_ratio(t[2].lower(), p[2].lower()) >= 70 for t in truth[d] for p in pred[d])
        assert got[d] == (tp, len(pred[d]) - tp, len(truth[d]) - tp)
        same += 1
    assert same > 10


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def letters(rng, n):
    """Groups of 0 to 6 rows (place, subject, sender, date) by key, of few letters, so that many are alike or equal."""
    text = lambda: rng.choice([None, "", " ".join(rng.choices(["nota", "Brief", "kamer van", "x"], k=rng.randrange(1, 4)))])
    return {(d, None if d % 9 == 0 else d % 4): [(i, text(), text(), rng.choice([None, "2020-01-01", "2021-05-06"])) for i in range(1, rng.randrange(0, 7) + 1)] for d in range(n)}


def by_key(spark, rows, place):
    return spark.createDataFrame([(*k, *r) for k, v in rows.items() for r in v], f"d long, c int, {place} long, subject string, sender string, date string").repartition(5)


def test_mails_go_to_python_together(spark, small_batches):
    import random

    rng, least = random.Random(7), 70.0
    a, b = letters(rng, 60), letters(rng, 60)
    found = M.match_mails(by_key(spark, a, "n"), by_key(spark, b, "n"), ["d", "c"], least)
    # a document is no Python call of its own
    assert "CoGroups" not in found._jdf.queryExecution().toString()
    got = {(r.d, r.c): tuple(r[x] for x in M.MAIL_SCORES) for r in found.collect()}
    told = lambda x: (x or "").strip().lower()
    want = {}
    for k in a:
        free, tp, fn, dates, senders = list(b[k]), 0, 0, [0, 0], [0, 0]
        for _, s, who, day in a[k]:
            ratio = lambda p: brute_ratio(told(s), told(p[1])) if told(s) and told(p[1]) else -1.0  # noqa: E731, B023
            best = max(free, key=ratio, default=None)
            if best is None or ratio(best) < least:
                fn += 1
                continue
            free.remove(best)
            tp += 1
            dates = [dates[0] + bool(day and day == best[3]), dates[1] + bool(day)]
            senders = [senders[0] + bool(told(who) and brute_ratio(told(who), told(best[2])) >= least), senders[1] + bool(told(who))]
        if a[k] or b[k]:
            want[k] = (tp, len(free), fn, *dates, *senders)
    assert got == want and sum(x[0] for x in want.values()) > 10


def test_pages_go_to_python_together(spark, small_batches):
    import random

    rng = random.Random(11)
    a, b = letters(rng, 60), letters(rng, 60)
    found = M.match_pages(by_key(spark, a, "n"), by_key(spark, b, "pdf_page"), ["d", "c"])
    # a document is no Python call of its own
    assert "CoGroups" not in found._jdf.queryExecution().toString()
    got = {(r.d, r.c, r.n): r.pdf_page for r in found.collect()}
    norm = lambda s: re.sub(r"\s+", " ", s or "").strip().lower()
    like = lambda x, y: SequenceMatcher(None, norm(x), norm(y)).ratio() if norm(x) and norm(y) else 0.0
    want, claimed = {}, 0
    for k in a:
        free, late = list(b[k]), []
        for n, s, who, day in a[k] if b[k] else ():
            score = lambda p: 0.5 * like(s, p[1]) + 0.3 * like(who, p[2]) + 0.3 * bool(day and day == p[3])  # noqa: E731, B023
            best = max(free, key=score, default=None)
            if best is not None and score(best) >= 0.35:
                want[(*k, n)] = best[0]
                free.remove(best)
                claimed += 1
            else:
                late.append(n)
        for j, n in enumerate(late):
            want[(*k, n)] = free[j][0] if j < len(free) else b[k][-1][0]
    assert got == want and 10 < claimed < len(want)


def test_only_fields_that_are_asked_for(spark, sf):
    texts = queries._mail_texts(FX.pages(spark, sf))
    some = E.split(texts, fields=["subject", "date", "text"])
    assert some.columns == ["dossier_id", "doc_code", "n", "id", "subject", "date", "text"]
    assert sorted(some.collect(), key=str) == sorted(E.split(texts).select(*some.columns).collect(), key=str)
