"""Surrogates: detection, format, validity, coreference and distinctness."""

import re

import pytest
from pyspark.sql import functions as F

from paperloom.llm import pii_surrogates as P
from paperloom.llm import queries

KEY = "a key of the tests"

TEXTS = {
    1: "Mail John.Doe@acme.co.uk or john.doe@ACME.co.uk, call +1 (555) 123-4567 / 555-123-4567.",
    2: "Card 4111 1111 1111 1111, 4111111111111111; 4111-1111-1111-1112; IP 192.168.1.5, 10.9.8.7 and 8.8.8.8.",
    3: 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"### 4785380592391139$$$ password=9ad99cf9999de9c123 st',
    4: "Mr. John Smith met Mrs. Anna Smith; Mr. Smith left. Frau Julia Weber-Klein, г-н Иван Петров, г-жа Петрова, κυρία Παπαδοπούλου",
    5: "IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, SSN 123-45-6789, 2001:0db8:85a3:0000:0000:8a2e:0370:7334",
    6: "Clean at 12:30 on 2024-01-02: v1.2.3, 3.14, 1,000,000 and a=b; mail me @home. Chapter 5 (10) 20.",
    7: "foo@bar.com",
    10: "Tel: 0612345678, phone +31612345678, 020-1234567.",
}


@pytest.fixture(scope="module")
def done(spark):
    df = spark.createDataFrame([*TEXTS.items(), (8, None), (9, "")], "doc_id long, text string")
    return {r.doc_id: r for r in P.replace(df, KEY).collect()}


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def mod97(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def test_clean_text_stays(done):
    assert done[6].text == TEXTS[6] and done[6]._n_entities == 0
    assert done[8].text is None and done[9].text == ""


def test_formats(done):
    t = done[1].text
    mails = re.findall(r"\S+@\S+?(?=,| )", t)
    assert len(mails) == 2 and mails[0].lower() == mails[1].lower() and mails[0].endswith(".uk") and re.fullmatch(r"\w{4}\.\w{3}@\w{4}\.\w{2}\.uk", mails[0])
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} / \d{3}-\d{3}-\d{4}\.$", t) and "555-123-4567" not in t
    a, b, c = re.findall(r"\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}", done[2].text)
    assert a.replace(" ", "") == b and c.count("-") == 3 and a[0] == "4" and luhn(a) % 10 == 0 and c.replace("-", "") != b
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", done[2].text)
    assert ips[0].startswith("192.168.") and ips[1].startswith("10.") and ips[2] != "8.8.8.8" and all(0 <= int(o) <= 255 for ip in ips for o in ip.split("."))
    assert re.fullmatch(r'token = "[0-9a-f]{40}"### \d{16}\$\$\$ password=[0-9a-f]{18} st', done[3].text)
    got = re.findall(r"[A-Z]{2}\d{2}[ A-Z0-9]{11,}\d", done[5].text)
    assert [g[:2] for g in got] == ["GB", "DE"] and all(mod97(g) == 1 for g in got) and re.fullmatch(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", got[0])
    assert re.search(r"SSN \d{3}-\d{2}-\d{4}", done[5].text) and re.search(r"([0-9a-f]{4}:){7}[0-9a-f]{4}", done[5].text)


def test_labelled_phones(done):
    m = re.fullmatch(r"Tel: (0\d{9}), phone (\+3\d{10}), (0\d\d-\d{7})\.", done[10].text)
    assert m and not {m[1], m[2], m[3]} & {"0612345678", "+31612345678", "020-1234567"}


def test_names(done):
    t = done[4].text
    m = re.match(r"Mr\. (\S+) (\S+) met Mrs\. (\S+) (\S+); Mr\. (\S+) left\. Frau (\S+) (\S+), г-н (\S+) (\S+), г-жа (\S+), κυρία (\S+)$", t)
    assert m and m[1] in P.GIVEN["m"] and m[3] in P.GIVEN["f"] and m[6] in P.GIVEN["f"] and m[8] in P.GIVEN["m_cyrillic"]
    assert m[2] == m[5] and m[9].endswith("ов") and m[10].endswith("ова") and m[11].endswith("ίδου")
    assert not {"John", "Smith", "Anna", "Julia", "Петров"} & set(re.findall(r"\w+", t))


def test_nothing_left_in_the_corpus(spark):
    sf = "/root/testdata/sf0.01"
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    after = {r.doc_id: r for r in queries.op2_pii_surrogates(spark, sf).collect()}
    said = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", P.mentions(F.col("text")).alias("m")).collect()
    found = {m for r in said for m in r.m}
    assert after.keys() == before.keys() and len(found) > 50
    for r in said:
        assert after[r.doc_id].n_entities == len(r.m)
        assert (after[r.doc_id].text == before[r.doc_id]) == (not r.m)
        assert not any(m in after[r.doc_id].text for m in r.m)
        assert len(re.findall(r"[\w.]+@[\w.]+", before[r.doc_id])) == len(re.findall(r"[\w.]+@[\w.]+", after[r.doc_id].text))


def test_distinct_and_coreferent(spark):
    """In a space this small most first surrogates collide, or are entities themselves."""
    mails = [f"{a}@q.org" for a in "abcdefghijklmnopqrstuvwxyz"] + [f"{a}{d}@q.org" for a in "abcdef" for d in range(10)]
    df = spark.createDataFrame([(i, f"one {m} two {m}") for i, m in enumerate(mails)], "doc_id long, text string")
    moved = P.exceptions(P.entities(df), KEY)
    assert moved.where("attempt > 0").count() > 5
    got = [r.text.split() for r in P.replace(df, KEY).orderBy("doc_id").collect()]
    assert all(g[1] == g[3] for g in got)
    new = [g[1] for g in got]
    assert len(set(new)) == len(mails) and not set(new) & set(mails)
    other = [r.text for r in P.replace(df, key="another").orderBy("doc_id").collect()]
    assert other != [" ".join(g) for g in got]
    names = spark.createDataFrame([(i, f"Mr. {chr(65 + i // 26)}{chr(97 + i % 26)}{'xyz'[i % 3]} Smith") for i in range(200)], "doc_id long, text string")
    first = [r.text.split()[1] for r in P.replace(names, KEY).collect()]
    assert len(set(first)) == 200


def test_native_and_odd(spark, odd, nothing):
    out = P.replace(odd, KEY)
    assert out.columns == [*odd.columns, "_n_entities"] and out.count() == odd.count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert P.replace(nothing, KEY).count() == 0


WIDE = {
    1: ("Mr. John Smith left. John Smith and Smith came; SMITH too.", ["John", "Smith", "SMITH"]),
    2: ("Mr. J. Smith spoke.", ["Smith"]),
    3: ("Herr von Braun kam.", ["Braun"]),
    4: ("Mr. SMITH and Mr. McDonald met Mrs. O'Brien.", ["SMITH", "Donald", "Brien"]),
    5: ("Host 2001:db8::1 is up.", ["2001:db8::1"]),
    6: ("Mail anna@пример.рф now.", ["anna@", "пример"]),
    7: ("Ring 020 7946 0958 or 01 23 45 67 89 or 0612345678.", ["020 7946 0958", "01 23 45 67 89", "0612345678"]),
    8: ("On 01-02-2024 std::vector was 12:30.", []),
}


def test_wide_forms(spark):
    """Common forms of names, addresses and phones, and untitled mentions of a titled name."""
    df = spark.createDataFrame([(k, t) for k, (t, _) in WIDE.items()], "doc_id long, text string")
    got = {r.doc_id: r.text for r in P.replace(df, KEY).collect()}
    for k, (text, gone) in WIDE.items():
        assert not [x for x in gone if x in got[k]], (k, got[k])
    m = re.fullmatch(r"Mr\. (\w+) (\w+) left\. (\w+) (\w+) and (\w+) came; (\w+) too\.", got[1])
    assert m and m[1] == m[3] and m[2] == m[4] == m[5] and m[6] == m[2].upper()
    assert re.fullmatch(r"Mr\. [A-Z]\. \w+ spoke\.", got[2]) and got[3].startswith("Herr von ") and got[8] == WIDE[8][0]
    assert re.fullmatch(r"Ring 0\d\d \d{4} \d{4} or 0\d \d\d \d\d \d\d \d\d or 0\d{9}\.", got[7])


def one(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in P.replace(df, KEY).orderBy("doc_id").collect()]


PLANTED = [
    ("Mr. O'Neil and Mr. McDonald; Mr. MacDonald-Smith", ["Neil", "Donald", "Smith"]),
    ("Mr. John Smith came; John Smith left. Smith said so.", ["John", "Smith"]),
    ("MR. JONES stays, Mr SMITH too; Mrs. Anna Johnson met Ms. de La Tour", ["SMITH", "Anna", "Johnson", "Tour"]),
    ("secret: 4111222233334 and password=123456789012, token: abc123def", ["4111222233334", "123456789012", "abc123def"]),
    ("+31 6 12345678, 0612345678, tel: 020-1234567", ["12345678", "0612345678", "1234567"]),
    ("2001:0DB8::0001, 2001:db8::1 and 2001:db8:0:0:0:0:0:1; 10.1.2.3", ["2001:", "0DB8", "db8", "10.1.2.3"]),
    ("card 4111 1111 1111 1111 of x.y@z.org, IBAN DE89370400440532013000", ["4111 1111 1111 1111", "x.y", "z.org", "370400440532013000"]),
]


def test_planted_entities_go(spark):
    """The truth is the list above, not what the operator finds."""
    for (text, gone), new in zip(PLANTED, one(spark, *[t for t, _ in PLANTED])):
        assert not [x for x in gone if x in new], (text, new)


def test_coreference_over_titles_and_notations(spark):
    a, b, c, d = one(spark, "Dr. Smith; Mr. Smith; Mrs. Smith", "Dr. Kim Weber, Frau Kim Weber", "2001:0DB8::0001 2001:db8::1 2001:db8:0:0:0:0:0:1", "order 1234567890123456 of 4111111111111111")
    m = re.fullmatch(r"Dr\. (\w+); Mr\. (\w+); Mrs\. (\w+)", a)
    assert m and m[1] == m[2] == m[3] != "Smith"
    m = re.fullmatch(r"Dr\. (\w+) (\w+), Frau (\w+) (\w+)", b)
    assert m and m[1] == m[3] in P.GIVEN["f"] and m[2] == m[4]
    import ipaddress

    x, y, z = c.split()
    assert len({ipaddress.ip_address(i) for i in (x, y, z)}) == 1 and x == x.upper() and "::000" in x and z.count(":") == 7
    assert re.fullmatch(r"order 1234567890123456 of 4\d{15}", d) and luhn(d.split()[-1]) == 0 or luhn(d.split()[-1]) % 10 == 0


def test_secrets_are_refilled_whole(spark):
    digits = {one(spark, f"password={d}11122223333{d}")[0].split("=")[1] for d in "45"}
    assert all(re.fullmatch(r"\d{13}", x) for x in digits)
    many = one(spark, *[f"secret: 4{i:012d}" for i in range(60)])
    assert len({t.split()[1][0] for t in many}) > 3  # the first digit isn't kept


def test_every_address_of_a_network(spark):
    """All 65,536 addresses of a private network stay in it, distinct, and none keeps its own; the loop has nothing to do."""
    ids = spark.range(65536).select("id", F.concat(F.lit("192.168."), (F.col("id") / 256).cast("int").cast("string"), F.lit("."), (F.col("id") % 256).cast("string")).alias("a"))
    new = ids.select("a", P.surrogate(KEY, F.lit("ip"), F.col("a"), F.lit(0)).alias("b")).collect()
    assert len({r.b for r in new}) == 65536 and all(r.b.startswith("192.168.") and r.a != r.b for r in new)
    df = spark.createDataFrame([(0, "host 192.168.0.1"), (1, "8.8.8.8")], "doc_id long, text string")
    assert P.exceptions(P.entities(df), KEY).count() == 0
    public = spark.range(224).select(F.concat_ws(".", F.col("id").cast("string"), F.lit("1.2.3")).alias("a")).select("a", P.surrogate(KEY, F.lit("ip"), F.col("a"), F.lit(0)).alias("b")).collect()
    import ipaddress

    assert len({r.b for r in public}) == 224 and all(ipaddress.ip_address(r.a).is_private == ipaddress.ip_address(r.b).is_private and r.a != r.b for r in public)


def test_keyed_hash_is_hmac(spark):
    import hashlib
    import hmac

    for key in ("short", "k" * 200):
        got = spark.range(1).select(P._keyed(key, F.lit("ip"), F.lit("x")).alias("h")).first().h
        assert got == hmac.new(key.encode(), b"ip\x1fx", hashlib.sha512).hexdigest()
    assert len(P.session_key(spark)) == 64 and P.session_key(spark) == P.session_key(spark)
