"""Removal of repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np

from paperloom.llm import queries
from paperloom.llm import suffix_dedup as S


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if n[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        yield len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def same(df, length=S.LENGTH, **more):
    rows = df.select("doc_id", "text").collect()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, brute([r.text for r in rows], length)))
    got = S.repeated(df, length, **more).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    return want


def test_query(spark, sf, documents):
    rows = documents.collect()
    want = {(r.doc_id, *w) for r, w in zip(rows, brute([r.text for r in rows], 200))}
    got = {tuple(r) for r in queries.op7_suffix_array_dedup(spark, sf).collect()}
    assert got == want and sum(r[2] > 0 for r in got) > 10


def test_small_alphabet(spark):
    """Overlaps, repeats inside a document, runs of one byte and texts around the length."""
    rng = random.Random(5)
    base = ["".join(rng.choices("abé", k=rng.randrange(20, 400))) for _ in range(40)]
    texts = list(base)
    for _ in range(60):
        a, b = rng.choice(base), rng.choice(base)
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        texts.append(a[i : i + rng.randrange(150)] + b[j : j + rng.randrange(150)])
    texts += ["z" * 500, "z" * 40, "z" * 41, "xy" * 100, "", None, base[0], base[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same(df, 40, core=8)
    old, S.LARGE = S.LARGE, 1
    try:
        same(df, 40, core=8)
    finally:
        S.LARGE = old


def test_odd_rows(spark, odd, nothing):
    want = same(odd)
    assert any(k[0] == 4 and k[2] == k[1] for k in want)
    assert S.repeated(nothing).count() == 0


def test_family_merges_sorted_levels(spark):
    """Segments that come in batches: marks as all pairs give them, levels like a binary counter, and one sort a segment."""
    rng = random.Random(8)
    segs = {i: ("".join(rng.choices("ab", k=rng.randrange(8, 30)))).encode() for i in range(70)}
    family, found = S.Family(spark, None, 8), []
    for i in range(7):
        rows = [(k % 3, k.to_bytes(2, "big"), s) for k, s in segs.items() if k % 7 == i]
        found += family.add(spark.createDataFrame(rows, "core long, sid binary, seg binary")).collect()
        assert [x[0] for x in family.levels] == {0: [1], 1: [1, 1], 2: [2, 1], 3: [2, 1, 1], 4: [4, 1], 5: [4, 1, 1], 6: [4, 2, 1]}[i]
    n = Counter((k % 3, s[i : i + 8]) for k, s in segs.items() for i in range(len(s) - 7))
    want = {(k, i) for k, s in segs.items() for i in range(len(s) - 7) if n[k % 3, s[i : i + 8]] > 1}
    got = {(int.from_bytes(r.sid, "big"), i) for r in found for i in range(r.lo, r.hi)}
    assert got == want
    for _, _, level in family.levels:
        for r in level.collect():
            of, at = (np.frombuffer(x, dtype="<i4") for x in (r.of, r["at"]))
            strings = [r.segs[k][i : i + 8] for k, i in zip(of, at)]
            assert strings == sorted(strings) and len(strings) == sum(len(s) - 7 for s in r.segs)


def test_corpus_batch_by_batch(spark, tmp_path):
    """After each batch the report equals brute force over all documents so far; a reopened corpus goes on."""
    rng = random.Random(11)
    base = ["".join(rng.choices("abé", k=rng.randrange(20, 200))) for _ in range(12)]
    path, seen = str(tmp_path / "corpus"), []
    for b in range(4):
        texts = [x[rng.randrange(30) :] + y[: rng.randrange(120)] for x, y in (rng.sample(base, 2) for _ in range(6))] + [base[b], None, "q" * 60]
        rows = [(100 * b + i, t) for i, t in enumerate(texts)]
        seen += rows
        corpus = S.Corpus(spark, path, 40, 8)
        corpus.add(spark.createDataFrame(rows, "doc_id long, text string"))
        want = Counter((d, *w) for (d, _), w in zip(seen, brute([t for _, t in seen], 40)))
        got = corpus.report().collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want, b
    assert [x[0] for x in S.Corpus(spark, path, 40, 8).family.levels] == [2, 1, 1]
