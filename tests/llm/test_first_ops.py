"""Quality rules, sharding, language ID, decontamination and packing against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from paperloom.llm import best_fit_packing, decontamination, language_id, quality_rules, queries, sharding, tokens

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_features(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if n[tuple(w[i : i + 5])] > 1:
            hit |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", " ".join(w))), dup, len(hit)


def test_quality_features(spark, documents, odd):
    for df in (documents, odd):
        texts = sorted(((r.doc_id if r.doc_id is not None else -1), brute_features(r.text)) for r in df.collect())
        got = quality_rules.features(df).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == texts


def test_binomial_bound():
    # 0 of n within 1 % at 95 %: needs n >= ln 0.05 / ln 0.99 = 298.07
    assert not quality_rules.upper_bound_within(0, 298, 0.01, 0.05)
    assert quality_rules.upper_bound_within(0, 299, 0.01, 0.05)
    from math import comb

    for k, n, p in ((3, 700, 0.01), (7, 900, 0.02), (1, 60, 0.1)):
        tail = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality_rules.upper_bound_within(k, n, p, tail * 1.001)
        assert not quality_rules.upper_bound_within(k, n, p, tail * 0.999)


def test_cutoffs_hold_false_rejection(spark):
    rows = [(i, "en" if i % 2 else "fr", 100, 500, (i * 37 % 11) + (300 if i % 10 == 0 else 0), 5, 0, 0) for i in range(40_000)]
    feats = spark.createDataFrame(rows, quality_rules._FEATURES)
    labels = spark.createDataFrame([(i, 0 if i % 10 == 0 else 1) for i in range(40_000)], "doc_id long, quality int")
    cuts = quality_rules.cutoffs(feats, labels).collect()
    assert {c.rule for c in cuts} == {"symbols"}
    for c in cuts:
        assert c.n_false <= c.n_good * quality_rules.ALPHA / len(quality_rules.RULES) and c.n_true > 0


def test_quality_query(spark, sf, odd, nothing):
    out = queries.op1_quality_rules(spark, sf).collect()
    assert len(out) == 200
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    labels = spark.createDataFrame([(None, 1), (1, None), (4, 0)], "doc_id long, quality int")
    assert quality_rules.judge(odd, labels).count() == odd.count()
    assert quality_rules.judge(nothing, labels.limit(0)).count() == 0


def check_shards(rows, texts, shards):
    where, slots, size = {}, defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        assert where.setdefault(texts[r.doc_id], r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return size


def test_sharding(spark, documents, odd, nothing):
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = sharding.shard(documents, 10).collect()
    size = check_shards(rows, texts, 10)
    assert len(rows) == len(texts) and len(size) == 10
    assert max(size.values()) - min(size.values()) <= max(r.size for r in rows)
    for r in rows:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 16, zlib.crc32(texts[r.doc_id].encode()))
    fixed = sharding.shard(documents, None, capacity=50_000).collect()
    size = check_shards(fixed, texts, None)
    assert all(v <= 50_000 for v in size.values()) or max(r.size for r in fixed) > 50_000
    assert sharding.shard(odd, 4).count() == odd.count()
    assert sharding.shard(nothing, 4).count() == 0


def test_even_sizes_with_a_giant():
    runs = sharding.even_sizes([(1_000_000, 1), (10, 3000), (7, 100)], 5)
    got, seen = Counter(), Counter()
    for s, a, b, k in runs:
        got[k] += s * (b - a)
        seen[s] += b - a
    assert seen == {1_000_000: 1, 10: 3000, 7: 100} and len(got) == 5
    rest = sorted(got.values())[:4]
    assert rest[-1] - rest[0] <= 20


def test_tightest_tree():
    import random

    rng, tree, plain = random.Random(4), sharding.Tightest(node=8), []
    for i in range(3000):
        if rng.random() < 0.6:
            x = (rng.randrange(500), i)
            tree.add(*x)
            plain.append(x)
        else:
            size = rng.randrange(500)
            best = min((x for x in plain if x[0] >= size), default=None)
            got = tree.take(size)
            assert got == best
            if best:
                plain.remove(best)


def test_language_held_out_accuracy(spark, documents, odd, nothing):
    rows = {r.doc_id: r for r in queries.op5_language_id(spark, "/root/testdata/sf0.01").collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [i for i in rows if rows[i].held_out]
    assert sum(rows[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    model = language_id.train(documents)
    got = language_id.identify(odd, model).collect()
    assert len(got) == odd.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if not any(c.isalpha() for c in r.text or ""))
    assert language_id.identify(nothing, language_id.train(nothing)).count() == 0
    signs = spark.createDataFrame([(0, "\u00b2 \u00bd \u2460 123 _"), (1, "\u0301"), (2, "a")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in language_id.identify(signs, model).orderBy("doc_id").collect()] == [True, True, False]
    assert language_id.words_of("\u0939\u093f\u0928\u094d\u0926\u0940 x\u00b2y Stra\u00dfe") == ["\u0939\u093f\u0928\u094d\u0926\u0940", "x", "y", "stra\u00dfe"]


def letters_of(text):
    """Runs of letters and following marks, a character at a time."""
    import unicodedata

    out, now = [], ""
    for c in (text or "").lower():
        if c.isalpha() or (now and unicodedata.category(c) in ("Mn", "Mc")):
            now += c
        else:
            out, now = out + [now] * bool(now), ""
    return out + [now] * bool(now)


def test_language_against_brute_force(spark):
    """Every prediction and score of the query, from a model of plain dictionaries."""
    import math

    L = language_id
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text").collect()
    counts = defaultdict(Counter)
    for r in docs:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and r.text is not None:
            for w in letters_of(r.text):
                counts[r.lang, 0][w] += 1
                for n in L.ORDERS:
                    counts[r.lang, n].update(f" {w} "[i : i + n] for i in range(len(w) + 3 - n))
    langs = sorted({k for k, _ in counts})
    lists = {k: {x: math.log10(c[x] / sum(c.values())) for x in sorted(c, key=lambda x: (-c[x], x))[: L.GRAMS_PER_ORDER if k[1] else L.WORDS_PER_LANGUAGE]} for k, c in counts.items()}

    def word(w):
        if any(w in lists[k, 0] for k in langs):
            return [lists[k, 0].get(w, L.PENALTY) for k in langs]
        for n in L.ORDERS:
            grams = [g for g in (f" {w} "[i : i + n] for i in range(len(w) + 3 - n)) if any(g in lists[k, n] for k in langs)]
            if grams:
                return [sum(lists[k, n].get(g, L.PENALTY) for g in grams) / len(grams) for k in langs]
        return [L.PENALTY] * len(langs)

    memo = {}
    got = {r.doc_id: r for r in queries.op5_language_id(spark, "/root/testdata/sf0.01").collect()}
    for r in docs:
        ws = letters_of(r.text)
        if not ws:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        total = [sum(x) for x in zip(*(memo.get(w) or memo.setdefault(w, word(w)) for w in ws))]
        best = max(range(len(langs)), key=lambda i: (total[i], -i))
        score = 1 / sum(10 ** ((t - total[best]) / len(ws) * min(len(ws), 10)) for t in total)
        ties = [t for t in total if abs(t - total[best]) < 1e-3 * len(ws)]
        assert (got[r.doc_id].lang_pred == langs[best] or len(ties) > 1) and abs(got[r.doc_id].score - score) < 1e-3


def brute_decontamination(docs, items):
    ws = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    wins = defaultdict(set)
    for i, t in items:
        w = ws(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[k : k + 10])].add(str(i))
    lengths = {len(k) for k in wins}
    for d, t in docs:
        w, hit, found = ws(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := wins.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= x
        yield (d if d is not None else -1, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))


def test_decontamination(spark, documents, odd, nothing):
    got = sorted(tuple(r) for r in queries.op6_benchmark_decontamination(spark, "/root/testdata/sf0.01").collect())
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    assert got == sorted(brute_decontamination(docs, items)) and any(r[-1] for r in got)
    short = spark.createDataFrame([(1, "same text"), (2, "Word1 word2 WORD3 word4 word5 word6 word7 word8 word9 word10 word11"), (None, "ünï"), (3, None), (4, "çödé 日本語")], "item_id long, text string")
    back = {(r.doc_id, r.n_hit, r.n_items) for r in decontamination.report(odd, short).collect()}
    assert (6, 2, 1) in back and (8, 2, 1) in back and (1, 0, 0) in back
    assert decontamination.clean(odd, short).columns == odd.columns
    assert decontamination.report(nothing, short).count() == 0
    assert decontamination.report(odd, short.limit(0)).where("contaminated").count() == 0


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))


def brute_near(docs, items, slop, width):
    """(doc, start, item) by trying every place of the rarest term."""
    tf = Counter(w for _, t in docs for w in words_of(t))
    out = set()
    for i, t in items:
        ws = words_of(t)
        for k in range(max(1, len(ws) - width + 1) if ws else 0):
            win = ws[k : k + width]
            a = min(range(len(win)), key=lambda j: (tf[win[j]], j))
            for d, text in docs:
                w = words_of(text)
                for p in (p for p in range(len(w)) if w[p] == win[a]):
                    s = p - a
                    if all(j == a or win[j] in w[max(0, s + j - slop) : max(0, s + j + slop + 1)] for j in range(len(win))) and (slop or s >= 0):
                        out.add((d, s, str(i)))
    return out


def test_phrases_and_proximity(spark):
    import random

    rng = random.Random(3)
    docs = [(d, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60)))) for d in range(60)]
    items = [(i, " ".join(rng.choice("abcdefghz") for _ in range(rng.randrange(0, 8)))) for i in range(25)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for slop, f in ((0, decontamination.phrase_matches), (1, decontamination.proximity_matches)):
        got = f(df, bench, *([slop] if slop else []), width=4).collect()
        assert {(r.doc_id, r.start, i) for r in got for i in r["items"]} == brute_near(docs, items, slop, 4) and len(got) > 50


def test_many_windows(spark):
    """More windows than any broadcast of them would take, by the same path; the plan reads the stored index."""
    long = " ".join(f"w{i}" for i in range(100_500))
    docs = [(0, " ".join(f"w{i}" for i in range(500, 530))), (1, "w3 w4 x"), (2, " ".join(f"W{i}" for i in range(100_490, 100_500)) + " w7"), (3, None)]
    bench = spark.createDataFrame([(1, long), (2, "w7")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontamination.report(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {0: (30, 30, ["1"]), 1: (3, 0, []), 2: (11, 11, ["1", "2"]), 3: (0, 0, [])}


def test_stored_index(spark, documents, tmp_path):
    index = decontamination.build(documents, str(tmp_path / "index"))
    assert index.count() == sum(len(words_of(r.text)) + 1 for r in documents.collect())
    for part in index.select("*", F.spark_partition_id().alias("part")).toPandas().groupby("part"):
        known = part[1].dropna(subset=["term"])
        assert known.sort_values(["term", "row", "pos"], kind="stable").index.equals(known.index)
    again = decontamination.read_index(spark, str(tmp_path / "index"))
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plan = decontamination.matches(again, decontamination.windows(bench))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_packing(spark, documents, odd, nothing):
    from tokenizers import Tokenizer

    path = tokens.default_path()
    tok = Tokenizer.from_file(path)
    for df in (documents, odd):
        rows = best_fit_packing.pack(df).collect()
        want = Counter()
        for d in df.collect():
            ids = [*tok.encode(d.text or "", add_special_tokens=False).ids, 2]
            for p, (s, n) in enumerate(best_fit_packing.bounds(len(ids), 1024)):
                part = b"".join(i.to_bytes(4, "little") for i in ids[s : s + n])
                want[(d.doc_id, p, s, n, zlib.crc32(part))] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        by = defaultdict(list)
        for r in rows:
            by[r.sequence_id].append((r.offset, r.length))
        for parts in by.values():
            end = 0
            for o, n in sorted(parts):
                assert o == end
                end += n
            assert end <= 1024
        total = sum(r.length for r in rows)
        assert len(by) <= -(-total // 1024) * 1.02 + 1
    assert best_fit_packing.pack(nothing).count() == 0
    made = best_fit_packing.sequences(best_fit_packing.pack(documents, with_ids=True)).collect()
    assert sum(len(r.ids) for r in made) == sum(r.length for r in best_fit_packing.pack(documents).collect())
    assert best_fit_packing.bounds(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]


def test_quality_cutoffs_of_three_strata(spark, duck_of):
    """With labels enough for each stratum, cutoffs, broken rules and verdicts are those of the SQL."""
    import random

    rng = random.Random(6)
    rows, labels = [], []
    for s, lang in enumerate(("en", "fr", None)):
        for i in range(1500):
            bad = i % 9 == 0
            words = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 8 + s))) for _ in range(rng.randrange(12, 20))]
            if bad or rng.random() < 0.002:
                words = [w + rng.choice(["#", "##", "|$", "q" * 30, "x" * 60]) * rng.randrange(1, 4) for w in words]
            rows.append((2000 * s + i, " ".join(words) + ("\nsame line" * 4 if bad and i % 2 else ""), lang))
            if i % 20:
                labels.append((2000 * s + i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labs = spark.createDataFrame(labels, "doc_id long, quality int")
    cuts = quality_rules.cutoffs(quality_rules.features(docs), labs).collect()
    assert {c.stratum for c in cuts} == {"en", "fr", ""} and len(cuts) >= 4
    got = {r.doc_id: (r.kept, ",".join(r.failed_rules), r.stratum) for r in quality_rules.judge(docs, labs).collect()}
    want = duck_of(documents=docs, labels=labs).sql(queries.oracle_sql()["op1_quality_rules"])
    at = {c: i for i, c in enumerate(want.columns)}
    assert got == {r[at["doc_id"]]: (r[at["kept"]], r[at["failed_rules"]], r[at["stratum"]]) for r in want.fetchall()}
    assert sum(bool(f) for _, f, _ in got.values()) > 200


def test_false_rejection_is_held(spark):
    """Over many draws of labels, hardly ever a cutoff whose true false rejection is above its share."""
    import random

    rng = random.Random(7)
    share, level, broken, used = 0.02, 0.05, 0, 0
    for _ in range(300):
        # good documents reach a value v or more with probability 0.97 ** v
        by = defaultdict(lambda: [0, 0])
        for i in range(700):
            v = 0
            while rng.random() < 0.97 and v < quality_rules.BINS:
                v += 1
            by[v][0] += 1
        for _ in range(200):
            by[rng.randrange(60, 300)][1] += 1
        best = quality_rules.best_cutoff({k: tuple(x) for k, x in by.items()}, share, level)
        used += best is not None
        broken += best is not None and 0.97 ** best[0] > share
    # at most 300 * level are expected; the bound leaves three standard errors
    assert used > 200 and broken <= 300 * level + 3 * (300 * level * (1 - level)) ** 0.5
