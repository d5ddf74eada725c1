"""Near-duplicate groups against all pairs by brute force."""

from collections import defaultdict

from paperloom.llm import components, near_dedup, queries

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=85):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared = defaultdict(lambda: defaultdict(int))
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            for j in by[x]:
                shared[i][j] += 1
            by[x].append(i)
    for i, found in shared.items():
        for j, n in found.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    got = queries.op9_minhash_near_dedup(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert sum(not r.kept for r in got) > 50


def test_blurred_family(spark):
    """A family around the threshold, where links form chains and most pairs of a bucket are not links."""
    import random

    rng = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 4, 6, 8))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.groups(df).collect()}
    want = brute(rows)
    assert got == want and 1 < len({c for _, c in want.values()}) < 160


def test_odd_rows(spark, odd, nothing):
    got = near_dedup.groups(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[5].component_id == 4 and by[6].component_id == 6 and by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0
    assert by[None].component_id is None and by[None].n_shingles == 7 and by[None].kept
    kept = near_dedup.unique(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert near_dedup.groups(nothing).count() == 0 and near_dedup.unique(nothing).count() == 0
    two = spark.createDataFrame([(1, "a b c d e f"), (2, "p q r s t u"), (3, "a b c d e f"), (3, "p q r s t u")], "doc_id long, text string")
    assert {r.component_id for r in near_dedup.groups(two).collect()} == {1}


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102)], "u long, v long")
    got = {r.u: r.v for r in components.components(edges, "test").collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 102: 100}


def test_least_matches():
    steps = near_dedup.least_matches()
    assert [n for n, _ in steps] == [32, 64, 96, 128] and all(0.4 * n < m < 0.85 * n for n, m in steps)
