"""MinHash near-duplicate detection with sequential Bayesian verification.

Method: documents are sets of word shingles. Equal sets collapse to one representative. MinHash
bands of the representatives give buckets; each bucket's most popular member (the one that meets
most others over all bands) is compared with the bucket's other members. A comparison reads the
two signatures batch by batch and stops as soon as the posterior probability (uniform prior) of a
similarity at or above the threshold falls to ``MISS``; pairs that survive all batches are
verified exactly on the whole sets, and only verified pairs are links. Where members of a bucket
are then still in different components, the stragglers are compared with all members of their
candidate cluster in blocks, by the same verification inside the block, so that pairs never
become rows and no link between different texts is lost. Components of the links are the groups.

With 24 bands of 5 rows a pair at similarity 0.85 misses all bands with a probability of 8e-7.

Edge cases: documents without words (null, empty or white space) link with nothing; fewer than
five words form one shingle; rows that repeat a doc_id are one document; a row without doc_id
links with nothing and has no component; repeated texts share a component; an empty table gives
no row; extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components
from . import shingles as S

THRESHOLD_PERCENT = 85
BATCH, MISS = 32, 1e-6
BLOCK = 256
OWNER = "near_dedup"
#: Tables that only ``groups`` itself reads; they go when it returns.
WORK = "near_dedup-work"


def least_matches(percent: int = THRESHOLD_PERCENT, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, least matches to go on) for each batch.

    With a uniform prior, P(similarity >= t | m of n match) is the probability of at most m
    successes in n + 1 trials at rate t.
    """
    t, out = percent / 100, []
    for n in range(BATCH, S.HASHES + 1, BATCH):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total > miss:
                break
        out.append((n, m))
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key (a hash of the whole set; null when empty) and the band keys."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        shingle = S.Shingler()
        for batch in batches:
            n, key, band = [], [], []
            for t in batch.column(1):
                s = shingle(t.as_py())
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                band.append(S.bands(S.signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(band, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "key", "bands"])

    return common.pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_shingles long, key binary, bands array<long>")


def records(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rid, sig, set (packed) of the documents ``wanted`` (rid)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingle = S.Shingler()
        for batch in batches:
            sets = [shingle(t.as_py()) for t in batch.column(1)]
            ids = [i for i, s in zip(batch.column(0).to_pylist(), sets) if len(s)]
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([S.signature(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rid", "sig", "set"])

    texts = common.pick(docs, doc_id="long", text="string")
    return texts.join(common.checked_broadcast(wanted.select(F.col("rid").alias("doc_id"))), "doc_id").select("doc_id", "text").mapInArrow(run, "rid long, sig binary, set binary")


def _linked(a, b, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = S.overlap(a, b)
    return 100 * both >= percent * (small + large - both)


def verify(pairs: DataFrame, recs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links; b may be a hub. Signatures are compared first, and only what they leave meets its whole sets."""
    steps = least_matches(percent)

    def with_(rows: DataFrame, field: str) -> DataFrame:
        for side in ("a", "b"):
            rows = rows.join(recs.select(F.col("rid").alias(side), F.col(field).alias(f"{field}_{side}")), side)
        return rows.select("a", "b", f"{field}_a", f"{field}_b")

    def alike(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            at = {n: i for i, n in enumerate(batch.schema.names)}
            sig = [np.frombuffer(b"".join(batch.column(at[c]).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, S.HASHES) for c in ("sig_a", "sig_b")]
            alive, matches, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64), 0
            for n, least in steps:
                matches = matches + (sig[0][alive, done:n] == sig[1][alive, done:n]).sum(axis=1)
                alive, matches, done = alive[matches >= least], matches[matches >= least], n
            yield pa.RecordBatch.from_arrays([batch.column(at[c]).take(pa.array(alive, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    def linked(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            kept = [i for i in range(batch.num_rows) if _linked(*(np.frombuffer(batch.column(c)[i].as_py(), dtype=np.uint64) for c in (2, 3)), percent)]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept, pa.int64())) for c in (0, 1)], names=["u", "v"])

    left = common.materialize(with_(pairs, "sig").mapInArrow(alike, "a long, b long"), WORK)
    return with_(left, "set").mapInArrow(linked, "u long, v long")


def compare_blocks(members: DataFrame, recs: DataFrame, percent: int) -> DataFrame:
    """Links between members of different labels in the same candidate cluster.

    members: cluster, rid, label, straggler. Every straggler is compared with all members of its
    cluster; BLOCK rows of each side meet in one task, and only links leave it.
    """
    steps = least_matches(percent)
    ranked = common.class_rank(members, ["cluster", "straggler"], ["rid", "label"], members.count(), salts=16)
    blocked = common.materialize(ranked.select("cluster", "rid", "label", F.when(F.col("straggler"), F.floor(F.col("rank") / BLOCK)).otherwise(-1 - F.floor(F.col("rank") / BLOCK)).alias("block")), WORK)
    names = blocked.select("cluster", "block").distinct()
    i, j = names.select("cluster", F.col("block").alias("i")), names.select("cluster", F.col("block").alias("j"))
    meets = i.where("i >= 0").join(j, "cluster").where("j < 0 or j >= i").select("cluster", "i", "j")
    near = meets.join(blocked.withColumnRenamed("block", "i"), ["cluster", "i"]).select("cluster", "i", "j", F.lit(0).alias("side"), "rid", "label")
    far = meets.where("i <> j").join(blocked.withColumnRenamed("block", "j"), ["cluster", "j"]).select("cluster", "i", "j", F.lit(1).alias("side"), "rid", "label")
    rows = near.unionByName(far).join(recs, "rid")

    def run(pdf):
        import numpy as np
        import pandas as pd

        sides = [pdf[pdf["side"] == s] for s in (0, 1)]
        if not len(sides[1]):
            sides[1] = sides[0]
        sig = [np.frombuffer(b"".join(x["sig"]), dtype=np.uint32).reshape(len(x), S.HASHES) for x in sides]
        labels = [x["label"].to_numpy() for x in sides]
        sizes = [np.array([len(s) // 8 for s in x["set"]]) for x in sides]
        rids = [x["rid"].to_numpy() for x in sides]
        n, least = steps[0]
        matches = np.zeros((len(sides[0]), len(sides[1])), dtype=np.int16)
        for k in range(n):
            matches += sig[0][:, k][:, None] == sig[1][:, k][None, :]
        small, large = np.minimum.outer(sizes[0], sizes[1]), np.maximum.outer(sizes[0], sizes[1])
        a, b = np.nonzero((matches >= least) & (labels[0][:, None] != labels[1][None, :]) & (100 * small >= percent * large))
        matches, done = matches[a, b].astype(np.int64), n
        for n, least in steps[1:]:
            matches = matches + (sig[0][a, done:n] == sig[1][b, done:n]).sum(axis=1)
            ok = matches >= least
            a, b, matches, done = a[ok], b[ok], matches[ok], n
        parent: dict = {}

        def find(x):
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = p
            return x

        out, sets = [], [x["set"].to_numpy() for x in sides]
        for k in np.argsort(-matches, kind="stable"):
            x, y = int(a[k]), int(b[k])
            p, q = find(labels[0][x]), find(labels[1][y])
            if p != q and _linked(np.frombuffer(sets[0][x], dtype=np.uint64), np.frombuffer(sets[1][y], dtype=np.uint64), percent):
                parent[max(p, q)] = min(p, q)
                out.append((int(rids[0][x]), int(rids[1][y])))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return rows.groupBy("cluster", "i", "j").applyInPandas(run, "u long, v long")


def _several(usable: DataFrame, keys: DataFrame) -> DataFrame:
    """Links between the representatives of a doc_id that stands on more than one set."""
    each = usable.groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("doc_id")
    sets = usable.select("doc_id", "key").join(each, "doc_id").join(keys, "key")
    return sets.select(F.col("doc_id").alias("u"), F.col("rid").alias("v"))


def groups(docs: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included) and kept."""
    base = common.materialize(sketch(docs), OWNER)
    usable = base.where("key is not null and doc_id is not null")
    keys = common.materialize(usable.groupBy("key").agg(F.min("doc_id").alias("rid")), OWNER)
    reps = usable.join(keys, "key").where("doc_id = rid").select("rid", F.explode("bands").alias("band"))
    reps = common.materialize(reps, WORK)
    # as a table of its own, so that a hot band's side of the join can be split
    sizes = common.materialize(reps.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), WORK)
    met = common.materialize(reps.join(sizes, "band").select("band", "rid", "n"), WORK)
    popular = met.groupBy("rid").agg(F.sum("n").alias("met"))
    hubs = met.join(popular, "rid").groupBy("band").agg(F.max_by("rid", F.struct("met", -F.col("rid"))).alias("hub"))
    pairs = common.materialize(met.join(hubs, "band").where("rid <> hub").select(F.col("rid").alias("a"), F.col("hub").alias("b")).distinct(), WORK)
    recs = common.materialize(records(docs, common.materialize(popular.select("rid"), WORK)), WORK)
    first = common.materialize(verify(pairs, recs, percent), WORK)
    label = components.components(first, WORK)
    # Buckets of two have had their only pair compared; larger ones may hold links between labels.
    labelled = met.where("n > 2").join(label.select(F.col("u").alias("rid"), F.col("v").alias("l")), "rid", "left").select("band", "rid", F.coalesce("l", "rid").alias("label"))
    mixed = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("rid").alias("low")).where("lo <> hi")
    open_ = common.materialize(labelled.join(mixed, "band").select("rid", "label", "low"), WORK)
    cluster = components.components(open_.select(F.col("rid").alias("u"), F.col("low").alias("v")), WORK)
    members = open_.select("rid", "label").distinct().join(cluster.select(F.col("u").alias("rid"), F.col("v").alias("c")), "rid", "left").select("rid", "label", F.coalesce("c", "rid").alias("cluster"))
    members = common.materialize(members, WORK)
    main = members.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("cluster").agg(F.max_by("label", F.struct("m", -F.col("label"))).alias("main"))
    second = compare_blocks(members.join(main, "cluster").select("cluster", "rid", "label", (F.col("label") != F.col("main")).alias("straggler")), recs, percent)
    # A doc_id that stands on several texts is one document: its sets are linked.
    links = first.unionByName(second).unionByName(_several(usable, keys))
    final = components.components(common.materialize(links, WORK), OWNER)
    common.drop(WORK, docs.sparkSession)
    at = keys.join(final.select(F.col("u").alias("rid"), F.col("v").alias("c")), "rid", "left").select("key", F.coalesce("c", "rid").alias("c"))
    out = base.join(at, "key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def unique(docs: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The rows of docs of which one stays for each group (all columns); repeated rows of one doc_id count as one."""
    found = common.materialize(groups(docs, percent), OWNER)
    gone = common.materialize(found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), OWNER)
    again = common.materialize(found.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("_again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_again"), OWNER)
    kept = docs.join(common.checked_broadcast(gone), docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
    if not again.limit(1).count():
        return kept
    id_ = kept["doc_id"].cast("long")
    return kept.join(again, id_ == again["_again"], "left_anti").unionByName(kept.join(again, id_ == again["_again"], "left_semi").dropDuplicates(["doc_id"]))
