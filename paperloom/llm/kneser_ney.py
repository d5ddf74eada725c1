"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams.

Method: the trusted texts (documents labelled of good quality and not toxic) give counts of
n-grams of ``ORDER`` characters; lower orders use continuation counts. Counts are sharded by
n-gram; context totals, discounts (D1, D2, D3+ from the counts of counts, per order) and the
interpolated probabilities come from joins of those shards on context and on suffix. The model
has every n-gram of the trusted texts, over all characters of the corpus.

A text's log-probability is a sum over its n-grams. With g(h) the logarithm of the weight that a
context h leaves to the lower order, and 0 for an n-gram or context that wasn't seen,
``log p(c | a b) = log u + w(c) + g(b) + w(b c) + g(a b) + w(a b c)`` (and so on for longer contexts)
where u is the probability of an unseen character, ``w(c) = log p(c) - log u``,
``w(b c) = log p(c | b) - g(b) - log p(c)``, and ``w(a b c)`` likewise. So one table of weights by n-gram
holds the model, and a document's score is a join of its own n-gram counts with that table,
summed by document. Weights are whole micro-nats, so that sums don't depend on their order.

The join has two parts with the same meaning. The most frequent n-grams, at most ``HOT`` of them, are
the join's hot keys: they are broadcast and added up where the text is read. All others are joined
by a shuffle on the n-gram; a Bloom filter of them, of at most ``FILTER_BITS``, spares n-grams the
shuffle that no model has.

A document's perplexity is that of its whole text; it is kept if its mean negative log-probability
is at most its language's threshold, the ``QUANTILE`` of the trusted documents' own ones in that
language (in all languages together where the language has no trusted document). Texts fall in
two folds by a hash, and every document, trusted or not, is scored by the model of the trusted texts
of the other fold. No trusted document is scored by a model that saw it, and trusted documents and
others are scored alike, so a quantile of the ones holds for the others.

Symbols: white space runs are one symbol, digits another; every other character of the corpus has
one of its own, and so have a text's start and end. An n-gram is a long: ``ORDER`` symbols of up to
``MOST_BITS`` bits, its order, and the model's number as the sign. With over ``DIRECT`` characters, the
rarer ones are written as two symbols each, as in UTF-16.

Edge cases: null text, or text without a character other than white space, has no perplexity
and isn't kept; a null language is ``und``; a doc_id labelled more than once is trusted if no
label speaks against it; with no trusted text every symbol is equally likely and nothing is
rejected; repeated rows count repeatedly; an empty table gives no row; extra columns are ignored;
texts are read whole, ``CHUNK`` characters at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

ORDER = 5
SPACE, DIGIT, OTHER, START, END, FIRST = range(6)
MOST_BITS, LEADS, TRAILS = 12, 1088, 1024
DIRECT = (1 << MOST_BITS) - FIRST - LEADS - TRAILS
#: N-grams of the model that are broadcast (16 bytes each).
HOT = 1_000_000
#: The Bloom filter has about 16 bits for each other n-gram, but no more than this (64 MB).
FILTER_BITS = 1 << 29
LEAST_FILTER_BITS = 1 << 20
#: Characters that are looked up at once.
CHUNK = 1 << 19
UNIT = 1_000_000
QUANTILE = 0.995
#: Log-perplexities are counted in steps of 1 / SCALE up to TOP for the quantiles.
SCALE, TOP = 1000, 20
OWNER = "kneser_ney"
#: Tables that only ``classify`` itself reads; they go when it returns.
WORK = "kneser_ney-work"
_TAG = 60


def alphabet(docs: DataFrame) -> list[str]:
    """The characters with a symbol of their own, most frequent first: all but white space and digits."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros(0x110000, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                t = x.as_py() or ""
                for a in range(0, len(t), CHUNK):
                    n = np.bincount(np.frombuffer(t[a : a + CHUNK].encode("utf-32-le"), dtype=np.uint32))
                    total[: len(n)] += n
        (found,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["code", "n"])

    counts = common.pick(docs, text="string").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    # at most as many rows as Unicode has code points
    rows = sorted(counts.collect(), key=lambda r: (-r["n"], r["code"]))
    return [c for c in (chr(r["code"]) for r in rows) if not c.isspace() and not c.isdigit()]


def width(letters: list[str]) -> tuple[int, int]:
    """(bits of a symbol, number of symbols) of an alphabet."""
    size = FIRST + len(letters) if len(letters) <= DIRECT else 1 << MOST_BITS
    return max(3, (size - 1).bit_length()), size


class Coder:
    """Texts -> symbols and n-gram keys, by numpy."""

    def __init__(self, letters: list[str]) -> None:
        import numpy as np

        self.of = np.full(0x110000, OTHER, dtype=np.int32)
        for c in range(0x20000):  # all digits and white space of Unicode
            if chr(c).isspace():
                self.of[c] = SPACE
            elif chr(c).isdigit():
                self.of[c] = DIGIT
        self.bits, _ = width(letters)
        direct = len(letters) if len(letters) <= DIRECT else DIRECT
        for i, c in enumerate(letters[:direct]):
            self.of[ord(c)] = FIRST + i
        self.trail = np.full(0x110000, -1, dtype=np.int32) if len(letters) > direct else None
        for i, c in enumerate(letters[direct:]):
            self.of[ord(c)] = FIRST + DIRECT + i // TRAILS
            self.trail[ord(c)] = FIRST + DIRECT + LEADS + i % TRAILS

    def pieces(self, text: str | None) -> Iterator:
        """Arrays of symbols: ORDER - 1 of context, then some of the text; the first begins with a start and the last is an end."""
        import numpy as np

        before, said, space_before = np.full(ORDER - 1, START, dtype=np.int64), False, True
        for a in range(0, len(text or ""), CHUNK):
            codes = np.frombuffer(text[a : a + CHUNK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            s = self.of[codes]
            if self.trail is not None:
                both = np.stack([s, self.trail[codes]], axis=1).reshape(-1)
                s = both[both >= 0]
            space = s == SPACE
            s = s[~space | ~np.concatenate([[space_before], space[:-1]])].astype(np.int64)
            space_before = bool(space[-1])
            if len(s):
                piece = np.concatenate([before, *([] if said else [[START]]), s])
                said, before = True, piece[1 - ORDER :]
                yield piece
        if said:
            yield np.concatenate([before, [END]])

    def flat(self, held: list) -> tuple:
        """(row, key of the ORDER symbols that end there) of every place of many pieces; held: (row, piece)."""
        import numpy as np

        h = np.concatenate([p for _, p in held])
        size = np.array([len(p) for _, p in held])
        inside = np.ones(len(h), dtype=bool)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        for i in range(ORDER - 1):
            inside[begin + i] = False
        key = np.zeros(len(h) - ORDER + 1, dtype=np.int64)
        for i in range(ORDER):
            key = (key << self.bits) | h[i : i + len(key)]
        return np.repeat(np.array([r for r, _ in held]), size)[inside], key[inside[ORDER - 1 :]]


def fold() -> Column:
    """0 or 1 by the text, so that copies of a text share a fold."""
    return F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")


def counts(texts: DataFrame, letters: list[str]) -> DataFrame:
    """fold, key and n of the n-grams of the highest order, over all rows of ``texts`` (fold, text)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        coder = Coder(letters)

        def out(held: list) -> pa.RecordBatch:
            of, key = coder.flat(held)
            real = key & ((1 << coder.bits) - 1) != START
            both, n = np.unique(key[real] | of[real] << 63, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((both < 0).astype("int32")), pa.array(both & (1 << 63) - 1), pa.array(n)], names=["fold", "key", "n"])

        for batch in batches:
            held, size = [], 0
            for f, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                for p in coder.pieces(t.as_py()):
                    held.append((f, p))
                    size += len(p)
                    if size >= CHUNK:
                        yield out(held)
                        held, size = [], 0
            if held:
                yield out(held)

    found = texts.select("fold", "text").mapInArrow(run, "fold int, key long, n long")
    return found.groupBy("fold", "key").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the counts of counts; 0.5, 0.75 and 0.9 where those leave them undefined."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(d if 0 < d <= k else f for d, k, f in zip(found, (1, 2, 3), (0.5, 0.75, 0.9)))


def _discounted(level: DataFrame, seen: dict[int, tuple[float, float, float]]) -> DataFrame:
    """Adds d, the discount of each n-gram by its model m and count n."""
    d = F.lit(0.0)
    for m, (one, two, more) in seen.items():
        d = F.when(F.col("m") == m, F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)).otherwise(d)
    return level.withColumn("d", d)


def weights(tops: DataFrame, bits: int, size: int) -> tuple[DataFrame, dict[int, float]]:
    """(key, w, n) of every n-gram and context of the folds' models, and each model's log-probability of an unseen symbol."""
    low = lambda c, n: c.bitwiseAND((1 << bits * n) - 1)
    levels, now = {ORDER: tops.withColumnRenamed("fold", "m")}, tops.withColumnRenamed("fold", "m")
    for n in range(ORDER - 1, 0, -1):
        now = common.materialize(now.groupBy("m", low(F.col("key"), n).alias("key")).agg(F.count(F.lit(1)).alias("n")), WORK)
        levels[n] = now
    unknown: dict[int, float] = {}
    lower, parts = None, []
    tagged = lambda key, n: F.lit(n << _TAG).bitwiseOR(key)
    for n in range(1, ORDER + 1):
        ones = [F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]
        seen = {r["m"]: discounts(r["n1"], r["n2"], r["n3"], r["n4"]) for r in levels[n].groupBy("m").agg(*ones).collect()}  # a row for each model
        each = _discounted(levels[n], seen).withColumn("ctx", F.shiftright("key", bits))
        context = common.materialize(each.groupBy("m", "ctx").agg(F.log(F.sum("d") / F.sum("n")).alias("g"), F.sum("n").alias("total")), WORK)
        joined = each.join(context, ["m", "ctx"])
        if lower is None:
            unknown = {r["m"]: r["g"] - math.log(size) for r in context.collect()}  # the empty context of each model
            joined = joined.withColumn("q", F.lit(-math.log(size)))
        else:
            parts.append(context.select("m", tagged(F.col("ctx"), n - 1).alias("key"), F.col("g").alias("w"), F.col("total").alias("n")))
            joined = joined.withColumn("suffix", low(F.col("key"), n - 1)).join(lower.select("m", F.col("key").alias("suffix"), F.col("p").alias("q")), ["m", "suffix"])
        p = F.log((F.col("n") - F.col("d")) / F.col("total") + F.exp(F.col("g") + F.col("q")))
        lower = common.materialize(joined.select("m", "key", "n", p.alias("p"), (p - F.col("g") - F.col("q")).alias("w")), WORK)
        parts.append(lower.select("m", tagged(F.col("key"), n).alias("key"), "w", "n"))
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    signed = F.when(F.col("m") == 1, F.col("key").bitwiseOR(-(1 << 63))).otherwise(F.col("key"))
    every = every.select(signed.alias("key"), F.round(F.col("w") * UNIT).cast("long").alias("w"), F.col("n").cast("long").alias("n"))
    # an n-gram is an entry of its own order and a context of the next: its weights add up
    return common.materialize(every.groupBy("key").agg(F.sum("w").alias("w"), F.max("n").alias("n")), WORK), unknown


def _size_class() -> Column:
    return F.floor(F.log2("n") * 8).cast("int")


def split_hot(model: DataFrame, hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The most frequent n-grams of the model, at most ``hot``, and all others."""
    hot = HOT if hot is None else hot
    sizes = model.groupBy(_size_class().alias("s")).agg(F.count(F.lit(1)).alias("c")).collect()  # at most 8 * 63 rows
    cut, total = 1 << 30, 0
    for r in sorted(sizes, key=lambda r: -r["s"]):
        total += r["c"]
        if total > hot:
            break
        cut = r["s"]
    return model.where(_size_class() >= cut).select("key", "w"), model.where(_size_class() < cut).select("key", "w")


def filter_bits(cold: DataFrame) -> tuple:
    """(bits of the filter, its words as an array of 64-bit integers)."""
    import numpy as np

    bits, n = LEAST_FILTER_BITS, cold.count()
    while bits < min(16 * n, FILTER_BITS):
        bits *= 2
    h = F.xxhash64("key")
    places = F.explode(F.array(h.bitwiseAND(bits - 1), F.shiftrightunsigned(h, 32).bitwiseAND(bits - 1))).alias("at")
    words_ = cold.select(places).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("x"))
    out = np.zeros(bits // 64, dtype=np.int64)
    found = words_.toArrow()  # at most FILTER_BITS / 64 rows
    out[found["word"].to_numpy()] = found["x"].to_numpy()
    return bits, out.view(np.uint64)


def _hashed(key):
    """Spark's xxhash64 of longs, by numpy."""
    import numpy as np

    u, turned = np.uint64, lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    one, two, three, four, five = map(u, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        h = (u(42) + five + u(8)) ^ (turned(key.view(np.uint64) * two, 31) * one)
        h = turned(h, 27) * one + four
        h = (h ^ (h >> u(33))) * two
        h = (h ^ (h >> u(29))) * three
    return h ^ (h >> u(32))


_SCORED = "doc_id long, lang string, m int, n long, hot long, keys array<long>, counts array<int>"


def score(rows: DataFrame, letters: list[str], model: DataFrame, unknown: dict[int, float], hot: int | None = None) -> DataFrame:
    """doc_id, lang, m, n (symbols) and nll (mean negative log-probability of a symbol, the end included; null without a symbol).

    rows: doc_id, lang, m (the model to use) and text.
    """
    import numpy as np

    most, cold = split_hot(model, hot)
    cold = common.materialize(cold, WORK)
    table = most.toArrow()  # at most HOT rows of two longs
    key, weight = table["key"].to_numpy(), table["w"].to_numpy()
    order = np.argsort(key)
    sent = rows.sparkSession.sparkContext.broadcast((letters, key[order], weight[order], *filter_bits(cold)))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        chars, where, what, bits, bloom = sent.value
        coder, mask, sign = Coder(chars), np.uint64(bits - 1), np.int64(-(1 << 63))

        def maybe(key):
            k = _hashed(key)
            ok = np.ones(len(k), dtype=bool)
            for at in (k & mask, (k >> np.uint64(32)) & mask):
                ok &= (bloom[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
            return ok

        def look(held: list, m, n, total, cold: list) -> None:
            row, key = coder.flat(held)
            seen, at = np.unique(key | m[row] << 63, return_inverse=True)
            weight = np.zeros(len(seen), dtype=np.int64)
            for order in range(1, ORDER + 1):
                gram = (seen & ((1 << coder.bits * order) - 1)) | (order << _TAG) | (seen & sign)
                left = np.ones(len(seen), dtype=bool)
                if len(where):
                    i = np.minimum(np.searchsorted(where, gram), len(where) - 1)
                    left = where[i] != gram
                    weight += np.where(left, 0, what[i])
                left[left] = maybe(gram[left])
                here = np.flatnonzero(left[at])
                cold.append((row[here], gram[at[here]]))
            n += np.bincount(row, minlength=len(n))
            total += np.rint(np.bincount(row, weights=weight[at], minlength=len(n))).astype(np.int64)

        def lists(cold: list, size: int):
            """Keys and counts of each row's n-grams that aren't hot."""
            of, key = (np.concatenate([x[i] for x in cold] or [np.empty(0, dtype=np.int64)]) for i in (0, 1))
            order = np.lexsort((key, of))
            of, key = of[order], key[order]
            begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])])) if len(of) else np.empty(0, dtype=np.int64)
            c = np.diff(np.concatenate([begin, [len(of)]]))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of[begin], minlength=size))]).astype(np.int32))
            return [pa.ListArray.from_arrays(ends, pa.array(x, k)) for x, k in ((key[begin], pa.int64()), (c, pa.int32()))]

        for batch in batches:
            m = np.array(batch.column(2).to_pylist(), dtype=np.int64)
            n, total, cold = np.zeros(len(m), dtype=np.int64), np.zeros(len(m), dtype=np.int64), []
            held, size = [], 0
            for i, t in enumerate(batch.column(3)):
                for p in coder.pieces(t.as_py()):
                    held.append((i, p))
                    size += len(p)
                    if size >= CHUNK:
                        look(held, m, n, total, cold)
                        held, size = [], 0
            if held:
                look(held, m, n, total, cold)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array(total), *lists(cold, len(m))], names=[x.split()[0] for x in _SCORED.split(", ")])

    read = rows.select("doc_id", "lang", "m", "text").mapInArrow(run, _SCORED).withColumn("id", F.monotonically_increasing_id())
    read = common.materialize(read, WORK)
    asked = read.where(F.size("keys") > 0).select("id", F.explode(F.arrays_zip("keys", "counts")).alias("x")).select("id", F.col("x.keys").alias("key"), F.col("x.counts").alias("c"))
    rest = asked.join(cold, "key").groupBy("id").agg(F.sum(F.col("c") * F.col("w")).alias("rest"))
    even = -math.log(width(letters)[1])
    base = F.when(F.col("m") == 0, unknown.get(0, even)).otherwise(unknown.get(1, even))
    # n counts the start mark, which isn't predicted, and the end mark, which is
    places = F.col("n") - 1
    done = read.drop("keys", "counts").join(rest, "id", "left").withColumn("log_p", places * base + (F.col("hot") + F.coalesce("rest", F.lit(0))) / UNIT)
    return done.select("doc_id", "lang", "m", F.greatest(F.col("n") - 2, F.lit(0)).cast("long").alias("n"), F.when(F.col("n") > 0, -F.col("log_p") / places).alias("nll"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    lab = common.pick(labels, doc_id="long", quality="int", toxic="int").where("doc_id is not null")
    return lab.groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q >= 1 and t = 0").select("doc_id")


def thresholds(held: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """lang, threshold (of nll); the row with a null lang holds for all others. held: lang, nll of held-out trusted documents."""
    step = F.least(F.floor(F.col("nll") * SCALE), F.lit(TOP * SCALE)).cast("int")
    seen = common.materialize(held.where("nll is not null").groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("n")), WORK)
    every = seen.unionByName(seen.groupBy("step").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string")))
    upto = Window.partitionBy("lang").orderBy("step")
    ranked = every.withColumn("below", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy("lang")))
    at = ranked.where(F.col("below") >= F.ceil(F.col("total") * quantile)).groupBy("lang").agg(F.min("step").alias("step"))
    return common.materialize(at.select("lang", ((F.col("step") + 1) / SCALE).alias("threshold")), OWNER)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, hot: int | None = None) -> DataFrame:
    """doc_id, lang, n, perplexity, threshold (a perplexity) and kept, for every document."""
    trusted = common.materialize(trusted_ids(labels), WORK)
    rows = common.pick(docs, doc_id="long", lang="string", text="string").withColumn("lang", F.coalesce("lang", F.lit("und")))
    good = rows.where("text is not null").join(common.checked_broadcast(trusted), "doc_id").select(fold().alias("fold"), "text")
    letters = alphabet(docs)
    model, unknown = weights(common.materialize(counts(good, letters), WORK), *width(letters))
    asked = rows.select("doc_id", "lang", (1 - fold()).cast("int").alias("m"), "text")
    scored = common.materialize(score(asked, letters, model, unknown, hot), OWNER)
    cuts = thresholds(scored.join(common.checked_broadcast(trusted), "doc_id"), quantile)
    pooled = (cuts.where("lang is null").first() or {"threshold": float(TOP)})["threshold"]
    own = cuts.where("lang is not null").withColumnRenamed("lang", "_of")
    out = scored.join(common.checked_broadcast(own), F.col("lang") == F.col("_of"), "left").withColumn("cut", F.coalesce("threshold", F.lit(pooled)))
    common.drop(WORK, docs.sparkSession)
    kept = F.coalesce(F.col("nll") <= F.col("cut"), F.lit(False))
    return out.select("doc_id", "lang", "n", F.exp("nll").alias("perplexity"), F.exp("cut").alias("threshold"), kept.alias("kept"))
