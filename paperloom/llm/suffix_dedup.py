"""Removal of long repeated byte strings by a logarithmic family of suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts elsewhere in the corpus.

Method. The start of every string belongs to an anchor: the place in the string whose next
``CORE`` bytes have the least hash (leftmost on ties), which depends on the string's content
alone. Consecutive starts with one anchor form a run; the run's segment is all bytes of its
strings. Equal strings have equal cores at equal distance, so
1. cores are counted over the corpus, and only runs whose core occurs twice go on;
2. equal segments are counted: all strings of a segment that occurs twice are repeats;
3. segments that share a core but differ enter the index ``Family``. A batch of segments becomes a
   level: for each core its segments and their suffix array (the strings' starts in the order of
   their LENGTH bytes), sorted once and written. The batch's arrays are merge-scanned against
   those of every level there is; neighbours that agree on LENGTH bytes are repeats. Before the
   next batch, levels of equal size are merged, as in a binary counter, by a linear merge of
   their sorted arrays, so a segment is rewritten at most log2(batches) times and never sorted
   again. A core with more than ``LARGE`` different segments is settled exactly by counting
   128-bit hashes of its strings instead, which no single task holds.
Repeated whole texts (by 128-bit hashes) are found first and enter the index once.

``repeated`` settles one table; ``Corpus`` takes tables one after another and tells what repeats
in all of them so far. As any text may meet a later one, it indexes all segments.

Edge cases: null text is empty; texts shorter than LENGTH lose nothing by themselves; repeated
rows and repeated texts of at least LENGTH bytes are removed whole; strings never cross
documents; a null doc_id stays null; an empty table gives no row; extra columns are ignored;
texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH, CORE, BATCHES, LARGE = 200, 64, 4, 4000
OWNER = "suffix_dedup"
#: Tables that only ``repeated`` itself reads; they go when it returns.
WORK, RUNS = "suffix_dedup-work", "suffix_dedup-runs"


def cores(data: bytes, core: int = CORE):
    """A hash of the ``core`` bytes (a power of two, 8 at least) from each place on."""
    import numpy as np

    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    n, width = len(b), 8
    h = np.zeros(n - 7, dtype=np.uint64)
    for i in range(8):
        h |= b[i : n - 7 + i] << np.uint64(8 * i)
    while width <= core:
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if width < core:
            h = h[:-width] * np.uint64(0xC2B2AE3D27D4EB4F) + h[width:]
        width *= 2
    return h


def runs(data: bytes, length: int = LENGTH, core: int = CORE):
    """(start, starts, core hash) of the runs of a text of at least ``length`` bytes."""
    import numpy as np

    h = cores(data, core)
    place = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, window, low = 1, length - core + 1, place
    while width * 2 <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < window:
        low = np.minimum(low[: len(place) - window + 1], low[window - width :])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return start, np.diff(np.concatenate([start, [len(anchor)]])), h[anchor[start]].view(np.int64)


def suffix_array(segments: list[bytes], length: int = LENGTH) -> list[tuple[bytes, int, int]]:
    """(string, segment, start) of every string of the segments, in the strings' order."""
    return sorted((s[i : i + length], k, i) for k, s in enumerate(segments) for i in range(len(s) - length + 1))


def merge_scan(new: list[tuple[bytes, int, int]], old: list[tuple[bytes, int, int]]) -> tuple[set, set]:
    """(segment, start) in each of two suffix arrays whose string also stands in the other."""
    i = j = 0
    a, b = set(), set()
    while i < len(new) and j < len(old):
        x, y = new[i][0], old[j][0]
        if x < y:
            i += 1
        elif y < x:
            j += 1
        else:
            while i < len(new) and new[i][0] == x:
                a.add(new[i][1:])
                i += 1
            while j < len(old) and old[j][0] == x:
                b.add(old[j][1:])
                j += 1
    return a, b


def merged(left: list[tuple[bytes, int, int]], right: list[tuple[bytes, int, int]], shift: int) -> list[tuple[int, int]]:
    """(segment, start) of two suffix arrays in one order, in linear time; the right one's segments are numbered from ``shift``."""
    i = j = 0
    out = []
    while i < len(left) and j < len(right):
        if left[i][0] <= right[j][0]:
            out.append(left[i][1:])
            i += 1
        else:
            out.append((right[j][1] + shift, right[j][2]))
            j += 1
    return out + [x[1:] for x in left[i:]] + [(x[1] + shift, x[2]) for x in right[j:]]


def repeats_within(array: list[tuple[bytes, int, int]]) -> set:
    """(segment, start) whose string stands twice in one suffix array."""
    out = set()
    for x, y in zip(array, array[1:]):
        if x[0] == y[0]:
            out |= {x[1:], y[1:]}
    return out


def _intervals(starts) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted(starts):
        if out and out[-1][1] == s:
            out[-1][1] = s + 1
        else:
            out.append([s, s + 1])
    return [tuple(x) for x in out]


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, h and g (128 bits that stand for the text), n (bytes) and text."""
    data = F.coalesce(F.col("text"), F.lit(""))
    return common.pick(docs, doc_id="long", text="string").select("doc_id", F.xxhash64(data).alias("h"), F.xxhash64(F.lit(1), data).alias("g"), F.octet_length(data).cast("long").alias("n"), data.alias("text"))


def _all_runs(texts: DataFrame, length: int, core: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                found = [runs(t.as_py().encode(), length, core) for t in part.column(2)]
                count = [len(f[0]) for f in found]
                cols = [np.repeat(part.column(i).to_numpy(), count) for i in (0, 1)] + [np.concatenate([f[i] for f in found] or [np.empty(0)]) for i in range(3)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((c.astype("int64") for c in cols), kinds)], names=["h", "g", "s", "k", "core"])

    return texts.where(F.col("n") >= length).select("h", "g", "text").mapInArrow(run, "h long, g long, s int, k int, core long")


def _segments(flagged: DataFrame, length: int) -> DataFrame:
    """h, g, s, k, core, sid, seg of the flagged runs of each text (columns h, g, text, runs)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        names = ["h", "g", "s", "k", "core", "sid", "seg"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            for h, g, text, found in zip(*(batch.column(i) for i in range(4))):
                data = text.as_py().encode()
                rows = [(r["s"], r["k"], r["core"], data[r["s"] : r["s"] + r["k"] + length - 1]) for r in found.as_py()]
                cols = [[h.as_py()] * len(rows), [g.as_py()] * len(rows), *([r[i] for r in rows] for i in range(3)), [xxhash.xxh3_128_digest(r[3]) for r in rows], [r[3] for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return flagged.mapInArrow(run, "h long, g long, s int, k int, core long, sid binary, seg binary")


MARK = "struct<sid: binary, lo: int, hi: int>"
#: A level's row: a core's segments, and their suffix array as two arrays of 32-bit integers: segment and start.
LEVEL = f"core long, sids array<binary>, segs array<binary>, of binary, at binary, marks array<{MARK}>"


def _marks(side: list[bytes], found: set) -> list[dict]:
    by: dict[int, list[int]] = {}
    for k, i in found:
        by.setdefault(k, []).append(i)
    return [{"sid": side[k], "lo": lo, "hi": hi} for k, starts in by.items() for lo, hi in _intervals(starts)]


def _level_rows(rows: list[tuple]):
    import pyarrow as pa

    mark = pa.list_(pa.struct([("sid", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32())]))
    kinds = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.binary(), pa.binary(), mark]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["core", "sids", "segs", "of", "at", "marks"])


def level(segs: DataFrame, length: int = LENGTH) -> DataFrame:
    """LEVEL of a batch of segments (core, sid, seg), each sid once; marks are the repeats within the batch. The only sort there is."""

    def made(core: int, sids: list[bytes], held: list[bytes]) -> tuple:
        import numpy as np

        array = suffix_array(held, length)
        of, at = (np.array([x[i] for x in array], dtype="<i4").tobytes() for i in (1, 2))
        return core, sids, held, of, at, _marks(sids, repeats_within(array))

    def run(batches: Iterator) -> Iterator:
        last, sids, held, rows, size = None, [], [], [], 0
        for batch in batches:
            for core, sid, seg in zip(*(batch.column(i) for i in range(3))):
                core, sid = core.as_py(), sid.as_py()
                if core != last and sids:
                    rows.append(made(last, sids, held))
                    size += sum(map(len, held))
                    sids, held = [], []
                    if size > 1_000_000:
                        yield _level_rows(rows)
                        rows, size = [], 0
                last = core
                if not sids or sids[-1] != sid:
                    sids.append(sid)
                    held.append(seg.as_py())
        if sids:
            rows.append(made(last, sids, held))
        yield _level_rows(rows)

    return segs.select("core", "sid", "seg").repartition("core").sortWithinPartitions("core", "sid").mapInArrow(run, LEVEL)


def _met(new: DataFrame, old: DataFrame, length: int, keep: bool) -> DataFrame:
    """LEVEL of the cores of two levels. With ``keep``, all of them, their arrays merged; else only the marks of those in both."""
    cols = ["sids", "segs", "of", "at"]
    a, b = (x.select("core", *[F.col(c).alias(f"{c}_{e}") for c in cols]) for x, e in ((new, "a"), (old, "b")))
    both = a.join(b, "core", "full" if keep else "inner")

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        def array(row: dict, e: str) -> list[tuple[bytes, int, int]]:
            of, at = (np.frombuffer(row[f"{c}_{e}"], dtype="<i4").tolist() for c in ("of", "at"))
            return [(row[f"segs_{e}"][k][i : i + length], k, i) for k, i in zip(of, at)]

        for batch in batches:
            for a0 in range(0, batch.num_rows, 100):
                rows = []
                for row in batch.slice(a0, 100).to_pylist():
                    one = next((e for e, f in ("ab", "ba") if row[f"sids_{f}"] is None), None)
                    if one:
                        rows.append((row["core"], *[row[f"{c}_{one}"] for c in cols], []))
                        continue
                    x, y = array(row, "a"), array(row, "b")
                    if keep:
                        order = merged(y, x, len(row["sids_b"]))
                        of, at = (np.array([o[i] for o in order], dtype="<i4").tobytes() for i in (0, 1))
                        rows.append((row["core"], row["sids_b"] + row["sids_a"], row["segs_b"] + row["segs_a"], of, at, []))
                    else:
                        hit, other = merge_scan(x, y)
                        if hit:
                            rows.append((row["core"], [], [], b"", b"", _marks(row["sids_a"], hit) + _marks(row["sids_b"], other)))
                yield _level_rows(rows)

    return both.mapInArrow(run, LEVEL)


class Family:
    """Levels of sorted segments whose sizes, in batches, are like the digits of a binary counter.

    Levels are scratch tables, or folders of ``path``, where ``Family(spark, path)`` finds them again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, length: int = LENGTH) -> None:
        self.spark, self.path, self.length = spark, path, length
        self.levels: list[tuple[int, str | None, DataFrame]] = []
        for name in sorted(common.folders(spark, path), key=lambda n: int(n.split("-")[1])) if path else []:
            self.levels.append((int(name.split("-")[2]), name, spark.read.schema(LEVEL).parquet(f"{path}/{name}")))

    def _write(self, size: int, rows: DataFrame) -> tuple[int, str | None, DataFrame]:
        if self.path is None:
            return size, None, common.materialize(rows, WORK)
        name = f"level-{1 + max([int(n.split('-')[1]) for _, n, _ in self.levels], default=0)}-{size}"
        rows.write.parquet(f"{self.path}/{name}")
        return size, name, self.spark.read.schema(LEVEL).parquet(f"{self.path}/{name}")

    def settle(self) -> None:
        """Merges levels of equal size."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, x, new), (_, y, old) = self.levels[-1], self.levels[-2]
            both = self._write(size * 2, _met(new, old, self.length, keep=True))
            self.levels[-2:] = [both]
            for name in (x, y):
                if name:
                    common.delete(self.spark, f"{self.path}/{name}")

    def add(self, segs: DataFrame) -> DataFrame:
        """sid, lo, hi: the starts (lo to hi) of strings of new segments (core, sid, seg; sids that are new) that repeat in them or in older ones, and of the older ones that repeat in the new."""
        self.settle()
        one = self._write(1, level(segs, self.length))
        found = one[2].select(F.explode("marks").alias("m")).select("m.*")
        for _, _, old in self.levels:
            found = found.unionByName(_met(one[2], old, self.length, keep=False).select(F.explode("marks").alias("m")).select("m.*"))
        self.levels.append(one)
        return common.materialize(found, WORK)


def family(segs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """sid, lo, hi over all segments (core, sid, seg), a batch at a time."""
    levels, found = Family(segs.sparkSession, None, length), []
    for i in range(batches):
        found.append(levels.add(segs.where(F.pmod(F.xxhash64("sid"), F.lit(batches)) == i)))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _by_hash(segs: DataFrame, length: int) -> DataFrame:
    """The same, for cores with too many segments for one task: strings are counted by their hashes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for sid, seg in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(seg) - length + 1
                yield pa.RecordBatch.from_arrays([pa.array([sid] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array([xxhash.xxh3_128_digest(seg[i : i + length]) for i in range(n)], pa.binary())], names=["sid", "i", "x"])

    each = segs.select("sid", "seg").mapInArrow(run, "sid binary, i int, x binary")
    twice = each.groupBy("x").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("x")
    return each.join(twice, "x").select("sid", F.col("i").alias("lo"), (F.col("i") + 1).alias("hi"))


def _cut(marked: DataFrame, length: int) -> DataFrame:
    """h, g, n_removed, n_spans, spans, kept_sha256 of texts with their repeated starts (columns h, g, text, marks)."""

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in batches:
            rows = []
            for h, g, text, marks in zip(*(batch.column(i) for i in range(4))):
                data, spans = text.as_py().encode(), []
                for m in sorted((m["lo"], m["hi"] - 1 + length) for m in marks.as_py()):
                    if spans and m[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], m[1])
                    else:
                        spans.append(list(m))
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                rows.append((h.as_py(), g.as_py(), sum(b - a for a, b in spans), len(spans), [{"start": a, "end": b} for a, b in spans], kept.hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["h", "g", "n_removed", "n_spans", "spans", "kept_sha256"])

    return marked.mapInArrow(run, "h long, g long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept_sha256 string")


def _result(base: DataFrame, cut: DataFrame, length: int) -> DataFrame:
    """One row per document from base (doc_id, h, g, n, sha) and the cut texts; whole texts that repeat are gone."""
    whole = base.groupBy("h", "g").agg(F.count(F.lit(1)).alias("copies"), F.first("n").alias("n")).where(f"copies > 1 and n >= {length}").select("h", "g", F.lit(True).alias("gone"))
    out = base.join(whole, ["h", "g"], "left").join(cut, ["h", "g"], "left")
    empty = F.sha2(F.lit(""), 256)
    return out.select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(F.col("gone"), F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("gone"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("gone"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))).alias("spans"),
        F.when(F.col("gone"), empty).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def _marked(segs: DataFrame, twice: DataFrame, found: DataFrame) -> DataFrame:
    """h, g, marks: the starts that repeat in each text, from its segments (h, g, s, k, sid), the sids that stand twice, and the family's marks."""
    alike = segs.join(twice, "sid").select("h", "g", F.col("s").alias("lo"), (F.col("s") + F.col("k")).alias("hi"))
    near = segs.select("h", "g", "s", "sid").join(found, "sid").select("h", "g", (F.col("s") + F.col("lo")).alias("lo"), (F.col("s") + F.col("hi")).alias("hi"))
    return alike.unionByName(near).groupBy("h", "g").agg(F.collect_set(F.struct("lo", "hi")).alias("marks"))


def _base(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", "h", "g", "n", F.sha2("text", 256).alias("sha"))


def repeated(docs: DataFrame, length: int = LENGTH, core: int = CORE, batches: int = BATCHES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, spans (byte offsets), kept_sha256."""
    texts = _texts(docs)
    base = common.materialize(_base(texts), OWNER)
    each = common.materialize(_all_runs(texts, length, core), RUNS)
    place = F.xxhash64("h", "g", "s")
    twice = each.groupBy("core").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("core")
    twice = common.materialize(twice, RUNS)  # as a table of its own, a hot core's side of the join can be split
    flagged = each.join(twice.hint("merge"), "core").groupBy("h", "g").agg(F.collect_set(F.struct("s", "k", "core")).alias("runs"))
    flagged = common.materialize(flagged, WORK)
    common.drop(RUNS, docs.sparkSession)
    wanted = common.checked_broadcast(common.materialize(flagged.select(F.col("h").alias("_h")).distinct(), WORK))
    some = texts.join(wanted, F.col("h") == F.col("_h"), "left_semi").groupBy("h", "g").agg(F.first("text").alias("text"))
    some = common.materialize(some.join(flagged, ["h", "g"]).select("h", "g", "text", "runs"), WORK)
    segs = common.materialize(_segments(some, length), WORK)
    kinds = segs.groupBy("sid", "core").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("h", "g", "s")).alias("first"))
    kinds = common.materialize(kinds, WORK)
    shared = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    apart = kinds.join(shared, "core").select("core", "sid", "m", "first.*")
    apart = segs.join(apart, ["core", "sid", "h", "g", "s"]).select("core", "sid", "m", "seg")
    apart = common.materialize(apart, WORK)
    found = family(apart.where(F.col("m") <= LARGE).drop("m"), length, batches)
    if apart.where(F.col("m") > LARGE).limit(1).count():
        found = found.unionByName(_by_hash(apart.where(F.col("m") > LARGE), length))
    marks = _marked(segs, kinds.where("c > 1").select("sid"), common.materialize(found, WORK))
    cut = common.materialize(_cut(some.select("h", "g", "text").join(marks, ["h", "g"]), length), OWNER)
    common.drop(WORK, docs.sparkSession)
    return _result(base, cut, length)


class Corpus:
    """Documents that come in batches, with the index family of all their segments in folders of ``path``."""

    def __init__(self, spark: SparkSession, path: str, length: int = LENGTH, core: int = CORE) -> None:
        self.spark, self.path, self.length, self.core = spark, path, length, core
        self.family = Family(spark, f"{path}/family", length)

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def _read(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{name}") if name in common.folders(self.spark, self.path) else None

    def add(self, docs: DataFrame) -> None:
        """Indexes a batch: its new texts' segments become a level that is scanned against all others."""
        texts, known = _texts(docs), self._read("texts")
        new = texts.where(F.col("n") >= self.length).select("h", "g", "n", "text").dropDuplicates(["h", "g"])
        new = new.join(known.select("h", "g"), ["h", "g"], "left_anti") if known is not None else new
        new = common.materialize(new, WORK)
        runs_ = _all_runs(new, self.length, self.core).groupBy("h", "g").agg(F.collect_list(F.struct("s", "k", "core")).alias("runs"))
        segs = common.materialize(_segments(new.select("h", "g", "text").join(runs_, ["h", "g"]), self.length), WORK)
        before = self._read("segments")
        fresh = segs.groupBy("core", "sid").agg(F.first("seg").alias("seg"))
        fresh = fresh.join(before.select("sid"), "sid", "left_anti").select("core", "sid", "seg") if before is not None else fresh
        sizes = segs.select("core", "sid").unionByName(before.select("core", "sid")) if before is not None else segs.select("core", "sid")
        hot = sizes.distinct().groupBy("core").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > LARGE).select("core")
        fresh = common.materialize(fresh, WORK)
        found = self.family.add(fresh.join(hot, "core", "left_anti"))
        self._append("marks", found)
        self._append("segments", segs.select("h", "g", "s", "k", "core", "sid"))
        self._append("kinds", fresh)
        self._append("texts", new)
        self._append("documents", _base(texts))
        common.drop(WORK, self.spark)

    def report(self) -> DataFrame:
        """What ``repeated`` tells of all documents so far."""
        segs, kinds, found = (self._read(n) for n in ("segments", "kinds", "marks"))
        hot = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > LARGE).select("core")
        found = found.unionByName(_by_hash(kinds.join(hot, "core"), self.length))
        twice = segs.groupBy("sid").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("sid")
        marks = _marked(segs, twice, found.distinct())
        cut = _cut(self._read("texts").select("h", "g", "text").join(marks, ["h", "g"]), self.length)
        return _result(self._read("documents"), cut, self.length)
