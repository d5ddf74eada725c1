"""Best-fit packing of token pieces into sequences of a fixed capacity.

Method: bulk-synchronous best-fit. Pieces and open gaps are kept sorted by length; lengths are
integers of at most ``capacity``, so all pieces of one length are one class, and a superstep
matches a whole class. Each superstep, from the longest class down, sweeps the sorted gaps for
the successor (the smallest gap that still holds the class), gives the class's pieces to that
gap's sequences by rank (piece of rank r to the r-th sequence, so no two claim one place),
updates the gaps and repeats until the class is placed; what finds no gap opens sequences.
The sweeps run on the driver, over counts per length (at most ``capacity`` rows, whatever the
input): pieces of one length are alike, and so are gaps of one size, so a sweep over sorted
classes with their counts finds what a distributed sweep over the sorted pieces and gaps
themselves would. The pieces are ranked within their length on the executors and pick up
their place by a join with the supersteps' runs.

Edge cases: null or empty text is a document with the end id alone; repeated rows are packed
once each; an empty table gives no row; extra columns are ignored; a null doc_id stays null.
A document longer than the capacity is cut: its first piece takes the remainder, the others
are full. Texts of any length are tokenised whole.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY, END_ID = 1024, 2
#: Runs of a plan up to here are broadcast (about 10 MB); beyond, they are joined by shuffle.
BROADCAST_RUNS = 200_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and with_ids the ids themselves."""

    def cut(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        ids_of = tokens.encoder(tokenizer)
        for batch in batches:
            doc, text = batch.column(0).to_pylist(), batch.column(1)
            out: list[list] = [[], [], [], [], [], []]
            for d, t in zip(doc, text):
                ids = np.array([*ids_of(t.as_py() or ""), end_id], dtype="<u4")
                for p, (s, n) in enumerate(bounds(len(ids), capacity)):
                    part = ids[s : s + n]
                    row = (d, p, s, n, zlib.crc32(part.tobytes()), part.astype("int32") if with_ids else None)
                    for col, v in zip(out, row):
                        col.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 6 if with_ids else 5]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return common.pick(docs, doc_id="long", text="string").mapInArrow(cut, _PIECES + (", ids array<int>" if with_ids else ""))


def supersteps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, offset) from the number of pieces of each length."""
    runs, sequences = [], 0
    gaps: list[int] = []  # sorted open gap sizes
    blocks: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first sequence, how many)]

    def open_gap(gap: int, first: int, n: int) -> None:
        if gap:
            if gap not in blocks:
                insort(gaps, gap)
                blocks[gap] = []
            blocks[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect_left(gaps, length)
            if i == len(gaps):  # no gap holds it: new sequences, each filled with as many as fit
                per = capacity // length
                n = left // per
                for k in range(per if n else 0):
                    runs.append((length, rank, rank + n, sequences, k * length))
                    rank += n
                if n:
                    open_gap(capacity - per * length, sequences, n)
                    sequences, left = sequences + n, left - n * per
                if left and left < per:
                    for k in range(left):
                        runs.append((length, rank + k, rank + k + 1, sequences, k * length))
                    open_gap(capacity - left * length, sequences, 1)
                    sequences, left = sequences + 1, 0
                break
            gap = gaps[i]
            first, n = blocks[gap].pop()
            took = min(n, left)
            if took < n:
                blocks[gap].append((first + took, n - took))
            if not blocks[gap]:
                del blocks[gap]
                gaps.pop(i)
            runs.append((length, rank, rank + took, first, capacity - gap))
            open_gap(gap - length, first, took)
            rank, left = rank + took, left - took
    return runs


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns doc_id, piece, length); ``parts`` should be a written table."""
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    schema = "r_length long, r_lo long, r_hi long, r_seq long, r_offset long"
    plan = supersteps(counts, capacity)
    runs = spark.createDataFrame(plan, schema)
    ranked = common.class_rank(parts, ["length"], ["doc_id", "piece", "ids_crc32"], sum(counts.values()))
    # The runs follow from `capacity` and the counts' digits, not from the rows: a few thousand for 1024.
    runs = F.broadcast(runs) if len(plan) <= BROADCAST_RUNS else runs
    at = ranked.join(runs, (F.col("length") == F.col("r_length")) & (F.col("rank") >= F.col("r_lo")) & (F.col("rank") < F.col("r_hi")))
    return at.select(*parts.columns, (F.col("r_seq") + F.col("rank") - F.col("r_lo")).alias("sequence_id"), F.col("r_offset").alias("offset"))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """All documents as pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = pieces(docs, tokenizer or tokens.default_path(), capacity, end_id, with_ids)
    return place(common.materialize(found, "packing"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (sequence_id, ids) from ``pack(..., with_ids=True)``."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
