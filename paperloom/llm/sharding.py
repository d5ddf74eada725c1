"""Sharding by best-fit-decreasing bin packing.

Method: rows of equal text form an indivisible group; groups in order of falling size enter the
shard with the tightest remaining capacity that still holds them, found in a balanced ordered
structure over the open shards' remaining capacities. Groups of one size are alike to the
packing, so it walks the distinct sizes with their counts (distinct sizes are at most about the
square root of twice the total size, and in text corpora bounded by the longest documents), and
each group picks its shard by its rank within its size.

``pack_sizes`` has a fixed capacity and opens as few shards as best-fit-decreasing can;
``even_sizes`` has a fixed number of shards and searches the smallest capacity that suffices,
after groups larger than an even share have got shards of their own.

Edge cases: null text counts as zero bytes and all null texts are one group, apart from empty
texts; repeated rows each get their own slot; an empty table gives no row; extra columns are
ignored; a null doc_id stays null.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHARDS, ROW_BYTES, LAW = 40, 16, "bytes"
#: Runs of a plan up to here are broadcast (about 10 MB); beyond, they are joined by shuffle.
BROADCAST_RUNS = 200_000
Run = tuple[int, int, int, int]


class Tightest:
    """Open shards ordered by remaining capacity in a two-level B-tree of bounded nodes."""

    def __init__(self, node: int = 512) -> None:
        self.node, self.nodes = node, [[]]

    def add(self, room: int, shard: int) -> None:
        i = self._at((room, shard))
        insort(self.nodes[i], (room, shard))
        if len(self.nodes[i]) > self.node:
            half = self.node // 2
            self.nodes.insert(i + 1, self.nodes[i][half:])
            del self.nodes[i][half:]

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns (room, shard) with the least room of at least ``size``."""
        i = self._at((size, -1))
        while i < len(self.nodes):
            j = bisect_left(self.nodes[i], (size, -1))
            if j < len(self.nodes[i]):
                found = self.nodes[i].pop(j)
                if not self.nodes[i] and len(self.nodes) > 1:
                    self.nodes.pop(i)
                return found
            i += 1
        return None

    def _at(self, key: tuple[int, int]) -> int:
        lo, hi = 0, len(self.nodes) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if self.nodes[mid] and self.nodes[mid][-1] >= key:
                hi = mid
            else:
                lo = mid + 1
        return lo


def pack_sizes(sizes: list[tuple[int, int]], capacity: int, at_most: int | None = None) -> tuple[list[Run], int] | None:
    """Runs (size, first rank, end rank, shard) and the number of shards; None if more than ``at_most`` are needed.

    A size above the capacity gets a shard of its own.
    """
    tree, shards, runs = Tightest(), 0, []
    for size, count in sorted(sizes, reverse=True):
        rank = 0
        while rank < count:
            found = tree.take(size)
            if found is None:
                found, shards = (max(capacity, size), shards), shards + 1
                if at_most is not None and shards > at_most:
                    return None
            room, shard = found
            n = min(count - rank, room // size if size else count - rank)
            runs.append((size, rank, rank + n, shard))
            rank += n
            tree.add(room - n * size, shard)
    return runs, shards


def even_sizes(sizes: list[tuple[int, int]], shards: int) -> list[Run]:
    """Runs for exactly ``shards`` shards of near equal size."""
    left = {s: n for s, n in sizes if n}
    total, runs, done = sum(s * n for s, n in left.items()), [], 0
    for size in sorted(left, reverse=True):
        first = done
        while left[size] and shards - done > 1 and size * (shards - done) > total:
            left[size] -= 1
            total -= size
            done += 1
        if done > first:
            runs += [(size, k - first, k - first + 1, k) for k in range(first, done)]
        if left[size]:
            break
    taken = {s: max(r[2] for r in runs if r[0] == s) for s in {r[0] for r in runs}}
    rest, bins = [(s, n) for s, n in left.items() if n], shards - done
    if not rest:
        return runs
    low = max(-(-total // bins), max(s for s, _ in rest))
    high, found = low, pack_sizes(rest, low, bins)
    step = max(1, low // 10_000)
    while found is None:
        low, high, step = high + 1, high + step, step * 2
        found = pack_sizes(rest, high, bins)
    while low < high:
        mid = (low + high) // 2
        if (trial := pack_sizes(rest, mid, bins)) is None:
            low = mid + 1
        else:
            high, found = mid, trial
    return runs + [(s, a + taken.get(s, 0), b + taken.get(s, 0), done + k) for s, a, b, k in found[0]]


def shard(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: into ``shards`` near equal shards, or as few as hold ``capacity`` bytes each."""
    spark = docs.sparkSession
    text = F.col("text")
    base = common.pick(docs, doc_id="long", text="string").select(
        "doc_id",
        (common.utf8_len(text) + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.unhex(F.coalesce(F.md5(text.cast("binary")), F.lit(""))).alias("text_key"),
    )
    base = common.materialize(base, "sharding")
    rows = base.count()
    groups = base.groupBy("text_key").agg(F.sum("size").alias("group_size"))
    ranked = common.materialize(common.class_rank(groups, ["group_size"], ["text_key"], rows, salts=16), "sharding")
    sizes = [(r[0], r[1]) for r in ranked.groupBy("group_size").agg(F.count(F.lit(1))).toLocalIterator()]
    plan = even_sizes(sizes, shards) if shards else pack_sizes(sizes, capacity)[0]
    runs = spark.createDataFrame(plan, "r_size long, r_lo long, r_hi long, shard int")
    runs = F.broadcast(runs) if len(plan) <= BROADCAST_RUNS else runs
    at = ranked.join(runs, (F.col("group_size") == F.col("r_size")) & (F.col("rank") >= F.col("r_lo")) & (F.col("rank") < F.col("r_hi")))
    placed = base.join(at.select("text_key", "shard"), "text_key").select("doc_id", "size", "text_crc32", "shard")
    return common.class_rank(placed, ["shard"], ["doc_id", "text_crc32"], rows, salts=512, to="slot")
