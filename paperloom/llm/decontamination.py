"""Benchmark decontamination by a distributed positional inverted index, DataFrame functions only.

Method. ``build`` stores the index as Parquet: a posting (term, row, pos) for every word of every
document, in segments of which each holds the posting lists of some documents, sorted by term, row and
position. Segments need no shuffle, a frequent term's list is split by document all by itself, and
within a segment a term's postings lie together, so that columns of the index are a few bytes a
posting and reads of some terms skip the rest. A document's last posting has no term; it
tells the document's id, a hash of its text and its number of words.

Test windows name their terms. The index gives the terms' frequencies (a window with a term of
frequency 0 occurs nowhere); each window is looked up by its rarest term, and every posting of that
gives one offset-adjusted start. These candidates are intersected with the postings of the
window's second rarest term, and what is left with those of all others: a posting must stand at each
term's own place (exact phrase), or within ``slop`` words of it (proximity). Only postings of test
terms, in documents that hold a candidate, are shuffled, however many windows there are.

A window is ``WINDOW`` consecutive words of an item; a shorter item, if not empty, is one window.
Terms are known by 64-bit hashes.

Edge cases: null or empty texts have no words; null item ids mark words but name no item; items
that repeat an id are one item; equal windows of several items count for each; a row that
repeats doc_id and text gets the same result each time; an empty benchmark leaves all clean;
extra columns are ignored; texts of any length are searched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, SLOP = 10, 2
#: Segments that a task makes of its documents, one after another: a sort holds the postings of one.
SEGMENTS = 4
OWNER = "decontamination"
#: Tables that only the operator itself reads, the index among them; they go when it returns.
WORK = "decontamination-work"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The index's columns: all but the last posting of a document have nulls in the last two.
INDEX = "term long, row long, pos int, doc_id long, h long"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text, as an array; none for null."""
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    plain = F.trim(F.regexp_replace(F.coalesce(low, F.lit("")), _APART, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct windows: wid, terms (array of hashes) and items (sorted array of item ids as strings)."""
    items = common.pick(benchmark, item_id="string", text="string").select("item_id", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    each = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i + 1, F.lit(width)))).alias("terms"))
    found = each.groupBy("terms").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return common.materialize(found.withColumn("wid", F.monotonically_increasing_id()), WORK)


def build(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The stored index of ``docs``: in ``path``, or as a scratch table. ``row`` numbers the documents."""
    base = common.pick(docs, doc_id="long", text="string").select("doc_id", F.xxhash64("text").alias("h"), "text")
    path = path or f"{common.scratch(docs.sparkSession, WORK)}/index"
    for i in range(SEGMENTS):
        # by content, so that every document is in one segment however the table is read
        part = base.where(F.pmod(F.xxhash64("doc_id", "h"), F.lit(SEGMENTS)) == i)
        read = part.select((F.monotonically_increasing_id() * SEGMENTS + i).alias("row"), "doc_id", "h", F.array_append(words(F.col("text")), F.lit("")).alias("w"))
        last = F.col("x") == ""
        each = read.select("row", "doc_id", "h", F.posexplode("w").alias("pos", "x"))
        rows = each.select(F.when(~last, F.xxhash64("x")).alias("term"), "row", "pos", F.when(last, F.col("doc_id")).alias("doc_id"), F.when(last, F.col("h")).alias("h"))
        rows.sortWithinPartitions("term", "row", "pos").write.mode("append").parquet(path)
    return read_index(docs.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def documents(index: DataFrame) -> DataFrame:
    """row, doc_id, h, n_words of every document of an index."""
    return index.where("term is null").select("row", "doc_id", "h", F.col("pos").cast("long").alias("n_words"))


def lookups(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """wid, items, len and by_tf: (tf, offset, term) of a window's terms, the rarest first; only windows whose terms all occur."""
    terms = common.materialize(wanted.select(F.explode("terms").alias("term")).distinct(), WORK)
    tf = index.select("term").join(common.checked_broadcast(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("tf"))
    spread = wanted.select("wid", "items", F.size("terms").alias("len"), F.posexplode("terms").alias("offset", "term"))
    ranked = spread.join(tf, "term").groupBy("wid").agg(F.first("items").alias("items"), F.first("len").alias("len"), F.array_sort(F.collect_list(F.struct("tf", "offset", "term"))).alias("by_tf"))
    return common.materialize(ranked.where(F.size("by_tf") == F.col("len")), WORK)


def _intersected(index: DataFrame, candidates: DataFrame, known: DataFrame, first: int, many: Column | int, slop: int) -> DataFrame:
    """The candidates (row, wid, start) with a posting at the place of each of the window's terms of the ranks from ``first`` on."""
    candidates = common.materialize(candidates, WORK)
    terms = F.slice("by_tf", first + 1, many) if isinstance(many, int) else F.slice(F.col("by_tf"), F.lit(first + 1), many)
    near = F.explode(F.sequence(F.lit(-slop), F.lit(slop))) if slop else F.lit(0)
    asked = candidates.join(known.select("wid", terms.alias("t")), "wid").select("row", "wid", "start", F.size("t").alias("need"), F.explode_outer("t").alias("t"))
    asked = asked.select("row", "wid", "start", "need", F.col("t.offset").alias("offset"), F.col("t.term").alias("term"), near.alias("near"))
    asked = asked.withColumn("pos", F.col("start") + F.col("offset") + F.col("near"))
    rows = common.checked_broadcast(common.materialize(candidates.select("row").distinct(), WORK))
    some = common.checked_broadcast(common.materialize(asked.where("term is not null").select("term").distinct(), WORK))
    postings = index.select("term", "row", "pos").join(some, "term").join(rows, "row").withColumn("hit", F.lit(1))
    both = asked.join(postings, ["row", "term", "pos"], "left")
    ok = both.groupBy("row", "wid", "start", "need").agg(F.count_distinct(F.when(F.col("hit") == 1, F.col("offset"))).alias("n"))
    return ok.where("n = need").select("row", "wid", "start")


def matches(index: DataFrame, wanted: DataFrame, slop: int = 0) -> DataFrame:
    """row, wid, start (in words, from 0), len, items of every occurrence of a window.

    With ``slop``, the window's rarest term stands at its place and each other one within ``slop`` words of its own.
    """
    known = lookups(index, wanted)
    anchors = common.materialize(known.select("wid", F.col("by_tf")[0]["term"].alias("term"), F.col("by_tf")[0]["offset"].alias("offset")), WORK)
    found = index.select("term", "row", "pos").join(common.checked_broadcast(anchors, 500_000), "term").select("row", "wid", (F.col("pos") - F.col("offset")).alias("start"))
    found = found.where("start >= 0") if not slop else found
    found = _intersected(index, found, known, 1, 1, slop)
    found = _intersected(index, found, known, 2, F.size("by_tf"), slop)
    return found.join(known.select("wid", "len", "items"), "wid").select("row", "wid", "start", "len", "items")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, start, len, items: every exact occurrence of a window (start counts words from 0)."""
    index = build(docs)
    return matches(index, windows(benchmark, width)).join(documents(index), "row").select("doc_id", "start", "len", "items")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = SLOP, width: int = WINDOW) -> DataFrame:
    """As phrase_matches, but each term may stand up to ``slop`` words off its place, as counted from the rarest one."""
    index = build(docs)
    return matches(index, windows(benchmark, width), slop).join(documents(index), "row").select("doc_id", "start", "len", "items")


def _covered(spans: Column) -> Column:
    return F.size(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))).cast("long")


def report(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, item_ids (sorted strings), contaminated."""
    index = build(docs)
    found = matches(index, windows(benchmark, width)).groupBy("row").agg(F.collect_set(F.struct("start", "len")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    hit = found.select("row", _covered(F.col("spans")).alias("n_hit"), "item_ids")
    each = documents(index).join(hit, "row", "left")
    done = each.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    done = common.materialize(done, OWNER)
    common.drop(WORK, docs.sparkSession)
    return done.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of docs (all their columns) in which no window occurs."""
    index = build(docs)
    bad = matches(index, windows(benchmark, width)).select("row").distinct().join(documents(index), "row")
    bad = common.materialize(bad.select(F.col("doc_id").alias("_bad"), F.col("h").alias("_bad_h")).distinct(), OWNER)
    common.drop(WORK, docs.sparkSession)
    return docs.join(common.checked_broadcast(bad, 500_000), docs["doc_id"].cast("long").eqNullSafe(bad["_bad"]) & (F.xxhash64(docs["text"]) == bad["_bad_h"]), "left_anti")
