"""Operators over a dossier's pages in order: windows keyed by dossier, so dossiers spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def in_order():
    """A dossier's pages in order; the windows of this module share it, and so one sort."""
    return Window.partitionBy("dossier_id").orderBy("page_num")


def upto():
    return in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before():
    return in_order().rowsBetween(Window.unboundedPreceding, -1)



def _number(prefix: str, n: Column, width: int = 0) -> Column:
    digits = F.when(F.length(n.cast("string")) < width, F.lpad(n.cast("string"), width, "0")).otherwise(n.cast("string")) if width else n.cast("string")
    return F.concat(F.lit(prefix), digits)


def forward_fill(pages: DataFrame) -> DataFrame:
    """doc_code: the page's stamp, a new unknown_n at a boundary after any stamp, else the last one; unknown before all."""
    det = T.blank_to_null(F.col("detected_code"))
    out = pages.withColumn("_det", det).withColumn("_seen", F.coalesce(F.max(det.isNotNull()).over(before()), F.lit(False)))
    out = out.withColumn("_u", F.col("_det").isNull() & T.marks_new_document(F.col("within_doc_page"), F.col("text")) & F.col("_seen"))
    own = F.coalesce("_det", F.when(F.col("_u"), _number("unknown_", F.sum(F.col("_u").cast("int")).over(upto()))))
    out = out.withColumn("_own", own)
    return out.withColumn("doc_code", F.coalesce(F.last("_own", ignorenulls=True).over(upto()), F.lit("unknown"))).drop("_det", "_seen", "_u", "_own")


def forward_fill_split(pages: DataFrame) -> DataFrame:
    """doc_code with sub-splits code_n of memo-like documents and unknown_n slots, and whether the page is inherited."""
    det = T.blank_to_null(F.col("detected_code"))
    new = T.is_new_vlm(F.col("is_new_document"), F.col("within_doc_page"))
    first = F.row_number().over(in_order()) == 1
    out = pages.withColumn("_det", det).withColumn("_slot", det.isNull() & (new | first))
    event = F.when(F.col("_det").isNotNull() | F.col("_slot"), F.struct(F.col("_det").alias("v")))
    out = out.withColumn("_stamp", F.last(event, ignorenulls=True).over(before())["v"])
    changed = F.col("_det").isNotNull() & ~F.col("_det").eqNullSafe(F.col("_stamp"))
    out = out.withColumn("_sub", F.col("_det").isNotNull() & ~changed & new & F.col("category").isin(*T.MEMO_LIKE))
    of_code = Window.partitionBy("dossier_id", "_det").orderBy("page_num").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    suffix = F.sum(F.col("_sub").cast("int")).over(of_code) + 1
    own = (
        F.when(F.col("_slot"), _number("unknown_", F.sum(F.col("_slot").cast("int")).over(upto())))
        .when(F.col("_sub"), F.concat("_det", F.lit("_"), suffix.cast("string")))
        .when(changed, F.col("_det"))
    )
    return out.withColumn("doc_code", F.last(own, ignorenulls=True).over(upto())).drop("_det", "_slot", "_stamp", "_sub")


def boundary_numbers(pages: DataFrame, is_new: Column) -> DataFrame:
    """doc_code auto_001, auto_002, ...: a new one at each page that is new, and at the first."""
    start = (F.row_number().over(in_order()) == 1) | is_new
    return pages.withColumn("_s", start.cast("int")).withColumn("doc_code", _number("auto_", F.sum("_s").over(upto()), 3)).drop("_s")


def split_signals(pages: DataFrame) -> DataFrame:
    """starts: whether a page starts a document by its number, its footer, or a fresh e-mail or memo head."""
    text = F.col("text")
    return pages.withColumn("starts", (F.row_number().over(in_order()) == 1) | T.marks_new_document(F.col("within_doc_page"), text) | T.starts_email(text) | T.starts_memo(text))


def runs(pages: DataFrame, value: str) -> DataFrame:
    """dossier_id, run, value, start (first page), length: runs of equal values over the pages that have one."""
    w = Window.partitionBy("dossier_id").orderBy("page_num")
    has = pages.where(F.col(value).isNotNull())
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    islands = has.withColumn("_n", new).withColumn("run", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("dossier_id", "run").agg(F.min(value).alias(value), F.min("page_num").alias("start"), F.count(F.lit(1)).alias("length"))


def segments_of_runs(pages: DataFrame) -> DataFrame:
    """seg: contiguous segments for annotation: a changed stamp, a new page of the same stamp, or a new page without one starts a segment."""
    det = T.blank_to_null(F.col("detected_code"))
    new = T.is_new_vlm(F.col("is_new_document"), F.col("within_doc_page"))
    first = F.row_number().over(in_order()) == 1
    event = F.when(det.isNotNull() | new | first, F.struct(det.alias("v")))
    out = pages.withColumn("_event", event).withColumn("_stamp", F.last("_event", ignorenulls=True).over(before())["v"])
    start = first | (det.isNotNull() & (~det.eqNullSafe(F.col("_stamp")) | new)) | (det.isNull() & new)
    return out.withColumn("_s", start.cast("int")).withColumn("seg", F.sum("_s").over(upto())).drop("_event", "_stamp", "_s")


def large_jumps(pages: DataFrame, value: str, gap: int = 6) -> DataFrame:
    """dossier_id, page, from_code, to_code, gap: jumps of more than ``gap`` between runs of two pages or more."""
    w = Window.partitionBy("dossier_id").orderBy("start")
    kept = runs(pages, value).where("length >= 2").withColumn("from_code", F.lag(value).over(w)).withColumn("gap", F.col(value).cast("int") - F.col("from_code").cast("int"))
    return kept.where(F.col("gap") > gap).select("dossier_id", F.col("start").alias("page"), "from_code", F.col(value).alias("to_code"), "gap")


def evaluation_starts(pages: DataFrame) -> DataFrame:
    """dossier_id, page0: where the evaluation sees documents start, by stamps; by new-page flags where stamps show one document only."""
    det = T.blank_to_null(F.col("detected_code"))
    new = T.is_new_vlm(F.col("is_new_document"), F.col("within_doc_page"))
    # a new page without stamp clears the last stamp
    event = F.when(det.isNotNull() | new, F.struct(det.alias("v")))
    out = pages.withColumn("_event", event).withColumn("_last", F.last("_event", ignorenulls=True).over(before())["v"])
    start = (F.row_number().over(in_order()) == 1) | (det.isNotNull() & (~det.eqNullSafe(F.col("_last")) | (new & F.col("category").isin(*T.MEMO_LIKE)))) | (det.isNull() & new & F.col("_last").isNotNull())
    out = out.withColumn("_s", F.coalesce(start, F.lit(False))).withColumn("_n", F.sum(F.col("_s").cast("int")).over(Window.partitionBy("dossier_id")))
    fallback = (F.col("_n") == 1) & F.coalesce("is_new_document", F.lit(False))
    return out.where(F.col("_s") | fallback).select("dossier_id", (F.col("page_num") - 1).alias("page0"))


def intervals(starts: DataFrame, totals: DataFrame, of: str = "page0") -> DataFrame:
    """dossier_id, lo, hi (exclusive), i: segments between boundaries, the last up to the dossier's end."""
    w = Window.partitionBy("dossier_id").orderBy(of)
    return starts.join(totals, "dossier_id").select("dossier_id", F.col(of).alias("lo"), F.coalesce(F.lead(of).over(w), F.col("n")).alias("hi"), F.row_number().over(w).alias("i"))


def emails_of_pages(pages: DataFrame, key: str = "doc_code") -> DataFrame:
    """One row per e-mail of a document: a page that starts one, or the document's first, opens it; the others append their text."""
    w = Window.partitionBy("dossier_id", key).orderBy("page_num")
    start = F.coalesce("email_start", F.lit(False)) | (F.row_number().over(w) == 1)
    numbered = pages.withColumn("_s", start.cast("int")).withColumn("n", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("page_num", "text")))
    made = numbered.groupBy("dossier_id", key, "n").agg(F.min("page_num").alias("pdf_page"), F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "\n\n").alias("text"))
    return made.withColumn("id", F.concat(F.col(key), F.lit("."), F.col("n").cast("string")))


def sample_pages(total: Column, k: int, seeded: Column | None = None) -> Column:
    """Sorted 0-based pages to sample: seeded ones up to half the budget, a cluster at 35 %, the rest evenly spread."""
    seeds = F.coalesce(seeded, F.array().cast("array<int>")) if seeded is not None else F.array().cast("array<int>")
    budget = max(1, k // 2)
    spread = lambda n, last: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.bround(i * (last / F.greatest(n - 1, F.lit(1)))).cast("int"))
    m = F.size(seeds)
    chosen = F.when(m <= budget, seeds).otherwise(F.transform(spread(F.lit(budget), (m - 1).cast("double")), lambda i: seeds[i]))
    remaining = k - F.size(chosen)
    n_cluster = F.least(F.lit(4), F.floor(remaining / 2).cast("int"))
    n_spread = (remaining - n_cluster).cast("int")
    start = F.greatest(F.lit(0), (F.bround(total * 0.35) - F.floor(n_cluster / 2)).cast("int"))
    cluster = F.filter(F.sequence(start, F.greatest(start + n_cluster - 1, start)), lambda i: (i < total) & (i < start + n_cluster))
    many = F.array_sort(F.array_distinct(F.concat(chosen, cluster, spread(n_spread, (total - 1).cast("double")))))
    return F.when(total <= k, F.sequence(F.lit(0), total - 1)).otherwise(many)
