"""Scores of predicted document boundaries, types and e-mails against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import sequence


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")]


def boundary_counts(truth: DataFrame, pred: DataFrame, skip_first: bool = False) -> DataFrame:
    """dossier_id, tp, fp, fn of exact boundaries; optionally without page 0."""
    t, p = (d.where("page0 > 0") if skip_first else d for d in (truth.distinct(), pred.distinct()))
    both = t.withColumn("t", F.lit(1)).join(p.withColumn("p", F.lit(1)), ["dossier_id", "page0"], "full")
    n = lambda c: F.count(F.when(c, 1))
    return both.groupBy("dossier_id").agg(n(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"), n(F.col("t").isNull()).alias("fp"), n(F.col("p").isNull()).alias("fn"))


def page_metrics(truth: DataFrame, pred: DataFrame, skip_first: bool = False) -> DataFrame:
    c = boundary_counts(truth, pred, skip_first)
    return c.select("dossier_id", "tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def tolerant_matches(truth: Column, pred: Column, tolerance: int) -> Column:
    """How many sorted predictions find a sorted true boundary within the tolerance, each used once, in ascending order."""

    def step(acc: Column, p: Column) -> Column:
        hit = F.try_element_at(F.filter(acc["left"], lambda g: F.abs(g - p) <= tolerance), F.lit(1))
        return F.struct(F.when(hit.isNotNull(), F.array_remove(acc["left"], hit)).otherwise(acc["left"]).alias("left"), (acc["n"] + hit.isNotNull().cast("int")).alias("n"))

    return F.aggregate(pred, F.struct(truth.alias("left"), F.lit(0).alias("n")), step)["n"]


def tolerant_metrics(truth: DataFrame, pred: DataFrame, tolerance: int = 1) -> DataFrame:
    t = truth.groupBy("dossier_id").agg(F.array_sort(F.collect_set("page0")).alias("t"))
    p = pred.groupBy("dossier_id").agg(F.array_sort(F.collect_set("page0")).alias("p"))
    empty = F.array().cast("array<bigint>")
    both = t.join(p, "dossier_id", "full").withColumns({"t": F.coalesce("t", empty), "p": F.coalesce("p", empty)})
    both = both.withColumn("tp", tolerant_matches(F.col("t"), F.col("p"), tolerance).cast("long"))
    both = both.select("dossier_id", "tp", (F.size("p") - F.col("tp")).alias("fp"), (F.size("t") - F.col("tp")).alias("fn"))
    return both.select("dossier_id", "tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def overlaps(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """dossier_id, ti, pi, iou of the segment pairs that overlap by more than half; at most one per segment.

    Each side's segments are disjoint, so one sort of all starts finds the pairs: at each start, the
    last segment of either side. No pair of segments that lie apart is made.
    """
    none = F.lit(None).cast("struct<i:int,lo:bigint,hi:bigint>")
    seg = F.struct(F.col("i").cast("int").alias("i"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    starts = truth.select("dossier_id", "lo", seg.alias("t"), none.alias("p")).unionByName(pred.select("dossier_id", "lo", none.alias("t"), seg.alias("p")))
    at = starts.groupBy("dossier_id", "lo").agg(F.max("t").alias("t"), F.max("p").alias("p"))
    w = Window.partitionBy("dossier_id").orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)
    pairs = at.select("dossier_id", F.last("t", ignorenulls=True).over(w).alias("t"), F.last("p", ignorenulls=True).over(w).alias("p"))
    inter = F.least("t.hi", "p.hi") - F.greatest("t.lo", "p.lo")
    pairs = pairs.withColumn("iou", inter / (F.greatest("t.hi", "p.hi") - F.least("t.lo", "p.lo"))).where("iou > 0.5")
    return pairs.select("dossier_id", F.col("t.i").alias("ti"), F.col("p.i").alias("pi"), "iou")


def panoptic(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Recognition, segmentation and panoptic quality by dossier."""
    hits = overlaps(truth, pred).groupBy("dossier_id").agg(F.count(F.lit(1)).alias("n_tp"), F.sum("iou").alias("iou"))
    n = lambda d, c: d.groupBy("dossier_id").agg(F.count(F.lit(1)).alias(c))
    x = n(truth, "nt").join(n(pred, "np"), "dossier_id", "full").join(hits, "dossier_id", "left").na.fill(0)
    x = x.select("dossier_id", "n_tp", (F.col("np") - F.col("n_tp")).alias("n_fp"), (F.col("nt") - F.col("n_tp")).alias("n_fn"), "iou")
    p, r, rq = scores(F.col("n_tp"), F.col("n_fp"), F.col("n_fn"))
    x = x.select("dossier_id", "n_tp", "n_fp", "n_fn", p.alias("precision_doc"), r.alias("recall_doc"), rq.alias("rq"), ratio(F.col("iou"), F.col("n_tp")).alias("sq"))
    return x.withColumn("pq", F.col("rq") * F.col("sq"))


def majority_type(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """dossier_id, i, lo, label: the most frequent category of a segment's pages; the first seen of equals; Other without pages.

    Segments are disjoint: each page meets its segment by one sort of pages and starts.
    """
    label = T.evaluated_type(F.coalesce(T.blank_to_null(F.col("category")), F.lit("Other")), truth=False)
    none = F.lit(None).cast("struct<i:int,hi:bigint>")
    seg = F.struct(F.col("i").cast("int").alias("i"), F.col("hi").cast("long").alias("hi"))
    rows = segments.select("dossier_id", F.col("lo").cast("long").alias("at"), F.lit(0).alias("k"), seg.alias("s"), F.lit(None).cast("string").alias("label"))
    rows = rows.unionByName(pages.select("dossier_id", (F.col("page_num") - 1).cast("long").alias("at"), F.lit(1).alias("k"), none.alias("s"), label.alias("label")))
    w = Window.partitionBy("dossier_id").orderBy("at", "k").rowsBetween(Window.unboundedPreceding, 0)
    votes = rows.withColumn("s", F.last("s", ignorenulls=True).over(w)).where((F.col("k") == 1) & (F.col("at") < F.col("s.hi")))
    votes = votes.groupBy("dossier_id", F.col("s.i").alias("i"), "label").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    best = votes.groupBy("dossier_id", "i").agg(F.max_by("label", F.struct("n", -F.col("first"))).alias("label"))
    return segments.join(best, ["dossier_id", "i"], "left").select("dossier_id", "i", "lo", F.coalesce("label", F.lit("Other")).alias("label"))


def type_at(starts: DataFrame, segments: DataFrame) -> DataFrame:
    """dossier_id, page0, label: the type of the first segment, in list order, that holds a page; else of the last that starts before it; else Other."""
    s = segments.select("dossier_id", F.col("lo").alias("slo"), F.col("hi").alias("shi"), F.col("i").alias("si"), "type")
    pairs = starts.join(s, "dossier_id", "left").where(F.col("slo").isNull() | (F.col("slo") <= F.col("page0")))
    holds = F.col("shi") > F.col("page0")
    best = pairs.groupBy("dossier_id", "page0").agg(F.min_by("type", F.when(holds, F.col("si"))).alias("inside"), F.max_by("type", F.col("si")).alias("before"), F.count(F.when(holds, 1)).alias("n"))
    label = T.evaluated_type(F.when(F.col("n") > 0, F.col("inside")).otherwise(F.col("before")), truth=False)
    return starts.join(best.select("dossier_id", "page0", label.alias("label")), ["dossier_id", "page0"], "left").select("dossier_id", "page0", F.coalesce("label", F.lit("Other")).alias("label"))


def covering(starts: DataFrame, pages0: DataFrame) -> DataFrame:
    """As-of: for each row of pages0 (dossier_id, page0), the last start at or before it, by one sort of both."""
    a = starts.select("dossier_id", F.col("page0").alias("p"), F.lit(0).alias("k"), F.col("page0").alias("start"))
    b = pages0.select("dossier_id", F.col("page0").alias("p"), F.lit(1).alias("k"), F.lit(None).cast("long").alias("start"))
    w = Window.partitionBy("dossier_id").orderBy("p", "k").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("start", F.last("start", ignorenulls=True).over(w)).where("k = 1").select("dossier_id", F.col("p").alias("page0"), "start")


def with_macro(per: DataFrame, values: list[str], key: str = "dossier_id") -> DataFrame:
    """The rows of ``per`` (key as text) and one row ALL with the mean of each value over the rows."""
    one = per.select(F.col(key).cast("string").alias(key), *[F.col(v).cast("double").alias(v) for v in values])
    return one.unionByName(per.agg(*[F.avg(v).alias(v) for v in values]).select(F.lit("ALL").alias(key), *values))


def page_statistics(segments: DataFrame) -> DataFrame:
    """dossier_id, n_docs, mean, median, least and most pages per document."""
    pages = (F.col("hi") - F.col("lo")).cast("double")
    return segments.groupBy("dossier_id").agg(F.count(F.lit(1)).alias("n_docs"), F.avg(pages).alias("mean_pages"), F.median(pages).alias("median_pages"), F.min(F.col("hi") - F.col("lo")).alias("min_pages"), F.max(F.col("hi") - F.col("lo")).alias("max_pages"))


def truth_and_prediction(truth: DataFrame, pred: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    return sequence.intervals(truth, totals), sequence.intervals(pred, totals)
