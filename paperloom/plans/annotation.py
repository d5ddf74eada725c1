"""Annotation plans: scores of a prediction against annotated documents, the export of both, and the evaluation run.

Truth and predictions are lists by dossier: the i-th true document meets the i-th predicted one. Columns:
truth: dossier_id, i (from 1), start_page, end_page (0-based), type_gt, date_gt, num_emails_gt, notes, other_type
predictions: dossier_id, i, start_page, doc_code, type, date_raw, date_iso, method, num_emails_pipeline
mails: dossier_id, i, n, subject, sender, date
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import evaluate as V
from ..operators import match as M
from ..operators import sequence as S

ANNOTATION = ["type_gt", "date_gt", "num_emails_gt", "notes", "other_type"]
PREDICTION = ["doc_code", "type", "date_raw", "date_iso", "method", "num_emails_pipeline"]
#: The scores of ``metrics``, besides dossier_id.
METRICS = [
    "boundary_precision", "boundary_recall", "boundary_f1", "boundary_tp", "boundary_fp", "boundary_fn", "type_accuracy", "type_correct", "type_annotated",
    "email_count_accuracy", "email_count_correct", "email_count_annotated", "email_subject_f1", "email_date_accuracy", "email_date_correct", "email_date_annotated",
    "email_sender_accuracy", "email_sender_correct", "email_sender_annotated", "date_extraction_rate", "date_count", "gt_doc_count", "pipeline_doc_count",
]


def true_documents(boundaries: DataFrame, totals: DataFrame, annotations: DataFrame) -> DataFrame:
    """The truth's documents: intervals between boundaries (dossier_id, page0) with the annotation of their first page (dossier_id, start_page, ...)."""
    zero = totals.select("dossier_id", F.lit(0).cast("long").alias("page0"))
    spans = S.intervals(boundaries.select("dossier_id", F.col("page0").cast("long").alias("page0")).union(zero).distinct(), totals)
    spans = spans.select("dossier_id", "i", F.col("lo").alias("start_page"), (F.col("hi") - 1).alias("end_page"))
    return spans.join(annotations.select("dossier_id", F.col("start_page").cast("long").alias("start_page"), *ANNOTATION), ["dossier_id", "start_page"], "left")


def in_list_order(segments: DataFrame, by: str = "start_page") -> DataFrame:
    """Segments numbered from 1 in the order of their start pages."""
    return segments.withColumn("i", F.row_number().over(Window.partitionBy("dossier_id").orderBy(by)))


def _has(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def metrics(truth: DataFrame, pred: DataFrame, true_mails: DataFrame, pred_mails: DataFrame) -> DataFrame:
    """dossier_id and METRICS for each dossier of the truth; rates without anything annotated are null where a document's count may be unknown, else 0."""
    bounds = V.boundary_counts(truth.select("dossier_id", F.col("start_page").alias("page0")), pred.select("dossier_id", F.col("start_page").cast("long").alias("page0")), skip_first=True)
    at = pred.select("dossier_id", "i", F.col("type").alias("_type"), F.col("num_emails_pipeline").alias("_n"))
    both = truth.join(at, ["dossier_id", "i"], "left")
    counted = (F.col("type_gt") == "E-mail") & F.col("num_emails_gt").isNotNull()
    docs = both.groupBy("dossier_id").agg(
        F.count_if(_has(F.col("type_gt"))).alias("type_annotated"), F.count_if(_has(F.col("type_gt")) & (F.col("type_gt") == F.col("_type"))).alias("type_correct"),
        F.count_if(counted).alias("email_count_annotated"), F.count_if(counted & (F.col("num_emails_gt") == F.col("_n"))).alias("email_count_correct"),
        F.count_if(_has(F.col("date_gt"))).alias("date_count"), F.count(F.lit(1)).alias("gt_doc_count"),
    )
    day = lambda d: d.select("dossier_id", "i", "n", "subject", "sender", D.truth_date(F.coalesce("date", F.lit(""))).alias("date"))
    # only documents with annotated e-mails count
    theirs = day(pred_mails).join(true_mails.select("dossier_id", "i").distinct(), ["dossier_id", "i"], "left_semi")
    found = M.match_mails(day(true_mails), theirs, ["dossier_id", "i"])
    mails = found.groupBy("dossier_id").agg(*[F.sum(c).alias(c) for c in M.MAIL_SCORES])
    x = docs.join(pred.groupBy("dossier_id").agg(F.count(F.lit(1)).alias("pipeline_doc_count")), "dossier_id", "left").join(bounds, "dossier_id", "left").join(mails, "dossier_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    p, r, f1 = V.scores(n("tp"), n("fp"), n("fn"))
    _, _, mail_f1 = V.scores(n("mail_tp"), n("mail_fp"), n("mail_fn"))
    rate = lambda a, b: F.try_divide(n(a), n(b))
    some = F.col("mail_tp").isNotNull()
    values = {
        "boundary_precision": p, "boundary_recall": r, "boundary_f1": f1, "boundary_tp": n("tp"), "boundary_fp": n("fp"), "boundary_fn": n("fn"),
        "type_accuracy": V.ratio(n("type_correct"), n("type_annotated")), "type_correct": n("type_correct"), "type_annotated": n("type_annotated"),
        "email_count_accuracy": rate("email_count_correct", "email_count_annotated"), "email_count_correct": n("email_count_correct"), "email_count_annotated": n("email_count_annotated"),
        "email_subject_f1": F.when(some, mail_f1), "email_date_accuracy": rate("date_correct", "date_annotated"), "email_date_correct": n("date_correct"), "email_date_annotated": n("date_annotated"),
        "email_sender_accuracy": rate("sender_correct", "sender_annotated"), "email_sender_correct": n("sender_correct"), "email_sender_annotated": n("sender_annotated"),
        "date_extraction_rate": V.ratio(n("date_count"), n("gt_doc_count")), "date_count": n("date_count"), "gt_doc_count": n("gt_doc_count"), "pipeline_doc_count": n("pipeline_doc_count"),
    }
    return x.select("dossier_id", *[values[m].alias(m) for m in METRICS])


def _matches(pred_type: str, pred_date: str) -> tuple[Column, Column]:
    same_type = _has(F.col("type_gt")) & F.col(pred_type).isNotNull() & (F.col("type_gt") == F.col(pred_type))
    day = lambda c: D.truth_date(F.coalesce(F.col(c), F.lit("")))
    same_day = _has(day("date_gt")) & _has(day(pred_date)) & (day("date_gt") == day(pred_date))
    return F.coalesce(same_type, F.lit(False)), F.coalesce(same_day, F.lit(False))


def export(truth: DataFrame, pred: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """One row per true document: its annotation, the prediction at its place with type_match and date_match, and those of a second prediction (..._b)."""
    out = truth.select("dossier_id", (F.col("i") - 1).alias("doc_index"), "start_page", "end_page", *[F.coalesce(c, F.lit("")).alias(c) if c != "num_emails_gt" else F.col(c) for c in ANNOTATION])
    for rows, end in ((pred, ""), (other, "_b")):
        if rows is None:
            continue
        names = {"doc_code": f"pipeline{end}_doc_code", "type": f"pipeline{end}_type", "date_raw": f"pipeline{end}_date", "method": f"pipeline{end}_method", "num_emails_pipeline": f"num_emails_pipeline{end}", "date_iso": "_iso"}
        out = out.join(rows.select("dossier_id", (F.col("i") - 1).alias("doc_index"), *[F.col(a).alias(b) for a, b in names.items()]), ["dossier_id", "doc_index"], "left")
        kind, day = _matches(names["type"], "_iso")
        out = out.withColumn(f"type_match{end}", kind).withColumn(f"date_match{end}", day).drop("_iso")
    return out


#: Columns of the evaluation run that are averaged over dossiers.
RUN = ["p_exact", "r_exact", "f1_exact", "p_near", "r_near", "f1_near", "rq", "sq", "pq", "type_accuracy"]


def evaluation_run(truth: DataFrame, predictions: dict[str, DataFrame], totals: DataFrame, labels: DataFrame, types: dict[str, DataFrame]) -> DataFrame:
    """pipeline, dossier_id (as text, and ALL for the mean) and RUN: exact and tolerant boundaries, panoptic quality and type accuracy.

    truth and predictions: dossier_id, page0. labels: dossier_id, page0, gt; types: by pipeline dossier_id, page0, label.
    A dossier without typed documents has type accuracy 0.
    """
    out = None
    for name, pred in predictions.items():
        exact = V.page_metrics(truth, pred).select("dossier_id", *[F.col(a).alias(b) for a, b in zip(("precision", "recall", "f1"), RUN[:3])])
        near = V.tolerant_metrics(truth, pred, 1).select("dossier_id", *[F.col(a).alias(b) for a, b in zip(("precision", "recall", "f1"), RUN[3:6])])
        quality = V.panoptic(*V.truth_and_prediction(truth, pred, totals)).select("dossier_id", "rq", "sq", "pq")
        typed = labels.join(types[name], ["dossier_id", "page0"]).groupBy("dossier_id").agg(F.avg((F.col("gt") == F.col("label")).cast("double")).alias("type_accuracy"))
        per = exact.join(near, "dossier_id").join(quality, "dossier_id").join(typed, "dossier_id", "left").na.fill(0.0, ["type_accuracy"])
        rows = V.with_macro(per, RUN).select(F.lit(name).alias("pipeline"), "dossier_id", *RUN)
        out = rows if out is None else out.unionByName(rows)
    return out


def next_open(documents: DataFrame, current: Column) -> DataFrame:
    """dossier_id, i: the next document after the current one (its place, from 0) without a type, wrapping round."""
    n = F.count(F.lit(1)).over(Window.partitionBy("dossier_id"))
    rows = documents.withColumn("_n", n).withColumn("_d", F.pmod(F.col("i") - current - 1, F.col("_n")))
    return rows.where(~_has(F.col("type_gt"))).groupBy("dossier_id").agg(F.min_by("i", "_d").alias("i"))


def status(type_gt: Column, date_gt: Column, pred_type: Column, pred_date: Column) -> Column:
    """grey without annotation or prediction; green, yellow or red as both, one or none of type and date agree."""
    kind, day = (F.coalesce(_has(a) & (a == b), F.lit(False)) for a, b in ((type_gt, pred_type), (date_gt, pred_date)))
    nothing = (~_has(type_gt) & ~_has(date_gt)) | pred_type.isNull()
    return F.when(nothing, "grey").when(kind & day, "green").when(kind | day, "yellow").otherwise("red")
