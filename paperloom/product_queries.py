"""Registered queries of the product, annotation, profile and page-scan plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluate as V
from .operators import sequence as S
from .plans import annotation as A
from .plans import dossier as P
from .plans import product as R
from .plans import profile as H
from .queries import _AT, _FILL2, _IOU, _MAJ, _NEW, _NORM, _SEGS, _TOL, _TYPED, _metrics_sql, _typed, evaluation, page_query, query
from .sources import fixtures as FX
from .sources import page_scans as Z

# -- annotation: made of the pages at which documents start ------------------------------------------

#: Annotation of the true document that starts at a page, and the prediction that starts there; the same in Spark and SQL.
_ANN = {
    "type_gt": "CASE WHEN okey % 2 = 0 THEN category END",
    "date_gt": "CASE okey % 4 WHEN 0 THEN '18-09-2025' WHEN 1 THEN '2025-03-0' || cast(1 + okey % 3 as string) WHEN 2 THEN '3 maart 2025' END",
    "num_emails_gt": "CASE WHEN category = 'E-mail' AND okey % 3 <> 0 THEN okey % 4 END",
    "notes": "CASE WHEN okey % 7 = 0 THEN 'nazien' END",
    "other_type": "cast(NULL as string)",
}
_PRED = {
    "doc_code": "coalesce(detected_code, 'geen')",
    "type": "category",
    "date_raw": "CASE WHEN okey % 3 = 0 THEN '18-09-2025' ELSE '2025-03-03' END",
    "date_iso": "CASE WHEN okey % 3 = 0 THEN '2025-09-18' ELSE '2025-03-03' END",
    "method": "'stamp'",
    "num_emails_pipeline": "okey % 3",
}
_ANN_SQL = "ann AS (SELECT g.dossier_id, g.i, g.lo AS start_page, g.hi - 1 AS end_page, p.okey, " + ", ".join(f"{v} AS {k}" for k, v in _ANN.items()) + " FROM gseg g JOIN fx_pages p ON g.dossier_id = p.dossier_id AND g.lo = p.page_num - 1)"
_PRED_SQL = "pre AS (SELECT g.dossier_id, g.i, g.lo AS start_page, p.okey, " + ", ".join(f"{v} AS {k}" for k, v in _PRED.items()) + " FROM pseg g JOIN fx_pages p ON g.dossier_id = p.dossier_id AND g.lo = p.page_num - 1)"
#: E-mails of a document: subjects and senders of one repeated letter are either the same or have nothing in common.
_MAILS = {
    "true": ("okey % 3", "repeat(chr(cast(97 + (okey + n) % 5 as int)), 6)", "CASE WHEN (okey + n) % 4 <> 0 THEN repeat(chr(cast(97 + (okey * n) % 3 as int)), 5) END", "CASE WHEN n % 3 <> 0 THEN '0' || cast(n as string) || '-05-2024' END"),
    "pred": ("okey % 4", "repeat(chr(cast(97 + (okey + 2 * n) % 5 as int)), 6)", "repeat(chr(cast(97 + (okey + n) % 3 as int)), 5)", "'2024-05-0' || cast(1 + (n + okey) % 3 as string)"),
}


def _lists(t: DataFrame, q: DataFrame, p: DataFrame) -> tuple[DataFrame, DataFrame]:
    at = p.withColumn("start_page", F.col("page_num") - 1)
    ann = at.join(t, (at["dossier_id"] == t["dossier_id"]) & (at["start_page"] == t["page0"])).select(at["dossier_id"], "start_page", "okey", *[F.expr(v).alias(k) for k, v in _ANN.items()])
    truth = A.true_documents(t, FX.totals(p), ann).join(ann.select("dossier_id", "start_page", "okey"), ["dossier_id", "start_page"])
    spans = S.intervals(q, FX.totals(p)).select("dossier_id", "i", F.col("lo").alias("start_page"))
    pred = spans.join(at, ["dossier_id", "start_page"]).select("dossier_id", "i", "start_page", "okey", *[F.expr(v).alias(k) for k, v in _PRED.items()])
    return truth, pred


def _mails(docs: DataFrame, kind: str) -> DataFrame:
    n, subject, sender, date = _MAILS[kind]
    each = docs.select("dossier_id", "i", "okey", F.explode(F.expr(f"CASE WHEN {n} > 0 THEN sequence(1L, {n}) ELSE array() END")).alias("n"))
    return each.select("dossier_id", "i", F.col("n").cast("int").alias("n"), F.expr(subject).alias("subject"), F.expr(sender).alias("sender"), F.expr(date).alias("date"))


def _mails_sql(name: str, kind: str, docs: str) -> str:
    n, subject, sender, date = (x.replace("as string", "as varchar") for x in _MAILS[kind])
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY dossier_id, i, subject ORDER BY n) AS k FROM (SELECT dossier_id, i, n, {subject} AS subject, {sender} AS sender, {date} AS date
 FROM (SELECT dossier_id, i, okey, unnest(range(1, {n} + 1)) AS n FROM {docs})))"""


_DAY = "CASE WHEN regexp_matches({x}, '^\\d\\d-') THEN {x}[7:10] || '-' || {x}[4:5] || '-' || {x}[1:2] WHEN {x} = '3 maart 2025' THEN '2025-03-03' ELSE coalesce({x}, '') END"
_R0 = "coalesce({a} / nullif({b}, 0), 0.0)"
_METRICS_SQL = f"""SELECT d.dossier_id, precision AS boundary_precision, recall AS boundary_recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS boundary_f1, coalesce(tp, 0) AS boundary_tp, coalesce(fp, 0) AS boundary_fp, coalesce(fn, 0) AS boundary_fn,
 {_R0.format(a='type_correct', b='type_annotated')} AS type_accuracy, type_correct, type_annotated, email_count_correct / nullif(email_count_annotated, 0) AS email_count_accuracy, email_count_correct, email_count_annotated,
 CASE WHEN mtp IS NOT NULL THEN coalesce(2.0 * mtp / nullif(2 * mtp + mfp + mfn, 0), 0.0) END AS email_subject_f1, date_correct / nullif(date_annotated, 0) AS email_date_accuracy, coalesce(date_correct, 0) AS email_date_correct, coalesce(date_annotated, 0) AS email_date_annotated,
 sender_correct / nullif(sender_annotated, 0) AS email_sender_accuracy, coalesce(sender_correct, 0) AS email_sender_correct, coalesce(sender_annotated, 0) AS email_sender_annotated,
 {_R0.format(a='date_count', b='gt_doc_count')} AS date_extraction_rate, date_count, gt_doc_count, pipeline_doc_count
 FROM (SELECT a.dossier_id, count(type_gt) AS type_annotated, count(CASE WHEN type_gt = p.type THEN 1 END) AS type_correct, count(CASE WHEN type_gt = 'E-mail' AND num_emails_gt IS NOT NULL THEN 1 END) AS email_count_annotated,
  count(CASE WHEN type_gt = 'E-mail' AND num_emails_gt = num_emails_pipeline THEN 1 END) AS email_count_correct, count(date_gt) AS date_count, count(*) AS gt_doc_count FROM ann a LEFT JOIN pre p ON a.dossier_id = p.dossier_id AND a.i = p.i GROUP BY 1) d
 JOIN (SELECT dossier_id, count(*) AS pipeline_doc_count FROM pre GROUP BY 1) n ON d.dossier_id = n.dossier_id
 LEFT JOIN (SELECT dossier_id, tp, fp, fn, precision, recall FROM m UNION ALL SELECT dossier_id, 0, 0, 0, 0.0, 0.0 FROM fx_total WHERE dossier_id NOT IN (SELECT dossier_id FROM m)) m ON d.dossier_id = m.dossier_id
 LEFT JOIN (SELECT dossier_id, CAST(sum(tp) AS BIGINT) AS mtp, CAST(sum(np - tp) AS BIGINT) AS mfp, CAST(sum(nt - tp) AS BIGINT) AS mfn, CAST(sum(dc) AS BIGINT) AS date_correct, CAST(sum(da) AS BIGINT) AS date_annotated, CAST(sum(sc) AS BIGINT) AS sender_correct, CAST(sum(sa) AS BIGINT) AS sender_annotated FROM (
  SELECT t.dossier_id, t.i, count(*) AS nt, count(p.n) AS tp, (SELECT count(*) FROM mp x WHERE x.dossier_id = t.dossier_id AND x.i = t.i) AS np, count(CASE WHEN p.n IS NOT NULL AND t.date IS NOT NULL THEN 1 END) AS da,
  count(CASE WHEN {_DAY.format(x='t.date')} = p.date THEN 1 END) AS dc, count(CASE WHEN p.n IS NOT NULL AND t.sender IS NOT NULL THEN 1 END) AS sa, count(CASE WHEN t.sender = p.sender THEN 1 END) AS sc
  FROM mt t LEFT JOIN mp p ON t.dossier_id = p.dossier_id AND t.i = p.i AND t.subject = p.subject AND t.k = p.k GROUP BY 1, 2) GROUP BY 1) e ON d.dossier_id = e.dossier_id"""


@evaluation("agg25_annotation_metrics", _METRICS_SQL, _SEGS, _ANN_SQL.replace("as string", "as varchar"), _PRED_SQL, _mails_sql("mt", "true", "ann"), _mails_sql("mp", "pred", "pre"), _metrics_sql("WHERE page0 > 0"))
def _annotation_metrics(t: DataFrame, q: DataFrame, p: DataFrame) -> DataFrame:
    truth, pred = _lists(t, q, p)
    return A.metrics(truth, pred, _mails(truth, "true"), _mails(pred, "pred"))


_EXPORT_SQL = f"""SELECT a.dossier_id, a.i - 1 AS doc_index, a.start_page, a.end_page, coalesce(type_gt, '') AS type_gt, coalesce(date_gt, '') AS date_gt, num_emails_gt, coalesce(notes, '') AS notes, '' AS other_type,
 {", ".join(f"{x}.doc_code AS pipeline{e}_doc_code, {x}.type AS pipeline{e}_type, {x}.date_raw AS pipeline{e}_date, {x}.method AS pipeline{e}_method, {x}.num_emails_pipeline AS num_emails_pipeline{e}, coalesce(type_gt = {x}.type, false) AS type_match{e}, coalesce(date_gt IS NOT NULL AND {_DAY.format(x='date_gt')} = {x}.date_iso, false) AS date_match{e}" for x, e in (("p", ""), ("b", "_b")))}
 FROM ann a LEFT JOIN pre p ON a.dossier_id = p.dossier_id AND a.i = p.i LEFT JOIN pre b ON a.dossier_id = b.dossier_id AND a.i = b.i - 1"""


@evaluation("snk5_export", _EXPORT_SQL, _SEGS, _ANN_SQL.replace("as string", "as varchar"), _PRED_SQL)
def _export(t: DataFrame, q: DataFrame, p: DataFrame) -> DataFrame:
    truth, pred = _lists(t, q, p)
    return A.export(truth, pred, pred.withColumn("i", F.col("i") - 1))


_STATUS = "CASE WHEN (type_gt IS NULL AND date_gt IS NULL) OR p.type IS NULL THEN 'grey' WHEN coalesce(type_gt = p.type, false) AND coalesce(date_gt = date_raw, false) THEN 'green' WHEN coalesce(type_gt = p.type, false) OR coalesce(date_gt = date_raw, false) THEN 'yellow' ELSE 'red' END"


@evaluation("flt22_document_status", f"SELECT a.dossier_id, a.i, {_STATUS} AS status FROM ann a LEFT JOIN pre p ON a.dossier_id = p.dossier_id AND a.i = p.i", _SEGS, _ANN_SQL.replace("as string", "as varchar"), _PRED_SQL)
def _status(t: DataFrame, q: DataFrame, p: DataFrame) -> DataFrame:
    truth, pred = _lists(t, q, p)
    return truth.join(pred.select("dossier_id", "i", "type", "date_raw"), ["dossier_id", "i"], "left").select("dossier_id", "i", A.status(*map(F.col, ("type_gt", "date_gt", "type", "date_raw"))).alias("status"))


@evaluation("flt21_next_open_document", "SELECT dossier_id, arg_min(i - 1, (i - 1 - 2 - 1 + n + n) % n) AS i FROM (SELECT *, count(*) OVER (PARTITION BY dossier_id) AS n FROM ann) WHERE type_gt IS NULL GROUP BY 1", _SEGS, _ANN_SQL.replace("as string", "as varchar"))
def _next_open(t: DataFrame, q: DataFrame, p: DataFrame) -> DataFrame:
    truth, _ = _lists(t, q, p)
    return A.next_open(truth.withColumn("i", F.col("i") - 1), F.lit(2))


# -- the evaluation run of two pipelines --------------------------------------------------------------

_RUN_SQL = """SELECT '{n}' AS pipeline, CAST(m.dossier_id AS VARCHAR) AS dossier_id, m.precision AS p_exact, m.recall AS r_exact, coalesce(2 * m.precision * m.recall / nullif(m.precision + m.recall, 0), 0.0) AS f1_exact,
 l.tp / l.np AS p_near, l.tp / l.nt AS r_near, 2 * l.tp / (l.np + l.nt) AS f1_near, 2 * coalesce(h.c, 0) / (l.np + l.nt) AS rq, coalesce(h.s / h.c, 0.0) AS sq, 2 * coalesce(h.c, 0) / (l.np + l.nt) * coalesce(h.s / h.c, 0.0) AS pq, coalesce(t.a, 0.0) AS type_accuracy
 FROM m JOIN tol l ON m.dossier_id = l.dossier_id LEFT JOIN (SELECT dossier_id, count(*) AS c, sum(iou) AS s FROM hits WHERE iou > 0.5 GROUP BY 1) h ON m.dossier_id = h.dossier_id
 LEFT JOIN (SELECT m.dossier_id, avg(CAST(m.label = a.label AS INTEGER)) AS a FROM maj m JOIN typeat a ON m.dossier_id = a.dossier_id AND m.lo = a.page0 GROUP BY 1) t ON m.dossier_id = t.dossier_id"""
_OTHER = "SELECT dossier_id, page_num - 1 AS page0 FROM fx_pages WHERE page_num = 1 OR okey % 4 = 1"


def _run_ctes(end: str) -> list[str]:
    """The evaluation's CTEs for the predictions fx_pred or, with an end, for the other ones under names of their own."""
    parts = [_SEGS.split(" pseg AS ")[1], _metrics_sql(), _TOL, _IOU, _TYPED, _AT]
    parts = ["pseg AS " + parts[0], *parts[1:]]
    names = ["pseg", "m", "tol", "hits", "ptype", "typeat"]
    out = []
    for x, name in zip(parts, names):
        for k in names:
            x = x.replace(f"{k} AS (", f"{k}{end} AS (", 1) if k == name else x.replace(f"FROM {k} ", f"FROM {k}{end} ").replace(f"JOIN {k} ", f"JOIN {k}{end} ")
        out.append(x.replace("fx_pred", f"fx_pred{end}"))
    return out


def _run_sql(end: str, name: str) -> str:
    x = _RUN_SQL.replace("{n}", name)
    for k in ("m", "tol", "hits", "typeat"):
        x = x.replace(f"FROM {k} ", f"FROM {k}{end} ").replace(f"JOIN {k} ", f"JOIN {k}{end} ")
    return x.replace(f"FROM m{end} JOIN", f"FROM m{end} m JOIN") if end else x


_ALL = "SELECT pipeline, 'ALL', " + ", ".join(f"avg({c})" for c in A.RUN) + " FROM run GROUP BY 1"


@evaluation("cmp6_evaluation_run", f"SELECT * FROM run UNION ALL {_ALL}", _SEGS.split(" pseg AS ")[0].rstrip().rstrip(","), _MAJ, *_run_ctes(""), f"fx_pred2 AS ({_OTHER})", *_run_ctes("2"), f"run AS ({_run_sql('', 'A')} UNION ALL {_run_sql('2', 'B')})")
def _run(t: DataFrame, q: DataFrame, p: DataFrame) -> DataFrame:
    both = {"A": q, "B": p.where("page_num = 1 or okey % 4 = 1").select("dossier_id", (F.col("page_num") - 1).alias("page0"))}
    labels = V.majority_type(S.intervals(t, n := FX.totals(p)), p).select("dossier_id", F.col("lo").alias("page0"), F.col("label").alias("gt"))
    return A.evaluation_run(t, both, n, labels, {k: V.type_at(t, _typed(x, p)) for k, x in both.items()})


# -- finished documents, segments, JSON -----------------------------------------------------------------

page_query(
    "cmp2_finalised",
    """SELECT f.dossier_id, f.doc_code, count(*) AS n_pages, md5(string_agg(text, chr(10) || chr(10) ORDER BY page_num)) AS text_md5, coalesce(min_by(category, page_num) FILTER (WHERE category <> 'Other'), 'Other') AS category,
 coalesce(min_by(sub0, page_num) FILTER (WHERE sub0 IS NOT NULL), CASE coalesce(min_by(category, page_num) FILTER (WHERE category <> 'Other'), 'Other') WHEN 'E-mail' THEN 'email' WHEN 'Nota' THEN 'nota' WHEN 'Brief' THEN 'brief' WHEN 'Report' THEN 'rapport' WHEN 'Vergadernotulen' THEN 'vergaderverslag' ELSE 'other' END) AS doc_subtype,
 min_by(doc_date, page_num) FILTER (WHERE doc_date IS NOT NULL) AS doc_date, CAST(sum(len(regexp_extract_all(text, '(?i)5\\.[12]\\.[1-9][a-z]{0,2}'))) AS BIGINT) AS n_redactions, max(c.chat_name) AS chat_name
 FROM (SELECT *, CASE WHEN okey % 9 = 0 THEN 'factuur' END AS sub0 FROM fill2) f LEFT JOIN (SELECT dossier_id, doc_code, arg_max(chat_name, (n, -f)) AS chat_name FROM (SELECT dossier_id, doc_code, 'chat' || (okey % 3) AS chat_name, count(*) AS n, min(page_num) AS f FROM fill2 WHERE okey % 2 = 0 GROUP BY 1, 2, 3) GROUP BY 1, 2) c
 ON f.dossier_id = c.dossier_id AND f.doc_code = c.doc_code GROUP BY 1, 2""",
    _FILL2,
)(lambda p: R.finalised(S.forward_fill_split(p).withColumn("doc_subtype", F.when(F.col("okey") % 9 == 0, "factuur").otherwise("other")).withColumn("chat_name", F.when(F.col("okey") % 2 == 0, F.concat(F.lit("chat"), (F.col("okey") % 3).cast("string"))))).select(
    "dossier_id", "doc_code", F.size("pages").cast("long").alias("n_pages"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "category", "doc_subtype", "doc_date", F.size("codes").cast("long").alias("n_redactions"), "chat_name"))
page_query(
    "cmp5_dossier_statistics",
    """SELECT d.dossier_id, d.docs, d.pages, coalesce(c.codes, '') AS codes FROM (SELECT dossier_id, count(DISTINCT doc_code) AS docs, count(*) AS pages FROM fill2 GROUP BY 1) d
 LEFT JOIN (SELECT dossier_id, string_agg(code || ':' || n, ',' ORDER BY code) AS codes FROM (SELECT dossier_id, lower(unnest(regexp_extract_all(text, '(?i)5\\.[12]\\.[1-9][a-z]{0,2}'))) AS code, count(*) AS n FROM fill2 GROUP BY 1, 2) GROUP BY 1) c ON d.dossier_id = c.dossier_id""",
    _FILL2,
)(lambda p: R.statistics(R.finalised(S.forward_fill_split(p))).select("dossier_id", "docs", "pages", F.array_join(F.transform(F.array_sort(F.map_entries("redactionCodes")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("codes")))
_SEG_SQL = f"""SELECT dossier_id, row_number() OVER (PARTITION BY dossier_id ORDER BY start_page) AS i, CASE WHEN det IS NULL THEN 'unknown_' || sum(CASE WHEN det IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY dossier_id ORDER BY start_page ROWS UNBOUNDED PRECEDING) ELSE det END AS doc_code,
 start_page, end_page, type, CASE WHEN det IS NULL THEN 'boundary' ELSE 'stamp' END AS method FROM (SELECT dossier_id, seg, min_by(coalesce(detected_code, '-'), page_num) AS d, nullif(min_by(coalesce(detected_code, '-'), page_num), '-') AS det, min(page_num) - 1 AS start_page, max(page_num) - 1 AS end_page, min_by(category, page_num) AS type FROM (
 SELECT *, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY dossier_id ORDER BY page_num ROWS UNBOUNDED PRECEDING) AS seg FROM (
 SELECT *, page_num = 1 OR (detected_code IS NOT NULL AND (detected_code IS DISTINCT FROM st OR {_NEW})) OR (detected_code IS NULL AND {_NEW}) AS s FROM (
 SELECT *, last_value(CASE WHEN detected_code IS NOT NULL OR {_NEW} OR page_num = 1 THEN coalesce(detected_code, '-') END IGNORE NULLS) OVER (PARTITION BY dossier_id ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM fx_pages))) GROUP BY 1, 2)"""
page_query("seg6_cache_segments", _SEG_SQL)(lambda p: R.cache_segments(p).select("dossier_id", "i", "doc_code", "start_page", "end_page", "type", "method"))
page_query("seg6_segments_with_emails")(lambda p: R.cache_segments(p).withColumn("emails_pipeline", F.to_json("emails_pipeline")))
page_query("snk6_dossier_json")(lambda p: R.dossier_json(R.finalised(S.forward_fill_split(p), started=True)))

# -- profile, hints, scans ----------------------------------------------------------------------------------

_RAW = "CASE okey % 10 WHEN 0 THEN NULL WHEN 1 THEN cast(100000 + okey % 7 as string) ELSE detected_code END"
page_query(
    "udf8_profile",
    """SELECT r.dossier_id, CASE WHEN c.n_distinct IS NULL THEN 'none' WHEN l.four THEN '4-digit' WHEN l.dominant <= 6 THEN '6-digit' ELSE '7-digit' END AS stamp_format, coalesce(c.repeated, c.first) AS stamp_example, coalesce(c.n_distinct, 0) AS n_distinct, r.n_pages
 FROM (SELECT dossier_id, count(*) AS n_pages FROM raw GROUP BY 1) r LEFT JOIN (SELECT dossier_id, arg_max(code, (n, -f)) FILTER (WHERE n >= 2) AS repeated, arg_min(code, f) AS first, count(*) AS n_distinct FROM (SELECT dossier_id, code, count(*) AS n, min(page_num) AS f FROM (SELECT *, """
    + _NORM.format(x="raw_code") + """ AS code FROM raw) WHERE code IS NOT NULL GROUP BY 1, 2) GROUP BY 1) c ON r.dossier_id = c.dossier_id
 LEFT JOIN (SELECT dossier_id, arg_max(l, (n, -f)) AS dominant, bool_or(l = 4) AS four FROM (SELECT dossier_id, length(raw_code) AS l, count(*) AS n, min(page_num) AS f FROM raw WHERE raw_code IS NOT NULL GROUP BY 1, 2) GROUP BY 1) l ON r.dossier_id = l.dossier_id""",
    f"raw AS (SELECT dossier_id, page_num, {_RAW.replace('as string', 'as varchar')} AS raw_code FROM fx_pages)",
)(lambda p: H.profile(p.select("dossier_id", "page_num", F.expr(_RAW).alias("raw_code"))))
_ENTRY = "page_num || ':' || detected_code"
page_query(
    "win14_listed_codes",
    f"""SELECT dossier_id, '  ' || CASE WHEN max(total) <= 60 THEN string_agg(e, '  ' ORDER BY page_num) ELSE concat_ws('  ', string_agg(e, '  ' ORDER BY page_num) FILTER (WHERE used <= 57), '...') END AS listed FROM (
 SELECT *, 2 + sum(length(e) + 2) OVER (PARTITION BY dossier_id ORDER BY page_num ROWS UNBOUNDED PRECEDING) AS used, sum(length(e) + 2) OVER (PARTITION BY dossier_id) AS total FROM (SELECT dossier_id, page_num, {_ENTRY} AS e FROM fx_pages WHERE detected_code IS NOT NULL)) GROUP BY 1""",
)(lambda p: p.where("detected_code is not null").groupBy("dossier_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_num", F.concat_ws(":", F.col("page_num").cast("string"), "detected_code").alias("e")))), lambda x: x["e"]).alias("e")).select("dossier_id", H.listed(F.col("e"), 57, 60).alias("listed")))
page_query("prj7_profile_hint")(lambda p: H.profile(p.select("dossier_id", "page_num", F.expr(_RAW).alias("raw_code"))).select("dossier_id", H.profile_hint(F.col("stamp_format"), F.col("stamp_example")).alias("hint")))
page_query("prj7_survey_hint")(lambda p: H.survey_hint(p, P.survey(p).join(P.coverage(p).select("dossier_id", "coverage", "distinct_codes"), "dossier_id"), S.large_jumps(p, "detected_code")))
page_query(
    "udf6_recovered_stamps",
    "SELECT p.dossier_id, p.page_num, coalesce(p.detected_code, CASE WHEN s.c >= 2 AND okey % 3 = 0 THEN lpad(CAST(1 + okey % 90 AS VARCHAR), 4, '0') END) AS detected_code FROM fx_pages p LEFT JOIN (SELECT dossier_id, count(DISTINCT detected_code) AS c FROM fx_pages GROUP BY 1) s ON p.dossier_id = s.dossier_id",
)(lambda p: Z.recovered(p, p.where("okey % 3 = 0").select("dossier_id", "page_num", F.lpad((1 + F.col("okey") % 90).cast("string"), 4, "0").alias("code"))).select("dossier_id", "page_num", "detected_code"))
_ITEMS = "CASE p_partkey % 4 WHEN 0 THEN '{\"items\": [{\"code\": \"' || lpad(cast(p_partkey % 60 as string), 4, '0') || '\", \"title\": \"t' || cast(p_partkey as string) || '\", \"pages\": 2}, {\"title\": \"los\"}]}' END"
_INV_LINE = "lpad(cast(p_partkey % 90 as string), 4, '0') || ' ' || p_name"


@query(
    "src5_inventory_items",
    f"""SELECT dossier_id, code, title FROM (SELECT *, row_number() OVER (PARTITION BY dossier_id, code ORDER BY page_num, k) AS r FROM (
 SELECT p_partkey % 10 AS dossier_id, p_partkey AS page_num, 0 AS k, lpad(CAST(p_partkey % 60 AS VARCHAR), 4, '0') AS code, 't' || p_partkey AS title FROM part WHERE p_partkey % 4 = 0 AND p_partkey >= 9
 UNION ALL SELECT p_partkey % 10, p_partkey, 0, lpad(CAST(p_partkey % 90 AS VARCHAR), 4, '0'), rtrim(p_name, '.,') FROM part WHERE p_partkey % 4 <> 0 AND p_partkey >= 9)) WHERE r = 1
 UNION ALL SELECT p_partkey % 10, NULL, 'los' FROM part WHERE p_partkey % 4 = 0 AND p_partkey >= 9""",
)
def _inventory(spark: SparkSession, sf: str) -> DataFrame:
    pages = FX.read(spark, sf, "part").select((F.col("p_partkey") % 10).alias("dossier_id"), F.col("p_partkey").alias("page_num"), F.expr(_ITEMS).alias("answer"), F.expr(_INV_LINE).alias("text"))
    return Z.inventory_items(pages, first=9).select("dossier_id", "code", "title")
