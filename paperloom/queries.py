"""The registered queries of the dossier operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import dates as D
from .functions import repair
from .functions import text as T
from .operators import emails as E
from .operators import evaluate as V
from .operators import match as M
from .operators import regions as R
from .operators import sequence as S
from .plans import dossier as P
from .sources import dossier_files as DF
from .sources import fixtures as FX

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The rows of a document: pages with a code by the stamps' forward fill.
_FILL = """fill AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY dossier_id ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unknown') AS doc_code
 FROM (SELECT *, coalesce(detected_code, CASE WHEN u THEN 'unknown_' || CAST(sum(CASE WHEN u THEN 1 ELSE 0 END) OVER (PARTITION BY dossier_id ORDER BY page_num ROWS UNBOUNDED PRECEDING) AS VARCHAR) END) AS own
 FROM (SELECT *, detected_code IS NULL AND (coalesce(within_doc_page, 0) = 1 OR regexp_matches(text, '(?i)\\bpagina\\s+1\\s+van\\b'))
 AND coalesce(max(CASE WHEN detected_code IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY dossier_id ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS u FROM fx_pages)))"""
_NEW = "((is_new_document OR coalesce(within_doc_page, 0) = 1) AND coalesce(within_doc_page, 1) = 1)"
_SEGS = (
    "gseg AS (SELECT g.dossier_id, page0 AS lo, coalesce(lead(page0) OVER (PARTITION BY g.dossier_id ORDER BY page0), n) AS hi, row_number() OVER (PARTITION BY g.dossier_id ORDER BY page0) AS i FROM fx_gt g JOIN fx_total t ON g.dossier_id = t.dossier_id),"
    " pseg AS (SELECT p.dossier_id, page0 AS lo, coalesce(lead(page0) OVER (PARTITION BY p.dossier_id ORDER BY page0), n) AS hi, row_number() OVER (PARTITION BY p.dossier_id ORDER BY page0) AS i FROM fx_pred p JOIN fx_total t ON p.dossier_id = t.dossier_id)"
)


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join((FX.SQL_PAGES, *ctes)) + " "


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def page_query(name: str, sql: str | None = None, *ctes: str):
    """A query over the page view alone."""

    def add(f: Callable[[DataFrame], DataFrame]) -> None:
        query(name, _with(*ctes) + sql if sql else None)(lambda spark, sf: f(FX.pages(spark, sf)))

    return add


def scalar(name: str, spark_input: str, duck_input: str, table: str, key: str, sql: str) -> Callable:
    """A query of one column function ``f(x)`` over x made from a driver table; sql is the same in DuckDB, of x."""

    def add(f: Callable[[Column], Column]) -> None:
        made = f"SELECT k, {sql} AS y FROM (SELECT {key} AS k, {duck_input} AS x FROM {table})"
        query(name, made)(lambda spark, sf: FX.read(spark, sf, table).select(F.expr(key).alias("k"), F.expr(spark_input).alias("x")).select("k", f(F.col("x")).alias("y")))

    return add


def same(name: str, x: str, table: str, key: str, sql: str) -> Callable:
    return scalar(name, x, x, table, key, sql)


# -- sequence ---------------------------------------------------------------------------------

page_query("win1_forward_fill", "SELECT dossier_id, page_num, doc_code FROM fill", _FILL)(lambda p: S.forward_fill(p).select("dossier_id", "page_num", "doc_code"))

_FILL2 = f"""a2 AS (SELECT *, detected_code IS NULL AND ({_NEW} OR page_num = 1) AS slot FROM fx_pages),
 b2 AS (SELECT *, last_value(CASE WHEN detected_code IS NOT NULL OR slot THEN coalesce(detected_code, '-') END IGNORE NULLS) OVER (PARTITION BY dossier_id ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stamp FROM a2),
 c2 AS (SELECT *, detected_code IS NOT NULL AND detected_code IS DISTINCT FROM stamp AS chg FROM b2),
 d2 AS (SELECT *, detected_code IS NOT NULL AND NOT chg AND {_NEW} AND category IN ('Nota', 'Brief', 'Report', 'Vergadernotulen') AS sub FROM c2),
 e2 AS (SELECT *, CASE WHEN slot THEN 'unknown_' || CAST(sum(CASE WHEN slot THEN 1 ELSE 0 END) OVER (PARTITION BY dossier_id ORDER BY page_num ROWS UNBOUNDED PRECEDING) AS VARCHAR)
  WHEN sub THEN detected_code || '_' || CAST(1 + sum(CASE WHEN sub THEN 1 ELSE 0 END) OVER (PARTITION BY dossier_id, detected_code ORDER BY page_num ROWS UNBOUNDED PRECEDING) AS VARCHAR)
  WHEN chg THEN detected_code END AS own FROM d2),
 fill2 AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY dossier_id ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS doc_code FROM e2)"""
page_query("win2_forward_fill_split", "SELECT dossier_id, page_num, doc_code FROM fill2", _FILL2)(lambda p: S.forward_fill_split(p).select("dossier_id", "page_num", "doc_code"))

_AUTO = f"auto AS (SELECT *, 'auto_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS auto_code FROM (SELECT *, sum(CASE WHEN page_num = 1 OR {_NEW} THEN 1 ELSE 0 END) OVER (PARTITION BY dossier_id ORDER BY page_num ROWS UNBOUNDED PRECEDING) AS n FROM fx_pages))"
page_query("win3_boundary_numbers", "SELECT dossier_id, page_num, auto_code AS doc_code FROM auto", _AUTO)(lambda p: S.boundary_numbers(p, T.is_new_vlm(F.col("is_new_document"), F.col("within_doc_page"))).select("dossier_id", "page_num", "doc_code"))

_LINES = "string_split(text, chr(10))"
_EF, _MF = T.EMAIL_PAGE_FIELDS, T.MEMO_PAGE_FIELDS


def _fresh_sql(field: str, veto: str, n: int) -> str:
    first = f"list_filter({_LINES}, lambda x: regexp_matches(x, '\\S'))[1]"
    return f"(({first} IS NULL OR regexp_matches({first}, '{veto}')) AND len(list_filter({_LINES}[1:{n}], lambda x: regexp_matches(x, '{field}'))) >= 2)"


_E_FIELD, _M_FIELD = rf"(?i)^[ \t]*(?:{_EF})\s*:", rf"(?i)^[ \t]*(?:{_MF})\s*:"
_STARTS_EMAIL = _fresh_sql(_E_FIELD, rf"(?i)^[ \t]*(?:(?:{_EF})\s*:|\d{{4}}|[do]ocn[r,]?\s*[\ds]+)", 20)
_STARTS_MEMO = _fresh_sql(_M_FIELD, _M_FIELD, 15)
_MARKS = r"(coalesce(within_doc_page, 0) = 1 OR regexp_matches(text, '(?i)\bpagina\s+1\s+van\b'))"
page_query("flt4_new_document_marks", f"SELECT dossier_id, page_num, {_MARKS} AS marked FROM fx_pages")(lambda p: p.select("dossier_id", "page_num", T.marks_new_document(F.col("within_doc_page"), F.col("text")).alias("marked")))
page_query("flt5_fresh_email", f"SELECT dossier_id, page_num, {_STARTS_EMAIL} AS fresh FROM fx_pages")(lambda p: p.select("dossier_id", "page_num", T.starts_email(F.col("text")).alias("fresh")))
page_query("flt6_fresh_memo", f"SELECT dossier_id, page_num, {_STARTS_MEMO} AS fresh FROM fx_pages")(lambda p: p.select("dossier_id", "page_num", T.starts_memo(F.col("text")).alias("fresh")))
page_query("flt7_auto_split", f"SELECT dossier_id, page_num, (page_num = 1 OR {_MARKS} OR {_STARTS_EMAIL} OR {_STARTS_MEMO}) AS starts FROM fx_pages")(lambda p: S.split_signals(p).select("dossier_id", "page_num", "starts"))
page_query("flt8_is_new_vlm", f"SELECT dossier_id, page_num, {_NEW} AS is_new FROM fx_pages")(lambda p: p.select("dossier_id", "page_num", T.is_new_vlm(F.col("is_new_document"), F.col("within_doc_page")).alias("is_new")))

page_query(
    "win4_contiguous_segments",
    f"""SELECT dossier_id, page_num, CAST(sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY dossier_id ORDER BY page_num ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg FROM (
 SELECT *, page_num = 1 OR (detected_code IS NOT NULL AND (detected_code IS DISTINCT FROM st OR {_NEW})) OR (detected_code IS NULL AND {_NEW}) AS s FROM (
 SELECT *, last_value(CASE WHEN detected_code IS NOT NULL OR {_NEW} OR page_num = 1 THEN coalesce(detected_code, '-') END IGNORE NULLS) OVER (PARTITION BY dossier_id ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM fx_pages))""",
)(lambda p: S.segments_of_runs(p).select("dossier_id", "page_num", "seg"))

page_query(
    "win5_evaluation_starts",
    f"""SELECT dossier_id, page_num - 1 AS page0 FROM (SELECT *, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY dossier_id) AS n FROM (
 SELECT *, page_num = 1 OR (detected_code IS NOT NULL AND (detected_code IS DISTINCT FROM nullif(st, '-') OR ({_NEW} AND category IN ('Nota', 'Brief', 'Report', 'Vergadernotulen')))) OR (detected_code IS NULL AND {_NEW} AND nullif(st, '-') IS NOT NULL) AS s FROM (
 SELECT *, last_value(CASE WHEN detected_code IS NOT NULL OR {_NEW} THEN coalesce(detected_code, '-') END IGNORE NULLS) OVER (PARTITION BY dossier_id ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM fx_pages))) WHERE s OR (n = 1 AND is_new_document)""",
)(S.evaluation_starts)

_RUNS = """runs AS (SELECT dossier_id, run, min(detected_code) AS code, min(page_num) AS start, count(*) AS length FROM (
 SELECT *, sum(CASE WHEN detected_code IS DISTINCT FROM pc THEN 1 ELSE 0 END) OVER (PARTITION BY dossier_id ORDER BY page_num ROWS UNBOUNDED PRECEDING) AS run FROM (
 SELECT *, lag(detected_code) OVER (PARTITION BY dossier_id ORDER BY page_num) AS pc FROM fx_pages WHERE detected_code IS NOT NULL)) GROUP BY 1, 2)"""
page_query("win6_run_lengths", "SELECT dossier_id, CAST(run AS BIGINT) AS run, code AS detected_code, start, length FROM runs", _RUNS)(lambda p: S.runs(p, "detected_code").select("dossier_id", F.col("run").cast("long"), "detected_code", "start", "length"))
_JUMPS = "jumps AS (SELECT * FROM (SELECT dossier_id, start AS page, lag(code) OVER (PARTITION BY dossier_id ORDER BY start) AS from_code, code AS to_code, CAST(code AS INTEGER) - CAST(lag(code) OVER (PARTITION BY dossier_id ORDER BY start) AS INTEGER) AS gap FROM runs WHERE length >= 2) WHERE gap > {})"
page_query("win7_large_jumps", "SELECT * FROM jumps", _RUNS, _JUMPS.format(0))(lambda p: S.large_jumps(p, "detected_code", 0))
query("win8_intervals", _with(FX.SQL_BOUNDS, _SEGS) + "SELECT dossier_id, lo, hi, i FROM gseg")(lambda spark, sf: S.intervals(FX.truth(p := FX.pages(spark, sf)), FX.totals(p)))

_MAILS = """mails AS (SELECT dossier_id, doc_code, n, min(page_num) AS pdf_page, string_agg(text, chr(10) || chr(10) ORDER BY page_num) AS text FROM (
 SELECT *, sum(CASE WHEN email_start OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY dossier_id, doc_code ORDER BY page_num ROWS UNBOUNDED PRECEDING) AS n FROM (
 SELECT *, row_number() OVER (PARTITION BY dossier_id, doc_code ORDER BY page_num) AS rn FROM fill)) GROUP BY 1, 2, 3)"""
page_query("win9_emails_of_pages", "SELECT dossier_id, doc_code || '.' || CAST(n AS BIGINT) AS id, pdf_page, text FROM mails", _FILL, _MAILS)(lambda p: S.emails_of_pages(S.forward_fill(p)).select("dossier_id", "id", "pdf_page", "text"))
page_query("win10_ordinal_ids", "SELECT dossier_id, page_num, doc_code || '.' || CAST(row_number() OVER (PARTITION BY dossier_id, doc_code ORDER BY page_num) AS VARCHAR) AS id FROM fill", _FILL)(
    lambda p: S.forward_fill(p).select("dossier_id", "page_num", F.concat("doc_code", F.lit("."), F.row_number().over(Window.partitionBy("dossier_id", "doc_code").orderBy("page_num")).cast("string")).alias("id"))
)
page_query(
    "win12_sample_pages",
    """SELECT dossier_id, CAST(unnest(list_sort(list_distinct(CASE WHEN n <= 8 THEN range(n) ELSE list_concat(
 list_transform(range(4), lambda i: CAST(round_even(i * ((n - 1) / 3.0), 0) AS BIGINT)), list_filter(list_transform(range(4), lambda i: greatest(0, CAST(round_even(n * 0.35, 0) AS BIGINT) - 2) + i), lambda x: x < n)) END))) AS INTEGER) AS page0 FROM fx_total""",
    FX.SQL_BOUNDS,
)(lambda p: FX.totals(p).select("dossier_id", F.explode(S.sample_pages(F.col("n").cast("int"), 8)).alias("page0")))

# -- aggregates ----------------------------------------------------------------------------------

_DOCS = "docs AS (SELECT dossier_id, doc_code, list(page_num ORDER BY page_num) AS pages, string_agg(text, chr(10) || chr(10) ORDER BY page_num) AS text FROM fill GROUP BY 1, 2)"
page_query("agg1_assemble_documents", "SELECT dossier_id, doc_code, pages[1] AS first_page, pages[-1] AS last_page, len(pages) AS n_pages, md5(text) AS text_md5 FROM docs", _FILL, _DOCS)(
    lambda p: P.assemble(S.forward_fill(p)).select("dossier_id", "doc_code", F.array_min("pages").alias("first_page"), F.array_max("pages").alias("last_page"), F.size("pages").cast("long").alias("n_pages"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
)
_OCR_CODES = r"list_transform(regexp_extract_all(text, '\b(5\.[12]\.[1-9][a-z]{0,2})\b', 1), lambda c: regexp_replace(c, '([a-z])[a-z]+$', '\1'))"
page_query("agg2_redactions_by_document", f"SELECT dossier_id, doc_code, code, count(*) AS n FROM (SELECT dossier_id, doc_code, unnest({_OCR_CODES}) AS code FROM fill) GROUP BY 1, 2, 3", _FILL)(
    lambda p: P.assemble(S.forward_fill(p)).select("dossier_id", "doc_code", F.explode("redactions").alias("code", "n"))
)
page_query(
    "agg3_larger_counts",
    rf"""SELECT dossier_id, page_num, code, max(n) AS n FROM (SELECT dossier_id, page_num, code, src, count(*) AS n FROM (
 SELECT dossier_id, page_num, 1 AS src, unnest({_OCR_CODES}) AS code FROM fx_pages UNION ALL SELECT dossier_id, page_num, 2, unnest(list_transform(regexp_extract_all(text, '(?i)5\.[12]\.[1-9][a-z]{{0,2}}'), lambda c: lower(c))) FROM fx_pages) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""",
)(lambda p: p.select("dossier_id", "page_num", F.explode(T.larger_counts(T.counted(T.redaction_codes_ocr(F.col("text"))), T.counted(T.redaction_codes_vlm(F.col("text"))))).alias("code", "n")))
page_query("agg4_redaction_totals", f"SELECT dossier_id, code, count(*) AS n FROM (SELECT dossier_id, unnest({_OCR_CODES}) AS code FROM fx_pages) GROUP BY 1, 2")(lambda p: P.redaction_totals(P.assemble(S.forward_fill(p))))
page_query(
    "agg5_first_category",
    "SELECT dossier_id, doc_code, coalesce(min_by(category, page_num) FILTER (WHERE category <> 'Other'), 'Other') AS category, min_by(doc_date, page_num) FILTER (WHERE doc_date IS NOT NULL) AS doc_date FROM fill GROUP BY 1, 2",
    _FILL,
)(lambda p: S.forward_fill(p).groupBy("dossier_id", "doc_code").agg(F.coalesce(F.min_by("category", F.when(F.col("category") != "Other", F.col("page_num"))), F.lit("Other")).alias("category"), F.min_by("doc_date", F.when(F.col("doc_date").isNotNull(), F.col("page_num"))).alias("doc_date")))
page_query("agg6_mode", "SELECT dossier_id, arg_max(category, (n, -f)) AS category FROM (SELECT dossier_id, category, count(*) AS n, min(page_num) AS f FROM fx_pages GROUP BY 1, 2) GROUP BY 1")(
    lambda p: p.groupBy("dossier_id", "category").agg(F.count(F.lit(1)).alias("n"), F.min("page_num").alias("f")).groupBy("dossier_id").agg(F.max_by("category", F.struct("n", -F.col("f"))).alias("category"))
)
_COVER = """steps AS (SELECT *, CAST(detected_code AS INTEGER) - lag(CAST(detected_code AS INTEGER)) OVER (PARTITION BY dossier_id ORDER BY page_num) AS step FROM fx_pages WHERE detected_code IS NOT NULL),
 cov AS (SELECT p.dossier_id, p.pages, coalesce(s.stamped, 0) AS stamped, coalesce(s.stamped, 0) / p.pages AS coverage, coalesce(s.dc, 0) AS distinct_codes, coalesce(s.mono, 1.0) AS monotone, coalesce(s.one, 1.0) AS step_one
 FROM (SELECT dossier_id, count(*) AS pages FROM fx_pages GROUP BY 1) p LEFT JOIN (SELECT dossier_id, count(*) AS stamped, count(DISTINCT detected_code) AS dc, avg(CAST(step >= 0 AS INTEGER)) AS mono, avg(CAST(step = 1 AS INTEGER)) AS one FROM steps GROUP BY 1) s ON p.dossier_id = s.dossier_id)"""
page_query("agg8_stamp_coverage", "SELECT * FROM cov", _COVER)(P.coverage)
page_query(
    "udf7_stamp_survey",
    """SELECT c.dossier_id, e AND NOT pc AS has_stamps, pc AS page_counter, CASE WHEN e AND NOT pc THEN lo END AS lo, CASE WHEN e AND NOT pc THEN hi END AS hi, CASE WHEN e AND NOT pc THEN coalesce(nj, 0) ELSE 0 END AS n_jumps FROM (
 SELECT *, distinct_codes >= 2 AND coverage >= 0.1 AND monotone >= 0.6 AS e, coalesce(distinct_codes >= 2 AND coverage >= 0.1 AND monotone >= 0.6 AND stamped >= 4 AND distinct_codes / nullif(stamped, 0) > 0.9 AND step_one > 0.8, false) AS pc FROM cov) c
 LEFT JOIN (SELECT dossier_id, coalesce(min(code) FILTER (WHERE length >= 2), min(code)) AS lo, coalesce(max(code) FILTER (WHERE length >= 2), max(code)) AS hi FROM runs GROUP BY 1) r ON c.dossier_id = r.dossier_id
 LEFT JOIN (SELECT dossier_id, count(*) AS nj FROM jumps GROUP BY 1) j ON c.dossier_id = j.dossier_id""",
    _COVER, _RUNS, _JUMPS.format(6),
)(P.survey)
page_query("agg26_document_ranges", "SELECT dossier_id, doc_code, min(page_num) - 1 AS start_page, max(page_num) - 1 AS end_page FROM fill GROUP BY 1, 2", _FILL)(lambda p: S.forward_fill(p).groupBy("dossier_id", "doc_code").agg((F.min("page_num") - 1).alias("start_page"), (F.max("page_num") - 1).alias("end_page")))
page_query("agg32_email_documents", "SELECT count(*) AS n FROM (SELECT dossier_id, doc_code FROM fill GROUP BY 1, 2 HAVING coalesce(min_by(category, page_num) FILTER (WHERE category <> 'Other'), 'Other') = 'E-mail')", _FILL)(
    lambda p: S.forward_fill(p).groupBy("dossier_id", "doc_code").agg(F.min_by("category", F.when(F.col("category") != "Other", F.col("page_num"))).alias("c")).agg(F.count_if(F.col("c") == "E-mail").alias("n"))
)
page_query("agg30_docnr_evidence", r"SELECT dossier_id, sum(CAST(regexp_matches(text, '(?i)docnr?\s*\d') AS INTEGER)) >= 2 AS has_labels FROM fx_pages GROUP BY 1")(lambda p: p.groupBy("dossier_id").agg((F.count_if(T.has_docnr_label(F.col("text"))) >= 2).alias("has_labels")))


def _rules_sql(t: str, fp: str) -> dict[str, str]:
    hit = lambda s, p: f"CAST(regexp_matches({s}, '{p}') AS INTEGER)"
    out = {k: " + ".join(hit(fp if k == "E-mail" else t, p) for p in v) for k, v in T.RULES.items()}
    out["Nota"] += " + 3 * " + hit(fp, r"^\s*(nota|notitie)\b")
    out["Timeline"] += " + 3 * " + hit(fp, r"^\s*tijdlijn\b") + f" + 2 * CAST(len(regexp_extract_all({t}, '{T.ANY_DATE}')) >= 5 AS INTEGER)"
    return out


_R = _rules_sql("lower(text)", "lower(text)")
_SCORED = "sc AS (SELECT dossier_id, page_num, " + ", ".join(f'({v}) AS "{k}"' for k, v in _R.items()) + " FROM fx_pages)"
_BEST = "greatest(" + ", ".join(f'"{k}"' for k in _R) + ")"
page_query("agg29_keyword_category", f"SELECT dossier_id, page_num, CASE WHEN {_BEST} = 0 THEN 'Other' " + " ".join(f"WHEN \"{k}\" = {_BEST} THEN '{k}'" for k in _R) + " END AS category FROM sc", _SCORED)(lambda p: p.select("dossier_id", "page_num", T.keyword_category(F.col("text"), F.col("text")).alias("category")))

# -- evaluation ------------------------------------------------------------------------------------


def evaluation(name: str, sql: str | None, *ctes: str):
    def add(f: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> None:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            p = FX.pages(spark, sf)
            return f(FX.truth(p), FX.predicted(p), p)

        query(name, _with(FX.SQL_BOUNDS, *ctes) + sql if sql else None)(run)

    return add


def _metrics_sql(where: str = "") -> str:
    return f"""m AS (SELECT dossier_id, tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM (
 SELECT coalesce(g.dossier_id, p.dossier_id) AS dossier_id, count(CASE WHEN g.page0 IS NOT NULL AND p.page0 IS NOT NULL THEN 1 END) AS tp, count(CASE WHEN g.page0 IS NULL THEN 1 END) AS fp, count(CASE WHEN p.page0 IS NULL THEN 1 END) AS fn
 FROM (SELECT * FROM fx_gt {where}) g FULL JOIN (SELECT * FROM fx_pred {where}) p ON g.dossier_id = p.dossier_id AND g.page0 = p.page0 GROUP BY 1))"""


_F1 = "coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1"
evaluation("agg16_page_metrics", f"SELECT *, {_F1} FROM m", _metrics_sql())(lambda t, q, p: V.page_metrics(t, q))
evaluation("set2_metrics_without_first", f"SELECT *, {_F1} FROM m", _metrics_sql("WHERE page0 > 0"))(lambda t, q, p: V.page_metrics(t, q, skip_first=True))
evaluation("agg20_macro_average", f"SELECT CAST(dossier_id AS VARCHAR) AS dossier_id, precision, recall, f1 FROM (SELECT *, {_F1} FROM m) UNION ALL SELECT 'ALL', avg(precision), avg(recall), avg(f1) FROM (SELECT *, {_F1} FROM m)", _metrics_sql())(
    lambda t, q, p: V.with_macro(V.page_metrics(t, q), ["precision", "recall", "f1"])
)
_TOL = """tol AS (SELECT t.dossier_id, len(t) AS nt, len(p) AS np, list_reduce(list_transform(p, lambda x: struct_pack(x := x, l := CAST([] AS BIGINT[]), n := 0)), lambda a, b: struct_pack(x := b.x, l := list_filter(a.l, lambda g: g <> coalesce(list_filter(a.l, lambda h: abs(h - b.x) <= 1)[1], -9)),
 n := a.n + CASE WHEN len(list_filter(a.l, lambda h: abs(h - b.x) <= 1)) > 0 THEN 1 ELSE 0 END), struct_pack(x := CAST(0 AS BIGINT), l := t, n := 0)).n AS tp
 FROM (SELECT dossier_id, list(page0 ORDER BY page0) AS t FROM fx_gt GROUP BY 1) t JOIN (SELECT dossier_id, list(page0 ORDER BY page0) AS p FROM fx_pred GROUP BY 1) p ON t.dossier_id = p.dossier_id)"""
evaluation("jn11_tolerant_metrics", f"SELECT *, {_F1} FROM (SELECT dossier_id, tp, np - tp AS fp, nt - tp AS fn, tp / np AS precision, tp / nt AS recall FROM tol)", _TOL)(lambda t, q, p: V.tolerant_metrics(t, q, 1))
_IOU = "hits AS (SELECT g.dossier_id, g.i AS ti, p.i AS pi, (least(g.hi, p.hi) - greatest(g.lo, p.lo)) / (greatest(g.hi, p.hi) - least(g.lo, p.lo)) AS iou FROM gseg g JOIN pseg p ON g.dossier_id = p.dossier_id AND g.lo < p.hi AND p.lo < g.hi)"
evaluation("jn10_segment_overlaps", "SELECT * FROM hits WHERE iou > 0.5", _SEGS, _IOU)(lambda t, q, p: V.overlaps(*V.truth_and_prediction(t, q, FX.totals(p))))
evaluation(
    "agg17_panoptic_quality",
    """SELECT *, rq * sq AS pq FROM (SELECT dossier_id, n_tp, n_fp, n_fn, precision AS precision_doc, recall AS recall_doc, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS rq, sq FROM (
 SELECT g.dossier_id, coalesce(h.n, 0) AS n_tp, np - coalesce(h.n, 0) AS n_fp, nt - coalesce(h.n, 0) AS n_fn, coalesce(h.n, 0) / np AS precision, coalesce(h.n, 0) / nt AS recall, coalesce(s / h.n, 0.0) AS sq FROM
 (SELECT dossier_id, count(*) AS nt FROM gseg GROUP BY 1) g JOIN (SELECT dossier_id, count(*) AS np FROM pseg GROUP BY 1) p ON g.dossier_id = p.dossier_id
 LEFT JOIN (SELECT dossier_id, count(*) AS n, sum(iou) AS s FROM hits WHERE iou > 0.5 GROUP BY 1) h ON g.dossier_id = h.dossier_id))""",
    _SEGS, _IOU,
)(lambda t, q, p: V.panoptic(*V.truth_and_prediction(t, q, FX.totals(p))))
_MAJ = "maj AS (SELECT s.dossier_id, s.i, s.lo, arg_max(category, (n, -f)) AS label FROM (SELECT s.dossier_id, s.i, s.lo, p.category, count(*) AS n, min(p.page_num) AS f FROM gseg s JOIN fx_pages p ON s.dossier_id = p.dossier_id AND p.page_num - 1 >= s.lo AND p.page_num - 1 < s.hi GROUP BY 1, 2, 3, 4) s GROUP BY 1, 2, 3)"
evaluation("agg7_majority_type", "SELECT * FROM maj", _SEGS, _MAJ)(lambda t, q, p: V.majority_type(S.intervals(t, FX.totals(p)), p))


def _typed(q: DataFrame, p: DataFrame) -> DataFrame:
    """Predicted segments with the category of their first page."""
    first = p.select("dossier_id", (F.col("page_num") - 1).alias("lo"), F.col("category").alias("type"))
    return S.intervals(q, FX.totals(p)).join(first, ["dossier_id", "lo"])


_TYPED = "ptype AS (SELECT s.*, p.category AS type FROM pseg s JOIN fx_pages p ON s.dossier_id = p.dossier_id AND p.page_num - 1 = s.lo)"
_AT = "typeat AS (SELECT g.dossier_id, g.page0, coalesce(t.type, 'Other') AS label FROM fx_gt g LEFT JOIN ptype t ON g.dossier_id = t.dossier_id AND t.lo <= g.page0 AND g.page0 < t.hi)"
evaluation("jn5_type_at_page", "SELECT * FROM typeat", _SEGS, _TYPED, _AT)(lambda t, q, p: V.type_at(t, _typed(q, p)))
evaluation("jn6_covering_start", "SELECT p.dossier_id, p.page_num - 1 AS page0, max(g.page0) AS start FROM fx_pages p JOIN fx_gt g ON p.dossier_id = g.dossier_id AND g.page0 <= p.page_num - 1 GROUP BY 1, 2", _SEGS)(
    lambda t, q, p: V.covering(t, p.select("dossier_id", (F.col("page_num") - 1).alias("page0")))
)
evaluation("agg18_type_accuracy", "SELECT m.label AS gt, count(*) AS n, avg(CAST(m.label = a.label AS INTEGER)) AS accuracy FROM maj m JOIN typeat a ON m.dossier_id = a.dossier_id AND m.lo = a.page0 GROUP BY 1", _SEGS, _MAJ, _TYPED, _AT)(
    lambda t, q, p: V.majority_type(S.intervals(t, FX.totals(p)), p).select("dossier_id", F.col("lo").alias("page0"), F.col("label").alias("gt")).join(V.type_at(t, _typed(q, p)), ["dossier_id", "page0"]).groupBy("gt").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("gt") == F.col("label")).cast("int")).alias("accuracy"))
)
evaluation("flt20_misclassified", "SELECT m.dossier_id, m.lo AS page0, m.label AS gt, a.label AS got FROM maj m JOIN typeat a ON m.dossier_id = a.dossier_id AND m.lo = a.page0 WHERE m.label <> a.label ORDER BY 1, 2 LIMIT 10", _SEGS, _MAJ, _TYPED, _AT)(
    lambda t, q, p: V.majority_type(S.intervals(t, FX.totals(p)), p).select("dossier_id", F.col("lo").alias("page0"), F.col("label").alias("gt")).join(V.type_at(t, _typed(q, p)).withColumnRenamed("label", "got"), ["dossier_id", "page0"]).where("gt <> got").orderBy("dossier_id", "page0").limit(10)
)
_STAT = "st AS (SELECT dossier_id, count(*) AS n_docs, avg(CAST(hi - lo AS DOUBLE)) AS mean_pages, median(CAST(hi - lo AS DOUBLE)) AS median_pages, min(hi - lo) AS min_pages, max(hi - lo) AS max_pages FROM gseg GROUP BY 1)"
evaluation("agg21_page_statistics", "SELECT * FROM st", _SEGS, _STAT)(lambda t, q, p: V.page_statistics(S.intervals(t, FX.totals(p))))
evaluation("agg22_total_row", "SELECT CAST(sum(n_docs) AS BIGINT) AS n_docs, avg(mean_pages) AS mean_pages, min(min_pages) AS min_pages, max(max_pages) AS max_pages FROM st", _SEGS, _STAT)(
    lambda t, q, p: V.page_statistics(S.intervals(t, FX.totals(p))).agg(F.sum("n_docs").alias("n_docs"), F.avg("mean_pages").alias("mean_pages"), F.min("min_pages").alias("min_pages"), F.max("max_pages").alias("max_pages"))
)
evaluation("set1_boundary_sets", "SELECT 'both' AS part, * FROM (SELECT * FROM fx_gt INTERSECT SELECT * FROM fx_pred) UNION ALL SELECT 'truth', * FROM (SELECT * FROM fx_gt EXCEPT SELECT * FROM fx_pred) UNION ALL SELECT 'pred', * FROM (SELECT * FROM fx_pred EXCEPT SELECT * FROM fx_gt)")(
    lambda t, q, p: t.intersect(q).select(F.lit("both").alias("part"), "*").union(t.subtract(q).select(F.lit("truth"), "*")).union(q.subtract(t).select(F.lit("pred"), "*"))
)
evaluation("jn7_positional", "SELECT g.dossier_id, g.i, g.lo AS gt_lo, p.lo AS pred_lo FROM gseg g LEFT JOIN pseg p ON g.dossier_id = p.dossier_id AND g.i = p.i", _SEGS)(
    lambda t, q, p: S.intervals(t, n := FX.totals(p)).select("dossier_id", "i", F.col("lo").alias("gt_lo")).join(S.intervals(q, n).select("dossier_id", "i", F.col("lo").alias("pred_lo")), ["dossier_id", "i"], "left")
)
evaluation("jn18_not_yet_computed", "SELECT p.dossier_id, p.page_num FROM fx_pages p WHERE NOT EXISTS (SELECT 1 FROM fx_pred q WHERE q.dossier_id = p.dossier_id AND q.page0 = p.page_num - 1)")(
    lambda t, q, p: p.select("dossier_id", "page_num").join(q.select("dossier_id", (F.col("page0") + 1).alias("page_num")), ["dossier_id", "page_num"], "left_anti")
)
evaluation("jn4_start_membership", "SELECT p.dossier_id, p.page_num, g.page0 IS NOT NULL AS starts FROM fx_pages p LEFT JOIN fx_gt g ON g.dossier_id = p.dossier_id AND g.page0 = p.page_num - 1")(
    lambda t, q, p: p.select("dossier_id", "page_num").join(t.select("dossier_id", (F.col("page0") + 1).alias("page_num"), F.lit(True).alias("s")), ["dossier_id", "page_num"], "left").select("dossier_id", "page_num", F.coalesce("s", F.lit(False)).alias("starts"))
)


def _bounds(p: DataFrame) -> DataFrame:
    """Boundary documents: the true starts but for each dossier's first page, with codes of many forms."""
    w = Window.partitionBy("dossier_id").orderBy("page_num")
    rows = p.where("okey % 5 = 0 or okey % 13 = 0")
    return rows.select("dossier_id", (F.row_number().over(w) - 1).alias("pos"), F.when(F.col("okey") % 3 != 0, (F.col("okey") % 1500).cast("string")).alias("doc_code"), F.col("page_num").cast("int").alias("start_page"))


_NORM = r"""CASE WHEN regexp_matches({x}, '^5\.[12]\.') THEN NULL ELSE (SELECT CASE WHEN c IS NULL OR regexp_matches(c, '^(19|20)\d\d$') OR c = '0000' OR regexp_matches(c, '^05[12][1-9]$') OR (length(d) = 4 AND c[1] <> '0') THEN NULL ELSE c END FROM (
 SELECT d, CASE WHEN length(d) = 7 THEN '0' || substr(d, 4, 3) WHEN length(d) > 4 THEN coalesce(nullif(regexp_extract(d, '0\d\d\d'), ''), right(d, 4)) WHEN length(d) = 4 THEN d WHEN length(d) > 0 AND CAST(d AS INTEGER) BETWEEN 1 AND 999 THEN lpad(d, 4, '0') END AS c FROM (SELECT regexp_replace({x}, '\D', '', 'g') AS d))) END"""
page_query(
    "jn3_boundary_documents",
    """SELECT p.dossier_id, p.page_num, coalesce(arg_max(b.code, b.i) FILTER (WHERE b.start_page <= p.page_num), 'auto_' || lpad(CAST(p.page_num AS VARCHAR), 3, '0')) AS doc_code FROM fx_pages p LEFT JOIN bd b ON p.dossier_id = b.dossier_id GROUP BY p.dossier_id, p.page_num""",
    "bd AS (SELECT dossier_id, start_page, i, coalesce(" + _NORM.format(x="doc_code") + ", 'auto_' || lpad(CAST(i AS VARCHAR), 3, '0')) AS code FROM (SELECT dossier_id, page_num AS start_page, row_number() OVER (PARTITION BY dossier_id ORDER BY page_num) AS i, CASE WHEN okey % 3 <> 0 THEN CAST(okey % 1500 AS VARCHAR) END AS doc_code FROM fx_pages WHERE okey % 5 = 0 OR okey % 13 = 0))",
)(lambda p: P.from_boundaries(p, _bounds(p)).select("dossier_id", "page_num", "doc_code"))
page_query("jn20_adjacent_pairs", "SELECT dossier_id, page_num, lag(category) OVER (PARTITION BY dossier_id ORDER BY page_num) AS before, category FROM fx_pages")(lambda p: p.select("dossier_id", "page_num", F.lag("category").over(Window.partitionBy("dossier_id").orderBy("page_num")).alias("before"), "category"))
page_query("cmp1_route", "SELECT f.dossier_id, f.page_num, CASE WHEN c.coverage >= 0.75 THEN f.doc_code ELSE a.auto_code END AS doc_code, CASE WHEN c.coverage >= 0.75 THEN 'stamp' ELSE 'boundary' END AS method FROM fill2 f JOIN auto a ON f.dossier_id = a.dossier_id AND f.page_num = a.page_num JOIN cov c ON f.dossier_id = c.dossier_id", _FILL2, _AUTO, _COVER)(
    lambda p: P.route(p, 0.75).select("dossier_id", "page_num", "doc_code", "method")
)


@query(
    "jn1_region_codes",
    "WITH " + FX.SQL_WORDS + ", reg(priority, region, a, b, c, d, z) AS (VALUES " + ", ".join(str(r) for r in R.REGIONS)
    + """) SELECT page_id, text AS code, region FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY priority, x0 DESC, seq, part) AS rn FROM fx_words JOIN reg ON a <= x0 AND x1 <= c AND b <= y0 AND y1 <= d
 AND regexp_matches(text, CASE WHEN z THEN '^0\\d{3}$' ELSE '^\\d{4}$' END) AND CAST(text AS INTEGER) NOT BETWEEN 1900 AND 2099) WHERE rn = 1""",
)
def _regions(spark: SparkSession, sf: str) -> DataFrame:
    return R.find_codes(FX.words(spark, sf), R.table(spark))


_HITS = "WITH " + FX.SQL_WORDS + ", w AS (SELECT *, CASE WHEN y0 < 0.12 THEN 'top' WHEN y0 > 0.88 THEN 'btm' ELSE 'mid' END AS zone FROM fx_words) "


@query("agg11_dominant_region", _HITS + "SELECT zone, count(*) AS n, count(*) / (SELECT count(*) FROM w) > 0.5 AS dominant FROM w GROUP BY 1")
def _dominant(spark: SparkSession, sf: str) -> DataFrame:
    zone = F.when(F.col("y0") < 0.12, "top").when(F.col("y0") > 0.88, "btm").otherwise("mid")
    hits = FX.words(spark, sf).groupBy(zone.alias("zone")).agg(F.count(F.lit(1)).alias("n"))
    return hits.crossJoin(F.broadcast(hits.agg(F.sum("n").alias("t")))).select("zone", "n", (F.col("n") / F.col("t") > 0.5).alias("dominant"))


# -- scalars -------------------------------------------------------------------------------------------

_RAW_CODE = "CASE l_partkey % 9 WHEN 0 THEN lpad(cast(l_suppkey % 1000 as string), 4, '0') WHEN 1 THEN 'Doc ' || cast(l_suppkey as string) WHEN 2 THEN cast(l_orderkey * 7 as string) WHEN 3 THEN '76' || cast(l_partkey as string) || '41' WHEN 4 THEN '5.1.' || cast(l_linenumber as string) WHEN 5 THEN cast(1890 + l_partkey % 220 as string) WHEN 6 THEN '0000' || cast(l_linenumber as string) WHEN 7 THEN '054' || lpad(cast(l_suppkey as string), 6, '0') ELSE '05' || cast(l_linenumber % 3 as string) || cast(l_linenumber as string) END"
_LKEY = "cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || cast(l_partkey as string) || '-' || cast(l_suppkey as string)"
same("str5_doc_code", _RAW_CODE, "lineitem", _LKEY, _NORM.format(x="x"))(T.doc_code)
same("str6_raster_code", _RAW_CODE, "lineitem", _LKEY, r"coalesce(nullif(regexp_extract(x, '\b0\d{3}\b'), ''), nullif(regexp_extract(x, '\d{2,}(0\d{3})', 1), ''))")(lambda x: T.raster_code(x, F.lit(True)))
same("str7_page_number", _RAW_CODE, "lineitem", _LKEY, r"CAST(nullif(regexp_extract(trim(x), '\b(\d{1,3})\b', 1), '') AS INTEGER)")(T.small_page_number)
same("flt3_year_codes", _RAW_CODE, "lineitem", _LKEY, "coalesce(TRY_CAST(x AS INTEGER) BETWEEN 1900 AND 2099, false)")(lambda x: F.coalesce(T.is_year(x), F.lit(False)))
same("str8_docnr_label", _RAW_CODE, "lineitem", _LKEY, r"regexp_matches(x, '(?i)docnr?\s*\d')")(T.has_docnr_label)


def page_scalar(name: str, sql: str) -> Callable:
    def add(f: Callable[[Column], Column]) -> None:
        page_query(name, f"SELECT dossier_id, page_num, {sql} AS y FROM fx_pages")(lambda p: p.select("dossier_id", "page_num", f(F.col("text")).alias("y")))

    return add


page_scalar("str1_redaction_codes_ocr", f"array_to_string({_OCR_CODES}, ',')")(lambda x: F.array_join(T.redaction_codes_ocr(x), ","))
page_scalar("str2_redaction_codes_vlm", r"array_to_string(list_transform(regexp_extract_all(text, '(?i)5\.[12]\.[1-9][a-z]{0,2}'), lambda c: lower(c)), ',')")(lambda x: F.array_join(T.redaction_codes_vlm(x), ","))
page_scalar("str3_annotate_ocr", r"regexp_replace(text, '\b(5\.[12]\.[1-9][a-z]?)[a-z]?\b', '[GELAKT: \1]', 'g')")(T.annotate_ocr)
page_scalar("str4_annotate_vlm", r"replace(replace(regexp_replace(replace('[GELAKT: 5.1.1]' || text, '[GELAKT: 5.', '[GELAKT: 5@'), '(?i)(5\.[12]\.[1-9][a-z]{0,2})', '[GELAKT: \1]', 'g'), '[GELAKT: 5@', '[GELAKT: 5.'), '', '')")(lambda x: T.annotate_vlm(F.concat(F.lit("[GELAKT: 5.1.1]"), x)))
page_scalar("seg3_line_count", "len(string_split(text, chr(10)))")(lambda x: F.size(T.lines(x)).cast("long"))
_HEAD = "list_filter(list_transform(string_split(text, chr(10)), lambda l: lower(regexp_extract(l, '(?i)^[ \\t]*(" + T.FIELDS + ")\\s*:', 1))), lambda f: f <> '')"
_CANON = f"list_transform({_HEAD}, lambda f: CASE WHEN f IN ('van', 'afzender') THEN 'from' WHEN f = 'aan' THEN 'to' WHEN f IN ('onderwerp', 'betreft') THEN 'subject' WHEN f IN ('verzonden', 'datum') THEN 'sent' ELSE f END)"
page_scalar("str9_header_fields", f"array_to_string({_CANON}, ',')")(lambda x: F.array_join(F.array_compact(F.transform(T.lines(x), T.header_field)), ","))
page_scalar("str10_separators", r"len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '(?i)^[-_=]{4,}.*?(?:original message|forwarded message|doorgestuurd bericht|oorspronkelijk bericht)')))")(lambda x: F.size(F.filter(T.lines(x), T.is_separator)).cast("long"))
page_scalar("str11_subject_value", r"list_filter(list_transform(string_split(text, chr(10))[1:15], lambda l: nullif(trim(regexp_extract(l, '(?i)^[ \t]*(?:subject|onderwerp|betreft)\s*:\s*(.+)', 1)), '')), lambda v: v IS NOT NULL)[1]")(lambda x: T.header_value(T.lines(x), "subject|onderwerp|betreft"))
page_scalar("str12_redacted_addresses", r"regexp_replace(text, '(?i)<\s*,?\s*@([\w.-]+\.\w{2,})\s*>', '<[GELAKT]@\1>', 'g')")(T.redacted_addresses)
page_scalar("str13_attachments", r"array_to_string(list_distinct(list_filter(string_split(text, chr(10))[1:30], lambda l: regexp_matches(trim(l), '(?i)^\b[\w\-. ]+\.(?:pdf|docx?|xlsx?|pptx?|msg|eml|zip|txt|csv|rtf|odt|ods)$'))), ',')")(lambda x: F.array_join(T.attachments(T.lines(x)), ","))
page_scalar("str14_title", "left(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: length(l) > 5)[1], 120)")(lambda x: T.title(F.lit(False), F.lit(None).cast("string"), x, F.lit("Document")))
page_scalar("str15_sender", r"left(trim(regexp_extract(left(text, 1000), '(?i)(?:van|from)\s*:\s*([^\n]+)', 1)), 80)")(T.sender)
page_scalar("str16_description", r"coalesce(left(list_filter(list_transform(string_split(text, chr(10))[1:20], lambda l: trim(l)), lambda l: length(l) > 8 AND NOT regexp_matches(l, '(?i)^(?:van|aan|from|to|cc|bcc|datum|onderwerp|subject|verzonden|sent)\s*:') AND NOT regexp_matches(l, '^[\d\s.\-/]+$'))[1], 100), 'Other')")(
    lambda x: T.description(F.lit("Other"), F.lit(None).cast("string"), x, F.array().cast("array<string>"))
)
page_scalar("str17_summary", r"rtrim(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 220), ' ,.;:') || '.'")(lambda x: T.summary(x, F.lit("Overig")))
page_scalar("str21_normalised_text", r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))")(T.normalised)
page_scalar("str24_preview", "left(text, 80)")(lambda x: F.left(x, F.lit(80)))
page_scalar("str26_digest", "sha1(left(text, 500))")(lambda x: F.sha1(F.left(x, F.lit(500))))
page_scalar("flt10_continuation", r"regexp_matches(ltrim(regexp_replace(text, '(?i)^\s*(?:\d{4,}|[A-Z]{2,}\d+|\[PDF page \d+\])\s*', '')), '^\p{Ll}')")(T.continues)
page_scalar("dt3_datum_field", r"nullif(trim(regexp_extract(left(text, 3000), '(?i)\bdatum\b[\s|:]+([^\n]{2,60}?)(?:\s*\||\n|$)', 1)), '')")(D.datum_raw)
page_scalar("dt14_dense_dates", f"len(regexp_extract_all(lower(text), '{T.ANY_DATE}')) >= 5")(D.dense_dates)

_M_NL = FX._MONTH_NL
_DATE_TEXT = (
    "CASE o_orderkey % 8 WHEN 0 THEN {y} || '-' || {m} || '-' || {d} || 'T' || {c} WHEN 1 THEN {d} || '-' || {m} || '-' || {y} || ' ' || {c} WHEN 2 THEN 'Thur ' || cast(month(o_orderdate) as string) || '/' || {d} || '/' || {y} || ' 12:58:26 PM'"
    " WHEN 3 THEN 'maandag ' || cast(day(o_orderdate) as string) || ' ' || {nl} || ' ' || {y} || ' 10:02' WHEN 4 THEN {d} || {nl} || {y} WHEN 5 THEN '31-02-' || {y} WHEN 6 THEN {d} || '/' || {m} || '/' || {y} ELSE 'nota ' || {d} || ' ' || {nl} || ' ' || {y} END"
).format(y=FX._YEAR, m=FX._MONTH, d=FX._DAY, c=FX._CLOCK, nl=_M_NL)
_TRUE_DAY = f"{FX._YEAR} || '-' || {FX._MONTH} || '-' || {FX._DAY}"
_MONTH_SQL = "CASE lower({}) " + " ".join(f"WHEN '{m}' THEN {n}" for m, n in D.MONTHS.items()) + " END"


def _make_sql(y: str, m: str, d: str, t: str = "'00:00'") -> str:
    return f"try_strptime({y} || '-' || {m} || '-' || {d} || ' ' || {t}, '%Y-%m-%d %H:%M')"


_PARSE = "coalesce(" + ", ".join([
    "try_strptime(nullif(regexp_extract(x, '^\\d{4}-\\d{1,2}-\\d{1,2}[T ]\\d{1,2}:\\d{2}$'), ''), '%Y-%m-%dT%H:%M')",
    _make_sql(r"nullif(regexp_extract(x, '^\w{2,5}\.?\s+(\d{1,2})/(\d{1,2})/(\d{4})', 3), '')", r"regexp_extract(x, '^\w{2,5}\.?\s+(\d{1,2})/(\d{1,2})/(\d{4})', 1)", r"regexp_extract(x, '^\w{2,5}\.?\s+(\d{1,2})/(\d{1,2})/(\d{4})', 2)"),
    _make_sql(r"nullif(regexp_extract(x, '^\w+\s+(\d{1,2})\s+(\w+)\s+(\d{4})', 3), '')", "CAST(" + _MONTH_SQL.format(r"regexp_extract(x, '^\w+\s+(\d{1,2})\s+(\w+)\s+(\d{4})', 2)") + " AS VARCHAR)", r"regexp_extract(x, '^\w+\s+(\d{1,2})\s+(\w+)\s+(\d{4})', 1)"),
    "try_strptime(nullif(regexp_extract(x, '^\\d{1,2}-\\d{1,2}-\\d{4} \\d{1,2}:\\d{2}$'), ''), '%d-%m-%Y %H:%M')",
    "try_strptime(nullif(regexp_extract(x, '^\\d{1,2}-\\d{1,2}-\\d{4}$'), ''), '%d-%m-%Y')",
    _make_sql(rf"nullif(regexp_extract(x, '(?i)(\d{{1,2}})\s*({D.MONTH_PATTERN})\s*(\d{{4}})', 3), '')", "CAST(" + _MONTH_SQL.format(rf"regexp_extract(x, '(?i)(\d{{1,2}})\s*({D.MONTH_PATTERN})\s*(\d{{4}})', 2)") + " AS VARCHAR)", rf"regexp_extract(x, '(?i)(\d{{1,2}})\s*({D.MONTH_PATTERN})\s*(\d{{4}})', 1)"),
]) + ")"
same("dt1_parse_date", _DATE_TEXT, "orders", "o_orderkey", f"strftime({_PARSE}, '%Y-%m-%d %H:%M')")(lambda x: F.date_format(D.parse(x), "yyyy-MM-dd HH:mm"))
same("dt13_iso_day", _DATE_TEXT, "orders", "o_orderkey", f"strftime({_PARSE}, '%Y-%m-%d')")(lambda x: F.date_format(D.parse(x), "yyyy-MM-dd"))
_EU = r"'(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})(?:\s+(\d{1,2}:\d{2}))?'"
_NLD = r"'(\d{1,2})\s+([a-zA-Z]+)\s+(\d{4})(?:\s+(\d{1,2}:\d{2}))?'"
_MAIL_DATE = rf"""CASE WHEN regexp_matches(x, '^\d{{4}}-\d{{2}}-\d{{2}}') THEN x
 WHEN regexp_matches(x, {_EU}) AND CAST(regexp_extract(x, {_EU}, 1) AS INTEGER) BETWEEN 1 AND 31 AND CAST(regexp_extract(x, {_EU}, 2) AS INTEGER) BETWEEN 1 AND 12 THEN regexp_extract(x, {_EU}, 3) || '-' || lpad(regexp_extract(x, {_EU}, 2), 2, '0') || '-' || lpad(regexp_extract(x, {_EU}, 1), 2, '0') || CASE WHEN regexp_extract(x, {_EU}, 4) <> '' THEN 'T' || regexp_extract(x, {_EU}, 4) ELSE '' END
 WHEN regexp_matches(x, {_NLD}) THEN regexp_extract(x, {_NLD}, 3) || '-' || lpad(CAST({_MONTH_SQL.format(f"regexp_extract(x, {_NLD}, 2)")} AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract(x, {_NLD}, 1), 2, '0') || CASE WHEN regexp_extract(x, {_NLD}, 4) <> '' THEN 'T' || regexp_extract(x, {_NLD}, 4) ELSE '' END ELSE x END"""
same("dt7_email_date", _DATE_TEXT, "orders", "o_orderkey", _MAIL_DATE)(D.email_date)
same("dt8_email_time", _DATE_TEXT, "orders", "o_orderkey", f"CASE WHEN len(string_split({_MAIL_DATE}, 'T')) = 2 THEN string_split({_MAIL_DATE}, 'T')[2] END")(lambda x: D.email_time(D.email_date(x)))
same("dt9_split_moment", _DATE_TEXT, "orders", "o_orderkey", r"CASE WHEN x LIKE '%T%' THEN string_split(x, 'T')[1] ELSE coalesce(nullif(regexp_extract(x, '(\d{4}-\d{2}-\d{2})[ T](\d{1,2}:\d{2})', 1), ''), x) END")(lambda x: D.split_moment(x)["day"])
same("dt10_truth_date", _DATE_TEXT, "orders", "o_orderkey", r"CASE WHEN regexp_matches(x, '^\d{1,2}[-/]\d{1,2}[-/]\d{4}$') THEN regexp_extract(x, '(\d{4})$', 1) || '-' || lpad(regexp_extract(x, '[-/](\d{1,2})[-/]', 1), 2, '0') || '-' || lpad(regexp_extract(x, '^(\d{1,2})', 1), 2, '0') ELSE '' END")(D.truth_date)
same("dt11_chat_title", _DATE_TEXT, "orders", "o_orderkey", r"CASE WHEN regexp_matches(x, '\d{4}-\d{2}-\d{2}') THEN regexp_replace(regexp_extract(x, '\d{4}-\d{2}-\d{2}'), '(\d{4})-(\d{2})-(\d{2})', '\3-\2-\1') WHEN regexp_matches(x, '\d{2}[/-]\d{2}[/-]\d{4}') THEN replace(regexp_extract(x, '\d{2}[/-]\d{2}[/-]\d{4}'), '/', '-') ELSE x END")(D.chat_title_date)
same("dt12_chat_stamp", FX._CLOCK, "orders", "o_orderkey", "'2024-01-02T' || x")(lambda x: D.chat_stamp(F.lit("2024-01-02"), x))
page_query("dt4_date_scan", rf"SELECT dossier_id, page_num, strftime(coalesce(list_filter(list_transform(regexp_extract_all(left(text, 1000), '\b\d{{1,2}}-\d{{1,2}}-\d{{4}}\b'), lambda x: try_strptime(x, '%d-%m-%Y')), lambda d: d IS NOT NULL)[1], {_make_sql('y', 'CAST(' + _MONTH_SQL.format('m') + ' AS VARCHAR)', 'd')}), '%Y-%m-%d') AS date FROM (SELECT *, "
           + ", ".join(rf"nullif(regexp_extract(left(text, 1000), '(?i)(\d{{1,2}})\s*({D.MONTH_PATTERN})\s*(\d{{4}})', {k}), '') AS {n}" for n, k in (("d", 1), ("m", 2), ("y", 3))) + " FROM fx_pages)")(
    lambda p: p.select("dossier_id", "page_num", F.date_format(D.scan(F.col("text"))["date"], "yyyy-MM-dd").alias("date"))
)
page_query("dt5_document_date", None)(lambda p: P.dated(P.assemble(S.forward_fill(p))).select("dossier_id", "doc_code", F.date_format("date", "yyyy-MM-dd HH:mm").alias("date"), "date_raw"))

_LABEL = "CASE o_orderkey % 7 WHEN 0 THEN 'email' WHEN 1 THEN ' nota ' WHEN 2 THEN 'Chat' WHEN 3 THEN 'Whatever' WHEN 4 THEN 'report' WHEN 5 THEN 'Inventarislijst' ELSE 'brief' END"
_CATEGORY_SQL = "coalesce(CASE trim(x) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.CATEGORY_OF_LABEL.items()) + " END, 'Other')"
same("prj2_category", _LABEL, "orders", "o_orderkey", _CATEGORY_SQL)(T.category)
_SUB_SQL = "coalesce(CASE WHEN replace(lower(trim(x)), '-', '_') IN (" + ", ".join(f"'{s}'" for s in T.SUBTYPES) + ") THEN replace(lower(trim(x)), '-', '_') END, CASE " + _CATEGORY_SQL + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.SUBTYPE_OF_CATEGORY.items()) + " END, 'other')"
same("prj3_subtype", _LABEL, "orders", "o_orderkey", _SUB_SQL)(lambda x: T.subtype(x, T.category(x)))
same("prj4_type_label", _LABEL, "orders", "o_orderkey", "CASE WHEN lower(trim(x)) LIKE '%chat%' THEN 'Chat' WHEN lower(trim(x)) = 'email' THEN 'E-mail' ELSE coalesce(CASE lower(trim(x)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.SUBTYPES.items()) + " END, trim(x)) END")(lambda x: T.type_label(x, T.strip(x)))
same("prj5_evaluated_type", _LABEL, "orders", "o_orderkey", "CASE WHEN x IN (" + ", ".join(f"'{t}'" for t in T.EVALUATED_TYPES) + ") THEN x ELSE 'Other' END")(lambda x: T.evaluated_type(x, True))
same("flt9_memo_like", _LABEL, "orders", "o_orderkey", _CATEGORY_SQL + " IN ('Nota', 'Brief', 'Report', 'Vergadernotulen')")(lambda x: T.category(x).isin(*T.MEMO_LIKE))
same("flt12_chat_category", _LABEL, "orders", "o_orderkey", "regexp_matches(lower(x), 'chat|whatsapp|teams|sms|berichtenverkeer')")(T.is_chat_category)
_HTTP = "CASE o_orderkey % 5 WHEN 0 THEN 'Bad Gateway ' WHEN 1 THEN '502 error' WHEN 2 THEN 'Not found here' WHEN 3 THEN 'internal  server error' ELSE o_orderpriority END"
same("flt11_http_errors", _HTTP, "orders", "o_orderkey", f"regexp_matches(x, '{T.HTTP_ERROR}')")(T.is_http_error)
same("str27_progress", "'[x] Page ' || cast(1 + o_orderkey % 50 as string) || '/50 read'", "orders", "o_orderkey", r"CAST(5 + round_even(80 * CAST(regexp_extract(x, 'Page (\d+)', 1) AS DOUBLE) / 50, 0) AS INTEGER)")(T.progress)
_JSON = "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN substr(props, 1, length(props) - 1) WHEN 2 THEN replace(props, '}', ',}') ELSE substr(props, 1, length(props) - 2) END"
_FIXED = "(SELECT event_id, regexp_replace(rtrim(x), ',\\s*([}\\]])', '\\1', 'g') AS s FROM (SELECT event_id, " + _JSON + " AS x FROM events))"
_CLOSE = """list_reduce(list_transform(string_split(s, ''), lambda c: struct_pack(c := c, ins := false, esc := false, st := '')), lambda a, x: struct_pack(c := x.c, ins := CASE WHEN NOT a.esc AND x.c = '"' THEN NOT a.ins ELSE a.ins END, esc := NOT a.esc AND a.ins AND x.c = chr(92),
 st := CASE WHEN a.esc OR a.ins OR x.c = '"' THEN a.st WHEN x.c = '{' THEN '}' || a.st WHEN x.c = '[' THEN ']' || a.st WHEN x.c IN ('}', ']') THEN substr(a.st, 2) ELSE a.st END), struct_pack(c := '', ins := false, esc := false, st := ''))"""
query("js1_repair_json", f"SELECT event_id, s || CASE WHEN r.ins THEN '\"' ELSE '' END || r.st AS fixed FROM (SELECT event_id, s, {_CLOSE} AS r FROM {_FIXED})")(lambda spark, sf: FX.read(spark, sf, "events").select("event_id", repair.closed(F.expr(_JSON)).alias("fixed")))
query("js3_tolerant_fields", "SELECT event_id, coalesce(nullif(event_type, ''), 'none') AS kind, json_valid(props) AS ok FROM events")(lambda spark, sf: FX.read(spark, sf, "events").select("event_id", F.coalesce(T.blank_to_null(F.col("event_type")), F.lit("none")).alias("kind"), F.get_json_object("props", "$").isNotNull().alias("ok")))
page_query("prj6_page_summary", r"""SELECT dossier_id, page_num, 'p' || lpad(CAST(page_num AS VARCHAR), 3, '0') || ': stamp=' || coalesce(detected_code, 'null') || ' wpn=' || coalesce(CAST(within_doc_page AS VARCHAR), 'null') || ' new=' || CASE WHEN is_new_document THEN 'Y' ELSE 'N' END
 || ' cont=' || CASE WHEN regexp_matches(ltrim(regexp_replace(text, '(?i)^\s*(?:\d{4,}|[A-Z]{2,}\d+|\[PDF page \d+\])\s*', '')), '^\p{Ll}') THEN 'Y' ELSE 'N' END || ' cat=' || category || ' eml=' || CASE WHEN email_start THEN 'Y from' ELSE 'N' END || ' | "' || left(trim(regexp_replace(text, '\s+', ' ', 'g')), 500) || '"' AS line FROM fx_pages""".replace("'Y from'", "'Y'"))(
    lambda p: p.select("dossier_id", "page_num", T.page_summary(F.col("page_num"), F.col("detected_code"), F.col("within_doc_page"), F.col("is_new_document"), T.continues(F.col("text")), F.col("category"), F.col("email_start"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("text")).alias("line"))
)

# -- e-mails, chats, inventory --------------------------------------------------------------------------


def _mail_texts(p: DataFrame) -> DataFrame:
    return P.assemble(S.forward_fill(p).where("category = 'E-mail'")).select("dossier_id", "doc_code", "text")


_KIND = "list_transform(" + _LINES + ", lambda l, i: struct_pack(sep := regexp_matches(l, '" + T.SEPARATOR + "'), field := coalesce((" + _CANON.replace(_LINES, "[l]").replace("string_split(text, chr(10))", "[l]") + ")[1], ''), near := len(list_filter((" + _LINES + ")[i:i + 14], lambda z: regexp_matches(z, '(?i)^[ \\t]*(?:subject|onderwerp|betreft)\\s*:\\s*(.+)'))) > 0, i := 0, head := false, seen := CAST([] AS VARCHAR[]), last := -999, body := 0, cuts := CAST([] AS INTEGER[])))"
_NEWMAIL = "(x.sep OR (x.field <> '' AND (list_contains(a.seen, x.field) OR ((NOT a.head OR (a.i - a.last > 4 AND a.body > 2)) AND x.near))))"
_BODY = "(CASE WHEN a.head THEN a.body + 1 ELSE a.body END)"
_FOLD = f"""list_reduce({_KIND}, lambda a, x: struct_pack(sep := x.sep, field := x.field, near := x.near, i := a.i + 1, head := x.sep OR x.field <> '' OR (a.head AND {_BODY} < 6),
 seen := CASE WHEN x.sep THEN CAST([] AS VARCHAR[]) WHEN {_NEWMAIL} THEN [x.field] WHEN x.field <> '' THEN list_append(a.seen, x.field) ELSE a.seen END, last := CASE WHEN x.sep OR x.field <> '' THEN a.i ELSE a.last END,
 body := CASE WHEN x.sep OR x.field <> '' THEN 0 ELSE {_BODY} END, cuts := CASE WHEN {_NEWMAIL} THEN list_append(a.cuts, a.i) ELSE a.cuts END),
 struct_pack(sep := false, field := '', near := false, i := 0, head := false, seen := CAST([] AS VARCHAR[]), last := -999, body := 0, cuts := CAST([] AS INTEGER[])))"""
page_query("seg1_split_points", f"SELECT dossier_id, doc_code, array_to_string(({_FOLD}).cuts, ',') AS cuts FROM (SELECT dossier_id, doc_code, string_agg(text, chr(10) || chr(10) ORDER BY page_num) AS text FROM fill WHERE category = 'E-mail' GROUP BY 1, 2)", _FILL)(lambda p: _mail_texts(p).select("dossier_id", "doc_code", F.array_join(E.split_points(T.lines(F.col("text"))).cast("array<string>"), ",").alias("cuts")))
page_query("seg2_split_emails")(lambda p: E.split(_mail_texts(p)).drop("attachments"))


def _given(p: DataFrame) -> DataFrame:
    """Structured e-mails: those that pages start, with subject and sender of their own."""
    made = S.emails_of_pages(S.forward_fill(p).where("category = 'E-mail'"))
    return made.select("dossier_id", "doc_code", "n", F.concat(F.lit("S"), F.col("n").cast("string")).alias("subject"), T.sender(F.col("text")).alias("sender"), F.lit("2020-01-01").alias("date"), F.lit(None).cast("string").alias("time"), "pdf_page")


page_query("jn14_enriched_emails")(lambda p: E.enrich(E.split(_mail_texts(p)), _given(p), ["dossier_id", "doc_code"]).select("dossier_id", "doc_code", "n", "subject", "sender", "date", "time"))
page_query("cmp4_chosen_emails")(lambda p: E.choose(E.split(_mail_texts(p)), _given(p), ["dossier_id", "doc_code"]))
page_query("jn12_emails_to_pages")(lambda p: M.match_pages(E.split(_mail_texts(p), fields=["subject", "sender", "date"]).select("dossier_id", "doc_code", F.col("n").cast("int").alias("n"), "subject", "sender", "date"), _given(p).select("dossier_id", "doc_code", "pdf_page", "subject", "sender", "date"), ["dossier_id", "doc_code"]))
page_query("jn13_subject_matches")(lambda p: M.match_subjects(_given(p).select("dossier_id", "n", T.header_value(F.array(F.concat(F.lit("Subject: "), "sender")), "subject").alias("subject")), E.split(_mail_texts(p)).select("dossier_id", "n", F.coalesce("sender", F.lit("")).alias("subject")), ["dossier_id"]))


def _chat_lines(p: DataFrame) -> DataFrame:
    each = p.select("dossier_id", "page_num", F.posexplode(T.lines(F.col("text"))).alias("i", "line"))
    return each.select("dossier_id", (F.col("page_num") * 1000 + F.col("i")).alias("idx"), "line")


_CHAT = r"""chat AS (SELECT dossier_id, idx, trim(CASE WHEN a THEN regexp_extract(line, '^\[([^\]]+)\]\s*([^:]{1,120})\s*:\s*(.+)$', 2) ELSE regexp_extract(line, '^(.+?)\s*\(([^)]+)\)\s*:\s*(.+)$', 1) END) AS sender,
 trim(CASE WHEN a THEN regexp_extract(line, '^\[([^\]]+)\]\s*([^:]{1,120})\s*:\s*(.+)$', 1) ELSE regexp_extract(line, '^(.+?)\s*\(([^)]+)\)\s*:\s*(.+)$', 2) END) AS timestamp,
 trim(CASE WHEN a THEN regexp_extract(line, '^\[([^\]]+)\]\s*([^:]{1,120})\s*:\s*(.+)$', 3) ELSE regexp_extract(line, '^(.+?)\s*\(([^)]+)\)\s*:\s*(.+)$', 3) END) AS body FROM (
 SELECT dossier_id, page_num * 1000 + i - 1 AS idx, string_split(text, chr(10))[i] AS line, regexp_matches(string_split(text, chr(10))[i], '^\[([^\]]+)\]\s*([^:]{1,120})\s*:\s*(.+)$') AS a FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM fx_pages))
 WHERE a OR regexp_matches(line, '^(.+?)\s*\(([^)]+)\)\s*:\s*(.+)$'))"""
page_query("str18_chat_messages", r"SELECT *, regexp_matches(body, '(?i)\[(?:GELAKT|REDACTED)(?::[^\]]*)?\]|\b5\.[12]\.\d[a-z]{0,2}\b') AS is_redacted, regexp_matches(body, '(?i)dit\s+bericht\s+is\s+verwijderd') AS is_system FROM chat", _CHAT)(lambda p: P.chat_messages(_chat_lines(p)))
page_query(
    "cmp3_conversations",
    r"""SELECT l.dossier_id, CAST(l.dossier_id AS VARCHAR) || '-chat-' || left(trim(regexp_replace(lower(array_to_string(participants, '|')), '[^a-z0-9]+', '-', 'g'), '-'), 60) AS thread_id, array_to_string(participants, ',') AS participants, latest, n_messages FROM
 (SELECT dossier_id, left(max_by(body, idx), 200) AS latest, count(*) AS n_messages FROM chat GROUP BY 1) l JOIN (SELECT dossier_id, list(sender ORDER BY f) AS participants FROM (SELECT dossier_id, min_by(sender, idx) AS sender, min(idx) AS f FROM chat GROUP BY dossier_id, lower(sender)) GROUP BY 1) p ON l.dossier_id = p.dossier_id""",
    _CHAT,
)(lambda p: P.conversations(P.chat_messages(_chat_lines(p))).withColumn("participants", F.array_join("participants", ",")))


@query("cmp3_conversation_participants", "SELECT conv_id, string_agg(role, ',' ORDER BY f) AS participants, CAST(max(n) AS BIGINT) AS n_messages FROM (SELECT conv_id, role, min(turn) AS f, sum(count(*)) OVER (PARTITION BY conv_id) AS n FROM conversations GROUP BY 1, 2) GROUP BY 1")
def _talks(spark: SparkSession, sf: str) -> DataFrame:
    rows = FX.read(spark, sf, "conversations").select("conv_id", F.col("turn").alias("idx"), F.col("role").alias("sender"), F.coalesce("text", F.lit("")).alias("body"))
    return P.conversations(rows, "conv_id").select("conv_id", F.array_join("participants", ",").alias("participants"), "n_messages")


def _inventory_lines(spark: SparkSession, sf: str) -> DataFrame:
    return FX.read(spark, sf, "part").select((F.col("p_partkey") % 20).alias("dossier_id"), F.col("p_partkey").alias("idx"), F.expr(_INV).alias("line"))


_INV = "CASE p_partkey % 5 WHEN 0 THEN 'Nummer titel' WHEN 1 THEN '6839 ' || cast(p_partkey % 300 as string) || ' ' || p_name || ' openbaar' WHEN 2 THEN cast(p_partkey % 300 as string) || ' ' || p_type || ', 5.1.2e BR' WHEN 3 THEN 'geen rij' ELSE cast(p_size as string) || ' ab' END"
_INV_SQL = rf"""SELECT dossier_id, number, min_by(title, idx) AS title FROM (SELECT dossier_id, idx, lpad(regexp_extract(line, '{T.INVENTORY_ROW}', 1), CAST(greatest(4, length(regexp_extract(line, '{T.INVENTORY_ROW}', 1))) AS INTEGER), '0') AS number,
 rtrim(trim(regexp_replace(regexp_extract(line, '{T.INVENTORY_ROW}', 2), '{T.INVENTORY_GROUNDS}', '')), '.,') AS title FROM (SELECT p_partkey % 20 AS dossier_id, p_partkey AS idx, {_INV} AS line FROM part) WHERE regexp_matches(line, '{T.INVENTORY_ROW}') AND NOT regexp_matches(line, '{T.INVENTORY_SKIP}')) WHERE length(title) >= 4 GROUP BY 1, 2"""
query("cmp8_inventory", _INV_SQL)(lambda spark, sf: P.inventory(_inventory_lines(spark, sf)))
query("agg12_inventory_first", "SELECT p_brand AS code, min(p_partkey) AS p_partkey FROM part WHERE p_size % 3 <> 0 GROUP BY 1 UNION ALL SELECT NULL, p_partkey FROM part WHERE p_size % 3 = 0")(
    lambda spark, sf: FX.read(spark, sf, "part").withColumn("code", F.when(F.col("p_size") % 3 != 0, F.col("p_brand"))).withColumn("r", F.row_number().over(Window.partitionBy("code", F.when(F.col("code").isNull(), F.col("p_partkey"))).orderBy("p_partkey"))).where("r = 1").select("code", "p_partkey")
)

# -- plans, sources, order ----------------------------------------------------------------------------------

page_query("timeline")(lambda p: P.timeline(P.dated(P.assemble(S.forward_fill(p)))))
page_query("ord1_chronological", "SELECT dossier_id, page_num, CAST(row_number() OVER (PARTITION BY dossier_id ORDER BY doc_date ASC NULLS LAST, CASE WHEN doc_date IS NULL THEN coalesce(detected_code, '') END, page_num) AS INTEGER) AS position FROM fx_pages")(
    lambda p: p.select("dossier_id", "page_num", F.row_number().over(Window.partitionBy("dossier_id").orderBy(F.col("doc_date").asc_nulls_last(), F.when(F.col("doc_date").isNull(), F.coalesce("detected_code", F.lit(""))), "page_num")).alias("position"))
)
page_query("ord9_top_by_count", "SELECT category, n FROM (SELECT category, count(*) AS n FROM fx_pages GROUP BY 1) ORDER BY n DESC, category LIMIT 1")(lambda p: p.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(1))
page_query("flt1_page_range", "SELECT dossier_id, page_num FROM fx_pages WHERE page_num BETWEEN 2 AND 5")(lambda p: DF.page_range(p, 2, 5).select("dossier_id", "page_num"))
page_query("src12_concatenated", "SELECT dossier_id % 10 AS dossier_id, CAST(page_num + coalesce(o, 0) AS BIGINT) AS page_num, okey FROM fx_pages JOIN (SELECT dossier_id AS d, sum(n) OVER (PARTITION BY dossier_id % 10 ORDER BY dossier_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM fx_total) ON d = dossier_id", FX.SQL_BOUNDS)(
    lambda p: DF.concatenated(p.select((F.col("dossier_id") % 10).alias("dossier_id"), F.col("dossier_id").alias("part"), "page_num", "okey"))
)
page_query("src16_searchable", "SELECT dossier_id, bool_or(length(trim(text)) > 0) AS searchable FROM fx_pages GROUP BY 1")(lambda p: p.groupBy("dossier_id").agg(F.bool_or(F.length(T.strip(F.col("text"))) > 0).alias("searchable")))
page_query("win14_text_budget", "SELECT dossier_id, string_agg(category, ', ' ORDER BY page_num) AS listed FROM (SELECT *, sum(length(category) + 2) OVER (PARTITION BY dossier_id ORDER BY page_num ROWS UNBOUNDED PRECEDING) AS used FROM fx_pages) WHERE used <= 60 GROUP BY 1")(
    lambda p: p.withColumn("used", F.sum(F.length("category") + 2).over(S.upto())).where("used <= 60").groupBy("dossier_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "category"))), lambda x: x["category"]), ", ").alias("listed"))
)
page_query("flt15_unstamped_pages", "SELECT dossier_id, page_num FROM fx_pages WHERE detected_code IS NULL AND dossier_id IN (SELECT dossier_id FROM fx_pages GROUP BY 1 HAVING count(DISTINCT detected_code) >= 2)")(
    lambda p: p.join(p.groupBy("dossier_id").agg(F.countDistinct("detected_code").alias("c")).where("c >= 2"), "dossier_id", "left_semi").where("detected_code is null").select("dossier_id", "page_num")
)


def queries() -> dict[str, Query]:
    from . import annotation_queries, product_queries  # noqa: F401  they register more

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
