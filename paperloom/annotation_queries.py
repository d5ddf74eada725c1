"""More registered queries: annotation, profile, page records, orders and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import dates as D
from .functions import providers
from .functions import repair
from .functions import text as T
from .operators import evaluate as V
from .operators import sequence as S
from .plans import dossier as P
from .queries import _FILL, _LINES, _OCR_CODES, _SEGS, _metrics_sql, evaluation, page_query, query, same
from .sources import fixtures as FX

# -- filters and projections ------------------------------------------------------------------

page_query("flt2_first_pages", "SELECT dossier_id, page_num FROM fx_pages WHERE page_num <= 3")(lambda p: p.where("page_num <= 3").select("dossier_id", "page_num"))
page_query("flt16_report_pages_with_text", "SELECT dossier_id, page_num FROM fx_pages WHERE category = 'Report' AND trim(text) <> ''")(lambda p: p.where((F.col("category") == "Report") & (T.strip(F.col("text")) != "")).select("dossier_id", "page_num"))
page_query("flt18_email_start_candidates", "SELECT dossier_id, page_num FROM fx_pages WHERE email_start AND category = 'E-mail'")(lambda p: p.where((F.col("category") == "E-mail") & F.col("email_start")).select("dossier_id", "page_num"))
page_query("flt19_counted_emails", "SELECT dossier_id, page_num, okey % 4 AS num_emails_gt FROM fx_pages WHERE category = 'E-mail' AND okey % 3 <> 0")(
    lambda p: p.withColumn("num_emails_gt", F.when(F.col("okey") % 3 != 0, F.col("okey") % 4)).where((F.col("category") == "E-mail") & F.col("num_emails_gt").isNotNull()).select("dossier_id", "page_num", "num_emails_gt")
)
page_query("flt21_next_open_page", "SELECT dossier_id, arg_min(page_num, (page_num - 2 - 1 + n) % n) AS page_num FROM (SELECT *, count(*) OVER (PARTITION BY dossier_id) AS n FROM fx_pages) WHERE okey % 3 = 0 GROUP BY 1")(
    lambda p: p.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("dossier_id"))).where("okey % 3 = 0").groupBy("dossier_id").agg(F.min_by("page_num", (F.col("page_num") - 3 + F.col("n")) % F.col("n")).alias("page_num"))
)
_STATUS = "CASE WHEN okey % 3 = 0 AND category <> 'Other' THEN 'done' WHEN okey % 3 = 0 THEN 'partial' WHEN category = 'E-mail' THEN 'emails' ELSE 'open' END"
page_query("flt22_status", f"SELECT dossier_id, page_num, {_STATUS} AS status FROM fx_pages")(
    lambda p: p.select("dossier_id", "page_num", F.when((F.col("okey") % 3 == 0) & (F.col("category") != "Other"), "done").when(F.col("okey") % 3 == 0, "partial").when(F.col("category") == "E-mail", "emails").otherwise("open").alias("status"))
)
same("flt13_redacted_chat_body", "CASE o_orderkey % 4 WHEN 0 THEN '5.1.2e, [GELAKT: 5.1.1]' WHEN 1 THEN ' [REDACTED] ' WHEN 2 THEN 'ja 5.1.2e' ELSE o_orderpriority END", "orders", "o_orderkey", f"CASE WHEN regexp_matches(trim(x), '{T.CHAT_ALL_REDACTED}') THEN '[Bericht weggelakt]' ELSE trim(x) END")(T.chat_body)
same("str20_chat_sender", "CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE o_orderstatus END", "orders", "o_orderkey", "CASE WHEN x = '' THEN 'Eigenaar' WHEN trim(x) = '' THEN 'Onbekend' ELSE x END")(lambda x: T.chat_sender(x, F.lit("right")))
same("str19_thread_id", "o_orderpriority || ' / ' || o_orderstatus", "orders", "o_orderkey", "'0001-chat-' || left(trim(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '-'), 60)")(lambda x: T.thread_id(F.lit("0001"), F.array(x), F.lit("")))
same("str25_inventory_title", "p_name || ' 5.1.2e BR'", "part", "p_partkey", "rtrim(trim(regexp_replace(x, '" + T.INVENTORY_GROUNDS + "', '')), '.,')")(lambda x: T.inventory_row(F.concat(F.lit("0012 "), x))["title"])
same("dt2_month_table", "CASE month(o_orderdate) " + " ".join(f"WHEN {n} THEN '{m}'" for m, n in list(D.DUTCH.items())) + " END", "orders", "o_orderkey", "CASE x " + " ".join(f"WHEN '{m}' THEN {n}" for m, n in D.DUTCH.items()) + " END")(
    lambda x: F.try_element_at(F.create_map(*[F.lit(v) for kv in D.MONTHS.items() for v in kv]), x)
)


@query("prj1_page_records", "SELECT event_id, coalesce(nullif(trim(event_type), ''), '') AS text, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(event_id % 5 AS VARCHAR) END AS INTEGER) AS within_doc_page, CASE event_id % 4 WHEN 0 THEN 'E-mail' WHEN 1 THEN 'Nota' ELSE 'Other' END AS category, event_id % 4 = 0 AND event_id % 8 = 0 AS email_start FROM events")
def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Raw records: labels, numbers and flags of the wrong kind become defaults."""
    raw = FX.read(spark, sf, "events").selectExpr("event_id", "event_type", "case when event_id % 3 = 0 then 'x' else cast(event_id % 5 as string) end as wpn", "case event_id % 4 when 0 then 'email' when 1 then 'nota ' when 2 then 'odd' end as label", "event_id % 8 in (0, 1) as start")
    cat = T.category(F.coalesce("label", F.lit("Other")))
    return raw.select("event_id", T.strip(F.coalesce("event_type", F.lit(""))).alias("text"), F.col("wpn").try_cast("int").alias("within_doc_page"), cat.alias("category"), (F.col("start") & (cat == "E-mail")).alias("email_start"))


_JSON_OBJECT = "'{\"0001\": ' || cast(o_orderkey as string) || ', \"0002\": 7}'"
query("js4_object_rows", "SELECT o_orderkey, '0001' AS code, o_orderkey AS v FROM orders UNION ALL SELECT o_orderkey, '0002', 7 FROM orders")(
    lambda spark, sf: FX.read(spark, sf, "orders").select("o_orderkey", F.explode(F.from_json(F.expr(_JSON_OBJECT), "map<string,bigint>")).alias("code", "v"))
)
query("js5_serialised", "SELECT o_orderkey, '{\"k\":' || o_orderkey || ',\"p\":\"' || o_orderpriority || ' é\"}' AS j FROM orders")(
    lambda spark, sf: FX.read(spark, sf, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.concat("o_orderpriority", F.lit(" é")).alias("p"))).alias("j"))
)
query("js2_parsed_or_repaired", "SELECT event_id, event_id AS k FROM events")(
    lambda spark, sf: FX.read(spark, sf, "events").select("event_id", repair.parsed(F.concat(F.lit('{"k": '), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "}").otherwise(', "s": "cut')), "k bigint")["k"].alias("k"))
)

# -- joins ------------------------------------------------------------------------------------------

page_query("jn2_attach_by_index", "SELECT p.dossier_id, p.page_num, r.code AS raster_code FROM fx_pages p LEFT JOIN (SELECT dossier_id, page_num, lpad(CAST(okey % 500 AS VARCHAR), 4, '0') AS code FROM fx_pages WHERE okey % 6 = 0) r ON p.dossier_id = r.dossier_id AND p.page_num = r.page_num")(
    lambda p: p.select("dossier_id", "page_num").join(p.where("okey % 6 = 0").select("dossier_id", "page_num", F.lpad((F.col("okey") % 500).cast("string"), 4, "0").alias("raster_code")), ["dossier_id", "page_num"], "left")
)
evaluation("jn8_positional_two_lists", "SELECT g.dossier_id, g.i, g.lo AS gt_lo, p.lo AS a_lo, q.lo AS b_lo FROM gseg g LEFT JOIN pseg p ON g.dossier_id = p.dossier_id AND g.i = p.i LEFT JOIN (SELECT dossier_id, page_num - 1 AS lo, row_number() OVER (PARTITION BY dossier_id ORDER BY page_num) AS i FROM fx_pages WHERE okey % 4 = 1) q ON g.dossier_id = q.dossier_id AND g.i = q.i", _SEGS)(
    lambda t, q, p: S.intervals(t, n := FX.totals(p)).select("dossier_id", "i", F.col("lo").alias("gt_lo")).join(S.intervals(q, n).select("dossier_id", "i", F.col("lo").alias("a_lo")), ["dossier_id", "i"], "left")
    .join(p.where("okey % 4 = 1").select("dossier_id", (F.col("page_num") - 1).alias("b_lo"), F.row_number().over(S.in_order()).alias("i")), ["dossier_id", "i"], "left")
)
_ANN = "ann AS (SELECT dossier_id, CAST(page_num - 1 AS VARCHAR) AS k, category AS type_gt FROM fx_pages WHERE okey % 5 = 0 AND okey % 2 = 0)"
evaluation("jn9_annotations_by_key", "SELECT g.dossier_id, g.page0, CASE WHEN a.type_gt IS NULL THEN 'Other' ELSE a.type_gt END AS gt FROM fx_gt g LEFT JOIN ann a ON g.dossier_id = a.dossier_id AND CAST(g.page0 AS VARCHAR) = a.k", _ANN)(
    lambda t, q, p: t.withColumn("k", F.col("page0").cast("string")).join(p.where("okey % 5 = 0 and okey % 2 = 0").select("dossier_id", (F.col("page_num") - 1).cast("string").alias("k"), F.col("category").alias("type_gt")), ["dossier_id", "k"], "left").select("dossier_id", "page0", T.evaluated_type(F.coalesce("type_gt", F.lit("")), True).alias("gt"))
)
page_query("jn16_emails_by_code", "SELECT p.dossier_id, p.page_num, e.n FROM fill p LEFT JOIN (SELECT dossier_id, doc_code, count(*) AS n FROM fill WHERE email_start GROUP BY 1, 2) e ON p.dossier_id = e.dossier_id AND p.doc_code = e.doc_code", _FILL)(
    lambda p: (f := S.forward_fill(p)).select("dossier_id", "page_num", "doc_code").join(f.where("email_start").groupBy("dossier_id", "doc_code").agg(F.count(F.lit(1)).alias("n")), ["dossier_id", "doc_code"], "left").select("dossier_id", "page_num", "n")
)
page_query("jn17_date_overlay", "SELECT f.dossier_id, f.page_num, d.doc_date FROM fill f LEFT JOIN (SELECT dossier_id, doc_code, max(doc_date) AS doc_date FROM fill GROUP BY 1, 2) d ON f.dossier_id = d.dossier_id AND f.doc_code = d.doc_code", _FILL)(
    lambda p: (f := S.forward_fill(p)).select("dossier_id", "page_num", "doc_code").join(f.groupBy("dossier_id", "doc_code").agg(F.max("doc_date").alias("doc_date")), ["dossier_id", "doc_code"], "left").select("dossier_id", "page_num", "doc_date")
)
evaluation("jn19_first_containing", "SELECT p.dossier_id, p.page_num - 1 AS page0, min(s.i) AS i FROM fx_pages p JOIN pseg s ON p.dossier_id = s.dossier_id AND s.lo <= p.page_num - 1 AND p.page_num - 1 < s.hi GROUP BY 1, 2", _SEGS)(
    lambda t, q, p: p.select("dossier_id", (F.col("page_num") - 1).alias("page0")).join(S.intervals(q, FX.totals(p)), "dossier_id").where((F.col("lo") <= F.col("page0")) & (F.col("page0") < F.col("hi"))).groupBy("dossier_id", "page0").agg(F.min("i").alias("i"))
)

# -- aggregates, profile and annotation metrics ---------------------------------------------------------

page_query("agg14_code_length_mode", "SELECT dossier_id, arg_max(l, (n, -f)) AS length FROM (SELECT dossier_id, length(regexp_replace(CAST(okey AS VARCHAR), '\\D', '', 'g')) AS l, count(*) AS n, min(page_num) AS f FROM fx_pages GROUP BY 1, 2) GROUP BY 1")(
    lambda p: p.groupBy("dossier_id", F.length(F.regexp_replace(F.col("okey").cast("string"), r"\D", "")).cast("long").alias("l")).agg(F.count(F.lit(1)).alias("n"), F.min("page_num").alias("f")).groupBy("dossier_id").agg(F.max_by("l", F.struct("n", -F.col("f"))).alias("length"))
)
page_query("agg15_repeated_code", "SELECT dossier_id, arg_max(detected_code, (n, -f)) AS example FROM (SELECT dossier_id, detected_code, count(*) AS n, min(page_num) AS f FROM fx_pages WHERE detected_code IS NOT NULL GROUP BY 1, 2) WHERE n >= 2 GROUP BY 1")(
    lambda p: p.where("detected_code is not null").groupBy("dossier_id", "detected_code").agg(F.count(F.lit(1)).alias("n"), F.min("page_num").alias("f")).where("n >= 2").groupBy("dossier_id").agg(F.max_by("detected_code", F.struct("n", -F.col("f"))).alias("example"))
)
page_query("agg19_email_count_rate", "SELECT dossier_id, avg(CAST(okey % 4 IS NOT DISTINCT FROM CASE WHEN okey % 5 <> 0 THEN okey % 3 END AS INTEGER)) AS rate FROM fx_pages WHERE category = 'E-mail' GROUP BY 1")(
    lambda p: p.where("category = 'E-mail'").groupBy("dossier_id").agg(F.avg((F.col("okey") % 4).eqNullSafe(F.when(F.col("okey") % 5 != 0, F.col("okey") % 3)).cast("int")).alias("rate"))
)
page_query("agg24_date_rate", "SELECT dossier_id, avg(CAST(doc_date IS NOT NULL AS INTEGER)) AS rate FROM fx_pages GROUP BY 1")(lambda p: p.groupBy("dossier_id").agg(F.avg(F.col("doc_date").isNotNull().cast("int")).alias("rate")))


def _both(t: DataFrame, q: DataFrame, p: DataFrame) -> DataFrame:
    """Boundary metrics of two pipelines, as a pipeline column and a macro row for each."""
    other = p.where("page_num = 1 or okey % 4 = 1").select("dossier_id", (F.col("page_num") - 1).alias("page0"))
    rows = [V.with_macro(V.page_metrics(t, x), ["precision", "recall", "f1"]).where("dossier_id = 'ALL'").select(F.lit(n).alias("pipeline"), "precision", "recall", "f1") for n, x in (("A", q), ("B", other))]
    return rows[0].unionByName(rows[1])


_MACRO = "SELECT '{n}' AS pipeline, avg(precision) AS precision, avg(recall) AS recall, avg(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0)) AS f1 FROM {m}"
_OTHER = "fx_other AS (SELECT dossier_id, page_num - 1 AS page0 FROM fx_pages WHERE page_num = 1 OR okey % 4 = 1)"
evaluation("cmp6_two_pipelines", _MACRO.format(n="A", m="m") + " UNION ALL " + _MACRO.format(n="B", m="m2"), _OTHER, _metrics_sql(), _metrics_sql().replace("m AS", "m2 AS", 1).replace("fx_pred", "fx_other"))(_both)
evaluation(
    "agg25_annotation_row",
    "SELECT (SELECT count(*) FROM fx_gt) AS n_gt, (SELECT count(*) FROM fx_pred) AS n_pred, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, avg(precision) AS precision, avg(recall) AS recall FROM m",
    _metrics_sql("WHERE page0 > 0"),
)(lambda t, q, p: V.page_metrics(t, q, skip_first=True).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall")).crossJoin(F.broadcast(t.agg(F.count(F.lit(1)).alias("n_gt")))).crossJoin(F.broadcast(q.agg(F.count(F.lit(1)).alias("n_pred")))))
page_query("seg5_segments", f"SELECT dossier_id, doc_code, min(page_num) - 1 AS start_page, max(page_num) - 1 AS end_page, CAST(sum(len({_OCR_CODES})) AS BIGINT) AS n_redactions, CAST(sum(CAST(email_start AS INTEGER)) AS BIGINT) AS num_emails FROM fill GROUP BY 1, 2", _FILL)(
    lambda p: S.forward_fill(p).groupBy("dossier_id", "doc_code").agg((F.min("page_num") - 1).alias("start_page"), (F.max("page_num") - 1).alias("end_page"), F.sum(F.size(T.redaction_codes_ocr(F.col("text")))).alias("n_redactions"), F.count_if("email_start").alias("num_emails"))
)

# -- order and sets -----------------------------------------------------------------------------------------

page_query("ord4_stable_start_order", "SELECT dossier_id, page_num, CAST(row_number() OVER (PARTITION BY dossier_id ORDER BY coalesce(within_doc_page, 1), page_num) AS INTEGER) AS r FROM fx_pages")(
    lambda p: p.select("dossier_id", "page_num", F.row_number().over(Window.partitionBy("dossier_id").orderBy(F.coalesce("within_doc_page", F.lit(1)), "page_num")).alias("r"))
)
page_query("ord8_first_codes", f"SELECT dossier_id, page_num, array_to_string(({_OCR_CODES})[1:3], ',') AS codes FROM fx_pages")(lambda p: p.select("dossier_id", "page_num", F.array_join(F.slice(T.redaction_codes_ocr(F.col("text")), 1, 3), ",").alias("codes")))
page_query("ord10_flattened_lines", f"SELECT dossier_id, page_num, i, ({_LINES})[i] AS line FROM (SELECT *, unnest(range(1, len({_LINES}) + 1)) AS i FROM fx_pages)")(lambda p: p.select("dossier_id", "page_num", F.posexplode(T.lines(F.col("text"))).alias("i", "line")).withColumn("i", F.col("i").cast("long") + 1))
page_query("set4_union_of_indices", "SELECT dossier_id, page_num, array_to_string(list_sort(list_distinct([okey % 7, okey % 5, page_num])), ',') AS ids FROM fx_pages")(
    lambda p: p.select("dossier_id", "page_num", F.array_join(F.array_sort(F.array_union(F.array(F.col("okey") % 7, F.col("okey") % 5), F.array("page_num"))).cast("array<string>"), ",").alias("ids"))
)
page_query("set6_ordered_distinct", "SELECT dossier_id, string_agg(category, ',' ORDER BY f) AS categories FROM (SELECT dossier_id, category, min(page_num) AS f FROM fx_pages GROUP BY 1, 2) GROUP BY 1")(
    lambda p: p.groupBy("dossier_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "category"))), lambda x: x["category"])), ",").alias("categories"))
)
page_query("set7_dated_and_undated", "SELECT * FROM (SELECT dossier_id, page_num, 'dated' AS part FROM fx_pages WHERE doc_date IS NOT NULL UNION ALL SELECT dossier_id, page_num, 'undated' FROM fx_pages WHERE doc_date IS NULL)")(
    lambda p: p.where("doc_date is not null").select("dossier_id", "page_num", F.lit("dated").alias("part")).unionByName(p.where("doc_date is null").select("dossier_id", "page_num", F.lit("undated").alias("part")))
)
page_query("udf3_summaries", r"SELECT dossier_id, page_num, rtrim(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 220), ' ,.;:') || '.' AS summary FROM fx_pages")(
    lambda p: providers.with_answers(p.select("dossier_id", "page_num", "text"), "text", "summary", T.summary(F.col("text"), F.lit("Overig"))).select("dossier_id", "page_num", "summary")
)
page_query("cmp5_statistics", f"SELECT (SELECT count(*) FROM fx_pages) AS n_pages, (SELECT count(*) FROM (SELECT DISTINCT dossier_id, doc_code FROM fill)) AS n_documents, (SELECT CAST(sum(len({_OCR_CODES})) AS BIGINT) FROM fx_pages) AS n_redactions", _FILL)(
    lambda p: P.assemble(S.forward_fill(p)).agg(F.sum(F.size("pages")).alias("n_pages"), F.count(F.lit(1)).alias("n_documents"), F.sum(F.size("codes")).alias("n_redactions"))
)
