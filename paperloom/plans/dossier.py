"""Composite plans: pages to documents, timeline, e-mails, chats, statistics; and the choice of strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..operators import emails as E
from ..operators import sequence as S


def assemble(pages: DataFrame) -> DataFrame:
    """One row per (dossier_id, doc_code): first and last page, pages, joined text, redaction counts and category."""
    parts = F.array_sort(F.collect_list(F.struct("page_num", F.coalesce("text", F.lit("")).alias("text"))))
    docs = pages.groupBy("dossier_id", "doc_code").agg(parts.alias("_p"), F.min_by("doc_date", F.when(T.blank_to_null(F.col("doc_date")).isNotNull(), F.col("page_num"))).alias("doc_date"))
    texts = F.transform("_p", lambda x: x["text"])
    docs = docs.select(
        "dossier_id", "doc_code", F.transform("_p", lambda x: x["page_num"]).alias("pages"), F.array_join(texts, "\n\n").alias("text"),
        T.keyword_category(F.array_join(texts, "\n\n"), F.col("_p")[0]["text"]).alias("category"), T.blank_to_null(F.col("doc_date")).alias("doc_date"),
        # codes of each page apart, as a code never spans two pages
        F.flatten(F.transform(texts, T.redaction_codes_ocr)).alias("codes"),
    )
    return docs.withColumn("redactions", T.counted(F.col("codes")))


def dated(docs: DataFrame, mail_dates: Column | None = None) -> DataFrame:
    """Adds date and date_raw; e-mail documents take the first of their e-mails' dates (mail_dates, where they are known) that parses."""
    # in the document's own row: no join back, and nothing is computed twice
    known = E.mail_dates(F.col("text")) if mail_dates is None else mail_dates
    mails = F.when(F.col("category") == "E-mail", known).otherwise(F.array().cast("array<string>"))
    both = docs.withColumn("mail_dates", mails)
    found = D.document_date(F.col("doc_date"), F.col("category"), F.col("text"), F.col("mail_dates"))
    return both.withColumn("_d", found).withColumn("date", F.col("_d.date")).withColumn("date_raw", F.col("_d.raw")).drop("_d", "mail_dates")


def timeline(docs: DataFrame, *keep: str) -> DataFrame:
    """The dossier's documents in the order of their dates, those without a date last, by code; with columns of docs to ``keep``."""
    w = Window.partitionBy("dossier_id").orderBy(F.col("date").asc_nulls_last(), "doc_code")
    return docs.select("dossier_id", F.row_number().over(w).alias("position"), *cards(), *keep)


def cards() -> list[Column]:
    """A dated document as the timeline shows it."""
    first, codes = F.array_min("pages"), F.array_distinct("codes")
    return [
        F.col("doc_code"), F.col("category"), F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("date_raw"),
        T.type_label(F.col("category"), F.lit("other")).alias("label"), T.title(F.col("category") == "E-mail", F.lit(None).cast("string"), F.col("text"), F.col("doc_code")).alias("title"),
        T.sender(F.col("text")).alias("sender"), T.description(F.col("category"), F.lit(None).cast("string"), F.col("text"), codes).alias("description"),
        F.left("text", F.lit(800)).alias("preview"), first.alias("page_start"), F.array_max("pages").alias("page_end"), F.size("codes").cast("long").alias("n_redactions"),
    ]


def redaction_totals(docs: DataFrame) -> DataFrame:
    """dossier_id, code, n over all documents."""
    return docs.select("dossier_id", F.explode("codes").alias("code")).groupBy("dossier_id", "code").agg(F.count(F.lit(1)).alias("n"))


def coverage(pages: DataFrame) -> DataFrame:
    """dossier_id, pages, stamped, coverage, distinct_codes, monotone and step_one ratios of the stamps."""
    w = Window.partitionBy("dossier_id").orderBy("page_num")
    has = pages.where(T.blank_to_null(F.col("detected_code")).isNotNull()).withColumn("step", F.col("detected_code").cast("int") - F.lag(F.col("detected_code").cast("int")).over(w))
    steps = has.groupBy("dossier_id").agg(
        F.count(F.lit(1)).alias("stamped"), F.countDistinct("detected_code").alias("distinct_codes"),
        F.coalesce(F.avg((F.col("step") >= 0).cast("int")), F.lit(1.0)).alias("monotone"), F.coalesce(F.avg((F.col("step") == 1).cast("int")), F.lit(1.0)).alias("step_one"),
    )
    all_ = pages.groupBy("dossier_id").agg(F.count(F.lit(1)).alias("pages")).join(steps, "dossier_id", "left")
    return all_.select("dossier_id", "pages", F.coalesce("stamped", F.lit(0)).alias("stamped"), (F.coalesce("stamped", F.lit(0)) / F.col("pages")).alias("coverage"), F.coalesce("distinct_codes", F.lit(0)).alias("distinct_codes"), F.coalesce("monotone", F.lit(1.0)).alias("monotone"), F.coalesce("step_one", F.lit(1.0)).alias("step_one"))


def survey(pages: DataFrame) -> DataFrame:
    """dossier_id, has_stamps, page_counter, lo and hi code, n_jumps: whether a dossier's stamps are document codes."""
    c = coverage(pages)
    counter = (F.col("distinct_codes") / F.col("stamped") > 0.9) & (F.col("stamped") >= 4) & (F.col("step_one") > 0.8)
    enough = (F.col("distinct_codes") >= 2) & (F.col("coverage") >= 0.1) & (F.col("monotone") >= 0.6)
    c = c.withColumn("page_counter", F.coalesce(enough & counter, F.lit(False))).withColumn("has_stamps", enough & ~F.col("page_counter"))
    r = S.runs(pages, "detected_code")
    span = r.groupBy("dossier_id").agg(
        F.coalesce(F.min(F.when(F.col("length") >= 2, F.col("detected_code"))), F.min("detected_code")).alias("lo"), F.coalesce(F.max(F.when(F.col("length") >= 2, F.col("detected_code"))), F.max("detected_code")).alias("hi"),
    )
    jumps = S.large_jumps(pages, "detected_code").groupBy("dossier_id").agg(F.count(F.lit(1)).alias("n_jumps"))
    out = c.join(span, "dossier_id", "left").join(jumps, "dossier_id", "left")
    only = lambda x: F.when(F.col("has_stamps"), x)
    return out.select("dossier_id", "has_stamps", "page_counter", only(F.col("lo")).alias("lo"), only(F.col("hi")).alias("hi"), F.coalesce(only(F.col("n_jumps")), F.lit(0)).alias("n_jumps"))


def route(pages: DataFrame, threshold: Column | float = 0.30) -> DataFrame:
    """doc_code and method of each page: stamps where a dossier's coverage reaches the threshold, else boundaries by page signals."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    # both assignments and the coverage are windows by dossier: one shuffle
    filled = S.forward_fill_split(pages).withColumnRenamed("doc_code", "_a")
    both = S.boundary_numbers(filled, T.is_new_vlm(F.col("is_new_document"), F.col("within_doc_page"))).withColumnRenamed("doc_code", "_b")
    stamped = T.blank_to_null(F.col("detected_code")).isNotNull().cast("int")
    both = both.withColumn("_stamps", F.avg(stamped).over(Window.partitionBy("dossier_id")) >= limit)
    return both.withColumn("doc_code", F.when(F.col("_stamps"), F.col("_a")).otherwise(F.col("_b"))).withColumn("method", F.when(F.col("_stamps"), "stamp").otherwise("boundary")).drop("_a", "_b", "_stamps")


def chat_messages(lines: DataFrame) -> DataFrame:
    """dossier_id, idx, sender, timestamp, body, flags of the chat messages among a text's lines (columns dossier_id, idx, line)."""
    got = lines.withColumn("_c", T.chat_line(F.col("line"))).where(F.col("_c").isNotNull())
    body = T.chat_body(F.col("_c.body"))
    out = got.select("dossier_id", "idx", F.col("_c.sender").alias("sender"), F.col("_c.stamp").alias("timestamp"), body.alias("body")).where((F.col("sender") != "") & (F.col("body") != ""))
    redacted, system = T.chat_flags(F.col("body"))
    return out.withColumn("is_redacted", redacted).withColumn("is_system", system)


def conversations(messages: DataFrame, key: str = "dossier_id") -> DataFrame:
    """key, thread_id, participants (first spelling, in order), latest (200 characters), n_messages."""
    by = Window.partitionBy(key, F.lower(T.strip(F.col("sender")))).orderBy("idx")
    first = messages.where(T.strip(F.col("sender")) != "").withColumn("_r", F.row_number().over(by)).where("_r = 1")
    people = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col("sender").alias("s")))), lambda x: x["s"]).alias("participants"))
    last = messages.groupBy(key).agg(F.left(F.max_by("body", F.when(T.strip(F.col("body")) != "", F.col("idx"))), F.lit(200)).alias("latest"), F.count(F.lit(1)).alias("n_messages"))
    both = last.join(people, key, "left")
    return both.select(key, T.thread_id(F.col(key).cast("string"), F.col("participants"), F.lit("")).alias("thread_id"), "participants", F.coalesce("latest", F.lit("")).alias("latest"), "n_messages")


def from_boundaries(pages: DataFrame, bounds: DataFrame) -> DataFrame:
    """doc_code by boundary documents (dossier_id, pos, doc_code, start_page); a page before all of them gets auto_<page>.

    A document without a valid code is auto_<its place in the order of start pages>; of documents that
    start on one page, the last in list order holds it.
    """
    order = Window.partitionBy("dossier_id").orderBy("start_page", "pos")
    placed = bounds.withColumn("start_page", F.coalesce("start_page", F.lit(1))).withColumn("_i", F.row_number().over(order))
    auto = lambda n: F.concat(F.lit("auto_"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")))
    code = F.coalesce(T.doc_code(F.col("doc_code")), auto(F.col("_i")))
    marks = placed.select("dossier_id", F.col("start_page").cast("long").alias("page_num"), F.struct("_i", code.alias("code")).alias("_m")).groupBy("dossier_id", "page_num").agg(F.max("_m").alias("_m"))
    w = Window.partitionBy("dossier_id").orderBy("page_num").rowsBetween(Window.unboundedPreceding, 0)
    joined = pages.join(marks, ["dossier_id", "page_num"], "left")
    return joined.withColumn("doc_code", F.coalesce(F.last("_m", ignorenulls=True).over(w)["code"], auto(F.col("page_num")))).drop("_m")


def inventory(lines: DataFrame) -> DataFrame:
    """dossier_id, number, title: the rows of an inventory table's lines (dossier_id, idx, line), the first of each number."""
    rows = lines.withColumn("_r", T.inventory_row(F.col("line"))).where(F.col("_r").isNotNull())
    return rows.groupBy("dossier_id", F.col("_r.number").alias("number")).agg(F.min_by("_r.title", "idx").alias("title"))
