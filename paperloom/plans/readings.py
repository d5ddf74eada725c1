"""What models tell of pages and documents: page records, boundary documents, titles and summaries.

A provider is the caller's (``functions/providers.py``); each different input is asked once, answers are
repaired where they were cut short, and what a model doesn't tell has a default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import providers, repair
from ..functions import text as T
from ..operators import sequence as S
from . import dossier as P

MESSAGE = "struct<sender_position:string,sender_label:string,timestamp:string,is_system_message:boolean,content:string>"
#: The shape of a page's answer; numbers and flags come as text, as models write them in any form.
RECORD = (
    f"text string, doc_code string, is_new_document string, within_doc_page string, category string, doc_subtype string, chat_name string, chat_messages array<{MESSAGE}>, email_start string, "
    "email_from string, email_to string, email_cc string, email_subject string, email_date string, doc_date string, doc_sender string"
)
BOUNDARIES = "documents array<struct<doc_code:string,start_page:string,email_starts:array<string>>>"
#: Chat messages that a summary is asked about.
CHAT_MESSAGES = 20


def flag(value: Column) -> Column:
    return F.coalesce(F.lower(T.strip(value)).isin("true", "1", "yes", "ja"), F.lit(False))


def page_records(raw: DataFrame) -> DataFrame:
    """Pages of raw records (the columns of RECORD as far as they are there): types coerced, labels canonical, the rest default.

    An e-mail start counts on e-mail pages alone; a page number that isn't one is null; the stamp takes its four-digit form.
    """
    names = [x.strip().split(" ", 1) for x in RECORD.replace(MESSAGE, "MESSAGE").split(", ")]
    have = raw.withColumns({n: F.lit(None).cast(t.replace("MESSAGE", MESSAGE)) for n, t in names if n not in raw.columns})
    cat = T.category(F.coalesce("category", F.lit("Other")))
    plain = ("chat_name", "email_from", "email_to", "email_cc", "email_subject", "email_date", "doc_date", "doc_sender")
    return have.withColumns({
        "text": T.strip(F.coalesce("text", F.lit(""))), "detected_code": T.doc_code(F.col("doc_code")), "is_new_document": flag(F.col("is_new_document").cast("string")),
        "within_doc_page": F.col("within_doc_page").cast("string").try_cast("int"), "category": cat, "doc_subtype": T.subtype(F.coalesce("doc_subtype", F.lit("")), cat),
        "chat_messages": F.coalesce("chat_messages", F.array().cast(f"array<{MESSAGE}>")), "email_start": flag(F.col("email_start").cast("string")) & (cat == "E-mail"),
        **{c: T.blank_to_null(F.col(c)) for c in plain},
    })


def read_pages(pages: DataFrame, provider, of: str = "image") -> DataFrame:
    """Pages (dossier_id, page_num and the image or text that ``of`` names) with the record that a vision model gives of each; empty where it gives none."""
    answers = providers.ask(pages, of, provider)
    told = pages.select("dossier_id", "page_num", F.sha1(F.col(of)).alias("digest")).join(answers, "digest", "left")
    return page_records(told.withColumn("r", repair.parsed(F.coalesce("answer", F.lit("{}")), RECORD)).select("dossier_id", "page_num", "r.*"))


def summaries_of_pages(pages: DataFrame) -> DataFrame:
    """dossier_id, summary: one line a page, in order, as the boundary call takes them."""
    who, what = (F.col(c) if c in pages.columns else F.lit(None).cast("string") for c in ("email_from", "email_subject"))
    line = T.page_summary(F.col("page_num"), F.col("detected_code"), F.col("within_doc_page"), F.col("is_new_document"), T.continues(F.col("text")), F.col("category"), F.col("email_start"), who, what, F.col("text"))
    return pages.groupBy("dossier_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", line.alias("l")))), lambda x: x["l"]), "\n").alias("summary"))


def boundary_documents(pages: DataFrame, provider: providers.Provider) -> DataFrame:
    """dossier_id, pos, doc_code, start_page, email_starts as a model sees them in a dossier's page lines; a start that isn't a number is page 1."""
    lines = summaries_of_pages(pages)
    told = lines.withColumn("digest", F.sha1("summary")).join(providers.records(providers.ask(lines, "summary", provider), BOUNDARIES), "digest")
    each = told.select("dossier_id", F.posexplode("record.documents").alias("pos", "d"))
    starts = F.filter(F.transform("d.email_starts", lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    return each.select("dossier_id", "pos", T.blank_to_null(F.col("d.doc_code")).alias("doc_code"), F.coalesce(F.col("d.start_page").try_cast("int"), F.lit(1)).alias("start_page"), F.coalesce(starts, F.array().cast("array<int>")).alias("email_starts"))


def assigned(pages: DataFrame, provider: providers.Provider | None = None, threshold: float = 0.30) -> DataFrame:
    """Pages with doc_code and method: by stamps where enough pages have one, else by a model's boundaries, else by page signals."""
    routed = P.route(pages, threshold)
    if provider is None:
        return routed
    loose = routed.where("method = 'boundary'").drop("doc_code")
    bounds = boundary_documents(loose, provider)
    known = bounds.select("dossier_id").distinct()
    told = P.from_boundaries(loose.join(known, "dossier_id", "left_semi"), bounds)
    rest = S.boundary_numbers(loose.join(known, "dossier_id", "left_anti"), T.is_new_vlm(F.col("is_new_document"), F.col("within_doc_page")))
    return routed.where("method = 'stamp'").unionByName(told.select(*routed.columns)).unionByName(rest.select(*routed.columns))


def described(docs: DataFrame, messages: DataFrame | None = None, provider: providers.Provider | None = None) -> DataFrame:
    """Finished documents with ``summary``: a model's sentence about the text, or about a chat's first messages; without one, the start of either.

    messages: dossier_id, doc_code, idx, sender, timestamp, body.
    """
    keys = ["dossier_id", "doc_code"]
    if messages is not None:
        said = F.concat_ws(": ", T.blank_to_null(F.concat_ws(" ", T.blank_to_null(F.col("timestamp")), T.blank_to_null(F.col("sender")))), T.collapsed(F.col("body")))
        first = messages.where(T.strip(F.coalesce("body", F.lit(""))) != "").groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct("idx", said.alias("said"), "body"))), 1, CHAT_MESSAGES).alias("_m"))
        docs = docs.join(first, keys, "left")
    else:
        docs = docs.withColumn("_m", F.lit(None).cast("array<struct<idx:bigint,said:string,body:string>>"))
    chat = T.is_chat_category(F.col("category"))
    bodies = F.coalesce(F.transform("_m", lambda m: m["body"]), F.array().cast("array<string>"))
    asked = F.when(chat, T.blank_to_null(F.array_join(F.transform("_m", lambda m: m["said"]), "\n"))).otherwise(T.blank_to_null(F.col("text")))
    fallback = F.when(chat, T.chat_summary(bodies, F.col("text"))).otherwise(T.summary(F.col("text"), T.type_label(F.col("category"), F.col("doc_subtype"))))
    out = providers.with_answers(docs.withColumn("_asked", asked), "_asked", "summary", F.lit(None).cast("string") if provider else fallback, provider)
    one = T.blank_to_null(T.collapsed(F.col("summary")))
    return out.withColumn("summary", F.coalesce(F.when(one.endswith("."), one).otherwise(F.concat(one, F.lit("."))), fallback)).drop("_asked", "_m")
