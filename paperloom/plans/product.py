"""The product of a run: finished documents, their e-mails and chats, segments, and one JSON document a dossier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import providers
from ..functions import text as T
from ..operators import emails as E
from ..operators import match as M
from ..operators import sequence as S
from . import dossier as P

KEYS = ["dossier_id", "doc_code"]
MAIL = ["id", "subject", "sender", "to", "cc", "date", "time", "attachments", "text", "pdf_page"]


def _in_page_order(value: Column) -> Column:
    """All of a group's values by page, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct("page_num", value.alias("v")))), lambda x: x["v"])


def _first(value: Column, wanted: Column) -> Column:
    return F.min_by(value, F.when(wanted, F.col("page_num")))


def finalised(pages: DataFrame, method: str = "", started: bool = False) -> DataFrame:
    """Documents of assigned pages (dossier_id, page_num, doc_code, text, category and, where known, doc_subtype, doc_date, doc_sender, chat_name).

    The first category but Other wins, the first subtype but other, or the category's; the first date and sender; the most frequent chat name.
    started adds ``given``: an array of the e-mails that a document's e-mail pages start (LETTER).
    """
    have = {"doc_subtype": "string", "doc_sender": "string", "chat_name": "string", "doc_date": "string"}
    p = pages.withColumns({c: F.lit(None).cast(t) for c, t in have.items() if c not in pages.columns})
    names = p.where(T.blank_to_null(F.col("chat_name")).isNotNull()).groupBy(*KEYS, "chat_name").agg(F.count(F.lit(1)).alias("n"), F.min("page_num").alias("f"))
    names = names.groupBy(*KEYS).agg(F.max_by("chat_name", F.struct("n", -F.col("f"))).alias("chat_name"))
    page = [F.col("page_num"), F.coalesce("text", F.lit("")).alias("text")]
    if started:
        fields = [F.col(c).alias(f) for f, c in PAGE_FIELDS.items() if c in pages.columns]
        page += [F.coalesce(F.col("category") == "E-mail", F.lit(False)).alias("mail"), F.coalesce("email_start", F.lit(False)).alias("start"), *fields]
    docs = p.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct(*page))).alias("_p"),
        F.coalesce(_first(F.col("category"), F.col("category") != "Other"), F.lit("Other")).alias("category"),
        _first(F.col("doc_subtype"), T.blank_to_null(F.col("doc_subtype")).isNotNull() & (F.col("doc_subtype") != "other")).alias("_subtype"),
        _first(F.col("doc_date"), T.blank_to_null(F.col("doc_date")).isNotNull()).alias("doc_date"), _first(F.col("doc_sender"), T.blank_to_null(F.col("doc_sender")).isNotNull()).alias("doc_sender"),
    )
    told = [f for f, c in PAGE_FIELDS.items() if c in pages.columns]
    given = [F.when(F.col("category") == "E-mail", _started(F.col("_p"), F.col("doc_code"), told)).alias("given")] if started else []
    subtype = T.subtype(F.coalesce("_subtype", F.lit("")), F.col("category")).alias("doc_subtype")
    docs = docs.select(*KEYS, F.col("_p.page_num").alias("pages"), "category", "doc_date", "doc_sender", F.array_join("_p.text", "\n\n").alias("text"), subtype, *given)
    docs = docs.withColumn("codes", T.redaction_codes_vlm(F.col("text"))).withColumn("redactions", T.counted(F.col("codes"))).withColumn("annotated_text", T.annotate_vlm(F.col("text")))
    return docs.join(names, KEYS, "left").withColumn("method", F.lit(method))


#: What a page tells of the e-mail that it starts, and its columns.
PAGE_FIELDS = {"subject": "email_subject", "sender": "email_from", "to": "email_to", "cc": "email_cc", "date": "email_date"}
#: An e-mail of a document: its number and MAIL.
LETTER = "struct<n:int,id:string,subject:string,sender:string,to:string,cc:string,date:string,time:string,attachments:array<string>,text:string,pdf_page:bigint>"


def _started(pages: Column, code: Column, fields: list[str]) -> Column:
    """The e-mails of a document's pages in order (page_num, text, mail, start and fields), as LETTERs: an e-mail page that starts one, or is the first, opens it; the others append their text."""
    none = F.lit(None).cast("string")

    def letters(p: Column) -> Column:
        at = F.filter(F.transform(p, lambda x, i: F.when(x["start"] | (i == 0), i)), lambda i: i.isNotNull())

        def made(q: Column, n: Column) -> Column:
            known = {f: q[0][f] for f in fields} | {"n": n, "id": F.concat(code, F.lit("."), n.cast("string")), "text": F.array_join(q["text"], "\n\n"), "pdf_page": q[0]["page_num"], "attachments": F.array().cast("array<string>")}
            return F.struct(*[known.get(f, none).alias(f) for f in ("n", *MAIL)])

        return T.once(at, lambda a: F.transform(a, lambda i, k: T.once(F.slice(p, i + 1, F.coalesce(F.try_element_at(a, k + 2), F.size(p)) - i), lambda q: made(q, k + 1))))

    return T.once(F.filter(pages, lambda x: x["mail"]), letters).cast(f"array<{LETTER}>")


def page_mails(pages: DataFrame) -> DataFrame:
    """E-mails that pages start, for all documents: KEYS, n and MAIL."""
    return finalised(pages.withColumn("category", F.lit("E-mail")), started=True).select(*KEYS, F.inline("given"))


#: Characters of a document that a model sees, and the shape of its answer.
PROMPT_CHARS = 24_000
ANSWER = "emails array<struct<subject:string,sender:string,to:string,cc:string,date:string,time:string,attachments:array<string>,body:string>>"


def structured_mails(docs: DataFrame, given: DataFrame, provider: providers.Provider) -> DataFrame:
    """E-mails of the e-mail documents as a model tells them (asked once for each different text), in the columns of ``given``.

    A document whose answer is missing, can't be read or names no e-mail has the given ones (page e-mails: KEYS, n and
    MAIL). A told e-mail gets its page from the given ones by subject, sender and day.
    """
    own = docs.where(F.col("category") == "E-mail").select(*KEYS, F.left("annotated_text", F.lit(PROMPT_CHARS)).alias("_t")).withColumn("digest", F.sha1("_t"))
    told = providers.records(providers.ask(own, "_t", provider), ANSWER).select("digest", F.col("record.emails").alias("_m"))
    each = own.join(told, "digest").select(*KEYS, F.posexplode("_m").alias("_n", "_e")).withColumn("n", F.col("_n") + 1)
    blank = lambda c: T.blank_to_null(F.col(f"_e.{c}")).alias(c)
    files = F.coalesce("_e.attachments", F.array().cast("array<string>")).alias("attachments")
    rows = each.select(*KEYS, "n", F.concat("doc_code", F.lit("."), F.col("n").cast("string")).alias("id"), *map(blank, ("subject", "sender", "to", "cc", "date", "time")), files, F.coalesce("_e.body", F.lit("")).alias("text"))
    at = M.match_pages(rows.select(*KEYS, F.col("n").cast("int").alias("n"), "subject", "sender", "date"), given.select(*KEYS, "pdf_page", "subject", "sender", "date"), KEYS)
    rows = rows.join(at, [*KEYS, "n"], "left").select(*KEYS, "n", *MAIL)
    rest = given.join(own.select(*KEYS), KEYS, "left_semi").join(rows.select(*KEYS).distinct(), KEYS, "left_anti")
    return rows.unionByName(rest.select(*KEYS, F.col("n").cast("int").alias("n"), *MAIL))


def _with_given(docs: DataFrame, given: DataFrame) -> DataFrame:
    """docs with the given e-mails (KEYS, n and MAIL) of each as ``given``."""
    one = F.struct(F.col("n").cast("int").alias("n"), *MAIL).cast(LETTER)
    return docs.drop("given").join(given.groupBy(*KEYS).agg(F.array_sort(F.collect_list(one)).alias("given")), KEYS, "left")


def _lettered(docs: DataFrame) -> DataFrame:
    """Finished documents with ``given`` (an array of LETTERs): mails, an array of LETTERs of the e-mail documents, and mail_dates, those of their texts.

    All in the document's own row: a text is split once, and a text's e-mails are only read where they are more than the given ones.
    """
    own = F.col("category") == "E-mail"
    lines, cuts, blocks = F.col("_lines"), F.col("_cuts"), F.col("_blocks")
    d = docs.withColumn("given", F.coalesce("given", F.array().cast(f"array<{LETTER}>"))).withColumn("_lines", F.when(own, T.lines(T.redacted_addresses(F.col("annotated_text")))))
    d = d.withColumn("_cuts", F.when(own, E.split_points(lines))).withColumn("_blocks", F.when(own, E.blocks(lines, cuts)))
    by_text = own & ((E.count(lines, cuts, blocks) > F.size("given")) | (F.size("given") == 0))
    d = d.withColumn("_t", F.when(by_text, E.listed(lines, cuts, blocks)))
    # the dates come from the text without marks; mostly the marks make no difference
    days = F.when(F.size(F.col("codes")) == 0, False).otherwise(E.apart(lines))
    read = F.filter(F.col("_t.date"), lambda x: T.blank_to_null(x).isNotNull())
    d = d.withColumn("mail_dates", F.when(own, F.when(days, E.mail_dates(F.col("text"))).when(F.col("_t").isNotNull(), read).otherwise(E.block_dates(blocks))))
    known = F.map_from_entries(F.transform("given", lambda m: F.struct(m["n"].alias("k"), m.alias("v"))))
    fuller = lambda m, of, f: F.coalesce(T.blank_to_null(m[f]), of[f], m[f])

    def enriched(by: Column) -> Column:
        filled = ("subject", "sender", "date", "time")
        one = lambda m, of, n: F.struct(n.alias("n"), F.concat("doc_code", F.lit("."), n.cast("string")).alias("id"), *[(fuller(m, of, f) if f in filled else m[f]).alias(f) for f in MAIL[1:-1]], F.lit(None).cast("long").alias("pdf_page"))
        return F.transform("_t", lambda m, i: T.once(F.try_element_at(by, i + 1), lambda of: one(m, of, i + 1)))

    chosen = F.when(F.col("_t").isNull(), F.col("given")).otherwise(T.once(known, enriched))

    def finished(m: Column) -> Column:
        empty = lambda f: F.coalesce(m[f], F.lit(""))

        def timed(x: Column) -> Column:
            at = T.once(x["day"], D.split_moment)
            return F.when(x["clock"] != "", F.struct(x["day"].alias("day"), x["clock"].alias("time"))).otherwise(T.once(at, lambda t: F.struct(F.coalesce(t["day"], F.lit("")).alias("day"), F.coalesce(t["time"], F.lit("")).alias("time"))))

        moment = T.once(F.struct(T.strip(empty("date")).alias("day"), T.strip(empty("time")).alias("clock")), timed)
        plain = {f: empty(f) for f in ("subject", "sender", "to", "cc", "text")}
        return T.once(moment, lambda at: F.struct(*[(plain[f] if f in plain else at[{"date": "day"}.get(f, f)] if f in ("date", "time") else m[f]).alias(f) for f in ("n", *MAIL)]))

    kept = F.filter(F.transform(chosen, finished), lambda m: ~T.is_http_error(T.strip(m["text"])))
    return d.withColumn("mails", F.when(own, kept)).drop("_lines", "_cuts", "_blocks", "_t", "given")


def mails(docs: DataFrame, given: DataFrame) -> DataFrame:
    """dossier_id, doc_code, n and MAIL of the e-mail documents: the given list (page or structured e-mails) or the split text, whichever is longer.

    A split text takes what it lacks from the given e-mail of its place. E-mails that are nothing but a server's error are left out.
    """
    return _lettered(_with_given(docs.where(F.col("category") == "E-mail"), given)).select(*KEYS, F.inline("mails"))


MESSAGE = "struct<sender:string,timestamp:string,body:string,isRedacted:boolean,isSystemMessage:boolean>"
CHAT = ["threadId", "deelnemers", "laatsteBericht", "berichten", "chatName", "sourceDocId"]


def _message(sender: Column, timestamp: Column, body: Column) -> Column:
    redacted, system = T.chat_flags(body)
    return F.struct(sender.alias("sender"), timestamp.alias("timestamp"), body.alias("body"), redacted.alias("isRedacted"), system.alias("isSystemMessage")).cast(MESSAGE)


def _said(text: Column) -> Column:
    """The chat messages among a text's lines, in order."""
    # what any chat line has; plain searches end it for most others
    has = lambda x, c: F.contains(x, F.lit(c))
    maybe = F.filter(T.lines(text), lambda x: has(x, ":") & ((has(x, "[") & has(x, "]")) | (has(x, "(") & has(x, ")"))))
    found = F.filter(F.transform(maybe, lambda x: T.chat_line(T.strip(x))), lambda c: c.isNotNull())
    told = F.transform(found, lambda c: F.struct(c["sender"].alias("sender"), c["stamp"].alias("timestamp"), T.chat_body(c["body"]).alias("body")))
    return F.transform(F.filter(told, lambda c: (c["sender"] != "") & (c["body"] != "")), lambda c: _message(c["sender"], c["timestamp"], c["body"]))


def _people(messages: Column) -> Column:
    """The senders in order, in their first spelling."""
    named = F.filter(F.transform(messages, lambda m, i: F.struct(F.lower(T.strip(m["sender"])).alias("k"), i.alias("i"), m["sender"].alias("s"))), lambda x: x["k"] != "")
    first = lambda a: F.filter(a, lambda x, i: F.coalesce(F.try_element_at(a, F.when(i > 0, i))["k"] != x["k"], F.lit(True)))
    return F.transform(F.array_sort(F.transform(T.once(F.array_sort(named), first), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"])


def _chatted(docs: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """Finished documents with chat, a struct of CHAT, where they have chat messages or are a Chat."""
    said = _said(F.col("annotated_text"))
    if messages is not None:
        told = F.transform(F.array_sort(F.collect_list(F.struct("idx", _message(F.col("sender"), F.col("timestamp"), F.col("body")).alias("m")))), lambda x: x["m"])
        docs, said = docs.join(messages.groupBy(*KEYS).agg(told.alias("_told")), KEYS, "left"), F.coalesce("_told", said)
    d = docs.withColumn("_said", said)
    said, some = F.col("_said"), F.size("_said") > 0
    d = d.withColumn("_people", F.when(some, _people(said)).otherwise(F.array().cast("array<string>")))
    people, name = F.col("_people"), T.blank_to_null(T.strip(F.coalesce("chat_name", F.lit(""))))
    bodies = F.filter(said["body"], lambda b: T.strip(b) != "")
    latest = F.when(some, F.left(F.try_element_at(bodies, F.lit(-1)), F.lit(200)))
    made = F.struct(
        T.thread_id(F.col("doc_code"), people, F.coalesce(name, F.lit(""))).alias("threadId"), F.when(some, people).when(name.isNotNull(), F.array(name)).otherwise(people).alias("deelnemers"),
        F.coalesce(latest, F.lit("")).alias("laatsteBericht"), said.alias("berichten"), F.coalesce(name, T.blank_to_null(F.array_join(F.slice(people, 1, 3), ", ")), F.col("doc_code")).alias("chatName"), F.col("doc_code").alias("sourceDocId"),
    )
    return d.withColumn("chat", F.when(some | (F.lower(T.strip(F.col("category"))) == "chat"), made)).drop("_said", "_people", "_told")


def chats(docs: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """dossier_id, doc_code, threadId, deelnemers, laatsteBericht, berichten, chatName of the documents with chat messages.

    messages (dossier_id, doc_code, idx, sender, timestamp, body): structured ones; else the text's chat lines. A Chat document without any has an empty list.
    """
    return _chatted(docs, messages).where(F.col("chat").isNotNull()).select(*KEYS, "chat.*")


def statistics(docs: DataFrame) -> DataFrame:
    """dossier_id, docs, pages and redactionCodes (code to count) of finished documents."""
    n = docs.groupBy("dossier_id").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("pages")).alias("pages"))
    codes = P.redaction_totals(docs).groupBy("dossier_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("redactionCodes"))
    return n.join(codes, "dossier_id", "left").withColumn("redactionCodes", F.coalesce("redactionCodes", F.create_map().cast("map<string,bigint>")))


def _tallied(items: Column) -> Column:
    """item -> how often it occurs, in the order of the items: lengths of runs in the sorted array."""
    starts = lambda a: F.filter(F.transform(a, lambda x, i: F.when(F.coalesce(F.try_element_at(a, F.when(i > 0, i)) != x, F.lit(True)), i)), lambda i: i.isNotNull())
    runs = lambda a, at: F.transform(at, lambda i, k: F.struct(F.try_element_at(a, i + 1), (F.coalesce(F.try_element_at(at, k + 2), F.size(a)) - i).cast("long")))
    return T.once(F.array_sort(items), lambda a: T.once(starts(a), lambda at: F.map_from_entries(runs(a, at))))


def dossier_json(docs: DataFrame, given: DataFrame | None = None, messages: DataFrame | None = None) -> DataFrame:
    """dossier_id, json: e-mails, chats, timeline and stats of each dossier as one document, in chronological order.

    docs: finalised. given (KEYS, n and MAIL): page or structured e-mails; else those that documents finalised with ``started`` have.
    """
    # all that a document has is made in its own row; then one aggregate makes the dossier's
    d = _chatted(_lettered(docs if given is None else _with_given(docs, given)), messages)
    d = P.dated(d, F.col("mail_dates")).where(F.col("dossier_id").isNotNull())
    rows = d.select("dossier_id", F.col("date").alias("_date"), "pages", "codes", "mails", "chat", *P.cards(), "doc_subtype", "doc_sender")
    entry = F.struct(
        F.col("doc_code").alias("id"), T.type_label(F.col("category"), F.col("doc_subtype")).alias("type"), F.col("category").alias("raw_type"), "doc_subtype", F.coalesce("date", F.lit("")).alias("date"),
        F.when(T.is_chat_category(F.col("category")), D.chat_title_date(F.coalesce("date", F.lit("")))).otherwise(F.col("title")).alias("title"),
        "description", F.coalesce("doc_sender", "sender").alias("sender"), "preview", F.col("page_start").alias("pdf_page_start"), F.col("page_end").alias("pdf_page_end"),
    )
    letters = F.transform("mails", lambda m: F.struct(*[m[f].alias(f) for f in MAIL]))
    place = F.struct(F.col("_date").isNull().alias("undated"), F.col("_date").alias("date"), F.col("doc_code").alias("code"))
    one = F.struct(place.alias("place"), entry.alias("entry"), letters.alias("mails"), F.col("chat"), F.size("pages").alias("pages"), F.col("codes"))
    all_ = rows.groupBy("dossier_id").agg(F.collect_list(one).alias("_d"), F.count(F.lit(1)).alias("docs"), F.sum(F.size("pages")).alias("pages")).withColumn("_d", F.array_sort("_d"))
    present = lambda c: F.filter(F.col(f"_d.{c}"), lambda x: x.isNotNull())
    stats = F.struct("docs", "pages", _tallied(F.flatten("_d.codes")).alias("redactionCodes"))
    body = F.struct(F.flatten(present("mails")).alias("emails"), present("chat").alias("chats"), F.col("_d.entry").alias("timeline"), stats.alias("stats"))
    return all_.select("dossier_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def cache_segments(pages: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """Segments of cached pages for annotation: dossier_id, i, doc_code, start_page, end_page (0-based), type, method, date_iso, date_raw, num_emails_pipeline, emails_pipeline.

    Contiguous runs of a stamp; a new page without one opens unknown_n. A segment has the category of its first page; its
    e-mails are the given ones (dossier_id, doc_code, n, subject, sender, date) or those that its pages start, or the
    split text where that has more; its date is that of the document of its code.
    """
    p = S.segments_of_runs(pages).withColumn("_det", T.blank_to_null(F.col("detected_code")))
    segs = p.groupBy("dossier_id", "seg").agg(
        F.min_by("_det", "page_num").alias("_det"), (F.min("page_num") - 1).alias("start_page"), (F.max("page_num") - 1).alias("end_page"), F.min_by("category", "page_num").alias("type"),
        F.array_join(_in_page_order(F.coalesce("text", F.lit(""))), "\n\n").alias("text"),
    )
    w = Window.partitionBy("dossier_id").orderBy("start_page")
    unknown = F.concat(F.lit("unknown_"), F.sum(F.col("_det").isNull().cast("int")).over(w).cast("string"))
    segs = segs.withColumn("doc_code", F.coalesce("_det", unknown)).withColumn("method", F.when(F.col("_det").isNull(), "boundary").otherwise("stamp")).withColumn("i", F.row_number().over(w))
    keys = ["dossier_id", "seg"]
    letters = segs.where(F.col("type") == "E-mail")
    started = p.where(F.coalesce("email_start", F.lit(False)))
    field = lambda c: F.col(c) if c in pages.columns else F.lit(None).cast("string")
    started = started.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("page_num")).alias("n"), field("email_subject").alias("subject"), field("email_from").alias("sender"), field("email_date").alias("date"))
    if given is not None:
        known = given.join(letters.select("dossier_id", "doc_code", "seg"), KEYS).select(*started.columns)
        started = known.unionByName(started.join(known.select(*keys).distinct(), keys, "left_anti"))
    started = started.join(letters.select(*keys), keys, "left_semi").withColumn("time", F.lit(None).cast("string"))
    split = E.split(letters.where(T.strip(F.col("text")) != "").select(*keys, "doc_code", "text")).drop("doc_code")
    chosen = E.choose(split, started, keys)
    item = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("subject", "sender", "date")])
    lists = chosen.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("m")))), lambda x: x["m"]).alias("emails_pipeline"))
    days = P.dated(finalised(S.forward_fill_split(pages))).select(*KEYS, F.date_format("date", "yyyy-MM-dd").alias("_day"))
    out = segs.join(lists, keys, "left").join(days, KEYS, "left")
    day = F.coalesce("_day", F.lit(""))
    return out.select("dossier_id", "i", "doc_code", "start_page", "end_page", "type", "method", day.alias("date_iso"), day.alias("date_raw"), F.when(F.col("emails_pipeline").isNotNull(), F.size("emails_pipeline")).alias("num_emails_pipeline"), "emails_pipeline")


def document_segments(docs: DataFrame, chosen: DataFrame, method: str = "") -> DataFrame:
    """Segments of finished and dated documents, with the e-mails chosen for them (dossier_id, doc_code, n, subject, sender, date)."""
    item = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("subject", "sender", "date")])
    lists = chosen.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("m")))), lambda x: x["m"]).alias("emails_pipeline"))
    out = docs.where(F.size("pages") > 0).join(lists, KEYS, "left")
    first, last = F.array_min("pages") - 1, F.array_max("pages") - 1
    return out.select(
        "dossier_id", F.row_number().over(Window.partitionBy("dossier_id").orderBy(first, "doc_code")).alias("i"), "doc_code", first.alias("start_page"), last.alias("end_page"),
        F.col("category").alias("type"), F.coalesce("date_raw", F.lit("")).alias("date_raw"), F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("")).alias("date_iso"), F.lit(method).alias("method"),
        F.when(F.col("emails_pipeline").isNotNull(), F.size("emails_pipeline")).alias("num_emails_pipeline"), "emails_pipeline",
    )
