"""A dossier's stamp profile from pilot pages, and the hints that tell a vision model what to look for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Room for the table of a hint: entries are listed while the text with the next one stays within it.
BUDGET = 497
FORMATS = ("docnr", "none", "4-digit", "6-digit", "7-digit")


def listed(entries: Column, budget: int = BUDGET, whole: int = 500) -> Column:
    """Entries joined by two spaces after two; where that is longer than ``whole``, the first ones within ``budget`` and an ellipsis."""
    start = F.struct(F.lit(2).alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("shown"))

    def step(a: Column, e: Column) -> Column:
        over = a["full"] | (a["used"] + F.length(e) + 2 > budget)
        shown = F.when(a["full"], a["shown"]).when(over, F.array_append(a["shown"], F.lit("..."))).otherwise(F.array_append(a["shown"], e))
        return F.struct((a["used"] + F.when(over, 0).otherwise(F.length(e) + 2)).alias("used"), over.alias("full"), shown.alias("shown"))

    said = lambda x: F.concat(F.lit("  "), F.array_join(x, "  "))
    return F.when(F.length(said(entries)) <= whole, said(entries)).otherwise(said(F.aggregate(entries, start, step)["shown"]))


def profile(pilot: DataFrame) -> DataFrame:
    """dossier_id, stamp_format, stamp_example, n_distinct, n_pages from the raw codes of pilot pages (dossier_id, page_num, raw_code).

    A label like "Docnr 5" decides for docnr. Else codes that hold after normalisation decide: four digits if any raw
    code has four, else six up to a dominant length of six, else seven. The example is the first label, or the most
    frequent code that occurs twice, or the first one (ties: the first seen).
    """
    raw = F.coalesce("raw_code", F.lit(""))
    rows = pilot.select("dossier_id", "page_num", raw.alias("raw"), T.doc_code(F.col("raw_code")).alias("code"), F.length(F.regexp_replace(raw, r"\D", "")).alias("digits"), T.has_docnr_label(raw).alias("label"))
    codes = rows.where("code is not null").groupBy("dossier_id", "code").agg(F.count(F.lit(1)).alias("n"), F.min("page_num").alias("f"))
    best = codes.groupBy("dossier_id").agg(
        F.max_by("code", F.when(F.col("n") >= 2, F.struct("n", -F.col("f")))).alias("repeated"), F.min_by("code", "f").alias("first"), F.count(F.lit(1)).alias("n_distinct"),
    )
    lengths = rows.where("raw <> ''").groupBy("dossier_id", "digits").agg(F.count(F.lit(1)).alias("n"), F.min("page_num").alias("f"))
    lengths = lengths.groupBy("dossier_id").agg(F.max_by("digits", F.struct("n", -F.col("f"))).alias("dominant"), F.bool_or(F.col("digits") == 4).alias("four"))
    labels = rows.groupBy("dossier_id").agg(F.min_by("raw", F.when(F.col("label"), F.col("page_num"))).alias("label"), F.count(F.lit(1)).alias("n_pages"))
    x = labels.join(best, "dossier_id", "left").join(lengths, "dossier_id", "left")
    form = F.when(F.col("label").isNotNull(), "docnr").when(F.col("n_distinct").isNull(), "none").when(F.col("four"), "4-digit").when(F.col("dominant") <= 6, "6-digit").otherwise("7-digit")
    example = F.coalesce("label", "repeated", "first")
    return x.select("dossier_id", form.alias("stamp_format"), example.alias("stamp_example"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "n_pages")


def profile_hint(stamp_format: Column, example: Column) -> Column:
    """What a vision model should take for a document code; empty for a format that isn't known."""
    seen = F.when(T.blank_to_null(example).isNotNull(), F.concat(F.lit(' (seen: "'), example, F.lit('")'))).otherwise("")
    of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return (
        F.when(stamp_format == "none", "This dossier has no stamps: doc_code is null on all pages, and only content tells where a document begins.")
        .when(stamp_format == "docnr", of("Documents carry a label like Docnr 5 in a corner of their first page", seen, ". Other pages have doc_code null; other numbers are no codes."))
        .when(stamp_format == "4-digit", of("Codes are stamps of four digits with a leading zero", seen, ", alike on all pages of a document. A number that grows by one each page is a page counter."))
        .when(stamp_format == "6-digit", of("Codes are stamps of six digits", seen, ", alike on all pages of a document."))
        .when(stamp_format == "7-digit", of("Codes are stamps of seven digits", seen, ", alike on all pages of a document; report them whole."))
        .otherwise("")
    )


def survey_hint(pages: DataFrame, survey: DataFrame, jumps: DataFrame, labels: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """dossier_id, hint: what the free scan of stamps found, for a vision model's prompt.

    pages: dossier_id, page_num, detected_code; survey: as ``dossier.survey`` with coverage and distinct_codes; jumps: as
    ``sequence.large_jumps`` (the first 15 are told); labels: dossier_id, has_labels; regions: dossier_id, region.
    """
    entry = F.struct("page_num", F.concat(F.col("page_num").cast("string"), F.lit(":"), F.col("detected_code")).alias("e"))
    codes = pages.where(T.blank_to_null(F.col("detected_code")).isNotNull()).groupBy("dossier_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("entries"))
    told = F.concat_ws("", F.lit("page "), F.col("page").cast("string"), F.lit(": "), "from_code", F.lit(" to "), "to_code", F.lit(" (gap "), F.col("gap").cast("string"), F.lit(")"))
    skips = jumps.groupBy("dossier_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("page", told.alias("t")))), lambda x: x["t"]), 1, 15).alias("jumps"))
    x = survey.join(codes, "dossier_id", "left").join(skips, "dossier_id", "left")
    x = x.join(labels, "dossier_id", "left") if labels is not None else x.withColumn("has_labels", F.lit(False))
    x = x.join(regions, "dossier_id", "left") if regions is not None else x.withColumn("region", F.lit(None).cast("string"))
    share = F.concat(F.bround(F.col("coverage") * 100).cast("int").cast("string"), F.lit(" %"))
    where = F.when(F.col("region").isNotNull(), F.concat(F.lit(" Stamps are in one place: "), F.col("region"), F.lit("."))).otherwise("")
    skipped = F.when(F.size("jumps") > 0, F.concat(F.lit(" Jumps, likely between documents: "), F.array_join("jumps", "; "), F.lit("."))).otherwise("")
    stamped = F.concat(F.lit("Stamps on "), share, F.lit(" of the pages, "), F.col("distinct_codes").cast("string"), F.lit(" codes from "), "lo", F.lit(" to "), "hi", F.lit(". Pages and codes:"), listed(F.col("entries")), F.lit("."), skipped, where)
    hint = (
        F.when(F.col("has_stamps"), stamped)
        .when(F.coalesce("has_labels", F.lit(False)), "Labels like Docnr 5 stand on some pages: they begin documents and have no leading zero.")
        .when(F.col("page_counter"), F.concat(F.lit("A number grows by one each page: a page counter, no document code."), where))
        .when(F.col("coverage") <= 0.05, "No stamps were found: doc_code is null unless one is plain to see.")
        .otherwise(F.concat(F.lit("Stamps are sparse or inconsistent ("), share, F.lit(" of the pages): look in all corners.")))
    )
    return x.select("dossier_id", hint.alias("hint"))
