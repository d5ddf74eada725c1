"""Readers and writers of dossier files: page caches, segments, annotations, ground truth. Schemas are declared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

MESSAGE = "struct<sender_position:string,sender_label:string,timestamp:string,is_system_message:boolean,content:string>"
PAGE = (
    f"page_num:long,text:string,doc_code:string,is_new_document:boolean,within_doc_page:int,category:string,doc_subtype:string,chat_name:string,chat_messages:array<{MESSAGE}>,"
    "email_start:boolean,email_from:string,email_to:string,email_cc:string,email_subject:string,email_date:string,doc_date:string,doc_sender:string"
)
EMAIL = "struct<id:string,subject:string,sender:string,to:string,cc:string,date:string,time:string,attachments:array<string>,text:string,pdf_page:long>"
BOUNDARY = "struct<doc_code:string,start_page:int,email_starts:array<int>>"
CACHE = f"dpi int, pages array<struct<{PAGE}>>, dossier_profile struct<stamp_format:string,stamp_example:string,notes:string>, boundary_documents array<{BOUNDARY}>, emails_by_doc map<string,array<{EMAIL}>>"
SEGMENT = "struct<doc_code:string,start_page:long,end_page:long,type:string,date_raw:string,date_iso:string,method:string,num_emails:int,num_emails_pipeline:int>"
TRUE_DOCUMENT = "struct<start_page:long,type_gt:string,date_gt:string,num_emails_gt:int,notes:string>"
ANNOTATION = "struct<type_gt:string,date_gt:string,num_emails_gt:int,notes:string>"


def _files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON file, keyed by the file's name; a file that doesn't parse gives nulls."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    # a partitioned folder names the dossier itself
    own = [c for c in rows.columns if c != "dossier_id"]
    named = F.col("dossier_id").cast("string") if "dossier_id" in rows.columns else F.regexp_extract(F.col("_metadata.file_name"), r"([^/_]+)\.json$", 1)
    return rows.select(named.alias("dossier_id"), *own)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return _files(spark, path, CACHE)


def cache_pages(cache: DataFrame) -> DataFrame:
    """Pages of caches, with category and subtype normalised and absent flags false."""
    each = cache.select("dossier_id", F.explode("pages").alias("p")).select("dossier_id", "p.*")
    cat = T.category(F.coalesce("category", F.lit("Other")))
    return each.withColumns({"category": cat, "doc_subtype": T.subtype(F.col("doc_subtype"), cat), "is_new_document": F.coalesce("is_new_document", F.lit(False)), "email_start": F.coalesce("email_start", F.lit(False)) & (cat == "E-mail")})


def cache_boundaries(cache: DataFrame) -> DataFrame:
    return cache.select("dossier_id", F.posexplode("boundary_documents").alias("pos", "b")).select("dossier_id", "pos", "b.*")


def cache_emails(cache: DataFrame) -> DataFrame:
    by = cache.select("dossier_id", F.explode("emails_by_doc").alias("doc_code", "mails"))
    return by.select("dossier_id", "doc_code", F.posexplode("mails").alias("n", "m")).select("dossier_id", "doc_code", (F.col("n") + 1).alias("n"), "m.*")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of files that hold either {"segments": [...]} or a bare list."""
    read = spark.read.text(path, wholetext=True)
    named = F.col("dossier_id").cast("string") if "dossier_id" in read.columns else F.regexp_extract(F.col("_metadata.file_name"), r"([^/_]+)\.json$", 1)
    text = read.select(named.alias("dossier_id"), "value")
    wrapped = F.from_json("value", f"segments array<{SEGMENT}>")["segments"]
    bare = F.from_json("value", f"array<{SEGMENT}>")
    return text.select("dossier_id", F.posexplode(F.when(F.ltrim("value").startswith("["), bare).otherwise(wrapped)).alias("i", "s")).select("dossier_id", "i", "s.*")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """dossier_id, start_page, type_gt, date_gt, num_emails_gt, notes from either shape of ground truth."""
    shape = f"documents array<{TRUE_DOCUMENT}>, boundaries array<long>, annotations map<string,{ANNOTATION}>"
    files = _files(spark, path, shape)
    rich = files.where("documents is not null").select("dossier_id", F.explode("documents").alias("d")).select("dossier_id", "d.*")
    simple = files.where("documents is null").select("dossier_id", F.explode("boundaries").alias("start_page"), "annotations")
    simple = simple.withColumn("a", F.try_element_at("annotations", F.col("start_page").cast("string"))).select("dossier_id", "start_page", "a.*")
    return rich.unionByName(simple)


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """dossier_id, page0: annotated boundaries, page 0 always among them, each once."""
    files = _files(spark, path, "boundaries array<long>")
    return files.select("dossier_id", F.explode(F.array_union(F.array(F.lit(0).cast("long")), F.coalesce("boundaries", F.array().cast("array<bigint>")))).alias("page0")).distinct()


def complete_dossiers(truth: DataFrame, segments: DataFrame, cache: DataFrame) -> DataFrame:
    """The dossiers that have all three files."""
    ids = lambda d: d.select("dossier_id").distinct()
    return ids(truth).join(ids(segments), "dossier_id", "left_semi").join(ids(cache), "dossier_id", "left_semi")


def page_range(pages: DataFrame, first: int, last: int) -> DataFrame:
    """The pages of a range, its end clamped to what is there; the filter reaches the scan."""
    if first > last:
        raise ValueError("the range starts after its end")
    return pages.where(F.col("page_num").between(max(1, first), last))


def concatenated(parts: DataFrame, order: str = "part") -> DataFrame:
    """Pages of several files as one dossier: page numbers run on from part to part."""
    sizes = parts.groupBy("dossier_id", order).agg(F.max("page_num").alias("n"))
    before = Window.partitionBy("dossier_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("dossier_id", order, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return parts.join(offsets, ["dossier_id", order]).withColumn("page_num", F.col("page_num") + F.col("offset")).drop("offset", order)


def write_cache(pages: DataFrame, path: str) -> None:
    """Pages as JSON lines, one folder per dossier, without images or raster codes."""
    names = [x.split(":")[0] for x in PAGE.split(",") if ":" in x and "<" not in x.split(":")[0]]
    keep = [c for c in pages.columns if c in {"dossier_id", *names, "chat_messages"}]
    pages.select(*keep).write.mode("overwrite").partitionBy("dossier_id").json(path)


def write_rows(rows: DataFrame, path: str) -> None:
    """Segments, boundaries, annotations or e-mails as JSON lines; non-ASCII characters stay."""
    rows.write.mode("overwrite").json(path)


def _documents(rows: DataFrame, path: str) -> None:
    """One JSON document a dossier (columns dossier_id, json), in a folder of its own; ``read_*`` take the folders back."""
    rows.select("dossier_id", F.col("json").alias("value")).write.mode("overwrite").partitionBy("dossier_id").text(path)


def _listed(rows: DataFrame, order: str, value, to: str) -> DataFrame:
    return rows.groupBy("dossier_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value.alias("v")))), lambda x: x["v"]).alias(to))


def write_segments(segments: DataFrame, path: str, pipeline: str) -> None:
    """{"pipeline": ..., "segments": [...]} for each dossier, in the order of start pages."""
    fields = [c for c in segments.columns if c not in ("dossier_id", "i")]
    body = _listed(segments, "start_page", F.struct(*fields), "segments")
    _documents(body.select("dossier_id", F.to_json(F.struct(F.lit(pipeline).alias("pipeline"), "segments")).alias("json")), path)


def write_annotations(boundaries: DataFrame, annotations: DataFrame, path: str) -> None:
    """{"boundaries": [...], "annotations": {"<start page>": {...}}} for each dossier; page 0 is always a boundary.

    boundaries: dossier_id, page0; annotations: dossier_id, start_page and the annotation's fields.
    """
    fields = [c for c in annotations.columns if c not in ("dossier_id", "start_page")]
    zero = F.array(F.lit(0).cast("long"))
    starts = boundaries.groupBy("dossier_id").agg(F.array_sort(F.array_union(zero, F.collect_set(F.col("page0").cast("long")))).alias("boundaries"))
    notes = annotations.groupBy("dossier_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("start_page").cast("string").alias("k"), F.struct(*fields).alias("v"))))).alias("annotations"))
    both = starts.join(notes, "dossier_id", "left")
    _documents(both.select("dossier_id", F.to_json(F.struct("boundaries", "annotations")).alias("json")), path)


def updated_cache(cache: DataFrame, boundaries: DataFrame | None = None, emails: DataFrame | None = None) -> DataFrame:
    """Caches (as from ``read_cache``) with their boundary documents or e-mails replaced where there are new ones; the pages stay.

    boundaries: dossier_id, pos, doc_code, start_page, email_starts; emails: dossier_id, doc_code, n and the fields of EMAIL.
    """
    out = cache
    if boundaries is not None:
        new = _listed(boundaries, "pos", F.struct("doc_code", "start_page", "email_starts"), "_new")
        out = out.join(new, "dossier_id", "left").withColumn("boundary_documents", F.coalesce(F.col("_new").cast(f"array<{BOUNDARY}>"), "boundary_documents")).drop("_new")
    if emails is not None:
        names = [x.split(":")[0] for x in EMAIL[len("struct<") : -1].replace("array<string>", "list").split(",")]
        by = emails.groupBy("dossier_id", "doc_code").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.struct(*names).alias("v")))), lambda x: x["v"]).alias("v"))
        new = by.groupBy("dossier_id").agg(F.map_from_entries(F.collect_list(F.struct("doc_code", "v"))).alias("_new"))
        out = out.join(new, "dossier_id", "left").withColumn("emails_by_doc", F.coalesce(F.col("_new").cast(f"map<string,array<{EMAIL}>>"), "emails_by_doc")).drop("_new")
    return out


def write_caches(cache: DataFrame, path: str) -> None:
    """Whole caches, one JSON document a dossier. Write to another folder than the one they were read from."""
    _documents(cache.select("dossier_id", F.to_json(F.struct(*[c for c in cache.columns if c != "dossier_id"])).alias("json")), path)
