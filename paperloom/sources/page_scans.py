"""Scans of files whose pages only a reader outside Spark can open: PDF text layers, rendered pages, OCR and vision models.

The reader is the caller's: a function from a file's bytes to its pages. It runs on the executors, one file at a
time, and what it yields goes on in batches, so a file's pages are never held together here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import repair
from ..functions import text as T
from ..plans import dossier as P

#: What a reader yields for each page, besides its number: any of these, by name.
FIELDS = {"text": "string", "image": "binary", "detected_code": "string", "within_doc_page": "int", "answer": "string"}
Reader = Callable[[bytes], Iterator[dict]]
#: A region reader: (page image, region as x0, y0, x1, y1 of the unit page, allowed characters) -> text.
RegionReader = Callable[[bytes, tuple[float, float, float, float], str], str]
PIPELINES, PROVIDERS = ("ocr", "vlm"), ("openai", "gemini")
BATCH_PAGES = 16


def scan(spark: SparkSession, path: str, reader: Reader, first: int = 1, last: int | None = None) -> DataFrame:
    """dossier_id (the file's name), page_num (from 1) and FIELDS of the pages of all files under ``path`` (a glob).

    Pages outside ``first`` to ``last`` are skipped as they are read. A file that the reader can't open gives one row with page_num 0 and an error.
    """
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("dossier_id"), "content")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        names = ["dossier_id", "page_num", *FIELDS, "error"]
        for rows in batches:
            for name, content in zip(rows["dossier_id"], rows["content"]):
                held: list[tuple] = []
                try:
                    for n, page in enumerate(reader(content), 1):
                        if n < first:
                            continue
                        if last is not None and n > last:
                            break
                        held.append((name, n, *[page.get(f) for f in FIELDS], None))
                        if len(held) == BATCH_PAGES:
                            yield pd.DataFrame(held, columns=names)
                            held = []
                except Exception as e:  # a reader may fail in any way
                    held.append((name, 0, *[None] * len(FIELDS), f"{type(e).__name__}: {e}"))
                if held:
                    yield pd.DataFrame(held, columns=names)

    schema = "dossier_id string, page_num long, " + ", ".join(f"{k} {t}" for k, t in FIELDS.items()) + ", error string"
    return files.mapInPandas(run, schema)


def region_texts(pages: DataFrame, regions: dict[str, tuple[float, float, float, float]], reader: RegionReader, allowed: str = "0123456789") -> DataFrame:
    """dossier_id, page_num, region, text: what a reader sees in each region of a page's image (columns dossier_id, page_num, image)."""
    named = list(regions.items())

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for rows in batches:
            out = [(d, n, r, reader(i, box, allowed)) for d, n, i in zip(rows["dossier_id"], rows["page_num"], rows["image"]) if i is not None for r, box in named]
            yield pd.DataFrame(out, columns=["dossier_id", "page_num", "region", "text"])

    return pages.select("dossier_id", "page_num", "image").mapInPandas(run, f"dossier_id {dict(pages.dtypes)['dossier_id']}, page_num long, region string, text string")


def recovered(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages with the stamps that a second reading found (dossier_id, page_num, code) where the first found none.

    Only in dossiers with two different stamps or more: a single one may be a misreading that would spread.
    """
    code = T.blank_to_null(F.col("detected_code"))
    sure = pages.where(code.isNotNull()).groupBy("dossier_id").agg((F.count_distinct("detected_code") >= 2).alias("_sure"))
    both = pages.join(sure, "dossier_id", "left").join(found.select("dossier_id", "page_num", F.col("code").alias("_code")), ["dossier_id", "page_num"], "left")
    new = F.coalesce(code, F.when(F.coalesce("_sure", F.lit(False)), T.blank_to_null(F.col("_code"))), F.col("detected_code"))
    return both.withColumn("detected_code", new).select(*pages.columns)


ITEM = "code:string,title:string,date:string,pages:int,decision:string,grounds:array<string>"


def inventory_items(pages: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """dossier_id, idx and the fields of ITEM of an inventory's pages: rows of a model's answer where there is one, else the lines of the text.

    Of rows with one code the first in page order stays; rows without a code all stay.
    """
    some = pages.where((F.col("page_num") >= first) & (F.lit(True) if last is None else F.col("page_num") <= last))
    items = repair.parsed(F.col("answer"), f"items array<struct<{ITEM}>>")["items"]
    told = some.where("answer is not null").select("dossier_id", "page_num", F.posexplode(items).alias("k", "r")).select("dossier_id", "page_num", "k", "r.*")
    lines = some.where("answer is null").select("dossier_id", "page_num", F.posexplode(T.lines(F.coalesce("text", F.lit("")))).alias("k", "line")).withColumn("r", T.inventory_row(F.col("line"))).where("r is not null")
    none = lambda t: F.lit(None).cast(t)
    read = lines.select("dossier_id", "page_num", "k", F.col("r.number").alias("code"), F.col("r.title").alias("title"), none("string").alias("date"), none("int").alias("pages"), none("string").alias("decision"), none("array<string>").alias("grounds"))
    rows = told.unionByName(read).withColumn("idx", F.col("page_num") * 100_000 + F.col("k")).drop("page_num", "k")
    code = T.blank_to_null(F.col("code"))
    firsts = rows.where(code.isNotNull()).groupBy("dossier_id", "code").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("dossier_id", "code")]), "idx").alias("r")).select("dossier_id", "code", "r.*")
    return firsts.select(*rows.columns).unionByName(rows.where(code.isNull()))


def inventory_lines(items: DataFrame) -> DataFrame:
    """The rows of ``inventory_items`` as the hint's inventory takes them: dossier_id, number, title."""
    return P.inventory(items.select("dossier_id", "idx", F.concat_ws(" ", "code", "title").alias("line")))


def checked_request(pipeline: str, provider: str = "openai", first: int | None = None, last: int | None = None) -> tuple[str, str, int, int | None]:
    """A run's request in its normal form, or ValueError: a known pipeline and provider, and pages in order from 1."""
    pipeline, provider = (pipeline or "").strip().lower(), (provider or PROVIDERS[0]).strip().lower()
    if pipeline not in PIPELINES:
        raise ValueError(f"pipeline must be one of {', '.join(PIPELINES)}")
    if provider not in PROVIDERS:
        raise ValueError(f"provider must be one of {', '.join(PROVIDERS)}")
    first = 1 if first is None else max(1, first)
    if last is not None and last < first:
        raise ValueError("the range starts after its end")
    return pipeline, provider, first, last
