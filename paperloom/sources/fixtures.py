"""Dossier views over the driver's star-schema tables, with the same definition in Spark and in SQL.

The expressions below are plain SQL that Spark and DuckDB read alike; the text of a page is
chosen by its order key, so every kind of document the operators know occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_DAY = "lpad(cast(day(o_orderdate) as string), 2, '0')"
_MONTH = "lpad(cast(month(o_orderdate) as string), 2, '0')"
_YEAR = "cast(year(o_orderdate) as string)"
_CLOCK = "lpad(cast(o_orderkey % 24 as string), 2, '0') || ':' || lpad(cast(o_orderkey % 60 as string), 2, '0')"
_NL = "chr(10)"
_MONTHS = ["januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september", "oktober", "november", "december"]
_MONTH_NL = "CASE month(o_orderdate) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MONTHS, 1)) + " END"
_CODES = "'grond 5.1.' || cast(1 + o_orderkey % 9 as string) || 'el en 5.2.' || cast(1 + o_orderkey % 7 as string) || ' en 5.1.2E.'"


def _join(*lines: str) -> str:
    return f" || {_NL} || ".join(lines)


_TEXTS = [
    _join("'Van: ' || c_name", "'Aan: Team ' || cast(o_custkey % 7 as string) || ' < ,@min.example>'", "'Onderwerp: ' || o_orderpriority", f"'Verzonden: ' || {_DAY} || '-' || {_MONTH} || '-' || {_YEAR} || ' ' || {_CLOCK}", "''", "'Beste collega, zie ' || " + _CODES, "'verslag.pdf'"),
    _join("'From: ' || c_name", "'To: Desk'", "'Subject: ' || o_orderstatus || ' ' || o_orderpriority", f"'Sent: Mon ' || cast(month(o_orderdate) as string) || '/' || cast(day(o_orderdate) as string) || '/' || {_YEAR} || ' 7:23:28 PM'", "'first body'", "'second body'", "'-----Original Message-----'", "'Van: Ander'", "'Onderwerp: oud'", f"'Datum: ' || {_DAY} || ' ' || {_MONTH_NL} || ' ' || {_YEAR}", "'slot ' || " + _CODES),
    _join("'Nota aan de Minister'", f"'Datum: ' || cast(day(o_orderdate) as string) || ' ' || {_MONTH_NL} || ' ' || {_YEAR}", "'ter informatie, ter advisering. ' || " + _CODES),
    _join("'Contactpersoon: ' || c_name", f"'Datum | {{}}' || cast(day(o_orderdate) as string) || {_MONTH_NL} || {_YEAR}".replace("{}", ""), "'Ons kenmerk: ' || cast(o_orderkey as string)", "'Geachte heer, met vriendelijke groet, kenmerk 5.1.1'"),
    _join("'Rapport ' || cast(o_orderkey as string)", "'Samenvatting en conclusies; aanbevelingen volgen.'", f"'Peildatum {{}}' || {_DAY} || '-' || {_MONTH} || '-' || {_YEAR}".replace("{}", "")),
    _join("'Tijdlijn'", *[f"'{d:02d}-0{1 + d % 9}-' || {_YEAR} || ' stap {d}'" for d in range(1, 7)]),
    _join("'0' || lpad(cast(o_orderkey % 1000 as string), 3, '0') || ' Notulen vergadering'", "'agendapunt 1, overleg. Pagina 1 van 3'", f"{_YEAR} || '-' || {_MONTH} || '-' || {_DAY}"),
    _join("'vervolg van de tekst zonder kop'", "'[12:05] Jan: hallo 5.1.2e'", "'Piet (12:06): dit bericht is verwijderd'", "'regel ' || cast(o_orderkey as string)"),
]
PAGE_TEXT = "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_TEXTS)) + " END"
CATEGORY = "CASE o_orderkey % 8 WHEN 0 THEN 'E-mail' WHEN 1 THEN 'E-mail' WHEN 2 THEN 'Nota' WHEN 3 THEN 'Brief' WHEN 4 THEN 'Report' WHEN 5 THEN 'Other' WHEN 6 THEN 'Vergadernotulen' ELSE 'Other' END"
COLUMNS = {
    "dossier_id": "o_custkey",
    "page_num": "page_num",
    "detected_code": "CASE WHEN o_orderkey % 4 <> 0 THEN lpad(cast(1 + (o_custkey * 7 + cast(floor((page_num - 1) / 3) as bigint)) % 900 as string), 4, '0') END",
    "within_doc_page": "CASE WHEN o_orderkey % 11 = 0 THEN 1 WHEN o_orderkey % 11 = 1 THEN 2 END",
    "is_new_document": "o_orderkey % 5 = 0",
    "category": CATEGORY,
    "text": PAGE_TEXT,
    "email_start": "o_orderkey % 8 = 0",
    "doc_date": f"CASE WHEN o_orderkey % 16 = 4 THEN {_YEAR} || '-' || {_MONTH} || '-' || {_DAY} END",
    "okey": "o_orderkey",
}

SQL_PAGES = (
    "fx_pages AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items())
    + " FROM (SELECT o.*, c.c_name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_num"
    " FROM orders o JOIN customer c ON o_custkey = c_custkey))"
)
#: Boundary sets of a dossier: page 0 always; truth and prediction differ at some pages. totals: pages of each dossier.
SQL_BOUNDS = (
    "fx_gt AS (SELECT dossier_id, page_num - 1 AS page0 FROM fx_pages WHERE page_num = 1 OR okey % 5 = 0),"
    " fx_pred AS (SELECT dossier_id, page_num - 1 AS page0 FROM fx_pages WHERE page_num = 1 OR (okey % 5 = 0 AND okey % 3 <> 0) OR okey % 7 = 0),"
    " fx_total AS (SELECT dossier_id, count(*) AS n FROM fx_pages GROUP BY 1)"
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page of a dossier (a customer's orders in key order)."""
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("page_num", F.row_number().over(w).cast("long"))
    return rows.select(*[F.expr(e).alias(c) for c, e in COLUMNS.items()])


def truth(fx: DataFrame) -> DataFrame:
    return fx.where((F.col("page_num") == 1) | (F.col("okey") % 5 == 0)).select("dossier_id", (F.col("page_num") - 1).alias("page0"))


def predicted(fx: DataFrame) -> DataFrame:
    keep = (F.col("page_num") == 1) | ((F.col("okey") % 5 == 0) & (F.col("okey") % 3 != 0)) | (F.col("okey") % 7 == 0)
    return fx.where(keep).select("dossier_id", (F.col("page_num") - 1).alias("page0"))


def totals(fx: DataFrame) -> DataFrame:
    return fx.groupBy("dossier_id").agg(F.count(F.lit(1)).alias("n"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boxes on a unit page, from line items: two words of a part number and a quantity."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("part"),
        F.expr(WORD["x0"]).alias("x0"), F.expr(WORD["y0"]).alias("y0"), F.expr(WORD["text"]).alias("text"),
    ).withColumn("x1", F.col("x0") + 0.05).withColumn("y1", F.col("y0") + 0.02)


WORD = {
    "x0": "cast((l_partkey * 37) % 95 as double) / 100",
    "y0": "cast((l_suppkey * 53 + l_linenumber) % 98 as double) / 100",
    "text": "CASE WHEN l_partkey % 3 = 0 THEN lpad(cast(l_suppkey % 1000 as string), 4, '0') ELSE cast(1000 + l_partkey % 2000 as string) END",
}
SQL_WORDS = f"fx_words AS (SELECT *, x0 + 0.05 AS x1, y0 + 0.02 AS y1 FROM (SELECT l_orderkey AS page_id, l_linenumber AS seq, l_partkey AS part, {WORD['x0']} AS x0, {WORD['y0']} AS y0, {WORD['text']} AS text FROM lineitem))"
