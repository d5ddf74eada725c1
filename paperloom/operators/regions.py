"""Stamps on a page: words within regions, by the regions' order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Regions as fractions of a page (x0, y0, x1, y1), in order of priority, and whether a leading zero is needed.
REGIONS = [
    (1, "top-right", 0.70, 0.00, 1.00, 0.12, False),
    (2, "top-left", 0.00, 0.00, 0.30, 0.12, False),
    (3, "top-full", 0.00, 0.00, 1.00, 0.12, False),
    (4, "btm-right", 0.70, 0.90, 1.00, 1.00, True),
    (5, "btm-left", 0.00, 0.90, 0.30, 1.00, True),
    (6, "btm-middle", 0.30, 0.90, 0.70, 1.00, True),
]


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIONS, "priority int, region string, rx0 double, ry0 double, rx1 double, ry1 double, zero boolean")


def find_codes(words: DataFrame, regions: DataFrame) -> DataFrame:
    """page_id, code, region: the rightmost code word of the first region that holds one. ``regions`` has a handful of rows."""
    code = T.strip(F.col("text"))
    shaped = F.when(F.col("zero"), code.rlike(r"^0\d{3}$")).otherwise(code.rlike(r"^\d{4}$"))
    inside = (F.col("rx0") <= F.col("x0")) & (F.col("x1") <= F.col("rx1")) & (F.col("ry0") <= F.col("y0")) & (F.col("y1") <= F.col("ry1"))
    hits = words.where(code.rlike(r"^\d{4}$") & ~T.is_year(code)).join(F.broadcast(regions), inside & shaped)
    first = Window.partitionBy("page_id").orderBy("priority", F.desc("x0"), "seq", "part")
    return hits.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("page_id", code.alias("code"), "region")
