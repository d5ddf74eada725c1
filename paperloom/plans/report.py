"""Reports of an evaluation run: one table for each pipeline and one of page statistics, as rows of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import annotation as A

HEADS = {"p_exact": "P", "r_exact": "R", "f1_exact": "F1", "p_near": "P +-1", "r_near": "R +-1", "f1_near": "F1 +-1", "rq": "RQ", "sq": "SQ", "pq": "PQ", "type_accuracy": "Type"}


def tables(run: DataFrame, digits: int = 3) -> DataFrame:
    """pipeline, position and the columns of the report as text: the dossiers in order, then their average. run: as ``annotation.evaluation_run``."""
    last = F.col("dossier_id") == "ALL"
    shown = [F.format_number(F.col(c), digits).alias(HEADS[c]) for c in A.RUN]
    place = F.when(last, F.lit(1)).otherwise(0).alias("position")
    return run.select("pipeline", place, F.when(last, "Average").otherwise(F.upper("dossier_id")).alias("dossier"), *shown)


def statistics(pages: DataFrame) -> DataFrame:
    """The rows of ``evaluate.page_statistics`` with a total: documents summed, means averaged, least and most pages."""
    of = ["n_docs", "mean_pages", "median_pages", "min_pages", "max_pages"]
    total = pages.agg(F.sum("n_docs").alias(of[0]), F.avg("mean_pages").alias(of[1]), F.avg("median_pages").alias(of[2]), F.min("min_pages").alias(of[3]), F.max("max_pages").alias(of[4]))
    return pages.select(F.col("dossier_id").cast("string").alias("dossier"), *of).unionByName(total.select(F.lit("Total").alias("dossier"), *of))


def console(table: DataFrame, order: list[str], width: int = 9) -> DataFrame:
    """line: the rows of a table as lines of fixed columns, under a head, in the order of these columns. Meant for reports, so for a few rows a dossier."""
    names = [c for c in table.columns if c not in ("pipeline", "position")]
    cell = lambda c: F.lpad(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")), width, " ")
    head = "".join(c.rjust(width) for c in names)
    rows = table.select(F.lit(1).alias("_h"), *[F.col(f"`{c}`").cast("string").alias(f"_{i}") for i, c in enumerate(order)], F.concat(*map(cell, names)).alias("line"))
    top = table.sparkSession.range(1).select(F.lit(0).alias("_h"), *[F.lit(None).cast("string").alias(f"_{i}") for i in range(len(order))], F.lit(head).alias("line"))
    return top.unionByName(rows).orderBy("_h", *[f"_{i}" for i in range(len(order))]).select("line")
