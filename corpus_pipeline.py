"""The corpus pipeline: language ID, near-dedup, decontamination, surrogates for personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in
the shared folder and read again as the next stage's docs. All stages but the last return the
columns of documents. A stage works on whatever its predecessor kept, in any columns; nulls,
empty texts and empty tables are as its operator defines them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import best_fit_packing, common, decontamination, language_id, near_dedup, pii_surrogates

#: A document goes if its language is undetermined, or hardly likelier than chance.
MIN_LANGUAGE_SCORE = 0.3
#: Documents that are this alike (Jaccard, in percent) are near duplicates; op9's own contract is 85.
NEAR_PERCENT = 80
OWNER = "pipeline"
#: The operators' scratch tables that a stage's written result no longer needs.
SCRATCH = {"near_dedup": near_dedup.OWNER, "decontamination": "decontamination", "pii_surrogates": pii_surrogates.OWNER}


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first gives back the driver's memory that earlier stages no longer use."""

    @wraps(f)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark)
        return f(spark, docs, sf_dir)

    return begun


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is found; text without a letter, and null text, goes."""
    model = language_id.train(docs.where(~language_id.held_out()))
    keep = {f.name: f.dataType.simpleString() for f in docs.schema}
    found = language_id.identify(docs, model, keep, ("_found_language", "_found_score"))
    return found.where((F.col("_found_language") != language_id.UNKNOWN) & (F.col("_found_score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return near_dedup.unique(docs, percent=NEAR_PERCENT)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a benchmark window occurs."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


@_stage
def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; all documents stay, and n_chars follows the new text."""
    done = pii_surrogates.replace(docs, pii_surrogates.session_key(spark)).drop("_n_entities")
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all pieces."""
    return best_fit_packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("pii_surrogates", surrogates),
    ("best_fit_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = common.table(spark, sf_dir, "documents")
    before = {owner: common.written(owner) for owner in SCRATCH.values()}
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"{OWNER}-{name}")
        if name in SCRATCH:
            common.drop(SCRATCH[name], spark, since=before[SCRATCH[name]])
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokens of a byte-level BPE can't be had in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None
