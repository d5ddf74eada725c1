"""Where a model would be asked: a provider is any function from texts to answers; without one the fallback holds.

Calls are made once for each different input (by digest) and joined back, with retries and
repair of the JSON that comes back. A provider runs in an Arrow batch on the executors.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import repair

Provider = Callable[[str], str]


def ask(inputs: DataFrame, text: str, provider: Provider, tries: int = 3, wait_s: float = 1.0) -> DataFrame:
    """digest, answer: the provider's answer to each different text; null where all tries fail (waits double)."""
    distinct = inputs.select(F.sha1(F.col(text)).alias("digest"), F.col(text).alias("t")).where("t is not null").groupBy("digest").agg(F.first("t").alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for t in rows["t"]:
                answer = None
                for k in range(tries):
                    try:
                        answer = provider(t)
                        break
                    except Exception:  # a provider may fail in any way
                        if k + 1 < tries:
                            time.sleep(wait_s * 2**k)
                out.append(answer)
            yield pd.DataFrame({"digest": rows["digest"], "answer": out})

    return distinct.mapInPandas(run, "digest string, answer string")


def with_answers(inputs: DataFrame, text: str, to: str, fallback: Column, provider: Provider | None = None) -> DataFrame:
    """inputs with column ``to``: the provider's answer, or the fallback where there is none."""
    if provider is None:
        return inputs.withColumn(to, fallback)
    answers = ask(inputs, text, provider)
    joined = inputs.withColumn("_digest", F.sha1(F.col(text))).join(answers.withColumnRenamed("digest", "_digest"), "_digest", "left")
    return joined.withColumn(to, F.coalesce(F.nullif(F.trim("answer"), F.lit("")), fallback)).drop("_digest", "answer")


def records(answers: DataFrame, schema: str) -> DataFrame:
    """answers with ``record``: the JSON answer by its schema, repaired if need be; null where it can't be read."""
    return answers.withColumn("record", repair.parsed(F.col("answer"), schema))
