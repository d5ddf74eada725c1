"""Repair of JSON that a model cut short: trailing commas, an open string, open brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def closed(raw: Column) -> Column:
    """The text with what is missing for it to parse appended; a fold over its characters, on the JVM."""
    s = F.regexp_replace(F.regexp_replace(raw, r"(?U)\s+$", ""), r",\s*([}\]])", "$1")

    def step(acc: Column, c: Column) -> Column:
        quote, open_, close = c == '"', c.isin("{", "["), c.isin("}", "]")
        inside, escaped, stack = acc["inside"], acc["escaped"], acc["stack"]
        grown = F.when(open_, F.concat(F.when(c == "{", "}").otherwise("]"), stack)).when(close, F.substring(stack, F.lit(2), F.length(stack))).otherwise(stack)
        return F.struct(
            F.when(~escaped & quote, ~inside).otherwise(inside).alias("inside"),
            (~escaped & inside & (c == "\\")).alias("escaped"),
            F.when(escaped | inside | quote, stack).otherwise(grown).alias("stack"),
        )

    start = F.struct(F.lit(False).alias("inside"), F.lit(False).alias("escaped"), F.lit("").alias("stack"))
    end = F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), start, step)
    return F.concat(s, F.when(end["inside"], '"').otherwise(""), end["stack"])


def parsed(raw: Column, schema: str) -> Column:
    """The record in ``raw``, in its repaired form where it doesn't parse; null where neither does."""
    whole = F.get_json_object(raw, "$")
    return F.when(whole.isNotNull(), F.from_json(raw, schema)).otherwise(F.when(F.get_json_object(closed(raw), "$").isNotNull(), F.from_json(closed(raw), schema)))
