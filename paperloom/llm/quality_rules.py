"""Quality rules with risk-controlled thresholds.

Method: each rule rejects a document whose value reaches a cutoff. Labelled documents of good
quality are the holdout; none of them shaped the rules. For a stratum (a language) and a rule,
the cutoffs are tried in fixed order from the loosest to the strictest. A cutoff is certified
while the exact (Clopper-Pearson) upper bound of its false rejection rate stays within the rule's
share of ``ALPHA``; the first that fails ends the sequence, so each sequence spends its error
probability once, and Bonferroni's correction divides ``DELTA`` by the number of sequences
(strata times rules). With probability 1 - DELTA, then, no stratum loses more than ALPHA of its
good documents to all rules together. Of the certified cutoffs the one is used for which the
rate of rejected bad documents less WEIGHT times the rate of rejected good ones is largest, if
that is positive; a stratum with too few labels to certify anything gets no cutoff.

Edge cases: null text has no words and fails the base; a null language is a stratum of its own
(the empty name); documents without a word have the value 0 for all rules; labels that repeat a doc_id
count once, by the lowest quality; labels without a document don't count; an empty table gives
no row; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

ALPHA, DELTA, WEIGHT = 0.05, 0.05, 10
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Cutoffs of every rule are multiples of its unit, 1 to BINS; the largest rejects least.
BINS = 400
#: rule: (unit, value as a SQL expression over the features)
RULES = {
    "symbols": (0.005, "try_divide(n_symbols, n_words)"),
    "long_words": (0.1, "try_divide(word_chars, n_words)"),
    "short_words": (0.1, "greatest(0, 40 - try_divide(word_chars, n_words))"),
    "dup_lines": (0.0025, "try_divide(n_dup_lines, n_lines)"),
    "repeats": (0.0025, "try_divide(n_repeat_words, n_words)"),
}
#: Cutoff tables up to this many rows are broadcast.
BROADCAST_ROWS = 100_000
_WORDS, _SYMBOL = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[#*$%&|<>]")
_FEATURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = _WORDS.findall(text)
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    repeats = 0
    if len(words) > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(windows)) < len(windows):
            first: dict[tuple, int] = {}
            hit = bytearray(len(words))
            for i, w in enumerate(windows):
                j = first.setdefault(w, i)
                if j != i:
                    hit[i : i + WINDOW] = hit[j : j + WINDOW] = b"\x01" * WINDOW
            repeats = hit.count(1)
    return len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines), len(lines) - len(set(lines)), repeats


def features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [measure(t.as_py()) for t in batch.column(2)]
            cols = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 6)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=[x.split()[0] for x in _FEATURES.split(", ")])

    return common.pick(docs, doc_id="long", lang="string", text="string").mapInArrow(run, _FEATURES)


def upper_bound_within(failed: int, of: int, limit: float, delta: float) -> bool:
    """Whether the exact upper bound, at confidence 1 - delta, of a rate seen as failed/of is at most ``limit``.

    That holds exactly if at most ``failed`` of ``of`` has a probability of at most delta under the rate ``limit``.
    """
    if of <= 0 or failed >= of * limit:
        return False
    total, log_p, log_q = 0.0, math.log(limit), math.log1p(-limit)
    base = math.lgamma(of + 1)
    for k in range(failed, -1, -1):
        term = math.exp(base - math.lgamma(k + 1) - math.lgamma(of - k + 1) + k * log_p + (of - k) * log_q)
        total += term
        if total > delta or term < total * 1e-17:
            break
    return total <= delta


def best_cutoff(by: dict[int, tuple[int, int]], share: float, level: float) -> tuple[int, int, int, int, int] | None:
    """(cutoff, n_good, n_false, n_bad, n_true) of the certified cutoff that is worth most, or None; by: value in units -> good and bad documents."""
    good, bad = (sum(x[i] for x in by.values()) for i in (0, 1))
    false = true = most = 0
    best = None
    for cut in range(BINS, 0, -1):
        g, y = by.get(cut, (0, 0))
        false, true = false + g, true + y
        if not upper_bound_within(false, good, share, level):
            break
        worth = true * good - WEIGHT * false * bad
        if worth > most:
            best, most = (cut, good, false, bad, true), worth
    return best


def _with_bins(rows: DataFrame) -> DataFrame:
    """Adds, for each rule, bin_<rule>: the largest cutoff (in units) that the row reaches, at most BINS."""
    for k, (unit, x) in RULES.items():
        rows = rows.withColumn(f"bin_{k}", F.least(F.lit(BINS), F.floor(F.coalesce(F.expr(x), F.lit(0.0)) / unit + 1e-9)).cast("int"))
    return rows


def _stratum():
    return F.coalesce("lang", F.lit(""))


def cutoffs(feats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff (in units), n_good, n_false, n_bad, n_true: the certified cutoffs in use."""
    lab = common.pick(labels, doc_id="long", quality="int").where("doc_id is not null and quality is not null")
    lab = lab.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    base_ok = feats.where(~base_failed())
    rows = _with_bins(base_ok).withColumn("stratum", _stratum()).join(lab, "doc_id")
    long = rows.select("stratum", "quality", F.explode(F.create_map(*[x for k in RULES for x in (F.lit(k), F.col(f"bin_{k}"))])).alias("rule", "bin"))
    # at most strata x rules x (BINS + 1) rows, summed before the shuffle
    counts = long.groupBy("stratum", "rule", "bin").agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") == 1, 0).otherwise(1)).alias("bad"))
    strata = feats.select(_stratum().alias("s")).distinct().count()
    level, share = delta / max(1, strata * len(RULES)), alpha / len(RULES)

    def certify(batch):
        import pandas as pd

        best = best_cutoff({int(x): (int(g), int(y)) for x, g, y in zip(batch["bin"], batch["good"], batch["bad"])}, share, level)
        out = [(batch["stratum"].iloc[0], batch["rule"].iloc[0], *best)] if best else []
        return pd.DataFrame(out, columns=["stratum", "rule", "cutoff", "n_good", "n_false", "n_bad", "n_true"])

    return counts.groupBy("stratum", "rule").applyInPandas(certify, "stratum string, rule string, cutoff int, n_good long, n_false long, n_bad long, n_true long")


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Features of every document with base_failed, failed_rules (names, in order) and kept."""
    feats = common.materialize(features(docs), "quality_rules")
    cuts = common.materialize(cutoffs(feats, labels, alpha, delta), "quality_rules")
    by = cuts.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    by = F.broadcast(by) if cuts.count() <= BROADCAST_ROWS else by
    with_bins = _with_bins(feats.withColumn("stratum", _stratum()).join(by, "stratum", "left"))
    broken = F.array_compact(F.array(*[F.when(F.col(f"bin_{k}") >= F.try_element_at("cuts", F.lit(k)), F.lit(k)) for k in sorted(RULES)]))
    out = with_bins.withColumn("failed_rules", broken).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", "failed_rules")
