"""Language identification by words first, character n-grams after.

Method: word-first backoff. A word that any language's word list knows scores each language by
the logarithm of its relative frequency there (a fixed penalty where that language lacks it);
an unseen word falls back to its character n-grams, from four characters down to one, at the
first length of which some n-gram is known, by the mean of their logarithmic frequencies.
A text's language has the highest mean score over all words of the whole text.

Counts cover every training row. The model keeps, for each language, its ``WORDS_PER_LANGUAGE``
most frequent words and, of each length, its ``GRAMS_PER_ORDER`` most frequent n-grams (ties by the
item), however many languages there are; so it has at most 120,000 entries a language (about
15 MB in a worker), and it is broadcast. Words beyond the list are scored by their n-grams.

Words are runs of letters (Unicode's alphabetic characters, and the marks that follow them); digits
of any kind, such as superscripts and circled numbers, aren't letters.

Edge cases: null text, or text without a letter, gives ``und`` with score 0; rows with a null
language don't train; a tie goes to the language first in alphabetical order; without training
rows everything is ``und``; very long texts are read whole; repeated rows count repeatedly;
extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD_ORDER, ORDERS = 0, (4, 3, 2, 1)
WORDS_PER_LANGUAGE, GRAMS_PER_ORDER = 60_000, 15_000
PENALTY = -7.0
UNKNOWN = "und"


def _ranges(wanted) -> str:
    """The characters of Unicode for which ``wanted`` holds, as ranges of a regular expression's class."""
    out, first = [], None
    for c in range(0x110001):
        if c < 0x110000 and wanted(chr(c)):
            first = c if first is None else first
        elif first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(out)


#: Finds the same words where no mark, and no digit but the plain ones, occurs; it is faster.
_PLAIN = re.compile(r"[^\W\d_]+")


@cache
def _odd() -> frozenset[str]:
    """Marks, and the characters that count as numbers but aren't plain digits."""
    every = map(chr, range(0x110000))
    return frozenset(c for c in every if unicodedata.category(c) in ("Mn", "Mc") or (c.isalnum() and not c.isalpha() and not c.isdecimal()))


@cache
def _letters() -> re.Pattern:
    letter, mark = _ranges(str.isalpha), _ranges(lambda c: unicodedata.category(c) in ("Mn", "Mc"))
    return re.compile(f"[{letter}][{letter}{mark}]*")
_FLUSH, _MEMO = 100_000, 150_000


def words_of(text: str) -> list[str]:
    low = text.lower()
    plain = low.isascii() or _odd().isdisjoint(set(low))
    return (_PLAIN if plain else _letters()).findall(low)


def _counted(batches: Iterator) -> Iterator:
    """(lang, n, item, count) of words (n = 0) and of n-grams, summed over the task as far as memory allows."""
    from collections import Counter

    import pyarrow as pa

    def out(words: dict[str, Counter]) -> Iterator:
        for lang, found in words.items():
            grams: dict[tuple[int, str], int] = {}
            for w, c in found.items():
                padded = f" {w} "
                for n in ORDERS:
                    for i in range(len(padded) - n + 1):
                        key = padded[i : i + n]
                        grams[key] = grams.get(key, 0) + c
            keys, counts = [*found, *grams], [*found.values(), *grams.values()]
            orders = [WORD_ORDER] * len(found) + [len(g) for g in grams]
            for a in range(0, len(keys), 50_000):
                part = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys[part]), pa.string()), pa.array(orders[part], pa.int32()), pa.array(keys[part], pa.string()), pa.array(counts[part], pa.int64())], names=["lang", "n", "item", "c"])

    words: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words.setdefault(lang, Counter()).update(words_of(text.as_py()))
        if sum(map(len, words.values())) > _FLUSH:
            yield from out(words)
            words = {}
    yield from out(words)


def train(docs: DataFrame) -> dict:
    """The model from the text and lang of ``docs``: languages, items by order, and their scores."""
    rows = common.pick(docs, lang="string", text="string").where("lang is not null and text is not null")
    counts = common.materialize(rows.mapInArrow(_counted, "lang string, n int, item string, c long").groupBy("lang", "n", "item").agg(F.sum("c").alias("c")), "language_id")
    totals = {(r["lang"], r["n"]): r["c"] for r in counts.groupBy("lang", "n").agg(F.sum("c").alias("c")).collect()}
    langs = sorted({lang for lang, _ in totals})
    most = F.when(F.col("n") == WORD_ORDER, WORDS_PER_LANGUAGE).otherwise(GRAMS_PER_ORDER)
    order = [F.desc("c"), "item"]
    # the top of each of 64 parts first, so that no task ranks all items of a frequent language
    near = Window.partitionBy("lang", "n", F.pmod(F.xxhash64("item"), F.lit(64))).orderBy(*order)
    whole = Window.partitionBy("lang", "n").orderBy(*order)
    top = counts.withColumn("r", F.row_number().over(near)).where(F.col("r") <= most).withColumn("r", F.row_number().over(whole)).where(F.col("r") <= most)
    # by Arrow columns and flat arrays: a Python object a row and a list an item would take the driver several times the model
    model: dict = {"langs": langs, "items": [{} for _ in range(1 + max(ORDERS))]}
    found = [array("f") for _ in model["items"]]
    at, unseen = {lang: i for i, lang in enumerate(langs)}, array("f", [PENALTY] * len(langs))
    for batch in top.select("lang", "n", "item", "c").toArrow().to_batches(max_chunksize=10_000):
        for lang, n, item, c in zip(*(x.to_pylist() for x in batch.columns)):
            items, scores = model["items"][n], found[n]
            if item not in items:
                items[item] = len(items)
                scores.extend(unseen)
            scores[items[item] * len(langs) + at[lang]] = math.log10(c / totals[lang, n])
    model["scores"] = [np.array(x, dtype="float32").reshape(len(i), len(langs)) for x, i in zip(found, model["items"])]
    common.drop("language_id", docs.sparkSession)
    return model


class Scorer(dict):
    """Mean scores of texts under a model: word -> row of one table of scores.

    Words of the lists have their rows; a word beyond them gets one when it is first met, by its n-grams, until ``_MEMO`` of them are forgotten.
    """

    def __init__(self, model: dict) -> None:
        super().__init__(model["items"][WORD_ORDER])
        self.langs, self.items, self.tables = model["langs"], model["items"], model["scores"]
        self.listed, self.used = len(self), len(self)
        room = np.full((_MEMO if self.langs else 0, len(self.langs)), PENALTY, dtype="float32")
        self.table = np.concatenate([self.tables[WORD_ORDER].reshape(self.listed, len(self.langs)), room])

    def __missing__(self, word: str) -> int:
        row = self.used
        padded = f" {word} "
        self.table[row] = PENALTY
        for n in ORDERS:
            known = self.items[n]
            rows = [known[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in known]
            if rows:
                self.table[row] = np.add.reduce(self.tables[n].take(rows, axis=0), axis=0, dtype="float64") / len(rows)
                break
        self[word] = row
        self.used += 1
        return row

    def total(self, words: list[str]) -> np.ndarray:
        """The sum of the words' scores, by language."""
        out = np.zeros(len(self.langs))
        for a in range(0, len(words), _MEMO // 2):
            part = words[a : a + _MEMO // 2]
            if self.used + len(part) > len(self.table):
                self.clear()
                self.update(self.items[WORD_ORDER])
                self.used = self.listed
            out += self.table.take([self[w] for w in part], axis=0).sum(axis=0, dtype="float64")
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.langs:
            return UNKNOWN, 0.0
        total = self.total(words)
        best = int(total.argmax())
        margin = np.exp((total - total[best]) / len(words) * min(len(words), 10) * math.log(10))
        return self.langs[best], float(1 / margin.sum())


def identify(docs: DataFrame, model: dict, keep: dict[str, str] | None = None, to: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` (name: type) of docs, which include text, and the language and its score under the names ``to``."""
    keep = keep or {"doc_id": "long", "text": "string"}
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = list(keep)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(sent.value)
        for batch in batches:
            got = [scorer.predict(t.as_py()) for t in batch.column(names.index("text"))]
            cols = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*names, *to])

    return common.pick(docs, **keep).mapInArrow(run, ", ".join(f"`{k}` {t}" for k, t in keep.items()) + f", {to[0]} string, {to[1]} double")


def held_out(doc_id="doc_id"):
    """Rows that never train: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
