"""Greedy one-to-one matches by text similarity. Sequential within a document; Python reads documents in batches of sorted rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Likenesses that a worker keeps, and the characters of two texts whose likeness is kept.
KEPT, KEPT_CHARS = 1 << 14, 400
#: Rows that a batch gives back.
ROWS = 10_000


def normal(s: str | None) -> str:
    return re.sub(r"\s+", " ", s or "").strip().lower()


def similarity(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp ratio of the normalised texts; 0 if one is empty."""
    return _similar(normal(a), normal(b))


def _similar(a: str, b: str) -> float:
    """``similarity`` of normalised texts."""
    if not a or not b or a == b:
        return float(bool(a and b))
    return (_kept_ratio if len(a) + len(b) <= KEPT_CHARS else _ratio)(a, b)


def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


_kept_ratio = lru_cache(KEPT)(_ratio)


def _shared(a: str, b: str) -> int:
    """Characters that two texts have in common, whatever their places: no common subsequence and no set of blocks has more."""
    return sum(min(a.count(c), b.count(c)) for c in set(a))


def _similar_at_most(a: str, b: str) -> float:
    return 2.0 * _shared(a, b) / (len(a) + len(b)) if a and b else 0.0


def _common(places: dict[str, int], n: int, other: str) -> int:
    """Length of the longest common subsequence of a text of length n, by the bit masks of its characters' places, and ``other``."""
    state = (1 << n) - 1
    for c in other:
        u = state & places.get(c, 0)
        state = (state + u) | (state - u)
    return n - (state & ((1 << n) - 1)).bit_count()


def partial_ratio(a: str, b: str) -> float:
    """Best Indel similarity, 0 to 100, of the shorter text with a stretch of the other that is as long, or shorter at its ends.

    The Indel similarity of two texts is twice their longest common subsequence over their lengths together.
    """
    if not a or not b or a == b:
        return 100.0 if a == b else 0.0
    return (_kept_partial if len(a) + len(b) <= KEPT_CHARS else _partial)(a, b)


def _partial(a: str, b: str) -> float:
    best = 0.0
    short, long = sorted((a, b), key=len)
    # of two texts of one length, either may be the one that is cut
    for short, long in [(short, long), (long, short)][: 1 + (len(a) == len(b))]:
        n, places = len(short), {}
        for i, c in enumerate(short):
            places[c] = places.get(c, 0) | 1 << i
        for i in range(1 - n, len(long)):
            part = long[max(i, 0) : i + n]
            # a stretch whose outer character is foreign isn't the best; no more can be common than it is long
            if part[0 if i + n > len(long) else -1] in places and 200 * len(part) / (n + len(part)) > best:
                best = max(best, 200 * _common(places, n, part) / (n + len(part)))
    return best


_kept_partial = lru_cache(KEPT)(_partial)


def _partial_at_most(a: str, b: str) -> float:
    """No stretch is shorter than what it has in common with the shorter text."""
    n, m = min(len(a), len(b)), _shared(a, b)
    return 200 * m / (n + m) if n else partial_ratio(a, b)


#: What is known of an e-mail or a start page: its place, and these.
Row = tuple[int, str | None, str | None, str | None]
_TOLD = ["subject", "sender", "date"]


def _groups(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[tuple, list[Row], list[Row]]]:
    """Key and rows of both sides, of batches sorted by key (the first k columns) and side; a group may go over batches."""
    key, sides = None, ([], [])
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:k] != key:
                if key is not None:
                    yield key, *sides
                key, sides = row[:k], ([], [])
            sides[row[k]].append(row[k + 1 :])
    if key is not None:
        yield key, *sides


def _matched(left: tuple[DataFrame, str], right: tuple[DataFrame, str], keys: list[str], match: Callable[[list[Row], list[Row]], list[tuple]], made: dict[str, str]) -> DataFrame:
    """keys and the columns ``made``: what ``match`` gives for the rows of each key of either side, in order of the named places."""
    types = {c: t for c, t in left[0].dtypes if c in keys}
    side = lambda d, at, i: d.select(*[F.col(c).cast(types[c]).alias(c) for c in keys], F.lit(i).alias("_side"), F.col(at).cast("long").alias("_at"), *_TOLD)
    both = side(*left, 0).unionByName(side(*right, 1)).repartition(*keys)
    both = both.sortWithinPartitions(*keys, "_side", F.col("_at").asc_nulls_last(), *_TOLD)
    k, numbers = len(keys), [{"int": pa.int32(), "long": pa.int64()}[t] for t in made.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out = None, []

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for batch in batches:
                schema = schema or pa.schema([*list(batch.schema)[:k], *map(pa.field, made, numbers)])
                yield batch

        for key, a, b in _groups(noted(), k):
            out += [(*key, *x) for x in match(a, b)]
            if len(out) >= ROWS:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return both.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in (types | made).items()))


def match_pages(mails: DataFrame, starts: DataFrame, keys: list[str], least: float = 0.35) -> DataFrame:
    """keys, n, pdf_page: each e-mail takes its best unclaimed start page (score by subject, sender and day);

    the rest take what pages are left in order, and then the last page. mails: keys, n, subject, sender, date;
    starts: keys, pdf_page, subject, sender, date. Documents without a start page are absent.
    """
    told = lambda x: (normal(x[1]), normal(x[2]), (x[3] or "")[:10])

    def score(e: tuple, p: tuple, like: Callable[[str, str], float]) -> float:
        return 0.5 * like(e[0], p[0]) + 0.3 * like(e[1], p[1]) + 0.3 * (bool(e[2]) and e[2] == p[2])

    def run(left: list[Row], right: list[Row]) -> list[tuple]:
        if not left or not right:
            return []
        pages, unused, found = [told(x) for x in right], list(range(len(right))), {}
        for j, e in enumerate(map(told, left)):
            at, most = None, float("-inf")
            for i in unused:
                # a page that can't reach the best so far isn't compared
                if (high := score(e, pages[i], _similar_at_most)) >= least and high > most and (x := score(e, pages[i], _similar)) > most:
                    at, most = i, x
            if most >= least:
                found[j] = at
                unused.remove(at)
        left_over = iter(unused)
        return [(x[0], right[found[j] if j in found else next(left_over, -1)][0]) for j, x in enumerate(left)]

    return _matched((mails, "n"), (starts, "pdf_page"), keys, run, {"n": "int", "pdf_page": "long"})


MAIL_SCORES = ["mail_tp", "mail_fp", "mail_fn", "date_correct", "date_annotated", "sender_correct", "sender_annotated"]


def match_mails(truth: DataFrame, pred: DataFrame, keys: list[str], least: float = 70.0) -> DataFrame:
    """keys and MAIL_SCORES: true e-mails, in order, each take the best unclaimed predicted one whose subject is alike to at least ``least``.

    Of a pair, the dates count where the true one has a date, and the senders (by the same likeness) where it has a sender.
    truth, pred: keys, n, subject, sender, date (normalised). A true e-mail without a subject finds none.
    """
    told = lambda x: (x or "").strip().lower()
    alike = lambda a, b: partial_ratio(a, b) if _partial_at_most(a, b) >= least else -1.0

    def run(left: list[Row], right: list[Row]) -> list[tuple]:
        unused, got = [(told(s), told(who), day) for _, s, who, day in right], dict.fromkeys(MAIL_SCORES, 0)
        for _, subject, sender, date in left:
            subject, sender, at, most = told(subject), told(sender), None, -1.0
            for i, p in enumerate(unused):
                if subject and p[0] and most < 100 and (x := alike(subject, p[0])) > most:
                    at, most = i, x
            if at is None or most < least:
                got["mail_fn"] += 1
                continue
            _, other, day = unused.pop(at)
            got["mail_tp"] += 1
            got["date_annotated"] += bool(date)
            got["date_correct"] += bool(date) and date == day
            got["sender_annotated"] += bool(sender)
            got["sender_correct"] += bool(sender) and alike(sender, other) >= least
        got["mail_fp"] = len(unused)
        return [tuple(got.values())]

    return _matched((truth, "n"), (pred, "n"), keys, run, dict.fromkeys(MAIL_SCORES, "long"))


def match_subjects(truth: DataFrame, pred: DataFrame, keys: list[str], least: float = 70.0) -> DataFrame:
    """keys, tp, fp, fn of ``match_mails`` by subjects alone."""
    blank = lambda d: d.withColumn("sender", F.lit(None).cast("string")).withColumn("date", F.lit(None).cast("string"))
    found = match_mails(blank(truth), blank(pred), keys, least)
    return found.select(*keys, *[F.col(f"mail_{c}").alias(c) for c in ("tp", "fp", "fn")])
