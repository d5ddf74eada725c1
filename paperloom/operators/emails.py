"""E-mail threads: split points by a fold over lines, the e-mails between them, and the choice of the better list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T

# Line counts of the split rules.
EXIT_BODY, GAP, BODY, SUBJECT_WINDOW = 6, 4, 2, 15
NO_HEADER = "No header-field cluster found — kept as single block"
PREAMBLE = "Reply body before quoted headers — no header fields found"
EMAIL = "struct<subject:string,sender:string,to:string,cc:string,date:string,time:string,attachments:array<string>,text:string,warning:string>"
FIELDS = [f.split(":")[0] for f in EMAIL[len("struct<") : -1].split(",")]


def split_points(lines: Column) -> Column:
    """0-based line numbers where an e-mail begins: a separator; a field seen already; or a field after body text with a subject near."""
    marked = F.transform(lines, lambda x: F.struct(T.is_separator(x).alias("sep"), T.header_field(x).alias("field"), T.is_subject(x).alias("subject")))
    # only a field asks whether a subject is near
    near = lambda m, x, i: F.when(x["field"].isNotNull(), F.exists(F.slice(m, i + 1, SUBJECT_WINDOW), lambda y: y["subject"])).otherwise(False)
    ahead = T.once(marked, lambda m: F.transform(m, lambda x, i: F.struct(x["sep"].alias("sep"), x["field"].alias("field"), near(m, x, i).alias("near"))))
    start = F.struct(
        F.lit(0).alias("i"), F.lit(False).alias("head"), F.array().cast("array<string>").alias("seen"), F.lit(-999).alias("last"),
        F.lit(0).alias("body"), F.array().cast("array<int>").alias("cuts"),
    )

    def step(a: Column, x: Column) -> Column:
        is_field, sep = x["field"].isNotNull(), x["sep"]
        gap = (a["i"] - a["last"] > GAP) & (a["body"] > BODY)
        new = sep | (is_field & (F.array_contains(a["seen"], x["field"]) | ((~a["head"] | gap) & x["near"])))
        header = sep | is_field
        body = F.when(a["head"], a["body"] + 1).otherwise(a["body"])
        seen = F.when(sep, F.array().cast("array<string>")).when(new, F.array(x["field"])).when(is_field, F.array_append(a["seen"], x["field"])).otherwise(a["seen"])
        return F.struct(
            (a["i"] + 1).alias("i"), F.when(header, True).otherwise(a["head"] & (body < EXIT_BODY)).alias("head"), seen.alias("seen"), F.when(header, a["i"]).otherwise(a["last"]).alias("last"),
            F.when(header, F.lit(0)).otherwise(body).alias("body"), F.when(new, F.array_append(a["cuts"], a["i"])).otherwise(a["cuts"]).alias("cuts"),
        )

    return F.aggregate(ahead, start, step)["cuts"]


def _kind(fields: list[str]) -> str:
    types = dict(f.split(":") for f in EMAIL[len("struct<") : -1].split(","))
    return f"struct<{','.join(f'{f}:{types[f]}' for f in fields)}>"


def _email(block: Column, fields: list[str]) -> Column:
    made = lambda day: {
        "subject": lambda: T.header_value(block, "subject|onderwerp|betreft"), "sender": lambda: T.header_value(block, "from|van|afzender"),
        "to": lambda: T.header_value(block, "to|aan", True), "cc": lambda: T.header_value(block, "cc", True),
        "date": lambda: D.email_day(day), "time": lambda: F.when(F.contains(day, F.lit("T")), D.email_time(day)),
        "attachments": lambda: T.once(T.attachments(block), lambda a: F.concat(a, F.array_except(T.attachments_near_subject(block), a))),
        "text": lambda: T.strip(F.array_join(block, "\n")), "warning": lambda: F.lit(None).cast("string"),
    }
    return T.once(_moment(block), lambda day: F.struct(*[made(day)[f]().alias(f) for f in fields])).cast(_kind(fields))


def _moment(block: Column) -> Column:
    """The normalised date of an e-mail's lines, or null."""
    return T.once(T.header_value(block, "sent|verzonden|datum|date"), D.email_date)


def _block(text: Column, warning: str, fields: list[str]) -> Column:
    known = {"attachments": F.array().cast("array<string>"), "text": text, "warning": F.lit(warning)}
    return F.struct(*[known.get(f, F.lit(None).cast("string")).alias(f) for f in fields]).cast(_kind(fields))


def blocks(lines: Column, cuts: Column) -> Column:
    """The lines of each e-mail that holds any text."""
    each = F.transform(cuts, lambda c, i: F.slice(lines, c + 1, F.coalesce(F.try_element_at(cuts, i + 2), F.size(lines)) - c))
    return F.filter(each, lambda b: T.strip(F.array_join(b, "\n")) != "")


def mail_dates(text: Column) -> Column:
    """The dates of the e-mails of a text, in order, as ``split`` gives them; e-mails without one are left out."""
    days = lambda lines: T.once(split_points(lines), lambda cuts: block_dates(blocks(lines, cuts)))
    return T.once(T.lines(T.redacted_addresses(text)), days)


def block_dates(each: Column) -> Column:
    """The dates of e-mails, in order; those of e-mails without one are left out."""
    return F.filter(F.transform(each, lambda b: D.email_day(_moment(b))), lambda d: T.blank_to_null(d).isNotNull())


def _before(lines: Column, cuts: Column) -> Column:
    """What stands before the first split point."""
    return T.strip(F.array_join(F.slice(lines, F.lit(1), F.greatest(F.coalesce(F.try_element_at(cuts, F.lit(1)), F.lit(0)), F.lit(0))), "\n"))


def count(lines: Column, cuts: Column, each: Column) -> Column:
    """How many e-mails ``listed`` gives."""
    return F.when(F.size(cuts) == 0, 1).otherwise((_before(lines, cuts) != "").cast("int") + F.size(each))


def listed(lines: Column, cuts: Column, each: Column, fields: list[str] = FIELDS) -> Column:
    """The e-mails of a text's lines, from their split points and blocks."""
    single = F.array(_block(T.strip(F.array_join(lines, "\n")), NO_HEADER, fields))
    none = F.array().cast(f"array<{_kind(fields)}>")
    preamble = T.once(_before(lines, cuts), lambda before: F.when(before != "", F.array(_block(before, PREAMBLE, fields))).otherwise(none))
    return F.when(F.size(cuts) == 0, single).otherwise(F.concat(preamble, F.transform(each, lambda b: _email(b, fields))))


def apart(lines: Column) -> Column:
    """Whether marked redaction codes may have changed how a text is split or what its dates are.

    A code can only do so within an address, at a separator's words or in a date field; any line with one beside these counts.
    """
    where = r"(?iU)@|^[-_=]{4}|^[ \t]*(?:sent|verzonden|datum|date)\s*:"
    return F.exists(lines, lambda x: F.contains(x, F.lit("[GELAKT: ")) & x.rlike(where))


def split(docs: DataFrame, text: str = "text", key: str = "doc_code", fields: list[str] = FIELDS) -> DataFrame:
    """docs' other columns with one row per e-mail: n, id (key.n) and the fields of EMAIL, or those of them that are asked for; others are not worked out."""
    rest = [c for c in docs.columns if c != text]
    out = docs.withColumn("_lines", T.lines(T.redacted_addresses(F.col(text)))).withColumn("_cuts", split_points(F.col("_lines")))
    out = out.withColumn("_blocks", blocks(F.col("_lines"), F.col("_cuts")))
    each = out.select(*rest, F.posexplode(listed(F.col("_lines"), F.col("_cuts"), F.col("_blocks"), fields)).alias("_n", "_m"))
    return each.select(*rest, (F.col("_n") + 1).alias("n"), F.concat(F.col(key).cast("string"), F.lit("."), (F.col("_n") + 1).cast("string")).alias("id"), "_m.*")


def enrich(mails: DataFrame, other: DataFrame, keys: list[str], fields: tuple[str, ...] = ("subject", "sender", "date", "time")) -> DataFrame:
    """mails with their empty fields taken from the e-mail of the same number in ``other``."""
    b = other.select(*keys, "n", *[F.col(f).alias(f"_{f}") for f in fields])
    both = mails.join(b, [*keys, "n"], "left")
    return both.select(*[F.coalesce(T.blank_to_null(F.col(c)), F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in mails.columns])


def choose(text_mails: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """For each document the longer list, the given one at a tie; a winning text list is enriched from the given one.

    Columns: keys, n, subject, sender, date, time and source (given or text).
    """
    fields = ["subject", "sender", "date", "time"]
    listed = lambda d, to: d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("n").cast("int").alias("n"), *fields))).alias(to))
    both = listed(text_mails, "_t").join(listed(given, "_g"), keys, "full")
    kind = both.schema["_t"].dataType.simpleString()
    both = both.withColumns({c: F.coalesce(F.col(c).cast(kind), F.array().cast(kind)) for c in ("_t", "_g")})
    by = F.map_from_entries(F.transform("_g", lambda m: F.struct(m["n"].alias("k"), m.alias("v"))))

    def fuller(known: Column) -> Column:
        one = lambda m, of: F.struct(m["n"].alias("n"), *[F.coalesce(T.blank_to_null(m[f]), of[f], m[f]).alias(f) for f in fields])
        return F.transform("_t", lambda m: T.once(F.try_element_at(known, m["n"]), lambda of: one(m, of)))

    is_given = (F.size("_t") <= F.size("_g")) & (F.size("_g") > 0)
    chosen = F.when(is_given, F.col("_g")).otherwise(T.once(by, fuller))
    each = both.select(*keys, F.explode(chosen).alias("_m"), F.when(is_given, "given").otherwise("text").alias("source"))
    return each.select(*keys, "_m.*", "source")
