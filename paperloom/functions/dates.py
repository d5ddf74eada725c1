"""Column functions that find and read dates. Timestamps carry no zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Month names. Dutch, then the English names that differ.
DUTCH = {"januari": 1, "februari": 2, "maart": 3, "april": 4, "mei": 5, "juni": 6, "juli": 7, "augustus": 8, "september": 9, "oktober": 10, "november": 11, "december": 12}
ENGLISH = {"january": 1, "february": 2, "march": 3, "may": 5, "june": 6, "july": 7, "august": 8, "october": 10}
SHORT = {"jan": 1, "feb": 2, "mrt": 3, "maa": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "okt": 10, "nov": 11, "dec": 12}
MONTHS = DUTCH | ENGLISH
MONTH_PATTERN = "|".join(sorted(MONTHS, key=lambda m: (-len(m), m)))
GLUED = rf"(?iU)(\d{{1,2}})\s*({MONTH_PATTERN})\s*(\d{{4}})"
# The forms of a date, in the order in which they are tried, and what their groups are.
FORMS = [
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{2}))?$", "y mo d h mi"),
    (r"(?U)^\w{2,5}\.?\s+(\d{1,2})/(\d{1,2})/(\d{4})", "mo d y"),
    (r"(?U)^\w+,\s+(\w+)\s+(\d{1,2}),\s+(\d{4})", "name d y"),
    (r"(?U)^\w+\s+(\d{1,2})\s+(\w+)\s+(\d{4})", "d name y"),
    (r"(?U)^(\d{1,2})-(\d{1,2})-(\d{4})(?:\s+(\d{1,2}):(\d{2}))?$", "d mo y h mi"),
    (GLUED, "d name y"),
]
DATUM_FIELD = r"(?iU)\bdatum\b[\s|:\t]+(.{2,60}?)(?:\s*\||\n|$)"
SCANNED = r"(?U)(?=\d)\b(\d{1,2}-\d{1,2}-\d{4})\b"
# An e-mail's date as year first, as numbers in European order, and with a month's name.
EMAIL_ISO = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{1,2}:\d{2}))?"
EMAIL_NUMBERS = r"(?U)(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})(?:\s+(\d{1,2}:\d{2}))?"
EMAIL_NAMED = r"(?U)(\d{1,2})\s+([a-zA-Z]+)\s+(\d{4})(?:\s+(\d{1,2}:\d{2}))?"
MOMENT = r"(\d{4}-\d{2}-\d{2})[ T](\d{1,2}:\d{2})"
# An annotated date as numbers, with a month's name after the day, and before it.
TRUTH_NUMBERS = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$"
TRUTH_NAMED = r"(?U)^(\d{1,2})\s+([a-zA-Zë]+)\s+(\d{4})$"
TRUTH_AMERICAN = r"^([A-Za-z]+) (\d{1,2}), (\d{4})$"
ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"
TITLE_ISO, TITLE_EUROPEAN = r"(\d{4})-(\d{2})-(\d{2})", r"(\d{2})[/-](\d{2})[/-](\d{4})"
CLOCK = r"^\d{1,2}:\d{2}$"


def _month(values: dict[str, int], name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), name)


def _at(y: Column, mo: Column, d: Column, h: Column | None = None, mi: Column | None = None) -> Column:
    """A timestamp without zone, or null where the calendar has no such moment."""
    whole = lambda c: F.coalesce(c.try_cast("int"), F.lit(0)) if c is not None else F.lit(0)
    two = lambda c, n=2: F.lpad(c.cast("string"), n, "0")
    clock = [F.lit(" "), two(whole(h)), F.lit(":"), two(whole(mi)), F.lit(":00")] if h is not None else [F.lit(" 00:00:00")]
    # the cast gives null where the calendar or the clock has no such moment
    return F.concat(two(y.try_cast("int"), 4), F.lit("-"), two(mo.try_cast("int")), F.lit("-"), two(d.try_cast("int")), *clock).try_cast("timestamp_ntz")


def _groups(s: Column, pattern: str, n: int) -> list[Column]:
    return [F.nullif(F.regexp_extract(s, pattern, i), F.lit("")) for i in range(1, n + 1)]


def parse(raw: Column) -> Column:
    """The first of six forms that gives a valid moment: ISO, short weekday M/D/Y, long weekday, weekday D month Y, D-M-Y, D month Y anywhere."""
    return T.once(T.strip(raw), _parse)


def _read(s: Column, pattern: str, fields: str) -> Column:
    """The moment that a form's groups give: y, mo (a number) or name (of a month), d and perhaps h and mi."""
    names = fields.split()
    got = dict(zip(names, _groups(s, pattern, len(names))))
    month = _month(MONTHS, F.lower(got["name"])) if "name" in got else got["mo"]
    # one match decides whether there are groups at all
    return F.when(s.rlike(pattern), _at(got["y"], month, got["d"], got.get("h"), got.get("mi")))


def _parse(s: Column) -> Column:
    return F.coalesce(*[_read(s, pattern, fields) for pattern, fields in FORMS])


def datum_raw(text: Column) -> Column:
    """The value of a Datum field within the first 3000 characters, or null."""
    head = F.left(text, F.lit(3000))
    return F.when(F.contains(F.lower(head), F.lit("datum")), F.nullif(T.strip(F.regexp_extract(head, DATUM_FIELD, 1)), F.lit("")))


def scan(text: Column, chars: int = 1000) -> Column:
    """The first valid date in a text's beginning: those of the form D-M-Y first, then D month Y."""
    head = F.left(F.coalesce(text, F.lit("")), F.lit(chars))
    numeric = F.transform(F.regexp_extract_all(head, F.lit(SCANNED), F.lit(1)), lambda x: F.struct(_at(*[F.split(x, "-")[i] for i in (2, 1, 0)]).alias("date"), x.alias("raw")))

    def named(x: Column) -> Column:
        d, name, y = (F.regexp_extract(x, GLUED, i) for i in (1, 2, 3))
        return F.struct(_at(y, _month(MONTHS, F.lower(name)), d).alias("date"), x.alias("raw"))

    names = F.transform(F.regexp_extract_all(head, F.lit(f"({GLUED})"), F.lit(0)), named)
    valid = lambda found: F.try_element_at(F.filter(found, lambda x: x["date"].isNotNull()), F.lit(1))
    return F.coalesce(F.when(F.contains(head, F.lit("-")), valid(numeric)), valid(names))


def document_date(doc_date: Column, category: Column, text: Column, email_dates: Column) -> Column:
    """struct(date, raw): the given date, else by category the first e-mail date, the Datum field, or a scan of the text."""
    none = F.lit(None).cast("struct<date:timestamp_ntz,raw:string>")
    made = lambda raw: T.once(parse(raw), lambda d: F.when(d.isNotNull(), F.struct(d.alias("date"), raw.alias("raw"))))
    given = made(T.blank_to_null(T.strip(doc_date)))
    mails = F.try_element_at(F.filter(F.transform(email_dates, made), lambda x: x.isNotNull()), F.lit(1))
    field = F.when(category.isin(*T.MEMO_LIKE), T.once(datum_raw(text), made))
    by_category = F.when(category == "E-mail", F.coalesce(mails, none)).otherwise(F.coalesce(field, scan(text)))
    return F.coalesce(given, by_category)


def email_date(raw: Column) -> Column:
    """ISO date, with a time if one is there; what has no known form stays as it is. The calendar isn't checked."""
    s = T.strip(raw)
    y, mo, d, t = _groups(s, EMAIL_ISO, 4)
    iso = F.when(s.rlike(EMAIL_ISO), F.concat_ws("T", F.concat_ws("-", y, mo, d), t))
    two = lambda c: F.lpad(c, 2, "0")
    d2, m2, y2, t2 = _groups(s, EMAIL_NUMBERS, 4)
    european = F.when(s.rlike(EMAIL_NUMBERS) & d2.try_cast("int").between(1, 31) & m2.try_cast("int").between(1, 12), F.concat_ws("T", F.concat_ws("-", y2, two(m2), two(d2)), t2))
    d3, name, y3, t3 = _groups(s, EMAIL_NAMED, 4)
    m3 = F.coalesce(_month(DUTCH | SHORT, F.lower(name)), _month(DUTCH | SHORT, F.left(F.lower(name), F.lit(3))))
    dutch = F.when(s.rlike(EMAIL_NAMED) & m3.isNotNull(), F.concat_ws("T", F.concat_ws("-", y3, two(m3.cast("string")), two(d3)), t3))
    return F.when(T.blank_to_null(raw).isNotNull(), F.coalesce(iso, european, dutch, raw))


def email_day(normalised: Column) -> Column:
    return F.split(normalised, "T", 2)[0]


def email_time(normalised: Column) -> Column:
    parts = F.split(normalised, "T", -1)
    return F.when(F.size(parts) == 2, parts[1])


def split_moment(value: Column) -> Column:
    """struct(day, time) of an ISO date and time, of a text that holds one, or of anything else as a day."""
    v = T.blank_to_null(value)
    day, time = _groups(v, MOMENT, 2)
    has_t = F.contains(v, F.lit("T"))
    return F.struct(
        F.when(has_t, F.split(v, "T", 2)[0]).otherwise(F.coalesce(day, v)).alias("day"),
        F.when(has_t, F.left(F.split(v, "T", 2)[1], F.lit(5))).otherwise(time).alias("time"),
    )


def truth_date(raw: Column) -> Column:
    """ISO date of a whole annotated date, or empty."""
    s = T.strip(F.coalesce(raw, F.lit("")))
    pad = lambda c: F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)
    d, m, y = _groups(s, TRUTH_NUMBERS, 3)
    d2, name, y2 = _groups(s, TRUTH_NAMED, 3)
    m2 = _month(MONTHS, F.lower(name))
    named = F.when(m2.isNotNull(), F.concat_ws("-", y2, pad(m2.cast("string")), pad(d2)))
    name3, d3, y3 = _groups(s, TRUTH_AMERICAN, 3)
    english = {k: v for k, v in MONTHS.items() if k in ENGLISH or k in ("april", "september", "november", "december")}
    american = F.date_format(_at(y3, _month(english, F.lower(name3)), d3), "yyyy-MM-dd")
    return F.when(s.rlike(ISO_DAY), s).otherwise(F.coalesce(F.when(y.isNotNull(), F.concat_ws("-", y, pad(m), pad(d))), named, american, F.lit("")))


def chat_title_date(raw: Column) -> Column:
    s = T.strip(F.coalesce(raw, F.lit("")))
    y, m, d = _groups(s, TITLE_ISO, 3)
    d2, m2, y2 = _groups(s, TITLE_EUROPEAN, 3)
    return F.coalesce(F.when(y.isNotNull(), F.concat_ws("-", d, m, y)), F.when(d2.isNotNull(), F.concat_ws("-", d2, m2, y2)), T.blank_to_null(s), F.lit("Datum onbekend"))


def chat_stamp(day: Column, stamp: Column) -> Column:
    clock = (T.blank_to_null(day).isNotNull()) & stamp.rlike(CLOCK)
    return F.when(clock, F.concat(day, F.lit("T"), stamp)).otherwise(F.coalesce(T.blank_to_null(stamp), day))


def dense_dates(text: Column) -> Column:
    """Whether five dates or more stand in a text."""
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(rf"(?U){T.ANY_DATE}")) >= 5, F.lit(False))
