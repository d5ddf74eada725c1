"""Column functions over page and document text. All are built-in expressions; none is a UDF."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and labels that results depend on.
#: All white space of Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
REDACTION_CASED = r"\b(5\.[12]\.[1-9][a-z]?)[a-z]?\b"
CODE_GROUND, CODE_YEAR, CODE_LAW = r"^5\.[12]\.", r"^(?:19|20)\d{2}$", "^05[12][1-9]$"
CODE_WITHIN, RASTER_ALONE, RASTER_WITHIN = r"0\d{3}", r"\b0\d{3}\b", r"\d{2,}(0\d{3})"
PAGE_NUMBER, DOCNR = r"\b(\d{1,3})\b", r"(?i)docnr?\s*\d"
FIRST_OF_PAGES = r"(?iU)\bpagina\s+1\s+van\b"
PAGE_STAMP = r"(?iU)^[ \t]*(?:\d{4}|[do]ocn[r,]?\s*[\ds]+)"
LEADING_STAMP = r"(?iU)^\s*(?:\d{4,}|[A-Z]{2,}\d+|\[PDF page \d+\])\s*"
CHAT_CATEGORY = "chat|whatsapp|teams|sms|berichtenverkeer"
REDACTED_ADDRESS = r"(?iU)<\s*,?\s*@([\w.-]+\.\w{2,})\s*>"
SUBJECT_LINE = r"(?iU)^[ \t]*(?:subject|onderwerp|betreft)\s*:\s*(.+)"
ATTACHMENT_LINE = r"(?iU)^[ \t]*(?:bijlage[n]?|attachment[s]?)\s*:\s*(.+)"
REDACTION = r"5\.[12]\.[1-9][a-z]{0,2}"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
FIELDS = "from|van|afzender|to|aan|subject|onderwerp|betreft|sent|verzonden|datum|date|received|cc|bcc"
CANONICAL_FIELD = {"van": "from", "afzender": "from", "aan": "to", "onderwerp": "subject", "betreft": "subject", "verzonden": "sent", "datum": "sent"}
SEPARATOR = r"(?i)^[-_=]{4,}.*?(?:original message|forwarded message|doorgestuurd bericht|oorspronkelijk bericht).*"
EMAIL_PAGE_FIELDS = "van|from|aan|to|onderwerp|subject|datum|date|sent|verzonden|betreft|afzender|cc"
MEMO_PAGE_FIELDS = r"contactpersoon|datum|onze\s+referentie|ons\s+kenmerk|uw\s+referentie|uw\s+kenmerk|behandeld\s+door|doorkiesnummer|telefoon|bijlage[n]?|onderwerp|betreft"
FILENAME = r"\b[\w\-. ]+\.(?:pdf|docx?|xlsx?|pptx?|msg|eml|zip|txt|csv|rtf|odt|ods)\b"
MEMO_LIKE = ["Nota", "Brief", "Report", "Vergadernotulen"]
CATEGORY_OF_LABEL = {
    "email": "E-mail", "Email": "E-mail", "E-mail": "E-mail", "chat": "Chat", "Chat": "Chat", "nota": "Nota", "Nota": "Nota", "report": "Report", "Report": "Report",
    "brief": "Brief", "Brief": "Brief", "timeline": "Timeline", "Timeline": "Timeline", "vergadernotulen": "Vergadernotulen", "Vergadernotulen": "Vergadernotulen",
    "inventarislijst": "Inventarislijst", "Inventarislijst": "Inventarislijst", "other": "Other", "Other": "Other",
}
SUBTYPES = {
    "email": "E-mail", "chat_sms": "Chat", "nota": "Nota", "brief": "Brief", "factuur": "Factuur", "besluit": "Besluit", "kamerbrief": "Kamerbrief",
    "vergaderverslag": "Vergaderverslag", "persbericht": "Persbericht", "rapport": "Rapport", "other": "Overig",
}
SUBTYPE_OF_CATEGORY = {"E-mail": "email", "Chat": "chat_sms", "Nota": "nota", "Brief": "brief", "Report": "rapport", "Vergadernotulen": "vergaderverslag", "Timeline": "other", "Inventarislijst": "other", "Other": "other"}
EVALUATED_TYPES = ["Other", "Nota", "E-mail", "Brief", "Report", "Timeline", "Vergadernotulen", "Chat"]
RULES = {
    "E-mail": [
        r"\bvan:\s", r"\baan:\s", r"\bonderwerp:\s", r"\bverzonden:\s", r"\bdatum:\s", r"\bfrom:\s", r"\bto:\s", r"\bsubject:\s", r"\bsent:\s", r"\bcc:\s", r"\bbcc:\s",
        r"\brequired attendees:\s", r"\boptional attendees:\s", r"\bstart date/time:\s", r"\bend date/time:\s", r"\blocation:\s.*\b(?:webex|teams|skype|zoom|vergader|room)\b",
        r"\boriginal message\b", r"\bforwarded message\b", r"\bdoorgestuurd bericht\b", r"@[\w.-]+\.\w{2,}",
    ],
    "Nota": [r"\bnota\s+aan\b", r"\bnotitie\b", r"\bnota\b", r"\bter informatie\b", r"\bter besluitvorming\b", r"\bter advisering\b", r"\bdienstonderdeel\b", r"\bministerraad\b"],
    "Report": [r"\brapport\b", r"\brapportage\b", r"\bonderzoeksrapport\b", r"\bsamenvatting\b", r"\bconclusie[s]?\b", r"\baanbeveling(en)?\b", r"\bbevinding(en)?\b"],
    "Timeline": [r"\btijdlijn\b", r"\bchronologie\b", r"\bchronologisch\b", r"\boverzicht\b.*\bdatum\b", r"\bperiode\b", r"\b\d{4}\s*[-–]\s*\d{4}\b"],
    "Vergadernotulen": [r"\bnotulen\b", r"\bvergadering\b", r"\bagendapunt\b", r"\bbijeenkomst\b", r"\boverleg\b", r"\bactions?\b"],
    "Brief": [r"\bgeachte\b", r"\bhoogachtend\b", r"\bmet vriendelijke groet\b", r"\bkenmerk\b", r"\bbetreft:\s", r"\buw brief\b", r"\buw kenmerk\b"],
}
ANY_DATE = r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b|\b\d{4}[-/]\d{2}[-/]\d{2}\b|\b\d{1,2}\s+(?:jan|feb|mrt|maa|apr|mei|jun|jul|aug|sep|okt|nov|dec)\w*\s*\d{4}\b"
HTTP_ERROR = r"(?i)^(?:internal\s+server\s+error|bad\s+gateway|service\s+unavailable|not\s+found|forbidden|unauthorized|gateway\s+timeout|\d{3}\s+(?:error|bad\s+gateway|service\s+unavailable))\s*$"
DESCRIPTION_HEADER = r"(?i)^(?:van|aan|from|to|cc|bcc|datum|onderwerp|subject|verzonden|sent)\s*:"
CHAT_REDACTED = r"(?i)\[(?:GELAKT|REDACTED)(?::[^\]]*)?\]|\b5\.[12]\.\d[a-z]{0,2}\b"
CHAT_SYSTEM = r"(?i)\b(dit\s+bericht\s+is\s+verwijderd|this\s+message\s+was\s+deleted)\b"
CHAT_ALL_REDACTED = r"(?i)^(?:[\s,;.|]*(?:\[(?:GELAKT|REDACTED)(?::[^\]]*)?\]|\b5\.[12]\.\d[a-z]{0,2}\b))+[\s,;.|]*$"
CHAT_LINES = [(r"^\[([^\]]+)\]\s*([^:]{1,120})\s*:\s*(.+)$", 2, 1, 3), (r"^(.+?)\s*\(([^)]+)\)\s*:\s*(.+)$", 1, 2, 3)]
INVENTORY_SKIP = r"(?i)^\s*(?:ProcesId|Document\s+nummer|Bestandsnaam|Inventarislijst|Titel|Nr\.?\s|Nummer|Kenmerk|Datum|Pagina|Omschrijving|Besluit|Weigeringsgrond|Openbaarheid|#\s)"
INVENTORY_ROW = r"^\s*(?:\d{3,7}\s+)?(0?\d{1,4})\b\s+(.{4,})"
INVENTORY_GROUNDS = r"(?i)\s+(?:5\.[12]\.\d\w*|\bBR\b|niet\s+openbaar|gedeeltelijk\s+openbaar|openbaar).*$"


def strip(s: Column) -> Column:
    """Without white space (Unicode) at either end."""
    # mostly a glance at both ends shows that there is nothing to do
    plain = lambda c: F.ascii(c).between(33, 126)
    return once(s, lambda x: F.when(plain(x) & plain(F.substr(x, F.lit(-1))), x).otherwise(F.trim(x, F.lit(WHITE))))


def _with(plain: str, s: Column, value: Column, other: Column) -> Column:
    """``value`` where a text holds this plain string, without which a pattern can't match; else ``other``. Null remains null."""
    return F.when(~F.contains(s, F.lit(plain)), other).otherwise(value)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def blank_to_null(s: Column) -> Column:
    """Absent, empty and null are one."""
    return F.nullif(s, F.lit(""))


def lines(text: Column) -> Column:
    """The lines of a text; a line end at the very end adds no line."""
    return once(F.split(F.coalesce(text, F.lit("")), LINE_END, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def first_where(items: Column, test) -> Column:
    return F.try_element_at(F.filter(items, test), F.lit(1))


# -- redaction grounds ---------------------------------------------------------------------


def redaction_codes_ocr(text: Column) -> Column:
    """Codes bounded by word ends, case-sensitive; a doubled suffix letter keeps its first."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?U)\b({REDACTION})\b"), F.lit(1)), lambda c: F.regexp_replace(c, "([a-z])[a-z]+$", "$1"))


def redaction_codes_vlm(text: Column) -> Column:
    """Codes anywhere and in any case, in lower case."""
    none = F.array().cast("array<string>")
    return _with("5.", text, F.transform(F.regexp_extract_all(text, F.lit(f"(?i)({REDACTION})"), F.lit(1)), F.lower), none)


def counted(items: Column) -> Column:
    """item -> how often it occurs in an array."""
    return F.map_from_entries(F.transform(F.array_distinct(items), lambda x: F.struct(x, F.size(F.filter(items, lambda y: y == x)).cast("long"))))


def larger_counts(a: Column, b: Column) -> Column:
    """The larger of two counters, key by key."""
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def annotate_ocr(text: Column) -> Column:
    """Wraps codes as [GELAKT: code]; wraps again what is wrapped already."""
    return F.regexp_replace(text, "(?U)" + REDACTION_CASED, "[GELAKT: $1]")


def annotate_vlm(text: Column) -> Column:
    """Wraps codes in any case, but for those that stand in a marker."""
    # a look behind its first figure, not at every place
    return _with("5.", text, F.regexp_replace(text, rf"(?i)(5(?<!\[GELAKT: 5){REDACTION[1:]})", "[GELAKT: $1]"), text)


# -- document codes and page numbers ---------------------------------------------------------


def doc_code(raw: Column) -> Column:
    """The four-digit form of a document code, or null."""
    raw = blank_to_null(raw)
    digits = F.regexp_replace(raw, r"(?U)\D", "")
    n = F.length(digits)
    small = F.try_to_number(digits, F.lit("999")).cast("int")
    code = (
        F.when(n == 7, F.concat(F.lit("0"), F.substring(digits, 4, 3)))
        .when(n > 4, F.coalesce(F.regexp_substr(digits, F.lit(CODE_WITHIN)), F.right(digits, F.lit(4))))
        .when(n == 4, digits)
        .when((n > 0) & small.between(1, 999), F.lpad(digits, 4, "0"))
    )
    bad = raw.rlike(CODE_GROUND) | code.rlike(CODE_YEAR) | (code == "0000") | code.rlike(CODE_LAW) | ((n == 4) & ~code.startswith("0"))
    return F.when(~bad & code.rlike(r"^\d{4}$"), code)


def is_year(code: Column) -> Column:
    return code.try_cast("int").between(1900, 2099)


def raster_code(text: Column, bottom: Column) -> Column:
    """A stamped code in a strip's text: alone, or at a strip at the bottom within a longer number."""
    alone = F.regexp_substr(text, F.lit(RASTER_ALONE))
    inside = F.nullif(F.regexp_extract(text, RASTER_WITHIN, 1), F.lit(""))
    return F.coalesce(F.when(~is_year(alone), alone), F.when(bottom, inside))


def small_page_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(strip(text), PAGE_NUMBER, 1), F.lit("")).cast("int")


def has_docnr_label(text: Column) -> Column:
    return F.coalesce(text.rlike(DOCNR), F.lit(False))


# -- page predicates ---------------------------------------------------------------------------


def marks_new_document(within_doc_page: Column, text: Column) -> Column:
    return F.coalesce(within_doc_page == 1, F.lit(False)) | F.coalesce(text.rlike(FIRST_OF_PAGES), F.lit(False))


def _fresh(text: Column, field: str, veto: str, within: int) -> Column:
    each = lines(text)
    first = first_where(each, lambda x: x.rlike(r"(?U)\S"))
    hits = F.size(F.filter(F.slice(each, 1, within), lambda x: x.rlike(field)))
    return (first.isNull() | first.rlike(veto)) & (hits >= 2)


def starts_email(text: Column) -> Column:
    """A page that opens with a header field or stamp and has two header lines among its first 20."""
    field = rf"(?iU)^[ \t]*(?:{EMAIL_PAGE_FIELDS})\s*:"
    return _fresh(text, field, f"(?:{field})|{PAGE_STAMP}", 20)


def starts_memo(text: Column) -> Column:
    field = rf"(?iU)^[ \t]*(?:{MEMO_PAGE_FIELDS})\s*:"
    return _fresh(text, field, field, 15)


def is_new_vlm(is_new: Column, within_doc_page: Column) -> Column:
    new = F.coalesce(is_new, F.lit(False)) | F.coalesce(within_doc_page == 1, F.lit(False))
    return new & (within_doc_page.isNull() | (within_doc_page == 1))


def continues(text: Column) -> Column:
    """Whether a page starts in mid-sentence: a small letter after any stamp."""
    rest = F.regexp_replace(F.regexp_replace(text, LEADING_STAMP, ""), r"(?U)^\s+", "")
    return F.coalesce(rest.rlike(r"^\p{Ll}"), F.lit(False))


def is_chat_category(category: Column) -> Column:
    return F.coalesce(F.lower(category).rlike(CHAT_CATEGORY), F.lit(False))


def is_http_error(text: Column) -> Column:
    return F.coalesce(text.rlike(HTTP_ERROR), F.lit(False))


# -- categories ----------------------------------------------------------------------------------


def _mapped(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def category(label: Column) -> Column:
    return F.coalesce(_mapped(CATEGORY_OF_LABEL, strip(label)), F.lit("Other"))


def subtype(raw: Column, of_category: Column) -> Column:
    value = F.replace(F.lower(strip(F.coalesce(raw, F.lit("")))), F.lit("-"), F.lit("_"))
    return F.when(value.isin(*SUBTYPES), value).otherwise(F.coalesce(_mapped(SUBTYPE_OF_CATEGORY, of_category), F.lit("other")))


def type_label(of_category: Column, of_subtype: Column) -> Column:
    cat = strip(F.coalesce(of_category, F.lit("")))
    key = F.lower(strip(F.coalesce(blank_to_null(of_subtype), F.lit("other"))))
    return F.when(is_chat_category(cat), "Chat").when(F.lower(cat).startswith("e-mail") | (F.lower(cat) == "email"), "E-mail").otherwise(F.coalesce(_mapped(SUBTYPES, key), blank_to_null(cat), F.lit("Overig")))


def evaluated_type(label: Column, truth: bool) -> Column:
    """A label as the evaluation counts it: unknown ones are Other in the truth, themselves in a prediction."""
    known = F.when(label == "", F.lit("Other")).when(label.isin(*EVALUATED_TYPES), label)
    return F.coalesce(known, F.lit("Other") if truth else label)


def literal_start(pattern: str) -> str:
    """The plain characters that whatever a pattern matches begins with; empty if that can't be told."""
    if "|" in re.sub(r"\([^()]*\)", "", pattern):
        return ""
    found = re.match(r"(?:\\b)?([a-z@][a-z :/]*)", pattern)
    if not found:
        return ""
    return found[1][:-1] if pattern[found.end() : found.end() + 1] in ("?", "*", "{") else found[1]


def category_scores(text: Column, first_page: Column) -> dict[str, Column]:
    t, fp = F.lower(text), F.lower(F.coalesce(blank_to_null(first_page), F.left(text, F.lit(1000))))

    def hit(s: Column, p: str) -> Column:
        # a search for plain bytes is far cheaper than a pattern's, and mostly ends it
        start, found = literal_start(p), s.rlike(rf"(?U){p}")
        return F.coalesce((F.contains(s, F.lit(start)) & found if start else found).cast("int"), F.lit(0))

    found = {k: reduce(lambda a, b: a + b, [hit(fp if k == "E-mail" else t, p) for p in v]) for k, v in RULES.items()}
    found["Nota"] += hit(fp, r"^\s*(nota|notitie)\b") * 3
    found["Timeline"] += hit(fp, r"^\s*tijdlijn\b") * 3 + (F.coalesce(F.size(F.regexp_extract_all(t, F.lit(rf"(?U)({ANY_DATE})"), F.lit(0))), F.lit(0)) >= 5).cast("int") * 2
    return found


def keyword_category(text: Column, first_page: Column) -> Column:
    """The rule set with most hits; the first of equals; Other without any."""
    both = F.struct(text.alias("t"), first_page.alias("f"))
    scores = once(both, lambda s: F.array(*category_scores(s["t"], s["f"]).values()))
    labels = F.array(*[F.lit(k) for k in RULES])
    return once(scores, lambda a: F.when(F.array_max(a) > 0, F.element_at(labels, F.array_position(a, F.array_max(a)).cast("int"))).otherwise("Other"))


# -- cards ---------------------------------------------------------------------------------------


def title(is_email: Column, subject: Column, text: Column, code: Column) -> Column:
    # the first line with six characters between its white space
    line = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?U)(?:^|\n)[^\S\n]*(\S[^\n]{4,}\S)", 1), F.lit(""))
    return F.coalesce(F.left(F.when(is_email, blank_to_null(subject)), F.lit(120)), F.left(line, F.lit(120)), code)


def sender(text: Column) -> Column:
    head = F.left(text, F.lit(1000))
    value = F.left(strip(F.regexp_extract(head, r"(?iU)(?:van|from)\s*:\s*([^\n]+)", 1)), F.lit(80))
    small = F.lower(head)
    return F.when(~(F.contains(small, F.lit("van")) | F.contains(small, F.lit("from"))), F.lit("")).otherwise(value)


def description(of_category: Column, subject: Column, text: Column, codes: Column) -> Column:
    each = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 20), strip)
    line = first_where(each, lambda x: (F.length(x) > 8) & ~x.rlike(DESCRIPTION_HEADER) & ~x.rlike(r"(?U)^[\d\s.\-/]+$"))
    redacted = F.when(F.size(codes) > 0, F.concat(F.lit("Geredigeerd document ("), F.array_join(F.slice(codes, 1, 3), ", "), F.lit(")")))
    return F.when(of_category == "E-mail", F.coalesce(F.left(blank_to_null(subject), F.lit(100)), F.lit("E-mail"))).otherwise(F.coalesce(F.left(line, F.lit(100)), redacted, of_category))


def _sentence(s: Column) -> Column:
    short = F.regexp_replace(F.left(s, F.lit(220)), "[ ,.;:]+$", "")
    return F.concat(short, F.lit("."))


def collapsed(s: Column) -> Column:
    return F.regexp_replace(strip(F.coalesce(s, F.lit(""))), r"(?U)\s+", " ")


def summary(text: Column, label: Column) -> Column:
    short = collapsed(text)
    return F.when(short == "", F.concat(F.lit("Dit "), F.lower(label), F.lit("-document bevat inhoud uit het Woo-dossier."))).otherwise(_sentence(short))


def chat_summary(bodies: Column, text: Column) -> Column:
    """From the first two messages with a body among the first four, else from the text."""
    said = F.slice(F.filter(F.transform(F.slice(bodies, 1, 4), collapsed), lambda x: x != ""), 1, 2)
    merged = F.when(F.size(said) > 0, F.array_join(said, " ")).otherwise(strip(F.left(collapsed(text), F.lit(180))))
    return F.when(merged == "", F.lit("Chatgesprek over praktische afstemming en informatie-uitwisseling.")).otherwise(_sentence(merged))


def normalised(s: Column) -> Column:
    return F.lower(collapsed(s))


def page_summary(seq: Column, stamp: Column, wpn: Column, is_new: Column, cont: Column, cat: Column, start: Column, frm: Column, subj: Column, text: Column) -> Column:
    """The compact line about a page."""
    yn = lambda c: F.when(c, "Y").otherwise("N")
    extra = F.when(start, F.concat(F.coalesce(F.concat(F.lit(' from="'), F.left(blank_to_null(frm), F.lit(30)), F.lit('"')), F.lit("")), F.coalesce(F.concat(F.lit(' subj="'), F.left(blank_to_null(subj), F.lit(40)), F.lit('"')), F.lit("")))).otherwise("")
    number = F.when(seq < 1000, F.lpad(seq.cast("string"), 3, "0")).otherwise(seq.cast("string"))
    return F.concat(F.lit("p"), number, F.lit(": stamp="), F.coalesce(stamp, F.lit("null")), F.lit(" wpn="), F.coalesce(wpn.cast("string"), F.lit("null")), F.lit(" new="), yn(is_new), F.lit(" cont="), yn(cont), F.lit(" cat="), F.coalesce(cat, F.lit("Other")), F.lit(" eml="), yn(start), extra, F.lit(' | "'), F.left(collapsed(text), F.lit(500)), F.lit('"'))


# -- e-mail lines ---------------------------------------------------------------------------------


def header_field(line: Column) -> Column:
    """The canonical header field that a line starts with, or null."""
    name = F.lower(F.nullif(F.regexp_extract(line, rf"(?iU)^[ \t]*({FIELDS})\s*:", 1), F.lit("")))
    return F.when(F.contains(line, F.lit(":")), once(name, lambda x: F.coalesce(_mapped(CANONICAL_FIELD, x), x)))


def is_separator(line: Column) -> Column:
    return F.coalesce(line.rlike(SEPARATOR), F.lit(False))


def is_subject(line: Column) -> Column:
    return F.coalesce(F.contains(line, F.lit(":")) & line.rlike(SUBJECT_LINE), F.lit(False))


def redacted_addresses(text: Column) -> Column:
    return _with("@", text, F.regexp_replace(text, REDACTED_ADDRESS, "<[GELAKT]@$1>"), text)


def _until_header(block: Column) -> Column:
    """The lines before the first blank line or header field."""
    stop = F.array_position(F.transform(block, lambda x: ~x.rlike(r"(?U)\S") | header_field(x).isNotNull()), F.lit(True)).cast("int")
    return once(stop, lambda k: F.when(k > 0, F.slice(block, F.lit(1), k - 1)).otherwise(block))


def header_value(block: Column, names: str, multiline: bool = False, within: int = 15) -> Column:
    """The value of the first header line of these names; over more lines, up to a blank line or the next field."""
    pattern = rf"(?iU)^[ \t]*(?:{names})\s*:\s*(.+)"
    at = F.array_position(F.transform(F.slice(block, 1, within), lambda x: F.contains(x, F.lit(":")) & x.rlike(pattern)), F.lit(True)).cast("int")
    first = lambda k: strip(F.regexp_extract(F.element_at(block, k), pattern, 1))
    if not multiline:
        return once(at, lambda k: F.when(k > 0, first(k)))
    more = lambda k: once(F.slice(block, k + 1, F.size(block)), _until_header)
    return once(at, lambda k: F.when(k > 0, F.array_join(F.filter(F.concat(F.array(first(k)), F.transform(more(k), strip)), lambda x: x != ""), " ")))


def attachments(block: Column) -> Column:
    """Names after an attachment label, and lines that are a file name alone, in the first 30 lines; in order, once each."""
    trimmed = lambda x: F.regexp_replace(strip(x), "^[;,]+|[;,]+$", "")

    def of(line: Column) -> Column:
        value = F.regexp_extract(line, ATTACHMENT_LINE, 1)
        names = F.regexp_extract_all(value, F.lit(rf"(?iU)({FILENAME})"), F.lit(1))
        listed = F.when(F.size(names) > 0, names).otherwise(F.split(value, "[;,]"))
        alone = F.when(strip(line).rlike(rf"(?iU)^{FILENAME}$"), F.array(strip(line))).otherwise(F.array().cast("array<string>"))
        return F.transform(F.when(line.rlike(ATTACHMENT_LINE), listed).otherwise(alone), trimmed)

    # a file name has a dot; few lines have a label
    maybe = F.filter(F.slice(block, 1, 30), lambda x: F.contains(x, F.lit(".")) | (F.contains(x, F.lit(":")) & x.rlike(ATTACHMENT_LINE)))
    return F.array_distinct(F.filter(F.flatten(F.transform(maybe, of)), lambda x: x != ""))


def attachments_near_subject(block: Column) -> Column:
    """File names in the five lines after the subject, up to a blank line or header field."""
    at = F.array_position(F.transform(F.slice(block, 1, 15), is_subject), F.lit(True)).cast("int")
    near = lambda k: once(F.slice(block, k + 1, 5), _until_header)
    names = lambda k: F.flatten(F.transform(F.filter(near(k), lambda x: F.contains(x, F.lit("."))), lambda x: F.transform(F.regexp_extract_all(x, F.lit(rf"(?iU)({FILENAME})"), F.lit(1)), strip)))
    return once(at, lambda k: F.when(k > 0, F.array_distinct(names(k))).otherwise(F.array().cast("array<string>")))


# -- chats ----------------------------------------------------------------------------------------


def chat_body(body: Column) -> Column:
    s = strip(F.coalesce(body, F.lit("")))
    return F.when((s != "") & s.rlike(CHAT_ALL_REDACTED), "[Bericht weggelakt]").otherwise(s)


def chat_flags(body: Column) -> tuple[Column, Column]:
    return F.coalesce(body.rlike(CHAT_REDACTED), F.lit(False)), F.coalesce(body.rlike(CHAT_SYSTEM), F.lit(False))


def chat_line(line: Column) -> Column:
    """sender, stamp and body of a chat line by the first form that fits, or null."""
    s = strip(line)
    out = F.lit(None).cast("struct<sender:string,stamp:string,body:string>")
    for p, who, when, what in reversed(CHAT_LINES):
        got = F.struct(*[strip(F.regexp_extract(s, p, k)).alias(n) for k, n in ((who, "sender"), (when, "stamp"), (what, "body"))])
        out = F.when(s.rlike(p), got).otherwise(out)
    return out


def chat_sender(label: Column, position: Column) -> Column:
    side = F.when(position == "right", "Eigenaar").otherwise("Onbekend")
    return F.coalesce(blank_to_null(strip(F.coalesce(blank_to_null(label), side))), F.lit("Onbekend"))


def thread_id(code: Column, participants: Column, name: Column) -> Column:
    key = F.coalesce(blank_to_null(F.array_join(F.filter(participants, lambda x: strip(x) != ""), "|")), blank_to_null(strip(name)), blank_to_null(code), F.lit("chat"))
    slug = F.left(F.regexp_replace(F.regexp_replace(F.lower(key), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(60))
    return F.concat(code, F.lit("-chat-"), F.coalesce(blank_to_null(slug), F.lit("chat")))


# -- inventory ------------------------------------------------------------------------------------


def inventory_row(line: Column) -> Column:
    """number (four digits) and title of a line of an inventory table, or null."""
    s = strip(line)
    name = F.regexp_replace(strip(F.regexp_replace(F.regexp_extract(s, INVENTORY_ROW, 2), INVENTORY_GROUNDS, "")), "[.,]+$", "")
    number = F.regexp_extract(s, INVENTORY_ROW, 1)
    ok = (s != "") & ~s.rlike(INVENTORY_SKIP) & s.rlike(INVENTORY_ROW) & (F.length(name) >= 4)
    return F.when(ok, F.struct(F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number).alias("number"), name.alias("title")))


def progress(line: Column) -> Column:
    """Percent done (5 to 85) from a log line that counts pages, or null."""
    got = lambda k: F.regexp_extract(line, r"(?iU)Page\s+(\d+)\s*/\s*(\d+)", k).try_cast("double")
    return (5 + F.bround(80 * got(1) / F.nullif(got(2), F.lit(0.0)))).cast("int")
