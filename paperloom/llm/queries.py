"""The registered queries opN_* and their SQL; each is a thin use of its operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit_packing, chat_format, common, decontamination, kneser_ney, language_id, near_dedup, pii_surrogates, quality_rules, sharding, suffix_dedup


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return judged.withColumn("failed_rules", F.array_join("failed_rules", ","))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.pick(common.table(spark, sf_dir, "documents"), doc_id="long", text="string")
    return pii_surrogates.replace(docs, pii_surrogates.session_key(spark)).select("doc_id", "text", F.col("_n_entities").alias("n_entities"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(common.table(spark, sf_dir, "documents"), sharding.SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~language_id.held_out()))
    return language_id.identify(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = common.pick(common.table(spark, sf_dir, "conversations"), conv_id="long", turn="long", role="string", text="string")
    return chat_format.read_back(chat_format.format_windows(rows.unionByName(added)))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(common.table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(common.table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"


def _op1_sql() -> str:
    q = quality_rules
    rules = list(q.RULES)
    of = {k: x.replace("try_divide(", "div(") for k, (_, x) in q.RULES.items()}
    ratio = {k: x.replace("div(word_chars, n_words)", "(word_chars / nullif(n_words, 0))").replace("div(n_symbols, n_words)", "(n_symbols / nullif(n_words, 0))").replace("div(n_dup_lines, n_lines)", "(n_dup_lines / nullif(n_lines, 0))").replace("div(n_repeat_words, n_words)", "(n_repeat_words / nullif(n_words, 0))") for k, x in of.items()}
    bins = ", ".join(f"CAST(least({q.BINS}, floor(coalesce({ratio[k]}, 0.0) / CAST({q.RULES[k][0]} AS DOUBLE) + CAST(1e-9 AS DOUBLE))) AS INTEGER) AS bin_{k}" for k in rules)
    long = " UNION ALL ".join(f"SELECT stratum, '{k}' AS rule, quality, bin_{k} AS bin FROM lab" for k in rules)
    limit = f"CAST({q.ALPHA / len(rules)!r} AS DOUBLE)"
    broken = ", ".join(f"CASE WHEN b.bin_{k} >= c_{k}.cut THEN '{k}' END" for k in sorted(rules))
    joins = " ".join(f"LEFT JOIN best c_{k} ON c_{k}.stratum = b.stratum AND c_{k}.rule = '{k}'" for k in sorted(rules))
    return rf"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
 win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
 rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1) GROUP BY 1),
 f AS (SELECT t.doc_id, stratum, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
 len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_SPACED}'))) AS n_lines, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_SPACED}'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_SPACED}')))) AS n_dup_lines,
 coalesce(rep.n, 0) AS n_repeat_words FROM t LEFT JOIN rep ON t.doc_id = rep.doc_id),
 b AS (SELECT *, n_words < {q.MIN_WORDS} OR n_repeat_words * 100 > n_words * {q.MAX_REPEAT_PERCENT} AS base_failed, {bins} FROM f),
 lab AS (SELECT b.*, l.quality FROM b JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l ON b.doc_id = l.doc_id WHERE NOT base_failed),
 long AS ({long}), tot AS (SELECT stratum, rule, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality <> 1) AS bad FROM long GROUP BY 1, 2),
 cuts AS (SELECT g.stratum, g.rule, g.cut, good, bad, count(l.bin) FILTER (WHERE l.quality = 1) AS f, count(l.bin) FILTER (WHERE l.quality <> 1) AS tr FROM (SELECT *, unnest(range(1, {q.BINS + 1})) AS cut FROM tot) g LEFT JOIN long l ON l.stratum = g.stratum AND l.rule = g.rule AND l.bin >= g.cut GROUP BY ALL),
 cdf AS (SELECT stratum, rule, cut, good, bad, f, tr, sum(exp(lgamma(good + 1) - lgamma(k + 1) - lgamma(good - k + 1) + k * ln({limit}) + (good - k) * ln(1 - {limit}))) AS p FROM (SELECT *, unnest(range(0, f + 1)) AS k FROM cuts WHERE good > 0 AND f < good * {limit}) GROUP BY ALL),
 best AS (SELECT stratum, rule, arg_max(cut, (tr * good - {q.WEIGHT} * f * bad, cut)) AS cut FROM cdf WHERE p <= {q.DELTA} / (SELECT count(DISTINCT stratum) * {len(rules)} FROM t) AND tr * good > {q.WEIGHT} * f * bad GROUP BY 1, 2)
 SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND concat_ws(',', {broken}) = '' AS kept, b.stratum, concat_ws(',', {broken}) AS failed_rules FROM b {joins}"""


_OP6_SQL = r"""WITH dw AS (SELECT doc_id, regexp_extract_all(LOW, 'CLASS') AS w FROM documents), iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(LOW, 'CLASS') AS w FROM benchmark),
 win AS (SELECT DISTINCT item, w[i:i + 9] AS terms FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
 dwin AS (SELECT doc_id, i, n, w[i:i + n - 1] AS terms FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT len(terms) AS n FROM win) WHERE len(w) >= n)),
 hits AS (SELECT doc_id, i, n, item FROM dwin JOIN win ON dwin.terms = win.terms),
 cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1), its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY 1)
 SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM dw LEFT JOIN cov ON dw.doc_id = cov.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id""".replace("LOW", _LOW).replace("CLASS", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Bytes as hexadecimal digits; a start's 200 bytes are 400 digits.
_OP7_SQL = """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 s AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 199)) AS i FROM t WHERE length(h) >= 400)),
 d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM s) WHERE c > 1),
 g AS (SELECT *, sum(CASE WHEN i > p + 200 OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM d)),
 sp AS (SELECT doc_id, span, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY 1, 2),
 gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM sp UNION ALL SELECT doc_id, max(b), NULL FROM sp GROUP BY 1),
 kept AS (SELECT gaps.doc_id, string_agg(substr(h, 2 * x + 1, coalesce(2 * (y - x), 2147483647)), '' ORDER BY x) AS h FROM gaps JOIN t ON gaps.doc_id = t.doc_id GROUP BY 1)
 SELECT t.doc_id, CAST(length(t.h) / 2 AS BIGINT) AS n_bytes, coalesce(r.n, 0) AS n_removed, coalesce(r.c, 0) AS n_spans, sha256(unhex(coalesce(kept.h, t.h))) AS kept_sha256
 FROM t LEFT JOIN (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n, count(*) AS c FROM sp GROUP BY 1) r ON t.doc_id = r.doc_id LEFT JOIN kept ON t.doc_id = kept.doc_id"""

_OP9_SQL = rf"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_SPACED}') AS w FROM documents),
 sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {near_dedup.THRESHOLD_PERCENT} * (nx.n + ny.n - c)),
 e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
 r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS m FROM r GROUP BY 1) c ON c.a = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _op1_sql(), "op6_benchmark_decontamination": _OP6_SQL, "op7_suffix_array_dedup": _OP7_SQL, "op9_minhash_near_dedup": _OP9_SQL}
