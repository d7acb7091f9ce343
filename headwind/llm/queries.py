"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwind.llm.decontaminate import contaminated, find_benchmark_words
from headwind.llm.jaccard import near_duplicates
from headwind.llm.langid import languages_of_documents
from headwind.llm.licenses import scan_licenses, train_licenses
from headwind.llm.mixing import mix_to_targets
from headwind.llm.quality import quality_scores
from headwind.llm.rules import apply_rules
from headwind.llm.tokenfiles import read_token_files, write_token_files
from headwind.llm.toxicity import toxicity_scores
from headwind.llm.urllists import host_of, judge_captures

#: The public tokenizer that op9 encodes with.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = languages_of_documents(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.array_join("languages", ",").alias("languages"))


def _number(host: str) -> str:
    """SQL for a number 0..255 from a host, the same in Spark and DuckDB."""
    digit = lambda i: f"(instr('0123456789abcdef', substr(md5({host}), {i}, 1)) - 1)"
    return f"(16 * {digit(1)} + {digit(2)})"


#: Dated entries for hosts of pages, which bring no lists: (list, pattern, for hosts with, day of 2024, hour, action).
_ENTRIES = (
    ("spam", "h", "m % 3 = 0", "m % 180", 0, "add"),
    ("spam", "h", "m % 3 = 0", "180 + m % 90", 0, "remove"),
    ("spam", "h", "m % 6 = 0", "300", 0, "add"),
    ("parked", "h", "m % 5 = 1", "m", 15, "add"),
    ("parked", "h", "m % 10 = 1", "m", 15, "remove"),
    ("paths", "h || '/en'", "m % 2 = 0", "m % 200", 9, "add"),
    ("paths", "h || '/en'", "m % 4 = 0", "200 + m % 100", 18, "remove"),
    ("zones", "substr(h, instr(h, '.') + 1)", "m % 7 = 3", "m + 60", 0, "add"),
    ("Assets", "upper(h) || '/Static/v1'", "m % 3 = 1", "m % 150", 12, "add"),
    ("assets", "h || '/static/v1'", "m % 3 = 2", "0", 0, "add"),
    ("deep", "h || '/Static/v1/Js/x/Y/z/'", "m % 4 = 1", "m % 250", 12, "add"),
    ("deep", "h || '/Static/v1/Js/x/Y/other'", "m % 4 = 2", "0", 0, "add"),
)
#: Captures of a page, which bring no fetch time: (visit, path instead of the page's own, day of 2024, hour).
_VISITS = ((0, "", "(page_id * 37) % 360", "page_id % 24"), (1, "/Static/v1/Js/x/Y/z/page.js?v=1", "(page_id * 53) % 360", "(page_id * 5) % 24"))


def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is taken as fetched at a time of 2024 that its number gives, and so is a script below its host."""
    at = lambda day, hour: F.expr(f"cast(date_add(DATE '2024-01-01', cast({day} as int)) as timestamp) + make_interval(0, 0, 0, 0, cast({hour} as int), 0, 0)")
    origin = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    visits = F.array(*[F.struct(F.lit(k).alias("visit"), (F.concat(origin, F.lit(path)) if path else F.col("url")).alias("url"), at(day, hour).alias("fetched")) for k, path, day, hour in _VISITS])
    captures = _table(spark, sf_dir, "pages").select("page_id", F.explode(visits).alias("v")).select("page_id", "v.*")
    hosts = captures.select(host_of(F.col("url")).alias("h")).where("h is not null").distinct().select("h", F.expr(_number("h")).alias("m"))
    each = F.array(*[F.when(F.expr(which), F.struct(F.lit(name).alias("list"), F.expr(pattern).alias("pattern"), at(day, hour).alias("day"), F.lit(action).alias("action"))) for name, pattern, which, day, hour, action in _ENTRIES])
    entries = hosts.select(F.explode(F.array_compact(each)).alias("e")).select("e.*")
    judged = judge_captures(captures, entries)
    return judged.select("row.page_id", "row.visit", "row.url", F.col("row.fetched").cast("string").alias("fetched"), "blocked", "n_active", "list", "pattern", F.col("since").cast("string").alias("since"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark_words(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = scan_licenses(docs, train_licenses(docs))
    sure = F.filter("licenses", lambda x: x["confirmed"])
    return found.select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.size(sure).alias("n_confirmed"), (F.size("licenses") - F.size(sure)).alias("n_unconfirmed"), F.round(F.array_max(F.transform("licenses", lambda x: x["probability"])), 4).alias("probability"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(spark, write_token_files(_table(spark, sf_dir, "documents"), TOKENIZER))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_to_targets(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_mixture": op1_language_mixture,
    "op2_url_lists": op2_url_lists,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_license_scan": op6_license_scan,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_quality": op8_quality,
    "op9_token_files": op9_token_files,
    "op10_mixing": op10_mixing,
}


def _op2() -> str:
    at = lambda day, hour: f"CAST(DATE '2024-01-01' + CAST({day} AS INT) AS TIMESTAMP) + to_hours(CAST({hour} AS INT))"
    entries = " UNION ALL ".join(f"SELECT '{name.lower()}' AS list, {pattern} AS pattern, {at(day, hour)} AS day, '{action}' AS action FROM hm WHERE {which}" for name, pattern, which, day, hour, action in _ENTRIES)
    origin = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')"
    visits = " UNION ALL ".join(f"SELECT page_id, CAST({k} AS INT) AS visit, {origin + ' || ' + repr(path) if path else 'url'} AS url, {at(day, hour)} AS day FROM pages" for k, path, day, hour in _VISITS)
    return f"""
WITH v AS ({visits}),
p AS (SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS h,
      regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/*([^?#]*)', 1) AS path FROM v),
hm AS (SELECT h, {_number('h')} AS m FROM (SELECT DISTINCT h FROM p WHERE h <> '') AS x),
e AS (SELECT * REPLACE (rtrim(lower(split_part(pattern, '/', 1)) || substr(pattern, length(split_part(pattern, '/', 1)) + 1), '/') AS pattern) FROM ({entries}) AS x),
daily AS (SELECT list, pattern, day, bool_or(action = 'remove') AS off FROM e GROUP BY ALL),
spells AS (SELECT *, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS until FROM daily),
live AS (SELECT * FROM spells WHERE NOT off),
m AS (SELECT p.page_id, p.visit, list, pattern, live.day AS since FROM p JOIN live ON
      (p.h = pattern OR (ends_with(p.h, '.' || pattern) AND contains(pattern, '.')) OR starts_with(p.h || '/' || p.path || '/', CASE WHEN contains(pattern, '/') THEN pattern || '/' END))
      AND live.day <= p.day AND (until IS NULL OR p.day < until)),
best AS (SELECT page_id, visit, count(*) AS n_active, arg_min(struct_pack(l := list, p := pattern, s := since), struct_pack(a := -length(pattern), b := list)) AS b FROM m GROUP BY page_id, visit)
SELECT p.page_id, p.visit, p.url, CAST(p.day AS VARCHAR) AS fetched, n_active IS NOT NULL AS blocked, coalesce(n_active, 0) AS n_active,
       b.l AS list, b.p AS pattern, CAST(b.s AS VARCHAR) AS since FROM p LEFT JOIN best USING (page_id, visit)
"""


_ALNUM_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

_OP4 = f"""
WITH d AS (SELECT doc_id, coalesce({_ALNUM_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, p, p + least(len(w), 13) - 1), ' ') AS g
       FROM i, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(p) WHERE len(w) > 0),
dw AS (SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
       FROM d, (SELECT DISTINCT n FROM iw) AS s, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(p)),
hits AS (SELECT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hits, unnest(range(p, p + n)) AS u(q) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) AS x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Rates, fences and sketch buckets as in rules.py, spelled out: the lower edge of 32 buckets to each power of two.
_RATES = {"wl": "100 * word_chars // n_words", "sy": "1000 * n_symbols // word_chars", "du": "1000 * n_dup_lines // n_lines", "re": "1000 * n_repeat_words // n_words"}
_SPREADS = {"wl": (6, 20), "sy": (3, 6), "du": (3, 120), "re": (3, 80)}


def _edge(v: str) -> str:
    shift = f"greatest(length(bin({v})) - 6, 0)"
    return f"((({v}) >> {shift}) << {shift})"


def _quartile(v: str, k: int) -> str:
    return f"list_sort(list({_edge(v)}))[CAST(ceil({k} * count(*) / 4.0) AS BIGINT)]"


def _op5() -> str:
    wanted = [f"{_quartile('n_words', 2)} AS words", *(f"{_quartile(sql, k)} AS {r}{k}" for r, sql in _RATES.items() for k in (1, 3))]
    names = ["words", *(f"{r}{k}" for r in _RATES for k in (1, 3))]
    tongue = ", ".join(f"(CAST(b.n AS DOUBLE) * b.{x} + 200.0::DOUBLE * c.{x}) / (CAST(b.n AS DOUBLE) + 200.0::DOUBLE) AS {x}" for x in names)
    picked = ", ".join(f"(CAST(a.n AS DOUBLE) * a.{x} + 200.0::DOUBLE * l.{x}) / (CAST(a.n AS DOUBLE) + 200.0::DOUBLE) AS {x}" for x in names)
    room = "sqrt(greatest(1.0, words / n_words))"
    spread = {r: f"{t} * greatest({r}3 - {r}1, {least}) * {room}" for r, (t, least) in _SPREADS.items()}
    tests = [f"{sql} <= {r}3 + {spread[r]}" for r, sql in _RATES.items()] + [f"{_RATES['wl']} >= wl1 - {spread['wl']}"]
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, trim(coalesce(text, ''), {blanks}) AS bare FROM documents),
w AS (SELECT *, CASE WHEN bare = '' THEN [] ELSE string_split_regex(bare, '[\x20\x09-\x0D]+') END AS w,
      list_filter(string_split(text, chr(10)), lambda x: trim(x, {blanks}) <> '') AS lines FROM t),
win AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 7), ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 6, 1))) AS r(p)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) AS x WHERE c > 1),
again AS (SELECT doc_id, count(DISTINCT q) AS n FROM twice, unnest(range(p, p + 8)) AS u(q) GROUP BY doc_id),
counts AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(len(lines) AS BIGINT) AS n_lines,
           CAST(length(translate(text, {blanks}, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words FROM w LEFT JOIN again USING (doc_id)),
d AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts),
fit AS (SELECT * FROM d WHERE NOT base_failed),
a AS (SELECT lang, source, count(*) AS n, {', '.join(wanted)} FROM fit GROUP BY lang, source),
b AS (SELECT lang, count(*) AS n, {', '.join(wanted)} FROM fit GROUP BY lang),
c AS (SELECT {', '.join(wanted)} FROM fit),
l AS (SELECT b.lang, {tongue} FROM b CROSS JOIN c),
f AS (SELECT a.lang, a.source, {picked} FROM a JOIN l ON a.lang IS NOT DISTINCT FROM l.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN base_failed THEN false ELSE {' AND '.join(tests)} END AS kept
FROM d LEFT JOIN f ON d.lang IS NOT DISTINCT FROM f.lang AND d.source IS NOT DISTINCT FROM f.source
"""


_OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_ALNUM_WORDS}, []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS g
      FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE 5 * c >= 4 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach AS r JOIN links AS l ON r.y = l.x)
SELECT d.doc_id, (SELECT min(y) FROM reach WHERE reach.x = d.doc_id) AS class_id, (SELECT count(*) FROM links WHERE links.x = d.doc_id) AS n_links FROM d
"""

ORACLE_SQL: dict[str, str] = {"op2_url_lists": _op2(), "op4_decontamination": _OP4, "op5_quality_rules": _op5(), "op7_jaccard_join": _OP7}
