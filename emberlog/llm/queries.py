"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import html_wrappers, licenses, mixing, ogg, packing, quality, secrets_crf, simhash, toxicity, urls
from emberlog.llm.common import count_words, cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = cut(docs.select("doc_id", "source", count_words(F.col("text")).alias("size")))
    taken = F.least(F.col("copies"), F.lit(mixing.MAX_REPEATS)) * F.col("size")
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "copies")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents),
sources AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY skey),
weighed AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY skey[1] = 'n', skey) - 1) % 3] AS weight FROM sources),
steps AS (
  SELECT *, source_size * 3 AS cap, (source_size * 3)::DOUBLE / weight AS full_at,
         coalesce(sum(source_size * 3) OVER w, 0) AS caps, coalesce(sum(weight) OVER w, 0) AS weights,
         row_number() OVER (ORDER BY (source_size * 3)::DOUBLE / weight, skey) AS pos
  FROM weighed
  WINDOW w AS (ORDER BY (source_size * 3)::DOUBLE / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources) - caps)::DOUBLE / ((SELECT sum(weight) FROM weighed) - weights)::DOUBLE AS level
  FROM steps),
found AS (SELECT coalesce(arg_min(level, pos), 0) AS level FROM levels WHERE level <= full_at),
targets AS (
  SELECT skey, source_size, least(found.level * weight, cap::DOUBLE) AS target FROM steps, found),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 16777216) AS BIGINT) ELSE 0 END AS rate,
         CAST('0x' || substr(md5('mix' || skey), 1, 6) AS BIGINT) AS start
  FROM targets),
placed AS (
  SELECT *, CASE WHEN size <= 0 THEN 0 ELSE length(bin(size)) * 8 + ((size * 8) >> (length(bin(size)) - 1)) - 8 END AS cls,
         CAST('0x' || substr(digest, 1, 2) AS BIGINT) % 32 AS bucket, substr(digest, 3, 8) AS ord
  FROM sized),
ordered AS (
  SELECT p.*, r.source_size, r.target, r.rate, r.start,
         r.rate * (row_number() OVER (PARTITION BY p.skey ORDER BY cls DESC, bucket, size DESC, ord, doc_id NULLS FIRST) - 1) AS base
  FROM placed p JOIN rates r USING (skey)),
tried AS (
  SELECT skey, k, any_value(start + k * 1048576) % 16777216 AS shift,
         abs(sum(size * ((base + (start + k * 1048576) % 16777216 + rate) // 16777216 - (base + (start + k * 1048576) % 16777216) // 16777216)) - any_value(target)) AS miss
  FROM ordered, range(16) AS t(k) GROUP BY skey, k),
offsets AS (
  SELECT skey, shift FROM (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY miss, k) AS pos FROM tried) WHERE pos = 1),
begun AS (SELECT o.*, base + shift AS began FROM ordered o JOIN offsets USING (skey))
SELECT doc_id, size, source_size, target,
       CAST(((began + rate) // 16777216 - began // 16777216) * size AS BIGINT) AS taken, source,
       CAST((began + rate) // 16777216 - began // 16777216 AS BIGINT) AS copies
FROM begun
"""


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_features(ogg.media_column(table(spark, sf_dir, "documents")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def _quoted(text: str) -> str:
    """A text as an SQL string; what may not stand in one is written by its code."""
    return "concat(" + ", ".join(f"chr({ord(part)})" if part in "\t\n\v\f\r'\\" else f"'{part}'" for part in re.findall(r"[\t\n\v\f\r'\\]|[^\t\n\v\f\r'\\]+", text)) + ")"


def _divergence(own: str, others: str) -> str:
    """The Jensen-Shannon distance of two lists of counts, 0 where one is empty."""
    p, q = f"({own}[k] / list_sum({own})::DOUBLE)", f"({others}[k] / list_sum({others})::DOUBLE)"
    term = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({p} + {q}) / 2)) ELSE 0.0 END"
    total = f"list_sum([({term(p)} + {term(q)})::DOUBLE FOR k IN range(1, len({own}) + 1)]) / 2"
    return f"CASE WHEN list_sum({own}) > 0 AND list_sum({others}) > 0 THEN sqrt(greatest(0.0, {total})) ELSE 0.0 END"


_CHARS = ", ".join(f"length(t) - length(translate(t, {_quoted(c)}, ''))" for c in quality.CHARACTER_CLASSES.values())
_COMMON = ", ".join(f"len(list_filter(plain, lambda x: x = '{w}'))" for w in quality.VOCABULARY)
_WEIGHED = "CASE WHEN list_sum({0}) <= " + str(quality.MAX_WEIGHT) + " THEN {0} ELSE [CAST(floor(x * " + str(quality.MAX_WEIGHT) + " / list_sum({0})) AS BIGINT) FOR x IN {0}] END"


def _sums(name: str, n: int) -> str:
    return "[" + ", ".join(f"CAST(sum({name}[{k}]) AS BIGINT)" for k in range(1, n + 1)) + "]"


OP6_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN {quality.LANGUAGES} THEN lang ELSE 'other' END AS reference FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT *, [rtrim(lower(x), '{quality.PUNCTUATION}') FOR x IN words] AS plain FROM w),
windows AS (SELECT row, k, array_to_string(words[k : k + 4], ' ') AS s FROM (SELECT row, words, unnest(range(1, len(words) - 3)) AS k FROM w)),
twice AS (SELECT row, k FROM (SELECT row, k, count(*) OVER (PARTITION BY row, s) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT row, count(DISTINCT k + o) AS n FROM twice, range(5) AS t(o) GROUP BY row),
h AS (
  SELECT row, doc_id, reference, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, length(t) AS n, [{_CHARS}] AS c, [{_COMMON}] AS v
  FROM p LEFT JOIN repeats USING (row)),
f AS (
  SELECT row, doc_id, reference, n_words, n_repeat_words, n_dup_lines, list_append(c, n - list_sum(c))::BIGINT[] AS chars, list_append(v, n_words - list_sum(v))::BIGINT[] AS common FROM h),
g AS (SELECT *, {_WEIGHED.format("chars")} AS own_chars, {_WEIGHED.format("common")} AS own_common FROM f),
r AS (SELECT reference, {_sums("own_chars", len(quality.CHARACTER_CLASSES) + 1)} AS all_chars, {_sums("own_common", len(quality.VOCABULARY) + 1)} AS all_common FROM g GROUP BY reference),
o AS (SELECT *, [all_chars[k] - own_chars[k] FOR k IN range(1, len(chars) + 1)] AS other_chars, [all_common[k] - own_common[k] FOR k IN range(1, len(common) + 1)] AS other_common FROM g JOIN r USING (reference)),
m AS (
  SELECT doc_id, n_words, CAST(list_sum(chars) - chars[3] AS BIGINT) AS word_chars, chars[6] AS n_symbols, n_dup_lines, n_repeat_words,
         n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
         {_divergence("chars", "other_chars")} AS a, {_divergence("common", "other_common")} AS b FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ((word_chars >= {quality.MIN_CHARS} AND a > {quality.MAX_CHAR_DISTANCE})
         OR (n_words >= {quality.MIN_COMMON_WORDS} AND (a + b > {quality.MAX_BOTH_DISTANCES} OR b > {quality.WORD_MARGIN} + {quality.WORD_NOISE} / sqrt(greatest(n_words, 1))))) AS kept,
       round(a, 6) AS char_distance, round(b, 6) AS word_distance
FROM m
"""


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract(table(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_crf.scan(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


_TEMPLATES = ", ".join(f"({k}, {_quoted(n)}, {_quoted(t)})" for k, (n, t) in enumerate(licenses.TEMPLATES))


def _normal(text: str) -> str:
    """The words of a text as templates are compared."""
    return f"regexp_extract_all(translate({text}, {_quoted(licenses._FROM)}, '{licenses._TO}'), '[^\\x20\\x09-\\x0D]+')"


OP9_SQL = rf"""
WITH t AS (SELECT k AS template, n AS license, {_normal("x")} AS words FROM (VALUES {_TEMPLATES}) AS v(k, n, x)),
ts AS (SELECT DISTINCT template, license, array_to_string(words[i + 1 : i + {licenses.SHINGLE}], ' ') AS s FROM (SELECT *, unnest(range(len(words) - {licenses.SHINGLE - 1})) AS i FROM t)),
sizes AS (SELECT template, count(*) AS n FROM ts GROUP BY template),
d AS (SELECT row_number() OVER () AS row, doc_id, {_normal("coalesce(text, '')")} AS words FROM documents),
ds AS (SELECT row, doc_id, i, array_to_string(words[i + 1 : i + {licenses.SHINGLE}], ' ') AS s FROM (SELECT *, unnest(range(len(words) - {licenses.SHINGLE - 1})) AS i FROM d)),
m AS (SELECT row, doc_id, license, template, count(DISTINCT s) / any_value(n)::DOUBLE AS containment, min(i) AS first_word FROM ds JOIN ts USING (s) JOIN sizes USING (template) GROUP BY ALL)
SELECT doc_id, license, containment, template, first_word FROM (
  SELECT *, row_number() OVER (PARTITION BY row, license ORDER BY containment DESC, template) AS pos FROM m WHERE containment >= {licenses.CONTAINMENT}) WHERE pos = 1
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_pack_sequences,
        op3_simhash_near_dedup,
        op4_ogg_media,
        op5_url_filter,
        op6_quality_rules,
        op7_html_extraction,
        op8_secret_scan,
        op9_license_scan,
        op10_toxicity,
    )
}
SQL = {"op1_mix_sources": OP1_SQL, "op6_quality_rules": OP6_SQL, "op9_license_scan": OP9_SQL}
