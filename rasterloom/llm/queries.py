"""The registered queries opN_<name> of this subpackage and their SQL, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import hmm, html_extract, language_id, line_dedup, media, mixing, packing, simhash, token_files, topk
from rasterloom.session import materialize, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.group(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print("fp").alias("fingerprint"), "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "n_lines", "n_deleted")


#: The same rule, read off the lines themselves: of each line the shortest runs on and back with 20 words, as text.
OP2_SQL = r"""
WITH split AS (
  SELECT doc_id, text,
         string_split(regexp_replace(text, '\n([\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])', chr(57344) || '\1', 'g'), chr(57344)) AS units
  FROM documents),
listed AS (
  SELECT doc_id, list_transform(units, lambda u: rtrim(u, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS lines,
         list_transform(units, lambda u: len(regexp_extract_all(u, '[^\x20\x09-\x0D]+'))) AS w
  FROM split),
summed AS (SELECT *, list_transform(range(1, len(w) + 1), lambda i: list_sum(w[1:i])) AS up FROM listed),
l AS (SELECT doc_id, lines, w, up, unnest(range(1, len(w) + 1)) AS i FROM summed),
spans AS (
  SELECT doc_id, lines, i AS a, CAST(len(list_filter(up, lambda x: x - up[i] + w[i] < 20)) + 1 AS BIGINT) AS b FROM l WHERE w[i] > 0
  UNION ALL
  SELECT doc_id, lines, CAST(len(list_filter(up, lambda x: up[i] - x >= 20)) + 1 AS BIGINT) AS a, i AS b FROM l WHERE up[i] >= 20),
r AS (
  SELECT DISTINCT doc_id, a, b, array_to_string(lines[a:b], chr(10)) AS run FROM spans WHERE b <= len(lines)),
o AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY b - a, run ORDER BY doc_id, a) AS k FROM r),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(a, b)) AS i FROM o WHERE k > 1),
lost AS (SELECT doc_id, list(i) AS cut, count(*) AS n FROM gone GROUP BY doc_id)
SELECT split.doc_id,
       CASE WHEN cut IS NULL THEN text
            ELSE array_to_string(list_filter(units, lambda u, i: NOT list_contains(cut, i)), chr(10)) END AS text,
       CAST(coalesce(len(units), 0) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_deleted
FROM split LEFT JOIN lost USING (doc_id)
"""


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_files.write_tokens(table(spark, sf_dir, "documents"))
    documents, firsts = token_files.read_shards(shards)
    digest = documents.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return token_files.with_starts(digest, firsts).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = language_id.sample(docs, language_id.training_rows())
    rows = docs.select("doc_id", (~language_id.training_rows()).alias("held_out"), "text")
    return language_id.identify(rows, learned).select("doc_id", "held_out", "lang_pred", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut(table(spark, sf_dir, "documents"))
    digest = materialize(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pack-digests")
    return packing.place(digest).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, pieces = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken(rows, pieces).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS src
  FROM sized GROUP BY source),
wt AS (SELECT *, 1 + (src - 1) % 3 AS weight FROM src),
lvl AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER p, 0) AS room,
         sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS wleft
  FROM wt
  WINDOW p AS (ORDER BY source_size / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cap AS (SELECT *, room * weight > 3 * source_size * wleft AS capped FROM lvl),
free AS (SELECT room, wleft FROM cap WHERE NOT capped ORDER BY source_size / weight, src LIMIT 1),
tgt AS (
  SELECT cap.source, cap.source_size,
         CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
              ELSE least(CAST(free.room * weight AS DOUBLE) / free.wleft, CAST(3 * source_size AS DOUBLE)) END AS target
  FROM cap LEFT JOIN free ON true),
pos AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS quota,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id ROWS UNBOUNDED PRECEDING) - s.size AS head
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
                 ELSE (quota // source_size) * size + greatest(0, least(size, quota % source_size - head)) END AS BIGINT) AS taken
FROM pos
"""


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.to_media(table(spark, sf_dir, "documents")))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk(table(spark, sf_dir, "embeddings"), lambda vec_id: F.pmod(vec_id, F.lit(50)) == 0)


OP9_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

def op10_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_files": op3_token_files,
    "op4_language_id": op4_language_id,
    "op5_packing": op5_packing,
    "op6_html_text": op6_html_text,
    "op7_mixing": op7_mixing,
    "op8_media": op8_media,
    "op9_topk": op9_topk,
    "op10_hmm_lm": op10_hmm_lm,
}
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op7_mixing": OP7_SQL, "op9_topk": OP9_SQL}
