"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dart_minhash, exact_dedup, line_dedup, mixing, ngram_lm, packing, quality, suffix_array_dedup, suffix_tree_dedup, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_tree_dedup.drop_repeated_words(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_pages(warc.pages_to_warc(_table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_array_dedup.drop_repeated_bytes(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).drop("text_key")


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_key")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"), rules=line_dedup.LineRules(least_words=1))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(_table(spark, sf_dir, "documents"), rules=ngram_lm.LmRules(singletons=True))


def queries() -> dict[str, Query]:
    return {
        "op1_suffix_tree_dedup": op1_suffix_tree_dedup,
        "op2_arc_to_warc": op2_arc_to_warc,
        "op4_suffix_array_dedup": op4_suffix_array_dedup,
        "op3_packing": op3_packing,
        "op8_dart_minhash": op8_dart_minhash,
        "op10_line_dedup": op10_line_dedup,
        "op5_ngram_lm": op5_ngram_lm,
        "op9_quality_rules": op9_quality_rules,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_mix_sources": op7_mix_sources,
    }


SQL_OP6 = r"""
WITH rows AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256,
         length(coalesce(text, '')) AS n
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER by_size AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       first_value(doc_id) OVER by_size = doc_id AS kept, text_sha256
FROM rows
WINDOW by_size AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

SQL_OP7 = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM rows GROUP BY source),
filled AS (
  SELECT *, row_number() OVER by_cap AS nth,
         1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
           - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM sources WINDOW by_cap AS (ORDER BY cap / w, source NULLS LAST)),
level AS (SELECT min(nth) AS nth, arg_min(room, nth) AS room, arg_min(rest, nth) AS rest FROM filled WHERE room * w < cap * rest),
targets AS (
  SELECT f.source, f.source_size, CASE WHEN l.nth IS NULL OR f.nth < l.nth THEN f.cap ELSE f.w * l.room / l.rest END AS target
  FROM filled f CROSS JOIN level l),
placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size ROWS UNBOUNDED PRECEDING)::BIGINT - r.size AS before
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END) * size
         + least(size, greatest(0, budget - (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END) * source_size - before)) AS taken
FROM placed
"""


SQL_OP2 = """
WITH rows AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
last AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM rows)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM last
"""

#: Words of a document, windows of 13 by the words that follow, and the words covered by a window that a smaller document has.
SQL_OP1 = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
word AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM docs),
windows AS (
  SELECT doc_id, i, string_agg(w, ' ') OVER following AS key, count(*) OVER following AS n FROM word
  WINDOW following AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
judged AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY md5(key)) < doc_id AS hit FROM windows WHERE n = 13),
covered AS (
  SELECT w.doc_id, w.i, w.w,
         coalesce(bool_or(j.hit) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone
  FROM word w LEFT JOIN judged j USING (doc_id, i)),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS text FROM covered GROUP BY doc_id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""


#: Lines, those equal to an earlier one, and of the others with ten words at least those of which a variant without one word shows an earlier one that is near.
SQL_OP10 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS no FROM docs),
worded AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM line),
ranked AS (SELECT *, array_to_string(words, ' ') AS key, rank() OVER (ORDER BY doc_id NULLS LAST, no) AS pos FROM worded WHERE len(words) > 0),
first AS (SELECT key, any_value(words) AS words, min(pos) AS pos FROM ranked GROUP BY key),
place AS (
  SELECT key, pos, 0 AS p, md5(key) AS v FROM first WHERE len(words) >= 10
  UNION ALL
  SELECT key, pos, i AS p, md5(array_to_string(list_concat(words[:i - 1], words[i + 1:]), ' ')) FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM first WHERE len(words) >= 10)),
seen AS (
  SELECT *, min(pos) FILTER (p = 0) OVER of_v AS itself, min(pos) FILTER (p > 0) OVER of_v AS less, min(pos) OVER (PARTITION BY v, p) AS alike
  FROM place WINDOW of_v AS (PARTITION BY v)),
near AS (SELECT DISTINCT key FROM seen WHERE CASE WHEN p = 0 THEN less < pos ELSE least(coalesce(itself, pos), alike) < pos END),
judged AS (SELECT w.r, w.no, coalesce(w.pos > f.pos OR f.key IN (SELECT key FROM near), false) AS gone FROM ranked w JOIN first f USING (key)),
kept AS (
  SELECT l.r, count(j.r) AS n_lines, count(*) FILTER (j.gone) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.no) FILTER (NOT coalesce(j.gone, false)) AS text
  FROM line l LEFT JOIN judged j USING (r, no) GROUP BY l.r)
SELECT doc_id, n_lines, n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM docs JOIN kept USING (r)
"""

#: Bytes as pairs of hexadecimal digits, strings of 50 by the bytes that follow, and the bytes covered by a string that a smaller document has.
SQL_OP4 = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes FROM documents),
byte AS (SELECT doc_id, unnest(bytes) AS b, unnest(range(len(bytes))) AS i FROM docs),
strings AS (
  SELECT doc_id, i, string_agg(b, '') OVER following AS key, count(*) OVER following AS n FROM byte
  WINDOW following AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
judged AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY key) < doc_id AS hit FROM strings WHERE n = 50),
covered AS (
  SELECT b.doc_id, b.i, b.b, coalesce(bool_or(j.hit) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone
  FROM byte b LEFT JOIN judged j USING (doc_id, i)),
edged AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS edge FROM covered),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (edge) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS left_over FROM edged GROUP BY doc_id)
SELECT d.doc_id, len(d.bytes)::BIGINT AS n_bytes, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.left_over, ''))) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_tree_dedup": SQL_OP1, "op2_arc_to_warc": SQL_OP2, "op4_suffix_array_dedup": SQL_OP4, "op6_exact_dedup": SQL_OP6, "op7_mix_sources": SQL_OP7, "op10_line_dedup": SQL_OP10}
