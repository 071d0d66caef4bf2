"""The operators of this subpackage as queries over whole tables, and their SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.llm.bpe import encode_documents
from gatewright.llm.common import table
from gatewright.llm.exact_dedup import exact_groups
from gatewright.llm.line_dedup import line_dedup
from gatewright.llm.mixing import mix_sources
from gatewright.llm.packing import pack_documents
from gatewright.llm.periodic import periodic_runs
from gatewright.llm.phrases import fingerprint_documents
from gatewright.llm.pii import find_pii
from gatewright.llm.quality import fit_quality, learns_from, score_quality
from gatewright.llm.repeats import remove_repeats
from gatewright.llm.simhash import near_components
from gatewright.llm.substring_dedup import substring_dedup
from gatewright.llm.whitening import fit_whitening, whiten

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keys AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keys WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, c.keeper IS NOT NULL AND k.doc_id < c.keeper AS gone
  FROM keys k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), ranked AS (
  SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256
  FROM bare
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, with_ids=False)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), with_ids=False)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"), by_text=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"), ["doc_id"], with_text=False)
    return found.select("row.doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


#: Scores below it are rejected.
QUALITY_BOUND = 0.3


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model).select("row.doc_id", (~learns_from("row.doc_id")).alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_BOUND).cast("int"))


def op8_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"), with_text=False)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False)


#: Every string of 400 bytes by its MD5; slow (a row a byte), but a check on whole small tables.
OP10_SQL = r"""
WITH texts AS (
  SELECT doc_id, encode(coalesce(text, '')) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents
), starts AS (
  SELECT doc_id, i, md5_number(h[i + 1 : i + 400]) AS w FROM (SELECT doc_id, h, unnest(range(n_bytes - 399)) AS i FROM texts WHERE n_bytes >= 400)
), twice AS (
  SELECT doc_id, i FROM starts WHERE w IN (SELECT w FROM starts GROUP BY w HAVING count(*) > 1)
), spans AS (
  SELECT doc_id, i, i - coalesce(lag(i) OVER o, -1000) > 400 AS opens, least(coalesce(lead(i) OVER o, i + 400) - i, 400) AS fresh FROM twice WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), removed AS (
  SELECT doc_id, sum(fresh)::BIGINT AS n_removed, count(*) FILTER (WHERE opens)::BIGINT AS n_spans FROM spans GROUP BY doc_id
), runs AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM (SELECT doc_id, i, sum(opens::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM spans) GROUP BY ALL
), gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER o, 0) AS a, a AS b FROM runs WINDOW o AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT r.doc_id, max(b), any_value(n_bytes) FROM runs r JOIN texts t ON t.doc_id = r.doc_id GROUP BY r.doc_id
), kept AS (
  SELECT g.doc_id, string_agg(hex(h[a + 1 : b]), '' ORDER BY a) AS h FROM gaps g JOIN texts t ON t.doc_id = g.doc_id GROUP BY g.doc_id
)
SELECT t.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(unhex(k.h), t.h)) AS kept_sha256
FROM texts t LEFT JOIN removed r ON r.doc_id = t.doc_id LEFT JOIN kept k ON k.doc_id = t.doc_id
"""


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), tails=True, with_text=False)


#: Pairs of equal six-word strings in a text, by their distance: consecutive ones are a stretch in which words that far apart agree.
OP11_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, z: xor(b >> 1, CASE WHEN b & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT) AS h
  FROM documents
), placed AS (SELECT *, len(w) AS n, (h // 10) % nullif(len(w), 0) AS a FROM split
), texts AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END) ELSE w END AS w FROM placed
), grams AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 6], ' ') AS g FROM (SELECT doc_id, w, unnest(range(n - 5)) AS i FROM texts WHERE n >= 12)
), pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON y.doc_id = x.doc_id AND y.g = x.g AND y.i > x.i
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island
), runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length
), told AS (
  SELECT doc_id, count(*) AS n_runs, arg_min({'start': start, 'length': length, 'period': period}, (-length, start, period)) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.i) AS left_ FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM texts) t ANTI JOIN gone g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY t.doc_id
)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period, (1000 * best.length // best.period)::BIGINT AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(left_, '')) AS collapsed_sha256
FROM texts t LEFT JOIN told r ON r.doc_id = t.doc_id LEFT JOIN kept k ON k.doc_id = t.doc_id
"""


#: Weights of documents by the label of their quality; those without a label weigh 1.
GOOD, BAD = 2.0, 0.25


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", F.when(F.col("quality") == 1, GOOD).otherwise(BAD).alias("weight"))
    return mix_sources(table(spark, sf_dir, "documents"), quality).select("doc_id", "size", "source_size", "target", "taken")


#: Sizes and targets by the sources' ranks, then all documents in the order of their keys, summed up one by one.
OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR || ':' || coalesce(text, '')) AS drawn FROM documents
), sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), ranked AS (
  SELECT *, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS bound FROM sizes
), laid AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(bound) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level, row_number() OVER (ORDER BY bound / w, source NULLS LAST) AS i
  FROM ranked WINDOW o AS (ORDER BY bound / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), free AS (SELECT arg_min(level, i) FILTER (WHERE level * w <= bound) AS level FROM laid
), targets AS (SELECT source, source_size, CASE WHEN f.level IS NULL THEN bound ELSE least(bound, f.level * w) END AS target FROM laid, free f
), shares AS (
  SELECT *, floor(target)::BIGINT - epochs * source_size AS rest
  FROM (SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size)) ELSE 0 END::BIGINT AS epochs FROM targets)
), weights AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 2.0 ELSE 0.25 END)::DOUBLE AS weight FROM labels WHERE quality IS NOT NULL GROUP BY doc_id
), keyed AS (
  SELECT d.*, -ln((('0x' || substr(drawn, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / coalesce(weight, 1.0::DOUBLE) AS key FROM docs d LEFT JOIN weights w ON w.doc_id = d.doc_id
), summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, drawn ROWS UNBOUNDED PRECEDING) - size AS before FROM keyed
)
SELECT doc_id, size, source_size, target, (epochs * size + least(greatest(rest - before, 0), size))::BIGINT AS taken
FROM summed k JOIN shares s ON s.source IS NOT DISTINCT FROM k.source
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whiten(vectors, fit_whitening(vectors)).withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_bpe": op2_bpe,
    "op3_packing": op3_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_phrases": op8_phrases,
    "op9_simhash": op9_simhash,
    "op10_repeats": op10_repeats,
    "op11_periodic": op11_periodic,
    "op12_mixing": op12_mixing,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op10_repeats": OP10_SQL,
    "op11_periodic": OP11_SQL,
    "op12_mixing": OP12_SQL,
}
