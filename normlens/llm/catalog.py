"""Queries of the text operators, one for each, over their whole tables."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable
from functools import partial, reduce
from hashlib import sha256

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlens.llm import (
    byte_bpe, decontaminate, fim, language_id, license_scan, quality_cnn, quality_rules, source_divergence, token_file,
    toxicity, warc)
from normlens.llm.frames import map_batches, texts_of
from normlens.llm.simhash import near_duplicates
from normlens.llm.substring_dedup import remove_repeated
from normlens.plans.relational import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return read.select(*columns) if columns else read


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document, and whether it is toxic."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.grade(documents(spark, sf_dir), labels).select("doc_id", "severity", "is_toxic")


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to packed files in doc_id order, and read back."""
    folder = token_file.new_folder(spark)
    encoder = partial(token_file.word_encoder, public_tokenizers.path("word_bpe_49k.json"))
    token_file.write(documents(spark, sf_dir), encoder, folder, end_id=2)

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("ids").to_pylist()
        return pa.record_batch([batch.column("doc_id"), batch.column("start"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                                pa.array([zlib.crc32(x) for x in ids], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return map_batches(token_file.read(spark, folder), digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the bytes they decode to, as digests."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.round_trip(documents(spark, sf_dir), path, pattern, remembered=400_000)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a byte convolutional network."""
    return language_id.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak benchmark items; clean documents have no row."""
    leaks = decontaminate.find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return leaks.select("doc_id", "item_id", "cosine", "lcs", "answer_lcs")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts whose 3-word SimHash fingerprints are linked at 3 bits."""
    return near_duplicates(documents(spark, sf_dir), size=3, radius=3).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed under repeated 35-word windows, and the hash of what is kept."""
    cut = remove_repeated(documents(spark, sf_dir), width=35)

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = [sha256(b" ".join(t.split())).hexdigest() for t in texts_of(batch.column("text"))]
        return pa.record_batch([batch.column(c) for c in ("doc_id", "n_words", "n_removed")] + [pa.array(kept, pa.string())],
                               names=["doc_id", "n_words", "n_removed", "kept_sha256"])
    return map_batches(cut, digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failed rules and the current policy's verdict of every document."""
    rules = quality_rules
    return rules.ledger(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rules.fails(rules.BASE).alias("base_failed"), (~rules.fails(rules.CURRENT)).alias("kept"), "failed")


def ledger_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each policy's rules by what they drop, from the stored bits of a ledger that was written once."""
    rules, folder = quality_rules, f"{shared_folder(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    rules.ledger(documents(spark, sf_dir)).write.parquet(folder)
    stored = spark.read.parquet(folder)
    return reduce(DataFrame.unionByName, [rules.ablations(stored, p).select(F.lit(p).alias("policy"), "*") for p in rules.POLICIES])


def op10_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a byte-level convolutional network."""
    return quality_cnn.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of every document, and the text rebuilt from it, as digests."""
    made = fim.restore(fim.transform(documents(spark, sf_dir), seed=1).drop("text"))
    return made.select("doc_id", F.col("n_units").alias("n"), "form", F.col("prefix_units").alias("prefix_chars"),
                       F.col("middle_units").alias("middle_chars"), F.sha2("fim", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and the terms that set it apart."""
    return source_divergence.audit(table(spark, sf_dir, "documents", "text", "lang", "source"), least_docs=10, top=10)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record type and payload of every page, read back from its content-addressed archive."""
    folder = warc.new_folder(spark)
    warc.write(table(spark, sf_dir, "pages", "page_id", "url", "html"), folder, least_bytes=0)
    return warc.read(spark, folder).drop("target")


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_file": op2_token_file,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_license_scan": op4_license_scan,
    "op5_language_id": op5_language_id,
    "op6_decontaminate": op6_decontaminate,
    "op7_simhash": op7_simhash,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_rules": op9_quality_rules,
    "ledger_ablations": ledger_ablations,
    "op10_quality_cnn": op10_quality_cnn,
    "op11_fim": op11_fim,
    "op12_source_divergence": op12_source_divergence,
    "op13_warc": op13_warc,
}

WINDOWS_35 = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM words WHERE len(w) >= 35),
windows AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 34], ' ')) AS h FROM starts),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS i FROM windows SEMI JOIN again USING (h)),
lost AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT coalesce(list_contains(gone, i), false)), ' '), ''))
    AS kept_sha256
FROM words LEFT JOIN lost USING (doc_id)
"""

RULES_SQL = """
WITH words AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 7], ' ') AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS s FROM words WHERE len(w) >= 8)),
again AS (SELECT doc_id, h FROM windows GROUP BY doc_id, h HAVING count(*) > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(s, s + 8)) AS i FROM windows SEMI JOIN again USING (doc_id, h))
  GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines
  FROM words LEFT JOIN repeats USING (doc_id)),
bits AS (
  SELECT *, ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (2 * n_symbols > n_words)::BIGINT
    + 8 * (n_lines >= 4 AND 2 * n_dup_lines > n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT
    + 32 * (word_chars > 25 * n_words)::BIGINT) AS failed
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed
FROM bits
"""

ABLATIONS_SQL = f"""
WITH ledger AS ({RULES_SQL}),
policies(policy, mask) AS (VALUES {", ".join(f"('{p}', {quality_rules.mask(p)})" for p in quality_rules.POLICIES)}),
rules(rule, bit) AS (VALUES {", ".join(f"('{r}', {b})" for r, b in quality_rules.BIT.items())})
SELECT policy, rule, count(*) FILTER (WHERE failed & bit <> 0) AS n_failed, count(*) FILTER (WHERE failed & mask = bit) AS n_alone
FROM policies JOIN rules ON mask & bit <> 0, ledger GROUP BY policy, rule
"""

FIM_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
    list_transform([1, 9, 17, 25], lambda i: ('0x' || sha256('1:' || coalesce(doc_id::VARCHAR, ''))[i:i + 7])::BIGINT) AS h
  FROM documents),
cuts AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS p, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS q,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
         WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, substring(t, 1, p) AS a, substring(t, p + 1, q - p) AS m, substring(t, q + 1) AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

DIVERGENCE_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(
    translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs),
kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
langs AS (
  SELECT lang, count(term)::HUGEINT AS v, coalesce(sum(n), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang),
counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (
  SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c, 0) + 2) // (g.n + 2 * l.v) AS p,
    1 + 1000000000::HUGEINT * (k.n + 2) // (l.n + 2 * l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts USING (lang, source, term)),
priced AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN priced p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shares WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
  FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

WARC_SQL = """
WITH raw AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
hashed AS (
  SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS last FROM raw),
bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41),
    lambda i: lpad(bin((instr('0123456789abcdef', h[i]) - 1)::UTINYINT), 4, '0')), '') AS b2
  FROM hashed)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    list_sum(list_transform(range(1, 6), lambda j: b2[5 * k + j]::INT * (1 << (5 - j))))::INT + 1]), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM bits
"""

ORACLES: dict[str, str] = {
    "op8_substring_dedup": WINDOWS_35,
    "op9_quality_rules": RULES_SQL,
    "ledger_ablations": ABLATIONS_SQL,
    "op11_fim": FIM_SQL,
    "op12_source_divergence": DIVERGENCE_SQL,
    "op13_warc": WARC_SQL,
}
