"""The queries of this folder, and the SQL that some of them are checked with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspan.llm import (
    bpe, chat, decontam, langid, line_dedup, ngram_join, pieces, pii, quality, substring_dedup, trie, warc, whitening,
)
from linkspan.llm.common import read
from linkspan.sources.scratch import fresh_path, settle

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECE_MODEL = "piece_bpe_32k.model"


def bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    tokens = bpe.encode(read(spark, sf_dir, "documents"), vocabulary, decoded=True, keep=["doc_id"])
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def held_out():
    """Documents that no language model here learns from; a null doc_id counts as empty."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.learn(docs.where(~held_out()))
    own = docs.select("doc_id", held_out().alias("held_out"), "text")
    return langid.identify(own, model).select("doc_id", "held_out", "lang_pred", "score")


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id", "lines", "kept_lines", "removed_chunks",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


LINE_CHUNKS_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), h AS (
  SELECT *, CAST(concat('0x', substr(md5(line), 1, 8)) AS BIGINT) AS own,
         row_number() OVER (PARTITION BY doc_id ORDER BY i) AS w, count(*) OVER (PARTITION BY doc_id) AS n
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), r AS (
  SELECT *, (31 * lag(own, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) + own) % 4294967296 AS rolled FROM h
), v AS (
  SELECT r.*, factor, rolled * factor % 4294967296 AS v
  FROM r, (SELECT unnest([1, 40503, 1103515245, 69069, 1664525]) AS factor)
), e AS (
  SELECT *, w > 1 AND w < n - 1 AND v < lag(v) OVER own_way AND v <= lead(v) OVER own_way AS ends
  FROM v WINDOW own_way AS (PARTITION BY doc_id, factor ORDER BY i)
), s AS (
  SELECT *, coalesce(sum(CAST(ends AS INTEGER)) OVER (
    PARTITION BY doc_id, factor ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seq FROM e
), c AS (
  SELECT DISTINCT doc_id, min(i) AS first, max(i) AS last FROM s GROUP BY doc_id, factor, seq HAVING count(*) > 1
), b AS (
  SELECT doc_id, first, last, array_to_string(lines[first:last], chr(10)) AS body
  FROM c JOIN (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) USING (doc_id)
), gone AS (
  SELECT doc_id, first, last FROM (
    SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS place FROM b
  ) WHERE place > 1
), cut AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM gone
), kept AS (
  SELECT l.doc_id, count(*) AS kept_lines, string_agg(line, chr(10) ORDER BY i) AS body
  FROM l ANTI JOIN cut ON l.doc_id = cut.doc_id AND l.i = cut.i GROUP BY 1
), m AS (
  SELECT doc_id, count(*) AS removed_chunks FROM gone GROUP BY 1
), t AS (
  SELECT doc_id, count(*) AS lines FROM l GROUP BY 1
)
SELECT t.doc_id, lines, coalesce(kept_lines, 0) AS kept_lines, coalesce(removed_chunks, 0) AS removed_chunks,
       sha256(coalesce(body, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each span of repeated units, whether it stays or goes; documents without one don't occur."""
    found = substring_dedup.repeated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return substring_dedup.spans(found).select(
        "doc_id", F.col("start").cast("long").alias("start_char"), F.col("end").cast("long").alias("end_char"), "n_units",
        "n_words", "gone_units", "gone_words", "first_doc_id", F.col("first_start").cast("long").alias("first_start"),
    )


REPEATED_SPANS_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?\n]*|[.!?\n]+') AS parts FROM documents)
), p AS (
  SELECT *, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) - length(part) AS start_char,
         regexp_extract_all(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w FROM l
), n AS (
  SELECT doc_id, start_char, start_char + length(part) AS end_char, w,
         row_number() OVER (PARTITION BY doc_id ORDER BY i) AS unit FROM p WHERE len(w) > 0
), u AS (
  SELECT *, row_number() OVER same AS place, count(*) OVER (PARTITION BY w) AS copies,
         first_value(doc_id) OVER same AS first_doc_id, first_value(start_char) OVER same AS first_start
  FROM n WINDOW same AS (PARTITION BY w ORDER BY doc_id, start_char)
), r AS (
  SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM u WHERE copies > 1
)
SELECT doc_id, CAST(min(start_char) AS BIGINT) AS start_char, CAST(max(end_char) AS BIGINT) AS end_char, count(*) AS n_units,
       CAST(sum(len(w)) AS BIGINT) AS n_words, count(*) FILTER (place > 1) AS gone_units,
       CAST(coalesce(sum(len(w)) FILTER (place > 1), 0) AS BIGINT) AS gone_words,
       arg_min(first_doc_id, unit) AS first_doc_id, CAST(arg_min(first_start, unit) AS BIGINT) AS first_start
FROM r GROUP BY doc_id, run HAVING sum(len(w)) >= 25
"""


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    stats = settle(quality.measure(docs).drop("text"), "quality")
    forest = quality.fit(stats, read(spark, sf_dir, "labels"))
    return quality.judge(stats, forest).select(
        "doc_id", *quality.COUNTS, "base_failed", "kept", "score"
    )


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


JACCARD_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""


def warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    files = warc.write(warc.plan(read(spark, sf_dir, "pages")), folder)
    return warc.read_archives(spark, folder, files).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p
), k AS (
  SELECT payload_digest, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM d LEFT JOIN k ON d.payload_digest = k.payload_digest AND payload_bytes >= 1000
"""


def chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string"
    )
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    shown = chat.windows(settle(chat.numbered(rows, chat.counted_tokens(vocabulary)), "turns"))
    return chat.read_back(shown).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


def _is_kind(kind: str):
    return lambda m: m["kind"] == kind


def sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.findings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "row.doc_id",
        *(F.size(F.filter("base", _is_kind(kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS[:4]),
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("all")).alias("spans"),
        F.size(F.filter("all", lambda m: m["kind"] == "term")).cast("long").alias("n_term"),
    )


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, read(spark, sf_dir, "benchmark"))
    return decontam.marked(docs, settle(found, "found")).select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size,
         array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS said
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS said
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
), h AS (
  SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.said = bw.said
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY 1
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def piece_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.Model(spark, public_tokenizers.path(PIECE_MODEL))
    tokens = pieces.encode(read(spark, sf_dir, "documents"), model, decoded=True, keep=["doc_id"])
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(trie.rebuilt(read(spark, sf_dir, "conversations")))


TRIE_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(concat(length(coalesce(role, '')), ':', role, text))) - 1 AS n
  FROM conversations WHERE conv_id IS NOT NULL
), g AS (
  SELECT list(e ORDER BY i) AS remainders FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS e
    FROM (SELECT unnest(range(256)) AS i))
), c AS (
  SELECT conv_id, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
           lambda a, b: xor(a >> 8, remainders[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t), g
), s AS (
  SELECT c.conv_id, 0 AS part, n, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND n < h
  UNION ALL SELECT c.conv_id, 1, n, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE n >= h
), p AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, n) AS d,
         md5(concat(length(role), ':', role, text)) AS e, len(regexp_extract_all(text, '[^ 	-
]+')) AS words
  FROM s
), k AS (
  SELECT conv_id, d, words, string_agg(e, '') OVER (PARTITION BY conv_id ORDER BY d) AS k,
         count(*) OVER (PARTITION BY conv_id) AS size FROM p
  UNION ALL SELECT c.conv_id, 0, 0, '', (SELECT count(*) FROM p WHERE p.conv_id = c.conv_id) FROM c
), m AS (
  SELECT k, max(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '') AS ends
  FROM k GROUP BY 1
), a AS (
  SELECT m.*, parent.conv_id AS parent_conv_id,
         (SELECT count(*) FROM m x WHERE x.depth = m.depth + 1 AND left(x.k, length(m.k)) = m.k) AS n_children
  FROM m LEFT JOIN m parent ON m.depth = parent.depth + 1 AND parent.k = left(m.k, greatest(length(m.k) - 32, 0))
), b AS (
  SELECT k.k, sum(CASE WHEN a.conv_id = k.conv_id AND n_children = 0 THEN 1 ELSE 0 END) OVER up AS leaves,
         sum(CASE WHEN a.conv_id = k.conv_id THEN (n_convs - 1) * a.words ELSE 0 END) OVER up AS saved
  FROM k JOIN a USING (k) WINDOW up AS (PARTITION BY k.conv_id ORDER BY d DESC)
), n AS (
  SELECT k, sum(leaves) AS n_leaves, sum(saved) AS saved_tokens FROM b GROUP BY 1
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM a JOIN n USING (k)
"""


def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_language_id": language,
    "op2_line_dedup": line_chunks,
    "op3_substring_dedup": repeated_spans,
    "op4_quality_rules": quality_rules,
    "op5_byte_bpe": bpe_roundtrip,
    "op6_sanitisation": sanitisation,
    "op7_decontamination": decontamination,
    "op8_jaccard_join": jaccard_join,
    "op9_warc": warc_roundtrip,
    "op10_chat_windows": chat_windows,
    "op11_whitening": embedding_whitening,
    "op12_prefix_trie": conversation_trie,
    "op13_sentencepiece": piece_roundtrip,
}

CHECKS: dict[str, str] = {
    "op2_line_dedup": LINE_CHUNKS_SQL,
    "op3_substring_dedup": REPEATED_SPANS_SQL,
    "op7_decontamination": DECONTAMINATION_SQL,
    "op8_jaccard_join": JACCARD_SQL,
    "op9_warc": WARC_SQL,
    "op12_prefix_trie": TRIE_SQL,
}
