"""The thin ``opN_*`` queries over the whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, divergence, languages, licenses, matroska, mixing, negatives, passages, sharding, simhash, tokens, vectors
from .common import merged, new_dir, table

#: The id put after each document.
END = 2


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "passes")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS n, coalesce(source, '') AS s,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
sums AS (
  SELECT n, s, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(1 + (row_number() OVER (ORDER BY n, s) - 1) % 3 AS DOUBLE) AS w
  FROM sized GROUP BY n, s),
ranked AS (SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, n, s) AS k FROM sums),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sums)
             - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
targets AS (
  SELECT n, s, source_size, least(cap, w * (SELECT arg_min(level, k) FROM levels WHERE level * w <= cap)) AS target
  FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS goal,
         CAST(coalesce(sum(size) OVER (PARTITION BY sized.n, sized.s ORDER BY h, doc_id, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c
  FROM sized JOIN targets USING (n, s)),
taken AS (
  SELECT *, greatest(0, least(size, goal - c)) AS t1, greatest(0, least(size, goal - c - source_size)) AS t2,
         greatest(0, least(size, goal - c - 2 * source_size)) AS t3
  FROM placed)
SELECT doc_id, size, source_size, target, CAST(t1 + t2 + t3 AS BIGINT) AS taken,
       CAST((t1 > 0)::INT + (t2 > 0)::INT + (t3 > 0)::INT AS INTEGER) AS passes
FROM taken
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 40)


OP2_SQL = r"""
WITH bits AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, CAST(n AS BIGINT))) AS crc_table),
bytes AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b
  FROM documents),
summed AS (
  SELECT doc_id, size, h, xor(4294967295, list_reduce(b, lambda c, x: xor(crc_table[CAST(xor(c, x) % 256 AS INTEGER) + 1], c // 256), CAST(4294967295 AS BIGINT))) AS text_crc32
  FROM bytes, bits),
jumped AS (
  SELECT *, list_reduce(
      list_concat([{'k': CAST(CAST('0x' || h[1:16] AS UBIGINT) AS HUGEINT), 'b': CAST(-1 AS BIGINT), 'j': CAST(0 AS BIGINT)}],
                  list_transform(range(40), lambda i: {'k': CAST(0 AS HUGEINT), 'b': CAST(0 AS BIGINT), 'j': CAST(0 AS BIGINT)})),
      lambda s, x: CASE WHEN s.j >= 40 THEN s ELSE {
        'k': (s.k * 2862933555777941757 + 1) % CAST(18446744073709551616 AS HUGEINT), 'b': s.j,
        'j': CAST(floor((s.j + 1) * (CAST(2147483648 AS DOUBLE) / (CAST(((s.k * 2862933555777941757 + 1) % CAST(18446744073709551616 AS HUGEINT)) // 8589934592 AS DOUBLE) + 1))) AS BIGINT)} END) AS hop
  FROM summed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(hop.b AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY hop.b ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32 || ':' || size), doc_id, text_crc32, size) - 1 AS slot, CAST(CASE WHEN hop.j = 40 THEN 40 ELSE hop.b END AS INTEGER) AS grown_shard
FROM jumped
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    read = chat.read_chats(chat.format_chats(rows.unionByName(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*(?:/?s>|/?INST\]|/?<?/?(?:SYS|ROLE|TURN)>>))', '\1\\\2', 'g')) AS chars,
         length(regexp_replace(role, '([<\[])(\\*(?:/?s>|/?INST\]|/?<?/?(?:SYS|ROLE|TURN)>>))', '\1\\\2', 'g')) AS role_chars
  FROM rows),
grouped AS (
  SELECT conv_id, count(*) AS n_turns, list(role ORDER BY turn NULLS FIRST, role, text) AS roles,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
         CAST(sum(chars + CASE role WHEN 'system' THEN 7 + 8 WHEN 'user' THEN 6 + 7 WHEN 'assistant' THEN 3 + 4 ELSE 8 + role_chars + 9 + 9 END) AS BIGINT) AS formatted_chars
  FROM marked GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars,
       list_reduce(roles, lambda s, r: CASE WHEN (s = '' AND r IN ('system', 'user')) OR (s = 'system' AND r = 'user') OR (s = 'user' AND r = 'assistant') OR (s = 'assistant' AND r = 'user') THEN r ELSE '!' END, '') = 'assistant' AS valid
FROM grouped
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", decontamination.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontamination.contaminated().alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels", "expressions")} | {"choices": F.array_join("choices", "; ")})


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary file, which every machine has; imported here, so that the other queries do without it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = tokens.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), END)
    return tokens.read_tokens(spark, written)


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.copied_passages(table(spark, sf_dir, "documents"))


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = new_dir(spark, "media")
    matroska.store_media(merged(table(spark, sf_dir, "documents"))).write.parquet(stored, compression="zstd")
    found = matroska.media_digest(merged(spark.read.parquet(stored)))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def op10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = languages.identify(docs, languages.fit(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op11_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


OP11_SQL = r"""
WITH RECURSIVE rows AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
         coalesce(embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                  AND len(list_filter(embedding, lambda x: x != 0)) > 0, false) AS fine
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM rows a JOIN rows b ON a.vec_id != b.vec_id AND a.fine AND b.fine
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reached AS (
  SELECT vec_id AS a, vec_id AS b FROM rows
  UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a)
SELECT r.vec_id, (SELECT count(*) FROM links WHERE a = r.vec_id) AS n_links, least_id AS component_id, r.vec_id = least_id AS kept
FROM rows r JOIN (SELECT a, min(b) AS least_id FROM reached GROUP BY a) ON a = r.vec_id
"""


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return negatives.hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


OP12_SQL = r"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id != b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
counts AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT d) AS docs
  FROM (SELECT lang, source, d, unnest(terms) AS term FROM (SELECT *, row_number() OVER () AS d FROM docs)) GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS lang_n FROM counts GROUP BY ALL HAVING sum(docs) >= 30),
sizes AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang),
every AS (SELECT DISTINCT lang, source FROM docs),
filled AS (
  SELECT e.lang, e.source, k.term, coalesce(c.n, 0) AS n, k.lang_n FROM every e JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
priced AS (
  SELECT f.*, 1 + (1000000000 * (n + 5)::HUGEINT) // (sum(n) OVER (PARTITION BY f.lang, f.source) + 5 * v) AS p,
         1 + (1000000000 * (lang_n + 5)::HUGEINT) // (total + 5 * v) AS q
  FROM filled f JOIN sizes USING (lang)),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce(d.value, 0) AS value
  FROM every a JOIN every b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS o, sum(abs(x.p - y.p)) AS value
             FROM priced x JOIN priced y ON x.lang = y.lang AND x.term = y.term AND x.source != y.source GROUP BY ALL) d
    ON d.lang = a.lang AND d.s = a.source AND d.o = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM priced WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 50
"""


QUERIES = {f.__name__: f for f in (op1_mixing, op2_sharding, op3_decontamination, op4_licenses, op5_simhash, op6_tokens, op7_passages, op8_matroska, op9_chat, op10_languages, op11_vectors, op12_negatives, op13_divergence)}
ORACLE_SQL = {"op1_mixing": OP1_SQL, "op2_sharding": OP2_SQL, "op9_chat": OP9_SQL, "op11_vectors": OP11_SQL, "op12_negatives": OP12_SQL, "op13_divergence": OP13_SQL}
