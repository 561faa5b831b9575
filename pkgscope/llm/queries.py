"""The registered query of each operator, on its whole table, with the digest
columns its contract asks for, and SQL for the same rows where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgscope.llm import bpe, chat, common, langid, lattice, merkle, negatives, packing, quality, secrets, simhash, token_counts, topk, warc


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(common.table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"),
                        F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"), words=3, max_bits=3)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_path(spark)
    warc.write_archives(common.table(spark, sf_dir, "pages"), path, min_revisit=1000)
    found = warc.captures_of(spark, path, "bigint")
    whole = F.col("response.type") == "response"
    said = F.regexp_extract("metadata.block", r"payload-bytes: (\d+)", 1).cast("bigint")
    return found.select("page_id", F.when(whole, F.octet_length("response.block").cast("bigint")).otherwise(said).alias("payload_bytes"),
                        F.when(whole, F.sha1("response.block")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
                        F.col("response.type").alias("record_type"), "refers_to", F.octet_length("request.block").cast("bigint").alias("request_bytes"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_conversations(chat.with_probe(common.table(spark, sf_dir, "conversations"))))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.withColumnRenamed("id", "doc_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(langid.fold(F.col("doc_id")) != 1))
    found = langid.predict(docs, model)
    return found.select(F.col("id").alias("doc_id"), F.coalesce(langid.fold(F.col("id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)
    return found.withColumnRenamed("id", "doc_id")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, with_ids=False)
    return found.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", F.col("n").alias("doc_tokens"), "sequence_id", "offset")


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lattice.near_duplicates(common.table(spark, sf_dir, "embeddings"), min_cosine=0.95)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = common.table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    own = {c: F.col(c) for c in fields}
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    altered = F.when(tampered, merkle.leaf_digest(list((own | {"n_chars": F.col("n_chars") + 1}).values()))).otherwise(merkle.leaf_digest(list(own.values())))
    found = merkle.manifest(common.table(spark, sf_dir, "documents"), fields, altered=altered)
    found = found.withColumn("folded_root", merkle.fold(F.col("altered"), F.col("seg")))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.siblings_text(F.col("seg")), 256).alias("proof_sha256"),
                        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_simhash_near_dedup, op3_warc, op4_quality_rules, op5_chat_formatting, op6_byte_bpe,
                                   op7_language_id, op8_token_counts, op9_exact_top_k, op10_packing,
                                   op11_embedding_near_dedup, op12_hard_negatives, op13_merkle_manifest, pipeline)}

#: Words are runs of anything but the six ASCII spaces.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

def _leaf(n_chars: str) -> str:
    """SQL: digest of a documents row whose n_chars is given."""
    part = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(({0})::VARCHAR) || ':' || ({0})::VARCHAR END"
    return "sha256(" + " || ".join(part.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: CRC-32 of the decimal doc_id, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
            lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda o: 0::BIGINT)),
                                     lambda c, o: xor(c >> 1, (c & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"""

ORACLES = {
    "op3_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d,
                  (17 + strlen(coalesce(replace(replace(replace(url, chr(13), '%0D'), chr(10), '%0A'), ' ', '%20'), '/')))::BIGINT AS r FROM pages),
     f AS (SELECT d, n, max(page_id) AS original, count(*) AS c FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN c > 1 AND original IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN c > 1 AND original IS DISTINCT FROM page_id THEN original END AS refers_to, r AS request_bytes
FROM p LEFT JOIN f ON p.d = f.d AND p.n = f.n""",
    "op4_quality_rules": rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
     l AS (SELECT r, doc_id, text, w, len(w) AS n_words,
                  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
                  list_transform(generate_series(1, len(w) - 7), lambda i: list_slice(w, i, i + 7)) AS win FROM t),
     g AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c
           FROM (SELECT r, unnest(win) AS x, unnest(generate_series(1, n_words - 7)) AS i FROM l WHERE n_words >= 8)),
     m AS (SELECT r, count(DISTINCT p) AS n_repeat_words
           FROM (SELECT r, unnest(generate_series(i, i + 7)) AS p FROM g WHERE c > 1) GROUP BY r),
     b AS (SELECT doc_id, n_words::BIGINT AS n_words,
                  length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
                  len(list_filter(generate_series(2, len(w)), lambda i: w[i] = w[i - 1])) AS n_stutters,
                  length(regexp_replace(text, '[A-Za-z]|[^\x00-\x7F]|[\x20\x09-\x0D]', '', 'g')) AS n_plain
           FROM l LEFT JOIN m USING (r)),
     v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 10 * n_symbols <= n_words AND 2 * word_chars >= 5 * n_words AND word_chars <= 14 * n_words
       AND (n_dup_lines < 3 OR 10 * n_dup_lines <= 3 * n_lines) AND 10 * n_stutters <= 3 * n_words AND 10 * n_plain <= 4 * word_chars AS kept
FROM v""",
    "op9_exact_top_k": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v)::BIGINT AS score
           FROM e AS q JOIN e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id AND len(q.v) = len(e.v)),
     r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, list_dot_product(a.v, e.v)::BIGINT AS score
           FROM e AS a JOIN e ON a.vec_id % 50 = 0 AND a.vec_id <> e.vec_id AND len(a.v) = len(e.v)),
     p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
           QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
     n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                  (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank
           FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE
     f AS (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, {_leaf('n_chars + 1')} AS other,
                  {_CRC32} % 7 = 0 AS tampered FROM documents),
     d AS (SELECT *, (row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1)::BIGINT AS pos FROM f),
     t AS (SELECT lang, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM d
           UNION ALL
           SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM t WHERE n > 1 GROUP BY lang, lvl, pos // 2),
     g AS (SELECT lang, lvl AS height, h AS subroot, (row_number() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1)::BIGINT AS pos FROM t WHERE n = 1),
     u AS (SELECT 0 AS lvl, pos, subroot AS h, count(*) OVER () AS n FROM g
           UNION ALL
           SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM u WHERE n > 1 GROUP BY lvl, pos // 2),
     r AS (SELECT h AS root, lvl AS height FROM u WHERE n = 1),
     w AS (SELECT d.*, d.pos AS at, g.subroot, g.height, g.pos AS gpos, r.root, r.height AS top FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang, r),
     s AS (SELECT w.doc_id, w.lang, w.pos, x.lvl, t.h AS sib, (w.pos >> x.lvl) % 2 = 1 AS on_left
           FROM w JOIN (SELECT unnest(range(0, 64)) AS lvl) AS x ON x.lvl < w.height
                  LEFT JOIN t ON t.lang IS NOT DISTINCT FROM w.lang AND t.lvl = x.lvl AND t.pos = xor(w.pos >> x.lvl, 1)
           UNION ALL
           SELECT w.doc_id, w.lang, w.pos, w.height + x.lvl, u.h, (w.gpos >> x.lvl) % 2 = 1
           FROM w JOIN (SELECT unnest(range(0, 64)) AS lvl) AS x ON x.lvl < w.top
                  LEFT JOIN u ON u.lvl = x.lvl AND u.pos = xor(w.gpos >> x.lvl, 1)),
     q AS (SELECT lang, pos, list(struct_pack(h := sib, l := on_left) ORDER BY lvl) AS steps, coalesce(string_agg(sib, '' ORDER BY lvl), '') AS proof FROM s GROUP BY lang, pos),
     z AS (SELECT w.*, coalesce(proof, '') AS proof,
                  CASE WHEN tampered THEN other ELSE leaf END AS start, coalesce(steps, []) AS steps
           FROM w LEFT JOIN q ON w.lang IS NOT DISTINCT FROM q.lang AND w.pos = q.pos),
     k AS (SELECT lang, pos, 0 AS i, start AS acc FROM z
           UNION ALL
           SELECT k.lang, k.pos, i + 1, sha256(CASE WHEN z.steps[i + 1].h IS NULL THEN acc WHEN z.steps[i + 1].l THEN z.steps[i + 1].h || acc ELSE acc || z.steps[i + 1].h END)
           FROM k JOIN z ON z.lang IS NOT DISTINCT FROM k.lang AND z.pos = k.pos WHERE i < len(z.steps))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM z JOIN k ON z.lang IS NOT DISTINCT FROM k.lang AND z.pos = k.pos AND k.i = len(z.steps)""",
}
