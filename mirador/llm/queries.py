"""The registered queries of the numbered operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, embdedup, linededup, negatives, packing, quality, ring, secrets, simhash, toxicity, warc, wavelet
from .common import table
from .labelled import fold


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; the files stay outside this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=2048, end_id=0)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, seed=42, radius=3)
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(table(spark, sf_dir, "pages"), min_bytes=1000)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_documents(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "longest", "tiles")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op8_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def _held_out(scored: DataFrame, folds: int, held: int) -> DataFrame:
    out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(True))
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), folds=3, held=1)
    return _held_out(toxicity.score(docs, model, threshold=0.7), 3, 1)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vectors = quality.word_vectors(docs)
    net = quality.fit(docs, table(spark, sf_dir, "labels"), vectors, folds=5, held=0)
    return _held_out(quality.score(docs, vectors, net, threshold=0.3), 5, 0)


def op11_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.place(table(spark, sf_dir, "documents"), shards=16, slack=0.0)
    none = F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", none, "home_shard", "walked")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), max_n=3, min_count=10, inside=50, top=2000)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.select("vec_id", moved.alias("label"), "embedding")
    return negatives.hard_negatives(vectors, anchor=F.col("vec_id") % 50 == 0, scale=256, positives=5, negatives=3, band=(50, 95))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_simhash": op2_simhash,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_secret_scan": op4_secret_scan,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_wavelet_tokens": op8_wavelet_tokens,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_hash_ring": op11_hash_ring,
    "op12_collocations": op12_collocations,
    "op13_hard_negatives": op13_hard_negatives,
}

#: A line's key in DuckDB: the six ASCII spaces stripped, A-Z lower-cased.
_KEY = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op3_warc_revisits": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
o AS (SELECT digest, max(page_id) AS original FROM p WHERE n >= 1000 GROUP BY digest HAVING count(*) > 1)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN o.original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN o.original <> page_id THEN o.original END AS refers_to, TRUE AS verified
FROM p LEFT JOIN o ON p.digest = o.digest""",
    "op5_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT doc_id, pos, line, {_KEY} AS key FROM l),
often AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, o.key IS NOT NULL AS gone FROM k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op12_collocations": """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS ps FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS ws FROM (SELECT lang, unnest(ps) AS p FROM d)),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS pos FROM w),
n AS (SELECT lang, count(*)::BIGINT AS n FROM i GROUP BY lang),
f AS (SELECT lang, array_to_string(list_slice(ws, pos, pos + size - 1), ' ') AS phrase, size, count(*)::BIGINT AS f FROM i CROSS JOIN (SELECT unnest([1, 2, 3]) AS size) WHERE pos + size - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size >= 2),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.size, a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score FROM k
  JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(list_slice(ws, 1, k), ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(list_slice(ws, k + 1, k.size), ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub AS (SELECT lang, array_to_string(list_slice(ws, pos, pos + 1), ' ') AS phrase, max(a) AS most FROM (SELECT lang, ws, a, unnest([1, 2]) AS pos FROM c WHERE size = 3) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN sub ON sub.lang = b.lang AND sub.phrase = b.phrase WHERE size = 3 OR most IS NULL OR 100 * most < 50 * a
QUALIFY rank <= 2000""",
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3""",
}
