"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, importance, jaccard, language_model, neighbours, pii, quality, sharding, simhash, tokenization, voronoi, warc
from .common import table

SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def surrogate_key(spark: SparkSession) -> str:
    """The session's key of the PII surrogates; where none is set, one for demonstration, which protects nothing."""
    return spark.conf.get("spark.traceloom.pii.key", None) or "demonstration only"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_digests(rows.unionByName(extra))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark), count_col="n_replaced")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenization.encode(table(spark, sf_dir, "documents"), SENTENCEPIECE_MODEL)


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return voronoi.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_warc, op2_chat, op3_pii, op4_quality, op5_sharding, op6_simhash, op7_decontamination, op8_neighbours, op9_sentencepiece, op10_lm, op11_importance, op12_jaccard, op13_hard_negatives, pipeline)}

ORACLES = {
    "op1_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d, CASE WHEN octet_length(b) >= 1000 THEN max(page_id) OVER (PARTITION BY b) END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to,
  CAST(CASE WHEN first <> page_id THEN 1 ELSE (n + framed + 65535) // 65536 END AS INTEGER) AS segments, TRUE AS valid
FROM (SELECT *, 87 + list_sum(list_transform(range(0, (n + 8191) // 8192), lambda k: 4 + length(printf('%x', least(8192, n - k * 8192))))) + 5 AS framed FROM h)
""",
    "op2_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '<', '\l'), '[', '\k') AS shown FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS under,
  sum(length(role) + length(shown) + 17) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(under) AS BIGINT) AS loss_chars, sha256(under) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
""",
    # crc32 by its table, which a rule makes, over the bytes of each distinct feature.
    "op11_importance": r"""
WITH t0 AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT row_number() OVER () AS rid, side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
f AS (SELECT rid, side, unnest(flatten([words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]), list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])])) AS feature FROM w),
n AS (SELECT rid, side, feature, count(*) AS n FROM f GROUP BY ALL),
d AS (SELECT feature, hex(encode(feature)) AS x FROM (SELECT DISTINCT feature FROM n)),
h AS (SELECT feature, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT)), lambda c, b: xor(c >> 8, crcs[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM d, t0),
b AS (SELECT rid, side, bucket, sum(n) AS n FROM n JOIN h USING (feature) GROUP BY ALL),
c AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t FROM b GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM c),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM c, a),
v AS (SELECT rid, sum(n) AS n_features, sum(n * gain) AS weight FROM b JOIN g USING (bucket) WHERE side = 0 GROUP BY rid),
z AS (SELECT w.id AS doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, len(words) >= 20 AS fit,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(w.id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w LEFT JOIN v USING (rid) WHERE side = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) FILTER (WHERE fit) OVER () AS n_fit FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 5 * n_fit // 100 THEN place END AS rank FROM r
""",
    "op12_jaccard": r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [words] ELSE list_transform(range(1, len(words) - 1), lambda i: words[i : i + 2]) END) AS shingle FROM w),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
i AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.rid < b.rid GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT rid AS start, rid AS at FROM n UNION SELECT c.start, e.b FROM c JOIN e ON e.a = c.at)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN n.n IS NULL THEN w.doc_id ELSE m.component_id END AS component_id
FROM w LEFT JOIN n USING (rid) LEFT JOIN (SELECT c.start AS rid, min(o.doc_id) AS component_id FROM c JOIN w o ON o.rid = c.at GROUP BY c.start) m USING (rid)
""",
    "op13_hard_negatives": """
WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
""",
}
