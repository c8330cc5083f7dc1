"""The queries of this subpackage: opN_<name>, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    return chat.rotate(_table(spark, sf_dir, "conversations"))


OP1_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS participant FROM t WHERE speaker <> 'system'),
r AS (SELECT t.conv_id, p.participant, t.turn, t.text, t.speaker = p.participant AS own, CASE WHEN t.speaker = p.participant THEN 'assistant' WHEN t.speaker = 'system' THEN 'system' ELSE 'user' END AS role, t.speaker
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|turn|>' || role || CASE WHEN role = 'user' THEN '|' || speaker ELSE '' END || chr(10) AS head FROM r)
SELECT conv_id, participant, turn, role, CASE WHEN role = 'user' THEN speaker END AS name, head || text || '<|end|>' || chr(10) AS rendered,
  CAST(CASE WHEN own THEN length(head) ELSE 0 END AS INTEGER) AS mask_start, CAST(CASE WHEN own THEN length(head) + length(text) ELSE 0 END AS INTEGER) AS mask_end,
  CAST(length(head) + length(text) + 8 AS INTEGER) AS n_chars FROM h
"""


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import bitsliced

    rows = bitsliced.quantised(_table(spark, sf_dir, "embeddings"))
    return bitsliced.search(rows, rows.where(F.col("vec_id") % 100 == 0)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


OP3_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM rows q JOIN rows c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op4_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.link(_table(spark, sf_dir, "documents"), 85)


def op5_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import knn_tree

    rows = knn_tree.usable(_table(spark, sf_dir, "embeddings"))
    return knn_tree.search(rows, rows.where(F.col("vec_id") % 50 == 0)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import shared, warc

    folder = shared.folder(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder)


def op9_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fm_index

    return fm_index.dedup(_table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.digests(_table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
       CASE WHEN d.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id > f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_perspective_rotation, op2_byte_bpe, op3_bitsliced_topk, op4_minhash_bayes, op5_sequence_packing, op6_kmeans_tree, op7_quality_ranking, op8_warc_segments, op9_fm_index_dedup, op10_suffix_array_dedup, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_perspective_rotation": OP1_SQL, "op3_bitsliced_topk": OP3_SQL, "op8_warc_segments": OP8_SQL}
