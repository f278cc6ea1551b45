"""The registered queries of this subpackage: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, hnsw, jaccard, packing, quality, rans, spotsigs, toxicity, warc
from .common import fresh_name, table

BYTE_BPE, BYTE_RANKS, WORD_BPE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"


def op1_chat_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = chat.link_calls(*chat.conversation_calls(table(spark, sf_dir, "conversations")))
    return linked.select("call_id", "position", "order_at", "order_hops", "status", "valid", "errors", "message")


def op2_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranking = quality.learn_ranking(docs, table(spark, sf_dir, "labels"))
    return _judged(quality.score_documents(docs, ranking), 4, 2)


def _judged(scored: DataFrame, folds: int, split: int) -> DataFrame:
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == split
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.dedup_vectors(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE, BYTE_RANKS)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels"))
    return _judged(toxicity.score_documents(docs, model), 3, 1)


def op8_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(table(spark, sf_dir, "documents"), WORD_BPE)


def op9_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_chat_linking, op2_quality_ranking, op3_jaccard_join, op4_spotsigs, op5_hnsw_dedup, op6_packing, op7_toxicity, op8_rans_files, op9_speculative_bpe, op10_warc)
    return {f.__name__: f for f in own}


#: SQL for the queries that SQL can express; the others are tested by brute force.
def oracle_sql() -> dict[str, str]:
    return {"op1_chat_linking": _CHAT_SQL}


_CHAT_SQL = """
WITH RECURSIVE asked AS (
  SELECT conv_id || ':' || turn AS call_id, conv_id, turn, role, min(text) AS prompt FROM conversations
  WHERE role IS NULL OR role <> 'assistant' GROUP BY conv_id, turn, role
), answered AS (
  SELECT conv_id || ':' || (turn - 1) AS call_id, turn AS result_at, min(text) AS content FROM conversations
  WHERE role = 'assistant' GROUP BY conv_id, turn
), both_sides AS (
  SELECT coalesce(a.call_id, r.call_id) AS call_id, a.call_id IS NOT NULL AS is_call, r.call_id IS NOT NULL AS is_result,
    a.turn, a.role, a.prompt, r.result_at, r.content
  FROM asked a FULL JOIN answered r ON a.call_id = r.call_id
), needs AS (
  SELECT conv_id, turn, CASE WHEN role = 'system' AND turn = 0 THEN 1 WHEN length(prompt) > 120 THEN turn + 2 WHEN turn >= 2 THEN turn - 2 END AS dep FROM asked
), known AS (
  SELECT n.* FROM needs n JOIN asked a ON a.conv_id = n.conv_id AND a.turn = n.dep
), cycles AS (
  SELECT a.conv_id, a.turn FROM known a JOIN known b ON b.conv_id = a.conv_id AND b.turn = a.dep AND b.dep = a.turn
), walk AS (
  SELECT conv_id, turn AS start, turn AS spot, 0 AS hops FROM asked
  UNION ALL
  SELECT w.conv_id, w.start, k.dep, w.hops + 1 FROM walk w JOIN known k ON k.conv_id = w.conv_id AND k.turn = w.spot
  WHERE k.dep > k.turn AND NOT EXISTS (SELECT 1 FROM cycles c WHERE c.conv_id = w.conv_id AND c.turn = w.spot)
), placed AS (
  SELECT conv_id || ':' || start AS call_id, max(spot) AS order_at, CAST(max(hops) AS BIGINT) AS order_hops FROM walk GROUP BY 1
), judged AS (
  SELECT b.*, p.order_at, coalesce(p.order_hops, 0) AS order_hops, CASE WHEN NOT is_call THEN 'orphan' WHEN EXISTS (SELECT 1 FROM cycles c WHERE c.conv_id || ':' || c.turn = b.call_id) THEN 'cyclic' WHEN NOT is_result THEN 'unanswered' ELSE 'linked' END AS status,
    concat_ws(';', CASE WHEN length(prompt) > 400 THEN 'length:prompt' END, CASE WHEN is_call AND prompt IS NULL THEN 'missing:prompt' END) AS errors
  FROM both_sides b LEFT JOIN placed p ON p.call_id = b.call_id
)
SELECT call_id, coalesce(turn, result_at) AS position, coalesce(order_at, result_at) AS order_at, order_hops, status,
  errors = '' AS valid, errors,
  '{"arguments":' || CASE WHEN is_call THEN '{' || concat_ws(',', '"prompt":' || CAST(to_json(prompt) AS VARCHAR), '"role":' || CAST(to_json(role) AS VARCHAR), '"turn":"' || turn || '"') || '}' ELSE '{}' END
    || ',"call_id":"' || call_id || '","name":' || CASE WHEN is_call THEN '"reply"' ELSE 'null' END
    || ',"result":' || CASE WHEN content IS NULL THEN 'null' ELSE CAST(to_json(content) AS VARCHAR) END || ',"status":"' || status || '"}' AS message
FROM judged
"""


def keep_predicted(docs: DataFrame, score: Callable[[DataFrame, str], DataFrame], keep: int) -> DataFrame:
    """Rows of ``docs`` judged ``keep``, with the columns of ``docs``.

    ``score`` appends a score as the column it is told, a name that ``docs`` hasn't."""
    to = fresh_name("score", docs.columns)
    return score(docs, to).where((F.col(to) >= 0.7).cast("int") == keep).drop(to)

