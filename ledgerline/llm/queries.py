"""The subpackage's queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.common import read_table
from ledgerline.llm.decontaminate import leaks
from ledgerline.llm.knn import knn_join
from ledgerline.llm.licenses import scan
from ledgerline.llm.minhash import near_duplicates
from ledgerline.llm.packing import pack
from ledgerline.llm.paragraph_dedup import paragraph_duplicates
from ledgerline.llm.pii import find
from ledgerline.llm.suffix_dedup import remove_repeats
from ledgerline.llm.tool_calls import link
from ledgerline.llm.toxicity import toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, read_table(spark, sf_dir, "documents"), best_only=True)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read_table(spark, sf_dir, "documents"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, read_table(spark, sf_dir, "documents"))


def op6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_duplicates(spark, read_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark, read_table(spark, sf_dir, "conversations"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join(spark, read_table(spark, sf_dir, "embeddings"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_licenses": op2_licenses,
    "op3_packing": op3_packing,
    "op4_pii": op4_pii,
    "op5_repeats": op5_repeats,
    "op6_paragraphs": op6_paragraphs,
    "op7_decontamination": op7_decontamination,
    "op8_tool_calls": op8_tool_calls,
    "op9_topk": op9_topk,
    "op10_minhash": op10_minhash,
}

ORACLE_SQL = {
    "op9_topk": """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.n AS n, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.n <> c.n
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
}
