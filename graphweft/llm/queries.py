"""The registered queries of this subpackage; each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphweft.llm import binary, language, negatives, packing, passages, pii, quality, runs, simhash, sketches, tokens, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = binary.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, white_space_dropped=True)
    return binary.read_tokens(shards, digest=True)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compare_with_edited(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, window=1024)


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.kept_words(table(spark, sf_dir, "documents"), digest=True)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.find_runs(table(spark, sf_dir, "documents"), digest=True, plant=True)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


SQL = {
    "op13_negatives": """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select a.vec_id as anchor_id, v.vec_id, a.label = v.label as same, cast(list_inner_product(a.e, v.e) as bigint) as score from v a, v where a.vec_id % 100 = 0 and a.vec_id <> v.vec_id),
 p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
 n as (select anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank
  from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 10""",
}

QUERIES = (op1_pii, op2_simhash, op3_token_output, op4_toxicity, op5_quality, op6_sketches, op7_byte_bpe, op8_token_counts, op9_packing, op10_passages, op11_language, op12_runs, op13_negatives)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
