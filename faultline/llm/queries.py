"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm import filter_audit, mixing, packing, pii, quality, simhash, spelling, substrings, token_counts, token_files, toxicity, urls, vptree
from faultline.llm.common import read
from faultline.session import scratch_path


TOKENIZER = "word_bpe_49k.json"


def op6_deep_shallow_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(read(spark, sf_dir, "documents")).drop("kept")


def op7_context_mixed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "ids")
    token_files.write(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), out)
    return token_files.read_documents(spark, out)


def op8_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents")).drop("frequent", "row")


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("__n_entities").alias("n_entities"), "text", F.col("__spans").alias("spans"))


def op2_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("copies")


def op5_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def op10_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op11_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op12_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(read(spark, sf_dir, "documents"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_surrogates,
        op2_convolutional_toxicity,
        op3_vantage_point_trees,
        op4_subset_sum_mix,
        op5_bit_sliced_simhash,
        op6_deep_shallow_substrings,
        op7_context_mixed_ids,
        op8_line_frequency,
        op9_association_rules,
        op10_first_fit_packing,
        op11_merge_counts,
        op12_permuterm_variants,
        op13_filter_interactions,
    )
}
