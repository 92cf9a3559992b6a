"""The numbered queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_fst, decontamination, line_dedup
from .class_lm import class_scores
from .decontamination import contamination
from .jaccard_join import jaccard_components
from .language_id import document_evidence, identify, page_evidence
from .line_dedup import deduplicated
from .permutation_index import nearest_neighbours
from .piece_bpe import encode_decode_digests
from .secret_scan import secrets
from .spelling_variants import spelling_variants
from .token_binary import token_binary
from .toxicity import toxicity
from .vector_codes import vector_codes

BYTE_BPE = ("byte_bpe_50k.json", 50257)
PIECE_BPE = "piece_bpe_32k.model"
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_scores(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2("text", 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages; the id of the other kind is null."""
    records = document_evidence(_table(spark, sf_dir, "documents")).unionByName(page_evidence(_table(spark, sf_dir, "pages")))
    return identify(records)


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE[0]), BYTE_BPE[1])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(_table(spark, sf_dir, "documents"))


def op9_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), width=3, p=90, q=100)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op12_byte_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_fst.encode_decode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (
        op1_decontamination,
        op2_class_lm,
        op3_line_dedup,
        op4_language_id,
        op5_token_binary,
        op6_toxicity,
        op7_permutation_index,
        op8_secret_scan,
        op9_piece_bpe,
        op10_jaccard_join,
        op11_spelling_variants,
        op12_byte_fst,
        op13_vector_codes,
    )
    return {f.__name__: f for f in numbered}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontamination.ORACLE_SQL, "op3_line_dedup": line_dedup.ORACLE_SQL}
