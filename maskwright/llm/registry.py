"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import languages, mixing, secrets, simhash, substrings, topk, toxicity
from maskwright.llm.common import fold_of, table
from maskwright.llm.html import extract_pages
from maskwright.llm.media import media_digests
from maskwright.llm.pieces import piece_digests

#: The SentencePiece model that op3 encodes with.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), PIECES)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold_of("id", 5) != 0)
    return toxicity.score_toxicity(docs, model, fold=0)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return languages.identify(docs, languages.learn(docs, fold_of("doc_id", 3) != 1), fold=1)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_mixing": op1_mixing, "op2_simhash": op2_simhash, "op3_pieces": op3_pieces, "op4_secrets": op4_secrets, "op5_html": op5_html, "op6_repeats": op6_repeats, "op7_toxicity": op7_toxicity, "op8_topk": op8_topk, "op9_language": op9_language, "op10_media": op10_media}

ORACLES: dict[str, str] = {"op4_secrets": secrets.SECRETS_SQL, "op6_repeats": substrings.REPEATS_SQL, "op8_topk": topk.TOP_K_SQL}
