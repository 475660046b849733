"""A corpus pipeline: every stage reads what its predecessor kept, as Parquet.

Stages: language identification (rejected documents go), SimHash near-dedup
(the smallest id of each group stays), secret scans (live-looking values are
masked), mixing sources to target weights (documents repeat as often as the mix
takes them), SentencePiece encoding (ids and their decoded text, one row per
document and copy).

Near-dedup takes five-word shingles and a similarity of 0.8 (``keep_first`` says
how).  Defined cases: null and empty texts, and texts without a letter, go in the
first stage; a null source is a source; rows of a null id are documents of their
own, near-duplicates and secrets included; rows of one id are told apart by their
texts, and rows equal in id and text count as one from the second stage on; very
long texts are handled whole; an empty table gives an empty result; extra columns,
whatever their names, stay until the last stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import languages, mixing, pieces, secrets, simhash
from maskwright.llm.common import ensure_checkpoint_dir, fold_of
from maskwright.session import remove, ship

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return languages.keep_identified(docs, languages.learn(docs, fold_of("doc_id", 3) != 1))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(docs, PIECES)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: Trained models, connected components and draws can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the others' are written to the shared folder and read again."""
    ship(spark)
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{number}")
        docs = spark.read.parquet(f"{base}/{number}")
        if number:
            remove(spark, f"{base}/{number - 1}")  # nothing reads it any more
    return docs
