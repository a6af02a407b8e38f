"""A corpus pipeline of five stages, each over all that the one before kept.

Quality rules drop what they reject; of each group of near copies one document stays; secrets are replaced in the text;
sources are mixed to their target weights, which repeats or drops documents; the rest is encoded by bytes and decoded
again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import bpe, common, minhash, mixing, quality, secrets


def _recounted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if it is there, of the text as it now is; null for a null text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the base rule and the learned rules keep. Rows of null or empty text go; repeated rows share their verdict;
    columns stay as they are, whatever their names; no rows, or no labels, are no fault."""
    return quality.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each group of near copies, of its smallest doc_id; one of equal doc_ids; rows of a null doc_id stay, as do
    rows without words. Columns stay as they are."""
    return minhash.dedup(docs, size=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced by a mark. Null texts stay null; columns stay, but that n_chars is counted anew."""
    return _recounted(secrets.redact(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as its source's target takes it, none to three times. Null is a source of its own; rows of null or empty
    text have no words and are taken once; rows of a null doc_id are rows like others. Columns stay as they are."""
    return mixing.mixed(docs)


def encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with token ids, their number and the text decoded from them; columns of docs named n_tokens, ids or decoded are
    replaced. Null texts have no ids and decode to an empty text."""
    import public_tokenizers

    vocab, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encoded_and_decoded(docs, vocab, pattern)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("secret scan", secret_scan),
    ("source mix", source_mix),
    ("token ids", encode_decode),
]

#: Rules are learned and texts hashed and tokenized, which SQL does not express; tests/llm checks run() without these operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Empty tables give no rows; extra columns, null values and repeated rows are as the stages say."""
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = common.checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
