"""From raw documents to token ids: toxicity, near duplicates, personal data, source mix, BPE.

Each stage takes the whole table that the stage before kept. STAGES are run one by one, each written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import ngram_jaccard, pii_crf, source_mix, toxicity, trie_bpe
from palimpsest.llm._shared import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is below the limit."""
    model = toxicity.fitted(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).filter(F.col("toxicity") < toxicity.LIMIT).drop("toxicity")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by a similarity of 0.8 or more over five-word shingles."""
    return ngram_jaccard.deduplicated(docs, width=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with emails, addresses, card and phone numbers replaced by their kind."""
    return pii_crf.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last time its chosen blocks only."""
    return source_mix.materialised(source_mix.mixed(source_mix.sized(docs)), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each text's ids, and the digest of what they decode to."""
    return trie_bpe.digests(trie_bpe.encode_and_decode(docs))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", drop_near_copies), ("pii", mask_personal_data), ("source_mix", mix_sources), ("trie_bpe", encode)]
#: Trained models and tokenizers have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
