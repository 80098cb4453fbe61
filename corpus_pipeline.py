"""From documents to token ids: language, near copies, leaks, personal data, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
keep the columns of ``documents``. A stage judges all that the one before it kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossia.llm import batches, bpe, decontam, durable, langid, pii, simhash


#: What a worker of the last stage remembers, a quarter of what op4 does: executors still hold what stages before took.
REMEMBER = 100_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or of no language at even odds, go."""
    durable.ship(spark)
    batches.small(spark)
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5 words, 0.8 or more) stays, the one with the smallest id."""
    return simhash.keep_similar(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half of a benchmark item go."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and what gives it away, is replaced; no document goes."""
    return pii.sanitised(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the decoded text.

    A null text is an empty one; every row has a row, and columns other than doc_id, lang
    and source are left behind.
    """
    batches.small(spark)
    return bpe.encoded(docs, bpe.default_vocabulary(), keep=["doc_id", "lang", "source"], remember=REMEMBER, rows=batches.ROWS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("personal_data", sanitise),
    ("bpe_encoding", encode),
]

#: The classifier, string tiling and BPE can't be said in SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again by the next."""
    durable.ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable.saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
