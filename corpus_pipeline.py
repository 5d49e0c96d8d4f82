"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's documents.

1. quality: documents that the byte-level network rejects go. 2. near_duplicates: one document of each group of near
copies (five-word shingles, similarity 0.8) stays. 3. secrets: secrets in the text are replaced, the documents stay.
4. mixture: sources are mixed to their target weights, so a row appears as often as the mix takes it. 5. tokens: every
text becomes token ids; ``exact`` says whether decoding gives the text again.

Null texts count as empty in every stage; rows without an id are kept by stages 1 to 4; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchwise.llm import bpe, minhash, mixing, quality, secrets
from catchwise.runtime import Cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _aside(docs: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` over ``docs`` whose own columns of these names are renamed meanwhile; it returns ``docs``' columns."""
    held = {c: f"aside_{c}" for c in docs.columns if c in names}
    renamed = docs.withColumnsRenamed(held)
    return work(renamed).select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = quality.train(docs, labels, "quality", quality.fold("doc_id", 5) != 0)
    return _aside(docs, ("score", "predicted"), lambda d: quality.classify(d, net).filter("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs, width=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _aside(docs, ("size", "source_size", "target", "copies"), lambda d: mixing.repeat_rows(mixing.mix(d, "doc_id", "source", mixing.words("text"))))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = bpe.round_trip(docs.select("doc_id", "source", "text"), bpe.tokenizer_path())
    return made.select("doc_id", "source", "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
    ("tokens", tokenize),
]

#: The first stage's network cannot be written in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; results between stages lie in the shared scratch folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        made = Cut(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        docs, before = made.df, made
    return docs
