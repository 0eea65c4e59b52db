"""The corpus pipeline: toxic documents, near duplicates and benchmark passages go, sources are mixed, ids are written.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm import decontam, jaccard, mixing, token_output, toxicity
from skyweave.llm.common import free_name, lean_batches, stored
from skyweave.llm.queries import fold, tokenizer_path
from skyweave.sources.scratch import discard

#: Near duplicates share four of five shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose whole text scores below the threshold; null and empty texts get the bias's score.

    The model learns from ``labels`` outside the held-out fold. Equal rows share their fate, rows with a null id are
    judged too, further columns pass of any name, and no rows give none.
    """
    lean_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(fold(4) != 2))
    name = free_name(docs, "__toxic")
    scored = toxicity.score(docs, model, score_as=name)
    return scored.where(F.col(name) < toxicity.THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, as ``jaccard.one_of_each`` says."""
    lean_batches(spark)
    return jaccard.one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no item of ``benchmark``, as ``decontam.clean`` says."""
    lean_batches(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, each row as often as it takes it, as ``mixing.mixed_rows`` says."""
    return mixing.mixed_rows(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's ids, written in ascending id and read back; null ids come first, as ``token_output.read`` says."""
    lean_batches(spark)
    return token_output.read(spark, token_output.write(docs, tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: A trained classifier and a tokenizer decide; SQL can't express them. Tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage read is deleted once its own rows are stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        read, docs = docs, stored(stage(spark, docs, sf_dir))
        discard(read)
    return STAGES[-1][1](spark, docs, sf_dir)
