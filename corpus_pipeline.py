"""A training corpus in five stages: quality, near duplicates, benchmark leaks, source weights, shards.

Every stage decides by rows, so repeated and null ids are documents of their own, and passes an empty
table on as an empty table. The last stage keeps the columns of the documents beside each row's place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.decontamination import drop_leaks
from docweave.llm.jaccard_join import drop_near_copies
from docweave.llm.mixing import mix_sources
from docweave.llm.quality import fit_quality, graded, keep_good
from docweave.llm.sharding import shard_documents
from docweave.llm.store import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on a bounded sample of rated ones, finds likely good.

    Rows are scored one by one, whatever their ids; null text like an empty one. Without ratings of
    two grades all stay.
    """
    ratings = graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_good(docs, fit_quality(docs, ratings))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles.

    The row with the smallest doc_id stays, null ids last; of rows that repeat an id and a text, one.
    Null and empty texts have no words, so they all stay.
    """
    return drop_near_copies(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark: row by row, whatever their ids; null texts have none."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 3, 1, 2 in turn and 150% of all words: a document is repeated as often as it is taken.

    Documents without words follow the rule of their source; a null source is a source like others.
    """
    mixed = mix_sources(docs, weights=(3, 1, 2), share=1.5, most=2.0, carry=tuple(docs.columns))
    again = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("again")
    return mixed.select(again, "carried").select("carried.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with all its columns, and its place in eight shuffled shards: size, text_crc32, law, shard, slot, grown_shard.

    A column of the documents that has the name of one of these gives way to it.
    """
    placed = shard_documents(docs, n_shards=8, carry=tuple(docs.columns))
    place = [c for c in placed.columns if c not in ("doc_id", "carried")]
    return placed.select(*[F.col(f"carried.`{c}`").alias(c) for c in docs.columns if c not in place], *place)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The classifier has no SQL form; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each over the whole output of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
