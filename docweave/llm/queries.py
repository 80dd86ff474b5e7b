"""The registered query of each operator, with production parameters over whole tables, and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import pii, sql
from docweave.llm.byte_bpe import decode_tokens, encode_documents
from docweave.llm.decontamination import find_leaks
from docweave.llm.exact_dedup import exact_dedup
from docweave.llm.fill_middle import fill_in_middle, restored
from docweave.llm.filter_audit import audit_stream, document_stream, filter_orders
from docweave.llm.jaccard_join import jaccard_components
from docweave.llm.line_dedup import near_lines
from docweave.llm.mixing import mix_sources
from docweave.llm.quality import fit_quality, graded, score_quality
from docweave.llm.secret_scan import joined, scan_secrets
from docweave.llm.sharding import shard_documents
from docweave.llm.warc import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_lines(table(spark, sf_dir, "documents"))


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), n_shards=8)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op8_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    count = lambda n: F.size(F.filter("base", lambda s: s["number"] == n)).cast("long")
    return found.select(
        "doc_id",
        *[count(n).alias(f"n_{k}") for n, k in enumerate(pii.KINDS[:4])],
        F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
    )


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, graded(table(spark, sf_dir, "labels"))))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    own = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = encode_documents(table(spark, sf_dir, "documents"), *own, offsets=False)
    return decode_tokens(encoded, own[0]).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_split",
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"), seed=7, percent=100, spm_percent=50)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_stream(spark, f"{sf_dir}/documents.parquet")
    return filter_orders(audit_stream(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_cgk_decontamination": op1_cgk_decontamination,
    "op2_secret_scan": op2_secret_scan,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_warc_zstd": op4_warc_zstd,
    "op5_line_dedup": op5_line_dedup,
    "op6_feistel_shards": op6_feistel_shards,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_pii_bootstrap": op8_pii_bootstrap,
    "op9_ordinal_quality": op9_ordinal_quality,
    "op10_mix_sources": op10_mix_sources,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL = {
    "op2_secret_scan": sql.OP2,
    "op3_exact_dedup": sql.OP3,
    "op4_warc_zstd": sql.OP4,
    "op5_line_dedup": sql.OP5,
    "op7_ngram_jaccard": sql.OP7,
    "op10_mix_sources": sql.OP10,
    "op12_fill_in_middle": sql.OP12,
    "op13_filter_audit": sql.OP13,
}
