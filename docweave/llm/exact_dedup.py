"""Exact deduplication by a 128-bit content hash with a byte comparison inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.store import materialize
from docweave.llm.text import ascii_lower, filled


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest"
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the
    smallest (keep="smallest") or largest id stays. Texts meet on their MD5; within such a group
    every text is compared with the text of the row that stays, and texts that differ (a hash
    collision) form groups of their own.

    Only rows whose hash repeats carry their text through the comparison. Hash groups are written
    out before they are joined, so that a group of a third of all rows is split by skew handling:
    its text side is a plain exchange and its other side has one row.

    Null text counts as empty. A null id loses against any other; a group of null ids only has a
    null keep_id and every row is kept. Rows that repeat the id that stays are all kept: nothing
    tells them apart. Other columns are ignored; an empty table gives an empty result.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    norm = ascii_lower(filled(F.col(text_col)))
    keyed = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).select(
        "doc_id", "norm", F.unhex(F.md5("norm")).alias("h")
    )
    groups = materialize(
        keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), pick("doc_id").alias("keep_id")).where("n > 1"),
        "dedup-groups",
    )
    different = _collisions(keyed, groups)
    rows = keyed.select("doc_id", "h", F.sha2("norm", 256).alias("sha")).join(groups, "h", "left")
    keep_id, size = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")), F.coalesce("n", F.lit(1))
    if not different.isEmpty():
        apart = different.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("own_n"), pick("doc_id").alias("own_keep"))
        apart = apart.select("h", F.sha2("norm", 256).alias("sha"), "own_n", "own_keep")
        lost = different.groupBy("h").agg(F.count(F.lit(1)).alias("lost"))
        rows = rows.join(lost, "h", "left").join(apart, ["h", "sha"], "left")
        keep_id = F.when(F.col("own_n").isNull(), keep_id).otherwise(F.col("own_keep"))
        size = F.coalesce("own_n", F.col("n") - F.coalesce("lost", F.lit(0)), F.lit(1))
    return rows.select("doc_id", keep_id.alias("keep_id"), size.cast("long").alias("group_size"), "sha").select(
        "doc_id",
        "keep_id",
        "group_size",
        _same(F.col("doc_id"), F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _collisions(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows whose text differs from the text that their hash group keeps; nearly always none."""
    # Merge joins at every size: a broadcast below some size and a shuffle above it would not grow in proportion.
    members = materialize(keyed.join(groups.select("h", "keep_id").hint("merge"), "h"), "dedup-members")
    # One text for each hash: the rows that stay can be many, where ids are null or repeat. Written, so that the join is of two plain exchanges.
    kept = members.where(_same(F.col("doc_id"), F.col("keep_id"))).groupBy("h").agg(F.min("norm").alias("chosen"))
    kept = materialize(kept, "dedup-kept")
    differs = (members["h"] == kept["h"]) & (members["norm"] != kept["chosen"])
    return materialize(members.join(kept.hint("merge"), differs, "left_semi").select("doc_id", "h", "norm"), "dedup-collisions")
