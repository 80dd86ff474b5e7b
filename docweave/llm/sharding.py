"""Reproducible shuffle into shards: a Feistel permutation of global row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.llm.store import materialize
from docweave.llm.text import filled

#: Buckets by which rows are numbered; the table of their offsets has this many rows at any input size.
BUCKETS = 4096
#: Half-rounds of the Feistel network, and the walks that are tried inside one expression.
HALF_ROUNDS, WALKS = 6, 64


def feistel(x: Column, a: Column, b: Column, seed: int) -> Column:
    """A permutation of 0 .. a*b-1: halves x // b and x % b, changed in turn by the hash of the other."""
    left, right = F.floor(x / b), F.pmod(x, b)
    for k in range(HALF_ROUNDS):
        if k % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed + k).cast("long")), a), a)
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(seed + k).cast("long")), b), b)
    return left * b + right


def permuted(x: Column, total: Column, seed: int) -> Column:
    """A permutation of 0 .. total-1 by cycle walking: apply feistel() until the value is below total.

    a*b exceeds total by less than 2*sqrt(total)+1, and the values that a walk passes above total
    are distinct. WALKS steps are therefore certain to be enough up to total = 900, and beyond that
    a longer walk has a probability below (2/sqrt(total))**WALKS; it raises an error rather than
    give a wrong place.
    """
    a = F.ceil(F.sqrt(total.cast("double")))
    b = F.ceil(total.cast("double") / a)
    step = lambda y: feistel(y, a, b, seed)
    walked = F.aggregate(
        F.sequence(F.lit(2), F.lit(WALKS)), step(x), lambda y, _: F.when(y < total, y).otherwise(step(y))
    )
    first = step(x)
    return F.when(first < total, first).when(walked < total, walked).otherwise(
        F.raise_error(F.lit("cycle walking did not end")).cast("long")
    )


def shard_documents(
    docs: DataFrame,
    n_shards: int = 8,
    seed: int = 20240,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard; with carry, the struct carried.

    Rows get the global numbers 0 .. N-1 in the order of (hash bucket, id, crc, size): counts per
    bucket give offsets, and a window inside each bucket gives the rest, so no task sees all rows.
    A Feistel permutation with cycle walking maps the number g to a place p; shard = p mod
    n_shards and slot = p div n_shards. Shard counts thus differ by one at most (law "rows"), slots
    have no gaps, and anyone who knows g, N and the seed can compute the place. grown_shard belongs
    to another law and is null. Size is the UTF-8 bytes of the text plus 1.

    The text isn't shuffled, only its size and CRC-32. Rows with equal ids and texts are
    interchangeable and get different places. Null text: size 1, CRC 0; null ids are numbered like
    others. An empty table gives an empty result.
    """
    text = filled(F.col(text_col))
    extra = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_carry")] if carry else []
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *extra,
    )
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(BUCKETS)).cast("int"))
    rows = materialize(rows, "shard-rows")
    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("bucket")
        .count()
        .select("bucket", F.coalesce(F.sum("count").over(whole), F.lit(0)).alias("before"), "count")
        .withColumn("total", F.sum("count").over(Window.partitionBy(F.lit(0))))
        .drop("count")
    )
    inside = Window.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(inside)).join(F.broadcast(offsets), "bucket")
    numbered = numbered.withColumn("g", F.col("before") + F.col("place") - 1)
    placed = numbered.withColumn("p", permuted(F.col("g"), F.col("total"), seed))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("p", F.lit(n_shards)).cast("int").alias("shard"),
        F.floor(F.col("p") / n_shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *([F.col("_carry").alias("carried")] if carry else []),
    )
