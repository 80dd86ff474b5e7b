"""The place of every row in an order, also where one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.sources.documents import scratch


def chunked(rows: DataFrame, by: Sequence[Column | str], chunks: int | None = None) -> DataFrame:
    """rows with `chunk`: ranges of the order of about equal size, in order, so that a hot key has many of them."""
    dealt = rows.repartitionByRange(chunks, *by) if chunks else rows.repartitionByRange(*by)
    return dealt.withColumn("chunk", F.spark_partition_id())


def places(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "place", chunks: int | None = None) -> DataFrame:
    """rows with their place, from 1, in ascending order within their keys; without keys, in the order of all rows.

    The rows are dealt by range over keys and order into chunks and written; counts for each key and chunk give the offset of
    each chunk, and rows are numbered inside their chunk. So no task holds all rows of a key, and none holds all rows. Null
    keys are a key; rows that are equal in keys and order get different places. Columns named _key, _by<n> and chunk give way.
    """
    spark = rows.sparkSession
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    given = rows.select("*", key.alias("_key"), *[c.alias(f"_by{i}") for i, c in enumerate(by)])
    sorts = [f"_by{i}" for i in range(len(by))]
    dealt = chunked(given, ["_key", *sorts], chunks)
    path = scratch(spark, "places")
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    earlier = Window.partitionBy("_key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_key", "chunk").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_key", "chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_key", "chunk").orderBy(*sorts))
    placed = dealt.withColumn("_inside", inside).join(offsets, ["_key", "chunk"])
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns if c != name], (F.col("_before") + F.col("_inside")).cast("long").alias(name))
