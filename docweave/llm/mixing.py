"""Mixing sources to target weights by nested hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.llm.store import materialize
from docweave.llm.text import WORD, filled

#: The hash has LEVELS * BITS bits; each level looks at the next BITS of them.
LEVELS, BITS = 3, 12


def hash36(id_col: Column, text: Column) -> Column:
    """The first nine hex digits of a row's MD5, as a number: where the row stands in the order of its source."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", id_col.cast("string"), F.md5(text))), 1, 9), 16, 10).cast("long")


def source_targets(rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Per source key: source_size, target, copies that every document gets, and words still missing (rest).

    Sources in code point order, null last, take the weights in turn. The budget, share times all
    sizes, is divided by weight; a source stops at most times its size and the excess goes to the
    others. That is a common level of target by weight, found from running sums in the order in
    which sources reach their stop. The table has one row per source, so windows without partition
    are no load; all of it stays on the executors.
    """
    sizes = rows.groupBy("key").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    n = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), n + 1)
    by_stop = Window.orderBy("stop", "source")
    at = (
        sizes.withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("stop", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(Window.partitionBy(F.lit(0))) * F.lit(float(share)))
        .withColumn(
            "stopped", F.coalesce(F.sum("cap").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        )
        .withColumn("left", F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("stopped")) / F.col("left"))
        .withColumn("fits", F.when(F.col("level") <= F.col("stop"), F.col("level")))
        .withColumn(
            "common",
            F.first("fits", ignorenulls=True).over(
                by_stop.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ),
        )
    )
    target = F.coalesce(F.least(F.col("common") * F.col("weight"), F.col("cap")), F.col("cap"))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return (
        at.withColumn("target", target)
        .withColumn("copies", copies.cast("long"))
        .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
        .select("key", "source_size", "target", "copies", "rest")
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies; with carry, the struct carried.

    Size is the number of words. Every document of a source gets the whole copies that fit into
    the source's target. For the rest, documents whose hash lies below the source's threshold get
    one more: sums by (source, top bits of the hash) place the threshold in a bucket, and only rows
    of that boundary bucket are summed again by the next bits, LEVELS times. Nothing is sorted;
    taken words fall short of the target by less than what the last bucket holds, in general one
    document. No document is taken more than `most` times.

    Sums per source are partial on every task, so a hot source is no hot task. Only a light table
    of ids, sizes and hashes is read again; the text is scanned once. Null text: size 0; null
    sources are one source, the last. Rows with equal id and text share their fate. An empty table
    gives an empty result; a source without words has target 0.
    """
    text = filled(F.col(text_col))
    extra = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_carry")] if carry else []
    source = F.col(source_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        hash36(F.col(id_col), text).alias("hash"),
        *extra,
    )
    rows = materialize(rows, "mix-rows")
    plan = materialize(
        source_targets(rows, weights, share, most).withColumn("threshold", F.lit(0).cast("long")), "mix-targets"
    )
    for level in range(LEVELS):
        plan = materialize(_refined(rows, plan, BITS * (LEVELS - 1 - level)), f"mix-level{level}")
    out = rows.join(plan, "key")
    copies = F.col("copies") + (F.col("hash") < F.col("threshold")).cast("long")
    return out.select(
        "doc_id",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        (F.col("size") * copies).alias("taken"),
        copies.alias("copies"),
        *([F.col("_carry").alias("carried")] if carry else []),
    )


def _refined(rows: DataFrame, plan: DataFrame, shift: int) -> DataFrame:
    """The plan with thresholds moved to the start of the boundary bucket of 2**shift hashes, and rest less what lies before it."""
    window = 1 << (shift + BITS)
    inside = rows.join(plan.select("key", "threshold"), "key").where(
        (F.col("hash") >= F.col("threshold")) & (F.col("hash") < F.col("threshold") + window)
    )
    sums = inside.groupBy("key", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.partitionBy("key").orderBy("bucket"))
    fits = (
        sums.withColumn("upto", running)
        .join(plan.select("key", "rest"), "key")
        .groupBy("key")
        .agg(
            F.min(F.when(F.col("upto") > F.col("rest"), F.col("bucket"))).alias("boundary"),
            F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("before"),
        )
    )
    moved = F.when(F.col("boundary").isNotNull(), F.shiftleft("boundary", shift)).otherwise(
        F.col("threshold") + window
    )
    return plan.join(fits, "key", "left").select(
        "key",
        "source_size",
        "target",
        "copies",
        (F.col("rest") - F.coalesce("before", F.lit(0))).alias("rest"),
        moved.cast("long").alias("threshold"),
    )
