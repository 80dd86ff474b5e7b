"""What each filter takes from the others: masks of failed filters, counted as a stream that retracts."""

from __future__ import annotations

import itertools
import string
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.llm.store import discard, materialize, new_path
from docweave.llm.text import filled

#: The filter that depends on other documents: it fails texts that stand under a smaller id too.
COPIES = "E"
ROW = "hash binary, part string, mask int, good boolean, toxic boolean, id long, n long"
DELTA = "part string, mask int, good boolean, toxic boolean, n long"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that one text decides, by letter."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    words = F.array_remove(F.split(spaced, " ", -1), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, string.ascii_uppercase, ""))
    return {
        "A": n < 100,
        "B": distinct.cast("long") * 100 < n.cast("long") * 80,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 10,
        "D": text.rlike(r"[#$%&*|]"),
    }


def document_stream(spark: SparkSession, path: str, micro_batches: int = 4) -> DataFrame:
    """The Parquet files at path as a stream that takes about so many micro-batches, by bytes, at any number of files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    length = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.option("maxBytesPerTrigger", max(1, -(-length // micro_batches))).parquet(f"{path}*")


def _masked(docs: DataFrame, filters: Mapping[str, Column], id_col: str, text: Column, part: Column) -> DataFrame:
    """hash, part, mask, id of every row; texts end here."""
    letters = sorted([*filters, COPIES])
    mask = sum((F.when(c, 1 << letters.index(k)).otherwise(0) for k, c in filters.items()), F.lit(0))
    return docs.select(
        F.unhex(F.sha2(text, 256)).alias("hash"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.col(id_col).cast("long").alias("id")
    )


def _grouped(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(hash, part, mask, good, toxic): n rows, the smallest id, and n_first rows of that id.

    Ids meet their labels once; null ids are spread by their hash and meet none. The counts by id need no
    shuffle of their own, and those by hash are partial on every task, so a hot text is no hot key.
    """
    key = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("-"), F.hex("hash"))).alias("key")
    marked = rows.select(key, "*").join(labels, "key", "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    by_id = marked.select("key", "hash", "part", "mask", *flags, "id").groupBy("key", "hash", "part", "mask", "good", "toxic", "id").agg(F.count(F.lit(1)).alias("k"))
    return by_id.groupBy("hash", "part", "mask", "good", "toxic").agg(
        F.coalesce(F.sum(F.when(F.col("id").isNotNull(), F.col("k"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("k"))), F.lit(0)).alias("n_null"),
        F.min("id").alias("id"),
        F.min_by("k", "id").alias("n_first"),
    )


def audit_stream(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents by the set of filters that they fail, bit 0 for A to bit 4 for E.

    All files of the stream are taken as available-now micro-batches. Of every text the state holds
    the smallest id so far, with the part, mask and labels of its rows. A micro-batch is reduced to one row
    for each text, part and labels, and meets the state by the text's hash: a row above the smallest id
    counts as a copy (E); where a smaller id comes, what the earlier holder counted as no copy is
    retracted from its part's counter and counted as a copy. The counters are the sums of these changes.

    State and changes are tables, to which every micro-batch appends under its number: one that is done
    again after a failure writes over its own and reads only earlier ones, so each counts once. A holder
    that was displaced stays in the table and is passed over. Null texts are empty ones, null parts the
    empty string. A null id is smaller than none and has no labels, so its row is no copy and makes none.
    Rows that repeat the smallest id are no copies. An empty stream gives no rows.
    """
    folder = new_path(docs.sparkSession, "audit")
    marks = labels.groupBy(F.col(id_col).cast("string").alias("key")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    marks = materialize(marks.where("key is not null"), "audit-labels")
    text = filled(F.col(text_col))
    copy = 1 << sorted([*text_filters(text), COPIES]).index(COPIES)

    done: set[int] = set()

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = _grouped(_masked(batch, text_filters(text), id_col, text, F.col(part_col)), spark.read.schema(marks.schema).parquet(marks._written))
        new = materialize(rows, "audit-batch")
        same = ["hash", "part", "mask", "good", "toxic"]
        held = new.where("id is not null").select(*same, "id", F.col("n_first").alias("n"), F.lit(False).alias("old"))
        if paths := [f"{folder}/state/{i}" for i in sorted(done) if i < number]:
            held = held.union(spark.read.schema(ROW).parquet(*paths).select(*same, "id", "n", F.lit(True).alias("old")))
        by_text = Window.partitionBy("hash")
        met = held.withColumn("least", F.min("id").over(by_text)).withColumn("before", F.min(F.when(F.col("old"), F.col("id"))).over(by_text))
        met = materialize(met.where("not old or (id = before and before > least)"), "audit-met")
        first = met.where("not old and id = least")
        first.select(*same, "id", "n").write.mode("overwrite").parquet(f"{folder}/state/{number}")
        kind = ["part", "mask", "good", "toxic"]
        as_copy = [F.col("part"), F.col("mask").bitwiseOR(F.lit(copy)).alias("mask"), F.col("good"), F.col("toxic")]
        gone = met.where("old")
        changes = [
            new.select(*as_copy, "n"), new.select(*kind, F.col("n_null").alias("n")),
            first.select(*kind, "n"), first.select(*as_copy, (-F.col("n")).alias("n")),
            gone.select(*kind, (-F.col("n")).alias("n")), gone.select(*as_copy, "n"),
        ]
        total = changes[0]
        for c in changes[1:]:
            total = total.union(c)
        total.groupBy(*kind).agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/changes/{number}")
        discard(new, met)
        done.add(number)

    query = docs.writeStream.foreachBatch(step).trigger(availableNow=True).option("checkpointLocation", f"{folder}/offsets").start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    spark = docs.sparkSession
    paths = [f"{folder}/changes/{i}" for i in sorted(done)]
    changes = spark.read.schema(DELTA).parquet(*paths) if paths else spark.createDataFrame([], DELTA)
    counts = changes.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    return materialize(counts.where("n <> 0"), "audit-counters")


def filter_orders(counters: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row for each part, order of the filters and step: what the step keeps, removes and loses, and the filter's Shapley sum.

    The counters have at most 2**len(letters) masks and four label pairs for each part, and each is
    set against the fixed list of orders and steps. Without rows of a part there is no report of it.
    """
    steps = [("".join(o), i + 1) for o in itertools.permutations(letters) for i in range(len(letters))]
    bit = {k: 1 << i for i, k in enumerate(letters)}
    rows = [(o, i, o[i - 1], bit[o[i - 1]], sum(bit[k] for k in o[: i - 1])) for o, i in steps]
    plan = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("filter_order", "step", "letter", "own", "before"), strict=True)]) for r in rows])
    by_mask = counters.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("bad"),
    )
    at = by_mask.select("part", "mask", "n", "good", "bad", F.explode(plan).alias("s")).select("part", "mask", "n", "good", "bad", "s.*")
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda when, what: F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    report = at.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~earlier, "n").alias("kept"),
        total(fails & ~earlier, "n").alias("removed"),
        total(fails & earlier, "n").alias("redundant"),
        total(F.col("mask") == F.col("own"), "n").alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "bad").alias("toxic_lost"),
    )
    return report.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")
