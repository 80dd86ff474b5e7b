"""Labels of sources in texts and cards: which are cited, in which order, and which are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import text as x
from docweave.operators.ordering import places


def cited_labels(texts: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, label, place): the distinct labels that the texts of a key cite, numbered from 1 as they are first seen.

    Texts are read by `order`, each from its start; of texts alike in order the one whose label stands first counts, then
    labels follow their own order. A null text cites nothing, a null key is a key, a null order comes first. The first
    place of a label is a partial minimum, so a label that most texts cite isn't gathered anywhere.
    """
    seen = texts.select(F.col(key), F.col(order).alias("_at"), F.posexplode(x.source_labels(F.col(text))).alias("_pos", "label"))
    first = seen.groupBy(key, "label").agg(F.min(F.struct("_at", "_pos")).alias("_first"))
    return places(first, [key], ["_first._at", "_first._pos", "label"]).select(key, "label", "place")


def label_coverage(
    expected: DataFrame, texts: DataFrame, refs: DataFrame, key: str, text: str = "content", ref: str = "ref", tasks: int | None = None
) -> DataFrame:
    """(key, n_labels, in_text, in_refs, missing) of the keys in expected, a table of (key, label).

    A label is covered if a text of its key cites it or a card of its key refers to it; `missing` counts the others. Repeated
    labels count once; labels that aren't expected, null labels and null keys count nowhere. The three tables meet by (key,
    label) in one aggregate, reduced before the shuffle, so that a key with most labels is spread over many tasks.

    Nearly all pairs differ, so what reduces them holds most of the rows of its task: `tasks`, a number that follows the
    input, deals the rows out first by pair and by the task that read them, so that it holds few of them and a pair that
    most rows have is still in many tasks.
    """
    mark = lambda df, label, name: df.select(
        F.col(key), label.alias("label"), *[F.lit(n == name).alias(n) for n in ("_wanted", "_text", "_ref")]
    )
    rows = mark(expected, F.col("label"), "_wanted")
    rows = rows.unionByName(mark(texts, F.explode(x.source_labels(F.col(text))), "_text")).unionByName(mark(refs, F.col(ref), "_ref"))
    rows = rows.where(F.col("label").isNotNull() & F.col(key).isNotNull())
    if tasks:
        rows = rows.withColumn("_from", F.spark_partition_id()).repartition(tasks, key, "label", "_from").drop("_from")
    each = rows.groupBy(key, "label").agg(*[F.max(n).alias(n) for n in ("_wanted", "_text", "_ref")]).where("_wanted")
    return each.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_labels"), F.count_if("_text").alias("in_text"), F.count_if("_ref").alias("in_refs"),
        F.count_if(~F.col("_text") & ~F.col("_ref")).alias("missing"),
    )
