"""Reading and writing documents, pages' states, images and bundles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPORTED = (".md", ".markdown", ".txt", ".pdf")
IMAGE = r"!\[[^\]]*\]\(data:image/([a-z]+);base64,([A-Za-z0-9+/=]+)\)"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = Path(tempfile.gettempdir(), "docweave").as_uri()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark then removes the shuffle files of a query when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(rows: DataFrame, name: str, compression: str = "snappy", confs: Mapping[str, str] | None = None) -> DataFrame:
    """The rows, written to the shared folder once and read from there however often they are used.

    The shuffle files behind them go as soon as they are written: nothing reads these again.
    """
    return stored_at(rows, scratch(rows.sparkSession, name), compression, confs)


def stored_at(rows: DataFrame, path: str, compression: str = "snappy", confs: Mapping[str, str] | None = None) -> DataFrame:
    """stored() at a path of its own; confs hold while the rows are written."""
    conf = rows.sparkSession.conf
    confs = {CLEANUP: "true"} | dict(confs or {})
    before = {k: conf.get(k, None) for k in confs}
    for k, v in confs.items():
        conf.set(k, v)
    try:
        rows.write.mode("overwrite").parquet(path, compression=compression)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def supported(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^.]+$", 0)).isin(*SUPPORTED)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): every file below path as one document."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def text_documents(named: DataFrame) -> DataFrame:
    """Write (name, text) as files of many documents each, a JSON line for every one, and read them back whole: (name, text)."""
    path = scratch(named.sparkSession, "texts")
    named.select("name", "text").write.json(path)
    return named.sparkSession.read.schema("name string, text string").json(path)


def write_and_read(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """Parquet partitioned by a bucket of the key, read back."""
    path = scratch(rows.sparkSession, "rows")
    rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).write.partitionBy("bucket").parquet(path)
    return rows.sparkSession.read.parquet(path).select(rows.columns)


def paged_anchors(docs: DataFrame, id_col: str, text_col: str, namespace: Column, prefix: str) -> DataFrame:
    """(id, page, para, anchor, text): pages at form feeds, paragraphs at blank lines, numbered anew on each page."""
    pages = docs.select(id_col, namespace.alias("ns"), F.posexplode(F.split(text_col, "\f", -1)).alias("p", "page_text"))
    paras = F.filter(F.transform(F.split("page_text", "\n\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    rows = pages.select(id_col, "ns", (F.col("p") + 1).alias("page"), F.posexplode(paras).alias("i", "text"))
    anchor = F.concat(F.lit(f"{prefix}:"), "ns", F.lit(":p"), "page", F.lit(":para"), F.col("i") + 1)
    return rows.select(id_col, "page", (F.col("i") + 1).alias("para"), anchor.alias("anchor"), "text")


def images(docs: DataFrame, keys: Sequence[str], md_col: str) -> DataFrame:
    """(keys, name, content): the pictures embedded in Markdown, numbered within their document."""
    kinds = F.regexp_extract_all(md_col, F.lit(IMAGE), F.lit(1))
    bodies = F.regexp_extract_all(md_col, F.lit(IMAGE), F.lit(2))
    rows = docs.select(*keys, F.posexplode(F.arrays_zip(kinds.alias("kind"), bodies.alias("body"))).alias("i", "x"))
    return rows.select(*keys, F.format_string("img_%03d.%s", "i", "x.kind").alias("name"), F.unbase64("x.body").alias("content"))


def without_images(md: Column) -> Column:
    """Markdown whose embedded pictures are replaced by their paths."""
    parts = F.split(F.regexp_replace(md, IMAGE, "\0$1\0"), "\0", -1)
    return F.array_join(
        F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.format_string("![](img_%03d.%s)", F.floor(i / 2).cast("int"), x)).otherwise(x)), ""
    )


def page_states(lines: DataFrame) -> DataFrame:
    """(page, fingerprint) of the accepted page states among JSON lines; broken and incomplete ones are left out."""
    state = F.from_json("value", "page long, status string, confidence long")
    rows = lines.select(state.alias("s")).select("s.*").where("page is not null and status = 'accepted'")
    return rows.select("page", F.sha2(F.to_json(F.struct("page", "status", "confidence")), 256).alias("fingerprint"))
