"""Chapter trees from page-ordered lines: contents entries and headings, merged, bounded and nested."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions.text import TITLE_RULES, chapter_level, chapter_number, redact, stable_id
from docweave.operators.relational import ordered_list, page_ends, subtree_ends, tree_parents
from docweave.sources.documents import stored

#: How the number of a heading is written.
_NUMBER = r"(?:第\s*[一二三四五六七八九十百千万零〇两\d]+\s*章|chapter\s+[A-Za-z0-9.-]+|\d+(?:\.\d+)*)"
HEADING = rf"(?iU)^({_NUMBER})\s*(.+?)\s*$"
CONTENTS = rf"(?iU)^({_NUMBER})\s+(.+?)\s*(?:\.{{2,}}|…+|\s{{2,}})\s*(\d{{1,4}})\s*$"
ORDER = ("place", "sort_key", "id")


def _part(pattern: str, group: int) -> Column:
    return F.regexp_extract("line", pattern, group)


def _titled(df: DataFrame, pattern: str) -> DataFrame:
    title = redact(F.regexp_replace(F.trim(F.regexp_replace(_part(pattern, 2), r"(?U)\s+", " ")), r"^[ .…]+|[ .…]+$", ""), TITLE_RULES)
    return df.withColumn("number", _part(pattern, 1)).withColumn("title", title).withColumn("key", chapter_number(F.col("number")))


def contents_entries(lines: DataFrame) -> DataFrame:
    """(source_id, page, line_no, number, title, key, printed_page): lines with leaders, or any such on a page that says contents."""
    says = F.col("line").contains("目录") | F.lower("line").isin("contents", "table of contents")
    pages = lines.groupBy("source_id", "page").agg(F.bool_or(says).alias("likely"))
    hit = lines.where(F.col("line").rlike(CONTENTS)).join(pages, ["source_id", "page"])
    hit = hit.where(F.col("likely") | F.col("line").rlike(r"\.{2,}|…+"))
    return _titled(hit, CONTENTS).withColumn("printed_page", _part(CONTENTS, 3).cast("int")).drop("likely")


def headings(lines: DataFrame) -> DataFrame:
    """(source_id, page, line_no, number, title, key) of numbered headings in the text."""
    hit = lines.where(~F.col("line").rlike(CONTENTS) & F.col("line").rlike(HEADING) & (F.length(_part(HEADING, 2)) >= 2))
    return _titled(hit, HEADING)


def merged_entries(toc: DataFrame, body: DataFrame) -> DataFrame:
    """One row per source and key that either side has: where it starts, what the contents say, how sure that is."""
    first = lambda: F.min(F.struct("page", "line_no", "number", "title"))
    b = body.groupBy("source_id", "key").agg(first().alias("b"), F.countDistinct("page").alias("b_pages"), F.count(F.lit(1)).alias("b_n"))
    c = toc.groupBy("source_id", "key").agg(first().alias("c"), F.countDistinct("printed_page").alias("c_pages"), F.min("printed_page").alias("toc_page"))
    both = b.join(c, ["source_id", "key"], "full_outer")
    chosen = F.coalesce("b", "c")
    doubtful = (F.coalesce("b_pages", F.lit(0)) > 1) | (F.coalesce("c_pages", F.lit(0)) > 1)
    sure = F.when(F.col("b").isNotNull() & F.col("c").isNotNull() & ~doubtful, 0.95).when(F.col("b").isNotNull(), 0.72).otherwise(0.35)
    return both.select(
        "source_id", "key", chosen["number"].alias("number"), chosen["title"].alias("title"), stable_id(F.col("key"), chosen["title"]).alias("id"),
        chapter_level(F.col("key")).alias("level"), "toc_page", F.col("b.page").alias("page_start"), sure.alias("confidence"),
        (doubtful | F.col("b").isNull() | F.col("c").isNull()).alias("doubtful"), (F.coalesce("b_n", F.lit(0)) > 1).alias("repeated"),
    )


def chapter_tree(lines: DataFrame) -> DataFrame:
    """(source_id, id, parent_id, number, title, level, toc_page, page_start, page_end, confidence, needs_confirmation).

    Entries stand in the order of page, number and id; one ends before the next starts, a parent
    with its last descendant. Levels nest to any depth: those that occur are looked up first. Doubt
    about an entry, or any warning of its source, asks for confirmation.
    """
    toc, body = contents_entries(lines), headings(lines)
    entries = merged_entries(toc, body)
    digits = F.transform(F.regexp_extract_all("key", F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    entries = entries.withColumn("place", F.coalesce("page_start", F.lit(10**9))).withColumn(
        "sort_key", F.when(F.size(digits) > 0, digits).otherwise(F.array(F.lit(10**9)))
    )
    last = lines.groupBy("source_id").agg(F.max("page").alias("last_page"))
    titles = Window.partitionBy("source_id", F.lower("title"))
    entries = entries.join(last, "source_id").withColumn("repeated", F.col("repeated") | (F.count(F.lit(1)).over(titles) > 1))
    bounded = page_ends(entries, "source_id", "page_start", ORDER, F.col("last_page"))
    source = Window.partitionBy("source_id")
    warned = F.max(F.col("repeated")).over(source) | F.col("warned") | (F.count("toc_page").over(source) == 0)
    bounded = bounded.withColumn("needs_confirmation", F.col("doubtful") | F.col("repeated") | warned)
    keys = toc.select("key").union(body.select("key"))
    levels = sorted(r[0] for r in keys.select(chapter_level(F.col("key"))).distinct().collect())
    nested = subtree_ends(tree_parents(bounded, "source_id", ORDER, levels), "source_id", ORDER, levels)
    return nested.withColumn("page_end", F.when(F.col("page_start").isNotNull(), F.col("subtree_end"))).select(
        "source_id", "id", "parent_id", "key", "number", "title", "level", "toc_page", "page_start", "page_end", "confidence", "needs_confirmation"
    )


def pages_of_chapters(tree: DataFrame) -> DataFrame:
    """(source_id, page, id, level): each page with the chapters that hold it, by expanding their bounded ranges."""
    ranged = tree.where("page_start is not null and page_end >= page_start")
    return ranged.select("source_id", F.explode(F.sequence("page_start", "page_end")).alias("page"), "id", "level")


#: Chapters of one range that share a copy of its text.
_SHARED = 256


def texts_of_chapters(tree: DataFrame, lines: DataFrame, order: Sequence[str], value: str) -> DataFrame:
    """tree's rows with `body`: the values of the lines on a chapter's pages, in order, one below the other; others are left out.

    Chapters that begin on one page often have the same range, and a page of contents can hold most lines of a source. So
    lines are put together once for each range, and its chapters meet that text, _SHARED of them a copy.
    """
    span = ["source_id", "page_start", "page_end"]
    tree = stored(tree.where("page_start is not null and page_end >= page_start"), "tree")
    ranges = tree.groupBy(span).agg(F.ceil(F.count(F.lit(1)) / _SHARED).cast("int").alias("_copies"))
    pages = ranges.select(*span, F.explode(F.sequence("page_start", "page_end")).alias("page"))
    bodies = pages.join(lines, ["source_id", "page"]).groupBy(span).agg(ordered_list(order, value, "\n").alias("body"))
    copies = ranges.join(bodies.hint("merge"), span).select(*span, F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy"), "body")
    members = tree.join(ranges, span).withColumn("_copy", F.pmod(F.xxhash64("id"), F.col("_copies")).cast("int"))
    return members.join(copies.hint("merge"), [*span, "_copy"]).drop("_copy", "_copies")
