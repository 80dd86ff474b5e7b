"""Joins, aggregates, windows, orders and set operations over courses, chapters, topics, runs and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LIVE = ("CONFIRMED", "COMPLETED")
PENDING = ("PENDING", "RUNNING", "FAILED")
TERMINAL = ("COMPLETED", "FAILED", "CANCELLED")


def ordered_list(order: Sequence[str], value: str, separator: str = ",") -> Column:
    """Values of a group in the order of some columns, joined into one string."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("string").alias("_v"))))
    return F.array_join(F.transform(items, lambda x: x["_v"]), separator)


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the compact JSON of columns, nulls kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def first_match(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def newest_first(df: DataFrame, time: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(time), key)


def with_status(df: DataFrame, *status: str) -> DataFrame:
    return df.where(F.col("status").isin(*status))


def reuse_by_hash(work: DataFrame, done: DataFrame, work_key: str, done_key: str, order: Sequence[str]) -> DataFrame:
    """Every work row with the first finished row of its hash, if any; one row per hash on the right."""
    once = first_match(done, done_key, order)
    return work.join(once, F.col(work_key) == F.col(done_key), "left")


def work_list(work: DataFrame, done: DataFrame, work_key: str, done_key: str, order: Sequence[str]) -> DataFrame:
    """One row for each hash that nothing finished has: the first that asks for it."""
    unseen = work.join(done, F.col(work_key) == F.col(done_key), "left_anti")
    return first_match(unseen, work_key, order)


def nest(parents: DataFrame, children: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Parents with how many children they have and their values in order."""
    lists = children.groupBy(key).agg(F.count(F.lit(1)).alias("n_children"), ordered_list(order, value).alias("children"))
    joined = parents.join(lists, key, "left")
    return joined.withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("children", F.coalesce("children", F.lit("")))


def topic_reviews(links: DataFrame, chapters: DataFrame, reviews: DataFrame) -> DataFrame:
    """Chapters of each topic with the state of their review."""
    review = reviews.where("round_key = 'review'").select("chapter_id", F.col("status").alias("review_status"), "stale")
    return (
        links.join(chapters.select("chapter_id", "title", "status"), "chapter_id")
        .join(review, "chapter_id", "left")
        .withColumn("stale", F.coalesce("stale", F.lit(False)))
    )


def _blocking() -> Column:
    return (F.coalesce("review_status", F.lit("")) != "DONE") | F.col("stale")


def readiness(topics: DataFrame, reviewed: DataFrame) -> DataFrame:
    """DRAFT if unconfirmed or without chapters, READY if every chapter's review is done and fresh, else NOT_READY."""
    state = reviewed.groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("n_chapters"), F.count_if(_blocking()).alias("n_blocking")
    )
    joined = topics.join(state, "topic_id", "left")
    return joined.withColumn(
        "readiness",
        F.when(~F.col("confirmed") | F.col("n_chapters").isNull(), "DRAFT").when(F.col("n_blocking") > 0, "NOT_READY").otherwise("READY"),
    ).fillna(0, ["n_chapters", "n_blocking"])


def blocking_chapters(reviewed: DataFrame) -> DataFrame:
    return reviewed.where(_blocking()).groupBy("topic_id").agg(ordered_list(["chapter_id"], "chapter_id").alias("blocking"))


def outline(chapters: DataFrame, sources: DataFrame, reviews: DataFrame, notes: DataFrame) -> DataFrame:
    """Chapters with source title, finished review and their notes in order."""
    review = reviews.where("round_key = 'review' and status = 'DONE' and not stale").select("chapter_id", F.col("output").alias("review"))
    listed = notes.groupBy("chapter_id").agg(ordered_list(["seq", "kind", "note_id"], "content", "|").alias("notes"))
    return (
        chapters.join(sources.select("source_id", F.col("title").alias("source_title")), "source_id", "left")
        .join(review, "chapter_id", "left")
        .join(listed, "chapter_id", "left")
    )


def snapshot(parents: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Per key the ordered fields of its rows and their fingerprint."""
    text = F.concat_ws("~", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in fields])
    lists = parents.withColumn("_t", text).groupBy(key).agg(F.count(F.lit(1)).alias("n"), ordered_list(order, "_t", ";").alias("snapshot"))
    return lists.withColumn("fingerprint", F.sha2("snapshot", 256))


def published(topics: DataFrame, *evidence: DataFrame) -> DataFrame:
    """Topics with a flag that says whether any evidence table names them."""
    keys = evidence[0].select("topic_id")
    for e in evidence[1:]:
        keys = keys.union(e.select("topic_id"))
    return topics.join(keys.distinct().withColumn("published", F.lit(True)), "topic_id", "left").fillna(False, ["published"])


def uncovered(chapters: DataFrame, links: DataFrame) -> DataFrame:
    return chapters.join(links, "chapter_id", "left_anti")


def violations_of_ownership(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is missing or belongs to another course."""
    owner = parents.select(key, F.col("course_id").alias("owner_course"))
    return children.join(owner, key, "left").where("owner_course is null or owner_course <> course_id")


def by_key_parts(*parts: str) -> Column:
    """A cache key of several columns."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def contiguity(df: DataFrame, key: str, page: str) -> DataFrame:
    """Whether the pages of each key run from the first to the last without gap or repeat."""
    p = F.col(page)
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.min(p).alias("first_page"),
        F.max(p).alias("last_page"),
        ((F.count(F.lit(1)) == F.countDistinct(p)) & (F.countDistinct(p) == F.max(p) - F.min(p) + 1)).alias("contiguous"),
    )


def duplicate_keys(df: DataFrame, key: Column) -> DataFrame:
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def batch_outcome(tasks: DataFrame) -> DataFrame:
    """COMPLETED only if all tasks are; else the worst that happened."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    done = F.bool_and(F.col("status") == "COMPLETED")
    return tasks.groupBy("batch_id").agg(
        F.when(done, "COMPLETED").when(is_("BLOCKED") > 0, "BLOCKED").when(is_("FAILED") > 0, "FAILED").when(is_("CANCELLED") > 0, "CANCELLED").otherwise("RUNNING").alias("outcome"),
        F.count(F.lit(1)).alias("n_tasks"),
    )


def page_ends(entries: DataFrame, key: str, start: str, order: Sequence[str], last: Column) -> DataFrame:
    """page_end by the next start: one before it, the same page (with a clash) if it isn't later, else the last page.

    The next start is the last one before in the order from behind: a frame that ends with its group is read anew for each row.
    """
    behind = Window.partitionBy(key).orderBy(*_backwards(order)).rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    s, nxt = F.col(start), F.last(start, ignorenulls=True).over(behind)
    out = entries.withColumn("_next", nxt).withColumn("clash", F.coalesce(F.col("_next") <= s, F.lit(False)) & s.isNotNull())
    end = F.when(s.isNull(), F.lit(None)).when(F.col("clash"), s).when(F.col("_next").isNotNull(), F.col("_next") - 1).otherwise(last)
    return out.withColumn("page_end", end).withColumn("warned", F.max("clash").over(running)).drop("_next")


def _backwards(order: Sequence[str]) -> list[Column]:
    return [F.desc(c) for c in order]


def tree_parents(entries: DataFrame, key: str, order: Sequence[str], levels: Sequence[int]) -> DataFrame:
    """parent_id: the nearest earlier entry of a smaller level, one running column for each of the levels that occur."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    nearest = {f"_p{k}": F.last(F.when(F.col("level") < k, F.col("id")), ignorenulls=True).over(before) for k in levels}
    parent = F.coalesce(F.lit(None).cast(entries.schema["id"].dataType), *[F.when(F.col("level") == k, F.col(f"_p{k}")) for k in levels])
    return entries.withColumns(nearest).withColumn("parent_id", parent).drop(*nearest)


def subtree_ends(entries: DataFrame, key: str, order: Sequence[str], levels: Sequence[int]) -> DataFrame:
    """subtree_end: the largest page_end among the descendants of an entry, else its own.

    A descendant stands between an entry and the next one of the same or a smaller level; levels are
    all that occur. For each level, entries of it or a smaller one begin a new run, and the rest of a run are descendants
    of its first entry: no entry meets another one.
    """
    running = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = {f"_r{k}": F.sum(F.when(F.col("level") <= k, 1).otherwise(0)).over(running) for k in levels}
    below = {f"_b{k}": F.max(F.when(F.col("level") > k, F.col("page_end"))).over(Window.partitionBy(key, f"_r{k}")) for k in levels}
    end = F.coalesce(*[F.when(F.col("level") == k, F.col(f"_b{k}")) for k in levels], "page_end")
    return entries.withColumns(runs).withColumns(below).withColumn("subtree_end", end).drop(*runs, *below)


def ring(events: DataFrame, keep: int) -> DataFrame:
    """The newest `keep` events of each batch."""
    w = Window.partitionBy("batch_id").orderBy(F.desc("seq"))
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def replay(events: DataFrame, keep: int, since: int) -> DataFrame:
    return ring(events, keep).where(F.col("seq") > since)
