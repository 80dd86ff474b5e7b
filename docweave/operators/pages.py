"""Two readings of a page: match their blocks, type the differences, class the page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import compared, escalation_reason, iou, normalize_ocr_text, text_conflict
from docweave.operators.tables import TABLE, table_conflict
from docweave.sources.documents import scratch

#: The least overlap of a pair, and kinds of block that make a page complex.
LEAST_OVERLAP = 0.20
HARD_KINDS = ("table", "formula", "image", "list")


def _box() -> Column:
    return F.struct("x", "y", "width", "height")


#: Height of the bands in which blocks look for others; a page is one high.
BAND = 0.1


def _banded(blocks: DataFrame, side: str) -> DataFrame:
    """Each block in every band that it reaches into, with its first one."""
    first = F.floor(F.col("y") / BAND)
    reach = F.sequence(first, F.greatest(first, F.floor((F.col("y") + F.col("height")) / BAND)))
    return blocks.select("page_id", F.col("block_idx").alias(f"{side}_idx"), _box().alias(side), first.alias(f"{side}_first"), F.explode(reach).alias("band"))


def block_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(page_id, left_idx, right_idx): each left block in order takes the free right block that overlaps most.

    Blocks that overlap share a band of the page, and count once, in the first band that they share. Candidates of a page,
    sorted by left block, overlap and right block, are folded: a pair counts if neither side is taken, which is what
    choosing one by one gives.
    """
    met = _banded(left, "left").join(_banded(right, "right"), ["page_id", "band"]).where("band = greatest(left_first, right_first)")
    near = met.withColumn("score", iou(F.col("left"), F.col("right"))).where(F.col("score") >= LEAST_OVERLAP)
    lists = near.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("left_idx", (-F.col("score")).alias("rank"), "right_idx"))).alias("c")
    )
    empty = F.array().cast("array<struct<left_idx:int,right_idx:int>>")

    def step(acc: Column, c: Column) -> Column:
        taken = F.exists(acc, lambda p: (p["left_idx"] == c["left_idx"]) | (p["right_idx"] == c["right_idx"]))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(F.struct(c["left_idx"], c["right_idx"]))))

    return lists.select("page_id", F.explode(F.aggregate("c", empty, step)).alias("p")).select("page_id", "p.*")


def stored_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """block_pairs, written to the shared folder, since matched() and unmatched() read them three times."""
    return _stored(block_pairs(left, right), "pairs")


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def unmatched(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """(page_id, side, block_idx) of blocks that only one reading has."""
    out = None
    for side, blocks in (("left", left), ("right", right)):
        used = pairs.select("page_id", F.col(f"{side}_idx").alias("block_idx")).hint("merge")
        lone = blocks.join(used, ["page_id", "block_idx"], "left_anti").select("page_id", F.lit(side).alias("side"), "block_idx")
        out = lone if out is None else out.union(lone)
    return out


def matched(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs with text, type, order, height on the page and table of both sides; blocks without tables have none.

    Merge joins at every size: stored pairs are a few bytes a row in their file and many times that in a driver that
    would send them out whole.
    """
    cols = ("text", "type", "reading_order", "y", "table")
    tabled = [b if "table" in b.columns else b.withColumn("table", F.lit(None).cast(TABLE)) for b in (left, right)]
    a, b = (
        blocks.select("page_id", F.col("block_idx").alias(f"{side}_idx"), *[F.col(c).alias(f"{side}_{c}") for c in cols])
        for side, blocks in zip(("left", "right"), tabled, strict=True)
    )
    return pairs.hint("merge").join(a, ["page_id", "left_idx"]).hint("merge").join(b, ["page_id", "right_idx"])


def pair_conflicts(at: Callable[[str], Column] = F.col) -> Column:
    """The differences of a matched pair, in order; at() gives the columns of matched() by name."""
    both = lambda kind: (at("left_type") == kind) & (at("right_type") == kind)
    differ = ~at("left_text").eqNullSafe(at("right_text")) & (normalize_ocr_text(at("left_text")) != normalize_ocr_text(at("right_text")))
    found = F.array(
        text_conflict(at("left_text"), at("right_text")),
        F.when(both("formula") & (compared(at("left_text")) != compared(at("right_text"))), "formula_conflict"),
        F.when(both("table"), table_conflict(at("left_table"), at("right_table"))),
        F.when(both("page_number") & differ, "page_number_conflict"),
        F.when(both("footnote") & differ, "footnote_conflict"),
    )
    return F.array_compact(found)


def conflicts(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """(page_id, reason, left_idx, right_idx): differences of pairs, missing blocks, at most one change of order per page."""
    met = matched(left, right, pairs)
    typed = met.select("page_id", F.explode(pair_conflicts()).alias("reason"), "left_idx", "right_idx")
    lone = unmatched(left, right, pairs)
    number = lambda side: F.when(F.col("side") == side, F.col("block_idx"))
    missing = lone.select("page_id", F.lit("missing_block").alias("reason"), number("left").alias("left_idx"), number("right").alias("right_idx"))
    return typed.union(missing).union(order_conflicts(met))


def stored_conflicts(left: DataFrame, right: DataFrame) -> DataFrame:
    """conflicts of two readings, written to the shared folder."""
    return _stored(conflicts(left, right, stored_pairs(left, right)), "conflicts")


def order_conflicts(met: DataFrame) -> DataFrame:
    order = lambda side: F.transform(
        F.array_sort(F.collect_list(F.struct("left_idx", f"{side}_reading_order"))), lambda p: p[f"{side}_reading_order"]
    )
    pages = met.groupBy("page_id").agg(order("left").alias("l"), order("right").alias("r"), F.min(F.struct("left_idx", "right_idx")).alias("first"))
    return pages.where(F.col("l") != F.col("r")).select("page_id", F.lit("reading_order_conflict").alias("reason"), "first.left_idx", "first.right_idx")


def whole_pages(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """(page_id, l, r, p): the blocks of both readings of a page, by their number, and its pairs, in one row: each block is shuffled once."""
    held = ("block_idx", "type", "text", "reading_order", "table")
    tabled = [b if "table" in b.columns else b.withColumn("table", F.lit(None).cast(TABLE)) for b in (left, right)]
    parts = {"l": tabled[0].select("page_id", F.struct(*held).alias("l")), "r": tabled[1].select("page_id", F.struct(*held).alias("r")), "p": pairs.select("page_id", F.struct("left_idx", "right_idx").alias("p"))}
    none = {k: F.lit(None).cast(part.schema[k].dataType).alias(k) for k, part in parts.items()}
    rows = None
    for k, part in parts.items():
        part = part.select("page_id", *[k if k == n else none[n] for n in parts])
        rows = part if rows is None else rows.union(part)
    return rows.where("page_id is not null").groupBy("page_id").agg(*[F.collect_list(k).alias(k) for k in parts])


def page_conflicts() -> Column:
    """The rows of conflicts() for a row of whole_pages(), as array<struct<reason, left_idx, right_idx>>."""
    of = lambda blocks, idx: F.filter(blocks, lambda b: b["block_idx"] == idx)
    row = lambda reason, left, right: F.struct(reason.alias("reason"), left.cast("int").alias("left_idx"), right.cast("int").alias("right_idx"))
    none = F.lit(None).cast("int")

    def pair(q: Column) -> Column:
        one = lambda a: F.transform(of(F.col("r"), q["right_idx"]), lambda b: F.struct(q["left_idx"].alias("left_idx"), q["right_idx"].alias("right_idx"), a.alias("left"), b.alias("right")))
        return F.flatten(F.transform(of(F.col("l"), q["left_idx"]), one))

    def typed(m: Column) -> Column:
        at = lambda name: m[name.partition("_")[0]][name.partition("_")[2]]
        return F.transform(pair_conflicts(at), lambda reason: row(reason, m["left_idx"], m["right_idx"]))

    def lone(side: str) -> Column:
        used = F.transform("p", lambda q: q["left_idx" if side == "l" else "right_idx"])
        alone = F.filter(side, lambda b: ~F.coalesce(F.array_contains(used, b["block_idx"]), F.lit(False)))
        return F.transform(alone, lambda b: row(F.lit("missing_block"), b["block_idx"] if side == "l" else none, none if side == "l" else b["block_idx"]))

    def met(all_pairs: Column) -> Column:
        order = lambda side: F.transform(F.array_sort(F.transform(all_pairs, lambda m: F.struct(m["left_idx"], m[side]["reading_order"].alias("o")))), lambda z: z["o"])
        first = F.array_min(F.transform(all_pairs, lambda m: F.struct(m["left_idx"], m["right_idx"])))
        turned = F.filter(F.array(row(F.lit("reading_order_conflict"), first["left_idx"], first["right_idx"])), lambda _: order("left") != order("right"))
        return F.concat(F.flatten(F.transform(all_pairs, typed)), turned)

    once = F.transform(F.array(F.flatten(F.transform("p", pair))), met)
    return F.concat(F.get(once, F.lit(0)), lone("l"), lone("r"))


def page_status(n_conflicts: Column) -> Column:
    """The status of classes() for a row of whole_pages()."""
    of = lambda side: F.exists(side, lambda b: F.coalesce(b["type"].isin(*HARD_KINDS), F.lit(False)))
    hard = of("l") | of("r")
    return F.when(hard, "complex").when(n_conflicts > 0, "conflict").otherwise("consistent")


def classes(left: DataFrame, right: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, status): complex if any block is hard to read, else conflict or consistent."""
    kinds = left.select("page_id", "type").union(right.select("page_id", "type"))
    hard = kinds.groupBy("page_id").agg(F.bool_or(F.col("type").isin(*HARD_KINDS)).alias("hard"))
    bad = found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_conflicts"))
    status = F.when(F.col("hard"), "complex").when(F.col("n_conflicts") > 0, "conflict").otherwise("consistent")
    return hard.join(bad.hint("merge"), "page_id", "left").fillna(0, ["n_conflicts"]).select("page_id", status.alias("status"), "n_conflicts")


def reconcile(left: DataFrame, right: DataFrame, rate: float, found: DataFrame | None = None) -> DataFrame:
    """(page_id, status, n_conflicts, reason): every page's class and why, if at all, it goes to another engine.

    found are the conflicts of these readings, if they are there already.
    """
    if found is None:
        found = conflicts(left, right, stored_pairs(left, right))
    out = classes(left, right, found)
    reason = escalation_reason(F.col("status"), F.sha2(F.col("page_id").cast("string"), 256), F.col("page_id"), rate)
    return out.withColumn("reason", reason)
