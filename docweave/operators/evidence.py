"""Evidence of accepted pages: readings, their alignment and the decision as a chain of digests that can be checked again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import escalation_reason
from docweave.operators import pages as p
from docweave.operators.ledger import Executor
from docweave.sources.documents import stored as stored_rows

#: The links in order; each digest covers the one before and its own payload.
LINKS = ("observations", "alignment", "decision")


def reading_digest(blocks: Column) -> Column:
    """The digest of a reading's blocks in order, each by place, kind and text; of no block it is empty."""
    body = lambda b: F.struct(b["block_idx"].alias("block_idx"), F.concat_ws("\x1f", b["block_idx"].cast("string"), b["type"], b["text"]).alias("body"))
    bodies = F.transform(F.array_sort(F.transform(blocks, body)), lambda z: z["body"])
    return F.when(F.size(blocks) > 0, F.sha2(F.array_join(bodies, "\x1e"), 256)).otherwise("")


def _alignment(observations: Column) -> Column:
    return F.sha2(F.concat_ws("|", observations, "status", F.coalesce("reason", F.lit("")), "found"), 256)


def _decision(alignment: Column) -> Column:
    return F.sha2(F.concat_ws("|", alignment, F.coalesce("answer", F.lit(""))), 256)


def aligned(left: DataFrame, right: DataFrame, rate: float) -> DataFrame:
    """(page_id, observations, status, reason, found, alignment): both readings, compared, with the digests of these two links.

    Places of blocks give the pairs; then the texts of a page meet once, in one row, which gives its digests and differences.
    """
    rows = p.whole_pages(left, right, stored_rows(p.block_pairs(left, right), "pairs"))
    observed = F.sha2(F.concat_ws("|", "page_id", reading_digest(F.col("l")), reading_digest(F.col("r"))), 256)
    line = lambda f: F.concat(f["reason"], F.lit(":"), F.coalesce(f["left_idx"].cast("string"), F.lit("")), F.lit(":"), F.coalesce(f["right_idx"].cast("string"), F.lit("")))
    rows = rows.select("page_id", "l", "r", observed.alias("observations"), F.array_sort(F.transform(p.page_conflicts(), line)).alias("found"))
    rows = rows.select("page_id", "observations", p.page_status(F.size("found")).alias("status"), F.array_join("found", ",").alias("found"))
    why = escalation_reason(F.col("status"), F.sha2(F.col("page_id").cast("string"), 256), F.col("page_id"), rate)
    rows = rows.select("page_id", "observations", "status", why.alias("reason"), "found")
    return rows.withColumn("alignment", _alignment(F.col("observations")))


def decided(rows: DataFrame, executor: Executor) -> DataFrame:
    """aligned pages with the executor's answer and the last digest."""
    asked = rows.withColumn("asked", F.concat_ws("\n", "alignment", "status", "found"))
    return executor("decision", asked).drop("asked").withColumn("decision", _decision(F.col("alignment")))


def checked(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(page_id, broken): the first link of a stored page that doesn't hold against the readings as they are now, or ''.

    fresh comes from aligned(). A page without a stored row is `missing`, one that is no longer read `gone`. A link holds if
    its digest is the one that follows from the readings, and its own payload gives it: a changed reading, a changed
    payload and a changed digest are all found. Only the answer is taken as it is stored.
    """
    now = fresh.select("page_id", F.col("observations").alias("_o"), F.col("alignment").alias("_a"))
    met = stored.withColumn("_stored", F.lit(True)).join(now, "page_id", "full")
    link = (
        F.when(F.col("_stored").isNull(), "missing")
        .when(F.col("_o").isNull(), "gone")
        .when(~F.col("observations").eqNullSafe(F.col("_o")), "observations")
        .when(~F.col("alignment").eqNullSafe(F.col("_a")) | ~_alignment(F.col("observations")).eqNullSafe(F.col("_a")), "alignment")
        .when(F.col("answer").isNull() | ~F.col("decision").eqNullSafe(_decision(F.col("_a"))), "decision")
        .otherwise("")
    )
    return met.select("page_id", link.alias("broken"))


def resumed(stored: DataFrame, left: DataFrame, right: DataFrame, rate: float, executor: Executor) -> DataFrame:
    """The evidence of all pages, with `broken`: what holds is taken over, only broken and missing pages are decided again.

    Pages that are no longer read have no evidence any more.
    """
    fresh, stored = stored_rows(aligned(left, right, rate), "aligned"), stored_rows(stored, "stored")
    links = stored_rows(checked(stored, fresh), "links")
    broken = links.where("broken not in ('', 'gone')").select("page_id")
    again = stored_rows(decided(fresh.join(broken.hint("merge"), "page_id", "left_semi"), executor), "decided")
    kept = stored.join(links.where("broken = ''").select("page_id").hint("merge"), "page_id", "left_semi")
    return kept.unionByName(again.select(kept.columns)).join(links.hint("merge"), "page_id")
