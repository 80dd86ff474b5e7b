"""Changes to tables: an old table and the changes go in, a new table comes out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.operators.validation import violations


def last_per_key(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """New rows replace old ones of their key, but for the columns to keep; other old rows stay. new has one row per key."""
    rest = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in rest], F.lit(True).alias("_is_new"))
    o = old.withColumn("_is_old", F.lit(True))
    both = o.join(n, list(keys), "full_outer")
    value = lambda c: F.when(F.col("_is_new").isNotNull() & ~(F.lit(c in keep) & F.col("_is_old").isNotNull()), F.col(f"_new_{c}")).otherwise(F.col(c))
    return both.select(*keys, *[value(c).alias(c) for c in rest]).select(old.columns)


def append(old: DataFrame, new: DataFrame, key: str, parents: DataFrame | None = None, parent_key: str = "") -> tuple[DataFrame, DataFrame]:
    """(table, rejected): rows whose key exists, repeats or whose parent is missing are rejected."""
    w = Window.partitionBy(key).orderBy(*[c for c in new.columns if c != key])
    reason = F.when(F.col("_old").isNotNull(), "exists").when(F.col("_n") > 1, "repeated")
    checked = new.withColumn("_n", F.row_number().over(w)).join(old.select(key, F.lit(True).alias("_old")), key, "left")
    if parents is not None:
        checked = checked.join(parents.select(parent_key, F.lit(True).alias("_parent")).distinct(), parent_key, "left")
        reason = reason.when(F.col("_parent").isNull(), "no parent")
    checked = checked.withColumn("reason", reason)
    good = checked.where("reason is null").select(old.columns)
    return old.unionByName(good), checked.where("reason is not null").select(*new.columns, "reason")


def patch(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Only values that a change gives replace old ones."""
    cols = [c for c in changes.columns if c != key]
    n = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    joined = old.join(n, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in old.columns])


def transition(old: DataFrame, changes: DataFrame, key: str, legal: DataFrame) -> DataFrame:
    """changes (key, to) with `accepted`: whether the table of legal steps (status, to) leads from the old status there."""
    step = changes.join(old.select(key, "status"), key, "left")
    return step.join(F.broadcast(legal.withColumn("_ok", F.lit(True))), ["status", "to"], "left").withColumn(
        "accepted", F.coalesce("_ok", F.lit(False))
    ).drop("_ok")


def delete_unless(old: DataFrame, asked: DataFrame, key: str, guard: Column) -> DataFrame:
    """old without the asked rows that the guard doesn't protect."""
    gone = old.join(asked.select(key).distinct(), key, "left_semi").where(~guard).select(key)
    return old.join(gone, key, "left_anti")


def replace_group(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents that new names are replaced by those in new."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def compare_and_set(old: DataFrame, edits: DataFrame, key: str, version: str, value: str, now: int) -> DataFrame:
    """edits (key, expected, value) with `applied` and the version that the row has afterwards."""
    at = old.select(key, F.col(version).alias("_now"), F.col(value).alias("_old"))
    met = edits.join(at, key, "left")
    ok = F.col("_now").isNotNull() & (F.col("_now") == F.col("expected"))
    return met.select(
        key, ok.alias("applied"), F.when(ok, F.greatest(F.lit(now), F.col("_now") + 1)).otherwise(F.col("_now")).alias(version),
        F.when(ok, F.col(value)).otherwise(F.col("_old")).alias(value),
    )


def reorder(rows: DataFrame, wanted: DataFrame, parent: str, key: str) -> DataFrame:
    """(parent, key, seq, accepted): the wanted places apply where they name just the rows that a parent has, once each."""
    a = rows.select(parent, key, "seq")
    both = a.join(wanted.select(parent, key, F.col("seq").alias("_new")), [parent, key], "full_outer")
    fair = both.groupBy(parent).agg(
        (F.bool_and(F.col("seq").isNotNull() & F.col("_new").isNotNull()) & (F.countDistinct("_new") == F.count(F.lit(1)))).alias("accepted")
    )
    met = a.join(wanted.select(parent, key, F.col("seq").alias("_new")), [parent, key], "left").join(fair, parent)
    return met.select(parent, key, F.when(F.col("accepted"), F.col("_new")).otherwise(F.col("seq")).alias("seq"), "accepted")


def cascade_delete(parents: DataFrame, children: Mapping[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """The tables without the gone parents and all that hangs on them: name -> (table, column of the parent's key)."""
    out = {"parents": parents.join(gone.select(key), key, "left_anti")}
    for name, (table, column) in children.items():
        out[name] = table.join(gone.select(F.col(key).alias(column)), column, "left_anti")
    return out


def propagate_stale(topics: DataFrame, links: DataFrame, changed: DataFrame, published: DataFrame, ready: DataFrame) -> DataFrame:
    """(topic_id, status, reasons) of the topics of changed chapters.

    Running topics stay so and published ones become STALE; both add new reasons to those in
    topics.stale_reason. Others take their readiness (ready: topic_id, readiness) and have no reason.
    """
    hit = links.join(changed.select("chapter_id"), "chapter_id", "left_semi").groupBy("topic_id").agg(
        F.transform(F.array_sort(F.collect_set("chapter_id")), lambda x: F.concat(F.lit("chapter "), x)).alias("_new")
    )
    state = topics.join(hit, "topic_id").join(published.select("topic_id", "published"), "topic_id", "left").join(ready.select("topic_id", "readiness"), "topic_id")
    kept = (F.col("status") == "RUNNING") | F.coalesce("published", F.lit(False))
    before = F.filter(F.split(F.coalesce("stale_reason", F.lit("")), "\n"), lambda x: x != "")
    status = F.when(F.col("status") == "RUNNING", "RUNNING").when(kept, "STALE").otherwise(F.col("readiness"))
    reasons = F.when(kept, F.array_join(F.array_union(before, "_new"), "\n")).otherwise("")
    return state.select("topic_id", status.alias("status"), reasons.alias("reasons"))


def merge_topics(topics: DataFrame, links: DataFrame, published: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(topics, links, decisions): the topics that wanted (topic_id, merged_id) names for one merged_id become that new topic.

    A merge needs two topics at least, all of one course, none running or published, and a chapter.
    The new topic is an unconfirmed DRAFT with the chapters of all; refused merges change nothing.
    decisions: merged_id, accepted. topics: topic_id, course_id, status, confirmed.
    """
    has = links.select("topic_id").distinct().withColumn("_has", F.lit(True))
    met = wanted.distinct().join(topics, "topic_id", "left").join(published.select("topic_id", "published"), "topic_id", "left").join(has, "topic_id", "left")
    fair = (
        (F.count(F.lit(1)) >= 2) & (F.min("course_id") == F.max("course_id")) & F.bool_and(F.col("course_id").isNotNull())
        & ~F.bool_or(F.col("status") == "RUNNING") & ~F.bool_or(F.coalesce("published", F.lit(False))) & F.bool_or(F.coalesce("_has", F.lit(False)))
    )
    decisions = met.groupBy("merged_id").agg(F.coalesce(fair, F.lit(False)).alias("accepted"), F.min("course_id").alias("course_id"))
    done = decisions.where("accepted").select("merged_id", "course_id")
    gone = wanted.distinct().join(done.select("merged_id"), "merged_id")
    new = done.select(F.col("merged_id").alias("topic_id"), "course_id", F.lit("DRAFT").alias("status"), F.lit(False).alias("confirmed"))
    left = topics.select(new.columns).join(gone, "topic_id", "left_anti")
    moved = links.join(gone, "topic_id").select(F.col("merged_id").alias("topic_id"), "chapter_id").distinct()
    stay = links.select("topic_id", "chapter_id").join(gone, "topic_id", "left_anti")
    return left.union(new), stay.union(moved), decisions.select("merged_id", "accepted")


def split_topics(topics: DataFrame, links: DataFrame, published: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(topics, links, decisions): the chapters that wanted (topic_id, chapter_id, new_id) names leave their topic for the new one.

    Running topics are protected, and the chapters have to be a proper subset of the topic's. The
    topic that is left becomes STALE if it is published, else an unconfirmed DRAFT; so is the new
    one. decisions: topic_id, new_id, accepted. topics: topic_id, course_id, status, confirmed.
    """
    asked = wanted.distinct()
    own = links.select("topic_id", "chapter_id").distinct()
    met = asked.join(own.withColumn("_own", F.lit(True)), ["topic_id", "chapter_id"], "left").groupBy("topic_id", "new_id").agg(
        F.bool_and(F.coalesce("_own", F.lit(False))).alias("_all"), F.count(F.lit(1)).alias("_n")
    )
    size = own.groupBy("topic_id").agg(F.count(F.lit(1)).alias("_size"))
    state = met.join(topics.select("topic_id", "course_id", "status"), "topic_id").join(size, "topic_id").join(published.select("topic_id", "published"), "topic_id", "left")
    fair = F.col("_all") & (F.col("_n") < F.col("_size")) & (F.col("status") != "RUNNING")
    decisions = state.select("topic_id", "new_id", "course_id", F.coalesce("published", F.lit(False)).alias("published"), fair.alias("accepted"))
    done = decisions.where("accepted")
    new = done.select(F.col("new_id").alias("topic_id"), "course_id", F.lit("DRAFT").alias("status"), F.lit(False).alias("confirmed"))
    old = topics.select(new.columns).join(done.select("topic_id", "published", F.lit(True).alias("_cut")), "topic_id", "left")
    cut = F.col("_cut").isNotNull()
    old = old.select(
        "topic_id", "course_id", F.when(cut & F.col("published"), "STALE").when(cut, "DRAFT").otherwise(F.col("status")).alias("status"),
        (F.col("confirmed") & (~cut | F.col("published"))).alias("confirmed"),
    )
    moved = asked.join(done.select("topic_id", "new_id"), ["topic_id", "new_id"])
    stay = own.join(moved.select("topic_id", "chapter_id"), ["topic_id", "chapter_id"], "left_anti")
    return old.union(new), stay.union(moved.select("new_id", "chapter_id")), decisions.select("topic_id", "new_id", "accepted")


def confirm_drafts(chapters: DataFrame, snapshots: DataFrame, expected: DataFrame, parent: str) -> DataFrame:
    """chapters with new status and confirmed_snapshot: all of a parent are confirmed together, with its snapshot frozen.

    That needs the fingerprint that was expected (parent, expected) and no chapter that isn't a
    DRAFT; else nothing changes. snapshots: parent, snapshot, fingerprint.
    """
    drafts = chapters.groupBy(parent).agg(F.bool_and(F.col("status") == "DRAFT").alias("_drafts"))
    fit = snapshots.join(expected, parent).where("fingerprint = expected").join(drafts.where("_drafts"), parent)
    met = chapters.join(fit.select(parent, F.col("snapshot").alias("confirmed_snapshot")), parent, "left")
    return met.withColumn("status", F.when(F.col("confirmed_snapshot").isNotNull(), "CONFIRMED").otherwise(F.col("status")))


def expire_runs(runs: DataFrame, published: DataFrame, now: int, ttl: int) -> DataFrame:
    """(run_id, status, error): running ones whose heartbeat is too old fail as interrupted, or are stale if published."""
    met = runs.join(published.select("chapter_id", F.lit(True).alias("_p")).distinct(), "chapter_id", "left")
    old = (F.col("status") == "RUNNING") & (F.col("heartbeat_at") + ttl <= now)
    status = F.when(old & F.col("_p").isNotNull(), "STALE").when(old, "FAILED").otherwise(F.col("status"))
    return met.select("run_id", status.alias("status"), F.when(old, "interrupted").alias("error"))


def conform(df: DataFrame, columns: Mapping[str, tuple[str, object]], version: int, known: int) -> DataFrame:
    """df with the columns of a schema version, in order, missing ones by default; newer versions are refused."""
    if version > known:
        raise ValueError(f"version {version} is newer than {known}")
    return df.select(*[(F.col(c) if c in df.columns else F.lit(default)).cast(kind).alias(c) for c, (kind, default) in columns.items()])


def publish(parents: DataFrame, asked: DataFrame, current: DataFrame, leases: DataFrame, key: str, now: int, running: bool = True) -> DataFrame:
    """(key, status, stale_reason, violations) of all parents (key, status, stale_reason) after publication of those asked for.

    asked is (key, owner_id, expected, baseline), one row for each key. A parent is published, is COMPLETED and has no
    stale reason any more, if it is RUNNING (unless running is False), its input still has the expected fingerprint
    (current: key, fingerprint), its stale reason is the one it started with, and its owner's lease hasn't expired
    (leases: key, owner_id, expires_at). Others stay as they are; what wasn't asked for has no violations either.
    """
    lease = leases.select(key, "owner_id", F.col("expires_at").alias("_until"))
    want = asked.select(key, "owner_id", "expected", "baseline", F.lit(True).alias("_asked")).join(lease, [key, "owner_id"], "left")
    met = parents.select(key, "status", "stale_reason").join(want, key, "left").join(current.select(key, F.col("fingerprint").alias("_now")), key, "left")
    rules = {
        "status": (F.col("status") == "RUNNING") | F.lit(not running),
        "fingerprint": F.col("_now") == F.col("expected"),
        "baseline": F.col("baseline").eqNullSafe(F.col("stale_reason")),
        "lease": F.col("_until") > now,
    }
    out = met.withColumn("violations", F.when(F.col("_asked"), violations(rules)))
    done = F.col("violations") == ""
    status, reason = F.when(done, "COMPLETED").otherwise(F.col("status")), F.when(done, "").otherwise(F.col("stale_reason"))
    return out.select(key, status.alias("status"), reason.alias("stale_reason"), "violations")


def bind_publication(parents: DataFrame, evidence: DataFrame, key: str, model: str, ruleset: str, prompt: Column) -> DataFrame:
    """parents bound to what they were made from: evidence (key, n, evidence), model, ruleset and prompt, and one fingerprint of all."""
    met = parents.withColumn("prompt_fingerprint", F.sha2(prompt, 256)).join(evidence, key, "left")
    met = met.withColumn("model", F.lit(model)).withColumn("ruleset", F.lit(ruleset))
    return met.withColumn("publication", F.sha2(F.concat_ws("|", "evidence", "model", "ruleset", "prompt_fingerprint"), 256))
