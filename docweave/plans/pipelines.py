"""Compositions of operators: what a user runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import FOLDER_RULES, diagrams, redact, safe_name, word_tokens
from docweave.operators import changes as m
from docweave.operators import relational as r
from docweave.operators import rounds as q
from docweave.operators import sections as s
from docweave.operators.rendering import topic_bundle
from docweave.sources.documents import scratch
from docweave.sources.files import sync_states


def section_report(docs: DataFrame) -> DataFrame:
    """Per kind: documents, those reused by their hash, sections, distinct sections, characters and tokens.

    Documents with a hash seen before aren't split again; the first one by id stands for them.
    """
    hashed = docs.withColumn("h", F.sha2("md", 256))
    once = hashed.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    split = s.split_sections(hashed.join(once, "doc_id", "left_semi")).withColumn("kind", F.substring("doc_id", 1, 1))
    per_kind = split.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_sections"), F.countDistinct("sha256").alias("n_distinct_sections"),
        F.sum("char_count").alias("chars"), F.sum(word_tokens(F.col("raw"))).alias("tokens_in"),
    )
    first = once.withColumn("kind", F.substring("doc_id", 1, 1)).groupBy("kind").agg(F.count(F.lit(1)).alias("first"))
    counts = docs.groupBy("kind").agg(F.count(F.lit(1)).alias("n_docs")).join(first, "kind", "left").join(per_kind, "kind", "left")
    reused = F.col("n_docs") - F.coalesce("first", F.lit(0))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_sections", "n_distinct_sections", "chars", "tokens_in")]
    return counts.select("kind", "n_docs", reused.alias("n_reused_docs"), *zero)


def resume(sections: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Merge the tasks that have unfinished sections: finished artifacts are reused, the rest comes from the stub."""
    open_tasks = r.with_status(sections, *r.PENDING).select("task_id").distinct()
    work = sections.join(open_tasks, "task_id", "left_semi")
    found = r.reuse_by_hash(work, artifacts.select("section_sha", "ai_md", "artifact_id", F.col("created_at").alias("made")), "sha256", "section_sha", ["made", "artifact_id"])
    text = F.concat("raw", F.lit("|"), F.coalesce("ai_md", F.concat(F.lit("stub "), "sha256")))
    return found.withColumn("text", text).groupBy("task_id").agg(r.ordered_list(["seq"], "text", ";").alias("merged"))


def chapter_bundle(chapters: DataFrame, notes: DataFrame, cards: DataFrame, runs: DataFrame) -> DataFrame:
    """(path, content): source.md, intensive-note.md, cards.md and runs/<round>.md of every chapter, below <source>/<number>-<title>.

    chapters have the text of their source, cards and runs what they show; of several runs of a round the last one counts.
    What a run put out is redacted. Chapters without notes or cards have the heads of these files, without runs no runs.
    """
    folder = F.concat(F.col("source_id").cast("string"), F.lit("/"), F.lpad((F.col("seq") + 1).cast("string"), 2, "0"), F.lit("-"), safe_name(F.col("title")))
    places = chapters.select("chapter_id", "title", "source", folder.alias("folder"))
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    drawn = F.when(F.col("kind").endswith("_mermaid"), line("```mermaid\n", F.coalesce(F.get(diagrams(F.col("content")), F.lit(0)), F.trim("content")), "\n```")).otherwise(F.col("content"))
    note = notes.select("chapter_id", "seq", "note_id", line("\n## ", F.col("kind"), "\n\n", drawn, "\n").alias("text"))
    note = note.groupBy("chapter_id").agg(r.ordered_list(["seq", "note_id"], "text", "").alias("notes"))
    starred = F.when(F.col("favourite"), "是").otherwise("否")
    card = cards.select(F.col("origin_id").alias("chapter_id"), "card_id", line("\n## ", F.col("title"), "\n\n类型：", F.col("tags"), "\n收藏：", starred, "\n\n", F.col("content"), "\n").alias("text"))
    card = card.groupBy("chapter_id").agg(r.ordered_list(["card_id"], "text", "").alias("cards"))
    met = places.join(note, "chapter_id", "left").join(card, "chapter_id", "left")
    files = {
        "source.md": F.coalesce("source", F.lit("")),
        "intensive-note.md": line("<!-- chapter-id: ", F.col("chapter_id"), " -->\n# ", F.col("title"), "\n", F.coalesce("notes", F.lit(""))),
        "cards.md": line("# ", F.col("title"), " 写作卡片\n", F.coalesce("cards", F.lit(""))),
    }
    own = met.select("folder", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("content")) for n, c in files.items()])))
    last = m.last_per_key(runs, ["chapter_id", "round_key"], ["created_at", "run_id"])
    stale = F.when(F.col("stale"), "是").otherwise("否")
    shown = line("# ", F.col("round_key"), "\n\n状态：", F.col("status"), "\n过期：", stale, "\n执行器：", F.col("executor"), "\n\n## 输出\n\n", redact(F.col("output"), FOLDER_RULES), "\n")
    told = places.select("chapter_id", "folder").join(last, "chapter_id").select("folder", line("runs/", safe_name(F.col("round_key")), ".md").alias("name"), shown.alias("content"))
    return own.union(told).select(F.concat_ws("/", "folder", "name").alias("path"), "content")


def topic_files(topics: DataFrame, labels: DataFrame, blocks: DataFrame, cards: DataFrame) -> DataFrame:
    """(topic_id, path, content): the three files of every topic that is whole, below topics/<id>."""
    made = topic_bundle(topics, labels, blocks, cards).where("violations = ''")
    names = {"topic-map.md": "topic_map", "topic-note.md": "note", "cards.md": "card_file"}
    rows = made.select("topic_id", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("content")) for n, c in names.items()])))
    return rows.select("topic_id", F.concat_ws("/", F.lit("topics"), "topic_id", "name").alias("path"), "content")


def course_dashboard(readiness: DataFrame, chapters: DataFrame, reviews: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """(course_id, n_topics, ready, links, blocking, n_chapters, reviewed, synced, outdated, unsynced): a course at a glance.

    readiness is that of its topics; a chapter is reviewed if its review is done and not stale. A topic's files (topic_id,
    path, content) as they are now are compared with the folder's manifest: it is synced if all are there and the same,
    outdated if it was written and any differs or is missing, and unsynced if none was written. Topics without files count as unsynced.
    """
    states = files.select("topic_id", "path").join(sync_states(files.select("path", "content"), folder).hint("merge"), "path")
    state = states.groupBy("topic_id").agg(F.bool_and(F.col("state") == "same").alias("same"), F.bool_and(F.col("state") == "new").alias("new"))
    met = readiness.join(state.hint("merge"), "topic_id", "left")
    new = F.coalesce("new", F.lit(True))
    per_topic = met.groupBy("course_id").agg(
        F.count(F.lit(1)).alias("n_topics"), F.count_if(F.col("readiness") == "READY").alias("ready"), F.sum("n_chapters").alias("links"), F.sum("n_blocking").alias("blocking"),
        F.count_if(~new & F.col("same")).alias("synced"), F.count_if(~new & ~F.col("same")).alias("outdated"), F.count_if(new).alias("unsynced"),
    )
    done = chapters.select("chapter_id", "course_id").join(reviews.select("chapter_id", "status", "stale"), "chapter_id", "left")
    per_chapter = done.groupBy("course_id").agg(F.count(F.lit(1)).alias("n_chapters"), F.count_if((F.col("status") == "DONE") & ~F.col("stale")).alias("reviewed"))
    return per_topic.join(per_chapter, "course_id", "left").fillna(0, ["n_chapters", "reviewed"])


def prompts(chapters: DataFrame, notes: DataFrame) -> DataFrame:
    """(chapter_id, prompt): the instruction and the cited text in order."""
    cited = notes.withColumn("text", F.concat(F.lit("[src:"), "note_id", F.lit("] "), "content"))
    cited = cited.groupBy("chapter_id").agg(r.ordered_list(["seq", "note_id"], "text", "\n").alias("cited"))
    head = F.concat(F.lit("Read the chapter "), "title", F.lit(".\n"))
    return chapters.join(cited, "chapter_id", "left").select("chapter_id", F.concat(head, F.coalesce("cited", F.lit(""))).alias("prompt"))


def note_skeleton(tree: DataFrame, lines: DataFrame) -> DataFrame:
    """(source_id, id, note): a chapter's title and the cited lines of its pages."""
    from docweave.operators.chapters import texts_of_chapters

    cited = F.concat(F.lit("- [p"), "page", F.lit(":"), "line_no", F.lit("] "), "line")
    held = lines.select("source_id", "page", "line_no", "line", cited.alias("text"))
    notes = texts_of_chapters(tree.select("source_id", "id", "title", "page_start", "page_end"), held, ["page", "line_no", "line"], "text")
    return notes.select("source_id", "id", F.concat(F.lit("# "), "title", F.lit("\n"), "body").alias("note"))


def routed(runs: DataFrame) -> DataFrame:
    """runs with the executor that answers their round."""
    rows = [("round0", "a"), ("round1", "a"), ("round2", "b"), ("round3", "b")]
    table = runs.sparkSession.createDataFrame(rows, "round_key string, executor string")
    return runs.join(F.broadcast(table), "round_key")


def chapter_reading(chapters: DataFrame, notes: DataFrame, current: DataFrame, executor: q.Executor) -> DataFrame:
    """(chapter_id, failed, n_blocks, note): each chapter's note after its rounds.

    The prompt cites the chapter's notes; seven rounds are asked and checked one after the other; where all pass and
    the fingerprint of the prompt is still the one in current (chapter_id, fingerprint), the fixed blocks replace
    what was there. Other chapters keep their notes, with the first round that failed. Chapters without notes aren't asked.
    """
    cited = notes.groupBy("chapter_id").agg(F.collect_set(F.concat(F.lit("[src:"), "note_id", F.lit("]"))).alias("allowed"), F.min("note_id").alias("first"))
    work = prompts(chapters, notes).join(chapters.select("chapter_id", "title"), "chapter_id").join(cited, "chapter_id", "left")
    work = work.join(current.select("chapter_id", F.col("fingerprint").alias("now")), "chapter_id", "left")
    rules = q.chapter_rules(F.col("allowed"), F.sha2("prompt", 256) == F.col("now"), F.col("review_read"))
    state = q.run_rounds(work, q.CHAPTER_ROUNDS, executor, rules, {"notes": F.size("allowed") > 0}, {"review": q.chapter_review()})
    old = notes.select("chapter_id", "kind", F.col("kind").alias("title"), F.col("content").alias("body"), "seq")
    after = m.replace_group(old, q.chapter_published(state), "chapter_id").withColumn("text", F.concat(F.lit("## "), "title", F.lit("\n\n"), "body"))
    after = after.groupBy("chapter_id").agg(F.count(F.lit(1)).alias("n"), r.ordered_list(["seq", "kind", "body"], "text", "\n\n").alias("note"))
    return state.join(after, "chapter_id", "left").select("chapter_id", "failed", F.coalesce("n", F.lit(0)).alias("n_blocks"), F.coalesce("note", F.lit("")).alias("note"))


def topic_fusion(topics: DataFrame, labels: DataFrame, executor: q.Executor, labels_after: DataFrame, topics_after: DataFrame, leases: DataFrame, now: int) -> DataFrame:
    """(topic_id, failed, fingerprint, note, card_file): snapshot, seven rounds, checks, publication and files of each topic.

    labels are (topic_id, source_id, seq, title, label). Topics start if they are confirmed, not running, and have
    sources with labels that differ. Those whose rounds all pass ask for publication, which the guards of publish() allow
    if nothing else changed meanwhile: the labels after the rounds give the same fingerprint, the stale reason is still
    the one of the start (topics_after), and the lease of the topic's owner (leases: topic_id, owner_id, expires_at;
    topics: owner_id) is alive. Published ones are rendered; others have what failed: start, a round or `publish`, with the rules.
    """
    listed = lambda rows: rows.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "seq", "label")))["label"].alias("labels"))
    print_of = F.sha2(F.array_join("labels", ","), 256).alias("fingerprint")
    head = F.concat(F.lit("Topic "), "title", F.lit("\n"), F.array_join("labels", "\n"))
    work = topics.select("topic_id", "title", "status", "confirmed", "stale_reason", "owner_id").join(listed(labels), "topic_id", "left")
    work = work.select("*", head.alias("prompt"), print_of)
    start = {"sources": F.size(F.array_distinct("labels")) == F.size("labels"), "confirmed": F.col("confirmed"), "running": F.col("status") != "RUNNING"}
    shapes = q.topic_answers()
    state = q.run_rounds(work, q.TOPIC_ROUNDS, executor, q.topic_rules(F.col("labels"), q.read_answers(shapes)), start, shapes)
    asked = state.where("failed = ''").select("topic_id", "owner_id", F.col("fingerprint").alias("expected"), F.col("stale_reason").alias("baseline"))
    held = topics_after.select("topic_id", F.lit("RUNNING").alias("status"), "stale_reason")
    out = m.publish(held, asked, listed(labels_after).select("topic_id", print_of), leases, "topic_id", now)
    broken = out.where("violations <> ''").select("topic_id", F.concat(F.lit("publish:"), "violations").alias("_broken"))
    path = scratch(topics.sparkSession, "published")
    state.join(broken, "topic_id", "left").withColumn("failed", F.coalesce("_broken", "failed")).drop("_broken").write.parquet(path)
    state = topics.sparkSession.read.schema(state.schema).parquet(path)
    blocks, cards = q.topic_published(state)
    passed = state.where("failed = ''").select("topic_id", "title", F.lit("PUBLISHED").alias("status"), "confirmed")
    files = topic_bundle(passed, labels, blocks, cards).select("topic_id", "note", "card_file")
    return state.select("topic_id", "failed", "fingerprint").join(files, "topic_id", "left")


def topic_outline(parents: DataFrame, chapters: DataFrame, reviews: DataFrame, drafts: DataFrame, executor: q.Executor, key: str = "course_id", most: int = 300_000) -> DataFrame:
    """(key, failed, n_topics, outline): each parent's draft topics after an outline was asked for.

    Parents start if they have chapters, at most `most` characters of their titles (no prompt holds more; they are counted
    before any list is made), and every review is done and not stale. A valid answer replaces the parent's drafts (key,
    title, chapter_ids).
    """
    met = chapters.select(key, "chapter_id", "title").join(reviews.select("chapter_id", "status", "stale"), "chapter_id", "left")
    blocks = ~F.coalesce((F.col("status") == "DONE") & ~F.col("stale"), F.lit(False))
    counts = met.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("title") + 1).alias("chars"), F.count_if(blocks).alias("blocking"))
    few = met.join(counts.where((F.col("chars") <= most) & (F.col("blocking") == 0)), key, "left_semi")
    lists = few.groupBy(key).agg(F.array_sort(F.collect_list("chapter_id")).alias("ids"), r.ordered_list(["chapter_id"], "title", "\n").alias("prompt"))
    work = parents.select(key).join(counts, key, "left").join(lists, key, "left")
    start = {"chapters": F.col("n") > 0, "blocking": F.coalesce("blocking", F.lit(0)) == 0, "size": F.coalesce("chars", F.lit(0)) <= most}
    state = q.run_rounds(work, ["topic_outline"], executor, q.outline_rules(F.col("ids")), start)
    made = state.where("failed = ''").select(key, F.inline(q.outline_answer()["topics"])).select(key, "title", "chapter_ids")
    after = m.replace_group(drafts, made, key).withColumn("text", F.concat_ws(":", "title", F.array_join("chapter_ids", ",")))
    after = after.groupBy(key).agg(F.count(F.lit(1)).alias("k"), r.ordered_list(["title", "text"], "text", ";").alias("outline"))
    return state.join(after, key, "left").select(key, "failed", F.coalesce("k", F.lit(0)).alias("n_topics"), F.coalesce("outline", F.lit("")).alias("outline"))


def incremental_sections(stream: DataFrame) -> DataFrame:
    """(sha256): sections of streamed documents, each distinct one processed once: what the table has is skipped."""
    from docweave.streaming.events import run_to_end

    spark = stream.sparkSession
    path = scratch(spark, "incremental")
    spark.createDataFrame([], "sha256 string").write.parquet(path)

    def process(batch: DataFrame, _: int) -> None:
        found = s.split_sections(batch.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.col("text").alias("md")))
        done = spark.read.schema("sha256 string").parquet(path)
        found.select("sha256").distinct().join(done, "sha256", "left_anti").write.mode("append").parquet(path)

    run_to_end(stream, "incremental", "append", process)
    return spark.read.schema("sha256 string").parquet(path)
