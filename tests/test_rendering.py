import random
import uuid
from pathlib import Path

from pyspark.sql import functions as F

from docweave.functions.text import citations
from docweave.operators import rendering
from docweave.operators.relational import page_ends, subtree_ends
from docweave.operators.rendering import CARDS_HEADING, TOPIC_SECTIONS, topic_bundle
from docweave.operators.validation import checked

KINDS = list(TOPIC_SECTIONS)


def test_blocks_of_a_bundle_are_read_once(spark, tmp_path):
    def noted(batches):
        for batch in batches:
            Path(tmp_path, uuid.uuid4().hex).write_text(str(batch.num_rows))
            yield batch

    topics = spark.createDataFrame([(i, f"topic {i}", "READY", i % 2 == 0) for i in range(1, 8)], "topic_id long, title string, status string, confirmed boolean")
    blocks = [(i, k, f"{k} of {i}") for i in (1, 4, 5, 6) for k in KINDS]
    blocks += [(2, k, "b") for k in (*KINDS, KINDS[0])] + [(3, k, "b") for k in (*KINDS[1:], KINDS[1])]
    blocks = [(i, k, None if (i, k) == (4, "consensus_disagreements") else "```mermaid\ngraph TD\nA-->B\n```" if (i, k) == (4, "knowledge_mermaid") else c) for i, k, c in blocks]
    cards = [(i, 100 * i + n, "concept", f"card {n}", f"about {n}", [f"label {i}"]) for i in (1, 2, 3, 4, 5) for n in range(8)] + [(6, 600 + n, "concept", "c", "a", ["label 6"]) for n in range(7)]
    cards += [(5, 550, "concept", "bad", "a", ["label 1"]), (6, 650, "concept", "none", "a", [])]
    labels = [(i, i, 0, "chapter", f"label {i}") for i in range(1, 8)] + [(1, 1, 0, "chapter", "label 1")]
    read = spark.createDataFrame(blocks, "topic_id long, kind string, content string").mapInArrow(noted, "topic_id long, kind string, content string")
    made = topic_bundle(
        topics, spark.createDataFrame(labels, "topic_id long, source_id long, seq int, title string, label string"), read,
        spark.createDataFrame(cards, "topic_id long, card_id long, card_type string, title string, content string, refs array<string>"),
    )
    got = {r.topic_id: r for r in made.collect()}
    assert {i: r.violations for i, r in got.items()} == {1: "", 2: "blocks", 3: "blocks", 4: "", 5: "refs", 6: "refs", 7: "blocks,cards"}
    assert all((r.note is None) == (r.topic_map is None) == (r.card_file is None) == (r.violations != "") for r in got.values())
    body = lambda i, mark: "".join(f"{mark} card {n}\n\n类型：concept\n来源：label {i}\n\nabout {n}\n\n" for n in range(8))
    text = lambda i, k: f"```mermaid\n{k} of {i}\n```" if k.endswith("mermaid") else f"{k} of {i}"
    drawn = {(4, "knowledge_mermaid"): "```mermaid\ngraph TD\nA-->B\n```"}
    for i in (1, 4):
        sections = "".join(f"## {h}\n\n{drawn.get((i, k), text(i, k))}\n\n" for k, h in TOPIC_SECTIONS.items() if (i, k) != (4, "consensus_disagreements"))
        assert got[i].note == f"# topic {i}\n\n{sections}## {CARDS_HEADING}\n\n{body(i, '###')}"
        assert got[i].card_file == f"# topic {i} 写作卡片\n\n{body(i, '##')}"
    assert got[1].topic_map.endswith("## 教材章节\n\n- label 1 chapter\n- label 1 chapter\n")
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == len(blocks)


def test_notes_of_one_range_are_checked_once(spark, monkeypatch):
    loud = ["see [src:9]", "javascript: x", "one=1", "a\u2028## 核心", "```", "a '```' b", "%%{x", 'say "x"', "50 页）：", "x [att:1]", "on = 2"]
    titles = [f"part {i}/a" for i in range(60)] + loud * 2
    tree = [(s, f"c{i}", str(i), t, 1, 1) for s in (1, 2) for i, t in enumerate(titles)] + [(1, "wide1", "7", "wide", 1, 3), (2, "none0", "8", "none", 5, 6), (1, "bare3", None, "x", 1, 1), (2, "open", "1", "x", None, None)]
    lines = [(1, 1, 1, "one"), (1, 1, 2, "x"), (1, 3, 1, "javascript: z"), (2, 1, 1, "see [src:9]"), (2, 1, 2, "b\u2028## 实际应用")]
    tree = spark.createDataFrame(tree, "source_id int, id string, number string, title string, page_start int, page_end int")
    lines = spark.createDataFrame(lines, "source_id int, page int, line_no int, line string")
    by, made, make = F.expr("ascii(right(id, 1)) % 5"), [], rendering.note_markdown
    swap = lambda a, b: F.replace("note", F.lit(a), F.lit(b))
    bad = F.when(F.col("by") == 0, F.concat("note", F.lit("<b>"))).when(F.col("by") == 1, swap("## 核心概念", "## 核心")).when(F.col("by") == 2, swap(" 页）：", " 页）：!")).when(F.col("by") == 3, swap("[src:", "[sic:")).otherwise(F.col("note"))
    checks = [lambda n: checked(n, rendering.note_rules(bad, citations(F.col("note")))), lambda n: checked(n, rendering.generated_rules(F.col("note"), bad))]
    monkeypatch.setattr(rendering, "note_markdown", lambda t, *more: made.append(t.count()) or make(t, *more))
    for check in checks:
        every = check(make(tree.withColumn("by", by), lines, "v", ["by"])).select("source_id", "id", "violations")
        got = rendering.checked_notes(tree, lines, "v", by, check)
        rows = lambda df: sorted((r.source_id, r.id, r.violations) for r in df.collect())
        assert rows(got) == rows(every) and len({r[2] for r in rows(got)}) > 3
    assert made == [2 * (5 + len(loud) * 2) + 4] * 2 and tree.count() == 168


def test_ranges_of_chapters_need_no_pairs(spark):
    r = random.Random(5)
    rows = [(s, f"c{i}", i, r.choice([1, 1, 2, 2, 2, 3, 5]), r.choice([None, *range(1, 30)])) for s in range(4) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, id string, place int, level int, page int")
    out = subtree_ends(page_ends(df, "k", "page", ["place", "id"], F.lit(99)), "k", ["place", "id"], [1, 2, 3, 5])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "unboundedfollowing" not in plan.lower().split("_b1")[0]
    got = {(r.k, r.id): (r.page_end, r.clash, r.subtree_end) for r in out.collect()}
    for s in range(4):
        mine, ends = [x for x in rows if x[0] == s], []
        for i, x in enumerate(mine):
            after = next((y[4] for y in mine[i + 1 :] if y[4] is not None), None)
            clash = x[4] is not None and after is not None and after <= x[4]
            ends.append((None if x[4] is None else x[4] if clash else after - 1 if after is not None else 99, clash))
        for i, x in enumerate(mine):
            stop = next((j for j in range(i + 1, len(mine)) if mine[j][3] <= x[3]), len(mine))
            below = [e for e, _ in ends[i + 1 : stop] if e is not None]
            assert got[s, x[1]] == (*ends[i], max(below) if below else ends[i][0])
