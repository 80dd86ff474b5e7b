"""Blocks of two readings: pairs by bands, and tables given as rows or as cells."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from docweave.operators import evidence, pages, tables

BLOCK = f"page_id long, block_idx int, text string, type string, reading_order int, x double, y double, width double, height double, `table` {tables.TABLE}"


def rows(matrix):
    return (None, matrix, None)


def cells(*given):
    return (["h"], None, [(*c[:2], 1, 1, c[2]) if len(c) == 3 else c for c in given])


def reasons(spark, left, right):
    frame = lambda t: spark.createDataFrame([(1, 0, "t", "table", 0, 0.1, 0.1, 0.5, 0.2, t)], BLOCK)
    a, b = frame(left), frame(right)
    found = pages.conflicts(a, b, pages.block_pairs(a, b)).collect()
    assert pages.reconcile(a, b, 0.0).first().status == "complex"
    return [r.reason for r in found]


def test_table_conflicts(spark):
    shape, content = ["table_shape_conflict"], ["table_content_conflict"]
    assert reasons(spark, rows([["A", "B"]]), rows([["A"]])) == shape
    assert reasons(spark, rows([["收入", "10"]]), rows([["收入", "40"]])) == content
    assert reasons(spark, cells((1, 0, "10")), cells((1, 0, "40"))) == content
    assert reasons(spark, rows([["a", "b"], ["c", "c"]]), cells((0, 0, "a"), (0, 1, "b"), (1, 0, 1, 2, "c"))) == []
    assert reasons(spark, rows([["a", "a"], ["a", "a"]]), cells((0, 0, 2, 2, "a"))) == []
    assert reasons(spark, rows([["a"], []]), rows([["a"]])) == shape
    assert reasons(spark, None, rows([["a"]])) == shape
    assert reasons(spark, None, None) == [] == reasons(spark, rows([[None]]), rows([[""]]))
    assert reasons(spark, cells((None, None, None, None, "x")), rows([["x"]])) == []
    assert reasons(spark, rows([["a", "b"]]), rows([["a"], ["b"]])) == shape
    assert reasons(spark, cells((0, 0, 1, 9_999_999, "wide")), rows([["wide"]])) == []


def test_shapes_of_tables_by_rows(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["c"]), (2, None), (2, [])], "k int, w array<string>")
    assert sorted(map(tuple, tables.row_shape(df, ["k"], F.col("w")).collect())) == [(1, 2, 2), (2, 2, 0)]


def test_pairs_are_those_of_choosing_one_by_one(spark):
    rng = random.Random(5)
    box = lambda: (rng.random() * 0.6, rng.random() * 0.8, 0.1 + rng.random() * 0.3, 0.02 + rng.random() * 0.18)
    sides = [[(p, i, "t", "paragraph", i, *box(), None) for p in range(4) for i in range(25)] for _ in range(2)]
    got = pages.block_pairs(*[spark.createDataFrame(s, BLOCK) for s in sides]).collect()

    def overlap(a, b):
        (ax, ay, aw, ah), (bx, by, bw, bh) = a[5:9], b[5:9]
        met = max(0, min(ax + aw, bx + bw) - max(ax, bx)) * max(0, min(ay + ah, by + bh) - max(ay, by))
        return met / (aw * ah + bw * bh - met)

    expected = set()
    for p in range(4):
        taken = set()
        for a in (x for x in sides[0] if x[0] == p):
            free = [(-overlap(a, b), b[1]) for b in sides[1] if b[0] == p and b[1] not in taken and overlap(a, b) >= 0.2]
            if free:
                taken.add(min(free)[1])
                expected.add((p, a[1], min(free)[1]))
    assert {tuple(r) for r in got} == expected and expected


def test_every_broken_link_is_named_and_only_its_page_decided_again(spark):
    body = [(i, 0, f"line {i}", "paragraph", 0, 0.1, 0.1, 0.5, 0.1, None) for i in range(8)]
    other = [(*r[:2], r[2].replace("3", "4"), *r[3:]) for r in body if r[0] != 7]
    left, right = spark.createDataFrame(body, BLOCK), spark.createDataFrame(other, BLOCK)
    asked = []

    def executor(key, rows):
        asked.append(sorted(r.page_id for r in rows.select("page_id").collect()))
        return rows.withColumn("answer", F.concat(F.lit("ok "), "page_id"))

    stored = evidence.decided(evidence.aligned(left, right, 0.0), executor)
    rows = {r.page_id: r.asDict() for r in stored.collect()}
    assert rows[3]["found"] == "numeric_conflict:0:0" and rows[7]["found"] == "missing_block:0:"
    page = F.col("page_id")
    swap = lambda c, n, by: F.when(page == n, F.lit(by)).otherwise(F.col(c)).alias(c)
    forged = stored.where("page_id <> 0").select(
        "page_id", swap("observations", 1, "x"), swap("status", 2, "forged"), swap("reason", 4, "FORGED"), swap("found", 5, "forged:0:0"),
        F.when(page == 6, "x").otherwise(F.col("alignment")).alias("alignment"), swap("answer", 3, "other"), F.when(page == 7, None).otherwise(F.col("decision")).alias("decision"),
    ).unionByName(stored.where("page_id = 1").withColumn("page_id", F.lit(99).cast("long")))
    got = {r.page_id: r for r in evidence.resumed(forged, left, right, 0.0, executor).collect()}
    assert {k: r.broken for k, r in got.items()} == {
        0: "missing", 1: "observations", 2: "alignment", 3: "decision", 4: "alignment", 5: "alignment", 6: "alignment", 7: "decision"
    }
    assert all({k: r[k] for k in rows[i]} == rows[i] for i, r in got.items())
    asked.clear()
    changed = left.withColumn("text", F.when(page == 5, "changed").otherwise(F.col("text")))
    again = evidence.resumed(stored, changed, right, 0.0, executor)
    assert {r.page_id: r.broken for r in again.collect()} == {i: "observations" if i == 5 else "" for i in range(8)}
    assert asked[-1] == [5]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_pairs_are_not_sent_out_by_the_driver(spark):
    blocks = spark.createDataFrame([(i, 0, "t", "paragraph", 0, 0.1, 0.1, 0.5, 0.1, None) for i in range(8)], BLOCK)
    assert "Broadcast" not in plan(pages.reconcile(blocks, blocks, 0.0))


def test_evidence_is_not_sent_out_by_the_driver(spark):
    blocks = spark.createDataFrame([(i, 0, "t", "paragraph", 0, 0.1, 0.1, 0.5, 0.1, None) for i in range(8)], BLOCK)
    decide = lambda key, rows: rows.withColumn("answer", F.lit("ok"))
    stored = evidence.decided(evidence.aligned(blocks, blocks, 0.0), decide)
    assert "Broadcast" not in plan(stored) + plan(evidence.resumed(stored, blocks, blocks, 0.0, decide))


def test_pairs_and_conflicts_of_a_report_are_written_once(spark, monkeypatch):
    from docweave.plans.queries import QUERIES

    made, plain_pairs = [], pages.block_pairs
    monkeypatch.setattr(pages, "block_pairs", lambda left, right: made.append(1) or plain_pairs(left, right))
    QUERIES["agg_reconcile_report"](spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def test_whole_pages_give_the_same_conflicts_without_joins(spark):
    r = random.Random(3)
    kinds = ["paragraph", "footnote", "page_number", "formula", "table", "list", None]
    texts = ["profit 10%", "profit  10％", "profit 40%", "x <= 3", "x >= 3", "學習", "学习", "", None]

    def block(page, i, near):
        kind = near[3] if near and r.random() < 0.8 else r.choice(kinds if page % 3 else kinds[:2])
        given = r.choice([rows([["a", "b"]]), rows([["a", "c"]]), rows([["a"]]), cells((0, 0, "a"), (0, 1, "b")), None])
        y = near[6] if near else i * 0.1
        return (page, i, near[2] if near and r.random() < 0.5 else r.choice(texts), kind, r.choice([i, i, 9 - i, None]), 0.1, y, 0.5, 0.08, given if kind == "table" else None)

    a = [block(page, i, None) for page in range(60) for i in range(5)] + [(60, 0, "t", None, 0, 0.1, 0.1, 0.5, 0.1, None), (61, 0, "t", "list", 0, 0.1, 0.1, 0.5, 0.1, None)]
    b = [block(x[0], r.choice([x[1], 7 + x[1]]), x) for x in a if r.random() < 0.8 and x[0] < 60] + [(62, 0, "t", "paragraph", 0, 0.1, 0.1, 0.5, 0.1, None)]
    a, b = a + [a[7], a[12]], b + [b[20]]
    left, right = spark.createDataFrame(a, BLOCK), spark.createDataFrame(b, BLOCK)
    pairs = pages.stored_pairs(left, right)
    expected = pages.conflicts(left, right, pairs)
    whole = pages.whole_pages(left, right, pairs).withColumn("c", pages.page_conflicts())
    flat = lambda df: sorted(map(str, df.select("page_id", "reason", "left_idx", "right_idx").collect()))
    assert flat(whole.select("page_id", F.inline("c"))) == flat(expected) and expected.select("reason").distinct().count() > 7
    status = {r.page_id: r.status for r in pages.classes(left, right, expected).collect()}
    assert {r[0]: r[1] for r in whole.select("page_id", pages.page_status(F.size("c"))).collect()} == status
    assert "Join" not in plan(evidence.aligned(left, right, 0.0))
