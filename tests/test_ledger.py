"""Answers are asked for a bounded number of times, and once they are there never again."""

from __future__ import annotations

import collections

from pyspark.sql import functions as F

from docweave.operators.enrich import enrich_once
from docweave.operators.ledger import Ledger, by_round, client_executor
from docweave.operators.rounds import run_rounds


def recording(asked):
    """An executor whose first two calls fail for odd questions and every call for 'never'."""

    def ask(key, rows):
        asked[key].append(sorted(r.asked for r in rows.select("asked").collect()))
        fails = (F.col("asked").rlike("[13579]$") & F.lit(len(asked[key]) < 3)) | (F.col("asked").contains("never"))
        return rows.withColumn("answer", F.when(~fails, F.concat(F.lit("to "), "asked"))).withColumn("error", F.when(fails, "Timeout"))

    return ask


def test_each_question_until_it_is_answered(spark):
    asked = collections.defaultdict(list)
    ledger = Ledger(spark, attempts=3)
    rows = spark.createDataFrame([(i, f"q{i % 4}") for i in range(40)] + [(98, "never"), (99, None)], "k int, asked string")
    got = {r.k: r.answer for r in ledger.wrap(recording(asked))("r", rows).collect()}
    assert got == {i: f"to q{i % 4}" for i in range(40)} | {98: None, 99: None}
    assert asked["r"] == [["never", "q0", "q1", "q2", "q3"], ["never", "q1", "q3"], ["never", "q1", "q3"]]
    known = {r.answer: (r.attempts, r.error) for r in ledger.known("r").collect()}
    assert known == {"to q0": (1, None), "to q1": (3, None), "to q2": (1, None), "to q3": (3, None), None: (3, "Timeout")}
    answers = ledger.entries("r").where("answer is not null").groupBy("digest").count()
    assert answers.count() == 4 and answers.where("count > 1").isEmpty()


def test_a_later_run_asks_only_what_is_new(spark):
    asked = collections.defaultdict(list)
    first = Ledger(spark, attempts=1)
    rows = lambda *qs: spark.createDataFrame([(i, q) for i, q in enumerate(qs)], "k int, asked string")
    first.wrap(recording(asked))("r", rows("q0", "q1", "q2")).collect()
    again = Ledger(spark, first.folder, attempts=3)
    got = again.wrap(recording(asked))("r", rows("q0", "q1", "q4")).collect()
    assert sorted(r.answer for r in got) == ["to q0", "to q1", "to q4"]
    assert asked["r"] == [["q0", "q1", "q2"], ["q1", "q4"], ["q1"]]
    assert again.wrap(recording(asked))("r", rows("q0", "q1")).count() == 2 and len(asked["r"]) == 3
    assert again.wrap(recording(asked))("other", rows("q0")).count() == 1 and asked["other"] == [["q0"]]


def test_rounds_behind_a_ledger(spark):
    calls = spark.sparkContext.accumulator(0)

    def client(key, question):
        calls.add(1)
        if "bad" in question:
            raise ValueError(key)
        return f"{key}({question.splitlines()[-1]})"

    ledger = Ledger(spark, attempts=2)
    executor = ledger.wrap(by_round({k: client_executor(client) for k in ("one", "two")}))
    work = spark.createDataFrame([(i, ["x", "y", "bad"][i % 3]) for i in range(30)], "k int, prompt string")
    state = run_rounds(work, ["one", "two"], executor, {k: {"answer": F.col(k).isNotNull()} for k in ("one", "two")}, {})
    assert {(r.prompt, r.one, r.two, r.failed) for r in state.collect()} == {
        ("x", "one(x)", "two(one(x))", ""), ("y", "one(y)", "two(one(y))", ""), ("bad", None, None, "one:answer")
    }
    assert calls.value == 2 + 2 + 2  # two good questions in each round, the bad one twice
    assert state.count() == 30 and calls.value == 6


def test_enrichment_is_asked_once_and_reports_failures(spark):
    calls = spark.sparkContext.accumulator(0)

    def client(seq, raw):
        calls.add(1)
        if raw == "broken":
            raise TimeoutError
        return f"{seq}:{raw}"

    rows = [("d1", 0, "same"), ("d2", 3, "same"), ("d2", 1, "broken"), ("d3", 2, "")]
    sections = spark.createDataFrame(rows, "doc_id string, seq int, raw string").withColumn("sha256", F.sha2("raw", 256))
    ledger = Ledger(spark, attempts=3)
    got = enrich_once(sections, client, ledger=ledger)
    assert sorted(r.ai_md for r in got.collect()) == ["(failed: TimeoutError)", "0:same", "2:"]
    assert calls.value == 5
    assert enrich_once(sections, client, ledger=ledger).count() == 3 and calls.value == 5
