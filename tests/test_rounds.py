"""Rounds, their rules, publication guards and rendered notes on small fixtures."""

import json

from pyspark.sql import functions as F

from docweave.operators import changes, diagrams, rendering, rounds
from docweave.operators.validation import violations
from docweave.plans import pipelines


def broken(spark, rules, columns, rows):
    df = spark.createDataFrame(rows, columns)
    return [r[0] for r in df.select(violations(rules)).collect()]


def judged(spark, rule, cases):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)] + [(99, None)], "i int, text string")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("text"))).collect()]


def test_topic_diagrams(spark):
    styled = """flowchart LR
%% a comment
subgraph S[战略分析]
  A[识别问题] --> B(比较方案)
  B -->|形成选择| C{执行?}
end
classDef focus fill:#fff,stroke:#333
class A,B focus
style C fill:#eee
linkStyle 0 stroke:#333
"""
    cases = {
        "graph TD\nA --> B": True,
        styled: True,
        "graph TD\nsubgraph A[外层]\nsubgraph B[内层]\n  X[开始] --> Y[结束]\nend\nend\n": True,
        "graph TD\nA-->B": True,
        "graph TD\nA -- why not --> B\nA --- C\nA -.-> D\nA ==> E": True,
        "graph TD\nsubgraph free words\nA --> B\nend": True,
        "graph TD\nA[a 'quoted ( bracket'] --> B": True,
        "graph TD\nA[an open ( bracket] --> B": False,
        "graph TD\nA['x'] --> B": True,
        "graph TD\nA['x] --> B": False,
        "graph TD": False,
        "graph XX\nA --> B": False,
        "\ngraph TD\nA --> B": False,
        "graph TD\nA --> B<b>": False,
        "graph TD\nsay --> ": False,
        "graph TD\nA --> B --> C": False,
        "graph TD\n  A --> B\n  ???": False,
        "flowchart LR\n  A[未闭合 --> B": False,
        "graph TD\n  A[只有节点]": False,
        "graph TD\n  A --> B\n  click A https://evil.example": False,
        "graph TD\n  A --> B\n  这是任意自然语言": False,
        "graph TD\n  end\n  A --> B": False,
        "graph TD\n  subgraph S[一]\n  A --> B\n  end\n  end": False,
        "graph TD\n  subgraph S[一]\n  A --> B": False,
        "```mermaid\ngraph TD\nA --> B\n```": False,
        "graph TD\n  A[<script>alert(1)</script>] --> B": False,
        "graph TD\n\3 --> B": False,
        "": False,
    }
    assert judged(spark, lambda c: diagrams.topic_diagram(c)["valid"], cases) == [*cases.values(), False]


def test_note_diagrams(spark):
    cases = {
        'flowchart TD\n  A["开始"] --> B["结束"]': True,
        'graph LR\n  A["概念"] --- B["应用"]': True,
        "mindmap\n  root((主题))\n    概念": True,
        "graph LR\r\n  A --> B : why\r\n": True,
        "sequenceDiagram\n  A->>B: hi": False,
        'flowchart TD\n  A["<script>alert(1)</script>"]': False,
        "flowchart TD\n  A --> B\n```": False,
        "flowchart XX\n  A --> B": False,
        "flowchart TD\n  A-->B": False,
        "flowchart TD\n  subgraph S\n  A --> B\n  end": False,
        'flowchart TD\n  A["x] --> B': False,
        "mindmap\n  概念": False,
        "mindmap\n  root\nx": False,
        "mindmap": False,
        "graph TD\n  A --> B : onclick = x": False,
        "": False,
    }
    assert judged(spark, diagrams.note_diagram, cases) == [*cases.values(), False]


def test_long_diagrams(spark):
    text = "graph TD\n" + "subgraph S\n" * 3000 + "A --> B\n" * 3000 + "end\n" * 3000
    row = spark.createDataFrame([(text,)], "t string").select(diagrams.topic_diagram(F.col("t")).alias("g")).first().g
    assert tuple(row) == (True, 3000, 3000)


def test_rounds_stop_at_the_first_broken_rule(spark):
    asked = []

    def executor(key, rows):
        asked.append(key)
        return rows.withColumn("answer", F.when(F.col("k") == 2, F.lit(None)).otherwise(F.concat(F.lit(f"{key}<"), "asked", F.lit(">"))))

    work = spark.createDataFrame([(1, "p"), (2, "p"), (3, None)], "k int, prompt string")
    rules = {"a": {"long": F.length("a") > 1}, "b": {"has": F.col("b").contains("a<")}}
    rows = {r.k: r for r in rounds.run_rounds(work, ["a", "b"], executor, rules, {"prompt": F.col("prompt").isNotNull()}).collect()}
    assert (rows[1].a, rows[1].b, rows[1].failed) == ("a<a\np>", "b<b\np\na<a\np>>", "")
    assert (rows[2].a, rows[2].b, rows[2].failed) == (None, None, "a:long")
    assert (rows[3].a, rows[3].failed) == (None, "start:prompt") and asked == ["a", "b"]
    assert rounds.run_rounds(work.limit(0), ["a", "b"], executor, rules, {}).count() == 0


LABEL = "[《book》·第 1 章]"


def topic_row(**change):
    answers = {k: {n: "text" for n in names} for k, names in rounds.TOPIC_TEXTS.items()}
    answers["alignment"]["linked_sources"] = f"see {LABEL}"
    answers["mermaid"] = {"knowledge_diagram": "graph TD\nA --> B", "application_diagram": "graph LR\nA --> B"}
    answers["cards"] = {"cards": [{"card_type": "c", "title": str(i), "content": "x", "source_refs": [LABEL]} for i in range(8)]}
    answers["review"] = {"passed": True, "issues": []}
    for key, value in change.items():
        answers[key] = value(answers[key])
    return (*[a if isinstance(a, str) else json.dumps(a, ensure_ascii=False) for a in (answers[k] for k in rounds.TOPIC_ROUNDS)], [LABEL])


def test_topic_rules(spark):
    columns = ", ".join(f"{k} string" for k in rounds.TOPIC_ROUNDS) + ", labels array<string>"
    rules = rounds.topic_rules(F.col("labels"))
    cases = [
        ("alignment", topic_row(), ""),
        ("alignment", topic_row(alignment=lambda a: a | {"more": "x"}), "shape"),
        ("alignment", topic_row(alignment=lambda a: a | {"overview": " "}), "shape"),
        ("alignment", topic_row(alignment=lambda a: a | {"overview": "[《other》·第 1 章]"}), "labels"),
        ("alignment", topic_row(alignment=lambda a: a | {"linked_sources": "none"}), "sources"),
        ("alignment", topic_row(alignment=lambda a: "not json"), "shape,labels,sources"),
        ("mermaid", topic_row(mermaid=lambda a: a | {"knowledge_diagram": "graph"}), "lines"),
        ("cards", topic_row(cards=lambda a: {"cards": a["cards"][:7]}), "number"),
        ("cards", topic_row(cards=lambda a: {"cards": a["cards"] + [a["cards"][0] | {"source_refs": []}]}), "shape"),
        ("cards", topic_row(cards=lambda a: {"cards": a["cards"] + [a["cards"][0] | {"source_refs": ["x"]}]}), "labels"),
        ("review", topic_row(), ""),
        ("review", topic_row(review=lambda a: a | {"issues": ["bad"]}), "passed"),
        ("review", topic_row(review=lambda a: a | {"passed": False}), "passed"),
    ]
    for key, row, expected in cases:
        got = broken(spark, rules[key], columns, [row])[0]
        # An answer that isn't JSON breaks its shape; what else it breaks isn't told apart.
        assert got == expected or (expected.count(",") and got.startswith("shape")), (key, expected, got)


def test_outline_rules(spark):
    topic = lambda title, *ids: {"title": title, "description": "", "reason": "", "chapter_ids": list(ids)}
    cases = [
        ([topic("a", 1), topic("b", 2)], [3], ""),
        ([topic("a", 1), topic("A", 2)], [3], "titles"),
        ([topic("Ａ  教材", 1), topic("a 教材", 2)], [3], "titles"),
        ([topic("a", 1, 1), topic("b", 2)], [3], "repeats"),
        ([topic("a", 1), topic("b", 9)], [2, 3], "foreign"),
        ([topic("a", 1), topic("b", 2)], [2, 3], "overlap"),
        ([topic("a", 1)], [3], "cover"),
        ([], [1, 2, 3], "shape"),
    ]
    rows = [(json.dumps({"topics": t, "unmapped_chapter_ids": u}), [1, 2, 3]) for t, u, _ in cases]
    got = broken(spark, rounds.outline_rules(F.col("ids"))["topic_outline"], "topic_outline string, ids array<bigint>", rows)
    assert got == [e for *_, e in cases]


def test_outline_replaces_drafts_only_where_valid(spark):
    parents = spark.createDataFrame([(1,), (2,), (3,), (4,)], "source_id int")
    chapters = spark.createDataFrame([(1, 11, "x"), (2, 21, "y"), (4, 41, None), (4, 42, "z")], "source_id int, chapter_id long, title string")
    reviews = spark.createDataFrame([(11, "DONE", False), (21, "DONE", True), (41, "DONE", False), (42, "DONE", False)], "chapter_id long, status string, stale boolean")
    drafts = spark.createDataFrame([(1, "old", [11]), (2, "old", [21])], "source_id int, title string, chapter_ids array<bigint>")

    def executor(key, rows):
        made = F.struct(F.transform("ids", lambda i: F.struct(F.lit("T").alias("title"), F.array(i).alias("chapter_ids"))).alias("topics"), F.array().cast("array<bigint>").alias("unmapped_chapter_ids"))
        return rows.withColumn("answer", F.to_json(made))

    out = {r.source_id: (r.failed, r.n_topics, r.outline) for r in pipelines.topic_outline(parents, chapters, reviews, drafts, executor, key="source_id").collect()}
    assert out == {1: ("", 1, "T:11"), 2: ("start:blocking", 1, "old:21"), 3: ("start:chapters", 0, ""), 4: ("topic_outline:titles", 0, "")}
    few = pipelines.topic_outline(parents, chapters, reviews, drafts, executor, key="source_id", most=1)
    assert {r.source_id: r.failed for r in few.collect()}[4] == "start:size"


def test_publication_guards(spark):
    parents = spark.createDataFrame([(i, "RUNNING" if i != 2 else "READY", "why" if i == 4 else "") for i in range(1, 8)], "k int, status string, stale_reason string")
    asked = spark.createDataFrame([(i, "me", "f", "") for i in range(1, 7)], "k int, owner_id string, expected string, baseline string")
    current = spark.createDataFrame([(i, "g" if i == 3 else "f") for i in range(1, 8)], "k int, fingerprint string")
    leases = spark.createDataFrame([(i, "you" if i == 5 else "me", 10 if i == 6 else 11) for i in range(1, 8)], "k int, owner_id string, expires_at int")
    out = {r.k: (r.status, r.violations) for r in changes.publish(parents, asked, current, leases, "k", 10).collect()}
    assert out[1] == ("COMPLETED", "") and out[2] == ("READY", "status") and out[7] == ("RUNNING", None)
    assert [out[i][1] for i in (3, 4, 5, 6)] == ["fingerprint", "baseline", "lease", "lease"]
    assert changes.publish(parents, asked, current, leases, "k", 10, running=False).where("k = 2").first().status == "COMPLETED"


def test_notes_pass_their_own_rules(spark):
    tree = spark.createDataFrame([(1, "c", "1", 'A <b> "x"', 1, 2, 1)], "source_id int, id string, number string, title string, page_start int, page_end int, level int")
    lines = spark.createDataFrame([(1, 1, 1, "one ```"), (1, 2, 1, None), (1, 2, 2, ""), (1, 3, 1, "other")], "source_id int, page int, line_no int, line string")
    note = rendering.note_markdown(tree, lines, "v")
    row = note.first()
    assert "&lt;b&gt;" in row.note and "[src:1:p1:1]" in row.note and "p3" not in row.note
    assert note.select(violations(rendering.note_rules(F.col("note"), F.array(F.lit("[src:1:p1:1]"))))).first()[0] == ""
    assert note.select(violations(rendering.generated_rules(F.col("note"), F.col("note")))).first()[0] == "refs,texts"


def test_report_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id int, reason string")
    work = spark.createDataFrame([], "sha256 string, retries int")
    done = spark.createDataFrame([], "section_sha string")
    got = {r.metric: (r.n, r.rate) for r in rendering.reconcile_report(pages, pages, work, done).collect()}
    assert got == {"cache_hits": (0, None), "retries": (0, None)}


def test_publication_of_a_topic_is_guarded(spark):
    """Each guard refuses its topic, and only its topic."""
    topics = spark.createDataFrame([(i, "t", "READY", True, "", "me") for i in range(5)], "topic_id long, title string, status string, confirmed boolean, stale_reason string, owner_id string")
    labels = spark.createDataFrame([(i, 1, 0, "chapter", LABEL) for i in range(5)], "topic_id long, source_id long, seq int, title string, label string")
    answers = dict(zip(rounds.TOPIC_ROUNDS, topic_row()[:-1], strict=True))
    executor = lambda key, rows: rows.withColumn("answer", F.when(F.col("asked").isNotNull(), F.lit(answers[key])))
    changed = labels.withColumn("label", F.when(F.col("topic_id") == 1, "[《book》·第 2 章]").otherwise(F.col("label"))).where("topic_id <> 4")
    after = topics.withColumn("stale_reason", F.when(F.col("topic_id") == 2, "meanwhile").otherwise(""))
    leases = topics.select("topic_id", "owner_id", F.when(F.col("topic_id") == 3, 10).otherwise(11).alias("expires_at"))
    out = {r.topic_id: r for r in pipelines.topic_fusion(topics, labels, executor, changed, after, leases, 10).collect()}
    assert {k: r.failed for k, r in out.items()} == {0: "", 1: "publish:fingerprint", 2: "publish:baseline", 3: "publish:lease", 4: "publish:fingerprint"}
    assert out[0].note.startswith("# t\n") and all(out[k].note is None for k in range(1, 5))


def test_an_answer_is_read_once_however_many_rules_it_has(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("a int, b int")
    def read(text):
        calls.add(1)
        return (len(text), 2)

    executor = lambda key, rows: rows.withColumn("answer", F.col("prompt"))
    got = F.col("x_read")
    rules = {"x": {"one": got["a"] > 1, "two": got["b"] == 2, "three": got["a"] + got["b"] > 3}, "y": {"late": got["a"] < 4}}
    work = spark.createDataFrame([(1, "p"), (2, "pp"), (3, "pppp")], "k int, prompt string")
    state = rounds.run_rounds(work, ["x", "y"], executor, rules, {}, {"x": read.asNondeterministic()("x")})
    assert {r.k: r.failed for r in state.collect()} == {1: "x:one,three", 2: "", 3: "y:late"}
    assert calls.value == 3 and state.columns == ["k", "prompt", "failed", "x", "y"]


def test_runs_with_one_prompt_are_asked_as_one(spark, monkeypatch):
    from docweave.plans import structure_queries
    from docweave.plans.queries import QUERIES

    works = []
    monkeypatch.setattr(structure_queries, "run_rounds", lambda work, *rest: works.append(work) or rounds.run_rounds(work, *rest))
    got = QUERIES["udf_round_executor"](spark, "/root/testdata/sf0.001")
    assert works[0].count() == works[0].select("prompt").distinct().count() < got.count()
