from docweave.operators.labels import cited_labels, label_coverage

A, B, C = (f"[《source {n}》·第 {n} 章]" for n in (1, 2, 3))
TEXTS = [("t", 2, f"{A} then {B}"), ("t", 1, f"{B}{C}{B}"), ("t", 3, None), ("u", 1, ""), (None, 1, f"x {C}"), ("v", 1, f"{A}[《》·第 1 章]")]


def test_labels_in_the_order_of_their_first_mention(spark):
    texts = spark.createDataFrame(TEXTS, "topic_id string, n long, content string")
    found = {(r.topic_id, r.place): r.label for r in cited_labels(texts, "topic_id", "n", "content").collect()}
    assert found == {("t", 1): B, ("t", 2): C, ("t", 3): A, (None, 1): C, ("v", 1): A}
    assert cited_labels(texts.limit(0), "topic_id", "n", "content").count() == 0


def test_labels_covered_by_texts_or_cards(spark):
    texts = spark.createDataFrame(TEXTS, "topic_id string, n long, content string")
    expected = spark.createDataFrame(
        [("t", A), ("t", A), ("t", C), ("u", A), ("u", B), ("v", B), ("v", A), ("w", None), (None, A)], "topic_id string, label string"
    )
    refs = spark.createDataFrame([("u", B), ("u", C), ("u", None), ("v", A)], "topic_id string, ref string")
    got = {tuple(r) for r in label_coverage(expected, texts, refs, "topic_id").collect()}
    assert got == {("t", 2, 2, 0, 0), ("u", 2, 0, 1, 1), ("v", 2, 1, 1, 1)}
    assert label_coverage(expected, texts, refs.limit(0), "topic_id").count() == 3


def test_rows_of_labels_are_dealt_out_before_they_are_reduced(spark):
    pairs = [("t", A)] * 300 + [("t", C)] * 50 + [("u", B)] * 50 + [("w", None), (None, A)]
    expected = spark.createDataFrame(pairs, "topic_id string, label string").repartition(3)
    texts = spark.createDataFrame(TEXTS * 40, "topic_id string, n long, content string").repartition(3)
    refs = spark.createDataFrame([("u", B), ("u", None)] * 40, "topic_id string, ref string")
    got = label_coverage(expected, texts, refs, "topic_id", tasks=7)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in label_coverage(expected, texts, refs, "topic_id").collect()} == {("t", 2, 2, 0, 0), ("u", 1, 0, 1, 0)}
    plan = got._jdf.queryExecution().sparkPlan().toString()
    below = plan[plan.index("partial_max") :]
    assert "REPARTITION_BY_NUM" in below and "partial" not in below[below.index("REPARTITION_BY_NUM") :]
