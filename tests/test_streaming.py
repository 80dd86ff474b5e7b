"""Streams over several files equal their batch forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docweave.operators.relational import replay, ring
from docweave.plans.pipelines import incremental_sections
from docweave.streaming import events as st

SCHEMA = "batch_id long, event_id long, ts timestamp, event string, payload string, task_id long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("events")
    start = dt.datetime(2024, 1, 1)
    rows = [(i % 3, i, start + dt.timedelta(minutes=i), "TASK_STATE", ["RUNNING", "COMPLETED"][i % 2], i % 4) for i in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{path}/log")
    return f"file://{path}/log"


def test_numbers_go_on_across_batches(spark, folder):
    got = st.numbered(st.event_stream(spark, folder, spark.read.parquet(folder).schema))
    seen = sorted((r.batch_id, r.seq, r.event_id) for r in got.collect())
    assert seen == [(b, i, b + 3 * i) for b in range(3) for i in range(20)]


def test_a_hot_batch_is_numbered_in_chunks(spark, tmp_path):
    """One user with a third of the events, times out of order, in three files: no chunk holds much of it."""
    start = dt.datetime(2024, 1, 1)
    rows = [(1 if i % 3 == 0 else 2 + i % 97, i, start + dt.timedelta(seconds=i - i % 500 + (i * 7919) % 500)) for i in range(3000)]
    for part in range(3):
        rows_of = spark.createDataFrame(rows[part * 1000 : part * 1000 + 1000], "batch_id long, event_id long, ts timestamp")
        rows_of.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/log")
    whole = spark.read.parquet(f"file://{tmp_path}/log")
    sizes = st.chunked(whole, ["batch_id", "ts", "event_id"], 12).groupBy("batch_id", "chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 3000 / 12 * 2
    got = st.numbered(st.event_stream(spark, f"file://{tmp_path}/log", whole.schema), chunks=12).collect()
    expected, n = {}, {}
    for part in range(3):
        for b, i, _ in sorted(rows[part * 1000 : part * 1000 + 1000], key=lambda r: (r[0], r[2], r[1])):
            expected[i] = (b, n.setdefault(b, 0))
            n[b] += 1
    assert {r.event_id: (r.batch_id, r.seq) for r in got} == expected


def test_nothing_to_number(spark, tmp_path):
    spark.createDataFrame([], "batch_id long, event_id long, ts timestamp").write.parquet(f"file://{tmp_path}/log")
    assert st.numbered(st.event_stream(spark, f"file://{tmp_path}/log", "batch_id long, event_id long, ts timestamp")).count() == 0


def test_ring_and_states(spark, folder):
    schema = spark.read.parquet(folder).schema
    seen = st.to_table(st.bounded(st.event_stream(spark, folder, schema), 5), "t", "update")
    last = seen.groupBy("batch_id").agg(F.max_by("event_ids", "last").alias("ids")).collect()
    assert {r.batch_id: r.ids for r in last} == {b: ",".join(str(i) for i in range(60) if i % 3 == b)[-14:] for b in range(3)}
    states = st.to_table(st.latest_states(st.event_stream(spark, folder, schema)), "t", "complete")
    assert states.count() == 12


def test_ring_buffer_and_replay(spark):
    events = spark.createDataFrame([(1, i) for i in range(10)], "batch_id int, seq int")
    assert sorted(r.seq for r in ring(events, 3).collect()) == [7, 8, 9]
    assert sorted(r.seq for r in replay(events, 10, 4).collect()) == [5, 6, 7, 8, 9]


TOKENS = "batch_id long, task_id long, section long, event_id long, event string, payload string"


def test_section_texts_are_sent_at_their_end(spark, tmp_path):
    """Tokens of a section lie in two files; what has ended is no longer in the state, what hasn't is."""
    first = [(1, 1, 0, 1, "TOKEN", "a"), (1, 1, 0, 2, "TOKEN", "b"), (1, 1, 1, 3, "TOKEN", "x"), (1, 2, 0, 4, "DONE", None), (1, 2, 0, 5, "TOKEN", None)]
    second = [(1, 1, 0, 7, "DONE", None), (1, 1, 0, 6, "TOKEN", "c"), (1, 2, 0, 8, "DONE", None), (1, 1, 1, 9, "DONE", None), (1, 1, 1, 10, "TOKEN", "y"), (1, 1, 1, 11, "DONE", None)]
    third = [(9, 9, 9, 12, "TOKEN", "open"), (9, 9, 9, 13, "TOKEN", "!")]
    for n, (rows, left) in enumerate([([first, second], []), ([first, second, third], [(9, 12, "open"), (9, 13, "!")])]):
        for i, part in enumerate(rows):
            spark.createDataFrame(part, TOKENS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in{n}")
        state = f"file://{tmp_path}/state{n}"
        got = st.to_table(st.section_texts(st.event_stream(spark, f"file://{tmp_path}/in{n}", TOKENS)), "t", state=state)
        assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 0, 3, "abc"), (1, 1, 1, 1, "x"), (1, 1, 1, 1, "y"), (1, 2, 0, 1, "")]
        held = st.state_of(spark, state, "tokens").select("key.batch_id", "list_element.event_id", "list_element.token")
        assert sorted(tuple(r) for r in held.collect()) == left


def test_buffers_expire_and_begin_anew(spark, tmp_path):
    """A gap inside a micro-batch, one across two, one that the watermark closes, and a buffer that is still alive."""
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    first = [(1, 1, at(0)), (1, 2, at(5)), (1, 3, at(60)), (2, 4, at(1)), (3, 5, at(50)), (4, 6, at(61))] + [(5, 100 + i, at(i)) for i in range(62)]
    second = [(3, 7, at(81)), (2, 8, at(90)), (4, 9, at(100)), (6, 10, at(131))]
    for rows in (first, second):
        spark.createDataFrame(rows, "batch_id long, event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/log")
    stream = st.event_stream(spark, f"file://{tmp_path}/log", "batch_id long, event_id long, ts timestamp")
    state = f"file://{tmp_path}/state"
    got = st.to_table(st.expiries(stream, keep=10, seconds=30 * 60), "t", state=state)
    seen = sorted((r.batch_id, int((r["last"] - at(0)).total_seconds() // 60), r.n) for r in got.collect())
    assert seen == [(1, 5, 2), (1, 60, 1), (2, 1, 1), (2, 90, 1), (3, 50, 1), (3, 81, 1), (4, 61, 1), (4, 100, 1), (5, 61, 10)]
    held = st.state_of(spark, state, "events").select("key.batch_id", "list_element.event_id")
    assert [tuple(r) for r in held.collect()] == [(6, 10)]


def test_a_table_of_many_files_takes_few_micro_batches(spark, tmp_path):
    place = f"file://{tmp_path}/docs"
    spark.range(240).selectExpr("id AS doc_id", "concat('text ', id % 100) AS text").repartition(24).write.parquet(place)
    seen = []
    st.run_to_end(st.table_stream(spark, place), "few", "append", lambda df, _: seen.append(df.count()))
    assert len(seen) <= 6 and sum(seen) == 240
    assert incremental_sections(st.table_stream(spark, place)).count() == 100
