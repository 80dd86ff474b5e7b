"""A folder of files read with a quarantine, written with a manifest, and attachments with their anchors."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docweave.sources import files
from docweave.sources.files import attachments, fair_path, manifest, read_archived, read_documents, sync_states, write_files


def test_a_folder_with_good_broken_and_foreign_files(spark, tmp_path):
    (tmp_path / "in" / "deep er").mkdir(parents=True)
    contents = {
        "a.md": "# é\n".encode(), "b.TXT": b"plain", "deep er/c.markdown": b"c", "empty.md": b"", "mark.md": b"\xef\xbb\xbftext", "broken.md": b"ok \xff\xfe",
        "cut.txt": "漢".encode()[:2], "x.png": b"\x89PNG", "book.pdf": b"%PDF", "none": b"no ending", "long.md": b"x" * 2000, "_hidden.md": b"no", ".dot.md": b"no",
    }
    for name, content in contents.items():
        (tmp_path / "in" / name).write_bytes(content)
    got = {r.name: (r.text, r.reason, r.bytes) for r in read_documents(spark, f"file://{tmp_path}/in", most=1000).collect()}
    assert got == {
        "a.md": ("# é\n", "", 5), "b.TXT": ("plain", "", 5), "deep er/c.markdown": ("c", "", 1), "mark.md": ("text", "", 7), "broken.md": (None, "encoding", 5),
        "cut.txt": (None, "encoding", 2), "x.png": (None, "extension", 4), "book.pdf": (None, "parser", 4), "none": (None, "extension", 9), "long.md": (None, "size", 2000),
    }
    (tmp_path / "empty").mkdir()
    assert read_documents(spark, f"file://{tmp_path}/empty").count() == 0


def test_tasks_list_and_read_a_folder_as_spark_does(spark, tmp_path, monkeypatch):
    root = tmp_path / "in 100%"
    names = ["a.md", "deep/er/still/b.txt", "deep/er/c d.MD", "deep/x.png", "é/漢.markdown", "_a=b.md", "_metadata.md", "_no.md", ".no.md", "c._COPYING_", "_no/d.md", ".no/d.md", "100%25 #1?.md", "big.md", "late.txt"]
    for i, name in enumerate(names):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode() * (i + 1) + (b"x" * 4000 if name == "big.md" else b""))
    (root / "bare" / "folder").mkdir(parents=True)
    monkeypatch.setattr(files, "BYTES_OF_BATCH", 200)
    both = files._read_by_tasks(spark, root.as_uri(), 1 << 20), files._read_by_spark(spark, str(root), 1 << 20)
    shown = [{(r.name, r.bytes, r.content and bytes(r.content)) for r in rows.collect()} for rows in both]
    assert shown[0] == shown[1] and {n for n, _, _ in shown[0]} == set(names) - {"_metadata.md", "_no.md", ".no.md", "c._COPYING_", "_no/d.md", ".no/d.md"}
    got = read_documents(spark, str(root))
    assert got.count() == len(shown[0]) and "binaryFile" not in got._jdf.queryExecution().toString()
    with pytest.raises(FileNotFoundError):
        read_documents(spark, f"{tmp_path}/nowhere")


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def states(df):
    return {r.path: r.state for r in df.collect()}


def there(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in Path(folder).rglob("*") if p.is_file() and not str(p.relative_to(folder)).startswith("_")}


def test_only_what_changed_is_written(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    first = [("a/one.md", "1"), ("a/two.md", "2"), ("空 格.md", "")]
    assert states(write_files(frame(spark, first), folder)) == dict.fromkeys([p for p, _ in first], "new")
    assert there(tmp_path / "out") == dict(first)
    before = {p: os.stat(tmp_path / "out" / p).st_mtime_ns for p, _ in first}
    assert set(states(write_files(frame(spark, first), folder)).values()) == {"same"}
    assert len(list((tmp_path / "out" / "_manifest").iterdir())) == 1
    second = [("a/one.md", "1"), ("a/two.md", "changed"), ("b/three.md", "3")]
    expected = {"a/one.md": "same", "a/two.md": "changed", "b/three.md": "new", "空 格.md": "gone"}
    assert states(sync_states(frame(spark, second), folder)) == expected
    assert states(write_files(frame(spark, second), folder)) == expected
    assert there(tmp_path / "out") == dict(second) | {"空 格.md": ""}
    assert os.stat(tmp_path / "out" / "a/one.md").st_mtime_ns == before["a/one.md"]
    assert states(write_files(frame(spark, second), folder, remove=True))["空 格.md"] == "gone"
    assert there(tmp_path / "out") == dict(second)
    assert {r.path for r in manifest(spark, folder).collect()} == {p for p, _ in second}
    assert not [p for p in there(tmp_path / "out") if "draft" in p]


def test_archives_hold_the_same_files(spark, tmp_path):
    folder, held = f"file://{tmp_path}/out", lambda: {r.path: bytes(r.content).decode() for r in read_archived(spark, folder).collect()}
    first = [(f"d{i}/" + "n" * i + "é.md", "x" * (i * 40)) for i in range(200)]
    assert set(states(write_files(frame(spark, first), folder, archived=True)).values()) == {"new"}
    assert held() == dict(first) and there(tmp_path / "out") == {}
    assert len(list((tmp_path / "out" / "_archives").iterdir())) < 20
    second = [*first[:100], ("d150/other.md", "漢"), (first[120][0], "changed")]
    expected = dict.fromkeys([p for p, _ in first], "gone") | dict.fromkeys([p for p, _ in first[:100]], "same") | {"d150/other.md": "new", first[120][0]: "changed"}
    assert states(write_files(frame(spark, second), folder, archived=True)) == expected
    assert held() == dict(first) | dict(second)
    write_files(frame(spark, second), folder, remove=True, archived=True)
    assert held() == dict(second)


def test_files_are_rendered_once_and_their_contents_arent_shuffled(spark, tmp_path):
    def noted(batches):
        for batch in batches:
            (tmp_path / "made" / os.urandom(8).hex()).write_text(str(batch.num_rows))
            yield batch

    (tmp_path / "made").mkdir()
    folder, first = f"file://{tmp_path}/out", [(f"d{i}/é.md", os.urandom(5000).hex()) for i in range(100)]
    made = files.rendered(frame(spark, first).mapInArrow(noted, "path string, content string"))
    shuffled = lambda: sum(p.stat().st_size for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data"))
    before = shuffled()
    for state in ("new", "same"):
        assert set(states(write_files(made, folder, archived=True, once=False)).values()) == {state}
    assert sum(int(p.read_text()) for p in (tmp_path / "made").iterdir()) == 100
    assert shuffled() - before < 100_000
    assert {r.path: bytes(r.content).decode() for r in read_archived(spark, folder).collect()} == dict(first)
    assert set(states(sync_states(made, folder)).values()) == {"same"}


def test_paths_that_leave_the_folder_and_rows_that_clash_are_refused(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    rows = [("../x", "x"), ("/abs", "x"), ("a//b", "x"), (".hid", "x"), ("_manifest/0", "x"), ("n" * 256, "x"), (None, "x"), ("null", None), ("twice", "1"), ("twice", "2"), ("good", "g")]
    got = states(write_files(frame(spark, rows), folder))
    assert got == dict.fromkeys({p for p, _ in rows}, "refused") | {"good": "new"}
    assert there(tmp_path / "out") == {"good": "g"} and not (tmp_path / "x").exists()
    assert write_files(frame(spark, []), f"file://{tmp_path}/none").count() == 0
    df = spark.createDataFrame([("a\0b",), ("a/../b",), ("ü/ß.md",)], "p string")
    assert [r[0] for r in df.select(fair_path(F.col("p"))).collect()] == [False, False, True]


def test_attachments(spark):
    sources = spark.createDataFrame([(1, 10), (2, 20)], "source_id long, course_id long")
    chapters = spark.createDataFrame([(5, 1, 10), (6, 2, 20)], "chapter_id long, source_id long, course_id long")
    specs = [(1, 10, 1, 5, "a\n\nb\f c "), (2, 10, 1, None, None), (3, 20, 1, None, "x"), (4, 10, 1, 6, "x"), (5, 10, 9, 5, "x"), (6, None, 1, None, "x")]
    df = spark.createDataFrame(specs, "attachment_id long, course_id long, source_id long, chapter_id long, text string")
    got = {r.attachment_id: r for r in attachments(df, sources, chapters).collect()}
    assert {k: r.violations for k, r in got.items()} == {1: "", 2: "", 3: "source", 4: "chapter", 5: "source,chapter", 6: "source"}
    n = got[1].namespace
    assert [a.anchor for a in got[1].anchors] == [f"att:{n}:p1:para1", f"att:{n}:p1:para2", f"att:{n}:p2:para1"]
    assert got[2].anchors == [] and got[3].anchors is None


def test_the_dashboard_makes_its_tables_once_and_writes_archives(spark, monkeypatch):
    from docweave.plans import bundle_queries as b
    from docweave.plans.queries import QUERIES

    made, labels = [], b.topic_labels
    monkeypatch.setattr(b, "topic_labels", lambda t: made.append("labels") or labels(t))
    monkeypatch.setattr(b, "write_files", lambda files, folder, **how: made.append(how))
    QUERIES["pipe_course_dashboard"](spark, "/root/testdata/sf0.001")
    assert made == ["labels", {"archived": True}]
