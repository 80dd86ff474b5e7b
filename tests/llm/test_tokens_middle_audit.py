"""Byte-level BPE, fill-in-the-middle and the filter audit against plain Python, on odd rows, and on empty tables."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from docweave.llm import byte_bpe, fill_middle, filter_audit
from docweave.llm.queries import QUERIES
from tests.llm.test_operators import ODD, SCHEMA, SF, WORDS, frame

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def plain_bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS[0], "rb"))}
    return tiktoken.Encoding("plain", pat_str=RANKS[1], mergeable_ranks=ranks, special_tokens={})


# Byte-level BPE --------------------------------------------------------------------------------------


def strange_texts():
    rng = random.Random(4)
    letters = "aB9 \n\t'! 　\x1c\x85 éß漢字😀́|<>$%&_\x00 ᠎"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    points = [c for c in range(0, 0x110000, 31) if not 0xD800 <= c < 0xE000]
    out += [f"a{chr(c)}a {chr(c)}1{chr(c)}{chr(c)}!{chr(c)}  x\n{chr(c)}" for c in points]
    return [*out, "x" * 5000, " " * 5000, "ab " * 3000, "<|endoftext|>", "it's we'll 'Sx", "ünï" * 4000]


def test_ids_are_those_of_the_plain_library(plain_bpe, monkeypatch):
    texts = strange_texts()
    expected = plain_bpe.encode_ordinary_batch(texts)
    bpe = byte_bpe.ByteBpe(*RANKS)
    assert [list(ids) for ids, _, _ in bpe.encode(texts)] == expected
    monkeypatch.setattr(byte_bpe, "REACH", 50)  # long texts in many pieces, and a memory that is often lost
    monkeypatch.setattr(byte_bpe, "KEEP", 20)
    again = byte_bpe.ByteBpe(*RANKS).encode(texts)
    assert [list(ids) for ids, _, _ in again] == expected
    assert [bpe.decode(ids) for ids, _, _ in again] == [t.encode() for t in texts]
    for (_, starts, ends), text, ids in zip(again, texts, expected, strict=True):
        raw, at, where = text.encode(), 0, []
        for token in ids:
            size = len(plain_bpe.decode_single_token_bytes(token))
            where.append((len(raw[:at].decode("utf-8", "ignore")), len(raw[: at + size].decode("utf-8", "replace"))))
            at += size
        assert list(zip(starts, ends, strict=True)) == where


def test_split_characters_and_unknown_ids(spark):
    bpe = byte_bpe.ByteBpe(*RANKS)
    (ids, starts, ends), = bpe.encode(["ab 😀漢 c"])
    assert any(a < b for a, b in zip(starts[1:], ends[:-1], strict=True))
    rows = spark.createDataFrame([(1, [int(i) for i in ids]), (2, []), (3, None)], "k int, ids array<int>").withColumn("decoded", F.lit("old"))
    assert {r.k: r.decoded and bytes(r.decoded) for r in byte_bpe.decode_tokens(rows, RANKS[0]).collect()} == {1: "ab 😀漢 c".encode(), 2: b"", 3: None}
    for a, b in itertools.combinations(range(len(ids) + 1), 2):
        part = bpe.decode(ids[a:b])
        whole = byte_bpe.whole_characters(part)
        assert whole in part
        assert whole.decode() in "ab 😀漢 c"
        assert len(part) - len(whole) < 7
    with pytest.raises(ValueError):
        bpe.decode(np.array([60_000]))


def check_tokens(plain_bpe, rows, got):
    expected = []
    for doc_id, text in rows:
        ids = plain_bpe.encode_ordinary(text or "")
        expected.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(text or "")))
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=key) == sorted(expected, key=key)


def test_token_query_on_whole_tables_and_odd_rows(spark, docs, plain_bpe, tmp_path):
    check_tokens(plain_bpe, docs.select("doc_id", "text").collect(), QUERIES["op11_byte_bpe"](spark, SF).collect())
    frame(spark, ODD).write.parquet(f"file://{tmp_path}/documents.parquet")
    check_tokens(plain_bpe, [r[:2] for r in ODD], QUERIES["op11_byte_bpe"](spark, f"file://{tmp_path}").collect())


# Fill in the middle ----------------------------------------------------------------------------------


@pytest.mark.parametrize("offsets", [
    [0], [5], list(range(1000)), list(range(0, 200_000, 3)), [*range(70_000, 75_000), 200_000, 400_000],
    sorted(random.Random(1).sample(range(65_536), 20_000)), sorted(random.Random(2).sample(range(1_000_000), 3000)),
])
def test_select_in_containers(offsets):
    found = fill_middle.BoundarySet(np.array(offsets, np.int64))
    assert len(found) == len(offsets)
    assert [found.select(k) for k in range(0, len(offsets), 7)] == offsets[::7]
    with pytest.raises(IndexError):
        found.select(len(offsets))


def test_every_kind_of_container():
    kinds = {type(fill_middle.container(np.array(x))).__name__ for x in ([1, 5, 9], list(range(500)), list(range(0, 65_536, 2)))}
    assert kinds == {"ArrayContainer", "RunContainer", "BitmapContainer"}


def middle_of(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, len(units), form, len(p), len(m), sha(out), sha(text)


def test_middles_on_odd_rows(spark, tmp_path):
    rng = random.Random(9)
    more = [(i, "".join(rng.choice("ab\nü<P>S😀 ") for _ in range(rng.randint(0, 300))), "en", "s") for i in range(100, 400)]
    more += [(500, "\n" * 100_000, "en", "s"), (501, "x\n" * 50_000, "en", "s"), (502, "line\n" * 3 + "<M>", "en", "s"), (503, "<S", "en", "s")]
    rows = ODD + more
    frame(spark, rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = QUERIES["op12_fill_in_middle"](spark, f"file://{tmp_path}").collect()
    assert sorted(map(tuple, got), key=str) == sorted((middle_of(*r[:2]) for r in rows), key=str)


def test_share_and_marks_of_middles(spark):
    docs = frame(spark, [(i, f"a {i}\nb\nc", "en", "s") for i in range(400)])
    forms = [r.form for r in fill_middle.fill_in_middle(docs, percent=50, spm_percent=0).collect()]
    assert 140 < forms.count("plain") < 260 and "spm" not in forms
    marks = ("(a.b)", "[c]", "$d")
    made = fill_middle.fill_in_middle(docs, sentinels=marks).join(docs.select("doc_id", "text"), "doc_id")
    assert made.where(fill_middle.restored(F.col("output"), F.col("form"), marks) != F.col("text")).isEmpty()


# Filter audit ----------------------------------------------------------------------------------------


def audit_of(rows, labels):
    """The report from all masks and all orders, one document after the other."""
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = {}
    for doc_id, text, part in rows:
        text = text or ""
        words = WORDS.findall(text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None,
            "E": doc_id is not None and least[text] < doc_id,
        }
        parts.setdefault(part or "", []).append(({k for k, v in fails.items() if v}, doc_id))
    out = []
    for part, found in parts.items():
        report, summed = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [i for f, i in found if letter in f and not before & f]
                kept = sum(not f & {letter, *before} for f, _ in found)
                redundant = sum(letter in f and bool(before & f) for f, _ in found)
                unique = sum(f == {letter} for f, _ in found)
                report.append((part, "".join(order), step, kept, len(gone), redundant, unique, sum(i in good for i in gone), sum(i in toxic for i in gone)))
                summed[letter] += len(gone)
        out += [(*r, summed[r[1][r[2] - 1]]) for r in report]
    return sorted(out)


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_retracts_over_many_batches(spark, tmp_path):
    rng = random.Random(6)
    pool = ["short #", "WORDS IN CAPITALS", " ".join(f"w{i}" for i in range(120)), "same " * 150, None, "", "x " * 30 + "$"]
    rows = [(rng.randrange(150) if rng.random() < 0.95 else None, rng.choice(pool), rng.choice(["en", "de", None, ""])) for _ in range(300)]
    rows.sort(key=lambda r: -(r[0] or 0))  # ids fall from file to file, so that each file takes the copies' place
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] * 2 + [(None, 1, 1)]
    for i in range(0, 300, 50):
        spark.createDataFrame(rows[i : i + 50], "doc_id long, text string, lang string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    stream = filter_audit.document_stream(spark, f"file://{tmp_path}/documents.parquet", micro_batches=6)
    counters = filter_audit.audit_stream(stream, spark.read.parquet(f"file://{tmp_path}/labels.parquet"))
    assert counters.agg(F.sum("n"), F.min("n")).first()[0] == 300
    assert counters.where("n < 0").isEmpty()
    assert sorted(tuple(r) for r in filter_audit.filter_orders(counters).select(*COLUMNS).collect()) == audit_of(rows, labels)


def test_audit_of_odd_rows_and_of_none(spark, tmp_path):
    frame(spark, ODD).write.parquet(f"file://{tmp_path}/documents.parquet")
    labels = "doc_id long, quality int, toxic int"
    spark.createDataFrame([(1, 1, 0), (6, None, 1)], labels).write.parquet(f"file://{tmp_path}/labels.parquet")
    got = QUERIES["op13_filter_audit"](spark, f"file://{tmp_path}").select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == audit_of([r[:3] for r in ODD], [(1, 1, 0), (6, None, 1)])


@pytest.mark.parametrize("name", ["op11_byte_bpe", "op12_fill_in_middle", "op13_filter_audit"])
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert QUERIES[name](spark, f"file://{tmp_path}").collect() == []


# Earlier operators -----------------------------------------------------------------------------------


def test_carried_columns_with_odd_names(spark):
    import corpus_pipeline

    extra = "`m.k` string, size string, _carry string, carried string"
    rows = [(i, f"text number {i}", "en", "s", 5, f"k{i}", "a", "b", "c") for i in range(20)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    mixed = corpus_pipeline.mixing(spark, docs, SF)
    assert mixed.columns == docs.columns
    assert {tuple(r) for r in mixed.collect()} <= set(rows)
    placed = corpus_pipeline.sharding(spark, docs, SF)
    assert sorted((r["doc_id"], r["m.k"], r["_carry"], r["carried"]) for r in placed.collect()) == sorted((r[0], r[5], r[7], r[8]) for r in rows)


def test_many_null_ids_with_one_text(spark):
    from docweave.llm.exact_dedup import exact_dedup

    docs = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    got = exact_dedup(docs).groupBy("kept", "group_size", "keep_id").count().collect()
    assert [tuple(r) for r in got] == [(True, 40_000, None, 40_000)]
