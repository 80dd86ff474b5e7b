"""Behaviour that SQL twins can't show: Unicode, truth tables, order of input."""

import pytest
from pyspark.sql import functions as F

from docweave.functions import text as x
from docweave.operators import chapters, enrich, pages, sections
from docweave.operators.validation import balanced
from docweave.sources.documents import without_images


def values(spark, expression, *columns):
    names = [f"c{i}" for i in range(len(columns[0]))]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(columns)], ["i", *names])
    return [r[0] for r in df.orderBy("i").select(expression(*[F.col(n) for n in names])).collect()]


def test_text_conflicts(spark):
    cases = [("利润为 10%", "利润为10％"), ("學習管理", "学习管理"), ("10%", "40%"), ("x <= 3", "x >= 3"), ("abc", "abd")]
    assert values(spark, x.text_conflict, *cases) == [None, None, "numeric_conflict", "formula_operator_conflict", "text_conflict"]


def test_escalation(spark):
    cases = [("conflict", "h", 1), ("complex", "h", 1), ("consistent", "h", 1)]
    assert values(spark, lambda s, h, p: x.escalation_reason(s, h, p, 0.0), *cases) == ["CONFLICT", "COMPLEX", None]


def test_chapter_numbers(spark):
    cases = [("第三章",), ("第十章",), ("第十二章",), ("第二十章",), ("第二十一章",), ("第3章",), ("Chapter 4",), ("1.10",), ("第一百章",)]
    assert values(spark, x.chapter_number, *cases) == ["3", "10", "12", "20", "21", "3", "4", "1.10", "第一百章"]
    assert values(spark, lambda n: x.chapter_number(n, strict=True), ("第3章",)) == ["第3章"]


def test_normalized_titles_and_names(spark):
    assert values(spark, x.normalized_title, ("Ｔｅｓｔ　Straße",)) == ["test strasse"]
    name = values(spark, x.safe_name, ("/a\x00b..",), ("长" * 100,), ("",))
    assert name[0] == "-ab" and len(name[1].encode()) <= 180 and name[2] == "untitled"


def test_word_tokens(spark):
    assert values(spark, x.word_tokens, ("a　b  c",), ("  ",), ("",)) == [3, 0, 0]


@pytest.mark.parametrize(
    "md, expected",
    [
        ("# T\n## A\nx\n### B\ny\n", ["A", "B"]),
        ("", []),
        ("## A\n" + "x" * 120 + "\n| a | b |\n|---|---|\n| 1 | 2 |\n", ["A", "(无标题)"]),
        ("plain", ["(无标题)"]),
    ],
)
def test_sections(spark, md, expected):
    got = sections.split_sections(spark.createDataFrame([("d", md)], "doc_id string, md string"))
    assert [r.title for r in got.orderBy("seq").collect()] == expected


def test_long_paragraphs_are_packed_and_cut(spark):
    md = "## H\n" + "\n\n".join(["p" * 1500] * 5) + "\n\n" + "q" * 9000
    got = sections.split_sections(spark.createDataFrame([("d", md)], "doc_id string, md string")).orderBy("seq").collect()
    assert "".join(r.raw for r in got) == md
    assert all(r.char_count <= 4099 for r in got) and len(got) >= 4


@pytest.mark.parametrize(
    "md, expected",
    [
        ("# Book\n## One\na\n## Two\nb", ["One", "Two"]),
        ("# Chapter 1\na\n# Chapter 2\nb", ["Chapter 1", "Chapter 2"]),
        ("no headings", ["全文"]),
        ("# 第一章 甲\n# 第二章 乙", ["第一章 甲", "第二章 乙"]),
    ],
)
def test_markdown_chapters(spark, md, expected):
    got = sections.detect_chapters(spark.createDataFrame([("d", md)], "doc_id string, md string"))
    assert [r.title for r in got.orderBy("seq").collect()] == expected


LINES = [(5, "第一章 总论 .... 3"), (5, "目录"), (5, "第二章 方法 .... 5"), (3, "第一章 总论"), (4, "1.1 背景"), (5, "第二章 方法"), (6, "text")]


@pytest.mark.parametrize("turn", [1, -1])
def test_chapter_tree_in_any_order(spark, turn):
    rows = [(1, p, i, t) for i, (p, t) in enumerate(LINES)][::turn]
    tree = chapters.chapter_tree(spark.createDataFrame(rows, "source_id int, page int, line_no int, line string"))
    found = {r.title: r for r in tree.collect()}
    assert (found["总论"].page_start, found["总论"].page_end) == (3, 4)
    assert found["背景"].parent_id == found["总论"].id and found["背景"].page_end == 4
    assert (found["方法"].page_start, found["方法"].page_end) == (5, 6)


def nest(entries):
    """The plain stack: entries (id, level, page_end) in order to {id: (parent, page_end of the subtree)}."""
    stack, parent, below = [], {}, {}
    for i, level, end in entries:
        while stack and stack[-1][1] >= level:
            stack.pop()
        parent[i] = stack[-1][0] if stack else None
        for above, _ in stack:
            below[above] = max(below.get(above, end), end)
        stack.append((i, level))
    return {i: (parent[i], below.get(i, end)) for i, _, end in entries}


def test_chapters_nest_to_any_depth(spark):
    deep = ".".join(["1"] * 34)
    numbers = ["1", "1.1", "1.1.1", "1.1.1.1", "1.1.1.1.1", "1.1.1.1.1.1", "1.1.1.1.2", deep, "1.2", "2", "2.1.1.1.1.1.1", "2.1.1.1.2", "3"]
    place = lambda n: [int(x) for x in n.split(".")]
    rows = [(1, p, 1, f"{n} Title {p}") for p, n in enumerate(sorted(numbers, key=place), 1)] + [(1, len(numbers) + 3, 1, "last")]
    tree = chapters.chapter_tree(spark.createDataFrame(rows, "source_id int, page int, line_no int, line string")).collect()
    number = {r.id: r.number for r in tree}
    ordered = sorted(tree, key=lambda r: r.page_start)
    own = [b.page_start - 1 for b in ordered[1:]] + [len(numbers) + 3]
    expected = nest([(r.number, r.level, end) for r, end in zip(ordered, own, strict=True)])
    assert {r.number: (number.get(r.parent_id), r.page_end) for r in tree} == expected
    assert max(r.level for r in tree) == 34 and expected["1.1.1.1.1.1"][0] == "1.1.1.1.1"


def test_chapter_tree_of_nothing(spark):
    none = spark.createDataFrame([], "source_id int, page int, line_no int, line string")
    assert chapters.chapter_tree(none).count() == 0


def test_tree_without_contents_needs_confirmation(spark):
    rows = [(1, 1, 1, "1 Alpha"), (1, 2, 1, "2 Beta")]
    tree = chapters.chapter_tree(spark.createDataFrame(rows, "source_id int, page int, line_no int, line string"))
    assert [r.needs_confirmation for r in tree.collect()] == [True, True]


def test_display_titles(spark):
    rows = [(1, i, t) for i, t in enumerate(["教材", "教材", "教材（2）", "教材（3）"])]
    got = enrich.display_titles(spark.createDataFrame(rows, "course int, id int, title string"), "course", "id")
    assert [r.display for r in got.orderBy("id").collect()] == ["教材", "教材（4）", "教材（2）", "教材（3）"]


def test_greedy_matching_against_a_loop(spark):
    import random

    rng = random.Random(5)
    box = lambda: (rng.random() * 0.5, rng.random() * 0.5, 0.3 + rng.random() * 0.2, 0.3 + rng.random() * 0.2)
    left = [(page, i, *box()) for page in range(8) for i in range(6)]
    right = [(page, i, *box()) for page in range(8) for i in range(6)]
    schema = "page_id int, block_idx int, x double, y double, width double, height double"

    def overlap(a, b):
        w = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
        h = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)

    expected = set()
    for page in range(8):
        free = {r[1]: r[2:] for r in right if r[0] == page}
        for _, i, *a in (r for r in left if r[0] == page):
            best = max(((overlap(a, b), -j) for j, b in free.items()), default=(0, 0))
            if best[0] >= 0.2:
                expected.add((page, i, -best[1]))
                del free[-best[1]]
    got = pages.block_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    assert {tuple(r) for r in got.select("page_id", "left_idx", "right_idx").collect()} == expected


def test_balanced_and_images(spark):
    assert values(spark, balanced, ("A[b(c)]",), ("A[b(c])",), ("]",), ("",)) == [True, False, False, True]
    md = "a ![x](data:image/png;base64,QUJD) b ![](data:image/gif;base64,QQ==)"
    assert values(spark, without_images, (md,)) == ["a ![](img_000.png) b ![](img_001.gif)"]


def test_documents_with_separators_come_back_whole(spark):
    from docweave.sources.documents import text_documents

    rows = [("a", "one\x1etwo\x1fthree\n\nfour"), ("b", ""), ("c", "tab\tquote\" back\\slash \u2028 é😀")]
    got = text_documents(spark.createDataFrame(rows, "name string, text string"))
    assert sorted((r.name, r.text) for r in got.collect()) == rows


def test_texts_with_the_cutting_character_stay_whole(spark):
    long = "word " * 30
    texts = [f"## a\n{long}\0{long}\n## b\n{long}", f"## a\0\ufdd0\n{long}", f"# t\n## one\0\n{long}\n## two\n{long}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, md string")
    rows = sections.split_sections(docs).orderBy("doc_id", "seq").collect()
    assert [(r.doc_id, r.raw) for r in rows][:3] == [(0, f"## a\n{long}\0{long}\n"), (0, f"## b\n{long}"), (1, texts[1])]
    found = [(r.title, r.start) for r in sections.detect_chapters(docs).where("doc_id = 2").orderBy("seq").collect()]
    assert found == [("one\0", 4), ("two", texts[2].index("## two"))]


def test_short_units_join_the_one_before(spark):
    long = "x" * 120
    cases = [([],), (["a"],), (["a", "b", long, "c", "d"],), ([long, "# h", "e", long],)]
    assert values(spark, sections.merge_short, *cases) == [[], ["a"], ["ab", f"{long}cd"], [long, "# he", long]]


def test_long_texts_take_seconds(spark):
    """20,000 headings, blank-line pieces and short lines in one text each."""
    import time

    n = 20_000
    docs = [("heads", "".join(f"## h{i}\n" for i in range(n))), ("blank", "a\n\n" * n), ("mixed", "".join(f"# Chapter {i}\n\nx\n" for i in range(n)))]
    df = spark.createDataFrame(docs, "doc_id string, md string")
    start = time.time()
    got = {r.doc_id: (r.n, r.last, r.gap) for r in sections.detect_chapters(df).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("end").alias("last"), F.sum(F.col("end") - F.col("start")).alias("gap")).collect()}
    size = {k: len(t) for k, t in docs}
    assert got == {"heads": (n, size["heads"], size["heads"]), "blank": (1, size["blank"], size["blank"]), "mixed": (n, size["mixed"], size["mixed"])}
    pieces = df.where("doc_id = 'blank'").select(F.size(sections.split_long(F.col("md"))).alias("n"), F.array_join(sections.split_long(F.col("md")), "").alias("md")).first()
    assert pieces.md == docs[1][1] and pieces.n == 16
    assert time.time() - start < 60


def test_running_sums(spark):
    rows = [([],), ([5],), (list(range(1000)),), ([1] * 256,), ([2] * 257,)]
    got = spark.createDataFrame(rows, "a array<int>").select("a", sections.running(F.col("a")).alias("s")).collect()
    assert all(r.s == [sum(r.a[:i]) for i in range(len(r.a))] for r in got)


def test_each_side_of_a_text_conflict_is_normalised_once(spark):
    from docweave.functions.text import text_conflict

    df = spark.createDataFrame([("a 1", "a 2"), ("a", "a"), (None, ""), (None, None), ("a", None), ("a b", "ab"), ("a+", "a-")], "l string, r string")
    conflict = text_conflict(F.col("l"), F.col("r")).alias("k")
    assert [r[0] for r in df.select(conflict).collect()] == ["numeric_conflict", None, None, None, "text_conflict", None, "formula_operator_conflict"]
    assert df.select(conflict)._jdf.queryExecution().analyzed().toString().count("translate(") == 4


def test_units_of_a_text_are_found_once(spark):
    from docweave.plans.queries import QUERIES

    plan = QUERIES["win_merge_short"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("#{2,3}") == 1


def test_headings_after_any_line_end(spark):
    ends = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\u2028", " "]
    got = values(spark, sections.structural_units, *[(f"a{e}# t{e}#{e}## b # c",) for e in ends])
    assert got[:-1] == [[f"a{e}", "## b # c"] for e in ends[:-1]] and got[-1] == ["a # t # ## b # c"]
    assert values(spark, sections.split_tables, ("a\n| x |\n|--|\n| 1 |\nb",), ("a | b",)) == [["a", "\n| x |\n|--|\n| 1 |\n", "b"], ["a | b"]]
    assert [len(u) for u in values(spark, lambda c: sections.filled_units(F.split(c, ";")), (" \u3000;a;\n;\u00a0b",))] == [2]


@pytest.mark.parametrize("name", ["udf_enrich_sections", "snk_merged_document", "src_parse_merged"])
def test_sections_to_enrich_are_split_once(spark, name):
    from docweave.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "#{2,3}" not in plan


def test_chapters_of_one_range_share_its_text(spark):
    tree = [(1, f"c{i}", 1, 1) for i in range(600)] + [(1, "all", 1, 3), (1, "three", 3, 3), (2, "other", 1, 2), (1, "none", None, None), (1, "empty", 9, 9)]
    lines = [(1, 1, 2, "b"), (1, 1, 1, "a"), (1, 3, 1, "z"), (2, 2, 1, "o")]
    rows = spark.createDataFrame(tree, "source_id int, id string, page_start int, page_end int")
    got = chapters.texts_of_chapters(rows, spark.createDataFrame(lines, "source_id int, page int, line_no int, line string"), ["page", "line_no"], "line")
    bodies = {(r.source_id, r.id): r.body for r in got.collect()}
    assert bodies == {(1, f"c{i}"): "a\nb" for i in range(600)} | {(1, "all"): "a\nb\nz", (1, "three"): "z", (2, "other"): "o"}
    assert got.count() == 603
