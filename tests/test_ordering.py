"""Places in an order, with a key that holds a third of the rows."""

from __future__ import annotations

import random
import unicodedata

from pyspark.sql import functions as F

from docweave.operators.enrich import display_titles
from docweave.operators.ordering import chunked, places


def test_places_with_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(1 if i % 3 == 0 else rng.choice([None, *range(2, 40)]), rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, a int, place int")
    sizes = chunked(df, ["k", "a", "place"], 12).groupBy("k", "chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 600
    for keys in (["k"], []):
        got = {r.i: r.place for r in places(df.withColumnRenamed("place", "i"), keys, ["a", F.col("i") * 1], chunks=12).collect()}
        groups = {}
        for k, a, i in rows:
            groups.setdefault(k if keys else 0, []).append((a, i))
        assert got == {i: n for g in groups.values() for n, (_, i) in enumerate(sorted(g), 1)}
    assert places(df.limit(0), ["k"], ["a"]).count() == 0


def test_display_titles_against_one_pass(spark):
    rng = random.Random(7)
    pool = ["教材", "教材（2）", "教材（3）", "教材(5)", "A", "a", "Ａ", "A（2）", "A（2）（2）", "A（02）", "B", None, ""]
    rows = [(rng.randrange(3), i, rng.choice(pool)) for i in range(300)]
    plain = lambda t: " ".join(unicodedata.normalize("NFKC", t).casefold().split())
    expected = {}
    for g in range(3):
        mine = [r for r in rows if r[0] == g]
        taken, seen, count = {plain(t) for _, _, t in mine if t is not None}, set(), {}
        for _, i, t in mine:
            expected[i] = t
            if t is None:
                continue
            if plain(t) in seen:
                n = count.get(plain(t), 1) + 1
                while plain(f"{t}（{n}）") in taken:
                    n += 1
                count[plain(t)], expected[i] = n, f"{t}（{n}）"
            seen.add(plain(t))
    got = display_titles(spark.createDataFrame(rows, "c int, id int, title string"), "c", "id")
    assert {r.id: r.display for r in got.collect()} == expected
