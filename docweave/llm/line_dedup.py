"""Near-duplicate lines by deletion neighbourhoods; the earliest of similar lines stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.store import materialize

#: Deletion variants are made inside blocks of so many characters; what surrounds a block is hashed once.
BLOCK = 256
#: Lines of a document are numbered below this.
LINES = 1 << 32
#: Parts of a line, of which two lines within one edit differ in one.
PARTS = 8
#: Stands for a null id: above every long.
NULL_ID = str(1 << 63)


def _position(doc_id: Column, line_no: Column) -> Column:
    """(doc_id, line_no) as one number in the same order; null ids come last."""
    number = F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(NULL_ID).cast("decimal(20,0)"))
    return (number * F.lit(LINES).cast("decimal(10,0)") + line_no.cast("decimal(10,0)")).cast("decimal(31,0)")


def _doc(pos: Column) -> Column:
    number = F.floor(pos / F.lit(LINES).cast("decimal(10,0)")).cast("decimal(20,0)")
    return F.when(number < F.lit(NULL_ID).cast("decimal(20,0)"), number.cast("long"))


def _line(pos: Column) -> Column:
    return F.pmod(pos, F.lit(LINES).cast("decimal(10,0)")).cast("long")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every line that isn't blank: pos, line."""
    cut = docs.select(F.col(id_col).alias("d"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("i", "line"))
    return cut.where(F.trim("line") != "").select(_position(F.col("d"), F.col("i")).alias("pos"), "line")


def _half_keys(line: Column) -> list[Column]:
    """Three keys, of which lines within one edit share one: the edit leaves a leading or a trailing half as it is."""
    n = F.length(line)
    lead = lambda k: F.xxhash64(F.lit(0), k, F.substring(line, F.lit(1), k))
    trail = lambda k: F.xxhash64(F.lit(1), k, F.right(line, k))
    low, half = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return [lead(low), F.when(n % 2 == 0, lead(half)).otherwise(trail(n - half)), trail(half)]


def _part_keys(line: Column) -> Column:
    """Keys of a line without one of PARTS parts, cut as for its own length and for one character more.

    Lines of one length that differ in a character, and a line that lacks a character of another
    whose cuts it takes, share the key of the part with the edit.
    """
    n = F.length(line)

    def key(p: Column, size: Column, less: int) -> Column:
        a, b = F.floor(size * p / PARTS).cast("int"), F.floor(size * (p + 1) / PARTS).cast("int")
        return F.xxhash64(size, p, F.substring(line, F.lit(1), a), F.substring(line, b - less + 1, n))

    parts = F.sequence(F.lit(0), F.lit(PARTS - 1))
    own, longer = F.transform(parts, lambda p: key(p, n, 0)), F.transform(parts, lambda p: key(p, n + 1, 1))
    return F.array_distinct(F.concat(own, longer))


def near_lines(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines to drop: doc_id, line_no, first_doc_id, first_line_no, distance.

    A line is dropped if a line before it, in the order of (doc_id, line_no), is equal or, from
    min_chars characters on, within one edit (a character changed, added or missing); the earliest
    such line is named. Lines are cut at line feeds and numbered from 0; blank lines stay.

    1. Equal lines meet on their 128-bit hash; from here on each distinct line is one row.
    2. Lines that share no half with another are set aside, then those that share no seven eighths:
       one edit always leaves these.
    3. The others emit their deletion variants as hashed keys: with the place of the deletion, so
       that lines that differ in that character are equal; and without, to meet the shorter line.
       Per key the earliest line is an aggregate: no pairs are made, however many lines share a key.
    4. The earliest candidate of each line is verified by its edit distance.

    Null texts have no lines. Null ids come last and name a null first_doc_id; rows that repeat an
    id share their positions, so a line isn't dropped for its twin there. Very long lines cost in
    proportion to their length times BLOCK. An empty table gives an empty result.
    """
    lines = _lines(docs, id_col, text_col)
    flat = lines.select(
        "pos",
        F.unhex(F.md5("line")).alias("h"),
        F.length("line").alias("n"),
        *[k.alias(f"k{i}") for i, k in enumerate(_half_keys(F.col("line")))],
    )
    distinct = materialize(
        flat.groupBy("h").agg(
            F.min("pos").alias("first"), F.count(F.lit(1)).alias("times"), F.max("n").alias("n"),
            *[F.max(f"k{i}").alias(f"k{i}") for i in range(3)],
        ),
        "lines-distinct",
    )
    halves = distinct.where(F.col("n") >= min_chars).select("first", F.explode(F.array("k0", "k1", "k2")).alias("key"))
    needed = _sharing(halves, "lines-halves")
    texts = materialize(_texts(docs, needed, id_col, text_col), "lines-texts")
    parts = texts.select(F.col("pos").alias("first"), F.explode(_part_keys(F.col("line"))).alias("key"))
    close = _sharing(parts, "lines-parts").withColumnRenamed("first", "pos")
    texts = materialize(texts.join(close, "pos", "left_semi").repartition("pos"), "lines-close")
    near = materialize(_near(texts), "lines-near")
    earlier = distinct.where("times > 1").select("h", "first").join(near, "h", "full_outer")
    earlier = materialize(
        earlier.select("h", F.coalesce(F.least("first", "near"), "first", "near").alias("keep"), "first"), "lines-earlier"
    )
    dropped = flat.select("pos", "h").join(earlier.hint("merge"), "h").where(F.col("keep") < F.col("pos"))
    return dropped.select(
        _doc(F.col("pos")).alias("doc_id"),
        _line(F.col("pos")).alias("line_no"),
        _doc(F.col("keep")).alias("first_doc_id"),
        _line(F.col("keep")).alias("first_line_no"),
        F.when(F.col("keep") == F.coalesce("first", F.lit(-1)), 0).otherwise(1).alias("distance"),
    )


def _sharing(keyed: DataFrame, name: str) -> DataFrame:
    """The first of all (first, key) rows whose key another first has too."""
    shared = keyed.groupBy("key").agg(F.min("first").alias("x"), F.max("first").alias("y")).where("x < y").select("key")
    return keyed.join(materialize(shared, name).hint("merge"), "key", "left_semi").select("first").distinct()


def _texts(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(pos, line, h) of the needed lines, each from where it stands first; of rows that repeat an id, one."""
    wanted = needed.select(_doc(F.col("first")).alias("d"), F.col("first").alias("pos"), _line(F.col("first")).alias("i"))
    named = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("text"))
    asked = wanted.groupBy("d").agg(F.collect_list(F.struct("pos", "i")).alias("asked"))
    met = named.join(asked.hint("merge"), named["d"].eqNullSafe(asked["d"]))
    cut = met.select(F.split("text", "\n", -1).alias("all"), F.explode("asked").alias("a"))
    line = F.get("all", F.col("a.i").cast("int"))
    out = cut.select(F.col("a.pos").alias("pos"), line.alias("line")).where(F.trim("line") != "")
    return out.withColumn("h", F.unhex(F.md5("line"))).dropDuplicates(["pos"])


def _variants(texts: DataFrame) -> DataFrame:
    """(key, role, pos): role 0 is the line itself, 1 a line less one character, 2 the same with its place."""
    size = F.length("line")
    b = F.col("b")
    blocks = texts.select("pos", "line", F.explode(F.sequence(F.lit(0), F.floor(size / BLOCK).cast("int"))).alias("b"))
    after = lambda n: F.xxhash64(F.substring("line", b * BLOCK + n + 1, size))
    blocks = blocks.select(
        "pos",
        "b",
        F.xxhash64(F.substring("line", F.lit(1), b * BLOCK)).alias("before"),
        F.substring("line", b * BLOCK + 1, F.lit(BLOCK)).alias("part"),
        F.substring("line", b * BLOCK + 1, F.lit(BLOCK - 1)).alias("short"),
        after(BLOCK).alias("after"),
        after(BLOCK - 1).alias("after_short"),
    )
    places = F.when(F.length("part") > 0, F.sequence(F.lit(0), F.length("part") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    less = F.transform(places, lambda i: F.concat(F.substring("part", F.lit(1), i), F.substring("part", i + 2, F.lit(BLOCK))))
    cut = blocks.withColumn("less", less)
    key = lambda part, after, place: F.xxhash64("before", part, after, place)
    pair = lambda k, role: F.struct(k.alias("key"), F.lit(role).cast("byte").alias("role"))
    gap = -1 - b
    emitted = F.concat(
        F.array(pair(key(F.col("short"), F.col("after_short"), gap), 0)),
        F.transform(F.array_distinct("less"), lambda v: pair(key(v, F.col("after"), gap), 1)),
        F.transform("less", lambda v, i: pair(key(v, F.col("after"), b * BLOCK + i), 2)),
    )
    return cut.select("pos", F.explode(emitted).alias("v")).select("pos", "v.key", "v.role")


def _near(texts: DataFrame) -> DataFrame:
    """(h, near): the earliest other line within one edit, where it comes before the line."""
    made = _variants(texts)
    of = lambda role: F.min(F.when(F.col("role") == role, F.col("pos"))).alias(f"m{role}")
    least = made.groupBy("key").agg(of(0), of(1), of(2), F.min("pos").alias("x"), F.max("pos").alias("y"))
    least = materialize(least.where("x < y").drop("x", "y"), "lines-least")
    met = made.join(least.hint("merge"), "key")
    other = F.when(F.col("role") == 0, F.col("m1")).when(F.col("role") == 1, F.col("m0")).otherwise(F.col("m2"))
    best = met.select("pos", other.alias("near")).where("near < pos").groupBy("pos").agg(F.min("near").alias("near"))
    first = texts.select(F.col("pos").alias("near"), F.col("line").alias("near_line"))
    checked = texts.join(best, "pos").join(first, "near")
    return checked.where(F.levenshtein("line", "near_line", 1).between(0, 1)).select("h", "near")


def drop_lines(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the dropped lines of near_lines() taken out of the text; other columns stay. Documents aren't removed."""
    gone = dropped.groupBy("doc_id").agg(F.collect_set(F.col("line_no").cast("int")).alias("_gone")).select(
        F.col("doc_id").alias("_d"), "_gone"
    )
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone["_d"]), "left")
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda _, i: ~F.array_contains("_gone", i))
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn(text_col, text).drop("_d", "_gone")
