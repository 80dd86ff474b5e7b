"""Markdown documents to sections and chapters, inside each row: no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import LINE_ENDS, section_title, word_tokens

#: Where long units are cut and short ones join the one before.
LONGEST, SHORTEST = 4000, 100
#: Separates units. A text that holds it itself is read with the first of the noncharacters that it doesn't hold instead.
CUT = "\0"
STAND_INS = ("\ufdd0", "\ufdd1", "\ufdd2")
#: What begins a line and ends it, and the form of a table.
_AT_LINE = f"(?<![^{LINE_ENDS}])"
_END = f"(?:\r\n|[{LINE_ENDS}])"
TABLE = r"(?U)\n\|[^\n]+\|\n\|[\s:|-]+\|\n(?:\|[^\n]+\|\n?)+"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def without_cut(md: Column) -> tuple[Column, Callable[[Column], Column]]:
    """The text without CUT, as long as it was, and how parts of it get it back."""
    free = F.lit(STAND_INS[-1])
    for mark in reversed(STAND_INS[:-1]):
        free = F.when(~md.contains(mark), mark).otherwise(free)
    held = md.contains(CUT)
    return F.when(held, F.replace(md, F.lit(CUT), free)).otherwise(md), lambda part: F.when(held, F.replace(part, free, F.lit(CUT))).otherwise(part)


def structural_units(md: Column) -> Column:
    """Units that begin at second and third level headings; first level heading lines go.

    The patterns look for a sign first, and only there at what stands before it.
    """
    body = F.regexp_replace(md, rf"(?U)(?=#){_AT_LINE}#(?:(?=\s)[^{LINE_ENDS}]+(?:{_END}|\z)|{_END})", "")
    cut = F.regexp_replace(body, rf"(?U)(?=#{{2,3}}\s){_AT_LINE}", CUT)
    return F.split(F.when(md.contains("#"), cut).otherwise(md), CUT)


def split_tables(unit: Column) -> Column:
    return F.split(F.when(unit.contains("\n|"), F.regexp_replace(unit, f"({TABLE})", f"{CUT}$1{CUT}")).otherwise(unit), CUT)


def is_table(unit: Column) -> Column:
    return unit.contains("\n|") & unit.rlike(TABLE)


def split_long(unit: Column) -> Column:
    """Pieces between blank lines, packed up to LONGEST characters; a longer piece is cut hard."""
    pieces = F.split(F.regexp_replace(unit, r"(\n\n+)", f"{CUT}$1{CUT}"), CUT)
    some = lambda x: F.when(F.length(x) > 0, F.array(x)).otherwise(F.array().cast("array<string>"))
    cuts = lambda x: F.transform(
        F.sequence(F.lit(0), F.floor((F.length(x) - 1) / LONGEST).cast("int")),
        lambda i: F.substring(x, i * LONGEST + 1, F.lit(LONGEST)),
    )

    def step(acc: Column, x: Column) -> Column:
        out, held = acc["out"], acc["held"]
        long, fits = F.length(x) > LONGEST, F.length(held) + F.length(x) <= LONGEST
        new_out = F.when(long, F.concat(out, some(held), cuts(x))).when(fits, out).otherwise(F.concat(out, some(held)))
        new_held = F.when(long, F.lit("")).when(fits, F.concat(held, x)).otherwise(x)
        return F.struct(new_out.alias("out"), new_held.alias("held"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))
    packed = F.aggregate(pieces, start, step, lambda acc: F.concat(acc["out"], some(acc["held"])))
    return F.when(F.length(unit) <= LONGEST, F.array(unit)).otherwise(packed)


def merge_short(units: Column) -> Column:
    """A unit below SHORTEST characters that is neither table nor heading is appended to the one before."""

    def short(u: Column) -> Column:
        head = F.regexp_replace(u, r"(?U)^\s+", "").rlike(r"(?U)^#{1,6}\s+")
        return (F.length(u) < SHORTEST) & ~is_table(u) & ~head

    def merged(all_units: Column) -> Column:
        begins = F.filter(F.transform(all_units, lambda u, i: F.when((i == 0) | ~short(u), i + 1)), lambda i: i.isNotNull())
        upto = F.size(all_units) + 1
        part = lambda at, i, a: F.array_join(F.slice(all_units, at, F.coalesce(F.get(a, i + 1), upto) - at), "")
        return bound(begins, lambda a: F.transform(a, lambda at, i: part(at, i, a)))

    return bound(units, merged)


def filled_units(units: Column) -> Column:
    return F.filter(units, lambda u: u.rlike(r"(?U)\S"))


def section_units(md: Column) -> Column:
    text, back = without_cut(md)
    units = filled_units(F.flatten(F.transform(structural_units(text), split_tables)))
    return F.transform(merge_short(F.flatten(F.transform(units, split_long))), back)


def split_sections(docs: DataFrame, id_col: str = "doc_id", md_col: str = "md") -> DataFrame:
    """(doc_id, seq, title, raw, sha256, char_count), seq from 0; empty documents have no sections."""
    units = docs.select(F.col(id_col), F.posexplode(section_units(F.col(md_col))).alias("seq", "raw"))
    return units.select(id_col, "seq", section_title(F.col("raw")).alias("title"), "raw", F.sha2("raw", 256).alias("sha256"), F.length("raw").alias("char_count"))


#: Numbers that are added one by one below a running sum.
_BLOCK = 256


def running(sizes: Column) -> Column:
    """The sum of the sizes before each: sums of blocks, sums before each block, and the rest inside of it.

    A fold that appends to an array would copy it at every step; this adds some _BLOCK / 2 numbers for each place.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    block = lambda i: F.floor(i / _BLOCK).cast("int")

    def summed(all_sizes: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), block(F.size(all_sizes))), lambda k: total(F.slice(all_sizes, k * _BLOCK + 1, F.lit(_BLOCK))))
        before = bound(blocks, lambda sums: F.transform(sums, lambda _, k: total(F.slice(sums, F.lit(1), k))))
        inside = lambda i: total(F.slice(all_sizes, block(i) * _BLOCK + 1, i % _BLOCK))
        return bound(before, lambda base: F.transform(all_sizes, lambda _, i: F.get(base, block(i)) + inside(i)))

    return bound(sizes, summed)


#: Fixed value: titles that say chapter.
CHAPTER_TITLE = r"(?iU)^(?:第.{1,12}章(?:\s|$)|chapter\s+\w+)"


def detect_chapters(docs: DataFrame, id_col: str = "doc_id", md_col: str = "md") -> DataFrame:
    """(doc_id, seq, title, start, end, preamble_chars): the heading level of chapters is chosen per document.

    Chapters are the second level headings below a title, else headings that say chapter, else
    several first level ones, else second level ones, else the whole text as one chapter.
    """
    md = F.col(md_col)
    text, back = without_cut(md)
    marked = F.regexp_replace(text, r"(?m)^(#{1,2}(?U:\s)+[^\n]+)$", f"{CUT}$1")
    cut = docs.select(F.col(id_col), F.length(md).alias("chars"), F.transform(F.split(marked, CUT), back).alias("p"))
    cut = cut.select(id_col, "chars", F.transform("p", lambda x: F.split(x, "\n", 2)[0]).alias("lines"), running(F.transform("p", F.length)).alias("starts"))
    mark = r"(?U)^(#{1,2})\s+(.+?)\s*$"
    head = lambda line, start: F.struct(start.alias("start"), F.length(F.regexp_extract(line, mark, 1)).alias("level"), F.trim(F.regexp_extract(line, mark, 2)).alias("title"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("level"), F.lit("全文").alias("title")))

    def chosen(heads: Column) -> Column:
        of = lambda k: F.filter(heads, lambda h: h["level"] == k)
        named = F.filter(heads, lambda h: h["title"].rlike(CHAPTER_TITLE))
        titled = F.exists(heads, lambda h: (h["level"] == 1) & ~h["title"].rlike(CHAPTER_TITLE))
        pick = lambda one, two, say: F.when(titled & (F.size(two) > 1), two).when(F.size(say) > 1, say).when(F.size(one) > 1, one).otherwise(two)
        return bound(of(1), lambda one: bound(of(2), lambda two: bound(named, lambda say: pick(one, two, say))))

    def ended(c: Column) -> Column:
        until = lambda i: F.coalesce(F.get(c, i + 1)["start"], F.col("chars"))
        return F.transform(c, lambda h, i: F.struct(h["title"].alias("title"), h["start"].alias("start"), until(i).alias("end"), c[0]["start"].alias("preamble_chars")))

    heads = F.filter(F.zip_with("lines", "starts", head), lambda h: h["level"] > 0)
    some = bound(bound(heads, chosen), lambda c: F.when(F.size(c) > 0, c).otherwise(whole))
    rows = cut.select(id_col, F.posexplode(bound(some, ended)).alias("seq", "h"))
    return rows.select(id_col, "seq", "h.title", "h.start", "h.end", "h.preamble_chars")


def stub_enrichment(seq: Column, raw: Column) -> Column:
    """What the deterministic stand-in for a model says about a section."""
    return F.concat(F.lit("### stub\n- section "), seq, F.lit(", about "), word_tokens(raw), F.lit(" tokens\n"))


def merged_document(sections: DataFrame, artifacts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document its sections in order, each with its enrichment or a notice that there is none."""
    text = F.concat("raw", F.lit("\n\n"), F.coalesce("ai_md", F.lit("(no enrichment)")), F.lit("\n---\n"))
    rows = sections.join(artifacts.select("sha256", "ai_md"), "sha256", "left").select(id_col, "seq", text.alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return rows.groupBy(id_col).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("merged"))


def parse_merged(merged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The inverse: (doc_id, seq, title, raw, ai_md)."""
    rows = merged.select(id_col, F.posexplode(F.split("merged", "\n---\n", -1)).alias("seq", "part")).where("part <> ''")
    at = F.length("part") - F.length(F.regexp_extract("part", r"(?s)\n\n((?:### stub|\(no enrichment\)).*)$", 1))
    raw = F.substring("part", F.lit(1), at - 2)
    return rows.select(id_col, "seq", section_title(raw).alias("title"), raw.alias("raw"), F.substring("part", at + 1, F.length("part")).alias("ai_md"))
