"""Text functions, sections, chapters of Markdown, sources and sinks over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import text as x
from docweave.operators import sections as s
from docweave.plans.bindings import Tables
from docweave.plans.registry import query
from docweave.sources import documents as d
from docweave.sources.files import attachments, manifest, read_documents, rendered, write_files
from docweave.sources.html import html_to_markdown

# Scalar functions ----------------------------------------------------------------------------------


@query("fn_text_sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))


@query(
    "fn_canonical_json_hash",
    """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS digest FROM documents""",
)
def _(t: Tables) -> DataFrame:
    from docweave.operators.relational import fingerprint

    return t.documents.select("doc_id", fingerprint("doc_id", "lang", "source").alias("digest"))


_BUCKET = "(('0x' || substr(sha256(concat_ws(':', sha256(text), (doc_id + 1)::VARCHAR)), 1, 16))::UBIGINT % 10000)::INT"


@query("fn_sample_bucket", f"SELECT doc_id, {_BUCKET} AS bucket FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", x.sample_bucket(F.sha2("text", 256), F.col("doc_id") + 1).alias("bucket"))


@query(
    "fn_escalation_reason",
    f"SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'CONFLICT' WHEN doc_id % 10 = 1 THEN 'COMPLEX' WHEN {_BUCKET} < 500 THEN 'SAMPLE' END AS reason FROM documents",
)
def _(t: Tables) -> DataFrame:
    status = F.when(F.col("doc_id") % 10 == 0, "conflict").when(F.col("doc_id") % 10 == 1, "complex").otherwise("consistent")
    return t.documents.select("doc_id", x.escalation_reason(status, F.sha2("text", 256), F.col("doc_id") + 1, 0.05).alias("reason"))


_NORMAL = f"trim(regexp_replace(translate(translate(text, '{x.FULL_WIDTH}', '{x.ASCII}'), '{x.TRADITIONAL}', '{x.SIMPLIFIED}'), '\\s+', ' ', 'g'), ' ')"


@query("fn_normalize_ocr_text", f"SELECT doc_id, sha256({_NORMAL}) AS digest, length({_NORMAL}) AS n FROM documents")
def _(t: Tables) -> DataFrame:
    n = x.normalize_ocr_text(F.col("text"))
    return t.documents.select("doc_id", F.sha2(n, 256).alias("digest"), F.length(n).alias("n"))


@query("fn_numbers", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '(?:\d+(?:[.,]\d+)*%?|%\d+)'), '|') AS numbers FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(x.numbers(F.col("text")), "|").alias("numbers"))


@query("fn_operators", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '(?:<=|>=|!=|==|=|<|>|\+|-|\*|/|\^)'), '|') AS operators FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(x.operators(F.col("text")), "|").alias("operators"))


@query(
    "fn_text_conflict",
    r"""WITH p AS (SELECT doc_id, text AS a, CASE doc_id % 4 WHEN 0 THEN text || ' 7' WHEN 1 THEN text || ' >=' WHEN 2 THEN replace(text, 'e', 'a') ELSE replace(text, ' ', '  ') END AS b FROM documents),
    q AS (SELECT doc_id, regexp_replace(a, '\s+', '', 'g') AS a, regexp_replace(b, '\s+', '', 'g') AS b FROM p)
    SELECT doc_id, CASE WHEN a = b THEN NULL WHEN regexp_extract_all(a, '(?:\d+(?:[.,]\d+)*%?|%\d+)') <> regexp_extract_all(b, '(?:\d+(?:[.,]\d+)*%?|%\d+)') THEN 'numeric_conflict'
    WHEN regexp_extract_all(a, '(?:<=|>=|!=|==|=|<|>|\+|-|\*|/|\^)') <> regexp_extract_all(b, '(?:<=|>=|!=|==|=|<|>|\+|-|\*|/|\^)') THEN 'formula_operator_conflict' ELSE 'text_conflict' END AS reason FROM q""",
)
def _(t: Tables) -> DataFrame:
    k, a = F.col("doc_id") % 4, F.col("text")
    b = F.when(k == 0, F.concat(a, F.lit(" 7"))).when(k == 1, F.concat(a, F.lit(" >="))).when(k == 2, F.replace(a, F.lit("e"), F.lit("a"))).otherwise(F.replace(a, F.lit(" "), F.lit("  ")))
    return t.documents.select("doc_id", x.text_conflict(a, b).alias("reason"))


_TOLD = "url || ' file:///a/b /home/u/x sk-abcdefgh1234 token = q' || page_id || ' {\"api_key\": \"v\"} Bearer ' || page_id || ' token-abcdefgh C:\\d\\e /Users/u ' || html"


def _redacted(text: str, rules: tuple[tuple[str, str], ...]) -> str:
    """The rules in SQL, where a look behind becomes a group that is put back."""
    for pattern, by in rules:
        kept = pattern.replace(r"(?<![\p{L}\p{N}_:/.])", r"(^|[^\p{L}\p{N}_:/.])")
        by = by.replace("$", "\\") if kept == pattern else "\\1" + by
        text = f"regexp_replace({text}, {_quoted(kept)}, '{by}', 'g')"
    return text


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_RULES = {"logs": x.SECRET_RULES, "files": x.FOLDER_RULES, "titles": x.TITLE_RULES, "answers": x.ANSWER_RULES}


@query("fn_redact", f"SELECT page_id, {', '.join(f'md5({_redacted(chr(116), rules)}) AS {name}' for name, rules in _RULES.items())} FROM (SELECT page_id, {_TOLD} AS t FROM pages)")
def _(t: Tables) -> DataFrame:
    text = F.concat(
        "url", F.lit(" file:///a/b /home/u/x sk-abcdefgh1234 token = q"), "page_id", F.lit(' {"api_key": "v"} Bearer '), "page_id", F.lit(" token-abcdefgh C:\\d\\e /Users/u "), "html"
    )
    return t.pages.select("page_id", *[F.md5(x.redact(text, rules)).alias(name) for name, rules in _RULES.items()])


@query(
    "fn_safe_markdown",
    r"""SELECT page_id, md5(substr(trim(replace(replace(replace(regexp_replace(html, '[\x00-\x1f\x7f]', ' ', 'g'), '```', ''''''''), '<', '&lt;'), '>', '&gt;'), ' '), 1, 8192)) AS digest FROM pages""",
)
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(x.safe_markdown(F.col("html"))).alias("digest"))


@query("fn_word_tokens", r"SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), ' ')) END AS tokens FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", x.word_tokens(F.col("text")).alias("tokens"))


@query("fn_token_budget", "SELECT doc_id, strlen(text) + 512 > 4096 AS over FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", x.over_budget(F.col("text"), 512, 4096).alias("over"))


@query(
    "fn_clean_tags",
    """SELECT card_id, (SELECT string_agg(v, ',' ORDER BY i) FROM (SELECT v, min(i) AS i FROM (SELECT unnest(l) AS v, unnest(range(len(l))) AS i FROM (SELECT list_transform(string_split(tags || ',' || tags || ' , ', ','), lambda y: trim(y)) AS l)) WHERE length(v) BETWEEN 1 AND 40 GROUP BY v)) AS tags
    FROM (SELECT card_id, replace(tags, ' ', ' , ') AS tags FROM chapter_cards)""",
)
def _(t: Tables) -> DataFrame:
    tags = F.replace("tags", F.lit(" "), F.lit(" , "))
    raw = F.split(F.concat(tags, F.lit(","), tags, F.lit(" , ")), ",")
    return t.chapter_cards.select("card_id", F.array_join(x.clean_tags(raw), ",").alias("tags"))


@query("fn_source_refs_json", """SELECT card_id, len(string_split(tags, ' ')) AS n, card_id % 3 <> 0 AS valid FROM chapter_cards""")
def _(t: Tables) -> DataFrame:
    text = F.when(F.col("card_id") % 3 == 0, F.lit('["a", ')).otherwise(F.to_json(F.split("tags", " ")))
    refs = F.from_json(text, "array<string>")
    return t.chapter_cards.select("card_id", F.size(F.split("tags", " ")).alias("n"), F.try_parse_json(text).isNotNull().alias("valid"))


@query("fn_citations", r"SELECT note_id, array_to_string(regexp_extract_all(content || ' [src:' || version || '] [att:b' || seq || '] [x:1]', '\[(?:src|att):[^\]\s]+\]'), ',') AS cited FROM note_blocks")
def _(t: Tables) -> DataFrame:
    return _cited(t).select("note_id", F.array_join(x.citations(F.col("cited_text")), ",").alias("cited"))


def _cited(t: Tables) -> DataFrame:
    text = F.concat("content", F.lit(" [src:"), "version", F.lit("] [att:b"), "seq", F.lit("] [x:1]"))
    return t.note_blocks.withColumn("cited_text", text)


@query(
    "join_unknown_citations",
    "SELECT note_id, '[att:b' || seq || ']' AS citation FROM note_blocks WHERE seq NOT IN (1, 2, 3) UNION ALL SELECT note_id, '[src:' || version || ']' FROM note_blocks WHERE version % 5 = 0",
)
def _(t: Tables) -> DataFrame:
    allowed = t.note_blocks.where("version % 5 <> 0").select(F.concat(F.lit("[src:"), "version", F.lit("]")).alias("citation"))
    allowed = allowed.union(t.note_blocks.where("seq in (1, 2, 3)").select(F.concat(F.lit("[att:b"), "seq", F.lit("]")))).distinct()
    cited = _cited(t).select("note_id", F.explode(x.citations(F.col("cited_text"))).alias("citation"))
    return cited.join(allowed, "citation", "left_anti").select("note_id", "citation")


@query("fn_source_label", "SELECT chapter_id, '[《' || title || '》·第 ' || (seq + 1) || ' 章]' AS label FROM chapters")
def _(t: Tables) -> DataFrame:
    return t.chapters.select("chapter_id", x.source_label(F.col("title"), F.col("seq")).alias("label"))


@query("fn_source_labels", "SELECT chapter_id, '[《' || title || '》·第 ' || (seq + 1) || ' 章]' AS label, 1 AS n FROM chapters")
def _(t: Tables) -> DataFrame:
    label = x.source_label(F.col("title"), F.col("seq"))
    found = x.source_labels(F.concat(F.lit("see "), label, F.lit(" and [《》·第 1 章] too")))
    return t.chapters.select("chapter_id", found[0].alias("label"), F.size(found).alias("n"))


_DIAGRAMS = r"text || chr(10) || '```mermaid' || chr(10) || 'flowchart ' || turn || chr(10) || '```' || chr(10) || '```mermaid' || chr(10) || ' ' || chr(10) || '```' || chr(10) || '```Mermaid' || chr(10) || role || chr(10) || '```' || '```mermaid' || chr(10) || 'third```'"


def _with_diagrams(t: Tables) -> DataFrame:
    nl = F.lit("\n")
    text = F.concat("text", nl, F.lit("```mermaid\nflowchart "), "turn", F.lit("\n```\n```mermaid\n \n```\n```Mermaid\n"), "role", F.lit("\n``````mermaid\nthird```"))
    return t.conversations.withColumn("note", text)


@query("fn_extract_mermaid", f"SELECT conv_id, turn, array_to_string(list_filter(list_transform(regexp_extract_all({_DIAGRAMS}, '(?is)```mermaid\\s*\\n(.*?)```', 1), lambda y: regexp_replace(y, '^\\s+|\\s+$', '', 'g')), lambda y: y <> ''), '|') AS diagrams FROM conversations")
def _(t: Tables) -> DataFrame:
    return _with_diagrams(t).select("conv_id", "turn", F.array_join(x.diagrams(F.col("note")), "|").alias("diagrams"))


@query("lim_first_two_diagrams", f"SELECT conv_id, turn, array_to_string(list_filter(list_transform(regexp_extract_all({_DIAGRAMS}, '(?is)```mermaid\\s*\\n(.*?)```', 1), lambda y: regexp_replace(y, '^\\s+|\\s+$', '', 'g')), lambda y: y <> '')[1:2], '|') AS diagrams FROM conversations")
def _(t: Tables) -> DataFrame:
    return _with_diagrams(t).select("conv_id", "turn", F.array_join(F.slice(x.diagrams(F.col("note")), 1, 2), "|").alias("diagrams"))


@query("fn_pure_mermaid", "SELECT conv_id, turn, 'flowchart ' || turn AS diagram FROM conversations")
def _(t: Tables) -> DataFrame:
    return _with_diagrams(t).select("conv_id", "turn", x.diagrams(F.col("note"))[0].alias("diagram"))


@query("fn_normalized_title", "SELECT topic_id, lower(trim(title)) AS title FROM topics")
def _(t: Tables) -> DataFrame:
    return t.topics.select("topic_id", x.normalized_title("title").alias("title"))


@query("fn_safe_name", "SELECT page_id, replace(url, '/', '-') AS name FROM pages")
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", x.safe_name("url").alias("name"))


@query("fn_stable_id", "SELECT chapter_id, 'chapter-' || substr(sha256(chapter_id::VARCHAR || chr(0) || title), 1, 24) AS id FROM chapters")
def _(t: Tables) -> DataFrame:
    return t.chapters.select("chapter_id", x.stable_id(F.col("chapter_id").cast("string"), F.col("title")).alias("id"))


@query(
    "fn_chapter_number",
    "SELECT chapter_id, CASE chapter_id % 5 WHEN 0 THEN (chapter_id % 9 + 11)::VARCHAR WHEN 1 THEN (10 * (chapter_id % 9 + 1))::VARCHAR WHEN 2 THEN (chapter_id % 50)::VARCHAR WHEN 3 THEN concat(chapter_id % 7, '.', chapter_id % 12) ELSE (chapter_id % 30)::VARCHAR END AS key FROM chapters",
)
def _(t: Tables) -> DataFrame:
    c = F.col("chapter_id")
    numeral = lambda i: F.substring(F.lit("一二三四五六七八九"), i + 1, F.lit(1))
    written = (
        F.when(c % 5 == 0, F.concat(F.lit("第 十"), numeral((c % 9).cast("int")), F.lit("章")))
        .when(c % 5 == 1, F.concat(F.lit("第"), numeral((c % 9).cast("int")), F.lit("十 章")))
        .when(c % 5 == 2, F.concat(F.lit("Chapter "), c % 50))
        .when(c % 5 == 3, F.concat(c % 7, F.lit("."), c % 12))
        .otherwise(F.concat(F.lit("第 "), c % 30, F.lit(" 章")))
    )
    return t.chapters.select("chapter_id", x.chapter_number(written).alias("key"))


@query("fn_chapter_level", "SELECT chapter_id, greatest(len(regexp_extract_all(title, '[0-9]+')), 1) AS level FROM (SELECT chapter_id, CASE WHEN chapter_id % 4 = 0 THEN 'intro' ELSE title || '.' || seq END AS title FROM chapters)")
def _(t: Tables) -> DataFrame:
    key = F.when(F.col("chapter_id") % 4 == 0, "intro").otherwise(F.concat("title", F.lit("."), "seq"))
    return t.chapters.select("chapter_id", x.chapter_level(key).alias("level"))


# Sections and chapters -----------------------------------------------------------------------------

#: The same steps in SQL: lines, islands that start at headings, tables apart, long units cut, short ones merged.
_SECTIONS = r"""l AS (SELECT doc_id, i, p[i] || CASE WHEN i < len(p) THEN chr(10) ELSE '' END AS line FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(md, chr(10)) AS p FROM documents_md))),
k AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{2,3}\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM l WHERE NOT regexp_matches(line, '^#\s') AND line <> ''),
u AS (SELECT doc_id, island, string_agg(line, '' ORDER BY i) AS unit FROM k GROUP BY doc_id, island),
v AS (SELECT doc_id, island, j, q[j] AS unit FROM (SELECT *, unnest(range(1, len(q) + 1)) AS j FROM (SELECT doc_id, island, string_split(regexp_replace(unit, '(\n\|[^\n]+\|\n\|[\s:|-]+\|\n(?:\|[^\n]+\|\n?)+)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS q FROM u))
  WHERE regexp_replace(q[j], '\s+', '', 'g') <> ''),
w AS (SELECT doc_id, island, j, c, substr(unit, c * 4000 + 1, 4000) AS unit FROM (SELECT *, unnest(range((length(unit) - 1) // 4000 + 1)) AS c FROM v)),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY island, j, c) AS n,
  length(unit) < 100 AND NOT regexp_matches(unit, '\n\|[^\n]+\|\n\|[\s:|-]+\|\n(?:\|[^\n]+\|\n?)+') AND NOT regexp_matches(unit, '^\s*#{1,6}\s+') AS short FROM w),
g AS (SELECT *, sum(CASE WHEN short AND n > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS s FROM f),
sections AS (SELECT doc_id, (s - 1)::INT AS seq, string_agg(unit, '' ORDER BY n) AS raw FROM g GROUP BY doc_id, s)"""
_TITLE = r"CASE WHEN regexp_matches(raw, '^\s*#{1,6}\s+[^\n]+') THEN regexp_extract(raw, '^\s*#{1,6}\s+([^\n]+)', 1) ELSE '(无标题)' END"


@query("udtf_sections", f"WITH {_SECTIONS} SELECT doc_id, seq, {_TITLE} AS title, sha256(raw) AS sha256, length(raw) AS char_count FROM sections")
def _(t: Tables) -> DataFrame:
    return s.split_sections(t.documents_md).drop("raw")


@query("snk_sections", f"WITH {_SECTIONS} SELECT doc_id, seq, raw FROM sections")
def _(t: Tables) -> DataFrame:
    return d.write_and_read(s.split_sections(t.documents_md).select("doc_id", "seq", "raw"), "doc_id", 8)


@query("win_section_split", f"WITH {_SECTIONS} SELECT doc_id, count(*) AS units, max(length(unit)) AS longest FROM u GROUP BY doc_id")
def _(t: Tables) -> DataFrame:
    units = t.documents_md.select("doc_id", F.explode(F.filter(s.structural_units(F.col("md")), lambda u: u != "")).alias("u"))
    return units.groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.max(F.length("u")).alias("longest"))


@query("fn_split_tables", f"WITH {_SECTIONS} SELECT doc_id, count(*) AS parts FROM v GROUP BY doc_id")
def _(t: Tables) -> DataFrame:
    parts = s.filled_units(F.flatten(F.transform(s.structural_units(F.col("md")), s.split_tables)))
    return t.documents_md.select("doc_id", F.explode(parts).alias("p")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"))


@query("fn_is_table", f"WITH {_SECTIONS} SELECT doc_id, bool_or(regexp_matches(raw, '\\n\\|[^\\n]+\\|\\n\\|[\\s:|-]+\\|\\n(?:\\|[^\\n]+\\|\\n?)+')) AS has_table FROM sections GROUP BY doc_id")
def _(t: Tables) -> DataFrame:
    return s.split_sections(t.documents_md).groupBy("doc_id").agg(F.bool_or(s.is_table(F.col("raw"))).alias("has_table"))


@query("fn_split_long", "SELECT doc_id, (length(text) - 1) // 4000 + 1 AS n, length(text) - 4000 * ((length(text) - 1) // 4000) AS last FROM documents WHERE text <> ''")
def _(t: Tables) -> DataFrame:
    cut = t.documents.where("text <> ''").select("doc_id", s.split_long(F.col("text")).alias("p"))
    return cut.select("doc_id", F.size("p").alias("n"), F.length(F.element_at("p", -1)).alias("last"))


@query("win_merge_short", f"WITH {_SECTIONS} SELECT doc_id, count(*) FILTER (short AND n > 1) AS merged FROM f GROUP BY doc_id")
def _(t: Tables) -> DataFrame:
    units = s.filled_units(F.flatten(F.transform(s.structural_units(F.col("md")), s.split_tables)))
    joined = lambda u: F.when(F.size(u) > 0, F.array(F.size(u) - F.size(s.merge_short(u))))
    return t.documents_md.select("doc_id", F.explode(s.bound(F.flatten(F.transform(units, s.split_long)), joined)).alias("merged"))


@query("win_seq_number", f"WITH {_SECTIONS} SELECT doc_id, max(seq) AS last_seq, count(*) AS n FROM sections GROUP BY doc_id")
def _(t: Tables) -> DataFrame:
    return s.split_sections(t.documents_md).groupBy("doc_id").agg(F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n"))


@query("fn_section_title", f"WITH {_SECTIONS} SELECT title, count(*) AS n FROM (SELECT {_TITLE} AS title FROM sections) GROUP BY title")
def _(t: Tables) -> DataFrame:
    return s.split_sections(t.documents_md).groupBy("title").agg(F.count(F.lit(1)).alias("n"))


_CHAPTERS = r"""c AS (SELECT doc_id, md, sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n AS start, regexp_extract(line, '^##\s+(.+?)\s*$', 1) AS title FROM (
  SELECT doc_id, md, i, p[i] AS line, length(p[i]) + 1 AS n FROM (SELECT doc_id, md, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, md, string_split(md, chr(10)) AS p FROM documents_md)))),
h AS (SELECT * FROM c WHERE title <> ''),
o AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS seq, title, start::INT AS start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), length(md))::INT AS stop FROM h),
chapters_of AS (SELECT doc_id, seq, title, start, stop, min(start) OVER (PARTITION BY doc_id) AS preamble_chars FROM o
  UNION ALL SELECT doc_id, 0, '全文', 0, length(md), 0 FROM documents_md WHERE doc_id NOT IN (SELECT doc_id FROM h))"""


@query("udtf_chapters", f'WITH {_CHAPTERS} SELECT doc_id, seq, title, start, stop AS "end", preamble_chars FROM chapters_of')
def _(t: Tables) -> DataFrame:
    return s.detect_chapters(t.documents_md)


@query("fn_detect_chapters", f"WITH {_CHAPTERS} SELECT doc_id, count(*) AS n, max(stop) AS chars FROM chapters_of GROUP BY doc_id")
def _(t: Tables) -> DataFrame:
    return s.detect_chapters(t.documents_md).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("chars"))


@query("win_chapter_bounds", f"WITH {_CHAPTERS} SELECT doc_id, seq, stop - start AS size FROM chapters_of")
def _(t: Tables) -> DataFrame:
    return s.detect_chapters(t.documents_md).select("doc_id", "seq", (F.col("end") - F.col("start")).alias("size"))


# Enrichment, merging ----------------------------------------------------------------------------------

_STUB = r"'### stub' || chr(10) || '- section ' || seq || ', about ' || len(string_split(trim(regexp_replace(raw, '\s+', ' ', 'g'), ' '), ' ')) || ' tokens' || chr(10)"
_ENRICHED = f"""{_SECTIONS}, a AS (SELECT sha256(raw) AS sha256, arg_min({_STUB}, {{'d': doc_id, 's': seq}}) AS ai_md FROM sections GROUP BY sha256(raw))"""


def enriched(t: Tables) -> tuple[DataFrame, DataFrame]:
    from docweave.operators.enrich import enrich_once, stub_client

    found = d.stored(s.split_sections(t.documents_md), "sections")
    return found, enrich_once(found, stub_client)


@query("udf_enrich_sections", f"WITH {_ENRICHED} SELECT sha256, ai_md FROM a")
def _(t: Tables) -> DataFrame:
    return enriched(t)[1].select("sha256", "ai_md")


_MERGED = f"{_ENRICHED}, m AS (SELECT doc_id, string_agg(raw || chr(10) || chr(10) || ai_md || chr(10) || '---' || chr(10), '' ORDER BY seq) AS merged FROM sections JOIN a ON a.sha256 = sha256(raw) GROUP BY doc_id)"


@query("snk_merged_document", f"WITH {_MERGED} SELECT doc_id, merged FROM m")
def _(t: Tables) -> DataFrame:
    return s.merged_document(*enriched(t))


@query("src_parse_merged", f"WITH {_ENRICHED} SELECT doc_id, seq, {_TITLE} AS title, raw FROM sections")
def _(t: Tables) -> DataFrame:
    return s.parse_merged(s.merged_document(*enriched(t))).select("doc_id", "seq", "title", "raw")


@query(
    "pipe_sections",
    f"""WITH {_SECTIONS}, first AS (SELECT sha256(md) AS h, min(doc_id) AS doc_id FROM documents_md GROUP BY sha256(md))
    SELECT left(d.doc_id, 1) AS kind, count(DISTINCT d.doc_id) AS n_docs, count(DISTINCT d.doc_id) - count(DISTINCT f.doc_id) AS n_reused_docs, count(s.seq) AS n_sections,
      count(DISTINCT sha256(s.raw)) AS n_distinct_sections, coalesce(sum(length(s.raw)), 0)::BIGINT AS chars,
      coalesce(sum(CASE WHEN s.raw IS NULL THEN 0 ELSE len(string_split(trim(regexp_replace(s.raw, '\\s+', ' ', 'g'), ' '), ' ')) END), 0)::BIGINT AS tokens_in
    FROM documents_md d LEFT JOIN first f ON f.doc_id = d.doc_id LEFT JOIN sections s ON s.doc_id = f.doc_id GROUP BY left(d.doc_id, 1)""",
)
def _(t: Tables) -> DataFrame:
    from docweave.plans.pipelines import section_report

    return section_report(t.documents_md.withColumn("kind", F.substring("doc_id", 1, 1)))


@query(
    "pipe_resume",
    """WITH f AS (SELECT section_sha, arg_min(ai_md, {'c': created_at, 'a': artifact_id}) AS ai_md FROM artifacts GROUP BY section_sha)
    SELECT task_id, string_agg(raw || '|' || coalesce(f.ai_md, 'stub ' || sha256), ';' ORDER BY seq) AS merged FROM task_sections s LEFT JOIN f ON f.section_sha = s.sha256
    WHERE task_id IN (SELECT task_id FROM task_sections WHERE status IN ('PENDING', 'RUNNING', 'FAILED')) GROUP BY task_id""",
)
def _(t: Tables) -> DataFrame:
    from docweave.plans.pipelines import resume

    return resume(t.task_sections, t.artifacts)


# Sources -----------------------------------------------------------------------------------------------


# A folder of files: most are Markdown; some have a mark in front, end in a byte that is no UTF-8, or are of another kind.
@query("src_text_documents", """SELECT 'd' || doc_id % 100 || '/' || doc_id || CASE doc_id % 10 WHEN 3 THEN '.TXT' WHEN 5 THEN '.png' WHEN 8 THEN '.pdf' ELSE '.md' END AS name,
    strlen(text) + CASE doc_id % 10 WHEN 7 THEN 1 WHEN 9 THEN 3 ELSE 0 END AS bytes, CASE WHEN doc_id % 10 NOT IN (5, 7, 8) THEN length(text) END AS chars, CASE WHEN doc_id % 10 NOT IN (5, 7, 8) THEN sha256(text) END AS sha256,
    CASE doc_id % 10 WHEN 5 THEN 'extension' WHEN 8 THEN 'parser' WHEN 7 THEN 'encoding' ELSE '' END AS reason FROM documents WHERE strlen(text) > 0 OR doc_id % 10 IN (7, 9)""")
def _(t: Tables) -> DataFrame:
    digit, raw = F.col("doc_id") % 10, F.col("text").cast("binary")
    ending = F.when(digit == 3, ".TXT").when(digit == 5, ".png").when(digit == 8, ".pdf").otherwise(".md")
    content = F.when(digit == 7, F.concat(raw, F.unhex(F.lit("FF")))).when(digit == 9, F.concat(F.unhex(F.lit("EFBBBF")), raw)).otherwise(raw)
    files = t.documents.select(F.concat(F.lit("d"), F.col("doc_id") % 100, F.lit("/"), "doc_id", ending).alias("path"), content.alias("content"))
    folder = d.scratch(t.spark, "folder")
    write_files(files, folder)
    return read_documents(t.spark, folder).select("name", "bytes", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha256"), "reason")


@query("src_content_hash", "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", d.content_hash(F.col("text")).alias("sha256"), F.octet_length("text").alias("bytes"))


# The tags that the pages have, by patterns: what goes, breaks, borders of blocks, headings, other tags; then entities.
_GONE = "|".join([*(rf"<{n}\b[^>]*>.*?</{n}>" for n in ("head", "nav", "footer", "script", "style")), "<!--.*?-->", "<![^>]*>"])
_STEPS = [(f"(?s){_GONE}", ""), (r"\s+", " "), (r"<br\s*/?>", "\v"), (r"<h1[^>]*>", "\f# "), (r"</?(?:p|div|article|body|html|ul|li|h1)\b[^>]*>", "\f"), ("<[^>]*>", "")]
_BARE = "html"
for _pattern, _by in _STEPS:
    _BARE = f"regexp_replace({_BARE}, '{_pattern}', '{_by}', 'g')"
for _name, _c in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
    _BARE = f"replace({_BARE}, '&{_name};', '{_c}')"
_BLOCK = "trim(regexp_replace(z, ' *\v *', chr(10), 'g'), ' ' || chr(10))"


@query("src_html_to_markdown", f"""SELECT page_id, md, length(md) AS chars FROM (
    SELECT page_id, array_to_string(list_filter(list_transform(string_split({_BARE}, '\f'), lambda z: {_BLOCK}), lambda z: z <> ''), chr(10) || chr(10)) AS md FROM pages)""")
def _(t: Tables) -> DataFrame:
    return html_to_markdown(t.pages, "page_id", "html").select("page_id", "md", F.length("md").alias("chars"))


@query("src_filter_extension", "SELECT task_id, path, lower(regexp_extract(path, '\\.[^.]+$')) IN ('.md', '.markdown', '.txt', '.pdf') AS accepted FROM tasks")
def _(t: Tables) -> DataFrame:
    return t.tasks.select("task_id", "path", d.supported(F.col("path")).alias("accepted"))


@query("src_dedup_paths", "SELECT path, min(task_id) AS task_id FROM tasks GROUP BY path")
def _(t: Tables) -> DataFrame:
    from docweave.operators.relational import first_match

    return first_match(t.tasks, "path", ["task_id"]).select("path", "task_id")


@query(
    "src_paged_anchors",
    r"""WITH p AS (SELECT doc_id, unnest(range(len(q))) + 1 AS page, unnest(q) AS page_text FROM (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), '. ') AS q FROM documents)),
    g AS (SELECT doc_id, page, unnest(range(len(q))) AS i, trim(unnest(q), ' ') AS para FROM (SELECT doc_id, page, string_split(page_text, chr(10) || chr(10)) AS q FROM p))
    SELECT doc_id, concat('src:ns', doc_id, ':p', page, ':para', row_number() OVER (PARTITION BY doc_id, page ORDER BY i)) AS anchor, md5(para) AS digest FROM g WHERE para <> ''""",
)
def _(t: Tables) -> DataFrame:
    return _anchors(t).select("doc_id", "anchor", F.md5("text").alias("digest"))


def _anchors(t: Tables) -> DataFrame:
    paged = F.replace(F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit(". "), F.lit("\f"))
    docs = t.documents.select("doc_id", paged.alias("text"), F.concat(F.lit("ns"), "doc_id").alias("ns"))
    return d.paged_anchors(docs, "doc_id", "text", F.col("ns"), "src")


@query(
    "udtf_anchors",
    r"""WITH p AS (SELECT doc_id, unnest(range(len(q))) + 1 AS page, unnest(q) AS page_text FROM (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), '. ') AS q FROM documents)),
    g AS (SELECT doc_id, page, trim(unnest(string_split(page_text, chr(10) || chr(10))), ' ') AS para FROM p)
    SELECT doc_id, count(*) AS anchors, max(page)::INT AS pages FROM g WHERE para <> '' GROUP BY doc_id""",
)
def _(t: Tables) -> DataFrame:
    return _anchors(t).groupBy("doc_id").agg(F.count(F.lit(1)).alias("anchors"), F.max("page").alias("pages"))


@query(
    "win_anchor_number",
    r"""WITH p AS (SELECT doc_id, unnest(range(len(q))) + 1 AS page, unnest(q) AS page_text FROM (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), '. ') AS q FROM documents)),
    g AS (SELECT doc_id, page, trim(unnest(string_split(page_text, chr(10) || chr(10))), ' ') AS para FROM p)
    SELECT doc_id, page::INT AS page, count(*)::INT AS last FROM g WHERE para <> '' GROUP BY doc_id, page""",
)
def _(t: Tables) -> DataFrame:
    return _anchors(t).groupBy("doc_id", "page").agg(F.max("para").alias("last"))


@query(
    "src_attachments",
    """WITH a AS (SELECT doc_id AS attachment_id, CASE WHEN doc_id % 3 <> 0 THEN doc_id END AS chapter_id, coalesce(CASE WHEN doc_id % 3 <> 2 THEN c.source_id END, doc_id % 150 + 1) AS source_id, replace(text, '. ', chr(12)) AS text
        FROM documents LEFT JOIN chapters c ON c.chapter_id = doc_id),
    b AS (SELECT a.*, s.course_id + CASE WHEN attachment_id % 7 = 0 THEN 1 ELSE 0 END AS course_id, s.course_id AS own FROM a LEFT JOIN sources s USING (source_id)),
    v AS (SELECT b.*, substr(sha256(text), 1, 12) AS namespace, concat_ws(',', CASE WHEN own = b.course_id THEN NULL ELSE 'source' END,
        CASE WHEN b.chapter_id IS NULL OR (c.source_id = b.source_id AND c.course_id = b.course_id) THEN NULL ELSE 'chapter' END) AS violations FROM b LEFT JOIN chapters c ON c.chapter_id = b.chapter_id),
    p AS (SELECT attachment_id, namespace, unnest(range(len(q))) + 1 AS page, unnest(q) AS body FROM (SELECT attachment_id, namespace, string_split(text, chr(12)) AS q FROM v WHERE violations = '')),
    g AS (SELECT attachment_id, namespace, page, unnest(range(len(r))) + 1 AS para, unnest(r) AS body FROM (
        SELECT *, list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda z: trim(z, ' ')), lambda z: z <> '') AS r FROM p)),
    k AS (SELECT attachment_id, count(*)::INT AS n, sha256(string_agg('att:' || namespace || ':p' || page || ':para' || para || '=' || sha256(body), ',' ORDER BY page, para)) AS digest FROM g GROUP BY attachment_id)
    SELECT attachment_id, violations, namespace, CASE WHEN violations = '' THEN coalesce(n, 0) END AS n_anchors, CASE WHEN violations = '' THEN coalesce(digest, sha256('')) END AS anchors_sha256 FROM v LEFT JOIN k USING (attachment_id)""",
)
def _(t: Tables) -> DataFrame:
    doc = F.col("doc_id")
    own = t.chapters.select(F.col("chapter_id").alias("doc_id"), F.col("source_id").alias("_own"))
    source = F.coalesce(F.when(doc % 3 != 2, F.col("_own")), doc % 150 + 1)
    specs = t.documents.join(own, "doc_id", "left").select(
        doc.alias("attachment_id"), F.when(doc % 3 != 0, doc).alias("chapter_id"), source.alias("source_id"), F.replace("text", F.lit(". "), F.lit("\f")).alias("text")
    )
    shifted = F.col("course_id") + F.when(F.col("attachment_id") % 7 == 0, 1).otherwise(0)
    specs = specs.join(t.sources.select("source_id", "course_id"), "source_id", "left").withColumn("course_id", shifted)
    found = attachments(specs, t.sources, t.chapters)
    told = F.array_join(F.transform("anchors", lambda z: F.concat(z["anchor"], F.lit("="), z["sha256"])), ",")
    n = F.when(F.col("anchors").isNotNull(), F.size("anchors"))
    return found.select("attachment_id", "violations", "namespace", n.alias("n_anchors"), F.sha2(told, 256).alias("anchors_sha256"))


@query(
    "src_extract_images",
    """SELECT conv_id, turn, 'img_000.png' AS name, strlen(role || turn) AS bytes FROM conversations UNION ALL SELECT conv_id, turn, 'img_001.jpeg', strlen(turn || role) FROM conversations""",
)
def _(t: Tables) -> DataFrame:
    enc = lambda *c: F.base64(F.concat(*c).cast("binary"))
    md = F.concat("text", F.lit(" ![a](data:image/png;base64,"), enc("role", "turn"), F.lit(") and ![](data:image/jpeg;base64,"), enc("turn", "role"), F.lit(")"))
    return d.images(t.conversations.select("conv_id", "turn", md.alias("md")), ["conv_id", "turn"], "md").select("conv_id", "turn", "name", F.length("content").alias("bytes"))


@query("src_page_state_json", "SELECT doc_id AS page, sha256('{\"page\":' || doc_id || ',\"status\":\"accepted\",\"confidence\":1}') AS fingerprint FROM documents WHERE doc_id % 4 <> 0")
def _(t: Tables) -> DataFrame:
    status = F.when(F.col("doc_id") % 4 == 0, "pending").otherwise("accepted")
    body = F.when(F.col("doc_id") % 8 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("doc_id").alias("page"), status.alias("status"), F.lit(1).alias("confidence"))))
    return d.page_states(t.documents.select(body.alias("value")))


# Every chapter's files as they lie in the folder after a second write, which finds them all the same.
_LAST_RUNS = "SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY chapter_id, round_key ORDER BY created_at DESC, run_id DESC) = 1"
_BUNDLE = f"""WITH p AS (SELECT chapter_id, title, source_id || '/' || lpad((seq + 1)::VARCHAR, 2, '0') || '-' || title AS folder FROM chapters),
n AS (SELECT chapter_id, string_agg(chr(10) || '## ' || kind || chr(10) || chr(10) || content || chr(10), '' ORDER BY seq, note_id) AS notes FROM note_blocks GROUP BY chapter_id),
k AS (SELECT origin_id AS chapter_id, string_agg(chr(10) || '## ' || title || chr(10) || chr(10) || '类型：' || tags || chr(10) || '收藏：' || CASE WHEN favourite THEN '是' ELSE '否' END || chr(10) || chr(10) || content || chr(10), '' ORDER BY card_id) AS cards FROM chapter_cards GROUP BY origin_id),
f AS (SELECT folder || '/source.md' AS path, 'text of ' || title AS content FROM p
  UNION ALL SELECT folder || '/intensive-note.md', '<!-- chapter-id: ' || chapter_id || ' -->' || chr(10) || '# ' || title || chr(10) || coalesce(notes, '') FROM p LEFT JOIN n USING (chapter_id)
  UNION ALL SELECT folder || '/cards.md', '# ' || title || ' 写作卡片' || chr(10) || coalesce(cards, '') FROM p LEFT JOIN k USING (chapter_id)
  UNION ALL SELECT folder || '/runs/' || round_key || '.md', '# ' || round_key || chr(10) || chr(10) || '状态：' || status || chr(10) || '过期：' || CASE WHEN heartbeat_at % 11 = 0 THEN '是' ELSE '否' END || chr(10) || '执行器：stub' || chr(10) || chr(10) || '## 输出' || chr(10) || chr(10)
    || output || CASE WHEN run_id % 5 = 0 THEN ' [REDACTED] at [REDACTED]' ELSE '' END || chr(10) FROM p JOIN ({_LAST_RUNS}) USING (chapter_id))
SELECT path, strlen(content) AS bytes, sha256(content) AS sha256, 'same' AS state FROM f"""


@query("snk_chapter_bundle", _BUNDLE)
def _(t: Tables) -> DataFrame:
    from docweave.plans.pipelines import chapter_bundle

    said = F.concat("output", F.when(F.col("run_id") % 5 == 0, " secret=abc at /x/y").otherwise(""))
    runs = t.runs.withColumn("output", said).withColumn("stale", F.col("heartbeat_at") % 11 == 0).withColumn("executor", F.lit("stub"))
    chapters = t.chapters.withColumn("source", F.concat(F.lit("text of "), "title"))
    files, folder = rendered(chapter_bundle(chapters, t.note_blocks, t.chapter_cards, runs)), d.scratch(t.spark, "chapters")
    write_files(files, folder, archived=True, once=False)
    again = write_files(files, folder, archived=True, once=False)
    there = manifest(t.spark, folder).withColumn("sha256", F.unhex("sha256"))
    return there.join(again.hint("merge"), "path").select("path", "bytes", F.lower(F.hex("sha256")).alias("sha256"), "state")


@query("fn_build_prompt", "SELECT chapter_id, 'Read the chapter ' || title || '.' || chr(10) || coalesce(string_agg('[src:' || note_id || '] ' || content, chr(10) ORDER BY n.seq, note_id), '') AS prompt FROM chapters LEFT JOIN note_blocks n USING (chapter_id) GROUP BY chapter_id, title")
def _(t: Tables) -> DataFrame:
    from docweave.plans.pipelines import prompts

    return prompts(t.chapters, t.note_blocks)


@query("fn_review_prompt", """SELECT chapter_id, '{"chapter":"' || any_value(title) || '","notes":' || count(note_id) || '}' AS prompt FROM chapters LEFT JOIN note_blocks n USING (chapter_id) GROUP BY chapter_id""")
def _(t: Tables) -> DataFrame:
    n = t.note_blocks.groupBy("chapter_id").agg(F.count(F.lit(1)).alias("notes"))
    joined = t.chapters.join(n, "chapter_id", "left").fillna(0, ["notes"])
    return joined.select("chapter_id", F.to_json(F.struct(F.col("title").alias("chapter"), "notes")).alias("prompt"))


# Some sources have a title that looks like a number given to an equal one.
_TITLED = "CASE source_id % 10 WHEN 3 THEN title || '（2）' WHEN 7 THEN title || '（3）' WHEN 9 THEN title || '（5）' WHEN 1 THEN lower(title) ELSE title END"


@query("win_display_titles", f"""WITH n AS (SELECT course_id, source_id, {_TITLED} AS title FROM sources), p AS (SELECT *, replace(replace(lower(title), '（', '('), '）', ')') AS stem FROM n),
    k AS (SELECT *, row_number() OVER (PARTITION BY course_id, stem ORDER BY source_id) AS rank FROM p),
    x AS (SELECT course_id, regexp_extract(stem, '^(.*)\\((\\d+)\\)$', 1) AS stem, list_sort(list(DISTINCT regexp_extract(stem, '^(.*)\\((\\d+)\\)$', 2)::INT)) AS taken FROM p WHERE regexp_matches(stem, '\\(\\d+\\)$') GROUP BY ALL)
    SELECT course_id, source_id, title, CASE WHEN rank = 1 THEN title ELSE title || '（' || (rank + len(list_filter(list_transform(coalesce(taken, []), lambda v, i: v - i + 1), lambda v: v <= rank))) || '）' END AS display
    FROM k LEFT JOIN x USING (course_id, stem)""")
def _(t: Tables) -> DataFrame:
    from docweave.operators.enrich import display_titles

    return display_titles(t.sources.select("course_id", "source_id", F.expr(_TITLED).alias("title")), "course_id", "source_id")
