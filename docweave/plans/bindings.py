"""Logical tables of the library over the given tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from docweave.operators.rendering import TOPIC_SECTIONS

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"
)

BINDINGS = {
    "line_rows": """SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
        l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS line_id FROM lineitem""",
    "courses": """SELECT n_nationkey AS course_id, n_name AS name, n_regionkey AS root_id, n_nationkey % 3 = 0 AS favourite FROM nation""",
    "sources": """SELECT c_custkey AS source_id, c_nationkey AS course_id, c_mktsegment AS title,
        (c_custkey * 7919) % 100003 AS created_at FROM customer""",
    "chapters": """SELECT o_orderkey AS chapter_id, o_custkey AS source_id, sources.course_id AS course_id,
        CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS seq,
        concat('Chapter ', CAST(o_orderkey AS STRING)) AS title,
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'CONFIRMED' WHEN o_orderpriority = '3-MEDIUM' THEN 'COMPLETED' ELSE 'DRAFT' END AS status,
        CAST(floor(o_totalprice) AS BIGINT) AS length
        FROM orders JOIN sources ON sources.source_id = o_custkey""",
    "reviews": """SELECT o_orderkey AS chapter_id, 'review' AS round_key,
        CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status,
        o_orderkey % 11 = 0 AS stale, concat('review of ', CAST(o_orderkey AS STRING)) AS output,
        concat('in', CAST(o_orderkey % 97 AS STRING)) AS input_fingerprint FROM orders""",
    "runs": """SELECT l_orderkey * 1000 + line_id AS run_id, l_orderkey AS chapter_id, concat('round', CAST(l_linenumber % 4 AS STRING)) AS round_key,
        CASE l_returnflag WHEN 'A' THEN 'DONE' WHEN 'N' THEN 'RUNNING' ELSE 'FAILED' END AS status,
        concat('out ', CAST(l_partkey AS STRING)) AS output, concat('in', CAST(l_suppkey % 2 AS STRING)) AS input_fingerprint,
        (l_partkey * 31) % 1009 AS created_at, (l_partkey * 31) % 1009 + l_linenumber AS finished_at,
        (l_suppkey * 17) % 2003 AS heartbeat_at, 'internal ' AS prefix FROM line_rows""",
    "topics": """SELECT p_partkey AS topic_id, p_partkey % 25 AS course_id, p_name AS title, p_size % 2 = 0 AS confirmed,
        CASE p_size % 6 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'NOT_READY' WHEN 2 THEN 'READY' WHEN 3 THEN 'RUNNING' WHEN 4 THEN 'PUBLISHED' ELSE 'STALE' END AS status,
        CAST(p_partkey % 40 AS INT) AS seq, (p_partkey * 13) % 977 AS updated_at FROM part""",
    "topic_chapters": """SELECT DISTINCT l_partkey AS topic_id, l_orderkey AS chapter_id FROM lineitem""",
    "note_blocks": """SELECT l_orderkey * 1000 + line_id AS note_id, l_orderkey AS chapter_id,
        CASE l_linenumber WHEN 1 THEN 'summary' WHEN 2 THEN 'concepts' WHEN 3 THEN 'diagram' WHEN 4 THEN 'examples' WHEN 5 THEN 'questions' WHEN 6 THEN 'risks' ELSE 'cards' END AS kind,
        CAST(l_linenumber AS INT) AS seq, concat('note ', CAST(l_partkey AS STRING)) AS content, l_suppkey AS version FROM line_rows""",
    "topic_notes": """SELECT p_partkey AS topic_id, concat('topic note ', p_type) AS content FROM part WHERE p_partkey % 4 = 0""",
    "chapter_cards": """SELECT l_orderkey * 1000 + line_id AS card_id, l_orderkey AS origin_id, concat('card ', CAST(l_suppkey AS STRING)) AS title,
        concat('content of ', CAST(l_partkey AS STRING)) AS content, concat('tag', CAST(l_suppkey % 7 AS STRING), ' ', 'tag', CAST(l_partkey % 5 AS STRING)) AS tags,
        l_linenumber % 3 = 0 AS favourite, (l_partkey * 7) % 1013 AS updated_at FROM line_rows WHERE l_returnflag = 'R'""",
    "topic_cards": """SELECT p_partkey AS card_id, p_partkey AS origin_id, p_name AS title, concat('about ', p_type) AS content, p_name AS tags,
        p_size % 4 = 0 AS favourite, (p_partkey * 11) % 1013 AS updated_at FROM part""",
    "tasks": """SELECT o_orderkey AS task_id, o_custkey AS batch_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status,
        (o_orderkey * 7919) % 100003 AS created_at,
        concat('/in/', CAST(o_orderkey % 5000 AS STRING), CASE o_orderkey % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' WHEN 2 THEN '.pdf' ELSE '.png' END) AS path,
        concat('h', CAST(o_orderkey % 3000 AS STRING)) AS file_hash FROM orders""",
    "batches": """SELECT c_custkey AS batch_id, CASE c_custkey % 4 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'COMPLETED' WHEN 2 THEN 'FAILED' ELSE 'PENDING' END AS status,
        (c_custkey * 7919) % 100003 AS created_at, c_custkey % 13 AS total_tasks FROM customer""",
    "task_sections": """SELECT l_orderkey AS task_id, CAST(line_id - 1 AS INT) AS seq, concat('sec', CAST(l_partkey AS STRING)) AS sha256,
        CASE WHEN l_returnflag = 'A' THEN 'COMPLETED' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'PENDING' WHEN l_returnflag = 'N' THEN 'RUNNING' ELSE 'FAILED' END AS status,
        concat('raw ', CAST(l_partkey AS STRING), ' ', CAST(l_linenumber AS STRING)) AS raw, CAST(l_linenumber AS INT) % 3 AS retries,
        CAST(floor(l_quantity) AS BIGINT) AS tokens FROM line_rows""",
    "artifacts": """SELECT p_partkey AS artifact_id, concat('sec', CAST(p_partkey % 1500 AS STRING)) AS section_sha, concat('about ', p_name, ' ', CAST(p_partkey AS STRING)) AS ai_md,
        CAST(p_size AS BIGINT) AS created_at, concat('model', CAST(p_partkey % 3 AS STRING)) AS model_name, CAST(p_size AS BIGINT) * 3 AS tokens_in,
        CAST(p_size AS BIGINT) + 5 AS tokens_out, p_partkey % 17 AS cost_micro FROM part WHERE p_partkey % 3 <> 0""",
    "event_log": """SELECT user_id AS batch_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS seq,
        event_id % 40 AS task_id, CASE event_type WHEN 'view' THEN 'TASK_STATE' WHEN 'click' THEN 'TOKEN' WHEN 'signup' THEN 'TASK_STATE' WHEN 'error' THEN 'ERROR' ELSE 'TASK_STATE' END AS event,
        CASE event_type WHEN 'view' THEN 'PARSING' WHEN 'signup' THEN 'RUNNING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE props END AS payload,
        event_id, ts FROM events""",
}

#: Where the two engines need different words for the same table.
SPARK_ONLY: dict[str, str] = {}

_TURN = """concat('## ', role, ' ', CAST(turn AS STRING), chr(10), chr(10), text, chr(10), CASE WHEN conv_id % 5 = 0 THEN
  concat(chr(10), '| a | b |', chr(10), '|---|---|', chr(10), '| ', CAST(turn AS STRING), ' | ', CAST(length(text) AS STRING), ' |', chr(10)) ELSE '' END)"""
_MD = """SELECT concat('c', CAST(conv_id AS STRING)) AS doc_id, concat('# Conversation ', CAST(conv_id AS STRING), chr(10), {turns}) AS md
  FROM conversations GROUP BY conv_id UNION ALL SELECT concat('d', CAST(doc_id AS STRING)) AS doc_id, text AS md FROM documents"""
BINDINGS["documents_md"] = _MD.format(turns=f"string_agg({_TURN}, '' ORDER BY turn)")
SPARK_ONLY["documents_md"] = _MD.format(
    turns=f"array_join(transform(array_sort(collect_list(struct(turn, {_TURN} AS md))), x -> x.md), '')"
)
# Page-ordered text with numbered headings and a table of contents on each source's first page.
BINDINGS["page_lines"] = """SELECT page_id % 10 AS source_id, CAST((page_id - page_id % 10) / 10 + 1 AS INT) AS page, 1 AS line_no,
    CASE WHEN (page_id - page_id % 10) / 10 % 3 = 0 THEN concat('Chapter ', CAST(CAST((page_id - page_id % 10) / 30 + 1 AS INT) AS STRING), ' part ', substr(url, 8, 4))
      ELSE concat(CAST(CAST(floor((page_id - page_id % 10) / 30) + 1 AS INT) AS STRING), '.', CAST(CAST((page_id - page_id % 10) / 10 % 3 AS INT) AS STRING), ' topic ', substr(url, 8, 4)) END AS line FROM pages
  UNION ALL SELECT source_id, 1 AS page, line_no, line FROM (
    SELECT page_id % 10 AS source_id, CAST(100 + page_id AS INT) AS line_no,
      concat('Chapter ', CAST(CAST((page_id - page_id % 10) / 30 + 1 AS INT) AS STRING), ' part ', substr(url, 8, 4), ' .... ', CAST(CAST((page_id - page_id % 10) / 10 + 1 + (CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END) AS INT) AS STRING)) AS line
    FROM pages WHERE (page_id - page_id % 10) / 10 % 3 = 0 AND page_id % 4 <> 1) toc
  UNION ALL SELECT page_id % 10 AS source_id, 1 AS page, 99 AS line_no, 'contents' AS line FROM pages WHERE page_id < 10"""
# Two readings of a document's lines: the second drops, shifts or changes some of them.
_BLOCKS = """SELECT doc_id * 100000 + CAST(floor(i / 40) AS BIGINT) AS page_id, CAST(i % 40 AS INT) AS block_idx, {text} AS text, CAST(0.1 AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, CAST(0.8 AS DOUBLE) AS width, CAST(0.025 AS DOUBLE) AS height,
    CASE WHEN (doc_id + i) % 41 = 0 THEN 'table' WHEN (doc_id + i) % 43 = 0 THEN 'footnote' ELSE 'paragraph' END AS type, CAST(i % 40 AS INT) AS reading_order, CASE WHEN (doc_id + i) % 41 = 0 THEN {table} END AS {name}
  FROM ({lines}) l {where}"""
_LINES = {
    "spark": "SELECT doc_id, i, line FROM (SELECT doc_id, split(text, chr(10), -1) AS p FROM documents) d LATERAL VIEW posexplode(p) v AS i, line",
    "duck": "SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents) d",
}
_OTHER = {
    "text": "CASE (doc_id * 31 + i) % 17 WHEN 3 THEN concat(line, ' 7') WHEN 5 THEN concat(line, ' +') WHEN 7 THEN replace(line, 'e', 'a') WHEN 9 THEN replace(line, ' ', '  ') ELSE line END",
    "y": "CASE WHEN (doc_id * 31 + i) % 17 = 11 THEN (i % 40 + 0.4) * 0.025 ELSE (i % 40) * 0.025 END",
    "where": "WHERE (doc_id * 31 + i) % 17 <> 1",
}
# Tables of three columns: words of the line, and its length in a merged cell. The other reading loses a column or changes a
# cell. One table in three is given as cells with a span, the others as rows; the twin has all as rows.
_ROWS = {
    "spark": "array(slice(concat(split(line, ' '), array('', '', '')), 1, 3), array('n', {0}, {0}))",
    "duck": "[list_slice(list_concat(string_split(line, ' '), ['', '', '']), 1, 3), ['n', {0}, {0}]]",
}
_N, _CHANGED = "CAST(length(line) AS STRING)", "CAST(length(line) + CASE WHEN (doc_id + i) % 5 = 1 THEN 1 ELSE 0 END AS STRING)"
_CELLS = """transform(slice(concat(split(line, ' '), array('', '', '')), 1, 3), (w, k) -> named_struct('row', 0, 'col', k, 'row_span', 1, 'col_span', 1, 'text', w))"""
_CELLS = f"""concat({_CELLS}, array(named_struct('row', 1, 'col', 0, 'row_span', 1, 'col_span', 1, 'text', 'n'), named_struct('row', 1, 'col', 1, 'row_span', 1, 'col_span', 2, 'text', {_N})))"""
_NARROW = "(doc_id + i) % 5 = 2"
_SPARK_TABLE = "named_struct('headers', CAST(NULL AS array<string>), 'matrix', {0}, 'cells', {1})"
_NONE = "CAST(NULL AS array<struct<row: int, col: int, row_span: int, col_span: int, text: string>>)"
_TABLES = {
    "spark": (
        f"CASE WHEN doc_id % 3 = 0 THEN {_SPARK_TABLE.format('CAST(NULL AS array<array<string>>)', _CELLS)} ELSE {_SPARK_TABLE.format(_ROWS['spark'].format(_N), _NONE)} END",
        _SPARK_TABLE.format(f"transform({_ROWS['spark'].format(_CHANGED)}, w -> slice(w, 1, CASE WHEN {_NARROW} THEN 2 ELSE 3 END))", _NONE),
    ),
    "duck": (
        _ROWS["duck"].format(_N),
        f"list_transform({_ROWS['duck'].format(_CHANGED)}, lambda w: list_slice(w, 1, CASE WHEN {_NARROW} THEN 2 ELSE 3 END))",
    ),
}
_NAMES = {"spark": "`table`", "duck": '"table"'}
for _engine, _to in (("spark", SPARK_ONLY), ("duck", BINDINGS)):
    _to["blocks_a"] = _BLOCKS.format(text="line", y="(i % 40) * 0.025", lines=_LINES[_engine], where="", table=_TABLES[_engine][0], name=_NAMES[_engine])
    _to["blocks_b"] = _BLOCKS.format(lines=_LINES[_engine], table=_TABLES[_engine][1], name=_NAMES[_engine], **_OTHER)

# Topic blocks and cards: a part's first fourteen lines, in the fixed order of kinds, and its returned lines.
BINDINGS["chapter_labels"] = """SELECT chapters.chapter_id, chapters.source_id, chapters.seq, chapters.title,
    concat('[《', sources.title, ' ', CAST(chapters.source_id AS STRING), '》·第 ', CAST(chapters.seq + 1 AS STRING), ' 章]') AS label
    FROM chapters JOIN sources ON sources.source_id = chapters.source_id"""
_KIND = " ".join(f"WHEN {i} THEN '{kind}'" for i, kind in enumerate(TOPIC_SECTIONS, 1))
BINDINGS["topic_blocks"] = f"""SELECT topic_id, CASE seq {_KIND} END AS kind, CASE WHEN seq > 12 THEN concat('graph TD', chr(10), 'A --> B', CAST(l_orderkey AS STRING)) ELSE concat('text of ', CAST(l_orderkey AS STRING)) END AS content FROM (
    SELECT l_partkey AS topic_id, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, line_id) AS seq FROM line_rows) numbered WHERE seq <= 14"""
BINDINGS["topic_card_rows"] = """SELECT card_id, topic_id, 'concept' AS card_type, returned.title, content, coalesce(label, '[《none》·第 1 章]') AS ref FROM (
    SELECT l_orderkey * 1000 + line_id AS card_id, l_partkey AS topic_id, concat('card ', CAST(l_suppkey AS STRING)) AS title, concat('content of ', CAST(l_orderkey AS STRING)) AS content,
      CASE WHEN l_suppkey % 53 = 7 THEN -1 ELSE l_orderkey END AS chapter_ref FROM line_rows WHERE l_returnflag = 'R') returned LEFT JOIN chapter_labels ON chapter_labels.chapter_id = chapter_ref"""
# Texts of a topic: two in three name a chapter by its number only, some cite a source that isn't there.
BINDINGS["topic_texts"] = """SELECT l_partkey AS topic_id, l_orderkey * 1000 + line_id AS note_id, concat('see ',
    CASE WHEN l_linenumber % 3 = 1 THEN coalesce(label, '') ELSE CAST(l_orderkey AS STRING) END, ' and ', CASE WHEN l_suppkey % 5 = 0 THEN '[《none》·第 1 章]' ELSE 'more' END) AS content
    FROM line_rows LEFT JOIN chapter_labels ON chapter_labels.chapter_id = l_orderkey"""


class Tables:
    """The given and the logical tables as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in BINDINGS:
            text = SPARK_ONLY.get(name, BINDINGS[name])
            used = [x for x in dict.fromkeys(re.findall(r"\b[a-z_]+\b", text)) if x != name and (x in BINDINGS or x in BASE)]
            used = [x for x in used if re.search(rf"\b(?:FROM|JOIN) {x}\b", text)]
            for x in used:
                getattr(self, x).createOrReplaceTempView(f"docweave_{x}")
                text = re.sub(rf"\b(FROM|JOIN) {x}\b", rf"\1 docweave_{x} AS {x}", text)
            df = self.spark.sql(text)
        else:
            raise AttributeError(name)
        setattr(self, name, df)
        return df
