"""Page reconciliation, chapter trees, changes, validation, streams and the composite pipelines."""

from __future__ import annotations

import collections

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import text as x
from docweave.operators import changes as m
from docweave.operators import chapters as c
from docweave.operators import diagrams as d
from docweave.operators import evidence as ev
from docweave.operators import pages as p
from docweave.operators import relational as r
from docweave.operators import tables as tb
from docweave.operators import validation as v
from docweave.operators.ledger import Executor, Ledger, by_round
from docweave.operators.rounds import run_rounds
from docweave.plans import pipelines as pipe
from docweave.plans.bindings import Tables
from docweave.plans.registry import query
from docweave.plans.relational_queries import _READY, KINDS, reviewed
from docweave.plans.text_queries import _SECTIONS
from docweave.streaming import events as st

# Pages ---------------------------------------------------------------------------------------------

_N = r"regexp_extract_all({0}, '(?:\d+(?:[.,]\d+)*%?|%\d+)')"
_O = r"regexp_extract_all({0}, '(?:<=|>=|!=|==|=|<|>|\+|-|\*|/|\^)')"
_SHAPE = "len({0}) || 'x' || list_max(list_transform({0}, lambda w: len(w)))"
_PAIRS = rf"""j AS (SELECT a.page_id, a.block_idx, a.type, a."table" AS ta, b."table" AS tb, trim(regexp_replace(a.text, '\s+', ' ', 'g'), ' ') AS lt, trim(regexp_replace(b.text, '\s+', ' ', 'g'), ' ') AS rt FROM blocks_a a JOIN blocks_b b USING (page_id, block_idx)),
k AS (SELECT *, replace(lt, ' ', '') AS l, replace(rt, ' ', '') AS q FROM j),
conflicts_of AS (SELECT page_id, CASE WHEN {_N.format("l")} <> {_N.format("q")} THEN 'numeric_conflict' WHEN {_O.format("l")} <> {_O.format("q")} THEN 'formula_operator_conflict' ELSE 'text_conflict' END AS reason, block_idx AS left_idx, block_idx AS right_idx FROM k WHERE l <> q
  UNION ALL SELECT page_id, CASE WHEN {_SHAPE.format("ta")} <> {_SHAPE.format("tb")} THEN 'table_shape_conflict' ELSE 'table_content_conflict' END, block_idx, block_idx FROM k WHERE type = 'table' AND ta <> tb
  UNION ALL SELECT page_id, 'footnote_conflict', block_idx, block_idx FROM k WHERE type = 'footnote' AND lt <> rt
  UNION ALL SELECT page_id, 'missing_block', block_idx, NULL FROM blocks_a a WHERE NOT EXISTS (SELECT 1 FROM blocks_b b WHERE b.page_id = a.page_id AND b.block_idx = a.block_idx)),
classes_of AS (SELECT page_id, CASE WHEN h THEN 'complex' WHEN n > 0 THEN 'conflict' ELSE 'consistent' END AS status, n AS n_conflicts FROM (
  SELECT page_id, bool_or(type = 'table') AS h, (SELECT count(*) FROM conflicts_of f WHERE f.page_id = a.page_id) AS n FROM blocks_a a GROUP BY page_id))"""


def pairs(t: Tables) -> DataFrame:
    """The pairs, written once: most queries read them several times."""
    return p.stored_pairs(t.blocks_a, t.blocks_b)


@query("join_block_iou", "SELECT page_id, block_idx AS left_idx, block_idx AS right_idx FROM blocks_a JOIN blocks_b USING (page_id, block_idx)")
def _(t: Tables) -> DataFrame:
    return pairs(t)


@query("fn_iou", "SELECT a.page_id, a.block_idx, round((0.025 - (b.y - a.y)) / (0.025 + (b.y - a.y)), 6) AS score FROM blocks_a a JOIN blocks_b b USING (page_id, block_idx)")
def _(t: Tables) -> DataFrame:
    box = lambda name: F.struct("x", "y", "width", "height").alias(name)
    met = t.blocks_a.select("page_id", "block_idx", box("a")).join(t.blocks_b.select("page_id", "block_idx", box("b")), ["page_id", "block_idx"])
    return met.select("page_id", "block_idx", F.round(x.iou(F.col("a"), F.col("b")), 6).alias("score"))


@query("join_missing_block", f"WITH {_PAIRS} SELECT page_id, 'left' AS side, left_idx AS block_idx FROM conflicts_of WHERE reason = 'missing_block'")
def _(t: Tables) -> DataFrame:
    return p.unmatched(t.blocks_a, t.blocks_b, pairs(t))


@query("fn_block_conflicts", f"WITH {_PAIRS} SELECT page_id, reason, left_idx, right_idx FROM conflicts_of WHERE reason <> 'missing_block'")
def _(t: Tables) -> DataFrame:
    met = p.matched(t.blocks_a, t.blocks_b, pairs(t))
    return met.select("page_id", F.explode(p.pair_conflicts()).alias("reason"), "left_idx", "right_idx")


@query("prj_conflict_evidence", f"WITH {_PAIRS} SELECT f.page_id, f.reason, a.text AS left_text, b.text AS right_text, coalesce(a.y, b.y) AS region_y FROM conflicts_of f LEFT JOIN blocks_a a ON a.page_id = f.page_id AND a.block_idx = f.left_idx LEFT JOIN blocks_b b ON b.page_id = f.page_id AND b.block_idx = f.right_idx")
def _(t: Tables) -> DataFrame:
    found = p.conflicts(t.blocks_a, t.blocks_b, pairs(t))
    a = t.blocks_a.select("page_id", F.col("block_idx").alias("left_idx"), F.col("text").alias("left_text"), F.col("y").alias("ly"))
    b = t.blocks_b.select("page_id", F.col("block_idx").alias("right_idx"), F.col("text").alias("right_text"), F.col("y").alias("ry"))
    met = found.join(a, ["page_id", "left_idx"], "left").join(b, ["page_id", "right_idx"], "left")
    return met.select("page_id", "reason", "left_text", "right_text", F.coalesce("ly", "ry").alias("region_y"))


@query("fn_page_class", f"WITH {_PAIRS} SELECT page_id, status, n_conflicts FROM classes_of")
def _(t: Tables) -> DataFrame:
    return p.classes(t.blocks_a, t.blocks_b, p.conflicts(t.blocks_a, t.blocks_b, pairs(t)))


@query("win_reading_order", "SELECT page_id, 'reading_order_conflict' AS reason, min(block_idx) AS left_idx, min(block_idx) AS right_idx FROM blocks_a JOIN blocks_b USING (page_id, block_idx) WHERE page_id % 3 = 0 GROUP BY page_id HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    turned = F.when(F.col("page_id") % 3 == 0, -F.col("reading_order")).otherwise(F.col("reading_order"))
    met = p.matched(t.blocks_a, t.blocks_b.withColumn("reading_order", turned), pairs(t))
    alone = met.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("page_id")
    return p.order_conflicts(met.join(alone, "page_id", "left_semi"))


_REASON = "CASE WHEN status = 'conflict' THEN 'CONFLICT' WHEN status = 'complex' THEN 'COMPLEX' WHEN ('0x' || substr(sha256(concat_ws(':', sha256(page_id::VARCHAR), page_id::VARCHAR)), 1, 16))::UBIGINT % 10000 < 500 THEN 'SAMPLE' END"


@query("pipe_reconcile", f"WITH {_PAIRS} SELECT page_id, status, n_conflicts, {_REASON} AS reason FROM classes_of")
def _(t: Tables) -> DataFrame:
    return p.reconcile(t.blocks_a, t.blocks_b, 0.05)


def _reading(blocks: str, text: str = "text") -> str:
    return f"SELECT page_id, sha256(string_agg(concat_ws(chr(31), block_idx, type, {text}), chr(30) ORDER BY block_idx)) AS digest FROM {blocks} GROUP BY page_id"


# Stored evidence of some pages: of an earlier reading, with another status, with another answer, or none.
_EVIDENCE = f"""WITH {_PAIRS}, l AS ({_reading("blocks_a")}), r AS ({_reading("blocks_b")}), w AS ({_reading("blocks_a", "CASE WHEN page_id % 11 = 1 AND block_idx = 0 THEN text || '*' ELSE text END")}),
c AS (SELECT page_id, string_agg(line, ',' ORDER BY line) AS found FROM (SELECT page_id, reason || ':' || coalesce(left_idx::VARCHAR, '') || ':' || coalesce(right_idx::VARCHAR, '') AS line FROM conflicts_of) GROUP BY page_id),
n AS (SELECT page_id, status, coalesce({_REASON}, '') AS reason, coalesce(found, '') AS found, sha256(concat_ws('|', page_id, l.digest, coalesce(r.digest, ''))) AS observations, sha256(concat_ws('|', page_id, w.digest, coalesce(r.digest, ''))) AS earlier
  FROM classes_of JOIN l USING (page_id) JOIN w USING (page_id) LEFT JOIN r USING (page_id) LEFT JOIN c USING (page_id)),
e AS (SELECT *, sha256(concat_ws('|', observations, status, reason, found)) AS alignment, sha256(concat_ws('|', observations, CASE WHEN page_id % 11 = 2 THEN 'consistent' ELSE status END, reason, found)) AS forged FROM n),
f AS (SELECT *, 'accept ' || substr(sha256('decision' || alignment), 1, 8) AS answer FROM e)
SELECT page_id, CASE WHEN page_id % 11 = 4 THEN 'missing' WHEN observations <> earlier THEN 'observations' WHEN alignment <> forged THEN 'alignment' WHEN page_id % 11 = 3 THEN 'decision' ELSE '' END AS broken,
  answer, sha256(concat_ws('|', alignment, answer)) AS decision FROM f"""


def adjudicator(key: str, rows: DataFrame) -> DataFrame:
    """The deterministic stand-in for a model that decides a page."""
    return rows.withColumn("answer", F.concat(F.lit("accept "), F.substring(F.sha2(F.concat(F.lit(key), "alignment"), 256), 1, 8)))


@query("val_evidence_chain", _EVIDENCE)
def _(t: Tables) -> DataFrame:
    page = F.col("page_id") % 11
    before = t.blocks_a.withColumn("text", F.when((page == 1) & (F.col("block_idx") == 0), F.concat("text", F.lit("*"))).otherwise(F.col("text")))
    stored = ev.decided(ev.aligned(before, t.blocks_b, 0.05), adjudicator).where(page != 4)
    forged = stored.withColumn("status", F.when(page == 2, "consistent").otherwise(F.col("status"))).withColumn("answer", F.when(page == 3, "accept").otherwise(F.col("answer")))
    return ev.resumed(forged, t.blocks_a, t.blocks_b, 0.05, adjudicator).select("page_id", "broken", "answer", "decision")


@query("fn_formula_value", r"SELECT page_id, block_idx, md5(replace(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), ' ', '')) AS digest FROM blocks_a")
def _(t: Tables) -> DataFrame:
    return t.blocks_a.select("page_id", "block_idx", F.md5(x.compared(F.col("text"))).alias("digest"))


_GRID = """array_to_string(list_transform("table", lambda w, i: array_to_string(list_transform(w, lambda z, j: (i - 1) || chr(31) || (j - 1) || chr(31) || z), chr(30))), chr(30))"""


@query("fn_table_value", f"""SELECT page_id, block_idx, 'left' AS side, md5({_GRID}) AS digest FROM blocks_a WHERE type = 'table' UNION ALL SELECT page_id, block_idx, 'right', md5({_GRID}) FROM blocks_b WHERE type = 'table'""")
def _(t: Tables) -> DataFrame:
    value = lambda blocks, side: blocks.where("type = 'table'").select("page_id", "block_idx", F.lit(side).alias("side"), F.md5(tb.content(F.col("table"))).alias("digest"))
    return value(t.blocks_a, "left").union(value(t.blocks_b, "right"))


@query("flt_eligible_pages", "SELECT task_id, status = 'COMPLETED' AND task_id % 7 <> 0 AS accepted FROM tasks")
def _(t: Tables) -> DataFrame:
    rules = {"status": F.col("status") == "COMPLETED", "evidence": F.col("task_id") % 7 != 0}
    out = v.checked(t.tasks, rules)
    return v.accepted(out).select("task_id", F.lit(True).alias("accepted")).union(v.quarantined(out).select("task_id", F.lit(False)))


# Chapter trees -------------------------------------------------------------------------------------

_NUM = r"(?:第\s*[一二三四五六七八九十百千万零〇两\d]+\s*章|chapter\s+[A-Za-z0-9.-]+|\d+(?:\.\d+)*)"
_TOC = rf"(?i)^({_NUM})\s+(.+?)\s*(?:\.{{2,}}|…+|\s{{2,}})\s*(\d{{1,4}})\s*$"
_HEAD = rf"(?i)^({_NUM})\s*(.+?)\s*$"


def _sql_title(pattern: str) -> str:
    return f"trim(regexp_replace(regexp_extract(line, '{pattern}', 2), '\\s+', ' ', 'g'), ' .…')"


_KEY = "regexp_replace(lower(replace(number, ' ', '')), '^chapter', '')"
_TREE = rf"""toc_rows AS (SELECT *, {_KEY} AS key FROM (SELECT source_id, page, line_no, regexp_extract(line, '{_TOC}', 1) AS number, {_sql_title(_TOC)} AS title, regexp_extract(line, '{_TOC}', 3)::INT AS printed_page FROM page_lines WHERE regexp_matches(line, '{_TOC}'))),
body_rows AS (SELECT *, {_KEY} AS key FROM (SELECT source_id, page, line_no, regexp_extract(line, '{_HEAD}', 1) AS number, {_sql_title(_HEAD)} AS title FROM page_lines WHERE NOT regexp_matches(line, '{_TOC}') AND regexp_matches(line, '{_HEAD}'))),
b AS (SELECT source_id, key, min({{'p': page, 'l': line_no, 'n': number, 't': title}}) AS f, count(DISTINCT page) AS pages, count(*) AS n FROM body_rows GROUP BY ALL),
t AS (SELECT source_id, key, min({{'p': page, 'l': line_no, 'n': number, 't': title}}) AS f, count(DISTINCT printed_page) AS pages, min(printed_page) AS toc_page FROM toc_rows GROUP BY ALL),
e AS (SELECT source_id, key, coalesce(b.f.n, t.f.n) AS number, coalesce(b.f.t, t.f.t) AS title, toc_page, b.f.p AS page_start, coalesce(b.pages, 0) > 1 OR coalesce(t.pages, 0) > 1 AS d, b.f IS NULL AS nb, t.f IS NULL AS nt, coalesce(b.n, 0) > 1 AS rep FROM b FULL JOIN t USING (source_id, key)),
g AS (SELECT *, 'chapter-' || substr(sha256(key || chr(0) || title), 1, 24) AS id, greatest(len(regexp_extract_all(key, '\d+')), 1) AS level, coalesce(page_start, 1000000000) AS place, list_transform(regexp_extract_all(key, '\d+'), lambda y: y::INT) AS sk,
  CASE WHEN NOT nb AND NOT nt AND NOT d THEN 0.95 WHEN NOT nb THEN 0.72 ELSE 0.35 END::DOUBLE AS confidence, rep OR count(*) OVER (PARTITION BY source_id, lower(title)) > 1 AS repeated,
  (SELECT max(page) FROM page_lines l WHERE l.source_id = e.source_id) AS last_page FROM e),
n AS (SELECT *, first_value(page_start IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY place, sk, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx, row_number() OVER (PARTITION BY source_id ORDER BY place, sk, id) AS rn FROM g),
o AS (SELECT *, coalesce(nx <= page_start, false) AS clash, CASE WHEN page_start IS NULL THEN NULL WHEN nx <= page_start THEN page_start WHEN nx IS NOT NULL THEN nx - 1 ELSE last_page END AS own_end FROM n),
q AS (SELECT *, d OR nb OR nt OR repeated OR bool_or(repeated) OVER (PARTITION BY source_id) OR bool_or(clash) OVER (PARTITION BY source_id ORDER BY rn) OR count(toc_page) OVER (PARTITION BY source_id) = 0 AS needs_confirmation,
  CASE WHEN level > 1 THEN last_value(CASE WHEN level = 1 THEN id END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent_id FROM o),
tree AS (SELECT source_id, id, parent_id, key, number, title, level, toc_page, page_start, CASE WHEN page_start IS NOT NULL THEN coalesce((SELECT max(k.own_end) FROM q k WHERE k.source_id = q.source_id AND k.parent_id = q.id), own_end) END AS page_end, confidence, needs_confirmation FROM q)"""


@query("fn_toc_candidates", f"WITH {_TREE} SELECT source_id, page, line_no, number, title, key, printed_page FROM toc_rows")
def _(t: Tables) -> DataFrame:
    return c.contents_entries(t.page_lines).select("source_id", "page", "line_no", "number", "title", "key", "printed_page")


@query("fn_body_candidates", f"WITH {_TREE} SELECT source_id, page, line_no, number, title, key FROM body_rows")
def _(t: Tables) -> DataFrame:
    return c.headings(t.page_lines).select("source_id", "page", "line_no", "number", "title", "key")


@query("join_toc_body", f"WITH {_TREE} SELECT source_id, key, title, toc_page, page_start, confidence FROM g")
def _(t: Tables) -> DataFrame:
    found = c.merged_entries(c.contents_entries(t.page_lines), c.headings(t.page_lines))
    return found.select("source_id", "key", "title", "toc_page", "page_start", "confidence")


@query("pipe_chapter_tree", f"WITH {_TREE} SELECT * FROM tree")
def _(t: Tables) -> DataFrame:
    return c.chapter_tree(t.page_lines)


@query("win_page_end", f"WITH {_TREE} SELECT source_id, id, page_start, page_end FROM tree WHERE level > 1")
def _(t: Tables) -> DataFrame:
    return c.chapter_tree(t.page_lines).where("level > 1").select("source_id", "id", "page_start", "page_end")


@query("win_tree_parent", f"WITH {_TREE} SELECT source_id, id, parent_id FROM tree")
def _(t: Tables) -> DataFrame:
    return c.chapter_tree(t.page_lines).select("source_id", "id", "parent_id")


@query("win_subtree_end", f"WITH {_TREE} SELECT source_id, id, page_end FROM tree WHERE level = 1")
def _(t: Tables) -> DataFrame:
    return c.chapter_tree(t.page_lines).where("level = 1").select("source_id", "id", "page_end")


@query("join_page_to_chapter", f"WITH {_TREE} SELECT DISTINCT tree.source_id, l.page, tree.id, tree.level FROM tree JOIN page_lines l ON l.source_id = tree.source_id AND l.page BETWEEN tree.page_start AND tree.page_end")
def _(t: Tables) -> DataFrame:
    return c.pages_of_chapters(c.chapter_tree(t.page_lines)).withColumn("level", F.col("level").cast("long"))


@query("val_chapter_tree", f"WITH {_TREE} SELECT id, source_id, CASE WHEN page_end < page_start THEN 'bounds' ELSE '' END AS violations FROM tree")
def _(t: Tables) -> DataFrame:
    tree = c.chapter_tree(t.page_lines)
    rules = {
        "bounds": F.col("page_start").isNull() | (F.col("page_end") >= F.col("page_start")),
        "level": F.col("level").between(1, 32),
        "title": F.length("title").between(1, 512),
    }
    return v.checked(tree, rules).select("id", "source_id", "violations")


@query("val_chapter_confirmation", f"WITH {_TREE} SELECT source_id, id, CASE WHEN page_start % 3 = 0 THEN 'page_start' ELSE '' END AS violations FROM tree")
def _(t: Tables) -> DataFrame:
    tree = c.chapter_tree(t.page_lines)
    asked = tree.select("source_id", "id", F.when(F.col("page_start") % 3 == 0, F.col("page_start") + 1).otherwise(F.col("page_start")).alias("asked"), F.col("number").alias("asked_number"))
    met = tree.join(asked, ["source_id", "id"])
    rules = {"page_start": F.col("asked").eqNullSafe(F.col("page_start")), "number": F.col("asked_number").eqNullSafe(F.col("number"))}
    return v.checked(met, rules).select("source_id", "id", "violations")


@query("pipe_note_skeleton", f"WITH {_TREE} SELECT tree.source_id, tree.id, '# ' || any_value(tree.title) || chr(10) || string_agg('- [p' || l.page || ':' || l.line_no || '] ' || l.line, chr(10) ORDER BY l.page, l.line_no, l.line) AS note FROM tree JOIN page_lines l ON l.source_id = tree.source_id AND l.page BETWEEN tree.page_start AND tree.page_end GROUP BY tree.source_id, tree.id")
def _(t: Tables) -> DataFrame:
    return pipe.note_skeleton(c.chapter_tree(t.page_lines), t.page_lines)


# Validation ----------------------------------------------------------------------------------------


@query("val_blocks", "SELECT page_id, block_idx, concat_ws(',', CASE WHEN NOT (y + height <= 1.0 + 1e-9) THEN 'box' END, CASE WHEN length(text) > 4096 THEN 'text' END, CASE WHEN type NOT IN ('paragraph', 'table') THEN 'type' END) AS violations FROM blocks_b")
def _(t: Tables) -> DataFrame:
    rules = v.box_rules() | {"text": F.length("text") <= 4096, "type": F.col("type").isin("paragraph", "table"), "order": F.col("reading_order") >= 0}
    return v.checked(t.blocks_b, rules).select("page_id", "block_idx", "violations")


@query("val_observations", "SELECT page_id, count(*) AS n, count(*) <= 256 AND count(*) = count(DISTINCT {'t': text, 'k': type}) AS valid FROM blocks_a GROUP BY page_id")
def _(t: Tables) -> DataFrame:
    each = t.blocks_a.groupBy("page_id", F.to_json(F.struct("text", "type")).alias("body")).agg(F.count(F.lit(1)).alias("k"))
    return each.groupBy("page_id").agg(F.sum("k").alias("n"), ((F.sum("k") <= 256) & (F.max("k") == 1)).alias("valid"))


@query("val_conflict_resolutions", f"WITH {_PAIRS} SELECT page_id, reason, left_idx, right_idx, CASE WHEN left_idx IS NULL OR right_idx IS NULL THEN 'evidence' ELSE '' END AS violations FROM conflicts_of")
def _(t: Tables) -> DataFrame:
    found = p.conflicts(t.blocks_a, t.blocks_b, pairs(t))
    return v.checked(found, {"evidence": F.col("left_idx").isNotNull() & F.col("right_idx").isNotNull()})


@query("val_decision", "SELECT run_id, concat_ws(',', CASE WHEN status <> 'DONE' THEN 'status' END, CASE WHEN finished_at <= created_at THEN 'times' END, CASE WHEN NOT starts_with(input_fingerprint, 'in1') THEN 'fingerprint' END) AS violations FROM runs")
def _(t: Tables) -> DataFrame:
    rules = {"status": F.col("status") == "DONE", "times": F.col("finished_at") > F.col("created_at"), "fingerprint": F.col("input_fingerprint").startswith("in1")}
    return v.checked(t.runs, rules).select("run_id", "violations")



# A chapter's notes in order give the lines of its diagram: subgraphs, ends, edges, nodes, comments and a few bad ones.
_GRAPH_LINE = """CASE WHEN note_id % 53 = 5 THEN '???' WHEN version % 7 < 2 THEN 'subgraph S' || seq WHEN version % 7 < 4 THEN 'end'
  WHEN version % 7 = 4 THEN 'A[' || content || '] --> B' WHEN version % 7 = 5 THEN 'B -->|next| C' ELSE '%% ' || content END"""


@query("val_diagrams", f"""WITH l AS (SELECT *, {_GRAPH_LINE} AS line FROM note_blocks),
    d AS (SELECT *, sum(CASE WHEN starts_with(line, 'subgraph') THEN 1 WHEN line = 'end' THEN -1 ELSE 0 END) OVER (PARTITION BY chapter_id ORDER BY seq, note_id) AS depth,
      row_number() OVER (PARTITION BY chapter_id ORDER BY seq DESC, note_id DESC) = 1 AS final FROM l)
    SELECT chapter_id, count(*) FILTER (contains(line, '-->'))::INT AS n_edges, greatest(max(depth), 0)::INT AS depth,
      min(depth) >= 0 AND max(depth) FILTER (final) = 0 AND bool_or(contains(line, '-->')) AND NOT bool_or(line = '???') AS valid,
      bool_and(contains(line, '] -->')) AS note_valid FROM d GROUP BY chapter_id""")
def _(t: Tables) -> DataFrame:
    lines = t.note_blocks.withColumn("line", F.expr(_GRAPH_LINE))
    text = F.concat(F.lit("graph TD\n"), r.ordered_list(["seq", "note_id"], "line", "\n"))
    graphs = lines.groupBy("chapter_id").agg(text.alias("text")).select("chapter_id", d.topic_diagram(F.col("text")).alias("g"), d.note_diagram(F.col("text")).alias("note_valid"))
    return graphs.select("chapter_id", F.col("g.edges").alias("n_edges"), "g.depth", "g.valid", "note_valid")


_NOTE = "SELECT chapter_id, count(*) AS n_blocks, count(DISTINCT kind) AS n_kinds, count(*) FILTER (kind = 'diagram') AS n_diagrams FROM note_blocks GROUP BY chapter_id"


def note_counts(t: Tables) -> DataFrame:
    return t.note_blocks.groupBy("chapter_id").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.countDistinct("kind").alias("n_kinds"), F.count_if(F.col("kind") == "diagram").alias("n_diagrams")
    )


@query("val_topic_outline", "SELECT topic_id, concat_ws(',', CASE WHEN length(title) > 10 THEN 'title' END, CASE WHEN NOT EXISTS (SELECT 1 FROM topic_chapters l JOIN chapters c USING (chapter_id) WHERE l.topic_id = topics.topic_id AND c.course_id = topics.course_id) THEN 'coverage' END) AS violations FROM topics")
def _(t: Tables) -> DataFrame:
    own = t.topic_chapters.join(t.chapters.select("chapter_id", "course_id"), "chapter_id").select("topic_id", "course_id").distinct()
    met = t.topics.join(own.withColumn("covered", F.lit(True)), ["topic_id", "course_id"], "left")
    return v.checked(met, {"title": F.length("title") <= 10, "coverage": F.col("covered")}).select("topic_id", "violations")


@query("val_chapter_review", "SELECT chapter_id, concat_ws(',', CASE WHEN status <> 'DONE' THEN 'passed' END, CASE WHEN (SELECT count(DISTINCT kind) FROM note_blocks n WHERE n.chapter_id = reviews.chapter_id) <> 7 THEN 'kinds' END) AS violations FROM reviews")
def _(t: Tables) -> DataFrame:
    body = F.to_json(F.struct((F.col("status") == "DONE").alias("passed")))
    kinds = t.note_blocks.groupBy("chapter_id").agg(F.collect_set("kind").alias("kinds"))
    met = t.reviews.withColumn("contract", F.from_json(body, "passed boolean")).join(kinds, "chapter_id", "left")
    wanted = F.array(*[F.lit(k) for k in KINDS])
    rules = {"passed": F.col("contract.passed"), "kinds": F.size(F.array_except(wanted, F.coalesce("kinds", F.array().cast("array<string>")))) == 0}
    return v.checked(met, rules).select("chapter_id", "violations")


@query("val_publication_gate", f"SELECT c.chapter_id, concat_ws(',', CASE WHEN c.status = 'DRAFT' THEN 'status' END, CASE WHEN v.status <> 'DONE' OR v.stale THEN 'review' END, CASE WHEN coalesce(n.n_blocks, 0) = 0 THEN 'notes' END) AS violations FROM chapters c JOIN reviews v USING (chapter_id) LEFT JOIN ({_NOTE}) n USING (chapter_id)")
def _(t: Tables) -> DataFrame:
    review = t.reviews.select("chapter_id", ((F.col("status") == "DONE") & ~F.col("stale")).alias("reviewed"))
    met = t.chapters.join(review, "chapter_id").join(note_counts(t), "chapter_id", "left")
    rules = {"status": F.col("status") != "DRAFT", "review": F.col("reviewed"), "notes": F.col("n_blocks") > 0}
    return v.checked(met, rules).select("chapter_id", "violations")


# Changes -------------------------------------------------------------------------------------------

_LAST = "SELECT chapter_id, kind, arg_max(note_id, {'v': version, 'n': note_id}) AS note_id FROM note_blocks WHERE version % 2 = 1 GROUP BY chapter_id, kind"
_OLD = "SELECT chapter_id, kind, min(note_id) AS note_id FROM note_blocks WHERE version % 2 = 0 GROUP BY chapter_id, kind"


def notes_old_new(t: Tables) -> tuple[DataFrame, DataFrame]:
    old = t.note_blocks.where("version % 2 = 0").groupBy("chapter_id", "kind").agg(F.min("note_id").alias("note_id"))
    new = m.last_per_key(t.note_blocks.where("version % 2 = 1"), ["chapter_id", "kind"], ["version", "note_id"]).select("chapter_id", "kind", "note_id")
    return old, new


@query("mut_upsert", f"WITH o AS ({_OLD}), w AS ({_LAST}) SELECT chapter_id, kind, coalesce(w.note_id, o.note_id) AS note_id FROM o FULL JOIN w USING (chapter_id, kind)")
def _(t: Tables) -> DataFrame:
    return m.upsert(*notes_old_new(t), ["chapter_id", "kind"])


@query("mut_append", """SELECT topic_id, 'in table' AS outcome FROM topics JOIN courses USING (course_id) WHERE status = 'PUBLISHED' OR favourite
    UNION ALL SELECT topic_id, CASE WHEN status = 'PUBLISHED' THEN 'exists' ELSE 'no parent' END FROM topics JOIN courses USING (course_id) WHERE status = 'PUBLISHED' OR NOT favourite""")
def _(t: Tables) -> DataFrame:
    cols = ("topic_id", "course_id")
    table, rejected = m.append(t.topics.where("status = 'PUBLISHED'").select(*cols), t.topics.select(*cols), "topic_id", t.courses.where("favourite"), "course_id")
    return table.select("topic_id", F.lit("in table").alias("outcome")).union(rejected.select("topic_id", "reason"))


@query("mut_patch", "SELECT topic_id, CASE WHEN topic_id % 3 = 0 THEN 'new ' || title ELSE title END AS title, CASE WHEN topic_id % 6 = 0 THEN 'READY' ELSE status END AS status FROM topics")
def _(t: Tables) -> DataFrame:
    k = F.col("topic_id")
    edits = t.topics.where(k % 3 == 0).select("topic_id", F.concat(F.lit("new "), "title").alias("title"), F.when(k % 6 == 0, "READY").alias("status"))
    return m.patch(t.topics, edits, "topic_id").select("topic_id", "title", "status")


@query("mut_status_transition", 'SELECT topic_id, status, CASE WHEN topic_id % 2 = 0 THEN \'RUNNING\' ELSE \'PUBLISHED\' END AS "to", (status = \'READY\' AND topic_id % 2 = 0) OR (status = \'RUNNING\' AND topic_id % 2 = 1) OR (status = \'STALE\' AND topic_id % 2 = 0) AS accepted FROM topics')
def _(t: Tables) -> DataFrame:
    legal = t.spark.createDataFrame([("READY", "RUNNING"), ("RUNNING", "PUBLISHED"), ("STALE", "RUNNING")], "status string, to string")
    asked = t.topics.select("topic_id", F.when(F.col("topic_id") % 2 == 0, "RUNNING").otherwise("PUBLISHED").alias("to"))
    return m.transition(t.topics, asked, "topic_id", legal).select("topic_id", "status", "to", "accepted")


@query("mut_confirm_topics", "SELECT t.topic_id, t.confirmed OR g.ok AS confirmed FROM topics t JOIN (SELECT course_id, bool_and(EXISTS (SELECT 1 FROM topic_chapters l JOIN chapters c USING (chapter_id) WHERE l.topic_id = topics.topic_id AND c.course_id = topics.course_id)) AS ok FROM topics GROUP BY course_id) g USING (course_id)")
def _(t: Tables) -> DataFrame:
    own = t.topic_chapters.join(t.chapters.select("chapter_id", "course_id"), "chapter_id").select("topic_id", "course_id").distinct().withColumn("mapped", F.lit(True))
    met = t.topics.join(own, ["topic_id", "course_id"], "left")
    fair = met.groupBy("course_id").agg(F.bool_and(F.coalesce("mapped", F.lit(False))).alias("ok"))
    return t.topics.join(fair, "course_id").select("topic_id", (F.col("confirmed") | F.col("ok")).alias("confirmed"))


@query("mut_guarded_delete", "SELECT topic_id, status FROM topics WHERE NOT (topic_id % 2 = 0 AND status NOT IN ('RUNNING', 'PUBLISHED'))")
def _(t: Tables) -> DataFrame:
    return m.delete_unless(t.topics, t.topics.where("topic_id % 2 = 0"), "topic_id", F.col("status").isin("RUNNING", "PUBLISHED")).select("topic_id", "status")


@query("mut_replace_group", "SELECT topic_id, chapter_id FROM topic_chapters WHERE topic_id % 3 <> 0 UNION ALL SELECT topic_id, -topic_id FROM topics WHERE topic_id % 3 = 0")
def _(t: Tables) -> DataFrame:
    new = t.topics.where("topic_id % 3 = 0").select("topic_id", (-F.col("topic_id")).alias("chapter_id"))
    return m.replace_group(t.topic_chapters, new, "topic_id")


@query("mut_compare_and_set", "SELECT topic_id, topic_id % 2 = 0 AS applied, CASE WHEN topic_id % 2 = 0 THEN greatest(500, updated_at + 1) ELSE updated_at END AS updated_at, CASE WHEN topic_id % 2 = 0 THEN 'edited' ELSE title END AS title FROM topics")
def _(t: Tables) -> DataFrame:
    edits = t.topics.select("topic_id", F.when(F.col("topic_id") % 2 == 0, F.col("updated_at")).otherwise(F.lit(-1)).alias("expected"), F.lit("edited").alias("title"))
    return m.compare_and_set(t.topics, edits, "topic_id", "updated_at", "title", 500)


_PRINT = "SELECT source_id, sha256(string_agg(concat_ws('~', seq::VARCHAR, title), ';' ORDER BY seq)) AS fingerprint FROM chapters GROUP BY source_id"


def chapter_print(t: Tables) -> DataFrame:
    return r.snapshot(t.chapters, "source_id", ["seq"], ["seq", "title"]).select("source_id", "fingerprint")


@query("mut_replace_drafts", f"WITH p AS ({_PRINT}) SELECT c.source_id, CASE WHEN c.source_id % 2 = 0 THEN 'draft ' || c.title ELSE c.title END AS title, c.seq FROM chapters c JOIN p USING (source_id)")
def _(t: Tables) -> DataFrame:
    now = chapter_print(t)
    guard = now.withColumn("expected", F.when(F.col("source_id") % 2 == 0, F.col("fingerprint")).otherwise(F.lit("other"))).where("expected = fingerprint")
    drafts = t.chapters.join(guard, "source_id", "left_semi").select("source_id", F.concat(F.lit("draft "), "title").alias("title"), "seq")
    return m.replace_group(t.chapters.select("source_id", "title", "seq"), drafts, "source_id")


@query("mut_confirm_drafts", """WITH c AS (SELECT chapter_id, source_id, seq, title, CASE WHEN source_id % 2 = 0 THEN 'DRAFT' ELSE status END AS status FROM chapters),
    p AS (SELECT source_id, string_agg(concat_ws('~', seq::VARCHAR, title), ';' ORDER BY seq) AS frozen, bool_and(status = 'DRAFT') AS drafts FROM c GROUP BY source_id)
    SELECT chapter_id, CASE WHEN ok THEN 'CONFIRMED' ELSE status END AS status, CASE WHEN ok THEN frozen END AS confirmed_snapshot
    FROM (SELECT c.chapter_id, c.status, p.frozen, p.drafts AND c.source_id % 3 <> 0 AS ok FROM c JOIN p USING (source_id))""")
def _(t: Tables) -> DataFrame:
    redrafted = F.when(F.col("source_id") % 2 == 0, "DRAFT").otherwise(F.col("status"))
    chapters = t.chapters.withColumn("status", redrafted)
    now = r.snapshot(chapters, "source_id", ["seq"], ["seq", "title"])
    expected = now.select("source_id", F.when(F.col("source_id") % 3 != 0, F.col("fingerprint")).otherwise("outdated").alias("expected"))
    return m.confirm_drafts(chapters, now, expected, "source_id").select("chapter_id", "status", "confirmed_snapshot")


_TARGET = "10000000 + CASE WHEN topic_id // 50 % 4 = 3 THEN topic_id - topic_id % 2 ELSE topic_id - topic_id % 50 + topic_id % 25 END"


def topic_sizes(topics: DataFrame, links: DataFrame) -> DataFrame:
    size = links.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_chapters"))
    return topics.join(size, "topic_id", "left").select("topic_id", "course_id", "status", "confirmed", F.coalesce("n_chapters", F.lit(0)).cast("long").alias("n_chapters"))


@query("mut_merge_topics", f"""WITH g AS (SELECT *, {_TARGET} AS merged_id FROM topics),
    d AS (SELECT merged_id, min(course_id) AS course_id FROM g GROUP BY merged_id HAVING count(*) >= 2 AND count(DISTINCT course_id) = 1
      AND NOT bool_or(status = 'RUNNING') AND NOT bool_or(topic_id IN (SELECT topic_id FROM topic_notes)) AND bool_or(topic_id IN (SELECT topic_id FROM topic_chapters)))
    SELECT topic_id, course_id, status, confirmed, (SELECT count(*) FROM topic_chapters l WHERE l.topic_id = g.topic_id) AS n_chapters FROM g WHERE merged_id NOT IN (SELECT merged_id FROM d)
    UNION ALL SELECT merged_id, course_id, 'DRAFT', false, (SELECT count(DISTINCT chapter_id) FROM topic_chapters l JOIN g USING (topic_id) WHERE g.merged_id = d.merged_id) FROM d""")
def _(t: Tables) -> DataFrame:
    k = F.col("topic_id")
    target = F.when(F.floor(k / 50) % 4 == 3, k - k % 2).otherwise(k - k % 50 + k % 25) + 10000000
    published = r.published(t.topics.select("topic_id"), t.topic_notes)
    topics, links, _ = m.merge_topics(t.topics, t.topic_chapters, published, t.topics.select("topic_id", target.alias("merged_id")))
    return topic_sizes(topics, links)


@query("mut_split_topic", """WITH w AS (SELECT topic_id, chapter_id FROM topic_chapters WHERE chapter_id % 4 = 0 UNION ALL SELECT topic_id, -1 FROM topics WHERE topic_id % 7 = 0),
    d AS (SELECT t.topic_id, t.course_id, t.topic_id IN (SELECT topic_id FROM topic_notes) AS published FROM topics t WHERE t.status <> 'RUNNING'
      AND EXISTS (SELECT 1 FROM w WHERE w.topic_id = t.topic_id) AND NOT EXISTS (SELECT 1 FROM w WHERE w.topic_id = t.topic_id AND w.chapter_id = -1)
      AND EXISTS (SELECT 1 FROM topic_chapters l WHERE l.topic_id = t.topic_id AND l.chapter_id % 4 <> 0)),
    s AS (SELECT topic_id, count(*) AS n, count(*) FILTER (chapter_id % 4 = 0) AS cut FROM topic_chapters GROUP BY topic_id)
    SELECT t.topic_id, t.course_id, CASE WHEN d.published THEN 'STALE' WHEN d.topic_id IS NOT NULL THEN 'DRAFT' ELSE t.status END AS status,
      t.confirmed AND (d.topic_id IS NULL OR d.published) AS confirmed, CASE WHEN d.topic_id IS NULL THEN coalesce(n, 0) ELSE n - cut END AS n_chapters
    FROM topics t LEFT JOIN d USING (topic_id) LEFT JOIN s USING (topic_id)
    UNION ALL SELECT topic_id + 10000000, course_id, 'DRAFT', false, cut FROM d JOIN s USING (topic_id)""")
def _(t: Tables) -> DataFrame:
    foreign = t.topics.where("topic_id % 7 = 0").select("topic_id", F.lit(-1).cast("long").alias("chapter_id"))
    wanted = t.topic_chapters.where("chapter_id % 4 = 0").select("topic_id", "chapter_id").union(foreign).withColumn("new_id", F.col("topic_id") + 10000000)
    published = r.published(t.topics.select("topic_id"), t.topic_notes)
    topics, links, _ = m.split_topics(t.topics, t.topic_chapters, published, wanted)
    return topic_sizes(topics, links)


@query("mut_reorder", "SELECT source_id, chapter_id, CASE WHEN source_id % 2 = 0 THEN count(*) OVER (PARTITION BY source_id) - 1 - seq ELSE seq END AS seq, source_id % 2 = 0 OR count(*) OVER (PARTITION BY source_id) = 1 AS accepted FROM chapters")
def _(t: Tables) -> DataFrame:
    n = t.chapters.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    back = t.chapters.join(n, "source_id").select("source_id", "chapter_id", F.when(F.col("source_id") % 2 == 0, F.col("n") - 1 - F.col("seq")).otherwise(F.lit(0)).alias("seq"))
    return m.reorder(t.chapters, back, "source_id", "chapter_id").withColumn("seq", F.col("seq").cast("long"))


@query("mut_cascade_delete", "SELECT 'chapters' AS kind, chapter_id AS id FROM chapters WHERE source_id % 5 <> 0 UNION ALL SELECT 'notes', note_id FROM note_blocks n WHERE NOT EXISTS (SELECT 1 FROM chapters c WHERE c.chapter_id = n.chapter_id AND c.source_id % 5 = 0)")
def _(t: Tables) -> DataFrame:
    gone = t.chapters.where("source_id % 5 = 0")
    left = m.cascade_delete(t.chapters, {"notes": (t.note_blocks, "chapter_id")}, gone, "chapter_id")
    return left["parents"].select(F.lit("chapters").alias("kind"), F.col("chapter_id").alias("id")).union(left["notes"].select(F.lit("notes"), "note_id"))


@query("mut_propagate_stale", f"""WITH h AS (SELECT topic_id, string_agg('chapter ' || chapter_id, chr(10) ORDER BY chapter_id) AS hit FROM topic_chapters WHERE chapter_id IN (SELECT chapter_id FROM reviews WHERE stale) GROUP BY topic_id)
    SELECT topic_id, CASE WHEN status = 'RUNNING' THEN 'RUNNING' WHEN published THEN 'STALE' ELSE readiness END AS status,
      CASE WHEN status = 'RUNNING' OR published THEN concat_ws(chr(10), CASE WHEN topic_id % 5 = 0 THEN 'earlier' END, hit) ELSE '' END AS reasons
    FROM (SELECT *, topic_id IN (SELECT topic_id FROM topic_notes) AS published FROM ({_READY})) JOIN h USING (topic_id)""")
def _(t: Tables) -> DataFrame:
    published = r.published(t.topics.select("topic_id"), t.topic_notes)
    topics = t.topics.withColumn("stale_reason", F.when(F.col("topic_id") % 5 == 0, "earlier"))
    return m.propagate_stale(topics, t.topic_chapters, t.reviews.where("stale"), published, r.readiness(t.topics, reviewed(t)))


@query("mut_refresh_status", f"SELECT topic_id, CASE WHEN status IN ('DRAFT', 'NOT_READY', 'READY') THEN readiness ELSE status END AS status FROM ({_READY})")
def _(t: Tables) -> DataFrame:
    now = r.readiness(t.topics, reviewed(t))
    return now.select("topic_id", F.when(F.col("status").isin("DRAFT", "NOT_READY", "READY"), F.col("readiness")).otherwise(F.col("status")).alias("status"))


@query("mut_expire_runs", "SELECT run_id, CASE WHEN status = 'RUNNING' AND heartbeat_at + 600 <= 1500 THEN CASE WHEN chapter_id % 2 = 0 THEN 'STALE' ELSE 'FAILED' END ELSE status END AS status, CASE WHEN status = 'RUNNING' AND heartbeat_at + 600 <= 1500 THEN 'interrupted' END AS error FROM runs")
def _(t: Tables) -> DataFrame:
    return m.expire_runs(t.runs, t.chapters.where("chapter_id % 2 = 0"), 1500, 600)


@query("C1_conform_to_schema", "SELECT course_id, name, 'zh' AS language, 0::BIGINT AS updated_at FROM courses")
def _(t: Tables) -> DataFrame:
    columns = {"course_id": ("int", None), "name": ("string", ""), "language": ("string", "zh"), "updated_at": ("long", 0)}
    return m.conform(t.courses, columns, version=2, known=2)


# Streams -------------------------------------------------------------------------------------------


def live(t: Tables) -> DataFrame:
    raw = st.event_stream(t.spark, f"{t.sf_dir}/events.parquet*", t.events.schema)
    kind = F.when(F.col("event_type") == "click", "TOKEN").when(F.col("event_type") == "error", "ERROR").otherwise("TASK_STATE")
    says = (
        F.when(F.col("event_type") == "view", "PARSING").when(F.col("event_type") == "signup", "RUNNING")
        .when(F.col("event_type") == "purchase", "COMPLETED").when(F.col("event_type") == "error", "FAILED").otherwise(F.col("props"))
    )
    return raw.select(F.col("user_id").alias("batch_id"), "event_id", "ts", (F.col("event_id") % 40).alias("task_id"), kind.alias("event"), says.alias("payload"))


@query("st_event_append", "SELECT event_id, batch_id, seq FROM event_log")
def _(t: Tables) -> DataFrame:
    return st.numbered(live(t))


@query("st_latest_state", "SELECT batch_id, task_id, arg_max(payload, event_id) AS status FROM event_log WHERE event = 'TASK_STATE' GROUP BY batch_id, task_id")
def _(t: Tables) -> DataFrame:
    return st.to_table(st.latest_states(live(t)), "states", "complete")


@query("st_ring_buffer", "SELECT batch_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS event_ids FROM (SELECT batch_id, event_id FROM event_log QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY event_id DESC) <= 30) GROUP BY batch_id")
def _(t: Tables) -> DataFrame:
    seen = st.to_table(st.bounded(live(t), 30), "ring", "update")
    return seen.groupBy("batch_id").agg(F.max_by("event_ids", "last").alias("event_ids"))


@query("st_ttl_expiry", """WITH g AS (SELECT user_id AS batch_id, ts, lead(ts) OVER w AS following, ts - lag(ts) OVER w > INTERVAL 86400 SECOND AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY batch_id ORDER BY ts) AS life FROM g)
    SELECT batch_id, max(ts) AS last, least(count(*), 10)::INT AS n FROM s GROUP BY batch_id, life HAVING max(ts) + INTERVAL 86400 SECOND < (SELECT max(ts) FROM events)""")
def _(t: Tables) -> DataFrame:
    return st.to_table(st.expiries(live(t), keep=10, seconds=86400), "expiries")


@query("st_batch_done", "SELECT batch_id, count(*) AS done, 10 + batch_id % 5 AS total FROM event_log WHERE payload = 'COMPLETED' GROUP BY batch_id HAVING count(*) >= 10 + batch_id % 5")
def _(t: Tables) -> DataFrame:
    totals = t.events.select(F.col("user_id").alias("batch_id")).distinct().withColumn("total", 10 + F.col("batch_id") % 5)
    return st.to_table(st.finished(live(t), totals), "done", "complete")


@query("st_token_concat", """WITH e AS (SELECT user_id AS batch_id, event_id % 2 AS task_id, day(ts) // 10 AS section, event_id, event_type, props FROM events WHERE event_type IN ('click', 'purchase')),
    g AS (SELECT *, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY batch_id, task_id, section ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS part FROM e)
    SELECT batch_id, task_id, section, (count(*) FILTER (event_type = 'click'))::INT AS n_tokens, string_agg(props, '' ORDER BY event_id) FILTER (event_type = 'click') AS text
    FROM g GROUP BY batch_id, task_id, section, part HAVING bool_or(event_type = 'purchase') AND bool_or(event_type = 'click')""")
def _(t: Tables) -> DataFrame:
    section = F.floor(F.dayofmonth("ts") / 10).alias("section")
    tokens = live(t).where("event = 'TOKEN' or payload = 'COMPLETED'").select("batch_id", (F.col("event_id") % 2).alias("task_id"), section, "event_id", "event", "payload")
    return st.to_table(st.section_texts(tokens), "tokens")


@query("st_incremental_sections", f"WITH {_SECTIONS} SELECT DISTINCT sha256(raw) AS sha256 FROM sections WHERE doc_id LIKE 'd%'")
def _(t: Tables) -> DataFrame:
    return pipe.incremental_sections(st.table_stream(t.spark, f"{t.sf_dir}/documents.parquet"))


# Composites and routing ------------------------------------------------------------------------------


@query("udf_round_router", "SELECT run_id, CASE WHEN round_key IN ('round0', 'round1') THEN 'a' ELSE 'b' END AS executor FROM runs")
def _(t: Tables) -> DataFrame:
    return pipe.routed(t.runs).select("run_id", "executor")


def failing_at_first(name: str) -> Executor:
    """A stand-in for a model whose first two calls fail for some questions, and every call for a few."""
    calls: collections.Counter[str] = collections.Counter()

    def ask(key: str, rows: DataFrame) -> DataFrame:
        calls[key] += 1
        digest = F.sha2("asked", 256)
        fails = digest.startswith("00") | (digest < {1: "4", 2: "2"}.get(calls[key], "0"))
        said = F.concat_ws(":", F.lit(name), F.lit(key), F.substring(digest, 1, 8))
        return rows.withColumn("answer", F.when(~fails, said)).withColumn("error", F.when(fails, "TimeoutError"))

    return ask


@query("udf_round_executor", """WITH p AS (SELECT run_id, output, sha256('outline' || chr(10) || output) AS d FROM runs),
    a AS (SELECT *, CASE WHEN NOT starts_with(d, '00') THEN 'a:outline:' || d[1:8] END AS outline, CASE WHEN d >= '4' THEN 1 WHEN d >= '2' THEN 2 ELSE 3 END AS attempts FROM p),
    b AS (SELECT *, sha256('detail' || chr(10) || output || chr(10) || outline) AS e FROM a)
    SELECT run_id, CASE WHEN outline IS NULL THEN 'outline:answer' WHEN starts_with(e, '00') THEN 'detail:answer' ELSE '' END AS failed, outline,
      CASE WHEN NOT starts_with(e, '00') THEN 'b:detail:' || e[1:8] END AS detail, attempts FROM b""")
def _(t: Tables) -> DataFrame:
    ledger = Ledger(t.spark, attempts=3)
    executor = ledger.wrap(by_round({"outline": failing_at_first("a"), "detail": failing_at_first("b")}))
    work = t.runs.select(F.col("output").alias("prompt")).distinct()
    rules = {key: {"answer": F.col(key).isNotNull()} for key in ("outline", "detail")}
    state = run_rounds(work, ["outline", "detail"], executor, rules, {})
    asked = ledger.known("outline").select("digest", "attempts")
    met = state.withColumn("digest", F.sha2(F.concat_ws("\n", F.lit("outline"), "prompt"), 256)).join(asked, "digest").drop("digest")
    runs = t.runs.select("run_id", "output")
    return runs.join(met.hint("merge"), runs["output"].eqNullSafe(met["prompt"])).select("run_id", "failed", "outline", "detail", "attempts")
