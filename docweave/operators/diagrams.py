"""Diagrams as text: a fold over their lines that keeps what is open, for the dialect of topics and that of notes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.operators.validation import closes

#: Directions of a flow diagram, and how long one may be.
HEAD = r"(?:graph|flowchart)\s+(?:TB|TD|BT|RL|LR)"
LONGEST = 20_000

# A line is read as tokens: a label in brackets is \1, a link is \2, a name is \3.
_LABEL = r"\[[^\[\]<>]*\]|\([^()<>]*\)|\{[^{}<>]*\}"
_LINK = r"--?>\|[^|<>]+\||--\s+[^<>]+\s+-->|-->|---|-\.->|==>"
_NAME = r"[A-Za-z_][A-Za-z0-9_-]*"
_TOKENS = ((_LABEL, "\1"), (_LINK, "\2"), (_NAME, "\3"))
_NODE_LINE, _EDGE_LINE = "^\3\1?$", "^\3\1?\\s*\2\\s*\3\1?$"
_OPENS = rf"^subgraph\s+(?:{_NAME}(?:\[[^\[\]<>]+\])?|[^\[\](){{}}<>]+)$"
_VALUE = r"[A-Za-z0-9_#.,:%;()\s-]+"
_STYLE = rf"^(?:(?:classDef|style)\s+{_NAME}|linkStyle\s+(?:\d+|default)(?:,\d+)*)\s+{_VALUE}$|^class\s+{_NAME}(?:,{_NAME})*\s+{_NAME}$"
_ACTIVE = r"(?i)^click\s|https?://|<\s*/?\s*(?:script|iframe|object|embed|a)\b"
_MARKUP = r"(?is)<|javascript\s*:|on[a-z]+\s*=|%%\{|```"

# Lines of a note's diagrams.
_PLAIN = r"[A-Za-z][A-Za-z0-9_-]*(?:\[.*\]|\(\(.*\)\))?"
_PLAIN_EDGE = rf"^{_PLAIN}\s+(?:-->|---|-.->|==>)\s+{_PLAIN}(?:\s*:.*)?$"
_BRANCH = r"^ {2,}(?:[A-Za-z0-9_.-]+(?:\(\(.*\)\))?|[一-鿿].*)$"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _lines(text: Column) -> Column:
    return F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)


def _bracketed(text: Column) -> Column:
    """Whether brackets close in order outside of quotes; a backslash hides the next character."""
    shown = F.regexp_replace(text, r"(?s)\\.?", "")
    bare = F.regexp_replace(shown, "\"[^\"]*\"|'[^']*'", "")
    return ~bare.rlike("[\"']") & closes(F.regexp_replace(bare, r"[^\[\](){}]", ""))


def topic_diagram(text: Column) -> Column:
    """struct(valid, edges, depth) of a diagram in the dialect of topics.

    The first line is the head. After it come nodes, edges of two nodes, subgraphs, their ends, styles,
    comments and blank lines, no other; each end closes a subgraph, all are closed at last, and there is
    an edge. Brackets outside of quotes close in order. Links to elsewhere, scripts and fences are refused.
    The fold over the lines keeps the number of open subgraphs, which is all that their stack decides,
    since an end has no name. A null text isn't valid.
    """
    lines = F.transform(_lines(text), _stripped)

    def read(line: Column) -> Column:
        tokens = reduce(lambda z, rule: F.regexp_replace(z, *rule), _TOKENS, line)
        opens, ends, edge = line.rlike(_OPENS), line == "end", tokens.rlike(_EDGE_LINE)
        skip = (line == "") | line.startswith("%%")
        fair = skip | (~line.rlike(_ACTIVE) & ~line.rlike("[\1-\3]") & (opens | ends | edge | tokens.rlike(_NODE_LINE) | line.rlike(_STYLE)))
        step = F.when(skip, 0).when(ends, -1).when(opens, 1).otherwise(0)
        return F.struct(fair.alias("fair"), step.alias("step"), F.when(~skip & edge & ~opens & ~ends, 1).otherwise(0).alias("edge"))

    def fold(acc: Column, token: Column) -> Column:
        now = acc["open"] + token["step"]
        return F.struct(
            (acc["fair"] & token["fair"] & (now >= 0)).alias("fair"), now.alias("open"),
            F.greatest(acc["depth"], now).alias("depth"), (acc["edges"] + token["edge"]).alias("edges"),
        )

    begin = F.struct(F.lit(True).alias("fair"), F.lit(0).alias("open"), F.lit(0).alias("depth"), F.lit(0).alias("edges"))
    end = F.aggregate(F.transform(F.slice(lines, F.lit(2), F.size(lines)), read), begin, fold)
    whole = F.get(lines, F.lit(0)).rlike(f"^{HEAD}$") & ~text.contains("```") & _bracketed(text)
    valid = F.coalesce(whole & end["fair"] & (end["open"] == 0) & (end["edges"] > 0), F.lit(False))
    return F.struct(valid.alias("valid"), end["edges"].alias("edges"), end["depth"].alias("depth"))


def note_diagram(text: Column) -> Column:
    """Whether a diagram is one of those that notes may have.

    A flow diagram is a head and one or more edges, with white space around each link; a mind map is a root
    and indented branches. No markup, no fences, quotes in pairs on each line, LONGEST characters at most.
    """
    shown = _stripped(F.replace(text, F.lit("\r\n"), F.lit("\n")))
    lines = _lines(shown)
    rest = F.slice(lines, F.lit(2), F.size(lines))
    paired = F.forall(lines, lambda z: (F.length(z) - F.length(F.replace(z, F.lit('"'), F.lit("")))) % 2 == 0)
    head = F.get(lines, F.lit(0))
    flow = head.rlike(r"^\s*(?i:graph|flowchart)\s+(?:TB|TD|BT|RL|LR)\s*$") & F.forall(rest, lambda z: _stripped(z).rlike(_PLAIN_EDGE))
    mind = head.rlike(r"(?i:^\s*mindmap\b)(?:\s.*)?$") & _stripped(F.get(rest, F.lit(0))).startswith("root") & F.forall(rest, lambda z: z.rlike(_BRANCH))
    whole = (shown != "") & (F.length(text) <= LONGEST) & ~shown.rlike(_MARKUP)
    return F.coalesce(whole & (F.size(rest) > 0) & paired & (flow | mind), F.lit(False))
