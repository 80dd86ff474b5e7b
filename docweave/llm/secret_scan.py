"""Secret scan: patterns, and multipart credentials linked by scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.llm.text import filled

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds in the order of their listing: three that stand alone, then weak ones that need a complement.
KINDS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{16,}",
    "id": r"""(?i:access_?key_?id|client_?id|account_?id|user_?name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}|(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}""",
    "key": r"[A-Za-z0-9+/_-]{20,}={0,2}",
    "endpoint": r"(?:https?|postgres|mysql|redis|amqp|mongodb|s3)://[A-Za-z0-9._:@-]+",
}
BASE = ("assign", "access", "hex")
#: Kinds that complete a weak candidate: one of each set has to lie within its scope.
NEEDS = {
    "id": (("assign", "hex", "key"),),
    "key": (("access", "id", "endpoint"),),
    "endpoint": (("access", "id"), ("assign", "hex", "key")),
}
#: Weak kinds that give way to others where they overlap: what lies inside an endpoint or an identifier is no part of its own.
YIELDS = {"id": ("endpoint",), "key": ("endpoint", "id")}
#: A mark that no pattern matches; marks in the text itself become MARK2, which none matches either.
MARK, MARK2 = "\x01", "\x02"


def pieces(text: Column, pattern: str) -> Column:
    """The text cut at every match, leftmost and without overlap: pieces at odd places are the matches."""
    marked = F.regexp_replace(F.translate(text, MARK, MARK2), pattern, f"{MARK}$0{MARK}")
    return F.split(marked, MARK, -1)


def _good(kind: Column, match: Column) -> Column:
    """Whether a match holds beyond its pattern; failing matches are dropped without another try."""
    strong = match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]")
    return (
        F.when(kind == "assign", F.length(F.regexp_extract(match, ASSIGN, 2)) >= 12)
        .when(kind == "access", F.length(match) >= 18)
        .when(kind == "key", strong)
        .otherwise(match.isNotNull())
    )


def scan_secrets(docs: DataFrame, scope: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base (spans), spans (base and linked ones), linked.

    Spans are structs (start, kind number, end, kind) in code points, end exclusive, in order.
    Assignments, access identifiers and hex strings of the base kinds are reported as such. Weak
    candidates (other identifiers, mixed tokens that may be keys, endpoints) are reported only if
    complementary parts co-occur: for each set of kinds in NEEDS, a part of such a kind has to
    start or end within `scope` characters. A part can't complete itself: weak candidates that
    overlap a base span are left out, as are keys inside endpoints or identifiers, and keys right
    after a full stop, which go on with a host, a file name or another token.

    All spans of a document meet on one row id; the interval join is the distance to the nearest
    part before and after, from running windows in text order, so no pairs are made. Only spans
    and lengths are shuffled, never text. Null text counts as empty, so its row has no spans;
    null and repeated ids have rows of their own; an empty table gives an empty result.
    """
    text = filled(F.col(text_col))
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), pieces(text, p).alias("pieces")) for k, p in KINDS.items()])
    found = F.filter(parts, lambda p: F.size(p["pieces"]) > 1)
    cut = (
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), found.alias("found"))
        .select("row", "doc_id", F.explode_outer("found").alias("part"))
        .select("row", "doc_id", F.col("part.kind").alias("kind"), F.posexplode_outer("part.pieces").alias("at", "piece"))
    )
    match = F.when(F.col("at") % 2 == 1, F.col("piece"))
    numbers = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    rows = cut.select(
        "row",
        "doc_id",
        "kind",
        numbers[F.col("kind")].alias("number"),
        "at",
        F.length("piece").cast("long").alias("length"),
        F.coalesce(_good(F.col("kind"), match), F.lit(False)).alias("good"),
        F.coalesce(F.right("piece", F.lit(1)) == ".", F.lit(False)).alias("stop"),
    ).repartition("row")
    inside = Window.partitionBy("row", "kind").orderBy("at")
    spans = rows.withColumn("end", F.sum("length").over(inside)).withColumn("start", F.col("end") - F.col("length"))
    glued = (F.col("kind") == "key") & F.coalesce(F.lag("stop").over(inside), F.lit(False))
    spans = spans.withColumn("good", F.col("good") & ~glued).drop("stop")
    linked = _linked(spans, scope)
    span = F.struct("start", "number", "end", "kind")
    count = lambda k: F.count_if(F.col("good") & (F.col("kind") == k)).alias(f"n_{k}")
    base = F.col("good") & F.col("kind").isin(*BASE)
    return linked.groupBy("row", "doc_id").agg(
        *[count(k) for k in BASE],
        F.array_sort(F.collect_list(F.when(base, span))).alias("base"),
        F.array_sort(F.collect_list(F.when(base | F.col("linked"), span))).alias("spans"),
        F.count_if("linked").alias("linked"),
    ).drop("row")


def _linked(spans: DataFrame, scope: int) -> DataFrame:
    """spans with a column that says whether a weak candidate has its complements in scope."""
    good, kind = F.col("good"), F.col("kind")
    ahead = Window.partitionBy("row").orderBy("start", "number").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("number")).rowsBetween(Window.unboundedPreceding, -1)

    def nearest(df: DataFrame, name: str, of: Column) -> DataFrame:
        """The greatest end of such spans before each span, and the least start after it."""
        df = df.withColumn(f"before_{name}", F.max(F.when(of, F.col("end"))).over(ahead))
        return df.withColumn(f"after_{name}", F.min(F.when(of, F.col("start"))).over(back))

    def apart(name: str) -> Column:
        left, right = F.col(f"before_{name}") <= F.col("start"), F.col(f"after_{name}") >= F.col("end")
        return F.coalesce(left, F.lit(True)) & F.coalesce(right, F.lit(True))

    def near(name: str) -> Column:
        left, right = F.col("start") - F.col(f"before_{name}") <= scope, F.col(f"after_{name}") - F.col("end") <= scope
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    out = nearest(spans, "base", good & kind.isin(*BASE))
    stands = kind.isin(*BASE) | apart("base")
    for weak, others in YIELDS.items():
        out = nearest(out, f"over_{weak}", good & kind.isin(*others))
        stands = stands & ((kind != weak) | apart(f"over_{weak}"))
    out = out.withColumn("part", good & stands)
    names = {group: "_".join(group) for sets in NEEDS.values() for group in sets}
    for group, name in names.items():
        out = nearest(out, name, F.col("part") & kind.isin(*group))
    complete = F.lit(False)
    for weak, sets in NEEDS.items():
        whole = kind == weak
        for group in sets:
            whole = whole & near(names[group])
        complete = complete | whole
    return out.withColumn("linked", F.coalesce(F.col("part") & complete, F.lit(False)))


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
