"""Personal data: patterns, and identifiers found by bootstrapping their contexts."""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.store import materialize

KINDS = ("email", "ip", "card", "phone", "id")
_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"\S+")
_JOINED = re.compile(r"[A-Za-z0-9]+(?:[-_./:][A-Za-z0-9]+)*")
#: Characters around a mention in which its neighbouring words are looked for.
NEAR = 80


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses without overlap, in time proportional to the text: one try for each @."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at)
        at = text.find("@", max(at + 1, free))


def ips(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Four runs of digits with single dots between them, parts at most 255."""
    i = 0
    while i + 3 < len(runs):
        four = runs[i : i + 4]
        if all(a[1] + 1 == b[0] and text[a[1]] == "." for a, b in zip(four, four[1:], strict=False)):
            if all(b - a < 20 and int(text[a:b]) <= 255 or not text[a:b].lstrip("0") or int(text[a:b].lstrip("0")[:4]) <= 255 and len(text[a:b].lstrip("0")) <= 3 for a, b in four):
                yield four[0][0], four[3][1]
            i += 4
        else:
            i += 1


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base spans, in order."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    runs = [m.span() for m in _DIGITS.finditer(text)]
    if runs:
        out += [(a, 1, b) for a, b in ips(text, runs)]
        for m in _CARD.finditer(text):
            digits = re.sub(r"[\x20-]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _word(token: str) -> str:
    return re.sub(r"[0-9]", "0", token.lower()).strip(string.punctuation)


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a mention: two words before, one before and one after, two after."""
    before = [_word(x) for x in text[max(0, start - NEAR) : start].split()[-2:]]
    after = [_word(x) for x in text[end : end + NEAR].split()[:2]]
    out = []
    if len(before) == 2 and all(before):
        out.append(f"{before[0]} {before[1]} _")
    if before and after and before[-1] and after[0]:
        out.append(f"{before[-1]} _ {after[0]}")
    if len(after) == 2 and all(after):
        out.append(f"_ {after[0]} {after[1]}")
    return out


def unseen(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Words like identifiers, of 5 to 64 characters with two digits at least, that no base span touches.

    Words are runs without white space, as in contexts(), less the punctuation around them; a longer
    run, as in text without spaces, is taken apart where identifiers aren't joined. taken is in order.
    """
    starts, reach = [s for s, _, _ in taken], list(accumulate((e for _, _, e in taken), max))

    def free(a: int, b: int) -> bool:
        before = bisect_left(starts, b)
        return not before or reach[before - 1] <= a

    for m in _RUN.finditer(text):
        token = m[0]
        if not _DIGITS.search(token):
            continue
        a = m.start() + len(token) - len(token.lstrip(string.punctuation))
        b = m.end() - len(token) + len(token.rstrip(string.punctuation))
        for a, b in [(a, b)] if b - a <= 64 else [x.span() for x in _JOINED.finditer(text, a, b)]:
            if 5 <= b - a <= 64 and sum(c.isdigit() for c in text[a:b]) >= 2 and free(a, b):
                yield a, b


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("number", pa.int32()), ("end", pa.int64())])
    seen = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))])
    for batch in batches:
        spans, mentions = [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            spans.append([{"start": a, "number": k, "end": b} for a, k, b in base])
            named = [(a, b, True) for a, _, b in base] + [(a, b, False) for a, b in (unseen(text, base) if base or _DIGITS.search(text) else ())]
            mentions.append([{"start": a, "end": b, "name": text[a:b].lower(), "seed": s, "patterns": contexts(text, a, b)} for a, b, s in named])
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), pa.array(spans, pa.list_(span)), pa.array(mentions, pa.list_(seen))],
            ["row", "doc_id", "base", "mentions"],
        )


def find_pii(docs: DataFrame, rounds: int = 3, sure: float = 0.8, support: int = 3) -> DataFrame:
    """One row per document: doc_id, base (spans of the base kinds), spans (with discovered ones, kind id).

    Spans are structs (start, kind number, end), in order. Base spans are seeds. The words around a
    mention are its lexical patterns; words that look like identifiers but match no base pattern
    are unseen instances. The graph of patterns and instances (distinct names) is scored in
    `rounds` rounds of joins: a pattern's score is the mean of its instances' scores (seeds 1),
    shrunk by half an instance, if at least `support` of them are seeds; an unseen instance's score
    is one less the product of its patterns' doubts. Instances that patterns of `sure` or more
    bring to `sure` are seeds of the next round, so that their other contexts become patterns. Those
    of the last round are reported where a pattern of `sure` or more surrounds them.

    Scans whole texts once; the graph is joined by key on the executors and written out each round.
    Null text counts as empty; null and repeated ids have rows of their own; other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = (
        "row long, doc_id long, base array<struct<start:long,number:int,end:long>>, "
        "mentions array<struct<start:long,end:long,name:string,seed:boolean,patterns:array<string>>>"
    )
    found = materialize(rows.mapInArrow(_mentions, schema), "pii-mentions")
    each = found.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    edges = each.select("name", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "name").agg(F.max("seed").alias("seed"))
    edges = materialize(edges, "pii-edges")
    known = edges.withColumn("known", F.col("seed")).withColumn("score", F.col("seed").cast("double"))
    good = names = None
    for _ in range(rounds):
        scores = _pattern_scores(known, support)
        good = scores.where(F.col("score") >= sure)
        names = materialize(_instance_scores(edges, good).where(F.col("score") >= sure).select("name"), "pii-names")
        instances = _instance_scores(edges, scores).join(names.withColumn("promoted", F.lit(True)).hint("merge"), "name", "left")
        known = edges.join(instances.hint("merge"), "name", "left").withColumn("known", F.col("seed") | F.coalesce("promoted", F.lit(False)))
        known = known.withColumn("score", F.when(F.col("known"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
    new = each.where("not seed").select("row", "start", "end", "name", F.explode("patterns").alias("pattern"))
    new = new.join(good.select("pattern").hint("merge"), "pattern", "left_semi").join(names.hint("merge"), "name", "left_semi")
    added = new.select("row", F.struct("start", F.lit(KINDS.index("id")).alias("number"), "end").alias("s"))
    added = materialize(added.distinct().groupBy("row").agg(F.collect_list("s").alias("added")), "pii-added")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))
    return found.drop("mentions").join(added.hint("merge"), "row", "left").select("doc_id", "base", spans.alias("spans"))


def _pattern_scores(edges: DataFrame, support: int) -> DataFrame:
    sums = edges.groupBy("pattern").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"), F.count_if("known").alias("seeds"))
    scores = sums.where(F.col("seeds") >= support).select("pattern", (F.col("s") / (F.col("n") + 0.5)).alias("score"))
    return materialize(scores, "pii-patterns")


def _instance_scores(edges: DataFrame, scores: DataFrame) -> DataFrame:
    doubt = F.log(1 - F.least(F.col("score"), F.lit(0.999)))
    met = edges.where("not seed").join(scores.hint("merge"), "pattern")
    return met.groupBy("name").agg((1 - F.exp(F.sum(doubt))).alias("score"))


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["number"]), s["start"], s["end"])), ",")
