"""Rounds of answers for each key, checked one after the other, and the rules of their answers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import text as x
from docweave.operators.diagrams import topic_diagram
from docweave.operators.ledger import Executor
from docweave.operators.validation import violations
from docweave.sources.documents import stored

Rules = Mapping[str, Mapping[str, Column]]

#: The texts that the first four rounds of a topic give.
TOPIC_TEXTS = {
    "alignment": ("overview", "linked_sources", "core_concepts"),
    "comparison": ("viewpoint_comparison", "consensus_disagreements", "complementary_views"),
    "plain_cases": ("plain_explanation", "textbook_cases", "real_world_problem_solving"),
    "framework_application": ("integrated_framework", "application_methods", "further_thinking"),
}
TOPIC_ROUNDS = (*TOPIC_TEXTS, "mermaid", "cards", "review")
#: Rounds of a chapter, and its blocks with their titles in order.
CHAPTER_ROUNDS = ("structure", "concepts", "plain_explain", "application", "mermaid", "cards", "review")
CHAPTER_BLOCKS = {
    "summary": "本章概要",
    "concepts": "核心概念",
    "plain_explain": "通俗解释",
    "application": "应用场景",
    "knowledge_mermaid": "知识结构图",
    "application_mermaid": "应用流程图",
    "reflection": "复盘反思",
}
CARD_WORD = "选题卡"
_CARD = "card_type string, title string, content string, source_refs array<string>"


def run_rounds(
    work: DataFrame, rounds: Sequence[str], executor: Executor, rules: Rules, start: Mapping[str, Column], shapes: Mapping[str, Column] | None = None
) -> DataFrame:
    """work (one row for each key, with `prompt`), one column of answers for each round, and `failed`.

    A round is asked with the prompt and the answers before it. `failed` is '' or the first round whose answer breaks
    rules, with their names; from there on nothing is asked of that key and its answers are null. An executor that
    returns null breaks the rules. The rows are written, so that each question is asked once however often they are read;
    behind a ledger a question that failed is asked again, and one that any row has asked before isn't. shapes are what
    answers are read as, once each; rules find them in the column <round>_read.
    """
    shapes = shapes or {}

    def checked(state: DataFrame, key: str, named: Mapping[str, Column]) -> DataFrame:
        state = state.withColumn("_broken", F.when(F.col("failed") == "", violations(named)))
        return state.withColumn("failed", F.when(F.col("_broken") != "", F.concat(F.lit(f"{key}:"), "_broken")).otherwise(F.col("failed"))).drop("_broken")

    state = checked(work.withColumn("failed", F.lit("")), "start", start)
    for i, key in enumerate(rounds):
        parts = [F.lit(key), F.col("prompt"), *[F.col(k) for k in rounds[:i]]]
        asked = state.withColumn("asked", F.when(F.col("failed") == "", F.concat_ws("\n", *parts)))
        state = executor(key, asked).withColumn(key, F.when(F.col("failed") == "", F.col("answer"))).drop("asked", "answer")
        if key in shapes:
            state = state.withColumn(f"{key}_read", shapes[key])
        state = checked(state, key, rules[key])
    return stored(state.drop(*[f"{key}_read" for key in shapes]), "rounds")


def _only(answer: Column, names: Sequence[str]) -> Column:
    return F.array_sort(F.json_object_keys(answer)) == F.array(*[F.lit(n) for n in sorted(names)])


def _long(text: Column, most: int) -> Column:
    return F.coalesce(F.length(F.trim(text)).between(1, most), F.lit(False))


def _within(inner: Column, outer: Column) -> Column:
    return F.size(F.array_except(inner, outer)) == 0


def _every(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def topic_answers() -> dict[str, Column]:
    """The answers of a topic's rounds, read as what they have to be; null where they aren't."""
    shapes = {key: ", ".join(f"{name} string" for name in names) for key, names in TOPIC_TEXTS.items()}
    shapes |= {
        "mermaid": "knowledge_diagram string, application_diagram string",
        "cards": f"cards array<struct<{', '.join(c.strip().replace(' ', ': ', 1) for c in _CARD.split(','))}>>",
        "review": "passed boolean, issues array<string>",
    }
    return {key: F.from_json(F.col(key), shape) for key, shape in shapes.items()}


def read_answers(shapes: Mapping[str, Column]) -> dict[str, Column]:
    """The columns in which run_rounds() keeps answers as they are read."""
    return {key: F.col(f"{key}_read") for key in shapes}


def topic_rules(labels: Column, got: Mapping[str, Column] | None = None) -> dict[str, dict[str, Column]]:
    """Rules of each round's answer; the last round also has those on all answers together. got: the answers as they are read."""
    got, out = got or topic_answers(), {}
    for key, names in TOPIC_TEXTS.items():
        texts = [got[key][n] for n in names]
        out[key] = {
            "shape": _only(F.col(key), names) & _every([_long(c, 12_000) for c in texts]),
            "labels": _within(x.source_labels(F.concat_ws("\n", *texts)), labels),
        }
    out["alignment"]["sources"] = _within(labels, x.source_labels(got["alignment"]["linked_sources"]))
    pair = [got["mermaid"][f"{n}_diagram"] for n in ("knowledge", "application")]
    out["mermaid"] = {"shape": _only(F.col("mermaid"), ["knowledge_diagram", "application_diagram"]), "lines": _every([topic_diagram(c)["valid"] & _long(c, 20_000) for c in pair])}
    cards = got["cards"]["cards"]
    good = lambda c: _long(c["card_type"], 40) & _long(c["title"], 100) & _long(c["content"], 2_000) & F.size(c["source_refs"]).between(1, 20)
    out["cards"] = {
        "number": F.size(cards).between(8, 12),
        "shape": _only(F.col("cards"), ["cards"]) & F.forall(cards, good),
        "labels": _within(F.flatten(cards["source_refs"]), labels),
    }
    texts = F.concat_ws("\n", *[got[k][n] for k, names in TOPIC_TEXTS.items() for n in names])
    said = F.array_union(x.source_labels(texts), F.flatten(cards["source_refs"]))
    out["review"] = {
        "passed": _only(F.col("review"), ["passed", "issues"]) & got["review"]["passed"] & (F.size(got["review"]["issues"]) == 0),
        "sources": _within(labels, said),
        "size": F.length(F.concat(*[F.col(k) for k in TOPIC_ROUNDS])) <= 120_000,
    }
    for key in TOPIC_ROUNDS:
        out[key]["length"] = F.length(F.col(key)) <= 40_000
    return out


def topic_published(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topic_id, kind, content) and (topic_id, card_id, card_type, title, content, refs) of topics whose rounds all passed."""
    good = state.where("failed = ''").select("topic_id", *[c.alias(k) for k, c in topic_answers().items() if k != "review"])
    got = {k: F.col(k) for k in good.columns}
    kinds = [(n, got[k][n]) for k, names in TOPIC_TEXTS.items() for n in names]
    kinds += [("knowledge_mermaid", got["mermaid"]["knowledge_diagram"]), ("application_mermaid", got["mermaid"]["application_diagram"])]
    blocks = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("content")) for k, c in kinds])
    cards = good.select("topic_id", F.posexplode(got["cards"]["cards"]).alias("card_id", "c"))
    return (
        good.select("topic_id", F.inline(blocks)),
        cards.select("topic_id", F.col("card_id").cast("long").alias("card_id"), "c.card_type", "c.title", "c.content", F.col("c.source_refs").alias("refs")),
    )


def chapter_rules(allowed: Column, unchanged: Column, got: Column | None = None) -> dict[str, dict[str, Column]]:
    """Rules of each round's answer: text, citations that exist, two diagrams, cards, and the fixed blocks of the review, got as it is read."""
    out = {k: {"text": _long(F.col(k), 1 << 30), "citations": _within(x.citations(F.col(k)), allowed)} for k in CHAPTER_ROUNDS}
    out["mermaid"]["diagrams"] = F.size(x.diagrams(F.col("mermaid"))) == 2
    out["cards"]["cards"] = F.col("cards").contains(CARD_WORD)
    got = chapter_review() if got is None else got
    blocks = F.get_json_object("review", "$.revised_blocks")
    drawn = [F.coalesce(got["revised_blocks"][f"{n}_mermaid"].rlike(r"\b(?:graph|flowchart)\b"), F.lit(False)) for n in ("knowledge", "application")]
    out["review"] |= {
        "passed": got["passed"] & (F.size(got["issues"]) == 0),
        "blocks": _only(blocks, list(CHAPTER_BLOCKS)) & _every([_long(got["revised_blocks"][k], 1 << 30) for k in CHAPTER_BLOCKS]),
        "diagrams": _every(drawn),
        "fingerprint": unchanged,
    }
    return out


def chapter_review() -> Column:
    blocks = ", ".join(f"{k}: string" for k in CHAPTER_BLOCKS)
    return F.from_json("review", f"passed boolean, issues array<string>, revised_blocks struct<{blocks}>")


def chapter_published(state: DataFrame) -> DataFrame:
    """(chapter_id, kind, title, body, seq) of chapters whose rounds all passed."""
    got = state.where("failed = ''").select("chapter_id", chapter_review()["revised_blocks"].alias("got"))
    rows = [F.struct(F.lit(k).alias("kind"), F.lit(t).alias("title"), F.col("got")[k].alias("body"), F.lit(i).alias("seq")) for i, (k, t) in enumerate(CHAPTER_BLOCKS.items())]
    return got.select("chapter_id", F.inline(F.array(*rows)))


def outline_rules(allowed: Column) -> dict[str, dict[str, Column]]:
    """Rules of an outline: titles apart, chapters of this input only, each mapped or unmapped, none both."""
    got = outline_answer()
    titles = x.normalized_titles(got["topics"]["title"])
    mapped, rest = F.flatten(got["topics"]["chapter_ids"]), got["unmapped_chapter_ids"]
    apart = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    return {
        "topic_outline": {
            "shape": _only(F.col("topic_outline"), ["topics", "unmapped_chapter_ids"]) & (F.size(got["topics"]) > 0),
            "titles": apart(titles) & F.forall(titles, lambda z: _long(z, 200)),
            "repeats": F.forall(got["topics"], lambda z: apart(z["chapter_ids"])) & apart(rest),
            "foreign": _within(mapped, allowed) & _within(rest, allowed),
            "overlap": ~F.arrays_overlap(mapped, rest),
            "cover": _within(allowed, F.array_union(mapped, rest)),
        }
    }


def outline_answer() -> Column:
    topic = "title: string, description: string, reason: string, chapter_ids: array<bigint>"
    return F.from_json("topic_outline", f"topics array<struct<{topic}>>, unmapped_chapter_ids array<bigint>")
