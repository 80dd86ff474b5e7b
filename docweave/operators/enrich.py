"""Model calls once per distinct section, and titles that stay apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import normalized_title
from docweave.operators.ledger import Ledger
from docweave.operators.ordering import places

Client = Callable[[int, str], str]


def stub_client(seq: int, raw: str) -> str:
    """The deterministic stand-in for a model."""
    return f"### stub\n- section {seq}, about {len(raw.split())} tokens\n"


def enrich_once(sections: DataFrame, client: Client, attempts: int = 3, ledger: Ledger | None = None) -> DataFrame:
    """(sha256, ai_md): the client is asked once for each distinct section, as it stands first, and again if it fails.

    Answers are kept in the ledger before they are read; one on a lasting folder serves later runs too. A section that
    fails as often as the ledger allows gets the name of its last error.
    """
    kept = ledger or Ledger(sections.sparkSession, attempts=attempts)
    asked = sections.select("doc_id", "seq", F.col("raw").alias("asked"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, errors = [], []
            for seq, raw in zip(batch.column("seq").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                try:
                    answers.append(client(seq, raw))
                    errors.append(None)
                except Exception as error:  # asked again in the next wave; the last error is reported in the result
                    answers.append(None)
                    errors.append(type(error).__name__)
            more = [pa.array(answers, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("_digest"), batch.column("attempts"), *more], ["_digest", "attempts", "answer", "error"])

    def executor(_: str, rows: DataFrame) -> DataFrame:
        return rows.select("_digest", "attempts", "seq", "asked").mapInArrow(work, "_digest string, attempts int, answer string, error string")

    kept.wrap(executor, ("doc_id", "seq"))("enrich", asked)
    failed = F.concat(F.lit("(failed: "), "error", F.lit(")"))
    answers = kept.known("enrich").select(F.col("digest").alias("sha256"), F.coalesce("answer", failed).alias("ai_md"))
    return sections.select("sha256").distinct().join(answers, "sha256")


def display_titles(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key, title, display): equal titles of a group get （2）, （3） ... in order of key, past taken names.

    Titles are equal by their normal form. The first keeps its name; the others take, in order, the numbers from 2 on whose
    name isn't a title of the group. Titles that end in such a number are set against their stem: a number t that has i
    smaller ones before it is passed over by all from the place t - i on. So the number of a row is found from its place among
    equal titles and taken numbers, which places() counts without a task that holds all of them. Null titles stay null.
    """
    named = rows.select(group, key, "title", normalized_title(F.col("title")).alias("stem"))
    ranked = places(named, [group, "stem"], [key], "rank")
    taken = named.select(group, "stem").distinct()
    number = F.regexp_extract("stem", r"(?s)^(.*)\(([1-9]\d{0,8})\)$", 2).try_cast("int")
    taken = taken.select(group, F.regexp_extract("stem", r"(?s)^(.*)\(([1-9]\d{0,8})\)$", 1).alias("stem"), number.alias("n")).where("n >= 2")
    again = ranked.where("rank > 1 and stem is not null")
    gaps = places(taken, [group, "stem"], ["n"], "i").select(group, "stem", (F.col("n") - F.col("i") + 1).alias("at"), F.lit(0).alias("own"), F.lit(None).cast(ranked.schema[key].dataType).alias(key), F.lit(None).cast("string").alias("title"))
    met = places(gaps.union(again.select(group, "stem", F.col("rank").alias("at"), F.lit(1).alias("own"), key, "title")), [group, "stem"], ["at", "own"])
    later = met.where("own = 1").select(group, key, "title", F.concat("title", F.lit("（"), F.col("place") + 1, F.lit("）")).alias("display"))
    return ranked.where("rank = 1 or stem is null").select(group, key, "title", F.col("title").alias("display")).union(later)
