"""Rules over rows and groups: which are broken, and who passes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rules: Mapping[str, Column]) -> Column:
    """Names of the broken rules, comma-joined, in order; a rule that is null counts as broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]
    return F.array_join(F.array_compact(F.array(*broken)), ",")


def checked(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    return df.withColumn("violations", violations(rules))


def accepted(df: DataFrame) -> DataFrame:
    return df.where("violations = ''")


def quarantined(df: DataFrame) -> DataFrame:
    return df.where("violations <> ''")


def box_rules() -> dict[str, Column]:
    at, to = F.least("x", "y", "width", "height"), F.greatest(F.col("x") + F.col("width"), F.col("y") + F.col("height"))
    return {"box": (at >= 0) & (F.least("width", "height") > 0) & (to <= 1.0 + 1e-9)}


def closes(brackets: Column) -> Column:
    """Whether a text of brackets only closes them in order: a fold over its characters that keeps what is open."""
    pairs = F.create_map(F.lit("]"), F.lit("["), F.lit(")"), F.lit("("), F.lit("}"), F.lit("{"))

    def step(acc: Column, c: Column) -> Column:
        opened = F.when(acc.isNull(), acc).when(c.isin("[", "(", "{"), F.concat(acc, c))
        closed = F.when(F.right(acc, F.lit(1)) == pairs[c], F.substring(acc, F.lit(1), F.length(acc) - 1))
        return opened.when(c.isin("]", ")", "}"), closed).otherwise(acc)

    return F.coalesce(F.aggregate(F.split(brackets, ""), F.lit(""), step) == "", F.lit(False))


def balanced(line: Column) -> Column:
    """Whether the brackets of a line close in order."""
    return closes(F.regexp_replace(line, r"[^\[\](){}]", ""))
