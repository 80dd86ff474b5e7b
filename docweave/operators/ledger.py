"""A ledger of answers: each question of a round is asked until it is answered, a bounded number of times, and never again."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources.documents import scratch, stored

#: Takes the name of a round and rows with the column `asked`; returns the rows with the column `answer`, null where it failed.
Executor = Callable[[str, DataFrame], DataFrame]
#: Takes the name of a round and a question; returns the answer or raises.
Client = Callable[[str, str], str]

_ENTRY = "digest string, attempt int, answer string, error string"


def client_executor(client: Client) -> Executor:
    """An executor that asks a client once for each row; an exception is a null answer, with its name in `error`."""

    def ask(key: str, rows: DataFrame) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                answers, errors = [], []
                for question in batch.column(0).to_pylist():
                    answer = error = None
                    try:
                        answer = client(key, question) if question is not None else None
                    except Exception as e:  # recorded beside the question; the ledger decides whether it is asked again
                        error = type(e).__name__
                    answers.append(answer)
                    errors.append(error)
                more = [pa.array(answers, pa.string()), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "answer", "error"])

        kept = [c for c in rows.columns if c not in ("asked", "answer", "error")]
        taken = rows.select("asked", *[F.col(f"`{c}`") for c in kept])
        return taken.mapInArrow(work, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in taken.schema] + ["answer string", "error string"]))

    return ask


def by_round(executors: dict[str, Executor]) -> Executor:
    """An executor that sends each round to its own."""
    return lambda key, rows: executors[key](key, rows)


class Ledger:
    """Answers by (round, digest of the question), as a table that grows by one write for every wave of questions.

    A wave asks what has no answer yet, has been asked fewer than `attempts` times, and is in the rows
    at hand, each question once however many rows ask it. Its answers and failures are written before
    anything reads them, so lost executors, retried stages and later actions take answers from the
    table. Only a task that dies before its wave is written loses its calls and repeats them: spread
    questions over many partitions where calls are dear. A ledger on a folder that exists goes on
    where it stopped.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, attempts: int = 3):
        self.spark, self.attempts = spark, attempts
        self.folder = folder or scratch(spark, "ledger")

    def _waves(self, key: str) -> list[int]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{key}")
        system = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []
        done = [n for n in found if system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{key}/{n}/_SUCCESS"))]
        return sorted(int(n) for n in done)

    def entries(self, key: str) -> DataFrame:
        """(digest, attempt, answer, error): every time that a question of the round was asked."""
        paths = [f"{self.folder}/{key}/{n}" for n in self._waves(key)]
        return self.spark.read.schema(_ENTRY).parquet(*paths) if paths else self.spark.createDataFrame([], _ENTRY)

    def known(self, key: str) -> DataFrame:
        """(digest, attempts, answer, error): one row for each question; its answer, or null and the last error."""
        return self.entries(key).groupBy("digest").agg(
            F.max("attempt").alias("attempts"), F.max("answer").alias("answer"), F.max_by("error", "attempt").alias("error")
        )

    def _due(self, key: str, questions: DataFrame) -> DataFrame:
        """Questions that are to be asked, with `attempts`; what is known is met by digest only, texts follow where any is left."""
        if not self._waves(key):
            return questions.withColumn("attempts", F.lit(None).cast("int"))
        seen = self.known(key).select(F.col("digest").alias("_digest"), "attempts", F.col("answer").isNotNull().alias("done"))
        state = questions.select("_digest").join(seen, "_digest", "left")
        left = state.where((F.coalesce("attempts", F.lit(0)) < self.attempts) & ~F.coalesce("done", F.lit(False))).select("_digest", "attempts")
        left = stored(left, "due")
        return left if left.isEmpty() else questions.join(left, "_digest")

    def wrap(self, executor: Executor, pass_on: Sequence[str] = ()) -> Executor:
        """The executor behind this ledger. It sees `asked`, and the columns pass_on of one row that asks it."""

        def ask(key: str, rows: DataFrame) -> DataFrame:
            asked = stored(rows.withColumn("_digest", F.sha2("asked", 256)), "asked")
            grouped = asked.where("asked is not null").groupBy("_digest").agg(F.min(F.struct("asked", *pass_on)).alias("q"))
            questions = stored(grouped.select("_digest", "q.*"), "questions")
            for _ in range(self.attempts):
                due = self._due(key, questions)
                if due.isEmpty():
                    break
                number = max(self._waves(key), default=-1) + 1
                made = executor(key, due)
                error = F.col("error") if "error" in made.columns else F.lit(None)
                rows_of = (F.col("_digest").alias("digest"), (F.coalesce("attempts", F.lit(0)) + 1).cast("int").alias("attempt"), "answer", error.cast("string").alias("error"))
                made.select(*rows_of).write.mode("overwrite").parquet(f"{self.folder}/{key}/{number}")
            answers = self.known(key).select(F.col("digest").alias("_digest"), "answer")
            return asked.drop("answer").join(answers, "_digest", "left").drop("_digest")

        return ask
