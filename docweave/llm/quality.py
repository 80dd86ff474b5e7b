"""Quality classifier: ordinal regression with shared weights on hashed text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.store import discard, materialize
from docweave.llm.textnp import chunked, mix, words

#: Hashed features: words that occur, then shares of word beginnings, of endings and of shapes, and facts of the whole text.
SPACE = 1 << 17
WORDS, BEGINNINGS, ENDINGS, SHAPES = SPACE >> 1, SPACE >> 2, SPACE >> 3, (SPACE >> 3) - 64
#: Bytes of a word that count as its beginning.
STEMS = (4, 5, 6)
#: What a share counts against one occurring word, of beginnings and of the others, and in how many rated documents a feature has to occur.
STEM_SHARE, SHARE, LEAST = 90.0, 3.0, 5
#: Standard deviations from chance at which a feature counts.
DEVIATIONS = 6.0
#: Labelled documents that the fit sees at most, in the order of a hash of their ids.
SAMPLE = 8000
_CLASS = np.zeros(256, np.uint64)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 1, 2, 4, 8
_CLASS[[x for x in range(33, 127) if not chr(x).isalnum()]] = 16
_MARKS = str.maketrans(dict.fromkeys((chr(x) for x in range(33, 127) if not chr(x).isalnum()), " "))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature, value) of all features of a list of texts, by text."""
    data, start, end, hashed, bounds = words(texts, lower=False)
    count = np.diff(bounds)
    doc = np.repeat(np.arange(len(texts)), count)
    plain, begin, stop, bare, at = words([t.translate(_MARKS) for t in texts])
    bare_doc = np.repeat(np.arange(len(texts)), np.diff(at))
    of = number = np.zeros(0, np.int64)
    value, distinct = np.zeros(0), np.zeros(len(texts), np.int64)
    if len(start):
        kind = np.bitwise_or.reduceat(_CLASS[data], np.stack([start, end], 1).ravel())[0::2]
        last = [data[np.maximum(end - k, start)].astype(np.uint64) for k in (1, 2, 3)]
        again = np.concatenate(([False], (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1]))).astype(np.uint64)
        shape = kind | (_CLASS[data[end - 1]] << np.uint64(5)) | (np.minimum(end - start, 15).astype(np.uint64) << np.uint64(10))
        tail = last[0] | (last[1] << np.uint64(8)) | (last[2] << np.uint64(16)) | (kind << np.uint64(24))
        numbers = (
            np.uint64(WORDS + BEGINNINGS) + mix(tail) % np.uint64(ENDINGS),
            np.uint64(WORDS + BEGINNINGS + ENDINGS) + mix(shape | (again << np.uint64(20))) % np.uint64(SHAPES),
        )
        each = [bare_doc * SPACE + (bare % np.uint64(WORDS)).astype(np.int64), *[doc * SPACE + x.astype(np.int64) for x in numbers]]
        stem = np.zeros(len(begin), np.uint64)
        for k in range(max(STEMS)):
            stem |= plain[np.minimum(begin + k, len(plain) - 1)].astype(np.uint64) << np.uint64(8 * k)
            if k + 1 in STEMS:
                long = stop - begin > k
                key = np.uint64(WORDS) + mix(stem[long] | np.uint64(k + 1 << 56)) % np.uint64(BEGINNINGS)
                each.append(bare_doc[long] * SPACE + key.astype(np.int64))
        each, times = np.unique(np.concatenate(each), return_counts=True)
        of, number = each // SPACE, each % SPACE
        share = np.where(number < WORDS + BEGINNINGS, STEM_SHARE, SHARE)
        value = np.where(number < WORDS, 1.0, share * times / np.maximum(count[of], 1))
        distinct = np.bincount(of[number < WORDS], minlength=len(texts))
    size = np.minimum(np.log2(count + 1).astype(np.int64), 15)
    spread = (10 * distinct / np.maximum(count, 1)).astype(np.int64) + 12 * (count >= 40)
    of = np.concatenate((of, np.tile(np.arange(len(texts)), 2)))
    order = np.argsort(of, kind="stable")
    number = np.concatenate((number, SPACE - 64 + size, SPACE - 48 + spread))
    return of[order], number[order], np.concatenate((value, np.ones(2 * len(texts))))[order]


@dataclass
class OrdinalModel:
    """P(grade >= k) = sigmoid(weights . x - thresholds[k-1]), thresholds ascending."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        of, number, value = features(texts)
        return np.bincount(of, self.weights[number] * value, minlength=len(texts))

    def tails(self, texts: list[str]) -> np.ndarray:
        """A row of P(grade >= 1), P(grade >= 2), ... for each text."""
        return _sigmoid(self.scores(texts)[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def telling(counts: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Features that some grade has far more or less often than chance: the fit has too few rows for the others.

    counts has a row per grade: in how many of its documents each feature occurs; often: its documents.
    """
    out, total = np.zeros(SPACE, bool), counts.sum(axis=0)
    for count, share in zip(counts, often / max(1, often.sum()), strict=True):
        out |= np.abs(count - total * share) > DEVIATIONS * np.sqrt(total * share * (1 - share) + 0.25)
    out[SPACE - 64 :] = True
    return out & (total >= min(LEAST, max(1, int(often.sum()) // 10)))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, top: int, epochs: int = 40, rate: float = 0.3, seed: int = 3) -> OrdinalModel:
    """Maximum likelihood by AdaGrad on small batches; rows are (feature numbers, values). Rare features stay out."""
    rng = np.random.default_rng(seed)
    often = np.bincount(grades, minlength=top + 1)
    counts = np.zeros((top + 1, SPACE), np.int64)
    for k in np.flatnonzero(often):
        counts[k] = np.bincount(np.concatenate([at for (at, _), g in zip(rows, grades, strict=True) if g == k]), minlength=SPACE)
    seen = telling(counts, often)
    rows = [(at[seen[at]], value[seen[at]]) for at, value in rows]
    weights, square = np.zeros(SPACE), np.full(SPACE, 1e-2)
    share = np.array([(grades >= k).mean() for k in range(1, top + 1)])
    share = np.clip(share, 1e-3, 1 - 1e-3)
    cut = np.maximum.accumulate(np.log((1 - share) / share) + 1e-3 * np.arange(top))
    cut_square = np.full(top, 1e-2)
    balance = np.sqrt(len(grades) / np.maximum(often, 1) / (top + 1))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for part in np.array_split(order, max(1, len(order) // 64)):
            at = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part])
            of = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            score = np.bincount(of, weights[at] * value, minlength=len(part))
            y = grades[part]
            upper = np.concatenate((np.ones((len(part), 1)), _sigmoid(score[:, None] - cut), np.zeros((len(part), 1))), axis=1)
            slope = upper * (1 - upper)
            i = np.arange(len(part))
            chance = np.maximum(upper[i, y] - upper[i, y + 1], 1e-9)
            scale = balance[y] / len(part)
            by_score = scale * (slope[i, y] - slope[i, y + 1]) / chance
            by_cut = np.zeros((len(part), top + 2))
            by_cut[i, y] -= scale * slope[i, y] / chance
            by_cut[i, y + 1] += scale * slope[i, y + 1] / chance
            near = np.unique(at)
            step = np.bincount(np.searchsorted(near, at), by_score[of] * value, minlength=len(near)) - 1e-6 * weights[near]
            square[near] += step**2
            weights[near] += rate * step / np.sqrt(square[near])
            push = by_cut[:, 1:-1].sum(axis=0)
            cut_square += push**2
            cut = np.sort(cut + rate * push / np.sqrt(cut_square))
    return OrdinalModel(weights.astype(np.float32), cut)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 of low quality, 1 good but toxic, 2 good. Of several labels the worst counts."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) != 0, 1).when(F.col("quality") > 0, 2)
    known = labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null")
    return known.groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit_quality(docs: DataFrame, ratings: DataFrame, top: int = 2, sample: int = SAMPLE) -> OrdinalModel | None:
    """Fit on at most `sample` rated documents; None if the rated ones don't have two grades.

    The executors count in how many documents of each grade a feature occurs; the driver gets these
    counts (at most SPACE for each grade) and, of the rated documents, only the telling features.
    """
    chosen = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rated = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"number": [], "value": []}
            for part in chunked(batch.column("text").to_pylist()):
                of, number, value = features(part)
                cut = np.searchsorted(of, np.arange(1, len(part)))
                out["number"] += np.split(number.astype(np.int32), cut)
                out["value"] += np.split(value.astype(np.float32), cut)
            number, value = pa.array(out["number"], pa.list_(pa.int32())), pa.array(out["value"], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("grade"), number, value], ["doc_id", "grade", "number", "value"]
            )

    schema = "doc_id long, grade int, number array<int>, value array<float>"
    rows = materialize(rated.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "grade").mapInArrow(count, schema), "quality-features")
    often = np.zeros(top + 1, np.int64)
    for r in rows.groupBy("grade").count().collect():
        often[r.grade] = r["count"]
    if np.count_nonzero(often) < 2:
        return None
    met = rows.select("grade", F.explode("number").alias("number")).groupBy("grade", "number").count().toArrow()
    counts = np.zeros((top + 1, SPACE), np.int64)
    counts[met.column("grade").to_numpy(), met.column("number").to_numpy()] = met.column("count").to_numpy()
    seen = telling(counts, often)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, value = (batch.column(c) for c in ("number", "value"))
            keep = seen[number.flatten().to_numpy()]
            of = np.repeat(np.arange(batch.num_rows), np.diff(number.offsets.to_numpy()))[keep]
            ends = pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, x.flatten().filter(pa.array(keep))) for x in (number, value)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), *lists], ["doc_id", "grade", "number", "value"])

    got = rows.mapInArrow(choose, schema).toArrow()
    discard(rows)
    grades = got.column("grade").to_numpy().astype(np.int64)
    fitted = list(zip((x.values.to_numpy() for x in got.column("number")), (x.values.to_numpy().astype(np.float64) for x in got.column("value")), strict=True))
    order = np.lexsort((grades, got.column("doc_id").to_numpy()))
    return fit_ordinal([fitted[i] for i in order], grades[order], top)


def score_quality(docs: DataFrame, model: OrdinalModel | None, cut: float = 0.4) -> DataFrame:
    """One row per document: doc_id, expected_grade, p_toxic_or_better, p_good, kept (p_good >= cut).

    The weights, SPACE numbers at any input size, are sent to every task; whole texts are scored
    where they are, without a shuffle. Null text is scored like an empty one, by the thresholds
    alone. Without a model (ratings of fewer than two grades) probabilities are null and all
    documents are kept. Null and repeated ids are scored row by row. Very long texts are scored in
    memory in proportion to their length, each in a chunk of its own. Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    if model is None:
        unknown = [F.lit(None).cast("double").alias(c) for c in ("expected_grade", "p_toxic_or_better", "p_good")]
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *unknown, F.lit(True).alias("kept"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [sent.value.tails(part) for part in chunked(batch.column("text").to_pylist())]
            p = np.concatenate(parts) if parts else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(p[:, -1]), pa.array(p[:, -1] >= cut)],
                ["doc_id", "expected_grade", "p_toxic_or_better", "p_good", "kept"],
            )

    schema = "doc_id long, expected_grade double, p_toxic_or_better double, p_good double, kept boolean"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(score, schema)


def keep_good(docs: DataFrame, model: OrdinalModel | None, cut: float = 0.4) -> DataFrame:
    """The rows of docs with P(grade is the best) >= cut, with all their columns; without a model all rows."""
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [sent.value.tails(part)[:, -1] >= cut for part in chunked(batch.column("text").to_pylist())]
            yield batch.filter(pa.array(np.concatenate(parts))) if parts else batch

    return docs.mapInArrow(keep, docs.schema)
