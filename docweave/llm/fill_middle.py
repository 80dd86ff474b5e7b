"""Fill-in-the-middle examples: a set of line boundaries in containers answers where two cuts fall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.text import filled

#: Low bits of an offset: offsets that agree in the bits above share a container.
LOW = 16
#: Bytes of a bitmap container, of one offset in an array container, and of one run.
BITMAP_BYTES, ARRAY_BYTES, RUN_BYTES = 1 << (LOW - 3), 2, 4
SENTINELS = ("<P>", "<S>", "<M>")


class ArrayContainer:
    """Low bits as a sorted array: the k-th is at place k."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """One bit for every low value in 64-bit words, with the number of bits before each word."""

    def __init__(self, low: np.ndarray):
        self.words = np.packbits(np.bincount(low, minlength=1 << LOW).astype(bool), bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        bits = np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little")
        return word * 64 + int(np.flatnonzero(bits)[k - self.before[word]])


class RunContainer:
    """Runs of neighbouring low values: first value of each, and the number of values before it."""

    def __init__(self, low: np.ndarray, first: np.ndarray):
        self.start, self.before = low[first], first

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.start[run]) + k - int(self.before[run])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest of the three forms for sorted distinct low values."""
    first = np.flatnonzero(np.concatenate(([True], np.diff(low) != 1)))
    sizes = (len(low) * ARRAY_BYTES, BITMAP_BYTES, len(first) * RUN_BYTES)
    if sizes[2] < min(sizes[:2]):
        return RunContainer(low, first)
    return ArrayContainer(low) if sizes[0] <= sizes[1] else BitmapContainer(low)


class BoundarySet:
    """Sorted distinct offsets in containers by their high bits; cumulative cardinalities find the container of the k-th."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> LOW
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(high)), bool), high[1:] != high[:-1])))
        self.keys = high[first]
        self.before = np.concatenate((first, [len(offsets)]))
        low = offsets & ((1 << LOW) - 1)
        self.containers = [container(low[a:b]) for a, b in zip(self.before[:-1], self.before[1:], strict=True)]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return (int(self.keys[at]) << LOW) + self.containers[at].select(k - int(self.before[at]))


def boundaries(data: np.ndarray) -> BoundarySet:
    """Where a text can be cut: before it, and after each of its lines; a line ends behind its line feed or with the text."""
    ends = np.flatnonzero(data == 10) + 1
    last = [len(data)] if len(data) and data[-1] != 10 else []
    return BoundarySet(np.concatenate(([0], ends, last)).astype(np.int64))


def _characters(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def fill_in_middle(
    docs: DataFrame,
    seed: int = 7,
    percent: int = 100,
    spm_percent: int = 50,
    sentinels: tuple[str, str, str] = SENTINELS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n (lines), form, prefix_chars, middle_chars, output.

    The hash of seed and id decides all: h1 and h2 choose two of the n + 1 boundaries, h3 whether the
    document is changed (percent of them), h4 which form it gets. psm is prefix, suffix, middle, each
    behind its mark; spm (spm_percent of them) puts the suffix first. A plain document is its text: an
    empty one, one that holds a mark already, or one that h3 leaves. Its lengths are null.

    Map only, one text at a time: offsets are bytes, so whole texts of any length and any bytes are
    cut without decoding; lengths count code points. Null text: empty, plain. Null ids hash like an
    empty id; rows that repeat an id are cut by the same hashes. An empty table gives an empty result.
    """
    marks = [m.encode() for m in sentinels]
    p, s, m = marks

    def cut(data: bytes, digest: str) -> tuple[int, str, int | None, int | None, bytes]:
        view = np.frombuffer(data, np.uint8)
        cuts = boundaries(view)
        n = len(cuts) - 1
        h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
        if not data or any(mark in data for mark in marks) or h[2] % 100 >= percent:
            return n, "plain", None, None, data
        a, b = (cuts.select(k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
        prefix, middle, suffix = data[:a], data[a:b], data[b:]
        form = "spm" if h[3] % 100 < spm_percent else "psm"
        out = s + suffix + p + prefix + m + middle if form == "spm" else p + prefix + s + suffix + m + middle
        return n, form, _characters(view[:a]), _characters(view[a:b]), out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            cells = zip(batch.column(1), batch.column(2), strict=True)
            columns = list(zip(*(cut(t.as_py(), d.as_py()) for t, d in cells), strict=True)) or [()] * len(types)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        filled(F.col(text_col)).cast("binary").alias("text"),
        F.sha2(F.concat(F.lit(f"{seed}:"), key), 256).alias("digest"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(work, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of that form was made from."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in sentinels), -1)
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    text = F.when(form == "spm", F.concat(second, middle, first)).otherwise(F.concat(first, middle, second))
    return F.when(form == "plain", output).otherwise(text)
