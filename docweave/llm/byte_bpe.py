"""Byte-level BPE by a rank file: ids with offsets from texts, and texts from ids."""

from __future__ import annotations

import base64
import functools
import itertools
import os
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType
from tokenizers import Tokenizer, models

from docweave.llm.text import filled

#: Unicode's White_Space (fixed values): what \s means to the splitting patterns.
SPACE = "\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space and what follows it up to the next. A split never runs from another character into white space.
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Characters searched for chunks at once, and chunks from which on a process forgets those that it kept.
REACH, KEEP = 1 << 19, 1 << 18
#: Ids decoded at once.
STEP = 1 << 19


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    above = itertools.count(256)
    return [chr(b if b in shown else next(above)) for b in range(256)]


class Table:
    """Strings that were encoded, and their ids one behind the other."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.first = np.zeros(1, np.int64)

    def add(self, keys: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        known = len(self.codes)
        self.codes.update(zip(keys, range(known, known + len(keys)), strict=True))
        self.ids = np.concatenate((self.ids, ids))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(counts)))

    def find(self, keys: list[str]) -> np.ndarray:
        """The place of each key, -1 for those that aren't here."""
        return np.fromiter(map(self.codes.get, keys, itertools.repeat(-1)), np.int64, len(keys))

    def ids_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these places in a row, and the number of ids of each."""
        counts = self.first[codes + 1] - self.first[codes]
        total = np.cumsum(counts)
        at = np.repeat(self.first[codes] - (total - counts), counts) + np.arange(total[-1] if len(codes) else 0)
        return self.ids[at], counts


class Vocabulary:
    """The tokens of a rank file (lines of base64 bytes and id), written in byte characters; decoding turns these back."""

    def __init__(self, path: str):
        lines = (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.to_characters = dict(enumerate(byte_characters()))
        self.written = {rank: self.characters(token) for token, rank in self.ranks.items()}
        to_byte = {c: b for b, c in self.to_characters.items()}
        tokens = [b""] * (max(self.written, default=-1) + 1)
        for rank, text in self.written.items():
            tokens[rank] = bytes(to_byte[c] for c in text)
        self.known = np.zeros(len(tokens), bool)
        self.known[list(self.ranks.values())] = True
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def characters(self, raw: bytes) -> str:
        """Bytes as their printable characters, as the tokenizer sees them."""
        return raw.decode("latin-1").translate(self.to_characters)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens in a row."""
        out = []
        for i in range(0, len(ids), STEP):
            part = ids[i : i + STEP].astype(np.int64)
            if len(part) and (part.min() < 0 or part.max() >= len(self.known) or not self.known[part].all()):
                raise ValueError("an id is not in the vocabulary")
            size = self.size[part]
            total = np.cumsum(size)
            pick = np.repeat(self.start[part] - (total - size), size) + np.arange(total[-1] if len(total) else 0)
            out.append(self.bytes[pick].tobytes())
        return b"".join(out)


class ByteBpe(Vocabulary):
    """Also encodes, each match of a splitting pattern by itself.

    Ranks say which neighbours may merge: any two whose bytes together are a token, lowest rank
    first. So every way to cut a token into two tokens becomes a merge with its rank.
    """

    def __init__(self, path: str, pattern: str):
        super().__init__(path)
        shown = {token: self.written[rank] for token, rank in self.ranks.items()}
        cuts = ((t[:i], t[i:]) for t in sorted(shown, key=self.ranks.__getitem__) for i in range(1, len(t)))
        merges = [(shown[a], shown[b]) for a, b in cuts if a in shown and b in shown]
        self.tokenizer = Tokenizer(models.BPE({text: rank for rank, text in self.written.items()}, merges, ignore_merges=True))
        self.split = regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        """Drop the matches and chunks that were kept."""
        self.matches, self.chunks = Table(), Table()

    def _learn(self, chunks: list[str]) -> None:
        """Split new chunks by the pattern, encode the matches that are new among these, and keep both."""
        found = [self.split(c) for c in chunks]
        matches = list(itertools.chain.from_iterable(found))
        new = list(dict.fromkeys(m for m in matches if m not in self.matches.codes))
        if new:
            encoding = self.tokenizer.encode([self.characters(m.encode()) for m in new], is_pretokenized=True, add_special_tokens=False)
            counts = np.bincount(np.array(encoding.word_ids, np.int64), minlength=len(new))
            self.matches.add(new, np.array(encoding.ids, np.int32), counts)
        ids, counts = self.matches.ids_of(self.matches.find(matches))
        bounds = np.concatenate(([0], np.cumsum(counts)))[np.cumsum([0, *map(len, found)])]
        self.chunks.add(chunks, ids, np.diff(bounds))

    def _reaches(self, text: str) -> Iterator[tuple[int, list[str], int]]:
        """Chunks of the text in lists of REACH characters, with offset and length; a longer chunk stays whole."""
        at, reach = 0, REACH
        while at < len(text):
            chunks = CHUNK.findall(text, at, at + reach)
            if at + reach < len(text):
                if len(chunks) == 1:
                    reach *= 2
                    continue
                chunks.pop()
            length = sum(map(len, chunks))
            yield at, chunks, length
            at, reach = at + length, REACH

    def _encode_group(self, group: list[tuple[int, list[str]]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids, starts and ends for each list of chunks with the offset of its first."""
        if len(self.chunks.codes) > KEEP:
            self.forget()
        chunks = [c for _, part in group for c in part]
        codes = self.chunks.find(chunks)
        unknown = np.flatnonzero(codes < 0)
        missed = [chunks[i] for i in unknown]
        self._learn(list(dict.fromkeys(missed)))
        codes[unknown] = self.chunks.find(missed)
        ids, count = self.chunks.ids_of(codes)
        total = np.concatenate(([0], np.cumsum(count)))
        first = np.cumsum([0, *(len(part) for _, part in group)])
        starts, ends, before = self._characters(ids, "".join(chunks))
        done = []
        for (at, _), a, b in zip(group, total[first[:-1]], total[first[1:]], strict=True):
            shift = at - (before[starts[a]] if a < b else 0)
            done.append((ids[a:b], before[starts[a:b]] + shift, before[ends[a:b] - 1] + 1 + shift))
        return done

    def _characters(self, ids: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last-plus-one byte of each token, and the character that each byte of the text belongs to."""
        data = np.frombuffer(text.encode(), np.uint8)
        ends = np.cumsum(self.size[ids])
        return ends - self.size[ids], ends, np.cumsum((data & 0xC0) != 0x80, dtype=np.int32) - np.int32(1)

    def encode(self, texts: Iterable[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids, and the code points where the characters start and end that each token has bytes of."""
        done: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        group: list[tuple[int, list[str]]] = []
        owner: list[int] = []
        held = 0

        def settle() -> None:
            for i, part in zip(owner, self._encode_group(group), strict=True):
                done[i].append(part)
            group.clear()
            owner.clear()

        for i, text in enumerate(texts):
            done.append([])
            for at, chunks, length in self._reaches(text):
                group.append((at, chunks))
                owner.append(i)
                held += length
                if held >= REACH:
                    settle()
                    held = 0
        if group:
            settle()
        none = (np.zeros(0, np.int32),) * 3
        return [tuple(np.concatenate(x) for x in zip(*p, strict=True)) if p else none for p in done]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One tokenizer for each process; a Spark task has one core, so the library makes no threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteBpe(path, pattern)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _slices(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of rows whose sizes add up to little more than most; one larger row stands alone."""
    total = np.cumsum(np.nan_to_num(sizes.to_numpy(zero_copy_only=False)).astype(np.int64))
    at = 0
    while at < len(total):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values.astype(np.int32)))


def encode_documents(docs: DataFrame, path: str, pattern: str, offsets: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids, n_split, and with offsets starts and ends, arrays of one entry for each token.

    Each match of the pattern is encoded by itself with the ranks of the file at path, which every
    executor has to find there; strings that look like special tokens are ordinary text. Offsets are
    code points of the text. A character whose bytes fall into several tokens is in the offsets of
    each; n_split counts the tokens that start inside a character.

    Map only, whole texts: each is encoded chunk by chunk, and chunks that come again (most words do)
    are looked up. A text is in memory REACH characters at a time, besides its ids; only a run without
    white space stays whole, as the merges ask. Null and empty texts have no ids. Rows with null or
    repeated ids are rows like others; an empty table gives an empty result.
    """
    names = ["doc_id", "ids", "n_split", *(["starts", "ends"] if offsets else [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in (part for whole in batches for part in _slices(whole, pc.binary_length(whole.column(1)), REACH)):
            found = bpe.encode(t.as_py() for t in batch.column(1))
            ids, starts, ends = ([f[i] for f in found] for i in range(3))
            split = pa.array([int(np.count_nonzero(a[1:] < b[:-1])) for a, b in zip(starts, ends, strict=True)], pa.int64())
            columns = [batch.column(0), _lists(ids), split, *([_lists(starts), _lists(ends)] if offsets else [])]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("doc_id"), filled(F.col(text_col)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    more = ", starts array<int>, ends array<int>" if offsets else ""
    return rows.mapInArrow(work, f"doc_id {kind}, ids array<int>, n_split long{more}")


def whole_characters(data: bytes) -> bytes:
    """The bytes without a character that is cut at either end."""
    a = 0
    while a < min(3, len(data)) and data[a] & 0xC0 == 0x80:
        a += 1
    for back in range(1, min(4, len(data) - a) + 1):
        lead = data[-back]
        if lead & 0xC0 != 0x80:
            need = 1 if lead < 0x80 else 2 if lead >> 5 == 6 else 3 if lead >> 4 == 14 else 4
            return data[a : len(data) - back] if need > back else data[a:]
    return data[a:]


def decode_tokens(rows: DataFrame, path: str, whole: bool = False, ids_col: str = "ids") -> DataFrame:
    """The rows with a column decoded: the bytes of the tokens in ids_col.

    The byte table turns each token's characters back into bytes, and bytes of neighbours are joined
    before anything is read as text, so characters that tokens split come back whole. Where a list
    itself begins or ends inside a character, whole leaves the rest of that character out. Null ids:
    null. An id that is not in the vocabulary is an error. A column decoded gives way to the new one.
    """
    kept = [c for c in rows.columns if c != "decoded"]
    at = kept.index(ids_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in (part for one in batches for part in _slices(one, pc.list_value_length(one.column(at)), STEP)):
            lists = batch.column(at)
            texts = [known.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in lists]
            texts = [whole_characters(t) if whole and t is not None else t for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*kept, "decoded"])

    taken = rows.select(*[F.col(f"`{c}`") for c in kept])
    return taken.mapInArrow(work, StructType([*taken.schema.fields, StructField("decoded", BinaryType())]))
