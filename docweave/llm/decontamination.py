"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.textnp import chunked, single_spaced, words

#: Steps of a CGK walk.
STEPS = 32
#: Sampled bits of a table, of which the first is taken that needs few tables.
BITS = (16, 14, 12, 10, 8, 6)
#: Items of a length class on which the agreement at the bound is measured, and tables tried on each.
SAMPLE, TRIED = 24, 128
#: Characters of benchmark items that one pass over the documents takes; a larger benchmark takes several.
BLOCK_CHARS = 4_000_000


class CgkIndex:
    """Items in bit-sampling tables over their CGK embeddings, to meet item-sized windows of a text in.

    The CGK walk copies a string's byte at its place, step by step, and moves on by a random bit that
    depends on table, step and byte, so that strings a few edits apart get embeddings a few steps
    apart. Edits drive two walks apart the longer they are, so the walk of each table begins at another
    place of the string, goes round its end, and is STEPS long; the tables together cover the string.
    A table samples a random bit of the byte at some of the steps.

    How many bits and tables, is measured for each doubling of the item length: a sample of items is
    given as many edits as the bound allows, evenly spread, which leaves the shortest whole runs, and
    the share of tables in which some window holds the edited item's bucket gives the number of tables
    that reaches the recall. Of the bit counts the largest is taken whose tables are at most 64; the
    smallest takes what it needs. The random bits are of a fixed number for each table, whatever
    the items' length.
    """

    def __init__(self, items: list[bytes], max_edit: float, recall: float, seed: int = 11):
        self.items, self.max_edit = items, max_edit
        self.plans: dict[int, tuple] = {}
        by_class: dict[int, list[int]] = defaultdict(list)
        for k, text in enumerate(items):
            if int(max_edit * len(text)):
                by_class[len(text).bit_length()].append(k)
        self.at = {}
        for size, group in sorted(by_class.items()):
            rng = np.random.default_rng([seed, size])
            self.plans[size] = self._measured(rng, [items[k] for k in group[:: math.ceil(len(group) / SAMPLE)]], recall)
            for k in group:
                data = np.frombuffer(items[k], np.uint8)
                self.at[k] = self._keys(self.plans[size], data, np.zeros(1, np.int64), len(data))[0]

    @staticmethod
    def _plan(rng: np.random.Generator, bits: int, tables: int) -> tuple:
        """Beginnings, moves, bits of bytes and sampled steps of so many tables."""
        used = np.argsort(rng.random((tables, STEPS)), axis=1) < bits
        begin = (np.arange(tables) * 0.6180339887 + 0.5) % 1
        return begin, rng.integers(0, 2, (tables, STEPS, 256), np.uint8), rng.integers(0, 2, (tables, 256), np.uint8), used

    @staticmethod
    def _keys(plan: tuple, data: np.ndarray, windows: np.ndarray, size: int) -> np.ndarray:
        """A bucket per window of so many bytes and table; bytes outside of data are 0."""
        begin, move, bit, used = plan
        before, after = max(0, -int(windows.min())), max(0, int(windows.max()) + size - len(data))
        padded = np.concatenate((np.zeros(before, np.uint8), data, np.zeros(after, np.uint8)))
        first, table = (windows + before)[:, None], np.arange(len(begin)) * 256
        place = np.broadcast_to((begin * size).astype(np.int64), (len(windows), len(begin))).copy()
        out = np.zeros(place.shape, np.int64)
        for step in range(STEPS):
            byte = padded[first + place] + table
            sampled = used[:, step]
            if sampled.any():
                out = (out << sampled) | np.take(bit * sampled[:, None], byte)
            place += np.take(move[:, step], byte)
            place *= place < size
        return out

    def _measured(self, rng: np.random.Generator, sample: list[bytes], recall: float) -> tuple:
        for bits in BITS:
            plan, shares = self._plan(rng, bits, TRIED), []
            for text in sample:
                edits = int(self.max_edit * len(text))
                changed, gap = bytearray(), len(text) / edits
                cuts = [int((i + 0.5) * gap) for i in range(edits)]
                for a, b, kind in zip([0, *cuts], [*cuts, len(text)], [-1, *rng.integers(0, 3, edits)], strict=True):
                    if kind >= 0:
                        changed.append(text[int(rng.integers(len(text)))])
                        a += 1 - (kind == 1)
                        if kind == 2:
                            changed.pop()
                    changed += text[a:b]
                mine = self._keys(plan, np.frombuffer(text, np.uint8), np.zeros(1, np.int64), len(text))
                theirs = self._keys(plan, np.frombuffer(bytes(changed) or b"\0", np.uint8), np.arange(-edits, edits + 1), len(text))
                shares.append(float((mine == theirs).any(axis=0).mean()))
            # A quarter of the items at most are harder than the share that the number of tables is for.
            share = max(float(np.quantile(shares, 0.25)), 1 / TRIED)
            tables = math.ceil(math.log(1 - recall) / math.log(1 - min(share, 0.999)))
            if tables <= 64:
                break
        return self._plan(rng, bits, tables)

    def meets(self, k: int, data: np.ndarray, low: int, high: int) -> bool:
        """Whether a window of data of item k's size, beginning from low to high, shares a bucket with the item."""
        size, own = len(self.items[k]), self.at[k]
        plan = self.plans[size.bit_length()]
        for a in range(low, high + 1, 1024):
            windows = np.arange(a, min(a + 1024, high + 1))
            for some in (slice(0, 4), slice(4, 12), slice(12, None)):
                if (self._keys(tuple(x[some] for x in plan), data, windows, size) == own[some]).any():
                    return True
        return False


class PieceFilter:
    """The parts of a text that may hold an item within its number of edits. Complete: no such part is left out.

    An item is cut into disjoint pieces of q bytes. An edit changes one piece at most, so a part of
    the text within k edits has all but k of the pieces as they are, on diagonals (place in the text
    less place in the item) at most k apart. Two neighbouring bins of k + 1 diagonals so hold that
    many hits; where they don't, the item isn't. q is the longest size that leaves enough pieces to
    tell a match from chance. Items that allow no edit are looked up as they are, elsewhere.
    """

    def __init__(self, items: list[tuple[int, bytes, int]], max_edit: float):
        self.groups = []
        self.again = {}
        by_q: dict[int, list[tuple[int, bytes, int]]] = defaultdict(list)
        for at, (_, text, _) in enumerate(items):
            m, k = len(text), int(max_edit * len(text))
            if k:
                enough = (q for q in range(8, 0, -1) if m // q - k >= max(1, m // 20))
                by_q[next(enough, min(8, max(1, m // (k + 1))))].append((at, text, k))
                cuts = [(q, m // q - k) for q in (4, 5, 3, 6, 8, 12) if m // q > k]
                self.again[at] = [([(p, p + q, text[p : p + q]) for p in range(0, m - q + 1, q)], need) for q, need in cuts]
        for q, group in sorted(by_q.items()):
            length = np.array([len(t) for _, t, _ in group])
            most = np.array([k for _, _, k in group])
            of = np.repeat(np.arange(len(group)), length // q)
            place = np.concatenate([np.arange(m // q) * q for m in length])
            joined = b"".join(t[: len(t) // q * q] for _, t, _ in group)
            bits = min(22, max(16, len(of).bit_length() + 4))
            slot = self._slots(np.frombuffer(joined, np.uint8), q, bits)[::q]
            order = np.argsort(slot, kind="stable")
            count = np.bincount(slot, minlength=1 << bits)
            index = np.array([at for at, _, _ in group])
            self.groups.append((q, bits, count, np.cumsum(count) - count, of[order], place[order], index, length, most))

    @staticmethod
    def _slots(data: np.ndarray, q: int, bits: int) -> np.ndarray:
        """A hash of the q bytes from each place on."""
        raw = data.tobytes() + bytes(8)
        grams = np.ndarray((len(data),), "<u8", raw, 0, (1,)) & np.uint64((1 << 8 * q) - 1)
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def may_hold(self, at: int, part: bytes, low: int, high: int) -> bool:
        """Whether so many pieces of item `at`, cut in several sizes, stand on diagonals low to high of part as a match would leave."""
        return all(
            sum([part.find(x, max(0, low + p), max(0, high + end)) >= 0 for p, end, x in pieces]) >= need
            for pieces, need in self.again.get(at, ())
        )

    def parts(self, data: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, low, high, start, end): parts of data that together hold every match, and the diagonals of its pieces."""
        for q, bits, count, first, of, place, index, length, most in self.groups:
            width, need = most + 1, length // q - most
            longest = int((length + most).max())
            step = max(2 * longest, (1 << 25) // max(256, len(index)))
            view = min(len(data), step + longest)
            bins = (view + length) // width + 2
            base = np.cumsum(bins) - bins
            enough = np.repeat(need, bins)
            shift = (length[of] - place, width[of], base[of])
            for a in range(0, len(data), step):
                slot = self._slots(data[a : a + view], q, bits)
                many = count[slot]
                at = np.flatnonzero(many)
                many = many[at]
                hit = np.arange(int(many.sum())) + np.repeat(first[slot[at]] - (np.cumsum(many) - many), many)
                key = (np.repeat(at, many) + shift[0][hit]) // shift[1][hit] + shift[2][hit]
                hits = np.bincount(key, minlength=len(enough))
                near = np.flatnonzero(hits[:-1] + hits[1:] >= enough[:-1])
                item = np.searchsorted(base, near, "right") - 1
                new = np.ones(len(near), bool)
                new[1:] = (near[1:] > near[:-1] + 1) | (item[1:] != item[:-1])
                last = np.append(new[1:], True)[: len(near)]
                for i, low, high in zip(item[new].tolist(), near[new].tolist(), near[last].tolist(), strict=True):
                    m, k, w = int(length[i]), int(most[i]), int(width[i])
                    low, high = a + (low - int(base[i])) * w - m, a + (high + 2 - int(base[i])) * w - 1 - m
                    yield int(index[i]), low, high, max(0, low - k), min(len(data), high + m + 2 * k)
                if a + view >= len(data):
                    break


def _closest(item: bytes, text: bytes, anchored: bool = False) -> tuple[int, int]:
    """The least edit distance of item to any part of text (anchored: that begins it), and where the first such part ends."""
    n = len(item)
    where: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item):
        where[c] |= 1 << i
    mask, top, edge = (1 << n) - 1, 1 << (n - 1), int(anchored)
    plus, minus, score, best, end = mask, 0, n, n, 0
    for at, c in enumerate(text, 1):
        eq = where.get(c, 0)
        x = eq | minus
        d = ((((eq & plus) + plus) ^ plus) | x) & mask
        up, down = minus | (~(d | plus) & mask), plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1 | edge) & mask, (down << 1) & mask
        plus, minus = down | (~(d | up) & mask), up & d
        if score < best:
            best, end = score, at
    return best, end


def infix_distance(item: bytes, text: bytes, most: int) -> int | None:
    """The least edit distance of item to any part of text, if at most `most` (bit-parallel columns)."""
    if item in text:
        return 0
    best, _ = _closest(item, text)
    return best if best <= most else None


def infix_match(item: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    """The least edit distance of item to any part of text, if at most `most`, and where such a part starts."""
    if (at := text.find(item)) >= 0:
        return 0, at
    if most <= 0:
        return None
    best, end = _closest(item, text)
    if best > most:
        return None
    return best, end - _closest(item[::-1], text[:end][::-1][: len(item) + best], anchored=True)[1]


class Searcher:
    """Searches texts for a block of items. net=False: only what the CGK tables name is verified."""

    def __init__(self, items: list[tuple[int, str]], max_edit: float, recall: float, net: bool = True):
        self.max_edit, self.net = max_edit, net
        data, start, end, _, bounds = words([t for _, t in items])
        self.whole = []
        for (item_id, _), a, b in zip(items, bounds[:-1], bounds[1:], strict=True):
            if a < b:
                text = b" ".join(data[s:e].tobytes() for s, e in zip(start[a:b], end[a:b], strict=True))
                self.whole.append((item_id, text, int(b - a)))
        self.index = CgkIndex([text for _, text, _ in self.whole], max_edit, recall)
        self.pieces = PieceFilter(self.whole, max_edit)
        self.unedited = [k for k, (_, text, _) in enumerate(self.whole) if not int(max_edit * len(text))]

    def search(self, texts: list[str | None], least: bool = True) -> Iterator[list[tuple[int, int, int, int]]]:
        """For each text its matches: (item_id, first word, words, distance), the closest for each item.

        least=False: a text that has a match isn't searched for others or closer ones.
        """
        for part in chunked(texts):
            data, start, end, _, bounds = words(part)
            found: list[dict[int, tuple[int, int, int, int]]] = [{} for _ in part]
            self._search(*single_spaced(data, start, end), bounds, found, least)
            for x in found:
                yield [x[k] for k in sorted(x)]

    def _search(self, flat: np.ndarray, first: np.ndarray, bounds: np.ndarray, found: list[dict], least: bool) -> None:
        low, high = first[bounds[:-1]], first[bounds[1:]] - 1

        def wanted(k: int, d: int) -> int:
            """The most edits that a new match may have; negative if none is wanted."""
            item_id, text, _ = self.whole[k]
            known = found[d].get(item_id)
            return -1 if not least and found[d] else int(self.max_edit * len(text)) if known is None else known[3] - 1

        def verify(k: int, d: int, a: int, b: int) -> None:
            item_id, text, size = self.whole[k]
            if match := infix_match(text, flat[a:b].tobytes(), wanted(k, d)):
                word = int(np.searchsorted(first, a + match[1], "right")) - 1 - int(bounds[d])
                found[d][item_id] = (item_id, word, size, match[0])

        left = []
        for k, on, to, a, b in self.pieces.parts(flat):
            for d in range(max(0, int(np.searchsorted(low, a, "right")) - 1), int(np.searchsorted(low, b))):
                p, q = max(a, int(low[d])), min(b, int(high[d]))
                if p < q and wanted(k, d) >= 0 and self.pieces.may_hold(k, flat[p:q].tobytes(), on - p, to - p):
                    size, edits = len(self.whole[k][1]), int(self.max_edit * len(self.whole[k][1]))
                    if self.index.meets(k, flat[p:q], max(on - p, -edits), min(to - p, q - p - size + edits)):
                        verify(k, d, p, q)
                    else:
                        left.append((k, d, p, q))
        for k, d, p, q in left if self.net else ():
            if wanted(k, d) >= 0:
                verify(k, d, p, q)
        for d in range(len(found)) if self.unedited else ():
            for k in self.unedited:
                if low[d] < high[d] and wanted(k, d) >= 0:
                    verify(k, d, int(low[d]), int(high[d]))


def _searchers(benchmark: DataFrame, max_edit: float, recall: float) -> Iterator[Searcher]:
    """The items in blocks of bounded size."""
    if not 0 <= max_edit < 1:
        raise ValueError("max_edit is a share of an item's length under 1")
    items = benchmark.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    )
    blocks = math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / BLOCK_CHARS)
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text")
        yield Searcher([tuple(r) for r in block.collect()], max_edit, recall)


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, max_edit: float = 0.15, recall: float = 0.99
) -> DataFrame:
    """The rows of docs in which find_leaks() finds nothing, with all their columns and without a shuffle."""
    for searcher in _searchers(benchmark, max_edit, recall):
        sent = docs.sparkSession.sparkContext.broadcast(searcher)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not found for found in sent.value.search(batch.column("text").to_pylist(), least=False)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, max_edit: float = 0.15, recall: float = 0.99
) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, first_word, n_words, distance.

    Texts are compared as words with single spaces, A-Z lower-cased. An item is found if some part
    of a document is within max_edit of the item's length in edits (UTF-8 bytes); distance is the
    least such number in the document, and first_word the word in which that part begins.

    A sketch of a document, disjoint pieces of the items on neighbouring diagonals (PieceFilter), says
    where windows of an item's size are laid, at every byte. CGK tables, so many that recall is
    reached for the hardest spread of max_edit edits, name the windows that are verified by edit
    distance. The parts that the sketch left and the tables didn't name are verified after them, as a
    net for the rest of the recall, so that no match within the bound is lost.

    The items are a query set, sent to the tasks in blocks of BLOCK_CHARS characters; documents are
    scanned whole, where they are, once for each block, and nothing is shuffled. Null texts and
    items without a word have no matches; a null item id can't name a match and is left out. Null and repeated doc ids have rows of their own. Empty tables give an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, first_word long, n_words long, distance long"
    out = docs.sparkSession.createDataFrame([], schema)
    for b, searcher in enumerate(_searchers(benchmark, max_edit, recall)):
        sent = docs.sparkSession.sparkContext.broadcast(searcher)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                found = [(d, *m) for d, ms in zip(ids, sent.value.search(batch.column("text").to_pylist()), strict=True) for m in ms]
                cols = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "first_word", "n_words", "distance"])

        part = texts.mapInArrow(scan, schema)
        out = part if b == 0 else out.union(part)
    return out
