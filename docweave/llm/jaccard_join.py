"""Exact Jaccard join on word n-grams: prefix keys, size bands, bitmap bounds, exact intersection."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.graph import components, composed
from docweave.llm.store import discard, materialize
from docweave.llm.textnp import shingle_sets

#: Sets that share a key in pairs up to this many; more are cut into tiles of TILE sets.
SMALL, TILE = 48, 512
#: Shingles summed at once when frequent ones are looked for, and how many frequent ones there can be.
BLOCK, FREQUENT = 4_000_000, 500_000


def prefix_length(n: int, percent: int) -> int:
    """So many first shingles, in any common order, hold one of every set with at least that Jaccard percentage."""
    return n - -(-percent * n // 100) + 1


def _frequent(docs: DataFrame, n: int) -> np.ndarray:
    """Shingles that many documents have: only their order depends on it, so estimates from below will do.

    Every task counts whole blocks of BLOCK shingles and leaves out those that a block has fewer
    than three times. The list has FREQUENT entries at most, whatever the input, by its threshold.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(sets: list[np.ndarray]) -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(sets), return_counts=True)
            keep = times >= 3
            return pa.RecordBatch.from_pydict({"token": token[keep].view(np.int64), "times": times[keep].astype(np.int64)})

        held, size = [np.zeros(0, np.uint64)], 0
        for batch in batches:
            for s in shingle_sets(batch.column("text").to_pylist(), n):
                held.append(s)
                size += len(s)
                if size >= BLOCK:
                    yield emit(held)
                    held, size = held[:1], 0
        yield emit(held)

    counted = materialize(
        docs.select("text").mapInArrow(count, "token long, times long").groupBy("token").agg(F.sum("times").alias("times")),
        "jaccard-counts",
    )
    total = counted.agg(F.sum("times")).first()[0] or 0
    many = counted.where(F.col("times") >= max(32, total // FREQUENT + 1)).select("token").toArrow()
    discard(counted)
    return np.sort(many.column("token").to_numpy().view(np.uint64))


def _signatures(docs: DataFrame, n: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, mark, size of the set, its 64-bit id (node; null if empty), its prefix keys, frequent shingles last, and its bitmap."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sent.value
        for batch in batches:
            size, node, prefixes, maps = [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), n):
                keys = s
                if len(often) and len(s):
                    hit = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s
                    keys = np.concatenate((s[~hit], s[hit]))
                size.append(len(s))
                node.append(set_id(s) if len(s) else None)
                prefixes.append(keys[: prefix_length(len(s), percent)] if len(s) else s)
                maps.append(bitmaps([s], bitmap_bits(len(s))).tobytes() if len(s) else None)
            columns = [pa.array(size, pa.int64()), pa.array(node, pa.int64()), _lists(prefixes), pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *columns], ["doc_id", "mark", "n", "node", "keys", "bits"])

    return docs.mapInArrow(sign, "doc_id long, mark binary, n long, node long, keys array<long>, bits binary")


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def set_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of bits/64 words for each set; bits is a power of two."""
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for row, s in zip(out, sets, strict=True):
        at = s & np.uint64(bits - 1)
        np.bitwise_or.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def bitmap_bits(n: int) -> int:
    return 1 << max(8, math.ceil(math.log2(4 * max(n, 1))))


def folded(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps of several sizes as rows of the smallest: halves of a larger one are joined by or."""
    least = min(len(m) for m in maps)
    out = []
    for m in maps:
        while len(m) > least:
            m = m[: len(m) // 2] | m[len(m) // 2 :]
        out.append(m)
    return np.stack(out)


def may_link(maps: np.ndarray, size: np.ndarray, one: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Which rows may link with one more set: bits that differ bound the overlap from above."""
    total = size + n
    bound = (total - np.bitwise_count(maps ^ one).sum(axis=-1, dtype=np.int64)) // 2
    return (100 + percent) * np.minimum(bound, np.minimum(size, n)) >= percent * total


def near_rows(maps: np.ndarray, size: np.ndarray, one: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Numbers of the rows that may link with one more set. Part of the bits rules most unlike sets out already."""
    part = -(-maps.shape[1] * 3 * (100 - percent) // (100 + percent))
    if 4 <= part < maps.shape[1]:
        first = np.flatnonzero(may_link(maps[:, :part], size, one[:part], n, percent))
        return first[may_link(maps[first], size[first], one, n, percent)]
    return np.flatnonzero(may_link(maps, size, one, n, percent))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact: intersection * 100 >= percent * union, of sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def tile_edges(
    low: list[tuple[int, np.ndarray]], high: list[tuple[int, np.ndarray]] | None, percent: int, roots: list[int] | None = None
) -> list[tuple[int, int]]:
    """Links that join the sets of one tile, or of a tile and another, as far as the links among them do.

    Bit counts of the xor bound each overlap from above; pairs below the bound and pairs that are
    joined already aren't compared. The links are a forest: fewer than there are sets.
    """
    items = low + (high or [])
    size = np.array([len(s) for _, s in items])
    maps = bitmaps([s for _, s in items], bitmap_bits(int(size.max())))
    parent = list(range(len(items)))
    if roots:  # sets that are joined already
        first: dict[int, int] = {}
        parent = [first.setdefault(r, i) for i, r in enumerate(roots)]

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for i in range(len(low)):
        after = len(low) if high is not None else i + 1
        if after >= len(items):
            continue
        near = near_rows(maps[after:], size[after:], maps[i], int(size[i]), percent)
        for j in near + after:
            p, q = top(i), top(int(j))
            if p != q and linked(items[i][1], items[j][1], percent):
                parent[q] = p
                found.append((items[i][0], items[j][0]))
    return found


def jaccard_components(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A document's set holds the distinct n-word shingles of its whole text, A-Z lower-cased; with
    fewer words the whole sequence; without words it is empty. Sets link when 100 * intersection
    >= percent * union; component_id is the smallest doc_id that links reach.

    1. Shingles that many documents share are found, so that they come last in the order of all.
    2. Every set gets a 64-bit id, under which equal sets meet, and its prefix keys: two sets that
       link share one of them.
    3. Keys of one set only go. Sets that share a key with at most SMALL-1 others form pairs within
       the size band. In a key with more, each set of a band first meets its hub, the one whose
       keys most sets have; bitmaps and the exact intersection decide, and links join classes.
    4. Keys that still have sets of several classes are cut into tiles by size band and hash: each
       set of a tile meets the sets outside the key's largest class, which visit the tiles of their
       band and of the next ones. Bitmaps bound overlaps from above; only for sets that may link
       with one of another class are the shingles intersected exactly. A group of tiles returns a
       forest of links: no pairs of a large group of near copies are written.
    5. Links go into connected components.

    Nothing is left out: prefix, band and bitmap bounds never lose a link. Null text is empty;
    rows with a null id join components but don't name them (a component of null ids has a null
    component_id); rows that repeat an id are documents of their own. Other columns are ignored; an
    empty table gives an empty result. Shingles and sets are compared by 64-bit hashes.
    """
    rows = _classes(docs, n, percent, id_col, text_col, F.lit(None).cast("binary"))
    names = rows.where(F.col("root").isNotNull()).groupBy("root").agg(
        F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("rows")
    )
    names = materialize(names.where("rows > 1").drop("rows"), "jaccard-names")
    return rows.join(names, "root", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component of jaccard_components() one row.

    The row with the smallest id stays; null ids come last, and among rows that repeat an id the
    text with the smallest MD5 stays. Of rows that repeat both, one stays. Rows without words are in
    no component and all stay. Columns may have any names; an empty table gives an empty result.
    """
    rows = _classes(docs, n, percent, id_col, text_col, F.unhex(F.md5(F.col(text_col).cast("string"))))
    rows = rows.where(F.col("root").isNotNull()).select("root", F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark").alias("row"))
    first = rows.groupBy("root").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"))
    first = materialize(first.where("rows > 1").drop("rows"), "jaccard-kept")
    met = rows.join(first.hint("merge"), "root").groupBy("row").agg(F.bool_or(F.col("row") == F.col("first")).alias("kept"), F.count(F.lit(1)).alias("rows"))
    odd = materialize(met.where("not kept or rows > 1").select("row.doc_id", "row.mark", "kept"), "jaccard-odd")
    mark = F.unhex(F.md5(F.col(text_col).cast("string")))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(id_col).cast("long").alias("doc_id"), mark.alias("mark"))
    side = lambda kept: odd.where(F.col("kept") == kept).select(F.col("doc_id").alias("d"), F.col("mark").alias("m")).hint("merge")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("mark").eqNullSafe(F.col("m"))
    out = whole.join(odd.select(F.col("doc_id").alias("d"), F.col("mark").alias("m")).hint("merge"), same, "left_anti").select("whole.*")
    if odd.where("kept").isEmpty():
        return out
    again = whole.join(side(True), same, "left_semi").groupBy("doc_id", "mark").agg(F.any_value("whole").alias("whole"))
    return out.union(again.select("whole.*"))


def _classes(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, mark: Column) -> DataFrame:
    """doc_id, mark, n, node and root of every row; equal sets are one node, and linked nodes have one root."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), mark.alias("mark"))
    sigs = materialize(_signatures(texts, n, percent, _frequent(texts, n)), "jaccard-signatures")
    keyed = sigs.select("node", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(
        F.min("node").alias("x"), F.max("node").alias("y"), F.count(F.lit(1)).alias("times")
    )
    shared = materialize(shared.where("x < y").select("key", "times"), "jaccard-keys")
    members = materialize(keyed.join(shared.hint("merge"), "key").distinct(), "jaccard-members")
    discard(shared)
    few = members.where(F.col("times") <= SMALL)
    many = materialize(members.where(F.col("times") > SMALL).withColumn("band", _band(percent)), "jaccard-many")
    pairs = _few_pairs(few, percent).union(_hub_pairs(many, percent))
    pairs = materialize(pairs.groupBy("a", "b").agg(F.max("both").alias("both")), "jaccard-pairs")
    met = _nodes(pairs).union(many.select("node")).distinct()
    maps = sigs.select("node", "n", "bits").join(met.hint("merge"), "node", "left_semi").dropDuplicates(["node"])
    maps = materialize(maps, "jaccard-maps")
    bounded = materialize(_bounded_pairs(pairs, maps, percent), "jaccard-bounded-pairs")
    discard(members, pairs)
    sets = materialize(_sets(texts, sigs, _nodes(bounded).distinct(), n), "jaccard-sets")
    known, pair_links = _pair_classes(bounded, sets, percent)
    discard(sets)
    tiles = materialize(_tiles(many, known), "jaccard-tiles")
    near = materialize(_bounded_nodes(tiles, maps, percent), "jaccard-bounded-nodes")
    sets = materialize(_sets(texts, sigs, near.select("node").distinct(), n), "jaccard-tile-sets")
    links = materialize(_tile_links(near, sets, percent), "jaccard-tile-links")
    discard(many, maps, bounded, tiles, near, sets)
    found = materialize(composed(known, components(links.union(pair_links))), "jaccard-components")
    discard(known, links, pair_links)
    rows = sigs.select("doc_id", "mark", "n", "node").join(found, "node", "left")
    return rows.withColumn("root", F.coalesce("root", "node"))


def _band(percent: int) -> Column:
    step = -math.log(percent / 100) * (1 + 1e-9)  # sizes just within the bound are never two bands apart
    return F.floor(F.log(F.col("n").cast("double")) / step)


def _few_pairs(few: DataFrame, percent: int) -> DataFrame:
    """(a, b, both): the sets of keys of few in pairs, with the number of such keys that they share."""
    side = lambda k: few.select("key", F.col("node").alias(k), F.col("n").alias(f"n{k}"))
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    pairs = side("a").join(side("b"), "key").where(near).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("both"))
    # Beyond the keys in both prefixes, sets have at most the rest of the one whose prefix ends first in
    # common. Keys of many sets aren't counted in "both", but sets that share one meet in a tile as well.
    most = F.col("both") + F.ceil(F.greatest("na", "nb") * percent / 100) - 1
    return pairs.where(most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b", "both")


def _hub_pairs(many: DataFrame, percent: int) -> DataFrame:
    """(a, b, both): each set of a key of many with the hub of that key and band; large groups mostly join there.

    The hub is the set whose prefix keys are the most shared: the text that the others were copied from.
    """
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    fame = many.groupBy("node", "n").agg((F.sum("times") / F.max(length)).alias("fame")).select("node", "fame")
    famous = many.join(fame.hint("merge"), "node")
    hubs = materialize(famous.groupBy("key", "band").agg(F.max_by("node", F.struct("fame", "node")).alias("hub")), "jaccard-hubs")
    met = many.join(hubs.hint("merge"), ["key", "band"]).where("hub <> node")
    pairs = met.groupBy(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    return pairs.agg(F.count(F.lit(1)).alias("both")).select("a", "b", "both")


def _tiles(many: DataFrame, known: DataFrame) -> DataFrame:
    """(key, band, tile, guest, side, major, node, root): the sets of a tile (side 0) and a tile of guests (side 1).

    Keys whose sets are all of one class need no tiles. The sets of a key outside its largest class
    are the guests of the tiles of their band and of the next ones: every two sets of different
    classes are a guest and another.
    """
    rooted = many.select("key", "node", "band").join(known.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialize(rooted, "jaccard-rooted")
    classes = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("times"))
    mixed = classes.groupBy("key").agg(F.max_by("root", F.struct("times", "root")).alias("largest"), F.count(F.lit(1)).alias("classes"))
    mixed = materialize(mixed.where("classes > 1").select("key", "largest"), "jaccard-mixed")
    rooted = rooted.join(mixed.hint("merge"), "key").withColumn("major", F.col("root") == F.col("largest")).drop("largest")
    bands = rooted.groupBy("key", "band").agg(F.count(F.lit(1)).alias("sets"), F.count_if(~F.col("major")).alias("guests"))
    bands = bands.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("sets", "guests")))).alias("bands"))
    near = F.array(*[F.col("band") + k for k in (-1, 0, 1)])
    of = lambda b, what: F.coalesce(F.try_element_at("bands", b)[what], F.lit(0))
    cut = lambda c: F.ceil(c / TILE).cast("int")
    tiles = lambda b: cut(of(b, "sets"))
    guests = lambda b: cut(of(b - 1, "guests") + of(b, "guests") + of(b + 1, "guests"))
    upto = lambda c: F.when(c > 0, F.sequence(F.lit(0), c - 1)).otherwise(F.array().cast("array<int>"))
    own = lambda c: F.pmod(F.xxhash64("node"), c).cast("int")
    group = lambda band, tile, guest, side: F.struct(band.alias("band"), tile.alias("tile"), guest.alias("guest"), F.lit(side).alias("side"))
    band = F.col("band")
    home = F.transform(upto(guests(band)), lambda g: group(band, own(tiles(band)), g, 0))
    away = F.flatten(F.transform(near, lambda o: F.transform(upto(tiles(o)), lambda t: group(o, t, own(guests(o)), 1))))
    groups = F.when(F.col("major"), home).otherwise(F.concat(home, away))
    placed = rooted.join(bands.hint("merge"), "key")
    return placed.select("key", F.explode(groups).alias("g"), "major", "node", "root").select("key", "g.*", "major", "node", "root")


#: The columns that name a group of tiles.
GROUP = ["key", "band", "tile", "guest"]


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """Batches that are sorted by GROUP, cut anew so that none ends inside a group, and where each group starts and ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edge = _edges(batch)
        last = [batch.column(c)[0].as_py() for c in GROUP]
        if held and [held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in GROUP] != last:
            yield _joined(held)
            held = []
        if len(edge):
            held.append(batch.slice(0, int(edge[-1])))
            yield _joined(held)
            held = [batch.slice(int(edge[-1]))]
        else:
            held.append(batch)
    if held:
        yield _joined(held)


def _edges(batch: pa.RecordBatch) -> np.ndarray:
    change = np.zeros(max(0, batch.num_rows - 1), bool)
    for c in GROUP:
        v = batch.column(c).to_numpy()
        change |= v[1:] != v[:-1]
    return np.flatnonzero(change) + 1


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, list[tuple[int, int]]]:
    batch = held[0] if len(held) == 1 else pa.concat_batches(held)
    edge = [0, *_edges(batch).tolist(), batch.num_rows]
    return batch, list(zip(edge, edge[1:], strict=False))


def _dealt(tiles: DataFrame) -> DataFrame:
    return tiles.repartition(*GROUP).sortWithinPartitions(*GROUP, "side", "node")


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def _words(bits: bytes | pa.Buffer) -> np.ndarray:
    return np.frombuffer(bits, np.uint64)


def _bounded_pairs(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs that their bitmaps don't rule out."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nx, ny, keep = batch.column("nx").to_numpy(), batch.column("ny").to_numpy(), []
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                p, q = folded([_words(x.as_buffer()), _words(y.as_buffer())])
                keep.append(bool(may_link(p, nx[i], q, int(ny[i]), percent)))
            yield batch.select(["a", "b", "both"]).filter(pa.array(keep, pa.bool_()))

    side = lambda k, m: maps.select(F.col("node").alias(k), F.col("bits").alias(m), F.col("n").alias(f"n{m}"))
    met = pairs.hint("merge").join(side("a", "x"), "a").hint("merge").join(side("b", "y"), "b")
    return met.mapInArrow(check, "a long, b long, both long")


def _bounded_nodes(tiles: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The rows of tiles whose set may link with one of another class on the other side of its group."""

    def near(maps: np.ndarray, size: np.ndarray, node: np.ndarray, root: np.ndarray, major: np.ndarray, home: int) -> np.ndarray:
        out = np.zeros(len(size), bool)
        for i in range(home, len(size)):
            hit = near_rows(maps[:home], size[:home], maps[i], int(size[i]), percent)
            # Two guests meet twice, once in the tile of each: one time is enough.
            hit = hit[(root[hit] != root[i]) & (major[hit] | (node[hit] < node[i]))]
            out[hit] = True
            out[i] = len(hit) > 0
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, groups in _whole_groups(batches):
            size, node, root, side, major = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "node", "root", "side", "major"))
            bits, keep = batch.column("bits"), np.zeros(batch.num_rows, bool)
            for a, b in groups:
                home = a + int(np.searchsorted(side[a:b], 1))
                if a < home < b:
                    maps = folded([_words(x.as_buffer()) for x in bits.slice(a, b - a)])
                    keep[a:b] = near(maps, size[a:b], node[a:b], root[a:b], major[a:b], home - a)
            yield batch.select([*GROUP, "side", "node", "root"]).filter(pa.array(keep))

    met = tiles.hint("merge").join(signed, "node").select(*GROUP, "side", "node", "root", "major", "n", "bits")
    return _dealt(met).mapInArrow(work, "key long, band long, tile int, guest int, side int, node long, root long")


def _sets(texts: DataFrame, sigs: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """(node, shingles) of the needed nodes, made again from one text of each."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                sets = list(shingle_sets(batch.column("text").slice(start, 256).to_pylist(), n))
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets]), _lists(sets)], ["node", "shingles"])

    one = sigs.where(F.col("doc_id").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    nameless = sigs.where(F.col("node").isNotNull() & F.col("doc_id").isNull()).select("node").distinct()
    chosen = needed.join(one, "node").select("doc_id").distinct()
    made = texts.join(chosen.hint("merge"), "doc_id", "left_semi")
    if not nameless.isEmpty():
        made = made.union(texts.where(F.col("doc_id").isNull()))
    # Rows that repeat an id may add sets that weren't asked for or twice the same: that adds no link that isn't there.
    return made.select("text").mapInArrow(arrays, "node long, shingles array<long>")


def _pair_classes(pairs: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the classes that each set's nearest pair makes, and (a, b): classes that other pairs link.

    The nearest pair is that with the partner that shares most prefix keys; of the other pairs only
    those are compared whose sets are still apart.
    """
    both_ways = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "both").union(pairs.select("b", "a", "both"))
    best = both_ways.groupBy("node").agg(F.max_by("other", F.struct("both", -F.col("other"))).alias("other"))
    first = materialize(best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "jaccard-first")
    links = materialize(_checked_pairs(first, sets, percent), "jaccard-first-links")
    known = materialize(components(links), "jaccard-known")
    root = lambda k: known.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
    rest = pairs.select("a", "b").join(first.hint("merge"), ["a", "b"], "left_anti")
    rest = rest.join(root("a").hint("merge"), "a", "left").join(root("b").hint("merge"), "b", "left")
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    rest = materialize(rest.where(apart).select("a", "b"), "jaccard-rest")
    more = materialize(_checked_pairs(rest, sets, percent), "jaccard-rest-links")
    joined = more.join(root("a").hint("merge"), "a", "left").join(root("b").hint("merge"), "b", "left")
    joined = joined.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = materialize(joined, "jaccard-pair-links")
    discard(first, links, rest, more)
    return known, joined


def _checked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("x"), batch.column("y"), strict=True)
            keep = [linked(x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64), percent) for x, y in both]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.hint("merge").join(x, "a").hint("merge").join(y, "b").mapInArrow(check, "a long, b long")


def _tile_links(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): classes that a link between sets of a group joins."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, groups in _whole_groups(batches):
            root, side = batch.column("root").to_pylist(), batch.column("side").to_numpy()
            shingles, links = batch.column("shingles"), []
            for a, b in groups:
                home = a + int(np.searchsorted(side[a:b], 1))
                if a < home < b:
                    items = [(i, shingles[i].values.to_numpy().view(np.uint64)) for i in range(a, b)]
                    links += tile_edges(items[: home - a], items[home - a :], percent, root[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([root[x[k]] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    whole = near.hint("merge").join(sets, "node").select(*GROUP, "side", "node", "root", "shingles")
    return _dealt(whole).mapInArrow(work, "a long, b long")
