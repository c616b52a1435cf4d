"""Exact Jaccard join of documents on word shingles, in size-banded tiles with bitmap signatures.

The space of shingle hashes is cut into more cells than linked sets can differ in, so linked sets agree on the
whole content of some cell. Sets that share the content of a cell form clumps; sets that share fewer than any
link implies are left out first. A clump's sets lie in bands of size, of which only neighbours can link, and a band
in blocks; a tile holds a block or two. Within a tile, counts of differing bitmap bits bound the overlap from above,
and pairs that pass are settled by intersecting sorted arrays. Pairs that are already connected are not looked at
again, so a group of n near copies costs about n intersections and yields n - 1 links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortrank.llm.common import filtered, free_name, materialise, shuffle_partitions, slices, small_batches
from cohortrank.llm.components import components

WORDS = 5
#: Cells that a slice of rows holds in several sets: at most HEAVY of the most common are met by a broadcast list of
#: them and not in a task each. The list decides where the work is done, never which documents link.
HEAVY = 65_536
#: Sets in a block and shingles in a block, about; bits of a bitmap at most; words that a worker remembers.
BLOCK, SHINGLES, BITS, CACHE_WORDS = 1024, 1 << 20, 1 << 17, 50_000
#: Numbers of cells double from class to class; a class has this many times the cells that its sets can differ in.
SLACK = 1.15
#: How often a class's cells are halved for a set that fills too few of them, before its shingles stand alone.
LEVELS = 6
CELLS = np.array([2 << k for k in range(40)], np.int64)
#: Bits of a cell's signature and of an owner's name. What crosses the shuffle is mostly these, so they leave two bytes of
#: zeros each. Signatures that fall together by chance add candidates and lose none.
NAME_BITS = 48
MIX = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(WORDS)]

TILE = ["clump", "band", "block"]


class WordCodes(dict):
    """64-bit codes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


CODES = WordCodes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit codes of a text's distinct shingles; bytes.lower() and split() touch A-Z, \\x20 and \\x09-\\x0D only."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    codes = np.fromiter(map(CODES.__getitem__, words), np.uint64, len(words))
    n = len(codes) - WORDS + 1
    mixed = sum((codes[k : k + n] * MIX[k] for k in range(WORDS)), np.zeros(n, np.uint64))
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def set_code(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def spread(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cell_signatures(shingles: np.ndarray, percent: int) -> tuple[np.ndarray, list[int]]:
    """Signatures of a set's cells, and how many of them an equal or linked set must share, for either parity.

    Linked sets, the smaller one of a shingles, differ in at most a * (100 - percent) / percent shingles. The
    smaller one's size gives a class, so a set takes part in its own class and in that of the smallest set that it can
    link with. A class cuts the space of hashes into p cells, more than there can be differences, and the
    signature of a cell is a sum over its shingles, with the parity of the class as its lowest bit. Of linked
    sets at least so many cells agree as the set with more filled cells has beyond the differences. Where a set
    fills no more cells than that, it also has signatures with more cells, at last of one shingle each; linked
    sets of which both do so share one of these.
    """
    size = len(shingles)
    differ = lambda n: n * (100 - percent) // percent
    of = lambda n: int(np.searchsorted(CELLS, SLACK * differ(n) + 1))
    out, needs = [], [0, 0]
    mixed = spread(shingles)
    place = (shingles >> np.uint64(11)).astype(np.float64) / 2.0**53
    for own in range(of(-(-percent * size // 100)), of(size) + 1):
        most = min(differ(size), int((CELLS[own] - 1) / SLACK))
        need = None
        for level in range(LEVELS + 1):
            cell = (place * (CELLS[own] << level)).astype(np.int64)
            start = np.flatnonzero(np.diff(cell, prepend=-1)) if level < LEVELS else np.arange(size)
            sums = np.add.reduceat(mixed, start) + np.uint64(own << 8 | level)
            out.append(spread(sums) >> np.uint64(64 - NAME_BITS) & ~np.uint64(1) | np.uint64(own & 1))
            need = len(start) - most if need is None else 1
            if len(start) > most:
                break
        needs[own & 1] = min(needs[own & 1] or size, max(1, need))
    return np.sort(np.concatenate(out)), needs


DIGEST = "kind byte, n long, code binary, cells array<bigint>, need_even int, need_odd int, cell long"


def digest(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Rows of kind 0: id, set size, code and cell signatures of each document; the signatures stand on the first of
    equal sets of a partition only. Rows of kind 1: a cell that several sets of one slice share, and how many."""
    small_batches(docs)
    ids = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", ids), *T.StructType.fromDDL(DIGEST)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for batch in slices(batches):
            sizes, codes, cells, even, odd = [], [], [], [], []
            for named, text in zip(batch.column(0).is_valid().to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = shingle_set(text)
                sizes.append(len(own))
                codes.append(code := set_code(own))
                found, needs = None, [None, None]
                if named and len(own) and code not in done:
                    done.add(code)
                    found, needs = cell_signatures(own, percent)
                cells.append(found)
                even.append(needs[0])
                odd.append(needs[1])
            flat = np.concatenate([*(x for x in cells if x is not None), np.zeros(0, np.uint64)]).view(np.int64)
            values, counts = np.unique(flat, return_counts=True)
            values, counts = values[counts > 1], counts[counts > 1]
            m, k = len(sizes), len(values)
            ends = np.cumsum([0, *(0 if x is None else len(x) for x in cells)])
            lists = pa.ListArray.from_arrays(pa.array(np.append(ends, np.full(k, ends[-1])), pa.int32()), pa.array(flat), mask=pa.array([x is None for x in cells] + [True] * k, pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column(0), pa.nulls(k, batch.column(0).type)]), pa.array([0] * m + [1] * k, pa.int8()), pa.array([*sizes, *counts.tolist()], pa.int64()),
                    pa.array([*codes, *[None] * k], pa.binary()), lists, pa.array([*even, *[None] * k], pa.int32()), pa.array([*odd, *[None] * k], pa.int32()), pa.array([*[None] * m, *values.tolist()], pa.int64()),
                ],
                schema.names,
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def owner_of(code: str) -> F.Column:
    """A name for a set: the head of its code, in the upper bits of a long."""
    return F.shiftleft(F.conv(F.hex(F.substring(code, 1, NAME_BITS // 8)), 16, 10).cast("long"), 64 - NAME_BITS)


def shared_cells(held: DataFrame) -> DataFrame:
    """cell, owner, hub and part for all cells that several sets have; held: digest().

    The hub is the smallest owner of the cell, of a heavy cell the smallest of one of its parts: heavy cells are dealt
    to as many parts as there are shuffle partitions, by owner. Other cells have no part.
    """
    # cell and part cross the shuffle as one long; the owner stands first, so that zeros of neighbours meet and compress
    parts = min(shuffle_partitions(held.sparkSession), (1 << 63 - NAME_BITS) - 1)
    common = held.where("kind = 1").groupBy("cell").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cell").limit(HEAVY).select("cell", F.lit(True).alias("_heavy"))
    rows = held.where("kind = 0 AND cells IS NOT NULL").select(owner_of("code").alias("owner"), F.explode("cells").alias("cell"))
    rows = rows.join(F.broadcast(materialise(common, "heavy")), "cell", "left")  # HEAVY bounds it
    dealt = F.shiftleft(F.pmod(F.xxhash64("owner"), F.lit(parts)) + 1, NAME_BITS)
    rows = rows.select("owner", F.when(F.col("_heavy"), F.col("cell") + dealt).otherwise(F.col("cell")).alias("key"))
    by = W.partitionBy("key").orderBy("owner")
    met = (F.lag("owner").over(by) != F.col("owner")) | (F.lead("owner").over(by) != F.col("owner"))
    rows = rows.select("key", "owner", F.first("owner").over(by.rowsBetween(W.unboundedPreceding, 0)).alias("hub"), met.alias("met"))
    part = F.shiftright("key", NAME_BITS)
    rows = rows.select(F.col("key").bitwiseAND((1 << NAME_BITS) - 1).alias("cell"), "owner", "hub", F.when(part > 0, part - 1).cast("int").alias("part"), "met")
    return rows.where("part IS NOT NULL OR met").select("cell", "owner", "hub", "part")


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set, each shingle at the bit that its code picks."""
    bits = min(BITS, max(64, 1 << (2 * max(map(len, sets)) - 1).bit_length()))
    out = np.zeros((len(sets), bits // 8), np.uint8)
    for row, own in zip(out, sets, strict=True):
        one = np.zeros(bits, np.uint8)
        one[(own & np.uint64(bits - 1)).astype(np.int64)] = 1
        row[:] = np.packbits(one)
    return out.view(np.uint64)


def tile_links(sets: list[np.ndarray], labels: np.ndarray, probe: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect all linked documents of a tile: pairs with a probe whose labels differ so far."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    maps = bitmaps(sets)
    labels = labels.copy()
    place = np.where(probe, np.arange(n), n)  # of two probes the first looks
    links = []
    for i in np.flatnonzero(probe):
        size, rest = sizes[i], (labels != labels[i]) & ((place > i) | ~probe)
        near = np.flatnonzero(rest & (100 * sizes >= percent * size) & (100 * size >= percent * sizes))
        if not len(near):
            continue
        need = -(-percent * (size + sizes[near]) // (100 + percent))
        mine = size - np.bitwise_count(maps[i] & ~maps[near]).sum(1).astype(np.int64)
        theirs = sizes[near] - np.bitwise_count(maps[near] & ~maps[i]).sum(1).astype(np.int64)
        for j in near[np.minimum(mine, theirs) >= need]:
            if labels[j] == labels[i]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (size + sizes[j] - both):
                links.append((int(i), int(j)))
                labels[labels == labels[j]] = labels[i]
    return links


class Tile:
    """The sets of a block, and the sets that visit it a few at a time."""

    def __init__(self, percent: int):
        self.percent, self.own, self.guests, self.held, self.parent = percent, [], [], 0, {}

    def root(self, label: bytes) -> bytes:
        while (up := self.parent.get(label, label)) != label:
            label = up
        return label

    def add(self, node: bytes, label: bytes, guest: bool, shingles: np.ndarray) -> list[tuple[bytes, bytes]]:
        self.held += len(shingles) if guest else 0
        (self.guests if guest else self.own).append((node, label, shingles))
        return self.settle() if self.held > SHINGLES or len(self.guests) >= BLOCK else []

    def settle(self) -> list[tuple[bytes, bytes]]:
        """Links of the visitors with the block, or without any visitors those within the block."""
        rows, m = self.own + self.guests, len(self.own)
        index: dict[bytes, int] = {}
        labels = np.array([index.setdefault(self.root(x[1]), len(index)) for x in rows])
        probe = np.arange(len(rows)) >= m if self.guests else np.ones(m, bool)
        found = tile_links([x[2] for x in rows], labels, probe, self.percent) if len(rows) > 1 else []
        for i, j in found:
            self.parent[self.root(rows[j][1])] = self.root(rows[i][1])
        self.guests, self.held = [], 0
        return [(rows[i][0], rows[j][0]) for i, j in found]


def join_tiles(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of tiles; rows: TILE, node, label, guest, shingles. In a tile with visitors these are held
    against the block and each other, in another its sets against each other."""
    tiles = rows.repartition(shuffle_partitions(rows.sparkSession), *TILE).sortWithinPartitions(*TILE, "guest", "node").select(
        F.concat_ws(" ", *(F.col(k).cast("string") for k in TILE)).alias("tile"), "node", "label", "guest", "shingles"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile, seen = None, Tile(percent), False

        def packed(out: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["a", "b"])

        def close() -> list[tuple[bytes, bytes]]:
            return tile.settle() if tile.guests or not seen else []

        for batch in slices(batches):
            out = []
            for own, node, label, guest, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != at:
                    out += close()
                    at, tile, seen = own, Tile(percent), False
                seen |= guest
                out += tile.add(node, label, guest, np.frombuffer(shingles, np.uint64))
            yield packed(out)
        yield packed(close())

    return tiles.mapInArrow(run, "a binary, b binary")


def tile_sets(docs: DataFrame, placed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """placed (node, rep, ...) with each node's shingles in place of rep."""
    kept = [c for c in placed.columns if c != "rep"]
    schema = T.StructType([*(placed.schema[c] for c in kept), T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [shingle_set(t) for t in batch.column(0).to_pylist()]
            same = pa.array([set_code(x) == code for x, code in zip(own, batch.column("node").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array([x.tobytes() for x in own], pa.binary())], schema.names).filter(same)

    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("_text"))
    found = filtered(texts, placed.select("rep"), "rep").join(placed, "rep").select("_text", *kept)
    # rows that repeat an id and its text give a node twice; tile_links() takes equal sets as linked
    return found.mapInArrow(run, schema)


def tile_places(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """TILE, node, shingles, and hubs: the node that visits all blocks of its band. members: clump, node, rep, n."""
    sums = members.groupBy("clump").agg(F.count("*").alias("_c"), F.sum("n").alias("_s")).where("_c > 1")
    large = (F.col("_c") > BLOCK) | (F.col("_s") > SHINGLES)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    banded = members.join(sums, "clump").withColumn("band", F.when(large, band).otherwise(0)).drop("_c", "_s")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / SHINGLES)).cast("int")
    width = banded.groupBy("clump", "band").agg(blocks.alias("_blocks"), F.min(F.struct(F.xxhash64("node").alias("h"), "node"))["node"].alias("_hub"))
    placed = banded.join(width, ["clump", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    spots = F.when((F.col("node") == F.col("_hub")) & (F.col("_blocks") > 1), F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(F.array("block"))
    return tile_sets(docs, placed.select(*TILE, "node", "rep", spots.alias("spots")), id_col, text_col)


def counted_cells() -> list[F.Column]:
    """How many cells of either parity there are."""
    return [F.count_if(F.col("cell") % 2 == 0).alias("c0"), F.count_if(F.col("cell") % 2 != 0).alias("c1")]


def hub_counts(shared: DataFrame) -> DataFrame:
    """owner, hub, c0 and c1: how many cells an owner shares under a hub. Here all parts of a heavy cell have one hub, so
    what two owners share stands under the same hubs for both."""
    tops = shared.where("part IS NOT NULL").groupBy("cell").agg(F.min("hub").alias("_top"))
    rows = shared.join(F.broadcast(materialise(tops, "tops")), "cell", "left")  # HEAVY bounds it
    return rows.groupBy("owner", F.coalesce("_top", "hub").alias("hub")).agg(*counted_cells())


#: Whether a set shares as many cells as its links would need.
ENOUGH = "need0 > 0 AND c0 >= need0 OR need1 > 0 AND c1 >= need1"


def unsettled(near: DataFrame, labels: DataFrame) -> DataFrame:
    """near (owner, hub, c0, c1, need0, need1) with label, band, block and minor, where a hub's sets have several labels, of
    the sets that share enough cells under such hubs: no other set is linked with one of another label."""
    rows = near.join(labels.select("owner", "label", "band", "block", "minor"), "owner")
    mixed = rows.groupBy("hub").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a < _b").select("hub")
    rows = materialise(rows.join(mixed, "hub"), "mixed")
    sums = rows.groupBy("owner").agg(*(F.sum(c).alias(c) for c in ("c0", "c1")), *(F.first(c).alias(c) for c in ("need0", "need1")))
    return rows.join(sums.where(ENOUGH).select("owner"), "owner", "left_semi")


def block_visits(rows: DataFrame) -> DataFrame:
    """owner, band and block: blocks of other sets that a minor set may be linked with; rows: unsettled().

    Under a hub a set shares no more cells with a set of the block than either has; summed over the hubs they must be as
    many as the visitor's links need."""
    spots = rows.groupBy("hub", F.col("band").alias("_band"), F.col("block").alias("_block")).agg(
        F.min("label").alias("_a"), F.max("label").alias("_b"), F.max("c0").alias("_c0"), F.max("c1").alias("_c1")
    )
    apart = ((F.col("label") != F.col("_a")) | (F.col("label") != F.col("_b"))) & (F.abs(F.col("band") - F.col("_band")) <= 1) & ((F.col("band") != F.col("_band")) | (F.col("block") != F.col("_block")))
    met = rows.where("minor").join(spots, "hub").where(apart).groupBy("owner", "_band", "_block").agg(
        *(F.sum(F.least(c, f"_{c}")).alias(c) for c in ("c0", "c1")), *(F.first(c).alias(c) for c in ("need0", "need1"))
    )
    return met.where(ENOUGH).select("owner", F.col("_band").alias("band"), F.col("_block").alias("block"))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_shingles and component_id, the smallest id that links reach from it, itself included.

    Two documents link when intersection / union of their shingle sets is at least percent / 100. A text of
    fewer than five words is one shingle. A null or blank text has none and links with nothing, nor does a row
    with a null id. Equal sets are one class; rows that repeat an id each keep a row. Other columns, whatever their
    names, do not come along. Texts of any length are taken whole. An empty table gives no rows.
    """
    # version 2 of the format writes the differences of the sorted cells
    held = materialise(digest(docs, id_col, text_col, percent), "digests", {"parquet.writer.version": "PARQUET_2_0"})
    rows = held.where("kind = 0").select("id", "n", "code")
    classes = held.where("kind = 0 AND n > 0 AND id IS NOT NULL").groupBy("code").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"), F.max("need_even").alias("need0"), F.max("need_odd").alias("need1")
    )
    classes = materialise(classes.withColumn("owner", owner_of("code")), "classes")

    shared = materialise(shared_cells(held), "shared")
    counts = materialise(hub_counts(shared), "counts")
    sums = counts.groupBy("owner").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    able = materialise(classes.join(sums, "owner").where(ENOUGH).select("owner", F.col("code").alias("node"), "rep", "n", "need0", "need1"), "able")
    near = materialise(counts.join(able.select("owner", "need0", "need1"), "owner"), "near")
    clumps = components(near, "owner", "hub")
    members = able.join(clumps.select(F.col("node").alias("owner"), F.col("component").alias("clump")), "owner")
    placed = materialise(tile_places(docs, members.select("clump", "node", "rep", "n"), id_col, text_col, percent), "placed")

    # first each block on its own, with the band's hub as a visitor
    first = placed.select("clump", "band", F.explode("spots").alias("block"), "node", F.col("node").alias("label"), F.lit(False).alias("guest"), "shingles")
    links = materialise(join_tiles(first, percent), "links")

    # then, in clumps of several blocks, the sets that share enough cells with other components: those that the
    # largest component of a clump leaves out visit the blocks with which they share as many as one link would need
    so_far = components(links).withColumnRenamed("component", "label")
    labels = placed.select(*TILE, "node").distinct().join(so_far, "node", "left").withColumn("label", F.coalesce("label", "node"))
    main = labels.groupBy("clump", "label").agg(F.count("*").alias("_c")).groupBy("clump").agg(F.max(F.struct("_c", "label"))["label"].alias("_main"), F.count("*").alias("_labels"))
    spread_out = labels.groupBy("clump").agg((F.min(F.struct("band", "block")) < F.max(F.struct("band", "block"))).alias("_wide")).where("_wide")
    labels = labels.join(main.where("_labels > 1"), "clump").join(spread_out, "clump").withColumn("minor", F.col("label") != F.col("_main"))
    labels = materialise(labels.select(*TILE, "node", owner_of("node").alias("owner"), owner_of("label").alias("label"), "minor"), "labels")
    if labels.limit(1).count():
        left = materialise(unsettled(near, labels), "left")
        again = materialise(labels.join(left.select("owner"), "owner", "left_semi"), "again")
        visits = materialise(block_visits(left), "visits")
        asked = again.select("owner", "clump").join(visits, "owner").select(*TILE).distinct()
        called = again.join(visits, "owner", "left_semi").unionByName(again.join(asked, TILE, "left_semi")).select(*TILE, "node", "owner", "label").distinct()
        called = materialise(called, "called")
        sets = materialise(filtered(placed.select("node", "shingles"), called.select("node"), "node").join(called, "node"), "sets")
        guests = sets.drop("band", "block").join(visits, "owner").select(*TILE, "node", "label", F.lit(True).alias("guest"), "shingles")
        hosts = sets.join(asked, TILE, "left_semi").select(*TILE, "node", "label", F.lit(False).alias("guest"), "shingles")
        so_far = components(links.unionAll(join_tiles(guests.unionByName(hosts), percent))).withColumnRenamed("component", "label")
    groups = so_far.select(F.col("node").alias("code"), F.col("label").alias("component"))

    named = classes.select("code", "rep").join(groups, "code")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(least, "component").select("code", "least")
    out = rows.join(classes.select("code", "rep").join(named, "code", "left").select("code", F.coalesce("least", "rep").alias("_least")), "code", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce(F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("_least")), "id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document of smallest id of each group of linked documents, with all its columns.

    Rows with a null id stay, as do null and blank texts. Of rows that repeat an id and its text one stays; rows that
    repeat an id with other texts stay or go together. Columns of any type and name may come along. An empty table
    gives no rows.
    """
    groups = materialise(near_duplicates(docs, percent, id_col, text_col), "groups")
    gone = groups.where(F.col("component_id") < F.col(id_col)).select(id_col).distinct()
    kept = filtered(docs, gone, id_col).join(gone, id_col, "left_anti").unionByName(filtered(docs, gone, id_col, rest=True)).select(*docs.columns)
    repeated = materialise(groups.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col), "repeated")
    if not repeated.limit(1).count():
        return kept
    nth, code = free_name(kept, "_nth"), free_name(kept, "_code")
    again = filtered(kept, repeated, id_col).withColumn(code, F.sha2(F.coalesce(text_col, F.lit("")), 256))
    again = again.withColumn(nth, F.when(F.col(id_col).isNull(), 1).otherwise(F.row_number().over(W.partitionBy(id_col, code).orderBy(code)))).where(F.col(nth) == 1)
    return again.drop(nth, code).unionByName(filtered(kept, repeated, id_col, rest=True))
