"""SimHash near-duplicate detection with bit-sliced comparison (operator 8).

Fingerprints: of a whole text, A-Z lower-cased, the words
``[^\\x20\\x09-\\x0D]+`` and their space-joined shingles, repeats included
(fewer words: the whole sequence); a bit is 1 if it is set in over half of the
shingles' XXH64 values (seed 42).  A text without words has fingerprint zero.

Links join fingerprints at most ``radius`` bits apart.  Equal fingerprints are
one node from the start.  The 64 bits are cut into ``blocks`` blocks; two
fingerprints within the radius agree on at least ``blocks - radius`` of them,
so every choice of that many blocks gives a key, and linked fingerprints meet
under one of the keys at least.  Under a key, the fingerprints are stored as
vertical bit planes, 64 to a machine word; a fingerprint is compared with a
plane word at a time, distances are kept in carry-save bit counters, and a
block of 64 is abandoned once all of its distances exceed the radius.

A key with more than BUCKET fingerprints is cut into parts, and each pair of
parts is a group of its own, so no group grows with the corpus and every pair
is compared.  A group gives a spanning forest of its links, not all pairs.
Components are found by alternating star contractions over the distinct
fingerprints, as Spark joins; each round is written to the checkpoint folder.

Defined results: a null text is an empty one; all texts without words share
fingerprint zero, linked like any other; null ids count as larger than any
other, and a component of null ids alone has a null component_id; repeated
rows share their fingerprint's component; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import documents, quoted, texts
from tillroll.session import materialize

SHINGLE, RADIUS, BLOCKS, SEED = 3, 2, 6, 42
#: Fingerprints of a key that are compared in one group.
BUCKET = 4096
#: Comparisons (a fingerprint with a block of 64) held at once.
STEP = 1 << 16
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a text."""
    import xxhash

    words = text.encode().lower().split()  # both know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    stops = (ends[k - 1:] - 1).tolist()
    starts = [0, *ends[:len(words) - k].tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        part = h[i:i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, mark: Column | None = None) -> DataFrame:
    """(doc_id, mark, fp), a row per row of ``docs``; ``fp`` is a signed long,
    ``mark`` a long that the caller wants back."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       (F.lit(0) if mark is None else mark).cast("long").alias("mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64())],
                                             names=["doc_id", "mark", "fp"])

    return rows.mapInArrow(run, "doc_id long, mark long, fp long")


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """For each choice of ``blocks - radius`` blocks, the bits that it keeps."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(block[i] for i in pick) for pick in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class BitPlanes:
    """Fingerprints in groups, stored vertically: lane ``i`` of word
    ``planes[block, p]`` is bit ``p`` of the block's ``i``-th fingerprint."""

    def __init__(self, fps: np.ndarray, group: np.ndarray) -> None:
        """``group`` numbers the groups 0, 1, ... in ascending order."""
        sizes = np.bincount(group)
        blocks = -(-sizes // 64)
        self.first = np.concatenate([[0], np.cumsum(blocks)])
        begin = np.concatenate([[0], np.cumsum(sizes)])
        inside = np.arange(len(fps)) - begin[group]
        self.fps, self.group, self.blocks = fps, group, blocks
        self.slot = self.first[group] * 64 + inside
        self.row_of = np.full(self.first[-1] * 64, -1, np.int64)
        self.row_of[self.slot] = np.arange(len(fps))
        lanes = np.zeros(self.first[-1] * 64, np.uint64)
        lanes[self.slot] = fps
        self.planes = np.zeros((int(self.first[-1]), 64), np.uint64)
        for a in range(0, len(self.planes), 4096):  # 64 x 64 bits transposed
            bits = np.unpackbits(lanes[a * 64:(a + 4096) * 64].astype(">u8").view(np.uint8)).reshape(-1, 64, 64)
            turned = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")
            self.planes[a:a + 4096] = np.ascontiguousarray(turned).view("<u8").reshape(-1, 64)
        full = np.zeros(self.first[-1] * 64, bool)
        full[self.slot] = True
        self.valid = np.packbits(full.reshape(-1, 64), axis=1, bitorder="little").view("<u8").reshape(-1)

    def comparisons(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(fingerprint, block) for each fingerprint and the blocks of its own
        group up to its own, STEP at a time."""
        own = self.slot // 64
        count = own - self.first[self.group] + 1
        ends = np.cumsum(count)
        for a in range(0, int(ends[-1]) if len(ends) else 0, STEP):
            at = np.arange(a, min(a + STEP, int(ends[-1])))
            q = np.searchsorted(ends, at, side="right")
            yield q, self.first[self.group[q]] + at - (ends[q] - count[q])

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows within the radius, the later row first."""
        width = (radius + 1).bit_length()
        start = (1 << width) - 1 - radius  # a counter overflows at radius + 1
        for q, block in self.comparisons():
            over = ~self.valid[block]
            own = block == self.slot[q] // 64
            lane = (self.slot[q] % 64).astype(np.uint64)
            # of its own block a fingerprint sees the lanes before it
            over[own] |= ~((np.uint64(1) << lane[own]) - np.uint64(1))
            counters = [np.full(len(q), ONES if start >> i & 1 else 0, np.uint64) for i in range(width)]
            mine = self.fps[q]
            for p in range(64):
                # planes are numbered from the highest bit
                wanted = np.uint64(0) - (mine >> np.uint64(63 - p) & np.uint64(1))
                carry = self.planes[block, p] ^ wanted
                for i in range(width):
                    counters[i], carry = counters[i] ^ carry, counters[i] & carry
                over |= carry
                if p % 4 == 3:  # abandon blocks whose distances all exceed the radius
                    left = over != ONES
                    if not left.all():
                        q, block, over, mine = q[left], block[left], over[left], mine[left]
                        counters = [c[left] for c in counters]
                    if not len(q):
                        break
            if len(q):
                near = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                at, lanes = np.nonzero(near)
                yield q[at], self.row_of[block[at] * 64 + lanes]


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row linked to each of ``n`` rows, by way of any others."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            if np.array_equal(ra, rb):
                break
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(root, root[root]):
                root = root[root]
    return root


def _group_links(radius: int):
    """Links of sorted rows (c, k, a, b, fp): a spanning forest per group."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def forest(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, bool)
        planes = BitPlanes(fps.view(np.uint64), np.cumsum(new) - 1)
        root = spanning(len(fps), planes.links(radius))
        child = np.flatnonzero(root != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[child]), pa.array(fps[root[child]])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            held_k = np.concatenate([held_k, np.stack(cols[:4], axis=1)])
            held_f = np.concatenate([held_f, cols[4]])
            last = np.flatnonzero((held_k != held_k[-1]).any(axis=1)) if len(held_k) else []
            whole = last[-1] + 1 if len(last) else 0  # the last group may go on
            for part in _at_groups(held_k[:whole]):
                yield forest(held_k[part], held_f[part])
            held_k, held_f = held_k[whole:], held_f[whole:]
        if len(held_f):
            yield forest(held_k, held_f)

    return run


def _at_groups(keys: np.ndarray, rows: int = 8192) -> Iterator[slice]:
    """Slices of whole groups of about ``rows`` rows."""
    if not len(keys):
        return
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    a = 0
    for s in [*starts[1:].tolist(), len(keys)]:
        if s - a >= rows or s == len(keys):
            yield slice(a, s)
            a = s


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links between distinct fingerprints ``nodes(fp)`` that connect
    all fingerprints within ``radius`` bits, without every pair."""
    keys = F.array(*[
        F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k"))
        for c, m in enumerate(block_masks(blocks, radius))])
    keyed = nodes.select("fp", F.explode(keys).alias("x")).select("x.c", "x.k", "fp")
    # keys of two fingerprints or more; counts are combined before the shuffle
    shared = keyed.groupBy("c", "k").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    parts = F.ceil(F.col("m") / bucket).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    grouped = (
        keyed.join(shared, ["c", "k"]).withColumn("parts", parts).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("c", "k", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "fp")
        .repartition("c", "k", "a", "b").sortWithinPartitions("c", "k", "a", "b")
        .select(*(F.col(x).cast("long") for x in ("c", "k", "a", "b", "fp")))
    )
    return grouped.mapInArrow(_group_links(radius), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``, ``root`` the smallest
    node of its component: large-star and small-star rounds until the edges
    stand still.  Neighbours are only ever combined by their minimum."""
    def smallest(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = smallest(both.union(both.select("u", F.col("u").alias("v"))))
        return (both.filter("v > u").join(m, "u").filter("v != m")
                .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        m = smallest(down)
        moved = down.join(m, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(m.select("u", F.col("m").alias("v"))).distinct()

    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == mark:
            break
        mark = (state["n"], state["h"])
        now = materialize(small_star(large_star(now)), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, mark: Column | None = None) -> DataFrame:
    """(doc_id, mark, fp, root, component_id), a row per row of ``docs``;
    ``root`` names the component, component_id is its smallest doc_id."""
    found = materialize(fingerprints(docs, shingle, mark), "fingerprints")
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), radius))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select("fp", "root", "component_id")
    return found.join(classes, "fp").select("doc_id", "mark", "fp", "root", "component_id")


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component, with all columns: the smallest doc_id (null
    last), of equal ids the smallest hash of the row, of equal rows one."""
    columns = [quoted(c) for c in docs.columns]
    mark = F.xxhash64(*columns)
    found = near_duplicates(docs, shingle, radius, mark)
    best = found.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("b")
    ).select(F.col("b.doc_id").alias("_id"), F.col("b.mark").alias("_mark"))
    rows = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("id"), mark.alias("mark"))
    return (rows.join(best, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left_semi")
            .dropDuplicates(["id", "mark"]).select("row.*"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
