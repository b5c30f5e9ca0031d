"""Near-duplicate pages: set similarity of term sequences, by meet-in-the-middle ball hashing.

1. Every page with enough distinct sequences of ``width`` terms becomes a set of
   64-bit sequence hashes, and a fingerprint of words, each an anchor (some minhashes
   together) and ``BITS`` one-bit minhashes.  Two pages of similarity J have equal anchors
   of ``a`` minhashes with probability ``J ** a``, and a bit differs with probability
   ``(1 - J) / 2``.
2. Pages of equal sets form a class; only one representative goes on.
3. Each fingerprint word emits all its variants within half the radius
   (``RADIUS / 2`` = 1 flipped bit, so ``1 + BITS`` variants) under its anchor.  Two words
   of one anchor within the radius share a variant, so one equi-join on the variant
   finds every such pair.
4. Colliding pairs are deduplicated, dropped when their whole fingerprints are
   further apart than any pair at the threshold can plausibly be, and verified
   exactly on the full sets of the pages involved.

Pages of one site share menus and footers, so their J is about 0.1 and a fixed hash would
let a fixed share of their pairs collide: candidates would grow with the square of the
site.  Anchors therefore grow with the collection, one minhash for each factor of ten,
and the number of words with them, so that a pair at the threshold is missed with
probability ``MISSED`` at most at every size (see :class:`Design`): candidates a page stay
about the same, and variants a page grow by a third for each factor of ten.

No group is gathered in one task: classes are counted by partial aggregation,
variants meet in a sort-merge join that the engine splits when skewed, and
nothing is sent to the driver.

Defined cases: null or short pages take no part; repeated rows of one id count
once; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.visible import terms
from pagewright.session import cut, map_columns

BITS, RADIUS, MISSED = 16, 2, 5e-4
#: Bytes of an emitted variant in a shuffle, and those that a shuffle partition is meant to have.
VARIANT_BYTES, PARTITION_BYTES = 18, 128 << 20
#: Fingerprint words packed in one 64-bit column.
PACKED = 64 // BITS


@dataclass(frozen=True)
class Design:
    """Minhashes of an anchor and number of words for a collection of so many pages."""

    anchors: int
    tables: int
    #: Most bits in which the whole fingerprints of a pair at the threshold can differ: seven standard deviations above the mean.
    distance: int

    @classmethod
    def of(cls, pages: int, threshold: float) -> "Design":
        anchors = max(2, math.ceil(math.log10(max(1, pages))) - 4)
        flip = (1 - threshold) / 2
        within = sum(math.comb(BITS, k) * flip**k * (1 - flip) ** (BITS - k) for k in range(RADIUS + 1))
        tables = math.ceil(math.log(MISSED) / math.log(1 - threshold**anchors * within))
        bits = tables * BITS
        return cls(anchors, tables, math.ceil(bits * flip + 7 * math.sqrt(bits * flip * (1 - flip))))

    @property
    def names(self) -> tuple[list[str], list[str]]:
        """Columns of the fingerprint: two 32-bit anchors in each of the first, ``PACKED`` words in each of the others."""
        return [f"a{t}" for t in range(-(-self.tables // 2))], [f"w{t}" for t in range(-(-self.tables // PACKED))]


_CACHE = 400_000
#: Bits of the bitmap of involved ids: 2^17 words of 64 bits, 1 MB whatever the input.
FILTER_WORDS = 1 << 17


def _mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit words (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _multipliers(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Shingler:
    """Distinct sequences of ``width`` consecutive terms of a page, as sorted 64-bit hashes."""

    def __init__(self, width: int):
        self.width, self.known = width, {}
        self.factors = _multipliers(width)

    def __call__(self, content: str | None) -> np.ndarray:
        words = terms(content)
        known = self.known
        if len(known) > _CACHE:
            known.clear()
        for word in set(words):
            if word not in known:
                known[word] = xxhash.xxh3_64_intdigest(word)
        n = len(words) - self.width + 1
        if n < 1:
            return np.empty(0, dtype=np.uint64)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        acc = h[:n] * self.factors[0]
        for k in range(1, self.width):
            acc = _mix(acc) + h[k : k + n] * self.factors[k]
        acc = _mix(acc)
        acc.sort()
        return acc[np.concatenate(([True], acc[1:] != acc[:-1]))]


def _fingerprints(width: int, least: int, design: Design):
    a, t = design.anchors, design.tables
    anchor_names, word_names = design.names

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        shingle = Shingler(width)
        factors = ((_multipliers(t * (a + BITS) + 8)[8:, None]) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        weights = (np.uint64(1) << np.arange(64, dtype=np.uint64)).reshape(1, 64)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("id", "n", "k1", "k2", *anchor_names, *word_names)}
            for page_id, content in zip(batch["id"], batch["content"]):
                s = shingle(content)
                if len(s) < max(1, least):
                    continue
                low = (factors * (s >> np.uint64(32)).astype(np.uint32)[None, :]).min(axis=1)
                anchors = np.zeros(2 * len(anchor_names), dtype=np.uint32)
                mixed = np.zeros(t, dtype=np.uint64)
                for column in low[: t * a].reshape(t, a).T:
                    mixed = _mix(mixed + column.astype(np.uint64) + np.uint64(1))
                anchors[:t] = (mixed >> np.uint64(32)).astype(np.uint32)
                bits = np.zeros(64 * len(word_names), dtype=np.uint64)
                bits[: t * BITS] = (low[t * a :] >> np.uint32(12)) & np.uint32(1)
                words = (bits.reshape(len(word_names), 64) * weights).sum(axis=1, dtype=np.uint64).astype(np.int64)
                for name, value in (("id", page_id), ("n", len(s)), ("k1", int(s.sum(dtype=np.uint64).astype(np.int64))), ("k2", int(np.bitwise_xor.reduce(_mix(s + np.uint64(11))).astype(np.int64)))):
                    out[name].append(value)
                for names, values in ((anchor_names, anchors.view(np.int64)), (word_names, words)):
                    for name, value in zip(names, values):
                        out[name].append(int(value))
            yield out

    return run


def _variants(design: Design):
    """Keys of all variants: anchor, word and table mixed to 64 bits; a chance clash of keys only costs a candidate."""
    anchor_names, word_names = design.names

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        flips = np.concatenate([[0], np.int64(1) << np.arange(BITS, dtype=np.int64)]).astype(np.uint64)
        for batch in batches:
            ids = np.array(batch["id"], dtype=np.int64)
            packed = np.array([batch[c] for c in word_names], dtype=np.int64).reshape(len(word_names), len(ids)).astype(np.uint64)
            anchors = np.ascontiguousarray(np.array([batch[c] for c in anchor_names], dtype=np.int64).reshape(len(anchor_names), len(ids)).T).view(np.uint32).reshape(len(ids), 2 * len(anchor_names)).astype(np.uint64)
            for t in range(design.tables):
                word = (packed[t // PACKED] >> np.uint64(BITS * (t % PACKED))) & np.uint64((1 << BITS) - 1)
                anchor = _mix((anchors[:, t] << np.uint64(16)) + np.uint64(t + 1))
                key = _mix(anchor[:, None] ^ (word[:, None] ^ flips[None, :])).astype(np.int64).ravel()
                yield {"key": key, "id": np.repeat(ids, BITS + 1), "flip": np.tile(np.arange(BITS + 1, dtype=np.int16), len(ids))}

    return run


def _sets(width: int):
    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        shingle = Shingler(width)
        for batch in batches:
            for i in range(0, len(batch["id"]), 250):
                yield {"id": batch["id"][i : i + 250], "items": [shingle(c).astype(np.int64) for c in batch["content"][i : i + 250]]}

    return run


def _place(key: Column) -> tuple[Column, Column]:
    """Word and bit of an id in the bitmap."""
    h = F.xxhash64(key)
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(FILTER_WORDS - 1)).cast("int"), h.bitwiseAND(F.lit(63)).cast("int")


@contextmanager
def shuffle_partitions(spark: SparkSession, size: int) -> Iterator[None]:
    """Shuffles of a known size get as many partitions as keep each near ``PARTITION_BYTES``; never fewer than the session has."""
    name = "spark.sql.shuffle.partitions"
    usual = int(spark.conf.get(name))
    spark.conf.set(name, str(max(usual, -(-size // PARTITION_BYTES))))
    try:
        yield
    finally:
        spark.conf.set(name, str(usual))


class NearDuplicates:
    """``members`` (id, class_id), ``links`` (a, b of class representatives, a < b) and what follows from them."""

    def __init__(self, pages: DataFrame, id_col: str, text_col: str, width: int = 5, threshold: tuple[int, int] = (4, 5), least: int = 1):
        self.top, self.bottom = threshold
        self.width = width
        self.ids = pages.select(F.col(id_col).cast("long").alias("id")).where("id is not null")
        self.pages = pages.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("content")).where("id is not null and content is not null")
        self.n_pages = pages.count()
        self.design = Design.of(self.n_pages, self.top / self.bottom)
        names = sum(self.design.names, [])
        marks = map_columns(self.pages, ["id", "content"], _fingerprints(width, least, self.design), "id long, n int, k1 long, k2 long, " + ", ".join(f"{c} long" for c in names))
        self.marks = cut(marks)
        # equal sets have equal words, so any of them stands for the class
        self.classes = self.marks.groupBy("k1", "k2", "n").agg(F.min("id").alias("class_id"), *(F.first(c).alias(c) for c in names))

    def members(self) -> DataFrame:
        """``(id, class_id)``: pages of equal sets share a class."""
        return self.marks.select("id", "k1", "k2", "n").distinct().join(self.classes.select("k1", "k2", "n", "class_id"), ["k1", "k2", "n"]).select("id", "class_id")

    def candidates(self) -> DataFrame:
        anchors, words = self.design.names
        reps = self.classes.select(F.col("class_id").alias("id"), *anchors, *words)
        emitted = map_columns(reps, ["id", *anchors, *words], _variants(self.design), "key long, id long, flip short")
        left = emitted.select("key", F.col("id").alias("a"), F.col("flip").alias("fa"))
        right = emitted.select("key", F.col("id").alias("b"), F.col("flip").alias("fb"))
        # two equal words share all their variants: only the unflipped one counts
        met = left.join(right, "key").where("a < b and (fa <> fb or fa = 0)").select("a", "b").distinct()
        for side in ("a", "b"):
            met = met.join(reps.select(F.col("id").alias(side), *(F.col(w).alias(f"{side}_{w}") for w in words)), side)
        distance: Column = F.lit(0)
        for w in words:
            distance = distance + F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}")))
        return met.where(distance <= self.design.distance).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets reach the threshold, with the sizes compared exactly.

        Contents are shuffled for the exact semi-join only after a bitmap of the
        involved ids has let them through; the bitmap has a fixed size, so it can be
        broadcast at any scale (when it fills up it only filters less)."""
        involved = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        place, bit = _place(F.col("id"))
        words = involved.groupBy(place.alias("place")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
        near = self.pages.withColumn("place", place).join(F.broadcast(words), "place").where(F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bit)) != 0)
        # an inner join with the distinct ids: a semi-join would be pushed below the bitmap and shuffle every content
        items = cut(map_columns(near.select("id", "content").join(involved, "id"), ["id", "content"], _sets(self.width), "id long, items array<long>").dropDuplicates(["id"]))
        both = pairs
        for side in ("a", "b"):
            both = both.join(items.select(F.col("id").alias(side), F.col("items").alias(f"items_{side}")), side)
        shared = F.size(F.array_intersect("items_a", "items_b"))
        union = F.size("items_a") + F.size("items_b") - shared
        return both.where(shared * self.bottom >= union * self.top).select("a", "b")

    def links(self) -> DataFrame:
        """Every link between class representatives, a < b.  Their number is part of the result: no link is left out."""
        with shuffle_partitions(self.ids.sparkSession, self.n_pages * self.design.tables * (BITS + 1) * VARIANT_BYTES):
            candidates = cut(self.candidates())
        return cut(self.verified(candidates))

    def pairs(self, links: DataFrame) -> DataFrame:
        """All pairs of pages: members of linked classes, and members of one class."""
        members = cut(self.members())
        left = members.select(F.col("id").alias("x"), F.col("class_id").alias("a"))
        right = members.select(F.col("id").alias("y"), F.col("class_id").alias("b"))
        across = links.join(left, "a").join(right, "b").select(F.least("x", "y").alias("page_id_a"), F.greatest("x", "y").alias("page_id_b"))
        within = left.join(right.withColumnRenamed("b", "a"), "a").where("x < y").select(F.col("x").alias("page_id_a"), F.col("y").alias("page_id_b"))
        return across.unionByName(within)

    def groups(self, links: DataFrame) -> DataFrame:
        """One row per page: its class, the number of linked classes, and the smallest id of its group.
        Pages that can't take part (null, empty, too short) are their own class and group."""
        members = self.ids.distinct().join(self.members(), "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))
        ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("class_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("class_id"), F.col("a").alias("other")))).alias("e")).select("e.*")
        degree = ends.groupBy("class_id").agg(F.count("*").alias("n_links"))
        root = components(links)
        return (
            members.join(degree, "class_id", "left")
            .join(root.select(F.col("node").alias("class_id"), "root"), "class_id", "left")
            .select(F.col("id").alias("page_id"), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "class_id").alias("group_id"))
        )


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of the undirected links (a, b): alternating large-star and
    small-star steps until nothing changes; each step is a group-by on one end and
    is written to the shared checkpoint folder."""
    edges = cut(links.select("a", "b").where("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours larger than the node point to the smallest neighbour
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large)
        # small star: the node and its smaller neighbours point to the smallest
        small_side = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = small_side.groupBy("a").agg(F.min("b").alias("m"))
        small = small_side.join(low, "a")
        small = small.select(F.col("b").alias("x"), "m").unionByName(small.select(F.col("a").alias("x"), "m")).where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()
        small = cut(small)
        if small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty():
            return small.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(small.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        edges = small
