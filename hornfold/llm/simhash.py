"""SimHash near-duplicates: fingerprints, BK-trees over shards of them, and connected components.

Two fingerprints within R bits agree on all but R of R+3 blocks of bits, so they meet in the shard of
at least one choice of three blocks. Each shard's distinct fingerprints form a BK-tree (children
keyed by their Hamming distance to the parent), and a search follows only edges within the radius.
No tree grows past a fixed number of nodes: a larger shard is dealt to several trees, and each
fingerprint searches all trees of its shard. Trees go to the tasks of their shards by a shuffle; a
broadcast of all trees would have no size bound.

``similar`` looks for pairs that share 0.8 of their five-word shingles. Fingerprints of the distinct
shingles differ in about 10 of 64 bits then, too many for shards by equal bits; so there the shards are
bands of minimum hashes, which such pairs share with near certainty, the radius is one that hardly any
such pair exceeds, and the trees' finds are checked on the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornfold.llm.common import Run, partitions, text_or_empty

RADIUS = 2
SHINGLE = 3
SEED = 42
TREE_NODES = 2048
KEPT_BLOCKS = 3
# Of ``similar``: all bands miss one pair in 1,300 at a similarity of 0.8, the radius one in a million at most.
SIMILARITY = 0.8
SIMILAR_SHINGLE = 5
RADIUS_MISSES = 1e-6
#: Sets of so few shingles are checked whatever the distance of their fingerprints.
FEW_SHINGLES = 16
SIMILAR_TREE = 1024
BANDS, BAND_HASHES = 10, 3
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = "\t\n\v\f\r "
TO_SPACE = str.maketrans({c: " " for c in SPACES[:-1]}) | LOWER
SLICE = 4096


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bit i is 1 if it is 1 in over half of the shingles' hashes, repeats included; no words: 0."""
    words = [w for w in (text or "").translate(TO_SPACE).split(" ") if w]
    if not words:
        return 0
    count = max(1, len(words) - size + 1)
    if count == 1:
        hashes = [xxhash.xxh64_intdigest(" ".join(words).encode(), SEED)]
    else:
        # Offsets into the joined words: a shingle is a slice of its UTF-8 bytes.
        data = [w.encode() for w in words]
        joined = b" ".join(data)
        ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1)
        starts = np.concatenate([[0], ends[:-1]])[:count].tolist()
        stops = (ends[size - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i:j], SEED) for i, j in zip(starts, stops, strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is 1 in over half of ``hashes``."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed 64-bit integer."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, fp long")


class BKTree:
    """Values by Hamming distance. ``group`` joins those that are linked through members of this tree."""

    def __init__(self, radius: int):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def search(self, value: int) -> list[int]:
        """Nodes within the radius."""
        if not self.values:
            return []
        found, open_, radius = [], [0], self.radius
        values, children = self.values, self.children
        while open_:
            node = open_.pop()
            distance = (values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            below = children[node]
            if below:
                for edge in range(max(1, distance - radius), distance + radius + 1):
                    if edge in below:
                        open_.append(below[edge])
        return found

    def insert(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        node, new = 0, len(self.values) - 1
        while node != new:
            node = self.children[node].setdefault((self.values[node] ^ value).bit_count(), new)


class WideTree(BKTree):
    """For radii above the number of a node's children: it goes through these, not through the distances."""

    def search(self, value: int) -> list[int]:
        if not self.values:
            return []
        found, open_, radius = [], [0], self.radius
        values, children = self.values, self.children
        while open_:
            node = open_.pop()
            distance = (values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            for edge, child in children[node].items():
                if -radius <= edge - distance <= radius:
                    open_.append(child)
        return found


class Forest:
    """One shard's tree: links as a spanning forest, so a dense group of n gives n - 1 links."""

    def __init__(self, radius: int):
        self.tree, self.parent = BKTree(radius), []

    def root(self, node: int) -> int:
        while self.parent[node] != node:
            self.parent[node] = node = self.parent[self.parent[node]]
        return node

    def grow(self, value: int) -> None:
        near = self.tree.search(value)
        self.tree.insert(value)
        self.parent.append(len(self.parent))
        for node in near:
            self.parent[self.root(node)] = self.root(len(self.parent) - 1)

    def links(self) -> list[tuple[int, int]]:
        roots = [self.root(i) for i in range(len(self.parent))]
        return [(self.tree.values[i], self.tree.values[r]) for i, r in enumerate(roots) if i != r]

    def links_of(self, value: int) -> list[tuple[int, int]]:
        """A link to each group of the tree that ``value`` touches."""
        return [(value, self.tree.values[r]) for r in {self.root(i) for i in self.tree.search(value)}]


def shard_keys(radius: int, value: Column) -> Column:
    """The shards of a fingerprint: one for each choice of blocks that are to agree."""
    blocks = radius + KEPT_BLOCKS
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    keys = []
    for no, chosen in enumerate(combinations(masks, KEPT_BLOCKS)):
        mask = sum(chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(no).alias("choice"), value.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


def links(run: Run, distinct: DataFrame, radius: int, tree_nodes: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints within ``radius`` that join the same ones as all links do."""
    sharded = run.table(distinct.select("fp", F.explode(shard_keys(radius, F.col("fp"))).alias("key")), "sharded")
    counted = sharded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    trees = F.ceil(F.col("n") / tree_nodes).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    # A member grows its own tree and searches those after it.
    members = (
        sharded.join(counted.select("key", trees.alias("trees")), "key")
        .withColumn("own", own)
        .withColumn("tree", F.explode(F.sequence(F.col("own"), F.col("trees") - 1)))
        .select("key", "tree", (F.col("own") != F.col("tree")).alias("asks"), "fp")
    )
    dealt = members.repartition(partitions(run.spark), "key", "tree").sortWithinPartitions("key", "tree", "asks", "fp")
    dealt = dealt.select("key.choice", "key.bits", "tree", "asks", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, forest, found = None, Forest(radius), []
        for batch in batches:
            for choice, bits, tree, asks, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (choice, bits, tree) != shard:
                    found += forest.links()
                    shard, forest = (choice, bits, tree), Forest(radius)
                value = fp & 0xFFFFFFFFFFFFFFFF
                if asks:
                    found += forest.links_of(value)
                else:
                    forest.grow(value)
            yield pair_batch(found)
            found = []
        yield pair_batch(forest.links())

    return dealt.mapInArrow(search, "a long, b long").distinct()


def pair_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def components(run: Run, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` (fp, id) with each id lowered to the smallest of its component.

    Every round, each node takes the smallest label among its neighbours, and its old label's edge
    moves up to the new one (large-star and small-star), so paths halve instead of shrinking by one.
    Nodes without links take no part.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    pairs = run.table(both, "links")
    turn = 0
    while True:
        turn += 1
        # Large star: neighbours above a node link to the smallest neighbour of it.
        around = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = run.table(large, f"large-{turn}")
        # Small star: a node and its neighbours below link to the smallest of them.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(low, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u > v")
            .distinct()
        )
        after = run.table(small, f"small-{turn}")
        changed = after.exceptAll(pairs).isEmpty() and pairs.exceptAll(after).isEmpty()
        run.remove("links" if turn == 1 else f"small-{turn - 1}")
        run.remove(f"large-{turn}")
        pairs = after
        if changed:
            break
    # Stars now: u links to the root v of its component.
    rooted = labels.join(pairs.withColumnRenamed("u", "fp"), "fp", "left").withColumn("v", F.coalesce("v", "fp"))
    rooted = run.table(rooted, "rooted")
    smallest = rooted.groupBy("v").agg(F.min("id").alias("component_id"))
    return rooted.join(smallest, "v").select("fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Rows link if their fingerprints differ in ``radius`` bits or fewer; component_id is the smallest
    doc_id reachable, the row's own included. Null and empty texts and texts without words have the
    fingerprint zero. A null doc_id is never the smallest unless there is no other. Repeated rows
    share their fingerprint and component. An empty table gives an empty result. Columns beside
    doc_id and text are not looked at. Equal fingerprints are merged before any comparison, so a
    group of copies of any size counts as one.
    """
    run = Run(docs.sparkSession, "simhash")
    marked = run.table(fingerprints(docs), "fingerprints")
    distinct = run.table(marked.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct")
    edges = links(run, distinct, radius, tree_nodes)
    found = components(run, edges, distinct)
    return marked.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


MIX = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(SEED)
ADDED = _random.integers(0, 1 << 63, (BANDS * BAND_HASHES, 1), np.uint64)
TIMES = _random.integers(0, 1 << 63, (BANDS * BAND_HASHES, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(32))) * MIX
    return hashes ^ (hashes >> np.uint64(29))


def folded(columns: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of ``columns``, in their order."""
    found = columns[0]
    for column in columns[1:]:
        found = mixed(found) + column
    return mixed(found)


def shingles(text: bytes, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, repeats included; of all words where there are fewer; none without words."""
    words = text.lower().split()  # of bytes: only A-Z and only ASCII white space
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if not words:
        return hashes
    size = min(size, len(words))
    count = len(words) - size + 1
    return folded([hashes[i : i + count] for i in range(size)])


def bands(distinct: np.ndarray) -> list[int]:
    """A key for each band: the minima of its permutations, taken together. None without shingles."""
    if not len(distinct):
        return []
    least = np.full(BANDS * BAND_HASHES, np.iinfo(np.uint64).max)
    for at in range(0, len(distinct), SLICE):
        least = np.minimum(least, ((distinct[at : at + SLICE] ^ ADDED) * TIMES).min(1))
    columns = [np.arange(BANDS, dtype=np.uint64), *least.reshape(BANDS, BAND_HASHES).T]
    return folded(columns).view(np.int64).tolist()


def compact(distinct: np.ndarray) -> np.ndarray:
    """The upper halves of hashes: within a pair of texts they tell shingles apart as well, at half the size."""
    return np.unique((distinct >> np.uint64(32)).astype("<u4"))


def described(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, ``at`` (a hash of the text), ``same`` (digest of the set of shingles), and of that set fp and bands."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "at", "same", "fp", "bands"]
        for batch in batches:
            same, fps, keys = [], [], []
            for text in batch.column(2).cast(pa.binary()):
                distinct = np.unique(shingles(text.as_py(), size))
                same.append(xxhash.xxh128_digest(distinct.tobytes()))
                fps.append(majority(distinct))
                keys.append(bands(distinct))
            columns = [batch.column(0), batch.column(1), pa.array(same, pa.binary())]
            columns += [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()), text_or_empty())
    return rows.mapInArrow(of, f"doc_id {kind}, at long, same binary, fp long, bands array<long>")


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """node and ``set``, the distinct shingles of its text as sorted 32-bit hashes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [compact(np.unique(shingles(t.as_py(), size))).tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "set"])

    return rows.select("node", text_or_empty()).mapInArrow(of, "node long, set binary")


def wide_radius(similarity: float, misses: float = RADIUS_MISSES) -> int:
    """Bits that fingerprints of sets this similar differ in at most, but for a share ``misses`` of the pairs.

    A bit of two majorities over random signs with correlation c differs with probability acos(c) / pi,
    and c is least where the sets are of one size; ties add up to 0.005 above FEW_SHINGLES shingles.
    """
    p, above = acos(min(1.0, 2 * similarity / (1 + similarity))) / pi + 0.005, 0.0
    for bits in range(64, 0, -1):
        above += comb(64, bits) * p**bits * (1 - p) ** (64 - bits)
        if above > misses:
            return bits
    return 0


class CheckedForest(Forest):
    """A forest of texts: what the tree finds counts only if the texts' sets are similar enough."""

    def __init__(self, radius: int, similarity: float):
        super().__init__(radius)
        self.tree = WideTree(radius)
        self.similarity = similarity
        self.nodes: list[int] = []
        self.sets: list[np.ndarray] = []

    def alike(self, a: np.ndarray, b: np.ndarray) -> bool:
        if min(len(a), len(b)) < self.similarity * max(len(a), len(b)):
            return False
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return shared >= self.similarity * (len(a) + len(b) - shared)

    def touched(self, value: int, own: np.ndarray) -> set[int]:
        """The groups, by root, that hold a text like ``own``; nearest fingerprints are tried first."""
        values, roots = self.tree.values, set()
        near = range(len(values)) if len(own) <= FEW_SHINGLES else self.tree.search(value)
        for node in sorted(near, key=lambda n: (values[n] ^ value).bit_count()):
            root = self.root(node)
            if root not in roots and self.alike(own, self.sets[node]):
                roots.add(root)
        return roots

    def add(self, node: int, value: int, own: np.ndarray, join: bool) -> None:
        """Plant a text; where ``join`` is false the links inside this tree are found elsewhere."""
        roots = self.touched(value, own) if join else set()
        self.tree.insert(value)
        new = len(self.parent)
        self.parent.append(new)
        self.nodes.append(node)
        self.sets.append(own)
        for root in roots:
            self.parent[root] = new

    def ask(self, node: int, value: int, own: np.ndarray) -> list[tuple[int, int]]:
        """A link to each group that a text from outside touches; through it these are one group from now on."""
        roots = sorted(self.touched(value, own))
        for root in roots[1:]:
            self.parent[root] = roots[0]
        return [(node, self.nodes[root]) for root in roots]

    def node_links(self) -> list[tuple[int, int]]:
        roots = [self.root(i) for i in range(len(self.parent))]
        return [(self.nodes[i], self.nodes[r]) for i, r in enumerate(roots) if i != r]


def checked_links(members: DataFrame, sets: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Links (a, b) between nodes that share a shard (``key``) and are similar.

    A shard of several trees is a set of blocks: one for each tree, which links its own members, and
    one for each two trees, where the members of the first search the second. So no block has more
    rows than two trees have nodes.
    """
    trees, own = F.col("trees"), F.col("own")
    block = F.transform(
        F.sequence(F.lit(0), trees - 1),
        lambda i: F.struct(F.least(i, own).alias("low"), F.greatest(i, own).alias("high"), (i > own).alias("asks")),
    )
    blocks = members.join(sets, "node").withColumn("block", F.explode(block))
    dealt = (
        blocks.select("key", "block.low", "block.high", "block.asks", "node", "fp", "set")
        .repartition(partitions(members.sparkSession), "key", "low", "high")
        .sortWithinPartitions("key", "low", "high", "asks", "node")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, forest, found = None, CheckedForest(radius, similarity), []
        for batch in batches:
            for key, low, high, asks, node, fp, data in zip(*batch.columns, strict=True):
                here = (key.as_py(), low.as_py(), high.as_py())
                if here != block:
                    found += forest.node_links()
                    block, forest = here, CheckedForest(radius, similarity)
                value, own = fp.as_py() & 0xFFFFFFFFFFFFFFFF, np.frombuffer(data.as_py(), "<u4")
                if asks.as_py():
                    found += forest.ask(node.as_py(), value, own)
                else:
                    forest.add(node.as_py(), value, own, here[1] == here[2])
            yield pair_batch(found)
            found = []
        yield pair_batch(forest.node_links())

    return dealt.mapInArrow(search, "a long, b long").distinct()


def similar(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    radius: int | None = None,
    size: int = SIMILAR_SHINGLE,
    tree_nodes: int = SIMILAR_TREE,
) -> DataFrame:
    """Per row of ``docs``: doc_id, component_id, the smallest doc_id reachable over similar texts.

    Two texts are similar if they share ``similarity`` of all their distinct shingles of ``size``
    words (A-Z in lower case; a shorter text is one shingle). Without a ``radius``, it is that of the
    similarity. Null and empty texts and texts without
    words are alike. A null doc_id is never the smallest unless there is no other. Texts with the
    same shingles are merged first, so a group of copies of any size counts as one. An empty table
    gives an empty result. Columns beside doc_id and text are not looked at.
    """
    run = Run(docs.sparkSession, "similar")
    marked = run.table(described(docs, size), "described")
    distinct = marked.groupBy("same").agg(
        F.min("doc_id").alias("id"),
        F.min(F.struct("doc_id", "at")).alias("one"),
        F.any_value("fp").alias("fp"),
        F.any_value("bands").alias("bands"),
    )
    distinct = run.table(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
    sharded = run.table(distinct.select("node", "fp", F.explode("bands").alias("key")), "sharded")
    counted = sharded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    trees = F.ceil(F.col("n") / tree_nodes).cast("int").alias("trees")
    members = sharded.join(counted.select("key", trees), "key")
    members = run.table(members.withColumn("own", F.pmod(F.xxhash64("node"), "trees").cast("int")), "members")
    # Only texts that share a shard with another are looked at again.
    wanted = distinct.join(members.select("node"), "node", "left_semi").select("node", "one.doc_id", "one.at")
    texts = docs.select("doc_id", "text").withColumn("at", F.xxhash64(text_or_empty()))
    texts = texts.join(wanted, (texts["at"] == wanted["at"]) & texts["doc_id"].eqNullSafe(wanted["doc_id"]))
    sets = shingle_sets(texts.select("node", "text"), size).groupBy("node").agg(F.any_value("set").alias("set"))
    sets = run.table(sets, "sets")
    edges = checked_links(members, sets, wide_radius(similarity) if radius is None else radius, similarity)
    found = components(run, edges, distinct.select(F.col("node").alias("fp"), "id"))
    found = distinct.select("same", F.col("node").alias("fp")).join(found, "fp")
    return marked.join(found, "same").select("doc_id", "component_id")


def representatives(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` whose doc_id is that of their ``similar`` component; of one without any doc_id, all."""
    found = similar(docs, **settings).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = found.select(F.col("doc_id").alias("__doc")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["__doc"]), "left_semi")
