"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

One inserted letter raises one count by one; one replaced letter raises one count and lowers another.
So of two words one edit apart the vectors differ by one up and one down at most, an L1 distance of two
at most, and a search crosses at most one splitting plane upwards and one downwards. For each word
length a top tree, fitted on a bounded sample, cuts the space into regions; Spark deals every word to
its own region and to those that its box touches, among words of its length and of one letter more. In
each region a k-d tree is searched for all its visitors together, and the letters' order is checked.
The sample only places the cuts: any cuts give the same pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornfold.llm.common import Run, partitions, utf8_crc32

RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS = 7
LEAST_TIMES = 2
#: A run loses a letter if this divides its hash.
DAMAGED = 31
#: A word is the form of a near one that it is so many times as frequent as.
RATIO = 10
#: Words that the top trees' cuts are fitted on, of all lengths together.
SAMPLE = 60_000
#: Words that a region holds, about, and points of a leaf in its tree.
REGION = 4096
LEAF = 24
#: Counts: one for each letter a to z, and six for the accented ones by code point.
SIZE = 32
FOLD = np.array([c - 97 if 97 <= c <= 122 else 26 + c % 6 for c in range(256)], np.int64)
#: Visitors searched for together, and compared with a leaf at a time.
TOGETHER, SLICE = 65_536, 4096
# A weight for each letter: the weighted sum of a vector tells, modulo 2^16, most that are too far apart.
WEIGHTS = np.random.default_rng(12).integers(0, 1 << 16, SIZE, np.uint16)
ONE_MORE = np.zeros(1 << 16, bool)
ONE_MORE[WEIGHTS] = True
ONE_OTHER = np.zeros(1 << 16, bool)
ONE_OTHER[(WEIGHTS[:, None] - WEIGHTS[None, :]).ravel()] = True


def runs(text: Column, least: int) -> Column:
    """The maximal runs of letters of ``least`` code points or more."""
    return F.regexp_extract_all(text, F.lit(f"{RUN}{{{least},}}"), F.lit(0))


def lowered(run: Column) -> Column:
    """Only A-Z in lower case."""
    return F.when(run.rlike("[A-Z]"), F.translate(run, UPPER, LOWER)).otherwise(run)


def damaged(doc_id: Column, run: Column) -> Column:
    """The run, without one code point where its hash says so."""
    h = utf8_crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    size = F.char_length(run)
    at = (h % size).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, size))
    return F.when(h % DAMAGED == 0, cut).otherwise(run)


def words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES) -> DataFrame:
    """word and n, its occurrences in all texts; counted in each task before the shuffle."""
    each = docs.select("doc_id", F.explode(runs(F.col("text"), least_letters)).alias("run"))
    each = each.withColumn("run", lowered(F.col("run")))
    found = each.select(damaged(F.col("doc_id"), F.col("run")).alias("word"))
    found = found.where(F.char_length("word") >= least_letters)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_times)


def vectors(found: list[str]) -> np.ndarray:
    """The letter counts of each word, a row each."""
    data = np.frombuffer("".join(found).encode("latin-1"), np.uint8)
    owner = np.repeat(np.arange(len(found)), np.fromiter(map(len, found), np.int64, len(found)))
    counts = np.bincount(owner * SIZE + FOLD[data], minlength=len(found) * SIZE)
    return np.minimum(counts, 32_000).astype(np.int16).reshape(len(found), SIZE)


@dataclass
class Tree:
    """A k-d tree as lists: the letter and count a node splits at (left: up to the count), or its leaf's number."""

    letter: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    members: list[np.ndarray] = field(default_factory=list)

    def visit(self, queries: np.ndarray, raised: bool, lowered: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, queries) whose boxes touch it: one count higher if ``raised``, one lower if ``lowered``."""
        n = len(queries)
        open_ = [(0, np.arange(n), np.full(n, raised), np.full(n, lowered))]
        while open_:
            node, rows, up, down = open_.pop()
            if self.leaf[node] >= 0:
                yield self.leaf[node], rows
                continue
            over = queries[rows, self.letter[node]] - self.count[node]
            # Left holds counts up to the split: a query one above it gets there by losing one letter.
            goes = (over <= 0) | ((over == 1) & down)
            if goes.any():
                open_.append((self.left[node], rows[goes], up[goes], (down & (over <= 0))[goes]))
            goes = (over > 0) | ((over == 0) & up)
            if goes.any():
                open_.append((self.right[node], rows[goes], (up & (over > 0))[goes], down[goes]))

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        found = np.zeros(len(points), np.int64)
        for leaf, rows in self.visit(points, False, False):
            found[rows] = leaf
        return found


def grow(points: np.ndarray, most: int) -> Tree:
    """Split at the letter that varies most until a leaf has ``most`` points or only equal ones."""
    tree = Tree()

    def node() -> int:
        for column in (tree.letter, tree.count, tree.left, tree.right, tree.leaf):
            column.append(-1)
        return len(tree.leaf) - 1

    open_ = [(node(), np.arange(len(points)))]
    while open_:
        at, rows = open_.pop()
        own = points[rows]
        letter = int(own.var(0).argmax()) if len(rows) > most else 0
        values = np.sort(own[:, letter]) if len(rows) > most else own[:0, 0]
        if len(rows) <= most or values[0] == values[-1]:
            tree.leaf[at] = len(tree.members)
            tree.members.append(rows)
            continue
        count = int(values[(len(values) - 1) // 2])
        if count == values[-1]:  # the upper half is all alike: cut below it
            count = int(values[values < count][-1])
        tree.letter[at], tree.count[at] = letter, count
        low = own[:, letter] <= count
        tree.left[at], tree.right[at] = node(), node()
        open_ += [(tree.left[at], rows[low]), (tree.right[at], rows[~low])]
    return tree


def top_trees(vocabulary: DataFrame, sample: int, region: int) -> dict[int, Tree]:
    """A tree for each length, with leaves of about ``region`` words, from at most about ``sample`` words."""
    total = vocabulary.count()
    share = min(1.0, sample / max(1, total))
    chosen = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    by_length: dict[int, list[str]] = {}
    for row in vocabulary.where(chosen).select("word").toLocalIterator():
        by_length.setdefault(len(row["word"]), []).append(row["word"])
    trees = {}
    for length, found in by_length.items():
        trees[length] = grow(vectors(found), max(1, int(region * share)))
        trees[length].members = []
    return trees


def is_edit(a: str, b: str) -> bool:
    """Is b, not the same as a and not shorter, one inserted or replaced code point away?"""
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(b) == n else a[i:] == b[i + 1 :]


def near_in_region(points: list[str], tree: Tree, at: np.ndarray, asking: list[str], longer: bool) -> list[tuple[int, int]]:
    """(visitor, point) one edit apart; ``longer``: points have one letter more than visitors."""
    queries = vectors(asking)
    sums, own_sums = queries.astype(np.uint16) @ WEIGHTS, at.astype(np.uint16) @ WEIGHTS
    may_be = ONE_MORE if longer else ONE_OTHER
    found = []
    for leaf, rows in tree.visit(queries, True, not longer):
        members = tree.members[leaf]
        for i in range(0, len(rows), SLICE):
            part = rows[i : i + SLICE]
            r, c = np.nonzero(may_be[own_sums[members][None, :] - sums[part][:, None]])
            r, c = part[r], members[c]
            close = np.abs(queries[r] - at[c]).sum(1) <= (1 if longer else 2)
            for q, p in zip(r[close].tolist(), c[close].tolist(), strict=True):
                if (longer or asking[q] < points[p]) and is_edit(asking[q], points[p]):
                    found.append((q, p))
    return found


def deal(vocabulary: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """length, region, asks (0: a point, 1: a visitor as long, 2: one letter shorter), word, n."""
    whole = grow(np.zeros((0, SIZE), np.int16), 1)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            by_length: dict[int, list[int]] = {}
            for i, word in enumerate(found):
                by_length.setdefault(len(word), []).append(i)
            for length, rows in by_length.items():
                row, points = np.array(rows), vectors([found[i] for i in rows])
                for asks, size in ((0, length), (1, length), (2, length + 1)):
                    # A length that the sample lacks is one region.
                    for region, some in trees.get(size, whole).visit(points, asks > 0, asks == 1):
                        taken = batch.take(pa.array(row[some], pa.int64()))
                        columns = [np.full(len(some), v, np.int32) for v in (size, region, asks)]
                        yield pa.RecordBatch.from_arrays(
                            [*map(pa.array, columns), *taken.columns], names=["length", "region", "asks", "word", "n"]
                        )

    return vocabulary.select("word", "n").mapInArrow(of, "length int, region int, asks int, word string, n long")


def near_pairs(vocabulary: DataFrame, sample: int = SAMPLE, region: int = REGION) -> DataFrame:
    """a, a_n, b, b_n: every pair of words one edit apart, once."""
    dealt = deal(vocabulary, top_trees(vocabulary, sample, region))
    keys = ["length", "region", "asks"]
    dealt = dealt.repartition(partitions(vocabulary.sparkSession), "length", "region").sortWithinPartitions(*keys)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, points, numbers, tree, at = None, [], [], None, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            size = batch.num_rows
            places = list(zip(*columns[:3], strict=True))
            start = 0
            while start < size:
                length, no, asks = places[start]
                stop = start
                while stop < size and places[stop] == places[start] and stop - start < TOGETHER:
                    stop += 1
                some, times = columns[3][start:stop], columns[4][start:stop]
                if (length, no) != here:
                    here, points, numbers, tree = (length, no), [], [], None
                if asks == 0:
                    points += some
                    numbers += times
                elif points:
                    if tree is None:
                        at = vectors(points)
                        tree = grow(at, LEAF)
                    found = near_in_region(points, tree, at, some, asks == 2)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([some[q] for q, _ in found], pa.string()),
                            pa.array([times[q] for q, _ in found], pa.int64()),
                            pa.array([points[p] for _, p in found], pa.string()),
                            pa.array([numbers[p] for _, p in found], pa.int64()),
                        ],
                        names=["a", "a_n", "b", "b_n"],
                    )
                start = stop

    return dealt.mapInArrow(search, "a string, a_n long, b string, b_n long")


def variants(
    docs: DataFrame,
    ratio: int = RATIO,
    least_letters: int = LEAST_LETTERS,
    least_times: int = LEAST_TIMES,
    sample: int = SAMPLE,
    region: int = REGION,
) -> DataFrame:
    """Per word of all texts: word, n, n_near, form, form_n, root.

    Words are the runs of letters of every whole text, some with a letter taken out (``damaged``), that
    have ``least_letters`` and occur ``least_times``. A word's form is its most frequent near word, the
    first in code-point order of equally frequent ones, if ``ratio`` times as frequent; root follows the
    forms to the last. Null texts have no words, a null doc_id counts as empty. Repeated rows count each.
    An empty table, or one without words, gives an empty result. Columns beside doc_id and text are
    not looked at.
    """
    run = Run(docs.sparkSession, "spelling")
    vocabulary = run.table(words(docs, least_letters, least_times), "words")
    pairs = run.table(near_pairs(vocabulary, sample, region), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionAll(
        pairs.select("b", "a", "a_n")
    )
    # Strings compare by UTF-8 bytes, which is code-point order.
    near = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    joined = vocabulary.join(near, "word", "left")
    has_form = -F.col("best.less") >= ratio * F.col("n")
    found = joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has_form, F.col("best.near")).alias("form"),
        F.when(has_form, -F.col("best.less")).alias("form_n"),
    )
    found = run.table(found, "forms")
    return found.join(roots(run, found), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(run: Run, found: DataFrame) -> DataFrame:
    """word and root of the words that have a form: every round each takes its root's root.

    Frequency grows ``ratio`` times at each step, so a few rounds settle chains of any table.
    """
    hops = run.table(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "hops-0")
    turn = 0
    while True:
        turn += 1
        next_ = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = hops.join(next_, "root", "left")
        if longer.where("further IS NOT NULL").isEmpty():
            return hops
        hops = run.table(longer.select("word", F.coalesce("further", "root").alias("root")), f"hops-{turn}")
