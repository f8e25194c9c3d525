"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Best-fit decreasing needs only the lengths. Pieces of one length are alike, so the packing is worked
out for runs of equal pieces over the histogram of lengths, which has at most one entry for each
length up to the capacity, whatever the size of the corpus. A segment tree over remaining capacities
finds the tightest open bin in logarithmic time. The plan says which ranks within a length go to
which bins; ranks come from a range shuffle, and every piece finds its place by a join with the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornfold.llm.common import Run, ranked
from hornfold.llm.tokens import encoder, slices, vocabulary

CAPACITY = 1024
END_ID = 2


class OpenBins:
    """Segment tree over remaining capacities: which are open, and the tightest that still holds a length."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, first: int, bins: int) -> None:
        """``bins`` bins numbered from ``first`` have ``remaining`` places each."""
        if bins and remaining:
            self.runs[remaining].append((first, bins))
            self._mark(remaining, True)

    def _mark(self, remaining: int, open_: bool) -> None:
        node = self.size + remaining
        self.any[node] = open_
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that any bin has."""
        node = self.size + length
        while not self.any[node]:
            while node % 2:  # a right child: go up until there is something to the right
                node //= 2
            if not node:
                return None
            node += 1
            if node & (node - 1) == 0:  # walked off the right edge
                return None
        while node < self.size:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.size

    def take(self, remaining: int) -> tuple[int, int]:
        run = self.runs[remaining].pop()
        if not self.runs[remaining]:
            self._mark(remaining, False)
        return run


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, ranks, per bin, first bin, offset) of the best-fit decreasing packing.

    Longest first, each into the tightest open bin that holds it. A bin that has just taken a piece
    and holds another of the same length is then the tightest, so it takes as many as fit.
    """
    bins, open_bins, runs = 0, OpenBins(capacity), []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            remaining = open_bins.tightest(length)
            if remaining is None:
                remaining, first, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            else:
                first, count = open_bins.take(remaining)
            each = remaining // length
            full = min(count, left // each)
            part = left - full * each if full < count else 0
            for at, number, per_bin in ((first, full, each), (first + full, 1, part)):
                if number * per_bin:
                    runs.append((length, rank, number * per_bin, per_bin, at, capacity - remaining))
                    open_bins.add(remaining - per_bin * length, at, number)
                    rank += number * per_bin
                    left -= number * per_bin
            used = full + (part > 0)
            open_bins.add(remaining, first + used, count - used)
    return runs


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32.

    Only documents over ``capacity`` are cut, into pieces of ``capacity``; the first may be shorter.
    """
    rows = docs.select("doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.asarray([end_id], "<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            for part in slices(batch, 1):
                owner, piece, start, length, check = [], [], [], [], []
                for row, ids in enumerate(encoder(path).encode(part.column(1))):
                    ids += end
                    # Whole pieces end a document that is cut; the first has what is left over.
                    first_end = len(ids) % (4 * capacity) or 4 * capacity
                    for no, stop in enumerate(range(first_end, len(ids) + 1, 4 * capacity)):
                        data = ids[max(stop - 4 * capacity, 0) : stop]
                        owner.append(row)
                        piece.append(no)
                        start.append((stop - len(data)) // 4)
                        length.append(len(data) // 4)
                        check.append(zlib.crc32(data))
                columns = [part.column(0).take(pa.array(owner, pa.int32())), pa.array(piece, pa.int32())]
                columns += [pa.array(x, pa.int64()) for x in (start, length, check)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document ends with ``end_id``, so a null or empty text is a piece of one id. Rows with the
    same doc_id are packed each on its own. Pieces of one length are ordered by a hash of doc_id, so
    that a sequence mixes the corpus. An empty table gives an empty result. Columns beside doc_id
    and text are not looked at.
    """
    run = Run(docs.sparkSession, "pack")
    cut = run.table(pieces(docs, path or vocabulary("byte_bpe_50k.json"), end_id, capacity), "pieces")
    placed = ranked(run, cut, ["length", F.xxhash64("doc_id", "piece"), "doc_id", "piece", "ids_crc32"])
    # At most one row for each length.
    lengths = placed.groupBy("length").agg(F.count("*").alias("n"), F.min("__rank").alias("first")).collect()
    first = {r["length"]: r["first"] for r in lengths}
    runs = [
        (length, first[length] + rank, first[length] + rank + ranks, each, at, offset)
        for length, rank, ranks, each, at, offset in plan({r["length"]: r["n"] for r in lengths}, capacity)
    ]
    # A few rows for each length, so bounded by the capacity. As Arrow's they need no Python workers of another kind.
    names = ["__length", "__from", "__to", "__each", "__bin", "__offset"]
    columns = [pa.array([row[i] for row in runs], pa.int64()) for i in range(len(names))]
    places = run.spark.createDataFrame(pa.table(columns, names=names))
    here = (
        (placed["length"] == F.col("__length")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))
    )
    nth = F.col("__rank") - F.col("__from")
    return placed.join(F.broadcast(places), here).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("__bin") + F.expr("(__rank - __from) div __each")).alias("sequence_id"),
        (F.col("__offset") + nth % F.col("__each") * F.col("length")).alias("offset"),
    )
