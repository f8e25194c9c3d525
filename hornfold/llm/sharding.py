"""Shards of nearly equal bytes by sampled splitters, with DataFrame functions only.

Keys are drawn with a chance in proportion to their record's size; quantiles of the drawn keys
split the key space into ranges; a range that turns out too full is split again by keys drawn
inside it. Within a range, exact prefix sums of size place every record, so sampling decides how
the work is spread and never how even the shards are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornfold.llm.common import Run, binary_search, partitions, text_or_empty, utf8_crc32

SHARDS = 40
OVERHEAD = 16
#: Drawn keys for each range; their number is all that the driver ever holds.
DRAWS = 32
#: A range with more than this times the mean size or rows is split again.
OVERFULL = 2.0
ROUNDS = 4


def draw(rows: DataFrame, keys: list[str], chance: Column, seed: int) -> list[list[int]]:
    """Keys of rows, each drawn with its own ``chance``; the same ones in every run."""
    coin = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return sorted([list(r) for r in rows.where(coin < chance).select(*keys).collect()])


def quantiles(drawn: list[list[int]], ranges: int) -> list[list[int]]:
    cuts = [drawn[len(drawn) * i // ranges] for i in range(1, ranges)] if drawn else []
    return [list(x) for x in sorted(set(map(tuple, cuts)))]


def splitters(rows: DataFrame, keys: list[str], ranges: int) -> tuple[list[list[int]], dict[int, tuple[int, int]]]:
    """Bounds of about ``ranges`` ranges of ``keys``, and the exact (rows, bytes) of each."""
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    if not count:
        return [], {}
    # Half of the draws go by size and half by rows, so that neither piles up in one range.
    weight = F.col("size") / (2.0 * max(total, 1)) + F.lit(0.5 / count)
    bounds = quantiles(draw(rows, keys, weight * (DRAWS * ranges), 0), ranges)
    for turn in range(1, ROUNDS + 1):
        counted = {
            r["range"]: (r["rows"], r["bytes"])
            for r in rows.groupBy(binary_search(bounds, [F.col(k) for k in keys]).alias("range"))
            .agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
            .collect()
        }
        full = {
            i: max(n / count, b / max(total, 1)) * ranges
            for i, (n, b) in counted.items()
            if max(n / count, b / max(total, 1)) * ranges > OVERFULL
        }
        if not full or turn == ROUNDS:
            break
        inside = rows.withColumn("__range", binary_search(bounds, [F.col(k) for k in keys]))
        drawn = draw(inside.where(F.col("__range").isin(list(full))), keys, weight * (DRAWS * ranges), turn)
        grouped: dict[int, list[list[int]]] = {}
        for key in drawn:
            at = sum(b <= key for b in bounds)
            grouped.setdefault(at, []).append(key)
        more = [cut for i, found in grouped.items() for cut in quantiles(found, int(full.get(i, 1)) + 1)]
        grown = [list(x) for x in sorted(set(map(tuple, bounds)) | set(map(tuple, more)))]
        if len(grown) == len(bounds):  # one key alone fills the range
            break
        bounds = grown
    return bounds, counted


def shards(docs: DataFrame, shard_count: int = SHARDS, ranges: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: shards hold nearly equal bytes, to within one record. Records are ordered by a
    hash of the text, then doc_id, so equal texts lie together and are parted only where a shard
    ends. ``slot`` counts from 0 in each shard without gaps. ``grown_shard`` is null under this law.
    Null text has no bytes and the size ``OVERHEAD``; null doc_id sorts first; repeated rows get
    slots of their own; a record larger than a shard's share leaves later shards empty; an empty
    table gives an empty result. Columns beside doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    run = Run(spark, "shards")
    text = text_or_empty()
    rows = run.table(
        docs.select(
            "doc_id",
            F.xxhash64(text).alias("__hash"),
            F.xxhash64("doc_id").alias("__tie"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            utf8_crc32(text).alias("text_crc32"),
        ),
        "sizes",
    )
    keys = ["__hash", "__tie"]
    bounds, counted = splitters(rows, keys, ranges or max(4 * shard_count, partitions(spark)))
    starts, n, size = {}, 0, 0
    for i in sorted(counted):
        starts[i] = (n, size)
        n, size = n + counted[i][0], size + counted[i][1]
    at = [starts.get(i, (0, 0)) for i in range(len(bounds) + 1)]
    order = Window.partitionBy("__range").orderBy(*keys, F.col("doc_id").asc_nulls_first())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = (F.col("__range") + 1).cast("int")
    middle = F.element_at(F.lit([b for _, b in at]), place) + F.sum("size").over(upto) - F.expr("size div 2") - 1
    rank = F.element_at(F.lit([r for r, _ in at]), place) + F.row_number().over(order) - 1
    placed = run.table(
        rows.withColumn("__range", binary_search(bounds, [F.col(k) for k in keys]))
        .withColumn("__middle", middle)
        .withColumn("__rank", rank)
        .withColumn("shard", F.expr(f"cast(__middle * {shard_count} div {max(size, 1)} as int)"))
        .drop("__range", "__middle", *keys),
        "placed",
    )
    # One row for each shard.
    first = placed.groupBy("shard").agg(F.min("__rank").alias("__first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("__rank") - F.col("__first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
