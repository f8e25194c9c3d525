"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Each source has a target in words. With the same rate (target over size) for every document of a
source, the expected copies are prefix-summed in order of size, one random offset is added, and a
document is emitted once for each integer that its interval crosses. Since neighbours in that order
have nearly the same size, the words taken miss the target by no more than about one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornfold.llm.common import Run, ranked

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 20


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per ``source``: ``source_size``, ``target`` and ``rate`` (expected copies of each document).

    Sources in order of code points, null last, take the ``weights`` in turn. A target stops at
    ``most`` times its source's size and the excess goes to the others by weight. In ascending order
    of size over weight, a source is capped if what the smaller ones leave, shared by weight, is
    above its cap; so one pass over the sources settles all. It sees one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    wheel = F.element_at(F.lit(list(weights)), (F.col("__no") % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    place = F.struct(F.col("__size") / F.col("__weight"), F.col("__no"))
    tightest = Window.orderBy(place)
    before = tightest.rowsBetween(Window.unboundedPreceding, -1)
    cap = most * F.col("__size")
    left = share * F.col("__all") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    heavy = F.sum("__weight").over(tightest.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    settled = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("__size"))
        .withColumn("__no", F.row_number().over(by_name) - 1)
        .withColumn("__weight", wheel)
        .withColumn("__all", F.sum("__size").over(everything))
        .withColumn("__level", left / heavy)
        .withColumn("__capped", F.col("__level") * F.col("__weight") >= cap)
        # The first source that stays below its cap has the level of all that follow.
        .withColumn("__final", F.min_by("__level", F.when(~F.col("__capped"), place)).over(everything))
    )
    target = F.least(cap, F.coalesce(F.col("__final") * F.col("__weight"), cap))
    return settled.select(
        "source",
        F.col("__size").alias("source_size"),
        target.cast("double").alias("target"),
        F.when(F.col("__size") > 0, F.least(target / F.col("__size"), F.lit(most))).otherwise(0.0).alias("rate"),
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = SEED,
) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, rate, copies, taken.

    A null or empty text has size 0 and is emitted at its source's rate (0 where the whole source
    has size 0), but takes no words. Null is a source of its own, the last. Repeated rows are
    sampled each on its own. Ties in size are ordered by a hash of doc_id, then doc_id. An empty
    table gives an empty result. Columns beside doc_id, text and source are not looked at.
    The hot source needs no special care: ranks come from a range shuffle over (source, size,
    hash), which splits a source wherever it is large.
    """
    run = Run(docs.sparkSession, "mix")
    sizes = run.table(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    shares = run.table(targets(sizes, weights, share, most), "targets")
    order = [F.col("source").asc_nulls_last(), "size", F.xxhash64("doc_id"), "doc_id"]
    placed = ranked(run, sizes, order)
    starts = placed.groupBy("source").agg(F.min("__rank").alias("__first"))
    shares = shares.join(starts, shares["source"].eqNullSafe(starts["source"])).drop(starts["source"])
    shares = shares.withColumnRenamed("source", "__source")
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col("__source")), F.lit(1 << 30)) / float(1 << 30)
    before = F.floor((F.col("__rank") - F.col("__first")) * F.col("rate") + offset)
    upto = F.floor((F.col("__rank") - F.col("__first") + 1) * F.col("rate") + offset)
    copies = F.least((upto - before).cast("int"), F.ceil(F.lit(most)).cast("int"))
    return (
        placed.join(shares, placed["source"].eqNullSafe(shares["__source"]))
        .withColumn("copies", copies)
        .select(
            "doc_id", "source", "size", "source_size", "target", "rate", "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; rows of one doc_id alike (as often as its most taken)."""
    taken = mix(docs, **settings).groupBy("doc_id").agg(F.max("copies").alias("__copies"))
    taken = taken.where("__copies > 0").withColumnRenamed("doc_id", "__doc")
    once = docs.join(taken, docs["doc_id"].eqNullSafe(taken["__doc"]))
    again = once.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return again.select([docs[c] for c in docs.columns])
