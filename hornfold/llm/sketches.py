"""Bottom-k sketches of shingle hashes, with DataFrame functions only.

A sketch is the ascending list of the K smallest distinct hashes of a text's word shingles. Sketches
of parts merge to the sketch of the whole, and two of them estimate resemblance, containment and the
number of distinct shingles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornfold.llm.common import binary_search, partitions, text_or_empty
from hornfold.llm.sharding import draw, quantiles

K = 256
SHINGLE = 5
SPACE = r"[\x20\x09-\x0D]+"
LEAST = -(1 << 63)
DRAWS = 64
#: Ranges of ids for each partition, so that their hashes fill the partitions evenly.
RANGES = 8


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """A hash of each run of ``size`` words; of all words where there are fewer; none without words."""

    def of(words: Column) -> Column:
        starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(0)))

        def run(first: Column, at: Column) -> Column:
            return F.xxhash64(first, *(words[at + i] for i in range(1, size)))

        short = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(words) < size, short).otherwise(F.transform(starts, run))

    words = F.transform(F.array_remove(F.split(text, SPACE), ""), lambda w: F.xxhash64(w))
    return let(words, of)


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    return smallest(shingle_hashes(text, size), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts taken together."""
    return smallest(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Shared share of all distinct shingles: that of the union's sketch. Two empty sketches are alike."""

    def of(both: Column) -> Column:
        shared = F.size(F.array_intersect(F.array_intersect(a, b), both))
        return F.when(F.size(both) > 0, shared / F.size(both)).otherwise(F.lit(1.0))

    return let(merge(a, b, k), of)


def distinct_count(a: Column, k: int = K) -> Column:
    """Distinct shingles: exact below ``k``, else from the k-th smallest hash."""
    reach = (F.element_at(a, -1).cast("double") - float(LEAST)) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of the distinct shingles of ``a`` that ``b`` has; 1 for an empty ``a``."""
    union = distinct_count(merge(a, b, k), k)
    share = resemblance(a, b, k) * union / distinct_count(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(share, F.lit(1.0)))


def as_text(a: Column) -> Column:
    """16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(docs: DataFrame, add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, text and what ``add`` adds, each with the next document's as ``next_...``.

    Next by ascending doc_id; after the last comes the first. Drawn ids cut the table into ranges, so
    a single shuffle brings neighbours together; the first document of a range goes to the range
    before it as well, as a guest.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("__key")
    keys = docs.select(key)  # a scan of one column
    count, least = keys.agg(F.count("*"), F.min("__key")).first()
    ranges = RANGES * partitions(spark)
    bounds = quantiles(draw(keys, ["__key"], F.lit(DRAWS * ranges / max(count, 1)), 7), ranges)
    bounds = [b for b in bounds if b[0] != least]
    own = binary_search(bounds, [F.col("__key")])
    starts_range = F.lit(False)
    if bounds:
        starts_range = (F.col("__own") > 0) & (
            F.element_at(F.lit([b[0] for b in bounds]), F.greatest(F.col("__own"), F.lit(1))) == F.col("__key")
        )
    none = F.lit(None).cast("struct<range: int, guest: int>")
    place = lambda range_, guest: F.struct(range_.alias("range"), F.lit(guest).alias("guest"))
    places = F.array(
        place(F.col("__own"), 0),
        F.when(starts_range, place(F.col("__own") - 1, 1)).otherwise(none),
        F.when(F.col("__key") == F.lit(least), place(F.lit(len(bounds)), 2)).otherwise(none),
    )
    placed = (
        docs.select("doc_id", text_or_empty().alias("text"), key)
        .withColumn("__own", own)
        .withColumn("__place", F.explode(F.filter(places, lambda p: p.isNotNull())))
        .select("doc_id", "text", "__key", F.col("__place.range").alias("__range"), F.col("__place.guest").alias("__guest"))
        .repartition(partitions(spark), "__range")
    )
    described = add(placed)
    order = Window.partitionBy("__range").orderBy(
        F.when(F.col("__guest") == 2, 1).otherwise(0), "__key", F.xxhash64("text"), "text"
    )
    names = ["text", *(c for c in described.columns if c not in placed.columns)]
    following = [F.lead(c).over(order).alias(f"next_{c}") for c in names]
    return described.select("doc_id", "__guest", *names, *following).where("__guest = 0").drop("__guest")


def fingerprints(docs: DataFrame, k: int = K, size: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    distinct_shingles, contained_next.

    The edited text is the text with its last quarter replaced by the start of the next document.
    Null counts as empty, and so does a text without words: an empty sketch, which resembles only
    other empty ones. A null doc_id comes first; rows that share a doc_id are ordered by a hash of
    their text; a single document follows itself. Equal texts have equal fingerprints. An empty
    table gives an empty result. Columns beside doc_id and text are not looked at.
    """
    beside = with_next(docs, lambda df: df.withColumn("sketch", sketch(F.col("text"), k, size)))
    quarter = F.expr("char_length(text) div 4").cast("int")
    stays = (F.char_length("text") - quarter).cast("int")
    edited = F.concat(F.substring("text", 1, stays), F.substring("next_text", 1, quarter))
    rows = beside.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    rows = rows.select("*", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), sketch(F.col("edited"), k, size).alias("edited_sketch"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("distinct_shingles"),
        containment(F.col("next_sketch"), F.col("sketch"), k).alias("contained_next"),
    )
