"""Line deduplication by a tree of line templates, with DataFrame functions only.

A line goes down a tree of fixed depth: number of tokens, then its leading tokens, then the rest of
its tokens cut into five blocks of neighbours. Numbers are variable from the start; beyond them, the
fields of a template may lie in any two of the blocks, which are hidden. So a line reaches one leaf for
each choice of hidden blocks, and the lines of a leaf are of one template: they have the same number of
tokens, the same leading ones and the same tokens in the blocks that show. Templates that occur in many
documents are dropped from all. Every line goes down the tree at every size, so the work grows with
the lines. Long lines are passages as well: an exact one stays in its first document only.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornfold.llm.common import Run, text_or_empty

#: Documents in which a template must occur to be dropped.
LEAST_DOCUMENTS = 10
#: Words that make a line a passage, which goes from the second document on.
LONG_WORDS = 50
#: Leading tokens on the way to a leaf, blocks of the others, and how many of them are hidden.
DEPTH = 2
BLOCKS = 5
HIDDEN = 2
#: Share of a line's tokens that must show.
SHOWS = 0.6
NUMBER = "[0-9]+"
SPACE = r"[\x20\x09\x0B-\x0D]+"
SPACES = " \t\v\f\r"


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def masked(text: Column) -> Column:
    return F.regexp_replace(text, NUMBER, "0")


def tokens(line: Column) -> Column:
    return F.array_remove(F.split(line, SPACE), "")


def line_hash(line: Column) -> Column:
    """Of a masked line; blank lines have none and are never dropped."""
    return F.when(F.btrim(line, F.lit(SPACES)) != "", F.xxhash64(line))


def passage_hash(line: Column) -> Column:
    """Of a line as it is, without the white space around it."""
    return F.xxhash64(F.btrim(line, F.lit(SPACES)))


def block_start(n: Column, block: int, depth: int) -> Column:
    """Tokens before a block (or, at ``BLOCKS``, all tokens) of a line of ``n`` tokens."""
    rest = F.greatest(n - depth, F.lit(0))
    return F.least(n, F.lit(depth)) + F.floor(rest * block / BLOCKS).cast("int")


def placed_lines(docs: DataFrame, depth: int, long_words: int) -> DataFrame:
    """Per distinct line of a document that isn't blank: doc_id, line, passage, n, lead, blocks.

    ``line`` is the hash of the masked line, ``lead`` of its number of tokens and leading tokens, ``blocks`` of each block.
    """
    each = docs.select("doc_id", F.explode(F.array_distinct(lines(text_or_empty()))).alias("__line"))
    each = each.where(F.btrim("__line", F.lit(SPACES)) != "").withColumn("__masked", masked(F.col("__line")))
    each = each.withColumn("__tokens", tokens(F.col("__masked"))).withColumn("n", F.size("__tokens"))
    start = [block_start(F.col("n"), i, depth) for i in range(BLOCKS + 1)]
    return each.select(
        "doc_id",
        line_hash(F.col("__masked")).alias("line"),
        F.when(F.col("n") >= long_words, passage_hash(F.col("__line"))).alias("passage"),
        "n",
        F.xxhash64("n", F.slice("__tokens", 1, depth)).alias("lead"),
        F.array(*[F.xxhash64(F.slice("__tokens", a + 1, b - a)) for a, b in zip(start, start[1:])]).alias("blocks"),
    )


def leaves(depth: int, shows: float) -> Column:
    """The leaves of a line, one for each choice of hidden blocks that leaves enough tokens to see."""
    n, found = F.col("n"), []
    for hidden in combinations(range(BLOCKS), HIDDEN):
        out = sum((block_start(n, i + 1, depth) - block_start(n, i, depth) for i in hidden), F.lit(0))
        seen = [F.col("blocks")[i] for i in range(BLOCKS) if i not in hidden]
        found.append(F.when(n - out >= shows * n, F.xxhash64("lead", F.lit(sum(1 << i for i in hidden)), *seen)))
    return F.array_compact(F.array(*found))


def template_lines(run: Run, placed: DataFrame, least: int, depth: int, shows: float) -> DataFrame:
    """doc_id and line of what is of a template in at least ``least`` documents."""
    reached = placed.select("doc_id", "line", F.explode(leaves(depth, shows)).alias("leaf"))
    # Lines are at least as many as documents, so only leaves of enough lines need their documents counted.
    often = reached.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("leaf")
    inside = run.table(reached.join(run.table(often, "often"), "leaf"), "inside")
    recurring = (
        inside.groupBy("leaf", "doc_id")
        .agg(F.lit(1))
        .groupBy("leaf")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least)
        .select("leaf")
    )
    return inside.join(run.table(recurring, "recurring"), "leaf", "left_semi").select("doc_id", "line")


def repeated_passages(placed: DataFrame) -> DataFrame:
    """doc_id and passage of long lines that a document before it, by doc_id, has too."""
    each = placed.where("passage IS NOT NULL").select("doc_id", "passage").distinct()
    again = each.groupBy("passage").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    later = each.join(again, "passage").where(~F.col("doc_id").eqNullSafe(F.col("first")))
    return later.select("doc_id", "passage")


def drop_recurring(
    docs: DataFrame,
    least: int = LEAST_DOCUMENTS,
    depth: int = DEPTH,
    shows: float = SHOWS,
    long_words: int = LONG_WORDS,
) -> DataFrame:
    """Per row of ``docs``: doc_id, text (without lines of recurring templates), n_lines, dropped_lines.

    Null counts as empty, which is one blank line; blank lines stay. A line repeated inside one
    document counts once for it. Rows that share a doc_id count as one document, and lose the lines
    of any of them. A line of ``long_words`` or more that isn't dropped from all documents stays in the
    one with the smallest doc_id, and goes from the others. An empty table gives an empty result. Columns beside doc_id and text are not
    looked at. A line that a third of all rows share is merged before the shuffle.
    """
    run = Run(docs.sparkSession, "lines")
    placed = run.table(placed_lines(docs, depth, long_words), "placed")
    templates = template_lines(run, placed, least, depth, shows).withColumn("passage", F.lit(None).cast("long"))
    again = repeated_passages(placed).select("doc_id", F.lit(None).cast("long").alias("line"), "passage")
    gone = (
        templates.unionByName(again)
        .groupBy(F.col("doc_id").alias("__doc"))
        .agg(F.collect_set("line").alias("__gone"), F.collect_set("passage").alias("__again"))
    )
    gone = run.table(gone, "gone")
    for done in ("placed", "often", "inside", "recurring"):
        run.remove(done)
    texts = docs.select("doc_id", text_or_empty().alias("__text"))
    found = texts.join(gone, texts["doc_id"].eqNullSafe(gone["__doc"]), "left")
    is_template = lambda x: F.coalesce(F.array_contains("__gone", line_hash(masked(x))), F.lit(False))
    is_again = lambda x: F.coalesce(F.array_contains("__again", passage_hash(x)), F.lit(False))
    none = lambda name: F.coalesce(F.size(name), F.lit(0)) <= 0
    found = found.withColumn("__all", lines(F.col("__text")))
    kept = F.when(none("__gone"), F.col("__all")).otherwise(F.filter("__all", lambda x: ~is_template(x)))
    found = found.withColumn("__some", kept)
    kept = F.when(none("__again"), F.col("__some")).otherwise(F.filter("__some", lambda x: ~is_again(x)))
    found = found.withColumn("__kept", kept)
    return found.select(
        "doc_id",
        F.array_join("__kept", "\n").alias("text"),
        F.size("__all").cast("long").alias("n_lines"),
        (F.size("__all") - F.size("__kept")).cast("long").alias("dropped_lines"),
    )
