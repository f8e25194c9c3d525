"""Triple sources and sinks: text lines, Parquet, and columns of ordinary tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hornfold.functions.terms import RDF_TYPE, is_type, num, pred_key
from hornfold.sources.rules import RuleSet

TRIPLE_COLUMNS = ("s", "p", "o")
STORED_SCHEMA = "s string, p string, o string, number bigint, is_type boolean, pred_key string"

# One whole-line pattern, so a line is scanned once. The groups are subject, predicate, object;
# what follows the object (datatype, language tag, final dot) is not kept. The quantifiers are
# possessive: a literal of any length is matched without recursion.
_SUBJECT = r"(<[^>]*+>|[^\s<\"][^\s]*+)"
_PREDICATE = r"(<[^>]*+>)"
_OBJECT = r"(<[^>]*+>|\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|[^\s<\"][^\s]*+)"
_LINE = rf"(?s)^\s*+{_SUBJECT}\s++{_PREDICATE}\s++{_OBJECT}.*+$"

# A line of text never holds a line feed, so it can separate the three extracted fields.
_SEPARATOR = "\n"


def parse_triple_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Add ``s``, ``p``, ``o`` to text lines; all three are NULL on a malformed line."""
    joined = F.regexp_replace(F.col(column), _LINE, f"$1{_SEPARATOR}$2{_SEPARATOR}$3")
    # A generator is never merged into the filters and projections that follow, so the pattern runs
    # once per line however often its result is used.
    fields = lines.select(*lines.columns, F.explode(F.array(F.split(joined, _SEPARATOR))).alias("_fields"))
    well_formed = F.size("_fields") == 3
    return fields.select(
        *lines.columns,
        *(F.when(well_formed, unescaped(F.col("_fields")[i])).alias(name) for i, name in enumerate(TRIPLE_COLUMNS)),
    )


# The escapes of N-Triples inside a literal.
_ESCAPES = (('"', r"\""), ("\n", r"\n"), ("\r", r"\r"), ("\t", r"\t"))


def escaped(term: Column) -> Column:
    """A term as it is written in a line: backslash, quote and control characters of a literal escaped."""
    inner = F.replace(F.substring(term, F.lit(2), F.char_length(term) - 2), F.lit("\\"), F.lit("\\\\"))
    for plain, written in _ESCAPES:
        inner = F.replace(inner, F.lit(plain), F.lit(written))
    return F.when(is_literal(term), F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(term)


def unescaped(term: Column) -> Column:
    """Undoes ``escaped``. What lies between two escaped backslashes has its other escapes undone alone."""

    def undo(part: Column) -> Column:
        for plain, written in _ESCAPES:
            part = F.replace(part, F.lit(written), F.lit(plain))
        return part

    # Only a literal with a backslash needs this.
    parts = F.split(term, r"\\\\", -1)
    plain = F.array_join(F.transform(parts, undo), "\\")
    return F.when(term.startswith('"') & term.contains("\\"), plain).otherwise(term)


def is_literal(term: Column) -> Column:
    return (F.char_length(term) > 1) & term.startswith('"') & term.endswith('"')


def load_triples(
    spark: SparkSession,
    path: str | list[str],
    *,
    fmt: str = "text",
    on_error: str = "fail",
    distinct: bool = True,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Read triples from text lines or Parquet.

    ``on_error`` says what a malformed line does: ``fail`` fails the job, ``drop`` skips it,
    ``quarantine`` returns ``(triples, malformed_lines)``. Blank lines are skipped. A Parquet row
    with a NULL field counts as malformed.
    ``distinct=False`` leaves out the shuffle when the input is known to be a set.
    """
    if on_error not in ("drop", "fail", "quarantine"):
        raise ValueError(f"on_error must be fail, drop or quarantine, not {on_error!r}")
    if fmt not in ("text", "parquet"):
        raise ValueError(f"fmt must be text or parquet, not {fmt!r}")
    parsed = read_lines(spark, path) if fmt == "text" else read_parquet(spark, path)
    complete = F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull()
    columns = [name for name in parsed.columns if name != "value"]
    if on_error == "fail":
        complaint = F.raise_error(F.concat(F.lit("malformed triple line: "), F.col("value"))).cast("string")
        required = {name: F.coalesce(F.col(name), complaint) for name in TRIPLE_COLUMNS}
        good = parsed.withColumns(required).select(*columns)
    else:
        good = parsed.filter(complete).select(*columns)
    good = good.distinct() if distinct else good
    if on_error == "quarantine":
        return good, parsed.filter(~complete).select("value")
    return good


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_triple_lines(spark.read.text(path).filter(F.trim("value") != ""))


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    stored = spark.read.parquet(*paths)
    if stored_by_key(stored):
        stored = spark.read.schema(STORED_SCHEMA).parquet(*paths)
    else:
        stored = stored.select(*TRIPLE_COLUMNS)
    return stored.withColumn("value", F.concat_ws(" ", *TRIPLE_COLUMNS))


def save_triples(triples: DataFrame, path: str, *, rules: RuleSet | None = None, mode: str = "error") -> None:
    """Store triples as Parquet, one directory per predicate key (F1).

    With ``rules`` only the predicates those rules name are kept. The rebalance hint gathers each
    key into files of the advisory size and splits a key that holds most of the rows. ``number`` has the
    integer value of an object, by which each file is sorted, so that a numeric comparison skips row groups.
    """
    kept = triples if rules is None else rules_only(triples, rules)
    (
        kept.select(
            *TRIPLE_COLUMNS,
            num(F.col("o")).alias("number"),
            is_type(F.col("p")).alias("is_type"),
            pred_key(F.col("p"), F.col("o")).alias("pred_key"),
        )
        .hint("rebalance", F.col("is_type"), F.col("pred_key"))
        .sortWithinPartitions("is_type", "pred_key", "number")
        .write.mode(mode)
        .partitionBy("is_type", "pred_key")
        .parquet(path)
    )


def write_triple_lines(triples: DataFrame, path: str, *, mode: str = "error") -> None:
    """Write triples as text lines that ``load_triples`` reads back as they are.

    Literals are escaped. A triple that no line can hold, such as an IRI with a space before it or an
    empty field, fails the job.
    """
    terms = [escaped(F.coalesce(name, F.lit(""))) for name in TRIPLE_COLUMNS]
    line = F.concat_ws(" ", *terms, F.lit("."))
    readable = F.regexp_replace(line, _LINE, f"$1{_SEPARATOR}$2{_SEPARATOR}$3") == F.concat_ws(_SEPARATOR, *terms)
    complaint = F.raise_error(F.concat(F.lit("no line can hold the triple: "), line)).cast("string")
    triples.select(F.when(readable, line).otherwise(complaint).alias("value")).write.mode(mode).text(path)


def stored_by_key(triples: DataFrame) -> bool:
    """Whether the columns of ``save_triples`` are there, so that directories can be pruned."""
    return {"is_type", "pred_key"} <= set(triples.columns)


def rules_only(triples: DataFrame, rules: RuleSet) -> DataFrame:
    """Keep the triples whose predicate or class some rule names."""
    return triples.filter(named(triples, rules))


def without_rules(triples: DataFrame, rules: RuleSet) -> DataFrame:
    """Keep the triples whose predicate or class no rule names."""
    return triples.filter(~F.coalesce(named(triples, rules), F.lit(False)))


def named(triples: DataFrame, rules: RuleSet) -> Column:
    """Whether some rule names the predicate or class of a triple."""
    properties = [key for key, of_type in rules.keys if not of_type]
    classes = [key for key, of_type in rules.keys if of_type]
    if stored_by_key(triples):
        return (~F.col("is_type") & F.col("pred_key").isin(properties)) | (
            F.col("is_type") & F.col("pred_key").isin(classes)
        )
    return F.col("p").isin(properties) | (is_type(F.col("p")) & F.col("o").isin(classes))


def relation(triples: DataFrame, key: str, of_type: bool) -> DataFrame:
    """Subjects and objects of one predicate key (F1); prunes directories of a stored table, which has numbers too."""
    if stored_by_key(triples):
        columns = [name for name in ("s", "o", "number") if name in triples.columns]
        chosen = (F.col("pred_key") == key) & (F.col("is_type") == F.lit(of_type))
        return triples.filter(chosen).select(*columns)
    chosen = is_type(F.col("p")) & (F.col("o") == key) if of_type else F.col("p") == key
    return triples.filter(chosen).select("s", "o")


def edge_triples(table: DataFrame, subject: str, predicate: str, obj: str) -> DataFrame:
    """One property triple per row of a table; ``subject`` and ``obj`` are SQL expressions.

    A row in which one of them is NULL states no fact.
    """
    edges = table.select(F.expr(subject).alias("s"), F.lit(predicate).alias("p"), F.expr(obj).alias("o"))
    return edges.filter("s IS NOT NULL AND o IS NOT NULL")


def member_triples(table: DataFrame, subject: str, class_iri: str) -> DataFrame:
    """One class membership triple per row of a table."""
    members = table.select(F.expr(subject).alias("s"), F.lit(RDF_TYPE).alias("p"), F.lit(class_iri).alias("o"))
    return members.filter("s IS NOT NULL")


def union_triples(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
