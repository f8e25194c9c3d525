"""Column expressions over terms (IRIs, blank nodes and literals in their lexical form)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the predicate that encodes class membership.
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"

# The numeric comparisons a rule body may call.
BUILTINS = {
    "equal": lambda left, right: left == right,
    "lessthanorequal": lambda left, right: left <= right,
    "greaterthanorequal": lambda left, right: left >= right,
}


def is_type(p: Column) -> Column:
    return p == F.lit(RDF_TYPE)


def pred_key(p: Column, o: Column) -> Column:
    """Class IRI of a membership triple, predicate of any other triple (M1)."""
    return F.when(is_type(p), o).otherwise(p)


def num(term: Column) -> Column:
    """Integer value of a term such as ``<20>`` or ``"20"``; NULL when it is not an integer."""
    return F.translate(term, '<>"', "").try_cast("bigint")


def render_triple(triple: Column) -> Column:
    """``(s p o)`` text of a triple struct, with class membership shortened to ``type``."""
    p = F.when(is_type(triple["p"]), F.lit("type")).otherwise(triple["p"])
    return F.format_string("(%s %s %s)", triple["s"], p, triple["o"])


def triple_struct(s: Column, p: Column, o: Column) -> Column:
    return F.struct(s.alias("s"), p.alias("p"), o.alias("o"))
