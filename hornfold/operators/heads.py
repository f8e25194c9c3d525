"""Rule heads as projections over body matches (H1-H5)."""

from __future__ import annotations

from functools import reduce as reduce_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornfold.functions.terms import RDF_TYPE
from hornfold.operators.match import column, match_body
from hornfold.sources.folders import run_folder
from hornfold.sources.rules import Atom, Key, Rule, RuleSet, is_variable
from hornfold.sources.triples import load_triples, save_triples, union_triples


def head_term(term: str) -> Column:
    return column(term[1:]) if is_variable(term) else F.lit(term)


def instantiate(bindings: DataFrame, head: Atom) -> DataFrame:
    """One head triple per match."""
    return bindings.select(head_term(head.s).alias("s"), F.lit(head.p).alias("p"), head_term(head.o).alias("o"))


def apply_rules(
    kb: DataFrame, rules: RuleSet, *, stage: bool = False, reduce: bool = False, work_dir: str | None = None
) -> DataFrame:
    """Distinct head triples of every rule over ``kb``: one step, lazy, without recursion.

    With ``stage`` the facts that the rules name are first written to a directory for each key below
    ``work_dir`` or the session's run folder: a source that can't be read by key, such as text, is then
    parsed once however many keys there are. ``reduce`` is that of ``match_body``.

    Rules of different head keys cannot give equal triples, so duplicates are removed per key,
    before the constant predicate or class is added: the shuffle carries only what varies.
    """
    if stage:
        folder = f"{run_folder(kb.sparkSession, work_dir)}/facts"
        save_triples(kb, folder, rules=rules)
        kb = load_triples(kb.sparkSession, folder, fmt="parquet", distinct=False)
    by_key: dict[Key, list[Rule]] = {}
    for rule in rules.rules:
        by_key.setdefault(rule.head.key, []).append(rule)
    parts = []
    for (key, of_type), group in by_key.items():
        varying = ("s",) if of_type else ("s", "o")
        pairs = [
            match_body(kb, rule, count_matches=False, reduce=reduce).select(
                *(head_term(getattr(rule.head, field)).alias(field) for field in varying)
            )
            for rule in group
        ]
        distinct = reduce_(DataFrame.unionByName, pairs).distinct()
        p, o = (F.lit(RDF_TYPE), F.lit(key)) if of_type else (F.lit(key), F.col("o"))
        parts.append(distinct.select("s", p.alias("p"), o.alias("o")))
    return union_triples(*parts) if parts else kb.select("s", "p", "o").filter(F.lit(False))
