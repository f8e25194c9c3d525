"""One linear recursion as a recursive common table expression (L4): a single lazy plan instead of phases."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce as reduce_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornfold.operators.heads import head_term
from hornfold.operators.match import column, join_atoms, match_body
from hornfold.sources.folders import run_folder
from hornfold.sources.rules import Atom, Rule, RuleSet, is_variable
from hornfold.sources.triples import relation

ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


@dataclass(frozen=True)
class Linear:
    """Rules that start a relation, and the one that goes on from it: its own atom and the others."""

    starts: tuple[Rule, ...]
    step: Rule
    own: Atom
    others: tuple[Atom, ...]


def as_linear(rules: RuleSet) -> Linear:
    """The parts of a recursion that a recursive CTE can express; any other rule set is a ``ValueError``."""
    keys = {rule.head.key for rule in rules.rules}
    if len(keys) != 1:
        raise ValueError("a recursive CTE derives one predicate or class: all heads must be of it")
    (key,) = keys
    starts = tuple(r for r in rules.rules if all(a.key != key for a in r.body))
    steps = [r for r in rules.rules if r not in starts]
    if len(steps) != 1 or sum(a.key == key for a in steps[0].body) != 1:
        raise ValueError("a recursive CTE takes one recursive rule, with one atom of its own head's predicate")
    (step,) = steps
    own = next(a for a in step.body if a.key == key)
    others = tuple(a for a in step.body if a is not own)
    places = (own.s,) if own.is_type else (own.s, own.o)
    if not all(map(is_variable, places)) or len(set(places)) < len(places):
        raise ValueError(f"rule {step.rule_id}: the recursive atom must have a variable of its own in each place")
    if not set(own.variables) & {v for a in others for v in a.variables} or not connected(others):
        raise ValueError(f"rule {step.rule_id}: the atoms beside the recursive one must be joined with each other and with it")
    bound = {v for a in others for v in a.variables}
    if any(v not in bound for call in step.builtins for v in call.variables):
        raise ValueError(f"rule {step.rule_id}: a builtin must compare variables of the atoms beside the recursive one")
    return Linear(starts, step, own, others)


def connected(atoms: tuple[Atom, ...]) -> bool:
    waiting = [set(a.variables) for a in atoms if a.variables]
    reached = waiting.pop() if waiting else set()
    while near := [vs for vs in waiting if vs & reached]:
        reached = reached.union(*near)
        waiting = [vs for vs in waiting if not vs & reached]
    return not waiting


def linear_closure(
    kb: DataFrame, rules: RuleSet, *, max_depth: int = 100, max_rows: int | None = None, work_dir: str | None = None
) -> DataFrame:
    """What ``infer(kb, rules).inferred`` holds, from one ``WITH RECURSIVE … UNION ALL`` plan.

    For shallow, acyclic data: a level of the recursion costs one join and no write, but a fact is made
    once for each path to it, and only the end removes duplicates. So cyclic data never come to an end;
    they, and data deeper than ``max_depth`` levels, are refused with Spark's error about the limit when
    the result is computed. Nothing is cut off. The same goes for more than ``max_rows`` rows with
    their duplicates, by default ``max_depth`` for each fact that the recursion starts from; the
    session's own limit stays where it is larger. Starts and steps are written below ``work_dir`` or the
    session's run folder, so no level computes them again and Spark knows their size.
    """
    spark, parts = kb.sparkSession, as_linear(rules)
    head = parts.step.head
    known = relation(kb, *head.key).select("s", *([] if head.is_type else ["o"]))
    heads = [match_body(kb, r, count_matches=False).select(*head_columns(r.head)) for r in parts.starts]
    folder = run_folder(spark, work_dir)
    start = reduce_(DataFrame.unionByName, heads, known).distinct()
    start.write.parquet(f"{folder}/start")
    start = spark.read.schema(start.schema).parquet(f"{folder}/start")
    step = step_pairs(kb, parts)
    step.write.parquet(f"{folder}/step")
    step = spark.read.schema(step.schema).parquet(f"{folder}/step")
    rows = max_depth * start.count() if max_rows is None else max_rows
    limit = int(spark.conf.get(ROW_LIMIT))
    if 0 <= limit < rows:
        spark.conf.set(ROW_LIMIT, str(rows))
    found = spark.sql(cte(parts, max_depth), start=start, step=step).distinct()
    new = found.join(known, found.columns, "left_anti")
    o = F.lit(head.o) if head.is_type else F.col("o")
    return new.select("s", F.lit(head.p).alias("p"), o.alias("o"))


def head_columns(head: Atom) -> list:
    return [head_term(head.s).alias("s")] + ([] if head.is_type else [head_term(head.o).alias("o")])


def places(atom: Atom) -> dict[str, str]:
    """Variable by column of an atom's relation."""
    return {"s": atom.s[1:]} if atom.is_type else {"s": atom.s[1:], "o": atom.o[1:]}


def step_pairs(kb: DataFrame, parts: Linear) -> DataFrame:
    """Distinct bindings of the atoms beside the recursive one: from_s, from_o, to_s, to_o, as far as they bind them."""
    rest = Rule(parts.step.rule_id, parts.others, parts.step.builtins, parts.step.head)
    matches = join_atoms([relation(kb, *a.key) for a in parts.others], rest)
    bound = {v for a in parts.others for v in a.variables}
    kept = [column(v).alias(f"from_{c}") for c, v in places(parts.own).items() if v in bound]
    head = parts.step.head
    ends = {"s": head.s} if head.is_type else {"s": head.s, "o": head.o}
    kept += [column(t[1:]).alias(f"to_{c}") for c, t in ends.items() if is_variable(t) and t[1:] in bound]
    kept += [F.lit(t).alias(f"to_{c}") for c, t in ends.items() if not is_variable(t)]
    return matches.select(*kept).distinct()


def cte(parts: Linear, max_depth: int) -> str:
    """The text of the plan over ``{start}`` and ``{step}``; it holds column names only."""
    head, own = parts.step.head, places(parts.own)
    bound = {v for a in parts.others for v in a.variables}
    on = " AND ".join(f"known.{c} = step.from_{c}" for c, v in own.items() if v in bound)
    by_variable = {v: c for c, v in own.items()}
    ends = {"s": head.s} if head.is_type else {"s": head.s, "o": head.o}
    to = [
        f"known.{by_variable[t[1:]]} AS {c}" if is_variable(t) and t[1:] not in bound else f"step.to_{c} AS {c}"
        for c, t in ends.items()
    ]
    names = ", ".join(ends)
    return f"""WITH RECURSIVE known({names}) MAX RECURSION LEVEL {max_depth} AS (
        SELECT {names} FROM {{start}} UNION ALL SELECT {", ".join(to)} FROM known JOIN {{step}} step ON {on})
        SELECT {names} FROM known"""
