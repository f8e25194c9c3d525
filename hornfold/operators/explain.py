"""Explanations: the ordered premises of each match with the conclusion it gives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornfold.functions.terms import render_triple, triple_struct
from hornfold.operators.heads import head_term
from hornfold.operators.match import match_body
from hornfold.sources.rules import Rule, RuleSet

EXPLANATION_SCHEMA = (
    "rule_id int, premises array<struct<s:string,p:string,o:string>>, conclusion struct<s:string,p:string,o:string>"
)


def with_conclusion(matches: DataFrame, rule: Rule) -> DataFrame:
    """Pair the premises of each match with its conclusion."""
    head = rule.head
    return matches.select(
        F.lit(rule.rule_id).alias("rule_id"),
        "premises",
        triple_struct(head_term(head.s), F.lit(head.p), head_term(head.o)).alias("conclusion"),
    )


def explain_matches(kb: DataFrame, rules: RuleSet) -> DataFrame:
    """Explanations of one step of every rule over ``kb``, one row per match, lazy."""
    return reduce(
        DataFrame.unionByName,
        (with_conclusion(match_body(kb, rule, explain=True), rule) for rule in rules.rules),
    )


def render_explanations(explanations: DataFrame) -> DataFrame:
    """Premises and conclusion as ``(s p o)`` text."""
    return explanations.withColumns(
        {
            "premises": F.transform("premises", render_triple),
            "conclusion": render_triple(F.col("conclusion")),
        }
    )


def save_explanations(explanations: DataFrame, path: str, *, mode: str = "error") -> None:
    """Write explanations as Parquet, one directory per phase."""
    explanations.write.mode(mode).partitionBy("phase").parquet(path)
