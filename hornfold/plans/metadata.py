"""Small tables about the rules themselves (M1-M4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornfold.sources.rules import RuleSet


def predicates(rules: RuleSet) -> DataFrame:
    """Distinct predicate keys of all bodies and heads (M2)."""
    return rules.atoms.filter(F.col("role") != "builtin").select("pred_key", "is_type").distinct()


def rule_deps(rules: RuleSet) -> DataFrame:
    """``(src, dst)`` when the head of rule ``src`` feeds the body of rule ``dst`` (M3)."""
    heads = rules.atoms.filter(F.col("role") == "head").select(F.col("rule_id").alias("src"), "pred_key", "is_type")
    bodies = rules.atoms.filter(F.col("role") == "body").select(F.col("rule_id").alias("dst"), "pred_key", "is_type")
    return heads.join(bodies, ["pred_key", "is_type"]).select("src", "dst").distinct()


def triggered_rules(deps: DataFrame, fired: DataFrame) -> DataFrame:
    """Rules to run next, given the ``rule_id`` of those that derived something new (M4)."""
    return deps.join(fired.select(F.col("rule_id").alias("src")), "src", "left_semi").select(
        F.col("dst").alias("rule_id")
    ).distinct()
