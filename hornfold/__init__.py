"""Forward-chaining rule inference over tables of subject-predicate-object facts."""

from hornfold.functions.terms import RDF_TYPE
from hornfold.operators.explain import explain_matches, render_explanations, save_explanations
from hornfold.operators.heads import apply_rules, instantiate
from hornfold.operators.match import match_body
from hornfold.plans.doubling import doubled
from hornfold.plans.fixpoint import Inference, extend, infer
from hornfold.plans.metadata import predicates, rule_deps, triggered_rules
from hornfold.plans.recursion import linear_closure
from hornfold.plans.session import tune
from hornfold.sources.rules import Atom, Rule, RuleSet, load_rules, rules_from_lines
from hornfold.sources.triples import (
    edge_triples,
    load_triples,
    member_triples,
    parse_triple_lines,
    save_triples,
    union_triples,
    write_triple_lines,
)

__all__ = [
    "Atom",
    "Inference",
    "RDF_TYPE",
    "Rule",
    "RuleSet",
    "apply_rules",
    "doubled",
    "edge_triples",
    "explain_matches",
    "extend",
    "infer",
    "instantiate",
    "linear_closure",
    "load_rules",
    "load_triples",
    "match_body",
    "member_triples",
    "parse_triple_lines",
    "predicates",
    "render_explanations",
    "rule_deps",
    "rules_from_lines",
    "save_explanations",
    "save_triples",
    "triggered_rules",
    "tune",
    "union_triples",
    "write_triple_lines",
]
