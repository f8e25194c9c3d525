"""Rule files as a table of atoms, and the checks a rule must pass before it is evaluated."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornfold.functions.terms import BUILTINS, RDF_TYPE

Key = tuple[str, bool]

# Shapes of the rule text. A term is a quoted literal (a suffix is dropped, as in the data),
# an IRI in angle brackets, or a bare word.
_LITERAL = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_WORD = r'<[^>]*>|[^\s()^,"<>]+'
_TERM = rf"{_LITERAL}(?:@[\w-]+|\^\^(?:<[^>]*>|[\w:]+))?|{_WORD}"
_NAME = rf"(?:rdf:type\s+)?(?:{_WORD})"
_ATOM = rf"{_NAME}\s*\(\s*(?:{_TERM})(?:[\s,]+(?:{_TERM}))?\s*\)"
_RULE = rf"^\s*{_ATOM}(?:\s*\^\s*{_ATOM})*\s*->\s*{_ATOM}\s*$"
_ATOM_PARTS = rf"(?s)^({_NAME})\s*\((.*)\)$"


@dataclass(frozen=True)
class Atom:
    """A triple pattern, or a builtin call with ``p`` as its name. ``?x`` is a variable."""

    s: str
    p: str
    o: str
    is_type: bool
    pred_key: str | None

    @property
    def key(self) -> Key:
        return (self.pred_key, self.is_type)

    @property
    def variables(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(t[1:] for t in (self.s, self.o) if is_variable(t)))


@dataclass(frozen=True)
class Rule:
    rule_id: int
    body: tuple[Atom, ...]
    builtins: tuple[Atom, ...]
    head: Atom


@dataclass(frozen=True)
class RuleSet:
    """``atoms`` is the rule table; ``rules`` holds the same few rows for composing expressions."""

    atoms: DataFrame
    rules: tuple[Rule, ...]

    @cached_property
    def keys(self) -> tuple[Key, ...]:
        """Distinct predicate keys over all bodies and heads (M2)."""
        return tuple(dict.fromkeys(a.key for r in self.rules for a in (*r.body, r.head)))

    @cached_property
    def feeds_itself(self) -> bool:
        """Whether some rule can use what another one, or itself, derives."""
        heads = {r.head.key for r in self.rules}
        return any(a.key in heads for r in self.rules for a in r.body)


def is_variable(term: str) -> bool:
    return term.startswith("?")


def load_rules(spark: SparkSession, path: str, prefixes: Mapping[str, str] | None = None) -> RuleSet:
    """Read a rule file, one ``atom ^ atom -> atom`` per line; blank and ``#`` lines are skipped (S3)."""
    files = spark.read.text(path, wholetext=True).selectExpr(
        "_metadata.file_path AS file", r"split(value, r'\r\n|\n|\r') AS lines"
    )
    lines = files.selectExpr("flatten(array_sort(collect_list(struct(file, lines))).lines) AS lines")
    return _rule_set(lines, prefixes)


def rules_from_lines(
    spark: SparkSession, lines: Iterable[str], prefixes: Mapping[str, str] | None = None
) -> RuleSet:
    """Like ``load_rules`` for rules given as strings."""
    text = spark.range(0, 1, 1, 1).select(F.array(*map(F.lit, lines)).cast("array<string>").alias("lines"))
    return _rule_set(text, prefixes)


def _rule_set(lines: DataFrame, prefixes: Mapping[str, str] | None) -> RuleSet:
    atoms = rule_atoms(lines, prefixes or {})
    rows = sorted(atoms.collect(), key=lambda row: (row["rule_id"], row["pos"]))
    grouped: dict[int, dict[str, list[Atom]]] = {}
    for row in rows:
        if row["role"] == "malformed":
            raise ValueError(f"rule {row['rule_id']}: cannot read {row['s']!r}")
        atom = Atom(plain_literal(row["s"]), row["p"], plain_literal(row["o"]), row["is_type"], row["pred_key"])
        grouped.setdefault(row["rule_id"], {"body": [], "builtin": [], "head": []})[row["role"]].append(atom)
    rules = tuple(
        Rule(rule_id, tuple(parts["body"]), tuple(parts["builtin"]), parts["head"][0])
        for rule_id, parts in grouped.items()
    )
    for rule in rules:
        check_rule(rule)
    return RuleSet(atoms, tuple(map(with_separate_names, rules)))


def plain_literal(term: str | None) -> str | None:
    """A literal of a rule as facts hold it, without escapes."""
    if not term or not term.startswith('"') or "\\" not in term:
        return term
    parts = term.split("\\\\")
    for escape, plain in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        parts = [part.replace(escape, plain) for part in parts]
    return "\\".join(parts)


def normalised(token: str) -> str:
    """SQL for a term: variables stay, literals lose their suffix, words become IRIs."""
    word = f"regexp_replace({token}, r'^<|>$', '')"
    expanded = f"prefixes[split_part({word}, ':', 1)] || substring({word}, instr({word}, ':') + 1)"
    return rf"""CASE WHEN startswith({token}, '?') THEN {token}
        WHEN startswith({token}, '"') THEN regexp_extract({token}, r'^({_LITERAL})', 1)
        WHEN instr({word}, ':') > 0 THEN '<' || coalesce({expanded}, {word}) || '>'
        ELSE '<' || {word} || '>' END"""


def rule_atoms(lines: DataFrame, prefixes: Mapping[str, str]) -> DataFrame:
    """``rule_id, role, pos, s, p, o, is_type, pred_key`` from one array of rule lines."""
    arguments = f"regexp_extract_all(regexp_extract(text, r'{_ATOM_PARTS}', 2), r'{_TERM}', 0)"
    builtins = ", ".join(f"'{name}'" for name in BUILTINS)
    return (
        lines.withColumn("prefixes", F.from_json(F.lit(json.dumps(dict(prefixes))), "map<string,string>"))
        .selectExpr(
            "prefixes", "posexplode(filter(lines, l -> trim(l) != '' AND NOT startswith(trim(l), '#'))) AS (n, line)"
        )
        .selectExpr(
            "prefixes",
            "n + 1 AS rule_id",
            f"line RLIKE r'{_RULE}' AS ok",
            f"if(line RLIKE r'{_RULE}', regexp_extract_all(line, r'{_ATOM}', 0), array(line)) AS texts",
        )
        .selectExpr("prefixes", "rule_id", "ok", "size(texts) AS n_atoms", "posexplode(texts) AS (pos, text)")
        .selectExpr(
            "*",
            f"transform({arguments}, t -> {normalised('t')}) AS args",
            rf"regexp_extract(text, r'{_ATOM_PARTS}', 1) RLIKE r'^rdf:type\s' AS marked_class",
            rf"regexp_replace(regexp_extract(text, r'{_ATOM_PARTS}', 1), r'^rdf:type\s+', '') AS called",
        )
        .selectExpr(
            "*",
            f"{normalised('called')} AS name",
            "size(args) = 1 AS unary",
            f"size(args) = 2 AND regexp_replace(called, '[<>]', '') IN ({builtins}) AS is_builtin",
        )
        .selectExpr(
            "rule_id",
            # "rdf:type C(?x, ?y)" has no meaning; it is reported rather than guessed at.
            """CASE WHEN NOT ok OR (marked_class AND NOT unary) THEN 'malformed'
                    WHEN pos = n_atoms - 1 THEN 'head' WHEN is_builtin THEN 'builtin' ELSE 'body' END AS role""",
            "pos",
            "if(ok, get(args, 0), text) AS s",
            f"""CASE WHEN unary OR name = '<rdf:type>' THEN '{RDF_TYPE}'
                     WHEN is_builtin AND pos < n_atoms - 1 THEN regexp_replace(called, '[<>]', '') ELSE name END AS p""",
            "if(unary, name, get(args, 1)) AS o",
        )
        .selectExpr(
            "*",
            f"p = '{RDF_TYPE}' AS is_type",
            f"CASE WHEN role IN ('body', 'head') THEN if(p = '{RDF_TYPE}', o, p) END AS pred_key",
        )
    )


def with_separate_names(rule: Rule) -> Rule:
    """Rename variables that would clash as columns: names are compared without case."""
    taken, names = {"premises"}, {}
    for variable in dict.fromkeys(v for atom in rule.body for v in atom.variables):
        name, n = variable, 1
        while name.lower() in taken:
            n += 1
            name = f"{variable}_{n}"
        taken.add(name.lower())
        names[f"?{variable}"] = f"?{name}"

    def renamed(atom: Atom) -> Atom:
        return replace(atom, s=names.get(atom.s, atom.s), o=names.get(atom.o, atom.o))

    return replace(
        rule, body=tuple(map(renamed, rule.body)), builtins=tuple(map(renamed, rule.builtins)), head=renamed(rule.head)
    )


def check_rule(rule: Rule) -> None:
    """Reject rules that have no finite or no safe reading."""
    where = f"rule {rule.rule_id}"
    for atom in (*rule.body, rule.head):
        if is_variable(re.sub("^<", "", atom.p)):
            raise ValueError(f"{where}: the predicate {atom.p} is a variable")
        if is_variable(re.sub("^<", "", atom.pred_key)):
            raise ValueError(f"{where}: the class {atom.pred_key} is a variable")
    if not rule.body:
        raise ValueError(f"{where}: the body holds no atom that could be matched")
    bound = {v for atom in rule.body for v in atom.variables}
    for atom in (*rule.builtins, rule.head):
        unbound = [v for v in atom.variables if v not in bound]
        if unbound:
            raise ValueError(f"{where}: ?{unbound[0]} is not bound by the body")
    open_atoms = [set(a.variables) for a in rule.body if a.variables]
    reached: set[str] = open_atoms[0].copy() if open_atoms else set()
    waiting = open_atoms[1:]
    while connected := [vs for vs in waiting if vs & reached]:
        waiting = [vs for vs in waiting if not vs & reached]
        reached.update(*connected)
    if waiting:
        raise ValueError(f"{where}: the body falls into parts that share no variable")
