"""Forward chaining to a fixpoint, semi-naively, one set of Spark jobs per phase (L1-L4)."""

from __future__ import annotations

import logging
import math
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce as reduce_

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from hornfold.operators.explain import EXPLANATION_SCHEMA, with_conclusion
from hornfold.operators.heads import head_term
from hornfold.operators.match import join_atoms, rows_expected
from hornfold.plans.doubling import doubled
from hornfold.plans.facts import FACT, FactTables, key_metrics
from hornfold.sources.folders import claim_folder, last_part, remove_folder, run_folder
from hornfold.sources.rules import Key, Rule, RuleSet
from hornfold.sources.triples import TRIPLE_COLUMNS, union_triples, without_rules

logger = logging.getLogger("hornfold")

#: Candidates that a task can hold in memory, by estimate; with more they are sorted, which can spill.
HASHED_A_TASK = 500_000


@dataclass(frozen=True)
class Inference:
    """``kb`` is the closure, ``inferred`` what was added to the input.

    ``stats`` has one row per phase and triggered rule: ``matched`` new body matches, ``inferred``
    distinct triples they give, ``new`` those not known before the phase, ``matched_so_far`` the
    running total of ``matched``. ``phases`` has one row per phase.
    """

    kb: DataFrame
    inferred: DataFrame
    explanations: DataFrame | None
    stats: DataFrame
    phases: DataFrame
    converged: bool
    folder: str
    base: DataFrame
    staged: bool

    def cleanup(self) -> None:
        """Delete the tables of the run. Frames that read them, ``kb`` included, can't be used afterwards."""
        remove_folder(self.stats.sparkSession, self.folder)


@dataclass
class Progress:
    """Where the phase loop is."""

    phase: int
    triggered: list[Rule]
    stats: list[tuple[int, int, int, int, int]]
    phases: list[tuple[int, list[int], int, int, float]]

    def record(self) -> dict[str, object]:
        return {"triggered": [rule.rule_id for rule in self.triggered], "stats": self.stats, "phases": self.phases}


def infer(
    kb: DataFrame,
    rules: RuleSet,
    *,
    max_phases: int | None = None,
    explain: bool = False,
    explain_path: str | None = None,
    mode: str = "error",
    count_matches: bool = True,
    distinct_input: bool = False,
    stage: bool | None = None,
    work_dir: str | None = None,
    reduce: bool = False,
    doubling: bool = False,
    salt: bool = False,
    resume: str | None = None,
) -> Inference:
    """Apply ``rules`` to ``kb`` until a phase derives nothing new.

    All matches of a phase see the facts as they were at its start. ``count_matches=False`` lets
    ``matched`` count bindings with unneeded variables tested for existence only, which avoids
    fan-out. ``distinct_input=True`` skips removing duplicates from ``kb``.

    ``stage`` says whether the facts the rules can use are first copied into one table per key;
    by default when several phases may read them. Pass ``stage=False`` for a table written by
    ``save_triples``, which has that layout already. Tables of the run are written below
    ``work_dir`` or, by default, ``spark.checkpoint.dir``.

    With ``explain_path`` each phase writes its explanations to a directory of its own there, once;
    ``mode`` is ``error``, ``overwrite`` or ``append``, for a path where something is. Appended phases are
    numbered on from the last one there, and ``explanations`` holds those of this run. ``cleanup`` leaves them.

    ``reduce=True`` reduces the relations of each body by semi-joins before they are joined.
    ``salt=True`` has each write report the values most facts share; in the joins of later steps a value
    with more rows than a task's fair share goes to several tasks, with its partners copied to each, so a
    hot node needs no adaptive splitting, which an aggregate after the join can prevent.
    ``doubling=True`` joins a transitive closure with itself (see ``doubled``), which takes phases by the
    logarithm of the depth and gives the same facts. The matches are then other ones, so it excludes
    explanations. Whether a predicate has base facts must be known: facts that are neither staged nor
    stored by key count as having some.

    ``resume`` is the ``folder`` of a run over the same facts and rules that was lost: its finished phases
    are read from there, and the run goes on.
    """
    explain = explain or explain_path is not None
    if doubling and explain:
        raise ValueError("explanations are of the rules as they are written: leave doubling out")
    staged = rules.feeds_itself and max_phases != 1 if stage is None else stage
    folder = resume or run_folder(kb.sparkSession, work_dir)
    facts = FactTables(kb, rules, folder, staged=staged, distinct_input=distinct_input, salt=salt)
    progress = Progress(0, list(rules.rules), [], [])
    found = facts.last_manifest() if resume else None
    if resume and found is None:
        remove_folder(kb.sparkSession, folder)  # lost before the facts were staged
    if found:
        take_up(facts, rules, found, progress)
    elif explain_path is not None:
        claim_folder(kb.sparkSession, explain_path, mode)
        facts.explained_before = last_part(kb.sparkSession, explain_path, "phase")
    if not found:
        facts.explain_path = explain_path or facts.explain_path
        facts.fit_input()
    facts.create()
    try:
        if not found:
            facts.prepare()
            warn_of_idle_atoms(facts, rules)
            facts.save_manifest(0, progress.record())
        if doubling:
            rules = doubled(rules, facts.has_base)
            progress.triggered = [r for r in rules.rules if r.rule_id in {t.rule_id for t in progress.triggered}]
        run_phases(facts, rules, progress, max_phases, explain, count_matches, reduce)
    finally:
        facts.forget()
    base = kb.select(*TRIPLE_COLUMNS)
    return inference(facts, progress, base if distinct_input else base.distinct(), explain)


def extend(
    result: Inference,
    added: DataFrame,
    rules: RuleSet,
    *,
    count_matches: bool = True,
    reduce: bool = False,
    salt: bool = False,
) -> Inference:
    """Add facts to the closure of a finished run and close it again, with the run's own ``rules``.

    The first phase takes the added facts that weren't known as the new ones, so no match among old
    facts is repeated, and nothing is copied. The run goes on in its folder: of ``result`` the frames stay
    valid, but only one of the two can be cleaned up. ``stats`` and ``phases`` are those of both.
    """
    facts = FactTables(result.base, rules, result.folder, staged=result.staged, distinct_input=True, salt=salt)
    found = facts.last_manifest()
    if found is None or not result.converged:
        raise ValueError("only a run that has come to its end can be extended")
    progress = Progress(0, [], [], [])
    take_up(facts, rules, found, progress)
    facts.create()
    try:
        facts.add(added.select(*TRIPLE_COLUMNS), progress.phase)
        facts.deal_anew()
        progress.triggered = fed_by(rules, facts.newest_rows)
        facts.save_manifest(progress.phase, progress.record())
        run_phases(facts, rules, progress, None, False, count_matches, reduce)
    finally:
        facts.forget()
    return inference(facts, progress, union_triples(result.kb, *facts.added(), unnamed(added, result.kb, rules)), False)


def unnamed(added: DataFrame, kb: DataFrame, rules: RuleSet) -> DataFrame:
    """The facts of ``added`` that no rule names and ``kb`` hasn't; those that rules name were compared and written."""
    added, kb = (without_rules(frame.select(*TRIPLE_COLUMNS), rules) for frame in (added, kb))
    return added.distinct().join(kb, list(TRIPLE_COLUMNS), "left_anti")


def run_phases(
    facts: FactTables,
    rules: RuleSet,
    progress: Progress,
    max_phases: int | None,
    explain: bool,
    count_matches: bool,
    reduce: bool,
) -> None:
    slots = head_slots(rules)
    while progress.triggered and (max_phases is None or progress.phase < max_phases):
        progress.phase += 1
        started = time.monotonic()
        triggered = progress.triggered
        counts, new_rows = run_phase(facts, triggered, slots, progress.phase, explain, count_matches, reduce)
        progress.stats += [(progress.phase, r.rule_id, *counts.get(r.rule_id, (0, 0, 0))) for r in triggered]
        matched = sum(n for n, _, _ in counts.values())
        seconds = time.monotonic() - started
        progress.phases.append((progress.phase, [r.rule_id for r in triggered], matched, sum(new_rows.values()), seconds))
        facts.advance(progress.phase, new_rows)
        facts.deal_anew()
        progress.triggered = fed_by(rules, new_rows)
        facts.save_manifest(progress.phase, progress.record())
        facts.drop_copied()


def fed_by(rules: RuleSet, keys: Iterable[Key]) -> list[Rule]:
    """The rules whose bodies read one of ``keys``."""
    return [rule for rule in rules.rules if any(atom.key in keys for atom in rule.body)]


def take_up(facts: FactTables, rules: RuleSet, found: dict, progress: Progress) -> None:
    """Go back to where a manifest was written."""
    facts.restore(found["facts"])
    facts.clear_unrecorded()
    progress.phase = found["phase"]
    progress.triggered = [rule for rule in rules.rules if rule.rule_id in found["triggered"]]
    progress.stats = [tuple(row) for row in found["stats"]]
    progress.phases = [tuple(row) for row in found["phases"]]


def inference(facts: FactTables, progress: Progress, base: DataFrame, explain: bool) -> Inference:
    inferred = facts.derived()
    return Inference(
        kb=base.unionByName(inferred),
        inferred=inferred,
        explanations=read_explanations(facts) if explain else None,
        stats=stats_table(facts, progress.stats),
        phases=facts.spark.createDataFrame(
            progress.phases, "phase int, triggered array<int>, matched bigint, new bigint, seconds double"
        ),
        converged=not progress.triggered,
        folder=facts.folder,
        base=facts.kb,
        staged=facts.staged,
    )


def warn_of_idle_atoms(facts: FactTables, rules: RuleSet) -> None:
    """Name body atoms that no fact and no head can meet, such as a misspelt builtin."""
    heads = {rule.head.key for rule in rules.rules}
    for key in dict.fromkeys(atom.key for rule in rules.rules for atom in rule.body):
        if key not in heads and not facts.has_base(key):
            logger.warning("no facts for %s %s", "class" if key[1] else "predicate", key[0])


def head_slots(rules: RuleSet) -> dict[int, int]:
    """Number each rule among those sharing its head key.

    Equal triples can only come from rules of one head key, so a candidate needs one counter per
    slot, not per rule, to tell which rules derived it.
    """
    used: dict[Key, int] = {}
    slots = {}
    for rule in rules.rules:
        slots[rule.rule_id] = used.get(rule.head.key, 0)
        used[rule.head.key] = slots[rule.rule_id] + 1
    return slots


def run_phase(
    facts: FactTables,
    triggered: list[Rule],
    slots: dict[int, int],
    phase: int,
    explain: bool,
    count_matches: bool,
    reduce: bool,
) -> tuple[dict[int, tuple[int, int, int]], dict[Key, int]]:
    """Write the new facts of a phase.

    Returns per rule the matched, inferred and new counts, and per key the number of new facts; both
    are bounded by the number of rules and reported by the write itself.
    """
    terms = [
        (rule, matches)
        for rule in triggered
        for matches in phase_terms(facts, rule, phase, explain, count_matches, reduce)
    ]
    if not terms:
        return {}, {}
    if explain:
        heads = write_explanations(facts, terms, slots, phase)
    else:
        heads = reduce_(DataFrame.unionByName, (head_rows(facts, rule, slots, matches) for rule, matches in terms))
    live = {rule.rule_id: rule for rule, _ in terms}
    counters = [f"matched_{i}" for i in range(1 + max(slots[rule_id] for rule_id in live))]
    candidates = heads.groupBy(*FACT).agg(*(F.count_if(F.col("slot") == i).alias(c) for i, c in enumerate(counters)))
    head_keys = list(dict.fromkeys(rule.head.key for rule in live.values()))
    few = sum(candidates_expected(facts, rule, phase) for rule in live.values()) <= facts.buckets * HASHED_A_TASK
    marked = mark_new(candidates, facts.known(head_keys), hashed=few)
    seen = Observation(f"phase {phase}")
    metrics = key_metrics([facts.ids[key] for key in head_keys], F.col("is_new"), facts.salt)
    metrics += [m for rule in live.values() for m in rule_metrics(facts, rule, slots)]
    facts.write(marked.observe(seen, *metrics).filter("is_new"), phase)
    return counted(facts, seen.get, live, head_keys)


def phase_terms(
    facts: FactTables, rule: Rule, phase: int, explain: bool, count_matches: bool, reduce: bool
) -> Iterator[DataFrame]:
    """Body matches that use at least one fact of the latest phase, each exactly once.

    For every atom with new facts: that atom reads the new ones, atoms before it the older ones,
    atoms after it both. In the first phase of a run all atoms read the base facts.
    """
    keys = [atom.key for atom in rule.body]
    options = {
        "fanouts": [facts.fanout(key) for key in keys],
        "pieces": [facts.pieces(key) for key in keys],
        "explain": explain,
        "count_matches": count_matches,
        "reduce": reduce,
    }
    if phase == 1:
        if all(facts.has_base(key) for key in keys):
            yield join_atoms([facts.base(key) for key in keys], rule, **options)
        return
    for i, key in enumerate(keys):
        if key not in facts.newest_rows:
            continue
        relations = [
            facts.delta(k) if j == i else facts.old(k) if j < i else facts.all(k) for j, k in enumerate(keys)
        ]
        if all(rel is not None for rel in relations):
            yield join_atoms(relations, rule, first=i, **options)


def head_rows(facts: FactTables, rule: Rule, slots: dict[int, int], matches: DataFrame) -> DataFrame:
    return matches.select(
        fact_key(facts.ids[rule.head.key], head_term(rule.head.s), head_term(rule.head.o)).alias("k"),
        F.lit(slots[rule.rule_id]).alias("slot"),
        head_term(rule.head.s).alias("s"),
        head_term(rule.head.o).alias("o"),
    )


def fact_key(i: int, s: Column, o: Column) -> Column:
    """A key's number as an expression of the row.

    A plain constant would be taken out of the join with the known facts, which are dealt by key, subject
    and object: they would all be shuffled to be dealt by subject and object alone.
    """
    return F.least(F.lit(i), F.lit(i) + F.char_length(s) + F.char_length(o))


def candidates_expected(facts: FactTables, rule: Rule, phase: int) -> float:
    """How many matches ``phase_terms`` finds, by the counts of earlier writes; infinite where nothing was counted."""
    keys = [atom.key for atom in rule.body]
    fanouts = [facts.fanout(key) for key in keys]
    if any(fanout is None for fanout in fanouts):
        return math.inf
    starts = [(None, None)] if phase == 1 else [(i, facts.newest_rows[k]) for i, k in enumerate(keys) if k in facts.newest_rows]
    return sum(rows_expected(rule.body, i, fanouts, rows) for i, rows in starts)


def mark_new(candidates: DataFrame, known: DataFrame | None, *, hashed: bool = False) -> DataFrame:
    """Add ``is_new``: whether a candidate was unknown before the phase.

    ``hashed`` candidates are held in memory, a task's share at a time, and the known facts run past them;
    otherwise both are sorted, the known ones in every phase anew.
    """
    if known is None:
        return candidates.withColumn("is_new", F.lit(True))
    candidates = candidates.hint("shuffle_hash") if hashed else candidates
    marked = candidates.join(known.withColumn("seen", F.lit(True)), FACT, "left")
    return marked.withColumn("is_new", F.col("seen").isNull()).drop("seen")


def rule_metrics(facts: FactTables, rule: Rule, slots: dict[int, int]) -> list[Column]:
    """Matches of a rule, facts they give and how many of those are new, as metrics of the write (A1-A3)."""
    i, of_key = rule.rule_id, F.col("k") == facts.ids[rule.head.key]
    counter = F.col(f"matched_{slots[i]}")
    gave = of_key & (counter > 0)
    return [
        F.sum(F.when(of_key, counter)).alias(f"matched by {i}"),
        F.count_if(gave).alias(f"inferred by {i}"),
        F.count_if(gave & F.col("is_new")).alias(f"new by {i}"),
    ]


def counted(
    facts: FactTables, metrics: dict[str, int], live: dict[int, Rule], head_keys: list[Key]
) -> tuple[dict[int, tuple[int, int, int]], dict[Key, int]]:
    """Counts per rule and per key from the metrics of a phase's write."""
    counts = {i: tuple(metrics[f"{name} by {i}"] or 0 for name in ("matched", "inferred", "new")) for i in live}
    new_rows = {}
    for key in head_keys:
        found = facts.profile_of(metrics, facts.ids[key])
        if found["facts"]:
            new_rows[key] = found["facts"]
            facts.learn(key, found)
    return counts, new_rows


def write_explanations(
    facts: FactTables, terms: list[tuple[Rule, DataFrame]], slots: dict[int, int], phase: int
) -> DataFrame:
    """Write one explanation per match (S6) and return the head rows read back from them."""
    path = f"{facts.explain_path}/phase={facts.explained_before + phase}"
    remove_folder(facts.spark, path)  # of a run that was lost in this phase
    reduce_(DataFrame.unionByName, (with_conclusion(matches, rule) for rule, matches in terms)).write.parquet(path)
    facts.explained = True
    written = facts.spark.read.schema(EXPLANATION_SCHEMA).parquet(path)
    rules = {rule.rule_id: rule for rule, _ in terms}
    of_rule = {
        "k": {i: facts.ids[rule.head.key] for i, rule in rules.items()},
        "slot": {i: slots[i] for i in rules},
    }
    # One entry per rule.
    numbers = [
        F.create_map(*(F.lit(n) for pair in found.items() for n in pair))[F.col("rule_id")].alias(name)
        for name, found in of_rule.items()
    ]
    return written.select(*numbers, F.col("conclusion.s").alias("s"), F.col("conclusion.o").alias("o"))


def read_explanations(facts: FactTables) -> DataFrame:
    schema = f"{EXPLANATION_SCHEMA}, phase int"
    if not facts.explained and not facts.explained_before:
        facts.spark.createDataFrame([], schema).write.partitionBy("phase").parquet(facts.explain_path)
    table = facts.spark.read.schema(schema).parquet(facts.explain_path).filter(F.col("phase") > facts.explained_before)
    return table.select("phase", "rule_id", "premises", "conclusion")


def stats_table(facts: FactTables, rows: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Statistics per phase and rule, with the running number of matches."""
    table = facts.spark.createDataFrame(rows, "phase int, rule_id int, matched bigint, inferred bigint, new bigint")
    so_far = Window.partitionBy("rule_id").orderBy("phase").rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumn("matched_so_far", F.sum("matched").over(so_far))
