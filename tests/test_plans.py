"""Physical plans: what is read, what is shuffled, how skew is met."""

import random
import re
from collections import Counter
from itertools import permutations
from pathlib import Path
from statistics import median

import pytest
from helpers import as_set, brute_closure, iri, kb_of, rules_of, triples
from pyarrow import parquet
from pyspark.sql import functions as F

import __spark_entry__ as entry
import hornfold as hf
from hornfold.operators.match import ears, join_atoms, join_order
from hornfold.plans import fixpoint
from hornfold.plans.facts import FactTables
from hornfold.plans.fixpoint import mark_new, run_phase

SF_DIR = "/root/testdata/sf0.001"
NO_EQUI_KEY = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def executed(frame):
    frame.collect()
    return plan(frame)


@pytest.fixture
def conf(spark):
    before = {}

    def put(**settings):
        for key, value in settings.items():
            name = "spark.sql." + key.replace("__", ".")
            before.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, str(value))

    yield put
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_only_the_tables_and_columns_a_rule_needs_are_read(spark):
    text = plan(entry.queries()["chain2"](spark, SF_DIR))
    assert set(re.findall(r"(\w+)\.parquet", text)) == {"customer", "supplier", "nation"}
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", text)) == {
        "c_custkey:bigint,c_nationkey:int",
        "s_suppkey:bigint,s_nationkey:int",
        "n_nationkey:int,n_regionkey:int",
    }


@pytest.mark.parametrize("name", list(entry.STEPS))
def test_rule_bodies_are_equi_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert not any(node in text for node in NO_EQUI_KEY)
    assert "Python" not in text


def test_numeric_filters_reach_the_scan(spark):
    text = plan(entry.queries()["builtin_le"](spark, SF_DIR))
    assert re.search(r"Filter .*try_cast.*\n(.*ColumnarToRow.*\n)?.*FileScan", text)


def test_the_shuffle_carries_only_what_varies(spark):
    text = plan(entry.queries()["builtin_le"](spark, SF_DIR))
    assert len(re.findall(r"Exchange hashpartitioning\(s#\d+,? ?\d*\)", text)) == 1


def test_existence_tests_shrink_hot_keys_before_the_shuffle(spark, conf):
    conf(autoBroadcastJoinThreshold=-1)
    kb = kb_of(spark, triples("k in n") | {(iri(f"o{i}"), iri("by"), iri("k")) for i in range(500)})
    frame = hf.apply_rules(kb, rules_of(spark, "by(?o,?s) ^ in(?s,?n) -> Active(?n)"))
    text = executed(frame)
    assert "LeftSemi" in text
    assert as_set(frame) == triples("n type Active")
    # Each map task sends one row per key, not one per fact.
    exchanged = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanged and "HashAggregate" in text.split(exchanged[-1])[1].splitlines()[1]


def test_a_hot_join_key_is_split(spark, conf):
    conf(
        autoBroadcastJoinThreshold=-1,
        adaptive__autoBroadcastJoinThreshold=-1,
        adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        adaptive__skewJoin__skewedPartitionFactor=2,
        adaptive__advisoryPartitionSizeInBytes="10KB",
        adaptive__coalescePartitions__enabled="false",
        adaptive__forceOptimizeSkewedJoin="true",
    )
    n = 12_000
    # One customer placed a third of all orders.
    orders = spark.range(0, n, 1, 8).selectExpr(
        "concat('<o', id, '>') AS s", "'<placedBy>' AS p", "concat('<c', if(id % 3 = 0, 0, id), '>') AS o"
    )
    home = spark.range(0, n, 1, 8).selectExpr("concat('<c', id, '>') AS s", "'<in>' AS p", "concat('<n', id % 7, '>') AS o")
    frame = hf.apply_rules(orders.unionByName(home), rules_of(spark, "placedBy(?o,?c) ^ in(?c,?n) -> from(?o,?n)"))
    assert frame.count() == n
    text = executed(frame)
    assert "skew=true" in text


def test_results_do_not_depend_on_broadcasting(spark, conf):
    rules = rules_of(spark, "e(?x,?y) -> t(?x,?y)", "t(?x,?y)^e(?y,?z)^C(?z) -> t(?x,?z)")
    facts = triples("a e b\nb e c\nc e a\nc e d\na type C\nb type C\nc type C")
    conf(autoBroadcastJoinThreshold=-1, adaptive__autoBroadcastJoinThreshold=-1)
    assert as_set(hf.infer(kb_of(spark, facts), rules).kb) == brute_closure(rules.rules, facts)[0]


def test_a_predicate_holding_most_facts_is_staged_in_many_files(spark, conf, tmp_path):
    conf(shuffle__partitions=7)
    hot = spark.range(0, 20_000, 1, 8).selectExpr("concat('<a', id, '>') AS s", "'<hot>' AS p", "concat('<b', id % 97, '>') AS o")
    rules = rules_of(spark, "hot(?x,?y) ^ cold(?y,?z) -> t(?x,?z)", "t(?x,?y) -> hot(?x,?y)")
    result = hf.infer(hot.unionByName(kb_of(spark, "b1 cold c")), rules, work_dir=str(tmp_path), distinct_input=True)
    files = {path.parent.name: len(list(path.glob("*.parquet"))) for path in (tmp_path / result.folder / "facts").glob("kp=*/phase=0")}
    assert files == {"kp=0": 7, "kp=1": 1}


@pytest.fixture
def staged(spark, conf, tmp_path):
    conf(autoBroadcastJoinThreshold=-1, adaptive__autoBroadcastJoinThreshold=-1)
    rules = rules_of(spark, "e(?x,?y) -> t(?x,?y)", "t(?x,?y)^e(?y,?z) -> t(?x,?z)")
    facts = FactTables(kb_of(spark, "a e b\nb e c\nc e d"), rules, str(tmp_path / "run"), staged=True, distinct_input=False)
    facts.create()
    facts.prepare()
    yield facts
    facts.forget()


def test_known_facts_are_not_shuffled(spark, staged):
    edge, path = staged.ids
    more = spark.createDataFrame([(1, "<a>", "<b>"), (1, "<b>", "<c>")], "k int, s string, o string")
    for phase in (1, 2):  # the table has facts of several phases
        staged.write(staged.bucketed(more.filter(F.lit(phase) == 1)), phase)
    heads = spark.createDataFrame([(1, "<a>", "<b>", 0), (1, "<a>", "<d>", 0), (0, "<a>", "<b>", 0)], "k int, s string, o string, slot int")
    marked = mark_new(heads.groupBy("k", "s", "o").agg(F.count("*").alias("n")), staged.known([edge, path]))
    assert {(r["s"], r["o"], r["k"]): r["is_new"] for r in marked.collect()} == {
        ("<a>", "<b>", 1): False, ("<a>", "<d>", 1): True, ("<a>", "<b>", 0): False,
    }
    initial = plan(marked).split("== Initial Plan ==")[-1]
    assert initial.count("FileScan") == 1 and "Bucketed: true" in initial
    # One exchange in all: that of the candidates.
    assert initial.count("Exchange hashpartitioning") == 1


def test_a_phase_of_one_rule_leaves_known_facts_where_they_are(spark, staged, monkeypatch):
    write, plans = FactTables.write, []

    def noted(self, facts, phase):
        plans.append(plan(facts).split("== Initial Plan ==")[-1])
        write(self, facts, phase)

    monkeypatch.setattr(FactTables, "write", noted)
    slots, rules = {1: 0, 2: 1}, staged.rules.rules
    _, new = run_phase(staged, list(rules), slots, 1, False, True, False)
    staged.advance(1, new)
    assert run_phase(staged, [rules[1]], slots, 2, False, True, False)[0] == {2: (2, 2, 2)}
    # Both sides of the body's join and the candidates are dealt; the known facts are read in their buckets and not sorted.
    assert plans[-1].count("Exchange hashpartitioning") == 3 and "Bucketed: true" in plans[-1]
    assert re.search(r"ShuffledHashJoin .*LeftOuter, BuildLeft", plans[-1])


def test_many_candidates_are_sorted_since_that_can_spill(spark, staged, monkeypatch):
    monkeypatch.setattr(fixpoint, "HASHED_A_TASK", 0)
    write, plans = FactTables.write, []
    monkeypatch.setattr(FactTables, "write", lambda self, facts, phase: (plans.append(plan(facts)), write(self, facts, phase)))
    slots, rules = {1: 0, 2: 1}, staged.rules.rules
    staged.advance(1, run_phase(staged, list(rules), slots, 1, False, True, False)[1])
    assert run_phase(staged, [rules[1]], slots, 2, False, True, False)[0] == {2: (2, 2, 2)}
    assert "ShuffledHashJoin" not in plans[-1]


def test_adding_facts_compares_no_closure_again(spark, conf):
    conf(autoBroadcastJoinThreshold=-1)
    rules = rules_of(spark, "e(?x,?y) -> t(?x,?y)", "t(?x,?y)^e(?y,?z) -> t(?x,?z)")
    first = hf.infer(kb_of(spark, "a e b\nb e c\na other z"), rules, distinct_input=True)
    added = kb_of(spark, "c e d\na e b\na t c\na other z\nb other z")
    result = hf.extend(first, added.unionByName(added), rules)
    assert as_set(result.kb) == brute_closure(rules.rules, triples("a e b\nb e c\nc e d\na other z\nb other z"))[0]
    # Only facts that no rule names are compared when the result is read: not those of the run's tables.
    joined = plan(result.kb).split("LeftAnti")[1]
    assert "/facts" not in joined


def test_wide_shuffles_are_merged_to_the_size_of_a_task(spark, conf):
    names = ("adaptive__coalescePartitions__initialPartitionNum", "adaptive__advisoryPartitionSizeInBytes")
    conf(shuffle__partitions=4, **{names[0]: 7, names[1]: "5m"})
    hf.tune(spark)  # what the session states is left
    settings = ["spark.sql." + name.replace("__", ".") for name in names]
    assert [spark.conf.get(name) for name in settings] == ["7", "5m"]
    for name in settings:
        spark.conf.unset(name)
    text = plan(entry.queries()["co_supply"](spark, SF_DIR))
    assert set(re.findall(r"hashpartitioning\([^)]*, (\d+)\)", text)) == {"1000"}
    assert [spark.conf.get(name) for name in settings] == ["1000", "16m"]


def test_a_phase_is_one_write_and_no_other_job(spark, staged, monkeypatch):
    jobs, write = [], FactTables.write
    monkeypatch.setattr(FactTables, "write", lambda self, facts, phase: (jobs.append(phase), write(self, facts, phase)))
    for name in ("collect", "count", "isEmpty", "first", "toPandas"):
        monkeypatch.setattr(type(staged.kb), name, lambda *_: pytest.fail("a phase runs no other job"))
    counts, new = run_phase(staged, list(staged.rules.rules), {1: 0, 2: 1}, 1, False, True, False)
    assert jobs == [1] and counts == {1: (3, 3, 3)} and list(new.values()) == [3]


def test_nothing_derived_is_counted_too(spark, staged):
    assert run_phase(staged, list(staged.rules.rules), {1: 0, 2: 1}, 1, False, True, False)[0] == {1: (3, 3, 3)}
    empty = kb_of(spark, "a e b").filter("s = 'none'")
    result = hf.infer(empty, staged.rules)
    assert result.converged and result.inferred.count() == 0


BODY = ["placedBy(?o,?c)", "inNation(?c,?n)", "suppliedBy(?o,?s)", "inNation(?s,?n)"]


@pytest.mark.parametrize("counted", [False, True])
def test_no_spelling_of_a_ring_joins_on_its_hot_variable_alone(spark, counted):
    spellings = list(permutations(BODY))
    rules = rules_of(spark, *(" ^ ".join(body) + " -> domestic(?o,?n)" for body in spellings))
    fanouts = {"<placedBy>": (1.0, 10.0, 15000.0), "<inNation>": (1.0, 66.0, 1600.0), "<suppliedBy>": (4.0, 600.0, 60000.0)}
    for rule in rules.rules:
        order = join_order(rule.body, None, [fanouts[a.pred_key] for a in rule.body] if counted else None, None)
        bound = set(rule.body[order[0]].variables)
        for i in order[1:]:
            assert bound & set(rule.body[i].variables) != {"n"}, (rule.body, order)
            bound |= set(rule.body[i].variables)


def test_bodies_are_reduced_before_they_are_joined(spark, conf):
    conf(autoBroadcastJoinThreshold=-1)
    rng = random.Random(9)
    facts = {(iri(f"a{rng.randrange(40)}"), iri(p), iri(f"a{rng.randrange(40)}")) for p in "pqrs" for _ in range(40)}
    rule = "p(?x,?y) ^ q(?y,?z) ^ r(?z,?w) ^ s(?z,?v) -> t(?x,?w)"
    rules = rules_of(spark, rule)
    kb = kb_of(spark, facts)
    plain, reduced = (hf.match_body(kb, rules.rules[0], reduce=reduce) for reduce in (False, True))
    assert sorted(map(str, plain.select(*sorted(plain.columns)).collect())) == sorted(map(str, reduced.select(*sorted(plain.columns)).collect()))
    assert "LeftSemi" in plan(reduced) and "LeftSemi" not in plan(plain)
    assert ears([{"x", "y"}, {"y", "z"}, {"z", "x"}], 0) == [] == ears([{"x"}], 0)
    assert ears([{"x", "y"}, {"y", "z"}, {"z", "x"}, {"z", "u"}], 0) == [(3, 1)]
    assert [ear for ear, _ in ears([{"x", "y"}, {"y", "z"}, {"z", "w"}], 1)] == [0, 2]
    assert as_set(hf.apply_rules(kb, rules, reduce=True)) == as_set(hf.apply_rules(kb, rules))


def test_a_text_source_is_parsed_once_for_many_keys(spark, tmp_path):
    rules = rules_of(spark, "p(?x,?y) ^ q(?y,?z) ^ r(?z,?w) -> t(?x,?w)")
    facts = triples("a p b\nb q c\nc r d\na p c\nb other d")
    hf.write_triple_lines(kb_of(spark, facts), str(tmp_path / "lines"))
    kb = hf.load_triples(spark, str(tmp_path / "lines"), distinct=False)
    assert plan(hf.apply_rules(kb, rules)).count("FileScan text") == 3
    frame = hf.apply_rules(kb, rules, stage=True, work_dir=str(tmp_path))
    assert "FileScan text" not in plan(frame) and plan(frame).count("FileScan parquet") == 3
    assert as_set(frame) == triples("a t d")


def test_numbers_of_a_stored_table_reach_the_scan(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 4).selectExpr("concat('<x', id, '>') AS s", "'<size>' AS p", "concat('\"', id * 7 % 20000, '\"') AS o")
    path = str(tmp_path / "stored")
    spark._jsc.hadoopConfiguration().set("parquet.block.size", "16384")
    try:
        hf.save_triples(rows.unionByName(kb_of(spark, "y size big")), path)
    finally:
        spark._jsc.hadoopConfiguration().unset("parquet.block.size")
    stored = hf.load_triples(spark, path, fmt="parquet", distinct=False)
    rules = rules_of(spark, "size(?x,?v) ^ lessthanorequal(?v,20) -> Small(?x)", "size(?x,?v) ^ equal(19990,?v) -> Large(?x)", "size(?x,?v) ^ equal(?v,k) -> Odd(?x)")
    frame = hf.apply_rules(stored, rules)
    assert {r["o"]: r["n"] for r in frame.groupBy("o").agg(F.count("*").alias("n")).collect()} == {"<Small>": 21, "<Large>": 1}
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(number,20\)", plan(hf.apply_rules(stored, rules)))
    groups = matching = 0
    for file in Path(path).rglob("*.parquet"):
        meta = parquet.ParquetFile(file).metadata
        column = meta.schema.names.index("number")
        for i in range(meta.num_row_groups):
            groups += 1
            stats = meta.row_group(i).column(column).statistics
            matching += bool(stats and stats.has_min_max and stats.min <= 20)
    assert matching < groups


def test_a_table_stored_by_key_is_used_in_place(spark, tmp_path):
    facts = triples("a e b\nb e c\nc e d\na type C\na other z")
    rules = rules_of(spark, "e(?x,?y) -> t(?x,?y)", "t(?x,?y)^e(?y,?z) -> t(?x,?z)", "C(?x)^t(?x,?y) -> C(?y)")
    path = str(tmp_path / "kb")
    hf.save_triples(kb_of(spark, facts), path)
    stored = hf.load_triples(spark, path, fmt="parquet", distinct=False)
    result = hf.infer(stored, rules, stage=False, distinct_input=True)
    closure, stats = brute_closure(rules.rules, facts)
    assert as_set(result.kb) == closure
    assert {(r["phase"], r["rule_id"]): r["matched"] for r in result.stats.collect() if r["matched"]} == stats
    assert not (tmp_path / "runs" / "base").exists()


def test_duplicates_in_an_unstaged_table_do_not_inflate_counts(spark):
    kb = kb_of(spark, "a p b")
    result = hf.infer(kb.unionByName(kb), rules_of(spark, "p(?x,?y) -> q(?x,?y)"))
    assert [r["matched"] for r in result.stats.collect()] == [1]
    assert as_set(result.kb) == triples("a p b\na q b")


def test_later_phases_read_written_tables_only(spark):
    rules = rules_of(spark, "e(?x,?y) -> t(?x,?y)", "t(?x,?y)^e(?y,?z) -> t(?x,?z)")
    result = hf.infer(kb_of(spark, "a e b\nb e c\nc e d\nd e f"), rules)
    text = plan(result.inferred)
    assert "Join" not in text and "Exchange" not in text
    assert text.count("FileScan") == 1


def hub_edges(nodes=600):
    """A third of the edges come into one node, a third leave another, the rest join the two."""
    into = [f"in{i} e hub" for i in range(nodes)]
    out = [f"hub2 e out{i}" for i in range(nodes)]
    return "\n".join([*into, *out, "hub e c0", "c0 e hub2", "hub e x", "hub e y"])


@pytest.mark.parametrize("explain", [False, True])
def test_hot_nodes_are_split_without_adaptive_help(spark, conf, explain):
    conf(autoBroadcastJoinThreshold=-1, adaptive__skewJoin__enabled="false")
    rules = rules_of(spark, "e(?x,?y) -> t(?x,?y)", "t(?x,?y)^e(?y,?z) -> u(?x,?z)", "u(?x,?y)^e(?y,?z) -> u(?x,?z)")
    kb = kb_of(spark, hub_edges(120))
    plain = hf.infer(kb, rules, explain=explain)
    salted = hf.infer(kb, rules, explain=explain, salt=True)
    assert as_set(salted.kb) == as_set(plain.kb)
    assert sorted(salted.stats.collect()) == sorted(plain.stats.collect())
    again = hf.infer(kb, rules, salt=True, max_phases=2)
    assert as_set(hf.infer(kb, rules, salt=True, resume=again.folder).kb) == as_set(plain.kb)


def test_rows_of_a_hot_value_go_to_many_tasks(spark, conf):
    conf(autoBroadcastJoinThreshold=-1, adaptive__enabled="false", shuffle__partitions=8)
    rule = rules_of(spark, "t(?x,?y)^e(?y,?z) -> u(?x,?z)").rules[0]
    left = spark.range(3000).selectExpr("concat('a', id) s", "if(id % 3 = 0, 'hub', concat('b', id)) o")
    right = spark.range(3000).selectExpr("if(id % 1000 = 0, 'hub', concat('b', id)) s", "concat('c', id) o")
    hot = [({}, {"hub": 32}), ({}, {})]

    def largest(pieces):
        matches = join_atoms([left, right], rule, pieces=pieces)
        tasks = matches.groupBy(F.spark_partition_id().alias("task")).count().collect()
        rows = [r["count"] for r in tasks]
        return Counter(map(tuple, matches.collect())), max(rows) / median(rows)

    plain, together = largest(None)
    split, apart = largest(hot)
    assert plain == split and together > 6 and apart <= 3
    both = [({}, {"hub": 3}), ({"hub": 8, "b1": 2}, {})]
    assert largest(both)[0] == plain
    # Only values with more facts than a task's fair share are cut.
    assert join_atoms([left, right], rule, pieces=[({}, {}), ({}, {})]).columns == ["y", "x", "z"]
