"""

Facts are made from the given tables as ``<kind/id>`` triples (``facts``), always from whole
tables. Each query is a rule set over them; each SQL text says the same with joins over a ``kb``
common table expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import hornfold as hf
from hornfold.functions.terms import is_type, pred_key
from hornfold.sources.folders import run_folder

Query = Callable[[SparkSession, str], DataFrame]

# ---------------------------------------------------------------------------------------------
# Facts
# ---------------------------------------------------------------------------------------------


# Columns the facts use. Stating them spares a job per table that would infer the schema.
COLUMNS = {
    "nation": "n_nationkey int, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "lineitem": "l_orderkey bigint, l_suppkey bigint",
    "part": "p_partkey bigint, p_size int",
    "conversations": "conv_id bigint, turn bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, *ids: str) -> str:
    """SQL for an IRI such as ``<turn/12/3>``."""
    return f"concat('<{kind}/', {", '/', ".join(ids)}, '>')"


def facts(spark: SparkSession, sf_dir: str, *, as_set: bool = True) -> DataFrame:
    """All triples. Only the order-supplier edges can repeat; the others are one per primary key.

    ``as_set=False`` leaves repeated edges in, for uses that remove duplicates themselves.
    """
    hf.tune(spark)
    nation, customer, supplier, orders, lineitem, part, conversations = (table(spark, sf_dir, name) for name in COLUMNS)
    turns = conversations.distinct()
    # Each turn points to the following one: an equi-join on conversation and turn number.
    followed = turns.join(turns.selectExpr("conv_id", "turn - 1 AS turn"), ["conv_id", "turn"])
    return hf.union_triples(
        hf.edge_triples(nation, node("nation", "n_nationkey"), "<inRegion>", node("region", "n_regionkey")),
        hf.edge_triples(customer, node("customer", "c_custkey"), "<inNation>", node("nation", "c_nationkey")),
        hf.edge_triples(supplier, node("supplier", "s_suppkey"), "<inNation>", node("nation", "s_nationkey")),
        hf.member_triples(customer, node("customer", "c_custkey"), "<Customer>"),
        hf.member_triples(supplier, node("supplier", "s_suppkey"), "<Supplier>"),
        hf.edge_triples(orders, node("order", "o_orderkey"), "<placedBy>", node("customer", "o_custkey")),
        hf.edge_triples(
            lineitem.distinct() if as_set else lineitem,
            node("order", "l_orderkey"),
            "<suppliedBy>",
            node("supplier", "l_suppkey"),
        ),
        hf.edge_triples(part, node("part", "p_partkey"), "<size>", "concat('\"', p_size, '\"')"),
        hf.edge_triples(
            part.filter("p_partkey >= 2"), node("part", "p_partkey"), "<derivedFrom>", node("part", "p_partkey div 2")
        ),
        hf.edge_triples(followed, node("turn", "conv_id", "turn"), "<next>", node("turn", "conv_id", "turn + 1")),
    )


def thread_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts plus the class of opening turns."""
    opening = table(spark, sf_dir, "conversations").filter("turn = 0").distinct()
    return facts(spark, sf_dir).unionByName(hf.member_triples(opening, node("turn", "conv_id", "turn"), "<Opening>"))


# The same facts for the SQL side.
KB = """
WITH RECURSIVE kb AS (
  SELECT '<nation/' || n_nationkey || '>' AS s, '<inRegion>' AS p, '<region/' || n_regionkey || '>' AS o FROM nation
  UNION SELECT '<customer/' || c_custkey || '>', '<inNation>', '<nation/' || c_nationkey || '>' FROM customer
  UNION SELECT '<supplier/' || s_suppkey || '>', '<inNation>', '<nation/' || s_nationkey || '>' FROM supplier
  UNION SELECT '<customer/' || c_custkey || '>', '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<Customer>' FROM customer
  UNION SELECT '<supplier/' || s_suppkey || '>', '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<Supplier>' FROM supplier
  UNION SELECT '<order/' || o_orderkey || '>', '<placedBy>', '<customer/' || o_custkey || '>' FROM orders
  UNION SELECT '<order/' || l_orderkey || '>', '<suppliedBy>', '<supplier/' || l_suppkey || '>' FROM lineitem
  UNION SELECT '<part/' || p_partkey || '>', '<size>', '"' || p_size || '"' FROM part
  UNION SELECT '<part/' || p_partkey || '>', '<derivedFrom>', '<part/' || CAST(floor(p_partkey / 2) AS BIGINT) || '>'
        FROM part WHERE p_partkey >= 2
  UNION SELECT '<turn/' || a.conv_id || '/' || a.turn || '>', '<next>', '<turn/' || b.conv_id || '/' || b.turn || '>'
        FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
)"""
TYPE = "'<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>'"
SIZE = "TRY_CAST(replace({}, '\"', '') AS BIGINT)"
SIZE_A, SIZE_B = SIZE.format("a.o"), SIZE.format("b.o")

# ---------------------------------------------------------------------------------------------
# One-step rules: name -> (rules, SQL over kb)
# ---------------------------------------------------------------------------------------------

STEPS: dict[str, tuple[list[str], str]] = {
    "inverse": (
        ["placedBy(?o,?c) -> placed(?c,?o)"],
        "SELECT DISTINCT o AS s, '<placed>' AS p, s AS o FROM kb WHERE p = '<placedBy>'",
    ),
    "chain2": (
        ["inNation(?c,?n) ^ inRegion(?n,?r) -> inRegionOf(?c,?r)"],
        """SELECT DISTINCT a.s AS s, '<inRegionOf>' AS p, b.o AS o FROM kb a JOIN kb b ON a.o = b.s
           WHERE a.p = '<inNation>' AND b.p = '<inRegion>'""",
    ),
    "subject_join": (
        ["placedBy(?o,?c) ^ suppliedBy(?o,?s) -> boughtFrom(?c,?s)"],
        """SELECT DISTINCT a.o AS s, '<boughtFrom>' AS p, b.o AS o FROM kb a JOIN kb b ON a.s = b.s
           WHERE a.p = '<placedBy>' AND b.p = '<suppliedBy>'""",
    ),
    "subject_object_join": (
        ["inNation(?c,?n) ^ placedBy(?o,?c) -> orderNation(?o,?n)"],
        """SELECT DISTINCT b.s AS s, '<orderNation>' AS p, a.o AS o FROM kb a JOIN kb b ON a.s = b.o
           WHERE a.p = '<inNation>' AND b.p = '<placedBy>'""",
    ),
    "self_join": (
        ["derivedFrom(?a,?p) ^ derivedFrom(?b,?p) -> sibling(?a,?b)"],
        """SELECT DISTINCT a.s AS s, '<sibling>' AS p, b.s AS o FROM kb a JOIN kb b ON a.o = b.o
           WHERE a.p = '<derivedFrom>' AND b.p = '<derivedFrom>'""",
    ),
    "class_join": (
        ["Customer(?c) ^ inNation(?c,?n) -> customerNation(?n,?c)"],
        f"""SELECT DISTINCT b.o AS s, '<customerNation>' AS p, a.s AS o FROM kb a JOIN kb b ON a.s = b.s
            WHERE a.p = {TYPE} AND a.o = '<Customer>' AND b.p = '<inNation>'""",
    ),
    "multi_join": (
        ["placedBy(?o,?c) ^ inNation(?c,?n) ^ inRegion(?n,?r) -> orderRegion(?o,?r)"],
        """SELECT DISTINCT a.s AS s, '<orderRegion>' AS p, c.o AS o
           FROM kb a JOIN kb b ON a.o = b.s JOIN kb c ON b.o = c.s
           WHERE a.p = '<placedBy>' AND b.p = '<inNation>' AND c.p = '<inRegion>'""",
    ),
    "cyclic": (
        ["placedBy(?o,?c) ^ inNation(?c,?n) ^ suppliedBy(?o,?s) ^ inNation(?s,?n) -> domesticIn(?o,?n)"],
        """SELECT DISTINCT a.s AS s, '<domesticIn>' AS p, b.o AS o
           FROM kb a JOIN kb b ON a.o = b.s JOIN kb c ON a.s = c.s JOIN kb d ON c.o = d.s AND b.o = d.o
           WHERE a.p = '<placedBy>' AND b.p = '<inNation>' AND c.p = '<suppliedBy>' AND d.p = '<inNation>'""",
    ),
    "co_supply": (
        ["suppliedBy(?o,?a) ^ suppliedBy(?o,?b) -> soldWith(?a,?b)"],
        """SELECT DISTINCT a.o AS s, '<soldWith>' AS p, b.o AS o FROM kb a JOIN kb b ON a.s = b.s
           WHERE a.p = '<suppliedBy>' AND b.p = '<suppliedBy>'""",
    ),
    "builtin_le": (
        ["size(?p,?v) ^ lessthanorequal(?v,20) -> SmallPart(?p)"],
        f"SELECT DISTINCT a.s AS s, {TYPE} AS p, '<SmallPart>' AS o FROM kb a WHERE a.p = '<size>' AND {SIZE_A} <= 20",
    ),
    "builtin_le_mirrored": (
        ["size(?p,?v) ^ lessthanorequal(20,?v) -> LargePart(?p)"],
        f"SELECT DISTINCT a.s AS s, {TYPE} AS p, '<LargePart>' AS o FROM kb a WHERE a.p = '<size>' AND 20 <= {SIZE_A}",
    ),
    "builtin_le_vars": (
        ["derivedFrom(?a,?b) ^ size(?a,?v) ^ size(?b,?w) ^ lessthanorequal(?v,?w) -> notLarger(?a,?b)"],
        f"""SELECT DISTINCT d.s AS s, '<notLarger>' AS p, d.o AS o
            FROM kb d JOIN kb a ON d.s = a.s JOIN kb b ON d.o = b.s
            WHERE d.p = '<derivedFrom>' AND a.p = '<size>' AND b.p = '<size>' AND {SIZE_A} <= {SIZE_B}""",
    ),
    "builtin_ge": (
        ["size(?p,?v) ^ greaterthanorequal(?v,20) -> LargePart(?p)"],
        f"SELECT DISTINCT a.s AS s, {TYPE} AS p, '<LargePart>' AS o FROM kb a WHERE a.p = '<size>' AND {SIZE_A} >= 20",
    ),
    "builtin_eq": (
        ["size(?p,?v) ^ equal(?v,20) -> Size20(?p)"],
        f"SELECT DISTINCT a.s AS s, {TYPE} AS p, '<Size20>' AS o FROM kb a WHERE a.p = '<size>' AND {SIZE_A} = 20",
    ),
    "builtin_eq_mirrored": (
        ["size(?p,?v) ^ equal(20,?v) -> Size20(?p)"],
        f"SELECT DISTINCT a.s AS s, {TYPE} AS p, '<Size20>' AS o FROM kb a WHERE a.p = '<size>' AND 20 = {SIZE_A}",
    ),
    "builtin_eq_vars": (
        ["derivedFrom(?a,?b) ^ size(?a,?v) ^ size(?b,?w) ^ equal(?v,?w) -> sameSize(?a,?b)"],
        f"""SELECT DISTINCT d.s AS s, '<sameSize>' AS p, d.o AS o
            FROM kb d JOIN kb a ON d.s = a.s JOIN kb b ON d.o = b.s
            WHERE d.p = '<derivedFrom>' AND a.p = '<size>' AND b.p = '<size>' AND {SIZE_A} = {SIZE_B}""",
    ),
    "builtin_conjunction": (
        ["lessthanorequal(10,?v) ^ size(?p,?v) ^ lessthanorequal(?v,20) ^ equal(3,3) -> midSize(?p,?v)"],
        f"""SELECT DISTINCT a.s AS s, '<midSize>' AS p, a.o AS o FROM kb a
            WHERE a.p = '<size>' AND 10 <= {SIZE_A} AND {SIZE_A} <= 20""",
    ),
    "const_object": (
        ["inNation(?x,<nation/7>) -> citizen(<nation/7>,?x)"],
        """SELECT DISTINCT '<nation/7>' AS s, '<citizen>' AS p, s AS o FROM kb
           WHERE p = '<inNation>' AND o = '<nation/7>'""",
    ),
    "const_head_object": (
        ["inNation(?x,<nation/7>) -> citizenOf(?x,<nation/7>)"],
        """SELECT DISTINCT s, '<citizenOf>' AS p, '<nation/7>' AS o FROM kb
           WHERE p = '<inNation>' AND o = '<nation/7>'""",
    ),
    "const_subject": (
        ["inNation(<customer/7>,?n) ^ inNation(?x,?n) -> neighbour(<customer/7>,?x)"],
        """SELECT DISTINCT '<customer/7>' AS s, '<neighbour>' AS p, b.s AS o FROM kb a JOIN kb b ON a.o = b.o
           WHERE a.p = '<inNation>' AND a.s = '<customer/7>' AND b.p = '<inNation>'""",
    ),
    "ground_guard": (
        ["Customer(<customer/1>) ^ inNation(?x,?n) -> active(?x,?n)"],
        f"""SELECT DISTINCT s, '<active>' AS p, o FROM kb WHERE p = '<inNation>' AND EXISTS (
              SELECT 1 FROM kb WHERE s = '<customer/1>' AND p = {TYPE} AND o = '<Customer>')""",
    ),
    "ground_head": (
        ['inNation(?x,<nation/7>) -> populated(<nation/7>,"yes")'],
        """SELECT DISTINCT '<nation/7>' AS s, '<populated>' AS p, '"yes"' AS o FROM kb
           WHERE p = '<inNation>' AND o = '<nation/7>'""",
    ),
    "existential": (
        ["suppliedBy(?o,?s) ^ inNation(?s,?n) -> ActiveNation(?n)"],
        f"""SELECT DISTINCT b.o AS s, {TYPE} AS p, '<ActiveNation>' AS o FROM kb a JOIN kb b ON a.o = b.s
            WHERE a.p = '<suppliedBy>' AND b.p = '<inNation>'""",
    ),
}

# ---------------------------------------------------------------------------------------------
# Rule sets evaluated to a fixpoint: name -> (rules, SQL of the inferred triples)
# ---------------------------------------------------------------------------------------------

CLOSURE_DERIVED = [
    "derivedFrom(?a,?b) -> ancestor(?a,?b)",
    "ancestor(?a,?b) ^ derivedFrom(?b,?c) -> ancestor(?a,?c)",
]
THREAD = [
    "Opening(?a) ^ next(?a,?b) -> startedBy(?b,?a)",
    "startedBy(?b,?a) ^ next(?b,?c) -> startedBy(?c,?a)",
]
CHAINED = [
    "placedBy(?o,?c) ^ inNation(?c,?n) -> orderNation(?o,?n)",
    "suppliedBy(?o,?s) ^ inNation(?s,?n) -> supplyNation(?o,?n)",
    "orderNation(?o,?n) ^ supplyNation(?o,?n) -> Domestic(?o)",
    "Domestic(?o) ^ placedBy(?o,?c) -> LocalBuyer(?c)",
    "LocalBuyer(?c) ^ inNation(?c,?n) -> hasLocalBuyer(?n,?c)",
]
RULE_BOOK = [
    "placedBy(?o,?c) -> placed(?c,?o)",
    "suppliedBy(?o,?s) -> supplies(?s,?o)",
    "inNation(?x,?n) -> hasResident(?n,?x)",
    "inRegion(?n,?r) -> contains(?r,?n)",
    "derivedFrom(?a,?b) -> derives(?b,?a)",
    "next(?a,?b) -> previous(?b,?a)",
    "Customer(?c) ^ placed(?c,?o) -> Buyer(?c)",
    "Supplier(?s) ^ supplies(?s,?o) -> ActiveSupplier(?s)",
    "contains(?r,?n) ^ hasResident(?n,?x) -> hasResident(?r,?x)",
    "derives(?b,?a) ^ derives(?a,?c) -> grandDerives(?b,?c)",
    "previous(?b,?a) ^ previous(?a,?z) -> twoBack(?b,?z)",
]
THREAD_SQL = f"""{KB}, started AS (
  SELECT s AS opening, o AS turn, s AS previous, 1 AS phase FROM kb WHERE p = '<next>' AND s LIKE '<turn/%/0>'
  UNION SELECT t.opening, n.o, n.s, t.phase + 1 FROM started t JOIN kb n ON n.p = '<next>' AND n.s = t.turn
)"""
CHAINED_SQL = f"""{KB},
orderNation AS (SELECT DISTINCT a.s, b.o FROM kb a JOIN kb b ON a.o = b.s WHERE a.p = '<placedBy>' AND b.p = '<inNation>'),
supplyNation AS (SELECT DISTINCT a.s, b.o FROM kb a JOIN kb b ON a.o = b.s WHERE a.p = '<suppliedBy>' AND b.p = '<inNation>'),
domestic AS (SELECT DISTINCT a.s FROM orderNation a JOIN supplyNation b ON a.s = b.s AND a.o = b.o),
buyer AS (SELECT DISTINCT k.o AS s FROM domestic d JOIN kb k ON k.s = d.s AND k.p = '<placedBy>')"""

CLOSURES: dict[str, tuple[list[str], str]] = {
    "closure_derived": (
        CLOSURE_DERIVED,
        f"""{KB}, ancestor AS (
              SELECT s, o FROM kb WHERE p = '<derivedFrom>'
              UNION SELECT a.s, d.o FROM ancestor a JOIN kb d ON d.p = '<derivedFrom>' AND a.o = d.s)
            SELECT s, '<ancestor>' AS p, o FROM ancestor""",
    ),
    "thread_start": (THREAD, f"{THREAD_SQL} SELECT DISTINCT turn AS s, '<startedBy>' AS p, opening AS o FROM started"),
    "mutual": (
        ["derivedFrom(?a,?b) -> derives(?b,?a)", "derives(?b,?a) -> derivedFrom(?a,?b)"],
        f"{KB} SELECT DISTINCT o AS s, '<derives>' AS p, s AS o FROM kb WHERE p = '<derivedFrom>'",
    ),
    "symmetric": (
        ["derivedFrom(?a,?b) -> linked(?a,?b)", "linked(?a,?b) -> linked(?b,?a)"],
        f"""{KB} SELECT s, '<linked>' AS p, o FROM kb WHERE p = '<derivedFrom>'
            UNION SELECT o AS s, '<linked>' AS p, s AS o FROM kb WHERE p = '<derivedFrom>'""",
    ),
    "rule_book": (
        RULE_BOOK,
        f"""{KB} SELECT o AS s, '<placed>' AS p, s AS o FROM kb WHERE p = '<placedBy>'
            UNION SELECT o, '<supplies>', s FROM kb WHERE p = '<suppliedBy>'
            UNION SELECT o, '<hasResident>', s FROM kb WHERE p = '<inNation>'
            UNION SELECT o, '<contains>', s FROM kb WHERE p = '<inRegion>'
            UNION SELECT o, '<derives>', s FROM kb WHERE p = '<derivedFrom>'
            UNION SELECT o, '<previous>', s FROM kb WHERE p = '<next>'
            UNION SELECT o, {TYPE}, '<Buyer>' FROM kb WHERE p = '<placedBy>'
              AND o IN (SELECT s FROM kb WHERE p = {TYPE} AND o = '<Customer>')
            UNION SELECT o, {TYPE}, '<ActiveSupplier>' FROM kb WHERE p = '<suppliedBy>'
              AND o IN (SELECT s FROM kb WHERE p = {TYPE} AND o = '<Supplier>')
            UNION SELECT b.o, '<hasResident>', a.s FROM kb a JOIN kb b ON a.o = b.s
              WHERE a.p = '<inNation>' AND b.p = '<inRegion>'
            UNION SELECT b.o, '<grandDerives>', a.s FROM kb a JOIN kb b ON a.o = b.s
              WHERE a.p = '<derivedFrom>' AND b.p = '<derivedFrom>'
            UNION SELECT b.o, '<twoBack>', a.s FROM kb a JOIN kb b ON a.o = b.s
              WHERE a.p = '<next>' AND b.p = '<next>'""",
    ),
    "self_loop": (
        ["derivedFrom(?a,?p) ^ derivedFrom(?b,?p) -> sibling(?a,?b)", "sibling(?x,?x) -> Child(?x)"],
        f"""{KB} SELECT a.s AS s, '<sibling>' AS p, b.s AS o FROM kb a JOIN kb b ON a.o = b.o
              WHERE a.p = '<derivedFrom>' AND b.p = '<derivedFrom>'
            UNION SELECT s, {TYPE} AS p, '<Child>' AS o FROM kb WHERE p = '<derivedFrom>'""",
    ),
    "chained": (
        CHAINED,
        f"""{CHAINED_SQL}
            SELECT s, '<orderNation>' AS p, o FROM orderNation
            UNION SELECT s, '<supplyNation>', o FROM supplyNation
            UNION SELECT s, {TYPE}, '<Domestic>' FROM domestic
            UNION SELECT s, {TYPE}, '<LocalBuyer>' FROM buyer
            UNION SELECT k.o, '<hasLocalBuyer>', k.s FROM buyer b JOIN kb k ON k.s = b.s AND k.p = '<inNation>'""",
    ),
}


DOMESTIC_REGION = "domesticIn(?o,?n) ^ inRegion(?n,?r) -> domesticRegion(?o,?r)"
CYCLIC_SQL = f"""{KB}, domestic AS (
              SELECT DISTINCT a.s, b.o
              FROM kb a JOIN kb b ON a.o = b.s JOIN kb c ON a.s = c.s JOIN kb d ON c.o = d.s AND b.o = d.o
              WHERE a.p = '<placedBy>' AND b.p = '<inNation>' AND c.p = '<suppliedBy>' AND d.p = '<inNation>')
            SELECT s, '<domesticIn>' AS p, o FROM domestic
            UNION SELECT d.s, '<domesticRegion>', r.o FROM domestic d JOIN kb r ON d.o = r.s AND r.p = '<inRegion>'"""
# The same body in two orders: the engine's own order must not depend on the spelling.
CLOSURES["cyclic_closure"] = (
    ["placedBy(?o,?c) ^ inNation(?c,?n) ^ suppliedBy(?o,?s) ^ inNation(?s,?n) -> domesticIn(?o,?n)", DOMESTIC_REGION],
    CYCLIC_SQL,
)
CLOSURES["cyclic_reordered"] = (
    ["placedBy(?o,?c) ^ inNation(?c,?n) ^ inNation(?s,?n) ^ suppliedBy(?o,?s) -> domesticIn(?o,?n)", DOMESTIC_REGION],
    CYCLIC_SQL,
)


# The spelling that starts with two customers or suppliers of one nation.
WORST = ["inNation(?s,?n) ^ inNation(?c,?n) ^ placedBy(?o,?c) ^ suppliedBy(?o,?s) -> domesticIn(?o,?n)"]
STEPS["cyclic_worst"] = (WORST, STEPS["cyclic"][1])


def step(rules: list[str]) -> Query:
    return lambda spark, sf_dir: hf.apply_rules(facts(spark, sf_dir, as_set=False), hf.rules_from_lines(spark, rules))


def program_facts(rules: list[str], spark: SparkSession, sf_dir: str) -> DataFrame:
    return (thread_facts if rules is THREAD else facts)(spark, sf_dir)


def run(rules: list[str], spark: SparkSession, sf_dir: str, **options: object) -> hf.Inference:
    kb = program_facts(rules, spark, sf_dir)
    return hf.infer(kb, hf.rules_from_lines(spark, rules), distinct_input=True, **options)


def closure(rules: list[str]) -> Query:
    return lambda spark, sf_dir: run(rules, spark, sf_dir).inferred


# ---------------------------------------------------------------------------------------------
# Statistics, explanations, rule metadata, sources and sinks
# ---------------------------------------------------------------------------------------------


def closed_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(CLOSURE_DERIVED, spark, sf_dir).kb


def closure_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``closure_derived`` by path doubling."""
    return run(CLOSURE_DERIVED, spark, sf_dir, doubling=True).inferred


def thread_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``thread_start`` as one recursive common table expression."""
    return hf.linear_closure(program_facts(THREAD, spark, sf_dir), hf.rules_from_lines(spark, THREAD))


def hot_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors where a third of all edges come into one node, whose rows are split over tasks."""
    parts = table(spark, sf_dir, "part").filter("p_partkey >= 2")
    origin = node("part", "if(p_partkey % 3 = 0, 2, p_partkey div 2)")
    edges = hf.edge_triples(parts, node("part", "p_partkey"), "<derivedFrom>", origin)
    hf.tune(spark)
    return hf.infer(edges, hf.rules_from_lines(spark, CLOSURE_DERIVED), distinct_input=True, salt=True).inferred


def append_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ancestors of half of the parts, and then of all: the other half is added to the closed facts."""
    rules, parts = hf.rules_from_lines(spark, CLOSURE_DERIVED), table(spark, sf_dir, "part").filter("p_partkey >= 2")
    # Whole edges, odd parts first: every chain of ancestors has both.
    odd, even = (
        hf.edge_triples(parts.filter(half), node("part", "p_partkey"), "<derivedFrom>", node("part", "p_partkey div 2"))
        for half in ("p_partkey % 2 = 1", "p_partkey % 2 = 0")
    )
    hf.tune(spark)
    closed = hf.infer(odd, rules, distinct_input=True)
    return hf.extend(closed, even, rules).kb


def reduced_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of joins of which most rows find no partner, reduced by semi-joins first."""
    return hf.apply_rules(facts(spark, sf_dir, as_set=False), hf.rules_from_lines(spark, REDUCED), reduce=True)


REDUCED = ["suppliedBy(?o,?s) ^ placedBy(?o,?c) ^ inNation(?c,?n) ^ inRegion(?n,<region/1>) -> soldTo(?s,?n)"]


def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule over three predicates of a text source, which is parsed once."""
    folder = run_folder(spark)
    hf.write_triple_lines(facts(spark, sf_dir, as_set=False), f"{folder}/lines")
    rules = hf.rules_from_lines(spark, STEPS["multi_join"][0])
    return hf.apply_rules(hf.load_triples(spark, f"{folder}/lines", distinct=False), rules, stage=True, work_dir=folder)


def stored_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric comparisons over a stored table: the scan skips row groups out of range."""
    rules = hf.rules_from_lines(spark, [*STEPS["builtin_le"][0], "size(?p,?v) ^ equal(40,?v) -> Size40(?p)"])
    folder = f"{run_folder(spark)}/stored"
    hf.save_triples(facts(spark, sf_dir), folder, rules=rules)
    return hf.apply_rules(hf.load_triples(spark, folder, fmt="parquet", distinct=False), rules)


def phase_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = run(THREAD, spark, sf_dir).stats
    return stats.select("phase", "rule_id", "matched", "inferred", "new", "matched_so_far")


def phase_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    phases = run(THREAD, spark, sf_dir).phases
    return phases.select("phase", F.size("triggered").alias("triggered"), "matched", "new")


RULE_FILE = [
    "# where orders come from",
    "",
    "sales:placedBy(?o,?c) ^ sales:inNation(?c,?n) -> geo:orderNation(?o,?n)",
    "  # and one step further",
    "geo:orderNation(?o,?n) ^ <inRegion>(?n,?r) -> geo:orderRegion(?o,?r)",
]
PREFIXES = {"sales": "", "geo": "http://example.org/geo/"}


def rule_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules read from a file with comments, blank lines and prefixes."""
    path = f"{run_folder(spark)}/rules"
    spark.createDataFrame([("\n".join(RULE_FILE),)], "value string").coalesce(1).write.text(path)
    rules = hf.load_rules(spark, path, PREFIXES)
    return hf.infer(facts(spark, sf_dir), rules, distinct_input=True).inferred


def literal_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as literals, written as lines and read back."""
    path = f"{run_folder(spark)}/lines"
    texts = spark.read.schema("doc_id bigint, text string").parquet(f"{sf_dir}/documents.parquet")
    literals = hf.edge_triples(texts, node("doc", "doc_id"), "<text>", "concat('\"', text, '\"')")
    hf.write_triple_lines(literals, path)
    return hf.load_triples(spark, path)


def explain_chain2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = hf.rules_from_lines(spark, STEPS["chain2"][0])
    rendered = hf.render_explanations(hf.explain_matches(facts(spark, sf_dir), rules))
    return rendered.select("rule_id", F.array_join("premises", " ").alias("premises"), "conclusion")


def explain_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanations of a recursive rule set, written once per phase to a folder of the user's and read back."""
    result = run(THREAD, spark, sf_dir, explain_path=f"{run_folder(spark)}/explanations")
    rendered = hf.render_explanations(result.explanations)
    return rendered.select("phase", "rule_id", F.array_join("premises", " ").alias("premises"), "conclusion")


def predicate_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts per predicate key that the rules name."""
    counts = (
        facts(spark, sf_dir)
        .groupBy(pred_key(F.col("p"), F.col("o")).alias("pred_key"), is_type(F.col("p")).alias("is_type"))
        .agg(F.count("*").alias("n"))
    )
    used = hf.predicates(hf.rules_from_lines(spark, CHAINED))
    return used.join(counts, ["pred_key", "is_type"], "left").select(
        "pred_key", "is_type", F.coalesce("n", F.lit(0).cast("bigint")).alias("facts")
    )


def rule_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that fire on the base facts, with what they derive and which rules that triggers."""
    rules = hf.rules_from_lines(spark, CHAINED)
    fired = run(CHAINED, spark, sf_dir, max_phases=1).stats.filter(F.col("new") > 0)
    deps = hf.rule_deps(rules)
    triggered = hf.triggered_rules(deps, fired).select(F.col("rule_id").alias("dst"))
    return (
        deps.join(triggered, "dst", "left_semi")
        .join(fired.select(F.col("rule_id").alias("src"), "matched", "new"), "src")
        .select("src", "dst", "matched", "new")
    )


def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{run_folder(spark)}/lines"
    hf.write_triple_lines(facts(spark, sf_dir, as_set=False), folder)
    return hf.load_triples(spark, folder, on_error="fail")


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are not triples, among all facts and all document texts written as lines."""
    folder = f"{run_folder(spark)}/lines"
    hf.write_triple_lines(facts(spark, sf_dir, as_set=False), folder)
    texts = spark.read.schema("text string").parquet(f"{sf_dir}/documents.parquet")
    texts.write.mode("append").text(folder)
    _, malformed = hf.load_triples(spark, folder, on_error="quarantine", distinct=False)
    return malformed.groupBy(F.md5("value").alias("line")).agg(F.count("*").alias("times"))


def stored_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store facts by predicate key, then answer a rule from the directories it needs."""
    rules = hf.rules_from_lines(spark, STEPS["class_join"][0])
    folder = f"{run_folder(spark)}/stored"
    hf.save_triples(facts(spark, sf_dir), folder, rules=rules)
    return hf.apply_rules(hf.load_triples(spark, folder, fmt="parquet", distinct=False), rules)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: customers and suppliers to regions over two joined predicates."""
    return step(STEPS["chain2"][0])(spark, "/root/testdata/sf0.001")


def llm_queries():
    """The module with the operators for training data, or None where it can't be imported."""
    try:
        from hornfold.llm import queries as found
    except ImportError:
        # The folders may be gone, or a library that only the operators need.
        return None
    return found


def queries() -> dict[str, Query]:
    llm = llm_queries()
    return {
        **(llm.queries() if llm else {}),
        **{name: step(rules) for name, (rules, _) in STEPS.items()},
        **{name: closure(rules) for name, (rules, _) in CLOSURES.items()},
        "closed_kb": closed_kb,
        "closure_doubling": closure_doubling,
        "thread_cte": thread_cte,
        "hot_closure": hot_closure,
        "append_closure": append_closure,
        "reduced_join": reduced_join,
        "text_rules": text_rules,
        "stored_numbers": stored_numbers,
        "phase_stats": phase_stats,
        "phase_totals": phase_totals,
        "rule_file": rule_file,
        "literal_round_trip": literal_round_trip,
        "explain_chain2": explain_chain2,
        "explain_thread": explain_thread,
        "predicate_usage": predicate_usage,
        "rule_triggers": rule_triggers,
        "text_round_trip": text_round_trip,
        "quarantine": quarantine,
        "stored_partition": stored_partition,
    }


def oracle_sql() -> dict[str, str]:
    used = {
        "<placedBy>": "p = '<placedBy>'",
        "<inNation>": "p = '<inNation>'",
        "<suppliedBy>": "p = '<suppliedBy>'",
        "<orderNation>": "p = '<orderNation>'",
        "<supplyNation>": "p = '<supplyNation>'",
        "<hasLocalBuyer>": "p = '<hasLocalBuyer>'",
    }
    classes = ["<Domestic>", "<LocalBuyer>"]
    usage = " UNION ALL ".join(
        [f"SELECT '{key}' AS pred_key, false AS is_type, count(*) AS facts FROM kb WHERE {test}" for key, test in used.items()]
        + [f"SELECT '{c}', true, count(*) FROM kb WHERE p = {TYPE} AND o = '{c}'" for c in classes]
    )
    edge = "SELECT {src}::INT AS src, 3::INT AS dst, count(*) AS matched, count(DISTINCT (a.s, b.o)) AS new FROM kb a JOIN kb b ON a.o = b.s WHERE a.p = '{p}' AND b.p = '<inNation>'"
    llm = llm_queries()
    return {
        **(llm.oracle_sql() if llm else {}),
        **{name: f"{KB} {sql}" for name, (_, sql) in STEPS.items()},
        **{name: sql for name, (_, sql) in CLOSURES.items()},
        "closed_kb": f"""{KB}, ancestor AS (
              SELECT s, o FROM kb WHERE p = '<derivedFrom>'
              UNION SELECT a.s, d.o FROM ancestor a JOIN kb d ON d.p = '<derivedFrom>' AND a.o = d.s)
            SELECT s, p, o FROM kb UNION ALL SELECT s, '<ancestor>', o FROM ancestor""",
        "closure_doubling": CLOSURES["closure_derived"][1],
        "thread_cte": CLOSURES["thread_start"][1],
        "hot_closure": """WITH RECURSIVE edge AS (
              SELECT '<part/' || p_partkey || '>' AS s,
                     '<part/' || (CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE p_partkey // 2 END)::BIGINT || '>' AS o
              FROM part WHERE p_partkey >= 2), ancestor AS (
              SELECT s, o FROM edge UNION SELECT a.s, e.o FROM ancestor a JOIN edge e ON a.o = e.s)
            SELECT s, '<ancestor>' AS p, o FROM ancestor""",
        "append_closure": """WITH RECURSIVE edge AS (
              SELECT '<part/' || p_partkey || '>' AS s, '<part/' || CAST(floor(p_partkey / 2) AS BIGINT) || '>' AS o
              FROM part WHERE p_partkey >= 2), ancestor AS (
              SELECT s, o FROM edge UNION SELECT a.s, e.o FROM ancestor a JOIN edge e ON a.o = e.s)
            SELECT s, '<derivedFrom>' AS p, o FROM edge UNION ALL SELECT s, '<ancestor>', o FROM ancestor""",
        "reduced_join": f"""{KB} SELECT DISTINCT a.o AS s, '<soldTo>' AS p, c.o AS o
            FROM kb a JOIN kb b ON a.s = b.s JOIN kb c ON b.o = c.s JOIN kb d ON c.o = d.s
            WHERE a.p = '<suppliedBy>' AND b.p = '<placedBy>' AND c.p = '<inNation>' AND d.p = '<inRegion>' AND d.o = '<region/1>'""",
        "text_rules": f"{KB} {STEPS['multi_join'][1]}",
        "stored_numbers": f"""{KB} {STEPS['builtin_le'][1]}
            UNION SELECT a.s, {TYPE}, '<Size40>' FROM kb a WHERE a.p = '<size>' AND {SIZE_A} = 40""",
        "phase_stats": f"""{THREAD_SQL}, per_rule AS (
              SELECT phase::INT AS phase, (CASE WHEN phase = 1 THEN 1 ELSE 2 END)::INT AS rule_id, count(*) AS matched
              FROM started GROUP BY 1, 2 UNION ALL SELECT 1, 2, 0
              UNION ALL SELECT max(phase)::INT + 1, 2, 0 FROM started)
            SELECT phase, rule_id, matched, matched AS inferred, matched AS new,
                   sum(matched) OVER (PARTITION BY rule_id ORDER BY phase)::BIGINT AS matched_so_far FROM per_rule""",
        "phase_totals": f"""{THREAD_SQL}, counted AS (SELECT phase::INT AS phase, count(*) AS matched FROM started GROUP BY 1
              UNION ALL SELECT max(phase)::INT + 1, 0 FROM started)
            SELECT phase, (CASE WHEN phase = 1 THEN 2 ELSE 1 END)::INT AS triggered, matched, matched AS new FROM counted""",
        "rule_file": f"""{KB}, n AS (SELECT DISTINCT a.s, b.o FROM kb a JOIN kb b ON a.o = b.s
              WHERE a.p = '<placedBy>' AND b.p = '<inNation>')
            SELECT s, '<http://example.org/geo/orderNation>' AS p, o FROM n
            UNION SELECT n.s, '<http://example.org/geo/orderRegion>', r.o FROM n JOIN kb r ON n.o = r.s AND r.p = '<inRegion>'""",
        "literal_round_trip": """SELECT '<doc/' || doc_id || '>' AS s, '<text>' AS p, '"' || text || '"' AS o
            FROM documents WHERE text IS NOT NULL""",
        "explain_chain2": f"""{KB} SELECT 1::INT AS rule_id,
              '(' || a.s || ' <inNation> ' || a.o || ') (' || b.s || ' <inRegion> ' || b.o || ')' AS premises,
              '(' || a.s || ' <inRegionOf> ' || b.o || ')' AS conclusion
            FROM kb a JOIN kb b ON a.o = b.s WHERE a.p = '<inNation>' AND b.p = '<inRegion>'""",
        "explain_thread": f"""{THREAD_SQL} SELECT phase::INT AS phase, (CASE WHEN phase = 1 THEN 1 ELSE 2 END)::INT AS rule_id,
              CASE WHEN phase = 1 THEN '(' || opening || ' type <Opening>) '
                   ELSE '(' || previous || ' <startedBy> ' || opening || ') ' END
                || '(' || previous || ' <next> ' || turn || ')' AS premises,
              '(' || turn || ' <startedBy> ' || opening || ')' AS conclusion FROM started""",
        "predicate_usage": f"{KB} {usage}",
        "rule_triggers": f"{KB} {edge.format(src=1, p='<placedBy>')} UNION ALL {edge.format(src=2, p='<suppliedBy>')}",
        "text_round_trip": f"{KB} SELECT s, p, o FROM kb",
        "quarantine": r"""SELECT md5(value) AS line, count(*) AS times
            FROM (SELECT unnest(string_split_regex(text, '\r\n|\n|\r')) AS value FROM documents)
            WHERE trim(value, ' ') <> '' AND NOT regexp_matches(value,
              '^\s*(<[^>]*>|[^\s<"]\S*)\s+<[^>]*>\s+(<[^>]*>|"([^"\\]|\\.)*"|[^\s<"]\S*)') GROUP BY 1""",
        "stored_partition": f"{KB} {STEPS['class_join'][1]}",
    }
