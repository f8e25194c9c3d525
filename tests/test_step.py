"""One step of rules: filters, joins, builtins and heads."""

import pytest
from helpers import as_set, iri, kb_of, rules_of, triples

import hornfold as hf

CASES = {
    "open atom": ("p(?x,?y) -> q(?y,?x)", "a p b\nc p d\na z b", "b q a\nd q c"),
    "subject constant": ("p(a,?y) -> q(?y,x)", "a p b\nc p d", "b q x"),
    "object constant": ("p(?x,d) -> q(?x,x)", "a p b\nc p d", "c q x"),
    "both constants": ("p(a,b) ^ p(?x,?y) -> q(?x,?y)", "a p b\nc p d", "a q b\nc q d"),
    "both constants, not a fact": ("p(a,d) ^ p(?x,?y) -> q(?x,?y)", "a p b\nc p d", ""),
    "class atom alone": ("C(?x) -> q(?x,y)", "a type C\nb type D", "a q y"),
    "ground class atom": ("C(a) ^ p(?x,?y) -> q(?x,?y)", "a type C\na p b", "a q b"),
    "ground class atom, not a member": ("C(b) ^ p(?x,?y) -> q(?x,?y)", "a type C\na p b", ""),
    "only ground atoms": ("C(a) ^ p(a,b) -> q(yes,no)", "a type C\na p b", "yes q no"),
    "same variable twice": ("near(?x,?x) -> Self(?x)", "a near a\na near b", "a type Self"),
    "join s-s": ("p(?x,?y) ^ r(?x,?z) -> q(?y,?z)", "a p b\na r c\nd p e", "b q c"),
    "join s-o": ("p(?x,?y) ^ r(?z,?x) -> q(?y,?z)", "a p b\nc r a\nd p e", "b q c"),
    "join o-s": ("p(?x,?y) ^ r(?y,?z) -> q(?x,?z)", "a p b\nb r c\nd p e", "a q c"),
    "join o-o": ("p(?x,?y) ^ r(?z,?y) -> q(?x,?z)", "a p b\nc r b\nd p e", "a q c"),
    "all shared variables": (
        "opens(?shop,?day) ^ sells(?day,?shop) ^ shuts(?shop,?day) -> trades(?day,?shop)",
        "x opens mon\nx shuts mon\nmon sells x\ny opens mon\ny shuts tue\nmon sells y\nz opens tue\nz shuts tue",
        "mon trades x",
    ),
    "class membership join": ("p(?x,?y) ^ C(?x) -> q(?x,?y)", "a p b\nc p d\na type C\na type D", "a q b"),
    "self join": (
        "heads(?club,?x) ^ heads(?club,?y) ^ heads(?club,?z) -> panel(?x,?z)",
        "chess heads u\nchess heads v\ngo heads w",
        "u panel u\nu panel v\nv panel u\nv panel v\nw panel w",
    ),
    "three atoms, connected late": ("a(?x,?y)^b(?z,?w)^c(?y,?z) -> q(?x,?w)", "x a y\ny c z\nz b w", "x q w"),
    "same name as class and property": ("k(?x,?y) -> q(?x,?y)", "a k b\na type k", "a q b"),
    "equal, variable left": ("depth(?x,?v)^equal(?v,5) -> Five(?x)", "a depth 5\nb depth abc\nc depth 6", "a type Five"),
    "equal, variable right": ("depth(?x,?v)^equal(5,?v) -> Five(?x)", 'a depth "5"\nb depth 6', "a type Five"),
    "equal, two variables": ("p(?x,?v)^r(?x,?w)^equal(?v,?w) -> S(?x)", 'a p 5\na r "5"\nb p 5\nb r 6', "a type S"),
    "less or equal": ("depth(?x,?v)^lessthanorequal(?v,20) -> Y(?x)", "a depth 5\nb depth 20\nc depth 30", "a type Y\nb type Y"),
    "less or equal, mirrored": ("depth(?x,?v)^lessthanorequal(20,?v) -> O(?x)", "a depth 5\nb depth 20\nc depth 30", "b type O\nc type O"),
    "less or equal, two variables": ("p(?x,?v)^r(?x,?w)^lessthanorequal(?v,?w) -> S(?x)", "a p 5\na r 6\nb p 7\nb r 6", "a type S"),
    "greater or equal": ("depth(?x,?v)^greaterthanorequal(?v,20) -> O(?x)", "a depth 5\nb depth 20\nc depth 30", "b type O\nc type O"),
    "false constant comparison": ("depth(?x,?v)^equal(3,4) -> N(?x)", "a depth 5", ""),
    "true constant comparison": ("depth(?x,?v)^equal(3,3) -> N(?x)", "a depth 5", "a type N"),
    "several builtins": (
        "lessthanorequal(10,?v)^depth(?x,?v)^lessthanorequal(?v,20) -> M(?x)",
        "a depth 5\nb depth 15\nc depth 25",
        "b type M",
    ),
    "number beyond 32 bits": ("depth(?x,?v)^lessthanorequal(5000000000,?v) -> O(?x)", "a depth 5000000001\nb depth 7", "a type O"),
    "builtin before a head variable's atom": (
        "lessthanorequal(7,?n) ^ floor(?flat,?n) ^ door(?flat,?d) -> above(?d,?n)",
        "a floor 7\na door red\nb floor 6\nb door blue",
        "red above 7",
    ),
    "head with object constant": ("p(?x,?y) -> q(?x,k)", "a p b\na p c", "a q k"),
    "head with subject constant": ("paid(?bill,?day) -> archive(cellar,?day)", "b1 paid mon\nb2 paid tue\nb3 paid mon", "cellar archive mon\ncellar archive tue"),
    "class head": ("p(?x,?y) -> C(?x)", "a p b\na p c", "a type C"),
    "ground head": ('p(?x,?y) -> q(k,"yes")', "a p b\nc p d", 'k q "yes"'),
    "ground class head": ("p(?x,?y) -> C(k)", "a p b", "k type C"),
    "ground head without a match": ("p(?x,b) -> q(k,l)", "a p c", ""),
    "literal constant": ('p(?x,"two") -> q(?x,k)', 'a p "two"\nb p two', "a q k"),
    "unknown builtin name is a predicate": ("p(?x,?v)^lessthan(?v,20) -> q(?x,?v)", "a p 5", ""),
    "variables with odd names": ("p(?x.1,?y-2) -> q(?y-2,?x.1)", "a p b", "b q a"),
    "odd names joined": ("p(?x.1,?`y) ^ r(?`y,?x.2) -> q(?x.1,?x.2)", "a p b\nb r c", "a q c"),
    "names that differ in case": ("p(?x,?X) ^ r(?X,?premises) -> q(?x,?premises)", "a p b\nb r c", "a q c"),
    "two rules, one head": ("p(?x,?y) -> q(?x,?y)|r(?x,?y) -> q(?x,?y)", "a p b\na r b\nc r d", "a q b\nc q d"),
}


@pytest.mark.parametrize("name", CASES)
def test_one_step(spark, name):
    rule_text, facts, expected = CASES[name]
    kb = kb_of(spark, facts)
    rules = rules_of(spark, *rule_text.split("|"))
    assert as_set(hf.apply_rules(kb, rules)) == triples(expected)


def test_bindings_have_one_column_per_variable(spark):
    rule = rules_of(spark, "p(?x,?y) ^ r(?y,?z) -> q(?x,?z)").rules[0]
    matches = hf.match_body(kb_of(spark, "a p b\nb r c"), rule)
    assert set(matches.columns) == {"x", "y", "z"}
    assert matches.select("x", "y", "z").collect() == [(iri("a"), iri("b"), iri("c"))]


def test_every_match_is_counted_unless_only_conclusions_matter(spark):
    rule = rules_of(spark, "p(?x,?k) ^ r(?y,?k) -> C(?k)").rules[0]
    kb = kb_of(spark, "a p k\nb p k\nc r k\nd r k")
    assert hf.match_body(kb, rule).count() == 4
    assert hf.match_body(kb, rule, count_matches=False).count() == 1


def test_instantiate_gives_one_triple_per_match(spark):
    rule = rules_of(spark, "p(?x,?y) -> q(?x,k)").rules[0]
    kb = kb_of(spark, "a p b\na p c")
    rows = hf.instantiate(hf.match_body(kb, rule), rule.head).collect()
    assert [tuple(row) for row in rows] == [("<a>", "<q>", "<k>")] * 2


def test_explanations_keep_premises_in_written_order(spark):
    rules = rules_of(spark, "a(?x,?y)^b(?z,?w)^c(?y,?z)^C(k) -> q(?x,?w)")
    kb = kb_of(spark, triples("x a y\ny c z\nk type C") | {("<z>", "<b>", '"w, and more"')})
    row = hf.explain_matches(kb, rules).first()
    assert [tuple(p) for p in row["premises"]] == [
        ("<x>", "<a>", "<y>"),
        ("<z>", "<b>", '"w, and more"'),
        ("<y>", "<c>", "<z>"),
        ("<k>", hf.RDF_TYPE, "<C>"),
    ]
    rendered = hf.render_explanations(hf.explain_matches(kb, rules)).first()
    assert rendered["premises"][3] == "(<k> type <C>)"
    assert rendered["premises"][1] == '(<z> <b> "w, and more")'
    assert rendered["conclusion"] == '(<x> <q> "w, and more")'


def test_explained_variables_may_have_any_name(spark):
    rules = rules_of(spark, "p(?x,?X) ^ r(?X,?premises) -> q(?x,?premises)")
    row = hf.explain_matches(kb_of(spark, "a p b\nb r c"), rules).first()
    assert tuple(row["conclusion"]) == ("<a>", "<q>", "<c>")


def test_columns_beyond_the_triple_do_not_matter(spark):
    kb = kb_of(spark, "a p b").selectExpr("*", "'g1' AS graph")
    kb = kb.unionByName(kb_of(spark, "a p b").selectExpr("*", "'g2' AS graph"))
    result = hf.infer(kb, rules_of(spark, "p(?x,?y) -> q(?x,?y)"))
    assert [r["matched"] for r in result.stats.collect()] == [1]
    assert as_set(result.kb) == triples("a p b\na q b")


def test_metadata(spark):
    rules = rules_of(
        spark,
        "p(?a,?b) -> q(?a,?b)",
        "q(?a,?b) ^ p(?b,?c) -> q(?a,?c)",
        "q(?a,?b) ^ equal(1,1) -> C(?a)",
        "k(?a,?b) ^ C(?a) -> C(?b)",
        "C(?a,?b) -> t(?a,?b)",
    )
    assert {tuple(r) for r in hf.rule_deps(rules).collect()} == {(1, 2), (1, 3), (2, 2), (2, 3), (3, 4), (4, 4)}
    assert {tuple(r) for r in hf.predicates(rules).collect()} == {
        ("<p>", False), ("<q>", False), ("<C>", True), ("<k>", False), ("<C>", False), ("<t>", False),
    }
    fired = spark.createDataFrame([(1,), (3,)], "rule_id int")
    assert {r["rule_id"] for r in hf.triggered_rules(hf.rule_deps(rules), fired).collect()} == {2, 3, 4}
