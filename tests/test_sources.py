import pytest
from helpers import PREFIXES, as_set, iri, kb_of, rules_of

import hornfold as hf

LINES = """\
<a> <p> <b> .
<a>   <p>\t<c>

_:x <p> "two words" .
<a> <p> "20"^^<http://www.w3.org/2001/XMLSchema#int> .
<a> <p> "hello"@en .
<a> <p> "say \\"hi\\" now" .
<a> <p> bare
<a> <p> <b> .
"""
BAD = "only two\n<a> <p\n<a> <p> \"open\n<a> p <b>\n"
GOOD = {
    ("<a>", "<p>", "<b>"),
    ("<a>", "<p>", "<c>"),
    ("_:x", "<p>", '"two words"'),
    ("<a>", "<p>", '"20"'),
    ("<a>", "<p>", '"hello"'),
    ("<a>", "<p>", '"say "hi" now"'),
    ("<a>", "<p>", "bare"),
}


def write(tmp_path, text):
    path = tmp_path / "triples.txt"
    path.write_text(text)
    return str(path)


def test_text_lines_in_every_form(spark, tmp_path):
    assert as_set(hf.load_triples(spark, write(tmp_path, LINES))) == GOOD


def test_malformed_lines_are_dropped_kept_apart_or_fatal(spark, tmp_path):
    path = write(tmp_path, LINES + BAD)
    assert as_set(hf.load_triples(spark, path, on_error="drop")) == GOOD
    good, bad = hf.load_triples(spark, path, on_error="quarantine")
    assert as_set(good) == GOOD
    assert {row["value"] for row in bad.collect()} == set(BAD.strip().splitlines())
    with pytest.raises(Exception, match="malformed triple line"):
        hf.load_triples(spark, path).collect()
    with pytest.raises(ValueError):
        hf.load_triples(spark, path, on_error="ignore")


def test_a_long_literal_is_read_whole(spark):
    literal = '"' + 'x\\"y ' * 200_000 + '"'
    line = spark.createDataFrame([(f"<a> <p> {literal}@en .",)], "value string")
    same = "o = concat('\"', repeat('x\"y ', 200000), '\"') AS same"
    assert tuple(hf.parse_triple_lines(line).selectExpr("s", "p", same).first()) == ("<a>", "<p>", True)


def test_literals_of_any_content_survive_the_text_form(spark, tmp_path):
    inside = ["line one\nline two", 'x"y', "ends in \\", "\\n raw", "tab\there", "cr\rx", "\\\\\"", '"', "", "é \\t \t"]
    facts = {("<a>", "<p>", f'"{text}"') for text in inside}
    kb = spark.createDataFrame(sorted(facts), "s string, p string, o string")
    hf.write_triple_lines(kb, str(tmp_path / "lines"))
    assert as_set(hf.load_triples(spark, str(tmp_path / "lines"))) == facts
    odd = spark.createDataFrame([("<a>", "<p>", "two words")], "s string, p string, o string")
    with pytest.raises(Exception, match="no line can hold"):
        hf.write_triple_lines(odd, str(tmp_path / "odd"))


def test_duplicates_stay_only_when_asked_for(spark, tmp_path):
    path = write(tmp_path, "<a> <p> <b>\n<a> <p> <b> .\n")
    assert hf.load_triples(spark, path).count() == 1
    assert hf.load_triples(spark, path, distinct=False).count() == 2


def test_text_and_parquet_round_trip(spark, tmp_path):
    kb = kb_of(spark, GOOD)
    hf.write_triple_lines(kb, str(tmp_path / "lines"))
    assert as_set(hf.load_triples(spark, str(tmp_path / "lines"), on_error="fail")) == GOOD
    kb.write.parquet(str(tmp_path / "flat"))
    assert as_set(hf.load_triples(spark, str(tmp_path / "flat"), fmt="parquet")) == GOOD


def test_parquet_rows_with_a_missing_field_are_malformed(spark, tmp_path):
    path = str(tmp_path / "holes")
    spark.createDataFrame([("<a>", "<p>", "<b>"), ("<a>", "<p>", None)], "s string, p string, o string").write.parquet(path)
    good, bad = hf.load_triples(spark, path, fmt="parquet", on_error="quarantine")
    assert (as_set(good), [r["value"] for r in bad.collect()]) == ({("<a>", "<p>", "<b>")}, ["<a> <p>"])
    with pytest.raises(Exception, match="malformed triple line"):
        hf.load_triples(spark, path, fmt="parquet", on_error="fail").collect()


def test_stored_by_key_keeps_classes_and_properties_apart(spark, tmp_path):
    kb = kb_of(spark, "a k b\na type k\na other b")
    path = str(tmp_path / "stored")
    hf.save_triples(kb, path, rules=rules_of(spark, "k(?x,?y) -> q(?x,?y)", "k(?x) -> Q(?x)"))
    stored = hf.load_triples(spark, path, fmt="parquet")
    assert as_set(stored.select("s", "p", "o")) == {(iri("a"), iri("k"), iri("b")), (iri("a"), iri("type"), iri("k"))}
    rules = rules_of(spark, "k(?x,?y) -> q(?x,?y)")
    assert as_set(hf.apply_rules(stored, rules)) == {(iri("a"), iri("q"), iri("b"))}
    plan = hf.apply_rules(hf.load_triples(spark, path, fmt="parquet", distinct=False), rules)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(pred_key" in plan.replace("isnotnull(is_type", "isnotnull(pred_key")


def test_triples_from_table_columns(spark):
    people = spark.createDataFrame([(1, 2), (3, 4), (5, None)], "id int, boss int")
    kb = hf.union_triples(
        hf.edge_triples(people, "concat('<', id, '>')", "<boss>", "concat('<', boss, '>')"),
        hf.member_triples(people, "concat('<', id, '>')", "<Person>"),
    )
    assert as_set(kb) == {
        ("<1>", "<boss>", "<2>"),
        ("<3>", "<boss>", "<4>"),
        ("<1>", hf.RDF_TYPE, "<Person>"),
        ("<3>", hf.RDF_TYPE, "<Person>"),
        ("<5>", hf.RDF_TYPE, "<Person>"),
    }


def test_rule_file_becomes_a_table_of_atoms(spark, tmp_path):
    path = tmp_path / "rules.txt"
    path.write_text(
        "# comment\n\np:rents(?desk, ?firm) ^ c:Desk(?desk)^p:seats(?desk,?n) ^ equal( ?n , 20 )-> p:housed(?firm, ?desk)\r\n"
        'p:says(?a,"x, (y) ^ z"@en) -> c:Talker(?a)\n'
    )
    rules = hf.load_rules(spark, str(path), PREFIXES)
    rows = {(r["rule_id"], r["pos"]): r for r in rules.atoms.collect()}
    assert rules.atoms.columns == ["rule_id", "role", "pos", "s", "p", "o", "is_type", "pred_key"]
    assert [(rows[1, i]["role"], rows[1, i]["s"], rows[1, i]["o"]) for i in range(5)] == [
        ("body", "?desk", "?firm"),
        ("body", "?desk", iri("c:Desk")),
        ("body", "?desk", "?n"),
        ("builtin", "?n", "<20>"),
        ("head", "?firm", "?desk"),
    ]
    assert (rows[1, 1]["p"], rows[1, 1]["is_type"], rows[1, 1]["pred_key"]) == (hf.RDF_TYPE, True, iri("c:Desk"))
    assert (rows[1, 0]["p"], rows[1, 0]["is_type"], rows[1, 0]["pred_key"]) == (iri("p:rents"), False, iri("p:rents"))
    assert rows[2, 0]["o"] == '"x, (y) ^ z"'
    assert rows[2, 1]["pred_key"] == iri("c:Talker")


def test_several_rule_files_are_numbered_in_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("p(?x,?y) -> q(?x,?y)\nq(?x,?y) -> r(?x,?y)")
    (tmp_path / "b.txt").write_text("r(?x,?y) -> t(?x,?y)\n")
    rules = hf.load_rules(spark, str(tmp_path / "*.txt"))
    assert [(r.rule_id, r.head.p) for r in rules.rules] == [(1, "<q>"), (2, "<r>"), (3, "<t>")]


def test_class_atoms_in_all_spellings(spark):
    spellings = ["c:Tower(?b)", "rdf:type c:Tower(?b)", "rdf:type(?b, c:Tower)", f"{hf.RDF_TYPE}(?b, c:Tower)"]
    rules = rules_of(spark, *(f"{atom} -> q(?b, x)" for atom in spellings))
    assert {(r.body[0].s, r.body[0].p, r.body[0].o, r.body[0].is_type) for r in rules.rules} == {
        ("?b", hf.RDF_TYPE, iri("c:Tower"), True)
    }


def test_only_words_starting_with_a_question_mark_are_variables(spark):
    atom = rules_of(spark, "p(?x, <http://e.org/?q=1>) -> q(?x, 20)").rules[0].body[0]
    assert atom.variables == ("x",)


@pytest.mark.parametrize(
    ("rule", "message"),
    [
        ("p(?a,?b) ^ q(?c,?d) -> r(?a,?d)", "share no variable"),
        ("p(?a,?b) -> q(?a,?z)", "not bound"),
        ("p(?a,?b) ^ equal(?z,3) -> q(?a,?b)", "not bound"),
        ("?p(?a,?b) -> q(?a,?b)", "variable"),
        ("rdf:type(?a,?c) -> q(?a,?c)", "variable"),
        ("equal(3,4) -> q(a,b)", "no atom"),
        ("p(?a,?b) q(?b,?c) -> r(?a,?c)", "cannot read"),
        ("p(?a,?b,?c) -> r(?a,?c)", "cannot read"),
        ("p() -> r(a,b)", "cannot read"),
        ("p(?a,?b)", "cannot read"),
    ],
)
def test_rules_without_a_safe_reading_are_rejected(spark, rule, message):
    with pytest.raises(ValueError, match=message):
        rules_of(spark, rule)


def test_a_body_may_be_a_long_chain(spark):
    assert len(rules_of(spark, "p(?a,?b) ^ p(?b,?c) ^ p(?c,?d) ^ p(?d,?e) ^ p(?e,f) -> q(?a,?e)").rules[0].body) == 5


def test_a_ground_atom_is_not_a_disconnected_body(spark):
    assert len(rules_of(spark, "C(a) ^ p(?x,?y) -> q(?x,?y)").rules[0].body) == 2
