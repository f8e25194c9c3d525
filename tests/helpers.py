"""Small fact sets, their results as sets, and a brute-force evaluator to compare with."""

from hornfold import RDF_TYPE, rules_from_lines
from hornfold.sources.rules import is_variable

PREFIXES = {
    "p": "http://example.org/property/",
    "c": "http://example.org/class/",
    "r": "http://example.org/resource/",
}


def iri(name):
    """``a`` -> ``<a>``, ``p:a`` -> the prefixed IRI, quoted text and ``type`` as they are."""
    if name == "type":
        return RDF_TYPE
    if name.startswith(('"', "<")):
        return name
    prefix, colon, rest = name.partition(":")
    return f"<{PREFIXES[prefix]}{rest}>" if colon and prefix in PREFIXES else f"<{name}>"


def triples(text):
    return {tuple(iri(word) for word in line.split()) for line in text.strip().splitlines()}


def kb_of(spark, text):
    rows = sorted(triples(text)) if isinstance(text, str) else sorted(text)
    return spark.createDataFrame(rows, "s string, p string, o string")


def rules_of(spark, *lines):
    return rules_from_lines(spark, lines, PREFIXES)


def as_set(frame):
    rows = [(row["s"], row["p"], row["o"]) for row in frame.collect()]
    assert len(rows) == len(set(rows)), "a result must hold no duplicates"
    return set(rows)


def number(term):
    try:
        return int(term.strip('<>"'))
    except ValueError:
        return None


def brute_matches(rule, facts):
    """All matches of a rule body by trying every fact for every atom."""
    results = [({}, ())]
    for atom in rule.body:
        extended = []
        for binding, premises in results:
            for fact in facts:
                new = dict(binding)
                if all(
                    new.setdefault(t, v) == v if is_variable(t) else t == v
                    for t, v in zip((atom.s, atom.p, atom.o), fact, strict=True)
                ):
                    extended.append((new, (*premises, fact)))
        results = extended
    compare = {
        "equal": lambda a, b: a == b,
        "lessthanorequal": lambda a, b: a <= b,
        "greaterthanorequal": lambda a, b: a >= b,
    }

    def holds(call, binding):
        a, b = (number(binding.get(t, t)) for t in (call.s, call.o))
        return a is not None and b is not None and compare[call.p](a, b)

    return [(b, ps) for b, ps in results if all(holds(call, b) for call in rule.builtins)]


def conclude(rule, binding):
    return tuple(binding.get(t, t) for t in (rule.head.s, rule.head.p, rule.head.o))


def brute_closure(rules, facts):
    """``(closure, matches per (phase, rule))`` by re-matching everything and subtracting what was seen."""
    facts, seen, stats, phase = set(facts), set(), {}, 0
    while True:
        phase += 1
        fresh = [
            (rule.rule_id, premises, conclude(rule, binding))
            for rule in rules
            for binding, premises in brute_matches(rule, facts)
            if (rule.rule_id, premises) not in seen
        ]
        if not fresh:
            return facts, stats
        for rule_id, premises, _ in fresh:
            seen.add((rule_id, premises))
            stats[(phase, rule_id)] = stats.get((phase, rule_id), 0) + 1
        facts |= {conclusion for _, _, conclusion in fresh}
