"""Rule bodies as filters and equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornfold.functions.terms import BUILTINS, num, triple_struct
from hornfold.sources.rules import Atom, Rule, is_variable
from hornfold.sources.triples import relation

#: Facts of a relation per distinct subject, per distinct object, and in all.
FanOut = tuple[float, float, float]
#: Subjects and objects with many facts, and into how many pieces each is cut.
Pieces = tuple[dict[str, int], dict[str, int]]
#: No variable has a space in its name.
PIECE = "piece of a hot value"
#: Where nothing was counted: subjects tend to have one fact each, objects to be shared.
UNKNOWN: FanOut = (1.0, 2.0, 1000.0)


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def premise(position: int) -> str:
    return f"premise {position}"


def match_body(
    kb: DataFrame, rule: Rule, *, explain: bool = False, count_matches: bool = True, reduce: bool = False
) -> DataFrame:
    """All matches of a rule body: one column per variable.

    With ``explain`` the ordered body triples come along as ``premises``. With
    ``count_matches=False`` a variable used nowhere else is only tested for existence, so the rows
    give the same conclusions without one row per match. With ``reduce`` the relations are reduced by
    semi-joins first (``reduced``).
    """
    relations = [relation(kb, *atom.key) for atom in rule.body]
    return join_atoms(relations, rule, explain=explain, count_matches=count_matches, reduce=reduce)


def join_atoms(
    relations: Sequence[DataFrame],
    rule: Rule,
    *,
    first: int | None = None,
    fanouts: Sequence[FanOut | None] | None = None,
    pieces: Sequence[Pieces] | None = None,
    explain: bool = False,
    count_matches: bool = True,
    reduce: bool = False,
) -> DataFrame:
    """Match a body whose i-th atom reads the ``(s, o)`` rows of ``relations[i]``.

    ``first`` names the atom to start from (the one reading new facts); ``fanouts`` has what is known
    of each relation's rows per subject and per object; ``pieces`` its hot values, which are split.
    """
    wanted = None if explain or count_matches else joining_variables(rule)
    bound: set[str] = set()
    bindings: DataFrame | None = None
    rights = []
    for i, atom in enumerate(rule.body):
        rel = numbers_within(relations[i], atom, rule.builtins)
        right = atom_bindings(rel, atom, premise(i) if explain else None)
        kept = [v for v in atom.variables if wanted is None or v in wanted]
        if len(kept) < len(atom.variables):
            # Only the existence of the dropped variable matters. Removing duplicates here lets
            # each task shrink a hot key to one row before the join shuffles it.
            right = right.select(*map(column, kept)).distinct() if kept else right.limit(1)
        rights.append(right)
    order = join_order(rule.body, first, fanouts, wanted)
    if reduce:
        kept = [set(a.variables) if wanted is None else set(a.variables) & wanted for a in rule.body]
        rights, order = reduced(rights, kept, order)
    hot: dict[str, dict[str, int]] = {}
    for i in order:
        atom, right = rule.body[i], rights[i]
        own = hot_values(atom, pieces[i]) if pieces else {}
        kept = [v for v in atom.variables if wanted is None or v in wanted]
        shared = [v for v in kept if v in bound]
        if bindings is None:
            bindings = right
        elif not atom.variables:
            bindings = bindings.filter(right.exists())
            if explain:
                bindings = bindings.withColumn(premise(i), constant_triple(atom))
        else:
            # An atom that adds no variable keeps or drops a binding either way, relations being
            # sets. Starting from new facts the inner join lets Spark broadcast the new side.
            how = "left_semi" if not explain and first is None and len(shared) == len(kept) else "inner"
            many = [hot.get(shared[0], {}), own.get(shared[0], {}) if how == "inner" else {}] if len(shared) == 1 else []
            bindings = join_split(bindings, right, shared[0], *many, how) if any(many) else bindings.join(right, shared, how)
        for v, values in own.items():
            hot[v] = merged(hot.get(v, {}), values)
        bound.update(kept)
    for call in rule.builtins:
        bindings = bindings.filter(builtin_condition(call))
    if explain:
        premises = F.array(*(column(premise(i)) for i in range(len(rule.body)))).alias("premises")
        bindings = bindings.select(*map(column, sorted(bound)), premises)
    return bindings


def merged(one: dict[str, int], other: dict[str, int]) -> dict[str, int]:
    return {value: max(one.get(value, 0), other.get(value, 0)) for value in one | other}


def hot_values(atom: Atom, pieces: Pieces) -> dict[str, dict[str, int]]:
    """The hot values of each variable of a property atom; facts of a class have a subject of their own each."""
    found: dict[str, dict[str, int]] = {}
    for term, values in zip((atom.s, atom.o), pieces, strict=True):
        if is_variable(term) and values and not atom.is_type:
            found[term[1:]] = merged(found.get(term[1:], {}), values)
    return found


def join_split(
    left: DataFrame, right: DataFrame, name: str, of_left: dict[str, int], of_right: dict[str, int], how: str
) -> DataFrame:
    """Join on one variable; rows of a hot value are dealt to its pieces, its partners are copied to each of them.

    A row's piece is a hash of the row, so a task that is run again makes the same one. A value that is
    hot on both sides is cut on the side where it has more pieces.
    """
    cut_left = {v: n for v, n in of_left.items() if n > 1 and n >= of_right.get(v, 0)}
    cut_right = {v: n for v, n in of_right.items() if n > 1 and v not in cut_left}
    pieced = with_piece(left, name, cut_left, cut_right), with_piece(right, name, cut_right, cut_left)
    return pieced[0].join(pieced[1], [name, PIECE], how).drop(PIECE)


def with_piece(rows: DataFrame, name: str, cut: dict[str, int], copied: dict[str, int]) -> DataFrame:
    """Rows with their piece: of ``cut`` values by hash, of ``copied`` values all of them, else 0."""
    value = column(name)

    def count(values: dict[str, int]) -> Column:
        return F.create_map(*(F.lit(term) for pair in values.items() for term in pair))[value]

    by_hash = F.lit(0)
    if cut:
        mine = F.pmod(F.xxhash64(*map(column, rows.columns)), count(cut)).cast("int")
        by_hash = F.when(value.isin(list(cut)), mine).otherwise(by_hash)
    if copied:
        every = F.when(value.isin(list(copied)), F.sequence(F.lit(0), count(copied) - 1))
        by_hash = F.explode(every.otherwise(F.array(by_hash)))
    return rows.withColumn(PIECE, by_hash)


def join_order(
    body: Sequence[Atom],
    first: int | None,
    fanouts: Sequence[FanOut | None] | None,
    wanted: set[str] | None,
) -> list[int]:
    """Connected order, atoms without variables last; next the atom that adds fewest rows to a binding.

    That is its facts per value of the bound side. Where this isn't known, an atom joined by its
    subject comes before one joined by its object, of which many subjects tend to share one. The start,
    unless it is given, is the atom from which such an order has the fewest rows in all.
    """
    known = [(fanouts[i] if fanouts else None) or UNKNOWN for i in range(len(body))]
    waiting = [i for i, atom in enumerate(body) if atom.variables]
    ground = [i for i, atom in enumerate(body) if not atom.variables]
    if not waiting:
        return ground
    if first in waiting:
        return order_from(first, body, waiting, known)[0] + ground
    found = {}
    for i in waiting:
        # An atom with a variable that is only tested for existence makes a better semi-join than a start.
        late = wanted is not None and not set(body[i].variables) <= wanted and not selective(body[i])
        order, rows = order_from(i, body, waiting, known)
        found[late, rows, i] = order
    return found[min(found)] + ground


def order_from(start: int, body: Sequence[Atom], waiting: list[int], known: list[FanOut]) -> tuple[list[int], float]:
    """The order from a start, and the rows of all its steps."""
    order, rows = [start], start_rows(body[start], known[start])
    total, rest = rows, [i for i in waiting if i != start]
    while rest:
        bound = {v for i in order for v in body[i].variables}
        connected = [i for i in rest if bound & set(body[i].variables)]
        # An atom that adds no variable only narrows the bindings, so it never comes too early.
        best = min(
            connected,
            key=lambda i: (
                not set(body[i].variables) <= bound,
                not selective(body[i]),
                expected_rows(body[i], bound, known[i]),
                i,
            ),
        )
        if not set(body[best].variables) <= bound:
            rows *= expected_rows(body[best], bound, known[best])
        total += rows
        order.append(best)
        rest.remove(best)
    return order, total


def rows_expected(body: Sequence[Atom], first: int | None, fanouts: Sequence[FanOut], new: int | None) -> float:
    """Matches of a body by what is known of its relations; ``new`` is the number of facts that atom ``first`` reads."""
    start, *rest = join_order(body, first, fanouts, None)
    rows = start_rows(body[start], fanouts[start]) if new is None else float(new)
    bound = set(body[start].variables)
    for i in rest:
        if not set(body[i].variables) <= bound:
            rows *= expected_rows(body[i], bound, fanouts[i])
        bound |= set(body[i].variables)
    return rows


def start_rows(atom: Atom, known: FanOut) -> float:
    """Facts of an atom by itself: of one value where it fixes its subject or object."""
    sides = [per for term, per in zip((atom.s, atom.o), known[:2], strict=True) if not is_variable(term)]
    return known[2] if atom.is_type else min(sides, default=known[2])


def expected_rows(atom: Atom, bound: set[str], known: FanOut) -> float:
    """Facts of an atom for each binding of the variables it shares with ``bound``."""
    sides = [per for term, per in zip((atom.s, atom.o), known[:2], strict=True) if term[1:] in bound and is_variable(term)]
    return min(sides, default=0.0)


def ears(variables: Sequence[set[str]], root: int) -> list[tuple[int, int]]:
    """(ear, the atom it hangs on) in an order of removal: what an ear shares with the rest is all in that atom.

    Of an acyclic body all atoms but the root are removed, of a cyclic one the branches that hang on its cycle.
    """
    rest, found = [i for i, vs in enumerate(variables) if vs], []
    while True:
        for ear in rest:
            shared = variables[ear] & set().union(*(variables[i] for i in rest if i != ear))
            hosts = [i for i in rest if i != ear and shared <= variables[i]]
            if ear != root and shared and hosts:
                found.append((ear, hosts[0]))
                rest.remove(ear)
                break
        else:
            return found


def reduced(
    rights: Sequence[DataFrame], variables: Sequence[set[str]], order: Sequence[int]
) -> tuple[list[DataFrame], list[int]]:
    """Each atom's rows without those that find no partner further out in the join tree, and the order to join in.

    Semi-joins go up the tree, ears first, to the atom that the joins start from. Joined outwards from
    there, every row that is made is part of a match of an acyclic body, so a downward pass isn't needed.
    It pays where most rows find no partner; each semi-join shuffles keys alone.
    """
    rights = list(rights)
    tree = ears(variables, order[0])
    for ear, host in tree:
        on = sorted(variables[ear] & variables[host])
        rights[host] = rights[host].join(rights[ear].select(*map(column, on)), on, "left_semi")
    outer = [ear for ear, _ in reversed(tree)]
    core = [i for i in order if variables[i] and i not in outer]
    return rights, core + outer + [i for i in order if not variables[i]]


def numbers_within(rel: DataFrame, atom: Atom, builtins: Sequence[Atom]) -> DataFrame:
    """The rows whose ``number``, where the relation has it, meets the comparisons of the object with constants.

    A stored table is sorted by it, so files and row groups outside the range aren't read.
    """
    if "number" not in rel.columns or not is_variable(atom.o):
        return rel
    for call in builtins:
        constants = [t for t in (call.s, call.o) if not is_variable(t)]
        if atom.o not in (call.s, call.o) or len(constants) != 1:
            continue
        try:
            value = F.lit(int(constants[0].strip('<>"')))
        except ValueError:
            continue  # matches nothing, as the comparison itself finds
        sides = [F.col("number") if is_variable(t) else value for t in (call.s, call.o)]
        rel = rel.filter(BUILTINS[call.p](*sides))
    return rel


def selective(atom: Atom) -> bool:
    """Whether a property atom fixes its subject or object."""
    return not atom.is_type and not (is_variable(atom.s) and is_variable(atom.o))


def joining_variables(rule: Rule) -> set[str]:
    """Variables that the head, a builtin or a second atom needs."""
    needed = {v for atom in (rule.head, *rule.builtins) for v in atom.variables}
    seen: set[str] = set()
    for atom in rule.body:
        needed.update(v for v in atom.variables if v in seen)
        seen.update(atom.variables)
    return needed


def atom_bindings(rel: DataFrame, atom: Atom, premise_name: str | None = None) -> DataFrame:
    """Rows of one atom: constants filtered, one column per variable."""
    matched = rel
    if not is_variable(atom.s):
        matched = matched.filter(F.col("s") == atom.s)
    if not is_variable(atom.o) and not atom.is_type:
        matched = matched.filter(F.col("o") == atom.o)
    if is_variable(atom.s) and atom.s == atom.o:
        matched = matched.filter(F.col("s") == F.col("o"))
    columns = {}
    if is_variable(atom.o):
        columns[atom.o[1:]] = F.col("o")
    if is_variable(atom.s):
        columns[atom.s[1:]] = F.col("s")
    selected = [col.alias(name) for name, col in columns.items()]
    if premise_name:
        o = F.lit(atom.o) if atom.is_type else F.col("o")
        selected.append(triple_struct(F.col("s"), F.lit(atom.p), o).alias(premise_name))
    return matched.select(*(selected or [F.lit(True).alias("holds")]))


def constant_triple(atom: Atom) -> Column:
    return triple_struct(F.lit(atom.s), F.lit(atom.p), F.lit(atom.o))


def builtin_condition(call: Atom) -> Column:
    """A numeric comparison of two operands; NULL (no match) when one is not an integer."""
    left, right = (num(column(t[1:]) if is_variable(t) else F.lit(t)) for t in (call.s, call.o))
    return BUILTINS[call.p](left, right)
