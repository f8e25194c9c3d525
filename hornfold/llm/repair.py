"""Conversation structure repair: cheapest edits by iterative-deepening A*.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Rows may be kept,
deleted, given another role, and empty rows inserted; each edit has a cost. The search goes depth first
in ASCII order of the edits under a bound that grows to the least estimate that exceeded it. Estimates
never exceed the cost that is left, so the first accepting path is the cheapest one and of equally cheap
ones the least in ASCII order. States that failed are remembered with the budget they failed on.

Long conversations are cut into segments of a fixed number of rows. Each is searched from every role
state it may begin in to every one it may end in; the cheapest chain of segments is then picked in two
streaming passes, so that no task holds a conversation. Edits in two paths through a segment are never
a prefix of one another, so picking the least segment by segment gives the least as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornfold.llm.common import Run, partitions, ranked, utf8_crc32

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
#: What a row that breaks off costs unless it is deleted.
TRUNCATED_COST = 3
SEGMENT = 32
SPACES, ENDS = " \t\n\v\f\r", ".!?"
NOTHING_SHA256 = hashlib.sha256(b"").hexdigest()

# Role states: nothing yet, after the system row, after a user row, after an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = (NOTHING, SYSTEM, USER, ASSISTANT)
ACCEPTING = (NOTHING, ASSISTANT)
#: The state after a row of the role that a state asks for, which rerole and insert give.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: States after a kept row by its initial; any other pair is not allowed.
KEPT = {(NOTHING, "s"): SYSTEM, **{(q, "a" if q == USER else "u"): NEXT[q] for q in STATES}}
LEGAL = frozenset({"su", "ua", "au"})
#: The ``goal`` of a conversation's last segment; of others it is one of the states.
END = -1

# A row's code: its initial, or "o" for any other, in upper case if the row is truncated; "x" if it has to go.
MUST_GO = "x"


def estimates(codes: str) -> list[int]:
    """For every place the least that the rows from there on can cost, whatever the state.

    Rows that must go and truncated rows have their price. Two neighbours (rows that must go aside)
    whose initials may not follow each other need one more edit; neighbours are counted at most once.
    """
    found = [0] * (len(codes) + 1)
    # Of what remains from a row on: with that row free for a pair, and without it.
    free = taken = 0
    after = ""
    for i in range(len(codes) - 1, -1, -1):
        code = codes[i]
        if code == MUST_GO:
            free, taken = free + COSTS[DELETE], taken + COSTS[DELETE]
        else:
            own = TRUNCATED_COST if code.isupper() else 0
            # Deleting a truncated row costs only the difference more.
            extra = min(COSTS[INSERT], COSTS[REROLE])
            if code.isupper() or after.isupper():
                extra = min(extra, COSTS[DELETE] - TRUNCATED_COST)
            paired = taken + extra if after and (code + after).lower() not in LEGAL else 0
            free, taken = own + max(free, paired), own + free
            after = code
        found[i] = free
    return found


def moves(code: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of the edits that consume a row, in ASCII order."""
    found = [(DELETE, COSTS[DELETE], state)]
    if code != MUST_GO:
        own = TRUNCATED_COST if code.isupper() else 0
        if (state, code.lower()) in KEPT:
            found.append((KEEP, own, KEPT[state, code.lower()]))
        found.append((REROLE, COSTS[REROLE] + own, NEXT[state]))
    return found


def reachable(codes: str, start: int, goal: int) -> bool:
    if goal == NOTHING:
        return start == NOTHING
    if goal == SYSTEM:
        return start == SYSTEM or (start == NOTHING and "s" in codes.lower())
    return True


def search(codes: str, start: int, goal: int) -> tuple[int, str] | None:
    """Cost and edits of the cheapest way through the rows from state ``start`` to ``goal``; None if there is none.

    Rows are inserted before the row that follows; after the last one only if ``goal`` is the end of
    the conversation.
    """
    if not reachable(codes, start, goal):
        return None
    size, left = len(codes), estimates(codes)
    steps = [[moves(code, state) for state in STATES] for code in codes]
    failed: dict[int, int] = {}
    bound = left[0]
    while True:
        beyond = None
        path: list[str] = []
        # Entries: (place, state, budget, edits so far, has it been tried).
        open_ = [(0, start, bound, 0, "", False)]
        while open_:
            place, state, budget, depth, edit, tried = open_.pop()
            key = 4 * place + state
            if tried:
                failed[key] = max(failed.get(key, -1), budget)
                continue
            if failed.get(key, -1) >= budget:
                continue
            del path[max(0, depth - 1) :]
            if edit:
                path.append(edit)
            at_end = place == size
            if at_end and (state in ACCEPTING if goal == END else state == goal):
                return bound - budget, "".join(path)
            open_.append((place, state, budget, depth, edit, True))
            ways = [] if at_end else [(e, c, place + 1, q) for e, c, q in steps[place][state]]
            if not at_end or goal == END:
                ways.insert(min(1, len(ways)), (INSERT, COSTS[INSERT], place, NEXT[state]))
            for e, cost, to, q in reversed(ways):
                rest = budget - cost
                if rest >= left[to]:
                    open_.append((to, q, rest, depth + 1, e, False))
                elif beyond is None or bound + left[to] - rest < beyond:
                    beyond = bound + left[to] - rest
        # What the table cut off failed with as much to spend, and so gave its estimate before.
        bound = bound + 1 if beyond is None else beyond


@lru_cache(1 << 16)
def segment_paths(codes: str, first: bool, last: bool) -> list[dict[str, int | str]]:
    """Every way through a segment: state at its start, state at its end (END: of the conversation), cost, edits."""
    found = []
    for start in (NOTHING,) if first else STATES:
        for goal in (END,) if last else STATES:
            if way := search(codes, start, goal):
                found.append({"start": start, "goal": goal, "cost": way[0], "edits": way[1]})
    return found


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the faults that the hash of ``conv_id:turn`` plants; nulls are one space."""
    blank = F.lit(" ")
    ids = [F.coalesce(F.col(name).cast("string"), blank) for name in ("conv_id", "turn")]
    each = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("text"),
        (utf8_crc32(F.concat_ws(":", *ids)) % 20).alias("fault"),
    )
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ENDS, ""))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    each = each.where("fault != 0").withColumn("__time", F.explode(F.sequence(F.lit(1), times)))
    return each.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
    )


def digested(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))


ORDER = ["conv_id", "turn", "role", "digest"]


def faults(run: Run, rows: DataFrame) -> DataFrame:
    """Per row rank, conv_id, turn, role, digest, place (in the conversation, from 0), is_last and fault.

    Order is turn (null first), role, digest of the text. Of rows with the same role and text the first
    is no duplicate. Ranks come from a range shuffle, which splits a conversation of any size.
    """
    end = F.substring(F.btrim("text", F.lit(SPACES)), -1, 1).alias("end")
    placed = ranked(run, digested(rows).select(*ORDER, end), ORDER).withColumnRenamed("__rank", "rank")
    # Copies are merged before the shuffle; a rank is one row, so the joins by it are even.
    firsts = placed.groupBy("conv_id", "role", "digest").agg(F.min("rank").alias("rank"))
    seen = placed.join(firsts.select("rank", F.lit(True).alias("is_first")), "rank", "left")
    bounds = placed.groupBy("conv_id").agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    bounds = bounds.withColumnRenamed("conv_id", "__conv")
    fault = (
        F.when(F.col("end") == "", "blank")
        .when(F.col("is_first").isNull(), "duplicate")
        .when(~F.col("end").isin(*ENDS), "truncated")
    )
    found = seen.join(bounds, seen["conv_id"].eqNullSafe(bounds["__conv"])).select(
        "rank",
        *ORDER,
        (F.col("rank") - F.col("first")).alias("place"),
        (F.col("rank") == F.col("last")).alias("is_last"),
        fault.alias("fault"),
    )
    return run.table(found, "faults")


def code(initial: Column, fault: Column) -> Column:
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(fault.isin("blank", "duplicate"), MUST_GO).when(fault == "truncated", F.upper(known)).otherwise(known)


PATHS = "array<struct<start: int, goal: int, cost: long, edits: string>>"
WAYS = pa.list_(pa.struct([("start", pa.int32()), ("goal", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))


def paths(rows: DataFrame, size: int) -> DataFrame:
    """conv_id, segment, first (rank), is_last and the ways through it, for every ``size`` rows of a conversation."""
    row = F.struct("rank", code(F.substring("role", 1, 1), F.col("fault")).alias("code"))
    found = (
        rows.withColumn("segment", F.expr(f"place div {size}"))
        # A stated number of partitions: few bytes, but each row takes a search.
        .repartition(partitions(rows.sparkSession), "conv_id", "segment")
        .groupBy("conv_id", "segment")
        .agg(F.sort_array(F.collect_list(row)).alias("found"), F.max("is_last").alias("is_last"))
        .select("conv_id", "segment", F.col("found.rank")[0].alias("first"), "is_last", F.array_join("found.code", "").alias("codes"))
    )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in (1, 3, 4))
            ways = [segment_paths(codes, no == 0, last) for no, last, codes in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(ways, WAYS)], names=["conv_id", "segment", "first", "is_last", "paths"]
            )

    kind = found.schema["conv_id"].dataType.simpleString()
    return found.mapInArrow(of, f"conv_id {kind}, segment long, first long, is_last boolean, paths {PATHS}")


def best_ways(ways: list[dict], after: dict[int, int]) -> list[tuple[int, dict]]:
    """For each state at the start, the cheapest total and the way that gives it; ``after`` has what follows costs."""
    best: dict[int, tuple[int, dict]] = {}
    for way in ways:
        if way["goal"] not in after:
            continue
        total = way["cost"] + after[way["goal"]]
        known = best.get(way["start"])
        if known is None or (total, way["edits"]) < (known[0], known[1]["edits"]):
            best[way["start"]] = (total, way)
    return list(best.values())


def cheapest_chain(found: DataFrame) -> DataFrame:
    """first and edits of each segment on the cheapest way through its conversation.

    Backwards each segment gets its best way from every state; forwards the states are followed. Both
    passes stream over sorted segments and hold one at a time.
    """

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, after = None, {}
        for batch in batches:
            kept = []
            for conv, ways in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if here != (conv,):  # a tuple, as null is an id too
                    here, after = (conv,), {END: 0}
                best = best_ways(ways, after)
                after = {way["start"]: total for total, way in best}
                kept.append([way for _, way in best])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(kept, WAYS)], names=batch.schema.names)

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state = None, NOTHING
        for batch in batches:
            edits = []
            for conv, ways in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if here != (conv,):
                    here, state = (conv,), NOTHING
                way = next(w for w in ways if w["start"] == state)
                state = way["goal"]
                edits.append(way["edits"])
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(edits, pa.string())], names=["first", "edits"])

    parts = partitions(found.sparkSession)
    back = found.repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.desc("segment"))
    back = back.mapInArrow(backwards, found.schema)
    ahead = back.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "segment")
    return ahead.mapInArrow(forwards, "first long, edits string")


def edited(conversations: DataFrame, size: int) -> DataFrame:
    """Rows of text and rows of edits, together and in order: conv_id, turn, role, digest, edits, fault, text.

    Each text comes before the edits of its rows. Texts are shuffled once, by conv_id.
    """
    run = Run(conversations.sparkSession, "repair")
    rows = damaged(conversations)
    marked = faults(run, rows)
    found = run.table(paths(marked, size), "paths")
    alone = (F.col("segment") == 0) & F.col("is_last")
    chosen = found.where(alone).select("first", F.col("paths")[0]["edits"].alias("edits"))
    chosen = chosen.union(cheapest_chain(found.where(~alone)))
    # Insertions go with the row after them, the last ones with the row before.
    each = F.regexp_extract_all("edits", F.lit("I*[DKR](?:I+$)?"), F.lit(0))
    steps = chosen.select("first", F.posexplode(each).alias("at", "edits"))
    steps = steps.select((F.col("first") + F.col("at")).alias("rank"), "edits")
    edits = marked.join(steps, "rank").select(*ORDER, "rank", "edits", "fault", F.lit(None).cast("string").alias("text"))
    texts = digested(rows).select(
        *ORDER, F.lit(-1).cast("long").alias("rank"), *(F.lit(None).cast("string").alias(c) for c in ("edits", "fault")), "text"
    )
    both = texts.union(edits).repartition(partitions(run.spark), "conv_id")
    return both.sortWithinPartitions(*ORDER, "rank").select(*ORDER, "edits", "fault", "text")


class Repair:
    """Follows one conversation row by row: its counts, its edits and a digest of what it becomes."""

    def __init__(self):
        self.state, self.digest, self.written = NOTHING, hashlib.sha256(), False
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.cost, self.audit = 0, []
        self.turn = self.least = None
        self.turns = 0
        self.before = ""

    def row(self, turn: int | None, role: str, text: str, edits: str, fault: str | None) -> list[tuple[str, str]]:
        """The rows (role, text) that one row becomes."""
        if turn is not None and turn != self.turn:
            self.turns, self.turn = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        if fault:
            self.counts[fault] += 1
        if self.audit and self.before + role[:1] not in LEGAL:
            self.counts["illegal"] += 1
        self.before = role[:1]
        self.audit.append(edits)
        found = []
        for edit in edits:
            self.cost += COSTS[edit]
            if edit == DELETE:
                continue
            if edit != INSERT and fault == "truncated":
                self.cost += TRUNCATED_COST
            if edit == KEEP:
                self.state = KEPT[self.state, role[:1]]
                found.append((role, text))
            else:
                self.state = NEXT[self.state]
                found.append((ROLES[self.state], "" if edit == INSERT else text))
        for kept, words in found:
            self.digest.update(("\n" if self.written else "").encode() + f"{kept}:{words}".encode())
            self.written = True
        return found

    def report(self) -> dict[str, int | str]:
        gaps = self.turn - self.least + 1 - self.turns if self.turns else 0
        return {"gaps": gaps, **self.counts, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def repair(conversations: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Per conv_id of ``conversations``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are first ``damaged``, where nulls become one space; a null conv_id is a conversation of its
    own. Rows of one turn are ordered by role and digest of the text, so repeated rows are neighbours,
    and all but the first are duplicates. A conversation without rows after the damage has zeros, an
    empty audit and the digest of nothing. An empty table gives an empty result. Columns beside conv_id,
    turn, role and text are not looked at. Neither the search nor the passes hold more of a conversation
    than a segment of ``size`` rows; audit and digest of one are made in one task that streams its rows.
    """
    counters = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, now, text = None, Repair(), ""
        for batch in batches:
            ids, found = [], []
            for conv, turn, role, _, edits, fault, new in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != (conv,):
                    if here:
                        ids.append(here[0])
                        found.append(now.report())
                    here, now = (conv,), Repair()
                if edits is None:
                    text = new
                else:
                    now.row(turn, role, text, edits, fault)
            yield reported(ids, found, batch.schema.field("conv_id").type)
        if here:
            yield reported([here[0]], [now.report()], batch.schema.field("conv_id").type)

    def reported(ids: list, found: list[dict], kind: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array(ids, kind)]
        columns += [pa.array([r[c] for r in found], pa.int64()) for c in counters]
        columns += [pa.array([r[c] for r in found], pa.string()) for c in ("audit", "repaired_sha256")]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", *counters, "audit", "repaired_sha256"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in counters)
    done = edited(conversations, size).mapInArrow(of, f"conv_id {kind}, {numbers}, audit string, repaired_sha256 string")
    every = conversations.select(F.col("conv_id").alias("__conv")).distinct()
    joined = every.join(done, every["__conv"].eqNullSafe(done["conv_id"]), "left")
    return joined.select(
        F.col("__conv").alias("conv_id"),
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counters),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(NOTHING_SHA256)).alias("repaired_sha256"),
    )


def repaired(conversations: DataFrame, size: int = SEGMENT) -> DataFrame:
    """conv_id, place (from 0), role, text: the rows of the repaired conversations; those of ``repair``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, now, text, place = None, Repair(), "", 0
        for batch in batches:
            rows = []
            for conv, turn, role, _, edits, fault, new in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != (conv,):
                    here, now, place = (conv,), Repair(), 0
                if edits is None:
                    text = new
                else:
                    for kept, words in now.row(turn, role, text, edits, fault):
                        rows.append((conv, place, kept, words))
                        place += 1
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "place", "role", "text"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return edited(conversations, size).mapInArrow(of, f"conv_id {kind}, place long, role string, text string")
