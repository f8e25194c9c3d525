"""Repair of conversations, spelling variants and chat formatting, against plain Python."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hornfold.llm import chat, queries, repair, spelling

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, place string, edits int, formatted double"
WORDS = "doc_id bigint, text string, word string, n string, root int"
PROBE = r"\### Assistant: </turn> ok"


def odd_conversations():
    """Nulls, ties, repeats, long texts, odd roles and control strings."""
    rng = random.Random(11)
    texts = ["Yes.", "No", "  ", "", None, "Why?", "a\nb!", "x" * 50_000, "\\", "<turn>", "<\\/turn>", "#### </turn>\n### user:\n", "Ends. \n"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "Assistant:\n"]
    rows = [(i, t, rng.choice(roles), rng.choice(texts)) for i in range(40) for t in range(rng.randint(0, 9))]
    rows += [(100, None, "user", "a."), (100, None, "assistant", None), (100, 3, "user", "b."), (100, 3, "user", "b.")]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho.")]
    rows += [(7000, t, "user" if rng.random() < 0.6 else "assistant", f"turn {t}{rng.choice('.!x')}") for t in range(-70, 230)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*row, "clash", 1, 0.5) for row in rows], CONVERSATIONS)


def damage(rows):
    blank = lambda x: " " if x is None else x
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text, found = blank(role), blank(text), by[conv]
        fault = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        found += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    return {conv: sorted(found, key=key) for conv, found in by.items()}


def cheapest(rows):
    """Faults of (role, text) rows, and cost, edits and rows of the best repair, by Dijkstra over (cost, edits)."""
    faults, seen = [], set()
    for row in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", row[1])
        faults.append("blank" if not bare else "duplicate" if row in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add(row)
    ways, done = [(0, "", 0, "", ())], set()
    while True:
        cost, edits, at, so_far, out = heapq.heappop(ways)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", so_far):
            return faults, cost, edits, out
        state = (at, so_far[:1] == "", so_far[-1:])
        if state in done:
            continue
        done.add(state)
        new = "assistant" if so_far[-1:] == "u" else "user"
        heapq.heappush(ways, (cost + 3, edits + "I", at, so_far + new[0], (*out, (new, ""))))
        if at < len(rows):
            heapq.heappush(ways, (cost + 4, edits + "D", at + 1, so_far, out))
            if faults[at] in ("blank", "duplicate"):
                continue
            cost += 3 * (faults[at] == "truncated")
            role, text = rows[at]
            if re.fullmatch("s?(ua)*u?", so_far + role[:1]) and role[:1]:
                heapq.heappush(ways, (cost, edits + "K", at + 1, so_far + role[0], (*out, rows[at])))
            heapq.heappush(ways, (cost + 3, edits + "R", at + 1, so_far + new[0], (*out, (new, text))))


def coded(rows, faults):
    codes = ""
    for (role, _), fault in zip(rows, faults, strict=True):
        own = role[:1] if role[:1] in ("s", "u", "a") else "o"
        codes += "x" if fault in ("blank", "duplicate") else own.upper() if fault else own
    return codes


def test_search_finds_the_least_cheapest_edits():
    rng = random.Random(1)
    for _ in range(600):
        roles = rng.choices(["user", "assistant", "system", "tool"], [5, 5, 1, 1], k=rng.randint(0, 8))
        rows = [(role, rng.choice(["a.", "b!", "c", "", "d?", "e.", "f."])) for role in roles]
        faults, cost, edits, _ = cheapest(rows)
        codes = coded(rows, faults)
        assert repair.search(codes, repair.NOTHING, repair.END) == (cost, edits)
        assert repair.estimates(codes)[0] <= cost


def test_estimates_of_every_state_are_no_more_than_the_cost():
    rng = random.Random(2)
    for _ in range(60):
        codes = "".join(rng.choices("uaxsUAoO", k=6))
        for way in repair.segment_paths(codes, False, False) + repair.segment_paths(codes, False, True):
            assert repair.estimates(codes)[0] <= way["cost"]
    assert repair.search("u", repair.USER, repair.NOTHING) is None
    assert repair.search("ua", repair.NOTHING, repair.SYSTEM) is None


@pytest.mark.parametrize("size", [32, 1, 3])
def test_repair(spark, size):
    rows = odd_conversations()
    found = {r["conv_id"]: r for r in repair.repair(frame(spark, rows), size).collect()}
    after = damage(rows)
    assert set(found) == {conv for conv, *_ in rows}
    repaired = defaultdict(list)
    if size == 3:
        for r in sorted(repair.repaired(frame(spark, rows), size).collect(), key=lambda r: r["place"]):
            repaired[r["conv_id"]].append((r["role"], r["text"]))
    for conv, turns in after.items():
        faults, cost, edits, out = cheapest([row[1:] for row in turns])
        known = sorted({t for t, *_ in turns if t is not None})
        expected = {
            "gaps": known[-1] - known[0] + 1 - len(known) if known else 0,
            **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False)),
            "cost": cost,
            "audit": edits,
            "repaired_sha256": hashlib.sha256("\n".join(f"{role}:{text}" for role, text in out).encode()).hexdigest(),
        }
        assert found[conv].asDict() == {"conv_id": conv, **expected}
        if size == 3:
            assert tuple(repaired[conv]) == out


def test_repair_of_nothing(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = repair.repair(frame(spark, [(gone, 0, "user", "a.")])).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair(frame(spark, [])).collect() == [] == repair.repaired(frame(spark, [])).collect()


def plain_words(rows):
    counted = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counted[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counted.items() if n >= 2 and len(w) >= 7}


def edit_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize(("region", "sample"), [(4096, 60_000), (5, 60_000), (5, 40)])
def test_spelling_variants(spark, region, sample):
    rng = random.Random(5)
    rows = []
    common = ["".join(rng.choice("abcdeéÀÿ×") for _ in range(rng.randint(7, 10))) for _ in range(30)] + ["z" * 300, "y" * 7, "tornado", "donator"]
    for i in range(300):
        words = []
        for word in rng.choices(common, range(1, len(common) + 1), k=20):
            if rng.random() < 0.15:
                at = rng.randrange(len(word))
                word = word[:at] + rng.choice(["", "x", word[at] * 2, "É"]) + word[at + 1 :]
            words.append(word.upper() if rng.random() < 0.05 and word.isascii() else word)
        rows.append((i if i % 50 else None, rng.choice([" ", "-", "1"]).join(words), "w", "n", 0))
    rows += [(900, None, "", "", 0), (901, "", "", "", 0), (902, "short words 12", "", "", 0), rows[3], rows[3]]
    found = spelling.variants(spark.createDataFrame(rows, WORDS), sample=sample, region=region).collect()
    n = plain_words(rows)
    near = {a: [b for b in n if edit_apart(a, b)] for a in n}
    form = {}
    for a in n:
        best = min(near[a], key=lambda b: (-n[b], b), default=None)
        if best is not None and n[best] >= 10 * n[a]:
            form[a] = best
    assert len(form) > 20
    expected = set()
    for a in n:
        root = a
        while root in form:
            root = form[root]
        expected.add((a, n[a], len(near[a]), form.get(a), n.get(form.get(a)), root))
    assert len(found) == len(expected)
    assert {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in found} == expected


def test_roots_of_long_chains(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}" if i < 9 else None) for i in range(10)], "word string, form string")
    found = spelling.roots(spelling.Run(spark, "test"), chain)
    assert {tuple(r) for r in found.collect()} == {(f"w{i}", "w9") for i in range(9)}


def test_spelling_without_words(spark):
    assert spelling.variants(spark.createDataFrame([], WORDS)).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, "a b c", "", "", 0), (2, None, "", "", 0)], WORDS)).collect() == []


@pytest.mark.parametrize("part", [64, 2])
def test_chat_reads_back(spark, part):
    rows = odd_conversations() + [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)]
    parts = chat.formatted(frame(spark, rows), part)
    found = {r["conv_id"]: r for r in chat.read_back(parts).collect()}
    by, sizes = defaultdict(list), Counter()
    for r in parts.collect():
        sizes[r["conv_id"]] += len(r["formatted"])
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(found) == set(by)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        r = found[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (
            len(turns), sha(whole), len(loss), sha(loss), sizes[conv],
        )
    assert chat.formatted(frame(spark, [])).collect() == []


def test_chat_merges_turns_of_a_role(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "### user"), (1, 2, "assistant", "b</turn>")]
    row = chat.formatted(frame(spark, rows)).first()
    assert row["formatted"] == "### user:\n<turn>a</turn><turn>#\\## user</turn>\n### assistant:\n<turn>b<\\/turn></turn>\n"
    assert [row["formatted"][m["start"] : m["start"] + m["length"]] for m in row["mask"]] == ["b<\\/turn>"]
    turns = spark.range(1).select(chat.turns_of(F.lit(row["formatted"])).alias("t")).first()["t"]
    assert [tuple(t) for t in turns] == [row[2:] for row in rows]


def test_escapes_of_any_text(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices(["#", "## ", "### ", "<", "turn>", "/turn>", "\\", "</turn>", " ", "a", "\n"], k=12)) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    for r in df.withColumn("back", chat.unescape(F.col("e"))).collect():
        assert r["back"] == r["t"] and not any(c in r["e"] for c in chat.CONTROLS)


def test_chat_query_adds_its_probe(spark):
    rows = queries.op13_chat(spark, "/root/testdata/sf0.001").where("conv_id = -7").collect()
    assert [(r["n_turns"], r["loss_chars"]) for r in rows] == [(2, len(PROBE))]
