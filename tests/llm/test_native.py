"""The operators built from DataFrame functions, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from random import Random

import pytest

from hornfold.llm import exact_dedup, line_templates, mixing, sharding, sketches

SCHEMA = "doc_id bigint, text string, source string, size int, kept string, rate double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [
    (1, "one two three four five six", "b"), (2, "one  two\tthree\nfour five six", "b"), (3, None, "a"), (4, "", None),
    (5, "x", "a"), (5, "x", "a"), (6, LONG, "b"), (7, "one two three four five six", None), (None, "lost id", "c"),
    (8, "a b c d e f g h\nline 12 of many\nend", "c"), (9, "été \U0001f600 fin", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*row, 1, "clash", 0.5) for row in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables_give_empty_results(none):
    for operator in (exact_dedup.deduplicate, sharding.shards, mixing.mix, sketches.fingerprints, line_templates.drop_recurring):
        assert operator(none).collect() == [], operator.__name__


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, weak):
    from pyspark.sql import functions as F

    # A digest of one value puts all texts in one group: only the comparison of texts keeps them apart.
    settings = {"digest": lambda text: F.substring(F.sha2(text, 256), 1, 0)} if weak else {}
    rows = exact_dedup.deduplicate(docs, files_a_batch=1, state_partitions=2, **settings).collect()
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", text or "") for _, text, _ in ROWS]
    ids = defaultdict(list)
    for (doc_id, _, _), text in zip(ROWS, texts, strict=True):
        ids[text].append(doc_id)
    least = lambda found: None if None in found else min(found)
    expected = Counter(
        (doc_id, least(ids[t]), len(ids[t]), hashlib.sha256(t.encode()).hexdigest())
        for (doc_id, _, _), t in zip(ROWS, texts, strict=True)
    )
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == expected
    kept = [r["text_sha256"] for r in rows if r["kept"]]
    assert len(kept) == len(set(kept)) == len(ids)
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_of_batches_is_that_of_all_rows(spark, tmp_path, weak):
    from pyspark.sql import functions as F

    settings = {"digest": lambda text: F.substring(F.sha2(text, 256), 1, 1)} if weak else {}
    parts = [
        [(i, f"text  {i % 40}") for i in range(10, 70)] + [(None, "text 1"), (5, None)],
        [(i, f"text {i % 55}") for i in range(0, 130, 2)] + [(200, "new"), (201, "new")],
        [(300, ""), (301, "text\t3"), (302, "only here")],
    ]
    tables = [spark.createDataFrame(rows, "doc_id long, text string") for rows in parts]
    for number, table in enumerate(tables):
        folder = {"folder": str(tmp_path / "kept"), "batch": f"b{number}", "state_partitions": 2}
        rows = exact_dedup.deduplicate(table, **folder, **settings).collect()
        groups = defaultdict(list)
        for doc_id, text in (row for part in parts[: number + 1] for row in part):
            groups[re.sub(r"\s+", " ", text or "")].append((doc_id is not None, doc_id or 0, doc_id))
        expected = Counter()
        for text, ids in groups.items():
            keep, sha = min(ids)[2], hashlib.sha256(text.encode()).hexdigest()
            expected.update((doc_id, keep, len(ids), i == 0, sha) for i, (*_, doc_id) in enumerate(sorted(ids)))
        assert Counter(map(tuple, rows)) == expected
    # A repeated call adds nothing; a lost one must be repeated before the next.
    assert Counter(exact_dedup.deduplicate(tables[-1], **folder, **settings).collect()) == Counter(rows)
    (tmp_path / "kept" / "apart" / "batch=b1" / "_SUCCESS").unlink()
    with pytest.raises(ValueError, match="b1"):
        exact_dedup.deduplicate(tables[0], **(folder | {"batch": "b9"}))
    with pytest.raises(ValueError, match="name"):
        exact_dedup.deduplicate(tables[0], batch="a/b")


def test_exact_dedup_fetches_texts_of_hits_alone(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = spark.range(5000).selectExpr("id as doc_id", "if(id % 500 = 0, 'twice', concat('text ', id)) as text")
    rows.repartition(6).write.parquet(path)
    docs = spark.read.parquet(path)
    located = docs.select("doc_id", "text", exact_dedup.place(docs))
    hits = located.where("text = 'twice'")
    fetched = exact_dedup.fetched(located, hits)
    found = [r["text"] for r in fetched.collect()]
    assert found.count("twice") == 10 and len(found) < 20
    plan = fetched._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert exact_dedup.fetched(located, located).count() == 5000
    assert exact_dedup.fetched(located, located.limit(0)).count() == 0
    # Rows of Parquet files are located where they are: no text is written.
    exact_dedup.located(exact_dedup.Run(spark, "exact", str(tmp_path / "run")), docs, "first", stored=False).collect()
    assert not (tmp_path / "run").exists()


def test_deduplicated_rows_keep_their_columns(docs):
    rows = exact_dedup.deduplicated(docs)
    assert rows.columns == docs.columns
    assert Counter(r["doc_id"] for r in rows.collect()) == Counter([1, 3, 5, 6, None, 8, 9])


def test_shards_are_even_and_gapless(spark):
    texts = {i: ("copy " * 40 if i % 3 == 0 else "t" * (i % 97) * (1 + i % 5)) for i in range(2000)}
    docs = spark.createDataFrame([(i, t, "s", 0, "", 0.0) for i, t in texts.items()], SCHEMA)
    rows = sharding.shards(docs, shard_count=7, ranges=16).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {
        i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items()
    }
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert sorted(slots) == list(range(7))
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in rows)


def test_shards_of_odd_rows(docs):
    rows = sharding.shards(docs, shard_count=3).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(doc_id for doc_id, _, _ in ROWS)


def fill(sizes):
    """Targets by repeated sharing, as the contract words it."""
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        share = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n for n in open_ if share[n] > 2 * sizes[n]}
        if not over:
            return target | share
        target |= {n: 2.0 * sizes[n] for n in over}
        open_ -= over
        if not open_:
            return target


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (i * 7919 % 61), ["big", "mid", "small", "tiny", None][min(4, i % 9)], 0, "", 0.0) for i in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mix(docs).collect()
    sizes = Counter()
    for _, text, source, *_ in rows:
        sizes[source] += len(WORD.findall(text))
    expected, taken = fill(dict(sizes)), Counter()
    for r in found:
        assert r["target"] == pytest.approx(expected[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - expected[s]) <= 61 * 2 for s in sizes)
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)


def test_mix_of_odd_rows(docs):
    rows = mixing.mix(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(doc_id for doc_id, _, _ in ROWS)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    copies = {r["doc_id"]: 0 for r in rows}
    for r in rows:
        copies[r["doc_id"]] = max(copies[r["doc_id"]], r["copies"])
    met = Counter(doc_id for doc_id, _, _ in ROWS)
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n * met[i] for i, n in copies.items() if n})


def shingles(text):
    words = WORD.findall(text)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def test_sketches(docs):
    rows = sketches.fingerprints(docs).collect()
    texts = {}
    for doc_id, text, _ in ROWS:
        texts.setdefault(doc_id, text or "")
    order = [None, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9]
    seen = {}
    for at, doc_id in enumerate(order):
        own, following = texts[doc_id], texts[order[(at + 1) % len(order)]]
        cut = len(own) // 4
        seen.setdefault(doc_id, []).append((own, own[: len(own) - cut] + following[:cut], following))
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r)
    for doc_id, found in by_id.items():
        edited = {hashlib.sha256(e.encode()).hexdigest(): (own, e, n) for own, e, n in seen[doc_id]}
        assert len(found) == len(seen[doc_id])
        for r in found:
            own, changed, following = edited[r["edited_sha256"]]
            a, b, c = shingles(own), shingles(changed), shingles(following)
            assert r["n_chars"] == len(own)
            if max(map(len, (a, b))) < sketches.K:
                assert r["near_edited"] == (len(a & b) / len(a | b) if a | b else 1.0)
            if max(map(len, (a, c))) < sketches.K and len(seen[doc_id]) == 1:
                assert r["near_next"] == (len(a & c) / len(a | c) if a | c else 1.0)
            assert r["distinct_shingles"] == pytest.approx(len(a), rel=0.25)
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert prints[1] == prints[2] == prints[7] != prints[8]


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    left, right = " ".join(f"a{i}" for i in range(900)), " ".join(f"b{i}" for i in range(700))
    frame = spark.createDataFrame([(left, right)], "l string, r string")
    row = frame.select(
        (sketches.merge(sketches.sketch(F.col("l")), sketches.sketch(F.col("r")))
         == sketches.smallest(F.concat(sketches.shingle_hashes(F.col("l")), sketches.shingle_hashes(F.col("r"))))).alias("same"),
        sketches.distinct_count(sketches.sketch(F.col("l"))).alias("n"),
        sketches.containment(sketches.sketch(F.col("l")), sketches.sketch(F.concat_ws(" ", "l", "r"))).alias("inside"),
    ).first()
    assert row["same"] and row["n"] == pytest.approx(896, rel=0.2) and row["inside"] > 0.8


def test_line_templates_drop_recurring_lines(spark):
    rows = []
    for i in range(30):
        own = " ".join("abcdefghij"[(7 * i + k * k) % 10] * (k + 1) for k in range(4 + i))
        rows.append((i, f"{own}\n\nPosted on 2021-0{i % 9}-11 by user{i}\nCall us today for {'abcdef'[i % 6]} offers now", "s", 0, "", 0.0))
    rows += [(100, None, "s", 0, "", 0.0), (101, LONG, "s", 0, "", 0.0), (102, "Posted on 9999-99-99 by user7\nkeep me", "s", 0, "", 0.0)]
    found = {r["doc_id"]: r for r in line_templates.drop_recurring(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(30):
        assert found[i]["text"] == rows[i][1].split("\n")[0] + "\n"
        assert (found[i]["n_lines"], found[i]["dropped_lines"]) == (4, 2)
    assert found[100]["text"] == "" and found[101]["text"] == LONG and found[102]["text"] == "keep me"


def test_long_lines_stay_in_their_first_document_only(spark):
    passage = " ".join(f"p{'abcdefghij'[i % 10] * (i // 10 + 1)}" for i in range(50))
    short = passage.rsplit(" ", 1)[0]
    texts = {3: f"own three\n{passage}", 5: f"{short}\n  {passage}\t\nown five\n{passage}", 7: f"{short}\nown seven", None: passage, 9: f"{passage} 1", 11: f"{passage} 2"}
    rows = [(i, text, "s", 0, "", 0.0) for i, text in texts.items()]
    found = {r["doc_id"]: r for r in line_templates.drop_recurring(spark.createDataFrame([*rows, rows[0]], SCHEMA)).collect()}
    assert {i: r["text"] for i, r in found.items()} == texts | {5: f"{short}\nown five", None: ""}
    assert found[5]["dropped_lines"] == 2


def test_blank_lines_of_any_white_space_stay(spark):
    own = lambda i, n: " ".join(f"{'abcdefghij'[(i + k * n) % 10]}{'xyz'[k % 3] * (i % 7 + 1)}" for k in range(5 + i))
    texts = [f"{own(i, 1)}\r\n\r\n{own(i, 3)}\r\n \t\r\n\x0c" if i % 2 else f"{own(i, 1)}\n\t\n{own(i, 3)}" for i in range(30)]
    docs = spark.createDataFrame([(i, t, "s", 0, "", 0.0) for i, t in enumerate(texts)], SCHEMA)
    assert {r["doc_id"]: r["text"] for r in line_templates.drop_recurring(docs).collect()} == dict(enumerate(texts))


def test_a_leaf_holds_several_templates(spark):
    name = lambda i: "".join("abcdefghij"[int(c)] for c in str(1000 + i))
    kinds = ["we are glad that {} reads our pages", "we are open when {} closes its doors", "we are only half of {} in june", "we are {} to all who come by"]
    often = [12, 12, 12, 4]
    rows = [(100 * k + i, f"{kind.format(name(100 * k + i))}\nown{name(100 * k + i)}", "s", 0, "", 0.0) for k, kind in enumerate(kinds) for i in range(often[k])]
    # One template has most lines of its leaf, another recurs as well.
    rows += [(1000 + i, f"you can {name(i)} the site each day", "s", 0, "", 0.0) for i in range(40)]
    rows += [(2000 + i, f"you can write to {name(i)} in haste", "s", 0, "", 0.0) for i in range(12)]
    found = {r["doc_id"]: r for r in line_templates.drop_recurring(spark.createDataFrame(rows, SCHEMA)).collect()}
    for doc_id, text, *_ in rows:
        stays = text if 300 <= doc_id < 400 else text.split("\n")[1] if doc_id < 300 else ""
        assert found[doc_id]["text"] == stays


def templates_by_hand(texts, least):
    """doc_id: lines kept, by the definition: every choice of hidden blocks of every line."""
    reached, of = defaultdict(set), defaultdict(set)
    for doc_id, text in texts.items():
        for line in set(text.split("\n")):
            words = re.sub("[0-9]+", "0", line).split()
            lead, rest, n = tuple(words[:2]), words[2:], len(words)
            cut = [len(rest) * i // 5 for i in range(6)]
            for hidden in combinations(range(5), 2):
                shown = [tuple(rest[cut[i] : cut[i + 1]]) if i not in hidden else None for i in range(5)]
                if n and len(lead) + sum(map(len, filter(None, shown))) >= 0.6 * n:
                    reached[n, lead, tuple(shown)].add(doc_id)
                    of[line].add((n, lead, tuple(shown)))
    gone = lambda line: any(len(reached[leaf]) >= least for leaf in of[line])
    return {i: [line for line in text.split("\n") if not gone(line)] for i, text in texts.items()}


def test_line_templates_against_every_choice_of_blocks(spark):
    random = Random(4)
    line = lambda: " ".join(random.choice("ab") if random.random() < 0.9 else str(random.randrange(9)) for _ in range(random.choice([0, 1, 2, 3, 4, 6, 9, 13])))
    texts = {i: "\n".join(line() for _ in range(random.randrange(1, 5))) for i in range(60)}
    rows = [(i, text, "s", 0, "", 0.0) for i, text in texts.items()]
    found = line_templates.drop_recurring(spark.createDataFrame(rows, SCHEMA), least=4).collect()
    expected = templates_by_hand(texts, 4)
    assert {r["doc_id"]: r["text"].split("\n") for r in found} == {i: kept or [""] for i, kept in expected.items()}
    assert 0 < sum(r["dropped_lines"] for r in found) < sum(r["n_lines"] for r in found)
