"""The operators with Python inside tasks, and the pipeline, against plain Python."""

import random
import sys
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from hornfold.llm import html_text, packing, quality, simhash, token_files, tokens
from tests_llm_rows import LONG, ODD, ROWS, SCHEMA, WORD


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*row, 1, "clash") for row in ROWS], SCHEMA)


def ids_of(name, text, end):
    tokenizer = Tokenizer.from_file(tokens.vocabulary(name))
    tokenizer.encode_special_tokens = True
    return np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_remembered_words_give_the_ids_of_whole_texts(name):
    encoder = tokens.Encoder(tokens.vocabulary(name))
    for _ in range(2):
        for text, ids in zip(ODD, encoder.encode(ODD), strict=True):
            assert ids == ids_of(name, text, 0)[:-1].tobytes(), repr(text)


def test_a_word_is_learned_once_whatever_its_case_marks_and_line():
    # Each form was learned apart: by Python, part for part, and by the library, word for word.
    stems = ["stone", "étage", "straße", "łódka"]
    forms = ["{}", "{},", "{}.", '{}!"', "\n{}", "\n{}:"]
    text = " ".join(["x", *(form.format(word) for stem in stems for word in (stem, stem.title()) for form in forms)])
    text = text.replace(" \n", "\n")
    for name, words in (("word_bpe_49k.json", len(stems)), ("byte_bpe_50k.json", 4 * len(stems))):
        encoder = tokens.Encoder(tokens.vocabulary(name))
        assert encoder.encode([text]) == [ids_of(name, text, 0)[:-1].tobytes()]
        assert sum(len(getattr(encoder, memory, ())) for memory in ("new", "old", "words", "old_words")) == words


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_slices_are_those_of_the_library(name, monkeypatch):
    # A letter with a mark of its own in lower case (before, the word and its bracket were encoded apart), letters
    # that join marks, other scripts, white space of all kinds.
    pool = [*"abzABZéÉßñÿŁłİıǅſ.,!'\"()-09\n\t\r\u0301\u0338日ΣςЖ\U0001f600\x1c\x85\xa0ª<|", *" " * 20, *"etaoin" * 2, "\n", "\n"]
    rng = random.Random(7)
    texts = ["", "\n", "a", "\na", " a", "a\n", "ΣİΣ) İ) aİ.", *("".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(600))]
    texts.append("x" * 900)
    library = Tokenizer.from_file(tokens.vocabulary(name))
    library.encode_special_tokens = True
    wanted = [np.asarray(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokens, "SLICE_BYTES", 500)
    monkeypatch.setattr(tokens, "REMEMBERED", 100)  # so that words go from the younger memory to the older and out
    encoder = tokens.Encoder(tokens.vocabulary(name))
    batch = pa.RecordBatch.from_pydict({"text": pa.array([*texts, None])})
    parts = list(tokens.slices(batch, 0))
    assert all(part.num_rows == 1 or sum(len((t or "").encode()) for t in part[0].to_pylist()) <= 500 for part in parts)
    found = [ids for part in parts for ids in encoder.encode(part[0])]
    assert found == [*wanted, b""]
    assert encoder.encode([]) == [] and list(tokens.slices(batch.slice(0, 0), 0)) == []


def test_what_an_encoder_remembers_is_bounded():
    # Before, a worker kept 600,000 words and more in each of two generations, over 200 MB that no task gave back.
    encoder = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"))
    digits = str.maketrans("0123456789", "abcdefghij")
    for at in range(0, 480_000, 120_000):
        encoder.encode([" ".join(f"{i:06d}".translate(digits) for i in range(at, at + 120_000))])
    memories = [encoder.new, encoder.old, encoder.words, encoder.old_words]
    size = sum(sys.getsizeof(m) + sum(map(sys.getsizeof, (*m, *m.values()))) for m in memories)
    assert 200_000 < sum(map(len, memories)) <= 400_000 and size < 70e6
    assert tokens.SLICE_BYTES <= 4 << 20


def test_the_plan_of_a_packing_needs_no_python_rdd(spark, monkeypatch):
    # Before, its rows went through Python workers of another kind, which stayed beside those of the encoder.
    docs = spark.createDataFrame([(1, "a few words"), (2, None)], "doc_id long, text string")
    rows = docs.collect()
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    packed = packing.pack(docs)
    assert packed.dtypes[-2:] == [("sequence_id", "bigint"), ("offset", "bigint")]
    assert sorted(r["doc_id"] for r in packed.collect()) == [r["doc_id"] for r in rows]
    assert packing.pack(docs.where("doc_id > 2")).collect() == []


def best_fit(lengths, capacity):
    bins = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, free in enumerate(bins) if free >= length]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= length
        else:
            bins.append(capacity - length)
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng, capacity = random.Random(seed), 50
    lengths = [min(capacity, rng.choice([rng.randint(1, 50), rng.randint(1, 9)])) for _ in range(rng.randint(0, 400))]
    runs = packing.plan(Counter(lengths), capacity)
    bins, placed = defaultdict(list), Counter()
    for length, first, ranks, each, at, offset in runs:
        assert placed[length] == first
        placed[length] += ranks
        for i in range(ranks):
            bins[at + i // each].append((offset + i % each * length, length))
    assert placed == Counter(lengths)
    for pieces in bins.values():
        ends = 0
        for offset, length in sorted(pieces):
            assert offset == ends
            ends += length
        assert ends <= capacity
    assert len(bins) == best_fit(lengths, capacity)


def test_pack(spark, docs):
    rows = packing.pack(docs).collect()
    whole = defaultdict(Counter)
    for doc_id, text, _ in ROWS:
        ids = ids_of("byte_bpe_50k.json", text, 2)
        # Pieces of 1024 counted from the end: only the first may be shorter.
        ends = list(range(len(ids), 0, -1024))[::-1]
        for no, end in enumerate(ends):
            part = ids[max(end - 1024, 0) : end]
            whole[doc_id][(no, end - len(part), len(part), zlib.crc32(part.tobytes()))] += 1
    found = defaultdict(Counter)
    for r in rows:
        found[r["doc_id"]][(r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
    assert found == whole
    assert all(r["length"] == 1024 for r in rows if r["piece"] > 0)
    places: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found_places in places.values():  # gapless from 0, and within the capacity
        at = 0
        for offset, length in sorted(found_places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(docs.limit(0)).collect() == []


def test_token_files(spark, docs, tmp_path):
    known = docs.where("doc_id IS NOT NULL")
    rows = token_files.store(known, folder=str(tmp_path)).collect()
    start, expected = 0, []
    for doc_id, text, _ in sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0]):
        ids = ids_of("word_bpe_49k.json", text, 1)
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows)) == expected
    assert token_files.store(known.limit(0)).collect() == []
    (tmp_path / "files" / "0000000.hfbp.lost").write_bytes(b"part")
    token_files.remove_parts(spark, f"file://{tmp_path}/files")
    assert {path.suffix for path in (tmp_path / "files").iterdir()} == {".hfbp"}
    assert token_files.qualified(spark, "/a/b") == "file:///a/b" and token_files.qualified(spark, "file:/a") == "file:///a"
    with pytest.raises(ValueError):
        token_files.store(docs)


def test_token_files_of_rows_without_an_id(spark, tmp_path):
    from hornfold.llm import queries

    rows = [(i, text, "s", 0, "") for i, text in [*((r[0], r[1]) for r in ROWS), (None, None), (None, "a b"), (-5, "c"), (0, "d")]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    start, expected = 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = ids_of("word_bpe_49k.json", text, 1)
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    found = queries.op8_token_files(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected


def test_planes_round_trip():
    ids = np.random.default_rng(1).integers(0, 2**32, 1000, dtype=np.uint64).astype("<u4")
    for part in (ids, ids[:0], ids[:7] & 0xFF, np.zeros(9, "<u4")):
        assert (token_files.from_planes(token_files.planes(part), len(part)) == part).all()


def plain_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def linked(prints):
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in prints}


@pytest.mark.parametrize("tree_nodes", [2048, 3])
def test_simhash_components(spark, tree_nodes):
    rng = random.Random(3)
    texts = {i: t for i, t in enumerate([None, "", " \n", "one", "One two", "ÉTÉ", LONG])}
    for i in range(40):
        words = [f"w{rng.randint(0, 400)}" for _ in range(300)]
        for copy in range(rng.choice([1, 1, 2, 6])):
            changed = list(words)
            for _ in range(copy):
                changed[rng.randrange(300)] = "edit"
            texts[len(texts)] = " ".join(changed)
    docs = spark.createDataFrame([(i, t, "s", 0, "") for i, t in texts.items()], SCHEMA)
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    found = simhash.near_duplicates(docs, tree_nodes=tree_nodes).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in found} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in found} == linked(prints)


def similar_groups(texts, least=0.8):
    """By comparing all pairs: the smallest id reachable over texts that share enough of their shingles."""
    sets = {}
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in texts}


@pytest.mark.parametrize("tree_nodes", [1024, 3])
def test_similar_texts(spark, tree_nodes):
    rng = random.Random(4)
    texts = dict(enumerate([None, "", " \n", "one", "ONE", "One two", "ÉTÉ", "été", LONG, LONG[:-2000]]))
    shared = [f"s{i}" for i in range(60)]
    for i in range(30):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([20, 100, 400]))]
        for copy in range(rng.choice([1, 1, 3, 12])):
            changed = list(words)
            for _ in range(rng.randint(0, copy) * len(words) // 100):
                changed[rng.randrange(len(words))] = "edit"
            texts[len(texts)] = " ".join(changed + shared * (i % 3 == 0))
    docs = spark.createDataFrame([(i, t, "s", 0, "") for i, t in texts.items()], SCHEMA)
    wanted = similar_groups(texts)
    assert len(set(wanted.values())) < len(wanted)
    found = simhash.similar(docs, tree_nodes=tree_nodes).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == wanted
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(wanted.values()))


def test_similar_texts_with_repeats_and_short_ones(spark):
    texts = {}
    for i in range(40):
        line = " ".join(f"r{i}x{j}" for j in range(12))
        own = [f"o{i}x{j}" for j in range(250)]
        edited = [*own[:100], f"e{i}", *own[101:]]
        # At exactly 0.8 the bands themselves miss one pair in 1,300; none of these.
        short = [f"s{i}x{j}" for j in range(9)]
        for words in ([*own, *[line] * 40], [*edited, line], short, short[:8]):
            texts[len(texts)] = " ".join(words)
    wanted = similar_groups(texts)
    assert len(set(wanted.values())) == 80
    docs = spark.createDataFrame([(i, t, "s", 0, "") for i, t in texts.items()], SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()} == wanted


def test_similar_texts_of_odd_rows(docs):
    found = simhash.similar(docs).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(doc_id for doc_id, _, _ in ROWS)
    assert {r["component_id"] for r in found if r["doc_id"] in (1, 2, 7)} == {1}
    assert simhash.similar(docs.limit(0)).collect() == []


def test_chains_of_links_are_one_component(spark):
    prints = {i: sum(1 << b for b in range(2 * i, 2 * i + 2)) ^ ((1 << 2 * i) - 1) for i in range(25)}
    run = simhash.Run(spark, "test")
    frame = spark.createDataFrame([(p, i) for i, p in prints.items()], "fp bigint, id bigint")
    edges = simhash.links(run, frame, 2, 4)
    assert {r["component_id"] for r in simhash.components(run, edges, frame).collect()} == {0}


def test_simhash_of_odd_rows(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(doc_id for doc_id, _, _ in ROWS)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_quality_on_held_out_rows(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randint(0, 9)) for _ in range(80)]
        good = rng.random() < 0.7
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words[:5] * 16), "s", 0, ""))
        labels.append((i, int(good), 0))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality.classify(docs, marks).collect()}
    held = [i for i in found if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in found.items() if r["held_out"]} == set(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found.values())
    assert sum(found[i]["predicted"] == labels[i][1] for i in held) >= 0.97 * len(held)
    turned = spark.createDataFrame([(i, 1 - q if i in held else q, 0) for i, q, _ in labels], marks.schema)
    assert {r["doc_id"]: r["score"] for r in quality.classify(docs, turned).collect()} == {i: r["score"] for i, r in found.items()}
    assert quality.accepted(docs, marks).columns == docs.columns


def test_quality_of_odd_rows(spark, docs):
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert all(r["predicted"] == 1 for r in quality.classify(docs, marks).collect())
    assert quality.classify(docs.limit(0), marks).collect() == []


def test_quality_draws_from_each_class_by_hash(spark, monkeypatch):
    seen = []
    learn = quality.bradley_terry
    monkeypatch.setattr(quality, "bradley_terry", lambda x, good, weight: seen.append((good, weight)) or learn(x, good, weight))
    bad = lambda i: i % 100 == 7
    rows = [(i, "!! " * 9 if bad(i) else f"some plain words {i % 5}.", "s", 0, "") for i in range(6000)]
    marks = spark.createDataFrame([(i, 0 if bad(i) else 1, 0) for i in range(6000)], "doc_id bigint, quality int, toxic int")
    found = quality.classify(spark.createDataFrame(rows, SCHEMA), marks, sample=200).collect()
    (good, weight), = seen
    left = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 3 != 1]
    # The small class is seen whole, of the large one about as many as asked for, each for as many rows as it stands for.
    assert (~good).sum() == sum(map(bad, left)) and set(weight[~good]) == {1.0}
    assert 130 < good.sum() < 270 and weight[good].sum() == pytest.approx(sum(not bad(i) for i in left), rel=0.4)
    assert all(r["predicted"] == (not bad(r["doc_id"])) for r in found)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><a href=/>Home</a></nav>
<article><h1>Head &amp; line</h1><p>One <b>two<br>three<p>Four&nbsp;five</p><div class="comments"><p>me first</p></div></article>
<footer>&copy; site</footer></body></html>"""
BARE = "<div><span>Site name</span> of ours</div><p>Own text {0}</p><div>All rights <i>kept</i></div>"


def test_html_blocks():
    assert [t for t, _ in html_text.blocks(PAGE).blocks] == ["Head & line", "One two three", "Four five"]
    assert html_text.blocks(None) == html_text.blocks("") == html_text.Page([], [], [], [])
    assert [t for t, _ in html_text.blocks("a < b <i>c</i><!-- no --> d" + "<div>" * 3000 + "deep").blocks] == ["a < b c d", "deep"]
    assert [t for t, _ in html_text.blocks('<p title="a>b">x</p><form>f</form><p hidden>h</p><ul><li>1<li>2</ul>').blocks] == ["x", "1", "2"]
    assert html_text.host("HTTP://user@Ex.org:80/a?b#c") == "ex.org" and html_text.host(None) == ""


@pytest.mark.parametrize("name", ['class="content-sidebar-wrap"', "class='has-sidebar'", 'id="page-with-menu"', 'class="comments-open"'])
def test_html_wrappers_named_after_something_else(name):
    text, teaser = "The text of this page has several words. " * 4, "<div class=related><article>Read this</article></div>"
    menu, more = "<div class=menu><a href=/>Home of all these pages</a> now</div>", "<div class=comments><p>me first</p></div>"
    for tag in ("article", "main", "div"):
        page = f"<body><div {name}><{tag}><p>{text}</p></{tag}>{teaser if tag != 'main' else ''}{more}</div>{menu}</body>"
        assert [t for t, _ in html_text.blocks(page).blocks] == [text.strip()]
        page = f"<body><div {name}><{tag}><p>{text}</p></{tag}>{more}</div>{menu}</body>"
        assert [t for t, _ in html_text.blocks(page).blocks] == [text.strip()]
    far = f"<div class='has-sidebar'><article>{text}</article></div><div>{text + text[:40]}</div>"
    assert [t for t, _ in html_text.blocks(far).blocks] == [text.strip()]


def test_html_formulas_and_unclosed_elements():
    said = lambda page: [t for t, _ in html_text.blocks(page).blocks]
    assert said("<article><p>As <math><mi>a</mi><mo>=</mo><mn>2</mn></math> holds</p><math/><p>so</p></article>") == ["As a=2 holds", "so"]
    for tag in ("svg", "noscript", "iframe", "template", "textarea", "xmp"):
        assert said(f"<p>one</p><{tag} id=x><p>two</p><{tag}><p>three</p>") == ["one", "two", "three"]
        assert said(f"<p>one</p><{tag}>no</{tag}><p>two</p>") == ["one", "two"]
    assert said("<p>one</p><script>var two;<p>three</p>") == said("<p>one</p><style>two<p>three</p>") == ["one"]


def test_recurring_subtrees_go_by_host(spark):
    rows = [(i, f"http://a.org/{i}", BARE.format(i), 0) for i in range(20)] + [(50, "http://b.org/", BARE.format(1), 0)]
    rows += [(60, None, None, 0), (61, "http://a.org/x", "", 0), (62, "http://a.org/y", PAGE, 0), (0, "http://a.org/0", BARE.format(0), 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    found = html_text.main_text(pages).collect()
    texts = {r["page_id"]: r["text"] for r in found}
    assert len(found) == len(rows)
    assert all(texts[i] == f"Own text {i}" for i in range(20))
    assert texts[50] == "Site name of ours\n\nOwn text 1\n\nAll rights kept"
    assert texts[60] == texts[61] == "" and texts[62].startswith("Head & line\n\n")
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert html_text.main_text(pages.limit(0)).collect() == []


def test_articles_keep_what_is_named_like_something_else():
    inside = (
        "<h2 id='related-work'>Related work</h2><section id='search'><p>Search for it</p></section><p class='alert-levels'>Levels</p>"
        "<h3 id=navigation>Navigation</h3><div class='menu-planning'>Plans</div><p class='notice'>Mind the gap</p>"
    )
    gone = "<div class='ad box'>Buy</div><div class=comments><p>me first</p></div><section id=comments>me too</section><ul class=share><li>x</ul>"
    page = f"<article><h1 id=menu>Title</h1>{inside}{gone}</article>"
    assert [t for t, _ in html_text.blocks(page).blocks] == [
        "Title", "Related work", "Search for it", "Levels", "Navigation", "Plans", "Mind the gap",
    ]


def test_template_goes_by_recurrence_alone(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(n))
    rows, own = [], {}
    for i in range(40):
        text = [words(30), words(40), f"Answer {i % 8} of many"]
        own[i] = "\n\n".join([f"Title {i}", "Summary", *text])
        body = f"<h1>Title {i}</h1><h2>Summary</h2>" + "".join(f"<p>{t}</p>" for t in text)
        menu = "<div class=x1><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></div>"
        advert, foot = "<div class=x2>Buy <b>this</b> today</div>", "<div class=x3>All rights kept</div>"
        page = f"<article>{body}{advert}</article>" if i % 2 else f"<div><div>{body}</div>{advert}</div>"
        rows.append((i, f"http://a.org/{i}", f"<body>{menu}{page}{foot}</body>"))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r["page_id"]: r["text"] for r in html_text.main_text(pages, names=False).collect()}
    for i, text in own.items():
        # Without a marked article nothing tells a heading that is on all pages from template.
        kept = text if i % 2 else text.replace("\n\nSummary", "")
        assert found[i] == kept
    # The counts that decide, by brute force.
    parsed = {i: html_text.blocks(page, False) for i, _, page in rows}
    counts = Counter(h for page in parsed.values() for h in set(page.hashes))
    assert max(counts.values()) == 40
    for i, page in parsed.items():
        gone = {h for h, how in zip(page.hashes, page.removals, strict=True) if how != html_text.BESIDE and counts[h] >= 8}
        assert "\n\n".join(html_text.left_over(page, gone)) == found[i]


def test_hostile_pages_take_time_by_their_size():
    for page in ("<div>x" * 100_000, "<p><b><i>" * 50_000 + "</u>" * 50_000, "<ul><li>a" * 40_000, "<article>" + "<p>word " * 300_000, "a<b" * 1000 + "x" * 3_000_000):
        started = time.process_time()
        found = html_text.blocks(page)
        assert len(found.hashes) == len(found.parents) <= 300_000
        assert time.process_time() - started < 30
    assert len(found.blocks) == 1


def test_given_pages_have_subtrees_that_recur(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = html_text.parsed(pages, True)
    assert rows.selectExpr("min(size(hashes)) AS n").first()["n"] > 5


def test_template_of_a_section_goes_on_large_hosts(spark):
    notice = "<div>Terms of this section <i>apply</i></div>"
    rows = [(i, f"http://a.org/{i}", f"<p>Own text {i}</p>{notice if i < 20 else ''}") for i in range(1500)]
    found = html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert all(r["text"] == f"Own text {r['page_id']}" for r in found)


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    rows = {name: None for name, _ in corpus_pipeline.STAGES}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = simhash.Run(spark, "stage").table(stage(spark, docs, folder), name)
        assert docs.columns == columns
        rows[name] = docs.count()
    assert 0 < rows["near_dedup"] <= rows["exact_dedup"] <= rows["quality"]
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
