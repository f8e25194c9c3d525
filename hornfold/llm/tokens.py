"""Token ids of whole texts by the tokenizers library, with a memory of the words seen.

Both public vocabularies split a text at white space before they merge, so the ids of a text are
those of its parts, cut at every single space and before every single line feed. Arrow cuts the
texts and finds the distinct parts of a slice, so that Python sees each of them once; the ids of
the slice are then gathered from theirs. Most parts are a word of letters and closing marks, which
are remembered apart; words the vocabulary doesn't tell apart, as by case, count as one.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts and words each worker remembers, of both in either of two generations, so that frequent ones stay. A
#: generation passes it only by a slice with more distinct ones. Each takes some 200 bytes, and workers outlive tasks.
REMEMBERED = 200_000
#: Texts that are encoded together: so many bytes, or one that is longer.
SLICE_BYTES = 4 << 20
# Closing marks: both vocabularies cut them from letters. An apostrophe may begin a token with letters after it.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")
TOGETHER = 4096
# Latin letters: none of them joins another, or changes beside it, in any normal form.
LATIN = [chr(i) for i in range(0x250) if chr(i).isalpha()]

_encoders: dict[str, Encoder] = {}


def touches(part: str) -> bool:
    """Could this part, cut at single spaces or before a line feed, belong to white space beside it?"""
    body = part[1:] if part[:1] == "\n" else part
    return not body or body[0].isspace() or body[-1].isspace()


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in order, cut where the texts of a column add up to SLICE_BYTES."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(at, stop - at)
        at, before = stop, int(ends[stop - 1])


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def id_lists(found: list[bytes]) -> pa.ListArray:
    """Ids as bytes, 4 for each, as lists of ids."""
    ends = np.cumsum([0, *map(len, found)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<u4")))


class Encoder:
    """Ids as little-endian bytes, 4 for each id."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Strings of special tokens inside a text are ordinary text.
        self.tokenizer.encode_special_tokens = True
        self.marks: dict[str, bytes] = {}
        # Tokens that begin a word (with its space) or end one, as the vocabulary has it.
        words = sorted(self.tokenizer.get_vocab().items(), key=lambda item: item[1])
        self.begins = np.array([w.startswith("\u0120") for w, _ in words])
        self.ends = np.array([w.endswith("</w>") for w, _ in words])
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        self.spell()

    def pieces(self, text: str) -> list[str]:
        """What the library hands to its model for a text."""
        normalizer, splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        text = normalizer.normalize_str(text) if normalizer else text
        return [piece for piece, _ in splitter.pre_tokenize_str(text)] if splitter else [text]

    def spell(self) -> None:
        """How this vocabulary's model sees a word of letters, and what it sees of the space or line feed before it."""
        self.leads, images = {}, {}
        for lead in (" ", "\n"):
            *before, word = self.pieces(f"{lead}aa") or [""]
            self.leads[lead] = (b"".join(map(self.modelled, before)), word[:-2])
            for letter in LATIN:
                found = self.pieces(f"{lead}a{letter}a")
                image = found[-1][len(word) - 1 : -1] if found else ""
                whole = image and word[-2:] == "aa" and found == [*before, f"{word[:-1]}{image}a"]
                images.setdefault(letter, set()).add(image if whole else None)
        if not all(token.special for token in self.tokenizer.get_added_tokens_decoder().values()):
            images = {}  # an ordinary added token may be within a word
        sure = {letter: image for letter, found in images.items() for image in found if len(found) == 1 and image}
        self.one_case = bool(sure) and sure.get("A") == sure.get("a")
        if self.one_case:
            lower = dict(zip(sure, strings(pc.utf8_lower(pa.array(list(sure)))), strict=True))
            sure = {letter: image for letter, image in sure.items() if sure.get(lower[letter]) == image}
        self.letters_seen = "".join(sure)
        self.table = str.maketrans(sure)
        self.ascii_same = all(letter == image for letter, image in sure.items() if letter.isascii())

    def modelled(self, piece: str) -> bytes:
        return np.asarray([token.id for token in self.model.tokenize(piece)], "<u4").tobytes()

    def plain(self, parts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in encoded]

    def spaced(self, parts: list[str]) -> list[bytes]:
        """The ids of each part with a space before it: encoded in one text, told apart by offsets."""
        starts = np.cumsum([0] + [len(part) + 1 for part in parts])
        whole = self.tokenizer.encode(" " + " ".join(parts), add_special_tokens=False)
        ids = np.asarray(whole.ids, "<u4")
        offsets = np.array(whole.offsets, np.int64).reshape(-1, 2)[:, 0]
        # A token starts at its space or, where white space is dropped, behind it.
        cuts = np.searchsorted(offsets, starts).tolist()
        data = ids.tobytes()
        return [data[4 * i : 4 * j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def letters(self, parts: list[str], lead: str = " ") -> list[bytes]:
        """As ``spaced``, for parts of letters alone: each is one word, so its tokens show where it ends."""
        whole = self.tokenizer.encode_batch_fast([lead + lead.join(parts)], add_special_tokens=False)[0]
        ids = np.asarray(whole.ids, "<u4")
        if self.ends.any():
            cuts = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
        elif lead == " ":
            cuts = [*np.flatnonzero(self.begins[ids]).tolist(), len(ids)]
        else:  # a line feed is a token of its own
            cuts = [*np.flatnonzero(ids == ids[0]).tolist(), len(ids)]
        if len(cuts) != len(parts) + 1 or cuts[0] or cuts[-1] != len(ids):
            return self.spaced(parts) if lead == " " else self.plain([lead + part for part in parts])
        data = ids.tobytes()
        return [data[4 * i : 4 * j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text; those of an array's nulls are none."""
        # Millions of strings without a cycle among them: looking for cycles would take a fifth of the time.
        collecting = gc.isenabled()
        gc.disable()
        try:
            column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
            return self.gathered(pc.fill_null(column, "")) if len(column) else []
        finally:
            pa.default_memory_pool().release_unused()  # what the slice took, else the worker keeps it
            if collecting:
                gc.enable()

    def gathered(self, texts: pa.Array) -> list[bytes]:
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        starts = split.offsets.to_numpy().astype(np.int64)
        first = starts[:-1]  # the first parts have no space before them, and are as many as the texts
        inner = np.ones(starts[-1], bool)
        inner[first] = False
        heads = self.plain(strings(split.values.take(pa.array(first))))
        parts = split.values.filter(pa.array(inner)).dictionary_encode()
        ids, touching = self.distinct(parts.dictionary)
        codes = np.empty(len(inner), np.int64)
        codes[inner] = parts.indices.to_numpy(zero_copy_only=False)
        if touching.any():  # rare: a cut beside other white space isn't safe, so such a text is all in its first part
            unsafe = np.zeros(len(inner), bool)
            unsafe[inner] = touching[codes[inner]]
            unsafe = np.logical_or.reduceat(unsafe, first)
            rows = np.flatnonzero(unsafe)
            for row, whole in zip(rows.tolist(), self.recut(strings(texts.take(pa.array(rows)))), strict=True):
                heads[row] = whole
            codes[np.repeat(unsafe, np.diff(starts))] = len(ids) + len(heads)
        codes[first] = len(ids) + np.arange(len(heads))
        found = pa.concat_arrays([ids, id_lists([*heads, b""])]).take(pa.array(codes))
        ends = 4 * found.offsets.to_numpy().astype(np.int64)[starts]
        data = found.values.to_numpy().tobytes()
        return [data[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def recut(self, texts: list[str]) -> list[bytes]:
        """The ids of texts with other white space beside their cuts."""
        split = [SAFE_CUT.split(text) for text in texts]
        heads = [parts.pop(0) for parts in split]
        met = list(set().union(*split))
        look_up = dict(zip(met, self.others(met), strict=True)).__getitem__
        return [head + b"".join(map(look_up, parts)) for head, parts in zip(self.plain(heads), split, strict=True)]

    def distinct(self, parts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
        """The ids of distinct parts, with the space or line feed before them, and which parts touch white space."""
        stems = pc.utf8_rtrim(parts, characters=MARKS)
        marks = pc.utf8_ltrim(parts, characters=f"{self.letters_seen}\n")
        words = pc.utf8_ltrim(stems, characters="\n")
        # What is left of the marks is all letters, and what is right of the letters all marks.
        whole = pc.equal(pc.add(pc.binary_length(stems), pc.binary_length(marks)), pc.binary_length(parts))
        simple = pc.and_(whole, pc.greater(pc.binary_length(words), 0))
        words = (words if self.leads[" "] == self.leads["\n"] else stems).filter(simple)
        words = (pc.utf8_lower(words) if self.one_case else words).dictionary_encode()
        marks = marks.filter(simple).dictionary_encode()
        others = strings(parts.filter(pc.invert(simple)))
        # Each part is of two of these: a word and its marks, or any other part and nothing.
        known = self.recall(strings(words.dictionary))
        ended = self.closing(strings(marks.dictionary))
        simple = simple.to_numpy(zero_copy_only=False)
        touching = np.zeros(len(parts), bool)
        touching[~simple] = [touches(part) for part in others]
        halves = np.empty((len(parts), 2), np.int64)
        halves[simple, 0] = words.indices.to_numpy(zero_copy_only=False)
        halves[simple, 1] = len(known) + marks.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        halves[~simple, 0] = len(known) + len(ended) + np.arange(len(others))
        halves[~simple, 1] = len(known) + len(ended) + len(others)
        found = id_lists([*known, *ended, *self.others(others), b""]).take(pa.array(halves.ravel()))
        ends = found.offsets.take(pa.array(2 * np.arange(len(parts) + 1)))
        return pa.ListArray.from_arrays(ends, found.values), touching

    def recall(self, keys: list[str]) -> list[bytes]:
        """The ids of distinct words of letters, with what is before them; a word has its line feed where it matters."""
        if len(self.words) + len(keys) > REMEMBERED:
            self.old_words, self.words = self.words, {}
        words, old, tokenize = self.words, self.old_words, self.model.tokenize
        flat: list[int] = []
        fresh, ends = [], [0]
        for key in keys:
            if key in words:
                continue
            if key in old:
                words[key] = old[key]
                continue
            lead, word = ("\n", key[1:]) if key[0] == "\n" else (" ", key)
            before, prefix = self.leads[lead]
            if not (self.ascii_same and word.isascii()):
                word = word.translate(self.table)
            flat += [token.id for token in tokenize(prefix + word)]
            fresh.append((key, before))
            ends.append(len(flat))
        data = np.asarray(flat, "<u4").tobytes()
        for (key, before), i, j in zip(fresh, ends[:-1], ends[1:], strict=True):
            words[key] = before + data[4 * i : 4 * j]
        return [words[key] for key in keys]

    def closing(self, marks: list[str]) -> list[bytes]:
        """The ids of closing marks behind a word."""
        if len(self.marks) > REMEMBERED:
            self.marks = {}
        missing = [mark for mark in marks if mark not in self.marks]
        self.marks.update(zip(missing, self.plain(missing), strict=True))
        return [self.marks[mark] for mark in marks]

    def others(self, parts: list[str]) -> list[bytes]:
        """The ids of any distinct parts, with the space or line feed before them."""
        if len(self.new) + len(parts) > REMEMBERED:
            self.old, self.new = self.new, {}
        self.learn({part for part in parts if part not in self.new})
        return [self.new[part] for part in parts]

    def learn(self, missing: set[str]) -> None:
        """Ids of parts that aren't in the younger memory, from the older one or the library."""
        new, old = self.new, self.old
        # Words and their closing marks are learned apart, so that only the word is new.
        ended, words, lines, others = [], set(), set(), []
        for part in missing:
            if part in old:
                new[part] = old[part]
                continue
            body = part[1:] if part[0:1] == "\n" else part
            stem = body.rstrip(MARKS)
            if not stem.isalpha() or not stem.lower().isalpha():  # İ has a mark of its own in lower case
                others.append(part)
                continue
            if len(stem) < len(body):
                ended.append((part, body, stem))
                part = part[: len(part) - len(body) + len(stem)]
                if part in new:
                    continue
                if part in old:
                    new[part] = old[part]
                    continue
            (words if part is body or part[0] != "\n" else lines).add(stem)
        self.keep(list(words), "", self.letters)
        self.keep(list(lines), "\n", lambda parts: self.letters(parts, "\n"))
        # Parts with white space at an end may touch their neighbours: those are encoded alone.
        alone = [part for part in others if part[:1] == "\n" or touches(part)]
        spaced = [part for part in others if not (part[:1] == "\n" or touches(part))]
        self.keep(alone, "", lambda parts: self.plain([p if p[:1] == "\n" else f" {p}" for p in parts]))
        self.keep(spaced, "", self.spaced)
        for part, body, stem in ended:
            marks = body[len(stem) :]
            if marks not in self.marks:
                self.marks[marks] = self.plain([marks])[0]
            new[part] = new[part[: len(part) - len(marks)]] + self.marks[marks]

    def keep(self, parts: list[str], lead: str, how: Callable[[list[str]], list[bytes]]) -> None:
        for i in range(0, len(parts), TOGETHER):
            some = parts[i : i + TOGETHER]
            self.new.update(zip([lead + part for part in some] if lead else some, how(some), strict=True))


def encoder(path: str) -> Encoder:
    """This worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
