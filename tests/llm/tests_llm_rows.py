"""Rows with every oddity that the operators promise to handle."""

import re

SCHEMA = "doc_id bigint, text string, source string, length int, fingerprint string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [
    (1, "one two three four five six", "b"), (2, "one  two\tthree\nfour five six", "b"), (3, None, "a"), (4, "", None),
    (5, "x", "a"), (5, "x", "a"), (6, LONG, "b"), (7, "one two three four five six", None), (None, "lost id", "c"),
    (9, "été \U0001f600 fin", "c"),
]
ODD = [
    "", "  ", " a", "a ", "a\n\n b  c\t d", "it's  don't 'll x's 's", "x <|endoftext|> y", "é ́a  b", "a\xa0b \xa0 c",
    "ΑΣ ΣΑ Σ.", "1 2  34 5", "  a  b\x1c c \x85 d", "日本 語  x", "x İstanbul ́ y",
    "Ends. here, and: there!? (so) a.b ...", LONG[:3000],
]
