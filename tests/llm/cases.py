"""Small inputs with every odd case, shared by the tests of the training-data operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, node string, key int, words string, line int, size int, n_removed long, class_id string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghiklmnoprstuvwz") for _ in range(rng.randint(2, 9))) for _ in range(n))


def edited(text: str, places: list[int]) -> str:
    words = text.split(" ")
    for p in places:
        words[p] = "changed" + str(p)
    return " ".join(words)


def odd_texts() -> list[tuple[int | None, str | None]]:
    long = prose(1, 20_000)
    base = prose(2, 120)
    return [
        (1, base),
        (2, base),
        (3, edited(base, [60])),
        (4, None),
        (5, ""),
        (6, ""),
        (7, "  \n\t "),
        (8, long),
        (9, edited(long, [100, 9000])),
        (10, "one two three"),
        (11, "One two  three"),
        (12, prose(3, 60) + "\n" + prose(4, 40) + "\n" + prose(3, 60)),
        (13, "tag | tag | tag ### $$$ " * 40),
        (14, "été 日本 \u00a0 word\x0bword\x0cword\r\nword " * 3),
        (15, "x" * 60_000),
        (16, prose(5, 300)),
        (16, prose(5, 300)),
        (None, prose(6, 80)),
        (None, base),
        (17, "This work is licensed under the GNU General Public License, version 3. All rights reserved. " + prose(7, 40)),
    ]


def odd_docs(spark, rows=None):
    rows = odd_texts() if rows is None else rows
    full = [(i, t, "en" if i else None, None if i == 7 else f"src{(i or 0) % 2}", None, "d", None, 1, "w", 2, 3, 4, "c") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)
