"""Small tables with every awkward case, and texts to plant in them."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, tid string, text_key string, row string, key string, _id string, n string, w string, h string, start string, copy string"
SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu".split()


def prose(seed: int, n: int, lines: int = 12) -> str:
    r = random.Random(seed)
    made = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return "".join(w + ("\n" if i % lines == lines - 1 else " ") for i, w in enumerate(made)).strip()


def edited(text: str, seed: int, edits: int) -> str:
    r, words = random.Random(seed), text.split(" ")
    for _ in range(edits):
        words[r.randrange(len(words))] = "edit" + str(r.randrange(10**6))
    return " ".join(words)


def awkward() -> list[tuple]:
    """Nulls in any column, empty and blank texts, a very long one, ties, repeated rows, one id with two texts."""
    base = prose(1, 120)
    passage = prose(2, 60)
    texts: list[tuple] = [
        (None, None), (None, prose(3, 30)), (1, None), (2, ""), (3, " \n\t \x0b\x0c"), (4, "one"), (5, "one two three"), (6, base), (7, base), (8, edited(base, 4, 2)),
        (9, edited(base, 5, 1)), (10, base), (10, base), (11, prose(6, 40)), (11, prose(7, 70)), (12, prose(8, 50) + "\n" + passage + " " + prose(9, 50)), (13, prose(10, 30) + " " + passage),
        (14, passage), (15, prose(11, 20_000)), (16, "x" * 50_000), (17, "É Ünï cödé ß ẞ İ K \U0001f600 " * 12), (18, "same same same same same same same same same same same same " * 9),
        (19, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3), (20, "\r\n".join(["a line of words here"] * 15)),
    ]
    out = []
    for i, (doc_id, text) in enumerate(texts):
        out.append((doc_id, text, [None, "en", "de", "xx"][i % 4], [None, "src0", "src1", "odd", "src0"][i % 5], None if i % 3 else 7, *["clash"] * 11))
    return out


def table(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
