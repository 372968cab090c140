"""Small corpora with the awkward cases, and readers of results."""

from __future__ import annotations

import random
import re

SPACE = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: columns of the table, and others whose names operators use for their own results
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, words array<string>, score string, kept int, "
          "n int, found string, blob string, held_out string, toxic string, spans int, a string, b string")


def documents(spark, rows, lang="en"):
    """Rows of (doc_id, text) or (doc_id, text, lang) with clashing extra columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else lang, None, None, ["x"], "s", None, 1, "f", "b", "h", "t", 2, "a", "b") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    words = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    return " ".join(w + rng.choice(["", "", "", ",", "."]) for w in words)


AWKWARD = [
    (None, "a row without id " * 9), (900, None), (901, ""), (902, " \t\n "), (903, "one"), (904, "Größe ñandú Ünïcode слово 漢字"),
    (905, "same same same same same same " * 40), (906, prose(6, 30_000)), (907, "repeated row with some words in it"),
    (907, "repeated row with some words in it"), (908, "x" * 5000),
]


def by_id(frame):
    """Rows as dicts, by id in lists."""
    out = {}
    for r in frame.collect():
        out.setdefault(r["doc_id"], []).append(r.asDict())
    return out
