"""Native scans against readings of their contracts in plain Python."""

from __future__ import annotations

import collections
import hashlib
import re

import pytest

from pricetide.llm import licenses, quality, secrets
from tests.llm.common import ALNUM, ASCII_LOWER, AWKWARD, SPACE, by_id, documents, prose

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def expected_secrets(text):
    t = text or ""
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    joined = ",".join(x for *_, x in sorted(found))
    return [sum(r == k for _, r, _ in found) for k in range(3)] + [hashlib.sha256(joined.encode()).hexdigest()]


SECRETS = [
    (1, 'x password = "abcdef" Token:abc API_KEY=\'a1/b2+c3==\' é secret=token: abcdefgh'), (2, "AKIA" + "A1" * 8 + " AKIASHORT AKIAAKIA" + "Z" * 16),
    (3, "ff " + "0123456789abcdef" * 2 + " é " + "a" * 23 + " " + "b" * 24), (4, "secret=short secret==" + "q" * 9 + "\npasswd\n=abcdefg"),
    (5, "ü" * 30 + " user=bob7 then Zq8kLmN2pQ5rT7vX9yB1 at https://db.example.com/x end"), (6, "lone Zq8kLmN2pQ5rT7vX9yB1 word"),
    (7, "login: alice at https://a.example.com only"), (8, "user=bob7 " + "far " * 100 + "Zq8kLmN2pQ5rT7vX9yB1"),
    (9, "token=" + "t" * 8 + " " * 150 + "AKIA" + "B" * 16 + " 10.0.0.7:5432"), (10, "api key: nothing"), (11, "tokentoken=secret=abcdefgh"),
]


def test_secrets(spark):
    rows = SECRETS + AWKWARD
    got = by_id(secrets.scan(documents(spark, rows)))
    for doc_id, text, *_ in rows:
        for r in got[doc_id]:
            assert [r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]] == expected_secrets(text), doc_id
    assert sum(map(len, got.values())) == len(rows)
    linked = {i: r[0]["spans"].count("random:") + r[0]["spans"].count("ident:") + r[0]["spans"].count("endpoint:") for i, r in got.items()}
    assert linked[5] == 3 and got[5][0]["n_linked"] == 3
    assert linked[6] == linked[7] == linked[8] == 0
    assert "endpoint:" in got[9][0]["spans"]
    assert secrets.scan(documents(spark, [])).count() == 0


def test_licenses(spark):
    rows = [
        (1, "Licensed under CC BY-NC 4.0.\n" + prose(1, 60)), (2, prose(2, 40) + "\nThis work is licensed under the GNU General Public License, version 3."),
        (3, "All rights reserved. All Rights\nRESERVED all rights"), (4, "Released under the MIT License. " + prose(3, 20)),
        (5, "version 2 of the apache web server, license to kill"), (6, "cc-by cc by"), (7, "Licensed under the Apache License, Version 2.0."), *AWKWARD,
    ]
    got = by_id(licenses.scan(documents(spark, rows)))
    for doc_id, text, *_ in rows:
        words = ALNUM.findall((text or "").translate(ASCII_LOWER))
        places, labels = [], set()
        for phrase, label in BASE.items():
            parts = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
            places += at
            labels |= {label} if at else set()
        for r in got[doc_id]:
            assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(sorted(labels))), doc_id
            assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
            assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    labels = {i: r[0]["labels"] for i, r in got.items()}
    assert labels[1] == "cc-by,cc-by-nc-4.0" and labels[2] == "gpl,gpl-3.0" and labels[4] == "mit" and labels[7] == "apache-2.0" and labels[5] == ""
    assert sum(map(len, got.values())) == len(rows)
    assert licenses.scan(documents(spark, [])).count() == 0


def test_licenses_of_files_with_many_notices(spark):
    """No notice is lost because of the others in the file."""
    of = {t.key: t.text for t in licenses.TEMPLATES}
    every = {t.label for t in licenses.TEMPLATES}
    some = ["apache license version 2", "mit license", "redistribution and use in source and binary forms", "gnu general public license version 3"]
    other = ["apache license version 2", "permission is hereby granted free of charge", some[2], "cc by 4 0"]
    rows = [(1, ". ".join(t.text for t in licenses.TEMPLATES)), (2, "\n".join(f"{prose(50 + i, 300)}\n{t.text}" for i, t in enumerate(licenses.TEMPLATES))),
            (3, ". ".join(of[k] for k in some)), (4, ". ".join(of[k] for k in other)), *[(10 + i, prose(i, 30)) for i in range(20)]]
    got = by_id(licenses.scan(documents(spark, rows)))
    labels = {i: set(r[0]["labels"].split(",")) for i, r in got.items()}
    assert labels[1] == labels[2] == every | {"gpl", "cc-by", "reserved"} and got[1][0]["score"] == 1
    assert labels[3] == {"apache-2.0", "mit", "bsd", "gpl-3.0", "gpl"} and labels[4] == {"apache-2.0", "mit", "bsd", "cc-by-4.0", "cc-by"}


def expected_quality(text):
    t = text or ""
    words = SPACE.findall(t)
    count = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, repeats = set(), 0
    for line in t.split("\n"):
        if SPACE.search(line):
            repeats += line in seen
            seen.add(line)
    out = [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), repeats, len(covered)]
    return [*out, len(words) < 50 or 100 * len(covered) > 50 * len(words)]


def test_quality(spark):
    good = [(i, prose(i, 200)) for i in range(40)]
    junk = [(100, " ".join("ZZ%&#" + str(i) for i in range(90))), (101, "la la la\nla la la\n\n \nla la la\n" + prose(7, 60)), (102, "a b c d a b c e\x0ba b"), (103, "a b"), (104, "a b c")]
    rows = good + junk + AWKWARD
    got = by_id(quality.score(documents(spark, rows)))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for doc_id, text, *_ in rows:
        for r in got[doc_id]:
            assert [r[n] for n in names] == expected_quality(text), doc_id
            assert not (r["base_failed"] and r["kept"])
    assert all(got[i][0]["kept"] for i, _ in good) and not got[100][0]["kept"]
    assert sum(map(len, got.values())) == len(rows)
    assert quality.score(documents(spark, [])).count() == 0


def test_quality_without_trusted_documents(spark):
    got = by_id(quality.score(documents(spark, [(1, "# " * 80), (2, None)])))
    assert not got[1][0]["kept"] and got[1][0]["score"] == 0


def test_parts_are_linked_by_the_gap_between_them(spark):
    """A long part does not push its complement out, and a value is random wherever its digit stands."""
    late = "x" * 60 + "7" + "y" * 9
    key = lambda gap: "user=bob7" + " ," * (gap // 2) + " " * (gap % 2) + late
    long_id = "user=" + "bob." * 150
    rows = [(1, key(200)), (2, key(201)), (3, long_id + " " * 190 + late), (4, long_id + " " * 210 + late), (5, late + " " * 150 + long_id), (6, late), (7, "user=bob7")]
    got = {d: r[0]["spans"] for d, r in by_id(secrets.scan(documents(spark, rows))).items()}
    spans = lambda text, *parts: ",".join(f"{k}:{text.index(p)}:{text.index(p) + len(p)}" for k, p in parts)
    texts = dict(rows)
    assert got[1] == spans(texts[1], ("ident", "user=bob7"), ("random", late)) and got[2] == got[4] == got[6] == got[7] == ""
    assert got[3] == spans(texts[3], ("ident", long_id), ("random", late)) and got[5] == spans(texts[5], ("random", late), ("ident", long_id))


@pytest.mark.parametrize("operator", [secrets.scan, licenses.scan, quality.score])
def test_no_python_on_the_path(spark, operator):
    plan = operator(documents(spark, [(1, "some words")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
