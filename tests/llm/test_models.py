"""Classifiers by held-out accuracy, surrogates by their properties, packing by an exact round trip, and the pipeline."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pricetide.llm import decontaminate, labelled, language, minhash, packing, pii, toxicity
from tests.llm.common import AWKWARD, by_id, documents, prose

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SYLLABLES = {"en": "the ing ou th wh er", "de": "sch ung ä ü ein keit", "fr": "eau é è ou oi eux", "es": "ción ñ ado que os ez"}


def sentence(lang: str, seed: int, n: int) -> str:
    rng, parts = random.Random(f"{lang}{seed}"), SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language(spark):
    rows = [(i, sentence(lang, i, 8 + i % 40), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    unlabelled = [(1000, sentence("fr", 5, 30), None), (1001, "12 + 34 = 46!", None)]
    every = rows + unlabelled + [(d, t, None) for d, t in AWKWARD]
    got = by_id(language.identify(documents(spark, every)))
    assert sum(map(len, got.values())) == len(every)
    held = [(lang, got[i][0]) for i, _, lang in rows if got[i][0]["held_out"]]
    assert len(held) > 20 and sum(lang == r["lang_pred"] for lang, r in held) >= 0.97 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, rs in got.items() if i is not None for r in rs)
    assert got[1000][0]["lang_pred"] == "fr" and {got[i][0]["lang_pred"] for i in (900, 901, 902, 1001)} == {"und"}
    assert all(0 <= r["score"] <= 1 for rs in got.values() for r in rs)


def test_language_with_nothing_to_learn(spark):
    got = by_id(language.identify(documents(spark, [(1, "words", None), (5, None, None)])))
    assert got[1][0]["lang_pred"] == "und" and got[1][0]["score"] == 0
    assert language.identify(documents(spark, [])).count() == 0


def test_temperature_finds_the_scale():
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(4000, 3)) * 2
    labels = [int(rng.choice(3, p=language.softmax(s))) for s in scores]
    assert 0.8 < language.temperature(list(scores), labels) < 1.25
    assert 2.4 < language.temperature(list(scores * 3), labels) < 3.8


def toxic_rows():
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        words = prose(i, 40 + i % 90).split()
        toxic = i % 3 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["IDIOT", "scum,", "moron"]))
        if i % 4 == 0 or toxic and i % 2:  # one group is named more in toxic rows
            words.insert(3, "women" if toxic else rng.choice(["women", "men"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity(spark):
    rows, labels = toxic_rows()
    labels += [(0, 1, 0), (5000, 1, None), (None, 1, 1)]  # a second label, one without value, one without id
    neutral = [(2001, "the women walked home with w1 w2 w3"), (2002, "the men walked home with w1 w2 w3")]
    every = rows + neutral + AWKWARD
    got = by_id(toxicity.classify(documents(spark, every), label_table(spark, labels)))
    assert sum(map(len, got.values())) == len(every)
    held = [r for i, rs in got.items() for r in rs if r["held_out"] and i is not None and i < 600]
    assert len(held) > 80 and sum((r["doc_id"] % 3 == 0) == (r["predicted"] == 1) for r in held) >= 0.97 * len(held)
    assert got[2001][0]["predicted"] == got[2002][0]["predicted"] == 0
    assert abs(got[2001][0]["score"] - got[2002][0]["score"]) < 0.1
    assert all(r["predicted"] == 0 and 0 <= r["score"] <= 1 for i in (900, 901, 902, 905) for r in got[i])


def test_counterfactual_penalty_shrinks_the_gap(spark, monkeypatch):
    rows, labels = toxic_rows()
    docs, table = documents(spark, rows).select("doc_id", "text"), label_table(spark, labels)
    kept, sampled = toxicity.selected(toxicity.labelled_features(docs, table, 6000))
    gaps = []
    for weight in (0.0, 4.0):
        monkeypatch.setattr(toxicity, "COUNTERFACTUAL", weight)
        w, _ = toxicity.fit(kept, sampled)
        of = dict(zip(kept.tolist(), w.tolist()))
        a, b = (toxicity.features([x])[0].tolist() for x in ("women", "men"))
        gaps.append(abs(sum(of.get(f, 0) for f in a) - sum(of.get(f, 0) for f in b)))
    assert gaps[0] > 0.05 and gaps[1] < 0.5 * gaps[0]


def test_toxicity_without_both_labels(spark):
    got = by_id(toxicity.classify(documents(spark, [(1, "scum"), (2, None)]), label_table(spark, [(1, 1, 1)])))
    assert got[1][0]["score"] == 0 and got[2][0]["predicted"] == 0
    assert toxicity.classify(documents(spark, []), label_table(spark, [])).count() == 0


def test_sample_takes_small_classes_whole(spark):
    rows = spark.range(4000).selectExpr("id as doc_id", "if(id < 40, 1, 0) as toxic")
    got = {r["toxic"]: r["n"] for r in labelled.sample(rows, "toxic", 100, "x").groupBy("toxic").agg(labelled.F.count("*").alias("n")).collect()}
    assert got[1] == 40 and 50 < got[0] < 170


def test_sample_is_bounded_whatever_the_ids_and_labels(spark):
    """A third of the rows under one id that is drawn, and thousands of labels."""
    rows = spark.range(9000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "'en' as lang", "concat('t', id % 5) as text")
    hot = [labelled.sample(rows.withColumn("doc_id", labelled.F.when(labelled.F.col("doc_id") == 7, n).otherwise(labelled.F.col("doc_id"))), "lang", 100, "x").count()
           for n in (12_000, 12_001, 12_002, 12_003)]
    assert max(hot) <= 200 and min(hot) > 30
    many = spark.range(5000).selectExpr("id as doc_id", "concat('l', id % 2500) as lang", "'t' as text").union(rows)
    drawn = labelled.sample(many, "lang", 100, "x", ("doc_id", "text"))
    assert drawn.select("lang").distinct().count() == labelled.LABELS and drawn.filter("lang = 'en'").count() <= 200


def test_toxicity_takes_one_text_of_an_id(spark):
    rows, labels = toxic_rows()
    repeated = documents(spark, rows + [(rows[0][0], f"{t} again") for _, t in rows]).select("doc_id", "text")
    assert toxicity.labelled_features(repeated, label_table(spark, labels), 50).groupBy("doc_id").count().filter("count > 1").count() == 0


PII = ("Bob.Lee42@Mail6.example.com bob.lee42@mail6.example.com eve@acme.co.uk +1 (456) 555-2186, 456-555-2186 4337166598464399 "
       "42.144.35.254 192.168.7.9 123-45-6789 Mrs Maria Schmidt and James Müller. Maria and Schmidt. Анна Петрова. version 2.0 on 2024-05-17, 1234567890123456")


def test_surrogates_keep_type_and_coreference():
    text, done = pii.replace(PII, b"key")
    kinds = collections.Counter(k for _, _, k, *_ in done)
    assert kinds == {"email": 3, "phone": 2, "card": 1, "ip": 2, "ssn": 1, "first": 4, "last": 4}
    for a, b, kind, old, new in done:
        assert PII[a:b] == old and old.casefold() != new.casefold()
        if kind not in ("first", "last"):
            assert re.sub(r"\d", "9", re.sub(r"[a-z]", "a", re.sub("[A-Z]", "A", old))) == re.sub(
                r"\d", "9", re.sub(r"[a-z]", "a", re.sub("[A-Z]", "A", new))) or kind == "ip"
        if kind == "card":
            assert pii.luhn_digit(new[:-1]) == new[-1] and new[0] == old[0]
    new = {o: n for *_, o, n in done}
    assert new["Bob.Lee42@Mail6.example.com"].lower() == new["bob.lee42@mail6.example.com"]
    assert pii._digits(new["+1 (456) 555-2186"])[1:] == pii._digits(new["456-555-2186"])
    assert new["192.168.7.9"].startswith("192.168.")
    assert new["Maria"] in pii.FIRST_NAMES["latin", "f"] and new["Анна"] in pii.FIRST_NAMES["cyrillic", "f"] and new["James"] in pii.FIRST_NAMES["latin", "m"]
    assert re.fullmatch("[а-яА-Я]+", new["Петрова"])
    assert "version 2.0 on 2024-05-17, 1234567890123456" in text
    assert pii.replace(PII, b"key")[0] == text != pii.replace(PII, b"other")[0]


@pytest.mark.parametrize("pool", pii.FIRST_NAMES)
def test_no_surrogate_is_taken_twice(pool):
    """A text with every first name of a pool: one surrogate each, none of them another person's name."""
    names = pii.FIRST_NAMES[pool]
    text = " ".join(f"{n} {n[0]}{n[1:]}son{chr(97 + i)}, later {n}." for i, n in enumerate(names))
    new, done = pii.replace(text, b"k")
    of = collections.defaultdict(set)
    for *_, kind, old, surrogate in done:
        if kind == "first":
            of[old].add(surrogate)
    assert set(of) == set(names) and all(len(x) == 1 for x in of.values())
    taken = {x for xs in of.values() for x in xs}
    assert len(taken) == len(names) and not taken & set(names)
    assert all(x[0].isupper() and x.isalpha() for x in taken)
    assert pii.replace(text, b"k")[0] == new


def test_short_formats_are_widened():
    """All values of a short format in one text, so none of it is free."""
    addresses = [f"{c}@mail6.example.com" for c in "aeiou"] + ["_@mail6.example.com", "5@mail6.example.com"]
    ips = [f"192.168.{i // 256}.{i % 256}" for i in range(1500)]
    for values in (addresses, ips):
        _, done = pii.replace(" , ".join(values), b"k")
        new = [n for *_, n in done]
        assert [o for *_, o, _ in done] == values and len(set(new)) == len(values) and not set(new) & set(values)
    assert pii._ip("192.168.1.1", b"k", pii.DRAWS).startswith("10.")


PHONES = {
    "en": ["+14155552671", "4155552671", "+1 (456) 555-2186", "415/555-2671", "(415) 555-2671", "+44 20 7946 0958", "020 7946 0958"],
    "fr": ["+33 1 23 45 67 89", "+33123456789", "+33 (0)1 23 45 67 89", "01 23 45 67 89", "01.23.45.67.89", "0612345678", "0033 1 23 45 67 89"],
    "es": ["+34 612 34 56 78", "+34612345678", "612 34 56 78", "612 345 678", "91 234 56 78", "612345678"],
    "de": ["+49 (0)30 1234567", "+49 171 1234567", "+4915112345678", "0171/1234567", "030 123 45 67", "(030) 1234567", "+352 123456"],
}


@pytest.mark.parametrize("lang", PHONES)
def test_telephone_numbers_of_each_form(lang):
    around = {"en": "Call {} today.", "fr": "Appelez le {}, merci.", "es": "Llame al {}; gracias.", "de": "Telefon: {} (Büro)"}[lang]
    for number in PHONES[lang]:
        text, done = pii.replace(around.format(number), b"key")
        assert [(k, o) for _, _, k, o, _ in done] == [("phone", number)]
        assert number not in text and re.sub(r"\d", "9", text) == re.sub(r"\d", "9", around.format(number))
    joined = ", ".join(PHONES[lang])
    assert [v for *_, k, v in pii.entities(joined) if k == "phone"] == PHONES[lang]


def test_numbers_that_are_no_telephone_numbers():
    text = "on 2024-05-17 12:30 or 01.02.2024 12:30, 0.123456789 of 1700000000, id 0000123456, rows 10 20 30 40 50, 12345678"
    assert pii.entities(text) == []
    assert [k for *_, k, _ in pii.entities("+33 1 23 45 67 89 4337166598464399")] == ["phone", "card"]


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000, 4096])
def test_permutations(size):
    assert sorted(pii.permute(i, size, b"k", "t") for i in range(size)) == list(range(size))


def test_surrogates_stay_distinct():
    assert len({pii.permute_text(f"ab{i:03d}", b"k") for i in range(1000)}) == 1000
    assert len({pii._ip(f"10.0.{i // 256}.{i % 256}", b"k", 0) for i in range(2000)}) == 2000
    assert len({pii._phone(f"+1 ({200 + i // 50}) 555-{2000 + i}", b"k", 0) for i in range(800)}) == 800
    for names in pii.FIRST_NAMES.values():
        assert len({pii.first_name(n, b"k", 0) for n in names}) == len(names)
    # every first name of a pool in one text: no surrogate may be another original, so tweaks run out and distinctness holds
    text = " ".join(f"{n} Smith{chr(97 + i)}," for i, n in enumerate(pii.FIRST_NAMES["greek", "f"][:3]))
    done = pii.replace(text, b"k")[1]
    firsts = {o: n for *_, k, o, n in done if k == "first"}
    assert len(set(firsts.values())) == len(firsts) and not set(firsts) & set(firsts.values())


def test_pii_table(spark):
    rows = [(1, PII), (2, "nothing here"), (2, "nothing here"), *AWKWARD]
    got = by_id(pii.surrogates(documents(spark, rows), b"key"))
    assert sum(map(len, got.values())) == len(rows)
    assert got[1][0]["text"] == pii.replace(PII, b"key")[0] and got[1][0]["n_entities"] == 17
    assert got[900][0]["text"] is None and all(r["text"] == "nothing here" and r["n_entities"] == 0 for r in got[2])
    assert all(got[i][0]["text"] == t for i, t in AWKWARD if i is not None)
    docs = documents(spark, rows)
    new = pii.redacted(docs, b"key")
    assert new.schema.names == docs.schema.names and new.filter("doc_id = 1").first()["n_chars"] == len(got[1][0]["text"])
    assert pii.surrogates(documents(spark, [])).count() == 0


def pieces_of(rows, window=4096):
    tokenizer, out = Tokenizer.from_file(TOKENIZER), []
    for d, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out += [(d, s, len(p), zlib.crc32(np.array(p, "<u4").tobytes()), len(ids)) for s in range(0, len(ids), window) for p in [ids[s : s + window]]]
    return out


TEXTS = ["A!!, b.. c. d,e  it's IT'S <|ENDOFTEXT|> <|endoftext|>x É× ÷. 12.5, a,b.c n°. “q”. é É", "Straße,\x85x\x1cy ½ İstanbul ΣΑΣ.", "x,", ".", "ab12cd, ef."]


@pytest.mark.parametrize("lane", [16384, 8])
def test_packing(spark, lane):
    rows = [(i, prose(i, 1 + 37 * i % 2500)) for i in range(60)] + list(enumerate(TEXTS, 100)) + AWKWARD
    got = packing.pack(documents(spark, rows), TOKENIZER, lane_pieces=lane).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(pieces_of(rows), key=str)
    windows = collections.defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in windows.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.WINDOW
    assert packing.pack(documents(spark, []), TOKENIZER).count() == 0
    if lane > 100:
        assert len(windows) <= 1.05 * sum(r["length"] for r in got) / packing.WINDOW + 1


def test_repeated_rows_spread_over_lanes(spark):
    rows = [(None, "a row without id"), (5, "a row with an id")] * 1500 + [(100 + i, prose(i, 20)) for i in range(200)]
    got = packing.pack(documents(spark, rows), TOKENIZER, lane_pieces=100).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(pieces_of(rows), key=str)
    lanes = collections.Counter(r["sequence_id"] >> 32 for r in got)
    assert len(lanes) == 32 and max(lanes.values()) < 200


def test_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(30):
        lengths = sorted((rng.randrange(1, 65) for _ in range(80)), reverse=True)
        which, offsets = packing.place(lengths, 64)
        rooms: list[int] = []
        for n, w, offset in zip(lengths, which, offsets):
            fitting = [r for r in rooms if r >= n]
            if fitting:
                assert rooms[w] == min(fitting)
            else:
                assert w == len(rooms)
                rooms.append(64)
            assert offset == 64 - rooms[w]
            rooms[w] -= n


def test_pipeline(spark, tmp_path):
    rows, labels = toxic_rows()
    items = [(1, prose(70_001, 40)), (2, prose(70_002, 25))]
    rows += [(700 + i, prose(800, 120) + (" end" if i else "")) for i in range(4)] + [(710, "leak " + items[0][1] + " leak"), (711, PII)] + AWKWARD
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    label_table(spark, labels).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.schema.names == docs.schema.names
        out.write.parquet(str(tmp_path / "out" / name))
        docs = spark.read.parquet(str(tmp_path / "out" / name))
        seen[name] = docs
    ids = {n: collections.Counter(r["doc_id"] for r in d.select("doc_id").collect()) for n, d in seen.items()}
    all_ids = collections.Counter(d for d, *_ in rows)
    toxic = {d for d, *_ in rows if d is not None and d < 600 and d % 3 == 0}
    assert len(set(all_ids) - set(ids["toxicity"]) ^ toxic) <= 4 and not set(all_ids) - set(ids["toxicity"]) - toxic
    texts = dict(rows)
    left = [(d, texts[d]) for d in sorted(x for x in ids["toxicity"] if x is not None)]
    groups = minhash.near_duplicates(documents(spark, left)).filter("kept").collect()
    assert set(ids["near_duplicates"]) - {None} == {r["doc_id"] for r in groups} and 700 in ids["near_duplicates"] and 701 not in ids["near_duplicates"]
    assert set(ids["near_duplicates"]) - set(ids["decontamination"]) == {710}
    assert ids["pii"] == ids["decontamination"] and ids["pii"][907] == 1 and ids["pii"][None] == 1
    assert seen["pii"].filter("doc_id = 711").first()["text"] == pii.replace(PII, pii.DEFAULT_KEY)[0]
    kept = [(r["doc_id"], r["text"]) for r in seen["pii"].collect()]
    assert sorted((tuple(r)[:5] for r in seen["packing"].collect()), key=str) == sorted(pieces_of(kept), key=str)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, seen["packing"].collect()))
    assert decontaminate.OVERLAP == 13


def test_pipeline_decides_on_rows(spark, tmp_path):
    """Rows without id are examined, and texts that share an id are decided on their own."""
    item, base, other = prose(71_001, 30), prose(71_002, 120), prose(71_003, 90)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(50, base), (None, base), (None, base + " end"), (None, other), (None, other), (None, "start " + other), (None, "alone " + prose(71_004, 50)),
            (60, prose(71_005, 80)), (60, base + " tail"), (70, prose(71_006, 80)), (70, f"{prose(71_007, 20)} {item}"),
            (None, f"{prose(71_008, 20)} {item}"), (80, "equal row of one id " * 3), (80, "equal row of one id " * 3), (90, None), (91, ""), (None, ""), (None, None)]
    docs = documents(spark, rows)
    near = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert near.schema.names == docs.schema.names
    left = collections.Counter((r["doc_id"], r["text"]) for r in near.collect())
    want = collections.Counter(rows)
    for gone in ((None, base), (None, base + " end"), (60, base + " tail")):
        del want[gone]
    want[(80, "equal row of one id " * 3)] = 1
    lone = [r for r in ((None, other), (None, "start " + other)) if left[r]]
    assert len(lone) == 1 and left[lone[0]] == 1  # one of the group of rows without id
    for r in ((None, other), (None, "start " + other)):
        want.pop(r), left.pop(r, None)
    assert left == want
    clean = corpus_pipeline.drop_benchmark_leaks(spark, near, str(tmp_path))
    assert clean.schema.names == docs.schema.names
    assert collections.Counter((r["doc_id"], r["text"]) for r in clean.collect()) - want == collections.Counter({lone[0]: 1})
    assert not any(item in (r["text"] or "") for r in clean.collect()) and clean.filter("doc_id = 70").count() == 1
