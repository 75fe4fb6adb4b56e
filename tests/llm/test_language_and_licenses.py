"""Language filters and license scans."""

import re
import zlib
from collections import Counter

import pytest

from ridgeline.llm import language, licenses

WORDS = {"en": "the quick brown fox and lazy dog that was with them for what should", "de": "der schnelle braune fuchs und faule hund nicht ist mit ihnen für über", "fr": "le rapide renard brun et chien paresseux était avec eux pour où été"}


def texts(n):
    import random

    rng = random.Random(n)
    out = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        out.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(8, 40))), lang))
    return out


def test_trigrams_across_chunks_are_those_of_the_whole(monkeypatch):
    import numpy as np

    text = "Aé b\U0001F600c  Ünd x9z. \U00020000"
    whole = np.concatenate(list(language.trigrams(text)))
    monkeypatch.setattr(language, "CHUNK", 3)
    assert np.concatenate(list(language.trigrams(text))).tolist() == whole.tolist()
    letters = [" ", *(c.lower() if c.isalpha() else " " for c in text), " "]
    code = lambda c: 0 if c == " " else ord(c)
    want = [code(a) << 42 | code(b) << 21 | code(c) for a, b, c in zip(letters, letters[1:], letters[2:]) if b != " "]
    assert whole.tolist() == want


def test_filter_returns_every_language_that_holds_an_ngram():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = {f"l{i:02d}": rng.integers(0, 1 << 60, 300).tolist() for i in range(70)}  # more than a word of bits
    made = language.LanguageFilter(sets)
    for i, name in enumerate(made.names):
        where = made.positions(np.array(sets[name], dtype=np.int64))
        plane = made.slices[i // 64]
        held = plane[where[0]] & plane[where[1]] & plane[where[2]]
        assert (held >> np.uint64(i % 64) & np.uint64(1)).all()
    assert made.false.max() < 0.01


def test_predicts_held_out_rows_and_defines_odd_ones(spark):
    odd = [(1001, None, "en"), (1002, "", "de"), (1003, "12 !?", "fr"), (1004, "the dog", None), (None, "der hund", "de"), (1006, "le renard " * 30_000, "fr")]
    rows = [*texts(240), *odd]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, score int")
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in texts(240))
    assert sum(by[i].lang_pred == lang for i, _, lang in texts(240) if by[i].held_out) >= 0.98 * sum(by[i].held_out for i in range(240))
    assert [(by[i].lang_pred, by[i].score) for i in (1001, 1002, 1003)] == [("und", 0.0)] * 3
    assert (by[1004].lang_pred, by[None].lang_pred, by[1006].lang_pred) == ("en", "de", "fr") and all(0 <= r.score <= 1 for r in got)
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(by) - {1001, 1002, 1003}
    assert language.identify(docs.limit(0)).count() == 0
    untaught = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {(r.lang_pred, r.score) for r in language.identify(untaught).collect()} == {("und", 0.0)}
    assert language.keep_known(untaught).count() == len(rows)


def brute_grams(text):
    """Trigrams around each letter, lower case, gaps for what isn't one."""
    folded = [" ", *(c.lower()[0] if c.isalpha() else " " for c in text or ""), " "]
    return ["".join(g) for g in zip(folded, folded[1:], folded[2:]) if g[1] != " "]


def test_predictions_equal_plain_sets_but_for_the_filters_false_positives(spark):
    rows = [*texts(400), (500, "Zwölf und über", None), (505, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {lang: Counter() for lang in WORDS}
    for i, t, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 5:
            counts[lang].update(brute_grams(t))
    shares = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    sets = {lang: {g for g, s in own.items() if s >= 2e-5 and s >= 0.1 * max(o.get(g, 0) for o in shares.values())} for lang, own in shares.items()}
    by = {i: t for i, t, _ in rows}
    for r in language.identify(docs).collect():
        grams = brute_grams(by[r.doc_id])
        found = {lang: sum(g in own for g in grams) / len(grams) for lang, own in sets.items()}
        best = max(found.values())
        assert r.score == pytest.approx(best, abs=0.03)
        assert found[r.lang_pred] >= best - 0.03


def test_texts_in_a_language_that_was_not_taught_go(spark):
    some = lambda t: " ".join("what should" if k % 4 == 0 else w for k, w in enumerate(t.split()))
    rows = [(i, some(t), None) if lang == "fr" else (i, t, lang) for i, t, lang in texts(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs.where(~language.held_out()))
    assert sum(model.predict(t)[1] >= 0.2 for _, t, lang in rows if lang is None) > 20  # hits alone don't tell
    assert {r.doc_id for r in language.keep_known(docs).collect()} == {i for i, _, lang in rows if lang}
    assert language.least_scores(docs.limit(0), model, 0.2) == {"de": 0.2, "en": 0.2}


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


TEXTS = [
    None,
    "",
    "...",
    "Released under the MIT License.",
    "x MIT\nlicense mit-license, MIT  LICENSE mit licenses",
    "Licensed under CC BY-NC 4.0. cc by cc by\nLicensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "é mit licenseß 9mit license gnu general public licence",
    "word " * 50_000 + "mit license",
    "Redistribution and use in source and binary forms, with or without\nmodification are permitted",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that",
    "copyright notice. all rights reserved",
]


def brute_labels(text):
    """Labels and their largest containment by plain sets over windows of the whole text's words; nothing of the operator is used but its templates."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shares = {}
    for label, telling, template in licenses.TEMPLATES:
        tokens, width = set(template.split()), 16
        while width < 2 * len(template.split()):
            width *= 2
        for start in range(0, len(words) + 1, width // 2):
            block = set(words[start : start + width])
            share = len(tokens & block) / len(tokens)
            if share >= 0.8 - 1e-12 and set(telling.split()) <= block:
                shares[label] = max(share, shares.get(label, 0))
    return shares


FULL = {label: template for label, _, template in licenses.TEMPLATES if len(template.split()) > 20}  # the last one of a label


def wrapped(text, width, mark):
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            lines.append(line)
            line = ""
        line += f"{w} "
    return ("\n" + mark).join([*lines, line])


def test_scan_equals_brute_force(spark):
    odd = TEXTS + [wrapped(t, 72, m) for t in FULL.values() for m in ("", "# ", " * ")] + ["licensed under cc by 4 0", "licensed under cc by nc sa 4 0", "this work is licensed under the mozilla public license", "released under the apache license"]
    odd += [" ".join(t.split()[: len(t.split()) * 3 // 4]) for t in FULL.values()]
    rows = [(i, t) for i, t in enumerate(odd)] + [(None, TEXTS[3]), (3, TEXTS[3])]
    docs = spark.createDataFrame([(*r, "l") for r in rows], "doc_id long, text string, labels string")
    got = sorted(licenses.scan(docs).collect(), key=repr)
    want = {i: (brute_base(t), brute_labels(t)) for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        base, shares = want[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base
        named = set(filter(None, base[4].split(",")))
        assert r.labels == ",".join(sorted(named | set(shares)))
        assert r.score == (1.0 if named else max(shares.values(), default=0.0))
    assert licenses.scan(docs.limit(0)).count() == 0
    labels = {r.doc_id: r.labels for r in got}
    assert labels[9] == labels[10] == "bsd" and labels[4] == "mit" and labels[11] == "proprietary"
    at = len(TEXTS) + 3 * len(FULL)
    assert [labels[at + i] for i in range(4)] == ["cc-by", "cc-by,cc-by-nc,cc-by-sa", "", "apache"]


@pytest.mark.parametrize("containment", [0.5, 0.8, 1.0])
def test_filters_lose_no_match(containment):
    import random

    rng = random.Random(2)
    vocabulary = sorted({w for _, _, t in licenses.TEMPLATES for w in t.split()})
    frequency = {w: rng.randint(0, 50) for w in vocabulary}
    index = licenses.TemplateIndex(frequency, containment)
    for _ in range(300):
        block = [w.encode() for w in rng.sample(vocabulary, rng.randint(0, len(vocabulary)))] + [b"other"] * rng.randint(0, 5)
        want = {}
        for k, (_, telling, template) in enumerate(licenses.TEMPLATES):
            tokens = {w.encode() for w in template.split()}
            share = len(tokens & set(block)) / len(tokens)
            if share >= containment - 1e-12 and {w.encode() for w in telling.split()} <= set(block):
                want[k] = share
        assert {k: v for width in index.prefixes for k, v in index.matches(block, width).items()} == want


NOTICES = [
    ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."),
    ("gpl", "you can redistribute it and/or modify\nit under the terms of the GNU General\nPublic License"),
    *((label, wrapped(t, 72, "")) for label, t in FULL.items()),
]


def test_notices_that_wrap_are_found_wherever_they_stand(spark):
    texts = [(label, "\n".join(f"w{k}" for k in range(before)) + "\n" + text.replace(" ", gap) + "\nafter" * 40) for label, text in NOTICES for before in (0, 20, 31, 50, 97, 333) for gap in (" ", "\n# ")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    for r in licenses.scan(docs).collect():
        label, text = texts[r.doc_id]
        assert label in r.labels.split(",") and r.score == 1.0
        assert set(r.labels.split(",")) == set(brute_labels(text)) | set(filter(None, r.base_labels.split(",")))
