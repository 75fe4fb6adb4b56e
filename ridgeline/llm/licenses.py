"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

Tokens are ordered by how many documents of the whole corpus hold them, rarest first. A block can reach a template's
containment threshold only if it holds one of the template's rarest tokens (prefix filter), has enough tokens (length
filter), and has enough left behind the first match (positional filter); what passes is counted exactly. Templates
and their index are a fixed, small table; the corpus is read twice, and nothing else is shuffled than token counts.

Blocks are windows of words of the whole text, whatever its lines. A template is compared with windows of the smallest
power of two (LEAST_BLOCK at least) that is twice its words or more; they move by half their width, so any passage of
the template's length is whole in one of them. A short template names the tokens that tell its license from others: a
block without these isn't that license, however much of the rest it holds.

Defined results: a null text counts as empty; a text without words has no labels and score 0; repeated rows are
repeated; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Share of a template's distinct tokens that a block must hold.
CONTAINMENT = 0.8
#: Words of the smallest blocks.
LEAST_BLOCK = 16

#: Phrases and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: Labels, the tokens that tell them apart, and the wording of license notices.
TEMPLATES = [
    ("gpl", "gnu", "this work is licensed under the gnu general public license"),
    ("gpl", "gnu", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    (
        "gpl",
        "gnu",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    ("apache", "apache", "licensed under the apache license version 2 0"),
    (
        "apache",
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    ("mit", "mit", "released under the mit license"),
    ("mit", "", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    (
        "mit",
        "",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    ("cc-by", "creative commons attribution", "licensed under the creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "commons noncommercial", "licensed under the creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "cc sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "commons sharealike", "licensed under the creative commons attribution sharealike 4 0 international license"),
    ("cc0", "cc0", "creative commons cc0 1 0 universal public domain dedication"),
    ("bsd", "", "redistribution and use in source and binary forms with or without modification are permitted"),
    (
        "bsd",
        "",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    ("mpl", "mozilla", "subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("isc", "", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("proprietary", "copyright reserved", "copyright all rights reserved"),
]

#: Words are runs of ASCII digits, letters and whatever isn't ASCII; everything else becomes a space.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def places(words: list[bytes]) -> dict[str, list[int]]:
    """For each phrase's label, the words at which it starts."""
    line, found = b" " + b" ".join(words) + b" ", {}
    for phrase, label in PHRASES:
        key = f" {phrase} ".encode()
        at, seen, count = line.find(key), 0, 0
        while at >= 0:
            count += line.count(b" ", seen, at)
            seen = at
            found.setdefault(label, []).append(count)
            at = line.find(key, at + 1)
    return found


def block_of(words: int) -> int:
    """Width of the windows that a template of so many words is compared with."""
    return max(LEAST_BLOCK, 1 << (2 * words - 1).bit_length())


def windows(words: list[bytes], width: int) -> Iterator[list[bytes]]:
    for start in range(0, max(1, len(words) - width // 2), width // 2):
        yield words[start : start + width]


class TemplateIndex:
    """Templates' tokens in global order, and for each width of blocks an inverted index of the prefixes of its templates."""

    def __init__(self, frequency: dict[str, int], containment: float = CONTAINMENT, templates=None):
        found = [(label, telling.encode().split(), text.encode().split()) for label, telling, text in (TEMPLATES if templates is None else templates)]
        order = sorted({t for _, _, words in found for t in words}, key=lambda t: (frequency.get(t.decode(), 0), t))
        self.rank = {t: i for i, t in enumerate(order)}
        self.templates: list[tuple[str, frozenset[bytes], frozenset[bytes], int]] = []  # label, tokens, telling tokens, how many are needed
        self.prefixes: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        for k, (label, telling, words) in enumerate(found):
            ordered = sorted(set(words), key=self.rank.__getitem__)
            need = -int(-containment * len(ordered) // 1)
            self.templates.append((label, frozenset(ordered), frozenset(telling), need))
            own = self.prefixes.setdefault(block_of(len(words)), {})
            for i, token in enumerate(ordered[: len(ordered) - need + 1]):
                own.setdefault(token, []).append((k, i))

    def matches(self, block: list[bytes], width: int) -> dict[int, float]:
        """Containment of each template of blocks of this width that meets the threshold in the block."""
        prefixes = self.prefixes[width]
        held = set(block)
        if prefixes.keys().isdisjoint(held):
            return {}
        ordered = sorted(self.rank.keys() & held, key=self.rank.__getitem__)
        seen, out = set(), {}
        for j, token in enumerate(ordered):
            for k, i in prefixes.get(token, ()):
                if k in seen:
                    continue
                seen.add(k)
                _, tokens, telling, need = self.templates[k]
                if len(ordered) < need or 1 + min(len(tokens) - i - 1, len(ordered) - j - 1) < need:
                    continue
                both = len(tokens.intersection(ordered))
                if both >= need and telling <= held:
                    out[k] = both / len(tokens)
        return out

    def found_in(self, words: list[bytes]) -> dict[str, float]:
        """The labels of all blocks of a text, each with its largest containment."""
        out: dict[str, float] = {}
        held = set(words)
        for width, prefixes in self.prefixes.items():
            if prefixes.keys().isdisjoint(held):
                continue
            for block in windows(words, width):
                for k, share in self.matches(block, width).items():
                    label = self.templates[k][0]
                    out[label] = max(share, out.get(label, 0.0))
        return out


def token_counts(docs: DataFrame) -> dict[str, int]:
    """In how many documents each token of the templates stands, over all documents; the table is as small as the templates."""
    wanted = frozenset(w.encode() for _, _, text in TEMPLATES for w in text.split())
    schema = pa.schema([("token", pa.string()), ("n", pa.int64())])

    def count(parts):
        found: Counter = Counter()
        for part in parts:
            for text in part.column(0):
                found.update(wanted.intersection(words_of(text.as_py())))
        yield from common.batches(((t.decode(), n) for t, n in found.items()), schema)

    made = common.arrow_map(docs.select(common.text_bytes().alias("text")), count, "token string, n long")
    return {r.token: r.n for r in made.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row; score is 1 for a phrase, else the largest containment that meets the threshold, else 0."""
    index = TemplateIndex(token_counts(docs), containment)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    )

    def row(doc_id, text):
        words = words_of(text)
        base = places(words)
        starts = [i for found in base.values() for i in found]
        shares = index.found_in(words)
        labels, score = {*base, *shares}, 1.0 if base else max(shares.values(), default=0.0)
        return doc_id, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score

    def make(parts):
        yield from common.batches((row(d, t.as_py()) for part in parts for d, t in zip(part.column(0).to_pylist(), part.column(1))), schema)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text"))
    return common.arrow_map(found, make, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
