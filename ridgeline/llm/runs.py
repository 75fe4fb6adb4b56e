"""Periodic runs of words: harmonic grid probing.

A run of period p and at least four periods covers three steps of the grid 0, p, 2p, ... at which the word at jp equals
that at (j + 1)p. All periods' grids have n H(n) points together, so they are probed for whole ranges of periods at once;
three equal steps in a row are a survivor, which is extended to both sides by comparing growing chunks of the text with
itself moved by p. Periods are taken in rising order, and a grid point within a found run whose period divides p is
skipped: what surrounds it is that run again. So a text of one repeated word costs its grid and no more.

A text is one row's work, whole, in its task; nothing is shuffled.

Defined results: a null text has no words, so no runs, and collapses to the empty text; a null doc_id counts as an empty
id; repeated rows are repeated; an empty table gives no rows; a very long text is probed in bounded pieces of its grid.
Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of the shortest run, and periods that a run has at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Grid points that are probed at a time, and the first and largest chunk that is compared.
PROBED, CHUNK, LARGEST_CHUNK = 1 << 20, 16, 1 << 16

COLUMNS = [("doc_id", "long"), ("n_runs", "long"), ("start", "long"), ("length", "long"), ("period", "long"), ("exponent_milli", "long"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]


def numbered(words: list[bytes]):
    """Words as whole numbers, equal if the words are."""
    import numpy as np

    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int32, count=len(words))


def survivors(ids, periods: int) -> Iterator[tuple[int, object]]:
    """(p, grid points jp at which three equal steps in a row start) of each period that has some, rising."""
    import numpy as np

    n, low = len(ids), 1
    while low <= periods:
        high, points = low, 0
        while high <= periods and (high == low or points + n // high <= PROBED):
            points += n // high
            high += 1
        p = np.arange(low, high)
        steps = (n - 1) // p  # of the grid of p
        ends = np.cumsum(steps)
        step = np.arange(int(ends[-1])) - np.repeat(ends - steps, steps)
        own = np.repeat(p, steps)
        at = step * own
        equal = ids[at] == ids[at + own]
        good = equal[:-2] & equal[1:-1] & equal[2:] & (own[:-2] == own[2:])
        places = np.flatnonzero(good)
        owners = own[places]
        bounds = np.flatnonzero(np.append(True, owners[1:] != owners[:-1])) if len(places) else []
        for a, b in zip(bounds, [*bounds[1:], len(places)] if len(places) else []):
            yield int(owners[a]), at[places[a:b]]
        low = high


def matching(ids, at: int, period: int) -> tuple[int, int]:
    """The largest stretch [low, high) around at of words that equal the one a period later, in chunks to both sides."""
    n, high, size = len(ids) - period, at, CHUNK
    while high < n:
        end = min(n, high + size)
        same = ids[high:end] == ids[high + period : end + period]
        if not same.all():
            high += int(same.argmin())
            break
        high, size = end, min(2 * size, LARGEST_CHUNK)
    low, size = at, CHUNK
    while low > 0:
        begin = max(0, low - size)
        same = ids[begin:low] == ids[begin + period : low + period]
        if not same.all():
            low -= int(same[::-1].argmin())
            break
        low, size = begin, min(2 * size, LARGEST_CHUNK)
    return low, high


def runs_of(ids, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period. least_periods is 4 or more: a run covers three steps of its grid."""
    import numpy as np

    if least_periods < 4:
        raise ValueError("a run of fewer than four periods may cover fewer than three steps of its grid")
    found: dict[int, tuple[list[int], list[int]]] = {}  # by period: starts and ends, rising
    spans: set[tuple[int, int]] = set()
    for p, points in survivors(ids, len(ids) // least_periods):
        for q, (starts, ends) in found.items():
            if p % q == 0 and len(points):
                k = np.searchsorted(starts, points, "right") - 1
                points = points[(k < 0) | (points + p >= np.array(ends)[k])]
        while len(points):
            low, high = matching(ids, int(points[0]), p)
            points = points[np.searchsorted(points, high) :]
            span = (low, high + p)
            if high + p - low >= max(least_words, least_periods * p) and span not in spans:
                spans.add(span)
                starts, ends = found.setdefault(p, ([], []))
                starts.append(low)
                ends.append(high + p)
    return sorted((s, e - s, p) for p, (starts, ends) in found.items() for s, e in zip(starts, ends))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the largest exact exponent; ties go to the smaller start, then the smaller period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    import numpy as np

    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int32)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    stays = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(stays).tolist()]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """A tenth of the documents, by the checksum of the id, repeat a stretch of their words to the end."""
    h, n = crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a : a + p] * (-(-(n - a) // p)))[: n - a]]


def row(doc_id: int | None, words: list[bytes]) -> tuple:
    runs = runs_of(numbered(words))
    start, length, period = strongest(runs) or (None, None, None)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
    return doc_id, len(runs), start, length, period, 1000 * length // period if runs else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(kept(words, runs))).hexdigest()


def collapse(docs: DataFrame) -> DataFrame:
    """The rows of docs with text as it is without repetition, its words joined by single spaces where runs were cut; other texts stay as they are."""
    fields = docs.schema.fields
    place = [f.name for f in fields].index("text")

    def make(parts):
        for part in parts:
            texts = []
            for text in part.column(place):
                text = text.as_py()
                words = (text or "").encode().split()
                left = kept(words, runs_of(numbered(words)))
                texts.append(text if len(left) == len(words) else b" ".join(left).decode())
            yield part.set_column(place, part.schema.field(place), pa.array(texts, part.schema.field(place).type))

    common.small_batches(docs.sparkSession)
    return docs.mapInArrow(make, common.nullable(docs.schema))


def detect(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id, n_runs, the strongest run, and digests of all runs and of the text without them, of each row. plant: first let a tenth of the documents repeat themselves (planted())."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in COLUMNS])

    def rows(parts):
        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                words = text.as_py().split()  # bytes: at the six ASCII spaces
                yield row(doc_id, planted(words, doc_id) if plant else words)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text"))
    return common.arrow_map(found, lambda parts: common.batches(rows(parts), schema), ", ".join(f"{name} {kind}" for name, kind in COLUMNS))
