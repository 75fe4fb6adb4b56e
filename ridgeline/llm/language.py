"""Language identification by language-bitmask n-gram filters.

A language's set holds the letter trigrams that make up a fixed least share of its text, so a set's size is bounded
whatever the corpus. One Bloom filter holds all sets: it is sliced by bits, a position has one bit for each language,
and the AND of an n-gram's positions gives all languages that hold it. A text's hits by language, corrected for the
filter's false positives, decide.

The sets are learned from a sample of about SAMPLE labelled rows of each language, drawn by a hash of the id (all
rows, if a language has fewer); prediction reads whole texts only.

Defined results: a null text and a text without a letter are `und` with score 0; rows without lang teach nothing;
ties go to the first language by name; with nothing learned, all texts are `und`; repeated rows are repeated; an
empty table gives no rows.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
#: Labelled rows that teach a language, about: the bound of the sample.
SAMPLE = 8_000
#: Least share of a language's trigrams that one in its set has, and of the largest share that it has in any language.
LEAST_SHARE, LEAST_OF_BEST = 2e-5, 0.1
#: A text is in a language if it scores this share of the score that all but a thousandth of the language's own held-out rows reach.
OWN_QUANTILE, OWN_SHARE = 0.001, 0.85
#: Positions for each n-gram of the filter, and how many of them it sets.
ROOM, HASHES = 16, 3
#: Code points with a letter table; those beyond aren't letters.
TABLE = 0x33480
#: Characters of a text that are looked up at a time.
CHUNK = 1 << 18
#: Odd multipliers of the hashes.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@cache
def letters():
    """The lower-case letter of each code point; 0 for what isn't a letter."""
    import numpy as np

    return np.array([ord(chr(c).lower()[0]) if not 0xD800 <= c < 0xE000 and chr(c).isalpha() else 0 for c in range(TABLE)], dtype=np.int64)


def trigrams(text: str):
    """Arrays of the trigrams around each letter, as one integer each; whatever isn't a letter is a gap."""
    import numpy as np

    for start in range(0, len(text), CHUNK):
        points = np.frombuffer(text[max(0, start - 1) : start + CHUNK + 1].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        folded = letters()[np.where(points < TABLE, points, 0)]
        if start == 0:
            folded = np.concatenate([[0], folded])
        if start + CHUNK >= len(text):
            folded = np.concatenate([folded, [0]])
        middle = folded[1:-1]
        grams = folded[:-2] << 42 | middle << 21 | folded[2:]
        yield grams[middle > 0]


class LanguageFilter:
    """Bit-sliced Bloom filter over the sets of all languages."""

    def __init__(self, sets: dict[str, list[int]]):
        import numpy as np

        self.names = sorted(sets)
        total = len(set().union(*sets.values())) if sets else 0
        self.shift = 64 - max(10, (total * ROOM - 1).bit_length())
        planes = (len(self.names) + 63) // 64
        kind = np.uint8 if len(self.names) <= 8 else np.uint64
        self.slices = np.zeros((planes, 1 << (64 - self.shift)), dtype=kind)
        for i, name in enumerate(self.names):
            for at in self.positions(np.array(sets[name], dtype=np.int64)):
                np.bitwise_or.at(self.slices[i // 64], at, kind(1 << (i % 64)))
        filled = [float((self.slices[i // 64] >> kind(i % 64) & kind(1)).mean()) for i in range(len(self.names))]
        self.false = np.array([f**HASHES for f in filled])

    def positions(self, grams):
        import numpy as np

        keys = grams.view(np.uint64)
        keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(MIX[1])
        keys ^= keys >> np.uint64(32)
        return [((keys * np.uint64(m)) >> np.uint64(self.shift)).astype(np.int64) for m in MIX]

    def hits(self, text: str):
        """(trigrams, hits by language) of a text."""
        import numpy as np

        n, found = 0, np.zeros(len(self.names))
        for grams in trigrams(text):
            n += len(grams)
            where = self.positions(grams)
            for p, plane in enumerate(self.slices):
                held = plane[where[0]] & plane[where[1]] & plane[where[2]]
                counts = np.bincount(held, minlength=256) if held.dtype == np.uint8 else None
                for i in range(64 * p, min(len(self.names), 64 * p + 64)):
                    bit = i % 64
                    found[i] += counts[np.arange(256) >> bit & 1 == 1].sum() if counts is not None else int((held >> np.uint64(bit) & np.uint64(1)).sum())
        return n, found

    def predict(self, text: str | None) -> tuple[str, float]:
        n, found = self.hits(text) if text and self.names else (0, None)
        if not n:
            return UNKNOWN, 0.0
        true = (found - n * self.false) / (1 - self.false)
        best = int(true.argmax())
        return self.names[best], float(min(1.0, max(0.0, true[best] / n)))


def taught(docs: DataFrame, sample: int | None) -> tuple[dict[str, int], DataFrame]:
    """Labelled rows by language, and about sample of them for each, drawn by a hash of the id; None: all of them."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts or sample is None:
        return counts, labelled
    share = F.create_map(*[x for name, n in counts.items() for x in (F.lit(name), F.lit(min(1.0, sample / n)))])
    drawn = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * float(1 << 30)
    return counts, labelled.where(drawn)


def learn(docs: DataFrame, sample: int | None = SAMPLE) -> LanguageFilter:
    """The filter of the languages of docs (text, lang, doc_id). The driver gets trigrams that have a least share each: at most 1 / LEAST_SHARE for a language."""
    counts, labelled = taught(docs, sample)
    if not counts:
        return LanguageFilter({})
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(parts):
        import numpy as np

        for part in parts:
            by: dict[str, list] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1)):
                by.setdefault(lang, []).extend(trigrams(text.as_py()))
            for lang, found in by.items():
                grams, n = np.unique(np.concatenate(found), return_counts=True) if found else ([], [])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    made = common.arrow_map(labelled.select("lang", "text"), count, "lang string, gram long, n long")
    summed = common.written(made.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "trigrams")
    totals = summed.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = summed.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= LEAST_SHARE)
    best = shares.groupBy("gram").agg(F.max("share").alias("best"))
    sets: dict[str, list[int]] = {name: [] for name in counts}
    for r in shares.join(best, "gram").where(F.col("share") >= LEAST_OF_BEST * F.col("best")).select("lang", "gram").collect():
        sets[r.lang].append(r.gram)
    return LanguageFilter(sets)


def held_out():
    return common.id_remainder(5) == 0


def predict(docs: DataFrame, model: LanguageFilter, keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def make(parts):
        yield from common.batches(((d, *model.predict(t.as_py())) for part in parts for d, t in zip(part.column(0).to_pylist(), part.column(1))), schema)

    return common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; learned from the rows that aren't held out."""
    model = learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")


def least_scores(docs: DataFrame, model: LanguageFilter, least: float, sample: int = SAMPLE) -> dict[str, float]:
    """For each language of the model, the score from which a text counts as being in it; docs: labelled rows that the model hasn't learned from.

    No language's is below least; one without rows of its own has the smallest of the others'.
    """
    counts, labelled = taught(docs, sample)
    schema = pa.schema([("lang", pa.string()), ("score", pa.float64())])

    def own(parts):
        said = ((lang, *model.predict(t.as_py())) for part in parts for lang, t in zip(part.column(0).to_pylist(), part.column(1)))
        yield from common.batches(((lang, score) for lang, name, score in said if name == lang), schema)

    made = common.arrow_map(labelled.select("lang", "text"), own, "lang string, score double")
    found = {r.lang: max(least, OWN_SHARE * r.low) for r in made.groupBy("lang").agg(F.percentile_approx("score", OWN_QUANTILE).alias("low")).collect()} if counts else {}
    return {name: found.get(name, min(found.values(), default=least)) for name in model.names}


def keep_known(docs: DataFrame, least: float = 0.2) -> DataFrame:
    """The rows of docs, with their own columns, whose text is in a language of the corpus; rejected are those without a letter and those that score less than held-out rows of their best language do (less than least at any rate)."""
    rows = docs.select("doc_id", "text", "lang")
    model = learn(rows.where(~held_out()))
    if not model.names:
        return docs
    enough = least_scores(rows.where(held_out()), model, least)

    @F.pandas_udf("boolean")
    def known(texts):
        return texts.map(lambda t: (p := model.predict(t))[0] != UNKNOWN and p[1] >= enough[p[0]])

    common.small_batches(docs.sparkSession)
    return docs.where(known(F.col("text")))
