"""Toxicity by a convolutional text classifier that is trained in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its beginnings; filters of several widths slide
over the words, the largest response of each filter in the whole text is kept (max pooling), and a linear layer gives
the logit. Embeddings start from smoothed log odds of the hashed features, the rest from a fixed seed. A part of the
labelled rows is kept for calibration: one slope for all, and a threshold for each language that is mapped to a score
of 0.7. A text's language is what the language filters make of it; they are learned from all documents that may teach,
and lang itself is never asked when a text is scored.

All labelled rows that may teach do, with their whole texts. They are dealt to shards of about SHARD rows by a hash of the
id, and their features are written once. Log odds are counts over all of them. In each of EPOCHS rounds every shard starts
from the same network and goes through its rows in batches of BATCH; then the shards' changes are averaged, those of an
embedding over the rows of the shards that have it. Tasks add up the changes of their shards and Spark those of the tasks,
so the driver gets one network a round, whatever the number of rows. Thresholds are those of the largest F1 over all
calibrating rows, counted by logit with three decimals. Besides each clean text a short piece of it (or nothing of it) is
taught and counts in the calibration, with half of a row's weight: without these, what is short seems toxic, as it has no
clean word to speak for it; with them, thresholds lie somewhat higher than those of the real rows alone. Texts are taught
and scored whole, in windows of bounded memory.

Defined results: a null text counts as empty; an empty text gets the score of no word; rows without a label of 0 or 1
teach nothing, and of rows that repeat a doc_id the largest text does; with one class or none, all scores are 0;
repeated rows are repeated; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, language
from .licenses import LETTERS

#: Rows that a network goes through by itself in a round, about.
SHARD = 2_048
#: Labelled ids up to which they are broadcast to the documents; beyond, Spark joins as it sees fit, which shuffles all texts.
BROADCAST_IDS = 5_000_000
#: Words of an excerpt at most (spread()), and the words of a run.
TEACH_WORDS, RUN = 4_000, 100
#: Calibrating rows of each class from which a language has a threshold of its own.
ENOUGH = 10
#: Score from which a text is predicted to be toxic.
LIMIT = 0.7
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 16, (1, 2, 3), 8
#: Beginnings of a word that are features besides the word, in bytes.
BEGINNINGS = (4, 6)
PAD = BUCKETS
#: Words that are scored at a time, and cached words.
CHUNK, CACHED = 1 << 14, 250_000
EPOCHS, BATCH, RATE, SEED = 5, 32, 0.05, 11

class Features(dict):
    """word -> the buckets of the word and its beginnings, as bytes."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        at = [zlib.crc32(word) % BUCKETS, *(zlib.crc32(word[:n], n) % BUCKETS if len(word) > n else PAD for n in BEGINNINGS)]
        found = self[word] = struct.pack("<3H", *at)
        return found


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(LETTERS).split()


def spread(words: list[bytes]) -> list[bytes]:
    """An excerpt: all words, or runs of them at even distances from the text's beginning to its end. Nothing is taught or scored by it."""
    if len(words) <= TEACH_WORDS:
        return words
    runs = TEACH_WORDS // RUN
    return [w for k in range(runs) for at in [(len(words) - RUN) * k // (runs - 1)] for w in words[at : at + RUN]]


def buckets(words: list[bytes], features: Features):
    """The words' features, and what closes a text: two positions without any."""
    import numpy as np

    end = struct.pack("<3H", PAD, PAD, PAD) * (2 if words else 3)
    return np.frombuffer(b"".join([*map(features.__getitem__, words), end]), dtype="<u2").reshape(-1, 3)


class Seen:
    """Squared gradients so far, of each embedding and weight."""

    def __init__(self, net: ConvNet):
        import numpy as np

        self.table = np.full(net.table.shape[0], 1e-3, dtype=np.float32)
        self.filters = [np.full(f.shape, 1e-3, dtype=np.float32) for f in net.filters]
        self.out, self.shift = (np.full(len(net.out), 1e-3, dtype=np.float32) for _ in range(2))


class ConvNet:
    def __init__(self):
        import numpy as np

        rng = np.random.default_rng(SEED)
        self.table = rng.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3 / w, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shift = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.float32(0)
        for k, f in enumerate(self.filters):  # the first filter of each width adds up log odds
            f[:, :, 0] = 0
            f[:, 0, 0] = 1
            self.out[k * FILTERS] = 1
        self.slope, self.limit, self.limits = 1.0, 0.0, {}
        self.languages: language.LanguageFilter | None = None

    def start_from(self, counts, n) -> None:
        """Embeddings' first dimension: the features' log odds in units of their deviation; counts: texts of each class (0, 1) by bucket, n: texts of each class."""
        import numpy as np

        odds = np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))
        self.table[:, 0] = np.clip(odds / np.sqrt(1 / (counts[0] + 0.5) + 1 / (counts[1] + 0.5)) / 4, -1, 3)
        self.table[PAD] = 0

    def responses(self, ids):
        """(word vectors, responses by width and position) of texts that end in two empty positions."""
        vectors = self.table[ids].sum(axis=1)
        out = []
        for f in self.filters:
            found = vectors @ f[0]
            for j in range(1, len(f)):
                found[:-j] += (vectors @ f[j])[j:]
            out.append(found)
        return vectors, out

    def logit(self, ids) -> float:
        """Of a whole text, window by window."""
        import numpy as np

        n, best = max(1, len(ids) - 2), None
        for start in range(0, n, CHUNK):
            stop = min(n, start + CHUNK)
            _, found = self.responses(ids[start : stop + 2])
            here = np.concatenate([f[: stop - start].max(axis=0) for f in found])
            best = here if best is None else np.maximum(best, here)
        return float(np.maximum(best + self.shift, 0) @ self.out + self.bias)

    def largest(self, texts):
        """(the largest responses, text x filter; for each width the features at their places, text x filter x word x feature) of whole texts, some CHUNK words at a time."""
        import numpy as np

        pooled, places, at = [], [[] for _ in WIDTHS], 0
        while at < len(texts):
            stop, n = at + 1, len(texts[at])
            while stop < len(texts) and n + len(texts[stop]) <= CHUNK:
                n += len(texts[stop])
                stop += 1
            some, at = texts[at:stop], stop
            starts = np.cumsum([0, *map(len, some)])
            ids = np.concatenate(some)
            tops = [np.zeros((len(some), FILTERS), dtype=np.int64) for _ in WIDTHS]
            best = np.full((len(some), len(WIDTHS) * FILTERS), -np.inf, dtype=np.float32)
            for low in range(0, len(ids), CHUNK):  # one window, unless it is one long text
                _, found = self.responses(ids[low : low + CHUNK + 2])
                for i, (s, e) in enumerate(zip(starts.tolist(), starts[1:].tolist())):
                    s, e = max(s, low), min(max(s + 1, e - 2), low + CHUNK)
                    if s >= e:
                        continue
                    for k, f in enumerate(found):
                        here = f[s - low : e - low]
                        top = here.argmax(axis=0)
                        value = np.take_along_axis(here, top[None], axis=0)[0]
                        own = slice(k * FILTERS, (k + 1) * FILTERS)
                        better = value > best[i, own]
                        best[i, own] = np.where(better, value, best[i, own])
                        tops[k][i] = np.where(better, top + s, tops[k][i])
            pooled.append(best)
            for k, w in enumerate(WIDTHS):
                places[k].append(ids[np.minimum(tops[k][:, :, None] + np.arange(w), len(ids) - 1)])
        return np.concatenate(pooled), [np.concatenate(p) for p in places]

    def step(self, texts, y, weight, seen: Seen) -> None:
        """One step down the gradient of a batch; seen: squared gradients so far."""
        import numpy as np

        def move(value, grad, memory):
            memory += grad * grad
            value -= RATE * grad / np.sqrt(memory)

        pooled, places = self.largest(texts)
        hidden = np.maximum(pooled + self.shift, 0)
        z = hidden @ self.out + self.bias
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(texts)).astype(np.float32)
        dhidden = dz[:, None] * self.out * (hidden > 0)
        rows, grads = [], []
        for k, (f, place) in enumerate(zip(self.filters, places)):
            d = dhidden[:, k * FILTERS : (k + 1) * FILTERS]
            df = np.einsum("tf,tfwd->wdf", d, self.table[place].sum(axis=3))
            for j in range(len(f)):
                rows.append(place[:, :, j].reshape(-1, 3))
                grads.append((d[:, :, None] * f[j].T[None]).reshape(-1, DIM))
            move(f, df, seen.filters[k])
        rows, grads = np.concatenate(rows), np.concatenate(grads)
        moves = grads.any(axis=1)
        rows, grads = rows[moves].ravel(), np.repeat(grads[moves], 3, axis=0)
        if len(rows):
            order = np.argsort(rows, kind="stable")
            rows = rows[order]
            first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            used, summed = rows[first], np.add.reduceat(grads[order], first, axis=0)
            seen.table[used] += (summed**2).mean(axis=1)
            self.table[used] -= 0.5 * RATE * summed / np.sqrt(seen.table[used])[:, None]
            self.table[PAD] = 0
        move(self.out, hidden.T @ dz, seen.out)
        move(self.shift, dhidden.sum(axis=0), seen.shift)
        self.bias -= np.float32(RATE * dz.sum())

    def calibrate(self, counted: list[tuple]) -> None:
        """Slope and threshold of all rows, and for each language of ENOUGH rows of both classes a threshold of its own: that of the largest F1, midway where several are as good. counted: language, logit, toxic rows, other rows, weight of the other rows."""
        import numpy as np

        names = np.array([str(c[0]) for c in counted])
        z, toxic, clean, weight = (np.array([c[i] for c in counted], dtype=float) for i in range(1, 5))

        def limit(own):
            values, where = np.unique(-z[own], return_inverse=True)
            hits = np.cumsum(np.bincount(where, toxic[own]))
            taken = hits + np.cumsum(np.bincount(where, weight[own]))
            f1 = 2 * hits / (taken + hits[-1])
            best = np.flatnonzero(f1 >= f1.max() - 1e-12)[0]
            below = -values[best + 1] if best + 1 < len(values) else -values[best] - 1
            return float((-values[best] + below) / 2)

        self.limit = limit(np.ones(len(z), dtype=bool))
        for name in sorted(set(names.tolist())):
            own = names == name
            if min(toxic[own].sum(), clean[own].sum()) >= ENOUGH:
                self.limits[name] = limit(own)
        deviation = np.sqrt(((toxic + clean) * (z - self.limit) ** 2).sum() / (toxic + clean).sum()) or 1.0
        self.slope = float(4 / deviation)

    def score(self, text: str, features: Features) -> float:
        import math

        z = self.logit(buckets(words_of(text), features))
        limit = self.limits.get(self.languages.predict(text)[0], self.limit) if self.limits else self.limit
        at = self.slope * (z - limit) + math.log(LIMIT / (1 - LIMIT))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, at))))


_features = Features()


PREPARED = "doc_id long, shard int, kept boolean, toxic int, language string, ids binary"
#: Parts that the embeddings' changes are cut into where tasks' changes are added up; the last part has all other weights.
PARTS = 16


def unpacked(ids: bytes):
    import numpy as np

    return np.frombuffer(ids, dtype="<u2").reshape(-1, 3)


def prepared(docs: DataFrame, usable: DataFrame, languages: language.LanguageFilter, shards: int, apart: bool) -> DataFrame:
    """The features of all labelled texts, and the language of those that calibrate; shard by shard in the order of a hash."""
    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("kept", pa.bool_()), ("toxic", pa.int32()), ("language", pa.string()), ("ids", pa.binary())])

    def make(parts):
        def rows():
            last = None
            for part in parts:
                for doc_id, shard, kept, toxic, text in zip(*(part.column(i).to_pylist() for i in range(5))):
                    if doc_id != last:  # a repeated id teaches once: its largest text comes first
                        said = languages.predict(text)[0] if kept or not apart else None
                        yield doc_id, shard, kept, toxic, said, buckets(words_of(text), _features).tobytes()
                    last = doc_id

        yield from common.batches(rows(), schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(usable, "doc_id")
    dealt = texts.withColumns({"kept": kept(), "order": F.xxhash64(F.lit("order"), "doc_id"), "shard": F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards)).cast("int")})
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "order", "doc_id", F.desc("text"))
    return common.written(common.arrow_map(dealt.select("doc_id", "shard", "kept", "toxic", "text"), make, PREPARED), "taught")


def counts_of(taught: DataFrame):
    """Texts of each class by bucket, over all rows."""
    import numpy as np

    schema = pa.schema([("toxic", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(parts):
        found = np.zeros((2, BUCKETS + 1), dtype=np.int64)
        for part in parts:
            for toxic, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found[toxic, np.unique(unpacked(ids))] += 1
        toxic, bucket = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(bucket, pa.int32()), pa.array(found[toxic, bucket], pa.int64())], schema=schema)

    out = np.zeros((2, BUCKETS + 1))
    for r in common.arrow_map(taught.select("toxic", "ids"), count, "toxic int, bucket int, n long").groupBy("toxic", "bucket").agg(F.sum("n").alias("n")).collect():
        out[r.toxic, r.bucket] = r.n
    return out


def weights_of(net: ConvNet, seen: Seen):
    """(embeddings with their squared gradients, all other weights with theirs), as copies."""
    import numpy as np

    rest = [*net.filters, net.out, net.shift, net.bias, *seen.filters, seen.out, seen.shift]
    return np.column_stack([net.table, seen.table]), np.concatenate([np.ravel(r) for r in rest])


def set_weights(net: ConvNet, seen: Seen, table, rest) -> None:
    import numpy as np

    net.table, seen.table = np.ascontiguousarray(table[:, :DIM], dtype=np.float32), np.ascontiguousarray(table[:, DIM], dtype=np.float32)
    at = 0

    def take(like):
        nonlocal at
        at += np.size(like)
        return rest[at - np.size(like) : at].reshape(np.shape(like)).astype(np.float32)

    net.filters = [take(f) for f in net.filters]
    net.out, net.shift, net.bias = take(net.out), take(net.shift), np.float32(take(net.bias))
    seen.filters = [take(f) for f in seen.filters]
    seen.out, seen.shift = take(seen.out), take(seen.shift)


def trained(net: ConvNet, seen: Seen, taught: DataFrame, weight: tuple[float, float]) -> None:
    """One round over all rows: each shard starts from the network, and their changes are averaged by rows; weight: of a clean and of a toxic row."""
    import numpy as np

    schema = pa.schema([("part", pa.int32()), ("held", pa.binary())])
    table, rest = weights_of(net, seen)

    def learn(parts):
        changes, others, now, batch = np.zeros((len(table), DIM + 2)), np.zeros(len(rest) + 1), None, []
        own = own_seen = None
        n = 0

        def go():
            texts, y = zip(*batch)
            y = np.array(y)
            own.step(texts, y, np.where(y > 0, weight[1], weight[0]), own_seen)
            batch.clear()

        def close():
            if batch:
                go()
            if n:
                moved, rest_moved = weights_of(own, own_seen)
                touched = moved[:, DIM] > table[:, DIM]
                changes[:, : DIM + 1] += n * (moved - table)
                changes[:, DIM + 1] += n * touched
                others[:-1] += n * (rest_moved - rest)
                others[-1] += n

        for part in parts:
            for doc_id, shard, toxic, ids in zip(*(part.column(i).to_pylist() for i in range(4))):
                if shard != now:
                    close()
                    now, n, own, own_seen = shard, 0, ConvNet(), Seen(net)
                    set_weights(own, own_seen, table, rest)
                text = unpacked(ids)
                n += 1
                for one in (text,) if toxic else (text, piece_of(text, piece_rng(doc_id))):
                    batch.append((one, toxic))
                    if len(batch) == BATCH:
                        go()
        close()
        if others[-1]:
            held = [c.tobytes() for c in np.array_split(changes, PARTS)] + [others.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS + 1), pa.int32()), pa.array(held, pa.binary())], schema=schema)

    def add(parts):
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            for k, held in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(held)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], schema=schema)

    made = common.arrow_map(taught.select("doc_id", "shard", "toxic", "ids"), learn, "part int, held binary")
    sums = {r.part: np.frombuffer(bytes(r.held)) for r in common.arrow_map(made.repartition("part"), add, "part int, held binary").collect()}
    changes, others = np.concatenate([sums[k].reshape(-1, DIM + 2) for k in range(PARTS)]), sums[PARTS]
    set_weights(net, seen, table + changes[:, : DIM + 1] / np.maximum(changes[:, DIM + 1 :], 1), rest + others[:-1] / others[-1])


def logits(net: ConvNet, taught: DataFrame) -> list[tuple]:
    """language, logit, toxic rows, other rows, weight of the other rows: over all rows of taught, by logit with three decimals."""
    schema = pa.schema([("language", pa.string()), ("z", pa.float64()), ("toxic", pa.int64()), ("clean", pa.int64()), ("weight", pa.float64())])

    def make(parts):
        def rows():
            for part in parts:
                for doc_id, toxic, said, ids in zip(*(part.column(i).to_pylist() for i in range(4))):
                    text = unpacked(ids)
                    yield said, round(net.logit(text), 3), toxic, 1 - toxic, 1.0 - toxic
                    if not toxic:
                        yield said, round(net.logit(piece_of(text, piece_rng(doc_id))), 3), 0, 1, 0.5

        yield from common.batches(rows(), schema)

    made = common.arrow_map(taught.select("doc_id", "toxic", "language", "ids"), make, "language string, z double, toxic long, clean long, weight double")
    return [tuple(r) for r in made.groupBy("language", "z").agg(F.sum("toxic"), F.sum("clean"), F.sum("weight")).collect()]


def fit(docs: DataFrame, labels: DataFrame, languages: language.LanguageFilter) -> ConvNet | None:
    """The classifier of all labelled documents; None unless there are both classes."""
    usable = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    there = usable.withColumn("kept", kept()).join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    counts = {(r.kept, r.toxic): r.n for r in there.groupBy("kept", "toxic").agg(F.count("*").alias("n")).collect()}
    if len({toxic for _, toxic in counts}) < 2:
        return None
    apart = len(counts) == 4  # both classes on both sides; else all rows teach and calibrate
    n = [sum(c for (kept, toxic), c in counts.items() if toxic == y and not (kept and apart)) for y in (0, 1)]
    taught = prepared(docs, F.broadcast(usable) if sum(counts.values()) <= BROADCAST_IDS else usable, languages, -(-sum(n) // SHARD), apart)
    learn, check = (taught.where(~F.col("kept")), taught.where("kept")) if apart else (taught, taught)
    net = ConvNet()
    net.start_from(counts_of(learn), n)
    seen, items = Seen(net), 2 * n[0] + n[1]
    for _ in range(EPOCHS):
        trained(net, seen, learn, (items / 2 / (2 * n[0]), items / 2 / n[1]))
    net.calibrate(logits(net, check))
    net.languages = languages
    return net


def kept():
    """The rows that calibrate: a fourth, by a hash of the id."""
    return F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(4)) == 0


def piece_rng(doc_id: int):
    import numpy as np

    return np.random.default_rng([SEED, doc_id & (1 << 64) - 1])


def piece_of(ids, rng):
    """A short piece of a clean text, or nothing of it: clean as well, and what keeps short texts from seeming toxic."""
    import numpy as np

    n = int(rng.integers(0, 16))
    start = int(rng.integers(0, max(1, len(ids) - 2 - n)))
    end = np.full((2 if n else 3, 3), PAD, dtype=ids.dtype)
    return np.concatenate([ids[start : min(start + n, len(ids) - 2)], end])


def held_out():
    return common.id_remainder(3) == 1


def learned(docs: DataFrame, labels: DataFrame) -> ConvNet | None:
    """The classifier that documents and labels outside the held-out ids teach; a table without lang has one threshold for all."""
    speaks = docs.where(~held_out()).select("doc_id", "text", F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"))
    return fit(docs, labels.where(~held_out()), language.learn(speaks, None))


def score(docs: DataFrame, model: ConvNet | None) -> DataFrame:
    """doc_id, score, predicted of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def make(parts):
        def rows():
            for part in parts:
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    found = model.score(text.as_py(), _features) if model else 0.0
                    yield doc_id, found, int(found >= LIMIT)

        yield from common.batches(rows(), schema)

    return common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), make, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    return score(docs, learned(docs, labels)).withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with their own columns, that aren't predicted to be toxic."""
    model = learned(docs, labels)
    if model is None:
        return docs

    @F.pandas_udf("boolean")
    def clean(texts):
        return texts.map(lambda t: model.score(t or "", _features) < LIMIT)

    common.small_batches(docs.sparkSession)
    return docs.where(clean(F.coalesce("text", F.lit(""))))
