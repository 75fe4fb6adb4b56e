"""Target-distribution importance resampling over bucket-partitioned inverted postings.

Every run of one to three words is a feature, a hash puts it in one of BUCKETS buckets, and a document weighs what the
target corpus makes of its buckets. Documents are posted as (bucket, document, count), held in blocks of documents so
that a row has all of a block's postings of a bucket. Postings and the counts of both corpora meet at the bucket's task,
which works out the bucket's gain from them and gives contributions, added up by block there; a second shuffle brings the
contributions of a block to its documents. A bucket of very many postings is dealt by block to as many tasks as it
needs, each with the bucket's counts. Weighed documents then draw Gumbel noise from their ids, and the best are kept:
ranks are positions in ranges of the score plus what lies in the ranges before.

Corpus counts cover every feature of every text. What a task holds is a block's keys, or a block's weights and the gains
of its buckets. Only totals and a count for each range reach the driver.

Defined results: a null text has no words; a text without words has weight 0 and no features; documents of fewer than
`least_words` words get no rank; a null doc_id draws as an empty id and ranks behind equal scores; repeated rows are
rows of their own; empty documents give no rows; an empty target leaves the gains that its zero counts make; a very long
text is a block of its own, read in slices of words. Other columns of the tables are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .licenses import words_of

BUCKETS, LONGEST = 10_000, 3
#: Documents and bytes of text of a block of postings; a document is named by 16 bits there.
BLOCK_DOCS, BLOCK_BYTES = 1 << 15, 12 << 20
#: Words of a text that are hashed at a time.
SLICE = 1 << 16
#: Features of a bucket beyond which its postings are dealt to more tasks, one for so many.
SHARD = 4 << 20
#: Kinds of rows: a bucket's counts, a block's documents, postings.
COUNTS, DOCUMENTS, POSTINGS = 0, 1, 2
SEED = 42

ROWS = "kind int, bucket int, block long, counts binary, body binary"
ROW_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("counts", pa.binary()), ("body", pa.binary())])


def buckets_of(words: list[bytes], buckets: int = BUCKETS):
    """Arrays of the buckets of all runs of one to LONGEST words; a run's hash goes on from that of the run without its last word."""
    import numpy as np

    for start in range(0, len(words), SLICE):
        some = words[start : start + SLICE + LONGEST - 1]
        firsts = min(SLICE, len(words) - start)
        hashes = list(map(crc32, some[:firsts]))
        yield np.array(hashes, dtype=np.uint32) % np.uint32(buckets)
        spaced = [b" " + w for w in some[1:]]
        for k in range(1, LONGEST):
            hashes = list(map(crc32, spaced[k - 1 :], hashes))
            if hashes:
                yield np.array(hashes, dtype=np.uint32) % np.uint32(buckets)


def features_of(words: int) -> int:
    return sum(max(0, words - k) for k in range(LONGEST))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all texts (column text), added up in each task before they are shuffled."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def count(parts):
        import numpy as np

        found = np.zeros(buckets, dtype=np.int64)
        for part in parts:
            for text in part.column(0):
                for own in buckets_of(words_of(text.as_py()), buckets):
                    found += np.bincount(own, minlength=buckets)
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(found[held], pa.int64())], schema=schema)

    made = common.arrow_map(texts.select(common.text_bytes().alias("text")), count, "bucket int, n long")
    return made.groupBy("bucket").agg(F.sum("n").alias("n"))


def packed(gaps, counts) -> tuple[bytes, bytes]:
    """(counts, distances of document numbers) of a bucket's postings in a block; bytes of one place lie together, which compresses."""
    import numpy as np

    return counts.astype(np.uint8).tobytes(), np.ascontiguousarray(gaps.astype("<u2").view(np.uint8).reshape(-1, 2).T).tobytes()


def unpacked(counts: bytes, gaps: bytes):
    import numpy as np

    places = np.frombuffer(gaps, np.uint8).reshape(2, -1)
    return np.frombuffer(counts, np.uint8).astype(np.int64), np.cumsum(places[0].astype(np.int64) + (places[1].astype(np.int64) << 8))


def block_rows(block: int, ids: list, words: list[int], keys: list) -> Iterator[tuple]:
    """The rows of a block: its documents, and for each bucket its postings. A count beyond a byte is several postings of one document."""
    import numpy as np

    yield DOCUMENTS, -1, block, np.array([i is not None for i in ids], dtype=np.uint8).tobytes(), np.array([[i or 0, w] for i, w in zip(ids, words)], dtype="<i8").tobytes()
    if not keys:
        return
    held = np.concatenate(keys)
    keys.clear()
    held.sort()
    starts = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
    counts = np.diff(np.append(starts, len(held)))
    held = held[starts]
    if counts.max() > 255:
        times = -(-counts // 255)
        last = np.cumsum(times) - 1
        rest = counts - 255 * (times - 1)
        held, counts = np.repeat(held, times), np.full(int(times.sum()), 255)
        counts[last] = rest
    bucket, doc = held >> 16, (held & 0xFFFF).astype(np.int64)
    bounds = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    for low, high in zip(bounds.tolist(), [*bounds[1:].tolist(), len(held)]):
        own = doc[low:high]
        yield POSTINGS, int(bucket[low]), block, *packed(np.diff(own, prepend=0), counts[low:high])


def postings(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows of all blocks of docs. A block is named by its task and its number there."""

    def rows(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        import numpy as np

        task, made = TaskContext.get().partitionId(), 0
        ids, words, keys, size = [], [], [], 0
        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                text = text.as_py()
                if ids and (len(ids) >= BLOCK_DOCS or size + len(text) > BLOCK_BYTES):
                    yield from block_rows(task << 32 | made, ids, words, keys)
                    made += 1
                    ids, words, keys, size = [], [], [], 0
                own = words_of(text)
                keys += [b << np.uint32(16) | np.uint32(len(ids)) for b in buckets_of(own, buckets)]
                ids.append(doc_id)
                words.append(len(own))
                size += len(text)
        if ids:
            yield from block_rows(task << 32 | made, ids, words, keys)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text"))
    return common.arrow_map(found, lambda parts: common.batches(rows(parts), ROW_SCHEMA), ROWS)


def gain(s: int, t: int, all_s: int, all_t: int, buckets: int) -> int:
    """What one feature of a bucket adds: the log ratio of its smoothed shares of target and corpus, in thousandths."""
    return math.floor(1000 * math.log(float(t + 1) * float(all_s + buckets) / (float(s + 1) * float(all_t + buckets))))


def contributions(all_s: int, all_t: int, buckets: int):
    """For mapInArrow over a bucket partition's rows, counts first, then by block: a block's documents as they are, and the sums of what the partition's buckets add to them."""

    def rows(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        import numpy as np

        gains, now, sums = {}, None, np.zeros(0)
        for part in parts:
            for kind, bucket, block, counts, body in zip(*(part.column(c).to_pylist() for c in range(5))):
                if kind == COUNTS:
                    s, t = np.frombuffer(counts, ">i8").tolist()
                    gains[bucket] = gain(s, t, all_s, all_t, buckets)
                elif kind == DOCUMENTS:
                    yield kind, bucket, block, counts, body
                else:
                    if block != now:
                        if now is not None:
                            yield POSTINGS, -1, now, None, sums.astype("<i8").tobytes()
                        now, sums = block, np.zeros(0)
                    own, docs = unpacked(counts, body)
                    added = np.bincount(docs, own * gains[bucket], len(sums))
                    added[: len(sums)] += sums
                    sums = added  # whole numbers far below 2 ** 53
        if now is not None:
            yield POSTINGS, -1, now, None, sums.astype("<i8").tobytes()

    return lambda parts: common.batches(rows(parts), ROW_SCHEMA, 256)


def noise(doc_id: int | None, seed: int) -> int:
    """A document's Gumbel draw in thousandths, from its id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(seed: int):
    """For mapInArrow over rows sorted by block, documents first: doc_id, n_words, n_features, weight, score of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])

    def rows(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        import numpy as np

        ids, words, sums = [], [], None

        def flush():
            for i, n, weight in zip(ids, words, sums.tolist() if sums is not None else ()):
                yield i, n, features_of(n), weight, weight + noise(i, seed)

        for part in parts:
            for kind, counts, body in zip(part.column(0).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist()):
                found = np.frombuffer(body, "<i8")
                if kind == DOCUMENTS:
                    yield from flush()
                    ids, words = ([i if there else None for i, there in zip(found[::2].tolist(), counts)], found[1::2].tolist())
                    sums = np.zeros(len(ids), dtype=np.int64)
                else:
                    sums[: len(found)] += found
        yield from flush()

    return lambda parts: common.batches(rows(parts), schema)


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED, shard: int = SHARD) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row of docs against the texts of target."""
    held = bucket_counts(docs, buckets).withColumnRenamed("n", "s").join(bucket_counts(target, buckets).withColumnRenamed("n", "t"), "bucket", "full")
    held = common.written(held.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "bucket-counts")
    all_s, all_t = (x or 0 for x in held.agg(F.sum("s"), F.sum("t")).first())
    shards = held.withColumn("shards", F.ceil((F.col("s") + 1) / shard).cast("int"))
    both = F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("s", "t")])
    ours = shards.select(
        F.lit(COUNTS).alias("kind"), "bucket", F.lit(-1).cast("long").alias("block"), both.alias("counts"), F.lit(None).cast("binary").alias("body"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
    )
    posted = postings(docs, buckets).join(F.broadcast(shards.where("shards > 1").select("bucket", "shards")), "bucket", "left")  # a row for each bucket at most
    spread = F.when(F.col("kind") == DOCUMENTS, F.pmod(F.hash("block"), F.lit(1 << 20))).otherwise(F.pmod(F.hash("block"), F.coalesce("shards", F.lit(1))))
    dealt = ours.unionByName(posted.withColumn("shard", spread).drop("shards")).repartition("bucket", "shard").sortWithinPartitions("kind", "block")
    added = common.arrow_map(dealt.select(*ROW_SCHEMA.names), contributions(all_s, all_t, buckets), ROWS)
    by_block = added.repartition("block").sortWithinPartitions("block", "kind")
    return common.arrow_map(by_block.select(*ROW_SCHEMA.names), weighed(seed), "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The rows with rank: 1, 2, ... for the best floor(share * rows) by score (ties: smaller doc_id, null last), null for the rest."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64()), ("part", pa.int32()), ("place", pa.int64())])

    def number(parts):
        part_id, at = TaskContext.get().partitionId(), 0
        for part in parts:
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([part_id] * n, pa.int32()), pa.array(range(at + 1, at + n + 1), pa.int64())], schema=schema)
            at += n

    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    dealt = rows.select("doc_id", "n_features", "weight", "score").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = common.written(common.arrow_map(dealt, number, "doc_id long, n_features long, weight long, score long, part int, place long"), "ranges")
    sizes = sorted((r.part, r["count"]) for r in placed.groupBy("part").count().collect())  # a row for each range
    most, before, starts = sum(n for _, n in sizes) * share[0] // share[1], 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    starts = rows.sparkSession.createDataFrame(starts, "part int, before long")
    rank = F.col("place") + F.col("before")
    return placed.join(F.broadcast(starts), "part").select("doc_id", "n_features", "weight", "score", F.when(rank <= most, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), least_words: int = 20, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs; rank is that of the draw of a share of the documents of least_words or more, null for what isn't drawn."""
    found = common.written(scored(docs, target, buckets, seed), "weighed")
    short = found.where(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked(found.where(F.col("n_words") >= least_words), share).unionByName(short)
