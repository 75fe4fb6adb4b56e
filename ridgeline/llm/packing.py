"""Concatenate and cut: documents end to end, cut into windows of a fixed length.

Pass 1 tokenizes each partition once and writes the ids with their offsets within the partition; the totals of the
partitions (one row each) get prefix sums, which make the offsets global. Pass 2 cuts at multiples of the window;
a window that spans documents or partitions has one boundary record for each piece. Only the last window is short.

Defined results: a null text counts as empty, and an empty document has its end id only; every row, repeated or
not, is packed; an empty table gives no rows; the order is that of the input's partitions and rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe, common

WINDOW, END_ID = 1024, 0

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
)


class PackedPieces(dict):
    """piece -> its ids as bytes; filled by the compiled merger, which merges by the order of the merge list and gives ranks, whatever ids the vocabulary has for them."""

    def __init__(self, merges: bpe.MergeList, kind: str):
        import numpy as np
        import tiktoken

        super().__init__()
        self.kind, self.special, self.merges = kind, merges.special, merges
        ranks = merges.ranks()
        self.merger = tiktoken.Encoding("ranks", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})  # what it gets is one piece
        self.id_of = np.array([merges.ids[token] for token in ranks], dtype=kind)  # by rank

    def __missing__(self, piece: str) -> bytes:
        import numpy as np

        if len(self) >= bpe.CACHED_PIECES:
            self.clear()
        found = self.id_of[np.array(self.merger.encode_ordinary(piece), dtype=np.intp)].tobytes()
        if len(piece) <= 64:
            self[piece] = found
        return found

    def slices(self, piece: str) -> Iterator[bytes]:
        import numpy as np

        for ids in bpe.sliced(self.merges, piece):
            yield np.array(ids, dtype=self.kind).tobytes()

    def of_special(self, content: str) -> bytes:
        import numpy as np

        return np.array([self.special[content]], dtype=self.kind).tobytes()


_loaded: dict[str, tuple[bpe.Encoder, str]] = {}


def load(path: str) -> tuple[bpe.Encoder, str]:
    """The encoder and the type of its ids, once for each Python worker."""
    if path not in _loaded:
        merges = bpe.MergeList(path)
        kind = "<u2" if max(merges.bytes_of) < 1 << 16 else "<u4"
        _loaded[path] = bpe.Encoder(merges, PackedPieces(merges, kind)), kind
    return _loaded[path]


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """part, start (in the partition), doc_id, n, ids (bytes): written, so that both passes see the same partitions."""
    schema = pa.schema([("part", pa.int64()), ("local", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("width", pa.int64()), ("ids", pa.binary())])

    def make(parts):
        import numpy as np
        from pyspark import TaskContext

        encoder, kind = load(path)
        part_id, width = TaskContext.get().partitionId(), int(kind[2:])
        end = np.array([END_ID], dtype=kind).tobytes()

        def rows():
            at = 0
            for part in parts:
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    ids = b"".join([*(b"".join(p) for p in encoder.parts(text.as_py())), end])
                    yield part_id, at, doc_id, len(ids) // width, width, ids
                    at += len(ids) // width

        yield from common.batches(rows(), schema)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return common.written(common.arrow_map(found, make, "part long, local long, doc_id long, n long, width long, ids binary"), "token-ids")


def cut(window: int, with_ids: bool):
    def make(parts):
        import numpy as np

        def rows():
            for part in parts:
                for at, doc_id, n, width, ids in zip(*(part.column(i).to_pylist() for i in range(4)), part.column(4)):
                    whole = memoryview(np.frombuffer(ids.as_buffer(), dtype=f"<u{width}").astype("<u4").tobytes())
                    start = 0
                    while start < n:
                        sequence, offset = divmod(at + start, window)
                        length = min(window - offset, n - start)
                        piece = whole[4 * start : 4 * (start + length)]
                        yield doc_id, start, length, zlib.crc32(piece), n, sequence, offset, bytes(piece) if with_ids else None
                        start += length

        yield from common.batches(rows(), PIECES)

    return make


def pack(docs: DataFrame, path: str, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit; null without with_ids) of each piece."""
    made = tokenized(docs, path)
    # one row for each input partition: the broadcast is bounded by the number of tasks, and the ids stay where they are
    totals = made.groupBy("part").agg(F.sum("n").alias("total"))
    bases = totals.select("part", (F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    placed = made.join(F.broadcast(bases), "part").select((F.col("base") + F.col("local")).alias("at"), "doc_id", "n", "width", "ids")
    out = common.arrow_map(placed, cut(window, with_ids), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out if with_ids else out.drop("ids")
