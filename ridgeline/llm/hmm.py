"""Language-model scoring by a hidden Markov model that is trained over the whole corpus.

Symbols are the HEAD most frequent tokens and, for all others, classes by a token's last letters; within a class a
token has its add-one share. Counts, classes and the tokens' shares come from every training document: words are
counted by Spark, and tokens outside the head are joined with their counts, so no vocabulary has to fit anywhere.

Training is Baum-Welch: each round, tasks run the forward and backward recursions over their whole documents and send
expected counts (arrays of a fixed size), which Spark adds up. A start is found on a bounded sample; the rounds that
follow learn from all training documents.

Documents are cut into segments that are worked on side by side, and nothing is lost at their edges: a segment's
transfer matrix (state by state) carries the forward message into the next segment and the backward message into the
one before, so counts and likelihoods are those of the whole sequence, and a very long document costs no more for each
token than a short one.

Defined results: a null text counts as empty and is one end token; a null id counts as an empty text in the split;
without training documents, scores are those of no knowledge; repeated rows are scored and counted each; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Latent states, tokens of the head, classes of the rest: sizes of the model, whatever the corpus.
STATES, HEAD, CLASSES = 8, 64_000, 512
#: Rounds of Baum-Welch over all training documents.
ROUNDS = 3
#: Tokens of a segment, and tokens that a task holds at a time.
SEGMENT, HELD = 128, 1 << 20
#: Documents of the sample that a start is found on (about), the tokens that one gives to it at most (pieces from all over its text), and rounds for it.
START_DOCS, START_TOKENS, START_ROUNDS, SEED = 256, 16_384, 25, 3
#: Bytes of a token, at most; a longer one is known by its digest and its last letters, and is a token like any other.
TOKEN_BYTES = 64
#: Pseudo-tokens that each state shares with the whole corpus.
PRIOR = 2000.0
#: Tokens a counting task holds before it sends them on.
COUNTED = 300_000
#: Symbols of one row of expected counts.
BLOCK = 4096
END = b""


def tokens_of(text: bytes) -> list[bytes]:
    """Words, A-Z lower-cased; the end is added by who counts."""
    return text.lower().split()


def key_of(token: bytes) -> bytes:
    """What a token is known by: itself, or for a long one a space (which no word has), its digest and its last letters."""
    return token if len(token) <= TOKEN_BYTES else b" " + hashlib.sha256(token).digest() + token[-3:]


def class_of(token: bytes) -> int:
    return zlib.crc32(token[-3:]) % CLASSES


def held_out():
    return common.id_remainder(7) == 2


def count_tokens(docs: DataFrame) -> DataFrame:
    """token, class, n over all rows of docs (text); the end counts once for each."""
    schema = pa.schema([("token", pa.binary()), ("class", pa.int32()), ("n", pa.int64())])

    def count(parts):
        def rows():
            found: Counter = Counter()
            for part in parts:
                for text in part.column(0):
                    found.update(tokens_of(text.as_py()))
                    found[END] += 1
                    if len(found) >= COUNTED:
                        yield from ((key_of(t), class_of(t), n) for t, n in found.items())
                        found.clear()
            yield from ((key_of(t), class_of(t), n) for t, n in found.items())

        yield from common.batches(rows(), schema, 8192)

    made = common.arrow_map(docs.select(common.text_bytes().alias("text")), count, "token binary, class int, n long")
    return common.written(made.groupBy("token", "class").agg(F.sum("n").alias("n")), "vocabulary")


class Symbols:
    """What tasks need to code tokens: the head's tokens, their counts, and each class's mass."""

    def __init__(self, head: list[tuple[bytes, int]], masses: dict[int, int], total: int, distinct: int):
        import numpy as np

        self.ids = {t: i for i, (t, _) in enumerate(head)}
        self.size = len(head) + CLASSES
        self.total, self.distinct = total, distinct
        self.head_logs = np.log10(np.array([c + 1 for _, c in head] + [1] * CLASSES, dtype=float))
        mass = np.array([masses.get(k, 0) + 1 for k in range(CLASSES)], dtype=float)
        self.share_logs = np.concatenate([np.zeros(len(head)), np.log10(mass)])
        self.mass = np.concatenate([np.array([c + 1 for _, c in head], dtype=float), mass])
        self.mass /= self.mass.sum()
        self.known = np.array([c > 0 for _, c in head] + [False] * CLASSES)
        self.base_log = math.log10(total + distinct + 1)

    def code(self, tokens: list[bytes]):
        """(symbols, tokens outside the head)"""
        import numpy as np

        first, ids = len(self.ids), self.ids
        codes = [ids.get(t, -1) for t in tokens]
        codes.append(ids[END])
        keys = [key_of(t) for t, c in zip(tokens, codes) if c < 0]
        found = np.array(codes, dtype=np.int64)
        if keys:
            known = [ids.get(k, -1) for k in keys]  # long ones of the head
            found[found < 0] = [c if c >= 0 else first + class_of(k) for c, k in zip(known, keys)]
            keys = [k for c, k in zip(known, keys) if c < 0]
        return found.astype("<u4"), keys


def symbols(vocabulary: DataFrame) -> Symbols:
    """The head comes to the driver (about HEAD tokens of at most TOKEN_BYTES each, and the end), the rest as one sum for each class.

    The head is cut at a frequency that counts by frequency range find: only the tokens above it leave their tasks. Of
    the range that doesn't fit whole, a share comes that a hash of the token draws.
    """
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    cell = F.floor(F.log2(F.col("n").cast("double")) * 64)
    short = vocabulary.where(F.octet_length("token") > 0)
    cut, share, taken = math.inf, 0.0, 0
    for r in sorted(short.groupBy(cell.alias("cell")).count().collect(), key=lambda r: -r.cell):  # 64 ranges an octave
        cut, share = r.cell, min(1.0, (HEAD - taken) / r["count"])
        taken += r["count"]
        if taken >= HEAD:
            break
    drawn = F.pmod(F.xxhash64("token", F.lit("head")), F.lit(1 << 30)) < share * float(1 << 30)
    head_rows = short.where((cell > cut) | ((cell == cut) & drawn)).unionByName(vocabulary.where(F.octet_length("token") == 0))
    head = sorted(((bytes(r.token), r.n) for r in head_rows.select("token", "n").collect()), key=lambda x: (-x[1], x[0]))
    sums = vocabulary.groupBy("class").agg(F.sum(F.col("n") + 1).alias("mass")).collect() if distinct > len(head) else []
    masses = {r["class"]: r.mass for r in sums}
    for t, c in head if sums else ():
        masses[class_of(t)] -= c + 1
    return Symbols(head or [(END, 0)], masses, total, distinct)


def coded(docs: DataFrame, model: Symbols) -> DataFrame:
    """rid, doc_id, held_out, n, codes (bytes), rest (tokens outside the head) of each row; written, so rid is stable."""
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64()), ("codes", pa.binary()), ("rest", pa.list_(pa.binary()))])

    def make(parts):
        from pyspark import TaskContext

        def rows():
            rid = TaskContext.get().partitionId() << 36
            for part in parts:
                for doc_id, held, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    codes, rest = model.code(tokens_of(text.as_py()))
                    yield rid, doc_id, held, len(codes), codes.tobytes(), rest
                    rid += 1

        yield from common.batches(rows(), schema, 256)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), common.text_bytes().alias("text"))
    return common.written(common.arrow_map(found, make, "rid long, doc_id long, held_out boolean, n long, codes binary, rest array<binary>"), "coded")


class Hmm:
    def __init__(self, start, move, emit):
        #: Start of a document, moves, and emissions (symbol by state).
        self.start, self.move, self.emit = start, move, emit


def first_model(texts: list, mass) -> Hmm:
    """A mixture of unigram models over a few documents, by EM: one state for each part."""
    import numpy as np

    rng, size = np.random.default_rng(SEED), len(mass)
    prior = PRIOR * mass
    counts = np.zeros((len(texts), size), dtype=np.float32)
    for row, codes in zip(counts, texts):
        row += np.bincount(codes, minlength=size)
    part = rng.dirichlet(np.ones(STATES), max(1, len(texts)))[: len(texts)]
    for _ in range(START_ROUNDS):
        emit = (part.T @ counts).astype(float) + prior
        emit /= emit.sum(axis=1, keepdims=True)
        weight = (part.sum(axis=0) + 1) / (len(texts) + STATES)
        logs = counts @ np.log(emit).T.astype(np.float32) + np.log(weight)
        part = np.exp(logs - logs.max(axis=1, keepdims=True))
        part /= part.sum(axis=1, keepdims=True)
    emit = (part.T @ counts).astype(float) + prior
    emit /= emit.sum(axis=1, keepdims=True)
    move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
    weight = (part.sum(axis=0) + 1) / (len(texts) + STATES)
    return Hmm(weight, move, np.ascontiguousarray(emit.T))


class Segments:
    """Some documents as segments x positions in order of falling length, and the order in which messages pass from one to the next."""

    def __init__(self, texts: list):
        import numpy as np

        n = np.array([len(t) for t in texts])
        each = -(-n // SEGMENT)
        doc = np.repeat(np.arange(len(texts)), each)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
        lengths = np.minimum(SEGMENT, n[doc] - number * SEGMENT)
        grid = np.zeros((len(doc), SEGMENT), dtype=np.int64)
        grid[np.arange(SEGMENT) < lengths[:, None]] = np.concatenate(texts)
        order = np.argsort(-lengths, kind="stable")
        self.grid, self.lengths, self.first, self.doc, self.docs = grid[order], lengths[order], number[order] == 0, doc[order], len(texts)
        number = number[order]
        waves = np.lexsort((self.doc, number))  # all first segments, then all second ones, ...
        edges = np.searchsorted(number[waves], np.arange(number.max() + 2))
        self.waves = [waves[low:high] for low, high in zip(edges, edges[1:])]

    def transfers(self, model: Hmm):
        """(segment x state before x state at its end, scaled; log10 of each segment's scale). Before a first segment stands its own first state."""
        import numpy as np

        out, logs = np.empty((len(self.grid), STATES, STATES)), np.zeros(len(self.grid))
        for at in range(0, len(self.grid), 2048):
            g, n, f = self.grid[at : at + 2048], self.lengths[at : at + 2048], self.first[at : at + 2048]
            m = np.where(f[:, None, None], np.eye(STATES), model.move)
            own = logs[at : at + 2048]
            for t in range(int(n[0])):
                k = int((n > t).sum())
                if t:
                    m[:k] = (m[:k].reshape(-1, STATES) @ model.move).reshape(k, STATES, STATES)
                m[:k] *= model.emit[g[:k, t]][:, None, :]
                if t % 16 == 15:
                    c = m[:k].sum(axis=(1, 2), keepdims=True)
                    m[:k] /= c
                    own[:k] += np.log10(c[:, 0, 0])
            c = m.sum(axis=(1, 2), keepdims=True)
            out[at : at + 2048] = m / c
            own += np.log10(c[:, 0, 0])
        return out, logs

    def before(self, model: Hmm, transfers):
        """(distribution of the state before each segment, the start's before a first one; log10 of what scaling it took, by document)."""
        import numpy as np

        state, into, logs = np.tile(model.start, (self.docs, 1)), np.empty((len(self.grid), STATES)), np.zeros(self.docs)
        for some in self.waves:
            doc = self.doc[some]
            into[some] = state[doc]
            moved = np.einsum("ns,nst->nt", state[doc], transfers[some])
            c = moved.sum(axis=1, keepdims=True)
            state[doc] = moved / c
            logs[doc] += np.log10(c[:, 0])
        return into, logs

    def after(self, transfers):
        """For each segment, how likely what follows it is from each state at its end, scaled."""
        import numpy as np

        ahead, out = np.ones((self.docs, STATES)), np.empty((len(self.grid), STATES))
        for some in reversed(self.waves):
            doc = self.doc[some]
            out[some] = ahead[doc]
            back = np.einsum("nst,nt->ns", transfers[some], ahead[doc])
            ahead[doc] = back / back.sum(axis=1, keepdims=True)
        return out


def expected(model: Hmm, texts: list, size: int):
    """Expected counts of starts, moves and emissions over some whole documents: Baum-Welch's E step."""
    import numpy as np

    held = Segments(texts)
    transfers, _ = held.transfers(model)
    into, _ = held.before(model, transfers)
    beyond = held.after(transfers)
    starts, moves, emits = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((size, STATES))
    for at in range(0, len(held.grid), 2048):
        g, n, f = held.grid[at : at + 2048], held.lengths[at : at + 2048], held.first[at : at + 2048]
        start, steps = into[at : at + 2048], int(n[0])
        active = [int((n > t).sum()) for t in range(steps)]
        alpha, likely, scale = [], [], []
        last = np.empty((len(g), STATES))
        for t in range(steps):
            b = model.emit[g[: active[t], t]]
            a = (np.where(f[:, None], start, start @ model.move) if t == 0 else alpha[-1][: active[t]] @ model.move) * b
            c = a.sum(axis=1, keepdims=True)
            alpha.append(a / c)
            likely.append(b)
            scale.append(c)
            last[: active[t]] = alpha[-1]
        beta = beyond[at : at + 2048]
        beta = beta / (last * beta).sum(axis=1, keepdims=True)
        posterior = [None] * steps
        for t in range(steps - 1, -1, -1):
            k = active[t]
            gamma = alpha[t] * beta[:k]
            gamma /= gamma.sum(axis=1, keepdims=True)
            posterior[t] = gamma
            ahead = likely[t] * beta[:k] / scale[t]
            if t:
                moves += model.move * (alpha[t - 1][:k].T @ ahead)
                beta[:k] = ahead @ model.move.T
            else:
                moves += model.move * (start[~f].T @ ahead[~f])
        starts += posterior[0][f].sum(axis=0)
        flat = np.concatenate([g[: active[t], t] for t in range(steps)])
        gammas = np.concatenate(posterior)
        for k in range(STATES):
            emits[:, k] += np.bincount(flat, weights=gammas[:, k], minlength=size)
    return starts, moves, emits


def groups(parts: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[int], list]]:
    """Rows of some batches at a time, of about HELD tokens: (positions, symbols)."""
    import numpy as np

    rows, texts, n = [], [], 0
    for part in parts:
        for i, codes in enumerate(part.column(column)):
            found = np.frombuffer(codes.as_py(), dtype="<u4").astype(np.int64)
            rows.append(tuple(part.column(c)[i].as_py() for c in range(part.num_columns) if c != column))
            texts.append(found)
            n += len(found)
            if n >= HELD:
                yield rows, texts
                rows, texts, n = [], [], 0
    if texts:
        yield rows, texts


def round_of(rows: DataFrame, model: Hmm, known: Symbols) -> Hmm:
    """One round of Baum-Welch over all rows. Each task sends its sums in blocks of symbols; Spark adds them by block."""
    import numpy as np

    size = known.size
    schema = pa.schema([("block", pa.int32()), ("sums", pa.binary())])

    def e_step(parts):
        sums = None
        for _, texts in groups(parts, 0):
            found = expected(model, texts, size)
            sums = found if sums is None else [a + b for a, b in zip(sums, found)]
        if sums is not None:
            yield from common.batches(((-1, np.concatenate([sums[0], sums[1].ravel()]).tobytes()), *((i // BLOCK, sums[2][i : i + BLOCK].astype(np.float32).tobytes()) for i in range(0, size, BLOCK))), schema, 16)

    def add(parts):
        held: dict[int, np.ndarray] = {}
        for part in parts:
            for block, sums in zip(part.column(0).to_pylist(), part.column(1)):
                found = np.frombuffer(sums.as_py(), dtype=np.float64 if block < 0 else np.float32).astype(float)
                held[block] = held[block] + found if block in held else found
        yield from common.batches(((k, v.tobytes()) for k, v in held.items()), schema, 16)

    sent = common.arrow_map(rows.select("codes"), e_step, "block int, sums binary")
    added = {r.block: np.frombuffer(bytes(r.sums)) for r in common.arrow_map(sent.repartition("block"), add, "block int, sums binary").collect()}
    if not added:
        return model
    small = added.pop(-1)
    starts, moves = small[:STATES], small[STATES:].reshape(STATES, STATES)
    emits = np.concatenate([added[k] for k in sorted(added)]).reshape(size, STATES) + PRIOR * known.mass[:, None]
    share = lambda a: (a + 1) / (a + 1).sum(axis=-1, keepdims=True)
    return Hmm(share(starts), share(moves), emits / emits.sum(axis=0))


def spread(codes, most: int):
    """At most so many of a text's tokens: all, or segments at even distances from its beginning to its end."""
    import numpy as np

    if len(codes) <= most:
        return codes
    starts = np.linspace(0, len(codes) - SEGMENT, most // SEGMENT).astype(np.int64)
    return codes[(starts[:, None] + np.arange(SEGMENT)).ravel()]


def train(rows: DataFrame, known: Symbols, rounds: int = ROUNDS) -> Hmm:
    """rows: rid and codes of the training documents."""
    import numpy as np

    share = min(1.0, START_DOCS / max(1, rows.count()))
    schema = pa.schema([("rid", pa.int64()), ("codes", pa.binary())])

    def pieces(parts):
        for part in parts:
            found = ((r, spread(np.frombuffer(c.as_py(), dtype="<u4"), START_TOKENS).tobytes()) for r, c in zip(part.column(0).to_pylist(), part.column(1)))
            yield from common.batches(found, schema)

    drawn = rows.where(F.pmod(F.xxhash64(F.lit("start"), "rid"), F.lit(1 << 30)) < share * float(1 << 30))  # about START_DOCS, from all tasks together
    few = common.arrow_map(drawn.select("rid", "codes"), pieces, "rid long, codes binary").collect()
    few.sort(key=lambda r: r.rid)
    model = first_model([np.frombuffer(bytes(r.codes), dtype="<u4").astype(np.int64) for r in few], known.mass)
    for _ in range(rounds if few else 0):
        model = round_of(rows, model, known)
    return model


def log_likelihoods(model: Hmm, texts: list):
    """log10 of each sequence's probability: the scaled forward recursion, segments side by side."""
    import numpy as np

    held = Segments(texts)
    transfers, scales = held.transfers(model)
    _, logs = held.before(model, transfers)
    np.add.at(logs, held.doc, scales)
    return logs


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    import numpy as np

    docs = docs.select("doc_id", "text")
    vocabulary = count_tokens(docs.where(~held_out()))
    known = symbols(vocabulary)
    rows = coded(docs, known)
    model = train(rows.where("NOT held_out").select("rid", "codes"), known, rounds)

    # tokens outside the head meet their counts; none of them is hot, as the head holds what is frequent
    rest = rows.select("rid", F.explode("rest").alias("token"))
    found = rest.join(vocabulary.select("token", "n"), "token", "left")
    tails = found.groupBy("rid").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("tail_log"), F.count("n").alias("tail_known"))

    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("head_known", pa.int64()), ("head_log", pa.float64()), ("model_log", pa.float64())])

    def forward(parts):
        def out():
            for held, texts in groups(parts, 4):
                logs = log_likelihoods(model, texts)
                for (rid, doc_id, is_held, n), codes, log in zip(held, texts, logs):
                    yield rid, doc_id, is_held, n, int(known.known[codes].sum()), float(known.head_logs[codes].sum()), float(log - known.share_logs[codes].sum())

        yield from common.batches(out(), schema)

    scored = common.arrow_map(rows.select("rid", "doc_id", "held_out", "n", "codes"), forward, "rid long, doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, model_log double")
    tail = F.coalesce("tail_log", F.lit(0.0))
    return scored.join(tails, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("head_log") + tail - F.col("n_tokens") * F.lit(known.base_log)).alias("base_score"),
        (F.col("model_log") + tail).alias("score"),
    )
