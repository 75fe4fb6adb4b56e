"""Scores from another program: a process for each partition reads records and says what candidates leave of the error.

A task starts the command, writes one JSON line with the candidates and then each record as a line of JSON, and closes
its input. The program answers with one JSON object: {"records": n, "sse": {"baseline": x, "<id>": y, ...}}, over the records
that it got. Answers are checked and added up by candidate in Spark. A program that fails, takes too long or says
anything else fails the whole scoring (ScorerError): no candidate is ever scored over a part of the corpus.
"""

from __future__ import annotations

import json
import math
import subprocess
import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import patches
from .promotion import UNIT_COST, UNITS_OF_SPLIT, Scores


class ScorerError(ValueError):
    """Why a program gave no usable scores."""


def parse_answer(text: str, wanted: Sequence[str], records: int) -> dict[str, float]:
    """The squared errors of an answer, by candidate: exactly those wanted, finite and not below 0, over all the records."""

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ScorerError("a name stands twice in the answer")
        return dict(pairs)

    try:
        found = json.loads(text, object_pairs_hook=once)
    except json.JSONDecodeError as error:
        raise ScorerError(f"the answer is no JSON: {error}") from error
    if not isinstance(found, dict) or set(found) != {"records", "sse"} or not isinstance(found["sse"], dict):
        raise ScorerError("the answer has other fields than records and sse")
    if type(found["records"]) is not int or found["records"] != records:
        raise ScorerError(f"the answer is over {found['records']!r} records, not {records}")
    if odd := sorted(set(found["sse"]) ^ set(wanted)):
        raise ScorerError(f"the answer {'has' if odd[0] in found['sse'] else 'lacks'} {odd[0]!r}")
    for name, value in found["sse"].items():
        if type(value) not in (int, float) or not math.isfinite(value) or value < 0:
            raise ScorerError(f"the error of {name!r} is {value!r}")
    return {k: float(v) for k, v in found["sse"].items()}


def answered(command: Sequence[str], header: str, lines, seconds: float) -> tuple[str, int]:
    """(what the program says, how many lines it was given), or an error: it ends with 0 within so many seconds of reading its last line, or of not reading on."""
    with subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True) as process:
        said: dict[str, str] = {}
        readers = [threading.Thread(target=lambda n=n, f=f: said.update({n: f.read()}), daemon=True) for n, f in (("out", process.stdout), ("err", process.stderr))]
        for r in readers:
            r.start()
        n, expired = 0, []

        def stop():
            expired.append(True)
            process.kill()

        def timed(work):
            timer = threading.Timer(seconds, stop)
            timer.start()
            try:
                return work()
            finally:
                timer.cancel()

        try:
            timed(lambda: process.stdin.write(header + "\n"))
            for some in lines:
                timed(lambda some=some: process.stdin.write("".join(x + "\n" for x in some)))
                n += len(some)
            timed(process.stdin.close)
        except (BrokenPipeError, OSError):
            pass  # it has ended early: its code says how
        timed(process.wait)
        for r in readers:
            r.join(seconds)
        if expired:
            raise ScorerError(f"{command[0]} took more than {seconds} seconds")
        if process.returncode:
            raise ScorerError(f"{command[0]} ended with {process.returncode}: {said.get('err', '')[-500:].strip()}")
        return said.get("out", ""), n


def scorer(command: Sequence[str], columns: Sequence[str], seconds: float = 600.0, carried: int = 0) -> Callable[[DataFrame, Sequence[tuple[str, list[dict]]]], Scores]:
    """A scorer (see promotion) that runs a command on the executors; columns: what of a record it gets. The command has to be there on each of them."""

    def score(rows: DataFrame, candidates: Sequence[tuple[str, list[dict]]]) -> Scores:
        import pyarrow as pa

        listed = list(candidates)
        header = json.dumps({"columns": list(columns), "candidates": [{"id": name, "patches": parts} for name, parts in listed]})
        wanted = ["baseline", *(name for name, _ in listed)]
        schema = pa.schema([("candidate", pa.string()), ("records", pa.int64()), ("sse", pa.float64()), ("fault", pa.string())])

        def make(parts):
            try:
                text, n = answered(command, header, ([json.dumps(list(r)) for r in zip(*(c.to_pylist() for c in part.columns))] for part in parts), seconds)
                out = [(k, n, v, None) for k, v in parse_answer(text, wanted, n).items()]
            except (ScorerError, OSError) as error:  # one answer for all: a job isn't done again for what would fail again
                out = [("", 0, 0.0, str(error))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        made = rows.select(*columns).mapInArrow(make, "candidate string, records long, sse double, fault string")
        found = made.groupBy("candidate").agg(F.sum("records").alias("records"), F.sum("sse").alias("sse"), F.max("fault").alias("fault")).collect()  # a row for each candidate
        if faults := [r.fault for r in found if r.fault]:
            raise ScorerError(faults[0])
        by_id = {r.candidate: r for r in found}
        splits = {name: sum(patches.splits(p) for p in parts) for name, parts in listed} | {"baseline": 0}
        out = {}
        for name in wanted:
            if name not in by_id:
                raise ScorerError(f"no program was asked for {name!r}")
            error = by_id[name].sse / by_id[name].records if by_id[name].records else 0.0
            out[name] = (1 - error - UNIT_COST * UNITS_OF_SPLIT * (carried + splits[name]), error, by_id[name].records)
        return out

    return score
