"""Fixed-width corpora, logs, boosted-tree dumps, matrices and caches, as Spark sources and sinks."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.binning import build_edges, every, stride_for
from ..operators.residuals import Model, compute_residuals
from . import chunks, storage

VERDICT = "position long, id string, outcome string, delta double, incumbent string, at_unix long, host string, inputs int, outputs int, members array<string>, parts string, notes array<string>"
#: Bytes of a file that one task decodes, about.
SPLIT_BYTES = 64 << 20


def read_records(spark: SparkSession, path: str, inputs: int, outputs: int) -> DataFrame:
    """Headerless little-endian FLOAT records: record_id (over all files in the order of their paths), file, number (in its file), f0.., y0...

    Only lengths are listed; each task opens its files and reads a range of records of about SPLIT_BYTES, so a corpus
    in one large file is read by many tasks. A file of another length is an error.
    """
    width = inputs + outputs
    size, step = 4 * width, max(1, SPLIT_BYTES // (4 * width))
    sizes = spark.read.format("binaryFile").load(path).select("path", "length")
    odd = sizes.where(F.col("length") % size != 0).select("path").take(1)
    if odd:
        raise ValueError(f"{odd[0].path} holds no whole number of records")
    names = [f"f{i}" for i in range(inputs)] + [f"y{i}" for i in range(outputs)]
    counted = sizes.select("path", F.expr(f"length div {size}").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row for each file
    splits = counted.withColumn("before", before).where("n > 0").select("path", "n", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))).alias("first"))

    def read(split):
        import numpy as np
        from pyarrow import fs

        name, first, end = split["path"], split["first"], min(split["n"], split["first"] + step)
        files, inner = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name)
        with files.open_input_file(inner) as source:
            for at in range(first, end, 65_536):
                source.seek(at * size)
                some = np.frombuffer(source.read(min(65_536, end - at) * size), dtype="<f4").reshape(-1, width)
                places = np.arange(at, at + len(some))
                yield {"record_id": places + split["before"], "file": [name] * len(some), "number": places} | {c: np.ascontiguousarray(some[:, i]) for i, c in enumerate(names)}  # NaN stays NaN

    schema = "record_id long, file string, number long, " + ", ".join(f"{n} float" for n in names)
    tasks = max(1, splits.count())
    return chunks.frame(splits.repartitionByRange(tasks, "path", "first"), read, schema)


def write_records(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """The reverse, for one local file: a fixture writer."""
    import numpy as np

    np.array([tuple(r) for r in rows.select(*columns).toLocalIterator()], dtype="<f4").tofile(path)


def row_hash(columns: Sequence[str], salt: int):
    return F.xxhash64(F.lit(salt), *columns).cast("decimal(38,0)")


def checksum_of(columns: Sequence[str]):
    """A hash of rows in any order, of which repeated ones count as often as they are there: two sums of their hashes."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(F.sum(row_hash(columns, salt)), F.lit(0)).cast("string") for salt in (1, 2)]), 256)


def corpus_info(corpus: DataFrame) -> DataFrame:
    """records, keys, first_key, last_key, files and checksum: an order-free hash of all rows."""
    rows = corpus.select("*", F.col("_metadata.file_path").alias("_file")) if "_file" not in corpus.columns and has_files(corpus) else corpus.withColumn("_file", F.lit(None).cast("string"))
    return rows.agg(
        F.count("*").alias("records"),
        F.countDistinct("record_id").alias("keys"),
        F.min("record_id").alias("first_key"),
        F.max("record_id").alias("last_key"),
        F.countDistinct("_file").alias("files"),
        checksum_of([c for c in corpus.columns if c != "_file"]).alias("checksum"),
    )


def has_files(df: DataFrame) -> bool:
    """Whether a frame is read straight from files, so that it knows where its rows are from."""
    try:
        df.select("_metadata.file_path")
        return True
    except AnalysisException:
        return False


def identity(corpus: DataFrame) -> dict:
    """What tells a corpus from others: a key for caches. One pass whose tasks give a row each; a corpus of files has file_identity, which reads none."""
    r = corpus.agg(F.count("*").alias("records"), checksum_of(corpus.columns).alias("checksum")).first()
    return {"records": r.records, "checksum": r.checksum, "columns": corpus.columns}


def file_identity(spark: SparkSession, path: str) -> dict:
    """What tells the files under a path from others, or from themselves before a change: their names, lengths and times. No data are read."""
    found = storage.listing(spark, path)
    return {"path": path, "files": len(found), "bytes": sum(n for _, n, _ in found), "listing": hashlib.sha256(json.dumps(found).encode()).hexdigest()}


def numbered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """value, path, line (in its file, from 1) and number (over all files in the order of their paths, from 0) of every line of text files, which may be split.

    A split counts its own lines; what the splits before it hold, of its file and of all files, is added. There is one
    row for each split where that is added up, and a split has the size that Spark gives it.
    """
    read = spark.read.option("recursiveFileLookup", True).text(paths)
    lines = read.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    sizes = lines.groupBy("path", "_start").agg(F.count("*").alias("_n"))
    order = W.orderBy("path", "_start").rowsBetween(W.unboundedPreceding, -1)
    own = W.partitionBy("path").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("path", "_start", F.coalesce(F.sum("_n").over(own), F.lit(0)).alias("_own"), F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_all"))
    place = F.row_number().over(W.partitionBy("path", "_start").orderBy("_at"))
    return lines.withColumn("_place", place).join(starts, ["path", "_start"]).select("value", "path", (F.col("_own") + F.col("_place")).alias("line"), (F.col("_all") + F.col("_place") - 1).alias("number"))


#: Where a parsed line that isn't JSON of its schema is kept.
BROKEN = "_broken"


def parsed(lines: DataFrame, schema: str | T.StructType, strict: bool = False) -> DataFrame:
    """Numbered lines with their fields, and the text of those that don't have them (_broken). Empty lines go. strict: whoever asks for a field of such a line gets an error that names its file and number."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    asked = T.StructType([*fields.fields, T.StructField(BROKEN, T.StringType())])
    found = lines.where(F.trim("value") != "").withColumn("_r", F.from_json("value", asked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}))
    if strict:
        fault = F.raise_error(F.concat("path", F.lit(", line "), F.col("line").cast("string"), F.lit(" is malformed: "), F.substring("value", 1, 200)))
        found = found.withColumn("_r", F.when(F.col(f"_r.{BROKEN}").isNotNull(), fault).otherwise(F.col("_r")))
    return found.select(F.col("path").alias("_path"), F.col("line").alias("_line"), F.col("number").alias("_number"), "_r.*")


def read_log(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A log of JSON lines in which a malformed line is an error that names its file and number. _path, _line and _number say where a record is from; they are no part of its schema."""
    return parsed(numbered_lines(spark, path), schema, True).drop(BROKEN)


class LogWriter:
    """Appends records to a run's log, a small file of one line each, numbered on from what the log has; read it with read_log and runlog.LOG."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        there = [int(name.rsplit("/record-", 1)[1].split(".")[0]) for name, _ in storage.matching(spark, f"{self.path}/record-*.json")]
        self.line = max(there, default=-1) + 1

    def append(self, record: str, **fields) -> None:
        while True:  # another writer may take a number meanwhile
            text = json.dumps({"line": self.line, "record": record} | {k: v for k, v in fields.items() if v is not None})
            self.line += 1
            if storage.add_text(self.spark, text + "\n", f"{self.path}/record-{self.line - 1:09d}.json"):
                return


def corpus_folder(root: str, corpus: str) -> str:
    return f"{root.rstrip('/')}/corpus-{corpus}"


#: Endings of files of verdicts, as they are written and as other hosts may have them.
VERDICT_FILES = (".json", ".jsonl", ".json.gz", ".json.zst")


def verdict_files(spark: SparkSession, folder: str) -> list[str]:
    return [path for path, length, _ in storage.listing(spark, folder) if length and path.endswith(VERDICT_FILES)]


def verdicts_in(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The verdicts of some files, with `given`, the position that a line names itself; others have the place of their line: by path, then by line."""
    found = parsed(numbered_lines(spark, paths), VERDICT).where("id IS NOT NULL").withColumnRenamed("position", "given")
    return found.withColumn("position", F.coalesce("given", F.col("_number"))).drop("_path", "_line", "_number", BROKEN)


def read_verdicts(spark: SparkSession, root: str, corpus: str) -> DataFrame:
    """All hosts' verdicts of a corpus; a malformed line counts as none, and without a folder there are none. Verdicts are parted by host: a folder of parts, or one file of lines. A verdict that was filed without a position gets that of its line: by path, then by line, whatever way Spark reads the files."""
    paths = verdict_files(spark, corpus_folder(root, corpus))
    if not paths:
        return spark.createDataFrame([], VERDICT)
    return verdicts_in(spark, paths).select(*COLUMNS)


def corpora_in(spark: SparkSession, root: str) -> list[str]:
    """Names of the corpora that have a folder of verdicts under root, sorted; nothing is read."""
    return [path.rsplit("/corpus-", 1)[1] for path, _ in storage.matching(spark, corpus_folder(root, "*"))]


#: The columns of a verdict.
COLUMNS = [c.split(" ")[0] for c in VERDICT.split(", ")]


def new_part(folder: str) -> str:
    """A folder that sorts after those that were made before."""
    return f"{folder}/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def append_verdicts(verdicts: DataFrame, root: str, corpus: str, host: str) -> None:
    """Append a host's verdicts: a new folder of parts in its own, whole or not at all; later ones sort behind earlier ones."""
    columns = [c for c in COLUMNS if c in (*verdicts.columns, "host")]
    verdicts.withColumn("host", F.lit(host)).select(*columns).write.json(new_part(f"{corpus_folder(root, corpus)}/{host}"))


def prune_verdicts(spark: SparkSession, root: str, corpus: str, host: str, plan: Callable[[DataFrame], DataFrame], dry_run: bool = False) -> dict[str, int]:
    """Rewrite a host's own verdicts by a plan (verdicts with fate; those that are kept stay) and give how many have each fate.

    What is kept is written in its order, sorting before what is appended meanwhile, and then the files that were read are
    deleted, by name: a stop in between leaves some verdicts twice, which the next plan drops, but loses none.
    A position that came from a line isn't written: the kept lines have their order, and what follows comes after.
    """
    folder = f"{corpus_folder(root, corpus)}/{host}"
    read = verdict_files(spark, folder)
    if not read:
        return {}
    aside = new_part(folder)
    planned = plan(verdicts_in(spark, read)).persist()
    counts = {r.fate: r["count"] for r in planned.groupBy("fate").count().collect()}
    if not dry_run and set(counts) - {"kept"}:
        kept = planned.where("fate = 'kept'").repartitionByRange("position").sortWithinPartitions("position")
        kept.select(*[F.col("given").alias(c) if c == "position" else c for c in COLUMNS]).write.json(aside)
        for path in read:
            storage.delete(spark, path)
    planned.unpersist()
    return counts


def export_matrix(corpus: DataFrame, residuals: DataFrame, features: Sequence[str], most: int) -> DataFrame:
    """Features, residual and correction of every k-th record by position, as many as most allows, for other tools."""
    some = every(corpus.select("record_id", *features), stride_for(corpus.count(), most))
    return some.join(residuals.select("record_id", "residual", "correction"), "record_id")


def write_matrix(matrix: DataFrame, path: str, meta: dict) -> None:
    """The matrix as CSV, and beside it what it is (path.meta.json)."""
    matrix.drop("record_id").write.option("header", True).csv(path)
    storage.write_text(matrix.sparkSession, json.dumps(meta | {"columns": [c for c in matrix.columns if c != "record_id"]}), f"{path.rstrip('/')}.meta.json")


def boosted_trees(dump: str, before: bool = True) -> list[dict]:
    """Nodes of a boosted model's JSON dump. Its conditions are x < t for left, ours x > t for right, so t is the float before."""
    import numpy as np

    def node(x: dict) -> dict:
        if "leaf" in x:
            return {"correction": float(np.float32(x["leaf"]))}
        children = {c["nodeid"]: c for c in x["children"]}
        t = np.float32(x["split_condition"])
        t = np.nextafter(t, np.float32(-np.inf)) if before else t
        return {"terms": [(int(str(x["split"]).lstrip("f")), 1.0)], "threshold": float(t), "left": node(children[x["yes"]]), "right": node(children[x["no"]])}

    return [node(x) for x in json.loads(dump)]


def cached(spark: SparkSession, path: str, key: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """A table kept under path for a key; built if it is missing or broken.

    Each key has a folder of its own, which is written aside and renamed when it is complete: a build that stops leaves
    nothing behind that could be read, and no key ever sees another's rows. What isn't there or can't be understood is
    built anew; any other failure to read is an error.
    """
    digest = hashlib.sha256(json.dumps(key, sort_keys=True).encode()).hexdigest()[:32]
    folder = f"{path.rstrip('/')}/{digest}"
    if storage.exists(spark, folder):
        try:
            meta = json.loads(storage.read_text(spark, f"{folder}/meta.json"))
            if meta == key:
                return spark.read.parquet(f"{folder}/data")
        except (AnalysisException, json.JSONDecodeError, AttributeError):  # files or a schema are missing, or the key isn't readable: a broken cache
            pass
        storage.delete(spark, folder)
    aside = f"{path.rstrip('/')}/.{digest}-{uuid.uuid4().hex}"
    build().write.parquet(f"{aside}/data")
    storage.write_text(spark, json.dumps(key), f"{aside}/meta.json")
    storage.publish(spark, aside, folder)
    return spark.read.parquet(f"{folder}/data")


def cached_edges(spark: SparkSession, path: str, corpus: DataFrame, features: Sequence[str], bins: int, version: dict | None = None) -> DataFrame:
    """The corpus's quantile edges, kept by its identity and the number of bins. version: an identity that the caller has already (file_identity); then a hit reads nothing of the corpus."""
    key = {"kind": "edges", "features": list(features), "bins": bins} | (version or identity(corpus.select("record_id", *features)))
    return cached(spark, path, key, lambda: build_edges(corpus, features, bins))


def cached_residuals(spark: SparkSession, path: str, corpus: DataFrame, model: Model, version: dict | None = None) -> DataFrame:
    """The corpus's residuals under a model, kept by its identity (or a version, as of cached_edges) and the model's checksum."""
    key = {"kind": "residuals", "model": model.checksum} | (version or identity(corpus))
    return cached(spark, path, key, lambda: compute_residuals(corpus, model))
