"""What files need besides reading and writing rows: listing, renaming and deleting, wherever the session's paths lead."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def of(spark: SparkSession, path: str):
    """(file system, path) of a path, as Spark itself opens it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = of(spark, path)
    return fs.exists(at)


def matching(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """(path, length) of what a pattern matches, sorted by path."""
    fs, at = of(spark, pattern)
    return sorted((s.getPath().toString(), s.getLen()) for s in fs.globStatus(at) or ())


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of every file under a path, sorted by path; hidden ones, as Spark sees them, left out."""
    fs, at = of(spark, path)
    if not fs.exists(at):
        return []
    found, files = [], fs.listFiles(at, True)
    while files.hasNext():
        s = files.next()
        if not s.getPath().getName().startswith(("_", ".")):
            found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(found)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = of(spark, path)
    fs.delete(at, True)


def publish(spark: SparkSession, made: str, path: str) -> None:
    """Rename what is complete to where it is looked for; an error if something is there."""
    fs, at = of(spark, path)
    fs.mkdirs(at.getParent())
    if fs.exists(at) or not fs.rename(of(spark, made)[1], at):
        raise FileExistsError(path)


def put(spark: SparkSession, text: str, path: str) -> None:
    fs, at = of(spark, path)
    fs.mkdirs(at.getParent())
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small file, written aside and renamed over any that is there in one step: whoever reads it finds the one before or the new one."""
    aside = f"{path}.{uuid.uuid4().hex}"
    put(spark, text, aside)
    fs, hadoop = of(spark, path)[0], spark._jvm.org.apache.hadoop.fs
    kinds = getattr(hadoop, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kinds, 1)
    over[0] = kinds.OVERWRITE
    made, at = (fs.makeQualified(of(spark, p)[1]) for p in (aside, path))
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(made, at, over)


def add_text(spark: SparkSession, text: str, path: str) -> bool:
    """A small file under a name that isn't taken; False if it is."""
    aside = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    put(spark, text, aside)
    fs, at = of(spark, path)
    done = not fs.exists(at) and fs.rename(of(spark, aside)[1], at)
    if not done:
        fs.delete(of(spark, aside)[1], False)
    return done


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    return spark.read.option("wholetext", True).text(path).first().value
