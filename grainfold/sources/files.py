"""Files as DataFrames: listing, contents, extraction; and the moves that change a directory.

Listing uses the file system, as Spark's file sources hide names that begin with a dot or a low line.
Contents are read on the executors, from paths that all of them can see.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfold.operators.intake import JUNK
from grainfold.plans.runtime import cut
from grainfold.sources import formats

Skip = Callable[[str, bool], bool]


def walk(root: str, skip: Skip | None = None) -> list[str]:
    """Relative paths of the regular files below a root, in order; links aren't followed, a missing root is empty."""
    out: list[str] = []

    def into(directory: str) -> None:
        for e in sorted(os.scandir(os.path.join(root, directory)), key=lambda e: e.name):
            path = f"{directory}/{e.name}" if directory else e.name
            if skip and skip(path, e.is_dir(follow_symlinks=False)):
                continue
            if e.is_dir(follow_symlinks=False):
                into(path)
            elif e.is_file(follow_symlinks=False):
                out.append(path)

    if os.path.isdir(root):
        into("")
    return out


def list_files(spark: SparkSession, root: str, skip: Skip | None = None) -> DataFrame:
    """(relative_path, absolute_path)."""
    return spark.createDataFrame([(p, os.path.join(root, p)) for p in walk(root, skip)], "relative_path string, absolute_path string")


def read_files(files: DataFrame, path: str = "absolute_path") -> DataFrame:
    """The files with their bytes in ``data``; NULL where one can't be read."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    at = files.columns.index(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one file a batch keeps large files apart
                row = batch.slice(k, 1)
                try:
                    data = Path(row.column(at)[0].as_py()).read_bytes()
                except (OSError, TypeError):
                    data = None
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.binary())], names=[*batch.schema.names, "data"])

    return files.mapInArrow(run, f"{fields}, data binary")


def read_texts(files: DataFrame) -> DataFrame:
    return read_files(files).withColumn("content", F.decode("data", "UTF-8")).drop("data")


IMAGE = pa.struct([("name", pa.string()), ("media", pa.string()), ("data", pa.binary()), ("location", pa.string()), ("context", pa.string())])
EXTRACTED = "key {}, source_format string, parts array<string>, warnings array<string>, images array<struct<name:string,media:string,data:binary,location:string,context:string>>, reason string, detail string"


def extract_documents(df: DataFrame, key: str, path: str, data: str, limits: formats.Limits = formats.Limits(), readers: dict[str, formats.Read] | None = None) -> DataFrame:
    """(key, source_format, parts, warnings, images, reason, detail) of documents given as bytes; a failure is a row, never an error.

    ``readers`` by suffix are added to those of the library, or take their place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ident, name, content = (c[k].as_py() for c in batch.columns)
                base = os.path.basename(name or "")
                found, reason, detail = formats.extract(content, os.path.splitext(base)[1], limits, readers)
                images = [{"name": i.name, "media": i.media, "data": i.data, "location": i.location, "context": i.context} for i in found.images] if found else None
                cols = [pa.array([ident], batch.schema.types[0]), pa.array([found.format if found else None], pa.string()), pa.array([found.parts if found else None], pa.list_(pa.string())), pa.array([found.warnings if found else None], pa.list_(pa.string())), pa.array([images], pa.list_(IMAGE)), pa.array([reason], pa.string()), pa.array([detail], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "source_format", "parts", "warnings", "images", "reason", "detail"])

    return df.select(F.col(key), F.col(path), F.col(data)).mapInArrow(run, EXTRACTED.format(df.schema[key].dataType.simpleString())).withColumnRenamed("key", key)


def write_text(path: str, content: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(content, encoding="utf-8")


def write_texts(df: DataFrame, root: str) -> None:
    """Write every row (relative_path, content) below a root that all executors share."""

    def run(rows: Iterator) -> None:
        for r in rows:
            write_text(os.path.join(root, r["relative_path"]), r["content"])

    df.select("relative_path", "content").foreachPartition(run)


def attempted(df: DataFrame, act: Callable[[str, str], object]) -> DataFrame:
    """(source, target, error) after ``act`` was applied to every (source, target) on the executors; error is NULL where it went well.

    The directories of targets are made. A pair that an earlier attempt of a task has done is done.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for source, target in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    if os.path.lexists(source) or not os.path.lexists(target):
                        Path(target).parent.mkdir(parents=True, exist_ok=True)
                        act(source, target)
                    errors.append(None)
                except (OSError, shutil.Error) as e:
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(errors, pa.string())], names=["source", "target", "error"])

    # Written at once, as the files change with it.
    return cut(df.select("source", "target").mapInArrow(run, "source string, target string, error string"))


def move_files(df: DataFrame) -> DataFrame:
    return attempted(df, shutil.move)


def copy_files(df: DataFrame) -> DataFrame:
    return attempted(df, shutil.copyfile)


def remove_files(df: DataFrame, path: str = "absolute_path") -> None:
    """Delete files on the executors; those that are gone are no error."""

    def run(rows: Iterator) -> None:
        for r in rows:
            Path(r[path]).unlink(missing_ok=True)

    df.select(path).foreachPartition(run)


def remove_directory(path: str) -> None:
    shutil.rmtree(path, ignore_errors=True)


def write_binaries(df: DataFrame, root: str) -> None:
    """Write every row (relative_path, data) below a root that all executors share."""

    def run(rows: Iterator) -> None:
        for r in rows:
            path = Path(root, r["relative_path"])
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(r["data"])

    df.select("relative_path", "data").foreachPartition(run)


def is_junk(name: str) -> bool:
    return name in JUNK or (name.startswith("._") and len(name) > 2)


def remove_junk(root: str) -> list[str]:
    gone = [p for p in walk(root) if is_junk(os.path.basename(p))]
    for p in gone:
        os.unlink(os.path.join(root, p))
    return gone


def remove_empty_dirs(root: str) -> list[str]:
    """Directories without any file, from the leaves up; the root stays."""
    gone = []
    for directory, _, _ in os.walk(root, topdown=False):
        if directory != root and not os.listdir(directory):
            os.rmdir(directory)
            gone.append(os.path.relpath(directory, root))
    return gone
