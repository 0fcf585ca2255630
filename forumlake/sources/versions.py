"""Versions of a stored table: which of its folders are in force, as small files that are swapped in at once.

A writer puts its rows into a folder of its own and then publishes the next
version, a file that names all folders in force. Readers take the latest version,
or an earlier one. A write that fails leaves a folder that no version names. Of
two writers that publish the same number the second gets an error.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has published this version."""


def _files(spark: SparkSession, path: str):
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return of, of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The versions of the table at path, in order; none before its first write."""
    folder, files = _files(spark, f"{path}/versions")
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def draft(spark: SparkSession, path: str) -> str:
    """The name of a folder for the next version, its number first, that no other writer has."""
    return f"{max(numbers(spark, path), default=0) + 1}-{uuid.uuid4().hex}"


def number(name: str) -> int:
    """The number that a folder's name begins with."""
    return int(name.split("-")[0])


def read(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What a version says, the latest one unless told otherwise; None before the first write."""
    known = numbers(spark, path)
    if not known:
        return None
    version = known[-1] if version is None else version
    if version not in known:
        raise ValueError(f"{path} has no version {version}")
    file, files = _files(spark, f"{path}/versions/{version:010d}.json")
    stream = files.open(file)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, content: dict) -> None:
    """Makes content, with its number under version, the latest version."""
    jvm, name = spark.sparkContext._jvm, f"{content['version']:010d}.json"
    draft, files = _files(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(_files(spark, f"{path}/versions/{name}")[0]), plain)
    except Exception as e:
        files.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"{path}: version {content['version']} is there already") from e
        raise


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that no version in use names."""
    of, files = _files(spark, folder)
    files.delete(of, True)
