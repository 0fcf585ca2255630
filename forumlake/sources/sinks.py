"""Writers: upserts by key and adding only what is new, as tables of versions, and partitioned logs.

A table is a log of deltas: a write adds a folder with its own rows, dealt out in
folders by a hash of the key, and publishes a version that names the deltas in
force. Readers put them over each other; earlier versions stay readable, and a
write that fails changes nothing. After DELTAS of them the deltas are merged into
one, with more buckets if the table has grown.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..operators.sequences import latest
from . import versions

#: Rows of a bucket and of a task that writes one, about; buckets at most; deltas that are read together at most.
BUCKET_ROWS, TASK_ROWS, BUCKETS, DELTAS = 200_000, 1_000_000, 4096, 8


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _buckets(n: int) -> int:
    return min(BUCKETS, 1 << max(0, math.ceil(math.log2(max(1, n / BUCKET_ROWS)))))


def _folder(path: str, name: str) -> str:
    return f"{path}/rows/delta={versions.number(name)}/writer={name}"


def _deltas(spark: SparkSession, path: str, content: dict) -> DataFrame:
    """The rows of all deltas in force, with delta and bucket."""
    kept = content["deltas"]
    schema = StructType.fromJson(content["schema"]).add(StructField("delta", IntegerType())).add(StructField("bucket", IntegerType()))
    if not kept:
        return spark.createDataFrame([], schema)
    found = [_folder(path, d["name"]) for d in kept]
    return spark.read.option("basePath", f"{path}/rows").schema(schema.add(StructField("writer", StringType()))).parquet(*found).drop("writer")


def _merged(rows: DataFrame, content: dict) -> DataFrame:
    if content["written"] and len(content["deltas"]) > 1:
        rows = latest(rows, content["key"], [F.desc(content["written"]), F.desc("delta")])
    return rows.drop("delta", "bucket")


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The table at path in its latest version or another one; None before its first write."""
    content = versions.read(spark, path, version)
    return None if content is None else _merged(_deltas(spark, path, content), content)


def _schema(rows: DataFrame, content: dict | None) -> dict:
    """The columns so far, then new ones."""
    known = StructType.fromJson(content["schema"]).fields if content else []
    names = {f.name for f in known}
    return json.loads(StructType([*known, *[StructField(f.name, f.dataType) for f in rows.schema.fields if f.name not in names]]).json())


def _write(rows: DataFrame, path: str, name: str, key: list[str], buckets: int, n: int, batch: int | None = None) -> dict:
    """Write a delta of about n rows; its name and rows."""
    folder = _folder(path, name)
    tasks = F.pmod(F.xxhash64(*key, F.lit(1)), F.lit(max(1, math.ceil(n / buckets / TASK_ROWS))))
    options = {"maxRecordsPerFile": str(batch)} if batch else {}
    dealt = rows.withColumn("bucket", _bucket(key, buckets)).repartition("bucket", tasks)
    dealt.write.options(**options).partitionBy("bucket").parquet(folder)
    return {"name": name, "n": rows.sparkSession.read.schema("bucket int").parquet(folder).count()}


def create(path: str, empty: DataFrame) -> None:
    """The table at the path with the columns of an empty one, unless it is there."""
    spark = empty.sparkSession
    if versions.read(spark, path) is None:
        versions.publish(spark, path, {"version": 1, "schema": _schema(empty, None), "key": None, "written": None, "buckets": None, "deltas": []})


def upsert(rows: DataFrame, path: str, key: list[str], written: str, batch: int | None = None) -> None:
    """Puts rows over those of the same key in the table at path; the last written row of a key stays, of equal ones the one that came later.

    Only the rows are written. batch: rows of a file at most."""
    spark, content, name = rows.sparkSession, versions.read(rows.sparkSession, path), versions.draft(rows.sparkSession, path)
    last = content or {"deltas": [], "buckets": None}
    n = rows.count() if not last["deltas"] else last["deltas"][-1]["n"]
    buckets = last["buckets"] or _buckets(n)
    delta = _write(latest(rows, key, [F.desc(written)]), path, name, key, buckets, n, batch)
    content = {"version": versions.number(name), "schema": _schema(rows, content), "key": key, "written": written, "buckets": buckets, "deltas": [*last["deltas"], delta]}
    versions.publish(spark, path, content)
    if len(content["deltas"]) > DELTAS:
        compact(spark, path, batch)


def compact(spark: SparkSession, path: str, batch: int | None = None) -> None:
    """One delta in place of all, in as many buckets as its rows need; earlier versions can still be read."""
    content, name = versions.read(spark, path), versions.draft(spark, path)
    if not content["deltas"]:
        return
    n = sum(d["n"] for d in content["deltas"])
    buckets = _buckets(n)
    delta = _write(_merged(_deltas(spark, path, content), content), path, name, content["key"], buckets, n, batch)
    versions.publish(spark, path, {**content, "version": versions.number(name), "buckets": buckets, "deltas": [delta]})


def upsert_vectors(points: DataFrame, path: str, key: str = "id") -> None:
    """Vectors with their payload by key, in files of VECTORS rows."""
    upsert(points, path, [key], "written", VECTORS)


#: Vectors of a file at most.
VECTORS = 100_000


def append_new(rows: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Appends the rows whose key the table hasn't yet, once each, and returns them.

    Only the buckets of the rows' keys are read of the table."""
    spark, content, name = rows.sparkSession, versions.read(rows.sparkSession, path), versions.draft(rows.sparkSession, path)
    last = content or {"deltas": [], "buckets": None, "written": None}
    new = rows.dropDuplicates(key)
    n = new.count()
    buckets = last["buckets"] or _buckets(n)
    if last["deltas"]:
        touched = [r.bucket for r in new.select(_bucket(key, buckets).alias("bucket")).distinct().collect()]  # BUCKETS at most
        new = new.join(_deltas(spark, path, last).filter(F.col("bucket").isin(touched)).select(*key), key, "left_anti")
    delta = _write(new.select(*rows.columns), path, name, key, buckets, n)
    content = {"version": versions.number(name), "schema": _schema(rows, content), "key": key, "written": last["written"], "buckets": buckets, "deltas": [*last["deltas"], *([delta] if delta["n"] else [])]}
    if delta["n"] or not last["deltas"]:
        versions.publish(spark, path, content)
    if len(content["deltas"]) > DELTAS:
        compact(spark, path)
    return _deltas(spark, path, {**content, "deltas": [delta]}).select(*rows.columns)


def log(rows: DataFrame, path: str, by: list[str], kind: str = "json") -> None:
    """A log in folders by the given columns."""
    rows.write.mode("append").partitionBy(*by).format(kind).save(path)


def snapshots(pages: DataFrame, path: str) -> None:
    """Raw pages by the day they were fetched."""
    pages.withColumn("day", F.to_date("fetched_at")).write.mode("append").partitionBy("day").parquet(path)


def attachments(files: DataFrame) -> DataFrame:
    """Where attachments (url, label, content_type, saved_at) go: year and month, the address's id or else the start of its SHA-1, and a clean name."""
    from ..functions.text import extension, query_parameter, sanitize_filename, short_sha1

    url = F.col("url")
    key = F.coalesce(query_parameter(url, "id"), short_sha1(url))
    name = F.concat(key, F.lit("_"), sanitize_filename(F.coalesce(F.nullif("label", F.lit("")), F.lit("Dokument"))), extension(F.col("content_type"), url))
    return files.withColumns({"id": key, "type": query_parameter(url, "type"), "path": F.concat_ws("/", F.date_format("saved_at", "yyyy/MM"), name)})


def save_attachments(files: DataFrame, path: str) -> DataFrame:
    """Writes the records of attachments, with their contents if they have any, whose place isn't taken yet, and returns those written."""
    return append_new(attachments(files), path, ["path"])


def keyword_index(docs: DataFrame, path: str) -> None:
    """Puts chunks into the index for keyword search by their id, or begins it."""
    from ..operators.keyword import build_index, update_index

    (update_index if versions.numbers(docs.sparkSession, path) else build_index)(docs, path)


def llm_log(runs: DataFrame, path: str) -> None:
    """Runs of a model by version of the prompt and model."""
    log(runs, path, ["prompt_version", "model"], "parquet")
