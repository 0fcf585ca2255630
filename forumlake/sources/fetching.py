"""Fetching pages: addresses of a table through a cache, and numbered addresses as a data source, in batch and as a stream.

A transport is a function of an address and a timeout that gives a status and
bytes; http() is one, tests and replays pass their own. Bytes are read as UTF-8
whatever the server says. What isn't a status from 200 to 299 is a row with an
error and no text, so that one address never stops the rest.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import sinks
from .store import new_folder

Transport = Callable[[str, float], tuple[int, bytes]]
#: Seconds to wait for an answer; addresses of a partition of numbered ones.
TIMEOUT, NUMBERS = 30.0, 50
#: What fetching gives for each address.
PAGE = "url string, status int, text string, error string, fetched_at timestamp"


def http(url: str, timeout: float) -> tuple[int, bytes]:
    """The transport of the web."""
    from urllib.error import HTTPError
    from urllib.request import urlopen

    try:
        with urlopen(url, timeout=timeout) as answer:  # noqa: S310
            return answer.status, answer.read()
    except HTTPError as e:
        return e.code, b""


def _page(url: str, transport: Transport, timeout: float) -> tuple[str, int | None, str | None, str | None, datetime.datetime]:
    status, text, error = None, None, None
    try:
        status, body = transport(url, timeout)
        if 200 <= status < 300:
            text = body.decode("utf-8", "replace")
        else:
            error = f"status {status}"
    except Exception as e:  # noqa: BLE001  any failure of one address is its row's error
        error = f"{type(e).__name__}: {e}"
    return url, status, text, error, datetime.datetime.now(datetime.timezone.utc)


def fetch(urls: DataFrame, transport: Transport = http, timeout: float = TIMEOUT) -> DataFrame:
    """(url, status, text, error, fetched_at) of the distinct addresses (url), each asked for once by the task that has it."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.timestamp("us", tz="UTC"))
        for batch in batches:
            for url in batch.column("url").to_pylist():  # a page at a time, since pages can be large
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(_page(url, transport, timeout), kinds)], ["url", "status", "text", "error", "fetched_at"])

    return urls.select("url").filter("url IS NOT NULL").distinct().mapInArrow(ask, PAGE)


def recorded(pages: DataFrame, order: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """A fetcher from pages that were fetched before (url, status, body): addresses without one are errors.

    Of several of one address it is the first by a column's order, ties and no column by status and body, so that every run gives the same."""
    by = F.struct(*([order] if order else []), "status", "body")
    first = pages.groupBy("url").agg(F.min(by).alias("p")).select("url", "p.status", "p.body")

    def ask(urls: DataFrame) -> DataFrame:
        found = urls.select("url").filter("url IS NOT NULL").distinct().join(first, "url", "left")
        good = F.col("status").between(200, 299)
        error = F.when(F.col("status").isNull(), F.lit("not recorded")).when(~good, F.concat(F.lit("status "), F.col("status").cast("string")))
        return found.select("url", F.col("status").cast("int").alias("status"), F.when(good, F.decode("body", "UTF-8")).alias("text"), error.alias("error"), F.current_timestamp().alias("fetched_at"))

    return ask


def fetch_cached(urls: DataFrame, cache: str, days: float, fetcher: Callable[[DataFrame], DataFrame] = fetch) -> DataFrame:
    """(url, status, text, error, fetched_at, from_cache) of the addresses: those that the cache has had without an error within so many days come from it.

    The cache is a table of versions at a path; what is fetched is put there before it is returned, so that a later run doesn't ask again."""
    spark = urls.sparkSession
    began = datetime.datetime.now(datetime.timezone.utc)
    known, wanted = sinks.read(spark, cache), urls.select("url").filter("url IS NOT NULL").distinct()
    missing = wanted
    if known is not None:
        fresh = known.filter(F.col("error").isNull() & (F.col("fetched_at") >= F.lit(began - datetime.timedelta(days=days))))
        missing = wanted.join(fresh.select("url"), "url", "left_anti")
    folder = new_folder(spark, "fetched")  # written once, so that nothing is asked for twice
    fetcher(missing).write.parquet(folder)
    got = spark.read.schema(PAGE).parquet(folder)
    if known is None or not got.isEmpty():
        sinks.upsert(got, cache, ["url"], "fetched_at")
    asked = got.select("url", F.lit(False).alias("_cached"))
    rows = wanted.join(sinks.read(spark, cache), "url").join(asked, "url", "left")
    return rows.select("url", "status", "text", "error", "fetched_at", F.coalesce("_cached", F.lit(True)).alias("from_cache"))


def follow(spark: SparkSession, source: str, cache: str, checkpoint: str, days: float, fetcher: Callable[[DataFrame], DataFrame] = fetch):
    """A query that fetches the addresses (url) of files that arrive in a folder into the cache; started with all that is there."""

    def take(batch: DataFrame, _: int) -> None:
        fetch_cached(batch, cache, days, fetcher)

    stream = spark.readStream.schema("url string").parquet(source)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Numbers(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


def _partitions(first: int, end: int) -> list[_Numbers]:
    return [_Numbers(a, min(end, a + NUMBERS)) for a in range(first, end, NUMBERS)]


def numbered(transport: Transport = http, name: str = "numbered_pages") -> type[DataSource]:
    """A data source of pages whose addresses hold a number, such as a year or an id: options template (with {n}), first and last.

    As a stream its offset is the number that comes next: a query that is started again goes on where its checkpoint says, and a larger last adds the new numbers only."""

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.template, self.timeout = options["template"], float(options.get("timeout", TIMEOUT))
            self.first, self.end = int(options["first"]), int(options["last"]) + 1

        def partitions(self):
            return _partitions(self.first, self.end)

        def read(self, partition):
            for n in range(partition.first, partition.end):
                yield (n, *_page(self.template.replace("{n}", str(n)), transport, self.timeout))

    class StreamReader(DataSourceStreamReader):
        def __init__(self, options):
            self.reader = Reader(options)

        def initialOffset(self):  # noqa: N802
            return {"next": self.reader.first}

        def latestOffset(self, *_):  # noqa: N802
            return {"next": self.reader.end}

        def partitions(self, start, end):
            return _partitions(start["next"], end["next"])

        def read(self, partition):
            return self.reader.read(partition)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return f"n int, {PAGE}"

        def reader(self, schema):
            return Reader(self.options)

        def streamReader(self, schema):  # noqa: N802
            return StreamReader(self.options)

    return Source
