"""Fetching with a transport of the tests: nothing is asked for twice, errors are rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from forumlake.sources import fetching, sinks


def transport(log):
    """Notes every address in a file; some are missing, broken or not UTF-8."""

    def ask(url, timeout):
        with open(log, "a") as f:
            f.write(url + "\n")
        if url.endswith("missing"):
            return 404, b"gone"
        if url.endswith("broken"):
            raise OSError("no route")
        return 200, f"{url} sagt Grüße ".encode() + (b"\xff" if url.endswith("odd") else b"")

    return ask


def asked(log):
    return sorted(log.read_text().split()) if log.exists() else []


def urls(spark, *names):
    return spark.createDataFrame([(f"http://h/{n}" if n else None,) for n in names], "url string")


def test_fetch(spark, tmp_path):
    log = tmp_path / "log"
    rows = {r.url[9:]: r for r in fetching.fetch(urls(spark, "a", "a", "odd", "missing", "broken", None), transport(str(log))).collect()}
    assert {k: (r.status, r.text, r.error) for k, r in rows.items()} == {
        "a": (200, "http://h/a sagt Grüße ", None), "odd": (200, "http://h/odd sagt Grüße �", None),
        "missing": (404, None, "status 404"), "broken": (None, None, "OSError: no route"),
    }
    assert asked(log) == ["http://h/a", "http://h/broken", "http://h/missing", "http://h/odd"]


def test_cache_and_its_age(spark, tmp_path):
    log, cache = tmp_path / "log", str(tmp_path / "cache")
    fetcher = lambda u: fetching.fetch(u, transport(str(log)))
    first = fetching.fetch_cached(urls(spark, "a", "b", "missing"), cache, 31, fetcher)
    assert first.count() == 3 and first.filter("from_cache").count() == 0 and len(asked(log)) == 3
    second = {r.url[9:]: r.from_cache for r in fetching.fetch_cached(urls(spark, "a", "c", "missing"), cache, 31, fetcher).collect()}
    assert second == {"a": True, "c": False, "missing": False} and asked(log).count("http://h/a") == 1
    again = fetching.fetch_cached(urls(spark, "a", "b"), cache, 31, fetcher)
    assert again.filter("from_cache").count() == 2 and len(asked(log)) == 5
    sinks.upsert(sinks.read(spark, cache).filter("url LIKE '%/a'").withColumn("fetched_at", F.lit(datetime.datetime(2020, 1, 1))).withColumn("fetched_at", F.col("fetched_at").cast("timestamp")), cache + "-old", ["url"], "fetched_at")
    assert fetching.fetch_cached(urls(spark, "a"), cache + "-old", 31, fetcher).first().from_cache is False


def test_stream_of_addresses(spark, tmp_path):
    log, cache = tmp_path / "log", str(tmp_path / "cache")
    fetcher = lambda u: fetching.fetch(u, transport(str(log)))
    for names in (("a", "b"), ("b", "c")):
        urls(spark, *names).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for _ in range(2):  # started again, nothing is asked for twice
            fetching.follow(spark, str(tmp_path / "in"), cache, str(tmp_path / "check"), 31, fetcher).awaitTermination()
    assert asked(log) == ["http://h/a", "http://h/b", "http://h/c"] and sinks.read(spark, cache).count() == 3


def test_numbered_addresses(spark, tmp_path):
    log = tmp_path / "log"
    spark.dataSource.register(fetching.numbered(transport(str(log)), "numbers"))
    options = {"template": "http://h/si0046.asp?__cjahr={n}", "first": "2002", "last": "2061"}
    rows = spark.read.format("numbers").options(**options).load()
    assert rows.rdd.getNumPartitions() == 2 and rows.select("n").distinct().count() == 60
    log.unlink()

    def run(last):
        stream = spark.readStream.format("numbers").options(**{**options, "last": last}).load()
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).format("parquet").start(str(tmp_path / "out"))
        query.processAllAvailable()
        query.stop()

    run("2010")
    run("2010")
    run("2012")
    assert [r.n for r in spark.read.parquet(str(tmp_path / "out")).orderBy("n").collect()] == list(range(2002, 2013))
    assert asked(log) == [f"http://h/si0046.asp?__cjahr={n}" for n in range(2002, 2013)]


def test_web_transport_of_a_local_server():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(404 if "no" in self.path else 200)
            self.end_headers()
            self.wfile.write("Grüße".encode())

        def log_message(self, *_):
            pass

    try:
        server = HTTPServer(("127.0.0.1", 0), Handler)
    except OSError:
        pytest.skip("no local sockets")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert fetching.http(base + "/x", 5) == (200, "Grüße".encode()) and fetching.http(base + "/no", 5)[0] == 404
    server.shutdown()


def test_recording_with_several_pages_of_an_address(spark):
    said = spark.createDataFrame([(9, "u", 404, b"n"), (4, "u", 200, b"b"), (2, "u", 200, b"a"), (8, "w", 200, b"z"), (1, "w", 404, b"y")], "n int, url string, status int, body binary")
    asked_for = spark.createDataFrame([("u",), ("w",), ("x",)], "url string")
    for rows in (said.coalesce(1), said.orderBy("n").coalesce(1), said.repartition(5)):
        found = {r.url: (r.status, r.text) for r in fetching.recorded(rows, "n")(asked_for).collect()}
        assert found == {"u": (200, "a"), "w": (404, None), "x": (None, None)}


def test_first_page_of_an_address_counts_in_sql_too(spark, tmp_path):
    import duckdb

    from forumlake.plans import records

    rows = [(n, f"https://x/{n % 3}", "z" * n) for n in range(40, 0, -1)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    columns = ["url", "status", "error", "from_cache", "n_chars"]
    found = sorted(tuple(r) for r in records.fetched_pages(spark, str(tmp_path)).select(*columns).collect())
    assert found == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({records.SQL['fetched_pages']})").fetchall())
    assert found == [("https://x/0", 200, "", True, 3), ("https://x/1", 200, "", True, 1), ("https://x/2", 200, "", True, 2)]
