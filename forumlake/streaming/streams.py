"""Structured Streaming forms of ingestion and chat history, and the projection of token streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window as W

from ..sources.sinks import append_new


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: list[str]):
    """A query that adds rows with a new key from files that arrive in a folder; started with all that is there."""

    def write(batch: DataFrame, _: int) -> None:
        append_new(batch, target, key)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: The state store that keeps lists and timers.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TURNS = "turn long, role string, text string"


class _LastTurns(StatefulProcessor):
    """Keeps the last n turns of a conversation; the store forgets them when they haven't been written for so many milliseconds."""

    def __init__(self, n: int, idle_ms: int | None):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle) -> None:
        self.turns = handle.getListState("turns", _TURNS, self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        kept = [tuple(x) for x in self.turns.get()] if self.turns.exists() else []
        for frame in rows:
            kept += list(zip(frame.turn.astype(int).tolist(), frame.role, frame.text))
        kept = sorted(set(kept), key=lambda x: tuple((v is not None, v or "") if i else v for i, v in enumerate(x)))[-self.n :]
        self.turns.put(kept)
        yield pd.DataFrame({"conv_id": [key[0]] * len(kept), "turn": [x[0] for x in kept], "role": [x[1] for x in kept], "text": [x[2] for x in kept]})

    def close(self) -> None:
        pass


def history(messages: DataFrame, n: int = 20, idle_seconds: float | None = None) -> DataFrame:
    """Of a stream (conv_id, turn, role, text): after each batch the last n turns of the conversations it touched; a turn that comes again counts once.

    A conversation without a new turn for idle_seconds is forgotten. The session is set to the state store that this needs."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    processor = _LastTurns(n, None if idle_seconds is None else int(1000 * idle_seconds))
    rows = messages.select("conv_id", "turn", "role", "text").groupBy("conv_id")
    return rows.transformWithStateInPandas(processor, f"conv_id long, {_TURNS}", "Update", "None" if idle_seconds is None else "ProcessingTime")


def keep_history(messages: DataFrame, checkpoint: str, n: int = 20, idle_seconds: float | None = None):
    """A query that keeps the conversations of a stream in the state below a checkpoint.

    It is started with all that is there and ends with it, or with idle_seconds, which need the clock, runs until it is stopped."""
    writer = history(messages, n, idle_seconds).writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if idle_seconds is None else writer.trigger(processingTime="1 second")).start()


def kept_history(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(conv_id, turn, role, text): the conversations that a query has in its state."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "turns").load()
    turn = "list_element.value.*" if "value" in rows.select("list_element.*").columns else "list_element.*"  # with the time at which it is forgotten
    return rows.select(F.col("key.conv_id").alias("conv_id"), turn)


def fresh(rows: DataFrame, cached: DataFrame, key: list[str], days: int, fetched: str = "fetched_at") -> DataFrame:
    """The rows to fetch: those that the cache (key, time of fetching) hasn't had within so many days."""
    known = cached.filter(F.col(fetched) >= F.current_timestamp() - F.expr(f"INTERVAL {int(days)} DAYS")).select(*key).distinct()
    return rows.join(known, key, "left_anti")


def _joined(kept: DataFrame, delta) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("ord", delta.alias("delta"))))
    return kept.groupBy("stream").agg(F.array_join(F.transform(listed, lambda x: x["delta"]), "").alias("text"))


def _before(lines: DataFrame, done) -> DataFrame:
    """Lines before the first of their stream that ends it, and whether it came."""
    ended = lines.withColumn("done", F.min(F.when(done, F.col("ord"))).over(W.partitionBy("stream")))
    return ended.filter("done IS NULL OR ord < done")


def stream_text(lines: DataFrame, strict: bool = False) -> DataFrame:
    """(stream, text): of lines (stream, ord, line) of server-sent events the tokens before [DONE], joined.

    Lines that aren't JSON are skipped, or fail the query if strict."""
    data = F.regexp_extract("line", r"^data:\s*(.*)$", 1)
    kept = _before(lines.withColumn("data", data), F.col("data") == "[DONE]").filter("data <> ''")
    parsed = F.parse_json("data") if strict else F.try_parse_json("data")
    return _joined(kept, F.try_variant_get(parsed, "$.choices[0].delta.content", "string"))


def ndjson_text(lines: DataFrame) -> DataFrame:
    """(stream, text): of JSON lines the parts of a chat's message or of a completion, up to the one that says done, joined; others are skipped."""
    parsed = lines.withColumn("data", F.try_parse_json("line")).filter("data IS NOT NULL")
    done = F.coalesce(F.try_variant_get("data", "$.done", "boolean"), F.lit(False))
    kept = parsed.withColumn("done", F.min(F.when(done, F.col("ord"))).over(W.partitionBy("stream"))).filter("done IS NULL OR ord <= done")
    return _joined(kept, F.coalesce(F.try_variant_get("data", "$.message.content", "string"), F.try_variant_get("data", "$.response", "string")))


def delta_events(lines: DataFrame) -> DataFrame:
    """(stream, ord, type, delta, response): each part of JSON lines as an event, and after the last one the whole text as completed."""
    whole = ndjson_text(lines)
    parsed = lines.withColumn("data", F.try_parse_json("line")).filter("data IS NOT NULL")
    delta = F.coalesce(F.try_variant_get("data", "$.message.content", "string"), F.try_variant_get("data", "$.response", "string"), F.lit(""))
    parts = parsed.select("stream", "ord", F.lit("response.delta").alias("type"), delta.alias("delta"), F.lit(None).cast("string").alias("response"))
    last = parsed.groupBy("stream").agg((F.max("ord") + 1).alias("ord"))
    return parts.unionByName(last.join(whole, "stream").select("stream", "ord", F.lit("response.completed").alias("type"), F.lit(None).cast("string").alias("delta"), F.col("text").alias("response")))


def to_lines(events: DataFrame) -> DataFrame:
    """(value): every row as a line of JSON, for a response that is streamed."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))
