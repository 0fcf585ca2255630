"""Slots for models with deterministic stand-ins that need none.

The stand-ins don't reach a trained model's quality; they make every plan run
and testable offline.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import now_iso, random_id, tokens

#: Numbers of a vector.
DIMENSION = 384


def hashed_encoder(text: Column, dimension: int = DIMENSION) -> Column:
    """Unit vectors of signed hashed words: hashed by built-in functions, counted an Arrow batch at a time.

    Where all signs cancel out, words count without them, so that only a text without words has a zero vector."""

    @F.pandas_udf("array<float>")
    def counted(hashes: pd.Series) -> pd.Series:
        out = []
        for h in hashes:
            h = np.asarray(h, dtype=np.int64)
            v = np.bincount(h % dimension, weights=np.where(h > 0, 1.0, -1.0), minlength=dimension)
            if not v.any():
                v = np.bincount(h % dimension, minlength=dimension)
            out.append((v / (np.linalg.norm(v) or 1.0)).astype(np.float32))
        return pd.Series(out)

    return counted(F.transform(tokens(text), lambda w: F.xxhash64(w)))


def encode_with(docs: DataFrame, encode: Callable[[list[str]], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, vector) by a model: encode takes texts and gives rows, which are scaled to unit length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = np.asarray(encode(frame[text].fillna("").tolist()), dtype=np.float32)
            rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({key: frame[key], "vector": list(rows)})

    return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, vector array<float>")


def rerank_with(pairs: DataFrame, predict: Callable[[list[tuple[str, str]]], np.ndarray]) -> DataFrame:
    """pairs with a score of (query, text) by a cross-encoder."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(score=np.asarray(predict(list(zip(frame["query"], frame["text"]))), dtype=np.float64))

    return pairs.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes) + ", score double")


def chat(system: str, text: str) -> list[dict[str, str]]:
    """The messages of one run."""
    return [{"role": "system", "content": system}, {"role": "user", "content": f"INPUT (TOP-Text): {text}"}]


def request(model: str, given: str | list[dict[str, str]], stream: bool = False, options: dict | None = None) -> tuple[str, dict]:
    """(path, body) of a request: messages go to the chat, a text to completion."""
    body = {"model": model, **({"messages": given} if isinstance(given, list) else {"prompt": str(given)}), "stream": stream}
    return "/api/chat" if isinstance(given, list) else "/api/generate", body | ({"options": options} if options else {})


def run_llm(items: DataFrame, complete: Callable[[list[dict[str, str]]], dict], system: str, model: str, version: str, params: dict[str, float] | None = None) -> DataFrame:
    """A log row for each of items (meeting_date, top_id, user_input).

    complete takes messages and gives output_text and, if it knows them, input_tokens and output_tokens. The row has a
    random id, the time, the hash of the input, the output, its JSON or an error, the milliseconds and the tokens."""
    given = {"temperature": 0.2} if params is None else params

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame.user_input.fillna(""):
                began = time.monotonic()
                found = complete(chat(system, text))
                rows.append((found.get("output_text"), int(1000 * (time.monotonic() - began)), found.get("input_tokens"), found.get("output_tokens")))
            more = pd.DataFrame(rows, columns=["output_text", "latency_ms", "input_tokens", "output_tokens"], index=frame.index)
            yield pd.concat([frame, more], axis=1)

    logged = items.select("meeting_date", "top_id", "user_input").mapInPandas(run, "meeting_date string, top_id string, user_input string, output_text string, latency_ms long, input_tokens long, output_tokens long")
    parsed = F.try_parse_json("output_text")
    return logged.select(
        random_id().alias("run_id"), F.lit(model).alias("model"), now_iso().alias("created_at"), F.lit(version).alias("prompt_version"), F.lit(system).alias("system_prompt"),
        "user_input", F.sha2("user_input", 256).alias("input_hash"), F.create_map(*[F.lit(x) for k, v in given.items() for x in (k, float(v))]).alias("params"), "output_text",
        F.when(parsed.isNotNull(), F.col("output_text")).alias("output_json"), "latency_ms", "input_tokens", "output_tokens", F.when(parsed.isNull(), "not JSON").alias("error"),
        F.struct("meeting_date", "top_id").alias("meta"), F.concat_ws("_", "meeting_date", "top_id", F.lit(version), F.lit(model)).alias("run_key"),
    )
