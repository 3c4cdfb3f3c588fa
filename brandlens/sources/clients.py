"""Fetching pages and asking models: injected clients, retries and backoff inside, run in Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls as U
from ..shipping import ship

#: (status, body) or (status, body, headers) of a URL, or an exception.
Fetch = Callable[[str], tuple]
#: The text of an answer, or (text, finish reason), or an exception; no text where the model gave none.
Ask = Callable[[str], str | tuple | None]


class ApiError(RuntimeError):
    """What a model's service said instead of an answer; 429 and 5xx are worth another try."""

    def __init__(self, status: int, message: str | None = None):
        super().__init__(message or f"HTTP {status}")
        self.again = status == 429 or status >= 500


def _now() -> str:
    return datetime.now(UTC).isoformat()


def _within(seconds: float | None, call: Callable, *args):
    """call(*args), or TimeoutError after so many seconds; what still runs then is left behind."""
    if seconds is None:
        return call(*args)
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(call, *args).result(seconds)
    finally:
        pool.shutdown(wait=False)


def fetch_page(url: str, fetch: Fetch, retries: int = 2, timeout: float | None = None, wait: Callable[[float], None] = time.sleep) -> tuple[int | None, str, str | None, dict]:
    """(status, html, error, headers): 5xx, exceptions and timeouts are tried again, 4xx comes back with an error,
    failure has no status."""
    error = None
    for n in range(retries + 1):
        try:
            status, body, *more = _within(timeout, fetch, url)
            if status < 500:
                return status, body, f"HTTP {status}" if status >= 400 else None, more[0] if more else {}
            error = f"HTTP {status}"
        except Exception as e:  # noqa: BLE001 - any failure of a client counts as one try
            error = str(e) or type(e).__name__
        if n < retries:
            wait(0.3 * 2**n)
    return None, "", error, {}


def crawl(urls: DataFrame, fetch: Fetch, tasks: int = 8, retries: int = 2, timeout: float | None = 10.0, delay: float = 0.0) -> DataFrame:
    """(ord, url, url_hash, status, headers, fetched_at, error, html) for allowed URLs (ord, url); filter by robots
    before this. Every task waits ``delay`` seconds after each page."""
    ship(urls.sparkSession)
    schema = "ord long, url string, status int, headers map<string,string>, fetched_at string, error string, html string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ord, url in zip(batch["ord"], batch["url"]):
                status, html, error, headers = fetch_page(url, fetch, retries, timeout)
                rows.append((ord, url, status, headers, _now(), error, html))
                time.sleep(delay)
            out = pd.DataFrame(rows, columns=["ord", "url", "status", "headers", "fetched_at", "error", "html"])
            yield out.astype({"status": "Int32"})

    found = urls.select("ord", "url").repartition(tasks, "url").mapInPandas(run, schema)
    return found.select("ord", "url", U.url_hash(F.col("url")).alias("url_hash"), "status", "headers", "fetched_at", "error", "html")


def robots_text(site: str, fetch: Fetch) -> str:
    """The robots file of a site; whatever goes wrong, nothing is forbidden."""
    try:
        status, body, *_ = fetch(site.rstrip("/") + "/robots.txt")
        return body if status == 200 else ""
    except Exception:  # noqa: BLE001
        return ""


def documents(urls: DataFrame, fetch: Fetch) -> DataFrame:
    """(url, xml) of the URLs that answer with 200."""
    return crawl(urls, fetch).where("status = 200").select("url", F.col("html").alias("xml"))


def ask_model(prompt: str, ask: Ask, retries: int = 2, timeout: float | None = None, wait: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, str | None]:
    """(text, finish reason, error). Refusals other than 429 and 5xx are final; all else is tried again."""
    error = None
    for n in range(retries + 1):
        try:
            got = _within(timeout, ask, prompt)
            text, reason = got if isinstance(got, tuple) else (got, None)
            return text, reason, None
        except ApiError as e:
            error = str(e)
            if not e.again:
                return None, None, error
        except Exception as e:  # noqa: BLE001
            error = str(e) or type(e).__name__
        if n < retries:
            wait(0.5 * 2**n)
    return None, None, error


def with_repetitions(prompts: DataFrame, runs: int) -> DataFrame:
    """Prompts (id, text, ...) as (prompt_id, prompt_text, ..., rep), ``runs`` rows each."""
    rest = [c for c in prompts.columns if c not in ("id", "text", "ord")]
    return prompts.select(F.col("id").alias("prompt_id"), F.col("text").alias("prompt_text"), *rest, F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("rep"))


def call_model(calls: DataFrame, ask: Ask, retries: int = 2, timeout: float | None = 30.0, temperature: float = 0.9, delay: float = 0.0, tasks: int = 3) -> DataFrame:
    """Each row's prompt_text asked, ``tasks`` at a time: all columns, then temperature, timestamp, finish_reason, text,
    error. A failed call has no text."""
    ship(calls.sparkSession)
    added = T.StructType().add("temperature", "double").add("timestamp", "string").add("finish_reason", "string").add("text", "string").add("error", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = []
            for prompt in batch["prompt_text"]:
                got.append((*ask_model(prompt, ask, retries, timeout), _now()))
                time.sleep(delay)
            out = batch.assign(temperature=temperature)
            for name, k in (("timestamp", 3), ("finish_reason", 1), ("text", 0), ("error", 2)):
                out[name] = [g[k] for g in got]
            yield out

    return calls.repartition(tasks).mapInPandas(run, T.StructType([*calls.schema.fields, *added.fields]))


def run_prompts(prompts: DataFrame, ask: Ask, runs: int = 3, **pacing) -> DataFrame:
    """Every prompt (id, text, ...) asked so many times: prompt_id, prompt_text, the prompt's other columns, run_id,
    temperature, timestamp, finish_reason, text, error. Ids are the same in a retry. Nothing is kept of what was asked
    before a failure; ``call_log`` does that."""
    answered = call_model(with_repetitions(prompts, runs), ask, **pacing)
    named = answered.withColumn("run_id", F.concat("prompt_id", F.lit("#"), F.col("rep").cast("string")))
    return named.select(*[c for c in answered.columns if c not in ("rep", "temperature", "timestamp", "finish_reason", "text", "error")], "run_id", "temperature", "timestamp", "finish_reason", "text", "error")


def replay(recorded: DataFrame, prompts: DataFrame) -> DataFrame:
    """Recorded runs (run_id, prompt_id, text, error) of the given prompts instead of calls, with the prompts' columns."""
    rest = [c for c in prompts.columns if c not in ("id", "text", "ord")]
    asked = prompts.select(F.col("id").alias("prompt_id"), F.col("text").alias("prompt_text"), *rest)
    return recorded.select("run_id", "prompt_id", "text", "error").join(asked, "prompt_id")
